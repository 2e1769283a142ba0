"""Repeated-measures pattern analytics as plain Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Python functions travel to the executors by value: no package install is needed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
