"""All registered queries."""

from . import decoding, geometry, joins, resampling, rows, scans, series, trials  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
