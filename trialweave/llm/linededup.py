"""Cross-site boilerplate lines, by how many distinct sites show them.

Every line hash gets a HyperLogLog sketch of its sites; partial sketches merge by aggregation, so a line that
stands in a third of all rows is a few sketches, not a group of rows. Lines whose estimate lies within the sketch's
error of the threshold get an exact distinct count; clearly wider ones are taken as they are. Such lines leave
every row but the one of their first occurrence (smallest id, then place).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free, written

SITES = 3  # distinct sites from which a line is boilerplate
LOG_K = 10  # sketch size: 2^LOG_K registers, relative error about 1.04 / sqrt(2^LOG_K)
LINE = ["h", "g"]


def split_lines(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def spread_lines(lines: DataFrame, sites: int = SITES) -> DataFrame:
    """(h, g, first): lines on at least ``sites`` distinct sites, with their first occurrence."""
    error = 3 * 1.04 / math.sqrt(1 << LOG_K)
    sketched = lines.groupBy(*LINE).agg(F.hll_sketch_agg("site", LOG_K).alias("sketch"), F.min(F.struct("id", "at", "row")).alias("first"), F.count(F.lit(1)).alias("n"))
    wide = sketched.where(F.col("n") >= sites).select(*LINE, "first", F.hll_sketch_estimate("sketch").alias("estimate"))
    wide = written(wide.where(F.col("estimate") >= math.floor(sites * (1 - error))), "wide")
    sure = wide.where(F.col("estimate") > math.ceil(sites * (1 + error)))
    near = wide.where(F.col("estimate") <= math.ceil(sites * (1 + error)))
    seen = lines.join(near.select(*LINE), LINE, "left_semi").where("site IS NOT NULL").groupBy(*LINE, "site").agg(F.lit(1).alias("one"))
    exact = seen.groupBy(*LINE).agg(F.count(F.lit(1)).alias("exact")).where(F.col("exact") >= sites)
    return sure.select(*LINE, "first").unionByName(near.join(exact, LINE, "left_semi").select(*LINE, "first"))


def remove_boilerplate(
    docs: DataFrame, ident: str = "doc_id", text: str = "text", site: str = "source", sites: int = SITES, out: str = "line_dedup"
) -> DataFrame:
    """``docs`` with ``out``: the text without boilerplate lines, the number of lines and of removed lines.

    Lines are compared without outer spaces; blank lines are never removed. A missing site counts for no spread,
    but lines of such rows are removed like others. A row without id comes first among occurrences; rows repeated
    with all their values share their lines' places and are treated alike. Null texts are one blank line.
    ``out`` replaces a column of that name; other columns stay.
    """
    names = [c for c in docs.columns if c != out]
    key, gone_id, gone_row, places = (free([*names, out], n) for n in ("_row", "_gone_id", "_gone_row", "_gone"))
    rows = docs.select(*names, F.xxhash64(ident, text, site).alias(key))  # rows of one id with other texts differ
    lines = rows.select(F.col(key).alias("row"), F.col(ident).alias("id"), F.col(site).cast("string").alias("site"), F.posexplode(split_lines(text)).alias("at", "line"))
    line = F.trim("line")
    lines = lines.where(line != "").select("row", "id", "site", "at", F.xxhash64(line).alias("h"), F.hash(line).alias("g"))
    lines = written(lines, "lines")
    spread = written(spread_lines(lines, sites), "spread")
    first = (F.col("first.id").eqNullSafe(F.col("id"))) & (F.col("first.at") == F.col("at")) & (F.col("first.row") == F.col("row"))
    gone = lines.join(spread, LINE).where(~first).select("id", "row", "at").distinct()
    gone = gone.groupBy(F.col("id").alias(gone_id), F.col("row").alias(gone_row)).agg(F.collect_set("at").alias(places))
    both = rows.join(gone, (F.col(key) == F.col(gone_row)) & F.col(ident).eqNullSafe(F.col(gone_id)), "left")
    kept = F.filter(split_lines(text), lambda x, i: ~F.array_contains(places, i))
    result = F.struct(
        F.when(F.col(places).isNull(), F.coalesce(F.col(text), F.lit(""))).otherwise(F.array_join(kept, "\n")).alias("text"),
        F.size(split_lines(text)).cast("bigint").alias("n_lines"), F.coalesce(F.size(places), F.lit(0)).cast("bigint").alias("n_removed"),
    )
    return both.select(*names, result.alias(out))
