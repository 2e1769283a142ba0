"""Block-held-out template decoding for many permutations of the labels at once.

The plain path (``patterns.decode``) makes one row of each unit, permutation and feature group. Here a task holds a
chunk of the units of one run as a matrix and the labels of a block of permutations as another:

1. an indicator of (permutation, class) times the unit matrix gives the class sums of the whole block of
   permutations; they are cut into feature tiles, so that the sums of all runs meet tile by tile;
2. per tile, totals minus own run are the held-out templates of each run;
3. a chunk of units meets the templates of its run and block: each place gathers its features from both matrices,
   and one product gives the correlations of all units, permutations and classes. Only hits and evidence, summed
   over the chunk, leave the task.

Units are sent once for each block of permutations, never once for each permutation, and one plan serves every width:
chunk and block shrink as vectors grow, so that each matrix holds about CELLS numbers. Members of the places are sent
in parts of at most PART numbers. Nothing is gathered on the driver but three counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors
from ..session import durable
from .ordered import FEW_ROWS
from .patterns import DIGITS, centre_blocks

CELLS = 1 << 21  # numbers of a matrix in a task, about 16 MB
TILE = 128  # features of a tile of class sums
UNITS = 1_024  # units of a chunk, at most
PERMS = 128  # permutations of a block, at most
PART = 1 << 20  # members of places in one part


def even_places(count: int, width: int, spark, key: str = "region") -> DataFrame:
    """(key, dims): consecutive equal slices of the vector."""
    return spark.range(count).select(F.col("id").cast("int").alias(key), F.sequence((F.col("id") * width).cast("int"), ((F.col("id") + 1) * width - 1).cast("int")).alias("dims"))


def near_places(membership: DataFrame, key: str = "centre") -> DataFrame:
    """(key, dims) from (key, dim) rows: one array of members for each centre."""
    return membership.groupBy(key).agg(F.array_sort(F.collect_set(F.col("dim").cast("int"))).alias("dims"))


def _chunked(units: DataFrame, unit: str, by: list[str], size: int) -> DataFrame:
    """Units with ``_chunk``: about ``size`` units of one run share a number, however large the run."""
    counts = units.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / size).alias("_chunks"))
    return units.join(counts, by).withColumn("_chunk", F.pmod(F.xxhash64(unit), F.col("_chunks"))).drop("_chunks")


def _packed_labels(keys: list[str], unit: str):
    """Labels of a group of permutations, in the order of permutation and unit, as a few bytes each."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def pack(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, sort_keys=[("perm", "ascending"), (unit, "ascending"), ("c", "ascending")]))
        if table["c"].null_count:
            raise ValueError("a label is missing")
        c, (perm, times) = table["c"].to_numpy(), np.unique(table["perm"].to_numpy(), return_counts=True)
        least, most = int(c.min()), int(c.max())
        form = next((f for f, size in (("u1", 8), ("<u2", 16), ("<u4", 32)) if most - least < 1 << size), "<i8")
        least = 0 if form == "<i8" else least
        row = {"perm": perm.tolist(), "times": times.tolist(), "least": least, "form": form, "c": (c - least).astype(form).tobytes()}
        kind = pa.struct([("perm", pa.list_(pa.int32())), ("times", pa.list_(pa.int32())), ("least", pa.int64()), ("form", pa.string()), ("c", pa.binary())])
        return table.slice(0, 1).select(keys).append_column("labels", pa.array([row], kind))

    return pack


def permuted_scores(
    units: DataFrame, unit: str, block: str, label: str, vec: str, places: DataFrame, key: str, labels: DataFrame, width: int, min_features: int = 1,
    keys: list[str] | None = None, source: str | None = None,
) -> DataFrame:
    """(keys, perm, place, accuracy, evidence, n, n_features, status) of leave-one-block-out template decoding.

    ``labels`` (perm, unit, permuted) names the label of every unit in every permutation. Vectors are centred within
    their block; prediction, ties and evidence are those of ``patterns.decode``: the nearest template by correlation,
    rounded to DIGITS, the smallest class among equals, own similarity minus the mean of the others. A place of fewer
    than ``min_features`` features keeps its rows, without statistics, and ``status`` says so. Labels are integers.

    ``keys`` (a subject) hold blocks of their own: templates never cross them. With ``source``, an integer column that
    is not permuted, each source has templates of its own, every unit is decoded by the templates of each source, and
    the rows are told apart by ``source`` and ``target``, the source of the tested units (both missing for places that
    are too small).
    """
    import numpy as np
    import pandas as pd

    keys = list(keys or [])
    by = [*keys, block]
    units = units.withColumn("_g", F.lit(0).cast("bigint") if source is None else F.col(source).cast("bigint"))
    classes = labels.agg(F.count_distinct("permuted"), F.max("perm")).first()
    if not classes[0]:
        return _no_scores(units, places, key, keys, source)
    groups = units.select("_g").distinct().agg(F.array_sort(F.collect_list("_g")).alias("groups"))
    each, many = int(classes[0]), len(groups.first()[0])
    most = each * many
    chunk = max(1, min(UNITS, CELLS // width))
    perms = max(1, min(PERMS, CELLS // (most * max(width, chunk))))

    raw = durable(vectors.sum_vectors(units, by, vec, "_s", "_n", width))
    means = raw.select(*by, vectors.divide("_s", "_n").alias("block_mean"))
    moved = durable(_chunked(centre_blocks(units.select(unit, *by, "_g", vec), means, by, vec), unit, by, chunk))
    rows = moved.groupBy(*by, "_chunk").agg(F.array_sort(F.collect_list(F.struct(F.col(unit).alias("u"), F.col(vec).alias("x"), F.col("_g").alias("g")))).alias("rows"))
    places_of = moved.select(unit, *by, "_chunk")
    # Labels are many short rows, which compress to a small file: only the units may be broadcast, and counted first.
    named = labels.select("perm", unit, F.col("permuted").cast("bigint").alias("c"))
    named = named.join(F.broadcast(places_of) if places_of.count() <= FEW_ROWS else places_of.hint("merge"), unit)
    named = named.withColumn("_block", F.floor(F.col("perm") / perms).cast("bigint"))
    kind = ", ".join(f"{name} {units.schema[name].dataType.simpleString()}" for name in by)
    named = named.groupBy(*by, "_chunk", "_block").applyInArrow(_packed_labels([*by, "_chunk", "_block"], unit), f"{kind}, _chunk bigint, _block bigint, labels struct<perm: array<int>, times: array<int>, least: bigint, form: string, c: binary>")
    forms = labels.select(F.col("permuted").cast("bigint").alias("c")).distinct().agg(F.array_sort(F.collect_list("c")).alias("classes"))
    met = rows.join(named, [*by, "_chunk"]).join(forms, F.lit(True)).join(groups, F.lit(True))  # one row of classes, one of sources
    met = durable(met)

    def matrices(one) -> tuple:
        """(units x width, perms x units numbers of classes, sources of the units, permutations)."""
        x = np.stack([np.asarray(r["x"], float) for r in one["rows"]])
        if x.shape[1] != width or not np.isfinite(x).all():
            raise ValueError(f"a vector is not of width {width} or misses an element")
        drawn = one["labels"]
        perm = np.repeat(drawn["perm"], drawn["times"]).reshape(-1, len(x))
        c = np.frombuffer(drawn["c"], drawn["form"]).astype(np.int64) + drawn["least"]
        c = np.searchsorted(np.asarray(one["classes"]), c).reshape(perm.shape)
        g = np.searchsorted(np.asarray(one["groups"]), np.array([r["g"] for r in one["rows"]]))
        return x, c, g, perm[:, 0]

    def sums(group: pd.DataFrame) -> pd.DataFrame:
        one = group.iloc[0]
        x, c, g, _ = matrices(one)
        total, count = np.empty((len(c), most, width)), np.empty((len(c), most), np.int64)
        for k in range(most):
            at = g == k // each
            own = (c[:, at] == k % each).astype(float)
            total[:, k], count[:, k] = own @ x[at], own.sum(1)
        tiles = range(0, width, TILE)
        return pd.DataFrame({
            **{name: [one[name]] * len(tiles) for name in by}, "_block": [one["_block"]] * len(tiles), "_tile": [t // TILE for t in tiles],
            "s": [total[:, :, t : t + TILE].ravel() for t in tiles], "n": [count.ravel()] * len(tiles),
        })

    cube = met.groupBy(*by, "_chunk", "_block").applyInPandas(sums, f"{kind}, _block bigint, _tile int, s array<double>, n array<bigint>")

    def held_out(group: pd.DataFrame) -> pd.DataFrame:
        runs = group.groupby(block, sort=True)  # the runs' sums of one tile and block of permutations
        s = {r: np.sum(np.stack(g["s"].to_list()), 0) for r, g in runs}
        n = {r: np.sum(np.stack(g["n"].to_list()), 0) for r, g in runs}
        all_s, all_n = sum(s.values()), sum(n.values())
        out = []
        for r in s:
            left = (all_n - n[r])[:, None]
            rest = (all_s - s[r]).reshape(len(left), -1)
            out.append((*(group[name].iloc[0] for name in keys), r, group["_block"].iloc[0], group["_tile"].iloc[0], np.where(left > 0, rest / np.maximum(left, 1), np.nan).ravel()))
        return pd.DataFrame(out, columns=[*by, "_block", "_tile", "t"])

    templates = cube.groupBy(*keys, "_block", "_tile").applyInPandas(held_out, f"{kind}, _block bigint, _tile int, t array<double>")
    templates = durable(templates.groupBy(*by, "_block").agg(F.array_sort(F.collect_list(F.struct("_tile", "t"))).alias("tiles")))

    sized = durable(places.select(key, "dims", F.size("dims").alias("n_features")))
    usable = sized.where(F.col("n_features") >= max(1, min_features))
    members = usable.agg(F.sum("n_features")).first()[0] or 0
    parts = max(1, -(-int(members) // PART))
    part = usable.groupBy(F.pmod(F.xxhash64(key), F.lit(parts)).alias("_part")).agg(F.collect_list(F.struct(F.col(key).alias("place"), "dims")).alias("places"))
    # Both sides are arrays that grow with units and permutations, and Spark takes a written table for as small as its source.
    rows = met.join(templates.hint("merge"), [*by, "_block"]).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint")))).join(part, "_part")

    def unit_length(m):
        m = m - m.mean(-1, keepdims=True)
        norm = np.sqrt((m * m).sum(-1, keepdims=True))
        return np.where(norm > 2.220446049250313e-16, m / np.where(norm > 0, norm, 1), np.nan)

    def decide(group: pd.DataFrame) -> pd.DataFrame:
        one = group.iloc[0]
        x, c, g, perm = matrices(one)
        t = np.concatenate([np.asarray(p["t"]).reshape(len(c), most, -1) for p in one["tiles"]], 2)
        shape = (len(c), len(x), many, each)  # permutation, unit, source, class
        present = np.broadcast_to(~np.isnan(t[:, :, 0]).reshape(len(c), 1, many, each), shape)  # a class without training rows is no candidate
        mine = np.broadcast_to(c[:, :, None, None], (*shape[:3], 1))
        able = np.take_along_axis(present, mine, 3)[..., 0]
        count = present[:, :1].sum(3)
        met_any = (count[:, 0] > 0).ravel()  # a source without any template decodes no unit
        others = np.where(count > 1, count - 1, np.nan)
        names = np.asarray(one["groups"])
        out = []
        for p in one["places"]:
            dims = np.asarray(p["dims"])
            a, b = unit_length(x[:, dims]), unit_length(t[:, :, dims])
            r = (b.reshape(-1, len(dims)) @ a.T).reshape(len(c), many, each, len(x)).transpose(0, 3, 1, 2)
            ranked = np.where(np.isnan(r), -np.inf, np.round(r, DIGITS))
            hit = np.isfinite(ranked.max(3)) & (ranked.argmax(3) == c[:, :, None])  # the first of equals
            own = np.where(able, np.take_along_axis(r, mine, 3)[..., 0], np.nan)
            evidence = own - (np.where(present, r, 0.0).sum(3) - own) / others
            fine = np.isfinite(evidence)
            evidence = np.where(fine, evidence, 0.0)
            for k in np.unique(g):
                at = g == k
                out.append(pd.DataFrame({
                    **{name: [one[name]] * (len(c) * many) for name in keys}, "place": [p["place"]] * (len(c) * many), "perm": np.repeat(perm, many),
                    "source": np.tile(names, len(c)), "target": np.full(len(c) * many, names[k]), "n": at.sum() * met_any,
                    "hits": hit[:, at].sum(1).ravel(), "e": evidence[:, at].sum(1).ravel(), "e_n": fine[:, at].sum(1).ravel(),
                }))
        return pd.concat(out, ignore_index=True)

    place = places.schema[key].dataType.simpleString()
    apart = "".join(f"{name} {units.schema[name].dataType.simpleString()}, " for name in keys)
    scored = rows.groupBy(*by, "_chunk", "_block", "_part").applyInPandas(decide, f"{apart}place {place}, perm int, source bigint, target bigint, n bigint, hits bigint, e double, e_n bigint")
    pair = ["source", "target"] if source else []
    total = scored.groupBy(*keys, "place", "perm", *pair).agg(*[F.sum(v).alias(v) for v in ("n", "hits", "e", "e_n")]).where("n > 0")
    total = total.select(
        *keys, F.col("place").alias(key), "perm", *pair, (F.col("hits") / F.col("n")).alias("accuracy"), F.when(F.col("e_n") > 0, F.col("e") / F.col("e_n")).alias("evidence"), "n")
    small = sized.where(F.col("n_features") < max(1, min_features)).withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(int(classes[1])))))
    if keys:
        small = small.join(raw.select(*keys).distinct(), F.lit(True))  # places that are too small x subjects
    kept = total.join(sized.select(key, "n_features"), key).withColumn("status", F.lit("ok"))
    none = F.lit(None).cast("double")
    lost = small.select(
        *keys, key, "perm", *[F.lit(None).cast("bigint").alias(c) for c in pair], none.alias("accuracy"), none.alias("evidence"), F.lit(0).cast("bigint").alias("n"),
        "n_features", F.lit("insufficient_features").alias("status"))
    return kept.select(*lost.columns).unionByName(lost)


def _no_scores(units: DataFrame, places: DataFrame, key: str, keys: list[str], source: str | None) -> DataFrame:
    """The empty result of an empty label table."""
    none = F.lit(None)
    pair = [none.cast("bigint").alias(c) for c in (("source", "target") if source else ())]
    empty = places.limit(0).join(units.limit(0).select(*keys), F.lit(True)) if keys else places.limit(0)
    empty = empty.select(*keys, key, none.cast("int").alias("perm"), *pair, none.cast("double").alias("accuracy"), none.cast("double").alias("evidence"), none.cast("bigint").alias("n"))
    return empty.withColumns({"n_features": F.lit(0), "status": F.lit("ok")})
