"""Sparse grids: indices, neighbourhoods, components, resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable


def linear_index(i: str, j: str, k: str, ni: int, nj: int) -> Column:
    """Column-major, 1-based index of 0-based grid coordinates."""
    return (F.col(i) + ni * (F.col(j) + nj * F.col(k)) + 1).cast("bigint")


def upper_index(i: str, j: str) -> Column:
    """1-based place of the 0-based pair i < j, column by column."""
    j_ = F.col(j)
    return (j_ * (j_ - 1) / 2 + F.col(i) + 1).cast("bigint")


def world(affine: list[list[float]], i: str = "i", j: str = "j", k: str = "k") -> list[Column]:
    """World coordinates of a cell under a 3x4 affine."""
    return [F.col(i) * a[0] + F.col(j) * a[1] + F.col(k) * a[2] + F.lit(float(a[3])) for a in affine]


def offsets_mm(affine: list[list[float]], radius: float, strict: bool = False) -> list[tuple[int, int, int]]:
    """Grid steps whose physical length is within the radius; a geometry constant."""
    steps = [sum(row[c] ** 2 for row in affine) ** 0.5 for c in range(3)]
    reach = int(radius // (min(steps) or 1.0)) + 2
    out = []
    for dx in range(-reach, reach + 1):
        for dy in range(-reach, reach + 1):
            for dz in range(-reach, reach + 1):
                d2 = sum((r[0] * dx + r[1] * dy + r[2] * dz) ** 2 for r in affine)
                if d2 < radius**2 - 1e-9 if strict else d2 <= radius**2 + 1e-9:
                    out.append((dx, dy, dz))
    return out


def offsets_voxel(radius: float) -> list[tuple[int, int, int]]:
    unit = [[1.0, 0, 0, 0], [0, 1.0, 0, 0], [0, 0, 1.0, 0]]
    return offsets_mm(unit, radius)


def shifted(df: DataFrame, offsets: list[tuple[int, int, int]]) -> DataFrame:
    """Every cell once per offset, with (ni, nj, nk) the cell stepped to."""
    lit = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip("xyz", o)]) for o in offsets])
    return (
        df.withColumn("_o", F.explode(lit))
        .withColumns({"ni": F.col("i") + F.col("_o.x"), "nj": F.col("j") + F.col("_o.y"), "nk": F.col("k") + F.col("_o.z")})
        .drop("_o")
    )


def neighbours(centres: DataFrame, members: DataFrame, offsets: list[tuple[int, int, int]], minimum: int = 1) -> DataFrame:
    """(i, j, k, ni, nj, nk): member cells around each centre with at least ``minimum`` of them."""
    near = shifted(centres.select("i", "j", "k"), offsets)
    cells = members.select(F.col("i").alias("ni"), F.col("j").alias("nj"), F.col("k").alias("nk"))
    near = near.join(cells, ["ni", "nj", "nk"])
    if minimum <= 1:
        return near
    big = near.groupBy("i", "j", "k").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= minimum)
    return near.join(big, ["i", "j", "k"], "left_semi")


def interior(mask: DataFrame, offsets: list[tuple[int, int, int]]) -> DataFrame:
    """Cells whose every offset stays inside the mask."""
    inside = neighbours(mask, mask, offsets).groupBy("i", "j", "k").agg(F.count(F.lit(1)).alias("_n"))
    return inside.where(F.col("_n") == len(offsets)).drop("_n")


TILE = 32  # edge of a labelling tile: at most 32^3 cells reach one group


def contract(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, label) of an edge table (a, b): every node with the smallest node of its component.

    Alternating large and small stars: each round hangs neighbours on the smallest node
    seen, first those above a node, then those below, until only stars are left. The
    number of rounds grows with the logarithm of the component, and a hub is only ever
    met through a minimum and a join.
    """
    state = durable(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    for _ in range(max_rounds):
        both = state.unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small_low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_low, "a")
        new = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b")))
        new = durable(new.where("a <> b").distinct())
        moved = new.join(state, ["a", "b"], "left_anti").limit(1).count() + state.join(new, ["a", "b"], "left_anti").limit(1).count()
        state = new
        if not moved:
            return state.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label"))
    raise RuntimeError(f"components not settled after {max_rounds} rounds")


def connected_components(mask: DataFrame) -> DataFrame:
    """(i, j, k, label): 6-connected components named by their smallest cell key.

    Cells are first labelled inside fixed tiles, whose size bounds a group; only the
    labels that touch across tile faces go on to the distributed contraction.
    """
    import pandas as pd

    shift = 1 << 20
    key = F.col("k").cast("bigint") * shift * shift + F.col("j") * shift + F.col("i")
    tiles = [F.floor(F.col(c) / TILE).alias(f"t{c}") for c in "ijk"]
    cells = mask.select("i", "j", "k").distinct().withColumn("cell", key.cast("bigint"))

    def label(pdf: "pd.DataFrame") -> "pd.DataFrame":
        parent = {c: c for c in pdf["cell"]}

        def root(c):
            while parent[c] != c:
                parent[c] = parent[parent[c]]
                c = parent[c]
            return c

        for c in pdf["cell"]:
            for step in (1, shift, shift * shift):
                if c + step in parent:
                    a, b = root(c), root(c + step)
                    parent[max(a, b)] = min(a, b)
        return pdf[["i", "j", "k", "cell"]].assign(label=[root(c) for c in pdf["cell"]])

    local = durable(cells.groupBy(*tiles).applyInPandas(label, "i int, j int, k int, cell bigint, label bigint"))
    faces = F.explode(F.array(*[F.lit(s) for s in (1, shift, shift * shift)]))
    edge_cells = local.where(" OR ".join(f"{c} % {TILE} = {TILE - 1}" for c in "ijk"))
    touching = edge_cells.select(F.col("label").alias("a"), F.col("cell"), faces.alias("_s")).select("a", (F.col("cell") + F.col("_s")).alias("cell"))
    edges = touching.join(local.select("cell", F.col("label").alias("b")), "cell").select("a", "b")
    roots = contract(edges).select(F.col("node").alias("label"), F.col("label").alias("_root"))
    return local.join(roots, "label", "left").select("i", "j", "k", F.coalesce("_root", "label").alias("label"))


def corner_weights(df: DataFrame, x: Column, y: Column, z: Column) -> DataFrame:
    """Eight source corners (si, sj, sk) with trilinear weights for each target row."""
    df = df.withColumns({"_x": x, "_y": y, "_z": z})
    corners = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.lit(c).alias("z")) for a in (0, 1) for b in (0, 1) for c in (0, 1)])
    df = df.withColumn("_c", F.explode(corners))

    def part(axis):
        value, bit = F.col(f"_{axis}"), F.col(f"_c.{axis}")
        frac = value - F.floor(value)
        return (F.floor(value) + bit).cast("int"), F.when(bit == 1, frac).otherwise(1 - frac)

    (si, wx), (sj, wy), (sk, wz) = part("x"), part("y"), part("z")
    return df.withColumns({"si": si, "sj": sj, "sk": sk, "weight": wx * wy * wz}).drop("_x", "_y", "_z", "_c")


def resample_nearest(target: DataFrame, source: DataFrame, affine: list[list[float]], value: str, fill: float) -> DataFrame:
    """Value of the nearest source cell for every target cell; off-grid cells get ``fill``."""
    x, y, z = (F.floor(c + 0.5).cast("int") for c in world(affine))
    aimed = target.select("i", "j", "k", x.alias("si"), y.alias("sj"), z.alias("sk"))
    src = source.select(F.col("i").alias("si"), F.col("j").alias("sj"), F.col("k").alias("sk"), F.col(value).alias("_v"))
    return aimed.join(src, ["si", "sj", "sk"], "left").select("i", "j", "k", F.coalesce("_v", F.lit(fill)).alias(value))


def resample_trilinear(target: DataFrame, source: DataFrame, affine: list[list[float]], value: str) -> DataFrame:
    aimed = corner_weights(target.select("i", "j", "k"), *world(affine))
    src = source.select(F.col("i").alias("si"), F.col("j").alias("sj"), F.col("k").alias("sk"), F.col(value).alias("_v"))
    hit = aimed.join(src, ["si", "sj", "sk"], "left")
    return hit.groupBy("i", "j", "k").agg(F.sum(F.col("weight") * F.coalesce("_v", F.lit(0.0))).alias(value))
