"""Fitted models: mixtures, components, discriminants, support vectors, nested selection."""

from __future__ import annotations

from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors
from .ordered import join_few


def mixture_threshold(df: DataFrame, value: str, seed: int = 1, steps: int = 500) -> DataFrame:
    """Two-component mixture of a value; rows above the lower component mean are kept. No convergence is an error."""
    data = df.withColumn("_f", array_to_vector(F.array(F.col(value))))
    model = GaussianMixture(k=2, featuresCol="_f", seed=seed, maxIter=steps).fit(data)
    if model.summary.numIter >= steps:
        raise RuntimeError(f"the mixture still moves after {steps} steps")
    low = min(float(g.mean[0]) for g in model.gaussians)
    return df.withColumn("kept", F.col(value) > F.lit(low))


def first_component(df: DataFrame, vec: str, keep: list[str]) -> DataFrame:
    """Projection on the first principal component, signed so that its largest weight is positive."""
    data = df.select(*keep, array_to_vector(vec).alias("_f"))
    model = PCA(k=1, inputCol="_f", outputCol="_p").fit(data)
    weights = [float(v) for v in model.pc.toArray()[:, 0]]
    sign = 1.0 if max(weights, key=abs) > 0 else -1.0
    return model.transform(data).select(*keep, (vector_to_array("_p")[0] * sign).alias("score"))


def best_candidate(df: DataFrame, keys: list[str], order: str, score: str, tolerance: float = 1e-12) -> DataFrame:
    """First candidate, in candidate order, within the tolerance of the best score."""
    best = df.groupBy(*keys).agg(F.max(score).alias("_best"))
    near = df.join(best, keys).where(F.col(score) >= F.col("_best") - tolerance)
    return near.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in df.columns if c not in keys]), order).alias("_w")).select(
        *keys, *[F.col(f"_w.{c}").alias(c) for c in df.columns if c not in keys]
    )


def class_moments(units: DataFrame, keys: list[str], block: str, label: str, vec: str) -> DataFrame:
    """(keys, block, label, n, s, ss): sums and sums of products per block and class.

    Tasks add up their own units with numpy and send one row per (key, block, class);
    the partial sums are then added by Spark.
    """
    import pandas as pd

    by = [*keys, block, label]
    slim = units.select(*by, vec)

    def partial(batches):
        import numpy as np

        held: dict = {}
        for batch in batches:
            for key, part in batch.groupby(by, sort=False):
                x = np.stack(part[vec].to_numpy())
                n, s, ss = held.get(key, (0, 0.0, 0.0))
                held[key] = (n + len(x), s + x.sum(0), ss + (x.T @ x)[np.triu_indices(x.shape[1])])
        rows = [(*k, n, s.tolist(), ss.tolist()) for k, (n, s, ss) in held.items()]
        yield pd.DataFrame(rows, columns=[*by, "n", "s", "ss"])

    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.schema if f.name in by)
    parts = slim.mapInPandas(partial, f"{head}, n bigint, s array<double>, ss array<double>")
    a = vectors.add_sums(parts, by, "s", "n", "s", "n")
    b = vectors.add_sums(parts, by, "ss", "n", "ss", "_n2").drop("_n2")
    return a.join(b, by)


def lda_weights(moments: DataFrame, keys: list[str], gammas: list[float]) -> DataFrame:
    """(keys, gamma, candidate, w, b) of shrunken linear discriminants with equal priors.

    One group holds one row per class: its sums, whatever the number of units was.
    """
    import pandas as pd

    cols = [*keys, "label", "n", "s", "ss"]

    def solve(pdf):
        import numpy as np

        d = len(pdf["s"].iloc[0])
        n = pdf["n"].to_numpy(dtype=float)
        means = np.stack(pdf["s"].to_numpy()) / n[:, None]
        total = np.zeros((d, d))
        total[np.triu_indices(d)] = np.sum(np.stack(pdf["ss"].to_numpy()), axis=0)
        total = total + np.triu(total, 1).T
        pooled = (total - (means * n[:, None]).T @ means) / max(n.sum() - len(n), 1)
        rows = []
        for gamma in gammas:
            cov = (1 - gamma) * pooled + gamma * np.diag(np.diag(pooled))
            w = np.linalg.pinv(cov) @ means.T
            for c, label in enumerate(pdf["label"]):
                rows.append((*[pdf[k].iloc[0] for k in keys], gamma, int(label), w[:, c].tolist(), float(-0.5 * means[c] @ w[:, c])))
        return pd.DataFrame(rows, columns=[*keys, "gamma", "candidate", "w", "b"])

    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in moments.schema if f.name in keys)
    return moments.select(*cols).groupBy(*keys).applyInPandas(solve, f"{head}, gamma double, candidate int, w array<double>, b double")


def train_moments(moments: DataFrame, keys: list[str], block: str) -> DataFrame:
    """Moments of every training set that leaves one block out: total minus own block."""
    def roll(vec):
        return vectors.add_sums(moments, [*keys, "label"], vec, "n", f"t_{vec}", "t_n")

    total = roll("s").join(roll("ss").drop("t_n"), [*keys, "label"])
    blocks = moments.select(*keys, block).distinct()
    grid = blocks.join(total, keys) if keys else blocks.join(total, F.lit(True))  # folds x classes
    own = moments.select(*keys, block, "label", F.col("n").alias("o_n"), F.col("s").alias("o_s"), F.col("ss").alias("o_ss"))
    g = grid.join(own, [*keys, block, "label"], "left")

    def less(a, b):
        return F.when(F.col(b).isNull(), F.col(a)).otherwise(vectors.subtract(a, b))

    return g.select(
        *keys, block, "label", (F.col("t_n") - F.coalesce("o_n", F.lit(0))).alias("n"), less("t_s", "o_s").alias("s"), less("t_ss", "o_ss").alias("ss")
    ).where("n > 0")


def linear_predict(tests: DataFrame, weights: DataFrame, on: list[str], by: list[str], unit: str, truth: str, vec: str) -> DataFrame:
    """Class with the largest linear score; ties to the smallest class."""
    scored = join_few(tests, weights, on).withColumn("_s", F.round(vectors.dot(vec, "w") + F.col("b"), 10))
    return scored.groupBy(*dict.fromkeys([*on, *by]), unit, truth).agg(
        F.max_by("candidate", F.struct("_s", (-F.col("candidate")).alias("c"))).alias("predicted")
    )


def lda_cross_validate(units: DataFrame, keys: list[str], unit: str, block: str, label: str, vec: str, gammas: list[float]) -> DataFrame:
    """(keys, block, gamma, unit, label, predicted) leaving one block out."""
    m = class_moments(units, keys, block, label, vec).withColumnRenamed(label, "label")
    w = lda_weights(train_moments(m, keys, block), [*keys, block], gammas)
    return linear_predict(units.select(*keys, block, unit, label, vec), w, [*keys, block], ["gamma"], unit, label, vec)


CELLS = 1 << 20  # numbers of the largest matrix of a task, about 8 MB


def fit_linear_svms(units: DataFrame, keys: list[str], vec: str, label: str, held: dict[str, list], models: list[dict], rounds: int = 50) -> DataFrame:
    """Linear support vector machines for many training sets at once.

    ``models`` lists dicts with the two classes, the cost and, per held-out column in
    ``held``, the value left out (None = nothing). Squared hinge loss is minimised by
    Newton steps. A step is one pass: each task adds gradient and curvature of its own
    units for every model and key, Spark adds those sums, tasks solve the small systems,
    and only the weights (models x keys x features) come back for the next step. Weights that
    still move after ``rounds`` steps are an error.
    """
    import numpy as np
    import pandas as pd

    spark = units.sparkSession
    slim = units.select(*keys, label, vec, *held)
    width = slim.select(F.size(vec).alias("d")).first()["d"] + 1
    iu = np.triu_indices(width)
    first, second = (np.array([m["classes"][n] for m in models]) for n in (0, 1))
    cost = np.array([m["cost"] for m in models])
    # Held-out values per model; where a model has fewer, NaN, which equals no block.
    most = {c: max(len(m[c]) for m in models) for c in held}
    left_out = {c: [np.array([float(m[c][n]) if n < len(m[c]) else np.nan for m in models]) for n in range(most[c])] for c in held}
    state: dict = {}

    def one_pass(weights):
        shared = spark.sparkContext.broadcast(weights)

        def partial(batches):
            sums: dict = {}
            for batch in batches:
                at_once = np.arange(len(batch)) // max(1, CELLS // len(models))  # bounds rows x models
                for (*key, _), part in batch.groupby([*keys, at_once], sort=False):
                    key = tuple(key)
                    x = np.column_stack([np.stack(part[vec].to_numpy()), np.ones(len(part))])
                    y = part[label].to_numpy()[:, None]
                    use = (y == first) | (y == second)
                    for c, values in left_out.items():
                        for v in values:
                            use &= part[c].to_numpy()[:, None] != v
                    side = np.where(y == first, 1.0, -1.0)
                    w = shared.value.get(key)
                    margin = 1 - side * (x @ w.T) if w is not None else np.ones(use.shape)
                    active = use & (margin > 0)
                    g = (x.T @ (side * margin * active)).T * (-2 * cost[:, None])
                    products = x[:, iu[0]] * x[:, iu[1]]  # one row per unit serves every model
                    h = (products.T @ active.astype(float)).T * (2 * cost[:, None])
                    sums[key] = sums.get(key, 0.0) + np.column_stack([g, h])
            rows = [(*k, m, row.tolist()) for k, total in sums.items() for m, row in enumerate(total)]
            yield pd.DataFrame(rows, columns=[*keys, "model", "sums"])

        def step(batches):
            # Rows are per task, key and model; a partition holds whole (key, model) pairs.
            held_sums: dict = {}
            for batch in batches:
                for *k, m, row in batch[[*keys, "model", "sums"]].itertuples(index=False, name=None):
                    at = (tuple(k), m)
                    held_sums[at] = held_sums.get(at, 0.0) + np.asarray(row)
            if not held_sums:
                return
            total = np.stack(list(held_sums.values()))
            reg = np.eye(width)
            reg[-1, -1] = 1e-6
            h = np.zeros((len(total), width, width))
            h[:, iu[0], iu[1]] = total[:, width:]
            h[:, iu[1], iu[0]] = total[:, width:]
            old = [shared.value.get(k) for k, _ in held_sums]
            w = np.stack([np.zeros(width) if o is None else o[m] for o, (_, m) in zip(old, held_sums)])
            new_w = w - np.linalg.solve(h + reg, (total[:, :width] + w @ reg)[:, :, None])[:, :, 0]
            rows = [(*k, m, v.tolist()) for (k, m), v in zip(held_sums, new_w)]
            yield pd.DataFrame(rows, columns=[*keys, "model", "w"])

        parts = slim.mapInPandas(partial, f"{head}, model int, sums array<double>")
        return parts.repartition(*keys, "model").mapInPandas(step, f"{head}, model int, w array<double>")

    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.schema if f.name in keys)
    for _ in range(rounds):
        # One short weight row per model and key comes back; their number is set by the caller's models.
        new: dict = {}
        for r in one_pass(state).collect():
            new.setdefault(tuple(r[k] for k in keys), np.zeros((len(models), width)))[r["model"]] = r["w"]
        done = bool(state) and max(float(np.abs(new[k] - state[k]).max()) for k in new) < 1e-6
        state = new
        if done or not state:
            break
    else:
        raise RuntimeError(f"support vector weights still move after {rounds} rounds")
    rows = [(*k, m, int(first[m]), int(second[m]), w[:-1].tolist(), float(w[-1])) for k, ws in state.items() for m, w in enumerate(ws)]
    return spark.createDataFrame(rows, f"{head}, model int, first int, second int, w array<double>, b double")


def vote(tests: DataFrame, machines: DataFrame, on: list[str], by: list[str], unit: str, truth: str, vec: str) -> DataFrame:
    """One vote per class pair; the most votes win, ties to the smallest class."""
    scored = join_few(tests, machines, on).withColumn("candidate", F.when(vectors.dot(vec, "w") + F.col("b") > 0, F.col("first")).otherwise(F.col("second")))
    group = list(dict.fromkeys([*on, *by]))
    votes = scored.groupBy(*group, unit, truth, "candidate").agg(F.count(F.lit(1)).alias("_v"))
    return votes.groupBy(*group, unit, truth).agg(F.max_by("candidate", F.struct("_v", (-F.col("candidate")).alias("c"))).alias("predicted"))


def class_pairs(classes: list[int]) -> list[list[int]]:
    return [[a, b] for n, a in enumerate(classes) for b in classes[n + 1:]]


def svm_cross_validate(units: DataFrame, keys: list[str], unit: str, block: str, label: str, vec: str, classes: list[int], cost: float) -> DataFrame:
    """One-against-one voting, leaving one block out; all folds and pairs are fitted together."""
    blocks = sorted(r[0] for r in units.select(block).distinct().collect())  # recording blocks: tens
    models = [{"classes": p, "cost": cost, block: [b]} for b in blocks for p in class_pairs(classes)]
    fitted = fit_linear_svms(units, keys, vec, label, {block: []}, models)
    left = F.array(*[F.lit(m[block][0]) for m in models])
    fitted = fitted.withColumn(block, F.element_at(left, F.col("model") + 1).cast(units.schema[block].dataType))
    return vote(units.select(*keys, block, unit, label, vec), fitted, [*keys, block], [], unit, label, vec)


GAMMAS = [0.0, 0.25, 0.5, 0.75, 1.0]
COSTS = [0.001, 0.01, 0.1, 1.0, 10.0, 100.0]


def nested_selection(
    units: DataFrame, keys: list[str], unit: str, block: str, fold: str, label: str, vec: str, classes: list[int],
    gammas: list[float] = GAMMAS, costs: list[float] = COSTS,
) -> DataFrame:
    """(keys, fold, candidate, n_units, accuracy, balanced_accuracy): inner folds choose, the outer fold is scored once.

    Inner folds are the other outer folds. A candidate is a shrinkage (1..) or a cost
    (after them); the first within 1e-12 of the best mean balanced accuracy wins.
    """
    from ..session import durable
    from .summaries import accuracy

    folds = sorted(r[0] for r in units.select(fold).distinct().collect())
    units = durable(units.select(*keys, unit, fold, label, vec))
    # Moments of each training set: all folds but the outer and, inside, but one more.
    m = durable(class_moments(units, keys, fold, label, vec).withColumnRenamed(label, "label"))
    kind = m.schema[fold].dataType
    outer = F.explode(F.array(*[F.lit(f).cast(kind) for f in folds]))
    rest = m.withColumn("outer", outer).where(F.col(fold) != F.col("outer"))
    inner_w = lda_weights(train_moments(rest, [*keys, "outer"], fold), [*keys, "outer", fold], gammas)
    tests = units.withColumn("outer", outer).where(F.col(fold) != F.col("outer"))
    inner = linear_predict(tests, inner_w, [*keys, "outer", fold], ["gamma"], unit, label, vec)
    rank = F.array_position(F.array(*[F.lit(g) for g in gammas]), F.col("gamma")).cast("int")
    inner = inner.withColumn("choice", rank).drop("gamma")
    outer_w = lda_weights(train_moments(m, keys, fold), [*keys, fold], gammas)
    final = linear_predict(units, outer_w, [*keys, fold], ["gamma"], unit, label, vec).withColumn("choice", rank).drop("gamma")

    specs, place = [], []
    for n, c in enumerate(costs):
        for o in folds:
            for p in class_pairs(classes):
                specs.append({"classes": p, "cost": c, fold: [o]})
                place.append((len(gammas) + n + 1, o, o))
                for i in folds:
                    if i != o:
                        specs.append({"classes": p, "cost": c, fold: [o, i]})
                        place.append((len(gammas) + n + 1, o, i))
    machines = durable(fit_linear_svms(units, keys, vec, label, {fold: []}, specs))
    lookup = F.array(*[F.struct(F.lit(a).alias("choice"), F.lit(o).alias("outer"), F.lit(i).alias(fold)) for a, o, i in place])
    at = machines.withColumn("_p", F.element_at(lookup, F.col("model") + 1)).select(*keys, "first", "second", "w", "b", "_p.choice", "_p.outer", f"_p.{fold}")
    svm_inner = vote(tests, at.where(F.col("outer") != F.col(fold)), [*keys, "outer", fold], ["choice"], unit, label, vec)
    svm_final = vote(units, at.where(F.col("outer") == F.col(fold)).drop("outer"), [*keys, fold], ["choice"], unit, label, vec)

    inner = inner.unionByName(svm_inner)
    scores = accuracy(inner, [*keys, "outer", fold, "choice"], label, "predicted")
    mean = scores.groupBy(*keys, "outer", "choice").agg(F.avg("balanced_accuracy").alias("score"))
    chosen = best_candidate(mean, [*keys, "outer"], "choice", "score").select(*keys, F.col("outer").alias(fold), "choice")
    final = final.unionByName(svm_final).join(chosen, [*keys, fold, "choice"])
    return accuracy(final, [*keys, fold, "choice"], label, "predicted").withColumnRenamed("choice", "candidate")
