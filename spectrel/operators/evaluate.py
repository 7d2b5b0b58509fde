"""Evaluation of scored tables: confusion, precision/recall, regression error, intervals."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions import vectors as V
from .splits import ranked

NAN = float("nan")
#: Draws made, and joined to their rows, in one task.
PART_DRAWS = 1 << 21


# ---------------------------------------------------------------- point metrics


def confusion_matrix(df: DataFrame, n_classes: int, true: str = "class_true", pred: str = "class_pred") -> DataFrame:
    """Dense counts: one row for each of the K x K (true, predicted) pairs, zeros included.

    A null label or one outside [0, K) fails the job.
    """
    inside = F.coalesce(F.col(true).between(0, n_classes - 1) & F.col(pred).between(0, n_classes - 1), F.lit(False))
    cell = F.when(inside, F.col(true) * n_classes + F.col(pred)).otherwise(
        F.raise_error(F.lit(f"label outside [0, {n_classes})"))).cast("long").alias("cell")
    counts = df.groupBy(cell).agg(F.count(F.lit(1)).alias("n"))
    grid = df.sparkSession.range(n_classes * n_classes).withColumnRenamed("id", "cell")
    return grid.join(counts, "cell", "left").select(
        F.floor(F.col("cell") / n_classes).cast("int").alias(true),
        F.pmod(F.col("cell"), F.lit(n_classes)).cast("int").alias(pred),
        F.coalesce("n", F.lit(0)).alias("n"))


def per_class(cm: DataFrame, true: str = "class_true", pred: str = "class_pred") -> DataFrame:
    """Precision, recall, F1 and support by class; undefined ratios read 0."""
    hit = F.when(F.col(true) == F.col(pred), F.col("n")).otherwise(F.lit(0))
    rows = cm.select(F.explode(F.array(
        F.struct(F.col(true).alias("class_index"), F.col("n").alias("actual"), F.lit(0).cast("long").alias("called"), hit.alias("hit")),
        F.struct(F.col(pred).alias("class_index"), F.lit(0).cast("long").alias("actual"), F.col("n").alias("called"), F.lit(0).cast("long").alias("hit")),
    )).alias("r")).select("r.*")
    sums = rows.groupBy("class_index").agg(*[F.sum(c).alias(c) for c in ("actual", "called", "hit")])

    def share(a: Column, b: Column) -> Column:
        return F.when(b == 0, F.lit(0.0)).otherwise(a / b)

    out = sums.withColumns({
        "precision": share(F.col("hit"), F.col("called")),
        "recall": share(F.col("hit"), F.col("actual")),
    })
    p, r = F.col("precision"), F.col("recall")
    return out.select("class_index", "precision", "recall",
                      share(2.0 * p * r, p + r).alias("f1"), F.col("actual").alias("support"))


def confusions(cm: DataFrame, true: str = "class_true", pred: str = "class_pred") -> DataFrame:
    """Wrong targets of each class, most frequent first (K rows a class at most)."""
    order = W.partitionBy(true).orderBy(F.desc("n"), pred)
    return cm.where((F.col(true) != F.col(pred)) & (F.col("n") > 0)).withColumn(
        "rank", F.row_number().over(order))


def _or_nan(c: Column) -> Column:
    return F.coalesce(c, F.lit(NAN))


def accuracy(true: str = "class_true", pred: str = "class_pred") -> Column:
    return _or_nan(F.avg((F.col(true) == F.col(pred)).cast("double")))


def rmse(true: str = "value_true", pred: str = "value_pred") -> Column:
    d = F.col(pred) - F.col(true)
    return _or_nan(F.sqrt(F.avg(d * d)))


def r2(true: str = "value_true", pred: str = "value_pred") -> Column:
    """One less the variance ratio of residual and truth; a constant bias does not lower it."""
    spread = F.var_pop(true)
    return _or_nan(F.when(spread > 0, 1.0 - F.var_pop(F.col(pred) - F.col(true)) / spread))


def metrics(df: DataFrame, by: tuple[str, ...] = (), class_true="class_true", class_pred="class_pred",
            value_true="value_true", value_pred="value_pred") -> DataFrame:
    """Accuracy, RMSE, R2 and row count, overall or by group, in one aggregate."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), accuracy(class_true, class_pred).alias("top1_acc"),
        rmse(value_true, value_pred).alias("ilm_rmse"), r2(value_true, value_pred).alias("ilm_r2"))


def ablation(scored: DataFrame, train: str = "train_model", test: str = "test_model", **columns) -> DataFrame:
    """Metrics of every (trained on, tested on) pair."""
    return metrics(scored, (train, test), **columns)


# ---------------------------------------------------------------- intervals


def bootstrap_draws(df: DataFrame, key: str, stats: dict[str, Column], n: int = 500, seed: int = 0) -> DataFrame:
    """Percentile intervals by resampling rows with replacement; any aggregate may be the statistic.

    Draw ``j`` of replicate ``b`` takes the row whose rank is a hash of (seed, b, j). Each
    replicate draws exactly as many rows as there are. Costs ``n`` times the table in shuffled
    rows; :func:`bootstrap_moments` avoids that for statistics built from sums.

    Draws are made and meet their rows in parts of about :data:`PART_DRAWS`, whatever the session's number of
    partitions, and only the rows of a part are held for that, so no task's memory grows with the table.
    """
    hashed = df.withColumn("_h", F.md5(F.col(key).cast("string"))).withColumn("_all", F.lit(0))
    rows = ranked(hashed, "_all", "_h").drop("_h", "_all", "n")
    total = df.count()
    # Draw number i is draw i % total of replicate i // total.
    parts = max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(total * n / PART_DRAWS))
    draws = df.sparkSession.range(0, total * n, 1, parts).select(
        F.floor(F.col("id") / F.lit(max(total, 1))).alias("_b"), F.pmod("id", F.lit(max(total, 1))).alias("_j"))
    word = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), "_b", "_j")), 1, 15)
    picked = draws.select("_b", (F.pmod(F.conv(word, 16, 10).cast("long"), F.lit(max(total, 1))) + 1).alias("rank"))
    met = picked.repartition(parts, "rank").join(rows.repartition(parts, "rank").hint("shuffle_hash"), "rank")
    replicates = met.groupBy("_b").agg(*[s.alias(k) for k, s in stats.items()])
    return _interval(replicates, list(stats))


#: Modulus and multiplier of the replicate hash (fixed values: a Mersenne prime and a primitive root of it).
PRIME, ROOT = (1 << 31) - 1, 16_807
#: P(X <= k) of a Poisson variable of mean 1, as far as a 31-bit uniform can tell.
POISSON = tuple(sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(13))


def replicate_factors(n: int) -> list[int]:
    """A multiplier for each replicate."""
    return [pow(ROOT, b + 1, PRIME) for b in range(n)]


def row_words(key: Column, seed: int) -> tuple[Column, Column]:
    """Two independent 31-bit words of a row."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string")))
    word = lambda at: F.pmod(F.conv(F.substring(digest, at, 8), 16, 10).cast("bigint"), F.lit(PRIME))
    return word(1), word(9)


def bootstrap_moments(df: DataFrame, key: str, moments: dict[str, Column], stats: dict[str, Column],
                      n: int = 500, seed: int = 0) -> DataFrame:
    """Percentile intervals for statistics that are functions of sums, in one pass at any table size.

    Replicate ``b`` takes a row as often as a Poisson(1) variable says, drawn from a hash of the row's
    key and ``b``. These weights stand in for drawing exactly as many rows as there are: the number of
    rows drawn varies by its square root, which ratios of sums do not feel. A task adds its rows up to
    ``n`` rows of sums; only these are shuffled. The draws depend on keys alone, not on partitions.

    ``stats`` are expressions over the moment names and ``n`` (rows drawn). Rows lacking a
    moment (no prediction) take no part, as in the point metrics.
    """
    names = list(moments)
    complete = F.lit(True)
    for c in moments.values():
        complete = complete & c.isNotNull()
    first, second = row_words(F.col(key), seed)
    rows = df.where(complete).select(first.alias("_u"), second.alias("_v"), *[c.cast("double").alias(m) for m, c in moments.items()])
    factors, steps = np.array(replicate_factors(n), dtype=np.int64), np.array(POISSON) * PRIME
    schema = ", ".join(["_b int", "n double", *[f"{m} double" for m in names]])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((n, len(names) + 1)), False
        for batch in batches:
            seen = seen or batch.num_rows > 0
            values = np.column_stack([np.ones(batch.num_rows), *[batch.column(m).to_numpy(zero_copy_only=False) for m in names]])
            u, v = (batch.column(c).to_numpy()[:, None] for c in ("_u", "_v"))
            for lo in range(0, n, 64):
                word = (u * factors[lo:lo + 64] + v) % PRIME
                total[lo:lo + 64] += np.searchsorted(steps, word, side="right").T.astype(float) @ values
        if seen:
            yield pa.RecordBatch.from_pydict({"_b": pa.array(np.arange(n, dtype=np.int32)), "n": pa.array(total[:, 0]),
                                              **{m: pa.array(total[:, i + 1]) for i, m in enumerate(names)}})

    sums = rows.mapInArrow(weigh, schema).groupBy("_b").agg(*[F.sum(c).alias(c) for c in ("n", *names)])
    return _interval(sums.select("_b", *[s.alias(k) for k, s in stats.items()]), list(stats))


def _interval(replicates: DataFrame, names: list[str]) -> DataFrame:
    """2.5 and 97.5 percentiles (linear between ranks) over the replicates; NaN when there are none
    or when the statistic is undefined in one of them."""
    def q(c: str, at: float) -> Column:
        undefined = F.bool_or(F.isnan(F.col(c).cast("double")))
        return _or_nan(F.when(~undefined, F.percentile(c, F.lit(at))))

    return replicates.agg(*[
        e for c in names for e in (q(c, 0.025).alias(f"{c}_lo"), q(c, 0.975).alias(f"{c}_hi"))])


def intervals(df: DataFrame, key: str, class_true="class_true", class_pred="class_pred",
              value_true="value_true", value_pred="value_pred", n: int = 500, seed: int = 0) -> DataFrame:
    """Bootstrap intervals of accuracy, RMSE and R2 from the same replicates.

    Variances are taken about the table's means: sums of raw squares would lose the digits that
    tell a constant truth from a nearly constant one.
    """
    error, truth = F.col(value_pred) - F.col(value_true), F.col(value_true)
    centre = df.agg(F.avg(error).alias("e"), F.avg(truth).alias("y")).first()
    e0, y0 = (float(centre[c]) if centre[c] is not None else NAN for c in ("e", "y"))
    e, y = error - F.lit(e0), truth - F.lit(y0)
    moments = {
        "hit": (F.col(class_true) == F.col(class_pred)).cast("double"), "square": error * error,
        "e": e, "ee": e * e, "y": y, "yy": y * y,
    }
    drawn = F.col("n")

    def var(s: str, ss: str) -> Column:
        return F.col(ss) / drawn - (F.col(s) / drawn) * (F.col(s) / drawn)

    spread = var("y", "yy")
    stats = {
        "accuracy": F.col("hit") / drawn,
        "rmse": F.sqrt(F.col("square") / drawn),
        "r2": F.when(spread > (1e-12 * y0) ** 2, 1.0 - var("e", "ee") / spread).otherwise(F.lit(NAN)),
    }
    return bootstrap_moments(df, key, moments, stats, n, seed)


# ---------------------------------------------------------------- calibration of confidence


def bin_edges(n_bins: int) -> list[float]:
    return [float(x) for x in np.linspace(0.0, 1.0, n_bins + 1)]


def reliability(df: DataFrame, p: str = "probabilities", label: str = "class_true", n_bins: int = 15) -> DataFrame:
    """Rows, mean confidence and accuracy per confidence bin; bins are open below, closed above."""
    edges = V.literal(bin_edges(n_bins))
    confidence = F.array_max(p)
    return (
        df.select(confidence.alias("c"), (V.argmax(F.col(p)) == F.col(label)).cast("double").alias("hit"))
        .withColumn("bin", F.size(F.filter(edges, lambda e: e < F.col("c"))) - 1)
        .groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("c").alias("confidence"), F.avg("hit").alias("accuracy"))
    )


def expected_calibration_error(df: DataFrame, p: str = "probabilities", label: str = "class_true",
                               n_bins: int = 15) -> DataFrame:
    table = reliability(df, p, label, n_bins)
    inside = (F.col("bin") >= 0) & (F.col("bin") < n_bins)
    gap = F.when(inside, F.col("n") * F.abs(F.col("confidence") - F.col("accuracy"))).otherwise(F.lit(0.0))
    return table.agg(F.coalesce(F.sum(gap) / F.sum("n"), F.lit(0.0)).alias("ece"))


def temperature_grid(lo: float = 0.5, hi: float = 5.0, count: int = 100) -> list[float]:
    return [float(t) for t in np.linspace(lo, hi, count)]


def temperature_loss(df: DataFrame, n_classes: int, logits: str = "logits", label: str = "class_true",
                     grid: list[float] | None = None) -> DataFrame:
    """Mean negative log-likelihood at every temperature of the grid.

    Each batch returns one partial sum per temperature, so rows are never multiplied by the
    grid outside a task. Logits of another width and labels that are null or outside [0, K) fail
    the job.
    """
    ts = np.array(grid or temperature_grid())

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, z in kernels.batches_as_matrix(batches, "z", n_classes):
            y = batch.column("y").to_numpy(zero_copy_only=False)
            if batch.column("y").null_count or ((y < 0) | (y >= n_classes)).any():
                raise ValueError(f"label null or outside [0, {n_classes})")
            z = z - z.max(axis=1, keepdims=True)
            own = z[np.arange(len(y)), y]
            loss = np.empty(len(ts))
            for i, t in enumerate(ts):
                logp = own / t - np.log(np.exp(z / t).sum(axis=1))
                loss[i] = -np.maximum(logp, np.log(1e-12)).sum()
            yield pa.RecordBatch.from_pydict({
                "temperature": pa.array(ts), "loss": pa.array(loss),
                "rows": pa.array(np.full(len(ts), len(y), dtype=np.int64)),
            })

    rows = df.select(F.col(logits).alias("z"), F.col(label).cast("int").alias("y"))
    return rows.mapInArrow(partial, "temperature double, loss double, rows bigint").groupBy("temperature").agg(
        (F.sum("loss") / F.sum("rows")).alias("nll"))


def fit_temperature(df: DataFrame, n_classes: int, logits: str = "logits", label: str = "class_true",
                    grid: list[float] | None = None) -> DataFrame:
    """Temperature of the grid with the least loss (the smallest on a tie; 1 without rows)."""
    best = F.min(F.struct("nll", "temperature"))
    return temperature_loss(df, n_classes, logits, label, grid).agg(
        F.coalesce(best.getField("temperature"), F.lit(1.0)).alias("temperature"), best.getField("nll").alias("nll"))


def recalibrate(df: DataFrame, n_classes: int, logits: str = "logits", label: str = "class_true", split: str = "split",
                grid: list[float] | None = None, n_bins: int = 15) -> DataFrame:
    """One row ``temperature, ece_before, ece_after``: fitted on the ``val`` rows, measured on the ``test`` rows."""
    fitted = fit_temperature(df.where(F.col(split) == "val"), n_classes, logits, label, grid)
    test = df.where(F.col(split) == "test").withColumn("_t", fitted.select("temperature").scalar())
    before = test.select(V.softmax(F.col(logits)).alias("p"), F.col(label).alias("y"))
    after = test.select(V.softmax(F.transform(logits, lambda z: z / F.col("_t"))).alias("p"), F.col(label).alias("y"))
    errors = [expected_calibration_error(t, "p", "y", n_bins).scalar() for t in (before, after)]
    return fitted.select("temperature", errors[0].alias("ece_before"), errors[1].alias("ece_after"))


# ---------------------------------------------------------------- report


def build_report(scored: DataFrame, n_classes: int, key: str = "measurement_id", n: int = 500, seed: int = 0,
                 **columns) -> dict[str, DataFrame]:
    """All evaluation tables of one scored split.

    ``scored`` is read several times: hand over a stored table, not an expensive plan.
    """
    names = {"class_true": "class_true", "class_pred": "class_pred",
             "value_true": "value_true", "value_pred": "value_pred", **columns}
    cm = confusion_matrix(scored, n_classes, names["class_true"], names["class_pred"])
    return {
        "metrics": metrics(scored, (), **names),
        "confusion_matrix": cm,
        "per_class": per_class(cm, names["class_true"], names["class_pred"]),
        "confusions": confusions(cm, names["class_true"], names["class_pred"]),
        "intervals": intervals(scored, key, n=n, seed=seed, **names),
    }
