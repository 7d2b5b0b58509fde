"""Aggregates across rows, channel by channel.

Counts, sums and squared deviations of whole arrays are folded per key inside each task and the
arrays are shuffled once (:func:`channel_moments`), so a key holding most of the table costs one
row per task. Other aggregates explode to (key, i, value) (:func:`channel_aggregate`).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keys a task holds before it hands their sums on.
HELD_KEYS = 2_048
#: Most tasks that fold the tasks' arrays of a table without keys, before the last one folds theirs.
MAX_FAN = 1_024


def explode_channels(df: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    return df.select(*keys, F.posexplode(column).alias("i", "v"))


def collect_channels(df: DataFrame, keys: Sequence[str], *columns: str) -> DataFrame:
    """Long (keys, i, values...) back to one row per key with an ordered array per value.

    A group has one row per channel, so its size is the block width.
    """
    packed = F.array_sort(F.collect_list(F.struct("i", *[c for c in columns if c != "i"])))
    out = df.groupBy(*keys).agg(packed.alias("_c"))
    return out.select(*keys, *[F.col("_c").getField(c).alias(c) for c in columns])


def channel_aggregate(df: DataFrame, column: str, keys: Sequence[str] = (), **aggs: Column) -> DataFrame:
    """Per-key, per-channel aggregates of the value column ``v``, repacked as arrays."""
    long = explode_channels(df, column, keys).groupBy(*keys, "i").agg(
        *[a.alias(n) for n, a in aggs.items()])
    return collect_channels(long, keys, *aggs)


ARRAYS = ("n", "sum", "m2", "b_sum", "b_m2", "cov", "b_min", "b_max")


def _rows_as_states(column: pa.Array, by: np.ndarray) -> dict[str, np.ndarray]:
    """Each row as the state of a group of one; channels that are null or beyond its width count 0."""
    length = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(int)
    flat = column.flatten()
    width = int(length.max(initial=0))
    row = np.repeat(np.arange(len(length)), length)
    at = np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)
    n, x = np.zeros((len(length), width)), np.zeros((len(length), width))
    n[row, at] = flat.is_valid().to_numpy(zero_copy_only=False) & ~np.isnan(by)[row]
    x[row, at] = pc.fill_null(flat.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)
    on, t = n > 0, np.nan_to_num(by)[:, None]
    zero = np.zeros_like(x)
    return {"n": n, "sum": np.where(on, x, 0.0), "m2": zero, "b_sum": np.where(on, t, 0.0), "b_m2": zero, "cov": zero,
            "b_min": np.where(on, t, np.inf), "b_max": np.where(on, t, -np.inf),
            "rows": np.ones(len(length)), "bare": (length == 0).astype(float), "width": length}


def _combined(state: dict[str, np.ndarray], group: np.ndarray, groups: int) -> dict[str, np.ndarray]:
    """States of equal ``group`` as one; deviations are moved to the common mean before they are added."""
    order = np.argsort(group, kind="stable")
    starts = np.searchsorted(group[order], np.arange(groups))
    add = lambda v: np.add.reduceat(v[order], starts, axis=0)
    n, total, b_total = add(state["n"]), add(state["sum"]), add(state["b_sum"])
    mean = lambda s, k: np.divide(s, k, out=np.zeros_like(s), where=k > 0)
    dx = np.where(state["n"] > 0, mean(state["sum"], state["n"]) - mean(total, n)[group], 0.0)
    db = np.where(state["n"] > 0, mean(state["b_sum"], state["n"]) - mean(b_total, n)[group], 0.0)
    return {"n": n, "sum": total, "m2": add(state["m2"] + state["n"] * dx * dx), "b_sum": b_total,
            "b_m2": add(state["b_m2"] + state["n"] * db * db), "cov": add(state["cov"] + state["n"] * dx * db),
            "b_min": np.minimum.reduceat(state["b_min"][order], starts, axis=0), "b_max": np.maximum.reduceat(state["b_max"][order], starts, axis=0),
            "rows": add(state["rows"]), "bare": add(state["bare"]), "width": np.maximum.reduceat(state["width"][order], starts)}


def _padded(state: dict[str, np.ndarray], width: int) -> dict[str, np.ndarray]:
    fill = {"b_min": np.inf, "b_max": -np.inf}
    return {k: v if v.ndim == 1 or v.shape[1] == width else np.pad(v, ((0, 0), (0, width - v.shape[1])), constant_values=fill.get(k, 0.0))
            for k, v in state.items()}


class _Fold:
    """States by key; ``keys`` are the key columns of the groups held, in order."""

    def __init__(self):
        self.keys: pa.Table | None = None
        self.state: dict[str, np.ndarray] = {}

    def add(self, keys: pa.Table, state: dict[str, np.ndarray]) -> None:
        if self.keys is not None:
            width = max(self.state["n"].shape[1], state["n"].shape[1])
            old, new = _padded(self.state, width), _padded(state, width)
            keys = pa.concat_tables([self.keys, keys])
            state = {k: np.concatenate([old[k], new[k]]) for k in new}
        group = np.zeros(len(state["rows"]), int)
        for c in keys.columns:
            codes = c.combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            group = np.unique(group * (codes.max(initial=0) + 1) + codes, return_inverse=True)[1]
        # Groups in the order in which they first stand.
        _, first, group = np.unique(group, return_index=True, return_inverse=True)
        place = np.argsort(np.argsort(first))
        self.state = _combined(state, place[group], len(first))
        self.keys = keys.take(pa.array(np.sort(first)))

    def take(self, count: int) -> pa.RecordBatch:
        """Hand on the first ``count`` groups."""
        out = {k: v[:count] for k, v in self.state.items()}
        columns = {name: c.combine_chunks() for name, c in zip(self.keys.column_names, self.keys.slice(0, count).columns)}
        # A key's arrays end where its widest row does.
        inside = np.arange(out["n"].shape[1]) < out["width"][:, None]
        offsets = pa.array(np.append(0, np.cumsum(out["width"])), pa.int32())
        columns |= {k: pa.ListArray.from_arrays(offsets, pa.array(out[k][inside])) for k in ARRAYS}
        columns |= {k: pa.array(out[k].astype(np.int64)) for k in ("rows", "bare")}
        self.keys, self.state = self.keys.slice(count), {k: v[count:] for k, v in self.state.items()}
        return pa.RecordBatch.from_pydict(columns)


def channel_moments(df: DataFrame, column: str, keys: Sequence[str] = (), by: Column | None = None) -> DataFrame:
    """Per key and channel: ``n``, ``sum``, ``m2`` (squared deviations), and with a scalar ``by`` of each
    row its ``b_sum, b_m2, b_min, b_max`` and co-deviation ``cov``, all as arrays; ``rows`` and ``bare``
    count the key's rows and those of them without channels.

    Null channels, and rows whose ``by`` is null, count nowhere. A task folds its rows to one row
    of arrays per key (handing on when it holds :data:`HELD_KEYS` keys); these are shuffled by key
    and folded again as they stream by, so no group is ever held in one task. Without keys they are
    dealt out, folded, and then folded in one task.
    """
    names = list(keys)
    value = F.lit(0.0) if by is None else by.cast("double")
    rows = df.select(*names, F.col(column).alias("_x"), value.alias("_by"))
    schema = T.StructType([*[rows.schema[k] for k in names], *[T.StructField(a, T.ArrayType(T.DoubleType())) for a in ARRAYS],
                           T.StructField("rows", T.LongType()), T.StructField("bare", T.LongType())])

    def key_table(batch: pa.RecordBatch) -> pa.Table:
        if names:
            return pa.Table.from_batches([batch.select(names)])
        return pa.table({"_all": pa.array(np.zeros(batch.num_rows, np.int8))})

    def emit(fold: _Fold, count: int) -> pa.RecordBatch:
        out = fold.take(count)
        return out if names else out.select(out.schema.names[1:])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = _Fold()
        for batch in batches:
            if batch.num_rows:
                t = pc.fill_null(batch.column("_by"), np.nan).to_numpy(zero_copy_only=False)
                fold.add(key_table(batch), _rows_as_states(batch.column("_x"), t))
                if fold.keys.num_rows > HELD_KEYS:
                    yield emit(fold, fold.keys.num_rows)
        if fold.keys is not None and fold.keys.num_rows:
            yield emit(fold, fold.keys.num_rows)

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = _Fold()
        for batch in batches:
            if batch.num_rows:
                lengths = pc.list_value_length(batch.column("n")).to_numpy(zero_copy_only=False)
                width = int(lengths.max(initial=0))
                state = {k: batch.column(k).to_numpy(zero_copy_only=False).astype(float) for k in ("rows", "bare")}
                state["width"] = lengths.astype(int)
                inside = np.arange(width) < lengths[:, None]
                for k in ARRAYS:
                    state[k] = np.full((batch.num_rows, width), {"b_min": np.inf, "b_max": -np.inf}.get(k, 0.0))
                    state[k][inside] = batch.column(k).flatten().to_numpy(zero_copy_only=False)
                fold.add(key_table(batch), state)
                # Rows come ordered by key: all but the last key are complete.
                if fold.keys.num_rows > 1:
                    yield emit(fold, fold.keys.num_rows - 1)
        if fold.keys is not None and fold.keys.num_rows:
            yield emit(fold, fold.keys.num_rows)

    parts = rows.mapInArrow(partial, schema)
    if names:
        return parts.repartition(*names).sortWithinPartitions(*names).mapInArrow(final, schema)
    fan = min(MAX_FAN, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return parts.repartition(fan).mapInArrow(final, schema).repartition(1).mapInArrow(final, schema)


def mean_of(total: str = "sum", n: str = "n") -> Column:
    """Channel means from :func:`channel_moments`; null where nothing counted."""
    return F.zip_with(total, n, lambda s, k: F.when(k > 0, s / k))


def fit_standardiser(df: DataFrame, column: str) -> DataFrame:
    """One row: per-channel mean and population deviation, deviations below 1e-9 read as 1."""
    std = F.zip_with("m2", "n", lambda m, k: F.when(k > 0, F.sqrt(m / k)))
    return channel_moments(df, column).select(
        mean_of().alias("mean"), F.transform(std, lambda d: F.when(d < 1e-9, F.lit(1.0)).otherwise(d)).alias("std"))


def apply_standardiser(df: DataFrame, fit: DataFrame, column: str, out: str | None = None) -> DataFrame:
    """Centre and scale ``column`` by a fitted row, read as a scalar subquery."""
    f = fit.select(F.struct("mean", "std").alias("f")).scalar()
    scaled = F.transform(F.col(column), lambda x, i: (x - F.get(F.col("_fit.mean"), i)) / (
        F.when(F.get(F.col("_fit.std"), i) < 1e-9, F.lit(1.0)).otherwise(F.get(F.col("_fit.std"), i))))
    return df.withColumn("_fit", f).withColumn(out or column, scaled).drop("_fit")


def class_means(df: DataFrame, klass: str, column: str) -> DataFrame:
    """Mean spectrum of every class."""
    return channel_moments(df, column, [klass]).select(klass, mean_of().alias("spec"))


def average_reads(df: DataFrame, scan: str, column: str) -> DataFrame:
    """Integer mean (rounded down) of the repeated reads of each scan, pixel by pixel."""
    return channel_moments(df, column, [scan]).select(
        scan, F.transform(mean_of(), lambda m: F.floor(m).cast("int")).alias("counts"))
