"""As-of match in one sorted pass: every row with the latest reference of each kind in its group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise


def _interleaved(frames: DataFrame, refs: DataFrame, by: str, ts: str, kind: str, kinds: tuple[str, ...],
                 values: tuple[str, ...]) -> DataFrame:
    """Frames and references as rows of one table: ``_row`` is set for frames, ``_ref`` and ``_kind`` for references."""
    of_kind = F.array_position(F.lit(list(kinds)), F.col(kind)).cast("int") - 1
    offered = refs.where(F.col(kind).isin(*kinds) & F.col(by).isNotNull() & F.col(ts).isNotNull()).select(
        F.col(by).alias("_by"), F.col(ts).alias("_ts"), F.lit(False).alias("_late"), of_kind.alias("_kind"),
        F.struct(F.col(ts).alias("ts"), *values).alias("_ref"), F.lit(0).cast("bigint").alias("_spread"),
        F.lit(None).cast(frames.schema).alias("_row"))
    # Frames of one instant may be many: a hash of their plain columns lets range bounds fall between them.
    plain = [f.name for f in frames.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType))]
    asked = frames.select(
        F.col(by).alias("_by"), F.col(ts).alias("_ts"), F.lit(True).alias("_late"), F.lit(-1).alias("_kind"),
        F.lit(None).cast(offered.schema["_ref"].dataType).alias("_ref"), F.xxhash64(*plain).alias("_spread"),
        F.struct(*frames.columns).alias("_row"))
    return offered.unionByName(asked)


def latest_references(frames: DataFrame, refs: DataFrame, by: str, ts: str, kind: str, kinds: tuple[str, ...],
                      values: tuple[str, ...] = (), partitions: int | None = None) -> DataFrame:
    """``frames`` with a struct ``<kind>`` (``ts`` and ``values``) per kind: the latest reference of the row's
    group taken at or before it, null when there is none.

    Frames and references are range-partitioned by (group, time) and sorted, so a group holding much of
    the table, and even one instant of it, spreads over many tasks. A task streams its rows and keeps the
    latest reference of each kind. What it cannot know, the references before its first row, concerns
    its first group alone: each task leaves one row of what it saw last, a window over these rows (one a
    task) carries references on, and only the rows left open are joined with them.

    Both tables are read once by the shuffle and once by the sampling of its range bounds. The pass is
    written to the shared folder, so the task numbers in it hold whatever is computed again.

    A row whose group or time is null is kept and finds nothing; such references serve nobody. References at
    the row's own instant count. Of several of one kind at one instant the largest struct of ``values`` is taken.
    ``partitions`` fixes the number of ranges; by default adaptive execution merges small ones.
    """
    if set(kinds) & set(frames.columns):
        raise ValueError(f"frames already have a column named as a kind: {sorted(set(kinds) & set(frames.columns))}")
    rows = _interleaved(frames, refs, by, ts, kind, kinds, values)
    order = ["_by", "_ts", "_late", "_ref", "_spread"]
    ranged = rows.repartitionByRange(*([partitions] if partitions else []), *order).sortWithinPartitions(*order)
    ref_type, by_type = rows.schema["_ref"].dataType, rows.schema["_by"].dataType
    schema = T.StructType([T.StructField("_row", frames.schema), *[T.StructField(k, ref_type) for k in kinds],
                           T.StructField("_part", T.IntegerType()), T.StructField("_open", T.BooleanType()),
                           T.StructField("_by", by_type), T.StructField("_first", by_type)])
    names = schema.names

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, groups, first, last, row_type = TaskContext.get().partitionId(), 0, None, None, None
        held: list[pa.Array] = []
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            group, ref, kind_of = batch.column("_by"), batch.column("_ref"), batch.column("_kind").to_numpy()
            if first is None:
                first, row_type = group.slice(0, 1), batch.column("_row").type
                held = [pa.nulls(1, ref.type) for _ in kinds]
            # Slot 0 is what earlier batches hold, slot i + 1 is row i.
            slot = np.arange(1, n + 1)
            fresh = np.ones(n, dtype=bool)
            fresh[1:] = ~pc.fill_null(pc.equal(group.slice(1), group.slice(0, n - 1)), False).to_numpy(zero_copy_only=False)
            fresh[0] = last is None or not group.slice(0, 1).equals(last)
            begun = np.maximum.accumulate(np.where(fresh, slot, 0))
            number = groups + np.cumsum(fresh)
            usable = group.is_valid().to_numpy(zero_copy_only=False) & batch.column("_ts").is_valid().to_numpy(zero_copy_only=False)
            found, unknown = [], np.zeros(n, dtype=bool)
            for i in range(len(kinds)):
                at = np.maximum.accumulate(np.where(kind_of == i, slot, 0))
                at = np.where(at >= np.maximum(begun, 1), at, np.where(begun == 0, 0, -1))
                source = pa.concat_arrays([held[i], ref])
                value = source.take(pa.array(at, mask=(at < 0) | ~usable))
                held[i] = source.take(pa.array(at[-1:], mask=at[-1:] < 0))
                unknown |= value.is_null().to_numpy(zero_copy_only=False)
                found.append(value)
            groups, last = int(number[-1]), group.slice(n - 1, 1)
            out = pa.RecordBatch.from_arrays(
                [batch.column("_row"), *found, pa.array(np.full(n, part, dtype=np.int32)),
                 pa.array((number == 1) & usable & unknown), group, pa.nulls(n, group.type)], names)
            yield out.filter(batch.column("_late"))
        if first is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, row_type), *held, pa.array([part], pa.int32()), pa.nulls(1, pa.bool_()), last, first], names)

    done = materialise(ranged.mapInArrow(stream, schema), "asof")
    seen = done.where(F.col("_open").isNull())
    asked = seen.select(F.col("_first").alias("_by"), "_part", F.lit(0).alias("_step"),
                        *[F.lit(None).cast(ref_type).alias(k) for k in kinds])
    told = seen.select("_by", "_part", F.lit(1).alias("_step"), *kinds)
    before = W.partitionBy("_by").orderBy("_part", "_step").rowsBetween(W.unboundedPreceding, W.currentRow)
    carried = asked.unionByName(told).select("_part", "_step", *[
        F.last(k, ignorenulls=True).over(before).alias(f"_{k}") for k in kinds]).where("_step = 0").drop("_step")
    closed = done.where(~F.col("_open")).select("_row.*", *kinds)
    opened = done.where(F.col("_open")).join(carried, "_part", "left").select(
        "_row.*", *[F.coalesce(k, f"_{k}").alias(k) for k in kinds])
    return closed.unionByName(opened)
