"""Spectral angle mapping: nearest reference spectrum by angle."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import kernels
from ..functions import vectors as V
from ..session import bounded_rows, materialise
from .channels import channel_aggregate

#: Reference spectra sent to every task; larger libraries are cut into tiles.
MAX_REFERENCES = 2_048
PIVOTS, TILE, MAX_TILES = 16, 256, 1 << 16
PIVOT_SAMPLE = 4_096  # references among which pivots are chosen
BINS = 4_096  # of the angle to the own pivot
VISITS = 8_192  # spectra that meet a tile in one task
GROUP_CELLS, MEET_CELLS = 1 << 23, 1 << 23  # numbers in a group of tiles, and in the spectra that meet it in one task, at most
LEAST_CELLS = 1 << 19  # of both, at least
MOST_TASKS = 4_096
TASKS = 4  # meetings a core, for which groups and parts are made smaller
CHUNK = 2_048  # spectra multiplied with a tile at once
WAIT = 16  # tiles whose few near pairs are judged together
PAIRS = 1 << 10  # angles made exactly at once
SLACK = 1e-6  # over the error of an angle, which is largest near zero
SHARPNESS = 5.0

# Fixed value: which class each pure end-member stands for.
ENDMEMBER_CLASS = {
    "ilmenite": "ilmenite_rich",
    "olivine": "olivine_rich",
    "pyroxene": "pyroxene_rich",
    "anorthite": "anorthositic",
    "glass_agglutinate": "glass_agglutinate",
}


def angle(s, r) -> Column:
    """Angle between two spectra in radians; a zero vector is at right angles to everything."""
    scale = V.norm(V.col(s)) * V.norm(V.col(r))
    cosine = V.clip(V.dot(V.col(s), V.col(r)) / scale, -1.0, 1.0)
    return F.when(scale < 1e-12, F.lit(math.pi / 2)).otherwise(F.acos(cosine))


def _angles(m: np.ndarray, refs: np.ndarray) -> np.ndarray:
    scale = np.linalg.norm(m, axis=1)[:, None] * np.linalg.norm(refs, axis=1)[None, :]
    return np.arccos(np.clip((m @ refs.T) / np.maximum(scale, 1e-12), -1.0, 1.0))


def angle_kernel(refs: np.ndarray):
    """Column function: angles of a spectrum to all references, in their order."""
    refs = np.ascontiguousarray(refs, dtype=np.float64)
    return kernels.array_kernel(lambda m: _angles(m, refs), refs.shape[1])


def with_mixed(pure: DataFrame, name: str = "class_name", spec: str = "spec") -> DataFrame:
    """References plus the ``mixed`` one, their unweighted mean."""
    mean = channel_aggregate(pure, spec, spec=F.avg("v")).select(F.lit("mixed").alias(name), F.col("spec").alias(spec))
    return pure.select(name, spec).unionByName(mean)


def references_from_endmembers(endmembers: DataFrame, endmember: str = "endmember",
                               spec: str = "spec") -> DataFrame:
    """Class references from pure end-members, matched by name rather than by position."""
    named = F.create_map(*[F.lit(x) for pair in ENDMEMBER_CLASS.items() for x in pair])
    pure = endmembers.select(F.get(F.array(named[F.col(endmember)]), F.lit(0)).alias("class_name"), spec)
    return with_mixed(pure.where("class_name is not null"))


def sam_classify(df: DataFrame, refs: DataFrame, spec: str = "spec", name: str = "class_name",
                 order: list | None = None) -> DataFrame:
    """Add ``angles, probabilities, sam_class, sam_index, angle_rad, angle_deg``.

    References are taken in ``order`` (else sorted by name); index 0 wins ties. Every row carries the
    angles to all of them, so their number is bounded by :data:`MAX_REFERENCES`; :func:`sam_nearest` finds
    the nearest one in a library of any size.
    """
    rows = bounded_rows(refs.select(name, spec), MAX_REFERENCES)
    if rows is None:
        raise ValueError(f"more than {MAX_REFERENCES} references in one row of angles: use sam_nearest")
    table = {r[0]: r[1] for r in rows}
    if len(table) != len(rows):
        raise ValueError("reference names repeat")
    names = list(order) if order is not None else sorted(table)
    if len(names) != len(rows) or set(names) != set(table):
        raise ValueError(f"{len(names)} class names for {len(rows)} references")
    kind = refs.schema[name].dataType
    closeness = F.transform(F.col("angles"), lambda a: a * F.lit(-SHARPNESS))
    out = df.withColumn("angles", angle_kernel(np.array([table[n] for n in names]))(F.col(spec)))
    return out.withColumns({
        "sam_index": V.argmin(F.col("angles")),
        "angle_rad": F.array_min("angles"),
        "probabilities": V.softmax(closeness),
    }).withColumns({
        "sam_class": F.get(F.lit(names), F.col("sam_index")).cast(kind),
        "angle_deg": F.degrees("angle_rad"),
    })


def sam_nearest(df: DataFrame, refs: DataFrame, key: str, spec: str = "spec", name: str = "class_name",
                few: int = MAX_REFERENCES, pivots: int = PIVOTS, tile: int = TILE) -> DataFrame:
    """(key, sam_class, angle_rad), a row per spectrum: its nearest reference of a library of any size, exactly.

    Up to ``few`` references become one matrix. A larger library is cut into tiles: angles obey the
    triangle inequality, so the angles of a tile's references to a few pivots bound their angles to any
    spectrum. Each spectrum first visits the most promising tile, then only those that may
    hold a nearer reference; visits are dealt out by tile, crowded tiles in parts of at most :data:`VISITS`.
    After the first visit tiles are visited by groups: a spectrum travels once to each group that holds a
    tile for it, whatever the number of these, and meets them there one after the other as its bound shrinks.
    Where the bounds rule little out, this is a product of blocks: quadratic in time. What travels is the table
    times the groups and the library times the parts of the table; both grow to a size that a task holds.
    Angles alike to twelve digits are ties and go to the smaller name. A zero spectrum or reference is at
    right angles to everything; a null spectrum has no class; null or empty references are left out.
    """
    spark = df.sparkSession
    rows = df.select(key, F.col(spec).cast("array<double>").alias("_s"))
    # Of equal spectra only the smallest name can win.
    known = refs.where(F.size(spec) > 0).groupBy(F.col(spec).cast("array<double>").alias("_r")).agg(F.min(name).alias("_n"))
    known = materialise(known, "references")
    kind = known.schema["_n"].dataType
    found = bounded_rows(known, few)
    width_ = known.select(F.max(F.size("_r")).alias("w"), F.min(F.size("_r")).alias("least")).first()
    if width_["w"] is None:
        raise ValueError("no references")
    if width_["w"] != width_["least"]:
        raise ValueError("references differ in width")
    width = width_["w"]
    if found is not None:
        found = sorted(found, key=lambda r: r["_n"])
        angles = angle_kernel(np.array([r["_r"] for r in found], float))(F.col("_s"))
        rows = rows.withColumn("_a", angles).withColumn("_a", F.transform("_a", lambda x: F.round(x, 12)))
        named = F.when(F.col("_a").isNotNull(), F.get(F.lit([r["_n"] for r in found]), V.argmin(F.col("_a"))))
        return rows.select(key, named.cast(kind).alias("sam_class"), F.array_min("_a").alias("angle_rad"))
    rows = materialise(rows.withColumn("_row", F.monotonically_increasing_id()), "spectra")
    good = rows.where((F.size("_s") == width) & F.forall("_s", lambda x: x.isNotNull()))
    library, bounds, centres = _tiles(known, width, pivots, tile)
    shared = spark.sparkContext.broadcast((centres, bounds))
    first = _visit(good.mapInArrow(_to_tiles(shared, width, False), _VISIT), library, width, kind)
    first = materialise(first, "first-visits")
    # Few large groups, since a spectrum begins anew in each, but parts enough to keep the cores busy.
    cells, offered, tasks = first.count() * width, library.count() * width, TASKS * spark.sparkContext.defaultParallelism
    room = min(GROUP_CELLS, max(LEAST_CELLS, offered * math.ceil(cells / LEAST_CELLS) / tasks))
    group = max(1, int(room * len(bounds[0]) / offered))  # tiles in one
    meet = max(1, int(min(MEET_CELLS, max(LEAST_CELLS, cells * offered / (room * tasks))) / width))  # spectra in a part
    again = first.select("_row", "_s", "_tile", "_angle").mapInArrow(_to_groups(shared, width, group), _AGAIN)
    more = _visit_groups(materialise(again, "second-visits"),
                         library.withColumn("_group", F.floor(F.col("_tile") / group).cast("int")), shared, width, kind, meet)
    best = first.select("_row", "_angle", "_name").unionByName(more).groupBy("_row").agg(F.min(F.struct("_angle", "_name")).alias("_b"))
    return rows.join(best, "_row", "left").select(key, F.col("_b._name").alias("sam_class"), F.col("_b._angle").alias("angle_rad"))


# Spectra travel as packed doubles, which are copied as they are.
_VISIT = "_row long, _tile int, _s binary"
_AGAIN = "_row long, _tile int, _angle double, _s binary, _groups array<int>"


def _pack(m: np.ndarray) -> pa.Array:
    """Rows of a matrix as binaries of doubles."""
    m = np.ascontiguousarray(m, np.float64)
    ends = np.arange(len(m) + 1, dtype=np.int32) * np.int32(8 * m.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(m), [None, pa.py_buffer(ends), pa.py_buffer(m)])


def _unpack(column, width: int) -> np.ndarray:
    """Inverse of :func:`_pack`; not copied where the column is in one piece."""
    chunks = [c for c in (column.chunks if isinstance(column, pa.ChunkedArray) else [column]) if len(c)]
    out = []
    for c in chunks:
        begin = int(np.frombuffer(c.buffers()[1], np.int32)[c.offset])
        out.append(np.frombuffer(c.buffers()[2], np.float64, len(c) * width, begin).reshape(-1, width))
    return out[0] if len(out) == 1 else np.concatenate(out) if out else np.zeros((0, width))


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def far_points(m: np.ndarray, count: int) -> np.ndarray:
    """Up to ``count`` unit vectors of ``m``, each as far as can be from those before."""
    units = _unit(m[np.linalg.norm(m, axis=1) >= 1e-12])
    if not len(units):
        return np.eye(1, m.shape[1])
    chosen, nearest = [0], _angles(units, units[:1])[:, 0]
    while len(chosen) < count and nearest.max() > 1e-6:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, _angles(units, units[chosen[-1:]])[:, 0])
    return units[chosen]


def _tiles(known: DataFrame, width: int, pivots: int, tile: int) -> tuple[DataFrame, tuple[np.ndarray, np.ndarray], np.ndarray]:
    """The library by tile, the least and largest angle of every tile to every pivot, and the pivots.

    A tile holds neighbours of one pivot at like angles; their number is bounded by :data:`MAX_TILES`, so
    the bounds that go to every task are, too.
    """
    spark, count = known.sparkSession, known.count()
    tile = max(tile, math.ceil(count / MAX_TILES))
    share = F.pmod(F.xxhash64("_r"), F.lit(1 << 32)) < math.ceil(min(1.0, PIVOT_SAMPLE / count) * (1 << 32))
    sample, _ = kernels.to_matrix(known.where(share).select("_r").toArrow().column("_r").combine_chunks(), width)
    centres = far_points(sample, pivots) if len(sample) else np.eye(pivots, width)

    def place(batches):
        for batch in batches:
            m, ok = kernels.to_matrix(batch.column("_r"), width)
            if not ok.all():
                raise ValueError("a reference holds nulls")
            d = _angles(m, centres)
            d[np.linalg.norm(m, axis=1) < 1e-12] = math.pi / 2
            yield pa.RecordBatch.from_pydict({"_r": _pack(m), "_n": batch.column("_n"), "_cell": pa.array(d.argmin(1), pa.int32()),
                                              "_bin": pa.array((d.min(1) / math.pi * BINS).astype(np.int32)),
                                              "_zero": pa.array((m == 0).all(1)), "_d": kernels.from_matrix(d, np.ones(len(d), bool))})

    # A reference of norm zero is at right angles to all, whatever the pivots say: it has a tile of its own.
    placed = materialise(known.mapInArrow(place, T.StructType([*T._parse_datatype_string("_r binary").fields, known.schema["_n"], *T._parse_datatype_string(
        "_cell int, _bin int, _zero boolean, _d array<double>").fields])), "placed")
    counts = placed.groupBy("_cell", "_bin").agg(F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(W.partitionBy("_cell").orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("_cell", "_bin", F.floor(before / tile).alias("_ring"), F.ceil(F.col("c") / tile).alias("_parts"))
    counts = materialise(counts, "rings")
    named = placed.join(counts, ["_cell", "_bin"]).select("_r", "_n", "_d", F.when(F.col("_zero"), F.lit(-1)).otherwise(F.col("_cell")).alias("_cell"), "_ring",
                                                          F.pmod(F.xxhash64("_r"), F.col("_parts")).alias("_part"))
    each = named.groupBy("_cell", "_ring", "_part").agg(
        *[f(F.col("_d")[j]).alias(f"{f.__name__}{j}") for f in (F.min, F.max) for j in range(len(centres))])
    keys = ["_cell", "_ring", "_part"]
    found = each.toArrow().sort_by([(k, "ascending") for k in keys])
    low, high = (np.column_stack([found.column(f"{f}{j}").to_numpy() for j in range(len(centres))]).astype(float).reshape(found.num_rows, -1) for f in ("min", "max"))
    own = found.column("_cell").to_numpy() < 0
    low[own], high[own] = 0.0, math.pi  # never ruled out
    numbers = spark.createDataFrame(found.select(keys).append_column("_tile", pa.array(np.arange(found.num_rows), pa.int32())))
    return materialise(named.join(numbers, keys).select("_tile", "_r", "_n"), "library"), (low, high), centres


def _reached(part: pa.RecordBatch, m: np.ndarray, shared) -> np.ndarray:
    """Which tiles, other than that of its first visit, can hold a reference nearer to each spectrum."""
    centres, (low, high) = shared.value
    go = _bounds(m, centres, low, high) <= part.column("_angle").to_numpy()[:, None] + SLACK
    go[np.arange(len(m)), part.column("_tile").to_numpy()] = False
    return go


def _slices(batches, tiles: int):
    """Batches in slices whose bounds to all tiles fit a task."""
    step = max(1, (1 << 22) // tiles)
    for batch in batches:
        for lo in range(0, batch.num_rows, step):
            yield batch.slice(lo, step)


def _to_tiles(shared, width: int, again: bool):
    """A row per spectrum and tile: the tile of least bound, or, ``again``, all others that can hold a nearer reference."""

    def run(batches):
        centres, (low, high) = shared.value
        for part in _slices(batches, len(low)):
            m, _ = kernels.to_matrix(part.column("_s"), width)
            if again:
                row, to = np.nonzero(_reached(part, m, shared))
            else:
                row, to = np.arange(len(m)), _bounds(m, centres, low, high).argmin(1)
            for at in range(0, len(row), VISITS):
                r, t = row[at:at + VISITS], pa.array(to[at:at + VISITS], pa.int32())
                yield pa.RecordBatch.from_pydict({"_row": part.column("_row").take(pa.array(r)), "_tile": t, "_s": _pack(m[r])})

    return run


def _to_groups(shared, width: int, group: int):
    """The spectra with the groups of tiles that can hold a nearer reference."""

    def run(batches):
        _, (low, _) = shared.value
        for part in _slices(batches, len(low)):
            go = np.logical_or.reduceat(_reached(part, _unpack(part.column("_s"), width), shared), np.arange(0, len(low), group), axis=1)
            ends = np.concatenate([[0], go.sum(1).cumsum()]).astype(np.int32)
            groups = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.nonzero(go)[1], pa.int32()))
            yield pa.RecordBatch.from_pydict({**{c: part.column(c) for c in ("_row", "_tile", "_angle", "_s")}, "_groups": groups})

    return run


def _bounds(m: np.ndarray, centres: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least angle of every spectrum to anything in every tile, in single precision and lowered by its error."""
    d = _angles(m, centres).astype(np.float32)
    middle, half = (np.ascontiguousarray(x.T, np.float32) for x in ((low + high) / 2, (high - low) / 2))
    bound = np.full((len(m), len(low)), -math.inf, np.float32)
    step = max(64, (1 << 15) // max(1, len(m)))  # tiles at a time, so that the work stays in cache
    for lo in range(0, len(low), step):
        here = bound[:, lo:lo + step]
        off = np.empty(here.shape, np.float32)
        for j in range(len(centres)):
            np.subtract(d[:, j, None], middle[j, lo:lo + step], out=off)
            np.abs(off, out=off)
            np.subtract(off, half[j, lo:lo + step], out=off)
            np.maximum(here, off, out=here)
    bound -= np.float32(SLACK)
    bound[np.linalg.norm(m, axis=1) < 1e-12] = 0.0
    return bound


def _visit(visits: DataFrame, library: DataFrame, width: int, kind) -> DataFrame:
    """(_row, _tile, _s, _angle, _name): the best of the tile a spectrum visits."""
    visits = materialise(visits, "visits")
    parts = visits.groupBy("_tile").agg(F.ceil(F.count("*") / VISITS).alias("_parts"))
    asked = visits.join(parts, "_tile").withColumn("_part", F.pmod(F.xxhash64("_row"), F.col("_parts"))).drop("_parts")
    offered = library.join(parts, "_tile").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))).drop("_parts")
    name = pa.string() if isinstance(kind, T.StringType) else to_arrow_type(kind)

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        if not (a.num_rows and b.num_rows):
            a = a.slice(0, 0)
        at, angles = np.zeros(a.num_rows, np.int64), np.zeros(a.num_rows)
        if a.num_rows:
            b = b.take(pc.sort_indices(b.column("_n")))
            m, r = _unpack(a.column("_s"), width), _unpack(b.column("_r"), width)
            flat = (np.linalg.norm(m, axis=1) < 1e-12)[:, None] | (np.linalg.norm(r, axis=1) < 1e-12)[None]
            step = max(1, (1 << 22) // len(r))
            for lo in range(0, len(m), step):
                d = np.where(flat[lo:lo + step], math.pi / 2, _angles(m[lo:lo + step], r)).round(12)
                at[lo:lo + step] = d.argmin(1)
                angles[lo:lo + step] = d.min(1)
        names = b.column("_n").take(pa.array(at)).cast(name) if a.num_rows else pa.array([], name)
        return pa.table({**{c: a.column(c) for c in ("_row", "_tile", "_s")}, "_angle": pa.array(angles), "_name": names})

    schema = T.StructType([*T._parse_datatype_string(f"{_VISIT}, _angle double").fields, T.StructField("_name", kind)])
    return asked.groupBy("_tile", "_part").cogroup(offered.groupBy("_tile", "_part")).applyInArrow(best, schema)


def _visit_groups(spectra: DataFrame, library: DataFrame, shared, width: int, kind, rows: int) -> DataFrame:
    """(_row, _angle, _name): the best of each group of tiles a spectrum visits, where it is no worse than its first one.

    A group and at most about ``rows`` of its spectra meet in one task.
    """
    met = spectra.select("_row", "_tile", "_angle", "_s", F.explode("_groups").alias("_group"))
    spark = met.sparkSession
    parts = met.groupBy("_group").agg(F.ceil(F.count("*") / rows).alias("_parts")).orderBy("_group").toArrow()  # a row per group: few by the cells of one
    of, many = (parts.column(c).to_numpy().astype(t) for c, t in (("_group", np.int32), ("_parts", np.int64)))
    groups = np.repeat(of, many)
    part = np.arange(len(groups)) - np.repeat(many.cumsum() - many, many)
    spread = min(MOST_TASKS, max(1, len(groups)))
    keys = dealt_keys(spark, len(groups), spread)
    meetings = pa.table({"_group": groups, "_part": part, "_key": keys})
    asked = met.join(F.broadcast(spark.createDataFrame(pa.table({"_group": of, "_parts": many}))), "_group")
    asked = asked.withColumn("_part", F.pmod(F.xxhash64("_row"), F.col("_parts"))).drop("_parts").join(F.broadcast(spark.createDataFrame(meetings)), ["_group", "_part"])
    offered = library.join(F.broadcast(spark.createDataFrame(meetings)), "_group")
    name = pa.string() if isinstance(kind, T.StringType) else to_arrow_type(kind)

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        found, angles = np.zeros(0, np.int64), np.zeros(0)
        picked = []
        if a.num_rows and b.num_rows:
            by_name = pc.sort_indices(b.column("_n")).to_numpy()
            m, r = _unpack(a.column("_s"), width), _unpack(b.column("_r"), width)[by_name]
            tiles = b.column("_tile").to_numpy()[by_name]
            b = b.select(["_n"])
            first, start = a.column("_tile").to_numpy(), a.column("_angle").to_numpy()
            centres, (low, high) = shared.value
            found, angles = _nearest_by_tiles(m, r, tiles, first, start, centres, low, high)
            picked = np.flatnonzero(found >= 0)
        names = b.column("_n").take(pa.array(by_name[found[picked]])).cast(name) if len(picked) else pa.array([], name)
        at = a.column("_row").to_numpy()[picked] if len(picked) else np.zeros(0, np.int64)
        return pa.table({"_row": pa.array(at, pa.int64()), "_angle": pa.array(angles[picked] if len(picked) else angles[:0], pa.float64()), "_name": names})

    schema = T.StructType([*T._parse_datatype_string("_row long, _angle double").fields, T.StructField("_name", kind)])
    asked, offered = (x.repartition(spread, "_key").groupBy("_key") for x in (asked, offered))
    return asked.cogroup(offered).applyInArrow(best, schema)


def dealt_keys(spark, count: int, partitions: int) -> np.ndarray:
    """Different numbers, the i-th of which ``repartition`` puts into partition ``i % partitions``: work of like length is dealt
    out evenly, which hashes of a few keys do not do."""
    size = 40 * max(count, partitions)
    place = spark.range(size).select(F.pmod(F.hash("id"), F.lit(partitions)).alias("p")).toArrow().column("p").to_numpy()
    of = np.argsort(place, kind="stable")
    begin = np.searchsorted(place[of], np.arange(partitions))
    i = np.arange(count)
    keys = of[begin[i % partitions] + i // partitions]
    if (place[keys] != i % partitions).any():
        raise ValueError("too few numbers to deal")
    return keys


def _lengthened(x: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Rows of length one; those of no length stay zero, as do those that have none."""
    known = (size >= 1e-12) & np.isfinite(size)
    return np.where(known[:, None], x, 0.0) / np.where(known, size, 1.0)[:, None]


def _nearest_by_tiles(m, r, tiles, first, start, centres, low, high) -> tuple[np.ndarray, np.ndarray]:
    """Of each spectrum the nearest reference (-1: none as near as ``start``) in tiles other than its first, and the angle.

    Products in single precision leave out what is surely farther than the best so far; what is left is compared by
    its angle in double precision, rounded as everywhere. Of equals the first reference wins.
    """
    order = np.argsort(tiles, kind="stable")
    r = r[order]  # neighbours lie together
    numbers, begins = np.unique(tiles[order], return_index=True)
    ends = np.append(begins[1:], len(r))
    size_m, size_r = np.linalg.norm(m, axis=1), np.linalg.norm(r, axis=1)
    flat_m, flat_r = size_m < 1e-12, size_r < 1e-12
    # Angles of products of sizes under 1e-12 are drawn to a right angle, which single precision does not follow.
    tiny = bool((~flat_m).any() and (~flat_r).any() and size_m[~flat_m].min() * size_r[~flat_r].min() < 1e-12)
    thin, wait = {}, []
    room = np.empty(CHUNK * int((ends - begins).max()), np.float32)  # fresh arrays cost more than the work on them
    left, right = np.empty((2, PAIRS, m.shape[1]))
    loose, close = m.shape[1] * 2.0 ** -22, 4e-12
    found, angle = np.full(len(m), -1), start.copy()
    floor = np.cos(np.minimum(angle, math.pi))

    def judge(i: np.ndarray, j: np.ndarray) -> None:
        """Exact angles of pairs; the best of each spectrum replaces a worse one."""
        for lo in range(0, len(i), PAIRS):
            a, b = i[lo:lo + PAIRS], j[lo:lo + PAIRS]
            scale = np.maximum(size_m[a] * size_r[b], 1e-12)
            cosine = np.clip(np.einsum("ij,ij->i", m.take(a, 0, left[:len(a)], "clip"), r.take(b, 0, right[:len(a)], "clip")) / scale, -1.0, 1.0)
            may = np.flatnonzero((cosine >= floor[a] - close) | flat_m[a] | flat_r[b])
            a, b, d = a[may], b[may], np.arccos(cosine[may])
            if not len(a):
                continue
            d = np.where(flat_m[a] | flat_r[b], math.pi / 2, d).round(12)
            b = order[b]
            top = np.lexsort((b, d, a))
            top = top[np.append(True, a[top][1:] != a[top][:-1])]
            a, b, d = a[top], b[top], d[top]
            better = (d < angle[a]) | ((d == angle[a]) & ((found[a] < 0) | (b < found[a])))
            a, b, d = a[better], b[better], d[better]
            found[a], angle[a], floor[a] = b, d, np.cos(d)

    def settle() -> None:
        if wait:
            judge(*(np.concatenate(x) for x in zip(*wait)))
            wait.clear()

    def compare(go: np.ndarray, thin_go: np.ndarray, some: slice, block: np.ndarray) -> None:
        """The spectra ``go`` meet the references ``some`` in single precision."""
        c = np.matmul(thin_go, block, out=room[:len(go) * block.shape[1]].reshape(len(go), -1))
        top = c.max(1)
        hit = np.flatnonzero(top >= floor[go] - loose)
        if not len(hit):
            return
        i, j = np.nonzero(c[hit] >= (np.maximum(floor[go[hit]], top[hit]) - loose)[:, None])
        if len(i) > 4 * len(hit) + 64:  # too near for single precision
            fine = _lengthened(m[go[hit]], size_m[go[hit]]) @ _lengthened(r[some], size_r[some]).T
            i, j = np.nonzero(fine >= (np.maximum(floor[go[hit]], fine.max(1)) - close)[:, None])
        wait.append((go[hit][i], some.start + j))
        if len(wait) >= WAIT or len(i) >= len(go) // WAIT:
            settle()

    def thin_of(x: np.ndarray, size: np.ndarray) -> np.ndarray:
        return _lengthened(x, size).astype(np.float32)

    lows, highs = low[numbers], high[numbers]
    for lo in range(0, len(m), CHUNK):
        here = np.arange(lo, min(lo + CHUNK, len(m)))
        bound = _bounds(m[here], centres, lows, highs)
        bound[first[here][:, None] == numbers] = math.inf
        thin_here = thin_of(m[here], size_m[here])
        for k in np.argsort(bound.min(0), kind="stable").tolist():
            go = here[bound[:, k] <= angle[here] + SLACK]
            if not len(go):
                continue
            some = slice(begins[k], ends[k])
            if tiny:
                judge(np.repeat(go, some.stop - some.start), np.tile(np.arange(some.start, some.stop), len(go)))
                continue
            if k not in thin:
                thin[k] = np.ascontiguousarray(thin_of(r[some], size_r[some]).T)
            all_ = 2 * len(go) > len(here)
            compare(here if all_ else go, thin_here if all_ else thin_here[go - lo], some, thin[k])
        settle()
    return found, angle
