"""Queries over sample-level splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import splits as S
from . import inputs as I
from .registry import query


def split_sql(source: str, val: float, test: float, seed: int, klass: str, sample: str) -> str:
    """CTEs ending in ``sp(klass, sample, split, h)``: rank by digest inside the class, then cut."""
    return f"""
d AS (SELECT DISTINCT {klass}, {sample}, md5('{seed}|' || {sample}::VARCHAR) AS h FROM {source}),
rk AS (SELECT *, row_number() OVER (PARTITION BY {klass} ORDER BY h) AS rk, count(*) OVER (PARTITION BY {klass}) AS n FROM d),
q1 AS (SELECT *, CASE WHEN n >= 3 THEN greatest(1, round_even(n * {test}::DOUBLE, 0)::BIGINT) ELSE 0 END AS t0,
        CASE WHEN n >= 3 THEN greatest(1, round_even(n * {val}::DOUBLE, 0)::BIGINT) ELSE 0 END AS v0 FROM rk),
q2 AS (SELECT *, greatest(greatest(1, n - t0 - v0) + t0 + v0 - n, 0) AS over FROM q1),
q3 AS (SELECT *, t0 - least(over, t0) AS nt, v0 - least(over - least(over, t0), v0) AS nv FROM q2),
sp AS (SELECT {klass}, {sample}, h, CASE WHEN rk <= n - nt - nv THEN 'train' WHEN rk <= n - nt THEN 'val' ELSE 'test' END AS split FROM q3)"""


_USERS = "u AS (SELECT user_id, min(event_type) AS klass FROM events GROUP BY user_id)"
_EVENT_ROWS = "ev AS (SELECT event_id, e.user_id, klass FROM events e JOIN u USING (user_id))"


def _event_rows(spark, sf):
    e = I.table(spark, sf, "events").select("event_id", "user_id", "event_type")
    # The smallest name by its place in the sorted list: an integer minimum aggregates by hash.
    names = F.lit(list(I.EVENT_TYPES))
    first = F.min(F.array_position(names, F.col("event_type"))).cast("int") - 1
    klass = e.groupBy("user_id").agg(first.alias("_k")).select("user_id", F.get(names, F.col("_k")).alias("klass"))
    return e.join(klass, "user_id")


@query("M1", "W1", sql=f"WITH {split_sql('embeddings', .15, .15, 0, 'label', 'vec_id')} SELECT label, vec_id, split FROM sp")
def split_of_samples(spark, sf):
    return S.split_samples(I.spectra(spark, sf), sample="vec_id", klass="label").drop("digest", "opens")


@query("M1", "M2", "P4", sql=f"""WITH {_USERS}, {_EVENT_ROWS},{split_sql('ev', .2, .25, 7, 'klass', 'user_id')}
SELECT event_id, ev.user_id, split FROM ev JOIN sp ON sp.user_id = ev.user_id""")
def split_of_rows(spark, sf):
    out = S.sample_level_split(_event_rows(spark, sf), .2, .25, 7, sample="user_id", klass="klass")
    return out.select("event_id", "user_id", "split")


@query("A24", sql=f"""WITH {_USERS}, {_EVENT_ROWS},{split_sql('ev', .2, .25, 7, 'klass', 'user_id')}
SELECT split, ev.klass, count(*) AS n_rows, count(DISTINCT ev.user_id) AS n_samples FROM ev JOIN sp ON sp.user_id = ev.user_id
GROUP BY split, ev.klass""")
def split_cardinalities(spark, sf):
    return S.split_sizes(S.sample_level_split(_event_rows(spark, sf), .2, .25, 7, sample="user_id", klass="klass"), "user_id", "klass")


@query("J3", sql=f"""WITH {_USERS}, {_EVENT_ROWS},{split_sql('ev', .15, .15, 1, 'klass', 'user_id')}
SELECT event_type, count(*) AS n FROM events WHERE user_id IN (SELECT user_id FROM sp WHERE split = 'test') GROUP BY event_type""")
def rows_of_test_split(spark, sf):
    table = S.split_samples(_event_rows(spark, sf), seed=1, sample="user_id", klass="klass")
    rows = S.in_split(I.table(spark, sf, "events"), table, "test", "user_id")
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("J3", "S10", sql=f"""WITH {_USERS}, {_EVENT_ROWS},{split_sql('ev', .15, .15, 1, 'klass', 'user_id')}
SELECT split, count(*) AS n, round(sum(value), 2) AS total FROM events JOIN sp USING (user_id) GROUP BY split""")
def rows_by_stored_split(spark, sf):
    from ..session import scratch_path
    from ..sources import stores

    path = scratch_path(spark, "split-table")
    stores.save_splits(S.split_samples(_event_rows(spark, sf), seed=1, sample="user_id", klass="klass"), path)
    rows = S.attach_split(I.table(spark, sf, "events"), stores.load_splits(spark, path), "user_id")
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("J4", "U2", sql=f"""WITH {_USERS}, {_EVENT_ROWS},{split_sql('ev', .15, .15, 1, 'klass', 'user_id')}
SELECT user_id, count(DISTINCT split) AS n_splits, min(split) AS first_split, max(split) AS last_split FROM sp
GROUP BY user_id HAVING count(DISTINCT split) > 1""")
def leakage_of_sample_split(spark, sf):
    return S.leaked_samples(S.split_samples(_event_rows(spark, sf), seed=1, sample="user_id", klass="klass"), "user_id")


@query("J4", sql=f"""WITH rowwise AS (SELECT event_type AS klass, event_id, user_id FROM events),
{split_sql('rowwise', .15, .15, 3, 'klass', 'event_id').strip()}
SELECT user_id, count(DISTINCT split) AS n_splits, min(split) AS first_split, max(split) AS last_split
FROM rowwise JOIN sp USING (event_id) GROUP BY user_id HAVING count(DISTINCT split) > 1""")
def leakage_of_row_split(spark, sf):
    rows = I.table(spark, sf, "events").select(F.col("event_type").alias("klass"), "event_id", "user_id")
    return S.leaked_samples(S.sample_level_split(rows, seed=3, sample="event_id", klass="klass"), "user_id")


@query("U1", sql=" UNION ALL ".join(
    f"SELECT * FROM (WITH {split_sql('embeddings', .15, .15, seed, 'label', 'vec_id')} "
    f"SELECT {seed} AS seed, split, count(*) AS n_samples FROM sp GROUP BY split)" for seed in (0, 1, 2)))
def splits_of_several_seeds(spark, sf):
    s = I.spectra(spark, sf)
    out = None
    for seed in (0, 1, 2):
        part = S.split_samples(s, seed=seed, sample="vec_id", klass="label").groupBy("split").agg(
            F.count(F.lit(1)).alias("n_samples")).withColumn("seed", F.lit(seed))
        out = part if out is None else out.unionByName(part)
    return out
