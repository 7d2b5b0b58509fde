"""Splits by physical sample: every measurement of a sample lands in one split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialise

SPLITS = ("train", "val", "test")
#: Above every hexadecimal digest.
NEVER = "g"


def sample_hash(sample: str, seed: int) -> Column:
    """The shuffle key of a sample; depends on nothing but the seed and the id."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(sample).cast("string")))


def ranked(df: DataFrame, group: str, key: str, digits: int = 3) -> DataFrame:
    """Exact 1-based rank ``rank`` of the hex digest ``key`` inside ``group``, and group size ``n``.

    A group may be a large share of the table, so it is never sorted in one task: rows are
    ranked inside buckets of equal digest prefix, and the sizes of the buckets before each
    (at most 16**digits per group) give its offset.
    """
    df = df.withColumn("_bucket", F.substring(key, 1, digits))
    sizes = df.groupBy(group, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    before = W.partitionBy(group).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        group, "_bucket",
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"),
        F.sum("_size").over(W.partitionBy(group)).alias("n"))
    inside = W.partitionBy(group, "_bucket").orderBy(key)
    return (
        df.withColumn("_at", F.row_number().over(inside))
        .join(offsets, [group, "_bucket"])
        .withColumn("rank", F.col("_offset") + F.col("_at"))
        .drop("_bucket", "_at", "_offset")
    )


def split_samples(df: DataFrame, val_frac: float = 0.15, test_frac: float = 0.15, seed: int = 0,
                  sample: str = "sample_id", klass: str = "mineral_class") -> DataFrame:
    """The ``(class, sample, split)`` table, with the digest that ordered it and ``opens``, true
    for the first sample of its class's val or test part.

    Within each class the samples are shuffled by digest; the first go to train, the next to
    val, the last to test. Sizes round half to even; classes of three or more samples give at
    least one to val and one to test, and always keep one for train. A sample found under two
    classes fails the job.
    """
    if not (0 < val_frac < 1 and 0 < test_frac < 1):
        raise ValueError("val_frac and test_frac must lie in (0, 1)")
    if val_frac + test_frac >= 1:
        raise ValueError("val_frac + test_frac must stay below 1")
    # A sample under two classes would be drawn twice and could land in two splits.
    only = F.when(F.count(F.lit(1)) == 1, F.first(klass)).otherwise(
        F.raise_error(F.concat(F.lit("sample leaks into several classes: "), F.col(sample).cast("string"))).cast(df.schema[klass].dataType))
    samples = df.select(klass, sample).distinct().groupBy(sample).agg(only.alias(klass)).withColumn("digest", sample_hash(sample, seed))
    n = F.col("n")

    def share(f: float) -> Column:
        return F.when(n >= 3, F.greatest(F.lit(1), F.rint(n * F.lit(f)).cast("long"))).otherwise(F.lit(0))

    sized = ranked(samples, klass, "digest").withColumn("_t", share(test_frac)).withColumn("_v", share(val_frac))
    over = F.greatest(F.greatest(F.lit(1), n - F.col("_t") - F.col("_v")) + F.col("_t") + F.col("_v") - n, F.lit(0))
    sized = sized.withColumn("_over", over)
    from_test = F.least("_over", "_t")
    sized = sized.withColumn("_t2", F.col("_t") - from_test).withColumn(
        "_v2", F.col("_v") - F.least(F.col("_over") - from_test, F.col("_v")))
    train = n - F.col("_t2") - F.col("_v2")
    split = (
        F.when(F.col("rank") <= train, F.lit("train"))
        .when(F.col("rank") <= train + F.col("_v2"), F.lit("val"))
        .otherwise(F.lit("test"))
    )
    opens = ((F.col("rank") == train + 1) & (F.col("_v2") > 0)) | (
        (F.col("rank") == train + F.col("_v2") + 1) & (F.col("_t2") > 0))
    return sized.select(klass, sample, split.alias("split"), "digest", opens.alias("opens"))


def split_cutoffs(splits: DataFrame, klass: str = "mineral_class") -> DataFrame:
    """Per class, the first digest of val and of test: all that is needed to place a row.

    Only the two opening samples of a class are aggregated; classes too small to have any are
    listed by a distinct.
    """
    opening = splits.where("opens").groupBy(klass).agg(
        F.min(F.when(F.col("split") == "val", F.col("digest"))).alias("val_from"),
        F.min(F.when(F.col("split") == "test", F.col("digest"))).alias("test_from"))
    return splits.select(klass).distinct().join(opening, klass, "left").select(
        klass, *[F.coalesce(c, F.lit(NEVER)).alias(c) for c in ("val_from", "test_from")])


def assign_split(df: DataFrame, cutoffs: DataFrame, seed: int = 0, sample: str = "sample_id",
                 klass: str = "mineral_class") -> DataFrame:
    """Put every row into its sample's split without shuffling the rows.

    A row's digest against its class's two cut-offs says which split it is in, so only the
    class table travels.
    """
    digest = sample_hash(sample, seed)
    return df.join(materialise(cutoffs, "cutoffs"), klass, "left").withColumn(
        "split",
        F.when(digest >= F.col("test_from"), F.lit("test"))
        .when(digest >= F.col("val_from"), F.lit("val"))
        .when(F.col("test_from").isNotNull(), F.lit("train")),
    ).drop("val_from", "test_from")


def sample_level_split(df: DataFrame, val_frac: float = 0.15, test_frac: float = 0.15, seed: int = 0,
                       sample: str = "sample_id", klass: str = "mineral_class") -> DataFrame:
    """Rows with their split, from the table alone."""
    splits = split_samples(df, val_frac, test_frac, seed, sample, klass)
    return assign_split(df, split_cutoffs(splits, klass), seed, sample, klass)


def attach_split(df: DataFrame, splits: DataFrame, sample: str = "sample_id") -> DataFrame:
    """Rows of samples listed in a stored split table, by an ordinary join on the sample."""
    return df.join(splits.select(sample, "split"), sample)


def in_split(df: DataFrame, splits: DataFrame, name: str, sample: str = "sample_id") -> DataFrame:
    return df.join(splits.where(F.col("split") == name).select(sample), sample, "left_semi")


def leaked_samples(splits: DataFrame, sample: str = "sample_id") -> DataFrame:
    """Samples found in more than one split. Empty for a sound split.

    Splits are gathered as bits of one integer, which a hash aggregate can update in place.
    """
    bit = F.lit(0)
    for n, name in enumerate(sorted(SPLITS)):
        bit = F.when(F.col("split") == name, F.lit(1 << n)).otherwise(bit)
    seen = splits.groupBy(sample).agg(F.bit_or(bit).alias("_seen")).where(F.bit_count("_seen") > 1)

    def named(order: list[str]) -> Column:
        return F.coalesce(*[
            F.when(F.col("_seen").bitwiseAND(1 << sorted(SPLITS).index(n)) > 0, F.lit(n)) for n in order])

    return seen.select(sample, F.bit_count("_seen").cast("bigint").alias("n_splits"),
                       named(sorted(SPLITS)).alias("first_split"), named(sorted(SPLITS, reverse=True)).alias("last_split"))


def assert_no_leakage(splits: DataFrame, sample: str = "sample_id") -> None:
    seen = leaked_samples(splits, sample).limit(5).collect()
    if seen:
        raise AssertionError(f"samples in several splits: {[r[0] for r in seen]}")


def split_sizes(rows: DataFrame, sample: str = "sample_id", klass: str = "mineral_class") -> DataFrame:
    """Rows and distinct samples per split and class."""
    return rows.groupBy("split", klass).agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct(sample).alias("n_samples"))
