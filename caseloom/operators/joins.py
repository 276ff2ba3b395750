"""Joins that check what they promise, and population checks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Counted rows up to which a side is broadcast by hint; larger sides are left to Spark.
BROADCAST_ROWS = 500_000
#: Values up to which a list of keys is part of the condition itself.
LISTED = 1000


def assert_unique(df: DataFrame, keys: list[str], what: str) -> None:
    if df.groupBy(*keys).count().where("count > 1").head(1):
        raise ValueError(f"{what}: {', '.join(keys)} is not unique")


def small(df: DataFrame) -> DataFrame:
    """With a broadcast hint if it has BROADCAST_ROWS rows at most."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def many_to_one(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", check: bool = True) -> DataFrame:
    """Many rows on the left meet one on the right."""
    if check:
        assert_unique(right, keys, "right side")
    return left.join(right, keys, how)


def once(df: DataFrame, keys: list[str], what: str) -> DataFrame:
    """df, which fails where it is computed if a key repeats: the same shuffle by key serves a join, so nothing is computed twice."""
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(f"`{c}`") for c in rest]) if rest else F.struct(F.lit(1).alias("_"))
    found = df.groupBy(*keys).agg(F.first(row).alias("_row"), F.count(F.lit(1)).alias("_times"))
    fail = F.raise_error(F.concat(F.lit(f"{what}: {', '.join(keys)} is not unique: "), F.to_json(F.struct(*keys))))
    kept = found.select(*keys, F.when(F.col("_times") > 1, fail).otherwise(F.col("_row")).alias("_row"))
    return kept.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]) if rest else kept.where(F.col("_row").isNotNull()).select(*keys)


def one_to_one(base: DataFrame, blocks: list[DataFrame], keys: list[str], check: bool | str = True) -> DataFrame:
    """Left joins of blocks to base; each side has one row a key, and no column twice.

    check: True looks at the keys of all sides beforehand, which computes each side once more; "inline" lets the result
    fail where it is computed; False trusts the caller.
    """
    if check is True:
        assert_unique(base, keys, "base")
    seen = set(base.columns)
    for b in blocks:
        if clash := (seen & set(b.columns)) - set(keys):
            raise ValueError(f"columns twice: {', '.join(sorted(clash))}")
        if check is True:
            assert_unique(b, keys, "block")
        seen |= set(b.columns)
    if check == "inline":
        base, blocks = once(base, keys, "base"), [once(b, keys, "block") for b in blocks]
    return reduce(lambda a, b: a.join(b, keys, "left"), blocks, base)


def members(rows: DataFrame, ids: DataFrame | Sequence, key: str = "case_id") -> DataFrame:
    """rows whose key is among ids: a short list of values goes into the scan, any other set is joined."""
    if not isinstance(ids, DataFrame):
        if len(ids) <= LISTED:
            return rows.where(F.col(key).isin(list(ids)))
        ids = rows.sparkSession.createDataFrame([(x,) for x in ids], rows.select(key).schema)
    return rows.join(small(ids.select(key).distinct()), key, "left_semi")


def aligned_violations(frames: dict[str, DataFrame], key: str, metadata: list[str]) -> DataFrame:
    """(model, case, problem) where a model's population or metadata differ from the first model's."""
    (first, base), *rest = frames.items()
    found = []
    for name, df in rest:
        a = base.select(F.col(key), F.struct(*metadata).alias("m"))
        b = df.select(F.col(key).alias("other"), F.struct(*metadata).alias("n"))
        met = a.join(b, a[key].eqNullSafe(F.col("other")), "full")
        problem = F.when(F.col("n").isNull(), "missing").when(F.col("m").isNull(), "extra").when(~F.col("m").eqNullSafe(F.col("n")), "changed")
        found.append(met.select(F.lit(name).alias("model"), F.coalesce(key, "other").alias(key), problem.alias("problem")).where("problem IS NOT NULL"))
    return reduce(DataFrame.unionAll, found) if found else base.select(F.lit(first).alias("model"), F.col(key), F.lit("").alias("problem")).where("false")


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """As bags of rows."""
    return not a.exceptAll(b).head(1) and not b.exceptAll(a).head(1)


def in_sample_order(sample: DataFrame, predictions: DataFrame, key: str, ordinal: str) -> DataFrame:
    """Predictions in the order of a sample, which they must cover one to one."""
    assert_unique(predictions, [key], "predictions")
    assert_unique(sample, [key], "sample")
    joined = sample.join(predictions, key, "left")
    if joined.where(F.col("prediction").isNull()).head(1):
        raise ValueError("the sample has cases without a prediction")
    return joined.orderBy(ordinal)


def key_overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that both sides hold."""
    return a.select(key).distinct().join(b.select(key), key, "left_semi")


def key_parts(spark: SparkSession) -> int:
    """Parts to which keys are dealt where a task shall hold one part and no more."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def key_parity(splits: dict[str, dict[str, DataFrame]], key: str = "case_id", base: str = "base") -> DataFrame:
    """(split, block, missing, extra, nulls): how many keys of a split's base a block lacks, or has beside them, in one pass.

    A key gets a bit for each block that holds it; keys are grouped by their bits, and those few groups give all counts.
    Rows are dealt by key before any is grouped, into as many parts as spark.sql.shuffle.partitions says, which are not
    put together again: a task groups the keys of its part alone. Whole numbers stay numbers.
    """
    names = {split: [base, *sorted(b for b in blocks if b != base)] for split, blocks in splits.items()}
    if any(base not in blocks or len(blocks) > 63 for blocks in splits.values()):
        raise ValueError(f"a split needs {base}, and 62 blocks beside it at most")
    frames = [splits[s][b] for s, blocks in names.items() for b in blocks]
    kind = "long" if {df.schema[key].dataType.typeName() for df in frames} <= {"long", "integer", "short", "byte"} else "string"
    bits = [splits[s][b].select(F.lit(s).alias("split"), F.col(key).cast(kind).alias("k"), F.lit(1 << i).cast("long").alias("bit")) for s, blocks in names.items() for i, b in enumerate(blocks)]
    rows = reduce(DataFrame.unionAll, bits)
    dealt = rows.where(F.col("k").isNotNull()).repartition(key_parts(frames[0].sparkSession), "k")
    masks = dealt.groupBy("split", "k").agg(F.bit_or("bit").alias("mask")).groupBy("split", "mask").agg(F.count(F.lit(1)).alias("n"))
    nulls = rows.where(F.col("k").isNull()).groupBy("split", F.col("bit").alias("bit")).agg(F.count(F.lit(1)).alias("nulls"))
    named = splits[next(iter(splits))][base].sparkSession.createDataFrame([(s, b, 1 << i) for s, blocks in names.items() for i, b in enumerate(blocks) if i], "split string, block string, bit long")
    has, of_base = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.lit(1)) != 0
    counts = named.join(masks, "split", "left").groupBy("split", "block", "bit").agg(F.coalesce(F.sum(F.when(of_base & ~has, F.col("n"))), F.lit(0)).alias("missing"), F.coalesce(F.sum(F.when(~of_base & has, F.col("n"))), F.lit(0)).alias("extra"))
    return counts.join(nulls, ["split", "bit"], "left").select("split", "block", "missing", "extra", F.coalesce("nulls", F.lit(0)).cast("long").alias("nulls"))
