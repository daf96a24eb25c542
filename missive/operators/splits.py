"""Deterministic splits and samples: order and fold come from hashes that other engines share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from missive.functions.text import date_value
from missive.operators.ranges import before, hash_ranked
from missive.operators.records import candidates, with_family
from missive.sources.scratch import written


def hash_fraction(seed: str, c: Column) -> Column:
    """A number in [0, 1) from the first 8 hexadecimal digits of SHA-256."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(seed + ":"), c), 256), 1, 8), 16, 10).cast("double") / float(1 << 32)


def hash_order(seed: str, c: Column) -> Column:
    return F.sha2(F.concat(F.lit(seed + ":"), c), 256)


def grouped_holdout(df: DataFrame, share: float = 0.25, seed: str = "s0", group: str = "family") -> DataFrame:
    return df.withColumn("holdout", hash_fraction(seed, F.col(group)) < share)


def grouped_holdout_with_both(df: DataFrame, share: float = 0.25, label: str = "meta_category", tries: int = 10) -> DataFrame:
    """The first seed whose two sides both hold both labels; all seeds are counted in one pass.

    Where no seed does, each label is split by itself: the first floor(share * n) of its families in hash order are
    held out, one at least of two or more; a label's only family stays in training.
    """
    held = [F.count_if(hash_fraction(f"s{k}", F.col("family")) < share).alias(f"s{k}") for k in range(tries)]
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), *held).collect()  # a row for each label
    for k in range(tries):
        if sum(r[f"s{k}"] > 0 for r in counts) >= 2 and sum(r[f"s{k}"] < r["n"] for r in counts) >= 2:
            return grouped_holdout(df, share, f"s{k}")
    ranked = hash_ranked(df, [label], hash_order("s0", F.col("family")), "family")
    most = F.greatest(F.floor(share * F.col("__n")), F.when(F.col("__n") >= 2, 1).otherwise(0))
    return ranked.withColumn("holdout", F.col("__rank") <= most).drop("__rank", "__n")


def folds(df: DataFrame, n: int, seed: str = "f", group: str = "family", name: str = "fold") -> DataFrame:
    return df.withColumn(name, F.floor(hash_fraction(seed, F.col(group)) * n).cast("int"))


def cutoff(dates: DataFrame, column: str, share: float = 0.75) -> DataFrame:
    """The element at floor(n * share) of the sorted column.

    Counted by distinct value first: the running sum is over dates, not over rows.
    """
    counts = dates.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    at = before(counts, column, ["n"]).crossJoin(F.broadcast(total))
    return at.where(F.col("before_n") + F.col("n") > F.floor(F.col("total") * share)).agg(F.min(column).alias("cutoff"))


def family_spans(df: DataFrame) -> DataFrame:
    """family, first, last of all candidate rows of clean families; families with an invalid date are void."""
    rows = with_family(candidates(df))
    created = date_value(F.col("created_at"))
    updated = F.when(F.col("updated_at") == "", created).otherwise(date_value(F.col("updated_at")))
    rows = rows.select("family", "meta_category", created.alias("c"), updated.alias("u"))
    bad = F.col("c").isNull() | F.col("u").isNull() | (F.col("u") < F.col("c"))
    spans = rows.groupBy("family").agg(
        F.min(F.least("c", "u")).alias("first"), F.max(F.greatest("c", "u")).alias("last"), F.bool_or(bad).alias("invalid"), F.min("meta_category").alias("a"), F.max("meta_category").alias("z"))
    return spans.where("a = z").select("family", "first", "last", "invalid")  # one label, as in training_families


def chronological_split(df: DataFrame) -> DataFrame:
    """family, side: train, test, purged (spans the cutoff) or invalid."""
    spans = written(family_spans(df))
    at = cutoff(spans.where("not invalid"), "first")
    side = F.when(F.col("invalid"), "invalid").when(F.col("last") < F.col("cutoff"), "train").when(F.col("first") >= F.col("cutoff"), "test").otherwise("purged")
    return spans.crossJoin(F.broadcast(at)).select("family", side.alias("side"))


def top_share(df: DataFrame, strata: list[str], share: float, seed: str, key: str = "id") -> DataFrame:
    """chosen: the first floor(share * n) rows of each stratum in hash order."""
    ranked = hash_ranked(df, strata, hash_order(seed, F.col(key)), key)
    return ranked.withColumn("chosen", F.col("__rank") <= F.floor(share * F.col("__n"))).drop("__rank", "__n")


def fixed_split(df: DataFrame, seed: str = "v", share: float = 0.25) -> DataFrame:
    """part: holdout by family hash, validation by strata of the rest, else train.

    Strata are label and requested category; if one of them has a single row, the label alone.
    """
    strata = ["meta_category", "requested_category"]
    held = written(grouped_holdout(df.select("family", *strata), 0.25, "s0"))
    rare = held.where("not holdout").groupBy(*strata).agg(F.count(F.lit(1)).alias("n")).where("n < 2").limit(1).count()
    rest = top_share(held.where("not holdout"), strata[:1] if rare else strata, share, seed, "family")
    part = F.when(F.col("chosen"), "validation").otherwise("train")
    return rest.select("family", part.alias("part")).unionByName(held.where("holdout").select("family", F.lit("holdout").alias("part")))


def persisted_split(df: DataFrame, path: str, seed: str = "v", share: float = 0.25) -> DataFrame:
    """family, part as fixed_split draws it, written to path the first time and read from there ever after.

    A stored split of other families is refused.
    """
    spark = df.sparkSession
    try:
        stored = spark.read.schema("family string, part string").parquet(path)
        known = stored.count()
    except Exception as missing:  # Spark's own class for this differs between modes
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        fixed_split(df, seed, share).write.parquet(path)
        return spark.read.schema("family string, part string").parquet(path)
    if known != df.count() or df.join(stored, "family", "left_anti").limit(1).count():
        raise ValueError("the stored split is of other families")
    return stored


def stratified_sample(df: DataFrame, n: int, seed: str, label: str = "recorded_category", key: str = "id") -> DataFrame:
    """About n rows, by label in proportion, whatever the order of input."""
    total = df.agg(F.count(F.lit(1)).alias("__total"))
    ranked = hash_ranked(df, [label], hash_order(seed, F.col(key)), key).crossJoin(F.broadcast(total))
    return ranked.where(F.col("__rank") <= F.round(n * F.col("__n") / F.col("__total"))).drop("__n", "__rank", "__total")


def cohort_sample(df: DataFrame, sizes: dict[str, int], seed: str, key: str = "id") -> DataFrame:
    """So many rows of each cohort, in hash order."""
    limit = F.coalesce(*[F.when(F.col("cohort") == c, F.lit(n)) for c, n in sizes.items()])
    ranked = hash_ranked(df, ["cohort"], hash_order(seed, F.col(key)), key)
    return ranked.where(F.col("__rank") <= limit).drop("__rank", "__n")


def training_only(corpus: DataFrame, holdout: DataFrame) -> DataFrame:
    """corpus without the holdout's ids and without its families."""
    return corpus.join(holdout.select("id"), "id", "left_anti").join(holdout.select("family").distinct(), "family", "left_anti")


def pending(targets: DataFrame, done: DataFrame, limit: int | None = None) -> DataFrame:
    rest = targets.join(done.select("id"), "id", "left_anti")
    return rest if limit is None else rest.orderBy("id").limit(limit)
