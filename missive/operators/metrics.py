"""Metrics over predictions, thresholds, and evaluation bookkeeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from missive.operators.ranges import before

U, M = "UTILITY", "MARKETING"


def _n(condition: Column) -> Column:
    return F.count_if(condition)


def score_columns(truth: str = "recorded_category", predicted: str = "prediction") -> list[Column]:
    """samples, accuracy, majority_accuracy, utility_precision, utility_recall, recorded_utility."""
    t, p, n = F.col(truth), F.col(predicted), F.count(F.lit(1))
    counts = [_n(t == c) for c in (U, M)]
    return [
        n.alias("samples"), F.round(F.try_divide(_n(t == p), n), 6).alias("accuracy"), F.round(F.try_divide(F.greatest(*counts), n), 6).alias("majority_accuracy"),
        F.round(F.try_divide(_n((p == U) & (t == U)), _n(p == U)), 6).alias("utility_precision"), F.round(F.try_divide(_n((p == U) & (t == U)), _n(t == U)), 6).alias("utility_recall"),
        _n(t == U).alias("recorded_utility"),
    ]


def score_rows(df: DataFrame, predicted: str = "prediction") -> DataFrame:
    return df.agg(*score_columns(predicted=predicted))


def slice_metrics(df: DataFrame) -> DataFrame:
    """The scores of all rows and of each requested category, from one scan."""
    names = F.array(F.lit("all"), F.when(F.col("requested_category") == U, F.lit("requested_utility")).when(F.col("requested_category") == M, F.lit("requested_marketing")))
    return df.withColumn("slice", F.explode(names)).where("slice is not null").groupBy("slice").agg(*score_columns())


def band(p: Column, low: float, high: float) -> Column:
    """Three bands; crossed thresholds collapse to the lower one."""
    low = min(low, high)
    return F.when(p >= high, U).when(p < low, M).otherwise("NEEDS_REVIEW")


def band_metrics(df: DataFrame) -> DataFrame:
    b, t, n = F.col("band"), F.col("recorded_category"), F.count(F.lit(1))
    decided = b != "NEEDS_REVIEW"
    return df.agg(
        F.round(F.coalesce(F.try_divide(_n(decided), n), F.lit(0.0)), 6).alias("coverage"), _n(decided).alias("decided"), _n(~decided).alias("referred"),
        F.round(F.try_divide(_n(decided & (b == t)), _n(decided)), 6).alias("accuracy_when_decided"), F.round(F.try_divide(_n((b == U) & (t == U)), _n(b == U)), 6).alias("utility_precision_when_decided"))


def classification_report(df: DataFrame) -> DataFrame:
    """label, support, precision, recall, f1 (0 where a denominator is 0), macro_f1."""
    pairs = df.groupBy("recorded_category", "prediction").agg(F.count(F.lit(1)).alias("n"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    rows = pairs.select(F.explode(F.array(F.lit(M), F.lit(U))).alias("label"), "*").groupBy("label").agg(
        F.coalesce(F.sum(F.when(F.col("recorded_category") == F.col("label"), F.col("n"))), F.lit(0)).alias("support"),
        F.coalesce(F.sum(F.when(F.col("prediction") == F.col("label"), F.col("n"))), F.lit(0)).alias("predicted"),
        F.coalesce(F.sum(F.when((F.col("prediction") == F.col("label")) & (F.col("recorded_category") == F.col("label")), F.col("n"))), F.lit(0)).alias("hit"))
    rows = rows.withColumns({"precision": zero(F.try_divide("hit", "predicted")), "recall": zero(F.try_divide("hit", "support"))})
    rows = rows.withColumn("f1", zero(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))))
    macro = F.avg("f1").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))  # two rows
    return rows.select("label", "support", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round("f1", 6).alias("f1"), F.round(macro, 6).alias("macro_f1"))


def confusion_matrix(df: DataFrame) -> DataFrame:
    return df.groupBy("recorded_category").pivot("prediction", [M, U]).agg(F.count(F.lit(1))).na.fill(0)


def majority_accuracy(train: DataFrame, test: DataFrame) -> DataFrame:
    label = train.groupBy("recorded_category").agg(F.count(F.lit(1)).alias("n")).agg(F.max_by("recorded_category", F.struct("n", "recorded_category")).alias("label"))
    return test.crossJoin(F.broadcast(label)).groupBy("label").agg(F.round(F.avg((F.col("recorded_category") == F.col("label")).cast("double")), 6).alias("accuracy"))


def wilson(correct: Column, total: Column) -> tuple[Column, Column]:
    """95% interval, clipped; null for no rows."""
    z, p = 1.96, F.try_divide(correct, total)
    scale = 1 + z * z / total
    center = (p + z * z / (2 * total)) / scale
    margin = z * F.sqrt(p * (1 - p) / total + z * z / (4 * total * total)) / scale
    some = total > 0
    return F.when(some, F.greatest(F.lit(0.0), center - margin)), F.when(some, F.least(F.lit(1.0), center + margin))


def with_failures(df: DataFrame, answer: str = "judge") -> DataFrame:
    """Rows without an answer stay in, as ERROR."""
    return df.withColumn("answer", F.coalesce(answer, F.lit("ERROR")))


def benchmark_summary(df: DataFrame, target: float = 0.90) -> DataFrame:
    scored = with_failures(df)
    t, a, n = F.col("recorded_category"), F.col("answer"), F.count(F.lit(1))
    out = scored.agg(n.alias("attempted"), _n(a == "ERROR").alias("failures"), _n(a == "NEEDS_REVIEW").alias("abstentions"), _n(a == t).alias("correct"), _n(a != "ERROR").alias("answered"))
    low, high = wilson(F.col("correct"), F.col("attempted"))
    return out.withColumns({
        "end_to_end_accuracy": F.round(F.try_divide("correct", "attempted"), 6), "answered_accuracy": F.round(F.try_divide("correct", "answered"), 6),
        "low": F.round(low, 6), "high": F.round(high, 6), "target_reached": F.coalesce(F.try_divide("correct", "attempted") >= target, F.lit(False))})


def paired(rows: DataFrame, results: DataFrame, answer: str = "judge") -> DataFrame:
    """Rows with the answer of the other judge, where there is one."""
    return rows.join(results.where(F.col(answer).isNotNull()).select("id", answer), "id")


def compare_judges(df: DataFrame) -> DataFrame:
    """Over rows that both judged: agreement cells with how often each side was right."""
    both = df.where("judge is not null")
    return both.groupBy("prediction", "judge").agg(F.count(F.lit(1)).alias("n"), _n(F.col("prediction") == F.col("recorded_category")).alias("local_right"), _n(F.col("judge") == F.col("recorded_category")).alias("judge_right"))


def error_rows(df: DataFrame) -> DataFrame:
    kind = F.when(F.col("prediction") == U, "false_utility").otherwise("false_marketing")
    return df.where("prediction <> recorded_category").withColumn("direction", kind)


def roc_auc(df: DataFrame, p: str = "text_p") -> DataFrame:
    """Rank-sum over distinct scores: what is sorted is one row per score, not per prediction."""
    counts = df.groupBy(F.col(p).alias("s")).agg(_n(F.col("recorded_category") == U).alias("pos"), F.count(F.lit(1)).alias("n"))
    ranked = before(counts, "s", ["n"]).withColumn("mean_rank", F.col("before_n") + (F.col("n") + 1) / 2)
    total = ranked.agg(F.sum(F.col("mean_rank") * F.col("pos")).alias("r"), F.sum("pos").alias("np"), F.sum(F.col("n") - F.col("pos")).alias("nn"))
    return total.select(F.round(F.try_divide(F.col("r") - F.col("np") * (F.col("np") + 1) / 2, (F.col("np") * F.col("nn")).cast("double")), 6).alias("auc"))


def class_weights(df: DataFrame, label: str = "recorded_category") -> DataFrame:
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # one row per class
    return counts.select(label, F.round(F.sum("n").over(everything) / (F.count(F.lit(1)).over(everything) * F.col("n")), 6).alias("weight"))


def operating_point(df: DataFrame, p: str, target: float, positive: str = U) -> DataFrame:
    """Lowest 3-decimal threshold whose predictions reach the target precision, else 1.

    Predictions are first counted by the highest threshold they pass, at most 1,001 bins.
    """
    bins = df.select(F.floor(F.round(F.col(p) * 1000, 6)).alias("bin"), F.round(F.col(p), 3).alias("t"), (F.col("recorded_category") == positive).alias("hit"))
    by_bin = bins.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("h"))
    thresholds = bins.select((F.round(F.col("t") * 1000)).cast("long").alias("bin")).distinct()
    at = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = by_bin.select("bin", "n", "h").unionByName(thresholds.select("bin", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("h"))).groupBy("bin").agg(F.sum("n").alias("n"), F.sum("h").alias("h"))
    reached = every.withColumns({"n": F.sum("n").over(at), "h": F.sum("h").over(at)}).join(thresholds, "bin", "left_semi")
    return reached.agg(F.coalesce(F.min(F.when((F.col("n") > 0) & (F.col("h") / F.col("n") >= target), F.col("bin") / 1000)), F.lit(1.0)).alias("threshold"))


def ensemble_diagnostics(df: DataFrame) -> DataFrame:
    """On requested UTILITY: rows where the two models differ, and where either is right."""
    a, b = F.when(F.col("text_p") >= 0.5, U).otherwise(M), F.when(F.col("neural_p") >= 0.5, U).otherwise(M)
    t = F.col("recorded_category")
    return df.where(F.col("requested_category") == U).agg(_n(a != b).alias("disagreements"), F.round(F.avg(((a == t) | (b == t)).cast("double")), 6).alias("either_correct"))


WEIGHTS, THRESHOLDS = (0.0, 0.25, 0.5, 0.75, 1.0), (0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65)


def blend_grid(df: DataFrame) -> DataFrame:
    """Scores of every (weight, threshold), ranked by requested-UTILITY accuracy, then overall; the first of equals leads."""
    settings = [(i * len(THRESHOLDS) + j, w, t) for i, w in enumerate(WEIGHTS) for j, t in enumerate(THRESHOLDS)]
    grid = df.sparkSession.createDataFrame(settings, "setting int, weight double, threshold double")
    # numerators of thousandths: exact sums in any order
    blended = F.round(F.col("weight") * F.col("neural_p") + (1 - F.col("weight")) * F.col("text_p"), 6) >= F.col("threshold")
    right = F.when(blended, U).otherwise(M) == F.col("recorded_category")
    asked = F.col("requested_category") == U
    out = df.crossJoin(F.broadcast(grid)).groupBy("setting", "weight", "threshold").agg(F.round(F.try_divide(_n(asked & right), _n(asked)), 6).alias("requested_accuracy"), F.round(F.avg(right.cast("double")), 6).alias("accuracy"))
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("requested_accuracy"), F.desc("accuracy"), "setting")))


def assess_once(report: DataFrame, ids: DataFrame, manifest: DataFrame, path: str) -> DataFrame:
    """Writes a holdout's one assessment to path and returns it; refused a second time, or for other ids than the manifest's."""
    if ids.select("id").exceptAll(manifest.select("id")).unionByName(manifest.select("id").exceptAll(ids.select("id"))).limit(1).count():
        raise ValueError("the assessed ids are not those of the manifest")
    report.write.mode("error").json(path)  # an error if it exists
    return report.sparkSession.read.schema(report.schema).json(path)


def conditional(requested: Column, prediction: Column) -> Column:
    return F.when(requested == M, M).otherwise(prediction)


def serve_scores(df: DataFrame, weight: float = 0.5, prior: float = 0.02) -> DataFrame:
    score = F.when(F.col("requested_category") == M, F.lit(prior)).when(F.col("requested_category") == U, weight * F.col("neural_p") + (1 - weight) * F.col("text_p")).otherwise(F.col("text_p"))
    return df.withColumn("score", F.round(score, 6))


def aligned(text: DataFrame, neural: DataFrame) -> DataFrame:
    """Both scores by id; rows that one side lacks are counted in missing, never dropped."""
    return text.join(neural, "id", "full_outer").withColumn("missing", F.col("text_p").isNull() | F.col("neural_p").isNull())


def error_queue(errors: DataFrame, annotations: DataFrame, snapshot: str) -> DataFrame:
    """Errors with their saved annotation of this snapshot, or the default."""
    mine = annotations.where(F.col("snapshot") == snapshot).select("id", "version", "review", "notes")
    return errors.join(mine, "id", "left").withColumns({"version": F.coalesce("version", F.lit(0)), "review": F.coalesce("review", F.lit("UNREVIEWED")), "notes": F.coalesce("notes", F.lit(""))})


def apply_annotations(log: DataFrame, incoming: DataFrame) -> DataFrame:
    """incoming with a result: accepted, or why not; the current version is the latest in the log."""
    current = log.groupBy("snapshot", "id").agg(F.max("version").alias("current"))
    joined = incoming.join(current, ["snapshot", "id"], "left").withColumn("current", F.coalesce("current", F.lit(0)))
    result = (F.when(F.col("version") != F.col("current"), "stale_version").when(~F.col("review").isin("UNREVIEWED", "CONFIRMED", "DISPUTED"), "unknown_status")
              .when((F.col("outcome") != "") & ((F.col("draft") == "") | (F.col("reference") == "")), "outcome_without_evidence").otherwise("accepted"))
    return joined.withColumn("result", result)


def check_partitions(parts: DataFrame, whole: DataFrame) -> DataFrame:
    """parts (part, id) against whole (id): ids in two parts, ids of no part, ids of no row."""
    each = parts.groupBy("id").agg(F.count_distinct("part").alias("n"))
    joined = whole.select("id").distinct().withColumn("known", F.lit(True)).join(each, "id", "full_outer")
    return joined.agg(F.count_if(F.col("n") > 1).alias("overlapping"), F.count_if(F.col("n").isNull()).alias("uncovered"), F.count_if(F.col("known").isNull()).alias("foreign"))
