"""Reports over judged, converted, recast, regenerated and clustered messages: one row each, or one a cohort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def _n() -> Column:
    return F.count(F.lit(1))


def _share(c: Column, of: Column | None = None, places: int = 4) -> Column:
    n = _n() if of is None else F.count_if(of)
    return F.round(F.coalesce(F.try_divide(F.count_if(c), n), F.lit(0.0)), places)


def judge_report(df: DataFrame) -> DataFrame:
    """prediction, judge (null: no answer), recorded_category -> counts over the rows that both judged."""
    judged, other = F.col("judge").isNotNull(), F.col("judge") != F.col("prediction")
    right, local = F.col("judge") == F.col("recorded_category"), F.col("prediction") == F.col("recorded_category")
    return df.agg(
        F.count_if(judged).alias("judged"), F.count_if(~judged).alias("failed"), F.count_if(F.col("judge") == "AUTHENTICATION").alias("authentication"),
        F.count_if(judged & ~other).alias("agreed"), F.count_if(other).alias("disagreed"), F.count_if(other & right).alias("judge_correct"),
        F.count_if(other & local).alias("local_correct"), F.count_if(other & ~right & ~local).alias("neither_correct"),
    )


def reason_counts(results: DataFrame) -> DataFrame:
    """reason ('' where there is an answer), clauses -> kind, value, n: failures by reason and cited clauses by name."""
    failures = results.where("reason <> ''").groupBy(F.lit("failure").alias("kind"), F.col("reason").alias("value")).agg(_n().alias("n"))
    cited = results.where("reason = ''").select(F.explode("clauses").alias("value"))
    return failures.unionByName(cited.groupBy(F.lit("clause").alias("kind"), "value").agg(_n().alias("n")))


def loop_report(df: DataFrame) -> DataFrame:
    """set, classified, meta_category, outcome, rounds -> one row for each set; what is sent on is classified MARKETING."""
    sent = F.col("classified") == "MARKETING"
    outcome = lambda name: F.count_if(sent & (F.col("outcome") == name))
    return df.groupBy("set").agg(
        _n().alias("templates"), F.count_if(F.col("classified") == "UTILITY").alias("said_utility"), _share(F.col("classified") == F.col("meta_category")).alias("classifier_accuracy"),
        F.count_if(sent).alias("sent"), outcome("converted").alias("converted"), outcome("not_converted").alias("not_converted"), outcome("error").alias("errors"),
        F.round(F.avg(F.when(sent, F.col("rounds"))), 2).alias("mean_rounds"),
    )


def recast_report(df: DataFrame, target: float = 0.60) -> DataFrame:
    """accepted, verdict, gain, score, start_score, rounds_used -> one row; scores are of accepted rewrites."""
    accepted = F.col("accepted")
    scored = accepted & F.col("score").isNotNull()
    mean = lambda c, which: F.round(F.avg(F.when(which, F.col(c))), 4)
    verdict = lambda v: F.count_if(F.col("verdict") == v)
    return df.agg(
        _n().alias("attempted"), F.count_if(accepted).alias("rewrote"), _share(accepted).alias("rewrote_share"), verdict("REFUSED").alias("refused"),
        verdict("REJECTED").alias("rejected"), verdict("ERROR").alias("errors"), mean("gain", accepted).alias("mean_gain"),
        F.count_if(accepted & (F.col("gain") > 0)).alias("closer"), F.count_if(accepted & (F.col("gain") < 0)).alias("further"),
        mean("start_score", scored).alias("reward_before"), mean("score", scored).alias("reward_after"),
        F.count_if(scored & (F.col("score") > F.col("start_score"))).alias("improved"), F.count_if(scored & (F.col("score") >= target)).alias("cleared_target"),
        F.round(F.avg(F.when(scored, F.coalesce("rounds_used", F.lit(1)))), 2).alias("mean_rounds"),
    )


def regenerate_report(df: DataFrame, target: float = 0.60) -> DataFrame:
    """verdict, form_matched, score -> one row; scores are of drafted rows."""
    drafted = F.col("verdict") == "DRAFTED"
    verdict = lambda v: F.count_if(F.col("verdict") == v)
    return df.agg(
        _n().alias("templates"), F.count_if(drafted).alias("drafted"), _share(drafted).alias("drafted_share"), verdict("WEAK").alias("weak"),
        verdict("PROMOTIONAL_INTENT").alias("promotional_intent"), verdict("REFUSED").alias("refused"), verdict("ERROR").alias("errors"),
        F.count_if(drafted & F.col("form_matched")).alias("matched_form"), F.round(F.avg(F.when(drafted, F.col("score"))), 4).alias("mean_score"),
        F.count_if(drafted & (F.col("score") >= target)).alias("above_target"),
    )


def form_report(assigned: DataFrame) -> DataFrame:
    """form, category, is_service -> a form's counts, its approval rate, and what its service messages may expect at that rate.

    A form without approved messages has no row, and one without downgraded ones the rate 1.
    """
    approved, down = F.count_if(F.col("category") == "UTILITY"), F.count_if(F.col("category") == "MARKETING")
    by = assigned.groupBy("form").agg(approved.alias("approved"), down.alias("downgraded"), F.count_if((F.col("category") == "MARKETING") & F.col("is_service")).alias("service_messages"))
    rate = F.col("approved") / (F.col("approved") + F.col("downgraded"))
    return by.where("approved > 0").select(
        "form", "approved", "downgraded", F.round(rate, 4).alias("approval_rate"), "service_messages", F.round(F.col("service_messages") * F.col("approved") / (F.col("approved") + F.col("downgraded")), 1).alias("expected_at_base_rate"))


def form_totals(report: DataFrame, downgraded: DataFrame) -> DataFrame:
    """One row: floor (service messages expected to pass as they are) and ceiling (all of them), as counts and as shares of downgraded."""
    n = downgraded.agg(_n().alias("downgraded"))
    sums = report.agg(F.coalesce(F.sum("service_messages"), F.lit(0)).alias("ceiling"), F.coalesce(F.sum(F.col("expected_at_base_rate").cast("decimal(20,1)")), F.lit(0)).cast("double").alias("expected"))  # exact sums of tenths, in any order
    share = lambda c: F.round(F.try_divide(F.col(c), F.col("downgraded")), 4)
    return sums.crossJoin(n).select("downgraded", F.round("expected", 0).cast("long").alias("floor"), share("expected").alias("floor_share"), "ceiling", share("ceiling").alias("ceiling_share"))


def pattern_report(df: DataFrame, patterns: dict[str, str], text: str = "body") -> DataFrame:
    """pattern, coverage of approved rows and separation from downgraded ones, in percentage points."""
    hits = df.select("cohort", F.explode(F.array(*[F.struct(F.lit(k).alias("pattern"), F.col(text).rlike("(?i)" + p).alias("hit")) for k, p in patterns.items()])).alias("h")).select("cohort", "h.*")
    share = lambda c: 100 * F.avg(F.when(F.col("cohort") == c, F.col("hit").cast("double")))
    return hits.groupBy("pattern").agg(F.round(share("approved"), 1).alias("coverage"), F.round(share("approved") - share("downgraded"), 1).alias("separation"))
