"""Queries of the reports and of the rest of the reference's parts, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from missive.functions import text as X
from missive.operators import records as O
from missive.operators import replies as Z
from missive.operators import reports as W
from missive.operators import rules as U
from missive.operators import splits as S
from missive.operators import vectors as V
from missive.plans import duck as D
from missive.plans.fixtures import P, RD, TV, T, fixture
from missive.plans.text_queries import SQL as TEXT_SQL
from missive.plans.vector_queries import CEN, DOT, EV, e
from missive.sources.scratch import folder, written

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None) -> Callable:
    def put(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


SOURCE = "CASE ingest_seq % 3 WHEN 0 THEN 'export' WHEN 1 THEN 'upload' ELSE '' END"


@query("a1_sources_and_labels", f"""{D.ctes('tv', D.clean_cte())} SELECT 'source' AS field, {SOURCE} AS value, count(*) AS n FROM tv GROUP BY 2
 UNION ALL SELECT 'training_category', meta_category, count(*) FROM clean GROUP BY 2""")
def a1_sources_and_labels(s: SparkSession, d: str) -> DataFrame:
    rows = fixture(s, d, TV).withColumn("source", F.expr(SOURCE))
    return O.source_and_label_counts(rows)


@query("a10_judge_report", f"""{D.ctes('p')} SELECT count(judge) AS judged, count(*) FILTER (WHERE judge IS NULL) AS failed, count(*) FILTER (WHERE judge = 'AUTHENTICATION') AS authentication,
 count(*) FILTER (WHERE judge = prediction) AS agreed, count(*) FILTER (WHERE judge <> prediction) AS disagreed, count(*) FILTER (WHERE judge <> prediction AND judge = recorded_category) AS judge_correct,
 count(*) FILTER (WHERE judge <> prediction AND prediction = recorded_category) AS local_correct,
 count(*) FILTER (WHERE judge <> prediction AND judge <> recorded_category AND prediction <> recorded_category) AS neither_correct FROM p""")
def a10_judge_report(s: SparkSession, d: str) -> DataFrame:
    return W.judge_report(fixture(s, d, P))


KIND = "(ingest_seq + round) % 5"
REASON = f"CASE {KIND} WHEN 0 THEN 'no_json' WHEN 1 THEN 'confidence_outside_range' WHEN 3 THEN 'unknown_category' ELSE '' END"


@query("a10_reasons_and_clauses", f"""{D.ctes('rd')} SELECT 'clause' AS kind, 'a' AS value, count(*) AS n FROM rd WHERE {KIND} IN (2, 4) HAVING count(*) > 0
 UNION ALL SELECT 'clause', 'b', count(*) FROM rd WHERE {KIND} = 4 HAVING count(*) > 0
 UNION ALL SELECT 'failure', CAST({KIND} AS VARCHAR), count(*) FROM rd WHERE {KIND} IN (0, 1, 3) GROUP BY 2""")
def a10_reasons_and_clauses(s: SparkSession, d: str) -> DataFrame:
    """Replies that fail, by the shape of reply that fails, and the clauses cited by those that don't."""
    parsed = fixture(s, d, RD).select(F.expr(f"cast({KIND} as string)").alias("shape"), Z.parse_responses(F.col("raw")).alias("r"))
    return W.reason_counts(parsed.select(F.when(F.col("r.reason") != "", F.col("shape")).otherwise("").alias("reason"), F.col("r.reply.clauses").alias("clauses")))


LP = """lp AS (SELECT CASE meta_category WHEN 'UTILITY' THEN 'meta_utility' ELSE 'meta_marketing' END AS "set", meta_category, CASE WHEN (ingest_seq * 7) % 10 < 6 THEN 'MARKETING' ELSE 'UTILITY' END AS classified,
 CASE ingest_seq % 4 WHEN 0 THEN 'error' WHEN 1 THEN 'not_converted' ELSE 'converted' END AS outcome, 1 + ingest_seq % 3 AS rounds FROM t WHERE meta_category IN ('UTILITY', 'MARKETING'))"""


@query("a13_loop_report", f"""{D.ctes('t', LP)} SELECT "set", count(*) AS templates, count(*) FILTER (WHERE classified = 'UTILITY') AS said_utility, round(avg((classified = meta_category)::INT), 4) AS classifier_accuracy,
 count(*) FILTER (WHERE classified = 'MARKETING') AS sent, count(*) FILTER (WHERE classified = 'MARKETING' AND outcome = 'converted') AS converted, count(*) FILTER (WHERE classified = 'MARKETING' AND outcome = 'not_converted') AS not_converted,
 count(*) FILTER (WHERE classified = 'MARKETING' AND outcome = 'error') AS errors, round(avg(rounds) FILTER (WHERE classified = 'MARKETING'), 2) AS mean_rounds FROM lp GROUP BY 1""")
def a13_loop_report(s: SparkSession, d: str) -> DataFrame:
    n = F.col("ingest_seq")
    rows = fixture(s, d, T).where("meta_category in ('UTILITY', 'MARKETING')").select(
        F.when(F.col("meta_category") == "UTILITY", "meta_utility").otherwise("meta_marketing").alias("set"), "meta_category",
        F.when((n * 7) % 10 < 6, "MARKETING").otherwise("UTILITY").alias("classified"),
        F.when(n % 4 == 0, "error").when(n % 4 == 1, "not_converted").otherwise("converted").alias("outcome"), (1 + n % 3).alias("rounds"))
    return W.loop_report(rows)


RC = """rc AS (SELECT possible AND ingest_seq % 5 > 0 AS accepted, CASE WHEN NOT possible THEN 'REFUSED' WHEN ingest_seq % 5 > 0 THEN 'REWROTE' WHEN ingest_seq % 2 = 0 THEN 'REJECTED' ELSE 'ERROR' END AS verdict,
 CAST((ingest_seq * 13 + round) % 200 - 80 AS DOUBLE) / 1000 AS gain, score, CAST((ingest_seq * 29) % 1000 AS DOUBLE) / 1000 AS start_score, round AS rounds_used FROM rd)"""


@query("a14_recast_report", f"""{D.ctes('rd', RC)} SELECT count(*) AS attempted, count(*) FILTER (WHERE accepted) AS rewrote, round(avg(accepted::INT), 4) AS rewrote_share, count(*) FILTER (WHERE verdict = 'REFUSED') AS refused,
 count(*) FILTER (WHERE verdict = 'REJECTED') AS rejected, count(*) FILTER (WHERE verdict = 'ERROR') AS errors, round(avg(gain) FILTER (WHERE accepted), 4) AS mean_gain, count(*) FILTER (WHERE accepted AND gain > 0) AS closer,
 count(*) FILTER (WHERE accepted AND gain < 0) AS further, round(avg(start_score) FILTER (WHERE accepted), 4) AS reward_before, round(avg(score) FILTER (WHERE accepted), 4) AS reward_after,
 count(*) FILTER (WHERE accepted AND score > start_score) AS improved, count(*) FILTER (WHERE accepted AND score >= 0.6) AS cleared_target, round(avg(rounds_used) FILTER (WHERE accepted), 2) AS mean_rounds FROM rc""")
def a14_recast_report(s: SparkSession, d: str) -> DataFrame:
    n = F.col("ingest_seq")
    rows = fixture(s, d, RD).select(
        (F.col("possible") & (n % 5 > 0)).alias("accepted"),
        F.when(~F.col("possible"), "REFUSED").when(n % 5 > 0, "REWROTE").when(n % 2 == 0, "REJECTED").otherwise("ERROR").alias("verdict"),
        (((n * 13 + F.col("round")) % 200 - 80).cast("double") / 1000).alias("gain"), "score", (((n * 29) % 1000).cast("double") / 1000).alias("start_score"), F.col("round").alias("rounds_used"))
    return W.recast_report(rows)


VERDICT = "CASE WHEN NOT possible THEN 'REFUSED' WHEN ingest_seq % 11 = 0 THEN 'ERROR' WHEN ingest_seq % 7 = 0 THEN 'PROMOTIONAL_INTENT' WHEN score >= 0.4 THEN 'DRAFTED' ELSE 'WEAK' END"


@query("a15_regenerate_report", f"""{D.ctes('rd')}, rg AS (SELECT {VERDICT} AS verdict, ingest_seq % 3 = 0 AS form_matched, score FROM rd) SELECT count(*) AS templates, count(*) FILTER (WHERE verdict = 'DRAFTED') AS drafted,
 round(avg((verdict = 'DRAFTED')::INT), 4) AS drafted_share, count(*) FILTER (WHERE verdict = 'WEAK') AS weak, count(*) FILTER (WHERE verdict = 'PROMOTIONAL_INTENT') AS promotional_intent, count(*) FILTER (WHERE verdict = 'REFUSED') AS refused,
 count(*) FILTER (WHERE verdict = 'ERROR') AS errors, count(*) FILTER (WHERE verdict = 'DRAFTED' AND form_matched) AS matched_form, round(avg(score) FILTER (WHERE verdict = 'DRAFTED'), 4) AS mean_score,
 count(*) FILTER (WHERE verdict = 'DRAFTED' AND score >= 0.6) AS above_target FROM rg""")
def a15_regenerate_report(s: SparkSession, d: str) -> DataFrame:
    return W.regenerate_report(fixture(s, d, RD).select(F.expr(VERDICT).alias("verdict"), (F.col("ingest_seq") % 3 == 0).alias("form_matched"), "score"))


ASSIGNED = f"asg AS (SELECT id, category, arg_max(form, (score, -form)) AS form FROM (SELECT e.id, e.category, form, round({DOT('e.vector', 'centre')}, 6) AS score FROM e, ce) GROUP BY 1, 2)"
REPORT = """fr AS (SELECT form, approved, downgraded, round(approved / (approved + downgraded), 4) AS approval_rate, service_messages, round(service_messages * approved / (approved + downgraded), 1) AS expected_at_base_rate
 FROM (SELECT form, count(*) FILTER (WHERE category = 'UTILITY') AS approved, count(*) FILTER (WHERE category = 'MARKETING') AS downgraded, count(*) FILTER (WHERE category = 'MARKETING' AND id % 3 = 0) AS service_messages FROM asg GROUP BY 1) WHERE approved > 0)"""


def assigned(s: SparkSession, d: str) -> DataFrame:
    from missive.plans.vector_queries import centres

    return V.nearest_centre(e(s, d), centres(s, d)).join(e(s, d).select("id", "category"), "id").withColumn("is_service", F.col("id") % 3 == 0)


@query("a18_form_report", f"WITH {EV}, {CEN}, {ASSIGNED}, {REPORT} SELECT * FROM fr")
def a18_form_report(s: SparkSession, d: str) -> DataFrame:
    return W.form_report(assigned(s, d))


@query("a18_form_totals", f"""WITH {EV}, {CEN}, {ASSIGNED}, {REPORT}, n AS (SELECT count(*) AS downgraded FROM asg WHERE category = 'MARKETING')
 SELECT any_value(n.downgraded) AS downgraded, CAST(round(sum(expected_at_base_rate), 0) AS BIGINT) AS floor, round(sum(expected_at_base_rate) / any_value(n.downgraded), 4) AS floor_share, CAST(sum(service_messages) AS BIGINT) AS ceiling,
 round(sum(service_messages) / any_value(n.downgraded), 4) AS ceiling_share FROM fr, n""")
def a18_form_totals(s: SparkSession, d: str) -> DataFrame:
    rows = assigned(s, d)
    return W.form_totals(W.form_report(rows), rows.where("category = 'MARKETING'"))


RATES = {"reference": r"\{\{[^}]+\}\}", "today": r"\btoday\b", "shipped": "has shipped", "explore": "explore our"}
_PART = lambda p, c: f"100 * avg({D.hit('body', p)}::INT) FILTER (WHERE meta_category = '{c}')"


@query("a24_pattern_report", f"{D.ctes('t')} " + " UNION ALL ".join(
    f"SELECT '{k}' AS pattern, round({_PART(p, 'UTILITY')}, 1) AS coverage, round({_PART(p, 'UTILITY')} - {_PART(p, 'MARKETING')}, 1) AS separation FROM t WHERE requested_category = 'UTILITY' AND meta_category IN ('UTILITY', 'MARKETING')" for k, p in RATES.items()))
def a24_pattern_report(s: SparkSession, d: str) -> DataFrame:
    return W.pattern_report(O.cohorts(fixture(s, d, T)), RATES)


@query("f11_script_gate", f"""{D.ctes('rd')} SELECT id, round, CASE WHEN ingest_seq % 3 = 0 THEN (ingest_seq + round) % 2 = 0 ELSE true END AS kept_script FROM rd""")
def f11_script_gate(s: SparkSession, d: str) -> DataFrame:
    """Every third original is in another script; half of its candidates are in it too."""
    n, hindi = F.col("ingest_seq"), F.lit(" यह संदेश आपके लिए है और इसमें आदेश की जानकारी दी गई है। इसे पढ़ लें और आगे की सूचना की प्रतीक्षा करें। धन्यवाद, आपका दिन शुभ हो और यात्रा मंगलमय रहे।")
    original = F.when(n % 3 == 0, hindi).otherwise(F.col("original"))
    candidate = F.when((n % 3 == 0) & ((n + F.col("round")) % 2 == 0), hindi).otherwise(F.col("candidate"))
    return fixture(s, d, RD).select("id", "round", Z.kept_script(original, candidate).alias("kept_script"))


EX = f"""xr AS (SELECT label::INT AS form, vector FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY id) AS n FROM e) WHERE n <= 3),
xc AS (SELECT form, list(m ORDER BY i) AS centre FROM (SELECT form, i, avg(vector[i]::DOUBLE) AS m FROM xr, (SELECT unnest(generate_series(1, 64)) AS i) GROUP BY 1, 2) GROUP BY 1)"""


@query("m20_exemplar_form", f"""WITH {EV}, {EX} SELECT id, round(max({DOT('e.vector', 'centre')} / sqrt({DOT('e.vector', 'e.vector')}) / sqrt({DOT('centre', 'centre')})), 6) AS similarity FROM e, xc GROUP BY 1""")
def m20_exemplar_form(s: SparkSession, d: str) -> DataFrame:
    """Draft mode: the form of largest similarity, by the mean of its first three exemplars; all forms here are approved often enough."""
    centres = V.exemplar_centres(e(s, d).withColumn("form", F.col("label").cast("int")))
    return V.classify_draft(e(s, d), centres.withColumn("approval_rate", F.lit(1.0))).select("id", "similarity")


@query("m22_manifest", f"{D.ctes('tv', D.clean_cte())} SELECT count(*) AS families, true AS same FROM clean")
def m22_manifest(s: SparkSession, d: str) -> DataFrame:
    """A split that was written once is read again, not drawn anew."""
    path, rows = f"{folder(s)}/manifest", written(O.training_families(fixture(s, d, TV)))
    first = S.persisted_split(rows, path)
    again = S.persisted_split(rows, path, seed="another")
    changed = first.join(again.withColumnRenamed("part", "again"), "family", "full_outer").where("not (part <=> again)")
    return first.agg(F.count(F.lit(1)).alias("families")).crossJoin(changed.agg((F.count(F.lit(1)) == 0).alias("same")))


@query("p13_fill_by_rule")
def p13_fill_by_rule(s: SparkSession, d: str) -> DataFrame:
    """Samples by eleven ordered rules; repeats take the next variant; tests compare it with a plain loop."""
    return fixture(s, d, T).select("id", Z.fill_by_rule(F.col("body")).alias("filled"))


SQL["a1_summary_counts_all"] = f"{TEXT_SQL['a1_summary_counts']} UNION ALL SELECT * FROM ({SQL['a1_sources_and_labels']})"


@query("a1_summary_counts_all", SQL["a1_summary_counts_all"])
def a1_summary_counts_all(s: SparkSession, d: str) -> DataFrame:
    rows = fixture(s, d, TV).withColumn("source", F.expr(SOURCE))
    return O.summary_counts(rows).unionByName(O.source_and_label_counts(rows))
