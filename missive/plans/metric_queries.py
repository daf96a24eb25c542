"""Queries over predictions, splits and decision economics, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from missive.functions.text import family_key
from missive.operators import economics as E
from missive.operators import metrics as M
from missive.operators import records as O
from missive.operators import splits as S
from missive.plans import duck as D
from missive.plans.fixtures import P, RD, TV, T, fixture
from missive.sources.scratch import written

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


def p(s: SparkSession, d: str) -> DataFrame:
    return fixture(s, d, P)


def priced(s: SparkSession, d: str) -> DataFrame:
    """Records with a utility probability."""
    return fixture(s, d, T).withColumn("p_utility", ((F.col("ingest_seq") * 7919 + 13) % 1000).cast("double") / 1000)


PR = "pr AS (SELECT *, CAST((ingest_seq * 7919 + 13) % 1000 AS DOUBLE) / 1000 AS p_utility FROM t)"


def scores(truth: str = "recorded_category", pred: str = "prediction") -> str:
    c = lambda cond: f"count(*) FILTER (WHERE {cond})"
    return f"""count(*) AS samples, round({c(f"{truth} = {pred}")} / nullif(count(*), 0), 6) AS accuracy, round(greatest({c(f"{truth} = 'UTILITY'")}, {c(f"{truth} = 'MARKETING'")}) / nullif(count(*), 0), 6) AS majority_accuracy,
 round({c(f"{pred} = 'UTILITY' AND {truth} = 'UTILITY'")} / nullif({c(f"{pred} = 'UTILITY'")}, 0), 6) AS utility_precision, round({c(f"{pred} = 'UTILITY' AND {truth} = 'UTILITY'")} / nullif({c(f"{truth} = 'UTILITY'")}, 0), 6) AS utility_recall, {c(f"{truth} = 'UTILITY'")} AS recorded_utility"""


query("a3_score_rows", f"{D.ctes('p')} SELECT {scores()} FROM p")(lambda s, d: M.score_rows(p(s, d)))
query("a4_slice_metrics", f"{D.ctes('p')} SELECT 'all' AS slice, {scores()} FROM p UNION ALL SELECT CASE requested_category WHEN 'UTILITY' THEN 'requested_utility' ELSE 'requested_marketing' END AS slice, {scores()} FROM p GROUP BY 1")(lambda s, d: M.slice_metrics(p(s, d)))
BAND = "CASE WHEN text_p >= 0.694 THEN 'UTILITY' WHEN text_p < 0.615 THEN 'MARKETING' ELSE 'NEEDS_REVIEW' END"
query("m11_band", f"{D.ctes('p')} SELECT id, {BAND} AS band FROM p")(lambda s, d: p(s, d).select("id", M.band(F.col("text_p"), 0.615, 0.694).alias("band")))
query("a5_band_metrics", f"""{D.ctes('p')}, b AS (SELECT *, {BAND} AS band FROM p) SELECT round(count(*) FILTER (WHERE band <> 'NEEDS_REVIEW') / count(*), 6) AS coverage, count(*) FILTER (WHERE band <> 'NEEDS_REVIEW') AS decided, count(*) FILTER (WHERE band = 'NEEDS_REVIEW') AS referred,
 round(count(*) FILTER (WHERE band = recorded_category) / count(*) FILTER (WHERE band <> 'NEEDS_REVIEW'), 6) AS accuracy_when_decided, round(count(*) FILTER (WHERE band = 'UTILITY' AND recorded_category = 'UTILITY') / count(*) FILTER (WHERE band = 'UTILITY'), 6) AS utility_precision_when_decided FROM b""")(
    lambda s, d: M.band_metrics(p(s, d).withColumn("band", M.band(F.col("text_p"), 0.615, 0.694))))
query("a6_classification_report", f"""{D.ctes('p')}, l AS (SELECT unnest(['MARKETING', 'UTILITY']) AS label), c AS (SELECT label, count(*) FILTER (WHERE recorded_category = label) AS support, count(*) FILTER (WHERE prediction = label) AS predicted, count(*) FILTER (WHERE prediction = label AND recorded_category = label) AS hit FROM l, p GROUP BY label),
r AS (SELECT *, coalesce(hit / nullif(predicted, 0), 0) AS pr, coalesce(hit / nullif(support, 0), 0) AS re FROM c), f AS (SELECT *, coalesce(2 * pr * re / nullif(pr + re, 0), 0) AS f FROM r)
SELECT label, support, round(pr, 6) AS precision, round(re, 6) AS recall, round(f, 6) AS f1, round(avg(f) OVER (), 6) AS macro_f1 FROM f""")(lambda s, d: M.classification_report(p(s, d)))
query("a6_confusion_matrix", f"""{D.ctes('p')} SELECT recorded_category, count(*) FILTER (WHERE prediction = 'MARKETING') AS "MARKETING", count(*) FILTER (WHERE prediction = 'UTILITY') AS "UTILITY" FROM p GROUP BY 1""")(lambda s, d: M.confusion_matrix(p(s, d)))
query("a7_majority_accuracy", f"{D.ctes('p')}, m AS (SELECT recorded_category AS label FROM p WHERE CAST(id AS BIGINT) % 4 <> 0 GROUP BY 1 ORDER BY count(*) DESC, 1 DESC LIMIT 1) SELECT label, round(avg((recorded_category = label)::INT), 6) AS accuracy FROM p, m WHERE CAST(id AS BIGINT) % 4 = 0 GROUP BY 1")(
    lambda s, d: M.majority_accuracy(p(s, d).where("cast(id as bigint) % 4 <> 0"), p(s, d).where("cast(id as bigint) % 4 = 0")))
WILSON = "((k / n + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n))", "(1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4 * n * n)) / (1 + 1.96 * 1.96 / n))"
query("a8_wilson", f"{D.ctes('p')}, c AS (SELECT requested_category, count(*) AS n, count(*) FILTER (WHERE prediction = recorded_category) AS k FROM p GROUP BY 1) SELECT requested_category, round(greatest(0, {WILSON[0]} - {WILSON[1]}), 6) AS low, round(least(1, {WILSON[0]} + {WILSON[1]}), 6) AS high FROM c")(
    lambda s, d: p(s, d).groupBy("requested_category").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("prediction") == F.col("recorded_category")).alias("k")).select("requested_category", *[F.round(x, 6).alias(a) for x, a in zip(M.wilson(F.col("k"), F.col("n")), ("low", "high"))]))
query("a9_benchmark_summary", f"""{D.ctes('p')}, c AS (SELECT count(*) AS n, count(*) FILTER (WHERE judge IS NULL) AS failures, count(*) FILTER (WHERE judge = 'NEEDS_REVIEW') AS abstentions, count(*) FILTER (WHERE judge = recorded_category) AS k, count(judge) AS answered FROM p)
SELECT n AS attempted, failures, abstentions, k AS correct, answered, round(k / n, 6) AS end_to_end_accuracy, round(k / answered, 6) AS answered_accuracy, round(greatest(0, {WILSON[0]} - {WILSON[1]}), 6) AS low, round(least(1, {WILSON[0]} + {WILSON[1]}), 6) AS high, k / n >= 0.9 AS target_reached FROM c""")(lambda s, d: M.benchmark_summary(p(s, d)))
query("a10_compare_judges", f"{D.ctes('p')} SELECT prediction, judge, count(*) AS n, count(*) FILTER (WHERE prediction = recorded_category) AS local_right, count(*) FILTER (WHERE judge = recorded_category) AS judge_right FROM p WHERE judge IS NOT NULL GROUP BY 1, 2")(lambda s, d: M.compare_judges(p(s, d)))
ERR = "e AS (SELECT *, CASE prediction WHEN 'UTILITY' THEN 'false_utility' ELSE 'false_marketing' END AS direction FROM p WHERE prediction <> recorded_category)"
query("a11_error_rows", f"{D.ctes('p', ERR)} SELECT id, direction FROM e")(lambda s, d: M.error_rows(p(s, d)).select("id", "direction"))
query("a11_error_report", f"{D.ctes('p', ERR)} SELECT direction, count(*) AS n, count(*) FILTER (WHERE CAST(id AS BIGINT) % 5 = 0) AS reviewed FROM e GROUP BY 1")(
    lambda s, d: M.error_rows(p(s, d)).groupBy("direction").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("id").cast("long") % 5 == 0).alias("reviewed")))
query("a20_roc_auc", f"{D.ctes('p')}, r AS (SELECT recorded_category, rank() OVER (ORDER BY text_p) + (count(*) OVER (PARTITION BY text_p) - 1) / 2 AS rk FROM p), c AS (SELECT sum(rk) FILTER (WHERE recorded_category = 'UTILITY') AS r, count(*) FILTER (WHERE recorded_category = 'UTILITY') AS np, count(*) FILTER (WHERE recorded_category <> 'UTILITY') AS nn FROM r) SELECT round((r - np * (np + 1) / 2) / (np * nn), 6) AS auc FROM c")(lambda s, d: M.roc_auc(p(s, d)))
query("a22_ensemble_diagnostics", f"{D.ctes('p')} SELECT count(*) FILTER (WHERE (text_p >= 0.5) <> (neural_p >= 0.5)) AS disagreements, round(avg(((text_p >= 0.5) = (recorded_category = 'UTILITY') OR (neural_p >= 0.5) = (recorded_category = 'UTILITY'))::INT), 6) AS either_correct FROM p WHERE requested_category = 'UTILITY'")(lambda s, d: M.ensemble_diagnostics(p(s, d)))
query("a23_class_weights", f"{D.ctes('p')} SELECT recorded_category, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight FROM p GROUP BY 1")(lambda s, d: M.class_weights(p(s, d)))
query("w5_operating_point", f"{D.ctes('p')}, t AS (SELECT DISTINCT round(text_p, 3) AS t FROM p), q AS (SELECT t, avg((recorded_category = 'UTILITY')::INT) AS pr FROM t JOIN p ON text_p >= t GROUP BY t) SELECT coalesce(min(t) FILTER (WHERE pr >= 0.9), 1.0) AS threshold FROM q")(lambda s, d: M.operating_point(p(s, d), "text_p", 0.9))
GRID = f"(SELECT i * {len(M.THRESHOLDS)} + j AS setting, w, t FROM (VALUES {', '.join(f'({i}, {w}::DOUBLE)' for i, w in enumerate(M.WEIGHTS))}) a(i, w), (VALUES {', '.join(f'({j}, {t}::DOUBLE)' for j, t in enumerate(M.THRESHOLDS))}) b(j, t))"
query("m15_blend_grid", f"""{D.ctes('p')}, x AS (SELECT setting, w, t, requested_category, (round(w * neural_p + (1 - w) * text_p, 6) >= t) = (recorded_category = 'UTILITY') AS ok FROM {GRID} g, p),
y AS (SELECT CAST(setting AS INT) AS setting, w AS weight, t AS threshold, round(count(*) FILTER (WHERE ok AND requested_category = 'UTILITY') / count(*) FILTER (WHERE requested_category = 'UTILITY'), 6) AS requested_accuracy, round(avg(ok::INT), 6) AS accuracy FROM x GROUP BY 1, 2, 3)
SELECT *, CAST(row_number() OVER (ORDER BY requested_accuracy DESC, accuracy DESC, setting) AS INT) AS rank FROM y""")(lambda s, d: M.blend_grid(p(s, d)))
query("m17_conditional", f"{D.ctes('p')} SELECT id, CASE WHEN requested_category = 'MARKETING' THEN 'MARKETING' ELSE prediction END AS prediction FROM p")(lambda s, d: p(s, d).select("id", M.conditional(F.col("requested_category"), F.col("prediction")).alias("prediction")))
query("m25_serve_scores", f"{D.ctes('p')} SELECT id, round(CASE requested_category WHEN 'MARKETING' THEN 0.02 WHEN 'UTILITY' THEN 0.5 * neural_p + 0.5 * text_p ELSE text_p END, 6) AS score FROM p")(lambda s, d: M.serve_scores(p(s, d)).select("id", "score"))
query("m26_locked_assessment", f"{D.ctes('p')} " + " UNION ALL ".join(f"SELECT '{k}' AS model, {scores(pred=e)} FROM p" for k, e in (("candidate", "(CASE WHEN 0.5 * neural_p + 0.5 * text_p >= 0.5 THEN 'UTILITY' ELSE 'MARKETING' END)"), ("text", "(CASE WHEN text_p >= 0.5 THEN 'UTILITY' ELSE 'MARKETING' END)"), ("baseline", "prediction"))))(
    lambda s, d: p(s, d).select("recorded_category", F.explode(F.array(*[F.struct(F.lit(k).alias("model"), F.when(c, "UTILITY").otherwise("MARKETING").alias("prediction")) for k, c in (("candidate", 0.5 * F.col("neural_p") + 0.5 * F.col("text_p") >= 0.5), ("text", F.col("text_p") >= 0.5), ("baseline", F.col("prediction") == "UTILITY"))])).alias("m")).select("recorded_category", "m.*").groupBy("model").agg(*M.score_columns()))
query("j13_paired", f"{D.ctes('p')} SELECT id, prediction, judge FROM p WHERE judge IS NOT NULL")(lambda s, d: M.paired(p(s, d).select("id", "prediction"), p(s, d)))
query("j14_scored_with_failures", f"{D.ctes('p')} SELECT id, coalesce(judge, 'ERROR') AS answer FROM p")(lambda s, d: M.with_failures(p(s, d)).select("id", "answer"))
query("j15_aligned", f"{D.ctes('p')} SELECT id, text_p, CASE WHEN CAST(id AS BIGINT) % 7 <> 0 THEN neural_p END AS neural_p, CAST(id AS BIGINT) % 7 = 0 AS missing FROM p")(
    lambda s, d: M.aligned(p(s, d).select("id", "text_p"), p(s, d).where("cast(id as bigint) % 7 <> 0").select("id", "neural_p")))
ANN = "SELECT id, 's1' AS snapshot, CAST(CAST(id AS BIGINT) % 3 AS INT) AS version, CASE CAST(id AS BIGINT) % 2 WHEN 0 THEN 'CONFIRMED' ELSE 'DISPUTED' END AS review, concat('note ', id) AS notes FROM e WHERE CAST(id AS BIGINT) % 3 > 0"


def annotations(s: SparkSession, d: str) -> DataFrame:
    n = F.col("id").cast("long")
    return M.error_rows(p(s, d)).where(n % 3 > 0).select("id", F.lit("s1").alias("snapshot"), (n % 3).cast("int").alias("version"), F.when(n % 2 == 0, "CONFIRMED").otherwise("DISPUTED").alias("review"), F.concat(F.lit("note "), "id").alias("notes"))


query("j11_error_queue", f"{D.ctes('p', ERR)}, a AS ({ANN}) SELECT e.id, direction, coalesce(version, 0) AS version, coalesce(review, 'UNREVIEWED') AS review, coalesce(notes, '') AS notes FROM e LEFT JOIN a USING (id)")(
    lambda s, d: M.error_queue(M.error_rows(p(s, d)), annotations(s, d), "s1").select("id", "direction", "version", "review", "notes"))
query("f14_browse_errors", f"{D.ctes('p', ERR)}, a AS ({ANN}) SELECT e.id FROM e LEFT JOIN a USING (id) WHERE direction = 'false_utility' AND coalesce(review, 'UNREVIEWED') = 'CONFIRMED' ORDER BY CAST(id AS BIGINT) LIMIT 10")(
    lambda s, d: M.error_queue(M.error_rows(p(s, d)), annotations(s, d), "s1").where("direction = 'false_utility' AND review = 'CONFIRMED'").orderBy(F.col("id").cast("long")).limit(10).select("id"))
query("w10_apply_annotations", f"""{D.ctes('p', ERR)}, a AS ({ANN}), i AS (SELECT id, CAST(CAST(id AS BIGINT) % 2 AS INT) AS version, CASE CAST(id AS BIGINT) % 7 WHEN 0 THEN 'OTHER' ELSE 'CONFIRMED' END AS review, CASE CAST(id AS BIGINT) % 5 WHEN 0 THEN 'UTILITY' ELSE '' END AS outcome FROM e)
SELECT i.id, coalesce(a.version, 0) AS current, CASE WHEN i.version <> coalesce(a.version, 0) THEN 'stale_version' WHEN i.review = 'OTHER' THEN 'unknown_status' WHEN outcome <> '' THEN 'outcome_without_evidence' ELSE 'accepted' END AS result FROM i LEFT JOIN a USING (id)""")(
    lambda s, d: M.apply_annotations(annotations(s, d), M.error_rows(p(s, d)).select("id", F.lit("s1").alias("snapshot"), (F.col("id").cast("long") % 2).cast("int").alias("version"), F.when(F.col("id").cast("long") % 7 == 0, "OTHER").otherwise("CONFIRMED").alias("review"), F.when(F.col("id").cast("long") % 5 == 0, "UTILITY").otherwise("").alias("outcome"), F.lit("").alias("draft"), F.lit("").alias("reference"))).select("id", "current", "result"))

FR = lambda seed, c: f"CAST(('0x' || substr(sha256('{seed}:' || {c}), 1, 8))::BIGINT AS DOUBLE) / 4294967296"
CLEAN = D.ctes("tv", D.clean_cte())


def clean(s: SparkSession, d: str) -> DataFrame:
    return O.training_families(fixture(s, d, TV))


def _checked(families: DataFrame) -> DataFrame:
    return M.check_partitions(S.fixed_split(families).select("part", F.col("family").alias("id")), families.select(F.col("family").alias("id")))


query("m9_grouped_holdout", f"{CLEAN} SELECT family, {FR('s0', 'family')} < 0.25 AS holdout FROM clean")(lambda s, d: S.grouped_holdout(clean(s, d)).select("family", "holdout"))
query("m8_folds", f"{CLEAN} SELECT family, CAST(floor({FR('f', 'family')} * 5) AS INT) AS fold FROM clean")(lambda s, d: S.folds(clean(s, d), 5).select("family", "fold"))
TS = "try_cast(replace({}, 'Z', '+00:00') AS TIMESTAMPTZ)"
SPANS = f"""sp AS (SELECT family, min({TS.format('created_at')}) AS f, max({TS.format('created_at')}) AS l, bool_or({TS.format('created_at')} IS NULL) AS invalid FROM cand WHERE family IN (SELECT family FROM clean) GROUP BY family),
cut AS (SELECT f AS cutoff FROM (SELECT f, row_number() OVER (ORDER BY f) AS rn, count(*) OVER () AS n FROM sp WHERE NOT invalid) WHERE rn = floor(n * 0.75) + 1)"""
query("w6_cutoff", f"{D.ctes('tv', D.clean_cte(), SPANS)} SELECT CAST(epoch(cutoff) AS BIGINT) AS cutoff FROM cut")(lambda s, d: S.cutoff(S.family_spans(fixture(s, d, TV)).where("not invalid"), "first").select(F.unix_timestamp("cutoff").alias("cutoff")))
query("m13_chronological_split", f"{D.ctes('tv', D.clean_cte(), SPANS)} SELECT family, CASE WHEN invalid THEN 'invalid' WHEN l < cutoff THEN 'train' WHEN f >= cutoff THEN 'test' ELSE 'purged' END AS side FROM sp, cut")(lambda s, d: S.chronological_split(fixture(s, d, TV)))
FIXED = f"""h AS (SELECT *, {FR('s0', 'family')} < 0.25 AS holdout FROM clean), r AS (SELECT family, row_number() OVER (PARTITION BY meta_category, requested_category ORDER BY sha256('v:' || family), family) <= floor(0.25 * count(*) OVER (PARTITION BY meta_category, requested_category)) AS chosen FROM h WHERE NOT holdout),
parts AS (SELECT family, CASE WHEN chosen THEN 'validation' ELSE 'train' END AS part FROM r UNION ALL SELECT family, 'holdout' FROM h WHERE holdout)"""
query("m22_fixed_split", f"{D.ctes('tv', D.clean_cte(), FIXED)} SELECT family, part FROM parts")(lambda s, d: S.fixed_split(clean(s, d)))
query("w12_check_partitions", "SELECT 0::BIGINT AS overlapping, 0::BIGINT AS uncovered, 0::BIGINT AS foreign")(lambda s, d: _checked(written(clean(s, d))))


@query("w12_check_bad_partitions", f"{D.ctes('p')} SELECT count(*) FILTER (WHERE id::BIGINT % 5 = 0) AS overlapping, count(*) FILTER (WHERE id::BIGINT % 7 = 0 AND id::BIGINT % 5 <> 0) AS uncovered, count(*) FILTER (WHERE id::BIGINT % 11 = 0) AS foreign FROM p")
def w12_check_bad_partitions(s: SparkSession, d: str) -> DataFrame:
    """A split with overlaps (multiples of 5), holes (other multiples of 7) and ids of no row (multiples of 11, negated)."""
    rows = p(s, d).select("id", F.col("id").cast("long").alias("n"))
    part = F.when(F.col("n") % 5 == 0, F.array(F.lit("a"), F.lit("b"))).when(F.col("n") % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("a")))
    parts = rows.select(F.explode(part).alias("part"), "id")
    strangers = rows.where("n % 11 = 0").select(F.lit("c").alias("part"), F.concat(F.lit("x"), "id").alias("id"))
    return M.check_partitions(parts.unionByName(strangers), rows)


query("m23_stratified_sample", f"{D.ctes('p')} SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY recorded_category ORDER BY sha256('b:' || id), id) AS rn, count(*) OVER (PARTITION BY recorded_category) AS n, count(*) OVER () AS total FROM p) WHERE rn <= round(100 * n / total)")(lambda s, d: S.stratified_sample(p(s, d), 100, "b").select("id"))
query("m24_cohort_sample", f"{D.ctes('t')} SELECT id, cohort FROM (SELECT id, cohort, row_number() OVER (PARTITION BY cohort ORDER BY sha256('c:' || id), id) AS rn FROM (SELECT id, CASE meta_category WHEN 'UTILITY' THEN 'approved' ELSE 'downgraded' END AS cohort FROM t WHERE requested_category = 'UTILITY' AND meta_category IN ('UTILITY', 'MARKETING'))) WHERE rn <= CASE cohort WHEN 'approved' THEN 30 ELSE 50 END")(
    lambda s, d: S.cohort_sample(O.cohorts(fixture(s, d, T)), {"approved": 30, "downgraded": 50}, "c").select("id", "cohort"))
TF = f"tf AS (SELECT *, {D.family()} AS family FROM t)"
query("j8_training_only", f"{D.ctes('t', TF)} SELECT id FROM tf WHERE CAST(id AS BIGINT) % 10 <> 0 AND family NOT IN (SELECT family FROM tf WHERE CAST(id AS BIGINT) % 10 = 0)")(
    lambda s, d: (lambda f: S.training_only(f, f.where("ingest_seq % 10 = 0")).select("id"))(fixture(s, d, T).withColumn("family", family_key())))
query("j9_pending", f"{D.ctes('t')} SELECT id FROM t WHERE CAST(id AS BIGINT) % 3 <> 0 ORDER BY id LIMIT 200")(lambda s, d: S.pending(fixture(s, d, T).select("id"), fixture(s, d, T).where("ingest_seq % 3 = 0"), 200))
query("j9_pending_all", f"{D.ctes('t')} SELECT id FROM t WHERE CAST(id AS BIGINT) % 3 <> 0")(lambda s, d: S.pending(fixture(s, d, T).select("id"), fixture(s, d, T).where("ingest_seq % 3 = 0")))

COST = "p_utility * 1.0 + (1 - p_utility) * 49.5"
query("x1_costs", f"{D.ctes('t', PR)} SELECT id, round({COST}, 4) AS cost_if_utility, 7.5::DOUBLE AS cost_if_marketing, round(42.0::DOUBLE / 48.5, 3) AS break_even, 6.5::DOUBLE AS saving, 0.0::DOUBLE AS pure_break_even FROM pr")(
    lambda s, d: E.costs(priced(s, d)).select("id", "cost_if_utility", "cost_if_marketing", "break_even", "saving", "pure_break_even"))
query("x2_decide", f"{D.ctes('t', PR)} SELECT id, CASE WHEN p_utility >= 42.0::DOUBLE / 48.5 THEN 'UTILITY' ELSE 'MARKETING' END AS declare FROM pr")(lambda s, d: E.decide(priced(s, d)).select("id", "declare"))
query("x4_weights", f"{D.ctes('t', PR)} SELECT id, coalesce(monthly_volume, 0) AS volume FROM pr")(lambda s, d: E.weights(priced(s, d)).select("id", "volume"))
RUN = """run AS (SELECT *, round(sum(volume) OVER o, 6) AS cv, round(sum(risk) OVER o, 6) AS cr FROM (SELECT *, round(volume * (1 - p_utility), 9) AS risk FROM (SELECT *, coalesce(monthly_volume, 0) AS volume FROM pr)) WINDOW o AS (ORDER BY p_utility DESC, volume DESC, id ROWS UNBOUNDED PRECEDING)),
al AS (SELECT *, CASE WHEN bool_and(coalesce(cv > 0 AND round(cr / nullif(cv, 0), 9) <= 0.15, false)) OVER (ORDER BY p_utility DESC, volume DESC, id ROWS UNBOUNDED PRECEDING) THEN 'UTILITY' ELSE 'MARKETING' END AS declare FROM run)"""
query("w3_allocate", f"{D.ctes('t', PR, RUN)} SELECT id, declare, CASE declare WHEN 'UTILITY' THEN round(volume * p_utility * 6.5, 4) ELSE 0.0 END AS saving FROM al")(lambda s, d: E.allocate(priced(s, d), 0.15).select("id", "declare", "saving"))
query("x5_portfolio", f"""{D.ctes('t', PR, RUN)}, c AS (SELECT count(*) FILTER (WHERE declare = 'UTILITY') AS declared_utility, count(*) AS templates, coalesce(sum(volume) FILTER (WHERE declare = 'UTILITY'), 0) AS v, sum(risk) FILTER (WHERE declare = 'UTILITY') AS r, sum(volume) AS total FROM al)
SELECT declared_utility, templates, round(v, 2) AS utility_volume, round(total, 2) AS total_volume, round(v / total, 4) AS utility_share, round(r / v, 4) AS misclassification, round(total * 7.5, 2) AS baseline, round(total * 7.5 - v * 6.5, 2) AS projected FROM c""")(lambda s, d: E.portfolio(E.allocate(priced(s, d), 0.15)))
query("w4_risk_curve", f"{D.ctes('t', PR, RUN)} SELECT budget, count(*) FILTER (WHERE round(cr / nullif(cv, 0), 9) <= budget) AS declared_utility, round(coalesce(max(cv) FILTER (WHERE round(cr / nullif(cv, 0), 9) <= budget), 0), 2) AS utility_volume FROM run, (SELECT unnest([{', '.join(f'{b}::DOUBLE' for b in E.RISK_BUDGETS)}]) AS budget) GROUP BY budget")(lambda s, d: E.risk_curve(priced(s, d)))
