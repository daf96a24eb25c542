"""Queries over vectors, forms, recorded replies and publishing, each with its SQL where SQL can say it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from missive.functions import patterns as R
from missive.functions import text as X
from missive.operators import metrics as M
from missive.operators import records as O
from missive.operators import replies as Z
from missive.operators import rules as U
from missive.operators import vectors as V
from missive.operators.dense import exact_topk
from missive.plans import duck as D
from missive.plans.fixtures import P, RD, T, fixture
from missive.sources import files as S
from missive.sources import sinks as K
from missive.sources.scratch import folder

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


def e(s: SparkSession, d: str) -> DataFrame:
    category = F.when(F.col("label") < 5, "UTILITY").otherwise("MARKETING")
    return s.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label", category.alias("category"))


def rd(s: SparkSession, d: str) -> DataFrame:
    return fixture(s, d, RD)


DIM = 64
AXIS = [((i * 37) % 11 - 5) / 10 for i in range(DIM)]
CEN = "ce AS (SELECT label::INT AS form, list(m ORDER BY i) AS centre FROM (SELECT label, i, avg(vector[i]::DOUBLE) AS m FROM e, (SELECT unnest(generate_series(1, 64)) AS i) GROUP BY 1, 2) GROUP BY 1)"
EV = "e AS (SELECT vec_id AS id, embedding AS vector, label, CASE WHEN label < 5 THEN 'UTILITY' ELSE 'MARKETING' END AS category FROM embeddings)"
AX = "[" + ", ".join(f"{x}::DOUBLE" for x in AXIS) + "]"
DOT = lambda a, b: f"list_sum(list_transform(generate_series(1, len({a})), lambda i: {a}[i]::DOUBLE * {b}[i]::DOUBLE))"

query("g1_class_means", f"WITH {EV} SELECT category, CAST(i - 1 AS INT) AS place, round(avg(vector[i]::DOUBLE), 6) AS mean FROM e, (SELECT unnest(generate_series(1, {DIM})) AS i) GROUP BY 1, 2")(lambda s, d: V.class_means(e(s, d)).withColumn("mean", F.round("mean", 6)))


@query("g1_direction_scores")
def _direction(s: SparkSession, d: str) -> DataFrame:
    direction = V.fit_direction(e(s, d))
    return e(s, d).select("id", "category", F.round(direction.score(F.col("vector")), 4).alias("score"))


fixed = V.Direction(np.array(AXIS), -0.5, 0.5)
query("g2_direction_score", f"WITH {EV} SELECT id, round({DOT('vector', AX)} + 0.5, 6) AS score FROM e")(lambda s, d: e(s, d).select("id", F.round(fixed.score(F.col("vector")), 6).alias("score")))
query("g3_displacement", f"WITH {EV}, x AS (SELECT id, round({DOT('vector', AX)} + 0.5, 4) AS s FROM e) SELECT a.id, a.s AS before, b.s AS after, round(b.s - a.s, 4) AS moved FROM x a JOIN x b ON b.id = a.id + 1")(
    lambda s, d: e(s, d).select("id", F.col("vector").alias("a")).join(e(s, d).select((F.col("id") - 1).alias("id"), F.col("vector").alias("b")), "id").select("id", *V.displacement(fixed, F.col("a"), F.col("b"))))
query("g4_l2_normalize", f"WITH {EV} SELECT id, round(vector[1]::DOUBLE / sqrt({DOT('vector', 'vector')}), 6) AS first, round(vector[{DIM}]::DOUBLE / sqrt({DOT('vector', 'vector')}), 6) AS last FROM e")(
    lambda s, d: e(s, d).select("id", V.l2_normalize(F.col("vector")).alias("u")).select("id", F.round(F.element_at("u", 1), 6).alias("first"), F.round(F.element_at("u", DIM), 6).alias("last")))
def centres(s: SparkSession, d: str) -> DataFrame:
    """The mean vector of each label: ten rows, however many vectors."""
    means = V.class_means(e(s, d), "label").groupBy("label").agg(F.array_sort(F.collect_list(F.struct("place", "mean"))).alias("m"))
    return means.select(F.col("label").alias("form"), F.col("m.mean").alias("centre"))


query("g5_dense_topk", f"WITH {EV}, {CEN} SELECT id, match, score, rk::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, match) AS rk FROM (SELECT e.id, form AS match, round({DOT('e.vector', 'centre')} / sqrt({DOT('e.vector', 'e.vector')}) / sqrt({DOT('centre', 'centre')}), 6) AS score FROM e, ce)) WHERE rk <= 5")(
    lambda s, d: V.dense_topk(e(s, d), centres(s, d).select(F.col("form").alias("id"), F.col("centre").alias("vector")), 5))
query("g5_all_neighbors", f"""WITH {EV}, u AS (SELECT id, list_transform(vector, lambda x: x::DOUBLE / sqrt({DOT('vector', 'vector')})) AS v FROM e)
 SELECT id, match, score, rk::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, match) AS rk FROM (SELECT a.id, b.id AS match, round(list_dot_product(a.v, b.v), 6) AS score FROM u a, u b)) WHERE rk <= 5""")(
    lambda s, d: exact_topk(e(s, d), e(s, d), 5).select("id", "match", F.round("score", 6).alias("score"), "rank"))
query("a21_cohens_d", f"WITH {EV}, x AS (SELECT category, {DOT('vector', AX)} AS v FROM e), c AS (SELECT category, count(*) AS n, avg(v) AS m, var_samp(v) AS s FROM x GROUP BY 1) SELECT round((u.m - k.m) / sqrt(((u.n - 1) * u.s + (k.n - 1) * k.s) / (u.n + k.n - 2)), 4) AS cohens_d FROM c u, c k WHERE u.category = 'UTILITY' AND k.category = 'MARKETING'")(
    lambda s, d: V.cohens_d(e(s, d).withColumn("v", V.dot(F.col("vector"), V.literal(AXIS))), "v"))
query("w7_rank_candidates", f"WITH {EV}, x AS (SELECT id // 4 AS grp, id % 4 AS candidate, id % 3 <> 0 AS eligible, round({DOT('vector', AX)}, 4) AS moved FROM e) SELECT grp AS \"group\", candidate, row_number() OVER (PARTITION BY grp ORDER BY eligible DESC, moved DESC, candidate)::INT AS rank FROM x")(
    lambda s, d: V.rank_candidates(e(s, d).select(F.floor(F.col("id") / 4).alias("group"), (F.col("id") % 4).alias("candidate"), (F.col("id") % 3 != 0).alias("eligible"), F.round(V.dot(F.col("vector"), V.literal(AXIS)), 4).alias("moved"))).select("group", "candidate", "rank"))
ASG = f"asg AS (SELECT id, category, arg_max(form, (score, -form)) AS form, max(score) AS score FROM (SELECT e.id, e.category, form, round({DOT('e.vector', 'centre')}, 6) AS score FROM e, ce) GROUP BY 1, 2)"


query("m19_assignment", f"WITH {EV}, {CEN}, {ASG} SELECT id, form, score FROM asg")(lambda s, d: V.nearest_centre(e(s, d), centres(s, d)))
STATS = "st AS (SELECT form, count(*) FILTER (WHERE category = 'UTILITY') AS approved, count(*) FILTER (WHERE category = 'MARKETING') AS downgraded FROM asg GROUP BY 1)"
query("a18_form_stats", f"WITH {EV}, {CEN}, {ASG}, {STATS} SELECT form, approved, downgraded, round(approved / (approved + downgraded), 4) AS approval_rate, round(sum(approved) OVER () / sum(approved + downgraded) OVER () * (approved + downgraded), 4) AS expected FROM st")(
    lambda s, d: V.form_stats(V.nearest_centre(e(s, d), centres(s, d)).join(e(s, d).select("id", "category"), "id")))
RATED = "ra AS (SELECT form, centre, ((form * 7) % 10) / 10 AS rate FROM ce)"


def rated(s: SparkSession, d: str) -> DataFrame:
    return centres(s, d).withColumn("approval_rate", ((F.col("form") * 7) % 10) / 10)


VAL = f"round({DOT('e.vector', 'centre')} / sqrt({DOT('e.vector', 'e.vector')}) / sqrt({DOT('centre', 'centre')}) * rate, 6)"
query("m20_choose_form", f"WITH {EV}, {CEN}, {RATED} SELECT id, max({VAL}) AS value FROM e, ra WHERE rate >= 0.6 GROUP BY 1")(lambda s, d: V.choose_form(e(s, d), rated(s, d)).select("id", "value"))
query("p15_form_evidence", f"WITH {EV}, {CEN}, {ASG} SELECT id, CASE WHEN score >= 0.4 THEN ((form * 7) % 10) / 10 END AS rate FROM asg")(
    lambda s, d: V.nearest_centre(e(s, d), centres(s, d)).select("id", V.form_evidence(F.col("score"), ((F.col("form") * 7) % 10) / 10).alias("rate")))
query("j10_form_for", f"WITH {EV}, {CEN}, {ASG} SELECT e.id, coalesce(CASE WHEN e.id % 3 <> 0 THEN form END, 7)::INT AS form FROM e JOIN asg USING (id)")(
    lambda s, d: e(s, d).select("id").join(V.nearest_centre(e(s, d), centres(s, d)).where("id % 3 <> 0"), "id", "left").crossJoin(F.broadcast(rated(s, d).agg(F.max_by("form", F.struct("approval_rate", (-F.col("form")).alias("f"))).alias("best")))).select("id", F.coalesce("form", "best").alias("form")))

LOST = f"list_sort(list_distinct(list_filter(regexp_extract_all(original, '{R.PLACEHOLDER}'), lambda x: NOT list_contains(regexp_extract_all(candidate, '{R.PLACEHOLDER}'), x))))"
DISTINCT = lambda c: f"len(list_distinct(regexp_extract_all({c}, '{R.PLACEHOLDER}')))"
GATE = f"g AS (SELECT *, len({LOST}) AS lost, {D.anchor('candidate')} AS anchor, NOT {D.promo('candidate')} AS no_promo, {DISTINCT('candidate')} <= {DISTINCT('original')} + 1 AS budget FROM rd)"
CLEANED = f"a AS (SELECT *, lost = 0 AND anchor AND no_promo AS clean FROM g)"


def gated(s: SparkSession, d: str) -> DataFrame:
    rows = rd(s, d).withColumn("g", Z.gates(F.col("original"), F.col("candidate")))
    return rows.withColumn("clean", (F.col("g.lost") == 0) & F.col("g.anchor") & F.col("g.clean"))


query("f11_gates", f"{D.ctes('rd', GATE)} SELECT id, round, lost::INT AS lost, anchor, no_promo AS clean, budget FROM g")(lambda s, d: gated(s, d).select("id", "round", "g.*"))
query("p11_critique", f"{D.ctes('rd', GATE)} SELECT id, round, concat_ws('|', CASE WHEN lost > 0 THEN 'lost_placeholder' END, CASE WHEN NOT anchor THEN 'no_anchor' END, CASE WHEN NOT no_promo THEN 'promotional' END, CASE WHEN NOT budget THEN 'too_many_placeholders' END) AS critique FROM g")(
    lambda s, d: rd(s, d).select("id", "round", F.array_join(Z.critique(F.col("original"), F.col("candidate")), "|").alias("critique")))
LOOP = "pk AS (SELECT id, round, score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round) AS n FROM a WHERE clean) WHERE n = 1)"
query("w8_pick_first", f"{D.ctes('rd', GATE, CLEANED, LOOP)} SELECT id, round, score FROM pk")(lambda s, d: Z.pick_attempt(gated(s, d), "loop"))
BEST = "st AS (SELECT *, coalesce(max((clean AND score >= 0.9)::INT) OVER (PARTITION BY id ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped FROM a), bk AS (SELECT id, round, score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, round) AS n FROM st WHERE stopped = 0 AND clean) WHERE n = 1)"
query("w8_pick_best", f"{D.ctes('rd', GATE, CLEANED, BEST)} SELECT id, round, score FROM bk")(lambda s, d: Z.pick_attempt(gated(s, d), "best"))
query("w9_draft_verdict", f"{D.ctes('rd', GATE, CLEANED, BEST)}, x AS (SELECT id, any_value(original) AS original, count(*) FILTER (WHERE possible) AS np FROM rd GROUP BY 1) SELECT x.id, CASE WHEN {D.promo('x.original')} THEN 'PROMOTIONAL_INTENT' WHEN np = 0 THEN 'REFUSED' WHEN score IS NULL THEN 'ERROR' WHEN score >= 0.6 THEN 'DRAFTED' ELSE 'WEAK' END AS verdict FROM x LEFT JOIN bk USING (id)")(
    lambda s, d: rd(s, d).groupBy("id").agg(F.any_value("original").alias("original"), F.count_if("possible").alias("np")).join(Z.pick_attempt(gated(s, d), "best").select("id", "score"), "id", "left").select("id", Z.draft_verdict(F.col("score"), U.is_promotional(F.col("original")), F.col("np")).alias("verdict")))
_W9 = SQL["w9_draft_verdict"]
query("a15_regenerate_summary", f"SELECT verdict, count(*) AS n FROM ({_W9}) GROUP BY 1")(lambda s, d: QUERIES["w9_draft_verdict"](s, d).groupBy("verdict").agg(F.count(F.lit(1)).alias("n")))
PER = "per AS (SELECT id, requested_category, count(*) AS rounds, arg_min(score, round) AS first_score FROM rd GROUP BY 1, 2)"
SUMM = "SELECT requested_category, count(*) AS items, count({k}.score) AS accepted, round(avg(rounds), 4) AS mean_rounds, round(avg({k}.score - first_score), 4) AS mean_gain FROM per LEFT JOIN {k} USING (id) GROUP BY 1"
query("a13_loop_summary", f"{D.ctes('rd', GATE, CLEANED, LOOP, PER)} {SUMM.format(k='pk')}")(lambda s, d: Z.attempts_summary(rd(s, d), Z.pick_attempt(gated(s, d), "loop"), ["requested_category"]))
query("a14_recast_summary", f"{D.ctes('rd', GATE, CLEANED, BEST, PER)} {SUMM.format(k='bk')}")(lambda s, d: Z.attempts_summary(rd(s, d), Z.pick_attempt(gated(s, d), "best"), ["requested_category"]))
CONV = "cv AS (SELECT id, CASE ingest_seq % 4 WHEN 0 THEN 'CONVERTIBLE' WHEN 1 THEN 'SPLIT_RECOMMENDED' WHEN 2 THEN 'NEEDS_CONTEXT' ELSE 'IRREDUCIBLY_MARKETING' END AS verdict, CAST((ingest_seq * 17) % 500 AS DOUBLE) / 1000 AS before, score AS after, ingest_seq % 31 = 0 AS error, ingest_seq % 13 = 0 AS lost FROM rd WHERE round = 1)"


def conversions(s: SparkSession, d: str) -> DataFrame:
    n = F.col("ingest_seq")
    verdict = F.when(n % 4 == 0, "CONVERTIBLE").when(n % 4 == 1, "SPLIT_RECOMMENDED").when(n % 4 == 2, "NEEDS_CONTEXT").otherwise("IRREDUCIBLY_MARKETING")
    return rd(s, d).where("round = 1").select("id", verdict.alias("verdict"), (((n * 17) % 500).cast("double") / 1000).alias("before"), F.col("score").alias("after"), (n % 31 == 0).alias("error"), (n % 13 == 0).alias("lost"), "body")


RAT = "verdict IN ('CONVERTIBLE', 'SPLIT_RECOMMENDED') AND after >= 0.5"
query("a12_conversion_summary", f"{D.ctes('rd', CONV)} SELECT count(*) AS rows, count(*) FILTER (WHERE verdict IN ('CONVERTIBLE', 'SPLIT_RECOMMENDED')) AS rewrites, count(*) FILTER (WHERE {RAT}) AS ratified, round(count(*) FILTER (WHERE {RAT}) / count(*), 4) AS ratified_share, round(avg(after - before) FILTER (WHERE {RAT}), 4) AS mean_gain, count(*) FILTER (WHERE error) AS failures, count(*) FILTER (WHERE lost) AS lost_placeholder FROM cv")(
    lambda s, d: Z.conversion_summary(conversions(s, d)))
query("k7_conversion_outputs", f"{D.ctes('rd', CONV)} SELECT id, round(after - before, 4) AS gain FROM cv WHERE {RAT} ORDER BY gain DESC, id LIMIT 100")(
    lambda s, d: conversions(s, d).where(RAT).select("id", F.round(F.col("after") - F.col("before"), 4).alias("gain")).orderBy(F.desc("gain"), "id").limit(100))
OUTS = "ou AS (SELECT cv.id, t.name, rd.original AS before_body, rd.candidate AS after_body, CASE WHEN verdict = 'SPLIT_RECOMMENDED' THEN 'Shop now.' END AS split_off, before, after, verdict FROM cv JOIN rd ON rd.id = cv.id AND rd.round = 1 JOIN t ON t.id = cv.id)"
HALF = lambda name, body, category: f"CAST(json_object('templateName', coalesce(nullif({name}, ''), 'UTILITY_DRAFT'), 'messageBody', json_object('type', 'TEXT', 'templateCategory', '{category}', 'header', '', 'body', {body}, 'footer', '', 'buttons', CAST([] AS VARCHAR[]))) AS VARCHAR)"


def rewrites(s: SparkSession, d: str) -> DataFrame:
    texts = rd(s, d).where("round = 1").select("id", F.col("original").alias("before_body"), F.col("candidate").alias("after_body"))
    split = F.when(F.col("verdict") == "SPLIT_RECOMMENDED", "Shop now.")
    return conversions(s, d).join(texts, "id").join(fixture(s, d, T).select("id", "name"), "id").withColumn("split_off", split)


query("k7_all_conversion_outputs", f"""{D.ctes('t', 'rd', CONV, OUTS)} SELECT id, name, before_body, after_body, split_off, before, after, round(after - before, 4) AS gain, after >= 0.5 AS ratified,
 array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(before_body, '{R.PLACEHOLDER}'), lambda x: NOT list_contains(regexp_extract_all(after_body, '{R.PLACEHOLDER}'), x)))), '|') AS placeholders_lost,
 {HALF('name', 'after_body', 'UTILITY')} AS utility_json, CASE WHEN split_off IS NOT NULL THEN {HALF("ltrim(concat(name, '_PROMO'), '_')", 'split_off', 'MARKETING')} END AS split_off_json
 FROM ou WHERE verdict IN ('CONVERTIBLE', 'SPLIT_RECOMMENDED') AND after_body <> ''""")(lambda s, d: Z.conversion_outputs(rewrites(s, d)))
@query("k5_publish", f"{D.ctes('p')} SELECT recorded_category, prediction, count(*) AS n FROM p GROUP BY 1, 2")
def _publish(s: SparkSession, d: str) -> DataFrame:
    """What was published, read back: the named fields and no others."""
    report = fixture(s, d, P).groupBy("recorded_category", "prediction").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("internal_id"))
    path = f"{folder(s)}/published"
    K.publish(report, ["recorded_category", "prediction", "n"], path)
    return s.read.json(path)


@query("k6_leaked_passages", "SELECT count(*) AS leaks FROM (SELECT DISTINCT text AS s FROM documents) WHERE EXISTS (SELECT 1 FROM benchmark b WHERE length(b.text) >= 10 AND contains(s, b.text))")
def _leaked_passages(s: SparkSession, d: str) -> DataFrame:
    """Documents that hold a whole benchmark passage."""
    return K.leak_count(s.read.parquet(f"{d}/documents.parquet"), "text", s.read.parquet(f"{d}/benchmark.parquet"), "text")


@query("k6_leak_audit", f"{D.ctes('t')}, pub AS (SELECT DISTINCT status AS s FROM t UNION SELECT DISTINCT meta_category FROM t) SELECT count(*) AS leaks FROM pub WHERE EXISTS (SELECT 1 FROM t WHERE contains(s, body))")
def _leaks(s: SparkSession, d: str) -> DataFrame:
    corpus = fixture(s, d, T)
    return K.leak_count(corpus.select(F.explode(F.array("status", "meta_category")).alias("s")), "s", corpus, "body", 1)


def _rewrite_reply():
    reply = F.to_json(F.struct("possible", F.col("candidate").alias("body"), F.lit("r").alias("reason")))
    return F.when(F.col("possible"), F.concat(F.lit("Reply: "), reply)).otherwise(F.col("raw"))


REPLIED = "nullif(regexp_extract(raw, '\\{.*\\}', 0, 's'), '') AS x"
query("b3_parse_responses", f"""{D.ctes('rd')}, q AS (SELECT id, round, {REPLIED} FROM rd), f AS (SELECT id, round, x, x->>'$.category' AS category, try_cast(x->>'$.confidence' AS DOUBLE) AS confidence, json_array_length(x->'$.clauses') AS clauses, x->>'$.rationale' AS rationale FROM q),
 r AS (SELECT *, CASE WHEN x IS NULL THEN 'no_json' WHEN category IS NULL THEN 'malformed' WHEN category NOT IN ({', '.join(D.quoted(k) for k in Z.KNOWN)}) THEN 'unknown_category' WHEN confidence IS NULL OR confidence < 0 OR confidence > 1 THEN 'bad_confidence'
 WHEN clauses IS NULL OR clauses > 8 THEN 'bad_clauses' WHEN length(coalesce(rationale, '')) > 1000 THEN 'long_rationale' ELSE '' END AS reason FROM f)
 SELECT id, round, CASE WHEN reason = '' THEN category END AS category, CASE WHEN reason = '' THEN confidence END AS confidence, reason FROM r""")(
    lambda s, d: rd(s, d).select("id", "round", Z.parse_responses(F.col("raw")).alias("r")).select("id", "round", "r.reply.category", "r.reply.confidence", "r.reason"))
query("b4_parse_rewrites", f"""{D.ctes('rd')}, q AS (SELECT id, round, {REPLIED} FROM (SELECT * REPLACE (CASE WHEN possible THEN 'Reply: ' || json_object('possible', possible, 'body', candidate, 'reason', 'r') ELSE raw END AS raw) FROM rd)),
 f AS (SELECT id, round, x, try_cast(x->>'$.possible' AS BOOLEAN) AS possible, x->>'$.body' AS body FROM q),
 r AS (SELECT *, CASE WHEN x IS NULL THEN 'no_json' WHEN possible IS NULL THEN 'malformed' WHEN possible AND coalesce(length(body), 0) = 0 THEN 'no_body' WHEN length(body) > 1024 THEN 'long_body' ELSE '' END AS reason FROM f)
 SELECT id, round, CASE WHEN reason = '' THEN possible END AS possible, reason FROM r""")(
    lambda s, d: rd(s, d).select("id", "round", Z.parse_rewrites(_rewrite_reply()).alias("r")).select("id", "round", "r.reply.possible", "r.reason"))
CHAT = "c AS (SELECT u.conv_id, u.turn, sha256(concat_ws(chr(31), 'm', u.text)) AS key, a.text AS answer FROM conversations u LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user')"


def chat(s: SparkSession, d: str) -> DataFrame:
    c = s.read.parquet(f"{d}/conversations.parquet")
    nxt = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return c.where("role = 'user'").join(nxt, ["conv_id", "turn"], "left").select("conv_id", "turn", Z.cache_key(F.lit("m"), F.col("text")).alias("key"), "answer")


query("b6_cache_key", f"WITH {CHAT} SELECT conv_id, turn, key FROM c")(lambda s, d: chat(s, d).select("conv_id", "turn", "key"))
WRITTEN = "conv_id * 100000 + turn"
query("b6_cache_merge", f"WITH {CHAT} SELECT key, sha256(arg_max(answer, {WRITTEN})) AS h FROM c WHERE answer IS NOT NULL AND conv_id % 2 = 0 GROUP BY key")(
    lambda s, d: Z.cache_merge(chat(s, d).where("answer is not null and conv_id % 2 = 0").withColumn("written", F.col("conv_id") * 100000 + F.col("turn"))).select("key", F.sha2("answer", 256).alias("h")))
query("b6_cache_merge_all", f"WITH {CHAT} SELECT key, sha256(arg_max(answer, {WRITTEN})) AS h FROM c WHERE answer IS NOT NULL GROUP BY key")(
    lambda s, d: Z.cache_merge(chat(s, d).where("answer is not null").withColumn("written", F.col("conv_id") * 100000 + F.col("turn"))).select("key", F.sha2("answer", 256).alias("h")))
query("j12_cache_split", f"WITH {CHAT}, k AS (SELECT DISTINCT key FROM c WHERE answer IS NOT NULL AND conv_id % 2 = 0) SELECT conv_id, turn, k.key IS NOT NULL AS cached FROM c LEFT JOIN k USING (key)")(
    lambda s, d: (lambda prompts, cache: Z.cache_split(prompts, cache)[0].select("conv_id", "turn", F.lit(True).alias("cached")).unionByName(Z.cache_split(prompts, cache)[1].select("conv_id", "turn", F.lit(False).alias("cached"))))(chat(s, d).select("conv_id", "turn", "key"), chat(s, d).where("answer is not null and conv_id % 2 = 0").select("key", "answer", (F.col("conv_id") * 100000 + F.col("turn")).alias("written"))))
query("b8_select_candidate", f"""{D.ctes('rd', GATE)} SELECT id, round FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, round) AS n FROM g WHERE anchor AND no_promo) WHERE n = 1""")(
    lambda s, d: Z.select_candidate(gated(s, d).withColumn("eligible", F.col("g.anchor") & F.col("g.clean"))).select("id", "round"))
query("b9_accept_edit", f"{D.ctes('rd')} SELECT id, round, {D.strip('candidate')} = {D.strip('original')} AND {D.anchor('candidate')} AND NOT {D.promo('candidate')} AS ok FROM rd")(
    lambda s, d: rd(s, d).select("id", "round", Z.accept_edit(F.col("candidate"), F.regexp_replace("original", " ", "  ")).alias("ok")))
query("b10_accept_restatement", f"{D.ctes('rd', GATE)} SELECT id, round, anchor AND no_promo AND lost = 0 AND length(candidate) <= 1.1 * length(original) + 20 AND score >= 0.5 AS ok FROM g")(
    lambda s, d: rd(s, d).select("id", "round", Z.accept_restatement(F.col("original"), F.col("candidate"), F.when(F.col("score") >= 0.5, "UTILITY").otherwise("MARKETING")).alias("ok")))
query("b11_accept_draft", f"{D.ctes('rd')} SELECT id, round, {D.event_in('(' + D.purpose('original') + ')', 'candidate')} AND NOT {D.promo('candidate')} AND len(regexp_extract_all(candidate, '{R.PLACEHOLDER}')) > 0 AS ok FROM rd")(
    lambda s, d: rd(s, d).select("id", "round", Z.accept_draft(U.detect_purpose(F.col("original")), F.col("candidate")).alias("ok")))
query("b12_regeneration_targets", f"{D.ctes('t')} SELECT id, {DISTINCT('body')}::INT + 1 AS budget FROM t WHERE requested_category = 'UTILITY' AND meta_category = 'MARKETING'")(
    lambda s, d: O.cohorts(fixture(s, d, T)).where("cohort = 'downgraded'").where(X.script_of(F.col("body")).isNull()).select("id", (F.size(F.array_distinct(X.placeholders(F.col("body")))) + 1).alias("budget")))
PRE = "(VALUES " + ", ".join(f"('{k}', {D.quoted(b)})" for k, _, b, _ in Z.PRESETS) + ") AS pre(purpose, draft)"
query("p12_drafts", f"{D.ctes('t')}, x AS (SELECT id, {D.purpose('body')} AS purpose, {D.promo('body')} AS promo FROM t) SELECT id, CASE WHEN promo THEN 'REFUSED' WHEN draft IS NULL THEN 'NEEDS_CONTEXT' ELSE 'DRAFTED' END AS verdict, CASE WHEN NOT promo THEN draft END AS draft FROM x LEFT JOIN {PRE} USING (purpose)")(
    lambda s, d: Z.draft_from_presets(fixture(s, d, T)).select("id", "verdict", "draft"))
query("p13_fill_samples")(lambda s, d: fixture(s, d, T).select("id", Z.fill_samples(F.col("body")).alias("filled")))
CL = "(VALUES ('a', 'Clause A'), ('b', 'Clause B')) AS cl(code, clause)"
query("j16_explanations", f"""{D.ctes('rd')}, x AS (SELECT id, round, 'MARKETING' AS category, unnest(['a']) AS code FROM rd WHERE (ingest_seq + round) % 5 = 2 UNION ALL SELECT id, round, 'UTILITY', unnest(['a', 'b']) FROM rd WHERE (ingest_seq + round) % 5 = 4)
 SELECT x.id, round, category, category = meta_category AS agrees, code, clause FROM x JOIN (SELECT DISTINCT id, meta_category FROM rd) USING (id) LEFT JOIN {CL} USING (code)""")(
    lambda s, d: rd(s, d).select("id", "round", "meta_category", Z.parse_responses(F.col("raw")).alias("r")).where("r.reason = ''").select("id", "round", F.col("r.reply.category").alias("category"), (F.col("r.reply.category") == F.col("meta_category")).alias("agrees"), F.explode("r.reply.clauses").alias("code")).join(F.broadcast(s.createDataFrame([("a", "Clause A"), ("b", "Clause B")], "code string, clause string")), "code", "left"))
@query("s6_load_done", "SELECT CAST(user_id AS BIGINT) AS id, arg_max(event_id, event_id) AS event_id FROM events GROUP BY 1")
def _load_done(s: SparkSession, d: str) -> DataFrame:
    """A log in files whose names follow the order of the events, with a torn line beside every tenth."""
    events = s.read.parquet(f"{d}/events.parquet").select(F.col("user_id").cast("long").alias("id"), F.col("event_id").cast("long").alias("event_id"))
    line = F.to_json(F.struct("id", "event_id"))
    lines = F.when(F.col("event_id") % 10 == 0, F.array(line, F.substr(line, F.lit(1), F.length(line) - 2))).otherwise(F.array(line))
    path = f"{folder(s)}/log"
    events.repartitionByRange(8, "event_id").sortWithinPartitions("event_id").select(F.explode(lines).alias("value")).write.text(path)
    return S.load_done(s, path, "id bigint, event_id bigint")


query("b5_parse_components", f"""{D.ctes('rd')} SELECT id, round, CASE WHEN possible THEN candidate END AS body, CASE WHEN possible THEN '' ELSE 'part_not_text' END AS reason FROM rd""")(
    lambda s, d: rd(s, d).select("id", "round", Z.parse_components(F.when(F.col("possible"), F.to_json(F.struct("possible", F.col("candidate").alias("body"), F.lit("h").alias("header")))).otherwise(F.lit('{"body": ["x"], "possible": true}'))).alias("r")).select("id", "round", "r.reply.body", "r.reason"))
query("n5_button_text", f"{D.ctes('t')} SELECT id, {D.strip('buttons')} AS labels FROM t")(
    lambda s, d: fixture(s, d, T).select("id", X.button_text(F.when(F.col("buttons") == "", F.col("buttons")).otherwise(F.to_json(F.transform(F.split("buttons", "\n"), lambda b: F.struct(F.lit("URL").alias("type"), b.alias("text")))))).alias("labels")))
