"""Queries over TF-IDF indexes and cosine joins, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from missive.functions import patterns as R
from missive.operators import records as O
from missive.operators import rules as U
from missive.operators import similarity as Y
from missive.operators import splits as S
from missive.operators import vectors as V
from missive.plans import duck as D
from missive.plans.fixtures import TV, fixture
from missive.plans.metric_queries import SPANS
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


def clean(s: SparkSession, d: str) -> DataFrame:
    return O.training_families(fixture(s, d, TV))


def sides(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(downgraded, approved) clean families that asked for UTILITY."""
    rows = written(O.cohorts(clean(s, d)))
    return rows.where("cohort = 'downgraded'"), rows.where("cohort = 'approved'")


def terms_sql(name: str, src: str, text: str, kind: str) -> str:
    n = D.norm(text)
    if kind == "char":
        return f"""{name}_t AS (SELECT id, substr(w, i, n) AS term, count(*) AS tf FROM (SELECT id, ' ' || unnest(list_filter(string_split({n}, ' '), lambda w: w <> '')) || ' ' AS w FROM {src}) q,
 LATERAL (SELECT unnest(generate_series(3, least(5, length(w)))) AS n) a, LATERAL (SELECT unnest(generate_series(1, length(w) - n + 1)) AS i) b GROUP BY 1, 2)"""
    return f"""{name}_t AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(list_concat(l, list_transform(generate_series(1, len(l) - 1), lambda i: l[i] || ' ' || l[i + 1]))) AS term FROM (SELECT id, list_filter(string_split({n}, ' '), lambda w: length(w) >= 2) AS l FROM {src})) GROUP BY 1, 2)"""


def fit_sql(name: str, src: str, cap: int) -> str:
    return f"{name}_v AS (SELECT term, count(*) AS df FROM {name}_t GROUP BY term ORDER BY sum(tf) DESC, term LIMIT {cap}), {name}_n AS (SELECT count(*) AS n FROM {src})"


def weight_sql(out: str, terms: str, fit: str, sublinear: bool = False) -> str:
    tf = "(1 + ln(tf))" if sublinear else "tf"
    return f"{out} AS (SELECT id, term, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS w FROM (SELECT id, term, {tf} * (ln((1 + n) / (1 + df)) + 1) AS x FROM {terms}_t JOIN {fit}_v USING (term), {fit}_n))"


def pairs_sql(name: str, left: str, right: str, floor: float = 0.0) -> str:
    return f"{name} AS (SELECT a.id AS l, b.id AS r, round(sum(a.w * b.w), 9) AS s FROM {left} a JOIN {right} b USING (term) GROUP BY 1, 2 HAVING round(sum(a.w * b.w), 9) {'>=' if floor else '>'} {floor})"


SIDES = "dn AS (SELECT * FROM clean WHERE requested_category = 'UTILITY' AND meta_category = 'MARKETING'), ap AS (SELECT * FROM clean WHERE requested_category = 'UTILITY' AND meta_category = 'UTILITY')"
CROSS = [terms_sql("ap", "ap", "body", "char"), terms_sql("dn", "dn", "body", "char"), fit_sql("ap", "ap", 40000), weight_sql("apw", "ap", "ap"), weight_sql("dnw", "dn", "ap")]
BASE = D.ctes("tv", D.clean_cte(), SIDES, *CROSS)
DOC_TERMS = terms_sql("d", "(SELECT doc_id AS id, text FROM documents)", "text", "word")

query("m1_word_tfidf", f"{D.ctes('tv', D.clean_cte(), terms_sql('c', 'clean', D.content(), 'word'), fit_sql('c', 'clean', 25000), weight_sql('cw', 'c', 'c', True))} SELECT id, term, round(w, 6) AS w FROM cw")(
    lambda s, d: Y.Index(clean(s, d), F.concat_ws("\n", *R.COMPONENTS), Y.word_terms, Y.WORDS_CAP, True).vectors.select("id", "term", F.round("w", 6).alias("w")))
query("m2_char_tfidf", f"{D.ctes('tv', D.clean_cte(), terms_sql('c', 'clean', 'body', 'char'), fit_sql('c', 'clean', 25000), weight_sql('cw', 'c', 'c', True))} SELECT id, term, round(w, 6) AS w FROM cw")(
    lambda s, d: Y.Index(clean(s, d), F.col("body"), Y.char_terms, 25_000, True).vectors.select("id", "term", F.round("w", 6).alias("w")))
query("w11_vocabulary", f"WITH {DOC_TERMS} SELECT term, count(*) AS df FROM d_t GROUP BY term ORDER BY sum(tf) DESC, term LIMIT 8000")(
    lambda s, d: Y.word_vocabulary(s.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"), "text"), F.col("text"), 8000))


def cross(s: SparkSession, d: str, floor: float = 0.0) -> DataFrame:
    dn, ap = sides(s, d)
    index = Y.Index(ap, F.col("body"))
    return Y.cosine_pairs(index.transform(dn, F.col("body")), index.vectors, floor)


def best(s: SparkSession, d: str, k: int) -> DataFrame:
    dn, ap = sides(s, d)
    index = Y.Index(ap, F.col("body"))
    return Y.best_pairs(index.transform(dn, F.col("body")), index.vectors, k)


query("j1_cosine_pairs", f"{BASE}, {pairs_sql('pr', 'dnw', 'apw', 0.5)} SELECT l AS left_id, r AS right_id, round(s, 4) AS score FROM pr")(lambda s, d: cross(s, d, 0.5).withColumn("score", F.round("score", 4)))
CHRON = f"ch AS (SELECT family, CASE WHEN invalid THEN 'invalid' WHEN l < cutoff THEN 'train' WHEN f >= cutoff THEN 'test' ELSE 'purged' END AS side FROM sp, cut), tr AS (SELECT c.* FROM clean c JOIN ch USING (family) WHERE side = 'train'), te AS (SELECT c.* FROM clean c JOIN ch USING (family) WHERE side = 'test')"


def chron(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = clean(s, d).join(S.chronological_split(fixture(s, d, TV)), "family")
    return rows.where("side = 'train'"), rows.where("side = 'test'")


query("j2_near_duplicates", f"{D.ctes('tv', D.clean_cte(), SPANS, CHRON, terms_sql('tr', 'tr', 'body', 'char'), terms_sql('te', 'te', 'body', 'char'), fit_sql('tr', 'tr', 25000), weight_sql('trw', 'tr', 'tr'), weight_sql('tew', 'te', 'tr'), pairs_sql('pr', 'tew', 'trw', 0.9))} SELECT l AS id, round(max(s), 6) AS score FROM pr GROUP BY 1")(
    lambda s, d: Y.near_duplicates(*chron(s, d)).select("id", F.round("score", 6).alias("score")))
DOCS_BENCH = "(SELECT doc_id AS id, text AS body FROM documents)", "(SELECT item_id AS id, text AS body FROM benchmark)"
query("j2_benchmark_screen", f"WITH {terms_sql('b', DOCS_BENCH[1], 'body', 'word')}, {terms_sql('d', DOCS_BENCH[0], 'body', 'word')}, {fit_sql('b', DOCS_BENCH[1], 25000)}, {weight_sql('bw', 'b', 'b')}, {weight_sql('dw', 'd', 'b')}, {pairs_sql('pr', 'dw', 'bw', 0.5)} SELECT l AS id, round(max(s), 6) AS score FROM pr GROUP BY 1")(
    lambda s, d: (lambda docs, bench: (lambda ix: Y.nearest(Y.cosine_pairs(ix.transform(docs, F.col("body")), ix.vectors, 0.5), docs.select("id")).where("match is not null").select("id", F.round("score", 6).alias("score")))(Y.Index(bench, F.col("body"), Y.word_terms, 25_000)))(
        s.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"), F.col("text").alias("body")), s.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("id"), F.col("text").alias("body"))))
PH = lambda x: f"regexp_extract_all({x}, '{R.PLACEHOLDER}')"
query("j3_precedents", f"""{BASE}, {pairs_sql('pr', 'dnw', 'apw', 0.85)}, k AS (SELECT *, row_number() OVER (PARTITION BY l ORDER BY s DESC, r) AS rk FROM pr), f AS (SELECT l, r, s, rk, {D.norm('dn.body')} = {D.norm('ap.body')} AS same FROM k JOIN dn ON dn.id = l JOIN ap ON ap.id = r
 WHERE rk <= 5 AND len(list_filter({PH('ap.body')}, lambda x: NOT list_contains({PH('dn.body')}, x))) = 0) SELECT l AS id, r AS match, round(s, 6) AS score, rk::INT AS rank, same AS identical FROM (SELECT *, row_number() OVER (PARTITION BY l ORDER BY rk) AS n FROM f) WHERE n = 1""")(
    lambda s, d: Y.precedents(*sides(s, d)).withColumn("score", F.round("score", 6)))
query("a17_precedent_summary", f"""{BASE}, {pairs_sql('pr', 'dnw', 'apw', 0.85)}, b AS (SELECT l, max(s) AS s FROM pr GROUP BY 1) SELECT CASE WHEN s >= 0.995 THEN 'same' WHEN s >= 0.95 THEN 'close' ELSE 'near' END AS tier, count(*) AS n FROM b GROUP BY 1""")(
    lambda s, d: cross(s, d, 0.85).groupBy("left_id").agg(F.max("score").alias("s")).groupBy(F.when(F.col("s") >= Y.IDENTICAL, "same").when(F.col("s") >= 0.95, "close").otherwise("near").alias("tier")).agg(F.count(F.lit(1)).alias("n")))
POOL = "po AS (SELECT *, CASE meta_category WHEN 'UTILITY' THEN 'approved' ELSE 'downgraded' END AS cohort FROM clean WHERE requested_category = 'UTILITY'), qu AS (SELECT * FROM po)"
POOLED = D.ctes("tv", D.clean_cte(), POOL, terms_sql("po", "po", "body", "char"), terms_sql("qu", "qu", "body", "char"), fit_sql("po", "po", 40000), weight_sql("pow", "po", "po"), weight_sql("quw", "qu", "po"))
query("j4_retrieve", f"""{POOLED}, {pairs_sql('pr', 'quw', 'pow', 0.2)}, k AS (SELECT l, po.cohort, r, s, row_number() OVER (PARTITION BY l, po.cohort ORDER BY s DESC, r) AS rk FROM pr JOIN qu ON qu.id = l JOIN po ON po.id = r WHERE l <> r AND qu.body <> po.body)
 SELECT l AS id, cohort, r AS match, round(s, 6) AS score, rk::INT AS rank FROM k WHERE rk <= CASE cohort WHEN 'approved' THEN 2 ELSE 1 END""")(
    lambda s, d: (lambda pool: Y.retrieve(pool, pool).withColumn("score", F.round("score", 6)))(O.cohorts(clean(s, d))))
query("j5_nearest_approved", f"{BASE}, {pairs_sql('pr', 'dnw', 'apw')} SELECT dn.id, m.r AS match, round(coalesce(m.s, 0), 6) AS score FROM dn LEFT JOIN (SELECT l, r, s, row_number() OVER (PARTITION BY l ORDER BY s DESC, r) AS n FROM pr) m ON m.l = dn.id AND m.n = 1")(
    lambda s, d: Y.nearest(best(s, d, 1), sides(s, d)[0].select("id")).withColumn("score", F.round("score", 6)))
WORDY = [terms_sql("ap", "ap", D.content(), "word"), terms_sql("dn", "dn", D.content(), "word"), fit_sql("ap", "ap", 25000), weight_sql("apw", "ap", "ap", True), weight_sql("dnw", "dn", "ap", True)]


def word_pairs(s: SparkSession, d: str, k: int, blocked: str | None = None) -> DataFrame:
    """The k best matches of downgraded messages among approved ones, without those blocked."""
    dn, ap = sides(s, d)
    text = F.concat_ws("\n", *R.COMPONENTS)
    index = Y.Index(ap, text, Y.word_terms, Y.WORDS_CAP, True)
    return Y.best_pairs(index.transform(dn, text), index.vectors.where(f"not ({blocked})") if blocked else index.vectors, k)


W_BASE = D.ctes("tv", D.clean_cte(), SIDES, *WORDY, pairs_sql("pr", "dnw", "apw"))
query("j6_neighbors", f"{W_BASE} SELECT l AS id, r AS match, rk::INT AS rank, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY l ORDER BY s DESC, r) AS rk FROM pr) WHERE rk <= 4")(
    lambda s, d: word_pairs(s, d, 4).select(F.col("left_id").alias("id"), F.col("right_id").alias("match"), "rank", F.round("score", 6).alias("score")))
query("j7_neighbor_pool", f"{W_BASE} SELECT l AS id, r AS match, rk::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l ORDER BY s DESC, r) AS rk FROM pr WHERE CAST(r AS BIGINT) % 7 <> 0) WHERE rk <= 40")(
    lambda s, d: word_pairs(s, d, 40, "cast(id as bigint) % 7 = 0").select(F.col("left_id").alias("id"), F.col("right_id").alias("match"), "rank"))
query("f12_available", f"{D.ctes('tv', D.clean_cte(), SIDES, *WORDY)} SELECT dn.id, CASE WHEN x.id IS NULL THEN 'no_known_vocabulary' ELSE '' END AS reason FROM dn LEFT JOIN (SELECT DISTINCT id FROM dnw) x USING (id)")(
    lambda s, d: (lambda dn, ap: (lambda ix: dn.select("id").join(ix.transform(dn, F.concat_ws("\n", *R.COMPONENTS)).select("id").distinct().withColumn("k", F.lit(True)), "id", "left").select("id", F.when(F.col("k").isNull(), "no_known_vocabulary").otherwise("").alias("reason")))(Y.Index(ap, F.concat_ws("\n", *R.COMPONENTS), Y.word_terms, Y.WORDS_CAP, True)))(*sides(s, d)))
SELF = f"{pairs_sql('pr', 'pow', 'pow', 0.7)}"
query("a25_agreement_by_similarity", f"{POOLED}, {SELF} SELECT CASE WHEN s >= 0.95 THEN 0.95 WHEN s >= 0.9 THEN 0.9 WHEN s >= 0.8 THEN 0.8 ELSE 0.7 END::DOUBLE AS bucket, count(*) AS pairs, round(avg((a.cohort = b.cohort)::INT), 4) AS agreement FROM pr JOIN po a ON a.id = l JOIN po b ON b.id = r WHERE l < r GROUP BY 1")(
    lambda s, d: (lambda pool: (lambda v: Y.agreement_by_similarity(Y.cosine_pairs(v, v, 0.7).where("left_id < right_id"), pool.select("id", F.col("cohort").alias("label"))))(Y.Index(pool, F.col("body")).vectors))(O.cohorts(clean(s, d))))
query("w2_balanced_examples", f"""{POOLED}, {pairs_sql('pr', 'quw', 'pow', 0.2)}, k AS (SELECT l, r, s, po.cohort AS label, row_number() OVER (PARTITION BY l, po.cohort ORDER BY s DESC, r) AS rk FROM pr JOIN po ON po.id = r)
 SELECT l AS id, r AS match, label, round(s, 6) AS score, row_number() OVER (PARTITION BY l ORDER BY s, r DESC)::INT AS place FROM k WHERE rk <= 3""")(
    lambda s, d: (lambda pool: (lambda ix: Y.balanced_examples(Y.cosine_pairs(ix.transform(pool, F.col("body")), ix.vectors, 0.2), pool.select("id", F.col("cohort").alias("label"))).withColumn("score", F.round("score", 6)))(Y.Index(pool, F.col("body"))))(O.cohorts(clean(s, d))))


def aligned(s: SparkSession, d: str) -> DataFrame:
    """Downgraded messages, stripped of solicitation, with likeness to approved wording before and after."""
    dn, ap = sides(s, d)
    kept, dropped = U.strip_solicitation(F.col("body"))
    rows = dn.select("id", "body", kept.alias("edited"), dropped.alias("dropped"))
    index = Y.Index(ap, F.col("body"))
    before = Y.nearest(Y.best_pairs(index.transform(rows, F.col("body")), index.vectors, 1), rows.select("id")).select("id", F.round("score", 4).alias("before"))
    after = Y.nearest(Y.best_pairs(index.transform(rows, F.col("edited")), index.vectors, 1), rows.select("id")).select("id", F.round("score", 4).alias("after"))
    lost = F.size(F.array_except(F.regexp_extract_all("body", F.lit(R.PLACEHOLDER), F.lit(0)), F.regexp_extract_all("edited", F.lit(R.PLACEHOLDER), F.lit(0)))) > 0
    out = rows.join(before, "id").join(after, "id").withColumns({"gain": F.round(F.col("after") - F.col("before"), 4), "lost": lost, "anchor": U.has_anchor(F.col("edited")), "clean": ~U.is_promotional(F.col("edited"))})
    substantive = ~F.col("lost") & F.col("anchor") & F.col("clean")
    return out.withColumns({"substantive": substantive, "tier": U.tier(F.col("after"), substantive), "is_edited": F.size("dropped") > 0})


_SOL = f"(regexp_matches({D.strip('x')} || ' ', '^(?:{R.QUESTION})$') OR {D.hit('x', R.CALL_TO_ACTION)} OR {D.hit('x', R.URGENCY)} OR {D.promo('x')})"
_DROPX = rf"({_SOL} AND NOT regexp_matches(x, '\{{\{{[^}}]+\}}\}}|\d{{2,}}'))"
ALIGN = f"""ed AS (SELECT *, {D.strip(f"array_to_string(list_filter({D.sentences('body')}, lambda x: NOT {_DROPX}), ' ')")} AS edited, len(list_filter({D.sentences('body')}, lambda x: {_DROPX})) > 0 AS is_edited FROM dn),
{terms_sql('ed', 'ed', 'edited', 'char')}, {weight_sql('edw', 'ed', 'ap')}, {pairs_sql('p0', 'dnw', 'apw')}, {pairs_sql('p1', 'edw', 'apw')},
al AS (SELECT ed.id, is_edited, round(coalesce(b.s, 0), 4) AS before, round(coalesce(a.s, 0), 4) AS after, round(round(coalesce(a.s, 0), 4) - round(coalesce(b.s, 0), 4), 4) AS gain, len(list_filter({PH('body')}, lambda x: NOT list_contains({PH('edited')}, x))) > 0 AS lost, {D.anchor('edited')} AS anchor, NOT {D.promo('edited')} AS clean
 FROM ed LEFT JOIN (SELECT l, max(s) AS s FROM p0 GROUP BY 1) b ON b.l = ed.id LEFT JOIN (SELECT l, max(s) AS s FROM p1 GROUP BY 1) a ON a.l = ed.id),
al2 AS (SELECT *, NOT lost AND anchor AND clean AS substantive, CASE WHEN NOT (NOT lost AND anchor AND clean) THEN 'not-a-service-message' WHEN after >= 0.8 THEN 'precedent-backed' WHEN after >= 0.7 THEN 'precedent-adjacent' ELSE 'policy-backed' END AS tier FROM al)"""
query("p10_align", f"{BASE}, {ALIGN} SELECT id, before, after, gain, lost, anchor, clean, tier FROM al2")(lambda s, d: aligned(s, d).select("id", "before", "after", "gain", "lost", "anchor", "clean", "tier"))
query("a16_align_summary", f"""{BASE}, {ALIGN} SELECT count(*) AS downgraded, count(*) FILTER (WHERE substantive AND after >= 0.7) AS aligned, count(*) FILTER (WHERE substantive) AS converted, count(*) FILTER (WHERE is_edited) AS edited, count(*) FILTER (WHERE gain > 0) AS closer, count(*) FILTER (WHERE is_edited AND gain < 0) AS further,
 round(coalesce(sum(gain) FILTER (WHERE is_edited) / nullif(count(*) FILTER (WHERE is_edited), 0), 0), 4) AS mean_gain, count(*) FILTER (WHERE NOT anchor) AS no_anchor, count(*) FILTER (WHERE NOT clean) AS promotional, count(*) FILTER (WHERE after < 0.7) AS below FROM al2""")(
    lambda s, d: aligned(s, d).agg(F.count(F.lit(1)).alias("downgraded"), F.count_if(F.col("substantive") & (F.col("after") >= 0.7)).alias("aligned"), F.count_if("substantive").alias("converted"), F.count_if("is_edited").alias("edited"), F.count_if(F.col("gain") > 0).alias("closer"), F.count_if(F.col("is_edited") & (F.col("gain") < 0)).alias("further"),
                                     F.round(F.coalesce(F.avg(F.when(F.col("is_edited"), F.col("gain"))), F.lit(0.0)), 4).alias("mean_gain"), F.count_if(~F.col("anchor")).alias("no_anchor"), F.count_if(~F.col("clean")).alias("promotional"), F.count_if(F.col("after") < 0.7).alias("below")))
query("b2_render_precedents", f"""{POOLED}, {pairs_sql('pr', 'quw', 'pow', 0.2)}, k AS (SELECT l, po.cohort, po.body, r, s, row_number() OVER (PARTITION BY l, po.cohort ORDER BY s DESC, r) AS rk FROM pr JOIN qu ON qu.id = l JOIN po ON po.id = r WHERE l <> r AND qu.body <> po.body)
 SELECT l AS id, string_agg(concat(cohort, ': ', body), chr(10) ORDER BY cohort, rk) AS block, count(DISTINCT cohort) = 2 AS contrast FROM k WHERE rk <= CASE cohort WHEN 'approved' THEN 2 ELSE 1 END GROUP BY 1""")(
    lambda s, d: (lambda pool: Y.retrieve(pool, pool).join(pool.select(F.col("id").alias("match"), "body"), "match").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("cohort", "rank", F.concat("cohort", F.lit(": "), "body").alias("line")))).alias("x")).select("id", F.array_join("x.line", "\n").alias("block"), (F.size(F.array_distinct("x.cohort")) == 2).alias("contrast")))(O.cohorts(clean(s, d))))


def review_prompts(s: SparkSession, d: str) -> DataFrame:
    from missive.functions.text import redacted
    from missive.operators.replies import review_prompts as prompts

    pool = O.cohorts(clean(s, d))
    asked = pool
    index = Y.Index(pool, F.col("body"))
    examples = Y.balanced_examples(Y.cosine_pairs(index.transform(asked, F.col("body")), index.vectors, 0.2), pool.select("id", F.col("cohort").alias("label")))
    examples = examples.join(pool.select(F.col("id").alias("match"), "body"), "match")
    return prompts(asked, examples, redacted(F.col("body")))


query("b1_review_prompts", f"""{POOLED}, {pairs_sql('pr', 'quw', 'pow', 0.2)}, k AS (SELECT l, r, s, po.cohort AS label, po.body, row_number() OVER (PARTITION BY l, po.cohort ORDER BY s DESC, r) AS rk FROM pr JOIN po ON po.id = r),
 g AS (SELECT l, string_agg(concat(label, ': ', body), chr(10) ORDER BY s, r DESC) AS lines, count(DISTINCT label) = 2 AS both_labels FROM k WHERE rk <= 3 GROUP BY 1)
 SELECT qu.id, concat('Message:', chr(10), regexp_replace(regexp_replace(qu.body, '[\\w.+-]+@[\\w.-]+\\.[A-Za-z]{{2,}}', '[EMAIL]', 'g'), 'https?://\\S+', '[URL]', 'g'), CASE WHEN both_labels THEN concat(chr(10), 'Examples of both outcomes follow; weigh what sets them apart.') ELSE '' END, chr(10), 'Examples:', chr(10), lines) AS prompt FROM qu JOIN g ON g.l = qu.id""")(review_prompts)
LT = "fo AS (SELECT id, ingest_seq % 4 AS form FROM clean), lw AS (SELECT form, term, sum(w) AS i FROM cw JOIN fo USING (id) GROUP BY 1, 2), tw AS (SELECT term, sum(w) AS t FROM cw GROUP BY 1), fn AS (SELECT form, count(*) AS n, (SELECT count(*) FROM fo) AS m FROM fo GROUP BY 1)"
query("a19_label_terms", f"{D.ctes('tv', D.clean_cte(), terms_sql('c', 'clean', D.content(), 'word'), fit_sql('c', 'clean', 8000), weight_sql('cw', 'c', 'c'), LT)} SELECT form, term, lift, rk::INT AS rank FROM (SELECT form, term, lift, row_number() OVER (PARTITION BY form ORDER BY lift DESC, term) AS rk FROM (SELECT form, term, round(i / n - (t - i) / (m - n), 6) AS lift FROM lw JOIN tw USING (term) JOIN fn USING (form))) WHERE rk <= 5")(
    lambda s, d: V.label_terms(Y.Index(clean(s, d), F.concat_ws("\n", *R.COMPONENTS), Y.word_terms, 8000).vectors, clean(s, d).select("id", (F.col("ingest_seq") % 4).alias("form"))))
