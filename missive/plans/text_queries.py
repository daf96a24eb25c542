"""Queries over message text, records and rules, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from missive.functions import patterns as R
from missive.functions import text as X
from missive.operators import records as O
from missive.operators import rules as U
from missive.plans import duck as D
from missive.plans.fixtures import RD, TV, T, fixture

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


def t(spark: SparkSession, d: str) -> DataFrame:
    return fixture(spark, d, T)


def tv(spark: SparkSession, d: str) -> DataFrame:
    return fixture(spark, d, TV)


def docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


query("n2_category", f"{D.ctes('t')} SELECT id, CASE WHEN upper(meta_category) IN ('MARKETING','UTILITY','AUTHENTICATION') THEN upper(meta_category) ELSE 'UNKNOWN' END AS category FROM t")(
    lambda s, d: t(s, d).select("id", X.category(F.col("meta_category")).alias("category")))
query("n3_timestamp_text", f"""{D.ctes('t')} SELECT id, created_at AS ts FROM t""")(
    lambda s, d: t(s, d).select("id", X.timestamp_text(F.when(F.col("ingest_seq") % 2 == 0, F.concat(F.lit('{"$date": "'), "created_at", F.lit('"}'))).otherwise(F.col("created_at"))).alias("ts")))
query("n6_record_content", f"{D.ctes('t')} SELECT id, {D.content()} AS content FROM t")(
    lambda s, d: t(s, d).select("id", X.record_content().alias("content")))
query("n7_normalized_content", f"SELECT doc_id, sha256({D.norm('text')}) AS h, CAST(length({D.norm('text')}) AS BIGINT) AS n FROM documents")(
    lambda s, d: docs(s, d).select("doc_id", X.normalized_content(F.col("text")).alias("x")).select("doc_id", F.sha2("x", 256).alias("h"), F.length("x").cast("long").alias("n")))
query("n7_normalized_messages", f"{D.ctes('t')} SELECT id, {D.norm(D.content())} AS content FROM t")(
    lambda s, d: t(s, d).select("id", X.normalized_content(X.record_content()).alias("content")))

_FEATURES = f"""{D.count('body', r'\{\{.*?\}\}')}::DOUBLE AS placeholder_count, len(list_distinct(regexp_extract_all(body, '\\{{\\{{.*?\\}}\\}}')))::DOUBLE AS distinct_placeholders,
 len({D.buttons('buttons')})::DOUBLE AS button_count, (header <> '')::INT::DOUBLE AS has_header, (footer <> '')::INT::DOUBLE AS has_footer, length(body)::DOUBLE AS body_length,
 {D.count('body', '[' + chr(0x2600) + '-' + chr(0x10FFFF) + ']')}::DOUBLE AS emoji_count, {D.count('body', '!')}::DOUBLE AS exclamation_count, {D.count('body', '[%$₹€£]')}::DOUBLE AS symbol_count,
 round(coalesce({D.count('body', r'\p{Lu}')} / nullif({D.count('body', r'\p{L}')}, 0), 0), 6) AS uppercase_ratio, {D.count('body', r'\p{Nd}+')}::DOUBLE AS number_count, {D.count('body', r'https?://\S+|www\.\S+')}::DOUBLE AS url_count"""
_FEATURE_NAMES = ["placeholder_count", "distinct_placeholders", "button_count", "has_header", "has_footer", "body_length", "emoji_count", "exclamation_count", "symbol_count", "number_count", "url_count"]
query("n8_structural_features", f"{D.ctes('t')} SELECT id, {_FEATURES} FROM t")(
    lambda s, d: X.structural_features(t(s, d)).select("id", *_FEATURE_NAMES, F.round("uppercase_ratio", 6).alias("uppercase_ratio")))
query("n9_family_key", f"{D.ctes('t')} SELECT id, {D.family()} AS family FROM t")(
    lambda s, d: t(s, d).select("id", X.family_key().alias("family")))
query("n12_length_guard", "SELECT doc_id, length(text) <= 20000 AS accepted FROM documents")(
    lambda s, d: docs(s, d).select("doc_id", (F.length("text") <= O.MAX_BODY).alias("accepted")))
query("n14_content_hash", f"{D.ctes('t')} SELECT id, substr(sha256({D.content()}), 1, 16) AS h FROM t")(
    lambda s, d: t(s, d).select("id", X.content_hash().alias("h")))
query("n15_redaction", rf"SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '[\w.+-]+@[\w.-]+\.[A-Za-z]{{2,}}', '[EMAIL]', 'g'), 'https?://\S+', '[URL]', 'g')) AS h FROM documents")(
    lambda s, d: docs(s, d).select("doc_id", F.sha2(F.regexp_replace(F.regexp_replace("text", R.EMAIL, "[EMAIL]"), R.LINK, "[URL]"), 256).alias("h")))
query("n15_redacted_numbers")(lambda s, d: docs(s, d).select("doc_id", X.redacted(F.col("text")).alias("text")))
_SCRIPT = "".join(f"WHEN {D.count('text', f'[{chr(a)}-{chr(b)}]')} > 0 AND greatest({', '.join(D.count('text', f'[{chr(x)}-{chr(y)}]') for x, y in R.SCRIPTS.values())}) = {D.count('text', f'[{chr(a)}-{chr(b)}]')} THEN '{k}' " for k, (a, b) in R.SCRIPTS.items())
query("n16_script", f"SELECT doc_id, CASE {_SCRIPT} END AS script FROM documents")(
    lambda s, d: docs(s, d).select("doc_id", X.script_of(F.col("text")).alias("script")))
query("n17_placeholders", rf"{D.ctes('rd')} SELECT id, round, array_to_string(regexp_extract_all(original, '{R.PLACEHOLDER}'), '|') AS found, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(original, '{R.PLACEHOLDER}'), lambda x: NOT list_contains(regexp_extract_all(candidate, '{R.PLACEHOLDER}'), x)))), '|') AS lost FROM rd")(
    lambda s, d: fixture(s, d, RD).select("id", "round", F.array_join(X.placeholders(F.col("original")), "|").alias("found"), F.array_join(X.lost_placeholders(F.col("original"), F.col("candidate")), "|").alias("lost")))
query("n18_sentences", f"SELECT doc_id, CAST(len({D.sentences('text')}) AS BIGINT) AS n, sha256(array_to_string({D.sentences('text')}, '|')) AS h FROM documents")(
    lambda s, d: docs(s, d).select("doc_id", X.sentences(F.col("text")).alias("x")).select("doc_id", F.size("x").cast("long").alias("n"), F.sha2(F.array_join("x", "|"), 256).alias("h")))
query("n19_fragments", f"{D.ctes('t')} " + " UNION ALL ".join(f"SELECT id, '{c}' AS component, CAST(i - 1 AS BIGINT) AS place, l[i] AS fragment FROM (SELECT id, {D.parts(c)} AS l FROM t), LATERAL (SELECT unnest(generate_series(1, len(l))) AS i)" for c in R.COMPONENTS))(
    lambda s, d: X.fragments(t(s, d)).select("id", "component", F.col("place").cast("long").alias("place"), "fragment"))
query("n20_date_value", f"{D.ctes('tv')} SELECT ingest_seq, CAST(epoch(try_cast(replace(created_at, 'Z', '+00:00') AS TIMESTAMPTZ)) AS BIGINT) AS at FROM tv")(
    lambda s, d: tv(s, d).select("ingest_seq", F.unix_timestamp(X.date_value(F.col("created_at"))).alias("at")))
query("n21_english_supported", f"SELECT doc_id, {D.english('text')} AS english FROM documents")(
    lambda s, d: docs(s, d).select("doc_id", X.english_supported(F.col("text")).alias("english")))
query("n1_as_text", f"{D.ctes('t')} SELECT id, {D.strip('body')} AS a, coalesce(CAST(monthly_volume AS VARCHAR), '') = '' AS blank FROM t")(
    lambda s, d: t(s, d).select("id", X.as_text(F.col("body")).alias("a"), (X.as_text(F.col("monthly_volume")) == "").alias("blank")))

query("f1_candidates", f"{D.ctes('tv')} SELECT ingest_seq FROM tv WHERE {D.CANDIDATE}")(lambda s, d: O.candidates(tv(s, d)).select("ingest_seq"))
query("f2_cohorts", f"{D.ctes('t')} SELECT id, CASE meta_category WHEN 'UTILITY' THEN 'approved' ELSE 'downgraded' END AS cohort FROM t WHERE requested_category = 'UTILITY' AND meta_category IN ('UTILITY', 'MARKETING')")(
    lambda s, d: O.cohorts(t(s, d)).select("id", "cohort"))
query("f3_mismatch", f"{D.ctes('t')} SELECT id FROM t WHERE requested_category = 'UTILITY' AND meta_category = 'MARKETING'")(lambda s, d: t(s, d).where(O.is_mismatch()).select("id"))
query("f4_browse", f"{D.ctes('t')}, f AS (SELECT *, count(*) OVER () AS total FROM t WHERE contains(lower(concat_ws(chr(1), name, header, body, footer, buttons)), 'invoice') AND meta_category = 'MARKETING' AND status = 'VERIFIED') SELECT id, total FROM f ORDER BY ingest_seq DESC LIMIT 10 OFFSET 10")(
    lambda s, d: O.browse(t(s, d), "Invoice", "MARKETING", "VERIFIED", page=2).select("id", "total"))
query("f5_lookup", f"{D.ctes('t')} SELECT id, name, body FROM t WHERE id = '42'")(lambda s, d: O.lookup(t(s, d), "42").select("id", "name", "body"))
query("f6_vocabulary_tests", f"{D.ctes('t')} SELECT id, {D.hit('body', R.TRANSACTION)} AS tr, {D.hit('body', R.REFERENCE)} AS ref, {D.hit(D.content(), R.AUTHENTICATION)} AS auth FROM t")(
    lambda s, d: t(s, d).select("id", U.has_transaction(F.col("body")).alias("tr"), U.has_reference(F.col("body")).alias("ref"), U.is_authentication(X.record_content()).alias("auth")))
query("f7_anchor", f"{D.ctes('t')} SELECT id, {D.anchor('body')} AS anchor FROM t")(lambda s, d: t(s, d).select("id", U.has_anchor(F.col("body")).alias("anchor")))
query("f8_service_message", f"{D.ctes('t')} SELECT id FROM t WHERE {D.anchor('body')} AND NOT {D.promo('body')}")(lambda s, d: t(s, d).where(U.is_service_message()).select("id"))
_SOLICIT = lambda x: f"(regexp_matches({D.strip(x)} || ' ', '^(?:{R.QUESTION})$') OR {D.hit(x, R.CALL_TO_ACTION)} OR {D.hit(x, R.URGENCY)} OR {D.promo(x)})"
query("f9_solicitation", f"{D.ctes('t')} SELECT id, x AS fragment, {_SOLICIT('x')} AS solicits FROM (SELECT id, unnest({D.sentences('body')}) AS x FROM t)")(
    lambda s, d: t(s, d).select("id", F.explode(X.sentences(F.col("body"))).alias("fragment")).withColumn("solicits", U.is_solicitation(F.col("fragment"))))
query("f10_eligible", f"{D.ctes('rd')} SELECT id, round, {D.strip('candidate')} <> '' AND {D.anchor('candidate')} AND NOT ({D.promo('candidate')} OR {D.promo('header')} OR {D.promo('footer')} OR {D.promo('buttons')}) AND (({D.purpose('original')}) = 'unknown' OR {D.event_in('(' + D.purpose('original') + ')', 'candidate')}) AS eligible FROM rd")(
    lambda s, d: fixture(s, d, RD).select("id", "round", U.eligible(F.col("candidate"), [F.col(c) for c in ("candidate", "header", "footer", "buttons")], U.detect_purpose(F.col("original"))).alias("eligible")))
query("f13_compatible", f"{D.ctes('rd')} SELECT id, round, len(list_filter(regexp_extract_all(original, '{R.PLACEHOLDER}'), lambda x: NOT list_contains(regexp_extract_all(candidate, '{R.PLACEHOLDER}'), x))) = 0 AS compatible FROM rd")(
    lambda s, d: fixture(s, d, RD).select("id", "round", (F.size(X.lost_placeholders(F.col("original"), F.col("candidate"))) == 0).alias("compatible")))

_CLEAN = f"{D.ctes('tv', D.clean_cte())}"
query("a2_training_families", f"{_CLEAN} SELECT family, id, ingest_seq, meta_category, requested_category, body FROM clean")(
    lambda s, d: O.training_families(tv(s, d)).select("family", "id", "ingest_seq", "meta_category", "requested_category", "body"))
query("a2_conflicts", f"{_CLEAN} SELECT family, count(*) AS n FROM cand GROUP BY family HAVING count(DISTINCT meta_category) > 1")(lambda s, d: O.conflicting_families(tv(s, d)))
_FIELDS = ["meta_category", "requested_category", "status", "format", "language"]
query("a1_summary_counts", f"{D.ctes('tv')} " + " UNION ALL ".join(f"SELECT '{f}' AS field, coalesce(nullif({f}, ''), 'UNKNOWN') AS value, count(*) AS n FROM tv GROUP BY 2" for f in _FIELDS))(lambda s, d: O.summary_counts(tv(s, d)))
query("a1_summary_totals", f"""{D.ctes('tv')}, r AS (SELECT *, {D.family()} AS family, {D.CANDIDATE} AS c FROM tv),
f AS (SELECT family, count(*) AS n, count(*) FILTER (WHERE c) AS nc, count(DISTINCT meta_category) FILTER (WHERE c) AS labels, count(*) FILTER (WHERE requested_category = 'UTILITY' AND meta_category = 'MARKETING') AS mm, count(*) FILTER (WHERE {D.strip('body')} = '') AS blank FROM r GROUP BY family)
SELECT CAST(sum(n) AS BIGINT) AS total, CAST(sum(mm) AS BIGINT) AS category_mismatches, count(*) AS families, CAST(sum(n - 1) AS BIGINT) AS duplicate_records, count(*) FILTER (WHERE labels > 1) AS conflicting_families,
 CAST(coalesce(sum(nc) FILTER (WHERE labels > 1), 0) AS BIGINT) AS conflicting_records, CAST(sum(nc) AS BIGINT) AS candidate_records, count(*) FILTER (WHERE labels = 1) AS training_families, CAST(sum(blank) AS BIGINT) AS missing_bodies FROM f""")(lambda s, d: O.summary_totals(tv(s, d)))
query("w1_latest_per_family", f"{D.ctes('tv')} SELECT family, ingest_seq FROM (SELECT {D.family()} AS family, ingest_seq, row_number() OVER (PARTITION BY {D.family()} ORDER BY coalesce(nullif(updated_at, ''), created_at) DESC, ingest_seq DESC) AS rn FROM tv) WHERE rn = 1")(
    lambda s, d: O.latest_per_family(O.with_family(tv(s, d))).select("family", "ingest_seq"))
_COHORT = "CASE meta_category WHEN 'UTILITY' THEN 'approved' ELSE 'downgraded' END"
query("w13_pool_sizes", f"{_CLEAN} SELECT cohort, records, coalesce(clean_families, 0) AS clean_families FROM (SELECT {_COHORT} AS cohort, count(*) AS records FROM cand WHERE requested_category = 'UTILITY' GROUP BY 1) LEFT JOIN (SELECT {_COHORT} AS cohort, count(*) AS clean_families FROM clean WHERE requested_category = 'UTILITY' GROUP BY 1) USING (cohort)")(lambda s, d: O.pool_sizes(tv(s, d)))
_REV = lambda x: f"SELECT sha256(string_agg(h, '' ORDER BY h)) AS revision FROM (SELECT sha256(string_agg(h, '' ORDER BY h)) AS h FROM (SELECT sha256({x}) AS h FROM t) GROUP BY substr(h, 1, 2))"
query("l1_revision", f"{D.ctes('t')} {_REV('id')}")(lambda s, d: O.revision(t(s, d), digits=2))
_PRINT = ["id", "header", "body", "footer", "buttons", "meta_category", "requested_category", "created_at"]
query("l2_fingerprint", f"{D.ctes('t')} {_REV('sha256(concat_ws(chr(31), ' + ', '.join(_PRINT) + '))')}")(lambda s, d: O.fingerprint(t(s, d), _PRINT, digits=2))
query("l4_snapshot_id", f"{D.ctes('t')} SELECT sha256(revision || '2026-01-01T00:00:00Z') AS snapshot FROM ({_REV('id')})")(
    lambda s, d: O.revision(t(s, d), digits=2).select(F.sha2(F.concat("revision", F.lit("2026-01-01T00:00:00Z")), 256).alias("snapshot")))
query("k1_import", f"{D.ctes('tv')} SELECT count(DISTINCT id) FILTER (WHERE NOT old) AS added, count(*) - count(DISTINCT id) FILTER (WHERE NOT old) AS present FROM (SELECT id, CAST(id AS BIGINT) % 4 = 0 AS old FROM tv)")(
    lambda s, d: O.import_records(tv(s, d), t(s, d).where("ingest_seq % 4 = 0"))[1])
query("k2_export_cells", f"{D.ctes('t')} SELECT id, CASE WHEN regexp_matches(ltrim(cell), '^[=+\\-@]') THEN '''' || cell ELSE cell END AS cell FROM (SELECT id, CASE CAST(id AS BIGINT) % 3 WHEN 0 THEN '=1+1' WHEN 1 THEN ' @x' ELSE body END AS cell FROM t)")(
    lambda s, d: t(s, d).select("id", U.safe_cell(F.when(F.col("ingest_seq") % 3 == 0, "=1+1").when(F.col("ingest_seq") % 3 == 1, " @x").otherwise(F.col("body"))).alias("cell")))
query("k4_template_json", f"{D.ctes('t')} SELECT id, CAST(json_object('templateName', name, 'messageBody', json_object('type', 'TEXT', 'templateCategory', 'UTILITY', 'header', header, 'body', body, 'footer', footer, 'buttons', {D.buttons('buttons')})) AS VARCHAR) AS j FROM t")(
    lambda s, d: t(s, d).select("id", U.template_json().alias("j")))

_CONF = "(ingest_seq % 4 <> 0)"
_PUR = f"({D.purpose('body')})"


def confirmed():
    return F.col("ingest_seq") % 4 != 0


def purpose():
    return U.detect_purpose(F.col("body"))


query("p1_findings", f"{D.ctes('t')} " + " UNION ALL ".join(f"SELECT id, '{c}' AS component, '{k}' AS code, regexp_extract({c}, {D.quoted('(?i)' + p)}) AS evidence FROM t WHERE {D.hit(c, p)}" for c in R.COMPONENTS for k, p in R.PROMOTIONS.items()))(lambda s, d: U.promotion_findings(t(s, d)))
query("p2_purpose", f"{D.ctes('t')} SELECT id, {_PUR} AS purpose FROM t")(lambda s, d: t(s, d).select("id", purpose().alias("purpose")))
query("p3_assess", f"{D.ctes('t')} SELECT id, {D.assess(_PUR, _CONF)} AS verdict FROM t")(lambda s, d: t(s, d).select("id", U.assess(purpose(), confirmed()).alias("verdict")))
query("p4_missing_context", f"""{D.ctes('t')} SELECT id, concat_ws('|', CASE WHEN NOT {_CONF} THEN 'relationship' END, CASE WHEN {_PUR} = 'unknown' THEN 'event' END,
 CASE WHEN {_PUR} <> 'unknown' AND NOT {D.event_in(_PUR, 'body')} THEN 'event_not_in_body' END, CASE WHEN {_PUR} NOT IN ('unknown', 'critical') AND NOT {D.hit('body', R.REFERENCE)} THEN 'reference' END) AS missing FROM t""")(
    lambda s, d: t(s, d).select("id", F.array_join(U.missing_context(purpose(), confirmed()), "|").alias("missing")))


def _edited(c: str, keep: str) -> str:
    return D.strip(f"array_to_string(list_filter({D.parts(c)}, lambda x: {keep}), {'chr(10)' if c == 'buttons' else chr(39) + ' ' + chr(39)})")


_TANGLED = " OR ".join(f"len(list_filter({D.parts(c)}, lambda x: {D.promo('x')} AND {D.hit('x', R.TRANSACTION)})) > 0" for c in R.COMPONENTS)
query("p5_limited_rewrite", f"""{D.ctes('t')}, e AS (SELECT *, {_PUR} AS purpose, {D.assess(_PUR, _CONF)} AS verdict, {', '.join(f'{_edited(c, "NOT " + D.promo("x"))} AS edited_{c}' for c in R.COMPONENTS)}, ({_TANGLED}) AS tangled FROM t)
SELECT id, edited_body, edited_buttons, verdict = 'LIKELY_MARKETING' AND {D.event_in('purpose', 'body')} AND {_CONF} AND (purpose = 'critical' OR {D.hit('body', R.REFERENCE)}) AND NOT tangled AND edited_body <> '' AND {D.event_in('purpose', 'edited_body')} AS available FROM e""")(
    lambda s, d: U.limited_rewrite(t(s, d), purpose(), confirmed()).select("id", "edited_body", "edited_buttons", "available"))
_AMB = lambda x: f"({D.promo(x)} AND (regexp_matches({x}, '{R.PLACEHOLDER}') OR ({D.hit(x, R.TRANSACTION)} AND NOT {D.hit(x, R.NEXT_PURCHASE)})))"
_SPLIT = f"""{', '.join(f'{_edited(c, "NOT " + D.promo("x") + " OR " + _AMB("x"))} AS kept_{c}' for c in R.COMPONENTS)},
 list_concat({', '.join(f'list_filter({D.parts(c)}, lambda x: {D.promo("x")} AND NOT {_AMB("x")})' for c in R.COMPONENTS)}) AS removed,
 list_concat({', '.join(f'list_filter({D.parts(c)}, lambda x: {_AMB("x")})' for c in R.COMPONENTS)}) AS ambiguous"""
query("p6_split_promotional", f"{D.ctes('t')}, e AS (SELECT id, {_SPLIT} FROM t) SELECT id, kept_body, kept_buttons, array_to_string(removed, '|') AS removed, array_to_string(ambiguous, '|') AS ambiguous FROM e")(
    lambda s, d: U.split_promotional(t(s, d)).select("id", "kept_body", "kept_buttons", F.array_join("removed", "|").alias("removed"), F.array_join("ambiguous", "|").alias("ambiguous")))
_BEFORE, _AFTER = "(CASE WHEN (ingest_seq * 37) % 1000 >= 500 THEN 'UTILITY' ELSE 'MARKETING' END)", "(CASE WHEN (ingest_seq * 53) % 1000 >= 300 THEN 'UTILITY' ELSE 'MARKETING' END)"
_DOWN = "(requested_category = 'UTILITY' AND meta_category = 'MARKETING')"
_KEPT = D.content("kept_")
_KP = f"({D.purpose('kept_body')})"
_KEPT_OK = f"(NOT {D.any_found('kept_')} AND {D.event_in(_KP, 'kept_body')} AND {_CONF} AND ({_KP} = 'critical' OR {D.hit('kept_body', R.REFERENCE)}) AND NOT {D.hit(_KEPT, R.AUTHENTICATION)} AND {D.english(_KEPT)})"
query("p7_convert", f"""{D.ctes('t')}, e AS (SELECT *, {_SPLIT}, {_PUR} AS purpose, {D.assess(_PUR, _CONF)} AS chk, {D.any_found()} AS found FROM t),
m AS (SELECT *, (NOT {_CONF} OR purpose = 'unknown' OR (purpose <> 'unknown' AND NOT {D.event_in('purpose', 'body')}) OR (purpose NOT IN ('unknown', 'critical') AND NOT {D.hit('body', R.REFERENCE)})) AS missing,
  len(list_filter(regexp_extract_all({D.content()}, '{R.PLACEHOLDER}'), lambda x: NOT list_contains(regexp_extract_all({_KEPT} || ' ' || array_to_string(removed, ' '), '{R.PLACEHOLDER}'), x))) > 0 AS vanished FROM e)
SELECT id, CASE WHEN chk = 'AUTHENTICATION' THEN 'AUTHENTICATION' WHEN chk = 'NEEDS_REVIEW' THEN 'NEEDS_CONTEXT'
 WHEN NOT found AND chk = 'UTILITY_CANDIDATE' THEN CASE WHEN {_DOWN} THEN 'NEEDS_CONTEXT' ELSE 'ALREADY_UTILITY' END
 WHEN NOT {D.anchor('body')} THEN 'IRREDUCIBLY_MARKETING' WHEN missing THEN 'NEEDS_CONTEXT' WHEN len(ambiguous) > 0 THEN 'NEEDS_CONTEXT'
 WHEN kept_body = '' OR NOT {D.anchor('kept_body')} THEN 'IRREDUCIBLY_MARKETING' WHEN NOT {_KEPT_OK} THEN 'NEEDS_CONTEXT' WHEN {_AFTER} = 'MARKETING' THEN 'NEEDS_CONTEXT' WHEN vanished THEN 'NEEDS_CONTEXT'
 WHEN len(removed) > 0 THEN 'SPLIT_RECOMMENDED' ELSE 'CONVERTIBLE' END AS verdict,
 NOT found AND chk = 'UTILITY_CANDIDATE' AND {_DOWN} AS disputed_by_record, NOT found AND chk = 'UTILITY_CANDIDATE' AND NOT {_DOWN} AND {_BEFORE} = 'MARKETING' AS disputed_by_model FROM m""")(
    lambda s, d: U.convert(t(s, d), confirmed(), O.is_mismatch(), F.when((F.col("ingest_seq") * 37) % 1000 >= 500, "UTILITY").otherwise("MARKETING"), F.when((F.col("ingest_seq") * 53) % 1000 >= 300, "UTILITY").otherwise("MARKETING")).select("id", "verdict", "disputed_by_record", "disputed_by_model"))
_DROP = lambda x: f"({_SOLICIT(x)} AND NOT regexp_matches({x}, '\\{{\\{{[^}}]+\\}}\\}}|\\d{{2,}}'))"
query("p9_strip_solicitation", f"{D.ctes('t')} SELECT id, {D.strip(f'array_to_string(list_filter({D.sentences("body")}, lambda x: NOT {_DROP("x")}), {chr(39)} {chr(39)})')} AS kept, array_to_string(list_filter({D.sentences('body')}, lambda x: {_DROP('x')}), '|') AS dropped FROM t")(
    lambda s, d: t(s, d).select("id", U.strip_solicitation(F.col("body"))[0].alias("kept"), F.array_join(U.strip_solicitation(F.col("body"))[1], "|").alias("dropped")))
_RATES = {"reference": r"\{\{[^}]+\}\}", "today": r"\btoday\b", "shipped": "has shipped", "explore": "explore our"}
query("a24_pattern_rates", f"{D.ctes('t')} " + " UNION ALL ".join(f"SELECT {_COHORT} AS cohort, '{k}' AS pattern, count(*) AS n, round(avg({D.hit('body', p)}::INT), 4) AS share FROM t WHERE requested_category = 'UTILITY' AND meta_category IN ('UTILITY', 'MARKETING') GROUP BY 1" for k, p in _RATES.items()))(
    lambda s, d: U.pattern_rates(O.cohorts(t(s, d)), _RATES))
