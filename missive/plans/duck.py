"""Pieces of DuckDB SQL that the oracles share."""

from __future__ import annotations

from missive.functions import patterns as R
from missive.plans.fixtures import P, RD, TV, T

#: Message records, versions, predictions and attempts as common table expressions.
WITH = {"t": f"t AS ({T})", "tv": f"tv AS ({TV})", "p": f"p AS ({P})", "rd": f"rd AS ({RD})"}


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def ctes(*names: str) -> str:
    return "WITH " + ", ".join(WITH.get(n, n) for n in names)


def norm(x: str) -> str:
    x = rf"regexp_replace(lower({x}), '\{{\{{.*?\}}\}}', ' variable ', 'g')"
    x = rf"regexp_replace({x}, 'https?://\S+|www\.\S+', ' url ', 'g')"
    x = rf"regexp_replace({x}, '\b[\w.+-]+@[\w.-]+\.[a-z]+\b', ' email ', 'g')"
    x = rf"regexp_replace({x}, '\p{{Nd}}+', ' number ', 'g')"
    return rf"array_to_string(regexp_extract_all({x}, '[\p{{L}}\p{{N}}_]+'), ' ')"


def content(a: str = "") -> str:
    return " || chr(10) || ".join(f"coalesce({a}{c}, '')" for c in R.COMPONENTS)


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def family(a: str = "") -> str:
    return f"substr(sha256(coalesce(nullif({norm(content(a))}, ''), {norm(f'coalesce({a}body, {chr(39)}{chr(39)})')})), 1, 24)"


def hit(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {quoted('(?i)' + pattern)})"


def promo(x: str) -> str:
    return hit(x, R.ANY_PROMOTION)


def anchor(x: str) -> str:
    return f"({hit(x, R.TRANSACTION)} AND {hit(x, R.REFERENCE)})"


def count(x: str, pattern: str) -> str:
    return f"CAST(len(regexp_extract_all({x}, {quoted(pattern)})) AS BIGINT)"


def sentences(x: str) -> str:
    return rf"list_filter(string_split_regex(regexp_replace({x}, '([.!?])\s+', '\1␞', 'g'), '␞|\n+'), lambda s: {strip('s')} <> '')"


def buttons(x: str) -> str:
    return f"list_filter(string_split({x}, chr(10)), lambda s: {strip('s')} <> '')"


def parts(component: str, a: str = "") -> str:
    return buttons(a + component) if component == "buttons" else sentences(a + component)


def purpose(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {hit(x, p)} THEN '{e}'" for e, p in R.EVENTS.items()) + " ELSE 'unknown' END"


def event_in(pur: str, x: str) -> str:
    return "(" + " OR ".join(f"({pur} = '{e}' AND {hit(x, p)})" for e, p in R.EVENTS.items()) + ")"


def english(x: str) -> str:
    letters, ascii_ = count(x, r"\p{L}"), count(x, "[A-Za-z]")
    return f"({letters} = 0 OR ({letters} - {ascii_}) / {letters} < 0.15)"


def any_found(a: str = "") -> str:
    return "(" + " OR ".join(promo(a + c) for c in R.COMPONENTS) + ")"


CANDIDATE = f"(status IN ('VERIFIED', 'APPROVED', 'ACTIVE') AND format = 'TEXT' AND meta_category IN ('MARKETING', 'UTILITY') AND length({strip('body')}) >= 10)"


def clean_cte(src: str = "tv") -> str:
    """Candidates by family (cand), and the newest record of each conflict-free one (clean)."""
    return f"""cand AS (SELECT *, {family()} AS family FROM {src} WHERE {CANDIDATE}),
clean AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY coalesce(nullif(updated_at, ''), created_at) DESC, ingest_seq DESC) AS rn,
    count(DISTINCT meta_category) OVER (PARTITION BY family) AS labels FROM cand) WHERE rn = 1 AND labels = 1)"""


def assess(pur: str, conf: str, a: str = "") -> str:
    b = f"{a}body"
    grounded = f"({event_in(pur, b)} AND {conf} AND ({pur} = 'critical' OR {hit(b, R.REFERENCE)}))"
    return f"""CASE WHEN NOT ({a}format = 'TEXT' AND {english(content(a))}) THEN 'NEEDS_REVIEW' WHEN {hit(content(a), R.AUTHENTICATION)} THEN 'AUTHENTICATION'
      WHEN {any_found(a)} THEN 'LIKELY_MARKETING' WHEN {grounded} THEN 'UTILITY_CANDIDATE' ELSE 'NEEDS_REVIEW' END"""
