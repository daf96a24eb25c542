"""The message rules: findings, events, verdicts, edits and conversion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from missive.functions import patterns as R
from missive.functions.text import english_supported, fragments_of, placeholders, record_content, sentences, stripped


def hits(c: Column, pattern: str) -> Column:
    return c.rlike(f"(?i){pattern}")


def is_promotional(c: Column) -> Column:
    return hits(c, R.ANY_PROMOTION)


def findings() -> Column:
    """Array of (code, component, evidence): the first match of each rule in each component."""
    found = []
    for component in R.COMPONENTS:
        c = F.coalesce(F.col(component), F.lit(""))
        rows = [F.when(hits(c, p), F.struct(F.lit(code).alias("code"), F.lit(component).alias("component"), F.regexp_extract(c, f"(?i)({p})", 1).alias("evidence"), F.lit("warning").alias("severity"))) for code, p in R.PROMOTIONS.items()]
        found.append(F.when(is_promotional(c), F.array(*rows)).otherwise(F.array().cast("array<struct<code:string,component:string,evidence:string,severity:string>>")))
    return F.filter(F.flatten(F.array(*found)), lambda x: x.isNotNull())


def promotion_findings(df: DataFrame) -> DataFrame:
    return df.select("id", F.explode(findings()).alias("f")).select("id", "f.component", "f.code", "f.evidence")


def has_finding() -> Column:
    return reduce(lambda a, b: a | b, [is_promotional(F.coalesce(F.col(c), F.lit(""))) for c in R.COMPONENTS])


def detect_purpose(c: Column) -> Column:
    """The first event whose pattern is found, else unknown."""
    out = F.lit("unknown")
    for event, pattern in reversed(R.EVENTS.items()):
        out = F.when(hits(c, pattern), event).otherwise(out)
    return out


def event_in(purpose: Column, c: Column) -> Column:
    return reduce(lambda a, b: a | b, [(purpose == event) & hits(c, pattern) for event, pattern in R.EVENTS.items()])


def has_transaction(c: Column) -> Column:
    return hits(c, R.TRANSACTION)


def has_reference(c: Column) -> Column:
    return hits(c, R.REFERENCE)


def is_authentication(c: Column) -> Column:
    return hits(c, R.AUTHENTICATION)


def has_anchor(c: Column) -> Column:
    return has_transaction(c) & has_reference(c)


def is_service_message() -> Column:
    return has_anchor(F.col("body")) & ~is_promotional(F.col("body"))


def missing_context(purpose: Column, confirmed: Column) -> Column:
    known = purpose.isin(list(R.EVENTS))
    stated = event_in(purpose, F.col("body"))
    items = [
        F.when(~confirmed, "relationship"), F.when(~known, "event"), F.when(known & ~stated, "event_not_in_body"),
        F.when(known & (purpose != "critical") & ~has_reference(F.col("body")), "reference"),
    ]
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def assess(purpose: Column, confirmed: Column) -> Column:
    """Checklist verdict."""
    full = record_content()
    grounded = event_in(purpose, F.col("body")) & confirmed & ((purpose == "critical") | has_reference(F.col("body")))
    supported = (F.col("format") == "TEXT") & english_supported(full)
    return (F.when(~supported, "NEEDS_REVIEW").when(is_authentication(full), "AUTHENTICATION").when(has_finding(), "LIKELY_MARKETING")
            .when(grounded, "UTILITY_CANDIDATE").otherwise("NEEDS_REVIEW"))


def _joined(parts: Column, component: str) -> Column:
    return stripped(F.array_join(parts, "\n" if component == "buttons" else " "))


def limited_rewrite(df: DataFrame, purpose: Column, confirmed: Column) -> DataFrame:
    """available, edited_<component>: promotional fragments dropped, unless one names a transaction or the event goes."""
    edited = {f"edited_{c}": _joined(F.filter(fragments_of(c), lambda x: ~is_promotional(x)), c) for c in R.COMPONENTS}
    tangled = reduce(lambda a, b: a | b, [F.exists(fragments_of(c), lambda x: is_promotional(x) & has_transaction(x)) for c in R.COMPONENTS])
    out = df.withColumns(edited).withColumns({"purpose": purpose, "verdict": assess(purpose, confirmed)})
    grounded = event_in(purpose, F.col("body")) & confirmed & ((purpose == "critical") | has_reference(F.col("body")))
    available = (F.col("verdict") == "LIKELY_MARKETING") & grounded & ~tangled & (F.col("edited_body") != "") & event_in(purpose, F.col("edited_body"))
    return out.withColumn("available", available)


def is_ambiguous(x: Column) -> Column:
    return is_promotional(x) & (x.rlike(R.PLACEHOLDER) | (has_transaction(x) & ~hits(x, R.NEXT_PURCHASE)))


def split_promotional(df: DataFrame) -> DataFrame:
    """kept_<component>, removed and ambiguous fragments."""
    kept, removed, ambiguous = {}, [], []
    for c in R.COMPONENTS:
        parts = fragments_of(c)
        kept[f"kept_{c}"] = _joined(F.filter(parts, lambda x: ~is_promotional(x) | is_ambiguous(x)), c)
        removed.append(F.filter(parts, lambda x: is_promotional(x) & ~is_ambiguous(x)))
        ambiguous.append(F.filter(parts, is_ambiguous))
    return df.withColumns(kept | {"removed": F.flatten(F.array(*removed)), "ambiguous": F.flatten(F.array(*ambiguous))})


CONVERSION_MESSAGE_LIMIT = 1000


def convert(df: DataFrame, confirmed: Column, known_downgrade: Column, before: Column, after: Column) -> DataFrame:
    """verdict, removed_text: conversion without a hosted model; before and after are utility categories of a classifier."""
    out = split_promotional(df.withColumns({"__purpose": detect_purpose(F.col("body"))}))
    out = out.withColumns({"__check": assess(F.col("__purpose"), confirmed), "__found": has_finding(), "__missing": missing_context(F.col("__purpose"), confirmed)})
    new_purpose = detect_purpose(F.col("kept_body"))
    kept_full = F.concat_ws("\n", *[F.col(f"kept_{c}") for c in R.COMPONENTS])
    kept_found = reduce(lambda a, b: a | b, [is_promotional(F.col(f"kept_{c}")) for c in R.COMPONENTS])
    kept_ok = ~kept_found & event_in(new_purpose, F.col("kept_body")) & confirmed & ((new_purpose == "critical") | has_reference(F.col("kept_body"))) & ~is_authentication(kept_full) & english_supported(kept_full)
    vanished = F.array_except(placeholders(record_content()), F.flatten(F.array(placeholders(kept_full), placeholders(F.array_join("removed", " ")))))
    verdict = (
        F.when(F.col("__check") == "AUTHENTICATION", "AUTHENTICATION")
        .when(F.col("__check") == "NEEDS_REVIEW", "NEEDS_CONTEXT")
        .when(~F.col("__found") & (F.col("__check") == "UTILITY_CANDIDATE"), F.when(known_downgrade, "NEEDS_CONTEXT").otherwise("ALREADY_UTILITY"))
        .when(~has_anchor(F.col("body")), "IRREDUCIBLY_MARKETING")
        .when(~confirmed | (F.size("__missing") > 0), "NEEDS_CONTEXT")
        .when(F.size("ambiguous") > 0, "NEEDS_CONTEXT")
        .when((F.col("kept_body") == "") | ~has_anchor(F.col("kept_body")), "IRREDUCIBLY_MARKETING")
        .when(~kept_ok, "NEEDS_CONTEXT")
        .when(after == "MARKETING", "NEEDS_CONTEXT")
        .when(F.size(vanished) > 0, "NEEDS_CONTEXT")
        .when(F.size("removed") > 0, "SPLIT_RECOMMENDED").otherwise("CONVERTIBLE"))
    already = ~F.col("__found") & (F.col("__check") == "UTILITY_CANDIDATE")
    return out.withColumns({
        "verdict": verdict, "removed_text": F.substring(F.array_join("removed", " "), 1, CONVERSION_MESSAGE_LIMIT),
        "disputed_by_record": already & known_downgrade, "disputed_by_model": already & ~known_downgrade & (before == "MARKETING"),
    }).drop("__purpose", "__check", "__found", "__missing")


def is_solicitation(x: Column) -> Column:
    """A fragment that asks for something new rather than reporting what happened."""
    return F.concat(stripped(x), F.lit(" ")).rlike(f"^(?:{R.QUESTION})$") | hits(x, R.CALL_TO_ACTION) | hits(x, R.URGENCY) | is_promotional(x)


def strip_solicitation(c: Column) -> tuple[Column, Column]:
    """(kept text, dropped fragments); a fragment with a placeholder or reference stays."""
    drop = lambda x: is_solicitation(x) & ~x.rlike(r"\{\{[^}]+\}\}|\d{2,}")
    return stripped(F.array_join(F.filter(sentences(c), lambda x: ~drop(x)), " ")), F.filter(sentences(c), drop)


def tier(similarity: Column, substantive: Column) -> Column:
    return F.when(~substantive, "not-a-service-message").when(similarity >= 0.80, "precedent-backed").when(similarity >= 0.70, "precedent-adjacent").otherwise("policy-backed")


def eligible(body: Column, parts: list[Column], purpose: Column) -> Column:
    promotional = reduce(lambda a, b: a | b, [is_promotional(p) for p in parts])
    return (stripped(body) != "") & has_anchor(body) & ~promotional & (~purpose.isin(list(R.EVENTS)) | event_in(purpose, body))


def pattern_rates(df: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """cohort, pattern, n, share: of approved and downgraded messages that match."""
    flags = F.array(*[F.struct(F.lit(k).alias("pattern"), hits(F.col("body"), p).alias("hit")) for k, p in patterns.items()])
    rows = df.select("cohort", F.explode(flags).alias("f")).groupBy("cohort", "f.pattern")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("f.hit").cast("double")), 4).alias("share"))


def template_json(category: str = "UTILITY") -> Column:
    """A record in the shape of the nested export."""
    message = F.struct(F.lit("TEXT").alias("type"), F.lit(category).alias("templateCategory"), "header", "body", "footer", F.filter(F.split("buttons", "\n"), lambda x: stripped(x) != "").alias("buttons"))
    return F.to_json(F.struct(F.coalesce(F.nullif("name", F.lit("")), F.lit("UTILITY_DRAFT")).alias("templateName"), message.alias("messageBody")))


def safe_cell(c: Column) -> Column:
    """A cell that a spreadsheet does not take for a formula."""
    return F.when(F.ltrim(c).rlike(r"^[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)
