"""Columns over message text: normalization, structure, fragments, redaction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from missive.functions.patterns import CATEGORIES, COMPONENTS, EMAIL, LINK, LONG_NUMBER, SCRIPTS

_SENTENCE_END = r"(?<=[.!?])\s+|\n+"


def stripped(c: Column) -> Column:
    """c without white space at either end, Unicode white space included."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def as_text(c: Column, kind: str = "string") -> Column:
    """Missing values are empty, structs and arrays JSON, all else stripped text."""
    if kind.startswith(("struct", "array", "map")):
        return F.coalesce(F.to_json(c), F.lit(""))
    return stripped(F.coalesce(c.cast("string"), F.lit("")))


def category(c: Column) -> Column:
    upper = F.upper(as_text(c))
    return F.when(upper.isin(CATEGORIES), upper).otherwise("UNKNOWN")


def timestamp_text(c: Column) -> Column:
    """A timestamp given as text, or as a JSON object with a ``$date``."""
    return stripped(F.coalesce(F.get_json_object(c, "$['$date']"), F.when(F.ltrim(c).startswith("{"), F.lit("")).otherwise(c), F.lit("")))


def record_content() -> Column:
    return F.concat_ws("\n", *[F.coalesce(F.col(c), F.lit("")) for c in COMPONENTS])


def normalized_content(c: Column) -> Column:
    """Lower case; placeholders, links, addresses and digits as tokens; words joined by blanks."""
    c = F.regexp_replace(F.lower(c), r"\{\{.*?\}\}", " variable ")
    c = F.regexp_replace(c, r"https?://\S+|www\.\S+", " url ")
    c = F.regexp_replace(c, r"\b[\w.+-]+@[\w.-]+\.[a-z]+\b", " email ")
    c = F.regexp_replace(c, r"\p{Nd}+", " number ")
    return F.array_join(F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), " ")


def placeholders(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"\{\{[^}]+\}\}"), F.lit(0))


def lost_placeholders(before: Column, after: Column) -> Column:
    return F.array_sort(F.array_except(placeholders(before), placeholders(after)))


def button_lines(c: Column) -> Column:
    return F.filter(F.split(c, "\n"), lambda x: stripped(x) != "")


def structural_features(df: DataFrame) -> DataFrame:
    """Twelve counts that normalization erases."""
    count = lambda p, c="body": F.regexp_count(c, F.lit(p)).cast("double")
    tokens = F.regexp_extract_all("body", F.lit(r"\{\{.*?\}\}"), F.lit(0))
    letters = F.regexp_count("body", F.lit(r"\p{L}"))
    return df.withColumns({
        "placeholder_count": F.size(tokens).cast("double"),
        "distinct_placeholders": F.size(F.array_distinct(tokens)).cast("double"),
        "button_count": F.size(button_lines(F.col("buttons"))).cast("double"),
        "has_header": (F.col("header") != "").cast("double"),
        "has_footer": (F.col("footer") != "").cast("double"),
        "body_length": F.length("body").cast("double"),
        "emoji_count": count(r"[\x{2600}-\x{10FFFF}]"),
        "exclamation_count": count("!"),
        "symbol_count": count("[%$₹€£]"),
        "uppercase_ratio": F.coalesce(F.try_divide(F.regexp_count("body", F.lit(r"\p{Lu}")), letters), F.lit(0.0)),
        "number_count": count(r"\p{Nd}+"),
        "url_count": count(r"https?://\S+|www\.\S+"),
    })


def short_hash(c: Column, n: int = 24) -> Column:
    return F.substring(F.sha2(c, 256), 1, n)


def family_key(family_id: Column | None = None) -> Column:
    """An explicit family id, else the content of all components, else that of the body.

    Contents are normalized in lambdas, which Spark keeps out of the stage's generated method: beside a record's other
    columns that grows beyond 8,000 bytes, and the JVM then never compiles it.
    """
    alone = lambda c: F.transform(F.array(c), normalized_content)[0]
    seed = F.coalesce(F.nullif(alone(record_content()), F.lit("")), alone(F.coalesce("body", F.lit(""))))
    if family_id is not None:
        seed = F.coalesce(F.nullif(stripped(family_id), F.lit("")), seed)
    return short_hash(seed)


def content_hash() -> Column:
    return short_hash(record_content(), 16)


def redacted(c: Column) -> Column:
    """E-mail addresses, links, phone or long numbers replaced, in that order."""
    for pattern, token in ((EMAIL, "[EMAIL]"), (LINK, "[URL]"), (LONG_NUMBER, "[PHONE_OR_LONG_ID]")):
        c = F.regexp_replace(c, pattern, token)
    return c


def script_of(c: Column) -> Column:
    """The non-Latin script with most characters; of equal ones that which comes first in the text."""
    found = F.array(*[F.struct((-F.regexp_count(c, F.lit(p))).alias("n"), F.regexp_instr(c, F.lit(p)).alias("at"), F.lit(name).alias("script")) for name, p in ((k, f"[\\x{{{lo:04X}}}-\\x{{{hi:04X}}}]") for k, (lo, hi) in SCRIPTS.items())])
    best = F.element_at(F.array_sort(found), 1)
    return F.when(best["n"] < 0, best["script"])


def sentences(c: Column) -> Column:
    return F.filter(F.split(c, _SENTENCE_END), lambda x: stripped(x) != "")


def fragments_of(component: str) -> Column:
    return button_lines(F.col(component)) if component == "buttons" else sentences(F.col(component))


def fragments(df: DataFrame) -> DataFrame:
    """One row per fragment: component, place, fragment."""
    parts = [df.select("*", F.lit(c).alias("component"), F.posexplode(fragments_of(c)).alias("place", "fragment")) for c in COMPONENTS]
    return reduce(DataFrame.unionByName, parts)


def english_supported(c: Column) -> Column:
    """No letters, or fewer than 15% of them outside ASCII."""
    letters = F.regexp_count(c, F.lit(r"\p{L}"))
    return (letters == 0) | ((letters - F.regexp_count(c, F.lit("[A-Za-z]"))) / letters < 0.15)


def date_value(c: Column) -> Column:
    """ISO text to a UTC instant, whatever the session's zone; text without a zone is UTC; null if it is none."""
    zoned = c.rlike(r"(?i)(?:z|[+-]\d{2}:?\d{2})$")
    clock = F.when(c.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.concat(c, F.lit("T00:00:00Z"))).otherwise(F.concat(c, F.lit("Z")))
    return F.try_to_timestamp(F.when(zoned & ~c.rlike(r"^\d{4}-\d{2}-?\d{2}$"), c).otherwise(clock))


def button_text(c: Column) -> Column:
    """Labels, one to a line, from plain text or from JSON (objects with text or label, or strings)."""
    item = "struct<text:string,label:string>"
    label = lambda b: stripped(F.coalesce(F.nullif(b["text"], F.lit("")), F.nullif(b["label"], F.lit("")), F.lit("")))
    trimmed = stripped(F.coalesce(c, F.lit("")))
    objects = F.from_json(F.when(trimmed.startswith("{"), F.concat(F.lit("["), trimmed, F.lit("]"))).otherwise(trimmed), f"array<{item}>")
    strings = F.from_json(trimmed, "array<string>")
    joined = lambda a: F.array_join(F.filter(a, lambda x: x != ""), "\n")
    from_objects = joined(F.transform(objects, label))
    return F.when(~trimmed.rlike(r"^[\[{]"), trimmed).when(objects.isNotNull() & (from_objects != ""), from_objects).when(strings.isNotNull(), joined(F.transform(strings, stripped))).otherwise(trimmed)
