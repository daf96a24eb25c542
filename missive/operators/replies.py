"""Data work around recorded model replies: validation, caches, attempts and acceptance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from missive.functions.text import lost_placeholders, placeholders, script_of, stripped
from missive.operators.rules import detect_purpose, event_in, has_anchor, is_promotional

REPLY = "category string, confidence double, clauses array<string>, rationale string"
KNOWN = ["MARKETING", "UTILITY", "AUTHENTICATION", "NEEDS_REVIEW"]


def parse_responses(raw: Column) -> Column:
    """struct(reply, reason): the JSON object inside prose, or why it is not accepted."""
    text = F.nullif(F.regexp_extract(raw, r"(?s)\{.*\}", 0), F.lit(""))
    r = F.from_json(text, REPLY)
    reason = (F.when(text.isNull(), "no_json").when(r.isNull() | r["category"].isNull(), "malformed").when(~r["category"].isin(KNOWN), "unknown_category")
              .when(r["confidence"].isNull() | F.isnan(r["confidence"]) | (r["confidence"] < 0) | (r["confidence"] > 1), "bad_confidence")
              .when(r["clauses"].isNull() | (F.size(r["clauses"]) > 8), "bad_clauses").when(F.length(F.coalesce(r["rationale"], F.lit(""))) > 1000, "long_rationale").otherwise(""))
    return F.struct(F.when(reason == "", r).alias("reply"), reason.alias("reason"))


REWRITE = "possible boolean, body string, reason string, name string, buttons string"


def parse_rewrites(raw: Column) -> Column:
    text = F.nullif(F.regexp_extract(raw, r"(?s)\{.*\}", 0), F.lit(""))
    r = F.from_json(text, REWRITE)
    reason = F.when(text.isNull(), "no_json").when(r["possible"].isNull(), "malformed").when(r["possible"] & (F.coalesce(F.length(r["body"]), F.lit(0)) == 0), "no_body").when(F.length(r["body"]) > 1024, "long_body").otherwise("")
    return F.struct(F.when(reason == "", r).alias("reply"), reason.alias("reason"))


def cache_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def cache_merge(cache: DataFrame) -> DataFrame:
    """Last write wins: key, answer."""
    return cache.groupBy("key").agg(F.max_by("answer", "written").alias("answer"))


def cache_split(prompts: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(prompts answered already, with answers; prompts to be answered)."""
    return prompts.join(cache_merge(cache), "key"), prompts.join(cache.select("key"), "key", "left_anti")


def pick_attempt(rounds: DataFrame, mode: str, target: float = 0.9) -> DataFrame:
    """One attempt per item. loop: the first clean one; best: the best clean score up to the first that reaches target."""
    if mode == "loop":
        return rounds.where("clean").groupBy("id").agg(F.min_by(F.struct("round", "score"), "round").alias("a")).select("id", "a.*")
    upto = Window.partitionBy("id").orderBy("round").rowsBetween(Window.unboundedPreceding, -1)
    stopped = F.coalesce(F.max((F.col("clean") & (F.col("score") >= target)).cast("int")).over(upto), F.lit(0))
    live = rounds.withColumn("stopped", stopped).where("stopped = 0 AND clean")
    return live.groupBy("id").agg(F.max_by(F.struct("round", "score"), F.struct("score", (-F.col("round")).alias("r"))).alias("a")).select("id", "a.*")


def select_candidate(proposals: DataFrame) -> DataFrame:
    """Of the eligible proposals of each id, that of the best score (ties: the first round)."""
    best = F.max_by(F.struct("round", "score"), F.struct("score", (-F.col("round")).alias("r")))
    return proposals.where("eligible").groupBy("id").agg(best.alias("a")).select("id", "a.*")


def draft_verdict(score: Column, promotional: Column, possible: Column) -> Column:
    return F.when(promotional, "PROMOTIONAL_INTENT").when(possible == 0, "REFUSED").when(score.isNull(), "ERROR").when(score >= 0.6, "DRAFTED").otherwise("WEAK")


def gates(original: Column, candidate: Column) -> Column:
    """struct of hard gates on a candidate text."""
    return F.struct(F.size(lost_placeholders(original, candidate)).alias("lost"), has_anchor(candidate).alias("anchor"), (~is_promotional(candidate)).alias("clean"),
                    (F.size(F.array_distinct(placeholders(candidate))) <= F.size(F.array_distinct(placeholders(original))) + 1).alias("budget"))


def kept_script(original: Column, candidate: Column) -> Column:
    """Is the candidate in the original's script? Originals in Latin script have none to keep."""
    return script_of(original).isNull() | script_of(candidate).eqNullSafe(script_of(original))


def critique(original: Column, candidate: Column) -> Column:
    """Codes of what is still wrong with a candidate."""
    g = gates(original, candidate)
    return F.filter(F.array(F.when(g["lost"] > 0, "lost_placeholder"), F.when(~g["anchor"], "no_anchor"), F.when(~g["clean"], "promotional"), F.when(~g["budget"], "too_many_placeholders")), lambda x: x.isNotNull())


def accept_edit(edit: Column, extractive: Column) -> Column:
    squeezed = lambda c: stripped(F.regexp_replace(c, r"\s+", " "))
    return (squeezed(edit) == squeezed(extractive)) & has_anchor(edit) & ~is_promotional(edit)


def accept_restatement(original: Column, text: Column, category: Column) -> Column:
    short = F.length(text) <= 1.1 * F.length(original) + 20
    return has_anchor(text) & ~is_promotional(text) & (F.size(lost_placeholders(original, text)) == 0) & short & (category == "UTILITY")


def accept_draft(purpose: Column, text: Column) -> Column:
    return event_in(purpose, text) & ~is_promotional(text) & (F.size(placeholders(text)) > 0)


def conversion_summary(df: DataFrame) -> DataFrame:
    """id, verdict, before, after, lost, error -> counts, shares and the mean gain of ratified rewrites."""
    ratified = F.col("verdict").isin("CONVERTIBLE", "SPLIT_RECOMMENDED") & (F.col("after") >= 0.5)
    n = F.count(F.lit(1))
    return df.agg(n.alias("rows"), F.count_if(F.col("verdict").isin("CONVERTIBLE", "SPLIT_RECOMMENDED")).alias("rewrites"), F.count_if(ratified).alias("ratified"), F.round(F.try_divide(F.count_if(ratified), n), 4).alias("ratified_share"),
                  F.round(F.avg(F.when(ratified, F.col("after") - F.col("before"))), 4).alias("mean_gain"), F.count_if("error").alias("failures"), F.count_if("lost").alias("lost_placeholder"))


def _half(name: Column, body: Column, category: str) -> Column:
    """A body alone in the shape of the nested export."""
    message = F.struct(F.lit("TEXT").alias("type"), F.lit(category).alias("templateCategory"), F.lit("").alias("header"), body.alias("body"), F.lit("").alias("footer"), F.array().cast("array<string>").alias("buttons"))
    return F.to_json(F.struct(F.coalesce(F.nullif(name, F.lit("")), F.lit("UTILITY_DRAFT")).alias("templateName"), message.alias("messageBody")))


def conversion_outputs(df: DataFrame) -> DataFrame:
    """id, name, verdict, before_body, after_body, split_off, before, after -> every rewrite by falling gain, with the export JSON of both halves."""
    name, split = F.coalesce("name", F.lit("")), F.nullif("split_off", F.lit(""))
    rewritten = F.col("verdict").isin("CONVERTIBLE", "SPLIT_RECOMMENDED") & (F.col("after_body") != "")
    kept = placeholders(F.concat_ws(" ", "after_body", "split_off"))
    lost = F.array_sort(F.array_distinct(F.array_except(placeholders(F.col("before_body")), kept)))
    gain = F.round(F.coalesce("after", F.lit(0.0)) - F.coalesce("before", F.lit(0.0)), 4)
    return df.where(rewritten).select(
        "id", "name", "before_body", "after_body", "split_off", "before", "after", gain.alias("gain"), (F.coalesce("after", F.lit(0.0)) >= 0.5).alias("ratified"), F.array_join(lost, "|").alias("placeholders_lost"),
        _half(name, F.col("after_body"), "UTILITY").alias("utility_json"), F.when(split.isNotNull(), _half(F.regexp_replace(F.concat(name, F.lit("_PROMO")), "^_+", ""), split, "MARKETING")).alias("split_off_json"),
    ).orderBy(F.desc("gain"), "id")


def attempts_summary(rounds: DataFrame, picked: DataFrame, by: list[str]) -> DataFrame:
    """Per cohort: items, items with an accepted attempt, mean rounds, mean score gain from the first round."""
    per = rounds.groupBy("id", *by).agg(F.count(F.lit(1)).alias("rounds"), F.min_by("score", "round").alias("first_score"))
    joined = per.join(picked.select("id", F.col("score").alias("picked")), "id", "left")
    return joined.groupBy(*by).agg(F.count(F.lit(1)).alias("items"), F.count("picked").alias("accepted"), F.round(F.avg("rounds"), 4).alias("mean_rounds"), F.round(F.avg(F.col("picked") - F.col("first_score")), 4).alias("mean_gain"))


# Drafts for the events that have one.
ALL_PRESETS = [
    ("billing", "Invoice issued", "Your invoice {{invoice_id}} for {{billing_period}} is ready. The amount due is {{amount}}, payable by {{due_date}}.", "View invoice"),
    ("billing", "Payment received", "We received your payment of {{amount}} for invoice {{invoice_id}} on {{payment_date}}.", "View receipt"),
    ("order", "Order shipped", "Your order {{order_id}} has shipped. Expected delivery: {{delivery_date}}.", "Track order"),
    ("appointment", "Appointment reminder", "Your appointment {{appointment_id}} is scheduled for {{appointment_date}} at {{appointment_time}}.", "View appointment"),
    ("support", "Support update", "Your support case {{case_id}} has been updated. Current status: {{case_status}}.", "View case"),
]
# End of fixed values.
#: The first preset of each event is the one that a task gets.
PRESETS = [p for i, p in enumerate(ALL_PRESETS) if p[0] not in {q[0] for q in ALL_PRESETS[:i]}]


def draft_from_presets(tasks: DataFrame, text: str = "body") -> DataFrame:
    """verdict and draft by the event a task names; promotional tasks are refused."""
    presets = tasks.sparkSession.createDataFrame(PRESETS, "purpose string, draft_name string, draft string, draft_buttons string")
    joined = tasks.withColumn("purpose", detect_purpose(F.col(text))).join(F.broadcast(presets), "purpose", "left")
    verdict = F.when(is_promotional(F.col(text)), "REFUSED").when(F.col("draft").isNull(), "NEEDS_CONTEXT").otherwise("DRAFTED")
    return joined.withColumn("verdict", verdict).withColumn("draft", F.when(F.col("verdict") == "DRAFTED", F.col("draft")))


# Sample values of ``fill_samples``, a short set of its own.
SAMPLES = [("amount|price|due|balance|total", "1,250"), ("date|day|on$", "12 Aug 2026"), ("time|slot", "10:30 AM"), ("link|url", "https://example.com/a"), ("id|number|no|order|invoice|case", "10482"), ("name|plan", "Asha")]
CONTEXT = 28


def fill_samples(text: Column) -> Column:
    """text with every placeholder replaced by a sample value: its name, else the 28 characters before it, picks the rule."""
    pieces = F.split(text, r"\{\{[^}]+\}\}", -1)
    names = placeholders(text)

    def value(name: Column, before: Column) -> Column:
        out = F.lit("value")
        for pattern, sample in reversed(SAMPLES):
            out = F.when(before.rlike(f"(?i)(?:{pattern})"), sample).otherwise(out)
        for pattern, sample in reversed(SAMPLES):
            out = F.when(name.rlike(f"(?i)(?:{pattern})"), sample).otherwise(out)
        return out

    filled = F.zip_with(pieces, names, lambda p, n: F.when(n.isNull(), p).otherwise(F.concat(p, value(F.regexp_replace(n, r"[{}]", ""), F.when(F.length(p) > CONTEXT, F.substr(p, F.length(p) - F.lit(CONTEXT - 1))).otherwise(p)))))
    return F.array_join(filled, "")


# Sample values by ordered rules, and the variants that repeats take in turn; links are on a neutral host.
SAMPLE_RULES = [
    (r"link|url|href|click here|pay here|track|view|anytime|below", "https://example.com/p/8c31fa"),
    (r"date|deadline|expiry|expires|scheduled (?:on|for)|by\b|due on", "12 October"),
    (r"time|slot|between|at\b", "3:30 PM"),
    (r"amount|price|payment of|balance|emi|fee|charge|rs\.?|₹|worth|overdue", "₹4,250"),
    (r"hi|hello|dear|name|customer|tenant|owner|user|agent|manager", "Rahul"),
    (r"phone|mobile|contact", "98••••3210"),
    (r"address|property|location|city|area|flat|apartment", "Indiranagar, Bengaluru"),
    (r"type|plan|category|service|product", "Home"),
    (r"status|state", "confirmed"),
    (r"percent|discount|waiver", "10"),
    (r"account|order|invoice|booking|ticket|case|receipt|id|number|ref|no\b", "8421337"),
]
SAMPLE_DEFAULT = "8421337"
VARIANTS = {
    "https://example.com/p/8c31fa": ["https://example.com/p/8c31fa", "https://example.com/b/47dd10", "https://example.com/t/9ba2e5"],
    "₹4,250": ["₹4,250", "₹1,890", "₹12,400"],
    "8421337": ["8421337", "5530912", "7104468"],
    "12 October": ["12 October", "18 October", "3 November"],
    "Rahul": ["Rahul", "Priya", "Arjun"],
    "3:30 PM": ["3:30 PM", "11:00 AM", "6:15 PM"],
    "Indiranagar, Bengaluru": ["Indiranagar, Bengaluru", "Kondapur, Hyderabad", "Powai, Mumbai"],
    "98••••3210": ["98••••3210", "97••••4417", "90••••1268"],
}
CURRENCY_BEFORE = r"(?i)(?:₹|\bRs\.?)\s*$"
# End of fixed values.


def fill_by_rule(text: Column) -> Column:
    """text with every placeholder replaced by a sample value.

    The first rule that its name meets, else the first that the CONTEXT characters before it
    meet, gives the value; the second and third use of a value in a text take its variants, in
    turn; after a currency sign the value has none of its own.
    """
    marks = placeholders(text)
    parts = F.split(text, r"\{\{[^}]+\}\}", -1)

    def by_rules(source: Column) -> Column:
        out = F.lit(None).cast("string")
        for pattern, sample in reversed(SAMPLE_RULES):
            out = F.when(source.rlike(f"(?i)(?:{pattern})"), sample).otherwise(out)
        return out

    # what stands before each placeholder: the text up to it, placeholders included
    upto = F.transform(marks, lambda _, i: F.array_join(F.flatten(F.transform(F.slice(F.arrays_zip(parts.alias("p"), marks.alias("m")), F.lit(1), i + 1), lambda z, k: F.when(k < i, F.array(z["p"], z["m"])).otherwise(F.array(z["p"])))), ""))
    tails = F.transform(upto, lambda u: F.substr(u, F.greatest(F.lit(1), F.length(u) - F.lit(CONTEXT - 1)), F.lit(CONTEXT)))
    bases = F.zip_with(marks, tails, lambda m, t: F.coalesce(by_rules(F.regexp_replace(m, r"^\{\{|\}\}$", "")), by_rules(t), F.lit(SAMPLE_DEFAULT)))

    def variant(base: Column, before: Column) -> Column:
        turn = F.size(F.filter(before, lambda x: x == base)) % 3
        out = base
        for value, options in VARIANTS.items():
            out = F.when(base == value, F.element_at(F.array(*map(F.lit, options)), turn + 1)).otherwise(out)
        return out

    values = F.transform(bases, lambda b, i: F.when(i == 0, b).otherwise(variant(b, F.slice(bases, F.lit(1), i))))
    values = F.zip_with(values, tails, lambda v, t: F.when(t.rlike(CURRENCY_BEFORE), F.regexp_replace(v, "^₹+", "")).otherwise(v))
    return F.array_join(F.zip_with(parts, values, lambda p, v: F.concat(p, F.coalesce(v, F.lit("")))), "")


COMPONENT_REPLY = "header string, body string, footer string, buttons string, possible boolean"


def parse_components(raw: Column) -> Column:
    """struct(reply, reason): message parts as strings and a boolean flag; parts of other types are refused."""
    text = F.nullif(F.regexp_extract(raw, r"(?s)\{.*\}", 0), F.lit(""))
    parsed = F.try_parse_json(text)
    kind = lambda name: F.schema_of_variant(F.try_variant_get(parsed, f"$.{name}", "variant"))
    strings = [F.coalesce(kind(c), F.lit("STRING")).isin("STRING", "VOID") for c in ("header", "body", "footer", "buttons")]
    bad_part = ~(strings[0] & strings[1] & strings[2] & strings[3])
    reason = F.when(text.isNull(), "no_json").when(parsed.isNull(), "malformed").when(bad_part, "part_not_text").when(F.coalesce(kind("possible"), F.lit("VOID")) != "BOOLEAN", "flag_not_boolean").otherwise("")
    return F.struct(F.when(reason == "", F.from_json(text, COMPONENT_REPLY)).alias("reply"), reason.alias("reason"))


def review_prompts(queries: DataFrame, examples: DataFrame, redacted: Column) -> DataFrame:
    """id, prompt: the redacted message, its examples with the closest last, and a note only where both labels occur.

    examples: id, label, body, place.
    """
    lines = examples.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", F.concat("label", F.lit(": "), "body").alias("line")))).alias("e"), (F.count_distinct("label") == 2).alias("both"))
    note = F.when(F.col("both"), "\nExamples of both outcomes follow; weigh what sets them apart.").otherwise("")
    return queries.join(lines, "id").select("id", F.concat(F.lit("Message:\n"), redacted, note, F.lit("\nExamples:\n"), F.array_join("e.line", "\n")).alias("prompt"))
