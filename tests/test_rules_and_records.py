"""Rules, records and metrics on small rows of our own."""

import pytest
from pyspark.sql import functions as F

from missive.functions import text as X
from missive.operators import economics as E
from missive.operators import metrics as M
from missive.operators import records as O
from missive.operators import replies as Z
from missive.operators import rules as U
from missive.operators import splits as S

COLUMNS = "id string, ingest_seq bigint, name string, header string, body string, footer string, buttons string, meta_category string, requested_category string, status string, format string, language string, created_at string, updated_at string"


def records(spark, bodies, **over):
    base = {"header": "", "footer": "", "buttons": "", "meta_category": "UTILITY", "requested_category": "UTILITY", "status": "APPROVED", "format": "TEXT", "language": "", "created_at": "2024-01-01T00:00:00Z", "updated_at": ""}
    rows = []
    for k, b in enumerate(bodies):
        r = base | over | {"id": str(k), "ingest_seq": k, "name": f"n{k}", "body": b} | (b if isinstance(b, dict) else {})
        rows.append(tuple(r[c.split()[0]] for c in COLUMNS.split(", ")))
    return spark.createDataFrame(rows, COLUMNS)


def test_normalization(spark):
    df = spark.createDataFrame([("Hi {{Name}}, pay 12,50 at https://x.y/z or a.b@c.de! नमस्ते ½",)], "t string")
    assert df.select(X.normalized_content(F.col("t"))).first()[0].split() == ["hi", "variable", "pay", "number", "number", "at", "url", "or", "email", "नमस", "त", "½"]
    df = spark.createDataFrame([(" call +91 98765 43210 or a@b.co, see http://x.y {{1}} 250 ",)], "t string")
    assert df.select(X.redacted(F.col("t"))).first()[0] == " call [PHONE_OR_LONG_ID] or [EMAIL], see [URL] {{1}} 250 "


def test_structural_features(spark):
    df = records(spark, [{"body": "Hi {{a}} {{a}} {{b}} 5% OFF! ☀ http://x.y", "header": "h", "buttons": "One\n\nTwo"}, ""])
    a, b = (r.asDict() for r in X.structural_features(df).orderBy("id").collect())
    assert (a["placeholder_count"], a["distinct_placeholders"], a["button_count"], a["emoji_count"], a["symbol_count"], a["url_count"]) == (3, 2, 2, 1, 1, 1)
    assert b["uppercase_ratio"] == 0 and b["body_length"] == 0


@pytest.mark.parametrize("body, script", [("ನಮಸ್ಕಾರ hello", "Kannada"), ("नमस्ते", "Devanagari"), ("hello", None), ("😀😀", None)])
def test_script(spark, body, script):
    assert spark.createDataFrame([(body,)], "t string").select(X.script_of(F.col("t"))).first()[0] == script


def test_button_text_shapes(spark):
    values = ["Plain ", '[{"type": "URL", "text": "Open"}, {"label": "Go"}]', '{"text": "One"}', '["a", "b"]', "[broken", None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "t string").select(X.button_text(F.col("t"))).collect()]
    assert got == ["Plain", "Open\nGo", "One", "a\nb", "[broken", ""]


def test_families_quarantine_conflicts(spark):
    df = records(spark, [{"body": "Invoice 12 is due", "meta_category": "UTILITY"}, {"body": "Invoice 99 is due", "meta_category": "MARKETING"}, {"body": "Order 5 has shipped"}, {"body": "Order 6 has shipped", "updated_at": "2025-01-01T00:00:00Z"}, {"body": "short", "status": "APPROVED"}, {"body": "Pending order message", "status": "PENDING"}])
    assert O.conflicting_families(df).count() == 1
    (kept,) = O.training_families(df).collect()
    assert kept["id"] == "3"


def test_import_is_idempotent(spark):
    df = records(spark, ["aaaaaaaaaaaa", "bbbbbbbbbbbb"])
    new, counts = O.import_records(df.unionByName(df), None)
    assert new.count() == 2 and tuple(counts.first()) == (2, 2)
    assert tuple(O.import_records(df, new)[1].first()) == (0, 2)


def test_rules_refuse_rather_than_launder(spark):
    df = records(spark, ["Your order {{id}} has shipped. Shop now.", "20% off everything today! Shop now.", "Your invoice 123 is due. Upgrade {{plan}} today.", "Your one time password is 1234"])
    yes = F.lit(True)
    got = U.convert(df, yes, F.lit(False), F.lit("MARKETING"), F.lit("UTILITY")).orderBy("id").collect()
    assert [r["verdict"] for r in got] == ["SPLIT_RECOMMENDED", "IRREDUCIBLY_MARKETING", "NEEDS_CONTEXT", "AUTHENTICATION"]
    assert got[0]["kept_body"] == "Your order {{id}} has shipped." and got[0]["removed"] == ["Shop now."]
    unsure = U.convert(df, F.lit(False), F.lit(False), F.lit("MARKETING"), F.lit("UTILITY")).where("id = '0'").first()
    assert unsure["verdict"] == "NEEDS_CONTEXT"


def test_strip_solicitation_keeps_business_values(spark):
    df = spark.createDataFrame([("Your visit is done. Hurry, limited time offer! Call us now about order 4512.",)], "t string")
    kept, dropped = (df.select(c).first()[0] for c in U.strip_solicitation(F.col("t")))
    assert kept == "Your visit is done. Call us now about order 4512." and dropped == ["Hurry, limited time offer!"]


def test_operating_point(spark):
    rows = [(0.1, "MARKETING"), (0.4, "MARKETING"), (0.6, "UTILITY"), (0.8, "UTILITY"), (0.9, "UTILITY")]
    df = spark.createDataFrame(rows, "p double, recorded_category string")
    assert M.operating_point(df, "p", 1.0).first()[0] == 0.6
    assert M.operating_point(df.withColumn("recorded_category", F.lit("MARKETING")), "p", 0.5).first()[0] == 1.0


def test_empty_slices_are_null(spark):
    df = spark.createDataFrame([], "recorded_category string, prediction string, requested_category string")
    assert M.score_rows(df).first()["accuracy"] is None


def test_budget_is_never_exceeded_and_curve_is_monotone(spark):
    rows = [(str(k), ((k * 37) % 100) / 100, float((k * 13) % 7)) for k in range(200)]
    df = spark.createDataFrame(rows, "id string, p_utility double, monthly_volume double")
    ordered = sorted(rows, key=lambda r: (-r[1], -r[2], r[0]))
    for budget in (0.02, 0.1, 0.3):
        want, v, r = set(), 0.0, 0.0
        for i, p, w in ordered:
            v, r = v + w, r + w * (1 - p)
            if v <= 0 or round(r / v, 9) > budget:
                break
            want.add(i)
        got = E.allocate(df, budget).where("declare = 'UTILITY'")
        assert {x["id"] for x in got.collect()} == want
    curve = [x["utility_volume"] for x in E.risk_curve(df).orderBy("budget").collect()]
    assert curve == sorted(curve)
    equal = E.weights(df.withColumn("monthly_volume", F.lit(None).cast("double")))
    assert equal.agg(F.min("volume"), F.max("volume")).first()[:] == (1.0, 1.0)


def test_costs_are_dominated_without_penalty():
    assert E.Costs(rework=0.0, penalty=0.0).break_even == 0.0 and 0.8 < E.Costs().break_even < 0.9


def test_replies(spark):
    raws = ["no json", 'x {"category": "UTILITY", "confidence": 0.5, "clauses": [], "rationale": "r"} y', '{"category": "SPAM", "confidence": 0.5, "clauses": []}', '{"category": "UTILITY", "confidence": 2, "clauses": []}', '{"category": "UTI']
    got = [r[0]["reason"] for r in spark.createDataFrame([(x,) for x in raws], "t string").select(Z.parse_responses(F.col("t"))).collect()]
    assert got == ["no_json", "", "unknown_category", "bad_confidence", "no_json"]
    filled = spark.createDataFrame([("Pay {{amount}} by {{due_date}} via {{1}}",)], "t string").select(Z.fill_samples(F.col("t"))).first()[0]
    assert "{{" not in filled and "1,250" in filled


def test_attempts_stop_at_the_target(spark):
    rows = [("a", 1, 0.5, True), ("a", 2, 0.95, True), ("a", 3, 0.99, True), ("b", 1, 0.4, False), ("b", 2, 0.3, True)]
    df = spark.createDataFrame(rows, "id string, round int, score double, clean boolean")
    assert {tuple(r) for r in Z.pick_attempt(df, "best").collect()} == {("a", 2, 0.95), ("b", 2, 0.3)}
    assert {tuple(r) for r in Z.pick_attempt(df, "loop").collect()} == {("a", 1, 0.5), ("b", 2, 0.3)}


def test_samples_do_not_depend_on_order(spark):
    df = spark.range(80).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") % 4 == 0, "UTILITY").otherwise("MARKETING").alias("recorded_category"))
    a, b = (sorted(r["id"] for r in S.stratified_sample(x, 20, "z").collect()) for x in (df, df.orderBy(F.desc("id"))))
    assert a == b and len(a) == 20
