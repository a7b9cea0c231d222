"""Guardrail rules on hand-made briefs (the flag cases the driver texts lack)."""

from pyspark.sql import functions as F

from tidemark.operators import text as TX


def test_unknown_feature_flags(spark):
    df = spark.createDataFrame([
        ("Usage fell: events_last_30d dropped and magic_score_value rose; magic_score_value again.",),
        ("Follow the follow_up and re_run plan_tier notes.",),
    ], "text string")
    got = [r[0] for r in df.select(TX.unknown_feature_flags(F.col("text"), TX.KNOWN_FEATURES, TX.SAFE_TOKENS)).collect()]
    assert got == [["hallucinated_feature:magic_score_value"], []]


def test_probability_and_confidence(spark):
    df = spark.createDataFrame([("Churn risk is 72% this quarter.", 0.71), ("Risk of 40 percent.", 0.2),
                                ("No number here.", 0.9)], "text string, p double")
    g = TX.churn_brief_guardrails(df, "text", F.col("p")).collect()
    assert [r["n_flags"] for r in g] == [0, 1, 0]
    assert [r["confidence_score"] for r in g] == [1.0, 0.8, 1.0]
    assert g[0]["final_text"].endswith(TX.WATERMARK)


def test_expansion_status_tone_scrub(spark):
    df = spark.createDataFrame([
        ("Act immediately on made_up_feature and other_fake_signal.", 0.3,
         "Ping 123e4567-e89b-12d3-a456-426614174000 about the XGBoost shap values."),
    ], "brief string, p double, email string")
    r = df.select(F.size(TX.expansion_brief_flags(F.col("brief"))).alias("n"),
                  TX.calibrate_tone(F.col("brief"), F.col("p")).alias("tone"),
                  TX.scrub_email(F.col("email")).alias("scrub")).collect()[0]
    assert r["n"] == 2
    assert r["tone"] == "Act on made_up_feature and other_fake_signal."
    assert r["scrub"] == "Ping [REDACTED] about the [REDACTED] [REDACTED] values."


def test_split_email_and_scope(spark):
    df = spark.createDataFrame([("Brief text. [EMAIL_DRAFT] Hello there", ), ("Only brief", )], "t string")
    brief, draft = TX.split_email(F.col("t"))
    got = [tuple(r) for r in df.select(brief, draft, TX.scope_exceeded(F.col("t"))).collect()]
    assert got == [("Brief text.", "Hello there", False), ("Only brief", None, False)]


def test_tenure_text(spark):
    df = spark.createDataFrame([(455,), (30,), (10,)], "d int")
    assert [r[0] for r in df.select(TX.tenure_text(F.col("d"))).collect()] == ["1y 3mo", "1mo", "0mo"]


def test_python_whitespace_semantics(spark):
    """Tokens split and strip like Python's str.split()/str.strip(), Unicode spaces included."""
    text = "\n\tLead made_up_signal and other_fake_thing.　\n"
    df = spark.createDataFrame([(text,)], "t string")
    flags = df.select(TX.unknown_feature_flags(F.col("t"), TX.KNOWN_FEATURES, TX.SAFE_TOKENS)).first()[0]
    expected = [f"hallucinated_feature:{tok.strip('.,;:!?()' + chr(39) + chr(34))}" for tok in text.split()
                if "_" in tok]
    assert flags == expected
    assert df.select(TX.py_strip(F.col("t"))).first()[0] == text.strip()


def test_long_tokens_take_linear_time(spark):
    """A token, a run of blanks, of digits, of punctuation or of underscores, a million characters long."""
    import time
    n = 1_000_000
    texts = ["x" * n, "made_up_feature" + " " * n + "z", "1" * n, "made_up_feature" + "!" * n + "y z", "a_" * (n // 2) + "a", "a" * n + " made_up_feature"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).cache()
    cols = [F.size(TX.unknown_feature_flags(F.col("t"), TX.KNOWN_FEATURES)).alias("n"), TX.stated_percentage(F.col("t")).alias("p"), F.length(TX.py_strip(F.col("t"))).alias("s")]
    df.limit(0).select(*cols).collect()
    start = time.time()
    got = [r["n"] for r in df.select(*cols).collect()]
    assert got == [0, 1, 0, 0, 1, 1] and time.time() - start < 30


def test_a_row_allows_its_own_features(spark):
    df = spark.createDataFrame([("sso_login_count rose", ["sso_login_count"]), ("sso_login_count rose", ["other_signal"]), ("sso_login_count rose", None)], "t string, own array<string>")
    got = [r[0] for r in df.select(F.size(TX.expansion_brief_flags(F.col("t"), F.col("own")))).collect()]
    assert got == [0, 1, 1]


def test_a_text_is_scanned_once_for_its_tokens(spark):
    """The count of flags reads the flags: one scan a text, and none where it has no underscore."""
    df = spark.createDataFrame([("made_up_feature (other_fake_thing), no__pe x_",), ("plain words",), (None,)], "text string")
    g = TX.churn_brief_guardrails(df, "text").select("flags", "n_flags")
    assert g._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    assert [(r[0], r[1]) for r in g.collect()] == [
        (["hallucinated_feature:made_up_feature", "hallucinated_feature:other_fake_thing"], 2), ([], 0), (None, None)]


def test_strip_compares_only_the_ends(spark):
    """No pattern runs over the whole text, and every kind of Python whitespace goes."""
    every = "".join(chr(i) for i in range(0x110000) if chr(i).isspace())
    df = spark.createDataFrame([(every + "a b" + every,), (every,), ("",), (None,), ("a\x00 ",)], "t string")
    got = df.select(TX.py_strip(F.col("t")).alias("s"))
    assert "regexp" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert [r[0] for r in got.collect()] == ["a b", "", "", None, "a\x00"]
