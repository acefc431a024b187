import unicodedata

from pyspark.sql import functions as F

from evisift.functions.text import casefold, collapse_spaces, has_injection_marker, security_text, tokens

TEXTS = [
    "Plain ASCII  text", "STRAẞE Straße", "ﬁne ＦＵＬＬ width", "İstanbul K", "a​b‌c‍d",
    "tab\tand nbsp em\x1cfs", "", "Ｍａｒｋ every  CONTROL​ satisfied",
]


def test_matches_python(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(99, None)], "i int, t string")
    t = F.col("t")
    rows = {
        r["i"]: r for r in df.select(
            "i", casefold(t).alias("fold"), collapse_spaces(t).alias("flat"), security_text(t).alias("sec"),
            has_injection_marker(security_text(t)).alias("hit"), tokens(t).alias("tokens"),
        ).collect()
    }
    for i, text in enumerate(TEXTS):
        assert rows[i]["fold"] == text.casefold()
        assert rows[i]["flat"] == " ".join(text.split())
        want = unicodedata.normalize("NFKC", text).casefold()
        for mark in "​‌‍":
            want = want.replace(mark, "")
        assert rows[i]["sec"] == " ".join(want.split())
    assert rows[7]["hit"] and not rows[0]["hit"]
    assert set(rows[1]["tokens"]) == {"strasse"}
    assert rows[99]["fold"] is None and rows[99]["sec"] is None


def test_plain_texts_skip_the_pattern(spark):
    """Each white-space character of ASCII still collapses; the pattern used to run on every text."""
    texts = [f"A{sep}b {sep} c{sep}" for sep in " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f"] + [" one  two ", "one two", " one", "", "a\x00b"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    out = df.select("i", collapse_spaces(F.col("t")), security_text(F.col("t")))
    assert sorted(map(tuple, out.collect())) == [(i, " ".join(t.split()), " ".join(t.lower().split())) for i, t in enumerate(texts)]
    plan = df.select(security_text(F.col("t")).alias("s"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("CASE WHEN") < plan.index("trim(lower(") < plan.index("regexp_replace(")
