"""Column expressions against plain Python and hand-worked cases."""

from __future__ import annotations

from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from parleystat import schemas as S
from parleystat.functions import chat, scores, text, urls

SPACES = [c for c in map(chr, range(0x110000)) if c.isspace()]
TEXTS = [
    None, "", " ", "a", " a ", "a b", "\n a\tb \r\n", "x" + "".join(SPACES) + "y", "".join(SPACES), "a​b", "é è",
    *[f"a{c}b" for c in SPACES], *[f"{c}a{c}" for c in SPACES], "\U0001f600 \U0001f600", "NA None",
]


def one(spark, rows, schema, *columns):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema).select("i", *columns).orderBy("i").collect()


def test_tokens_and_strip_follow_python(spark):
    got = one(
        spark, [(t,) for t in TEXTS], "t string",
        text.count_tokens(F.col("t")).alias("n"), text.strip(F.col("t")).alias("s"), text.is_blank(F.col("t")).alias("b"),
    )
    assert len(SPACES) == 29
    assert [r["n"] for r in got] == [0 if t is None else len(t.split()) for t in TEXTS]
    assert [r["s"] for r in got] == [None if t is None else t.strip() for t in TEXTS]
    assert [r["b"] for r in got] == [not (t or "").strip() for t in TEXTS]


def test_prefix_counts_code_points(spark):
    row = one(spark, [("\U0001f600" * 5,)], "t string", text.prefix(F.col("t"), 3).alias("p"))[0]
    assert row["p"] == "\U0001f600" * 3


URLS = [
    "?article_id=", "?article_id=&article_id=7", "?xarticle_id=3", "?response_id=a%20b+c", "#article_id=4",
    "not a url ?article_id=9", None, "https://h/p?a=1&article_id=8#article_id=2", "https://h/p#x?article_id=3",
    "https://h/?article_id=1=2", "https://h/?article_id", "https://h/?article_id=%zz%41", "https://h/?article%5Fid=6",
    "https://h/?response_id=caf%C3%A9&article_id=3", "", "https://h/?a?article_id=5&article_id=6", "?article_id=a\nb",
]


@pytest.mark.parametrize("name", ["article_id", "response_id"])
def test_query_param_follows_parse_qs(spark, name):
    got = one(spark, [(u,) for u in URLS], "u string", urls.query_param(F.col("u"), name).alias("v"))
    assert [r["v"] for r in got] == [parse_qs(urlparse(u or "").query).get(name, [None])[0] for u in URLS]


def test_text_request_precedence(spark):
    rows = [
        ("b", "s", {"article_id": "q"}, "?article_id=r"),
        ("", "s", {"article_id": "q"}, "?article_id=r"),
        (None, None, {"article_id": "q"}, "?article_id=r"),
        (None, "", {"article_id": ""}, "?article_id=r"),
        (None, None, {"other": "q"}, "?article_id=r"),
        (None, None, None, "#article_id=r"),
        (None, None, None, "https://h/"),
        (None, None, None, None),
    ]
    column = urls.text_request_id("article_id", *[F.col(c) for c in ("b", "s", "q", "r")])
    got = one(spark, rows, "b string, s string, q map<string,string>, r string", column.alias("v"))
    assert [r["v"] for r in got] == ["b", "s", "q", "", "r", None, "5", "5"]


def test_avatar_context_precedence(spark):
    rows = [
        ('{"queryParams": {"article_id": "1"}, "url": "?article_id=2"}', None),
        ('{"queryParams": {"article_id": ""}, "client": {"queryParams": {"article_id": 3}}}', None),
        ('{"pageUrl": "https://h/#article_id=4", "url": "https://h/?article_id=5x"}', None),
        ('{"client": {"referer": "https://h/?article_id=6"}}', "https://h/?article_id=7"),
        ('{"pageUrl": "https://h/?a=1", "client": {"pageUrl": "https://h/?article_id=8"}}', "https://h/?article_id=7"),
        ("{}", "https://h/?article_id=7"),
        ("{}", None),
        ("not json", None),
    ]
    context = urls.parse_context(F.col("c"))
    got = one(
        spark, rows, "c string, h string",
        urls.avatar_session_id("article_id", context, F.col("h")).alias("a"),
        urls.avatar_session_id("response_id", context, F.col("h")).alias("r"),
    )
    assert [r["a"] for r in got] == ["1", "3", "5x", "6", "7", "7", "5", "5"]
    assert {r["r"] for r in got} == {""}


def test_means_skip_missing_but_scores_do_not(spark):
    names = list(S.EMPATHY_ITEMS) + list(S.EXTRAVERSION_PLUS + S.EXTRAVERSION_MINUS)
    rows = [(1, 2, 3, 4, 6, 5, 4, 1, 2), (None, 2, None, 4, 6, 5, 4, 1, None), (None,) * 5 + (1, 1, 5, 5)]
    got = one(
        spark, rows, ", ".join(f"{n} int" for n in names),
        scores.empathy_mean().alias("m"), scores.extraversion().alias("e"),
    )
    assert [r["m"] for r in got] == [3.2, 4.0, None]
    assert [r["e"] for r in got] == [1.5, None, -2.0]


def test_significance_and_rounding(spark):
    rows = [(0.0499,), (0.05,), (0.0999,), (0.1,), (float("nan"),)]
    got = one(spark, rows, "p double", scores.significance(F.col("p")).alias("s"))
    assert [r["s"] for r in got] == ["*", "**", "**", "ns", "ns"]
    import numpy as np

    values = [0.00005, 0.00015, 0.12345, 2.00025, -1.00005, 1.23455, 3.0, 1e9 + 0.00005]
    got = one(spark, [(v,) for v in values], "v double", scores.round_half_even(F.col("v")).alias("r"))
    assert [r["r"] for r in got] == [float(np.round(v, 4)) for v in values]


def test_input_classes(spark):
    rows = [("hi",), ("",), ("  ",), ("page_metadata",), (" Page_Metadata ",), ("welcome",), (" welcome",), (None,)]
    got = one(
        spark, rows, "u string",
        chat.input_class(F.col("u"), "text").alias("t"), chat.input_class(F.col("u"), "avatar").alias("a"),
    )
    assert [r["t"] for r in got] == ["turn", "welcome", "welcome", "welcome", "welcome", "turn", "turn", "welcome"]
    assert [r["a"] for r in got] == ["turn", "silent", "silent", "silent", "turn", "silent", "turn", "silent"]
    with pytest.raises(ValueError):
        chat.input_class(F.col("u"), "voice")


def test_final_reply_and_issued_code(spark):
    rows = [
        ("my CODE", "ok", True, 7), ("my CODE", "ok", False, 7), ("hello", "ok", True, 7),
        ("hello", "Completion Code soon", True, 7), ("hello", "dear friend", True, 7),
    ]
    reply = [F.col(c) for c in ("u", "b", "e", "c")]
    got = one(
        spark, rows, "u string, b string, e boolean, c long",
        chat.final_reply(*reply, "text").alias("t"), chat.final_reply(*reply, "avatar").alias("a"),
        chat.issued_code(chat.final_reply(*reply, "text")).alias("n"),
    )
    given = "Here's your completion code: 7. Thank you for participating in this experiment!"
    assert [r["t"] for r in got] == [
        given, "ok", "ok" + S.CODE_HINT, "Completion Code soon", "dear friend" + S.CODE_HINT,
    ]
    assert [r["a"] for r in got] == [given, "ok", "ok" + S.CODE_HINT, "Completion Code soon", "dear friend"]
    assert [r["n"] for r in got] == [7, None, None, None, None]


def test_codes_cover_the_range(spark):
    drawn = spark.range(20000).select(
        chat.completion_code(F.lit("s"), F.col("id")).alias("c")
    ).agg(F.min("c").alias("low"), F.max("c").alias("high"), F.avg("c").alias("mean")).first()
    assert drawn["low"] == 0 or drawn["low"] < 20
    assert 9980 < drawn["high"] <= 10000
    assert 4900 < drawn["mean"] < 5100


def test_missing_input_counts_as_a_turn(spark):
    got = one(spark, [(None,), ("",), (S.TRIGGER_INPUT,)], "u string", chat.is_counted(F.col("u")).alias("c"))
    assert [r["c"] for r in got] == [True, True, False]
