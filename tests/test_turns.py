"""Turn-log operators against a record-by-record simulation in Python."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from parleystat import schemas as S
from parleystat.operators import turns as T
from parleystat.operators.messages import prompt_messages
from parleystat.operators.skew import heavy_keys

SCHEMA = (
    "_id long, session_id string, ArticleID string, ResponseID string, user_input string, bot_response string, "
    "response_time timestamp_ntz"
)
SKEWS = [{}, {"floor": 30, "max_heavy": 1000}, {"floor": 3, "max_heavy": 10_000}]
START = dt.datetime(2024, 1, 1)
ARTICLES = {"1": "first text", "5": "default text", "7": "", "3": "long " * 5000}


def make_log():
    rng = random.Random(11)
    data = []
    for i in range(900):
        session = rng.choice(["a", "a", "b", "c", "d", f"s{rng.randrange(40)}", None])
        user = rng.choice([f"say {i}", f"say {i}", S.TRIGGER_INPUT, None, "", " spaced ", "my code", "welcome"])
        bot = rng.choice([f"reply {i}", f"reply {i}", "", None, "the end"])
        article = rng.choice([None] * 12 + ["", "5", "1", "7", "3", "99"])
        response = rng.choice([None] * 8 + ["", "R1", "R2"])
        time = None if rng.random() < 0.02 else START + dt.timedelta(seconds=rng.randrange(400))
        data.append((i, session, article, response, user, bot, time))
    # A session with a long run of unusable turns between usable ones.
    for i in range(900, 1200):
        bot = "reply" if i % 100 == 0 or i > 1140 else ""
        data.append((i, "runs", None, None, f"say {i}", bot, START + dt.timedelta(seconds=i)))
    return data


LOG = make_log()


@pytest.fixture(scope="module")
def log(spark):
    return spark.createDataFrame(LOG, SCHEMA).repartition(6).persist()


def sessions():
    groups = {}
    for r in LOG:
        groups.setdefault(r[1], []).append(r)
    for group in groups.values():
        group.sort(key=lambda r: (r[6] is not None, r[6] or START, r[0]))
    return groups


def cut(items):
    return items[:5] + items[-45:] if len(items) > 50 else items


def usable(record):
    return bool(record[4]) and bool(record[5])


def simulate(variant):
    """id -> (turn number, eligible, article, response, messages)"""
    out = {}
    for group in sessions().values():
        article = response = None
        for place, record in enumerate(group):
            before = group[:place]
            counted_before = sum(r[4] != S.TRIGGER_INPUT for r in before)
            counted = record[4] != S.TRIGGER_INPUT
            asked = record[2] or None
            if variant == "avatar" and asked == "5":
                asked = None
            used_article = asked or article or "5"
            used_response = record[3] or response or ""
            article = used_article if used_article != "5" else article
            response = used_response or response
            context = ARTICLES.get(used_article, "")
            if variant == "text":
                past = [r for r in cut(before) if usable(r)]
                typed = (record[4] or "").strip()
                opens = not typed or typed.lower() == "page_metadata" or not counted
                current, silent = ("welcome" if opens else typed), False
                messages = [("system", "P")]
            else:
                past = cut([r for r in before if usable(r)])
                typed = record[4] or ""
                silent = not typed.strip() or typed.lower() in ("welcome", "page_metadata")
                current = typed
                messages = [("system", "P"), ("system", f"Current conversation turn: {counted_before + 1}")]
            if context:
                messages.append(("system", S.ARTICLE_PREFACE[variant] + context[:10000]))
            for r in past:
                messages += [("user", r[4]), ("assistant", r[5])]
            messages.append(("user", current))
            out[record[0]] = (
                counted_before + 1 if counted else 0,
                counted and counted_before >= 10,
                used_article,
                used_response,
                None if silent else messages,
            )
    return out


@pytest.mark.parametrize("skew", SKEWS)
@pytest.mark.parametrize("variant", S.VARIANTS)
def test_messages(spark, log, variant, skew):
    articles = spark.createDataFrame(list(ARTICLES.items()), "article_id string, text string")
    built = prompt_messages(log, articles, heavy_keys(log, "session_id", **skew), "P", variant)
    got = {r["_id"]: [(m["role"], m["content"]) for m in r["messages"]] for r in built.collect()}
    assert got == {i: v[4] for i, v in simulate(variant).items() if v[4] is not None}


@pytest.mark.parametrize("skew", SKEWS)
@pytest.mark.parametrize("variant", S.VARIANTS)
def test_numbers_and_sticky_ids(log, variant, skew):
    heavy = heavy_keys(log, "session_id", **skew)
    expected = simulate(variant)
    numbered = {r["_id"]: (r["turn_number"], r["eligible"]) for r in T.number_turns(log, heavy).collect()}
    assert numbered == {i: v[:2] for i, v in expected.items()}
    resolved = {r["_id"]: (r["article_id"], r["response_id"]) for r in T.sticky_ids(log, heavy, variant).collect()}
    assert resolved == {i: v[2:4] for i, v in expected.items()}


@pytest.mark.parametrize("skew", SKEWS)
@pytest.mark.parametrize("variant", S.VARIANTS)
def test_history(log, variant, skew):
    expected = set()
    for group in sessions().values():
        kept = [r for r in cut(group) if usable(r)] if variant == "text" else cut([r for r in group if usable(r)])
        expected |= {r[0] for r in kept}
    kept = T.history(log, heavy_keys(log, "session_id", **skew), variant).collect()
    assert {r["_id"] for r in kept} == expected
    assert len(kept) == len(expected)


def test_the_two_cuts_differ(log):
    heavy = heavy_keys(log, "session_id")
    text, avatar = ({r["_id"] for r in T.history(log, heavy, v).collect()} for v in S.VARIANTS)
    assert text != avatar


def test_latest(log):
    expected = {r[0] for group in sessions().values() for r in group[-7:] if usable(r)}
    assert {r["_id"] for r in T.latest(log, 7).collect()} == expected
    plan = T.latest(log, 7)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_counts_and_utterances(log):
    counts = {r["session_id"]: r["turn_count"] for r in T.turn_counts(log).collect()}
    assert counts == {k: sum(r[4] != S.TRIGGER_INPUT for r in g) for k, g in sessions().items()}
    spoken = T.utterances(log)
    assert spoken.count() == 2 * len(LOG)
    assert spoken.where("person_id = ''").count() == 0


def test_one_shuffle_for_messages(spark, log):
    articles = spark.createDataFrame(list(ARTICLES.items()), "article_id string, text string")
    built = prompt_messages(log, articles, heavy_keys(log, "session_id"), "P", "text")
    plan = built._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_small_blocks_are_exact(log):
    heavy = heavy_keys(log, "session_id", floor=3, max_heavy=10_000)
    positions = {r["_id"]: r["position"] for r in T.chronological(log, heavy).collect()}
    for group in sessions().values():
        assert [positions[r[0]] for r in group] == list(range(1, len(group) + 1))


@pytest.mark.parametrize("variant", S.VARIANTS)
def test_replies_without_a_session_id(log, variant):
    done = T.completion(log, heavy_keys(log, "session_id"), variant).where("eligible and bot_response is not null")
    assert done.count() > 100
    assert done.where("final_reply is null or code is null or code not between 0 and 10000").count() == 0
    asked = done.where("contains(lower(user_input), 'code')")
    assert asked.count() == asked.where("final_reply like 'Here\\'s your completion code: %'").count() > 0


def exchanges_above_the_history(frame) -> int:
    """Shuffles between the window that gathers histories and the result, by the indents of the plan."""
    lines = frame._jdf.queryExecution().executedPlan().toString().splitlines()
    at = next(i for i, line in enumerate(lines) if "Window" in line and "collect_list" in line)
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    above, low = 0, depth(lines[at])
    for line in reversed(lines[:at]):
        if depth(line) < low:
            low = depth(line)
            above += "Exchange" in line
    return above


@pytest.mark.parametrize("variant", ["text", "avatar"])
def test_contexts_join_before_histories(spark, log, variant):
    articles = spark.createDataFrame(list(ARTICLES.items()), "article_id string, text string")
    heavy = heavy_keys(log, "session_id")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shuffled = prompt_messages(log, articles, heavy, "Be kind.", variant, broadcast_rows=0)
        assert exchanges_above_the_history(shuffled) == 0
        rows = {r._id: r.messages for r in shuffled.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    sent = prompt_messages(log, articles, heavy, "Be kind.", variant)
    assert exchanges_above_the_history(sent) == 0
    assert rows == {r._id: r.messages for r in sent.collect()}
    # Popular articles and heavy sessions, without a broadcast of texts.
    split = prompt_messages(log, articles, heavy_keys(log, "session_id", floor=30, max_heavy=1000), "Be kind.", variant, broadcast_rows=0, floor=20)
    assert rows == {r._id: r.messages for r in split.collect()}
