"""Requests to log rows against a request-by-request simulation in Python."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import random
from urllib.parse import parse_qs, urlparse

import pytest

from parleystat import schemas as S
from parleystat.operators.requests import log_rows_avatar, log_rows_text
from parleystat.operators.skew import heavy_keys

START = dt.datetime(2024, 1, 1)
SKEWS = [{}, {"floor": 30, "max_heavy": 1000}, {"floor": 3, "max_heavy": 10_000}]
URLS = [
    None, "", "https://h/p?article_id=7&response_id=R1", "https://h/p?article_id=&x=1", "https://h/#article_id=3", "https://h/p?x=article_id=",
    "https://h/p?response_id=%41+b", "https://h/p?article_id=5",
]
MESSAGES = ["hi", " hi ", "my Code", "", "  \t", None, "page_metadata", " Page_Metadata ", "Welcome", S.TRIGGER_INPUT, "é ok"]
REPLIES = ["fine", "fine", "the end", "Completion Code soon", None, "", "finish it"]
TEXT = (
    "_id long, session_id string, request_time timestamp_ntz, user_message string, article_id string, response_id string, "
    "query map<string,string>, referer string, reply string, reply_time timestamp_ntz, n int"
)
AVATAR = (
    "_id long, session_id string, request_time timestamp_ntz, kind string, context string, header_referer string, text string, "
    "reply string, reply_time timestamp_ntz"
)


def times(rng, i):
    return None if rng.random() < 0.02 else START + dt.timedelta(seconds=rng.randrange(300)), START + dt.timedelta(hours=1, seconds=i)


def text_requests():
    rng, rows = random.Random(4), []
    for i in range(900):
        asked, told = times(rng, i)
        rows.append((
            i, rng.choice(["a", "a", "b", f"s{rng.randrange(30)}", None]), asked, rng.choice(MESSAGES),
            rng.choice([None] * 6 + ["", "5", "1", "7"]), rng.choice([None] * 6 + ["", "B1", "B2"]),
            rng.choice([None, None, {}, {"article_id": "q2"}, {"article_id": ""}, {"response_id": "Q"}]), rng.choice(URLS), rng.choice(REPLIES), told, 1,
        ))
    return rows


def avatar_requests():
    rng, rows = random.Random(5), []
    for i in range(900):
        asked, told = times(rng, i)
        context = {f: rng.choice(URLS) for f in ("pageUrl", "url", "referer") if rng.random() < 0.3}
        context |= {"queryParams": {"article_id": rng.choice(["", "2", "5"])}} if rng.random() < 0.3 else {}
        context["client"] = {f: rng.choice(URLS) for f in ("pageUrl", "url") if rng.random() < 0.3}
        context["client"] |= {"queryParams": {"response_id": rng.choice(["", "C"])}} if rng.random() < 0.3 else {}
        rows.append((
            i, rng.choice(["a", "a", "b", f"s{rng.randrange(30)}", None]), asked, rng.choice(["session", "execute", "execute", "execute"]),
            rng.choice([json.dumps(context)] * 4 + [None]), rng.choice(URLS), rng.choice(MESSAGES), rng.choice(REPLIES), told,
        ))
    return rows


def by_session(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    return [sorted(g, key=lambda r: (r[2] is not None, r[2] or START, r[0])) for g in groups.values()]


def from_url(url, name):
    return parse_qs(urlparse(url).query).get(name, [None])[0]


def answered(session, number, before, said, reply, variant):
    digest = hashlib.md5(f"{session or ''}#{number}".encode()).hexdigest()
    low = reply.lower()
    if before < 10:
        return reply
    if "code" in said.lower():
        return f"{S.CODE_SENTENCE[0]}{int(digest[:8], 16) % 10001}{S.CODE_SENTENCE[1]}"
    if "completion code" in low or variant == "avatar" and ("end" in low or "finish" in low):
        return reply
    return reply + S.CODE_HINT


def simulate_text(rows):
    out = []
    for group in by_session(rows):
        stored, counted = {"article_id": None, "response_id": None}, 0
        for _id, session, _, message, article, response, query, referer, reply, told, _ in group:
            message, ids = (message or "").strip(), {}
            for name, body, default in (("article_id", article, "5"), ("response_id", response, "")):
                if body:
                    ids[name] = body
                elif stored[name]:
                    ids[name] = stored[name]
                elif name in (query or {}):
                    ids[name] = query[name]
                elif referer and f"{name}=" in referer:
                    ids[name] = from_url(referer, name)
                else:
                    ids[name] = default
                if ids[name] != default and (name == "article_id" or ids[name]):
                    stored[name] = ids[name]
            if not message or message.lower() == "page_metadata":
                row = (0, S.TRIGGER_INPUT, S.FAILED_WELCOME if reply is None else reply)
            else:
                row = (counted + 1, message, answered(session, counted + 1, counted, message, S.FAILED_REPLY if reply is None else reply, "text"))
                counted += message != S.TRIGGER_INPUT
            out.append((_id, session, ids["article_id"], ids["response_id"], row[0], row[1], told, row[2], told))
    return sorted(out, key=lambda r: r[0])


def simulate_avatar(rows):
    def found(context, header, name):
        client = context.get("client", {})
        for place in (context, client):
            if place.get("queryParams", {}).get(name):
                return place["queryParams"][name]
        for field in ("pageUrl", "url", "referer"):
            url = context.get(field) or client.get(field)
            if url and f"{name}=" in url and from_url(url, name):
                return from_url(url, name)
        return from_url(header, name) if header and f"{name}=" in header else None

    out = []
    for group in by_session(rows):
        article, response, counted = None, None, 0
        for _id, session, _, kind, context, header, text, reply, told in group:
            if kind == "session":
                context = json.loads(context) if context else {}
                asked = found(context, header, "article_id")
                article = asked if asked and asked != "5" else article
                response = found(context, header, "response_id") or response
            elif (text or "").strip() and text.lower() not in ("welcome", "page_metadata"):
                said = answered(session, counted + 1, counted, text, S.FAILED_REPLY if reply is None else reply, "avatar")
                out.append((_id, session, article or "5", response or "", counted + 1, text, told, said, told))
                counted += text != S.TRIGGER_INPUT
    return sorted(out, key=lambda r: r[0])


@pytest.mark.parametrize("skew", SKEWS)
@pytest.mark.parametrize("variant", S.VARIANTS)
def test_rows_are_what_the_server_would_log(spark, variant, skew):
    made, schema = (text_requests(), TEXT) if variant == "text" else (avatar_requests(), AVATAR)
    to_log, want = (log_rows_text, simulate_text) if variant == "text" else (log_rows_avatar, simulate_avatar)
    asked = spark.createDataFrame(made, schema).repartition(5).persist()
    rows = to_log(asked, heavy_keys(asked, "session_id", **skew))
    assert [f.name for f in S.TURN_LOG] == rows.columns
    assert sorted((tuple(r) for r in rows.collect()), key=lambda r: r[0]) == want(made)


@pytest.mark.parametrize("variant", S.VARIANTS)
def test_no_requests(spark, variant):
    schema, to_log = (TEXT, log_rows_text) if variant == "text" else (AVATAR, log_rows_avatar)
    asked = spark.createDataFrame([], schema)
    assert to_log(asked, heavy_keys(asked, "session_id")).collect() == []
