"""From chat requests to the rows of the turn log.

A request is answered with what its session stored before: identifiers, and how many turns were counted. One running
scan per session gives both, so a log is rebuilt, or a backlog of requests turned into log rows, in one pass. What the
language model said is a column of the requests; a null stands for a failed call and gives the fixed sentence.

`heavy` is `heavy_keys(requests, "session_id")`; `order` must tell any two requests of a session apart. Requests
without a session id belong to one session. Rows come out with the columns of the log, and `_id` from the request.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parleystat import schemas as S
from parleystat.functions import chat
from parleystat.functions.text import is_present, non_empty
from parleystat.functions.urls import avatar_session_id, parse_context, text_request_id
from parleystat.operators.scan import running
from parleystat.operators.skew import HeavyKeys
from parleystat.operators.turns import is_eligible

ORDER = ("request_time", "_id")


def _kept(value: Column, default: str) -> Column:
    """An identifier that later requests of the session may use: neither empty nor the default."""
    return F.when(is_present(value) & (value != default), value)


def _logged(scanned: DataFrame, article: Column, response: Column, variant: str) -> DataFrame:
    """Log rows from requests with `_input`, `_class` and `_prior`, the counted turns before."""
    turn, prior = F.col("_class") == "turn", F.col("_prior")
    reply = F.coalesce("reply", F.when(turn, F.lit(S.FAILED_REPLY)).otherwise(F.lit(S.FAILED_WELCOME)))
    number = F.when(turn, prior + 1).otherwise(F.lit(0)).cast("int")
    said = chat.final_reply(
        F.col("_input"), reply, is_eligible(turn, prior), chat.completion_code(F.col("session_id"), number), variant
    )
    return scanned.select(
        "_id",
        "session_id",
        article.alias("ArticleID"),
        response.alias("ResponseID"),
        number.alias("turn_number"),
        F.when(turn, F.col("_input")).otherwise(F.lit(S.TRIGGER_INPUT)).alias("user_input"),
        F.col("reply_time").alias("user_input_time"),
        said.alias("bot_response"),
        F.col("reply_time").alias("response_time"),
    )


def log_rows_text(requests: DataFrame, heavy: HeavyKeys, order: Sequence[str] = ORDER) -> DataFrame:
    """Log rows of the text chat, one per request.

    `requests`: `_id, session_id, request_time, user_message, article_id, response_id` (of the body), `query` (map of
    parameters), `referer, reply, reply_time`. A blank message or page metadata opens the chat: turn 0 with the
    trigger as input. An identifier comes from the body, else from what the session stored, else from query or
    referer. A stored one is replaced by a body's alone; query and referer are asked only while nothing is stored.
    """
    none = F.lit(None).cast("string")
    message = chat.stored_input(F.coalesce("user_message", F.lit("")), "text")
    rows = requests.withColumns(
        {
            "_input": message,
            "_class": chat.input_class(F.col("user_message"), "text"),
            **{f"_own_{n}": text_request_id(n, none, none, F.col("query"), F.col("referer")) for n in ("article_id", "response_id")},
        }
    )
    defaults = {"article_id": S.DEFAULT_ARTICLE_ID, "response_id": S.DEFAULT_RESPONSE_ID}
    counted = (F.col("_class") == "turn") & chat.is_counted(F.col("_input"))
    scanned = running(
        rows,
        heavy,
        order,
        sums={"_prior": counted},
        lasts={f"_asked_{n}": _kept(F.col(n), d) for n, d in defaults.items()},
        firsts={f"_found_{n}": F.when(~is_present(F.col(n)), _kept(F.col(f"_own_{n}"), d)) for n, d in defaults.items()},
    )
    article, response = (F.coalesce(non_empty(F.col(n)), f"_asked_{n}", f"_found_{n}", f"_own_{n}") for n in defaults)
    return _logged(scanned, article, response, "text")


def log_rows_avatar(requests: DataFrame, heavy: HeavyKeys, order: Sequence[str] = ORDER) -> DataFrame:
    """Log rows of the avatar chat, one per input that is not silent.

    `requests`: `_id, session_id, request_time, kind` ('session' or 'execute'), `context` (JSON) and `header_referer`
    of a session request, `text, reply, reply_time` of an execute request. Silent inputs go before anything is counted.
    Only session requests store identifiers: the last that is neither empty nor the default stays.
    """
    session = F.col("kind") == "session"
    silent = (F.col("kind") == "execute") & (chat.input_class(F.col("text"), "avatar") == "silent")
    context = F.col("_context")
    rows = (
        requests.where(F.col("kind").isin("session", "execute") & ~silent)
        .withColumn("_context", F.when(session, parse_context(F.col("context"))))
        .withColumns(
            {
                "_input": F.col("text"),
                "_class": F.when(session, "session").otherwise("turn"),
                "_own_article": F.when(session, avatar_session_id("article_id", context, F.col("header_referer"))),
                "_own_response": F.when(session, avatar_session_id("response_id", context, F.col("header_referer"))),
            }
        )
    )
    scanned = running(
        rows,
        heavy,
        order,
        sums={"_prior": ~session & chat.is_counted(F.col("_input"))},
        lasts={
            "_article": _kept(F.col("_own_article"), S.DEFAULT_ARTICLE_ID),
            "_response": _kept(F.col("_own_response"), S.DEFAULT_RESPONSE_ID),
        },
    )
    article = F.coalesce("_article", F.lit(S.DEFAULT_ARTICLE_ID))
    response = F.coalesce(non_empty(F.col("_response")), F.lit(S.DEFAULT_RESPONSE_ID))
    return _logged(scanned.where(F.col("_class") == "turn"), article, response, "avatar")
