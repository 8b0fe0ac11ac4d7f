"""Chat turn logs: counting, numbering, history, sticky identifiers, completion codes.

`heavy` is always `heavy_keys(turns, "session_id")`; `order` must tell any two turns of a session apart.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parleystat import schemas as S
from parleystat.functions import chat
from parleystat.functions.text import non_empty
from parleystat.operators.scan import running
from parleystat.operators.skew import HeavyKeys

ORDER = ("response_time", "_id")


def turn_counts(turns: DataFrame) -> DataFrame:
    """Counted turns per session."""
    return turns.groupBy("session_id").agg(F.count_if(chat.is_counted(F.col("user_input"))).alias("turn_count"))


def _number(counted: Column, prior: Column) -> Column:
    return F.when(counted, prior + 1).otherwise(F.lit(0).cast("long"))


def is_eligible(counted: Column, prior: Column) -> Column:
    """A code is due once ten counted turns came before this one."""
    return counted & (prior >= S.MIN_TURNS_FOR_CODE)


def number_turns(turns: DataFrame, heavy: HeavyKeys, order: Sequence[str] = ORDER) -> DataFrame:
    """Add `prior_turns` (counted turns before this one), `turn_number` (0 for triggers), `eligible`."""
    counted = chat.is_counted(F.col("user_input"))
    scanned = running(turns, heavy, order, sums={"prior_turns": counted.cast("long")})
    return scanned.withColumns(
        {
            "turn_number": _number(counted, F.col("prior_turns")),
            "eligible": is_eligible(counted, F.col("prior_turns")),
        }
    )


def stored_ids() -> dict[str, Column]:
    """What a turn leaves behind for later turns: a non-default article, a non-empty response id."""
    article = non_empty(F.col("ArticleID"))
    return {
        "stored_article": F.when(article != S.DEFAULT_ARTICLE_ID, article),
        "stored_response": non_empty(F.col("ResponseID")),
    }


def resolved_ids(stored_article: Column, stored_response: Column, variant: str) -> dict[str, Column]:
    """The text chat lets a request name the default article for one turn; the avatar chat does not."""
    asked = non_empty(F.col("ArticleID"))
    if S.check_variant(variant) == "avatar":
        asked = F.nullif(asked, F.lit(S.DEFAULT_ARTICLE_ID))
    return {
        "article_id": F.coalesce(asked, stored_article, F.lit(S.DEFAULT_ARTICLE_ID)),
        "response_id": F.coalesce(
            non_empty(F.col("ResponseID")), stored_response, F.lit(S.DEFAULT_RESPONSE_ID)
        ),
    }


def sticky_ids(
    turns: DataFrame, heavy: HeavyKeys, variant: str = "text", order: Sequence[str] = ORDER
) -> DataFrame:
    """Resolve each turn's article and response id from its own request and the session's memory.

    `ArticleID` and `ResponseID` are what the request carried. Memory is per session.
    """
    scanned = running(turns, heavy, order, lasts=stored_ids())
    return scanned.withColumns(
        resolved_ids(F.col("stored_article"), F.col("stored_response"), variant)
    ).drop("stored_article", "stored_response")


def chronological(turns: DataFrame, heavy: HeavyKeys, order: Sequence[str] = ORDER) -> DataFrame:
    """Add the 1-based `position` of each record in its session."""
    scanned = running(turns, heavy, order, sums={"position": F.lit(1)})
    return scanned.withColumn("position", F.col("position") + 1)


def latest(turns: DataFrame, limit: int, order: Sequence[str] = ORDER) -> DataFrame:
    """The usable turns among the latest `limit` records of each session; `recency` 1 is the newest.

    The rank filter limits each map task's output before the shuffle, so no session arrives whole.
    """
    newest = Window.partitionBy("session_id").orderBy(*[F.col(name).desc_nulls_last() for name in order])
    kept = turns.withColumn("recency", F.row_number().over(newest)).where(F.col("recency") <= limit)
    return kept.where(chat.is_usable(F.col("user_input"), F.col("bot_response")))


def history(
    turns: DataFrame, heavy: HeavyKeys, variant: str = "text", order: Sequence[str] = ORDER
) -> DataFrame:
    """What a session's prompt would hold now: at most the first 5 and last 45 turns, usable ones only.

    The text chat cuts first and drops unusable records after; the avatar chat does it the other way.
    `position` counts the records (text) or the usable ones (avatar).
    """
    usable = chat.is_usable(F.col("user_input"), F.col("bot_response"))
    if S.check_variant(variant) == "avatar":
        turns = turns.where(usable)
    scanned = running(turns, heavy, order, sums={"position": F.lit(1)}, totals={"records": F.lit(1)})
    scanned = scanned.withColumn("position", F.col("position") + 1)
    in_range = (
        (F.col("records") <= S.HISTORY_LIMIT)
        | (F.col("position") <= S.HISTORY_HEAD)
        | (F.col("position") > F.col("records") - S.HISTORY_TAIL)
    )
    return scanned.where(in_range & usable).drop("records")


def completion(
    turns: DataFrame, heavy: HeavyKeys, variant: str = "text", order: Sequence[str] = ORDER
) -> DataFrame:
    """Number the turns, draw the codes and rewrite the replies of eligible turns."""
    numbered = number_turns(turns, heavy, order)
    code = chat.completion_code(F.col("session_id"), F.col("turn_number"))
    return numbered.withColumn("code", F.when(F.col("eligible"), code)).withColumn(
        "final_reply",
        chat.final_reply(F.col("user_input"), F.col("bot_response"), F.col("eligible"), F.col("code"), variant),
    )


def utterances(turns: DataFrame) -> DataFrame:
    """One row per side of a turn, with the response id as the person."""
    sides = F.array(F.col("user_input"), F.col("bot_response"))
    return turns.select(non_empty(F.col("ResponseID")).alias("person_id"), F.explode(sides).alias("text"))
