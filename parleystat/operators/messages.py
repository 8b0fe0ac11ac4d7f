"""The message list a chat model would receive for each turn."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parleystat import schemas as S
from parleystat.functions import chat
from parleystat.operators.articles import BROADCAST_ARTICLES, contexts_of, may_be_sent, with_context, with_session_context
from parleystat.operators.scan import running
from parleystat.operators.skew import HeavyKeys
from parleystat.operators.turns import ORDER, resolved_ids, stored_ids


def _spread(rows: DataFrame, heavy: HeavyKeys, contributes: Column) -> DataFrame:
    """Cut heavy sessions into blocks, and hand each block the earlier turns its rows can look back on.

    A block is a range of `prior` (history entries so far), split into lanes by record number where
    many rows share that range. A history entry goes to every lane of its block; one of the last 50 of
    a block also to the next block, and one of the first 5 to all later blocks. `_own` marks the one
    copy that stands for the row itself.
    """
    size = max(heavy.limit, S.HISTORY_LIMIT)
    own = rows.withColumns(
        {
            "_block": F.floor(F.col("prior") / size).cast("int"),
            "_lane": F.floor(F.col("prior_records") / size).cast("int"),
        }
    )
    blocks = (
        heavy.only(own)
        .groupBy("session_id", "_block")
        .agg(F.min("_lane").alias("low"), F.max("_lane").alias("high"))
        .groupBy(F.col("session_id").alias("_session"))
        .agg(F.sort_array(F.collect_list(F.struct(F.col("_block").alias("block"), "low", "high"))).alias("blocks"))
    )
    placed = own.join(F.broadcast(blocks), F.col("session_id").eqNullSafe(F.col("_session")), "left")

    def lanes(wanted: Column) -> Column:
        return F.flatten(
            F.transform(
                wanted,
                lambda b: F.transform(
                    F.sequence(b["low"], b["high"]), lambda lane: F.struct(b["block"].alias("block"), lane.alias("lane"))
                ),
            )
        )

    here = F.struct(F.col("_block").alias("block"), F.col("_lane").alias("lane"))
    late = F.col("prior") % size >= size - S.HISTORY_LIMIT
    reach = (
        F.when(F.col("prior") < S.HISTORY_HEAD, F.size("blocks"))
        .when(late, F.lit(2))
        .otherwise(F.lit(1))
    )
    wanted = F.slice("blocks", F.col("_block") + 1, reach)
    targets = F.when(F.col("blocks").isNotNull() & contributes, lanes(wanted)).otherwise(F.array(here))
    copies = placed.withColumn("_at", F.explode(targets))
    return copies.withColumn("_own", F.col("_at") == here).drop("_session", "blocks", "_block", "_lane")


def _with_history(rows: DataFrame, heavy: HeavyKeys, contributes: Column, entry: Column) -> DataFrame:
    """Add `history`: the entries before each row, or the first 5 and last 45 where there are over 50.

    `prior` is the number of entries before the row, so the window needs only bounded value ranges.
    """
    keys = ["session_id"]
    if heavy:
        rows = _spread(rows, heavy, contributes)
        keys.append("_at")
    ordered = Window.partitionBy(*keys).orderBy("prior")
    kept = F.when(contributes, entry)
    head = F.when(contributes & (F.col("prior") < S.HISTORY_HEAD), entry)
    found = rows.withColumns(
        {
            "_recent": F.collect_list(kept).over(ordered.rangeBetween(-S.HISTORY_LIMIT, -1)),
            "_first": F.collect_list(head).over(ordered.rangeBetween(Window.unboundedPreceding, -1)),
        }
    )
    if heavy:
        found = found.where("_own").drop("_own", "_at")
    skipped = S.HISTORY_LIMIT - S.HISTORY_TAIL
    cut = F.concat("_first", F.slice("_recent", skipped + 1, S.HISTORY_TAIL))
    chosen = F.when(F.col("prior") > S.HISTORY_LIMIT, cut).otherwise(F.col("_recent"))
    return found.withColumn("history", chosen).drop("_recent", "_first")


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def prompt_messages(
    turns: DataFrame,
    articles: DataFrame,
    heavy: HeavyKeys,
    system_prompt: str,
    variant: str = "text",
    order: Sequence[str] = ORDER,
    broadcast_rows: int = BROADCAST_ARTICLES,
    **skew: int,
) -> DataFrame:
    """Add `messages`, an array of (role, content): the system prompt, the turn number (avatar only),
    the article where it has a text, the bounded history, and the input.

    Silent inputs get no messages. A blank input of the text chat asks for the welcome reply.
    """
    user, bot = F.col("user_input"), F.col("bot_response")
    usable = chat.is_usable(user, bot)
    if S.check_variant(variant) == "avatar":
        contributes = usable
        asked = chat.input_class(user, variant) == "turn"
        current = user
    else:
        contributes = F.lit(True)
        asked = F.lit(True)
        opens = (chat.input_class(user, variant) == "welcome") | ~chat.is_counted(user)
        current = F.when(opens, S.WELCOME_INPUT).otherwise(chat.stored_input(user, variant))
    scanned = running(
        turns,
        heavy,
        order,
        sums={
            "prior": contributes.cast("long"),
            "prior_records": F.lit(1),
            "prior_turns": chat.is_counted(user).cast("long"),
        },
        lasts=stored_ids(),
    ).withColumns(resolved_ids(F.col("stored_article"), F.col("stored_response"), variant))
    # An unusable record of the text chat takes up a place in the history but says nothing there.
    pair = F.array(_message("user", user), _message("assistant", bot))
    entry = F.when(usable, pair).otherwise(F.array().cast(S.MESSAGES))
    rows = scanned.drop("stored_article", "stored_response")
    # A history is fifty turns wide. A text that can't be sent to all tasks joins its turn before that.
    sent = may_be_sent(contexts_of(articles), broadcast_rows)
    if not sent:
        rows = with_session_context(rows, articles, heavy, ("session_id", *order), **skew)
    rows = _with_history(rows, heavy, contributes, entry).where(asked)
    if sent:
        rows = with_context(rows, articles, ("session_id", *order), broadcast_rows=broadcast_rows)

    opening = [F.array(_message("system", F.lit(system_prompt)))]
    if variant == "avatar":
        number = (F.col("prior_turns") + 1).cast("string")
        opening.append(F.array(_message("system", F.concat(F.lit(S.TURN_PREFACE), number))))
    article = _message("system", F.concat(F.lit(S.ARTICLE_PREFACE[variant]), F.col("article_text")))
    opening.append(F.coalesce(F.when(F.col("article_text") != "", F.array(article)), F.array().cast(S.MESSAGES)))
    closing = F.array(_message("user", current))
    return rows.withColumn("messages", F.concat(*opening, F.flatten("history"), closing)).drop(
        "history", "article_text", "prior", "prior_records", "prior_turns"
    )
