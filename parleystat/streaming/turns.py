"""Turn numbers, eligibility and sticky identifiers as stateful streams.

State per session is one count and two short strings, and only narrow columns reach Python. Sessions share one of
`BUCKETS` state entries by their hash: Python is called once for a bucket's rows of a micro-batch and works on its
sessions together, since a call costs some 10 ms however few rows it has. A bucket's rows of one micro-batch meet in
one task, so the source must bound the micro-batch (`maxBytesPerTrigger`). To work off a large backlog in large
micro-batches, use `replay`.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from parleystat import schemas as S
from parleystat.functions import chat
from parleystat.operators.turns import ORDER, resolved_ids, stored_ids

#: State entries, each with the sessions of some hashes. A checkpoint holds for one number of them.
BUCKETS = 1024
#: Per session of a bucket, in one order.
_STATE = T.StructType(
    [
        T.StructField("sessions", T.ArrayType(T.StringType())),
        T.StructField("turns", T.ArrayType(T.LongType())),
        T.StructField("articles", T.ArrayType(T.StringType())),
        T.StructField("responses", T.ArrayType(T.StringType())),
    ]
)


def narrow_turns(turns: DataFrame, order: Sequence[str]) -> DataFrame:
    """What numbering and identifiers need of a turn."""
    return turns.select(
        "session_id",
        *order,
        "ArticleID",
        "ResponseID",
        chat.is_counted(F.col("user_input")).alias("counted"),
        *[value.alias(name) for name, value in stored_ids().items()],
    )


def followed_columns(followed: DataFrame, variant: str, order: Sequence[str]) -> DataFrame:
    """The published columns, from what came before each turn."""
    prior = F.col("prior_turns")
    ids = resolved_ids(F.col("prior_stored_article"), F.col("prior_stored_response"), variant)
    return followed.select(
        "session_id",
        *order,
        prior,
        F.when(F.col("counted"), prior + 1).otherwise(F.lit(0).cast("long")).alias("turn_number"),
        (F.col("counted") & (prior >= S.MIN_TURNS_FOR_CODE)).alias("eligible"),
        *[value.alias(name) for name, value in ids.items()],
    )


def _follow(order: list[str]):
    def before(values: pd.Series, first: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What each row's session held before it, where a missing value changes nothing, and what it holds after it.
        `first` is where the row's session begins, and `held` what the session held at first."""
        rows = np.arange(len(values))
        last = np.maximum.accumulate(np.where(values.notna(), rows, -1))
        taken = values.to_numpy(dtype=object)
        earlier = np.append(-1, last[:-1])
        return np.where(earlier >= first, taken[earlier], held), np.where(last >= first, taken[last], held)

    def follow(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known, turns, articles, responses = state.get if state.exists else ([], [], [], [])
        parts = list(chunks)
        rows = parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)
        # Sessions are numbered as the state has them, new ones after those.
        named = np.concatenate([np.array(known, dtype=object), rows.pop("state_session").to_numpy(dtype=object)])
        numbers, sessions = pd.factorize(named)
        new = len(sessions) - len(known)
        turns = np.array([*turns, *[0] * new], dtype="int64")
        articles, responses = (np.array([*x, *[None] * new], dtype=object) for x in (articles, responses))
        rows["state_bucket"] = numbers[len(known) :]
        rows = rows.sort_values(["state_bucket", *order], kind="stable", na_position="first", ignore_index=True)
        mine = rows.pop("state_bucket").to_numpy()
        opens = np.append(True, mine[1:] != mine[:-1])
        closes = np.append(opens[1:], True)
        first = np.flatnonzero(opens)[np.cumsum(opens) - 1]
        counted = rows["counted"].to_numpy(dtype="int64")
        prior = np.cumsum(counted) - counted
        prior += turns[mine] - prior[first]
        held_article, article = before(rows.pop("stored_article"), first, articles[mine])
        held_response, response = before(rows.pop("stored_response"), first, responses[mine])
        rows["prior_turns"] = prior
        rows["prior_stored_article"] = held_article
        rows["prior_stored_response"] = held_response
        ended = mine[closes]
        turns[ended] = (prior + counted)[closes]
        articles[ended], responses[ended] = article[closes], response[closes]
        state.update((list(sessions), turns.tolist(), articles.tolist(), responses.tolist()))
        yield rows

    return follow


def follow_turns(turns: DataFrame, variant: str = "text", order: Sequence[str] = ORDER) -> DataFrame:
    """Number each arriving turn, say whether a code is due, and resolve its identifiers.

    Turns of a session are taken in `order` within a micro-batch and in arrival order across them.
    """
    narrow = narrow_turns(turns, order)
    kept = [f for f in narrow.schema if f.name not in ("stored_article", "stored_response")]
    schema = T.StructType(
        kept
        + [
            T.StructField("prior_turns", T.LongType()),
            T.StructField("prior_stored_article", T.StringType()),
            T.StructField("prior_stored_response", T.StringType()),
        ]
    )
    session = F.col("session_id")
    bucket = F.when(session.isNull(), -1).otherwise(F.pmod(F.xxhash64(session), F.lit(BUCKETS)))
    named = F.coalesce(session.cast("string"), F.lit(""))  # turns without a session have a bucket of their own
    dealt = narrow.withColumns({"state_session": named, "state_bucket": bucket.cast("int")})
    followed = dealt.groupBy("state_bucket").applyInPandasWithState(
        _follow(list(order)), schema, _STATE, "append", GroupStateTimeout.NoTimeout
    )
    return followed_columns(followed, variant, order)
