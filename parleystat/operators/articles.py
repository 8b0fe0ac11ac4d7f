"""Article corpora and article context."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parleystat import schemas as S
from parleystat.functions.text import prefix
from parleystat.operators.skew import HeavyKeys, has_at_most, heavy_keys, salted_lookup_join

# What may be sent to every task: so many rows at most, and of those so many bytes of cut texts and ids, as measured.
BROADCAST_ARTICLES = 100_000
BROADCAST_BYTES = 64 << 20


def last_of_each(articles: DataFrame, position: Sequence[str]) -> DataFrame:
    """One text per article id: the last one wins."""
    at = F.struct(*[F.col(name) for name in position])
    # The struct around the text lets a null text win, too.
    newest = F.max_by(F.struct("text"), at)
    return articles.groupBy("article_id").agg(newest.alias("newest")).select("article_id", "newest.text")


def contexts_of(articles: DataFrame, chars: int = S.MAX_ARTICLE_CHARS) -> DataFrame:
    """`article_id, article_text`: the first `chars` characters of each article."""
    return articles.select("article_id", prefix(F.col("text"), chars).alias("article_text"))


def may_be_sent(contexts: DataFrame, rows: int = BROADCAST_ARTICLES, size: int = BROADCAST_BYTES) -> bool:
    """Whether the contexts are few and small enough for a broadcast. Texts are measured only where the rows are few."""
    if not has_at_most(contexts, rows):
        return False
    length = sum((F.coalesce(F.octet_length(F.col(name).cast("string")), F.lit(0)) for name in contexts.columns), F.lit(0))
    return (contexts.agg(F.sum(length.cast("long"))).first()[0] or 0) <= size


def with_context(
    turns: DataFrame,
    articles: DataFrame,
    spread: Sequence[str],
    chars: int = S.MAX_ARTICLE_CHARS,
    broadcast_rows: int = BROADCAST_ARTICLES,
    counted: DataFrame | None = None,
    **skew: int,
) -> DataFrame:
    """Add `article_text`, the first `chars` characters of the turn's article, '' for an unknown one.

    `articles` has one row per `article_id`; the `spread` columns tell turns apart. A corpus of checked
    size is broadcast. A larger one is shuffled, with the turns of a popular article spread over tasks;
    `counted` may name a cheaper frame with the same article ids, to find the popular ones in.
    """
    contexts = contexts_of(articles, chars)
    if may_be_sent(contexts, broadcast_rows):
        joined = turns.join(F.broadcast(contexts), "article_id", "left")
    else:
        popular = heavy_keys(turns if counted is None else counted, "article_id", **skew)
        joined = salted_lookup_join(turns, contexts.hint("merge"), popular, spread)
    return joined.withColumn("article_text", F.coalesce("article_text", F.lit("")))


def with_session_context(
    turns: DataFrame, articles: DataFrame, sessions: HeavyKeys, spread: Sequence[str], broadcast_rows: int = 0, **skew: int
) -> DataFrame:
    """`with_context` for turns that are, or will be, partitioned by session.

    Each (session, article) that occurs fetches its text once, and comes back as one more row of the session: the text
    spreads to the turns inside the session's own partition, so no turn is shuffled by its article. Where a session is
    too large for a partition, turns are joined by article instead.
    """
    if sessions:
        return with_context(turns, articles, spread, broadcast_rows=broadcast_rows, **skew)
    asked = turns.select("session_id", "article_id").distinct()
    found = with_context(asked, articles, ("session_id",), broadcast_rows=broadcast_rows, **skew)
    fetched = found.select("session_id", "article_id", F.col("article_text").alias("_fetched"), F.lit(False).alias("_turn"))
    rows = turns.withColumns({"_fetched": F.lit(None).cast("string"), "_turn": F.lit(True)})
    together = rows.unionByName(fetched, allowMissingColumns=True).repartition("session_id")
    here = Window.partitionBy("session_id", "article_id")
    return together.withColumn("article_text", F.max("_fetched").over(here)).where("_turn").drop("_fetched", "_turn")
