"""Streams over several micro-batches against the batch operators."""

from __future__ import annotations

import glob
import os
import shutil
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from parleystat.operators import turns as T
from parleystat.operators.skew import heavy_keys
from parleystat.operators.survey import token_totals
from parleystat.plans import queries
from parleystat.session import shared_dir
from parleystat.streaming import replay, turns
from parleystat.streaming.replay import replay_turns
from parleystat.streaming.sinks import append_turns_stream, drain, read_changes, save_changes, stream_token_totals
from parleystat.streaming.turns import follow_turns
from tests.test_turns import LOG, SCHEMA, START

FILES = 7
COLUMNS = ("_id", "turn_number", "eligible", "article_id", "response_id")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The log in time order, one file per stretch, written one after the other."""
    path = str(tmp_path_factory.mktemp("turns") / "log")
    rows = sorted(LOG, key=lambda r: (r[6] is not None, r[6] or START, r[0]))
    size = -(-len(rows) // FILES)
    for i in range(FILES):
        part = spark.createDataFrame(rows[i * size : (i + 1) * size], SCHEMA)
        part.where("session_id is not null").coalesce(1).write.mode("append").parquet(path)
    return path


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


@pytest.mark.parametrize("variant", ["text", "avatar"])
@pytest.mark.parametrize("how", ["state", "replay", "replay split"])
def test_streams_equal_the_batch(spark, folder, variant, how, monkeypatch):
    monkeypatch.setattr(replay, "_MERGE_EVERY", 3)
    log = spark.read.schema(SCHEMA).parquet(folder)
    heavy = heavy_keys(log, "session_id")
    batch = T.number_turns(log, heavy).select("_id", "turn_number", "eligible")
    batch = batch.join(T.sticky_ids(log, heavy, variant).select("_id", "article_id", "response_id"), "_id")
    if how == "state":
        streamed = drain(follow_turns(stream(spark, folder), variant), "turns")
    else:
        skew = {"floor": 10, "max_heavy": 1000} if how == "replay split" else {}
        streamed = replay_turns(stream(spark, folder), variant, **skew)
    expected = sorted(tuple(r) for r in batch.select(*COLUMNS).collect())
    assert sorted(tuple(r) for r in streamed.select(*COLUMNS).collect()) == expected


def test_sessions_share_state_entries(spark, folder, monkeypatch):
    """Calls and state entries are bounded however many sessions there are; turns without a session are one of their own."""
    monkeypatch.setattr(turns, "BUCKETS", 3)
    log = spark.read.schema(SCHEMA).parquet(folder)
    batch = {r._id: (r.turn_number, r.eligible) for r in T.number_turns(log, heavy_keys(log, "session_id")).collect()}
    nobody = log.withColumn("session_id", F.lit(None).cast("string"))  # every turn again, all of no session
    alone = {r._id: r.turn_number for r in T.number_turns(nobody.withColumn("session_id", F.lit("x")), heavy_keys(log, "session_id")).collect()}
    seen = []

    def keep(rows, number):
        seen.extend(rows.select("session_id", "_id", "turn_number", "eligible").collect())

    copies = F.explode(F.array(F.col("session_id"), F.lit(None).cast("string")))
    query = follow_turns(stream(spark, folder).withColumn("session_id", copies)).writeStream.foreachBatch(keep).trigger(availableNow=True).start()
    query.awaitTermination()
    entries = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    assert log.select("session_id").distinct().count() > 4 >= entries
    assert {r._id: (r.turn_number, r.eligible) for r in seen if r.session_id is not None} == batch
    assert {r._id: r.turn_number for r in seen if r.session_id is None} == alone


def test_stretches_of_several_files_are_one_micro_batch_each(spark, tmp_path, monkeypatch):
    rows = [(k, START + timedelta(minutes=(k * 37) % 400), k % 7, "chat", 0.0, "") for k in range(400)]
    events = spark.createDataFrame(rows, queries.proxies.TABLES["events"])
    events.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    run = queries.queries()["stream_turns_resumed_text"]
    expected = sorted(map(tuple, run(spark, str(tmp_path)).collect()))
    monkeypatch.setattr(queries, "_FILE_ROWS", 20)
    arriving = []
    monkeypatch.setattr(queries, "drain", lambda stream, *a: arriving.append(a) or drain(stream, *a))
    assert sorted(map(tuple, run(spark, str(tmp_path)).collect())) == expected and len(arriving) == 2
    place = glob.glob(os.path.join(shared_dir(spark).removeprefix("file:"), "resumed-state-in-*"))
    assert max(len(glob.glob(f"{p}/part-*")) for p in place) >= 4 * 4


def test_token_totals(spark, folder):
    def spoken(frame):
        return frame.select(F.col("session_id").alias("person_id"), F.col("user_input").alias("text"))

    expected = sorted(map(tuple, token_totals(spoken(spark.read.schema(SCHEMA).parquet(folder))).collect()))
    assert sorted(map(tuple, stream_token_totals(spoken(stream(spark, folder))).collect())) == expected


@pytest.mark.parametrize("how", ["state", "replay"])
def test_a_stopped_stream_goes_on(spark, folder, tmp_path, how, monkeypatch):
    """Some files, a stop, the others, a stop, and once more with nothing new: equal to one run."""
    monkeypatch.setattr(replay, "_MERGE_EVERY", 2)
    place, out = tmp_path / "in", str(tmp_path / "out")
    place.mkdir()

    def run():
        log = stream(spark, str(place))
        if how == "replay":
            return replay_turns(log, "avatar", out=out, checkpoint=f"{out}-progress")
        return drain(follow_turns(log, "avatar"), "turns", out, f"{out}-progress")

    files = sorted(glob.glob(f"{folder}/part-*.parquet"), key=os.path.getmtime)
    for k, name in enumerate(files):
        shutil.copy(name, place / f"{k}.parquet")
        os.utime(place / f"{k}.parquet", (1e9 + k, 1e9 + k))
        if k in (2, len(files) - 1):
            run()
    rows = sorted(tuple(r) for r in run().select(*COLUMNS).collect())
    whole = follow_turns(stream(spark, folder), "avatar")
    assert rows == sorted(tuple(r) for r in drain(whole, "turns").select(*COLUMNS).collect())


def test_a_log_is_appended_once_and_read_while_it_grows(spark, folder, tmp_path):
    path, progress, place = str(tmp_path / "log"), str(tmp_path / "progress"), tmp_path / "in"
    place.mkdir()
    files, seen = sorted(glob.glob(f"{folder}/part-*.parquet")), 0
    for k, name in enumerate(files[:3]):
        shutil.copy(name, place / f"{k}.parquet")
        turns = stream(spark, str(place)).withColumn("turn_number", F.lit(1)).withColumn("user_input_time", F.col("response_time"))
        log = append_turns_stream(turns, path, progress)
        seen += spark.read.parquet(name).count()
        assert log.count() == log.select("_id").distinct().count() == seen
    # A progress that lost its last commit: the micro-batch is run again, and the log stays as it is.
    commits = sorted((tmp_path / "progress" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for name in (commits[-1], commits[-1].with_name(f".{commits[-1].name}.crc")):
        name.rename(tmp_path / name.name.replace(".", "gone"))
    assert append_turns_stream(turns, path, progress).count() == seen


@pytest.mark.parametrize("every", [2, 16])
def test_changes_are_merged_by_levels(spark, tmp_path, every):
    """Totals of 200 micro-batches, some repeated, from few tables."""
    out, best = str(tmp_path / "changes"), {}

    def latest(changes):
        return changes.groupBy("person_id").agg(F.max("total_tokens").alias("total_tokens"))

    for n in range(200 if every == 16 else 24):
        rows = [(f"p{(n * k) % 11}", 1000 * n + k) for k in (1, 3)]
        best.update(dict(sorted(rows)) if rows[0][0] != rows[1][0] else {rows[0][0]: max(r[1] for r in rows)})
        batch = spark.createDataFrame(rows, "person_id string, total_tokens long").groupBy("person_id").agg(F.max("total_tokens").alias("total_tokens"))
        for _ in range(2 if n % 8 in (3, 7) else 1):
            save_changes(batch.coalesce(1), n, out, latest, every)
    tables = [p for p in (tmp_path / "changes").glob("level=*/upto=*")]
    assert len(tables) <= (every - 1) * 8
    found = read_changes(spark, out, "person_id string, total_tokens long", latest)
    assert {r.person_id: r.total_tokens for r in found.collect()} == best


def test_names_come_in_pairs(spark, folder):
    with pytest.raises(ValueError, match="both"):
        drain(stream(spark, folder), "turns", out="somewhere")
