"""Readers and writers on small files."""

from __future__ import annotations

import datetime as dt
import glob
import json

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from parleystat import schemas as S
from parleystat.__main__ import main
from parleystat.plans.studies import run_mediation, run_regression
from parleystat.sources import readers, writers


def write_survey(path, people=40):
    header = ["extra", *S.SURVEY.names]
    lines = [",".join(header)]
    for i in range(people):
        condition = ("text", "male_avatar", "female_avatar", "other")[i % 4]
        numbers = [str(1 + (i * k + k) % 5) for k in range(2, 2 + len(S.SURVEY) - 4)]
        if i == 4:
            numbers[0], numbers[1] = "NA", ""
        lines.append(",".join(["e", str(i), condition, "FM"[i % 2], f'"eth, {i % 3}"', *numbers]))
    path.write_text("﻿" + "\n".join(lines) + "\n", encoding="utf-8")


def write_talk(path, people=40):
    rows = ["person_id,text"]
    for i in range(people):
        rows.append(f'{i},"said ""{"x " * (i % 7)}""\nand more"')
    rows += ["0,None", ",lost words", "1,N/A"]
    path.write_text("\n".join(rows) + "\n", encoding="utf-8")


@pytest.fixture
def inputs(tmp_path):
    write_survey(tmp_path / "survey.csv")
    write_talk(tmp_path / "talk.csv")
    return str(tmp_path / "survey.csv"), str(tmp_path / "talk.csv"), tmp_path


def test_survey_csv(spark, inputs):
    rows = readers.read_survey(spark, inputs[0]).orderBy("person_id").collect()
    assert len(rows) == 40
    gaps = next(r for r in rows if r["person_id"] == "4")
    assert gaps["EMP_1"] is None and gaps["EMP_2"] is None and gaps["EMP_3"] is not None
    assert gaps[S.ETHNICITY] == "eth, 1"


def test_bad_numbers(spark, tmp_path):
    write_survey(tmp_path / "survey.csv")
    text = (tmp_path / "survey.csv").read_text(encoding="utf-8").splitlines()
    cells = text[3].split(",")
    cells[6] = "seven"
    (tmp_path / "survey.csv").write_text("\n".join([*text[:3], ",".join(cells), *text[4:]]), encoding="utf-8")
    path = str(tmp_path / "survey.csv")
    with pytest.raises(Exception, match="holds no number: seven"):
        readers.read_survey(spark, path).collect()
    counted = {r["column"]: r["n"] for r in readers.bad_numbers(spark, path, S.SURVEY).collect()}
    assert sum(counted.values()) == 1
    assert readers.read_csv(spark, path, S.SURVEY, bad_numbers="missing").count() == 40


def test_headers_that_differ(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("person_id,text\n1,one two\n")
    (tmp_path / "in" / "b.csv").write_text("text,person_id\nthree word text,2\n")
    for multi_line in (True, False):
        with pytest.raises(Exception, match="(?i)header"):
            readers.read_csv(spark, str(tmp_path / "in"), S.UTTERANCE, multi_line).collect()


def test_utterance_csv(spark, inputs):
    rows = readers.read_utterances(spark, inputs[1]).collect()
    assert len(rows) == 43
    assert any(r["text"] and r["text"].endswith("\nand more") for r in rows)
    assert sum(r["text"] is None for r in rows) == 2
    assert sum(r["person_id"] is None for r in rows) == 1


def test_missing_column(spark, tmp_path):
    (tmp_path / "bad.csv").write_text("person_id,other\n1,2\n")
    with pytest.raises(ValueError, match="text"):
        readers.read_utterances(spark, str(tmp_path / "bad.csv"))


def test_every_missing_token(spark, tmp_path):
    cells = [t for t in S.MISSING_TOKENS if t] + ["NONE", "Na"]
    (tmp_path / "t.csv").write_text("person_id,text\n" + "".join(f"{i},{c}\n" for i, c in enumerate(cells)))
    rows = readers.read_utterances(spark, str(tmp_path / "t.csv")).collect()
    assert {r["text"] for r in rows} == {None, "NONE", "Na"}


def test_nan_becomes_missing(spark, tmp_path):
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in S.SURVEY)
    row = ("1", "text", "F", "e", *[float("nan")] * (len(S.SURVEY) - 4))
    spark.createDataFrame([row], fields).write.parquet(str(tmp_path / "s"))
    assert readers.read_survey(spark, str(tmp_path / "s"), "parquet").first()["EMP_1"] is None


def test_studies_from_files(spark, inputs):
    survey_path, talk_path, folder = inputs
    study = run_regression(spark, survey_path, talk_path, str(folder / "out"))
    assert {f.n for f in study.fits} == {29}
    assert study.predictions()[0].count() == 29
    assert len(run_mediation(spark, survey_path, talk_path).fits) == 5


def articles(spark, folder, *documents):
    folder.mkdir()
    for i, document in enumerate(documents):
        (folder / f"{i}.json").write_text(document if isinstance(document, str) else json.dumps(document, indent=1))
    return {r["article_id"]: r["text"] for r in readers.read_articles(spark, str(folder)).collect()}


def test_article_corpus(spark, tmp_path):
    items = [
        {"article_id": 5, "text": "five"}, {"article_id": "6", "text": "six"}, {"article_id": 5, "text": "again"},
        {"article_id": 7}, {"text": "lost"}, {"article_id": 8, "text": None}, {"article_id": None, "text": "none"},
        {"article_id": True, "text": "yes"}, {"article_id": "true", "text": "word"}, {"article_id": 2.5, "text": "é\n"},
        {"article_id": 4.0, "text": "four"},
        {"article_id": 9, "text": "old"}, {"article_id": 9, "text": None, "more": [1, {"a": 2}]},
    ]
    assert articles(spark, tmp_path / "a", items) == {
        "5": "again", "6": "six", "8": None, "None": "none", "True": "yes", "true": "word", "2.5": "é\n", "9": None,
        "4.0": "four",
    }


def test_article_corpus_must_be_a_list(spark, tmp_path):
    assert articles(spark, tmp_path / "a", {"article_id": 1, "text": "x"}) == {}
    assert articles(spark, tmp_path / "b", "not json") == {}
    assert articles(spark, tmp_path / "d", [{"article_id": 1, "text": "x"}, 2]) == {}
    assert articles(spark, tmp_path / "c", [{"article_id": 1, "text": "x"}], [{"article_id": 1, "text": "y"}]) == {"1": "y"}


NOW = dt.datetime(2024, 5, 1, 12, 0, 0, 5)
TURN = ("id1", "s1", "5", "R", 1, ' say "hi",\nyou ', NOW, "reply é", NOW)


def test_turn_log_round_trip(spark, tmp_path):
    path = str(tmp_path / "log")
    one = spark.createDataFrame([TURN], S.TURN_LOG)
    writers.append_turns(one, path)
    writers.append_turns(spark.createDataFrame([("id2", "s2", *TURN[2:])], S.TURN_LOG), path)
    assert {r["_id"] for r in readers.read_turn_log(spark, path).collect()} == {"id1", "id2"}
    session = readers.read_turn_log(spark, path, session_id="s1")
    assert [tuple(r) for r in session.collect()] == [TURN]
    assert "EqualTo(session_id,s1)" in session._jdf.queryExecution().executedPlan().toString()


def test_export_and_preview(spark, tmp_path):
    a = spark.createDataFrame([TURN], S.TURN_LOG)
    b = spark.createDataFrame([(2, "s2", "bye")], "_id long, session_id string, note string")
    whole = writers.union_of_documents([a, b])
    assert whole.columns == [*S.TURN_LOG.names, "note"]
    writers.export_csv(whole, str(tmp_path / "csv"))
    back = spark.read.options(header=True, multiLine=True, escape='"').csv(str(tmp_path / "csv"))
    assert {(r["_id"], r["user_input"], r["note"]) for r in back.collect()} == {("id1", TURN[5], None), ("2", None, "bye")}
    assert {r["response_time"] for r in back.collect()} == {"2024-05-01 12:00:00.000005", None}
    many = spark.range(20).withColumnRenamed("id", "_id")
    assert [r["_id"] for r in writers.preview(many, ["_id"]).collect()] == [0, 1, 2, 3, 4]


def test_documents_with_differing_keys(spark, tmp_path):
    lines = [
        {"_id": {"$oid": "a1"}, "session_id": "s", "turn_number": 1, "response_time": {"$date": "2024-05-01T12:00:00Z"}},
        {"_id": {"$oid": "a2"}, "session_id": "t", "bot_response": "x,\ny", "more": {"k": [1]}},
    ]
    (tmp_path / "dump.json").write_text("\n".join(map(json.dumps, lines)))
    main(["export", str(tmp_path / "dump.json"), str(tmp_path / "out")])
    rows = spark.read.options(header=True, multiLine=True, escape='"').csv(str(tmp_path / "out")).orderBy("_id").collect()
    assert [r["_id"] for r in rows] == ["a1", "a2"]
    assert rows[0]["response_time"] == "2024-05-01T12:00:00Z" and rows[0]["bot_response"] is None
    assert rows[1]["bot_response"] == "x,\ny" and json.loads(rows[1]["more"]) == {"k": ["1"]}


def test_command_line(spark, inputs, capsys):
    survey_path, talk_path, folder = inputs
    main(["regression", survey_path, talk_path, str(folder / "a"), "--spec", "2"])
    main(["mediation", survey_path, talk_path, str(folder / "b")])
    printed = capsys.readouterr().out
    assert "spec2 EMP_1: 29 rows" in printed and "path_a anthropomorphism: 30 rows" in printed


def test_one_session_reads_one_folder_and_few_row_groups(spark, tmp_path):
    """A third of all turns in one session; the others in 2000 sessions."""
    path, again = str(tmp_path / "log"), str(tmp_path / "again")
    rows = spark.range(60_000).select(
        F.col("id").cast("string").alias("_id"),
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 1000 != 1, F.concat(F.lit("s"), F.col("id") % 2000)).alias("session_id"),
        F.lit("5").alias("ArticleID"), F.lit("").alias("ResponseID"), F.lit(1).alias("turn_number"),
        F.sha2(F.col("id").cast("string"), 512).alias("user_input"), F.timestamp_seconds("id").cast("timestamp_ntz").alias("user_input_time"),
        F.sha2((-F.col("id")).cast("string"), 512).alias("bot_response"), F.timestamp_seconds("id").cast("timestamp_ntz").alias("response_time"),
    )
    for k in (0, 1):
        writers.append_clustered(rows.where(F.col("id") % 2 == k), path, buckets=8, row_group=1 << 18)
    for session in ("hot", "s7", None, "absent"):
        mine = rows.where(F.col("session_id").eqNullSafe(F.lit(session))).orderBy("response_time", "_id").collect()
        found = readers.read_session(spark, path, session, buckets=8)
        assert [tuple(r) for r in found.collect()] == [tuple(r) for r in mine]
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan
    hot = spark.read.parquet(path).where("session_id = 'hot'").select(F.input_file_name().alias("f")).groupBy("f").count().collect()
    assert len(hot) > 2 and max(r["count"] for r in hot) < 15_000  # written by several tasks
    writers.recluster(spark, path, again, buckets=8, row_group=1 << 18)
    assert readers.read_clustered_log(spark, again).count() == 60_000
    groups = holding = 0
    for name in glob.glob(f"{again}/bucket=*/*.parquet"):
        meta = pq.ParquetFile(name).metadata
        column = meta.schema.names.index("session_id")
        for g in range(meta.num_row_groups):
            stats = meta.row_group(g).column(column).statistics
            groups += 1
            holding += stats.has_min_max and stats.min <= "s7" <= stats.max
    assert groups > 30 and 0 < holding <= groups / 4


def test_documents_of_which_some_wrap_their_ids(spark, tmp_path):
    lines = ['{"_id": {"$oid": "a1"}, "t": {"$date": "2024-01-01"}, "x": 1}', '{"_id": "a2", "t": "2024-01-02", "x": "{}"}', '{"_id": 7}']
    (tmp_path / "d.json").write_text("\n".join(lines))
    rows = {r._id: (r.t, r.x) for r in readers.read_documents(spark, str(tmp_path / "d.json")).collect()}
    assert rows == {"a1": ("2024-01-01", "1"), "a2": ("2024-01-02", "{}"), "7": (None, None)}
