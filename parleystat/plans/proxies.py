"""Study inputs derived from the given tables. Each list is read by Spark and by the SQL oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parleystat import schemas as S

_BALANCE = "cast(floor(abs(c_acctbal)) as bigint)"


def _likert(name: str, modulus: int, missing: int, value: str, points: int) -> str:
    return f"case when c_custkey % {modulus} = {missing} then null else 1 + ({value}) % {points} end as {name}"


_EMP = [
    _likert(f"EMP_{i}", 41, i, f"c_custkey * {step} + c_nationkey * {i} + {_BALANCE}", 7)
    for i, step in enumerate((3, 5, 11, 13, 17), start=1)
]
_ANTHRO = [
    _likert(f"G_ANTHRO_{i}", 43, i, f"c_custkey * {step} + {_BALANCE} * {i}", 5)
    for i, step in enumerate((3, 5, 11, 13, 17), start=1)
]
_PERSONALITY = sorted(
    S.EXTRAVERSION_PLUS + S.EXTRAVERSION_MINUS + S.AGREEABLENESS_PLUS + S.AGREEABLENESS_MINUS
)
_TRAITS = []
for _name in _PERSONALITY:
    _k = int(_name[1 : _name.index("_")])
    _TRAITS.append(
        _likert(_name, 47, _k, f"{_BALANCE} + c_custkey * {_k} + cast(floor(c_custkey / {_k}) as bigint)", 5)
    )

SURVEY = [
    "c_custkey as person_id",
    "case when c_custkey % 53 = 52 then null when c_custkey % 4 = 0 then 'text' "
    "when c_custkey % 4 = 1 then 'male_avatar' when c_custkey % 4 = 2 then 'female_avatar' else 'other' end as condition",
    "case when c_nationkey % 2 = 0 then 'Female' when c_nationkey % 5 = 0 then 'Prefer not to say' "
    "else 'Male' end as Sex",
    "case when c_custkey % 61 = 60 then null else c_mktsegment end as ethnicity_simplified",
    *_EMP,
    *_ANTHRO,
    *_TRAITS,
]

TURNS = [
    "event_id",
    "cast(user_id as varchar(20)) as session_id",
    "case when event_id % 6 = 0 then cast(event_id % 9 as varchar(20)) else null end as ArticleID",
    "case when event_id % 7 = 0 then concat('R_', cast(event_id % 13 as varchar(20))) else '' end as ResponseID",
    "case when event_type = 'error' then '[initial prompt trigger]' "
    "when event_id % 11 = 0 then 'May I have my Code please' when event_id % 29 = 0 then null "
    "else event_type end as user_input",
    "case when event_id % 17 = 0 then '' when event_id % 19 = 0 then 'Shall we end here, friend?' "
    "else concat('reply ', cast(event_id as varchar(20))) end as bot_response",
    "ts as response_time",
]

# What chat requests carry: typed input with odd spacing, and identifiers in several places.
REQUESTS = [
    "event_id",
    "case when event_id % 13 = 0 then concat(' ', event_type, '  ') when event_id % 17 = 0 then '   ' "
    "when event_id % 19 = 0 then 'Page_Metadata' when event_id % 23 = 0 then 'WELCOME' "
    "when event_id % 29 = 0 then null else event_type end as user_message",
    "case when event_id % 3 = 0 then cast(event_id % 9 as varchar(20)) when event_id % 3 = 1 then '' end as body_id",
    "case when event_id % 5 = 0 then cast(user_id as varchar(20)) end as stored_id",
    "case when event_id % 4 = 0 then concat('q', cast(user_id % 7 as varchar(20))) end as query_id",
    "case when event_id % 7 = 0 then concat('https://host/p?x=1&article_id=', cast(user_id as varchar(20)), '%20b+c#f') "
    "when event_id % 7 = 1 then 'https://host/p?article_id=&response_id=' "
    "when event_id % 7 = 2 then concat('https://host/#article_id=', cast(user_id as varchar(20))) end as page_url",
]

# Requests of the text chat: bodies, query parameters and referers that carry identifiers or don't.
TEXT_REQUESTS = [
    "event_id",
    "cast(user_id as varchar(20)) as session_id",
    "ts as request_time",
    "case when event_id % 31 = 0 then concat(' ', event_type, ' code ') when event_id % 17 = 0 then '   ' "
    "when event_id % 19 = 0 then 'Page_Metadata' when event_id % 29 = 0 then null "
    "when event_id % 37 = 0 then '[initial prompt trigger]' else event_type end as user_message",
    "case when event_id % 23 = 0 then cast(event_id % 9 as varchar(20)) when event_id % 3 = 1 then '' end as article_id",
    "case when event_id % 41 = 0 then concat('B', cast(event_id % 13 as varchar(20))) when event_id % 5 = 1 then '' end as response_id",
    "case when event_id % 11 = 0 then concat('q', cast(event_id % 7 as varchar(20))) when event_id % 13 = 0 then '' end as query_article",
    "case when event_id % 7 = 0 then concat('https://host/p?x=1&article_id=', cast(event_id % 8 as varchar(20)), '&response_id=R', "
    "cast(event_id % 10 as varchar(20)), '%20b+c#f') when event_id % 7 = 1 then 'https://host/p?article_id=&response_id=' "
    "when event_id % 7 = 2 then 'https://host/#article_id=4' end as referer",
    "case when event_id % 43 = 0 then null when event_id % 19 = 0 then 'Shall we end here, friend?' "
    "else concat('reply ', cast(event_id as varchar(20))) end as reply",
    "ts as reply_time",
]

# Requests of the avatar chat: some open a session and carry a context, the others are inputs.
AVATAR_REQUESTS = [
    "event_id",
    "cast(user_id as varchar(20)) as session_id",
    "ts as request_time",
    "case when event_id % 9 = 0 then 'session' else 'execute' end as kind",
    "case when event_id % 9 <> 0 or event_id % 10 = 0 then null "
    "when event_id % 4 = 0 then concat('{\"queryParams\": {\"article_id\": \"', cast(event_id % 7 as varchar(20)), '\"}}') "
    "when event_id % 4 = 1 then concat('{\"pageUrl\": \"\", \"client\": {\"pageUrl\": \"https://host/p?article_id=', "
    "cast(event_id % 8 as varchar(20)), '&response_id=R', cast(event_id % 12 as varchar(20)), '\"}}') "
    "when event_id % 4 = 2 then '{\"queryParams\": {\"article_id\": \"\"}, \"url\": \"https://host/#article_id=1\"}' "
    "else concat('{\"client\": {\"queryParams\": {\"response_id\": \"C', cast(event_id % 5 as varchar(20)), '\"}}}') end as context",
    "case when event_id % 6 = 0 then concat('https://host/h?article_id=', cast(event_id % 11 as varchar(20))) end as header_referer",
    "case when event_id % 31 = 0 then 'My CODE please' when event_id % 17 = 0 then '   ' when event_id % 19 = 0 then 'Page_Metadata' "
    "when event_id % 23 = 0 then 'Welcome' when event_id % 29 = 0 then null when event_id % 37 = 0 then '[initial prompt trigger]' "
    "else concat(' ', event_type) end as text",
    "case when event_id % 43 = 0 then null when event_id % 13 = 0 then 'Shall we end here, friend?' "
    "else concat('reply ', cast(event_id as varchar(20))) end as reply",
    "ts as reply_time",
]

ORDER = ("response_time", "event_id")

# Declared, so that reading a table starts no job to look at its footers.
TABLES = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "pages": "page_id bigint, url string, html string",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}.parquet")


def survey(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").selectExpr(*SURVEY).withColumnRenamed("ethnicity_simplified", S.ETHNICITY)


def utterances(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select(F.col("doc_id").alias("person_id"), "text")
    talks = table(spark, folder, "conversations").select(F.col("conv_id").alias("person_id"), "text")
    return documents.unionByName(talks)


def turns(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").selectExpr(*TURNS)


def requests(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").selectExpr(*REQUESTS)


def text_requests(spark: SparkSession, folder: str) -> DataFrame:
    asked = table(spark, folder, "events").selectExpr(*TEXT_REQUESTS)
    query = F.when(F.col("query_article").isNotNull(), F.create_map(F.lit("article_id"), "query_article"))
    return asked.withColumn("query", query).withColumnRenamed("event_id", "_id")


def avatar_requests(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").selectExpr(*AVATAR_REQUESTS).withColumnRenamed("event_id", "_id")


def articles(spark: SparkSession, folder: str) -> DataFrame:
    """Every document is an article; ids are unique."""
    return table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("article_id"), "text")
