"""Declared schemas and the values a study fixes."""

from __future__ import annotations

from pyspark.sql import types as T

# Survey items and conditions of the study.
EMPATHY_ITEMS = ("EMP_1", "EMP_2", "EMP_3", "EMP_4", "EMP_5")
ANTHRO_ITEMS = ("G_ANTHRO_1", "G_ANTHRO_2", "G_ANTHRO_3", "G_ANTHRO_4", "G_ANTHRO_5")
EXTRAVERSION_PLUS = ("P3_do_not_mind_centre_of_attention", "P10_make_friends_easily")
EXTRAVERSION_MINUS = ("P14_keep_in_the_background", "P18_avoid_contact_with_others")
AGREEABLENESS_PLUS = ("P6_believe_others_have_good_intentions", "P13_am_easy_to_satisfy")
AGREEABLENESS_MINUS = ("P2_hold_a_grudge", "P9_cut_others_to_pieces")
AVATAR_CONDITIONS = ("male_avatar", "female_avatar")
CORE_CONDITIONS = ("male_avatar", "female_avatar", "text")
SEX = "Sex"
ETHNICITY = "Ethnicity simplified"

# What a CSV cell must hold to count as missing.
MISSING_TOKENS = (
    "", "NA", "N/A", "n/a", "NULL", "null", "None", "NaN", "nan", "-NaN", "-nan", "<NA>",
    "#N/A", "#N/A N/A", "#NA", "1.#IND", "-1.#IND", "1.#QNAN", "-1.#QNAN",
)

# Limits and texts of the chat protocol.
TRIGGER_INPUT = "[initial prompt trigger]"
WELCOME_INPUT = "welcome"
DEFAULT_ARTICLE_ID = "5"
DEFAULT_RESPONSE_ID = ""
MIN_TURNS_FOR_CODE = 10
MAX_CODE = 10000
MAX_ARTICLE_CHARS = 10000
HISTORY_LIMIT = 50
HISTORY_HEAD = 5
HISTORY_TAIL = 45
CODE_SENTENCE = ("Here's your completion code: ", ". Thank you for participating in this experiment!")
FAILED_REPLY = "I'm sorry, I'm having trouble processing your request right now."
FAILED_WELCOME = (
    "This news describes the tragic death of young Marlins pitcher José Fernández—"
    "what are your thoughts on his life story and the impact he had on others?"
)
CODE_HINT = " (You can ask for your completion code if you'd like to end the conversation.)"
ARTICLE_PREFACE = {
    "text": "Background context for this conversation. "
    "Use it to inform your answers, but DO NOT reveal or quote verbatim unless asked.\n\n",
    "avatar": "Background context for this conversation. Use it to inform your answers, "
    "but do NOT reveal or quote the article verbatim unless explicitly asked by the user.\n\n",
}
TURN_PREFACE = "Current conversation turn: "

VARIANTS = ("text", "avatar")


def check_variant(variant: str) -> str:
    if variant not in VARIANTS:
        raise ValueError(f"variant must be one of {VARIANTS}, not {variant!r}")
    return variant


_ITEMS = (
    EMPATHY_ITEMS + ANTHRO_ITEMS + EXTRAVERSION_PLUS + EXTRAVERSION_MINUS + AGREEABLENESS_PLUS + AGREEABLENESS_MINUS
)

SURVEY = T.StructType(
    [T.StructField(name, T.StringType()) for name in ("person_id", "condition", SEX, ETHNICITY)]
    + [T.StructField(name, T.DoubleType()) for name in _ITEMS]
)

UTTERANCE = T.StructType([T.StructField("person_id", T.StringType()), T.StructField("text", T.StringType())])

TURN_LOG = T.StructType(
    [
        T.StructField("_id", T.StringType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("ArticleID", T.StringType()),
        T.StructField("ResponseID", T.StringType()),
        T.StructField("turn_number", T.IntegerType()),
        T.StructField("user_input", T.StringType()),
        T.StructField("user_input_time", T.TimestampNTZType()),
        T.StructField("bot_response", T.StringType()),
        T.StructField("response_time", T.TimestampNTZType()),
    ]
)

_PARAMS = T.MapType(T.StringType(), T.StringType())
_URLS = [T.StructField(name, T.StringType()) for name in ("pageUrl", "url", "referer")]

REQUEST_CONTEXT = T.StructType(
    [T.StructField("queryParams", _PARAMS)]
    + _URLS
    + [T.StructField("client", T.StructType([T.StructField("queryParams", _PARAMS)] + _URLS))]
)

MESSAGES = T.ArrayType(
    T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])
)
