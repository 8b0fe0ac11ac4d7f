"""Per-turn rules of the two chat variants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parleystat import schemas as S
from parleystat.functions.text import is_blank, is_present, strip


def is_counted(user_input: Column) -> Column:
    """Everything but the trigger record counts as a turn, a missing input included."""
    return ~user_input.eqNullSafe(F.lit(S.TRIGGER_INPUT))


def is_usable(user_input: Column, bot_response: Column) -> Column:
    return is_present(user_input) & is_present(bot_response)


def input_class(user_input: Column, variant: str) -> Column:
    """`text`: blank or metadata input opens the chat (`welcome`). `avatar`: such input, and the word
    'welcome' itself, is `silent` and never logged."""
    if S.check_variant(variant) == "text":
        system = is_blank(user_input) | (F.lower(strip(user_input)) == "page_metadata")
        return F.when(system, "welcome").otherwise("turn")
    system = is_blank(user_input) | F.lower(user_input).isin("welcome", "page_metadata")
    return F.when(system, "silent").otherwise("turn")


def stored_input(user_input: Column, variant: str) -> Column:
    """What the log keeps: the text chat strips the input, the avatar chat keeps it as sent."""
    return strip(user_input) if S.check_variant(variant) == "text" else user_input


def asks_for_code(user_input: Column) -> Column:
    return F.contains(F.lower(user_input), F.lit("code"))


def lacks_hint(bot_response: Column, variant: str) -> Column:
    reply = F.lower(bot_response)
    lacks = ~F.contains(reply, F.lit("completion code"))
    if S.check_variant(variant) == "avatar":
        lacks = lacks & ~F.contains(reply, F.lit("end")) & ~F.contains(reply, F.lit("finish"))
    return lacks


def completion_code(session_id: Column, turn_number: Column) -> Column:
    """A code from 0 to 10000, drawn anew each turn by hashing, so that a rerun repeats it."""
    digest = F.md5(F.concat(F.coalesce(session_id, F.lit("")), F.lit("#"), turn_number.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % (S.MAX_CODE + 1)


def final_reply(user_input: Column, bot_response: Column, eligible: Column, code: Column, variant: str) -> Column:
    before, after = S.CODE_SENTENCE
    return (
        F.when(eligible & asks_for_code(user_input), F.concat(F.lit(before), code.cast("string"), F.lit(after)))
        .when(eligible & lacks_hint(bot_response, variant), F.concat(bot_response, F.lit(S.CODE_HINT)))
        .otherwise(bot_response)
    )


def issued_code(bot_response: Column) -> Column:
    """The code a stored reply handed out; null when it handed out none."""
    found = F.regexp_extract(bot_response, r"completion code: (\d+)\.", 1)
    return F.nullif(found, F.lit("")).cast("long")
