"""Identifiers carried by URLs and request contexts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parleystat import schemas as S
from parleystat.functions.text import non_empty

DEFAULTS = {"article_id": S.DEFAULT_ARTICLE_ID, "response_id": S.DEFAULT_RESPONSE_ID}


def _decode(part: Column) -> Column:
    # A '%' that starts no escape stands for itself.
    return F.url_decode(F.regexp_replace(part, "%(?![0-9A-Fa-f]{2})", "%25"))


def query_param(url: Column, name: str) -> Column:
    """First non-blank value of `name` in the query string, decoded; null when there is none."""
    query = F.regexp_extract(F.translate(url, "\t\r\n", ""), r"^[^?#]*\?([^#]*)", 1)
    named = F.filter(
        F.split(query, "&"),
        lambda pair: F.regexp_like(pair, F.lit("(?s)^[^=]*=.+"))
        & (_decode(F.substring_index(pair, "=", 1)) == name),
    )
    first = F.get(named, F.lit(0))
    return _decode(F.regexp_replace(first, "^[^=]*=", ""))


def _from_url(url: Column, name: str) -> Column:
    return F.when(F.contains(url, F.lit(f"{name}=")), non_empty(query_param(url, name)))


def text_request_id(name: str, body: Column, stored: Column, query: Column, referer: Column) -> Column:
    """Request body, then stored id, then query parameters, then referer, then the default.

    Two quirks belong to the protocol: a query parameter that is present but blank gives '', and a
    referer that mentions `name=` without a usable value gives null rather than the default.
    """
    return (
        F.when(F.coalesce(body, F.lit("")) != "", body)
        .when(F.coalesce(stored, F.lit("")) != "", stored)
        .when(F.coalesce(F.map_contains_key(query, name), F.lit(False)), query[name])
        .when(F.contains(referer, F.lit(f"{name}=")), query_param(referer, name))
        .otherwise(F.lit(DEFAULTS[name]))
    )


def avatar_session_id(name: str, context: Column, header_referer: Column) -> Column:
    """Context parameters, then its client's, then the context URLs, then the referer header."""
    client = context["client"]
    urls = [F.coalesce(non_empty(context[f]), client[f]) for f in ("pageUrl", "url", "referer")]
    return F.coalesce(
        non_empty(context["queryParams"][name]),
        non_empty(client["queryParams"][name]),
        *[_from_url(url, name) for url in urls],
        _from_url(header_referer, name),
        F.lit(DEFAULTS[name]),
    )


def parse_context(json: Column) -> Column:
    return F.from_json(json, S.REQUEST_CONTEXT)
