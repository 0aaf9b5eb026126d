"""Defined terms marked in the HTML of a law's units."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.functions import text

_TAG = re.compile(r"(<[^>]+>)")
_OPEN, _CLOSE = 'class="defined-term"', "</span>"


def marked(html: str, patterns: list[str], definitions: list[str]) -> str:
    """``html`` with each term's occurrences in spans, term by term. A term isn't sought within tags or within a span of
    another; once it is found in a piece of text, later pieces are passed over until a span has ended."""
    for pattern, definition in zip(patterns, definitions):
        term = re.compile(pattern, re.I)
        span = f'<span {_OPEN} data-definition="{definition}" title="{definition}">'
        parts, inside = _TAG.split(html), False
        for k, part in enumerate(parts):
            if k % 2 == 0 and not inside:
                part = parts[k] = term.sub(lambda m: f"{span}{m[0]}{_CLOSE}", part)  # noqa: B023
            if _OPEN in part:
                inside = True
            elif _CLOSE in part:
                inside = False
        html = "".join(parts)
    return html


def with_tooltips(units: DataFrame, definitions: DataFrame, inflected: bool = False) -> DataFrame:
    """``units`` (doc_id, html, ...) with the terms of their own law marked in ``html``, longest first.

    definitions: doc_id, place, term, definition; one law's definitions are gathered. ``inflected``: words are sought by
    their stems. Null html stays null; terms that are null or empty are left out, a null definition is empty.
    """
    term = F.col("term")
    whole = F.concat(F.lit("(?<![A-Za-z0-9_-])"), F.regexp_replace(term, r"([.*+?^${}()|\[\]\\])", r"\\$1"), F.lit("(?![A-Za-z0-9_-])"))
    entry = F.struct((-F.length("term")).alias("o"), "place", (text.stem_pattern(term) if inflected else whole).alias("p"), text.escaped(F.coalesce("definition", F.lit(""))).alias("d"))
    gathered = definitions.where("term <> ''").groupBy("doc_id").agg(F.array_sort(F.collect_list(entry)).alias("__terms"))

    @F.pandas_udf("string")
    def mark(html: pd.Series, patterns: pd.Series, meanings: pd.Series) -> pd.Series:
        return pd.Series([h if h is None or p is None else marked(h, p, d) for h, p, d in zip(html, patterns, meanings)], dtype=object)

    joined = units.join(gathered, "doc_id", "left")
    pick = lambda field: F.transform("__terms", lambda t: t[field])
    return joined.withColumn("html", mark("html", pick("p"), pick("d"))).drop("__terms")
