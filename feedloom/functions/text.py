"""Text functions (F1, F2, F3, F10, P18) as native column expressions."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The embedding input is cut at this many characters.
EMBED_TEXT_MAX_CHARS = 8000

# A tag, whose quoted attribute values may hold '>'; failing that, up to the next '>'.
TAG = r"""(?s)<(?:[^>"']++|"[^"]*+"|'[^']*+')*+>|<[^>]*>"""


def strip_ws(c: Column) -> Column:
    """Python-style strip (Unicode whitespace), not Spark's space-only trim."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def is_blank(c: Column) -> Column:
    """True when null or whitespace only."""
    return c.isNull() | ~c.rlike(r"(?U)\S")


def embed_text(title: Column, summary: Column) -> Column:
    """``title + ' ' + (summary or '')`` — keeps the trailing space."""
    return F.concat(title, F.lit(" "), F.coalesce(summary, F.lit("")))


def truncate_chars(c: Column, n: int = EMBED_TEXT_MAX_CHARS) -> Column:
    """first ``n`` characters (code points, like Python slicing)."""
    return F.substring(c, 1, n)


@F.pandas_udf(T.StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None else html.unescape(t))


def unescape_entities(c: Column) -> Column:
    """Decode named and numeric character references.  Only rows that hold an
    ``&`` carry text to the Arrow helper."""
    has = F.contains(c, F.lit("&"))
    return F.when(has, _unescape(F.when(has, c))).otherwise(c)


def strip_comments_and_scripts(page: Column) -> Column:
    """Drop comments, <script> and <style> blocks: their markup is not markup."""
    out = F.regexp_replace(page, r"(?s)<!--.*?-->", "")
    out = F.regexp_replace(out, r"(?is)<script\b[^>]*>.*?</script\s*>", " ")
    return F.regexp_replace(out, r"(?is)<style\b[^>]*>.*?</style\s*>", " ")


def clean_html(page: Column) -> Column:
    """text of an HTML fragment — no tags, scripts, comments; entities
    decoded; runs of whitespace collapsed to one space; stripped."""
    out = strip_comments_and_scripts(page)
    out = F.regexp_replace(out, TAG, " ")
    out = unescape_entities(out)
    out = F.regexp_replace(out, r"(?U)\s+", " ")
    return strip_ws(out)


def once(value: Column, fn) -> Column:
    """``fn(value)`` with the value worked out once, however often ``fn`` uses it."""
    return F.element_at(F.transform(F.array(value), fn), 1)
