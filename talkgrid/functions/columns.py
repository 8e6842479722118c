"""Column functions over text, time and words, all evaluated in the JVM."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: English words that carry no search weight.
STOP_WORDS = (
    "the a an is are was were be been being of to in on at for with by from up about into through during before after above below "
    "out off over under again further then once how what why when where who which does do did done doing this that these those such "
    "and but or nor so as also than very much many more most some any all each every between us we you he she it they i his her their "
    "its our your my me him them"
).split()


def terms(text: Column) -> Column:
    """Distinct lower-case words of letters and digits, three or longer, without stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.array_except(F.filter(found, lambda t: F.length(t) >= 3), stop)


def stop_sql() -> str:
    """The stop words as an SQL list."""
    return "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"


def clock_seconds(clock: Column) -> Column:
    """``HH:MM:SS.mmm`` to seconds; anything else is null."""
    p = F.split(clock, ":")
    ok = clock.rlike(r"^\d{2,}:\d{2}:\d{2}\.\d{3}$")
    return F.when(ok, F.get(p, F.lit(0)).cast("double") * 3600 + F.get(p, F.lit(1)).cast("double") * 60 + F.get(p, F.lit(2)).cast("double"))


def seconds_clock(seconds: Column) -> Column:
    """Seconds to ``HH:MM:SS.mmm``, rounded to milliseconds and never below zero."""
    ms = F.greatest(F.round(seconds * 1000), F.lit(0)).cast("bigint")
    part = lambda v, n: F.lpad(v.cast("string"), n, "0")
    hours = F.floor(ms / 3600000)
    long_hours = F.when(hours > 99, hours.cast("string")).otherwise(part(hours, 2))
    return F.concat(long_hours, F.lit(":"), part(F.floor(ms / 60000) % 60, 2), F.lit(":"), part(F.floor(ms / 1000) % 60, 2), F.lit("."), part(ms % 1000, 3))


def tenths(seconds: Column) -> Column:
    """Seconds with one decimal as ``%.1f`` of C and Python writes them: the binary value, ties to even.

    Java's ``%.1f`` rounds the shortest decimal half up, so 0.25 and 0.35 would differ.  Only a product that
    falls on a half can be off; the lost part of ``8f + 2f`` (f the fraction) is then exact and decides.  For ``abs(x) < 9e15``.
    """
    x = F.abs(seconds)
    whole = F.floor(x)
    f = x - whole
    p = f * 8 + f * 2
    lost, low = f * 2 - (p - f * 8), F.floor(p)
    half = F.when((lost > 0) | ((lost == 0) & (low % 2 == 1)), low + 1).otherwise(low)
    t = F.when(p - low == 0.5, half).otherwise(F.floor(p + 0.5))
    sign = F.when(seconds.cast("string").startswith("-"), "-").otherwise("")
    return F.concat(sign, (whole + F.when(t > 9, 1).otherwise(0)).cast("string"), F.lit("."), (t % 10).cast("string"))


#: The entities of markup itself, in the order in which they are resolved.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
_ENTITY = r"&(#\d+|#[xX][0-9a-fA-F]+|\w+);?"


@F.pandas_udf(T.ArrayType(T.StringType()))
def _unescaped(lines: pd.Series) -> pd.Series:
    return lines.map(lambda own: None if own is None else [html.unescape(x) for x in own])


def _settled(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(line, r"^>>\s*", ""), r"[\s\x{a0}]+", " "))


def clean_line(line: Column) -> Column:
    """A caption line without tags, common entities, speaker marks and repeated white space."""
    x = F.regexp_replace(line, "<[^>]*>", "")
    for entity, sign in ENTITIES:
        x = F.replace(x, F.lit(entity), F.lit(sign))
    return _settled(x)


def clean_lines(lines: Column) -> Column:
    """The same for an array of lines, with every entity of HTML.

    Only arrays with an entity go through Python; for the others it gets nulls.
    """
    bare = F.transform(lines, lambda x: F.regexp_replace(x, "<[^>]*>", ""))
    escaped = F.exists(bare, lambda x: x.rlike(_ENTITY))
    return F.transform(F.coalesce(_unescaped(F.when(escaped, bare)), bare), _settled)


def ends_sentence(text: Column) -> Column:
    """Whether the text ends with a full stop, exclamation or question mark."""
    return F.rtrim(text).rlike(r"[.!?]$")


def token_count(text: Column) -> Column:
    """Runs of characters other than white space."""
    return F.regexp_count(text, F.lit(r"\S+"))
