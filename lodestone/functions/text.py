"""Column expressions over text, all built-in functions."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_BLANK = r"[\x09-\x0d\x1c-\x20\x{85}\p{Z}]+"
TOKEN = r"[\p{L}\p{N}]+"

# English words left out of queries, Swedish function words and generic search words left out of soft terms besides.
ENGLISH = [
    "a", "about", "an", "and", "are", "as", "at", "be", "but", "by", "can", "did", "do", "does", "for", "from", "had", "has", "have", "how", "i", "in",
    "is", "it", "me", "my", "of", "on", "or", "our", "that", "the", "this", "to", "was", "were", "what", "when", "where", "which", "who", "why",
    "said", "say", "with", "you",
]
SWEDISH = [
    "och", "att", "det", "som", "en", "ett", "den", "de", "dem", "är", "var", "för", "med", "på", "av", "till", "från", "om", "men", "eller", "inte",
    "jag", "du", "han", "hon", "vi", "ni", "man", "sig", "sin", "sitt", "har", "hade", "ska", "skulle", "kan", "kunde", "vill", "ville", "blir",
    "blev", "här", "där", "när", "vad", "hur", "varför", "vilken", "vilka", "så", "då", "nu", "bara", "också", "efter", "under", "över", "mot",
    "mig", "min", "mitt", "mina", "dig", "din", "ditt", "vara", "vid", "än",
]
GENERIC = ["archive", "find", "local", "look", "remember", "search", "semantic"]
STOP = ENGLISH
SOFT_STOP = [*SWEDISH, *GENERIC]


def strip(c: Column) -> Column:
    """White space of any kind off both ends; built-in trim() takes spaces only."""
    return F.regexp_replace(c, f"^{_BLANK}|{_BLANK}$", "")


def without_nul(c: Column) -> Column:
    return F.replace(c, F.lit("\x00"), F.lit(""))


def content_hash(c: Column) -> Column:
    """16 hex digits of the text's SHA-1."""
    return F.substring(F.sha1(F.encode(c, "UTF-8")), 1, 16)


def windows(text: Column, size: int, overlap: int, most: int | None) -> Column:
    """array<struct<start,text>>: overlapping windows of the stripped text until the start passes its end."""
    step = max(1, size - overlap)
    starts = F.sequence(F.lit(0), F.length(text) - 1, F.lit(step))
    starts = F.slice(starts, 1, most) if most else starts
    cut = F.transform(starts, lambda s: F.substr(text, s + 1, F.lit(size)))
    return F.when(F.length(text) > 0, cut).otherwise(F.array().cast("array<string>"))


def tokens(c: Column) -> Column:
    """Lower-cased runs of letters and digits, in order; a null text has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TOKEN), F.lit(0))


def query_terms(c: Column, limit: int = 12) -> Column:
    """The first distinct terms of a query without English filler words and single characters."""
    stop = F.array(*[F.lit(w) for w in STOP])
    return F.slice(F.array_distinct(F.filter(tokens(c), lambda t: (F.length(t) >= 2) & ~F.array_contains(stop, t))), 1, limit)


def soft_terms(c: Column, limit: int = 12) -> Column:
    """query_terms without Swedish function words and generic search words, or query_terms itself where nothing else is left."""
    terms = query_terms(c, limit)
    rest = F.array_except(terms, F.array(*[F.lit(w) for w in SOFT_STOP]))
    return F.when(F.size(rest) > 0, rest).otherwise(terms)


def latin1_repair(c: Column) -> Column:
    """UTF-8 read as Latin-1, read again rightly; anything else as it is."""
    raw = F.encode(c, "ISO-8859-1")
    return F.when(c.rlike(r"^[\x00-\x{ff}]*$"), F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")).otherwise(c)).otherwise(c)


def note_key(c: Column) -> Column:
    """A note's content without its tag line, with single spaces: the key that joins it to its dates."""
    unix = F.regexp_replace(c, "\r\n?", "\n")
    return strip(F.regexp_replace(F.regexp_replace(unix, r"\n+Tags:[^\n]*\s*$", ""), _BLANK, " "))


def _unescape(c: pd.Series) -> pd.Series:
    # the table of named entities is the standard library's; built-in functions have none
    return c.map(lambda t: html.unescape(t) if t is not None and "&" in t else t)


def html_text(c: Column) -> Column:
    """Text of an HTML body: scripts and styles dropped, tags to spaces, all entities decoded, blank runs collapsed."""
    c = F.regexp_replace(c, r"(?is)<(script|style)\b[^>]*>.*?</(script|style)\s*>", " ")
    c = F.pandas_udf(_unescape, StringType())(F.regexp_replace(c, r"(?s)<[^>]*>", " "))
    return strip(F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\n\s*\n+", "\n\n"))


def from_base64url(c: Column) -> Column:
    """Bytes of base64 in the alphabet for URLs or the common one, with or without padding; null for null."""
    plain = F.translate(F.regexp_replace(c, "[=\\s]", ""), "-_", "+/")
    return F.try_to_binary(F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), "="), F.lit("base64"))


def recency(created: Column, as_of: Column, days: int = 730) -> Column:
    """1 on the day, falling to 0 over `days`; 0 for what is no date."""
    day = F.try_to_date(F.when(created.rlike(r"^\d{4}-\d{2}-\d{2}$"), created), "yyyy-MM-dd")
    age = F.datediff(as_of, day)
    return F.when(day.isNull(), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - F.greatest(age, F.lit(0)) / F.lit(float(days))))


def sender_domain(c: Column) -> Column:
    """Domain of the first From: address, lower case, null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(c, r"From:[^@\n]*@([A-Za-z0-9._-]+)", 1)), F.lit(""))


def object_key(c: Column) -> Column:
    """Id without its last #part."""
    return F.regexp_replace(c, "#[^#]*$", "")


def epoch_day(c: Column) -> Column:
    """Day in UTC of an epoch in seconds or, above 1e11, milliseconds; '' for null."""
    seconds = F.when(c > 1e11, c / 1000.0).otherwise(c)
    return F.coalesce(F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd"), F.lit(""))
