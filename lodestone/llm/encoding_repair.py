"""Text decoded with a wrong character encoding: found and restored through a table of garbled forms of clean corpus words."""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.runtime import small, spread, table_cut

# Single-byte encodings that such text has passed through.
SINGLE = ["latin-1", "cp1252", "mac_roman", "cp437", "cp850", "cp1251", "koi8_r", "cp866"]
# Letters beyond ASCII of sv, en, de, da, fr, es, fi, ru, and typographic signs of ordinary prose.
LATIN = "åäöéüèæøßàâáíóúñçêëîïôûœùÅÄÖÉÜÈÆØÀÂÁÍÓÚÑÇÊËÎÏÔÛŒÙ"
SIGNS = "’‘“”„«»‹›–—…·•€§°¿¡£¥©®™½¼¾×±µ¶²³¹ªº¨´¬÷ ­"
CYRILLIC = "абвгдеёжзийклмнопрстуфхцчшщъыьэюя"
_NATURAL = re.compile(rf"(?:[\x00-\x7f{LATIN}{SIGNS}]|[\x00-\x7f{CYRILLIC}{CYRILLIC.upper()}{SIGNS}])*\Z")
_NO_CASE_BREAK = re.compile(rf"[{CYRILLIC}][{CYRILLIC.upper()}]|[a-zåäöéüèæøßàáíóúñç][{SIGNS[8:]}]+[a-zåäöé]")
_SIGN_INSIDE = re.compile(r"\w[€£¥©®™½¼¾×±¶¨´¬÷¿¡²³¹ªº]\w|^[½¼¾©®™£¶¨´¬÷]\w")
# National 7-bit alphabets, whose letters stand where ASCII has these signs.
SEVEN_BIT = {
    "sv": ("äöåÄÖÅéüÜ", "{|}[\\]`~^"),
    "da": ("æøåÆØÅ", "{|}[\\]"),
    "de": ("äöüßÄÖÜ", "{|}~[\\]"),
    "fr": ("éùèàç", "{|}@\\"),
    "es": ("ñÑ¡¿", "|\\[]"),
}
_SEVEN = [str.maketrans(a, b) for a, b in SEVEN_BIT.values()]
_SEVEN_SIGN = re.compile(r"[\[\]{}|\\^~`]")
_UTF7 = re.compile(r"\+[A-Za-z0-9/]{3,}")
#: Letters from which a word in a 7-bit alphabet is a finding of its own; shorter ones may be code.
SEVEN_SURE = 4
#: How much more frequent a word must be than an equally natural form for that form to count as its garbling.
MARGIN = 5
#: Tokens whose repair a worker remembers.
REMEMBERED = 300_000


def _decode_table(name: str) -> str:
    """The 256 characters of an encoding; bytes without one keep their value, as browsers do."""
    return "".join(bytes([b]).decode(name, "ignore") or chr(b) for b in range(256))


TABLES = {name: _decode_table(name) for name in SINGLE}
BACK = {name: codecs.charmap_build(t) for name, t in TABLES.items()}


def _read(raw: bytes, name: str) -> str:
    return codecs.charmap_decode(raw, "strict", TABLES[name])[0]


def _bytes(text: str, name: str) -> bytes | None:
    try:
        return codecs.charmap_encode(text, "strict", BACK[name])[0]
    except UnicodeEncodeError:
        return None


def is_natural(token: str) -> bool:
    """Only letters of one known alphabet with ordinary signs, and no sign or capital where prose has none."""
    return bool(_NATURAL.match(token)) and not _SEVEN_SIGN.search(token) and not _UTF7.search(token) and not _NO_CASE_BREAK.search(token) and not _SIGN_INSIDE.search(token)


def garbled_forms(word: str) -> Iterator[tuple[str, bool]]:
    """(form, multi_byte) of word under every chain of encodings: UTF-8 read as a single-byte encoding, once or twice, one single-byte
    encoding read as another (then also through UTF-8), and a single-byte encoding read as UTF-8 with lost letters."""
    seen = {word}

    def fresh(form: str) -> bool:
        return form not in seen and not seen.add(form)

    for table in _SEVEN:
        form = word.translate(table)
        if form.isascii() and fresh(form):
            yield form, False
    utf = word.encode("utf-8", "surrogatepass")
    for outer in SINGLE:
        once = _read(utf, outer)
        if fresh(once):
            yield once, True
        for inner in SINGLE[:5]:
            twice = _read(once.encode("utf-8"), inner)
            if fresh(twice):
                yield twice, True
    for src in SINGLE:
        raw = _bytes(word, src)
        if raw is None:
            continue
        lost = raw.decode("utf-8", "replace")
        if "�" in lost and fresh(lost):
            yield lost, True
        for dst in SINGLE:
            form = _read(raw, dst)
            if fresh(form):
                yield form, False
            if form != word:
                for inner in SINGLE[:2]:
                    twice = _read(form.encode("utf-8"), inner)
                    if fresh(twice):
                        yield twice, True


#: What stands in garbled forms of letters only, under the same chains: control characters, and the sign for a lost letter.
LOST = {c for letter in LATIN + CYRILLIC + CYRILLIC.upper() for form, _ in garbled_forms(letter) for c in form if "\x7f" < c < "\xa0" or c == "\ufffd"}


def rare_forms(word: str) -> set[str]:
    """The forms of word under the second readings that garbled_forms leaves out, as they are rarer than any of its own."""
    utf, raws = word.encode("utf-8", "surrogatepass"), [raw for src in SINGLE if (raw := _bytes(word, src)) is not None]
    out = {_read(_read(utf, outer).encode("utf-8"), inner) for outer in SINGLE for inner in SINGLE[5:]}
    out |= {_read(form.encode("utf-8"), inner) for form in {_read(raw, dst) for raw in raws for dst in SINGLE} - {word} for inner in SINGLE[2:]}
    return out - {word} - {form for form, _ in garbled_forms(word)}


def reversed_utf8(token: str, depth: int = 2) -> str | None:
    """The word whose UTF-8 bytes were read as a single-byte encoding (once or twice) to give token; natural ones before other words of letters."""
    words = []
    if token.isascii():
        try:
            word = token.encode().decode("utf-7")
        except UnicodeDecodeError:
            return None
        return word if _UTF7.search(token) and not word.isascii() and is_natural(word) else None
    for name in SINGLE:
        raw = _bytes(token, name)
        if raw is None or max(raw, default=0) < 128:
            continue
        try:
            word = raw.decode("utf-8")
        except UnicodeDecodeError:
            continue
        if is_natural(word):
            return word
        if depth > 1 and (deeper := reversed_utf8(word, depth - 1)):
            words.insert(0, deeper)
        elif all(c.isascii() or "À" <= c <= "ž" for c in word):
            words.append(word)
    return words[0] if words else None


#: Taken from the count of words behind a rare form, so that each other explanation of a token goes first.
RARE = 1 << 40
_FORMS = "form string, word string, multi boolean, word_n long"


def _mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        b["natural"] = [is_natural(t) for t in b["token"]]
        yield b


def _generate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for token, n, natural in zip(b["token"], b["n"], b["natural"]):
            if natural:
                out += [(form, token, multi, n) for form, multi in garbled_forms(token)]
                out += [(form, token, True, n - RARE) for form in rare_forms(token)]
            else:
                # originals that occur nowhere clean: accepted only when garbling them gives the token again
                word = reversed_utf8(token)
                if word and (token.isascii() or any(form == token for form, _ in garbled_forms(word)) or token in rare_forms(word)):
                    out.append((token, word, True, 0))
                elif not LOST.isdisjoint(token):
                    out.append((token, None, True, 0))
        yield pd.DataFrame(out, columns=["form", "word", "multi", "word_n"])


def suspicious_tokens(rows: DataFrame, columns: tuple[str, ...] = ("text", "title"), id_col: str = "id") -> DataFrame:
    """(id, col_name, token): distinct tokens per value that may be garbled: with a character beyond ASCII, a sign of the 7-bit
    alphabets next to a letter, or a UTF-7 sequence; signs that can't belong to them are cut off at both ends."""
    values = F.explode(F.array(*[F.struct(F.lit(c).alias("col_name"), F.col(c).alias("value")) for c in columns]))

    def tokens(pattern: str, edge: str):
        return F.transform(F.regexp_extract_all("v.value", F.lit(pattern), F.lit(0)), lambda t: F.regexp_replace(t, edge, ""))

    none = F.array().cast("array<string>")
    seven = r"[\[\]{}|\\^~`]"
    beyond = tokens("(?<![^\\x00-\\x20\\x2d])[\\x21-\\x2c\\x2e-\\x7f]*+[^\\x00-\\x7f][^\\x00-\\x20\\x2d]*+", "^[\\x00-\\x40\\x5b-\\x60\\x7b-\\x7f]+|[\\x00-\\x40\\x5b-\\x60\\x7b-\\x7f]+$")
    national = tokens(rf"(?<![!-,.-~])[!-,.-~]*?(?:[A-Za-z]{seven}|{seven}[A-Za-z])[!-,.-~]*+", "^[\\x00-\\x3f_]+|[\\x00-\\x3f_]+$")
    utf7 = tokens(r"(?<![!-~])[!-~]*?\+[A-Za-z0-9/]{3}[!-~]*+", "^[^A-Za-z+]+|[^A-Za-z0-9-]+$")
    found = F.concat(
        F.when(F.col("v.value").rlike("[^\\x00-\\x7f]"), beyond).otherwise(none),
        F.when(F.col("v.value").rlike(rf"[A-Za-z]{seven}|{seven}[A-Za-z]"), national).otherwise(none),
        F.when(F.col("v.value").rlike(r"\+[A-Za-z0-9/]{3}"), utf7).otherwise(none),
    )
    return (
        spread(rows.select(F.col(id_col).alias("id"), *columns))
        .select("id", values.alias("v"))
        .where(F.col("id").isNotNull() & F.col("v.value").isNotNull())
        .select("id", "v.col_name", F.explode(F.array_distinct(found)).alias("token"))
    )


def garbled_dictionary(tokens: DataFrame) -> DataFrame:
    """(token, original, sure): every garbled token of the corpus with its verified original, null where that is lost or ambiguous;
    not sure are short words in a 7-bit alphabet, which count only beside a sure token.

    Of the words that garble to a token, the most frequent is taken if no other is as frequent. A token that itself looks
    natural counts as garbled only if its word is far more frequent; ties thus leave text as it is.
    """
    counted = tokens.groupBy("token").agg(F.count("*").alias("n"))
    vocabulary = table_cut(counted.mapInPandas(_mark, "token string, n long, natural boolean"))
    forms = vocabulary.mapInPandas(_generate, _FORMS)
    wordlike = F.col("word").rlike(r"\p{L}.*\p{L}") & F.col("form").rlike(r"\p{L}.*\p{L}")
    lettered, more = F.col("form").rlike(r"\p{L}"), F.col("word_n") > F.col("form_n")
    hits = forms.join(vocabulary.select(F.col("token").alias("form"), F.col("n").alias("form_n"), "natural"), "form").where(
        F.when(F.col("natural"), F.col("multi") & more | wordlike & (F.col("word_n") >= MARGIN * F.col("form_n")))
        .when(F.col("multi"), F.lit(True))
        .otherwise(lettered & more)
    )
    by_form = Window.partitionBy("form").orderBy(F.col("word").isNull(), F.col("word_n") < 0, F.desc("multi"), F.desc("word_n"), "word")
    ranked = hits.withColumn("k", F.row_number().over(by_form)).withColumn("tie", F.lead("word_n").over(by_form) == F.col("word_n"))
    sure = F.col("form").rlike("[^\\x00-\\x7f]") | F.col("multi") | (F.length("word") >= SEVEN_SURE)
    lost = F.col("form").contains("�") & F.col("tie")
    return ranked.where("k = 1").select(F.col("form").alias("token"), F.when(~F.coalesce(lost, F.lit(False)), F.col("word")).alias("original"), sure.alias("sure"))


# where tokens stand in a text, and the edges that suspicious_tokens cuts off them
_TOKEN = re.compile(r"(?<![!-\U0010ffff])[!-~]*\+[A-Za-z0-9/]{3}[!-~]*|(?<![!-,.-\U0010ffff])[!-,.-~]*[^\x00-\x7f][^\x00-\x20-]*|(?<![!-,.-\U0010ffff])[!-,.-~]*[\[\]{}|\\^~`][!-,.-~]*")
_EDGES = (re.compile(r"[A-Za-z+](?:.*[A-Za-z0-9-])?", re.S), re.compile(r"[@-^`-\U0010ffff](?:.*[@-^`-\U0010ffff])?", re.S), re.compile(r"[A-Za-z\x80-\U0010ffff](?:.*[A-Za-z\x80-\U0010ffff])?", re.S))


class Repairs(dict):
    """Garbled token -> original; knows by which characters a text may hold one, and remembers what it has looked up."""

    def __init__(self, pairs=()):
        super().__init__(pairs)
        marks = {next((c for c in token for odd in [_oddness(c)] if odd == max(map(_oddness, token))), "") for token in self} - {""}
        self.marks = re.compile("[" + "".join(map(re.escape, sorted(marks))) + "]") if marks else None
        self.seen: dict[str, tuple[int, int, str] | None] = {}

    def within(self, token: str) -> tuple[int, int, str] | None:
        """(start, end, original) of the part of a token of the text that is garbled."""
        if token not in self.seen:
            if len(self.seen) > REMEMBERED:
                self.seen.clear()
            parts = [part for edge in _EDGES if (part := edge.search(token)) and part[0] in self]
            self.seen[token] = (parts[0].start(), parts[0].end(), self[parts[0][0]]) if parts else None
        return self.seen[token]


def _oddness(c: str) -> int:
    """How little a character belongs to ordinary words."""
    if c.isascii():
        return 2 if not c.isalnum() else 0
    return 1 if c in LATIN or c.lower() in CYRILLIC else 3


def repaired(text: str, repairs: dict[str, str]) -> tuple[str, list[tuple[int, int]]]:
    """text with garbled tokens restored where they stand as tokens, and the (end, shift back, start, raw start) of each there."""
    known = repairs if isinstance(repairs, Repairs) else Repairs(repairs)
    if known.marks is None or not known.marks.search(text):
        return text, []
    out, steps, at, grown = [], [], 0, 0
    for m in _TOKEN.finditer(text):
        hit = known.within(m[0])
        if hit:
            start, end, new = m.start() + hit[0], m.start() + hit[1], hit[2]
            out.append(text[at:start])
            out.append(new)
            grown += len(new) - (end - start)
            steps.append((end + grown, -grown, start + grown - (len(new) - (end - start)), start))
            at = end
    if not steps:
        return text, []
    out.append(text[at:])
    return "".join(out), steps


def find_garbled(rows: DataFrame, columns: tuple[str, ...] = ("text", "title"), id_col: str = "id") -> DataFrame:
    """(id, col_name): one row per value with characters from a wrong decoding, restorable or not.

    Null ids and null or empty values give no row; repeated rows give one. Only the garbled dictionary meets the
    tokens; it is broadcast after a count, else joined with adaptive skew handling.
    """
    tokens = suspicious_tokens(rows, columns, id_col)
    known = small(table_cut(garbled_dictionary(tokens).where("sure").select("token")))
    return tokens.join(known, "token", "left_semi").select("id", "col_name").distinct()


def _restorer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        fixed = [repaired(value, dict(zip(tokens, originals)))[0] for value, tokens, originals in zip(b["value"], b["tokens"], b["originals"])]
        yield pd.DataFrame({"id": b["id"], "col_name": b["col_name"], "restored": fixed})


def restore(rows: DataFrame, columns: tuple[str, ...] = ("text", "title"), id_col: str = "id") -> DataFrame:
    """(id, col_name, restored): each affected value of distinct ids with its garbled tokens replaced by their originals, as whole tokens.

    Tokens whose letters are lost beyond recovery stay as they are, as does what only looks like a token inside another. Several
    versions of one id: the least result counts.
    """
    tokens = suspicious_tokens(rows, columns, id_col)
    known = small(table_cut(garbled_dictionary(tokens)))
    swaps = F.collect_set(F.when(F.col("original").isNotNull(), F.struct("token", "original")))
    per_value = tokens.join(known, "token").groupBy("id", "col_name").agg(swaps.alias("swaps"), F.bool_or("sure").alias("sure")).where("sure")
    per_value = per_value.select("id", "col_name", F.col("swaps.token").alias("tokens"), F.col("swaps.original").alias("originals"))
    # the affected values are picked before anything of the text is shuffled
    values = rows.select(F.col(id_col).alias("id"), F.explode(F.array(*[F.struct(F.lit(c).alias("col_name"), F.col(c).alias("value")) for c in columns])).alias("v")).select("id", "v.col_name", "v.value")
    affected = values.where(F.col("value").isNotNull()).join(small(table_cut(per_value), 20_000), ["id", "col_name"])
    fixed = affected.mapInPandas(_restorer, "id string, col_name string, restored string")
    return fixed.groupBy("id", "col_name").agg(F.min("restored").alias("restored"))
