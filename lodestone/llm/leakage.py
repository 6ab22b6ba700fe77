"""Held-out passages inside corpus documents: rarity-ordered prefix join on word shingles, then exact containment by local alignment."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.runtime import small, spread, table_cut

#: Words per shingle; share of an item's words that a leak covers; one word in CHANGED may differ.
SHINGLE, SHARE, CHANGED = 5, 0.5, 8
_MARKUP = re.compile(r"<[^<>\n]{1,80}>|&(?:nbsp|shy|zwnj|zwj|#\d{2,6}|#x[0-9a-fA-F]{2,5});|&(?=amp;)")
_INVISIBLE = re.compile("[\xad\u200b-\u200f\u2060\ufeff\u180e\u034f\x00]")
_COMBINING = re.compile("[\u0300-\u036f]")
_HYPHENATED = re.compile(r"[-‐‑¬](?<=[^\W\d_].)\s*\n[\s>|*#-]*(?=[^\W\d_])")
_WORD = re.compile(r"[^\W_]+")
#: Items up to which a shingle tells them apart. What more share is a phrase and no evidence, unless they share half of the item as one piece.
SHARED = 2
#: Bits of the filter that the item shingles set, two each; at any number of them it lets all of them through, and of others the fewer the emptier it is.
FILTER_BITS = 1 << 25
#: Common shingles from which a pair is aligned; an item whose leaks may keep fewer whole asks for fewer.
LEAST_HITS = 2
#: Words whose folded form and hash a worker remembers.
REMEMBERED = 500_000
#: Matched share of the item words that an alignment spans, from which it is one passage with at most one word in CHANGED altered.
DENSITY = 1 - 1.75 / CHANGED


class _Folding(dict):
    """Word -> its letters without case, accents and compatibility forms; filled as words turn up."""

    plain = {"ø": "o", "æ": "ae", "œ": "oe", "ß": "ss", "đ": "d", "ð": "d", "ł": "l", "þ": "th"}

    def __missing__(self, word: str) -> str:
        if len(self) > REMEMBERED:
            self.clear()
        letters = unicodedata.normalize("NFKD", word.casefold())
        self[word] = word if word.isascii() else "".join(self.plain.get(c, c) for c in letters if not unicodedata.combining(c))
        return self[word]


class _Hashing(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = xxhash.xxh3_64_intdigest(word)
        return self[word]


_FOLD, _HASH = _Folding(), _Hashing()


def words(text: str) -> list[str]:
    """Folded words: no case, accents, markup, invisible characters, or hyphens at line ends."""
    if "<" in text or "&" in text:
        text = _MARKUP.sub(" ", text)
    if not text.isascii() or "\x00" in text:
        text = _INVISIBLE.sub("", text)
        if _COMBINING.search(text):
            text = unicodedata.normalize("NFC", text)
    parts = _WORD.findall(_HYPHENATED.sub("", text).lower())
    return parts if text.isascii() else [_FOLD[w] for w in parts]


def _hash(parts: list[str]) -> np.ndarray:
    """64-bit hash of each run of SHINGLE words."""
    h = np.fromiter(map(_HASH.__getitem__, parts), dtype=np.uint64, count=len(parts))
    n = len(h) - SHINGLE + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    out = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(SHINGLE):
            out = (out ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(31)
    return out.view(np.int64)


def needed(n_words: int) -> int:
    """Intact shingles that a leak of SHARE of n_words has at least, with one word in CHANGED differing or broken, and a foreign line in it."""
    part = int(np.ceil(SHARE * n_words))
    return max(1, part - SHINGLE + 1 - SHINGLE * int(np.ceil(part / CHANGED)) - (SHINGLE - 1))


def align(item: list[str], window: list[str], least: float = 0) -> tuple[int, int]:
    """(matched words, item words spanned) of the best local alignment in order; a word broken in two counts as itself.

    (0, 0) where fewer than `least` of the item's words are in the window at all, as then no alignment can match as many.
    """
    where: dict[str, list[int]] = {}
    for i, w in enumerate(item):
        where.setdefault(w, []).append(i)
    merged, k = [], 0
    while k < len(window):
        for size in (1, 2, 3):
            joined = "".join(window[k : k + size])
            if joined in where:
                break
        else:
            size, joined = 1, window[k]
        merged.append(joined)
        k += size
    if sum(min(c, len(where[w])) for w, c in Counter(w for w in merged if w in where).items()) < least:
        return 0, 0
    n, gap = len(item), 0.4
    steps = gap * np.arange(n + 1)
    table = np.zeros((len(merged) + 1, n + 1))
    for j, w in enumerate(merged, 1):
        row = np.maximum(0, table[j - 1] - gap)
        diagonal = table[j - 1, :-1] - 0.5
        if w in where:
            at = where[w]
            diagonal[at] = table[j - 1, at] + 1
        row[1:] = np.maximum(row[1:], diagonal)
        table[j] = np.maximum.accumulate(row + steps) - steps
    j, i = np.unravel_index(table.argmax(), table.shape)
    last, matched = i, 0
    while j and i and table[j, i] > 1e-9:
        hit = merged[j - 1] == item[i - 1]
        if hit and abs(table[j, i] - table[j - 1, i - 1] - 1) < 1e-6:
            matched, j, i = matched + 1, j - 1, i - 1
        elif abs(table[j, i] - table[j - 1, i - 1] + 0.5) < 1e-6:
            j, i = j - 1, i - 1
        elif abs(table[j, i] - table[j - 1, i] + gap) < 1e-6:
            j -= 1
        else:
            i -= 1
    return matched, int(last - i)


def holds(item: list[str], doc: list[str], hits: list[tuple[int, int]], least: float = 0) -> tuple[int, int]:
    """Best (matched, spanned) over the item-sized windows of doc around the shingle hits (document position, item position)."""
    best = (0, 0)
    spans = sorted((d - i, d) for d, i in hits)
    reach = len(item) // 3 + 25
    while spans:
        first = spans[0][0]
        spans = [s for s in spans if s[0] > first + reach]
        best = max(best, align(item, doc[max(0, first - 10) : first + len(item) + 2 * reach], least))
    return best


def item_shingles(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, pos, shingle, need, n_shingles) of each item's distinct shingles."""
    kind = items.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, text in zip(b["item"], b["text"]):
                parts = words(text)
                h = _hash(parts)
                out += [(i, k, s, needed(len(parts)), len(h)) for k, s in enumerate(h.tolist())]
            yield pd.DataFrame(out, columns=["item", "pos", "shingle", "need", "n"])

    rows = items.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("item"), F.col(text_col).alias("text")).distinct()
    return rows.mapInPandas(run, f"item {kind}, pos int, shingle long, need int, n int")


def _places(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of the filter that belong to each hash."""
    u = h.view(np.uint64)
    return u & np.uint64(FILTER_BITS - 1), (u >> np.uint64(32)) & np.uint64(FILTER_BITS - 1)


def _set_bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        bits = np.unique(np.concatenate(_places(b["shingle"].to_numpy(dtype=np.int64))))
        word, start = np.unique(bits >> np.uint64(6), return_index=True)
        value = np.bitwise_or.reduceat(np.uint64(1) << (bits & np.uint64(63)), start) if len(bits) else bits
        yield pd.DataFrame({"word": word.astype(np.int64), "bits": value.view(np.int64)})


def shingle_filter(shingles: DataFrame) -> np.ndarray:
    """A Bloom filter of FILTER_BITS over the column shingle: put together by tasks, of one size however many there are."""
    rows = shingles.mapInPandas(_set_bits, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    out = np.zeros(FILTER_BITS >> 6, dtype=np.uint64)
    out[rows["word"].to_numpy(dtype=np.int64)] = rows["bits"].to_numpy(dtype=np.int64).view(np.uint64)
    return out


def _touched(shared) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for b in batches:
            docs, texts, at, found = [], [], [], []
            for d, text in zip(b["doc"], b["text"]):
                h = _hash(words(text))
                keep = np.flatnonzero(np.bitwise_and.reduce([known[p >> np.uint64(6)] >> (p & np.uint64(63)) for p in _places(h)]) & np.uint64(1)) if len(h) else h
                if len(keep):
                    docs.append(d)
                    texts.append(text)
                    at.append(keep.tolist())
                    found.append(h[keep].tolist())
            if docs:
                yield pd.DataFrame({"doc": docs, "text": texts, "at": at, "shingle": found})

    return run


def _verifier(share: float) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out, last, parts = [], None, []
            for d, text, item, item_text, hits in zip(b["doc"], b["text"], b["item"], b["item_text"], b["hits"]):
                if last != d:
                    parts, last = words(text), d
                own = words(item_text)
                matched, spanned = holds(own, parts, [(h["at"], h["pos"]) for h in hits], (len(own) * share - 1) * DENSITY)
                out.append((d, item, matched, spanned, len(own)))
            yield pd.DataFrame(out, columns=["doc", "item", "matched", "spanned", "n"])

    return run


def evidence(shingles: DataFrame, share: float = SHARE) -> DataFrame:
    """Of item_shingles those that tell of a leak: of at most SHARED items, or in a shared piece of at least `share` of the item's words,
    or all where the item has fewer such than a leak keeps whole."""
    usual = shingles.groupBy("shingle").agg(F.count_distinct("item").alias("items"))
    common = F.col("items") > SHARED
    # neighbouring positions of one item that are alike common or not form a piece
    by_place = Window.partitionBy("item").orderBy("pos")
    marked = shingles.join(usual, "shingle").withColumn("common", common).withColumn("piece", F.row_number().over(by_place) - F.row_number().over(Window.partitionBy("item", "common").orderBy("pos")))
    words = F.count("*").over(Window.partitionBy("item", "common", "piece")) + (SHINGLE - 1)
    told = marked.withColumn("told", ~F.col("common") | (words >= F.ceil((F.col("n") + SHINGLE - 1) * F.lit(share))))
    own = F.sum(F.col("told").cast("int")).over(Window.partitionBy("item"))
    return told.withColumn("own", own).where(F.col("told") | (F.col("own") < F.col("need"))).select(*shingles.columns)


def leaks(documents: DataFrame, items: DataFrame, doc_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", share: float = SHARE) -> DataFrame:
    """(doc_col, item_col, matched, spanned, n): every pair whose document holds a passage near to an item, with the item words matched
    in order, the item words from the first to the last of them, and the item's words; zeros where too few words meet for `share`.

    A shingle of more than SHARED items is a phrase and no evidence where the piece of the item that is so shared has less than `share` of
    its words, unless the item has too few others; a longer piece, as near copies of an item have, is evidence for each of them. The
    evidence is ordered by rarity in the corpus; only an item's rarest n - need + LEAST_HITS are joined, of which a leak, that keeps at
    least `need` whole, has LEAST_HITS; where need is less, that many hits do. Null texts and ids take no part, items shorter than a
    shingle leak nowhere, repeated rows count once. A filter of fixed size stops most documents in the scan; those with a hit are written, and only their texts are shuffled.
    """
    doc_kind, item_kind = (t.schema[c].dataType.simpleString() for t, c in ((documents, doc_col), (items, item_col)))
    shingles = table_cut(evidence(table_cut(item_shingles(items, item_col, text_col)), share))
    shared = documents.sparkSession.sparkContext.broadcast(shingle_filter(shingles.select("shingle")))
    docs = documents.where(F.col(doc_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(doc_col).alias("doc"), F.col(text_col).alias("text"))
    touched = table_cut(spread(docs).mapInPandas(_touched(shared), f"doc {doc_kind}, text string, at array<int>, shingle array<long>"))
    df = touched.select(F.explode(F.array_distinct("shingle")).alias("shingle")).groupBy("shingle").agg(F.count("*").alias("df"))
    # a shingle that no document has can't be met, whatever its rank
    rank = F.row_number().over(Window.partitionBy("item").orderBy("df", "shingle", "pos"))
    ranked = shingles.join(df, "shingle", "left").withColumn("df", F.coalesce("df", F.lit(0))).withColumn("r", rank)
    hits_needed = F.least(F.col("need"), F.lit(LEAST_HITS))
    prefix = ranked.where(F.col("r") <= F.col("n") - F.col("need") + hits_needed).select("item", "pos", "shingle", hits_needed.alias("least"))
    hits = touched.select("doc", F.explode(F.arrays_zip("at", "shingle")).alias("h")).select("doc", "h.at", "h.shingle")
    pairs = hits.join(small(prefix), "shingle").groupBy("doc", "item").agg(F.array_sort(F.collect_set(F.struct("at", "pos"))).alias("hits"), F.min("least").alias("least")).where(F.size("hits") >= F.col("least")).drop("least")
    texts = small(items.where(F.col(item_col).isNotNull() & F.col(text_col).isNotNull()).groupBy(F.col(item_col).alias("item")).agg(F.min(text_col).alias("item_text")))
    found = touched.select("doc", "text").join(pairs, "doc").join(texts, "item").select("doc", "text", "item", "item_text", "hits")
    out = found.mapInPandas(_verifier(share), f"doc {doc_kind}, item {item_kind}, matched int, spanned int, n int").groupBy("doc", "item").agg(F.max("matched").alias("matched"), F.max("spanned").alias("spanned"), F.max("n").alias("n"))
    return out.withColumnsRenamed({"doc": doc_col, "item": item_col})


def leaked(documents: DataFrame, items: DataFrame, doc_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", share: float = SHARE) -> DataFrame:
    """(doc_col, item_col) of the documents that hold at least share of an item's words in one passage, one word in CHANGED aside."""
    enough = F.col("matched") >= F.col("spanned") * DENSITY
    return leaks(documents, items, doc_col, item_col, text_col, share).where((F.col("spanned") >= F.col("n") * share - 1) & enough).select(doc_col, item_col)
