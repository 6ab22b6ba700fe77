"""Token ids by a byte-level BPE vocabulary: a minimal perfect hash for whole pre-tokens, a heap over linked bytes for the rest."""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.runtime import spread

#: Folder of the public vocabularies; a parameter of every function here.
VOCABULARIES = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
# Fixed value: the pattern that this vocabulary's pre-tokens follow.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Merged pre-tokens a worker remembers between batches.
REMEMBERED = 200_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PerfectHash:
    """Minimal perfect hash of byte strings by hash and displace: n keys, n slots, one displacement per bucket of about four keys."""

    def __init__(self, items: dict[bytes, int]):
        keys = list(items)
        self.n, self.m = len(keys), max(1, len(keys) // 4)
        h = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], dtype=np.uint64)
        bucket = (h % np.uint64(self.m)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(self.m + 1))
        self.shift = np.zeros(self.m, dtype=np.uint64)
        taken = np.zeros(self.n, dtype=bool)
        for b in np.argsort(-np.diff(cuts), kind="stable"):
            members = h[order[cuts[b] : cuts[b + 1]]]
            if not len(members):
                break
            # displacements are tried in growing blocks until one puts every member in a free slot of its own
            first, block = 0, 16
            while True:
                tried = self._slots(members[:, None], np.arange(first, first + block, dtype=np.uint64)[None, :])
                good = ~taken[tried].any(axis=0)
                if len(members) > 1:
                    good &= (np.diff(np.sort(tried, axis=0), axis=0) != 0).all(axis=0)
                if good.any():
                    break
                first, block = first + block, min(4 * block, 65536)
            at = int(good.argmax())
            taken[tried[:, at]] = True
            self.shift[b] = first + at
        at = self.slots(h)
        self.keys: list[bytes] = [b""] * self.n
        self.ids = [0] * self.n
        for slot, key in zip(at.tolist(), keys):
            self.keys[slot] = key
            self.ids[slot] = items[key]

    def _slots(self, h: np.ndarray, d) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (h ^ (d * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xFF51AFD7ED558CCD)
            x ^= x >> np.uint64(33)
        return (x % np.uint64(self.n)).astype(np.int64)

    def slots(self, h: np.ndarray) -> np.ndarray:
        return self._slots(h, self.shift[(h % np.uint64(self.m)).astype(np.int64)])

    def lookup(self, words: list[bytes]) -> list[int]:
        """The id of each word, -1 where it is no key."""
        if not words:
            return []
        at = self.slots(np.array([xxhash.xxh3_64_intdigest(w) for w in words], dtype=np.uint64)).tolist()
        keys, ids = self.keys, self.ids
        return [ids[s] if keys[s] == w else -1 for s, w in zip(at, words)]


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Byte-pair merges of word in rank order: bytes are linked, a heap holds the mergeable neighbours."""
    n = len(word)
    end = list(range(1, n + 1))  # end[i]: where the piece starting at i ends; 0 once merged into another
    left = list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        r = ranks.get(word[i : i + 2])
        if r is not None:
            heap.append((r, i, i + 2))
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if not j or j >= n or end[j] != stop:
            continue  # one of the two has changed since
        end[i], end[j] = stop, 0
        if stop < n:
            left[stop] = i
            r = ranks.get(word[i : end[stop]])
            if r is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (h := left[i]) >= 0:
            r = ranks.get(word[h:stop])
            if r is not None:
                heapq.heappush(heap, (r, h, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


class Encoder:
    def __init__(self, ranks: dict[bytes, int], table: PerfectHash | None = None):
        self.table = table or PerfectHash(ranks)
        self.ranks = ranks
        self.known: dict[str, list[int]] = {}

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        split = regex.compile(PATTERN).findall
        parts = [split(t) if t else [] for t in texts]
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        fresh = list({w for p in parts for w in p if w not in known})
        raw = [w.encode("utf-8", "replace") for w in fresh]
        for w, b, i in zip(fresh, raw, self.table.lookup(raw)):
            known[w] = [i] if i >= 0 else merge(b, self.ranks)
        return [[i for w in p for i in known[w]] for p in parts]


def _encoder(shared) -> Callable:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        made = Encoder(*shared.value)
        for texts in batches:
            # steps of 500 texts bound the pre-tokens held at once
            yield pd.Series([ids for at in range(0, len(texts), 500) for ids in made.encode(texts.iloc[at : at + 500].tolist())], index=texts.index)

    return run


def encode_column(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(id_col, ids): the token ids of each row's whole text, without special tokens; text that looks like one is ordinary text.

    Empty and null texts give an empty list. Rows are kept one for one, null ids and repeated rows included. No shuffle; the
    vocabulary (fixed size) is the only thing sent to the executors.
    """
    ranks = load_ranks(vocabulary or os.path.join(VOCABULARIES, "byte_bpe_50k.tiktoken"))
    shared = rows.sparkSession.sparkContext.broadcast((ranks, PerfectHash(ranks)))
    udf = F.pandas_udf(_encoder(shared), "array<int>", F.PandasUDFType.SCALAR_ITER)
    return spread(rows.select(id_col, text_col)).select(id_col, udf(F.coalesce(text_col, F.lit(""))).alias("ids"))
