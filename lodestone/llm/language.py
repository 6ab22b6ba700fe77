"""Language of each text and of each of its segments: multinomial naive Bayes over hashed character n-grams, scored sparsely in numpy."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.runtime import spread

LANGUAGES = ("sv", "en", "de", "da", "fr", "es", "fi", "ru")
#: Labelled texts per language that the model is fitted on, at most.
TRAINING_TEXTS = 400
BUCKETS = 1 << 17
SIZES = (2, 3, 4)
#: Letters from which a sentence speaks for itself; shorter ones and headings go with their surroundings.
LEAST_LETTERS = 20
#: Log-likelihood that a change of language costs, and the most that one sentence can say against a language.
SWITCH, MOST = 12.0, 40.0
# Notations of language labels beside two-letter codes with or without a region.
NAMES = {
    "swe": "sv", "svenska": "sv", "swedish": "sv", "eng": "en", "english": "en", "engelska": "en", "ger": "de", "deu": "de", "german": "de", "deutsch": "de", "tyska": "de",
    "dan": "da", "danish": "da", "dansk": "da", "danska": "da", "fra": "fr", "fre": "fr", "french": "fr", "français": "fr", "franska": "fr", "spa": "es", "spanish": "es", "español": "es", "spanska": "es",
    "fin": "fi", "finnish": "fi", "suomi": "fi", "finska": "fi", "rus": "ru", "russian": "ru", "русский": "ru", "ryska": "ru",
}
# Readings of the corpus's letters under a wrong encoding that training texts are also shown in.
CHAINS = [("utf-8", "latin-1"), ("utf-8", "cp1252"), ("utf-8", "mac_roman"), ("utf-8", "cp437"), ("utf-8", "cp1251"), ("cp1252", "mac_roman"), ("cp1252", "cp850"), ("mac_roman", "cp1252"), ("cp850", "latin-1"), ("cp1251", "latin-1"), ("cp1251", "koi8_r"), ("koi8_r", "cp1251"), ("koi8_r", "latin-1"), ("cp866", "cp1251"), ("latin-1", "utf-8"), ("utf-8", "cp850"), ("cp866", "latin-1"), ("utf-7", "latin-1")]

_NOISE = re.compile(r"\S*(?:@|://|\d)\S*|\S+\[at\]\S+|\(at\)")
_NOT_LETTER = re.compile(r"[\s\d!-/:-@\[-`{-¿×÷‐-⁞€™]+")
_SPEAKER = re.compile(r"(?:[-*•>#|]+\s+)*(?:\w[\w.’'-]*(?:,? [\w(][\w.’')-]*){0,4}:\s+)?")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"”»’)]*\s+")
_FINAL = re.compile(r"[.!?…][\"”»’)]*\s*$")
_CONTACT = re.compile(r"@|\[at\]|\(at\)|(?:\d[ ./()+-]{0,3}){5}|[^\W\d_a-zåäöéüèæøßа-я][\w’-]+ \d{1,3} ?[A-Za-z]?\b|\b\d{1,3}[A-Za-z]? [^\W\d_a-zåäöéüèæøß][\w’-]+ [^\W\d_a-zåäöéüèæøß]\w+|(?<!^)(?<![.!?] )\b[^\W\d_a-zåäöéüèæøßа-я][\w’-]+\.? [^\W\d_a-zåäöéüèæøßа-я][\w’-]{2,}")
_CAPITAL = re.compile(r"(?<!^)\b[^\W\d_a-zåäöéüèæøßа-я][\w’-]*")


def label_language(label: str | None) -> str | None:
    """The two-letter code that a label denotes in any notation, None if it names none of the known languages."""
    head = re.split(r"[-_\s(]", (label or "").strip().lower())[0]
    return head if head in LANGUAGES else NAMES.get(head)


def clean(text: str) -> str:
    """Lower-case letters between single spaces, without addresses, numbers and signs."""
    return " " + _NOT_LETTER.sub(" ", _NOISE.sub(" ", text)).strip().lower() + " "


def _hashed(texts: list[str]) -> tuple[np.ndarray, Iterator[np.ndarray]]:
    """Where each text starts, and for every size in turn the bucket of the n-gram at each character of all texts; BUCKETS where one would
    reach beyond its text. The hash of a longer n-gram goes on from that of the shorter."""
    code = np.frombuffer(("\0".join(texts) + "\0" * SIZES[-1]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])[:-1]]).astype(np.int64) if texts else np.zeros(0, np.int64)

    def sizes() -> Iterator[np.ndarray]:
        wide, gap = code.astype(np.uint64), code == 0
        h, outside = np.zeros(len(code), dtype=np.uint64), np.zeros(len(code), dtype=bool)
        for n in range(1, SIZES[-1] + 1):
            stop = len(code) - n + 1
            with np.errstate(over="ignore"):
                h = (h[:stop] ^ wide[n - 1 :]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            outside = outside[:stop] | gap[n - 1 :]
            if n in SIZES:
                bucket = (h & np.uint64(BUCKETS - 1)).astype(np.int64)
                bucket[outside] = BUCKETS
                yield bucket

    return starts, sizes()


def gram_counts(texts: list[str]) -> np.ndarray:
    """How often each bucket is met by the n-grams of all texts."""
    return sum((np.bincount(bucket, minlength=BUCKETS + 1)[:BUCKETS] for bucket in _hashed(texts)[1]), np.zeros(BUCKETS))


def gram_sums(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text the sum of the table's rows (bucket, column) over its n-grams, and their number."""
    out, count = np.zeros((len(texts), table.shape[1])), np.zeros(len(texts), dtype=np.int64)
    if texts:
        padded = np.concatenate([table, np.zeros((1, table.shape[1]), table.dtype)])
        starts, sizes = _hashed(texts)
        for bucket in sizes:
            out += np.add.reduceat(padded[bucket], starts, axis=0)
            count += np.add.reduceat((bucket < BUCKETS).astype(np.int64), starts)
    return out, count


def scores(texts: list[str], logp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihood of each text under each language, and its number of n-grams."""
    return gram_sums(texts, logp)


def _garbled(text: str) -> Iterator[str]:
    for src, dst in CHAINS:
        try:
            yield text.encode(src).decode(dst, "replace")
        except UnicodeError:
            pass


def train(texts: list[tuple[str, str]], alpha: float = 0.3) -> np.ndarray:
    """Log-probability matrix (bucket, language). Texts whose label the first fit contradicts are left out of the second."""
    kept = [(clean(t), LANGUAGES.index(y), t) for t, y in texts if t]
    logp = np.zeros((BUCKETS, len(LANGUAGES)), dtype=np.float32)
    for turn in range(2):
        count = np.full((len(LANGUAGES), BUCKETS), alpha)
        for y in range(len(LANGUAGES)):
            own = [(c, t) for c, z, t in kept if z == y]
            for at in range(0, len(own), 50):
                count[y] += gram_counts([c for c, _ in own[at : at + 50]])
            if turn:
                # every tenth text also as it looks after a wrong decoding, at low weight
                bad = [clean(g) for _, t in own[::10] for g in _garbled(t[:2000])]
                if bad:
                    count[y] += 0.1 * gram_counts(bad)
        logp = np.log(count / count.sum(axis=1, keepdims=True)).T.astype(np.float32)
        if not turn:
            guess = np.concatenate([scores([c for c, _, _ in kept[at : at + 200]], logp)[0].argmax(axis=1) for at in range(0, len(kept), 200)]) if kept else []
            kept = [x for x, g in zip(kept, guess) if x[1] == g]
    return logp


def fit(documents: DataFrame, text_col: str = "text", lang_col: str = "lang", limit: int = TRAINING_TEXTS) -> np.ndarray:
    """The matrix fitted on at most limit labelled texts per language, chosen by hash so that the choice is stable."""
    order = Window.partitionBy(lang_col).orderBy(F.xxhash64(text_col), text_col)
    rows = documents.where(F.col(lang_col).isin(*LANGUAGES) & F.col(text_col).isNotNull()).select(text_col, lang_col).withColumn("r", F.row_number().over(order)).where(F.col("r") <= limit)
    return train([(r[0], r[1]) for r in rows.select(F.substring(text_col, 1, 20000), lang_col).collect()])


def sentences(text: str) -> list[tuple[str, bool]]:
    """(sentence, speaks): the sentences in order; headings, lone names, contact lines and the like don't speak for a language."""
    out = []
    for k, line in enumerate(text.split("\n")):
        bare = line.strip()
        if not bare:
            continue
        if bare.startswith("Heading:"):
            out.append((bare, False))
            continue
        body = bare[_SPEAKER.match(bare).end() :]
        parts = _SENTENCE.split(body)
        for part in parts:
            whole = bool(_FINAL.search(part)) or len(parts) > 1 or k > 0 and len(part) > 60
            plain = clean(_CAPITAL.sub("", part)) if part[:1].isupper() else clean(part)
            out.append((part, whole and sum(map(len, plain.split())) >= LEAST_LETTERS and not _CONTACT.search(part)))
    return out


def segment(evidence: np.ndarray, speaks: list[bool], priors: np.ndarray) -> list[int]:
    """Language per sentence: the cheapest sequence under bounded evidence and a cost per change; silent sentences follow the previous one."""
    idx = [k for k, s in enumerate(speaks) if s]
    if not idx:
        return [int(priors.argmax())] * len(speaks)
    e = evidence[idx]
    e = np.maximum(e - e.max(axis=1, keepdims=True), -MOST)
    best, back = e[0].copy(), []
    for row in e[1:]:
        jump = best.max() - SWITCH
        stay = best >= jump
        back.append(np.where(stay, np.arange(len(best)), best.argmax()))
        best = np.where(stay, best, jump) + row
    path = [int(best.argmax())]
    for turn in reversed(back):
        path.append(int(turn[path[-1]]))
    path = path[::-1]
    out, at = [], 0
    for s in speaks:
        out.append(path[at] if s else path[max(at - 1, 0)])
        at += s
    return out


def _segmenter(shared) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        logp = shared.value
        for big in batches:
            for start in range(0, len(big), 500):
                b = big.iloc[start : start + 500]
                split = [sentences(t) for t in b["text"]]
                flat = [clean(s) for parts in split for s, _ in parts]
                score, grams = scores(flat, logp)
                out, at = [], 0
                for i, v, parts in zip(b["id"], b["v"], split):
                    n = len(parts)
                    own, size = score[at : at + n], grams[at : at + n]
                    at += n
                    if not n:
                        continue
                    langs = segment(own, [s for _, s in parts], own.sum(axis=0))
                    first = number = 0
                    for k in range(1, n + 1):
                        if k == n or langs[k] != langs[first]:
                            total = own[first:k].sum(axis=0)
                            z = (total - total.max()) / np.sqrt(max(1, size[first:k].sum()))
                            p = np.exp(z) / np.exp(z).sum()
                            out.append((i, v, number, LANGUAGES[langs[first]], float(p[langs[first]])))
                            first, number = k, number + 1
                yield pd.DataFrame(out, columns=["id", "v", "seg_no", "lang", "confidence"])

    return run


def language_segments(rows: DataFrame, model: np.ndarray, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, seg_no, lang, confidence): the longest runs of sentences in one language of each distinct id.

    Null ids, null texts and texts without any visible character give no row; of versions of one id one is taken whole. Texts don't leave
    their partition; the matrix (fixed size) is the only thing sent out.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)
    texts = spread(rows.where(F.col(id_col).isNotNull() & F.col(text_col).rlike(r"\S")).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("v")))
    found = texts.mapInPandas(_segmenter(shared), "id string, v long, seg_no int, lang string, confidence double")
    one = found.withColumn("_v", F.min("v").over(Window.partitionBy("id"))).where("v = _v")
    return one.dropDuplicates(["id", "seg_no"]).select("id", "seg_no", "lang", "confidence")


def relabel(rows: DataFrame, labels: DataFrame, model: np.ndarray) -> DataFrame:
    """(id, seg_no, lang, confidence) of each labelled id whose label is absent, names no language or another than its text's first one, or
    whose text has several languages. Repeated labels count once; an id with a missing and a right label is a case."""
    found = language_segments(rows, model)
    head = F.lower(F.regexp_extract(F.coalesce("label", F.lit("")), r"^\s*([^-_\s(]*)", 1))
    names = F.create_map(*[F.lit(x) for pair in ({c: c for c in LANGUAGES} | NAMES).items() for x in pair])
    given = labels.where(F.col("id").isNotNull()).groupBy("id").agg(F.min(F.coalesce(F.try_element_at(names, head), F.lit(""))).alias("given"))
    first = found.groupBy("id").agg(F.min(F.struct("seg_no", "lang"))["lang"].alias("first"), F.count("*").alias("n"))
    cases = given.join(first, "id").where((F.col("given") != F.col("first")) | (F.col("n") > 1)).select("id")
    return found.join(cases, "id", "left_semi")
