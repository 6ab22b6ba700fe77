"""Newly written lines of emails: every line labelled new, quoted, signature or disclaimer by a sequence model trained here.

The model is a linear chain over line features (position, punctuation, prefix, wording, neighbouring lines) decoded by Viterbi. It is
trained with the averaged perceptron on a bounded sample of mails that a cautious labelling routine has marked.
"""

from __future__ import annotations

import random
import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.runtime import hash_sample, spread

LABELS = ("new", "quoted", "signature", "disclaimer", "head")
#: Mails the model is fitted on, at most.
TRAINING_MAILS = 3000
HEAD_LINES = 5

# Wordings of mail programs and correspondents.
WROTE = r"wrote|writes|skrev|skriver|schrieb|schreibt|a écrit|écrit|escribió|kirjoitti|написал|написала|пишет"
CLOSING = (
    "best|best regards|kind regards|warm regards|regards|thanks|many thanks|thank you|all the best|cheers|sincerely|yours|yours sincerely|take care|"
    "med vänliga hälsningar|med vänlig hälsning|vänliga hälsningar|vänlig hälsning|hälsningar|hälsar|mvh|vänligen|allt gott|tack|ha det bra|"
    "mit freundlichen grüßen|freundliche grüße|mfg|viele grüße|beste grüße|liebe grüße|grüße|gruß|herzliche grüße|danke|"
    "med venlig hilsen|venlig hilsen|mange hilsner|hilsen|kh|vh|bedste hilsner|tak|"
    "cordialement|bien à vous|bien cordialement|amicalement|merci|à bientôt|saludos|un saludo|saludos cordiales|gracias|atentamente|"
    "ystävällisin terveisin|terveisin|terveiset|parhain terveisin|kiitos|с уважением|всего доброго|спасибо|с наилучшими пожеланиями"
)


def _loose(wording: str) -> str:
    """wording whose letters of the Latin alphabets beyond ASCII may have come through a wrong decoding."""
    return re.sub("[À-ž]", lambda m: rf"(?:{m[0]}|\S{{1,8}})", wording)


_CLOSING = re.compile(rf"(?:{_loose(CLOSING)})\s*[,!.]?\s*$", re.I)
_DEVICE = re.compile(_loose(r"(?:sent from (?:my|a)|get outlook|skicka[dt] fr\S{1,9}n min|von mein\w+ .{2,30}gesendet|gesendet von mein|sendt fra min|envoyé (?:de|depuis) mon|enviado desde mi|lähetetty .{2,30}|отправлено с)\b"), re.I)
_LEGAL = re.compile(
    "confidential|privileged|intended (?:solely|only) for|received (?:it|this \\S+) in error|disclaimer|sekretess|endast avsedd?t? f|rätt mottagare|skriver ut detta me|"
    "vertraulich|genannten Empf|Weitergabe ist|bestimmt\\. |fortrolig|rette modtager|confidentiel|destinataire|confidencial|destinatario|luottamuksell|vastaanottaj|конфиденциальн|"
    "meddela avs|radera det och|Diese Nachricht enth|Detta meddelande kan inneh|nur f\\S+ den genannten|avsett f\\S+ adressaten",
    re.I,
)
_MARKER = re.compile(r"\s*-{4,}\s*\S.*\S\s*-{3,}\s*$|\s*-{4,}\s*\S+\s*-{3,}\s*$")
_MARK_HEAD = re.compile(_loose(r"(?:from|från|von|de|fra|lähettäjä|от|sent|skickat|gesendet|envoyé|enviado|sendt|to|till|an|à|para|til|subject|ämne|betreff|objet|asunto|emne|date|datum|fecha|cc|kopia)\s?:"), re.I)
_SENDER_HEAD = re.compile(_loose(r"(?:from|från|von|de|fra|lähettäjä|от)\s?:"), re.I)
_PREFIX = re.compile(r"\s*(?:>|\|(?!.*\|\s*$)|\|\s*[>|])")
_WROTE_END = re.compile(rf"(?:\b(?:{WROTE})\b.*:\s*$)|^\s*<\S+@\S+>\s*(?:{WROTE})?\s*:\s*$|^\s*(?:{WROTE})?\s*:\s*$", re.I)
_WROTE_HEAD = re.compile(rf"(?:on|den|am|le|el|il|\d{{1,4}}|[^\W\d_]+)\b.*(?:\d{{4}}|\b(?:{WROTE})\b)", re.I)
_CARRIED = re.compile(rf"^\s*<\S+@\S+>\s*(?:{WROTE})?\s*:\s*$|^\s*(?:{WROTE})?\s*:\s*$", re.I)
_CONTACT = re.compile(r"(?:tel|tfn|phone|mobil\w*|fax|e-?mail|mail|web|www)\b\s*[.:]|^\S+@\S+$|^[+(]?\d[\d\s()./-]{6,}(?:ext\.?\s*\d+)?$|^\S.*\s\|\s.*\S@\S|https?://\S+$", re.I)
_NAME = re.compile(r"(?:[^\W\d_a-zåäöéüèæøßàâáíóúñ][\w’'.-]*,?\s*){1,4}$")
_SLASH = re.compile(r"\s*[/–—~]\s?[^\W\d_][\w’'-]*(?:[ -][^\W\d_][\w’'.-]*){0,2}\s*$")
_END = re.compile(r"[.!?…:;][\"”»’)\]]*\s*$")
_GREETING = re.compile(_loose(r"(?:hi|hello|hej|hejsan|hallå|dear|hey|hallo|liebe|lieber|guten|moin|god|good|morning|morgon|kære|bonjour|salut|hola|moi|hei|привет|здравствуйте)\b.{0,40}[,!]\s*$"), re.I)
_DASHES = re.compile(r"\s*--\s*$")
_UNDERSCORES = re.compile(r"\s*_{5,}\s*$")
_ALNUM = re.compile(r"[^\W_]")


def _header_block(lines: list[str], k: int) -> bool:
    """Whether the header of an earlier message starts at line k: three fields of different names, one below the other."""
    names = [m[0].casefold() for line in lines[k : k + 3] if (m := _MARK_HEAD.match(line.strip()))]
    return len(set(names)) == 3


def _kinds(lines: list[str]) -> list[str]:
    """The strongest shape of each line, by itself and the line after it."""
    out = []
    for k, line in enumerate(lines):
        after = lines[k + 1] if k + 1 < len(lines) else ""
        bare = line.strip()
        if k < HEAD_LINES:
            kind = "head"
        elif not bare:
            kind = "blank"
        elif _PREFIX.match(line):
            kind = "prefixed"
        elif _MARKER.match(line):
            kind = "marker"
        elif _LEGAL.search(line) and len(bare) > 50:
            kind = "legal"
        elif len(bare) < 160 and _WROTE_END.search(line) and (any(c.isdigit() for c in bare) or "@" in bare or _CARRIED.match(line)):
            kind = "intro"
        elif len(bare) < 120 and after and _CARRIED.match(after) and _WROTE_HEAD.match(bare) and not _END.search(bare):
            kind = "intro"
        elif _DEVICE.match(bare):
            kind = "device"
        elif _DASHES.match(line):
            kind = "dashes"
        elif _UNDERSCORES.match(line):
            kind = "marker" if _MARK_HEAD.match(after.strip()) else "underscores"
        elif len(bare) < 45 and _CLOSING.match(bare):
            kind = "closing"
        elif _SLASH.match(line) and len(bare) < 40:
            kind = "slash"
        elif _GREETING.match(bare) and len(bare) < 50:
            kind = "greeting"
        elif _SENDER_HEAD.match(bare) and _header_block(lines, k):
            kind = "marker"
        elif _MARK_HEAD.match(bare):
            kind = "fields"
        elif _CONTACT.match(bare) and len(bare) < 90:
            kind = "contact"
        elif not _ALNUM.search(bare):
            kind = "rule"
        elif len(bare) < 45 and _NAME.match(bare) and not _END.search(bare):
            kind = "name"
        elif len(bare) < 60 and not _END.search(bare):
            kind = "short"
        else:
            kind = "prose"
        out.append(kind)
    return out


def _rest_of_quote(lines: list[str], kinds: list[str]) -> list[bool]:
    """Lines without prefix that continue a wrapped quoted line: they go on in mid-sentence, or stop there with quotation following."""
    free = ("prose", "short", "name", "contact", "greeting", "fields", "closing")
    sure, maybe = [False] * len(lines), [False] * len(lines)
    for k in range(HEAD_LINES + 1, len(lines)):
        if kinds[k] not in free or kinds[k - 1] != "prefixed" or _END.search(lines[k - 1]) or not _ALNUM.search(lines[k - 1]):
            continue
        bare = lines[k].strip()
        followed = k + 1 < len(lines) and kinds[k + 1] == "prefixed"
        if bare[:1].islower() or (followed and not _END.search(bare) and len(bare) < 90):
            sure[k] = True
        maybe[k] = True
    if any(sure):
        return maybe
    return sure


def line_features(text: str) -> tuple[list[str], list[tuple[str, ...]]]:
    """The lines of a mail and the features of each."""
    lines = text.split("\n")
    kinds = _kinds(lines)
    rest = _rest_of_quote(lines, kinds)
    shapes = ["rest" if r else k for k, r in zip(kinds, rest)]
    forwarded, trail, since_blank = False, "none", "none"
    features = []
    for k, (line, shape) in enumerate(zip(lines, shapes)):
        bare = line.strip()
        before = shapes[k - 1] if k else "start"
        after = shapes[k + 1] if k + 1 < len(lines) else "end"
        if shape in ("dashes", "closing", "slash", "device", "underscores") and not (shape == "closing" and after == "prose"):
            trail = since_blank = shape
        elif shape in ("intro", "prefixed", "legal", "marker"):
            trail = since_blank = "none"
        elif shape == "blank":
            since_blank = "none"
            if trail in ("closing", "slash", "device"):
                trail = "none"
        end = "end" if _END.search(bare) else "open"
        first = "low" if bare[:1].islower() else "cap"
        place = f"fwd={forwarded}"
        features.append((
            "bias",
            f"shape={shape}|{place}",
            f"shape={shape}|trail={trail}",
            f"shape={shape}|before={before}",
            f"shape={shape}|after={after}",
            f"shape={shape}|{end}|{first}",
            f"trail={trail}|{place}|{'short' if len(bare) < 60 else 'long'}",
            f"since={since_blank}|{end}",
            f"before={before}|{end}|{first}",
            f"place={min(k, 6)}|{shape}",
        ))
        if shape == "marker":
            forwarded = True
    return lines, features


def cautious_labels(text: str) -> list[str]:
    """Training labels of one mail by explicit rules over line shapes."""
    lines = text.split("\n")
    kinds = _kinds(lines)
    rest = _rest_of_quote(lines, kinds)
    out, forwarded, sign = [], False, ""
    for k, kind in enumerate(kinds):
        if kind in ("prefixed", "intro", "marker"):
            sign = ""
        if kind == "blank" and sign != "dashes":
            sign = ""
        if kind in ("dashes", "underscores"):
            sign = "dashes"
        elif kind in ("device", "slash") or kind == "closing" and (k + 1 == len(lines) or kinds[k + 1] != "prose"):
            sign = sign or kind
        if kind == "head":
            label = "head"
        elif kind == "legal":
            label, sign = "disclaimer", ""
        elif forwarded or kind in ("prefixed", "intro", "marker") or rest[k]:
            label = "quoted"
        elif sign:
            label = "signature"
        else:
            label = "new"
        forwarded |= kind == "marker"
        out.append(label)
    return out


class LineModel:
    """Linear chain with one weight per (feature, label) and per (label, next label)."""

    def __init__(self, weights: dict[str, list[float]], moves: list[list[float]]):
        self.weights, self.moves = weights, moves
        self.scores: dict[tuple, list[float]] = {}

    def emit(self, features: tuple[str, ...]) -> list[float]:
        found = self.scores.get(features)
        if found is None:
            rows = [w for f in features if (w := self.weights.get(f))]
            found = self.scores[features] = [sum(r[y] for r in rows) for y in range(len(LABELS))]
        return found

    def decode(self, features: list[tuple[str, ...]]) -> list[int]:
        size, moves = range(len(LABELS)), self.moves
        best, back = self.emit(features[0])[:], []
        for f in features[1:]:
            e, turn, now = self.emit(f), [], []
            for y in size:
                options = [best[p] + moves[p][y] for p in size]
                top = max(options)
                turn.append(options.index(top))
                now.append(top + e[y])
            back.append(turn)
            best = now
        path = [best.index(max(best))]
        for turn in reversed(back):
            path.append(turn[path[-1]])
        return path[::-1]


def train(mails: list[str], rounds: int = 4, seed: int = 5) -> LineModel:
    """Averaged perceptron; stops early after a round without error."""
    data = [(line_features(t)[1], [LABELS.index(y) for y in cautious_labels(t)]) for t in mails if t]
    w, total = defaultdict(lambda: [0.0] * len(LABELS)), defaultdict(lambda: [0.0] * len(LABELS))
    m, m_total = [[0.0] * len(LABELS) for _ in LABELS], [[0.0] * len(LABELS) for _ in LABELS]
    step, order = 1, random.Random(seed)
    for _ in range(rounds):
        order.shuffle(data)
        errors = 0
        for features, gold in data:
            model = LineModel(w, m)
            guess = model.decode(features)
            if guess != gold:
                errors += 1
                for f, y, z in zip(features, gold, guess):
                    if y != z:
                        for name in f:
                            for label, d in ((y, 1.0), (z, -1.0)):
                                w[name][label] += d
                                total[name][label] += d * step
                for seq, d in ((gold, 1.0), (guess, -1.0)):
                    for a, b in zip(seq, seq[1:]):
                        m[a][b] += d
                        m_total[a][b] += d * step
            step += 1
        if not errors:
            break
    weights = {f: [a - b / step for a, b in zip(v, total[f])] for f, v in w.items()}
    return LineModel(weights, [[a - b / step for a, b in zip(r, t)] for r, t in zip(m, m_total)])


def fit(mails: DataFrame, text_col: str = "text", limit: int = TRAINING_MAILS) -> LineModel:
    """The model fitted on at most limit distinct mails, chosen by hash so that the choice is stable."""
    return train(hash_sample(mails.where(F.col(text_col).isNotNull()), text_col, limit))


def _labeller(weights: dict, moves: list) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = LineModel(weights, moves)
        for b in batches:
            ids, numbers, labels = [], [], []
            for i, text in zip(b["id"], b["text"]):
                lines, features = line_features(text)
                for k, y in enumerate(model.decode(features)):
                    ids.append(i)
                    numbers.append(k)
                    labels.append("blank" if not _ALNUM.search(lines[k]) else LABELS[y])
            yield pd.DataFrame({"id": ids, "line_no": numbers, "label": labels})

    return run


def label_lines(mails: DataFrame, model: LineModel | None = None, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, line_no, label) of every line of every mail; label blank for lines without letter or digit.

    Null ids and null texts give no row, an empty text one blank line; repeated rows repeat. One pass, no shuffle of the texts.
    """
    model = model or fit(mails, text_col)
    rows = mails.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return spread(rows).mapInPandas(_labeller(dict(model.weights), model.moves), "id string, line_no int, label string")


def new_lines(mails: DataFrame, model: LineModel | None = None, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, line_no): the lines newly written by the sender, each once however often its mail is repeated."""
    return label_lines(mails, model, id_col, text_col).where("label = 'new'").select("id", "line_no").distinct()
