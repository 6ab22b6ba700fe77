"""Personal data in free text: a skip-chain conditional random field over candidate mentions, decoded by loopy message passing.

Candidates come from lexical patterns and from name lexicons that the corpus's own mail headers give. Each is a node whose
potential is a log-linear function of its form and context; neighbours share a chain edge, and mentions with a token in common
anywhere in the text a skip edge, so that clear mentions decide unclear ones. Weights are trained here on a bounded sample.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from datetime import date

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.runtime import hash_sample, spread, table_cut
from lodestone.llm.encoding_repair import Repairs, garbled_dictionary, repaired, suspicious_tokens

KINDS = ("EMAIL", "PHONE", "ID_NUMBER", "ADDRESS", "NAME")
#: What a word of the lexicon can be.
ROLES = ("given", "family", "town")
#: Texts the field is trained on, at most.
TRAINING_TEXTS = 4000
#: Lexicon entries and repaired tokens up to which they are broadcast whole; more are joined to the texts that hold them.
LEXICON, REPAIRS = 200_000, 400_000
ROUNDS = 6
#: Log-odds shift of every decision; 0 weighs precision and recall alike.
BIAS = 0.0
#: Log-odds at which labelled candidates are held in training, weight of the couplings' prior at zero, and the strongest coupling.
HELD, PRIOR, STRONGEST = 30.0, 20.0, 1.0

_UP = "A-ZÅÄÖÉÈÜÆØÇÑÁÍÓÚÀÂÊÎÔŠŽ"
# The at sign and the dot as sv, en, de, da, no, fr, es, fi and ru spell them.
_AT_WORD = r"(?:snabel-?a|kanel-?bulle|alfakrull|krøllalfa|krullalfa|klammeraffe|affenschwanz|arrobas?|arobase|miukumauku|ät-?merkki|at-?tecken|at-?tegn|собака)"
_DOT_WORD = r"(?:dot|punktum|punkt|prick|point|punto|piste|точка)"
_DOT = rf"(?:\.|\s?[(\[](?i:{_DOT_WORD})[)\]]\s?)"
_AT = re.compile(rf"@|[(\[](?:at|AT|(?i:{_AT_WORD}))[)\]]")
_LABELS = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
_DOMAIN = re.compile(rf"\s?(?:{_LABELS}{_DOT})+[A-Za-z]{{2,}}(?![\w@])")
_DOT_SPELLED = rf"(?:\s{_DOT_WORD}\s|{_DOT})"
# a bare `at` is a common word, so that a known ending must close what follows it
_ENDING = r"(?:com|org|net|info|edu|gov|eu|example|test|se|no|dk|fi|de|fr|es|uk|ru|us)"
_SPELLED_AT = re.compile(rf"\s(?:{_AT_WORD}|at(?=\s(?:{_LABELS}{_DOT_SPELLED})*{_LABELS}\s{_DOT_WORD}\s{_ENDING}\b))(?=\s)", re.I)
_SPELLED_DOMAIN = re.compile(rf"\s(?:{_LABELS}{_DOT_SPELLED})+[A-Za-z]{{2,}}(?![\w@])", re.I)
_DOTS = ("dot", "punkt", "prick", "point", "punto", "piste", "точка")
_NOT_LOCAL = re.compile(r"[^\w.+-]")
# How the numbering plans of these countries are written.
_EXT = r"(?:,?\s?(?:ext|x|anknytning|ankn|Durchwahl|poste)\.?\s?\d{1,5})?"
PHONE = re.compile(
    rf"(?<![\w+=/.-])(?<!\d[ /-])(?:"
    rf"(?:\+|00)\d{{1,3}}[ ./-]?(?:\(0\)[ ]?)?\(?\d{{1,5}}\)?(?:[ ./-]?\d{{2,9}}){{1,5}}"
    rf"|\(0?\d{{1,4}}\)[ /-]?\d{{2,8}}(?:[ ./-]?\d{{2,6}}){{0,4}}"
    rf"|1-\d{{3}}-\d{{3}}-\d{{4}}|\d{{3}}[-. ]\d{{3}}[-. ]\d{{4}}"
    rf"|0\d(?:[ .]\d\d){{4}}|0\d{{1,4}}[-/ ]\d{{2,8}}(?:[ -]\d{{2,6}}){{0,4}}"
    rf"){_EXT}(?![\w]|[-/.:]\d)"
)
IDENTITY = re.compile(r"(?<![\w+/=.-])(?<!\d )(?:(?:19|20)?\d{6}[-+ ]?\d{4}|\d{6}[ -]?\d{5}|\d{6}[-+A-FU-Y]\d{3}[0-9A-Y])(?![\w+=/]|[-.]\d)")
_TOWN = rf"[{_UP}][\w’]+(?:-[{_UP}][\w’]+)*(?: (?:am|an der|im|upon|de|du|la|le)(?= [{_UP}])(?: [{_UP}][\w’-]+)| (?!Det |De |The |Om |Min |Jag |Kan |Vi )[{_UP}][a-zåäöéü][\w’-]+)?"
_POST = r"(?:[A-Z]{1,2}-)?\d{3} ?\d{2}"
_UNIT = r"(?:lgh\.? ?\d{3,4}|(?:Apt|Flat|Unit|Suite|Apartment|APT|FLAT|UNIT|SUITE)\.? ?\w{1,5}|\d{1,2} ?tr\.?|LGH \d{4}|\d{1,2} TR\b|vån\.? ?\d{1,2})"
_ROAD = "väg|vägen|gata|gatan|stig|stigen|gränd|gränden|kajen|kaj|brinken|backen|allén|torg|torget|plan|plats|platsen|liden|straße|strasse|allee|weg|platz|gasse|ufer|damm|teich|vej|gade|allé|katu|tie|polku|kuja"
_ROADS = "Street|Road|Court|Close|Lane|Avenue|Drive|Way|Place|Square|Terrace|Crescent|Hill|Row|Walk|Gardens|Grove|Mews"
ADDRESS = re.compile(
    rf"(?<![\w/])(?:(?:[{_UP}][\w’-]+ ){{0,2}}[{_UP}][\w’-]*(?:(?i:{_ROAD}))\b ?\d{{1,4}}(?: ?[A-Za-z](?![\w’])(?! ?\.))?"
    rf"|(?:(?:Am|An der|Im|Zum|Zur|Auf der|AM|IM|ZUM) )[{_UP}][\w’-]+ \d{{1,4}} ?[a-zA-Z]?(?![\w’])"
    rf"|\d{{1,4}}[A-Za-z]? (?:[{_UP}][\w’-]+ ){{1,3}}(?i:{_ROADS})\b)"
    rf"(?:,? {_UNIT})?(?:, {_POST} {_TOWN}|, {_TOWN}(?: [A-Z]{{1,2}}\d{{1,2}}[A-Z]? ?\d[A-Z]{{2}}\b)?)?"
)
_LAST_TOWN = re.compile(rf", (?:{_POST} )?({_TOWN})\Z")
_DIGIT = re.compile(r"\d")
_STATION = re.compile(rf"\d{{3}} ?\d{{2}} ({_TOWN})")
_BRACKET = re.compile(r" <([A-Za-z0-9._+-]+)@")
_NOT_SHOWN = re.compile(r'[\n<>|"·]')
_LABEL = re.compile(r"^.*(?::|·)\s+")
_WORD = re.compile(r"[^\W\d_]+")
_CAPITALISED = re.compile(r"(?<![^\W\d_])[A-ZÀ-ÖØ-ÞĀ-ŽА-ЯЁ][^\W\d_]*")
_INITIAL = re.compile(rf" [{_UP}]\.(?= )")
_BEFORE = re.compile(rf"(?<![\w])([{_UP}]\. ){{1,2}}\Z")
_GREETING = re.compile(r"\b(?:hi|hello|dear|hej|hejsan|hey|hallo|liebe|lieber|kære|bonjour|salut|cher|chère|hola|querid[oa]|hei|moi|привет|morning|morgon)[ ,]+\Z", re.I)


def fold(text: str) -> str:
    text = unicodedata.normalize("NFKD", text.casefold().replace("ø", "o").replace("æ", "ae").replace("ß", "ss"))
    return "".join(c for c in text if not unicodedata.combining(c))


def original_position(pos: int, steps: list[tuple], is_end: bool) -> int:
    """Position in the original text of a position in the repaired one; inside a restored token its start or end."""
    shift = 0
    for end, back, start, raw in steps:
        if pos >= end:
            shift = back
        elif pos > start:
            return end + back if is_end else raw
        else:
            break
    return pos + shift


def _luhn(digits: str) -> bool:
    total = sum(sum(divmod(int(d) * (2 - k % 2), 10)) for k, d in enumerate(digits))
    return total % 10 == 0


def _day(day: int, month: int, year: int) -> bool:
    try:
        date(year, month, day)
        return True
    except ValueError:
        return False


def identity_form(raw: str) -> str:
    """Country of a national personal number with a possible birth date and right check digits, date only, or ''."""
    bare = re.sub(r"[ -]", "", raw) if not re.search(r"[A-Z]|\+", raw) else raw
    digits = re.sub(r"\D", "", raw)
    if m := re.fullmatch(r"(\d\d)(\d\d)(\d\d)([-+A-FU-Y])(\d{3})([0-9A-Y])", raw):
        right = "0123456789ABCDEFHJKLMNPRSTUVWXY"[int(m[1] + m[2] + m[3] + m[5]) % 31] == m[6]
        if any(_day(int(m[1]), int(m[2]), c + int(m[3])) for c in (1900, 2000, 1800)):
            if right:
                return "fi"
            if m[6].isalpha():
                return "fi-date"
    if len(digits) in (10, 12) and re.fullmatch(r"(?:\d\d)?\d{6}[-+ ]?\d{4}", raw):
        ten = digits[-10:]
        years = (int(digits[:4]),) if len(digits) == 12 else (1900 + int(ten[:2]), 2000 + int(ten[:2]))
        day = int(ten[4:6]) - (60 if int(ten[4:6]) > 60 else 0)
        if any(_day(day, int(ten[2:4]), y) for y in years):
            return "se" if _luhn(ten) else "se-date"
        return ""
    if len(bare) == 11 and bare.isdigit():
        d = [int(c) for c in bare]
        day, month = int(bare[:2]), int(bare[2:4])
        day -= 40 if day > 40 else 0
        month -= 80 if month > 80 else 65 if month > 65 else 40 if month > 40 else 0
        if any(_day(day, month, c + int(bare[4:6])) for c in (1900, 2000, 1800)):
            k1 = (11 - sum(a * b for a, b in zip((3, 7, 6, 1, 8, 9, 4, 5, 2), d)) % 11) % 11
            k2 = (11 - sum(a * b for a, b in zip((5, 4, 3, 2, 7, 6, 5, 4, 3, 2), d)) % 11) % 11
            return "no" if (k1, k2) == (d[9], d[10]) else "no-date"
    return ""


def phone_form(raw: str) -> str:
    digits = re.sub(r"\D", "", re.split(r"ext|x|ankn|Durch|poste", raw)[0])
    if not 7 <= len(digits) <= 15 or re.fullmatch(r"(?:19|20)\d\d[-/. ]\d\d[-/. ]\d\d.*|\d\d\.\d\d\.(?:19|20)\d\d.*", raw):
        return ""
    if raw.startswith("+") or raw.startswith("00"):
        return "intl" if 8 <= len(digits) else ""
    if raw.startswith("("):
        return "area"
    if raw.startswith("0"):
        return "zero" if 8 <= len(digits) <= 12 else ""
    return "plan"


def name_candidates(text: str, given: dict[str, int], family: dict[str, int]) -> list[tuple[int, int, str, tuple[str, ...]]]:
    """(start, end, form, tokens) of name mentions built around words of the lexicons."""
    tokens = [(m.start(), m.end(), m[0]) for m in _CAPITALISED.finditer(text)]
    out, skip_to = [], -1
    for k, (s, e, w) in enumerate(tokens):
        if s < skip_to or not w[0].isupper():
            continue
        low = w.casefold()
        is_given, is_family = low in given, low in family
        if not (is_given or is_family):
            continue

        def word(j):
            return tokens[j] if j < len(tokens) else (len(text) + 9, 0, "x")

        def tail(j):
            """Index and end after a hyphenated second part of the word at j."""
            end = tokens[j][1]
            n = word(j + 1)
            if n[0] == end + 1 and text[end] == "-" and n[2][0].isupper():
                return j + 1, n[1]
            return j, end

        if s > 0 and (text[s - 1] in "-_@\\.+=" or text[s - 1].isdigit() or text[s - 1] == "/" and text[max(0, s - 2) : s - 1].strip(" \n>|")):
            continue
        if e < len(text) and (text[e] in "_@+=/" or text[e].isdigit()):
            continue
        if is_given:
            j, end = tail(k)
            if j > k and tokens[j][2].casefold() not in given:
                j, end = k, e
                if text[e : e + 1] == "-":
                    continue
            while m := _INITIAL.match(text, end):
                end = m.end()
                j += 1
            n = word(j + 1)
            known = n[2].casefold() in family
            plain = n[2].istitle() and not text[s:e].isupper() and n[2].casefold() not in given and not text[end - 1 :].startswith(". ")
            if n[0] == end + 1 and text[end] == " " and n[2][0].isupper() and (known or plain and len(n[2]) > 3):
                j, stop = tail(j + 1)
                out.append((s, stop, "full" if known else "full?", (low, n[2].casefold())))
                skip_to = stop
                continue
            if j > k and tokens[j][2].casefold() not in given:
                end = tail(k)[1] if tokens[min(k + 1, len(tokens) - 1)][2].casefold() in given and text[e : e + 1] == "-" else e
            out.append((s, end, "alone", (low,)))
            skip_to = end
        else:
            j, end = tail(k)
            before = _BEFORE.search(text, max(0, s - 7), s)
            start = before.start() if before else s
            if m := re.compile(rf",\s?(?:([{_UP}][^\W\d_]*)((?:-[{_UP}][^\W\d_]*)?)|[{_UP}]\.)((?: [{_UP}]\.)*)").match(text, end):
                if m[1] is None or m[1].casefold() in given:
                    out.append((s, m.end(), "comma" if m[1] else "comma-initial", (low, (m[1] or "").casefold())))
                    skip_to = m.end()
                    continue
            out.append((start, end, "initial" if before else "family", (low,)))
            skip_to = end
    return out


def addresses(text: str) -> list[tuple[int, int]]:
    """Mail addresses, also spaced or with at and dot in words: found from the at sign to both sides."""
    anchors = [(m, _DOMAIN) for m in _AT.finditer(text)]
    low = text.lower()
    if any(w in low for w in _DOTS):
        anchors = sorted([*anchors, *((m, _SPELLED_DOMAIN) for m in _SPELLED_AT.finditer(text))], key=lambda a: a[0].start())
    out, last = [], 0
    for m, form in anchors:
        domain = form.match(text, m.end())
        if not domain or m.start() < last:
            continue
        stop = m.start() - (text[m.start() - 1 : m.start()] == " ")
        local = _NOT_LOCAL.split(text[max(last, stop - 80) : stop])[-1].lstrip("._+-")
        if local and local[0].isascii() and local[-1] != ".":
            out.append((stop - len(local), domain.end()))
            last = domain.end()
    return out


def candidates(text: str, lexicon: dict[str, dict[str, int]]) -> list[tuple]:
    """(start, end, kind, form, tokens) of everything that may be personal data, in order."""
    out = []
    for start, end in addresses(text):
        whole = text[start:end]
        out.append((start, end, "EMAIL", "plain" if " " not in whole and "@" in whole else "veiled", (whole.casefold(),)))
    towns = lexicon.get("town", {})
    start = 0
    for line in text.split("\n"):
        stop = start + len(line)
        # numbers and addresses lie within a line and have a digit
        if _DIGIT.search(line):
            for m in IDENTITY.finditer(text, start, stop):
                if form := identity_form(m[0]):
                    out.append((m.start(), m.end(), "ID_NUMBER", form, (m[0],)))
            for m in PHONE.finditer(text, start, stop):
                if form := phone_form(m[0]):
                    out.append((m.start(), m.end(), "PHONE", form, (re.sub(r"\D", "", m[0])[-7:],)))
            for m in ADDRESS.finditer(text, start, stop):
                end = m.end()
                last = _LAST_TOWN.search(m[0])
                if last and last[1].casefold() not in towns:
                    first = last[1].split(" ")[0]
                    cut = first if first.casefold() in towns else None
                    if cut:
                        end -= len(last[1]) - len(cut)
                    elif not _DIGIT.search(last[0]):
                        end = m.start() + last.start()
                out.append((m.start(), end, "ADDRESS", "long" if last else "short", (text[m.start() : m.start() + 12].casefold(),)))
        start = stop + 1
    blocked = [(c[0], c[1]) for c in out if c[2] in ("EMAIL", "ADDRESS")]
    for c in name_candidates(text, lexicon["given"], lexicon["family"]):
        if not any(a < c[1] and c[0] < b for a, b in blocked):
            out.append((c[0], c[1], "NAME", c[2], c[3]))
    return sorted(out)


def node_features(text: str, c: tuple) -> list[str]:
    start, end, kind, form, _ = c
    left, right = text[max(0, start - 24) : start], text[end : end + 16]
    line = text.rfind("\n", 0, start) + 1
    words = _WORD.findall(left.rpartition("\n")[2])
    after = _WORD.findall(right.partition("\n")[0])
    prev, nxt = (words[-1].casefold() if words else "^"), (after[0].casefold() if after else "$")
    lead = text[line:start].strip(" >|-*•\t")
    alone = not lead and not text[end : end + 1].strip("\n\r")
    f = [kind, f"{kind}:{form}", f"{kind}:prev={prev}", f"{kind}:next={nxt}", f"{kind}:{form}:edge={left[-1:] or '^'}{right[:1] or '$'}"]
    if kind == "NAME":
        f += [f"NAME:{form}:greet={bool(_GREETING.search(left))}", f"NAME:{form}:alone={alone}", f"NAME:{form}:lead={not lead}", f"NAME:{form}:slash={left.endswith('/')}", f"NAME:{form}:prev={prev}", f"NAME:{form}:next={nxt}"]
    return f


def skip_edges(found: list[tuple]) -> list[tuple[int, int, int]]:
    """(i, j, type): 0 for neighbours within a line's reach, 1 for mentions of one kind with a token in common, linked as a chain per token."""
    edges, last = [], {}
    for j, c in enumerate(found):
        if j and c[0] - found[j - 1][1] < 60:
            edges.append((j - 1, j, 0))
        for t in c[4]:
            if t:
                key = (c[2], t)
                if key in last:
                    edges.append((last[key], j, 1))
                last[key] = j
    return edges


# Words beside numbers and names that make them something else than personal data.
_NOT_PERSON_BEFORE = {"projekt", "project", "the", "projektet", "produkt", "product", "team", "server", "modul", "module"}
_NOT_PERSON_AFTER = {"pipeline", "project", "projekt", "server", "går", "api", "cluster", "release", "module", "modul"}
_NOT_PII_BEFORE = {"invoice", "ticket", "order", "no", "build", "isbn", "bankgiro", "commit", "host", "version", "plusgiro", "faktura", "ärende", "ref", "id", "offset"}


def cautious_label(text: str, c: tuple) -> int | None:
    """Training label of a candidate: 1, 0, or None where only context can tell."""
    start, end, kind, form, _ = c
    left, right = text[max(0, start - 24) : start], text[end : end + 16]
    words, after = _WORD.findall(left.rpartition("\n")[2]), _WORD.findall(right.partition("\n")[0])
    prev, nxt = (words[-1].casefold() if words else ""), (after[0].casefold() if after else "")
    if kind == "EMAIL":
        return 1
    if kind in ("PHONE", "ID_NUMBER"):
        if prev in _NOT_PII_BEFORE and '"' not in left[-4:]:
            return 0
        return 1 if kind == "PHONE" or "-" not in form else 0 if form == "se-date" else None
    if kind == "ADDRESS":
        return 1
    if form in ("full", "comma", "initial"):
        return 1
    if form == "family":
        return 0 if right[:1] == "-" else None
    if prev in _NOT_PERSON_BEFORE or nxt in _NOT_PERSON_AFTER:
        return 0
    if form == "alone":
        line = text.rfind("\n", 0, start) + 1
        lead = text[line:start].strip(" >|-*•\t")
        if _GREETING.search(left) or left.endswith("/") or not lead and not text[end : end + 1].strip("\n\r,"):
            return 1
    return None


def propagate(unary: np.ndarray, edges: np.ndarray, couplings: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(log-odds of every node, expected agreement of both ends of every edge) after rounds of loopy message passing.

    Nodes are +1 or -1 with fields unary / 2, an edge (i, j, type) couples its ends by couplings[type]; all texts are worked off at once.
    """
    h = unary / 2
    if not len(edges):
        return 2 * h, np.zeros(0)
    n = len(edges)
    a, b = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
    twin = np.concatenate([np.arange(n) + n, np.arange(n)])
    t = np.tanh(np.asarray(couplings))[np.concatenate([edges[:, 2], edges[:, 2]])]
    m = np.zeros(len(a))
    for _ in range(rounds):
        total = h + np.bincount(b, weights=m, minlength=len(h))
        m = 0.5 * m + 0.5 * np.arctanh(np.clip(t * np.tanh(total[a] - m[twin]), -0.999999, 0.999999))
    total = h + np.bincount(b, weights=m, minlength=len(h))
    # what each end is without the other
    x, y = np.tanh(total[a[:n]] - m[twin[:n]]), np.tanh(total[b[:n]] - m[:n])
    return 2 * total, (t[:n] + x * y) / (1 + t[:n] * x * y)


class Field:
    """Trained potentials: weight per feature, and coupling of chain and skip edges."""

    def __init__(self, weights: dict[str, float], couplings: tuple[float, float]):
        self.weights, self.couplings = weights, couplings

    def marginals(self, unary: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Log-odds of every node of a batch of texts."""
        return propagate(unary, edges, np.array(self.couplings))[0] + BIAS


def train(texts: list[str], lexicon: dict[str, dict[str, int]], rounds: int = 100, rate: float = 0.3) -> Field:
    """Potentials and couplings that make the clear candidates likeliest, the unclear ones summed out: both by gradient, the expectations
    by message passing over all candidates, once with the clear ones held at their labels and once without."""
    cols, rows, labels, edges = [], [], [], []
    names: dict[str, int] = {}
    for text in texts:
        found = candidates(text, lexicon)
        edges += [(i + len(labels), j + len(labels), kind) for i, j, kind in skip_edges(found)]
        for c in found:
            own = [names.setdefault(f, len(names)) for f in node_features(text, c)]
            cols += own
            rows += [len(labels)] * len(own)
            label = cautious_label(text, c)
            labels.append(np.nan if label is None else 2.0 * label - 1)
    w, j = np.zeros(max(1, len(names))), np.zeros(2)
    if labels:
        col, row, y = np.array(cols), np.array(rows), np.array(labels)
        linked = np.array(edges, dtype=np.int64).reshape(-1, 3)
        clear = ~np.isnan(y)
        w_scale, j_scale = np.zeros(len(w)) + 1e-8, np.zeros(2) + 1e-8
        for _ in range(rounds):
            u = np.bincount(row, weights=w[col], minlength=len(y))
            free, free_pairs = propagate(u, linked, j)
            held, held_pairs = propagate(np.where(clear, HELD * y, u), linked, j)
            g = np.bincount(col, weights=((np.tanh(free / 2) - np.tanh(held / 2)) / 2)[row], minlength=len(w)) + 0.5 * w
            w_scale += g * g
            w -= rate * g / np.sqrt(w_scale)
            if len(linked):
                g = np.bincount(linked[:, 2], weights=free_pairs - held_pairs, minlength=2) + PRIOR * j
                j_scale += g * g
                j = np.clip(j - 0.1 * rate * g / np.sqrt(j_scale), 0.0, STRONGEST)
    return Field({f: float(w[k]) for f, k in names.items()}, (float(j[0]), float(j[1])))


def _harvest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out: dict[tuple[str, str], int] = {}

        def add(role, token):
            out[role, token] = out.get((role, token), 0) + 1

        for text in b["text"]:
            if "<" in text and "@" in text:
                for m in _BRACKET.finditer(text):
                    shown, local = _NOT_SHOWN.split(text[max(0, m.start() - 60) : m.start()])[-1], m[1].casefold()
                    shown = _LABEL.sub("", shown).strip()
                    if len(shown) < 3:
                        continue
                    first, last = ([x.strip() for x in reversed(shown.split(",", 1))]) if "," in shown else (shown.split(" ")[0], shown.split(" ")[-1])
                    g, s = (re.fullmatch(r"([^\W\d_]+)(?:-[^\W\d_]+)*", x) for x in (first, last))
                    if not g or not s or first == last or not (g[0][0].isupper() and s[0][0].isupper()):
                        continue
                    fg, fs = fold(g[1]), fold(s[1])
                    if len(fg) > 1 and (fg in local and (fs[:5] in local or re.fullmatch(rf"{fg}\d+", local)) or local.startswith(fg[0] + fs)):
                        add("given", g[1].casefold())
                        add("family", s[1].casefold())
            for m in _STATION.finditer(text):
                add("town", m[1].casefold())
        yield pd.DataFrame([(r, t, n) for (r, t), n in out.items()], columns=["role", "token", "n"])


def learn_lexicon(rows: DataFrame, text_col: str = "text", least: int = 2) -> DataFrame:
    """(role, token, n): given names, family names and towns with their counts over all rows: names whose mail address repeats them, towns
    behind postcodes. What is more often a family name is no given name."""
    seen = rows.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text")).mapInPandas(_harvest, "role string, token string, n long")
    top = seen.groupBy("role", "token").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    by_token = top.groupBy("token").agg(*[F.coalesce(F.max(F.when(F.col("role") == role, F.col("n"))), F.lit(0)).alias(role) for role in ROLES])
    kept = F.array(*[F.struct(F.lit(role).alias("role"), (F.when(F.col("family") <= F.col("given"), F.col("given")).otherwise(0) if role == "given" else F.col(role)).cast("long").alias("n")) for role in ROLES])
    return by_token.select("token", F.explode(F.filter(kept, lambda k: k["n"] > 0)).alias("k")).select("k.role", "token", "k.n")


def as_lexicon(rows) -> dict[str, dict[str, int]]:
    """{role: {token: n}} of (role, token, n) rows."""
    out: dict[str, dict[str, int]] = {role: {} for role in ROLES}
    for role, token, n in rows:
        out[role][token] = n
    return out


def learn_repairs(rows: DataFrame, text_col: str = "text", id_col: str = "id") -> DataFrame:
    """(token, original) of garbled tokens over the corpus, so that garbled mentions are found in place."""
    return garbled_dictionary(suspicious_tokens(rows, (text_col,), id_col)).where(F.col("original").isNotNull()).select("token", "original")


def _case_counter(shared) -> Callable:
    """Counts of the words of shared, or of all words for None."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = None if shared is None else shared.value
        for b in batches:
            tokens: Counter = Counter()
            for text in b["text"]:
                at = 0
                for start, end in addresses(text):
                    tokens.update(text[at:start].split())
                    at = end
                tokens.update(text[at:].split())
            out: dict[str, list[int]] = {}
            for token, n in tokens.items():
                if "@" in token or "://" in token or "www." in token:
                    continue
                for w in _WORD.findall(token):
                    low = w.casefold()
                    if known is None or low in known:
                        out.setdefault(low, [0, 0])[not w[0].islower()] += n
            yield pd.DataFrame([(w, *n) for w, n in out.items()], columns=["token", "lower", "upper"])

    return run


def common_words(rows: DataFrame, words: DataFrame, text_col: str = "text") -> DataFrame:
    """(token): those of the words (token) that all rows together write in lower case more often than not, mail addresses and URLs aside.

    One pass; a batch sends one row for each of the words it holds, summed before and after the shuffle.
    """
    few = [r[0] for r in words.select("token").distinct().limit(LEXICON + 1).collect()]
    shared = rows.sparkSession.sparkContext.broadcast(set(few)) if len(few) <= LEXICON else None
    texts = spread(rows.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text")))
    seen = texts.mapInPandas(_case_counter(shared), "token string, lower long, upper long").groupBy("token").agg(F.sum("lower").alias("lower"), F.sum("upper").alias("upper"))
    common = seen.where(F.col("lower") > F.col("upper")).select("token")
    return common if shared is not None else common.join(words.select("token").distinct(), "token", "left_semi")


def without_common_words(rows: DataFrame, lexicon: DataFrame, text_col: str = "text") -> DataFrame:
    """The lexicon (role, token, n) without the names that the rows mostly write in lower case."""
    names = lexicon.where("role <> 'town'")
    drop = common_words(rows, names, text_col).withColumn("_drop", F.lit(True))
    return lexicon.join(drop, "token", "left").where((F.col("role") == "town") | F.col("_drop").isNull()).select("role", "token", "n")


_TOWN_AHEAD = re.compile(rf"(?<!\w)(?=({_TOWN}))")


def _words_of(text: str) -> set[str]:
    """What of a text may be in a lexicon, in lower case: its words, and the runs that towns are read as, whole and their first part."""
    runs = {m[1].casefold() for m in _TOWN_AHEAD.finditer(text)}
    return runs | {r.split(" ")[0] for r in runs} | {w.casefold() for w in _WORD.findall(text)}


def _word_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        pairs = [(i, w) for i, t in zip(b["id"], b["text"]) for w in _words_of(t)]
        yield pd.DataFrame(pairs, columns=["id", "token"])


def own_knowledge(texts: DataFrame, lexicon: DataFrame, repairs: DataFrame, tokens: DataFrame) -> DataFrame:
    """(id, names, fixes): of the lexicon and the repairs what each text (id, text) can hold, its repaired words included.

    The exact way for lexicons and repairs that are too many to broadcast: they meet the words of the texts in shuffled joins. tokens
    are the suspicious tokens (id, token) of the texts.
    """
    fixed = tokens.select("id", "token").join(repairs, "token")
    words = texts.mapInPandas(_word_rows, "id string, token string").unionByName(fixed.select("id", F.col("original").alias("text")).mapInPandas(_word_rows, "id string, token string"))
    names = words.join(lexicon, "token").groupBy("id").agg(F.collect_set(F.struct("role", "token", "n")).alias("names"))
    fixes = fixed.groupBy("id").agg(F.collect_set(F.struct("token", "original")).alias("fixes"))
    return names.join(fixes, "id", "full_outer")


def fit(rows: DataFrame, lexicon: DataFrame, text_col: str = "text", limit: int = TRAINING_TEXTS) -> Field:
    """The field from at most limit texts chosen by hash so that the choice is stable, with what of the lexicon they hold."""
    texts = hash_sample(rows.where(F.length(text_col).between(1, 20000)), text_col, limit)
    held = rows.sparkSession.createDataFrame([(w,) for w in sorted({w for t in texts for w in _words_of(t)})], "token string")
    return train(texts, as_lexicon(lexicon.join(held, "token", "left_semi").select("role", "token", "n").collect()))


def mentions_of(texts: list[str], lexicon: dict, repairs: dict[str, str], field: Field) -> list[list[tuple[str, int, int]]]:
    """(kind, start, end) per text, decoded over all texts at once; overlaps go to the likelier mention."""
    nodes, edges, owner, base, steps_of = [], [], [], 0, []
    weights = field.weights
    unary = []
    for k, raw in enumerate(texts):
        text, steps = repaired(raw, repairs)
        steps_of.append(steps)
        found = candidates(text, lexicon)
        for c in found:
            unary.append(sum(weights.get(f, 0.0) for f in node_features(text, c)))
        edges += [(i + base, j + base, t) for i, j, t in skip_edges(found)]
        nodes += found
        owner += [k] * len(found)
        base += len(found)
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    if not nodes:
        return out
    odds = field.marginals(np.array(unary), np.array(edges, dtype=np.int64).reshape(-1, 3))
    kept: list[list[tuple[int, int]]] = [[] for _ in texts]
    for i in sorted(np.flatnonzero(odds > 0).tolist(), key=lambda i: (-(nodes[i][1] - nodes[i][0]), -odds[i])):
        s, e, kind = nodes[i][:3]
        k = owner[i]
        if not any(a < e and s < b for a, b in kept[k]):
            kept[k].append((s, e))
            out[k].append((kind, original_position(s, steps_of[k], False), original_position(e, steps_of[k], True)))
    return out


def _finder(shared, mask: bool) -> Callable:
    """Mentions or masked texts of batches; a batch that brings names and fixes of its own is worked off with these."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon, repairs, field = shared.value
        for big in batches:
            for at in range(0, len(big), 400):
                b = big.iloc[at : at + 400]
                texts = b["text"].tolist()
                if lexicon is None:
                    names = as_lexicon({(n["role"], n["token"], n["n"]) for row in b["names"] if row is not None for n in row})
                    fixes = Repairs((f["token"], f["original"]) for row in b["fixes"] if row is not None for f in row)
                else:
                    names, fixes = lexicon, repairs
                found = mentions_of(texts, names, fixes, field)
                if mask:
                    yield pd.DataFrame({"id": b["id"], "text": [placeholders(t, f) for t, f in zip(texts, found)]})
                else:
                    yield pd.DataFrame([(i, *m) for i, f in zip(b["id"], found) for m in f], columns=["id", "pii_kind", "start_pos", "end_pos"])

    return run


def placeholders(text: str, found: list[tuple[str, int, int]]) -> str:
    """text with each mention replaced by its kind in brackets."""
    for kind, s, e in sorted(found, key=lambda m: -m[1]):
        text = f"{text[:s]}[{kind}]{text[e:]}"
    return text


def _prepared(rows: DataFrame, model, id_col: str, text_col: str):
    spark = rows.sparkSession
    texts = spread(rows.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")))
    if model is not None:
        return spark.sparkContext.broadcast(model), texts
    lexicon = table_cut(without_common_words(rows, table_cut(learn_lexicon(rows, text_col)), text_col))
    field, repairs = fit(rows, lexicon, text_col), table_cut(learn_repairs(rows, text_col, id_col))
    if lexicon.count() <= LEXICON and repairs.count() <= REPAIRS:
        return spark.sparkContext.broadcast((as_lexicon(lexicon.collect()), Repairs((r[0], r[1]) for r in repairs.collect()), field)), texts
    own = own_knowledge(texts, lexicon, repairs, suspicious_tokens(texts, ("text",)))
    return spark.sparkContext.broadcast((None, None, field)), texts.join(own, "id", "left")


def find_mentions(rows: DataFrame, model: tuple | None = None, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, pii_kind, start_pos, end_pos): every mention once, in code points of the text as it stands.

    Null ids and null or empty texts give no row; repeated rows give their mentions once. Whole texts are worked off where they lie;
    only mentions are shuffled. Lexicon and repairs are broadcast up to LEXICON and REPAIRS; beyond, each text is joined with what of
    them it holds, and the mentions are the same.
    """
    shared, texts = _prepared(rows, model, id_col, text_col)
    return texts.mapInPandas(_finder(shared, False), "id string, pii_kind string, start_pos int, end_pos int").distinct()


def mask_mentions(rows: DataFrame, model: tuple | None = None, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, text): every row's text with typed placeholders for its mentions; repeated rows repeat, null texts and ids are left out."""
    shared, texts = _prepared(rows, model, id_col, text_col)
    return texts.mapInPandas(_finder(shared, True), "id string, text string")
