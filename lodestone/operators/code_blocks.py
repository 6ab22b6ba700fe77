"""Blocks and definitions of languages with braces, read by a scanner that knows strings and comments but no grammar."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

#: Languages whose blocks are braces.
BRACES = {"javascript", "typescript", "tsx", "java", "c", "cpp", "c_sharp", "php", "swift", "kotlin", "scala", "rust", "go"}
_PIECE = re.compile(r"""//[^\n]*|\#[^\n]*|/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n]){0,80}'|`(?:\\.|[^`\\])*`|[{}]|\n""", re.S)
_TYPE = re.compile(r"\b(?:class|struct|interface|enum|trait|object|protocol|extension|namespace|impl(?:<[^>]*>)?(?:\s+[\w:<>]+\s+for)?)\s+([A-Za-z_]\w*)")
_NAMED = re.compile(r"\b(?:function\*?|fn|func|fun|def)\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)")
_ARROW = re.compile(r"\b(?:const|let|var|val)\s+([A-Za-z_]\w*)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:function\b|\([^)]*\)\s*(?::[^=]+)?=>|\w+\s*=>)")
_METHOD = re.compile(r"^\s*(?:[\w<>\[\],.:&*~?@]+\s+)*[&*]*([A-Za-z_~]\w*)\s*\([^;{}]*\)?[^;{}=]*\{")
# Words before a bracket and a brace that name no function.
_NO_NAME = {"if", "for", "while", "switch", "catch", "return", "else", "do", "try", "match", "with", "when", "guard", "foreach", "using", "lock", "synchronized", "new"}


def depths(source: str, hash_comments: bool = False) -> list[int]:
    """Brace depth at the start of every line, and after the last; braces in strings and comments don't count, nor do surplus closing ones."""
    out, depth = [0], 0
    for m in _PIECE.finditer(source):
        piece = m[0]
        if piece == "{":
            depth += 1
        elif piece == "}":
            depth = max(0, depth - 1)
        elif piece == "\n":
            out.append(depth)
        elif piece[0] == "#" and not hash_comments:
            # a preprocessor line or a private name: what is in it counts
            depth = max(0, depth + piece.count("{") - piece.count("}"))
        else:
            out += [depth] * piece.count("\n")
    return [*out, depth]


def spans(lines: list[str], depth: list[int], budget: int, size: Callable[[list[str]], int], start: int = 0, stop: int | None = None) -> list[tuple[int, int]]:
    """Runs of whole blocks up to the budget; a block above it is cut at the blocks inside it, one without any stays whole."""
    stop = len(lines) if stop is None else stop
    level, at, out = depth[start], start, []
    while at < stop:
        end = at + 1
        while end < stop and depth[end] > level:
            end += 1
        if size(lines[at:end]) > budget and end - at > 2 and depth[at + 1] > level:
            inner = spans(lines, depth, budget, size, at + 1, end)
            first = (at, inner[0][1])
            out += [first, *inner[1:]] if size(lines[slice(*first)]) <= budget else [(at, at + 1), *inner]
        elif out and out[-1][1] == at and size(lines[out[-1][0] : end]) <= budget:
            out[-1] = (out[-1][0], end)
        else:
            out.append((at, end))
        at = end
    return out


def definitions(lines: list[str], depth: list[int]) -> Iterator[tuple[int, str, str]]:
    """(line, dotted name, kind) of types and functions, each under those whose block it lies in."""
    trail: list[tuple[int, str]] = []
    for k, line in enumerate(lines):
        while trail and depth[k] <= trail[-1][0]:
            trail.pop()
        bare = line.lstrip()
        if bare.startswith(("//", "*", "/*")):
            continue
        kind, m = "class", _TYPE.search(line)
        if not m:
            kind = "function"
            m = _NAMED.search(line) or _ARROW.search(line)
            if not m and (m := _METHOD.match(line)) and m[1] in _NO_NAME:
                m = None
        if m:
            yield k, ".".join([*(name for _, name in trail), m[1]]), kind
            if depth[k + 1] > depth[k]:
                trail.append((depth[k], m[1]))
