"""The order in which a scanned page is read, and the way back to the places in its text."""

from __future__ import annotations

import re
from bisect import bisect_right

# Misread letters: each is mapped to one of its look-alikes, one character to one character.
_PAIRS = dict(zip("uUaA4fFbBhHqQcC1iIl|0oOſ5sS2zZäÄöÖüÜéÉèÈêÊëËàÀâÂîÎïÏôÔûÛçÇ", "nNoOoTTHHHHGGEELLLLLOOOSSSSZZZOOOONNEEEEEEEEOOOOLLLLOONNEE"))
_ALIKE = bytes(ord(_PAIRS.get(c, c).upper()) if len(c.upper()) == 1 and ord(_PAIRS.get(c, c).upper()) < 256 else ord(c) for c in map(chr, range(256)))


def alike(s: str) -> str:
    """``s`` in upper case with look-alike letters mapped to one; lengths stay equal."""
    return s.replace("ſ", "s").encode("latin-1", "replace").translate(_ALIKE).decode("latin-1")


#: Marks that end a line inside a word.
MARKS = "-­¬="
_GUTTER = re.compile(r" {2,}[|\t]?| *[|\t]")
#: Marks that are printed above a letter or not at all.
_UNSEEN = re.compile("[\u0300-\u036f\u200b-\u200d\u2060\ufeff]")
_BREAK = re.compile(r"([-­¬=])(?<=[^\W_].) ?\n+(?=[^\s])")
#: What only the careful way handles: indents, adverts between stars, unseen marks.
_SLOW = re.compile("[\t\u0300-\u036f\u200b-\u200d\u2060\ufeff]|\n |\\* ?\\*")
_STARS = re.compile(r"^\s*(?:\* ?){3,}\s*$")
#: An advert between two lines of stars has at most so many lines.
_ADVERT = 10


class Reading:
    """A text in reading order; ``place`` maps its positions to the original's."""

    __slots__ = ("text", "_at", "_from", "_original")

    def __init__(self, text: str, at: list[int], origin: list[int], original: str):
        self.text, self._at, self._from, self._original = text, at, origin, original

    def place(self, start: int, end: int) -> tuple[int, int]:
        """Original (start, end) of a span: from its first to its last character."""
        a, b = bisect_right(self._at, start) - 1, bisect_right(self._at, end - 1) - 1
        lo, hi = self._from[a] + start - self._at[a], self._from[b] + end - 1 - self._at[b]
        lo, hi = min(lo, hi), max(lo, hi) + 1
        while hi < len(self._original) and _UNSEEN.match(self._original, hi):
            hi += 1
        return lo, hi


def _may_join(text: str) -> bool:
    return "  " in text or "|" in text or "\t" in text


def _columns(lines: list[tuple[int, int]], text: str, xs: list | None, n_columns: int | None) -> list[list[tuple[int, int]]]:
    """Lines (start, end) by column; a line that joins columns is cut at its gutter."""
    if n_columns is not None and n_columns < 2:
        return [lines]
    cut = [_GUTTER.search(text, s, e) for s, e in lines] if _may_join(text) else []
    inner = sum(1 for m, (s, e) in zip(cut, lines) if m and m.start() > s and m.end() < e)
    if inner >= 3 and inner * 4 >= len(lines):
        columns: list[list[tuple[int, int]]] = []
        for s, e in lines:
            at, k = s, 0
            for m in _GUTTER.finditer(text, s, e):
                if m.end() >= e:
                    break
                if len(columns) <= k:
                    columns.append([])
                columns[k].append((at, m.start()))
                at, k = m.end(), k + 1
            if len(columns) <= k:
                columns.append([])
            columns[k].append((at, e))
        return columns
    if not xs or len(xs) != len(lines) or n_columns is None:
        return [lines]
    known = sorted(x for x in xs if x is not None)
    if not known:
        return [lines]
    starts = [known[0]]
    for a, b in zip(known, known[1:]):
        if b - a > 40:
            starts.append(b)
    if len(starts) < 2:
        return [lines]
    columns, last = [[] for _ in starts], 0
    for (s, e), x in zip(lines, xs):
        last = bisect_right(starts, x) - 1 if x is not None else last
        columns[last].append((s, e))
    return columns


def _adverts_after(lines: list[tuple[int, int]], text: str, moved: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Takes out what stands between two lines of stars, into ``moved``."""
    stars = [i for i, (s, e) in enumerate(lines) if e - s < 14 and e > s and text[s] in "* " and _STARS.match(text[s:e])]
    out, i, k = [], 0, 0
    while k + 1 < len(stars):
        a, b = stars[k], stars[k + 1]
        if b - a - 1 <= _ADVERT and b > a + 1:
            out += lines[i:a]
            moved += lines[a : b + 1]
            i, k = b + 1, k + 2
        else:
            k += 1
    return out + lines[i:] if i else lines


def _in_order(xs: list | None) -> bool:
    """Whether the boxes give the lines' own order: each column is one run of lines."""
    known = [x for x in xs or () if x is not None]
    return all(b > a - 40 for a, b in zip(known, known[1:]))


def _plain(text: str) -> Reading:
    """A page whose lines are in order: only the words broken at line ends are rejoined."""
    parts, where, origin, at, n = [], [0], [0], 0, 0
    for m in _BREAK.finditer(text):
        mark, follows = m[1], text[m.end() : m.end() + 2]
        before = text[m.start() - 1]
        cut = m.end() if mark == "-" else m.start() + 1
        if mark != "-" or follows[:1].islower() or follows[:1].isdigit() or (before.isupper() and follows.isupper() and len(follows) == 2):
            cut = m.start()
        elif mark == "-":
            cut = m.start() + 1
        parts.append(text[at:cut])
        n += cut - at
        at = m.end()
        where.append(n)
        origin.append(at)
    parts.append(text[at:])
    return Reading("".join(parts), where, origin, text)


def reading(text: str, xs: list | None = None, n_columns: int | None = None) -> Reading:
    """Columns one after the other, interrupting adverts at the end, words rejoined.

    ``xs`` has the left edge of each line's box, in the order of lines. A newline stays one
    character; where a mark breaks a word, mark and newline are left out.
    """
    n_columns = 1 if n_columns is None and not xs else n_columns
    if ((n_columns or 0) < 2 or not (_may_join(text) and _GUTTER.search(text)) and _in_order(xs)) and not _SLOW.search(text):
        return _plain(text)
    lines, at = [], 0
    for line in text.split("\n"):
        lines.append((at, at + len(line)))
        at += len(line) + 1
    parts: list[str] = []
    where: list[int] = []
    origin: list[int] = []
    n = 0
    unseen = _UNSEEN.search(text) is not None
    moved: list[tuple[int, int]] = []
    columns = [_adverts_after(c, text, moved) for c in _columns(lines, text, xs, n_columns)]
    # Columns follow one another, so a sentence may go on in the next; adverts come last.
    whole = [line for c in columns for line in c]
    for column in (whole, moved):
        for i, (s, e) in enumerate(column):
            while s < e and text[s] in " \t":
                s += 1
            while e > s and text[e - 1] in " \t":
                e -= 1
            joined = False
            if e > s and text[e - 1] in MARKS and e - s > 1 and text[e - 2].isalnum():
                k = i + 1
                while k < len(column) and column[k][1] <= column[k][0]:
                    k += 1
                follows = text[column[k][0] : column[k][1]].lstrip() if k < len(column) else ""
                if follows and (follows[0].islower() or follows[0].isdigit() or (text[e - 2].isupper() and follows[0].isupper() and follows[1:2].isupper()) or text[e - 1] != "-"):
                    joined = True
            stop = e - 1 if joined else e
            # A hyphen that is no break mark ends the line inside a double name.
            tight = joined or (e > s and text[e - 1] == "-")
            at = s
            for m in _UNSEEN.finditer(text, s, stop) if unseen else ():
                if m.start() > at:
                    parts.append(text[at : m.start()])
                    where.append(n)
                    origin.append(at)
                    n += m.start() - at
                at = m.end()
            parts.append(text[at:stop])
            where.append(n)
            origin.append(at)
            n += stop - at
            if not tight:
                parts.append("\n")
                where.append(n)
                origin.append(min(e, len(text) - 1))
                n += 1
    return Reading("".join(parts), where or [0], origin or [0], text)
