"""Cutting one text into overlapping pieces by content-defined landmarks."""

from __future__ import annotations

import re

import numpy as np
import xxhash

_TOKEN = re.compile(r"[^ \t\r\n]+")
_ENDS = re.compile(r"[.!?…。！？]+[\"'”’»)\]]*$")
_CLAUSE = re.compile(r"[,;:]+[\"'”’»)\]]*$")
#: Words in the rolling window of a landmark.
WINDOW = 5


def token_spans(text: str) -> list[tuple[int, int]]:
    """Start and end of every run of characters other than space, tab and line break."""
    return [m.span() for m in _TOKEN.finditer(text)]


def boundary_strength(text: str, spans: list[tuple[int, int]]) -> np.ndarray:
    """For a cut before token i: 4 after a blank line, 3 after a sentence, 2 at a line break, 1 after a clause, 0 elsewhere."""
    out = np.zeros(len(spans) + 1, np.int8)
    for i in range(1, len(spans)):
        a, b = spans[i - 1], spans[i]
        lines = text.count("\n", a[1], b[0])
        if lines > 1:
            out[i] = 4
        elif _ENDS.search(text, a[0], a[1]):
            out[i] = 3
        elif lines:
            out[i] = 2
        elif _CLAUSE.search(text, a[0], a[1]):
            out[i] = 1
    out[0] = out[len(spans)] = 4
    return out


def landmarks(text: str, spans: list[tuple[int, int]], every: int) -> np.ndarray:
    """Whether a landmark lies before token i: the rolling hash of the tokens before it is 0 modulo ``every``."""
    n = len(spans)
    h = np.fromiter((xxhash.xxh64_intdigest(text[a:b].encode("utf-8", "surrogatepass")) for a, b in spans), np.uint64, n)
    roll, factor = np.zeros(n + 1, np.uint64), 1
    for j in range(WINDOW):
        # token i - 1 - j contributes to the cut before token i
        roll[j + 1 :] += h[: n - j] * np.uint64(factor)
        factor = factor * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
    roll ^= roll >> np.uint64(31)
    return roll % np.uint64(max(1, every)) == 0


def cut_points(text: str, spans: list[tuple[int, int]], limit: int, overlap: int) -> list[int]:
    """Tokens before which the text is cut, so that every piece with its overlap holds at most ``limit``.

    A cut lies between a quarter of the room and the whole of it, at the strongest boundary there is in
    this reach; of several as strong at the one nearest to the landmark.  Where there is no boundary the
    landmark itself cuts, and without one the room's end.
    """
    n = len(spans)
    if n <= limit:
        return []
    strength = boundary_strength(text, spans)
    first_max, step = limit, limit - overlap
    least = max(1, step // 4)
    marks = landmarks(text, spans, max(1, step // 3))
    mark_at = np.flatnonzero(marks)
    levels = [np.flatnonzero(strength == level) for level in (4, 3, 2, 1)]
    cuts, start = [], 0
    while True:
        most = start + (first_max if start == 0 else step)
        if n <= most:
            return cuts
        low = start + least
        k = np.searchsorted(mark_at, low)
        mark = int(mark_at[k]) if k < len(mark_at) and mark_at[k] <= most else None
        cut = None
        for places in levels:
            a, b = np.searchsorted(places, low), np.searchsorted(places, most, "right")
            if a < b:
                near = places[a:b]
                cut = int(near[np.argmin(np.abs(near - mark))]) if mark is not None else int(near[-1])
                break
        if cut is None:
            cut = mark if mark is not None else most
        cuts.append(cut)
        start = cut


def split_text(text: str, limit: int, overlap: int) -> list[tuple[int, int, int, str]]:
    """Pieces ``(first new token, overlap tokens, tokens, text)``; a text within the limit is one piece."""
    if limit < 1 or overlap < 0 or overlap >= limit:
        raise ValueError("need 0 <= overlap < limit")
    spans = token_spans(text)
    cuts = cut_points(text, spans, limit, overlap)
    if not cuts:
        return [(0, 0, len(spans), text)]
    edges = [0, *cuts, len(spans)]
    out = []
    for a, b in zip(edges, edges[1:]):
        back = min(overlap, a)
        out.append((a, back, b - a + back, text[spans[a - back][0] : spans[b - 1][1]]))
    return out
