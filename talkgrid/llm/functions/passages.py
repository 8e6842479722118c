"""Words of a passage without markup and time codes, and their winnowed fingerprints."""

from __future__ import annotations

import html
import re

import numpy as np
import xxhash

from talkgrid.functions.text import words

_CUE_NUMBER = re.compile(r"(?m)^\s*\d+\s*\r?\n(?=\s*\d{1,2}:\d{2})")
_TIME = re.compile(r"[\[(<]?\b\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d{1,3})?\b[\])>]?|-->")
_TAG = re.compile(r"</?[A-Za-z][^<>]*>|<!--.*?-->", re.S)
_LINK = re.compile(r"\]\([^()\s]+\)")
#: Fixed odd multiplier of the rolling hash.
_STEP = 0x9E3779B97F4A7C15


def passage_words(text: str | None) -> list[str]:
    """Words of the text; case, punctuation, line breaks, markup and time codes do not matter."""
    if not text:
        return []
    shown = text
    if "&" in shown:
        shown = html.unescape(shown)
    if "<" in shown:
        shown = _TAG.sub(" ", shown)
    if "](" in shown:
        shown = _LINK.sub("] ", shown)
    if ":" in shown:
        shown = _TIME.sub(" ", _CUE_NUMBER.sub(" ", shown))
    return words(shown)


#: Hashes of words met before in this process; emptied when it holds ``_SEEN_WORDS``.
_SEEN: dict[str, int] = {}
_SEEN_WORDS = 1 << 20


def word_hashes(tokens: list[str]) -> np.ndarray:
    """Hash of every word."""
    if len(_SEEN) > _SEEN_WORDS:
        _SEEN.clear()
    get, put = _SEEN.get, _SEEN.setdefault
    return np.fromiter((get(t) or put(t, xxhash.xxh64_intdigest(t.encode()) | 1) for t in tokens), np.uint64, len(tokens))


def gram_hashes(tokens: list[str], k: int) -> np.ndarray:
    """Hash of every run of ``k`` words, as unsigned 64-bit integers."""
    n = len(tokens) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    base = word_hashes(tokens)
    out, factor = np.zeros(n, np.uint64), 1
    for j in range(k):
        out += base[j : j + n] * np.uint64(factor)
        factor = factor * _STEP & 0xFFFFFFFFFFFFFFFF
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Positions of the least hash of every window of ``window`` hashes (the last of equal ones).

    Two texts that share ``window`` consecutive hashes share a fingerprint.  Fewer hashes than a
    window still give their least one.
    """
    if len(hashes) == 0:
        return np.empty(0, np.int64)
    if len(hashes) <= window:
        return np.array([len(hashes) - 1 - int(np.argmin(hashes[::-1]))])
    view = np.lib.stride_tricks.sliding_window_view(hashes[::-1], window)
    at = np.argmin(view, axis=1) + np.arange(len(view))
    return np.unique(len(hashes) - 1 - at)


def longest_common_run(a: list[str], b: list[str], ga: np.ndarray, gb: np.ndarray, k: int) -> tuple[int, int]:
    """Length of the longest run of words of at least ``k`` that stands in both, and where in ``a``.

    ``ga`` and ``gb`` are the hashes of the runs of ``k`` words; equal ones are tested word by word and
    extended to the right as far as the words agree.  A hit inside a run already extended on the same
    diagonal is passed over.
    """
    order = np.argsort(gb, kind="stable")
    ranked = gb[order]
    low, high = np.searchsorted(ranked, ga, "left"), np.searchsorted(ranked, ga, "right")
    best, where, done = 0, -1, {}
    for i in np.flatnonzero(high > low).tolist():
        for j in order[low[i] : high[i]].tolist():
            if done.get(i - j, -1) > i or a[i : i + k] != b[j : j + k]:
                continue
            n = k
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            done[i - j] = i + n - k + 1
            if n > best:
                best, where = n, i
    return best, where
