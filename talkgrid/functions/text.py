"""Text normalization shared by the operators, as plain Python for Arrow-batched functions."""

from __future__ import annotations

import re
import unicodedata

#: Cyrillic and Greek letters that look like Latin ones.
CONFUSABLES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "к": "k", "м": "m",
    "н": "h", "о": "o", "р": "p", "т": "t", "у": "y", "х": "x", "ѵ": "v", "ԛ": "q", "ԝ": "w", "һ": "h",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
}
_FOLD = str.maketrans(CONFUSABLES)
_WORD = re.compile(r"[^\W_]+", re.UNICODE)
_ASCII_WORD = re.compile(r"[a-z0-9]+")
_POSSESSIVE = re.compile(r"(?<=\w)['’]s\b")
_LATIN = re.compile(r"[a-zà-ÿ]")
_FOREIGN = re.compile(r"[\u0370-\u052f]")
#: Anything that compatibility composition may change, or that is invisible; plain Western European text has none.
_ODD = re.compile(r"[\xa0\xa8\xaa\xad\xaf\xb2-\xb5\xb8-\xba\xbc-\xbe]|[^\x00-\xff\u2010-\u2016\u2018-\u201f\u2020-\u2022\u20ac]")


def _fold_word(word: str) -> str:
    """Replace look-alike letters when the word also holds Latin letters."""
    if word.isascii() or not _LATIN.search(word):
        return word
    return word.translate(_FOLD)


def plain(text: str | None) -> str:
    """Compatibility form, lower case, without invisible characters; null gives ''."""
    if not text:
        return ""
    if text.isascii():
        return text.lower()
    shown = text
    if _ODD.search(text):
        shown = unicodedata.normalize("NFKC", text)
        # drop format characters (zero-width, byte-order marks) and soft hyphens
        shown = "".join(ch for ch in shown if ch.isascii() or unicodedata.category(ch) != "Cf")
    return shown.casefold() if "ß" not in shown else shown.lower()


def words(text: str | None) -> list[str]:
    """Words of letters and digits of the normalized text, possessives split off."""
    shown = plain(text)
    if "'" in shown or "’" in shown:
        shown = _POSSESSIVE.sub("", shown)
    if shown.isascii():
        return _ASCII_WORD.findall(shown)
    found = _WORD.findall(shown)
    return [_fold_word(w) for w in found] if _FOREIGN.search(shown) else found


def edits_within(a: str, b: str, limit: int) -> bool:
    """Whether ``a`` becomes ``b`` by at most ``limit`` edits, a swap of neighbours counting one."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > limit:
        return False
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            best = min(row[j] + 1, now[j - 1] + 1, row[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 1)
            now.append(best)
        if min(now) > limit:
            return False
        before, row = row, now
    return row[-1] <= limit


def same_word(a: str, b: str) -> bool:
    """Equal up to a slip of the keyboard: one edit from four letters on, two from eight on."""
    short = min(len(a), len(b))
    if a == b or short < 4 or a.isdigit() or b.isdigit():
        return a == b
    return edits_within(a, b, 2 if short >= 8 else 1)
