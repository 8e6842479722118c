"""English word stems by the published suffix-stripping rules (Porter's second algorithm), and web search queries."""

from __future__ import annotations

import functools
import re

_VOWELS = "aeiouy"
_SHORT = re.compile(r"^(?:[aeiouy][^aeiouy]|.*[^aeiouy][aeiouy][^aeiouywxY])$")
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
#: Words with stems of their own.
_WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_KEPT = frozenset("inning outing canning herring earring proceed exceed succeed".split())
#: Suffixes of the later steps and what takes their place.
_STEP2 = (
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"),
    ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"),
)
_STEP3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")


def _regions(w: str) -> tuple[int, int]:
    """Where the parts behind the first and the second vowel and consonant begin."""
    spots = []
    at = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    if at is not None:
        spots.append(at)
    i = spots[0] if spots else 0
    while len(spots) < 2:
        while i < len(w) and w[i] not in _VOWELS:
            i += 1
        while i < len(w) and w[i] in _VOWELS:
            i += 1
        i = min(i + 1, len(w))
        spots.append(i)
    return spots[0], spots[1]


def _has_vowel(part: str) -> bool:
    return any(ch in _VOWELS for ch in part)


@functools.lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    """The stem of a lower-case English word; other words come out with nothing but such suffixes taken."""
    if len(word) <= 2 or not word.isascii() or not word.isalpha():
        return word
    if word in _WHOLE:
        return _WHOLE[word]
    # a y that stands for a consonant is marked
    w = re.sub(r"(?:(?<=^)|(?<=[aeiouy]))y", "Y", word)
    r1, r2 = _regions(w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and _has_vowel(w[:-2]):
        w = w[:-1]
    if w in _KEPT:
        return w
    if w.endswith(("eedly", "eed")):
        cut = 5 if w.endswith("eedly") else 3
        if len(w) - cut >= r1:
            w = w[:-cut] + "ee"
    else:
        cut = next((len(s) for s in ("ingly", "edly", "ing", "ed") if w.endswith(s)), 0)
        if cut and _has_vowel(w[:-cut]):
            w = w[:-cut]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif w.endswith(_DOUBLES):
                w = w[:-1]
            elif r1 >= len(w) and _SHORT.match(w):
                w += "e"
    if w[-1] in "yY" and len(w) > 2 and w[-2] not in _VOWELS:
        w = w[:-1] + "i"
    for suffix, put in _STEP2:
        if w.endswith(suffix):
            if len(w) - len(suffix) >= r1:
                w = w[: -len(suffix)] + put
            break
    else:
        if w.endswith("ogi") and len(w) - 3 >= r1 and w[-4:-3] == "l":
            w = w[:-1]
        elif w.endswith("li") and len(w) - 2 >= r1 and w[-3:-2] in tuple("cdeghkmnrt"):
            w = w[:-2]
    for suffix, put in _STEP3:
        if w.endswith(suffix):
            if len(w) - len(suffix) >= r1:
                w = w[: -len(suffix)] + put
            break
    else:
        if w.endswith("ative") and len(w) - 5 >= r2:
            w = w[:-5]
    for suffix in _STEP4:
        if w.endswith(suffix):
            if len(w) - len(suffix) >= r2:
                w = w[: -len(suffix)]
            break
    else:
        if w.endswith("ion") and len(w) - 3 >= r2 and w[-4:-3] in ("s", "t"):
            w = w[:-3]
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _SHORT.match(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


_PART = re.compile(r'(-?)"([^"]*)"|(\S+)')


def parse_websearch(query: str, words) -> list[tuple[list[list[str]], list[list[str]]]]:
    """Alternatives of a web search query, each (phrases wanted, phrases unwanted), by ``words(text)``.

    Quotes make a phrase, ``OR`` separates alternatives, a leading minus excludes; unbalanced quotes are
    spaces.  Parts without words are dropped, and so are alternatives that want nothing.
    """
    found: list[tuple[list[list[str]], list[list[str]]]] = [([], [])]
    text = query if query.count('"') % 2 == 0 else query[::-1].replace('"', " ", 1)[::-1]
    for minus, quoted, plain in _PART.findall(text):
        if plain.lower() == "or":
            found.append(([], []))
            continue
        bare = plain.lstrip("-")
        own = words(quoted if not plain else bare)
        if own:
            # a plain part of several words is a phrase as well, as in "trade-off"
            found[-1][1 if minus or (plain and plain.startswith("-")) else 0].append(own)
    return [f for f in found if f[0]]
