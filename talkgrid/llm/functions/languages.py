"""Languages by character n-grams, trained on labelled texts."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np

_LETTERS = re.compile(r"[^\W\d_]+")
N = 3
#: Texts a language needs to be known.
LEAST_TEXTS = 20
#: Log odds over the whole text, and a letter group, from which one language is taken for another.
ODDS, ODDS_EACH = 6.0, 0.12
#: How far below the usual a letter group's log probability must be, in every known language, for an unknown one
#: (the training texts have few words, so less far off may be new words or code).
UNLIKE, UNLIKE_GRAMS = 4.5, 25


def grams(text: str) -> list[str]:
    """Groups of ``N`` characters of the words, single spaces between."""
    shown = " " + " ".join(_LETTERS.findall(text.lower())) + " "
    return [shown[i : i + N] for i in range(len(shown) - N + 1)] if len(shown) > N else []


class Languages:
    """Smoothed n-gram frequencies of every language with enough labelled texts."""

    def __init__(self, names: list[str], index: dict[str, int], logs: np.ndarray, unseen: np.ndarray, usual: np.ndarray):
        self.names, self.index, self.logs, self.unseen, self.usual = names, index, logs, unseen, usual

    @classmethod
    def fit(cls, rows: list[tuple[str, str]]) -> Languages | None:
        """From (language, text); a fifth of the texts tells what is usual.  None without any known language."""
        texts: dict[str, list[list[str]]] = {}
        for lang, text in rows:
            own = grams(text)
            if own:
                texts.setdefault(lang, []).append(own)
        texts = {lang: own for lang, own in texts.items() if len(own) >= LEAST_TEXTS}
        if not texts:
            return None
        names = sorted(texts)
        counts = [Counter(g for k, own in enumerate(texts[lang]) if k % 5 for g in own) for lang in names]
        index = {g: i for i, g in enumerate(sorted(set().union(*counts)))}
        table = np.array([[c[g] for c in counts] for g in index], dtype=np.float64) + 0.5
        total = table.sum(axis=0) + 0.5
        model = cls(names, index, np.log(table / total), np.log(0.5 / total), np.zeros(len(names)))
        for i, lang in enumerate(names):
            held = [model.scores(own)[i] for k, own in enumerate(texts[lang]) if k % 5 == 0]
            model.usual[i] = float(np.median(held))
        return model

    def scores(self, own: list[str]) -> np.ndarray:
        """Mean log probability of the groups in every language."""
        at = [self.index.get(g, -1) for g in own]
        known = np.array([a for a in at if a >= 0], dtype=np.int64)
        return (self.logs[known].sum(axis=0) + (len(at) - len(known)) * self.unseen) / max(1, len(at))

    def best(self, text: str) -> int | None:
        """Number of the language the text is in, or None where two are as likely."""
        own = grams(text)
        if not own:
            return None
        s = self.scores(own)
        order = np.argsort(-s)
        if len(s) > 1 and (s[order[0]] - s[order[1]]) * len(own) < ODDS:
            return None
        return int(order[0])

    def differs(self, question: int | None, answer: str) -> bool:
        """Whether the answer is surely in another known language than the question."""
        own = grams(answer)
        if question is None or not own:
            return False
        s = self.scores(own)
        gap = s.max() - s[question]
        return bool(gap * len(own) > ODDS and gap > ODDS_EACH)

    def unlike(self, answer: str) -> bool:
        """Whether the answer is like no known language."""
        own = grams(answer)
        return len(own) >= UNLIKE_GRAMS and bool((self.scores(own) < self.usual - UNLIKE).all())
