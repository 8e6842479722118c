"""The label model of noisy labelling functions, and its cutoffs."""

from __future__ import annotations

import random

import numpy as np

from talkgrid.llm.functions.answers import VOTES, signals
from talkgrid.llm.functions.languages import Languages

DEFECTS = ("empty", "truncated", "refusal", "copy", "language")
CANDIDATES = (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95)
#: F1 on held-out spoiled answers, by defect and cutoff of ``CANDIDATES``: sound answers of the tables of scale 0.01,
#: half of them spoiled (seed 0; ``tests/llm/test_pairs.py`` repeats it).
SWEEP = {
    "empty": (1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0),
    "truncated": (0.9589, 0.9589, 0.9589, 0.9589, 0.9589, 0.9589, 0.9589, 0.9589, 0.9589, 0.9444, 0.9444),
    "refusal": (0.5846, 0.5846, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0),
    "copy": (1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 0.8696, 0.8696),
    "language": (1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 0.9804, 0.9804),
}
#: Posterior from which a defect is kept: the middle of the cutoffs of largest F1 in ``SWEEP``.
CUTOFFS = {"empty": 0.5, "truncated": 0.4, "refusal": 0.6, "copy": 0.4, "language": 0.4}
_ROUNDS = 50


def _em(fires: np.ndarray, n: np.ndarray, pro: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    # prior counts (fired, not fired) on defects and on sound rows
    on_a, on_b = np.where(pro, 6.0, 1.0), np.where(pro, 4.0, 20.0)
    off_a, off_b = np.where(pro, 1.0, 14.0), np.where(pro, 200.0, 6.0)
    share, on, off = 0.05, on_a / (on_a + on_b), off_a / (off_a + off_b)
    post = np.zeros(len(n))
    for _ in range(_ROUNDS):
        log_on = (fires * np.log(on) + (1 - fires) * np.log(1 - on)) @ weight + np.log(share)
        log_off = (fires * np.log(off) + (1 - fires) * np.log(1 - off)) @ weight + np.log(1 - share)
        new = 1 / (1 + np.exp(np.clip(log_off - log_on, -700, 700)))
        w = n * new
        on = (w @ fires + on_a) / (w.sum() + on_a + on_b)
        off = ((n - w) @ fires + off_a) / ((n - w).sum() + off_a + off_b)
        share = (w.sum() + 1) / (n.sum() + 20)
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return new, on, off


def dependence(fires: np.ndarray, n: np.ndarray, post: np.ndarray) -> np.ndarray:
    """Correlation of every two functions given the truth: the larger of those on defects and on sound rows."""
    out = np.zeros((fires.shape[1],) * 2)
    for w in (n * post, n * (1 - post)):
        if w.sum() < 20:
            continue
        mean = w @ fires / w.sum()
        dev = fires - mean
        cov = (dev * w[:, None]).T @ dev / w.sum()
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        out = np.maximum(out, cov / np.outer(sd, sd))
    return np.clip(out, 0.0, 1.0)


def label_model(patterns: np.ndarray, counts: np.ndarray, votes: list[int]) -> np.ndarray:
    """Posterior of the defect for each pattern of votes, by expectation-maximization.

    A labelling function either fires or not.  Fire rates and the share of defects are re-estimated from
    the posteriors, weighted by the patterns' counts, under weak priors: a function that votes for the
    defect fires on most defects and on few sound rows, one that votes against it the other way
    round.  Functions that depend on each other given the truth would be counted twice: after a first fit
    each function's evidence is divided by one plus its correlations with the others, and the model is
    fitted again.
    """
    fires, n, pro = patterns.astype(float), counts.astype(float), np.array(votes) == 1
    post, _, _ = _em(fires, n, pro, np.ones(fires.shape[1]))
    linked = dependence(fires, n, post)
    np.fill_diagonal(linked, 0.0)
    linked[linked < 0.2] = 0.0
    return _em(fires, n, pro, 1 / (1 + linked.sum(axis=1)))[0]


def posteriors(rows: list[list[bool]]) -> list[dict[str, float]]:
    """The posteriors of every row of signals, by a label model over these rows."""
    out: list[dict[str, float]] = [{} for _ in rows]
    for d in DEFECTS:
        at = [i for i, v in enumerate(VOTES) if v[0] == d]
        codes = [tuple(r[i] for i in at) for r in rows]
        found = sorted(set(codes))
        post = label_model(np.array(found).astype(int), np.array([codes.count(c) for c in found]), [VOTES[i][2] for i in at])
        by = dict(zip(found, post))
        for o, c in zip(out, codes):
            o[d] = float(by[c])
    return out


def spoiled(pairs: list[tuple[str, str]], others: dict[str, list[str]], language_of, seed: int = 0) -> list[tuple[str, str | None, str]]:
    """Sound pairs of a question and an answer, half of them spoiled in a known way: (question, answer, defect or '')."""
    rng, out = random.Random(seed), []
    for q, a in pairs:
        kind = rng.choice(["", "", "", "", "", *DEFECTS])
        if kind == "empty":
            a = rng.choice(["", None, "-", " \u200b", "N/A", "null", "...", "{}"])
        elif kind == "truncated":
            cut = [k for k in range(len(a) // 3, len(a) - 3) if a[k - 1] not in ".!?)\"”\n" and a[k].isalpha()]
            if len(a.split()) < 9 or not cut:
                kind = ""
            else:
                a = a[: rng.choice(cut)]
        elif kind == "refusal":
            a = rng.choice(["I cannot answer this question.", "Sorry, I can't tell from the clips.", "No relevant information found.", "I don't know.", "Unable to answer.", "Leider kann ich das nicht beantworten.", "Lo siento, no puedo responder.", "Je ne peux pas répondre."])
        elif kind == "copy":
            a = rng.choice([q, q.upper(), f"Question: {q}", f"**{q}**", q.rstrip("?")])
        elif kind == "language":
            away = [lang for lang in others if lang != language_of(q) and others[lang]]
            if language_of(q) is None or not away:
                kind = ""
            else:
                a = rng.choice(others[rng.choice(away)])
        out.append((q, a, kind))
    return out


def sweep(rows: list[tuple[str, str | None, str]], languages: Languages | None) -> dict[str, list[float]]:
    """F1 of every defect at every cutoff of ``CANDIDATES`` over spoiled answers; the label model sees no truth."""
    found = posteriors([signals(q, a, None, True, None, languages) for q, a, _ in rows])
    out = {}
    for d in DEFECTS:
        f1 = []
        for cut in CANDIDATES:
            said = [p[d] >= cut for p in found]
            hit = sum(s and r[2] == d for s, r in zip(said, rows))
            f1.append(round(2 * hit / max(1, sum(said) + sum(r[2] == d for r in rows)), 4))
        out[d] = f1
    return out


def chosen(f1: list[float]) -> float:
    """The middle of the cutoffs with the largest F1."""
    best = [c for c, f in zip(CANDIDATES, f1) if f == max(f1)]
    return best[len(best) // 2]
