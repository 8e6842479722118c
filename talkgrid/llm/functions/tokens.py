"""Tokens of a public byte-pair vocabulary, and what a classifier of domains sees of them."""

from __future__ import annotations

import base64
import functools
import os

import numpy as np

#: Where vocabulary files lie unless a parameter says otherwise.
VOCABULARY = os.environ.get("TALKGRID_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Fixed value: the pattern that splits a text before the merges of the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.lru_cache(maxsize=2)
def encoder(path: str):
    """The encoder of a rank file, loaded once per process."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_ids(text: str, path: str) -> np.ndarray:
    """Tokens of a text."""
    return np.array(encoder(path).encode_ordinary(text), dtype=np.int64)


def features(ids: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the tokens and the square roots of their shares, a vector of length 1."""
    at, n = np.unique(ids % buckets, return_counts=True)
    return at, np.sqrt(n / max(1, len(ids)))


class Domains:
    """Softmax classifier of domains over bucketed tokens."""

    def __init__(self, names: list[str], weights: np.ndarray, bias: np.ndarray):
        self.names, self.weights, self.bias = names, weights, bias

    @classmethod
    def fit(cls, rows: list[tuple[np.ndarray, np.ndarray]], labels: list[str], buckets: int, rounds: int = 50, ridge: float = 1e-3) -> Domains:
        """Full-batch gradient descent with momentum; the ridge keeps posteriors soft."""
        names = sorted(set(labels))
        y = np.array([names.index(x) for x in labels])
        index, value = [np.asarray(i, np.int64) for i, _ in rows], [np.asarray(v) for _, v in rows]
        row = np.repeat(np.arange(len(rows)), [len(i) for i in index])
        col = np.concatenate(index) if index else np.empty(0, np.int64)
        val = np.concatenate(value) if value else np.empty(0)
        used, local = np.unique(col, return_inverse=True)
        x = np.zeros((len(rows), len(used)), np.float32)
        x[row, local] = val
        w, b = np.zeros((len(used), len(names)), np.float32), np.log(np.bincount(y, minlength=len(names)) / len(y)).astype(np.float32)
        goal = np.eye(len(names), dtype=np.float32)[y]
        speed = np.zeros_like(w)
        for _ in range(rounds):
            z = x @ w + b
            z -= z.max(axis=1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(axis=1, keepdims=True)
            speed = 0.9 * speed + x.T @ (p - goal) / len(y) + ridge * w
            w -= 2.0 * speed
        full = np.zeros((buckets, len(names)), np.float32)
        full[used] = w
        return cls(names, full, b.astype(float))

    def posterior(self, at: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Probability of every domain."""
        z = self.bias + value @ self.weights[at]
        p = np.exp(z - z.max())
        return p / p.sum()
