"""Randomly rotated one-bit codes of unit vectors, with unbiased estimates and error bounds."""

from __future__ import annotations

import numpy as np


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def pack(bits: np.ndarray) -> np.ndarray:
    """Boolean rows to rows of unsigned 64-bit words, padded with zeros."""
    n, d = bits.shape
    padded = np.zeros((n, -(-d // 64) * 64), np.uint8)
    padded[:, :d] = bits
    return np.packbits(padded, axis=1, bitorder="little").view(np.uint64)


def encode(vectors: np.ndarray, center: np.ndarray, rot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed code, distance to the center and the code's inner product with its vector, per row."""
    rest = vectors - center
    norm = np.linalg.norm(rest, axis=1)
    turned = (rest / np.maximum(norm, 1e-12)[:, None]) @ rot
    own = np.abs(turned).sum(axis=1) / np.sqrt(vectors.shape[1])
    return pack(turned > 0), norm, np.maximum(own, 1e-6)


def signs(codes: np.ndarray, dim: int) -> np.ndarray:
    """Packed codes as rows of -1 and 1."""
    bits = np.unpackbits(codes.view(np.uint8), axis=1, count=None, bitorder="little")[:, :dim]
    return bits.astype(np.float32) * 2 - 1


class Codes:
    """Coded vectors of one list, made ready to bound their cosine with many queries by one matrix product.

    With o the coded and q the query vector, both of length 1, and c the center, the cosine is
    ``1 - |q - c|^2 / 2 - |o - c|^2 / 2 + <q - c, o - c>``.  The last term is estimated by the inner product of the
    rotated query with the code's signs, divided by the code's own inner product, which makes it
    unbiased; its error is at most ``eps * |q - c| * |o - c| * sqrt((1 - own^2) / own^2 / (dim - 1))`` but for a chance
    that falls as exp(-eps^2).
    """

    def __init__(self, codes: np.ndarray, norm: np.ndarray, own: np.ndarray, center: np.ndarray, rot: np.ndarray, eps: float):
        self.center, self.rot, dim = center, rot, rot.shape[0]
        error = eps * norm * np.sqrt(np.maximum(1 - own**2, 0) / own**2 / max(1, dim - 1))
        scaled = signs(codes, dim) * (norm / own / np.sqrt(dim))[:, None]
        self.matrix = np.column_stack([scaled, -(norm**2) / 2, np.ones(len(norm)), error]).astype(np.float32)

    def queries(self, vectors: np.ndarray) -> np.ndarray:
        """Query rows against which ``upper`` and ``lower`` are taken."""
        rest = vectors - self.center
        norm = np.linalg.norm(rest, axis=1)
        return np.column_stack([rest @ self.rot, np.ones(len(norm)), 1 - norm**2 / 2, norm]).astype(np.float32)

    def upper(self, queries: np.ndarray) -> np.ndarray:
        """Upper bound of the cosine of every query with every coded vector."""
        return queries @ self.matrix.T

    def lower(self, queries: np.ndarray) -> np.ndarray:
        """Lower bound of the same."""
        flipped = queries.copy()
        flipped[:, -1] *= -1
        return flipped @ self.matrix.T
