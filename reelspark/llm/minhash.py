"""MinHash banding over padded q-grams, with recall tuned from the collision curve."""

from __future__ import annotations

import zlib

import numpy as np


def qgrams(text: str, q: int = 2) -> list[str]:
    """Padded q-grams: every character takes part in q of them, those at the ends too."""
    if not text:
        return []
    pad = "\u0002" * (q - 1)
    t = pad + text + pad.replace("\u0002", "\u0003")
    return list({t[i : i + q] for i in range(len(t) - q + 1)})


def collision(s: float, bands: int, rows: int) -> float:
    """Probability that two sets of Jaccard similarity ``s`` share a band."""
    return 1.0 - (1.0 - s**rows) ** bands


def tune(at: float, recall: float, most: int = 96) -> tuple[int, int]:
    """(bands, rows) with the most rows per band that still reach ``recall`` at similarity ``at`` within ``most`` hash functions."""
    best = (most, 1)
    for rows in range(1, 9):
        bands = next((b for b in range(1, most // rows + 1) if collision(at, b, rows) >= recall), None)
        if bands is None:
            break
        best = (bands, rows)
    return best


class Bander:
    """Band keys of a set of q-grams."""

    _PRIME = (1 << 61) - 1

    def __init__(self, bands: int, rows: int, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = rng.integers(1, 1 << 63, bands * rows, dtype=np.uint64) | np.uint64(1)
        self.b = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
        self.band = np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def keys(self, grams: list[str]) -> np.ndarray:
        """One 64-bit key per band."""
        x = np.fromiter((zlib.crc32(g.encode()) for g in grams), np.uint64, len(grams))
        x = (x + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h = x[:, None] * self.a + self.b
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        low = h.min(0).reshape(self.bands, self.rows)
        key = self.band.copy()
        for i in range(self.rows):
            key = (key ^ low[:, i]) * np.uint64(0x94D049BB133111EB)
            key ^= key >> np.uint64(31)
        return key.view(np.int64)
