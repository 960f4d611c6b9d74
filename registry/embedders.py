"""Embedders that fail, for the queries on retries and on vectors that cannot be stored."""

from __future__ import annotations

import hashlib

import numpy as np

from memspark.operators.embed import HashingEmbedder


class FirstTimeFailing(HashingEmbedder):
    """Fails the first time it meets a text in a process, and works from then on."""

    def __init__(self, dim: int):
        super().__init__(dim)
        self.met: set[bytes] = set()  # by a short hash: whole texts would be held for as long as the task runs

    def encode(self, texts, pooling="mean", normalize=True):
        new = {hashlib.blake2b(repr(text).encode(), digest_size=16).digest() for text in texts} - self.met
        self.met |= new
        if new:
            raise RuntimeError("not ready")
        return super().encode(texts, pooling, normalize)


class Down(HashingEmbedder):
    """Fails for texts with an even number of characters."""

    def encode(self, texts, pooling="mean", normalize=True):
        if any(len(text) % 2 == 0 for text in texts):
            raise RuntimeError("down")
        return super().encode(texts, pooling, normalize)


class Crooked(HashingEmbedder):
    """By the number of characters modulo 5: fails, gives a vector too wide, one with NaN, one with infinity, or a good one."""

    def encode(self, texts, pooling="mean", normalize=True):
        if any(len(text) % 5 == 0 for text in texts):
            raise RuntimeError("no")
        out = []
        for text, vector in zip(texts, super().encode(texts, pooling, normalize)):
            kind = len(text) % 5
            if kind == 1:
                vector = np.append(vector, 0.0)
            elif kind in (2, 3):
                vector[0] = np.nan if kind == 2 else np.inf
            out.append(vector)
        return out
