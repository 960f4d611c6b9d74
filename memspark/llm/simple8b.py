"""Simple-8b coding of ids: a 64-bit word holds a 4-bit selector and up to 60 ids of equal width.

An id too large for the widest shared slot (30 bits) is an escape: a word of its own with 60 bits.
Ids are coded in blocks of BLOCK; every block starts a new word, and the offsets of the
blocks are stored, so blocks are coded and decoded all at once, word by word in step.
"""

from __future__ import annotations

import numpy as np

BLOCK = 128  # ids
# Fixed values of the format: selector -> ids in a word; each id has 60 // count bits.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = 60 // COUNTS


def _fits(bits: np.ndarray) -> np.ndarray:
    """For each block and place the number of ids that the best word from there holds."""
    blocks, length = bits.shape
    padded = np.zeros((blocks, length + int(COUNTS[0])), np.int8)
    padded[:, :length] = bits
    choice = np.full((blocks, length), len(COUNTS) - 1, np.int8)
    widest, done = padded[:, :length].copy(), 1
    for selector in range(len(COUNTS) - 2, -1, -1):
        for j in range(done, COUNTS[selector]):
            np.maximum(widest, padded[:, j : j + length], out=widest)
        done = COUNTS[selector]
        choice[widest <= WIDTHS[selector]] = selector
    return choice


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words, and the number of words before each block and in all; ids are below 2**60.

    A word at the end of a block may hold fewer ids than its selector says.
    """
    total = len(ids)
    blocks = -(-total // BLOCK)
    if not blocks:
        return np.zeros(0, np.uint64), np.zeros(1, np.uint32)
    value = np.zeros((blocks, BLOCK + int(COUNTS[0])), np.uint64)
    value[:, :BLOCK].reshape(-1)  # rows are padded with zeros, which fit any width
    flat = np.zeros(blocks * BLOCK, np.uint64)
    flat[:total] = ids
    value[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    bits = np.maximum(1, np.ceil(np.log2(value[:, :BLOCK].astype(np.float64) + 1))).astype(np.int8)
    choice = _fits(bits)
    last = np.full(blocks, BLOCK)
    last[-1] = total - (blocks - 1) * BLOCK
    at = np.zeros(blocks, np.int64)
    words, owners = [], []
    active = np.arange(blocks)
    while len(active):
        selector = choice[active, at[active]]
        word = selector.astype(np.uint64) << np.uint64(60)
        for s in np.unique(selector).tolist():
            of = np.flatnonzero(selector == s)
            row, start = active[of], at[active[of]]
            for j in range(COUNTS[s]):
                word[of] |= value[row, start + j] << np.uint64(j * WIDTHS[s])
        words.append(word)
        owners.append(active)
        at[active] += COUNTS[selector]
        active = active[at[active] < last[active]]
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    counts = np.bincount(owner, minlength=blocks)
    return np.concatenate(words)[order], np.concatenate([[0], np.cumsum(counts)]).astype(np.uint32)


def decode(words: np.ndarray, offsets: np.ndarray, total: int) -> np.ndarray:
    """The ids of whole blocks, ``total`` in all."""
    blocks = len(offsets) - 1
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[selector]
    before = np.cumsum(counts) - counts
    owner = np.repeat(np.arange(blocks), np.diff(offsets.astype(np.int64)))
    start = before - before[offsets[:-1].astype(np.int64)][owner] if len(words) else before
    out = np.zeros(blocks * BLOCK + int(COUNTS[0]), np.uint64)
    for s in np.unique(selector).tolist():
        of = np.flatnonzero(selector == s)
        place = owner[of] * BLOCK + start[of]
        limit = (owner[of] + 1) * BLOCK
        for j in range(COUNTS[s]):
            inside = place + j < limit
            slot = (words[of[inside]] >> np.uint64(j * WIDTHS[s])) & np.uint64((1 << int(WIDTHS[s])) - 1)
            out[place[inside] + j] = slot
    return out[:total]
