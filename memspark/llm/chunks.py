"""Texts cut where no token of a byte-level tokenizer can cross.

The pattern of these tokenizers joins a word with one space before it and no other white space.
So a text may be cut before every single space that stands between two characters that are
not white space: the parts are tokenized as they would be inside the text. As words recur,
tokenizing each part once is many times cheaper than tokenizing whole texts.
"""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_LITTLE = sys.byteorder == "little" and array("I").itemsize == 4
_UNEVEN = re.compile(r"\s | \s")  # a space beside other white space
_CUT = re.compile(r"(?<=\S)(?= \S)")
LONG = 200  # characters; longer parts are not kept


def cut(text: str) -> list[str]:
    """The parts of a text; together they are the text."""
    if not text:
        return []
    if _UNEVEN.search(text):
        return _CUT.split(text)
    first, *rest = text.split(" ")
    parts = [" " + part for part in rest]
    return [first, *parts] if first else parts


def pack_ids(ids: list[int]) -> bytes:
    """Ids as little-endian numbers of 32 bits."""
    return array("I", ids).tobytes() if _LITTLE else np.array(ids, "<u4").tobytes()


# The same test for Arrow: white space as Python's patterns know it.
_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_UNEVEN_ARROW = f"{_SPACE} | {_SPACE}"


def cut_all(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct parts of all texts, the number of the part at each place, and the places where texts begin.

    The last array has one entry more than there are texts. Null reads as empty.
    """
    texts = texts.cast(pa.large_string()).fill_null("")
    uneven = pc.match_substring_regex(texts, _UNEVEN_ARROW).to_numpy(zero_copy_only=False)
    even = pc.split_pattern(texts.filter(pa.array(~uneven)), " ")
    counts = np.zeros(len(texts), np.int64)
    counts[~uneven] = pc.list_value_length(even).to_numpy(zero_copy_only=False)
    coded = even.flatten().dictionary_encode()
    words, code = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.zeros(len(code), bool)
    own = counts[~uneven]
    first[(np.cumsum(own) - own)] = True
    number = np.full((2, len(words)), -1, np.int64)  # of a word at the start of a text, and after a space
    parts: list[str] = []
    for row, lead in ((0, ""), (1, " ")):
        used = np.unique(code[first == (row == 0)])
        number[row, used] = np.arange(len(parts), len(parts) + len(used))
        parts += [lead + words[w] for w in used.tolist()]
    code = number[np.where(first, 0, 1), code]
    odd = [cut(text) for text in texts.filter(pa.array(uneven)).to_pylist()]
    counts[uneven] = [len(o) for o in odd]
    offsets = np.concatenate([[0], np.cumsum(counts)])
    place = np.empty(offsets[-1], np.int64)
    is_odd = np.repeat(uneven, counts)
    place[~is_odd] = code
    place[is_odd] = np.arange(len(parts), len(parts) + int(is_odd.sum()))
    parts += [part for o in odd for part in o]
    return parts, place, offsets


def spread(values: list[bytes], place: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of whole texts from the ids (32 bits each) of their parts: all ids, and where each text begins."""
    length = np.fromiter(map(len, values), np.int64, len(values)) // 4
    start = np.cumsum(length) - length
    flat = np.frombuffer(b"".join(values), "<u4")
    own = length[place]
    before = np.cumsum(own) - own
    ids = flat[np.repeat(start[place] - before, own) + np.arange(own.sum())]
    return ids, np.append(before, len(ids))[offsets]


class Memory:
    """What ``work`` makes of lists of parts. Holds the parts met lately: at most twice ``size``.

    When ``size`` parts are held they become the older half, and parts of it that are met again come back.
    """

    def __init__(self, work: Callable[[list[str]], list], size: int = 600_000):
        self.work, self.size = work, size
        self.recent: dict[str, object] = {}
        self.older: dict[str, object] = {}

    def values(self, parts: list[str]) -> list:
        """The value of each part; those not held are worked out together."""
        out = list(map(self.recent.get, parts))
        lacking = [i for i, value in enumerate(out) if value is None]
        new = []
        for i in lacking:
            out[i] = self.older.get(parts[i])
            if out[i] is None:
                new.append(i)
        for at in range(0, len(new), 4096):
            some = new[at : at + 4096]
            for i, value in zip(some, self.work([parts[i] for i in some])):
                out[i] = value
        for i in lacking:
            if len(parts[i]) <= LONG:
                self.recent[parts[i]] = out[i]
        if len(self.recent) >= self.size:
            self.recent, self.older = {}, self.recent
        return out

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """For ``work`` that gives ids: all ids of the texts, and where each text begins."""
        parts, place, offsets = cut_all(texts)
        return spread(self.values(parts), place, offsets)

    def sums(self, texts: pa.Array) -> np.ndarray:
        """For ``work`` that gives numbers: their sum over the parts of each text."""
        parts, place, offsets = cut_all(texts)
        value = np.array(self.values(parts), np.int64)
        total = np.concatenate([[0], np.cumsum(value[place])])
        return total[offsets[1:]] - total[offsets[:-1]]
