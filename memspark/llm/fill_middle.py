"""Fill-in-the-middle examples: a text cut in prefix, middle and suffix, and these put in another order.

The units of a cut are words with the white space before them; white space at the end of a text is a
unit of its own. Units are found in the UTF-8 of a whole batch as 64-bit words, eight bytes at a time:
arithmetic on a word marks the bytes that end a unit, ``bitwise_count`` counts the marks of a word, a
search in the running counts finds the word in which a unit ends, and the place inside it is found by
clearing the marks before. Code points are counted in the same way.

Forms: ``psm`` is <P>prefix<S>suffix<M>middle, ``spm`` is <S>suffix<P>prefix<M>middle, ``plain`` is the
text as it is. A text that is empty or holds one of the signs <P>, <S>, <M> is always plain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.llm.words import utf8

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SIGNS = "<[PSM]>"  # any of them
SEED = 42
RATE = 50  # per cent of the texts that are cut
SPM = 80  # per cent of those that put the suffix first
SLICE = 8 << 20  # bytes of text worked on at once, about

_ONE = np.uint64(1)
_LOW = np.uint64(0x7F7F7F7F7F7F7F7F)
_HIGH = np.uint64(0x8080808080808080)


def _each(byte: int) -> np.uint64:
    """A word of eight equal bytes."""
    return np.uint64(byte * 0x0101010101010101)


def separators(words: np.ndarray) -> np.ndarray:
    """The top bit of every byte that is U+0020 or U+0009 to U+000D."""
    other = words ^ _each(0x20)
    space = ~(((other & _LOW) + _LOW) | other)
    low = words & _LOW
    control = (low + _each(0x80 - 0x09)) & ~(low + _each(0x80 - 0x0E)) & ~words
    return (space | control) & _HIGH


class Marks:
    """Marked bytes (top bits) of a run of 64-bit words, with their running count."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    def rank(self, place: np.ndarray) -> np.ndarray:
        """Number of marks in the bytes before each place."""
        word = place >> 3
        inside = (_ONE << ((place & 7) << 3).astype(np.uint64)) - _ONE
        return self.before[word] + np.bitwise_count(np.append(self.words, np.uint64(0))[word] & inside)

    def select(self, number: np.ndarray) -> np.ndarray:
        """The byte of each mark, numbered from 0."""
        word = np.searchsorted(self.before, number, side="right") - 1
        left, rest = number - self.before[word], self.words[word]
        for _ in range(7):
            rest = np.where(left > 0, rest & (rest - _ONE), rest)
            left = left - 1
        return (word << 3) + (np.bitwise_count((rest & (~rest + _ONE)) - _ONE) >> 3)


class Units:
    """Unit ends and code points of texts: ``data`` holds their UTF-8, text i from offsets[i] to offsets[i + 1]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.offsets = offsets
        words = np.full((len(data) + 7) // 8 * 8, 0x20, np.uint8)
        words[: len(data)] = data
        words = words.view("<u8").astype(np.uint64)
        gap = separators(words)
        following = np.append(gap[1:], _HIGH) << np.uint64(56) if len(gap) else gap
        ends = ~gap & ((gap >> np.uint64(8)) | following) & _HIGH
        # whatever stands at the end of a text ends a unit there
        last = offsets[1:][offsets[1:] > offsets[:-1]] - 1
        np.bitwise_or.at(ends, last >> 3, np.uint64(0x80) << ((last & 7) << 3).astype(np.uint64))
        self.ends = Marks(ends)
        self.inner = Marks(words & ~(words << _ONE) & _HIGH)  # bytes that begin no code point
        self.first = self.ends.rank(offsets)
        self.count = np.diff(self.first)

    def after(self, units: np.ndarray) -> np.ndarray:
        """The byte place after so many units of each text."""
        place = self.offsets[:-1].copy()
        some = units > 0
        place[some] = self.ends.select((self.first[:-1] + units)[some] - 1) + 1
        return place

    def chars(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Code points between two places."""
        return stop - start - (self.inner.rank(stop) - self.inner.rank(start))


RESULT = "n long, form string, prefix_chars long, middle_chars long, output string"


def _arranged(texts: pa.Array, draws: list[np.ndarray], rate: int, spm: int) -> pa.StructArray:
    """One struct of RESULT for each text; ``draws`` are four numbers for each."""
    data, offsets = utf8(texts)
    units = Units(data, offsets)
    one, two = draws[0] % (units.count + 1), draws[1] % (units.count + 1)
    left, right = units.after(np.minimum(one, two)), units.after(np.maximum(one, two))
    begin, end = offsets[:-1], offsets[1:]
    signs = pc.fill_null(pc.match_substring_regex(texts, SIGNS), False).to_numpy(zero_copy_only=False)
    plain = signs | (begin == end) | (draws[2] % 100 >= rate)
    suffix_first = draws[3] % 100 < spm
    form = np.where(plain, "plain", np.where(suffix_first, "spm", "psm"))
    raw = data.tobytes()
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    output = []
    for a, x, y, b, kind in zip(begin.tolist(), left.tolist(), right.tolist(), end.tolist(), form.tolist()):
        if kind == "plain":
            output.append(raw[a:b])
        elif kind == "spm":
            output.append(b"".join((s, raw[y:b], p, raw[a:x], m, raw[x:y])))
        else:
            output.append(b"".join((p, raw[a:x], s, raw[y:b], m, raw[x:y])))
    columns = [
        pa.array(units.count),
        pa.array(form.tolist(), pa.string()),
        pa.array(units.chars(begin, left), mask=plain),
        pa.array(units.chars(left, right), mask=plain),
        pa.array(output, pa.binary()).cast(pa.string()),
    ]
    return pa.StructArray.from_arrays(columns, ["n", "form", "prefix_chars", "middle_chars", "output"])


def arranged(text: Column, draws: list[Column], rate: int = RATE, spm: int = SPM) -> Column:
    """A struct of RESULT: the number of units, the form, code points of prefix and middle (null if plain), the output.

    ``draws`` are four non-negative longs: the first two choose the cuts, the third whether the text is cut,
    the fourth the form. A null text reads as empty.
    """

    def work(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for texts, *numbers in batches:
            texts = texts.cast(pa.large_string())
            _, offsets = utf8(texts)
            parts, start = [], 0
            while start < len(texts):
                stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + SLICE, side="right")) - 1)
                drawn = [n.slice(start, stop - start).to_numpy(zero_copy_only=False).astype(np.int64) for n in numbers]
                parts.append(_arranged(texts.slice(start, stop - start), drawn, rate, spm))
                start = stop
            empty = pa.array([], pa.struct([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())]))
            yield pa.concat_arrays(parts) if parts else empty

    return F.arrow_udf(work, RESULT)(text, *draws)


def draws_of(key: Column, seed: int = SEED) -> list[Column]:
    """Four numbers of 32 bits from the SHA-256 of ``seed:key``; a null key reads as empty."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    digest = F.sha2(text, 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def restored(output: Column, form: Column) -> Column:
    """The text from which ``output`` was made."""
    part = F.split(output, SIGNS)
    psm = F.concat(F.get(part, 1), F.get(part, 3), F.get(part, 2))
    spm = F.concat(F.get(part, 2), F.get(part, 3), F.get(part, 1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """(doc_id and RESULT) for every row of ``docs`` (doc_id, text); other columns are not read.

    Every row is worked on alone, so repeated rows give equal rows and an empty table none. A null text reads
    as empty, a null doc_id draws as if it were written with no digits. Memory follows SLICE or the longest text.
    """
    rows = docs.select("doc_id", arranged(F.col("text"), draws_of(F.col("doc_id"), seed), rate, spm).alias("f"))
    return rows.select("doc_id", "f.*")
