"""Byte-level BPE encoding and decoding.

Encoder: the merges are compiled, as far as texts need them, into a finite-state transducer. A string of tokens is
what the merges make of its bytes exactly when each token is what they make of its own bytes, and each
two neighbours are what they make of theirs. So every prefix has one encoding; its last token is the one
that may follow the encoding of the bytes before it. The machine gives that last token at every byte.

A place is a start from which a token may still go on, with what the token before it bars; places move on bytes by
themselves. A state is the set of open places. Places, states and steps are made when first met and kept, up to
a bound on their number; beyond it the machine starts afresh, with the same results. A token is
final as soon as the encodings up to all open places have it; no open place lies further back than the longest
token, and their encodings soon agree. Every LOOK bytes the tokens that are final are given and forgotten.

Decoder: bytes of tokens go through a UTF-8 state machine that holds back an unfinished character.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import cache
from unicodedata import category

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memspark.llm.chunks import Memory, pack_ids
from memspark.llm.memory import tidy
from memspark.llm.words import slices

STEPS = 150_000  # steps kept by a transducer
LOOK = 4096  # bytes after which the tokens that are final are read off
PARTS = 150_000  # parts of texts in each half of what a codec holds
SLICE = 4 << 20  # bytes of text that are cut at once, about; words recur in it, so smaller ones take longer
CODED_SLICE = 2 << 20  # bytes of text whose ids leave a task together, about


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and their ranks from a file of base64 tokens and numbers."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class Place:
    """Where a token may go on: the bytes since its start, and what may not follow the token before it.

    ``barred`` has (part, rank): a token is barred when that part stands at its left end at that rank.
    """

    __slots__ = ("since", "barred", "moves")

    def __init__(self, since: bytes, barred: tuple[tuple[bytes, int], ...]):
        self.since, self.barred = since, barred
        self.moves: dict[int, tuple[Place | None, int | None]] = {}


class State(dict):
    """Steps made so far: byte -> (next state, last token of the encoding up to and with this byte)."""

    __slots__ = ("places",)


class Transducer:
    """Bytes of one piece of text in, token ids out."""

    def __init__(self, ranks: dict[bytes, int], steps: int = STEPS):
        self.ranks, self.limit = ranks, steps
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.longer = {token[:i] for token in ranks for i in range(1, len(token))}
        self.after: dict[bytes, list[tuple[bytes, int]]] = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                if token[:i] in ranks and token[i:] in ranks:
                    self.after.setdefault(token[:i], []).append((token[i:], rank))
        self.edges: dict[int, tuple[list, list] | None] = {}
        self._clear()

    def _clear(self) -> None:
        self.places: dict[tuple, Place] = {}
        self.fresh: dict[int, Place] = {}
        self.states: dict[tuple, State] = {}
        self.made = 0
        self.start = self._state((self._place(b"", ()),))

    def _place(self, since: bytes, barred: tuple) -> Place:
        place = self.places.get((since, barred))
        if place is None:
            place = self.places[since, barred] = Place(since, barred)
        return place

    def _state(self, places: tuple[Place, ...]) -> State:
        state = self.states.get(places)
        if state is None:
            state = self.states[places] = State()
            state.places = places
        return state

    def merged(self, data: bytes, parts_left: int = 1) -> list[bytes]:
        """The encoding by the definition: join the neighbours of the lowest rank, the first ones first."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > parts_left:
            rank, i = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _edge(self, token: int) -> tuple[dict, dict] | None:
        """The parts that stand at the left and at the right end of a token while its bytes are merged, with the
        rank at which each is merged away. None for a token that the merges never make."""
        if token not in self.edges:
            data = self.bytes_of[token]
            if self.merged(data) != [data]:
                self.edges[token] = None
            elif len(data) == 1:
                self.edges[token] = {data: 1 << 60}, {data: 1 << 60}
            else:
                ends = [(part, self._edge(self.ranks[part])[side]) for side, part in enumerate(self.merged(data, 2))]
                self.edges[token] = tuple(end | {part: token, data: 1 << 60} for part, end in ends)
        return self.edges[token]

    def _after(self, token: int) -> Place:
        """The place right behind a token.

        A merge joins two tokens when both parts are there at its rank. At equal ranks the place further
        left goes first: the merge inside the first token, the joining one before that inside the second.
        """
        place = self.fresh.get(token)
        if place is None:
            barred: dict[bytes, int] = {}
            for part, end in self._edge(token)[1].items():
                for other, rank in self.after.get(part, ()):
                    if rank < end and rank < barred.get(other, 1 << 60):
                        barred[other] = rank
            place = self.fresh[token] = self._place(b"", tuple(sorted(barred.items())))
        return place

    def _move(self, place: Place, byte: int) -> tuple[Place | None, int | None]:
        """The same place one byte later, if some token is longer, and the token that may end here."""
        since = place.since + bytes((byte,))
        token, onward = self.ranks.get(since), None
        barred = tuple([p for p in place.barred if p[0].startswith(since) or since.startswith(p[0])])
        if token is not None:
            edge = self._edge(token)
            if edge is None or any(edge[0].get(part, -1) >= rank for part, rank in barred):
                token = None
        if since in self.longer:
            onward = self._place(since, barred)
        place.moves[byte] = onward, token
        return onward, token

    def _step(self, state: State, byte: int) -> tuple[State, int]:
        places, ended = [], None
        for place in state.places:
            onward, token = place.moves.get(byte) or self._move(place, byte)
            if onward is not None:
                places.append(onward)
            if token is not None:
                ended = token  # of one place only, as a prefix has one encoding
        places.append(self._after(ended))
        return self._state(tuple(places)), ended

    def encode(self, data: bytes) -> list[int]:
        """Token ids of one piece."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        out: list[int] = []
        last, state, look = [], self.start, LOOK
        for byte in data:
            step = state.get(byte)
            if step is None:
                if self.made >= self.limit:
                    here = state.places
                    self._clear()
                    state = self._state(here)
                step = state[byte] = self._step(state, byte)
                self.made += 1
            state, token = step
            last.append(token)
            if len(last) >= look:
                final = self._final(state, last)
                out += self._chain(last[:final])
                del last[:final]
                look = len(last) + LOOK
        return out + self._chain(last)

    def _final(self, state: State, last: list[int]) -> int:
        """The last place that the encodings up to all open places go through."""
        ends = {len(last) - len(place.since) for place in state.places}
        while len(ends) > 1:
            furthest = max(ends)
            ends.remove(furthest)
            ends.add(furthest - len(self.bytes_of[last[furthest - 1]]))
        return ends.pop()

    def _chain(self, last: list[int]) -> list[int]:
        """The tokens that end at the last byte, from the last token at each byte."""
        tokens, at, length = [], len(last), self.bytes_of
        while at:
            token = last[at - 1]
            tokens.append(token)
            at -= len(length[token])
        tokens.reverse()
        return tokens


# The letters and numbers that Unicode 16.0 added to Unicode 15.1, as hexadecimal ranges. The patterns of the
# public vocabularies are read by the tables of Unicode 16.0.
ADDED = {
    "L": "1C89-1C8A A7CB-A7CD A7DA-A7DC 105C0-105F3 10D4A-10D65 10D6F-10D85 10EC2-10EC4 11380-11389 1138B 1138E 11390-113B5 "
    "113B7 113D1 113D3 11BC0-11BE0 13460-143FA 16100-1611D 16D40-16D6C 18CFF 1E5D0-1E5ED 1E5F0",
    "N": "10D40-10D49 116D0-116E3 11BF0-11BF9 16130-16139 16D70-16D79 1CCF0-1CCF9 1E5F1-1E5FA",
}


@cache
def members(kind: str) -> np.ndarray:
    """For each code point whether it is a letter ("L") or a number ("N"); surrogates are neither."""
    out = np.fromiter((category(chr(c))[0] == kind for c in range(0x110000)), bool, 0x110000)
    for part in ADDED[kind].split():
        first, _, last = part.partition("-")
        out[int(first, 16) : int(last or first, 16) + 1] = True
    return out


def _ranges(inside: np.ndarray) -> str:
    """The marked code points as the inner part of a character class."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], inside.astype(np.int8), [0]])))
    return "".join(f"\\U{a:08X}-\\U{b - 1:08X}" for a, b in edges.reshape(-1, 2).tolist())


@cache
def compiled(pattern: str) -> regex.Pattern:
    r"""A pattern whose \p{L} and \p{N} are ``members``, whatever tables the regex package has."""
    points = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind in ADDED:
        name = rf"\p{{{kind}}}"
        found = np.zeros(0x110000, bool)
        found[[ord(c) for c in regex.findall(name, points)]] = True
        ours = members(kind)
        more, less = _ranges(ours & ~found), _ranges(found & ~ours)
        own = f"[{name}--[{less}]]" if less else name
        pattern = pattern.replace(name, f"[{own}||[{more}]]" if more else own)
    return regex.compile(pattern, regex.V1)


class Codec:
    """Texts to ids and back for one file of ranks and one pattern of pieces."""

    def __init__(self, path: str, pattern: str):
        self.transducer = Transducer(read_ranks(path))
        self.pieces = compiled(pattern)
        self.parts = Memory(lambda parts: [self._part(part) for part in parts], PARTS)
        self.vocabulary = self.transducer.bytes_of

    def _part(self, part: str) -> bytes:
        ids: list[int] = []
        word = part[1:] if part[:1] == " " else part
        # a word, or a word with a comma or full stop, is split by the pattern as follows;
        # what Python knows as letters are letters in the pattern as well
        if word.isalpha():
            pieces = [part]
        elif word[-1:] in (",", ".") and word[:-1].isalpha():
            pieces = [part[:-1], part[-1]]
        else:
            pieces = self.pieces.findall(part)
        for piece in pieces:
            ids += self.transducer.encode(piece.encode())
        return pack_ids(ids)

    def encode_all(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text, 32 bits each; none for null."""
        for rows in slices(pa.record_batch([texts], ["text"]), "text", SLICE):
            ids, starts = self.parts.ids(rows.column(0))
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
                yield ids[a:b]

    def encode(self, text: str) -> np.ndarray:
        """Ids of one text."""
        return next(self.encode_all(pa.array([text], pa.string())))

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """The text in parts; each part ends with a whole character."""
        machine, vocabulary = Utf8(), self.vocabulary
        ids = ids if isinstance(ids, np.ndarray) else np.fromiter(ids, np.uint32)
        for at in range(0, len(ids), 4096):
            yield machine.feed(b"".join([vocabulary[i] for i in ids[at : at + 4096].tolist()]))
        yield machine.end()


class Utf8:
    """Decodes bytes as they come. State: the bytes of an unfinished character, how many are
    missing, and the range of the next one. Faulty bytes read as U+FFFD."""

    def __init__(self):
        self.held, self.missing, self.low, self.high = b"", 0, 0x80, 0xBF

    def _lead(self, byte: int) -> None:
        """Begin a character of two to four bytes; any other byte needs nothing more."""
        self.missing = 1 if 0xC2 <= byte <= 0xDF else 2 if 0xE0 <= byte <= 0xEF else 3 if 0xF0 <= byte <= 0xF4 else 0
        self.low = {0xE0: 0xA0, 0xF0: 0x90}.get(byte, 0x80)
        self.high = {0xED: 0x9F, 0xF4: 0x8F}.get(byte, 0xBF)

    def feed(self, data: bytes) -> str:
        """The characters that are whole with these bytes."""
        data, self.held, self.missing = self.held + data, b"", 0
        first = len(data)
        for back in range(1, min(3, len(data)) + 1):  # an unfinished character is at most 3 bytes
            if data[-back] >= 0xC0:
                first = len(data) - back
                break
            if data[-back] < 0x80:
                break
        for i in range(first, len(data)):
            if i == first:
                self._lead(data[i])
            elif self.missing and self.low <= data[i] <= self.high:
                self.missing, self.low, self.high = self.missing - 1, 0x80, 0xBF
            else:
                self.missing = 0
        if self.missing:
            data, self.held = data[:first], data[first:]
        return data.decode("utf-8", "replace")

    def end(self) -> str:
        """What is left at the end of the input."""
        data, self.held, self.missing = self.held, b"", 0
        return data.decode("utf-8", "replace")


@cache
def codec(path: str, pattern: str) -> Codec:
    """One codec for each process."""
    return Codec(path, pattern)


def encode(text: Column, path: str, pattern: str) -> Column:
    """Ids of a text as an array of ints. Null gives an empty array."""

    @tidy
    def work(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(path, pattern)
        for column in texts:
            ids = list(own.encode_all(column))
            offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
            flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))

    return F.arrow_udf(work, "array<int>").asNondeterministic()(text)


def decode(ids: Column, path: str, pattern: str) -> Column:
    """The text of an array of ids; null gives null."""

    @tidy
    def work(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(path, pattern)
        for column in columns:
            yield pa.array([None if i is None else "".join(own.decode(i)) for i in column.to_pylist()], pa.string())

    return F.arrow_udf(work, "string").asNondeterministic()(ids)


DIGEST = "n_tokens long, ids_sha256 string, decoded_sha256 string"
CODED = DIGEST + ", ids array<int>"


_CODED = ["n_tokens", "ids_sha256", "decoded_sha256", "ids"]


def _coded(own: Codec, texts: pa.Array, with_ids: bool = True) -> list[pa.Array]:
    """The columns of CODED, or without the ids those of DIGEST."""
    counts, encoded, decoded, kept = [], [], [], []
    for ids in own.encode_all(texts):
        counts.append(len(ids))
        encoded.append(hashlib.sha256(ids.tobytes()).hexdigest())
        back = hashlib.sha256()
        for part in own.decode(ids):
            back.update(part.encode())
        decoded.append(back.hexdigest())
        if with_ids:
            kept.append(ids)
    columns = [pa.array(counts, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())]
    if with_ids:
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        flat = np.concatenate(kept).view(np.int32) if kept else np.zeros(0, np.int32)
        columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)))
    return columns


def digest(text: Column, path: str, pattern: str) -> Column:
    """Encode a text, decode its ids, and return what identifies both: a struct of DIGEST.

    Null counts as the empty text. Every row is worked on alone.
    """

    @tidy
    def work(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(path, pattern)
        for column in texts:
            yield pa.StructArray.from_arrays(_coded(own, column, with_ids=False), _CODED[:3])

    return F.arrow_udf(work, DIGEST).asNondeterministic()(text)


def coded(text: Column, path: str, pattern: str) -> Column:
    """``digest`` with the ids themselves: a struct of CODED."""

    @tidy
    def work(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(path, pattern)
        for column in texts:
            yield pa.StructArray.from_arrays(_coded(own, column), _CODED)

    return F.arrow_udf(work, CODED).asNondeterministic()(text)


def coded_rows(rows: DataFrame, text: str, path: str, pattern: str) -> DataFrame:
    """``rows`` with the columns of ``coded`` in place of ``text``.

    A batch leaves in parts of about CODED_SLICE bytes of text, so neither all its ids nor copies of its rows are held.
    """
    others = [f for f in rows.schema.fields if f.name != text]

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for part in slices(batch, text, CODED_SLICE):
                columns = [part.column(f.name) for f in others] + _coded(own, part.column(text))
                yield pa.RecordBatch.from_arrays(columns, [*[f.name for f in others], *_CODED])

    schema = T.StructType([*others, *T.StructType.fromDDL(CODED).fields])
    return rows.mapInArrow(work, schema)
