"""Byte-level BPE by prefix dynamic programming.

For every byte prefix of a piece there is exactly one token that can end its
encoding. A table holds that token per prefix, so the encoding of any prefix is
read off backwards, appended bytes only add entries, and an edit only changes
entries from its place until they agree with the old ones again.

Nulls and empty texts have no tokens and decode to no bytes. Rows are
independent, so ties and repeated rows need no rule. A text of any length is
encoded piece by piece; an empty table gives an empty result. Other columns are
kept; one named like the result is replaced.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable, Iterator
from hashlib import sha256
from itertools import chain
from math import inf

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import column, map_batches, ship, texts_of

#: Bounds of what a worker remembers; speed only, never results. Two caches of two generations hold CACHED bytes each at most, and
#: PAIRS told pairs take 160 bytes each. On prose a worker grows by some 100 MB beside the vocabulary's 85.
CACHED = 80_000_000
PAIRS = 250_000

#: Fixed value: the usual pattern of byte-level vocabularies.
WORDWISE = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_BLANKS = [c for c in map(chr, range(0x3001)) if regex.match(r"\s", c)]
_RUNS = sorted({pair for c in _BLANKS for pair in (" " + c, c + " ")})


class Vocabulary:
    """Ranks of byte strings, and which pairs of tokens can stand side by side."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            self.bytes[rank] = piece
        self.longest = max(map(len, ranks))
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._right: dict[int, list[tuple[bytes, float]]] = {}
        self._left: dict[int, list[tuple[bytes, float]]] = {}
        self.known: dict[tuple[int, int], bool] = {}

        # Tokens that end at each byte are told by one automaton, the longest first; bytes stand as characters.
        self.automaton = ahocorasick.Automaton()
        for piece, rank in ranks.items():
            self.automaton.add_word(piece.decode("latin-1"), (rank, len(piece)))
        self.automaton.make_automaton()

    def endings(self, piece: bytes, begin: int) -> Iterator[tuple[int, tuple[int, int]]]:
        """(index of the last byte, (token, its length)) of the tokens in piece that end behind ``begin`` bytes, by end and then the longest first."""
        first = max(0, begin - self.longest)
        found = self.automaton.iter(piece[first:].decode("latin-1"))
        return found if not begin else ((first + at, x) for at, x in found if first + at >= begin)

    @classmethod
    def from_tiktoken(cls, raw: bytes) -> Vocabulary:
        return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a})

    def merge(self, piece: bytes, below: float = inf) -> list[bytes]:
        """Plain merging of the lowest rank first, of ranks under ``below``."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(parts[k] + parts[k + 1], inf), k) for k in range(len(parts) - 1))
            if rank >= below:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for bytes and for tokens that merging never makes."""
        if token not in self._halves:
            parts = self.merge(self.bytes[token], token)
            self._halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self._halves[token]

    def made(self, token: int) -> bool:
        return len(self.bytes[token]) == 1 or self.halves(token) is not None

    def _spine(self, token: int, side: int) -> list[tuple[bytes, float]]:
        """Outermost parts at one side as merging goes on, each with the rank of the merge that takes it in."""
        known = self._right if side else self._left
        if token not in known:
            out, at, taken = [], token, inf
            while True:
                out.append((self.bytes[at], taken))
                if (h := self.halves(at)) is None:
                    break
                at, taken = h[side], at
            known[token] = out[::-1]
        return known[token]

    def fits(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a and b gives just these two tokens: no merge across the border comes in time. a is -1 for no bytes."""
        if (told := self.known.get((a, b))) is not None:
            return told
        if len(self.known) > PAIRS:
            self.known.clear()
        if a < 0:
            self.known[a, b] = out = self.made(b)
            return out
        left, right = self._spine(a, 1), self._spine(b, 0)
        i = j = 0
        while True:
            (x, x_taken), (y, y_taken) = left[i], right[j]
            across = self.ranks.get(x + y, inf)
            if across < x_taken and across <= y_taken:
                out = False
                break
            if x_taken == y_taken == inf:
                out = True
                break
            if x_taken <= y_taken:
                i += 1
            else:
                j += 1
        self.known[a, b] = out
        return out


class PrefixTable:
    """The last token of each prefix of a growing byte string."""

    def __init__(self, vocabulary: Vocabulary, piece: bytes = b""):
        self.v = vocabulary
        self.piece = b""
        self.last: list[int] = [-1]
        self.append(piece)

    def _grow(self, begin: int, stop: Callable[[int], bool] | None = None) -> None:
        """Appends the entries of the prefixes longer than ``begin`` bytes, up to the one whose length stops it."""
        last, fits = self.last, self.v.fits
        known = self.v.known.get
        end = begin
        for at, (token, length) in self.v.endings(self.piece, begin):
            if at != end:
                if at > end:
                    break
                continue
            before = last[end + 1 - length]
            if (good := known((before, token))) is None:
                good = fits(before, token)
            if good:
                last.append(token)
                end += 1
                if stop and stop(end):
                    return
        if end < len(self.piece):
            raise ValueError(f"byte {self.piece[end]} is in no token")

    def append(self, more: bytes) -> None:
        at, self.piece = len(self.piece), self.piece + more
        self._grow(at)

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Put new for the bytes from start to stop; returns how many entries were computed."""
        old, tail = self.last, len(self.piece) - stop
        self.piece = self.piece[:start] + new + self.piece[stop:]
        self.last = old[: start + 1]
        same = done = 0

        def settled(end: int) -> bool:
            nonlocal same, done
            rest, done = len(self.piece) - end, end
            # A later entry looks back at most the longest token's length.
            same = same + 1 if rest < tail and self.last[-1] == old[len(old) - 1 - rest] else 0
            return same >= self.v.longest and rest > 0

        self._grow(start, settled)
        if rest := len(self.piece) + 1 - len(self.last):
            self.last += old[len(old) - rest :]
            return done - start
        return len(self.piece) - start

    def tokens(self, end: int | None = None) -> list[int]:
        at, out = len(self.piece) if end is None else end, []
        while at:
            out.append(self.last[at])
            at -= len(self.v.bytes[out[-1]])
        return out[::-1]


class Cache:
    """Encodings of chunks in two generations, bounded in bytes: the older is dropped when the newer is full."""

    def __init__(self, make):
        self.make = make
        self.size = 0
        self.new: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def all(self, chunks: list[str]) -> list[int]:
        found = list(map(self.new.get, chunks))
        if None in found:
            one = self.one
            found = [one(chunk) if ids is None else ids for chunk, ids in zip(chunks, found)]
        return list(chain.from_iterable(found))

    def one(self, chunk: str) -> tuple[int, ...]:
        if (ids := self.new.get(chunk)) is not None:
            return ids
        if (ids := self.old.get(chunk)) is None:
            ids = tuple(self.make(chunk))
        if len(chunk) <= 64:
            # A slot, the headers of a string and a tuple, and what they hold; ids are the vocabulary's own numbers.
            self.size += 210 + 4 * len(chunk) + 8 * len(ids)
            if self.size > CACHED:
                self.old, self.new, self.size = self.new, {}, 0
            self.new[chunk] = ids
        return ids


class Encoder:
    """Encodes texts: a pattern cuts pieces, the prefix table encodes each."""

    def __init__(self, raw: bytes, pattern: str):
        self.v = Vocabulary.from_tiktoken(raw)
        self.cut = regex.compile(pattern).findall
        self.pieces = Cache(self.piece)
        # Chunks are told apart by words only if the pattern is the one for which that holds.
        self.by_words = pattern == WORDWISE
        self.words = Cache(self.word)

    def word(self, word: str) -> list[int]:
        """The ids of a space and a word; a first piece that begins with the space is itself such a word."""
        first, *more = self.cut(" " + word)
        if not more:
            return self.piece(first)
        return [*(self.words.one(first[1:]) if first[0] == " " and len(first) > 1 else self.pieces.one(first)), *self.pieces.all(more)]

    def piece(self, piece: str) -> list[int]:
        raw = piece.encode()
        whole = self.v.ranks.get(raw)
        return [whole] if whole is not None else PrefixTable(self.v, raw).tokens()

    def encode(self, text: str) -> array:
        """The ids of all pieces.

        With the pattern WORDWISE, a space between two characters that are no
        white space always begins a piece, so what follows it up to the next
        such space is encoded alone and kept. A text in which a space stands
        beside other white space, or at the end, is cut as a whole.
        """
        if not self.by_words or text[-1:] == " " or any(run in text for run in _RUNS):
            return array("I", self.pieces.all(self.cut(text)))
        first, *words = text.split(" ")
        return array("I", self.pieces.all(self.cut(first)) + self.words.all(words))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.v.bytes.__getitem__, ids))


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(raw: bytes, pattern: str) -> Encoder:
    """One encoder per vocabulary and Python worker."""
    key = (sha256(raw).hexdigest(), pattern)
    if key not in _encoders:
        _encoders[key] = Encoder(raw, pattern)
    return _encoders[key]


def load(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _held(spark: SparkSession, path: str):
    """The vocabulary file as a broadcast: its size is that of the file, whatever the data."""
    ship(spark)
    return spark.sparkContext.broadcast(load(path))


def encode_column(df: DataFrame, path: str, pattern: str, text: str = "text", into: str = "ids") -> DataFrame:
    """Adds the token ids of the text."""
    held = _held(df.sparkSession, path)

    @F.arrow_udf("array<int>")
    def ids(a: pa.Array) -> pa.Array:
        e = encoder(held.value, pattern)
        flat, ends = array("I"), array("i", [0])
        for t in a:
            flat += e.encode(t.as_py() or "")
            ends.append(len(flat))
        # Ids stay numbers of four bytes on their way; the arrays are read in place.
        return pa.ListArray.from_arrays(pa.array(np.frombuffer(ends, np.int32)), pa.array(np.frombuffer(flat, np.int32)))

    return df.withColumn(into, ids(df[text]))


def decode_column(df: DataFrame, path: str, pattern: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Adds the bytes of the token ids; null ids give no bytes."""
    held = _held(df.sparkSession, path)

    @F.arrow_udf("binary")
    def raw(a: pa.Array) -> pa.Array:
        e = encoder(held.value, pattern)
        return pa.array([e.decode(x or ()) for x in a.to_pylist()], pa.binary())

    return df.withColumn(into, raw(df[ids]))


DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def token_digest(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per text: the number of tokens, the digest of the ids, and that of the bytes decoded from them."""
    held = _held(df.sparkSession, path)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        e = encoder(held.value, pattern)
        n, a, b = [], [], []
        for text in texts_of(batch, "text"):
            ids = e.encode(text)
            n.append(len(ids))
            a.append(sha256(ids.tobytes()).hexdigest())
            b.append(sha256(e.decode(ids)).hexdigest())
        cols = [column(batch, "doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
        return pa.RecordBatch.from_arrays(cols, [f.split()[0] for f in DIGEST.split(", ")])

    return map_batches(df.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, DIGEST)
