"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every byte prefix of a piece there is exactly one token that its encoding can end with: the longest token t ending
there such that t and the last token of the prefix before t are a pair that the merges would leave apart. Storing these
last tokens makes encoding linear in the length, an append exact (only the new prefixes are computed) and an edit local
(prefixes before it stand; those behind it are recomputed until they agree with the old ones again).

Texts are split by a pattern first and each match is encoded separately. Space-led words recur, so the codec keeps the
ids of those it has met, in a table of bounded size that starts anew when full: that is speed only, never a result.

Edge cases: null is encoded as the empty text (no ids); special-token strings are ordinary text; texts of any length
are processed whole; bytes that are not UTF-8 decode to U+FFFD before encoding, as the reader of the column would show them.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
from collections.abc import Callable, Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm.common import as_bytes, per_batch, slim, table

#: Entries that a codec keeps of words met before.
MEMORY = 300_000
#: Pairs of tokens that are remembered.
BORDERS = 200_000
#: Pieces up to this many bytes share the table of prefixes.
SHORT = 40
#: A space before which the pattern may not start a new match.
_UNSAFE = re.compile(r" (?:\s|\Z)")


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 token and rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Merges:
    """The merge that makes each token, and which neighbours stay apart."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token_bytes = {n: t for t, n in ranks.items()}
        self.longest = max(map(len, ranks))
        self.reach: dict[bytes, int] = {}  # the longest token that ends with these four bytes (or is these, if shorter)
        for t in ranks:
            self.reach[t[-4:]] = max(self.reach.get(t[-4:], 3), len(t))
        self.borders: dict[tuple[int, int], bool] = {}  # what apart() said, of `most` pairs (speed only)
        self.most = BORDERS
        self.pairs: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for token, n in sorted(ranks.items(), key=lambda x: x[1]):
            self.parts[n] = (n, n)
            if len(token) > 1 and (two := self._halves(token, n)):
                self.parts[n] = two
                self.pairs[two] = n

    def _halves(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one: what merging by lower ranks leaves."""
        at = [token[i : i + 1] for i in range(len(token))]
        while len(at) > 2:
            best, k = min(((self.ranks.get(at[i] + at[i + 1], rank), i) for i in range(len(at) - 1)))
            if best >= rank:
                return None
            at[k : k + 2] = [at[k] + at[k + 1]]
        return self.ranks[at[0]], self.ranks[at[1]]

    def apart(self, left: int, right: int) -> bool:
        """Whether encoding the bytes of left then right gives just these two tokens.

        Undo merges on both sides of the border, latest first, and look for a merge across it that would have come
        before the merge undone last on either side: the idea of public linear-time byte-pair encoders.
        """
        pairs, parts, bound = self.pairs, self.parts, 1 << 60
        while True:
            if pairs.get((left, right), 1 << 60) < bound:
                return False
            if left > right:
                bound, left = left, parts[left][1]
                if left == bound:  # a single byte: go on with the other side
                    bound, right = right + 1, parts[right][0]
                    if right + 1 == bound:
                        return True
            else:
                bound, right = right + 1, parts[right][0]
                if right + 1 == bound:
                    bound, left = left, parts[left][1]
                    if left == bound:
                        return True


    def last(self, data: bytes, end: int, before: Callable[[int], int]) -> int:
        """The last token of data[:end]; before(j) is that of the shorter prefix data[:j]."""
        ranks, borders = self.ranks, self.borders
        for j in range(max(0, end - self.reach.get(data[max(0, end - 4) : end], 3)), end):
            if (s := data[j:end]) in ranks:
                t = ranks[s]
                if not j:
                    return t
                pair = (before(j), t)
                if (fits := borders.get(pair)) is None:
                    if len(borders) > self.most:
                        borders.clear()
                    fits = borders[pair] = self.apart(*pair)
                if fits:
                    return t
        raise ValueError("the vocabulary lacks a single byte")


class PrefixTable:
    """Bytes with the last token of each of their prefixes."""

    def __init__(self, merges: Merges, data: bytes = b""):
        self.merges, self.data, self.last = merges, b"", []
        self.append(data)

    def _last(self, i: int) -> int:
        """The last token of data[: i + 1]."""
        last = self.last
        return self.merges.last(self.data, i + 1, lambda j: last[j - 1])

    def append(self, more: bytes) -> None:
        n = len(self.data)
        self.data += more
        for i in range(n, len(self.data)):
            self.last.append(self._last(i))

    def edit(self, start: int, end: int, new: bytes) -> int:
        """Put new in the place of data[start:end]; returns the number of prefixes that were computed again."""
        old, shift = self.last[end:], len(new) - (end - start)
        self.data = self.data[:start] + new + self.data[end:]
        self.last = self.last[:start]
        same = 0
        for i in range(start, len(self.data)):
            if same >= self.merges.longest:  # all that later prefixes look back at is as it was
                self.last += old[i - shift - end :]
                return i - start
            self.last.append(self._last(i))
            k = i - shift - end
            same = same + 1 if k >= 0 and i - start >= len(new) and old[k] == self.last[i] else 0
        return len(self.data) - start

    def ids(self) -> list[int]:
        out, i = [], len(self.data)
        while i:
            out.append(self.last[i - 1])
            i -= len(self.merges.token_bytes[out[-1]])
        return out[::-1]


class Codec:
    """Encodes and decodes texts. ids are kept as text, joined by one space."""

    def __init__(self, merges: Merges, pattern: str, memory: int = MEMORY):
        self.merges, self.split, self.memory = merges, regex.compile(pattern).findall, memory
        merges.most = min(BORDERS, 2 * memory)
        self.names = {str(n): t for n, t in merges.token_bytes.items()}
        self.pieces: dict[str, str] = {}
        self.spaced: dict[str, str] = {}
        self.before: dict[str, str] = {}  # the last table that was full
        self.prefixes: dict[bytes, int] = {}

    def _piece(self, piece: str) -> str:
        data = piece.encode()
        if (t := self.merges.ranks.get(data)) is not None:
            return str(t)
        if len(data) > SHORT:
            return " ".join(map(str, PrefixTable(self.merges, data).ids()))
        known = self.prefixes
        if len(known) > 2 * self.memory:
            known.clear()
        end = len(data)
        while end and data[:end] not in known:
            end -= 1
        while end < len(data):
            end += 1
            known[data[:end]] = self.merges.last(data, end, lambda j: known[data[:j]])
        out = []
        while end:
            t = known[data[:end]]
            out.append(str(t))
            end -= len(self.merges.token_bytes[t])
        return " ".join(out[::-1])

    def _pieces(self, text: str) -> str:
        known, out = self.pieces, []
        if len(known) > self.memory:
            known.clear()
        for p in self.split(text):
            if (x := known.get(p)) is None:
                x = known[p] = self._piece(p)
            out.append(x)
        return " ".join(out)

    def encode(self, text: str) -> str:
        if _UNSAFE.search(text):
            return self._pieces(text)
        # every space starts a new match here, so that each space-led word can be encoded on its own
        spaced = self.spaced
        head, *words = text.split(" ")
        if len(spaced) > self.memory:
            self.before, self.spaced = spaced, {}
            spaced = self.spaced
        out = [self._pieces(head)] if head else []
        try:
            out += [spaced[w] for w in words]
        except KeyError:
            for w in words:
                if w not in spaced:
                    spaced[w] = self.before.get(w) or self._pieces(" " + w)
            out += [spaced[w] for w in words]
        return " ".join(out)

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.names.__getitem__, ids.split(" "))) if ids else b""


@lru_cache(maxsize=2)
def _merges(path: str) -> Merges:
    return Merges(read_ranks(path))


def _codec_maker(spark: SparkSession, path: str, pattern: str, memory: int = MEMORY) -> Callable[[], Codec]:
    """A function that gives the codec of a Python worker. The driver reads the rank file; its tables are broadcast (fixed size)."""
    sent = spark.sparkContext.broadcast(_merges(path))
    held: list[Codec] = []

    def codec() -> Codec:
        if not held:
            held.append(Codec(sent.value, pattern, memory))
            gc.set_threshold(1_000_000)  # large tables without cycles: collecting them over and over finds nothing
        return held[0]

    return codec


def _texts(column: pa.Array) -> Iterable[str]:
    return ("" if t is None else t.decode("utf-8", "replace") for t in as_bytes(column))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", memory: int = MEMORY) -> DataFrame:
    """id and `ids` (array<int>) of every row. memory: words that a task remembers."""
    codec = _codec_maker(docs.sparkSession, path, pattern, memory)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec()
        ids = [np.array(s.split(" "), np.int32) if (s := c.encode(t)) else np.empty(0, np.int32) for t in _texts(batch.column(1))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], [id_col, "ids"])

    return per_batch(slim(docs, id_col, text_col), run, f"`{id_col}` {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """id and `data` (binary: bytes need not be whole characters) of every row of ids."""
    codec = _codec_maker(encoded.sparkSession, path, pattern)
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        names = codec().merges.token_bytes
        data = [b"".join(map(names.__getitem__, ids or ())) for ids in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], [id_col, "data"])

    return per_batch(slim(encoded, id_col, "ids"), run, f"`{id_col}` {kind}, data binary")


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every row, decode the ids again, and return id, n_tokens and the digests of ids and decoded bytes."""
    codec = _codec_maker(docs.sparkSession, path, pattern)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c, n, a, b = codec(), [], [], []
        for t in _texts(batch.column(1)):
            ids = c.encode(t)
            n.append(ids.count(" ") + 1 if ids else 0)
            a.append(hashlib.sha256(ids.encode()).hexdigest())
            b.append(hashlib.sha256(c.decode(ids)).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return per_batch(slim(docs, id_col, text_col), run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", memory: int = MEMORY) -> DataFrame:
    """Encode every row, decode the ids again, and return id, n_tokens, ids (array<int>) and the digest of the decoded bytes."""
    codec = _codec_maker(docs.sparkSession, path, pattern, memory)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c, ids, digest = codec(), [], []
        for t in _texts(batch.column(1)):
            s = c.encode(t)
            ids.append(np.array(s.split(" "), np.int32) if s else np.empty(0, np.int32))
            digest.append(hashlib.sha256(c.decode(s)).hexdigest())
        n = pa.array([len(x) for x in ids], pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0), n, pa.array(ids, pa.list_(pa.int32())), pa.array(digest, pa.string())], [id_col, "n_tokens", "ids", "decoded_sha256"])

    return per_batch(slim(docs, id_col, text_col), run, f"`{id_col}` {kind}, n_tokens long, ids array<int>, decoded_sha256 string")


def public_vocabulary() -> tuple[str, str]:
    """Path of the ranks and pattern that the query uses."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: every text of `documents`, encoded and decoded."""
    return digests(table(spark, sf_dir, "documents"), *public_vocabulary())
