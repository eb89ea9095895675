"""N-gram Jaccard self-join over a count-vector R-tree.

A text is the set of its 5-word shingles. Hashing the shingles into groups and counting them gives a point; the sum of the
coordinate-wise minima of two points bounds the overlap of the two sets from above, and the minima with a box's upper
corner bound it for all points of the box. Texts link when 7 * overlap >= 3 * (size + size), which is Jaccard >= 0.75.

The tree is distributed. Its upper level fans out by shingle: two linked sets share one of the first
n - ceil(0.75 n) + 1 shingles of each in any common order, so a point belongs to the regions of these shingles only, and every
linked pair meets in a region. The order is by frequency, rare shingles first, so that common passages make few and small
regions: every shingle of every text is counted in a table of 2**BITS cells (a fixed size), whose levels are sent to all
tasks. Shingles that share a cell only come later than they could, so the order costs no link. A place in that order
bounds the overlap, too: what comes before the common shingle in one set and what comes behind it in the other is not shared.
Most shingles of prefixes are in one text only; a first pass sends 32 bits of each and gives a table of bits, so that only those that
two texts have, and a few more, are sent with the number of their set. Regions with the same members are one region. Below, each region has an R-tree of its own, joined with itself by pruning pairs of boxes.

Copies count once: texts with the same set are one point. Groups of near copies do not become pairs either: first every region links its
members to one of them (a round, followed by connected components), then only members of different
components are compared, so a region whose members are all connected is never entered. Of these comparisons no table of pairs is made,
as it would grow with the square of a group: a tree names the members that have a candidate, each pair in the first region that both share,
then the whole sets of these members meet in their region, which compares them and gives the links that connect components, fewer than it has
members. The result is exact: a pair of different components that could link is compared until its components are one, and sets are told
apart by 128 bits (by 64 in the rounds, after those that clash there have been given other numbers).

Edge cases: null texts and texts without words have no shingles and link with nothing; fewer than five words are one
shingle; repeated rows and copies share a component; a null id takes part but is no component's name unless all its ids are null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm.common import arrow, as_bytes, if_small, materialize, mix64, scratch, slim, small_batches, table
from tagloom.llm.components import relabel
from tagloom.llm.rolling import Rolling

N = 5
#: Groups of a point, see point().
LEAST_GROUPS, MOST_GROUPS, PER_GROUP, FEW = 64, 1 << 16, 8, 512
LISTED, COUNTED = b"l", b"c"
#: Cells of the table of frequencies, as a power of two; parts in which it is summed; levels of a doubling.
BITS, PARTS, LEVELS = 22, 64, 4
LEAF, MANY, ROUNDS, MEMORY = 48, 40, 1, 500_000
#: Counts that a tree may hold at once.
CELLS = 4_000_000
#: Regions of a point by which trees see that a pair meets elsewhere, too; shingles of a block of a region, two of which meet in a task.
LEAST, HELD = 8, 4_000_000
#: Bits of the table of keys that two texts have, as a power of two at most; keys that a task sorts at once.
MOST_BITS, SORTED = 29, 1 << 20
#: Fixed odd factors that tell a shingle's places apart.
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


_IS_SPACE = np.isin(np.arange(256), list(b"\x20\x09\x0a\x0b\x0c\x0d"))
_ROLL = Rolling()


def shingles(text: bytes | None) -> np.ndarray:
    """The set of a text: ascending 64-bit hashes of its different shingles."""
    data = np.frombuffer(text.lower() if text else b"", np.uint8)
    edge = np.flatnonzero(np.diff(_IS_SPACE[data], prepend=True, append=True))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.empty(0, np.uint64)
    h = mix64(_ROLL.parts(_ROLL.sums(data), start, end) + (end - start).astype(np.uint64))
    n = min(N, len(h))
    s = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        s += h[k : len(h) - n + 1 + k] * FACTORS[k]
    return np.unique(mix64(s))


def set_id(s: np.ndarray) -> tuple[int, int]:
    """128 bits, as two numbers."""
    d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


class Names:
    """The number of a set in the rounds: its first 64 bits, or the other 64 where the first ones are those of several sets."""

    def __init__(self, clashes: frozenset[int] = frozenset()):
        self.clashes = clashes

    def of(self, s: np.ndarray) -> int:
        first, other = set_id(s)
        return other if first in self.clashes else first


def point(s: np.ndarray) -> bytes:
    """The point of a set: LEAST_GROUPS counts, and the finer groups that its size asks for.

    A group is the hash's upper bits, so counts of fewer groups are sums of neighbours. Up to FEW shingles the finer groups
    are the MOST_GROUPS ones, written as a list of differences, lower bytes first, from which the counts follow; above, they
    are counts of about a group for PER_GROUP shingles, behind the others.
    """
    fine = (s >> np.uint64(48)).astype(np.uint16)
    if len(s) <= FEW:
        return LISTED + np.diff(fine, prepend=np.uint16(0)).view(np.uint8).reshape(-1, 2).T.tobytes()
    low = np.bincount(fine >> 10, minlength=LEAST_GROUPS).astype(np.uint32)
    groups = min(MOST_GROUPS, 1 << ((len(s) - 1) // PER_GROUP).bit_length())
    fine = np.bincount(fine // (MOST_GROUPS // groups), minlength=groups).astype(np.uint16 if len(s) < MOST_GROUPS else np.uint32)
    return COUNTED + low.tobytes() + fine.tobytes()


class Point:
    """A point that was read: n, low (counts of LEAST_GROUPS), and fine: a list of groups or counts."""

    def __init__(self, data: bytes):
        self.listed = data[:1] == LISTED
        if self.listed:
            steps = np.frombuffer(data, np.uint8, offset=1).reshape(2, -1).T.copy().view(np.uint16).ravel()
            self.n, self.fine = len(steps), np.cumsum(steps, dtype=np.uint16)
            self.low = np.bincount(self.fine >> 10, minlength=LEAST_GROUPS).astype(np.uint32)
        else:
            self.low = np.frombuffer(data, np.uint32, LEAST_GROUPS, offset=1)
            self.n = int(self.low.sum())
            self.fine = np.frombuffer(data, np.uint32 if self.n >= MOST_GROUPS else np.uint16, offset=1 + 4 * LEAST_GROUPS)

    def counts(self, groups: int) -> np.ndarray:
        if self.listed:
            return np.bincount(self.fine // (MOST_GROUPS // groups), minlength=groups)
        return self.fine.astype(np.int64).reshape(groups, -1).sum(1)


def could_link(a: Point, b: Point) -> bool:
    """Whether the minima of the finest groups that both have allow a link."""
    if a.listed and b.listed:
        x, i = np.unique(a.fine, return_counts=True)
        y, j = np.unique(b.fine, return_counts=True)
        _, u, v = np.intersect1d(x, y, assume_unique=True, return_indices=True)
        shared = np.minimum(i[u], j[v]).sum()
    else:
        groups = min(MOST_GROUPS if p.listed else len(p.fine) for p in (a, b))
        shared = np.minimum(a.counts(groups), b.counts(groups)).sum()
    return 7 * int(shared) >= 3 * (a.n + b.n)


def prefix(s: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The first n - ceil(0.75 n) + 1 shingles by level, then by hash."""
    n = len(s) - -(-3 * len(s) // 4) + 1
    rank = levels[cells(s)].astype(np.uint64) << np.uint64(56) | s >> np.uint64(8)
    first = np.argpartition(rank, n - 1)[:n] if n < len(s) else np.arange(len(s))
    return s[first[np.argsort(rank[first], kind="stable")]]


def cells(s: np.ndarray) -> np.ndarray:
    """The cell of each shingle: bits that points do not use for their groups."""
    return (s & np.uint64((1 << BITS) - 1)).astype(np.int64)


class Counts:
    """How often each cell was met by a task; a count stops at what a byte holds, as the most frequent come last anyhow."""

    def __init__(self) -> None:
        self.total, self.held, self.size = np.zeros(1 << BITS, np.uint32), [], 0

    def add(self, s: np.ndarray) -> None:
        self.held.append(cells(s).astype(np.int32))
        self.size += len(s)
        if self.size > 1 << BITS:
            self._count()

    def _count(self) -> None:
        if self.held:
            self.total += np.bincount(np.concatenate(self.held), minlength=1 << BITS).astype(np.uint32)
            self.held, self.size = [], 0

    def parts(self) -> list[bytes]:
        self._count()
        return [pa.compress(x.tobytes(), "zstd", asbytes=True) if x.any() else b"" for x in np.minimum(self.total, 255).astype(np.uint8).reshape(PARTS, -1)]


def frequency_levels(counts: DataFrame) -> np.ndarray:
    """The level of each cell, from rows (sid: part, point: counts). The driver gets a byte a cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(pa.decompress(data, (1 << BITS) // PARTS, "zstd"), np.uint8)
                total[part] = total[part] + x if part in total else x.astype(np.int64)
        levels = [np.minimum(255, np.rint(LEVELS * np.log2(1 + x))).astype(np.uint8).tobytes() for x in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(levels, pa.binary())], ["part", "levels"])

    with small_batches(counts.sparkSession, 64):  # a row holds a part of a table
        out = np.zeros((PARTS, (1 << BITS) // PARTS), np.uint8)
        for part, data in arrow(counts.select("sid", "point").repartition(PARTS, "sid"), run, "part long, levels binary").collect():  # PARTS rows
            out[part] = np.frombuffer(data, np.uint8)
    return out.ravel()


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x)


def read_points(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per row of docs (kind 0: id, sid and other, n, point), and each task's counts of shingles (kind 1: sid is the part, point its counts)."""
    id_type = docs.schema[id_col].dataType
    schema = f"kind int, id {id_type.simpleString()}, sid long, other long, n long, point binary"
    names = ["kind", "id", "sid", "other", "n", "point"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, kind, seen = Counts(), None, set()
        for batch in batches:
            kind = batch.column(0).type
            sid, other, n, points = [], [], [], []
            if len(seen) > MEMORY:
                seen.clear()
            for text in as_bytes(batch.column(1)):
                s = shingles(text)
                first, second = set_id(s)
                sid.append(first)
                other.append(second)
                n.append(len(s))
                points.append(point(s) if len(s) else b"")
                if len(s) and first not in seen:
                    seen.add(first)  # copies in a task count once
                    counts.add(s)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(n), np.int32)), batch.column(0), *(pa.array(x, pa.int64()) for x in (sid, other, n)), pa.array(points, pa.binary())], names)
        if kind is None:
            return
        parts = [(i, x) for i, x in enumerate(counts.parts()) if x]
        for i in range(0, len(parts), 8):
            some = parts[i : i + 8]
            none = pa.nulls(len(some), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([1] * len(some), pa.int32()), pa.nulls(len(some), kind), pa.array([x for x, _ in some], pa.int64()), none, none, pa.array([x for _, x in some], pa.binary())], names)

    return arrow(slim(docs, id_col, text_col), run, schema)


def _prefixes(batches: Iterator[pa.RecordBatch], levels: np.ndarray, names: Names) -> Iterator[list[tuple[int, np.ndarray]]]:
    """Of each batch of texts: the number and prefix of every set. Copies in a task count once."""
    seen: set[int] = set()
    for batch in batches:
        got = []
        if len(seen) > MEMORY:
            seen.clear()
        for text in as_bytes(batch.column(0)):
            s = shingles(text)
            if len(s) and (sid := names.of(s)) not in seen:
                seen.add(sid)
                got.append((sid, prefix(s, levels)))
        if got:
            yield got


class Twice:
    """The keys that more than one text has: a table of bits, in parts. A key's mix names its part and, by 32 other bits, its bit there. A key
    that one text has may share the bit of another, and is kept with it; no key that two texts have is missed."""

    def __init__(self, parts: int, entries: int):
        """entries: how many keys all texts have about, which the table has bits for."""
        self.parts, self.bits = parts, 8 * -(-min(1 << MOST_BITS, max(entries, 1)) // (8 * parts))
        self.table = np.zeros(0, np.uint8)

    def codes(self, keys: np.ndarray) -> np.ndarray:
        """The part in the upper half, what is left of the key in the lower one."""
        h = mix64(keys ^ FACTORS[0])
        return (h >> np.uint64(32)) * np.uint64(self.parts) & ~np.uint64(0xFFFFFFFF) | h & np.uint64(0xFFFFFFFF)

    def slots(self, low: np.ndarray) -> np.ndarray:
        return (low.astype(np.uint64) * np.uint64(self.bits) >> np.uint64(32)).astype(np.int64)

    def rows(self, keys: np.ndarray) -> pa.RecordBatch:
        """(part, n, low) of many keys: the lower halves of their codes, ascending, packed by their differences; none more than twice."""
        code, times = np.unique(self.codes(keys), return_counts=True)
        code = np.repeat(code, np.minimum(times, 2))
        part, low = (code >> np.uint64(32)).astype(np.int64), (code & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        start = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        packed = [pa.compress(np.diff(x, prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T.tobytes(), "zstd", asbytes=True) for x in np.split(low, start[1:])]
        return pa.RecordBatch.from_arrays([pa.array(part[start]), pa.array(np.diff(np.append(start, len(low)))), pa.array(packed, pa.binary())], ["part", "n", "low"])

    def part(self, rows: list[tuple[int, bytes]]) -> bytes:
        """The bits of a part, from all its rows (n, low)."""
        unpacked = (np.frombuffer(pa.decompress(data, 4 * n, "zstd"), np.uint8).reshape(4, n).T.copy().view(np.uint32).ravel() for n, data in rows)
        low = np.sort(np.concatenate([np.cumsum(x, dtype=np.uint32) for x in unpacked]))
        bits = np.zeros(self.bits, bool)
        bits[self.slots(low[1:][low[1:] == low[:-1]])] = True
        return np.packbits(bits, bitorder="little").tobytes()

    def has(self, keys: np.ndarray) -> np.ndarray:
        code = self.codes(keys)
        at = (code >> np.uint64(32)).astype(np.int64) * self.bits + self.slots(code & np.uint64(0xFFFFFFFF))
        return (self.table[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def met_twice(docs: DataFrame, levels: np.ndarray, names: Names, text_col: str, entries: int) -> Twice:
    """Which keys more than one text has, so that the many that one text has alone need not meet: 32 bits of each are sent, packed. The
    driver gets up to a bit a key, 64 MB at most."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(levels)  # a byte a cell
    twice = Twice(max(PARTS, int(spark.conf.get("spark.sql.shuffle.partitions"))), entries)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for got in _prefixes(batches, sent.value, names):
            held += [keys for _, keys in got]
            size += sum(len(keys) for _, keys in got)
            if size >= SORTED:
                yield twice.rows(np.concatenate(held))
                held, size = [], 0
        if held:
            yield twice.rows(np.concatenate(held))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[tuple[int, bytes]]] = {}
        for batch in batches:
            for part, n, low in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts.setdefault(part, []).append((n, low))
        for part, rows in parts.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([twice.part(rows)], pa.binary())], ["part", "bits"])

    rows = arrow(slim(docs, text_col), send, "part long, n long, low binary").repartition("part")
    table = np.zeros((twice.parts, twice.bits // 8), np.uint8)
    for part, data in arrow(rows, meet, "part long, bits binary").collect():  # a row a part
        table[part] = np.frombuffer(data, np.uint8)
    twice.table = table.ravel()
    return twice


def regions(docs: DataFrame, levels: np.ndarray, names: Names, text_col: str, entries: int) -> DataFrame:
    """(key, sid, at) of regions with two members or more, no two regions with the same members; at is the place of key in the set's order."""
    sent = docs.sparkSession.sparkContext.broadcast((levels, met_twice(docs, levels, names, text_col, entries)))

    def entries_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, twice = sent.value
        for got in _prefixes(batches, levels, names):
            size = [len(keys) for _, keys in got]
            keys = np.concatenate([keys for _, keys in got])
            sids = np.repeat(np.array([sid for sid, _ in got], np.int64), size)
            places = np.concatenate([np.arange(n, dtype=np.int32) for n in size])
            some = twice.has(keys)
            yield pa.RecordBatch.from_arrays([_signed(keys[some]), pa.array(sids[some]), pa.array(places[some])], ["key", "sid", "at"])

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [[b.column(i).to_numpy() for i in range(3)] for b in batches]
        if not got:
            return
        key, sid, at = (np.concatenate(x) for x in zip(*got, strict=True))
        order = np.lexsort((sid, key))
        key, sid, at = key[order], sid[order], at[order]
        fresh = np.append(True, (key[1:] != key[:-1]) | (sid[1:] != sid[:-1]))
        key, sid, at = key[fresh], sid[fresh], at[fresh]
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(start, len(key)))
        # 128 bits that depend on the members only
        sigs = [np.add.reduceat(mix64(sid.view(np.uint64) ^ FACTORS[k]), start).view(np.int64) for k in range(2)]
        order = np.lexsort((*sigs, size))
        like = np.append(False, np.all([x[order][1:] == x[order][:-1] for x in (size, *sigs)], 0))
        keep = np.zeros(len(start), bool)
        keep[order[~like]] = True
        rows = np.repeat(keep & (size > 1), size)
        out = [key, *(np.repeat(x, size) for x in sigs), sid, at]
        out = [x[rows] for x in out]
        for i in range(0, len(out[0]), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 100_000]) for x in out], ["key", "sig", "sig2", "sid", "at"])

    rows = arrow(arrow(slim(docs, text_col), entries_of, "key long, sid long, at int").repartition("key"), group, "key long, sig long, sig2 long, sid long, at int", rows=100_000)
    with scratch() as keep:
        rows = materialize(rows, "regions")
        first = rows.groupBy("sig", "sig2").agg(F.min("key").alias("key"))
        rows = materialize(rows.join(first, ["sig", "sig2", "key"]).select("key", "sid", "at"), "regions")
        keep(rows)
    return rows


class Box:
    """A node of an R-tree: the upper corner, sizes and components of the points order[lo:hi], and up to two children."""

    def __init__(self, tree: Tree, order: np.ndarray):
        p = tree.low[order]
        self.order, self.top, self.n = order, p.max(0), (tree.n[order].min(), tree.n[order].max())
        self.comps = (tree.comp[order].min(), tree.comp[order].max())
        self.parts: list[Box] = []
        if len(order) > LEAF:
            spread = p.max(0) - p.min(0)
            if 3 * self.n[1] > 4 * self.n[0]:  # sizes too far apart to link: the size is the coordinate to split
                by = order[np.argsort(tree.n[order], kind="stable")]
            else:
                by = order[np.argsort(p[:, spread.argmax()], kind="stable")] if spread.any() else order
            self.parts = [Box(tree, by[: len(by) // 2]), Box(tree, by[len(by) // 2 :])]


class Tree:
    """The R-tree of a region's points, and its join with itself."""

    def __init__(self, points: list[Point], comp: np.ndarray, at: np.ndarray, before: np.ndarray | None = None, side: np.ndarray | None = None):
        """before: some of the regions of each point that come before this one, see _before(); pairs that have one in common are left to it. side: only pairs of different sides are asked for."""
        self.points, self.comp, self.at, self.before, self.side = points, comp, at, before, side
        self.low = np.array([p.low for p in points]).astype(np.int32)
        self.n = self.low.sum(1)
        self.listed = np.array([p.listed for p in points])
        self.fine = np.array([len(p.fine) > 0 for p in points])
        self.all: tuple | None = None

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of different components whose bounds allow a link."""
        root = Box(self, np.arange(len(self.points)))
        todo = [(root, root)]
        while todo:
            a, b = todo.pop()
            if a.comps == b.comps and a.comps[0] == a.comps[1] or 4 * a.n[1] < 3 * b.n[0] or 4 * b.n[1] < 3 * a.n[0]:
                continue
            if 7 * np.minimum(a.top, b.top).sum() < 3 * (a.n[0] + b.n[0]):
                continue
            if a is b and a.parts:
                todo += [(a.parts[0], a.parts[0]), (a.parts[0], a.parts[1]), (a.parts[1], a.parts[1])]
            elif a.parts and (not b.parts or len(a.order) >= len(b.order)):
                todo += [(x, b) for x in a.parts]
            elif b.parts:
                todo += [(a, x) for x in b.parts]
            else:
                yield self._leaves(a, b)

    def _leaves(self, a: Box, b: Box) -> tuple[np.ndarray, np.ndarray]:
        i, j = a.order[:, None], b.order[None, :]
        ok = (4 * self.n[i] >= 3 * self.n[j]) & (4 * self.n[j] >= 3 * self.n[i]) & (self.comp[i] != self.comp[j])
        if a is b:
            ok &= i < j
        if self.side is not None:
            ok &= self.side[i] != self.side[j]
        # shared at most: before the common shingle, itself, and behind it
        shared = np.minimum(self.at[i], self.at[j]) + np.minimum(self.n[i] - self.at[i], self.n[j] - self.at[j])
        x, y = np.nonzero(ok & (7 * shared >= 3 * (self.n[i] + self.n[j])))
        x, y = a.order[x], b.order[y]
        shared = np.minimum(self.low[x], self.low[y]).sum(1)
        likely = 7 * shared >= 3 * (self.n[x] + self.n[y])
        x, y = x[likely], y[likely]
        if self.before is not None and len(x):
            here = ~(self.before[x][:, :, None] == self.before[y][:, None, :]).any((1, 2))
            x, y = x[here], y[here]
        small = self.listed[x] & self.listed[y]
        if small.sum() > MANY:
            # many pairs of small sets: products of counts, which are no less than their minima, for all at once
            u, v = np.unique(x[small]), np.unique(y[small])
            p, q = self._counts(u, v)
            shared = (p @ q.T)[np.searchsorted(u, x[small]), np.searchsorted(v, y[small])]
            small[small] = 7 * shared < 3 * (self.n[x[small]] + self.n[y[small]])
            x, y = x[~small], y[~small]
        fine = self.fine[x] & self.fine[y]
        fine[fine] = [not could_link(self.points[u], self.points[v]) for u, v in zip(x[fine], y[fine], strict=True)]
        return x[~fine], y[~fine]

    def _counts(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of the finest groups of points a and of points b, by the groups that occur. Made once if all fit CELLS."""
        if self.all is None:
            small = np.flatnonzero(self.listed)
            whole = _table([self.points[k].fine for k in small])
            self.all = (np.searchsorted(small, np.arange(len(self.points))), whole) if whole is not None else ()
        if self.all:
            row, whole = self.all
            return whole[row[a]], whole[row[b]]
        both = _table([self.points[k].fine for k in [*a, *b]], limit=None)
        return both[: len(a)], both[len(a) :]


def _table(lists: list[np.ndarray], limit: int | None = CELLS) -> np.ndarray | None:
    """A row of counts for each list; None if that takes more than limit cells."""
    names, at = np.unique(np.concatenate(lists), return_inverse=True)
    if limit is not None and len(names) * len(lists) > limit:
        return None
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    return np.bincount(row * len(names) + at, minlength=len(lists) * len(names)).reshape(len(lists), -1).astype(np.float32)


def _points_of(points: DataFrame, sids: DataFrame) -> DataFrame:
    """The points of these sets, found before points are moved if there are few."""
    return points.join(if_small(materialize(sids.distinct(), "met")), "sid", "left_semi")


def _with_labels(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return rows.withColumn("comp", F.col("sid"))
    return rows.join(if_small(labels.withColumnRenamed("node", "sid")), "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))


def star_pairs(rows: DataFrame, labels: DataFrame | None, salt: int) -> DataFrame:
    """(a, b): a member of each region's largest component, and every member outside of it.

    In the first round the member is the one with the fewest rare shingles before the region's: of texts that were edited in many ways, the one that most others are near to.
    """
    rows = _with_labels(rows, labels)
    near = F.lit(0) if salt else F.col("at")
    parts = rows.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct(near.alias("near"), F.xxhash64("sid", F.lit(salt)).alias("h"), "sid")).alias("least"))
    order = F.struct("size", (-F.col("least.near")).alias("near"), (-F.xxhash64("comp", F.lit(salt)).cast("double")).alias("h"), "comp", F.col("least.sid").alias("pivot"))
    best = parts.groupBy("key").agg(F.max(order).alias("best"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
    pairs = rows.join(best.select("key", "best.*").withColumnRenamed("comp", "of").drop("size", "near", "h"), "key").where("comp <> of")
    return pairs.select(F.least("sid", "pivot").alias("a"), F.greatest("sid", "pivot").alias("b")).distinct()


def _before(least: list[list[int]], key: int) -> np.ndarray:
    """The regions of each list that come before key, as a row of a table; gaps hold numbers that occur once."""
    width = max(map(len, least))
    rows = np.array([x + [key] * (width - len(x)) for x in least], np.int64).reshape(len(least), width)
    # places among all regions met here: a gap's number is below all of them
    names, at = np.unique(rows, return_inverse=True)
    return np.where(names[at.reshape(rows.shape)] < key, at.reshape(rows.shape), -1 - np.arange(rows.size).reshape(rows.shape))


def _regions(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[list[list]]:
    """The columns of each run of rows whose first columns, by of them, are equal."""
    held: list[list] = []
    for batch in batches:
        cols = [c.to_pylist() for c in batch.columns]
        same = np.all([np.array(c[1:], np.int64) == np.array(c[:-1], np.int64) for c in cols[:by]], 0)
        cuts = [0, *(np.flatnonzero(~same) + 1).tolist(), len(cols[0])]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if hi > lo:
                if held and all(h[0] == c[lo] for h, c in zip(held[:by], cols, strict=False)):
                    for h, c in zip(held, cols, strict=True):
                        h += c[lo:hi]
                else:
                    if held:
                        yield held
                    held = [c[lo:hi] for c in cols]
    if held:
        yield held


MEMBERS = "key long, i int, j int, side int, sid long, comp long, at int, least array<long>"


def _tree(points: list[Point], key: int, comp: np.ndarray, at: list[int], least: list[list[int]], side: np.ndarray | None = None) -> Tree:
    return Tree(points, comp, np.array(at, np.int64), _before(least, key), side)


def _members(tree: Tree, block: np.ndarray, key: int, sid: list[int], comp: list[int], at: list[int], least: list[list[int]]) -> Iterator[pa.RecordBatch]:
    """Rows of MEMBERS for the points of a tree that are in one of its pairs; block: the number of each point's block."""
    many, blocks = len(sid), int(block.max()) + 1
    found, size = [np.empty(0, np.int64)], 0
    for x, y in tree.pairs():
        x, y = np.where(block[x] <= block[y], x, y), np.where(block[x] <= block[y], y, x)
        tile = (block[x] * blocks + block[y]) * many
        found.append(np.unique(np.concatenate([tile + x, tile + y])))
        size += len(found[-1])
        if size > MEMORY:
            found, size = [np.unique(np.concatenate(found))], 0
    tile, member = np.divmod(np.unique(np.concatenate(found)), many)
    i, j = np.divmod(tile, blocks)
    side = block[member] != i
    whole = [np.full(len(member), key, np.int64), *(x.astype(np.int32) for x in (i, j, side)), *(np.array(x, np.int64)[member] for x in (sid, comp)), np.array(at, np.int32)[member]]
    for lo in range(0, len(member), 10_000):
        some = slice(lo, lo + 10_000)
        yield pa.RecordBatch.from_arrays([*(pa.array(x[some]) for x in whole), pa.array([least[k] for k in member[some].tolist()], pa.list_(pa.int64()))], ["key", "i", "j", "side", "sid", "comp", "at", "least"])


def candidates(rows: DataFrame, labels: DataFrame | None, points: DataFrame) -> DataFrame:
    """MEMBERS of regions that have a candidate of another component there, by each region's R-tree.

    A region is dealt in blocks of HELD shingles; a row is for a pair of blocks (i, j), where its member is of block i (side 0) or j (side 1). A pair
    may share many regions: it is a candidate in the first of them, and in others only if the LEAST first ones of both do not tell. Places and
    coarse counts are compared first (for small sets, the fine ones too), then the fine counts of the members that are left, by the first of the
    regions that are left. There only regions' first blocks count as shared: two members of that block are compared in it, others need not be.
    """
    rows = _with_labels(rows, labels)
    mixed = rows.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("key")
    rows = materialize(rows.join(mixed, "key").select("key", "sid", "comp", "at"), "mixed")
    least = rows.groupBy("sid").agg(F.slice(F.array_sort(F.collect_set("key")), 1, LEAST).alias("least"))
    coarse = _points_of(points, rows.select("sid")).select("sid", F.when(F.col("n") > FEW, F.substring("point", 1, 1 + 4 * LEAST_GROUPS)).otherwise(F.col("point")).alias("point"))
    rows = rows.join(coarse.join(least, "sid"), "sid").select("key", "sid", "comp", "at", "least", "point")

    def by_region(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, sid, comp, at, least, data in _regions(batches, 1):
            tree = _tree([Point(p) for p in data], key[0], np.unique(np.array(comp, np.int64), return_inverse=True)[1], at, least)
            order = np.argsort(tree.n, kind="stable")
            block = np.empty(len(sid), np.int64)
            block[order] = np.cumsum(tree.n[order]) // HELD
            yield from _members(tree, block, key[0], sid, comp, at, least)

    rows = materialize(arrow(rows.repartition("key").sortWithinPartitions("key"), by_region, MEMBERS), "candidates")

    def by_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, i, j, side, sid, comp, at, least, data in _regions(batches, 3):
            tree = _tree([Point(p) for p in data], key[0], np.unique(np.array(comp, np.int64), return_inverse=True)[1], at, least, np.array(side) if i[0] != j[0] else None)
            yield from _members(tree, np.where(np.array(side) > 0, j[0], i[0]), key[0], sid, comp, at, least)

    least = rows.where("j = 0").groupBy("sid").agg(F.slice(F.array_sort(F.collect_set("key")), 1, 4 * LEAST).alias("least"))
    rows = rows.drop("least").join(least, "sid", "left").withColumn("least", F.coalesce("least", F.array().cast("array<long>")))
    rows = _points_of(points, rows.select("sid")).select("sid", "point").join(rows, "sid").select("key", "i", "j", "side", "sid", "comp", "at", "least", "point")
    return arrow(rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j"), by_blocks, MEMBERS)


def cross_links(rows: DataFrame, labels: DataFrame | None, points: DataFrame, sets: Sets) -> DataFrame:
    """(a, b): links that connect all components that have one: of each pair of blocks of a region, fewer than it has members."""
    rows = materialize(candidates(rows, labels, points), "candidates")
    known = sets.of(rows.select("sid"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, i, j, side, sid, comp, at, least, data in _regions(batches, 3):
            whole = [np.frombuffer(x, np.uint64) for x in data]
            up = np.unique(np.array(comp, np.int64), return_inverse=True)[1]  # components, merged with every link; the tree reads them, too
            tree = _tree([Point(point(s)) for s in whole], key[0], up, at, least, np.array(side) if i[0] != j[0] else None)
            found = []
            for x, y in tree.pairs():
                for u, v in zip(x.tolist(), y.tolist(), strict=True):
                    if up[u] != up[v] and linked(whole[u], whole[v]):
                        found.append((sid[u], sid[v]))
                        up[up == up[u]] = up[v]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b"])

    with small_batches(rows.sparkSession, 256):  # a row holds a whole set
        rows = known.join(if_small(rows), "sid").select("key", "i", "j", "side", "sid", "comp", "at", "least", "set")
        return materialize(arrow(rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j"), run, "a long, b long"), "linked")


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets link."""
    return 7 * len(np.intersect1d(a, b, assume_unique=True)) >= 3 * (len(a) + len(b))


class Sets:
    """The sets of the points that are asked for, read again from the texts and kept."""

    def __init__(self, docs: DataFrame, points: DataFrame, names: Names, id_col: str, text_col: str):
        self.docs, self.points, self.names, self.id_col, self.text_col = docs, points, names, id_col, text_col
        self.known: DataFrame | None = None

    def of(self, sids: DataFrame) -> DataFrame:
        ids = sids.distinct()
        if self.known is not None:
            ids = ids.join(self.known.select("sid"), "sid", "left_anti")
        ids = materialize(if_small(materialize(ids, "ids")).join(self.points, "sid").select(F.col("id").alias("__id"), "sid", "copies"), "ids")
        docs, names, id_col, text_col = self.docs, self.names, self.id_col, self.text_col

        def texts(ids: DataFrame) -> DataFrame:
            return slim(docs, id_col, text_col).join(if_small(ids), F.col(id_col).eqNullSafe(F.col("__id"))).select("sid", text_col)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                got = [(sid, s) for sid, t in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True) if len(s := shingles(t)) and names.of(s) == sid]
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in got], pa.int64()), pa.array([s.tobytes() for _, s in got], pa.binary())], ["sid", "set"])

        with small_batches(docs.sparkSession, 1000):
            new = arrow(texts(ids.where("copies = 1")), run, "sid long, set binary")
            if ids.where("copies > 1").limit(1).count():  # rows that share a text may share its id, too
                new = new.unionByName(arrow(texts(ids.where("copies > 1")), run, "sid long, set binary").dropDuplicates(["sid"]))
            new = materialize(new, "sets")
        self.known = new if self.known is None else self.known.unionByName(new)
        return self.known


def verified(pairs: DataFrame, points: DataFrame, sets: Sets) -> DataFrame:
    """The pairs that link: by size, by the fine counts of their points, then by their whole sets."""
    ends = lambda x: x.select(F.col("a").alias("sid")).unionByName(x.select(F.col("b").alias("sid")))
    a, b = (points.select(F.col("sid").alias(x), F.col("n").alias(f"n{x}")) for x in "ab")
    sized = materialize(pairs.join(a, "a").join(b, "b").where("4 * na >= 3 * nb and 4 * nb >= 3 * na").select("a", "b"), "pairs")
    some = _points_of(points, ends(sized))
    a, b = (some.select(F.col("sid").alias(x), F.col("point").alias(f"p{x}")) for x in "ab")

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [could_link(Point(x), Point(y)) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    pairs = arrow(sized.join(a, "a").join(b, "b").select("a", "b", "pa", "pb"), bound, "a long, b long")
    pairs = materialize(pairs, "pairs")
    known = sets.of(ends(pairs))
    a, b = (known.select(F.col("sid").alias(x), F.col("set").alias(f"s{x}")) for x in "ab")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    with small_batches(pairs.sparkSession, 256):  # a row holds two whole sets
        return materialize(arrow(pairs.join(a, "a").join(b, "b").select("a", "b", "sa", "sb"), check, "a long, b long"), "linked")


def _named_points(rows: DataFrame) -> tuple[DataFrame, DataFrame, Names]:
    """Rows and different sets (sid, id, n, copies: the rows that have it), with numbers that no two sets share. Clashes of 64 bits are a handful even among 10**11 sets."""

    def different(rows: DataFrame) -> DataFrame:
        found = rows.where("n > 0").groupBy("sid").agg(
            F.min("id").alias("id"), F.first("n").alias("n"), F.count(F.lit(1)).alias("copies"), (F.min("other") != F.max("other")).alias("clash"))
        return materialize(found, "points")

    points = different(rows)
    clashes = frozenset(r.sid for r in points.where("clash").select("sid").collect())
    if clashes:
        rows = rows.withColumn("sid", F.when(F.col("sid").isin(*clashes), F.col("other")).otherwise(F.col("sid")))
        points = different(rows)
        if points.where("clash").limit(1).count():
            raise ValueError("two sets share both halves' numbers")
    return rows, points.drop("clash"), Names(clashes)


def _read(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, Names]:
    """Rows (id, sid, n), different sets (sid, id, n, copies), members of regions, the points of these members, and names. Points of texts that
    meet no other go with what else is written on the way."""
    with scratch() as keep:
        read = materialize(read_points(docs, id_col, text_col), "read")
        with_points, points, names = _named_points(read.where("kind = 0"))
        rows = materialize(with_points.select("id", "sid", "n"), "rows")
        levels = frequency_levels(read.where("kind = 1"))
        entries = points.select(F.sum((F.col("n") / 4 + 1).cast("long"))).first()[0] or 0
        members = regions(docs, levels, names, text_col, entries)
        met = materialize(members.select("sid").distinct(), "met")
        found = with_points.select("sid", "point").join(if_small(met), "sid").groupBy("sid").agg(F.first("point").alias("point"))
        found = materialize(found.join(points, "sid"), "met-points")
        for df in (rows, points, members, found):
            keep(df)
    return rows, points, members, found, names


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles and component_id of every row of docs."""
    rows, points, members, met, names = _read(docs, id_col, text_col)
    sets, labels = Sets(docs, met, names, id_col, text_col), None
    for k in range(ROUNDS):
        labels = relabel(labels, verified(star_pairs(members, labels, k), met, sets))
    labels = relabel(labels, cross_links(members, labels, met, sets))
    # names: the smallest id of a component
    ids = points.select("sid", "id").join(if_small(labels).withColumnRenamed("node", "sid"), "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
    linked = ids.join(labels.select("comp").distinct(), "comp").groupBy("comp").agg(F.min("id").alias("component_id"))
    named = materialize(ids.join(linked, "comp", "left").select("sid", F.coalesce("component_id", "id").alias("component_id")), "names")
    out = rows.select("id", "sid", "n").join(named, "sid", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs of each component, the one of the smallest id (null last; then the first such row), with all its columns.
    Decided by row: rows that share an id but no component do not share its fate."""
    numbered = materialize(docs.withColumn("__rid", F.monotonically_increasing_id()), "numbered", packed=True)
    with scratch() as keep:
        groups = materialize(jaccard_groups(numbered, "__rid", text_col).select("__rid", "component_id"), "groups")
        keep(groups)
    rows = groups.join(slim(numbered, id_col, "__rid").withColumnRenamed(id_col, "id"), "__rid")  # not by component: no group meets in one task
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "__rid")).alias("first")
    stays = rows.groupBy("component_id").agg(first).select(F.col("first.__rid").alias("__rid"))
    gone = materialize(groups.select("__rid").join(stays, "__rid", "left_anti"), "gone")
    return numbered.join(if_small(gone), "__rid", "left_anti").drop("__rid")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: every document with the size of its set and its component."""
    return jaccard_groups(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, row_number() OVER () AS rid,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents),
k AS (SELECT rid, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM d WHERE len(w) > 0),
g AS (SELECT DISTINCT rid, array_to_string(w[i:i + 4], ' ') AS s FROM k),
n AS (SELECT rid, count(*) AS n FROM g GROUP BY rid),
p AS (SELECT a.rid AS a, b.rid AS b, count(*) AS shared FROM g AS a JOIN g AS b ON a.s = b.s AND a.rid <> b.rid GROUP BY a.rid, b.rid),
l AS (SELECT a, b FROM p JOIN n AS x ON x.rid = a JOIN n AS y ON y.rid = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
r AS (SELECT rid AS a, rid AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT x.doc_id, coalesce(n.n, 0) AS n_shingles, min(y.doc_id) AS component_id
FROM d AS x JOIN r ON r.a = x.rid JOIN d AS y ON y.rid = r.b LEFT JOIN n ON n.rid = x.rid
GROUP BY x.rid, x.doc_id, n.n
"""
