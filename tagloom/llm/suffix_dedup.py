"""Suffix-array dedup: remove every byte that a repeated string of LENGTH bytes covers.

Not all suffixes are needed. Every string of LENGTH bytes owns one anchor: the leftmost smallest of its K-byte grams by hash, so equal
strings own equal anchors at equal offsets, and about one place in (LENGTH - K) / 2 is an anchor. A run of neighbouring
strings shares an anchor, and their union is the anchor's span. Only the suffixes at anchors are arranged:

1. Splitters, taken from a bounded sample of texts, range-partition the anchors' suffixes by their leading bytes (then
   by the hash of the gram). Buckets sort locally. Grams that occur once own no repeated string and leave.
   Spans that occur twice or more are repeated as a whole. A gram that is a splitter may lie in many buckets: such
   grams are compared across boundaries, by sums that every task makes of its own rows first.
2. Where a gram is repeated in different spans, one span of each kind is read again. Its strings are sorted by multikey
   quicksort (8 bytes a key, ties only), and neighbours that agree on all LENGTH bytes are repeated.

Equal texts are one text: their suffixes agree anyhow, and one that occurs twice is repeated as a whole. Texts are told
apart by 128 bits (by 64 in the tables, after those that clash there have been given other numbers); spans by the 64 bits of
their key and 64 of their own hash, which two different spans would have to share together.

Edge cases: null counts as empty; texts under LENGTH bytes have no such string and keep all; strings never cross
documents; occurrences may overlap in one document; repeated rows repeat each other; a null id has a row like any other; texts
of any length are processed whole; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm.common import arrow, as_bytes, if_small, materialize, mix64, slim, table
from tagloom.llm.rolling import BASES, Rolling

LENGTH, K = 200, 48
#: Strings that compete for an anchor: grams of one string.
WIDTH = LENGTH - K + 1
#: Different texts that the splitters are taken from, about, and the most keys of each; bytes of different texts to a bucket.
SAMPLE, SAMPLE_KEYS, BUCKET = 4000, 4096, 256 << 20
#: Bits of an anchor's place in a text; longer texts are taken in overlapping pieces of this size.
PLACE = 24
#: Members of a gram's group up to which its spans meet in one task; larger groups meet by digests of strings.
GROUP = 50_000
CHUNK = 1 << 22
_GRAMS, _SPANS = Rolling(BASES[0]), Rolling(BASES[1])
#: Sorted per gram: key (4 leading bytes, 32 bits of hash), span (hash), tid and pack (place, first and last string before it).
COLUMNS = "key long, span long, tid long, pack long"


def _smallest(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbours: from the minima towards both ends of blocks."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    left = np.minimum.accumulate(blocks, 1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def anchors(text: bytes) -> tuple[np.ndarray, ...]:
    """key, span, place, first and last of the anchors of a text: strings place-first .. place-last own the anchor."""
    data = np.frombuffer(text, np.uint8)
    empty = np.empty(0, np.uint64)
    if len(data) < LENGTH:
        return empty, empty, *(np.empty(0, np.int64),) * 3
    sums = _GRAMS.sums(data)
    gram = mix64((sums[K:] - sums[:-K]) * _GRAMS.down[: len(data) - K + 1])
    owner = []
    step = (1 << PLACE) - LENGTH
    for at in range(0, len(gram) - WIDTH + 1, step):
        part = gram[at : at + step + WIDTH - 1]
        rank = (part >> np.uint64(PLACE) << np.uint64(PLACE)) | np.arange(len(part), dtype=np.uint64)
        owner.append((_smallest(rank, WIDTH) & np.uint64((1 << PLACE) - 1)).astype(np.int64) + at)
    place = np.concatenate(owner)  # of the anchor of each string
    start = np.flatnonzero(np.diff(place, prepend=-1))
    end = np.append(start[1:], len(place)) - 1
    place = place[start]
    wide = _SPANS.sums(data)
    span = mix64(_SPANS.parts(wide, start, end + LENGTH) + ((place - start) << 8 | (end - start)).astype(np.uint64))
    lead = np.zeros(len(place), np.uint64)
    for k in range(4):
        lead = lead << np.uint64(8) | data[place + k]
    return lead << np.uint64(32) | gram[place] >> np.uint64(32), span, place, place - start, place - end


def _signed(key: np.ndarray) -> np.ndarray:
    """uint64 as int64 in the same order."""
    return (key ^ np.uint64(1 << 63)).view(np.int64)


def _tid(text: Column, clashes: list[int]) -> Column:
    """The number of a text: a hash of it, so that all that follows depends on texts only; another hash for those whose first one clashes."""
    first = F.xxhash64(text, F.octet_length(text))
    return F.when(first.isin(clashes), _other(text)).otherwise(first) if clashes else first


def _other(text: Column) -> Column:
    return F.xxhash64(F.lit(LENGTH), F.octet_length(text), text)


@dataclass
class Texts:
    """(tid, text) of texts that are long enough; how many different ones there are, and their bytes."""

    rows: DataFrame
    number: int
    bytes: int
    clashes: list[int]


def _texts(docs: DataFrame, text_col: str) -> Texts:
    text = F.col(f"`{text_col}`")
    long = docs.where(F.octet_length(text) >= LENGTH)
    ids = long.select(_tid(text, []).alias("tid"), _other(text).alias("other"), F.octet_length(text).cast("long").alias("bytes"))
    ids = materialize(ids.groupBy("tid").agg((F.min("other") != F.max("other")).alias("clash"), F.max("bytes").alias("bytes")), "texts")
    number, size = ids.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    clashes = [r.tid for r in ids.where("clash").select("tid").collect()]  # a handful even among 10**11 texts
    return Texts(long.select(_tid(text, clashes).alias("tid"), text.alias("text")), number, size, clashes)


def _rows(text: bytes, tid: int) -> tuple[np.ndarray, ...]:
    key, span, place, first, last = anchors(text)
    return _signed(key), span.view(np.int64), np.full(len(key), tid, np.int64), place << 16 | first << 8 | last


def splitters(texts: Texts, buckets: int) -> np.ndarray:
    """Ascending keys between the buckets; a frequent key may come more than once. Copies of a text count once; about SAMPLE
    texts and at most SAMPLE_KEYS keys of each come to the driver."""
    many = max(1, texts.number // SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [_signed(k)[:: max(4, -(-len(k) // SAMPLE_KEYS))] for t in as_bytes(batch.column(0)) for k in anchors(t)[:1]]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64))], ["key"])

    some = texts.rows.where(F.pmod("tid", F.lit(many)) == 0).dropDuplicates(["tid"])  # copies leave where they are
    got = arrow(some.select("text"), run, "key long").toArrow()["key"].to_numpy()
    got = np.sort(got)
    return got[(np.arange(1, buckets) * len(got)) // buckets] if len(got) else got


def _classify(key: np.ndarray, span: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows sorted by key and span, each standing for n equal ones: which are repeated as a whole, which are the first of
    their span in a group of several spans, for first ones how many rows their span has (else 0), and how many spans the group has."""
    new_key = np.append(True, key[1:] != key[:-1])
    new_span = new_key | np.append(True, span[1:] != span[:-1])
    first, start = np.flatnonzero(new_span), np.flatnonzero(new_key)
    size = np.add.reduceat(n, first)
    whole = np.repeat(size > 1, np.diff(np.append(first, len(key))))
    spans = np.add.reduceat(new_span.astype(np.int64), start)
    spans = np.repeat(spans, np.diff(np.append(start, len(key))))
    total = np.zeros(len(key), np.int64)
    total[first] = size
    return whole, (spans > 1) & new_span, total, spans


def arrange(texts: Texts) -> DataFrame:
    """(kind, key, span, tid, pack, n): anchors whose spans are repeated (kind 0), to be compared (kind 1), or of a splitter's gram or
    a group of over GROUP spans (kind 2)."""
    spark = texts.rows.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-texts.bytes // BUCKET))
    most = GROUP
    between = splitters(texts, n)
    sent = spark.sparkContext.broadcast(between)  # a key a bucket

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [_rows(text, tid) for tid, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True)]
            if got:
                key, span, tid, pack = (np.concatenate(x) for x in zip(*got, strict=True))
                low, high = np.searchsorted(sent.value, key), np.searchsorted(sent.value, key, "right")
                spread = (mix64((span ^ tid).view(np.uint64)) >> np.uint64(1)).astype(np.int64) % (high - low + 1)
                yield pa.RecordBatch.from_arrays([*map(pa.array, (key, span, tid, pack)), pa.array((low + spread).astype(np.int32))], ["key", "span", "tid", "pack", "bucket"])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [[b.column(i).to_numpy() for i in range(4)] for b in batches]
        if not got:
            return
        rows = [np.concatenate(x) for x in zip(*got, strict=True)]
        order = np.lexsort((rows[3], rows[2], rows[1], rows[0]))
        rows = [x[order] for x in rows]
        # copies of a text are one text: their rows are equal in all columns
        fresh = np.flatnonzero(np.append(True, np.any([x[1:] != x[:-1] for x in rows], 0)))
        n, rows = np.diff(np.append(fresh, len(order))), [x[fresh] for x in rows]
        shared = np.isin(rows[0], sent.value)
        whole, compare, total, spans = _classify(rows[0], rows[1], n)
        shared |= spans > most
        # of a gram that may lie in other buckets too, one row of each span goes on, with the number that this bucket has
        for kind, chosen in ((0, whole), (1, compare & ~shared), (2, shared & (total > 0))):
            at = np.flatnonzero(chosen)
            for i in range(0, len(at), 100_000):
                part = at[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), kind, np.int32)), *(pa.array(x[part]) for x in rows), pa.array(total[part])], ["kind", "key", "span", "tid", "pack", "n"])

    rows = arrow(texts.rows, emit, f"{COLUMNS}, bucket int").repartitionById(n, F.col("bucket")).drop("bucket")
    return materialize(arrow(rows, sort, f"kind int, {COLUMNS}, n long", rows=100_000), "anchors")


def across_boundaries(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of grams that are splitters or have many spans, a row for each span and bucket: further spans that are repeated as a whole (once in each of
    several buckets), those to be compared, and those of large groups."""
    spans = rows.groupBy("key", "span").agg(F.sum("n").alias("all"), F.min(F.struct("tid", "pack")).alias("one"))
    spans = materialize(spans, "spans")
    groups = materialize(spans.groupBy("key").agg(F.count(F.lit(1)).alias("spans")), "groups")  # at most a row a splitter, and one for GROUP spans
    whole = rows.where("n = 1").join(spans.where("all > 1").select("key", "span"), ["key", "span"], "left_semi").select("tid", "pack")
    several = spans.join(if_small(groups), "key").where("spans > 1").select("spans", "key", F.col("one.tid").alias("tid"), F.col("one.pack").alias("pack"))
    return whole, several.where(F.col("spans") <= GROUP).drop("spans"), several.where(F.col("spans") > GROUP).drop("spans")


def _spans_of(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, tid, pack, bytes): the bytes of spans, from the texts that hold them."""
    own = materialize(wanted.groupBy("tid").agg(F.collect_list(F.struct("key", "pack")).alias("spans")).withColumnRenamed("tid", "own"), "wanted")
    rows = arrow(texts.join(if_small(own), F.col("tid") == F.col("own")).select("tid", "text", "spans"), _cut, "key long, tid long, pack long, bytes binary")
    return rows.dropDuplicates(["key", "tid", "pack"])


def _unpack(pack: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place, first string and last string."""
    place = pack >> 16
    return place, place - (pack >> 8 & 255), place - (pack & 255)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [], [], [], []
        for tid, text, spans in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            for s in spans:
                place, first, last = _unpack(s["pack"])
                for column, x in zip(out, (s["key"], tid, s["pack"], text[first : last + LENGTH]), strict=True):
                    column.append(x)
        yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.binary())], ["key", "tid", "pack", "bytes"])


def repeated_strings(data: np.ndarray, start: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Which of the strings data[start : start + LENGTH] occur twice or more in their group.

    Multikey quicksort, breadth first: all ties of one depth are split by their next eight bytes; what is alone leaves.
    """
    words = np.zeros(len(data), np.uint64)
    padded = np.append(data, np.zeros(8, np.uint8)).astype(np.uint64)
    for k in range(8):
        words = words << np.uint64(8) | padded[k : k + len(data)]
    left, run = np.arange(len(start)), group
    for depth in range(0, LENGTH, 8):
        word = words[start[left] + depth]
        order = np.lexsort((word, run))
        left, run, word = left[order], run[order], word[order]
        fresh = np.append(True, (run[1:] != run[:-1]) | (word[1:] != word[:-1])) if len(left) else np.empty(0, bool)
        run = np.cumsum(fresh) - 1
        tied = np.bincount(run)[run] > 1 if len(run) else fresh
        left, run = left[tied], run[tied]
        if not len(left):
            break
    out = np.zeros(len(start), bool)
    out[left] = True
    return out


def _compared(rows: list[tuple[int, int, int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """tid, first and last start of repeated strings, of whole groups of spans."""
    key, tid, pack = (np.array([r[i] for r in rows], np.int64) for i in range(3))
    data = np.frombuffer(b"".join(r[3] for r in rows), np.uint8)
    place, first, last = _unpack(pack)
    n = last - first + 1
    begin = np.cumsum(np.append(0, n[:-1] + LENGTH - 1))
    member = np.repeat(np.arange(len(rows)), n)
    step = np.arange(len(member)) - np.repeat(np.cumsum(n) - n, n)
    _, group = np.unique(key, return_inverse=True)
    # strings can only be equal where their anchor lies at the same offset
    offset = (place - first)[member] - step
    found = repeated_strings(data, begin[member] + step, group[member] * 256 + offset)
    member, at = member[found], (first[member] + step)[found]
    fresh = np.append(True, (member[1:] != member[:-1]) | (at[1:] != at[:-1] + 1)) if len(at) else np.empty(0, bool)
    lo = np.flatnonzero(fresh)
    hi = np.append(lo[1:], len(at)) - 1
    return tid[member[lo]], at[lo], at[hi]


RUNS = ["tid", "first", "last"]


def compare(spans: DataFrame) -> DataFrame:
    """(tid, first, last): runs of starts of repeated strings, from spans that share grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, bytes]] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if size > CHUNK and row[0] != held[-1][0]:  # groups stay together
                    yield pa.RecordBatch.from_arrays([*map(pa.array, _compared(held))], RUNS)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield pa.RecordBatch.from_arrays([*map(pa.array, _compared(held))], RUNS)

    return arrow(spans.repartition("key").sortWithinPartitions("key"), run, "tid long, first long, last long")


def compare_large(spans: DataFrame) -> DataFrame:
    """The same for groups of more than GROUP spans: strings meet by their digests, whose counts are summed before they move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [], [], []
            for _, tid, pack, data in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                _, first, last = _unpack(pack)
                for i in range(last - first + 1):
                    for column, x in zip(out, (tid, first + i, hashlib.blake2b(data[i : i + LENGTH], digest_size=16).digest()), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], ["tid", "first", "digest"])

    rows = materialize(arrow(spans, run, "tid long, first long, digest binary"), "strings")
    often = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return rows.join(often, "digest", "left_semi").select("tid", "first", F.col("first").alias("last"))


def covered(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(tid, spans): the bytes to remove of each text, as (start, end)."""
    return _covered(_texts(docs, text_col))


def _covered(texts: Texts) -> DataFrame:
    rows = arrange(texts)
    whole, few, many = across_boundaries(rows.where("kind = 2"))
    whole = rows.where("kind = 0").select("tid", "pack").unionByName(whole)
    place = F.shiftright("pack", 16)
    runs = whole.select("tid", (place - F.shiftright("pack", 8).bitwiseAND(F.lit(255))).alias("first"), (place - F.col("pack").bitwiseAND(F.lit(255))).alias("last"))
    runs = runs.unionByName(compare(_spans_of(texts.rows, rows.where("kind = 1").select("key", "tid", "pack").unionByName(few))))
    many = materialize(many, "large")
    if many.limit(1).count():
        runs = runs.unionByName(compare_large(_spans_of(texts.rows, many)))
    spans = runs.groupBy("tid").agg(F.collect_set(F.struct(F.col("first").alias("start"), (F.col("last") + LENGTH).alias("end"))).alias("spans"))
    return materialize(arrow(spans.select(F.col("tid").alias("own"), "spans"), _merged, "own long, spans array<struct<start:long,end:long>>"), "covered")


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), _span_array([_union(x) for x in batch.column(1).to_pylist()])], ["own", "spans"])


def _span_array(rows: list[list[tuple[int, int]]]) -> pa.Array:
    return pa.array([[{"start": a, "end": b} for a, b in r] for r in rows], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))


def _union(spans: list[dict[str, int]] | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s in sorted((s["start"], s["end"]) for s in spans or ()):
        if out and s[0] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], s[1]))
        else:
            out.append(s)
    return out


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, spans (maximal removed runs of bytes) and kept (the remaining bytes) of every row of docs."""
    kind = docs.schema[id_col].dataType.simpleString()
    texts = _texts(docs, text_col)
    cover, text = _covered(texts), F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`"), text, _tid(text, texts.clashes).alias("__tid")).join(if_small(cover), F.col("__tid") == F.col("own"), "left").select(id_col, text_col, "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, spans, kept = [], [], []
            for text, found in zip(as_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                data, gone, at, parts = text or b"", _union(found), 0, []
                for start, end in gone:
                    parts.append(data[at:start])
                    at = end
                n.append(len(data))
                spans.append(gone)
                kept.append(b"".join([*parts, data[at:]]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), _span_array(spans), pa.array(kept, pa.binary())], [id_col, "n_bytes", "spans", "kept"])

    return arrow(rows, run, f"`{id_col}` {kind}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: every document with what is left of its bytes."""
    out = suffix_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
