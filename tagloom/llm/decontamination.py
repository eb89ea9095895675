"""Benchmark decontamination by a distributed positional inverted index.

The index is partitioned by document: a row holds, for one document, the terms that any benchmark item uses and the
sorted positions of each (its postings). It is written once for the whole benchmark, where the texts are read, without a shuffle. Document
frequencies are summed over the whole corpus, so that every window of an item knows its rarest terms. A window is found
by taking the postings of its rarest term, moving them back by the term's place in the window, and intersecting them with the
moved postings of the next rarest term, and so on: what is left are the starts of exact occurrences.
`proximity` finds all terms of a query within a span, also from the rarest term's postings.

The benchmark is handled in blocks of BLOCK_WORDS words, each broadcast; a larger benchmark means more blocks, not a
larger broadcast, and an item that is larger than a block goes in several. All blocks search the one index, as long as the benchmark has
VOCABULARY different words at most; beyond, each block has an index of its own terms. Hits of several blocks meet by document id.

Edge cases: documents without id are reported like others, by their text where several blocks have hits; null and empty texts have no words and no hits; items without words are left out; items of fewer words than a
window are one window; items with the same id count once; repeated documents are reported each; an empty benchmark hits nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm.common import arrow, as_bytes, materialize, slim, table

WINDOW, BLOCK_WORDS, VOCABULARY = 10, 500_000, 1_000_000
#: Bytes that are no part of a word become spaces; A-Z become a-z.
_TO_WORDS = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)


def words(text: bytes | None) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the lower-cased text, as UTF-8."""
    return text.translate(_TO_WORDS).split() if text else []


@dataclass
class Block:
    """Items as term numbers, and their different windows."""

    terms: dict[bytes, int] = field(default_factory=dict)
    windows: dict[tuple[int, ...], list[str]] = field(default_factory=dict)

    def add(self, item: str, tokens: list[bytes], window: int) -> None:
        ids = [self.terms.setdefault(w, len(self.terms)) for w in tokens]
        for i in range(max(1, len(ids) - window + 1)):
            items = self.windows.setdefault(tuple(ids[i : i + window]), [])
            if not items or items[-1] != item:
                items.append(item)


def blocks(benchmark: DataFrame, window: int, terms: dict[bytes, int] | None, id_col: str = "item_id", text_col: str = "text") -> Iterator[Block]:
    """Items in blocks of about BLOCK_WORDS words, read one partition at a time. The pieces of a larger item overlap, so that
    no window is lost. terms: the numbers that all blocks share; None: each block has its own."""

    def fresh() -> Block:
        return Block({} if terms is None else terms)

    block, n = fresh(), 0
    for row in slim(benchmark, id_col, text_col).toLocalIterator():
        tokens = words((row[1] or "").encode()) if row[0] is not None else []
        step = max(window, BLOCK_WORDS)
        for at in range(0, max(1, len(tokens) - window + 1), step) if tokens else ():
            piece = tokens[at : at + step + window - 1]
            block.add(str(row[0]), piece, window)
            n += len(piece)
            if n >= BLOCK_WORDS:
                yield block
                block, n = fresh(), 0
    if n:
        yield block


def vocabulary(benchmark: DataFrame, text_col: str = "text") -> dict[bytes, int] | None:
    """Numbers of all different words of the benchmark; None if there are more than VOCABULARY."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {w for text in as_bytes(batch.column(0)) for w in words(text)}
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary())], ["word"])

    rows = arrow(slim(benchmark, text_col), run, "word binary").distinct().limit(VOCABULARY + 1).collect()
    return {w: i for i, w in enumerate(sorted(bytes(r.word) for r in rows))} if len(rows) <= VOCABULARY else None


def build_index(docs: DataFrame, terms: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, terms, ends, positions, digest): the postings of a document as int32 arrays in bytes.

    positions[ends[i-1]:ends[i]] are the places of terms[i]; terms and positions are ascending. digest tells texts of one id apart.
    """
    sent = docs.sparkSession.sparkContext.broadcast(terms)  # at most the words of a block
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            n, out = [], ([], [], [], [])
            for text in as_bytes(batch.column(1)):
                w = words(text)
                out[3].append(hashlib.blake2b(text or b"", digest_size=16).digest())
                n.append(len(w))
                ids = np.fromiter((known.get(x, -1) for x in w), np.int32, len(w))
                at = np.flatnonzero(ids >= 0).astype(np.int32)
                ids = ids[at]
                order = np.argsort(ids, kind="stable")
                ids, at = ids[order], at[order]
                ends = np.flatnonzero(np.append(ids[1:] != ids[:-1], True)).astype(np.int32) if len(ids) else ids
                for column, x in zip(out, (ids[ends], ends + 1, at), strict=False):
                    column.append(x.astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *(pa.array(x, pa.binary()) for x in out)], ["id", "n_words", "terms", "ends", "positions", "digest"])

    return arrow(slim(docs, id_col, text_col), run, f"id {kind}, n_words long, terms binary, ends binary, positions binary, digest binary")


def frequencies(index: DataFrame, n_terms: int) -> np.ndarray:
    """In how many documents each term occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int32), minlength=n_terms)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["term", "n"])

    out = np.zeros(n_terms, np.int64)
    for term, n in arrow(index.select("terms"), run, "term long, n long").groupBy("term").agg(F.sum("n")).collect():  # at most a row a term
        out[term] = n
    return out


class Postings:
    """The postings of one document."""

    def __init__(self, terms: bytes, ends: bytes, positions: bytes):
        self.terms, self.ends, self.positions = (np.frombuffer(x, np.int32) for x in (terms, ends, positions))

    def of(self, term: int) -> np.ndarray:
        i = int(np.searchsorted(self.terms, term))
        if i == len(self.terms) or self.terms[i] != term:
            return self.positions[:0]
        return self.positions[self.ends[i - 1] if i else 0 : self.ends[i]]

    def phrase(self, plan: list[tuple[int, int]]) -> np.ndarray:
        """Starts of the phrase whose (term, place) pairs come rarest first."""
        starts = self.of(plan[0][0]) - plan[0][1]
        for term, place in plan[1:]:
            if not len(starts):
                break
            own = self.of(term)
            at = np.searchsorted(own, starts + place)
            starts = starts[(at < len(own)) & (own[np.minimum(at, len(own) - 1)] == starts + place)] if len(own) else starts[:0]
        return starts

    def near(self, terms: list[int], span: int) -> np.ndarray:
        """Places of terms[0], the rarest, that have each of the other terms less than span words away."""
        at = self.of(terms[0])
        for term in terms[1:]:
            own = self.of(term)
            if not len(at) or not len(own):
                return at[:0]
            right = np.searchsorted(own, at)
            gap = np.minimum(np.abs(own[np.minimum(right, len(own) - 1)] - at), np.abs(own[np.maximum(right - 1, 0)] - at))
            at = at[gap < span]
        return at


class Plan:
    """The windows of a block, by their rarest term; terms that occur nowhere rule their windows out."""

    def __init__(self, block: Block, found: np.ndarray):
        self.by_rarest: dict[int, list[tuple[list[tuple[int, int]], int, list[str]]]] = {}
        for ids, items in block.windows.items():
            if all(found[t] for t in ids):
                plan = sorted(((t, k) for k, t in enumerate(ids)), key=lambda x: (found[x[0]], x))
                self.by_rarest.setdefault(plan[0][0], []).append((plan, len(ids), items))
        self.rarest = np.array(sorted(self.by_rarest), np.int32)

    def hits(self, p: Postings) -> tuple[np.ndarray, set[str]]:
        """Starts and ends of occurrences, as rows, and their items."""
        found, items = [], set()
        for term in p.terms[np.isin(p.terms, self.rarest)].tolist():
            for plan, n, names in self.by_rarest[term]:
                starts = p.phrase(plan)
                if len(starts):
                    found.append(np.stack([starts, starts + n], 1))
                    items.update(names)
        return np.concatenate(found) if found else np.zeros((0, 2), np.int64), items


def merge_spans(spans: np.ndarray) -> np.ndarray:
    """The union of spans, as disjoint spans."""
    if not len(spans):
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    first = np.append(True, spans[1:, 0] > reach[:-1])
    return np.stack([spans[first, 0], reach[np.append(np.flatnonzero(first)[1:] - 1, len(spans) - 1)]], 1)


HITS = "id {kind}, n_words long, spans array<struct<start:int,end:int>>, items array<string>, digest binary"


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, spans (disjoint spans of hit words) and items (ids of items with occurring windows) of every row of docs."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = HITS.format(kind=kind)
    parts, index, found = [], None, None
    terms = vocabulary(benchmark)
    for block in blocks(benchmark, window, terms):
        if index is None or terms is None:
            index = materialize(build_index(docs, block.terms, id_col, text_col), "postings")
            found = frequencies(index, len(block.terms))
        plan = docs.sparkSession.sparkContext.broadcast(Plan(block, found))

        def run(batches: Iterator[pa.RecordBatch], plan=plan) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                spans, items = [], []
                for row in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                    found, names = plan.value.hits(Postings(*row))
                    spans.append([{"start": int(a), "end": int(b)} for a, b in merge_spans(found)])
                    items.append(sorted(names))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(items, pa.list_(pa.string())), batch.column(5)],
                    ["id", "n_words", "spans", "items", "digest"])

        parts.append(arrow(index, run, schema))
    if not parts:
        return build_index(docs, {}, id_col, text_col).select(F.col("id").alias(id_col), "n_words", F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("spans"), F.expr("cast(array() as array<string>)").alias("items"))
    out = parts[0]
    for more in parts[1:]:  # only documents with hits move
        hits = more.where(F.size("items") > 0).groupBy(F.col("id").alias("i"), F.col("digest").alias("d")).agg(F.first("spans").alias("s2"), F.first("items").alias("i2"))
        out = out.join(hits, F.col("id").eqNullSafe(F.col("i")) & (F.col("digest") == F.col("d")), "left").select(
            "id", "n_words", F.expr("case when s2 is null then spans else concat(spans, s2) end").alias("spans"),
            F.expr("case when i2 is null then items else array_sort(array_union(items, i2)) end").alias("items"), "digest")
    if len(parts) > 1:
        out = arrow(out, _merged, schema)
    return out.drop("digest").withColumnRenamed("id", id_col)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = [[{"start": int(a), "end": int(b)} for a, b in merge_spans(np.array([(x["start"], x["end"]) for x in s], np.int64).reshape(-1, 2))] for s in batch.column(2).to_pylist()]
        yield batch.set_column(2, batch.schema.field(2), pa.array(spans, batch.schema.field(2).type))


def proximity(docs: DataFrame, queries: list[str], span: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, query, positions): where the rarest word of a query has all its other words less than span words away."""
    block = Block()
    for q in queries:
        block.add(q, words(q.encode()), 1 << 30)
    index = materialize(build_index(docs, block.terms, id_col, text_col), "postings")
    found = frequencies(index, len(block.terms))
    plans = [(q, sorted({block.terms[w] for w in words(q.encode())}, key=lambda t: (found[t], t))) for q in queries if words(q.encode())]
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [(i, q, x.tolist()) for i, row in enumerate(zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True)) for q, terms in plans if len(x := Postings(*row).near(terms, span))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([x[0] for x in at], pa.int64())), pa.array([x[1] for x in at], pa.string()), pa.array([x[2] for x in at], pa.list_(pa.int32()))], ["id", "query", "positions"])

    return arrow(index, run, f"id {kind}, query string, positions array<int>").withColumnRenamed("id", id_col)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without a hit, with all their columns. Rows with a null id stay: no decision can be carried to them."""
    from tagloom.llm.common import if_small

    hit = materialize(decontaminate(docs, benchmark, window, id_col, text_col).where(F.size("items") > 0).select(F.col(f"`{id_col}`").alias("__hit")).distinct(), "hit")
    return docs.join(if_small(hit), F.col(f"`{id_col}`") == F.col("__hit"), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: every document with what it shares with `benchmark`."""
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", F.expr("cast(aggregate(spans, 0, (n, s) -> n + s.end - s.start) as long)").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


SQL = rf"""
WITH d AS (
    SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents),
b AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark WHERE item_id IS NOT NULL),
i AS (
    SELECT item_id, least(len(w), {WINDOW}) AS n, w[k:k + least(len(w), {WINDOW}) - 1] AS x
    FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - {WINDOW} + 1) + 1)) AS k FROM b WHERE len(w) > 0)),
s AS (SELECT DISTINCT n FROM i),
p AS (
    SELECT rid, n, k, w[k:k + n - 1] AS x
    FROM (SELECT rid, n, w, unnest(range(1, len(w) - n + 2)) AS k FROM d CROSS JOIN s WHERE len(w) >= n)),
h AS (SELECT rid, p.n, k, item_id FROM p JOIN i USING (n, x)),
c AS (SELECT rid, count(DISTINCT j) AS n_hit FROM (SELECT rid, unnest(range(k, k + n)) AS j FROM h) GROUP BY rid),
g AS (SELECT rid, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM h GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
    sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN g USING (rid)
"""
