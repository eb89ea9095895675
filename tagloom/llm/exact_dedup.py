"""Exact dedup by a heavy-hitter split.

A text's digest is the SHA-256 of its UTF-8 form without `[\\x20\\x09-\\x0D]`. Misra-Gries summaries, one per partition
and then merged, name the digests that may be frequent; their exact counts are then taken, and the verified winners
with their chosen rows are broadcast (at most `counters` rows), so rows of a large group are decided on the map side.
All other digests are counted with a partial aggregate on the map side, and no group can hold more than 1/counters of the
rows; of these groups, only those of two rows or more are joined with the rows again.

Edge cases: a null text counts as empty; all empty texts form one group; repeated rows (same id, same text) are one
group whose keep_id is that id, and `kept` then marks one of them; a null id sorts after all others; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm.common import if_small, materialize, scratch, slim, table

#: Misra-Gries counters: every digest with over 1/COUNTERS of the rows is found.
COUNTERS = 1000
_SPACE = "\t\n\x0b\x0c\r "


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), _SPACE, "")


def misra_gries(digests: Iterator[bytes], counters: int) -> dict[bytes, int]:
    """Summary of at most `counters` digests that holds each one seen more than n/(counters+1) times."""
    held: dict[bytes, int] = {}
    for d in digests:
        if d in held:
            held[d] += 1
        elif len(held) < counters:
            held[d] = 1
        else:
            held = {k: n - 1 for k, n in held.items() if n > 1}
    return held


def merge_summaries(summaries: list[dict[bytes, int]], counters: int) -> dict[bytes, int]:
    """Merge two or more summaries, keeping the guarantee: subtract the (counters+1)-th count from all."""
    total: Counter[bytes] = Counter()
    for s in summaries:
        total.update(s)
    if len(total) <= counters:
        return dict(total)
    floor = sorted(total.values(), reverse=True)[counters]
    return {k: n - floor for k, n in total.items() if n > floor}


def frequent_digests(digests: DataFrame, counters: int = COUNTERS) -> list[bytes]:
    """Digests that may have over 1/(counters+1) of the rows. Summaries merge in a tree, each node of bounded size."""

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = misra_gries((d for b in batches for d in b.column(0).to_pylist()), counters)
        yield pa.RecordBatch.from_pydict({"digest": pa.array(list(held), pa.binary()), "n": pa.array(list(held.values()), pa.int64())})

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        for b in batches:
            rows = zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
            held = merge_summaries([held, *({d: n} for d, n in rows)], counters)  # a batch may hold a digest several times
        yield pa.RecordBatch.from_pydict({"digest": pa.array(list(held), pa.binary()), "n": pa.array(list(held.values()), pa.int64())})

    out = digests.select("digest").mapInArrow(summary, "digest binary, n long")
    out = out.repartition(max(1, min(64, digests.sparkSession.sparkContext.defaultParallelism))).mapInArrow(merged, "digest binary, n long")
    held: dict[bytes, int] = {}
    for row in out.toLocalIterator():  # at most 64 x counters rows
        held[bytes(row.digest)] = held.get(bytes(row.digest), 0) + row.n
    return list(merge_summaries([held], counters))


def _digests(docs: DataFrame, id_col: str, text_col: str, rid: Column) -> DataFrame:
    text = F.col(f"`{text_col}`")
    return materialize(
        docs.select(
            F.col(f"`{id_col}`").alias("id"),
            F.unhex(F.sha2(normalised(text).cast("binary"), 256)).alias("digest"),
            F.length(F.coalesce(text, F.lit(""))).alias("len"),
            rid.alias("rid"),
        ),
        "digests",
    )


def _decide(rows: DataFrame, counters: int) -> DataFrame:
    """rid, id, digest, n, keep, kept, and spare (the first rid of the group's rows without id) of every row that _digests() gave."""
    spark = rows.sparkSession
    best = F.min(F.struct((-F.col("len")).alias("neg_len"), F.col("id").isNull().alias("no_id"), "id", "rid")).alias("best")
    no_id = F.min(F.when(F.col("id").isNull(), F.col("rid")))
    candidates = spark.createDataFrame([(bytearray(x),) for x in frequent_digests(rows, counters)], "digest binary")
    found = rows.join(F.broadcast(candidates), "digest").groupBy("digest").agg(F.count(F.lit(1)).alias("n"), best, no_id.alias("spare")).where("n > 1")
    kind = rows.schema["id"].dataType.simpleString()
    winners = F.broadcast(spark.createDataFrame(  # at most `counters` rows
        [(r.digest, r.n, r.best.id, r.best.rid, r.spare) for r in found.collect()], f"digest binary, n long, keep {kind}, keep_rid long, spare long"))
    hot = rows.join(winners, "digest").select("rid", "id", "digest", "n", "keep", (F.col("rid") == F.col("keep_rid")).alias("kept"), "spare")
    cold = rows.join(winners.select("digest"), "digest", "left_anti")
    groups = cold.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), best, no_id.alias("spare")).where("n > 1")
    groups = materialize(groups.select(F.col("digest").alias("of"), "n", F.col("best.id").alias("keep"), F.col("best.rid").alias("keep_rid"), "spare"), "groups")
    alone = F.col("of").isNull()
    cold = cold.join(if_small(groups), F.col("digest") == F.col("of"), "left").select(
        "rid", "id", "digest", F.coalesce("n", F.lit(1).cast("long")).alias("n"), F.when(alone, F.col("id")).otherwise(F.col("keep")).alias("keep"),
        (alone | (F.col("rid") == F.col("keep_rid"))).alias("kept"), F.when(~alone, F.col("spare")).when(F.col("id").isNull(), F.col("rid")).alias("spare"))
    return hot.unionByName(cold)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per row of docs: id, digest (binary), n (rows with equal text), keep (id of the row that stays), kept."""
    rows = _digests(docs, id_col, text_col, F.monotonically_increasing_id())  # fixed by being written: tells repeated rows apart
    return _decide(rows, counters).drop("rid", "spare")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """The rows of docs that stay, with all columns of docs: one row of each group, the one that exact_groups() keeps. The
    decision is a row's own, so of repeated rows one stays, and rows that share an id but not a text do not share its fate.
    Beside a kept row that has an id, one row without id stays, too."""
    numbered = materialize(docs.withColumn("__rid", F.monotonically_increasing_id()), "numbered", packed=True)
    with scratch() as keep:
        rows = _decide(_digests(numbered, id_col, text_col, F.col("__rid")), counters)
        stays = F.col("kept") | (F.col("id").isNull() & F.col("keep").isNotNull() & (F.col("rid") == F.col("spare")))
        gone = materialize(rows.where(~stays).select(F.col("rid").alias("__rid")), "gone")
        keep(gone)
    return numbered.join(if_small(gone), "__rid", "left_anti").drop("__rid")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: every row of `documents` with the row that its group keeps."""
    return exact_groups(slim(table(spark, sf_dir, "documents"), "doc_id", "text")).select(
        F.col("id").alias("doc_id"), F.col("keep").alias("keep_id"), F.col("n").alias("group_size"), "kept", F.lower(F.hex("digest")).alias("text_sha256"))


SQL = r"""
WITH d AS (
    SELECT doc_id, length(coalesce(text, '')) AS len, row_number() OVER () AS rid,
        sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
    FROM documents)
SELECT doc_id, first_value(doc_id) OVER o AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
    row_number() OVER o = 1 AS kept, text_sha256
FROM d
WINDOW o AS (PARTITION BY text_sha256 ORDER BY len DESC, doc_id ASC NULLS LAST, rid)
"""
