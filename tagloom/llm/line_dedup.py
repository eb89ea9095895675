"""Line dedup by site-relative frequency, with DataFrame functions only.

The share of a host's pages that contain a line (once or more) tells boilerplate from content: lines whose share exceeds
RATIO are dropped from all pages of that host, if LEAST pages of it or more contain them: what stands on one page only repeats
nothing, however few pages its host has. A line is what lies between newlines or block-level tags of the HTML, other tags removed, trimmed.

Counts are summed before they are shuffled, so a host or line that holds a third of all rows arrives as a row per task.
A host's dropped lines are few (at most its mean number of lines a page over RATIO), so they go to the pages as one array
a host: broadcast when their table is small, else by a join whose hot hosts are spread over SALTS partitions.

Edge cases: a null or unreadable URL has the host ''; null or empty HTML has no lines; repeated rows count as pages of
their own; a share of just RATIO is kept; pages of any length are read whole, in time that is linear even if tags or comments
never end; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm.common import BROADCAST_LIMIT, materialize, table, written_bytes

RATIO, LEAST, SALTS = 0.3, 2, 64
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
COMMENT = r"<!--[\s\S]*?-->"
BLOCK = r"</?(?i:address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|script|section|style|table|td|th|title|tr|ul)(?:[\x20\t/][^>]*)?>"
BREAKS = rf"[\r\n]+|{COMMENT}|{BLOCK}"
TAGS = r"</?[A-Za-z][^>]*>|<![^>]*>"


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))


def _cut(text: Column, last: str) -> tuple[Column, Column]:
    """What ends with the last occurrence of a string, and what follows it."""
    after = F.substring_index(text, last, -1)
    return F.substring(text, F.lit(1), F.length(text) - F.length(after)), after


def lines(html: Column) -> Column:
    """The lines of a page, in order, without empty ones.

    A pattern is only tried where its last character still comes, so that no search runs to the end in vain.
    """
    tags, rest = _cut(F.coalesce(html, F.lit("")), ">")
    comments, tags = _cut(tags, "-->")
    text = F.concat(F.regexp_replace(comments, BREAKS, "\n"), F.regexp_replace(tags, BLOCK, "\n"), rest)

    def bare(line: Column) -> Column:
        tags, rest = _cut(line, ">")
        return F.btrim(F.concat(F.regexp_replace(tags, TAGS, ""), rest), F.lit(" \t"))

    return F.filter(F.transform(F.split(text, r"[\r\n]+"), bare), lambda x: x != "")


def _digest(line: Column) -> Column:
    return F.unhex(F.md5(line.cast("binary")))


def boilerplate(pages: DataFrame, ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """(host, drop): digests of the lines to drop. pages: host, lines."""
    total = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    n = pages.select("host", F.explode(F.array_distinct(F.transform("lines", _digest))).alias("digest")).groupBy("host", "digest").agg(F.count(F.lit(1)).alias("n"))
    often = n.where(F.col("n") >= least)  # drops most rows before the join
    return often.join(total, "host").where(F.col("n") > F.lit(ratio) * F.col("pages")).groupBy("host").agg(F.collect_list("digest").alias("drop"))


def line_dedup(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """id, host, n_lines and kept (array of lines) of every page."""
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), host(F.col(f"`{url_col}`")).alias("host"), lines(F.col(f"`{html_col}`")).alias("lines"))
    rows = materialize(rows, "lines")  # pages are parsed once
    drop = materialize(boilerplate(rows, ratio, least), "boilerplate")
    if written_bytes(drop) * 4 <= BROADCAST_LIMIT:
        joined = rows.join(F.broadcast(drop), "host", "left")
    else:
        salted = rows.withColumn("salt", F.pmod(F.xxhash64("id", "lines"), F.lit(SALTS)))
        joined = salted.join(drop.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["host", "salt"], "left")
    kept = F.when(F.col("drop").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains(F.col("drop"), _digest(x))))
    return joined.select(F.col("id").alias(id_col), "host", F.size("lines").cast("long").alias("n_lines"), kept.alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: every page of `pages` with what is left of it."""
    return line_dedup(table(spark, sf_dir, "pages")).select(
        "page_id", "host", "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_dropped"), F.sha2(F.array_join("kept", "\n").cast("binary"), 256).alias("kept_sha256"))


SQL = rf"""
WITH p AS (
    SELECT page_id, row_number() OVER () AS rid, lower(regexp_extract(coalesce(url, ''), '{HOST}', 1)) AS host,
        list_filter(list_transform(regexp_split_to_array(coalesce(html, ''), '{BREAKS}'),
            lambda x: regexp_replace(regexp_replace(x, '{TAGS}', '', 'g'), '^[\x20\t]+|[\x20\t]+$', '', 'g')), lambda x: x <> '') AS lines
    FROM pages),
t AS (SELECT host, count(*) AS pages FROM p GROUP BY host),
n AS (SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM p) GROUP BY host, line),
d AS (
    SELECT host, list(line) AS gone FROM n JOIN t USING (host)
    WHERE n >= {LEAST} AND n > {RATIO} * pages GROUP BY host),
k AS (
    SELECT page_id, host, len(lines) AS n_lines, list_filter(lines, lambda x: NOT list_contains(coalesce(gone, []), x)) AS kept
    FROM p LEFT JOIN d USING (host))
SELECT page_id, host, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_lines - len(kept) AS BIGINT) AS n_dropped, sha256(array_to_string(kept, chr(10))) AS kept_sha256
FROM k
"""
