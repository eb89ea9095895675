"""Where documents come from: files, string columns, rows of chunks."""

from __future__ import annotations

import re
from tempfile import gettempdir
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNKS = "doc_id bigint, chunk_seq bigint, bytes binary, is_last boolean"


def decoded(content: Column, encoding: str = "utf-8") -> Column:
    """Text of bytes. Bytes that are no UTF-8 become U+FFFD; a byte order mark is dropped; what the XML declaration says does not count."""
    if encoding.lower().replace("-", "").replace("_", "") == "utf8":
        x = F.make_valid_utf8(content.cast("string"))
    else:
        x = F.decode(content, encoding)
    return F.when(F.startswith(x, F.lit("﻿")), F.substring(x, F.lit(2), F.length(x))).otherwise(x)


def read_files(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """(doc_id, path, xml): a document a file; doc_id is a hash of the path."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.xxhash64("path").alias("doc_id"), "path", decoded(F.col("content"), encoding).alias("xml"))


def read_records(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    """Repeated elements of large files, which are split among tasks. Give all columns as strings; order and mixed text are lost."""
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def chunks(docs: DataFrame, size: int, id_col: str = "doc_id", xml_col: str = "xml") -> DataFrame:
    """Documents as rows of `size` bytes; characters may be cut."""
    data = F.coalesce(F.col(xml_col), F.lit("")).cast("binary")
    n = F.greatest(F.ceil(F.octet_length(data) / F.lit(size)), F.lit(1)).cast("int")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), data.alias("data"), n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    return rows.select("doc_id", F.col("i").cast("long").alias("chunk_seq"), F.substring("data", F.col("i") * size + 1, F.lit(size)).alias("bytes"), (F.col("i") == F.col("n") - 1).alias("is_last"))


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, for files that driver and executors share. Only where all run in one process may that be unset."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{(at or gettempdir()).rstrip('/')}/tagloom-{uuid4().hex}"


def stored(rows: DataFrame) -> DataFrame:
    """The same rows, computed once: they are written to Parquet files in a shared folder, where they stay, and read from there."""
    at = f"{shared_folder(rows.sparkSession)}/rows"
    rows.write.parquet(at)
    return rows.sparkSession.read.schema(rows.schema).parquet(at)


def read_chunk_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream of chunk rows from Parquet files."""
    return spark.readStream.schema(CHUNKS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
