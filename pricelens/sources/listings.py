"""Listing sources (S1-S6): raw JSON arrays, processed CSV, fallbacks.

Raw dumps are one JSON array per file, named ``<EventName><yyMMdd>.json``.
The scan is a normal Spark file source, so files are split across tasks and
the schema is given, never inferred.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import suppress

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from ..schema import PROCESSED_CSV_SCHEMA, RAW_LISTING_SCHEMA

JSON_GLOB = "*.[jJ][sS][oO][nN]"
CORRUPT = "_corrupt_record"


# S2 / F4 -------------------------------------------------------------------
def with_file_keys(df: DataFrame, file_col: str = "_file") -> DataFrame:
    """``event_name`` and ``event_date`` from the file name (last six characters: yyMMdd)."""
    stem = F.regexp_replace(F.col(file_col), r"(?i)\.json$", "")
    return (df.withColumn("_stem", stem)
            .withColumn("event_name", S.file_event("_stem"))
            .withColumn("event_date", S.file_date("_stem"))
            .drop("_stem"))


# S1 ------------------------------------------------------------------------
def read_listing_json(spark: SparkSession, path: str, schema: T.StructType = RAW_LISTING_SCHEMA,
                      recursive: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of all ``.json`` files (any case) under ``path``.

    An empty array gives no rows; a file that is no JSON is one row of rejects (file, reason).
    """
    schema = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    r = (spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", JSON_GLOB)
         .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT))
    if recursive:
        r = r.option("recursiveFileLookup", True)
    df = r.json(path).withColumn("_file", F.col("_metadata.file_name"))
    any_value = F.coalesce(*[F.col(f.name).cast("string") for f in schema.fields[:-1]])
    # Spark refuses to read the corrupt-record column alone, so the test names the others too
    bad = F.col(CORRUPT).isNotNull() & ((F.col(CORRUPT) != "") | any_value.isNotNull())
    rejects = df.where(bad).select(F.url_decode("_file").alias("file"), F.when(any_value.isNull(), "unparsable").otherwise("partly unparsable").alias("reason"))
    return with_file_keys(df.where(~bad).drop(CORRUPT)).drop("_file"), rejects


_NO_NAME = "__HIVE_DEFAULT_PARTITION__"  # Spark's folder name for null and empty values
_ESCAPED = re.compile("[\x01-\x1f\x7f\"#%'*/:=?\\\\{\\[\\]^]")  # as in names of Spark's partition folders


def _write_files(folder: str):
    """A task's rows, sorted by file, written as one stream per file. A file is named once it is whole, so a task that is run again does no harm."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, name, out, ends = f"{folder}/_part-{uuid.uuid4().hex}", None, None, set()

        def close() -> None:
            if False in ends and True not in ends:  # neither cut short nor without a mark
                out.write(b"]\n")
            out.close()
            called = _ESCAPED.sub(lambda m: f"%{ord(m[0]):02X}", name) + ".json"
            with suppress(FileNotFoundError):  # the checksum of an earlier file of that name
                os.unlink(f"{folder}/.{called}.crc")
            os.replace(part, f"{folder}/{called}")

        files = 0
        for rows in batches:
            names, values, broken = (rows[c].to_numpy() for c in ("_file", "value", "_cut"))
            edges = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1), len(names)] if len(names) else []
            for i, j in zip(edges, edges[1:]):
                if names[i] != name:
                    if out:
                        close()
                    name, out, ends, files, before = names[i], open(part, "wb"), set(), files + 1, b"[\n"
                else:
                    before = b","
                out.write(before + b"\n,".join(values[i:j]) + b"\n")
                ends.update(broken[i:j])
        if out:
            close()
        yield pd.DataFrame({"files": [files]})
    return run


def write_listing_json(rows: DataFrame, path: str, file_col: str, latin1: str | None = None, broken: str | None = None) -> None:
    """One JSON array per value of ``file_col``, in a file of that name with ``.json``. Rows are written in Latin-1 where
    the column ``latin1`` holds, and files with a row where the column ``broken`` holds lack their end.

    A file's rows are written as lines by one task, as a stream: an opening bracket, the objects, a closing one. In a folder
    that tasks reach by its path they write the named files themselves; in other stores Spark's text sink writes them, a folder
    each, and the driver names them one by one.
    """
    spark = rows.sparkSession
    line = F.to_json(F.struct(*[c for c in rows.columns if c not in (file_col, latin1, broken)]), {"ignoreNullFields": "false"}).cast("binary")
    if latin1:
        line = F.when(F.col(latin1), F.encode(line.cast("string"), "ISO-8859-1")).otherwise(line)
    cut = F.col(broken) if broken else F.lit(False)
    name = F.coalesce(F.nullif(F.col(file_col).cast("string"), F.lit("")), F.lit(_NO_NAME))
    lines = rows.select(name.alias("_file"), line.alias("value"), cut.alias("_cut"))
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    where = fs.makeQualified(top).toUri()
    if where.getScheme() != "file":
        return _write_by_sink(lines, fs, path)
    fs.mkdirs(top)
    written = lines.repartition("_file").sortWithinPartitions("_file").mapInPandas(_write_files(where.getPath()), "files long")
    written.write.format("noop").mode("overwrite").save()


def _write_by_sink(lines: DataFrame, fs, path: str) -> None:
    """The same files by Spark's text sink, for stores that only Spark reaches. The sink writes a string's bytes as they are."""
    lines = lines.select("_file", F.lit(1).alias("_part"), F.col("value").cast("string").alias("value"), "_cut")
    names = lines.groupBy("_file").agg(F.bool_or("_cut").alias("_cut"))
    ends = [names.select("_file", F.lit(0).alias("_part"), F.lit("[").alias("value")),
            names.where(~F.col("_cut")).select("_file", F.lit(2).alias("_part"), F.lit("]").alias("value"))]
    after = F.lag("_part").over(Window.partitionBy("_file").orderBy("_part"))
    whole = lines.drop("_cut").unionByName(ends[0]).unionByName(ends[1]).withColumn("_after", after)
    comma = F.when((F.col("_part") == 1) & (F.col("_after") == 1), F.lit(",")).otherwise(F.lit(""))
    whole = whole.select(F.concat(comma, F.col("value")).alias("value"), "_file")
    folder = f"{path.rstrip('/')}/_lines"  # not seen by readers, which skip names that begin with _
    whole.write.partitionBy("_file").text(folder)
    of = lines.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path
    for status in fs.globStatus(of(f"{folder}/_file=*/part-*")):
        name = status.getPath().getParent().getName().split("=", 1)[1]
        fs.rename(status.getPath(), of(path, f"{name}.json"))


# S3 ------------------------------------------------------------------------
def read_listing_json_any_encoding(spark: SparkSession, path: str,
                                   schema: T.StructType = RAW_LISTING_SCHEMA) -> tuple[DataFrame, DataFrame]:
    """Files in UTF-8, or Latin-1 when not valid UTF-8; unparsable files go to a reject table.

    Returns (rows, rejects). Each file is one binary record, decoded and
    parsed with ``from_json`` inside the task that reads it.
    """
    raw = (spark.read.format("binaryFile").option("pathGlobFilter", JSON_GLOB).load(path)
           .select(F.regexp_extract("path", r"([^/]+)$", 1).alias("_file"), "content"))
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.decode("content", "UTF-8")) \
        .otherwise(F.decode("content", "ISO-8859-1"))
    parsed = raw.select("_file", text.alias("_text")).withColumn(
        "_rows", F.from_json("_text", T.ArrayType(schema), {"mode": "PERMISSIVE"}))
    rejects = parsed.where(F.col("_rows").isNull()).select(F.col("_file").alias("file"), F.lit("unparsable").alias("reason"))
    rows = parsed.where(F.col("_rows").isNotNull()).select("_file", F.explode("_rows").alias("r")).select("_file", "r.*")
    return with_file_keys(rows).drop("_file"), rejects


# S4 ------------------------------------------------------------------------
def read_listing_csv(spark: SparkSession, path: str, schema: T.StructType = PROCESSED_CSV_SCHEMA) -> DataFrame:
    """Processed listings CSV with a header; the duplicate month column is dropped."""
    df = spark.read.schema(schema).option("header", True).csv(path)
    drop = [c for c in df.columns if c.endswith("_DUP")]
    out = df.drop(*drop)
    for c in ("event_date", "listing_time"):
        if c in out.columns:
            out = out.withColumn(c, S.parse_or_null(c))
    return out


# S5 ------------------------------------------------------------------------
def read_or_default(spark: SparkSession, reader: Callable[[], DataFrame], default_rows: Sequence[tuple],
                    schema: T.StructType | str) -> DataFrame:
    """``reader()``, or a table of ``default_rows`` when the source path does not exist."""
    try:
        df = reader()
        df.schema  # resolve now, so a missing path fails here
        return df
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e) and "Path does not exist" not in str(e):
            raise
        return spark.createDataFrame(list(default_rows), schema)


# S6 ------------------------------------------------------------------------
def coalesce_listing_time(df: DataFrame, fallback: str = "created_at") -> DataFrame:
    """Use ``fallback`` as ``listing_time`` when the latter is absent; fail when both are."""
    if "listing_time" in df.columns:
        return df
    if fallback in df.columns:
        return df.withColumn("listing_time", F.col(fallback))
    raise ValueError(f"listings need a listing time: neither 'listing_time' nor {fallback!r} is a column")
