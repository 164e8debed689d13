"""Result sinks and scans.

Results are tables in long form (model, split, metric, value), written as
Parquet/CSV or as the nested JSON documents the dashboard reads. The nested
documents are built with ``map_from_entries(collect_list(...))`` over the
long tables, whose size is models x splits x metrics (or x features, x days):
small, bounded by the model catalogue, not by the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

METRICS_DOC = T.MapType(T.StringType(), T.MapType(T.StringType(), T.MapType(T.StringType(), T.DoubleType())))
IMPORTANCE_DOC = T.MapType(T.StringType(), T.MapType(T.StringType(), T.DoubleType()))
PROBABILITY_DOC = T.MapType(T.StringType(), T.StructType([
    T.StructField("days_until_event", T.ArrayType(T.IntegerType())),
    T.StructField("mean_probability", T.ArrayType(T.DoubleType())),
    T.StructField("std_probability", T.ArrayType(T.DoubleType())),
    T.StructField("count", T.ArrayType(T.LongType())),
]))


# S7 ------------------------------------------------------------------------
def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] | None = None,
                mode: str = "overwrite") -> None:
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


# S8 ------------------------------------------------------------------------
def _nest(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Fold the last key into a map, one level at a time: keys[:-1] + map(keys[-1] -> value)."""
    *outer, inner = keys
    return df.groupBy(*outer).agg(F.map_from_entries(F.collect_list(F.struct(inner, value))).alias(value))


def metrics_document(metrics_long: DataFrame) -> DataFrame:
    """(model, split, metric, value) -> one row with the JSON text model -> split -> metric -> value."""
    d = _nest(metrics_long, ["model", "split", "metric"], "value")
    d = _nest(d, ["model", "split"], "value")
    d = _nest(d, ["model"], "value")
    return d.select(F.to_json("value").alias("value"))


def importance_document(imp: DataFrame) -> DataFrame:
    """(model, feature, importance) -> JSON text model -> feature -> importance."""
    d = _nest(imp, ["model", "feature"], "importance")
    d = _nest(d, ["model"], "importance")
    return d.select(F.to_json("importance").alias("value"))


def probability_document(curve: DataFrame) -> DataFrame:
    """(model, day, mean, std, count) -> JSON text model -> parallel arrays sorted by day."""
    s = F.array_sort(F.collect_list(F.struct("days_until_event", "mean_probability", "std_probability", "count")))
    per = curve.groupBy("model").agg(s.alias("a")).select(
        "model", F.struct(F.col("a.days_until_event").alias("days_until_event"),
                          F.col("a.mean_probability").alias("mean_probability"),
                          F.col("a.std_probability").alias("std_probability"),
                          F.col("a.count").alias("count")).alias("v"))
    return per.agg(F.map_from_entries(F.collect_list(F.struct("model", "v"))).alias("m")).select(
        F.to_json("m").alias("value"))


def write_document(doc: DataFrame, path: str) -> None:
    """Write a one-row ``value`` text column as a single file (the document is small)."""
    doc.coalesce(1).write.mode("overwrite").text(path)


# S9 ------------------------------------------------------------------------
def upsert(old: DataFrame, new: DataFrame, key: Sequence[str] | str) -> DataFrame:
    """Replace the rows of ``old`` whose key is in ``new``; keep the others; add new keys."""
    k = [key] if isinstance(key, str) else list(key)
    return old.join(new.select(*k), k, "left_anti").unionByName(new, allowMissingColumns=True)


VERSION = "version-"


def _folder(spark: SparkSession, path: str) -> str:
    """Where versions are kept: ``path``, or a folder beside it where ``path`` is a plain file."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return path.rstrip("/") + (".versions" if fs.exists(at) and fs.getFileStatus(at).isFile() else "")


def _versions(spark: SparkSession, path: str) -> list[tuple[int, str, bool]]:
    """(number, folder, whether its write was finished) of the versions under ``path``, in order."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(_folder(spark, path))
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    found = []
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if status.isDirectory() and name.startswith(VERSION):
            done = fs.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS"))
            found.append((int(name[len(VERSION):]), status.getPath().toString(), done))
    return sorted(found)


def current_version(spark: SparkSession, path: str) -> str:
    """The folder of the last version whose write was finished; ``path`` itself before the first one."""
    done = [folder for _, folder, ok in _versions(spark, path) if ok]
    return done[-1] if done else path


def commit_documents(docs: DataFrame, path: str, keep: int = 2) -> str:
    """Write (key, doc) rows as the next version of the document under ``path``, and return its folder.

    A version counts once Spark has set its mark of success, the last thing a write does. A driver or a write that is lost
    before that leaves a folder that no reader looks at, and the version before it stays the current one. ``docs`` may read the
    current version. The last ``keep`` finished versions are kept for readers that are still at them; older ones go.
    """
    spark = docs.sparkSession
    before = _versions(spark, path)
    number = before[-1][0] + 1 if before else 1  # also past unfinished ones
    folder = f"{_folder(spark, path)}/{VERSION}{number:010d}"
    write_document(documents_json(docs), folder)
    jvm = spark.sparkContext._jvm
    done = [(n, f) for n, f, ok in before if ok] + [(number, folder)]
    for n, old, _ in before:
        if n < done[-keep:][0][0]:
            target = jvm.org.apache.hadoop.fs.Path(old)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    return folder


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object file, or its current version, as (key, doc) rows; an absent or broken file counts as empty."""
    empty = spark.createDataFrame([], "key string, doc string")
    try:
        txt = spark.read.text(current_version(spark, path), wholetext=True)
        m = txt.select(F.from_json("value", T.MapType(T.StringType(), T.StringType())).alias("m"))
        out = m.where(F.col("m").isNotNull()).select(F.explode("m").alias("key", "doc"))
        out.schema
        return out
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return empty


def documents_json(docs: DataFrame) -> DataFrame:
    """(key, doc) rows back to one JSON object text; ``doc`` holds the JSON text of each value.

    Each member is written as ``"<key>": <doc>``; the key is quoted and escaped
    by ``to_json`` of a one-element array (``["k"]`` minus its brackets).
    """
    quoted = F.expr("substring(to_json(array(key)), 2, length(to_json(array(key))) - 2)")
    members = F.array_sort(F.collect_list(F.concat(quoted, F.lit(":"), F.col("doc"))))
    return docs.agg(F.concat(F.lit("{"), F.concat_ws(",", members), F.lit("}")).alias("value"))


# S10 -----------------------------------------------------------------------
def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Metrics document to (model, split, metric, value)."""
    txt = spark.read.text(path, wholetext=True)
    m = txt.select(F.from_json("value", METRICS_DOC).alias("m"))
    return (m.select(F.explode("m").alias("model", "s"))
            .select("model", F.explode("s").alias("split", "x"))
            .select("model", "split", F.explode("x").alias("metric", "value")))


def read_importances(spark: SparkSession, path: str) -> DataFrame:
    txt = spark.read.text(path, wholetext=True)
    m = txt.select(F.from_json("value", IMPORTANCE_DOC).alias("m"))
    return m.select(F.explode("m").alias("model", "f")).select("model", F.explode("f").alias("feature", "importance"))


def read_probabilities(spark: SparkSession, path: str) -> DataFrame:
    """Parallel arrays per model to (model, days_until_event, mean, std, count) rows."""
    txt = spark.read.text(path, wholetext=True)
    m = txt.select(F.from_json("value", PROBABILITY_DOC).alias("m"))
    z = m.select(F.explode("m").alias("model", "v")).select(
        "model", F.arrays_zip("v.days_until_event", "v.mean_probability", "v.std_probability", "v.count").alias("z"))
    return z.select("model", F.inline("z"))
