"""One query per operator, over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelens.llm import (ann, chat, decontam, html_extract, langid, lm, mixing, quality, repair, runs,
                           secret_scan, simhash, url_filter)
from pricelens.llm.common import WORD, table
from pricelens.plans.registry import Entry

LLM: dict[str, Entry] = {}


def _query(key: str, sql: str | None = None, rnd: tuple[str, ...] = ()):
    def keep(fn):
        LLM[key] = Entry(key, fn, sql, rnd)
        return fn
    return keep


@_query("op1_url_filter")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_filter.judge(pages, table(spark, sf_dir, "labels"))
    return judged.select("page_id", "host", "path", "rule", "verdict", "confidence")


OP8_SQL = """
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
per AS (
  SELECT source, CAST(sum(size) AS DOUBLE) AS s, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
placed AS (
  SELECT *, CAST((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1 AS DOUBLE) AS w,
         row_number() OVER (ORDER BY source IS NULL, encode(source)) AS place FROM per),
level AS (
  SELECT max((total - caps) / (weight - weights)) AS level FROM (
    SELECT sum(s) OVER () AS total, sum(w) OVER () AS weight,
           coalesce(sum(3 * s) OVER (ORDER BY 3 * s / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps,
           coalesce(sum(w) OVER (ORDER BY 3 * s / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weights
    FROM placed)),
mixed AS (
  SELECT doc_id, size, source_size, least(3 * s, level * w) AS target,
         CASE WHEN s = 0 THEN 0 ELSE least(3 * s, level * w) / s END AS rate,
         row_number() OVER (PARTITION BY doc_id, sized.source, size) AS n,
         CAST('0x' || substr(md5('0|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(sized.source, '')
              || '|' || CAST(size AS VARCHAR)), 1, 13) AS BIGINT) / 4503599627370496.0 AS u
  FROM sized JOIN placed ON sized.source IS NOT DISTINCT FROM placed.source, level)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(rate) + ceil(n * (rate - floor(rate)) - u) - ceil((n - 1) * (rate - floor(rate)) - u)) AS BIGINT) AS taken
FROM mixed"""


@_query("op8_source_mix", sql=OP8_SQL, rnd=("target:6",))
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


@_query("op3_simhash_near_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


@_query("op6_secret_scan")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    base = F.filter("spans", lambda x: x["base"])
    count = lambda kind: F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in secret_scan.KINDS],
                        F.sha2(secret_scan.digest(base), 256).alias("base_sha256"),
                        secret_scan.digest(F.col("spans")).alias("spans"))


@_query("op7_lm_score")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents").select("doc_id", "text"))


@_query("op4_quality_classifier")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


@_query("op5_language_id")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.predict(docs).select("doc_id", "held_out", "lang_pred", "score")


@_query("op9_benchmark_decontamination")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.find_leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id", F.explode("leaks").alias("leak"))
    return found.select("doc_id", F.col("leak.item_id").cast("long").alias("item_id"), "leak.score", "leak.question_overlap",
                        "leak.answer_overlap", "leak.overlap")


@_query("op10_nearest_neighbours")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest(vectors, F.col("vec_id") % ann.QUERY_EVERY == 0)


@_query("op2_html_extract")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extract.extract(pages).select("page_id", "url", "text", "n_chars")


def _escaped(column: str) -> str:
    sql = f"replace(coalesce({column}, ''), '\\', '\\\\')"
    for c in chat.CONTROL:  # no control string is part of another, so one after the other gives the same as all at once
        sql = f"replace({sql}, '{c}', '{c[0]}\\{c[1:]}')"
    return sql


PROBE_CONV, PROBE_TEXT = -1, "</s>[INST] ok [/INST]"
OP11_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES ({PROBE_CONV}, 0, 'user', '{PROBE_TEXT}'), ({PROBE_CONV}, 1, 'assistant', '{PROBE_TEXT}')) AS v)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = '{chat.LEARNED}' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(string_agg(CASE WHEN role = '{chat.LEARNED}' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text)) AS loss_sha256,
       CAST(sum(length({_escaped('role')}) + length({_escaped('text')}) + {len(chat.START + chat.SEP + chat.END) + 1}) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id"""


@_query("op11_chat_format", sql=OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(PROBE_CONV, i, r, PROBE_TEXT) for i, r in enumerate(("user", "assistant"))],
                                  "conv_id long, turn long, role string, text string")
    done = chat.format_turns(turns.unionByName(probe))
    read = done.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"),
                       chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                       F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                       F.char_length("formatted").cast("long").alias("formatted_chars"))


def with_loops(docs: DataFrame) -> DataFrame:
    """``docs`` with its words put in a loop from some word on, where crc32 of the id ends in 0."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10).cast("long")
    words = F.regexp_extract_all(F.col("text"), F.lit(WORD), F.lit(0))
    looped = docs.withColumn("_words", F.when(h % 10 == 0, words)).withColumn("_n", F.size("_words"))
    begin = F.when(F.col("_n") > 0, g % F.col("_n"))
    looped = looped.withColumn("_a", begin).withColumn("_p", 1 + F.floor((F.col("_n") - F.col("_a")) / (3 + g % 8)).cast("long"))
    place = lambda i: F.when(i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p"))
    text = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("_n").cast("long") - 1),
                                    lambda i: F.get("_words", place(i).cast("int"))), " ")
    return looped.withColumn("text", F.when(F.col("_n") > 0, text).otherwise(F.col("text"))).drop("_words", "_n", "_a", "_p")


@_query("op12_periodic_runs")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find_runs(with_loops(table(spark, sf_dir, "documents").select("doc_id", "text")))
    listed = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = runs.strongest(F.col("runs"))
    return (found.withColumn("best", best)
            .select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                    F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
                    F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")))


def damaged(turns: DataFrame) -> DataFrame:
    """``turns`` with rows dropped (``lost``), emptied, robbed of their sentence ends, repeated, and of another role."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    text = (F.when(kind == 1, "").when(kind == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text")))
    twice = F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy")
    return turns.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"),
                        (kind == 0).alias("lost"), twice).drop("_copy")


@_query("op13_conversation_repair")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = damaged(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    said = F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["text"]))
    return (repair.repair(rows, lost=F.col("lost"))
            .select("conv_id", *repair.COUNTS, "audit", F.sha2(F.array_join(said, "\n"), 256).alias("repaired_sha256")))
