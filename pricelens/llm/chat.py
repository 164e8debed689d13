"""Chat formatting: event logs folded into final messages, then rendered with a reversible template and a loss mask.

A log has one row per event, in order of ``seq`` within its conversation:

* ``message`` opens a message named ``msg`` with a role and the text so far;
* ``delta`` appends its text to the latest message of that name;
* ``edit`` replaces that message's text, and what follows stays;
* ``regenerate`` replaces that message's text (by what its deltas then stream in) and takes back all messages
  opened since.

The fold is stated without a loop: each event belongs to the latest opening of its name, a message's text is
what its last replacing event and the deltas after it hold, and a message goes if an earlier one was
regenerated after its opening. Logs are dealt by conversation once, and every later step keeps that dealing;
sorts spill. A rendered conversation is one value, so one conversation has to fit a row. DataFrame functions only.

Template: ``<|im_start|>role<|im_sep|>text<|im_end|>`` and a line end per message. In roles and texts every
backslash is doubled and every control string gets a backslash behind its first character, so that none is left
and ``unescape`` gives back the text. The loss mask is a list of byte ranges in the UTF-8 of the output, one per
message of the learned role, without markers.

Defined cases: a null text, role or message name is empty (a null name is a name of its own); events of one
``seq`` are taken openings first, then by name, role and text; rows of an unknown kind and events
without an opened message have no effect; a null conversation is one of its own; repeated rows are events of their
own; a message with empty text has an empty range; conversations without a message left, and empty tables, give no row.
Only the named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MESSAGE, DELTA, EDIT, REGENERATE = KINDS = ("message", "delta", "edit", "regenerate")
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: strings that tokenizers of common chat templates read as control tokens
CONTROL = (START, SEP, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
LEARNED = "assistant"
PIECE = 1024  # code points of one streamed delta in ``log_of_turns``


def escape(text: Column, control: Sequence[str] = CONTROL) -> Column:
    heads: dict[str, list[str]] = {}
    for c in control:
        heads.setdefault(c[0], []).append(c[1:])
    pattern = "|".join(re.escape(h) + "(?=" + "|".join(map(re.escape, rest)) + ")" for h, rest in heads.items())
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), pattern, r"$0\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def reconstruct(log: DataFrame) -> DataFrame:
    """(conv_id, place, role, text) of the final messages, from (conv_id, seq, kind, msg, role, text)."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    events = (log.filter(F.col("kind").isin(*KINDS))
              .select("conv_id", "seq", "kind", "msg", empty("role"), empty("text")))
    in_log = Window.partitionBy("conv_id").orderBy(F.col("seq").asc_nulls_first(), F.col("kind") != MESSAGE, "msg", "role",
                                                   F.array_position(F.lit(list(KINDS)), F.col("kind")), "text")
    events = events.withColumn("at", F.row_number().over(in_log))
    so_far = Window.partitionBy("conv_id", "msg").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    opening = F.last(F.when(F.col("kind") == MESSAGE, F.col("at")), ignorenulls=True).over(so_far)
    events = events.withColumn("place", opening).filter(F.col("place").isNotNull())
    latest = lambda *kinds: F.max(F.when(F.col("kind").isin(*kinds), F.col("at")))
    folded = events.groupBy("conv_id", "place").agg(
        latest(MESSAGE, EDIT, REGENERATE).alias("whole"), latest(REGENERATE).alias("again"),
        F.max(F.when(F.col("kind") == MESSAGE, F.col("role"))).alias("role"),
        F.sort_array(F.collect_list(F.struct("at", "text"))).alias("parts"))
    live = F.filter("parts", lambda p: p["at"] >= F.col("whole"))
    folded = folded.withColumn("text", F.array_join(F.transform(live, lambda p: p["text"]), ""))
    earlier = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    taken_back = F.coalesce(F.max("again").over(earlier) > F.col("place"), F.lit(False))
    return (folded.withColumn("taken_back", taken_back).filter(~F.col("taken_back"))
            .select("conv_id", "place", "role", "text"))


def render(messages: DataFrame, learned: str = LEARNED) -> DataFrame:
    """(conv_id, formatted, loss_spans) from (conv_id, place, role, text); spans are byte ranges, end exclusive."""
    pieces = messages.select("conv_id", "place", "role", F.concat(F.lit(START), escape(F.col("role")), F.lit(SEP)).alias("head"),
                             escape(F.col("text")).alias("body"))
    pieces = pieces.withColumn("piece", F.concat("head", "body", F.lit(END + "\n")))
    earlier = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.coalesce(F.sum(F.octet_length("piece")).over(earlier), F.lit(0)) + F.octet_length("head")
    pieces = pieces.withColumn("begin", begin.cast("long"))
    span = F.when(F.col("role") == learned, F.struct(F.col("begin").alias("start"),
                                                     (F.col("begin") + F.octet_length("body")).alias("end")))
    row = F.struct("place", "piece", span.alias("span"))
    whole = pieces.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    spans = F.filter(F.transform("rows", lambda r: r["span"]), lambda s: s.isNotNull())
    return whole.select("conv_id", F.array_join(F.transform("rows", lambda r: r["piece"]), "").alias("formatted"),
                        spans.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """Roles and texts of a rendered conversation, as an array of structs."""
    quoted = lambda s: "\\Q" + s + "\\E"
    blocks = F.split(formatted, quoted(START))
    return F.transform(F.slice(blocks, F.lit(2), F.size(blocks)), lambda b: F.transform(
        F.array(F.split(b, quoted(SEP), 2)), lambda p: F.struct(
            unescape(p[0]).alias("role"), unescape(F.substring_index(p[1], END, 1)).alias("text")))[0])


def read_loss(formatted: Column, spans: Column) -> Column:
    """Texts under the loss mask, unescaped, one after the other."""
    part = lambda raw, s: unescape(F.substring(raw, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")).cast("string"))
    # the bytes are an element of an array, so that they are made once and not per span
    return F.array_join(F.transform(F.array(formatted.cast("binary")), lambda raw: F.transform(spans, lambda s: part(raw, s)))[0], "")


def log_of_turns(turns: DataFrame, streamed: str = LEARNED, piece: int = PIECE) -> DataFrame:
    """The log that leads to (conv_id, turn, role, text): each row opens a message, and those of the streamed
    role receive their text in deltas. Rows of one turn are taken by role and text, nulls first."""
    order = Window.partitionBy("conv_id").orderBy(*[F.col(c).asc_nulls_first() for c in ("turn", "role", "text")])
    rows = turns.select("conv_id", "turn", "role", "text").withColumn("msg", F.row_number().over(order))
    deltas = F.concat(F.array(F.lit("")), F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("(?s).{1,%d}" % piece), F.lit(0)))
    pieces = F.when(F.col("role") == streamed, deltas).otherwise(F.array("text"))
    return (rows.select("conv_id", "msg", "role", F.posexplode(pieces).alias("n", "text"))
            .select("conv_id", F.struct("msg", "n").alias("seq"), F.when(F.col("n") == 0, MESSAGE).otherwise(DELTA).alias("kind"),
                    "msg", "role", "text"))


def format_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans) of a table of turns, by way of its log."""
    return render(reconstruct(log_of_turns(turns)))
