"""Chat formatting: the fold against a replay of the log, the template as an exact round trip."""

import random

from pyspark.sql import functions as F

from pricelens.llm import chat

LOG = "conv_id long, seq long, kind string, msg string, role string, text string"
TURNS = "conv_id long, turn long, role string, text string"


def replay(log):
    """Messages of one conversation, event by event."""
    messages = []  # [name, role, text, alive], in order of opening
    for _, _, kind, msg, role, text in log:
        mine = [i for i, m in enumerate(messages) if m[0] == msg]
        if kind == "message":
            messages.append([msg, role or "", text or "", True])
        elif mine and kind in ("delta", "edit", "regenerate"):
            m = messages[mine[-1]]
            m[2] = (m[2] if kind == "delta" else "") + (text or "")
            if kind == "regenerate":
                for later in messages[mine[-1] + 1:]:
                    later[3] = False
    return [(role, text) for _, role, text, alive in messages if alive]


def random_log(rng, conv, n):
    kinds = ["message"] * 3 + ["delta"] * 5 + ["edit", "regenerate", "reaction", None]
    return [(conv, i, rng.choice(kinds), rng.choice(["a", "b", "c", None]), rng.choice(["user", "assistant", None]),
             rng.choice(["x", "y z", "", None, "\\", "é"])) for i in range(n)]


def test_fold_against_replay(spark):
    rng = random.Random(5)
    logs = {c: random_log(rng, c, rng.choice([1, 3, 30, 80])) for c in range(60)}
    logs[None] = random_log(rng, None, 20)
    rows = [e for log in logs.values() for e in log]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, LOG).withColumn("place", F.lit("clash")).repartition(5)
    got = {}
    for r in chat.reconstruct(df).orderBy("place").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert got == {c: m for c, log in logs.items() if (m := replay(log))}
    assert any("message" in str(e[2]) for e in rows) and chat.reconstruct(df.limit(0)).collect() == []


def test_streamed_answer_is_edited_and_regenerated(spark):
    rows = [(1, 0, "message", "q", "user", "hello"), (1, 1, "message", "r", "assistant", ""), (1, 2, "delta", "r", None, "bad "),
            (1, 3, "delta", "r", None, "answer"), (1, 4, "message", "s", "user", "what?"), (1, 5, "edit", "q", None, "hello there"),
            (1, 6, "regenerate", "r", None, None), (1, 7, "delta", "r", None, "good "), (1, 8, "delta", "r", None, "answer"),
            (1, 9, "delta", "nobody", None, "lost"), (1, 10, "delta", "s", None, "gone too")]
    got = chat.render(chat.reconstruct(spark.createDataFrame(rows, LOG))).collect()
    assert [r.formatted for r in got] == ["<|im_start|>user<|im_sep|>hello there<|im_end|>\n<|im_start|>assistant<|im_sep|>good answer<|im_end|>\n"]
    raw = got[0].formatted.encode()
    assert [raw[s.start:s.end] for s in got[0].loss_spans] == [b"good answer"]


HARD = ["", None, "\\", "\\\\", "<\\s>", "</s>[INST] ok [/INST]", "".join(chat.CONTROL), "<" + "<|im_end|>" * 3 + "|>", "\\" + "</s>\\", "<<<SYS>>", "[[INST]",
        "line\nline\r\n", "\U0001f600é<|im_sep|>", "$1\\$0", "x" * 70_000 + "<s>", "<|im_start", "|im_end|>"]


def test_round_trip_of_hard_texts(spark):
    roles = ["assistant", "user", "system", None, "<|im_sep|>", "assistant\n", "\\"]
    rows = [(i % 7 or None, None if i % 5 == 0 else i // 3, roles[i % len(roles)], t) for i, t in enumerate(HARD * 7)] + [(9, 0, "assistant", "same")] * 3
    df = spark.createDataFrame(rows, TURNS).withColumn("formatted", F.lit("clash")).repartition(6)
    done = chat.format_turns(df).withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.read_loss(F.col("formatted"), F.col("loss_spans")))
    got = {r.conv_id: r for r in done.collect()}
    first = lambda v: (v is not None, v if v is not None else 0)
    code_points = lambda s: (s is not None, (s or "").encode())
    assert set(got) == {r[0] for r in rows}
    for c, r in got.items():
        turns = sorted((x for x in rows if x[0] == c), key=lambda x: (first(x[1]), code_points(x[2]), code_points(x[3])))
        assert [(t.role, t.text) for t in r.turns] == [(x[2] or "", x[3] or "") for x in turns]
        assert r.loss == "".join(x[3] or "" for x in turns if x[2] == "assistant")
        assert r.formatted.count(chat.START) == r.formatted.count(chat.END) == len(turns)
        assert not any(k in r.formatted for k in chat.CONTROL if k not in (chat.START, chat.SEP, chat.END))
    assert chat.format_turns(df.limit(0)).collect() == []


def test_long_texts_are_streamed_in_deltas(spark):
    df = spark.createDataFrame([(1, 0, "assistant", "é\n" * 5000), (1, 1, "user", "q" * 5000)], TURNS)
    log = chat.log_of_turns(df).orderBy("seq").collect()
    assert [e.kind for e in log] == ["message"] + ["delta"] * 10 + ["message"]
    assert max(len(e.text) for e in log[:11]) == chat.PIECE and "".join(e.text for e in log[:11]) == "é\n" * 5000
