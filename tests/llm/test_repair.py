"""Conversation repair against a search over all edits, and the comparison of audits against plain strings."""

import hashlib
import itertools
import random
import re
import zlib

from pyspark.sql import functions as F

from pricelens.llm import queries, repair

TURNS = "conv_id long, turn long, role string, text string"
ROLE = {"u": "user", "a": "assistant"}


def faults(rows):
    out = []
    for i, (role, text) in enumerate(rows):
        seen = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not seen else "duplicate" if (role, text) in rows[:i] else "truncated" if seen[-1] not in ".!?" else "")
    return out


def brute_repair(rows):
    """Cheapest cost, then least audit, over every choice of edits; at most two insertions side by side."""
    marks, best = faults(rows), None
    choices = []
    for (role, _), mark in zip(rows, marks):
        own = [("D", 4, "")]
        if mark not in ("blank", "duplicate"):
            more = 3 * (mark == "truncated")
            own += [("K", more, role[:1] or "?")] + [("R", 3 + more, r) for r in "ua"]
        choices.append(own)
    inserts = ["", "u", "a", "ua", "au"]
    for edits in itertools.product(*choices):
        for gaps in itertools.product(inserts, repeat=len(rows) + 1):
            roles = gaps[0] + "".join(e[2] + g for e, g in zip(edits, gaps[1:]))
            if re.fullmatch("(s?(ua)+)?", roles):
                audit = "I" * len(gaps[0]) + "".join(e[0] + "I" * len(g) for e, g in zip(edits, gaps[1:]))
                cost = sum(e[1] for e in edits) + 3 * sum(map(len, gaps))
                if best is None or (cost, audit) < best[:2]:
                    said, left, spoken = [], iter(zip(rows, edits)), []
                    for g, e in itertools.zip_longest(gaps, edits):
                        spoken += [ROLE[r] + ":" for r in g]
                        if e:
                            row, _ = next(left)
                            spoken += [] if e[0] == "D" else [f"{row[0] if e[0] == 'K' else ROLE[e[2]]}:{row[1]}"]
                    best = cost, audit, spoken
    return best


def random_rows(rng, n):
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", " ", "ursula"]
    return [(rng.choice(roles), rng.choice(["a.", "b!", "c", " ", "", "d?\n", f"{rng.random()}."])) for _ in range(n)]


def test_edits_against_all_choices():
    rng = random.Random(11)
    for case in range(90):
        rows = random_rows(rng, rng.choice([0, 1, 2, 3]))
        one = repair.Repair(modulus=rng.choice([repair.MODULUS, 3, 1]))  # small moduli: most hashes are equal
        for i, (role, text) in enumerate(rows):
            one.add(i, role, text)
        got = one.result()
        cost, audit, spoken = brute_repair(rows)
        assert (got["cost"], got["audit"], [f"{m['role']}:{m['text']}" for m in got["messages"]]) == (cost, audit, spoken), rows


def plain_repair(rows):
    """The same search with whole strings in place of nodes."""
    best = {"": (0, "")}
    legal = {"": "su", "s": "u", "u": "a", "a": "u"}

    def put(to, state, value):
        to[state] = min(to.get(state, value), value)

    def insert(best):
        for state in ("", "s", "a", "u"):
            if state in best:
                cost, audit = best[state]
                put(best, legal[state][-1], (cost + 3, audit + "I"))
        return best

    insert(best)
    for (role, _), mark in zip(rows, faults(rows)):
        new = {}
        for state, (cost, audit) in best.items():
            put(new, state, (cost + 4, audit + "D"))
            if mark not in ("blank", "duplicate"):
                more = 3 * (mark == "truncated")
                if role[:1] and role[:1] in legal[state]:
                    put(new, role[:1], (cost + more, audit + "K"))
                for r in set(legal[state]) & set("ua"):
                    put(new, r, (cost + 3 + more, audit + "R"))
        best = insert(new)
    return min(v for s, v in best.items() if s in ("", "a"))


def test_long_conversations_against_whole_strings():
    rng = random.Random(12)
    for n in [5, 17, 64, 200, 600] * 6:
        rows = random_rows(rng, n)
        for modulus in (repair.MODULUS, 97):
            one = repair.Repair(modulus)
            for i, (role, text) in enumerate(rows):
                one.add(i, role, text)
            got = one.result()
            assert (got["cost"], got["audit"]) == plain_repair(rows)


def test_comparison_of_audits():
    rng = random.Random(13)
    for modulus in (repair.MODULUS, 5, 1):
        nodes = {"": repair.NO_EDITS}
        while len(nodes) < 400:
            s = rng.choice(list(nodes)) + rng.choice("DIKR")
            nodes[s] = nodes.get(s) or repair.grow(nodes[s[:-1]], s[-1], modulus)
        for _ in range(4000):
            a, b = rng.choice(list(nodes)), rng.choice(list(nodes))
            assert repair.less(nodes[a], nodes[b]) == (a < b) and repair.letters(nodes[a]) == a


def brute_damage(rows):
    """Conversation to rows (turn, role, text) left, in order."""
    out = {}
    space = lambda x: " " if x is None else x
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        kind = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        role, text = space(role), space(text)
        row = (turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
        kept += [row] * {0: 0, 3: 2}.get(kind, 1)
    first = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())
    return {c: sorted(k, key=first) for c, k in out.items()}


def test_query_rows(spark, tmp_path):
    rng = random.Random(14)
    rows = [(c, t, role, text + str(t % 5) + rng.choice(["", "."])) for c in range(120) for t, (role, text) in enumerate(random_rows(rng, rng.choice([1, 4, 9])))]
    rows += [(None, t, "user", f"{t}.") for t in (1, 2, 9, None)] + [(500, None, None, None), (501, 2, "assistant", None), (501, 2, "assistant", "é."), (501, -7, "user", "\U0001f600!")]
    rows += [(502, t, ("user", "assistant")[t % 2], "x." * 20_000 + str(t) + "!") for t in range(6)] + [(503, t, "user", "same.") for t in range(30)]
    rows += rows[:40]
    path = str(tmp_path / "sf")
    df = spark.createDataFrame(rows, TURNS).withColumn("lost", F.lit(True)).withColumn("audit", F.lit("clash"))
    df.repartition(5).write.parquet(path + "/conversations.parquet")
    got = {r.conv_id: r for r in queries.op13(spark, path).collect()}
    left = brute_damage(rows)
    assert set(got) == set(left) and any(not k for k in left.values())
    for conv, kept in left.items():
        r, said = got[conv], [(role, text) for _, role, text in kept]
        marks = faults(said)
        assert (r.blank, r.duplicate, r.truncated) == tuple(marks.count(m) for m in ("blank", "duplicate", "truncated"))
        turns = [t for t, _, _ in kept if t is not None]
        assert r.gaps == (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0)
        assert r.illegal == sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(said, said[1:]))
        assert (r.cost, r.audit) == plain_repair(said)
        spoken = "\n".join(f"{m['role']}:{m['text']}" for m in repair.replay(r.audit, said))
        assert r.repaired_sha256 == hashlib.sha256(spoken.encode()).hexdigest()


def test_repair_of_nothing(spark):
    df = spark.createDataFrame([(1, 0, "user", "hi.")], TURNS)
    assert repair.repair(df.limit(0)).collect() == []
    assert [tuple(r) for r in repair.repair(df, lost=F.lit(True)).collect()] == [(1, 0, 0, 0, 0, 0, 0, "", [])]
    assert [(r.cost, r.audit) for r in repair.repair(df).collect()] == [(3, "KI")]
