"""Conversation repair against a table of all turns and states, and the registered query against plain Python."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from trustmill.llm import conversations, queries

SHAPE = re.compile("(s?(ua)+)?")
WHITE = " \t\n\x0b\x0c\r"


def faults(rows):
    """For (role, text) in order: first faults, and whether a turn must go."""
    seen, out = set(), []
    for role, text in rows:
        kept = (text or "").rstrip(WHITE)
        out.append("blank" if not kept else "duplicate" if (role, text) in seen else "truncated" if kept[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, repaired rows) by a full table over whole audits: one entry for each state after each turn."""
    after = lambda state, c: {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((state, c))
    word = {"u": "user", "a": "assistant"}

    def inserted(table):
        for _ in range(3):
            for state, (cost, audit, made) in list(table.items()):
                for c in "ua":
                    to = after(state, c)
                    if to is not None:
                        x = (cost + 2, audit + "I", [*made, (word[c], "")])
                        table[to] = min(table.get(to, x), x)
        return table

    table = {"": (0, "", [])}
    for (role, text), fault in zip(rows, faults(rows)):
        new = {}

        def put(to, x):
            new[to] = min(new.get(to, x), x)

        for state, (cost, audit, made) in inserted(table).items():
            put(state, (cost + 3, audit + "D", made))
            if fault in ("blank", "duplicate"):
                continue
            more = cost + (fault == "truncated")
            if role and after(state, role[0]) is not None:
                put(after(state, role[0]), (more, audit + "K", [*made, (role, text)]))
            for c in "ua":
                if after(state, c) is not None:
                    put(after(state, c), (more + 2, audit + "R", [*made, (word[c], text)]))
        table = new
    return min(x for state, x in inserted(table).items() if state in ("", "a"))


def expected(rows):
    """The row of a report for (turn, role, text) in order."""
    plain = [(r, t) for _, r, t in rows]
    cost, audit, made = cheapest(plain)
    found = faults(plain)
    turns = [t for t, _, _ in rows if t is not None]
    initial = [r[:1] for r, _ in plain]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, **{k: found.count(k) for k in ("blank", "duplicate", "truncated")},
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initial)), "cost": cost, "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest(),
    }


def test_divide_and_conquer_finds_the_least_audit():
    r = random.Random(3)
    for _ in range(400):
        rows = [(r.choice(["system", "user", "assistant", "tool", ""]), r.choice(["a.", "b.", "c", "d!", "", " "]) + str(k) * r.choice([0, 1]) + r.choice(["", "."])) for k in range(r.randint(1, 14))]
        fault = faults(rows)
        codes = bytes(("sua".find(role[0]) % 4 if role else 3) | (conversations.MUST_GO if f in ("blank", "duplicate") else 0) | (conversations.CUT if f == "truncated" else 0) for (role, _), f in zip(rows, fault))
        end = conversations.last_state(conversations.forward(codes, 0))
        audit = "".join(x for _, x in conversations.solve(codes, 0, end)) + conversations.FINAL[end][1]
        cost, want, made = cheapest(rows)
        assert audit == want
        assert SHAPE.fullmatch("".join(role[0] for role, _ in made))
        cut = r.randint(1, len(codes)) if len(codes) > 1 else 1
        if cut < len(codes):
            whole = conversations.compose(conversations.matrix(codes[:cut]), conversations.matrix(codes[cut:]))
            assert [x for x in whole[0::2]] == [x for x in conversations.matrix(codes)[0::2]]
            reached = conversations.forward(codes, 0)[end][0] + conversations.FINAL[end][0]
            assert reached == cost


def damaged(rows):
    """The damage of the query on (conv_id, turn, role, text), by conversation."""
    out = {}
    for c, turn, role, text in rows:
        own = out.setdefault(c, [])
        s = lambda x: " " if x is None else str(x)
        harm = zlib.crc32(f"{s(c)}:{s(turn)}".encode()) % 20
        role, text = s(role), s(text)
        if harm == 1:
            text = ""
        if harm == 2:
            text = re.sub("[.!?]", "", text)
        if harm == 4:
            role = "user"
        own += [(turn, role, text)] * (0 if harm == 0 else 2 if harm == 3 else 1)
    for own in out.values():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, hashlib.sha256(f"{x[1]}:{x[2]}".encode()).hexdigest()))
    return out


def check(spark, df, tmp_path):
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in queries.op12_conversation_repair(spark, str(tmp_path)).collect()}
    want = {c: expected(own) for c, own in damaged([(r["conv_id"], r["turn"], r["role"], r["text"]) for r in df.collect()]).items()}
    assert got == want
    return got


@pytest.mark.parametrize("segment", [4096, 3])
def test_query_on_a_whole_table(spark, sf_dir, tmp_path, monkeypatch, segment):
    """Segments of three turns send nearly all conversations through the tree of matrices."""
    monkeypatch.setattr(conversations, "SEGMENT", segment)
    monkeypatch.setattr(conversations, "FAN", 2)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", str(segment > 3))  # so that several partitions meet in the tree
    try:
        got = check(spark, spark.read.parquet(f"{sf_dir}/conversations.parquet"), tmp_path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(len(x["audit"]) for x in got.values()) > 80


def test_query_on_odd_rows(spark, tmp_path, monkeypatch):
    """Nulls, ties, repeated rows, long texts, a conversation that loses all its turns, clashing names."""
    monkeypatch.setattr(conversations, "SEGMENT", 4)
    r = random.Random(9)
    gone = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "x."), (None, 1, "user", "a."), (None, 2, "assistant", "b."), (7, None, "user", None), (7, None, None, "t."), (7, 3, "", "u."), (8, 1, "user", "long. " * 50_000), (8, 1, "user", "long. " * 50_000), (8, 2, "assistant", "z.")]
    rows += [(50, k, r.choice(["user", "assistant", "system", "bot"]), r.choice(["q.", "r", "s!"]) + str(r.randint(0, 40))) for k in range(120)]
    rows += [(51, r.randint(0, 9), "user", r.choice(["same.", "other."])) for _ in range(60)]
    df = spark.createDataFrame([(*x, 0, "k") for x in rows], "conv_id long, turn long, role string, text string, pos int, key string")
    got = check(spark, df, tmp_path)
    assert got[gone] == {**dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), 0), "audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}


def test_empty_table(spark, tmp_path):
    check(spark, spark.createDataFrame([], "conv_id long, turn long, role string, text string"), tmp_path)
