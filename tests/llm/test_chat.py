"""Snapshots, copies and rendering against a plain version."""

import random

from memspark.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, place int, h1 string, copies string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA)


def plain(rows):
    chats = {}
    for conv_id, turn, role, text in set(rows):
        if conv_id is not None:
            chats.setdefault(conv_id, []).append((turn is not None, turn or 0, role or "", text or ""))
    chats = {c: tuple((r, t) for _, _, r, t in sorted(set(v))) for c, v in chats.items()}
    inner = {s[:n] for s in chats.values() for n in range(1, len(s))}
    out = {}
    for conv_id, s in sorted(chats.items()):
        if s not in inner:
            first, n = out.get(s, (conv_id, 0))
            out[s] = (first, n + 1)
    return sorted((c, len(s), n, "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in s)) for s, (c, n) in out.items())


def result(df):
    got = chat.format_chats(df)
    assert got.columns == ["conv_id", "turns", "copies", "text"]
    return sorted(tuple(r) for r in got.collect())


def test_snapshots(spark):
    r = random.Random(1)
    rows, conv_id = [], 0
    for family in range(25):
        turns = [("user" if i % 2 == 0 else "assistant", f"text {r.randint(0, 3 if family < 9 else 10**6)}") for i in range(8)]
        for _ in range(r.randint(1, 6)):
            for turn, (role, text) in enumerate(turns[: r.randint(1, 8)]):
                rows.append((conv_id, turn * 3, role, text))
            conv_id += 1
    r.shuffle(rows)
    want = plain(rows)
    assert 0 < len(want) < conv_id
    assert result(table(spark, rows).repartition(4)) == want


def test_same_turns_elsewhere_are_no_prefix(spark):
    rows = [(1, 0, "user", "b"), (2, 0, "user", "a"), (2, 1, "user", "b"), (3, 0, "a", "user"), (4, 0, "user", "a")]
    assert result(table(spark, rows)) == plain(rows)
    assert [r[0] for r in result(table(spark, rows))] == [1, 2, 3]


def test_odd_rows(spark):
    rows = [
        (None, 0, "user", "left out"),
        (1, None, "user", "no turn"),
        (1, 0, None, None),
        (2, 0, "user", ""),
        (2, 0, "user", ""),
        (3, 5, "user", "x" * 200_000),
        (3, 5, "user", "x" * 200_000),
        (4, 1, "", "é 漢 🙂 <|im_end|>"),
        (5, 7, "user", ""),
    ]
    assert result(table(spark, rows)) == plain(rows)
    assert result(table(spark, [])) == []


def test_ties_have_a_fixed_order(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "b"), (2, 0, "user", "b"), (2, 0, "user", "a")]
    [only] = result(table(spark, rows))
    assert only[:3] == (1, 2, 2)


def test_only_hashes_are_shuffled_to_find_snapshots(spark):
    df = chat.maximal(table(spark, [(1, 0, "user", "a")]))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "left_anti" in plan.lower().replace("leftanti", "left_anti")
    below = plan[plan.index("Exchange") :]
    assert "text#" not in below.split("Project")[0]
