"""Repair of conversations against every cheapest repair, over whole, split, hot and damaged ones."""

import random

import brute
import pytest

from factweave.llm import queries, turns

TURNS = "conv_id long, turn long, role string, text string, edit string, stats string"
REPORT = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def talk(seed, convs=60, most=9, roles=("user", "assistant", "system", "user", "assistant", "tool", "", None, "User")):
    rng, rows = random.Random(seed), []
    for c in range(convs):
        turn = rng.randint(-3, 3)
        for _ in range(rng.randint(0, most)):
            turn += rng.choice((0, 1, 1, 1, 2))
            text = rng.choice(("Yes.", "No!", "Really?", "cut off", "cut off \n", "A. ", "", " \t\n", None, "é…", "ü.\x0b", "x.\xa0"))
            rows.append((None if c == 7 else c, None if rng.random() < 0.05 else turn, rng.choice(roles), text))
    rng.shuffle(rows)
    return rows


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "e", "s") for r in rows], TURNS).repartition(parts)


def reports(df):
    return sorted(map(tuple, df.select(*REPORT).collect()), key=repr)


def test_semiring_is_associative_and_trees_equal_folds():
    rng = random.Random(3)
    codes = ["".join(rng.choice("sua-") + rng.choice("0123") for _ in range(n)) for n in range(1, 40)]
    for code in codes:
        fold = turns.identity()
        for i in range(0, len(code), 2):
            fold = turns.times(fold, turns._turn(code[i : i + 2]))
        cut = 2 * rng.randint(0, len(code) // 2)
        assert turns.scanned(code) == fold == turns.times(turns.scanned(code[:cut]), turns.scanned(code[cut:]))


@pytest.mark.parametrize("seed", range(3))
def test_against_every_cheapest_repair(spark, seed):
    rows = talk(seed)
    assert reports(turns.repair(frame(spark, rows))) == sorted(brute.op13(rows), key=repr)


def test_pieces_of_few_turns_and_many_tasks(spark, monkeypatch):
    """A conversation over all tasks, cut into pieces of two turns."""
    rows = talk(5, convs=6, most=12) + [(99, i // 2, ("user", "assistant", "system")[i % 3], f"{i % 7}{'.' if i % 5 else ''}") for i in range(40)]
    monkeypatch.setattr(turns, "PIECE", 2)
    spark.conf.set("spark.sql.shuffle.partitions", 9)
    try:
        got = reports(turns.repair(frame(spark, rows)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert got == sorted(brute.op13(rows), key=repr)


def test_long_conversation_and_hot_message(spark):
    """Thousands of turns of one conversation, most of them one message; brute force keeps too many repairs there, so a plain scan is the measure."""
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", "same." if i % 3 else f"{i}.") for i in range(6000)] + [(2, 0, "user", "x" * 300_000), (2, 1, "assistant", "Fine.")]
    got = {r["conv_id"]: r for r in turns.repair(frame(spark, rows)).collect()}
    assert got[1]["n_rows"] == 6000 and got[1]["duplicate"] == 4000 - 2 and got[1]["gaps"] == 0
    seen, code = set(), ""
    for _, _, role, text in rows[:6000]:
        code += role[0] + ("2" if (role, text) in seen else "0")
        seen.add((role, text))
    fold = turns.identity()
    for i in range(0, len(code), 2):
        fold = [turns.times(fold[:1], turns._turn(code[i : i + 2]))[0]] * 4
    assert (got[1]["cost"], got[1]["audit"]) == turns.cheapest(fold)
    assert (got[2]["truncated"], got[2]["cost"], got[2]["audit"]) == (1, 1, "KK")


def test_repaired_turns_are_what_the_digest_says(spark):
    import hashlib
    from itertools import groupby

    rows = talk(11)
    df = frame(spark, rows)
    found = sorted((tuple(r) for r in turns.repaired_turns(df).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    made = {c: [*g] for c, g in groupby(found, key=lambda r: r[0])}
    for r in turns.repair(df).collect():
        own = made.get(r["conv_id"], [])
        assert [x[1] for x in own] == list(range(len(own)))
        assert "".join(x[4] for x in own) == r["audit"].replace("D", "")
        assert hashlib.sha256("\n".join(f"{x[2]}:{x[3]}" for x in own).encode()).hexdigest() == r["repaired_sha256"]


def test_no_rows_and_conversations_without_rows(spark):
    empty = spark.createDataFrame([], TURNS)
    assert turns.repair(empty).collect() == []
    assert turns.repaired_turns(empty).collect() == []
    ids = spark.createDataFrame([(4,), (4,), (None,)], "conv_id long")
    assert reports(turns.repair(empty, ids)) == sorted(brute.op13([], [4, None]), key=repr)


def test_text_ids(spark):
    rows = [("b", 0, "user", "Hi."), ("a", 0, "assistant", "Hi."), ("a", 1, None, None)]
    df = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")
    assert reports(turns.repair(df)) == sorted(brute.op13(rows), key=repr)


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_query_against_brute_force(spark, folder):
    path = f"/root/testdata/{folder}"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = brute.op13(brute.op13_damaged(rows), {r[0] for r in rows})
    assert reports(queries.op13_min_plus_repair(spark, path)) == sorted(want, key=repr)
