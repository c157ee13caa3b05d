"""N-gram join against brute force: prefixes under each order, long lists, copies, nulls, repeated and text ids."""

import random

import brute
import numpy as np
import pytest

from factweave.llm import ngrams, queries

DOCS = "doc_id long, text string, shingles string, component string"


def copies(seed, n=70, boilerplate=45):
    """Texts of which many share one passage, with near copies of all degrees."""
    rng = random.Random(seed)
    say = lambda k: [f"w{rng.randint(0, 5000)}" for _ in range(k)]
    shared, rows = say(boilerplate), [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "One"), (5, "two Words"), (6, "a b c d"), (7, "ab " * 300), (8, " ".join(say(3000)))]
    base = [say(rng.randint(4, 60)) + (shared if rng.random() < 0.7 else []) for _ in range(12)]
    for i in range(9, n):
        words = list(rng.choice(base))
        for _ in range(rng.choice((0, 0, 1, 1, 2, 4, 8))):
            words[rng.randrange(len(words))] = f"e{rng.randint(0, 9)}"
        rows.append((i, " ".join(words).title() if rng.random() < 0.2 else "\n".join(words)))
    rng.shuffle(rows)
    return rows


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "s", "c") for r in rows], DOCS).repartition(parts)


def want(rows, k, percent):
    return sorted((r[:3] for r in brute.op8(rows, k, percent)), key=repr)


def got(df):
    return sorted(map(tuple, df.select("doc_id", "n_shingles", "component_id").collect()), key=repr)


def test_similar_sets_meet_in_their_prefixes_under_every_order():
    rng = np.random.default_rng(4)
    for _ in range(40):
        pool = rng.integers(1, 1 << 63, 400, dtype=np.uint64)
        sets = [np.unique(rng.choice(pool, int(rng.integers(1, 60)))) for _ in range(12)]
        for own in list(sets):
            sets.append(np.unique(np.concatenate((own[rng.random(len(own)) > 0.06], rng.choice(pool, 2))))[: len(own) + 2])
        held, first = np.concatenate(sets), np.cumsum([0, *map(len, sets)])
        own, back, count = np.unique(held, return_inverse=True, return_counts=True)
        level = ngrams.levels(count)[back]
        for percent in (50, 85):
            lists = [ngrams.prefixes(held, first, level, percent, o) for o in range(3)]
            for i, a in enumerate(sets):
                for j in range(i):
                    both = len(np.intersect1d(a, sets[j]))
                    if 100 * both >= percent * (len(a) + len(sets[j]) - both):
                        assert all(len(np.intersect1d(x[i], x[j])) for x in lists)


def test_orders_differ():
    shingles = np.random.default_rng(1).integers(1, 1 << 63, 200, dtype=np.uint64)
    level = ngrams.levels(np.arange(1, 201) % 9 + 1)
    orders = [tuple(np.argsort(ngrams.ranks(shingles, level, o))) for o in range(3)]
    assert len(set(orders)) == 3
    assert all(np.all(np.diff((level[list(o)] > 0).astype(int)) >= 0) for o in orders)


@pytest.mark.parametrize("seed,k,percent", [(1, 4, 85), (2, 5, 80), (3, 2, 60), (4, 1, 40)])
def test_against_brute_force(spark, seed, k, percent):
    rows = copies(seed)
    assert got(ngrams.similar(frame(spark, rows), k, percent)) == want(rows, k, percent)


def test_long_lists_go_through_all_orders_and_blocks(spark, monkeypatch):
    seen = []
    across = ngrams._across
    monkeypatch.setattr(ngrams, "_across", lambda *a: seen.append(1) or across(*a))
    monkeypatch.setattr(ngrams, "SHORT", 1)
    rows = copies(6, n=60, boilerplate=80)
    assert got(ngrams.similar(frame(spark, rows), 2, 70)) == want(rows, 2, 70)
    assert seen


def test_long_lists_are_taken_apart_by_the_next_order(spark, monkeypatch):
    monkeypatch.setattr(ngrams, "SHORT", 3)
    for seed in (7, 8):
        rows = copies(seed, n=60, boilerplate=70)
        assert got(ngrams.similar(frame(spark, rows), 3, 75)) == want(rows, 3, 75)


def test_null_and_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(None, text), (None, text + " x"), (5, text + " y"), (5, "quite another text of six words"), (9, "quite another text of six words"), (None, None), (None, "single")]
    assert got(ngrams.similar(frame(spark, rows), 4, 85)) == want(rows, 4, 85)


def test_text_ids_and_empty_table(spark):
    rows = copies(9, n=30)
    named = frame(spark, rows).selectExpr("lpad(cast(doc_id as string), 4, '0') AS doc_id", "text")
    assert got(ngrams.similar(named, 4, 85)) == sorted(((f"{d:04}", n, f"{c:04}") for d, n, c in want(rows, 4, 85)), key=repr)
    assert ngrams.similar(frame(spark, rows).limit(0), 4, 85).collect() == []


def test_a_large_group_of_copies(spark):
    """Exact and near copies by the thousand, over many partitions."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(50)]
    rows = [(i, " ".join(base)) for i in range(1500)]
    rows += [(2000 + i, " ".join(base[:49] + [f"z{rng.randint(0, 10**9)}"])) for i in range(600)]
    rows += [(5000, " ".join(base[:20]) + " other words follow here")]
    found = got(ngrams.similar(frame(spark, rows, 8), 4, 85))
    assert found == [(d, n, 5000 if d == 5000 else 0) for d, n in sorted(((d, len(set(zip(*[t.split()[j:] for j in range(4)])))) for d, t in rows), key=repr)]


def test_query_against_brute_force(spark):
    path = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
    assert got(queries.op11_multiple_order_join(spark, path)) == want(rows, 4, 85)
