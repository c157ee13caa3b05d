"""The stored word index: early ends, batches, directories that aren't read, phrases."""

import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from factweave.operators import search
from factweave.operators.word_index import WordIndex, _bucket

DOCS = "content string, text string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    common, rare = ["the", "and", "of", "roof", "then", "Été"], [f"word{i}" for i in range(200)]
    out = [(f"d{i}", " ".join(rng.choice(common) if rng.random() < 0.7 else rng.choice(rare) for _ in range(rng.randint(1, 30)))) for i in range(900)]
    return out + [("empty", ""), ("none", None), ("signs", "a, b! ?"), ("cut", "The ROOF then fell"), ("long", "of " * 5000 + "the end")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(4)


@pytest.fixture(scope="module")
def index(docs, tmp_path_factory):
    return WordIndex.build(docs, str(tmp_path_factory.mktemp("words") / "index"))


def got(df):
    return sorted(map(tuple, df.select("content", "score").collect()))


@pytest.mark.parametrize("query", [["the"], ["word3", "the", "and"], ["word1", "word2", "of", "the", "and"], ["nowhere"], ["nowhere", "word5"], ["été", "été"], []])
@pytest.mark.parametrize("k", [1, 7, 60, None])
def test_keyword_equals_a_scan(docs, index, query, k):
    assert got(index.keyword(query, k)) == (got(search.keyword(docs, list(dict.fromkeys(query)), k)) if query else [])


def test_frequent_words_are_not_essential(index):
    found = index.frequencies(["word1", "word2", "the", "and"])
    weights = {w: 10.0 if w.startswith("word") else 0.5 for w in found}
    assert index.essential(weights, found, 5) == ["word1", "word2"]
    assert len(index.essential(weights, found, 100_000)) == 4 == len(index.essential(weights, found, None))


def test_fuzzy_equals_a_scan(docs, index):
    for query in (["word33"], ["rooof", "wordd7", "the"], ["zzz"], []):
        assert got(index.fuzzy(query, 40)) == got(search.fuzzy_keyword(docs, query, 40))


@pytest.mark.parametrize("query", ["of the", "f the", "f th", "oof", "a, b", "the end", " the", "the ", "ROOF then fell", "no such phrase", "? ", "é"])
def test_phrases_are_found_inside_words_too(docs, rows, index, query):
    want = sorted(c for c, t in rows if t is not None and query.lower() in t.lower())
    assert sorted(r["content"] for r in index.phrase(docs, query).collect()) == want
    best = [(-r["score"], r["content"]) for r in index.phrase(docs, query, 5).collect()]
    assert best == sorted(best) and len(best) == min(5, len(want))


def test_only_the_directories_of_the_query_are_read(docs, index, tmp_path):
    """With all other directories gone the answer is the same."""
    query = ["word3", "word9", "the"]
    want = got(index.keyword(query, 10))
    shutil.copytree(index.folder, tmp_path / "copy")
    kept = {f"bucket={_bucket(w)}" for w in query}
    gone = 0
    for table in ("postings", "words"):
        for name in os.listdir(tmp_path / "copy" / table):
            if name.startswith("bucket=") and name not in kept:
                shutil.rmtree(tmp_path / "copy" / table / name)
                gone += 1
    shutil.rmtree(tmp_path / "copy" / "grams")
    assert gone > 40
    assert got(WordIndex(docs.sparkSession, str(tmp_path / "copy")).keyword(query, 10)) == want


def test_batches_add_up(docs, tmp_path):
    first, more = docs.where(F.crc32("content") % 3 > 0), docs.where(F.crc32("content") % 3 == 0)
    index = WordIndex.build(first, str(tmp_path / "index"))
    index.add(more)
    again = WordIndex(docs.sparkSession, index.folder)
    assert again.size() == docs.count()
    for k in (5, None):
        assert got(again.keyword(["word4", "the", "of"], k)) == got(search.keyword(docs, ["word4", "the", "of"], k))
    assert got(again.fuzzy(["rooof"], 30)) == got(search.fuzzy_keyword(docs, ["rooof"], 30))


def test_an_empty_index(spark, tmp_path):
    index = WordIndex.build(spark.createDataFrame([], DOCS), str(tmp_path / "index"))
    assert index.keyword(["a"], 3).collect() == [] == index.fuzzy(["a"], 3).collect()


def test_only_lists_are_shuffled(docs, rows, tmp_path):
    """The shuffle that writes the lists has a row a word and block, not one for each word of a content."""
    status = docs.sparkSession.sparkContext._jsc.sc().statusStore()
    none = docs.sparkSession.sparkContext._gateway.new_array(docs.sparkSession.sparkContext._jvm.double, 0)

    def written():
        stages = status.stageList(None, False, False, none, None)
        return [stages.apply(i).shuffleWriteRecords() for i in range(stages.size())]

    again = docs.sparkSession.createDataFrame(rows * 4, DOCS).repartition(4).withColumn("content", F.concat("content", F.lit("-"), F.monotonically_increasing_id())).localCheckpoint()
    before = len(written())
    WordIndex.build(again, str(tmp_path / "index"))
    assert max(written()[: -before or None], default=0) < 2000 < again.count()


def test_trigrams_are_shuffled_as_lists(spark, tmp_path):
    """The shuffle that writes the trigrams has a row a trigram and block, not one for each trigram of a word."""
    rng = random.Random(2)
    docs = spark.createDataFrame([(f"d{i}", " ".join("".join(rng.choice("abcdé") for _ in range(12)) for _ in range(10))) for i in range(300)], DOCS).repartition(4).localCheckpoint()
    status = spark.sparkContext._jsc.sc().statusStore()
    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def stages():
        found = status.stageList(None, False, False, none, None)
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteRecords() for i in range(found.size())}

    before = stages()
    index = WordIndex.build(docs, str(tmp_path / "index"))
    assert max(n for stage, n in stages().items() if stage not in before) <= 3000
    query = ["abcdéabcdéab", "ddcba"]
    assert got(index.fuzzy(query, None, 0.2)) == got(search.fuzzy_keyword(docs, query, None, 0.2)) != []
