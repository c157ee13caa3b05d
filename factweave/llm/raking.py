"""Mixing sources to target weights by iterative proportional fitting.

Tokens are counted by source, language and topic.  The cells' weights are raked:
scaled in turn so that the sums by source, by language and by topic meet their
targets, until every sum does or `rounds` are over (then a warning says by how
much they don't).  A document's probability is its cell's raked weight over the
cell's tokens, times the largest factor that leaves no probability above 1;
documents are sampled by a hash of id and seed.  The expected mixture then has
exactly the raked shares.

Targets not given are the observed shares to the power `flatten`, normalised:
0 is uniform, 1 as observed.  Given ones are weights, normalised too.

A document's topic is one of `TOPICS` clusters of words: that of the rarest topic
word that it has.  Topic words are counted on all rows: of each language the
`WORDS` most frequent words of five letters and more that a share of its texts
between `least` and `usual` has, at most `ALL_WORDS` together.  A word's cluster
is a hash, so clusters cut across languages and targets by topic don't exclude
those by language.  Any expression can be given instead.

DataFrame functions only; cells are aggregated before anything is shuffled by
key, and are broadcast only if there are at most `CELLS`.  Nulls are values of
their own in each margin.  Texts that are null, empty or without words have no
tokens, weight 0 and probability 0.  Values without a target, or targets without
a value, count as 0, and so do all targets of a margin whose sum is 0; of targets
that exclude each other, those by topic are met, and the rest as far as the
rounds get.  Repeated ids are sampled together, null ids as if they were one.  An
empty table gives an empty one.  Columns of docs with the names of results are
replaced; all others are kept, whatever their names.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.llm import exchange as X

MARGINS = ("source", "lang", "topic")
#: Clusters of words, topic words by language and in all, cells that are broadcast at most.
TOPICS, WORDS, ALL_WORDS, CELLS = 8, 48, 512, 100_000
_SPACE = "[\\x20\\x09-\\x0D]+"


def topic_words(docs: DataFrame, least: float = 0.004, usual: float = 0.1) -> list[str]:
    """The corpus' topic words, the rarest first; all rows are counted."""
    texts = X.checkpoint(docs.groupBy(F.col("lang").alias("own")).agg(F.count(F.lit(1)).alias("texts")))
    texts = F.broadcast(texts) if texts.count() <= CELLS else texts
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("\\p{L}{5,}"), F.lit(0)))
    held = docs.select("lang", F.explode(words).alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    held = held.join(texts, F.col("lang").eqNullSafe(F.col("own"))).where((F.col("n") >= least * F.col("texts")) & (F.col("n") <= usual * F.col("texts")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    found = held.withColumn("rank", rank).where(F.col("rank") <= WORDS).groupBy("word").agg(F.sum("n").alias("n"), F.min("rank").alias("rank"))
    found = found.orderBy("rank", "word").limit(ALL_WORDS).collect()
    return [r["word"] for r in sorted(found, key=lambda r: (r["n"], r["word"]))]


def _of(words: list[str], text: Column) -> Column:
    """The cluster of the first of words in a text; null without one."""
    if not words:
        return F.lit(None).cast("string")
    word = F.get(F.array_intersect(F.array(*map(F.lit, words)), F.split(F.lower(text), "[^\\p{L}]+")), 0)
    return F.when(word.isNotNull(), F.concat(F.lit("topic "), F.pmod(F.xxhash64(word), F.lit(TOPICS))))


def rake(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, flatten: float = 0.7, rounds: int = 96, step: int = 4, close: float = 1e-9) -> DataFrame:
    """cells (source, lang, topic, tokens) and their raked weight; weights add up to 1."""
    cells = X.checkpoint(cells)
    total = cells.agg(F.sum("tokens").alias("total"))
    cells = cells.crossJoin(F.broadcast(total)).where("total > 0").withColumn("weight", F.col("tokens") / F.col("total"))
    for m in MARGINS:
        if targets and m in targets:
            whole = sum(targets[m].values())
            share = F.lit(0.0)
            if whole > 0:
                share = F.coalesce(F.create_map(*(F.lit(x) for k, v in targets[m].items() for x in (k, v / whole)))[F.col(m)], F.lit(0.0))
            cells = cells.withColumn(f"aim_{m}", share)
        else:
            share = F.pow(F.sum("weight").over(Window.partitionBy(m)), F.lit(flatten))
            one = cells.withColumn("_share", share)
            sums = one.groupBy(m).agg(F.first("_share").alias("s")).agg(F.sum("s").alias("_all"))
            cells = one.crossJoin(F.broadcast(sums)).withColumn(f"aim_{m}", F.col("_share") / F.col("_all")).drop("_share", "_all")
    cells = X.checkpoint(cells)
    worst = None
    for i in range(rounds):
        for m in MARGINS:
            own = F.sum("weight").over(Window.partitionBy(m))
            cells = cells.withColumn("weight", F.when(own > 0, F.col("weight") * F.col(f"aim_{m}") / own).otherwise(F.lit(0.0)))
        if i % step == step - 1:
            cells = X.checkpoint(cells)
            off = [F.abs(F.sum("weight").over(Window.partitionBy(m)) - F.col(f"aim_{m}")).alias(m) for m in MARGINS]
            worst = cells.select(*off).agg(F.max(F.greatest(*MARGINS))).first()[0]
            if worst is None or worst < close:
                break
    if worst is not None and worst >= close:
        warnings.warn(f"after {rounds} rounds a share is {worst:.3g} off its target; targets may exclude each other", stacklevel=2)
    return cells.select(*MARGINS, "tokens", "weight")


def mixed(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, flatten: float = 0.7, topic: Column | None = None, seed: int = 0, rounds: int = 96, keep_text: bool = True) -> DataFrame:
    """docs with mix_topic, mix_tokens, mix_probability and mix_sampled.

    Texts are looked at once for the topic words.  Without the text in the result, they are looked at once more; with it, once
    for the cells and once for the result, which is cheaper than to write them.
    """
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), _SPACE), lambda w: w != "")).cast("long")
    subject = F.coalesce(_of(topic_words(docs), F.col("text")) if topic is None else topic, F.lit("none"))
    counted = docs.withColumns({"mix_topic": subject, "mix_tokens": words})
    if not keep_text:
        counted = X.checkpoint(counted.drop("text"))
    cells = counted.groupBy("source", "lang", F.col("mix_topic").alias("topic")).agg(F.sum("mix_tokens").alias("tokens"))
    raked = rake(cells, targets, flatten, rounds).where("tokens > 0").withColumn("ratio", F.col("weight") / F.col("tokens"))
    raked = X.checkpoint(raked.crossJoin(F.broadcast(raked.agg(F.max("ratio").alias("most")))))
    source, lang, subject, p = X.fresh(counted, "source", "lang", "topic", "p")
    held = raked.select(F.col("source").alias(source), F.col("lang").alias(lang), F.col("topic").alias(subject), F.when(F.col("most") > 0, F.col("ratio") / F.col("most")).alias(p))
    held = F.broadcast(held) if raked.count() <= CELLS else held
    same = F.col("source").eqNullSafe(F.col(source)) & F.col("lang").eqNullSafe(F.col(lang)) & F.col("mix_topic").eqNullSafe(F.col(subject))
    out = counted.join(held, same, "left").withColumn("mix_probability", F.when(F.col("mix_tokens") > 0, F.coalesce(p, F.lit(0.0))).otherwise(F.lit(0.0))).drop(source, lang, subject, p)
    # 53 bits of a hash, uniform in [0, 1)
    drawn = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11) / F.lit(float(1 << 53))
    return out.withColumn("mix_sampled", drawn < F.col("mix_probability"))
