"""Quality rules with thresholds from mergeable quantile sketches.

Each document has rates: symbols per word character, lines that repeat earlier
ones, words in repeated 8-word runs, characters per word.  KLL sketches of rates are
aggregated by language and source, and merged to languages and to the corpus.  A
group's quantiles are drawn to its language's, and those to the corpus', as if
`weight` documents more had been seen there, so verdicts do not jump at any number
of rows.

Characters per word are judged by the quartiles of the rows that pass the base rule:
a document is rejected if it is more than `reach` distances between quartiles beyond
one of them.  Below the group's median size, which is a quantile too, the distance
grows with the root, since means of few words vary more.  The other rates are mostly
zero, and what is odd in them may be no odder than what all of a source have.  So
their limits come from the group's core, the documents whose characters per word are
within `core` distances of the quartiles: the quantile `tail` of their rates, and
`beyond` times its distance from their median on top.  No limit is fixed, nor is any
unit of one.

DataFrame functions only.  The table of thresholds has a row for each language
and source; Spark broadcasts it if it is small when measured, and joins by
shuffle, splitting skewed groups, if not.

Nulls and texts without words have no words, fail the base rule and aren't
counted in sketches.  Null languages and sources are groups of their own.  Rows
are judged one by one, so null and repeated ids change nothing, and equal texts of
a group get equal verdicts.  Where no row passes the base rule none is kept.  A
text is in memory as a whole, with some 20 bytes a word for its runs.  An empty
table gives an empty one; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.llm import exchange as X

#: Rates whose limit is the tail of the core's.
TAILED = ("symbol_rate", "dup_line_rate", "repeat_rate")


def measures(docs: DataFrame, keep: list[str], run: int = 8) -> DataFrame:
    """keep, and the counts of each text."""
    word = "[^\\x20\\x09-\\x0D]+"
    df = docs.select(*keep, F.coalesce("text", F.lit("")).alias("_text"))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    df = df.select(*keep, "_text", F.regexp_extract_all("_text", F.lit(f"({word})"), 1).alias("_words"), lines.alias("_lines"))
    df = df.select(
        *keep, F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"), F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"), F.size("_lines").cast("long").alias("n_lines"), (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
    )
    counts = ["word_chars", "n_symbols", "n_lines", "n_dup_lines"]
    n = F.size("_hashes")
    runs = F.when(n >= run, F.transform(F.sequence(F.lit(0), n - run), lambda i: F.xxhash64(*(F.get("_hashes", i + j) for j in range(run))))).otherwise(F.array().cast("array<bigint>"))
    df = df.select(*keep, *counts, n.cast("long").alias("n_words"), runs.alias("_runs"))
    twice = F.size(F.array_distinct("_runs")) < F.size("_runs")
    # runs in order of hash, only where one occurs again
    df = df.select(*keep, *counts, "n_words", F.when(twice, F.sort_array(F.transform("_runs", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("_sorted"))
    same = lambda x, i: F.coalesce(F.get("_sorted", i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("_sorted", i + 1)["h"] == x["h"], F.lit(False))
    df = df.select(*keep, *counts, "n_words", F.when(F.col("_sorted").isNotNull(), F.sort_array(F.transform(F.filter("_sorted", same), lambda x: x["i"]))).alias("_at"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-run).alias("last"))
    covered = F.aggregate("_at", start, lambda s, p: F.struct((s["n"] + F.least(F.lit(run), p - s["last"])).alias("n"), p.alias("last")), lambda s: s["n"])
    return df.select(*keep, *counts, "n_words", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def _with_rates(df: DataFrame) -> DataFrame:
    some = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return df.withColumns(
        {
            "base_failed": (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
            "symbol_rate": F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)), "dup_line_rate": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
            "repeat_rate": F.col("n_repeat_words") / some, "word_length": F.col("word_chars") / some,
        }
    )


def quantiles(rows: DataFrame, groups: DataFrame, wanted: dict[str, tuple[str, float]], weight: float) -> DataFrame:
    """(lang, source, name...) for each of groups: quantiles (column, share) of rows by their sketches, null if there are no rows."""
    columns = list(dict.fromkeys(c for c, _ in wanted.values()))
    own = rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), *(F.kll_sketch_agg_double(F.col(c).cast("double")).alias(c) for c in columns))
    merged = lambda: [F.sum("n").alias("n"), *(F.kll_merge_agg_double(c).alias(c) for c in columns)]
    by_lang = own.groupBy("lang").agg(*merged())
    whole = own.agg(*merged())
    named = lambda df, tag, *keys: df.select(*(F.col(k).alias(f"{k}_{tag}") for k in keys), *(F.col(c).alias(f"{c}_{tag}") for c in ("n", *columns)))
    held = groups.join(named(own, "own", "lang", "source"), F.col("lang").eqNullSafe(F.col("lang_own")) & F.col("source").eqNullSafe(F.col("source_own")), "left")
    held = held.join(named(by_lang, "lang", "lang"), F.col("lang").eqNullSafe(F.col("lang_lang")), "left").join(F.broadcast(named(whole, "all")))

    def quantile(x: str, q: float) -> Column:
        out = F.when(F.col("n_all") > 0, F.kll_sketch_get_quantile_double(f"{x}_all", F.lit(q)))
        for tag in ("lang", "own"):
            n = F.col(f"n_{tag}")
            out = F.when(n > 0, (n * F.kll_sketch_get_quantile_double(f"{x}_{tag}", F.lit(q)) + weight * out) / (n + weight)).otherwise(out)
        return out

    return held.select("lang", "source", *(quantile(*w).alias(name) for name, w in wanted.items()))


def _beside(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """rows with the limits of their language and source."""
    limits = limits.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    return rows.join(limits, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left").drop("_lang", "_source")


def _within(distances: float) -> Column:
    """Whether a document's characters per word are within so many distances of the quartiles."""
    between = (F.col("q75_word_length") - F.col("q25_word_length")) * F.sqrt(F.greatest(F.col("typical_words") / F.greatest(F.col("n_words"), F.lit(1)), F.lit(1.0)))
    return F.col("word_length").between(F.col("q25_word_length") - distances * between, F.col("q75_word_length") + distances * between)


LENGTHS = {"q25_word_length": ("word_length", 0.25), "q75_word_length": ("word_length", 0.75), "typical_words": ("n_words", 0.5)}


def thresholds(rated: DataFrame, weight: float = 25.0, core: float = 0.75, tail: float = 0.99, beyond: float = 2.0) -> DataFrame:
    """(lang, source, quartiles of word length, typical size, limit_<rate>) from the rated rows that pass the base rule."""
    base, groups = rated.where(~F.col("base_failed")), rated.select("lang", "source").distinct()
    lengths = X.checkpoint(quantiles(base, groups, LENGTHS, weight))
    inner = _beside(base, lengths).where(_within(core))
    tails = quantiles(inner, groups, {f"{kind}_{r}": (r, q) for r in TAILED for kind, q in (("high", tail), ("mid", 0.5))}, weight)
    limit = lambda r: (F.col(f"high_{r}") + beyond * (F.col(f"high_{r}") - F.col(f"mid_{r}"))).alias(f"limit_{r}")
    return _beside(lengths, tails.select("lang", "source", *(limit(r) for r in TAILED)))


def judged(docs: DataFrame, weight: float = 25.0, reach: float = 3.0, core: float = 0.75, tail: float = 0.99, beyond: float = 2.0) -> DataFrame:
    """Per row of docs (doc_id, text, lang, source): its counts and rates, the limits of its group, base_failed and kept."""
    rated = X.checkpoint(_with_rates(measures(docs, ["doc_id", "lang", "source"])))
    both = _beside(rated, X.checkpoint(thresholds(rated, weight, core, tail, beyond)))
    good = ~F.col("base_failed") & F.coalesce(_within(reach), F.lit(True))
    for rate in TAILED:
        good &= F.coalesce(F.col(rate) <= F.col(f"limit_{rate}"), F.lit(True))
    return both.withColumn("kept", good)
