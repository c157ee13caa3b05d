"""From raw documents to a training mixture: each stage is written as Parquet and read again.

All stages but the last return the columns of documents.  Each decides about rows,
not ids, so null or repeated ids neither save a row nor take another with it;
columns of any name and type are carried along.  An empty table gives an empty
mixture.  See the operators for null, empty and very long texts.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.llm import exchange, pii, queries, raking, setsketch, toxicity, winnow
from factweave.session import shared_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows scored below 0.5; labels are learnt from the rows outside the held-out fold, as in op3."""
    raw = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = toxicity.train(raw, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    (score,) = exchange.fresh(docs, "toxicity")
    return toxicity.with_score(docs, model, score).where(F.col(score) < 0.5).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five words a shingle, 0.8 or more): that with the least id."""
    return setsketch.distinct(docs, k=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a benchmark window."""
    return winnow.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by pseudonyms of the same format."""
    return pii.pseudonymised(docs, queries.secret(spark))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows sampled, with topic, tokens and probability."""
    return raking.mixed(docs, queries.TARGETS).where("mix_sampled").drop("mix_sampled")


def _alone(stage):
    """stage, begun after executors have given back the heap that the stages before it left full of garbage.

    Columns whose names aren't words have others inside the stage.
    """

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        exchange.collect_garbage(spark)
        odd = [c for c in docs.columns if not re.fullmatch(r"\w+", c)]
        names = dict(zip(odd, exchange.fresh(docs, *(f"column_{i}" for i in range(len(odd))))))
        out = stage(spark, docs.toDF(*(names.get(c, c) for c in docs.columns)), sf_dir)
        back = {v: k for k, v in names.items()}
        return out.toDF(*(back.get(c, c) for c in out.columns))

    return run


STAGES = [(name, _alone(stage)) for name, stage in (("toxicity", drop_toxic), ("near duplicates", drop_near_duplicates), ("decontamination", drop_contaminated), ("personal data", pseudonymise), ("mixture", mix))]

#: Classifier, sketches and keyed permutation can't be said in SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture made from the documents in sf_dir."""
    exchange.tune(spark)
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
