"""Corpus operators as pipeline stages: documents in, documents out, whatever other columns they have and however those are called.

In every stage repeated rows are judged alike, a null or empty text has no words, and an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import toxicity as tox
from .common import checkpoint, read
from .decontamination import decontaminate
from .pieces import encode_documents
from .simhash import similar_documents
from .substring_dedup import substring_dedup

#: So many ids (8 bytes each) are broadcast to drop their documents; more are dropped by a shuffled anti join.
BROADCAST_IDS = 1_000_000


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents whose doc_id isn't among ids; a null id never is."""
    ids = checkpoint(ids.select("doc_id").filter("doc_id IS NOT NULL").distinct())
    return docs.join(F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids, "doc_id", "left_anti").select(docs.columns)


def private(docs: DataFrame, *names: str) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """docs with the columns `names` and all others under names that clash with nothing, and the way back."""
    hidden = [c if c in names else f"__column_{i}" for i, c in enumerate(docs.columns)]

    def restored(df: DataFrame, *more: str) -> DataFrame:
        return df.select(*[F.col(h).alias(c) for h, c in zip(hidden, docs.columns)], *more)

    return docs.toDF(*hidden), restored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity, learned from `labels`, is below 0.3. A null text is scored as an empty one; a null id is kept or dropped by its text."""
    model = tox.fit([(t, y) for _, t, y in tox.training_rows(docs, read(spark, sf_dir, "labels"), "toxic")])
    own, restored = private(docs, "text")
    return restored(tox.score_toxicity(own, model, score="__toxicity").filter("__toxicity < 0.3"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near duplicates: five-word shingles with a Jaccard similarity of 0.8 at least.

    Fingerprints of 1,024 bits find candidates where documents share one of their six least shingle hashes; their shingle sets decide.
    Texts without words are alike. Rows without an id stay, and a group that has one keeps no other; rows of the least id all stay.
    """
    groups = similar_documents(docs, shingle=5, radius=256, lanes=16, sketch=6, similarity=0.8)
    return without(docs, groups.filter("doc_id <> component_id OR component_id IS NULL"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of 13-word windows that an earlier document has; n_chars follows the text. A null text stays null; a null id is the earliest."""
    own, restored = private(docs, "doc_id", "text", "n_chars")
    others = tuple(c for c in own.columns if c not in ("doc_id", "text"))
    cut = substring_dedup(own, window=13, carry=others).withColumnRenamed("kept", "text")
    if "n_chars" in others:
        cut = cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return restored(cut)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten-word window of `benchmark`. Of rows of one id all go if one has such a window; rows without an id stay."""
    return without(docs, decontaminate(docs, read(spark, sf_dir, "benchmark"), window=10).filter("contaminated"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their piece ids under merge-dropout, decoded again and checked. A null or empty text has none; a column `tokens` of docs is replaced."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() == "tokens"])
    own, restored = private(docs, "doc_id", "text")
    return restored(encode_documents(own, dropout=0.1, seed=0), "tokens")
