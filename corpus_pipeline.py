"""The corpus pipeline: each stage applies one training-data operator to all its predecessor kept.

Stages take (spark, docs, sf_dir); their result is written and read again as the next one's docs.
All but the last return the columns of `documents`. In every stage a null text is an empty one, null ids and null
sources are values of their own, an empty table stays empty, other columns are dropped and repeated rows are judged alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialframe.llm import toxicity as toxic
from trialframe.llm.common import staged, table
from trialframe.llm.near_duplicates import near_duplicates
from trialframe.llm.piece_encoding import encode
from trialframe.llm.quality_votes import quality
from trialframe.llm.queries import piece_model
from trialframe.llm.source_mixing import keyed, mix

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
TOXIC = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity under 0.7 stay. The classifier learns from the labels that are not held out."""
    labels = table(spark, sf_dir, "labels")
    model = toxic.train(docs, labels.filter(~toxic.held_out("doc_id", 3, 1)))
    return toxic.score(docs, model, keys=COLUMNS).filter(F.col("score") < TOXIC).select(*COLUMNS)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighed quality rules keep stay."""
    return quality(docs, keys=COLUMNS).filter("kept").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that with the smallest id. Rows without id stay, and so do rows that share an id."""
    dropped = near_duplicates(docs, percent=80).filter("NOT kept").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated, or left out, as the mix of sources asks: once for each copy."""
    copies = mix(docs).filter("copies > 0").select(F.col("key").alias("_key"), "copies")
    taken = keyed(docs.select(*COLUMNS)).join(copies, "_key")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*COLUMNS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, digests and decoded text's digest of every document that is left."""
    outputs = ("n_tokens", "ids", "ids_sha256", "decoded_sha256")
    return encode(docs, piece_model(spark), keys=("doc_id", "source"), outputs=outputs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_poor),
    ("MinHash near-dedup", near_dedup),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode_pieces),
]

#: Trained scores, signatures and tokens are beyond SQL; tests/llm hold each stage against its plain version on a small table.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs)
    return docs
