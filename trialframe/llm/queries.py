"""The registered queries of the training-data operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, oracle
from .common import staged, table
from .fingerprints import fingerprints
from .katz import katz_scores
from .lexical_search import top_documents
from .near_duplicates import near_duplicates
from .piece_encoding import encode
from .quality_votes import quality
from .quotations import as_replies, link_quotations
from .source_mixing import mix
from .threads import conversations, reply_order
from .toxicity import toxicity
from .url_filter import repeated_urls, url_filter
from .vector_codes import compress
from .warc import round_trip

#: The model file of the pieces; another path may be given by this setting of the session.
PIECES = "spark.trialframe.pieceModel"
#: The file of the ranks; another path may be given by this setting of the session.
RANKS = "spark.trialframe.byteRanks"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op5_circulant_minhash(spark, sf):
    return near_duplicates(table(spark, sf, "documents"), percent=85)


def tokenizer_file(spark: SparkSession, setting: str, name: str) -> str:
    """Path of a vocabulary file, on the driver: the session's setting, or that of the public tokenizers."""
    path = spark.conf.get(setting, None)
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(name)
    return path


def piece_model(spark: SparkSession) -> str:
    return tokenizer_file(spark, PIECES, "piece_bpe_32k.model")


@query
def op1_paragraph_sketches(spark, sf):
    return fingerprints(table(spark, sf, "documents"))


@query
def op2_katz_scores(spark, sf):
    return katz_scores(table(spark, sf, "documents"), order=3)


@query
def op3_quotation_linking(spark, sf):
    linked = staged(link_quotations(staged(as_replies(table(spark, sf, "conversations")))))  # both are read by several plans
    return conversations(linked, reply_order(linked))


@query
def op4_piece_encoding(spark, sf):
    outputs = ("n_tokens", "ids_sha256", "decoded_sha256", "covered_bytes")
    return encode(table(spark, sf, "documents"), piece_model(spark), outputs=outputs)


@query
def op6_warc_round_trip(spark, sf):
    return round_trip(table(spark, sf, "pages")).drop("payload", "url")


@query
def op7_quality_votes(spark, sf):
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "quality", "kept")
    return quality(table(spark, sf, "documents")).select("doc_id", *columns)


@query
def op8_toxicity(spark, sf):
    return toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def op9_source_mixing(spark, sf):
    return mix(table(spark, sf, "documents")).drop("key")


@query
def op10_url_filter(spark, sf):
    pages = table(spark, sf, "pages")
    return url_filter(pages, repeated_urls(pages))


@query
def op11_vector_codes(spark, sf):
    return compress(table(spark, sf, "embeddings")).drop("label")


@query
def op12_lexical_search(spark, sf):
    return top_documents(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query
def op13_byte_bpe(spark, sf):
    import public_tokenizers

    ranks = byte_bpe.read_ranks(tokenizer_file(spark, RANKS, "byte_bpe_multi_50k.tiktoken"))
    outputs = ("n_tokens", "ids_sha256", "decoded_sha256")
    return byte_bpe.encode(table(spark, sf, "documents"), ranks, public_tokenizers.PATTERN, outputs=outputs)


#: Equivalent SQL where it can express an operator.
ORACLE: dict[str, str] = oracle.build()
