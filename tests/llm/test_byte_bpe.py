"""Byte-level BPE against the library that reads the same ranks."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from trialframe.llm import byte_bpe, queries

RANKS = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ODD = [
    "", "a" * 3000, "ab" * 1500, "=" * 1000, " " * 2000 + "x", "x\x1cy \x1d\x1e\x1f \x85z", "a᠎b​c d　e",
    "\n\n\n \t x", "don't I'll we've 12 345٣٤", "日本語テキスト。", "🎉🎉👩‍👩‍👧", "͸\U00010570 \U0001E030 \U00031350 \U00011DD8࢏",
    "ſs ŉ 'S 'll'd", "é é", "<|endoftext|>", "\x00\x01",
]


def encode(spark, texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = byte_bpe.encode(df, RANKS, public_tokenizers.PATTERN, outputs=("ids", "decoded"), **options)
    return {r.doc_id: (r.ids, bytes(r.decoded)) for r in got.collect()}


def check(spark, texts):
    for k, (ids, decoded) in encode(spark, texts).items():
        want = LIBRARY.encode_ordinary(texts[k] or "")
        assert ids == want, repr(texts[k])[:100]
        assert decoded == LIBRARY.decode_bytes(want) == (texts[k] or "").encode()


def test_odd_texts(spark):
    check(spark, [*ODD, None])


def test_random_texts(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab \nA1é=日'st") for _ in range(60)) for _ in range(300)]
    spans = [(32, 0x500), (0x10000, 0x1FFFF), (0x2000, 0xD7FF)]
    check(spark, texts + ["".join(chr(rng.randrange(*rng.choice(spans))) for _ in range(40)) for _ in range(300)])


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=60))
def test_any_texts(spark, texts):
    check(spark, [t for t in texts if not any(0xD800 <= ord(c) < 0xE000 for c in t)])


def test_very_long_text(spark):
    rng = random.Random(2)
    check(spark, [" ".join(rng.choice(["merge", "Bytes", "zqxjk", "été", "12", "\n"]) for _ in range(200_000))])


def test_rows_repeat_and_other_columns_are_not_read(spark):
    df = spark.createDataFrame(
        [(1, "same words", 9, "x"), (1, "same words", 8, "y"), (None, "no id", 7, None), (2, None, 6, "")],
        "doc_id long, text string, ids int, words string",
    )
    got = byte_bpe.encode(df, RANKS, public_tokenizers.PATTERN).collect()
    same, other = LIBRARY.encode_ordinary("same words"), LIBRARY.encode_ordinary("no id")
    assert sorted((str(r.doc_id), r.ids) for r in got) == sorted([("1", same), ("1", same), ("None", other), ("2", [])])
    assert byte_bpe.encode(df.limit(0), RANKS, public_tokenizers.PATTERN).collect() == []
    keyed = byte_bpe.encode(df, RANKS, public_tokenizers.PATTERN, keys=("words", "doc_id"), outputs=("n_tokens",)).collect()
    assert sorted((str(r.words), r.n_tokens) for r in keyed) == sorted([("x", len(same)), ("y", len(same)), ("None", len(other)), ("", 0)])


def test_small_blocks_give_the_same(spark, monkeypatch):
    before = encode(spark, ODD)
    monkeypatch.setattr(byte_bpe, "BLOCK", 100)
    assert encode(spark, ODD) == before
    monkeypatch.setattr(byte_bpe, "KNOWN", 3)
    assert encode(spark, ODD) == before


def test_a_vocabulary_without_some_byte_is_refused(spark):
    with pytest.raises(ValueError, match="bytes without a token"):
        byte_bpe.encode(spark.range(1).selectExpr("id AS doc_id", "'a' AS text"), {b"a": 0}, public_tokenizers.PATTERN)


def test_query_digests(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op13_byte_bpe(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = LIBRARY.encode_ordinary(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
