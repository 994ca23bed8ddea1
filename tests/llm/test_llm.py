"""The training-data operators against plain versions, on small tables with nulls, ties and repeats."""

import hashlib
import io
import math
import random
import re
import tracemalloc
import weakref
import zlib

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from brute_texts import components, shingles, words
from pyspark.sql import functions as F

from trialframe.llm import fingerprints as fp
from trialframe.llm import katz, quality_votes, queries, quotations, source_mixing, toxicity, url_filter, warc
from trialframe.llm import near_duplicates as near
from trialframe.llm.near_duplicates import near_duplicates
from trialframe.llm.piece_encoding import Encoder, decode, encode
from trialframe.llm.quotations import as_replies, chosen_turn, link_quotations
from trialframe.llm.threads import conversations, reply_order

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, _size long"


def docs(spark, texts, source=None):
    rows = [(i, t, "en", source(i) if source else "s", len(t or ""), "extra", 7) for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(400)]
    out = {}
    for i in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(30, 90))]
        out[i] = " ".join(base)
        if i % 3 == 0:
            for k in range(3):  # near copies at several distances
                copy = list(base)
                for _ in range(k):
                    copy[rng.randrange(len(copy))] = "x"
                out[100 + 10 * i + k] = " ".join(copy)
    out |= {900: "", 901: None, 902: "  \n ", 903: "One two", 904: "one TWO", 905: "y " * 3000}
    return out


def test_near_duplicates(spark, texts):
    got = {r.doc_id: r for r in near_duplicates(docs(spark, [*texts.items(), (None, "one two")]), percent=85).collect()}
    want = components(texts, 85)
    assert {i: got[i].component_id for i in texts} == want
    assert {i: got[i].n_shingles for i in texts} == {i: len(shingles(t)) for i, t in texts.items()}
    assert all(got[i].kept == (want[i] == i) for i in texts)
    assert got[None].kept and got[None].component_id is None
    assert near_duplicates(docs(spark, [])).count() == 0


def test_a_chain_inside_one_bucket_is_followed(spark):
    """Neighbours of a chain are linked, its ends are not: the smallest member alone would lose links."""
    base = [f"v{k}" for k in range(200)]
    chain = {i: " ".join(["z%d" % k if k < 2 * i else base[k] for k in range(200)]) for i in range(30)}
    got = {r.doc_id: r.component_id for r in near_duplicates(docs(spark, chain.items()), percent=85).collect()}
    assert got == components(chain, 85)


def test_a_bucket_of_many_blocks_loses_no_link(spark, monkeypatch):
    """Versions at likenesses around the threshold, small blocks and split hubs."""
    monkeypatch.setattr(near, "BLOCK", 16)
    monkeypatch.setattr(near, "PIECE", 8)
    rng = np.random.default_rng(7)
    base = [f"v{k}" for k in range(400)]
    rows = {}
    for i in range(160):
        own = list(base)
        for k in rng.choice(400, int(rng.integers(3, 20)), replace=False):
            own[k] = f"r{i}x{k}"
        rows[1000 - i] = " ".join(own)
    want = components(rows, 85)
    got = {r.doc_id: r.component_id for r in near_duplicates(docs(spark, rows.items()), percent=85).collect()}
    assert got == want
    assert 1 < len(set(want.values())) < len(rows)


def test_open_pairs_are_those_that_a_bound_allows():
    """Every pair of a block at the threshold comes out, and none that sizes or counts rule out."""
    rng = np.random.default_rng(11)
    base = rng.integers(0, 1 << 62, 300).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, 300 - d, replace=False), rng.integers(0, 1 << 62, d).astype(np.uint64)])) for d in rng.integers(0, 60, 80)]
    bands = near.bands_for(80)
    signs = [near.band_keys(near.signature(s, bands * near.ROWS)) for s in sets]
    for k in signs:
        k[0] = 5  # all share the first band
    batch = pa.table(
        {
            "key": [5] * 80, "doc_id": range(80), "component": range(80), "outsider": [1] * 80, "partner": [1] * 80,
            "n_shingles": [len(s) for s in sets], "bins": [near.bin_counts(s) for s in sets], "keys": [k.tobytes() for k in signs],
        }
    )
    def pairs(batch):
        got = near._open_pairs(bands, 80, None)(batch)
        return set(zip(got["a"].to_pylist(), got["b"].to_pylist(), strict=True))

    found, true = pairs(batch), {}
    for i in range(80):
        for j in range(i + 1, 80):
            both = len(np.intersect1d(sets[i], sets[j]))
            true[i, j] = both / (len(sets[i]) + len(sets[j]) - both)
    alike = {p for p, x in true.items() if x >= 0.8}
    assert alike <= found
    assert len(alike) <= len(found) < len(true)
    blind = batch.set_column(6, "bins", pa.array([None] * 80, pa.binary()))  # bins too full: sizes alone decide
    assert found < pairs(blind)
    assert near.bin_counts(np.arange(1 << 20, dtype=np.uint64)) is None
    assert (near.bands_for(85), near.bands_for(80), near.bands_for(100)) == (32, 47, 1)
    assert all((1 - (p / 100) ** near.ROWS) ** near.bands_for(p) <= near.MISSED for p in (60, 80, 85, 95))


def test_fingerprints(spark, texts):
    rows = [*texts.items(), (7, texts[7])]
    got = fp.fingerprints(docs(spark, rows), chunks=6).collect()
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: (-r[0], r[1] or ""))
    follows = {(a[0], k): b[1] or "" for k, (a, b) in enumerate(zip(order, order[1:] + order[:1], strict=True))}
    likeness = {}
    for (i, _), after in follows.items():
        text = texts[i] or ""
        half = len(text) // 2
        new = text[: len(text) - half] + after[:half]
        mine, changed, theirs = (set(fp.digests(t).tolist()) for t in (text, new, after))
        share = [len(mine & x) / len(mine | x) if mine | x else 1.0 for x in (changed, theirs)]
        likeness.setdefault(i, []).append((len(text), hashlib.sha256(new.encode()).hexdigest(), *share))
    for r in got:
        assert (r.n_chars, r.edited_sha256) in [x[:2] for x in likeness[r.doc_id]]
        assert any(abs(r.near_edited - x[2]) + abs(r.near_next - x[3]) < 1e-9 for x in likeness[r.doc_id])
    marks = {}
    for r in got:
        assert marks.setdefault(texts[r.doc_id] or "", r.fingerprint) == r.fingerprint
    assert fp.fingerprints(docs(spark, [])).count() == 0
    only = fp.fingerprints(docs(spark, [(None, "a b. c"), (None, "a b. c")])).collect()
    assert [r.near_next for r in only] == [1.0, 1.0]


def test_peeling_recovers_what_differs_and_retries():
    rng = np.random.default_rng(3)
    shared, a, b = (np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (500, 40, 300))
    one, other = np.union1d(shared, a), np.union1d(shared, b)
    small = fp.Sketch(one, fp.PART), fp.Sketch(other, fp.PART)
    assert fp.peel(*small) is None
    left, right = fp.peel(fp.Sketch(one, 512), fp.Sketch(other, 512))
    assert sorted(left) == sorted(a) and sorted(right) == sorted(b)
    differ, cells = fp.difference(one, other, small)
    assert differ == len(a) + len(b) and cells > 3 * fp.PART


def test_katz(spark, texts):
    got = {r.doc_id: r for r in katz.katz_scores(docs(spark, texts.items())).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in texts}
    tokens = {i: [*words(t), "\n"] for i, t in texts.items()}
    single, pairs, after = {}, {}, {}
    for i, w in tokens.items():
        for h, x in zip([" ", *w], w) if not held[i] else ():
            single[x] = single.get(x, 0) + 1
            pairs[h, x] = pairs.get((h, x), 0) + 1
            after[h] = after.get(h, 0) + 1
    total = sum(single.values())
    stats = [[sum(c == r for c in t.values()) for r in range(1, 7)] for t in (single, pairs)]
    d1, d2 = (katz.good_turing(np.array(s)) for s in stats)

    def cut(c, d):
        return c * (d[c] if c <= 5 else 1)

    lost = total - sum(cut(c, d1) for c in single.values())

    def p1(x):
        return cut(single[x], d1) / total if x in single else lost / total

    seen, mass = {}, {}
    for (h, x), c in pairs.items():
        seen[h] = seen.get(h, 0) + cut(c, d2)
        mass[h] = mass.get(h, 0) + p1(x)

    def p(h, x):
        if h not in after:
            return p1(x)
        whole = after[h] if seen[h] < after[h] - 1e-9 else after[h] + 1
        if (h, x) in pairs:
            return cut(pairs[h, x], d2) / whole
        return (1 - seen[h] / whole) / (1 - mass[h]) * p1(x)

    for h in (" ", "w1", "one"):
        assert abs(sum(p(h, x) for x in single) + p(h, "unknown") - 1) < 1e-9
    for i, w in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[i], len(w), total)
        assert r.n_known == sum(x in single for x in w)
        assert math.isclose(r.score, sum(math.log10(p(h, x)) for h, x in zip([" ", *w], w)), rel_tol=1e-9)
        base = sum(math.log10((single.get(x, 0) + 0.5) / (total + 0.5 * (len(single) + 1))) for x in w)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
    assert katz.katz_scores(docs(spark, [])).count() == 0
    assert katz.katz_scores(docs(spark, [(None, None)])).first().n_tokens == 1


def test_katz_lets_a_batch_go_before_the_next():
    """A task with several batches holds the arrays of one; blobs are not copied out of what the task reads."""
    held = []

    class Held(np.ndarray):
        pass

    def work(batch, rows):
        assert all(h() is None for h in held)
        values = katz.unpack(rows[0][3], "u8")[0].copy().view(Held)
        held.append(weakref.ref(values))
        return [(batch, 0, 0, katz.pack(values.view(np.ndarray)))]

    blob = katz.pack(np.arange(1000, dtype=np.uint64))
    read = katz._rows([(b, 0, 0, blob) for b in range(4)])
    assert all(isinstance(r[3], pa.Buffer) for _, rows in katz._grouped([read], "batch") for r in rows)
    made = list(katz._each("batch", work)([read]))
    assert len(held) == 4 and [m.column("batch")[0].as_py() for m in made] == [0, 1, 2, 3]
    assert all(katz.unpack(m.column("blob")[0].as_buffer(), "u8")[0].tolist() == list(range(1000)) for m in made)


def test_katz_leaves_the_session_as_it_was(spark):
    before = spark.conf.get(katz.CLEANUP, None)
    assert katz.katz_scores(docs(spark, [(1, "a b a")]), order=3).count() == 1
    assert spark.conf.get(katz.CLEANUP, None) == before


def test_katz_of_higher_orders(spark, texts, monkeypatch):
    """Against plain recursion over counts of all orders, in one batch and in many."""
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in texts}
    tokens = {i: [" ", *words(t), "\n"] for i, t in texts.items()}
    counts, after = [{} for _ in range(5)], {}
    for i, w in tokens.items():
        for k in range(1, len(w)) if not held[i] else ():
            for n in range(1, min(4, k + 1) + 1):
                gram = tuple(w[k - n + 1 : k + 1])
                counts[n][gram] = counts[n].get(gram, 0) + 1
                after.setdefault(gram[:-1], {})[gram[-1]] = 0
    total = sum(counts[1].values())
    d = [None, *(katz.good_turing(np.array([sum(c == r for c in counts[n].values()) for r in range(1, 7)])) for n in range(1, 5))]

    def cut(gram):
        c = counts[len(gram)][gram]
        return c * (d[len(gram)][c] if c <= 5 else 1)

    lost = total - sum(map(cut, counts[1]))
    cache = {}

    def back(h):
        if h not in cache:
            seen, times = sum(cut((*h, x)) for x in after[h]), sum(counts[len(h) + 1][*h, x] for x in after[h])
            whole = times if seen < times - 1e-9 else times + 1
            cache[h] = whole, (1 - seen / whole) / (1 - sum(p(h[1:], x) for x in after[h]))
        return cache[h]

    def p(h, x):
        if not h:
            return cut((x,)) / total if (x,) in counts[1] else lost / total
        if h not in after:
            return p(h[1:], x)
        return cut((*h, x)) / back(h)[0] if x in after[h] else back(h)[1] * p(h[1:], x)

    for h in ((" ", "y"), ("y", "y"), ("y", "y", "y"), (" ", "one", "two")):
        assert abs(sum(p(h, x) for (x,) in counts[1]) + p(h, "unknown") - 1) < 1e-9
    differ = 0
    for order, size in ((3, katz.BATCH), (3, 50), (4, katz.BATCH)):
        monkeypatch.setattr(katz, "BATCH", size)
        got = {r.doc_id: r.score for r in katz.katz_scores(docs(spark, texts.items()).coalesce(2), order=order).collect()}
        for i, w in tokens.items():
            want = sum(math.log10(p(tuple(w[max(0, k - order + 1) : k]), w[k])) for k in range(1, len(w)))
            assert math.isclose(got[i], want, rel_tol=1e-9)
            differ += not math.isclose(want, sum(math.log10(p((w[k - 1],), w[k])) for k in range(1, len(w))), rel_tol=1e-6)
    assert differ > 20


def test_katz_asks_only_about_what_batches_share(spark, monkeypatch):
    """Two batches with one phrase in common: 2 bigrams, 1 trigram and 2 contexts of trigrams are asked for by each."""
    ids = [i for i in range(50) if zlib.crc32(str(i).encode()) % 5 != 1]
    texts = [(ids[0], "a1 a2 x y z a3"), (ids[1], "b1 b2 x y z b3")]
    made, written = [], katz._written
    monkeypatch.setattr(katz, "_written", lambda df: made.append(written(df)) or made[-1])
    apart = docs(spark, texts).rdd.map(lambda row: (tuple(row), None)).partitionBy(2, lambda row: row[0] == ids[0])
    scores = {r.doc_id: r.score for r in katz.katz_scores(spark.createDataFrame(apart.keys(), DOCS), order=3).collect()}
    rows = [r for df in made for r in df.filter("batch >= 0").collect()]
    assert len({r.batch for r in rows}) == 2

    def answers(kind, *kinds):
        return [len(katz.unpack(bytes(r.blob), *kinds)[0]) for r in rows if r.kind == kind]

    assert [sum(answers(katz.of_order(katz.COUNTS, k), "u8", "u1", "u4")) for k in (2, 3)] == [4, 2]
    masses = [katz.unpack(bytes(r.blob), "u8", *["u4"] * katz.LARGEST)[0] for r in rows if r.kind == katz.of_order(katz.TOTALS, 3)]
    assert np.concatenate(masses).tolist() == [0] * 4  # every token was seen, so no context needs its mass
    together = {r.doc_id: r.score for r in katz.katz_scores(docs(spark, texts).coalesce(1), order=3).collect()}
    assert scores.keys() == together.keys() and all(math.isclose(scores[i], together[i], rel_tol=1e-12) for i in scores)


def test_katz_memory_of_a_batch(spark, monkeypatch):
    """A batch is climbed in less than 105 bytes a token: arrays of all n-grams are not held as doubles, nor those of lower orders."""
    made, written = [], katz._written
    monkeypatch.setattr(katz, "_written", lambda df: made.append(written(df)) or made[-1])
    words = np.random.default_rng(1).zipf(1.1, 400_000) % 50_000
    batches = [(k, " ".join(map(str, words[k::4]))) for k in range(4)]
    katz.katz_scores(spark.createDataFrame(batches, "doc_id long, text string").repartitionByRange(4, "doc_id"), order=3)
    rows = sorted((r.batch, r.kind, r.part, bytes(r.blob)) for df in made for r in df.collect())
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def statistics(kind):
        return sum(np.frombuffer(r[3], "<i8") for r in rows if r[0] == -1 and r[1] == kind)

    model = katz.Model(katz.Unigrams(statistics(katz.NUMBERS)), parts, 4)
    model.discounts = {k: katz.good_turing(statistics(katz.of_order(katz.COUNTS, k))[2:]) for k in (2, 3)}
    batch = max(r[0] for r in rows)
    own = [(*r[:3], pa.py_buffer(r[3])) for r in rows if r[0] == batch and r[1] != katz.WORDS]
    monkeypatch.setattr(katz, "SLICE", 1 << 12)
    tracemalloc.start()
    try:
        tokens = len(model.texts(own, 3).p)
        assert tracemalloc.get_traced_memory()[1] < 105 * tokens
    finally:
        tracemalloc.stop()
    assert tokens == 100_001


def test_katz_orders_keys_that_share_their_upper_bits():
    rng = np.random.default_rng(3)
    for keys in (rng.integers(0, 50, 1000), rng.integers(0, 1 << 63, 1000), np.arange(0), np.array([7]), np.array([5, 3, 5, 4, 3])):
        keys = keys.astype(np.uint64)
        order, found = katz._ordered(keys)
        assert order.tolist() == np.argsort(keys, kind="stable").tolist() and found.tolist() == np.sort(keys).tolist()


ODD = ["", " ", "  a  b ", "a▁b ▁", "😀 x😀y", "日本語 テキスト", "a\x00b\tq\n\n  z", "� <s> </s> <0x41>", "x" * 3000, "   ", "ﬁ ① ß"]


def test_piece_encoding(spark):
    path = queries.piece_model(spark)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice(" ▁aé日😀\n\tb.<>") for _ in range(rng.randint(1, 40))) for _ in range(100)]
    outputs = ("n_tokens", "ids", "begins", "ends", "decoded", "covered_bytes")
    rows = encode(docs(spark, [*enumerate(texts), (-1, None), (0, "")]), path, outputs=outputs).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        text = texts[r.doc_id] if r.doc_id >= 0 else ""
        ids = [1, *library.encode(text), 2]
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.decoded == library.decode(ids)
        raw = text.encode()
        assert b"".join(raw[b:e] for b, e in zip(r.begins, r.ends, strict=True)) == raw
        assert r.covered_bytes == len(raw)


def test_spans_through_a_character_map():
    """Against the library, with a model whose map rewrites, drops and joins characters."""
    from sentencepiece import sentencepiece_model_pb2, sentencepiece_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(__import__("public_tokenizers").path("piece_bpe_32k.model"), "rb") as f:
        model.ParseFromString(f.read())
    rules = sentencepiece_model_pb2.ModelProto()
    rules.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto())
    model.normalizer_spec.precompiled_charsmap = rules.normalizer_spec.precompiled_charsmap
    for squeeze in (False, True):
        model.normalizer_spec.remove_extra_whitespaces = squeeze
        blob = model.SerializeToString()
        library, mine = sentencepiece.SentencePieceProcessor(model_proto=blob), Encoder(blob)
        for text in [*ODD, "\x01bé.\n é a\x01", "ｶﾞ ﷺ x", "\n\x01 a  "]:
            ids, begins, ends, _ = mine.encode(text.encode())
            proto = sentencepiece_pb2.SentencePieceText()
            proto.ParseFromString(library.encode(text, out_type="serialized_proto"))
            assert ids.tolist()[1:-1] == [p.id for p in proto.pieces]
            assert list(zip(begins[1:-1], ends[1:-1], strict=True)) == [(p.begin, p.end) for p in proto.pieces]


def test_warc(spark):
    long, short = "é" * 700, "same"
    rows = [(1, "http://a/1", long, 0), (5, "http://a/5", long, 0), (3, None, long, 0), (4, "u", None, 0), (6, "u", short, 0), (7, "u", short, 0), (None, "u", long, 0), (8, "u\r\nX: y", "", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, archive int")
    got = {r.page_id: r for r in warc.round_trip(pages).collect()}
    assert len(got) == len(rows)
    for i, _, html, _ in rows:
        payload = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(payload), hashlib.sha1(payload).hexdigest())
        assert (got[i].record_type, got[i].refers_to) == (("revisit", 5) if i in (1, 3) else ("response", None))
        assert got[i].payload == (None if i in (1, 3) else payload)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_broken_archives_are_noticed():
    good = warc.record(1, "u", b"payload", 7, None)
    assert [warc.parsed(m)["payload"] for m in warc.members(io.BytesIO(good + good))] == [b"payload"] * 2
    with pytest.raises(warc.BrokenArchive):
        list(warc.members(io.BytesIO(good + good[:-9])))
    with pytest.raises(warc.BrokenArchive):
        warc.parsed(next(warc.members(io.BytesIO(good))).replace(b"payload\r\n\r\n", b"PAYLOAD\r\n\r\n"))


def test_quality_counts(spark, texts):
    extra = {910: "a b c a b c x", 911: "be be be be", 912: "x\nx\n\ny\n \nx", 913: "#1 *2 & | <b> $%"}
    got = {r.doc_id: r for r in quality_votes.quality(docs(spark, (texts | extra).items())).collect()}
    for i, t in (texts | extra).items():
        w = re.findall("[^\x20\x09-\x0d]+", t or "")
        runs = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        places = {p for k, x in enumerate(runs) if runs.count(x) > 1 for p in (k, k + 1, k + 2)} if len(w) < 1000 else set(range(len(w)))
        lines = [x for x in (t or "").split("\n") if x.strip(" \t\x0b\x0c\r")]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(places))
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words) == want
        failed = len(w) < 50 or 100 * len(places) > 50 * len(w)
        assert got[i].base_failed == failed and not (failed and got[i].kept)
    assert quality_votes.quality(docs(spark, [])).count() == 0


def test_votes_recover_accuracies(spark):
    rng = random.Random(2)
    true = {"a": (0.95, 0.8), "b": (0.9, 0.7), "c": (0.85, 0.9), "d": (0.97, 0.6)}
    rows = []
    for _ in range(4000):
        good = rng.random() < 0.75
        rows.append([0 if rng.random() < 0.2 else (1 if good else -1) * (1 if rng.random() < true[k][not good] else -1) for k in true])
    found, _, share = quality_votes.estimate(spark.createDataFrame(rows, "a int, b int, c int, d int"), list(true))
    assert abs(share - 0.75) < 0.06 and all(abs(found[k] - true[k][0]) < 0.06 for k in true)


def test_toxicity_on_held_out_labels(spark):
    """On a table with enough labels to say something: 144 toxic ones are held out."""
    from conftest import SF

    sf = f"{SF.rstrip('/').rpartition('/')[0]}/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = toxicity.toxicity(spark.read.parquet(f"{sf}/documents.parquet"), labels).join(labels, "doc_id").collect()
    held = [(r.score, r.toxic, r.predicted) for r in rows if r.held_out]
    good, bad = ([s for s, t, _ in held if t == k] for k in (0, 1))
    assert sum(a > b for a in bad for b in good) >= 0.95 * len(good) * len(bad)
    assert sum(p and not t for _, t, p in held) <= 0.01 * len(good) and sum(p and t for _, t, p in held) >= 0.85 * len(bad)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    empty = toxicity.toxicity(docs(spark, [(1, None), (None, "x")]), spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r.score for r in empty.collect()] == [0.5, 0.5]


def test_mixing(spark):
    rng = random.Random(9)
    table = [(i, "w " * int(rng.paretovariate(1.2) * 20)) for i in range(600)] + [(700, ""), (701, None), (None, "a b"), (None, "a b")]
    names = ["b", "a", None, "c", "Z"]
    df = docs(spark, table, lambda i: names[(i or 0) % 5 if (i or 0) % 3 else 0])
    rows = source_mixing.mix(df).collect()
    assert len(rows) == len(table)
    size = {}
    for i, t in table:
        s = names[(i or 0) % 5 if (i or 0) % 3 else 0]
        size[s] = size.get(s, 0) + len(words(t))
    ordered = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(ordered)}
    target, left, open_ = {}, 1.5 * sum(size.values()), set(size)
    while True:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * size[s]}
        if not over:
            break
        for s in over:
            target[s] = 2 * size[s]
            left -= target[s]
        open_ -= over
    target |= {s: level * weight[s] for s in open_}
    by = {s: [r for r in rows if r.source_size == size[s]] for s in size}
    for s in size:
        assert all(math.isclose(r.target, target[s], rel_tol=1e-9) for r in by[s])
        assert abs(sum(r.taken for r in by[s]) - target[s]) <= 0.03 * target[s]
        assert math.isclose(sum(r.rate * r.size for r in by[s]), target[s], rel_tol=1e-6)
    assert all(r.taken <= 2 * r.size for r in rows)
    again = source_mixing.mix(df.repartition(7)).collect()
    assert sorted((r.doc_id or -1, r.taken) for r in rows) == sorted((r.doc_id or -1, r.taken) for r in again)
    assert source_mixing.mix(docs(spark, [])).count() == 0


def test_url_filter(spark):
    rows = ["HTTP://WWW.A.example.org/es/x?y", "https://example.org/en/12", "x://sub.org", "x://q.com/de/1", "x://q.com/fr/1#f", "a.net/es/", None, "x://b.net/p.html?u=1", "y://www.b.net/p/", "x://c.net/p", "x://c.net/p", "://", "x://notexample.org/es/"]
    pages = spark.createDataFrame([(k, u, "h") for k, u in enumerate(rows)], "page_id long, url string, host string")
    got = {r.page_id: r for r in url_filter.url_filter(pages, url_filter.repeated_urls(pages)).collect()}
    assert [got[k].rule for k in range(len(rows))] == ["example.org/es/", "example.org/en/1", None, "com/de/", "com/fr/", None, None, None, None, None, None, None, "org/"]
    assert [got[k].verdict for k in range(len(rows))] == ["block", "block", "allow", "block", "allow", "allow", "allow", "block", "block", "allow", "allow", "allow", "allow"]
    assert (got[0].host, got[0].path, got[5].host, got[5].path) == ("www.a.example.org", "/es/x", "", "")
    nothing = url_filter.url_filter(pages, pages.select(pages.url.alias("canonical")).limit(0))
    assert nothing.filter("listed").count() == 0


def test_quotations_round_trip(spark):
    rows = [(1, 0, "user", "Hello there.\nSecond line."), (1, 1, "bot", "An answer."), (1, 2, "user", None), (1, 3, "bot", "Last."), (None, 0, "user", "Alone"), (2, 0, "user", "> lost quote\nown")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): r for r in link_quotations(as_replies(table)).collect()}
    assert len(got) == len(rows)
    assert got[1, 1].body == "An answer." and got[1, 1].reply_to == 0 and got[1, 1].n_linked == got[1, 1].n_quoted == 2
    assert got[1, 2].depth_quoted == 2 and got[1, 2].reply_to == 1 and got[1, 0].reply_to is None
    assert got[2, 0].body == "own" and (got[2, 0].n_quoted, got[2, 0].n_linked) == (1, 0)


def test_most_quoted_text_decides_the_parent(spark, monkeypatch):
    """Not the latest turn with a common line; re-wrapped passages; the chosen turn of derived replies; common or rare alike."""
    rows = [(1, t, "user", "Hello,\nnothing new " + str(t)) for t in range(20)]
    rows[3] = (1, 3, "user", "Hello,\nthe build fails\nsince Monday")
    rows += [(1, 20, "bot", "> Hello,\n> the build fails\n> since Monday\n\nSee log."), (1, 21, "bot", ">Hello, the build\n>fails since   monday\nRe-wrapped.")]
    rows += [(1, 22, "bot", "> Hello,\nAny."), (1, 23, "bot", "> > Hello,\n> See log.\nThanks."), (1, 24, "bot", "> nothing new 2\n> nothing new 7\nYes.")]
    rng = random.Random(2)
    rows += [(2, t, "user", "\n".join([f"line {t}", "Hello,", *rng.sample(["aa", "bb", "cc"], 2)])) for t in range(60)]
    mail = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    derived = as_replies(mail.filter("conv_id = 2"))
    assert max(re.match("[> ]*", x).group().count(">") for r in derived.collect() for x in r.text.split("\n")) == 3
    every = mail.filter("conv_id = 1").unionByName(derived)
    want = {r.turn: r.c for r in derived.select("turn", chosen_turn(F.col("conv_id"), F.col("turn")).alias("c")).collect()}
    assert sum(c is not None and c != t - 1 for t, c in want.items()) > 20
    for common in (16, 1, 1000):
        monkeypatch.setattr(quotations, "COMMON", common)
        got = {(r.conv_id, r.turn): r for r in link_quotations(every).collect()}
        assert [got[1, t].reply_to for t in range(20, 25)] == [3, 3, 19, 20, 7]
        assert (got[1, 21].n_passages, got[1, 21].n_passages_linked, got[1, 21].n_linked) == (1, 1, 0)
        assert {t: got[2, t].reply_to for t in want} == want


def test_branching_threads_in_reply_order(spark):
    """Against a plain walk of the trees: a star, a chain, random trees, a repeated turn and missing keys."""
    rng = random.Random(3)
    parents = {1: {0: None, 1: 0, 2: 0, 3: 1, 4: 2, 5: 1, 2000: 0}, 2: {t: t - 1 if t else None for t in range(40)}}
    parents |= {3: {t: rng.randrange(t) if t else None for t in range(90)}, 4: {t: 0 if t else None for t in range(30)}, None: {0: None, 7: 0}, 5: {None: None}}
    rows = [(c, t, "user", p, f"{c}-{t}") for c, of in parents.items() for t, p in of.items()] + [(1, 1, "zebra", 0, "again")]
    linked = spark.createDataFrame(rows, "conv_id long, turn long, role string, reply_to long, body string")
    got = {(r.m.conv_id, r.m.turn): r for r in reply_order(linked).collect()}
    blocks = conversations(linked, reply_order(linked), block=16).collect()
    for c, of in parents.items():
        want, todo = [], [(t, 0) for t, p in of.items() if p is None]
        while todo:
            t, depth = todo.pop()
            r = got[c, t]
            assert (r.depth, r.place) == (depth, len(want)) and r.root == (None if c == 5 else 0)
            want += [f"{c}-{t}"] if (c, t) != (1, 1) else ["1-1", "again"]
            todo += sorted(((x, depth + 1) for x, p in of.items() if p == t and x != t and x is not None), reverse=True) if t is not None else []
        mine = sorted((b for b in blocks if b.conv_id == c), key=lambda b: b.block)
        assert [m.body for b in mine for m in b.messages] == want
        assert all(b.n_messages == len(b.messages) <= 17 for b in mine)


def test_a_filter_in_a_table_gives_the_same(spark, monkeypatch):
    urls = [f"x://h{k % 70}.net/p{k % 211}" + ".html" * (k % 2) for k in range(3000)] + [None, "no url"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    listed = url_filter.repeated_urls(pages)
    before = {tuple(r) for r in url_filter.url_filter(pages, listed).collect()}
    monkeypatch.setattr(url_filter, "MOST_BLOCKS", 8)
    assert {tuple(r) for r in url_filter.url_filter(pages, listed).collect()} == before
    assert [url_filter.blocks_for(n) for n in (0, 3200, 3201, 6_553_600)] == [64, 64, 128, 1 << 17]


def test_mixing_with_many_sources_gives_the_same(spark, monkeypatch):
    df = docs(spark, [(k, "w " * (k % 37)) for k in range(300)], lambda i: f"s{i % 9}" if i % 3 else None)

    def mixed():  # sums differ in their last digits
        return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in source_mixing.mix(df).collect())

    before = mixed()
    monkeypatch.setattr(source_mixing, "SOURCES", 3)
    assert mixed() == before


def test_texts_with_one_id_keep_their_keys(spark):
    rows = [(1, "a b c"), (1, "d e f"), (1, "g h i"), (2, "x"), (2, "x")]
    keys = [{(r.text, r._key) for r in source_mixing.keyed(docs(spark, order)).collect()} for order in (rows, rows[::-1], rows[2:] + rows[:2])]
    assert keys[0] == keys[1] == keys[2] and len(keys[0]) == 5


def test_decoding_reads_the_ids(spark):
    path = queries.piece_model(spark)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(4)
    lists = [[rng.randrange(32_000) if rng.random() < 0.7 else rng.randrange(300) for _ in range(rng.randint(0, 30))] for _ in range(300)]
    lists += [[], [1, 2], [0], [3 + 0xC3, 3 + 0xA9], [3 + 0xC3], [3 + 0xF0, 3 + 0x9F, 100], [1, 29871, 29871, 3 + 0x20, 2]]
    df = spark.createDataFrame(list(enumerate(lists)) + [(-1, None)], "k int, ids array<int>")
    got = {r.k: r.decoded for r in decode(df, path).collect()}
    assert got.pop(-1) is None
    assert all(text == library.decode(lists[k]) for k, text in got.items())
    with pytest.raises(Exception, match="does not have"):
        decode(spark.createDataFrame([([32_000],)], "ids array<int>"), path).collect()


def test_piece_query_digests(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model(spark))
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in queries.op4_piece_encoding(spark, "/root/testdata/sf0.001").collect():
        ids = [1, *library.encode(texts[r.doc_id]), 2]
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_fit_holds_one_copy_of_long_texts():
    """8 million values: 32 MB as features and values, and temporaries of a block's size besides."""
    import tracemalloc

    rng = np.random.default_rng(1)
    toxic = np.arange(400) % 2.0

    def rows():
        for k in range(400):
            at = np.unique(rng.integers(0, toxicity.FEATURES, 20_000))
            yield np.concatenate([at, [k % 2]]).astype(np.int32), np.append(np.full(len(at), 0.1), 5.0).astype(np.float32)

    tracemalloc.start()
    weights, bias = toxicity.fit(rows(), toxic)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * 8_000_000 + 120e6
    assert weights[1] > 0 > weights[0] and np.isfinite(bias)


def test_fit_against_plain_gradient_steps():
    """The minimum of the same loss, found by plain steps on dense rows."""
    rng = np.random.default_rng(2)
    toxic = (np.arange(60) % 3 == 0).astype(float)
    dense = rng.random((60, 12)) * (rng.random((60, 12)) < 0.5)
    dense[:, 0] += toxic
    rows = [(np.flatnonzero(d).astype(np.int32), d[d > 0].astype(np.float32)) for d in dense]
    weights, bias = toxicity.fit(rows, toxic)
    sizes = [(toxic == c).sum() for c in (0, 1)]
    rate = [(dense[toxic == c].sum(axis=0) + toxicity.SMOOTHING * n / 60) / n for c, n in zip((0, 1), sizes)]
    x = dense * np.log(rate[1] / rate[0])
    w, b, share = np.zeros(12), 0.0, np.where(toxic == 1, 0.5 / sizes[1], 0.5 / sizes[0])
    for _ in range(60_000):
        error = share * (1 / (1 + np.exp(-(x @ w + b))) - toxic)
        w, b = w - 2 * (x.T @ error + toxicity.RIDGE * w), b - 2 * error.sum()
    mine, plain = x @ (weights[:12] / np.log(rate[1] / rate[0])) + bias, x @ w + b
    np.testing.assert_allclose(mine, plain, atol=0.05 + 0.02 * np.abs(plain).max())


def _stage_input(spark):
    """Clean prose, planted toxic, poor, copied, null and repeated rows, with the labels to learn from."""
    rng = random.Random(6)
    good = [f"{a}{b}" for a in ("ba", "lo", "mi", "ru", "ten") for b in ("da", "ki", "mo", "ras", "vel", "in", "or")]
    bad = ["venom", "scum", "wretch", "filth", "vermin"]

    def prose(n, toxic=False):
        return " ".join(rng.choice(bad if toxic and rng.random() < 0.3 else good) for _ in range(n))

    rows, labels = [], []
    for k in range(240):
        toxic = k % 4 == 0
        rows.append((k, prose(rng.randint(80, 160), toxic), "en", "web" if k % 2 else "book", 0))
        labels.append((k, int(not toxic), int(toxic)))
    rows += [(1000 + k, rows[2 * k + 1][1], "en", "web", 0) for k in range(5)]  # copies of clean rows
    rows += [(1100, "word " * 300, "en", "web", 0), (1101, "too short", None, None, 0), (1102, None, "en", "web", None), (None, prose(90), "en", "web", 0)]
    rows += [rows[1], rows[1]]
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return documents, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows


def test_pipeline_stages(spark, tmp_path):
    """Each stage on its own input against its plain version."""
    import corpus_pipeline as cp

    documents, labels, rows = _stage_input(spark)
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(cp.STAGES)
    assert list(stages) == ["toxicity", "quality rules", "MinHash near-dedup", "mixing sources to target weights", "SentencePiece encoding and decoding"]
    names = list(cp.COLUMNS)

    def by_id(df):
        assert df.columns == names
        return sorted((str(r.doc_id) for r in df.collect()))

    kept = stages["toxicity"](spark, documents, str(tmp_path))
    left = by_id(kept)
    toxic = {str(k) for k in range(0, 240, 4)}
    assert not toxic & set(left)
    assert set(left) >= {str(r[0]) for r in rows} - toxic - {"1100", "1101", "1102"}
    assert left.count("1") == 3

    kept = stages["quality rules"](spark, documents, str(tmp_path))
    plain = {str(r[0]) for r in rows if len(words(r[1])) >= 50 and r[0] != 1100}
    assert set(by_id(kept)) <= plain  # 50 words, at most half of them repeated; the votes may reject more
    assert len(by_id(kept)) >= 0.9 * sum(str(r[0]) in plain for r in rows)

    kept = stages["MinHash near-dedup"](spark, documents, str(tmp_path))
    group = components({r[0]: r[1] for r in rows if r[0] is not None}, 80)
    assert {r for r in by_id(kept) if r != "None"} == {str(i) for i in group if group[i] == i}

    kept = stages["mixing sources to target weights"](spark, documents, str(tmp_path))
    copies = by_id(kept)
    taken = source_mixing.mix(documents).collect()
    want = sorted(str(r.doc_id) for r in taken for _ in range(r.copies))
    assert copies == want
    texts = {(r[0], r[1]) for r in rows}
    assert {(r.doc_id, r.text) for r in kept.collect()} <= texts

    library = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model(spark))
    encoded = stages["SentencePiece encoding and decoding"](spark, documents, str(tmp_path)).collect()
    assert sorted(str(r.ids) for r in encoded) == sorted(str([1, *library.encode(r[1] or ""), 2]) for r in rows)

    empty = documents.limit(0)
    for name, stage in cp.STAGES:
        if name != "toxicity":
            assert stage(spark, empty, str(tmp_path)).collect() == []
    assert stages["toxicity"](spark, empty, str(tmp_path)).collect() == []


def test_pipeline_keeps_only_ids_of_the_table(spark):
    import corpus_pipeline
    from conftest import SF

    documents = spark.read.parquet(f"{SF}/documents.parquet")
    result = {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()}
    assert result and result <= {r.doc_id for r in documents.collect()}
