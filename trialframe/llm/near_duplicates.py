"""Near-duplicate documents: circulant MinHash, banding, and exact Jaccard verification.

Two permutations make the whole signature. The first spreads the shingles over a universe of
2**20 places; the second, circularly shifted by 0, 1, 2, ..., gives the value of a place in each
coordinate, so the values of one shingle are one contiguous window of a single table. Bands of
the signature send alike documents to the same bucket, and links are confirmed on full sets.

Buckets are never expanded into all pairs. Documents with equal shingle sets are one node. Every
member of a bucket is first compared with the smallest member; verified links are contracted to
components. Only buckets that still hold several components are looked at again: members outside
the bucket's main component are compared with the rest in blocks, by counts of their shingles in 512
bins: the overlap of two sets is at most the sum of the smaller counts. Pairs that this bound rules out are
left, the likeliest others are verified, 16 for each document and block, then all that are left.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache
from math import ceil, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, text_batches
from .components import components
from .hashing import hashed_words, mix

UNIVERSE = 1 << 20
ROWS = 5  # coordinates of a band
MISSED = 1e-8  # chance that two sets at the threshold share no band
SHINGLE = 5
BLOCK = 1024
#: Partners verified for each outsider and block; in the last round all.
ROUNDS = (16, None)
#: Bins of a set's shingle counts, a byte each; a set with a fuller bin has no counts and is always verified.
BINS = 512
#: Pairs of one smaller id that meet its set in one piece of a join.
PIECE = 2048


def bands_for(percent: int) -> int:
    """Bands that sets with a Jaccard of percent / 100 all miss with a chance of at most `MISSED`: 32 at 85, 47 at 80."""
    agree = (percent / 100) ** ROWS
    return 1 if agree >= 1 else ceil(log(MISSED) / log1p(-agree))


@cache
def shifted_table(width: int) -> np.ndarray:
    """Row p holds the second permutation at p, p + 1, ..., p + width - 1, circularly; a view, not a copy."""
    order = np.random.default_rng(104729).permutation(UNIVERSE).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([order, order[: width - 1]]), width)


def signature(shingles: np.ndarray, width: int) -> np.ndarray:
    """The first `width` coordinates of the set of 64-bit shingle hashes (not empty)."""
    places = np.unique(mix(shingles ^ np.uint64(0xA5A5A5A5)) >> np.uint64(44)).astype(np.int64)
    rows = shifted_table(width)
    out = rows[places[:512]].min(axis=0)
    for start in range(512, len(places), 512):
        np.minimum(out, rows[places[start : start + 512]].min(axis=0), out=out)
    return out


def band_keys(sign: np.ndarray) -> np.ndarray:
    """The bucket of each band of a signature."""
    rows = sign.reshape(-1, ROWS)
    key = np.arange(1, len(rows) + 1, dtype=np.uint64)
    for column in rows.T:
        key = mix(key * np.uint64(0x100000001B3) + column)
    return key.view(np.int64)


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """For each text its sorted distinct hashed shingles: `size` words, or all words where there are fewer."""
    for _, words, bounds in hashed_words(texts):
        run = np.zeros(max(0, len(words) - size + 1), np.uint64)
        for j in range(size):
            run = mix(run * np.uint64(0x100000001B3) + words[j : j + len(run)])
        for start, stop in zip(bounds[:-1], bounds[1:], strict=True):
            n = stop - start
            if n >= size:
                yield np.unique(run[start : stop - size + 1])
            elif n:
                x = np.uint64(n)
                with np.errstate(over="ignore"):
                    for w in words[start:stop]:
                        x = mix(x * np.uint64(0x100000001B3) + w)
                yield np.array([x])
            else:
                yield np.empty(0, np.uint64)


def bin_counts(shingles: np.ndarray) -> bytes | None:
    """How many shingles of a set fall into each bin."""
    counts = np.bincount((mix(shingles + np.uint64(3)) % np.uint64(BINS)).astype(np.int64), minlength=BINS)
    return counts.astype(np.uint8).tobytes() if counts.max() <= 255 else None


def _features(bands: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, "text"):
            sizes, digests, keys = [], [], []
            for found in shingle_sets(batch.column("text")):
                sizes.append(len(found))
                if not len(found):
                    digests.append(None)
                    keys.append(None)
                    continue
                ends = mix(found + np.uint64(1))
                digests.append(np.array([len(found), ends.sum(), np.bitwise_xor.reduce(mix(ends))], np.uint64).tobytes())
                keys.append(band_keys(signature(found, bands * ROWS)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(sizes, pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.array(keys, pa.list_(pa.int64())),
                ],
                ["doc_id", "n_shingles", "digest", "bands"],
            )

    return run


def _set_rows(bands: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, "text"):
            found = list(shingle_sets(batch.column("text")))
            keys = [band_keys(signature(s, bands * ROWS)).tobytes() if len(s) else None for s in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64())),
                    pa.array([bin_counts(s) if len(s) else None for s in found], pa.binary()),
                    pa.array(keys, pa.binary()),
                ],
                ["doc_id", "shingles", "bins", "keys"],
            )

    return run


def _open_pairs(bands: int, percent: int, most: int | None):
    """For one block of outsiders and one block of other members: the likeliest partners of each outsider, or all.

    Partners are ruled out by the greatest overlap that sizes and bin counts allow, never by an estimate. A pair that
    shares several buckets is looked at in that of its first shared band only.
    """

    def pairs(batch: pa.Table) -> pa.Table:
        out = np.asarray(batch.column("outsider"))
        ids, comp = np.asarray(batch.column("doc_id")), np.asarray(batch.column("component"))
        size = np.asarray(batch.column("n_shingles"))
        full = np.asarray(batch.column("bins").is_null())  # no counts: nothing is known but the size
        bins = np.frombuffer(b"".join(b or bytes(BINS) for b in batch.column("bins").to_pylist()), np.uint8).reshape(-1, BINS)
        keys = np.frombuffer(b"".join(batch.column("keys").to_pylist()), np.int64).reshape(-1, bands)
        here = batch.column("key")[0].as_py()
        mine, other = np.flatnonzero(out), np.flatnonzero(np.asarray(batch.column("partner")))
        left, right = [], []
        for i in mine:
            low, high = np.minimum(size[i], size[other]), np.maximum(size[i], size[other])
            fit = other[(comp[other] != comp[i]) & (100 * low >= percent * high)]
            fit = fit[keys[i][(keys[fit] == keys[i]).argmax(axis=1)] == here]
            both = np.minimum(bins[fit], bins[i]).sum(axis=1, dtype=np.int64)
            both = np.where(full[fit] | full[i], np.minimum(size[fit], size[i]), both)
            union = size[fit] + size[i] - both
            may = 100 * both >= percent * union
            fit, likeness = fit[may], both[may] / union[may]
            best = np.argsort(-likeness, kind="stable")[:most]
            left += [ids[i]] * len(best)
            right += list(ids[fit[best]])
        a, b = np.minimum(left, right).astype(np.int64), np.maximum(left, right).astype(np.int64)
        return pa.table({"a": a, "b": b})

    return pairs


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The distinct pairs (a, b) whose full sets are alike enough.

    A set that is the smaller id of many pairs is copied, once for each `PIECE` of them, and its pairs are dealt over the copies.
    """
    left = sets.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("na"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("nb"), F.col("shingles").alias("sb"))
    pieces = pairs.groupBy("a").agg(F.ceil(F.count("*") / PIECE).cast("int").alias("pieces"))
    hubs = staged(pieces.filter("pieces > 1"))  # written, so that its size decides how it is joined
    one = F.coalesce("pieces", F.lit(1))
    copies = left.join(hubs, "a", "left").withColumn("piece", F.explode(F.sequence(F.lit(0), one - 1))).drop("pieces")
    dealt = pairs.join(hubs, "a", "left").withColumn("piece", F.pmod(F.xxhash64("b"), one).cast("int")).drop("pieces")
    both = F.size(F.array_intersect("sa", "sb")).cast("long")
    return (
        dealt.join(right, "b")
        .join(copies, ["a", "piece"])
        .filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
        .filter(100 * both >= percent * (F.col("na") + F.col("nb") - both))
        .select("a", "b")
    )


def _labelled(members: DataFrame, links: DataFrame) -> DataFrame:
    """Members with the component of their node so far; a node without links is its own."""
    return members.join(links, members.doc_id == links.node, "left").withColumn(
        "component", F.coalesce("component", "doc_id")
    ).drop("node")


def _blocks(members: DataFrame) -> DataFrame:
    """Outsiders and partners of buckets with several components, dealt into pairs of blocks.

    The main component of a bucket is its largest. An outsider is met with every block of the bucket, a
    member of the main component only with the blocks of outsiders, so a bucket that is almost
    settled costs in proportion to its size.
    """
    sizes = members.groupBy("key", "component").agg(F.count("*").alias("n"))
    shape = (
        sizes.groupBy("key")
        .agg(
            F.max(F.struct("n", -F.col("component"), "component")).alias("top"),
            F.sum("n").alias("all"),
            F.count("*").alias("parts"),
        )
        .filter("parts > 1 AND all > 2")
        .select(
            "key",
            F.col("top.component").alias("main"),
            F.ceil(F.col("all") / BLOCK).cast("int").alias("blocks"),
            F.ceil((F.col("all") - F.col("top.n")) / BLOCK).cast("int").alias("outer_blocks"),
        )
    )
    open_members = members.join(shape, "key").withColumn("spread", F.xxhash64("doc_id"))
    outside = F.col("component") != F.col("main")
    as_outsider = open_members.filter(outside).select(
        "key", "doc_id", "component",
        F.pmod("spread", F.col("outer_blocks")).cast("int").alias("i"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"),
        F.lit(1).alias("outsider"), F.lit(0).alias("partner"),
    )
    as_partner = open_members.select(
        "key", "doc_id", "component",
        F.explode(F.sequence(F.lit(0), F.col("outer_blocks") - 1)).alias("i"),
        F.pmod("spread", F.col("blocks")).cast("int").alias("j"),
        F.lit(0).alias("outsider"), F.lit(1).alias("partner"),
    )
    return as_outsider.unionByName(as_partner)


def near_duplicates(docs: DataFrame, percent: int = 80, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): components of documents with a Jaccard of percent / 100 or more.

    Sets are distinct 5-word shingles of lower-cased words, or the whole sequence of a shorter text. A
    null or wordless text has no shingles and links with nothing. Rows with one id are one node, so
    repeated rows repeat their result; a row without an id links with nothing, is kept, and has a null
    component. The smallest id of a component is kept. Other columns are not read. An empty table gives
    an empty result. The number of bands follows `percent`: two texts at the threshold share no bucket with a chance
    of 1e-8 at most. Of the pairs that share a bucket none is left out but by a bound on its overlap.
    """
    bands = bands_for(percent)
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"))
    features = staged(
        docs.mapInArrow(
            _features(bands), "doc_id long, n_shingles long, digest binary, bands array<long>"
        )
    )
    named = features.filter("doc_id IS NOT NULL AND n_shingles > 0")
    nodes = named.groupBy("digest").agg(
        F.min("doc_id").alias("doc_id"),
        F.first("n_shingles").alias("n_shingles"),
        F.first("bands").alias("bands"),
    )
    nodes = staged(nodes)
    buckets = nodes.select("doc_id", F.explode("bands").alias("key"))
    shared = (
        buckets.groupBy("key")
        .agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
        .filter("first_id < last_id")
        .select("key", "first_id")
    )
    members = staged(buckets.join(shared, "key"))
    suspects = members.select("doc_id").distinct()
    sets = staged(
        docs.join(suspects, "doc_id", "left_semi")
        .mapInArrow(_set_rows(bands), "doc_id long, shingles array<long>, bins binary, keys binary")
        .withColumn("n_shingles", F.size("shingles").cast("long"))
    )
    counted = sets.filter("keys IS NOT NULL").select("doc_id", "n_shingles", "bins", "keys")

    pairs = staged(
        members.filter("doc_id != first_id")
        .select(F.col("first_id").alias("a"), F.col("doc_id").alias("b"))
        .distinct()
    )
    links = staged(components(_verified(pairs, sets, percent)))
    tested = pairs
    for most in ROUNDS:
        blocks = _blocks(_labelled(members.select("key", "doc_id"), links)).join(counted, "doc_id")
        found = (
            blocks.groupBy("key", "i", "j")
            .applyInArrow(_open_pairs(bands, percent, most), "a long, b long")
            .distinct()
            .join(tested, ["a", "b"], "left_anti")
        )
        found = staged(found)
        if found.isEmpty():
            continue  # the likeliest may all be tested while others are not
        new = _verified(found, sets, percent)
        known = links.select(F.col("node").alias("a"), F.col("component").alias("b"))
        links = staged(components(known.unionByName(new)))
        tested = tested.unionByName(found)

    node_of = nodes.select("digest", F.col("doc_id").alias("node"))
    classes = node_of.join(links, "node", "left").select(
        "digest", F.coalesce("component", "node").alias("class_component")
    )
    by_id = (
        named.select("doc_id", "digest").join(classes, "digest").groupBy("doc_id").agg(F.min("class_component").alias("component_id"))
    )
    return features.select("doc_id", "n_shingles").join(by_id, "doc_id", "left").select(
        "doc_id",
        "n_shingles",
        F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component_id", "doc_id"), F.lit(True)).alias("kept"),
    )
