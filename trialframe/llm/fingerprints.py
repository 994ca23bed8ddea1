"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is cut into paragraphs at line ends, and long lines further at sentence ends or after 48
characters; each paragraph has a 64-bit digest, repeated ones a digest for each repetition. The sketch has
three equal parts; a digest goes to one cell of each, which holds the number of digests, their exclusive
or, and that of their checks. Subtracting the sketches of two versions cancels what they share; peeling cells
with one digest left recovers the digests that differ. Where a sketch is too small for that, the comparison is
retried with larger ones, sized by the difference the failed one shows, until it succeeds.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_batches
from .hashing import mix

PARAGRAPH = re.compile(r"[^\n.!?]{0,47}[.!?]+|[^\n.!?]{1,48}")
PART = 8  # cells in each part of the stored sketch
PARTS = 3
_MASK = (1 << 64) - 1


def digests(text: str) -> np.ndarray:
    """Sorted 64-bit digests of the paragraphs of a text; the second and later copies of one differ from the first."""
    found = [xxhash.xxh3_64_intdigest(p) for p in (x.strip() for x in PARAGRAPH.findall(text)) if p]
    out = set(found)
    if len(out) < len(found):
        for value, n in Counter(found).items():
            out.update(xxhash.xxh3_64_intdigest(value.to_bytes(8, "little"), k) for k in range(1, n))
    return np.sort(np.fromiter(out, np.uint64, len(out)))


class Sketch:
    """Cells of a set of digests; `part` is a power of two."""

    def __init__(self, values: np.ndarray, part: int):
        self.part = part
        self.count = np.zeros(PARTS * part, np.int64)
        self.keys = np.zeros(PARTS * part, np.uint64)
        self.checks = np.zeros(PARTS * part, np.uint64)
        checks = mix(values)
        for k in range(PARTS):
            at = places(values, part, k)
            self.count += np.bincount(at, minlength=PARTS * part)
            np.bitwise_xor.at(self.keys, at, values)
            np.bitwise_xor.at(self.checks, at, checks)

    def text(self) -> str:
        cells = (self.count.astype("<u4"), self.keys.astype("<u8"), (self.checks >> np.uint64(32)).astype("<u4"))
        return base64.b64encode(b"".join(c.tobytes() for c in cells)).decode()


def places(values: np.ndarray, part: int, k: int) -> np.ndarray:
    return ((values >> np.uint64(21 * k)) & np.uint64(part - 1)).astype(np.int64) + k * part


def peel(one: Sketch, other: Sketch) -> tuple[np.ndarray, np.ndarray] | None:
    """Digests only `one` has, and only `other` has; None where the sketches are too small.

    Every round takes out all digests that are alone in a cell.
    """
    part = one.part
    count, keys, checks = one.count - other.count, one.keys ^ other.keys, one.checks ^ other.checks
    left, right = [], []
    while True:
        alone = np.flatnonzero(np.abs(count) == 1)
        alone = alone[checks[alone] == mix(keys[alone])]
        if not len(alone):
            break
        found, first = np.unique(keys[alone], return_index=True)
        sign = count[alone[first]]
        left.append(found[sign > 0])
        right.append(found[sign < 0])
        check = checks[alone[first]]
        for k in range(PARTS):
            at = places(found, part, k)
            np.subtract.at(count, at, sign)
            np.bitwise_xor.at(keys, at, found)
            np.bitwise_xor.at(checks, at, check)
    if count.any() or keys.any():
        return None
    return np.concatenate([*left, keys[:0]]), np.concatenate([*right, keys[:0]])


def difference(one: np.ndarray, other: np.ndarray, first: tuple[Sketch, Sketch]) -> tuple[int, int]:
    """(digests that differ, cells the comparison took), starting from the stored sketches `first`.

    The parts have at most 2**21 cells; beyond what they can hold, the digests themselves are compared.
    """
    found = peel(*first)
    part = first[0].part
    while found is None:
        if part >= 1 << 21:
            return len(np.setxor1d(one, other, assume_unique=True)), 0
        # in each part the squares of the cell counts add up to the difference and what the sizes explain
        squares = int(((first[0].count - first[1].count) ** 2).sum()) // PARTS
        shown = max(0, squares - (len(one) - len(other)) ** 2 // PART, abs(len(one) - len(other)))
        part = max(2 * part, 1 << (6 * shown // 10).bit_length())
        found = peel(Sketch(one, part), Sketch(other, part))
    return len(found[0]) + len(found[1]), PARTS * part


def likeness(n_one: int, n_other: int, differ: int) -> float:
    """Shared paragraphs as a share of all; 1 for two texts without any."""
    return (n_one + n_other - differ) / (n_one + n_other + differ) if n_one + n_other else 1.0


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by the beginning of the one that follows."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_OUT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_chars", pa.int64()),
        ("edited_sha256", pa.string()),
        ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()),
        ("near_edited", pa.float64()),
        ("near_next", pa.float64()),
        ("n_paragraphs", pa.int64()),
        ("changed_paragraphs", pa.int64()),
        ("peeled_cells", pa.int64()),
    ]
)


def _compared(doc_id, text: str, mine, following: str, theirs) -> tuple:
    own, sketch = mine
    new = edited(text, following)
    changed = digests(new)
    new_sketch = Sketch(changed, PART)
    differ, cells = difference(own, changed, (sketch, new_sketch))
    apart, _ = difference(own, theirs[0], (sketch, theirs[1]))
    return (
        doc_id,
        len(text),
        hashlib.sha256(new.encode()).hexdigest(),
        sketch.text(),
        new_sketch.text(),
        likeness(len(own), len(changed), differ),
        likeness(len(own), len(theirs[0]), apart),
        len(own),
        differ,
        cells,
    )


def _fingerprinted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by chunk, in order; the last of a chunk is a copy of the row that follows it."""

    def flush(rows):
        columns = zip(*rows, strict=True) if rows else [()] * len(_OUT)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _OUT, strict=True)], schema=_OUT)

    waiting = None  # (chunk, id, text, its digests and sketch)
    for batch in text_batches(batches, "text"):
        rows = []
        for chunk, tail, doc_id, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            found = digests(text)
            now = (chunk, doc_id, text, (found, Sketch(found, PART)), tail)
            if waiting is not None and waiting[0] == chunk and not waiting[4]:
                rows.append(_compared(waiting[1], waiting[2], waiting[3], text, now[3]))
            waiting = now if waiting is None or waiting[0] != chunk or not waiting[4] else waiting
        yield flush(rows)


def fingerprints(docs: DataFrame, chunks: int | None = None) -> DataFrame:
    """Fingerprint, edited fingerprint and likenesses of every row of `docs` (doc_id, text).

    The next document is the next smaller doc_id, after the smallest the largest; rows with equal ids
    are ordered by their texts, rows without id come after all others. A null text is empty. A single
    row follows itself; an empty table stays empty; other columns are not read.

    The ids are cut into chunks at quantiles, which are ids themselves. The first row of each
    chunk is copied to the end of the one before, so every chunk finds its successors in one sorted stream;
    texts are shuffled once, and a task holds two of them at a time.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks = chunks or 4 * parts
    shares = [k / chunks for k in range(1, chunks)]
    ends = rows.agg(
        F.percentile_approx("doc_id", shares, F.lit(20 * chunks)).alias("cuts"),
        F.max("doc_id").alias("top"),
        F.max(F.col("doc_id").isNull()).alias("nulls"),
    ).first()
    # chunk k holds the ids in (bounds[k - 1], bounds[k]], null ids form a chunk of their own below all
    bounds = sorted({*(ends.cuts or []), *([] if ends.top is None else [ends.top])})
    first_of = {b: k for k, b in enumerate(bounds)}
    last = -1 if ends.nulls else 0
    empty = ends.top is None  # only null ids, if any

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limits = np.array(bounds, np.int64)
        for batch in text_batches(batches, "text"):
            ids = batch.column("doc_id")
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            values = ids.fill_null(0).to_numpy(zero_copy_only=False)
            chunk = np.where(known, np.searchsorted(limits, values), -1).astype(np.int32)
            yield _dealt(batch, chunk, 0)
            # the largest id of a chunk is its first row: it also ends the chunk above, the top one the lowest
            edge = np.flatnonzero([k and v in first_of or not k and empty for k, v in zip(known.tolist(), values.tolist(), strict=True)])
            if len(edge):
                above = [last if not known[e] or first_of[int(values[e])] == len(bounds) - 1 else first_of[int(values[e])] + 1 for e in edge]
                yield _dealt(batch.take(pa.array(edge)), np.array(above, np.int32), 1)
            # rows without an id follow the smallest one
            lost = np.flatnonzero(~known)
            if len(lost) and not empty:
                yield _dealt(batch.take(pa.array(lost)), np.zeros(len(lost), np.int32), 1)

    dealt = rows.mapInArrow(deal, "chunk int, tail int, doc_id long, text string")
    ordered = dealt.repartition(parts, "chunk").sortWithinPartitions("chunk", "tail", F.desc_nulls_last("doc_id"), "text")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_paragraphs long, changed_paragraphs long, peeled_cells long"
    return ordered.mapInArrow(_fingerprinted, schema)


def _dealt(batch: pa.RecordBatch, chunk: np.ndarray, tail: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(chunk), pa.array(np.full(len(chunk), tail, np.int32)), batch.column("doc_id"), batch.column("text")],
        ["chunk", "tail", "doc_id", "text"],
    )
