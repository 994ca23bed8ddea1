"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text is its lower-cased character 3-, 4- and 5-grams, hashed to 2**18 features, each with the value
log(1 + occurrences in a thousand characters). A feature counts with its log ratio
r = log((p / |p|) / (q / |q|)), p and q being smoothed sums of its values among toxic and clean training texts; a ridge-penalised logistic regression is fitted
on the scaled features. It is fitted in one task on a bounded sample of the labelled rows (at most
`sample` ids and `characters` of whole texts of each class, those with the smallest hash of the id, whatever the size of the input). All
rows are scored in one pass over the texts, without a shuffle; the coefficients take 1 MB.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_batches
from .hashing import mix

BITS = 18
FEATURES = 1 << BITS
PART_BITS = 16
PART = 1 << PART_BITS
SIZES = (3, 4, 5)
SAMPLE = 4000
#: Characters of sampled text of a class: about 3 features each, of 4 bytes, so the fit takes 0.5 GB at most.
CHARACTERS = 20_000_000
BLOCK = 1 << 20  # features that are handled at once in the fit
SMOOTHING = 10.0
RIDGE = 1e-3
STEPS = 60
PIECE = 1 << 20  # characters that are hashed at once


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features of a text and their values. It is framed by spaces, so short texts have features too; "" has none."""
    if not text:
        return np.empty(0, np.int64), np.empty(0)
    chars = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    parts = [_hashed(chars[s : s + PIECE + SIZES[-1] - 1], PIECE) for s in range(0, len(chars), PIECE)]
    found, times = np.unique(parts[0], return_counts=True)
    if len(parts) > 1:  # a long text is counted piece by piece
        dense = np.zeros(FEATURES, np.int64)
        for part in parts:
            dense += np.bincount(part, minlength=FEATURES)
        found = np.flatnonzero(dense)
        times = dense[found]
    return found, np.log1p(times * (1000 / len(chars)))


def _hashed(chars: np.ndarray, starts: int) -> np.ndarray:
    """The features of the n-grams that begin at the first `starts` characters."""
    out, run = [], chars
    for n in range(2, SIZES[-1] + 1):
        run = run[: max(0, len(chars) - n + 1)] * np.uint64(0x100000001B3) + chars[n - 1 :]
        if n in SIZES:
            out.append(mix(run[:starts] + np.uint64(n)) >> np.uint64(64 - BITS))
    return np.concatenate(out).astype(np.int64)


class Block:
    """Some rows of the sample, with the features in parts of 2**16: 4 bytes for each value, and nothing else is kept."""

    def __init__(self, first: int, rows: list[tuple[np.ndarray, np.ndarray]]):
        self.first, self.rows = first, len(rows)
        at, value = (np.concatenate([r[k] for r in rows]) for k in (0, 1))
        owner = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
        part = at >> PART_BITS
        self.parts = []
        for p in range(FEATURES >> PART_BITS):
            mine = part == p
            begins = np.append(0, np.cumsum(np.bincount(owner[mine], minlength=len(rows))))
            self.parts.append((begins, (at[mine] & (PART - 1)).astype(np.uint16), value[mine].astype(np.float16)))


def blocks_of(rows: Iterable[tuple[np.ndarray, np.ndarray]]) -> Iterator[Block]:
    """The rows (features, values) in blocks of about `BLOCK` values."""
    held, size, first, count = [], 0, 0, 0
    for at, value in rows:
        held.append((at, value))
        size += len(at)
        count += 1
        if size >= BLOCK:
            yield Block(first, held)
            held, size, first = [], 0, count
    if held:
        yield Block(first, held)


def fit(rows: Iterable[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray) -> tuple[np.ndarray, float]:
    """Coefficients of the raw features and the intercept, from rows of (features, values) and their classes."""
    return fit_blocks(list(blocks_of(rows)), toxic)


def fit_blocks(blocks: list[Block], toxic: np.ndarray) -> tuple[np.ndarray, float]:
    """The same from blocks, the only copy of the sample; losses and gradients are added up block by block.

    With one class only, or no rows, every coefficient is 0 and the intercept gives the smoothed share.
    """
    share = (toxic.sum() + 0.5) / (len(toxic) + 1)
    if not len(toxic) or toxic.min() == toxic.max():
        return np.zeros(FEATURES), float(np.log(share / (1 - share)))

    def per_row(by_feature: np.ndarray) -> np.ndarray:
        out = np.zeros(len(toxic))
        for block in blocks:
            for p, (begins, at, value) in enumerate(block.parts):
                sums = np.append(0.0, np.cumsum(by_feature[p * PART : (p + 1) * PART][at] * value))
                out[block.first : block.first + block.rows] += sums[begins[1:]] - sums[begins[:-1]]
        return out

    def per_feature(by_row: np.ndarray) -> np.ndarray:
        out = np.zeros(FEATURES)
        for block in blocks:
            own = by_row[block.first : block.first + block.rows]
            for p, (begins, at, value) in enumerate(block.parts):
                out[p * PART : (p + 1) * PART] += np.bincount(at, weights=np.repeat(own, np.diff(begins)) * value, minlength=PART)
        return out

    seen = [per_feature((toxic == c).astype(float)) for c in (0.0, 1.0)]
    sizes = [(toxic == c).sum() for c in (0.0, 1.0)]
    # smoothed in proportion to the classes, so a feature that neither class has weighs nothing
    rate = [(n + SMOOTHING * k / len(toxic)) / k for n, k in zip(seen, sizes, strict=True)]
    ratio = np.log(rate[1] / rate[0])
    weight = np.where(toxic == 1, 0.5 / sizes[1], 0.5 / sizes[0])  # both classes weigh the same in the fit
    sign = 2 * toxic - 1

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        margin = sign * (per_row(x[:-1] * ratio) + x[-1])
        error = -weight * sign / (1 + np.exp(np.clip(margin, -40, 40)))
        grad = np.append(ratio * per_feature(error) + RIDGE * x[:-1], error.sum())
        return float((weight * np.logaddexp(0, -margin)).sum() + RIDGE / 2 * (x[:-1] ** 2).sum()), grad

    x = _minimum(loss, np.zeros(FEATURES + 1))
    return x[:-1] * ratio, float(x[-1])


def _minimum(loss, x: np.ndarray, keep: int = 8) -> np.ndarray:
    """Limited-memory quasi-Newton steps with halving, for a smooth convex loss."""
    value, grad = loss(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(STEPS):
        way, factors = grad.copy(), []
        for s, y in reversed(pairs):
            factors.append((s @ way) / (s @ y))
            way -= factors[-1] * y
        way *= (pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1]) if pairs else 1 / max(1.0, np.abs(grad).sum())
        for (s, y), f in zip(pairs, reversed(factors), strict=True):
            way += (f - (y @ way) / (s @ y)) * s
        step = 1.0
        while True:
            new_value, new_grad = loss(x - step * way)
            if new_value <= value - 1e-4 * step * (grad @ way) or step < 1e-6:
                break
            step /= 2
        s, y = -step * way, new_grad - grad
        done = value - new_value < 1e-6 * value
        x, value, grad = x + s, new_value, new_grad
        pairs = [*pairs, (s, y)][-keep:] if s @ y > 0 else pairs
        if done:
            break
    return x


def _fitted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    toxic: list[int] = []

    def rows() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                toxic.append(label)
                yield grams(text or "")

    blocks = list(blocks_of(rows()))
    w, b = fit_blocks(blocks, np.array(toxic, float))
    yield pa.RecordBatch.from_arrays([pa.array([w.astype("<f4").tobytes()]), pa.array([b])], ["weights", "intercept"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, characters: int = CHARACTERS) -> tuple[bytes, float]:
    """Coefficients and intercept learned from `labels` (doc_id, toxic 0/1) and the texts of `docs`.

    Of repeated labels of an id the largest counts; null ids and labels are left out. At most 2 * sample
    ids are broadcast to find their texts, so the texts of other rows are not moved. Of a class, whole texts are taken in
    the order of the hash until they have `characters` characters.
    """
    known = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = [known.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for c in (0, 1)]
    chosen = F.broadcast(chosen[0].unionByName(chosen[1]))
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").select("doc_id", "text", "toxic")
    order = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"), "text")
    size = F.coalesce(F.length("text"), F.lit(0)) + 1
    before = F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - size
    rows = rows.withColumn("_before", before).filter(F.col("_before") < characters).drop("_before")
    # one order, whatever that of arrival
    rows = rows.repartition(1).sortWithinPartitions("doc_id", F.xxhash64("text"), "text").select("text", "toxic")
    found = rows.mapInArrow(_fitted, "weights binary, intercept double").first()
    if found is None:  # no labelled text at all: no task had a row
        return np.zeros(FEATURES, "<f4").tobytes(), 0.0
    return bytes(found.weights), found.intercept


def score(docs: DataFrame, model: tuple[bytes, float], keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The keys and `score`, the probability that a text is toxic. A null text is an empty one: the intercept's."""
    fields = [f for f in docs.select(*keys).schema]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["score double"])
    weights, intercept = model

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.frombuffer(weights, "<f4")
        for batch in text_batches(batches, "_text"):
            rows = (grams(t or "") for t in batch.column("_text").to_pylist())
            sums = [intercept + float(w[at] @ value) for at, value in rows]
            found = pa.array(1 / (1 + np.exp(-np.clip(np.array(sums), -40, 40))), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(len(keys))] + [found], [*keys, "score"])

    return docs.select(*keys, docs[text].alias("_text")).mapInArrow(run, schema)


def held_out(doc_id: str, folds: int, fold: int):
    """Whether crc32 of the id as text falls into the fold; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; labels of held-out ids are never read.

    Empty tables give an empty result; repeated rows repeat; without labels every score is 0.5.
    """
    model = train(docs, labels.filter(~held_out("doc_id", 3, 1)), sample)
    return score(docs, model).select(
        "doc_id",
        held_out("doc_id", 3, 1).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
