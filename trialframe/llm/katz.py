"""Katz back-off n-grams: Good-Turing discounted counts with exactly normalised back-off weights.

Texts are read once and kept as batches of word numbers. A batch asks each table only for the n-grams it has:
the requests, with the batch's own training counts, are dealt by a hash of the n-gram into the parts of
the tables of each order, whose tasks add up the counts and answer in the order of the
request. So n-grams are pre-aggregated a batch at a time before any shuffle, a frequent word is one entry for each
batch, and no table is ever broadcast or held by one task. Requests and answers are written tables of
packed columns, (batch, kind, part, blob); every job can be repeated after a loss.

An answer also says whether no other batch asked for the n-gram. Such an n-gram, and so every longer one that holds it, is nowhere
else: the batch has its counts and what follows it, and asks nothing about longer ones (it reports how often which count occurs).

    p(w)     = d(c) c(w) / N, what is left going to the one class of unknown words
    p(w | h) = d(c) c(h w) / C(h) for seen n-grams, else a(h) p(w | h without its first word); a(h) = 1 for an unseen h

d is the Good-Turing discount of the order for counts up to 5, and 1 above. C(h) is the count of h, or one
more where no seen n-gram of h is discounted; a(h) makes the probabilities after h sum to 1. The context of
the first word is a begin mark, and nothing is before that; the end of a text is a token. Every order repeats one step:
its contexts are the keys of the n-grams of the order below, and a batch knows the lower p of each of its tokens.
The key of a word is its mixed 64-bit number, that of a longer n-gram a 64-bit hash of its context's key and its last word's;
parts are ranges of keys. There are as many parts as the text has blocks of 64 MB, or shuffle partitions if those are more.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, text_batches
from .hashing import hashed_words, mix
from .toxicity import held_out

BATCH = 1_750_000  # tokens of a batch; a longer text is a batch of its own
LARGEST = 5  # counts above are not discounted
END = np.uint64(0)  # hash of the end token
BEGIN = np.uint64(0xFFFFFFFFFFFFFFFF)  # key of the begin context
PART_BYTES = 64 << 20  # text behind one part of a table
UNIT = 2.0**-52  # masses are sums of so many units; nothing but 1 - mass is used, which a double rounds as much
ALL = 1e-12  # a context that leaves no more than this is one after which everything was seen
SLICE = 1 << 18  # tokens or contexts that are worked out at once
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
SCHEMA = "batch long, kind int, part int, blob binary"
_FIELDS = pa.schema([("batch", pa.int64()), ("kind", pa.int32()), ("part", pa.int32()), ("blob", pa.binary())])
TEXTS, WORDS, NUMBERS, GRAMS, COUNTS, SUMS, TOTALS = range(7)
TOLD = -1  # kind of the statistics of n-grams that no part is asked about
FIRST, ALONE = 1, 2  # marks of answers


def of_order(kind: int, order: int) -> int:
    """Kind of the rows of an order from 2 on."""
    return kind + 4 * (order - 2)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value.

    Bytes of one weight lie together, so the zeros of small numbers cost nothing.
    """
    values = [np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes() for a in arrays]
    batch = pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in values], [str(k) for k in range(len(values))])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    batch = next(iter(pa.ipc.open_stream(blob)))
    out = []
    for column, kind in zip(batch.columns, map(np.dtype, kinds), strict=True):
        data = np.frombuffer(column[0].as_buffer(), np.uint8)
        out.append(np.ascontiguousarray(data.reshape(kind.itemsize, -1).T).reshape(-1).view(kind))
    return out


def packed_keys(keys: np.ndarray) -> np.ndarray:
    """Sorted keys or numbers as differences, which compress well; `np.cumsum` undoes it."""
    return np.diff(keys, prepend=np.uint64(0))


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _FIELDS, strict=True)], schema=_FIELDS)


def _grouped(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[tuple]]]:
    """Runs of sorted rows with one value of `key`, as (batch, kind, part, blob); blobs are not copied."""
    now, rows = None, []
    for batch in batches:
        blobs = batch.column("blob")
        for k, row in enumerate(zip(*[batch.column(c).to_pylist() for c in ("batch", "kind", "part")], strict=True)):
            value = row[_FIELDS.get_field_index(key)]
            if rows and value != now:
                yield now, rows
                rows = []
                pa.default_memory_pool().release_unused()
            now = value
            rows.append((*row, blobs[k].as_buffer()))
    if rows:
        yield now, rows


def _each(key: str, work):
    """Rows of `work` for each group of `_grouped`; what it holds goes before the next group is begun."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for value, rows in _grouped(batches, key):
            if made := work(value, rows):
                yield _rows(made)
            made = None

    return run


def _ask(batch: int, kind: int, part: np.ndarray, keys: np.ndarray, *values: np.ndarray) -> Iterator[tuple]:
    """Requests of a batch; keys are ordered by (part, key)."""
    bounds = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
    for start, stop in zip(bounds[:-1], bounds[1:], strict=True):
        yield batch, kind, int(part[start]), pack(packed_keys(keys[start:stop]), *[v[start:stop] for v in values])


def _ordered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the keys in their order, equal ones as they came, and the keys in order.

    The upper bits of a key and its place are sorted as one number, which is several times faster than sorting places.
    Keys are hashes, so few that differ share the upper bits; those are put in order afterwards.
    """
    bits = np.uint64(max(len(keys) - 1, 1).bit_length())
    low = (np.uint64(1) << bits) - np.uint64(1)
    order = (keys & ~low) | np.arange(len(keys), dtype=np.uint64)
    order.sort()
    order &= low
    order = order.view(np.int64)
    found = keys[order]
    upper = found >> bits
    for group in np.unique(upper[1:][found[1:] < found[:-1]]):
        s = slice(np.searchsorted(upper, group), np.searchsorted(upper, group, side="right"))
        order[s] = order[s][np.argsort(found[s], kind="stable")]
        found[s] = keys[order[s]]
    return order, found


def _new(found: np.ndarray) -> np.ndarray:
    """Which of the ordered keys are the first of their value."""
    new = np.ones(len(found), bool)
    new[1:] = found[1:] != found[:-1]
    return new


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Parts of keys; keys are hashes, and parts are ranges of them."""
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)


def _unique(keys: np.ndarray, training: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, training counts, and where each input key is."""
    order, found = _ordered(keys)
    new = _new(found)
    found, where = found[new], np.empty(len(keys), np.int32)
    where[order] = np.cumsum(new, dtype=np.int32) - 1
    return found, np.bincount(where[training], minlength=len(found)).astype(np.uint32), where


def _steps(numbers: np.ndarray) -> np.ndarray:
    """Numbers that grow, but for zeros between them, as differences from the last that is not 0."""
    out = numbers.copy()
    some = np.flatnonzero(numbers)
    out[some] = np.diff(numbers[some], prepend=np.uint32(0))
    return out


def _numbers(steps: np.ndarray) -> np.ndarray:
    return np.where(steps > 0, np.cumsum(steps, dtype=np.uint32), np.uint32(0))


def _statistics(counts: np.ndarray) -> np.ndarray:
    """All counts, keys with a count, keys with count 1 to 6."""
    least = np.bincount(counts[counts <= LARGEST + 1].astype(np.int64), minlength=LARGEST + 2)[1:]
    return np.concatenate([[counts.sum(dtype=np.int64), np.count_nonzero(counts)], least]).astype("<i8")


def gram_keys(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Keys of n-grams from the keys of their contexts and last words."""
    with np.errstate(over="ignore"):
        return mix(context * np.uint64(0x9E3779B97F4A7C15) + word)


def tokenised(docs: DataFrame, parts: int) -> DataFrame:
    """TEXTS and WORDS rows: batches of texts as numbers of their distinct words, and those words with training counts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made = TaskContext.get().partitionId() << 32, 0
        ids, known, held, words, sizes, size = [], [], [], [], [], 0

        def flush():
            tokens, lengths = np.concatenate(words), np.concatenate(sizes)
            out = np.concatenate(held)
            keys, counts, place = _unique(tokens, np.repeat(~out, lengths))
            # in the stored texts frequent words have small numbers; `back` leads to the order of the requests
            back = np.argsort(-np.bincount(place, minlength=len(keys)), kind="stable")
            rank = np.empty(len(back), np.uint32)
            rank[back] = np.arange(len(back))
            blob = pack(np.concatenate(ids), np.concatenate(known), out, lengths, rank[place], back.astype(np.uint32))
            return _rows([(first + made, TEXTS, -1, blob), *_ask(first + made, WORDS, part_of(keys, parts), keys, counts)])

        for batch in text_batches(batches, "text"):
            for start, hashes, bounds in hashed_words(batch.column("text")):
                n = len(bounds) - 1
                here = batch.slice(start, n)
                words.append(np.insert(hashes, bounds[1:], END))
                sizes.append(np.diff(bounds) + 1)
                known.append(here.column("doc_id").is_valid().to_numpy(zero_copy_only=False))
                ids.append(here.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False))
                held.append(here.column("held_out").to_numpy(zero_copy_only=False))
                size += len(words[-1])
                if size >= BATCH:
                    yield flush()
                    made, size = made + 1, 0
                    ids, known, held, words, sizes = [], [], [], [], []
        if sizes:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id", 5, 1).alias("held_out"), "text")
    return rows.mapInArrow(run, SCHEMA)


def summed(requests: DataFrame, answer: int, parts: int, last: bool = False) -> DataFrame:
    """Add up the requests of each part; answers in the order of the requests, and one row of statistics (batch -1).

    Answers: the count of each key, `FIRST` if this is the first request for it and `ALONE` if it is the only one, and its number in the
    part (0 if it has none: those without training texts, and n-grams that are alone). N-grams of the last order are no contexts, so they
    have no number and no `ALONE`. Statistics: as `_statistics`, with those that batches told.
    """

    def sums(part: int, rows: list[tuple]) -> list[tuple]:
        told = sum((np.frombuffer(r[3], "<i8") for r in rows if r[1] == TOLD), np.zeros(2 + LARGEST + 1, "<i8"))
        rows = [r for r in rows if r[1] != TOLD]
        if not rows:
            return [(-1, answer, part, told.tobytes())]
        asked = [unpack(r[3], "u8", "u4") for r in rows]
        stop = np.cumsum([len(a[0]) for a in asked])
        order, found = _ordered(np.concatenate([np.cumsum(a[0], dtype=np.uint64) for a in asked]))
        new = _new(found)
        where = np.empty(len(order), np.int32)
        where[order] = np.cumsum(new, dtype=np.int32) - 1
        first = np.flatnonzero(new)
        counts = np.bincount(where, weights=np.concatenate([a[1] for a in asked]), minlength=len(first)).astype(np.uint64)
        alone = np.diff(first, append=len(order)) == 1
        mark = np.zeros(len(order), np.uint8)
        mark[order[first]] = np.where(alone & (not last), FIRST | ALONE, FIRST)
        numbered = (counts > 0) & ((not last) & ~alone if answer != NUMBERS else True)
        numbers = np.where(numbered, np.cumsum(numbered), 0).astype(np.uint32)
        made = []
        for row, e, a in zip(rows, stop, asked, strict=True):
            s = slice(e - len(a[0]), e)
            at = where[s]
            made.append((row[0], answer, part, pack(counts[at], mark[s], _steps(numbers[at]))))
        return [*made, (-1, answer, part, (_statistics(counts) + told).tobytes())]

    return requests.repartition(parts, "part").sortWithinPartitions("part", "batch").mapInArrow(_each("part", sums), SCHEMA)


def statistics(answers: DataFrame) -> np.ndarray:
    """Sums of the statistics rows: one row for each part reaches the driver."""
    rows = answers.filter("batch = -1").select("blob").collect()
    return sum((np.frombuffer(bytes(r.blob), "<i8") for r in rows), np.zeros(2 + LARGEST + 1, np.int64))


def good_turing(least: np.ndarray) -> np.ndarray:
    """Discounts of counts 0 to 5, from the numbers of n-grams with counts 1 to 6.

    A count whose discount would not lie between 0 and 1 (too few n-grams) is halved if it is 1, else left.
    """
    n = [0, *map(int, least)]
    out = np.ones(LARGEST + 1)
    common = (LARGEST + 1) * n[LARGEST + 1] / n[1] if n[1] else 1.0
    for r in range(1, LARGEST + 1):
        value = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if n[r] and common < 1 else 1.0
        out[r] = value if 0 < value < 1 else 0.5 if r == 1 else 1.0
    return out


def discounted(counts: np.ndarray, discounts: np.ndarray) -> np.ndarray:
    return counts * discounts[np.where(counts > LARGEST, 0, counts.astype(np.int64))]


class Unigrams:
    """Discounted unigram probabilities from the statistics of the table."""

    def __init__(self, stats: np.ndarray):
        self.total, self.distinct = int(stats[0]), int(stats[1])
        self.discounts = good_turing(stats[2:])
        lost = sum((1 - self.discounts[r]) * r * stats[1 + r] for r in range(1, LARGEST + 1))
        self.whole = self.total if lost > 0 else self.total + 1
        self.unknown = (lost or 1.0) / self.whole

    def __call__(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, discounted(counts, self.discounts) / self.whole, self.unknown)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.total + 0.5 * (self.distinct + 1)))


class Grams:
    """The n-grams of one order in a batch: where their contexts are among those of the order below, and what is asked about both.

    The contexts are the distinct n-grams that `texts` has reached, and one more: the begin mark in order 2, else none.
    """

    def __init__(self, texts: Texts, order: int, parts: int, begins: int):
        none = len(texts.keys)
        keys, alone = np.append(texts.keys, BEGIN), np.append(texts.alone, False)
        self.times = np.append(texts.times, np.uint64(begins if order == 2 else 0))
        self.context = np.empty(len(texts.words), np.int32)  # of each token
        self.context[1:] = texts.at[:-1]
        self.context[np.cumsum(texts.lengths) - texts.lengths] = none
        self.known = self.times[self.context] > 0
        self.both = np.flatnonzero(self.known & (texts.count > 0)[texts.words]).astype(np.int32)
        of = self.context[self.both]
        grams = gram_keys(keys[of], texts.word_keys[texts.words[self.both]])
        self.keys, self.counts, self.place = _unique(grams, texts.training()[self.both])
        self.mark = np.zeros(len(self.keys), np.uint8)
        self.mark[self.place] = np.where(alone[of] | alone[texts.at[self.both]], FIRST | ALONE, 0)
        self.asked = np.flatnonzero(self.mark == 0).astype(np.int32)
        used = np.zeros(none + 1, bool)
        used[self.context[self.known]] = True
        numbers, part = np.append(texts.numbers, np.uint32(0)), np.append(texts.part, np.int32(0))
        asked = np.flatnonzero(used & ~alone).astype(np.int32)
        self.contexts = asked[np.lexsort((numbers[asked], part[asked]))]
        self.context_numbers, self.context_part = numbers[self.contexts].astype(np.uint64), part[self.contexts]

    def sums(self, texts: Texts, count: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many of the n-grams that this batch asked for first have each discounted count, and their lower p, by context."""
        mine = (mark & FIRST > 0) & (count > 0)
        token = np.zeros(len(self.keys), np.int32)  # a token where the n-gram is
        token[self.place] = self.both
        token, count = token[mine], count[mine]
        at, size = self.context[token], len(self.times)
        few = np.empty((LARGEST, size), np.uint32)
        for r in range(1, LARGEST + 1):
            few[r - 1] = np.bincount(at[count == r], minlength=size)
        return few, np.bincount(at, texts.p[token], size)

    def open(self, count: np.ndarray) -> np.ndarray:
        """Contexts before a token that no training text has after them: only there their mass is needed."""
        unseen = self.known.copy()
        unseen[self.both[count[self.place] > 0]] = False
        out = np.zeros(len(self.times), bool)
        out[self.context[unseen]] = True
        return out


class Texts:
    """A batch: its texts as places among its distinct words, with the answers put in, and p of each token, order by order.

    `at` is the place of the n-gram of the order reached that ends at each token, among the distinct ones: `keys`, `times` (their
    counts), `alone`, and `part` and `numbers` in the tables. A place after the last is an n-gram without training texts.
    """

    def __init__(self, rows: list[tuple], unigrams: Unigrams, parts: int):
        blob = {k: [r[2:] for r in rows if r[1] == k] for k in {r[1] for r in rows}}
        self.ids, self.known_id, self.held, self.lengths, rank, back = unpack(blob[TEXTS][0][1], "i8", "?", "?", "i8", "u4", "u4")
        self.words, self.blob, self.parts = back.astype(np.int32)[rank], blob, parts
        part, *answers = zip(*self._answers(NUMBERS), strict=True)
        self.count, mark, self.numbers = map(np.concatenate, answers)
        self.part = np.repeat(np.array(part, np.int32), list(map(len, answers[0])))
        # the key of a word is the same in every batch; one without training texts is in no key that is asked for
        self.word_keys = mix(self.numbers.astype(np.uint64) * np.uint64(parts) + self.part.astype(np.uint64))
        self.at, self.keys, self.times, self.alone = self.words, self.word_keys, self.count, mark & ALONE > 0
        self.p = unigrams(self.count)[self.words]

    def training(self) -> np.ndarray:
        return np.repeat(~self.held, self.lengths)

    def _answers(self, kind: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """The part, and (count, mark, number) of all that it was asked, in the order of the requests."""
        for part, blob in self.blob.get(kind, []):
            count, mark, steps = unpack(blob, "u8", "u1", "u4")
            yield part, count, mark, _numbers(steps)

    def answered(self, order: int, grams: Grams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(count, mark, number) of the distinct n-grams: the batch's own for those it did not ask about."""
        out = grams.counts.astype(np.uint64), grams.mark.copy(), np.zeros(len(grams.keys), np.uint32)
        start = 0
        for _, *answer in self._answers(of_order(COUNTS, order)):
            asked = grams.asked[start : start + len(answer[0])]
            for values, got in zip(out, answer, strict=True):
                values[asked] = got
            start += len(asked)
        return out

    def climb(self, order: int, grams: Grams, discounts: np.ndarray) -> None:
        """From p of the order below to p of this order."""
        self.keys = self.times = self.alone = self.numbers = self.part = None  # `grams` has what is needed of the order below
        count, mark, numbers = self.answered(order, grams)
        few, mass_after = grams.sums(self, count, mark)
        start = 0
        for _, blob in self.blob.get(of_order(TOTALS, order), []):
            mass, *some = unpack(blob, "u8", *["u4"] * LARGEST)
            contexts = grams.contexts[start : start + len(mass)]
            mass_after[contexts], few[:, contexts] = mass * UNIT, some
            start += len(mass)
        lost_after, lost_by_count = np.empty(few.shape[1]), (1 - discounts[1:]) * np.arange(1, LARGEST + 1)
        for start in range(0, len(lost_after), SLICE):  # a slice, as `few` becomes doubles
            lost_after[start : start + SLICE] = lost_by_count @ few[:, start : start + SLICE]
        del few
        times = np.append(count, np.uint64(0))
        self.at = np.full(len(self.words), len(count), np.int32)
        self.at[grams.both] = grams.place
        for start in range(0, len(grams.known), SLICE):
            known = start + np.flatnonzero(grams.known[start : start + SLICE])
            of = grams.context[known]
            lost, mass, h, c = lost_after[of], mass_after[of], grams.times[of], times[self.at[known]]
            seen = h - lost
            all_seen = 1 - mass <= ALL
            whole = np.where(all_seen, np.maximum(seen, 1e-300), np.where(lost > 0, h, h + 1))
            weight = np.where(all_seen, 0.0, (1 - seen / whole) / np.where(all_seen, 1.0, 1 - mass))
            self.p[known] = np.where(c > 0, np.maximum(discounted(c, discounts), 1e-300) / whole, weight * self.p[known])
        self.keys, self.times, self.alone, self.numbers, self.part = grams.keys, count, mark & ALONE > 0, numbers, part_of(grams.keys, self.parts)


class Model:
    """What every batch task knows: the unigram statistics, the discounts of the orders done, and how to climb them."""

    def __init__(self, unigrams: Unigrams, parts: int, begins: int):
        self.unigrams, self.parts, self.begins, self.discounts = unigrams, parts, begins, {}

    def grams(self, texts: Texts, order: int) -> Grams:
        return Grams(texts, order, self.parts, self.begins)

    def texts(self, rows: list[tuple], order: int) -> Texts:
        """A batch with p of `order`."""
        texts = Texts(rows, self.unigrams, self.parts)
        for k in range(2, order + 1):
            texts.climb(k, self.grams(texts, k), self.discounts[k])
        return texts


def _written(df: DataFrame) -> DataFrame:
    """As `staged`; the shuffle files behind it go when it is written, not when the driver happens to collect its garbage."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        return staged(df)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)


def _by_batch(rows: DataFrame, work, schema: str) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "batch").sortWithinPartitions("batch", "kind", "part").mapInArrow(work, schema)


def _gram_requests(model: Model, order: int):
    def requests(batch: int, rows: list[tuple]) -> list[tuple]:
        grams = model.grams(model.texts(rows, order - 1), order)
        told = _statistics(grams.counts[grams.mark > 0]).tobytes()
        keys = grams.keys[grams.asked]
        asked = _ask(batch, of_order(GRAMS, order), part_of(keys, model.parts), keys, grams.counts[grams.asked])
        return [(batch, TOLD, batch % model.parts, told), *asked]

    return _each("batch", requests)


def _context_requests(model: Model, order: int):
    """Each n-gram is counted by the first batch that asked for it: its count if discounted and its lower p, summed by context."""

    def requests(batch: int, rows: list[tuple]) -> list[tuple]:
        texts = model.texts(rows, order - 1)
        grams = model.grams(texts, order)
        count, mark, _ = texts.answered(order, grams)
        few, mass = (v[..., grams.contexts] for v in grams.sums(texts, count, mark))
        values = grams.open(count)[grams.contexts], np.rint(mass / UNIT).astype(np.uint64), *few
        return list(_ask(batch, of_order(SUMS, order), grams.context_part, grams.context_numbers, *values))

    return _each("batch", requests)


def _context_totals(order: int):
    """Sums by context. Where a request does not need them whole, masses are 0 and numbers of n-grams 1 at most."""

    def totals(part: int, rows: list[tuple]) -> list[tuple]:
        kinds = "u8", "?", "u8", *["u4"] * LARGEST
        numbers = [np.cumsum(unpack(r[3], *kinds)[0], dtype=np.uint64).astype(np.int64) for r in rows]
        size = max(int(n[-1]) for n in numbers) + 1
        mass, few = np.zeros(size, np.uint64), np.zeros((LARGEST, size), np.uint32)
        for n, row in zip(numbers, rows, strict=True):  # a request names each context once
            _, _, m, *f = unpack(row[3], *kinds)
            mass[n] += m
            few[:, n] += f
        made = []
        for n, row in zip(numbers, rows, strict=True):
            whole = unpack(row[3], *kinds)[1] | (1 - mass[n] * UNIT <= ALL)
            values = np.where(whole, mass[n], np.uint64(0)), *np.where(whole, few[:, n], np.minimum(few[:, n], 1))
            made.append((row[0], of_order(TOTALS, order), part, pack(*values)))
        return made

    return _each("part", totals)


def _scores(model: Model, order: int):
    def scores(rows: list[tuple]) -> pa.RecordBatch:
        texts = model.texts(rows, order)
        owner = np.repeat(np.arange(len(texts.lengths)), texts.lengths)

        def by_text(values):
            return np.bincount(owner, weights=values, minlength=len(texts.lengths))

        with np.errstate(divide="ignore"):
            score = by_text(np.log10(texts.p))
        counts = texts.count
        base = model.unigrams.base(counts)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(texts.ids, mask=~texts.known_id),
                pa.array(texts.held),
                pa.array(texts.lengths),
                pa.array(by_text((counts > 0)[texts.words]).astype(np.int64)),
                pa.array(by_text(base[texts.words])),
                pa.array(score),
            ],
            ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
        )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _grouped(batches, "batch"):
            yield scores(rows)

    return run


def katz_scores(docs: DataFrame, order: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of `docs` (doc_id, text).

    `order` is that of the longest n-grams, 1 or more. Counts come from the whole texts of rows that are not held out
    (crc32 of the id as text modulo 5 is 1). A null
    or empty text is the end token alone. A row without an id is trained on. Repeated rows repeat and count as often
    as they occur; an empty table stays empty; without training texts every token is unknown. Other
    columns are not read.
    """
    begins, size = docs.agg(F.count_if(~held_out("doc_id", 5, 1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    texts = _written(tokenised(docs, parts))
    numbers = _written(summed(texts.filter(f"kind = {WORDS}"), NUMBERS, parts))
    model = Model(Unigrams(statistics(numbers)), parts, begins)
    known = texts.filter(f"kind = {TEXTS}").unionByName(numbers.filter("batch >= 0"))
    for k in range(2, order + 1):
        asked = _by_batch(known, _gram_requests(model, k), SCHEMA)
        counts = _written(summed(asked, of_order(COUNTS, k), parts, last=k == order))
        model.discounts[k] = good_turing(statistics(counts)[2:])
        known = known.unionByName(counts.filter("batch >= 0"))
        sums = _by_batch(known, _context_requests(model, k), SCHEMA)
        totals = sums.repartition(parts, "part").sortWithinPartitions("part", "batch").mapInArrow(_context_totals(k), SCHEMA)
        known = known.unionByName(_written(totals))
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    return _by_batch(known, _scores(model, order), schema).withColumn("train_tokens", F.lit(model.unigrams.total).cast("long"))
