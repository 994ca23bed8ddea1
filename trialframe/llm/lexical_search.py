"""Ranked lexical search: exact maximum inner products in ball trees of sparse document vectors.

A document is the vector of its saturated term counts, an item the vector of its term weights, both whole numbers; the
score is their inner product. Only terms of the items matter, so texts are reduced to these once. Each task builds ball
trees over blocks of documents (halves along the line between two far documents): a node has a centroid c and a radius,
and also the farthest that its documents lie from c along each term. For an item q no document of the node scores more
than q.c + |q| * r, where r is the radius, or less if the distances along the item's own terms allow no more, and |q| counts
terms that some document of the node has. Nodes are opened best first and a subtree is pruned when its bound, rounded up, is
below the item's 50th best score so far. At the leaves scores are computed in 64-bit integers.

A first pass over a part of the documents gives each item a floor that its 50th best score surely reaches; the second
pass searches all documents and keeps only what reaches the floor, so what is ranked at the end does not grow with the
number of tasks.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, text_batches

TOP = 50
ITEMS = 256  # items that are searched at once
DOCUMENTS = 8192  # documents in a tree
ENTRIES = 4 << 20  # entries of the documents of a tree, and numbers in the tables of its nodes
LEAF = 32
FLOOR_PART = 16  # one document in so many gives the floors
#: Room for rounding in bounds, as a share of the summed sizes; sums of up to 10**5 terms lose less.
ROUNDING = 1e-9

_LETTERS = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_BETWEEN = [c for c in range(128) if not chr(c).isalnum()]
#: Byte table: A-Z in lower case, every other ASCII character than digits and letters a space.
TERMS = bytes(32 if c in _BETWEEN else _LETTERS[c] for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, in order: runs of digits, letters and all characters beyond ASCII; only A-Z lower-cased."""
    return text.translate(TERMS).split()


@dataclass
class Items:
    """A bounded set of items: their ids, and of each distinct term a number and the items that have it."""

    ids: list
    number: dict[bytes, int]
    terms: list[np.ndarray]
    weight: np.ndarray | None = None

    @classmethod
    def of(cls, ids: list, texts: list[str | None]) -> Items:
        number: dict[bytes, int] = {}
        terms = []
        for text in texts:
            own = dict.fromkeys(terms_of((text or "").encode()))
            terms.append(np.array([number.setdefault(t, len(number)) for t in own], np.int64))
        return cls(ids, number, terms)


def term_weights(documents: int, frequency: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(df) + 1))) for df in frequency], np.int64)


def saturated(times: np.ndarray, length_share: np.ndarray) -> np.ndarray:
    """The entry of a term that occurs so many times in a document of length share m."""
    return (1_000_000_000 * times) // (1000 * times + 20 * length_share)


def length_shares(lengths: np.ndarray, documents: int, total: int) -> np.ndarray:
    """m = 50 + (50 * n * N) div L; in whole numbers of any size where 64 bits would not do."""
    if 50 * int(lengths.max(initial=0)) * documents < 2**62:
        return 50 + 50 * lengths * documents // total
    return np.array([50 + 50 * int(n) * documents // total for n in lengths], np.int64)


def _reduced(docs: DataFrame, doc_id: str, text: str, items: Items) -> DataFrame:
    """(doc_id, n, terms, times): the length of each text, and which terms of the items it has how often."""
    number = items.number

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, "_text"):
            lengths, terms, times = [], [], []
            for data in batch.column("_text").cast(pa.binary()).to_pylist():
                found = terms_of(data or b"")
                lengths.append(len(found))
                at, n = np.unique(np.array([number[t] for t in found if t in number], np.int32), return_counts=True)
                terms.append(at)
                times.append(n.astype(np.int32))
            columns = [batch.column("doc_id"), pa.array(lengths, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "terms", "times"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("_text"))
    return rows.mapInArrow(run, "doc_id long, n long, terms array<int>, times array<int>")


class BallTree:
    """Ball tree over sparse rows (`begins` into `terms` and `values`), with bounds for all items of a set."""

    def __init__(self, begins: np.ndarray, terms: np.ndarray, values: np.ndarray):
        self.active, local = np.unique(terms, return_inverse=True)  # the terms that occur here
        self.begins, self.terms, self.values = begins, local.astype(np.int64), values
        rows, width = len(begins) - 1, max(1, len(self.active))
        leaf = max(LEAF, -(-4 * rows * width // ENTRIES))
        self.rows: list[np.ndarray] = []  # of each node
        self.children: list[tuple[int, int] | None] = []
        self.squares = np.add.reduceat(np.append(values.astype(float) ** 2, 0.0), begins[:-1]) * (np.diff(begins) > 0) if rows else np.zeros(0)
        sums, lows, highs = [], [], []
        stack = [(np.arange(rows), None, 0)] if rows else []
        while stack:
            members, parent, side = stack.pop()
            node = len(self.rows)
            self.rows.append(members)
            self.children.append(None)
            if parent is not None:
                pair = self.children[parent] or (0, 0)
                self.children[parent] = (node, pair[1]) if side == 0 else (pair[0], node)
            at, term, value = self._entries(members)
            total = np.bincount(term, weights=value, minlength=width)
            high, low = np.zeros(width), np.full(width, np.inf)
            np.maximum.at(high, term, value)
            np.minimum.at(low, term, value)
            low[np.bincount(term, minlength=width) < len(members)] = 0.0
            sums.append(total)
            lows.append(low)
            highs.append(high)
            if len(members) > leaf:
                first, second = self._halves(members, at, term, value, total / len(members))
                stack += [(second, node, 1), (first, node, 0)]
        if not rows:
            return
        self.centre = np.array(sums) / np.array([len(r) for r in self.rows])[:, None]
        self.present = (np.array(highs) > 0).astype(float)
        reach = np.maximum(np.array(highs) - self.centre, self.centre - np.array(lows))
        self.reach = reach * reach * (1 + ROUNDING)
        self.radius = np.array([self._radius(members, c) for members, c in zip(self.rows, self.centre, strict=True)])

    def _entries(self, members: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For the rows in order: place of the row among them, term and value of each entry."""
        counts = self.begins[members + 1] - self.begins[members]
        at = np.repeat(np.arange(len(members)), counts)
        ends = np.cumsum(counts)
        places = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.begins[members] - ends + counts, counts)
        return at, self.terms[places], self.values[places].astype(float)

    def _squared(self, members, at, term, value, point) -> np.ndarray:
        """Squared distances of rows to a point, raised by what rounding can take away."""
        own, square = self.squares[members], float(point @ point)
        dot = np.bincount(at, weights=value * point[term], minlength=len(members))
        return np.maximum(own - 2 * dot + square, 0.0) + ROUNDING * (own + square)

    def _radius(self, members: np.ndarray, centre: np.ndarray) -> float:
        return float(np.sqrt(self._squared(members, *self._entries(members), centre).max()))

    def _halves(self, members, at, term, value, centre) -> tuple[np.ndarray, np.ndarray]:
        """Rows on either side of the median along the line between two far rows; ties by row, so equal rows split too."""

        def row(k: int) -> np.ndarray:
            out = np.zeros(len(centre))
            out[term[at == k]] = value[at == k]
            return out

        far = row(int(self._squared(members, at, term, value, centre).argmax()))
        line = row(int(self._squared(members, at, term, value, far).argmax())) - far
        order = np.argsort(np.bincount(at, weights=value * line[term], minlength=len(members)), kind="stable")
        half = len(members) // 2
        return members[order[:half]], members[order[half:]]

    def bounds(self, items: Items) -> np.ndarray:
        """(node, item): no row of the node has a greater score."""
        weight = np.zeros((len(self.active), len(items.terms)))
        place = np.full(len(items.number), -1)
        place[self.active] = np.arange(len(self.active))
        for k, own in enumerate(items.terms):
            here = place[own]
            weight[here[here >= 0], k] = items.weight[own[here >= 0]]
        centre = self.centre @ weight
        span = np.sqrt(self.present @ (weight * weight))
        reach = np.minimum(self.radius[:, None], np.sqrt(self.reach @ (weight > 0)))
        return (centre + span * reach) * (1 + ROUNDING) + 1.0

    def scores(self, node: int, weight: np.ndarray) -> np.ndarray:
        """Exact scores of the rows of a node for an item given by the weights of the active terms."""
        out = np.zeros(len(self.rows[node]), np.int64)
        counts = self.begins[self.rows[node] + 1] - self.begins[self.rows[node]]
        at = np.repeat(np.arange(len(out)), counts)
        ends = np.cumsum(counts)
        places = np.arange(ends[-1]) + np.repeat(self.begins[self.rows[node]] - ends + counts, counts)
        np.add.at(out, at, weight[self.terms[places]] * self.values[places])
        return out


class Best:
    """The best documents of an item so far: by score, then by id, null ids last."""

    def __init__(self, top: int, floor: int):
        self.top, self.floor = top, max(1, floor)
        self.score, self.ids, self.null = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    def add(self, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        keep = score >= self.floor
        if not keep.any():
            return
        self.score, self.ids, self.null = (np.concatenate(x) for x in ((self.score, score[keep]), (self.ids, ids[keep]), (self.null, null[keep])))
        if len(self.score) > self.top:
            order = np.lexsort((self.ids, self.null, -self.score))[: self.top]
            self.score, self.ids, self.null = self.score[order], self.ids[order], self.null[order]
        if len(self.score) == self.top:
            self.floor = max(self.floor, int(self.score.min()))


def search(tree: BallTree, ids: np.ndarray, null: np.ndarray, items: Items, best: list[Best]) -> int:
    """Add the documents of a tree to the best of each item; the number of leaves that were scored."""
    opened = 0
    if not tree.rows:
        return 0
    bounds = tree.bounds(items)
    for k, own in enumerate(items.terms):
        if bounds[0, k] < best[k].floor:
            continue
        weight = np.zeros(len(items.number), np.int64)
        weight[own] = items.weight[own]
        weight = weight[tree.active]
        queue = [(-bounds[0, k], 0)]
        while queue and -queue[0][0] >= best[k].floor:
            _, node = heapq.heappop(queue)
            if tree.children[node] is None:
                rows = tree.rows[node]
                best[k].add(tree.scores(node, weight), ids[rows], null[rows])
                opened += 1
            else:
                for child in tree.children[node]:
                    if bounds[child, k] >= best[k].floor:
                        heapq.heappush(queue, (-bounds[child, k], child))
    return opened


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Reduced documents by blocks of at most `DOCUMENTS` rows and about `ENTRIES` / 4 entries."""
    held, rows, entries = [], 0, 0
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            held.append(part)
            rows += part.num_rows
            entries += len(part.column("terms").flatten())
            if rows >= DOCUMENTS or entries >= ENTRIES // 4:
                yield pa.Table.from_batches(held)
                held, rows, entries = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


def _searched(reduced: DataFrame, items: Items, documents: int, total: int, floors: list[int], top: int) -> DataFrame:
    """(item, doc_id, score): what each task finds best for each item, at least its floor."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(top, f) for f in floors]
        for block in _blocks(batches):
            block = block.combine_chunks()
            ids = block.column("doc_id")
            null = np.array(ids.is_null())
            ids = np.array(ids.fill_null(0), dtype=np.int64)
            lists = block.column("terms").combine_chunks()
            counts = np.array(pa.compute.list_value_length(lists), dtype=np.int64)
            terms = np.array(lists.flatten(), dtype=np.int64)
            times = np.array(block.column("times").combine_chunks().flatten(), dtype=np.int64)
            shares = length_shares(np.array(block.column("n"), dtype=np.int64), documents, total)
            values = saturated(times, np.repeat(shares, counts))
            search(BallTree(np.append(0, np.cumsum(counts)), terms, values), ids, null, items, best)
        for k, found in enumerate(best):
            n = len(found.score)
            yield pa.RecordBatch.from_arrays([pa.array([k] * n, pa.int32()), pa.array(found.ids, mask=found.null), pa.array(found.score)], ["item", "doc_id", "score"])

    return reduced.mapInArrow(run, "item int, doc_id long, score long")


def _ranked(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def _top(docs: DataFrame, doc_id: str, text: str, items: Items, top: int) -> DataFrame | None:
    """(item, rank, doc_id, score) for a bounded set of items."""
    reduced = staged(_reduced(docs, doc_id, text, items))
    documents, total = reduced.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not total:
        return None
    frequency = np.zeros(len(items.number), np.int64)
    for term, n in reduced.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        frequency[term] = n
    items.weight = term_weights(documents, frequency)
    useful = reduced.filter(F.size("terms") > 0)
    part = useful.filter(F.pmod(F.xxhash64("doc_id", "n"), F.lit(FLOOR_PART)) == 0)
    sample = _ranked(_searched(part, items, documents, total, [1] * len(items.ids), top), top)
    floors = [1] * len(items.ids)
    for item, least, n in sample.groupBy("item").agg(F.min("score"), F.count(F.lit(1))).collect():
        floors[item] = least if n == top else 1
    return _ranked(_searched(useful, items, documents, total, floors, top), top)


def top_documents(docs: DataFrame, items: DataFrame, top: int = TOP, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the `top` best documents of each item, with a score above 0.

    Equal scores rank by ascending id, null ids last, and repeated rows among themselves in any order. A null or empty
    text has no terms: such an item has no rows, such a document no rank. Repeated items each have their own rows, repeated
    documents each their own rank. Without documents the result is empty. Other columns are not read. Items are taken
    256 at a time, each time over all documents; only they, their terms and their floors are on the driver.
    """
    rows = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"))
    item_type = rows.schema["item_id"].dataType.simpleString()
    found = docs.sparkSession.createDataFrame([], f"item_id {item_type}, rank int, doc_id long, score long")
    waiting: list = []

    def searched() -> DataFrame:
        chosen = Items.of([r.item_id for r in waiting], [r.text for r in waiting])
        result = _top(docs, doc_id, text, chosen, top) if chosen.number else None
        if result is None:
            return found
        names = docs.sparkSession.createDataFrame(list(enumerate(chosen.ids)), f"item int, item_id {item_type}")
        return found.unionByName(staged(result.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")))

    for row in staged(rows).toLocalIterator():
        waiting.append(row)
        if len(waiting) == ITEMS:
            found, waiting = searched(), []
    return searched() if waiting else found
