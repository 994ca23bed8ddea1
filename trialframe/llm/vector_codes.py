"""Product codes of vectors, with norm-of-sum bounds.

Vectors of integers are cut into parts; each part position has a codebook that is refined for some rounds by assigning
every part to its nearest entry and moving entries to the mean of their parts. The codebooks of all rounds are kept.
With each part travel its code, a lower bound of its distance to every other entry and the round stamp of that bound.
In a later round the bound falls by the greatest net displacement of another entry since the stamp, the norm of the sum
of its moves, which is at most the sum of their norms. A part whose exact distance to its own entry lies under the fallen
bound keeps its code; only the others are scanned again. Distances are whole numbers and exact; bounds are rounded
to the safe side.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
ROWS = 4096  # vectors that are compared with a codebook at once
MOST = 1 << 26  # greatest size of a scaled component: sums of squares then fit 64 bits
#: A label with more than one row in so many is hot: there are fewer than that of them, so they may be broadcast.
HOT = 1000

_STATE = "vec_id long, label {label}, ints binary, code binary, bound binary, stamp binary"


def _kept(df: DataFrame, vec_id: str, vector: str, label: str) -> DataFrame:
    def unusable(x):
        return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))

    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    return rows.filter(F.col("vector").isNotNull() & ~F.exists("vector", unusable))


def scaled(vectors: pa.ListArray, width: int) -> np.ndarray:
    """floor(256 * x) of every component, a row for each vector."""
    lengths = np.diff(vectors.offsets.to_numpy())
    if (lengths != width).any():
        raise ValueError(f"vectors of {sorted(set(lengths.tolist()) - {width})} components among vectors of {width}")
    values = np.floor(SCALE * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if len(values) and np.abs(values).max() >= MOST:
        raise ValueError(f"a component of {MOST // SCALE} or more")
    return values.astype(np.int64).reshape(len(lengths), width)


def squared_distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances (rows by entries); through doubles where every step is a whole number below 2**53."""
    most = max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0))
    if 4.0 * float(most) ** 2 * max(1, x.shape[1]) < 2.0**53:
        x, entries = x.astype(np.float64), entries.astype(np.float64)
    found = (x * x).sum(axis=1)[:, None] - 2 * (x @ entries.T) + (entries * entries).sum(axis=1)
    return found.astype(np.int64)


def _nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the nearest entry (the lowest of equals), its squared distance, and a lower bound of the distance to any other."""
    found = squared_distances(x, entries)
    code = found.argmin(axis=1)
    rows = np.arange(len(x))
    best = found[rows, code]
    found[rows, code] = np.iinfo(np.int64).max
    return code, best, np.sqrt(found.min(axis=1).astype(np.float64)) * (1 - 1e-12)


def net_moves(history: list[np.ndarray], now: int, then: int) -> np.ndarray:
    """(part, entry): upper bounds of the distance between an entry now and then."""
    gap = (history[now] - history[then]).astype(np.float64)
    return np.sqrt((gap * gap).sum(axis=2)) * (1 + 1e-12)


def _greatest_other(moves: np.ndarray) -> np.ndarray:
    """(part, entry): the greatest move of any other entry of the part."""
    out = np.zeros_like(moves)
    if moves.shape[1] > 1:
        order = np.argsort(moves, axis=1)
        first, second = order[:, -1], order[:, -2]
        parts = np.arange(len(moves))
        out[:] = moves[parts, first][:, None]
        out[parts, first] = moves[parts, second]
    return out


class Codes:
    """Codes, bounds and stamps of a batch of vectors; arrays of rows by parts."""

    def __init__(self, x: np.ndarray, code: np.ndarray, bound: np.ndarray, stamp: np.ndarray):
        self.x, self.code, self.bound, self.stamp = x, code, bound, stamp
        self.scans = 0

    @classmethod
    def unknown(cls, x: np.ndarray) -> Codes:
        """No bound holds yet: every part will be scanned."""
        rows, parts = x.shape[:2]
        return cls(x, np.zeros((rows, parts), np.uint8), np.full((rows, parts), -1.0, np.float32), np.zeros((rows, parts), np.uint8))

    def assign(self, history: list[np.ndarray]) -> np.ndarray:
        """Bring the codes to the last codebook of the history; the squared distances to the assigned entries."""
        now, parts = len(history) - 1, self.x.shape[1]
        other = {int(s): _greatest_other(net_moves(history, now, int(s))) for s in np.unique(self.stamp)}
        errors = np.zeros(self.code.shape, np.int64)
        for p in range(parts):
            gap = self.x[:, p] - history[now][p][self.code[:, p]]
            own = (gap * gap).sum(axis=1)
            fall = np.zeros(len(own))
            for s, moves in other.items():
                mine = self.stamp[:, p] == s
                fall[mine] = moves[p][self.code[mine, p]]
            least = self.bound[:, p].astype(np.float64) - fall
            again = np.flatnonzero(np.sqrt(own.astype(np.float64)) * (1 + 1e-12) >= least * (1 - 1e-12))
            self.scans += len(again)
            for start in range(0, len(again), ROWS):
                rows = again[start : start + ROWS]
                code, best, second = _nearest(self.x[rows, p], history[now][p])
                self.code[rows, p], own[rows], self.stamp[rows, p] = code, best, now
                bound = second.astype(np.float32)
                self.bound[rows, p] = np.where(bound.astype(np.float64) > second, np.nextafter(bound, np.float32(0)), bound)
            errors[:, p] = own
        return errors


def _binary(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    size = rows.dtype.itemsize * int(np.prod(rows.shape[1:]))
    ends = np.arange(len(rows) + 1, dtype=np.int32) * size
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(rows)])


def _array(column: pa.Array, dtype, shape: tuple[int, ...]) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), *shape)


def _state(batch: pa.RecordBatch, shape: tuple[int, int]) -> Codes:
    x = _array(batch.column("ints"), "<i4", shape).astype(np.int64)
    code, stamp = (_array(batch.column(c), np.uint8, shape[:1]).copy() for c in ("code", "stamp"))
    return Codes(x, code, _array(batch.column("bound"), "<f4", shape[:1]).copy(), stamp)


def _written(batch: pa.RecordBatch, codes: Codes) -> pa.RecordBatch:
    columns = [batch.column("vec_id"), batch.column("label"), _binary(codes.x.astype("<i4")), _binary(codes.code), _binary(codes.bound), _binary(codes.stamp)]
    return pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "ints", "code", "bound", "stamp"])


def _moved(state: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """The codebooks after a round: each entry at floor(sum / count) of its parts; unused entries stay.

    Tasks add up their rows; (entry, component) sums are added by Spark, and as many numbers as the codebooks
    have come to the driver.
    """
    parts, entries, width = codebooks.shape

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts * entries, width + 1), np.int64)
        for batch in batches:
            codes = _state(batch, (parts, width))
            for p in range(parts):
                slots = codes.code[:, p].astype(np.int64)
                np.add.at(total, p * entries + slots, np.column_stack([codes.x[:, p], np.ones(len(slots), np.int64)]))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total.ravel()[at], pa.int64())], ["slot", "total"])

    sums = state.select("ints", "code", "bound", "stamp").mapInArrow(run, "slot long, total long")
    total = [[0] * (width + 1) for _ in range(parts * entries)]
    for slot, value in sums.groupBy("slot").agg(F.sum(F.col("total").cast("decimal(38,0)"))).collect():
        total[slot // (width + 1)][slot % (width + 1)] = int(value)
    moved = codebooks.reshape(parts * entries, width).copy()
    for slot, (*values, n) in enumerate(total):
        if n:
            moved[slot] = [v // n for v in values]
    return moved.reshape(codebooks.shape)


def codebook_digest(codebooks: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def _label_errors(rows: DataFrame) -> DataFrame:
    """`rows` with the sum of `error` over equal labels. Hot labels are joined from a broadcast of fewer than `HOT` rows."""
    sums = staged(rows.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")))
    total = sums.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = F.col("n") * HOT > total
    few = F.broadcast(sums.filter(hot).select(F.col("label").alias("_hot"), "label_error"))
    rest = sums.filter(~hot).select(F.col("label").alias("_cold"), "label_error")
    same = F.col("label").eqNullSafe(F.col("_hot"))
    cold = rows.join(few, same, "left_anti").join(rest, F.col("label").eqNullSafe(F.col("_cold")))
    return rows.join(few, same).select(*rows.columns, "label_error").unionByName(cold.select(*rows.columns, "label_error"))


def train(df: DataFrame, label_type: str, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame | None, list[np.ndarray]]:
    """The rows with codes, bounds and stamps after the last round but before the final assignment, and the history of codebooks.

    `df` has vec_id, label, vector. Without rows there is no state and no codebook.
    """
    first = df.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    if not first:
        return None, []
    width = len(first[0].vector)
    if width % parts:
        raise ValueError(f"vectors of {width} components cannot be cut into {parts} equal parts")
    start = scaled(pa.array([r.vector for r in first], pa.list_(pa.float64())), width)
    history = [np.ascontiguousarray(start.reshape(len(first), parts, width // parts).transpose(1, 0, 2))]
    shape = (parts, width // parts)
    state = None
    for _ in range(rounds):

        def run(batches: Iterable[pa.RecordBatch], history=tuple(history)) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if "vector" in batch.schema.names:
                    codes = Codes.unknown(scaled(batch.column("vector"), width).reshape(batch.num_rows, *shape))
                else:
                    codes = _state(batch, shape)
                codes.assign(list(history))
                yield _written(batch, codes)

        state = staged((df if state is None else state).mapInArrow(run, _STATE.format(label=label_type)))
        history.append(_moved(state, history[-1]))
    return state, history


def compress(
    df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) of every usable vector.

    Left out are rows whose vector is null or holds a null, NaN or infinite component. Components are floor(256 * x).
    Codebooks start from the rows with the smallest vec_ids (null ids last, equal ids by vector); with fewer rows than entries they are
    smaller. `code` has two hex digits for each part, `error` is the sum of squared distances, `label_error` its sum over
    equal labels, null labels together. Repeated rows repeat and count as often as they occur; an empty table stays empty; other
    columns are not read. Vectors of different lengths, a length that `parts` does not divide, and components of 2**18 or
    more are errors. At least one round.
    """
    if not 1 <= entries <= 256 or not 1 <= rounds < 255:
        raise ValueError("1 to 256 entries and 1 to 254 rounds")
    rows = _kept(df, vec_id, vector, label)
    label_type = rows.schema["label"].dataType.simpleString()
    state, history = train(rows, label_type, parts, entries, rounds)
    schema = f"vec_id long, label {label_type}, code string, error long"
    if state is None:
        return df.sparkSession.createDataFrame([], f"{schema}, label_error long, codebooks_sha256 string")
    shape = (parts, history[0].shape[2])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = _state(batch, shape)
            errors = codes.assign(history).sum(axis=1)
            texts = [bytes(c).hex() for c in codes.code]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(texts, pa.string()), pa.array(errors, pa.int64())], ["vec_id", "label", "code", "error"])

    return _label_errors(staged(state.mapInArrow(run, schema))).withColumn("codebooks_sha256", F.lit(codebook_digest(history[-1])))
