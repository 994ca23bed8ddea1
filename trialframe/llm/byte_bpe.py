"""Byte-level BPE: ranked merges folded over the byte arrays of distinct words, in Spark's higher-order functions.

Texts are cut into words by the pattern of the vocabulary. The words of a task's texts are numbered, so
each word is encoded once for a task (a bounded number of words is remembered): its bytes become an array of one-byte pieces, and a fold merges, as long as two
neighbours together are a token, the neighbours of the lowest rank, the leftmost first. Ranks are
looked up in a literal rank map, an array of small maps chosen by the crc32 of the bytes, as a lookup in one map of
50,000 entries would scan it. Ids are the ranks of the pieces left. Decoding concatenates the binary pieces of the ids.
A block of texts (about 4 MB) is one row with its new words, from cutting to joining the words of each
text; rows stay in order and nothing is shuffled.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain, islice, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_batches

#: Letters and numbers that came into Unicode after version 16, which the libraries of the rank files
#: follow; a newer Unicode here must not see them as letters or numbers.
NEWER = regex.compile(
    "[\\u0558\\u058B-\\u058C\\u088F\\u0C5C\\u0CDC\\u208F\\u209D\\uA7CE-\\uA7CF\\uA7D2\\uA7D4\\uA7DD\\uA7E2\\uA7F1\\uAB6C-\\uAB6D"
    "\\U000107BB-\\U000107BF\\U00010940-\\U00010959\\U00010EC5-\\U00010EC7\\U00010ED9-\\U00010EEE\\U00011B0A"
    "\\U00011DB0-\\U00011DDB\\U00011DE0-\\U00011DE9\\U00011DF1\\U0001246F\\U00012475-\\U0001247F\\U00012550-\\U00012686"
    "\\U00016EA0-\\U00016EB8\\U00016EBB-\\U00016ED3\\U00016FF2-\\U00016FF6\\U000187F8-\\U000187FF\\U00018CD6-\\U00018CDA"
    "\\U00018D09-\\U00018D20\\U00018D80-\\U00018DF2\\U00018E00-\\U00019191\\U000191A0-\\U000191D2\\U0001B123-\\U0001B128"
    "\\U0001B168\\U0001D6A6\\U0001DF1F-\\U0001DF24\\U0001DF2B-\\U0001DF81\\U0001DF90-\\U0001DF96\\U0001DFCD-\\U0001DFFF"
    "\\U0001E6C0-\\U0001E6DE\\U0001E6E0-\\U0001E6E2\\U0001E6E4-\\U0001E6E5\\U0001E6E7-\\U0001E6ED\\U0001E6F0-\\U0001E6F4"
    "\\U0001E6FE-\\U0001E6FF\\U0002B73A-\\U0002B73F\\U0002B81E\\U0002CEA2-\\U0002CEAD\\U000323B0-\\U00033479\\U0003D000-\\U0003FC3F]"
)
UNASSIGNED = "\u0378"
BUCKETS = 1 << 14
BLOCK = 4 << 20  # bytes of text that are a row
KNOWN = 1 << 20  # chunks that a task remembers
LONG = 100
NONE = 1 << 30  # above every rank

TYPES = {"n_tokens": "long", "ids": "array<int>", "ids_sha256": "string", "decoded": "binary", "decoded_sha256": "string"}
_ARROW = {"long": pa.int64(), "array<int>": pa.list_(pa.int32()), "string": pa.string(), "binary": pa.binary()}
_BLOCK = "first boolean, keys binary, texts binary, places binary, parts binary, numbers binary, spelt array<binary>"
_BLOCK_ARROW = pa.schema([("first", pa.bool_()), *[(c, pa.binary()) for c in ("keys", "texts", "places", "parts", "numbers")], ("spelt", pa.list_(pa.binary()))])


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file: on each line a token in base64 and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def rank_map(ranks: dict[bytes, int]) -> Column:
    """array<map<hex of a token, rank>>, a literal: the map of a token is at its crc32 modulo the number of maps."""
    maps: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for token, rank in ranks.items():
        maps[zlib.crc32(token) % BUCKETS][token.hex().upper()] = rank
    return F.from_json(F.lit(json.dumps(maps, separators=(",", ":"))), "array<map<string,int>>")


def pieces_by_id(ranks: dict[bytes, int]) -> Column:
    """array<string>, a literal: the bytes of each id in hex; null for ids that no token has."""
    pieces: list[str | None] = [None] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        pieces[rank] = token.hex().upper()
    return F.from_json(F.lit(json.dumps(pieces, separators=(",", ":"))), "array<string>")


def _let(value: Column, then) -> Column:
    """`then(value)`, with the value worked out once: the start of a fold over nothing, and its end."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda same, _: same, then)


def rank_of(ranks: Column, piece: Column) -> Column:
    """Rank of a byte string in the rank map; null for one that is no token."""
    return F.try_element_at(F.get(ranks, F.crc32(piece).bitwiseAND(F.lit(BUCKETS - 1)).cast("int")), F.hex(piece))


def _joined(word: Column, starts: Column, i: Column, pieces: int) -> Column:
    """The bytes of so many pieces from the i-th (from 0) on; null if there are fewer."""
    first = F.get(starts, i)
    return F.substring(word, first, F.get(starts, i + pieces) - first)


def _one_by_one(word: Column, ranks: Column) -> Column:
    """Where pieces start after merging the leftmost neighbours of the lowest rank, again and again; and the end.

    A piece is one number, `rank << 32 | start`: the rank that it has together with the next piece, or `NONE`. So the
    least number is the next merge, and a merge looks up two ranks anew.
    """

    def number(start: Column, after: Column) -> Column:
        """That of a piece, given where the piece after the next one starts; null if there is none."""
        rank = rank_of(ranks, F.substring(word, start.cast("int"), (after - start).cast("int")))
        return F.shiftleft(F.coalesce(rank, F.lit(NONE)).cast("long"), 32) + start

    def begin(of: Column) -> Column:
        return of.bitwiseAND(F.lit(0xFFFFFFFF))

    def merge(pieces: Column, _: Column) -> Column:
        def join(lowest: Column) -> Column:
            place = _let(begin(lowest), lambda at: F.size(F.filter(pieces, lambda p: begin(p) <= at)))  # of the second, from 0

            def rebuild(i: Column) -> Column:
                def renumber(left: Column) -> Column:
                    return F.transform(left, lambda p, k: F.when((k >= i) | (k < i - 2), p).otherwise(number(begin(p), begin(F.get(left, k + 2)))))

                return _let(F.filter(pieces, lambda _, k: k != i), renumber)

            return F.when(lowest < (NONE << 32), _let(place, rebuild)).otherwise(pieces)

        return _let(F.array_min(pieces), join)

    size = F.octet_length(word)
    singles = F.transform(F.sequence(F.lit(1), size + 1), lambda at: number(at, F.when(at < size, at + 2)))
    return F.aggregate(F.sequence(F.lit(2), size), singles, merge, lambda pieces: F.transform(pieces, lambda p: begin(p).cast("int")))


def _all_at_once(word: Column, ranks: Column) -> Column:
    """The same, merging all places of the lowest rank at once from left to right: of overlapping places the second waits."""

    def merge(starts: Column) -> Column:
        def join(found: Column, lowest: Column) -> Column:
            hits = F.filter(F.transform(found, lambda rank, i: F.when(rank == lowest, i)), lambda i: i.isNotNull())
            apart = F.aggregate(
                hits,
                F.array().cast("array<int>"),
                lambda done, i: F.when(F.coalesce(F.get(done, F.size(done) - 1) < i - 1, F.lit(True)), F.concat(done, F.array(i))).otherwise(done),
            )
            return F.when(lowest.isNotNull(), F.array_except(starts, F.transform(apart, lambda i: F.get(starts, i + 1))))

        neighbours = F.transform(starts, lambda _, i: rank_of(ranks, _joined(word, starts, i, 2)))
        return _let(neighbours, lambda found: _let(F.array_min(found), lambda lowest: join(found, lowest)))

    def again(state: Column, _: Column) -> Column:
        new = _let(merge(state["at"]), lambda new: F.struct(F.coalesce(new, state["at"]).alias("at"), new.isNull().alias("done")))
        return F.when(state["done"], state).otherwise(new)

    size = F.octet_length(word)
    start = F.struct(F.sequence(F.lit(1), size + 1).alias("at"), F.lit(False).alias("done"))
    return F.aggregate(F.sequence(F.lit(2), size), start, again, lambda state: state["at"])


def encode_word(word: Column, ranks: Column) -> Column:
    """Ids of one word (binary): its own rank where it is a token, else the ranks after folding merges over its bytes.

    Merges are done one at a time; in words of more than `LONG` bytes all places of a rank at once, so that the work does
    not grow with the square of the length. Both orders give the same pieces, as no merge makes a pair of a lower rank.
    """

    def ids(starts: Column) -> Column:
        return F.transform(F.slice(starts, F.lit(1), F.size(starts) - 1), lambda _, i: rank_of(ranks, _joined(word, starts, i, 1)))

    whole = rank_of(ranks, word)
    folded = F.when(F.octet_length(word) > LONG, _all_at_once(word, ranks)).otherwise(_one_by_one(word, ranks))
    return F.when(whole.isNotNull(), F.array(whole)).otherwise(_let(folded, ids))


def decode_ids(ids: Column, pieces: Column) -> Column:
    """The bytes of ids: their binary pieces, written in hex, concatenated. An id that the vocabulary lacks has none."""
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(pieces, i)), ""))


def words_of(text: str, pattern: regex.Pattern) -> list[str]:
    """The matches of the pattern over a text, in order."""
    if text.isascii() or not NEWER.search(text):
        return pattern.findall(text)
    # each newer character counts as one without a class
    return [text[m.start() : m.end()] for m in pattern.finditer(NEWER.sub(UNASSIGNED, text))]


#: A space next to white space; only there do matches of the pattern depend on what is before a space.
_RUN = re.compile(r" \s|\s ")
_CUT = re.compile(r"(?<=\S) (?=\S)")


def chunks_of(text: str) -> list[str]:
    """A text cut before each single space between other characters: no word reaches over such a cut."""
    first, *rest = _CUT.split(text) if _RUN.search(text) else text.split(" ")
    return [first, *[" " + r for r in rest]]


class _Numbers(dict):
    """Numbers its keys in the order in which they are asked for first."""

    def __missing__(self, key) -> int:
        self[key] = n = len(self)
        return n

    def of(self, keys: list) -> list[int]:
        return list(map(self.__getitem__, keys))


def _blocks(pattern: str, keys: list[str]):
    """One row for each block: its keys, the chunks of each text, the words of each new chunk, the new words.

    Chunks and words are numbered over the blocks of a task, until there are `KNOWN` chunks; then numbers start anew.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = regex.compile(pattern)
        chunks, words = _Numbers(), _Numbers()
        for batch in text_batches(batches, "_text", BLOCK):
            if len(chunks) >= KNOWN:
                chunks, words = _Numbers(), _Numbers()
            old_chunks, old_words = len(chunks), len(words)
            texts, places, parts, numbers = [], array("i"), [], array("i")
            for text in batch.column("_text").to_pylist():
                found = chunks_of(text or "")
                texts.append(len(found))
                places.extend(chunks.of(found))
            for chunk in islice(chunks, old_chunks, None):
                found = words_of(chunk, cut)
                parts.append(len(found))
                numbers.extend(words.of(found))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.select(keys).schema) as out:
                out.write_batch(batch.select(keys))
            spelt = pa.array([w.encode() for w in islice(words, old_words, None)], pa.binary())
            row = [pa.array([old_chunks == 0]), pa.array([sink.getvalue().to_pybytes()], pa.binary())]
            row += [pa.array([x.tobytes()], pa.binary()) for x in (array("i", texts), places, array("i", parts), numbers)]
            yield pa.RecordBatch.from_arrays([*row, pa.ListArray.from_arrays(pa.array([0, len(spelt)], pa.int32()), spelt)], schema=_BLOCK_ARROW)

    return run


class _Decoder:
    """Puts blocks together again, in their order: what each known chunk stands for, by its number."""

    def __init__(self, outputs: tuple[str, ...]):
        self.outputs = outputs
        self.clear()

    def clear(self) -> None:
        self.words: dict[str, list] = {"n": [], "ids": [], "spelt": [], "bytes": []}
        self.chunks: dict[str, list] = {k: [] for k in self.words}

    def block(self, rows: pa.RecordBatch, k: int) -> pa.RecordBatch:
        if rows.column("first")[k].as_py():
            self.clear()
        texts, places, parts, numbers = (np.frombuffer(rows.column(c)[k].as_buffer(), "<i4").tolist() for c in ("texts", "places", "parts", "numbers"))
        encoded = rows.column("encoded")[k].values
        lists = encoded.field("ids")
        starts, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        if "n_tokens" in self.outputs:
            self._learn("n", np.diff(starts).tolist(), parts, numbers, sum)
        if "ids" in self.outputs:
            self._learn("ids", [flat[a:b].tolist() for a, b in pairwise(starts)], parts, numbers, lambda x: list(chain.from_iterable(x)))
        if "ids_sha256" in self.outputs:
            spelt = list(map(str, flat.tolist()))
            self._learn("spelt", [",".join(spelt[a:b]) for a, b in pairwise(starts.tolist())], parts, numbers, ",".join)
        if {"decoded", "decoded_sha256"} & set(self.outputs):
            self._learn("bytes", encoded.field("decoded").to_pylist(), parts, numbers, b"".join)
        with pa.ipc.open_stream(rows.column("keys")[k].as_buffer()) as stream:
            keys = stream.read_next_batch()
        made: dict[str, list] = {o: [] for o in self.outputs}
        at = 0
        for n in texts:
            own = places[at : at + n]
            at += n
            for name, column in made.items():
                column.append(self._of_text(name, own))
        arrays = [pa.array(c, _ARROW[TYPES[o]]) for o, c in made.items()]
        return pa.RecordBatch.from_arrays([*keys.columns, *arrays], [*keys.schema.names, *made])

    def _learn(self, kind: str, new: list, parts: list[int], numbers: list[int], join) -> None:
        words, chunks, at = self.words[kind], self.chunks[kind], 0
        words += new
        for n in parts:
            chunks.append(words[numbers[at]] if n == 1 else join([words[w] for w in numbers[at : at + n]]))
            at += n

    def _of_text(self, output: str, places: list[int]):
        if output == "n_tokens":
            return sum(map(self.chunks["n"].__getitem__, places))
        if output == "ids":
            return list(chain.from_iterable(map(self.chunks["ids"].__getitem__, places)))
        if output == "ids_sha256":  # only an empty text has a chunk without ids
            return hashlib.sha256(",".join(map(self.chunks["spelt"].__getitem__, places)).encode()).hexdigest()
        data = b"".join(map(self.chunks["bytes"].__getitem__, places))
        return data if output == "decoded" else hashlib.sha256(data).hexdigest()


def _texts(outputs: tuple[str, ...]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _Decoder(outputs)
        for rows in batches:
            for k in range(rows.num_rows):
                yield decoder.block(rows, k)

    return run


def encode(
    df: DataFrame,
    ranks: dict[bytes, int],
    pattern: str,
    keys: tuple[str, ...] = ("doc_id",),
    text: str = "text",
    outputs: tuple[str, ...] = ("ids",),
) -> DataFrame:
    """The keys and, for each text, the asked outputs of encoding without special tokens.

    `ids`; `n_tokens`; `ids_sha256`, of the decimal ids joined by commas; `decoded`, the bytes that the ids stand for,
    and `decoded_sha256`. A null text is an empty one and has no ids. Rows are independent: repeated rows repeat, other
    columns are not read, an empty table stays empty. Text between matches of the pattern is left out, as in the
    library. `ranks` must hold every single byte; they travel in the plan, so executors need no file.
    """
    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"bytes without a token: {missing}")
    fields = list(df.select(*keys).schema)
    names = [f"_key{k}" for k in range(len(fields))]
    schema = ", ".join([f"{n} {f.dataType.simpleString()}" for n, f in zip(names, fields, strict=True)] + [f"{o} {TYPES[o]}" for o in outputs])
    blocks = df.select(*[df[k].alias(n) for k, n in zip(keys, names, strict=True)], df[text].alias("_text")).mapInArrow(_blocks(pattern, names), _BLOCK)

    def word(ids: Column, pieces: Column) -> Column:
        return F.struct(ids.alias("ids"), decode_ids(ids, pieces).alias("decoded"))

    def encoded(tables: Column) -> Column:
        return F.transform("spelt", lambda w: _let(encode_word(w, tables["ranks"]), lambda ids: word(ids, tables["pieces"])))

    tables = F.struct(rank_map(ranks).alias("ranks"), pieces_by_id(ranks).alias("pieces"))
    rows = blocks.select("first", "keys", "texts", "places", "parts", "numbers", _let(tables, encoded).alias("encoded")).mapInArrow(_texts(outputs), schema)
    return rows.toDF(*keys, *outputs)
