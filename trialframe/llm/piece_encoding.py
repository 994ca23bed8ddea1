"""SentencePiece encoding that keeps, for every piece, the bytes of the original text it came from.

Normalisation is done here: at each position the longest prefix found in the model's compiled
character map (a double array over bytes, followed by the replacement strings) is replaced, and each
normalised byte remembers the source byte it came from. Decoding reads the model's table of pieces. The normalised text is cut before runs of the
space mark; no piece of the model reaches over such a cut, so each part is encoded once for a batch of
texts and looked up afterwards. Pieces are projected through the alignment to spans of source bytes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as model_pb2

from .common import text_batches

MARK = "▁"
BATCH = 3 << 20  # bytes of text whose parts are encoded together; the arrays beside it take some forty times as much
PARTS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")

TYPES = {
    "n_tokens": "long",
    "ids": "array<int>",
    "begins": "array<int>",
    "ends": "array<int>",
    "ids_sha256": "string",
    "decoded": "string",
    "decoded_sha256": "string",
    "covered_bytes": "long",
}
_ARROW = {
    "long": pa.int64(),
    "array<int>": pa.list_(pa.int32()),
    "string": pa.string(),
}


class CharacterMap:
    """The compiled map of a model: longest prefix of a byte string, and what replaces it."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob[4 : 4 + size], dtype="<u4").tolist()
        self.strings = blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes matched, replacement) of the longest key that starts at `at`."""
        units, node, found = self.units, 0, None
        unit = units[0]
        node ^= (unit >> 10) << ((unit & 0x200) >> 6)
        for k in range(at, len(text)):
            node ^= text[k]
            unit = units[node]
            if (unit & 0x800000FF) != text[k]:  # the label, with the leaf bit
                break
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if unit & 0x100:
                found = (k + 1 - at, units[node] & 0x7FFFFFFF)
        if found is None:
            return None
        length, start = found
        return length, self.strings[start : self.strings.index(b"\0", start)]


def _utf8(data: bytes) -> str:
    """Bytes as text; every byte that is no part of a character becomes U+FFFD."""
    out = []
    while data:
        try:
            out.append(data.decode())
            break
        except UnicodeDecodeError as e:
            out += [data[: e.start].decode(), "\ufffd"]
            data = data[e.start + 1 :]
    return "".join(out)


class Decoder:
    """Text of ids, by the pieces of a model: marks are spaces, runs of byte pieces characters, control pieces nothing."""

    def __init__(self, model: model_pb2.ModelProto):
        spec, unknown = model.normalizer_spec, model.trainer_spec.unk_surface
        plain = [p.type not in (p.CONTROL, p.UNKNOWN, p.BYTE) for p in model.pieces]
        self.texts = [p.piece.replace(MARK, " ") if k else unknown if p.type == p.UNKNOWN else "" for p, k in zip(model.pieces, plain, strict=True)]
        self.bytes = [int(p.piece[3:5], 16) if p.type == p.BYTE else -1 for p in model.pieces]
        self.is_byte = np.array([b >= 0 for b in self.bytes])
        self.bare, self.squeeze = spec.add_dummy_prefix or spec.remove_extra_whitespaces, spec.remove_extra_whitespaces
        self.starts = [k and p.piece.startswith(MARK) for p, k in zip(model.pieces, plain, strict=True)]

    def decode(self, ids: np.ndarray) -> str:
        if len(ids) and not (0 <= int(ids.min()) and int(ids.max()) < len(self.texts)):
            raise ValueError("an id that the model does not have")
        numbers = ids.tolist()
        parts = [self.texts[i] for i in numbers]
        for k, i in enumerate(numbers):  # the space in front: of the first piece with text, one mark of each piece before it too
            if self.bytes[i] >= 0:
                break
            if self.bare and self.starts[i]:
                parts[k] = parts[k][1:]
                if not self.squeeze:
                    break
            if parts[k]:
                break
        if self.is_byte[ids].any():
            run: list[int] = []
            for k, i in enumerate([*numbers, -1]):
                if i >= 0 and self.bytes[i] >= 0:
                    run.append(self.bytes[i])
                elif run:
                    parts[k - 1] = _utf8(bytes(run))
                    run = []
        return "".join(parts)


class Encoder:
    """A model with its normaliser taken apart: rules here, merges in the library."""

    def __init__(self, blob: bytes):
        model = model_pb2.ModelProto()
        model.ParseFromString(blob)
        spec = model.normalizer_spec
        self.map = CharacterMap(spec.precompiled_charsmap) if spec.precompiled_charsmap else None
        self.prefix, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        cuttable = all(MARK not in p.piece.lstrip(MARK) and p.type != p.USER_DEFINED for p in model.pieces)
        self.cuttable = cuttable and self.escape and not model.trainer_spec.treat_whitespace_as_suffix
        self.decoder = Decoder(model)
        spec.name, spec.precompiled_charsmap = "identity", b""
        spec.add_dummy_prefix = spec.remove_extra_whitespaces = spec.escape_whitespaces = False
        self.merges = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.begin, self.end = self.merges.bos_id(), self.merges.eos_id()
        plain = [p.type == p.NORMAL or p.type == p.USER_DEFINED for p in model.pieces]
        self.odd = ~np.array(plain)
        self.widths = np.array([len(p.piece.encode()) for p in model.pieces], np.int64)

    def normalise(self, text: bytes) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its bytes and its end the source offset."""
        if self.map is None and not self.squeeze and self.escape:
            return self._marked(text)
        out, source, at = [], [], 0
        front, leading = 0, self.squeeze  # source bytes of the spaces dropped in front
        while at < len(text):
            hit = self.map.longest(text, at) if self.map else None
            if hit is None:
                step = 1
                while at + step < len(text) and text[at + step] & 0xC0 == 0x80:
                    step += 1
                hit = step, text[at : at + step]
            chars = hit[1].decode()
            out += chars
            source += [at] * len(chars)
            at += hit[0]
            if leading and chars == " ":
                front = at
            else:
                leading = False
        if self.squeeze:
            keep = [k for k, c in enumerate(out) if c != " " or (k and out[k - 1] != " ")]
            while keep and (out[keep[-1]] == " " or self.escape and out[keep[-1]] == MARK):
                at = source[keep.pop()]
            out, source = [out[k] for k in keep], [source[k] for k in keep]
        if self.prefix and (out or text and not self.squeeze):
            out.insert(0, " ")
            source.insert(0, front)
        if self.escape:
            out = [MARK if c == " " else c for c in out]
        starts = np.repeat(np.array(source, np.int64), [len(c.encode()) for c in out])
        return "".join(out), np.append(starts, at if out else 0)

    def _marked(self, text: bytes) -> tuple[str, np.ndarray]:
        """The same where only spaces change."""
        if not text:
            return "", np.zeros(1, np.int64)
        widths = np.where(np.frombuffer(text, np.uint8) == 32, 3, 1)
        source = np.append(np.repeat(np.arange(len(text)), widths), len(text))
        marked = text.decode().replace(" ", MARK)
        return (MARK + marked, np.concatenate([np.zeros(3, np.int64), source])) if self.prefix else (marked, source)

    def _encode_parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all parts in a row, normalised bytes under each id, where each part starts.

        Odd are parts with byte or unknown pieces. A character that is spelt in bytes counts for its last byte.
        """
        found = self.merges.encode(parts, num_threads=1)
        starts = np.zeros(len(parts) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, found), np.int64, len(parts)), out=starts[1:])
        ids = np.fromiter(chain.from_iterable(found), "<u4", starts[-1])
        widths = self.widths[ids]
        for k in np.unique(np.searchsorted(starts, np.flatnonzero(self.odd[ids]), side="right") - 1).tolist():
            pieces = self.merges.encode(parts[k], return_type="proto").pieces
            widths[starts[k] : starts[k + 1]] = [len(p.surface.encode()) for p in pieces]
        return ids, widths, starts

    def encode_all(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, str]]:
        """For each text: ids with begin and end, first source byte of each, byte after the last, decoded text.

        Every different part is encoded once for all texts.
        """
        normal = [self.normalise(t) for t in texts]
        split = [PARTS.findall(n) if self.cuttable else [n] * bool(n) for n, _ in normal]
        number: dict[str, int] = {}
        places = np.fromiter((number.setdefault(p, len(number)) for p in chain.from_iterable(split)), np.int64)
        part_ids, part_widths, starts = self._encode_parts(list(number))
        first = 0
        for (_, source), parts in zip(normal, split, strict=True):
            own = places[first : first + len(parts)]
            first += len(parts)
            counts = starts[own + 1] - starts[own]
            after = np.cumsum(counts)
            at = np.arange(after[-1] if len(own) else 0) + np.repeat(starts[own] - after + counts, counts)
            ids, ends = part_ids[at], np.cumsum(part_widths[at])
            begins, ends = source[ends - part_widths[at]], source[ends]
            low, high = (begins[0], ends[-1]) if len(ids) else (0, 0)
            whole = np.concatenate([[self.begin], ids, [self.end]]).astype("<u4")
            yield whole, np.concatenate([[low], begins, [high]]), np.concatenate([[low], ends, [high]]), self.decoder.decode(whole)

    def encode(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, str]:
        return next(self.encode_all([text]))


@cache
def _encoder(blob: bytes) -> Encoder:
    return Encoder(blob)


def decode(df: DataFrame, model: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """`df` with the text that its arrays of ids stand for; null for null ids, an empty text for an empty array.

    Begin, end and other control ids stand for nothing, unknown ids for the model's mark of them. A null in an array and an id
    that the model does not have are errors.
    """
    with open(model, "rb") as f:
        blob = f.read()

    @F.pandas_udf("string")
    def texts(column: pd.Series) -> pd.Series:
        decoder = _encoder(blob).decoder
        return pd.Series([None if x is None else decoder.decode(np.asarray(x, np.int64)) for x in column], dtype=object)

    return df.withColumn(out, texts(F.col(ids)))


def _outputs(encoded: tuple[np.ndarray, np.ndarray, np.ndarray, str], wanted: tuple[str, ...]) -> list:
    ids, begins, ends, decoded = encoded
    values = {"n_tokens": len(ids), "ids": ids.view("<i4"), "begins": begins, "ends": ends, "decoded": decoded}
    if "ids_sha256" in wanted:
        values["ids_sha256"] = hashlib.sha256(ids.tobytes()).hexdigest()
    if "decoded_sha256" in wanted:
        values["decoded_sha256"] = hashlib.sha256(decoded.encode()).hexdigest()
    if "covered_bytes" in wanted:
        values["covered_bytes"] = int((ends - begins).sum())
    return [values[w] for w in wanted]


def encode(
    df: DataFrame,
    model: str,
    keys: tuple[str, ...] = ("doc_id",),
    text: str = "text",
    outputs: tuple[str, ...] = ("ids", "begins", "ends"),
) -> DataFrame:
    """The keys and, for each text, the asked outputs of encoding with begin and end ids.

    `ids`; `begins` and `ends`, the source bytes of each piece (the last byte piece of a character
    carries it, the others and the space put in front are empty); `decoded`, the text its ids stand for;
    `n_tokens`; digests of ids (little-endian unsigned 32-bit) and decoded text; `covered_bytes`, the sum
    of the spans. A null or empty text has the begin and end ids only. Rows are independent: repeated rows
    repeat, other columns are not read, an empty table stays empty. `model` is read by the driver and
    travels with the tasks, so executors need no file.
    """
    with open(model, "rb") as f:
        blob = f.read()
    fields = [f for f in df.select(*keys).schema]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"{o} {TYPES[o]}" for o in outputs])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(blob)
        for batch in text_batches(batches, "_text", BATCH):
            texts = batch.column("_text").cast(pa.binary()).fill_null(b"").to_pylist()
            rows = [_outputs(found, outputs) for found in encoder.encode_all(texts)]
            made = [pa.array([r[k] for r in rows], _ARROW[TYPES[o]]) for k, o in enumerate(outputs)]
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(len(keys))] + made, [*keys, *outputs])

    return df.select(*keys, df[text].alias("_text")).mapInArrow(run, schema)
