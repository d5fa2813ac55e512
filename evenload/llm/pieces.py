"""SentencePiece encoding and decoding with spans of the original bytes.

Normalisation matches the longest prefix at each position in the model's
compiled character map (a double-array trie over UTF-8 bytes followed by the
replacement strings) and records, for every normalised byte, where the original bytes
that it came from begin and end. White space becomes the escape symbol with the same record.
Pieces partition the normalised bytes, so their lengths, summed up, give each
piece's place there, and the record projects it to a span of the original text: from the
beginning of its first byte to the end of its last. Pieces that share a replaced
character share its span.

Ids come from the library's own encoder, so they equal it by construction. The
model travels to the executors as its bytes (a fixed size).

Defined cases: a null or empty text has no pieces; decoding no ids gives an
empty text; other columns pass through; repeated rows are encoded row by row.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from sentencepiece import sentencepiece_model_pb2

from evenload.llm.words import batches

ESCAPE = "▁".encode()


class CharacterMap:
    """Longest-prefix replacement by a compiled character map."""

    def __init__(self, blob: bytes) -> None:
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist() if blob else []
        self.strings = blob[4 + size :] if blob else b""

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest entry that data has at this position."""
        if not self.units:
            return None
        found, unit, node = None, self.units[0], 0
        node ^= self._offset(unit)
        for k in range(at, len(data)):
            node ^= data[k]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & 0x800000FF != data[k]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                start = self.units[node] & 0x7FFFFFFF
                found = (k + 1 - at, self.strings[start : self.strings.index(b"\0", start)])
        return found

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)


class Pieces:
    """A model with its normaliser, spans and decoder."""

    def __init__(self, model: bytes) -> None:
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        self.spec = proto.normalizer_spec
        self.suffix = proto.trainer_spec.treat_whitespace_as_suffix
        self.map = CharacterMap(self.spec.precompiled_charsmap)
        kind = sentencepiece_model_pb2.ModelProto.SentencePiece
        unknown, byte = kind.UNKNOWN, kind.BYTE
        self.lengths = np.array([1 if p.type == byte else len(p.piece.encode()) for p in proto.pieces], np.int64)
        self.unknown = np.array([p.type == unknown for p in proto.pieces])
        self.own = [p.piece.encode() for p in proto.pieces if p.type == kind.USER_DEFINED]

    def normalise(self, data: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
        """Normalised bytes and, for each of them, where its original bytes begin and end."""
        if not data:
            return b"", np.zeros(0, np.int64), np.zeros(0, np.int64)
        space = ESCAPE if self.spec.escape_whitespaces else b" "
        if not self.map.units and not self.spec.remove_extra_whitespaces and not self.suffix:
            raw = np.frombuffer(data, np.uint8)
            align = np.repeat(np.arange(len(raw)), np.where(raw == 0x20, len(space), 1))
            out, lead = data.replace(b" ", space), space if self.spec.add_dummy_prefix else b""
            none = np.zeros(len(lead), np.int64)
            return lead + out, np.concatenate([none, align]), np.concatenate([none, align + 1])
        parts: list[tuple[bytes, int, int]] = []
        at = 0
        while at < len(data):
            own = max((o for o in self.own if data.startswith(o, at)), key=len, default=None)
            found = (len(own), own) if own else self.map.longest(data, at)
            if found is None:
                step = next((n for n, top in ((1, 0x80), (2, 0xE0), (3, 0xF0)) if data[at] < top), 4)
                found = (step, data[at : at + step])
            parts.append((found[1], at, at + found[0]))
            at += found[0]
        if self.spec.remove_extra_whitespaces:
            while parts and parts[0][0].strip(b" ") == b"":
                parts.pop(0)
        out, align = bytearray(), []
        if parts and self.spec.add_dummy_prefix and not self.suffix:
            out += space
            align += [(parts[0][1], parts[0][1])] * len(space)
        last_space = self.spec.remove_extra_whitespaces
        end = parts[-1][2] if parts else len(data)
        for text, begin, stop in parts:
            if last_space:
                text = text.lstrip(b" ")
            for c in text:
                new = space if c == 0x20 else bytes([c])
                out += new
                align += [(begin, stop)] * len(new)
            if text:
                last_space = text.endswith(b" ") and self.spec.remove_extra_whitespaces
        if self.spec.remove_extra_whitespaces:
            while out.endswith(space):
                end = align[-len(space)][0]
                del out[-len(space) :], align[-len(space) :]
        if out and self.spec.add_dummy_prefix and self.suffix:
            out += space
            align += [(end, end)] * len(space)
        begins, ends = np.array(align, np.int64).reshape(-1, 2).T
        return bytes(out), begins, ends

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The original bytes of each piece: begin and end, exclusive."""
        lengths = self.lengths[ids]
        if self.unknown[ids].any():
            lengths = np.array([len(p.encode()) if u else n for p, u, n in zip(self.processor.encode(text, out_type=str), self.unknown[ids], lengths, strict=True)], np.int64)
        _, begins, stops = self.normalise(text.encode())
        ends = np.cumsum(lengths)
        return begins[ends - lengths], stops[ends - 1]


@functools.cache
def loaded(model: bytes) -> Pieces:
    """One copy of a model in a process."""
    return Pieces(model)


NEW = (
    T.StructField("ids", T.ArrayType(T.IntegerType())),
    T.StructField("begins", T.ArrayType(T.IntegerType())),
    T.StructField("ends", T.ArrayType(T.IntegerType())),
)
DECODED = T.StructField("decoded", T.StringType())


def encode_documents(docs: DataFrame, model: bytes, text_col: str = "text", decoded: bool = False) -> DataFrame:
    """docs with ids, begins and ends added, and on demand decoded, the text of the ids.

    begins and ends are byte offsets of the text. Columns of these names are
    replaced. Results leave a task in small batches, so memory follows the
    longest text and not the number of rows.
    """
    new = [*NEW, *[DECODED] * decoded]
    kept = [c for c in docs.columns if c not in [f.name for f in new] or c == text_col]
    schema = T.StructType([*(docs.schema[c] for c in kept), *new])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(model)
        for part in parts:
            texts = [t or "" for t in part.column(text_col).to_pylist()]
            for a, b in batches(texts):
                ids = pieces.processor.encode(texts[a:b], num_threads=1, return_type="numpy")
                spans = [pieces.spans(t, own) for t, own in zip(texts[a:b], ids, strict=True)]
                offsets = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())

                def lists(rows: list[np.ndarray], offsets: pa.Array = offsets) -> pa.Array:
                    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(rows).astype(np.int32)))

                columns = [lists(ids), lists([s[0] for s in spans]), lists([s[1] for s in spans])]
                if decoded:
                    columns.append(pa.array(pieces.processor.decode([i.tolist() for i in ids], num_threads=1), pa.string()))
                old = part.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(old.column(c) for c in kept), *columns], schema.fieldNames())

    return docs.select(*kept).mapInArrow(run, schema)


def decode(model: bytes, ids: Column) -> Column:
    """The text of ids, by the library's decoder."""

    @F.arrow_udf("string")
    def texts(column: pa.Array) -> pa.Array:
        processor, out = loaded(model).processor, []
        for i in range(0, len(column), 64):
            out += processor.decode([x or [] for x in column.slice(i, 64).to_pylist()], num_threads=1)
        return pa.array(out, pa.string())

    return texts(ids)
