"""Operator 10: SentencePiece encoding with offsets, and decoding.

``Normalizer`` reads the compiled character map of the model (a double-array trie of source strings and
their replacements) and rewrites a text by the longest prefix found at each place, recording for
every normalised byte the source byte it stands for.  The pieces of the normalised text are then
projected to byte spans of the original, which tile it.  Ids are those of the library's encode.

Results of odd input: null and empty texts give no ids, no spans and an empty decoded text; text of
any length is encoded whole; repeated rows give equal rows; further input columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁".encode()
MODEL = "piece_bpe_32k.model"
ROWS = 256
KINDS = {
    "ids": ("array<int>", pa.list_(pa.int32())),
    "spans": ("array<struct<start:int,end:int>>", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
    "decoded": ("string", pa.string()),
    "n_tokens": ("long", pa.int64()),
    "n_bytes": ("long", pa.int64()),
    "ids_sha256": ("string", pa.string()),
    "decoded_sha256": ("string", pa.string()),
}


class Normalizer:
    """Longest-prefix normalisation by a compiled character map: a trie of 32-bit units and a pool of replacements."""

    def __init__(self, charsmap: bytes, dummy_prefix: bool = True, trim_spaces: bool = False):
        self.dummy_prefix, self.trim_spaces = dummy_prefix, trim_spaces
        self.units: tuple[int, ...] = ()
        if charsmap:
            size = struct.unpack_from("<I", charsmap)[0]
            self.units = struct.unpack_from(f"<{size // 4}I", charsmap, 4)
            self.pool = charsmap[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest source string of the map that starts at a byte."""
        found, node = None, self._child(0, 0)
        for k in range(at, len(data)):
            here = node ^ data[k]
            if here >= len(self.units) or self.units[here] & 0x800000FF != data[k]:
                break
            node = self._child(here, here)
            if self.units[here] & 0x100:  # a source string ends here; its leaf holds the place of the replacement
                start = self.units[node] & 0x7FFFFFFF
                found = k + 1 - at, self.pool[start : self.pool.index(b"\0", start)]
        return found

    def _child(self, node: int, unit: int) -> int:
        u = self.units[unit]
        return node ^ ((u >> 10) << ((u & 0x200) >> 6))

    def __call__(self, text: str) -> tuple[bytes, np.ndarray]:
        """The normalised bytes, and for each of them (and their end) the byte of the source it stands for."""
        data = text.encode()
        out, origin = self._mapped(data) if self.units or self.trim_spaces else self._plain(data)
        if self.dummy_prefix and out:
            out, origin = MARK + out, np.concatenate([np.zeros(len(MARK), np.int64), origin])
        return out, np.append(origin, len(data))

    def _plain(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """Without a map only spaces change."""
        width = np.where(np.frombuffer(data, np.uint8) == 0x20, len(MARK), 1)
        return data.replace(b" ", MARK), np.repeat(np.arange(len(data)), width)

    def _mapped(self, data: bytes) -> tuple[bytes, np.ndarray]:
        out, origin, at, spaced = bytearray(), [], 0, self.trim_spaces
        while at < len(data):
            used, new = (self.longest(data, at) if self.units else None) or (_char_width(data[at]), data[at : at + _char_width(data[at])])
            same = new == data[at : at + used]
            for i, byte in enumerate(new):
                if byte == 0x20:
                    if not (self.trim_spaces and spaced):
                        out += MARK
                        origin += [at] * len(MARK)
                    spaced = True
                else:
                    out.append(byte)
                    origin.append(at + i if same else at)
                    spaced = False
            at += used
        while self.trim_spaces and out.endswith(MARK):
            del out[-len(MARK) :], origin[-len(MARK) :]
        return bytes(out), np.array(origin, np.int64)


def _char_width(first: int) -> int:
    return 1 if first < 0xC0 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4


class Codec:
    """A model with its normaliser and the byte width of every piece."""

    def __init__(self, model_file: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        proto = pb.ModelProto()
        with open(model_file, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        self.normalize = Normalizer(spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces)
        self.width = np.array([1 if self.model.is_byte(i) else len(p.piece.encode()) for i, p in enumerate(proto.pieces)])
        self.unknown = self.model.unk_id()
        self.names = [str(i) for i in range(len(proto.pieces))]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.model.decode(ids, num_threads=1)

    def spans(self, text: str, ids: list[int]) -> np.ndarray:
        """n by 2: the bytes of the original that each piece covers; together they tile the text."""
        normal, origin = self.normalize(text)
        width = self.width[np.array(ids, np.int64)]
        if self.unknown in ids:  # an unknown piece stands for a run of characters outside the vocabulary
            width, at = width.copy(), 0
            pieces = self.model.encode_as_pieces(text)
            for k, (i, piece) in enumerate(zip(ids, pieces, strict=True)):
                if i == self.unknown:
                    width[k] = len(piece.encode())
                at += width[k]
        ends = np.cumsum(width)
        return origin[np.stack([ends - width, ends], axis=1)] if len(ends) else np.zeros((0, 2), np.int64)


@lru_cache(maxsize=4)
def codec(model_file: str) -> Codec:
    """One codec a worker process."""
    return Codec(model_file)


def encode_decode(docs: DataFrame, model_file: str, doc_id: str = "doc_id", text: str = "text", outputs: tuple[str, ...] = ("ids", "spans", "decoded")) -> DataFrame:
    """doc_id and any of KINDS: the ids, their byte spans in the text, the decoded text, their counts and digests.

    n_bytes is the number of bytes that the spans cover.  Digests are made inside the task, so that
    neither ids nor texts need travel."""
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    want_spans, want_text = {"spans", "n_bytes"} & set(outputs), {"decoded", "decoded_sha256"} & set(outputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_file)
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                texts = [t or "" for t in batch.column("text").to_pylist()]
                ids = c.encode(texts)
                spans = [c.spans(t, i) for t, i in zip(texts, ids, strict=True)] if want_spans else []
                decoded = c.decode(ids) if want_text else []
                made = {
                    "ids": lambda: ids,  # noqa: B023
                    "spans": lambda: [[{"start": int(a), "end": int(e)} for a, e in s] for s in spans],  # noqa: B023
                    "decoded": lambda: decoded,  # noqa: B023
                    "n_tokens": lambda: [len(i) for i in ids],  # noqa: B023
                    "n_bytes": lambda: [int((s[:, 1] - s[:, 0]).sum()) for s in spans],  # noqa: B023
                    "ids_sha256": lambda: [hashlib.sha256(",".join([c.names[k] for k in i]).encode()).hexdigest() for i in ids],  # noqa: B023
                    "decoded_sha256": lambda: [hashlib.sha256(d.encode()).hexdigest() for d in decoded],  # noqa: B023
                }
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(made[o](), KINDS[o][1]) for o in outputs)], names=["doc_id", *outputs])

    schema = ", ".join([f"doc_id {src.schema['doc_id'].dataType.simpleString()}", *(f"{o} {KINDS[o][0]}" for o in outputs)])
    return src.mapInArrow(run, schema)


def default_model() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(MODEL))


def op10_sentencepiece(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_decode(docs, default_model(), outputs=("n_tokens", "ids_sha256", "decoded_sha256", "n_bytes"))
