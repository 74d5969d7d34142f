"""Problem 6: token ids of every document by a public byte-level BPE vocabulary.

Method as dealt: a sentencepiece BPE model is serialised straight from the vocabulary file. Its
pieces are the vocabulary's tokens in their byte-mapped form, the score of a piece is its negative
rank, and normalisation is the identity; so sentencepiece merges exactly the pairs that byte-level
BPE merges. Pre-tokens are encoded one by one (each distinct one once per task); decoding is the
inverse of the byte mapping.

One Arrow map without a shuffle; the model file (about 1 MB) is built by each task from the
vocabulary file, whose path is a parameter.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korpusline.functions.session import spread
from korpusline.llm.words import CACHE_ENTRIES

VOCABULARY = os.environ.get("KORPUSLINE_TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.tiktoken"

#: Fixed value: the pre-token pattern published with this vocabulary.
PRE_TOKEN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else one from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, f))}


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def _field(number: int, value: bytes | int) -> bytes:
    """A protobuf field: length-delimited for bytes, varint for a number."""
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def model_proto(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto whose piece ids are the ranks; the unknown piece comes last."""
    import struct

    letters = byte_letters()
    unknown = 2
    size = max(ranks.values()) + 1
    by_rank = {rank: token for token, rank in ranks.items()}
    out = []
    for rank in range(size):
        piece = "".join(letters[b] for b in by_rank[rank])
        out.append(_field(1, _field(1, piece.encode()) + b"\x15" + struct.pack("<f", -float(rank))))
    out.append(_field(1, _field(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + _field(3, unknown)))
    trainer = _field(3, 2) + _field(4, size + 1) + _field(40, size) + _field(41, (1 << 64) - 1) + _field(42, (1 << 64) - 1) + _field(43, (1 << 64) - 1)
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(out) + _field(2, trainer) + _field(3, normalizer)


class Codec:
    """Text to ids and back, with one sentencepiece processor per Python worker."""

    def __init__(self, path: str = VOCABULARY):
        import regex
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_proto(read_ranks(path)))
        self.split = regex.compile(PRE_TOKEN).findall
        letters = byte_letters()
        self.to_letters = {b: letters[b] for b in range(256)}
        self.to_bytes = {letter: b for b, letter in enumerate(letters)}
        self.known: dict[str, bytes] = {}

    def packed(self, text: str) -> bytes:
        """The ids as 32-bit numbers in one bytes object."""
        import numpy as np

        parts = self.split(text)
        known = self.known
        if new := [x for x in set(parts) if x not in known]:
            if len(known) > CACHE_ENTRIES:
                known.clear()
                new = list(set(parts))
            mapped = [x.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.to_letters) for x in new]
            for x, ids in zip(new, self.model.encode(mapped, num_threads=1)):
                known[x] = np.array(ids, np.int32).tobytes()
        return b"".join(map(known.__getitem__, parts))

    def encode(self, text: str) -> list[int]:
        import numpy as np

        return np.frombuffer(self.packed(text), np.int32).tolist()

    def decode(self, ids: list[int]) -> str:
        pieces = "".join(map(self.model.id_to_piece, ids))
        return bytes(map(self.to_bytes.__getitem__, pieces)).decode("utf-8", "replace")


def encode_corpus(documents: DataFrame, path: str = VOCABULARY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids) for every row, special tokens' strings being ordinary text.

    A null and an empty text have the empty list; blank texts are encoded as they are. Rows are
    neither dropped nor merged. Every id is a rank of the vocabulary file.
    """
    narrow = documents.select(F.col(key), F.col(text).alias("text"))
    key_type = narrow.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        codec = None
        for batch in batches:
            codec = codec or Codec(path)
            packed = [codec.packed(x) if x else b"" for x in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *(len(x) // 4 for x in packed)], dtype=np.int64)
            ids = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(packed))])
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), ids)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], [key, "ids"])

    return spread(narrow).mapInArrow(run, f"`{key}` {key_type}, ids array<int>")


def decode_corpus(encoded: DataFrame, path: str = VOCABULARY, key: str = "doc_id") -> DataFrame:
    """(key, text) from (key, ids): the inverse mapping; the empty list gives the empty text."""
    narrow = encoded.select(key, "ids")
    key_type = narrow.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for batch in batches:
            codec = codec or Codec(path)
            texts = [codec.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [key, "text"])

    return narrow.mapInArrow(run, f"`{key}` {key_type}, text string")
