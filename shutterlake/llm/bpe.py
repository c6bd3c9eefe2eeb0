"""Byte-level BPE: texts to token ids and back to bytes, with a local rank file.

The rank file (a parameter) is read on the driver, checked to be at most `RANKS_BYTES` long, and broadcast, so that
executors need no file of their own. Each Python worker builds one encoder of the tiktoken library from it.

A text of more than `LONG` characters is split before it is encoded, at places where every match of the pattern ends and
where what follows has no part in the match: before white space, between ASCII letters and digits, and between
sentence marks other than the apostrophe and what are letters in all versions of Unicode. Runs of white space of `RUN`
characters and more, on which the library's matcher overflows, are cut out whole: all of a run but its last character is
one match of the pattern (the whole run at the end of a text), and is encoded as one piece without the matcher. So the
ids are those of the whole text, in time and memory that grow with it.

Edge cases: a null text is empty and has no ids; strings that look like special tokens are ordinary text; decoding gives
raw bytes, also of ids that cut a character; repeated rows, ties and null ids are rows of their own; an empty table gives
an empty result; all other columns are kept, except ones named like those added.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from shutterlake.llm.common import slices, table

RANKS = "byte_bpe_multi_50k.tiktoken"
RANKS_BYTES = 64 << 20
LONG = 50_000
RUN = 10_000
#: Texts or ids of a batch that are Python objects at a time.
ROWS = 200

_RUN = regex.compile(rf"\s{{{RUN},}}")
_SAFE = regex.compile(r"(?<=\S)(?=\s)|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[.,;:!?、。，])(?=[A-Za-z0-9ぁ-ゖ一-龥])")


class Codec:
    """Encoder and decoder of one rank file."""

    def __init__(self, ranks: bytes, pattern: str = public_tokenizers.PATTERN):
        pairs = (line.split() for line in ranks.splitlines() if line)
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks={base64.b64decode(t): int(n) for t, n in pairs}, special_tokens={})

    def _plain(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, disallowed_special=())

    def _pieces(self, text: str) -> Iterator[np.ndarray]:
        start = 0
        for run in _RUN.finditer(text):
            yield from self._split(text, start, run.start())
            start = run.end() if run.end() == len(text) else run.end() - 1
            yield np.array(self.encoding._encode_single_piece(text[run.start():start]), dtype=np.uint32)
        yield from self._split(text, start, len(text))

    def _split(self, text: str, start: int, stop: int) -> Iterator[np.ndarray]:
        while start < stop:
            cut = _SAFE.search(text, start + LONG, stop) if stop - start > LONG else None
            end = cut.start() if cut else stop
            yield self._plain(text[start:end])
            start = end

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a whole text."""
        if not text:
            return np.zeros(0, dtype=np.uint32)
        return self._plain(text) if len(text) < RUN else np.concatenate([*self._pieces(text)])

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids, whether or not they are valid UTF-8."""
        return self.encoding.decode_bytes(ids.tolist())


#: A worker's codecs by the digest of their rank file.
_CODECS: dict[str, Codec] = {}


class Ranks:
    """A rank file for use in tasks."""

    def __init__(self, spark: SparkSession, path: str):
        if os.path.getsize(path) > RANKS_BYTES:
            raise ValueError(f"{path} is larger than a rank file may be")
        with open(path, "rb") as file:
            content = file.read()
        self.digest, self.content = hashlib.sha256(content).hexdigest(), spark.sparkContext.broadcast(content)

    def codec(self) -> Codec:
        """The worker's codec, built once."""
        if self.digest not in _CODECS:
            _CODECS[self.digest] = Codec(self.content.value)
        return _CODECS[self.digest]


def _path(path: str | None) -> str:
    return path or public_tokenizers.path(RANKS)


def _joined(values: list[np.ndarray]) -> pa.ListArray:
    """Arrays as one list column."""
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    flat = np.concatenate(values).astype(np.int32) if values else np.zeros(0, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _lists(column: pa.ListArray) -> list[np.ndarray]:
    """A list column as arrays; null is empty."""
    flat, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:])]


def _extended(frame: DataFrame, *fields: StructField) -> StructType:
    own = {f.name for f in fields}
    return StructType([f for f in frame.schema.fields if f.name not in own] + list(fields))


def _with(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    kept = [k for k, name in enumerate(batch.schema.names) if name not in columns]
    arrays, names = [batch.column(k) for k in kept], [batch.schema.names[k] for k in kept]
    return pa.RecordBatch.from_arrays([*arrays, *columns.values()], names=[*names, *columns])


def encode(documents: DataFrame, path: str | None = None) -> DataFrame:
    """documents with n_tokens and ids in place of the text."""
    ranks = Ranks(documents.sparkSession, _path(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = ranks.codec()
        for batch in slices(batches, ROWS):
            ids = [codec.encode(text) for text in batch.column("text").to_pylist()]
            out = _with(batch, n_tokens=pa.array([len(x) for x in ids], pa.int64()), ids=_joined(ids))
            yield out.drop_columns(["text"])

    schema = _extended(documents.drop("text"), StructField("n_tokens", LongType()), StructField("ids", ArrayType(IntegerType())))
    return documents.mapInArrow(run, schema)


def decode(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """tokens with the bytes of column ids as `bytes`, and the digest of the ids as `ids_sha256`, in place of the ids."""
    ranks = Ranks(tokens.sparkSession, _path(path))

    def digest(ids: np.ndarray) -> str:
        found = hashlib.sha256()
        for at in range(0, len(ids), 10_000):
            found.update(("," * (at > 0) + ",".join(map(str, ids[at:at + 10_000].tolist()))).encode())
        return found.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = ranks.codec()
        for batch in slices(batches, ROWS):
            ids = _lists(batch.column("ids"))
            out = _with(batch, bytes=pa.array([codec.decode(x) for x in ids], pa.binary()), ids_sha256=pa.array([digest(x) for x in ids], pa.string()))
            yield out.drop_columns(["ids"])

    schema = _extended(tokens.drop("ids"), StructField("bytes", BinaryType()), StructField("ids_sha256", StringType()))
    return tokens.mapInArrow(run, schema)


def op12_byte_bpe(spark, folder: str) -> DataFrame:
    """All texts of the `documents` table encoded and decoded again."""
    tokens = encode(table(spark, folder, "documents").select("doc_id", "text"))
    return decode(tokens).select("doc_id", "n_tokens", "ids_sha256", F.sha2("bytes", 256).alias("decoded_sha256"))
