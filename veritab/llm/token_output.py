"""Token ids in a binary format with Elias-Fano encoded document boundaries.

The format is a table of blocks, written and committed by Spark. A block holds
the ids of consecutive documents as one little-endian array (two bytes an id
where the vocabulary allows), and two Elias-Fano sequences: where each document
ends in it, and the document ids. Blocks are ordered by (shard, block); ``at``
is a block's place in its shard, and the shards' places follow from their sizes,
so there is no table of 64-bit offsets per document.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritab.llm._runtime import materialise, shared_dir
from veritab.llm._words import pieces

BLOCKS = """shard int, block int, at long, n_docs long, n_ids long, width int, ids binary,
ends_bits int, ends_low binary, ends_high binary, ends_samples binary,
n_null_keys long, key_base long, keys_bits int, keys_low binary, keys_high binary, keys_samples binary"""
ARROW_BLOCKS = pa.schema(
    [("shard", pa.int32()), ("block", pa.int32()), ("at", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("width", pa.int32()), ("ids", pa.binary()),
     ("ends_bits", pa.int32()), ("ends_low", pa.binary()), ("ends_high", pa.binary()), ("ends_samples", pa.binary()),
     ("n_null_keys", pa.int64()), ("key_base", pa.int64()), ("keys_bits", pa.int32()), ("keys_low", pa.binary()), ("keys_high", pa.binary()), ("keys_samples", pa.binary())]
)
BOUNDARIES = "doc_id long, start long, n_tokens long, ids_crc32 long"
SAMPLE = 256


class EliasFano:
    """A non-decreasing sequence of n integers below u in about n (2 + log2(u / n)) bits.

    The low ``bits`` of each value stand in ``low``; the high parts are unary in
    ``high``: value i sets bit (high part + i). ``samples`` has the place of every
    256th set bit, from which ``select`` finds any value by counting a few bytes.
    """

    def __init__(self, n: int, bits: int, low: bytes, high: bytes, samples: bytes):
        self.n, self.bits = n, bits
        self.low, self.high, self.samples = np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint8), np.frombuffer(samples, "<u4")

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        if not n:
            return cls(0, 0, b"", b"", b"")
        bits = max(0, (int(values[-1]) // n).bit_length() - 1) if int(values[-1]) >= n else 0
        shift = np.arange(bits, dtype=np.uint64)
        low = np.packbits(((values[:, None] >> shift) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        place = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(place[-1]) + 1, np.uint8)
        high[place] = 1
        return cls(n, bits, low.tobytes(), np.packbits(high, bitorder="little").tobytes(), place[::SAMPLE].astype("<u4").tobytes())

    def parts(self) -> tuple[int, bytes, bytes, bytes]:
        return self.bits, self.low.tobytes(), self.high.tobytes(), self.samples.astype("<u4").tobytes()

    def decode(self) -> np.ndarray:
        if not self.n:
            return np.zeros(0, np.int64)
        place = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))
        low = np.unpackbits(self.low, bitorder="little", count=self.n * self.bits).reshape(self.n, self.bits)
        weight = np.int64(1) << np.arange(self.bits, dtype=np.int64)
        return ((place - np.arange(self.n)) << self.bits) + low.astype(np.int64) @ weight

    def select(self, i: int) -> int:
        """Value i, without decoding the others."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte, skip = divmod(place, 8)
        window = np.unpackbits(self.high[byte : byte + 1], bitorder="little")[skip:]
        while left >= (ones := int(window.sum())):
            left, byte = left - ones, byte + 1
            skip, window = 0, np.unpackbits(self.high[byte : byte + 1], bitorder="little")
        place = byte * 8 + skip + int(np.flatnonzero(window)[left])
        bit = np.arange(i * self.bits, (i + 1) * self.bits)
        low = int(((self.low[bit >> 3] >> (bit & 7)) & 1).astype(np.int64) @ (np.int64(1) << np.arange(self.bits))) if self.bits else 0
        return ((place - i) << self.bits) + low


#: Fixed values of byte-level BPE: how it cuts texts, here for ASCII and the letters of Latin-1 and Latin Extended.
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
PRE_TOKEN = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{LETTERS}]+| ?[0-9]+| ?[^\s{LETTERS}0-9]+|\s+(?!\S)|\s+")
UNUSUAL = re.compile(rf"[^\t\n\r\x20-\x7e{LETTERS}]")
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]


def byte_alphabet() -> dict[int, str]:
    """The character by which byte-level BPE writes each byte: printed ones stand for themselves, the others for 256, 257, ..."""
    others = [b for b in range(256) if b not in PRINTED]
    return {b: chr(b) for b in PRINTED} | {b: chr(256 + i) for i, b in enumerate(others)}


class PreTokens(dict):
    """The place of each pre-token seen so far; one that is new goes through the tokenizer's model."""

    def __init__(self, model, dtype: np.dtype):
        super().__init__()
        self.model, self.alphabet = model, byte_alphabet()
        self.ids, self.start, self.size, self.chars = array("H" if dtype.itemsize == 2 else "I"), array("q"), array("q"), 0

    def __missing__(self, piece: str) -> int:
        found = [x.id for x in self.model.tokenize(piece.encode().decode("latin-1").translate(self.alphabet))]
        self[piece] = place = len(self.start)
        self.start.append(len(self.ids))
        self.size.append(len(found))
        self.ids.extend(found)
        self.chars += len(piece)
        return place


class Encoder:
    """Encodes whole texts with the tokenizers library.

    A byte-level BPE without a normaliser encodes each pre-token by itself, so those
    seen before are looked up. Texts with characters outside the common range or with
    an added token (as ``<|endoftext|>``, which the library gives its own id), and all
    texts of other kinds of tokenizer, go through the library in one piece.
    """

    LIMIT, LIMIT_CHARS = 600_000, 10 << 20  # pre-tokens, and their characters, that are remembered

    def __init__(self, tokenizer_json: str, end_id: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.end_id = end_id
        spec = json.loads(tokenizer_json)
        cut = spec.get("pre_tokenizer") or {}
        self.byte_level = spec.get("normalizer") is None and cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
        self.added = [t["content"] for t in spec.get("added_tokens") or []]
        self.seen = PreTokens(self.tokenizer.model, self.dtype)

    def encode(self, text: str) -> np.ndarray:
        """The ids of ``text`` and the end id."""
        if not self.byte_level or UNUSUAL.search(text) or any(t in text for t in self.added):
            return np.array([*self.tokenizer.encode(text, add_special_tokens=False).ids, self.end_id], self.dtype)
        if len(self.seen) > self.LIMIT or self.seen.chars > self.LIMIT_CHARS:
            self.seen = PreTokens(self.tokenizer.model, self.dtype)
        parts = PRE_TOKEN.findall(text)
        which = np.fromiter(map(self.seen.__getitem__, parts), np.int64, len(parts))
        size = np.frombuffer(self.seen.size, np.int64)[which] if parts else which
        start = np.frombuffer(self.seen.start, np.int64)[which] if parts else which
        to = np.cumsum(size)
        total = int(to[-1]) if parts else 0
        out = np.empty(total + 1, self.dtype)
        if total:
            out[:total] = np.frombuffer(self.seen.ids, self.dtype)[np.arange(total) + np.repeat(start - to + size, size)]
        out[total] = self.end_id
        return out


_ENCODERS: dict[tuple[int, int], Encoder] = {}


def _encoder(tokenizer_json: str, end_id: int) -> Encoder:
    """One per Python worker: what it remembers serves the next tasks too."""
    key = (hash(tokenizer_json), end_id)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(tokenizer_json, end_id)
    return _ENCODERS[key]


def _block(shard: int, block: int, at: int, keys: list, ids: list[np.ndarray]) -> pa.RecordBatch:
    some = np.array([k for k in keys if k is not None], np.int64)
    base = int(some[0]) if len(some) else 0
    ends = EliasFano.encode(np.cumsum([len(x) for x in ids]))
    names = EliasFano.encode((some - base).astype(np.uint64))
    flat = np.concatenate(ids)
    row = [shard, block, at, len(keys), len(flat), flat.dtype.itemsize, flat.tobytes(), *ends.parts(), len(keys) - len(some), base, *names.parts()]
    return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, ARROW_BLOCKS, strict=True)], schema=ARROW_BLOCKS)


def write_tokens(docs: DataFrame, path: str, tokenizer_json: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", block_ids: int = 1 << 20) -> None:
    """Encode every whole text and write the blocks to ``path``, in ascending order of the (integer) id.

    Null texts are empty: only the end id. Null ids come first. Documents with equal
    ids are in the order of a hash of their texts. A document is never split; one of
    more than ``block_ids`` ids has a block of its own. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.xxhash64(text_col).alias("tie"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_json, end_id)
        shard, block, at, n = TaskContext.get().partitionId(), 0, 0, 0
        keys: list = []
        ids: list[np.ndarray] = []
        for piece in pieces(batches, "text"):
            for key, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                got = encoder.encode(text)
                if keys and n + len(got) > block_ids:
                    yield _block(shard, block, at, keys, ids)
                    block, at, n, keys, ids = block + 1, at + n, 0, [], []
                keys.append(key)
                ids.append(got)
                n += len(got)
        if keys:
            yield _block(shard, block, at, keys, ids)

    rows.mapInArrow(encode, BLOCKS).write.option("compression", "zstd").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The blocks, with ``base``: the number of ids in all shards before."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n_ids"))
    before = F.sum("n_ids").over(Window.orderBy("shard")) - F.col("n_ids")
    shards = materialise(shards.select(F.col("shard"), before.alias("base")))
    return blocks.join(shards, "shard")


def document_boundaries(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the written files."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                flat = np.frombuffer(row["ids"], f"<u{row['width']}").astype("<u4")
                ends = EliasFano(row["n_docs"], row["ends_bits"], row["ends_low"], row["ends_high"], row["ends_samples"]).decode()
                n_null = row["n_null_keys"]
                names = EliasFano(row["n_docs"] - n_null, row["keys_bits"], row["keys_low"], row["keys_high"], row["keys_samples"]).decode() + row["key_base"]
                starts = np.concatenate([[0], ends[:-1]])
                crc = [zlib.crc32(flat[a:b]) for a, b in zip(starts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([None] * n_null + names.tolist(), pa.int64()), pa.array(starts + row["base"] + row["at"], pa.int64()), pa.array(ends - starts, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    columns = ["base", "at", "n_docs", "width", "ids", "ends_bits", "ends_low", "ends_high", "ends_samples", "n_null_keys", "key_base", "keys_bits", "keys_low", "keys_high", "keys_samples"]
    return read_tokens(spark, path).select(*columns).mapInArrow(decode, BOUNDARIES)


def find_documents(spark: SparkSession, path: str, wanted: Iterable[int]) -> DataFrame:
    """(doc_id, start, ids) of the named documents, looked up in the written files.

    In a block whose first name is not too large, each name is found by binary search among
    the block's names, and the document's ends by two selects; no other document is decoded.
    ``wanted`` is a list of the caller's, sent to the tasks.
    """
    wanted = sorted(set(wanted))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                ends = EliasFano(row["n_docs"], row["ends_bits"], row["ends_low"], row["ends_high"], row["ends_samples"])
                n_null = row["n_null_keys"]
                names = EliasFano(row["n_docs"] - n_null, row["keys_bits"], row["keys_low"], row["keys_high"], row["keys_samples"])
                if not names.n:
                    continue
                found, flat = [], np.frombuffer(row["ids"], f"<u{row['width']}")
                first, last = row["key_base"], row["key_base"] + names.select(names.n - 1)
                for name in wanted[bisect_left(wanted, first) : bisect_right(wanted, last)]:
                    i = bisect_left(range(names.n), name - first, key=names.select)
                    while i < names.n and names.select(i) == name - first:
                        lo, hi = (ends.select(n_null + i - 1) if n_null + i else 0), ends.select(n_null + i)
                        found.append((name, row["base"] + row["at"] + lo, flat[lo:hi].astype(np.int64).tolist()))
                        i += 1
                if found:
                    yield pa.RecordBatch.from_pylist([dict(zip(("doc_id", "start", "ids"), f, strict=True)) for f in found], schema=pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.list_(pa.int64()))]))

    columns = ["base", "at", "n_docs", "width", "ids", "ends_bits", "ends_low", "ends_high", "ends_samples", "n_null_keys", "key_base", "keys_bits", "keys_low", "keys_high", "keys_samples"]
    some = read_tokens(spark, path).where(F.col("key_base") <= (wanted[-1] if wanted else 0)) if wanted else read_tokens(spark, path).where("false")
    return some.select(*columns).mapInArrow(find, "doc_id long, start long, ids array<long>")


def default_tokenizer() -> str:
    import public_tokenizers

    return Path(public_tokenizers.path("byte_bpe_50k.json")).read_text()


def token_output(docs: DataFrame, path: str | None = None, tokenizer_json: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write ``docs`` as token ids to ``path`` (a new folder of the shared one, by default) and return the boundaries read back."""
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, tokenizer_json or default_tokenizer(), end_id, id_col, text_col)
    return document_boundaries(spark, path)
