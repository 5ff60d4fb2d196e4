"""Operator 2: byte-level BPE by a global shuffle of distinct words.

1. Documents gather in blocks.  A block numbers its distinct words (pieces of text between safe
   cuts, see ``tokens``) and writes each document as the sequence of these numbers, its positions.
2. The words of all blocks are shuffled by a hash of the word.  Where a word arrives from all
   blocks that have it, it is encoded once, and its ids go back to each of these blocks.  A block
   sends a word once however often it occurs, so a very frequent word costs a row per block.
3. A block joins the ids to its sequences; documents are reassembled by position.

Blocks are shuffled once and serve both as the source of the words and as the left side of the last
join.  Decoding joins the ids with the token-byte table, which is as large as the vocabulary.
"""

from __future__ import annotations

import base64
import pickle
from array import array
from collections.abc import Iterable
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resurvey.llm.base import lean, only, release_memory
from resurvey.llm.tokens import CHUNK_BYTES, MARK, chunks, cut_text

# Text bytes of a block: its distinct words and sequences are held in one task at a time.
BLOCK_BYTES = 8 << 20
# Buckets of words for each input partition, and their bounds; a bucket's words are held in one task.
BUCKETS_PER_PARTITION, MIN_BUCKETS, MAX_BUCKETS = 8, 64, 16_384
# Bytes of a bucket's words kept at once, with what a word takes besides its letters and ids; beyond
# it they are forgotten, which costs time but not results.
KEPT_BYTES, WORD_BYTES = 128 << 20, 200


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ids of a rank file: lines of base64 and a number."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def encoder_of(ranks: dict[bytes, int], pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _pack(*parts) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(parts, protocol=5))


def _unpack(data: bytes) -> tuple:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(data))


class _Words:
    """Words behind one another in one buffer."""

    def __init__(self, data: bytes, sizes: bytes):
        self.data = data
        self.sizes = np.frombuffer(sizes, np.uint32).astype(np.int64)
        self.ends = np.cumsum(self.sizes)

    def __len__(self) -> int:
        return len(self.sizes)

    def __getitem__(self, i: int) -> bytes:
        end = int(self.ends[i])
        return self.data[end - int(self.sizes[i]) : end]

    def __iter__(self):
        start = 0
        for end in map(int, self.ends):
            yield self.data[start:end]
            start = end

    def take(self, at: np.ndarray) -> tuple[bytes, bytes]:
        """The words at these places, and their lengths."""
        sizes = self.sizes[at]
        flat = np.frombuffer(self.data, np.uint8)[_gather(self.ends[at] - sizes, sizes)]
        return flat.tobytes(), sizes.astype(np.uint32).tobytes()


class _Block:
    """Documents being gathered."""

    def __init__(self):
        self.numbers: dict[str, int] = {}
        self.keys: list = []
        self.counts: list[int] = []
        self.places: list[np.ndarray] = []
        self.size = 0

    def add(self, keys: list, texts: list[str | None]) -> None:
        numbers = self.numbers
        found = array("I")
        for t in texts:
            pieces = cut_text(t) if t else []
            self.counts.append(len(pieces))
            found.extend([numbers.setdefault(p, len(numbers)) for p in pieces])
        self.places.append(np.frombuffer(found, np.uint32))
        self.keys += keys

    def packed(self) -> bytes:
        """Keys, counts, sequences, words; frequent words have small numbers."""
        places = np.concatenate(self.places)
        self.places = []
        uses = np.bincount(places, minlength=len(self.numbers))
        order = np.argsort(-uses, kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        places = rank[places]
        planes = [(places >> np.uint32(8 * k)).astype(np.uint8).tobytes() for k in range(4)]
        del places
        names = list(self.numbers)
        self.numbers.clear()
        words = [(p[1:] if p[:1] == MARK else " " + p).encode() for p in names]
        del names
        words = _Words(b"".join(words), np.fromiter(map(len, words), np.uint32, len(words)).tobytes())
        return _pack(self.keys, np.array(self.counts, np.int64).tobytes(), planes, *words.take(order))


def blocks_of(docs: DataFrame, key: str, text: str, block_bytes: int) -> DataFrame:
    """block, data: see ``_Block.packed``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        made, block = 0, _Block()

        def row() -> pa.RecordBatch:
            number = (TaskContext.get().partitionId() << 32) + made
            return pa.record_batch([pa.array([number], pa.int64()), pa.array([block.packed()], pa.binary())], ["block", "data"])

        for batch in batches:
            for part in chunks(batch, text, CHUNK_BYTES):
                block.add(part.column(key).to_pylist(), part.column(text).to_pylist())
                block.size += part.column(text).nbytes
                if block.size >= block_bytes:
                    yield row()
                    made, block = made + 1, _Block()
        if block.keys:
            yield row()

    return only(docs, key, text).mapInArrow(lean(run), "block long, data binary")


def _by_bucket(words: _Words, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words in the order of (bucket, word), and where each bucket begins."""
    where = np.fromiter((crc32(w) % buckets for w in words), np.uint16 if buckets <= 1 << 16 else np.uint32, len(words))
    order = np.argsort(where, kind="stable")
    borders = np.searchsorted(where[order], np.arange(buckets + 1))
    for a, b in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True):
        if b - a > 1:
            order[a:b] = sorted(order[a:b].tolist(), key=words.__getitem__)
    return order, borders


def bucketed_words(blocks: DataFrame, buckets: int) -> DataFrame:
    """bucket, block, words: the words of a block in each bucket, in alphabetical order."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = _Words(*_unpack(data.as_py())[3:])
                order, borders = _by_bucket(words, buckets)
                found = np.flatnonzero(np.diff(borders)).tolist()
                rows = [(b, _pack(*words.take(order[borders[b] : borders[b + 1]]))) for b in found]
                yield pa.record_batch(
                    [pa.array([b for b, _ in rows], pa.int32()), pa.array([block] * len(rows), pa.int64()), pa.array([w for _, w in rows], pa.binary())],
                    ["bucket", "block", "words"],
                )

    return blocks.mapInArrow(lean(run), "bucket int, block long, words binary")


def encoded_words(words: DataFrame, ranks_path: str, pattern: str, parts: int) -> DataFrame:
    """block, bucket, ids: the ids of the words of a block in one bucket, in the order of the words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        ranks = load_ranks(ranks_path)
        kind, code = ("<u2", "H") if max(ranks.values()) < 1 << 16 else ("<u4", "I")
        size = np.dtype(kind).itemsize
        encode = encoder_of(ranks, pattern).encode_ordinary
        known: dict[bytes, bytes] = {}
        now, held = None, 0
        for batch in batches:
            for bucket, block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if bucket != now or held > KEPT_BYTES:
                    known, now, held = {}, bucket, 0
                mine = _Words(*_unpack(data.as_py()))
                ids = []
                for w in mine:
                    coded = known.get(w)
                    if coded is None:
                        coded = known[w] = array(code, encode(w.decode())).tobytes()
                        held += len(w) + len(coded) + WORD_BYTES
                    ids.append(coded)
                counts = np.fromiter(map(len, ids), np.uint32, len(ids)) // size
                packed = _pack(kind, crc32(mine.data), counts.tobytes(), b"".join(ids))
                yield pa.record_batch([pa.array([block], pa.int64()), pa.array([bucket], pa.int32()), pa.array([packed], pa.binary())], ["block", "bucket", "ids"])

    return words.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(lean(run), "block long, bucket int, ids binary")


def _gather(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of ragged pieces: all of the first, then all of the second, ..."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


class TokenBytes:
    """The token-byte table: a row per token of the vocabulary, as arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values(), default=-1) + 1
        self.lengths = np.full(size, -1, np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)
        self.starts = np.cumsum(np.maximum(self.lengths, 0)) - np.maximum(self.lengths, 0)
        self.data = np.frombuffer(b"".join(t for t, _ in sorted(ranks.items(), key=lambda x: x[1])), np.uint8)

    def join(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids, in their order; an id that is not in the table is an error."""
        if len(ids) and (ids.max() >= len(self.lengths) or (self.lengths[ids] < 0).any()):
            raise ValueError("an id that is not in the vocabulary")
        return self.data[_gather(self.starts[ids], self.lengths[ids])].tobytes()


def encode_documents(
    docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES,
    decode: bool = False,
) -> DataFrame:
    """``key``, ``ids`` (little-endian unsigned 32-bit integers) of every row of ``docs``.

    With ``decode`` also ``decoded``, what the ids give back by the token-byte table, in the same task.

    ``pattern`` must be the splitting pattern for which the cuts in ``tokens`` are safe.  A NULL or
    empty text has no ids.  Rows are kept as they are: repeated rows give repeated rows, NULL keys
    stay, an empty table gives no rows.  Other columns are not read.
    """
    kind = docs.schema[key].dataType.simpleString()
    n = docs.rdd.getNumPartitions()
    buckets = min(MAX_BUCKETS, max(MIN_BUCKETS, BUCKETS_PER_PARTITION * n))
    blocks = blocks_of(docs, key, text, block_bytes).repartition(max(1, n), "block")
    ids = encoded_words(bucketed_words(blocks, buckets), ranks_path, pattern, max(1, n))
    table = docs.sparkSession.sparkContext.broadcast(TokenBytes(load_ranks(ranks_path))) if decode else None
    arrow_key = pa.from_numpy_dtype(np.int64) if kind in ("bigint", "int", "smallint", "tinyint") else pa.string()

    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows != 1:
            raise ValueError("ids for a block that is not there")
        keys, counts, planes, *words = _unpack(left.column("data")[0].as_py())
        words = _Words(*words)
        order, borders = _by_bucket(words, buckets)
        n_words = len(order)
        starts, lengths = np.zeros(n_words, np.int64), np.full(n_words, -1, np.int64)
        flat, base = [], 0
        for b, data in zip(right.column("bucket").to_pylist(), right.column("ids"), strict=True):
            numbers = order[borders[b] : borders[b + 1]]
            form, check, n_ids, coded = _unpack(data.as_py())
            n_ids = np.frombuffer(n_ids, np.uint32).astype(np.int64)
            # a block made again after a loss may hold its rows in another order and with other words
            if len(numbers) != len(n_ids) or crc32(words.take(numbers)[0]) != check:
                raise ValueError("a bucket came back with other words")
            starts[numbers] = base + np.cumsum(n_ids) - n_ids
            lengths[numbers] = n_ids
            flat.append(np.frombuffer(coded, form))
            base += len(flat[-1])
        if (lengths < 0).any():
            raise ValueError("a block has words without ids")
        flat = np.concatenate(flat or [np.zeros(0, "<u4")]).astype("<u4", copy=False)
        places = sum(np.frombuffer(p, np.uint8).astype(np.uint32) << np.uint32(8 * k) for k, p in enumerate(planes))
        ends = np.cumsum(np.frombuffer(counts, np.int64))
        out, decoded = [], []
        for a, b in zip((ends - np.frombuffer(counts, np.int64)).tolist(), ends.tolist(), strict=True):
            mine = places[a:b]
            ids = flat[_gather(starts[mine], lengths[mine])]
            out.append(ids.tobytes())
            if decode:
                decoded.append(table.value.join(ids))
        del flat, places, words, order
        release_memory()
        columns = [pa.array(keys, arrow_key), pa.array(out, pa.binary())]
        return pa.table([*columns, pa.array(decoded, pa.binary())] if decode else columns, ["id", "ids", "decoded"] if decode else ["id", "ids"])

    schema = f"id {'bigint' if arrow_key == pa.int64() else 'string'}, ids binary" + ", decoded binary" * decode
    joined = blocks.groupBy("block").cogroup(ids.groupBy("block")).applyInArrow(assemble, schema)
    return joined.select(F.col("id").cast(kind).alias(key), *joined.columns[1:])


def decode_documents(encoded: DataFrame, ranks_path: str, key: str = "doc_id") -> DataFrame:
    """``key``, ``ids``, ``decoded`` (bytes): the ids joined with the token-byte table.

    The table has a row per token of the vocabulary and goes to all tasks.  An id that is not in
    it is an error; no ids give no bytes.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(TokenBytes(load_ranks(ranks_path)))
    kind = encoded.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "ids", CHUNK_BYTES):
                out = [shared.value.join(np.frombuffer(packed.as_buffer(), "<u4")) for packed in part.column(1)]
                yield pa.record_batch([part.column(0), part.column(1), pa.array(out, pa.binary())], ["id", "ids", "decoded"])

    decoded = encoded.select(key, "ids").mapInArrow(lean(run), f"id {kind}, ids binary, decoded binary")
    return decoded.withColumnRenamed("id", key)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` of every row."""
    return encode_documents(docs, ranks_path, pattern, key, text, decode=True).select(
        key, F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )
