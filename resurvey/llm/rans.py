"""Operator 9: token ids in files coded by a range asymmetric numeral system with static tables.

One frequency table, counted over all documents, serves all blocks.  A block holds whole documents
in ascending order of their keys and is coded by itself: its ids are dealt to interleaved lanes,
each a coder state of its own, that share one stream of 32-bit words.  Checkpoints inside a block
hold the states of all lanes, so that decoding may start there; a checksum closes each block.

Layout of a block (little-endian): ``HEADER``; per document its key (8 bytes), whether it is NULL
(1 byte), its number of ids (8 bytes); per checkpoint the words used before it (8 bytes) and the
states of all lanes (8 bytes each), the first checkpoint being the start; the words; a CRC-32 of
all before; a zero byte.  Files are written by Spark's text sink with the zero byte as line end, so
they go to whatever file system the cluster shares, and are read as binary files.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from resurvey.llm.base import lean, mixed, only, parts_for, written
from resurvey.llm.tokens import CHUNK_BYTES, chunks, pieces_of

# Frequencies add up to 2**SCALE; states lie in [LOW, LOW << 32).
SCALE, LOW = 20, 1 << 31
LANES, BLOCK_IDS, CHECKPOINT_STEPS = 2048, 1 << 19, 64
FILE_IDS = 4 << 20
FILES_PER_GROUP = 1000
# Ids counted at once.
COUNT_IDS = 1 << 20
HEADER = struct.Struct("<4sQIIQIIQ")  # magic, bytes up to the CRC, table, documents, ids, lanes, checkpoints, words
MAGIC = b"RANB"


@dataclass
class Table:
    """Static frequencies of the ids."""

    symbols: np.ndarray  # ids that occur
    freqs: np.ndarray
    starts: np.ndarray

    @staticmethod
    def of_counts(symbols: np.ndarray, counts: np.ndarray) -> Table:
        """Frequencies near the shares of the counts, at least 1 each."""
        order = np.argsort(symbols)
        symbols, counts = symbols[order].astype(np.int64), counts[order].astype(np.float64)
        total = 1 << SCALE
        if len(symbols) > total:
            raise ValueError("more distinct ids than the table has places")
        if not len(symbols):
            return Table(symbols, np.zeros(0, np.uint64), np.zeros(0, np.uint64))
        # those whose share is below one place get one, the others share the rest of the places
        freqs = np.ones(len(symbols), np.int64)
        large = np.arange(len(symbols))
        while True:
            share = counts[large] / counts[large].sum() * (total - (len(symbols) - len(large)))
            if not (share < 1).any() or len(large) == 1:
                break
            large = large[share >= 1]
        freqs[large] = np.maximum(1, np.floor(share)).astype(np.int64)
        spare = total - int(freqs.sum())
        rank = large[np.argsort(np.floor(share) - share, kind="stable")]
        freqs[rank[:spare]] += 1  # fewer than there are ids of more than one place
        if freqs.sum() != total or freqs.min() < 1:
            raise ValueError("the frequencies do not fill the table")
        return Table(symbols, freqs.astype(np.uint64), np.concatenate(([0], np.cumsum(freqs)[:-1])).astype(np.uint64))

    def name(self) -> int:
        return crc32(self.freqs.tobytes(), crc32(self.symbols.tobytes()))


class Coder:
    def __init__(self, table: Table):
        self.table = table
        self.name = table.name()
        size = int(table.symbols.max()) + 1 if len(table.symbols) else 0
        self.freq = np.zeros(size, np.uint64)
        self.start = np.zeros(size, np.uint64)
        self.freq[table.symbols] = table.freqs
        self.start[table.symbols] = table.starts
        self.places: np.ndarray | None = None

    def encode(self, ids: np.ndarray) -> tuple[int, list[tuple[int, np.ndarray]], np.ndarray]:
        """Lanes, checkpoints (words before, states), words."""
        n = len(ids)
        lanes = max(1, min(LANES, n // 64))
        steps = -(-n // lanes)
        state = np.full(lanes, LOW, np.uint64)
        out, marks, used = [], [], 0
        shift, low32 = np.uint64(32), np.uint64(0xFFFFFFFF)
        for t in range(steps - 1, -1, -1):
            s = ids[t * lanes : (t + 1) * lanes]
            f = self.freq[s]
            x = state[: len(s)]
            full = x >= (f << np.uint64(63 - SCALE))
            words = (x[full] & low32).astype(np.uint32)
            out.append(words)
            used += len(words)
            x = np.where(full, x >> shift, x)
            q = x // f
            state[: len(s)] = (q << np.uint64(SCALE)) + (x - q * f) + self.start[s]
            if t % CHECKPOINT_STEPS == 0:
                marks.append((used, state.copy()))
        if not marks:
            marks.append((0, state))
        return lanes, [(used - u, st) for u, st in reversed(marks)], np.concatenate(out[::-1] or [np.zeros(0, np.uint32)])

    def decode(self, n: int, lanes: int, checkpoints: list[tuple[int, np.ndarray]], words: np.ndarray, first: int = 0, last: int | None = None) -> np.ndarray:
        """The ids from checkpoint ``first`` up to checkpoint ``last`` (the end if None)."""
        if self.places is None:
            self.places = np.repeat(self.table.symbols, self.table.freqs.astype(np.int64)).astype(np.uint32)
        at, state = checkpoints[first]
        state = state.copy()
        steps = -(-n // lanes)
        end = steps if last is None else min(steps, last * CHECKPOINT_STEPS)
        begin = first * CHECKPOINT_STEPS
        out = np.empty(max(0, min(n, end * lanes) - begin * lanes), np.uint32)
        mask, scale, shift = np.uint64((1 << SCALE) - 1), np.uint64(SCALE), np.uint64(32)
        for t in range(begin, end):
            active = min(lanes, n - t * lanes)
            x = state[:active]
            slot = x & mask
            s = self.places[slot.astype(np.int64)]
            x = self.freq[s] * (x >> scale) + slot - self.start[s]
            need = np.flatnonzero(x < LOW)
            x[need] = (x[need] << shift) | words[at : at + len(need)]
            at += len(need)
            state[:active] = x
            out[(t - begin) * lanes : (t - begin) * lanes + active] = s
        return out


    def decode_all(self, n: int, lanes: int, checkpoints: list[tuple[int, np.ndarray]], words: np.ndarray) -> np.ndarray:
        """All ids; the stretches between checkpoints are decoded side by side, each from its own."""
        whole = len(checkpoints) - 1  # all stretches but the last are full
        tail = self.decode(n, lanes, checkpoints, words, first=whole)
        if not whole:
            return tail
        at = np.array([a for a, _ in checkpoints[:whole]], np.int64)
        x = np.stack([state for _, state in checkpoints[:whole]])
        out = np.empty((whole, CHECKPOINT_STEPS, lanes), np.uint32)
        mask, scale, shift = np.uint64((1 << SCALE) - 1), np.uint64(SCALE), np.uint64(32)
        for t in range(CHECKPOINT_STEPS):
            slot = x & mask
            s = self.places[slot.astype(np.int64)]
            out[:, t] = s
            x = self.freq[s] * (x >> scale) + slot - self.start[s]
            row, lane = np.nonzero(x < LOW)
            used = np.bincount(row, minlength=whole)
            rank = np.arange(len(row)) - np.repeat(np.cumsum(used) - used, used)
            x[row, lane] = (x[row, lane] << shift) | words[at[row] + rank]
            at += used
        return np.concatenate((out.ravel(), tail))


def pack_block(coder: Coder, keys: list[int | None], sizes: list[int], ids: np.ndarray) -> bytes:
    """A block up to its last zero byte, which the sink adds."""
    lanes, marks, words = coder.encode(ids)
    body = b"".join([
        np.array([0 if k is None else k for k in keys], "<i8").tobytes(),
        bytes(k is None for k in keys),
        np.array(sizes, "<i8").tobytes(),
        *[struct.pack("<Q", u) + st.astype("<u8").tobytes() for u, st in marks],
        words.astype("<u4").tobytes(),
    ])
    head = HEADER.pack(MAGIC, HEADER.size + len(body), coder.name, len(keys), len(ids), lanes, len(marks), len(words))
    return head + body + struct.pack("<I", crc32(body, crc32(head)))


@dataclass
class Block:
    keys: list[int | None]
    sizes: np.ndarray
    lanes: int
    checkpoints: list[tuple[int, np.ndarray]]
    words: np.ndarray

    def ids(self, coder: Coder) -> np.ndarray:
        return coder.decode_all(int(self.sizes.sum()), self.lanes, self.checkpoints, self.words)


def read_blocks(data: bytes, table: int) -> Iterator[Block]:
    """The blocks of a file; raises ValueError where the file is damaged."""
    at = 0
    while at < len(data):
        if len(data) - at < HEADER.size:
            raise ValueError("the file ends inside a block")
        magic, size, name, n_docs, _, lanes, n_marks, n_words = HEADER.unpack_from(data, at)
        if magic != MAGIC or at + size + 5 > len(data):
            raise ValueError("not a block")
        (check,) = struct.unpack_from("<I", data, at + size)
        if crc32(memoryview(data)[at : at + size]) != check or data[at + size + 4] != 0:
            raise ValueError("a block has a wrong checksum")
        if name != table:
            raise ValueError("a block was written with another table")
        p = at + HEADER.size
        keys = np.frombuffer(data, "<i8", n_docs, p)
        nulls = np.frombuffer(data, np.uint8, n_docs, p + 8 * n_docs)
        sizes = np.frombuffer(data, "<i8", n_docs, p + 9 * n_docs)
        p += 17 * n_docs
        marks = []
        for _ in range(n_marks):
            marks.append((struct.unpack_from("<Q", data, p)[0], np.frombuffer(data, "<u8", lanes, p + 8)))
            p += 8 + 8 * lanes
        words = np.frombuffer(data, "<u4", n_words, p).astype(np.uint64)
        yield Block([None if z else int(k) for k, z in zip(keys, nulls, strict=True)], sizes, lanes, marks, words)
        at += size + 5


def ids_in(data: bytes) -> int:
    """The number of ids in a file, from the headers of its blocks."""
    at = total = 0
    while at < len(data):
        _, size, _, _, n, _, _, _ = HEADER.unpack_from(data, at)
        total += n
        at += size + 5
    return total


def token_ids(docs: DataFrame, tokenizer_path: str, end_id: int, key: str, text: str) -> DataFrame:
    """key, n, ids: packed ids of each text with ``end_id`` behind them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        pieces = pieces_of(tokenizer_path, lengths=False)
        size = 2 if pieces.code == "H" else 4
        last = end_id.to_bytes(size, "little")
        press = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for part in chunks(batch, text, CHUNK_BYTES):
                coded = [c + last for c in pieces.of(part.column(text).to_pylist())]
                n = pa.array([len(c) // size for c in coded], pa.int64())
                yield pa.record_batch([part.column(key).cast(pa.int64()), n, pa.array([bytes([size]) + press(c) for c in coded], pa.binary())], ["key", "n", "ids"])

    return only(docs, key, text).mapInArrow(lean(run), "key long, n long, ids binary")


def unpack(packed: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(memoryview(packed)[1:]), "<u2" if packed[0] == 2 else "<u4")


def _counts(rows: DataFrame) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            held: list[np.ndarray] = []
            size = 0
            for i, packed in enumerate(batch.column(0)):
                held.append(unpack(packed.as_py()))
                size += len(held[-1])
                if size > COUNT_IDS or i == len(batch) - 1:
                    found = np.bincount(np.concatenate(held), minlength=len(total))
                    found[: len(total)] += total
                    total, held, size = found, [], 0
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], ["symbol", "n"])

    return rows.select("ids").mapInArrow(run, "symbol long, n long").groupBy("symbol").agg(F.sum("n").alias("n"))


def write_ids(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, key: str = "doc_id", text: str = "text", file_ids: int = FILE_IDS) -> None:
    """Write the ids of all texts below ``path``: ``table`` (Parquet) and ``blocks`` (files in key order).

    ``key`` is an integer column; NULL keys come first, equal keys in an order fixed by their ids.  A
    NULL or empty text is one end id; an empty table gives no blocks.  Other columns are not read.
    """
    spark = docs.sparkSession
    rows = written(token_ids(docs, tokenizer_path, end_id, key, text), "rans-ids")
    _counts(rows).write.parquet(f"{path}/table")
    coder_of = _coder(spark, path)
    total = rows.agg(F.sum("n")).first()[0] or 0
    # equal keys are told apart by a hash, since Spark samples what it ranges by in the driver
    ranged = rows.withColumn("tie", mixed("ids")).repartitionByRange(parts_for(total, file_ids), "key", "tie")
    ordered = ranged.sortWithinPartitions("key", "tie", "ids")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        coder = Coder(coder_of.value)
        keys: list[int | None] = []
        parts: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for k, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                keys.append(k)
                parts.append(unpack(packed.as_py()))
                held += len(parts[-1])
                if held >= BLOCK_IDS:
                    yield pa.record_batch([pa.array([pack_block(coder, keys, [len(p) for p in parts], np.concatenate(parts))], pa.binary())], ["block"])
                    keys, parts, held = [], [], 0
        if keys:
            yield pa.record_batch([pa.array([pack_block(coder, keys, [len(p) for p in parts], np.concatenate(parts))], pa.binary())], ["block"])

    blocks = ordered.select("key", "ids").mapInArrow(lean(run), "block binary")
    # the text sink writes the bytes as they are
    blocks.select(F.col("block").cast("string").alias("value")).write.option("lineSep", "\0").text(f"{path}/blocks")


def _coder(spark: SparkSession, path: str):
    """The frequency table, for all tasks; it has a row per id of the vocabulary at most."""
    counts = spark.read.parquet(f"{path}/table").toArrow()
    table = Table.of_counts(counts.column("symbol").to_numpy(), counts.column("n").to_numpy())
    return spark.sparkContext.broadcast(table)


def read_ids(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row per document of the files: ``key``, ``start``, ``n_tokens``, ``ids_crc32`` (, ``ids``).

    Files are decoded in parallel, and the checkpoints of a block side by side.

    ``start`` counts the ids of all documents before it, over all files in their order.
    """
    coder_of = _coder(spark, path)
    extra = ", ids array<long>" if with_ids else ""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        coder = Coder(coder_of.value)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                before = 0
                for block in read_blocks(content.as_buffer().to_pybytes(), coder.name):
                    ids = block.ids(coder).astype("<u4")
                    ends = np.cumsum(block.sizes)
                    parts = np.split(ids, ends[:-1])
                    columns = [
                        pa.array([name] * len(parts)), pa.array(block.keys, pa.int64()), pa.array(before + ends - block.sizes),
                        pa.array(block.sizes), pa.array([crc32(p.tobytes()) for p in parts], pa.int64()),
                    ]
                    names = ["file", "key", "before", "n_tokens", "ids_crc32"]
                    if with_ids:
                        columns.append(pa.array([p.astype(np.int64) for p in parts], pa.list_(pa.int64())))
                        names.append("ids")
                    yield pa.record_batch(columns, names)
                    before += int(ends[-1])

    files = spark.read.format("binaryFile").load(f"{path}/blocks").select("path", "content")
    decoded = files.mapInArrow(run, f"file string, key long, before long, n_tokens long, ids_crc32 long{extra}")
    # files are numbered in the order of their keys
    number = F.regexp_extract("file", r"part-(\d+)", 1).cast("long")
    decoded = decoded.withColumn("file", number)

    def sizes(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            n = [ids_in(content.as_buffer().to_pybytes()) for content in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64())], ["file", "n"])

    totals = files.mapInArrow(sizes, "file string, n long").withColumn("file", number)  # a row per file
    totals = written(totals.withColumn("group", F.floor(F.col("file") / FILES_PER_GROUP)), "rans-totals")
    earlier = Window.rowsBetween(Window.unboundedPreceding, -1)
    groups = totals.groupBy("group").agg(F.sum("n").alias("g"))
    groups = groups.select("group", F.coalesce(F.sum("g").over(earlier.orderBy("group")), F.lit(0)).alias("g0"))
    inside = F.coalesce(F.sum("n").over(earlier.partitionBy("group").orderBy("file")), F.lit(0))
    starts = totals.withColumn("f0", inside).join(groups, "group").select("file", (F.col("f0") + F.col("g0")).alias("f0"))
    cols = ["key", (F.col("f0") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]
    return decoded.join(starts, "file").select(*cols)
