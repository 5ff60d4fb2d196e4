"""Operator 11: documents packed into training sequences of equal attention cost.

The cost of a piece of n tokens is linear plus quadratic: 6 * width * n for the layers that treat
tokens one by one, n * n for attention within the piece.  A document gives whole sequences as long
as it can fill them; what remains of it is assigned, longest remainders first, to the sequence of
the lowest cost that has room for it.  Where none has, the remainder is cut to fill the roomiest
sequence and its rest takes its turn among the shorter ones.

Documents are dealt by a hash to groups of about ``GROUP_DOCUMENTS``, which pack by themselves.
The sequences of a group hold exactly its tokens: what the full ones leave goes into a few shorter
ones whose lengths are powers of two and need no padding.  Only numbers are shuffled for packing;
ids are written once and join their pieces afterwards.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resurvey.llm.base import lean, mixed, only, parts_for, written
from resurvey.llm.tokens import CHUNK_BYTES, chunks, pieces_of

SEQUENCE_TOKENS = 2048
# Width of the model whose cost is estimated.
WIDTH = 1024
GROUP_DOCUMENTS = 16_384
# Sequences of a group have numbers of so many bits.
NUMBER_BITS = 32


def cost_of(n: int, width: int = WIDTH) -> int:
    """Cost of a piece of ``n`` tokens, in multiplications per layer over twice the width."""
    return 6 * width * n + n * n


def capacities(tokens: int, size: int) -> list[int]:
    """Lengths of sequences that hold ``tokens`` exactly: full ones, then powers of two, falling."""
    full, rest = divmod(tokens, size)
    return [size] * full + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(lengths: list[int], size: int, width: int = WIDTH) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents with so many tokens, each at least one.

    Ties go to the earlier document and the earlier sequence.
    """
    out: list[tuple[int, int, int, int, int]] = []
    room = capacities(sum(n % size for n in lengths), size)
    number = len(room)  # sequences that one document fills come after the shared ones
    for i, n in enumerate(lengths):
        for start in range(0, n - n % size, size):
            out.append((i, start, size, number, 0))
            number += 1
    pieces = [(-(n % size), i, n - n % size) for i, n in enumerate(lengths) if n % size]
    heapq.heapify(pieces)
    cost, filled = [0] * len(room), [0] * len(room)
    # sequences wait by their room, until pieces are short enough for it
    waiting: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]
    for s, r in enumerate(room):
        heapq.heappush(waiting[r], (0, s))
    ready: list[tuple[int, int]] = []
    least = size + 1  # all sequences with so much room are ready
    widest = size
    while pieces:
        n, i, start = heapq.heappop(pieces)
        n = -n
        while least > n:
            least -= 1
            for x in waiting[least]:
                heapq.heappush(ready, x)
            waiting[least] = []
        if ready:
            s = heapq.heappop(ready)[1]
            take = n
        else:
            widest = min(widest, n - 1)
            while not waiting[widest]:
                widest -= 1
            s = heapq.heappop(waiting[widest])[1]
            take = widest
            heapq.heappush(pieces, (take - n, i, start + take))
        out.append((i, start, take, s, filled[s]))
        filled[s] += take
        cost[s] += cost_of(take, width)
        left = room[s] - filled[s]
        if left >= least:
            heapq.heappush(ready, (cost[s], s))
        elif left:
            heapq.heappush(waiting[left], (cost[s], s))
            widest = max(widest, left)
    return out


def numbered_ids(docs: DataFrame, tokenizer_path: str, end_id: int, key: str, text: str) -> DataFrame:
    """row (a number of its own), id (the key), n, ids (packed) of each text with ``end_id`` behind its ids."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        pieces = pieces_of(tokenizer_path, lengths=False)
        size = 2 if pieces.code == "H" else 4
        last = end_id.to_bytes(size, "little")
        press = zstandard.ZstdCompressor(level=1).compress
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in chunks(batch, text, CHUNK_BYTES):
                coded = [c + last for c in pieces.of(part.column(text).to_pylist())]
                yield pa.record_batch(
                    [
                        pa.array(np.arange(number, number + len(coded))), part.column(key), pa.array([len(c) // size for c in coded], pa.int64()),
                        pa.array([bytes([size]) + press(c) for c in coded], pa.binary()),
                    ],
                    ["row", "id", "n", "ids"],
                )
                number += len(coded)

    return only(docs, key, text).mapInArrow(lean(run), f"row long, id {kind}, n long, ids binary")


def packed_rows(sizes: DataFrame, size: int, group_documents: int, width: int = WIDTH) -> DataFrame:
    """row, start, length, sequence_id, offset: the pieces of rows (row, n), a written table."""
    groups = parts_for(sizes.count(), group_documents)
    dealt = sizes.select("row", "n", F.pmod(mixed("row"), F.lit(groups)).alias("bin"))

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("row")
        found = np.array(pack(rows.column("n").to_pylist(), size, width), np.int64).reshape(-1, 5)
        number = (rows.column("bin")[0].as_py() << NUMBER_BITS) + found[:, 3]
        return pa.table(
            [rows.column("row").take(pa.array(found[:, 0])), pa.array(found[:, 1]), pa.array(found[:, 2]), pa.array(number), pa.array(found[:, 4])],
            ["row", "start", "length", "sequence_id", "offset"],
        )

    return dealt.groupBy("bin").applyInArrow(run, "row long, start long, length long, sequence_id long, offset long")


def pack_documents(
    docs: DataFrame, tokenizer_path: str, end_id: int, size: int = SEQUENCE_TOKENS, key: str = "doc_id", text: str = "text",
    width: int = WIDTH, group_documents: int = GROUP_DOCUMENTS, with_ids: bool = True,
) -> DataFrame:
    """One row per piece: ``key``, ``start``, ``length``, (``ids``,) ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``.

    A document is the ids of its text with ``end_id`` behind them; ``start`` counts its ids before
    the piece.  A sequence holds at most ``size`` (a power of two) ids, laid gapless from offset 0;
    those with fewer ids hold a power of two of them.  ``ids`` are little-endian unsigned 32-bit
    integers, ``ids_crc32`` their checksum.

    A NULL or empty text is one end id.  Repeated rows and rows that share a key are documents of
    their own; a NULL key stays NULL; a long text takes as many sequences as it fills; an empty
    table gives no rows; other columns are not read.
    """
    if size < 1 or size & (size - 1):
        raise ValueError("the sequence length must be a power of two")
    kind = docs.schema[key].dataType.simpleString()
    rows = written(numbered_ids(docs, tokenizer_path, end_id, key, text), "packing-ids")
    parts = packed_rows(rows.select("row", "n"), size, group_documents, width)
    # a document's own pieces
    parts = parts.groupBy("row").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("parts"))
    joined = rows.join(parts, "row").select("id", "n", "ids", "parts")
    fields = ["start", "length", "sequence_id", "offset"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            lists = batch.column("parts")
            counts = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten()
            start, length = flat.field("start").to_numpy(), flat.field("length").to_numpy()
            at, sums, held = 0, [], []
            for packed, c in zip(batch.column("ids"), counts.tolist(), strict=True):
                data = memoryview(packed.as_py())
                ids = np.frombuffer(unpress(data[1:]), "<u2" if data[0] == 2 else "<u4").astype("<u4")
                for k in range(at, at + c):
                    piece = ids[start[k] : start[k] + length[k]].tobytes()
                    sums.append(crc32(piece))
                    if with_ids:
                        held.append(piece)
                at += c
            owner = pa.array(np.repeat(np.arange(len(batch)), counts))
            columns = [batch.column("id").take(owner), batch.column("n").take(owner), *[flat.field(f) for f in fields], pa.array(sums, pa.int64())]
            names = ["id", "doc_tokens", *fields, "ids_crc32"]
            yield pa.record_batch(columns + [pa.array(held, pa.binary())] * with_ids, names + ["ids"] * with_ids)

    out = f"id {kind}, doc_tokens long, start long, length long, sequence_id long, offset long, ids_crc32 long" + ", ids binary" * with_ids
    cols = ["start", "length", *["ids"] * with_ids, "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return joined.mapInArrow(lean(run), out).select(F.col("id").alias(key), *cols)
