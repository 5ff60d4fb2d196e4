"""Operator 13: two tokenizers' tokens aligned by bytes, pairs counted by inverted bitmaps.

Both tokenizers see each text behind a space.  Texts are cut into units in front of spaces, and units
into parts at line ends and between letters and marks: neither tokenizer has tokens that run over
such a place, so the tokens, groups and links of a text are those of its parts.  A part is encoded
once, and a unit that occurs again is only looked up.

Documents gather in blocks, where they have small numbers.  A block inverts its links: for each
pair of ids it keeps the documents in which they are linked as compressed bitmaps, one per binary
digit of the number of links (multiplicity planes).  Bits of parts of a block are OR-merged; the
OR of a pair's planes counts its documents, the popcounts of its planes, times their powers of two,
its links.  Blocks hold different documents, so a pair's counts add up over blocks: the bitmap of a
very frequent pair is never brought together in one place.

Counts over all blocks tell which pairs are the most frequent of their second id.  They go back to
the blocks that have the pair, whose postings return them as scores to the documents.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import re
from collections.abc import Iterable
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resurvey.llm.base import Grown, lean, only, ragged, written
from resurvey.llm.tokens import AMBIGUOUS, INNER, LETTERS, MARKS, WORD, WordModel, batches_of, chunks

# Text bytes and documents of a block: its postings are held in one task at a time.
BLOCK_BYTES, BLOCK_DOCUMENTS = 16 << 20, 1 << 16
CHUNK_BYTES = 1_000_000
# Units kept in a worker; beyond it the memory starts anew, which costs time but not results.
KEPT_UNITS = 400_000
# Units of one text that are turned into links at once.
UNITS_AT_ONCE = 200_000

# In front of a run of spaces: the second vocabulary has pieces of several spaces.
CUT = re.compile(r"(?<=\S)(?= )")
# What no piece of the second vocabulary may hold: a character in front of its space, a line end, a
# letter or digit in front of a mark.
OVER_A_CUT = re.compile(rf"[^ ] |\n|[{LETTERS}0-9][{''.join(sorted(MARKS))}]")


def byte_of_character() -> dict[str, int]:
    """The bytes that characters of a byte-level vocabulary stand for: printable ones for themselves, the rest from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def units_of(text: str) -> list[str]:
    """Units of a text that is not empty, behind the space that both tokenizers see in front of it."""
    whole = " " + text
    if AMBIGUOUS.search(whole) is None:
        return [" " + w for w in text.split(" ")]
    return [u for u in CUT.split(whole) if u]


class Units:
    """Tokens, groups and links of units seen so far."""

    def __init__(self, a_path: str, b_path: str):
        # one thread per task: Spark decides how many tasks run
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = byte_of_character()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            known = all(c in letters for c in token)
            self.a_bytes[i] = bytes(letters[c] for c in token) if known else token.encode()
        self.b_bytes = [self._piece(i) for i in range(len(self.b))]
        if any(OVER_A_CUT.search(self.b.id_to_piece(i).replace("▁", " ")) for i in range(len(self.b))):
            raise ValueError("the piece vocabulary has tokens that run over the cuts of units")
        if not WordModel.fits(self.a):
            raise ValueError("the first tokenizer must be byte-level, with its splitting pattern")
        self.words = WordModel(a_path)
        self.a_size = np.array([len(t) for t in self.a_bytes])
        self.b_size = np.array([len(t) for t in self.b_bytes])
        self.a_name = [str(i) for i in range(len(self.a_bytes))]
        self.b_name = [str(i) for i in range(len(self.b_bytes))]
        self.before = self.b.encode("\n")  # its own space and the line end
        if len(self.before) != 2:
            raise ValueError("the piece tokenizer must put a space in front of texts and spell line ends by themselves")
        self.clear()

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def clear(self) -> None:
        self.numbers: dict[str, int] = {}
        self.groups: list[str] = []  # the groups of a unit as text
        self.n_a, self.n_b, self.n_groups, self.n_links, self.link_at = Grown(), Grown(), Grown(), Grown(), Grown()
        self.good = Grown(bool)
        self.links = Grown()  # a id * size of the b vocabulary + b id, for each link

    def of(self, texts: list[list[str]]) -> list[list[int]]:
        """The numbers of the units of texts."""
        get = self.numbers.get
        found = [list(map(get, units)) for units in texts]
        new = dict.fromkeys(u for units, f in zip(texts, found, strict=True) if None in f for u, n in zip(units, f, strict=True) if n is None)
        if not new:
            return found
        self.learn(list(new))
        get = self.numbers.__getitem__
        return [list(map(get, units)) if None in f else f for units, f in zip(texts, found, strict=True)]

    def learn(self, new: list[str]) -> None:
        parts = {u: p for u in new if not (u[0] == " " and u[1:].isalpha()) and len(p := INNER.split(u)) > 1}
        wanted = dict.fromkeys(p for ps in parts.values() for p in ps if p not in self.numbers)
        wanted.update(dict.fromkeys(u for u in new if u not in parts))
        words = [p for p in wanted if WORD(p, p[0] == " ")]
        others = [p for p in wanted if not WORD(p, p[0] == " ")]
        for kind, some in ((True, words), (False, others)):
            for start, stop in batches_of(some):
                self._learn(some[start:stop], kind)
        if parts:
            self._compose(list(parts), [[self.numbers[p] for p in ps] for ps in parts.values()])

    def _compose(self, units: list[str], parts: list[list[int]]) -> None:
        """Learn units from the numbers of their parts."""
        n = np.array([len(p) for p in parts])
        at = np.fromiter(chain.from_iterable(parts), np.int64, int(n.sum()))
        starts = np.cumsum(n) - n
        n_a, n_b, n_groups, n_links = (np.add.reduceat(x.data[at], starts) for x in (self.n_a, self.n_b, self.n_groups, self.n_links))
        good = np.logical_and.reduceat(self.good.data[at], starts)
        links = self.links.data[ragged(self.link_at.data[at], self.n_links.data[at])]
        groups = [";".join([self.groups[i] for i in p]) for p in parts]
        self._keep(units, n_a, n_b, n_groups, n_links, good, links, groups)

    def _keep(self, units: list[str], n_a: np.ndarray, n_b: np.ndarray, n_groups: np.ndarray, n_links: np.ndarray, good: np.ndarray, links: np.ndarray, groups: list[str]) -> None:
        self.numbers.update(zip(units, range(self.good.n, self.good.n + len(units)), strict=True))
        self.groups += groups
        self.link_at.add(self.links.n + np.cumsum(n_links) - n_links)
        self.links.add(links)
        for kept, new in ((self.n_a, n_a), (self.n_b, n_b), (self.n_groups, n_groups), (self.n_links, n_links), (self.good, good)):
            kept.add(new)

    def _encode_a(self, units: list[str], words: bool) -> tuple[np.ndarray, np.ndarray]:
        if words:
            ids, ends = self.words.encode(units)
            return ids, np.diff(ends, prepend=0)
        coded = [e.ids for e in self.a.encode_batch_fast(units, add_special_tokens=False)]
        n = np.array([len(c) for c in coded])
        return np.fromiter(chain.from_iterable(coded), np.int64, int(n.sum())), n

    def _encode_b(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The library puts a space in front by itself; what has none of its own is encoded behind a line end."""
        bare = [u[0] != " " or len(u) == 1 for u in units]
        coded = self.b.encode(["\n" + u if x else u[1:] for u, x in zip(units, bare, strict=True)], num_threads=1)
        for c, x in zip(coded, bare, strict=True):
            if x:
                if c[:2] != self.before:
                    raise ValueError("the piece tokenizer joins a line end with what follows")
                del c[:2]
        n = np.array([len(c) for c in coded])
        return np.fromiter(chain.from_iterable(coded), np.int64, int(n.sum())), n

    def _learn(self, units: list[str], words: bool) -> None:
        (ids_a, n_a), (ids_b, n_b) = self._encode_a(units, words), self._encode_b(units)
        data = [u.encode() for u in units]
        size = np.array([len(d) for d in data])
        at_a, at_b = np.repeat(np.arange(len(units)), n_a), np.repeat(np.arange(len(units)), n_b)
        good = (np.bincount(at_a, self.a_size[ids_a], len(units)) == size) & (np.bincount(at_b, self.b_size[ids_b], len(units)) == size)
        spelt = [b"".join(map(t.__getitem__, ids.tolist())) for t, ids in ((self.a_bytes, ids_a), (self.b_bytes, ids_b))]
        if not good.all() or not spelt[0] == spelt[1] == b"".join(data):
            ends_a, ends_b = np.cumsum(n_a).tolist(), np.cumsum(n_b).tolist()
            for i, d in enumerate(data):
                own_a, own_b = ids_a[ends_a[i] - n_a[i] : ends_a[i]].tolist(), ids_b[ends_b[i] - n_b[i] : ends_b[i]].tolist()
                good[i] = b"".join([self.a_bytes[t] for t in own_a]) == d == b"".join([self.b_bytes[t] for t in own_b])
            ids_a, ids_b = ids_a[good[at_a]], ids_b[good[at_b]]
            n_a, n_b = n_a * good, n_b * good
        # all units behind one another: both tokenizers' tokens cover the same bytes
        end_a, end_b = np.cumsum(self.a_size[ids_a]), np.cumsum(self.b_size[ids_b])
        first = np.searchsorted(end_b, end_a - self.a_size[ids_a], "right")
        count = np.searchsorted(end_b, end_a, "left") + 1 - first
        links = np.repeat(ids_a, count) * len(self.b_bytes) + ids_b[ragged(first, count)]
        unit_a = np.repeat(np.arange(len(units)), n_a)
        n_links = np.bincount(unit_a, count, len(units)).astype(np.int64)
        # groups end where tokens of both end
        _, last_a, last_b = np.intersect1d(end_a, end_b, assume_unique=True, return_indices=True)
        n_groups = np.bincount(unit_a[last_a], minlength=len(units))
        name_a, name_b = [self.a_name[i] for i in ids_a.tolist()], [self.b_name[i] for i in ids_b.tolist()]
        texts, p, q = [], 0, 0
        for x, y in zip((last_a + 1).tolist(), (last_b + 1).tolist(), strict=True):
            if x - p == 1 and y - q == 1:
                texts.append(f"{name_a[p]}|{name_b[q]}")
            else:
                texts.append(f"{','.join(name_a[p:x])}|{','.join(name_b[q:y])}")
            p, q = x, y
        groups, at = [], 0
        for n in n_groups.tolist():
            groups.append(";".join(texts[at : at + n]) if n != 1 else texts[at])
            at += n
        self._keep(units, n_a, n_b, n_groups, n_links, good, links, groups)


_KEPT: dict[tuple[str, str], Units] = {}


def units_in_worker(a_path: str, b_path: str) -> Units:
    """What a Python worker has learned so far; its tasks share it."""
    if (a_path, b_path) not in _KEPT:
        _KEPT[a_path, b_path] = Units(a_path, b_path)
    return _KEPT[a_path, b_path]


def summed(codes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, rising, and the sums of their weights."""
    if not len(codes):
        return codes, weights
    order = np.argsort(codes)
    codes, weights = codes[order], weights[order]
    starts = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    return codes[starts], np.add.reduceat(weights, starts)


class Block:
    """Documents being gathered; entries are (link * BLOCK_DOCUMENTS + number of the document, how many)."""

    def __init__(self):
        self.ids: list = []
        self.digests: list[str] = []
        self.numbers: list[tuple[int, int, int, int]] = []
        self.codes: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.size = 0

    def add(self, units: Units, ids: list, texts: list[str | None]) -> None:
        if len(units.numbers) > KEPT_UNITS:
            units.clear()
        pieces = [units_of(t) if t else [] for t in texts]
        found = units.of([p if len(p) <= UNITS_AT_ONCE else [] for p in pieces])
        used: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        later = []
        for key, own, at in zip(ids, pieces, found, strict=True):
            if len(own) > UNITS_AT_ONCE:
                later.append((key, own))
                continue
            numbers = np.array(at, np.int64)
            if not len(numbers) or not units.good.data[numbers].all():
                self.numbers.append((0, 0, 0, 0))
                self.digests.append("")
            else:
                used.append(numbers)
                owners.append(np.full(len(numbers), len(self.ids)))
                self.numbers.append(tuple(int(x.data[numbers].sum()) for x in (units.n_a, units.n_b, units.n_groups, units.n_links)))
                self.digests.append(hashlib.sha256(";".join(map(units.groups.__getitem__, at)).encode()).hexdigest())
            self.ids.append(key)
        self._post(units, used, owners)
        for key, own in later:
            self._add_long(units, key, own)

    def _add_long(self, units: Units, key: object, pieces: list[str]) -> None:
        """A long text, some units at a time; where a unit is not good its links are taken back."""
        before = len(self.codes)
        total, digest, good = np.zeros(4, np.int64), hashlib.sha256(), True
        for start in range(0, len(pieces), UNITS_AT_ONCE):
            if len(units.numbers) > KEPT_UNITS:
                units.clear()
            at = units.of([pieces[start : start + UNITS_AT_ONCE]])[0]
            numbers = np.array(at, np.int64)
            good = good and bool(units.good.data[numbers].all())
            if not good:
                break
            total += [x.data[numbers].sum() for x in (units.n_a, units.n_b, units.n_groups, units.n_links)]
            digest.update((";" * (start > 0) + ";".join(map(units.groups.__getitem__, at))).encode())
            self._post(units, [numbers], [np.full(len(numbers), len(self.ids))])
            codes, counts = summed(np.concatenate(self.codes[before:]), np.concatenate(self.counts[before:]))
            self.codes[before:], self.counts[before:] = [codes], [counts]
        if not good:
            del self.codes[before:], self.counts[before:]
        self.numbers.append(tuple(total.tolist()) if good else (0, 0, 0, 0))
        self.digests.append(digest.hexdigest() if good else "")
        self.ids.append(key)

    def _post(self, units: Units, used: list[np.ndarray], owners: list[np.ndarray]) -> None:
        if not used:
            return
        places = np.concatenate(owners) * units.good.n + np.concatenate(used)
        places, times = np.unique(places, return_counts=True)
        number, owner = places % units.good.n, places // units.good.n
        count = units.n_links.data[number]
        links = units.links.data[ragged(units.link_at.data[number], count)]
        codes, counts = summed(links * BLOCK_DOCUMENTS + np.repeat(owner, count), np.repeat(times, count))
        self.codes.append(codes)
        self.counts.append(counts)

    def postings(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
        """Pairs, rising, with their numbers of documents and links, and the packed bitmaps."""
        codes, counts = summed(np.concatenate(self.codes or [np.zeros(0, np.int64)]), np.concatenate(self.counts or [np.zeros(0, np.int64)]))
        self.codes, self.counts = [], []
        return pack_postings(codes // BLOCK_DOCUMENTS, (codes % BLOCK_DOCUMENTS).astype(np.uint16), counts, len(self.ids))


def pack_postings(pair: np.ndarray, doc: np.ndarray, count: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Planes of rows (pair, document, number of links), sorted by pair and document.

    A plane with few documents lists their numbers; one with more is a row of bits.
    """
    starts = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1]))) if len(pair) else np.zeros(0, np.int64)
    pairs = pair[starts]
    index = np.repeat(np.arange(len(pairs)), np.diff(np.append(starts, len(pair))))
    width = -(-n_docs // 8)
    n_links = np.zeros(len(pairs), np.int64)
    listed = np.zeros(len(pairs), np.int64)  # documents in any plane
    planes = []
    for k in range(int(count.max(initial=0)).bit_length()):
        at = np.flatnonzero(count >> k & 1)
        ones = np.bincount(index[at], minlength=len(pairs))
        dense = 2 * ones > width
        own = dense[index[at]]
        row = np.cumsum(dense) - 1
        bits = np.zeros(int(dense.sum()) * width, np.uint8)
        d = doc[at[own]].astype(np.int64)
        np.bitwise_or.at(bits, row[index[at[own]]] * width + (d >> 3), (1 << (d & 7)).astype(np.uint8))
        popcount = np.where(dense, 0, ones)
        popcount[dense] = np.bitwise_count(bits).reshape(-1, width).sum(1) if width else 0
        n_links += popcount.astype(np.int64) << k
        held = np.flatnonzero(ones)
        planes.append((held.astype(np.uint32), ones[held].astype(np.uint32), dense[held], doc[at[~own]], bits))
    if len(pair):
        listed = np.add.reduceat((count > 0).astype(np.int64), starts)
    data = zstandard.ZstdCompressor(level=1).compress(pickle.dumps((n_docs, pairs, planes), protocol=5))
    return pairs, listed, n_links, data


def plane_rows(n_docs: int, plane: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Indices of pairs and numbers of documents whose bit is set in a plane."""
    held, ones, dense, sparse, bits = plane
    width = -(-n_docs // 8)
    pairs = [np.repeat(held[~dense], ones[~dense])]
    docs = [sparse.astype(np.int64)]
    if dense.any():
        row, place = np.nonzero(np.unpackbits(bits.reshape(-1, width), axis=1, bitorder="little"))
        pairs.append(held[dense][row])
        docs.append(place)
    return np.concatenate(pairs).astype(np.int64), np.concatenate(docs)


def _sum_by(place: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Exact sums of whole numbers by place; halves keep the float sums of ``bincount`` exact."""
    low = np.bincount(place, values & 0x3FFFFFF, n).astype(np.int64)
    return low + (np.bincount(place, values >> 26, n).astype(np.int64) << 26)


def returned_scores(data: bytes, pairs: np.ndarray, links: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per document of a block: its links of best pairs, and the sum of its links' counts."""
    n_docs, held, planes = pickle.loads(zstandard.ZstdDecompressor().decompress(data))
    order = np.argsort(pairs)
    if not np.array_equal(pairs[order], held):
        raise ValueError("a block's pairs came back with others")
    links, best = links[order], best[order]
    n_best, total = np.zeros(n_docs, np.int64), np.zeros(n_docs, np.int64)
    for k, plane in enumerate(planes):
        at, doc = plane_rows(n_docs, plane)
        n_best += _sum_by(doc, best[at].astype(np.int64), n_docs) << k
        total += _sum_by(doc, links[at], n_docs) << k
    return n_best, total


DOC_FIELDS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def inverted(docs: DataFrame, a_path: str, b_path: str, key: str, text: str, block_bytes: int) -> DataFrame:
    """A row per block (block, docs, data) and a row per block and pair (block, pair, n_docs, n_links).

    ``pair`` is the first tokenizer's id times the size of the second's vocabulary plus its id.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        units = units_in_worker(a_path, b_path)
        made, block, id_type = 0, Block(), None

        def rows() -> Iterable[pa.RecordBatch]:
            number = (TaskContext.get().partitionId() << 32) + made
            pairs, n_docs, n_links, data = block.postings()
            fields = [pa.array(block.ids, id_type), *[pa.array([x[i] for x in block.numbers], pa.int64()) for i in range(4)], pa.array(block.digests)]
            own = pa.StructArray.from_arrays(fields, ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
            names = ["block", "docs", "data", "pair", "n_docs", "n_links"]
            none = [pa.nulls(1, pa.int64())] * 3
            yield pa.record_batch([pa.array([number]), pa.ListArray.from_arrays([0, len(own)], own), pa.array([data], pa.binary()), *none], names)
            n = len(pairs)
            yield pa.record_batch(
                [pa.array(np.full(n, number)), pa.nulls(n, pa.list_(own.type)), pa.nulls(n, pa.binary()), pa.array(pairs), pa.array(n_docs), pa.array(n_links)], names
            )

        for batch in batches:
            id_type = batch.column(key).type
            for part in chunks(batch, text, CHUNK_BYTES):
                if len(block.ids) + len(part) > BLOCK_DOCUMENTS:
                    yield from rows()
                    made, block = made + 1, Block()
                block.add(units, part.column(key).to_pylist(), part.column(text).to_pylist())
                block.size += part.column(text).nbytes
                if block.size >= block_bytes:
                    yield from rows()
                    made, block = made + 1, Block()
        if block.ids:
            yield from rows()

    out = f"block long, docs array<struct<id {kind}, {DOC_FIELDS}>>, data binary, pair long, n_docs long, n_links long"
    return only(docs, key, text).mapInArrow(lean(run), out)


def pair_counts(postings: DataFrame, b_size: int) -> DataFrame:
    """pair, a, b, n_docs, n_links, best: each pair's documents and links, and whether no other pair of its ``b`` has more links."""
    rows = postings.where("pair IS NOT NULL")
    counted = rows.groupBy("pair").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_links").alias("n_links"))
    b = (F.col("pair") % b_size).cast("int")
    counted = written(counted.select("pair", F.floor(F.col("pair") / b_size).cast("int").alias("a"), b.alias("b"), "n_docs", "n_links"), "align-pairs")
    top = counted.groupBy("b").agg(F.max("n_links").alias("top"))  # a row per id of the vocabulary at most
    return counted.join(top, "b").select("pair", "a", "b", "n_docs", "n_links", (F.col("n_links") == F.col("top")).alias("best"))


def vocabulary_size(path: str) -> int:
    import sentencepiece

    return len(sentencepiece.SentencePieceProcessor(model_file=path))


def align(
    docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES
) -> tuple[DataFrame, DataFrame]:
    """What documents and what pairs of ids look like under two tokenizers.

    Of documents, one row per row of ``docs``: ``key``, ``n_a``, ``n_b`` (tokens), ``n_groups``
    (stretches between byte offsets where tokens of both end), ``n_links`` (pairs of tokens whose
    bytes overlap), ``n_best`` (links whose pair is the most frequent of its ``b``, ties included),
    ``count_sum`` (the links' counts over all documents, added up) and ``groups_sha256``.  Of pairs:
    ``a``, ``b``, ``n_docs``, ``n_links``, ``best``.

    ``a_path`` is a byte-level vocabulary of the ``tokenizers`` library, ``b_path`` a sentencepiece
    model that puts a space in front of texts.  Strings of special tokens are plain text.  A NULL
    or empty text, and one that the tokens of either do not spell, has zeros and an empty digest.
    Repeated rows and rows that share a key count each by itself; NULL keys stay; an empty table
    gives no rows; other columns are not read.
    """
    kind = docs.schema[key].dataType.simpleString()
    postings = written(inverted(docs, a_path, b_path, key, text, block_bytes), "align-postings")
    pairs = written(pair_counts(postings, vocabulary_size(b_path)), "align-counts")
    own = postings.where("data IS NOT NULL").select("block", "docs", "data")
    asked = postings.where("pair IS NOT NULL").select(F.col("block").alias("to"), "pair")
    answers = asked.join(pairs.select("pair", "n_links", "best"), "pair")
    names = ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        flat = left.column("docs").combine_chunks().flatten()
        values = [right.column(c).to_numpy() for c in ("pair", "n_links", "best")]
        n_best, total = returned_scores(left.column("data")[0].as_py(), *values)
        return pa.table([*[flat.field(n) for n in names[:5]], pa.array(n_best), pa.array(total), flat.field("groups_sha256")], names)

    out = f"id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    found = own.groupBy("block").cogroup(answers.groupBy("to")).applyInArrow(score, out)
    return found.withColumnRenamed("id", key), pairs.drop("pair")
