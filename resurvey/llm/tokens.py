"""Whole texts through a byte-level tokenizer of the ``tokenizers`` library, piece by piece.

A text may be cut in front of a space unless white space stands on both sides of that cut: the
splitting pattern of these tokenizers starts a match at such a space in any case, and no match
runs over it.  The pieces of a text repeat, so each distinct piece is encoded once per task, in
batches of bounded size, and a whole text is the sum or the concatenation of its pieces.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable

import numpy as np
import pyarrow as pa

# Bytes of text that are cut into pieces at once, and of new pieces handed to the library at once.
CHUNK_BYTES = 2_000_000
BATCH_BYTES = 250_000
# Pieces kept in a worker; beyond it the memory starts anew, which costs time but not results.
KEPT_PIECES = 2_000_000

AMBIGUOUS = re.compile(r" \s")
CUT = re.compile(r"(?<=\S)(?= )|(?= \S)")
# Inside a piece: after a letter or digit in front of these marks, and after a single line end.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
MARKS = frozenset(".,!?;:#*$%&")
INNER = re.compile(rf"(?<=[{LETTERS}0-9])(?=[\n{''.join(sorted(MARKS))}])|(?<=\S\n)(?=[{LETTERS}0-9])")
# One match of the splitting pattern, whatever stands around it.
WORD = re.compile(f"[{LETTERS}]+").fullmatch
# Characters of a byte-level vocabulary for bytes: printable ones for themselves, the others from 256 on.
_PLAIN = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
LETTER_OF_BYTE = {b: chr(b) for b in sorted(_PLAIN)} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in _PLAIN)}
LETTER_OF_BYTE[ord("\n")] = "\n"  # between words
# Stands in front of a piece that has no space of its own; no valid text contains it.
MARK = "\ud800"


def cut_text(text: str) -> list[str]:
    """Pieces of a text; all but the first begin with a space, which is left out of them.

    The first piece is returned as it is, after ``MARK``, so that both kinds can share a memory.
    """
    if AMBIGUOUS.search(text) is None:
        parts = text.split(" ")
        parts[0] = MARK + parts[0]
        return parts
    found = [p for p in CUT.split(text) if p]
    return [MARK + found[0], *[p[1:] if p[0] == " " else MARK + p for p in found[1:]]]


def inner(piece: str) -> list[str]:
    """A piece cut once more at its marks; the parts are pieces themselves."""
    if piece[-1:] in MARKS and piece[:-1].isalpha() and piece[-2] < "\u0250":
        return [piece[:-1], MARK + piece[-1]]  # a word behind a space and one mark
    first, *rest = INNER.split(piece[1:] if piece[:1] == MARK else " " + piece)
    return [first[1:] if first[:1] == " " and len(first) > 1 else MARK + first, *[MARK + p for p in rest]]


class WordModel:
    """The model of a byte-level tokenizer for words that are one match of the splitting pattern each.

    Such words need no pattern: lines of them, in the characters of their bytes, go to the library at
    once, which takes half the time.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import Split

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes_of_id = np.zeros(max(vocabulary.values()) + 1, np.int64)  # a character of a token is a byte
        self.bytes_of_id[list(vocabulary.values())] = list(map(len, vocabulary))
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.pre_tokenizer = Split("\n", "removed")

    @staticmethod
    def fits(tokenizer) -> bool:
        """Whether a tokenizer does nothing but byte-level splitting by the pattern."""
        from tokenizers.pre_tokenizers import ByteLevel

        first = tokenizer.pre_tokenizer
        return tokenizer.normalizer is None and isinstance(first, ByteLevel) and not first.add_prefix_space and first.use_regex

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, each with its space if it has one, and where each word's ids end."""
        lines = "\n".join(words).encode().decode("latin-1").translate(LETTER_OF_BYTE)
        ids = np.array(self.tokenizer.encode_batch_fast([lines], add_special_tokens=False)[0].ids, np.int64)
        # a word ends where its bytes do
        done, bytes_ = np.cumsum(self.bytes_of_id[ids]), np.cumsum([len(x) for x in lines.split("\n")])
        ends = np.searchsorted(done, bytes_) + 1
        if ends[-1] != len(ids) or not np.array_equal(done[ends - 1], bytes_):
            raise ValueError("the tokenizer joins words")
        return ids, ends


class Pieces:
    """Pieces already seen, as their ids in little-endian bytes or as their number of tokens."""

    def __init__(self, path: str, lengths: bool):
        # one thread per task: Spark decides how many tasks run
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = self.tokenizer.get_added_tokens_decoder().values()
        if any(MARKS.intersection(t.content) or re.search(r"\s", t.content) for t in added):
            raise ValueError("a special token holds white space or a mark at which texts are cut")
        self.lengths = lengths
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.words = WordModel(path) if WordModel.fits(self.tokenizer) else None
        self.known: dict[str, int | bytes] = {}

    def _encode(self, new: list[str]) -> None:
        """Learn strings that hold no safe cut, in batches of bounded size."""
        texts = [p[1:] if p[:1] == MARK else " " + p for p in new]
        for start, stop in batches_of(texts):
            coded = self.tokenizer.encode_batch_fast(texts[start:stop], add_special_tokens=False)
            if self.lengths:
                self.known.update(zip(new[start:stop], map(len, coded), strict=True))
            else:
                made = [array(self.code, e.ids).tobytes() for e in coded]
                self.known.update(zip(new[start:stop], made, strict=True))

    def _encode_words(self, new: list[str]) -> None:
        """Learn words of letters, many at once."""
        for start, stop in batches_of(new):
            words = new[start:stop]
            ids, ends = self.words.encode([p[1:] if p[:1] == MARK else " " + p for p in words])
            if self.lengths:
                self.known.update(zip(words, np.diff(ends, prepend=0).tolist(), strict=True))
            else:
                size = array(self.code).itemsize
                data = ids.astype(f"<u{size}").tobytes()
                ends = (size * ends).tolist()
                self.known.update(zip(words, [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)], strict=True))

    def learn(self, new: set[str]) -> None:
        parts = {p: inner(p) for p in new if not p.isalpha()}
        wanted = new.difference(parts)  # nothing to cut
        wanted.update([q for ps in parts.values() for q in ps if q not in self.known])
        plain = [p for p in wanted if WORD(p, p[:1] == MARK)] if self.words else []
        self._encode_words(plain)
        self._encode([p for p in wanted if p not in self.known])
        get = self.known.__getitem__
        if self.lengths:
            self.known.update([(p, sum(map(get, ps))) for p, ps in parts.items()])
        else:
            self.known.update([(p, b"".join(map(get, ps))) for p, ps in parts.items()])

    def of(self, texts: list[str | None]) -> list:
        """Counts, or ids as bytes, of each text; nothing for NULL and for an empty text."""
        if len(self.known) > KEPT_PIECES:
            self.known.clear()
        cut = [cut_text(t) if t else [] for t in texts]
        found = [list(map(self.known.get, parts)) for parts in cut]
        holes = [[i for i, v in enumerate(values) if v is None] if None in values else () for values in found]
        self.learn({parts[i] for parts, at in zip(cut, holes, strict=True) for i in at})
        for parts, values, at in zip(cut, found, holes, strict=True):
            for i in at:
                values[i] = self.known[parts[i]]
        return [sum(v) for v in found] if self.lengths else [b"".join(v) for v in found]


def batches_of(texts: list[str], limit: int = BATCH_BYTES) -> Iterable[tuple[int, int]]:
    """Bounds of runs of about ``limit`` characters."""
    start = size = 0
    for i, s in enumerate(texts):
        size += len(s)
        if size >= limit or i == len(texts) - 1:
            yield start, i + 1
            start, size = i + 1, 0


_KEPT: dict[tuple[str, bool], Pieces] = {}


def pieces_of(path: str, lengths: bool) -> Pieces:
    """The pieces a Python worker has seen so far; its tasks share them."""
    if (path, lengths) not in _KEPT:
        _KEPT[path, lengths] = Pieces(path, lengths)
    return _KEPT[path, lengths]


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterable[pa.RecordBatch]:
    """Slices of the batch with about ``limit`` bytes of ``column`` each."""
    sizes = np.diff(np.asarray(offsets(batch.column(column))))
    ends = np.cumsum(sizes)
    start = 0
    while start < len(batch):
        base = ends[start - 1] if start else 0
        stop = int(np.searchsorted(ends, base + limit, "right"))
        stop = min(len(batch), max(stop, start + 1))
        yield batch.slice(start, stop - start)
        start = stop


def offsets(column: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    return np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1]
