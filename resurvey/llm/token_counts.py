"""Operator 3: token counts of whole texts, computed in Arrow batches that return lengths only.

Texts are cut at safe boundaries (see ``tokens``), so a very long text needs no more memory at
once than a chunk; batches for the library are balanced by bytes.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resurvey.llm.base import only
from resurvey.llm.tokens import CHUNK_BYTES, chunks, pieces_of

# A longer text is counted section by section, each cut at a safe boundary.
SECTION_CHARS = 1_000_000


def sections(text: str, size: int = SECTION_CHARS) -> Iterable[str]:
    """Sections of about ``size`` characters whose token counts add up to those of the text.

    A cut lies in front of a space between two characters that are not white space; a text
    without such a place stays whole.
    """
    start = 0
    while len(text) - start > size:
        at = start + size
        while (at := text.find(" ", at)) > 0:
            if at + 1 < len(text) and not text[at - 1].isspace() and not text[at + 1].isspace():
                break
            at += 1
        if at < 0:
            break
        yield text[start:at]
        start = at
    yield text[start:]


def token_counts(
    docs: DataFrame, tokenizer_path: str, limit: int = 1024, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Columns ``key``, ``n_bytes``, ``n_tokens``, ``over_limit`` (more than ``limit`` tokens).

    A NULL or empty text has no bytes and no tokens.  Rows are kept as they are: a repeated row
    gives repeated rows, a NULL key stays NULL, an empty table gives no rows.  Strings of special
    tokens inside a text count as the library's default has them.  Other columns are not read.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        pieces = pieces_of(tokenizer_path, lengths=True)
        for batch in batches:
            for part in chunks(batch, text, CHUNK_BYTES):
                counts = []
                for t in (texts := part.column(text).to_pylist()):
                    if t and len(t) > SECTION_CHARS:
                        counts.append(sum(pieces.of([s])[0] for s in sections(t)))
                    else:
                        counts.append(None)
                short = iter(pieces.of([t for t, c in zip(texts, counts, strict=True) if c is None]))
                counts = [next(short) if c is None else c for c in counts]
                yield pa.record_batch([part.column(key), pa.array(counts, pa.int64()), part.column("n_bytes")], ["id", "n_tokens", "n_bytes"])

    kind = docs.schema[key].dataType.simpleString()
    rows = only(docs, key, text).withColumn("n_bytes", F.coalesce(F.octet_length(text).cast("long"), F.lit(0).cast("long")))
    counted = rows.mapInArrow(run, f"id {kind}, n_tokens long, n_bytes long")
    return counted.select(F.col("id").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
