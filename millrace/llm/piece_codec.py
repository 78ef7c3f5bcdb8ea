"""Operator 10: piece encoding and decoding through a distinct-chunk table.

No piece of the model crosses from a character to a whitespace marker (checked when the model is loaded), so a text's
segmentation is that of its marked words, one after another.  Each Python worker segments each distinct marked word
once, keeps it in a bounded table over all its tasks, and joins ids and decoded bytes back by position.  Narrow: no
shuffle.  Null text is empty; an empty text has no ids; rows with equal ids stay separate rows; of other columns only
those named are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .chunks import encode_pieces
from .shared import byte_list, steps, tidy, with_text


def encode_column(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids (decimal, joined by commas), n_tokens, decoded: the operator's full outputs."""
    return _apply(docs, model, lambda n, ids, out: (n, ids.decode(), out.decode("utf-8", "replace")), "n_tokens long, ids string, decoded string", (pa.int64(), pa.string(), pa.string()))


def encode_digests(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return _apply(docs, model, lambda n, ids, out: (n, hashlib.sha256(ids).hexdigest(), hashlib.sha256(out).hexdigest()), "n_tokens long, ids_sha256 string, decoded_sha256 string", (pa.int64(), pa.string(), pa.string()))


def _apply(docs: DataFrame, model: str, each, schema: str, types: tuple) -> DataFrame:
    names = ["doc_id", *(x.split()[0] for x in schema.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = byte_list(batch.column("text"))
            for a, b in steps(texts):
                rows = [each(*x) for x in encode_pieces(texts[a:b], model)]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), *columns], names=names)

    return with_text(docs).mapInArrow(tidy(run, "pieces"), f"doc_id long, {schema}")
