"""Operator 2: token ids as flat unsigned integer files with 64-bit document offsets.

A part holds a range of doc_id: ``part-N.bin`` (little-endian ids, 16 bits wide if the vocabulary allows, else 32),
``part-N.off`` (64-bit offsets of its documents, from 0, one more than documents) and ``part-N.doc`` (64-bit doc ids;
null is -2**63).  ``manifest.json`` lists parts in order with their base, the prefix sum of the ids before.  Rows are
range-partitioned by doc_id, which shuffles each text once; the driver sees one small row a part.  A part is written
under a name of its attempt and renamed when whole, so a task that runs again replaces it.

Null text is empty and gets the end id alone; equal doc ids stay separate documents, ordered by text hash; null ids
come first; an empty table gives an empty manifest.  Texts are encoded in steps of bounded size.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import encode_words
from .shared import byte_list, open_fs, partitions, steps, tidy, with_text

NO_ID = -(1 << 63)


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end_id: int | None = None, width: int = 16, parts: int | None = None) -> list[dict]:
    """Encode every text, write the files into ``path``, return the manifest's parts."""
    if width not in (16, 32):
        raise ValueError("ids are 16 or 32 bits wide")
    spark = docs.sparkSession
    kind = f"<u{width // 8}"
    fs, root = open_fs(path)
    fs.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(path)
        task = TaskContext.get()
        n, temp = task.partitionId(), f"{root}/.part-{task.partitionId():06d}-{task.taskAttemptId()}"
        sizes, ids_of, total = [], [], 0
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{temp}.bin") as out:
            for batch in batches:
                texts = byte_list(batch.column("text"))
                ids_of.append(batch.column("doc_id").fill_null(NO_ID).to_numpy())
                for a, b in steps(texts):
                    ids, count = encode_words(texts[a:b], tokenizer)
                    if end_id is not None:
                        at = np.cumsum(count + 1) - 1
                        full = np.full(len(ids) + len(count), end_id, np.uint32)
                        inner = np.ones(len(full), bool)
                        inner[at] = False
                        full[inner] = ids
                        ids, count = full, count + 1
                    if len(ids) and width == 16 and ids.max() > 0xFFFF:
                        raise ValueError("an id doesn't fit in 16 bits; write with width 32")
                    out.write(ids.astype(kind).tobytes())
                    sizes.append(count)
                    total += len(ids)
        if not ids_of:
            fs.delete_file(f"{temp}.bin")
            return
        for name, values in (("off", np.concatenate([[0], np.cumsum(np.concatenate([*sizes, np.zeros(0, np.int64)]))])), ("doc", np.concatenate(ids_of))):
            with fs.open_output_stream(f"{temp}.{name}") as out:
                out.write(values.astype("<i8").tobytes())
        for name in ("bin", "off", "doc"):
            fs.move(f"{temp}.{name}", f"{root}/part-{n:06d}.{name}")
        yield pa.RecordBatch.from_pydict({"part": [n], "docs": [sum(map(len, ids_of))], "ids": [total]}, pa.schema([("part", pa.int64()), ("docs", pa.int64()), ("ids", pa.int64())]))

    rows = (
        with_text(docs)
        .repartitionByRange(parts or partitions(spark), F.col("doc_id").asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
        .mapInArrow(tidy(run, "words"), "part long, docs long, ids long")
        .collect()  # one row a file
    )
    manifest, base, doc_base = [], 0, 0
    for r in sorted(rows):
        manifest.append({"part": r.part, "base": base, "doc_base": doc_base, "docs": r.docs, "ids": r.ids, "width": width})
        base, doc_base = base + r.ids, doc_base + r.docs
    with fs.open_output_stream(f"{root}/manifest.json") as out:
        out.write(json.dumps({"ids": base, "docs": doc_base, "parts": manifest}).encode())
    return manifest


def _map_file(fs, path: str, kind: str) -> np.ndarray:
    """Memory-mapped where the file is local, else read through."""
    if fs.type_name == "local":
        return np.memmap(path, kind, "r") if fs.get_file_info(path).size else np.zeros(0, kind)
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), kind)


def read_part(path: str, part: dict | object, step: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Doc ids, offsets (of the whole set, one more than documents) and ids of runs of a part's documents."""
    fs, root = open_fs(path)
    ids, off, doc = (_map_file(fs, f"{root}/part-{part['part']:06d}.{x}", k) for x, k in (("bin", f"<u{part['width'] // 8}"), ("off", "<i8"), ("doc", "<i8")))
    for a in range(0, len(doc), step):
        o = off[a : a + step + 1]
        yield doc[a : a + step], o + part["base"], ids[o[0] : o[-1]]


def read_tokens(spark: SparkSession, path: str, manifest: list[dict] | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as 32-bit integers), read back from the files."""
    if manifest is None:
        fs, root = open_fs(path)
        with fs.open_input_stream(f"{root}/manifest.json") as f:
            manifest = json.loads(f.read())["parts"]
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.to_pylist():
                for doc, off, ids in read_part(path, part):
                    at = (off - off[0]).tolist()
                    crc = [zlib.crc32(ids[a:b].astype("<u4")) for a, b in zip(at, at[1:])]
                    yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64(), mask=doc == NO_ID), pa.array(off[:-1], pa.int64()), pa.array(np.diff(off), pa.int64()), pa.array(crc, pa.int64())], schema=schema)

    parts = spark.createDataFrame([(p["part"], p["base"], p["width"]) for p in manifest], "part long, base long, width long")
    return parts.repartition(max(1, len(manifest))).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
