"""Token ids of a corpus as binary files with Elias-Fano document boundaries.

The documents are dealt out by ranges of their id; each range is one shard of
two files.  ``ids-<shard>.bin`` holds the ids of its documents one after the
other, 2 or 4 bytes each, little-endian, with the end id behind each document.
``bounds-<shard>.ef`` holds a header (magic, bytes per id, number of documents
without an id, least document id), the document ids less the least one, and the
ends of the documents in the id array, both Elias-Fano encoded.  The place of
any document is found by ``select`` without a table of 64-bit offsets.

A shard is written under a name of its own and moved into place, so a task
that runs again replaces its files as a whole.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seepage.llm import elias_fano
from seepage.llm.encoding import default_path, encoder
from seepage.llm.tables import stored

#: Id behind each document.
END = 2
MAGIC = b"SEEPIDS1"
_HEAD = "<8sqqq"


def _place(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else "file://" + folder)


def _moved_in(store: fs.FileSystem, name: str, write) -> None:
    attempt = f"{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(attempt) as out:
        write(out)
    store.move(attempt, name)


def write(docs: DataFrame, folder: str, path: str | None = None, end: int = END) -> DataFrame:
    """Write ``docs`` (doc_id, text) to ``folder``; returns (shard, n_docs, n_ids) per shard.

    Ids ascend, rows without an id come first, rows with equal ids are ordered
    by a hash of their texts, then by the texts, wherever the rows lie.  Null
    texts are empty documents: the end id alone.
    """
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        size = own.kind.itemsize
        last = np.array([end], own.kind).tobytes()
        store, base = _place(folder)
        shard, doc_ids, ends, total = None, [], [], 0

        def ids_written(out: pa.NativeFile) -> None:
            nonlocal shard, total
            for batch in batches:
                if batch.num_rows and shard is None:
                    shard = batch.column("shard")[0].as_py()
                doc_ids.extend(batch.column("doc_id").to_pylist())
                for text in batch.column("text").to_pylist():
                    data = own.encode(text or "") + last
                    out.write(data)
                    total += len(data) // size
                    ends.append(total)

        attempt = f"{base}/attempt-{uuid.uuid4().hex}"
        with store.open_output_stream(attempt) as out:
            ids_written(out)
        if shard is None:
            store.delete_file(attempt)
            return
        store.move(attempt, f"{base}/ids-{shard:08d}.bin")
        known = np.array([i for i in doc_ids if i is not None], np.int64)
        least = int(known[0]) if len(known) else 0
        head = struct.pack(_HEAD, MAGIC, size, len(doc_ids) - len(known), least)
        bounds = head + elias_fano.encode((known - least).astype(np.uint64)) + elias_fano.encode(np.array(ends, np.uint64))
        _moved_in(store, f"{base}/bounds-{shard:08d}.ef", lambda out: out.write(bounds))
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([len(doc_ids)], pa.int64()), pa.array([total], pa.int64())], ["shard", "n_docs", "n_ids"])

    spark = docs.sparkSession
    store, base = _place(folder)
    store.create_dir(base)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the row's place tells equal rows apart, so that they spread over shards, too
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).withColumns({"_hash": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})
    ranged = rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), F.col("_hash"), F.col("_row"))
    ordered = ranged.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "_hash", "text", "_row").select("doc_id", "text", F.spark_partition_id().cast("long").alias("shard"))
    return stored(ordered.mapInArrow(run, "shard long, n_docs long, n_ids long"), "manifest")


class Shard:
    """One shard's files, read back."""

    def __init__(self, folder: str, shard: int):
        store, base = _place(folder)
        with store.open_input_stream(f"{base}/bounds-{shard:08d}.ef") as f:
            data = f.read()
        magic, self.size, self.unnamed, self.least = struct.unpack_from(_HEAD, data)
        if magic != MAGIC:
            raise ValueError("not a bounds file")
        self.names = elias_fano.Sequence(data, struct.calcsize(_HEAD))
        self.ends = elias_fano.Sequence(data, self.names.end)
        self.file = store.open_input_file(f"{base}/ids-{shard:08d}.bin")

    def __enter__(self) -> "Shard":
        return self

    def __exit__(self, *_: object) -> None:
        self.file.close()

    def __len__(self) -> int:
        return self.ends.n

    def doc_ids(self) -> list[int | None]:
        return [None] * self.unnamed + (self.names.all() + self.least).tolist()

    def ids(self, place: int) -> np.ndarray:
        """Ids of the document at ``place``: two selects and one read."""
        ends = self.ends.select(np.arange(max(place - 1, 0), place + 1))
        return self.between(int(ends[0]) if place else 0, int(ends[-1]))

    def between(self, start: int, end: int) -> np.ndarray:
        self.file.seek(start * self.size)
        return np.frombuffer(self.file.read((end - start) * self.size), f"<u{self.size}")


def read(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) per document, from the files.

    ``start`` counts all ids before the document, ``ids_crc32`` is taken over
    its ids as little-endian unsigned 32-bit numbers.
    """
    # one row per shard
    shards = sorted((r["shard"], r["n_ids"]) for r in manifest.collect())
    rows, before = [], 0
    for shard, n in shards:
        rows.append((shard, before))
        before += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with Shard(folder, row["shard"]) as shard:
                    names, ends = shard.doc_ids(), shard.ends.all()
                    starts = np.concatenate(([0], ends[:-1]))
                    for a in range(0, len(names), 1024):
                        b = min(a + 1024, len(names))
                        ids = shard.between(int(starts[a]), int(ends[b - 1])).astype("<u4")
                        base = int(starts[a])
                        sums = [zlib.crc32(ids[s - base : e - base].tobytes()) for s, e in zip(starts[a:b].tolist(), ends[a:b].tolist())]
                        yield pa.RecordBatch.from_arrays([
                            pa.array(names[a:b], pa.int64()), pa.array(starts[a:b] + row["before"], pa.int64()),
                            pa.array(ends[a:b] - starts[a:b], pa.int64()), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    listed = spark.createDataFrame(rows, "shard long, before long")
    return listed.repartition(max(1, len(rows)), "shard").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
