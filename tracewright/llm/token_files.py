"""Documents to Simple-8b shard files in ascending doc_id order, and back.

Documents are dealt out by ranges of doc_id and sorted within them; each task encodes its range and writes shard
files of a bounded size under names of its own attempt. The manifest (one row a shard: range, place in it, path,
counts) is a written table, so only files of attempts that succeeded are ever read, and no later step encodes again.
A shard's first position is the sum of ids in the shards before it: a cumulative sum over ranges (a small aggregate),
then over the shards of each range.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm import common, simple8b, tokens

_MANIFEST = "part int, seq int, path string, n_docs long, n_ids long, n_bytes long"
_ROW = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _put(folder: str, name: str, data: bytes) -> str:
    """Any file system that pyarrow knows by its URI."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    with store.open_output_stream(f"{path}/{name}") as out:
        out.write(data)
    return f"{folder}/{name}"


def _get(uri: str) -> bytes:
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_file(path) as f:
        return f.read()


def write_tokens(
    docs: DataFrame, path: str, pattern: str, end_id: int = 2, shard_ids: int = 1 << 20, folder: str | None = None
) -> DataFrame:
    """Writes the shard files; returns their manifest, already written itself.

    A null text is the end id alone. Repeated ids keep all their rows; equal ids are ordered by text. A null id comes
    first and is read back as null. An empty table gives no shards. Other columns of docs are ignored. A shard ends with
    the document that brings it to shard_ids ids.
    """
    spark = docs.sparkSession
    folder = folder or common.new_path(spark, "tokens")

    def run(batches):
        part, attempt, encoder = TaskContext.get().partitionId(), uuid.uuid4().hex, tokens.encoder(path, pattern)
        seq, held = 0, []  # what a shard holds so far: document ids, counts and token ids, in pieces

        def shard():
            doc_ids = pa.chunked_array([x[0] for x in held])
            counts, ids = (np.concatenate([x[i] for x in held]) for i in (1, 2))
            data = simple8b.pack(doc_ids.drop_null().to_numpy(), counts, ids, doc_ids.null_count)
            uri = _put(folder, f"{part:06d}-{seq:06d}-{attempt}.s8b", data)
            return pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([part], pa.int32()),
                    "seq": pa.array([seq], pa.int32()),
                    "path": [uri],
                    "n_docs": [len(counts)],
                    "n_ids": [len(ids)],
                    "n_bytes": [len(data)]
                }
            )

        size = 0
        for table in common.text_blocks(batches, 8 << 20):
            counts, ids = encoder.ids_of(table.column("text").to_pylist())
            ids = np.insert(ids, np.cumsum(counts), end_id)
            counts += 1
            ends, doc_ids, at = np.cumsum(counts), table.column("doc_id").combine_chunks(), 0
            while at < len(counts):
                begin = ends[at] - counts[at]
                stop = min(int(np.searchsorted(ends, begin + shard_ids - size)) + 1, len(counts))
                held.append((doc_ids.slice(at, stop - at), counts[at:stop], ids[begin : ends[stop - 1]]))
                size, at = size + int(ends[stop - 1] - begin), stop
                if size >= shard_ids:
                    yield shard()
                    seq, held, size = seq + 1, [], 0
        if held:
            yield shard()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = ordered.repartitionByRange(common.partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    return common.written(ordered.mapInArrow(run, _MANIFEST), "token-manifest")


def with_starts(manifest: DataFrame) -> DataFrame:
    """Each shard's first position: sums over whole ranges first, so that no window sees more than the ranges or one range's shards."""
    ranges = manifest.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = ranges.select("part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("before"))
    own = Window.partitionBy("part").orderBy("seq")
    return manifest.join(before, "part").withColumn("start", F.col("before") + F.sum("n_ids").over(own) - F.col("n_ids")).drop("before")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, decoded from the shard files, a shard to a task at a time."""

    def run(batches):
        for batch in batches:
            for uri, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                doc_ids, counts, ids, nulls = simple8b.unpack(_get(uri))
                if len(ids) and int(ids.max()) >> 32:
                    raise ValueError(f"{uri} holds an id of more than 32 bits, which ids_crc32 does not cover")
                ends = np.cumsum(counts)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                own = pa.chunked_array([pa.nulls(nulls, pa.int64()), pa.array(doc_ids, pa.int64())]).combine_chunks()
                yield pa.RecordBatch.from_arrays(
                    [own, pa.array(start + ends - counts, pa.int64()), pa.array(counts, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"]
                )

    found = with_starts(manifest).select("path", "start").repartition(common.partitions(manifest.sparkSession), "path")
    return found.mapInArrow(run, _ROW)
