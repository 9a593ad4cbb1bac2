"""Token ids as flat unsigned integer files with 64-bit document offsets, memory-mapped when read.

``documents`` is dealt by ranges of the id and sorted inside each, a task writes one pair of files, and the base of each
partition is a prefix sum over the manifest, which has one row per partition. Files carry a random part in their names and
count only if the manifest names them, so a task that is repeated after a lost executor does no harm.
"""

from __future__ import annotations

import os
import uuid
import zlib
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortroll.llm.common import narrow, ragged, text_slices, texts_of
from cohortroll.llm.library_tokens import library_words
from cohortroll.session import keep

MANIFEST = "part int, ids_file string, index_file string, n_docs bigint, n_ids bigint"
READ_IDS = 4_000_000  # ids of the documents that are read from a file at once


def encode_documents(df: DataFrame, path: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, ids array<int>``: ids by the library without special tokens, then ``end_id``.

    A null or empty text is ``end_id`` alone. Order and partitions stay as they are; rows may repeat.
    """

    def run(batches):
        words = library_words(path, keeps_space=True)
        for batch in text_slices(batches):
            ids, ends = words.encode_batch(texts_of(batch))
            ids = np.insert(ids, ends[1:], end_id)
            yield pa.RecordBatch.from_arrays([batch.column(0), ragged(ids, ends + np.arange(len(ends)))], ["doc_id", "ids"])

    frame = narrow(df, doc_id=doc_id, text=text)
    return frame.mapInArrow(run, f"doc_id {frame.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and the folder's path in it."""
    return fs.FileSystem.from_uri(folder) if urlparse(folder).scheme else (fs.LocalFileSystem(), os.path.abspath(folder))


def write_files(encoded: DataFrame, folder: str, width: int = 2, null_ids: bool = False) -> DataFrame:
    """Writes ``doc_id bigint, ids`` partition by partition, as they stand, and returns the manifest, read back.

    ``part-*.bin`` holds the ids, unsigned little-endian of ``width`` bytes (an id beyond that fails). ``part-*.idx``
    holds, for each document, its id, where its ids end and whether the id is null (1; the id is 0 then), each of 64 bits.
    Null document ids are refused unless ``null_ids``. An empty partition writes nothing; an empty table has an empty
    manifest.
    """
    limit = 1 << 8 * width

    def run(batches):
        part = TaskContext.get().partitionId()
        store, at = _store(folder)
        name = f"{at}/part-{part:06d}-{uuid.uuid4().hex}"
        out, index, n_docs, n_ids = None, None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                store.create_dir(at, recursive=True)
                out, index = store.open_output_stream(f"{name}.bin"), store.open_output_stream(f"{name}.idx")
            if batch.column(0).null_count and not null_ids:
                raise ValueError("a document without an id has no place in the files")
            lists = batch.column(1)
            ends, ids = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            ids = ids[ends[0]:ends[-1]]
            if len(ids) and not 0 <= int(ids.min()) <= int(ids.max()) < limit:
                raise ValueError(f"ids don't fit into {width} bytes")
            out.write(ids.astype(f"<u{width}").tobytes())
            rows = np.empty((batch.num_rows, 3), "<i8")
            rows[:, 0] = pc.fill_null(batch.column(0), 0).to_numpy(zero_copy_only=False)
            rows[:, 1] = n_ids + ends[1:] - ends[0]
            rows[:, 2] = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            index.write(rows.tobytes())
            n_docs, n_ids = n_docs + batch.num_rows, n_ids + len(ids)
        if out is not None:
            out.close()
            index.close()
            yield pa.RecordBatch.from_pylist([{"part": part, "ids_file": f"{name}.bin", "index_file": f"{name}.idx", "n_docs": n_docs, "n_ids": n_ids}],
                                             pa.schema([("part", pa.int32()), ("ids_file", pa.string()), ("index_file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    return keep(encoded.mapInArrow(run, MANIFEST), "token-manifest")


def with_bases(manifest: DataFrame) -> DataFrame:
    """Adds ``base``: the ids of all partitions before. The manifest has one row per partition, so one window holds it."""
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(order), F.lit(0)))


def read_files(based: DataFrame, folder: str, width: int = 2) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` from the files: a task maps a file pair into memory and walks its documents.

    ``start`` counts the ids of all documents before; ``ids_crc32`` is over unsigned 32-bit little-endian ids.
    """

    def mapped(path, kind):
        store, _ = _store(folder)
        if isinstance(store, fs.LocalFileSystem):
            return np.memmap(path, kind, mode="r")
        with store.open_input_file(path) as source:  # a store without files of its own can't be mapped
            return np.frombuffer(source.read(), kind)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, index = mapped(row["ids_file"], f"<u{width}"), mapped(row["index_file"], "<i8").reshape(-1, 3)
                ends = index[:, 1]
                at = 0
                while at < len(ends):
                    first = int(ends[at - 1]) if at else 0
                    to = max(at + 1, int(np.searchsorted(ends, first + READ_IDS, "right")))
                    whole = np.asarray(ids[first:int(ends[to - 1])]).astype("<u4").tobytes()
                    bounds = np.concatenate([[first], ends[at:to]]).astype(np.int64)
                    cuts = ((bounds - first) * 4).tolist()
                    view = memoryview(whole)
                    sums = [zlib.crc32(view[a:b]) for a, b in zip(cuts, cuts[1:])]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.array(index[at:to, 0]), mask=index[at:to, 2] == 1), pa.array(row["base"] + bounds[:-1]),
                        pa.array(np.diff(bounds)), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                    at = to

    spread = based.repartition(max(1, based.sparkSession.sparkContext.defaultParallelism), "part")
    return spread.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def in_id_order(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents dealt by ranges of the id and sorted, null ids first; equal ids follow their text's hash, so a repeated id can't fill one task."""
    frame = narrow(df, doc_id=doc_id, text=text)
    order = ["doc_id", F.xxhash64("text")]
    return frame.repartitionByRange(*order).sortWithinPartitions(*order)
