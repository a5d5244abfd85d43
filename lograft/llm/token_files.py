"""Token ids of a corpus as compressed binary files, and the way back.

Documents are dealt into ranges of doc_id; each range is written as one or more files (idcodec's format, in a binary
column beside the identifiers and lengths of its documents). Where a file begins in the corpus follows from the counts of
the files before it.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import idcodec
from .common import load, scratch, ship, whole_text
from .tokens import default_path, encoder

#: Ids after which a file is closed; a document never spans two files.
FILE_IDS = 8 << 20
SCHEMA = "part int, nth int, n_ids long, doc_ids array<long>, counts array<long>, data binary"
END = 0
#: Bytes of rows that are encoded together.
GATHER = 6 << 20


def gathered(batches):
    """Batches put together up to GATHER bytes: fewer pieces of texts are new in each."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= GATHER:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if size:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _files(path: str, file_ids: int):
    def run(batches):
        part, nth = TaskContext.get().partitionId(), 0
        encode = encoder(path).encode_column
        ids, docs, counts, held = [], [], [], 0

        def close():
            nonlocal ids, docs, counts, held, nth
            data = idcodec.encode(np.concatenate(ids))
            row = [pa.array([x], t) for x, t in ((part, pa.int32()), (nth, pa.int32()), (held, pa.int64()), (docs, pa.list_(pa.int64())), (counts, pa.list_(pa.int64())), (data, pa.binary()))]
            ids, docs, counts, held, nth = [], [], [], 0, nth + 1
            return pa.RecordBatch.from_arrays(row, ["part", "nth", "n_ids", "doc_ids", "counts", "data"])

        for batch in gathered(batches):
            found, sizes = encode(batch.column(1))
            found = np.insert(found, np.cumsum(sizes), END)
            names, sizes = batch.column(0).to_pylist(), (sizes + 1).tolist()
            begin = at = first = 0  # what of found, and which document of the batch, the open file begins with
            for k, n in enumerate(sizes):
                if held and held + n > file_ids:
                    ids.append(found[begin:at])
                    docs += names[first:k]
                    counts += sizes[first:k]
                    yield close()
                    begin, first = at, k
                held += n
                at += n
            ids.append(found[begin:])
            docs += names[first:]
            counts += sizes[first:]
        if docs:
            yield close()

    return run


def write(docs: DataFrame, path: str, tokenizer: str | None = None, file_ids: int = FILE_IDS) -> None:
    """Files of the ids of each row of docs (doc_id, text), an end id 0 after each, in ascending order of doc_id.

    Null texts count as empty; null doc_ids come first; rows with one doc_id stand next to each other; other columns are
    not looked at; an empty table gives no files. A text of any length is encoded whole and stands in one file, which is closed
    after file_ids ids.
    """
    ship(docs.sparkSession)
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(_files(tokenizer or default_path(), file_ids), SCHEMA).write.parquet(path)


def _documents(batches):
    for batch in batches:
        for k in range(batch.num_rows):
            docs, counts = batch["doc_ids"][k].values, batch["counts"][k].values.to_numpy()
            ids = memoryview(idcodec.decode(batch["data"][k].as_buffer().to_pybytes())).cast("B")
            ends = np.cumsum(counts)
            starts = ends - counts
            sums = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            n = len(docs)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, batch["part"][k].as_py(), np.int32)), pa.array(np.full(n, batch["nth"][k].as_py(), np.int32)), docs, pa.array(starts), pa.array(counts), pa.array(sums, pa.int64())],
                ["part", "nth", "doc_id", "inside", "n_tokens", "ids_crc32"],
            )


def read(spark, path: str) -> DataFrame:
    """One row per document of the files at path: doc_id, start, n_tokens, ids_crc32, all from the decoded ids."""
    ship(spark)
    files = spark.read.schema(SCHEMA).parquet(path)
    inside = files.select("part", "nth", "doc_ids", "counts", "data").mapInArrow(_documents, "part int, nth int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    # Where a file begins: its predecessors in its range, and the ranges before, of which there are as many as tasks.
    sizes = files.select("part", "nth", "n_ids")
    before = (Window.unboundedPreceding, -1)
    of_part = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    of_part = of_part.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(*before)), F.lit(0)).alias("base"))
    of_file = sizes.select("part", "nth", F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("nth").rowsBetween(*before)), F.lit(0)).alias("offset"))
    begins = of_file.join(of_part, "part").select("part", "nth", (F.col("base") + F.col("offset")).alias("begin"))
    return inside.join(begins, ["part", "nth"]).select("doc_id", (F.col("begin") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def op5_token_files(spark, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-files")
    write(load(spark, sf_dir, "documents"), path)
    return read(spark, path)
