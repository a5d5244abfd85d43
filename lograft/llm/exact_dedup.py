"""Exact deduplication as a stateful stream, with DataFrame and SQL functions only.

The stream's keyed state is on disk (RocksDB) and never expires. For each digest of a normalised text it
keeps the smallest identifier seen, the number of rows and the locator of the file that holds the keeper.
A hit, a row whose digest is in the state already, counts as a copy only after its full text has been compared
with the keeper's: once the stream has ended, the rows of digests that came more than once are grouped again by digest and full
text. The locator tells which row of which file is the keeper; no file is opened by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch, settings, whole_text, written

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Runs of these characters count as one space.
SPACES = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACES, " ")


#: Batches that a table is read in at least, if it has as many files.
BATCHES = 3
#: Rows above which a group's texts are dealt by a salt, or rows over this number if that is more; and the parts they are dealt in.
HOT, SALTS = 1000, 64


def keyed_state(signatures: DataFrame, path: str, files_per_batch: int) -> DataFrame:
    """One row per digest, after signatures (a table written at path) has run through the stream."""
    spark = signatures.sparkSession
    out = scratch(spark, "dedup-state")
    seen = (
        spark.readStream.schema(signatures.schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
        .groupBy("digest")
        .agg(F.min("doc_id").alias("keep_id"), F.min_by("locator", "doc_id").alias("keep_locator"), F.count("*").alias("group_size"))
    )
    with settings(
        spark,
        spark__sql__streaming__stateStore__providerClass=ROCKSDB,
        spark__sql__streaming__stateStore__rocksdb__changelogCheckpointing__enabled="true",
        spark__sql__streaming__stateStore__rocksdb__allowFAllocate="false",  # many small stores: no preallocated files
        spark__sql__streaming__stateStore__rocksdb__boundedMemoryUsage="true",
        spark__sql__streaming__stateStore__rocksdb__maxMemoryUsageMB="128",
    ):
        query = (
            seen.writeStream.outputMode("update").trigger(availableNow=True)
            .option("checkpointLocation", scratch(spark, "dedup-checkpoint"))
            .foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}"))
            .start()
        )
        query.awaitTermination()
    schema = "digest string, keep_id long, keep_locator string, group_size long"
    # The id only falls and the count only grows, so a group's last update has the least and the most.
    return (
        spark.read.schema(schema).parquet(f"{out}/batch=*").groupBy("digest")
        .agg(F.min("keep_id").alias("keep_id"), F.min_by("keep_locator", "keep_id").alias("keep_locator"), F.max("group_size").alias("group_size"))
    )


def dedup(docs: DataFrame, digest=lambda text: F.sha2(text, 256), files_per_batch: int | None = None) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, keep_id, group_size, kept, digest, keep_locator.

    Null texts count as empty. Of equal texts the smallest doc_id stays; null ids are larger than all others, and if a
    group has no other id, its rows stay. Rows that repeat the keeper's doc_id and text stay with it. Texts of any length
    are compared whole. Other columns are not looked at. An empty table gives an empty result. digest: text column to
    string column; a weak one costs time only. files_per_batch: files of signatures that one batch of the stream takes;
    unless it is given, a batch has work for each of the cluster's cores a few times over, and a small table BATCHES batches.
    """
    spark = docs.sparkSession
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(whole_text()).alias("norm"), F.input_file_name().alias("locator"))
    text = text.withColumn("digest", digest(F.col("norm")))
    path = scratch(spark, "dedup-signatures")
    signatures = text.select("doc_id", "digest", "locator")
    signatures.write.parquet(path)
    signatures = spark.read.schema(signatures.schema).parquet(path)
    if signatures.isEmpty():
        return spark.createDataFrame([], "doc_id long, keep_id long, group_size long, kept boolean, digest string, keep_locator string")
    if files_per_batch is None:
        files_per_batch = min(-(-len(signatures.inputFiles()) // BATCHES), 8 * spark.sparkContext.defaultParallelism)
    state = written(keyed_state(signatures, path, files_per_batch), "dedup-groups")

    # Full texts of each group against its keeper's, which is the row of that id behind its locator. Rows of very large groups
    # are dealt by a salt; there are at most HOT such groups, so their list may be broadcast.
    several = state.where("group_size > 1")
    large = F.col("group_size") > max(HOT, signatures.count() // HOT)
    hot = several.where(large)
    salts = F.when(large, SALTS).otherwise(1)
    several = several.select("digest", "keep_id", "keep_locator", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    dealt = text.join(F.broadcast(hot.select("digest", F.lit(SALTS).alias("salts"))), "digest", "left")
    dealt = dealt.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.coalesce("salts", F.lit(1))).cast("int")).join(several, ["digest", "salt"])
    own = F.col("doc_id").eqNullSafe(F.col("keep_id")) & F.col("locator").eqNullSafe(F.col("keep_locator"))
    contents = dealt.groupBy("digest", "salt", "norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"), F.max(own).alias("own"))
    contents = contents.groupBy("digest", "norm").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.max("own").alias("own"))
    contents = written(contents, "dedup-contents")
    unlike = contents.where("not own").select("digest").distinct()
    rows = signatures.join(state, "digest")
    if not unlike.isEmpty():
        unlike = written(unlike, "dedup-unlike")
        ids = text.join(unlike, "digest", "left_semi").select("digest", "norm", "doc_id")
        fixed = ids.join(contents, ["digest", "norm"]).select("doc_id", "keep_id", "group_size", "digest", F.lit(None).cast("string").alias("keep_locator"))
        rows = rows.join(unlike, "digest", "left_anti").select("doc_id", "keep_id", "group_size", "digest", "keep_locator").unionByName(fixed)
    return rows.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest", "keep_locator")


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    from .common import load

    return dedup(load(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


OP3_SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)
"""
