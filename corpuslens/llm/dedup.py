"""Exact deduplication as a stateful stream.

Documents come in as digests of their normalised text. The keyed state, on disk in RocksDB and kept without expiry,
holds for each digest how many rows had it and, of the row to keep, its stable identifier, its length and its content
locator. Partial sums are made before the shuffle, so a text with very many copies is no burden on one task. On hits
the full normalised texts are compared; rows whose bytes differ in spite of equal digests are grouped by the bytes.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.runtime import materialise, new_path

#: Settings of the stream while it starts: state in RocksDB, of which changes are uploaded; no space is set aside for it
#: on disk, since there is a store for each partition, and those of an executor share a bounded memory.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
}
WHITE = " \t\n\x0b\x0c\r"
#: Groups with more than one HOT-th of the rows are dealt to SALTS tasks when bytes are compared.
HOT, SALTS = 1000, 64


def normalised(text: str = "text") -> Column:
    """The text without [\\x20\\x09-\\x0D]; null is empty."""
    return F.translate(F.coalesce(F.col(text), F.lit("")), WHITE, "")


def locator(docs: DataFrame) -> Column:
    """Where a row of a table in files is: the file, and its number there if the format tells it; empty for other rows."""
    for place in (F.concat_ws("#", "_metadata.file_path", "_metadata.row_index"), F.col("_metadata.file_path")):
        try:
            docs.select(place)
            return place
        except AnalysisException:
            continue
    return F.lit("")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_points (code points of the text), n_bytes and sha256 of the normalised text, locator."""
    plain = normalised().cast("binary")
    return docs.select("doc_id", F.coalesce(F.char_length("text"), F.lit(0)).cast("bigint").alias("n_points"), F.octet_length(plain).cast("bigint").alias("n_bytes"), F.sha2(plain, 256).alias("sha256"), locator(docs).alias("locator"))


def keep_state(stream: DataFrame, *keys: str) -> DataFrame:
    """From a stream (or table) of digests, by keys (sha256 and n_bytes): group_size and keep (n_points, minus_id, locator), the row that stays.

    It is the row with the most code points, then the smallest doc_id; rows without doc_id come last.
    """
    best = F.struct("n_points", F.coalesce(-F.col("doc_id"), F.lit(-(2**63)).cast("bigint")).alias("minus_id"), "locator")
    return stream.groupBy(*(keys or ("sha256", "n_bytes"))).agg(F.count("*").alias("group_size"), F.max(best).alias("keep"))


def run_stream(spark: SparkSession, folder: str, schema, files_per_batch: int = 10_000) -> DataFrame:
    """Feed the digest files of folder through the state; the last update of each digest.

    State and progress are in the shared folder: a run that is started again there goes on where it stopped.
    """
    out, state = new_path(spark, "groups"), new_path(spark, "state")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    before = {k: spark.conf.get(k, None) for k in STATE}
    try:
        for k, v in STATE.items():
            spark.conf.set(k, v)
        query = keep_state(stream).writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    kind = keep_state(spark.createDataFrame([], schema)).schema.add("batch", "long")
    updates = spark.read.schema(kind).parquet(out)
    last = updates.groupBy("sha256", "n_bytes").agg(F.max("batch").alias("batch"))
    return updates.join(last, ["sha256", "n_bytes", "batch"]).drop("batch")


def exact_duplicates(docs: DataFrame, files_per_batch: int = 10_000) -> DataFrame:
    """Row of docs -> doc_id, keep_id, group_size, kept, text_sha256, locator (of the row that stays).

    Texts are equal if identical without [\\x20\\x09-\\x0D]; null counts as empty. Of equal texts the row with the most
    code points, then the smallest doc_id, stays. Rows without doc_id stay only if no other row of their group has one
    (and keep_id is null then); rows that repeat a doc_id are each counted and each reported. Other columns are ignored,
    an empty table gives no row.
    """
    spark = docs.sparkSession
    folder = new_path(spark, "digests")
    found = digests(docs)
    found.write.parquet(folder)
    rows = spark.read.schema(found.schema).parquet(folder)
    if rows.isEmpty():
        return rows.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(0).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), F.col("sha256").alias("text_sha256"), "locator")
    groups = materialise(run_stream(spark, folder, found.schema, files_per_batch), "groups")
    out = rows.drop("locator").join(_kept(groups), ["sha256", "n_bytes"])
    differ = _differing(docs, groups)
    if not differ.isEmpty():
        out = out.join(differ, "sha256", "left_anti").unionByName(_by_bytes(docs, differ))
    return out.select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"), F.col("sha256").alias("text_sha256"), F.col("kept_at").alias("locator"))


def _kept(groups: DataFrame) -> DataFrame:
    """The groups with keep_id and kept_at in place of keep."""
    no_id = F.lit(-(2**63)).cast("bigint")
    return groups.select(*[c for c in groups.columns if c != "keep"], F.when(F.col("keep.minus_id") != no_id, -F.col("keep.minus_id")).alias("keep_id"), F.col("keep.locator").alias("kept_at"))


def _differing(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """sha256 of the groups of several rows whose full normalised texts aren't all the same bytes.

    They are if the least and the greatest are equal. Both are kept for each digest where the texts are read, so of a
    text with very many copies one goes on from each task.
    """
    several = groups.where("group_size > 1 AND n_bytes > 0").select("sha256", "group_size")
    large = F.col("group_size") > (groups.agg(F.sum("group_size")).first()[0] or 0) / HOT
    # fewer than HOT rows; their texts are dealt to SALTS tasks each
    hot = F.broadcast(several.where(large).select("sha256", F.lit(True).alias("hot")))
    dealt = several.select("sha256", F.explode(F.when(large, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
    plain = normalised().cast("binary")
    texts = docs.select("doc_id", F.sha2(plain, 256).alias("sha256"), plain.alias("plain")).join(hot, "sha256", "left")
    texts = texts.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).otherwise(0).cast("int")).join(dealt, ["sha256", "salt"], "left_semi")
    return materialise(texts.groupBy("sha256").agg(F.min("plain").alias("least"), F.max("plain").alias("most")).where("least <> most").select("sha256"), "differ")


def _by_bytes(docs: DataFrame, differ: DataFrame) -> DataFrame:
    """The rows with these digests, grouped by the bytes themselves."""
    plain = normalised().cast("binary")
    found = docs.select("doc_id", F.coalesce(F.char_length("text"), F.lit(0)).cast("bigint").alias("n_points"), F.octet_length(plain).cast("bigint").alias("n_bytes"), F.sha2(plain, 256).alias("sha256"), locator(docs).alias("locator"), plain.alias("plain"))
    inside = materialise(found.join(differ, "sha256", "left_semi"), "inside")
    return inside.drop("locator").join(_kept(keep_state(inside, "plain")), "plain").drop("plain")


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with their own columns. Rows that have the doc_id and the text (but for white space) of one that stays do, too."""
    dropped = exact_duplicates(docs).where("NOT kept").select("doc_id", F.col("text_sha256").alias("__sha256")).distinct()
    keyed = docs.withColumn("__sha256", F.sha2(normalised().cast("binary"), 256))
    same = keyed["doc_id"].eqNullSafe(dropped["doc_id"]) & (keyed["__sha256"] == dropped["__sha256"])
    return keyed.join(dropped, same, "left_anti").select(*docs.columns)
