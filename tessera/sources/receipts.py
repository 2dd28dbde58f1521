"""Run receipts as a sink: nested JSON lines by day and batch, written so that a repeated or broken-off write changes nothing twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T


def receipts(runs: DataFrame, claims: DataFrame) -> DataFrame:
    """One row a run: run_id, day, name and payload. runs: run_id, query, started (a timestamp), answer; claims: run_id, claim_id, verdict."""
    counted = lambda v: F.count_if(F.col("verdict") == v).alias(f"{v}_claims")
    summed = claims.groupBy("run_id").agg(F.count("*").alias("claim_count"), counted("supported"), counted("contradicted"), counted("insufficient_evidence"), F.array_sort(F.collect_list(F.struct("claim_id", "verdict"))).alias("claims"))
    j = runs.join(summed, "run_id", "left")
    counts = F.struct(*[F.coalesce(c, F.lit(0)).alias(c) for c in ("claim_count", "supported_claims", "contradicted_claims", "insufficient_evidence_claims")])
    payload = F.to_json(F.struct("run_id", F.col("query").alias("user_query"), F.date_format("started", "yyyy-MM-dd'T'HH:mm:ss").alias("started_at"), "answer", counts.alias("summary"), "claims"))
    return j.select("run_id", F.date_format("started", "yyyyMMdd").alias("day"), F.concat_ws("-", "run_id", T.slug(F.col("query"))).alias("name"), payload.alias("payload"))


def read_receipts(spark: SparkSession, folder: str) -> DataFrame:
    """The receipts under a folder: run_id, name, payload, day, batch; none where nothing was committed yet."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    there = place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
    schema = "run_id string, name string, payload string, day string, batch string"
    return spark.read.schema(schema).json(folder) if there else spark.createDataFrame([], schema)


def write_receipts(rows: DataFrame, folder: str) -> str:
    """Write the receipts (run_id, day, name, payload) that are not there yet, as JSON lines by day and batch; returns the batch.

    A batch is named by a digest of its run_ids, so the same rows make the same batch whenever they are written. Tasks write
    into a staging folder; committing the job moves whole folders of a day and batch into place and replaces those that a
    write before had left, so a job that dies leaves nothing visible, or some whole days. Written again, runs that are
    there are left out by run_id, and the rest goes into the same batch. Rows that repeat a run_id count once.
    """
    spark = rows.sparkSession
    one = rows.groupBy("run_id").agg(F.min(F.struct("day", "name", "payload")).alias("r")).select("run_id", "r.*")
    n, digest = one.agg(F.count("*"), F.bit_xor(F.xxhash64("run_id"))).first()
    batch = f"{n}-{(digest or 0) % (1 << 64):016x}"
    new = one.join(read_receipts(spark, folder).select("run_id").distinct(), "run_id", "left_anti").withColumn("batch", F.lit(batch))
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").json(folder)
    return batch


def run_id(query, started):
    """Time stamp and the first eight digits of a digest of query and time."""
    return F.concat(F.date_format(started, "yyyyMMdd'T'HHmmss'Z'"), F.lit("-"), F.substr(F.sha1(F.concat_ws("|", query, F.date_format(started, "yyyy-MM-dd'T'HH:mm:ss"))), F.lit(1), F.lit(8)))
