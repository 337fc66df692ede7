"""Structured Streaming: overlays from a folder, and event-time aggregation as an extension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.snapshot import TABLES
from graphloom.streaming.store import Store


def watch_folder(store: Store, folder: str, table: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """New Parquet files under a folder become overlays of a table, a commit for each batch."""
    source = store.spark.readStream.schema(TABLES[table]).parquet(folder)

    def commit(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            store.commit_overlay(table, batch.distinct())

    w = source.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime="10 seconds")).start()


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """window start, event_type, n, total of (ts, event_id, event_type, value): repeats dropped within the watermark."""
    own = events.withWatermark("ts", late)
    if events.isStreaming:
        own = own.dropDuplicatesWithinWatermark(["event_id"])
    else:
        own = own.dropDuplicates(["event_id"])
    return own.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


CHAT_PATTERNS = (("uses", r"(?i)\b(\w+) uses (\w+)\b"), ("depends_on", r"(?i)\b(\w+) depends on (\w+)\b"), ("is_a", r"(?i)\b(\w+) is an? (\w+)\b"))


def conversation_facts(turns: DataFrame, confidence: float = 0.85) -> DataFrame:
    """subject, rel, object, confidence, source of what turns state by a few patterns."""
    out = None
    for rel, rx in CHAT_PATTERNS:
        m = F.explode(F.arrays_zip(F.regexp_extract_all("text", F.lit(rx), 1).alias("s"), F.regexp_extract_all("text", F.lit(rx), 2).alias("o")))
        part = turns.select("conv_id", "turn", m.alias("m")).select(F.lower("m.s").alias("subject"), F.lit(rel).alias("rel"), F.lower("m.o").alias("object"), F.lit(confidence).alias("confidence"), F.concat_ws("_", "conv_id", "turn").alias("source"))
        out = part if out is None else out.unionByName(part)
    return out


def sync_turns(facts: DataFrame, known: DataFrame, threshold: float = 0.8) -> DataFrame:
    """facts with a decision: 'integrate', 'review' (under the threshold) or 'conflict' (is_a of another kind already)."""
    other = known.where("rel = 'is_a'").select("subject", F.col("object").alias("was")).distinct()
    j = facts.join(other, "subject", "left")
    d = F.when((F.col("rel") == "is_a") & F.col("was").isNotNull() & (F.col("was") != F.col("object")), "conflict").when(F.col("confidence") >= threshold, "integrate").otherwise("review")
    return j.withColumn("decision", d).drop("was").distinct()


def masked_tuples(spark: SparkSession, facts: DataFrame, share: float = 0.15, seed: int = 1) -> DataFrame:
    """fact_id, field, value, masked: fields of a fact table, some hidden, the same ones for the same seed."""
    names = [c for c in facts.columns if c != "fact_id"]
    rows = facts.select("fact_id", F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in names))).alias("f")).select("fact_id", "f.field", "f.value")
    return rows.withColumn("masked", F.pmod(F.xxhash64("fact_id", "field", F.lit(seed)), F.lit(1000)) < int(share * 1000))


def review(queue: DataFrame, decisions: DataFrame) -> DataFrame:
    """fact_id, status of a queue after decisions (fact_id, action: approve or reject); only what waits for review moves."""
    d = decisions.groupBy("fact_id").agg(F.max("action").alias("action"))
    new = F.when(F.col("status") != "review", F.col("status")).when(F.col("action") == "approve", "integrated").when(F.col("action") == "reject", "rejected").otherwise(F.col("status"))
    return queue.join(d, "fact_id", "left").select("fact_id", new.alias("status"))
