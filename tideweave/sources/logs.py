"""Operation logs derived from the supplied tables, deterministically."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

REPLICAS = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(df: DataFrame, column: str) -> Column:
    """Milliseconds since the epoch; times without a zone are in UTC whatever the session's zone."""
    if dict(df.dtypes)[column] == "timestamp_ntz":
        return F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {column})")
    return F.unix_millis(column)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, ts_ms, user_id, event_type, value, k, replica."""
    return derived_events(table(spark, sf_dir, "events"))


def derived_events(e: DataFrame) -> DataFrame:
    return e.select(
        "event_id",
        millis(e, "ts").alias("ts_ms"),
        "user_id",
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        F.concat(F.lit("r"), (F.col("user_id") % REPLICAS).cast("string")).alias("replica"),
    )


def counter_ops(ev: DataFrame) -> DataFrame:
    """Every event counts once for its type: errors down, all others up."""
    return ev.select("replica", F.col("event_id").alias("seq"), "ts_ms", F.col("event_type").alias("counter"), F.when(F.col("event_type") == "error", "dec").otherwise("inc").alias("kind"), F.lit(1).cast("long").alias("amount"))


def set_ops(ev: DataFrame) -> DataFrame:
    """Events other than errors add their k to the set of their type; an error removes the tags of its k seen before it in all sets of its replica."""
    adds = ev.where("event_type <> 'error'").select("replica", F.col("event_id").alias("seq"), "ts_ms", F.col("event_type").alias("set_id"), F.lit("add").alias("kind"), F.col("k").cast("string").alias("element"), F.col("replica").alias("tag_replica"), F.col("event_id").alias("tag_seq"))
    errors = ev.where("event_type = 'error'").select("replica", F.col("event_id").alias("at"), "ts_ms", F.col("k").cast("string").alias("element"))
    # the last error on (replica, k) has seen all tags before it
    last = errors.groupBy("replica", "element").agg(F.max("at").alias("at"), F.max("ts_ms").alias("ts_ms"))
    gone = adds.select("replica", "set_id", "element", "tag_replica", "tag_seq").join(last, ["replica", "element"]).where("tag_seq < at")
    removes = gone.select("replica", F.col("at").alias("seq"), "ts_ms", "set_id", F.lit("remove").alias("kind"), "element", "tag_replica", "tag_seq")
    return adds.unionByName(removes)


def register_ops(ev: DataFrame) -> DataFrame:
    return ev.select("replica", F.col("event_id").alias("seq"), "ts_ms", F.col("k").cast("string").alias("key"), F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("value"))


def map_ops(ev: DataFrame) -> DataFrame:
    """Purchases and signups put integers, clicks and views texts, errors remove; the map is the event's user modulo 50."""
    kind = F.when(F.col("event_type") == "error", "remove").otherwise("put")
    is_int = F.col("event_type").isin("purchase", "signup")
    return ev.select(
        "replica", F.col("event_id").alias("seq"), F.concat(F.lit("m"), (F.col("user_id") % 50).cast("string")).alias("map_id"), F.col("k").cast("string").alias("key"), kind.alias("kind"),
        F.when(kind == "put", F.when(is_int, "Int").otherwise("Text")).alias("v_kind"), F.when(is_int, F.col("event_id")).alias("v_int"), F.when(F.col("event_type").isin("click", "view"), F.col("event_type")).alias("v_text"), F.lit(None).cast("binary").alias("v_bytes"),
    )


def named_dag(ev: DataFrame) -> DataFrame:
    """DAG nodes with readable ids n<event>: the parent is at half the number, and of every tenth event at a third as well."""
    name = lambda c: F.concat(F.lit("n"), F.lpad(c.cast("string"), 9, "0"))
    up = lambda d: F.floor((F.col("event_id") - 1) / d).cast("long")
    two = F.array_distinct(F.array_compact(F.array(name(up(2)), F.when(F.col("event_id") % 10 == 0, name(up(3))))))
    parents = F.when(F.col("event_id") > 0, two).otherwise(F.array().cast("array<string>"))
    return ev.select(name(F.col("event_id")).alias("cid"), parents.alias("parents"), F.when(F.col("event_id") > 0, 1).otherwise(0).cast("tinyint").alias("payload_type"), F.encode("event_type", "utf-8").alias("payload"), F.col("ts_ms").alias("timestamp"), F.col("replica").alias("creator"))


def doc_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents created with a title from source and id, graded by labels as metadata, every 13th deleted."""
    docs = table(spark, sf_dir, "documents")
    null = F.lit(None).cast("string")
    kind = F.element_at(F.array(F.lit("Text"), F.lit("RichText"), F.lit("Json")), (F.col("doc_id") % 3 + 1).cast("int"))
    rid = F.concat(F.lit("r"), (F.col("doc_id") % REPLICAS).cast("string")).alias("replica")
    name = F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("doc_id")
    create = docs.select(rid, F.col("doc_id").alias("seq"), (F.col("doc_id") * 10).alias("ts_ms"), name, F.lit("create").alias("kind"), kind.alias("doc_type"), F.concat_ws("/", "source", (F.col("doc_id") % 97).cast("string")).alias("title"), null.alias("meta_key"), null.alias("meta_value"))
    grade = table(spark, sf_dir, "labels").select(rid, F.col("doc_id").alias("seq"), (F.col("doc_id") * 10 + 5).alias("ts_ms"), name, F.lit("metadata").alias("kind"), null.alias("doc_type"), null.alias("title"), F.lit("quality").alias("meta_key"), F.col("quality").cast("string").alias("meta_value"))
    gone = docs.where("doc_id % 13 = 0").select(rid, F.col("doc_id").alias("seq"), (F.col("doc_id") * 10 + 9).alias("ts_ms"), name, F.lit("delete").alias("kind"), null.alias("doc_type"), null.alias("title"), null.alias("meta_key"), null.alias("meta_value"))
    return create.unionByName(grade).unionByName(gone)


def presence_events(ev: DataFrame) -> DataFrame:
    status = F.when(F.col("event_type") == "error", "Offline").when(F.col("event_type") == "click", "Typing").otherwise("Online")
    return ev.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user_id"), F.col("event_id").alias("clock"), "ts_ms", status.alias("status"), F.concat(F.lit("doc"), (F.col("k") % 20).cast("string")).alias("doc_id"), F.col("k").cast("int").alias("position"), F.when(F.col("event_type") == "view", (F.col("k") + 5).cast("int")).alias("anchor"), F.lit(False).alias("removed"))


def relay_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as rooms: members are the conversation before, this and the next one's users; each turn is a sync."""
    c = table(spark, sf_dir, "conversations").where("conv_id is not null")
    rooms = c.select("conv_id").distinct()
    null = F.lit(None)
    tail = [null.cast("int").alias("cursor"), null.cast("int").alias("sel_start"), null.cast("int").alias("sel_end")]
    user = lambda n: F.concat(F.lit("u"), n.cast("string"))
    joins = rooms.withColumn("j", F.explode(F.array(*map(F.lit, range(4))))).select(
        (F.col("conv_id") * 1000 + F.col("j")).alias("arrival"), F.lit("join").alias("type"), F.concat(F.lit("room"), F.col("conv_id").cast("string")).alias("doc_id"), user(F.col("j")).alias("user_id"), F.concat(F.lit("name"), F.col("j").cast("string")).alias("user_name"), F.lit("#000000").alias("user_color"), null.cast("string").alias("state"), *tail
    )
    leaves = rooms.where("conv_id % 2 = 0").select((F.col("conv_id") * 1000 + 503).alias("arrival"), F.lit("leave").alias("type"), F.concat(F.lit("room"), F.col("conv_id").cast("string")).alias("doc_id"), user(F.lit(3)).alias("user_id"), null.cast("string").alias("user_name"), null.cast("string").alias("user_color"), null.cast("string").alias("state"), *tail)
    turns = c.select((F.col("conv_id") * 1000 + 500 + F.col("turn")).alias("arrival"), F.lit("sync").alias("type"), F.concat(F.lit("room"), F.col("conv_id").cast("string")).alias("doc_id"), user(F.col("turn") % 4).alias("user_id"), null.cast("string").alias("user_name"), null.cast("string").alias("user_color"), F.col("text").alias("state"), *tail)
    return joins.unionByName(leaves).unionByName(turns)
