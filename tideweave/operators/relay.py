"""Rooms: parsing, membership and fan-out of relay messages, and client sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideweave.schemas import RELAY_MESSAGES

KINDS = ("join", "leave", "sync", "sync_request", "presence")


def parse(lines: DataFrame, column: str = "value") -> DataFrame:
    """Messages of JSON lines (arrival, value); invalid JSON and unknown types are dropped."""
    shape = RELAY_MESSAGES.removeprefix("arrival BIGINT, ")
    return lines.select("arrival", F.from_json(column, shape, {"mode": "PERMISSIVE"}).alias("m")).select("arrival", "m.*").where(F.col("type").isin(*KINDS))


def members_over_time(messages: DataFrame) -> DataFrame:
    """Join and leave intervals: doc_id, user_id, user_name, user_color, joined, left (null: still there)."""
    moves = messages.where("type in ('join', 'leave')")
    w = Window.partitionBy("doc_id", "user_id").orderBy("arrival")
    return moves.withColumn("left", F.lead("arrival").over(w)).where("type = 'join'").select("doc_id", "user_id", "user_name", "user_color", F.col("arrival").alias("joined"), "left")


def members(messages: DataFrame) -> DataFrame:
    """Who is in each room at the end: the last move of a user there is a join. Empty rooms do not occur."""
    last = messages.where("type in ('join', 'leave')").groupBy("doc_id", "user_id").agg(F.max_by(F.struct("type", "user_name", "user_color"), "arrival").alias("m"))
    return last.where("m.type = 'join'").select("doc_id", "user_id", "m.user_name", "m.user_color")


def room_users(messages: DataFrame) -> DataFrame:
    users = F.array_sort(F.collect_list(F.struct("user_id", "user_name", "user_color")))
    return members(messages).groupBy("doc_id").agg(users.alias("users"))


def fan_out(messages: DataFrame) -> DataFrame:
    """Deliveries of sync and presence messages: to everyone in the room at that moment but the sender."""
    sent = messages.where("type in ('sync', 'presence')").withColumnRenamed("user_id", "sender")
    room = members_over_time(messages).select("doc_id", F.col("user_id").alias("receiver"), "joined", "left")
    hit = sent.join(room, "doc_id").where("receiver <> sender and joined < arrival and (left is null or left > arrival)")
    return hit.select("arrival", "type", "doc_id", "sender", "receiver", "state", "cursor", "sel_start", "sel_end")


def notices(messages: DataFrame) -> DataFrame:
    """user_joined and user_left notices to the others in the room."""
    moves = messages.where("type in ('join', 'leave')").withColumnRenamed("user_id", "sender")
    room = members_over_time(messages).select("doc_id", F.col("user_id").alias("receiver"), "joined", "left")
    hit = moves.join(room, "doc_id").where("receiver <> sender and joined < arrival and (left is null or left > arrival)")
    return hit.select("arrival", F.when(F.col("type") == "join", "user_joined").otherwise("user_left").alias("notice"), "doc_id", "sender", "receiver")


def sync_requests(messages: DataFrame) -> DataFrame:
    """Each sync request goes to one other member: the first that joined."""
    asked = messages.where("type = 'sync_request'").withColumnRenamed("user_id", "sender")
    room = members_over_time(messages).select("doc_id", F.col("user_id").alias("receiver"), "joined", "left")
    hit = asked.join(room, "doc_id").where("receiver <> sender and joined < arrival and (left is null or left > arrival)")
    return hit.groupBy("arrival", "doc_id", "sender").agg(F.min_by("receiver", F.struct("joined", "receiver")).alias("receiver"))


def sessions(requests: DataFrame) -> DataFrame:
    """Get or create: the first request of each session_id makes it."""
    return requests.groupBy("session_id").agg(F.min_by(F.struct("peer_id", "arrival"), "arrival").alias("s")).select("session_id", "s.*")


def closed(sessions_: DataFrame, gone: DataFrame) -> DataFrame:
    return sessions_.join(gone.select("session_id"), "session_id", "left_anti")


def document_events(opens: DataFrame) -> DataFrame:
    """DocumentOpened of the first opening of each (session_id, doc_id)."""
    w = Window.partitionBy("session_id", "doc_id").orderBy("arrival")
    return opens.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r").withColumn("event", F.lit("DocumentOpened"))


def document_changes(log: DataFrame) -> DataFrame:
    """session_id, doc_id, arrival, event: DocumentOpened and DocumentClosed where a log (kind open or close) changes what is open.

    Opening an open document and closing one that is not open give no event.
    """
    w = Window.partitionBy("session_id", "doc_id").orderBy("arrival")
    before = F.coalesce(F.lag("kind").over(w), F.lit("close"))
    event = F.when(F.col("kind") == "open", "DocumentOpened").otherwise("DocumentClosed")
    return log.withColumn("_before", before).where("kind <> _before").select("session_id", "doc_id", "arrival", event.alias("event"))


def open_documents(events: DataFrame) -> DataFrame:
    """session_id, doc_id whose last event (kind open or close) is an opening."""
    last = events.groupBy("session_id", "doc_id").agg(F.max_by("kind", "arrival").alias("kind"))
    return last.where("kind = 'open'").select("session_id", "doc_id")
