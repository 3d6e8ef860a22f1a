"""Presence: per user the event with the greatest logical clock, with cursors per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideweave.operators.sets import union_all

STALE_MS = 30_000


def current(events: DataFrame) -> DataFrame:
    """user_id and its newest event (clock, then time); removed users are left out."""
    best = events.groupBy("user_id").agg(F.max(F.struct("clock", "ts_ms", "status", "doc_id", "position", "anchor", "removed")).alias("p"))
    return best.select("user_id", "p.*").where("not removed").drop("removed")


def join(*states: DataFrame) -> DataFrame:
    """States of several holders: the newer clock wins, an equal one keeps the greater row."""
    cols = [c for c in states[0].columns if c != "user_id"]
    best = union_all(*states).groupBy("user_id").agg(F.max(F.struct(*cols)).alias("p"))
    return best.select("user_id", "p.*")


def cursors(events: DataFrame) -> DataFrame:
    """user_id, doc_id, position, anchor: the newest cursor of each user in each document."""
    best = events.where("doc_id is not null").groupBy("user_id", "doc_id").agg(F.max(F.struct("clock", "ts_ms", "position", "anchor")).alias("p"))
    return best.select("user_id", "doc_id", "p.position", "p.anchor")


def cursor_map(events: DataFrame) -> DataFrame:
    """user_id, cursors: a map from document to (position, anchor)."""
    each = F.array_sort(F.collect_list(F.struct("doc_id", F.struct("position", "anchor").alias("c"))))
    return cursors(events).groupBy("user_id").agg(F.map_from_entries(each).alias("cursors"))


def is_stale(updated: Column, now_ms: int, timeout_ms: int = STALE_MS) -> Column:
    return F.lit(now_ms) - updated > timeout_ms


def online(state: DataFrame, now_ms: int, timeout_ms: int = STALE_MS) -> DataFrame:
    return state.where(~is_stale(F.col("ts_ms"), now_ms, timeout_ms) & (F.col("status") != "Offline"))


def online_count(state: DataFrame, now_ms: int, timeout_ms: int = STALE_MS) -> DataFrame:
    return online(state, now_ms, timeout_ms).agg(F.count(F.lit(1)).alias("n"))


def users_in_document(events: DataFrame, now_ms: int, timeout_ms: int = STALE_MS) -> DataFrame:
    """doc_id, user_id of online users with a cursor in the document."""
    return cursors(events).join(online(current(events), now_ms, timeout_ms).select("user_id"), "user_id", "left_semi").select("doc_id", "user_id")


def cursors_in_document(events: DataFrame, now_ms: int, local: str | None = None, timeout_ms: int = STALE_MS) -> DataFrame:
    """Cursors of online users, the local one left out."""
    out = cursors(events).join(online(current(events), now_ms, timeout_ms).select("user_id"), "user_id", "left_semi")
    return out if local is None else out.where(F.col("user_id") != local)


def expired(state: DataFrame, now_ms: int, local: str | None = None, timeout_ms: int = STALE_MS) -> DataFrame:
    """Stale users to evict; never the local one."""
    out = state.where(is_stale(F.col("ts_ms"), now_ms, timeout_ms))
    return (out if local is None else out.where(F.col("user_id") != local)).select("user_id")


def removals(users: DataFrame, now_ms: int) -> DataFrame:
    """Removal events for users (user_id, clock): leaving is the removal of oneself."""
    null = F.lit(None)
    return users.select("user_id", (F.col("clock") + 1).alias("clock"), F.lit(now_ms).cast("long").alias("ts_ms"), F.lit("Offline").alias("status"), null.cast("string").alias("doc_id"), null.cast("int").alias("position"), null.cast("int").alias("anchor"), F.lit(True).alias("removed"))


def sessions(events: DataFrame, timeout_ms: int = STALE_MS) -> DataFrame:
    """user_id, session_start, session_end, n: runs of events with no gap beyond the timeout."""
    w = F.session_window(F.timestamp_millis("ts_ms"), f"{timeout_ms} milliseconds")
    out = events.groupBy("user_id", w).agg(F.count(F.lit(1)).alias("n"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"))
    return out.select("user_id", "first_ms", "last_ms", "n")
