"""Content hashes. Hashes are lower-case hex strings, whose order is that of their bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO = "0" * 64


def sha256(data: Column) -> Column:
    return F.sha2(data, 256)


def sha256_all(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def to_hex(data: Column) -> Column:
    return F.lower(F.hex(data))


def from_hex(text: Column) -> Column:
    """32 bytes from 64 hex digits, else null."""
    return F.when(text.rlike("^[0-9a-fA-F]{64}$"), F.unhex(text))


def short(text: Column) -> Column:
    return F.substring(text, 1, 8)


def is_zero(text: Column) -> Column:
    return text == ZERO


def le8(value: Column) -> Column:
    """A BIGINT as 8 bytes, least first."""
    return F.unhex(F.reverse(F.regexp_replace(F.lpad(F.hex(value), 16, "0"), "(.)(.)", "$2$1")))


def node_cid(parents: Column, payload_type: Column, payload: Column, timestamp: Column, creator: Column) -> Column:
    """Content id of a DAG node: parent count, sorted parents, type byte, payload, timestamp, creator."""
    kind = F.unhex(F.lpad(F.hex(payload_type.cast("long")), 2, "0"))
    return sha256_all(le8(F.size(parents).cast("long")), F.unhex(F.array_join(F.array_sort(parents), "")), kind, F.coalesce(payload, F.lit(b"")), le8(timestamp), F.encode(creator, "utf-8"))


def snapshot_id(version: Column, state: Column, vv: Column, created_at: Column, creator: Column) -> Column:
    """Content id of a snapshot: version byte, state, vector entries by replica, time, creator."""
    entry = lambda e: F.concat(F.encode(e["key"], "utf-8"), le8(e["value"]))
    vector = F.aggregate(F.transform(F.array_sort(F.map_entries(vv)), entry), F.lit(b""), lambda a, x: F.concat(a, x))
    return sha256_all(F.unhex(F.lpad(F.hex(version.cast("long")), 2, "0")), state, vector, le8(created_at), F.encode(creator, "utf-8"))


def message_id(origin: Column, heads: Column, timestamp: Column) -> Column:
    """Content id of a heads announcement."""
    return sha256_all(F.encode(origin, "utf-8"), F.unhex(F.array_join(heads, "")), le8(timestamp))
