"""Schemas of the append-only logs that all operators read, as DDL that readers and createDataFrame take."""

from __future__ import annotations


DOT = "STRUCT<seq: BIGINT, replica: STRING>"

SET_OPS = "replica STRING, seq BIGINT, ts_ms BIGINT, set_id STRING, kind STRING, element STRING, tag_replica STRING, tag_seq BIGINT"
COUNTER_OPS = "replica STRING, seq BIGINT, ts_ms BIGINT, counter STRING, kind STRING, amount BIGINT"
REGISTER_OPS = "replica STRING, seq BIGINT, ts_ms BIGINT, key STRING, value STRING"
MAP_OPS = "replica STRING, seq BIGINT, map_id STRING, key STRING, kind STRING, v_kind STRING, v_int BIGINT, v_text STRING, v_bytes BINARY"
VERSION_VECTORS = "holder STRING, replica STRING, seq BIGINT"
DELTA_LOG = "replica STRING, seq BIGINT, payload STRING"
ACKS = "replica STRING, peer STRING, acked BIGINT"
INTERVALS = "from_replica STRING, to_replica STRING, from_seq BIGINT, to_seq BIGINT, arrival BIGINT, payload STRING"
DAG_NODES = "cid STRING, parents ARRAY<STRING>, payload_type TINYINT, payload BINARY, timestamp BIGINT, creator STRING"
SNAPSHOTS = "id STRING, version TINYINT, vv MAP<STRING, BIGINT>, superseded_roots ARRAY<STRING>, state BINARY, created_at BIGINT, creator STRING, metadata MAP<STRING, STRING>"
SEQ_OPS = f"doc_id STRING, kind STRING, id {DOT}, origin {DOT}, value STRING"
MARK_OPS = f"doc_id STRING, mark_id STRING, kind STRING, mark_kind STRING, a1 STRING, a2 STRING, start_kind STRING, start_id {DOT}, end_kind STRING, end_id {DOT}"
JSON_OPS = f"doc_id STRING, object_id STRING, key STRING, value_id {DOT}, kind STRING, b BOOLEAN, i BIGINT, f DOUBLE, s STRING, ref STRING, deletes ARRAY<{DOT}>"
DOC_CHANGES = "replica STRING, seq BIGINT, ts_ms BIGINT, doc_id STRING, kind STRING, doc_type STRING, title STRING, meta_key STRING, meta_value STRING"
PRESENCE_EVENTS = "user_id STRING, clock BIGINT, ts_ms BIGINT, status STRING, doc_id STRING, position INT, anchor INT, removed BOOLEAN"
UNDO_OPS = "doc_id STRING, replica STRING, clock BIGINT, action STRING, group_id STRING, op_kind STRING, position INT, deleted STRING, inserted STRING"
RELAY_MESSAGES = "arrival BIGINT, type STRING, doc_id STRING, user_id STRING, user_name STRING, user_color STRING, state STRING, cursor INT, sel_start INT, sel_end INT"
