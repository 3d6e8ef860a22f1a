"""Pieces of the oracle SQL."""

from __future__ import annotations

EV = """ev AS (SELECT event_id, epoch_us(ts) // 1000 AS ts_ms, user_id, event_type, value,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, 'r' || (user_id % 8) AS replica FROM events)"""

NODES = """nodes AS (SELECT event_id, 'n' || lpad(event_id::VARCHAR, 9, '0') AS cid, ts_ms, replica FROM ev),
edges AS (SELECT DISTINCT cid AS child, 'n' || lpad(p::VARCHAR, 9, '0') AS parent FROM (
    SELECT cid, (event_id - 1) // 2 AS p FROM nodes WHERE event_id > 0
    UNION ALL SELECT cid, (event_id - 1) // 3 FROM nodes WHERE event_id > 0 AND event_id % 10 = 0))"""


def le8(x: str) -> str:
    """Eight bytes of a non-negative integer, least first."""
    h = f"format('{{:016x}}', ({x})::BIGINT)"
    return "unhex(" + " || ".join(f"substr({h}, {i}, 2)" for i in range(15, 0, -2)) + ")"
