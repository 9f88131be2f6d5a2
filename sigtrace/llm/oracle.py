"""SQL of the queries that SQL can express; the others are tested against brute force."""

from __future__ import annotations

_NUMBER = "CASE WHEN trim({0}) ILIKE '0x%' THEN CAST(lower(trim({0})) AS UBIGINT) ELSE TRY_CAST(trim({0}) AS UBIGINT) END"

_RUNS = f"""
    WITH n AS (
        SELECT row_id, received_at, analysis_id, frame, is_heartbeat,
            {_NUMBER.format("seq_num")} AS seq, {_NUMBER.format("seid")} AS sei, {_NUMBER.format("msg_type")} AS typ,
            TRY_CAST(time_epoch AS DECIMAL(38,18)) AS t,
            least(coalesce(transport.src_ip, ''), coalesce(transport.dst_ip, '')) AS peer_a,
            greatest(coalesce(transport.src_ip, ''), coalesce(transport.dst_ip, '')) AS peer_b
        FROM pfcp_messages
    ), once AS (
        SELECT * FROM (
            SELECT *, row_number() OVER (PARTITION BY analysis_id, frame, seq, sei ORDER BY received_at, row_id) AS k FROM n
        ) WHERE k = 1
    ), e AS (
        SELECT *, CASE WHEN typ IN (1, 2) THEN 'heartbeat' WHEN typ IS NOT NULL THEN 'type ' || typ
                       WHEN is_heartbeat THEN 'heartbeat' END AS event
        FROM once
    ), timed AS (
        SELECT * FROM e WHERE t IS NOT NULL
    ), m AS (
        SELECT *, CASE WHEN event = lag(event) OVER w THEN 0 ELSE 1 END AS new
        FROM timed WINDOW w AS (PARTITION BY analysis_id, peer_a, peer_b ORDER BY t, frame, seq NULLS FIRST, sei NULLS FIRST)
    ), r AS (
        SELECT *, sum(new) OVER (PARTITION BY analysis_id, peer_a, peer_b ORDER BY t, frame, seq NULLS FIRST, sei NULLS FIRST
                                 ROWS UNBOUNDED PRECEDING) AS run FROM m
    ), g AS (
        SELECT *, row_number() OVER u AS f,
            row_number() OVER (PARTITION BY analysis_id, peer_a, peer_b, run
                               ORDER BY t DESC, frame DESC, seq DESC NULLS LAST, sei DESC NULLS LAST) AS l
        FROM r WINDOW u AS (PARTITION BY analysis_id, peer_a, peer_b, run ORDER BY t, frame, seq NULLS FIRST, sei NULLS FIRST)
    )
"""

_UUID = "CASE WHEN regexp_matches(regexp_replace(translate(lower(trim({0})), '{{}}-', ''), '^urn:uuid:', ''), '^[0-9a-f]{{32}}$') THEN CAST(CAST(regexp_replace(translate(lower(trim({0})), '{{}}-', ''), '^urn:uuid:', '') AS UUID) AS VARCHAR) END"

# Labels of a recursive table with one row per vertex: each round takes the least label among the neighbours.
_GROUPS = f"""
    WITH RECURSIVE o AS (
        SELECT DISTINCT coalesce({_UUID.format("observation_id")}, nullif(trim(observation_id), '')) AS id FROM identity_observations WHERE observation_id IS NOT NULL
    ), p AS (
        SELECT {_UUID.format("left_observation_id")} AS x, {_UUID.format("right_observation_id")} AS y FROM identity_edges
        WHERE decision IN ('accepted', 'accepted_with_warning') AND edge_effect = 'union_same_type'
    ), e AS (
        SELECT DISTINCT x, y FROM (SELECT x, y FROM p UNION ALL SELECT y, x FROM p) WHERE x <> y AND x IN (SELECT id FROM o) AND y IN (SELECT id FROM o)
    ), g(id, label) USING KEY (id) AS (
        SELECT DISTINCT x, x FROM e
        UNION
        SELECT e.y, min(g.label) FROM g JOIN e ON e.x = g.id JOIN recurring.g AS r ON r.id = e.y WHERE g.label < r.label GROUP BY e.y
    )
"""

# p6, p7 and p8 are beyond SQL and tested against brute force.
ORACLE: dict[str, str] = {
    "p1_found": _RUNS
    + """
    SELECT analysis_id, min(frame) FILTER (f = 1) AS first_frame, min(frame) FILTER (l = 1) AS last_frame
    FROM g GROUP BY analysis_id, peer_a, peer_b, run HAVING count(*) >= 2
    """,
    "p1_collapsed": _RUNS
    + """
    SELECT analysis_id, peer_a, peer_b, any_value(event) AS event, count(*) AS n_events, max(t) - min(t) AS duration, min(t) AS first_time, max(t) AS last_time,
        min(frame) FILTER (f = 1) AS first_frame, min(frame) FILTER (l = 1) AS last_frame
    FROM g GROUP BY analysis_id, peer_a, peer_b, run
    UNION ALL
    SELECT analysis_id, peer_a, peer_b, event, 1, NULL, NULL, NULL, frame, frame FROM e WHERE t IS NULL
    """,
    "p2_found": _GROUPS + "SELECT label AS group_id, id AS observation_id FROM g",
    "p2_groups": _GROUPS + "SELECT coalesce(g.label, o.id) AS group_id, o.id AS observation_id FROM o LEFT JOIN g ON g.id = o.id",
}
