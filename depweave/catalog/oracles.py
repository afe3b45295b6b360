"""The same results in DuckDB SQL over the same parquet tables."""

TASKS = """
tasks_ev AS (
  SELECT user_id AS graph_id,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS task_id,
         event_id AS seq, event_type AS name, ts,
         (event_type = 'error' AND value > 150) AS failed,
         CAST(round(value * 100) AS BIGINT) AS cost_us
  FROM events)"""

EDGES = (
    TASKS
    + """,
edges_ev AS (
  SELECT graph_id, min(((seq * 7919) % 1000003) * 2 + slot) AS edge_seq, task_id AS dependent_id,
         CASE slot WHEN 0 THEN 1 + seq % (task_id - 1) ELSE 1 + (seq // 7) % (task_id - 1) END AS dependency_id
  FROM tasks_ev, (VALUES (0), (1)) s(slot)
  WHERE task_id > 3
  GROUP BY ALL)"""
)

CAND = """
cand_ev AS (
  SELECT event_id AS seq, user_id AS dependent_graph_id, event_id % (n + 2) AS dependent_id,
         CASE WHEN event_id % 11 = 0 THEN user_id + 1 ELSE user_id END AS dependency_graph_id,
         (event_id // 3) % (n + 2) AS dependency_id
  FROM events JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY 1) USING (user_id))"""

GRAPHS = """
all_graphs AS (
  SELECT dependent_graph_id AS graph_id FROM cand_ev
  UNION SELECT dependency_graph_id FROM cand_ev)"""

# Structural verdicts without frozen graphs; `frozen` puts one more test in front.
JUDGED = """
judged AS (
  SELECT c.*,
    CASE {frozen}
      WHEN dependent_id = 0 OR dependency_id = 0 THEN 'invalid_handle'
      WHEN dependent_graph_id <> dependency_graph_id THEN 'cross_graph'
      WHEN dependent_id = dependency_id THEN 'self'
      WHEN a.task_id IS NULL OR b.task_id IS NULL THEN 'missing'
      WHEN row_number() OVER (PARTITION BY dependent_graph_id, dependent_id, dependency_graph_id, dependency_id
                              ORDER BY c.seq) > 1 THEN 'repeat'
      ELSE 'ok' END AS verdict
  FROM cand_ev c
  LEFT JOIN tasks_ev a ON a.graph_id = dependent_graph_id AND a.task_id = dependent_id
  LEFT JOIN tasks_ev b ON b.graph_id = dependency_graph_id AND b.task_id = dependency_id)"""

GOOD = (
    TASKS
    + ","
    + CAND
    + ","
    + JUDGED.format(frozen="")
    + """,
good AS (
  SELECT dependent_graph_id AS graph_id, seq AS edge_seq, dependent_id, dependency_id
  FROM judged WHERE verdict = 'ok')"""
)

# Proper paths of at least one edge along dependencies in `good`.
PATHS = (
    GOOD
    + """,
paths AS (
  SELECT graph_id, dependent_id AS low, dependency_id AS high FROM good
  UNION
  SELECT p.graph_id, p.low, g.dependency_id
  FROM paths p JOIN good g ON g.graph_id = p.graph_id AND g.dependent_id = p.high),
on_cycle AS (SELECT graph_id, low AS task_id FROM paths WHERE low = high)"""
)

# Longest path by collecting all path lengths; acyclic input only.
LEVELS = (
    EDGES
    + """,
depths AS (
  SELECT graph_id, task_id, CAST(0 AS BIGINT) AS depth FROM tasks_ev
  UNION
  SELECT d.graph_id, e.dependent_id, d.depth + 1
  FROM depths d JOIN edges_ev e ON e.graph_id = d.graph_id AND e.dependency_id = d.task_id),
levels_ev AS (SELECT graph_id, task_id, max(depth) AS level FROM depths GROUP BY 1, 2)"""
)

# Within a level, order by (place of the last-visited dependency one level up, edge order).
FIFO = (
    LEVELS
    + """,
waves AS (
  SELECT graph_id, task_id, level, row_number() OVER (PARTITION BY graph_id ORDER BY seq) AS place
  FROM levels_ev JOIN tasks_ev USING (graph_id, task_id) WHERE level = 0
  UNION ALL
  SELECT graph_id, task_id, level, row_number() OVER (PARTITION BY graph_id ORDER BY key) AS place
  FROM (SELECT w.graph_id, l.task_id, l.level, max(w.place * 10000000000 + e.edge_seq) AS key
        FROM waves w
        JOIN edges_ev e ON e.graph_id = w.graph_id AND e.dependency_id = w.task_id
        JOIN levels_ev l ON l.graph_id = w.graph_id AND l.task_id = e.dependent_id AND l.level = w.level + 1
        GROUP BY 1, 2, 3)),
fifo AS (
  SELECT graph_id, task_id, level, row_number() OVER (PARTITION BY graph_id ORDER BY level, place) AS position
  FROM waves)"""
)

RUN = (
    FIFO
    + """,
stops AS (
  SELECT graph_id, min(position) AS stop FROM fifo JOIN tasks_ev USING (graph_id, task_id) WHERE failed GROUP BY 1),
run AS (
  SELECT f.*, t.failed, t.cost_us,
    CASE WHEN failed THEN 'task ' || task_id || ' failed' END AS error,
    CASE WHEN stop IS NULL OR position < stop THEN 'executed'
         WHEN position = stop THEN 'failed' ELSE 'not_started' END AS outcome
  FROM fifo f JOIN tasks_ev t USING (graph_id, task_id) LEFT JOIN stops USING (graph_id))"""
)

SUMMARY = (
    RUN
    + ","
    + CAND
    + ","
    + GRAPHS
    + """,
summary AS (
  SELECT graph_id,
    CASE WHEN total IS NULL THEN 'GraphNotFinalised' WHEN failures > 0 THEN 'TaskFailed'
         WHEN executed = total THEN 'Success' ELSE 'InvalidGraph' END AS status,
    CAST(coalesce(executed, 0) AS BIGINT) AS executed_task_count,
    error,
    CAST(coalesce(elapsed, 0) AS BIGINT) AS execution_time_us
  FROM all_graphs LEFT JOIN (
    SELECT graph_id, count(*) AS total, count(*) FILTER (outcome = 'executed') AS executed,
           count(*) FILTER (outcome = 'failed') AS failures,
           max(error) FILTER (outcome = 'failed') AS error,
           sum(cost_us) FILTER (outcome <> 'not_started') AS elapsed
    FROM run GROUP BY 1) USING (graph_id))"""
)

FRAMES = """
frames AS (
  SELECT vec_id AS frame_id, embedding AS positions, list_reverse(embedding) AS velocities FROM embeddings),
resources AS (
  SELECT doc_id % (SELECT count(*) FROM embeddings) AS frame_id, doc_id AS idx, n_chars AS size_bytes
  FROM documents),
uploads AS (
  SELECT frame_id, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS uploaded_bytes
  FROM frames LEFT JOIN resources USING (frame_id) GROUP BY 1)"""

MOVED = """list_transform(list_zip(positions, velocities),
    lambda z: CAST(z[1] + CAST(z[2] * CAST(1.0 / 60.0 AS FLOAT) AS FLOAT) AS FLOAT))"""

CULLED = "list_filter({xs}, lambda x: abs(x) <= CAST(0.1 AS FLOAT))"

FOLD = """list_reduce(list_transform({xs},
      lambda x: CAST(trunc(CAST(CAST(x + CAST(2 AS FLOAT) AS FLOAT) * CAST(1000 AS FLOAT) AS FLOAT)) AS HUGEINT)),
    lambda a, x: xor((a * 1099511628211) % 18446744073709551616, x), CAST({seed} AS HUGEINT))"""

EXPLODED = """SELECT frame_id, CAST(idx - 1 AS BIGINT) AS idx, CAST(xs[idx] AS DOUBLE) AS position
FROM (SELECT frame_id, {xs} AS xs FROM frames), LATERAL (SELECT unnest(range(1, len(xs) + 1)) AS idx)"""


def _with(ctes, select, recursive=False):
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}\n{select}"


PIPELINE = _with(
    FRAMES
    + f""",
seen AS (
  SELECT frame_id, uploaded_bytes, {CULLED.format(xs=MOVED)} AS visible
  FROM frames JOIN uploads USING (frame_id))""",
    f"""SELECT frame_id, len(visible) AS n_visible, uploaded_bytes,
  CAST(xor({FOLD.format(xs='visible', seed='uploaded_bytes')},
    CAST(len(visible) AS HUGEINT) * 4294967296) AS VARCHAR) AS presented_checksum{{more}}
FROM seen""",
)

# One offer per turn and graph; ``closed`` holds every (lo waits for hi) of the accepted edges.
ADMITTED = (
    GOOD
    + """,
offers AS (
  SELECT graph_id, dependent_id AS d, dependency_id AS p, row_number() OVER (PARTITION BY graph_id ORDER BY edge_seq) AS turn
  FROM good),
walk AS (
  SELECT DISTINCT graph_id, CAST(0 AS BIGINT) AS turn, CAST([] AS STRUCT(lo BIGINT, hi BIGINT)[]) AS closed,
    CAST(NULL AS BIGINT) AS d, CAST(NULL AS BIGINT) AS p, false AS refused
  FROM offers
  UNION ALL
  SELECT graph_id, turn,
    CASE WHEN refused THEN closed ELSE list_distinct(list_concat(closed, flatten(list_transform(
      list_append(list_transform(list_filter(closed, lambda c: c.hi = d), lambda c: c.lo), d),
      lambda x: list_transform(
        list_append(list_transform(list_filter(closed, lambda c: c.lo = p), lambda c: c.hi), p),
        lambda y: {'lo': x, 'hi': y}))))) END,
    d, p, refused
  FROM (SELECT w.graph_id, o.turn, w.closed, o.d, o.p, list_contains(w.closed, {'lo': o.p, 'hi': o.d}) AS refused
        FROM walk w JOIN offers o ON o.graph_id = w.graph_id AND o.turn = w.turn + 1)),
verdicts AS (
  SELECT j.seq, j.dependent_graph_id, j.dependent_id, j.dependency_graph_id, j.dependency_id,
    CASE WHEN j.verdict NOT IN ('ok', 'repeat') THEN j.verdict WHEN w.refused THEN 'cycle'
         WHEN j.verdict = 'repeat' THEN 'duplicate' ELSE 'ok' END AS verdict
  FROM judged j LEFT JOIN walk w
    ON w.graph_id = j.dependent_graph_id AND w.d = j.dependent_id AND w.p = j.dependency_id AND j.verdict IN ('ok', 'repeat'))"""
)

ORACLES = {
    "assign_ids": _with(TASKS, "SELECT graph_id, task_id, seq, name FROM tasks_ev"),
    "valid_handles": _with(
        CAND, "SELECT seq, dependent_graph_id, dependent_id FROM cand_ev WHERE dependent_id <> 0"
    ),
    "handle_key": _with(
        TASKS, "SELECT graph_id, task_id, graph_id * 4294967296 + task_id AS handle_key FROM tasks_ev"
    ),
    "lookup_tasks": _with(
        TASKS + "," + CAND,
        """SELECT c.seq AS offer, c.dependency_graph_id AS graph_id, c.dependency_id AS task_id, coalesce(t.seq, 0) AS seq, t.name,
  t.task_id IS NOT NULL AS found
FROM cand_ev c LEFT JOIN tasks_ev t ON t.graph_id = c.dependency_graph_id AND t.task_id = c.dependency_id""",
    ),
    "list_tasks": _with(TASKS, "SELECT graph_id, task_id, seq, name FROM tasks_ev ORDER BY graph_id, seq"),
    "task_counts": _with(
        TASKS + "," + CAND + "," + GRAPHS,
        """SELECT graph_id, count(task_id) AS task_count
FROM all_graphs LEFT JOIN tasks_ev USING (graph_id) GROUP BY 1""",
    ),
    "append_tasks": _with(
        TASKS,
        """SELECT user_id % 3 <> 0 AS accepted, user_id AS graph_id,
  CASE WHEN user_id % 3 <> 0 THEN top + row_number() OVER (PARTITION BY user_id ORDER BY event_id) ELSE 0 END AS task_id,
  event_id AS seq, event_type AS name
FROM events JOIN (SELECT graph_id, max(task_id) AS top FROM tasks_ev GROUP BY 1) ON graph_id = user_id
WHERE event_type = 'signup'""",
    ),
    "classify_edges": _with(
        TASKS + "," + CAND + "," + JUDGED.format(frozen="WHEN dependent_graph_id % 3 = 0 THEN 'finalised'"),
        "SELECT * FROM judged",
    ),
    "dedupe_edges": _with(
        CAND,
        """SELECT dependent_graph_id AS graph_id, min(seq) AS edge_seq, dependent_id, dependency_id
FROM cand_ev WHERE dependent_graph_id = dependency_graph_id GROUP BY ALL""",
    ),
    "adjacency": _with(
        EDGES,
        """SELECT graph_id, task_id, CAST(0 AS BIGINT) AS part,
  coalesce(i.ids, '') AS dependencies, coalesce(o.ids, '') AS dependents
FROM tasks_ev
LEFT JOIN (SELECT graph_id, dependent_id AS task_id, string_agg(dependency_id, ',' ORDER BY edge_seq) AS ids
           FROM edges_ev GROUP BY 1, 2) i USING (graph_id, task_id)
LEFT JOIN (SELECT graph_id, dependency_id AS task_id, string_agg(dependent_id, ',' ORDER BY edge_seq) AS ids
           FROM edges_ev GROUP BY 1, 2) o USING (graph_id, task_id)""",
    ),
    "degrees": _with(
        EDGES,
        """SELECT graph_id, task_id, coalesce(i.n, 0) AS n_dependencies, coalesce(o.n, 0) AS n_dependents
FROM tasks_ev
LEFT JOIN (SELECT graph_id, dependent_id AS task_id, count(*) AS n FROM edges_ev GROUP BY 1, 2) i
  USING (graph_id, task_id)
LEFT JOIN (SELECT graph_id, dependency_id AS task_id, count(*) AS n FROM edges_ev GROUP BY 1, 2) o
  USING (graph_id, task_id)""",
    ),
    "remove_edges": _with(
        EDGES, "SELECT graph_id, edge_seq, dependent_id, dependency_id FROM edges_ev WHERE edge_seq % 5 <> 0"
    ),
    "audit_links": _with(
        EDGES,
        """SELECT graph_id, dependent_id, dependency_id, 'dependent' AS side FROM edges_ev WHERE edge_seq % 7 = 0""",
    ),
    "reachable": _with(
        EDGES
        + """,
walk AS (
  SELECT graph_id, max(task_id) AS seed_id, max(task_id) AS task_id, CAST(0 AS BIGINT) AS hops
  FROM tasks_ev GROUP BY 1
  UNION
  SELECT w.graph_id, w.seed_id, e.dependency_id, w.hops + 1
  FROM walk w JOIN edges_ev e ON e.graph_id = w.graph_id AND e.dependent_id = w.task_id)""",
        "SELECT graph_id, seed_id, task_id, min(hops) AS hops FROM walk GROUP BY 1, 2, 3",
        True,
    ),
    "probe_cycles": _with(
        GOOD
        + EDGES.removeprefix(TASKS)
        + """,
up AS (
  SELECT DISTINCT graph_id, dependency_id AS start, dependency_id AS task_id FROM good
  UNION
  SELECT u.graph_id, u.start, e.dependency_id
  FROM up u JOIN edges_ev e ON e.graph_id = u.graph_id AND e.dependent_id = u.task_id)""",
        """SELECT g.*, u.task_id IS NOT NULL AS would_cycle
FROM good g LEFT JOIN up u
  ON u.graph_id = g.graph_id AND u.start = g.dependency_id AND u.task_id = g.dependent_id""",
        True,
    ),
    "cyclic_core": _with(
        PATHS
        + """,
below AS (  -- on a cycle, or waiting for one
  SELECT * FROM on_cycle
  UNION SELECT p.graph_id, p.low FROM paths p JOIN on_cycle c ON c.graph_id = p.graph_id AND c.task_id = p.high),
above AS (
  SELECT * FROM on_cycle
  UNION SELECT p.graph_id, p.high FROM paths p JOIN on_cycle c ON c.graph_id = p.graph_id AND c.task_id = p.low)""",
        """SELECT graph_id, task_id, b.task_id IS NOT NULL AS stuck,
  b.task_id IS NOT NULL AND a.task_id IS NOT NULL AS core
FROM tasks_ev t LEFT JOIN below b USING (graph_id, task_id) LEFT JOIN above a USING (graph_id, task_id)""",
        True,
    ),
    "cycle_members": _with(
        PATHS,
        """SELECT t.graph_id, t.task_id, least(t.task_id, min(b.low)) AS scc_id, count(b.low) > 0 AS in_cycle
FROM tasks_ev t
LEFT JOIN paths a ON a.graph_id = t.graph_id AND a.low = t.task_id
LEFT JOIN paths b ON b.graph_id = a.graph_id AND b.low = a.high AND b.high = a.low
GROUP BY 1, 2""",
        True,
    ),
    "admit_edges": _with(ADMITTED, "SELECT *, verdict = 'ok' AS accepted FROM verdicts", True),
    "roots_and_leaves": _with(
        EDGES,
        """SELECT graph_id, task_id,
  (graph_id, task_id) NOT IN (SELECT (graph_id, dependent_id) FROM edges_ev) AS is_root,
  (graph_id, task_id) NOT IN (SELECT (graph_id, dependency_id) FROM edges_ev) AS is_leaf
FROM tasks_ev""",
    ),
    "validate_graphs": _with(
        PATHS
        + ","
        + GRAPHS
        + """,
counts AS (
  SELECT t.graph_id, count(*) AS n,
    count(*) FILTER ((t.graph_id, t.task_id) NOT IN (SELECT (graph_id, dependent_id) FROM good)) AS n_roots
  FROM tasks_ev t GROUP BY 1),
reasons AS (
  SELECT graph_id,
    CASE WHEN n IS NULL THEN 'empty' WHEN n_roots = 0 THEN 'no_root'
         WHEN graph_id IN (SELECT graph_id FROM on_cycle) THEN 'cycle' ELSE 'ok' END AS reason
  FROM all_graphs LEFT JOIN counts USING (graph_id))""",
        """SELECT graph_id, graph_id % 3 = 0 OR reason = 'ok' AS finalised,
  CASE WHEN graph_id % 3 = 0 THEN 'ok' ELSE reason END AS reason
FROM reasons""",
        True,
    ),
    "levels": _with(LEVELS, "SELECT graph_id, task_id, level FROM levels_ev", True),
    "levels_one_graph": _with(
        """
links AS (
  SELECT DISTINCT k, p FROM (
    SELECT o_orderkey + 1 AS k, lag(o_orderkey + 1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p
    FROM orders
    UNION ALL
    SELECT o_orderkey + 1, (o_orderkey + 1) // 2 FROM orders WHERE o_orderkey > 0)
  WHERE p IS NOT NULL),
depths AS (
  SELECT o_orderkey + 1 AS task_id, CAST(0 AS BIGINT) AS depth FROM orders
  UNION
  SELECT k, depth + 1 FROM depths JOIN links ON p = task_id)""",
        "SELECT CAST(1 AS BIGINT) AS graph_id, task_id, max(depth) AS level FROM depths GROUP BY 2",
        True,
    ),
    "levels_chains": _with(
        """
links AS (
  SELECT DISTINCT k, p FROM (
    SELECT o_orderkey + 1 AS k, lag(o_orderkey + 1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p
    FROM orders
    UNION ALL
    SELECT o_orderkey + 1, (o_orderkey + 1) // 2 FROM orders WHERE (o_orderkey + 1) % 50 = 0)
  WHERE p IS NOT NULL),
depths AS (
  SELECT o_orderkey + 1 AS task_id, CAST(0 AS BIGINT) AS depth FROM orders
  UNION
  SELECT k, depth + 1 FROM depths JOIN links ON p = task_id)""",
        "SELECT CAST(1 AS BIGINT) AS graph_id, task_id, max(depth) AS level FROM depths GROUP BY 2",
        True,
    ),
    "fifo_order": _with(FIFO, "SELECT graph_id, task_id, level, position FROM fifo", True),
    "ready_tasks": _with(
        EDGES,
        """SELECT t.graph_id, t.task_id, count(d.task_id) AS remaining, count(d.task_id) = 0 AS ready
FROM tasks_ev t
LEFT JOIN edges_ev e ON e.graph_id = t.graph_id AND e.dependent_id = t.task_id
LEFT JOIN tasks_ev d ON d.graph_id = e.graph_id AND d.task_id = e.dependency_id AND d.ts >= TIMESTAMP '2024-01-15'
WHERE t.ts >= TIMESTAMP '2024-01-15'
GROUP BY 1, 2""",
    ),
    "run_outcome": _with(RUN, "SELECT graph_id, task_id, level, position, outcome FROM run", True),
    "run_summary": _with(SUMMARY, "SELECT * FROM summary", True),
    "run_timeline": _with(
        RUN,
        """SELECT graph_id, task_id, ends - cost_us AS start_us, ends AS end_us
FROM (SELECT *, CAST(sum(cost_us) OVER (PARTITION BY graph_id ORDER BY position) AS BIGINT) AS ends
      FROM run WHERE outcome = 'executed')""",
        True,
    ),
    "render_report": _with(
        SUMMARY,
        """SELECT graph_id, 'SchedulerResult{status=' || status || ', executedTaskCount=' || executed_task_count
  || ', executionTime=' || execution_time_us || 'micro(s), exception=' || coalesce(error, 'none') || '}' AS report
FROM summary""",
        True,
    ),
    "guarded_apply": _with(
        TASKS,
        """SELECT graph_id, CASE WHEN bool_or(failed) THEN 'TaskFailed' ELSE 'Success' END AS status,
  CASE WHEN NOT bool_or(failed) THEN CAST(sum(cost_us) AS BIGINT) ELSE 0 END AS cost_us,
  CASE WHEN bool_or(failed) THEN 'a task of this graph failed' END AS error
FROM tasks_ev GROUP BY 1""",
    ),
    "release_stream": _with(
        EDGES,
        """SELECT e.graph_id, e.dependent_id AS task_id, max(epoch_us(d.ts)) AS released_us
FROM edges_ev e JOIN tasks_ev d ON d.graph_id = e.graph_id AND d.task_id = e.dependency_id
GROUP BY 1, 2 HAVING NOT bool_or(d.failed)""",
    ),
    "run_progress_stream": _with(
        TASKS,
        """SELECT graph_id,
  count(*) FILTER (NOT failed AND (first_failure IS NULL OR ts < first_failure.ts OR (ts = first_failure.ts AND task_id < first_failure.t))) AS executed_task_count,
  CASE WHEN bool_or(failed) THEN 'TaskFailed' ELSE 'Success' END AS status
FROM (SELECT *, min({'ts': ts, 't': task_id}) FILTER (failed) OVER (PARTITION BY graph_id) AS first_failure FROM tasks_ev) GROUP BY 1""",
    ),
    "init_frames": """SELECT vec_id AS frame_id, CAST(0 AS BIGINT) AS n_visible, CAST(0 AS BIGINT) AS uploaded_bytes,
  '0' AS presented_checksum, true AS frame_prepared, false AS simulation_updated, false AS frame_presented
FROM embeddings""",
    "integrate": _with(FRAMES, EXPLODED.format(xs=MOVED)),
    "upload_total": _with(FRAMES, "SELECT frame_id, uploaded_bytes FROM uploads"),
    "cull": _with(FRAMES, EXPLODED.format(xs=CULLED.format(xs="positions"))),
    "rolling_checksum": _with(
        FRAMES,
        f"SELECT frame_id, CAST({FOLD.format(xs='positions', seed='frame_id')} AS VARCHAR) AS checksum FROM frames",
    ),
    "seal_frame": _with(
        FRAMES,
        f"""SELECT frame_id, CAST(xor({FOLD.format(xs='positions', seed='frame_id')},
    CAST(len(positions) AS HUGEINT) * 4294967296) AS VARCHAR) AS sealed
FROM frames""",
    ),
    "require_stage": _with(
        FRAMES,
        """SELECT frame_id, uploaded_bytes, CASE WHEN uploaded_bytes < 2000 THEN 'too little uploaded' END AS stage_error
FROM uploads""",
    ),
    "frame_pipeline": PIPELINE.format(more=", true AS frame_presented"),
    "object_pipeline": PIPELINE.format(more=""),
}

# The same questions, answered by the plan for large graphs.
for _name in ("reachable", "probe_cycles", "cyclic_core", "cycle_members", "fifo_order", "admit_edges"):
    ORACLES[f"{_name}_rounds"] = ORACLES[_name]
ORACLES["release_stream_delay"] = ORACLES["release_stream"]
