"""The same results in DuckDB SQL over the given tables."""

from __future__ import annotations

LOGS = """logs AS (
SELECT event_id, ts AS "timestamp",
  CASE user_id % 3 WHEN 0 THEN 'freight-service' WHEN 1 THEN 'gate-service' ELSE 'exports-service' END AS project,
  concat('run-', lpad(CAST(user_id AS VARCHAR), 4, '0')) AS logid,
  CASE WHEN event_type='error' AND event_id % 10 = 0 THEN 'FATAL' WHEN event_type='error' THEN 'ERROR'
       WHEN event_type='purchase' THEN 'WARN' WHEN event_type='view' THEN 'DEBUG' ELSE 'INFO' END AS level,
  concat(event_type, ' ', props) AS message,
  CASE WHEN event_id % 10 = 7 THEN '' ELSE concat('handler.go:', CAST(user_id + 1 AS VARCHAR)) END AS caller
FROM events)"""
MANIFEST = LOGS + """, counted AS (
SELECT event_id // 250 AS k, project, count(*) AS n FROM logs GROUP BY 1, 2),
shares AS (SELECT k, string_agg(project || '=' || n, ',' ORDER BY project) AS project_rows
FROM counted GROUP BY k),
manifest AS (
SELECT concat('logs-', lpad(CAST(event_id // 250 AS VARCHAR), 6, '0'), '.parquet') AS file,
  min("timestamp") AS started, max("timestamp") AS ended, count(*) AS row_count,
  string_agg(DISTINCT project, ',' ORDER BY project) AS projects,
  CAST(sum(16 + strlen(project) + strlen(logid) + strlen(level) + strlen(message)) AS BIGINT) AS size_bytes,
  any_value(project_rows) AS project_rows
FROM logs JOIN shares ON k = event_id // 250 GROUP BY 1)"""
SIX = '"timestamp", project, logid, level, message, caller'
TIES = "project, logid, level, message, caller"
NOW = "TIMESTAMP '2024-01-31 00:00:00'"


def over_logs(text: str) -> str:
    return f"WITH {LOGS} {text}"


def over_manifest(text: str) -> str:
    return f"WITH {MANIFEST} {text}"


def page(where: str, limit: int, offset: int = 0, order: str = "DESC") -> str:
    return over_logs(f"""
SELECT (SELECT count(*) FROM logs WHERE {where}) AS count,
  CAST(rank - 1 - {offset} AS INTEGER) AS position, {SIX}
FROM (SELECT *, row_number() OVER (ORDER BY "timestamp" {order}, {TIES}) AS rank
      FROM logs WHERE {where})
WHERE rank > {offset} AND rank <= {offset + limit}""")


BILLING = (
    "project = 'freight-service' AND \"timestamp\" >= TIMESTAMP '2024-01-05 00:00:00'"
    " AND \"timestamp\" <= TIMESTAMP '2024-01-20 00:00:00'"
)

# What each replaced payload of the wire corpus decodes to: slot, timestamp (null
# where it is filled with NOW), project, level, message.
ACCEPTED = """accepted(slot, ts, project, level, message) AS (VALUES
(0, NULL, 'p', 'INFO', ''), (1, NULL, 'p', 'INFO', ''), (2, NULL, 'p', 'INFO', ''),
(6, TIMESTAMP '2026-09-06 10:11:12', 'p', 'INFO', ''),
(7, TIMESTAMP '2026-09-06 08:11:12', 'p', 'INFO', ''),
(8, TIMESTAMP '2026-09-06 10:11:12.123', 'p', 'INFO', ''),
(9, TIMESTAMP '2026-09-06 10:11:12.123456', 'p', 'INFO', ''),
(10, NULL, 'cs', 'INFO', ''), (11, NULL, 'q', 'INFO', ''), (12, NULL, 'p', 'INFO', ''),
(13, NULL, 'p', 'INFO', ''), (14, NULL, 'p', 'INFO', ''), (15, NULL, 'p', 'INFO', '] , " }'),
(16, NULL, 'p', 'VERBOSE', ''), (36, NULL, 'p', 'INFO', ''), (37, NULL, 'esc', 'INFO', ''))"""
REFUSED = """refused AS (
SELECT event_id, event_id % 97 AS slot,
  CASE WHEN event_id % 97 IN (31, 32, 33) THEN 'decode: project is required'
       WHEN event_id % 97 = 34 THEN 'decode: logid is required'
       WHEN event_id % 97 = 35 THEN 'decode: level is required'
       ELSE 'decode json' END AS reason
FROM logs WHERE event_id % 97 IN (3, 4, 5) OR event_id % 97 BETWEEN 17 AND 35)"""
PAYLOADS = """payloads(slot, value) AS (VALUES
(3, '{"project":"p","logid":"l","level":"INFO","timestamp":""}'),
(4, '{"project":"p","logid":"l","level":"INFO","timestamp":"2026-09-06"}'),
(5, '{"project":"p","logid":"l","level":"INFO","timestamp":1756944000}'),
(17, 'not-json'), (18, ''), (19, NULL), (20, '5'), (21, '"x"'), (22, '[1]'),
(23, '{"project":"p","logid":"l","level":"INFO"'),
(24, '{''project'':''p'',''logid'':''l'',''level'':''INFO''}'),
(25, '{"project":"p","logid":"l","level":"INFO"} x'),
(26, '{"project":"p","logid":"l","level":"INFO"},{"project":"p","logid":"l","level":"INFO"}'),
(27, '{"project":"p","logid":"l","level":"INFO"}]'),
(28, '{"project":"p","logid":"l","level":"INFO"}}'),
(29, '{"project":"p","logid":"l","level":"INFO"}],[{"project":"p","logid":"l","level":"INFO"}'),
(30, '{"project":5,"logid":"l","level":"INFO"}'),
(31, 'null'), (32, '{"logid":"l","level":"INFO"}'),
(33, '{"project":"","logid":"l","level":"INFO"}'),
(34, '{"project":"p","level":"INFO"}'), (35, '{"project":"p","logid":"l"}'))"""


def greedy(target: int, day: str = "''", where: str = "TRUE") -> str:
    """The batches of the files in name order, one file after another."""
    return f"""WITH RECURSIVE {MANIFEST},
files AS (SELECT file, size_bytes, {day} AS key, row_number() OVER (ORDER BY {day}, file) AS n
          FROM manifest WHERE {where}),
fold AS (
  SELECT n, file, size_bytes, key, CAST(size_bytes AS BIGINT) AS held, CAST(0 AS BIGINT) AS batch
  FROM files WHERE n = 1
  UNION ALL
  SELECT f.n, f.file, f.size_bytes, f.key,
    CASE WHEN fold.held >= {target} OR f.key <> fold.key THEN f.size_bytes
         ELSE fold.held + f.size_bytes END,
    CASE WHEN fold.held >= {target} OR f.key <> fold.key THEN fold.batch + 1 ELSE fold.batch END
  FROM fold JOIN files f ON f.n = fold.n + 1),
batches AS (SELECT file, size_bytes, batch FROM fold
            QUALIFY count(*) OVER (PARTITION BY batch) >= 2)"""


TOTALS = """min("timestamp") AS started, max("timestamp") AS ended, count(*) AS row_count,
  string_agg(DISTINCT project, ',' ORDER BY project) AS projects"""


ORACLES: dict[str, str] = {
    "project_filter": over_logs(f"SELECT {SIX} FROM logs WHERE project = 'freight-service'"),
    "logid_filter": over_logs(f"SELECT {SIX} FROM logs WHERE logid = 'run-0007'"),
    "level_filter": over_logs(f"SELECT {SIX} FROM logs WHERE level = 'ERROR'"),
    "min_level": over_logs(f"SELECT {SIX} FROM logs WHERE level IN ('WARN','ERROR','FATAL')"),
    "time_range": over_logs(
        f"SELECT {SIX} FROM logs WHERE \"timestamp\" BETWEEN TIMESTAMP '2024-01-05 00:00:00'"
        " AND TIMESTAMP '2024-01-06 00:00:00'"
    ),
    "time_range_exact_ends": over_logs(
        f"SELECT {SIX} FROM logs WHERE event_id BETWEEN 100 AND 300"
    ),
    "preset_counts": over_logs(f"""
SELECT p.preset, count(l."timestamp") AS matches
FROM (VALUES ('15m', 15), ('1h', 60), ('6h', 360), ('24h', 1440), ('72h', 4320)) p(preset, minutes)
LEFT JOIN logs l ON l."timestamp" BETWEEN {NOW} - to_minutes(p.minutes) AND {NOW}
GROUP BY p.preset"""),
    "lookup_newest": page(BILLING, 100),
    "lookup_oldest_first": page("project = 'gate-service'", 1000, order="ASC"),
    "lookup_logid_level": page("logid = 'run-0011' AND level = 'INFO'", 100),
    "lookup_offset": page("project = 'exports-service'", 50, 120),
    "lookup_past_end": over_logs(
        "SELECT count(*) AS count, CAST(0 AS INTEGER) AS returned FROM logs"
        " WHERE project = 'freight-service'"
    ),
    "lookup_no_match": over_logs(
        "SELECT count(*) AS count, CAST(0 AS INTEGER) AS returned FROM logs"
        " WHERE logid = 'no-such-id'"
    ),
    "ordered_rows": over_logs(f'SELECT {SIX} FROM logs ORDER BY "timestamp" DESC, {TIES}'),
    "deep_page": over_logs(f"""
SELECT {SIX} FROM logs WHERE project = 'freight-service'
ORDER BY "timestamp" DESC, {TIES} LIMIT 40 OFFSET 2500"""),
    "walk_pages": over_logs(f"""
SELECT CAST((rank - 1) // 200 AS INTEGER) AS page, {SIX}
FROM (SELECT *, row_number() OVER (ORDER BY "timestamp" DESC, {TIES}) AS rank
      FROM logs WHERE project = 'freight-service')"""),
    "live_tail": over_logs(f"""
SELECT {SIX}, CAST(row_number() OVER w AS INTEGER) AS position FROM logs
WINDOW w AS (PARTITION BY project ORDER BY "timestamp" DESC, {TIES})
QUALIFY row_number() OVER w <= 10"""),
    "stream_live_tail": over_logs(f"""
SELECT {SIX}, CAST(row_number() OVER w AS INTEGER) AS position FROM logs
WINDOW w AS (PARTITION BY project ORDER BY "timestamp" DESC, {TIES})
QUALIFY row_number() OVER w <= 10"""),
    "stream_merge_unique": over_logs(f"""
SELECT {SIX} FROM logs QUALIFY row_number() OVER (
  PARTITION BY "timestamp", project, logid, message ORDER BY event_id) = 1"""),
    "ingest_file_sizes": over_logs(
        "SELECT count(*) AS rows, CAST(0 AS BIGINT) AS above, true AS mostly_full, count(*) AS listed FROM logs"
    ),
    "live_tail_by_logid": over_logs(f"""
SELECT {SIX}, CAST(row_number() OVER w AS INTEGER) AS position FROM logs
WINDOW w AS (PARTITION BY logid ORDER BY "timestamp" DESC, {TIES})
QUALIFY row_number() OVER w <= 3"""),
    "union_sources": over_logs("""
SELECT "timestamp", project, logid, level, message,
  CASE WHEN "timestamp" < TIMESTAMP '2024-01-20 00:00:00' THEN '' ELSE caller END AS caller
FROM logs"""),
    "merge_unique": over_logs(f"""
, doubled AS (SELECT *, 0 AS source FROM logs UNION ALL SELECT *, 2 FROM logs UNION ALL
SELECT event_id, "timestamp", project, logid, 'OTHER', message, caller, 1 FROM logs WHERE event_id % 20 = 0)
SELECT {SIX} FROM doubled QUALIFY row_number() OVER (
  PARTITION BY "timestamp", project, logid, message ORDER BY source, event_id) = 1"""),
    "reconcile": over_logs("""
, got AS (
  SELECT 'project' AS kind, project AS name, count(*) AS got FROM logs GROUP BY project
  UNION ALL SELECT 'logid', logid, count(*) FROM logs GROUP BY logid
  UNION ALL SELECT 'total', '', count(*) FROM logs),
wanted AS (
  SELECT 'project' AS kind, project AS name,
    (SELECT count(*) // count(DISTINCT project) FROM logs) AS want FROM logs GROUP BY project
  UNION ALL SELECT 'logid', logid, (SELECT count(*) // count(DISTINCT logid) FROM logs)
    FROM logs GROUP BY logid
  UNION ALL SELECT 'project', 'absent-service', 1)
SELECT kind, name, coalesce(want, 0) AS want, coalesce(got, 0) AS got,
  coalesce(got, 0) < coalesce(want, 0) AS short
FROM got FULL JOIN wanted USING (kind, name)"""),
    "volume": over_logs("""
SELECT project, strftime("timestamp", '%Y-%m-%d') AS day, level, count(*) AS rows,
  CAST(sum(16 + strlen(project) + strlen(logid) + strlen(level) + strlen(message)) AS BIGINT) AS bytes
FROM logs GROUP BY ALL"""),
    "age_histogram": over_logs("""
, aged AS (SELECT project, greatest(epoch_us(TIMESTAMP '2024-01-30 12:00:00')
  - epoch_us("timestamp"), 0) // 1000000 AS s FROM logs)
SELECT project,
  CASE WHEN s < 60 THEN 's' WHEN s < 3600 THEN 'm' WHEN s < 86400 THEN 'h' ELSE 'd' END AS unit,
  CASE WHEN s < 60 THEN s WHEN s < 3600 THEN s // 60 WHEN s < 86400 THEN s // 3600
       ELSE s // 86400 END AS age, count(*) AS rows
FROM aged GROUP BY ALL"""),
    "distinct_projects": over_logs("""
SELECT level, coalesce(string_agg(DISTINCT project, ',' ORDER BY project)
  FILTER (WHERE caller <> ''), '') AS projects FROM logs GROUP BY level"""),
    "enrich": over_logs(f"""
SELECT {SIX},
  CAST(CASE level WHEN 'DEBUG' THEN 0 WHEN 'INFO' THEN 1 WHEN 'WARN' THEN 2
       WHEN 'ERROR' THEN 3 ELSE 4 END AS INTEGER) AS level_no,
  CAST(NULL AS TIMESTAMP) AS logid_minute,
  CASE WHEN caller <> '' THEN split_part(caller, ':', 1) END AS caller_file,
  CAST(CASE WHEN caller <> '' THEN split_part(caller, ':', 2) ELSE '-1' END AS INTEGER) AS caller_line
FROM logs"""),
    "level_functions": """
WITH e AS (SELECT event_id, user_id % 70 AS n,
  CASE WHEN event_id % 3 = 0 THEN upper(event_type) ELSE event_type END AS t FROM events)
SELECT event_id,
  CAST(CASE t WHEN 'ERROR' THEN 3 ELSE 1 END AS INTEGER) AS ordinal,
  CASE n - 2 WHEN 0 THEN 'DEBUG' WHEN 1 THEN 'INFO' WHEN 2 THEN 'WARN' WHEN 3 THEN 'ERROR'
    WHEN 4 THEN 'FATAL' ELSE 'INFO' END AS name,
  CASE t WHEN 'ERROR' THEN 'ERROR' ELSE 'INFO' END AS level, t = 'ERROR' AS ok,
  CASE n WHEN 10 THEN 'DEBUG' WHEN 20 THEN 'INFO' WHEN 30 THEN 'WARN' WHEN 40 THEN 'ERROR'
    WHEN 50 THEN 'FATAL' ELSE 'INFO' END AS from_python,
  CASE WHEN n >= 18 THEN 'ERROR' WHEN n >= 14 THEN 'WARN' WHEN n >= 10 THEN 'INFO'
    ELSE 'DEBUG' END AS from_slog
FROM e""",
    "default_logids": over_logs("""
SELECT event_id, CASE WHEN event_id % 3 = 1 THEN logid ELSE '-' END AS go_logid,
  CASE WHEN event_id % 3 = 1 THEN logid ELSE 'unknown' END AS python_logid FROM logs"""),
    "logid_minutes": over_logs("""
SELECT event_id,
  CASE WHEN event_id % 5 = 0 THEN logid ELSE strftime("timestamp", '%Y%m%d-%H%M-') END AS head,
  CAST(CASE WHEN event_id % 5 = 0 THEN length(logid) ELSE 20 END AS INTEGER) AS width,
  CASE WHEN event_id % 5 <> 0 THEN date_trunc('minute', "timestamp") END AS minute
FROM logs"""),
    "wire_decode": over_logs(f"""
, {ACCEPTED}
SELECT event_id, {SIX} FROM logs WHERE event_id % 97 > 37
UNION ALL
SELECT event_id, coalesce(a.ts, {NOW}), a.project, 'l', a.level, a.message, ''
FROM logs JOIN accepted a ON a.slot = event_id % 97"""),
    "dead_letters": over_logs(f"""
, {REFUSED}, {PAYLOADS}
SELECT event_id, value, reason FROM refused JOIN payloads USING (slot)"""),
    "ingest_stats": over_logs(f"""
, {REFUSED}
SELECT coalesce(reason, 'decoded') AS outcome, count(*) AS records
FROM logs LEFT JOIN refused USING (event_id) GROUP BY 1"""),
    "backfill_timestamp": over_logs(f"""
SELECT event_id, CASE WHEN event_id % 4 < 2 THEN {NOW} ELSE "timestamp" END AS "timestamp",
  {TIES} FROM logs"""),
    "wire_round_trip": over_logs(f"SELECT {SIX} FROM logs"),
    "wire_round_trip_documents": """
SELECT TIMESTAMP '2024-01-01 00:00:00' AS "timestamp", source AS project,
  CAST(doc_id AS VARCHAR) AS logid, 'INFO' AS level, text AS message, lang AS caller
FROM documents""",
    "stream_ingest": over_logs(f"SELECT {SIX} FROM logs"),
    "stream_dead_letters": over_logs("""
SELECT concat('junk ', project) AS value, 'decode json' AS reason, count(*) AS records
FROM logs WHERE event_id % 50 = 0 GROUP BY 1"""),
    "read_old_layout": over_logs("""
SELECT "timestamp", project, logid, level, message,
  CASE WHEN level = 'DEBUG' THEN '' ELSE caller END AS caller FROM logs"""),
    "read_beside_corrupt": over_logs(f"SELECT {SIX} FROM logs"),
    "read_nanoseconds": over_logs(f"SELECT {SIX} FROM logs"),
    "build_manifest": over_manifest("SELECT * FROM manifest"),
    "list_files": over_manifest("SELECT * FROM manifest ORDER BY started DESC, file"),
    "list_projects": over_logs("SELECT DISTINCT project FROM logs ORDER BY project"),
    "suggest_projects": over_logs(
        "SELECT DISTINCT project FROM logs WHERE contains(lower(project), 'rts-serv')"
    ),
    "prune_files": over_manifest("""
SELECT file, row_count FROM manifest
WHERE contains(projects, 'freight-service') AND ended >= TIMESTAMP '2024-01-05 00:00:00'
  AND started <= TIMESTAMP '2024-01-06 00:00:00'"""),
    "audit_manifest": over_manifest("""
, listed AS (SELECT file FROM manifest WHERE day(started) > 3),
present AS (SELECT file FROM manifest WHERE (contains(projects, 'freight-service')
  OR contains(projects, 'exports-service')) AND NOT ends_with(file, '7.parquet'))
SELECT file, 'orphan_manifest' AS finding FROM listed WHERE file NOT IN (FROM present)
UNION ALL SELECT file, 'unindexed_file' FROM present WHERE file NOT IN (FROM listed)"""),
    "table_rows": over_logs(f"SELECT {SIX} FROM logs"),
    "table_total": over_logs("""
SELECT 'window' AS asked, count(*) AS count FROM logs WHERE project = 'freight-service'
  AND "timestamp" BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-06 00:00:00'
UNION ALL SELECT 'project', count(*) FROM logs WHERE project = 'freight-service'
UNION ALL SELECT 'logid', count(*) FROM logs WHERE logid = 'run-0007'
UNION ALL SELECT 'absent', 0"""),
    "table_walk": over_logs(f"""
SELECT CAST((rank - 1) // 200 AS INTEGER) AS page, {SIX}
FROM (SELECT *, row_number() OVER (ORDER BY "timestamp" DESC, {TIES}) AS rank
      FROM logs WHERE {BILLING})"""),
    "table_manifest_totals": over_logs(f"SELECT {TOTALS} FROM logs"),
    "table_lookup": page(BILLING, 100),
    "table_pruned_rows": over_logs(
        f"SELECT {SIX} FROM logs WHERE project = 'freight-service' AND \"timestamp\""
        " BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-06 00:00:00'"
    ),
    "lookup_damaged": over_logs(
        "SELECT count(*) AS count, CAST(1 AS INTEGER) AS skipped_files FROM logs"
        " WHERE project = 'freight-service' AND level <> 'ERROR'"
    ),
    "read_many_files": over_logs(f"SELECT {SIX} FROM logs"),
    "retention_freed": over_logs(
        "SELECT count(*) AS rows_left, CAST(0 AS INTEGER) AS unlisted_files FROM logs"
        f" WHERE \"timestamp\" > {NOW} - INTERVAL 14 DAY"
    ),
    "table_audit": over_logs(
        "SELECT 'unindexed_file' AS finding, TRUE AS found, CAST(count(*) AS INTEGER) AS rows"
        " FROM logs"
    ),
    "retention_plan": over_manifest(f"""
SELECT file, row_count, ended FROM manifest
WHERE ended <= {NOW} - INTERVAL 14 DAY AND file <> 'logs-000003.parquet'"""),
    "retention_totals": over_manifest(f"""
SELECT count(*) AS scanned, count(*) FILTER (WHERE old) AS deleted, CAST(0 AS BIGINT) AS skipped,
  CAST(coalesce(sum(size_bytes) FILTER (WHERE old), 0) AS BIGINT) AS bytes_freed
FROM (SELECT *, ended <= {NOW} - INTERVAL 14 DAY AS old FROM manifest)"""),
    "retention_applied": over_logs(
        f'SELECT {SIX} FROM logs WHERE "timestamp" > {NOW} - INTERVAL 14 DAY'
    ),
    "compaction_candidate_files": over_manifest("""
SELECT file, size_bytes FROM manifest
WHERE size_bytes <= 14480 AND file <> 'logs-000002.parquet'"""),
    "compaction_plan": greedy(60_000) + " SELECT * FROM batches",
    "compaction_plan_in_blocks": greedy(60_000) + " SELECT * FROM batches",
    "compaction_plan_by_day": greedy(25_000, "CAST(CAST(started AS DATE) AS VARCHAR)")
    + " SELECT * FROM batches",
    "compaction_totals": greedy(60_000, where="size_bytes <= 14480") + """
SELECT (SELECT count(*) FROM manifest) AS scanned, count(DISTINCT batch) AS merged,
  count(*) AS source_files, CAST(coalesce(sum(b.size_bytes), 0) AS BIGINT) AS bytes_freed,
  CAST(coalesce(sum(m.row_count), 0) AS BIGINT) AS rows,
  (SELECT count(*) FROM manifest WHERE size_bytes > 14480) AS skipped
FROM batches b JOIN manifest m USING (file)""",
    "compacted_rows": over_logs(f"SELECT {SIX} FROM logs"),
    "compacted_manifest_totals": over_logs(f"SELECT {TOTALS} FROM logs"),
}
