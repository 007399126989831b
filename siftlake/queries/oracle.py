"""SQL for DuckDB that gives the rows of queries on plain paths of their own."""

CANONICAL = r"rtrim(regexp_replace(url_decode(regexp_replace({0}, '^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?', '')), '/+', '/', 'g'), '/')"
PATH = CANONICAL.format("path")
SECS = "CASE WHEN modification_time < 100000000000 THEN modification_time ELSE modification_time // 1000 END"

BLOCKS = "(SELECT file_id, block_no, max(length) AS length, any_value(hosts) AS hosts FROM block_locations GROUP BY file_id, block_no)"
SIZES = f"""(SELECT s.file_id, coalesce(s.length, b.length) AS size
  FROM (SELECT file_id, max(length) AS length FROM file_status GROUP BY file_id) s
  LEFT JOIN (SELECT file_id, sum(length) AS length FROM {BLOCKS} GROUP BY file_id) b USING (file_id))"""
SMALL = f"""SELECT file_id, regexp_replace(p, '/[^/]*$', '') AS directory, size
  FROM (SELECT file_id, min({PATH}) AS p FROM file_status WHERE NOT is_dir GROUP BY file_id) JOIN {SIZES} USING (file_id)
  WHERE size < 16777216 AND NOT regexp_matches(p, '(^|/)[_.][^/=]*(/|$)')"""

LISTED = f"""SELECT dataset_id, snapshot_no, p, s, length FROM (
  SELECT *, row_number() OVER (PARTITION BY dataset_id, snapshot_no, p ORDER BY s DESC, length DESC NULLS LAST) AS r FROM (
    SELECT dataset_id, snapshot_no, {PATH} AS p, {SECS} AS s, length, delivery_no, max(delivery_no) OVER (PARTITION BY dataset_id, snapshot_no) AS m FROM snapshot_files)
  WHERE delivery_no = m) WHERE r = 1"""
CHANGES = f"""WITH l AS ({LISTED}),
  n AS (SELECT dataset_id, snapshot_no, lag(snapshot_no) OVER (PARTITION BY dataset_id ORDER BY snapshot_no) AS before FROM (SELECT DISTINCT dataset_id, snapshot_no FROM l)),
  a AS (SELECT l.*, n.before FROM l JOIN n USING (dataset_id, snapshot_no) WHERE n.before IS NOT NULL),
  b AS (SELECT l.dataset_id, n.snapshot_no, l.p, l.s, l.length FROM l JOIN n ON l.dataset_id = n.dataset_id AND l.snapshot_no = n.before)
SELECT coalesce(a.dataset_id, b.dataset_id) AS dataset_id, coalesce(a.snapshot_no, b.snapshot_no) AS snapshot_no, coalesce(a.p, b.p) AS path,
  CASE WHEN b.p IS NULL THEN 'added' WHEN a.p IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
FROM a FULL JOIN b ON a.dataset_id = b.dataset_id AND a.snapshot_no = b.snapshot_no AND a.p = b.p
WHERE a.p IS NULL OR b.p IS NULL OR a.s <> b.s OR a.length <> b.length"""

SEEN = f"""SELECT DISTINCT arrival_id, dataset_id, {PATH} AS p, length, {SECS} AS s, listed_at, loaded_at FROM file_arrivals"""
RUNS = "SELECT DISTINCT run_id, dataset_id, started_at FROM index_runs WHERE lower(outcome) = 'succeeded'"
STATES = f"""SELECT r.run_id, r.dataset_id, r.started_at, f.p, arg_max(f.arrival_id, f.listed_at) AS arrival_id, arg_max(f.length, f.listed_at) AS length, arg_max(f.s, f.listed_at) AS s
  FROM ({RUNS}) r JOIN ({SEEN}) f ON f.dataset_id = r.dataset_id AND f.loaded_at <= r.started_at GROUP BY ALL"""

CLAIMED = f"""SELECT f.dataset_id, f.arrival_id, f.seq, r.run_id FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY arrival_id) AS seq FROM ({SEEN})) f
  ASOF JOIN ({RUNS}) r ON f.dataset_id = r.dataset_id AND f.loaded_at <= r.started_at"""

HOST_KEY = r"regexp_replace(regexp_replace(lower(regexp_replace({0}, '^\s+|\s+$', '', 'g')), ':\d+$', ''), '\.$', '')"
HOSTS = f"""WITH e AS (SELECT file_id, {HOST_KEY.format("name")} AS name FROM (SELECT file_id, unnest(hosts) AS name FROM {BLOCKS})),
  h AS (SELECT DISTINCT host_id, {HOST_KEY.format("name")} AS name FROM (SELECT host_id, unnest([host_name, split_part(host_name, '.', 1), ip, alias]) AS name FROM cluster_hosts) WHERE name IS NOT NULL),
  p AS (SELECT host_id, file_id, count(*) AS n FROM e JOIN h USING (name) GROUP BY ALL)
SELECT host_id, sum(n) AS placements, CAST(sum(coalesce(size, 0)) AS BIGINT) AS bytes FROM p LEFT JOIN {SIZES} USING (file_id) GROUP BY host_id"""

SQL = {
    "p2_found": f"SELECT file_id FROM (SELECT file_id, count(*) OVER (PARTITION BY directory) AS n FROM ({SMALL})) WHERE n > 1",
    "p2_digest": f"""WITH s AS ({SMALL}), r AS (SELECT file_id, sum(row_count) AS n FROM (SELECT DISTINCT file_id, block_no, row_count FROM block_metadata) GROUP BY file_id)
SELECT directory, count(*) AS files, sum(size) AS bytes, sum(coalesce(n, 0)) AS row_count, CAST(greatest(1, ceil(sum(size) / 134217728)) AS BIGINT) AS outputs, true AS same_rows
FROM s LEFT JOIN r USING (file_id) GROUP BY directory HAVING count(*) > 1""",
    "p2_rewrite": "SELECT * FROM events",
    "p2_layout": "SELECT CAST(event_id % 4 AS INTEGER) AS bucket, 3 AS files, 0 AS overlaps FROM events GROUP BY ALL",
    "p3_found": CHANGES,
    "p3_counts": f"SELECT dataset_id, snapshot_no, change_kind, count(*) AS files FROM ({CHANGES}) GROUP BY ALL",
    "p4_found": f"""SELECT run_id, arrival_id FROM (SELECT *, lag(length) OVER w AS l0, lag(s) OVER w AS s0, row_number() OVER w AS r FROM ({STATES}) WINDOW w AS (PARTITION BY dataset_id, p ORDER BY started_at))
WHERE r = 1 OR l0 IS DISTINCT FROM length OR s0 IS DISTINCT FROM s""",
    "p4_intervals": f"""SELECT dataset_id, run_id, min(seq) AS first_seq, max(seq) AS last_seq FROM (
  SELECT *, seq - row_number() OVER (PARTITION BY dataset_id, run_id ORDER BY seq) AS island FROM ({CLAIMED})) GROUP BY dataset_id, run_id, island""",
    "p5_hosts": HOSTS,
    "p5_found": f"WITH l AS ({HOSTS}) SELECT host_id FROM l WHERE placements >= 0.02 * (SELECT sum(placements) FROM l) OR bytes >= 0.02 * (SELECT sum(bytes) FROM l)",
}
