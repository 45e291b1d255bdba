"""DuckDB SQL for the registered queries, over the same tables."""

from __future__ import annotations

from jobtally.functions.vocabulary import DEFAULT_OPERATIONS, LONG_BY_SHORT, LONG_NAMES, SHORT_BY_LONG
from jobtally.plans.queries import END, IDS, JOB, PIVOT_OPS, START
from jobtally.plans.report import DIFF_LABEL, PEAK_JOBS_LABEL, PEAK_OPS_LABEL, RATE_LABEL, RATE_TOTAL_LABEL, TOTAL_LABEL

KNOWN = ", ".join(f"'{name}'" for name in LONG_NAMES)
NINE = ", ".join(f"'{name}'" for name in DEFAULT_OPERATIONS)
EXACT = ", ".join(f"'{job}'" for job in IDS)
NINE_ROWS = ", ".join(f"('{name}')" for name in DEFAULT_OPERATIONS)

SAMPLES = f"""
ev AS (
  SELECT CAST(extract(day FROM ts) - 1 AS BIGINT) AS poll, user_id,
         concat('exe', user_id % 4, '.', user_id % 25, '.n', user_id) AS job_id,
         CASE event_type WHEN 'click' THEN 'open' WHEN 'view' THEN 'read' WHEN 'purchase' THEN 'write'
              WHEN 'error' THEN 'close' ELSE CASE WHEN user_id % 7 = 0 THEN 'mystery_op' ELSE 'getattr' END END AS operation,
         event_id % 3 AS host_no, 10 + event_id % 90 AS w
  FROM events),
byp AS (SELECT poll, user_id, job_id, operation, host_no, CAST(sum(w) AS BIGINT) AS n
        FROM ev GROUP BY poll, user_id, job_id, operation, host_no),
k AS (SELECT user_id, job_id, operation, host_no, min(poll) AS p0 FROM byp GROUP BY user_id, job_id, operation, host_no),
polls AS (SELECT DISTINCT poll, CAST({START} + poll * 10 AS BIGINT) AS poll_ts FROM ev),
g AS (SELECT k.user_id, k.job_id, k.operation, k.host_no, p.poll,
             CASE WHEN k.user_id % 10 = 0 AND p.poll >= 15 THEN 1 ELSE 0 END AS era
      FROM k JOIN polls p ON p.poll >= k.p0),
c AS (SELECT g.poll, g.user_id, g.job_id, g.operation, g.host_no,
             CAST(sum(coalesce(b.n, 0)) OVER (PARTITION BY g.job_id, g.operation, g.host_no, g.era ORDER BY g.poll) AS BIGINT) AS samples
      FROM g LEFT JOIN byp b ON b.poll = g.poll AND b.job_id = g.job_id AND b.operation = g.operation AND b.host_no = g.host_no),
samples AS (
  SELECT poll, CAST({START} + poll * 10 AS BIGINT) AS poll_ts, concat('oss', host_no) AS host,
         concat(CASE WHEN operation IN ('read', 'write') THEN 'obdfilter.fs-OST000' ELSE 'mdt.fs-MDT000' END, host_no, '.job_stats') AS param,
         job_id, CAST({START} + poll * 10 + host_no AS BIGINT) AS snapshot_time,
         CAST({START} - user_id % 50 AS BIGINT) AS start_time,
         CAST(poll * 10 + host_no + user_id % 50 AS BIGINT) AS elapsed_time,
         operation, samples
  FROM c
  WHERE poll <> 20 AND (user_id + poll) % 11 <> 0 AND NOT (operation = 'getattr' AND poll % 5 = 4))"""

BYTES = """
sb AS (
  SELECT poll, poll_ts, host, param, job_id, snapshot_time, start_time, elapsed_time, operation, samples,
         'reqs' AS unit, CAST(0 AS BIGINT) AS "min", CAST(0 AS BIGINT) AS "max", CAST(0 AS BIGINT) AS "sum" FROM samples
  UNION ALL
  SELECT poll, poll_ts, host, param, job_id, snapshot_time, start_time, elapsed_time, concat(operation, '_bytes'), samples,
         'bytes', 4096, 1048576, samples * 65536 FROM samples WHERE operation IN ('read', 'write')
  UNION ALL
  SELECT DISTINCT poll, poll_ts, host, concat('mdt.fs-MDT000', right(host, 1), '.job_stats'), job_id, snapshot_time,
         start_time, elapsed_time, 'statfs', CAST(0 AS BIGINT), 'reqs', 0, 0, 0 FROM samples)"""

MERGED = """
m AS (SELECT poll, poll_ts, job_id, operation, CAST(sum(samples) AS BIGINT) AS value
      FROM samples WHERE samples <> 0 GROUP BY poll, poll_ts, job_id, operation),
o AS (SELECT * FROM m UNION ALL
      SELECT poll, poll_ts, job_id, 'ops', CAST(sum(value) AS BIGINT) FROM m GROUP BY poll, poll_ts, job_id),
points AS (SELECT poll_ts AS "timestamp", job_id, operation, value FROM o)"""

TIMES = """
t AS (SELECT poll, poll_ts, job_id, max(snapshot_time) AS s, max(start_time) AS b, max(elapsed_time) AS e
      FROM samples GROUP BY poll, poll_ts, job_id)"""


def _changes(value: str, source: str = "o", times: str = "t") -> str:
    return f"""(SELECT tc.poll, tc.poll_ts, p.job_id, p.operation, CAST({value} AS BIGINT) AS value, tc.s - tp.s AS sampling_window
  FROM {source} p
  JOIN {times} tp ON tp.poll = p.poll AND tp.job_id = p.job_id
  JOIN {times} tc ON tc.poll = p.poll + 1 AND tc.job_id = p.job_id
  LEFT JOIN {source} c ON c.poll = tc.poll AND c.job_id = p.job_id AND c.operation = p.operation
  WHERE tc.s > tp.s AND p.operation IN ({KNOWN}))"""


DIFF = "greatest(coalesce(c.value, 0) - p.value, 0)"
RATE = f"{DIFF} // (tc.s - tp.s)"
RATES = f"\nr AS {_changes(RATE)}"
DIFFS = f"\nd AS {_changes(DIFF)}"
TOTALS = f"""
tot AS (SELECT poll, poll_ts, operation, CAST(sum(value) AS BIGINT) AS value
        FROM o WHERE operation IN ({KNOWN}) GROUP BY poll, poll_ts, operation)"""
STATE = f"""
st AS (SELECT poll, job_id, operation, value FROM o WHERE job_id LIKE '%exe1%'),
top AS (SELECT * FROM (SELECT poll, job_id, CAST(sum(value) AS BIGINT) AS total,
          CAST(row_number() OVER (PARTITION BY poll ORDER BY sum(value) DESC, job_id) AS BIGINT) AS rank
          FROM st WHERE operation IN ({NINE}) GROUP BY poll, job_id HAVING sum(value) > 0) WHERE rank <= 10),
last_top AS (SELECT job_id FROM top WHERE poll = (SELECT max(poll) FROM top))"""


def _with(*ctes: str) -> str:
    return "WITH " + ",".join((SAMPLES, *ctes)) + "\n"


_M = _with(MERGED)
_R = _with(MERGED, TIMES, RATES)
_TOT = _with(MERGED, TOTALS)
_OPS = _M + "SELECT poll, job_id, operation, value FROM o WHERE "


def _grouped(part: int) -> str:
    return f"""
gm AS (SELECT poll, concat('"', split_part(job_id, '.', {part}), '"') AS job_id, operation, CAST(sum(samples) AS BIGINT) AS value
       FROM samples WHERE samples <> 0 GROUP BY ALL),
go AS (SELECT * FROM gm UNION ALL SELECT poll, job_id, 'ops', CAST(sum(value) AS BIGINT) FROM gm GROUP BY poll, job_id),
gt AS (SELECT poll, poll_ts, concat('"', split_part(job_id, '.', {part}), '"') AS job_id, max(snapshot_time) AS s
       FROM samples GROUP BY ALL)"""


def _wide(source: str, keys: str, names: list[str]) -> str:
    cells = ", ".join(f"max(CASE WHEN operation = '{n}' THEN value END) AS \"{n}\"" for n in names)
    return f"(SELECT {keys}, {cells} FROM {source} GROUP BY {keys})"


def _top(source: str, sort: str, columns: str, where: str, first: int, last: int) -> str:
    keys = "poll, job_id, sampling_window" if source == "r" else "poll, job_id"
    wide = _wide(source, keys, ["ops", "write"])
    return f"""SELECT poll, rank, job_id, {columns} FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY poll ORDER BY coalesce({sort}, 0) DESC, job_id) AS BIGINT) AS rank
  FROM {wide} WHERE {where}) WHERE rank BETWEEN {first} AND {last}"""


def _series_rate(source: str, keys: str) -> str:
    return f"""SELECT {keys}, "timestamp", CAST(greatest(value - pv, 0) // (ts - pt) AS BIGINT) AS value FROM (
  SELECT {keys}, "timestamp", "timestamp" AS ts, value, lag(value) OVER w AS pv, lag("timestamp") OVER w AS pt
  FROM {source} WINDOW w AS (PARTITION BY {keys} ORDER BY "timestamp")) WHERE pt < ts"""


_OPSER = """
os AS (SELECT operation, "timestamp", CAST(sum(value) AS BIGINT) AS value FROM points GROUP BY operation, "timestamp")"""
_LAST = """SELECT {keys}, CAST(coalesce(max(CASE WHEN n = 1 THEN rate END), 0) AS BIGINT) AS value FROM (
  SELECT {keys}, rate, row_number() OVER (PARTITION BY {keys} ORDER BY rate IS NULL, "timestamp" DESC) AS n FROM (
    SELECT {keys}, "timestamp", greatest(value - lag(value) OVER w, 0) // ("timestamp" - lag("timestamp") OVER w) AS rate
    FROM {source} WHERE "timestamp" BETWEEN {low} AND {high} WINDOW w AS (PARTITION BY {keys} ORDER BY "timestamp")))
  GROUP BY {keys}"""
_SHORT = " ".join(f"WHEN '{long}' THEN '{short}'" for long, short in SHORT_BY_LONG.items())
_LONG = " ".join(f"WHEN '{short}' THEN '{long}'" for short, long in LONG_BY_SHORT.items())
_MATCH = "(contains(job_id, 'exe1') OR contains(job_id, '.3.'))"
_QUOTED = """SELECT "timestamp", concat('"', job_id, '"') AS job_id, operation, value FROM points"""
_BY = "GROUP BY poll, job_id, operation"
_OF_TOP = f""" "timestamp" >= {START + 100} AND operation IN ({NINE}) AND job_id IN (SELECT job_id FROM last_top)"""
_FRAMES = """, f AS (SELECT unnest(range((SELECT min("timestamp") FROM points),
              (SELECT max("timestamp") FROM points) + 1, 25)) AS frame)
            SELECT frame, job_id, operation, value FROM (SELECT f.frame, p.job_id, p.operation, p.value, row_number() OVER (
              PARTITION BY f.frame, p.job_id, p.operation ORDER BY p."timestamp" DESC) AS n
              FROM f JOIN points p ON p."timestamp" <= f.frame) WHERE n = 1"""


def oracle_sql() -> dict[str, str]:
    window = lambda low, high: f'SELECT * FROM points WHERE "timestamp" BETWEEN {low} AND {high}'
    return {
        "parse_job_stats": _with(BYTES) + """SELECT host, param, poll_ts, job_id, snapshot_time, start_time, elapsed_time,
            operation, samples, unit, "min", "max", "sum" FROM sb""",
        "parse_histogram": _with(BYTES) + """SELECT poll_ts, host, job_id, operation, '64K' AS bucket, samples AS "count"
            FROM sb WHERE unit = 'bytes'""",
        "parse_messy_dumps": _with() + """SELECT poll_ts, host, param, job_id, operation,
            CASE WHEN left(job_id, 4) IN ('exe0', 'exe1') THEN samples ELSE 0 END AS samples,
            CASE left(job_id, 4) WHEN 'exe1' THEN 'bytes' WHEN 'exe3' THEN '' ELSE 'reqs' END AS unit,
            CASE left(job_id, 4) WHEN 'exe1' THEN concat('4K=1,8K=', samples) ELSE '' END AS buckets FROM samples""",
        "parse_flat_blocks": _M + "SELECT * FROM points",
        "raw_log_frames": _with(BYTES) + "SELECT poll_ts, host, param, job_id, operation, samples FROM sb",
        "parse_large_dumps": _with(BYTES) + "SELECT poll_ts, host, param, job_id, operation, samples FROM sb",
        "scoped_log_store": _with(BYTES) + f"""SELECT poll_ts, host, param, job_id, operation, samples FROM sb
            WHERE host IN ('oss0', 'oss2') AND param LIKE 'mdt.%.job_stats' AND poll_ts BETWEEN {START + 50} AND {START + 210}""",
        "rates_from_raw_log": _R
        + "SELECT poll, job_id, operation, value FROM r",
        "poll_register": _with() + """SELECT CAST(row_number() OVER (ORDER BY poll_ts) - 1 AS BIGINT) AS poll, poll_ts
            FROM (SELECT DISTINCT poll_ts FROM samples)""",
        "prometheus_roundtrip": _M + _QUOTED,
        "victoriametrics_roundtrip": _M + _QUOTED,
        "victoriametrics_series_roundtrip": _M + _QUOTED,
        "scope_ost": _with() + "SELECT poll, host, param, job_id, operation, samples FROM samples WHERE param LIKE 'obdfilter.%'",
        "scope_servers": _with() + """SELECT poll, host, param, job_id, operation, samples FROM samples
            WHERE param LIKE 'mdt.fs-MDT000%' AND host IN ('oss0', 'oss2')""",
        "merge_jobs": _M + "SELECT poll, job_id, operation, value FROM m",
        "merge_with_ops": _OPS + "true",
        "merge_with_bytes": _with(BYTES) + f"""SELECT poll, job_id, operation, CAST(sum(samples) AS BIGINT) AS value
            FROM sb WHERE samples <> 0 {_BY}
            UNION ALL SELECT poll, job_id, 'ops', CAST(sum(samples) AS BIGINT) FROM sb WHERE samples <> 0 GROUP BY poll, job_id""",
        "job_table": _with(MERGED, TIMES, "w AS " + _wide("o", "poll, job_id", ["ops", *PIVOT_OPS]))
        + """SELECT t.poll, t.job_id, t.s AS snapshot_time, ops, "open", "read", "write", "close", getattr, setattr
            FROM t LEFT JOIN w ON w.poll = t.poll AND w.job_id = t.job_id""",
        "job_times": _with(TIMES) + "SELECT poll, job_id, s AS snapshot_time, b AS start_time, e AS elapsed_time FROM t",
        "group_by_user": _with(_grouped(2)) + "SELECT * FROM go",
        "group_by_host": _with(_grouped(3)) + "SELECT * FROM go",
        "rates_by_user": _with(_grouped(2), "gr AS " + _changes(RATE, "go", "gt"))
        + "SELECT poll, job_id, operation, value FROM gr",
        "job_components": _with() + """SELECT DISTINCT job_id, split_part(job_id, '.', 1) AS exe,
            split_part(job_id, '.', 2) AS "user", split_part(job_id, '.', 3) AS host_short FROM samples""",
        "poll_summary": _with() + """, s AS (SELECT poll, count(DISTINCT job_id) AS total_jobs, count(DISTINCT host) AS servers,
              count(DISTINCT CASE WHEN param LIKE 'obdfilter.%' THEN concat(host, '|', param) END) AS osts,
              count(DISTINCT CASE WHEN param LIKE 'mdt.%' THEN concat(host, '|', param) END) AS mdts
              FROM samples GROUP BY poll)
            SELECT p.poll, coalesce(s.total_jobs, 0) AS total_jobs, coalesce(s.servers, 0) AS servers,
                   coalesce(s.osts, 0) AS osts, coalesce(s.mdts, 0) AS mdts,
                   CAST(CASE WHEN b.poll IS NULL THEN 0 ELSE 10 END AS BIGINT) AS query_duration
            FROM polls p LEFT JOIN s ON s.poll = p.poll LEFT JOIN s b ON b.poll = p.poll - 1""",
        "rate_between_polls": _R + "SELECT poll, job_id, operation, value FROM r",
        "diff_between_polls": _with(MERGED, TIMES, DIFFS) + "SELECT poll, job_id, operation, value FROM d",
        "sampling_windows": _with(TIMES) + """SELECT tc.poll, tc.job_id, tc.s - tp.s AS sampling_window,
            tc.poll_ts - tp.poll_ts AS query_duration
            FROM t tc JOIN t tp ON tp.poll = tc.poll - 1 AND tp.job_id = tc.job_id WHERE tc.s > tp.s""",
        "totals": _TOT + "SELECT poll, operation, value FROM tot",
        "percent_of_total": _TOT + """SELECT o.poll, o.job_id, o.operation, CAST(CASE WHEN tot.value IS NULL THEN o.value
            WHEN tot.value = 0 THEN 0 ELSE o.value * 100 // tot.value END AS BIGINT) AS value
            FROM o LEFT JOIN tot ON tot.poll = o.poll AND tot.operation = o.operation""",
        "percent_table": _TOT + """SELECT o.poll, o.job_id, o.operation, CAST(CASE WHEN tot.value = 0 THEN 0
            ELSE o.value * 100 // tot.value END AS BIGINT) AS value
            FROM o JOIN tot ON tot.poll = o.poll AND tot.operation = o.operation""",
        "peak_ops": _R + """SELECT operation, value AS rate, poll_ts AS "timestamp" FROM (
            SELECT *, row_number() OVER (PARTITION BY operation ORDER BY value DESC, poll_ts) AS n FROM (
              SELECT poll_ts, operation, CAST(sum(value) AS BIGINT) AS value FROM r GROUP BY poll_ts, operation)) WHERE n = 1""",
        "peak_jobs": _R + """, b AS (SELECT * FROM (SELECT *, row_number() OVER (
              PARTITION BY operation ORDER BY value DESC, poll_ts, job_id) AS n FROM r) WHERE n = 1 AND value > 0)
            SELECT b.operation, b.job_id, b.value AS rate,
                   string_agg(concat(v.operation, '=', v.value), ',' ORDER BY v.operation) AS ops, b.poll_ts AS "timestamp"
            FROM b JOIN r v ON v.poll_ts = b.poll_ts AND v.job_id = b.job_id
            GROUP BY b.operation, b.job_id, b.value, b.poll_ts""",
        "running_peak_ops": _R + """, s AS (SELECT poll, poll_ts, operation, CAST(sum(value) AS BIGINT) AS value FROM r GROUP BY ALL)
            SELECT poll, operation, value AS rate, poll_ts AS "timestamp" FROM (
              SELECT a.poll, a.operation, b.value, b.poll_ts, row_number() OVER (
                PARTITION BY a.poll, a.operation ORDER BY b.value DESC, b.poll_ts) AS n
              FROM s a JOIN s b ON b.operation = a.operation AND b.poll <= a.poll) WHERE n = 1""",
        "running_peak_jobs": _R + """, u AS (SELECT DISTINCT poll, operation FROM r WHERE value > 0),
            b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY poll, operation ORDER BY value DESC, job_id) AS n
                  FROM r WHERE value > 0) WHERE n = 1)
            SELECT poll, operation, job_id, value AS rate, poll_ts AS "timestamp" FROM (
              SELECT u.poll, u.operation, b.job_id, b.value, b.poll_ts, row_number() OVER (
                PARTITION BY u.poll, u.operation ORDER BY b.value DESC, b.poll_ts, b.job_id) AS n
              FROM u JOIN b ON b.operation = u.operation AND b.poll <= u.poll) WHERE n = 1""",
        "filter_exclude": _OPS + f"NOT {_MATCH}",
        "filter_include": _OPS + _MATCH,
        "filter_exact": _OPS + f"job_id NOT IN ({EXACT})",
        "select_inclusive": _OPS + f"job_id IN ({EXACT})",
        "select_exclusive": _OPS + f"job_id NOT IN ({EXACT})",
        "min_rate": _R + """SELECT poll, job_id, operation, value FROM r
            WHERE (poll, job_id) IN (SELECT (poll, job_id) FROM r WHERE operation = 'ops' AND value > 20)""",
        "long_min_rate": _OPS + "(poll, job_id) IN (SELECT (poll, job_id) FROM o WHERE operation = 'ops' AND value > 500)",
        "active_jobs": _R + """SELECT poll, job_id, operation, value FROM r
            WHERE (poll, job_id) IN (SELECT (poll, job_id) FROM r WHERE value <> 0)""",
        "filter_ops": _OPS + f"operation IN ({NINE})",
        "known_ops": _OPS + f"operation IN ({KNOWN})",
        "op_short_names": _M + f"""SELECT poll, job_id, short_name,
            CASE short_name {_LONG} ELSE short_name END AS long_name, value FROM (
            SELECT *, CASE operation {_SHORT} ELSE left(operation, 4) END AS short_name FROM o)""",
        "filter_component": _OPS + "contains(split_part(job_id, '.', 2), '1') AND contains(split_part(job_id, '.', 3), 'n')",
        "time_window": _M + window(START + 50, START + 100),
        "prune_before": _M + window(START + 170, START + 290),
        "top_jobs": _R + _top("r", "ops", "ops, sampling_window", "ops > 1", 1, 5),
        "top_jobs_by_op": _R + _top("r", "write", 'ops, "write"', "ops > 1", 1, 5),
        "top_jobs_page": _R + _top("r", "ops", "ops", "ops > 1", 6, 10),
        "top_jobs_percent": _with(MERGED, TOTALS, """pc AS (SELECT o.poll, o.job_id, o.operation,
            o.value * 100 // tot.value AS value FROM o JOIN tot ON tot.poll = o.poll AND tot.operation = o.operation)""")
        + _top("pc", "ops", "CAST(ops AS BIGINT) AS ops", "ops > 0", 1, 5),
        "top_jobs_matching": _M + _top("o", "ops", "ops", f"ops > 1 AND {_MATCH}", 1, 3),
        "top_jobs_exact": _M + _top("o", "ops", "ops", f"ops > 0 AND job_id NOT IN ({EXACT})", 1, 5),
        "top_jobs_filtered": _with(MERGED, STATE) + "SELECT poll, rank, job_id, total FROM top",
        "scrolled_jobs": _with(MERGED, STATE) + "SELECT poll, rank, job_id, total FROM top WHERE rank BETWEEN 3 AND 7",
        "job_table_pivot": _M + f"""SELECT poll, job_id, CAST(sum(value) AS BIGINT) AS total, {", ".join(
            f"CAST(sum(CASE WHEN operation = '{n}' THEN value ELSE 0 END) AS BIGINT) AS \"{n}\"" for n in PIVOT_OPS)}
            FROM o WHERE operation IN ({", ".join(f"'{n}'" for n in PIVOT_OPS)})
            GROUP BY poll, job_id HAVING sum(value) > 0""",
        "top_job_bars": _with(MERGED, STATE) + f"""SELECT top.poll, top.job_id, n.operation, CAST(coalesce(st.value, 0) AS BIGINT) AS value
            FROM top CROSS JOIN (VALUES {NINE_ROWS}) n(operation)
            LEFT JOIN st ON st.poll = top.poll AND st.job_id = top.job_id AND st.operation = n.operation""",
        "top_job_rates": _with(MERGED, STATE, f"""
            lr AS ({_LAST.format(keys="job_id, operation", source="points", low=END - 60, high=END)})""")
        + f"""SELECT last_top.job_id, n.operation, CAST(coalesce(lr.value, 0) AS BIGINT) AS value
            FROM last_top CROSS JOIN (VALUES {NINE_ROWS}) n(operation)
            LEFT JOIN lr ON lr.job_id = last_top.job_id AND lr.operation = n.operation""",
        "top_job_series": _with(MERGED, STATE) + "SELECT * FROM points WHERE " + _OF_TOP,
        "top_job_rate_series": _with(MERGED, STATE, "tp AS (SELECT * FROM points WHERE " + _OF_TOP + ")")
        + _series_rate("tp", "job_id, operation"),
        "op_totals_filtered": _with(MERGED, STATE) + f"""SELECT p.poll, n.operation, CAST(coalesce(sum(st.value), 0) AS BIGINT) AS value
            FROM (SELECT DISTINCT poll FROM st) p CROSS JOIN (VALUES {NINE_ROWS}) n(operation)
            LEFT JOIN st ON st.poll = p.poll AND st.operation = n.operation GROUP BY p.poll, n.operation""",
        "time_range": _M + 'SELECT min("timestamp") AS first, max("timestamp") AS last FROM points',
        "distinct_ops": _M + "SELECT DISTINCT operation FROM points",
        "distinct_jobs": _M + "SELECT DISTINCT job_id FROM points",
        "op_series": _with(MERGED, _OPSER) + f"""SELECT "timestamp", value FROM os
            WHERE operation = 'read' AND "timestamp" >= {START + 50}""",
        "op_series_rate": _with(MERGED, _OPSER) + _series_rate("os", "operation"),
        "job_series": _M + f"""SELECT "timestamp", CAST(sum(value) AS BIGINT) AS value FROM points
            WHERE job_id = '{JOB}' AND operation IN ('open', 'read') AND "timestamp" >= {START + 50} GROUP BY "timestamp" """,
        "get_series": _M + f"""SELECT "timestamp", value FROM points
            WHERE job_id = '{JOB}' AND operation = 'open' AND "timestamp" >= {START + 50}""",
        "jobs_with_ops": _M + f"""SELECT DISTINCT job_id FROM points
            WHERE operation IN ('open', 'read') AND "timestamp" >= {START + 50}""",
        "series_rate": _M + _series_rate("points", "job_id, operation"),
        "series_rate_chunked": _M + _series_rate("points", "job_id, operation"),
        "rates_chunked": _R + "SELECT poll, job_id, operation, value FROM r",
        "latest_rate": _M + _LAST.format(keys="job_id, operation", source="points", low=START + 230, high=START + 290),
        "latest_op_rate": _with(MERGED, _OPSER, f"""
            lr AS ({_LAST.format(keys="operation", source="os", low=START + 230, high=START + 290)})""")
        + f"""SELECT n.operation, CAST(coalesce(lr.value, 0) AS BIGINT) AS value
            FROM (VALUES {NINE_ROWS}) n(operation) LEFT JOIN lr ON lr.operation = n.operation""",
        "cap_series": _M + """SELECT "timestamp", job_id, operation, value FROM (SELECT *, row_number() OVER (
            PARTITION BY job_id, operation ORDER BY "timestamp" DESC) AS n FROM points) WHERE n <= 10""",
        "filter_many_patterns": _M + _PATTERNS.format("NOT"),
        "keep_many_patterns": _M + _PATTERNS.format(""),
        "points_by_time": _M + """SELECT *, CAST(row_number() OVER (PARTITION BY "timestamp" ORDER BY job_id, operation) AS INTEGER) AS place
            FROM points""",
        "state_at": _M + _STATE,
        "state_at_snapshots": _M + _STATE,
        "replay_intervals": _M + """SELECT job_id, operation, "timestamp" AS "from", lead("timestamp") OVER (
            PARTITION BY job_id, operation ORDER BY "timestamp") AS "to", value FROM points""",
        "replay_frames": _M + _FRAMES,
        "replay_frames_chunked": _M + _FRAMES,
        "downsample": _M + f"""SELECT "timestamp", job_id, operation, value FROM (SELECT *, row_number() OVER (
            PARTITION BY ("timestamp" - {START}) // (290 // 7), job_id, operation ORDER BY "timestamp" DESC) AS n
            FROM points WHERE "timestamp" BETWEEN {START} AND {START + 290}) WHERE n = 1""",
        "human_counts": _TOT + """SELECT poll, operation, CASE WHEN value >= 1000000 THEN printf('%.1fM', value / 1000000.0)
            WHEN value >= 1000 THEN printf('%.1fK', value / 1000.0) ELSE CAST(value AS VARCHAR) END AS shown FROM tot""",
        "log_heights": _TOT + """SELECT poll, operation,
            CAST(floor(log10(CAST(value AS DOUBLE) + 1.0) * 1000) AS BIGINT) AS height FROM tot""",
        "axis_ceilings": _TOT + """SELECT poll, operation, CAST(round(CASE WHEN lead <= 1 THEN 1.0 WHEN lead <= 2 THEN 2.0
              WHEN lead <= 5 THEN 5.0 ELSE 10.0 END * magnitude * 1.1) AS BIGINT) AS ceiling
            FROM (SELECT *, value / magnitude AS lead FROM (
              SELECT *, pow(CAST(10.0 AS DOUBLE), floor(log10(value))) AS magnitude FROM tot))""",
        "chart_axis": _with(MERGED, _OPSER) + f"""SELECT operation, "timestamp" - {START + 100} AS x, value FROM os
            WHERE "timestamp" >= {START + 100}""",
        "chart_maximum": _with(MERGED, _OPSER) + "SELECT greatest(100, max(value)) AS max_value FROM os",
        "clocks": _M + f"""SELECT DISTINCT "timestamp", strftime(to_timestamp("timestamp") AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS utc_time,
            strftime(to_timestamp("timestamp") AT TIME ZONE 'UTC', '%H:%M:%S') AS utc_clock,
            CAST(round(("timestamp" - {START}) / 290.0 * 1000000) AS BIGINT) AS progress,
            greatest("timestamp" - 100, {START + 40}) AS window_start, "timestamp" AS window_end FROM points""",
        "short_ids": _with() + """SELECT DISTINCT job_id,
            CASE WHEN length(job_id) > 8 THEN concat(left(job_id, 5), '...') ELSE job_id END AS cut,
            rpad(concat(job_id, ':'), 17, ' ') AS padded FROM samples""",
        "report_lines": _with(MERGED, TIMES, RATES) + _report(5, RATE_LABEL, RATE_TOTAL_LABEL),
        "report_peaks": _with(MERGED, TIMES, RATES) + _report(5, RATE_LABEL, RATE_TOTAL_LABEL).replace(",\nrt AS", _PEAK_TABLES + ",\nrt AS") + _PEAK_LINES,
        "report_diff": _with(MERGED, TIMES, "\nr AS " + _changes(DIFF)) + _report(3, DIFF_LABEL, TOTAL_LABEL),
    }


_NUMBERS = "string_agg(concat(CASE operation {short} END, ': ', value), ', ' ORDER BY list_position([{names}], operation))".format(
    short=_SHORT, names=KNOWN
)


def _report(count: int, label: str, total: str) -> str:
    return _REPORT.replace("<count>", str(count)).replace("<label>", label.format(count)).replace("<total>", total)


_PATTERNS = """SELECT poll, job_id, operation, value FROM o WHERE job_id {} IN (
            SELECT DISTINCT job_id FROM (SELECT DISTINCT job_id FROM o) j JOIN (
              SELECT concat('.n', user_id) AS p FROM events WHERE user_id % 9 = 2
              UNION SELECT concat(user_id % 25, '.n', user_id % 7) FROM events WHERE user_id % 13 = 5
              UNION SELECT concat('n', user_id, '.') FROM events WHERE user_id % 50 = 7
              UNION SELECT 'n99' FROM events WHERE user_id = 8) ON contains(job_id, p))"""

_PEAK_TABLES = f""",
po AS (SELECT * FROM (SELECT h.poll, t.operation, t.value, t.poll_ts, row_number() OVER (PARTITION BY h.poll, t.operation ORDER BY t.value DESC, t.poll_ts) AS n
        FROM h JOIN (SELECT poll, poll_ts, operation, CAST(sum(value) AS BIGINT) AS value FROM r WHERE operation IN ({KNOWN}) GROUP BY ALL) t ON t.poll <= h.poll) WHERE n = 1),
pb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY poll, operation ORDER BY value DESC, job_id) AS n
        FROM r WHERE value > 0 AND operation IN ({KNOWN})) WHERE n = 1),
pj AS (SELECT * FROM (SELECT h.poll, b.operation, b.job_id, b.poll AS best, b.poll_ts, row_number() OVER (
        PARTITION BY h.poll, b.operation ORDER BY b.value DESC, b.poll_ts, b.job_id) AS n FROM h JOIN pb b ON b.poll <= h.poll) WHERE n = 1),
pv AS (SELECT poll, job_id, string_agg(concat(CASE operation {_SHORT} END, ': ', value), ', ' ORDER BY value DESC, operation) AS numbers
        FROM r WHERE operation IN ({KNOWN}) GROUP BY poll, job_id)"""

_PEAK_LINES = f"""
UNION ALL SELECT poll, '{PEAK_OPS_LABEL}' FROM h
UNION ALL SELECT poll, '{PEAK_JOBS_LABEL}' FROM h
UNION ALL SELECT poll, concat('- ', rpad(concat(CASE operation {_SHORT} END, ':'), 10, ' '), ' {{rate: ', rpad(concat(value, ','), 10, ' '), ' ts: ', poll_ts, '}}') FROM po
UNION ALL SELECT pj.poll, concat('- ', rpad(concat(CASE operation {_SHORT} END, ':'), 10, ' '), ' {{', numbers, ', ts: ', poll_ts, ', job_id: ', pj.job_id, '}}')
  FROM pj JOIN pv ON pv.poll = pj.best AND pv.job_id = pj.job_id"""

_STATE = f"""SELECT job_id, operation, value FROM (SELECT *, row_number() OVER (
            PARTITION BY job_id, operation ORDER BY "timestamp" DESC) AS n FROM points
            WHERE "timestamp" <= {START + 155}) WHERE n = 1"""

_REPORT = f""",
s AS (SELECT poll, count(DISTINCT job_id) AS jobs, count(DISTINCT host) AS servers,
        count(DISTINCT CASE WHEN param LIKE 'obdfilter.%' THEN concat(host, '|', param) END) AS osts,
        count(DISTINCT CASE WHEN param LIKE 'mdt.%' THEN concat(host, '|', param) END) AS mdts FROM samples GROUP BY poll),
h AS (SELECT p.poll, p.poll_ts, coalesce(s.jobs, 0) AS jobs, coalesce(s.servers, 0) AS servers, coalesce(s.osts, 0) AS osts,
        coalesce(s.mdts, 0) AS mdts FROM polls p JOIN s b ON b.poll = p.poll - 1 LEFT JOIN s ON s.poll = p.poll),
j AS (SELECT poll, job_id, sampling_window, max(CASE WHEN operation = 'ops' THEN value END) AS ops, {_NUMBERS} AS numbers
        FROM r GROUP BY poll, job_id, sampling_window),
tj AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY poll ORDER BY ops DESC, job_id) AS n FROM j WHERE ops > 1) WHERE n <= <count>),
rt AS (SELECT poll, operation, CAST(sum(value) AS BIGINT) AS value FROM r GROUP BY poll, operation)
SELECT poll, '---' AS line FROM h
UNION ALL SELECT poll, concat('timestamp: ', poll_ts) FROM h
UNION ALL SELECT poll, 'query_duration: 10' FROM h
UNION ALL SELECT poll, concat('servers_queried: ', servers) FROM h
UNION ALL SELECT poll, concat('osts_queried: ', osts) FROM h
UNION ALL SELECT poll, concat('mdts_queried: ', mdts) FROM h
UNION ALL SELECT poll, concat('total_jobs: ', jobs) FROM h
UNION ALL SELECT poll, concat('<label>',
            CASE WHEN poll IN (SELECT poll FROM tj) THEN '' ELSE ' []' END) FROM h
UNION ALL SELECT poll, concat('- ', rpad(concat(job_id, ':'), 17, ' '), ' {{', numbers, ', sw: ', sampling_window, '}}') FROM tj
UNION ALL SELECT poll, '<total>' FROM h
UNION ALL SELECT poll, concat('- ', rpad(concat(CASE operation {_SHORT} END, ':'), 10, ' '), ' {{rate: ', value, '}}') FROM rt
UNION ALL SELECT poll, '...' FROM h"""
