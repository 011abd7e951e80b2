"""Registered queries: blocking, sessions and graphs (BLK-*) on F2."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import blocking as blk
from ..operators.graph import one_hop
from . import fixtures as fx
from . import fixtures_more as fm
from . import oracle_fixtures as ofx

QUERIES: dict = {}
ORACLE: dict = {}


def reg(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


F2 = ofx.with_(ofx.f2())

LOCKS_SQL = """locks AS (
  SELECT 'srv0' AS server_name, l_orderkey + 1 AS session_id, 'KEY: ' || CAST(l_partkey AS VARCHAR) AS resource,
         (['S', 'X', 'U', 'IX'])[l_linenumber % 4 + 1] AS request_mode,
         CASE WHEN l_linestatus = 'F' THEN 'GRANT' ELSE 'WAIT' END AS request_status
  FROM lineitem)"""


@reg("blk01_blocked_with_blocker", F2 + """
SELECT s.*, b.login_name AS blocker_login_name, b.status AS blocker_status, b.program_name AS blocker_program_name
FROM f2 s JOIN f2 b ON s.server_name = b.server_name AND s.blocking_session_id = b.session_id
WHERE s.blocking_session_id <> 0""")
def q_blk01(spark, sf_dir):
    return blk.blocked_with_blocker(fx.f2_sessions(spark, sf_dir))


@reg("blk01_blockers_semi_join", F2 + """
SELECT * FROM f2 s WHERE EXISTS (SELECT 1 FROM f2 v WHERE v.server_name = s.server_name
                                 AND v.blocking_session_id = s.session_id AND v.blocking_session_id <> 0)""")
def q_blk01b(spark, sf_dir):
    return blk.blockers(fx.f2_sessions(spark, sf_dir))


_CHAINS = """
WITH RECURSIVE f2 AS ({f2body}),
ch(server_name, session_id, root_blocker, chain_level) AS (
  SELECT server_name, session_id, session_id, 0 FROM f2 WHERE blocking_session_id = 0
  UNION ALL
  SELECT s.server_name, s.session_id, ch.root_blocker, ch.chain_level + 1
  FROM f2 s JOIN ch ON s.server_name = ch.server_name AND s.blocking_session_id = ch.session_id
  WHERE s.blocking_session_id <> 0)"""


def _f2_body() -> str:
    body = ofx.f2().strip()
    return body[body.index("(") + 1: body.rindex(")")]


@reg("blk02_blocking_chains", _CHAINS.format(f2body=_f2_body()) + """
SELECT server_name, session_id, root_blocker, CAST(chain_level AS BIGINT) AS chain_level, false AS is_cycle FROM ch""")
def q_blk02(spark, sf_dir):
    return blk.blocking_chains(fx.f2_sessions(spark, sf_dir))


@reg("blk02_victims_per_root", _CHAINS.format(f2body=_f2_body()) + """
SELECT server_name, root_blocker, CAST(count(*) AS BIGINT) AS victims, CAST(max(chain_level) AS BIGINT) AS max_level
FROM ch WHERE chain_level > 0 GROUP BY ALL""")
def q_blk02v(spark, sf_dir):
    return blk.victims_per_root(blk.blocking_chains(fx.f2_sessions(spark, sf_dir)))


@reg("blk03_lead_blockers", F2 + """
, e AS (SELECT server_name, blocking_session_id AS session_id, CAST(count(*) AS BIGINT) AS sessions_blocked,
               max(wait_duration_ms) AS longest_wait_ms
        FROM f2 WHERE blocking_session_id <> 0 AND wait_duration_ms > 3000 AND wait_type LIKE 'LCK%' GROUP BY ALL)
SELECT s.*, e.sessions_blocked, e.longest_wait_ms FROM f2 s JOIN e USING (server_name, session_id)
WHERE s.blocking_session_id = 0""")
def q_blk03(spark, sf_dir):
    return blk.lead_blockers(fx.f2_sessions(spark, sf_dir), min_wait_ms=3000)


@reg("blk04_reconcile_blocker", F2 + """
, b AS (SELECT 'srv0' AS server_name, o_orderkey * 2 + 1 AS session_id,
               CAST(CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE o_orderkey % 97 + 1 END AS BIGINT) AS blocking_session_id
        FROM orders)
SELECT r.server_name, r.session_id,
       CASE WHEN r.blocking_session_id <> 0 AND b.session_id IS NULL THEN r.blocking_session_id
            WHEN r.blocking_session_id <> 0 AND r.session_id <> b.blocking_session_id THEN b.blocking_session_id
            WHEN r.blocking_session_id = 0 AND r.session_id = b.session_id THEN b.blocking_session_id
            WHEN r.blocking_session_id <> 0 AND r.session_id = b.blocking_session_id THEN r.blocking_session_id
       END AS resolved_blocking_session_id
FROM f2 r LEFT JOIN b ON r.server_name = b.server_name AND r.session_id = b.session_id""")
def q_blk04(spark, sf_dir):
    return blk.reconcile_blocker(fx.f2_sessions(spark, sf_dir), fm.f2_second_source(spark, sf_dir))


@reg("blk05_locks_per_session", ofx.with_(ofx.f2(), LOCKS_SQL) + """
SELECT s.server_name, s.session_id, s.login_name, l.resource, l.request_mode, l.request_status
FROM f2 s LEFT JOIN locks l ON s.server_name = l.server_name AND s.session_id = l.session_id
WHERE l.request_status = 'WAIT'""")
def q_blk05(spark, sf_dir):
    return blk.locks_per_session(fx.f2_sessions(spark, sf_dir), fm.f2_locks(spark, sf_dir), status="WAIT")


@reg("blk06_wait_list", """
WITH w AS (SELECT 'srv0' AS server_name, l_orderkey + 1 AS session_id, 'W_' || l_returnflag AS wait_type,
                  CAST(l_quantity AS BIGINT) * 100 AS wait_duration_ms FROM lineitem),
g AS (SELECT server_name, session_id, wait_type, CAST(sum(wait_duration_ms) AS BIGINT) AS ms FROM w GROUP BY ALL)
SELECT server_name, session_id, CAST(sum(ms) AS BIGINT) AS total_wait_ms,
       string_agg(wait_type || ' (' || CAST(ms AS VARCHAR) || ' ms)', ', ' ORDER BY ms DESC, wait_type) AS wait_list
FROM g GROUP BY ALL""")
def q_blk06(spark, sf_dir):
    return blk.wait_list(fm.f2_waits(spark, sf_dir))


@reg("blk07_last_observation", """
WITH o AS (SELECT 'srv0' AS server_name, l_orderkey % 500 + 1 AS session_id, 'db' || CAST(l_suppkey % 5 AS VARCHAR) AS database_name,
                  date_trunc('year', l_shipdate) AS request_start, l_partkey % 10 AS plan_handle, l_shipdate AS observed_ts,
                  CAST(round(l_extendedprice * 100) AS BIGINT) AS cpu_ms, CAST(l_quantity AS BIGINT) AS reads,
                  l_orderkey * 10 + l_linenumber AS obs_id FROM lineitem)
SELECT server_name, session_id, database_name, request_start, plan_handle,
       arg_max(observed_ts, (observed_ts, obs_id, cpu_ms, reads)) AS observed_ts,
       arg_max(cpu_ms, (observed_ts, obs_id, cpu_ms, reads)) AS cpu_ms,
       arg_max(reads, (observed_ts, obs_id, cpu_ms, reads)) AS reads,
       arg_max(obs_id, (observed_ts, obs_id, cpu_ms, reads)) AS obs_id,
       CAST(count(*) AS BIGINT) AS observations
FROM o GROUP BY ALL""")
def q_blk07(spark, sf_dir):
    return blk.last_observation(fm.f2_observations(spark, sf_dir),
                                ["server_name", "session_id", "database_name", "request_start", "plan_handle"],
                                ["observed_ts", "obs_id", "cpu_ms", "reads"])


@reg("blk09_parallel_skew", """
WITH t AS (SELECT l_orderkey % 100 AS session_id, 0 AS request_id, l_linenumber % 3 AS node_id, l_linenumber AS thread_id,
                  sum(CAST(l_quantity AS BIGINT) * 10) AS row_count FROM lineitem GROUP BY ALL),
x AS (SELECT *, sum(row_count) OVER w AS s, count(*) OVER w AS dop FROM t WHERE thread_id > 0
      WINDOW w AS (PARTITION BY session_id, request_id, node_id)),
y AS (SELECT *, row_count / CASE WHEN s / dop = 0 THEN 1.0 ELSE s / dop END AS skew FROM x WHERE dop > 1)
SELECT session_id, request_id, CAST(count(*) AS BIGINT) AS skewed_threads, round(max(skew), 4) AS max_skew
FROM y WHERE row_count > 100 AND (skew > 1.2 OR skew < 0.8) GROUP BY ALL""")
def q_blk09(spark, sf_dir):
    return blk.parallel_skew(fm.f2_threads(spark, sf_dir), min_rows=100, high=1.2, low=0.8)


@reg("blk10_bad_estimates", """
SELECT l_orderkey AS query_id, l_linenumber AS node_id, CAST(l_quantity AS BIGINT) AS estimated_rows,
       CAST(floor(l_extendedprice) AS BIGINT) AS actual_rows
FROM lineitem WHERE CAST(floor(l_extendedprice) AS BIGINT) > 0
  AND (CAST(l_quantity AS BIGINT) * 1000 < CAST(floor(l_extendedprice) AS BIGINT)
       OR CAST(l_quantity AS BIGINT) > CAST(floor(l_extendedprice) AS BIGINT) * 1000)""")
def q_blk10(spark, sf_dir):
    return blk.bad_estimates(fm.f2_ops(spark, sf_dir))


@reg("blk11_connection_summary", F2 + """
SELECT server_name, database_name, CAST(count(*) AS BIGINT) AS sessions,
       CAST(count(DISTINCT login_name) AS BIGINT) AS distinct_logins,
       array_to_string(list_sort(list_distinct(list(login_name))), ', ') AS logins
FROM f2 GROUP BY ALL""")
def q_blk11(spark, sf_dir):
    return blk.connection_summary(fx.f2_sessions(spark, sf_dir))


@reg("blk12_one_hop_edges", F2 + """
SELECT s.server_name, s.session_id AS from_session_id, s.login_name AS from_login_name,
       b.session_id AS to_session_id, b.login_name AS to_login_name
FROM f2 s JOIN f2 b ON s.server_name = b.server_name AND s.blocking_session_id = b.session_id
WHERE s.blocking_session_id <> 0""")
def q_blk12(spark, sf_dir):
    s = fx.f2_sessions(spark, sf_dir)
    nodes = s.select("server_name", "session_id", "login_name")
    edges = s.filter(F.col("blocking_session_id") != 0).select("server_name", "session_id", "blocking_session_id")
    return one_hop(nodes, edges, node_key="session_id", src="session_id", dst="blocking_session_id",
                   group=["server_name"])


@reg("ag10_session_rollup", F2 + """
SELECT server_name, database_name, CAST(count(*) AS BIGINT) AS sessions, CAST(sum(cpu_ms) AS BIGINT) AS cpu_ms
FROM f2 GROUP BY ROLLUP (server_name, database_name)""")
def q_ag10(spark, sf_dir):
    return blk.session_rollup(fx.f2_sessions(spark, sf_dir))
