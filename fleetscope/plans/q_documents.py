"""Registered queries: JSON documents, statement text, vectors (DOC-*, PRJ-6,
QS-14, SRC-6, VEC-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import documents as doc
from ..operators import vectors as vec
from . import fixtures as fx

QUERIES: dict = {}
ORACLE: dict = {}


def reg(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


@reg("doc01_json_paths", """
SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(len(json_keys(props)) AS BIGINT) AS key_count
FROM events""")
def q_doc01(spark, sf_dir):
    return doc.json_paths(fx._t(spark, sf_dir, "events"), doc="props", paths={"k": ("$.k", "long")})


def order_docs(spark, sf_dir):
    o = fx._t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_orderstatus").alias("status"))
    li = fx._t(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").cast("long").alias("line"),
        F.col("l_partkey").alias("part"), F.col("l_quantity").cast("long").alias("qty"),
        fx.cents("l_extendedprice").alias("price_cents"))
    return doc.order_documents(o, li)


@reg("doc03_json_construction", """
WITH li AS (SELECT l_orderkey, list({'line': CAST(l_linenumber AS BIGINT), 'part': l_partkey, 'qty': CAST(l_quantity AS BIGINT),
                                     'price_cents': CAST(round(l_extendedprice * 100) AS BIGINT)}
                                    ORDER BY l_linenumber, l_partkey, CAST(l_quantity AS BIGINT), round(l_extendedprice * 100)) AS items
            FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey AS order_id, CAST(to_json({'id': o_orderkey, 'status': o_orderstatus, 'items': items}) AS VARCHAR) AS doc
FROM orders JOIN li ON o_orderkey = l_orderkey""")
def q_doc03(spark, sf_dir):
    return order_docs(spark, sf_dir)


@reg("doc02_json_array_rows", """
SELECT l_orderkey AS order_id, CAST(l_linenumber AS BIGINT) AS line, l_partkey AS part, CAST(l_quantity AS BIGINT) AS qty,
       CAST(round(l_extendedprice * 100) AS BIGINT) AS price_cents,
       CAST(l_quantity AS BIGINT) * CAST(round(l_extendedprice * 100) AS BIGINT) AS line_total_cents
FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)""")
def q_doc02(spark, sf_dir):
    return doc.document_lines(order_docs(spark, sf_dir))


@reg("doc04_event_sourced_state", """
SELECT user_id, arg_max(props, (ts, event_id)) AS payload, arg_max(event_type, (ts, event_id)) AS last_type,
       max(ts) AS last_ts, CAST(count(*) AS BIGINT) AS events,
       CAST(json_extract_string(arg_max(props, (ts, event_id)), '$.k') AS BIGINT) AS k
FROM events WHERE event_type IN ('purchase', 'signup', 'click') GROUP BY user_id""")
def q_doc04(spark, sf_dir):
    return doc.current_state(fx._t(spark, sf_dir, "events"), entity="user_id", ts="ts", tie="event_id", payload="props",
                             types=["purchase", "signup", "click"], fields={"k": ("$.k", "long")})


@reg("doc05_read_model", """
SELECT event_type, date_trunc('day', ts) AS day, CAST(count(*) AS BIGINT) AS events, round(sum(value), 2) AS total_value
FROM events GROUP BY ALL""")
def q_doc05(spark, sf_dir):
    ev = fx._t(spark, sf_dir, "events").withColumn("day", F.date_trunc("day", "ts"))
    return doc.read_model(ev, keys=["event_type", "day"], value="value")


@reg("prj06_statement_offsets", """
WITH d AS (SELECT doc_id, text, (doc_id % 50) * 2 AS start_off,
                  CASE WHEN doc_id % 3 = 0 THEN -1 ELSE (doc_id % 50) * 2 + (doc_id % 200) * 2 END AS end_off FROM documents)
SELECT doc_id, start_off, end_off,
       substring(text, start_off // 2 + 1,
                 greatest(((CASE WHEN end_off = -1 THEN length(text) * 2 ELSE end_off END) - start_off) // 2 + 1, 0)) AS statement
FROM d""")
def q_prj06(spark, sf_dir):
    d = fx._t(spark, sf_dir, "documents").select(
        "doc_id", "text", ((F.col("doc_id") % 50) * 2).alias("start_off"),
        F.when(F.col("doc_id") % 3 == 0, F.lit(-1)).otherwise((F.col("doc_id") % 50) * 2 + (F.col("doc_id") % 200) * 2)
        .cast("long").alias("end_off"))
    return doc.statements(d).drop("text")


def statement_texts(spark, sf_dir):
    li = fx._t(spark, sf_dir, "lineitem")
    tbl = (F.col("l_suppkey") % 10).cast("string")
    text = (F.when(F.col("l_returnflag") == "R", F.concat(F.lit("SELECT * FROM tbl"), tbl))
            .when(F.col("l_returnflag") == "A", F.concat(F.lit("  update tbl"), tbl, F.lit(" SET x = 1")))
            .otherwise(F.concat(F.lit("EXEC usp_"), tbl)))
    return li.select("l_orderkey", "l_linenumber", text.alias("text"))


@reg("qs14_workload_by_text", """
WITH s AS (SELECT l_orderkey, l_linenumber,
                  CASE WHEN l_returnflag = 'R' THEN 'SELECT * FROM tbl' || CAST(l_suppkey % 10 AS VARCHAR)
                       WHEN l_returnflag = 'A' THEN '  update tbl' || CAST(l_suppkey % 10 AS VARCHAR) || ' SET x = 1'
                       ELSE 'EXEC usp_' || CAST(l_suppkey % 10 AS VARCHAR) END AS text FROM lineitem)
SELECT *, CASE WHEN lower(ltrim(text)) LIKE 'insert%' OR lower(ltrim(text)) LIKE 'update%'
                    OR lower(ltrim(text)) LIKE 'delete%' OR lower(ltrim(text)) LIKE 'merge%' THEN 'Write'
               WHEN lower(ltrim(text)) LIKE 'select%' THEN 'Read'
               WHEN lower(ltrim(text)) LIKE 'alter index%' OR lower(ltrim(text)) LIKE 'dbcc%' THEN 'Maintenance'
               ELSE 'Other' END AS workload FROM s""")
def q_qs14t(spark, sf_dir):
    return doc.classify_text(statement_texts(spark, sf_dir))


@reg("qs14_workload_by_stats", """
WITH g AS (SELECT l_partkey AS query_id, sum(CAST(l_quantity AS BIGINT)) AS execs,
                  sum(CAST(round(l_extendedprice * 100) AS BIGINT) + CAST(l_quantity AS BIGINT) * 1000) AS dur,
                  date_diff('day', min(l_shipdate), max(l_shipdate)) + 1 AS days FROM lineitem GROUP BY l_partkey),
s AS (SELECT query_id, execs / days AS executions_per_day, dur / execs AS avg_duration FROM g)
SELECT *, CASE WHEN executions_per_day >= 0.1 AND avg_duration < 150000 THEN 'OLTP'
               WHEN executions_per_day < 0.1 AND avg_duration >= 150000 THEN 'Reporting'
               WHEN executions_per_day >= 0.1 AND avg_duration >= 150000 THEN 'Batch' ELSE 'Ad hoc' END AS workload
FROM s""")
def q_qs14s(spark, sf_dir):
    from ..functions.scalar import datediff_boundary

    f = fx.f4_query_stats(spark, sf_dir)
    li = fx._t(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("query_id")).agg(
        F.min("l_shipdate").alias("a"), F.max("l_shipdate").alias("b"))
    g = f.groupBy("query_id").agg(F.sum("executions").alias("execs"), F.sum("duration").alias("dur")).join(li, "query_id")
    s = g.select("query_id", (F.col("execs") / (datediff_boundary("day", F.col("a"), F.col("b")) + 1))
                 .alias("executions_per_day"), (F.col("dur") / F.col("execs")).alias("avg_duration"))
    return doc.classify_stats(s, freq_high=0.1, slow_ms=150000)


@reg("src06_split_lines", """
WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS items
           FROM documents)
SELECT doc_id, CAST(i AS BIGINT) AS item_pos, items[i] AS item FROM s, generate_series(1, len(items)) t(i)""")
def q_src06(spark, sf_dir):
    return doc.split_rows(fx._t(spark, sf_dir, "documents"), col="text", sep="\n", key=["doc_id"])


VEC01_SQL = """
WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE vec_id % 100 = 0),
c AS (SELECT vec_id AS match_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
d AS (SELECT query_id, match_id,
             round(1 - list_dot_product(qv, v) / (sqrt(list_dot_product(qv, qv)) * sqrt(list_dot_product(v, v))), 6) + 0.0 AS distance
      FROM q, c)
SELECT query_id, match_id, distance,
       row_number() OVER (PARTITION BY query_id ORDER BY distance, match_id) AS rank
FROM d QUALIFY rank <= 5"""


@reg("vec01_topk_in_cells", VEC01_SQL)
def q_vec01_cells(spark, sf_dir):
    e = fx._t(spark, sf_dir, "embeddings")
    index = vec.build_cells(e, metric="cosine", centres=64)
    return vec.top_k_in_cells(index, e.filter(F.col("vec_id") % 100 == 0), k=5)[0]


@reg("vec01_topk_cosine", VEC01_SQL)
def q_vec01(spark, sf_dir):
    e = fx._t(spark, sf_dir, "embeddings")
    return vec.top_k_search(e, e.filter(F.col("vec_id") % 100 == 0), k=5, metric="cosine")


@reg("vec02_distance_metrics", """
WITH p AS (SELECT a.vec_id AS a_id, b.vec_id AS b_id, CAST(a.embedding AS DOUBLE[]) AS a, CAST(b.embedding AS DOUBLE[]) AS b
           FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT a_id, b_id,
       round(1 - list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))), 6) AS cosine_distance,
       round(sqrt(list_sum(list_transform(list_zip(a, b), lambda x: (x[1] - x[2]) * (x[1] - x[2])))), 6) AS euclidean_distance,
       round(-list_dot_product(a, b), 6) AS dot_distance
FROM p""")
def q_vec02(spark, sf_dir):
    e = fx._t(spark, sf_dir, "embeddings")
    a = e.select(F.col("vec_id").alias("a_id"), F.col("embedding").alias("a"))
    b = e.select(F.col("vec_id").alias("b_id"), F.col("embedding").alias("b"))
    pairs = a.join(b, b.b_id == a.a_id + 1)
    return vec.pair_distances(pairs, a="a", b="b").drop("a", "b")
