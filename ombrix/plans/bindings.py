"""Domain tables as deterministic projections of the star schema, for Spark and, as text, for the oracle.

A splat is a row of a point cloud, tagged PRIOR (0) or OBSERVED (1), with a confidence and a view count.
Every column is arithmetic on one table, so scans stay pruned to the columns a query uses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SPLAT = """SELECT ((l_orderkey*100000+l_partkey)*10000+l_suppkey)*10+l_linenumber AS splat_id, l_suppkey AS vehicle_id,
 (CAST(l_quantity AS DOUBLE)-CAST(25.5 AS DOUBLE))/CAST(24.5 AS DOUBLE) AS x, CAST(l_partkey%81-40 AS DOUBLE)/100 AS y,
 CAST(l_extendedprice AS DOUBLE)/105000*CAST(0.7 AS DOUBLE) AS z,
 CAST(l_discount AS DOUBLE)*10 AS r, CAST(l_tax AS DOUBLE)*CAST(12.5 AS DOUBLE) AS g, CAST(l_orderkey%256 AS DOUBLE)/255 AS b,
 CAST(l_linenumber AS DOUBLE)*CAST(0.002 AS DOUBLE)+CAST(0.01 AS DOUBLE) AS scale, CAST(l_partkey%100 AS DOUBLE)/100 AS opacity,
 CASE WHEN l_returnflag='R' THEN 1 ELSE 0 END AS provenance, CAST(l_orderkey%101 AS DOUBLE)/100 AS confidence,
 CAST(l_linenumber-1 AS INT) AS view_count, l_shipdate AS last_seen_ts FROM lineitem"""

OBSERVATION = """SELECT event_id AS observation_id, user_id AS vehicle_id, ts,
 CASE event_type WHEN 'signup' THEN 'phone_ar' WHEN 'purchase' THEN 'phone' WHEN 'view' THEN 'camera' WHEN 'click' THEN 'pi' ELSE 'cctv' END AS device,
 CAST(value AS DOUBLE) AS motion, CAST(regexp_extract(props,'[0-9]+',0) AS INT) AS inliers,
 CAST(regexp_extract(props,'[0-9]+',0) AS INT) + CAST(event_id%40 AS INT) AS total_matches, CAST(value AS DOUBLE)/100 AS reproj_error FROM events"""

EVENT_LOG = """SELECT event_id, user_id AS vehicle_id, ts,
 CASE event_type WHEN 'signup' THEN 'merge_pending' WHEN 'purchase' THEN 'merge' WHEN 'error' THEN 'merge_rejected' ELSE 'observation' END AS kind,
 user_id*100 + CAST(regexp_extract(props,'[0-9]+',0) AS BIGINT) AS pending_key, CAST(value AS DOUBLE) AS score FROM events"""

VEHICLE = """SELECT c.c_custkey AS vehicle_id, c.c_name AS name, c.c_mktsegment AS alias, min(o.o_orderdate) AS created_ts,
 max(o.o_orderdate) AS updated_ts, count(o.o_orderkey) AS frames
 FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY c.c_custkey, c.c_name, c.c_mktsegment"""

EMBEDDING = "SELECT label AS vehicle_id, vec_id AS observation_id, embedding FROM embeddings"

VIEWS = {"v_splat": SPLAT, "v_observation": OBSERVATION, "v_event_log": EVENT_LOG, "v_vehicle": VEHICLE, "v_embedding": EMBEDDING}
_TABLES = {"v_splat": ["lineitem"], "v_observation": ["events"], "v_event_log": ["events"], "v_vehicle": ["customer", "orders"], "v_embedding": ["embeddings"]}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of VIEWS over the tables in ``sf_dir``; no view is registered."""
    return spark.sql(VIEWS[name].replace("FROM customer c LEFT JOIN orders o", "FROM {customer} c LEFT JOIN {orders} o") if name == "v_vehicle" else VIEWS[name].replace(f"FROM {_TABLES[name][0]}", f"FROM {{{_TABLES[name][0]}}}"), **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _TABLES[name]})


def with_views(sql: str, *names: str) -> str:
    """Oracle text with the views it names in front."""
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in names) + (", " + sql[5:] if sql.startswith("WITH ") else " " + sql)
