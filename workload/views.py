"""Crash tables as views over the given tables, in SQL that Spark and DuckDB both run.

Table names are in braces: Spark fills them with DataFrames, DuckDB with its own view names.
"""

from __future__ import annotations

# Orders are collisions: 40 roads, each a meridian with two pieces 3 degrees apart.
COLLISION = """
SELECT o.o_orderkey AS collision_id,
       CAST(o.o_orderdate AS DATE) AS occurred_on,
       CAST(o.o_orderkey % 24 AS INT) AS hour,
       concat('A', CAST(o.o_custkey % 40 AS STRING)) AS road_number,
       -4e0 + (o.o_custkey % 40) * 1e-1 AS lon,
       50e0 + CASE WHEN o.o_orderkey % 3 = 0 THEN 3e0 ELSE 0e0 END
            + ((o.o_custkey * 7919 + o.o_orderkey * 104729) % 20000) * 180e0 / (pi() * 6371008.8e0) AS lat,
       CASE WHEN o.o_orderkey % 7 = 0 THEN 'Fatal'
            WHEN o.o_orderkey % 7 <= 2 THEN CASE WHEN year(o.o_orderdate) < 1998 THEN 'Serious' ELSE 'Serious injury' END
            ELSE 'Slight' END AS severity_raw,
       CASE substr(o.o_orderpriority, 1, 1) WHEN '1' THEN 20 WHEN '2' THEN 30 WHEN '3' THEN 40 WHEN '4' THEN 60 ELSE 70 END AS speed_limit,
       o.o_orderstatus AS road_type,
       CASE o.o_custkey % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'crossroads' WHEN 2 THEN 'roundabout' WHEN 3 THEN 't_junction' ELSE 'slip_road' END AS junction_type,
       c.c_nationkey % 2 = 0 AS is_urban,
       CASE o.o_orderkey % 3 WHEN 0 THEN 'daylight' WHEN 1 THEN 'dark_lit' ELSE 'dark_unlit' END AS lighting
FROM {orders} o LEFT JOIN {customer} c ON o.o_custkey = c.c_custkey
"""

# Unclassified roads carry no number.
COLLISION_WITH_UNNUMBERED = """
SELECT collision_id, occurred_on, CASE WHEN collision_id % 50 = 0 THEN NULL ELSE road_number END AS road_number, lon, lat FROM {collision}
"""

# Line items are casualties.
CASUALTY = """
SELECT l_orderkey AS collision_id,
       CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS INT) AS casualty_no,
       CAST(l_partkey % 90 AS INT) AS age,
       CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F'
            THEN CASE WHEN l_quantity > 45 THEN 'fatal' ELSE 'serious' END
            ELSE 'slight' END AS severity
FROM {lineitem}
"""

VEHICLE = """
SELECT collision_id, CAST(row_number() OVER (PARTITION BY collision_id ORDER BY supp) AS INT) AS vehicle_no,
       CASE supp % 4 WHEN 0 THEN 'car' WHEN 1 THEN 'van' WHEN 2 THEN 'cycle' ELSE 'lorry' END AS vehicle_type,
       CASE supp % 5 WHEN 0 THEN 'front' WHEN 1 THEN 'back' WHEN 2 THEN 'left' WHEN 3 THEN 'right' ELSE 'none' END AS point_of_impact
FROM (SELECT DISTINCT l_orderkey AS collision_id, l_suppkey AS supp FROM {lineitem}) d
"""
VEHICLE_TYPES = ["car", "van", "cycle", "lorry"]
IMPACTS = ["front", "back", "left", "right", "none"]

# Every customer asks for a journey beside one road: three candidates 20, 45 and 80 m east of it.
ROUTE_ENDS = """
SELECT request_id, CAST(candidate AS INT) AS candidate,
       -4e0 + (request_id % 40) * 1e-1
         + CASE candidate WHEN 1 THEN 20e0 WHEN 2 THEN 45e0 ELSE 80e0 END / (6371008.8e0 * pi() / 180e0 * cos(radians(50e0))) AS lon,
       50e0 + ((request_id * 37) % 15000) * 180e0 / (pi() * 6371008.8e0) AS lat0,
       50e0 + ((request_id * 37) % 15000 + 5000) * 180e0 / (pi() * 6371008.8e0) AS lat1
FROM (SELECT c_custkey AS request_id, EACH_1_TO_3 AS candidate FROM {customer}) c
"""

MANIFEST = """
SELECT 'collision' AS kind, CAST(y AS INT) AS year, CAST(n + CASE y % 3 WHEN 0 THEN 10 WHEN 1 THEN 0 ELSE -10 END AS BIGINT) AS expected_rows
FROM (SELECT year(o_orderdate) AS y, count(*) AS n FROM {orders} GROUP BY year(o_orderdate)) a
UNION ALL
SELECT 'collision', CAST(max(year(o_orderdate)) + 1 AS INT), CAST(count(*) AS BIGINT) FROM {orders}
"""

# Label drift: the middle label changes its text in 1998.
SEVERITY_MAP = """
SELECT year, CASE m WHEN 1 THEN 'Fatal' WHEN 2 THEN 'Serious' ELSE 'Serious injury' END AS raw,
       CASE m WHEN 1 THEN 'fatal' ELSE 'serious' END AS label,
       CASE m WHEN 3 THEN 9e-1 ELSE 1e0 END AS weight
FROM (SELECT year, EACH_1_TO_3 AS m FROM (SELECT DISTINCT CAST(year(o_orderdate) AS INT) AS year FROM {orders}) y) x
"""

# Integer arithmetic up to the last step, with a different prime for each feature.
CONTRIBUTION = """
SELECT id, CASE p WHEN 1 THEN 'f_crashes' WHEN 2 THEN 'f_speed_mean' ELSE 'f_night_share' END AS feature,
       ((id * CASE p WHEN 1 THEN 3 WHEN 2 THEN 67 ELSE 7 END + p) % (161 + 20 * p) - 90) / 1e2 AS value
FROM (SELECT o_orderkey AS id, EACH_1_TO_3 AS p FROM {orders}) o
"""

# Crash files of one year each, line by line: 1996 breaks off within its last line, in 1998 one line lost its end.
CSV_LINES = """
SELECT file, CAST(sum(length(value) + 1) OVER (PARTITION BY file) - CASE WHEN y = 1996 THEN 1 ELSE 0 END AS BIGINT) AS size, value FROM (
  SELECT concat('collision_', CAST(y AS STRING), '.csv') AS file, y,
         CASE WHEN (y = 1996 AND r = 1) OR (y = 1998 AND r = 3) THEN substr(line, 1, 9) ELSE line END AS value
  FROM (SELECT year(o_orderdate) AS y, row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY o_orderkey DESC) AS r,
               concat(CAST(o_orderkey AS STRING), ',', CAST(CAST(o_orderdate AS DATE) AS STRING), ',', CAST(o_orderkey % 24 AS STRING), ',A', CAST(o_custkey % 40 AS STRING)) AS line
        FROM {orders}) a) b
"""

FEATURE_YEARS = (1997, 1999)
TARGET_YEARS = (2000, 2001)


def for_spark(text: str) -> str:
    return text.replace("EACH_1_TO_3", "explode(sequence(1, 3))")


def for_duckdb(text: str) -> str:
    return text.replace("EACH_1_TO_3", "unnest(range(1, 4))")
