"""Views of the driver's tables in the shape of the curation tables.

Each view is one SQL text that Spark and DuckDB both run, so a query and its SQL twin read the same rows. All arithmetic
is on integers and doubles. A view may use views above it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings")

VIEWS = {
    # clusters of four assets about 89 m apart, five classes
    "assets_fx": """
        SELECT 'osm_' || CASE c_custkey % 3 WHEN 0 THEN 'node' WHEN 1 THEN 'way' ELSE 'relation' END || '_' || CAST(c_custkey AS VARCHAR(20)) AS asset_id,
               CASE s.site % 5 WHEN 0 THEN 'transport.train_station' WHEN 1 THEN 'energy.transmission.substation'
                    WHEN 2 THEN 'water.wastewater.plant' WHEN 3 THEN 'energy.generation.power_plant'
                    ELSE 'energy.generation.solar_farm' END AS asset_type,
               CASE s.site % 5 WHEN 0 THEN 'transport' WHEN 2 THEN 'water' ELSE 'energy' END AS sector,
               -60e0 + (s.site * 7919 % 120000) / 1e3 + (c_custkey % 4) * 8e-4 AS lat,
               -175e0 + (s.site * 104729 % 350000) / 1e3 AS lon,
               c_name AS name, lower(r_name) AS region, c_custkey AS pos, s.site AS site, c_acctbal AS balance
        FROM (SELECT *, CAST(floor(c_custkey / 4) AS BIGINT) AS site FROM customer) s
        JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "elements_fx": """
        SELECT CASE p_partkey % 3 WHEN 0 THEN 'node' WHEN 1 THEN 'way' ELSE 'relation' END AS osm_type, p_partkey AS osm_id,
               CASE p_size % 10 WHEN 0 THEN 'substation' WHEN 1 THEN 'substation' WHEN 2 THEN 'plant' WHEN 3 THEN 'plant' END AS t_power,
               CASE WHEN p_size % 10 IN (0, 1) THEN CASE p_partkey % 5 WHEN 0 THEN 'transmission' WHEN 1 THEN 'distribution'
                    WHEN 2 THEN 'minor_distribution' END END AS t_substation,
               CASE WHEN p_size % 10 IN (2, 3) THEN CASE p_partkey % 4 WHEN 0 THEN 'solar' WHEN 1 THEN 'wind' WHEN 2 THEN 'coal' END END AS t_source,
               CASE p_size % 10 WHEN 4 THEN 'wastewater_plant' WHEN 5 THEN 'water_works' WHEN 6 THEN 'storage_tank' END AS t_man_made,
               CASE WHEN p_partkey % 2 = 0 THEN 'water' ELSE 'oil' END AS t_content,
               CASE p_size % 10 WHEN 7 THEN 'aerodrome' END AS t_aeroway,
               CASE p_size % 10 WHEN 8 THEN 'station' END AS t_railway,
               CASE p_partkey % 7 WHEN 0 THEN 'yes' END AS t_train,
               CASE WHEN p_partkey % 11 = 0 THEN p_name END AS t_name,
               CASE p_size % 10 WHEN 9 THEN 'yes' END AS t_harbour,
               CASE p_partkey % 13 WHEN 0 THEN 'data_center' WHEN 1 THEN 'transformer_tower' END AS t_building,
               CASE WHEN p_partkey % 17 <> 0 THEN (p_retailprice - 850e0) * 6e3 END AS area_m2,
               CAST((p_partkey % 9) * 33000 AS VARCHAR(20)) || ';' || CAST((p_partkey % 4) * 11000 AS VARCHAR(20)) AS voltage
        FROM part""",
    # points of official registers, 0 to 400 m from the sites
    "registers_fx": """
        SELECT s_suppkey AS point_id, CASE s_suppkey % 3 WHEN 0 THEN 'rail' WHEN 1 THEN 'grid' ELSE 'water' END AS register,
               'Customer ' || CAST(s_suppkey * 3 AS VARCHAR(20)) || ' Riverside' AS name,
               -60e0 + ((s_suppkey * 3) * 7919 % 120000) / 1e3 + (s_suppkey % 5) * 9e-4 AS lat,
               -175e0 + ((s_suppkey * 3) * 104729 % 350000) / 1e3 AS lon,
               'plant ' || CAST(s_nationkey AS VARCHAR(20)) AS detail,
               CASE s_suppkey % 4 WHEN 0 THEN 'transport.train_station' WHEN 1 THEN 'energy.transmission.substation'
                    WHEN 2 THEN 'energy.generation.power_plant' END AS implies,
               s_suppkey % 7 = 0 AS inactive
        FROM supplier""",
    # lines from one site to the next
    "lines_fx": """
        SELECT p_partkey AS line_id, CASE WHEN p_size % 6 <> 0 THEN p_size * 11e0 END AS kv, p_size % 8 = 0 AS traced,
               -60e0 + (p_partkey * 7919 % 120000) / 1e3 + 1e-3 AS lat1, -175e0 + (p_partkey * 104729 % 350000) / 1e3 AS lon1,
               -60e0 + ((p_partkey + 1) * 7919 % 120000) / 1e3 AS lat2, -175e0 + ((p_partkey + 1) * 104729 % 350000) / 1e3 + 1e-3 AS lon2,
               CASE p_partkey % 5 WHEN 0 THEN 'UNKNOWN101' WHEN 1 THEN 'TAP 7' ELSE p_name END AS sub_1, p_name || ' west' AS sub_2
        FROM part""",
    "decisions_fx": """
        SELECT 'osm_way_' || CAST(user_id AS VARCHAR(20)) AS asset_id,
               CASE event_id % 4 WHEN 0 THEN 'r0' WHEN 1 THEN 'r1' WHEN 2 THEN 'r2' ELSE 'source' END AS reviewer,
               CASE event_type WHEN 'view' THEN 'accept' WHEN 'click' THEN 'accept' WHEN 'purchase' THEN 'relabel'
                    WHEN 'error' THEN 'unsure' ELSE 'accept' END AS decision,
               CASE event_type WHEN 'error' THEN '' WHEN 'purchase' THEN 'energy.generation.solar_farm' ELSE 'energy.generation.power_plant' END AS label,
               'note ' || CAST(event_id % 10 AS VARCHAR(20)) AS note, ts AS at, event_id AS line
        FROM events""",
    "preds_fx": """
        SELECT o_orderkey AS tile_id, CAST(substring(o_orderpriority, 1, 1) AS INT) - 1 AS truth,
               CASE WHEN o_orderkey % 7 < 3 THEN (CAST(substring(o_orderpriority, 1, 1) AS INT) - 1 + CAST(o_orderkey % 5 AS INT)) % 5
                    ELSE CAST(substring(o_orderpriority, 1, 1) AS INT) - 1 END AS pred,
               CAST(o_orderkey % 3 AS INT) AS seed, lower(r_name) AS region
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey""",
    # learning curves: three seeds, whose lengths are as 3 to 2 to 1; every part is an epoch of one
    "epochs_fx": """
        SELECT CASE p_partkey % 4 WHEN 0 THEN 'm0' WHEN 1 THEN 'm1' WHEN 2 THEN 'm2' ELSE 'm3' END AS model,
               CASE WHEN p_partkey % 8 < 4 THEN 'LP' ELSE 'FT' END AS protocol,
               CASE WHEN step % 6 < 3 THEN 0 WHEN step % 6 < 5 THEN 1 ELSE 2 END AS seed,
               CAST(floor(step / 6) AS BIGINT) * CASE WHEN step % 6 < 3 THEN 3 WHEN step % 6 < 5 THEN 2 ELSE 1 END
               + CASE WHEN step % 6 < 3 THEN step % 6 WHEN step % 6 < 5 THEN step % 6 - 3 ELSE 0 END AS epoch,
               (p_size * 7 % 50) / 5e1 AS val_f1, p_retailprice / 1e2 AS time_s
        FROM (SELECT *, CAST(floor(p_partkey / 8) AS BIGINT) AS step FROM part) p""",
    "names_fx": """
        SELECT doc_id, lang,
               CASE doc_id % 11 WHEN 0 THEN 'Solar Park ' WHEN 1 THEN 'Old power station ' WHEN 2 THEN 'Umspannwerk ' WHEN 3 THEN 'Kläranlage '
                    WHEN 4 THEN 'Water works ' WHEN 5 THEN 'Data Centre ' WHEN 6 THEN 'Aéroport ' WHEN 7 THEN 'Station ' ELSE '' END
               || CAST(doc_id % 100 AS VARCHAR(20)) || ' / ' || CAST(doc_id % 7 * 33 AS VARCHAR(20)) || ' kV' AS name,
               CASE doc_id % 4 WHEN 0 THEN 'energy.generation.solar_farm' WHEN 1 THEN 'energy.transmission.substation'
                    WHEN 2 THEN 'water.wastewater.plant' ELSE 'transport.airport' END AS label
        FROM documents""",
    # two agents for each order line
    "agents_fx": """
        SELECT 't' || CAST(l_orderkey AS VARCHAR(20)) || '_' || CAST(l_linenumber AS VARCHAR(20)) AS id, l_orderkey AS tile,
               'c' || CAST(l_suppkey % 5 AS VARCHAR(20)) AS osm_label, 'c' || CAST(l_partkey % 5 AS VARCHAR(20)) AS human_label,
               l_suppkey % 9 = 0 AS human_unsure,
               CASE l_linenumber % 4 WHEN 0 THEN 'request_review' WHEN 1 THEN 'relabel' ELSE 'confirm' END AS a_action,
               'c' || CAST(l_partkey % 5 AS VARCHAR(20)) AS a_label, 1e0 - l_discount * 4e0 AS a_confidence,
               CASE WHEN l_returnflag = 'R' THEN 'poor' ELSE 'adequate' END AS a_quality,
               CASE WHEN l_partkey % 8 = 0 THEN 'request_review' ELSE 'classify' END AS b_action,
               CASE WHEN l_linenumber % 4 = 1 THEN 'c' || CAST(l_partkey % 5 AS VARCHAR(20)) ELSE 'c' || CAST(l_suppkey % 5 AS VARCHAR(20)) END AS b_label,
               1e0 - l_tax * 4e0 AS b_confidence, CASE WHEN l_linestatus = 'O' THEN 'calibration' ELSE 'heldout' END AS half,
               'r' || CAST(l_partkey % 3 AS VARCHAR(20)) AS region
        FROM (SELECT l_orderkey, l_linenumber, max(l_suppkey) AS l_suppkey, max(l_partkey) AS l_partkey, max(l_discount) AS l_discount,
                     max(l_tax) AS l_tax, max(l_returnflag) AS l_returnflag, max(l_linestatus) AS l_linestatus
              FROM lineitem GROUP BY l_orderkey, l_linenumber) l""",
    # attempted and kept tiles of cells
    "attempts_fx": """
        SELECT o_orderkey AS asset_id, lower(r_name) AS region, CASE o_orderkey % 4 WHEN 0 THEN 'energy' WHEN 1 THEN 'water' WHEN 2 THEN 'transport' ELSE 'telecom' END AS sector,
               -60e0 + (o_orderkey * 7919 % 120000) / 1e3 AS lat, -175e0 + (o_orderkey * 104729 % 350000) / 1e3 AS lon,
               o_orderstatus <> 'F' AS fetched, o_orderstatus = 'O' AND o_orderkey % 5 <> 0 AS passed,
               CASE o_orderkey % 3 WHEN 0 THEN 'sentinel2_ms' WHEN 1 THEN 'sentinel2_ms+sentinel1' ELSE 'sentinel2_rgb+naip' END AS modalities
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey""",
    "scenes_fx": """
        SELECT 'scene_' || CAST(o_orderkey AS VARCHAR(20)) AS item_id, o_orderdate AS taken,
               CASE WHEN o_orderkey % 6 <> 0 THEN CAST(o_orderkey * 37 % 100 AS DOUBLE) END AS cloud_cover,
               CASE o_orderkey % 2 WHEN 0 THEN 'landsat-8' ELSE 'landsat-7' END AS platform,
               -60e0 + (o_orderkey * 7919 % 120000) / 1e3 - 1e0 AS miny, -60e0 + (o_orderkey * 7919 % 120000) / 1e3 + 1e0 AS maxy,
               -175e0 + (o_orderkey * 104729 % 350000) / 1e3 - 1e0 AS minx, -175e0 + (o_orderkey * 104729 % 350000) / 1e3 + 1e0 AS maxx,
               CAST(o_orderkey AS BIGINT) AS scene_rank
        FROM orders""",
    # register pages as evidence in long form
    "evidence_fx": """
        SELECT 'osm_way_' || CAST(l_orderkey % 3000 AS VARCHAR(20)) AS asset_id, CAST(l_linenumber AS INT) AS seq,
               CASE l_linenumber % 4 WHEN 0 THEN 'lines' WHEN 1 THEN 'plants' WHEN 2 THEN 'registers' ELSE 'grid' END AS source,
               CASE WHEN l_linenumber % 3 = 0 THEN '' WHEN l_returnflag = 'R' THEN 'Caution: x' || CAST(l_partkey % 10 AS VARCHAR(20))
                    ELSE 'near ' || CAST(l_suppkey % 10 AS VARCHAR(20)) END AS text,
               l_returnflag = 'A' AS corroborated, l_returnflag = 'A' AND l_linestatus = 'F' AS auto_ok, l_orderkey AS k, l_partkey AS k2
        FROM lineitem""",
}


def uses(sql: str, names) -> list[str]:
    return [n for n in names if re.search(rf"\b{n}\b", sql)]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One view as a DataFrame; only the tables it uses are read."""
    sql = VIEWS[name]
    needed = [t for t in TABLES if re.search(rf"\b(FROM|JOIN) {t}\b", sql)]
    for table in needed:
        sql = re.sub(rf"\b(FROM|JOIN) {table}\b", rf"\1 {{{table}}}", sql)
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in needed}
    return spark.sql(sql, **frames)


def oracle(sql: str) -> str:
    """A query over views as one statement for the driver's tables."""
    needed: list[str] = []

    def add(text: str) -> None:
        for n in uses(text, VIEWS):
            if n not in needed:
                add(VIEWS[n])
                needed.append(n)

    add(sql)
    if not needed:
        return sql
    head = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in needed)
    body = sql.lstrip()
    recursive = body.upper().startswith("WITH RECURSIVE")
    if body.upper().startswith("WITH"):
        body = "," + body.split(None, 2 if recursive else 1)[2 if recursive else 1]
    return f"WITH {'RECURSIVE ' if recursive else ''}{head}\n{body}"
