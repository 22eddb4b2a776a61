"""Queries: evidence from registers, plants and lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartolith.fixtures import view
from cartolith.functions.geo import EVIDENCE_R
from cartolith.functions.names import DX, TX
from cartolith.operators import evidence
from cartolith.plans.curation import haversine
from cartolith.plans.queries import query


def tiles(spark, sf_dir):
    """Assets with the name of their site, so that some match the registers' names."""
    return view(spark, sf_dir, "assets_fx").withColumn("name", F.concat(F.lit("Riverside "), F.col("site").cast("string")))


def points(spark, sf_dir):
    return view(spark, sf_dir, "registers_fx")


_T = "(SELECT *, 'Riverside ' || CAST(site AS VARCHAR) AS title FROM assets_fx)"


def near_sql(within: float, keep: str = "true") -> str:
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY d, point_id) AS n FROM (SELECT a.asset_id, a.asset_type, p.point_id, p.name AS r_name, p.detail, p.implies, p.inactive, {haversine('a', 'p', EVIDENCE_R)} AS d
      FROM {_T} a JOIN registers_fx p ON abs(a.lat - p.lat) < 2e-1 WHERE {keep}) x WHERE d <= {within}) y"""


@query(f"SELECT asset_id, point_id, n, round(d, 3) AS metres FROM ({near_sql(600)}) z WHERE n <= 3")
def c3_nearest_three(spark, sf_dir):
    near = evidence.nearest(tiles(spark, sf_dir), points(spark, sf_dir), 600, 3, "point_id")
    return near.select("asset_id", F.col("r_point_id").alias("point_id"), "n", F.round("distance_m", 3).alias("metres"))


_REG = """CASE WHEN d <= 300 AND inactive THEN 'Caution: ' ELSE '' END || 'rail: ' || r_name || ' (' || detail || ') ' || CAST(CAST(round_even(d, 0) AS BIGINT) AS VARCHAR) || ' m away (matches OSM name)'"""


@query(f"""WITH g AS (SELECT asset_id, string_agg({_REG}, ' | ' ORDER BY n) AS text, bool_or(d <= 300 AND NOT inactive) AS ok FROM ({near_sql(600)}) z WHERE n <= 3 GROUP BY asset_id)
  SELECT a.asset_id, a.asset_type, 'rail' AS source, coalesce(text, 'rail: nothing within 0.6 km') AS text, coalesce(ok, false) AS corroborated, coalesce(ok, false) AS auto_ok FROM assets_fx a LEFT JOIN g ON g.asset_id = a.asset_id""")
def g18_register_evidence(spark, sf_dir):
    return evidence.register_evidence(tiles(spark, sf_dir), points(spark, sf_dir), "rail", 300)


@query(f"""WITH z AS (SELECT *, point_id % 3 AS k FROM ({near_sql(1500)}) y), g AS (SELECT asset_id, min(d) AS d, bool_or(d <= 1000 AND k = 1) AS ok, bool_or(d <= 300 AND k = 1 AND n <= 3) AS strict FROM z GROUP BY asset_id)
  SELECT a.asset_id, round_even(g.d, 0) AS nearest_m, coalesce(ok AND a.asset_type LIKE 'energy.generation%', false) AS corroborated FROM assets_fx a LEFT JOIN g ON g.asset_id = a.asset_id""")
def c4_plant_evidence(spark, sf_dir):
    """Plants within 1 500 m; the right kind within 1 000 m corroborates."""
    t = tiles(spark, sf_dir).withColumn("agrees", F.when(F.col("asset_type").startswith("energy.generation"), "solar"))
    kind = F.when(F.col("point_id") % 3 == 1, "solar").when(F.col("point_id") % 3 == 2, "batteries").otherwise("wind")
    plants = points(spark, sf_dir).select(F.col("point_id").alias("plant_id"), "name", kind.alias("kind"), F.lit(12.0).alias("mw"), "lat", "lon")
    return evidence.plant_evidence(t, plants).select("asset_id", "nearest_m", "corroborated")


@query(f"""SELECT a.asset_id, z.d IS NOT NULL AS listed, coalesce(z.d <= 250 AND a.asset_type = z.implies, false) AS corroborated,
  coalesce(z.d <= 250 AND a.asset_type <> z.implies, false) AS caution FROM assets_fx a LEFT JOIN ({near_sql(500)}) z ON z.asset_id = a.asset_id AND z.n = 1""")
def c5_grid_point_evidence(spark, sf_dir):
    """The nearest grid point: listed, agreeing, or a caution."""
    e = evidence.grid_point_evidence(tiles(spark, sf_dir), points(spark, sf_dir), "grid", 250)
    return e.select("asset_id", (~F.col("text").contains("no substation within")).alias("listed"), "corroborated", F.col("text").startswith("Caution").alias("caution"))


def lines(spark, sf_dir):
    l = view(spark, sf_dir, "lines_fx")
    end = lambda k: F.struct(F.col(f"lat{k}").alias("lat"), F.col(f"lon{k}").alias("lon"))
    return l.withColumn("ends", F.array(end(1), end(2)))


_ENDS = f"""SELECT DISTINCT asset_id, line_id, kv FROM (SELECT a.asset_id, p.line_id, p.kv, {haversine('a', 'p', EVIDENCE_R)} AS d FROM assets_fx a
  JOIN (SELECT line_id, kv, lat1 AS lat, lon1 AS lon FROM lines_fx UNION ALL SELECT line_id, kv, lat2, lon2 FROM lines_fx) p ON abs(a.lat - p.lat) < 1e-1) x WHERE d <= 400"""


@query(f"SELECT asset_id, line_id FROM ({_ENDS}) e")
def c6_lines_ending(spark, sf_dir):
    return evidence.ending_lines(tiles(spark, sf_dir), lines(spark, sf_dir), 400).select("asset_id", "line_id")


@query(f"""SELECT asset_id, count(*) AS lines, coalesce(string_agg(DISTINCT CAST(CAST(kv AS INT) AS VARCHAR), '/' ORDER BY CAST(CAST(kv AS INT) AS VARCHAR) DESC), '') AS kvs, count(*) FILTER (kv IS NULL) AS unknown, max(kv) AS max_kv
  FROM ({_ENDS}) e GROUP BY asset_id""")
def d16_line_summary(spark, sf_dir):
    s = evidence.line_summary(tiles(spark, sf_dir), lines(spark, sf_dir))
    # the twin sorts as text
    return s.withColumn("kvs", F.array_join(F.sort_array(F.array_distinct(F.filter(F.split("kvs", "/"), lambda x: x != "")), asc=False), "/"))


@query(f"""SELECT asset_id, array_to_string(list_transform(list_reverse_sort(list(DISTINCT CAST(kv AS INT)) FILTER (kv IS NOT NULL)), lambda x: CAST(x AS VARCHAR)), '/') AS kvs FROM ({_ENDS}) e GROUP BY asset_id HAVING count(kv) > 0""")
def d16_line_voltages(spark, sf_dir):
    """Whole kV of the lines that end at each tile, the highest first."""
    return evidence.line_summary(tiles(spark, sf_dir), lines(spark, sf_dir)).filter("kvs <> ''").select("asset_id", "kvs")


# lines that run north and south of where the view's begin: some end at tiles, some pass
_NORTH = "(SELECT *, lat1 - (line_id % 3) * 1e-2 AS la, lat1 + (line_id % 3) * 1e-2 AS lb FROM lines_fx)"
_MEET = f"""SELECT a.asset_id, l.*, least({haversine('a', 'p', EVIDENCE_R)}, {haversine('a', 'q', EVIDENCE_R)}) <= 250 AS here,
    abs((lon1 - a.lon) * cos(radians(a.lat)) * 111320e0) <= 300 AND (la - a.lat) * 111320e0 <= 300 AND (lb - a.lat) * 111320e0 >= -300 AS across
  FROM assets_fx a JOIN {_NORTH} l ON abs(l.lat1 - a.lat) < 5e-2 AND abs(l.lon1 - a.lon) < 5e-2
  JOIN (SELECT line_id, la AS lat, lon1 AS lon FROM {_NORTH} x) p ON p.line_id = l.line_id JOIN (SELECT line_id, lb AS lat, lon1 AS lon FROM {_NORTH} y) q ON q.line_id = l.line_id"""
_REAL = "CASE WHEN {c} <> '' AND NOT regexp_matches({c}, '^(UNKNOWN|TAP|DEADEND|NOT AVAILABLE)', 'i') THEN {c} END"
# the words of a line's end that tell which it is; 'Riverside' and numbers never are
_DESCRIBE = """array_to_string(list_filter([
    CASE WHEN count(kv) > 0 THEN array_to_string(list_transform(list_reverse_sort(list(DISTINCT CAST(kv AS INT)) FILTER (kv IS NOT NULL)), lambda x: CAST(x AS VARCHAR)), '/') || ' kV' END,
    CASE WHEN count(*) FILTER (kv IS NULL) > 0 THEN count(*) FILTER (kv IS NULL) || ' unknown voltage' END,
    CASE WHEN count(*) FILTER (traced) > 0 THEN count(*) FILTER (traced) || ' traced from OSM' END], lambda x: x IS NOT NULL), ', ')"""


@query(f"""WITH m AS (SELECT * FROM ({_MEET}) x WHERE here OR across), e AS (SELECT *, {_REAL.format(c='sub_1')} AS r1, {_REAL.format(c='sub_2')} AS r2 FROM m WHERE here),
  n AS (SELECT asset_id, list(name ORDER BY o) AS names FROM (SELECT asset_id, name, min(line_id * 2 + k) AS o FROM
      (SELECT asset_id, line_id, 0 AS k, r1 AS name FROM e UNION ALL SELECT asset_id, line_id, 1, r2 FROM e) u WHERE name IS NOT NULL GROUP BY asset_id, name) v GROUP BY asset_id),
  g AS (SELECT asset_id, count(*) AS lines_end, max(kv) FILTER (NOT traced) AS max_kv, {_DESCRIBE} AS says FROM e GROUP BY asset_id),
  p AS (SELECT asset_id, count(*) AS across, {_DESCRIBE} AS says FROM m WHERE NOT here GROUP BY asset_id), t AS (SELECT asset_id, count(*) FILTER (traced) AS traced_lines FROM m GROUP BY asset_id)
  SELECT a.asset_id, coalesce(lines_end, 0) AS lines_end, max_kv, coalesce(array_to_string(names, '; '), '') AS names, coalesce(traced_lines, 0) AS traced_lines, coalesce(max_kv >= 100, false) AS transmission,
    CASE WHEN lines_end > 0 THEN 'lines: ' || lines_end || ' line(s) end here (' || g.says || ')' WHEN across > 0 THEN 'lines: no line ends here; ' || across || ' pass within 300 m (' || p.says || ')' ELSE 'lines: no transmission line within 300 m' END
      || CASE WHEN len(names) > 0 THEN ' | lines line ends named: ' || array_to_string(names[1:4], ', ') ELSE '' END
      || CASE WHEN traced_lines > 0 THEN ' | Caution: ' || traced_lines || ' of these lines lines were traced from OSM, so they don''t count as independent' ELSE '' END AS text
  FROM assets_fx a LEFT JOIN g ON g.asset_id = a.asset_id LEFT JOIN n ON n.asset_id = a.asset_id LEFT JOIN p ON p.asset_id = a.asset_id LEFT JOIN t ON t.asset_id = a.asset_id""")
def d16_traced_lines(spark, sf_dir):
    """What the lines that end at each tile or cross it say of it."""
    up = (F.col("line_id") % 3) * 1e-2
    end = lambda y: F.struct((F.col("lat1") + y).alias("lat"), F.col("lon1").alias("lon"))
    north = view(spark, sf_dir, "lines_fx").withColumn("ends", F.array(end(-up), end(up)))
    return evidence.traced_line_evidence(tiles(spark, sf_dir).withColumn("name", F.lit("")), north, "lines").drop("name_match")


@query(f"""SELECT a.asset_id, count(m.line_id) AS lines_end, coalesce(bool_or(CASE a.pos % 3 WHEN 0 THEN m.line_id IS NOT NULL WHEN 1 THEN regexp_matches(sub_2, '(^| )widget( |$)') ELSE false END), false) AS name_match
  FROM assets_fx a LEFT JOIN (SELECT * FROM ({_MEET}) x WHERE here) m ON m.asset_id = a.asset_id GROUP BY a.asset_id""")
def d16_named_lines(spark, sf_dir):
    """Tiles whose name shares a word with a real name of a line that ends there."""
    up = (F.col("line_id") % 3) * 1e-2
    end = lambda y: F.struct((F.col("lat1") + y).alias("lat"), F.col("lon1").alias("lon"))
    north = view(spark, sf_dir, "lines_fx").withColumn("ends", F.array(end(-up), end(up)))
    name = F.when(F.col("pos") % 3 == 0, "West Substation 7").when(F.col("pos") % 3 == 1, "Widget switchyard").otherwise("Riverside 110 kV")
    return evidence.traced_line_evidence(tiles(spark, sf_dir).withColumn("name", name), north, "lines").select("asset_id", "lines_end", "name_match")


@query(f"""WITH e AS (SELECT asset_id, count(*) AS n, bool_or(kv >= 110) AS strong FROM ({_ENDS}) e GROUP BY asset_id)
  SELECT a.asset_id, coalesce(strong, false) AND a.asset_type = '{TX}' AS corroborated, coalesce(strong, false) AND a.asset_type <> '{TX}' AS caution, coalesce(n, 0) > 0 AS ends FROM assets_fx a LEFT JOIN e ON e.asset_id = a.asset_id""")
def g18_grid_line_evidence(spark, sf_dir):
    e = evidence.grid_line_evidence(tiles(spark, sf_dir), lines(spark, sf_dir), "lines", 400, 110, TX)
    return e.select("asset_id", "corroborated", F.col("text").startswith("Caution").alias("caution"), F.col("text").contains("end here").alias("ends"))


@query(f"SELECT asset_id, asset_type, 'map' AS source, 'Schematic map (map): ' || detail || ' about ' || printf('%.1f', round(d / 1000, 1)) || ' km away' AS text, false AS corroborated, false AS auto_ok FROM ({near_sql(5000)}) z WHERE n = 1")
def c8_schematic(spark, sf_dir):
    """The nearest schematic entry within 5 km, as a pointer that never confirms."""
    return evidence.schematic_evidence(tiles(spark, sf_dir), points(spark, sf_dir), "map")


@query("""SELECT node, list_sort(list(DISTINCT kv)) AS kvs FROM (SELECT sub_1 AS node, kv FROM lines_fx UNION ALL SELECT sub_2, kv FROM lines_fx) n WHERE kv IS NOT NULL GROUP BY node""")
def c9_node_voltages(spark, sf_dir):
    return evidence.node_voltages(lines(spark, sf_dir).withColumn("nodes", F.array("sub_1", "sub_2")))


_SHORT = """(SELECT line_id, kv, lat1 - (line_id % 7 + 1) * 1e-2 AS lat1, lon1 - (line_id % 5) * 1e-2 AS lon1, lat1 + (line_id % 7 + 1) * 1e-2 AS lat2,
  lon1 + (line_id % 5) * 1e-2 AS lon2 FROM lines_fx)"""


@query(f"""WITH s AS (SELECT a.asset_id, l.line_id, (lon1 - a.lon) * cos(radians(a.lat)) * 111320e0 AS u1, (lat1 - a.lat) * 111320e0 AS v1, (lon2 - a.lon) * cos(radians(a.lat)) * 111320e0 AS u2, (lat2 - a.lat) * 111320e0 AS v2,
    {haversine('a', 'p', EVIDENCE_R)} AS d1, {haversine('a', 'q', EVIDENCE_R)} AS d2
    FROM assets_fx a JOIN {_SHORT} l ON abs(l.lat1 - a.lat) < 2e-1 AND abs(l.lon1 - a.lon) < 2e-1 JOIN (SELECT line_id, lat1 AS lat, lon1 AS lon FROM {_SHORT} x) p ON p.line_id = l.line_id JOIN (SELECT line_id, lat2 AS lat, lon2 AS lon FROM {_SHORT} y) q ON q.line_id = l.line_id),
  t AS (SELECT *, u2 - u1 AS du, v2 - v1 AS dv FROM s WHERE d1 > 400 AND d2 > 400),
  c AS (SELECT asset_id, line_id, CASE WHEN abs(du) < 1e-9 THEN abs(u1) <= 300 ELSE true END AND CASE WHEN abs(dv) < 1e-9 THEN abs(v1) <= 300 ELSE true END AS inside,
    greatest(0, CASE WHEN abs(du) < 1e-9 THEN 0 ELSE least((-300 - u1) / du, (300 - u1) / du) END, CASE WHEN abs(dv) < 1e-9 THEN 0 ELSE least((-300 - v1) / dv, (300 - v1) / dv) END) AS low,
    least(1, CASE WHEN abs(du) < 1e-9 THEN 1 ELSE greatest((-300 - u1) / du, (300 - u1) / du) END, CASE WHEN abs(dv) < 1e-9 THEN 1 ELSE greatest((-300 - v1) / dv, (300 - v1) / dv) END) AS high FROM t)
  SELECT asset_id, line_id FROM c WHERE inside AND low <= high""")
def c7_lines_passing(spark, sf_dir):
    """Short lines that cross a tile and don't end at it."""
    l = view(spark, sf_dir, "lines_fx")
    up, right = (F.col("line_id") % 7 + 1) * 1e-2, (F.col("line_id") % 5) * 1e-2
    p = F.struct((F.col("lat1") - up).alias("lat"), (F.col("lon1") - right).alias("lon"))
    q = F.struct((F.col("lat1") + up).alias("lat"), (F.col("lon1") + right).alias("lon"))
    return evidence.passing_lines(tiles(spark, sf_dir), l.select("line_id", "kv", F.array(p, q).alias("ends")))


#: Vertices of a path of each line: (path, how far along, lat, lon) as SQL; a fourth of the lines have a second path.
_BENDS = (
    (0, 0, "lat1 - up", "lon1 - rt"), (0, 1, "lat1 - up / 2", "lon1 + rt + 3e-3"), (0, 2, "lat1 + (line_id % 3) * 2e-3", "lon1 - 4e-3"), (0, 3, "lat1 + up", "lon1 + rt"),
    (1, 0, "lat1 + 2e-2", "lon1 - 2e-2"), (1, 1, "lat1 + 2e-2", "lon1 + 1e-4"), (1, 2, "lat1 - 2e-2", "lon1 + 5e-4"),
)
_BENT = "(SELECT *, (line_id % 7 + 1) * 1e-2 AS up, (line_id % 5) * 1e-2 AS rt FROM lines_fx)"


@query(f"""WITH pt AS ({" UNION ALL ".join(f"SELECT line_id, {p} AS path, {i} AS i, {y} AS lat, {x} AS lon FROM {_BENT} l WHERE {p} = 0 OR line_id % 4 = 0" for p, i, y, x in _BENDS)}),
  seg AS (SELECT a.line_id, a.lat AS lat1, a.lon AS lon1, b.lat AS lat2, b.lon AS lon2 FROM pt a JOIN pt b ON a.line_id = b.line_id AND a.path = b.path AND b.i = a.i + 1),
  t AS (SELECT asset_id, line_id, (lon1 - a.lon) * cos(radians(a.lat)) * 111320e0 AS u1, (lat1 - a.lat) * 111320e0 AS v1, (lon2 - lon1) * cos(radians(a.lat)) * 111320e0 AS du, (lat2 - lat1) * 111320e0 AS dv
    FROM assets_fx a JOIN seg l ON abs(l.lat1 - a.lat) < 2e-1 AND abs(l.lon1 - a.lon) < 2e-1),
  c AS (SELECT asset_id, line_id, CASE WHEN abs(du) < 1e-9 THEN abs(u1) <= 300 ELSE true END AND CASE WHEN abs(dv) < 1e-9 THEN abs(v1) <= 300 ELSE true END AS inside,
    greatest(0, CASE WHEN abs(du) < 1e-9 THEN 0 ELSE least((-300 - u1) / du, (300 - u1) / du) END, CASE WHEN abs(dv) < 1e-9 THEN 0 ELSE least((-300 - v1) / dv, (300 - v1) / dv) END) AS low,
    least(1, CASE WHEN abs(du) < 1e-9 THEN 1 ELSE greatest((-300 - u1) / du, (300 - u1) / du) END, CASE WHEN abs(dv) < 1e-9 THEN 1 ELSE greatest((-300 - v1) / dv, (300 - v1) / dv) END) AS high FROM t),
  e AS (SELECT a.asset_id, p.line_id FROM assets_fx a JOIN pt p ON abs(p.lat - a.lat) < 1e-1 AND abs(p.lon - a.lon) < 1e-1 WHERE (path, i) IN ((0, 0), (0, 3), (1, 0), (1, 2)) AND {haversine('a', 'p', EVIDENCE_R)} <= 400)
  SELECT DISTINCT asset_id, line_id FROM c WHERE inside AND low <= high AND NOT EXISTS (SELECT 1 FROM e WHERE e.asset_id = c.asset_id AND e.line_id = c.line_id)""")
def c7_bent_lines_passing(spark, sf_dir):
    """Lines of several vertices, some of two paths, that cross a tile and end elsewhere."""
    l = view(spark, sf_dir, "lines_fx").withColumn("up", (F.col("line_id") % 7 + 1) * 1e-2).withColumn("rt", (F.col("line_id") % 5) * 1e-2)
    path = lambda k: F.array(*(F.struct(F.expr(y).alias("lat"), F.expr(x).alias("lon")) for p, _, y, x in _BENDS if p == k))
    paths = F.when(F.col("line_id") % 4 == 0, F.array(path(0), path(1))).otherwise(F.array(path(0)))
    return evidence.passing_lines(tiles(spark, sf_dir), l.select("line_id", "kv", paths.alias("paths")))


def landed(spark, sf_dir):
    """The suppliers as rows of a landed register: key, title, lat, lon, kind (0 to 6), place, all as text but the key."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    k = F.col("s_suppkey")
    return s.select(
        k.alias("k"), F.col("s_name").alias("title"), F.when(k % 17 != 0, -60.0 + (k * 7919 % 120000) / 1e3).alias("lat"), (-175.0 + (k * 104729 % 350000) / 1e3).alias("lon"),
        (k % 7).cast("int").alias("kind"), F.when(k % 5 != 0, F.col("s_nationkey").cast("string")).alias("place"),
    )


_LANDED = """(SELECT s_suppkey AS k, s_name AS title, CASE WHEN s_suppkey % 17 <> 0 THEN -60e0 + (s_suppkey * 7919 % 120000) / 1e3 END AS lat, -175e0 + (s_suppkey * 104729 % 350000) / 1e3 AS lon,
  s_suppkey % 7 AS kind, CASE WHEN s_suppkey % 5 <> 0 THEN CAST(s_nationkey AS VARCHAR) END AS place FROM supplier)"""


def _pointed(register: str, name: str, detail: str, implies: str = "CAST(NULL AS VARCHAR)", inactive: str = "false", keep: str = "true") -> str:
    return f"SELECT '{register}' AS register, {name} AS name, lat, lon, {detail} AS detail, {implies} AS implies, {inactive} AS inactive FROM {_LANDED} l WHERE lat IS NOT NULL AND ({keep})"


@query(" UNION ALL ".join((
    _pointed("nodes", "title", "'Trafikverket ' || coalesce(place, '')"),
    _pointed("irish", "title", "'Irish rail stop ' || CAST(k AS VARCHAR)", keep="kind = 2"),
    _pointed("halls", "title", "'SNCF station UIC ' || coalesce(place, 'None')"),
    _pointed("national", "title", "'GA station, ' || CASE kind WHEN 0 THEN 'abandoned' WHEN 1 THEN 'operational' ELSE '' END || ', ' || coalesce(place, '')", inactive="kind = 0", keep="kind NOT IN (3, 4)"),
    _pointed("feed", "title", "'Digitraffic stopping point S' || CAST(k AS VARCHAR)", keep="kind < 4"),
)))
def a16_station_registers(spark, sf_dir):
    """Station registers in one shape."""
    from cartolith.sources import registers

    l = landed(spark, sf_dir)
    kind = F.col("kind")
    tables = {
        "nodes": registers.station_nodes(l.select(F.col("title").alias("geographicalName"), F.col("place").alias("formOfNode"), F.array("lat", "lon").alias("coordinates"))),
        "irish": registers.irish_stops(l.select(F.when(kind == 2, "RLY").otherwise("BCT").alias("StopType"), F.col("title").alias("CommonName"), F.col("k").alias("AtcoCode"), F.col("lat").alias("Latitude"), F.col("lon").alias("Longitude"))),
        "halls": registers.passenger_halls(l.select(F.col("title").alias("nom"), F.col("place").alias("codes_uic"), F.struct("lat", "lon").alias("position_geographique"))),
        "national": registers.national_stations(l.select(
            F.concat("title", F.when(kind == 1, " RAILWAY STATION").otherwise("")).alias("name"), F.when(kind == 0, "Abandoned").when(kind == 1, "Operational").alias("operationalstatus"),
            F.when(kind == 3, "OSM").when(kind == 4, "osm").when(kind == 5, "traced from OpenStreetMap").alias("feature_source"), F.col("place").alias("state"), "lat", "lon")),
        "feed": registers.passenger_stations(l.select(
            F.col("title").alias("stationName"), F.concat(F.lit("S"), F.col("k").cast("string")).alias("stationShortCode"), F.lit("STOPPING_POINT").alias("type"),
            F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), (kind < 4).alias("passengerTraffic"))),
    }
    return _together(tables)


def _together(tables):
    out = None
    for name, df in tables.items():
        df = df.select(F.lit(name).alias("register"), *df.columns)
        out = df if out is None else out.union(df)
    return out


_VOLTS = "[33e0, 66e0, 110e0, 220e0, 400e0, 0e0, 132e0][kind + 1]"


@query(" UNION ALL ".join((
    _pointed("complexes", "title || [' ZONE SUBSTATION', ' TRANSMISSION SUBSTATION', ' BULK SUPPLY SUBSTATION', ' SUBSTATION', ' DEPOT', ' SUBSTATION', ' SWITCHING STATION SUBSTATION'][kind + 1]", "'NSW Features of Interest'",
             f"CASE WHEN kind = 0 THEN '{DX}' WHEN kind IN (1, 2, 6) THEN '{TX}' END", keep="kind <> 4"),
    _pointed("facilities", "title", "'Vicmap ' || CASE WHEN kind < 2 THEN 'power terminal station' ELSE 'power sub station' END", f"CASE WHEN kind < 2 THEN '{TX}' ELSE '{DX}' END", keep="kind < 5"),
    _pointed("posts", "''", "'OSINERGMIN SED ' || CAST(k AS VARCHAR) || ' (' || title || ')'"),
    _pointed("communal", "''", "'Enedis poste HTA/BT, ' || coalesce(place, '')"),
    _pointed("labelled", "title", "'KPLC primary substation ' || title || CASE WHEN kind < 5 THEN ' ( ' || CAST(CAST(" + _VOLTS + " AS INT) AS VARCHAR) || ' / 11 KV)' ELSE '' END",
             f"CASE WHEN kind >= 5 THEN '{DX}' WHEN {_VOLTS} < 100 THEN '{DX}' END"),
    _pointed("typed", "title", "'ZESCO substation' || CASE WHEN " + _VOLTS + " > 0 THEN ', ' || CAST(CAST(" + _VOLTS + " AS INT) AS VARCHAR) || ' kV' ELSE '' END",
             f"CASE WHEN {_VOLTS} >= 220 THEN '{TX}' WHEN {_VOLTS} >= 100 THEN NULL ELSE '{DX}' END"),
    _pointed("transformers", "title", "'Secretaría de Energía ET, ' || CAST(CAST(" + _VOLTS + " AS INT) AS VARCHAR) || ' kV in, 132 kV out'", f"CASE WHEN {_VOLTS} >= 1 THEN '{TX}' END"),
    _pointed("schematic", "title", "CASE WHEN kind < 2 THEN 'a ' || CAST(kind * 11 + 66 AS VARCHAR) || ' kV substation' ELSE 'a grid node at ' || title || ' (city)' || CASE WHEN kind > 2 THEN ' on ' || CAST(kind * 11 AS VARCHAR) || ' kV lines' ELSE '' END END"),
)))
def a17_grid_registers(spark, sf_dir):
    """Operators' substations in one shape, with the type that each implies."""
    from cartolith.sources import registers

    l = landed(spark, sf_dir)
    kind = F.col("kind")
    volts = F.element_at(F.array(*(F.lit(v) for v in (33, 66, 110, 220, 400, 0, 132))), kind + 1)
    words = F.element_at(F.array(*(F.lit(w) for w in (" ZONE SUBSTATION", " TRANSMISSION SUBSTATION", " BULK SUPPLY SUBSTATION", " SUBSTATION", " DEPOT", " SUBSTATION", " SWITCHING STATION SUBSTATION"))), kind + 1)
    joined = l.select(F.array("title").alias("nodes"), F.when(kind > 2, kind * 11).alias("kv"))
    tables = {
        "complexes": registers.named_complexes(l.select(F.concat("title", words).alias("generalname"), F.col("lat").alias("y"), F.col("lon").alias("x"))),
        "facilities": registers.power_facilities(l.select(F.col("title").alias("name"), F.when(kind < 2, "power terminal station").when(kind < 5, "power sub station").otherwise("power station").alias("feature_subtype"), "lat", "lon")),
        "posts": registers.distribution_posts(l.select(F.col("title").alias("CODEMP"), F.col("k").cast("string").alias("CODSED"), "lat", "lon")),
        "communal": registers.communal_posts(l.select(F.col("place").alias("nom_commune"), "lat", "lon")),
        "labelled": registers.labelled_substations(l.select(F.concat("title", F.when(kind < 5, F.format_string(" ( %d / 11 KV)", volts)).otherwise("")).alias("Name_IMS11"), F.lit("x").alias("Name8"), "lat", "lon")),
        "typed": registers.typed_by_voltage(l.select(F.col("title").alias("NAME"), F.when(volts > 0, volts.cast("string")).otherwise("n/a").alias("VOLATGELEV"), "lat", "lon")),
        "transformers": registers.transformer_stations(l.select(F.col("title").alias("NOMBRE"), volts.cast("string").alias("TENSION_EN"), F.lit("132").alias("TENSION_SA"), "lat", "lon")),
        "schematic": registers.schematic_points(l.select(
            F.col("title").alias("name"), F.when(kind >= 2, "city").alias("node_type"), F.format_string("%d / 11 kV", kind * 11 + 66).alias("text"), "lat", "lon"), joined),
    }
    return _together(tables)
