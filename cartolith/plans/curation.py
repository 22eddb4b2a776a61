"""Queries: rules, names, geometry, de-duplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolith import ontology
from cartolith.fixtures import view
from cartolith.functions import geo, names, tags
from cartolith.operators import dedup
from cartolith.plans.queries import query

HAVERSINE = """2 * {r} * asin(least(1e0, sqrt(pow(sin(radians({b}.lat - {a}.lat) / 2), 2)
    + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2))))"""


def haversine(a: str, b: str, r: float = geo.DEDUP_R) -> str:
    return HAVERSINE.format(a=a, b=b, r=f"{r}e0")


#: Radius by class in SQL.
RADIUS = "CASE asset_type " + " ".join(f"WHEN '{c.name}' THEN {c.radius_m}e0" for c in ontology.CLASSES) + " ELSE 200e0 END"


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The element view with its tags as a map."""
    raw = view(spark, sf_dir, "elements_fx")
    keys = {"power": "t_power", "substation": "t_substation", "plant:source": "t_source", "man_made": "t_man_made",
            "content": "t_content", "aeroway": "t_aeroway", "railway": "t_railway", "train": "t_train", "name": "t_name",
            "harbour": "t_harbour", "building": "t_building", "voltage": "voltage"}
    made = F.map_filter(F.create_map(*(x for k, c in keys.items() for x in (F.lit(k), F.col(c)))), lambda k, v: v.isNotNull())
    return raw.select("osm_type", "osm_id", made.alias("tags"), "area_m2")


BEST = """CASE
  WHEN t_power = 'substation' AND t_substation = 'transmission' AND NOT tower THEN 'energy.transmission.substation'
  WHEN t_power = 'substation' AND t_substation = 'distribution' AND NOT tower THEN 'energy.distribution.substation'
  WHEN t_power = 'substation' AND t_substation = 'minor_distribution' AND NOT tower THEN 'energy.distribution.substation_minor'
  WHEN t_power = 'substation' AND NOT tower THEN 'energy.distribution.substation_untyped'
  WHEN t_power = 'plant' AND t_source = 'solar' AND osm_type <> 'node' THEN 'energy.generation.solar_farm'
  WHEN t_power = 'plant' AND t_source = 'wind' AND osm_type <> 'node' THEN 'energy.generation.wind_farm'
  WHEN t_power = 'plant' AND coalesce(t_source, '') NOT IN ('solar', 'wind') THEN 'energy.generation.power_plant'
  WHEN t_man_made = 'wastewater_plant' THEN 'water.wastewater.plant'
  WHEN t_man_made = 'water_works' THEN 'water.water_works'
  WHEN t_man_made = 'storage_tank' AND t_content = 'water' THEN 'water.storage_tank'
  WHEN t_aeroway = 'aerodrome' AND osm_type <> 'node' AND area_m2 >= 500000 THEN 'transport.airport'
  WHEN t_railway = 'station' AND (t_name IS NOT NULL OR t_train = 'yes') THEN 'transport.train_station'
  WHEN t_harbour = 'yes' AND osm_type <> 'node' AND area_m2 >= 200000 THEN 'transport.port_terminal'
  WHEN t_building = 'data_center' THEN 'telecom.data_center' END"""
CLASSIFIED = f"""SELECT *, {BEST} AS asset_type FROM (SELECT *, coalesce(t_building = 'transformer_tower', false) AS tower FROM elements_fx) e"""


@query(f"SELECT osm_type, osm_id, asset_type FROM ({CLASSIFIED}) c WHERE asset_type IS NOT NULL")
def b6_best_class(spark, sf_dir):
    """Each element's first accepting class."""
    found = tags.anchored(elements(spark, sf_dir))
    best = tags.best_class(F.col("tags"), F.col("osm_type"), F.col("area_m2"))
    return found.select("osm_type", "osm_id", best.alias("asset_type")).filter("asset_type is not null")


@query(f"SELECT asset_type, count(*) AS n FROM ({CLASSIFIED}) c WHERE asset_type IS NOT NULL GROUP BY asset_type")
def d1_class_counts(spark, sf_dir):
    return b6_best_class(spark, sf_dir).groupBy("asset_type").agg(F.count("*").alias("n"))


@query("""SELECT osm_type, osm_id, coalesce(t_power = 'substation', false) AND coalesce(t_substation = 'transmission', false) AS all_ok,
  coalesce(t_name IS NOT NULL OR t_train = 'yes', false) AS any_ok, NOT coalesce(t_building = 'transformer_tower', false) AS none_ok,
  osm_type IN ('way', 'relation') AS area_ok FROM elements_fx""")
def b1_b4_tag_predicates(spark, sf_dir):
    t = F.col("tags")
    return elements(spark, sf_dir).select(
        "osm_type",
        "osm_id",
        tags.all_match(t, (("power", "substation"), ("substation", "transmission"))).alias("all_ok"),
        tags.any_match(t, (("name", None), ("train", "yes"), ("public_transport", "station"))).alias("any_ok"),
        tags.none_match(t, (("building", "transformer_tower"),)).alias("none_ok"),
        tags.geometry_allowed("way_or_relation", F.col("osm_type")).alias("area_ok"),
    )


@query("""SELECT osm_type, osm_id FROM elements_fx WHERE t_power IS NOT NULL OR t_man_made IS NOT NULL OR t_aeroway IS NOT NULL
  OR t_railway IS NOT NULL OR t_harbour IS NOT NULL OR t_building IS NOT NULL""")
def b10_anchor_filter(spark, sf_dir):
    return tags.anchored(elements(spark, sf_dir)).select("osm_type", "osm_id")


@query(f"""SELECT coalesce(CASE asset_type WHEN 'energy.distribution.substation_minor' THEN 'energy.distribution.other'
  WHEN 'energy.distribution.substation_untyped' THEN 'energy.distribution.other' WHEN 'water.water_works' THEN 'water.treatment.plant'
  ELSE asset_type END, 'unmapped') AS coarse, count(*) AS n FROM ({CLASSIFIED}) c GROUP BY 1""")
def b14_coarse_classes(spark, sf_dir):
    """Elements by coarse class; what no class accepts is counted as unmapped."""
    best = tags.best_class(F.col("tags"), F.col("osm_type"), F.col("area_m2"))
    mapping = F.create_map(*(F.lit(x) for pair in ontology.COARSE.items() for x in pair))
    named = elements(spark, sf_dir).select(best.alias("c"))
    coarse = F.coalesce(F.try_element_at(mapping, F.col("c")), "c", F.lit("unmapped"))
    return named.groupBy(coarse.alias("coarse")).agg(F.count("*").alias("n"))


@query("""SELECT osm_type, osm_id, greatest(CAST(split_part(voltage, ';', 1) AS DOUBLE), CAST(split_part(voltage, ';', 2) AS DOUBLE)) / 1000 AS max_kv
  FROM elements_fx""")
def b25_max_kv(spark, sf_dir):
    return elements(spark, sf_dir).select("osm_type", "osm_id", tags.max_kv(F.col("tags")["voltage"]).alias("max_kv"))


HINTS = """SELECT osm_id, 'OSM tags: ' || concat_ws(', ', 'power=' || t_power, 'substation=' || t_substation, 'voltage=' || voltage, 'plant:source=' || t_source,
  'railway=' || t_railway, 'aeroway=' || t_aeroway, 'man_made=' || t_man_made, 'content=' || t_content, 'harbour=' || t_harbour, 'building=' || t_building)
  || CASE WHEN kv > 0 THEN ' (max ' || CAST(CAST(kv AS BIGINT) AS VARCHAR) || ' kV)' ELSE '' END AS hint
  FROM (SELECT *, greatest(CAST(split_part(voltage, ';', 1) AS BIGINT), CAST(split_part(voltage, ';', 2) AS BIGINT)) / 1000 AS kv FROM elements_fx) e"""


@query(HINTS)
def b27_tag_hints(spark, sf_dir):
    return elements(spark, sf_dir).select("osm_id", tags.hint_text(F.col("tags")).alias("hint"))


_PATTERN_SQL = {
    "solar": r"(?i)\b(solar|photovolta)",
    "plant": r"(?i)\b(power station|power plant|generating station|centrale)\b",
    "sub": r"(?i)\b(substation|switchyard|umspannwerk|subestaci[oó]n|poste source)\b",
    "waste": r"(?i)(sewage|waste ?water|wwtp|effluent|kl[äa]ranlage|depuradora|[ée]puration|rioolwaterzuivering)",
    "water": r"(?i)\b(water ?works|drinking|potable|water treatment)\b",
    "data": r"(?i)\b(data ?cent(er|re)|datacenter)\b",
    "air": r"(?i)(^|[^a-z])(airport|aerodrome|airfield|aeropuerto|a[ée]roport)($|[^a-z])",
}


def _hint(key: str, target: str) -> str:
    return f"WHEN regexp_matches(name, '{_PATTERN_SQL[key]}') THEN CASE WHEN label = '{target}' THEN '' ELSE '{target}' END"


@query(f"""SELECT doc_id, CASE {_hint("solar", "energy.generation.solar_farm")} {_hint("plant", "energy.generation.power_plant")}
  WHEN regexp_matches(name, '{_PATTERN_SQL["sub"]}') THEN CASE WHEN contains(label, 'substation') THEN '' ELSE 'a substation' END
  {_hint("waste", "water.wastewater.plant")} {_hint("water", "water.treatment.plant")} {_hint("data", "telecom.data_center")}
  {_hint("air", "transport.airport")} ELSE '' END AS name_hint FROM names_fx""")
def b20_name_hints(spark, sf_dir):
    return view(spark, sf_dir, "names_fx").select("doc_id", names.name_hint(F.col("name"), F.col("label")).alias("name_hint"))


@query(rf"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(regexp_replace(lower(name),
  '\b({names.FILLER}|[0-9]+)\b', ' ', 'g'), '[a-z]+'), lambda x: length(x) > 2))), ' ') AS tokens FROM names_fx""")
def b21_name_tokens(spark, sf_dir):
    words = F.array_join(F.array_sort(names.tokens(F.col("name"))), " ")
    return view(spark, sf_dir, "names_fx").select("doc_id", words.alias("tokens"))


@query("""SELECT doc_id, len(k) AS n, list_max(k) AS top, CASE WHEN len(k) > 0 THEN CASE WHEN list_min(k) >= 100 THEN 'energy.transmission.substation'
  WHEN list_max(k) < 100 THEN 'energy.distribution.substation' END END AS implied,
  CASE WHEN list_max(k) >= 220 THEN 'energy.transmission.substation' WHEN list_max(k) >= 100 THEN NULL ELSE 'energy.distribution.substation' END AS allowed
  FROM (SELECT doc_id, list_filter(list_transform(regexp_extract_all(replace(name, ',', '.'), '[0-9]+(?:[.][0-9]+)?'), lambda x: CAST(x AS DOUBLE)), lambda x: x BETWEEN 1 AND 1200) AS k
  FROM names_fx) n""")
def b22_b24_voltages(spark, sf_dir):
    k = names.kvs(F.col("name"))
    return view(spark, sf_dir, "names_fx").select(
        "doc_id",
        F.size(k).alias("n"),
        F.array_max(k).alias("top"),
        names.by_voltage(k, F.array().cast("array<double>")).alias("implied"),
        names.top_voltage_kind(F.lit(names.DX), F.array_max(k)).alias("allowed"),
    )


@query("""SELECT line_id, list_sort(list_filter([sub_1, sub_2], lambda x: NOT regexp_matches(x, '(?i)^(UNKNOWN|TAP|DEADEND|NOT AVAILABLE)'))) AS names FROM lines_fx""")
def b26_placeholder_ends(spark, sf_dir):
    ends = F.filter(F.array("sub_1", "sub_2"), lambda x: ~x.rlike(names.PLACEHOLDER))
    return view(spark, sf_dir, "lines_fx").select("line_id", F.array_sort(ends).alias("names"))


@query("""SELECT asset_id, split_part(asset_id, '_', 2) AS osm_type, CAST(split_part(asset_id, '_', 3) AS BIGINT) AS osm_id,
  'https://www.openstreetmap.org/' || split_part(asset_id, '_', 2) || '/' || split_part(asset_id, '_', 3) AS url,
  translate(asset_type || '/' || name, '/:', '__') AS safe, lower(trim(region)) AS region FROM assets_fx""")
def b17_b28_ids(spark, sf_dir):
    a = view(spark, sf_dir, "assets_fx")
    kind, number = names.osm_parts(F.col("asset_id"))
    return a.select(
        "asset_id",
        kind.alias("osm_type"),
        number.alias("osm_id"),
        names.element_url(F.col("asset_id")).alias("url"),
        names.safe_id(F.concat_ws("/", "asset_type", "name")).alias("safe"),
        F.lower(F.trim("region")).alias("region"),
    )


@query("""SELECT asset_id FROM assets_fx WHERE (lat BETWEEN 24 AND 50 AND lon BETWEEN -125 AND -66) OR (lat BETWEEN 51 AND 72 AND lon BETWEEN -170 AND -129)
  OR (lat BETWEEN 18.8e0 AND 22.4e0 AND lon BETWEEN -160.5e0 AND -154.6e0) OR (lat BETWEEN 17.8e0 AND 18.6e0 AND lon BETWEEN -67.4e0 AND -65.2e0)""")
def b16_region_boxes(spark, sf_dir):
    return view(spark, sf_dir, "assets_fx").filter(geo.in_boxes(F.col("lat"), F.col("lon"), geo.US_BOXES)).select("asset_id")


@query("""SELECT asset_id, round(lat - 300e0 / 111320e0, 6) AS miny, round(lon - 300e0 / (cos(radians(lat)) * 111320e0), 6) AS minx,
  round(lat + 300e0 / 111320e0, 6) AS maxy, round(lon + 300e0 / (cos(radians(lat)) * 111320e0), 6) AS maxx,
  'https://www.openstreetmap.org/#map=15/' || CAST(CAST(floor(lat) AS BIGINT) AS VARCHAR) || '/' || CAST(CAST(floor(lon) AS BIGINT) AS VARCHAR) AS url FROM assets_fx""")
def b18_b31_boxes(spark, sf_dir):
    box = geo.centroid_to_bbox(F.col("lat"), F.col("lon"), 300.0)
    url = F.concat(F.lit("https://www.openstreetmap.org/#map=15/"), F.floor("lat").cast("string"), F.lit("/"), F.floor("lon").cast("string"))
    return view(spark, sf_dir, "assets_fx").select("asset_id", *(F.round(c, 6).alias(k) for k, c in box.items()), url.alias("url"))


_PREV = "lag({c}) OVER (PARTITION BY site ORDER BY pos)"


@query(f"""SELECT asset_id, round(d, 3) AS metres, round(x, 3) AS x_m, round(y, 3) AS y_m FROM (
  SELECT b.asset_id, {haversine("a", "b")} AS d, (b.lon - a.lon) * cos(radians(a.lat)) * 111320e0 AS x, (b.lat - a.lat) * 111320e0 AS y
  FROM assets_fx a JOIN assets_fx b ON a.site = b.site AND b.pos = a.pos + 1) t""")
def g1_g2_distances(spark, sf_dir):
    """Distance of each asset to the one before it on its site, on the sphere and on the local plane."""
    a = view(spark, sf_dir, "assets_fx").select("site", (F.col("pos") + 1).alias("pos"), F.col("lat").alias("lat0"), F.col("lon").alias("lon0"))
    both = view(spark, sf_dir, "assets_fx").join(a, ["site", "pos"])
    x, y = geo.local_metres(F.col("lat"), F.col("lon"), F.col("lat0"), F.col("lon0"))
    d = geo.haversine_m(F.col("lat0"), F.col("lon0"), F.col("lat"), F.col("lon"))
    return both.select("asset_id", F.round(d, 3).alias("metres"), F.round(x, 3).alias("x_m"), F.round(y, 3).alias("y_m"))


@query("""SELECT a.asset_id, b.asset_id AS other, round(greatest(0e0, least(a.lon, b.lon) + 2e-3 - greatest(a.lon, b.lon)) * greatest(0e0, least(a.lat, b.lat) + 2e-3 - greatest(a.lat, b.lat)) * 1e9) AS overlap
  FROM assets_fx a JOIN assets_fx b ON a.site = b.site AND a.pos < b.pos""")
def b19_box_overlap(spark, sf_dir):
    a = view(spark, sf_dir, "assets_fx").select("site", "asset_id", "pos", "lat", "lon")
    b = a.select("site", *(F.col(c).alias(f"{c}2") for c in ("asset_id", "pos", "lat", "lon")))
    box = lambda la, lo: {"minx": F.col(lo), "maxx": F.col(lo) + 2e-3, "miny": F.col(la), "maxy": F.col(la) + 2e-3}
    both = a.join(b, "site").filter("pos < pos2")
    area = geo.bbox_overlap(box("lat", "lon"), box("lat2", "lon2"))
    return both.select("asset_id", F.col("asset_id2").alias("other"), F.round(area * 1e9).alias("overlap"))


PAIRS = f"""SELECT a.asset_id AS lo, b.asset_id AS hi, {haversine("a", "b")} AS d, a.r FROM (SELECT *, {RADIUS} AS r FROM assets_fx) a
  JOIN assets_fx b ON a.asset_type = b.asset_type AND a.pos < b.pos AND abs(a.lat - b.lat) < 2e-2"""


@query(f"SELECT lo, hi, round(d, 3) AS metres FROM ({PAIRS}) p WHERE d <= r")
def c1_radius_self_join(spark, sf_dir):
    """Pairs of assets of a class within its radius."""
    pairs = dedup.neighbours(dedup.with_radius(view(spark, sf_dir, "assets_fx")))
    return pairs.select("lo", "hi", F.round("distance_m", 3).alias("metres"))


# The walk in order, one row of every class a step, as a recursive query.
GREEDY = f"""WITH RECURSIVE ranked AS (SELECT *, row_number() OVER (PARTITION BY asset_type ORDER BY pos) AS i FROM assets_fx),
  near AS (SELECT hi, list(lo) AS los FROM ({PAIRS}) p WHERE d <= r GROUP BY hi),
  walk AS (
    SELECT asset_type, 0 AS i, CAST([] AS VARCHAR[]) AS kept, CAST(NULL AS VARCHAR) AS asset_id, false AS ok FROM (SELECT DISTINCT asset_type FROM assets_fx) c
    UNION ALL
    SELECT w.asset_type, w.i + 1, CASE WHEN list_has_any(coalesce(n.los, []), w.kept) THEN w.kept ELSE list_append(w.kept, r.asset_id) END,
           r.asset_id, NOT list_has_any(coalesce(n.los, []), w.kept)
    FROM walk w JOIN ranked r ON r.asset_type = w.asset_type AND r.i = w.i + 1 LEFT JOIN near n ON n.hi = r.asset_id),
  verdict AS (SELECT asset_id, asset_type, ok FROM walk WHERE asset_id IS NOT NULL),
  edges AS (SELECT lo, hi, d FROM ({PAIRS}) p WHERE d <= r UNION ALL SELECT hi, lo, d FROM ({PAIRS}) p WHERE d <= r),
  best AS (SELECT e.hi AS asset_id, e.lo AS deduplicated_by, row_number() OVER (PARTITION BY e.hi ORDER BY e.d, e.lo) AS n
    FROM edges e JOIN verdict v ON v.asset_id = e.lo AND v.ok)"""


@query(f"""{GREEDY} SELECT v.asset_id, v.ok AS kept, CASE WHEN NOT v.ok THEN b.deduplicated_by END AS deduplicated_by
  FROM verdict v LEFT JOIN best b ON b.asset_id = v.asset_id AND b.n = 1""")
def e1_c2_greedy_dedup(spark, sf_dir):
    """Each asset: kept or removed, and by which survivor."""
    return dedup.deduplicate(view(spark, sf_dir, "assets_fx")).select("asset_id", "kept", "deduplicated_by")


@query(f"""{GREEDY} SELECT asset_type, count(*) FILTER (ok) AS kept, count(*) FILTER (NOT ok) AS removed, count(*) AS total,
  round(1e2 * count(*) FILTER (NOT ok) / count(*), 2) AS removed_pct, max({RADIUS}) AS radius_m FROM verdict GROUP BY asset_type""")
def d2_dedup_summary(spark, sf_dir):
    """Flagship: assets de-duplicated by the radius of their class, summed up by class."""
    return dedup.summary(dedup.deduplicate(view(spark, sf_dir, "assets_fx")))


@query(f"""{GREEDY}, after AS (SELECT v.asset_id, v.ok AS kept, CASE WHEN NOT v.ok THEN CASE WHEN pos % 43 = 0 THEN 'nobody' ELSE b.deduplicated_by END END AS via FROM verdict v
    JOIN assets_fx a ON a.asset_id = v.asset_id LEFT JOIN best b ON b.asset_id = v.asset_id AND b.n = 1 WHERE pos % 37 <> 0)
  SELECT asset_id, 'lost' AS rule FROM assets_fx WHERE pos % 37 = 0 UNION ALL SELECT 'x' || asset_id, 'invented' FROM assets_fx WHERE pos % 41 = 0
  UNION ALL SELECT asset_id, 'no_survivor' FROM after WHERE NOT kept AND (via IS NULL OR via NOT IN (SELECT asset_id FROM after WHERE kept))""")
def j11_conservation(spark, sf_dir):
    """Violations of a de-duplicated table from which rows were taken and to which some were added."""
    a = view(spark, sf_dir, "assets_fx")
    out = dedup.deduplicate(a).select("asset_id", "kept", "deduplicated_by", "pos")
    by = F.when(~F.col("kept") & (F.col("pos") % 43 == 0), "nobody").otherwise(F.col("deduplicated_by"))
    more = a.filter("pos % 41 = 0").select(F.concat(F.lit("x"), "asset_id").alias("asset_id"), F.lit(True).alias("kept"), F.lit(None).cast("string").alias("deduplicated_by"), "pos")
    return dedup.conservation(a, out.filter("pos % 37 <> 0").withColumn("deduplicated_by", by).unionByName(more))


@query(f"SELECT asset_id, {RADIUS} AS radius_m FROM assets_fx")
def e2_class_radius(spark, sf_dir):
    return dedup.with_radius(view(spark, sf_dir, "assets_fx")).select("asset_id", "radius_m")


_Q = "0.006694379990141317e0"
_SINB = """(1 - 0.0066943799901413165e0) * (s / (1 - 0.0066943799901413165e0 * s * s) - ln((1 - 0.08181919084262149e0 * s) / (1 + 0.08181919084262149e0 * s)) / (2 * 0.08181919084262149e0)) / 1.995531087388263e0"""


@query(f"""SELECT asset_id, CAST(floor(2 * sqrt(3e0) * 6371007.180918474e0 * radians(lon) * cos(t) / (3 * (9 * 0.003796e0 * pow(t, 8) + 7 * 0.000893e0 * pow(t, 6) + 3 * -0.081106e0 * pow(t, 2) + 1.340264e0)) / 2e5) AS BIGINT) AS block_id_x,
  CAST(floor(6371007.180918474e0 * t * (0.003796e0 * pow(t, 8) + 0.000893e0 * pow(t, 6) + -0.081106e0 * pow(t, 2) + 1.340264e0) / 2e5) AS BIGINT) AS block_id_y
  FROM (SELECT asset_id, lon, asin(sqrt(3e0) / 2 * {_SINB}) AS t FROM (SELECT *, sin(radians(lat)) AS s FROM assets_fx) a) b""")
def e13_equal_area_blocks(spark, sf_dir):
    return geo.spatial_blocks(view(spark, sf_dir, "assets_fx")).select("asset_id", "block_id_x", "block_id_y")


@query(f"""SELECT name, count(asset_type) AS n FROM (VALUES ('energy.transmission.substation'), ('energy.distribution.substation'), ('energy.generation.solar_farm'), ('energy.generation.wind_farm'),
  ('energy.generation.power_plant')) t(name) LEFT JOIN ({CLASSIFIED}) c ON asset_type = name GROUP BY name""")
def b7_b9_presets(spark, sf_dir):
    """Elements of each class of the energy preset with high confidence."""
    wanted = ontology.by_confidence("high", "energy")
    n = b6_best_class(spark, sf_dir).filter(F.col("asset_type").isin(wanted)).groupBy(F.col("asset_type").alias("name")).agg(F.count("*").alias("n"))
    return ontology.registry(spark).filter(F.col("name").isin(wanted)).select("name").join(n, "name", "left").fillna({"n": 0})


MORTON = " + ".join(f"(((CAST(la AS BIGINT) >> {i}) & 1) << {2 * i}) + (((CAST(lo AS BIGINT) >> {i}) & 1) << {2 * i + 1})" for i in range(16))


@query(f"""SELECT asset_id, ntile(7) OVER (ORDER BY {MORTON}, asset_id) - 1 AS shard FROM (SELECT asset_id,
  round_even(least(1e0, greatest(0e0, (lat + 90) / 180)) * 65535, 0) AS la, round_even(least(1e0, greatest(0e0, (lon + 180) / 360)) * 65535, 0) AS lo FROM assets_fx) a""")
def e18_morton_shards(spark, sf_dir):
    """Seven shards of equal size along a space-filling curve."""
    from cartolith.operators.ranking import equal_chunks

    a = view(spark, sf_dir, "assets_fx").select("asset_id", geo.morton(F.col("lat"), F.col("lon")).alias("key"))
    return equal_chunks(a, ["key", "asset_id"], 7).select("asset_id", F.col("chunk").alias("shard"))
