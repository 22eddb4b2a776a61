"""Tag rules over a map of tags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolith.ontology import CLASSES, AssetClass, Tag

#: Tag keys that say what an element is, in the order they are shown (fixed values).
HINT_KEYS = (
    "power", "substation", "voltage", "operator", "plant:source", "generator:source", "plant:output:electricity", "railway",
    "public_transport", "station", "aeroway", "aerodrome:type", "iata", "man_made", "content", "water_works", "wastewater",
    "harbour", "industrial", "telecom", "building", "landuse", "disused", "abandoned",
)


def _holds(tags: Column, tag: Tag) -> Column:
    key, value = tag
    found = F.try_element_at(tags, F.lit(key))
    return F.coalesce(found.isNotNull() if value is None else found == value, F.lit(False))


def all_match(tags: Column, rules: tuple[Tag, ...]) -> Column:
    """Every rule holds; a rule without a value asks for the key only."""
    return reduce(lambda a, b: a & b, (_holds(tags, r) for r in rules), F.lit(True))


def any_match(tags: Column, rules: tuple[Tag, ...]) -> Column:
    """One of the rules holds, or there is none."""
    return reduce(lambda a, b: a | b, (_holds(tags, r) for r in rules)) if rules else F.lit(True)


def none_match(tags: Column, rules: tuple[Tag, ...]) -> Column:
    return ~any_match(tags, rules) if rules else F.lit(True)


def geometry_allowed(wanted: str, osm_type: Column) -> Column:
    if wanted == "any":
        return F.lit(True)
    return osm_type.isin("way", "relation") if wanted == "way_or_relation" else osm_type == wanted


def accepts(c: AssetClass, tags: Column, osm_type: Column, area_m2: Column) -> Column:
    ok = all_match(tags, c.tags) & geometry_allowed(c.geometry, osm_type)
    ok = ok & any_match(tags, c.any_of) & none_match(tags, c.none_of)
    return ok if c.min_area_m2 is None else ok & F.coalesce(area_m2 >= c.min_area_m2, F.lit(False))


def best_class(tags: Column, osm_type: Column, area_m2: Column, classes=CLASSES) -> Column:
    """Name of the first class that accepts the element, or null."""
    out = None
    for c in classes:
        test = accepts(c, tags, osm_type, area_m2)
        out = F.when(test, F.lit(c.name)) if out is None else out.when(test, F.lit(c.name))
    return out.otherwise(F.lit(None))


def anchor_keys(classes=CLASSES) -> list[str]:
    """The first tag key of each class: an element without any of them belongs to no class."""
    return sorted({c.tags[0][0] for c in classes})


def anchored(elements: DataFrame, classes=CLASSES) -> DataFrame:
    """The elements that hold an anchor key."""
    keys = F.array(*(F.lit(k) for k in anchor_keys(classes)))
    return elements.filter(F.arrays_overlap(F.map_keys("tags"), keys))


def needed_nodes(nodes: DataFrame, ways: DataFrame, relations: DataFrame) -> DataFrame:
    """Tagged anchor nodes, and nodes that kept ways or relations refer to. ways: refs; relations: members (type, ref)."""
    refs = ways.select(F.explode("refs").alias("osm_id"))
    members = relations.select(F.explode("members").alias("m")).filter("m.type = 'node'").select(F.col("m.ref").alias("osm_id"))
    return anchored(nodes).unionByName(nodes.join(refs.union(members), "osm_id", "left_semi")).dropDuplicates(["osm_id"])


def first_elements(elements: DataFrame, rank: str = "arrival") -> DataFrame:
    """One row for each (osm_type, osm_id), the one that arrived first."""
    least = F.min_by(F.struct(*elements.columns), rank).alias("e")
    return elements.groupBy("osm_type", "osm_id").agg(least).select("e.*")


def way_centroids(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """Plain mean of a way's node coordinates; a node that closes the way counts twice. ways: osm_id, refs."""
    at = ways.select("osm_id", F.posexplode("refs").alias("i", "ref"))
    places = nodes.filter("lat between -90 and 90 and lon between -180 and 180").select(F.col("osm_id").alias("ref"), "lat", "lon")
    return at.join(places, "ref").groupBy("osm_id").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.count("*").alias("nodes"))


def max_kv(voltage: Column) -> Column:
    """Largest of the whole volts in a list separated by ; or , in kV."""
    parts = F.filter(F.transform(F.split(voltage, "[;,]"), lambda x: F.trim(x)), lambda x: x.rlike("^[0-9]+$"))
    return F.array_max(F.transform(parts, lambda x: x.cast("double") / 1000))


def hint_text(tags: Column) -> Column:
    """The defining tags an element has, in fixed order, and its highest voltage."""
    keys = F.filter(F.array(*(F.lit(k) for k in HINT_KEYS)), lambda k: F.map_contains_key(tags, k))
    shown = F.array_join(F.transform(keys, lambda k: F.concat(k, F.lit("="), F.try_element_at(tags, k))), ", ")
    kv = max_kv(F.try_element_at(tags, F.lit("voltage")))
    text = F.when(F.size(keys) > 0, shown).otherwise(F.lit("none of the defining tags"))
    return F.concat(F.lit("OSM tags: "), text, F.when(kv > 0, F.concat(F.lit(" (max "), plain(kv), F.lit(" kV)"))).otherwise(F.lit("")))


def plain(number: Column) -> Column:
    """A number without needless decimals."""
    return F.when(number == F.floor(number), F.floor(number).cast("string")).otherwise(number.cast("string"))
