"""The class registry: which tags make a map element an infrastructure asset.

The order of the classes is their priority: an element belongs to the first class that accepts it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Tag = tuple[str, str | None]


@dataclass(frozen=True)
class AssetClass:
    name: str
    tags: tuple[Tag, ...]
    radius_m: float
    confidence: str = "high"
    any_of: tuple[Tag, ...] = ()
    none_of: tuple[Tag, ...] = ()
    geometry: str = "any"
    min_area_m2: float | None = None

    @property
    def sector(self) -> str:
        return self.name.split(".")[0]


_TOWER = (("building", "transformer_tower"),)
_AREA = "way_or_relation"

# Class names, tags, radii and confidences.
CLASSES = (
    AssetClass("energy.transmission.substation", (("power", "substation"), ("substation", "transmission")), 200.0, none_of=_TOWER),
    AssetClass("energy.distribution.substation", (("power", "substation"), ("substation", "distribution")), 200.0, none_of=_TOWER),
    AssetClass("energy.distribution.substation_minor", (("power", "substation"), ("substation", "minor_distribution")), 200.0, "medium", none_of=_TOWER),
    AssetClass("energy.distribution.substation_untyped", (("power", "substation"),), 200.0, "medium", none_of=_TOWER),
    AssetClass("energy.generation.solar_farm", (("power", "plant"), ("plant:source", "solar")), 1000.0, geometry=_AREA),
    AssetClass("energy.generation.wind_farm", (("power", "plant"), ("plant:source", "wind")), 1000.0, geometry=_AREA),
    AssetClass("energy.generation.power_plant", (("power", "plant"),), 500.0, none_of=(("plant:source", "solar"), ("plant:source", "wind"))),
    AssetClass("water.wastewater.plant", (("man_made", "wastewater_plant"),), 300.0),
    AssetClass("water.water_works", (("man_made", "water_works"),), 300.0),
    AssetClass("water.storage_tank", (("man_made", "storage_tank"), ("content", "water")), 50.0, "medium"),
    AssetClass("transport.airport", (("aeroway", "aerodrome"),), 1500.0, geometry=_AREA, min_area_m2=500_000.0),
    AssetClass("transport.train_station", (("railway", "station"),), 50.0, any_of=(("name", None), ("train", "yes"), ("public_transport", "station"))),
    AssetClass("transport.port_terminal", (("harbour", "yes"),), 500.0, geometry=_AREA, min_area_m2=200_000.0),
    AssetClass("telecom.data_center", (("building", "data_center"),), 200.0),
)

SECTORS = ("energy", "water", "transport", "telecom")
CONFIDENCE = {"high": 3, "medium": 2, "low": 1}
FALLBACK_RADIUS_M = 200.0
#: Raw class names to the coarse classes of the benchmark; also the older name of one class.
COARSE = {
    "energy.distribution.substation_minor": "energy.distribution.other",
    "energy.distribution.substation_untyped": "energy.distribution.other",
    "water.water_works": "water.treatment.plant",
}


def registry(spark: SparkSession) -> DataFrame:
    """One row for each class: name, sector, priority, tag rules as arrays of structs, geometry, area, radius, confidence."""
    rule = "array<struct<key:string,value:string>>"
    rows = [
        (c.name, c.sector, i, list(c.tags), list(c.any_of), list(c.none_of), c.geometry, c.min_area_m2, c.radius_m, c.confidence)
        for i, c in enumerate(CLASSES)
    ]
    return spark.createDataFrame(
        rows,
        f"name string, sector string, priority int, tags {rule}, any_of {rule}, none_of {rule}, geometry string, "
        "min_area_m2 double, radius_m double, confidence string",
    )


def preset(name: str) -> tuple[AssetClass, ...]:
    """The classes of a filter preset: a sector, ``full`` (energy) or ``substation``."""
    if name == "substation":
        return tuple(c for c in CLASSES if c.sector == "energy" and "substation" in c.name)
    sector = "energy" if name == "full" else name
    if sector not in SECTORS:
        raise ValueError(f"unknown preset {name!r}")
    return tuple(c for c in CLASSES if c.sector == sector)


def by_confidence(least: str = "medium", filter_preset: str = "full") -> list[str]:
    """Class names of a preset whose confidence reaches ``least``; an unknown word counts as medium."""
    threshold = CONFIDENCE.get(least, 2)
    return [c.name for c in preset(filter_preset) if CONFIDENCE[c.confidence] >= threshold]


def violations(classes: DataFrame) -> DataFrame:
    """name and rule for each rule that a class of the registry breaks."""
    sector_of = F.split("name", r"\.")[0]
    broken = {
        "sector": ~F.col("sector").isin(*SECTORS) | (sector_of != F.col("sector")),
        "geometry": ~F.col("geometry").isin("any", "node", "way", "relation", _AREA),
        "confidence": ~F.col("confidence").isin(*CONFIDENCE),
        "area_needs_area_geometry": F.col("min_area_m2").isNotNull() & ~F.col("geometry").isin("way", "relation", _AREA),
        "radius": F.col("radius_m") <= 0,
        "no_tags": F.size("tags") + F.size("any_of") == 0,
    }
    own = classes.select("name", F.explode(F.array(*(F.when(c, F.lit(k)) for k, c in broken.items()))).alias("rule"))
    own = own.filter("rule is not null")
    twice = classes.groupBy("name").count().filter("count > 1").select("name", F.lit("unique_name").alias("rule"))
    # a class must not come after another whose tags are a part of its own and that excludes nothing more
    a, b = classes.alias("a"), classes.alias("b")
    hidden = a.join(
        F.broadcast(b),
        (F.col("a.priority") > F.col("b.priority"))
        & (F.size(F.array_except("b.tags", "a.tags")) == 0)
        & (F.size("b.any_of") == 0)
        & F.col("b.min_area_m2").isNull()
        & (F.col("b.geometry").isin("any") | (F.col("a.geometry") == F.col("b.geometry")))
        & ~F.exists("b.none_of", lambda x: F.array_contains("a.tags", x)),
    ).select("a.name", F.lit("after_catch_all").alias("rule"))
    return own.unionByName(twice).unionByName(hidden.distinct())
