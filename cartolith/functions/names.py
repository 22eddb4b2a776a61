"""Names, labels and voltages in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TX, DX = "energy.transmission.substation", "energy.distribution.substation"

# Keyword patterns and the class each points at; the first that matches decides.
_WORD = r"(?iu)(?<![\p{L}\p{N}_])"
_END = r"(?![\p{L}\p{N}_])"
NAME_HINTS = (
    (_WORD + r"(solar|photovolta)", "energy.generation.solar_farm"),
    (_WORD + r"(power station|power plant|generating station|centrale)" + _END, "energy.generation.power_plant"),
    (_WORD + r"(substation|switchyard|umspannwerk|subestaci[oó]n|poste source)" + _END, "energy.*.substation"),
    (r"(?iu)(sewage|waste ?water|wwtp|effluent|kl[äa]ranlage|depuradora|[ée]puration|rioolwaterzuivering)", "water.wastewater.plant"),
    (_WORD + r"(water ?works|drinking|potable|water treatment)" + _END, "water.treatment.plant"),
    (_WORD + r"(data ?cent(er|re)|datacenter)" + _END, "telecom.data_center"),
    (_WORD + r"(airport|aerodrome|airfield|aeropuerto|a[ée]roport)" + _END, "transport.airport"),
)
# Words that name a kind of facility, not a place.
FILLER = (
    "substation|sub|station|switching|switchyard|power|electric|kv|rail|railway|train|amtrak|airport|aerodrome|airfield|"
    "international|intl|regional|rgnl|municipal|muni|county"
)
PLACEHOLDER = r"(?i)^(UNKNOWN|TAP|DEADEND|NOT AVAILABLE)"


def name_hint(name: Column, label: Column) -> Column:
    """The class a name points at if it isn't the label's, else the empty text."""
    out = F.when(name.isNull() | (name == ""), F.lit(""))
    for pattern, target in NAME_HINTS:
        if target == "energy.*.substation":
            agrees = label.contains("substation") | (label == "energy.distribution.other")
            hint = F.when(agrees, F.lit("")).otherwise(F.lit("a substation"))
        else:
            hint = F.when(label == target, F.lit("")).otherwise(F.lit(target))
        out = out.when(name.rlike(pattern), hint)
    return out.otherwise(F.lit(""))


def tokens(name: Column) -> Column:
    """Distinct runs of more than two letters a-z of a name in lower case, without filler words."""
    rest = F.regexp_replace(F.lower(name), rf"\b({FILLER}|[0-9]+)\b", " ")
    return F.array_distinct(F.filter(F.regexp_extract_all(rest, F.lit("([a-z]+)"), 1), lambda x: F.length(x) > 2))


def names_match(a: Column, b: Column) -> Column:
    return F.coalesce(F.arrays_overlap(tokens(a), tokens(b)), F.lit(False))


def kvs(text: Column) -> Column:
    """The numbers from 1 to 1200 in a text; a comma is a decimal point."""
    found = F.regexp_extract_all(F.regexp_replace(text, ",", "."), F.lit(r"([0-9]+(?:[.][0-9]+)?)"), 1)
    return F.filter(F.transform(found, lambda x: x.cast("double")), lambda x: x.between(1, 1200))


def by_voltage(high: Column, low: Column) -> Column:
    """The substation class that voltages imply, or null: stepping down from 100 kV to less implies neither."""
    down = F.when(F.size(low) > 0, low).otherwise(high)
    return F.when(F.size(high) > 0, F.when(F.array_min(down) >= 100, F.lit(TX)).when(F.array_max(high) < 100, F.lit(DX)))


def top_voltage_kind(kind: Column, kv: Column) -> Column:
    """The class a site's highest voltage allows, given the one its source files it under."""
    return F.when(kv >= 220, F.lit(TX)).when((kind == DX) & (kv >= 100), F.lit(None)).otherwise(kind)


def safe_id(text: Column) -> Column:
    return F.translate(text, "/:", "__")


def osm_parts(asset_id: Column) -> tuple[Column, Column]:
    """Type and number of an element id osm_<type>_<number>."""
    pattern = "osm_(node|way|relation)_([0-9]+)"
    return F.regexp_extract(asset_id, pattern, 1), F.nullif(F.regexp_extract(asset_id, pattern, 2), F.lit("")).try_cast("bigint")


def element_url(asset_id: Column, base: str = "https://www.openstreetmap.org/") -> Column:
    pattern = "osm_(node|way|relation)_([0-9]+)"
    return F.concat(F.lit(base), F.regexp_extract(asset_id, pattern, 1), F.lit("/"), F.regexp_extract(asset_id, pattern, 2))
