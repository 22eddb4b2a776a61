"""Official registers and operators' points and lines, landed as files, in one shape.

Points: name, lat, lon, detail, implies, inactive. Lines: line_id, kv, ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolith.functions.names import DX, TX, by_voltage, kvs, top_voltage_kind
from cartolith.functions.tags import plain


def points(df: DataFrame, name: Column, lat: Column, lon: Column, detail: Column, implies: Column | None = None, inactive: Column | None = None) -> DataFrame:
    out = df.select(
        F.coalesce(name, F.lit("")).alias("name"), lat.cast("double").alias("lat"), lon.cast("double").alias("lon"), detail.alias("detail"),
        (implies if implies is not None else F.lit(None).cast("string")).alias("implies"),
        F.coalesce(inactive, F.lit(False)).alias("inactive") if inactive is not None else F.lit(False).alias("inactive"),
    )
    return out.filter("lat is not null and lon is not null")


def rail_nodes(df: DataFrame) -> DataFrame:
    """North American rail nodes: PASSNGRSTN, STATE, COUNTRY, lat, lon."""
    some = df.filter("coalesce(PASSNGRSTN, '') <> ''")
    detail = F.concat(F.lit("passenger station node, "), F.coalesce("STATE", F.lit("")), F.lit(" "), F.coalesce("COUNTRY", F.lit("")))
    return points(some, F.col("PASSNGRSTN"), F.col("lat"), F.col("lon"), detail)


def access_nodes(df: DataFrame) -> DataFrame:
    """British stops: StopType RLY and active ones."""
    some = df.filter("StopType = 'RLY' and coalesce(Status, 'active') = 'active'")
    return points(some, F.col("CommonName"), F.col("Latitude"), F.col("Longitude"), F.concat(F.lit("national rail station "), "ATCOCode"))


def aviation(df: DataFrame) -> DataFrame:
    """Airports (site type A) with their use and status."""
    use = F.when(F.col("FACILITY_USE_CODE") == "PU", "public").when(F.col("FACILITY_USE_CODE") == "PR", "private").otherwise("")
    detail = F.concat(F.lit("FAA "), F.coalesce("ARPT_ID", F.lit("")), F.lit(", "), use, F.lit(", "), F.coalesce("ARPT_STATUS", F.lit("")))
    return points(df.filter("SITE_TYPE_CODE = 'A'"), F.col("ARPT_NAME"), F.col("lat"), F.col("lon"), detail)


def stop_places(df: DataFrame) -> DataFrame:
    """Stop places of an XML timetable: the mean of their equipment's points. df: name, mode, points (array of lat, lon)."""
    some = df.filter("(mode is null or mode = 'rail') and size(points) > 0")
    mean = lambda c: F.aggregate("points", F.lit(0.0), lambda s, p: s + p[c]) / F.size("points")
    return points(some, F.col("name"), mean("lat"), mean("lon"), F.lit("railway stop place"))


def passenger_stations(df: DataFrame) -> DataFrame:
    """Stations of a rail operator's feed that serve passengers: stationName, stationShortCode, type, latitude, longitude, passengerTraffic."""
    detail = F.concat(F.lit("Digitraffic "), F.replace(F.lower("type"), F.lit("_"), F.lit(" ")), F.lit(" "), "stationShortCode")
    return points(df.filter("passengerTraffic"), F.col("stationName"), F.col("latitude"), F.col("longitude"), detail)


def station_nodes(df: DataFrame) -> DataFrame:
    """Railway station nodes of a transport agency: geographicalName, formOfNode, coordinates (latitude, longitude)."""
    detail = F.concat(F.lit("Trafikverket "), F.coalesce("formOfNode", F.lit("")))
    return points(df, F.col("geographicalName"), F.col("coordinates")[0], F.col("coordinates")[1], detail)


def irish_stops(df: DataFrame) -> DataFrame:
    """Irish stops: StopType RLY, whatever their status. StopType, CommonName, AtcoCode, Latitude, Longitude."""
    return points(df.filter("StopType = 'RLY'"), F.col("CommonName"), F.col("Latitude"), F.col("Longitude"), F.concat(F.lit("Irish rail stop "), F.col("AtcoCode").cast("string")))


def passenger_halls(df: DataFrame) -> DataFrame:
    """French passenger stations: nom, codes_uic, position_geographique (lat, lon)."""
    at = F.col("position_geographique")
    return points(df, F.col("nom"), at["lat"], at["lon"], F.concat(F.lit("SNCF station UIC "), F.coalesce("codes_uic", F.lit("None"))))


def national_stations(df: DataFrame) -> DataFrame:
    """Stations of a national map, without those that it took from OSM; closed ones are inactive.

    name, operationalstatus, feature_source, state, lat, lon.
    """
    some = df.filter(F.upper(F.coalesce("feature_source", F.lit(""))) != "OSM")
    status = F.coalesce("operationalstatus", F.lit(""))
    name = F.regexp_replace(F.coalesce("name", F.lit("")), r"\s+RAILWAY STATION$", "")
    detail = F.concat(F.lit("GA station, "), F.lower(status), F.lit(", "), F.coalesce("state", F.lit("")))
    return points(some, name, F.col("lat"), F.col("lon"), detail, inactive=status.isin("Abandoned", "Disused"))


def named_complexes(df: DataFrame) -> DataFrame:
    """Building complexes of New South Wales that are named as substations; the name tells the type. generalname, x, y."""
    name = F.coalesce("generalname", F.lit(""))
    kind = F.when(name.contains("ZONE SUBSTATION"), DX).when(name.rlike("TRANSMISSION SUBSTATION|BULK SUPPLY|SWITCHING STATION"), TX)
    return points(df.filter(F.col("generalname").contains("SUBSTATION")), name, F.col("y"), F.col("x"), F.lit("NSW Features of Interest"), kind)


def power_facilities(df: DataFrame) -> DataFrame:
    """Power facilities of Victoria: terminal stations are transmission, sub stations distribution. name, feature_subtype, lat, lon (centroids)."""
    some = df.filter("feature_subtype in ('power sub station', 'power terminal station')")
    kind = F.when(F.col("feature_subtype") == "power terminal station", TX).otherwise(DX)
    return points(some, F.col("name"), F.col("lat"), F.col("lon"), F.concat(F.lit("Vicmap "), "feature_subtype"), kind)


def distribution_posts(df: DataFrame) -> DataFrame:
    """Distribution substations of Peru, a dense register without names: CODEMP, CODSED, lat, lon."""
    return points(df, F.lit(""), F.col("lat"), F.col("lon"), F.format_string("OSINERGMIN SED %s (%s)", "CODSED", "CODEMP"))


def communal_posts(df: DataFrame) -> DataFrame:
    """Distribution substations of France, a dense register without names: nom_commune, lat, lon."""
    return points(df, F.lit(""), F.col("lat"), F.col("lon"), F.concat(F.lit("Enedis poste HTA/BT, "), F.coalesce("nom_commune", F.lit(""))))


def labelled_substations(df: DataFrame) -> DataFrame:
    """Primary substations of Kenya, labelled NAME ( high / low KV): Name_IMS11, Name8, lat, lon."""
    label = F.coalesce("Name_IMS11", F.lit(""))
    volts = F.when(label.contains("("), kvs(F.element_at(F.split(label, r"\("), -1))).otherwise(F.array().cast("array<double>"))
    name = F.coalesce(F.nullif(F.trim(F.split(label, r"\(")[0]), F.lit("")), "Name8", F.lit(""))
    kind = F.when(F.size(volts) > 0, by_voltage(F.slice(volts, 1, 1), F.slice(volts, 2, 1000))).otherwise(DX)
    return points(df, name, F.col("lat"), F.col("lon"), F.concat(F.lit("KPLC primary substation "), label), kind)


def typed_by_voltage(df: DataFrame) -> DataFrame:
    """Substations of Zambia, filed as distribution and typed by their voltage: NAME, VOLATGELEV, lat, lon."""
    kv = F.col("VOLATGELEV").try_cast("double")
    detail = F.concat(F.lit("ZESCO substation"), F.when(kv > 0, F.concat(F.lit(", "), plain(kv), F.lit(" kV"))).otherwise(""))
    return points(df, F.col("NAME"), F.col("lat"), F.col("lon"), detail, top_voltage_kind(F.lit(DX), kv))


def transformer_stations(df: DataFrame) -> DataFrame:
    """High-voltage transformer stations of Argentina with their voltages in and out: NOMBRE, TENSION_EN, TENSION_SA, lat, lon."""
    detail = F.format_string("Secretaría de Energía ET, %s kV in, %s kV out", "TENSION_EN", "TENSION_SA")
    volts = lambda c: F.coalesce(kvs(F.col(c)), F.array().cast("array<double>"))
    return points(df, F.col("NOMBRE"), F.col("lat"), F.col("lon"), detail, by_voltage(volts("TENSION_EN"), volts("TENSION_SA")))


def schematic_points(df: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """Points of a schematic map. A grid node has the voltages of the lines that name it, a substation the highest in its text.

    name, node_type (null: a substation), text (what the map says of its voltage), lat, lon; lines: kv, nodes (names).
    """
    kv_of = F.array().cast("array<double>")
    if lines is not None:
        named = lines.filter("kv is not null").select(F.explode("nodes").alias("name"), F.col("kv").cast("double").alias("kv"))
        df = df.join(named.groupBy("name").agg(F.sort_array(F.collect_set("kv"), asc=False).alias("kvs")), "name", "left")
        kv_of = F.coalesce("kvs", kv_of)
    volts = F.coalesce(kvs(F.col("text")), F.array().cast("array<double>"))
    place = F.coalesce(F.nullif("name", F.lit("")), F.lit("an unnamed place"))
    listed = F.array_join(F.transform(kv_of, plain), "/")
    node = F.concat(F.lit("a grid node at "), place, F.lit(" ("), "node_type", F.lit(")"), F.when(F.size(kv_of) > 0, F.concat(F.lit(" on "), listed, F.lit(" kV lines"))).otherwise(""))
    station = F.when(F.size(volts) > 0, F.concat(F.lit("a "), plain(F.array_max(volts)), F.lit(" kV substation"))).otherwise("a substation")
    return points(df, F.col("name"), F.col("lat"), F.col("lon"), F.when(F.col("node_type").isNotNull(), node).otherwise(station))


def grid_sites(df: DataFrame) -> DataFrame:
    """Sites of a transmission operator: all transmission. df: name, type (ACSTN, HVDC), lat, lon."""
    return points(df.filter("type in ('ACSTN', 'HVDC')"), F.col("name"), F.col("lat"), F.col("lon"), F.concat(F.lit("site "), "type"), F.lit(TX))


def zone_substations(df: DataFrame) -> DataFrame:
    """Zone substations of a distributor."""
    return points(df, F.col("name"), F.col("lat"), F.col("lon"), F.lit("zone substation"), F.lit(DX))


def national_substations(df: DataFrame) -> DataFrame:
    """Substations of a national map with subtype and voltage. df: name, subtype, kv, source, lat, lon."""
    some = df.filter(~F.lower(F.coalesce("source", F.lit(""))).contains("open street map"))
    kind = F.when(F.col("subtype") == "Zone", DX).when(F.col("subtype").isin("Transmission", "Terminal", "Switchyard", "Bulk Supply Point"), TX)
    detail = F.concat(F.coalesce("subtype", F.lit("substation")), F.when(F.col("kv") > 0, F.concat(F.lit(", "), plain(F.col("kv")), F.lit(" kV"))).otherwise(""))
    return points(some, F.col("name"), F.col("lat"), F.col("lon"), detail, top_voltage_kind(kind, F.col("kv")))


def lines_from_paths(df: DataFrame, least_kv: float | None = None, most_kv: float | None = None, countries_out: tuple[str, ...] = ()) -> DataFrame:
    """Lines with both ends of every path. df: line_id, kv, status, country, paths (array of arrays of lon, lat)."""
    some = df.filter(F.coalesce("status", F.lit("Existing")) == "Existing").filter(~F.coalesce("country", F.lit("")).isin(*countries_out))
    if least_kv is not None:
        some = some.filter(F.col("kv") >= least_kv)
    if most_kv is not None:
        some = some.filter(F.col("kv") <= most_kv)
    end = lambda p, i: F.struct(F.element_at(p, i)[1].alias("lat"), F.element_at(p, i)[0].alias("lon"))
    kv = F.when(F.col("kv") >= 0, F.col("kv"))
    return some.select("line_id", kv.alias("kv"), F.flatten(F.transform("paths", lambda p: F.array(end(p, 1), end(p, -1)))).alias("ends"))


def feeder_lines(df: DataFrame, kv: float = 20.0) -> DataFrame:
    """Medium-voltage lines of a distributor, all of one voltage: line_id, paths (array of arrays of lon, lat)."""
    return lines_from_paths(df.withColumns({"kv": F.lit(kv), "status": F.lit("Existing"), "country": F.lit("")}))


def plants(df: DataFrame) -> DataFrame:
    """A plant inventory without rows at latitude zero."""
    return df.filter("abs(cast(Latitude as double)) > 0").select(
        F.col("Plant_Code").cast("long").alias("plant_id"), F.col("Plant_Name").alias("name"), F.col("PrimSource").alias("kind"),
        F.coalesce(F.col("Total_MW").cast("double"), F.lit(0.0)).alias("mw"), F.col("Latitude").cast("double").alias("lat"), F.col("Longitude").cast("double").alias("lon"),
    )
