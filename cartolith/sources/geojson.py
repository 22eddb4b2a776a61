r"""Features of GeoJSON documents of any size, as rows.

A document is read in pieces that end with a closing brace, by as many tasks as it has ranges of bytes. A prefix sum over the
pieces' quotation marks tells which of them begin inside a string, one over their braces how deep each begins, and one over
the objects that ended before gives each piece the number of its feature; a feature's pieces are put together again. No task
sees more than a range of bytes or one feature.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolith.operators.ranking import running_sums

#: A string without its end; a whole one has one more quotation mark.
_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+'
FEATURE = "type string, properties map<string,string>, geometry struct<type:string,coordinates:string>"


def _count(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def features(spark: SparkSession, path: str) -> DataFrame:
    """file, number (from 0, of the objects in a document), type, properties, geometry (type, coordinates as JSON text).

    A byte order mark before a document and any text after its end are ignored.
    """
    meta = F.col("_metadata")
    pieces = spark.read.option("lineSep", "}").text(path)
    pieces = pieces.select(meta["file_path"].alias("file"), meta["file_block_start"].alias("byte"), F.monotonically_increasing_id().alias("row"), "value")
    quotes = _count(F.regexp_replace("value", r"(?s)\\.", ""), '"')
    order = ["byte", "row"]
    placed = running_sums(pieces.withColumn("quotes", quotes), ["file"], order, ["quotes"])
    begins, ends = F.col("before_quotes") % 2 == 1, (F.col("before_quotes") + F.col("quotes")) % 2 == 1
    bare = F.regexp_replace(F.concat(F.when(begins, '"').otherwise(""), "value"), f"(?s){_STRING}\"", "")
    bare = F.regexp_replace(bare, f"(?s){_STRING}$", "")
    placed = placed.select("file", *order, "value", (_count(bare, "{") - F.when(ends, 0).otherwise(1)).alias("deeper"), (~ends).alias("closes"))
    placed = running_sums(placed, ["file"], order, ["deeper"])
    after = F.col("before_deeper") + F.col("deeper")
    placed = placed.select(
        "file", *order, "value", (F.col("closes") & (after == 1)).cast("int").alias("object"), (F.col("closes") & (after <= 0)).cast("int").alias("document")
    )
    placed = running_sums(placed, ["file"], order, ["object", "document"]).filter("before_document = 0 and document = 0")
    whole = placed.groupBy("file", F.col("before_object").alias("number")).agg(F.array_sort(F.collect_list(F.struct(*order, "value"))).alias("p"))
    text = F.concat(F.array_join(F.transform("p", lambda x: x["value"]), "}"), F.lit("}"))
    # what stands before an object: of the first one the document's own brace too
    before = rf'(?s)^[^{{"]*+(?:{_STRING}"[^{{"]*+)*+'
    text = F.when(F.col("number") == 0, F.regexp_replace(F.regexp_replace(text, before + r"\{", ""), before, "")).otherwise(F.regexp_replace(text, before, ""))
    found = whole.select("file", "number", F.from_json(text, FEATURE).alias("f"))
    return found.filter("f.geometry.coordinates is not null").select("file", "number", "f.type", "f.properties", "f.geometry")


def _points(p: Column) -> Column:
    return F.transform(p, lambda x: F.struct(F.get(x, F.lit(1)).alias("lat"), F.get(x, F.lit(0)).alias("lon")))


def tolerant_geojson(spark: SparkSession, path: str) -> DataFrame:
    """properties, kind, point (lon, lat), paths and rings of each feature that has coordinates.

    paths: arrays of points (lat, lon) of lines; rings: arrays of role (outer, inner) and pts of polygons, as area_features takes them.
    """
    kind, json = F.col("geometry.type"), F.col("geometry.coordinates")
    depth = lambda n: F.from_json(json, "array<" * n + "double" + ">" * n)
    rings = lambda polygon: F.transform(polygon, lambda r, i: F.struct(F.when(i == 0, "outer").otherwise("inner").alias("role"), _points(r).alias("pts")))
    return features(spark, path).select(
        "properties",
        kind.alias("kind"),
        F.when(kind == "Point", depth(1)).alias("point"),
        F.when(kind == "LineString", F.array(_points(depth(2)))).when(kind == "MultiLineString", F.transform(depth(3), _points)).alias("paths"),
        F.when(kind == "Polygon", rings(depth(3))).when(kind == "MultiPolygon", F.flatten(F.transform(depth(4), rings))).alias("rings"),
    )
