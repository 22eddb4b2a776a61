"""Round trips of the readers and writers, and the register shapes."""

import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartolith.functions.names import DX, TX
from cartolith.functions import tags
from cartolith.operators import evidence, queue, reconcile, review, sampling, tiles
from cartolith.sources import arrays, cells, registers, tables
from cartolith.streaming import decisions


def test_asset_tables(spark, tmp_path):
    df = spark.createDataFrame([("a", "x", 1.0, 2.0, "n", "s", '{"power": "plant"}')], tables.ASSETS)
    df.write.parquet(f"{tmp_path}/a.parquet")
    df.write.csv(f"{tmp_path}/a.csv", header=True, escape='"')
    for suffix in ("parquet", "csv"):
        assert tables.load_assets(spark, f"{tmp_path}/a.{suffix}").first().osm_tags == {"power": "plant"}
    with pytest.raises(ValueError):
        tables.load_assets(spark, f"{tmp_path}/a.xlsx")
    tables.save_assets(tables.load_assets(spark, f"{tmp_path}/a.parquet"), f"{tmp_path}/out")
    assert "osm_tags" not in spark.read.parquet(f"{tmp_path}/out.parquet").columns


def test_manifests_targets_and_results(spark, tmp_path):
    for region, sector in (("asia", "energy"), ("north-america", "water")):
        os.makedirs(f"{tmp_path}/m/dataset_{region}_{sector}_v1")
        with open(f"{tmp_path}/m/dataset_{region}_{sector}_v1/manifest.json", "w") as f:
            json.dump({"version": 1, "records": [{"asset_id": f"{region}1", "lat": 1.5}]}, f, indent=1)
    rows = tables.load_manifests(spark, f"{tmp_path}/m/*/manifest.json", "asset_id: string, lat: double").collect()
    assert {(r.region, r.sector, r.asset_id) for r in rows} == {("asia", "energy", "asia1"), ("north-america", "water", "north-america1")}

    (tmp_path / "targets.json").write_text(json.dumps({"seed": 42, "cells": {"asia/energy": {"target": 1000, "threshold": 1000, "sample_rows": 9, "run": "1k"}}}))
    assert tuple(tables.load_targets(spark, f"{tmp_path}/targets.json").first()) == ("asia", "energy", 1000, 1000, 9, "1k")

    run = {"history": [{"epoch": 0, "val_macro_f1": 0.5}], "test": {"confusion": [[3, 1], [0, 2]], "per_class_f1": [0.8, 0.7]}}
    for i, wrap in enumerate(("linear_probe", "finetune", None)):
        (tmp_path / f"run{i}.json").write_text(json.dumps({wrap: run} if wrap else run))
    cells = tables.confusion_rows(tables.load_results(spark, f"{tmp_path}/run*.json"))
    assert cells.count() == 12 and cells.agg(F.sum("n")).first()[0] == 18


def test_split_artifact(spark, tmp_path):
    row = {c: 1 for c in tables.SPLIT_COLUMNS} | {c: "x" for c, t in tables.SPLIT_COLUMNS.items() if t == "string"}
    df = spark.createDataFrame([row])
    tables.save_split(df.select(*reversed(df.columns)), f"{tmp_path}/split")
    assert spark.read.parquet(f"{tmp_path}/split").columns == list(tables.SPLIT_COLUMNS)
    assert tables.load_split(spark, f"{tmp_path}/split").columns == ["asset_id", "split"]
    with pytest.raises(ValueError):
        tables.save_split(df.drop("split"), f"{tmp_path}/bad")


def test_decision_logs_in_batch_and_stream(spark, tmp_path):
    os.makedirs(f"{tmp_path}/log")
    lines = [{"asset_id": "a", "reviewer": "r", "decision": d, "label": "x", "note": "", "at": "2026-01-01T00:00:00", "line": i} for i, d in enumerate(("accept", "relabel"))]
    with open(f"{tmp_path}/log/decisions_r.jsonl", "w") as f:
        f.write("\n".join(map(json.dumps, lines)) + "\n")
    rows = tables.load_decisions(spark, f"{tmp_path}/log").orderBy("line").collect()
    assert [r.decision for r in rows] == ["accept", "relabel"]
    run = decisions.latest_stream(decisions.read_log(spark, f"{tmp_path}/log")).writeStream.format("memory").queryName("latest").outputMode("update").trigger(availableNow=True).start()
    run.awaitTermination()
    assert [r.decision for r in spark.table("latest").collect()] == ["relabel"]


def test_appended_decisions_come_last_and_large_logs_are_split(spark, tmp_path):
    folder = f"{tmp_path}/log"
    os.makedirs(folder)
    line = lambda i, d: json.dumps({"asset_id": f"a{i % 50}", "reviewer": "zoé", "decision": d, "label": str(i), "note": "x" * (i % 90), "at": "2026-01-01T00:00:00"})
    with open(f"{folder}/decisions_zoé.jsonl", "w") as f:
        f.write("\n\n".join(line(i, "accept") for i in range(3000)) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        log = tables.load_decisions(spark, folder)
        assert log.rdd.getNumPartitions() > 5
        rows = log.orderBy("file", "line").collect()
        assert [int(r.label) for r in rows] == list(range(3000))
        assert {int(r.label) for r in review.latest(log).collect()} == set(range(2950, 3000))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    os.makedirs(f"{folder}/_00-killed")  # what a killed append leaves isn't read
    with open(f"{folder}/_00-killed/part-0.json", "w") as f:
        f.write(line(1, "unsure") + "\n")
    more = spark.range(100, numPartitions=3).select(
        F.format_string("a%d", F.col("id") % 3).alias("asset_id"), F.lit("zoé").alias("reviewer"), F.lit("relabel").alias("decision"), F.col("id").cast("string").alias("label"),
        F.lit("").alias("note"), F.lit("2025-01-01").alias("at"),
    )
    tables.append_decisions(more.filter("id < 99"), folder)
    tables.append_decisions(more.filter("id = 99"), folder)
    last = {r.asset_id: r for r in review.latest(tables.load_decisions(spark, folder)).collect()}
    assert (last["a0"].label, last["a1"].label, last["a2"].label, last["a3"].decision) == ("99", "97", "98", "accept") and len(last) == 50


def test_cells_are_replaced_and_marked(spark, tmp_path):
    path, cell = f"{tmp_path}/cells", ["region", "sector"]
    grid = spark.createDataFrame([(r, s) for r in ("asia", "europe") for s in ("energy", "water")] + [("none", "water")], "region string, sector string")

    def work(open_):
        asked.append(sorted(tuple(r) for r in open_.collect()))
        rows = open_.filter("region <> 'none'").crossJoin(spark.range(times, numPartitions=1).withColumnRenamed("id", "k"))
        return rows.withColumn("ok", F.col("k") % 2 == 0)

    def files():
        return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(f"{path}/data") for f in names if f.startswith("part")}

    asked, times = [], 5
    counts = {"n_ok": F.count(F.when(F.col("ok"), 1))}
    cells.run_cells(grid, path, cell, work, counts)
    marks = {(r.region, r.sector): (r.n, r.n_ok) for r in cells.markers(spark, path, cell).collect()}
    assert marks == {(r, s): (5, 3) for r in ("asia", "europe") for s in ("energy", "water")} | {("none", "water"): (0, 0)}
    cells.run_cells(grid, path, cell, work, counts)
    assert len(asked) == 1 and cells.pending(grid, path, cell).isEmpty() and cells.load(spark, path, cell).count() == 20
    # a run is killed between data and marker: its cell is done again, no other cell's files are touched
    before, one = files(), grid.filter("region = 'asia' and sector = 'water'")
    times = 2
    cells.begin(one, path, cells.new_run())
    cells.save(work(one), path, cell)
    asked.clear()
    assert cells.load(spark, path, cell).count() == 15
    times = 3
    cells.run_cells(grid, path, cell, work, counts)
    assert asked == [[("asia", "water")]] and cells.load(spark, path, cell).count() == 18
    after = files()
    same = {f: t for f, t in before.items() if "region=asia/sector=water" not in f}
    assert len(same) >= 3 and all(after.get(f) == t for f, t in same.items())
    # data that was lost after its marker is found
    assert cells.damaged(spark, path, cell).isEmpty()
    for f in after:
        if "region=europe/sector=water" in f:
            os.remove(f)
    assert [tuple(r) for r in cells.damaged(spark, path, cell).collect()] == [("europe", "water", 5, 0)]


def test_arrays_of_a_killed_task_leave_nothing(spark, tmp_path):
    good = spark.createDataFrame([(f"p{i}", [2, 2], [float(i)] * 4) for i in range(20)], "path string, shape array<int>, data array<double>").repartition(4)
    bad = good.withColumn("shape", F.when(F.col("path") == "p7", F.array(F.lit(3), F.lit(5))).otherwise(F.col("shape")))
    folder = f"file://{tmp_path}/arrays"
    with pytest.raises(Exception):  # a shape that doesn't fit ends its task
        tables.save_arrays(bad, folder)
    assert [f for _, _, names in os.walk(f"{tmp_path}/arrays") for f in names if f.endswith(".npy")] == []
    for _ in range(2):
        tables.save_arrays(good, folder)
    assert sorted(os.listdir(f"{tmp_path}/arrays")) == sorted(arrays.file_name(f"p{i}") for i in range(20))
    back = tables.load_arrays(spark, f"{folder}/*.npy").collect()
    assert sorted(r.data[3] for r in back) == [float(i) for i in range(20)] and all(list(r["shape"]) == [2, 2] for r in back)


def test_status_stream_resumes_and_takes_late_lines(spark, tmp_path):
    def put(name, lines):
        os.makedirs(f"{tmp_path}/log", exist_ok=True)
        with open(f"{tmp_path}/log/{name}.json", "w") as f:
            f.writelines(json.dumps(dict(zip(("asset_id", "reviewer", "decision", "label", "at", "line"), x, strict=True))) + "\n" for x in lines)

    def run():
        q = decisions.keep_status(decisions.read_log(spark, f"{tmp_path}/log"), f"{tmp_path}/status", f"{tmp_path}/checkpoint")
        q.awaitTermination()
        return {r.asset_id: (r.status, r.final_label, list(r.reviewers)) for r in decisions.current_status(spark, f"{tmp_path}/status").collect()}

    day = lambda d: f"2026-01-0{d}T00:00:00"
    put("one", [("a", "r", "accept", "x", day(1), 1), ("b", "r", "unsure", "", day(1), 2), ("c", "r", "accept", "x", day(1), 3)])
    assert run() == {"a": ("done", "x", ["r"]), "b": ("unsure", "", ["r"]), "c": ("done", "x", ["r"])}
    # a second run knows the first one's state: another reviewer, a later word, and a line older than what is known
    put("two", [("a", "s", "relabel", "y", day(2), 4), ("b", "r", "accept", "z", day(2), 5), ("c", "r", "unsure", "", "2025-12-31T00:00:00", 6)])
    assert run() == {"a": ("disputed", "", ["r", "s"]), "b": ("done", "z", ["r"]), "c": ("done", "x", ["r"])}
    assert run()["a"][0] == "disputed"


def test_status_table_grows_with_assets_not_batches(spark, tmp_path):
    path = f"{tmp_path}/status"

    def put(number, words):
        rows = [(a, w, "", ["r"]) for a, w in words.items()]
        decisions.merge_status(spark.createDataFrame(rows, decisions.STATUS), number, path, buckets=4)

    def now():
        return {r.asset_id: r.status for r in decisions.current_status(spark, path).collect()}

    def rows_on_disk():
        return spark.read.schema(decisions.STATUS).parquet(f"{path}/batch=*/bucket=*").count()

    assert now() == {}
    put(0, {f"a{i}": "done" for i in range(40)})
    for number in range(1, 8):
        put(number, {"a1": f"w{number}", f"b{number}": "unsure"})
    want = {f"a{i}": "done" for i in range(40)} | {f"b{n}": "unsure" for n in range(1, 8)} | {"a1": "w7"}
    assert now() == want and rows_on_disk() <= 2 * len(want)
    # a batch is run again, after it had been written in whole and after it had been cut off
    put(7, {"a1": "again", "b7": "unsure"})
    assert now() == want | {"a1": "again"}
    os.remove(f"{path}/batch=7/_SUCCESS")
    assert now() == {k: v for k, v in (want | {"a1": "w6"}).items() if k != "b7"}
    put(7, {"a1": "w7", "b7": "unsure"})
    assert now() == want and rows_on_disk() <= 2 * len(want)


def test_pending_tiles_of_a_stream_are_not_done_twice(spark, tmp_path):
    os.makedirs(f"{tmp_path}/in")
    (tmp_path / "in" / "a.json").write_text('{"asset_id": "a"}\n{"asset_id": "b"}\n')
    done = spark.createDataFrame([("b",)], "asset_id string")

    def run():
        rows = decisions.pending_stream(spark.readStream.schema("asset_id string").json(f"{tmp_path}/in"), done)
        rows.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
        return sorted(r.asset_id for r in spark.read.parquet(f"{tmp_path}/out").collect())

    assert run() == ["a"]
    (tmp_path / "in" / "b.json").write_text('{"asset_id": "c"}\n')
    assert run() == ["a", "c"]


def test_writers_and_batches(spark, tmp_path):
    nodes = spark.createDataFrame([("node", 1, {"power": "plant"}), ("node", 2, {}), ("node", 3, {"x": "y"})], "osm_type string, osm_id long, tags map<string,string>")
    ways = spark.createDataFrame([("way", 9, [2, 4])], "osm_type string, osm_id long, refs array<long>")
    relations = spark.createDataFrame([([("node", 3), ("way", 9)],)], "members array<struct<type string, ref long>>")
    assert sorted(r.osm_id for r in tags.needed_nodes(nodes, ways, relations).collect()) == [1, 2, 3]
    assert tables.candidates(nodes, ways, ways.withColumn("area_m2", F.lit(1.0))).count() == 5

    records = spark.createDataFrame([("asia", "energy", "a", ["naip", "sentinel1"], [1.0])], "region string, sector string, asset_id string, modalities array<string>, box array<double>")
    tables.save_dataset(records, f"{tmp_path}/set")
    assert spark.read.csv(f"{tmp_path}/set/summary", header=True).first().modalities == "naip+sentinel1"
    assert spark.read.json(f"{tmp_path}/set/records").first().region == "asia"

    entry = spark.createDataFrame([("a", "r", "accept", "x", "", "2026-01-01")], "asset_id string, reviewer string, decision string, label string, note string, at string")
    for _ in range(2):
        tables.append_decisions(entry, f"{tmp_path}/decisions")
    assert tables.load_decisions(spark, f"{tmp_path}/decisions").count() == 2
    tables.save_results(spark.createDataFrame([("m", 0.5), ("n", 0.25)], "model string, f1 double"), f"{tmp_path}/results")
    assert json.loads(spark.read.text(f"{tmp_path}/results").first().value)["n"] == 2

    for batch, rows in (("batch_1", [{"id": "a"}]), ("batch_2", [{"id": "b"}, {"id": "c"}])):
        os.makedirs(f"{tmp_path}/agents/{batch}")
        with open(f"{tmp_path}/agents/{batch}/decisions.json", "w") as f:
            json.dump(rows, f)
    made = tables.load_batches(spark, f"{tmp_path}/agents", "id string")
    assert sorted((r.batch, r.id) for r in made.collect()) == [("batch_1", "a"), ("batch_2", "b"), ("batch_2", "c")]
    packets = spark.createDataFrame([("batch_1",), ("batch_3",)], "batch string")
    assert [r.batch for r in tables.missing_batches(spark, packets, made).collect()] == ["batch_3"]
    some = spark.createDataFrame([("1", "P", "solar", "2.5", "10", "20"), ("2", "Q", "wind", None, "0", "20")], "Plant_Code string, Plant_Name string, PrimSource string, Total_MW string, Latitude string, Longitude string")
    assert [tuple(r) for r in registers.plants(some).collect()] == [(1, "P", "solar", 2.5, 10.0, 20.0)]

    image = spark.createDataFrame([("p", [1, 2, 3], [float(x) for x in range(6)])], "path string, shape array<int>, data array<double>")
    tables.save_arrays(image, f"{tmp_path}/arrays")
    back = tables.load_arrays(spark, f"{tmp_path}/arrays/*.npy").first()
    assert list(back.shape) == [1, 2, 3] and list(back.data) == [float(x) for x in range(6)]


def test_small_rules(spark):
    stored = spark.createDataFrame([("a", "x", 1)], "asset_id string, asset_type string, draw long")
    fresh = spark.createDataFrame([("b", "x", 1), ("c", "y", 1)], "asset_id string, asset_type string, draw long")
    assert sorted(r.asset_id for r in sampling.persisted_sample(stored, fresh).collect()) == ["a", "c"]
    pins = spark.createDataFrame([("a", {"naip": "s"}), ("b", {})], "asset_id string, pinned map<string,string>")
    queue.require_pins(pins, allow_partial=True)
    queue.require_pins(pins.filter("asset_id = 'a'"))
    with pytest.raises(ValueError):
        queue.require_pins(pins)
    frames = spark.createDataFrame([("a", 3), ("a", 1), ("b", 2)], "asset_id string, taken long")
    assert sorted(map(tuple, tiles.numbered_windows(frames, ["asset_id"], "taken").collect())) == [("a", 1, 0), ("a", 3, 1), ("b", 2, 0)]
    with pytest.raises(ValueError):
        reconcile.run_log(spark.createDataFrame([("r", 1, 2)], "region string, seq long, surprise long"), [])
    rows = spark.createDataFrame([("a", "accept", "x", " n "), ("b", "relabel", "y", ""), ("c", "unsure", "", "")], "asset_id string, decision string, label string, note string")
    known = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "x"), ("d", "x")], "asset_id string, asset_type string")
    sent = queue.exported(known, rows)
    assert {r.asset_id: (r.verdict, r.cls) for r in sent.collect()} == {"a": ("true", ""), "b": ("false", "y"), "c": ("false", ""), "d": ("", "")}
    back = queue.imported(sent, known, "r").select("asset_id", "decision", "label")
    assert sorted(map(tuple, back.collect())) == [("a", "accept", "x"), ("b", "relabel", "y"), ("c", "unsure", "")]


def test_arrays_and_geojson(spark, tmp_path):
    np.save(f"{tmp_path}/t.npy", np.arange(6, dtype="uint8").reshape(1, 2, 3))
    row = tables.load_arrays(spark, f"{tmp_path}/*.npy").first()
    assert row.shape == [1, 2, 3] and row.data == [0, 1, 2, 3, 4, 5]
    body = {"features": [{"properties": {"n": "a"}, "geometry": {"type": "Point", "coordinates": [1.0, 2.0]}}, {"properties": {"n": "b"}, "geometry": None}]}
    (tmp_path / "p.json").write_text("﻿" + json.dumps(body) + " trailing words", encoding="utf-8")
    rows = tables.tolerant_geojson(spark, f"{tmp_path}/p.json").collect()
    assert [(r.properties["n"], r.kind, r.point) for r in rows] == [("a", "Point", [1.0, 2.0])]


@pytest.mark.parametrize("split", [None, 700])
def test_geojson_of_any_size_and_spacing(spark, tmp_path, split):
    rng = random.Random(3)
    dull = lambda: "".join(rng.choice('ab{}[]"\\ ,:é') for _ in range(rng.randrange(30)))
    shapes = [
        ("Point", [1.5, 2.5]), ("LineString", [[0, 1], [2, 3], [4, 5.25]]), ("MultiLineString", [[[0, 1], [2, 3]], [[4, 5], [6, 7], [8, 9]]]),
        ("Polygon", [[[0, 0], [1, 0], [1, 1], [0, 0]], [[0.1, 0.1], [0.2, 0.1], [0.1, 0.1]]]), ("MultiPolygon", [[[[0, 0], [1, 0], [0, 0]]], [[[5, 5], [6, 5], [5, 5]]]]),
    ]
    want = {}
    for name in ("one", "two"):
        made = []
        for i in range(60):
            kind, coordinates = shapes[i % 5]
            properties = {"n": f"{name}{i}", "text": dull(), dull() + "k": dull(), "deep": {"a": {"b": 1}}}
            feature = {"properties": properties, "geometry": {"type": kind, "coordinates": coordinates}, "type": "Feature"} if i % 7 else {"type": "Feature", "geometry": None, "properties": properties}
            made.append(feature)
            if i % 7:
                want[f"{name}{i}"] = (kind, properties["text"])
        body = {"type": "FeatureCollection", "name": dull(), "crs": {"type": "name", "properties": {"name": "x{"}}, "features": made, "after": {"b": [1]}}
        text = json.dumps(body, indent=2 if name == "one" else None, ensure_ascii=False)
        (tmp_path / f"{name}.json").write_text("\ufeff" + text + ' and {"more": {"words": {}}} }', encoding="utf-8")
    (tmp_path / "none.json").write_text('{"features": []}')
    if split:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        rows = tables.tolerant_geojson(spark, f"{tmp_path}/*.json").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {r.properties["n"]: (r.kind, r.properties["text"]) for r in rows} == want and len(rows) == len(want)
    by = {r.kind: r for r in rows}
    assert by["Point"].point == [1.5, 2.5] and [(p.lat, p.lon) for p in by["LineString"].paths[0]] == [(1.0, 0.0), (3.0, 2.0), (5.25, 4.0)]
    assert [len(p) for p in by["MultiLineString"].paths] == [2, 3] and [x.role for x in by["Polygon"].rings] == ["outer", "inner"]
    assert [(x.role, len(x.pts)) for x in by["MultiPolygon"].rings] == [("outer", 3), ("outer", 3)] and by["Point"].paths is None and by["Point"].rings is None


def test_registers(spark):
    air = spark.createDataFrame([("A", "PU", "X", "AAA", "O", 1.0, 2.0), ("H", "PR", "Y", "BBB", "O", 1.0, 2.0)], "SITE_TYPE_CODE string, FACILITY_USE_CODE string, ARPT_NAME string, ARPT_ID string, ARPT_STATUS string, lat double, lon double")
    assert [tuple(r) for r in registers.aviation(air).collect()] == [("X", 1.0, 2.0, "FAA AAA, public, O", None, False)]
    subs = spark.createDataFrame([("a", "Zone", 66.0, "", 1.0, 1.0), ("b", "Zone", 132.0, "", 1.0, 1.0), ("c", "Zone", 330.0, "", 1.0, 1.0), ("d", "Terminal", None, "Open Street Map", 1.0, 1.0)], "name string, subtype string, kv double, source string, lat double, lon double")
    assert {r.name: r.implies for r in registers.national_substations(subs).collect()} == {"a": DX, "b": None, "c": TX}
    places = spark.createDataFrame([("s", "rail", [(1.0, 2.0), (3.0, 4.0)]), ("t", "bus", [(1.0, 2.0)])], "name string, mode string, points array<struct<lat double, lon double>>")
    assert [(r.name, r.lat, r.lon) for r in registers.stop_places(places).collect()] == [("s", 2.0, 3.0)]
    paths = spark.createDataFrame([(1, 110.0, "Existing", "A", [[[0.0, 1.0], [2.0, 3.0], [4.0, 5.0]]]), (2, 110.0, "Planned", "A", [[[0.0, 1.0], [2.0, 3.0]]])], "line_id long, kv double, status string, country string, paths array<array<array<double>>>")
    assert [[(e.lat, e.lon) for e in r.ends] for r in registers.lines_from_paths(paths, 100, None, ("B",)).collect()] == [[(1.0, 0.0), (5.0, 4.0)]]


def test_first_registers(spark):
    rail = spark.createDataFrame([("Union", "NY", "US", 1.0, 2.0), (None, "NY", "US", 1.0, 2.0), ("", "", "", 1.0, 2.0)], "PASSNGRSTN string, STATE string, COUNTRY string, lat double, lon double")
    assert [tuple(r)[:4] for r in registers.rail_nodes(rail).collect()] == [("Union", 1.0, 2.0, "passenger station node, NY US")]
    stops = spark.createDataFrame([("RLY", "active", "A", 1.0, 2.0, "910A"), ("RLY", "inactive", "B", 1.0, 2.0, "910B"), ("BCT", "active", "C", 1.0, 2.0, "1"), ("RLY", None, "D", 1.0, None, "2")], "StopType string, Status string, CommonName string, Latitude double, Longitude double, ATCOCode string")
    assert [(r.name, r.detail) for r in registers.access_nodes(stops).collect()] == [("A", "national rail station 910A")]
    sites = spark.createDataFrame([("P", "ACSTN", 1.0, 2.0), ("Q", "TEE", 1.0, 2.0)], "name string, type string, lat double, lon double")
    assert [(r.name, r.detail, r.implies) for r in registers.grid_sites(sites).collect()] == [("P", "site ACSTN", TX)]
    assert [r.implies for r in registers.zone_substations(sites).collect()] == [DX, DX]


def test_registers_that_copy_the_map_do_not_confirm_it(spark):
    rows = [("Alpha RAILWAY STATION", "Operational", "OSM", "VIC"), ("Beta  RAILWAY STATION", "Abandoned", "state survey", None), ("Gamma", None, None, "NSW")]
    df = spark.createDataFrame([(*r, 1.0, 2.0) for r in rows], "name string, operationalstatus string, feature_source string, state string, lat double, lon double")
    got = [(r.name, r.detail, r.inactive) for r in registers.national_stations(df).collect()]
    assert got == [("Beta", "GA station, abandoned, ", True), ("Gamma", "GA station, , NSW", False)]


def test_schematic_nodes_have_the_voltages_of_their_lines(spark):
    points = spark.createDataFrame([("Fes", "city", None, 34.0, -5.0), ("", "plant", None, 1.0, 1.0), ("Sub", None, "220/110 kV", 2.0, 2.0), ("Bare", None, "", 3.0, 3.0)], "name string, node_type string, text string, lat double, lon double")
    lines = spark.createDataFrame([(400.0, ["Fes", "Meknes"]), (225.0, ["Fes"]), (None, ["Fes"])], "kv double, nodes array<string>")
    got = [r.detail for r in registers.schematic_points(points, lines).orderBy("lat", ascending=False).collect()]
    assert got == ["a grid node at Fes (city) on 400/225 kV lines", "a substation", "a 220 kV substation", "a grid node at an unnamed place (plant)"]
    lines = spark.createDataFrame([(1, [[[0.0, 1.0], [2.0, 3.0]]])], "line_id long, paths array<array<array<double>>>")
    assert [(r.kv, [tuple(e) for e in r.ends]) for r in registers.feeder_lines(lines).collect()] == [(20.0, [(1.0, 0.0), (3.0, 2.0)])]


def test_line_texts(spark):
    tile = spark.createDataFrame([("t", "Riverside substation", 0.0, 0.0), ("p", "x", 0.5, 0.0), ("far", "x", 10.0, 0.0)], "asset_id string, name string, lat double, lon double")
    at = lambda lat, lon: {"lat": lat, "lon": lon}
    rows = [
        (1, 345.0, False, "RIVERSIDE", "UNKNOWN7", [at(0.001, 0.0), at(0.2, 0.0)]), (2, 138.0, True, "TAP 9", "Elm", [at(0.0, 0.001), at(0.0, 0.2)]),
        (3, None, False, "RIVERSIDE", None, [at(0.0, 0.0), at(-0.2, 0.0)]), (4, 69.0, False, "a", "b", [at(0.5, -0.2), at(0.5, 0.2)]),
    ]
    lines = spark.createDataFrame(rows, "line_id long, kv double, traced boolean, sub_1 string, sub_2 string, ends array<struct<lat double, lon double>>")
    got = {r.asset_id: r for r in evidence.traced_line_evidence(tile, lines, "HIFLD").collect()}
    t = got["t"]
    assert (t.lines_end, t.max_kv, t.names, t.name_match, t.traced_lines, t.transmission) == (3, 345.0, "RIVERSIDE; Elm", True, 1, True)
    assert t.text == (
        "HIFLD: 3 line(s) end here (345/138 kV, 1 unknown voltage, 1 traced from OSM) | HIFLD line ends named: RIVERSIDE, Elm (matches OSM name)"
        " | Caution: 1 of these HIFLD lines were traced from OSM, so they don't count as independent"
    )
    assert got["p"].text == "HIFLD: no line ends here; 1 pass within 300 m (69 kV)" and not got["p"].transmission
    assert (got["far"].text, got["far"].max_kv) == ("HIFLD: no transmission line within 300 m", None)


def test_evidence_texts(spark):
    tile = spark.createDataFrame([("t", TX, "Riverside", 0.0, 0.0), ("u", evidence.UNTYPED, "x", 0.0, 0.0), ("far", TX, "x", 10.0, 0.0)], "asset_id string, asset_type string, name string, lat double, lon double")
    point = spark.createDataFrame([(1, "Riverside yard", 0.001, 0.0, "66 kV", DX, False)], "point_id long, name string, lat double, lon double, detail string, implies string, inactive boolean")
    text = {r.asset_id: r for r in evidence.grid_point_evidence(tile, point, "op", 250).collect()}
    assert text["t"].text.startswith("Caution: op: Riverside yard (66 kV) 111 m away (matches OSM name); the operator lists a distribution")
    assert text["u"].text.endswith("suggests a distribution substation") and not text["u"].corroborated
    assert text["far"].text == "op: no substation within 500 m"
    dense = {r.asset_id: r.text for r in evidence.grid_point_evidence(tile, point, "op", 250, dense=True).collect()}
    assert not dense["t"].startswith("Caution")


def test_pixels(spark):
    rows = [("a", [float(x) for x in range(16)]), ("b", [7.0] * 16)]
    df = spark.createDataFrame([(i, (1, 4, 4, d)) for i, d in rows], "asset_id string, image struct<c int, h int, w int, data array<double>>")
    small = {r.asset_id: r.image.data for r in tiles.resampled(df, 2).collect()}
    assert small["a"] == [0.0, 2.0, 8.0, 10.0]
    smooth = {r.asset_id: r.image.data for r in tiles.resampled(df, 2, bilinear=True).collect()}
    assert smooth["a"] == pytest.approx([2.5, 4.5, 10.5, 12.5])
    flat = {r.asset_id: r.image.data for r in tiles.stretched(df).collect()}
    assert min(flat["a"]) == 0 and max(flat["a"]) == 1 and flat["b"] == pytest.approx([7 / 255] * 16)
    spans = tiles.windows("2026-01-31", 3, 10, spark).orderBy("id").collect()
    assert str(spans[-1].stop) == "2026-01-31" and str(spans[0].start) == "2026-01-01"


def test_settled_functions_leave_their_result_only(spark, tmp_path, monkeypatch):
    from cartolith import session

    monkeypatch.setattr(session, "shared_folder", lambda spark: f"file://{tmp_path}/shared")

    @session.settled
    def inner():
        return session.written(spark.range(5), "inner-part").withColumn("x", F.lit(1))

    @session.settled
    def outer():
        a = session.written(spark.range(5), "outer-part")
        return a.join(inner(), "id")

    out = outer()
    left = os.listdir(f"{tmp_path}/shared")
    assert len(left) == 1 and left[0].startswith("outer-") and out.count() == 5
    session.written(spark.range(1), "kept")
    assert len(os.listdir(f"{tmp_path}/shared")) == 2


def test_a_folder_of_its_own_only_on_a_local_master():
    from types import SimpleNamespace

    from cartolith import session

    def fake(master, folder=None):
        conf = SimpleNamespace(get=lambda *a: folder)
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, applicationId="a1", getConf=lambda: conf))

    assert session.shared_folder(fake("yarn", "hdfs://x/y/")) == "hdfs://x/y"
    local = session.shared_folder(fake("local[2]"))
    assert local.startswith("file://") and session.shared_folder(fake("local[2]")) == local
    with pytest.raises(ValueError):
        session.shared_folder(fake("yarn"))
