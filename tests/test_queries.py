"""Every query against its SQL twin, and the properties that matter."""

import hashlib
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from cartolith import ontology, plans
from cartolith.functions import geo, names, tags
from cartolith.operators import dedup, evidence, footprint, metrics, ranking, review, sampling

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 8)
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="session")
def duck(sf):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def labelled(sf):
    import pyarrow.parquet as pq

    return {r["vec_id"]: r for r in pq.read_table(f"{sf}/embeddings.parquet").to_pylist()}


def check_hints(spark, sf, rows):
    """A hint for every embedding, which doesn't follow from its own label: as good as the probabilities say, no better."""
    known = labelled(sf)
    assert sorted(r.id for r in rows) == sorted(known)
    for r in rows:
        assert 0 <= r.p_label <= r.p_top + 1e-9 <= 1 + 2e-9
        assert (r.suggests == known[r.id]["label"]) <= (r.p_label == r.p_top)


def check_probe(spark, sf, rows):
    """Predictions for exactly the test rows, with their own truth."""
    known = labelled(sf)
    assert {r.id: r.truth for r in rows} == {k: v["label"] for k, v in known.items() if k % 20 >= 17}
    assert all(0 <= r.pred < 10 for r in rows)


def check_intervals(spark, sf, rows):
    """Both bounds leave 2.5 % in the binomial tail beyond them; the counts are those of the rows."""
    assert rows
    for r in rows:
        k, n = r.correct, r.reviewed - r.unsure
        tail = lambda p, ks: sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in ks)  # noqa: E731, B023
        assert 0 <= k <= n <= r.sampled <= r.class_size and r.accuracy_pct == pytest.approx(100 * k / n, abs=0.06)
        assert k == 0 or tail(r.ci_low, range(k, n + 1)) == pytest.approx(0.025, rel=1e-3)
        assert k == n or tail(r.ci_high, range(k + 1)) == pytest.approx(0.025, rel=1e-3)


#: Queries without a twin: models, and a distribution function that SQL lacks.
CHECKED = {"h1_out_of_fold_hints": check_hints, "h2_linear_probe": check_probe, "h2_probe_three_tenths": check_probe, "d30_class_accuracy": check_intervals}


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query_equals_sql(spark, sf, duck, name):
    df = plans.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    rows = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    if name not in plans.SQL:
        CHECKED[name](spark, sf, df.collect())
        return
    cursor = duck.execute(plans.SQL[name])
    have = [d[0] for d in cursor.description]
    assert sorted(have) == columns
    at = [have.index(c) for c in columns]
    assert rows == sorted(repr(tuple(plain(r[i]) for i in at)) for r in cursor.fetchall())


def assets(spark, rows):
    return spark.createDataFrame(rows, "asset_id string, asset_type string, lat double, lon double, pos long")


def distance(a, b):
    la, lb = math.radians(a[2]), math.radians(b[2])
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(b[3] - a[3]) / 2) ** 2
    return 2 * geo.DEDUP_R * math.asin(math.sqrt(h))


def greedy(rows):
    radius = {c.name: c.radius_m for c in ontology.CLASSES}
    kept = []
    for r in sorted(rows, key=lambda r: (r[4], r[0])):
        if all(k[1] != r[1] or distance(k, r) > radius[r[1]] for k in kept):
            kept.append(r)
    return {r[0] for r in kept}


@pytest.mark.parametrize("lat0", [0.0, 45.0, 75.0, -89.9])
def test_greedy_dedup_equals_the_sequential_walk(spark, lat0):
    rng = random.Random(int(lat0) + 100)
    kinds = ("transport.train_station", "energy.transmission.substation", "energy.generation.solar_farm")
    rows = [
        (f"a{i}", kinds[i % 3], max(-90.0, min(90.0, lat0 + rng.uniform(-0.02, 0.02))), (179.99 + rng.uniform(-0.03, 0.05) + 180) % 360 - 180, i)
        for i in range(150)
    ]
    df = assets(spark, rows)
    for parts in (1, 7):
        out = dedup.deduplicate(df.repartition(parts)).collect()
        assert {r.asset_id for r in out if r.kept} == greedy(rows)
    assert dedup.conservation(df, dedup.deduplicate(df)).isEmpty()


def test_a_crowd_keeps_few_and_needs_few_rounds(spark):
    # one class, all rows in a cell or two: no pairs of all with all
    rng = random.Random(5)
    rows = [(f"a{i}", "energy.transmission.substation", 45 + rng.uniform(0, 0.004), 7 + rng.uniform(0, 0.004), rng.randrange(10**6)) for i in range(600)]
    out = dedup.deduplicate(assets(spark, rows)).collect()
    assert len(out) == len(rows) and {r.asset_id for r in out if r.kept} == greedy(rows)
    by = {r[0]: r for r in rows}
    kept = [r.asset_id for r in out if r.kept]
    for r in out:
        if not r.kept:
            assert distance(by[r.asset_id], by[r.deduplicated_by]) == pytest.approx(min(distance(by[r.asset_id], by[k]) for k in kept))


def rounds_of(monkeypatch):
    levels, real = [], dedup.widest_level
    monkeypatch.setattr(dedup, "widest_level", lambda *a: levels.append(real(*a)) or levels[-1])
    return levels


def test_a_chain_takes_a_round_for_each_block_not_for_each_row(spark, monkeypatch):
    # 175 m apart in order, the class's radius is 200 m: each row waits for the one before
    rows = [(f"c{i:04d}", "energy.transmission.substation", 10.0, i * 175 / 111_320 / math.cos(math.radians(10)), i) for i in range(2000)]
    levels = rounds_of(monkeypatch)
    out = dedup.deduplicate(assets(spark, rows))
    assert len(levels) == 1
    assert {r.asset_id for r in out.collect() if r.kept} == {r[0] for r in rows[::2]}
    # small blocks: rounds follow crossings of blocks
    monkeypatch.setattr(dedup, "BLOCK_ROWS", 500)
    levels.clear()
    out = dedup.deduplicate(assets(spark, rows))
    assert len(levels) < 10 and min(levels) >= 0
    assert {r.asset_id for r in out.collect() if r.kept} == {r[0] for r in rows[::2]}


@pytest.mark.parametrize("block_rows", [12, 6])
def test_small_blocks_equal_the_walk(spark, monkeypatch, block_rows):
    rng = random.Random(block_rows)
    kinds = ("transport.train_station", "energy.transmission.substation")
    spots = [(rng.uniform(-80, 80), rng.uniform(-180, 180)) for _ in range(6)] + [(0.0, 179.999), (89.99, 0.0)]
    rows = []
    for i in range(400):
        lat, lon = rng.choice(spots)
        lon = (lon + rng.uniform(-0.02, 0.02) + 180) % 360 - 180
        rows.append((f"a{i}", rng.choice(kinds), max(-90.0, min(90.0, lat + rng.uniform(-0.02, 0.02))), lon, rng.randrange(200)))
    monkeypatch.setattr(dedup, "BLOCK_ROWS", block_rows)
    levels = rounds_of(monkeypatch)
    out = dedup.deduplicate(assets(spark, rows)).collect()
    assert {r.asset_id for r in out if r.kept} == greedy(rows) and len(out) == len(rows)
    assert len(levels) > 1 and (block_rows > 6 or -1 in levels)


def test_no_window_sees_a_whole_class(spark):
    rows = [(f"t{i}", "only", "r", "train", i) for i in range(900)]
    df = spark.createDataFrame(rows, "asset_id string, asset_type string, region string, split string, pos long").repartition(5)
    out = ranking.numbered(df, ["asset_type"], [F.col("pos").desc()], "rank", "size").collect()
    assert all((r["rank"], r["size"]) == (900 - r.pos, 900) for r in out)
    for made in (
        sampling.proportional_sample(df, ["region"], 50), sampling.fraction_sample(df, 0.3), sampling.class_sample(df), sampling.random_split(df, ["region"]),
        sampling.class_fallback(df.withColumn("split_protocol", F.lit("spatial_block")), ["only"]), ranking.batches(df, ["asset_type"], ["asset_id"], 50),
    ):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        ranks = [line for line in plan.splitlines() if "row_number()" in line]
        # of a range partition, or of a bin of digests
        assert ranks and all("part__" in line or "bin__" in line for line in ranks)
    nulls = spark.createDataFrame([(None, 1), (None, 2), ("a", 1)], "g string, k long")
    assert sorted((str(r.g), r.k, r["rank"]) for r in ranking.numbered(nulls, ["g"], ["k"]).collect()) == [("None", 1, 1), ("None", 2, 2), ("a", 1, 1)]


@pytest.mark.parametrize("bin_rows", [100_000, 3])
def test_pieces_equal_ranks(spark, monkeypatch, bin_rows):
    monkeypatch.setattr(ranking, "BIN_ROWS", bin_rows)
    rng = random.Random(bin_rows)
    rows = [(i % 400, rng.choice(["a", "a", "b", None]), i) for i in range(500)]  # ties in the drawn key
    names = "key long, g string, draw__ long"
    df = spark.createDataFrame(rows, names).repartition(3)
    wanted = {"a": [0, 100, 100], "b": [-5, 7, 999], None: [1, 2, 3]}
    table = spark.createDataFrame([(g, v) for g, v in wanted.items()], "g string, limits array<bigint>")
    limits = lambda sizes: sizes.join(table.withColumnRenamed("g", "h"), F.col("g").eqNullSafe(F.col("h"))).select("g", "limits")
    got = ranking.pieces(df, ["g"], ranking.draw_key(1, "key"), "draw__", limits).collect()
    digest = lambda k: hashlib.md5(f"1|{k}".encode()).hexdigest()
    want = {}
    for g in wanted:
        ordered = sorted((digest(k), i, k) for k, h, i in rows if h == g)
        for rank, (_, i, _) in enumerate(ordered, 1):
            want[i] = sum(rank > x for x in wanted[g])
    assert {r.draw__: r.piece for r in got} == want and len(got) == 500


def test_numbers_leave_clashing_columns(spark):
    df = spark.createDataFrame([(i, "x", i * 7, "y", "z", "w") for i in range(20)], "k long, part__ string, inside__ long, before__ string, group0__ string, __i string")
    out = ranking.numbered(df, ["part__"], ["k"], "rank").collect()
    assert all((r["rank"], r.part__, r.inside__, r.before__, r.group0__) == (r.k + 1, "x", r.k * 7, "y", "z") for r in out)
    out = ranking.dense_order(df, ["k"]).collect()
    assert all((r.order, r.part__, r.inside__, r["__i"]) == (r.k, "x", r.k * 7, "w") for r in out)


def test_chain_keeps_both_ends(spark):
    rows = [("a", "energy.transmission.substation", 0.0, 0.0, 0), ("b", "energy.transmission.substation", 0.0, 0.0015, 1), ("c", "energy.transmission.substation", 0.0, 0.003, 2)]
    out = {r.asset_id: r for r in dedup.deduplicate(assets(spark, rows)).collect()}
    assert out["a"].kept and not out["b"].kept and out["c"].kept and out["b"].deduplicated_by == "a"


def test_radius_join_finds_every_pair(spark):
    rng = random.Random(4)
    rows = [(str(i), "x", rng.choice([rng.uniform(-90, 90), 89.999, -89.99, 60.0 + rng.uniform(0, 0.01)]), rng.choice([rng.uniform(-180, 180), 180.0, -180.0, 10 + rng.uniform(0, 0.02)]), i) for i in range(400)]
    df = assets(spark, rows)
    got = {(r.asset_id, r.r_asset_id) for r in geo.radius_join(df, df, 500.0).select("asset_id", "r_asset_id").collect()}
    want = {(a[0], b[0]) for a in rows for b in rows if distance(a, b) <= 500}
    assert got == want


def test_spatial_joins_are_equi_joins(spark, sf):
    for name in ("c1_radius_self_join", "c3_nearest_three", "c6_lines_ending", "c18_best_scenes"):
        plan = plans.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


@pytest.mark.parametrize("name", ["c7_bent_lines_passing", "c7_lines_passing"])
def test_lines_and_tiles_are_not_broadcast(spark, sf, name):
    """Only the nations and regions of the tiles' view are, of however few bytes the files of lines and tiles seem."""
    plan = plans.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    joins = [x for x in plan.splitlines() if "BroadcastHashJoin" in x]
    assert all("n_nationkey" in x or "r_regionkey" in x for x in joins) and "SortMergeJoin" in plan


def test_an_end_counts_for_its_own_line_only(spark):
    """Line 2 ends at the tile that line 1 passes; line 3 has two rows, of which one ends there."""
    tiles = spark.createDataFrame([("a", 10.0, 20.0), ("b", 10.1, 20.0), ("c", 10.2, 20.0)], "asset_id string, lat double, lon double")
    at = lambda lat: {"lat": lat, "lon": 20.0}
    rows = [(1, [at(10.0), at(10.2)]), (2, [at(10.0), at(10.1)]), (3, [at(9.9), at(10.3)]), (3, [at(10.1), at(10.15)]), (4, [at(9.9), at(10.3)])]
    lines = spark.createDataFrame([(i, 110.0, e) for i, e in rows], "line_id long, kv double, ends array<struct<lat double, lon double>>")
    got = {(r.asset_id, r.line_id) for r in evidence.passing_lines(tiles, lines).collect()}
    assert got == {("b", 1), ("a", 3), ("c", 3), ("a", 4), ("b", 4), ("c", 4)}


def test_registry_is_sound(spark):
    table = ontology.registry(spark)
    assert ontology.violations(table).isEmpty()
    bad = table.withColumn("radius_m", F.when(F.col("priority") == 0, -1.0).otherwise(F.col("radius_m")))
    assert [(r.name, r.rule) for r in ontology.violations(bad).collect()] == [("energy.transmission.substation", "radius")]
    late = table.withColumn("priority", F.when(F.col("name").endswith("untyped"), F.lit(-1)).otherwise(F.col("priority")))
    assert {r.rule for r in ontology.violations(late).collect()} == {"after_catch_all"}


def test_tag_rules(spark):
    rows = [
        ({"power": "substation", "substation": "transmission"}, "way", None, "energy.transmission.substation"),
        ({"power": "substation"}, "node", None, "energy.distribution.substation_untyped"),
        ({"power": "substation", "building": "transformer_tower"}, "way", None, None),
        ({"power": "plant", "plant:source": "solar"}, "way", None, "energy.generation.solar_farm"),
        ({"power": "plant", "plant:source": "solar"}, "node", None, None),
        ({"railway": "station"}, "node", None, None),
        ({"railway": "station", "name": "x"}, "node", None, "transport.train_station"),
        ({"aeroway": "aerodrome"}, "way", 499_999.0, None),
        ({"aeroway": "aerodrome"}, "way", 500_000.0, "transport.airport"),
        ({"aeroway": "aerodrome"}, "way", None, None),
    ]
    df = spark.createDataFrame(rows, "tags map<string,string>, t string, area double, want string")
    out = df.select("want", tags.best_class(F.col("tags"), F.col("t"), F.col("area")).alias("got")).collect()
    assert [r.want for r in out] == [r.got for r in out]


def test_names_and_voltages(spark):
    hints = [("Éolienne", ""), ("Aéroport de Lyon", "transport.airport"), ("AÉROPORT", "transport.airport"), ("waste water treatment", "water.wastewater.plant"), ("Insolare", "")]
    df = spark.createDataFrame(hints, "name string, want string")
    out = df.select("want", names.name_hint(F.col("name"), F.lit("telecom.data_center")).alias("got")).collect()
    assert [r.want for r in out] == [r.got for r in out]
    volts = spark.createDataFrame([("PARKLANDS ( 66 / 11 KV)", [66.0, 11.0]), ("13.2 | 33", [13.2, 33.0]), ("0.4 / 5000", [])], "t string, want array<double>")
    assert all(r.want == r.got for r in volts.select("want", names.kvs(F.col("t")).alias("got")).collect())
    cases = spark.createDataFrame([([500.0], [220.0], names.TX), ([33.0], [11.0], names.DX), ([132.0], [33.0, 13.2], None)], "h array<double>, l array<double>, want string")
    assert all(r.want == r.got for r in cases.select("want", names.by_voltage(F.col("h"), F.col("l")).alias("got")).collect())


def test_block_split_is_coherent(spark):
    rng = random.Random(8)
    rows = [(f"t{i}", f"r{i % 3}", "c", f"b{i % 3}_{rng.randrange(40)}") for i in range(1500)]
    df = spark.createDataFrame(rows, "asset_id string, region string, asset_type string, block_id string")
    a = sampling.block_split(df)
    assert sampling.split_violations(a, slack=0.05).isEmpty()
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, sampling.block_split(df.repartition(13)).collect()))
    assert sorted(map(tuple, a.collect())) != sorted(map(tuple, sampling.block_split(df, seed=7).collect()))
    with pytest.raises(ValueError):
        sampling.block_split(df, fractions=(0.5, 0.5, 0.5))


def test_decision_rules(spark):
    rows = [("one", "a", "accept", "x"), ("two", "a", "relabel", "y"), ("three", "a", "unsure", ""), ("four", "a", "accept", "x"), ("four", "b", "accept", "x"), ("five", "a", "accept", "x"), ("five", "b", "relabel", "y"), ("six", "a", "unsure", ""), ("six", "b", "accept", "x")]
    df = spark.createDataFrame(rows, "asset_id string, reviewer string, decision string, label string")
    one = {r.asset_id: r.status for r in review.status(df).collect()}
    two = {r.asset_id: r.status for r in review.status(df, second_opinion=True).collect()}
    assert one == {"one": "done", "two": "done", "three": "unsure", "four": "done", "five": "disputed", "six": "done"}
    assert two == {"one": "done", "two": "needs_second", "three": "needs_second", "four": "done", "five": "disputed", "six": "disputed"}
    assert review.invalid(df).isEmpty()


def test_clopper_pearson(spark):
    df = spark.createDataFrame([(0, 0), (0, 10), (10, 10), (8, 20)], "k long, n long")
    out = [r.ci for r in df.select("k", "n", review.clopper_pearson(F.col("k"), F.col("n")).alias("ci")).orderBy("n", "k").collect()]
    assert out[0].low is None
    assert out[1].high == pytest.approx(1 - 0.025**0.1, abs=1e-6) and out[2].low == pytest.approx(0.025**0.1, abs=1e-6)
    assert (out[3].low, out[3].high) == (pytest.approx(0.1912, abs=1e-3), pytest.approx(0.6395, abs=1e-3))


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1)], "truth int, pred int")
    classes = metrics.per_class(metrics.confusion(df, 3))
    by = {r.cls: r for r in classes.collect()}
    assert (by[0].precision, by[0].recall, by[1].precision, by[1].recall, by[2].f1) == (1.0, 0.5, pytest.approx(2 / 3), 1.0, 0.0)
    assert metrics.overall(classes, present=True).first().macro_f1 == pytest.approx((2 / 3 + 0.8) / 2)
    assert metrics.overall(classes).first().macro_f1 == pytest.approx((2 / 3 + 0.8) / 3)


def test_footprints_by_hand():
    import numpy as np

    square = np.array([[-100, -100], [100, -100], [100, 100], [-100, 100]], float)
    hole = square / 2
    got = footprint.measure([("outer", square), ("inner", hole)])
    assert got == {"area_m2": 30000.0, "extent_m": 200.0, "tile_share": round(30000 / 360000, 5), "exceeds_tile": False}
    big = square * 5
    assert footprint.measure([("outer", big)])["tile_share"] == 1.0 and footprint.measure([("outer", big)])["exceeds_tile"]
    turned = square @ np.array([[math.cos(0.5), -math.sin(0.5)], [math.sin(0.5), math.cos(0.5)]])
    assert footprint.measure([("outer", turned)])["extent_m"] == pytest.approx(200.0, abs=0.1)
    assert footprint.measure([("outer", square[:2])]) is None


def test_footprints_are_rounded_once(spark, sf, tmp_path):
    """Customers whose area or share comes near a half: rounded to a decimal first, it would be rounded to the other side."""
    duckdb = pytest.importorskip("duckdb")
    keys = [1555, 2257, 2725, 6014]
    spark.createDataFrame([(k, f"Customer#{k}", 0, 0.0) for k in keys], "c_custkey long, c_name string, c_nationkey int, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    for t in ("nation", "region"):
        spark.read.parquet(f"{sf}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    con = duckdb.connect()
    for t in ("customer", "nation", "region"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    cursor = con.execute(plans.SQL["g3_footprints"])
    have = [d[0] for d in cursor.description]
    want = sorted(cursor.fetchall())
    assert len(want) == len(keys)
    assert sorted(tuple(r[c] for c in have) for r in plans.QUERIES["g3_footprints"](spark, str(tmp_path)).collect()) == want


def test_dense_order_and_chunks(spark):
    df = spark.range(1003).select(((F.col("id") * 7919) % 1003).alias("k"))
    out = ranking.dense_order(df, ["k"]).collect()
    assert all(r.k == r.order for r in out)
    sizes = [r["count"] for r in ranking.equal_chunks(df, ["k"], 7).groupBy("chunk").count().orderBy("chunk").collect()]
    assert sizes == [144, 144, 143, 143, 143, 143, 143]


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and callable(e.entry)
