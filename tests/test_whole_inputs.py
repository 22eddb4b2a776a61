"""Queries see every row of their tables; wanted values come from plain Python, not from the SQL twins."""

from pyspark.sql import functions as F

from cartolith import plans
from cartolith.fixtures import view

REVIEWER = ("r0", "r1", "r2", "source")


def latest_by_hand(spark, sf_dir):
    """(asset, reviewer) -> (decision, label) of the last line in the whole events table."""
    kinds = {"purchase": ("relabel", "energy.generation.solar_farm"), "error": ("unsure", "")}
    last = {}
    for e in sorted(spark.read.parquet(f"{sf_dir}/events.parquet").collect(), key=lambda e: e.event_id):
        last[f"osm_way_{e.user_id}", REVIEWER[e.event_id % 4]] = kinds.get(e.event_type, ("accept", "energy.generation.power_plant"))
    return last


def test_every_event_is_a_decision(spark, sf):
    assert view(spark, sf, "decisions_fx").count() == spark.read.parquet(f"{sf}/events.parquet").count()
    got = {(r.asset_id, r.reviewer): (r.decision, r.label) for r in plans.QUERIES["e14_latest_decisions"](spark, sf).collect()}
    assert got == latest_by_hand(spark, sf)


def test_every_customer_gets_a_pass(spark, sf, tmp_path):
    spark.createDataFrame([(k,) for k in range(1, 451)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    spark.read.parquet(f"{sf}/events.parquet").withColumn("user_id", F.col("event_id") % 400).write.parquet(f"{tmp_path}/events.parquet")
    entries = {}
    for (asset, reviewer), said in latest_by_hand(spark, tmp_path).items():
        entries.setdefault(asset, {})[reviewer] = said

    def wanted(asset):
        own = entries.get(asset)
        if not own:
            return "first"
        labels = [label for decision, label in own.values() if decision != "unsure"]
        done = [d for d, _ in own.values()] == ["accept"] or len(labels) >= 2 and len(set(labels)) == 1
        return "second" if not done and "r1" not in own else ""

    got = plans.QUERIES["g14_passes"](spark, str(tmp_path)).collect()
    assert sorted((r.asset_id, r["pass"]) for r in got) == sorted((f"osm_way_{k}", wanted(f"osm_way_{k}")) for k in range(1, 451))
    assert {r["pass"] for r in got} == {"first", "second", ""}


def test_every_part_is_an_epoch(spark, sf):
    e = view(spark, sf, "epochs_fx")
    assert e.count() == spark.read.parquet(f"{sf}/part.parquet").count() == e.select("model", "protocol", "seed", "epoch").distinct().count()
    runs = {}
    for r in e.collect():
        runs.setdefault((r.model, r.protocol), {}).setdefault(r.seed, []).append(r.epoch)
    assert len(runs) == 8
    for seeds in runs.values():
        assert all(sorted(x) in (list(range(len(x))), list(range(1, len(x) + 1))) for x in seeds.values())
        assert len(seeds[0]) > len(seeds[1]) > len(seeds[2])
    last = {run: min(max(x) for x in seeds.values()) for run, seeds in runs.items()}
    got = {(r.model, r.protocol): r["n"] for r in plans.QUERIES["e23_curves"](spark, sf).groupBy("model", "protocol").agg(F.count("*").alias("n")).collect()}
    assert got == {run: len({x for own in seeds.values() for x in own if x <= last[run]}) for run, seeds in runs.items()}
