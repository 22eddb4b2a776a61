"""Near-duplicate groups that are larger than what is compared at once."""

import random
from collections import Counter

import numpy as np
from cartolith.llm import kernel as K
from cartolith.llm import near_dedup
from tests.llm.conftest import prose, save
from tests.llm.test_models_and_pairs import brute_classes


def edited_family(n: int, words: int, edits: int, seed: int, first: int = 0):
    rng, rows = random.Random(seed), []
    base = prose(seed, words).split()
    for i in range(n):
        own = list(base)
        for _ in range(rng.randrange(edits + 1)):
            own[rng.randrange(words)] = f"edit{seed}x{i}"
        rows.append((first + i, " ".join(own), "en", "s"))
    return rows


def test_crowded_buckets_lose_no_link(spark, tmp_path):
    # edits up to a level at which most pairs are below 0.8 and single links hold classes together
    rows = edited_family(90, 100, 6, 1) + edited_family(40, 60, 4, 2, 1000)
    folder = save(tmp_path / "d", rows)
    out = near_dedup.classes(spark.read.parquet(f"{folder}/documents.parquet"), block=10)
    assert Counter((r.doc_id, r.class_id) for r in out.collect()) == brute_classes(rows)


def test_a_bucket_over_the_block_in_production(spark, tmp_path):
    rows = edited_family(3 * near_dedup.BLOCK, 80, 5, 4)
    folder = save(tmp_path / "d", rows)
    out = near_dedup.classes(spark.read.parquet(f"{folder}/documents.parquet"))
    assert Counter((r.doc_id, r.class_id) for r in out.collect()) == brute_classes(rows)


def test_components_of_chains_and_stars(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(60)] + [(100 + i, 161 - i) for i in range(31)] + [(200, 201 + i) for i in range(40)]
    links += [(300 + rng.randrange(50), 300 + rng.randrange(50)) for _ in range(30)]
    rng.shuffle(links)
    frame = spark.createDataFrame([(f"{a:04}".encode(), f"{b:04}".encode()) for a, b in links], "a binary, b binary")
    up = {x: x for pair in links for x in pair}
    for _ in range(100):
        for a, b in links:
            up[a] = up[b] = min(up[a], up[b])
    got = {int(r.node): int(r.label) for r in near_dedup.components(frame).collect()}
    assert got == {n: r for n, r in up.items() if n in got} and set(up) - set(got) == {a for a, b in links if a == b} - {x for a, b in links if a != b for x in (a, b)}


def test_intersections_equal_sets():
    rng = np.random.default_rng(5)
    for n, most in ((1, 5), (7, 40), (60, 300)):
        sets = [np.unique(rng.integers(0, 500, rng.integers(0, most))).astype(K.U) for _ in range(n)]
        want = [[len(np.intersect1d(a, b)) if i != j else None for j, b in enumerate(sets)] for i, a in enumerate(sets)]
        got = near_dedup.intersections(sets)
        assert all(want[i][j] == got[i, j] for i in range(n) for j in range(n) if i != j)


def test_recall_by_rate_of_edits(spark, tmp_path):
    """All pairs of similarity 0.8 or more are linked, whatever the share of changed words."""
    rows, first = [], 0
    for rate in (0.005, 0.01, 0.02, 0.03):
        for g in range(25):
            rng = random.Random(f"{rate}-{g}")
            base = prose(5000 + first, 200).split()
            own = [f"w{first}x{i}" if rng.random() < rate else w for i, w in enumerate(base)]
            rows += [(first, " ".join(base), "en", "s"), (first + 1, " ".join(own), "en", "s")]
            first += 2
    folder = save(tmp_path / "d", rows)
    got = Counter((r.doc_id, r.class_id) for r in near_dedup.classes(spark.read.parquet(f"{folder}/documents.parquet")).collect())
    assert got == brute_classes(rows)


def test_clashing_names(spark, tmp_path):
    from pyspark.sql import functions as F

    folder = save(tmp_path / "d", edited_family(20, 60, 1, 7))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = ["key", "first", "node", "label", "count", "__key", "Key_"]
    for name in names:
        docs = docs.withColumn(name, F.concat(F.lit(name), F.col("doc_id").cast("string")))
    out = near_dedup.deduplicated(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert rows and all(r[name] == f"{name}{r.doc_id}" for r in rows for name in names)
