import random
from collections import Counter

import duckdb
import numpy as np
from pyspark.sql import functions as F

from cartolith.llm import source_divergence as D
from tests.llm.conftest import save

WORDS = "Alpha beta GAMMA été ÉTÉ señor 日本 delta-x l'eau naïve ſ one two three four five".split()


def rows(seed: int, n: int, sources: int):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(["en", "en", "en", "fr", None, ""])
        text = " ".join(rng.choice(WORDS) + rng.choice(["", "", "a", "b", "Z", "9", "."]) for _ in range(rng.randrange(0, 30)))
        out.append((i, rng.choice([text, text, text, None if i % 9 == 0 else text]), lang, rng.choice([f"s{rng.randrange(sources)}", "hot", "hot", None])))
    out += [(n, "", "xx", "empty"), (n + 1, "123 -- 45", "xx", "none"), (n + 2, "rare words only", "yy", "a"), (n + 3, "rare words", "yy", "b"), (n + 4, "x" * 50_000, "en", "s0")]
    return out + out[:40]


def compared(spark, folder, **kw):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = sorted(tuple(r) for r in D.divergence(docs, **kw).collect())
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{folder}/documents.parquet')")
    want = sorted(con.execute(D.OP13_SQL).fetchall())
    assert got == want
    return got


def test_op13_equals_sql_on_edges(spark, tmp_path, monkeypatch):
    folder = save(tmp_path, rows(1, 400, 5))
    got = compared(spark, folder)
    assert {r[2] for r in got} == {"pair", "term"}
    # languages without kept terms, and groups without terms
    assert ("yy", "a", "pair", "b", 0, 1) in got and ("xx", "empty", "pair", "none", 0, 1) in got
    # many slices of the vocabulary, blocks of terms, tiles of sources
    monkeypatch.setattr(D, "SAMPLED", 1)
    monkeypatch.setattr(D, "BLOCK", 7)
    monkeypatch.setattr(D, "TILE", 2)
    assert compared(spark, folder, slice_terms=25) == got


def test_op13_empty_table(spark, empty_dir):
    assert compared(spark, empty_dir) == []


def test_op13_large_numbers(spark):
    rows = [(10**13, 10**14, 5), (9_000_000_000, 10**10, 7), (8_999_999_999, 10**10, 7), (0, 0, 0), (3, 7, 2)]
    df = spark.createDataFrame(rows, "c long, t long, v long")
    got = [r[0] for r in df.select(D.smoothed(df.c, df.t, df.v)).collect()]
    assert got == [1 + 10**9 * (c + 2) // max(1, t + 2 * v) for c, t, v in rows]


def test_op13_bounds_vocabularies(spark, tmp_path, monkeypatch):
    """No vectorizer holds a whole vocabulary that is larger than a slice."""
    monkeypatch.setattr(D, "SAMPLED", 1)
    held = []
    real = D.fitted
    monkeypatch.setattr(D, "fitted", lambda w, n: held.append(real(w, n)) or held[-1])
    docs = spark.read.parquet(save(tmp_path, rows(2, 300, 3)) + "/documents.parquet")
    counts, terms = D.group_counts(docs, slice_terms=10)
    sizes = [len(m.vocabulary) for m in held if m]
    assert len(sizes) > 3 and max(sizes) < 30
    assert sum(sizes) == counts.select("lang", "term_id").distinct().count() == terms.select("term_id").distinct().count()




def test_op13_vectorizer_sees_what_decides(spark, tmp_path, monkeypatch):
    """A term that a task has met often enough isn't shown to the vectorizer again; terms near the limit come out right."""
    rng = random.Random(3)
    docs = [[i, " ".join(rng.sample(WORDS, 6)), rng.choice(["en", "fr", None]), f"s{i % 3}"] for i in range(4000)]
    for n in range(7, 14):  # each in n documents of one language, in two sources, all over the table
        for i in rng.sample([d[0] for d in docs if d[2] == "en"], n):
            docs[i][1] += f" edge{'x' * n} edge{'x' * n}"
    folder = save(tmp_path, [tuple(d) for d in docs])
    shown = []
    real = D.fitted
    monkeypatch.setattr(D, "fitted", lambda w, n: shown.append(w.select(F.sum(F.size("terms"))).first()[0]) or real(w, n))
    got = sorted(tuple(r) for r in D.divergence(spark.read.parquet(f"{folder}/documents.parquet").coalesce(1)).collect())
    assert shown[0] < 4000 * 6 / 4
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{folder}/documents.parquet')")
    assert got == sorted(con.execute(D.OP13_SQL).fetchall())
    # too few slots, sums passed on often, in short pieces, many tasks
    for name, value in (("SLOTS", 2), ("PENDING", 500), ("SUMS", 40), ("PIECE", 3)):
        monkeypatch.setattr(D, name, value)
    assert sorted(tuple(r) for r in D.divergence(spark.read.parquet(f"{folder}/documents.parquet").repartition(7)).collect()) == got


def test_op13_open_terms_reach_the_limit_exactly():
    rng = np.random.default_rng(5)
    for slots in (1, 8, 1 << 10):
        met, docs, shown = D.Met(slots), Counter(), Counter()
        for _ in range(40):
            hashes = np.concatenate([np.unique(rng.zipf(1.3, 30) % 200) for _ in range(3)]).astype(np.uint64)
            docs.update(hashes.tolist())
            shown.update(hashes[met.open(hashes, 10)].tolist())
        assert all(shown[h] == n or 10 <= shown[h] <= n for h, n in docs.items())
        assert slots < 1 << 10 or max(shown.values()) <= 12 < max(docs.values())  # three documents a call
