"""Nothing is dropped by length, number or order of rows; joint risks hold; other columns may have any name."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cartolith.llm import mixing, quality_classifier, quality_rules, samples, secret_scan, sharding, toxicity
from cartolith.llm.language import trained as trained_languages
from cartolith.llm.shared import skew_join, written
from tests.llm.conftest import prose, save
from tests.llm.test_bpe_sharding_mixing_rules import op
from tests.llm.test_models_and_pairs import auc


def read(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def labels(spark, folder):
    return spark.read.parquet(f"{folder}/labels.parquet")


def test_models_learn_from_long_texts(spark, tmp_path):
    # every labelled text has over 20 000 characters; the bad words are far behind
    rng, rows, marks = random.Random(3), [], []
    for i in range(360):
        bad = i % 2
        words = prose(i, 4000).split()
        for _ in range(500):
            words[rng.randrange(2500, 4000)] = f"{'vile' if bad else 'mild'}{rng.randrange(3)}"
        rows.append((i, " ".join(words), "en", "s"))
        marks.append((i, 1 - bad, bad))
    folder = save(tmp_path / "d", rows, marks)
    assert min(len(r[1]) for r in rows) > 20_000
    toxic = {r.doc_id: r.score for r in op(3)(spark, folder).collect()}
    good = {r.doc_id: r.score for r in op(4)(spark, folder).collect()}
    assert auc([(t, toxic[i]) for i, _, t in marks]) > 0.95 and auc([(q, good[i]) for i, q, _ in marks]) > 0.95


def test_excerpts_are_of_the_whole_text():
    text = prose(1, 20_000)
    short = samples.excerpt(text)
    assert len(short) < 25_000 and set(short.split()) <= set(text.split())
    at = [text.find(piece) / len(text) for piece in short.split("\n")]
    assert min(at) >= 0 and at == sorted(at) and min(at) < 0.1 and max(at) > 0.9
    assert samples.excerpt("a b") == "a b" and samples.excerpt("x" * 30_000) == "x" * 30_000 and samples.excerpt(" " * 30_000) == ""


def test_samples_depend_on_rows_alone(spark, tmp_path):
    # one id has many rows with different texts: which of them is learned from does not depend on their order
    rows = [(i % 7, prose(i, 30), "en", "s") for i in range(200)]
    folder = save(tmp_path / "d", rows, [(i, i % 2, i % 2) for i in range(7)])
    docs = read(spark, folder).select("doc_id", "text", "lang")
    picks = [
        sorted(map(tuple, samples.labelled_sample(docs.repartition(n), labels(spark, folder), "toxic", F.lit(True), 50).collect())) for n in (1, 5)
    ]
    assert picks[0] == picks[1] and [p[0] for p in picks[0]] == list(range(7))
    a, b = (trained_languages(docs.repartition(n), 20) for n in (1, 6))
    assert (a.bits == b.bits).all() and a.bits.any()


def test_short_texts_have_a_language(spark, tmp_path):
    rng, rows = random.Random(4), []
    words = {"en": "no one the and of to".split(), "es": "hola si el los una con".split()}
    for i in range(300):
        lang = ("en", "es")[i % 2]
        rows.append((i, " ".join(rng.choice(words[lang]) for _ in range(20)), lang, "s"))
    rows += [(1000, "hola", None, "s"), (1001, "the", None, "s"), (1002, "si", None, "s"), (1003, "of", None, "s")]
    out = {r.doc_id: r for r in op(6)(spark, save(tmp_path / "d", rows)).collect()}
    assert [out[i].lang_pred for i in range(1000, 1004)] == ["es", "en", "es", "en"]
    assert all(out[i].score > 0.5 for i in range(1000, 1004))


def test_rules_hold_their_joint_risk():
    """Rules that each reject few good texts, but different ones: their union is what is bounded."""
    rng = np.random.default_rng(1)
    n, rules = 4000, list(quality_rules.RULES)
    good = rng.random(n) < 0.5
    bins = {k: np.where(rng.random(n) < np.where(good, 0.012, 0.3), 40, 2) for k in rules}
    half = np.arange(n) < n // 2

    def histogram(rows):
        seen = Counter((k, int(bins[k][i]), int(good[i])) for i in np.flatnonzero(rows) for k in rules)
        return [{"stratum": "=x", "rule": k, "bin": b, "good": g, "n": c} for (k, b, g), c in seen.items()]

    proposed = quality_rules.candidates(histogram(half))
    assert proposed["=x"]
    counts = {}
    for i, cut in enumerate(proposed["=x"]):
        hit = np.any([bins[k] >= b for k, b in cut.items()], 0)
        counts["=x", i] = tuple(int(x.sum()) for x in (hit & half & ~good, hit & half & good, hit & ~half & good, ~half & good))
    chosen = quality_rules.chosen_cutoffs(proposed, counts)
    # all five rules reject about 6 % of the good ones together: no such candidate may be taken at a risk of 2 %
    for cut in chosen.values():
        hit = np.any([bins[k] >= b for k, b in cut.items()], 0)
        assert (hit & good).sum() <= 0.02 * good.sum()
    wide = quality_rules.chosen_cutoffs(proposed, counts, risk=0.5)
    assert wide["=x"]
    assert quality_rules.chosen_cutoffs(proposed, {k: (100, 0, 0, 10) for k in counts}) == {}


def test_equal_texts_are_one_trial(spark, tmp_path):
    # 900 copies of one good loud text are one trial; bounds on 40 good texts allow no cutoff
    rows = [(i, prose(i, 60), "en", "s") for i in range(80)] + [(1000 + i, prose(7, 60), "en", "s") for i in range(900)]
    rows += [(5000 + i, prose(9000 + i, 60).upper(), "en", "s") for i in range(300)]
    marks = [(r[0], int(r[0] < 5000), 0) for r in rows]
    folder = save(tmp_path / "d", rows, marks)
    out = {r.doc_id: r.kept for r in op(7)(spark, folder).collect()}
    assert all(out.values())
    # with as many different good texts the cutoff is allowed
    rows += [(20_000 + i, prose(30_000 + i, 60), "en", "s") for i in range(900)]
    folder = save(tmp_path / "e", rows, [(r[0], int(not 5000 <= r[0] < 20_000), 0) for r in rows])
    out = {r.doc_id: r.kept for r in op(7)(spark, folder).collect()}
    assert not any(out[5000 + i] for i in range(300)) and all(out[i] for i in out if not 5000 <= i < 20_000)


def test_repositories_count_too(spark, tmp_path):
    token, few = "Zx81Qw72Er63Ty54Ui45", "Qm19Wn28Eb37Rv46Tc55"
    rows = [(i, f"see {token} number {i}", "en", f"s{i % 2}") for i in range(secret_scan.COPIED_REPOS)] + [(900 + i, f"see {few} {i}", "en", "s0") for i in range(10)]
    out = {r.doc_id: r for r in op(1)(spark, save(tmp_path / "d", rows)).collect()}
    assert (out[1].spans, out[1].n_copied, out[1].most_repos, out[1].most_owners) == ("", 1, secret_scan.COPIED_REPOS, 2)
    assert (out[901].spans, out[901].n_live, out[901].most_repos, out[901].most_owners) == ("owned:4:24", 1, 10, 1)


@pytest.mark.parametrize("many", [40, 2500])
def test_verdicts_of_rare_and_heavy_values(spark, tmp_path, many):
    """Counts by plain Python; with many values most are below the share that makes a key heavy."""
    rng, rows = random.Random(many), []
    tokens = [f"{i:04}" + "".join(rng.choice("abcdefghijkLMNOPQRST0123456789") for _ in range(20)) for i in range(many)]
    for i in range(2 * many):
        own = {tokens[i % many], tokens[min(many - 1, int(rng.expovariate(0.2)))]}
        rows.append((i, " ".join(sorted(own)), "en", f"s{rng.randrange(5)}"))
    held = {}
    for i, text, _, source in rows:
        for t in text.split():
            held.setdefault(t, []).append((source, i))
    out = {r.doc_id: r for r in op(1)(spark, save(tmp_path / "d", rows)).collect()}
    for i, text, *_ in rows:
        own = text.split()
        copied = [len({s for s, _ in held[t]}) >= secret_scan.COPIED_OWNERS or len({d for _, d in held[t]}) >= secret_scan.COPIED_REPOS for t in own]
        assert out[i].n_copied == sum(copied)
        assert out[i].most_repos == max(len({d for _, d in held[t]}) for t in own)
        assert out[i].n_live == sum(not c and secret_scan.random_looking(t) for t, c in zip(own, copied))


def test_skew_join_equals_a_join(spark):
    left = written(spark.createDataFrame([(i % 5 if i % 3 else i, i) for i in range(9000)] + [(None, -1)], "k long, v long"), "t")
    right = spark.range(0, 9000, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w"))
    for how in ("inner", "left"):
        want = Counter(map(tuple, left.join(right, "k", how).select("k", "v", "w").collect()))
        assert Counter(map(tuple, skew_join(left, right, "k", how, bounded=False).select("k", "v", "w").collect())) == want


def test_clashing_names_survive(spark, tmp_path):
    rows = [(i, f"password = hunter2hunter{i}x " + prose(i, 60), "en", f"s{i % 3}") for i in range(30)]
    docs = read(spark, save(tmp_path / "d", rows, extra=False))
    names = ["key", "text_key", "marks", "to_source", "copies", "copy", "last0", "last1", "taken", "shuffle", "__key", "__copies", "size", "target", "Copies_"]
    for name in names:
        docs = docs.withColumn(name, F.concat(F.lit(name), F.col("doc_id").cast("string")))
    mixed, clean = mixing.mixture(docs), secret_scan.redacted(docs)
    for out in (mixed, clean):
        assert out.columns == docs.columns
        got = out.collect()
        assert got and all(r[n] == f"{n}{r.doc_id}" for r in got for n in names)
    assert all("hunter" not in r.text for r in clean.collect())


def test_shards_are_cut_where_plain_sums_say(spark):
    rng = random.Random(2)
    rows = [(i, f"{rng.randrange(400):03}", rng.randrange(16, 300)) for i in range(700)]
    frame = written(spark.createDataFrame(rows, "doc_id long, digest string, size long"), "t")
    got = {r.doc_id: (r.shard, r.slot) for r in sharding.shard(frame, 9).collect()}
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    total, before, spans = sum(r[2] for r in rows), [], {}
    at = 0
    for _, digest, size in order:
        before.append(at)
        at += size
        spans[digest] = (spans.get(digest, (at - size, 0))[0], at)
    cuts = []
    for j in range(1, 9):
        aim = total * j / 9
        i = max(k for k in range(len(order)) if before[k] < aim)
        end = min(spans[order[i][1]], key=lambda x: (abs(x - aim), x))
        if abs(end - aim) > sharding.SLACK * total / 9:
            end = min((before[i], before[i] + order[i][2]), key=lambda x: (abs(x - aim), x))
        cuts.append(end)
    slots = Counter()
    for (doc_id, _, _), b in zip(order, before):
        shard = sum(b >= c for c in cuts)
        assert got[doc_id] == (shard, slots[shard])
        slots[shard] += 1


def test_chain_adds_to_its_word_list():
    """The transitions and neighbours matter: a doubtful word beside a marker is likelier toxic than alone."""
    rng, rows = random.Random(6), []
    for i in range(240):
        words = prose(i, 40).split()
        for _ in range(3):
            at = rng.randrange(38)
            words[at : at + 2] = ["vilest", "brute"] if i % 2 else ["calmer", "brute"]
        rows.append((i, " ".join(words), i % 2))
    table = pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows], "y": pa.array([r[2] for r in rows], pa.int32())})
    model = toxicity.fit(table)
    from cartolith.llm import kernel as K

    t = K.texts(pa.array(["quiet vilest brute quiet", "quiet calmer brute quiet"]))
    _, _, p, counts = model.spans(t)
    beside, apart = p[2], p[int(counts[0]) + 2]
    assert p[1] > 0.5 and beside > 3 * apart
    assert quality_classifier.EACH == toxicity.EACH == 1500
