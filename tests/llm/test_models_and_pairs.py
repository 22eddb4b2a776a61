import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from cartolith.llm import fingerprints, near_dedup, secret_scan, toxicity
from cartolith.llm import kernel as K
from tests.llm.conftest import EDGE_ROWS, prose, save
from tests.llm.test_bpe_sharding_mixing_rules import WORD, folder, op  # noqa: F401

ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def base(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found)


def spell(spans):
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in spans)


def test_op1_base_spans(spark, folder, read):  # noqa: F811
    rows = op(1)(spark, folder).collect()
    want = Counter()
    for i, text, *_ in read(folder):
        spans = base(text or "")
        kinds = [k for _, k, _ in spans]
        want[(i, *(kinds.count(k) for k in range(3)), hashlib.sha256(spell(spans).encode()).hexdigest())] += 1
    assert Counter(tuple(r)[:5] for r in rows) == want
    for r in rows:
        kept = [s for s in r.spans.split(",") if s and not s.startswith("owned")]
        assert hashlib.sha256(",".join(kept).encode()).hexdigest() == r.base_sha256


def test_op1_tells_copied_examples_from_owned_ones(spark, tmp_path):
    copied, owned, assigned = "Zx81Qw72Er63Ty54Ui45", "Qm19Wn28Eb37Rv46Tc55", "hunter2Hunter2kx9w"
    rows = [(i, f"see {copied} here", "en", f"s{i % 7}") for i in range(60)]
    rows += [(100 + i, f"mine {owned} ok", "en", "solo") for i in range(5)] + [(200, f"token = {assigned}", "en", "solo")]
    rows += [(300, f"aaaaaaaaaaaaaaaaaaaaaaaaaaa1 {copied}", "en", "s1")]
    out = {r.doc_id: r for r in op(1)(spark, save(tmp_path / "d", rows)).collect()}
    assert out[3].spans == "" and out[3].n_copied == 1 and out[3].n_live == 0
    assert out[102].spans == "owned:5:25" and out[102].n_live == 1
    assert out[200].spans.startswith("assign:0:") and out[200].n_live == 1
    assert out[300].spans == ""


def test_redaction_marks_secrets_and_leaves_other_documents(spark, edge_dir):
    from cartolith.llm.shared import documents

    docs = documents(spark, edge_dir)
    before = sorted(map(tuple, docs.collect()), key=str)
    out = secret_scan.redacted(docs)
    assert out.columns == docs.columns
    after = sorted(map(tuple, out.collect()), key=str)
    changed = [r for r in after if r not in before]
    assert len(after) == len(before) and [r[0] for r in changed] == [13]
    assert changed[0][1] == 'password = "<SECRET>"\n<SECRET> <SECRET>' and changed[0][4] == len(changed[0][1])


def brute_pairs(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    return [(r, order[(i + 1) % len(order)]) for i, r in enumerate(order)]


def test_op2_edits_and_likeness(spark, folder, read):  # noqa: F811
    rows = op(2)(spark, folder).collect()
    docs = read(folder)
    assert Counter(r.doc_id for r in rows) == Counter(d[0] for d in docs)
    texts = defaultdict(list)
    for d in docs:
        texts[d[0]].append(d[1] or "")
    for r in rows:
        assert r.n_chars in {len(t) for t in texts[r.doc_id]}
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        # the likeness is a function of the two fingerprints that are returned
        own, other = (fingerprints.read_fingerprint(x) for x in (r.fingerprint, r.edited_fingerprint))
        assert (own.spelled(), r.near_edited) == (r.fingerprint, fingerprints.likeness(own, other))
    if len(docs) == len(texts):  # no ties: the pairs are fixed
        got = {r.doc_id: r for r in rows}
        prints, nexts = defaultdict(set), {}
        i_of = {d[0]: i for i, d in enumerate(docs)}
        for a, b in brute_pairs(docs):
            text, following = a[1] or "", b[1] or ""
            half = len(text) // 2
            changed = text[: len(text) - half] + following[:half]
            r = got[a[0]]
            assert r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
            assert (text != changed) or (r.fingerprint == r.edited_fingerprint and r.near_edited == 1)
            assert (text != following) or r.near_next == 1
            same = next((k for k, (x, y) in enumerate(zip(text, following)) if x != y), min(len(text), len(following)))
            assert r.prefix_next == same
            same = next((k for k, (x, y) in enumerate(zip(text[::-1], following[::-1])) if x != y), min(len(text), len(following)))
            assert r.suffix_next == same
            nexts[i_of[a[0]]] = (r.near_next, r.fingerprint, got[b[0]].fingerprint)
            prints[text].add(r.fingerprint)
            prints[changed].add(r.edited_fingerprint)
        assert all(len(x) == 1 for x in prints.values())
        assert len({next(iter(x)) for x in prints.values()}) == len(prints)
        read_ = fingerprints.read_fingerprint
        assert all(near == fingerprints.likeness(read_(x), read_(y)) for near, x, y in nexts.values())
        assert not rows or np.mean([r.near_edited for r in rows]) > np.mean([r.near_next for r in rows]) + 0.2


def test_op2_heavy_ids(spark, tmp_path):
    # a null id and one id hold a third of all rows each, and one text a third of one of these
    rows = [(i, prose(i, 8), "en", "a") for i in range(100)] + [(None, prose(500 + i, 8), "en", "a") for i in range(100)]
    rows += [(50, prose(900, 8) if i % 3 else prose(1000 + i, 8), "en", "a") for i in range(100)]
    folder_ = save(tmp_path / "d", rows)
    out = fingerprints.fingerprinted(spark.read.parquet(f"{folder_}/documents.parquet"), heavy_rows=10).collect()
    assert Counter(r.doc_id for r in out) == Counter(r[0] for r in rows)
    print_of = {t: fingerprints.Prefixes(t).fingerprint() for _, t, *_ in rows}
    assert Counter((r.doc_id, r.fingerprint) for r in out) == Counter((i, print_of[t].spelled()) for i, t, *_ in rows)
    # the next documents go round: in all, each text follows once
    halves = Counter(hashlib.sha256(fingerprints.edited(a, b).encode()).hexdigest() for a, b in brute_texts(rows))
    ordinary = {r.edited_sha256 for r in out if r.doc_id is not None and r.doc_id not in (50, 51, 0)}
    assert ordinary <= set(halves)


def brute_texts(rows):
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: -r[0])
    return [(a[1], b[1]) for a, b in zip(order, order[1:])]


def test_likeness_of_fingerprints_estimates_that_of_texts():
    text, other = prose(1, 400), prose(2, 400)
    print_ = lambda x: fingerprints.Prefixes(x).fingerprint()
    near = lambda x, y: fingerprints.likeness(print_(x), print_(y))
    assert near(text, text) == near("", "") == 1 and near(text, "") == 0
    assert near(text, other) < 0.2
    for share in (0.25, 0.5, 0.75):
        at = int(len(text) * share)
        assert near(text, text[:at] + other[: len(text) - at]) == pytest.approx(share, abs=0.17)
        assert near(text, other[: len(text) - at] + text[-at:]) == pytest.approx(share, abs=0.17)


def test_prefix_arrays_answer_spans():
    rng = random.Random(5)
    a, b = ("".join(rng.choice("aé😀 ") for _ in range(n)) for n in (300, 170))
    pa_, pb = fingerprints.Prefixes(a), fingerprints.Prefixes(b)
    for _ in range(3000):
        n = rng.randrange(4)
        i, j = rng.randrange(len(a) - n), rng.randrange(len(b) - n)
        assert (pa_.span(i, i + n) == pb.span(j, j + n)) == (a[i : i + n] == b[j : j + n])
    x, y = fingerprints.Prefixes("abcdef-middle-xyz"), fingerprints.Prefixes("abcdeX-xyz")
    assert (fingerprints.common_prefix(x, y), fingerprints.common_suffix(x, y)) == (5, 4)


@pytest.mark.parametrize(("n", "folds", "held"), [(3, 5, 0), (4, 3, 1), (6, 4, 2)])
def test_scores_and_folds(spark, folder, read, n, folds, held):  # noqa: F811
    rows = op(n)(spark, folder).collect()
    docs = read(folder)
    ids = Counter(d[0] for d in docs)
    assert Counter(r.doc_id for r in rows) == ids
    for r in rows:
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % folds == held)
        assert 0 <= r.score <= 1
        if n != 6:
            assert r.predicted == int(r.score >= 0.5)
    if n == 6:
        languages = {d[2] for d in docs if d[2]}
        bare = {d[0] for d in docs if not re.search(r"[^\W\d_]", d[1] or "")}
        assert all(r.lang_pred in languages | {"und"} for r in rows)
        assert all((r.lang_pred == "und") == (r.doc_id in bare) for r in rows)


def auc(pairs):
    good, bad = [s for y, s in pairs if y], [s for y, s in pairs if not y]
    return np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"  # the smaller ones hold out six toxic documents or fewer, two of them mislabelled
    labels = {r.doc_id: r for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    quality = [(labels[r.doc_id].quality, r.score) for r in op(4)(spark, d).collect() if r.held_out and r.doc_id in labels]
    toxic = [(labels[r.doc_id].toxic, r.score) for r in op(3)(spark, d).collect() if r.held_out and r.doc_id in labels]
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang").collect()}
    hits = [r.lang_pred == langs[r.doc_id] for r in op(6)(spark, d).collect() if r.held_out]
    assert auc(quality) > 0.99 and auc(toxic) > 0.95 and np.mean(hits) > 0.995


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(3)
    counts = np.array([1, 0, 5, 9, 2])
    odds, moves = np.exp(rng.normal(size=17)), np.exp(rng.normal(size=(2, 2)))
    got, pairs = toxicity.forward_backward(odds, counts, moves)
    at, want, want_pairs = 0, [], np.zeros((2, 2))
    for n in counts:
        own = odds[at : at + n]
        at += n
        total, one, two = 0.0, np.zeros(n), np.zeros((2, 2))
        for path in range(1 << n) if n else []:
            s = [(path >> i) & 1 for i in range(n)]
            w = np.prod([own[i] if s[i] else 1.0 for i in range(n)]) * np.prod([moves[a, b] for a, b in zip(s, s[1:])])
            total += w
            one += w * np.array(s)
            for a, b in zip(s, s[1:]):
                two[a, b] += w
        want += list(one / total) if n else []
        want_pairs += two / total if n else 0
    assert np.allclose(got, want) and np.allclose(pairs, want_pairs)
    # across blocks: a long chain equals the plain recursion
    n = 300
    odds = np.exp(rng.normal(size=n))
    f, b = np.zeros((n, 2)), np.ones((n, 2))
    f[0] = 1, odds[0]
    for i in range(1, n):
        f[i] = (f[i - 1] @ moves) * [1, odds[i]]
        f[i] /= f[i].sum()
    for i in range(n - 2, -1, -1):
        b[i] = moves @ (np.array([1, odds[i + 1]]) * b[i + 1])
        b[i] /= b[i].sum()
    p = (f * b)[:, 1] / (f * b).sum(1)
    assert np.allclose(toxicity.forward_backward(odds, np.array([n]), moves)[0], p)


def test_interactions_equal_the_pairwise_sum():
    from cartolith.llm.quality_classifier import BINS, STATISTICS, Machine

    machine = Machine(np.linspace(0, 5, (BINS - 1) * STATISTICS).reshape(BINS - 1, STATISTICS), seed=1)
    machine.w = np.random.default_rng(2).normal(size=machine.w.shape)
    t = K.texts(pa.array(["one two two three", "", None, "### !!! a | b"]))
    index, values, counts = machine.features(t)
    raw, _ = machine.raw(index, values, counts)
    at = 0
    for n, got in zip(counts, raw, strict=True):
        i, x = index[at : at + n], values[at : at + n].astype(float)
        at += n
        want = (machine.w[i] * x).sum()
        want += sum(machine.v[i[a]] @ machine.v[i[b]] * x[a] * x[b] for a in range(n) for b in range(a))
        assert got == pytest.approx(want, rel=1e-4, abs=1e-4)


@pytest.mark.parametrize("many", [2, 5, 11, 67])
def test_bloom_filters_count_and_correct(many, monkeypatch):
    from cartolith.llm.language import Filters, grams

    monkeypatch.setattr(Filters, "slots", 1 << 14)
    rng = random.Random(many)
    own = [[prose(1000 * k + i, 30) for i in range(3)] for k in range(many)]
    filters = Filters([f"l{k}" for k in range(many)])
    held = []
    for k, texts in enumerate(own):
        packed, _ = grams(K.texts(pa.array(texts)))
        held.append(set(packed.tolist()))
        filters.add(k, packed)
    filters.close()
    texts = [rng.choice(rng.choice(own)) + " " + prose(7, 20) for _ in range(12)] + ["", None, "no", "hola"]
    t = K.texts(pa.array(texts))
    packed, doc = grams(t)
    assert set(doc.tolist()) == set(range(12)) | {14, 15}
    raw, n = filters.raw_counts(t)
    corrected = filters.counts(t)
    masks = [filters.holders(packed, p) for p in range(len(filters.bits))]
    for i in range(len(texts)):
        mine = packed[doc == i].tolist()
        assert n[i] == len(mine)
        for k in range(many):
            true = sum(g in held[k] for g in mine)
            bits = sum(int(m) >> k % 64 & 1 for m in masks[k // 64][doc == i])
            assert raw[i, k] == bits >= true
            f = filters.false[k]
            assert corrected[i, k] == pytest.approx(max(0, (bits - len(mine) * f) / (1 - f)))
            # what all filters hold isn't corrected away, and false positives are, on average
            assert abs(corrected[i, k] - true) <= 6 * (len(mine) * f) ** 0.5 / (1 - f) + 3


def weighted_shingles(text):
    words = WORD.findall(text or "")
    if len(words) < 5:
        return Counter([tuple(words)] if words else [])
    return Counter(zip(*(words[i:] for i in range(5))))


def brute_classes(docs, threshold=0.8):
    texts = sorted({d[1] or "" for d in docs})
    bags = [weighted_shingles(t) for t in texts]
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    by = defaultdict(list)
    for i, bag in enumerate(bags):
        for s in bag:
            by[s].append(i)
    for i, bag in enumerate(bags):
        for j in {j for s in bag for j in by[s] if j < i}:
            common = sum((bag & bags[j]).values())
            if common >= threshold * (sum(bag.values()) + sum(bags[j].values()) - common):
                up[root(i)] = root(j)
    number = {t: root(i) for i, t in enumerate(texts)}
    least = {}
    for d in docs:
        k = number[d[1] or ""]
        if d[0] is not None:
            least[k] = min(d[0], least.get(k, d[0]))
    return Counter((d[0], least.get(number[d[1] or ""])) for d in docs)


def test_op10_equals_brute_force(spark, folder, read):  # noqa: F811
    got = Counter((r.doc_id, r.class_id) for r in op(10)(spark, folder).collect())
    assert got == brute_classes(read(folder))


def test_op10_edited_groups_and_shared_passages(spark, tmp_path):
    rng = random.Random(9)
    rows, n = [], 0
    for g in range(12):
        words = prose(100 + g, rng.choice([8, 40, 300])).split()
        for _ in range(rng.choice([2, 5, 40])):
            own = list(words)
            for _ in range(rng.randrange(1 + len(words) // 60 + (len(words) > 30))):
                own[rng.randrange(len(own))] = f"edit{n}"
            rows.append((n, " ".join(own), "en", "s"))
            n += 1
    passage = prose(77, 60)
    rows += [(1000 + i, prose(2000 + i, 60) + " " + passage, "en", "s") for i in range(60)]
    rows += [(2000, "", "en", "s"), (2001, None, "en", "s"), (2002, "x y", "en", "s"), (2003, "x y", "en", "s")]
    rng.shuffle(rows)
    got = Counter((r.doc_id, r.class_id) for r in op(10)(spark, save(tmp_path / "d", rows)).collect())
    assert got == brute_classes(rows)


def test_signatures_estimate_weighted_jaccard():
    rng = random.Random(3)
    a = [rng.randrange(60) for _ in range(400)]
    b = [x if rng.random() < 0.9 else rng.randrange(60) for x in a]
    t = K.texts(pa.array([" ".join(map(str, a)), " ".join(map(str, b))]))
    found, counts = near_dedup.elements(t, words=1)
    s = near_dedup.signatures(found, counts, 2048)
    x, y = Counter(a), Counter(b)
    want = sum((x & y).values()) / sum((x | y).values())
    assert np.mean(s[0] == s[1]) == pytest.approx(want, abs=0.04)


def test_deduplicated_keeps_one_row_of_each_class(spark, edge_dir):
    from cartolith.llm.shared import documents

    docs = documents(spark, edge_dir)
    out = near_dedup.deduplicated(docs)
    assert out.columns == docs.columns
    ids = [r.doc_id for r in out.collect()]
    # 1, 1 and 14 are equal; 2 (null) and 3 are empty; 4 is blank and a text of its own
    assert sorted(ids, key=str) == sorted([r[0] for r in EDGE_ROWS if r[0] not in (1, 14, 3)] + [1], key=str)


@pytest.mark.parametrize("name", ["sf", "edge_dir", "empty_dir"])
def test_pipeline(spark, name, request, tmp_path):
    import corpus_pipeline as C

    folder_ = request.getfixturevalue(name)
    docs = spark.read.parquet(f"{folder_}/documents.parquet")
    columns = docs.columns
    counts = [docs.count()]
    for i, (_, stage) in enumerate(C.STAGES):
        out = stage(spark, docs, folder_)
        if i < len(C.STAGES) - 1:
            assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        counts.append(docs.count())
    assert counts[1] <= counts[0] and counts[2] <= counts[1] and counts[3] == counts[2] and counts[5] == counts[4]
    if name == "sf":
        assert counts[4] > counts[3]
        first, second = (sorted(map(tuple, x.select("doc_id", "ids_sha256").collect())) for x in (docs, C.run(spark, folder_)))
        assert first == second
