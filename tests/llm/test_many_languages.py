"""More languages than one word of bits holds."""

import random

from cartolith.llm.language import op6_bloom_language
from cartolith.llm.quality_rules import op7_risk_controlled_rules
from tests.llm.conftest import save

LANGUAGES = 70


def text(language: int, rng: random.Random, n: int = 60) -> str:
    words = random.Random(language)
    own = ["".join(words.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(40)]
    return " ".join(rng.choice(own) for _ in range(n))


def test_every_language_is_learned(spark, tmp_path):
    rng, rows = random.Random(5), []
    for language in range(LANGUAGES):
        for _ in range(40 if language < 64 else 24):  # the last six are the least frequent
            rows.append((len(rows), text(language, rng), f"l{language:02}", "a"))
    out = {r.doc_id: r for r in op6_bloom_language(spark, save(tmp_path / "docs", rows)).collect()}
    assert len(out) == len(rows)
    held = [r for r in rows if out[r[0]].held_out]
    assert {r[2] for r in held} == {r[2] for r in rows}
    assert all(out[i].lang_pred == lang for i, _, lang, _ in held)


def test_every_labelled_language_has_its_own_cutoffs(spark, tmp_path):
    # shouting is bad in l64 and good in l65; each of the 64 other languages has more labels
    rng = random.Random(6)
    rows = [(i, "x", f"l{i % 64:02}", "a") for i in range(64 * 900)]
    labels = [(r[0], 1, 0) for r in rows]
    for language in (64, 65):
        for i in range(860):
            body, loud = text(language, rng), i % 4 == 0
            labels.append((len(rows), int(not loud or language == 65), 0))
            rows.append((len(rows), body.upper() if loud else body, f"l{language}", "a"))
    kept = {r.doc_id: r.kept for r in op7_risk_controlled_rules(spark, save(tmp_path / "docs", rows, labels)).collect()}
    loud = {lang: [kept[i] for i, t, own, _ in rows if own == lang and t.isupper()] for lang in ("l64", "l65")}
    assert not any(loud["l64"]) and all(loud["l65"])
    assert all(kept[i] for i, t, own, _ in rows if own == "l64" and not t.isupper())
