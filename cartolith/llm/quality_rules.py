"""Quality rules with risk-controlled thresholds (operator 7).

Word and line statistics of every whole text give five rule metrics. A document is rejected if any of them reaches its
cutoff, so what is controlled is the joint rejection: in each stratum, the share of good documents (of those that pass the
base rules) that any rule rejects must not exceed ``risk``, at a joint ``confidence`` over all strata.

Labelled texts are parted by a hash of the text. One half proposes a short list of candidates for each stratum: for each
of the ``LEVELS`` the lowest cutoffs whose rules reject that share of its good texts at most and more bad texts than
``COST`` times the good ones. The other half, the holdout, tests each candidate's joint rejection by its exact
(Clopper-Pearson) upper bound; the error is split evenly over strata and candidates (Bonferroni), so all bounds hold
together. Among the candidates that pass, the one that rejects the most bad texts of the first half, less ``COST`` times
the good ones, is taken; if none passes or gains anything, no rule is on in that stratum.

Equal texts of a stratum are one trial, good if any of them is labelled good: repeated rows and copies make no bound
narrower. All labelled rows count: what reaches the driver is a histogram (stratum, rule, bin, label) and joint counts
(stratum, candidate).

Defined results: null or empty text has no words and fails the base rules; strata are the values of lang that have a
labelled row, null is one of its own, and the empty string too; in a stratum without labels no rule is on; an empty table
gives no rows; repeated rows get the same verdict; other columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolith.llm import kernel as K
from cartolith.llm.shared import documents, mapped, settled, skew_join, small, written

#: The symbols that the contract counts.
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters", "n_lines")
#: Rule metrics, each 0 to 1, a higher value being worse.
RULES = {
    "symbols": lambda c: F.try_divide(c("n_symbols"), c("word_chars")),
    "dup_lines": lambda c: F.try_divide(c("n_dup_lines"), c("n_lines")),
    "repeat_words": lambda c: F.try_divide(c("n_repeat_words"), c("n_words")),
    "upper": lambda c: F.try_divide(c("n_upper"), c("n_letters")),
    "long_words": lambda c: F.try_divide(c("word_chars"), c("n_words")) / 40.0,
}
BINS = 50
RISK, CONFIDENCE, COST = 0.02, 0.95, 2.0
#: Shares of good texts that a candidate's rules may each reject in the half that proposes it.
LEVELS = (0.0, 0.002, 0.005, 0.01)


def statistics(t: K.Texts) -> dict[str, np.ndarray]:
    """Per-document statistics of one block of texts."""
    starts, ends, counts = t.runs(K.SPACE)
    doc = t.doc_of(counts)
    words = t.hashes(starts, ends)
    code_points = np.concatenate([[0], np.cumsum((t.data & 0xC0) != 0x80)])
    chars = np.bincount(doc, code_points[ends] - code_points[starts], t.n).astype(np.int64)

    windows, at, many = K.window_hashes(words, counts, 3)
    covered = np.zeros(len(words), bool)
    twice = repeated(K.mix(windows + np.repeat(np.arange(t.n), many).astype(K.U) * K.U(0x9E3779B97F4A7C15)), first=True)
    for k in range(3):
        covered[at[twice] + k] = True

    line_starts, line_ends, line_counts = t.runs(K.NEWLINE)
    begin = np.concatenate([[0], np.cumsum(~K.SPACE[t.data])])
    real = begin[line_ends] > begin[line_starts]
    line_doc = t.doc_of(line_counts)[real]
    lines = t.hashes(line_starts[real], line_ends[real])
    again = repeated(K.mix(lines + line_doc.astype(K.U) * K.U(0x9E3779B97F4A7C15)), first=False)
    return {
        "n_words": counts,
        "word_chars": chars,
        "n_symbols": t.count(SYMBOLS[t.data]),
        "n_dup_lines": np.bincount(line_doc[again], minlength=t.n),
        "n_repeat_words": np.bincount(doc[covered], minlength=t.n),
        "n_upper": t.count(UPPER[t.data]),
        "n_letters": t.count(LETTER[t.data]),
        "n_lines": np.bincount(line_doc, minlength=t.n),
    }


def repeated(keys: np.ndarray, first: bool) -> np.ndarray:
    """Which keys occur more than once; without their first occurrence unless ``first``."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    flags = np.zeros(len(keys), bool)
    flags[order[1:][same]] = True
    if first:
        flags[order[:-1][same]] = True
    return flags


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, text_key (a hash of the text) and the statistics of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, t in K.blocks(batch):
                found = statistics(t)
                keys = t.hashes(t.offsets[:-1], t.offsets[1:]).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(keys), *(pa.array(found[k], pa.int64()) for k in STATS)],
                    ["doc_id", "lang", "text_key", *STATS],
                )

    schema = "doc_id long, lang string, text_key long, " + ", ".join(f"{k} long" for k in STATS)
    return mapped(docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), "text"), run, schema)


def upper_bound(bad: int, n: int, error: float) -> float:
    """Exact one-sided binomial bound: the largest rate under which ``bad`` or fewer of n have probability error."""
    if bad >= n:
        return 1.0
    # log of the number of ways to choose 0 .. bad of n
    i = np.arange(1, bad + 1)
    choose = np.concatenate([[0.0], np.cumsum(np.log((n - i + 1) / i))])
    k = np.arange(bad + 1)
    low, high = bad / n, 1.0
    for _ in range(60):
        p = (low + high) / 2
        if not 0 < p < 1:
            break
        below = np.exp(choose + k * math.log(p) + (n - k) * math.log1p(-p)).sum()
        low, high = (p, high) if below > error else (low, p)
    return high


def candidates(histogram: list, cost: float = COST) -> dict:
    """stratum -> list of {rule: lowest rejected bin}. histogram: rows (stratum, rule, bin, good, n) of the proposing half."""
    table: dict[tuple, np.ndarray] = {}
    for r in histogram:
        table.setdefault((r["stratum"], r["rule"]), np.zeros((BINS + 1, 2), np.int64))[r["bin"], r["good"]] += r["n"]
    out: dict = {}
    for (stratum, rule), counts in sorted(table.items()):
        rejected = counts[::-1].cumsum(0)[::-1]
        lists = out.setdefault(stratum, [{} for _ in LEVELS])
        for level, chosen in zip(LEVELS, lists, strict=True):
            fit = [b for b in range(1, BINS + 1) if rejected[b, 1] <= level * rejected[0, 1] and rejected[b, 0] > cost * rejected[b, 1]]
            if not fit:
                continue
            best = min(fit, key=lambda b: (cost * rejected[b, 1] - rejected[b, 0], b))
            # the highest cutoff that rejects the same labelled texts: leaves the gap to the texts in use
            while best < BINS and (rejected[best + 1] == rejected[best]).all():
                best += 1
            chosen[rule] = best
    return {s: [c for i, c in enumerate(lists) if c and c not in lists[:i]] for s, lists in out.items()}


def chosen_cutoffs(proposed: dict, counts: dict, risk: float = RISK, confidence: float = CONFIDENCE, cost: float = COST) -> dict:
    """stratum -> {rule: lowest rejected bin}, where a candidate passes.

    counts: (stratum, candidate) -> (rejected bad and good of the proposing half, rejected good and all good of the holdout).
    """
    tests = sum(len(x) for x in proposed.values())
    out = {}
    for stratum, lists in proposed.items():
        best = 0.0
        for i, cut in enumerate(lists):
            bad, good, hits, n = counts.get((stratum, i), (0, 0, 0, 0))
            if n and hits <= risk * n and bad - cost * good > best and upper_bound(hits, n, (1 - confidence) / tests) <= risk:
                best, out[stratum] = bad - cost * good, cut
    return out


def rejected(cuts, bins: dict) -> F.Column:
    """Whether any rule's bin reaches its cutoff. cuts: a struct of nullable cutoffs."""
    out = F.lit(False)
    for k, b in bins.items():
        out = out | F.coalesce(b >= cuts[k], F.lit(False))
    return out


@settled
def judged(docs: DataFrame, labels: DataFrame, risk: float = RISK, confidence: float = CONFIDENCE, cost: float = COST) -> DataFrame:
    """Statistics, base_failed and kept of every document. docs: doc_id, text, lang; labels: doc_id, quality."""
    spark = docs.sparkSession
    ratio = lambda c: F.coalesce(c, F.lit(0.0))
    bins = {
        name: F.least(F.lit(BINS), F.greatest(F.lit(0), F.ceil(ratio(rule(F.col)) * BINS))).cast("int")
        for name, rule in RULES.items()
    }
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    stats = written(measured(docs).withColumn("base_failed", base), "rules-stats")
    labels = labels.filter("quality is not null").groupBy("doc_id").agg((F.max("quality") > 0).cast("int").alias("good"))
    # null has a key of its own, apart from every value
    stratum = F.coalesce(F.concat(F.lit("="), "lang"), F.lit("-"))
    known = skew_join(stats.filter("not base_failed"), labels, "doc_id").groupBy(stratum.alias("stratum"), "text_key")
    known = known.agg(F.max("good").alias("good"), *(F.first(b).alias(k) for k, b in bins.items()))
    known = written(known.withColumn("holdout", F.pmod(F.xxhash64("text_key"), F.lit(2)) == 1), "rules-known")
    # strata x rules x bins x 2 rows at most, after the partial sums
    rules = F.explode(F.array(*(F.struct(F.lit(k).alias("rule"), F.col(k).alias("bin")) for k in RULES))).alias("x")
    long = known.filter("not holdout").select("stratum", "good", rules)
    proposed = candidates(long.groupBy("stratum", "x.rule", "x.bin", "good").agg(F.count(F.lit(1)).alias("n")).collect(), cost)
    cuts = "struct<" + ", ".join(f"{k}: int" for k in RULES) + ">"
    rows = [(s, i, tuple(c.get(k) for k in RULES)) for s, lists in proposed.items() for i, c in enumerate(lists)]
    tried = spark.createDataFrame(rows, f"stratum string, candidate int, cuts {cuts}")
    hit = rejected(F.col("cuts"), {k: F.col(k) for k in RULES})
    part = lambda x: F.count(F.when(x, True))
    joint = known.join(small(tried), "stratum").groupBy("stratum", "candidate").agg(
        part(hit & ~F.col("holdout") & (F.col("good") == 0)).alias("bad"),
        part(hit & ~F.col("holdout") & (F.col("good") == 1)).alias("good"),
        part(hit & F.col("holdout") & (F.col("good") == 1)).alias("hits"),
        part(F.col("holdout") & (F.col("good") == 1)).alias("n"),
    )
    counts = {(r["stratum"], r["candidate"]): (r["bad"], r["good"], r["hits"], r["n"]) for r in joint.collect()}
    chosen = chosen_cutoffs(proposed, counts, risk, confidence, cost)
    rows = [(s, tuple(c.get(k) for k in RULES)) for s, c in sorted(chosen.items())]
    table = spark.createDataFrame(rows, f"stratum string, cuts {cuts}")
    out = stats.withColumn("stratum", stratum).join(small(table), "stratum", "left")
    return out.withColumn("kept", ~F.col("base_failed") & ~rejected(F.col("cuts"), bins)).drop("stratum", "cuts", "text_key")


def op7_risk_controlled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word statistics and verdict of every document."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    out = judged(documents(spark, sf_dir).select("doc_id", "text", "lang"), labels)
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
