"""Quality by a factorisation machine (operator 4).

Features of a text: its hashed words (log counts, scaled to unit length), structure statistics (symbols, repeated words
and lines, capitals, list bars, line and word lengths, punctuation, variety), each as one of ten quantile bins, and the
length of the text as metadata. The machine adds a low-rank interaction to every pair of features and scores in time linear
in the features, since the sum over pairs is half of (sum of v x) squared minus the sum of (v x) squared. It is fitted by
mini-batch Adam on a bounded sample, ``each`` documents of each label. Their features are taken from the whole texts, of any
length, in the cluster; the driver gets those only.

Defined results: null and empty texts have no words and the statistics 0, and are scored from those; without labels of both
kinds the score is the sample's share of good documents (0.5 without any); repeated rows score alike; an empty table gives
no rows; only doc_id and text are read for scores, labels only where ``fit`` allows; other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolith.llm import kernel as K
from cartolith.llm.quality_rules import statistics
from cartolith.llm.samples import labelled_sample, stories
from cartolith.llm.shared import documents, fold, mapped
from cartolith.llm.toxicity import logistic

EACH = 1500
HASHED = 1 << 14
RANK = 8
BINS = 10
FOLDS, HELD = 3, 1
_FLAGS = {name: np.zeros(256, bool) for name in ("bars", "marks", "digits", "stops")}
for _name, _bytes in (("bars", b"|"), ("marks", b"!?"), ("digits", b"0123456789"), ("stops", b".,;:")):
    _FLAGS[_name][list(_bytes)] = True
STATISTICS = 15


def structure(t: K.Texts) -> np.ndarray:
    """Structure statistics and metadata, (documents, STATISTICS)."""
    s = {k: v.astype(float) for k, v in statistics(t).items()}
    starts, ends, counts = t.runs(K.SPACE)
    words, chars, lines = (np.maximum(1.0, s[k]) for k in ("n_words", "word_chars", "n_lines"))
    seen = K.mix(t.hashes(starts, ends) + t.doc_of(counts).astype(K.U) * K.U(0x9E3779B97F4A7C15))
    _, first = np.unique(seen, return_index=True)
    kinds = np.bincount(t.doc_of(counts)[first], minlength=t.n)
    columns = [
        s["n_symbols"] / chars,
        s["n_dup_lines"] / lines,
        s["n_repeat_words"] / words,
        s["n_upper"] / np.maximum(1.0, s["n_letters"]),
        s["n_letters"] / chars,
        s["word_chars"] / words,
        s["n_words"] / lines,
        kinds / np.maximum(1.0, s["n_words"]),
        *(t.count(_FLAGS[k][t.data]) / words for k in ("bars", "marks", "digits", "stops")),
        np.log1p(s["n_words"]),
        np.log1p(t.chars()),
        np.log1p(s["n_lines"]),
    ]
    return np.stack(columns, 1)


def hashed_words(t: K.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted sparse rows of a text's words: hashed numbers, log counts of unit length, numbers of each document."""
    starts, ends, counts = t.runs(K.SPACE)
    bucket = (t.hashes(starts, ends, lower=True) >> K.U(40)).astype(np.int64) & (HASHED - 1)
    key, many = np.unique(t.doc_of(counts) * HASHED + bucket, return_counts=True)
    doc, value = key // HASHED, np.log1p(many)
    norm = np.sqrt(np.bincount(doc, value**2, t.n))
    return key % HASHED, value / norm[doc], np.bincount(doc, minlength=t.n)


class Machine:
    """w0 + sum of w x + half of (sum of v x)^2 - sum of (v x)^2 over hashed words and binned statistics."""

    def __init__(self, edges: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        n = HASHED + STATISTICS * (BINS + 1)
        self.edges, self.bias = edges, 0.0
        self.w = np.zeros(n, np.float32)
        self.v = rng.normal(0, 0.05, (n, RANK)).astype(np.float32)

    def features(self, t: K.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted sparse rows: feature numbers, values, features of each document."""
        return self.joined(*hashed_words(t), structure(t))

    def joined(self, index: np.ndarray, value: np.ndarray, counts: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of hashed words and the statistics' bins."""
        n = len(counts)
        bins = np.stack([np.searchsorted(self.edges[:, j], stats[:, j], "right") for j in range(STATISTICS)], 1)
        extra = HASHED + np.arange(STATISTICS) * (BINS + 1) + bins
        at = np.concatenate([np.repeat(np.arange(n), counts), np.repeat(np.arange(n), STATISTICS)])
        order = np.argsort(at, kind="stable")
        index = np.concatenate([index, extra.reshape(-1)])[order]
        values = np.concatenate([value, np.ones(extra.size)])[order]
        return index, values.astype(np.float32), np.bincount(at, minlength=n)

    def raw(self, index: np.ndarray, values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores before the logistic function, and the sums of v x. Every document has its statistics, so no row is empty."""
        begin = np.cumsum(counts) - counts
        vx = self.v[index] * values[:, None]
        sums = np.add.reduceat(vx, begin)
        squares = np.add.reduceat((vx * vx).sum(1), begin)
        linear = np.add.reduceat(self.w[index] * values, begin)
        return self.bias + linear + 0.5 * ((sums * sums).sum(1) - squares), sums

    def scores(self, t: K.Texts) -> np.ndarray:
        if not t.n:
            return np.zeros(0)
        return logistic(self.raw(*self.features(t))[0].astype(float))


def described(rows: DataFrame) -> pa.Table:
    """y, story, stats, index and value of a sample (doc_id, text, y), on the driver, in order of ids.

    At most HASHED features a row, whatever the text's length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, t in K.blocks(batch):
                index, value, counts = hashed_words(t)
                ends = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
                stats = pa.array(structure(t).reshape(-1))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(2),
                        pa.array(stories(t).view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(np.arange(t.n + 1) * STATISTICS, pa.int32()), stats),
                        pa.ListArray.from_arrays(ends, pa.array(index.astype(np.int32))),
                        pa.ListArray.from_arrays(ends, pa.array(value)),
                    ],
                    ["doc_id", "y", "story", "stats", "index", "value"],
                )

    schema = "doc_id long, y int, story long, stats array<double>, index array<int>, value array<double>"
    rows = rows.select(F.col("doc_id").cast("long"), "text", F.col("y").cast("int"))
    return mapped(rows, run, schema).toArrow().sort_by([("doc_id", "ascending")]).combine_chunks()


def fit(rows: pa.Table, epochs: int = 12, batch: int = 64, step: float = 0.02, ridge: float = 3e-3, seed: int = 7) -> Machine:
    """Learn a machine from what ``described`` gives."""
    y = rows.column("y").to_numpy().astype(np.float32)
    if not len(y) or y.min() == y.max():
        machine = Machine(np.zeros((BINS - 1, STATISTICS)))
        machine.v[:] = 0
        share = float(y.mean()) if len(y) else 0.5
        machine.bias = float(np.log((share + 1e-6) / (1 - share + 1e-6)))
        return machine
    # one of a group of near copies
    rows = rows.take(pa.array(np.sort(np.unique(rows.column("story").to_numpy(), return_index=True)[1]), pa.int64())).combine_chunks()
    y = rows.column("y").to_numpy().astype(np.float32)
    flat = lambda c: rows.column(c).combine_chunks().flatten().to_numpy()
    stats = flat("stats").reshape(-1, STATISTICS)
    machine = Machine(np.quantile(stats, np.arange(1, BINS) / BINS, axis=0), seed)
    many = np.array([len(x) for x in rows.column("index").to_pylist()])
    index, values, counts = machine.joined(flat("index").astype(np.int64), flat("value"), many, stats)
    begin = np.concatenate([[0], np.cumsum(counts)])
    rng = np.random.default_rng(seed)
    wm, wv, vm, vv = (np.zeros_like(x) for x in (machine.w, machine.w, machine.v, machine.v))
    bm = bv = 0.0
    n = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            rows_ = order[at : at + batch]
            take = np.concatenate([np.arange(begin[r], begin[r + 1]) for r in rows_])
            i, x, c = index[take], values[take], counts[rows_]
            raw, sums = machine.raw(i, x, c)
            off = (logistic(raw) - y[rows_]).astype(np.float32) / len(rows_)
            each = np.repeat(off, c)
            used, where = np.unique(i, return_inverse=True)
            gw = np.bincount(where, each * x, len(used)).astype(np.float32) + ridge * machine.w[used]
            slope = (each * x)[:, None] * (np.repeat(sums, c, 0) - machine.v[i] * x[:, None])
            sort = np.argsort(where, kind="stable")
            edges = np.searchsorted(where[sort], np.arange(len(used)))
            gv = np.add.reduceat(slope[sort], edges) + ridge * machine.v[used]
            n += 1
            fix1, fix2 = 1 - 0.9**n, 1 - 0.99**n
            wm[used] = 0.9 * wm[used] + 0.1 * gw
            wv[used] = 0.99 * wv[used] + 0.01 * gw**2
            machine.w[used] -= step * (wm[used] / fix1) / (np.sqrt(wv[used] / fix2) + 1e-6)
            vm[used] = 0.9 * vm[used] + 0.1 * gv
            vv[used] = 0.99 * vv[used] + 0.01 * gv**2
            machine.v[used] -= step * (vm[used] / fix1) / (np.sqrt(vv[used] / fix2) + 1e-6)
            gb = float(off.sum())
            bm, bv = 0.9 * bm + 0.1 * gb, 0.99 * bv + 0.01 * gb**2
            machine.bias -= step * (bm / fix1) / (bv / fix2 + 1e-12) ** 0.5
    return machine


def trained(docs: DataFrame, labels: DataFrame, each: int = EACH) -> Machine:
    rows = labelled_sample(docs.select("doc_id", "text"), labels, "quality", fold(F.col("doc_id"), FOLDS) != HELD, each)
    return fit(described(rows))


def scored(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id and score of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, t in K.blocks(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(machine.scores(t))], ["doc_id", "score"])

    return mapped(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, score double")


def accepted(docs: DataFrame, machine: Machine, least: float = 0.5) -> DataFrame:
    """The documents whose score reaches ``least``, in one pass over them; all columns stay."""
    columns, at = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, t in K.blocks(batch, columns[at]):
                yield part.filter(pa.array(machine.scores(t) >= least))

    return mapped(docs, run, docs.schema)


def op4_factorisation_machine_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return scored(docs, trained(docs, labels)).select(
        "doc_id",
        (fold(F.col("doc_id"), FOLDS) == HELD).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
