"""Toxic spans by a linear-chain conditional random field (operator 3).

Labels exist for documents only, so token labels are derived from the training sample: a token type is a marker if enough
sampled documents hold it and nearly all of those are toxic (both bounds are parameters); markers inside toxic documents
are labelled 1, all other tokens 0. The chain has two states; features of a token are its own types (itself and its
beginnings), its left and its right neighbour's (among the sample's most telling types), capitals, and the transition. It is fitted by gradient ascent on
the exact conditional likelihood. For every whole text, forward-backward gives each token's marginal; a document's score is
a logistic function of their sum and maximum, fitted on the same sample, and the offending spans are the tokens whose
marginal is at least 0.5.

The sums over a chain are exact for any length: 2x2 transfer products of blocks of tokens, a scan over the blocks, and the
messages inside each block; all documents of a batch at once. The sample is bounded: ``each`` documents of each label; of
those over 20 KB pieces from all over the text, chosen by hash (samples.excerpt). Scores and spans are of whole texts.

Defined results: null and empty texts have no tokens and get the score of that; without usable labels of both kinds no
type is a marker and every score is the sample's share of toxic documents (0 without any); repeated rows score alike; an
empty table gives no rows; only doc_id and text are read for scores, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolith.llm import kernel as K
from cartolith.llm.quality_rules import UPPER
from cartolith.llm.samples import distinct_stories, excerpts, labelled_sample, slices
from cartolith.llm.shared import documents, fold, mapped

EACH = 1500
TYPES = 2000
#: A marker is in at least this share and number of the toxic sample, and this share of the documents that hold it is toxic.
MARKER_SHARE, MARKER_LEAST, MARKER_PRECISION = 0.01, 5, 0.95
#: Types that become markers by accident, at most, on average over samples.
MARKER_ERROR = 1.0
BLOCK = 64
#: Lengths, in bytes, of the beginnings of a token that count as types of their own.
HEADS = (5, 7)
FOLDS, HELD = 5, 0


def tokens(t: K.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and types of each run of letters and digits; tokens of each document.

    Types, one row each: hashes of the token and of its first bytes, without regard to ASCII case.
    """
    starts, ends, counts = t.runs(K.NOT_WORD)
    whole = t.hashes(starts, ends, lower=True)
    heads = [K.mix(t.hashes(starts, np.minimum(starts + n, ends), lower=True) + K.U(n)) for n in HEADS]
    return starts, ends, np.stack([whole, *heads]), counts


class Lexicon:
    """Numbers known hashes from 1; any other is 0."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes)
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[self.hashes & K.U(0xFFFF)] = True

    def find(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(hashes.size, np.int32)
        shape, hashes = hashes.shape, hashes.ravel()
        maybe = np.flatnonzero(self.maybe[hashes & K.U(0xFFFF)])
        if len(self.hashes) and len(maybe):
            at = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), len(self.hashes) - 1)
            out[maybe] = np.where(self.hashes[at] == hashes[maybe], at + 1, 0)
        return out.reshape(shape)


class Chain:
    """A two-state chain: emission scores of state 1 against state 0, and log transition scores."""

    def __init__(self, lexicon: Lexicon):
        n = len(lexicon.hashes) + 1
        self.lexicon = lexicon
        self.own, self.left, self.right = np.zeros(n), np.zeros(n), np.zeros(n)
        self.bias, self.upper = -3.0, 0.0
        self.moves = np.zeros((2, 2))

    def emissions(self, ids: np.ndarray, counts: np.ndarray, upper: np.ndarray) -> np.ndarray:
        left, right = neighbours(ids[0], counts)
        return self.bias + self.own[ids].sum(0) + self.left[left] + self.right[right] + self.upper * upper

    def marginals(self, emissions: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """P(state 1) of each token, in the laid out blocks; and the blocks' forward and backward messages."""
        return forward_backward(np.exp(np.clip(emissions, -30, 30)), counts, np.exp(self.moves))[0]


def neighbours(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the tokens to the left and right inside a document, 0 at its ends."""
    left, right = np.zeros_like(ids), np.zeros_like(ids)
    if len(ids):
        left[1:], right[:-1] = ids[:-1], ids[1:]
        ends = np.cumsum(counts)[counts > 0]
        left[ends[:-1]] = 0
        right[ends - 1] = 0
    return left, right


def forward_backward(odds: np.ndarray, counts: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginal of state 1 for each token, and expected counts of the four moves, summed.

    odds: emission of state 1 over state 0; counts: tokens of each document; moves: 2x2 positive weights.
    """
    n = int(counts.sum())
    if not n:
        return np.zeros(0), np.zeros((2, 2))
    blocks = -(-counts // BLOCK)
    many = int(blocks.sum())
    first_block = np.cumsum(blocks) - blocks
    inside = np.arange(n) - np.repeat(np.cumsum(counts) - counts, counts)
    place = np.repeat(first_block, counts) * BLOCK + inside
    grid = np.ones(many * BLOCK)
    grid[place] = odds
    real = np.zeros(many * BLOCK, bool)
    real[place] = True
    # time runs along the first axis
    grid, real = np.ascontiguousarray(grid.reshape(many, BLOCK).T), np.ascontiguousarray(real.reshape(many, BLOCK).T)
    start = np.zeros(many, bool)
    start[first_block[blocks > 0]] = True
    (m00, m01), (m10, m11) = moves

    # product of each block's transfer matrices; a document's first token has no move into it
    p00, p01, p10, p11 = np.ones(many), np.zeros(many), np.zeros(many), np.ones(many)
    for s in range(BLOCK):
        e, r = grid[s], real[s]
        a00, a01, a10, a11 = m00, m01 * e, m10, m11 * e
        if s == 0:
            a00, a01 = np.where(start, 1.0, a00), np.where(start, 0.0, a01)
            a10, a11 = np.where(start, 0.0, a10), np.where(start, e, a11)
        q00, q01 = p00 * a00 + p01 * a10, p00 * a01 + p01 * a11
        q10, q11 = p10 * a00 + p11 * a10, p10 * a01 + p11 * a11
        scale = 1.0 / (q00 + q01 + q10 + q11)
        p00, p01 = np.where(r, q00 * scale, p00), np.where(r, q01 * scale, p01)
        p10, p11 = np.where(r, q10 * scale, p10), np.where(r, q11 * scale, p11)

    # messages at the ends of blocks: a scan over the blocks of each document, all documents at once
    before, after = np.ones((many, 2)), np.ones((many, 2))
    most = int(blocks.max())
    for k in range(1, most):
        at = first_block[blocks > k] + k
        x0, x1 = before[at - 1, 0], before[at - 1, 1]
        y0, y1 = x0 * p00[at - 1] + x1 * p10[at - 1], x0 * p01[at - 1] + x1 * p11[at - 1]
        before[at, 0], before[at, 1] = y0 / (y0 + y1), y1 / (y0 + y1)
    for k in range(most - 1, 0, -1):
        at = first_block[blocks > k] + k
        x0, x1 = after[at, 0], after[at, 1]
        y0, y1 = p00[at] * x0 + p01[at] * x1, p10[at] * x0 + p11[at] * x1
        after[at - 1, 0], after[at - 1, 1] = y0 / (y0 + y1), y1 / (y0 + y1)

    # messages inside the blocks
    back0, back1 = np.empty((BLOCK, many)), np.empty((BLOCK, many))
    x0, x1 = after[:, 0], after[:, 1]
    for s in range(BLOCK - 1, -1, -1):
        back0[s], back1[s] = x0, x1
        e, r = grid[s], real[s]
        y0, y1 = m00 * x0 + m01 * e * x1, m10 * x0 + m11 * e * x1
        scale = 1.0 / (y0 + y1)
        x0, x1 = np.where(r, y0 * scale, x0), np.where(r, y1 * scale, x1)
    marginal = np.empty((BLOCK, many))
    pairs = np.zeros((2, 2))
    x0, x1 = before[:, 0], before[:, 1]
    for s in range(BLOCK):
        e, r = grid[s], real[s]
        y0, y1 = m00 * x0 + m10 * x1, (m01 * x0 + m11 * x1) * e
        moved = r
        if s == 0:
            y0, y1 = np.where(start, 1.0, y0), np.where(start, e, y1)
            moved = r & ~start
        b0, b1 = back0[s], back1[s]
        total = y0 * b0 + y1 * b1
        marginal[s] = y1 * b1 / total
        if moved.any():
            z = np.where(moved, 1.0 / total, 0.0)
            pairs += [
                [(x0 * m00 * b0 * z).sum(), (x0 * m01 * e * b1 * z).sum()],
                [(x1 * m10 * b0 * z).sum(), (x1 * m11 * e * b1 * z).sum()],
            ]
        scale = 1.0 / (y0 + y1)
        x0, x1 = np.where(r, y0 * scale, x0), np.where(r, y1 * scale, x1)
    return marginal.T.reshape(-1)[place], pairs


def capitals(t: K.Texts, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which tokens have two or more ASCII capitals."""
    total = np.concatenate([[0], np.cumsum(UPPER[t.data])])
    return total[ends] - total[starts] >= 2


class Model:
    def __init__(self, chain: Chain, weights: np.ndarray):
        self.chain, self.weights = chain, weights

    def spans(self, t: K.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start and end byte and marginal of each token; tokens of each document."""
        starts, ends, hashes, counts = tokens(t)
        ids = self.chain.lexicon.find(hashes)
        emissions = self.chain.emissions(ids, counts, capitals(t, starts, ends))
        return starts, ends, self.chain.marginals(emissions, counts), counts

    def scores(self, t: K.Texts) -> np.ndarray:
        _, _, p, counts = self.spans(t)
        return logistic(summary(p, counts, t.n) @ self.weights)


def summary(p: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """Constant, log of the expected toxic tokens, and largest marginal of each document."""
    doc = np.repeat(np.arange(n), counts)
    most = np.zeros(n)
    np.maximum.at(most, doc, p)
    return np.stack([np.ones(n), np.log1p(np.bincount(doc, p * (p > 0.05), n)), most], 1)


def logistic(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton's method for a ridge logistic regression."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = logistic(x @ w)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (y - p) - ridge * w)
        w += np.clip(step, -5, 5)
    return w


def surprise(hits: np.ndarray, n: np.ndarray, share: float) -> np.ndarray:
    """Minus the log of a bound (Chernoff) of the chance that so many of n or more hit by chance."""
    p = np.clip(hits / np.maximum(n, 1), share, 1.0)
    rest = np.where(p < 1, (1 - p) * np.log(np.maximum(1 - p, 1e-12) / (1 - share)), 0.0)
    return n * (p * np.log(p / share) + rest)


def fit(rows: pa.Table, rounds: int = 60) -> Model:
    """Learn the chain and the document score from (text, y)."""
    y = rows.column("y").to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        share = y.mean() if len(y) else 0.0
        return Model(Chain(Lexicon(np.zeros(0, K.U))), np.array([np.log((share + 1e-6) / (1 - share + 1e-6)), 0.0, 0.0]))
    rows = distinct_stories(rows)
    y = rows.column("y").to_numpy().astype(float)
    parts, pairs_seen, at = [], [], 0
    for t in slices(rows.column("text")):
        starts, ends, found, many = tokens(t)
        parts.append((found, many, capitals(t, starts, ends)))
        doc = t.doc_of(many) + at
        pairs_seen += [K.distinct_pairs(kind, doc) for kind in found]
        at += t.n
    hashes, counts, upper = (np.concatenate([p[i] for p in parts], axis=-1) for i in range(3))
    upper, doc = upper.astype(float), np.repeat(np.arange(len(y)), counts)
    seen, holder = (np.concatenate(x) for x in zip(*pairs_seen, strict=True))
    kinds, where = np.unique(seen, return_inverse=True)
    toxic = np.bincount(where, y[holder], len(kinds))
    holds = np.bincount(where, minlength=len(kinds))
    share = y.mean()
    # weight clean documents so that both labels count alike
    precision = toxic / share / (toxic / share + (holds - toxic) / (1 - share))
    marker = (toxic >= np.maximum(MARKER_LEAST, MARKER_SHARE * y.sum())) & (precision >= MARKER_PRECISION)
    marker &= surprise(toxic, holds, share) >= np.log(np.count_nonzero(holds >= MARKER_LEAST) / MARKER_ERROR + 1)
    telling = np.abs(np.log((toxic + 0.5) / (y.sum() + 1)) - np.log((holds - toxic + 0.5) / ((1 - y).sum() + 1)))
    telling = np.where(holds >= 5, telling * np.sqrt(holds), 0) + 1e6 * marker
    lexicon = Lexicon(kinds[np.argsort(-telling, kind="stable")[:TYPES]])
    marks = np.zeros(len(lexicon.hashes) + 1, bool)
    marks[lexicon.find(kinds[marker])] = True
    marks[0] = False

    chain = Chain(lexicon)
    ids = lexicon.find(hashes)
    truth = (marks[ids].any(0) & (y[doc] == 1)).astype(float)
    left, right = neighbours(ids[0], counts)
    ends_at = np.cumsum(counts)[counts > 0]
    into = np.ones(len(truth), bool)
    into[0] = False
    into[ends_at[:-1]] = False
    was = np.concatenate([[0.0], truth[:-1]])
    observed = np.array(
        [[((1 - was) * (1 - truth) * into).sum(), ((1 - was) * truth * into).sum()], [(was * (1 - truth) * into).sum(), (was * truth * into).sum()]]
    )
    # Adam on the log-likelihood for each toxic token, with a small ridge
    size = len(chain.own)
    scale = max(1.0, truth.sum())
    theta = np.concatenate([chain.own, chain.left, chain.right, [chain.bias, 0.0], chain.moves.ravel()])
    one, two = np.zeros_like(theta), np.zeros_like(theta)
    for i in range(1, rounds + 1):
        chain.own, chain.left, chain.right = theta[:size], theta[size : 2 * size], theta[2 * size : 3 * size]
        chain.bias, chain.upper, chain.moves = theta[3 * size], theta[3 * size + 1], theta[3 * size + 2 :].reshape(2, 2)
        p, pairs = forward_backward(np.exp(np.clip(chain.emissions(ids, counts, upper), -30, 30)), counts, np.exp(chain.moves))
        off = truth - p
        parts = [sum(np.bincount(x, off, size) for x in ids), np.bincount(left, off, size), np.bincount(right, off, size)]
        slope = np.concatenate([*parts, [off.sum(), (off * upper).sum()], (observed - pairs).ravel()]) / scale - 1e-3 * theta
        one, two = 0.9 * one + 0.1 * slope, 0.99 * two + 0.01 * slope**2
        theta = theta + 0.25 * (one / (1 - 0.9**i)) / (np.sqrt(two / (1 - 0.99**i)) + 1e-8)
    p = chain.marginals(chain.emissions(ids, counts, upper), counts)
    return Model(chain, fit_logistic(summary(p, counts, len(y)), y))


def trained(docs: DataFrame, labels: DataFrame, each: int = EACH) -> Model:
    rows = labelled_sample(docs.select("doc_id", "text"), labels, "toxic", fold(F.col("doc_id"), FOLDS) != HELD, each)
    return fit(excerpts(rows))


def scored(docs: DataFrame, model: Model, with_spans: bool = False) -> DataFrame:
    """doc_id and score of each document; on request its offending spans as code point offsets."""
    names = ["doc_id", "score", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, t in K.blocks(batch):
                starts, ends, p, counts = model.spans(t)
                columns = [part.column(0), pa.array(logistic(summary(p, counts, t.n) @ model.weights))]
                if with_spans:
                    hit = p >= 0.5
                    points = np.concatenate([[0], np.cumsum((t.data & 0xC0) != 0x80)])
                    doc = t.doc_of(counts)[hit]
                    base = points[t.offsets[doc]]
                    pair = np.stack([points[starts[hit]] - base, points[ends[hit]] - base], 1)
                    cuts = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=t.n))])
                    inner = pa.ListArray.from_arrays(
                        pa.array(np.arange(len(pair) + 1) * 2, pa.int32()), pa.array(pair.reshape(-1), pa.int64())
                    )
                    columns.append(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), inner))
                yield pa.RecordBatch.from_arrays(columns, names[: len(columns)])

    schema = "doc_id long, score double" + ", spans array<array<long>>" * with_spans
    return mapped(docs.select(F.col("doc_id").cast("long"), "text"), run, schema)


def op3_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, with its offending spans."""
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    out = scored(docs, trained(docs, labels), with_spans=True)
    return out.select(
        "doc_id",
        (fold(F.col("doc_id"), FOLDS) == HELD).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "spans",
    )
