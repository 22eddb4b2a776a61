"""Document fingerprints from prefix polynomial hashes (operator 2).

For each text two modular prefix arrays over its code points (modulus 2^31 - 1, two bases) give the hash of any span in
constant time: the difference of two entries, shifted by a power of the base. Two spans anywhere are equal if their hashes
are, so the longest common prefix and suffix of two texts are found by binary search.

A fingerprint is the number of code points, the hash of the whole text, samples of its prefix array and of its suffixes at
fixed lengths that grow by a quarter of an octave, and the 64 least hashes of all its spans of 16 code points, mixed to 32
bits. The likeness of two fingerprints is a function of these alone: the larger of the share of the longer text that the
longest common samples cover (binary search over the sampled lengths: a lower bound of the common prefix and suffix), and
the share of spans in common that the least hashes estimate (twice the common ones over all of both). Equal texts have
likeness 1, as have two empty ones. The exact common prefix and suffix of a text and the next one, by binary search over the
whole prefix arrays, are columns of their own.

Each document meets the next one in descending order of ids without a global window: buckets between quantiles of the ids
are dealt to tasks, a bucket gets a copy of the first document of the following bucket, and a task reads its sorted rows
once, holding two at a time. An id that holds more rows than a bucket should, null too, has buckets of its own by ranges of
its texts' hashes, and equal rows of it are dealt to several. Only keys of first documents are sent around, a row a bucket.

Defined results: null text counts as empty; rows of equal id follow each other by a hash of their text; null ids come last;
the last document's next is the first; a single document is its own next; repeated rows are documents of their own; an
empty table gives no rows; only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartolith.llm.kernel import mix
from cartolith.llm.shared import documents, mapped, written

P = (1 << 31) - 1
BASES = (1_000_000_007, 1_234_567_891)
SPAN, SKETCH = 16, 64
MOST_BUCKETS = 100_000
#: An id or text that stands for fewer rows than this is no burden to a task.
HEAVY_ROWS = 10_000
#: Lengths at which prefixes and suffixes are sampled: 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 14, 16, ...
LENGTHS = np.unique(np.floor(2.0 ** (np.arange(0, 161) / 4)).astype(np.int64))
U = np.uint64
_up = [np.ones(1, U) for _ in BASES]
_down = [np.ones(1, U) for _ in BASES]


def lowered(x: np.ndarray) -> np.ndarray:
    """x modulo 2^31 - 1 in place, for x below twice that."""
    return np.minimum(x, x - U(P), out=x)  # the difference wraps round if x is smaller


def reduced(x: np.ndarray) -> np.ndarray:
    """x modulo 2^31 - 1, for a product of two numbers below that."""
    y = x & U(P)
    y += x >> U(31)
    return lowered(y)


def modulo(x: np.ndarray) -> np.ndarray:
    """x modulo 2^31 - 1, for x below 2^62."""
    y = x & U(P)
    y += x >> U(31)
    return reduced(y)


def powers(n: int) -> None:
    """Make the tables of powers of the bases and of their inverses at least n long."""
    while len(_up[0]) < n:
        for table, bases in ((_up, BASES), (_down, [pow(b, -1, P) for b in BASES])):
            for k, b in enumerate(bases):
                factor = U(pow(b, len(table[k]), P))
                table[k] = np.concatenate([table[k], reduced(table[k] * factor)])


class Prefixes:
    """Prefix arrays of one text: hash of the first i code points, times nothing, for i = 0 .. n."""

    def __init__(self, text: str):
        self.points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.n = n = len(self.points)
        powers(n + 1)
        value = self.points.astype(U) + U(1)
        self.sums = []
        for k in range(len(BASES)):
            s = np.zeros(n + 1, U)
            np.cumsum(reduced(value * _up[k][:n]), out=s[1:])
            self.sums.append(modulo(s))

    def span(self, start: int, end: int) -> tuple[int, ...]:
        """Hash of code points start to end, whatever its place."""
        return tuple(
            (int(s[end]) - int(s[start])) * int(_down[k][start]) % P for k, s in enumerate(self.sums)
        )

    def samples(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the prefixes and of the suffixes of the sampled lengths, mixed to 32 bits."""
        at = LENGTHS[: np.searchsorted(LENGTHS, self.n, "right")]
        prefix = [s[at] for s in self.sums]
        rest = self.n - at
        suffix = [reduced(lowered(s[self.n] + U(P) - s[rest]) * _down[k][rest]) for k, s in enumerate(self.sums)]
        return tuple((mix(x[0] | x[1] << U(31)) >> U(32)).astype(np.uint32) for x in (prefix, suffix))

    def fingerprint(self) -> Fingerprint:
        whole = self.span(0, self.n)
        if not self.n:
            return Fingerprint(0, whole, *(np.zeros(0, np.uint32) for _ in range(3)))
        width = min(SPAN, self.n)
        many = self.n - width + 1
        hashes = [reduced(lowered(s[width:] + U(P) - s[:many]) * _down[k][:many]) for k, s in enumerate(self.sums)]
        mixed = mix(hashes[0] | hashes[1] << U(31)) >> U(32)
        # the least ones by a cut that leaves a few times as many, then exactly
        near = mixed[mixed < U(min(1 << 32, (4 * SKETCH << 32) // many))] if many > 8 * SKETCH else mixed
        least = np.unique(near)
        if len(least) < SKETCH and len(near) < many:
            least = np.unique(mixed)
        return Fingerprint(self.n, whole, *self.samples(), least[:SKETCH].astype(np.uint32))


class Fingerprint(NamedTuple):
    n: int
    whole: tuple[int, ...]
    prefixes: np.ndarray
    suffixes: np.ndarray
    least: np.ndarray

    def spelled(self) -> str:
        parts = (x.astype(">u4").tobytes().hex() for x in self[2:])
        return "-".join([f"{self.n:x}", "".join(f"{h:08x}" for h in self.whole), *parts])


def read_fingerprint(text: str) -> Fingerprint:
    """The inverse of ``spelled``."""
    n, whole, *parts = text.split("-")
    parts = [np.frombuffer(bytes.fromhex(x), ">u4").astype(np.uint32) for x in parts]
    return Fingerprint(int(n, 16), tuple(int(whole[i : i + 8], 16) for i in range(0, len(whole), 8)), *parts)


def common_length(a: np.ndarray, b: np.ndarray) -> int:
    """The longest sampled length at which both agree: they agree below it, so a binary search finds it."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        at = (low + high + 1) // 2
        low, high = (at, high) if a[at - 1] == b[at - 1] else (low, at - 1)
    return int(LENGTHS[low - 1]) if low else 0


def likeness(a: Fingerprint, b: Fingerprint) -> float:
    """How alike the texts of two fingerprints are, 0 to 1."""
    if a[:2] == b[:2]:
        return 1.0
    if not a.n or not b.n:
        return 0.0
    shorter, longer = sorted((a.n, b.n))
    covered = min(common_length(a.prefixes, b.prefixes) + common_length(a.suffixes, b.suffixes), shorter) / longer
    least = np.union1d(a.least, b.least)[:SKETCH]
    jaccard = len(np.intersect1d(np.intersect1d(a.least, b.least), least)) / len(least)
    return min(max(covered, 2 * jaccard / (1 + jaccard)), 1.0)


def common_prefix(a: Prefixes, b: Prefixes) -> int:
    low, high = 0, min(a.n, b.n)
    while low < high:
        at = (low + high + 1) // 2
        low, high = (at, high) if all(x[at] == y[at] for x, y in zip(a.sums, b.sums, strict=True)) else (low, at - 1)
    return low


def common_suffix(a: Prefixes, b: Prefixes) -> int:
    low, high = 0, min(a.n, b.n)
    while low < high:
        at = (low + high + 1) // 2
        low, high = (at, high) if a.span(a.n - at, a.n) == b.span(b.n - at, b.n) else (low, at - 1)
    return low


def edited(text: str, following: str) -> str:
    """The last half of a text, rounded down, replaced by as many of the first code points of the next one, or all."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def paired(docs: DataFrame, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """doc_id, text, bucket, last: sorted so that each row is followed by the next document; ``last`` rows only end a bucket."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = min(MOST_BUCKETS, 4 * parts)
    docs = bucketed(docs, buckets, heavy_rows)
    heads = docs.groupBy("bucket", "sub").agg(F.min(F.struct("back", "tie")).alias("head"))  # a row for each bucket
    heads = written(heads.select("bucket", "sub", "head.back", "head.tie"), "fingerprint-heads")
    over = Window.orderBy("bucket", "sub")
    to, first = F.lag(F.struct("bucket", "sub")).over(over), F.max(F.struct("bucket", "sub")).over(Window.partitionBy())
    heads = heads.withColumn("to", F.coalesce(to, first))
    ends = docs.join(F.broadcast(heads), ["bucket", "sub", "back", "tie"]).dropDuplicates(["bucket", "sub"])
    ends = ends.select("doc_id", "text", "to.bucket", "to.sub", "back", "tie", F.lit(True).alias("last"))
    rows = docs.select("doc_id", "text", "bucket", "sub", "back", "tie", F.lit(False).alias("last")).union(ends)
    rows = rows.repartition(parts, "bucket", "sub").sortWithinPartitions("bucket", "sub", "last", "back", "tie", "text")
    return rows.select("doc_id", "text", "bucket", "last")


def bucketed(docs: DataFrame, buckets: int, heavy_rows: int) -> DataFrame:
    """Adds bucket and sub, in descending order of doc_id with null last, and the sort keys back and tie inside them.

    Buckets lie between quantiles of the ids. An id with far more rows than a bucket should have (fewer than ``buckets``
    ids) is cut by ranges of its texts' hashes, and rows of it with the same text, if they are as many, at random: it
    doesn't matter which of them follows which.
    """
    narrow = docs.select("doc_id")
    total = narrow.count()
    cuts = narrow.approxQuantile("doc_id", [i / buckets for i in range(1, buckets)], 0.25 / buckets) if total else []
    cuts = sorted(set(cuts))
    number = F.lit(0)
    if cuts:
        splits = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="id_", outputCol="at_", handleInvalid="keep")
        docs = splits.transform(docs.withColumn("id_", F.col("doc_id").cast("double")))
        number = len(cuts) - F.col("at_")
    number = F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 1)).otherwise(number)
    docs = docs.withColumns(
        {"bucket": number.cast("int"), "back": F.coalesce(F.bitwise_not("doc_id"), F.lit(0)), "tie": F.xxhash64("text")}
    )
    most = max(total // buckets, heavy_rows)
    same = lambda table: F.col("doc_id").eqNullSafe(table["heavy"])
    pieces = lambda rows: F.broadcast(docs.sparkSession.createDataFrame(rows, "heavy long, hash long, pieces long"))
    ids = narrow.groupBy("doc_id").count().filter(F.col("count") > 2 * most).collect()
    if not ids:
        return docs.withColumn("sub", F.lit(0).cast("long"))
    few = pieces([(r["doc_id"], None, 2 * r["count"] // most) for r in ids])
    texts = docs.join(few, same(few), "left_semi").groupBy("doc_id", "tie").count().filter(F.col("count") > 2 * most).collect()
    alike = pieces([(r["doc_id"], r["tie"], 2 * r["count"] // most) for r in texts])
    docs = docs.join(few, same(few), "left").withColumn("piece", F.floor((F.col("tie") / 2.0**64 + 0.5) * F.col("pieces")))
    docs = docs.drop("heavy", "hash", "pieces").join(alike, same(alike) & (F.col("tie") == alike["hash"]), "left")
    sub = F.coalesce("piece", F.lit(0)) * MOST_BUCKETS + F.coalesce(F.floor(F.rand(7) * F.col("pieces")), F.lit(0))
    return docs.withColumn("sub", sub.cast("long"))


COLUMNS = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, "
    "near_next double, prefix_next long, suffix_next long"
)


def fingerprinted(docs: DataFrame, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """Fingerprints of each document and of its text with the second half replaced, their likeness and that to the next one.

    prefix_next and suffix_next are the longest common prefix and suffix of a text and the next one, in code points.
    """
    names = [c.split()[0] for c in COLUMNS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (doc_id, text, prefixes, fingerprint) of the row before
        for batch in batches:
            out = []
            ids, texts, _, lasts = (batch.column(i) for i in range(4))
            for i in range(batch.num_rows):
                text, last = texts[i].as_py(), lasts[i].as_py()
                own = Prefixes(text)
                print_ = own.fingerprint()
                if held:
                    doc_id, before, a, fa = held
                    changed = edited(before, text)
                    fb = Prefixes(changed).fingerprint()
                    digest = hashlib.sha256(changed.encode()).hexdigest()
                    near = likeness(fa, fb), likeness(fa, print_)
                    ends = common_prefix(a, own), common_suffix(a, own)
                    out.append((doc_id, a.n, digest, fa.spelled(), fb.spelled(), *near, *ends))
                held = None if last else (ids[i].as_py(), text, own, print_)
            if out:
                arrays = [pa.array(x) for x in zip(*out, strict=True)]
                arrays[0] = arrays[0].cast(pa.int64())
                yield pa.RecordBatch.from_arrays(arrays, names)

    return mapped(paired(docs, heavy_rows), run, COLUMNS)


def op2_prefix_hash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return fingerprinted(documents(spark, sf_dir))
