"""Language by bit-sliced Bloom filters of n-grams (operator 6).

A filter has as many words of up to 64 bits for each slot as its languages need, each word in a plane of its own: bit l of
plane p belongs to language 64 p + l, so one lookup, the conjunction of the slots of a few hash functions, returns all
languages that hold an n-gram. Each language's filter holds the n-grams that are frequent in its part of a bounded sample.
For a text the bits are counted by language; each count c of n n-grams is corrected to (c - n f) / (1 - f), f being the rate
of false positives that the filter's share of set bits gives. The largest corrected count decides, its share of all is the
score.

n-grams are five bytes of the UTF-8 text in lower case (ASCII), all white space being one kind, and besides each whole word
of up to six bytes between its edges; so every text with a letter has some. The sample is at most ``each`` different texts
of every language, whole ones of any length, chosen by a hash of the text. Document frequencies of n-grams and the filters'
words are counted in the cluster; the driver gets the words of the filters only (2^20 a plane at most).

Defined results: null texts and texts without a letter are `und` with score 0; texts whose n-grams no filter knows get the
most frequent language with score 0; ties go to the more frequent language; without labelled documents all are `und`;
repeated rows get the same result; an empty table gives no rows; only text is read for predictions, so other columns may
have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartolith.llm import kernel as K
from cartolith.llm.quality_rules import LETTER
from cartolith.llm.shared import documents, fold, mapped, small, written

GRAM = 5
#: Longest word, in bytes, that is an n-gram with its edges; with them it fills 64 bits.
WORD = 6
SLOTS = 1 << 20
HASHES = 2
EACH = 1200
#: Languages of a plane: bits of the widest word.
PLANE = 64
#: An n-gram belongs to a language if at least this many of its sampled documents hold it, and this share of them.
LEAST_DOCS, LEAST_SHARE = 3, 0.004
FOLDS, HELD = 4, 2
_LETTER = regex.compile(r"\p{L}").search


def grams(t: K.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams and the number of the document of each: windows of bytes, then short words with their edges."""
    low = np.where(K.SPACE[t.data], np.uint8(0x20), K.LOWER[t.data]).astype(K.U)
    many = np.maximum(t.lengths - GRAM + 1, 0)
    packed, doc = np.zeros(0, K.U), np.zeros(0, np.int64)
    if many.sum():
        packed = low[: len(low) - GRAM + 1].copy()
        for k in range(1, GRAM):
            packed |= low[k : len(low) - GRAM + 1 + k] << K.U(8 * k)
        inside = np.ones(len(packed), bool)
        for k in range(1, GRAM):  # no n-gram crosses the end of a document
            cut = t.offsets[1:-1] - k
            inside[cut[(cut >= 0) & (cut < len(packed))]] = False
        packed, doc = packed[inside], t.doc_of(many)
    starts, ends, counts = t.runs(K.SPACE)
    short = np.flatnonzero(ends - starts <= WORD)
    starts, length = starts[short], (ends - starts)[short]
    word = np.full(len(short), 0x20, K.U)
    for k in range(WORD):
        on = length > k
        word[on] |= low[starts[on] + k] << K.U(8 * (k + 1))
    word |= K.U(0x20) << (K.U(8) * (length.astype(K.U) + K.U(1)))
    return np.concatenate([packed, word]), np.concatenate([doc, t.doc_of(counts)[short]])


class Filters:
    """Bloom filters of any number of languages in planes of slots."""

    slots = SLOTS

    def __init__(self, languages: list[str]):
        self.languages = languages
        kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if min(len(languages), PLANE) <= 8 * k().itemsize)
        self.bits = np.zeros((max(1, -(-len(languages) // PLANE)), self.slots), kind)

    @classmethod
    def places(cls, packed: np.ndarray) -> Iterator[np.ndarray]:
        h = K.mix(packed)
        for i in range(HASHES):
            yield (h >> K.U(24 * i)) & K.U(cls.slots - 1)

    def add(self, language: int, packed: np.ndarray) -> None:
        plane = self.bits[language // PLANE]
        for at in self.places(packed):
            plane[at] |= self.bits.dtype.type(1 << language % PLANE)

    def close(self) -> None:
        """Fix the false positive rate of each language."""
        n = len(self.languages)
        self.false = np.array([(np.count_nonzero(self.bits[i // PLANE] & self.bits.dtype.type(1 << i % PLANE)) / self.slots) ** HASHES for i in range(n)])

    def holders(self, packed: np.ndarray, plane: int = 0) -> np.ndarray:
        """A mask of the plane's languages that hold each n-gram."""
        found = None
        for at in self.places(packed):
            found = self.bits[plane, at] if found is None else found & self.bits[plane, at]
        return found

    def raw_counts(self, t: K.Texts) -> tuple[np.ndarray, np.ndarray]:
        """N-grams that each language's filter holds, (documents, languages), and n-grams of each document."""
        packed, doc = grams(t)
        n, many = len(self.languages), np.bincount(doc, minlength=t.n)
        if not len(packed):
            return np.zeros((t.n, n)), many
        columns = []
        for p in range(len(self.bits)):
            held = self.holders(packed, p)
            own = min(PLANE, n - p * PLANE)
            if own <= 8:
                # popcounts by mask: one count for each document and mask, few as masks are
                cells = np.bincount(doc * (1 << own) + held.astype(np.int64), minlength=t.n << own).reshape(t.n, 1 << own)
                columns += [cells[:, (np.arange(1 << own) >> i) & 1 == 1].sum(1) for i in range(own)]
            else:
                columns += [np.bincount(doc[held >> self.bits.dtype.type(i) & self.bits.dtype.type(1) > 0], minlength=t.n) for i in range(own)]
        return np.stack(columns, 1), many

    def counts(self, t: K.Texts) -> np.ndarray:
        """Counts corrected for false positives, (documents, languages)."""
        found, many = self.raw_counts(t)
        full = self.false >= 1  # a filter without a free bit says nothing
        return np.where(full, 0, np.maximum(0, (found - many[:, None] * self.false) / np.where(full, 1, 1 - self.false)))

    def predict(self, t: K.Texts) -> tuple[np.ndarray, np.ndarray]:
        """Number of the language and score of each document."""
        counts = self.counts(t)
        total = counts.sum(1)
        return counts.argmax(1), counts.max(1) / np.where(total > 0, total, 1)


def fit(kinds: dict[str, np.ndarray]) -> Filters:
    """Filters from the n-grams of each language; the order of the languages decides ties."""
    filters = Filters(list(kinds))
    for i, own in enumerate(kinds.values()):
        filters.add(i, own)
    filters.close()
    return filters


def sample(docs: DataFrame, languages: DataFrame, each: int) -> DataFrame:
    """number, text: up to ``each`` different texts of each language, by a hash of the text. languages: lang, number, count."""
    own = docs.withColumn("h", F.xxhash64("text", F.lit("language"))).join(small(languages), "lang")
    # the hashes let through several times as many rows as are wanted, before any is moved; copies are one
    share = F.least(F.lit(1.0), 16.0 * each / F.col("count"))
    own = own.filter(F.pmod("h", F.lit(1 << 30)) < share * (1 << 30))
    ranked = F.row_number().over(Window.partitionBy("number").orderBy(F.pmod("h", F.lit(1 << 30)), "h"))
    chosen = own.select("number", "h").distinct().withColumn("i", ranked).filter(F.col("i") <= each).select("number", "h")
    chosen = written(chosen, "language-chosen")
    # one of the equal texts, put together where they are first
    return own.join(small(chosen), ["number", "h"]).groupBy("number", "h").agg(F.min("text").alias("text")).select("number", "text")


def trained(docs: DataFrame, each: int = EACH) -> Filters:
    """docs: doc_id, text, lang."""
    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id"), FOLDS) != HELD))
    counted = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()  # a row a language
    rows = [(r["lang"], i, r["count"]) for i, r in enumerate(counted)]
    languages = docs.sparkSession.createDataFrame(rows, "lang string, number int, count long")
    texts = written(sample(usable.select("lang", "text"), languages, each), "language-sample")

    def kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, t in K.blocks(batch):
                own, doc = K.distinct_pairs(*grams(t))
                number = part.column(0).to_numpy()[doc]
                yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(own.view(np.int64))], ["number", "gram"])

    holds = mapped(texts, kinds, "number int, gram long").groupBy("number", "gram").agg(F.count(F.lit(1)).alias("holds"))
    sizes = texts.groupBy("number").agg(F.count(F.lit(1)).alias("docs"))
    least = F.greatest(F.least(F.lit(LEAST_DOCS), "docs"), LEAST_SHARE * F.col("docs"))
    frequent = holds.join(small(sizes), "number").filter(F.col("holds") >= least).select("number", "gram")
    filters = Filters([r["lang"] for r in counted])

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = batch.column(0).to_numpy()
            bit = (np.ones(1, K.U) << (number % PLANE).astype(K.U)).view(np.int64)
            for at in Filters.places(batch.column(1).to_numpy().view(K.U)):
                arrays = [pa.array(number // PLANE), pa.array(at.astype(np.int32)), pa.array(bit)]
                yield pa.RecordBatch.from_arrays(arrays, ["plane", "slot", "bits"])

    words = mapped(frequent, slots, "plane int, slot int, bits long").groupBy("plane", "slot").agg(F.bit_or("bits").alias("bits"))
    found = words.toArrow()  # the filters: SLOTS rows a plane at most
    plane, slot, bits = (found.column(c).to_numpy() for c in ("plane", "slot", "bits"))
    filters.bits[plane, slot] = bits.view(K.U).astype(filters.bits.dtype)
    filters.close()
    return filters


def predicted(docs: DataFrame, filters: Filters) -> DataFrame:
    """doc_id, lang_pred and score of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*filters.languages, "und"], object)
        for batch in batches:
            for part, t in K.blocks(batch):
                if not filters.languages:
                    best, score = np.zeros(t.n, np.int64), np.zeros(t.n)
                else:
                    best, score = filters.predict(t)
                letters = t.count(LETTER[t.data]) > 0
                for i in np.flatnonzero(~letters & (t.lengths > 0)):
                    letters[i] = bool(_LETTER(part.column(1)[int(i)].as_py() or ""))
                best = np.where(letters, best, len(filters.languages))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(names[best], pa.string()), pa.array(np.where(letters, score, 0.0))],
                    ["doc_id", "lang_pred", "score"],
                )

    return mapped(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, lang_pred string, score double")


def op6_bloom_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = documents(spark, sf_dir)
    return predicted(docs, trained(docs.select("doc_id", "text", "lang"))).select(
        "doc_id", (fold(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), "lang_pred", "score"
    )
