"""Audit of how the sources of a language differ (operator 13).

CountVectorizer, with minDF and the largest vocabSize, finds the vocabulary, from each document's different terms. Terms carry
their language (``lang`` NUL ``term``), so that one vectorizer holds a vocabulary for each language, minDF being counted
inside it. A vectorizer keeps its vocabulary on the driver; terms are therefore split by hash into slices of about SLICE kept
terms, counted beforehand on one term in SAMPLED, and each slice gets a vectorizer: its size is bounded however large the
corpus, and no term is lost. Once a task has met a term in minDF documents, the term is in the vocabulary whatever follows, so
its later documents there need not show it to the vectorizer (which took two fifths of the time of the whole).

A document's exact sparse vector is its terms' places in the vocabulary and their counts. Only their sums by group are needed,
so each task adds up every occurrence by group and 64-bit hash of the term in the pass that finds the terms (as Summarizer
does, but sparsely: a group's dense vector could be of any length); once the vocabulary is known, hashes become places.

Pairs are evaluated sparsely. With p0 the value of a term that a group lacks, the sum over all terms of f(p, q) is that of
f(p, q0) over the terms of one, of f(p0, q) over those of the other, f(p0, q0) for the rest, and a correction over the
terms that both have. The first two depend on counts only, so they come from histograms of counts. The corrections are
worked out in blocks of terms and tiles of sources, so that a task holds BLOCK * TILE * 2 entries at most and no row is made
for a pair and a term. All numbers are integers.

Defined results: null text, lang and source are empty texts; texts without terms still make their group; a language without
kept terms has values 0 and no terms; repeated rows are documents of their own; ties go by UTF-8; an empty table gives no
rows; only text, lang and source are read, so other columns may have any name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import IllegalArgumentException
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartolith.llm import kernel as K
from cartolith.llm.shared import documents, mapped, settled, small, written

LEAST_DOCS = 10
TOP = 10
UNIT = 1_000_000_000
#: Kept terms of a slice of the vocabulary, about; one term in SAMPLED is counted to tell how many slices that takes.
SLICE, SAMPLED = 500_000, 64
#: Slots for terms that a task has met; sums of groups that a task holds: new ones before they are added up, all before they are passed on.
SLOTS, PENDING, SUMS = 1 << 20, 1 << 19, 1 << 20
#: Terms of a group's row.
PIECE = 2048
WORDED = ["lang", "source", "terms", "sampled", "hashes", "counts"]
#: Terms of a block and sources of a tile.
BLOCK, TILE = 2048, 64


#: Whatever isn't part of a term.
BETWEEN = np.zeros(256, bool)
BETWEEN[[*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True

#: Keeps equal hashes of different documents or groups apart, as a factor of their numbers.
APART = K.U(0xD6E8FEB86659FD93)


def term_hashes(t: K.Texts, starts: np.ndarray, ends: np.ndarray, salts: np.ndarray) -> np.ndarray:
    """64-bit hashes of lower-cased terms, each salted with its language."""
    return K.mix(t.hashes(starts, ends, lower=True) + salts * K.U(0x9E3779B97F4A7C15))


#: Tagged terms that are hashed at a time.
TERMS = 1 << 15


def salt(lang: bytes) -> int:
    return zlib.crc32(lang)


def tagged_hashes(tagged: pa.StringArray, tags: np.ndarray, salts: np.ndarray) -> np.ndarray:
    """The hashes of terms that follow a language and NUL, ``tags`` bytes together. salts: of each term's language."""
    out = [np.zeros(0, K.U)]
    for at in range(0, len(tagged), TERMS):
        t = K.texts(tagged.slice(at, TERMS))
        out.append(term_hashes(t, t.offsets[:-1] + tags[at : at + TERMS], t.offsets[1:], salts[at : at + TERMS]))
    return np.concatenate(out)


def salted(langs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of each language's tag, and its salt."""
    return np.fromiter((len(x) + 1 for x in langs), np.int64, len(langs)), np.fromiter(map(salt, langs), np.int64, len(langs)).astype(K.U)


def bags(t: K.Texts, langs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each document's different terms, by document: the document, start and end of one occurrence, occurrences, hash."""
    starts, ends, counts = t.runs(BETWEEN)
    doc = t.doc_of(counts)
    hashes = term_hashes(t, starts, ends, salted(langs)[1][doc])
    # a document's number in the key keeps documents apart; the hash itself is kept beside it
    key = K.mix(hashes) + doc.astype(K.U) * APART
    order = np.argsort(key)
    new = np.ones(len(key), bool)
    new[1:] = np.diff(key[order]) != 0
    at = np.flatnonzero(new)
    times = np.zeros(len(key), np.int64)
    times[order[at]] = np.diff(np.append(at, len(key)))
    first = np.flatnonzero(times)
    many = times[first]
    return doc[first], starts[first], ends[first], many, hashes[first]


def tagged(t: K.Texts, langs: list[bytes], doc: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.StringArray:
    """The lower-cased terms at these places, in order, each after its document's language and NUL."""
    lengths = ends - starts
    offsets = np.concatenate([[0], np.cumsum(salted(langs)[0][doc] + lengths)])
    out, free = np.zeros(offsets[-1], np.uint8), np.ones(offsets[-1], bool)
    tags = [x + b"\x00" for x in langs]
    for tag in set(tags):
        at = offsets[:-1][np.fromiter((x == tag for x in tags), bool, len(tags))[doc]]
        for i, byte in enumerate(tag):
            out[at + i], free[at + i] = byte, False
    turns = np.zeros(len(t.data) + 1, np.int8)
    turns[starts] += 1
    turns[ends] -= 1
    out[free] = K.LOWER[t.data[np.cumsum(turns[:-1], dtype=np.int8).view(bool)]]
    return pa.Array.from_buffers(pa.string(), len(doc), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out)])


def bounds(doc: np.ndarray, docs: int) -> pa.Array:
    """Offsets of the documents' lists."""
    return pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=docs))]), pa.int32())


class Met:
    """In how many of a task's documents each term was met, while it is open. A slot belongs to the first term that takes it; others have none."""

    def __init__(self, slots: int):
        self.owner, self.docs = np.zeros(slots, K.U), np.zeros(slots, np.int32)

    def open(self, hashes: np.ndarray, least_docs: int) -> np.ndarray:
        """Which terms earlier calls met in fewer than least_docs documents, or have no slot. hashes: documents' different terms."""
        slot = (hashes % K.U(len(self.owner))).astype(np.int64)
        free = self.owner[slot] == 0
        self.owner[slot[free]] = hashes[free]
        own = (self.owner[slot] == hashes) & (hashes != 0)
        out = ~own | (self.docs[slot] < least_docs)
        np.add.at(self.docs, slot[own & out], 1)
        return out


def summed(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """group, hash and sum of the counts for each different group and hash of the parts."""
    group, hashes, count = (np.concatenate(x) for x in zip(*parts))
    key = hashes + group.astype(K.U) * APART
    order = np.argsort(key)
    key = key[order]
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else order
    first = order[new]
    return group[first], hashes[first], np.add.reduceat(count[order], new) if len(key) else count


def pieces(groups: list[tuple[str, str]], most: int, group: np.ndarray, hashes: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
    """Rows of ``worded`` for the sums of groups, ``most`` terms each at most."""
    order = np.argsort(group, kind="stable")
    group = group[order]
    edges = np.flatnonzero(np.diff(group, prepend=-1, append=-1)) if len(group) else np.zeros(1, np.int64)
    begin = np.concatenate([np.zeros(0, np.int64), *(np.arange(a, b, most) for a, b in zip(edges[:-1], edges[1:]))])
    where = pa.array(np.append(begin, len(group)), pa.int32())
    names = [groups[i] for i in group[begin]]
    lists = [pa.ListArray.from_arrays(where, pa.array(x[order].view(np.int64))) for x in (hashes, count)]
    lang, source = (pa.array([x[i] for x in names], pa.string()) for i in (0, 1))
    none = [pa.nulls(len(begin), pa.list_(x)) for x in (pa.string(), pa.int64())]
    return pa.RecordBatch.from_arrays([lang, source, *none, *lists], WORDED)


def worded(docs: DataFrame, least_docs: int) -> DataFrame:
    """Rows of documents and of groups, from one pass over the texts.

    A document's row has its terms (lang NUL term) that are open, and sampled, some of their hashes; a group's row has lang,
    source, and hashes and counts of terms in some of its documents. A term is open until it was met in least_docs documents
    of its task: either all of a task's documents with the term have it in their rows, or least_docs of them or more do. So
    over all rows it reaches least_docs exactly if it does over all documents. The groups' rows have every occurrence.
    """
    one_in, slots, most_pending, most_sums, piece, names = SAMPLED, SLOTS, PENDING, SUMS, PIECE, WORDED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met, number, sums, pending = Met(slots), {}, [], 0
        for batch in batches:
            for part, t in K.blocks(batch):
                langs = part.column(0).to_pylist()
                keys = list(zip(langs, part.column(1).to_pylist()))
                of_doc = np.fromiter((number.setdefault(x, len(number)) for x in keys), np.int32, len(keys))
                langs = [x.encode() for x in langs]
                doc, starts, ends, many, hashes = bags(t, langs)
                opened = met.open(hashes, least_docs)
                sampled = opened & (hashes % K.U(one_in) == 0)
                terms = pa.ListArray.from_arrays(bounds(doc[opened], t.n), tagged(t, langs, doc[opened], starts[opened], ends[opened]))
                some = pa.ListArray.from_arrays(bounds(doc[sampled], t.n), pa.array(hashes[sampled].view(np.int64)))
                none = [pa.nulls(t.n, x) for x in (pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*none[:2], terms, some, *none[2:]], names)
                sums.append((of_doc[doc], hashes, many))
                pending += len(doc)
                if pending > most_pending:
                    sums, pending = [summed(sums)], 0
                    if len(sums[0][0]) > most_sums:
                        yield pieces(list(number), piece, *sums[0])
                        sums, number = [], {}
        if sums:
            yield pieces(list(number), piece, *summed(sums))

    held = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), "text")
    kinds = ("string", "string", "array<string>", "array<bigint>", "array<bigint>", "array<bigint>")
    return mapped(held, run, ", ".join(f"{name} {kind}" for name, kind in zip(WORDED, kinds)))


def slices_for(words: DataFrame, least_docs: int, slice_terms: int) -> int:
    """How many slices hold some slice_terms kept terms each."""
    kept = words.select(F.explode("sampled").alias("term")).groupBy("term").count().filter(F.col("count") >= least_docs).count()
    return max(1, -(-kept * SAMPLED // slice_terms))


def added(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys and the sums of their values."""
    if not len(key):
        return key, value
    order = np.argsort(key)
    key = key[order]
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[new], np.add.reduceat(value[order], new)


def group_sums(sums: DataFrame, vocabulary: list[str]) -> DataFrame:
    """group, index, count: the sums of the groups' document vectors over a vocabulary.

    sums: group, hashes, counts. A term's index is its place in the vocabulary.
    """
    hashes = tagged_hashes(pa.array(vocabulary, pa.string()), *salted([x.rpartition("\x00")[0].encode() for x in vocabulary]))
    order = np.argsort(hashes)
    table = hashes[order]
    if (table[1:] == table[:-1]).any():
        raise ValueError("two terms of the vocabulary have one hash")
    held = sums.sparkSession.sparkContext.broadcast((table, order))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, order = held.value
        for batch in batches:
            groups, number = np.unique(batch.column(0).to_numpy(), return_inverse=True)
            found = batch.column(1).flatten().to_numpy().view(K.U)
            place = np.minimum(np.searchsorted(table, found), len(table) - 1)
            kept = table[place] == found
            key = np.repeat(number * len(table), pc.list_value_length(batch.column(1)).to_numpy())[kept] + order[place[kept]]
            key, total = added(key, batch.column(2).flatten().to_numpy()[kept])
            columns = [pa.array(groups[key // len(table)]), pa.array((key % len(table)).astype(np.int32)), pa.array(total)]
            yield pa.RecordBatch.from_arrays(columns, ["group", "index", "count"])

    found = mapped(sums.select("group", "hashes", "counts"), run, "group bigint, index int, count bigint")
    return found.groupBy("group", "index").agg(F.sum("count").alias("count"))


def fitted(words: DataFrame, least_docs: int) -> CountVectorizerModel | None:
    """A vectorizer of the terms in least_docs documents or more; none if there is no such term."""
    try:
        return CountVectorizer(inputCol="terms", outputCol="vector", minDF=least_docs, vocabSize=2**31 - 1).fit(words)
    except IllegalArgumentException as e:
        if "vocabulary size" in str(e):
            return None
        raise


def group_counts(docs: DataFrame, least_docs: int = LEAST_DOCS, slice_terms: int = SLICE) -> tuple[DataFrame, DataFrame]:
    """Occurrences of each kept term in each group that has it (lang, source, term_id, count), and the terms (term_id, term)."""
    spark, words = docs.sparkSession, written(worded(docs, least_docs), "divergence-terms")
    own_sums, words = words.filter("hashes IS NOT NULL"), words.filter("terms IS NOT NULL")
    # groups by number: entries then have keys of a fixed width
    groups = own_sums.select("lang", "source").distinct()
    groups = written(groups.withColumn("group", F.monotonically_increasing_id()), "divergence-group-numbers")
    n, counts, terms = slices_for(words, least_docs, slice_terms), [], []
    own_sums = own_sums.join(small(groups), ["lang", "source"]).select("group", "hashes", "counts")
    for i in range(n):
        own = F.col("terms") if n == 1 else F.filter("terms", lambda t: F.pmod(F.xxhash64(t), F.lit(n)) == i)
        model = fitted(words.select(own.alias("terms")), least_docs)
        if model is None:
            continue
        vocabulary = model.vocabulary
        numbers = pa.array(np.arange(len(vocabulary)) + i * 2**31)
        named = spark.createDataFrame(pa.table({"term_id": numbers, "term": pa.array([x.rpartition("\x00")[2] for x in vocabulary], pa.string())}))
        sums = group_sums(own_sums, vocabulary).join(small(groups), "group")
        sums = sums.select("lang", "source", (F.lit(i).cast("long") * F.lit(2**31) + F.col("index")).alias("term_id"), "count")
        counts.append(written(sums, "divergence-counts"))
        terms.append(written(named, "divergence-vocabulary"))
    if not counts:
        none = lambda c: spark.createDataFrame([], c)
        return none("lang string, source string, term_id bigint, count bigint"), none("term_id bigint, term string")
    return reduce(DataFrame.union, counts), reduce(DataFrame.union, terms)


def div(a: Column, b: Column) -> Column:
    """The exact integer quotient."""
    return F.call_function("div", a, b)


def smoothed(count: Column, total: Column, terms: Column) -> Column:
    """p = 1 + floor(UNIT * (count + 2) / (total + 2 * terms)); in decimals where a long can't hold the product."""
    below = F.greatest(total + 2 * terms, F.lit(1))
    exact = div((count + 2).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)"), below.cast("decimal(20,0)"))
    return F.lit(1) + F.when(count < 9_000_000_000, div((F.least(count, F.lit(9_000_000_000)) + 2) * UNIT, below)).otherwise(exact)


def apart(p: Column, q: Column) -> Column:
    """f = floor((p - q)^2 / (p + q)); p and q are UNIT + 1 at most, so a long holds the square."""
    return div((p - q) * (p - q), p + q)


def corrections(tiled: DataFrame) -> DataFrame:
    """lang, a, b (a < b: numbers of sources), value: what the terms that both have add to the sum over the terms of either.

    tiled: lang, block, tile_a, tile_b, term_id, source_no, p, p0; the entries of both tiles for the terms of a block.
    """
    names = ["lang", "a", "b", "value"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64()]

    def f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (p - q) ** 2 // (p + q)

    def run(rows: pa.Table) -> pa.Table:
        lang, tile_a, tile_b = (rows.column(c)[0].as_py() for c in ("lang", "tile_a", "tile_b"))
        term, source, p, p0 = (rows.column(c).to_numpy() for c in ("term_id", "source_no", "p", "p0"))
        _, term = np.unique(term, return_inverse=True)
        sources, at = np.unique(source, return_inverse=True)
        grid = np.zeros((len(sources), term.max() + 1), np.int64)
        grid[at, term] = p
        base = np.zeros(len(sources), np.int64)
        base[at] = p0
        found = []
        for i in np.flatnonzero(sources // TILE == tile_a):
            has = grid[i] > 0
            later = np.flatnonzero((sources // TILE == tile_b) & (sources > sources[i]))
            other, mine, low = grid[np.ix_(later, has)], grid[i, has], base[later][:, None]
            both = other > 0
            other = np.maximum(other, 1)
            gain = f(mine, other) - f(mine, low) - f(base[i], other) + f(base[i], low)
            sums = np.where(both, gain, 0).sum(1)
            found += zip([lang] * len(later), [int(sources[i])] * len(later), sources[later].tolist(), sums.tolist())
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*found) if found else [()] * 4, types)], names)

    groups = tiled.groupBy("lang", "block", "tile_a", "tile_b")
    return groups.applyInArrow(run, "lang string, a bigint, b bigint, value bigint").groupBy("lang", "a", "b").agg(F.sum("value").alias("joint"))


def pairs(groups: DataFrame, entries: DataFrame) -> DataFrame:
    """lang, source, item, value of each ordered pair of sources of a language.

    groups: lang, source, source_no, sources, total, terms, kept (the language's), p0; entries: lang, source_no, term_id, count, p.
    """
    blocks, tiles = F.ceil(F.col("kept") / BLOCK), F.ceil(F.col("sources") / TILE)
    sides = groups.select("lang", "source_no", "p0", blocks.alias("blocks"), tiles.alias("tiles"))
    placed = entries.join(small(sides), ["lang", "source_no"])
    own = F.floor(F.col("source_no") / TILE)
    met = F.transform(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1), lambda t: F.struct(F.least(own, t).alias("tile_a"), F.greatest(own, t).alias("tile_b")))
    tiled = placed.select("lang", F.pmod(F.xxhash64("term_id"), F.col("blocks")).alias("block"), "term_id", "source_no", "p", "p0", F.explode(met).alias("t"))
    joint = corrections(tiled.select("lang", "block", "t.tile_a", "t.tile_b", "term_id", "source_no", "p", "p0"))
    side = lambda x: groups.select("lang", *(F.col(c).alias(f"{c}_{x}") for c in ("source", "source_no", "terms", "p0")))
    counts = entries.groupBy("lang", "source_no", "p").agg(F.count(F.lit(1)).alias("n"))
    alone = counts.join(side("o"), "lang").filter("source_no != source_no_o")
    alone = alone.groupBy("lang", "source_no", "source_no_o").agg(F.sum(F.col("n") * apart(F.col("p"), F.col("p0_o"))).alias("alone"))
    both = side("g").join(groups.select("lang", "kept"), "lang").distinct().join(side("o"), "lang").filter("source_no_g != source_no_o")
    low, high = F.least("source_no_g", "source_no_o"), F.greatest("source_no_g", "source_no_o")
    both = both.withColumn("a", low).withColumn("b", high).join(joint, ["lang", "a", "b"], "left")
    one = alone.select("lang", F.col("source_no").alias("source_no_g"), "source_no_o", F.col("alone").alias("mine"))
    two = alone.select("lang", F.col("source_no").alias("source_no_o"), F.col("source_no_o").alias("source_no_g"), F.col("alone").alias("theirs"))
    both = both.join(one, ["lang", "source_no_g", "source_no_o"], "left").join(two, ["lang", "source_no_g", "source_no_o"], "left")
    held = lambda c: F.coalesce(F.col(c), F.lit(0))
    rest = (F.col("kept") - F.col("terms_g") - F.col("terms_o")) * apart(F.col("p0_g"), F.col("p0_o"))
    value = F.when(F.col("kept") > 0, held("mine") + held("theirs") + rest + held("joint")).otherwise(0)
    return both.select("lang", F.col("source_g").alias("source"), F.col("source_o").alias("item"), value.cast("long").alias("value"))


@settled
def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, slice_terms: int = SLICE) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank. docs: text, lang, source."""
    counts, vocabulary = group_counts(docs, least_docs, slice_terms)
    by_term = written(counts.groupBy("lang", "term_id").agg(F.sum("count").alias("in_lang")), "divergence-by-term")
    langs = written(by_term.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("in_lang").alias("lang_total")), "divergence-langs")
    found = counts.groupBy("lang", "source").agg(F.sum("count").alias("total"), F.count(F.lit(1)).alias("terms"))
    groups = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    groups = groups.join(found, ["lang", "source"], "left").join(small(langs), "lang", "left").fillna(0)
    mine = Window.partitionBy("lang")
    groups = groups.withColumn("source_no", (F.row_number().over(mine.orderBy("source")) - 1).cast("long")).withColumn("sources", F.count(F.lit(1)).over(mine))
    groups = written(groups.withColumn("p0", smoothed(F.lit(0), F.col("total"), F.col("kept"))), "divergence-groups")
    sides = groups.select("lang", "source", "source_no", "total", "kept")
    p = smoothed(F.col("count"), F.col("total"), F.col("kept"))
    entries = counts.join(small(sides), ["lang", "source"]).select("lang", "source", "source_no", "term_id", "count", p.alias("p"))
    entries = written(entries, "divergence-entries")
    q = by_term.join(small(langs), "lang").select("lang", "term_id", smoothed(F.col("in_lang"), F.col("lang_total"), F.col("kept")).alias("q"))
    over = entries.join(q, ["lang", "term_id"]).filter("p > q").select("lang", "source", "term_id", apart(F.col("p"), F.col("q")).alias("value"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    # by value first, ties and all, so that terms are looked up for few rows
    over = over.withColumn("rank", F.rank().over(by_value)).filter(F.col("rank") <= top).drop("rank")
    over = over.join(vocabulary, "term_id").select("lang", "source", F.col("term").alias("item"), "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    terms = over.withColumn("rank", rank).filter(F.col("rank") <= top)
    ranked = pairs(groups, entries).withColumn("rank", rank)
    columns = ("lang", "source", "part", "item", "value", "rank")
    return ranked.withColumn("part", F.lit("pair")).select(*columns).unionByName(terms.withColumn("part", F.lit("term")).select(*columns))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every group of language and source against the language's others and against the language."""
    return divergence(documents(spark, sf_dir).select("text", "lang", "source"))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(body, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
v AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN v ON w.lang = v.lang AND w.term = v.term GROUP BY ALL),
k AS (SELECT lang, count(*) AS kept FROM v GROUP BY lang),
g AS (SELECT d.lang, d.source, coalesce(any_value(k.kept), 0) AS kept FROM d LEFT JOIN k ON d.lang = k.lang GROUP BY d.lang, d.source),
s AS (SELECT g.*, CAST(coalesce((SELECT sum(n) FROM c WHERE c.lang = g.lang AND c.source = g.source), 0) AS HUGEINT) AS total FROM g),
p AS (SELECT s.lang, s.source, v.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (s.total + 2 * s.kept) AS p
    FROM s JOIN v ON s.lang = v.lang LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = v.term),
m AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 2)) // (any_value(t) + 2 * any_value(kept)) AS q
    FROM (SELECT c.lang, c.term, c.n, k.kept, sum(c.n) OVER (PARTITION BY c.lang) AS t FROM c JOIN k ON c.lang = k.lang) GROUP BY lang, term),
x AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
    FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
y AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(x.value, 0) AS BIGINT) AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
z AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, CAST(((p.p - m.q) * (p.p - m.q)) // (p.p + m.q) AS BIGINT) AS value
    FROM p JOIN m ON p.lang = m.lang AND p.term = m.term WHERE p.n > 0 AND p.p > m.q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM y UNION ALL SELECT * FROM z))
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 10"""
