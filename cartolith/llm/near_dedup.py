"""Near-duplicate classes by DartMinHash and banded joining (operator 10).

A text is the weighted set of its shingles of five words, a shingle's weight being how often it occurs. Darts are hashed
into regions (shingle, unit of weight, unit of rank), about one dart a region with a hashed rank and coordinate; a text
owns the darts in the regions that its weights cover. For each of the k coordinates its earliest dart is its signature
value, so two texts agree in a coordinate with probability equal to their weighted Jaccard similarity. The work is one
step a region and one a dart: about n + k ln k, not n times k. Regions of higher rank are opened until no coordinate is
empty.

Signatures are cut into bands; texts that share a band meet in a bucket. Equal texts are one node throughout. Pairs are
verified on the exact weighted sets, and links of at least ``threshold`` are joined into components after each step:

1. every node with the least node that it meets anywhere;
2. in buckets that hold several components, every node with the bucket's least one;
3. in buckets of up to ``block`` nodes that still do, all nodes with each other, by one product of matrices a group;
4. the nodes of larger such buckets get a longer signature and bands of ``DEEP_ROWS`` coordinates, which part texts that are
   merely alike; groups of these that hold several components are compared as in step 3. A group that is still larger than
   ``block`` is cut: the nodes outside its most frequent component meet each other and all the rest, part by part.

Pairs are never rows of a table in steps 3 and 4, nothing is expanded inside a component, and groups with the same nodes
are compared once. Every pair that shares a band is verified unless it is joined already, or unless all the buckets that it
shares are larger than ``block`` and no deep band is shared. Banding (40 bands of 6) misses a pair of similarity 0.8 with
probability 5e-6, deep banding (128 of 12) with 1e-4, and both far less above.

Nothing but a bitmap of fixed size (which texts to read again for the exact check) and the fewer than 1000 heaviest keys of
a join reach the driver. Tables are written to the shared folder between the steps and removed at the end. Defined results:
null text counts as empty; texts without words are duplicates of equal texts only; texts of one to four words are one
shingle; repeated rows and equal ids fall in the same class if their texts do; class_id is the least id of the class, null
only if it has none; an empty table gives no rows; only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartolith.llm import kernel as K
from cartolith.llm.shared import documents, free_names, is_small, mapped, settled, skew_join, written

BANDS, ROWS = 40, 6
COORDINATES = BANDS * ROWS
THRESHOLD = 0.8
WORDS = 5
#: Nodes that are compared in one group.
BLOCK = 256
#: Bands and rows of the longer signatures of nodes in larger buckets.
DEEP_BANDS, DEEP_ROWS = 128, 12
#: A node that many others are compared with is copied to so many groups at least.
SALTS = 64
#: Bits of the map of texts to read again. More texts than bits only make it less selective.
MAP_BITS = 24
_A, _B, _C, _D = (K.U(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3))
#: Cumulative probabilities of 0, 1, 2, ... darts in a region of mean 1.
POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(18)])


def elements(t: K.Texts, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The unit-weight elements of each document, (shingle, number of its occurrence), sorted, and how many."""
    found, counts = K.shingles(t, words)
    doc = t.doc_of(counts)
    order = np.lexsort((found, doc))
    found = found[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (doc[1:] != doc[:-1])
    begin = np.maximum.accumulate(np.where(new, np.arange(len(found)), 0))
    return K.mix(found + (np.arange(len(found)) - begin).astype(K.U) * _A), counts


def signatures(found: np.ndarray, counts: np.ndarray, k: int = COORDINATES, reach: float = 1.0) -> np.ndarray:
    """The earliest dart of every coordinate, uint32 of shape (documents, k); zeros where there is no element."""
    n = len(counts)
    out = np.zeros((n, k), np.uint32)
    if not len(found):
        return out
    darts = (k * math.log(k) + 2 * k) * reach
    ranks = np.ceil(darts / np.maximum(counts, 1)).astype(np.int64)
    regions = np.repeat(ranks, counts)
    element = np.repeat(found, regions)
    rank = np.arange(len(element)) - np.repeat(np.cumsum(regions) - regions, regions)
    doc = np.repeat(np.arange(n), counts * ranks)
    region = K.mix(element + rank.astype(K.U) * _B)
    many = np.searchsorted(POISSON, (region >> K.U(11)) * 2.0**-53, "right")
    dart_of = np.repeat(np.arange(len(region)), many)
    number = np.arange(len(dart_of)) - np.repeat(np.cumsum(many) - many, many)
    dart = K.mix(region[dart_of] + (number.astype(K.U) + K.U(1)) * _C)
    where = doc[dart_of] * k + (((dart & K.U(0xFFFFFF)) * K.U(k)) >> K.U(24)).astype(np.int64)
    when = rank[dart_of] + (dart >> K.U(24)) * 2.0**-40
    first = np.full(n * k, np.inf)
    np.minimum.at(first, where, when)
    wins = when == first[where]
    out.reshape(-1)[where[wins]] = (K.mix(dart[wins] + _D) >> K.U(32)).astype(np.uint32)
    short = np.isinf(first).reshape(n, k).any(1) & (counts > 0)
    if short.any():
        out[short] = signatures(found[np.repeat(short, counts)], counts[short], k, reach * 2)
    return out


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A 64-bit key for each band of each signature; the number of the band is part of it."""
    n, k = signature.shape
    parts = signature.reshape(n, bands, k // bands).astype(K.U)
    key = np.broadcast_to(np.arange(bands, dtype=K.U) * _C, (n, bands)).copy()
    for i in range(k // bands):
        key = K.mix(key + parts[:, :, i] * _A + K.U(1))
    return key.view(np.int64)


def digests(t: K.Texts) -> list[bytes]:
    raw, at = t.data.tobytes(), t.offsets
    return [hashlib.md5(raw[at[i] : at[i + 1]]).digest() for i in range(t.n)]


def slot(digest: bytes, doc_id: int | None) -> int:
    """Place of a document in the bitmap."""
    return (int.from_bytes(digest[:8], "little") ^ (doc_id or 0) * 0x9E3779B97F4A7C15) >> 11 & (1 << MAP_BITS) - 1


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, node (digest of the text), slot and bands of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, t in K.blocks(batch):
                found, counts = elements(t)
                signature = signatures(found, counts)
                keys = band_keys(signature)[counts > 0]
                ends = np.concatenate([[0], np.cumsum((counts > 0) * BANDS)])
                nodes = digests(t)
                slots = [slot(d, i) for d, i in zip(nodes, part.column(0).to_pylist(), strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys.reshape(-1), pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(nodes, pa.binary()), pa.array(slots, pa.int32()), lists],
                    ["doc_id", "node", "slot", "bands"],
                )

    return mapped(docs, run, "doc_id long, node binary, slot int, bands array<long>")


def weighted_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, elements (sorted 64-bit words) of the given nodes, read from the documents whose slot is in the bitmap."""
    bits = nodes.groupBy((F.col("slot").bitwiseAND((1 << MAP_BITS) - 1) / 64).cast("int").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, slot & 63)")).alias("bits")
    )
    table = np.zeros(1 << MAP_BITS - 6, np.int64)
    for r in bits.collect():  # 2**(MAP_BITS - 6) rows at most
        table[r["word"]] = r["bits"]
    packed = table.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        has = np.frombuffer(packed, np.uint8)
        for batch in batches:
            for part, t in K.blocks(batch):
                found = digests(t)
                ids = part.column(0).to_pylist()
                slots = np.array([slot(d, i) for d, i in zip(found, ids, strict=True)])
                wanted = np.flatnonzero(has[slots >> 3] >> (slots & 7) & 1)
                if not len(wanted):
                    continue
                column = part.column(1).take(pa.array(wanted))
                sets, counts = elements(K.texts(column))
                raw = [np.sort(x).tobytes() for x in np.split(sets, np.cumsum(counts)[:-1])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([found[i] for i in wanted], pa.binary()), pa.array(raw, pa.binary())], ["node", "elements"]
                )

    sets = mapped(docs, run, "node binary, elements binary")
    # whatever shares a slot by chance goes; repeated rows are one
    return sets.join(nodes.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])


def linked(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose weighted Jaccard similarity is at least the threshold.

    The sets of the b that share an a follow that of a in a task; an a of many b is dealt over many such groups by salts,
    and no key has more rows than a group.
    """
    salts = max(SALTS, int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    side = pairs.select("a", F.pmod(F.xxhash64("b"), F.lit(salts)).alias("salt"), F.col("b").alias("node"), F.lit(1).alias("turn"))
    hubs = side.select("a", "salt", F.col("a").alias("node"), F.lit(0).alias("turn")).distinct()
    rows = side.union(hubs).join(sets, "node").select("a", "salt", "turn", "node", "elements")
    rows = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "turn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = np.zeros(0, K.U)
        for batch in batches:
            keep = []
            for i, (turn, own) in enumerate(zip(batch.column(2).to_pylist(), batch.column(4), strict=True)):
                own = np.frombuffer(own.as_buffer(), K.U)
                if not turn:
                    hub = own.copy()
                elif overlap(hub, own, threshold):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3)], ["a", "b"]).take(pa.array(keep, pa.int64()))

    return mapped(rows, run, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """node, label (least node of its component) for the nodes of the links (a, b).

    Each round hooks every node to its least neighbour, follows the hooks to their ends, and goes on with the links between
    different ends only. Nodes of many links and ends of many nodes are joined as heavy keys (shared.skew_join).
    """
    edges = written(links.select("a", "b").filter("a <> b").distinct(), "edges")
    labels = None
    while True:
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("m")).union(edges.select("b", "a"))
        hooked = both.groupBy("node").agg(F.min("m").alias("m")).select("node", F.least("node", "m").alias("label"))
        ends = followed(written(hooked, "hooked"))
        labels = ends if labels is None else relabelled(labels, ends)
        edges = between(edges, ends)
        if edges.isEmpty():
            return labels


def followed(hooks: DataFrame) -> DataFrame:
    """node, label at the end of its hooks. Every label is a node; the hooks have no cycles."""
    while True:
        up = hooks.select(F.col("node").alias("label"), F.col("label").alias("up"))
        hooks = written(skew_join(hooks, up, "label").select("node", F.col("up").alias("label"), (F.col("up") != F.col("label")).alias("moved")), "followed")
        if hooks.filter("moved").isEmpty():
            return hooks.select("node", "label")
        hooks = hooks.select("node", "label")


def relabelled(labels: DataFrame, ends: DataFrame) -> DataFrame:
    """node, label after the labels in ``ends`` (node, label) got new ones; other nodes of ``ends`` are added."""
    new = ends.select(F.col("node").alias("label"), F.col("label").alias("new"))
    moved = skew_join(labels, new, "label", "left").select("node", F.coalesce("new", "label").alias("label"))
    return written(moved.union(ends.join(labels.select("node"), "node", "left_anti").select("node", "label")), "labels")


def between(links: DataFrame, labels: DataFrame) -> DataFrame:
    """The different links (a, b) between labels that the links join; a node without a label is its own."""
    few = is_small(labels)
    for side, other in (("a", "b"), ("b", "a")):
        new = labels.select(F.col("node").alias(side), F.col("label").alias("end"))
        joined = links.join(F.broadcast(new), side, "left") if few else skew_join(links, new, side, "left", bounded=False)
        joined = joined.select(F.coalesce("end", side).alias(side), other)
        links = joined if few else written(joined, "between")
    return written(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")


def apart(members: DataFrame, labels: DataFrame) -> DataFrame:
    """band, node, label, least, least_label of the buckets that hold several components."""
    named = members.join(labels, "node", "left").select("band", "node", F.coalesce("label", "node").alias("label"))
    named = written(named, "near-named")
    head = F.min(F.struct("node", "label")).alias("head")
    mixed = named.groupBy("band").agg(head, F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi")
    mixed = mixed.select("band", F.col("head.node").alias("least"), F.col("head.label").alias("least_label"))
    return named.join(written(mixed, "near-mixed"), "band")


def several(rows: DataFrame, name: str) -> DataFrame:
    """band, node, label, n of the groups (band) that hold several components; of groups with the same nodes one is kept.

    n: nodes of the group. rows: band, node, label.
    """
    rows = written(rows, name)
    same = F.struct(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.sum(F.xxhash64("node") % (1 << 31)).alias("y"))
    groups = rows.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), same.alias("same")).filter("lo <> hi")
    groups = groups.groupBy("same").agg(F.min("band").alias("band")).select("band", "same.n")
    return rows.join(written(groups, name + "-groups"), "band")


def with_more(labels: DataFrame, found: DataFrame) -> DataFrame:
    """Labels after more links were found."""
    found = written(found, "near-links")
    if found.isEmpty():
        return labels
    edges = between(found, labels)
    return labels if edges.isEmpty() else relabelled(labels, components(edges))


def overlap(x: np.ndarray, y: np.ndarray, threshold: float) -> bool:
    """Whether the weighted Jaccard similarity of two sorted sets of unit elements is at least the threshold."""
    if min(len(x), len(y)) < threshold * max(len(x), len(y)):
        return False
    at = np.minimum(np.searchsorted(x, y), len(x) - 1)
    common = int((x[at] == y).sum())
    return common >= threshold * (len(x) + len(y) - common)


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Common elements of every two sets, exactly.

    Elements with the same holders are one column that counts as often as there are such elements; elements of one holder
    are none. Then a matrix times its transpose, some columns at a time.
    """
    n = len(sets)
    out = np.zeros((n, n))
    if not n:
        return out
    element = np.concatenate(sets)
    holder = np.repeat(np.arange(n), [len(x) for x in sets])
    order = np.argsort(element, kind="stable")
    element, holder = element[order], holder[order]
    begin = np.flatnonzero(np.concatenate([[True], element[1:] != element[:-1]])) if len(element) else np.zeros(0, np.int64)
    many = np.diff(np.concatenate([begin, [len(element)]]))
    begin, many = begin[many > 1], many[many > 1]
    if not len(begin):
        return out
    marks = K.mix(np.arange(1, n + 1, dtype=K.U) * _B)
    total = np.concatenate([np.zeros(1, K.U), np.cumsum(marks[holder])])
    _, first, weight = np.unique(total[begin + many] - total[begin], return_index=True, return_counts=True)
    begin, many = begin[first], many[first]
    width = max(1, (1 << 22) // n)
    for at in range(0, len(begin), width):
        b, m = begin[at : at + width], many[at : at + width]
        column = np.repeat(np.arange(len(b)), m)
        place = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(b, m)
        has = np.zeros((n, len(b)), np.float32)
        has[holder[place], column] = 1
        out += (has * weight[at : at + width].astype(np.float32)) @ has.T
    return out


def joins(sets: list[np.ndarray], group: np.ndarray, threshold: float) -> tuple[list[int], list[int]]:
    """Links that join all sets of different groups that are similar enough: a tree of links, not all of them."""
    size = np.array([len(x) for x in sets])
    total = size[:, None] + size[None, :]
    common = intersections(sets)
    near = (common >= threshold * (total - common)) & (group[:, None] != group[None, :])
    one, two, unseen = [], [], np.ones(len(sets), bool)
    for root in np.flatnonzero(near.any(1)):
        front = [root] if unseen[root] else []
        unseen[root] = False
        while front:
            i = front.pop()
            for j in np.flatnonzero(near[i] & unseen):
                unseen[j] = False
                one.append(i)
                two.append(j)
                front.append(j)
    return one, two


def compared(groups: DataFrame, sets: DataFrame, threshold: float, block: int) -> DataFrame:
    """Links (a, b) between components inside the groups of ``several`` (band, node, label, n).

    A group of up to ``block`` nodes is compared whole. A larger one is cut into parts of half as many, those of the most
    frequent component apart from all others; each part of the others meets every part, and only these are copied.
    """
    half = max(1, block // 2)
    small = groups.filter(F.col("n") <= block).select("band", F.lit(0).alias("i"), F.lit(0).alias("j"), "node", "label")
    large = groups.filter(F.col("n") > block)
    kinds = large.groupBy("band", "label").agg(F.count(F.lit(1)).alias("k"))
    most = kinds.groupBy("band").agg(F.max(F.struct("k", "label")).alias("most"), F.sum("k").alias("all"))
    most = most.select("band", F.col("most.label").alias("top"), F.ceil(F.col("most.k") / half).cast("int").alias("tops"), F.ceil((F.col("all") - F.col("most.k")) / half).cast("int").alias("others"))
    large = large.join(most, "band")
    own = F.when(F.col("label") == F.col("top"), F.col("others") + F.pmod(F.xxhash64("node"), "tops")).otherwise(F.pmod(F.xxhash64("node"), "others"))
    large = large.withColumn("part", own.cast("int"))
    last = F.when(F.col("part") < F.col("others"), F.col("others") + F.col("tops")).otherwise(F.col("others")) - 1
    large = large.withColumn("other", F.explode(F.sequence(F.lit(0), last))).filter("part <> other")
    large = large.select("band", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "node", "label")
    rows = small.union(large).join(sets, "node").select("band", "i", "j", "label", "node", "elements")
    rows = rows.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def links(table: pa.Table) -> pa.RecordBatch:
            """The links of the whole groups of a table."""
            keys = np.stack([table.column(c).to_numpy() for c in range(3)])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
            label = table.column(3).combine_chunks().dictionary_encode().indices.to_numpy()
            node, raw = table.column(4).combine_chunks(), table.column(5)
            one, two = [], []
            for at, to in zip([0, *cuts], [*cuts, table.num_rows], strict=True):
                sets_ = [np.frombuffer(x.as_buffer(), K.U) for x in raw.slice(at, to - at)]
                a, b = joins(sets_, label[at:to], threshold)
                one += [x + at for x in a]
                two += [x + at for x in b]
            return pa.RecordBatch.from_arrays([node.take(pa.array(x, pa.int64())) for x in (one, two)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(c) for c in range(3)]
            ends = batch.num_rows - 1
            begin = ends
            while begin and all(k[begin - 1] == k[ends] for k in keys):
                begin -= 1
            # the last group of a batch may go on in the next one
            if begin or (held and any(held[-1].column(c)[0] != keys[c][0] for c in range(3))):
                whole = [*held, batch.slice(0, begin)]
                yield links(pa.Table.from_batches(whole))
                held = []
            held.append(batch.slice(begin))
        if held:
            yield links(pa.Table.from_batches(held))

    return mapped(rows, run, "a binary, b binary")


def deep_bands(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """band, node, label of the nodes of the groups under longer signatures; a row for each deep band."""
    nodes = written(groups.select("node", "label").distinct(), "near-crowded").join(sets, "node").select("node", "label", "elements")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 32):
                part = batch.slice(at, 32)
                own = [np.frombuffer(x.as_buffer(), K.U) for x in part.column(2)]
                signature = signatures(np.concatenate(own), np.array([len(x) for x in own]), DEEP_BANDS * DEEP_ROWS)
                keys = band_keys(signature, DEEP_BANDS)
                ends = pa.array(np.arange(len(keys) + 1) * DEEP_BANDS, pa.int32())
                lists = pa.ListArray.from_arrays(ends, pa.array(keys.reshape(-1), pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists], ["node", "label", "bands"])

    return mapped(nodes, run, "node binary, label binary, bands array<long>").select(F.explode("bands").alias("band"), "node", "label")


@settled
def labelled(docs: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """doc_id, node, label of each document: equal labels make a class of near duplicates."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = written(signed(docs), "near-rows")
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "slot")).alias("least")
    nodes = rows.filter(F.size("bands") > 0).groupBy("node").agg(least, F.first("bands").alias("bands"))
    nodes = written(nodes.select("node", "least.slot", "bands"), "near-nodes")

    banded = nodes.select("node", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("node").alias("least"), F.max("node").alias("most"))
    buckets = written(buckets.filter("least <> most").select("band", "least"), "near-buckets")
    members = written(banded.join(buckets, "band"), "near-members")
    sets = weighted_sets(docs, nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", "slot"))
    sets = written(sets, "near-sets")

    # one pair a node: with the least node it meets anywhere
    first = members.filter("node <> least").groupBy(F.col("node").alias("b")).agg(F.min("least").alias("a"))
    labels = components(linked(first, sets, threshold))
    # the least nodes of its buckets that are in other components
    rest = apart(members, labels)
    stars = rest.filter("label <> least_label").groupBy(F.col("node").alias("b"), "least_label").agg(F.min("least").alias("a"))
    labels = with_more(labels, linked(stars, sets, threshold))
    # the other nodes of its buckets; the least one has met them all, or is in their component
    groups = several(apart(members, labels).filter("node <> least").select("band", "node", "label"), "near-open")
    groups = written(groups, "near-groups")
    labels = with_more(labels, compared(groups.filter(F.col("n") <= block), sets, threshold, block))
    crowded = groups.filter(F.col("n") > block).select("band", "node")
    if not crowded.isEmpty():
        named = crowded.join(labels, "node", "left").select("band", "node", F.coalesce("label", "node").alias("label"))
        crowded = several(named, "near-crowded-open")
        deep = written(several(deep_bands(crowded, sets), "near-deep"), "near-deep-groups")
        labels = with_more(labels, compared(deep, sets, threshold, block))
    return skew_join(rows.select("doc_id", "node"), labels, "node", "left").select(
        "doc_id", "node", F.coalesce("label", "node").alias("label")
    )


@settled
def classes(docs: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """doc_id, node, class_id, class_node (text of the representative) and class_size of each document."""
    rows = labelled(docs, threshold, block)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("best")
    groups = rows.groupBy("label").agg(best, F.count(F.lit(1)).alias("class_size"))
    groups = groups.select("label", F.col("best.doc_id").alias("class_id"), F.col("best.node").alias("class_node"), "class_size")
    out = skew_join(rows, written(groups, "near-classes"), "label")
    return out.select("doc_id", "node", "class_id", "class_node", "class_size")


def deduplicated(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents without near duplicates: of each class the row with the least id (nulls last) stays.

    Texts are shuffled once, by the digest of id and text that both the join and the numbering of repeated rows use (one of
    them stays). All columns stay as they came, whatever their names; null ids and texts as in the module's docstring.
    """
    key, first = free_names(docs.columns, "key", "first")
    spelled = lambda node: F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("none")), F.hex(node)).cast("binary"))
    kept = classes(docs, threshold).filter("doc_id <=> class_id and node = class_node").select(spelled(F.col("node")).alias(key)).distinct()
    own = docs.withColumn(key, spelled(F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))))
    number = F.row_number().over(Window.partitionBy(key).orderBy(F.lit(0)))
    return own.join(kept, key, "left_semi").withColumn(first, number).filter(F.col(first) == 1).select(*docs.columns)


def op10_dart_minhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the class of its near duplicates (five words, similarity 0.8)."""
    return classes(documents(spark, sf_dir)).select("doc_id", "class_id", "class_size")
