"""Bounded training samples of labelled documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolith.llm import kernel as K
from cartolith.llm.shared import mapped

#: A text is cut into pieces of about so many bytes for its excerpt, which has so many pieces at most.
PIECE, PIECES = 512, 40


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, fit: Column, each: int) -> DataFrame:
    """doc_id, text (whole), y of at most ``each`` documents of every label value 0 and 1.

    docs: doc_id, text; fit: which doc_id may be learned from. Rows are chosen by a hash of the id among the labels, a
    narrow table; the chosen ids (2 * each rows) are broadcast to the scan of the texts. Of rows that share an id the text
    with the least hash stands for all, combined before it is moved.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & fit)
    known = known.groupBy("doc_id").agg(F.max(label).alias("y"))
    chosen = None
    for value in (0, 1):
        part = known.filter(F.col("y") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(each)
        chosen = part if chosen is None else chosen.union(part)
    found = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y")
    return found.agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("least")).select("doc_id", "least.text", "y")


def excerpt(text: str) -> str:
    """A short text whole; of a longer one PIECES pieces spread over all of it, chosen by their hashes, in order."""
    raw = text.encode()
    if len(raw) <= PIECE * PIECES:
        return text
    t = K.texts(pa.array([text]))
    starts, ends, _ = t.runs(K.SPACE)
    if not len(starts):
        return ""
    # a piece ends with the word that fills it; a longer word is a piece of its own
    number = starts // PIECE
    first = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
    last = np.concatenate([first[1:], [len(starts)]]) - 1
    hashes = t.hashes(starts[first], ends[last])
    kept = np.sort(np.argsort(hashes, kind="stable")[:PIECES])
    return "\n".join(raw[starts[first[i]] : ends[last[i]]].decode() for i in kept)


def excerpts(rows: DataFrame) -> pa.Table:
    """doc_id, text (excerpt), y of a sample, on the driver, in order of ids; equal texts once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            short = pa.array([excerpt(x or "") for x in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), short, batch.column(2)], ["doc_id", "text", "y"])

    table = mapped(rows.select(F.col("doc_id").cast("long"), "text", F.col("y").cast("int")), run, "doc_id long, text string, y int").toArrow()
    table = table.sort_by([("doc_id", "ascending")])
    seen, keep = set(), []
    for i, text in enumerate(table.column("text").to_pylist()):
        if text not in seen:
            seen.add(text)
            keep.append(i)
    return table.take(pa.array(keep, pa.int64()))


#: Documents of a sample that are worked on at a time, so that fitting holds little memory.
SLICE = 128


def slices(column: pa.ChunkedArray) -> list[K.Texts]:
    """A text column as Texts, some documents each."""
    return [as_texts(column.slice(i, SLICE)) for i in range(0, len(column), SLICE)]


def stories(t: K.Texts) -> np.ndarray:
    """The least shingle of each document: near copies share it mostly."""
    found, counts = K.shingles(t)
    own = np.zeros(t.n, K.U)
    if len(found):
        own[counts > 0] = np.minimum.reduceat(found, (np.cumsum(counts) - counts)[counts > 0])
    return own


def distinct_stories(rows: pa.Table) -> pa.Table:
    """The rows without those that share their least shingle: one of a group of near copies."""
    _, first = np.unique(np.concatenate([stories(t) for t in slices(rows.column("text"))]), return_index=True)
    return rows.take(pa.array(np.sort(first), pa.int64()))


def as_texts(column: pa.ChunkedArray) -> K.Texts:
    return K.texts(column.combine_chunks())
