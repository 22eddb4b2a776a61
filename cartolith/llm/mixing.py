"""Source mixing by weighted fair queueing (operator 5).

Each source is a queue of its documents in a seeded shuffle, repeated up to ``epochs`` times. A row for each document and
epoch has a virtual finish time, the words of its source up to its end divided by the source's target. All rows are sorted
globally by virtual finish (range partitions, shared.running_totals) and taken in that order until the total budget is used
up. With ``cut='document'`` rows are taken whole, so the total is within half a document of the budget. With ``cut='word'``
a document that is in service at virtual time 1, when every source has its target, counts as two rows, the part up to that
time and the rest, and the row at the budget is taken in part: then the truncated order meets each source's target to the
word, but for the rounding of targets to whole words (less than a word a source in all).

In a source the global order is that of its queue, so the words that the cut leaves to each source say which documents they
are. One source may hold any share of the rows. Defined results: null source is a source of its own, last; null text has
size 0; a document of size 0 is never taken; an empty table gives no rows; repeated rows are documents of their own; rows
that tie in finish go by source (null first), epoch, shuffle and id; other columns may have any name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartolith.llm.shared import documents, free_names, is_small, running_totals, settled, small, word_count, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
EPOCHS = 2
SEED = "mix-1"


def shuffle_key(doc_id: Column, seed: str = SEED) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), doc_id.cast("string")).cast("binary"))


@settled
def targets(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """source, source_size, target: the budget shared by weight, capped at epochs times a source's size.

    rows: written table with columns source and size. Weights repeat over the sources by code point, null last.
    The excess over a cap is shared again by weight until no target is above its cap.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    sizes = written(sizes.withColumn("last", F.col("source").isNull()), "mixing-sources")
    if is_small(sizes):  # a window over a row for each source; else without a task that sees all
        ranked = sizes.withColumn("position", F.row_number().over(Window.orderBy("last", "source")) - 1)
    else:
        ranked = running_totals(sizes, ["last", "source"], "source_size")
    pick = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("position") % len(weights) + 1).cast("int"))
    ranked = written(
        ranked.select("source", "source_size", pick.alias("weight"), (F.col("source_size") * epochs).alias("cap")),
        "mixing-weights",
    )
    budget = share * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    rate = 0.0
    while True:
        over = F.col("cap") < F.col("weight") * rate
        full, left = ranked.agg(
            F.coalesce(F.sum(F.when(over, F.col("cap"))), F.lit(0)), F.sum(F.when(~over, F.col("weight")))
        ).first()
        new = (budget - full) / left if left else rate
        if new <= rate:
            break
        rate = new
    fair = F.col("weight") * rate
    return ranked.select(
        "source", "source_size", F.when(F.col("cap") < fair, F.col("cap").cast("double")).otherwise(fair).alias("target")
    )


@settled
def mix(rows: DataFrame, cut: str = "word", epochs: int = EPOCHS, **how) -> DataFrame:
    """Words that the mix takes of each document. rows: written table with doc_id, source, size and shuffle (order)."""
    wanted = targets(rows, epochs=epochs, **how)
    budget = wanted.agg(F.sum("target")).first()[0] or 0.0
    placed = running_totals(rows, ["shuffle", "doc_id"], "size", ["source"])
    to = F.col("source").eqNullSafe(F.col("to_source"))
    both = placed.join(small(wanted.withColumnRenamed("source", "to_source")), to).drop("to_source")
    whole = served(queued(both, cut, epochs), budget, cut).withColumnRenamed("source", "to_source")
    both = both.join(small(whole), to, "left").drop("to_source")
    words, taken = F.coalesce("served", F.lit(0)), F.lit(0).cast("long")
    for epoch in range(epochs):
        taken = taken + F.greatest(F.lit(0), F.least(F.col("size"), words - F.col("source_size") * epoch - F.col("before")))
    finish = F.when(F.col("target") > 0, (F.col("before") + F.col("size")) / F.col("target"))
    return both.withColumn("taken", taken.cast("long")).withColumn("finish", finish).drop("served")


def queued(both: DataFrame, cut: str, epochs: int) -> DataFrame:
    """source, epoch, shuffle, doc_id, words, finish: the rows that the global order sorts."""
    queue = both.filter("size > 0 and target > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    queue = queue.withColumn("start", F.col("source_size") * F.col("epoch") + F.col("before"))
    end, goal = F.col("start") + F.col("size"), F.floor("target")
    whole = F.struct(F.col("size").cast("long").alias("words"), (end / F.col("target")).alias("finish"))
    parts = F.array(whole)
    if cut == "word":
        first = F.struct((goal - F.col("start")).cast("long").alias("words"), F.lit(1.0).alias("finish"))
        rest = F.struct((end - goal).cast("long").alias("words"), (end / F.col("target")).alias("finish"))
        parts = F.when((F.col("start") < goal) & (end > F.col("target")), F.array(first, rest)).otherwise(parts)
    queue = queue.select("source", "epoch", "shuffle", "doc_id", F.explode(parts).alias("part"))
    return written(queue.select("source", "epoch", "shuffle", "doc_id", "part.words", "part.finish"), "mixing-queue")


def served(queue: DataFrame, budget: float, cut: str) -> DataFrame:
    """source, served: words of each source that the budget takes in the global order of virtual finish.

    Whole rows: one is taken if half of it at least fits, and no row after one that is left. Else the last one in part.
    """
    placed = running_totals(queue, ["finish", "source", "epoch", "shuffle", "doc_id"], "words")
    own = F.col("words")
    if cut == "document":
        placed = placed.filter(2 * F.col("before") + F.col("words") <= 2 * budget)
    else:
        limit = F.lit(math.floor(budget + 1e-6))
        placed = placed.filter(F.col("before") < limit)
        own = F.least(F.col("words"), limit - F.col("before"))
    return written(placed.groupBy("source").agg(F.sum(own).alias("served")), "mixing-served")


def mixture(docs: DataFrame, **how) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns they came with.

    In a source's shuffled order the mix takes a prefix in each epoch, so a threshold for each source and epoch says it
    all: the texts are read once, against a table with a row for each source, and aren't moved. Repeated rows share a key
    and are taken or left together.
    """
    key = F.struct(shuffle_key(F.col("doc_id")).alias("shuffle"), "doc_id")
    rows = docs.select(
        "doc_id", "source", word_count(F.col("text")).alias("size"), shuffle_key(F.col("doc_id")).alias("shuffle")
    )
    epochs = how.get("epochs", EPOCHS)
    taken = mix(written(rows, "mixing-rows"), cut="document", **how).filter("taken > 0")
    to_source, copies, copy, *ends = free_names(docs.columns, "to_source", "copies", "copy", *(f"last{e}" for e in range(epochs)))
    last = [F.max(F.when(F.col("taken") > F.col("size") * e, F.struct("shuffle", "doc_id"))).alias(ends[e]) for e in range(epochs)]
    last = written(taken.groupBy(F.col("source").alias(to_source)).agg(*last), "mixing-last")
    both = docs.join(small(last), F.col("source").eqNullSafe(F.col(to_source)))
    many = sum((F.coalesce(key <= F.col(end), F.lit(False)).cast("int") for end in ends), F.lit(0))
    both = both.withColumn(copies, F.when(word_count(F.col("text")) > 0, many).otherwise(0)).filter(F.col(copies) > 0)
    return both.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)


def op5_fair_queue_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed at weights 5, 2, 1 repeating and 150 % of all words, in order of virtual finish."""
    rows = documents(spark, sf_dir).select(
        "doc_id", "source", word_count(F.col("text")).alias("size"), shuffle_key(F.col("doc_id")).alias("shuffle")
    )
    mixed = mix(written(rows, "mixing-rows"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "finish").orderBy(
        F.col("finish").asc_nulls_last(), "source", "doc_id"
    )
