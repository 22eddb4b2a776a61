"""Repair of conversation structure by weighted interval parsing (operator 11).

The grammar of a repaired conversation is ``(s?(ua)+)?`` over role initials. In Chomsky normal form its nonterminals are
pairs of phases (nothing yet, after s, after u, after a): A[p,q] derives the spans of rows that, once edited, lead from
phase p to phase q. The rules are A[p,q] -> A[p,r] A[r,q], and A[p,q] -> row for keeping, re-roling or deleting a row. Each
cell holds the minimum (cost, audit) of its span, closed under insertions on both sides. Spans are combined bottom-up by
length: rows, then pairs of neighbouring spans. Since A[p,q] exists for every pair of phases, each split of a span gives the
same minimum, so one split a span is enough (tested against the chart of all splits).

The minimum over (cost, audit) may be taken span by span: at equal cost no audit of a span is a prefix of another (the
longer one would only add insertions, which cost), so what stands to the right never changes an order.

Scale: equal rows of a conversation at one turn are counted before anything else; narrow rows (no texts) get their number
by range partitions, so a conversation of any share of the rows is spread out; CHUNK rows become one cell, FAN cells one
cell a round, until each conversation has one. Texts are moved once, to lay the edits on them, as a stream that holds one
conversation's audit and one batch. (A SHA-256 of a conversation is sequential, so there its lines pass one task, in order.)

Defined results: null conversations are one conversation, returned as null; null turns come first; null role or text is one
space, a role without a letter fits no phase; rows that tie in turn go by role and digest of the text before damage; repeated
rows are rows, all but the first duplicates; conversations without rows after damage get zeros and no lines; an empty table
gives no rows; only conv_id, turn, role and text are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolith.llm.shared import mapped, settled, written
from cartolith.operators.ranking import numbered

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Rows of a first cell, and cells that a round joins.
CHUNK, FAN = 256, 64
#: Phases: 0 nothing yet, 1 after s, 2 after u, 3 after a. A conversation may end in 0 or 3.
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
PHASES = (0, 1, 2, 3)
LEGAL = ("su", "ua", "au")

Cell = dict[tuple[int, int], tuple[int, str]]


def least(cell: Cell, at: tuple[int, int], found: tuple[int, str]) -> None:
    if at not in cell or found < cell[at]:
        cell[at] = found


def joined(left: Cell, right: Cell) -> Cell:
    """The cell of two neighbouring spans: A[p,q] -> A[p,r] A[r,q]."""
    out: Cell = {}
    for (p, r), (cost, audit) in left.items():
        for q in PHASES:
            other = right.get((r, q))
            if other is not None:
                total = cost + other[0]
                held = out.get((p, q))
                if held is None or total < held[0] or (total == held[0] and audit + other[1] < held[1]):
                    out[p, q] = (total, audit + other[1])
    return out


def insertions() -> Cell:
    """The closure of insertions over an empty span."""
    cell: Cell = {(p, p): (0, "") for p in PHASES}
    one = {(p, q): (INSERT, "I") for (p, x), q in STEPS.items() if x != "s"}
    while True:
        more = dict(cell)
        for at, found in joined(cell, one).items():
            least(more, at, found)
        if more == cell:
            return cell
        cell = more


EMPTY = insertions()


def deletions(n: int) -> Cell:
    """n rows that must go. D sorts before I, so insertions follow."""
    return {at: (DELETE * n + cost, "D" * n + audit) for at, (cost, audit) in EMPTY.items()}


@lru_cache(maxsize=None)
def row_cell(initial: str, truncated: bool) -> Cell:
    """A row that may stay; initial is s, u, a or o (any other)."""
    cell: Cell = {(p, p): (DELETE, "D") for p in PHASES}
    extra = TRUNCATED if truncated else 0
    for (p, x), q in STEPS.items():
        if x == initial:
            least(cell, (p, q), (KEEP + extra, "K"))
        if x != "s":
            least(cell, (p, q), (REROLE + extra, "R"))
    return joined(joined(EMPTY, cell), EMPTY)


def combined(cells: list[Cell]) -> Cell:
    """Neighbouring spans joined two by two until one is left."""
    while len(cells) > 1:
        cells = [joined(*cells[i : i + 2]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
    return cells[0] if cells else EMPTY


@lru_cache(maxsize=1 << 15)
def short_span(rows: str) -> Cell:
    """The cell of a few rows: an initial each, upper case if truncated, x if it must go."""
    if len(rows) == 1:
        return deletions(1) if rows == "x" else row_cell(rows.lower(), rows.isupper())
    half = len(rows) // 2
    return joined(short_span(rows[:half]), short_span(rows[half:]))


def span_cell(rows: str) -> Cell:
    return combined([short_span(rows[i : i + 8]) for i in range(0, len(rows), 8)])


def repair(rows: str) -> tuple[int, str]:
    """Cost and audit of a conversation of rows written as for ``short_span``."""
    return best(span_cell(rows))


def best(cell: Cell) -> tuple[int, str]:
    return min(cell[0, q] for q in (0, 3) if (0, q) in cell)


class Span:
    """A cell with what the counts of its rows need: initials at its ends and turns at its ends."""

    __slots__ = ("cell", "blank", "duplicate", "truncated", "illegal", "first", "last", "low", "high", "turns")

    def __init__(self, cell, blank=0, duplicate=0, truncated=0, illegal=0, first=None, last=None, low=None, high=None, turns=0):
        self.cell, self.blank, self.duplicate, self.truncated, self.illegal = cell, blank, duplicate, truncated, illegal
        self.first, self.last, self.low, self.high, self.turns = first, last, low, high, turns

    def counts(self) -> tuple:
        return self.blank, self.duplicate, self.truncated, self.illegal, self.first, self.last, self.low, self.high, self.turns

    def take(self, next_: Span) -> None:
        """Adds the counts of the span that follows."""
        self.blank += next_.blank
        self.duplicate += next_.duplicate
        self.truncated += next_.truncated
        self.illegal += next_.illegal
        if next_.first is not None:
            if self.last is not None and self.last + next_.first not in LEGAL:
                self.illegal += 1
            self.first, self.last = self.first or next_.first, next_.last
        if next_.turns:
            self.turns += next_.turns - (self.turns > 0 and self.high == next_.low)
            self.low = next_.low if self.low is None else self.low
            self.high = next_.high


def span_of(initials: str, faults: str, many: list[int], turns: list[int | None]) -> Span:
    """The span of a chunk's rows: initial, fault (b, d, t or - for none), copies and turn of each.

    Of several copies the first has the fault, the others are duplicates (blank if it is blank).
    """
    out, cells, run = Span(None), [], []
    for initial, fault, n, turn in zip(initials, faults, many, turns, strict=True):
        if not n:
            continue
        if fault == "b":
            out.blank += n
        else:
            out.duplicate += n - 1 + (fault == "d")
            out.truncated += fault == "t"
        out.illegal += n - 1
        if out.last is None:
            out.first = initial
        elif out.last + initial not in LEGAL:
            out.illegal += 1
        out.last = initial
        if turn is not None and turn != out.high:
            out.turns += 1
            out.low = turn if out.low is None else out.low
            out.high = turn
        run.append("x" if fault in "bd" else initial.upper() if fault == "t" else initial)
        if n > 1:
            cells += [span_cell("".join(run)), deletions(n - 1)]
            run = []
    if run:
        cells.append(span_cell("".join(run)))
    out.cell = combined(cells)
    return out


SPAN = pa.schema(
    [
        ("cost", pa.list_(pa.int64())),
        ("audit", pa.list_(pa.string())),
        *((c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal")),
        ("first", pa.string()),
        ("last", pa.string()),
        *((c, pa.int64()) for c in ("low", "high", "turns")),
    ]
)
SPAN_SQL = (
    "cost array<bigint>, audit array<string>, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
    "first string, last string, low bigint, high bigint, turns bigint"
)
ALL = [(p, q) for p in PHASES for q in PHASES]


def packed(span: Span) -> tuple:
    found = [span.cell.get(at, (None, None)) for at in ALL]
    return [f[0] for f in found], [f[1] for f in found], *span.counts()


def unpacked(row: dict) -> Span:
    cell = {at: (c, a) for at, c, a in zip(ALL, row["cost"], row["audit"], strict=True) if c is not None}
    return Span(cell, *(row[name] for name in SPAN.names[2:]))


def as_batch(keys: list[pa.Array], names: list[str], spans: list[Span]) -> pa.RecordBatch:
    columns = list(zip(*map(packed, spans))) or [()] * len(SPAN)
    arrays = [pa.array(c, f.type) for c, f in zip(columns, SPAN, strict=True)]
    return pa.RecordBatch.from_arrays(keys + arrays, names + SPAN.names)


def first_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv_id, chunk, initials, faults, many, turns to a span each."""
    for batch in batches:
        rows = zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True)
        yield as_batch(batch.columns[:2], ["conv_id", "chunk"], [span_of(*r) for r in rows])


def wider_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv_id, chunk and the neighbouring spans in order to a span each."""
    for batch in batches:
        out = []
        for row in batch.column(2).to_pylist():
            spans = [unpacked(x) for x in row]
            whole = Span(None)
            for span in spans:
                whole.take(span)
            whole.cell = combined([s.cell for s in spans])
            out.append(whole)
        yield as_batch(batch.columns[:2], ["conv_id", "chunk"], out)


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after damage, copies (0 if dropped), and by_role, by_text: the order of rows of one turn."""
    held = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(held("conv_id"), F.lit(":"), held("turn")).cast("binary")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.translate(held("text"), ".!?", "")).otherwise(held("text"))
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(fault == 4, "user").otherwise(held("role")).alias("role"),
        text.alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("copies"),
        held("role").alias("by_role"),
        F.md5(held("text").cast("binary")).alias("by_text"),
    )


def undamaged(rows: DataFrame) -> DataFrame:
    """Rows as they come, in the form that ``parsed`` and ``repaired`` take."""
    held = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    own = (F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), held("role").alias("role"), held("text").alias("text"))
    return rows.select(*own, F.lit(1).alias("copies"), held("role").alias("by_role"), F.md5(held("text").cast("binary")).alias("by_text"))


ORDER = ("turn", "by_role", "by_text")


@settled
def parsed(rows: DataFrame) -> DataFrame:
    """One row a conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit. rows: as of ``damaged``."""
    initial = F.substring("role", 1, 1)
    last = F.right(F.rtrim(F.translate("text", "\t\n\x0b\x0c\r", "     ")), F.lit(1))
    narrow = rows.select(
        "conv_id",
        *ORDER,
        F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("initial"),
        F.when(last == "", "b").when(last.isin(".", "!", "?"), "-").otherwise("t").alias("fault"),
        F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")).alias("kind"),
        "copies",
    )
    # what is equal in these has equal damage, so it is equal in all
    runs = narrow.groupBy("conv_id", *ORDER, "initial", "fault", "kind").agg(F.sum("copies").alias("many"))
    runs = written(numbered(runs, ["conv_id"], [*ORDER, "kind"], "number"), "repair-runs")
    firsts = runs.filter("many > 0").groupBy("conv_id", "kind").agg(F.min("number").alias("at"))
    firsts = firsts.select(F.col("conv_id").alias("conv_"), "at")
    same = runs["conv_id"].eqNullSafe(firsts["conv_"]) & (runs["number"] == firsts["at"])
    marked = runs.join(firsts, same, "left")
    fault = F.when((F.col("fault") != "b") & F.col("at").isNull(), "d").otherwise(F.col("fault"))
    row = F.struct("number", "initial", fault.alias("fault"), "many", "turn")
    chunks = marked.groupBy("conv_id", F.floor((F.col("number") - 1) / CHUNK).cast("long").alias("chunk"))
    chunks = chunks.agg(F.array_sort(F.collect_list(row)).alias("rows"))
    lists = (F.array_join("rows.initial", "").alias("initials"), F.array_join("rows.fault", "").alias("faults"), "rows.many", "rows.turn")
    cells = mapped(chunks.select("conv_id", "chunk", *lists), first_cells, f"conv_id bigint, chunk bigint, {SPAN_SQL}")
    longest = runs.agg(F.max("number")).first()[0] or 0
    n = -(-longest // CHUNK)
    while n > 1:
        cells = written(cells, "repair-cells")
        wider = cells.groupBy("conv_id", F.floor(F.col("chunk") / FAN).cast("long").alias("wider"))
        wider = wider.agg(F.array_sort(F.collect_list(F.struct("chunk", *SPAN.names))).alias("spans"))
        cells = mapped(wider.select("conv_id", "wider", "spans"), wider_cells, f"conv_id bigint, chunk bigint, {SPAN_SQL}")
        n = -(-n // FAN)
    ends = [F.struct(F.get("cost", F.lit(ALL.index((0, q)))).alias("cost"), F.get("audit", F.lit(ALL.index((0, q)))).alias("audit")) for q in (0, 3)]
    found = F.array_min(F.filter(F.array(*ends), lambda x: x["cost"].isNotNull()))
    gaps = F.when(F.col("turns") > 0, F.col("high") - F.col("low") + 1 - F.col("turns")).otherwise(0)
    return cells.select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", found["cost"].alias("cost"), found["audit"].alias("audit"))


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def laid(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """The audits and the rows they are for, side by side: in one partition and in order, a conversation's audit first."""
    lines = rows.filter("copies > 0").withColumn("part", F.lit(1))
    both = plans.withColumn("part", F.lit(0)).unionByName(lines, allowMissingColumns=True)
    both = both.repartition("conv_id").sortWithinPartitions("conv_id", "part", *ORDER)
    return both.select("conv_id", "part", *COUNTS, "audit", "copies", "role", "text")


def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Each conversation's audit (0, its row of ``laid``), then its repaired lines (1, edit, role, text)."""
    audit, at, out, odd = "", 0, 0, 0

    def role_at(n: int) -> str:
        return "user" if (n - odd) % 2 == 0 else "assistant"

    def inserted(at: int, out: int) -> Iterator[tuple]:
        while at < len(audit) and audit[at] == "I":
            yield 1, "I", role_at(out), ""
            at, out = at + 1, out + 1

    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for row in zip(*columns, strict=True):
            if row[1] == 0:
                for line in inserted(at, out):
                    yield line
                audit, at, out = row[8], 0, 0
                odd = (len(audit) - audit.count("D")) % 2
                yield 0, row
                continue
            for _ in range(row[9]):
                for line in inserted(at, out):
                    yield line
                    at, out = at + 1, out + 1
                edit = audit[at]
                at += 1
                if edit != "D":
                    yield 1, edit, row[10] if edit == "K" else role_at(out), row[11]
                    out += 1
    yield from inserted(at, out)


#: Bytes of text in an output batch.
OUT = 1 << 20


def repaired(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, line (from 0), edit (K, R or I), role, text."""
    names = ["conv_id", "line", "edit", "role", "text"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, line, held, size = None, 0, [], 0
        for event in edited(batches):
            if event[0] == 0:
                conv, line = event[1][0], 0
                continue
            held.append((conv, line, *event[1:]))
            line, size = line + 1, size + len(event[3]) + 64
            if size > OUT:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)

    return mapped(laid(rows, plans), run, "conv_id bigint, line bigint, edit string, role string, text string")


def digested(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """The audits with the SHA-256 of each repaired conversation, role:text joined by newlines."""
    names = ["conv_id", *COUNTS, "audit", "repaired_sha256"]
    types = [pa.int64()] * 7 + [pa.string()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, digest, lines, held, size = None, None, 0, [], 0
        for event in edited(batches):
            if event[0] == 1:
                digest.update(f"{'' if lines == 0 else chr(10)}{event[2]}:{event[3]}".encode())
                lines += 1
                continue
            if head is not None:
                held.append((*head, digest.hexdigest()))
                size += len(head[7]) + 128
            row = event[1]
            head, digest, lines = (row[0], *row[2:9]), hashlib.sha256(), 0
            if size > OUT:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)
                held, size = [], 0
        if head is not None:
            held.append((*head, digest.hexdigest()))
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)

    schema = ", ".join(["conv_id bigint", *(f"{c} bigint" for c in COUNTS), "audit string", "repaired_sha256 string"])
    return mapped(laid(rows, plans), run, schema)


@settled
def op11_interval_parsing_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damages every conversation and repairs it at the least cost."""
    rows = damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))
    return digested(rows, parsed(rows))
