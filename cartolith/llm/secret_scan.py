"""Secret candidates judged by corpus-wide ownership (operator 1).

Three detectors find the base spans; a fourth, `bare`, adds every other long token of letters and digits. Each candidate
value is hashed, and the hashes are aggregated over the whole corpus by distinct repositories and owners. A value that
``COPIED_OWNERS`` owners share, or that stands in ``COPIED_REPOS`` repositories whoever owns them, is a widely copied example;
one of fewer owners and repositories that looks random is taken to be a live credential of its owner. Base spans always
stay; a bare token becomes a span (kind `owned`) only if it is live by that verdict.

Here a document is a repository and its source the owner. Counting goes from (value, owner, repository) to (value, owner)
to value, each with partial sums, so a value that a third of all rows hold is combined before it is moved. Verdicts return
to texts, and texts to documents, by joins that broadcast the fewer than 1000 heaviest keys (shared.skew_join).

Defined results: null text counts as empty, null source is an owner of its own; repeated rows count as one repository if
their ids are equal (null ids are one repository); a document of any length is scanned whole; an empty table gives no rows;
only doc_id, text and source are read, so other columns may have any name. Values never leave the tasks in clear, only their
hashes do.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolith.llm import kernel as K
from cartolith.llm.shared import documents, free_names, mapped, settled, skew_join, written

#: Fixed patterns of the base detectors.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
BARE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
KINDS = ("assign", "access", "hex", "owned")
LEAST_VALUE = 8
_TOKEN = np.array([not (chr(b).isascii() and (chr(b).isalnum() or chr(b) in "+/_=-")) for b in range(256)])

#: A value of so many owners is a copied example.
COPIED_OWNERS = 3
#: A value of so many repositories is one too, even if they have one or two owners.
COPIED_REPOS = 50
#: Bits a character, and different characters, of a value that may be random.
LEAST_ENTROPY, LEAST_KINDS = 2.8, 8


def base_spans(text: str, low: bytes | None = None, raw: bytes | None = None) -> list[tuple[int, int, int, int, int]]:
    """(start, kind, end, value start, value end) of the base detectors, sorted, in code points."""
    found = []
    low = text.lower().encode() if low is None else low
    if any(k in low for k in KEYWORDS):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= LEAST_VALUE:
                found.append((m.start(), 0, m.end(), m.start(2), m.end(2)))
    if raw is None or b"AKIA" in raw:
        found += [(m.start(), 1, m.end(), *m.span()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), *m.span()) for m in HEX.finditer(text)]
    return sorted(found)


def bare_spans(text: str, base: list) -> list[tuple[int, int, int, int, int]]:
    """Long tokens with a letter and a digit that no base span touches."""
    found = []
    for m in BARE.finditer(text):
        value = m[0]
        if any(c.isdigit() for c in value) and any(c.isalpha() for c in value):
            if all(m.end() <= s or e <= m.start() for s, _, e, *_ in base):
                found.append((m.start(), 3, m.end(), *m.span()))
    return found


def random_looking(value: str) -> bool:
    counts = Counter(value).values()
    entropy = -sum(c / len(value) * math.log2(c / len(value)) for c in counts)
    return len(counts) >= LEAST_KINDS and entropy >= LEAST_ENTROPY


def spelled(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


CANDIDATE = "struct<kind int, start long, end long, vstart long, vend long, hash long, random boolean>"


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, owner, text_key and candidates of each document."""
    kind = pa.struct(
        [("kind", pa.int32()), *((n, pa.int64()) for n in ("start", "end", "vstart", "vend", "hash")), ("random", pa.bool_())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, t in K.blocks(batch):
                starts, ends, counts = t.runs(_TOKEN)
                long = np.bincount(t.doc_of(counts)[ends - starts >= 20], minlength=t.n) > 0
                raw, low = t.data.tobytes(), K.LOWER[t.data].tobytes()
                keys, rows = [], []
                for i in range(t.n):
                    at, to = int(t.offsets[i]), int(t.offsets[i + 1])
                    own, small = raw[at:to], low[at:to]
                    keys.append(hashlib.md5(own).digest())
                    if not (long[i] or b"AKIA" in own or any(k in small for k in KEYWORDS)):
                        rows.append([])
                        continue
                    text = own.decode()
                    base = base_spans(text, small, own)
                    row = []
                    for s, k, e, vs, ve in base + bare_spans(text, base):
                        value = text[vs:ve]
                        digest = int.from_bytes(hashlib.blake2b(value.encode(), digest_size=8).digest(), "little", signed=True)
                        row.append((k, s, e, vs, ve, digest, random_looking(value)))
                    rows.append([dict(zip(("kind", "start", "end", "vstart", "vend", "hash", "random"), x, strict=True)) for x in row])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(keys, pa.binary()), pa.array(rows, pa.list_(kind))],
                    ["doc_id", "owner", "text_key", "found"],
                )

    columns = docs.select(F.col("doc_id").cast("long"), "text", F.col("source").cast("string"))
    return mapped(columns, run, f"doc_id long, owner string, text_key binary, found array<{CANDIDATE}>")


def verdicts(rows: DataFrame, copied_owners: int = COPIED_OWNERS, copied_repos: int = COPIED_REPOS) -> DataFrame:
    """hash, n, n_repos, n_owners, copied for each candidate value. rows: what ``scanned`` gives, written."""
    each = rows.filter(F.size("found") > 0).select(
        F.explode(F.expr("transform(found, x -> x.hash)")).alias("hash"), "owner", F.coalesce("doc_id", F.lit(-1)).alias("repo")
    )
    repos = each.groupBy("hash", "owner", "repo").agg(F.count(F.lit(1)).alias("n"))
    owners = repos.groupBy("hash", "owner").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_repos"))
    values = owners.groupBy("hash").agg(
        F.sum("n").alias("n"), F.sum("n_repos").alias("n_repos"), F.count(F.lit(1)).alias("n_owners")
    )
    return values.withColumn("copied", (F.col("n_owners") >= copied_owners) | (F.col("n_repos") >= copied_repos))


def decided(rows: DataFrame, values: DataFrame) -> DataFrame:
    """text_key, decided: the candidates of each different text, with copied and live. Both tables are written."""
    each = rows.filter(F.size("found") > 0).select("text_key", F.explode("found").alias("x")).distinct()
    each = written(each.withColumn("hash", F.col("x.hash")), "secret-candidates")
    each = skew_join(each, values.select("hash", "copied", "n_repos", "n_owners"), "hash")
    live = ~F.col("copied") & F.col("x.random")
    # the candidates of one text: as many as it has
    return each.groupBy("text_key").agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    *(F.col(f"x.{c}") for c in ("start", "kind", "end", "vstart", "vend")), "copied", live.alias("live"), "n_repos", "n_owners"
                )
            )
        ).alias("decided")
    )


@settled
def scan(docs: DataFrame, copied_owners: int = COPIED_OWNERS, copied_repos: int = COPIED_REPOS) -> DataFrame:
    """doc_id, text_key and decided (all candidates with verdicts, or null without any) of each document."""
    rows = written(scanned(docs), "secret-rows")
    values = written(verdicts(rows, copied_owners, copied_repos), "secret-values")
    by_text = written(decided(rows, values), "secret-decided")
    some = skew_join(rows.filter(F.size("found") > 0), by_text, "text_key", "left", bounded=False).select("doc_id", "text_key", "decided")
    none = rows.filter(F.size("found") == 0).select(
        "doc_id", "text_key", F.lit(None).cast(by_text.schema["decided"].dataType).alias("decided")
    )
    return some.union(none)


def spell(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(
        F.transform(
            spans,
            lambda x: F.concat_ws(":", F.element_at(kinds, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string")),
        ),
        ",",
    )


def redacted(docs: DataFrame, copied_owners: int = COPIED_OWNERS, copied_repos: int = COPIED_REPOS) -> DataFrame:
    """The documents with the value of each span replaced: <SECRET>, or <EXAMPLE> where it is widely copied.

    n_chars follows the text; documents without a span are returned as they are. All columns stay, whatever their names.
    """
    key, marks = free_names(docs.columns, "text_key", "marks")
    found = scan(docs, copied_owners, copied_repos).filter(
        F.exists("decided", lambda x: (x["kind"] < 3) | x["live"])
    )  # null without candidates
    found = written(found, "secret-found")
    spans = found.select("text_key", F.filter("decided", lambda x: (x["kind"] < 3) | x["live"]).alias(marks)).dropDuplicates(["text_key"])
    spans = written(spans.withColumnRenamed("text_key", key), "secret-spans")
    own = docs.withColumn(key, F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    # copies of one text may be any share of the rows: they are counted on the narrow table
    both = skew_join(own, spans, key, "left", found.select(F.col("text_key").alias(key)), bounded=False).select(*docs.columns, marks)
    columns, at = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marked = np.flatnonzero(batch.column(len(columns)).is_valid())
            texts = batch.column(at).to_pylist() if len(marked) else []
            for i in marked:
                spans = batch.column(len(columns))[int(i)].as_py()
                texts[i] = replaced(texts[i], [(x["vstart"], x["vend"], x["copied"]) for x in spans])
            arrays = list(batch.columns[: len(columns)])
            if len(marked):
                arrays[at] = pa.array(texts, arrays[at].type)
            yield pa.RecordBatch.from_arrays(arrays, columns)

    out = mapped(both, run, docs.schema)
    if "n_chars" in columns:
        kind = dict(docs.dtypes)["n_chars"]
        if kind in ("bigint", "int"):
            out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(kind)))
    return out.select(*columns)


def replaced(text: str, values: list[tuple[int, int, bool]]) -> str:
    """Values that overlap are one; it is an example only if all of them are."""
    merged: list[list] = []
    for s, e, copied in sorted(values):
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
            merged[-1][2] = merged[-1][2] and copied
        else:
            merged.append([s, e, copied])
    out, at = [], 0
    for s, e, copied in merged:
        out += [text[at:s], "<EXAMPLE>" if copied else "<SECRET>"]
        at = e
    return "".join([*out, text[at:]])


def op1_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document with the verdicts of their values."""
    found = scan(documents(spark, sf_dir))
    all_ = F.coalesce("decided", F.array().cast(found.schema["decided"].dataType))
    base = F.filter(all_, lambda x: x["kind"] < 3)
    number = lambda k: F.size(F.filter(all_, lambda x: x["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        number(0).alias("n_assign"),
        number(1).alias("n_access"),
        number(2).alias("n_hex"),
        F.sha2(spell(base).cast("binary"), 256).alias("base_sha256"),
        spell(F.filter(all_, lambda x: (x["kind"] < 3) | x["live"])).alias("spans"),
        F.size(F.filter(all_, lambda x: x["live"])).cast("long").alias("n_live"),
        F.size(F.filter(all_, lambda x: x["copied"])).cast("long").alias("n_copied"),
        F.coalesce(F.array_max(F.transform(all_, lambda x: x["n_repos"])), F.lit(0)).cast("long").alias("most_repos"),
        F.coalesce(F.array_max(F.transform(all_, lambda x: x["n_owners"])), F.lit(0)).cast("long").alias("most_owners"),
    )
