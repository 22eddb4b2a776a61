"""Byte-level BPE through a sentencepiece model that is written straight from the vocabulary (operator 8).

Each byte is mapped to one printable character, each vocabulary entry to the string of its bytes' characters; entry of
rank r becomes a piece with score -r, after the unknown piece at id 0, under identity normalisation. Merging the best
scored neighbours first is then merging the lowest rank first. Texts are split into pre-tokens, each is encoded by
itself, and ids are decoded by the inverse mapping. A pre-token that is an entry is that entry, as the ranks demand, and
needs no model: on running prose most occurrences are such. All others go through the model, each different one once while
it stays in a task's cache (``CACHE`` of them; a long text is looked up in parts, so memory is bounded).

The vocabulary is read once on the driver (a fixed file of about 1 MB) and sent with the function. Defined results: a
null text counts as empty, an empty text has no ids; ids may be any integers of the file; characters outside the basic
plane and lone control characters are bytes like all others; repeated rows are coded alike, each for itself; an empty table
gives no rows; null ids stay null; only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolith.llm import kernel as K
from cartolith.llm.shared import documents, mapped

#: A character for each byte: letters without case, digits or marks, that no normalisation touches.
BYTE_CHARS = [chr(0x4E00 + b) for b in range(256)]
CACHE = 200_000
NAMES = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    """One field of a protocol buffer message."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece BPE model: piece 0 is unknown, piece i + 1 the entry with the i-th lowest rank."""
    pieces = [_field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)]
    for token in sorted(ranks, key=ranks.get):
        pieces.append(_field(1, spelled(token).encode()) + _field(2, -float(ranks[token])) + _field(3, 1))
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, 0)  # model type BPE, vocabulary size, unknown id
    trainer += b"".join(_field(n, (1 << 64) - 1) for n in (41, 42, 43))  # no begin, end and padding pieces
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normalizer)


def spelled(token: bytes) -> str:
    return "".join([BYTE_CHARS[b] for b in token])


class Codec:
    """Encodes and decodes by the ranks of a vocabulary and the pattern of its pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, model: bytes | None = None):
        import sentencepiece

        self.ranks = ranks
        self.tokens = {r: t for t, r in ranks.items()}
        self.by_piece = [-1, *sorted(ranks.values())]
        self.find = regex.compile(pattern).findall
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model or model_bytes(ranks))
        self.cache: dict[str, tuple[int, ...]] = {}

    def learn(self, pre_tokens: set[str]) -> None:
        """Encode the pre-tokens that the cache lacks, in one call."""
        if len(self.cache) > CACHE:
            self.cache.clear()
        hard = []
        for p in pre_tokens:
            if p not in self.cache:
                rank = self.ranks.get(p.encode())
                if rank is None:
                    hard.append(p)
                else:
                    self.cache[p] = (rank,)
        if hard:
            ids = self.pieces.encode([spelled(p.encode()) for p in hard], num_threads=1)
            name = self.by_piece
            self.cache.update((p, tuple([name[i] for i in x])) for p, x in zip(hard, ids, strict=True))

    def encode(self, text: str) -> list[int]:
        split = self.find(text)
        out: list[int] = []
        # a very long text is looked up in pieces, so that the cache holds what is in use
        for at in range(0, len(split), CACHE // 2):
            part = split[at : at + CACHE // 2]
            missing = {p for p in part if p not in self.cache}
            if missing:
                self.learn(missing)
                if not all(map(self.cache.__contains__, part)):  # the cache was cleared
                    self.learn(set(part))
            for ids in map(self.cache.__getitem__, part):
                out += ids
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def coded(docs: DataFrame, ranks: dict[bytes, int], pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document, and its ids on request."""
    model = model_bytes(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(ranks, pattern, model)
        names = {r: str(r) for r in codec.tokens}
        for batch in batches:
            for part, _ in K.blocks(batch):
                counts, ids_digest, text_digest, all_ids = [], [], [], []
                for text in part.column(1).to_pylist():
                    ids = codec.encode(text or "")
                    counts.append(len(ids))
                    ids_digest.append(hashlib.sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest())
                    text_digest.append(hashlib.sha256(codec.decode(ids)).hexdigest())
                    all_ids.append(ids)
                columns = [part.column(0), pa.array(counts, pa.int64()), pa.array(ids_digest), pa.array(text_digest)]
                if with_ids:
                    columns.append(pa.array(all_ids, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, NAMES[: len(columns)])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return mapped(docs.select(F.col("doc_id").cast("long"), "text"), run, schema)


def op8_sentencepiece_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by the multilingual byte-level vocabulary and decoded again."""
    import public_tokenizers

    ranks = read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return coded(documents(spark, sf_dir), ranks, public_tokenizers.PATTERN)
