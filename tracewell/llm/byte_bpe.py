"""Byte-level BPE over a rank file, run by sentencepiece.

The vocabulary is serialised straight into a sentencepiece BPE model: every
token's bytes are mapped to one character each, its score is its negative rank,
and normalisation is the identity, so sentencepiece merges the pair of lowest
rank first, leftmost among equals. Texts are cut by the vocabulary's pattern
and each piece is encoded by itself; ids decode through the inverse mapping.
Pieces that are tokens themselves are looked up before any merge.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
import sentencepiece
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as pb

#: Pieces that a worker remembers; the memory is emptied when it is full.
REMEMBERED = 150_000
#: Longer pieces are encoded anew each time.
LONG = 200


def _characters() -> list[str]:
    """A printable character for each byte: itself where printable, else one from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(moved)) for b in range(256)]


CHARACTER = _characters()
BYTE = {c: b for b, c in enumerate(CHARACTER)}
TABLE = {b: c for b, c in enumerate(CHARACTER)}


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(t): int(r) for t, r in (line.split() for line in data.splitlines() if line)}


def serialise(ranks: dict[bytes, int]) -> bytes:
    """The sentencepiece model; ids are ranks, the unknown piece follows the last."""
    if sorted(ranks.values()) != list(range(len(ranks))):
        raise ValueError("ranks must count from 0 without gaps")
    model = pb.ModelProto()
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        model.pieces.add(piece=token.decode("latin-1").translate(TABLE), score=-float(rank), type=pb.ModelProto.SentencePiece.NORMAL)
    model.pieces.add(piece="⁇unknown", score=0.0, type=pb.ModelProto.SentencePiece.UNKNOWN)
    t = model.trainer_spec
    t.model_type, t.vocab_size, t.unk_piece, t.unk_id = pb.TrainerSpec.BPE, len(model.pieces), "⁇unknown", len(ranks)
    t.bos_id = t.eos_id = t.pad_id = -1
    n = model.normalizer_spec
    n.name, n.add_dummy_prefix, n.remove_extra_whitespaces, n.escape_whitespaces = "identity", False, False, False
    return model.SerializeToString()


class Codec:
    def __init__(self, data: bytes, pattern: str):
        self.ranks = read_ranks(data)
        self.tokens = [t for t, _ in sorted(self.ranks.items(), key=lambda x: x[1])]
        self.pieces = regex.compile(pattern)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(self.ranks))
        self.known: dict[str, tuple[int, str, bytes]] = {}
        self.short: dict[str, list[int]] = {}

    def ids(self, piece: str) -> list[int]:
        raw = piece.encode()
        rank = self.ranks.get(raw)
        return [rank] if rank is not None else self.model.encode(raw.decode("latin-1").translate(TABLE))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        known, more = self.short.get, out.extend
        for p in self.pieces.findall(text):
            more(known(p) or self._remember(p))
        return out

    def _remember(self, piece: str) -> list[int]:
        ids = self.ids(piece)
        if len(piece) <= LONG:
            if len(self.short) >= REMEMBERED:
                self.short.clear()
            self.short[piece] = ids
        return ids

    def piece(self, piece: str) -> tuple[int, str, bytes]:
        """Number of ids, ids as text, bytes decoded from the ids."""
        ids = self.ids(piece)
        out = len(ids), " ".join(map(str, ids)), self.decode(ids)
        if len(piece) <= LONG:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[piece] = out
        return out

    def digest(self, text: str) -> tuple[int, str, str]:
        known, piece = self.known.get, self.piece
        parts = [known(p) or piece(p) for p in self.pieces.findall(text)]
        ids = " ".join([p[1] for p in parts])
        return sum([p[0] for p in parts]), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(b"".join([p[2] for p in parts])).hexdigest()


@lru_cache(2)
def codec(name: str, pattern: str) -> Codec:
    """The worker's codec; name is the vocabulary as Spark distributed it."""
    with open(SparkFiles.get(name), "rb") as f:
        return Codec(f.read(), pattern)


def _distributed(df: DataFrame, vocabulary: str) -> str:
    df.sparkSession.sparkContext.addFile(vocabulary)
    return vocabulary.rpartition("/")[2]


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, n_tokens, round_trip): the ids of every whole text,
    and whether they decode to the text's bytes.

    Null and empty texts have no ids, null ids stay. Rows that repeat are encoded each, very
    long texts whole; an empty table gives no rows; other columns are not read.
    """
    name = _distributed(docs, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(name, pattern)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            ids = [c.encode(t) for t in texts]
            same = [c.decode(i) == t.encode() for i, t in zip(ids, texts)]
            yield pa.record_batch([b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(list(map(len, ids)), pa.int64()), pa.array(same, pa.bool_())], names=["doc_id", "ids", "n_tokens", "round_trip"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, round_trip boolean")


def decode_documents(encoded: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """(doc_id, text): the texts of (doc_id, ids); a null list gives an empty text, bytes that are
    no UTF-8 are replaced; rows that repeat are decoded each; an empty table gives no rows."""
    name = _distributed(encoded, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(name, pattern)
        for b in batches:
            texts = [c.decode(ids or []).decode("utf-8", "replace") for ids in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digest_documents(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of encoding every whole text and decoding its ids.

    ids_sha256 is of the decimal ids joined by one space, decoded_sha256 of the
    decoded bytes. Null texts count as empty, null ids stay; rows that repeat are encoded
    each, very long texts whole; an empty table gives no rows; other columns are not read.
    """
    name = _distributed(docs, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(name, pattern)
        for b in batches:
            n, ids, raw = zip(*(c.digest(t or "") for t in b.column(1).to_pylist())) if b.num_rows else ((), (), ())
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(raw, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
