"""Operator 10: BPE encoding with a queue of merge ranks, and decoding by concatenated vocabulary strings.

Null texts count as empty: no ids, hashes of the empty string.  Repeated rows give repeated rows; ids pass through,
null too; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .bpe import Bpe, space_chunks
from .common import Generations, per_worker, released


def _chunks_of(bpe: Bpe):
    def entry(chunk: bytes) -> tuple[bytes, bytes, int]:
        ids = bpe.encode(chunk.decode("utf-8", "replace"))
        text = bpe.decode(ids)
        return ",".join(map(str, ids)).encode(), chunk if text == chunk else text, len(ids)

    return Generations(entry, bpe.limit)


def _digest_memo(vocab_path: str, memo: int):
    bpe = Bpe(vocab_path, memo)
    return bpe, _chunks_of(bpe)


def encode(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", memo: int = 300_000) -> DataFrame:
    """``(id, ids array<int>)``, as the library encodes without added special tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe(vocab_path, memo)
        known = Generations(lambda c: bpe.encode(c.decode("utf-8", "replace")), memo)
        for batch in batches:
            out = []
            for data in batch.column(1).to_pylist():
                out.append([i for c in space_chunks(data or b"") for i in known[c]])
                known.trim()
            bpe.trim()
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(out, pa.list_(pa.int32()))], names=["id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(lambda batches: released(run(batches)), "id long, ids array<int>").withColumnRenamed("id", id_col)


def decode(rows: DataFrame, vocab_path: str, id_col: str = "doc_id") -> DataFrame:
    """``(id, text)`` from ``(id, ids)``; null ids give the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe(vocab_path, 1)
        for batch in batches:
            texts = [bpe.decode(ids or []).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(texts, pa.string())], names=["id", "text"])

    return rows.select(F.col(id_col).cast("long").alias("id"), "ids").mapInArrow(lambda batches: released(run(batches)), "id long, text string").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", memo: int = 500_000) -> DataFrame:
    """Encode and decode in one pass, keeping only digests of both: ``(id, n_tokens, ids_sha256, decoded_sha256)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, known = per_worker(_digest_memo, vocab_path, memo)
        for batch in batches:
            n_tokens, of_ids, of_text = [], [], []
            for data in batch.column(1).to_pylist():
                entries = list(map(known.__getitem__, space_chunks(data or b"")))
                n_tokens.append(sum([e[2] for e in entries]))
                of_ids.append(hashlib.sha256(b",".join([e[0] for e in entries])).hexdigest())
                of_text.append(hashlib.sha256(b"".join([e[1] for e in entries]).decode("utf-8", "replace").encode()).hexdigest())
                known.trim()
            bpe.trim()
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(lambda batches: released(run(batches)), "id long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)


def op10_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
