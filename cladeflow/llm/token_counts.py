"""Operator 3: exact token counts at every prefix, by dynamic programming.

``prefix_tables`` stores, for every text, the token count at each of its prefixes; ``totals``, ``fitting`` and
``counts_at`` answer from that table, for any budget, and encode nothing.  Counts are kept as steps, a signed byte a
code point: a count can fall where a prefix completes a token, and one code point adds a few tokens at most.

Empty and null texts have 0 tokens; repeated rows give repeated rows; ids pass through, null too; other columns are
not read.  A text is worked on as a whole, in memory in proportion to it; a single run without white space costs in
proportion to its length (what normalising joins into one character, to the square of its code points).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .bpe import Bpe
from .common import Generations, per_worker, released, write_table

STORED = "id long, n_bytes long, steps binary"
BLANKS = bytes.maketrans(b"\t\n\v\f\r", b"     ")


def _memo(vocab_path: str, memo: int) -> tuple[Bpe, Generations]:
    bpe = Bpe(vocab_path, memo)
    return bpe, Generations(lambda chunk: bpe.steps(chunk.decode("utf-8", "replace")), memo)


def prefix_tables(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", memo: int = 500_000) -> DataFrame:
    """``(id, n_bytes, steps)``, written: the prefix of i code points has as many tokens as the first i steps add up to.

    For vocabularies that drop white space: no token reaches over it, so a text's table is its chunks' tables, which
    are memoised, with a step of 0 for each blank.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, steps_of = per_worker(_memo, vocab_path, memo)
        for batch in batches:
            sizes, steps = [], []
            for data in batch.column(1).to_pylist():
                data = data or b""
                sizes.append(len(data))
                steps.append(b"\0".join(map(steps_of.__getitem__, data.translate(BLANKS).split(b" "))))
                steps_of.trim()
            bpe.trim()
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(steps, pa.binary())], names=["id", "n_bytes", "steps"])

    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return write_table(plain.mapInArrow(lambda batches: released(run(batches)), STORED), "prefixes")


def _answered(stored: DataFrame, names: list[str], answer: Callable[[np.ndarray], tuple[int, ...]]) -> DataFrame:
    """Stored rows with ``names``, from the running counts of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [answer(np.cumsum(np.frombuffer(x, np.int8), dtype=np.int64)) for x in batch.column(2).to_pylist()]
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *[pa.array(c, pa.int64()) for c in cols]], names=["id", "n_bytes", *names])

    return stored.select("id", "n_bytes", "steps").mapInArrow(lambda batches: released(run(batches)), ", ".join(["id long", "n_bytes long", *[f"{n} long" for n in names]]))


def longest(counts: np.ndarray, limit: int) -> int:
    """The longest prefix, in code points, with at most ``limit`` tokens."""
    fits = np.flatnonzero(counts <= limit)
    return int(fits[-1]) + 1 if len(fits) else 0


def fitting(stored: DataFrame, limits: list[int]) -> DataFrame:
    """``(id, n_bytes, n_tokens, fit_<limit>...)`` for any list of budgets: the longest prefixes that keep them."""
    names = ["n_tokens", *[f"fit_{k}" for k in limits]]
    return _answered(stored, names, lambda counts: (int(counts[-1]) if len(counts) else 0, *[longest(counts, k) for k in limits]))


def counts_at(stored: DataFrame, every: int) -> DataFrame:
    """``(id, chars, n_tokens)`` at every so many code points, and at the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts = np.cumsum(np.frombuffer(x, np.int8), dtype=np.int64)
                ends = np.unique(np.r_[np.arange(every, len(counts), every), len(counts)])
                n = counts[ends - 1] if len(counts) else np.zeros(1, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(ends), pa.int64()), pa.array(ends, pa.int64()), pa.array(n, pa.int64())], names=["id", "chars", "n_tokens"])

    return stored.select("id", "steps").mapInArrow(lambda batches: released(run(batches)), "id long, chars long, n_tokens long")


def token_counts(docs: DataFrame, vocab_path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: bytes, tokens, whether tokens exceed ``limit``, and ``fit_chars``: the longest prefix, in code points,
    that has at most ``limit`` tokens (a prefix counts as a text of its own).  All from the stored prefix tables."""
    found = fitting(prefix_tables(docs, vocab_path, id_col, text_col), [limit])
    return found.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), F.col(f"fit_{limit}").alias("fit_chars"))


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
