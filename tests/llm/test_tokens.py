import hashlib
import random
import time
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers as public
import pytest
from tokenizers import Tokenizer

from cladeflow.llm import bpe, bpe_codec, packing, token_counts

WORD, BYTE = public.path("word_bpe_49k.json"), public.path("byte_bpe_50k.json")
ODD = ["", " ", "  a  b ", "it's <|endoftext|> don't<|endoftext|>", "ΑΣ Σ İI", "a\x1cb ,\x1c", "日本語 123", "é x́", "'S I'LL", "\n\n x\t\ty  ", "ﬁ ß ẞ", "foo!!bar ### a_b ^ ]", "<|startoftext|>hi", "x" * 400, "é\xa0 x　 y"]


def texts():
    r = random.Random(3)
    return ODD + ["".join(r.choice("ab'sSTrevΣé \n\t \x1c,.!1２日<|>_́") for _ in range(r.randint(0, 40))) for _ in range(1500)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash") for i, t in enumerate(texts())] + [(None, "no id", "x"), (3, ODD[3], "x"), (10**6, None, None), (10**6 + 1, "the quick fox " * 3000, None)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").repartition(3)



def test_merge_queue_and_prefix_tables_match_the_library():
    for path in (WORD, BYTE):
        own = bpe.Bpe(path)
        for t in texts():
            want = own.library.encode(t, add_special_tokens=False).ids
            cut = t.encode().split() if path == WORD else bpe.space_chunks(t.encode())
            assert [i for c in cut for i in own.encode(c.decode())] == want
            if path == WORD:
                assert sum(own.count(c.decode()) for c in cut) == len(want)
            else:
                assert own.decode(want).decode() == own.library.decode(want, skip_special_tokens=False)


def test_every_prefix_has_its_count():
    own = bpe.Bpe(WORD)
    r = random.Random(8)
    pieces = [*"ab'sSTrevlmdΣé \n\x1c,.!1２日本<|>_̸̣́̂각İßﬁ\xa0　", "<|endoftext|>", "'re", "é", "<|endof", "don't", "각"]
    made = ["".join(r.choice(pieces) for _ in range(r.randint(0, 14))) for _ in range(3000)]
    for t in ["internationalisation of the don't", "thntblere of, ABC!! été 12", "ΑΣΣ x", *ODD, *made]:
        assert own.prefix_table(t) == [len(own.library.encode(t[:i], add_special_tokens=False).ids) for i in range(len(t) + 1)]


def test_long_runs_cost_in_proportion():
    own = bpe.Bpe(WORD)
    n = lambda t: len(own.library.encode(t, add_special_tokens=False).ids)
    for t in ["日本語処理"[: k % 5 + 1] * 2000 for k in range(2)] + ["x" * 10_000, "!" * 10_000, "é" * 3000]:
        begin = time.perf_counter()
        table = own.prefix_table(t)
        assert time.perf_counter() - begin < 10  # with every prefix counted anew it would be minutes
        assert all(table[i] == n(t[:i]) for i in (0, 1, 2, 777, len(t) // 2, len(t)))


def test_token_counts(spark, docs):
    rows, df = docs
    tok = Tokenizer.from_file(WORD)
    n = lambda t: len(tok.encode(t, add_special_tokens=False).ids)
    text = {r[0]: r[1] or "" for r in rows}
    for limit in (0, 9, 60):
        got = token_counts.token_counts(df, WORD, limit=limit).collect()
        assert len(got) == len(rows)
        for r in got:
            t = text[r.doc_id]
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n(t), n(t) > limit)
            if len(t) < 1000:
                assert r.fit_chars == max(i for i in range(len(t) + 1) if n(t[:i]) <= limit)
            else:
                assert n(t[: r.fit_chars]) <= limit < n(t[: r.fit_chars + 1])
    assert token_counts.token_counts(df.limit(0), WORD).count() == 0


def test_stored_tables_answer_any_budget(spark, docs):
    rows, df = docs
    tok = Tokenizer.from_file(WORD)
    n = lambda t: len(tok.encode(t, add_special_tokens=False).ids)
    text = {r[0]: r[1] or "" for r in rows}
    stored = token_counts.prefix_tables(df, WORD)
    for r in token_counts.fitting(stored, [1, 5, 10**6]).collect():
        t = text[r.id]
        assert r.n_tokens == n(t) and r["fit_1000000"] == len(t)
        if len(t) < 100:
            assert [r.fit_1, r.fit_5] == [max(i for i in range(len(t) + 1) if n(t[:i]) <= k) for k in (1, 5)]
    for r in token_counts.counts_at(stored, 7).collect():
        if r.chars < 100:
            assert r.n_tokens == n(text[r.id][: r.chars])


def test_encode_decode_and_digests(spark, docs):
    rows, df = docs
    text = {r[0]: r[1] or "" for r in rows}
    tok = Tokenizer.from_file(BYTE)
    for r in bpe_codec.digests(df, BYTE).collect():
        ids = tok.encode(text[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    back = {r.doc_id: r.text for r in bpe_codec.decode(bpe_codec.encode(df, BYTE), BYTE).collect()}
    assert back == text
    assert bpe_codec.digests(df.limit(0), BYTE).count() == 0


def test_packing(spark, docs):
    rows, df = docs
    got = packing.pack(df, WORD, size=64).toPandas()
    tok = Tokenizer.from_file(WORD)
    assert (got["offset"] + got["length"] <= 64).all()
    q = got.sort_values(["sequence_id", "offset"])
    assert (q.groupby("sequence_id")["length"].cumsum() - q["length"] == q["offset"]).all()
    total = q.groupby("sequence_id")["length"].sum()
    assert sorted(total.index) == list(range(len(total)))
    assert total.sum() / (64 * len(total)) > 0.9  # sequences as short as this leave more over
    text = {r[0]: r[1] or "" for r in rows}
    assert got["length"].sum() == sum(len(tok.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in rows)
    for r in got[got["doc_id"].notna()].itertuples():
        ids = tok.encode(text[int(r.doc_id)], add_special_tokens=False).ids + [1]
        assert r.doc_tokens == len(ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    assert packing.pack(df.limit(0), WORD).count() == 0


def test_histogram_packing_places_every_piece_once():
    r = random.Random(1)
    counts = {n: r.randint(1, 50) for n in r.sample(range(1, 100), 60)}
    patterns = packing.pack_histogram(counts, 100)
    placed: dict[int, int] = {}
    for n, pattern in patterns:
        assert sum(length * times for length, times in pattern) <= 100
        for length, times in pattern:
            placed[length] = placed.get(length, 0) + n * times
    assert placed == counts


def test_worker_lets_go_of_one_object_before_it_makes_another():
    import weakref

    from cladeflow.llm.common import per_worker

    class Memo:
        pass

    made = []

    def make(name):
        assert not [r for r in made if r() is not None]
        made.append(weakref.ref(memo := Memo()))
        return memo

    assert per_worker(make, "a") is per_worker(make, "a") and len(made) == 1
    per_worker(make, "b")
    assert len(made) == 2


def test_packing_holds_little_beside_its_texts():
    import tracemalloc

    import numpy as np

    from cladeflow.llm.packing import gather

    n = 1 << 20
    index = np.zeros(n, np.int32)
    tracemalloc.start()
    got = gather(np.arange(4, dtype="<u4"), np.array([1]), np.array([2]), index)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got[:4].tolist() == [1, 2, 1, 2] and len(got) == 2 * n and peak < 56 * n


def test_encoder_asks_for_few_encodings_at_once():
    """An encoding weighs much more than its ids: chunks of a slice that are no plain words go to the library in parts."""
    vocab = public.path("word_bpe_49k.json")
    encoder = packing.WordEncoder(vocab)
    library, asked = encoder.library, []

    class Counting:
        def encode_batch_fast(self, texts, **more):
            asked.append(len(texts))
            return library.encode_batch_fast(texts, **more)

    encoder.library = Counting()
    texts = [" ".join(f"x{i}y{i} word{'ab'[i % 2]}" for i in range(n)) for n in (0, 1, 2_500)] + ["", "Ein été, (so) 中文 a²"]
    got = [np.frombuffer(ids, "<u4").tolist() for ids in encoder(pa.array(texts, pa.string()))]
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert max(asked) <= 1_000
