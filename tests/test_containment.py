"""Sequences inside longer ones."""

import random

import numpy as np

from cladeflow.operators import containment, kmers, sieve


def made(seed: int, letters: str = "ab") -> dict[int, str]:
    rng = random.Random(seed)
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 120))) for _ in range(60)]
    for t in texts[:40]:  # parts of others: beginnings, ends, middles; and copies
        p, q = sorted(rng.randint(0, len(t)) for _ in range(2))
        texts += [t[:q], t[p:], t[p:q], t]
    return dict(enumerate(texts + ["", "aaaaaa", "a" * 50, "a" * 51, "ä" * 7 + "𝒳" * 9, "ä" * 3 + "𝒳" * 4]))


def by_hand(texts: dict[int, str], k: int) -> set[int]:
    return {i for i, t in texts.items() if len(t) >= k and any(len(u) > len(t) and t in u for u in texts.values())}


def test_window_hashes_agree():
    text = "".join(random.Random(0).choice("abcd") for _ in range(500))
    for k in (3, 5, 24):
        for w, h in containment.levels(sieve.codes([text]), k):
            heads, tails = containment.ends([text[i : i + w] for i in range(0, len(h), 17)], k)
            assert (heads == h[::17]).all() and (tails == heads).all()


def test_contained_by_hand(spark):
    for seed, letters in ((1, "ab"), (2, "abcdefgh")):
        texts = made(seed, letters)
        df = spark.createDataFrame(list(texts.items()), "rid long, seq string")
        found = kmers.contained(df, 5)
        assert sorted(r.rid for r in found.collect()) == sorted(by_hand(texts, 5))
        assert "seq" not in found._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]  # no sequence is shuffled


def test_shared_beginnings_make_no_pairs(spark, monkeypatch):
    """All begin alike: what is compared by digest is what lies inside, and false alarms of full bitmaps change nothing."""
    rng = random.Random(3)
    texts = ["header" * 20 + "".join(rng.choice("acgt") for _ in range(rng.randint(10, 80))) for _ in range(300)]
    texts += [texts[0] + "tail", texts[1][:-1]]
    own = [t for t in texts if len(t) >= 24]
    heads, tails = containment.ends(own, 24)
    n, w = (np.array(x) for x in ([len(t) for t in own], [containment.width(len(t), 24) for t in own]))
    maps = []
    for x in (heads, containment.mixed(heads, n, tails)):
        bits = np.zeros((1 << sieve.BITS) // 8, np.uint8)
        for p in containment.PROBES:
            slot = (x * p >> containment.SHIFT).astype(np.int64)
            np.bitwise_or.at(bits, slot >> 3, np.uint8(1) << (slot & 7).astype(np.uint8))
        maps.append(bits)
    assert sorted(containment.inside(own, 24, set(w.tolist()), *maps)) == [(1, 0, len(texts[301])), (300, 0, len(texts[0]))]
    full = np.full((1 << sieve.BITS) // 8, 255, np.uint8)
    monkeypatch.setattr(sieve, "bitmap", lambda at: full)
    df = spark.createDataFrame(list(enumerate(texts[-40:])), "rid long, seq string")
    assert sorted(r.rid for r in kmers.contained(df, 24).collect()) == sorted(by_hand(dict(enumerate(texts[-40:])), 24))
