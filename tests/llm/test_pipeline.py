import random

import corpus_pipeline
from cladeflow.llm.registry import ORACLES, QUERIES


def test_stages(spark, tmp_path):
    r = random.Random(2)
    word = lambda: "".join(r.choice(["an", "re", "tion", "er", "é"]) for _ in range(r.randint(1, 4)))
    texts = [" ".join(word() for _ in range(60)) for _ in range(100)]
    texts += ["".join(r.choice("#$%&XQZ") for _ in range(300)) for _ in range(10)]
    texts += [texts[0], texts[0] + " re", f'{" ".join(texts[20:30])} token = "{"9f86d081884c7d65" * 2}" {texts[2]}', None, ""]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)] + [(5, texts[5], "en", "s", 1)]
    other = " ".join(word() for _ in range(60))
    rows += [(6, other, "en", "s", 1), (7, texts[8], "en", "s", 1), (None, texts[9], "en", "s", 1)]  # ids of other texts, a copy under one of them
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 100), 0) for i in range(0, 110)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs
        if name != "packing":
            assert docs.columns == columns
    ids = lambda n: sorted((x.doc_id for x in seen[n].select("doc_id").collect()), key=lambda i: (i is None, i))
    assert not set(ids("quality")) & set(range(100, 110))
    known = lambda n: [i for i in ids(n) if i is not None]
    assert known("near_dedup") == sorted([*(set(known("quality")) - {110, 111, 8}), 6, 7])
    kept = {(x.doc_id, x.text) for x in seen["near_dedup"].collect()}
    assert {(5, texts[5]), (6, texts[6]), (6, other), (7, texts[7]), (7, texts[8]), (None, texts[9])} <= kept
    assert ids("secrets") == ids("near_dedup")
    clean = {x.doc_id: x for x in seen["secrets"].collect()}
    assert "[SECRET]" in clean[112].text and clean[112].n_chars == len(clean[112].text)
    assert clean[3].text == texts[3]
    assert {x.doc_id for x in seen["packing"].collect()} == set(clean)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == seen["packing"].count()


def test_registry():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 11))
    assert set(ORACLES) <= set(QUERIES)
