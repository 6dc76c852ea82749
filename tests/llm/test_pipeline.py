"""The pipeline's stages on a small table, each against a plain version of its decision."""

import zlib

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from keyloom.llm.pii_feistel import pseudonymise
from keyloom.llm.quality_rules import score_quality
from keyloom.llm.queries import PII_KEY
from keyloom.llm.simhash_lsh import content_words, similarity, word_shingles
from keyloom.llm.stock_packing import cuts
from keyloom.llm.tokens import vocabulary

from .test_decontaminate import brute as leaks

D = "/root/testdata/sf0.001"


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def near_groups(texts):
    ids = sorted(texts)
    sets = {i: word_shingles(content_words((texts[i] or "").encode())) for i in ids}
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and find(a) != find(b) and similarity(sets[a], sets[b]) >= 0.8:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {find(i) for i in ids}


def test_stages(spark, tmp_path):
    stages = dict(P.STAGES)
    assert list(stages) == ["quality", "near_dedup", "decontamination", "pii", "packing"]
    docs = spark.read.parquet(f"{D}/documents.parquet")
    after = {}
    for k, (name, f) in enumerate(P.STAGES):
        f(spark, docs, D).write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        if name != "packing":
            assert docs.columns == spark.read.parquet(f"{D}/documents.parquet").columns
        after[name] = (before, docs)
    before, kept = after["quality"]
    scored = score_quality(before, spark.read.parquet(f"{D}/labels.parquet")).where("predicted = 1")
    assert set(rows(kept)) == set(rows(scored)) and len(rows(kept)) < before.count()
    before, kept = after["near_dedup"]
    assert set(rows(kept)) == near_groups({i: r.text for i, r in rows(before).items()})
    before, kept = after["decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    bad = {i for i, v in leaks([(i, r.text) for i, r in rows(before).items()], items).items() if v[0][0]}
    assert bad and set(rows(kept)) == set(rows(before)) - bad
    before, kept = after["pii"]
    assert {i: r.text for i, r in rows(kept).items()} == {i: r.text for i, r in rows(pseudonymise(before, PII_KEY)).items()}
    assert all(r.n_chars == len(r.text) for r in kept.collect())
    before, packed = after["packing"]
    t = Tokenizer.from_file(vocabulary()["vocab"])
    want = []
    for i, r in rows(before).items():
        ids = np.array([*t.encode(r.text, add_special_tokens=False).ids, 0], "<u4")
        want += [(i, s, n, zlib.crc32(ids[s : s + n].tobytes()), len(ids)) for s, n in cuts(len(ids), 1024)]
    assert sorted((p.doc_id, p.start, p.length, p.ids_crc32, p.doc_tokens) for p in packed.collect()) == sorted(want)


def test_odd_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, cols in (("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], cols).write.parquet(str(tmp_path / f"{name}.parquet"))
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "documents.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0
    docs = spark.createDataFrame([(1, None, None, None, None), (None, "a b", "en", "s", 3), (2, "", None, "s", 0), (3, "x y z", "en", "s", 5), (3, "x y z", "en", "s", 5)], schema)
    for _, f in P.STAGES[1:4]:
        docs = f(spark, docs, str(tmp_path))
    assert sorted(map(str, (r.doc_id for r in docs.collect()))) == ["1", "3", "None"]


def test_near_dedup_keeps_different_texts_of_one_id(spark):
    words = [[f"{a}{k}" for k in range(40)] for a in "pqrstu"]
    texts = [" ".join(w) for w in words]
    near = " ".join([*words[0][:-1], "edited"])
    docs = [(1, texts[0]), (7, near), (7, texts[1]), (None, texts[2]), (None, texts[3]), (None, texts[3]), (None, near), (9, texts[4]), (9, texts[4]), (3, texts[5])]
    got = dict(P.STAGES)["near_dedup"](spark, spark.createDataFrame(docs, "doc_id long, text string").repartition(3), D)
    want = [(1, texts[0]), (7, texts[1]), (None, texts[2]), (None, texts[3]), (9, texts[4]), (3, texts[5])]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)


CLASHING = "_q _s _stay _digest _found _new _text _in _h score predicted n_replaced found stay docs root tid h digest node".split()


def test_every_document_and_column_is_kept(spark):
    """Different texts under one id or none are documents of their own; columns may have any name."""
    words = [f"w{k}" for k in range(900)]
    texts = [" ".join(words[100 * k : 100 * k + 90]) for k in range(6)]
    ids = [None, None, None, 7, 7, 8]
    near = texts[5].replace("w505", "x")
    data = [(i, t, "en", "web", len(t)) for i, t in [*zip(ids, texts, strict=True), (None, near), (7, texts[3])]]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    for c in CLASHING:
        docs = docs.withColumn(c, F.lit(c))
    for name, f in P.STAGES[:-1]:
        out = f(spark, docs, D)
        assert out.columns == docs.columns
        got = out.collect()
        assert all(r[c] == c for r in got for c in CLASHING), name
        if name == "near_dedup":
            assert sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in got) == sorted((i is None, i or 0, t) for i, t in zip(ids, texts, strict=True))
        elif name != "quality":
            assert sorted(r.text for r in got) == sorted(d[1] for d in data)
    assert {r.doc_id for r in P.packing(spark, docs, D).collect()} == {None, 7, 8}
