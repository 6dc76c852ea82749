import random

import numpy as np
from pyspark.sql import functions as F

from keyloom.llm import quality_rules as Q


def corpus(n=1200, seed=1):
    r = random.Random(seed)
    words = ["word%d" % i for i in range(2000)]
    docs, labels = [], []
    for i in range(n):
        w = [r.choice(words) for _ in range(r.randint(20, 200))]
        kind = r.randrange(8)
        if kind == 0:
            w = [x + "###" for x in w]
        elif kind == 1:
            w = [w[0]] * len(w)
        elif kind == 2:
            w = [x.upper() + "!!" for x in w]
        docs.append((i, " ".join(w)))
        labels.append((i, int(kind > 2), 0))
    return docs, labels


def test_learns_the_rules(spark):
    docs, labels = corpus()
    d = spark.createDataFrame([*docs, (5000, None), (5001, ""), (5002, "x")], "doc_id long, text string").withColumn("score", F.lit("clash"))
    lab = spark.createDataFrame([*labels, (None, 1, 0), (9999, None, 0), (8888, 1, 0)], "doc_id long, quality int, toxic int")
    out = Q.score_quality(d, lab).withColumn("held", Q.held_out(F.col("doc_id"))).collect()
    truth = {i: q for i, q, _ in labels}
    test = [r for r in out if r.held and r.doc_id in truth]
    assert len(test) > 200 and np.mean([r.predicted == truth[r.doc_id] for r in test]) > 0.97
    assert len(out) == len(docs) + 3 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)


def test_column_agrees_with_the_model(spark):
    rng = np.random.default_rng(0)
    x = rng.random((600, 3))
    y = ((x[:, 0] > 0.5) & (x[:, 1] < 0.4)).astype(float)
    m = Q.fit_rules(x, y, ["a", "b", "c"])
    assert len(m.rules) > 0 and np.mean((m.score(x) > 0.5) == y) > 0.97
    df = spark.createDataFrame([(i, (float(a), float(b), float(c))) for i, (a, b, c) in enumerate(x)], "i int, _q struct<a:double,b:double,c:double>")
    got = [r.s for r in df.select("i", m.column("_q").alias("s")).orderBy("i").collect()]
    assert np.allclose(got, m.score(x))


def test_without_labels(spark):
    d = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in Q.score_quality(d, none).collect()] == [0.5, 0.5]
    assert Q.score_quality(d.limit(0), none).count() == 0
