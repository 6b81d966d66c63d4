import zlib

import numpy as np
from pyspark.sql import functions as F

from roomrank.llm import quality, toxicity
from roomrank.llm.queries import op4_toxicity, op5_quality
from roomrank.llm.shared import table

SF = "/root/testdata/sf0.01"


def test_quality_on_the_held_out_fold(spark):
    rows = op5_quality(spark, SF).collect()
    assert len(rows) == table(spark, SF, "documents").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    label = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    held = [(r.predicted, label[r.doc_id]) for r in rows if r.held_out and r.doc_id in label]
    assert np.mean([p == q for p, q in held]) > 0.95
    assert np.mean([p for p, q in held if q == 1]) > 0.98


def test_quality_does_not_read_the_held_out_labels(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a = {r.doc_id: r.score for r in quality.classify(docs, labels).collect()}
    b = {r.doc_id: r.score for r in quality.classify(docs.repartition(5), flipped).collect()}
    assert max(abs(a[i] - b[i]) for i in a) < 1e-4


def test_context_sums_equal_brute_force():
    import pyarrow as pa

    texts = ["a b c a", None, "b b", "c"]
    index = quality.index_vectors()
    from roomrank.llm.bytes_text import flat

    want = np.zeros((quality.BUCKETS, quality.DIM), int)
    ids, bounds = quality._word_ids(*flat(pa.array(texts)))
    for t in range(len(texts)):
        w = ids[bounds[t]:bounds[t + 1]]
        for i in range(len(w)):
            for j in range(max(0, i - 2), min(len(w), i + 3)):
                if i != j:
                    want[w[i]] += index[w[j]]
    got = np.zeros_like(want)
    for b in quality._sum_contexts([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])]):
        got[b.column(0).to_numpy()] = np.stack([b.column(j + 1).to_numpy() for j in range(quality.DIM)], 1)
    assert (got == want).all()


def test_toxicity_finds_toxic_documents_and_leaves_clean_ones(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    got = {r.doc_id: r for r in toxicity.score(docs, toxicity.fit(docs, labels.where(fold != 0))).collect()}
    held = labels.where(fold == 0).collect()
    assert all(got[r.doc_id].toxic == bool(r.toxic) for r in held) or np.mean([got[r.doc_id].toxic == bool(r.toxic) for r in held]) > 0.95
    assert not any(got[r.doc_id].toxic for r in held if not r.toxic)
    rows = op4_toxicity(spark, SF).collect()
    assert len(rows) == docs.count() and all(0 <= r.severity <= 3 for r in rows)


def test_ordinal_regression_orders_grades():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 6)) < 0.4
    z = x @ np.array([2.0, 1.0, 0.5, -1.0, 0.0, 0.0]) + rng.logistic(size=4000)
    grade = (z > 1).astype(int) + (z > 2) + (z > 3)
    row, col = np.nonzero(x)
    w, t = toxicity.fit_ordinal(row, col, grade, 6, l2=0)
    assert np.allclose(w, [2, 1, 0.5, -1, 0, 0], atol=0.3) and np.allclose(t, [1, 2, 3], atol=0.3) and (np.diff(t) > 0).all()


def test_odd_and_empty_tables(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 0, 0), (3, 1, 1), (7, None, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    none = labels.where("false")
    for lab in (labels, none):
        q = quality.classify(odd_docs, lab).collect()
        t = toxicity.score(odd_docs, toxicity.fit(odd_docs, lab)).collect()
        assert len(q) == len(t) == odd_docs.count() and all(0 <= r.score <= 1 for r in q)
        assert all(r.held_out is not None for r in q)
        assert quality.classify(no_docs, lab).count() == toxicity.score(no_docs, toxicity.fit(no_docs, lab)).count() == 0
        assert quality.accepted(odd_docs, lab).columns == odd_docs.columns
