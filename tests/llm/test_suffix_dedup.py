import hashlib
import random
from collections import Counter

import pytest
from conftest import DOCS, doc_rows

from roomrank.llm.queries import op8_suffix_dedup
from roomrank.llm.shared import table
from roomrank.llm.suffix_dedup import remove_repeats


def plain(rows, length):
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p:p + length]
            if w in seen:
                gone[p:p + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[d] = (len(b), sum(gone), sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest())
    return out


def result(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


@pytest.mark.parametrize("length, q, bucket_runs", [(100, 32, 50_000), (40, 12, 50_000), (40, 12, 0), (33, 32, 3)])
def test_equals_brute_force(spark, length, q, bucket_runs):
    rng = random.Random(length + bucket_runs)
    base = ["".join(rng.choice("ab cdé\n") for _ in range(400)) for _ in range(6)]
    rows = []
    for i in range(120):
        t = "".join(rng.choice(base)[a:a + rng.randint(10, 250)] for a in [rng.randint(0, 300) for _ in range(rng.randint(0, 6))])
        k = rng.random()
        rows.append((i, None if k > 0.95 else "x" * rng.randint(0, 700) if k < 0.1 else "ab" * rng.randint(0, 300) if k < 0.15 else t))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert result(remove_repeats(df, length=length, q=q, bucket_runs=bucket_runs)) == plain(rows, length)


def test_query(spark, sf_small):
    rows = [(r.doc_id, r.text) for r in table(spark, sf_small, "documents").collect()]
    assert result(op8_suffix_dedup(spark, sf_small)) == plain(rows, 100)


def test_text_longer_than_a_slice(spark):
    rng = random.Random(8)
    long_ = "".join(rng.choice("abcdefgh ") for _ in range(2_600_000))
    rows = [(0, long_[1_048_000:1_049_500]), (1, long_), (2, "new " * 5 + long_[2_097_000:2_097_400] + "end"), (3, long_[:300] + "x" + long_[:300])]
    assert result(remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))) == plain(rows, 100)


def test_odd_and_empty_tables(spark, odd_docs, no_docs):
    rows = remove_repeats(odd_docs).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in odd_docs.collect())
    assert remove_repeats(no_docs).count() == 0
    # the same row twice is one document: neither loses its text to the other
    twice = spark.createDataFrame(doc_rows([(4, "abcdefghij" * 7 + str(list(range(60)))), (4, "abcdefghij" * 7 + str(list(range(60))))]), DOCS)
    assert [r.n_removed for r in remove_repeats(twice).collect()] == [0, 0]
