from collections import Counter

import numpy as np
from conftest import WORD

from roomrank.llm import rules
from roomrank.llm.queries import op7_quality_rules
from roomrank.llm.shared import table


def plain(text):
    t = text or ""
    w = WORD.findall(t)
    seen, dup, lines = set(), 0, 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
            lines += 1
    windows = [tuple(w[j:j + 8]) for j in range(len(w) - 7)]
    count, covered = Counter(windows), set()
    for j, x in enumerate(windows):
        if count[x] > 1:
            covered.update(range(j, j + 8))
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(covered), lines


def check(rows, texts):
    for r in rows:
        want = plain(texts[r.doc_id]) if r.doc_id in texts else None
        if want:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want[:5], r.doc_id
            assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept)


def test_query_equals_brute_force(spark, sf_small):
    texts = {r.doc_id: r.text for r in table(spark, sf_small, "documents").collect()}
    rows = op7_quality_rules(spark, sf_small).collect()
    assert len(rows) == len(texts)
    check(rows, texts)


def test_verdicts_follow_the_labels():
    import duckdb

    from roomrank.session import get_spark

    sf = "/root/testdata/sf0.01"
    kept = {r.doc_id: r.kept for r in op7_quality_rules(get_spark(), sf).collect()}
    labels = duckdb.sql(f"select doc_id, quality from '{sf}/labels.parquet' join '{sf}/documents.parquet' using (doc_id) where n_chars > 400").fetchall()
    assert np.mean([kept[i] for i, q in labels if q == 1]) > 0.97
    assert np.mean([not kept[i] for i, q in labels if q == 0]) > 0.9


def test_sketch_quantiles(spark):
    rng = np.random.default_rng(2)
    v = np.concatenate([rng.lognormal(0, 2, 5000), np.zeros(700)])
    df = spark.createDataFrame([(float(x), "g") for x in v], "ratio double, lang string")
    q = rules.quantiles(rules.sketch(df, ["lang"], ["ratio"]), ["lang"], [0.05, 0.5, 0.9]).first()
    want = np.sort(v)[np.ceil(np.array([0.05, 0.5, 0.9]) * len(v)).astype(int) - 1]
    assert q.n == len(v) and q.q[0] == 0 and np.allclose(q.q[1:], want[1:], rtol=0.05)


def test_small_groups_use_the_merged_sketch(spark):
    rows = [(i, "word " * 30 + ("# " * (i % 3)), "en", "big", 0) for i in range(400)] + [(900, "word " * 30 + "# " * 100, "en", "small", 0)]
    out = {r.doc_id: r for r in rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    assert "symbol_ratio" in out[900].failed


def test_source_with_much_junk(spark):
    rows = [(1000 * s + i, " ".join(f"w{i}x{j}" + "###" * (s == 0 and i % 10 < 3) for j in range(40)) + " #" * (i % 3), "en", f"s{s}", 0)
            for s in range(4) for i in range(300)]
    out = rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()
    assert {r.doc_id for r in out if not r.kept} == {i for i in range(300) if i % 10 < 3}


def test_odd_and_empty_tables(spark, odd_docs, no_docs):
    rows = rules.judge(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    once = Counter(r.doc_id for r in odd_docs.collect())
    check(rows, {r.doc_id: r.text for r in odd_docs.collect() if once[r.doc_id] == 1})
    assert all(not r.kept for r in rows if not r.n_words) and rules.judge(no_docs).count() == 0
