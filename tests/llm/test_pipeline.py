import zlib

import corpus_pipeline
import numpy as np
import pytest
from test_ngram_join import plain as components_of

from roomrank.llm.queries import END_ID, tokenizer_path
from roomrank.llm.shared import fresh_dir, table

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage left: name -> rows in the order of its files."""
    docs, out = table(spark, SF, "documents"), {}
    out["documents"] = docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        path = fresh_dir(spark, f"test-{name}")
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out[name] = docs.selectExpr("*", "_metadata.file_name f", "_metadata.row_index i").orderBy("f", "i").drop("f", "i").collect()
    return out


def test_quality(stages, spark):
    from roomrank.llm.queries import op5_quality

    good = {r.doc_id for r in op5_quality(spark, SF).collect() if r.predicted}
    assert sorted(r.doc_id for r in stages["quality"]) == sorted(good)
    label = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    kept = {r.doc_id for r in stages["quality"]}
    assert np.mean([d in kept for d, q in label.items() if q == 1]) > 0.98


def test_near_duplicates(stages):
    want = {c for _, _, c in components_of([(r.doc_id, r.text) for r in stages["quality"]])}
    assert sorted(r.doc_id for r in stages["near_duplicates"]) == sorted(want)


def test_decontamination(stages, spark):
    from test_decontaminate import plain

    items = [plain(r.text) for r in table(spark, SF, "benchmark").collect()]
    leak = {r.doc_id for r in stages["near_duplicates"] if any(x in plain(r.text) for x in items)}
    left = {r.doc_id for r in stages["decontamination"]}
    assert leak and not leak & left
    assert len(left) >= 0.99 * (len(stages["near_duplicates"]) - len(leak))


def test_mixing_and_tokens(stages, spark):
    import tokenizers

    from roomrank.llm import mixing

    before, mixed = stages["decontamination"], stages["mixing"]
    assert sorted(r.doc_id for r in mixed) == sorted(r.doc_id for r in before) and set(mixed) == set(before)
    at = {int(r.doc_id.split("-")[0]): (r.slot, r.place) for r in mixing.mix(
        spark.createDataFrame(before).selectExpr("concat(doc_id, '-', xxhash64(text)) doc_id", "source")).collect()}
    assert [r.doc_id for r in mixed] == sorted(at, key=at.get)
    tok, start, want = tokenizers.Tokenizer.from_file(tokenizer_path()), 0, []
    for r in mixed:
        ids = tok.encode(r.text, add_special_tokens=False).ids + [END_ID]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in stages["tokens"]) == sorted(want)


def test_columns_and_odd_tables(spark, odd_docs, no_docs):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for docs in (odd_docs, no_docs):
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns, name
            assert out.count() <= docs.count()
    for docs in (odd_docs, no_docs):
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()


def test_run(stages, spark):
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, SF).collect()) == sorted(r.doc_id for r in stages["tokens"])
