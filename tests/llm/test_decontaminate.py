import random
import re

import numpy as np
from conftest import draw

from roomrank.llm import decontaminate as dc
from roomrank.llm.queries import op9_decontaminate
from roomrank.llm.shared import table


def plain(t):
    return " " + " ".join(re.findall(r"[^\W\d_]+", (t or "").lower())) + " "


def test_query_finds_every_verbatim_item(spark):
    sf = "/root/testdata/sf0.01"
    docs, items = table(spark, sf, "documents").collect(), table(spark, sf, "benchmark").collect()
    want = {(d.doc_id, i.item_id) for d in docs for i in items if plain(i.text) in plain(d.text)}
    out = op9_decontaminate(spark, sf).collect()
    got = {(r.doc_id, r.item_id) for r in out}
    assert want <= got and len(got - want) <= 0.02 * len(got)


def words_of(rng, n):
    """Words of letters only."""
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n)]


def test_paraphrases_and_answers(spark):
    rng = random.Random(7)
    items = [(i, " ".join(words_of(rng, rng.randint(12, 60))) + ". " + " ".join(words_of(rng, 6)) + ".") for i in range(60)]
    rows, leaks, clean = [], set(), set()
    for i in range(600):
        w, k = words_of(rng, rng.randrange(200)), rng.random()
        if k < 0.3:
            item = rng.randrange(60)
            x = items[item][1].split()
            kind = rng.random()
            if kind < 0.4:  # every tenth word changed, upper case
                x = [y.upper() if j % 10 else "other" for j, y in enumerate(x)]
                leaks.add((i, item))
            elif kind < 0.7:
                leaks.add((i, item))
            else:  # without its answer
                x = x[:-6]
                clean.add((i, item))
            w = w + x + words_of(rng, rng.randrange(150))
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (512, 25):
        got = {(r.doc_id, r.item_id) for r in dc.search(docs, bench, block=block).collect()}
        assert len(got & leaks) >= 0.95 * len(leaks) and not got - leaks and not got & clean


def test_candidates_recall_against_brute_force(spark):
    """The latent search opens nearly every passage that the checks alone would accept."""
    sf = "/root/testdata/sf0.01"
    docs, bench = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    fitted = dc.fit(docs, bench)
    got = {(r.doc_id, r.item_id) for r in dc.search(docs, bench, fitted=fitted).collect()}
    every = {(r.doc_id, r.item_id) for r in dc.search(docs, bench, fitted=fitted, cosine=-2.0).collect()}
    assert got <= every and len(got) >= 0.95 * len(every)


def test_item_in_a_third_of_the_documents_and_item_of_common_words(spark):
    """Held against plain text search, which knows no weights."""
    rng = random.Random(5)
    common = sorted(set(words_of(rng, 200)))
    items = [(i, " ".join(words_of(rng, 30)) + ". " + " ".join(words_of(rng, 6)) + ".") for i in range(30)]
    items.append((30, " ".join(rng.choice(common) for _ in range(34)) + ". " + " ".join(rng.choice(common) for _ in range(6)) + "."))
    items.append((31, " ".join(rng.choice(common) for _ in range(9)) + "."))
    rows = []
    for i in range(600):
        w = words_of(rng, rng.randrange(60)) + [rng.choice(common) for _ in range(100)]
        held = [0] if i % 3 == 0 else []
        held += [30] if i % 40 == 1 else []
        held += [31] if i % 50 == 2 else []
        held += [rng.randrange(1, 30)] if i % 20 == 4 else []
        at = rng.randrange(len(w) + 1)
        w[at:at] = [x for k in held for x in items[k][1].split()]
        rows.append((i, " ".join(w)))
    want = {(i, k) for i, t in rows for k, x in items if plain(x) in plain(t)}
    assert sum(k == 0 for _, k in want) == 200
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = dc.search(docs, bench).collect()
    got = {(r.doc_id, r.item_id) for r in out}
    assert want <= got and not {x for x in got - want if x[1] != 31}
    assert len(out) == len(got) and all(0 < r.cosine < 1.001 for r in out)
    only = spark.createDataFrame(items[:1], "item_id long, text string")  # nothing has a place in the latent space
    assert {r.doc_id for r in dc.clean(docs, only).collect()} == {i for i, _ in rows} - {i for i, k in want if k == 0}


def test_items_without_letters(spark):
    """Held against plain text search with word borders."""
    rng = random.Random(11)
    items = [(1, "17 * 3 = 51"), (2, "1 2 4 8 16 32 64 128"), (3, "42"), (4, "..."), (4, " ".join(str(rng.randrange(10 ** 6)) for _ in range(300))), (None, "3 + 4 = 7")]
    rows = [(0, "it is so: 17 * 3 = 51. and more"), (1, "117 * 3 = 51"), (2, "17 * 3 = 510"), (3, "(1 2 4 8 16 32 64 128) 17 *\n3  = 51"), (4, "42"),
            (5, "there were 42 of them ..."), (6, "17 * 3"), (7, "= 51 17 * 3"), (8, "x " + items[4][1] + " y"), (9, None), (10, "..."), (11, "3 + 4 = 7 3 + 4 = 7")]
    want = {(0, 1), (3, 1), (3, 2), (4, 3), (8, 4), (11, None)}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for more in ([], [(9, " ".join(words_of(rng, 20)) + ".")]):  # alone, and beside an item of words
        both = bench.union(spark.createDataFrame(more, "item_id long, text string")) if more else bench
        for block in (512, 2):
            out = dc.search(docs, both, block=block).collect()
            assert {(r.doc_id, r.item_id) for r in out} == want and len(out) == len(want)
        assert {r.doc_id for r in dc.clean(docs, both).collect()} == {i for i, _ in rows} - {i for i, _ in want}
    starts = {r.doc_id: r.region_start for r in dc.search(docs, bench).collect() if r.item_id == 1}
    assert starts == {0: 3, 3: 0}


def test_run_hash_is_of_the_run_alone():
    rng = np.random.default_rng(3)
    h = rng.integers(0, 6, 400).astype(np.uint64)
    for size in (1, 2, 3, 7, 8, 13, 64, 300, 400, 401):
        got = dc.run_hash(h, size)
        assert len(got) == max(0, 401 - size)
        runs = [tuple(h[k:k + size].tolist()) for k in range(len(got))]
        assert len(set(zip(runs, got.tolist(), strict=True))) == len(set(runs)) == len(set(got.tolist()))
        assert all(dc.run_hash(h[k:k + size], size)[0] == got[k] for k in range(0, len(got), 37))


def test_common_subsequence():
    rng = random.Random(1)
    for _ in range(200):
        a, b = [[rng.randrange(6) for _ in range(rng.randrange(1, 40))] for _ in range(2)]
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1, j + 1] = t[i, j] + 1 if a[i] == b[j] else max(t[i, j + 1], t[i + 1, j])
        masks = {}
        for i, x in enumerate(a):
            masks[x] = masks.get(x, 0) | 1 << i
        assert dc.common_subsequence(masks, len(a), b) == t[-1, -1]


def test_odd_and_empty_tables(spark, odd_docs, odd_texts, no_docs):
    rng = random.Random(2)
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "123 !!"), (4, " ".join(draw(rng, 20))), (4, "die antwort ist"), (None, "one")], "item_id long, text string")
    texts = [t[1] if isinstance(t, tuple) else t for t in odd_texts]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, item_id string")
    out = dc.search(docs, bench).collect()
    assert 3 in {r.doc_id for r in out} and {r.item_id for r in out} <= {4, None}
    left = dc.clean(docs, bench)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(set(range(len(texts))) - {r.doc_id for r in out})
    assert dc.search(docs, bench.where("false")).count() == 0 and dc.search(no_docs, bench).count() == 0
    assert dc.clean(odd_docs, bench.where("false")).count() == odd_docs.count()
    assert dc.clean(odd_docs, bench).count() < odd_docs.count()
