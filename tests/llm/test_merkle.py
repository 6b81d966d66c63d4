import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from roomrank.llm import merkle
from roomrank.llm.queries import op11_merkle
from roomrank.llm.shared import table
from tests.llm.conftest import DOCS, LOWER, draw


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def up(nodes, arity):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i:i + arity]) for i in range(0, len(out[-1]), arity)])
    return out


def path(tree, i, arity):
    """Per level the digests before and after node i in its run."""
    out = []
    for low in tree[:-1]:
        run = low[i // arity * arity:][:arity]
        out.append((run[:i % arity], run[i % arity + 1:]))
        i //= arity
    return out


def brute(rows, arity=16, present=None):
    """rows: (doc_id, text, lang, source, n_chars); one result per row, as sorted tuples."""
    groups = {}
    for r in rows:
        now = present(r) if present else None
        groups.setdefault(r[3], []).append((r[0], leaf([r[0], r[3], r[2], r[4], r[1]]), None if now is None else leaf([r[0], r[3], r[2], r[4], now])))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[s] = up([x[1] for x in groups[s]], arity)
    top = up([trees[s][-1][0] for s in names], arity)
    out = []
    for k, s in enumerate(names):
        for i, (doc, own, now) in enumerate(groups[s]):
            steps = path(trees[s], i, arity) + path(top, k, arity)
            node = now or own
            for a, b in steps:
                node = h(*a, node, *b)
            root = top[-1][0]
            out.append((doc, own, trees[s][-1][0], root, h(*[x for a, b in steps for x in a + b]), node, node == root))
    return sorted(out, key=str)


def tampered(r):
    return r[1].translate(LOWER) if r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else None


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query_equals_brute_force(spark, sf_small):
    rows = [tuple(r) for r in table(spark, sf_small, "documents").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    want = brute(rows, present=tampered)
    assert got(op11_merkle(spark, sf_small)) == want
    assert 0 < sum(not r[-1] for r in want) < len(want)


@pytest.mark.parametrize("arity,height", [(2, 1), (2, 2), (3, 1), (16, 3)])
def test_trees_of_all_shapes(spark, arity, height):
    """Sources of 1 to 40 rows, so that last runs hold one node, superblocks are partial and tiers differ."""
    rng = random.Random(5)
    rows, i = [], 0
    for s, size in enumerate([1, 2, 3, 4, 5, 7, 8, 9, 16, 17, 27, 28, 40]):
        for _ in range(size):
            rows.append((i, " ".join(draw(rng, 4)).upper(), "en", None if s == 4 else f"s{s}", i % 7))
            i += rng.randrange(1, 4)
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    out = merkle.manifest(docs, merkle.tampered_text(docs), arity=arity, height=height)
    assert got(out) == brute(rows, arity, tampered)


def test_odd_texts(spark, odd_docs):
    rows = [tuple(r)[:5] for r in odd_docs.collect()]
    assert got(merkle.manifest(odd_docs, merkle.tampered_text(odd_docs))) == brute(rows, present=tampered)


def test_null_and_empty_source_and_fields(spark):
    rows = [(1, None, None, None, None), (2, "", "", "", 0), (3, "A", "en", "é", 1), (4, "B", "en", "z", 1), (2, "", "", "", 0)]
    docs = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], DOCS + ", n long, grp string, digest string")
    want = brute(rows)
    assert got(merkle.manifest(docs)) == want and all(r[-1] for r in want)


def test_one_row_and_no_rows(spark, no_docs):
    one = spark.createDataFrame([(7, "Text", "en", "s", 4)], DOCS)
    (row,) = got(merkle.manifest(one))
    assert row[1] == row[2] == row[3] and row[4] == h("") and row[6]
    assert merkle.manifest(no_docs).count() == 0


def test_any_change_of_a_row_is_seen(spark):
    rows = [(i, f"text {i}", "en", f"s{i % 3}", i) for i in range(60)]
    docs = spark.createDataFrame(rows, DOCS)
    out = merkle.manifest(docs, F.when(F.col("doc_id") == 17, F.lit("text 17 ")))
    assert [r.doc_id for r in out.collect() if not r.verified] == [17]
