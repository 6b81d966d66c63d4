import random
import re

import pytest

from roomrank.llm import license_scan
from roomrank.llm.queries import op12_license_scan
from roomrank.llm.shared import table
from tests.llm.conftest import DOCS, LOWER, doc_rows, draw

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text, templates=license_scan.TEMPLATES, percent=license_scan.PERCENT, block=license_scan.BLOCK):
    ws = WORD.findall((text or "").translate(LOWER))
    places, base = [], set()
    for phrase, label in license_scan.PHRASES.items():
        p = phrase.split()
        found = [i for i in range(len(ws)) if ws[i:i + len(p)] == p]
        places += found
        base |= {label} if found else set()
    labels, score = set(base), 1.0 if base else 0.0
    sets = [(label, set(license_scan.template_words(t))) for label, t in templates]
    for s in range(0, max(len(ws) - block // 2, 1), block // 2):
        own = set(ws[s:s + block])
        for label, t in sets:
            shared = len(own & t)
            if 100 * shared >= percent * len(t):
                labels.add(label)
                score = max(score, shared / len(t))
    return (len(ws), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def want(rows, **kw):
    return sorted(((r[0], *brute(r[1], **kw)) for r in rows), key=str)


def test_query_equals_brute_force(spark, sf_small):
    rows = [tuple(r) for r in table(spark, sf_small, "documents").select("doc_id", "text").collect()]
    assert got(op12_license_scan(spark, sf_small)) == want(rows)


def test_odd_texts(spark, odd_docs, no_docs):
    rows = [tuple(r)[:2] for r in odd_docs.collect()]
    assert got(license_scan.scan(odd_docs)) == want(rows)
    assert license_scan.scan(no_docs).count() == 0


@pytest.mark.parametrize("percent", [50, 75, 90, 100])
def test_random_blocks_of_template_words(spark, percent):
    """Texts drawn from the templates' own words: many near misses on every filter."""
    rng = random.Random(percent)
    vocabulary = sorted({w for _, t in license_scan.TEMPLATES for w in license_scan.template_words(t)})
    texts = []
    for _ in range(60):
        _, t = rng.choice(license_scan.TEMPLATES)
        ws = [w for w in license_scan.template_words(t) if rng.random() < 0.9]
        rng.shuffle(ws)
        texts.append(" ".join(draw(rng, rng.randrange(90)) + ws + rng.choices(vocabulary, k=rng.randrange(40)) + draw(rng, rng.randrange(90))))
    rows = doc_rows(texts)
    docs = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], DOCS + ", row string, block long, label string")
    assert got(license_scan.scan(docs, percent=percent)) == want([r[:2] for r in rows], percent=percent)


def test_base_places_and_letters(spark):
    texts = ["CC BY cc-by cc.by", "ccby cc", "CcK by", "cc by", "K mit", "ALL rights\nreserved; all RIGHTS reserved all rights",
             "General  Public--License general public é license", "İ cc by İ", "straße all rights reserved"]
    rows = doc_rows(texts)
    assert got(license_scan.scan(spark.createDataFrame(rows, DOCS))) == want([r[:2] for r in rows])


def test_any_stretch_of_half_a_block_lies_in_one_block(spark):
    rng = random.Random(1)
    label, notice = max(license_scan.TEMPLATES, key=lambda t: len(t[1]))
    texts = [" ".join(draw(rng, k) + notice.split() + draw(rng, 70)) for k in range(0, 70, 3)]
    out = license_scan.scan(spark.createDataFrame(doc_rows(texts), DOCS)).collect()
    assert all(label in r.labels.split(",") and r.score == 1 for r in out)


def test_templates_that_do_not_fit_are_refused(spark, no_docs):
    with pytest.raises(ValueError, match="templates must have"):
        license_scan.scan(no_docs, templates=[("x", "word " * 33)])
