import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from roomrank.llm import token_files
from roomrank.llm.bytes_text import flat
from roomrank.llm.queries import END_ID, op2_token_files, tokenizer_path
from roomrank.llm.shared import fresh_dir, table

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def tok():
    return tokenizers.Tokenizer.from_file(tokenizer_path())


def expected(tok, rows):
    start, out = 0, []
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [END_ID]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_pieces_encode_as_whole_texts(tok):
    rng = random.Random(3)
    parts = ["a", "B", "é", "×", "ß", "'s", "'", "'ll", " ", "  ", "\n", "\r\n", "\t", "1", "42", ".", "!!", "\u00a0", "\u2028", "日本", "<|endoftext|>",
             "ö", "Ç", "😀", "_", "\x7f", "\x00", "÷"]
    enc = token_files.PieceEncoder(tokenizer_path())
    assert enc.by_piece
    for special in (True, False):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(4000)] + [None, "", " "]
        texts = texts if special else [(t or "").replace("<|endoftext|>", "") for t in texts]
        ids, n = enc.encode(*flat(pa.array(texts)))
        ends = np.cumsum(n)
        for t, a, b in zip(texts, ends - n, ends, strict=True):
            assert tok.encode(t or "", add_special_tokens=False).ids == ids[a:b].tolist(), repr(t)


def test_query_equals_brute_force(spark, sf_small, tok):
    docs = sorted((r.doc_id, r.text) for r in table(spark, sf_small, "documents").select("doc_id", "text").collect())
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in op2_token_files(spark, sf_small).collect())
    assert got == expected(tok, docs)


def test_odd_texts(spark, odd_docs, odd_texts, tok):
    got = token_files.token_table(spark, odd_docs, fresh_dir(spark, "t"), tokenizer_path(), END_ID).collect()
    assert len(got) == odd_docs.count()
    by_text = {}
    for r in odd_docs.collect():
        by_text.setdefault(r.doc_id, set()).add(expected(tok, [(0, r.text)])[0][2:])
    assert all((r.n_tokens, r.ids_crc32) in by_text[r.doc_id] for r in got)
    got.sort(key=lambda r: r.start)
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got]).tolist()[:-1]]
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))


def test_repeated_ids_stand_in_the_order_of_their_texts(spark, tok):
    rows = [(5, "b b b"), (5, None), (5, "a"), (3, "x y"), (5, "a"), (None, "z"), (5, "")]
    want = [(i, s, n, c) for i, s, n, c in expected(tok, sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")))]
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, _text string").repartition(1 + seed)
        got = token_files.token_table(spark, docs, fresh_dir(spark, "t"), tokenizer_path(), END_ID).collect()
        assert sorted([tuple(r) for r in got], key=lambda r: r[1]) == want


def test_empty_table(spark, no_docs):
    assert token_files.token_table(spark, no_docs, fresh_dir(spark, "t"), tokenizer_path(), END_ID).count() == 0


def test_files_are_flat_and_offsets_64_bit(spark, sf_small, tok):
    folder = fresh_dir(spark, "t")
    manifest = token_files.write_tokens(table(spark, sf_small, "documents"), folder, tokenizer_path(), END_ID).collect()
    local = folder.removeprefix("file:")
    local = "/" + local.lstrip("/")
    for r in manifest:
        off = np.memmap(f"{local}/{r.stem}.off", "<u8", "r")
        assert len(off) == r.n_docs + 1 and off[0] == 0 and off[-1] == r.n_tokens
        assert len(np.memmap(f"{local}/{r.stem}.bin", "<u2", "r")) == r.n_tokens
    assert [r.base for r in manifest] == np.cumsum([0, *[r.n_tokens for r in manifest]])[:-1].tolist()
