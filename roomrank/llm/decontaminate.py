"""9. Benchmark decontamination by latent semantic retrieval.

Words are runs of letters in lower case (A-Z and Latin-1). A passage is `SPAN` words of a document, one starting
every `STEP_WORDS` words. The vocabulary is that of the benchmark block at hand; a word's weight is its inverse
document frequency over all documents, above 0 for every word. The latent space leaves out words in more than
`max_share` of the documents; words outside the vocabulary count towards a passage's length only.

1. One pass counts document frequencies.
2. One pass multiplies the passage matrix A (passages x vocabulary, TF-IDF) with a test matrix made
   of random directions and random mixtures of the benchmark's own vectors, and back: A'(A W), summed
   per task and then over tasks. The Nystroem form of the randomised SVD gives the leading right
   singular vectors of A from it.
3. One pass projects every passage and compares it with every item of the block in the latent space
   (items in pieces as long as passages); candidates above a cosine that hold a quarter of a piece's
   weighted words are checked on the words at hand: the longest common subsequence of the
   item and the words around the passage must hold a share of the item, enough of the item's weighted
   words must be there, and its answer (the last sentence) must be there too.
4. Items with less than `POOR_SHARE` of their words in the latent space (leaked into many documents, or of common
   words only) are searched exactly in the same pass: all their words are counted in the words around each
   passage, and every place that can pass the checks is checked.

No text is shuffled. The benchmark is the query set: it is taken in blocks of `block` items, so what
is broadcast (vocabulary, basis, items) is bounded whatever its size.

5. Items without letters (figures, formulas) have no place in a space of words: they are searched by exact text in the
   same pass. Their words are runs between white space and `. , ; : ! ? ( ) [ ]` and quotes; an item is found where its words stand one after
   another, items of fewer than `LEAST_MARKS` words only in a document that has no other words.

Null and empty texts and items, and items of such signs only, hold and match nothing. Repeated documents and items are judged
each. Of ties of a text and item the best place counts, then the latest. Very long texts are taken a slice at a time, very long
items in pieces. Without items or documents the result is empty. Null ids stay null. Extra columns are ignored.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomrank.llm.bytes_text import NO_LETTER, SPACE, STEP, flat, folded, mix, ragged, slices, word_hashes, words

SPAN = 32
STEP_WORDS = 16
RANK = 64
MAX_SHARE = 0.03
POOR_SHARE = 0.25
CELLS = 1 << 22  # cells times words counted at once
COSINE = 0.15
PIECE_SHARE = 0.25
LCS_SHARE = 0.6
WEIGHT_SHARE = 0.6
ANSWER_SHARE = 0.6
BLOCK = 512
LEAST_MARKS = 3
BETWEEN = SPACE.copy()  # what stands between the words of items without letters
BETWEEN[list(b".,;:!?()[]\"'`")] = True


def item_words(text: str | None) -> np.ndarray:
    data, starts = flat(pa.array([text], pa.string()))
    ws, we, _ = words(data, starts, NO_LETTER)
    return word_hashes(folded(data), ws, we, lower=False) if len(ws) else np.zeros(0, np.uint64)


def answer_of(text: str) -> str:
    """The last sentence (all of a text with one)."""
    return ([s for s in re.split(r"[.!?\n]+", text) if any(c.isalpha() for c in s)] or [text])[-1]


def marks(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, hash) of the words between `BETWEEN`, and per text the first word's place (n + 1)."""
    ws, we, bounds = words(data, starts, BETWEEN)
    return ws, word_hashes(data, ws, we, lower=False) if len(ws) else np.zeros(0, np.uint64), bounds


def run_hash(h: np.ndarray, size: int) -> np.ndarray:
    """Fingerprint of each run of `size` words, by doubling: a run of 2 n words is made of two of n."""
    out, done, have = np.zeros(max(0, len(h) - size + 1), np.uint64), 0, h
    width, k = 1, 0
    while len(out):
        if size & width:
            out = mix(out ^ (have[done:done + len(out)] + STEP[k]))
            done += width
        if done == size:
            break
        have = mix(have[:-width] + mix(have[width:] ^ STEP[k + 32]))
        width, k = 2 * width, k + 1
    return out


class Items:
    """A block of benchmark items: their words, the block's vocabulary, and once fitted the weights and basis."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        got = [(i, item_words(t), item_words(answer_of(t)), t) for i, t in items if t]
        self.plain: dict[int, dict[int, list[int | None]]] = {}  # items without letters by their number of words and fingerprint
        for i, w, _, t in got:
            h = marks(*flat(pa.array([t], pa.string())))[1] if not len(w) else w[:0]
            if len(h):
                self.plain.setdefault(len(h), {}).setdefault(int(run_hash(h, len(h))[0]), []).append(i)
        got = [x for x in got if len(x[1])]
        self.ids = [x[0] for x in got]
        self.words = [x[1] for x in got]
        self.answers = [x[2] for x in got]
        self.vocab = np.unique(np.concatenate([np.zeros(0, np.uint64), *self.words]))
        self.maybe = np.zeros(1 << 16, bool)  # low bits of the vocabulary, to skip most lookups
        self.maybe[self.vocab & np.uint64(0xFFFF)] = True

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Place in the vocabulary, -1 outside."""
        out = np.full(len(h), -1, np.int32)
        at = np.flatnonzero(self.maybe[h & np.uint64(0xFFFF)])
        place = np.minimum(np.searchsorted(self.vocab, h[at]), len(self.vocab) - 1)
        ok = self.vocab[place] == h[at]
        out[at[ok]] = place[ok]
        return out

    def weigh(self, df: np.ndarray, n_docs: int, max_share: float) -> None:
        self.idf = np.log((1 + n_docs) / (1 + df)) + 0.1
        self.latent_idf = np.where(df > max(max_share * n_docs, 20), 0, self.idf)
        self.other = np.log(1 + n_docs) + 0.1
        pieces = []  # items in pieces as long as passages
        for k, w in enumerate(self.words):
            for s in range(0, max(1, len(w) - STEP_WORDS), STEP_WORDS):
                pieces.append((k, self.lookup(w[s:s + SPAN])))
        self.piece_item = np.array([k for k, _ in pieces], np.int64)
        self.queries = np.zeros((len(pieces), len(self.vocab)))
        for r, (_, ids) in enumerate(pieces):
            np.add.at(self.queries[r], ids, self.latent_idf[ids])
        self.has = self.queries > 0
        self.piece_weight = (self.has * self.idf).sum(axis=1)
        self.weight = [self.idf[np.unique(self.lookup(w))] for w in self.words]
        # items for the exact search, by the cells of STEP_WORDS words that they reach to either side, and for each
        # (word, item): the share of the item's places, weights and answer that the word makes up
        self.poor: dict[int, tuple[np.ndarray, list[np.ndarray]]] = {}
        ids = [self.lookup(w) for w in self.words]
        for k, x in enumerate(ids):
            if np.mean(self.latent_idf[x] > 0) < POOR_SHARE:
                self.poor.setdefault(-(-len(x) // STEP_WORDS), []).append(k)
        self.poor_vocab = np.unique(np.concatenate([np.zeros(0, np.int32), *[ids[k] for ks in self.poor.values() for k in ks]]))
        for reach, ks in self.poor.items():
            shares = [np.zeros((len(self.poor_vocab), len(ks)), np.float32) for _ in range(3)]
            for j, k in enumerate(ks):
                places, answer = (np.bincount(np.searchsorted(self.poor_vocab, x), minlength=len(self.poor_vocab)) for x in (ids[k], self.lookup(self.answers[k])))
                weights = (places > 0) * self.idf[self.poor_vocab]
                for share, x in zip(shares, (places, weights, answer), strict=True):
                    share[:, j] = x / max(x.sum(), 1e-9)
            self.poor[reach] = np.array(ks), shares

    def test_matrix(self, rank: int) -> np.ndarray:
        rng = np.random.default_rng(9)
        v = len(self.vocab)
        own = self.queries.T @ rng.normal(size=(len(self.queries), rank - rank // 4)) / np.sqrt(len(self.queries))
        return np.concatenate([rng.normal(size=(v, rank // 4)), own], axis=1).astype(np.float32)

    def set_basis(self, w: np.ndarray, y: np.ndarray) -> None:
        """Right singular vectors of A from W and Y = A'A W (Nystroem), and the items' latent vectors."""
        scale = np.linalg.norm(y) + 1e-12
        shift = 1e-7 * scale
        y = y + shift * w
        core = w.T.astype(float) @ y
        vals, vecs = np.linalg.eigh((core + core.T) / 2)
        keep = vals > 1e-9 * max(vals.max(initial=0), 1e-30)
        half = y @ (vecs[:, keep] / np.sqrt(vals[keep]))
        u, _, _ = np.linalg.svd(half, full_matrices=False)
        self.basis = u.astype(np.float32)
        q = self.queries @ self.basis
        self.latent = (q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-9)).astype(np.float32)

    def masks(self) -> None:
        """Bit masks of each word's places, for the longest common subsequence."""
        def table(w):
            out: dict[int, int] = {}
            for i, x in enumerate(w.tolist()):
                out[x] = out.get(x, 0) | 1 << i
            return out
        self.item_masks = [table(w) for w in self.words]
        self.answer_masks = [table(w) for w in self.answers]


def common_subsequence(masks: dict[int, int], size: int, seq: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel over the item."""
    full = (1 << size) - 1
    v = full
    for x in seq:
        m = masks.get(x)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


class Passages:
    """Sparse TF-IDF rows of the passages of some texts."""

    def __init__(self, items: Items, data: np.ndarray, starts: np.ndarray) -> None:
        ws, we, bounds = words(data, starts, NO_LETTER)
        self.hashes = word_hashes(folded(data), ws, we, lower=False)
        self.bounds = bounds
        counts = np.diff(bounds)
        self.per_text = -(-counts // STEP_WORDS)
        self.first = np.cumsum(self.per_text) - self.per_text
        text = np.repeat(np.arange(len(counts)), counts)
        self.col = items.lookup(self.hashes)
        self.text = text
        if not hasattr(items, "idf"):
            return
        place = np.arange(len(text)) - bounds[text]
        j = place // STEP_WORDS
        passage = self.first[text] + j
        n = int(self.per_text.sum())
        weight = np.where(self.col >= 0, items.latent_idf[np.maximum(self.col, 0)], items.other)
        both = np.concatenate([passage, passage[j > 0] - 1])
        outside = np.concatenate([self.col < 0, (self.col < 0)[j > 0]])
        sq = np.bincount(both[outside], minlength=n) * items.other ** 2
        use = (self.col >= 0) & (weight > 0)
        code = passage[use] * len(items.vocab) + self.col[use]
        again = use & (j > 0)
        code = np.concatenate([code, (passage[again] - 1) * len(items.vocab) + self.col[again]])
        code, tf = np.unique(code, return_counts=True)
        self.row, self.column = code // len(items.vocab), code % len(items.vocab)
        self.value = (tf * items.latent_idf[self.column]).astype(np.float32)
        sq = sq + np.bincount(self.row, weights=self.value.astype(float) ** 2, minlength=n)
        self.norm = np.sqrt(sq)
        # rows that have entries
        self.at = np.flatnonzero(np.diff(self.row, prepend=-1))
        self.rows = self.row[self.at]
        self.span, self.size = self.at, np.diff(np.append(self.at, len(self.row)))

    def times(self, m: np.ndarray) -> np.ndarray:
        """A M for the rows that have entries."""
        if not len(self.rows):
            return np.zeros((0, m.shape[1]), np.float32)
        return np.add.reduceat(self.value[:, None] * m[self.column], self.at, axis=0)

    def back(self, z: np.ndarray, out: np.ndarray) -> None:
        """out += A' Z."""
        order = np.argsort(self.column, kind="stable")
        place = np.repeat(np.arange(len(self.at)), np.diff(np.append(self.at, len(self.row))))
        col = self.column[order]
        first = np.flatnonzero(np.diff(col, prepend=-1))
        if len(first):
            out[col[first]] += np.add.reduceat(self.value[order][:, None] * z[place[order]], first, axis=0)


def _frequencies(sent):
    def work(batches):
        items, n = sent.value, 0
        df = np.zeros(len(items.vocab), np.int64)
        for batch in batches:
            n += batch.num_rows
            for _, data, starts in slices(batch.column(0)):
                p = Passages(items, data, starts)
                ok = p.col >= 0
                df += np.bincount(np.unique(p.text[ok] * len(df) + p.col[ok]) % max(len(df), 1), minlength=len(df))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(df))), pa.array(np.append(n, df))], names=["word", "c"])
    return work


def _sketch(sent, test):
    def work(batches):
        items, w = sent.value, test.value
        y = np.zeros(w.shape)
        for batch in batches:
            for _, data, starts in slices(batch.column(0)):
                p = Passages(items, data, starts)
                if len(p.rows):
                    # unit passages
                    p.value = p.value / np.maximum(p.norm[p.row], 1e-9).astype(np.float32)
                    p.back(p.times(w), y)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(y))), pa.array([r.tobytes() for r in y], pa.binary())], names=["word", "vector"])
    return work


def _add_vectors(batches):
    """(word, vector) dealt by word -> the sum of each word's vectors."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for word, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            v = np.frombuffer(vector)
            sums[word] = sums[word] + v if word in sums else v
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["word", "vector"])


def exact_candidates(items: Items, p: Passages) -> list[tuple[int, int]]:
    """(passage, item) of the items searched exactly, wherever the words around the passage can pass the checks."""
    n, v = int(p.per_text.sum()), len(items.poor_vocab)
    out: list[tuple[int, int]] = []
    if not n or not v:
        return out
    column = np.full(len(items.vocab) + 1, -1)
    column[items.poor_vocab] = np.arange(v)
    column = column[p.col]  # -1: outside
    at = np.flatnonzero(column >= 0)
    column = column[at]
    cell = p.first[p.text[at]] + (at - p.bounds[p.text[at]]) // STEP_WORDS
    begin, end = np.repeat(p.first, p.per_text), np.repeat(p.first + p.per_text, p.per_text)
    halo = max(items.poor) + SPAN // STEP_WORDS
    step = max(halo, CELLS // v)
    for a in range(0, n, step):
        b = min(n, a + step)
        lo, hi = max(0, a - halo), min(n, b + halo)
        held = np.zeros((hi - lo + 1, v), np.int32)
        x, y = np.searchsorted(cell, [lo, hi])
        held[cell[x:y] - lo + 1, column[x:y]] = 1
        held = np.cumsum(held, axis=0, dtype=np.int32)
        c = np.arange(a, b)
        for reach, (ks, shares) in items.poor.items():
            first, last = np.maximum(c - reach, begin[a:b]), np.minimum(c + SPAN // STEP_WORDS + reach, end[a:b])
            there = (held[last - lo] > held[first - lo]).astype(np.float32)
            ok = np.ones((b - a, len(ks)), bool)
            for share, least in zip(shares, (LCS_SHARE, WEIGHT_SHARE, ANSWER_SHARE), strict=True):
                ok &= (there @ share >= least - 1e-3) | ~share.any(axis=0)
            r, j = np.nonzero(ok)
            out += zip((r + a).tolist(), ks[j].tolist(), strict=True)
    return out


def latent_candidates(items: Items, p: Passages, cosine: float):
    """(passage, item, cosine) of the pairs near in the latent space that hold a share of a piece's weighted words."""
    if not len(p.rows):
        return
    z = p.times(items.basis)
    norm = np.linalg.norm(z, axis=1)
    z /= np.maximum(norm, 0.2 * p.norm[p.rows])[:, None].astype(np.float32) + 1e-9
    for lo in range(0, len(z), 8192):
        sim = z[lo:lo + 8192] @ items.latent.T
        r, q = np.nonzero(sim >= cosine)
        # the passage must hold a share of the piece's weighted words
        row = p.span[r + lo]
        of = np.repeat(np.arange(len(r)), p.size[r + lo])
        entry = ragged(row, p.size[r + lo])
        held = np.bincount(of, weights=items.has[q[of], p.column[entry]] * items.idf[p.column[entry]], minlength=len(r))
        likely = held >= PIECE_SHARE * items.piece_weight[q] if cosine > -1 else np.ones(len(r), bool)
        r, q = r[likely], q[likely]
        if not len(r):
            continue
        order = np.lexsort((sim[r, q], items.piece_item[q], r))
        top = dict(zip(zip(p.rows[r + lo][order].tolist(), items.piece_item[q][order].tolist(), strict=True), sim[r, q][order].tolist(), strict=True))
        for (row, k), sim_ in top.items():  # the best piece of an item stands last
            yield row, k, sim_


def word_cosine(items: Items, k: int, hashes: np.ndarray) -> float:
    """Cosine of an item and a passage over all words, by weight."""
    def vector(h):
        ids = items.lookup(h)
        return np.bincount(ids[ids >= 0], minlength=len(items.idf)) * items.idf, (ids < 0).sum() * items.other ** 2
    (a, _), (b, outside) = vector(items.words[k]), vector(hashes)
    return float(a @ b / max(np.sqrt((a @ a) * (b @ b + outside)), 1e-9))


def exact_matches(items: Items, data: np.ndarray, starts: np.ndarray) -> list[tuple]:
    """As `matches`, of the items without letters: the first place of each text and item, counted in words of letters."""
    if not items.plain:
        return []
    at, h, bounds = marks(data, starts)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    letters, _, letter_bounds = words(data, starts, NO_LETTER)
    out = []
    for size, held in items.plain.items():
        runs = run_hash(h, size)
        inside = text[:len(runs)] == text[size - 1:] if len(runs) else np.zeros(0, bool)
        if size < LEAST_MARKS:
            inside = inside & (np.diff(bounds)[text[:len(runs)]] == size)
        place = np.flatnonzero(inside & np.isin(runs, np.array(list(held), np.uint64)))
        order = place[np.lexsort((place, runs[place], text[place]))]
        first = (np.diff(text[order], prepend=-1) != 0) | (np.diff(runs[order], prepend=np.uint64(0)) != 0)
        first[:1] = True
        for k in order[first].tolist():
            word = int(np.searchsorted(letters, at[k]) - letter_bounds[text[k]])
            out += [(int(text[k]), i, word, 0, 1.0, 1.0, 1.0) for i in held[int(runs[k])]]
    return out


def matches(items: Items, data: np.ndarray, starts: np.ndarray, cosine: float) -> list[tuple]:
    """(text, item, first word, words, cosine, lcs share, answer share) of the verified matches, the best of each text and item."""
    return (word_matches(items, data, starts, cosine) if len(items.vocab) else []) + exact_matches(items, data, starts)


def word_matches(items: Items, data: np.ndarray, starts: np.ndarray, cosine: float) -> list[tuple]:
    """`matches` of the items with letters."""
    p = Passages(items, data, starts)
    near = {(row, k): sim for row, k, sim in latent_candidates(items, p, cosine)}
    for pair in exact_candidates(items, p):
        near.setdefault(pair)
    if not near:
        return []
    best: dict[tuple[int, int], tuple] = {}
    pairs = np.array(list(near))
    texts = np.searchsorted(p.first + p.per_text, pairs[:, 0], "right")
    for (row, k), text in zip(pairs.tolist(), texts.tolist(), strict=True):
        size = len(items.words[k])
        a, b = int(p.bounds[text]), int(p.bounds[text + 1])
        s = a + (row - int(p.first[text])) * STEP_WORDS
        lo_w, hi_w = max(a, s - size), min(b, s + SPAN + size)
        seq = p.hashes[lo_w:hi_w].tolist()
        there = set(seq)
        masks = items.item_masks[k]
        if sum(m.bit_count() for x, m in masks.items() if x in there) < LCS_SHARE * size:
            continue
        weights = items.weight[k]
        vocab = np.unique(items.words[k])
        held = sum(w for x, w in zip(vocab.tolist(), weights.tolist(), strict=True) if x in there)
        if held < WEIGHT_SHARE * weights.sum():
            continue
        share = common_subsequence(masks, size, seq) / size
        if share < LCS_SHARE:
            continue
        n_answer = len(items.answers[k])
        answer = common_subsequence(items.answer_masks[k], n_answer, seq) / n_answer if n_answer else 1.0
        if answer < ANSWER_SHARE:
            continue
        sim = near[row, k]
        if sim is None:
            sim = word_cosine(items, k, p.hashes[s:min(b, s + SPAN)])
        found = (share, answer, sim, lo_w - a, hi_w - lo_w)
        if (text, k) not in best or found > best[text, k]:
            best[text, k] = found
    return [(text, items.ids[k], f[3], f[4], float(f[2]), f[0], f[1]) for (text, k), f in best.items()]


FOUND = "doc_id long, item_id long, region_start long, region_words long, cosine double, lcs_share double, answer_share double"


def _search(sent, cosine):
    def work(batches):
        items = sent.value
        items.masks()
        for batch in batches:
            for lo, data, starts in slices(batch.column(1)):
                found = matches(items, data, starts, cosine)
                if found:
                    cols = list(zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.array(cols[0]) + lo))] + [pa.array(c, pa.int64()) for c in cols[1:4]]
                                                     + [pa.array(c, pa.float64()) for c in cols[4:]], names=[f.split()[0] for f in FOUND.split(", ")])
    return work


def _without(sent, text_at, cosine):
    def work(batches):
        for s in sent:
            s.value.masks()
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for s in sent:
                for lo, data, starts in slices(batch.column(text_at)):
                    for found in matches(s.value, data, starts, cosine):
                        keep[lo + found[0]] = False
            yield batch.filter(pa.array(keep))
    return work


def blocks(benchmark: DataFrame, item_id: str, text: str, block: int):
    """The benchmark's items block by block, in order of their ids."""
    held: list[tuple[int, str]] = []
    for r in benchmark.select(F.col(f"`{item_id}`").cast("long").alias("i"), F.col(f"`{text}`").alias("t")).orderBy("i", "t").toLocalIterator():
        held.append((r["i"], r["t"]))
        if len(held) == block:
            yield held
            held = []
    if held:
        yield held


def fit(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
        rank: int = RANK, max_share: float = MAX_SHARE, block: int = BLOCK) -> list[Items]:
    """The fitted blocks: vocabulary, weights and latent basis from all documents."""
    sc, out = docs.sparkSession.sparkContext, []
    texts = docs.select(F.col(f"`{text}`").alias("text"))
    for held in blocks(benchmark, item_id, item_text, block):
        items = Items(held)
        if not len(items.vocab):
            out += [items] if items.plain else []
            continue
        rows = (texts.mapInArrow(_frequencies(sc.broadcast(items)), "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))).collect()
        counts = np.zeros(len(items.vocab) + 1, np.int64)
        for r in rows:
            counts[r["word"]] = r["c"]  # -1: the documents
        items.weigh(counts[:-1], int(counts[-1]), max_share)
        w = items.test_matrix(rank)
        y = np.zeros(w.shape)
        for r in (texts.mapInArrow(_sketch(sc.broadcast(items), sc.broadcast(w)), "word long, vector binary")
                  .repartition("word").mapInArrow(_add_vectors, "word long, vector binary").toLocalIterator()):
            y[r["word"]] = np.frombuffer(r["vector"])
        items.set_basis(w, y)
        items.queries = None
        out.append(items)
    return out


def search(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", cosine: float = COSINE, fitted: list[Items] | None = None,
           **how) -> DataFrame:
    """One row per document and item found in it: FOUND."""
    spark = docs.sparkSession
    fitted = fit(docs, benchmark, text, **how) if fitted is None else fitted
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    parts = [rows.mapInArrow(_search(spark.sparkContext.broadcast(i), cosine), FOUND) for i in fitted]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], FOUND)


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", cosine: float = COSINE, fitted: list[Items] | None = None, **how) -> DataFrame:
    """The rows of docs, all columns as they are, in which no item is found. No row is shuffled."""
    fitted = fit(docs, benchmark, text, **how) if fitted is None else fitted
    sent = [docs.sparkSession.sparkContext.broadcast(i) for i in fitted]
    return docs.mapInArrow(_without(sent, docs.columns.index(text), cosine), docs.schema)
