"""8. Suffix-array dedup by bucket-pointer refinement: remove every repeat of a 100-byte string.

A byte is removed if some 100-byte string covering it also starts earlier (smaller id, or the same
document at an earlier place); strings are judged on the input. Suffixes are put into buckets by
their first q bytes, and a bucket with more than one suffix is refined by the bucket identifiers of
later offsets; what a level settles is never opened again. Since only common prefixes of `length`
bytes matter, one suffix per window of `length` bytes is enough to start from: the one whose q-gram
identifier is least in the window. Equal windows choose it at the same offset, so

1. `_anchors`: each text is cut into runs of consecutive windows with the same chosen suffix
   (about one per 35 bytes). A run carries the bucket identifier of its suffix's q-gram and a refined
   identifier, that of all bytes its windows cover. Equal runs of one batch are pre-aggregated: the
   earliest stays, the others are settled (repeats) before any shuffle, so a bucket never gets more
   equal runs than there are batches.
2. `_refine`: sorted by (bucket, refined identifier, place). Buckets of one suffix are settled
   (no repeat); of equal runs all but the earliest are repeats in full; the earliest of each refined
   bucket stays open if its bucket holds more than one.
3. `_contexts`, `_windows`: open runs (the edges of repeated passages) are refined to the depth of
   `length` bytes at every offset: the identifier of depth 2^k at p is made of those of depth 2^(k-1)
   at p and at the later offset p + 2^(k-1), each level using the one before. Buckets with more than
   `bucket_runs` open runs go window by window through a shuffle instead, so no task holds a large bucket.
4. The repeats of each document are joined to its text once, and the bytes they cover leave.

Identifiers are 64-bit fingerprints compared within buckets of another 64-bit one (128 bits in all).

Null and empty texts: no bytes, nothing removed. Rows that repeat an id with the same text are one
document (equal places are not repeats of each other); with other texts they are separate documents
in order of the text's fingerprint. Null ids come first. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roomrank.llm.bytes_text import (BASE_A, BASE_B, BYTE_B, SLICE_BYTES, flat, mix, powers, prefix_sums, ragged, slices, spans)
from roomrank.llm.shared import written

LENGTH = 100
Q = 32
BUCKET_RUNS = 50_000
NO_ID = -(1 << 63)
PLACE_BITS = (1 << 21) - 1

# `at` packs a run's place: 23 bits of the text's fingerprint, 32 bits of the first window, 8 bits: settled flag and windows
FLAG = 0x80


def _fingerprint(text: Column) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(text, F.lit(""))), F.lit(1 << 23))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    k = 1
    while 2 * k <= width:
        x = np.minimum(x[:-k], x[k:])
        k *= 2
    return np.minimum(x[:len(x) - (width - k)], x[width - k:]) if k < width else x


def runs(data: np.ndarray, starts: np.ndarray, length: int, q: int) -> tuple[np.ndarray, ...]:
    """First and last window, bucket identifier and refined identifier of each run of windows with the same chosen suffix."""
    n = len(data)
    if n < length:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    sums = prefix_sums(data)
    h = sums[q:] - sums[:n - q + 1]
    h *= powers(BASE_A, n)[1][:n - q + 1]
    h = mix(h)
    low = np.uint64(PLACE_BITS)
    least = _sliding_min((h & ~low) | np.arange(n - q + 1, dtype=np.uint64), length - q + 1)
    chosen = (least & low).astype(np.int64)
    whole = np.zeros(n + 1, np.int64)  # windows within one text
    long_ = np.diff(starts) >= length
    whole[starts[:-1][long_]] += 1
    whole[starts[1:][long_] - length + 1] -= 1
    chosen[np.cumsum(whole)[:len(chosen)] == 0] = -1
    s = np.flatnonzero(np.diff(chosen, prepend=-2))
    e = np.append(s[1:], len(chosen)) - 1
    inside = chosen[s] >= 0
    s, e = s[inside], e[inside]
    a = chosen[s]
    refined = spans(prefix_sums(data, BYTE_B, BASE_B), s, e + length, BASE_B) ^ mix((a - s).astype(np.uint64))
    return s, e, h[a], refined


def _pieces(col: pa.Array, length: int):
    """(rows, offset in the row's text, bytes, starts): slices of texts; a long text comes in pieces that share length - 1 bytes."""
    for lo, data, starts in slices(col):
        if len(starts) == 2 and len(data) > SLICE_BYTES + length:
            for at in range(0, len(data) - length + 1, SLICE_BYTES):
                part = data[at:at + SLICE_BYTES + length - 1]
                yield np.array([lo]), at, part, np.array([0, len(part)])
        else:
            yield np.arange(lo, lo + len(starts) - 1), 0, data, starts


def _anchors(length: int, q: int):
    def work(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            prints = batch.column(1).to_numpy(zero_copy_only=False)
            got = []
            for rows, offset, data, starts in _pieces(batch.column(2), length):
                s, e, b, c = runs(data, starts, length, q)
                row = np.searchsorted(starts, s, "right") - 1
                place = s - starts[row] + offset
                row = rows[row]
                got.append((b.view(np.int64), c.view(np.int64), ids[row], (prints[row] << 40) | (place << 8) | (e - s + 1)))
            if not got or not sum(len(x[0]) for x in got):
                continue
            b, c, doc, at = (np.concatenate(x) for x in zip(*got, strict=True))
            order = np.lexsort((at, doc, c, b))
            b, c, doc, at = b[order], c[order], doc[order], at[order]
            same = np.zeros(len(b), bool)
            same[1:] = (b[1:] == b[:-1]) & (c[1:] == c[:-1])
            again = same.copy()
            again[1:] &= (doc[1:] == doc[:-1]) & (at[1:] == at[:-1])
            keep = ~again
            same, b, c, doc, at = same[keep], b[keep], c[keep], doc[keep], at[keep]
            spread = mix(doc.view(np.uint64) ^ mix(at.view(np.uint64))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.where(same, spread, b)), pa.array(np.where(same, 0, c)), pa.array(doc),
                                              pa.array(np.where(same, at | FLAG, at))], names=["bucket", "refined", "doc_id", "at"])
    return work


def _refine(batches):
    """Rows sorted by (bucket, refined, doc_id, at). kind 1: a repeat in full; kind 2: open."""
    def settle(t):
        b, c, doc, at = t
        flag = (at & FLAG) != 0
        out = [(b[flag], doc[flag], at[flag] & ~FLAG, np.ones(int(flag.sum()), np.int8))]
        b, c, doc, at = b[~flag], c[~flag], doc[~flag], at[~flag]
        if len(b):
            new_b = np.ones(len(b), bool)
            new_b[1:] = b[1:] != b[:-1]
            new_c = new_b.copy()
            new_c[1:] |= c[1:] != c[:-1]
            again = np.zeros(len(b), bool)  # the same place twice: one document listed twice
            again[1:] = ~new_c[1:] & (doc[1:] == doc[:-1]) & (at[1:] == at[:-1])
            group = np.cumsum(new_b) - 1
            open_ = new_c & (np.bincount(group[new_c])[group] > 1)
            first = np.maximum.accumulate(np.where(new_c, np.arange(len(b)), 0))
            repeat = ~new_c & ~again & ~((doc == doc[first]) & (at == at[first]))
            out += [(x[0][m], x[1][m], x[2][m], np.full(int(m.sum()), k, np.int8)) for m, k, x in ((repeat, 1, (b, doc, at)), (open_, 2, (b, doc, at)))]
        r = [np.concatenate(x) for x in zip(*out, strict=True)]
        if len(r[0]):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in r], names=["bucket", "doc_id", "at", "kind"])

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        if held is not None:
            t = [np.concatenate(x) for x in zip(held, t, strict=True)]
        cut = int(np.searchsorted(t[0], t[0][-1]))  # the last bucket may go on in the next batch
        held = [x[cut:] for x in t]
        if cut:
            yield from settle([x[:cut] for x in t])
    if held is not None:
        yield from settle(held)


def _contexts(length: int):
    def work(batches):
        for batch in batches:
            data, starts = flat(batch.column(1))
            listed = batch.column(2).combine_chunks() if isinstance(batch.column(2), pa.ChunkedArray) else batch.column(2)
            row = np.repeat(np.arange(batch.num_rows), listed.value_lengths().fill_null(0).to_numpy())
            items = listed.flatten()
            at = items.field("at").to_numpy(zero_copy_only=False)
            s = starts[row] + ((at >> 8) & 0xFFFFFFFF)
            size = (at & 0x7F) + length - 1
            for lo in range(0, len(at), 4096):
                hi = min(lo + 4096, len(at))
                body = data[ragged(s[lo:hi], size[lo:hi])]
                off = np.concatenate([[0], np.cumsum(size[lo:hi])]).astype(np.int32)
                ctx = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(off.tobytes()), pa.py_buffer(body.tobytes())])
                yield pa.RecordBatch.from_arrays([items.field("bucket").slice(lo, hi - lo), batch.column(0).take(pa.array(row[lo:hi])),
                                                  pa.array(at[lo:hi]), ctx], names=["bucket", "doc_id", "at", "bytes"])
    return work


def refined_windows(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, offset and (n, 2) identifiers of every window, by doubling: depth 2^k from depth 2^(k-1) at a later offset."""
    ids = [mix(t[data] + np.uint64(1)) for t in (BYTE_B, np.roll(BYTE_B, 7))]
    depth = 1
    while depth < length:
        shift = min(depth, length - depth)  # the last level overlaps
        ids = [mix(x[:len(x) - shift] * np.uint64(BASE_A) + x[shift:]) for x in ids]
        depth += shift
    size = np.maximum(np.diff(starts) - length + 1, 0)
    pos = ragged(starts[:-1], size)
    row = np.repeat(np.arange(len(starts) - 1), size)
    return row, pos - starts[row], np.stack([x[pos] for x in ids], 1) if len(pos) else np.zeros((0, 2), np.uint64)


def _as_spans(doc: np.ndarray, at: np.ndarray):
    """Runs of at most 127 windows from single windows (doc, at with 1 window), sorted by both."""
    if not len(doc):
        return doc, at
    base = at & ~0xFF
    step = np.ones(len(doc), bool)
    step[1:] = (doc[1:] != doc[:-1]) | (base[1:] != base[:-1] + 256)
    first = np.maximum.accumulate(np.where(step, np.arange(len(doc)), 0))
    step |= (np.arange(len(doc)) - first) % 127 == 0
    s = np.flatnonzero(step)
    return doc[s], base[s] | np.diff(np.append(s, len(doc)))


def _windows(length: int):
    """Rows (bucket, doc_id, at, bytes) sorted by bucket -> (doc_id, at) of windows that are repeats."""
    def settle(t):
        bucket, doc, at, col = t
        data, starts = flat(col)
        row, off, ids = refined_windows(data, starts, length)
        order = np.lexsort((at[row] + (off << 8), doc[row], ids[:, 1], ids[:, 0], bucket[row]))
        row, off, ids = row[order], off[order], ids[order]
        same = np.zeros(len(row), bool)
        same[1:] = (bucket[row[1:]] == bucket[row[:-1]]) & (ids[1:] == ids[:-1]).all(axis=1)
        first = np.maximum.accumulate(np.where(~same, np.arange(len(row)), 0))
        d, a = doc[row], (at[row] & ~0xFF) + (off << 8) + 1
        same &= (d != d[first]) | (a != a[first])
        d, a = d[same], a[same]
        order = np.lexsort((a, d))
        d, a = _as_spans(d[order], a[order])
        if len(d):
            yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(a)], names=["doc_id", "at"])

    def work(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)] + [batch.column(3).cast(pa.large_binary())]
            if held is not None:
                t = [np.concatenate(x) for x in zip(held[:3], t[:3], strict=True)] + [pa.concat_arrays([held[3], t[3]])]
            cut = int(np.searchsorted(t[0], t[0][-1]))
            held = [x[cut:] for x in t]
            if cut:
                yield from settle([x[:cut] for x in t])
        if held is not None:
            yield from settle(held)
    return work


def _each_window(length: int):
    def work(batches):
        for batch in batches:
            data, starts = flat(batch.column(3))
            row, off, ids = refined_windows(data, starts, length)
            doc, at = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            yield pa.RecordBatch.from_arrays([pa.array(ids[:, 0].view(np.int64)), pa.array(ids[:, 1].view(np.int64)), pa.array(doc[row]),
                                              pa.array((at[row] & ~0xFF) + (off << 8) + 1)], names=["w1", "w2", "doc_id", "at"])
    return work


def _cut(length: int):
    def work(batches):
        for batch in batches:
            data, starts = flat(batch.column(1))
            listed = batch.column(2)
            bounds = np.concatenate([[0], np.cumsum(listed.value_lengths().fill_null(0).to_numpy())])
            at = listed.flatten().to_numpy(zero_copy_only=False)
            removed, n_spans, sha, edges = [], [], [], []
            for i in range(batch.num_rows):
                body = data[starts[i]:starts[i + 1]]
                mine = at[bounds[i]:bounds[i + 1]]
                if len(mine):
                    s = (mine >> 8) & 0xFFFFFFFF
                    e = s + (mine & 0x7F) + length - 1
                    order = np.argsort(s, kind="stable")
                    s, e = s[order], np.maximum.accumulate(e[order])
                    new = np.append(True, s[1:] > e[:-1])
                    s, e = s[new], e[np.append(np.flatnonzero(new)[1:] - 1, len(e) - 1)]
                    keep = ragged(np.append(0, e), np.append(s, len(body)) - np.append(0, e))
                    body = body[keep]
                    edges.append([{"start": int(x), "end": int(y)} for x, y in zip(s, e, strict=True)])
                else:
                    edges.append([])
                removed.append(int(starts[i + 1] - starts[i]) - len(body))
                n_spans.append(len(edges[-1]))
                sha.append(hashlib.sha256(body.tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(starts)), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(sha, pa.string()),
                 pa.array(edges, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])
    return work


RUN = "bucket long, refined long, doc_id long, at long"


def repeats(keyed: DataFrame, length: int = LENGTH, q: int = Q, bucket_runs: int = BUCKET_RUNS) -> DataFrame:
    """(doc_id, print, text) -> (doc_id, at): runs of windows that are repeats, over all documents."""
    found = (keyed.select("doc_id", "print", "text").mapInArrow(_anchors(length, q), RUN)
             .repartition("bucket").sortWithinPartitions("bucket", "refined", "doc_id", "at")
             .mapInArrow(_refine, "bucket long, doc_id long, at long, kind byte"))
    found = written(found, "suffix-runs")
    open_ = found.where("kind = 2")
    per_doc = (open_.groupBy("doc_id", F.shiftright("at", 40).alias("print"))
               .agg(F.collect_list(F.struct("bucket", "at")).alias("runs")))  # at most the runs of one text
    contexts = (keyed.join(per_doc, ["doc_id", "print"]).select("doc_id", "text", "runs")
                .mapInArrow(_contexts(length), "bucket long, doc_id long, at long, bytes binary"))
    large = open_.groupBy("bucket").count().where(F.col("count") > bucket_runs).select(F.col("bucket").alias("large"))
    marked = contexts.join(large, F.col("bucket") == F.col("large"), "left")
    marked = written(marked, "suffix-contexts")
    plain = marked.where("large is null").select("bucket", "doc_id", "at", "bytes")
    edges = (plain.repartition("bucket").sortWithinPartitions("bucket")
             .mapInArrow(_windows(length), "doc_id long, at long"))
    each = (marked.where("large is not null").select("bucket", "doc_id", "at", "bytes")
            .mapInArrow(_each_window(length), "w1 long, w2 long, doc_id long, at long"))
    first = (each.groupBy("w1", "w2").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.count(F.lit(1)).alias("c"))
             .where("c > 1"))
    single = (each.join(first, ["w1", "w2"]).where("struct(doc_id, at) <> first").select("doc_id", "at"))
    return found.where("kind = 1").select("doc_id", "at").unionByName(edges).unionByName(single)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, q: int = Q,
                   bucket_runs: int = BUCKET_RUNS) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (start, end of each removed run, in bytes)."""
    keyed = docs.select(F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(NO_ID)).alias("doc_id"),
                        _fingerprint(F.col(f"`{text}`")).alias("print"), F.col(f"`{text}`").alias("text"))
    spans_ = (repeats(keyed, length, q, bucket_runs).groupBy("doc_id", F.shiftright("at", 40).alias("print"))
              .agg(F.collect_list("at").alias("runs")))  # at most the runs of one text
    out = (keyed.join(spans_, ["doc_id", "print"], "left").select("doc_id", "text", "runs")
           .mapInArrow(_cut(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
                                     "spans array<struct<start:long,end:long>>"))
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))
