"""2. Token-ID / binary output: flat unsigned integer files plus 64-bit document offsets.

Layout of one set (a folder): for each partition `part-NNNNNN-ATTEMPT`
    .bin  token ids, little-endian, 2 bytes each if every id fits, else 4
    .off  n + 1 little-endian 64-bit token offsets of the part's documents, from 0
    .ids  n little-endian signed 64-bit document ids
and the manifest (part, stem, n_docs, n_tokens, width), whose running sums of n_tokens are the bases
that turn a part's offsets into positions in the whole set. Parts are ranges of the order asked for,
so the whole set is in that order. A retried task writes files under another attempt's name; the
manifest lists only those of the attempt that Spark took, so lost executors leave no wrong data.

Rows with a null text are empty documents (only the end id); a null doc_id is written as the least
64-bit integer and read back as null. Repeated ids keep all their rows, in the order of their texts (a null text
first); they are dealt by the id and the text's first 32 characters, so a repeated id lands in one task
only as far as its texts begin alike. Very long texts are encoded like others, one slice at a time. An empty table gives no files and no rows. Only the two columns named are read,
so other columns, whatever their names, play no part. Files are opened through pyarrow: local folders and the
schemes that it knows (file:, hdfs:, s3:, gs:).
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roomrank.llm.bytes_text import BASE_B, BYTE_B, SLICE_BYTES, flat, prefix_sums, ragged, slices, spans

NO_ID = -(1 << 63)
MANIFEST = "part int, stem string, n_docs long, n_tokens long, width int"
KEPT_PIECES = 1_500_000  # encoded pieces that a worker remembers before it starts over; bounds memory, not results
GROUP_BYTES = 8 << 20
DEALT_CHARS = 32  # of a text, to deal rows that repeat an id

LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
VISIBLE = np.zeros(256, bool)
VISIBLE[0x21:0x7F] = True


def _latin(data: np.ndarray) -> np.ndarray:
    """True on both bytes of the letters U+00C0 to U+00FF (two bytes, the first 0xC3)."""
    lead = data[:-1] == 0xC3
    lead &= (data[1:] != 0x97) & (data[1:] != 0xB7)  # the signs for times and division
    out = np.zeros(len(data), bool)
    out[:-1] |= lead
    out[1:] |= lead
    return out


def _byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies (a fixed rule of that format)."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PieceEncoder:
    """Encodes texts with a byte-level BPE tokenizer, each different piece once.

    A text is cut where the tokenizer's own pre-tokenizer always cuts: before a single space between
    two visible characters, around a single line feed between two, and after a letter that a sign or
    digit follows. Encodings of such pieces put one after another are the encoding of the text. Equal
    pieces are encoded once per worker and gathered by fingerprint (two independent 64-bit ones must
    agree, else the texts at hand are encoded whole). Texts that contain an added token, and
    tokenizers of another kind, are encoded whole.
    """

    def __init__(self, path: str) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.width = 2 if self.tok.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.kind = np.dtype("<u2" if self.width == 2 else "<u4")
        conf = json.loads(self.tok.to_str())
        pre, model = conf.get("pre_tokenizer") or {}, conf["model"]
        self.by_piece = (pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
                         and not conf.get("normalizer") and model.get("type") == "BPE"
                         and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix"))
        self.added = [t["content"].encode() for t in conf.get("added_tokens", [])]
        self.chars = _byte_chars()
        self.clear()

    def clear(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.second = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.len = np.zeros(0, np.int64)
        self.pool = np.zeros(0, self.kind)

    @staticmethod
    def cuts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        n = len(data)
        visible = VISIBLE[data]
        latin = _latin(data)
        seen = visible | latin
        letter = LETTER[data] | latin
        before = np.zeros(n, bool)
        before[1:] = seen[:-1]
        after = np.zeros(n, bool)
        after[:-1] = seen[1:]
        edge = starts[(starts > 0) & (starts < n)]
        before[edge] = False
        after[edge - 1] = False
        both = before & after
        cut = both & (data == 0x20)
        feed = np.flatnonzero(both & (data == 0x0A))
        cut[feed] = True
        cut[feed + 1] = True
        sign = visible & ~letter
        sign[0] = False
        sign[1:] &= letter[:-1]
        cut |= sign
        cut[starts[:-1][starts[:-1] < n]] = True
        return np.flatnonzero(cut)

    def learn(self, pieces: list[bytes], h: np.ndarray, h2: np.ndarray) -> None:
        """Encode new pieces and remember them."""
        data, starts = flat(pa.array(pieces, pa.large_binary()))
        latin = _latin(data)
        total = [np.concatenate([[0], np.cumsum(m)]) for m in (LETTER[data] | latin, DIGIT[data], VISIBLE[data] & ~LETTER[data] & ~DIGIT[data] & (data != 0x27))]
        s, e = starts[:-1], starts[1:]
        body = e - s - (data[s] == 0x20)
        # one pre-token: letters only, digits only or signs only (no apostrophe), after a space or not; or one byte
        single = (e - s == 1) | ((body > 0) & np.logical_or.reduce([t[e] - t[s] == body for t in total]))
        tokenize, chars = self.tok.model.tokenize, self.chars
        out: list[list[int]] = []
        for piece, one in zip(pieces, single.tolist(), strict=True):
            if one:
                out.append([t.id for t in tokenize(piece.decode("latin-1").translate(chars))])
            else:
                out.append(self.tok.encode(piece.decode("utf-8", "replace"), add_special_tokens=False).ids)
        lens = np.fromiter(map(len, out), np.int64, len(out))
        at = len(self.pool) + np.cumsum(lens) - lens
        known = np.concatenate([self.known, h])
        order = np.argsort(known, kind="stable")
        self.known = known[order]
        self.second = np.concatenate([self.second, h2])[order]
        self.at = np.concatenate([self.at, at])[order]
        self.len = np.concatenate([self.len, lens])[order]
        self.pool = np.concatenate([self.pool, np.fromiter((i for x in out for i in x), self.kind, int(lens.sum()))])

    def encode(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and per text their number."""
        raw = data.tobytes()
        if not len(data) or not self.by_piece or any(t in raw for t in self.added):
            return self.whole(raw, starts)
        got = []
        lo, n = 0, len(starts) - 1
        while lo < n:  # fingerprints by slices of about a megabyte
            hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + SLICE_BYTES, "right")) - 1)
            part = data[starts[lo]:starts[hi]]
            if len(part):
                s = self.cuts(part, starts[lo:hi + 1] - starts[lo])
                e = np.append(s[1:], len(part))
                got.append((s + starts[lo], spans(prefix_sums(part), s, e), spans(prefix_sums(part, BYTE_B, BASE_B), s, e, BASE_B)))
            lo = hi
        s, h, h2 = (np.concatenate(x) for x in zip(*got, strict=True))
        uniq, first, back = np.unique(h, return_index=True, return_inverse=True)
        if len(self.known) > KEPT_PIECES:
            self.clear()
        place = np.searchsorted(self.known, uniq)
        have = place < len(self.known)
        have[have] = self.known[place[have]] == uniq[have]
        if (h2[first][back] != h2).any() or (self.second[place[have]] != h2[first][have]).any():
            return self.whole(raw, starts)
        if not have.all():
            new = first[~have]
            ends = np.append(s[1:], len(data))[new]
            self.learn([raw[a:b] for a, b in zip(s[new].tolist(), ends.tolist(), strict=True)], h[new], h2[new])
            place = np.searchsorted(self.known, uniq)
        lens = self.len[place][back]
        upto = np.concatenate([[0], np.cumsum(lens)])[np.searchsorted(s, starts)]
        return self.pool[ragged(self.at[place][back], lens)], np.diff(upto)

    def whole(self, raw: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
        out = [np.array(x.ids, self.kind) for x in self.tok.encode_batch(texts, add_special_tokens=False)]
        return np.concatenate([np.zeros(0, self.kind), *out]), np.array([len(x) for x in out], np.int64)


_encoders: dict[str, PieceEncoder] = {}  # one per worker process, so later tasks know the pieces of earlier ones


def encoder(path: str) -> PieceEncoder:
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def _open_out(uri: str):
    fs, path = pafs.FileSystem.from_uri(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return fs.open_output_stream(path)


def _writer(folder: str, tokenizer: str, end_id: int):
    def write(batches):
        ctx = TaskContext.get()
        part, enc, stem, n_docs, n_tokens = ctx.partitionId(), None, "", 0, 0
        offs: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        out = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                enc = encoder(tokenizer)
                stem = f"part-{part:06d}-{ctx.taskAttemptId()}"
                out = _open_out(f"{folder}/{stem}.bin")
            doc_ids = batch.column(0).cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            ids.append(doc_ids)
            for _, data, starts in slices(batch.column(1), GROUP_BYTES):
                tokens, lens = enc.encode(data, starts)
                ends = np.cumsum(lens)
                out.write(np.insert(tokens, ends, np.array(end_id, enc.kind)).tobytes())
                offs.append(n_tokens + ends + np.arange(1, len(ends) + 1))
                n_tokens += len(tokens) + len(lens)
            n_docs += len(doc_ids)
        if out is not None:
            out.close()
            for ext, a in ((".off", np.concatenate([[0], *offs]).astype("<u8")), (".ids", np.concatenate(ids).astype("<i8"))):
                with _open_out(f"{folder}/{stem}{ext}") as f:
                    f.write(a.tobytes())
            yield pa.RecordBatch.from_pylist([{"part": part, "stem": stem, "n_docs": n_docs, "n_tokens": n_tokens, "width": enc.width}],
                                             schema=pa.schema([("part", pa.int32()), ("stem", pa.string()), ("n_docs", pa.int64()),
                                                               ("n_tokens", pa.int64()), ("width", pa.int32())]))
    return write


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text",
                 order: list | None = None) -> DataFrame:
    """Write the token files of docs in ascending order of `order` (doc_id if none); returns the manifest with bases.

    The manifest has one row per file, so it is read to the driver to add the bases (running sums).
    """
    spark = docs.sparkSession
    keys = order or [F.col(f"`{doc_id}`")]
    named = docs.select(*[k.alias(f"_k{i}") for i, k in enumerate(keys)], F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{text}`").alias("_text"))
    cols = [F.col(f"_k{i}") for i in range(len(keys))]
    # rows that repeat an id stand in the order of their texts; the ranges are sampled on the texts' first characters only
    dealt, cols = ([*cols, F.substring("_text", 1, DEALT_CHARS)], [*cols, F.col("_text")]) if not order else (cols, [*cols, F.col("_id")])
    rows = (named.repartitionByRange(*dealt).sortWithinPartitions(*cols).select("_id", "_text")
            .mapInArrow(_writer(folder, tokenizer, end_id), MANIFEST).collect())
    base, out = 0, []
    for r in sorted(rows, key=lambda r: r["part"]):
        out.append((*r, base, folder))
        base += r["n_tokens"]
    return spark.createDataFrame(out, MANIFEST + ", base long, folder string")


def _reader(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    for batch in batches:
        for r in batch.to_pylist():
            arrays = []
            for ext, kind in ((".bin", "<u2" if r["width"] == 2 else "<u4"), (".off", "<u8"), (".ids", "<i8")):
                fs, path = pafs.FileSystem.from_uri(f"{r['folder']}/{r['stem']}{ext}")
                if isinstance(fs, pafs.LocalFileSystem):
                    arrays.append(np.memmap(path, kind, "r"))
                else:
                    with fs.open_input_file(path) as f:
                        arrays.append(np.frombuffer(f.read(), kind))
            tokens, off, ids = arrays
            for lo in range(0, len(ids), 4096):
                o = off[lo:lo + 4097].astype(np.int64)
                crc = [zlib.crc32(tokens[a:b].astype("<u4").tobytes()) for a, b in zip(o[:-1].tolist(), o[1:].tolist(), strict=True)]
                found = np.asarray(ids[lo:lo + 4096], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(found, mask=found == NO_ID), pa.array(o[:-1] + r["base"]),
                                                  pa.array(np.diff(o)), pa.array(crc, pa.int64())], schema=schema)


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Per document of the written set: doc_id, start, n_tokens, ids_crc32; one task per few files, each memory-mapped."""
    return (manifest.repartition(max(1, manifest.count()), "part")
            .mapInArrow(_reader, "doc_id long, start long, n_tokens long, ids_crc32 long"))


def token_table(spark: SparkSession, docs: DataFrame, folder: str, tokenizer: str, end_id: int, order: list | None = None) -> DataFrame:
    return read_tokens(write_tokens(docs, folder, tokenizer, end_id, order=order))
