"""Substring de-duplication over word windows by super-k-mer partitioning.

A window is WINDOW consecutive words. Its minimiser is the pair of neighbouring words in it that comes first in a fixed
pseudo-random order; consecutive windows that share their minimiser travel as one packed string to the minimiser's bucket
(about a sixth of the strings that single windows would need). A bucket sorts its windows, which puts equal ones side by
side, so that each window's smallest document is known exactly.

Buckets receive super-k-mers in compressed blocks: document ids and word positions next to their packed strings. Two things
keep frequent passages from piling up in one bucket. Of equal strings in a block only those of the smallest document are
sent; the others repeat it, whatever the other blocks hold. And minimisers that are hot by a count over all documents are
taken apart: their windows travel one by one, to buckets by a hash of the whole window.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import free_names, materialize, need_integral, partitions, release, tidy, utf8_views

WINDOW, MINIMISER = 13, 2
#: Bytes of text that are cut at once, of packed strings that a task holds before it sends blocks, of a bucket that are
#: unpacked at once (a larger bucket is worked through in slices of minimisers).
CHUNK_BYTES, HOLD_BYTES, SLICE_BYTES = 1 << 20, 32 << 20, 96 << 20
#: Windows of one super-k-mer at most; a longer run is continued in the next.
MAX_WINDOWS = 200
#: A null document id: after all others.
NULL_ID = (1 << 63) - 1
#: A minimiser is hot with this share of an average bucket's super-k-mers, and so many at least.
HOT_SHARE, HOT_LEAST = 0.25, 4000
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
#: Tags tell rows of null id apart, by their texts; others have tag 0.
_HEAD = np.dtype([("doc", "<i8"), ("tag", "<u4"), ("start", "<u4"), ("key", "<u4"), ("words", "<u2")])


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def super_kmers(texts: list[bytes], window: int = WINDOW) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of the texts that have a window, and per super-k-mer: index of its text, its first word in the text, its first
    word among all words, its windows, its minimiser's key."""
    per = [t.split() for t in texts]
    counts = np.array([len(w) for w in per], np.int64)
    words = [w for ws in per if len(ws) >= window for w in ws]
    docs = np.flatnonzero(counts >= window)
    none = np.zeros(0, np.int64)
    if not len(docs):
        return words, none, none, none, none, none.astype(np.uint64)
    h = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    size = np.fromiter(map(len, words), np.int64, len(words))
    pair = (h[:-1] * _A) ^ (h[1:] * _B)
    pair ^= pair >> np.uint64(32)
    pair *= _C
    pair ^= pair >> np.uint64(29)
    # Long word pairs come first in the order: they are rare, so that few windows meet by chance.
    both = size[:-1] + size[1:]
    rank = 3 - (both >= 8).astype(np.uint64) - (both >= 12) - (both >= 16)
    order = (pair >> np.uint64(2)) | (rank << np.uint64(62))
    low = _sliding_min(order, window - MINIMISER + 1)  # of the window that begins at each word
    n = counts[docs]
    ends = np.cumsum(n)
    firsts = ends - n
    begins = np.concatenate([np.arange(a, b - window + 1) for a, b in zip(firsts.tolist(), ends.tolist())])
    owner = np.repeat(docs, n - window + 1)
    inside = begins - np.repeat(firsts, n - window + 1)
    low = low[begins]
    new = np.ones(len(begins), bool)
    new[1:] = (low[1:] != low[:-1]) | (begins[1:] != begins[:-1] + 1)
    at = np.flatnonzero(new)
    runs = np.diff(np.append(at, len(begins)))
    if runs.max() > MAX_WINDOWS:
        at = np.concatenate([np.arange(a, a + r, MAX_WINDOWS) for a, r in zip(at.tolist(), runs.tolist())])
        stops = np.concatenate([np.minimum(np.arange(a, a + r, MAX_WINDOWS) + MAX_WINDOWS, a + r) for a, r in zip(np.flatnonzero(new).tolist(), runs.tolist())])
        runs = stops - at
    return words, owner[at], inside[at], begins[at], runs, low[at]


def _columns(h: np.ndarray) -> list[bytes]:
    """Fields column by column, documents as differences."""
    return [np.diff(h["doc"], prepend=0).astype("<i8").tobytes(), *(np.ascontiguousarray(h[c]).tobytes() for c in _HEAD.names[1:])]


def _pack(heads: list[np.ndarray], strings: list[bytes]) -> bytes:
    """One block: heads and strings of what has to be solved, then heads of what is solved here: super-k-mers whose string a
    smaller document has in this very block. In the latter the key is the CRC of the string."""
    h = np.concatenate(heads)
    low: dict[bytes, int] = {}
    docs = h["doc"].tolist()
    for s, d in zip(strings, docs):
        if d < low.setdefault(s, d):
            low[s] = d
    if len(low) < len(strings):
        done = np.array([d > low[s] for s, d in zip(strings, docs)])
        known, h = h[done], h[~done]
        known["key"] = [zlib.crc32(s) for s, x in zip(strings, done.tolist()) if x]
        strings = [s for s, x in zip(strings, done.tolist()) if not x]
    else:
        known = h[:0]
    body = b"".join([*_columns(h), *_columns(known), b"\n".join(strings)])
    return len(h).to_bytes(4, "little") + len(known).to_bytes(4, "little") + zstandard.ZstdCompressor(level=3).compress(body)


def _unpack(block: bytes) -> tuple[np.ndarray, np.ndarray, bytes]:
    body = zstandard.ZstdDecompressor().decompress(block[8:])
    at, parts = 0, []
    for n in (int.from_bytes(block[:4], "little"), int.from_bytes(block[4:8], "little")):
        h = np.zeros(n, _HEAD)
        for name in _HEAD.names:
            h[name] = np.frombuffer(body, _HEAD[name], n, at)
            at += n * _HEAD[name].itemsize
        h["doc"] = np.cumsum(h["doc"])
        parts.append(h)
    return *parts, body[at:]


def _chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CHUNK_BYTES."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size < CHUNK_BYTES):
            size += len(texts[end])
            end += 1
        yield at, end
        at = end


def hot_minimisers(docs: DataFrame, text_col: str, window: int, buckets: int) -> np.ndarray:
    """Ascending keys of the minimisers that are hot, from a count over all documents.

    A task counts its own super-k-mers and names the keys that it has more than once, so a key is missed only below the
    limit plus one for each million that a task counts. No more than ``buckets / HOT_SHARE`` keys reach the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, total = [], 0, 0

        def flush() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            keys, n = keys[n > 1], n[n > 1]
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["key", "n"])

        for batch in batches:
            texts = utf8_views(batch.column(0))
            for a, b in _chunks(texts):
                held.append(super_kmers(texts[a:b], window)[-1])
                size += len(held[-1])
                total += len(held[-1])
                if size >= 1_000_000:
                    yield flush()
                    size = 0
        if held:
            yield flush()
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([total], pa.int64())], ["key", "n"])

    counts = docs.select(F.col(text_col).alias("text")).mapInArrow(tidy(count), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("key").isNull() | (F.col("n") >= HOT_LEAST))
    counts = materialize(counts, "minimisers")
    total = counts.filter("key IS NULL").agg(F.max("n")).first()[0] or 0
    found = counts.filter(F.col("key").isNotNull() & (F.col("n") >= total * HOT_SHARE / buckets)).select("key").collect()
    release(counts)
    return np.sort(np.array([r["key"] for r in found], np.int64).view(np.uint64))


def row_tag(id_col: str, text_col: str) -> Column:
    """0 for rows with an id, 32 bits of a hash of the text for others."""
    return F.when(F.col(id_col).isNull(), F.xxhash64(F.col(text_col)).bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.lit(0).cast("long"))


def cut_documents(docs: DataFrame, id_col: str, text_col: str, window: int, buckets: int, hot: np.ndarray) -> DataFrame:
    """``bucket, block``: the super-k-mers of all documents; those of ``hot`` minimisers as single windows."""
    if window + MAX_WINDOWS > 1 << 16:
        raise ValueError("the window is too long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads: dict[int, list[np.ndarray]] = {}
        strings: dict[int, list[bytes]] = {}
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal held
            keys = sorted(heads)
            out = pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([_pack(heads[k], strings[k]) for k in keys], pa.binary())], ["bucket", "block"])
            heads.clear()
            strings.clear()
            held = 0
            return out

        def cut(ids: list, tags: list, texts: list[bytes]) -> None:
            nonlocal held
            words, owner, inside, begin, n, key = super_kmers(texts, window)
            if not len(owner):
                return
            if len(hot):
                apart = hot[np.minimum(np.searchsorted(hot, key), len(hot) - 1)] == key
                if apart.any():
                    times = np.where(apart, n, 1)
                    step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    owner, inside, begin, n, key, apart = np.repeat(owner, times), np.repeat(inside, times) + step, np.repeat(begin, times) + step, np.repeat(np.where(apart, 1, n), times), np.repeat(key, times), np.repeat(apart, times)
                    single = np.flatnonzero(apart)
                    key[single] = np.array([xxhash.xxh64_intdigest(b" ".join(words[a : a + window])) for a in begin[single].tolist()], np.uint64)
            ids64 = np.array([NULL_ID if i is None else i for i in ids], np.int64)
            head = np.zeros(len(owner), _HEAD)
            head["doc"], head["start"], head["key"], head["words"] = ids64[owner], inside, (key >> np.uint64(8)).astype(np.uint32), n + window - 1
            head["tag"] = np.array(tags, np.int64)[owner]
            bucket = ((key * _A) >> np.uint64(33)).astype(np.int64) % buckets
            order = np.argsort(bucket, kind="stable")
            edges = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=buckets + 1))
            packed = [b" ".join(words[a : a + k]) for a, k in zip(begin[order].tolist(), head["words"][order].tolist())]
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                k = int(bucket[order[a]])
                heads.setdefault(k, []).append(head[order[a:b]])
                strings.setdefault(k, []).extend(packed[a:b])
            held += sum(map(len, packed)) + _HEAD.itemsize * len(packed)

        for batch in batches:
            ids, tags, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8_views(batch.column(2))
            for a, b in _chunks(texts):
                cut(ids[a:b], tags[a:b], texts[a:b])
                if held >= HOLD_BYTES:
                    yield flush()
        if heads:
            yield flush()

    return docs.select(F.col(id_col).cast("long").alias("id"), row_tag(id_col, text_col).alias("tag"), F.col(text_col).alias("text")).mapInArrow(tidy(run), "bucket int, block binary")


def _solve_run(rows: list[tuple[int, int, int, bytes]], window: int) -> Iterator[tuple[int, int, int, int, int]]:
    """Ranges (document, tag, first word, words, check) that repeat an earlier document, of the super-k-mers of one minimiser.

    Equal strings count once, for their smallest document. Their windows are sorted; of equal windows the first has the
    smallest document.
    """
    least: dict[bytes, int] = {}
    for doc, _, _, s in rows:
        if s not in least or doc < least[s]:
            least[s] = doc
    texts = list(least)
    windows = []
    for t, s in enumerate(texts):
        w = s.split(b" ")
        windows += [(b" ".join(w[i : i + window]), least[s], t, i) for i in range(len(w) - window + 1)]
    windows.sort()
    first: list[list[int]] = [[0] * (s.count(b" ") + 2 - window) for s in texts]
    for _, same in groupby(windows, key=lambda x: x[0]):
        low = None
        for _, doc, t, i in same:
            low = doc if low is None else low
            first[t][i] = low
    index = {s: t for t, s in enumerate(texts)}
    whole: dict[tuple[int, int, int], tuple[int, int]] = {}
    for doc, tag, start, s in rows:
        f = first[index[s]]
        n = len(f)
        i = 0
        while i < n:
            if f[i] >= doc:
                i += 1
                continue
            j = i
            while j + 1 < n and f[j + 1] < doc:
                j += 1
            key = (index[s], i, j)
            if key not in whole:
                whole[key] = (j - i + window, zlib.crc32(s if j - i == n - 1 else b" ".join(s.split(b" ")[i : j + window])))
            size, check = whole[key]
            yield doc, tag, start + i, size, check
            i = j + 1


def _solve_bucket(blocks: list[bytes], sizes: int, window: int) -> Iterator[list[tuple[int, int, int, int, int]]]:
    slices = max(1, -(-sizes // SLICE_BYTES))
    for part in range(slices):
        heads, strings = [], []
        for b in blocks:
            h, known, body = _unpack(b)
            if part == 0 and len(known):
                yield list(zip(*(known[c].tolist() for c in ("doc", "tag", "start", "words", "key"))))
            s = body.split(b"\n")
            if slices > 1:
                mine = np.flatnonzero(h["key"] % slices == part)
                h, s = h[mine], [s[k] for k in mine.tolist()]
            heads.append(h)
            strings.append(s)
        h = np.concatenate(heads)
        flat = [x for s in strings for x in s]
        if not len(h):
            continue
        order = np.lexsort((h["doc"], h["key"]))
        keys, docs = h["key"][order], h["doc"][order]
        at = np.flatnonzero(np.diff(keys.astype(np.int64), prepend=-1))
        ends = np.append(at[1:], len(keys))
        several = docs[at] != docs[ends - 1]
        out: list[tuple[int, int, int, int, int]] = []
        starts, tags = h["start"], h["tag"]
        for a, b in zip(at[several].tolist(), ends[several].tolist()):
            rows = [(int(h["doc"][k]), int(tags[k]), int(starts[k]), flat[k]) for k in order[a:b].tolist()]
            out += _solve_run(rows, window)
            if len(out) >= 100_000:
                yield out
                out = []
        if out:
            yield out


def repeated_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``id, tag, start, words, check``: word ranges of documents all of whose windows also start in a document of smaller id.

    ``check`` is the CRC of the range's words joined by spaces: a range holds for any row of that id that has these words
    there, so rows that repeat an id with another text are told apart. Null ids appear as the largest id, and ``tag`` tells
    their rows apart. Ids are integers, or a TypeError is raised.
    """
    need_integral(docs, id_col)
    buckets = 4 * partitions(docs.sparkSession)
    cut = cut_documents(docs, id_col, text_col, window, buckets, hot_minimisers(docs, text_col, window, buckets))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, blocks, size = None, [], 0

        def done():
            for rows in _solve_bucket(blocks, size, window):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()))], ["id", "tag", "start", "words", "check"])

        for batch in batches:
            for k, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k != bucket and blocks:
                    yield from done()
                    blocks, size = [], 0
                bucket = k
                blocks.append(block)
                size += zstandard.frame_content_size(block[8:])
        if blocks:
            yield from done()

    return cut.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(tidy(solve), "id long, tag long, start int, words int, check long")


def covered_words(words: list[bytes], ranges: list[dict]) -> np.ndarray:
    """Mask of the words inside ranges that hold for this text."""
    out = np.zeros(len(words), bool)
    for r in ranges:
        a, b = r["start"], r["start"] + r["words"]
        if b <= len(words) and zlib.crc32(b" ".join(words[a:b])) == r["check"]:
            out[a:b] = True
    return out


def _with_ranges(docs: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """The columns of ``docs`` and, as the last one, the ranges of each row's id (of its text, if that is null)."""
    i, tag, ranges = free_names(docs, "__id", "__tag", "__ranges")
    found = repeated_ranges(docs, id_col, text_col, window).groupBy(F.col("id").alias(i), F.col("tag").alias(tag)).agg(F.collect_list(F.struct("start", "words", "check")).alias(ranges))
    keyed = docs.withColumn(i, F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID))).withColumn(tag, row_tag(id_col, text_col))
    return keyed.join(found, [i, tag], "left").select(*docs.columns, ranges)


def substring_report(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of each document.

    Words are runs of anything but ASCII white space, unchanged. A word goes if a window that covers it also starts in a
    document of smaller id, judged on the input. Nulls: a null text has no words; a null id counts as larger than all ids.
    Documents of fewer words than a window keep them all. Rows that repeat an id do not repeat each other. Ids are integers.
    Empty tables give no rows; other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, kept = [], [], []
            for text, ranges in zip(utf8_views(batch.column(1)), batch.column(2).to_pylist()):
                words = text.split()
                if ranges:
                    gone = covered_words(words, ranges)
                    left = [w for w, g in zip(words, gone.tolist()) if not g]
                else:
                    left = words
                n.append(len(words))
                removed.append(len(words) - len(left))
                kept.append(hashlib.sha256(b" ".join(left)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    joined = _with_ranges(docs.select("doc_id", "text"), "doc_id", "text", window)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(tidy(run), f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars", window: int = WINDOW) -> DataFrame:
    """Documents without their repeated words; texts without any stay byte for byte. White space goes with the word before
    it. A text of which nothing is left is taken out; ``chars_col``, if there, is the new length. Other columns stay, whatever
    their names. Nulls, repeated rows and empty tables as ``substring_report``; ids are integers."""
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keep, sizes = [], [], []
            old = batch.column(at).to_pylist()
            for text, ranges in zip(old, batch.column(len(names)).to_pylist()):
                if ranges:
                    raw = text.encode()
                    gone = covered_words(raw.split(), ranges)
                    if gone.any():
                        spans = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", raw)]
                        text = b"".join(raw[a:b] for (a, b), g in zip(spans, gone.tolist()) if not g).decode().rstrip(" \t\n\r\x0b\x0c")
                        keep.append(not gone.all())
                    else:
                        keep.append(True)
                else:
                    keep.append(True)
                texts.append(text)
                sizes.append(None if text is None else len(text))
            cols = [batch.column(k) for k in range(len(names))]
            cols[at] = pa.array(texts, cols[at].type)
            if chars_col in names:
                k = names.index(chars_col)
                cols[k] = pa.array([s if t is not o else c for s, t, o, c in zip(sizes, texts, old, cols[k].to_pylist())], cols[k].type)
            yield pa.RecordBatch.from_arrays(cols, names).filter(pa.array(keep, pa.bool_()))

    return _with_ranges(docs, id_col, text_col, window).mapInArrow(tidy(run), docs.schema)
