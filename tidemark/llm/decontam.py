"""Benchmark decontamination by Wu-Manber multi-pattern search over whole, normalised texts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import WORD_BYTES, free_names, map_arrow, tidy, utf8_views

#: Log2 of the entries of a shift table, and the bytes of a shift block.
TABLE_BITS, BLOCK = 22, 8
#: Bytes of benchmark text whose patterns are searched in one pass; larger benchmarks take several passes over the documents.
PASS_BYTES = 32 << 20
#: Normalised bytes that are searched together, in lanes of LANE bytes each.
CHUNK_BYTES, LANE = 8 << 20, 4096
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


def patterns_of(text: bytes, window: int) -> list[bytes]:
    """The windows of one benchmark item; an item of fewer words is one window, an item without words has none."""
    w = words_of(text)
    return [b" " + b" ".join(w[i : i + window]) + b" " for i in range(max(1, len(w) - window + 1))] if w else []


class WuManber:
    """Patterns of similar length with one shift table and suffix-hash buckets.

    ``m`` is the shortest pattern. A block is the last ``b`` bytes at a cursor; its shift is how far the cursor may jump
    before a block of the first ``m`` bytes of some pattern can end there. Shift 0 selects a bucket by the block's full
    hash; the bucket's patterns are compared with the text byte by byte.
    """

    def __init__(self, patterns: Iterable[bytes]):
        self.patterns = sorted(set(patterns))
        self.m = min(map(len, self.patterns))
        self.b = min(BLOCK, self.m)
        self.shift = np.full(1 << TABLE_BITS, self.m - self.b + 1, np.int32)
        self.buckets: dict[int, list[int]] = {}
        heads = np.frombuffer(b"".join(p[: self.m] for p in self.patterns), np.uint8).reshape(-1, self.m)
        for end in range(self.b, self.m + 1):
            h = self._hash(heads[:, end - self.b : end])
            np.minimum.at(self.shift, self._slot(h), self.m - end)
        for k, h in enumerate(h.tolist()):
            self.buckets.setdefault(h, []).append(k)
        self.known = np.sort(np.array(list(self.buckets), np.uint64))

    def _hash(self, block: np.ndarray) -> np.ndarray:
        h = np.zeros(len(block), np.uint64)
        for k in range(self.b):
            h = (h << np.uint64(8)) | block[:, k].astype(np.uint64)
        return h * _MIX

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def find(self, text: bytes) -> Iterator[tuple[int, int]]:
        """(start, pattern) of every occurrence. Lanes of the text move in lockstep, each by its own shifts."""
        a = np.frombuffer(text, np.uint8)
        m, b = self.m, self.b
        if len(a) < m:
            return
        end = np.arange(m, len(a) + 1, LANE)
        stop = np.minimum(end + LANE, len(a) + 1)
        back = np.arange(-b, 0)
        while len(end):
            h = self._hash(a[end[:, None] + back])
            jump = self.shift[self._slot(h)]
            at = np.flatnonzero(jump == 0)
            if len(at):
                at = at[self.known[np.minimum(np.searchsorted(self.known, h[at]), len(self.known) - 1)] == h[at]]
                for e, key in zip(end[at].tolist(), h[at].tolist()):
                    for k in self.buckets[key]:
                        if text.startswith(self.patterns[k], e - m):
                            yield e - m, k
            end = end + np.maximum(jump, 1)
            live = end < stop
            end, stop = end[live], stop[live]


class Searcher:
    """All patterns of a benchmark: a Wu-Manber table for each class of pattern length, so that short items don't shorten
    the jumps made for long ones."""

    def __init__(self, items: Iterable[tuple[str | None, bytes]], window: int):
        self.owners: dict[bytes, list[str]] = {}
        classes: dict[int, set[bytes]] = {}
        for item, text in items:
            for p in patterns_of(text, window):
                if item not in (own := self.owners.setdefault(p, [])) and item is not None:
                    own.append(item)
                n = p.count(b" ") - 1
                classes.setdefault(window if n >= window else n.bit_length(), set()).add(p)
        self.tables = [WuManber(x) for _, x in sorted(classes.items())]
        self.n_words = {p: p.count(b" ") - 1 for p in self.owners}

    def search(self, texts: list[bytes]) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
        """For each text: its number of words, merged [from, to) ranges of hit words, sorted item ids."""
        out: list = []
        group: list[bytes] = []
        size = 0
        for t in texts:
            n = b" ".join(words_of(t))
            group.append(n)
            size += len(n)
            if size >= CHUNK_BYTES:
                out += self._group(group)
                group, size = [], 0
        return out + self._group(group)

    def _group(self, norm: list[bytes]) -> list:
        if not norm:
            return []
        joined = b" " + b" \x00 ".join(norm) + b" "
        starts = np.cumsum([0] + [len(n) + 3 for n in norm[:-1]])
        hits: dict[int, list[tuple[int, bytes]]] = {}
        for table in self.tables:
            for start, k in table.find(joined):
                doc = int(np.searchsorted(starts, start, "right")) - 1
                hits.setdefault(doc, []).append((start - int(starts[doc]), table.patterns[k]))
        out = []
        for d, n in enumerate(norm):
            items: set[str] = set()
            ranges: list[list[int]] = []
            if d in hits:
                spaces = np.flatnonzero(np.frombuffer(b" " + n, np.uint8) == 32)
                for start, p in sorted(hits[d]):
                    first = int(np.searchsorted(spaces, start))
                    items.update(self.owners[p])
                    if ranges and first <= ranges[-1][1]:
                        ranges[-1][1] = max(ranges[-1][1], first + self.n_words[p])
                    else:
                        ranges.append([first, first + self.n_words[p]])
            out.append((n.count(b" ") + 1 if n else 0, [tuple(r) for r in ranges], sorted(items)))
        return out


def benchmark_passes(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", pass_bytes: int = PASS_BYTES) -> list[list[tuple[str | None, bytes]]]:
    """The stated query set in blocks of at most ``pass_bytes`` (one item at least); each block is one search pass."""
    blocks: list[list[tuple[str | None, bytes]]] = []
    size = pass_bytes
    for item, text in benchmark.select(F.col(item_col).cast("string"), F.col(text_col)).toLocalIterator():
        if text is None:
            continue
        if size >= pass_bytes:
            blocks.append([])
            size = 0
        blocks[-1].append((item, raw := text.encode()))
        size += len(raw)
    return blocks


def contaminated(n_hit, n_words, share: int = 20):
    return n_hit > 0 and share * n_hit >= n_words


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """Benchmark passages inside documents: ``id, n_words, ranges array<struct<from,to>>, items array<string>``.

    Words: A-Z lower-cased, then runs of ASCII letters, digits and characters beyond ASCII. A window is ``window``
    consecutive words of an item, or the whole of a shorter item. ``ranges`` are the merged word ranges inside any
    occurrence, ``items`` the sorted ids of items with an occurrence.

    Nulls: a null text has no words; benchmark items with null text are not searched, those with null id give ranges and no
    items; a null document id stays null. Empty tables give no rows (documents) or no hits (benchmark). Repeated rows each
    keep their row. Other columns, of any name, are ignored. A benchmark above ``pass_bytes`` is searched in several passes whose hits are merged per row.
    """
    schema = "id {t}, n_words long, ranges array<struct<`from`:int,`to`:int>>, items array<string>".format(t=docs.schema[id_col].dataType.simpleString())
    arrow_ranges = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))

    def one(found: Searcher | list):
        made: list[Searcher] = []

        def search(batch: pa.RecordBatch) -> pa.RecordBatch:
            if not made:
                made.append(Searcher(found, window))
            got = made[0].search(utf8_views(batch.column(1)))
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([g[0] for g in got], pa.int64()), pa.array([[{"from": a, "to": b} for a, b in g[1]] for g in got], arrow_ranges), pa.array([g[2] for g in got], pa.list_(pa.string()))],
                ["id", "n_words", "ranges", "items"],
            )

        return search

    passes = benchmark_passes(benchmark, text_col="text", pass_bytes=pass_bytes)
    if len(passes) <= 1:
        return map_arrow(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), one(passes[0] if passes else []), schema)
    # Several passes: rows are told apart by id and text hash; equal rows have equal hits, so each keeps a place of its own.
    keyed = docs.select(F.struct(F.col(id_col).alias("id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("h")).alias("id"), F.col(text_col).alias("text"))
    nested = "id struct<id:{t},h:string>, n_words long, ranges array<struct<`from`:int,`to`:int>>, items array<string>".format(t=docs.schema[id_col].dataType.simpleString())
    parts = [map_arrow(keyed, one(block), nested).withColumn("pass", F.lit(k)) for k, block in enumerate(passes)]
    allp = parts[0]
    for p in parts[1:]:
        allp = allp.unionByName(p)
    merged = allp.groupBy("id").agg(
        F.max("n_words").alias("n_words"), F.flatten(F.collect_list("ranges")).alias("ranges"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.count_if(F.col("pass") == 0).cast("int").alias("copies")
    )

    def merge(batch: pa.RecordBatch) -> pa.RecordBatch:
        joined = []
        for ranges in batch.column(2).to_pylist():
            out: list[dict] = []
            for r in sorted(ranges, key=lambda r: (r["from"], r["to"])):
                if out and r["from"] <= out[-1]["to"]:
                    out[-1] = {"from": out[-1]["from"], "to": max(out[-1]["to"], r["to"])}
                else:
                    out.append(r)
            joined.append(out)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(joined, arrow_ranges), batch.column(3)], ["id", "n_words", "ranges", "items"])

    each = merged.select(F.col("id.id").alias("id"), "n_words", "ranges", "items", F.explode(F.sequence(F.lit(1), "copies"))).drop("col")
    return map_arrow(each, merge, schema)


def decontamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: words, hit words, items, and whether a twentieth or more of the words are benchmark passages."""
    f = find_contamination(docs, benchmark)
    n_hit = F.aggregate("ranges", F.lit(0).cast("long"), lambda a, r: a + r["to"] - r["from"])
    return f.select(
        F.col("id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    ).select("*", ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13) -> DataFrame:
    """Documents without those that are contaminated; columns stay as they are.

    Nulls, empty tables and repeated rows: as ``find_contamination``. One pass over the documents without a shuffle; a
    benchmark of several passes is judged on the merged hits, joined by id and text hash.
    """
    at = docs.columns.index(text_col)
    passes = benchmark_passes(benchmark)
    if not passes:
        return docs
    if len(passes) == 1:

        def keep(batches):
            s = Searcher(passes[0], window)
            for batch in batches:
                got = s.search(utf8_views(batch.column(at)))
                yield batch.filter(pa.array([not contaminated(sum(b - a for a, b in r), n) for n, r, _ in got], pa.bool_()))

        return docs.mapInArrow(tidy(keep), docs.schema)
    key = F.struct(F.col(id_col).alias("id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("h"))
    found = find_contamination(docs.select(key.alias("id"), F.col(text_col).alias("text")), benchmark, "id", "text", window)
    n_hit = F.aggregate("ranges", F.lit(0), lambda a, r: a + r["to"] - r["from"])
    (name,) = free_names(docs, "__key")
    bad = found.filter((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).select(F.to_json("id").alias(name)).distinct()
    return docs.withColumn(name, F.to_json(key)).join(bad, name, "left_anti").select(*docs.columns)
