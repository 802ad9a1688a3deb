"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within ``radius`` bits meet at a fingerprint within half that of both. Emitting such a ball over all 64 bits
is 2081 variants for radius 3, since half of it is rounded up; so the bits are cut into three blocks, and two fingerprints
within 3 bits are within 2 bits on some pair of blocks. Each fingerprint emits, for each pair of blocks, all variants within
one bit there (3 times 43 or 44), variants are shuffled together, and fingerprints that collide are compared in full.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import free_names, map_arrow, materialize, tidy, utf8_views
from tidemark.llm.components import connected_components

SEED = 42


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of each shingle of ``width`` words, repeats included; the whole sequence if shorter; none without words."""
    w = text.lower().split()  # bytes.lower() folds A-Z alone
    if not w:
        return np.zeros(0, np.uint64)
    joined = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
    n = max(1, len(w) - width + 1)
    starts = np.concatenate([[0], ends[: n - 1]]).tolist()
    stops = (ends[min(width, len(w)) - 1 :][:n] - 1).tolist()
    h = xxhash.xxh64_intdigest
    return np.array([h(joined[a:b], SEED) for a, b in zip(starts, stops)], np.uint64)


def simhash(hashes: np.ndarray) -> int:
    """Bit k is 1 if it is set in over half of the hashes."""
    n = len(hashes)
    if not n:
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        ones += np.unpackbits(hashes[at : at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprint_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``id, fp``: the SimHash of every whole text, as a signed long of the same bits. Null texts have no words."""
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, fp long"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([simhash(shingle_hashes(t, width)) for t in utf8_views(batch.column(1))], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    return map_arrow(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, schema)


def ball_masks(radius: int, blocks: int) -> list[tuple[int, np.ndarray]]:
    """For each choice of blocks: the bits it keeps, and the flips within half the distance that is left there."""
    edges = [round(k * 64 / blocks) for k in range(blocks + 1)]
    out = []
    keep = blocks - 1 if blocks > 1 else 1
    for chosen in combinations(range(blocks), keep):
        bits = [b for c in chosen for b in range(edges[c], edges[c + 1])]
        # Of all choices, one has at most radius * keep / blocks of the differing bits.
        half = -(-(radius * keep // blocks) // 2)
        flips = [sum(1 << b for b in some) for k in range(half + 1) for some in combinations(bits, k)]
        out.append((sum(1 << b for b in bits), np.array(flips, np.uint64)))
    return out


def variants(fps: np.ndarray, radius: int, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, fingerprint) of every variant; the choice of blocks is told apart by the bits it leaves out."""
    keys, owners = [], []
    for k, (mask, flips) in enumerate(ball_masks(radius, blocks)):
        v = (fps & np.uint64(mask))[:, None] ^ flips[None, :]
        free = [b for b in range(64) if not mask >> b & 1]
        if free:  # room outside the kept bits to tell the choices apart
            v = v | np.uint64(sum(1 << b for b, on in zip(free, f"{k + 1:b}"[::-1]) if on == "1"))
        keys.append(v.ravel())
        owners.append(np.repeat(fps, len(flips)))
    return np.concatenate(keys), np.concatenate(owners)


def bit_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def spanning_links(members: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that join the members of a bucket exactly as all pairs within ``radius`` would: a search that visits each
    member once and takes its unvisited neighbours, so a dense bucket costs little more than its size."""
    left = members
    out = []
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            near = bit_distance(left, x) <= radius
            if near.any():
                got = left[near]
                out += [(int(x), int(y)) for y in got]
                front += list(got)
                left = left[~near]
    return out


def links(fps: DataFrame, radius: int = 3, blocks: int = 3) -> DataFrame:
    """``a, b``: links between different fingerprints (column ``fp``, distinct) that connect exactly those within ``radius``.

    Every pair within ``radius`` is connected by the links of the buckets in which it meets; no bucket emits all its pairs.
    """

    def emit(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        all_fps = batch.column(0).to_numpy().view(np.uint64)
        for at in range(0, len(all_fps), 4096):
            keys, owners = variants(all_fps[at : at + 4096], radius, blocks)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(owners.view(np.int64))], ["key", "fp"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k, held_f = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def solve(k: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            cut = np.flatnonzero(np.diff(k)) + 1
            starts, sizes = np.concatenate([[0], cut]), np.diff(np.concatenate([[0], cut, [len(k)]]))
            two = starts[sizes == 2]
            a, b = f[two], f[two + 1]
            near = bit_distance(a, b) <= radius
            pairs = [(a[near], b[near])]
            for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
                if got := spanning_links(f[s : s + n], radius):
                    g = np.array(got, np.uint64)
                    pairs.append((g[:, 0], g[:, 1]))
            a, b = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
            a, b = np.minimum(a, b), np.maximum(a, b)
            ab = np.unique(np.stack([a, b], 1), axis=0) if len(a) else np.zeros((0, 2), np.uint64)
            return pa.RecordBatch.from_arrays([pa.array(ab[:, 0].copy().view(np.int64)), pa.array(ab[:, 1].copy().view(np.int64))], ["a", "b"])

        for batch in batches:
            held_k = np.concatenate([held_k, batch.column(0).to_numpy()])
            held_f = np.concatenate([held_f, batch.column(1).to_numpy().view(np.uint64)])
            whole = int(np.searchsorted(held_k, held_k[-1])) if len(held_k) else 0  # the last bucket may go on
            if whole:
                yield solve(held_k[:whole], held_f[:whole])
                held_k, held_f = held_k[whole:], held_f[whole:]
        if len(held_k):
            yield solve(held_k, held_f)

    out = map_arrow(fps.select("fp"), emit, "key long, fp long").repartition("key").sortWithinPartitions("key", "fp").mapInArrow(tidy(meet), "a long, b long")
    return out.distinct()


def cluster(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 3, blocks: int = 3) -> DataFrame:
    """``id, fp, component_id``: each document's fingerprint and the smallest id that is reachable through fingerprints
    within ``radius`` bits of each other.

    Nulls: a null text has no words and fingerprint zero, like any text without words; a null id is never the smallest
    (a component of null ids alone has a null component). Repeated rows keep their rows. Empty tables give no rows. Other
    columns are not looked at. Copies meet by their fingerprint, so that a group of them counts once from there on.
    """
    rows = materialize(fingerprint_rows(docs, id_col, text_col, width), "simhash")
    classes = materialize(rows.groupBy("fp").agg(F.min("id").alias("first")), "simhash-classes")
    found = materialize(links(classes, radius, blocks), "simhash-links")
    parts = connected_components(found)
    # Components of one fingerprint need no label; the others take the smallest id of their fingerprints.
    joined = classes.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("part", F.coalesce("part", "fp"))
    least = joined.groupBy("part").agg(F.min("first").alias("component_id"))
    return rows.join(joined.select("fp", "part").join(least, "part").select("fp", "component_id"), "fp").select("id", "fp", "component_id")


#: Near-duplicates by similarity: texts whose fingerprints, over shingles of FP_WORDS words, are within NEAR_BITS meet first.
#: On one of two blocks such fingerprints are within 2 bits, so the ball is that of 3 bits: 66 variants in all.
FP_WORDS, NEAR_BITS, NEAR_BLOCKS = 3, 5, 2
#: Pairs of fingerprints further apart meet by BANDS keys of BAND_ROWS minima each. Texts of similarity J share a key with a chance of
#: 1 - (1 - J ** BAND_ROWS) ** BANDS, however the edits lie: all but 4e-7 of pairs at 0.8, 3e-8 at 0.83.
BANDS, BAND_ROWS = 28, 4
#: Size of the sketch by which candidates are sifted: the smallest shingle hashes. Texts of fewer shingles are compared
#: exactly; the error for others is about sqrt(s * (1 - s) / SKETCH), 0.025 at a similarity of 0.8. Pairs within SLACK of the
#: threshold, six times that, are decided on all of their shingles.
SKETCH, SLACK = 256, 0.15
#: Classes in doubt, of 16 bytes each, up to which they are broadcast.
FEW = 200_000
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def _mixed(x: np.ndarray, k: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX[k % 5] + np.uint64(k)
    x = (x ^ (x >> np.uint64(29))) * _MIX[(k + 2) % 5]
    return x ^ (x >> np.uint64(32))


#: An odd multiplier for each order.
_ORDERS = _mixed(np.arange(1, BANDS * BAND_ROWS + 1, dtype=np.uint64), 5) | np.uint64(1)


def _word_shingles(h: np.ndarray, width: int) -> np.ndarray:
    """Distinct hashes of shingles of word hashes; the whole sequence if shorter."""
    n = max(1, len(h) - width + 1) if len(h) else 0
    out = np.zeros(n, np.uint64)
    for k in range(min(width, len(h))):
        out = _mixed(out + h[k : k + n], k)
    return np.unique(out)


def min_bands(shingles: np.ndarray) -> np.ndarray:
    """BANDS keys of a set of shingle hashes, each from its minima under BAND_ROWS orders. Sets share a key with a chance that
    depends on their Jaccard similarity alone."""
    if not len(shingles):
        return np.zeros(BANDS, np.uint64)
    low = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(shingles), 2048):
        low = np.minimum(low, (_ORDERS[:, None] * _mixed(shingles[at : at + 2048], 3)[None, :]).min(1))
    low, out = low.reshape(BANDS, BAND_ROWS), np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(BAND_ROWS):
        out = _mixed(out + low[:, k], k)
    return out


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Ascending hashes of the distinct shingles of ``width`` words."""
    return np.unique(_word_shingles(np.fromiter(map(xxhash.xxh64_intdigest, text.lower().split()), np.uint64), width) >> np.uint64(32))


def describe(text: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Band keys and the ascending hashes of all distinct shingles of ``width`` words; the first SKETCH are the sketch."""
    shingles = shingle_set(text, width)
    return min_bands(shingles), shingles


class Sketches:
    """Similarities of one sketch to all of a set, by an index from hashes to the sketches that hold them.

    Two sketches are complete up to the smaller of their largest hashes (a sketch that is not full is complete); up to there
    they are compared exactly. ``size`` is that of a full sketch; without one all are complete.
    """

    def __init__(self, sketches: list[np.ndarray], size: float = SKETCH):
        self.sketches = sketches
        self.sizes = np.array([len(x) for x in sketches])
        self.values = np.concatenate(sketches).astype(np.int64)
        self.rows = np.repeat(np.arange(len(sketches)), self.sizes)
        self.top = np.array([int(x[-1]) if len(x) >= size else 1 << 40 for x in sketches])
        ids = np.unique(self.values, return_inverse=True)[1]
        order = np.argsort(ids, kind="stable")
        self.holders = self.rows[order]
        counts = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
        self.from_, self.counts = np.cumsum(counts) - counts, counts
        self.begin = np.concatenate([[0], np.cumsum(self.sizes)])
        self.ids = ids
        self.keys = (self.rows << 33) | self.values  # ascending, to count a sketch's hashes up to a bound
        self.empty = np.flatnonzero(self.sizes == 0)

    def near(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """The sketches that share a hash with sketch ``i`` (all empty ones, if it is empty) and their similarities; others
        have none. Costs what those sketches share, whatever the size of the set."""
        if not self.sizes[i]:
            return self.empty, np.ones(len(self.empty))
        mine = self.ids[self.begin[i] : self.begin[i + 1]]
        n = self.counts[mine]
        at = np.repeat(self.from_[mine] - np.cumsum(n) + n, n) + np.arange(n.sum())
        found, both = np.unique(self.holders[at], return_counts=True)
        theirs = np.searchsorted(self.keys, (found << 33) | min(int(self.top[i]), (1 << 33) - 1), "right") - self.begin[found]
        own = np.searchsorted(self.values[self.begin[i] : self.begin[i + 1]], self.top[found], "right")
        total = np.where(self.top[found] < self.top[i], self.sizes[found] + own, theirs + self.sizes[i]) - both
        return found, both / total

    def similarities(self, i: int) -> np.ndarray:
        """To every sketch of the set."""
        out = np.zeros(len(self.sketches))
        found, s = self.near(i)
        out[found] = s
        return out


def sketch_similarity(a: np.ndarray, b: np.ndarray, size: float = SKETCH) -> float:
    """Jaccard similarity of two sketches; exact when neither is full."""
    top = min(int(x[-1]) if len(x) >= size else 1 << 40 for x in (a, b))
    a, b = a[: np.searchsorted(a, top, "right")], b[: np.searchsorted(b, top, "right")]
    both = len(np.intersect1d(a, b, assume_unique=True))
    total = len(a) + len(b) - both
    return both / total if total else 1.0


def _similar_links(cids: list[int], sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links that join the members of a set exactly as all pairs of the given similarity would, from all of their shingles."""
    if len(cids) == 2:
        return [(cids[0], cids[1])] if sketch_similarity(*sets, size=np.inf) >= similarity else []
    index = Sketches(sets, np.inf)
    left, out = np.ones(len(cids), bool), []
    for first in range(len(cids)):
        if not left[first]:
            continue
        front, left[first] = [first], False
        while front:
            x = front.pop()
            found, got = index.near(x)
            found = found[left[found] & (got >= similarity)]
            out += [(cids[x], cids[y]) for y in found.tolist()]
            front += found.tolist()
            left[found] = False
    return out


def _sift(cids: list[int], sketches: list[np.ndarray], similarity: float) -> tuple[list[tuple[int, int]], list[tuple[int, int]], bool]:
    """(links, doubtful pairs, whole): links that the sketches are sure of, and pairs that they cannot decide and that no such
    links join. With over four of them a member it stops: all shingles of the ``whole`` set are to be compared."""
    full = np.array([len(x) >= SKETCH for x in sketches])
    index = Sketches(sketches)
    part, left, out, doubts = np.zeros(len(cids), np.int64), np.ones(len(cids), bool), [], []
    for own in range(len(cids)):
        if not left[own]:
            continue
        front, left[own], part[own] = [own], False, own
        while front:
            x = front.pop()
            found, got = index.near(x)
            found, got = found[left[found]], got[left[found]]
            rough = full[found] | full[x]
            near = got >= np.where(rough, similarity + SLACK, similarity)
            doubts += [(x, y) for y in found[~near & rough & (got >= similarity - SLACK)].tolist()]
            if len(doubts) > 4 * len(cids):
                return out, [], True
            found = found[near]
            part[found], left[found] = own, False
            out += [(cids[x], cids[y]) for y in found.tolist()]
            front += found.tolist()
    return out, [(cids[x], cids[y]) for x, y in doubts if part[x] != part[y]], False


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """``id, h, group``: near-duplicate groups of rows by word shingles: copies, and texts linked by chains of pairs with a
    Jaccard similarity of ``similarity`` or more; ``group`` is the smallest id. ``h`` is the text's hash.

    SimHash fingerprints come first, as in ``cluster``: texts whose fingerprints are connected by steps of NEAR_BITS bits or
    fewer, found by ball hashing, are one candidate set. Pairs that differ in more bits share one of BANDS keys made of minima
    over the shingles: a pair at 0.8 fails to with a chance of 4e-7, whether its edits are scattered or in one block. Buckets
    whose members the first step has joined are done. All members of a set are compared, each set of members once, and what
    sketches cannot decide is decided on all shingles. Nulls: a null text is empty, texts without words are copies of each
    other; a null id is larger than all others.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def first(batch: pa.RecordBatch) -> pa.RecordBatch:
        bands, sketches, cids, fps = [], [], [], []
        for t in utf8_views(batch.column(2)):
            fps.append(simhash(shingle_hashes(t, FP_WORDS)))
            b, s = describe(t, width)
            bands.append((b >> np.uint64(32)).astype("<u4").tobytes())
            sketches.append(s[:SKETCH].astype("<u4").tobytes())
            cids.append(xxhash.xxh64_intdigest(s.tobytes()))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bands, pa.binary()), pa.array(sketches, pa.binary()), pa.array(np.array(cids, np.uint64).view(np.int64)), pa.array(np.array(fps, np.uint64).view(np.int64))], ["id", "h", "bands", "shingles", "cid", "fp"])

    def whole(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t, width).astype("<u4").tobytes() for t in utf8_views(batch.column(1))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["cid", "shingles"])

    keyed = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"), F.col(text_col).alias("text"))
    # A class (cid) is one set of shingles: copies, and texts that differ in case or white space alone, or in repeats.
    rows = materialize(map_arrow(keyed, first, f"id {kind}, h long, bands binary, shingles binary, cid long, fp long"), "near-rows")
    # One row stands for a class: that of its smallest id. Its sketch stays in the table of rows until it is asked for.
    classes = materialize(rows.groupBy("cid").agg(F.min("id").alias("low"), F.min_by("h", F.struct(F.col("id").isNull(), "id", "h")).alias("low_h"), F.first("bands").alias("bands")), "near-classes")

    def emit(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        short = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u4").reshape(-1, BANDS)
        keys = (short.astype(np.int64) | np.arange(BANDS) << 32).reshape(-1)
        yield pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(np.repeat(batch.column(j).to_numpy(), BANDS)) for j in range(2))], ["key", "cid", "root"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Members of buckets that are not joined yet, under a hash of the set, so that equal sets meet."""
        held = [np.zeros(0, np.int64) for _ in range(3)]

        def several(k: np.ndarray, c: np.ndarray, root: np.ndarray) -> pa.RecordBatch:
            starts = np.concatenate([[0], np.flatnonzero(np.diff(k)) + 1])
            sizes = np.diff(np.append(starts, len(k)))
            apart = np.minimum.reduceat(root, starts) < np.maximum.reduceat(root, starts)
            c, sizes = c[np.repeat(apart, sizes)], sizes[apart]
            sums = np.add.reduceat(_mixed(c.view(np.uint64), 3), np.cumsum(sizes) - sizes) if len(c) else np.zeros(0, np.uint64)
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(sums, sizes).view(np.int64)), pa.array(c)], ["set", "cid"])

        for batch in batches:
            held = [np.concatenate([h, batch.column(j).to_numpy()]) for j, h in enumerate(held)]
            whole = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
            if whole:
                yield several(*[h[:whole] for h in held])
                held = [h[whole:] for h in held]
        if len(held[0]):
            yield several(*held)

    def by_set(solve):
        """Runs ``solve(set, cids, shingles)`` for each set of rows that are sorted by set and cid; it returns rows (set, a, b)."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, cids, sets, done = None, [], [], []

            def flush():
                out = pa.RecordBatch.from_arrays([pa.array([x[j] for x in done], pa.int64()) for j in range(3)], ["set", "a", "b"])
                done.clear()
                return out

            for batch in batches:
                for k, c, s in zip(*(batch.column(n).to_pylist() for n in ("set", "cid", "shingles"))):
                    if k != now and cids:
                        if len(cids) > 1:
                            done.extend(solve(now, cids, sets))
                        cids, sets = [], []
                        if len(done) >= 20_000:
                            yield flush()
                    now = k
                    if cids and cids[-1] == c:  # a row that repeats the class's first
                        continue
                    cids.append(c)
                    sets.append(np.frombuffer(s, "<u4"))
            if len(cids) > 1:
                done.extend(solve(now, cids, sets))
            if done:
                yield flush()

        return run

    def sift(k: int, cids: list[int], sketches: list[np.ndarray]) -> list[tuple]:
        """Links, each to the first member of its part, have no set; a doubtful pair is a set of its own, the same wherever it
        is met."""
        sure, doubts, whole = _sift(cids, sketches, similarity)
        roots: dict[int, int] = {}
        for a, b in sure:
            roots[b] = roots.get(a, a)
        open_ = [(k, c, None) for c in cids] if whole else []
        if doubts:
            ab = np.array(doubts, np.int64)
            keys = _mixed(_mixed(ab.view(np.uint64)[:, 0], 1) + ab.view(np.uint64)[:, 1], 2).view(np.int64).tolist()
            open_ += [(p, c, None) for p, pair in zip(keys, doubts) for c in pair]
        return [(None, a, b) for b, a in roots.items()] + open_

    def decide(k: int, cids: list[int], sets: list[np.ndarray]) -> list[tuple]:
        return [(None, a, b) for a, b in _similar_links(cids, sets, similarity)]

    firsts = classes.select("cid", F.col("low").alias("__l"), F.col("low_h").alias("__lh"))
    known = lambda firsts: rows.join(firsts, "cid").filter(F.col("id").eqNullSafe(F.col("__l")) & (F.col("h") == F.col("__lh"))).select("cid", "shingles")

    def compared(sets: DataFrame, shingles: DataFrame, solve) -> DataFrame:
        return sets.join(shingles, "cid").select("set", "cid", "shingles").repartition("set").sortWithinPartitions("set", "cid").mapInArrow(tidy(by_set(solve)), "set long, a long, b long").distinct()

    balls = materialize(links(rows.select("fp").distinct(), NEAR_BITS, NEAR_BLOCKS), "near-balls")
    parts = connected_components(balls).withColumnRenamed("node", "fp")
    # Copies have one class and one fingerprint. A class has several if its texts repeat shingles unequally often.
    alike = rows.select("cid", "fp").distinct().join(parts, "fp", "left").select(F.coalesce("part", "fp").alias("set"), "cid").distinct()
    alike = materialize(alike.join(alike.groupBy("set").count().filter("count > 1").select("set"), "set"), "near-alike")
    close = materialize(compared(alike, known(firsts.join(alike.select("cid").distinct(), "cid")), sift), "near-close")
    # Classes of one root are joined already; of several roots, which a class of several fingerprints may have, any will do.
    roots = close.filter(F.col("set").isNull()).groupBy(F.col("b").alias("cid")).agg(F.min("a").alias("root"))
    keys = map_arrow(classes.join(roots, "cid", "left").select("cid", F.coalesce("root", "cid").alias("root"), "bands"), emit, "key long, cid long, root long")
    met = keys.repartition("key").sortWithinPartitions("key", "cid").mapInArrow(tidy(gather), "set long, cid long").distinct()
    sifted = materialize(compared(met, known(firsts), sift), "near-sifted").unionByName(close)
    undecided = sifted.filter(F.col("set").isNotNull()).select("set", F.col("a").alias("cid"))
    # All shingles are made again, from one text of each class that is in doubt; few such classes are sent to the texts.
    asked = materialize(classes.join(undecided.select("cid").distinct(), "cid").select("cid", F.col("low_h").alias("h")), "near-asked")
    texts = keyed.select("h", "text").join(F.broadcast(asked) if asked.count() <= FEW else asked, "h").select("cid", "text")
    decided = compared(undecided, map_arrow(texts, whole, "cid long, shingles binary").groupBy("cid").agg(F.first("shingles").alias("shingles")), decide)
    found = materialize(sifted.filter(F.col("set").isNull()).unionByName(decided).select("a", "b").distinct(), "near-links")
    parts = connected_components(found)
    joined = classes.select("cid", "low").join(parts.withColumnRenamed("node", "cid"), "cid", "left").withColumn("part", F.coalesce("part", "cid"))
    least = joined.groupBy("part").agg(F.min("low").alias("group"))
    return rows.select("id", "h", "cid").join(joined.select("cid", "part").join(least, "part").select("cid", "group"), "cid").select("id", "h", "group")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """One document of each near-duplicate group, that of the smallest id; columns stay as they are. Of rows that repeat that
    id and its text one stays. A group of null ids alone keeps one row of each text. Ids may be of any type that has an order;
    other columns may have any name."""
    groups = similar_groups(docs, id_col, text_col, width, similarity)
    i, h = free_names(docs, "__i", "__h")
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\x00"))
    go = groups.filter(~F.col("id").eqNullSafe(F.col("group"))).select(name("id").alias(i), F.col("h").alias(h)).distinct()
    keyed = docs.withColumn(i, name(id_col)).withColumn(h, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    # The repeats of a row go by the keys of the join, so texts move once.
    return keyed.join(go, [i, h], "left_anti").dropDuplicates([i, h]).select(*docs.columns)


def near_duplicate_report(docs: DataFrame) -> DataFrame:
    """Per document: its fingerprint in hex and the smallest document it is linked with."""
    return cluster(docs).select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, F.lit("0")).alias("fingerprint"), "component_id")
