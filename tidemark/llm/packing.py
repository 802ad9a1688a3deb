"""Sequence packing by cutting-stock column generation.

Documents are tokenised once. Whole capacities are cut off as full sequences; what remains of each document is an item of
less than a capacity. The items' length histogram has a bounded number of bins, so the linear program over patterns (which
bins fill a sequence, how often) is small for any number of documents: its columns are generated by a knapsack dynamic
program over the bins' prices. Rounded-down patterns are assigned to documents by their rank within their bin; the bounded
rest is laid end to end and cut where sequences end.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm._common import materialize, tidy

CAPACITY, QUANTUM, END_ID = 4096, 8, 2
#: Parts of a bin that are ranked apart, so that no bin is one task's.
SALTS = 64
#: Simplex steps at most; every basis on the way is a valid set of patterns.
MAX_STEPS = 6000
#: Words, and word pieces, that a worker keeps: as many again stay from before, so that frequent ones are never lost.
WORDS, PIECES = 120_000, 100_000
#: How the tokenizer's file must say that texts are normalised and split.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: Letters whose normal form and lower case are plain, then marks: such words need no normaliser.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?|\"#$%&()*+\-/=@\[\]^_`{}~]*)")


class WordEncoder:
    """Ids of texts under a word-level BPE file whose pieces never reach across a space or a line feed, by cached words.

    Plain words go to the model by themselves; all others through the whole tokenizer. The ids are those of the library. A
    file that normalises or splits otherwise is refused.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if (spec.get("normalizer"), spec.get("pre_tokenizer"), spec.get("post_processor")) != (NORMALIZER, PRE_TOKENIZER, None) or (spec["model"].get("type"), spec["model"].get("ignore_merges", False)) != ("BPE", False):
            raise ValueError(f"{path}: this tokenizer normalises or splits texts in another way")
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        self.char = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.old_words: dict[str, bytes] = {}
        self.old_pieces: dict[str, bytes] = {}

    def _piece(self, p: str) -> bytes:
        got = self.pieces.get(p)
        if got is None:
            got = self.old_pieces.get(p)
            if got is None:
                mapped = p if p.isascii() else "".join([self.char[b] for b in p.encode()])
                got = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(mapped)])
            if len(self.pieces) >= PIECES:
                self.old_pieces, self.pieces = self.pieces, {}
            self.pieces[p] = got
        return got

    def _word(self, w: str) -> bytes:
        got = self.words.get(w)
        if got is None:
            got = self.old_words.get(w)
            if got is None:
                m = _PLAIN.fullmatch(w)
                if m:
                    got = self._piece(m[1].lower()) + (self._piece(m[2]) if m[2] else b"")
                else:
                    got = np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes()
            if len(w) <= 64:
                if len(self.words) >= WORDS:
                    self.old_words, self.words = self.words, {}
                self.words[w] = got
        return got

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids."""
        if "<|" not in text:  # a special string is only one in lower case
            try:
                text.encode("latin-1")
                text = text.lower()  # as the normaliser does, so that fewer words differ
            except UnicodeEncodeError:
                pass
        words = text.replace("\n", " ").split(" ")
        try:
            return b"".join(map(self.words.__getitem__, words))
        except KeyError:
            return b"".join(map(self._word, words))


@lru_cache(maxsize=4)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def document_ids(path: str, text: str | None, end_id: int) -> bytes:
    return encoder(path).encode(text or "") + end_id.to_bytes(4, "little")


def best_pattern(price: np.ndarray, width: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Knapsack by dynamic programming over the capacity: the dearest pattern and how often each bin is in it."""
    value, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(width, kind="stable")
    w, p = width[order], price[order]
    fits = np.searchsorted(w, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        value[c] = value[c - 1]
        if fits[c]:
            v = p[: fits[c]] + value[c - w[: fits[c]]]
            k = int(v.argmax())
            if v[k] > value[c] + 1e-12:
                value[c], choice[c] = v[k], k
    pattern, c = np.zeros(len(width), np.int64), capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            pattern[order[choice[c]]] += 1
            c -= int(w[choice[c]])
    return float(value[capacity]), pattern


def generate_columns(width: np.ndarray, demand: np.ndarray, capacity: int, max_steps: int = MAX_STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows) and how often the relaxed program uses each: revised simplex, columns priced by ``best_pattern``."""
    m = len(width)
    basis = np.diag(capacity // width).astype(np.int64)
    inverse = np.diag(1.0 / (capacity // width))
    x = inverse @ demand
    for step in range(max_steps):
        value, pattern = best_pattern(inverse.sum(0), width, capacity)
        if value <= 1 + 1e-9:
            break
        d = inverse @ pattern
        ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        k = int(ratio.argmin())
        if not np.isfinite(ratio[k]):
            break
        t = ratio[k]
        x = x - t * d
        x[k] = t
        x = np.maximum(x, 0)
        inverse[k] /= d[k]
        others = np.arange(m) != k
        inverse[others] -= np.outer(d[others], inverse[k])
        basis[k] = pattern
        if step % 200 == 199:  # rounding errors don't pile up
            inverse = np.linalg.inv(basis.T.astype(float))
            x = np.maximum(inverse @ demand, 0)
    return basis, x


@dataclass(frozen=True)
class Plan:
    """For each bin: slots up to which its patterns reach, their first sequence and copies a sequence; sequences used, and
    items that no pattern has room for."""

    ends: dict[int, np.ndarray]
    first: dict[int, np.ndarray]
    copies: dict[int, np.ndarray]
    sequences: int
    loose: int

    def place(self, bin_: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Sequence of each (bin, rank), -1 if no pattern has room for it."""
        out = np.full(len(bin_), -1, np.int64)
        for b in np.unique(bin_).tolist():
            if b not in self.ends:
                continue
            at = np.flatnonzero(bin_ == b)
            j = np.searchsorted(self.ends[b], rank[at], "right")
            ok = j < len(self.ends[b])
            at, j = at[ok], j[ok]
            begin = np.concatenate([[0], self.ends[b][:-1]])[j]
            out[at] = self.first[b][j] + (rank[at] - begin) // self.copies[b][j]
        return out


def plan_patterns(demand: dict[int, int], capacity: int) -> Plan:
    """Patterns for a histogram of widths; each is used a whole number of times, rounded down, never beyond the demand."""
    width = np.array(sorted(demand), np.int64)
    if not len(width):
        return Plan({}, {}, {}, 0, 0)
    need = np.array([demand[w] for w in width.tolist()], np.int64)
    patterns, x = generate_columns(width, need.astype(float), capacity)
    times = np.floor(x + 1e-6).astype(np.int64)
    left = need.copy()
    used, total = [], 0
    for p, t in sorted(zip(patterns.tolist(), times.tolist()), key=lambda z: (-z[1], z[0])):
        p = np.array(p)
        t = min(t, int((left[p > 0] // p[p > 0]).min())) if p.any() else 0
        if t > 0:
            left -= t * p
            used.append((p, t, total))
            total += t
    ends, first, copies = {}, {}, {}
    for k, w in enumerate(width.tolist()):
        mine = [(p[k], t, at) for p, t, at in used if p[k]]
        if mine:
            ends[w], first[w], copies[w] = np.cumsum([c * t for c, t, _ in mine]), np.array([at for _, _, at in mine]), np.array([c for c, _, _ in mine])
    return Plan(ends, first, copies, total, int(left.sum()))


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, quantum: int = QUANTUM) -> DataFrame:
    """``id, start, length, ids_crc32, doc_tokens, sequence_id, offset``: the pieces of every document.

    Each id of a document (its text's ids, then ``end_id``) lies in exactly one piece; a sequence holds at most ``capacity``
    ids, gapless from offset 0. Null texts are empty: one piece of one id. Null ids stay null; repeated rows are packed each
    by itself. An empty table gives no rows. Other columns are not looked at. ``tokenizer`` is a path that every executor
    can read.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    units = -(-capacity // quantum)

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, crcs = [], []
            for text in batch.column(2).to_pylist():
                ids = document_ids(tokenizer, text, end_id)
                n.append(len(ids) // 4)
                crcs.append([zlib.crc32(ids[a : a + 4 * capacity]) for a in range(0, len(ids), 4 * capacity)])
            # The place in the batch counts too, so that rows that repeat each other are ranked in many tasks.
            salt = (batch.column(1).to_numpy().view(np.uint64) + np.arange(len(n), dtype=np.uint64)) % np.uint64(SALTS)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(salt.astype(np.int32))], ["id", "h", "n", "crcs", "salt"])

    keyed = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"), F.col(text_col).alias("text"))
    base = materialize(keyed.mapInArrow(tidy(tokenise), f"id {kind}, h long, n long, crcs array<bigint>, salt int"), "packing-tokens")
    rest = F.col("n") % capacity
    cells = base.select("*", F.ceil(rest / quantum).cast("int").alias("bin"), F.floor(F.col("n") / capacity).alias("full"))
    # At most (capacity / quantum + 1) * SALTS rows, whatever the input.
    sums = sorted((r["bin"], r["salt"], r["c"], r["f"]) for r in cells.groupBy("bin", "salt").agg(F.count("*").alias("c"), F.sum("full").alias("f")).collect())
    rank0, full0, demand, full = {}, {}, {}, 0
    for b, s, c, f in sums:
        rank0[b, s], full0[b, s] = demand.get(b, 0), full
        demand[b] = demand.get(b, 0) + c
        full += f
    demand.pop(0, None)
    plan = plan_patterns(demand, capacity // quantum if capacity % quantum == 0 else units)
    if plan.loose > len(demand) * units:
        raise RuntimeError("more items are left than one use of every pattern holds")
    w = Window.partitionBy("bin", "salt").orderBy("id", "h")
    ranked = cells.select("*", F.row_number().over(w).alias("rn"), F.sum("full").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("fb"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {k: batch.column(k) for k in batch.schema.names}
            n, bins, salts = (c[k].to_numpy() for k in ("n", "bin", "salt"))
            cell = list(zip(bins.tolist(), salts.tolist()))
            rank = np.array([rank0[x] for x in cell], np.int64) + c["rn"].to_numpy() - 1
            seq = plan.place(bins, rank)
            chunk0 = np.array([full0[x] for x in cell], np.int64) + np.array([x or 0 for x in c["fb"].to_pylist()], np.int64)
            who, start, length, crc, sequence = [], [], [], [], []
            for k, (size, crcs) in enumerate(zip(n.tolist(), c["crcs"].to_pylist())):
                for j, x in enumerate(crcs):
                    who.append(k)
                    start.append(j * capacity)
                    length.append(min(capacity, size - j * capacity))
                    crc.append(x)
                    sequence.append(-2 - int(chunk0[k]) - j if length[-1] == capacity else int(seq[k]))
            at = pa.array(who, pa.int64())
            cols = [batch.column(batch.schema.get_field_index("id")).take(at), c["h"].take(at), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), c["n"].take(at), pa.array(sequence, pa.int64()), pa.array(bins).take(at).cast(pa.int32()), pa.array(rank).take(at)]
            yield pa.RecordBatch.from_arrays(cols, ["id", "h", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "bin", "rank"])

    placed = materialize(ranked.mapInArrow(tidy(place), f"id {kind}, h long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, bin int, rank long"), "packing-pieces")
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    by = Window.partitionBy("sequence_id").orderBy("bin", "rank")
    patterned = placed.filter("sequence_id >= 0").withColumn("offset", F.sum("length").over(by) - F.col("length"))
    # The rest: fewer items than one use of each pattern holds, a number that does not depend on the input.
    line = Window.orderBy(F.desc("bin"), "rank")
    loose = placed.filter("sequence_id = -1").withColumn("to", F.sum("length").over(line)).withColumn("from", F.col("to") - F.col("length"))
    cuts = loose.withColumn("s", F.explode(F.sequence(F.floor(F.col("from") / capacity), F.floor((F.col("to") - 1) / capacity))))
    a, b = F.greatest("from", F.col("s") * capacity), F.least("to", (F.col("s") + 1) * capacity)
    cuts = cuts.select("id", "h", (F.col("start") + a - F.col("from")).alias("start"), (b - a).alias("length"), F.when(b - a == F.col("length"), F.col("ids_crc32")).alias("ids_crc32"), "doc_tokens", (F.col("s") + plan.sequences).alias("sequence_id"), (a - F.col("s") * capacity).alias("offset"))
    cuts = materialize(cuts, "packing-rest")
    last = cuts.agg(F.max("sequence_id")).first()[0]
    last = plan.sequences - 1 if last is None else last
    fulls = placed.filter("sequence_id < -1").withColumn("sequence_id", F.lit(last - 1) - F.col("sequence_id")).withColumn("offset", F.lit(0).cast("long"))
    whole, parts = cuts.filter("ids_crc32 is not null"), cuts.filter("ids_crc32 is null").drop("ids_crc32")

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for text, pieces in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                ids = document_ids(tokenizer, text, end_id)
                got.append([{**p, "ids_crc32": zlib.crc32(ids[4 * p["start"] : 4 * (p["start"] + p["length"])])} for p in pieces])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "length", "doc_tokens", "sequence_id", "offset", "ids_crc32")])))], ["id", "p"])

    # Documents cut at the end of a sequence of the rest are tokenised again; they are as few as those sequences.
    again = parts.groupBy(F.col("id").alias("i"), F.col("h").alias("k")).agg(F.collect_list(F.struct("start", "length", "doc_tokens", "sequence_id", "offset")).alias("p"))
    texts = keyed.join(F.broadcast(again), F.col("id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("k"))).dropDuplicates(["id", "h"]).select("id", "text", "p")
    fixed = texts.mapInArrow(tidy(crc), f"id {kind}, p array<struct<start:bigint,length:bigint,doc_tokens:bigint,sequence_id:bigint,offset:bigint,ids_crc32:bigint>>").select("id", F.inline("p"))
    out = patterned.select(names)
    for x in (whole, fixed, fulls):
        out = out.unionByName(x.select(names))
    return out
