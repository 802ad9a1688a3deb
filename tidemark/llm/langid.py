"""Language identification by bit-sliced Bloom filters over n-grams.

One table holds the filters of all languages: entry ``p`` is a bitmask whose bit ``l`` says that position ``p`` is set in
the filter of language ``l``. Looking an n-gram up is a bitwise and of its few entries, which yields every language that
contains it at once. Per-language popcounts over a text, corrected for the filters' false positives, decide.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm._common import held_out, map_arrow, tidy

#: Labelled whole texts per language (about) that a fit reads, the n-grams kept per language, log2 of the filter bits, hashes.
FIT_DOCS, FIT_GRAMS, LOG2_BITS, HASHES = 600, 60_000, 20, 3
#: Bytes of an n-gram; it must occur so often, and so often compared with the language where it is most frequent.
GRAM, MIN_COUNT, MIN_SHARE = 4, 3, 0.35
UNKNOWN = "und"
#: ASCII letters and bytes beyond ASCII stay, all else separates words.
_LETTERS = np.array([b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
CHUNK_CHARS = 1 << 20


def grams_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of lower-cased texts with separators around words, and where each text's begin (one more for the end)."""
    pad = b" " * GRAM
    raw = [x.lower().encode("utf-8", "replace") for x in texts]
    a = _LETTERS[np.frombuffer(pad + pad.join(raw) + pad, np.uint8)]
    begins = np.cumsum([0] + [len(r) + GRAM for r in raw])
    n = len(a) - GRAM + 1
    g = np.zeros(n, np.uint32)
    for k in range(GRAM):
        g = (g << np.uint32(8)) | a[k : k + n]
    gap = a == 32
    pair = gap[:-1] & gap[1:]
    keep = ~(pair[:n] | pair[GRAM - 2 : GRAM - 2 + n])
    at = np.flatnonzero(keep)
    return g[at], np.searchsorted(at, begins)


@dataclass(frozen=True)
class LanguageFilters:
    """``table[p]``: words of 64 languages each; ``fp[l]``: chance that an n-gram outside language l seems inside."""

    langs: tuple[str, ...]  # most often labelled first
    log2_bits: int
    hashes: int
    table: np.ndarray
    fp: np.ndarray

    @classmethod
    def build(cls, grams: dict[str, np.ndarray], log2_bits: int = LOG2_BITS, hashes: int = HASHES) -> LanguageFilters:
        """Filters of n-grams by language, given in order of preference when languages tie."""
        langs = tuple(grams)
        width = max(1, -(-len(langs) // 64))
        dtype = np.uint8 if len(langs) <= 8 else np.uint16 if len(langs) <= 16 else np.uint32 if len(langs) <= 32 else np.uint64
        table = np.zeros((width, 1 << log2_bits), dtype)
        fp = np.zeros(len(langs))
        for k, lang in enumerate(langs):
            for p in cls._positions(grams[lang], log2_bits, hashes):
                table[k // 64, p] |= dtype(1 << (k % 64))
            fp[k] = (np.count_nonzero((table[k // 64] >> dtype(k % 64)) & dtype(1)) / (1 << log2_bits)) ** hashes
        return cls(langs, log2_bits, hashes, table, fp)

    @staticmethod
    def _positions(grams: np.ndarray, log2_bits: int, hashes: int):
        for k in range(hashes):
            yield ((grams.astype(np.uint64) * _MULT[k]) >> np.uint64(64 - log2_bits)).astype(np.int64)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score (the share of the text's n-grams that its language knows, corrected), lead over the next
        language, and the number of n-grams."""
        pred, score, lead, grams = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        if not self.langs:
            return pred, score, lead, grams
        have = [i for i, x in enumerate(texts) if x and any(map(str.isalpha, x))]
        at = 0
        while at < len(have):
            end, size = at, 0
            while end < len(have) and (end == at or size < CHUNK_CHARS):
                size += len(texts[have[end]])
                end += 1
            part = have[at:end]
            g, begins = grams_of([texts[i] for i in part])
            n = np.diff(begins)
            share = np.zeros((len(self.langs), len(part)))
            for w in range(self.table.shape[0]):
                mask = None
                for p in self._positions(g, self.log2_bits, self.hashes):
                    got = self.table[w][p]
                    mask = got if mask is None else mask & got
                for k in range(w * 64, min(len(self.langs), w * 64 + 64)):
                    total = np.concatenate([[0], np.cumsum((mask >> mask.dtype.type(k % 64)) & mask.dtype.type(1), dtype=np.int64)])
                    hits = total[begins[1:]] - total[begins[:-1]]
                    share[k] = np.clip((hits - n * self.fp[k]) / (1 - self.fp[k]), 0, None) / np.maximum(n, 1)
            best = share.argmax(0)
            top = np.sort(share, 0)
            for j, i in enumerate(part):
                pred[i], score[i], lead[i], grams[i] = self.langs[best[j]], min(1.0, share[best[j], j]), top[-1, j] - (top[-2, j] if len(top) > 1 else 0), n[j]
            at = end
        return pred, score, lead, grams


def learn_grams(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", learn: Column | None = None, key_cols: tuple[str, ...] = ("doc_id",), fit_docs: int = FIT_DOCS, fit_grams: int = FIT_GRAMS) -> dict[str, np.ndarray]:
    """N-grams by language, learnt from about ``fit_docs`` labelled whole texts of each, picked by a hash of key and text.

    Rows without label or text teach nothing. What reaches the driver is at most ``fit_grams`` n-grams a language.
    """
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.lit(True) if learn is None else learn))
    counts = {r["lang"]: r["n"] for r in rows.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    limit = F.lit(0)
    for lang, n in counts.items():
        limit = F.when(F.col(lang_col) == lang, int(min(1.0, fit_docs / n) * (1 << 30))).otherwise(limit)
    sample = rows.filter(F.pmod(F.xxhash64(*key_cols, text_col), F.lit(1 << 30)) < limit).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def count(batch: pa.RecordBatch):
        langs = np.array(batch.column(0).to_pylist(), object)
        texts = batch.column(1).to_pylist()
        for lang in sorted(set(langs)):
            g, n = np.unique(grams_of([texts[i] for i in np.flatnonzero(langs == lang)])[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    summed = map_arrow(sample, count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).filter(F.col("n") >= MIN_COUNT)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))  # of the sample's n-grams, a bounded number
    table = summed.withColumn("rank", rank).filter(F.col("rank") <= fit_grams).drop("rank").toPandas()
    table["rate"] = table["n"] / table.groupby("lang")["n"].transform("sum")
    table["top"] = table.groupby("gram")["rate"].transform("max")
    kept = table[table["rate"] >= MIN_SHARE * table["top"]]
    return {lang: kept.loc[kept["lang"] == lang, "gram"].to_numpy(np.uint32) for lang in sorted(counts, key=lambda x: (-counts[x], x))}


def fit(docs: DataFrame, **how) -> LanguageFilters:
    """Filters of the n-grams that ``learn_grams`` finds; takes what that takes."""
    return LanguageFilters.build(learn_grams(docs, **how))


def identify(docs: DataFrame, filters: LanguageFilters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, lang_pred, score, lead`` for every whole text.

    A null text, or one without a letter, is ``und`` with score 0. A text with letters but no n-gram gets the most frequent
    learnt language with score 0; ties go to the more frequent language, then to the one that sorts first. Without any
    labelled text all are ``und``. Ids may be null or repeat; other columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # bounded: 2 ** LOG2_BITS entries of a bit per language
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double, lead double"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        pred, score, lead, _ = shared.value.predict(batch.column(1).to_pylist())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score), pa.array(lead)], ["id", "lang_pred", "score", "lead"])

    return map_arrow(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, schema)


def highest_share(score: float, n: int, sure: float = 2.0) -> float:
    """The largest share that a text's language may know in truth (Wilson's upper bound at ``sure`` deviations), when it knows
    ``score`` of the text's ``n`` n-grams; 1 without any. One rule for all sizes: the fewer n-grams, the less they prove."""
    z = sure * sure
    return (score + z / (2 * n) + sure * (score * (1 - score) / n + z / (4 * n * n)) ** 0.5) / (1 + z / n) if n else 1.0


def keep_identified(docs: DataFrame, filters: LanguageFilters, min_score: float = 0.3, sure: float = 2.0, text_col: str = "text") -> DataFrame:
    """Documents whose language is recognised; columns stay as they are. Rejected are ``und`` and texts of which the best
    language knows a share that is surely (``highest_share``) below ``min_score``.

    Null texts and texts without a letter are ``und``; null or repeated ids, and columns of any name, change nothing. An empty
    table stays empty."""
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def keep(batches):
        for batch in batches:
            pred, score, _, n = shared.value.predict(batch.column(at).to_pylist())
            yield batch.filter(pa.array([p != UNKNOWN and highest_share(s, k, sure) >= min_score for p, s, k in zip(pred, score, n.tolist())], pa.bool_()))

    return docs.mapInArrow(tidy(keep), docs.schema)


def predict_documents(docs: DataFrame) -> DataFrame:
    """Fit on the labelled documents outside the held-out quarter, then identify every document."""
    filters = fit(docs, learn=~held_out(F.col("doc_id")))
    return identify(docs, filters).select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "lang_pred", "score", "lead")
