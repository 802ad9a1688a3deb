"""Document fingerprints: a homomorphic multiset hash of paragraphs, as DataFrame expressions.

A text's fingerprint is the sum of wide vectors hashed from its paragraphs, modulo powers of two: sums do not depend on
order, and a paragraph is inserted or deleted by adding or subtracting its vector. Three parts stand in one array of longs:
the number of paragraphs, LANES lanes of 32 bits (equal for equal multisets and practically never otherwise), and CELLS
signed counters of 16 bits, whose differences estimate how many paragraphs two texts do not share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm._common import need_integral

LANES, CELLS = 16, 64
LANE_MASK, CELL_MASK = 0xFFFFFFFF, 0xFFFF
WIDTH = 1 + LANES + CELLS
#: Range buckets for each shuffle partition, when documents are put in order of id.
BUCKETS = 4


def paragraphs(text: Column) -> Column:
    """Non-empty paragraphs: they end at a line break, or at a mark that ends a sentence and is followed by spaces. Null
    counts as empty."""
    return F.filter(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "([.!?]) +", "$1\n"), "\n"), lambda p: p != "")


def _hex(h: Column, k: int) -> Column:
    return F.conv(F.substring(h, 8 * k + 1, 8), 16, 10).cast("long")


def paragraph_hash(p: Column) -> Column:
    """128 hex digits of a paragraph: 16 lanes of 32 bits."""
    b = p.cast("binary")
    return F.concat(F.sha2(b, 256), F.sha2(F.concat(F.lit(b"\x01"), b), 256))


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, which a plain column inside a lambda would not be."""
    return F.transform(F.array(value), use)[0]


def fingerprint(text: Column) -> Column:
    """``array<long>``: count, lanes, cells. Texts without paragraphs give zeros."""
    zero = F.lit(0).cast("long")

    def lane(hashes: Column, k: int) -> Column:
        return F.reduce(hashes, zero, lambda a, h: a + _hex(h, k)).bitwiseAND(F.lit(LANE_MASK))

    def cell_sum(cells: Column):
        return lambda c: F.reduce(F.filter(cells, lambda x: x["c"] == c), zero, lambda a, x: a + x["s"]).bitwiseAND(F.lit(CELL_MASK))

    def sums(hashes: Column) -> Column:
        cells = F.transform(hashes, lambda h: F.struct((_hex(h, 0) % CELLS).alias("c"), (1 - 2 * (_hex(h, 1) % 2)).alias("s")))
        tail = _bound(cells, lambda cs: F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), cell_sum(cs)))
        return F.concat(F.array(F.size(hashes).cast("long"), *[lane(hashes, k) for k in range(LANES)]), tail)

    return _bound(F.transform(paragraphs(text), paragraph_hash), sums)


def _mask(k: Column) -> Column:
    return F.when(k <= LANES, F.lit(LANE_MASK)).otherwise(F.lit(CELL_MASK))


def insert(a: Column, b: Column) -> Column:
    """Fingerprint of two texts' paragraphs together."""
    return F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda x, k: (x["a"] + x["b"]).bitwiseAND(_mask(k)))


def delete(a: Column, b: Column) -> Column:
    """Fingerprint of what is left of ``a`` without the paragraphs of ``b``."""
    return F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda x, k: (x["a"] - x["b"]).bitwiseAND(_mask(k)))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: the estimated share of paragraphs that two fingerprints have in common; 1 if they are equal."""
    half = 1 << 15
    cells = F.zip_with(F.slice(a, 2 + LANES, CELLS), F.slice(b, 2 + LANES, CELLS), lambda x, y: (x - y + half).bitwiseAND(F.lit(CELL_MASK)) - half)
    apart = F.reduce(cells, F.lit(0).cast("long"), lambda s, d: s + d * d)
    return F.when(a == b, 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - apart / F.greatest(a[0] + b[0], F.lit(1))))


def text_form(fp: Column) -> Column:
    """Lower-case hex: 8 digits for the count and each lane, 4 for each cell."""
    return F.array_join(F.transform(fp, lambda x, k: F.lpad(F.lower(F.hex(x)), F.when(k <= LANES, 8).otherwise(4), F.lit("0"))), "")


def with_next(rows: DataFrame, id_col: str, *carried: str) -> DataFrame:
    """Adds ``next``: the carried columns of the row that follows in descending order of id (after the last, of the first).

    Rows move once, to range buckets of ids; the first row of each bucket also goes to the end of the bucket before it, so
    that no row has to be looked up elsewhere. Bucket borders and firsts, a few numbers for each partition, are all that the
    driver sees. Ids are integers, or a TypeError is raised; null ids come last; ties are in order of the carried columns.
    """
    need_integral(rows, id_col)
    spark = rows.sparkSession
    o = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    n = BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = rows.select(o.alias("o"))
    borders = sorted(set(keys.agg(F.percentile_approx("o", [k / n for k in range(1, n)], 10 * n)).first()[0] or []), reverse=True) if n > 1 else []
    bucket = F.size(F.filter(F.array(*[F.lit(b).cast("long") for b in borders]), lambda b: b >= F.col("__o"))) if borders else F.lit(0)
    firsts = keys.withColumn("__o", F.col("o")).groupBy(bucket.alias("b")).agg(F.max("o").alias("o")).orderBy("b").collect()
    if not firsts:
        return rows.withColumn("next", F.struct(*carried))
    before = {r["o"]: firsts[k - 1]["b"] for k, r in enumerate(firsts)}
    places = F.map_from_arrays(F.array(*[F.lit(k).cast("long") for k in before]), F.array(*map(F.lit, before.values())))
    also = F.try_element_at(places, F.col("__o"))
    sent = rows.withColumn("__o", o).select("*", F.explode(F.array_compact(F.array(F.struct(bucket.alias("b"), F.lit(0).alias("guest")), F.when(also.isNotNull(), F.struct(also.alias("b"), F.lit(1).alias("guest")))))).alias("__at"))
    w = Window.partitionBy("__at.b").orderBy("__at.guest", F.desc("__o"), *carried)
    return sent.withColumn("next", F.lead(F.struct(*carried)).over(w)).filter("__at.guest = 0").drop("__o", "__at")


def edited(text: Column, following: Column) -> Column:
    """The text with its last half (rounded down) replaced by as many code points from the start of the following text."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, fp``: the fingerprint of every whole text. Null texts are empty; ids may be null or repeat; other columns are
    not looked at."""
    return docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col)).alias("fp"))


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """Per document: its fingerprint, that of its edited text, and how alike it is to the edited text and the next document.

    Ids are integers (null ones come last). Null texts are empty; repeated rows each keep their row; an empty table gives no
    rows; other columns are not looked at."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("fp", fingerprint(F.col("text")))
    both = with_next(rows, "doc_id", "text", "fp").withColumn("changed", edited(F.col("text"), F.col("next.text")))
    both = both.withColumn("efp", fingerprint(F.col("changed")))
    return both.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("changed").cast("binary"), 256).alias("edited_sha256"), text_form(F.col("fp")).alias("fingerprint"),
        text_form(F.col("efp")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("efp")).alias("near_edited"), likeness(F.col("fp"), F.col("next.fp")).alias("near_next"),
    )
