import random

from pyspark.sql import functions as F

from tidemark.llm.multiset import delete, fingerprint, fingerprint_report, fingerprints, insert, likeness, with_next


def test_order_independence_insertion_and_deletion(spark):
    df = spark.createDataFrame([("Alpha one. Beta two!\nGamma", "Gamma\nBeta two!\nAlpha one.", "Gamma", "Alpha one.\nBeta two!")], "a string, b string, c string, d string")
    f = df.select(*[fingerprint(F.col(c)).alias(c) for c in "abcd"])
    r = f.select((F.col("a") == F.col("b")).alias("same"), (insert(F.col("c"), F.col("d")) == F.col("a")).alias("ins"), (delete(F.col("a"), F.col("c")) == F.col("d")).alias("dele"), likeness(F.col("a"), F.col("d")).alias("near"), (F.col("a") == F.col("d")).alias("diff")).first()
    assert r.same and r.ins and r.dele and not r.diff and 0 <= r.near < 1


def test_next_and_edges(spark):
    rng = random.Random(4)
    texts = ["", None, "a", "é\U0001f600b", "x " * 40_000] + ["".join(rng.choice("ab é.\n") for _ in range(rng.randrange(200))) for _ in range(300)]
    ids = rng.sample(range(10_000), len(texts))
    rows = [(i, t, "c") for i, t in zip(ids, texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(5)
    got = {r.doc_id: r for r in fingerprint_report(df).collect()}
    assert len(got) == len(rows)
    order = sorted(rows, reverse=True, key=lambda r: r[0])
    import hashlib

    for k, (i, t, _) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        want = t[: len(t) - half] + nxt[:half]
        r = got[i]
        assert r.edited_sha256 == hashlib.sha256(want.encode()).hexdigest() and r.n_chars == len(t)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert (r.fingerprint == r.edited_fingerprint) >= (t == want)
    assert fingerprint_report(df.limit(0)).count() == 0
    one = fingerprint_report(df.filter(F.col("doc_id") == ids[4])).first()
    assert one.near_next == 1
    odd = spark.createDataFrame([(None, "n", 1), (None, None, 1), (5, "b", 1), (5, "a", 1)], "doc_id long, text string, next int")
    assert fingerprint_report(odd.drop("next")).count() == 4
    order = with_next(odd.select("doc_id", "text"), "doc_id", "text").collect()
    assert {(r.doc_id, r.text): r.next.text for r in order} == {(5, "a"): "b", (5, "b"): None, (None, None): "n", (None, "n"): "a"}
    assert len({tuple(r.fp) for r in fingerprints(spark.createDataFrame([(1, "q"), (2, "q"), (3, "z")], "doc_id long, text string")).collect()}) == 2


def test_ids_are_integers(spark):
    import pytest

    with pytest.raises(TypeError):
        fingerprint_report(spark.createDataFrame([("a", "x")], "doc_id string, text string"))
