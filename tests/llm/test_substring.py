import hashlib
import random

import pytest

import tidemark.llm.substring as S
from tidemark.llm.substring import remove_repeats, substring_report, super_kmers


def brute(rows, k=13):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in words:
        for j in range(len(w) - k + 1):
            g = tuple(w[j : j + k])
            key = S.NULL_ID if i is None else i
            first[g] = min(first.get(g, key), key)
    out = []
    for i, w in words:
        gone = set()
        for j in range(len(w) - k + 1):
            if first[tuple(w[j : j + k])] < (S.NULL_ID if i is None else i):
                gone.update(range(j, j + k))
        left = [x for j, x in enumerate(w) if j not in gone]
        out.append((-1 if i is None else i, len(w), len(gone), hashlib.sha256(b" ".join(left)).hexdigest()))
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    vocab = ["the", "of", "and", *("w%d" % rng.randrange(400) for _ in range(300)), "été", "x\x1cy", " nb"]
    passages = [[rng.choice(vocab) for _ in range(rng.randrange(10, 70))] for _ in range(12)]
    rows = []
    for i in range(120):
        w = []
        for _ in range(rng.randrange(1, 6)):
            w += rng.choice(passages) if rng.random() < 0.5 else [rng.choice(vocab) for _ in range(rng.randrange(60))]
        rows.append((rng.randrange(100) if i % 17 else None, rng.choice([" ", "  ", "\n", "\t \x0b"]).join(w)))
    rows += [(200 + k, "a " * 700) for k in range(3)] + [(300, None), (301, ""), (302, " \n"), (303, "one two"), (304, " ".join(map(str, range(13)))), (305, " ".join(map(str, range(14)))), (305, " ".join(map(str, range(14))))]
    rows += [(400 + k, " ".join(passages[0]) + " tail") for k in range(150)] + [(999, " ".join(map(str, range(60_000))))]
    return rows


def test_equals_brute_force(spark, monkeypatch):
    for seed in (1, 2):
        rows = corpus(seed)
        df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, n_words string").repartition(3)
        got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_report(df).collect())
        assert got == brute(rows)
    assert substring_report(df.limit(0)).count() == 0


def test_slices_and_blocks_change_nothing():
    rows = [(i, t) for i, t in corpus(3) if i is not None]
    words, owner, inside, begin, n, key = super_kmers([(t or "").encode() for _, t in rows])
    import numpy as np

    head = np.zeros(len(owner), S._HEAD)
    head["doc"], head["start"], head["key"], head["words"] = np.array([r[0] for r in rows])[owner], inside, (key >> np.uint64(8)).astype(np.uint32), n + 12
    strings = [b" ".join(words[a : a + k]) for a, k in zip(begin.tolist(), head["words"].tolist())]
    whole = sorted(x for part in S._solve_bucket([S._pack([head], strings)], 1, 13) for x in part)
    h = len(head) // 2
    parts = sorted(x for part in S._solve_bucket([S._pack([head[:h]], strings[:h]), S._pack([head[h:]], strings[h:])], 5 * S.SLICE_BYTES, 13) for x in part)
    assert whole == parts and whole
    covered = np.zeros(len(words), int)
    for a, k in zip(begin.tolist(), n.tolist()):
        covered[a : a + k] += 1
    assert covered.max() == 1  # each window travels once
    assert len({x[0] for x in whole}) > 10


def test_stage_keeps_columns_and_white_space(spark):
    p = " ".join(f"p{k}" for k in range(20))
    rows = [(1, f"a  b\n{p}\nc", "s", 5), (2, f"x\t{p} y\n z", "s", None), (3, p, "s", 1), (4, None, "s", None), (5, "", "s", 0), (6, "short\n ", "s", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    got = {r.doc_id: r for r in remove_repeats(df).collect()}
    assert remove_repeats(df).columns == df.columns
    assert got[1].text == rows[0][1] and got[1].n_chars == 5 and got[2].text == "x\ty\n z" and got[2].n_chars == 6
    assert 3 not in got and got[4].text is None and got[5].text == "" and got[6].text == "short\n " and got[6].n_chars == 7


def test_hot_minimisers_are_taken_apart(spark, monkeypatch):
    monkeypatch.setattr(S, "HOT_LEAST", 20)
    monkeypatch.setattr(S, "HOT_SHARE", 0.0)
    rows = corpus(5)
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, n_words string").repartition(3)
    assert 3 < len(S.hot_minimisers(df, "text", 13, 16)) < 500
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_report(df).collect())
    assert got == brute(rows)


def test_one_passage_in_very_many_texts(spark):
    rng = random.Random(9)
    passage = " ".join(f"p{k}" for k in range(20))
    rows = [(k, f"w{rng.random()} x{rng.random()} {passage} y{rng.random()}") for k in range(100_000)]
    rows += [(None, f"n{k % 5000} {passage}") for k in range(10_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    assert len(S.hot_minimisers(df, "text", 13, 16)) > 0
    ranges = S.repeated_ranges(df)
    assert ranges.filter(f"id = {S.NULL_ID}").groupBy("tag").count().agg({"count": "max"}).first()[0] < 200
    got = substring_report(df).groupBy("n_words", "n_removed").count().collect()
    assert {(r.n_words, r.n_removed): r["count"] for r in got} == {(23, 0): 1, (23, 20): 99_999, (21, 20): 10_000}


def test_names_and_ids(spark):
    p = " ".join(f"p{k}" for k in range(20))
    rows = [(1, p, 5, "r", "t"), (2, "x " + p, 6, "r2", "t2"), (None, p + " z", 7, "r3", "t3"), (None, p + " z", 7, "r3", "t3")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __id long, __ranges string, __TAG string")
    got = sorted(map(tuple, remove_repeats(df).collect()), key=repr)
    assert got == sorted([rows[0], (2, "x", 6, "r2", "t2"), (None, "z", 7, "r3", "t3"), (None, "z", 7, "r3", "t3")], key=repr)
    for bad in ("string", "double"):
        with pytest.raises(TypeError):
            substring_report(df.select(df.doc_id.cast(bad).alias("doc_id"), "text"))
    big = spark.createDataFrame([(1, " ".join(map(str, range(400)))), (2, " ".join(map(str, range(400))))], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring_report(big, window=300).collect()} == {1: 0, 2: 400}
