import random

import corpus_pipeline
from tidemark.llm.decontam import words_of
from tidemark.llm.simhash import drop_near_duplicates, similar_groups

from test_packing import audit

SF = "/root/testdata/sf0.01"


def shingles(text, k=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_near_duplicates(spark):
    rng = random.Random(8)
    vocab = [f"word{k}" for k in range(900)]
    rows, truth = [], {}
    for g in range(25):
        base = [rng.choice(vocab) for _ in range(rng.randrange(120, 700))]
        for c in range(4):
            w = list(base)
            for _ in range(c * len(base) // 200):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((g * 10 + c, ("  " if c == 2 else " ").join(w)))
            truth[g * 10 + c] = g * 10
    rows += [(900 + k, " ".join(rng.choice(vocab) for _ in range(200))) for k in range(40)]
    rows += [(2000, None), (2001, ""), (2002, "one"), (2003, "ONE"), (None, "one"), (2002, "one"), (3000, "long " * 40_000)]
    df = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, group string")
    got = {r.id: r.group for r in similar_groups(df.filter("doc_id < 2000")).collect()}
    sh = {i: shingles(t) for i, t in rows if i is not None and i < 2000}
    for i in truth:
        for j in truth:
            if i < j and similarity(sh[i], sh[j]) >= 0.85:
                assert got[i] == got[j], (i, j)
    assert all(got[i] // 10 == i // 10 for i in truth) and all(got[900 + k] == 900 + k for k in range(40))
    kept = drop_near_duplicates(df)
    assert kept.columns == df.columns
    left = [r.doc_id for r in kept.collect()]
    assert sorted(x for x in left if x and x >= 2000) == [2000, 2002, 3000] and len(left) == len(set(left))
    assert drop_near_duplicates(df.limit(0)).count() == 0


def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    state, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        state = stage(spark, state, SF)
        assert state.schema == docs.schema
        from tidemark.llm._common import materialize

        state = materialize(state, "test")
        seen[name] = {r.doc_id: r for r in state.collect()}
    assert len(seen["language_id"]) > 0.98 * len(before)
    kept = seen["simhash_dedup"]
    sh = {i: shingles(r.text) for i, r in seen["language_id"].items()}
    by = {}
    for i, s in sh.items():
        for x in s:
            by.setdefault(x, []).append(i)
    for i in sh:
        if i not in kept:  # it went for a chain of near copies, which begins with a close one
            near = {j for x in sh[i] for j in by[x] if j != i}
            assert any(similarity(sh[i], sh[j]) >= 0.7 for j in near), i
        else:
            near = {j for x in sh[i] for j in by[x] if j < i and j in kept}
            assert all(similarity(sh[i], sh[j]) < 0.86 for j in near), i
    first = {}
    words = {i: r.text.encode().split() for i, r in kept.items()}
    for i in sorted(words):
        for k in range(len(words[i]) - 12):
            first.setdefault(tuple(words[i][k : k + 13]), i)
    for i, w in words.items():
        gone = {x for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for x in range(k, k + 13)}
        left = [x for k, x in enumerate(w) if k not in gone]
        got = seen["substring_dedup"].get(i)
        assert (got.text.encode().split() if got else []) == left and (got is not None or not left)
        assert got is None or got.n_chars == len(got.text)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    grams = {tuple(w[k : k + 13]) for r in bench for w in [words_of(r.text.encode())] for k in range(max(1, len(w) - 12))}
    for i, r in seen["substring_dedup"].items():
        w = words_of(r.text.encode())
        hit = {x for k in range(len(w) - 12) if tuple(w[k : k + 13]) in grams for x in range(k, k + 13)}
        assert (i in seen["decontaminate"]) == (not (hit and 20 * len(hit) >= len(w)))
    rows = [(i, r.text) for i, r in seen["decontaminate"].items()]
    audit(rows, corpus_pipeline.run(spark, SF).collect())


def test_decontamination_searches_items_without_an_id(spark, tmp_path):
    passage = " ".join(f"w{k}" for k in range(20))
    spark.createDataFrame([(None, passage), (1, "another passage")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(1, "before " + passage), (2, "clean text"), (3, "has another passage")], "doc_id long, text string")
    assert [r.doc_id for r in corpus_pipeline.decontaminate(spark, docs, str(tmp_path)).collect()] == [2]
