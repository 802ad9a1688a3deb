import hashlib
import random

from hypothesis import given, settings, strategies as st

import tidemark.llm.decontam as D
from tidemark.llm.decontam import Searcher, WuManber, decontamination_report, drop_contaminated, find_contamination, words_of


def brute(docs, items, k=13):
    pats = {}
    for i, t in items:
        w = words_of((t or "").encode())
        for j in range(max(1, len(w) - k + 1) if w else 0):
            pats.setdefault(tuple(w[j : j + k]), set()).update([] if i is None else [str(i)])
    out = []
    for i, t in docs:
        w = words_of((t or "").encode())
        hit, found = set(), set()
        for n in {len(p) for p in pats}:
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in pats:
                    hit.update(range(j, j + n))
                    found |= pats[tuple(w[j : j + n])]
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(6)
    vocab = ["The", "of", "été", "x1", "A", "bb", "ccc", "Straße", *[f"w{k}" for k in range(60)]]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 2, 5, 12, 13, 14, 30, 60])))) for k in range(40)]
    items += [(100, None), (None, "the of"), (101, ""), (102, " ,.; "), (9, items[3][1])]
    docs = []
    for i in range(200):
        parts = [rng.choice([x for _, x in items if x] + [" ".join(rng.choice(vocab) for _ in range(rng.randrange(80)))]) for _ in range(rng.randrange(5))]
        docs.append((i if i % 30 else None, rng.choice([" ", ", ", "\n", "--"]).join(p.upper() if rng.random() < 0.2 and p.isascii() else p for p in parts)))
    long = " ".join(rng.choice(vocab) for _ in range(50_000)) + " " + items[6][1] + " tail"
    return docs + [(300, None), (301, ""), (302, long), (302, long), (303, items[5][1])], items


def test_report_equals_brute_force(spark):
    docs, items = corpus()
    d = spark.createDataFrame([(*r, "c") for r in docs], "doc_id long, text string, n_words string").repartition(3)
    b = spark.createDataFrame([(*r, "c") for r in items], "item_id long, text string, extra string")
    got = sorted((tuple(r[c] for c in ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for r in decontamination_report(d, b).collect()), key=repr)
    assert got == brute(docs, items)
    assert decontamination_report(d.limit(0), b).count() == 0
    assert decontamination_report(d, b.limit(0)).filter("n_hit > 0").count() == 0
    kept = drop_contaminated(d, b)
    assert kept.columns == d.columns and kept.count() == sum(not r[5] for r in brute(docs, items))


def test_several_passes_find_the_same(spark, monkeypatch):
    docs, items = corpus()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    norm = lambda df: sorted((str(r.id), r.n_words, [tuple(x) for x in r.ranges], r["items"]) for r in df.collect())
    assert norm(find_contamination(d, b)) == norm(find_contamination(d, b, pass_bytes=900))
    one = sorted(map(str, drop_contaminated(d, b).collect()))
    passes = D.benchmark_passes
    monkeypatch.setattr(D, "benchmark_passes", lambda *a, **k: passes(*a, **{**k, "pass_bytes": 900}))
    assert sorted(map(str, drop_contaminated(d, b).collect())) == one
    named = d.selectExpr("doc_id", "text", "doc_id AS __key", "text AS __KEY_", "1 AS id", "2 AS k")
    kept = drop_contaminated(named, b)
    assert kept.columns == named.columns and kept.filter("NOT __key <=> doc_id OR NOT __KEY_ <=> text").count() == 0 and kept.count() == len(one)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.binary(min_size=3, max_size=12).map(lambda x: bytes(97 + c % 3 for c in x)), min_size=1, max_size=6), st.binary(max_size=300).map(lambda x: bytes(97 + c % 3 for c in x)))
def test_wu_manber_finds_every_occurrence(patterns, text):
    w = WuManber(patterns)
    want = {(i, p) for p in set(patterns) for i in range(len(text)) if text.startswith(p, i)}
    assert {(s, w.patterns[k]) for s, k in w.find(text)} == want


def test_lanes_and_chunks(monkeypatch):
    monkeypatch.setattr(D, "LANE", 7)
    monkeypatch.setattr(D, "CHUNK_BYTES", 50)
    s = Searcher([("1", b"one two three four five six seven eight nine ten eleven twelve thirteen fourteen"), ("2", b"short one")], 13)
    got = s.search([b"zero One two three four five six seven eight nine ten eleven twelve thirteen fourteen and short ONE", b"", b"short one two", b"xshort one"])
    assert got[1:] == [(0, [], []), (3, [(0, 2)], ["2"]), (2, [], [])]
    assert got[0][0] == 18 and got[0][1] == [(1, 15), (16, 18)] and got[0][2] == ["1", "2"]
