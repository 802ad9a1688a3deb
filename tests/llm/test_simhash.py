import random

import numpy as np
import xxhash

from tidemark.llm.queries import QUERIES
from tidemark.llm.simhash import ball_masks, cluster, links, simhash, shingle_hashes, spanning_links


def brute_fp(text, width=3):
    w = (text or "").encode().lower().split()
    sh = [b" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or ([b" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(fps, radius=3):
    a = np.array(fps, np.uint64)
    part, out = [-1] * len(a), 0
    for i in range(len(a)):
        if part[i] < 0:
            part[i], stack = out, [i]
            while stack:
                x = stack.pop()
                for y in np.flatnonzero(np.bitwise_count(a ^ a[x]) <= radius).tolist():
                    if part[y] < 0:
                        part[y] = out
                        stack.append(y)
            out += 1
    return part


def expect(rows):
    fps = [brute_fp(t) for _, t in rows]
    part = components(fps)
    low = {}
    for (i, _), p in zip(rows, part):
        if i is not None:
            low[p] = min(low.get(p, i), i)
    return sorted(((i if i is not None else -1), f, low.get(p)) for (i, _), f, p in zip(rows, fps, part))


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op4_simhash"](spark, "/root/testdata/sf0.01").collect()
    assert sorted((r.doc_id, int(r.fingerprint, 16), r.component_id) for r in got) == expect(rows)
    assert all(len(r.fingerprint) == 16 for r in got)


def test_edges(spark):
    rng = random.Random(0)
    base = [rng.choice("alpha beta gamma delta eps zeta".split()) + str(rng.randrange(50)) for _ in range(400)]
    rows = [(None, "x y z"), (1, None), (2, ""), (3, "\x0b\t "), (4, "one"), (5, "ONE"), (5, "ONE"), (6, "x y z"), (None, "unique words here"), (7, "A\x1cB C D É é")]
    for k in range(60):
        w = list(base)
        w[rng.randrange(400)] = "changed"
        rows.append((100 + k, " ".join(w)))
    rows.append((300, "w" * 10 + " " + "long text " * 30_000))
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, fp string")
    got = sorted((-1 if r.id is None else r.id, r.fp & (1 << 64) - 1, r.component_id) for r in cluster(df).collect())
    assert [g[:2] for g in got] == [e[:2] for e in expect(rows)] and sorted(map(repr, got)) == sorted(map(repr, expect(rows)))
    assert cluster(df.limit(0)).count() == 0


def test_links_connect_all_pairs_within_the_radius(spark):
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    fps = set()
    for c in centres.tolist():
        for _ in range(40):
            x = c
            for b in rng.choice(64, rng.integers(0, 5), replace=False).tolist():
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    for radius, blocks in ((3, 3), (2, 1), (4, 4)):
        edges = [(np.int64(r.a).astype(np.uint64).item(), np.int64(r.b).astype(np.uint64).item()) for r in links(df, radius, blocks).collect()]
        assert all(bin(a ^ b).count("1") <= radius for a, b in edges)
        root = {f: f for f in fps}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            root[find(a)] = find(b)
        want = components(fps, radius)
        assert len({(find(f), p) for f, p in zip(fps, want)}) == len(set(want)) == len({find(f) for f in fps})
    assert len(ball_masks(3, 3)) == 3 and sum(len(m[1]) for m in ball_masks(3, 3)) == 131
    assert spanning_links(np.array([1, 2, 4], np.uint64), 1) == []
    assert simhash(shingle_hashes(b"", 3)) == 0


def test_sketches_equal_pairwise_similarities():
    from tidemark.llm.simhash import SKETCH, Sketches, sketch_similarity

    rng = np.random.default_rng(4)
    base = np.unique(rng.integers(0, 1 << 32, 2000))
    sets = [np.unique(np.concatenate([rng.choice(base, n, replace=False), rng.integers(0, 1 << 32, 20)]))[:SKETCH].astype("<u4") for n in (5, 100, 230, 300, 900, 1900, 1950)] + [np.zeros(0, "<u4"), np.zeros(0, "<u4")]
    index = Sketches(sets)
    for i in range(len(sets)):
        assert np.allclose(index.similarities(i), [sketch_similarity(sets[i], x) for x in sets])
    small = [set(x.tolist()) for x in sets[:3]]
    assert sketch_similarity(sets[0], sets[1]) == len(small[0] & small[1]) / len(small[0] | small[1])
    assert sketch_similarity(sets[-1], sets[-2]) == 1 and sketch_similarity(sets[0], sets[-1]) == 0


def block_edits(rng, vocab, kind, want):
    """Word lists of a text and of a copy with one appended, cut or replaced block, whose shingles have about ``want``."""
    n = int(rng.integers(100, 900))
    a = [vocab[k] for k in rng.zipf(1.3, n) % len(vocab)]
    new = lambda m: [vocab[k] for k in rng.integers(0, len(vocab), m)]
    if kind == "appended":
        return a, a + new(int(n * (1 / want - 1)))
    if kind == "cut":
        return a, a[: int(n * want) + 1]
    m = int(n * (1 - want) / (1 + want))
    at = int(rng.integers(0, n - m + 1))
    return a, a[:at] + new(m) + a[at + m :]


def test_pairs_with_block_edits_meet():
    from tidemark.llm.simhash import describe

    rng = np.random.default_rng(7)
    vocab = [f"{'abcdefgh'[k % 8] * (1 + k % 9)}{k}" for k in range(4000)]
    sets = lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    for kind in ("appended", "cut", "replaced"):
        for want in (0.81, 0.85, 0.9):
            met = made = 0
            while made < 60:
                a, b = block_edits(rng, vocab, kind, want)
                x, y = sets(a), sets(b)
                if 0.8 <= len(x & y) / len(x | y) <= 0.92:
                    made += 1
                    met += bool((describe(" ".join(a).encode(), 5)[0] == describe(" ".join(b).encode(), 5)[0]).any())
            assert met == made, (kind, want, met)


def test_long_texts_are_decided_on_all_their_shingles(spark):
    from tidemark.llm.simhash import similar_groups

    rng = random.Random(5)
    rows, want = [], {}
    for g in range(60):
        # Shingles in common: n - 4. The block after them makes the similarity just 0.8 or just below.
        n = rng.randrange(400, 1200) * 4 + 4
        base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        more = (n - 4) // 4 + g % 2 * 8
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(base + [f"v{rng.randrange(10**6)}" for _ in range(more)]))]
        want[2 * g], want[2 * g + 1] = 2 * g, 2 * g + g % 2
    # Texts of one core of 1600 shingles: two odd ones are at 1600 / 1980, others at 1600 / 2005 and 1600 / 2030.
    core = [f"c{k}" for k in range(1604)]
    for k in range(30):
        rows.append((1000 + k, " ".join(core + [f"x{k}y{j}" for j in range(190 if k % 2 else 215)])))
        want[1000 + k] = 1001 if k % 2 else 1000 + k
    got = {r.id: r.group for r in similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_hubs_have_one_component(spark):
    from tidemark.llm.components import connected_components

    rng = random.Random(3)
    star = [(1_000_000, k) for k in range(20_000)] + [(k, k + 50_000) for k in range(0, 20_000, 7)]
    chain = [(2_000_000 + k, 2_000_001 + k) for k in range(300)]
    rng.shuffle(star)
    got = {r.node: r.part for r in connected_components(spark.createDataFrame(star + chain, "a long, b long")).collect()}
    assert all(got[a] == got[b] == (0 if a < 2_000_000 else 2_000_000) for a, b in star + chain if 0 < min(a, b) and min(a, b) != 2_000_000)


def test_a_set_of_unlike_members_costs_little():
    import time

    from tidemark.llm.simhash import _sift, _similar_links

    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 1 << 32, 256)).astype("<u4") for _ in range(4000)]
    began = time.perf_counter()
    assert _sift(list(range(4000)), sets, 0.8) == ([], [], False) and _similar_links(list(range(4000)), sets, 0.8) == []
    assert time.perf_counter() - began < 20


def test_names(spark):
    from tidemark.llm.simhash import drop_near_duplicates

    text = " ".join(f"w{k}" for k in range(30))
    rows = [("b", text, "v", 1, 2), ("a", text, "w", 3, 4), ("c", text + " other words at the end of it all here now", "x", 5, 6), (None, text, "y", 7, 8)]
    df = spark.createDataFrame(rows, "doc_id string, text string, __i string, __h int, cid int")
    got = sorted(map(tuple, drop_near_duplicates(df).collect()))
    assert got == [rows[1], rows[2]]


def test_near_copies_meet_by_fingerprints_alone(spark, monkeypatch):
    """The pipeline's stage finds texts within five bits by ball hashing, without a band that they share."""
    import corpus_pipeline
    from tidemark.llm import simhash as module

    shingle_set, bands = module.shingle_set, module.BANDS
    monkeypatch.setattr(module, "describe", lambda text, width: (np.frombuffer(xxhash.xxh3_128_digest(text) * (bands // 2), np.uint64) ^ np.arange(bands, dtype=np.uint64), shingle_set(text, width)))
    rng = random.Random(11)
    rows = []
    for g in range(12):
        base = [f"w{rng.randrange(10**6)}" for _ in range(600)]
        rows += [(10 * g + k, " ".join(base[: 600 - k])) for k in range(4)]
    # Fingerprints alike by what they repeat, with few shingles in common: the check on all shingles keeps them apart.
    for k in range(4):
        rows.append((900 + k, "the same few words again " * 3000 + " ".join(f"v{rng.randrange(10**6)}" for _ in range(20))))
    fps = [brute_fp(t) for _, t in rows]
    part = components(fps, 5)
    assert len(set(part[-4:])) == 1 and all(len(set(part[4 * g : 4 * g + 4])) < 4 for g in range(12))
    low = {p: min(i for (i, _), q in zip(rows, part) if p == q) for p in part}
    want = sorted(i for (i, _), p in zip(rows, part) if i >= 900 or low[p] == i)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.simhash_dedup(spark, df, "").collect()) == want


def test_groups_joined_by_fingerprints_and_bands(spark):
    """Chains of links of both kinds are whole, also through classes of several fingerprints and sets that are joined already."""
    from tidemark.llm.simhash import similar_groups

    rng = random.Random(12)
    rows, want = [], {}
    for g in range(10):
        base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        texts = [base, base[:299], base[:-1] + ["z"], [*base, *base[:296]], base[:260], base[:226], base[:225]]
        for k, w in enumerate(texts):
            rows.append((100 * g + k, " ".join(w)))
            want[100 * g + k] = 100 * g
    got = {r.id: r.group for r in similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want
    sh = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    a, b, c = sh(base), sh(base[:260]), sh(base[:226])
    assert len(c) / len(a) < 0.8 <= min(len(b) / len(a), len(c) / len(b))
    assert bin(brute_fp(rows[0][1]) ^ brute_fp(rows[4][1])).count("1") > 5


def test_two_blocks_lose_no_pair(spark):
    from tidemark.llm.simhash import NEAR_BITS, NEAR_BLOCKS

    rng = np.random.default_rng(6)
    fps = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    near = fps.copy()
    for i in range(len(near)):
        for b in rng.choice(64, 1 + i % 5, replace=False).tolist():
            near[i] ^= np.uint64(1 << b)
    df = spark.createDataFrame([(int(f),) for f in np.concatenate([fps, near]).view(np.int64)], "fp long")
    got = {frozenset((r.a, r.b)) for r in links(df, NEAR_BITS, NEAR_BLOCKS).collect()}
    assert got == {frozenset((int(a), int(b))) for a, b in zip(fps.view(np.int64), near.view(np.int64))}
