import random

from pyspark.sql import functions as F

from tidemark.llm._common import held_out
from tidemark.llm.langid import LanguageFilters, fit, grams_of, highest_share, identify, keep_identified, learn_grams, predict_documents
from tidemark.llm.queries import QUERIES

import numpy as np
import zlib

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = QUERIES["op1_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(got) == 1000 and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    out = [r for r in got if r.held_out]
    assert len(out) > 150 and sum(r.lang == r.lang_pred for r in out) / len(out) > 0.98


def test_held_out_rows_teach_nothing(spark):
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 4 == 2]
    df = spark.createDataFrame([(i, "secret words of the unseen", "xx") if i in ids else (i, "plain common text here", "en") for i in range(40)], "doc_id long, text string, lang string")
    assert fit(df, learn=~held_out(F.col("doc_id"))).langs == ("en",)


def test_edges(spark):
    rng = random.Random(1)
    words = {"aa": ["lorem", "ipsum", "dolor"], "bb": ["kwik", "zwok", "vrix"], "cc": ["ñandú", "čaj", "éau"]}
    rows = [(k, " ".join(rng.choice(words[lang]) for _ in range(30)), lang, "x") for k, lang in enumerate(["aa"] * 30 + ["bb"] * 20 + ["cc"] * 20)]
    extra = [(None, None, None, "x"), (100, "", "aa", "x"), (101, "123 !!", None, "x"), (102, "a", None, "x"), (103, "kwik zwok " * 30000, None, "x"), (103, "kwik zwok " * 30000, None, "x"), (104, "čaj", None, "x")]
    df = spark.createDataFrame(rows + extra, "doc_id long, text string, lang string, score string")
    f = fit(df)
    got = identify(df, f).collect()
    assert len(got) == len(rows) + len(extra)
    by = {r.id: r for r in got}
    assert (by[None].lang_pred, by[100].lang_pred, by[101].lang_pred, by[102].lang_pred, by[103].lang_pred, by[104].lang_pred) == ("und", "und", "und", "aa", "bb", "cc")
    assert by[102].score == 0 and by[103].score > 0.9
    kept = keep_identified(df, f)
    assert kept.columns == df.columns and kept.count() == len(rows) + 4
    assert identify(df.limit(0), f).count() == 0 and fit(df.limit(0)).langs == ()
    assert {r.lang_pred for r in identify(df, fit(df.limit(0))).collect()} == {"und"}


def test_many_languages_and_false_positives():
    rng = np.random.default_rng(0)
    grams = {f"l{k:03d}": rng.integers(0, 1 << 32, 20000, dtype=np.uint32) for k in range(70)}
    f = LanguageFilters.build(grams, log2_bits=16)
    assert f.table.shape[0] == 2 and 0 < f.fp.mean() < 0.5
    g, begins = grams_of(["ab cd", "x"])
    assert begins[0] == 0 and begins[-1] == len(g) and len(f.predict(["hello there"])[0]) == 1


def test_predictions_equal_a_recount_with_sets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    grams = {k: set(v.tolist()) for k, v in learn_grams(docs, learn=~held_out(F.col("doc_id"))).items()}
    filters = LanguageFilters.build({k: np.array(sorted(v), np.uint32) for k, v in grams.items()})
    got = {r.doc_id: r for r in predict_documents(docs).collect()}
    far = apart = 0
    for r in docs.select("doc_id", "text").collect():
        p = got[r.doc_id]
        if not r.text or not any(map(str.isalpha, r.text)):
            assert (p.lang_pred, p.score) == ("und", 0)
            continue
        raw = [b for b in r.text.lower().encode()]
        letters = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in raw)
        a = b"    " + letters + b"    "
        mine = [a[k : k + 4] for k in range(len(a) - 3) if b"  " not in (a[k : k + 2], a[k + 2 : k + 4])]
        share = {k: sum(int.from_bytes(g, "big") in v for g in mine) / max(1, len(mine)) for k, v in grams.items()}
        best = max(share, key=lambda k: (share[k], -filters.langs.index(k)))
        far += abs(share[best] - p.score) > 0.02
        apart += best != p.lang_pred and share[best] - share[p.lang_pred] > 0.02
    assert apart == 0 and far <= 0.01 * len(got)


def test_one_rule_for_texts_of_all_sizes(spark):
    assert highest_share(0.0, 0) == 1 and highest_share(1.0, 5) <= 1.0000001
    bounds = [highest_share(0.1, n) for n in range(1, 3000)]
    assert all(a >= b for a, b in zip(bounds, bounds[1:])) and bounds[0] > 0.8 and abs(bounds[-1] - 0.1) < 0.02
    words = ["lorem", "ipsum", "dolor", "amet", "sed", "elit"]
    known = [(k, " ".join(random.Random(k).choices(words, k=30)), "aa") for k in range(40)]
    f = fit(spark.createDataFrame(known, "doc_id long, text string, lang string"))
    odd = [(100 + n, " ".join(f"{chr(97 + (7 * k) % 26)}{chr(97 + (11 * k) % 26)}qxz" for k in range(n)), None) for n in (1, 2, 3, 4, 5, 6, 8, 40)]
    left = {r.doc_id for r in keep_identified(spark.createDataFrame(known + odd, "doc_id long, text string, lang string"), f).collect()}
    assert left >= set(range(40)) and 101 in left and 140 not in left
    gone = [n for n in (1, 2, 3, 4, 5, 6, 8, 40) if 100 + n not in left]
    assert gone == [n for n in (1, 2, 3, 4, 5, 6, 8, 40) if n >= gone[0]]  # what goes is what is long enough to prove it
