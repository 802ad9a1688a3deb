import json
import random
import zlib

import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tidemark.llm.queries import QUERIES
from tidemark.llm.tokencount import PrefixCounter, answer, count_at, count_tokens, counter, longest_within, prefix_tables

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIB = Tokenizer.from_file(PATH)


def n_lib(texts):
    return [len(e.ids) for e in LIB.encode_batch(texts, add_special_tokens=False)]


def check(text):
    c = counter(PATH)
    want = n_lib([text[:k] for k in range(len(text) + 1)])
    assert c.prefix_counts(text) == want, text
    packed = zlib.compress(c.table(text))
    for limit in {0, 1, 2, want[-1] // 2, want[-1] - 1, want[-1], want[-1] + 3}:
        if limit >= 0:
            longest = max(k for k, n in enumerate(want) if n <= limit)
            assert longest == longest_within(packed, limit), (text, limit)
    assert count_at(packed, len(text) // 2) == want[len(text) // 2]


@pytest.mark.parametrize("text", ["", " ", "a  b", "a \n\n  b", "it's we'll they've 're", "x<|endoftext|>y !!<|endoftext|> <|endof", "  <|endoftext|>  a", "ñandú éèê日本語テスト😀😀", "aaaaaaaaaaaaaaaaaaaaaaaa", "a 　 b", "\x1c\x1d x \x85 y", "123 4567 ²Ⅷ", "tab\t\tx", "é ́", "                    x"])
def test_known(text):
    check(text)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([*"ab'lesrtv \n\t!<|>1é日😀 ", "<|endoftext|>", "the ", "    "]), max_size=40).map("".join))
def test_prefixes_equal_the_library(text):
    check(text)


def test_query_edges(spark):
    rng = random.Random(5)
    long = " ".join("".join(rng.choice("thanerosiet") for _ in range(rng.randrange(1, 14))) for _ in range(20_000))
    rows = [(1, "hello world", "x"), (2, None, "x"), (3, "", "x"), (4, long, "x"), (4, long, "x"), (None, "<|endoftext|>", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = count_tokens(df, PATH, 1024).collect()
    want = dict(zip([r[1] for r in rows], n_lib([r[1] or "" for r in rows])))
    assert sorted((r.id or 0, r.n_tokens) for r in got) == sorted((r[0] or 0, want[r[1]]) for r in rows)
    four = next(r for r in got if r.id == 4)
    assert four.over_limit and n_lib([long[: four.fit_chars]])[0] <= 1024 < n_lib([long[: four.fit_chars + 1]])[0]
    assert count_tokens(df.limit(0), PATH).count() == 0
    t = {r.id: r.prefixes for r in prefix_tables(df.filter("doc_id < 4"), PATH).collect()}
    assert count_at(t[1], 5) == n_lib(["hello"])[0] and count_at(t[2], 9) == 0


def test_query_equals_the_library_on_the_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip([r.doc_id for r in docs], n_lib([r.text or "" for r in docs])))
    got = QUERIES["op8_token_counts"](spark, sf).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in got} == {r.doc_id: (len((r.text or "").encode()), want[r.doc_id], want[r.doc_id] > 1024) for r in docs}
    assert len(got) == len(docs)


def test_stored_tables_answer_any_limit(spark):
    rows = [(k, " ".join(f"word{j * k}" for j in range(k))) for k in range(40)]
    tables = prefix_tables(spark.createDataFrame(rows, "doc_id long, text string"), PATH)
    for limit in (0, 1, 17):
        for r in answer(tables, limit).collect():
            n = n_lib([rows[r.id][1][:k] for k in range(len(rows[r.id][1]) + 1)])
            assert r.n_tokens == n[-1] and r.over_limit == (n[-1] > limit) and r.fit_chars == max(k for k, x in enumerate(n) if x <= limit)


def test_other_tokenizers_are_refused(tmp_path):
    spec = json.load(open(PATH))
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": {**spec["model"], "type": "WordPiece"}}):
        (tmp_path / "t.json").write_text(json.dumps({**spec, **change}))
        with pytest.raises(ValueError):
            PrefixCounter(str(tmp_path / "t.json"))


def test_pairs_stay_apart_as_their_merges_say():
    c, rng = counter(PATH), random.Random(11)
    tokens = sorted(c.tokens, key=lambda t: c.rank[t])
    pairs = [(rng.choice(tokens[: 10 ** rng.randrange(2, 6)]), rng.choice(tokens[: 10 ** rng.randrange(2, 6)])) for _ in range(20_000)]
    for t in rng.sample(tokens, 3000):  # pairs that are likely to merge elsewhere
        k = rng.randrange(1, len(t) + 1)
        pairs += [(x, y) for x, y in ((t[:k], t[k:]), (t, t), (t[k:], t)) if x in c.tokens and y in c.tokens]
    for a, b in pairs:
        assert c._may_follow(a, b) == (c._merge(a + b) == [a, b]), (a, b)
