import random
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tidemark.llm.packing import WordEncoder, best_pattern, generate_columns, pack, plan_patterns
from tidemark.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")
LIB = Tokenizer.from_file(PATH)
OWN = WordEncoder(PATH)


def lib_ids(text):
    return LIB.encode(text or "", add_special_tokens=False).ids + [2]


def audit(rows, got, capacity=4096):
    """Every id once, right checksums, gapless sequences; returns ids and padded room."""
    left = {}
    for i, t in rows:
        left.setdefault((i, len(lib_ids(t))), []).append(np.array(lib_ids(t), "<u4"))
    seqs, pieces = {}, {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length, r.ids_crc32))
    assert set(pieces) == set(left)
    for key, docs in left.items():
        want = {}
        for start, n, crc in pieces[key]:
            assert any(zlib.crc32(d[start : start + n].tobytes()) == crc for d in docs)
            for k in range(start, start + n):
                want[k] = want.get(k, 0) + 1
        assert want == {k: len(docs) for k in range(key[1])}
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at and n > 0
            at += n
        assert at <= capacity
    total = sum(n for s in seqs.values() for _, n in s)
    return total, len(seqs) * capacity


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    total, room = audit(rows, QUERIES["op10_pack"](spark, "/root/testdata/sf0.01").collect())
    assert room - total < 4096 + 0.01 * room


def test_edges(spark):
    rng = random.Random(0)
    rows = [(1, None), (2, ""), (3, "a"), (3, "a"), (3, "b b"), (None, "null id"), (None, "null id"), (4, "w " * 4095), (5, "w " * 4096), (6, "w " * 30_000)]
    rows += [(100 + k, "same copy of words " * 40) for k in range(400)]
    rows += [(1000 + k, "x " * rng.randrange(1, 5000)) for k in range(300)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, start string")
    total, room = audit(rows, pack(df, PATH).withColumnRenamed("id", "doc_id").collect())
    assert room - total < 4096 + 0.02 * room
    assert pack(df.limit(0), PATH).count() == 0
    for few in ("doc_id = 5", "doc_id in (1, 5, 6)", "doc_id = 4", "doc_id in (1, 2)"):  # full sequences beside a single other one, or none
        part = [r for r in rows if r[0] in {"doc_id = 5": (5,), "doc_id in (1, 5, 6)": (1, 5, 6), "doc_id = 4": (4,), "doc_id in (1, 2)": (1, 2)}[few]]
        audit(part, pack(df.filter(few), PATH).withColumnRenamed("id", "doc_id").collect())


def test_columns_are_optimal_on_a_known_case():
    value, pattern = best_pattern(np.array([0.5, 0.34]), np.array([5, 3]), 11)
    assert pattern.tolist() == [1, 2] and abs(value - 1.18) < 1e-9
    basis, x = generate_columns(np.array([3, 5, 9]), np.array([30.0, 20.0, 10.0]), 10)
    assert abs(x.sum() - (10 + 10 + 10)) < 1e-6 and (basis @ np.array([3, 5, 9]) <= 10).all()
    plan = plan_patterns({3: 30, 5: 20, 9: 10}, 10)
    seq = plan.place(np.array([9] * 11), np.arange(11))
    assert len(set(seq.tolist())) == 11 and seq[-1] == -1


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([*"ab'sÉéßΣςİ\n\t .,!?1²é日 ", "<|endoftext|>", "<|startoftext|>", "word", "it's", "…", "Ω"]), max_size=25).map("".join))
def test_ids_equal_the_library(text):
    assert np.frombuffer(OWN.encode(text), "<u4").tolist() == LIB.encode(text, add_special_tokens=False).ids


def test_other_tokenizers_are_refused(tmp_path):
    import json

    import pytest

    spec = json.load(open(PATH))
    for change in ({"normalizer": None}, {"pre_tokenizer": {"type": "Whitespace"}}, {"post_processor": {"type": "BertProcessing"}}):
        (tmp_path / "t.json").write_text(json.dumps({**spec, **change}))
        with pytest.raises(ValueError):
            WordEncoder(str(tmp_path / "t.json"))
