import hashlib

from pyspark.sql import functions as F

from tidemark.llm.chat import canonical_turns, digest_conversations, read_back, render


def test_layouts_map_to_the_same_turns(spark):
    rows = [
        '{"id":1,"messages":[{"role":"user","content":"hi"},{"role":"assistant","content":"yo"}],"extra":5}',
        '{"id":2,"conversations":[{"from":"human","value":"hi"},{"from":"gpt","value":"yo"}]}',
        '{"id":3,"prompt":"hi","response":"yo"}',
        '{"id":4,"instruction":"hi","output":"yo"}',
        '{"id":5,"turn":0,"role":"user","text":"hi"}',
        '{"id":5,"turn":1,"role":"assistant","text":"yo"}',
        '{"id":6,"prompt":"hi","instruction":"both"}',
    ]
    df = spark.read.json(spark.createDataFrame([(r,) for r in rows], "value string").select("value").rdd.map(lambda r: r[0]))
    got = canonical_turns(df, "id")
    assert {r.key for r in got.filter("layout is null").collect()} == {6}
    by = digest_conversations(read_back(render(got))).collect()
    assert len(by) == 5 and len({(r.turns_sha256, r.loss_sha256, r.n_turns) for r in by}) == 1
    assert by[0].turns_sha256 == hashlib.sha256(b"user\nhi\nassistant\nyo\n").hexdigest()


def test_hostile_texts_round_trip(spark):
    texts = ["", None, "### Assistant: </turn> ok", "\\", "\\\\#", "a </turn>\n### user: b", ": ", "#" * 7, "é\U0001f600$1", "x" * 100_000, "\r\n\t"]
    roles = ["user", "assistant", None, "we:ird #\\", ""]
    rows = [(k % 3 if k % 7 else None, k, roles[k % len(roles)], t, "z") for k, t in enumerate(texts * 5)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, key string")
    got = read_back(render(canonical_turns(df.drop("key"), "conv_id")))
    assert got.filter((F.col("role") != F.col("role_back")) | (F.col("text") != F.col("text_back"))).count() == 0
    assert got.filter(F.when(F.col("role") == "assistant", F.col("text")).otherwise("") != F.col("loss_back")).count() == 0
    out = {r.key: r for r in digest_conversations(got).collect()}
    for key in (None, 0, 1, 2):
        mine = [r for r in rows if r[0] == key]
        assert out[key].n_turns == len(mine)
        assert out[key].turns_sha256 == hashlib.sha256("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine).encode()).hexdigest()
        assert out[key].loss_sha256 == hashlib.sha256("".join(r[3] or "" for r in mine if r[2] == "assistant").encode()).hexdigest()
    assert digest_conversations(got.limit(0)).count() == 0
