"""Registered queries of the training-data operators, and the SQL that DuckDB runs for those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return add


@query(
    "op5_decontaminate",
    """
    WITH items AS (
      SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
      FROM benchmark WHERE text IS NOT NULL),
    pats AS (
      SELECT DISTINCT item, least(13, len(w)) AS k, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS p
      FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM items WHERE len(w) > 0)),
    docs AS (
      SELECT rowid AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
      FROM (SELECT row_number() OVER () AS rowid, doc_id, text FROM documents)),
    wins AS (
      SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS p
      FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, (SELECT DISTINCT k FROM pats) WHERE len(w) >= k)),
    hits AS (SELECT wins.r, wins.i, wins.k, pats.item FROM wins JOIN pats USING (k, p)),
    covered AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS j FROM hits) GROUP BY r),
    found AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS s FROM hits GROUP BY r)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
      sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM docs LEFT JOIN covered USING (r) LEFT JOIN found USING (r)
    """,
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.decontam import decontamination_report

    return decontamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(
    "op7_warc",
    """
    WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
    d AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS h FROM p),
    g AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM d)
    SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest, CASE WHEN n < 100 OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
      CASE WHEN n < 100 OR page_id = first THEN NULL ELSE first END AS refers_to
    FROM g
    """,
)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.warc import page_catalogue

    return page_catalogue(table(spark, sf_dir, "pages"))


@query(
    "op2_chat_format",
    """
    WITH c AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
    e AS (SELECT *, length(role) + length(text) + 14 + 1 + length(regexp_replace(role || text, '[^\\\\#<:]', '', 'g')) AS f FROM c)
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
      CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, CAST(sum(f) AS BIGINT) AS formatted_chars
    FROM e GROUP BY conv_id
    """,
)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.chat import digest_conversations, format_conversations

    said = "\\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return digest_conversations(format_conversations(rows)).withColumnRenamed("key", "conv_id")


@query("op1_language_id")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.langid import predict_documents

    return predict_documents(table(spark, sf_dir, "documents"))


@query("op8_token_counts")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidemark.llm.tokencount import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")).withColumnRenamed("id", "doc_id")


def _license_sql() -> str:
    from tidemark.llm.licenses import CONTAINMENT, PHRASES, TEMPLATES, tokens_of

    low = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    quote = lambda toks: "[" + ", ".join(f"'{t}'" for t in toks) + "]"
    templates = ", ".join(f"('{label}', {quote(sorted(set(tokens_of(t))))})" for label, t in TEMPLATES.items())
    phrases = ", ".join(f"('{label}', {quote(tokens_of(p))})" for p, label in PHRASES.items())
    return f"""
    WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
    w AS (SELECT r, doc_id, {low.format("text")} AS w FROM docs),
    t(label, t) AS (VALUES {templates}),
    p(label, p) AS (VALUES {phrases}),
    hits AS (SELECT r, label, i - 1 AS pos FROM (SELECT r, w, label, p, unnest(range(1, len(w) + 1)) AS i FROM w, p) WHERE w[i] = p[1] AND w[i:i + len(p) - 1] = p),
    lines AS (SELECT r, list_distinct({low.format("line")}) AS b FROM (SELECT r, unnest(regexp_split_to_array(text, '\\n[ \\t\\r\\x0B\\x0C]*\\n')) AS line FROM docs)),
    found AS (SELECT r, label, max(len(list_intersect(b, t)) / len(t)) AS c FROM lines, t WHERE len(list_intersect(b, t)) >= ceil({CONTAINMENT} * len(t) - 1e-9) GROUP BY r, label),
    h AS (SELECT r, count(*) AS n, min(pos) AS a, max(pos) AS z, string_agg(DISTINCT label, ',' ORDER BY label) AS s FROM hits GROUP BY r),
    f AS (SELECT r, max(c) AS c FROM found GROUP BY r),
    l AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS s FROM (SELECT r, label FROM hits UNION SELECT r, label FROM found) GROUP BY r)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_base, CAST(h.a AS BIGINT) AS first_word, CAST(h.z AS BIGINT) AS last_word,
      coalesce(h.s, '') AS base_labels, coalesce(l.s, '') AS labels, CAST(CASE WHEN h.n > 0 THEN 1 ELSE coalesce(f.c, 0) END AS DOUBLE) AS score
    FROM w LEFT JOIN h USING (r) LEFT JOIN f USING (r) LEFT JOIN l USING (r)
    """


@query("op3_license_scan", _license_sql())
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.licenses import license_report

    return license_report(table(spark, sf_dir, "documents"))


def _multiset_sql() -> str:
    from tidemark.llm.multiset import CELLS, LANES

    digits = lambda k: f"CAST('0x' || substr(h, {8 * k + 1}, 8) AS UBIGINT)"
    lanes = ", ".join(f"sum(CAST({digits(k)} AS HUGEINT)) & 4294967295 AS l{k}" for k in range(LANES))
    hexes = " || ".join(f"printf('%08x', CAST(coalesce(l{k}, 0) AS BIGINT))" for k in range(LANES))
    return f"""
    WITH d AS (SELECT row_number() OVER (ORDER BY doc_id DESC) AS r, doc_id, coalesce(text, '') AS text FROM documents),
    n AS (SELECT *, length(text) AS n, coalesce(lead(text) OVER (ORDER BY r), first_value(text) OVER (ORDER BY r)) AS nxt FROM d),
    e AS (SELECT *, left(text, n - n // 2) || left(nxt, n // 2) AS changed FROM n),
    v AS (SELECT r, 0 AS kind, text AS t FROM e UNION ALL SELECT r, 1, changed FROM e),
    p AS (SELECT r, kind, unnest(string_split(regexp_replace(t, '([.!?]) +', '\\1' || chr(10), 'g'), chr(10))) AS p FROM v),
    h AS (SELECT r, kind, sha256(encode(p)) || sha256('\\x01'::BLOB || encode(p)) AS h FROM p WHERE p <> ''),
    l AS (SELECT r, kind, count(*) AS c, {lanes} FROM h GROUP BY r, kind),
    c AS (SELECT r, kind, {digits(0)} % {CELLS} AS cell, CAST(sum(CASE WHEN {digits(1)} % 2 = 0 THEN 1 ELSE -1 END) AS BIGINT) AS s FROM h GROUP BY ALL),
    g AS (SELECT v.r, v.kind, k AS cell, coalesce(s, 0) AS s FROM v CROSS JOIN (SELECT unnest(range({CELLS})) AS k) LEFT JOIN c ON c.r = v.r AND c.kind = v.kind AND c.cell = k),
    f AS (
      SELECT r, kind, printf('%08x', CAST(coalesce(c, 0) AS BIGINT)) || {hexes} || t AS f, coalesce(c, 0) AS c, s
      FROM (SELECT r, kind, string_agg(printf('%04x', s & 65535), '' ORDER BY cell) AS t, list(s ORDER BY cell) AS s FROM g GROUP BY r, kind) LEFT JOIN l USING (r, kind)),
    m AS (SELECT count(*) AS m FROM d),
    j AS (SELECT e.*, a.f AS fa, b.f AS fb, x.f AS fx, a.c AS ca, b.c AS cb, x.c AS cx, a.s AS sa, b.s AS sb, x.s AS sx
      FROM e JOIN m ON true JOIN f a ON a.r = e.r AND a.kind = 0 JOIN f b ON b.r = e.r AND b.kind = 1 JOIN f x ON x.r = e.r % m + 1 AND x.kind = 0)
    SELECT doc_id, n AS n_chars, sha256(encode(changed)) AS edited_sha256, fa AS fingerprint, fb AS edited_fingerprint,
      CASE WHEN fa = fb THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1 - list_sum(list_transform(list_zip(sa, sb), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) / greatest(ca + cb, 1)) END AS near_edited,
      CASE WHEN fa = fx THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1 - list_sum(list_transform(list_zip(sa, sx), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) / greatest(ca + cx, 1)) END AS near_next
    FROM j
    """


@query("op6_multiset_fingerprint", _multiset_sql())
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.multiset import fingerprint_report

    return fingerprint_report(table(spark, sf_dir, "documents"))


@query("op4_simhash")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.simhash import near_duplicate_report

    return near_duplicate_report(table(spark, sf_dir, "documents"))


@query(
    "op9_substring_dedup",
    """
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    v AS (SELECT r, doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
    m AS (SELECT g, min(doc_id) AS low FROM v GROUP BY g),
    c AS (SELECT DISTINCT r, j FROM (SELECT r, unnest(range(i, i + 13)) AS j FROM v JOIN m USING (g) WHERE low < doc_id)),
    k AS (SELECT r, list(j) AS js FROM c GROUP BY r)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(js), 0) AS BIGINT) AS n_removed,
      sha256(encode(coalesce(array_to_string(CASE WHEN js IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(js, i)) END, ' '), ''))) AS kept_sha256
    FROM d LEFT JOIN k USING (r)
    """,
)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.substring import substring_report

    return substring_report(table(spark, sf_dir, "documents"))


@query("op10_pack")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidemark.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")
