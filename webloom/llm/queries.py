"""One registered query per operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm import ball_tree, best_fit, byte_cnn, jaccard_join, license_rules, license_scan, line_repeats, mixing, prefix_intervals, skip_chain_crf, structure_repair, suffix_decontaminate, suffix_dedup, warc
from webloom.llm.registry import query, table
from webloom.llm.repair_sql import CRC, repair_sql


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")



LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = "regexp_extract_all(" + LOWERED.format("coalesce(text, '')") + ", '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


@query(
    "op3_benchmark_decontamination",
    f"""
    WITH i AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, {WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
    iw AS (
      SELECT DISTINCT item_id, least(len(w), 13) AS n, list_aggregate(w[p : p + least(len(w), 13) - 1], 'string_agg', ' ') AS win
      FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS p FROM i WHERE len(w) > 0)
    ),
    d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
    dw AS (
      SELECT r, n, p, list_aggregate(w[p : p + n - 1], 'string_agg', ' ') AS win
      FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)
    ),
    m AS (SELECT r, p, n, item_id FROM dw JOIN iw USING (n, win)),
    h AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM m) GROUP BY r),
    g AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT r, item_id FROM m) GROUP BY r)
    SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
      coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM d LEFT JOIN h USING (r) LEFT JOIN g USING (r)
    """,
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(
    "op4_exact_top_k",
    """
    WITH v AS (
      SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
      WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), s AS (
      SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
    ), r AS (
      SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
    ) SELECT * FROM r WHERE rank <= 5
    """,
)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = ball_tree.quantised(table(spark, sf_dir, "embeddings"))
    return ball_tree.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0))


@query("op5_language_id")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", byte_cnn.held_out())
    model = byte_cnn.trained(docs.where("NOT held_out"))
    return byte_cnn.predict(docs, model, ("doc_id", "held_out"))


_BITS = "list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(concat('0b', substr(bits, 1 + 5 * k, 5)) AS INTEGER), 1))"


@query(
    "op6_warc_captures",
    f"""
    WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
    h AS (SELECT page_id, octet_length(b) AS payload_bytes, CAST(CAST(unhex(sha1(b)) AS BIT) AS VARCHAR) AS bits FROM p),
    d AS (SELECT page_id, payload_bytes, list_aggregate({_BITS}, 'string_agg', '') AS payload_digest FROM h),
    m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM d)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
      CASE WHEN page_id <> top THEN top END AS refers_to, CAST(3 AS BIGINT) AS n_records
    FROM m
    """,
)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_captures(table(spark, sf_dir, "pages"))


def _licence_sql() -> str:
    rules = ", ".join(f"({k}, {r.priority}, {r.confidence}, '{r.label}', '{r.first}', '{r.keyword}', '^(?:{r.pattern}) ')" for k, r in enumerate(license_rules.rules()))
    base = ", ".join(f"('{p}', {len(p.split())}, '{label}')" for p, label in license_rules.BASE)
    return f"""
    WITH rules(o, priority, confidence, label, first, keyword, pattern) AS (VALUES {rules}), phrases(phrase, n, label) AS (VALUES {base}),
    d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
    p AS (SELECT r, w, unnest(range(CAST(len(w) AS BIGINT))) AS i FROM d),
    c AS (SELECT r, i, w[i + 1] AS head, array_to_string(w[i + 1 : i + {license_rules.SPAN}], ' ') || ' ' AS t FROM p WHERE w[i + 1] IN (SELECT first FROM rules UNION SELECT split_part(phrase, ' ', 1) FROM phrases)),
    b AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM c JOIN phrases ON starts_with(t, phrase || ' ') GROUP BY r),
    f AS (SELECT r, i, priority, confidence, label, o, regexp_extract(t, pattern) AS m FROM c JOIN rules ON head = first AND contains(t, keyword)),
    h AS (SELECT *, len(m) - len(replace(m, ' ', '')) AS n FROM f WHERE m <> ''),
    h1 AS (SELECT r, i, i + n AS e, priority, confidence, label FROM h QUALIFY row_number() OVER (PARTITION BY r, i ORDER BY priority DESC, n DESC, o) = 1),
    k AS (SELECT * FROM h1 WHERE NOT EXISTS (SELECT 1 FROM h1 x WHERE x.r = h1.r AND x.i < h1.i AND x.e >= h1.e AND x.priority >= h1.priority)),
    l AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM k UNION SELECT r, label FROM c JOIN phrases ON starts_with(t, phrase || ' ')) GROUP BY r),
    s AS (SELECT r, max(confidence) AS top FROM k GROUP BY r)
    SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
      greatest(coalesce(top, 0.0), CASE WHEN n_base > 0 THEN 0.5 ELSE 0.0 END) AS score
    FROM d LEFT JOIN b USING (r) LEFT JOIN l USING (r) LEFT JOIN s USING (r)
    """


@query("op1_license_scan", _licence_sql())
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("detections")


@query("op2_pii_skip_chain")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return skip_chain_crf.personal_data(docs, skip_chain_crf.trained(docs))


@query("op9_best_fit_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pack(table(spark, sf_dir, "documents"), tokenizer_file())


@query("op10_line_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_repeats.report(table(spark, sf_dir, "documents"))


@query("op7_ngram_jaccard_join")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.linked(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("size").alias("n_shingles"), "component_id")


@query("op8_suffix_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(table(spark, sf_dir, "documents"))


@query("op13_source_mixing")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mixture(table(spark, sf_dir, "documents"), odds=mixing.fuller_first())
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies")


@query("op12_structure_repair", repair_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure_repair.report(table(spark, sf_dir, "conversations"))


@query(
    "op11_prefix_intervals",
    """
    WITH t AS (
      SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, role, text) AS s, """
    + CRC.format("CAST(conv_id AS VARCHAR)")
    + """ % 6 AS h
      FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
    ),
    b AS (SELECT t.conv_id, list_concat(coalesce(a.s[1 : t.h], []), t.s[t.h + 1 :]) AS s FROM t LEFT JOIN t a ON a.conv_id = t.conv_id - t.conv_id % 100),
    p AS (SELECT conv_id, s, len(s) AS n, unnest(range(0, CAST(len(s) AS BIGINT) + 1)) AS d FROM b),
    m AS (
      SELECT s[1 : d] AS prefix, d, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256
      FROM p GROUP BY s[1 : d], d
    ),
    c AS (SELECT prefix[1 : d - 1] AS prefix, d - 1 AS d, count(*) AS n_children FROM m WHERE d > 0 GROUP BY 1, 2),
    w AS (SELECT m.*, coalesce(n_children, 0) AS n_children, CASE WHEN d > 0 THEN (n_convs - 1) * length(prefix[-1].t) ELSE 0 END AS saved FROM m LEFT JOIN c USING (prefix, d)),
    u AS (
      SELECT prefix[1 : k] AS prefix, k AS d, CAST(sum(saved) AS BIGINT) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
      FROM (SELECT *, unnest(range(0, d + 1)) AS k FROM w) GROUP BY 1, 2
    )
    SELECT w.conv_id, w.d AS depth, o.conv_id AS parent_conv_id, w.n_convs, w.n_children, u.n_leaves, u.saved_tokens, w.ends_sha256
    FROM w JOIN u ON u.prefix = w.prefix AND u.d = w.d LEFT JOIN m o ON w.d > 0 AND o.d = w.d - 1 AND o.prefix = w.prefix[1 : w.d - 1]
    """,
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_intervals.report(table(spark, sf_dir, "conversations"))
