"""The corpus queries op1 to op13 and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from vecatlas.llm import decontam, golomb_dedup, html_extract, imatch, importance, langid, order_minhash, packing, prefix_trie, quality, sharding, token_files, toxicity
from vecatlas.llm.common import delete_at_exit, held_out, table, work_dir


def vocabulary(name):
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held_out("doc_id", 5, 0)))
    ids = docs.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "text")
    return toxicity.score(ids, model, keep=["doc_id", "held_out"])


def op2_best_fit_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), with_ids=False)


def op3_imatch_fingerprint(spark, sf_dir):
    return imatch.fingerprint_and_compare(table(spark, sf_dir, "documents"))


def op4_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels").where(~held_out("doc_id", 4, 2)))
    ids = docs.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "text")
    return quality.classify(ids, model, keep=["doc_id", "held_out"])


def op5_site_templates(spark, sf_dir):
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op6_decontamination(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.find(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return decontam.report(found, ["doc_id"])


OP6_SQL = r"""
WITH item_words AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS pattern
  FROM item_words, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS r(i) WHERE len(w) > 0
), doc_words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents
), hits AS (
  SELECT doc_id, i, size, item_id
  FROM (SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS pattern
        FROM doc_words, (SELECT DISTINCT size FROM windows), unnest(range(1, len(w) - size + 2)) AS r(i))
  JOIN windows USING (size, pattern)
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + size)) AS r(p) GROUP BY doc_id
), found AS (
  SELECT doc_id, count(item) AS n_items, sha256(coalesce(string_agg(item, ',' ORDER BY item), '')) AS items_sha256
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(f.n_items, 0) AS n_items,
       coalesce(f.items_sha256, sha256('')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN covered c ON d.doc_id = c.doc_id LEFT JOIN found f ON d.doc_id = f.doc_id
"""


def op7_token_files(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    folder = work_dir(spark)
    manifest = token_files.write(docs, vocabulary("word_bpe_49k.json"), folder)
    delete_at_exit(spark, folder)
    return token_files.read(spark, manifest, "doc_id", docs.schema["doc_id"].dataType)


def op8_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~held_out("doc_id", 4, 2)))
    ids = docs.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "text")
    return langid.identify(ids, model, keep=["doc_id", "held_out"])


def op9_order_minhash(spark, sf_dir):
    return order_minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_minimax_sharding(spark, sf_dir):
    return sharding.shard(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark, sf_dir):
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def crc32_sql(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes: each byte is followed by eight shifts (-1)."""
    pairs = f"flatten(list_transform(range(1, strlen({text}) * 2, 2), lambda i: [CAST('0x' || hex(encode({text}))[i : i + 1] AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))"
    return f"xor(list_reduce({pairs}, lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END, CAST(4294967295 AS BIGINT)), 4294967295)"


OP11_SQL = f"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY i) AS t, {crc32_sql("CAST(conv_id AS VARCHAR)")} % 6 AS h FROM turns GROUP BY conv_id
), built AS (
  SELECT o.conv_id, list_concat(coalesce(b.t[1 : o.h], []), o.t[o.h + 1 :]) AS t FROM own o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 100
), prefixes AS (
  SELECT conv_id, d AS depth, sha256(CAST(t[1 : d] AS VARCHAR)) AS node, sha256(CAST(t[1 : d - 1] AS VARCHAR)) AS parent, CASE WHEN d > 0 THEN length(t[d].text) ELSE 0 END AS len, d = len(t) AS ends
  FROM built, unnest(range(0, len(t) + 1)) AS r(d)
), nodes AS (
  SELECT node, depth, min(conv_id) AS conv_id, first(parent) AS parent, count(*) AS n_convs, (count(*) - 1) * first(len) AS saved,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM prefixes GROUP BY node, depth
), kids AS (
  SELECT parent AS node, depth - 1 AS depth, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL
), subtree AS (
  SELECT a.node, a.depth, sum(b.saved) AS saved, count(*) FILTER (k.n IS NULL) AS leaves
  FROM nodes b LEFT JOIN kids k ON k.node = b.node AND k.depth = b.depth JOIN prefixes p ON p.conv_id = b.conv_id AND p.depth <= b.depth JOIN nodes a ON a.node = p.node AND a.depth = p.depth GROUP BY ALL
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, s.leaves AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n LEFT JOIN nodes p ON n.depth > 0 AND p.node = n.parent AND p.depth = n.depth - 1 LEFT JOIN kids k ON k.node = n.node AND k.depth = n.depth JOIN subtree s ON s.node = n.node AND s.depth = n.depth
"""


def op12_importance_resampling(spark, sf_dir):
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP12_SQL = rf"""
WITH doc_words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), item_words AS (
  SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark
), s_words AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(w) AS word FROM doc_words) GROUP BY ALL
), t_words AS (SELECT word, count(*) AS n FROM item_words GROUP BY word
), known AS (SELECT word, {crc32_sql("word")} % 10000 AS bucket FROM (SELECT word FROM s_words UNION SELECT word FROM t_words)
), s AS (SELECT bucket, sum(n) AS n FROM s_words JOIN known USING (word) GROUP BY bucket
), t AS (SELECT bucket, sum(n) AS n FROM t_words JOIN known USING (word) GROUP BY bucket
), all_of AS (SELECT CAST(coalesce((SELECT sum(n) FROM s), 0) AS DOUBLE) AS s, CAST(coalesce((SELECT sum(n) FROM t), 0) AS DOUBLE) AS t
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln((CAST(coalesce(t.n, 0) AS DOUBLE) + 1) * (a.s + 10000) / ((CAST(coalesce(s.n, 0) AS DOUBLE) + 1) * (a.t + 10000)))) AS BIGINT) AS gain
  FROM s FULL JOIN t USING (bucket), all_of a
), weights AS (SELECT doc_id, sum(n * gain) AS weight FROM s_words JOIN known USING (word) JOIN gains USING (bucket) GROUP BY doc_id
), scored AS (
  SELECT d.doc_id, len(d.w) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
         CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || sha256(concat('2024:', d.doc_id))[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM doc_words d LEFT JOIN weights x ON d.doc_id = x.doc_id
)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score,
       CASE WHEN n_features >= 20 AND row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) <= 10 * count(*) FILTER (n_features >= 20) OVER () // 100
            THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS rank
FROM scored
"""


def op13_golomb_dedup(spark, sf_dir):
    return golomb_dedup.duplicates(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = min(doc_id) OVER same AS kept, sha256(t) AS text_sha256 FROM n WINDOW same AS (PARTITION BY t)
"""


def queries():
    return {
        f.__name__: f
        for f in (
            op1_toxicity, op2_best_fit_packing, op3_imatch_fingerprint, op4_quality, op5_site_templates, op6_decontamination, op7_token_files, op8_language_id, op9_order_minhash,
            op10_minimax_sharding, op11_prefix_trie, op12_importance_resampling, op13_golomb_dedup,
        )
    }


def oracle_sql():
    return {"op6_decontamination": OP6_SQL, "op11_prefix_trie": OP11_SQL, "op12_importance_resampling": OP12_SQL, "op13_golomb_dedup": OP13_SQL}
