"""The registered queries of this subpackage, each over its whole table, and their SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from weftline.llm import ann, bpe, embedding_dedup, packing, periodic, rules, secrets, sharding, simhash, surrogates, tokenbin, trie, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digests(_read(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op2_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(_read(spark, sf_dir, "documents"), shards=24)


def op3_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_read(spark, sf_dir, "pages"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=4096)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbin.round_trip(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_read(spark, sf_dir, "embeddings"), every=20, k=20)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"), words=3, most=3)


def op9_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.pseudonymise(_read(spark, sf_dir, "documents"), key="weftline").select("doc_id", "text", "n_entities", "entities")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_read(spark, sf_dir, "documents"))


def op11_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_read(spark, sf_dir, "embeddings"), threshold=0.98).drop("label")


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(_read(spark, sf_dir, "documents"), rebuild=True)


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(_read(spark, sf_dir, "conversations"), rebuild=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_shard": op2_shard,
    "op3_rules": op3_rules,
    "op4_warc": op4_warc,
    "op5_packing": op5_packing,
    "op6_token_files": op6_token_files,
    "op7_neighbours": op7_neighbours,
    "op8_simhash": op8_simhash,
    "op9_surrogates": op9_surrogates,
    "op10_secrets": op10_secrets,
    "op11_embeddings": op11_embeddings,
    "op12_periodic": op12_periodic,
    "op13_trie": op13_trie,
}

#: The letters of base32, in order.
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

#: CRC-32 of a number's decimal form: the reversed polynomial is 0xEDB88320.
def _crc32(number: str) -> str:
    digits = f"[ascii(d)::BIGINT FOR d IN string_split(({number})::VARCHAR, '')]"
    return f"xor(list_reduce([4294967295::BIGINT] || {digits}, lambda c, b: xor(c >> 8, list_reduce([xor(c, b) & 255] || [0::BIGINT FOR k IN range(8)], lambda x, k: xor(x >> 1, 3988292384 * (x & 1))))), 4294967295)"


_WORD = r"[^\x20\x09-\x0D]+"

ORACLE: dict[str, str] = {
    "op4_warc": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
        d AS (SELECT h, min(page_id) AS first FROM p GROUP BY h),
        b AS (SELECT h, first, unhex(upper(h))::BIT::VARCHAR AS bits FROM d)
        SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
               array_to_string(list_transform(range(32), lambda i: substr('{_BASE32}', 1 + (
                   16 * substr(bits, 5 * i + 1, 1)::INT + 8 * substr(bits, 5 * i + 2, 1)::INT + 4 * substr(bits, 5 * i + 3, 1)::INT
                   + 2 * substr(bits, 5 * i + 4, 1)::INT + substr(bits, 5 * i + 5, 1)::INT), 1)), '') AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to
        FROM p JOIN b USING (h)""",
    "op11_embeddings": """
        WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL),
        u AS (SELECT vec_id, label, e, sqrt(list_inner_product(e, e)) AS length FROM v WHERE NOT list_contains(list_transform(e, lambda x: x IS NULL OR NOT isfinite(x)), true)),
        l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND a.length > 0 AND b.length > 0
              WHERE list_inner_product(a.e, b.e) / (a.length * b.length) >= 0.98),
        r AS (SELECT vec_id AS node, vec_id AS root FROM embeddings UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node WHERE r.root < l.b),
        c AS (SELECT node, min(root) AS component_id FROM r GROUP BY 1), n AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
        SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings LEFT JOIN n ON n.a = vec_id JOIN c ON c.node = vec_id""",
    "op12_periodic": f"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS o, {_crc32("doc_id")} AS h FROM documents),
        g AS (SELECT doc_id, o, len(o) AS n, h, h // 10 AS g FROM d),
        a AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n ELSE n END AS a FROM g),
        p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
        w AS (SELECT doc_id, n, CASE WHEN a = n THEN o ELSE [o[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1] FOR i IN range(n)] END AS w FROM p),
        x AS (SELECT doc_id, n, unnest(range(n)) AS i, unnest(w) AS word FROM w),
        e AS (SELECT x.doc_id, y.i - x.i AS q, x.i AS i FROM x JOIN x y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
        s AS (SELECT doc_id, q, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island, i FROM e),
        m AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM s GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
        r AS (SELECT * FROM m WHERE NOT EXISTS (FROM m k WHERE k.doc_id = m.doc_id AND k.q < m.q AND k.start <= m.start AND k.start + k.length >= m.start + m.length)),
        b AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS runs,
                     first({{'s': start, 'l': length, 'q': q}} ORDER BY length DESC, start, q) AS best FROM r GROUP BY doc_id),
        c AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM x WHERE NOT EXISTS (FROM r WHERE r.doc_id = x.doc_id AND i >= start + q AND i < start + length) GROUP BY x.doc_id)
        SELECT w.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.s::BIGINT AS start, best.l::BIGINT AS length, best.q::BIGINT AS period, (1000 * best.l // best.q)::BIGINT AS exponent_milli,
               sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
        FROM w LEFT JOIN b USING (doc_id) LEFT JOIN c USING (doc_id)""",
    "op13_trie": f"""
        WITH o AS (SELECT conv_id, list({{'r': coalesce(role, ''), 'x': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS own FROM conversations GROUP BY conv_id),
        h AS (SELECT *, {_crc32("conv_id")} % 4 AS h FROM o),
        s AS (SELECT h.conv_id, list_concat(CASE WHEN b.conv_id IS NULL THEN [] ELSE b.own[1:h] END, h.own[h + 1:]) AS seq FROM h LEFT JOIN o b ON b.conv_id = h.conv_id - h.conv_id % 20),
        p AS (SELECT conv_id, len(seq) AS size, unnest(range(len(seq) + 1)) AS depth, seq FROM s),
        k AS (SELECT conv_id, depth, size, md5(to_json(seq[1:depth])) AS node, CASE WHEN depth > 0 THEN md5(to_json(seq[1:depth - 1])) END AS parent,
                     CASE WHEN depth > 0 THEN len(regexp_extract_all(seq[depth].x, '{_WORD}')) ELSE 0 END AS words FROM p),
        n AS (SELECT node, parent, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS saved,
                     coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (size = depth), '') AS ends FROM k GROUP BY node, parent, depth),
        c AS (SELECT parent AS node, count(*) AS n_children FROM n WHERE parent IS NOT NULL GROUP BY 1),
        a AS (SELECT DISTINCT k.node, u.node AS above FROM k JOIN k u ON k.conv_id = u.conv_id AND u.depth <= k.depth),
        t AS (SELECT above AS node, sum(saved) AS saved_tokens, count(*) FILTER (c.node IS NULL) AS n_leaves FROM a JOIN n USING (node) LEFT JOIN c USING (node) GROUP BY 1)
        SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
        FROM n LEFT JOIN n u ON n.parent = u.node LEFT JOIN c ON c.node = n.node JOIN t ON t.node = n.node""",
}
