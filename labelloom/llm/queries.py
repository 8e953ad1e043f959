"""The queries of the subpackage, over whole tables, and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from labelloom.llm import brown, fixity, interaction, langid, mixing, packing, phrases, pii, rangejoin, sharding, simhash, topk, winnowing


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"))


def op2_metric_range_join(spark: SparkSession, sf: str) -> DataFrame:
    return rangejoin.near_vectors(table(spark, sf, "embeddings"), 0.93)


def op3_threshold_topk(spark: SparkSession, sf: str) -> DataFrame:
    vectors = topk.quantised(table(spark, sf, "embeddings"))
    return topk.top_inner_products(vectors, vectors.where("vec_id % 50 = 0"), 5)


def op4_segmentation_langid(spark: SparkSession, sf: str) -> DataFrame:
    found = langid.fit_and_identify(table(spark, sf, "documents").select("doc_id", "text", "lang"))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op5_simhash_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf, "documents"))
    return found.select("doc_id", simhash.fingerprint_hex().alias("fingerprint"), "component_id")


def op6_hilbert_shards(spark: SparkSession, sf: str) -> DataFrame:
    assigned = sharding.document_shards(table(spark, sf, "documents"), 24)
    return assigned.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve_index"
    )


def op7_bootstrapped_pii(spark: SparkSession, sf: str) -> DataFrame:
    found = pii.find(table(spark, sf, "documents").select("doc_id", "text"))
    counts = [pii.count_of(i) for i in range(len(pii.KINDS))]
    return found.select(
        "doc_id",
        *[n.alias(f"n_{kind}") for n, kind in zip(counts, pii.KINDS)],
        F.sha2(pii.written(F.col("base")), 256).alias("base_sha256"),
        pii.written(F.col("spans")).alias("spans"),
    )


def op8_merkle_fixity(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    return fixity.audit(pages, fixity.decayed(pages))


def op9_block_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.taken_words(mixing.mix(table(spark, sf, "documents")))


def op10_brown_lm(spark: SparkSession, sf: str) -> DataFrame:
    found = brown.fit_and_score(table(spark, sf, "documents").select("doc_id", "text"))
    return found.withColumn("held_out", brown.held_out())


def op11_prefix_free_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return phrases.collocations(table(spark, sf, "documents"))


def op12_winnowing_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    found = winnowing.against_edited(table(spark, sf, "documents"))
    return found.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "positions")


def op13_filter_interactions(spark: SparkSession, sf: str) -> DataFrame:
    return interaction.audit(table(spark, sf, "documents"), table(spark, sf, "labels"))


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_metric_range_join": op2_metric_range_join,
    "op3_threshold_topk": op3_threshold_topk,
    "op4_segmentation_langid": op4_segmentation_langid,
    "op5_simhash_near_duplicates": op5_simhash_near_duplicates,
    "op6_hilbert_shards": op6_hilbert_shards,
    "op7_bootstrapped_pii": op7_bootstrapped_pii,
    "op8_merkle_fixity": op8_merkle_fixity,
    "op9_block_mix": op9_block_mix,
    "op10_brown_lm": op10_brown_lm,
    "op11_prefix_free_collocations": op11_prefix_free_collocations,
    "op12_winnowing_fingerprints": op12_winnowing_fingerprints,
    "op13_filter_interactions": op13_filter_interactions,
}

OP2_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT *, sqrt(list_dot_product(x, x)) AS norm FROM v),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_dot_product(a.x, b.x) / (a.norm * b.norm) >= 0.93),
reach(vec_id, other) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON r.other = l.a),
linked AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT r.vec_id, coalesce(any_value(n_links), 0) AS n_links, min(other) AS component_id, r.vec_id = min(other) AS kept
FROM reach r LEFT JOIN linked ON r.vec_id = a GROUP BY r.vec_id
"""
OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.x AS DOUBLE[]), CAST(c.x AS DOUBLE[])) AS BIGINT) AS score
  FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM scored)
SELECT * FROM ranked WHERE rank <= 5
"""
OP8_SQL = r"""
WITH numbered AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html,
         row_number() OVER (ORDER BY page_id) - 1 AS node FROM pages),
both_sides AS (
  SELECT node, page_id, url, html, CASE WHEN page_id % 50 = 7 THEN translate(html, 'e', '3') ELSE html END AS other FROM numbered),
heads AS (
  SELECT *, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id
         || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Length: ' || strlen(html)
         || chr(13) || chr(10) || chr(13) || chr(10) AS head, chr(13) || chr(10) || chr(13) || chr(10) AS tail FROM both_sides),
records AS (
  SELECT node, page_id, strlen(head || html || tail) AS length, sha256(head || html || tail) AS expected, sha256(head || other || tail) AS found FROM heads),
placed AS (
  SELECT page_id, node // 4096 AS file, node % 4096 AS record,
         CAST(sum(length) OVER (PARTITION BY node // 4096 ORDER BY node) - length AS BIGINT) AS "offset", length, expected, found FROM records)
SELECT page_id, file, record, "offset", length, expected, found FROM placed WHERE expected <> found
"""
OP11_SQL = r"""
WITH texts AS (
  SELECT coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM texts),
split AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces),
grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(words) - k + 2), lambda i: array_to_string(words[i:i + k - 1], ' '))) AS phrase
  FROM split, range(1, 6) s(k)),
f AS (SELECT lang, phrase, k AS words, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 100),
totals AS (SELECT lang, sum(len(words))::BIGINT AS n FROM split GROUP BY lang),
candidates AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE words > 1),
covered AS (
  SELECT DISTINCT c.lang, c.phrase FROM candidates c JOIN candidates o ON c.lang = o.lang AND o.words > c.words
    AND contains(' ' || o.phrase || ' ', ' ' || c.phrase || ' ') AND 100 * o.a >= 100 * c.a),
cuts AS (
  SELECT c.*, k, array_to_string(w[1:k], ' ') AS p, array_to_string(w[k + 1:], ' ') AS q
  FROM candidates c ANTI JOIN covered USING (lang, phrase), range(1, 5) s(k) WHERE k < words),
scored AS (
  SELECT c.lang, c.phrase, c.a, k, x.a AS l, y.a AS r, n, (1000::HUGEINT * c.a * n) // (x.a::HUGEINT * y.a) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = p JOIN f y ON y.lang = c.lang AND y.phrase = q JOIN totals t ON t.lang = c.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""
OP13_SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
said AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
firsts AS (SELECT text, min(doc_id) AS first FROM texts GROUP BY text),
failed AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CAST(len(words) < 200 AS INT)
    + 2 * CAST(100 * len(list_distinct(words)) < 50 * len(words) AS INT)
    + 4 * CAST(100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text) AS INT)
    + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INT)
    + 16 * CAST(coalesce(texts.doc_id > first, false) AS INT) AS bits
  FROM texts JOIN firsts USING (text) LEFT JOIN said ON texts.doc_id = said.doc_id),
cells AS (SELECT part, bits, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order,
    [a.bit, b.bit, c.bit, d.bit, e.bit] AS steps
  FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps AS (
  SELECT filter_order, CAST(step AS INT) AS step, steps[step] AS bit, coalesce(list_sum(steps[1:step - 1]), 0)::BIGINT AS earlier
  FROM orders, range(1, 6) s(step)),
counted AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN bits & (earlier | bit) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN bits & bit <> 0 AND bits & earlier = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN bits & bit <> 0 AND bits & earlier <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN bits = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN bits & bit <> 0 AND bits & earlier = 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN bits & bit <> 0 AND bits & earlier = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM cells, steps GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM counted
"""
ORACLES: dict[str, str] = {
    "op2_metric_range_join": OP2_SQL,
    "op8_merkle_fixity": OP8_SQL,
    "op3_threshold_topk": OP3_SQL,
    "op11_prefix_free_collocations": OP11_SQL,
    "op13_filter_interactions": OP13_SQL,
}
