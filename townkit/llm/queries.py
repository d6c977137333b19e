"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from townkit.llm import contamination, credentials, frames, hosts, jaccard, mixing, packing, periods, suffixes, tokens, toxicity, treaps, vectors


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hosts.judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


def op8_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.read_token_files(frames.write_token_files(table(spark, sf_dir, "documents")))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_classes(table(spark, sf_dir, "documents"))


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.find_secrets(table(spark, sf_dir, "documents"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return treaps.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.run_digests(periods.periodic_runs(periods.with_planted_runs(table(spark, sf_dir, "documents"))))


QUERIES = {f.__name__: f for f in (op1_url_filters, op2_suffix_array_dedup, op3_token_counts, op4_embedding_near_dedup, op5_toxicity, op6_best_fit_packing, op7_benchmark_decontamination, op8_token_frames, op9_ngram_jaccard_join, op10_secret_scans, op11_ranked_search, op12_source_mixing, op13_periodic_runs)}

#: The reputation of op1 in SQL: the same moment estimates and posteriors.
OP1_SQL = r"""
WITH urls AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT page_id, CASE WHEN url IS NOT NULL AND instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages)),
known AS (SELECT doc_id AS page_id, count(quality) AS n, sum(quality) AS k FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id),
sums AS (SELECT host, coalesce(sum(n), 0)::DOUBLE AS n, coalesce(sum(k), 0)::DOUBLE AS k FROM urls LEFT JOIN known USING (page_id) GROUP BY host),
parts AS (SELECT *, string_split(regexp_replace(host, '^.*@|:[0-9]*$', '', 'g'), '.') AS labels FROM sums),
sized AS (SELECT *, CASE WHEN len(labels) > 1 AND length(labels[-1]) = 2 AND labels[-2] IN ('ac', 'co', 'com', 'edu', 'gov', 'net', 'org') THEN 2 ELSE 1 END AS m FROM parts),
outcomes AS (SELECT host, n, k, array_to_string(labels[greatest(1, len(labels) - m):], '.') AS domain, array_to_string(labels[greatest(1, len(labels) - m + 1):], '.') AS suffix FROM sized),
s0 AS (SELECT suffix, sum(n) AS n, sum(k) AS k, (SELECT (sum(k) + 1) / (sum(n) + 2) FROM outcomes) AS mu FROM outcomes GROUP BY suffix),
s1 AS (SELECT *, (SELECT greatest(0.001, least(0.5, CASE WHEN sum(n * (n - 1) * mu * (1 - mu)) > 0 THEN sum((k - n * mu) * (k - n * mu) - n * mu * (1 - mu)) / sum(n * (n - 1) * mu * (1 - mu)) ELSE 0.5 END)) FROM s0) AS rho FROM s0),
s2 AS (SELECT suffix, (mu * (1 / rho - 1) + k) / (1 / rho - 1 + n) AS mean FROM s1),
d0 AS (SELECT suffix, domain, sum(n) AS n, sum(k) AS k, any_value(s2.mean) AS mu FROM outcomes JOIN s2 USING (suffix) GROUP BY suffix, domain),
d1 AS (SELECT *, (SELECT greatest(0.001, least(0.5, CASE WHEN sum(n * (n - 1) * mu * (1 - mu)) > 0 THEN sum((k - n * mu) * (k - n * mu) - n * mu * (1 - mu)) / sum(n * (n - 1) * mu * (1 - mu)) ELSE 0.5 END)) FROM d0) AS rho FROM d0),
d2 AS (SELECT suffix, domain, (mu * (1 / rho - 1) + k) / (1 / rho - 1 + n) AS mean FROM d1),
h0 AS (SELECT host, n, k, d2.mean AS mu FROM outcomes JOIN d2 USING (suffix, domain)),
h1 AS (SELECT *, (SELECT greatest(0.001, least(0.5, CASE WHEN sum(n * (n - 1) * mu * (1 - mu)) > 0 THEN sum((k - n * mu) * (k - n * mu) - n * mu * (1 - mu)) / sum(n * (n - 1) * mu * (1 - mu)) ELSE 0.5 END)) FROM h0) AS rho FROM h0),
h2 AS (SELECT host, (mu * (1 / rho - 1) + k) / (1 / rho - 1 + n) AS mean, 1 / rho - 1 + n AS strength FROM h1),
bound AS (SELECT host, mean, mean + 1.645 * sqrt(mean * (1 - mean) / (strength + 1)) AS upper FROM h2),
rules(verdict, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
judged AS (SELECT urls.*, mean, upper, (SELECT max_by(h || p || ' ' || rules.verdict, (length(h || p), h || p)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS fit FROM urls JOIN bound USING (host))
SELECT page_id, host, path, split_part(fit, ' ', 1) AS rule, coalesce(split_part(fit, ' ', 2), CASE WHEN upper < 0.8 THEN 'block' ELSE 'allow' END) AS verdict,
       round(mean, 6) AS good_mean, round(upper, 6) AS good_upper FROM judged
"""

#: Exact containment of each item in each document that shares a shingle with it; text_hash is left to Spark's hash, so it is not compared.
OP7_SQL = r"""
WITH item_words AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
items AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM item_words WHERE len(w) > 0)),
sized AS (SELECT item_id, s, count(*) OVER (PARTITION BY item_id) AS item_shingles FROM items),
lengths AS (SELECT DISTINCT least(len(w), 5) AS m FROM item_words WHERE len(w) > 0),
doc_words AS (SELECT DISTINCT doc_id, text, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
places AS (SELECT doc_id, text, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM doc_words, lengths),
held AS (SELECT DISTINCT doc_id, text, item_id, s, item_shingles FROM (SELECT doc_id, text, array_to_string(w[i:i + m - 1], ' ') AS s FROM places) JOIN sized USING (s))
SELECT doc_id, item_id, count(*) AS shared, item_shingles, round(count(*) / item_shingles, 6) AS containment
FROM held GROUP BY doc_id, text, item_id, item_shingles HAVING count(*) >= 0.8 * item_shingles - 1e-9
"""

#: All pairs that share a shingle, their exact similarity, and the least id that links reach.
OP9_SQL = r"""
WITH RECURSIVE cut AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
sets AS (SELECT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM cut WHERE len(w) > 0) GROUP BY ALL),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE k * 1.8 >= 0.8 * (x.n + y.n) - 1e-6),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT doc_id, (SELECT min(b) FROM reach WHERE a = doc_id) AS class_id, (SELECT count(*) FROM links WHERE a = doc_id) AS n_links FROM documents
"""

#: All pairs of a label by brute force. Equal vectors have a cosine of 1, whatever the rounding.
OP4_SQL = r"""
WITH RECURSIVE usable AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
          WHERE a.x = b.x OR list_dot_product(a.x, b.x) / sqrt(list_dot_product(a.x, a.x) * list_dot_product(b.x, b.x)) >= 0.98),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, (SELECT min(b) FROM reach WHERE a = vec_id) AS component_id,
       vec_id = (SELECT min(b) FROM reach WHERE a = vec_id) AS kept FROM embeddings
"""

#: Every score of every item and document, by the same whole numbers.
OP11_SQL = r"""
WITH cut AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
asked AS (SELECT DISTINCT i, item_id, unnest(w) AS term FROM (SELECT row_number() OVER () AS i, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark)),
stats AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS l FROM cut WHERE len(w) > 0),
held AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM cut) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS weight FROM held, stats GROUP BY term),
impacts AS (SELECT r, doc_id, term, weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // l))) AS impact FROM held JOIN weights USING (term), stats),
scores AS (SELECT i, item_id, r, doc_id, sum(impact)::BIGINT AS score FROM asked JOIN impacts USING (term) GROUP BY ALL HAVING sum(impact) > 0)
SELECT item_id, (row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM scores
QUALIFY row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) <= 50
"""

#: The level of the targets by rounds, and each pass by running totals in the order of the same hash.
OP12_SQL = r"""
WITH RECURSIVE sizes AS (
  SELECT row_number() OVER () AS r, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 13))::BIGINT AS h FROM documents),
sources AS (SELECT source, size, 3 * size AS stop, ([5, 2, 1])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM (SELECT source, sum(size)::BIGINT AS size FROM sizes GROUP BY source)),
level(i, x) AS (
  SELECT 0, (SELECT sum(size)::BIGINT / sum(w)::BIGINT FROM sources)
  UNION ALL
  SELECT i + 1, ((SELECT sum(size) FROM sources) - coalesce((SELECT sum(stop) FROM sources WHERE stop < w * x), 0))::BIGINT / ((SELECT sum(w) FROM sources) - coalesce((SELECT sum(w) FROM sources WHERE stop < w * x), 0))::BIGINT FROM level WHERE i < 30),
planned AS (SELECT source, size AS source_size, CASE WHEN stop < w * x THEN stop::DOUBLE ELSE w * x END AS target FROM sources, (SELECT x FROM level ORDER BY i DESC LIMIT 1)),
p0 AS (SELECT r, doc_id, s.size, s.h, p.source, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS times, target - times * source_size AS open, false AS more
       FROM sizes s JOIN planned p ON s.source IS NOT DISTINCT FROM p.source),
PASSES
SELECT doc_id, size, source_size, target, (size * (times + more::INT))::BIGINT AS taken FROM p5
"""
#: One pass: of what is not taken and (but for the first pass) fits, the rows whose running total stays within what is open.
OP12_PASS = """
q{n} AS (SELECT r, CASE WHEN {fits} AND open > target * 0.001 AND NOT more THEN sum(CASE WHEN {fits} AND NOT more THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY h) END AS upto FROM p{n}),
p{next} AS (SELECT p{n}.* REPLACE (more OR coalesce(upto <= open, false) AS more, open - coalesce(sum(CASE WHEN upto <= open THEN size END) OVER (PARTITION BY source), 0) AS open) FROM p{n} JOIN q{n} USING (r))"""
OP12_SQL = OP12_SQL.replace("PASSES", ",".join(OP12_PASS.format(n=n, next=n + 1, fits="size <= open" if n else "true") for n in range(5)))

ORACLE_SQL = {"op11_ranked_search": OP11_SQL, "op12_source_mixing": OP12_SQL, "op4_embedding_near_dedup": OP4_SQL, "op9_ngram_jaccard_join": OP9_SQL, "op1_url_filters": OP1_SQL, "op7_benchmark_decontamination": OP7_SQL}
