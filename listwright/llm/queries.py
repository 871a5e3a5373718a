"""The registered queries of the operators, with oracle SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from listwright.llm import cover_tree, jaccard, language_id, license_scan, mixing, packing, pii, quality, queries_text, topk, url_filter
from listwright.llm.common import fold, table


def op1_url_filters(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages")).drop("weight")


def op2_quality(spark, sf_dir):
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 5) == 0)


def op3_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    chain = language_id.learn(docs, fold(F.col("doc_id"), 3) != 1)
    held_out = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False))
    return language_id.predict(docs, chain).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op4_topk(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top(vectors, vectors.where("vec_id % 50 = 0"), 5)


def op5_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), with_ids=False).drop("ids")


def op6_pii(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return pii.find(docs, pii.learn(docs))


def op7_cover_tree(spark, sf_dir):
    return cover_tree.link(table(spark, sf_dir, "embeddings"))


def op8_mixing(spark, sf_dir):
    return mixing.assign(table(spark, sf_dir, "documents")).drop("source")


def op9_jaccard_join(spark, sf_dir):
    return jaccard.join(table(spark, sf_dir, "documents"))


def op10_license_scans(spark, sf_dir):
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("blocks")


QUERIES = {f.__name__: f for f in (op1_url_filters, op2_quality, op3_language_id, op4_topk, op5_packing, op6_pii, op7_cover_tree, op8_mixing, op9_jaccard_join, op10_license_scans)} | queries_text.QUERIES

_HITS = "len(list_filter([{terms}], lambda t: regexp_matches(u, '(^|[^a-z0-9])' || t || '([^a-z0-9]|$)')))"
_RULES = ", ".join(f"('{rule}', '{verdict}', '{rule.partition('/')[0]}', '/{rule.partition('/')[2]}')" for rule, verdict in url_filter.RULES)

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_PHRASES = ", ".join(f"({p.split()}, '{label}')" for p, label in license_scan.PHRASES.items())
_HEADERS = [(label, sorted(b" ".join(t).decode() for t in license_scan.tokens_of(text)), list(telling)) for label, text, telling in license_scan.NOTICES]
_NOTICES = ", ".join(f"({tokens}, '{label}', {license_scan.need(len(tokens), license_scan.CONTAINMENT)}, {telling})" for label, tokens, telling in _HEADERS)
_BLOCK, _STEP = license_scan.blocking()

SQL = {
    "op1_url_filters": f"""
WITH parts AS (
  SELECT page_id, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS u,
    CASE WHEN contains(url, '://') THEN translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
rules(rule, verdict, h, p) AS (VALUES {_RULES}),
judged AS (
  SELECT page_id, host, path, u,
    (SELECT max_by(struct_pack(r := rule, v := verdict), length(rule)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS best,
    {_HITS.format(terms=", ".join(f"'{t}'" for t in url_filter.STRICT))}::INT AS n_strict,
    {_HITS.format(terms=", ".join(f"'{t}'" for t in url_filter.SOFT))}::INT AS n_soft
  FROM parts)
SELECT page_id, host, path, best.r AS rule,
  coalesce(best.v, CASE WHEN n_strict > 0 OR n_soft >= {url_filter.MIN_SOFT} THEN 'block' ELSE 'allow' END) AS verdict, n_strict, n_soft
FROM judged""",
    "op4_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op7_cover_tree": f"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
e AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= {cover_tree.COSINE}),
reach(x, y) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.x, e.y FROM reach JOIN e ON reach.y = e.x),
root AS (SELECT x, min(y) AS c FROM reach GROUP BY x),
n AS (SELECT x, count(*) AS n FROM e GROUP BY x)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, c AS component_id, vec_id = c AS kept
FROM embeddings LEFT JOIN n ON n.x = vec_id LEFT JOIN root ON root.x = vec_id""",
    "op8_mixing": f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size, coalesce(md5(doc_id::VARCHAR), '') AS k
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS class
  FROM d GROUP BY source),
w AS (SELECT *, (CASE class WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::DOUBLE AS weight, ({mixing.REPEATS} * source_size)::DOUBLE AS cap FROM s),
l AS (
  SELECT *, ({mixing.BUDGET}::DOUBLE * sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w),
t AS (SELECT source, source_size, class, least(cap, weight * max(level) OVER ()) AS target FROM l),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.class, round(t.target)::BIGINT AS goal,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, greatest(0, least(size, goal - start)) AS first, greatest(0, least(size, goal - start - source_size)) AS second, least(1.0::DOUBLE, start / target) AS share,
  (CASE class WHEN 0 THEN 1.5 WHEN 1 THEN 1.0 ELSE 0.5 END)::DOUBLE AS a, (CASE class WHEN 0 THEN 0.5 WHEN 1 THEN 1.0 ELSE 1.5 END)::DOUBLE AS b FROM p)
SELECT doc_id, size, source_size, target, (first + second)::BIGINT AS taken,
  CASE WHEN first > 0 THEN 2 * (share * (a + b) / 2) / (a + sqrt(greatest(0, a * a + 2 * (b - a) * (share * (a + b) / 2)))) END AS position
FROM q""",
    "op9_jaccard_join": """
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
s AS (
  SELECT r, doc_id, list_distinct(list_transform(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1), lambda i: hash(array_to_string(w[i : i + 4], ' ')))) AS g, least(len(w), 5) AS k
  FROM d),
t AS (SELECT r, unnest(g) AS g, k, len(g) AS n FROM s),
p AS (SELECT a.r AS x, b.r AS y, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS c FROM t a JOIN t b ON a.g = b.g AND a.k = b.k AND a.r < b.r GROUP BY a.r, b.r),
l AS (SELECT x, y FROM p WHERE 100 * c >= 75 * (n + m - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l UNION ALL SELECT r, r FROM d),
reach(x, y) AS (SELECT r, r FROM d UNION SELECT reach.x, e.y FROM reach JOIN e ON reach.y = e.x),
root AS (SELECT x, min(doc_id) AS c FROM reach JOIN d ON d.r = y GROUP BY x)
SELECT doc_id, len(g)::BIGINT AS n_shingles, c AS component_id FROM s JOIN root ON root.x = s.r""",
    "op10_license_scans": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
phrases(p, label) AS (VALUES {_PHRASES}),
notices(t, label, need, telling) AS (VALUES {_NOTICES}),
places AS (SELECT r, label, unnest(list_filter(range(len(w)), lambda i: w[i + 1 : i + len(p)] = p)) AS i FROM d, phrases WHERE list_has_all(w, p)),
base AS (SELECT r, count(*) AS n, min(i) AS a, max(i) AS b, string_agg(DISTINCT label, ',' ORDER BY label) AS l FROM places GROUP BY r),
blocks AS (
  SELECT r, list_distinct(list_transform(range(1, len(b)), lambda i: b[i] || ' ' || b[i + 1])) AS b
  FROM (
    SELECT r, w[k + 1 : k + {_BLOCK}] AS b
    FROM (SELECT r, w, unnest(range(0, greatest(len(w) - {_BLOCK} + {_STEP}, 1), {_STEP})) AS k FROM d))),
matches AS (
  SELECT r, label, len(list_intersect(b, t)) AS shared, len(t) AS size, need
  FROM blocks, notices WHERE list_has_all(b, telling)),
found AS (SELECT r, label, max(shared::DOUBLE / size) AS c FROM matches WHERE shared >= need GROUP BY r, label),
labels AS (SELECT r, label FROM places UNION SELECT r, label FROM found),
joined AS (SELECT r, string_agg(label, ',' ORDER BY label) AS l FROM labels GROUP BY r),
best AS (SELECT r, max(c) AS c FROM found GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, a AS first_word, b AS last_word,
  coalesce(base.l, '') AS base_labels, coalesce(joined.l, '') AS labels, CASE WHEN n > 0 THEN 1.0 ELSE coalesce(c, 0.0) END::DOUBLE AS score
FROM d LEFT JOIN base USING (r) LEFT JOIN joined USING (r) LEFT JOIN best USING (r)""",
} | queries_text.SQL
