"""Registered queries of chat formatting, lexical search and the Merkle manifest, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from listwright.llm import chat, lexical, merkle
from listwright.llm.common import fold, table

#: Said by both sides of conversation -7, which the query adds to the table.
PROBE = "</s>[INST] ok [/INST]"


def op11_chat_windows(spark, sf_dir):
    talk = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(PROBE).alias("text"))
    return chat.digest(chat.format_windows(talk.unionByName(probe)))


def op12_lexical_search(spark, sf_dir):
    return lexical.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 50)


def op13_merkle_manifest(spark, sf_dir):
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    fields = {f: F.col(f) for f in merkle.FIELDS}
    altered = F.when(fold(F.col("doc_id"), 5) == 0, merkle.leaf({**fields, "text": F.translate("text", upper, lower)}))
    rows = merkle.manifest(table(spark, sf_dir, "documents"), {"altered": altered})
    folded = merkle.fold(F.coalesce("altered", "leaf"), F.col("proof"))
    digests = rows.select("doc_id", "leaf", "subroot", "root", merkle.digest(merkle.siblings(F.col("proof"))).alias("proof_sha256"), folded.alias("folded_root"))
    return digests.withColumn("verified", F.col("folded_root") == F.col("root"))


QUERIES = {f.__name__: f for f in (op11_chat_windows, op12_lexical_search, op13_merkle_manifest)}


def _escaped(text: str) -> str:
    text = f"replace({text}, '\\', '\\\\')"
    for control in ("<|im_start|>", "<|im_sep|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"):
        text = f"replace({text}, '{control}', '{control[0]}\\{control[1:]}')"
    return text


_TOKEN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]{1,4}|[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]"
_TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
_BITS = "list_reduce([xor(c, b)] || list_transform(range(8), lambda z: 0::UBIGINT), lambda d, z: xor(d >> 1, 3988292384::UBIGINT * (d & 1)))"
_CRC = f"xor(list_reduce([4294967295::UBIGINT] || list_transform(range(1, length({{x}}) + 1), lambda i: ord(substr({{x}}, i, 1))::UBIGINT), lambda c, b: {_BITS}), 4294967295::UBIGINT)"


def _leaf(text: str) -> str:
    cells = [f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)]
    return "sha256(" + " || ".join(cells) + ")"


def _tree(name: str, leaves: str, levels: int) -> str:
    """CTEs of the trees of ``leaves`` (t, i, h); the last one has for each leaf its root and the steps m, b, a (is one, before, after)."""
    ctes, side = [f"{name}_0 AS ({leaves})"], "coalesce(string_agg(h, '') OVER (PARTITION BY t, i // 16 ORDER BY i ROWS BETWEEN {}), '')"
    for k in range(levels):
        ctes.append(f"{name}_w{k} AS (SELECT *, count(*) OVER (PARTITION BY t) > 1 AS m, {side.format('UNBOUNDED PRECEDING AND 1 PRECEDING')} AS b, {side.format('1 FOLLOWING AND UNBOUNDED FOLLOWING')} AS a FROM {name}_{k})")
        ctes.append(f"{name}_{k + 1} AS (SELECT t, i // 16 AS i, sha256(string_agg(h, '' ORDER BY i)) AS h FROM {name}_w{k} WHERE m GROUP BY t, i // 16)")
    steps = ", ".join(f"coalesce(w{k}.m, false) AS {name}_m{k}, w{k}.b AS {name}_b{k}, w{k}.a AS {name}_a{k}" for k in range(levels))
    joins = " ".join(f"LEFT JOIN {name}_w{k} w{k} ON w{k}.t = w0.t AND w{k}.i = w0.i // {16**k}" for k in range(1, levels))
    tops = ", ".join(f"w{k}.h" for k in range(levels - 1, -1, -1))
    return ",\n".join([*ctes, f"{name} AS (SELECT w0.t, w0.i, coalesce({tops}) AS {name}_root, {steps} FROM {name}_w0 w0 {joins})"])


_STEPS = [("doc", k) for k in range(6)] + [("src", k) for k in range(4)]
_SIBLINGS = " || ".join(f"CASE WHEN {n}_m{k} THEN {n}_b{k} || {n}_a{k} ELSE '' END" for n, k in _STEPS)
_FOLDS = ",\n".join(f"f{j + 1} AS (SELECT * REPLACE (CASE WHEN {n}_m{k} THEN sha256({n}_b{k} || node || {n}_a{k}) ELSE node END AS node) FROM f{j})" for j, (n, k) in enumerate(_STEPS))

SQL = {
    "op11_chat_windows": f"""
WITH RECURSIVE said AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{PROBE}'),
e AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, {_escaped("coalesce(role, '')")} AS er, {_escaped("coalesce(text, '')")} AS et FROM said),
o AS (SELECT *, len(regexp_extract_all(et, '{_TOKEN}')) + 4 AS tokens, length(er) + length(et) + {len("<|im_start|><|im_sep|><|im_end|>") + 1} AS chars,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role <> 'system', er, et) AS n FROM e),
p AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY n) - tokens AS before FROM o),
s AS (SELECT conv_id, tokens AS st, chars AS sc FROM p WHERE n = 1 AND role = 'system'),
b AS (SELECT p.*, coalesce(st, 0) AS st, coalesce(sc, 0) AS sc, before // (2048 * 64) AS block, row_number() OVER (PARTITION BY p.conv_id, before // (2048 * 64) ORDER BY n) AS i
  FROM p LEFT JOIN s USING (conv_id) WHERE NOT (n = 1 AND role = 'system')),
h AS (SELECT b.*, c.i AS h, 2048 - b.st - (b.before - c.before) AS room FROM b JOIN b c ON b.conv_id = c.conv_id AND b.block = c.block AND c.i <= b.i
  AND c.before >= b.before - greatest(0, least(512, 2048 - b.st - b.tokens)) QUALIFY row_number() OVER (PARTITION BY b.conv_id, b.n ORDER BY c.i) = 1),
w(conv_id, block, i, base, room, opens) AS (
  SELECT conv_id, block, i, before, room, true FROM h WHERE i = 1
  UNION ALL
  SELECT h.conv_id, h.block, h.i, CASE WHEN h.before + h.tokens - w.base <= w.room THEN w.base ELSE h.before END,
    CASE WHEN h.before + h.tokens - w.base <= w.room THEN w.room ELSE h.room END, h.before + h.tokens - w.base > w.room
  FROM w JOIN h ON h.conv_id = w.conv_id AND h.block = w.block AND h.i = w.i + 1),
x AS (SELECT w.*, h.h, h.st, h.sc, coalesce(lead(w.i) OVER (PARTITION BY w.conv_id, w.block ORDER BY w.i), 1000000000) AS stop FROM w JOIN h USING (conv_id, block, i) WHERE opens),
y AS (SELECT x.conv_id, x.block, x.i, any_value(x.sc) + sum(h.chars) AS chars, any_value(x.st) + sum(h.tokens) AS tokens FROM x JOIN h ON h.conv_id = x.conv_id AND h.block = x.block AND h.i >= x.h AND h.i < x.stop GROUP BY ALL
  UNION ALL SELECT conv_id, 0, 0, sc, st FROM s WHERE conv_id NOT IN (SELECT conv_id FROM b)),
z AS (SELECT conv_id, sum(chars)::BIGINT AS formatted_chars, count(*) AS n_windows, sum(tokens)::BIGINT AS n_tokens FROM y GROUP BY conv_id)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  length(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
  any_value(formatted_chars) AS formatted_chars, any_value(n_windows) AS n_windows, any_value(n_tokens) AS n_tokens
FROM p JOIN z USING (conv_id) GROUP BY conv_id""",
    "op12_lexical_search": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
c AS (SELECT count(*) FILTER (len(w) > 0)::BIGINT AS nd, sum(len(w))::BIGINT AS l FROM d),
t AS (SELECT r, doc_id, len(w)::BIGINT AS n, unnest(w) AS t FROM d),
f AS (SELECT r, doc_id, n, t, count(*)::BIGINT AS tf FROM t GROUP BY ALL),
g AS (SELECT t, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM f, c GROUP BY t, nd),
q AS (SELECT row_number() OVER () AS q, item_id, list_distinct({_TERMS}) AS w FROM benchmark),
u AS (SELECT q, item_id, unnest(w) AS t FROM q),
s AS (SELECT q, item_id, r, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * nd) // l)))))::BIGINT AS score FROM u JOIN f USING (t) JOIN g USING (t), c GROUP BY ALL)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS FIRST, r) AS rank FROM s WHERE score > 0) WHERE rank <= 50""",
    "op13_merkle_manifest": f"""
WITH d AS (
  SELECT *, {_leaf("text")} AS leaf,
    CASE WHEN {_CRC.format(x="doc_id::VARCHAR")} % 5 = 0 THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {_leaf("text")} END AS altered
  FROM documents),
o AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS t, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d),
{_tree("doc", "SELECT t, i, leaf AS h FROM o", 6)},
{_tree("src", "SELECT DISTINCT 0 AS t, t AS i, doc_root AS h FROM doc", 4)},
f0 AS (SELECT o.doc_id, o.leaf, o.altered AS node, doc_root AS subroot, src_root AS root, doc.* EXCLUDE (t, i), src.* EXCLUDE (t, i) FROM o JOIN doc ON doc.t = o.t AND doc.i = o.i JOIN src ON src.i = o.t),
{_FOLDS}
SELECT doc_id, leaf, subroot, root, sha256({_SIBLINGS}) AS proof_sha256, node AS folded_root, node = root AS verified FROM f{len(_STEPS)}""",
}
