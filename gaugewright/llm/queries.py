"""The queries of the operators over their whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import additive_quant, chat, decontamination, lm_trie, packing, pieces, prefix_trie, quality_rules, secret_scan, simhash, toxicity, variants, wrappers
from .common import fold


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.apply_policy(quality_rules.ledger(_table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits")


def quality_rule_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the default policy fails, alone and together, over the whole ledger."""
    return quality_rules.ablation(quality_rules.ledger(_table(spark, sf_dir, "documents")))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", (fold() == 0).alias("held_out"), "score", "predicted")


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one that holds the template's own control strings."""
    own = r"\### Assistant: </turn> ok"
    control = spark.createDataFrame([(-7, 0, "user", own), (-7, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(rows.unionByName(control))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan.find(docs, secret_scan.learn(docs))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", secret_scan.span_text().alias("spans"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(_table(spark, sf_dir, "documents"), with_ids=False)


def op7_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return additive_quant.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extracted(_table(spark, sf_dir, "pages"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_trie.scores(_table(spark, sf_dir, "documents"), fold() != 1)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.grouped(_table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    ids = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), ids.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(_table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [
        op1_quality_rules, op2_toxicity, op3_chat_formatting, op4_simhash, op5_secret_scan, op6_sentencepiece, op7_additive_quantisation,
        op8_packing, op9_html_extraction, op10_lm_scoring, op11_spelling_variants, op12_decontamination, op13_prefix_trie, quality_rule_ablation,
    ]
    return {f.__name__: f for f in named}


_RULES_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS k FROM p),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM c WHERE n > 1) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws) AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
      length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
      coalesce(l.n_lines, 0) AS n_lines, coalesce(l.n_dup, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
      length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n_letters, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper,
      length(regexp_replace(text, '[^0-9]', '', 'g')) AS n_digits
      FROM w LEFT JOIN l ON l.doc_id = w.doc_id LEFT JOIN r ON r.doc_id = w.doc_id),
b AS (SELECT *, {bits} AS fail_bits FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       (fail_bits & 3) <> 0 AS base_failed, (fail_bits & {mask}) = 0 AS kept, CAST(fail_bits AS BIGINT) AS fail_bits
FROM b
"""


_CHAT_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
s AS (SELECT *, 4 + length(regexp_replace(role, '(\\|###|</turn>|:)', '\\\1', 'g')) + 2
                + length(regexp_replace(text, '(\\|###|</turn>)', '\\\1', 'g')) + 8 AS size FROM c),
e AS (SELECT *, sum(size) OVER w AS stream_end, lead(1) OVER w IS NULL AS is_last FROM s
      WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(stream_end) FILTER (role = 'assistant' OR is_last) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

_NEAREST_SQL = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) = (SELECT len(embedding) FROM embeddings GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)),
q AS (SELECT vec_id AS query_id, v AS q FROM v WHERE vec_id % 50 = 0),
p AS (SELECT query_id, vec_id, list_inner_product(v, q) / (sqrt(list_inner_product(v, v)) * sqrt(list_inner_product(q, q))) AS score
      FROM q, v WHERE query_id <> vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""

#: For pages whose article is one <article> element without furniture, as in the tables at hand.
_PAGES_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|$)', 1) AS t FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(t, '</?(p|h1|br|li|ul|ol|div)[^>]*>', ' ', 'g'), '<[^>]*>', '', 'g') AS t FROM a),
d AS (SELECT page_id, url, replace(replace(replace(replace(replace(regexp_replace(t, '&amp([^;]|$)', '&amp;\1', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;', '&') AS t FROM b),
f AS (SELECT page_id, url, trim(regexp_replace(t, '\s+', ' ', 'g')) AS text FROM d)
SELECT page_id, url, text, length(text) AS n_chars FROM f
"""

#: The table of crc32 by bytes, from its polynomial.
_CRC_SQL = "SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t"

_VARIANTS_SQL = r"""
WITH t AS ({crc}),
r AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{00C0}}-\x{{00FF}}]+')) AS r FROM documents),
p AS (SELECT d, r, count(*) AS n FROM r WHERE length(r) >= 6 GROUP BY d, r),
b AS (SELECT r, n, flatten(list_transform(string_split(d || ':' || r, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)] END)) AS bytes FROM p),
h AS (SELECT r, n, xor(list_reduce(list_concat([4294967295], bytes), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM b, t),
s AS (SELECT CASE WHEN h % 199 = 0 THEN r[:CAST(h % length(r) AS BIGINT)] || r[CAST(h % length(r) AS BIGINT) + 2:] ELSE r END AS word, n FROM h),
v AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM s WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
g AS MATERIALIZED (SELECT word, n, i, word[:i - 1] AS a, word[i + 1:] AS z FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
e AS (SELECT x.word, y.word AS near, y.n AS near_n FROM g x JOIN g y ON x.i = y.i AND x.a = y.a AND x.z = y.z AND x.word <> y.word
      UNION SELECT g.word, v.word, v.n FROM g JOIN v ON v.word = g.a || g.z
      UNION SELECT v.word, g.word, g.n FROM g JOIN v ON v.word = g.a || g.z),
f AS (SELECT word, count(*) AS n_near, max(near_n) AS best, arg_min(near, (-near_n, near)) AS form FROM e GROUP BY word),
w AS MATERIALIZED (SELECT v.word, v.n, coalesce(f.n_near, 0) AS n_near, CASE WHEN f.best >= 5 * v.n THEN f.form END AS form, CASE WHEN f.best >= 5 * v.n THEN f.best END AS form_n FROM v LEFT JOIN f ON f.word = v.word),
c AS (WITH RECURSIVE c AS (SELECT word, word AS at FROM w UNION ALL SELECT c.word, w.form FROM c JOIN w ON w.word = c.at WHERE w.form IS NOT NULL) SELECT c.word, c.at AS root FROM c JOIN w ON w.word = c.at WHERE w.form IS NULL)
SELECT w.word, w.form, c.root, w.n, w.n_near, w.form_n FROM w JOIN c ON c.word = w.word
"""

_LEAKS_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS k, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
i AS (SELECT item, least(len(w), 10) AS size, unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2), lambda p: array_to_string(w[p:p + least(len(w), 10) - 1], ' '))) AS win FROM b WHERE len(w) > 0),
s AS (SELECT DISTINCT size FROM i),
p AS (SELECT k, size, unnest(range(1, len(w) - size + 2)) AS p FROM d, s),
o AS (SELECT p.k, p.p, p.size, array_to_string(d.w[p.p:p.p + p.size - 1], ' ') AS win FROM p JOIN d ON d.k = p.k),
m AS (SELECT DISTINCT o.k, o.p, o.size, i.item FROM o JOIN i ON i.win = o.win AND i.size = o.size),
h AS (SELECT k, count(DISTINCT q) AS n_hit FROM (SELECT k, unnest(range(p, p + size)) AS q FROM m) GROUP BY k),
j AS (SELECT k, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS sha FROM (SELECT DISTINCT k, item FROM m) GROUP BY k)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(j.n_items, 0) AS n_items, coalesce(j.sha, sha256('')) AS items_sha256, h.n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h ON h.k = d.k LEFT JOIN j ON j.k = d.k
"""

_TRIE_SQL = r"""
WITH t AS ({crc}),
c AS (SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS own FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, own, xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(unicode(x) AS BIGINT))), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) % 6 AS h FROM c, t),
r AS (SELECT h.conv_id, list_concat(CASE WHEN b.own IS NULL THEN [] ELSE b.own[1:h.h] END, h.own[h.h + 1:]) AS p FROM h LEFT JOIN c b ON b.conv_id = h.conv_id - h.conv_id % 100),
n AS (SELECT conv_id, len(p) AS size, d AS depth, p[1:d] AS path FROM (SELECT conv_id, p, unnest(range(0, len(p) + 1)) AS d FROM r)),
v AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (size = depth), '')) AS ends_sha256 FROM n GROUP BY path, depth),
k AS (SELECT path[1:depth - 1] AS up, depth - 1 AS d, count(*) AS n_children FROM v WHERE depth > 0 GROUP BY 1, 2),
w AS (SELECT v.*, coalesce(k.n_children, 0) AS n_children, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * length(path[depth].t) END AS own FROM v LEFT JOIN k ON k.d = v.depth AND k.up = v.path),
a AS (SELECT unnest(range(0, depth + 1)) AS d, path, n_children, own FROM w),
s AS (SELECT d, path[1:d] AS path, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum(own) AS BIGINT) AS saved_tokens FROM a GROUP BY 1, 2)
SELECT w.conv_id, CAST(w.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, w.n_convs, w.n_children, s.n_leaves, s.saved_tokens, w.ends_sha256
FROM w JOIN s ON s.d = w.depth AND s.path = w.path LEFT JOIN v u ON u.depth = w.depth - 1 AND u.path = w.path[1:w.depth - 1]
"""

_ABLATION_SQL = """
WITH f AS ({rules}), r(rule, bit) AS (VALUES {values})
SELECT rule, CAST(bit AS BIGINT) AS bit, count(*) FILTER ((fail_bits & bit) <> 0) AS n_failed, count(*) FILTER ((fail_bits & {mask}) = bit) AS n_only,
       count(*) FILTER ((fail_bits & {mask}) = 0) AS n_kept, count(*) FILTER ((fail_bits & {mask} & ~bit) = 0) AS n_kept_without, count(*) AS n_rows
FROM f, r GROUP BY rule, bit
"""


def oracle_sql() -> dict[str, str]:
    bits = " + ".join(f"CASE WHEN {r.fails} THEN {1 << i} ELSE 0 END" for i, r in enumerate(quality_rules.RULES))
    policy = quality_rules.DEFAULT
    rules = _RULES_SQL.format(bits=bits, mask=policy.mask)
    values = ", ".join(f"('{r}', {quality_rules.BIT[r]})" for r in policy.rules)
    return {
        "op1_quality_rules": rules,
        "quality_rule_ablation": _ABLATION_SQL.format(rules=rules, values=values, mask=policy.mask),
        "op3_chat_formatting": _CHAT_SQL,
        "op7_additive_quantisation": _NEAREST_SQL,
        "op9_html_extraction": _PAGES_SQL,
        "op11_spelling_variants": _VARIANTS_SQL.format(crc=_CRC_SQL),
        "op12_decontamination": _LEAKS_SQL,
        "op13_prefix_trie": _TRIE_SQL.format(crc=_CRC_SQL),
    }
