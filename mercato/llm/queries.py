"""The registered queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.llm import chat, digest_index, jaccard, lbl, linecrf, mixing, packing, periodic, permindex, secrets, sharding, toxicity, whitening
from mercato.llm.common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", both), (-7, 1, "assistant", both)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(chat.format_chats(rows), ordered=True)  # as the formatter left it


def op4_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permindex.nearest(table(spark, sf_dir, "embeddings"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, pieces = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixing.taken_words(placed, pieces).select("doc_id", "size", "source_size", "target", "taken", "first_shard")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.span_digests(secrets.scan_secrets(table(spark, sf_dir, "documents")))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_index.exact_dedup(table(spark, sf_dir, "documents"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lbl.score_documents(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.balanced_shards(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.periodic_runs(table(spark, sf_dir, "documents"), tails=True)


def op12_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linecrf.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    white = whitening.whitened_embeddings(table(spark, sf_dir, "embeddings"))
    return white.withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_packing": op2_packing,
    "op3_chat_formatting": op3_chat_formatting,
    "op4_permutation_index": op4_permutation_index,
    "op5_mixing": op5_mixing,
    "op6_secret_scan": op6_secret_scan,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_sharding": op10_sharding,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_quality_crf": op12_quality_crf,
    "op13_whitening": op13_whitening,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP8_SQL = f"""
WITH d AS (SELECT doc_id, sha256({_LOWER}) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""

# length after escaping: backslashes twice, one more for each # after two others and for each end mark
_ESCAPED = r"""(length(x) + length(x) - length(replace(x, '\', '')) + len(regexp_extract_all(x, '</(turn|role)>'))
  + coalesce(list_sum(list_transform(regexp_extract_all(x, '#{3,}'), lambda r: length(r) - 2)), 0))"""


def _escaped(column: str) -> str:
    return _ESCAPED.replace("x,", f"{column},").replace("(x)", f"({column})")


OP3_SQL = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(CASE role WHEN 'system' THEN 12 WHEN 'user' THEN 10 WHEN 'assistant' THEN 15
    ELSE 10 + {_escaped('role')} + 7 END + {_escaped('text')} + 8) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""


def _op6_spans(kind: str, ix: int, pattern: str, group: int, least: int) -> str:
    quoted = pattern.replace("'", "''")
    return f"""
{kind}_m AS (SELECT uid, list_transform(regexp_split_to_array(t, '{quoted}'), lambda x: length(x)) AS gap,
    regexp_extract_all(t, '{quoted}', 0) AS found, regexp_extract_all(t, '{quoted}', {group}) AS judged
  FROM d WHERE regexp_matches(t, '{quoted}')),
{kind}_r AS (SELECT uid, unnest(range(1, len(found) + 1)) AS nth, gap, found, judged FROM {kind}_m),
{kind}_s AS (SELECT uid, nth, found[nth] AS text, length(judged[nth]) AS judged,
    sum(gap[nth] + length(found[nth])) OVER (PARTITION BY uid ORDER BY nth) AS fin FROM {kind}_r),
{kind}_f AS (SELECT uid, nth, text, fin - length(text) AS start, fin, {ix} AS kind_ix FROM {kind}_s WHERE judged >= {least})"""


_W = secrets.WINDOW
# of a window's text
_BITS = "CASE " + " ".join(
    f"WHEN regexp_matches(w, '{whole}') THEN CASE WHEN " + " AND ".join(f"regexp_matches(w, '{p}')" for p in parts) + f" THEN {bits} END"
    for _, whole, parts, bits in secrets.CLASSES
) + " END"
_HARMLESS = " OR ".join(f"regexp_matches(regexp_replace(stretch, '{secrets.LEADING}', ''), '{p}')" for p in secrets.ALLOW)
_KINDS = ", ".join(f"'{k}'" for k in [kind for kind, *_ in secrets.BASE] + [secrets.ENTROPY])
OP6_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, coalesce(text, '') AS t FROM documents),
{",".join(_op6_spans(kind, ix, pattern, group, least) for ix, (kind, pattern, group, least) in enumerate(secrets.BASE))},
{_op6_spans("entropy", len(secrets.BASE), secrets.CANDIDATE, 0, 0)},
e1 AS (SELECT uid, nth, start, text, unnest(range(0, length(text) - {_W - 1})) AS i FROM entropy_f),
e2 AS (SELECT *, substr(text, CAST(i + 1 AS BIGINT), {_W}) AS w FROM e1),
e3 AS (SELECT uid, nth, start, text, i FROM e2 WHERE list_entropy(string_split(w, '')) >= {_BITS}),
e4 AS (SELECT *, sum(CASE WHEN i - before <= {_W} THEN 0 ELSE 1 END) OVER (PARTITION BY uid, nth ORDER BY i) AS island
  FROM (SELECT *, lag(i) OVER (PARTITION BY uid, nth ORDER BY i) AS before FROM e3) x),
e5 AS (SELECT uid, start + min(i) AS start, start + max(i) + {_W} AS fin, substr(any_value(text), CAST(min(i) + 1 AS BIGINT), CAST(max(i) - min(i) + {_W} AS BIGINT)) AS stretch
  FROM e4 GROUP BY uid, nth, start, island),
s AS (SELECT uid, start, fin, kind_ix FROM assign_f UNION ALL SELECT uid, start, fin, kind_ix FROM access_f
  UNION ALL SELECT uid, start, fin, kind_ix FROM hex_f
  UNION ALL SELECT uid, start, fin, {len(secrets.BASE)} FROM e5 WHERE NOT ({_HARMLESS})),
n AS (SELECT uid, kind_ix, start, fin, ([{_KINDS}])[kind_ix + 1] || ':' || start || ':' || fin AS said FROM s),
g AS (SELECT uid, count(*) FILTER (kind_ix = 0) AS n_assign, count(*) FILTER (kind_ix = 1) AS n_access,
  count(*) FILTER (kind_ix = 2) AS n_hex, string_agg(said, ',' ORDER BY start, kind_ix, fin) AS spans,
  string_agg(said, ',' ORDER BY start, kind_ix, fin) FILTER (kind_ix < {len(secrets.BASE)}) AS base FROM n GROUP BY uid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (uid)
"""

OP7_SQL = rf"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS uid, doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT uid, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
  ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingle FROM w),
n AS (SELECT uid, count(*) AS n FROM s GROUP BY uid),
p AS (SELECT a.uid AS x, b.uid AS y, count(*) AS inter FROM s a JOIN s b ON a.shingle = b.shingle AND a.uid <> b.uid GROUP BY a.uid, b.uid),
l AS (SELECT x, y FROM p JOIN n a ON a.uid = x JOIN n b ON b.uid = y WHERE 100 * inter >= 80 * (a.n + b.n - inter)),
r(x, y) AS (SELECT uid, uid FROM w UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT a.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(b.doc_id) AS component_id
FROM r JOIN w a ON a.uid = r.x JOIN w b ON b.uid = r.y LEFT JOIN n ON n.uid = r.x GROUP BY a.uid, a.doc_id
"""

# crc32 of the id bit by bit; pairs of equal words q apart, in stretches of consecutive ones, are the runs of period q
OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
  coalesce(xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''),
    lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295), -1) AS h FROM documents),
e AS (SELECT uid, doc_id, w, len(w) AS n, h, h // 10 AS g, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) ELSE 0 END AS a FROM d),
f AS (SELECT uid, doc_id, n, CASE WHEN h >= 0 AND h % 10 = 0 AND n > 0
  THEN list_transform(range(0, n), lambda i: w[1 + CASE WHEN i >= a THEN a + (i - a) % (1 + (n - a) // (3 + g % 8)) ELSE i END]) ELSE w END AS w FROM e),
p AS (SELECT uid, n, unnest(w) AS word, unnest(range(0, n)) AS i FROM f WHERE n >= 6),
q AS (SELECT a.uid, b.i - a.i AS q, a.i FROM p a JOIN p b ON a.uid = b.uid AND a.word = b.word AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
s AS (SELECT uid, q, i, i - row_number() OVER (PARTITION BY uid, q ORDER BY i) AS island FROM q),
c AS (SELECT uid, q AS period, min(i) AS start, count(*) + q AS length FROM s GROUP BY uid, q, island HAVING count(*) >= 3 * q AND count(*) + q >= 6),
r AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.uid = c.uid AND b.period < c.period AND c.period % b.period = 0
  AND b.start <= c.start AND b.start + b.length >= c.start + c.length)),
l AS (SELECT uid, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS said FROM r GROUP BY uid),
b AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY length / period DESC, start, period) AS nth FROM r),
g AS (SELECT DISTINCT uid, unnest(range(start + period, start + length)) AS i FROM r),
k AS (SELECT p.uid, string_agg(word, ' ' ORDER BY p.i) AS kept FROM p ANTI JOIN g ON g.uid = p.uid AND g.i = p.i GROUP BY p.uid)
SELECT f.doc_id, coalesce(n_runs, 0) AS n_runs, b.start, b.length, b.period, 1000 * b.length // b.period AS exponent_milli,
  sha256(coalesce(said, '')) AS runs_sha256, sha256(CASE WHEN f.n < 6 THEN array_to_string(w, ' ') ELSE kept END) AS collapsed_sha256
FROM f LEFT JOIN l USING (uid) LEFT JOIN k USING (uid) LEFT JOIN b ON b.uid = f.uid AND b.nth = 1
"""

ORACLE_SQL = {"op3_chat_formatting": OP3_SQL, "op6_secret_scan": OP6_SQL, "op7_jaccard_join": OP7_SQL, "op8_exact_dedup": OP8_SQL, "op11_periodic_runs": OP11_SQL}
