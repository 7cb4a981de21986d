"""The queries of this subpackage: thin digests of the operators over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id, mixing, ngram_join, packing, quality, secret_scan, syncmers, token_files, url_reputation, warc

#: Limits of op2's second packing: documents of a sequence, and its attention cost (a longer piece stands alone).
BOUNDED = {"max_docs": 8, "max_attention": 2048**2}

#: Verdict, host and path of the URL rules.
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_syncmers(spark, sf_dir):
    return syncmers.compare_with_edits(_read(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark, sf_dir):
    # the fewest sequences leave the other two capacities slack, so a second packing of the same pieces lets them bind
    return packing.pack_documents(_read(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), end_id=1, max_tokens=4096, bounded=BOUNDED)


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled outcomes of pages: a url's path ends in the number of its document; good is of quality and not toxic."""
    number = F.regexp_extract("url", r"://[^/?#]*/[^/?#]*/([0-9]{1,18})", 1)
    numbered = pages.select("url", F.nullif(number, F.lit("")).cast("long").alias("doc_id")).filter("doc_id is not null")
    return numbered.join(labels.filter("quality is not null and toxic is not null").select("doc_id", ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int").alias("good")), "doc_id").select("url", "good")


def op3_url_reputation(spark, sf_dir):
    pages = _read(spark, sf_dir, "pages")
    return url_reputation.judge(pages, page_outcomes(pages, _read(spark, sf_dir, "labels")), URL_RULES)


def language_fold():
    """0, 1 or 2; documents of fold 1 are held out, and null ids never teach."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3))


def op4_language_field(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    field = language_id.fit(docs, language_fold() != 1)
    return language_id.predict(docs, field).select("doc_id", F.coalesce(language_fold() == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op5_warc_members(spark, sf_dir):
    return warc.archive(_read(spark, sf_dir, "pages"), least=0)


def op6_weak_supervision(spark, sf_dir):
    kept = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return quality.judge(_read(spark, sf_dir, "documents")).select(*kept)


def op7_source_mixing(spark, sf_dir):
    return mixing.mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "source_blocks", (F.col("size") * F.size("shards")).alias("taken"))


def op8_token_files(spark, sf_dir):
    return token_files.token_files(_read(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), end_id=0, vocabulary=50_257)


def op9_secret_scan(spark, sf_dir):
    rows = secret_scan.scan(_read(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{name}") for k, name in enumerate(secret_scan.KINDS[:3])]
    return rows.select("doc_id", *counts, F.sha2(secret_scan.joined(F.col("base")), 256).alias("base_sha256"), secret_scan.joined(F.col("spans")).alias("spans"))


def op10_ngram_join(spark, sf_dir):
    return ngram_join.join_components(_read(spark, sf_dir, "documents"), n=3, percent=90)


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}


_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

OP3_SQL = r"""
WITH parsed AS (
  SELECT page_id, url,
    CASE WHEN strpos(url, '://') > 0 THEN translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
rules(v, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
ruled AS (
  SELECT page_id, any_value(url) AS url, any_value(host) AS host, any_value(path) AS path, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS by_rule
  FROM parsed LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id),
outcomes AS (
  SELECT host, (quality = 1 AND toxic = 0)::INT AS good FROM parsed JOIN labels ON doc_id = TRY_CAST(regexp_extract(url, '://[^/?#]*/[^/?#]*/([0-9]{1,18})', 1) AS BIGINT)
  WHERE quality IS NOT NULL AND toxic IS NOT NULL),
hosts AS (
  SELECT host, count(good)::DOUBLE AS n, coalesce(sum(good), 0)::DOUBLE AS k,
    CASE WHEN regexp_matches(host, '(?:^|\.)(?:ac|co|com|edu|gov|net|org)\.[^.]{2}$') THEN regexp_extract(host, '(?:^|\.)((?:ac|co|com|edu|gov|net|org)\.[^.]{2})$', 1) ELSE regexp_extract(host, '([^.]*)$', 1) END AS suffix
  FROM (SELECT host, NULL::INT AS good FROM parsed UNION ALL SELECT host, good FROM outcomes) GROUP BY host),
named AS (
  SELECT *, regexp_extract(substr(host, 1, greatest(length(host) - length(suffix) - 1, 0)), '([^.]*)$', 1) AS label FROM hosts),
h AS (SELECT host, n, k, suffix, CASE WHEN label <> '' THEN label || '.' || suffix ELSE host END AS domain FROM named),
d AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM d GROUP BY ALL),
sj AS (SELECT s.*, (SELECT (sum(k) + 0.5) / (sum(n) + 1) FROM s) AS m FROM s),
sf AS (SELECT least(greatest(coalesce((sum((k - n * m) ** 2) - sum(m * (1 - m) * n)) / nullif(sum(m * (1 - m) * n * (n - 1)), 0), 0.001), 0.001), 0.9) AS rho FROM sj),
sp AS (SELECT suffix, ((1 - rho) / rho * m + k) / ((1 - rho) / rho + n) AS m FROM sj, sf),
dj AS (SELECT d.*, m FROM d JOIN sp USING (suffix)),
df AS (SELECT least(greatest(coalesce((sum((k - n * m) ** 2) - sum(m * (1 - m) * n)) / nullif(sum(m * (1 - m) * n * (n - 1)), 0), 0.001), 0.001), 0.9) AS rho FROM dj),
dp AS (SELECT domain, suffix, ((1 - rho) / rho * m + k) / ((1 - rho) / rho + n) AS m FROM dj, df),
hj AS (SELECT h.*, m FROM h JOIN dp USING (domain, suffix)),
hf AS (SELECT least(greatest(coalesce((sum((k - n * m) ** 2) - sum(m * (1 - m) * n)) / nullif(sum(m * (1 - m) * n * (n - 1)), 0), 0.001), 0.001), 0.9) AS rho FROM hj),
hp AS (SELECT host, ((1 - rho) / rho * m + k) / ((1 - rho) / rho + n) AS m, (1 - rho) / rho + n AS total FROM hj, hf)
SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN m + 1.645 * sqrt(m * (1 - m) / (total + 1)) < 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled LEFT JOIN hp USING (host)
"""

MIX_CTE = rf"""
d AS (SELECT *, {_WORDS}::BIGINT AS size, substr(md5('mix/' || coalesce(doc_id::VARCHAR, '')), 1, 16) AS key FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS n, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM d GROUP BY source),
ratios AS (
  SELECT *, coalesce(sum(2 * n) OVER o - 2 * n, 0) AS caps, sum(w) OVER () - sum(w) OVER o + w AS ws, sum(n) OVER () AS total FROM sources
  WINDOW o AS (ORDER BY 12 * n / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
capped AS (SELECT *, 2 * (2 * n) * ws <= (3 * total - 2 * caps) * w AS sat FROM ratios),
level AS (SELECT 3 * any_value(total) - 2 * coalesce(sum(2 * n) FILTER (sat), 0) AS num, 2 * sum(w) FILTER (NOT sat) AS den FROM capped),
aims AS (SELECT source, n AS source_size, CASE WHEN sat THEN (2 * n)::DOUBLE ELSE (num * w)::DOUBLE / den::DOUBLE END AS target FROM capped, level),
parts AS (SELECT *, CASE WHEN source_size = 0 THEN 2 ELSE floor(target / source_size) END::BIGINT AS passes FROM aims),
ranked AS (
  SELECT d.*, source_size, target, passes, target - passes * source_size AS rest,
    sum(size) OVER (PARTITION BY d.source ORDER BY key RANGE UNBOUNDED PRECEDING) AS upto, sum(size) OVER (PARTITION BY d.source, key) AS same
  FROM d JOIN parts ON d.source IS NOT DISTINCT FROM parts.source),
blocks AS (SELECT source, substr(key, 1, 3) AS block, sum(size) AS words, sum(sum(size)) OVER (PARTITION BY source ORDER BY substr(key, 1, 3)) AS upto FROM d GROUP BY source, substr(key, 1, 3)),
quotas AS (SELECT p.source, any_value(passes) * 4096 + coalesce(max(CASE WHEN rest > 0 AND upto - words < rest AND upto >= rest THEN ('0x' || block)::INT + 1 END), 0) AS source_blocks
  FROM (SELECT *, target - passes * source_size AS rest FROM parts) p LEFT JOIN blocks b ON b.source IS NOT DISTINCT FROM p.source GROUP BY p.source),
mixed AS (SELECT *, passes + CASE WHEN rest > 0 AND 2 * upto - same <= 2 * rest THEN 1 ELSE 0 END AS times FROM ranked)
"""

OP7_SQL = f"WITH {MIX_CTE} SELECT doc_id, size, source_size, target, source_blocks::BIGINT AS source_blocks, (size * times)::BIGINT AS taken FROM mixed JOIN quotas ON mixed.source IS NOT DISTINCT FROM quotas.source"


def _matches_sql(pattern: str, kind: int, group: int, least: int) -> str:
    """Same reading of positions as the operator's: pieces between matches and the matches before."""
    quoted = pattern.replace("'", "''")
    return rf"""
  (SELECT * FROM (SELECT doc_id, unnest(list_transform(range(1, len(hits) + 1), lambda i: {{'start': (list_sum(list_transform(parts[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: length(x))), 0))::BIGINT, 'kind': {kind}, 'len': length(hits[i]), 'hit': hits[i], 'value': groups[i]}}), recursive := true)
   FROM (SELECT doc_id, string_split_regex(text, '{quoted}') AS parts, regexp_extract_all(text, '{quoted}', 0) AS hits, regexp_extract_all(text, '{quoted}', {group}) AS groups FROM documents WHERE regexp_matches(text, '{quoted}')))
   WHERE length(value) >= {least})"""


OP9_SQL = rf"""
WITH base AS (SELECT doc_id, start, kind, start + len AS stop FROM ({_matches_sql(secret_scan.ASSIGN, 0, 2, 8)} UNION ALL {_matches_sql(secret_scan.ACCESS, 1, 0, 16)} UNION ALL {_matches_sql(secret_scan.HEX, 2, 0, 32)})),
runs AS (SELECT doc_id, source, text, start, start + len AS stop, hit FROM {_matches_sql(secret_scan.CANDIDATE, 3, 0, 24)} JOIN documents USING (doc_id)
  WHERE regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[A-Za-z]')),
apart AS (SELECT * FROM runs r WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = r.doc_id AND b.start < r.stop AND r.start < b.stop)),
held AS (SELECT hit, source, count(DISTINCT text) AS n FROM apart GROUP BY hit, source),
whole AS (SELECT hit, count(DISTINCT text) AS n FROM apart GROUP BY hit),
owned AS (SELECT hit FROM held GROUP BY hit HAVING count(*) = 1 UNION SELECT hit FROM held JOIN whole USING (hit, n)),
spans AS (SELECT * FROM base UNION ALL SELECT doc_id, start, 3, stop FROM apart SEMI JOIN owned USING (hit)),
listed AS (
  SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    string_agg(['assign', 'access', 'hex', 'owned'][kind + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind) FILTER (kind < 3) AS base,
    string_agg(['assign', 'access', 'hex', 'owned'][kind + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind) AS spans
  FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN listed USING (doc_id)
"""


#: A digest's 40 hexadecimal digits by fives: 20 bits are four base32 letters.
_BASE32 = "array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31))::INT, 1)), '')"

OP5_SQL = f"""
WITH held AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM held
"""

OP10_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END)) AS grams FROM w),
nodes AS (SELECT min(doc_id) AS node, grams, len(grams) AS n FROM s WHERE len(grams) > 0 GROUP BY grams),
lists AS (SELECT node, n, unnest(grams) AS gram FROM nodes),
links AS (SELECT a.node AS a, b.node AS b FROM lists a JOIN lists b ON a.gram = b.gram AND a.node <> b.node AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach AS (SELECT node, node AS head FROM nodes UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.head),
heads AS (SELECT node, min(head) AS head FROM reach GROUP BY node)
SELECT doc_id, len(s.grams)::BIGINT AS n_shingles, coalesce(head, doc_id) AS component_id FROM s LEFT JOIN nodes ON nodes.grams = s.grams LEFT JOIN heads USING (node)
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_url_reputation": OP3_SQL, "op5_warc_members": OP5_SQL, "op7_source_mixing": OP7_SQL, "op9_secret_scan": OP9_SQL, "op10_ngram_join": OP10_SQL}
