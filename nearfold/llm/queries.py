"""One query for each operator of the subpackage, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, langid, minhash, pii, simhash, substring, tokenbin, urlfilter, warc
from .store import materialize, table


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.duplicates(table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op3_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens as blocks, each decoded again."""
    return tokenbin.write_blocks(table(spark, sf_dir, "documents"), check=True)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class of near copies and its number of links."""
    return simhash.document_classes(table(spark, sf_dir, "documents"), weighted=True)


def op5_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archive of all pages against a replica, indexed from its own records, in which one record in 256 is altered and one in 256 was lost."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    fate = F.substring(F.md5(F.col("page_id").cast("string")), 1, 2)
    altered = pages.filter(F.coalesce(fate != "01", F.lit(True))).withColumn("html", F.when(fate == "00", F.overlay("html", F.lit("?"), F.lit(1))).otherwise(F.col("html")))
    return warc.audit(*(materialize(warc.index(p)) for p in (pages, altered)))


def op8_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_passages(table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, fetched at a time that follows from its id, against a list whose history follows from the hosts."""
    pages = table(spark, sf_dir, "pages")
    captures = pages.select("page_id", "url", (F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.col("page_id") * 7919, F.lit(525600)) * 60)).alias("fetched_at"))
    host = urlfilter.host_of(F.col("url"))
    digit = lambda k: F.expr(f"instr('0123456789abcdef', substr(md5(pattern), {k}, 1)) - 1")
    named = pages.select(F.explode(F.array(F.concat(F.lit("d:"), host), F.concat(F.lit("d:"), F.regexp_replace(host, r"^(www|m|blog)\.", "")), F.concat(F.lit("p:"), host, F.lit("/"), F.regexp_extract(urlfilter.rest_of(F.col("url")), r"^/([^/?]*)", 1)))).alias("pattern")).distinct()
    listed = named.filter(digit(1) < 5)
    added = F.timestamp_seconds(F.lit(1704067200) + digit(2) * 12 * 86400)
    removed = F.timestamp_seconds(F.lit(1704067200) + (digit(2) * 12 + digit(3) * 9) * 86400)
    again = F.timestamp_seconds(F.lit(1704067200) + (digit(2) * 12 + digit(3) * 9 + digit(4) * 6) * 86400)
    entries = listed.select("pattern", F.lit("add").alias("action"), added.alias("at")).union(listed.filter(digit(5) < 12).select("pattern", F.lit("remove"), removed)).union(listed.filter(digit(5) < 6).select("pattern", F.lit("add"), again))
    return urlfilter.evaluate(captures, entries)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, decoded again, and whether that is the document."""
    return bpe.encode_checked(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def tokens_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts that the documents' tokens, as a table, decode to."""
    return bpe.decode(materialize(bpe.encode(table(spark, sf_dir, "documents"))))


def blocks_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts that the documents' token blocks, as a table, decode to."""
    blocks = materialize(tokenbin.write_blocks(table(spark, sf_dir, "documents")))
    return bpe.decode(tokenbin.read_blocks(blocks))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash": op1_minhash,
    "op2_pii": op2_pii,
    "op3_token_blocks": op3_token_blocks,
    "op4_simhash": op4_simhash,
    "op5_warc_audit": op5_warc_audit,
    "op6_language": op6_language,
    "op7_bpe": op7_bpe,
    "op8_repeated_passages": op8_repeated_passages,
    "op9_url_filter": op9_url_filter,
    "op10_decontaminate": op10_decontaminate,
    "tokens_decoded": tokens_decoded,
    "blocks_decoded": blocks_decoded,
}

#: The lengths of the records follow from their texts; which are altered or lost follows from the ids.
WARC_SQL = """
WITH r AS (
  SELECT page_id, html, coalesce(CAST(floor(page_id / 4096.0) AS BIGINT), -1) AS file,
    'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), '')
    || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: '
    || CAST(strlen(coalesce(html, '')) AS VARCHAR) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record
  FROM pages
), o AS (
  SELECT file, page_id, html, CAST(row_number() OVER w - 1 AS BIGINT) AS seq, CAST(coalesce(sum(strlen(record)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
    CAST(strlen(record) AS BIGINT) AS length, substr(md5(CAST(page_id AS VARCHAR)), 1, 2) AS fate
  FROM r WINDOW w AS (PARTITION BY file ORDER BY page_id, sha256(record))
)
SELECT file, seq, page_id, "offset", length, CASE fate WHEN '00' THEN 'damaged' ELSE 'missing' END AS finding FROM o
WHERE fate = '01' OR fate = '00' AND substr(html, 1, 1) <> '?'
"""

URL_SQL = r"""
WITH c AS (
  SELECT page_id, url, TIMESTAMP '2024-01-01' + to_minutes(page_id * 7919 % 525600) AS fetched_at,
    lower(regexp_replace(regexp_extract(url, '^\s*[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/:?#]+)', 1), '[\s.]+$', '')) AS host,
    regexp_replace(regexp_extract(url, '^\s*[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^#]*)', 1), '\s+$', '') AS rest
  FROM pages
), named AS (
  SELECT 'd:' || host AS pattern FROM c UNION SELECT 'd:' || regexp_replace(host, '^(www|m|blog)\.', '') FROM c UNION SELECT 'p:' || host || '/' || regexp_extract(rest, '^/([^/?]*)', 1) FROM c
), d AS (
  SELECT pattern, instr('0123456789abcdef', substr(md5(pattern), 1, 1)) - 1 AS d1, instr('0123456789abcdef', substr(md5(pattern), 2, 1)) - 1 AS d2, instr('0123456789abcdef', substr(md5(pattern), 3, 1)) - 1 AS d3,
    instr('0123456789abcdef', substr(md5(pattern), 4, 1)) - 1 AS d4, instr('0123456789abcdef', substr(md5(pattern), 5, 1)) - 1 AS d5
  FROM named
), entries AS (
  SELECT pattern, 'add' AS action, TIMESTAMP '2024-01-01' + to_days(CAST(d2 * 12 AS INTEGER)) AS moment FROM d WHERE d1 < 5
  UNION SELECT pattern, 'remove', TIMESTAMP '2024-01-01' + to_days(CAST(d2 * 12 + d3 * 9 AS INTEGER)) FROM d WHERE d1 < 5 AND d5 < 12
  UNION SELECT pattern, 'add', TIMESTAMP '2024-01-01' + to_days(CAST(d2 * 12 + d3 * 9 + d4 * 6 AS INTEGER)) FROM d WHERE d1 < 5 AND d5 < 6
), v AS (
  SELECT pattern, action, moment AS since, lead(moment) OVER (PARTITION BY pattern ORDER BY moment, action) AS until FROM entries
), hits AS (
  SELECT c.page_id, c.url, c.fetched_at, v.pattern, v.since,
    row_number() OVER (PARTITION BY c.page_id, c.url, c.fetched_at ORDER BY CASE substr(v.pattern, 1, 1) WHEN 'u' THEN 0 WHEN 'p' THEN 1 ELSE 2 END, -length(v.pattern), v.pattern, v.since) AS nth
  FROM c JOIN v ON v.action = 'add' AND (v.until IS NULL OR v.until > v.since) AND c.fetched_at >= v.since AND (v.until IS NULL OR c.fetched_at < v.until)
    AND (v.pattern = 'u:' || c.host || c.rest OR v.pattern = 'p:' || c.host || '/' || regexp_extract(c.rest, '^/([^/?]*)', 1)
      OR v.pattern LIKE 'd:%' AND ('.' || c.host) LIKE '%.' || substr(v.pattern, 3))
  WHERE length(c.host) > 0
)
SELECT DISTINCT c.page_id, c.fetched_at, h.pattern IS NOT NULL AS listed, h.pattern, h.since
FROM c LEFT JOIN hits h ON h.nth = 1 AND h.page_id = c.page_id AND h.url = c.url AND h.fetched_at = c.fetched_at
"""

#: Rows of ``documents`` (equal ones once) as words with their places: cut (rid, doc_id, n, words, starts, ends).
WORDS_SQL = r"""
WITH rows_ AS (SELECT row_number() OVER () AS rid, doc_id, text FROM (SELECT {distinct} doc_id, text FROM documents WHERE text IS NOT NULL{known})),
pieces AS (SELECT rid, doc_id, regexp_extract_all(text, '[\p{{L}}\p{{M}}\p{{N}}]+|[^\p{{L}}\p{{M}}\p{{N}}]+') AS p FROM rows_),
placed AS (SELECT rid, doc_id, k, piece, CAST(sum(length(piece)) OVER (PARTITION BY rid ORDER BY k) AS BIGINT) AS stop FROM (SELECT rid, doc_id, unnest(p) AS piece, unnest(range(1, len(p) + 1)) AS k FROM pieces)),
cut AS (SELECT rid, any_value(doc_id) AS doc_id, count(*) AS n, list(lower(piece) ORDER BY k) AS words, list(stop - length(piece) ORDER BY k) AS starts, list(stop ORDER BY k) AS ends FROM placed WHERE regexp_matches(piece, '[\p{{L}}\p{{M}}\p{{N}}]') GROUP BY rid)"""

PASSAGES_SQL = WORDS_SQL.format(distinct="DISTINCT", known=" AND doc_id IS NOT NULL") + f""",
w AS (SELECT rid, unnest(range(0, n - {substring.WINDOW} + 1)) AS pos FROM cut WHERE n >= {substring.WINDOW}),
h AS (SELECT w.rid, w.pos, md5(array_to_string(list_slice(cut.words, w.pos + 1, w.pos + {substring.WINDOW}), ' ')) AS h FROM w JOIN cut USING (rid)),
shared AS (SELECT h FROM h GROUP BY h HAVING count(DISTINCT rid) > 1),
hit AS (SELECT rid, pos, CASE WHEN pos - lag(pos) OVER (PARTITION BY rid ORDER BY pos) <= {substring.WINDOW} THEN 0 ELSE 1 END AS fresh FROM h WHERE h IN (SELECT h FROM shared)),
isle AS (SELECT rid, pos, sum(fresh) OVER (PARTITION BY rid ORDER BY pos) AS isle FROM hit),
span AS (SELECT rid, min(pos) AS lo, max(pos) + {substring.WINDOW} AS hi FROM isle GROUP BY rid, isle)
SELECT cut.doc_id, CAST(cut.starts[lo + 1] AS INTEGER) AS start, CAST(cut.ends[hi] AS INTEGER) AS "end", CAST(hi - lo AS INTEGER) AS words FROM span JOIN cut USING (rid)
"""

LEAKS_SQL = WORDS_SQL.format(distinct="", known="") + f""",
items AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{N}}]+') AS v FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
pattern AS (SELECT DISTINCT item_id, least(len(v), {decontam.WINDOW}) AS size, array_to_string(list_slice(v, a + 1, a + {decontam.WINDOW}), ' ') AS p FROM (SELECT item_id, v, unnest(range(0, greatest(1, len(v) - {decontam.WINDOW} + 1))) AS a FROM items WHERE len(v) > 0)),
w AS (SELECT rid, size, unnest(range(0, n - size + 1)) AS pos FROM cut, (SELECT DISTINCT size FROM pattern) WHERE n >= size),
seen AS (SELECT w.rid, w.pos, w.size, array_to_string(list_slice(cut.words, w.pos + 1, w.pos + w.size), ' ') AS p FROM w JOIN cut USING (rid)),
hit AS (SELECT rid, item_id, pos AS lo, pos + seen.size AS hi FROM seen JOIN pattern USING (p, size)),
step AS (SELECT *, CASE WHEN lo < max(hi) OVER (PARTITION BY rid, item_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM hit),
isle AS (SELECT *, sum(fresh) OVER (PARTITION BY rid, item_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS isle FROM step),
span AS (SELECT rid, item_id, min(lo) AS lo, max(hi) AS hi FROM isle GROUP BY rid, item_id, isle)
SELECT cut.doc_id, item_id, CAST(cut.starts[lo + 1] AS INTEGER) AS start, CAST(cut.ends[hi] AS INTEGER) AS "end", CAST(hi - lo AS INTEGER) AS words FROM span JOIN cut USING (rid)
"""

#: Exact similarities of all pairs that share a shingle, and their connected components.
COPIES_SQL = WORDS_SQL.format(distinct="DISTINCT", known=" AND doc_id IS NOT NULL") + f""",
gram AS (SELECT DISTINCT rid, array_to_string(list_slice(words, a + 1, a + {minhash.SHINGLE}), ' ') AS g FROM (SELECT rid, words, unnest(range(0, greatest(1, n - {minhash.SHINGLE} + 1))) AS a FROM cut)),
size AS (SELECT rid, count(*) AS n FROM gram GROUP BY rid),
both_ AS (SELECT x.rid AS a, y.rid AS b, count(*) AS n FROM gram x JOIN gram y ON x.g = y.g AND x.rid < y.rid GROUP BY 1, 2),
near AS (SELECT a, b FROM both_ JOIN size x ON x.rid = a JOIN size y ON y.rid = b WHERE both_.n >= {minhash.THRESHOLD} * (x.n + y.n - both_.n)),
edge AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
reach AS (WITH RECURSIVE r(a, b) AS (SELECT a, b FROM edge UNION SELECT r.a, edge.b FROM r JOIN edge ON r.b = edge.a) SELECT a, b FROM r),
team AS (SELECT a AS rid, least(a, min(b)) AS team FROM reach GROUP BY a),
stat AS (SELECT team, min(doc_id) AS duplicate_of, count(*) AS group_size FROM team JOIN cut USING (rid) GROUP BY team)
SELECT DISTINCT cut.doc_id, stat.duplicate_of, stat.group_size FROM team JOIN stat USING (team) JOIN cut USING (rid) WHERE cut.doc_id <> stat.duplicate_of
"""

WHOLE_SQL = "SELECT doc_id, text FROM documents"

ORACLES: dict[str, str] = {
    "op1_minhash": COPIES_SQL,
    "op5_warc_audit": WARC_SQL,
    "op8_repeated_passages": PASSAGES_SQL,
    "op9_url_filter": URL_SQL,
    "op10_decontaminate": LEAKS_SQL,
    "tokens_decoded": WHOLE_SQL,
    "blocks_decoded": WHOLE_SQL.replace("text", "coalesce(text, '') AS text", 1),
}
