"""Queries of the training-data problems on texts and oversized items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonargrid.llm import encoding, leakage, mixing, segments, spans
from sonargrid.session import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return segments.quiet_stretches(table(spark, d, "samples"))


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return segments.pieces(table(spark, d, "samples"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return encoding.garbled(encoding.text_cells(table(spark, d, "metadata"), table(spark, d, "markers"))).select("origin", "rec_id", "item_no", "field").distinct()


def p3_restored(spark: SparkSession, d: str) -> DataFrame:
    return encoding.garbled(encoding.text_cells(table(spark, d, "metadata"), table(spark, d, "markers")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "benchmark"))


def p6_removed(spark: SparkSession, d: str) -> DataFrame:
    return leakage.removed(table(spark, d, "documents"), table(spark, d, "benchmark"))


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "mix_targets")
    return mixing.shares(mixing.mixture(table(spark, d, "documents"), targets), targets)


def p7_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Whether every source of the mixture keeps within its bounds: its share, its repeats, each document once and in its own source.

    Flights keep the totals and only the last two documents of a source are landed, so a share may be off by three of the largest documents, besides 0.002.
    """
    docs, targets = table(spark, d, "documents"), table(spark, d, "mix_targets")
    mixed = mixing.mixture(docs, targets)
    own = docs.select("doc_id", F.lower(F.trim("source")).alias("source")).distinct().withColumn("own", F.lit(True))
    strays = mixed.groupBy("doc_id", "source").agg(F.count("*").alias("n")).join(own, ["doc_id", "source"], "left").groupBy("source").agg(F.count_if(F.expr("own IS NULL OR n > 1")).alias("strays"))
    got = mixing.shares(mixed, targets).join(strays, "source", "left").crossJoin(F.broadcast(mixed.agg((0.002 + 3 * F.max("n_tokens") / F.sum(F.col("n_tokens") * F.col("uses"))).alias("bound"))))  # one row
    return got.select("source", "max_repeats", (F.abs(F.col("share") - F.col("target_share")) <= F.col("bound")).alias("on_target"), (F.col("most_uses") <= F.col("max_repeats")).alias("within_repeats"), (F.col("strays") == 0).alias("own_documents_once"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_spans(table(spark, d, "documents"))


def p8_coverage(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return spans.coverage(docs, spans.shared_spans(docs))


QUERIES = {f.__name__: f for f in (p2_found, p2_pieces, p3_found, p3_restored, p6_found, p6_removed, p7_mixture, p7_shares, p7_bounds, p8_found, p8_coverage)}

_WORDS = r"""regexp_extract_all(lower(regexp_replace(text, '</?[A-Za-z!][^<>]*>|\[/?[A-Za-z*][^\[\]]*\]|&(?:[A-Za-z][A-Za-z0-9_]*|#[0-9]+|#[xX][0-9A-Fa-f]+);', ' ', 'g')), '[\p{L}\p{N}]+')"""
_LEAKS = f"""dw AS (SELECT DISTINCT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL), iw AS (SELECT DISTINCT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
dg AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS g FROM dw WHERE len(w) >= 12),
ig AS (SELECT item_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS g FROM iw WHERE len(w) >= 12)"""
_DRESS = r"""</?[A-Za-z!][^<>]*>|\[/?[A-Za-z*][^\[\]]*\]|&(?:[A-Za-z][A-Za-z0-9_]*|#[0-9]+|#[xX][0-9A-Fa-f]+);"""
_REMOVED = rf"""WITH {_LEAKS}, d AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL), l AS (SELECT *, regexp_extract_all(text, '{_DRESS}|[\p{{L}}\p{{N}}]+|(?s:.)') AS toks FROM d),
t AS (SELECT doc_id, text, unnest(toks) AS tok, unnest(range(1, len(toks) + 1)) AS k FROM l), w AS (SELECT *, row_number() OVER v AS wi FROM t WHERE regexp_matches(tok, '^[\p{{L}}\p{{N}}]') WINDOW v AS (PARTITION BY doc_id, text ORDER BY k)),
n AS (SELECT *, string_agg(lower(tok), ' ') OVER v AS g, max(k) OVER v AS last, count(*) OVER v AS n FROM w WINDOW v AS (PARTITION BY doc_id, text ORDER BY wi ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING)),
h AS (SELECT doc_id, text, k, max(last) AS last FROM n JOIN (SELECT DISTINCT g FROM ig) USING (g) WHERE n = 12 GROUP BY 1, 2, 3),
c AS (SELECT t.*, coalesce(max(last) OVER (PARTITION BY doc_id, text ORDER BY t.k) >= t.k, false) AS gone FROM t LEFT JOIN h USING (doc_id, text, k)),
r AS (SELECT doc_id, text AS whole, coalesce(string_agg(tok, '' ORDER BY k) FILTER (NOT gone), '') AS kept, sum(length(tok)) FILTER (gone) AS leaked FROM c GROUP BY 1, 2)
SELECT doc_id, CASE WHEN leaked <= 0.5::DOUBLE * length(whole) THEN kept END AS text, leaked::BIGINT AS leaked_chars, leaked > 0.5::DOUBLE * length(whole) AS dropped FROM r WHERE leaked > 0"""
_SHARED = """d AS (SELECT DISTINCT doc_id, text FROM documents WHERE length(text) >= 250 AND doc_id IS NOT NULL), p AS (SELECT doc_id, text, unnest(range(0, length(text) - 249)) AS i FROM d),
w AS (SELECT doc_id, i, md5(substr(text, i + 1, 250)) AS h FROM p), s AS (SELECT h FROM w GROUP BY h HAVING count(DISTINCT doc_id) > 1),
r AS (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM w JOIN s USING (h)), sp AS (SELECT doc_id, min(i) AS start_char, max(i) + 250 AS end_char FROM r GROUP BY doc_id, k)"""
_QUIET = """s AS (SELECT rec_id, channel, frame, min(x) AS x, bool_or(x IS NULL) AS gone FROM samples GROUP BY 1, 2, 3), m AS (SELECT rec_id, channel, median(x) AS m FROM s GROUP BY 1, 2),
n AS (SELECT rec_id, count(DISTINCT channel) AS channels, count(DISTINCT frame) AS frames FROM s GROUP BY 1)"""
# a cut after e frames is quiet with 25 quiet frames on either side, a lull with one; from each place the next cut is the last quiet one within 950 frames, else the last lull of the latter half
_PIECES = f"""WITH RECURSIVE {_QUIET}, f AS (SELECT rec_id, frame, count(*) FILTER (abs(x - m) <= 0.02::DOUBLE) = channels AS q FROM s JOIN m USING (rec_id, channel) JOIN n USING (rec_id) GROUP BY rec_id, frame, channels),
j AS (SELECT *, coalesce(frame - lag(frame) OVER (PARTITION BY rec_id ORDER BY frame) > 1001, true)::INT AS new FROM f), k AS (SELECT *, sum(new) OVER (PARTITION BY rec_id ORDER BY frame) AS part FROM j),
ext AS (SELECT rec_id, part, min(frame) AS lo, max(frame) + 1 - min(frame) AS n FROM k GROUP BY 1, 2), g AS (SELECT rec_id, part, lo, n, unnest(range(0, n + 1)) AS e FROM ext),
c AS (SELECT g.*, coalesce(q, false)::INT AS q FROM g LEFT JOIN k ON k.rec_id = g.rec_id AND k.part = g.part AND k.frame = g.lo + g.e),
b AS (SELECT *, sum(q) OVER (PARTITION BY rec_id, part ORDER BY e ROWS BETWEEN 25 PRECEDING AND 24 FOLLOWING) = 50 AS quiet, q = 1 AND lag(q) OVER (PARTITION BY rec_id, part ORDER BY e) = 1 AS lull FROM c),
l AS (SELECT *, max(CASE WHEN quiet THEN e END) OVER w AS last_quiet, max(CASE WHEN lull THEN e END) OVER w AS last_lull FROM b WINDOW w AS (PARTITION BY rec_id, part ORDER BY e)),
nx AS (SELECT a.rec_id, a.part, a.e, CASE WHEN a.n - a.e <= 950 OR (a.e = 0 AND a.n <= 1000) THEN a.n WHEN z.last_quiet >= a.e + 75 THEN z.last_quiet WHEN z.last_lull >= a.e + 476 THEN z.last_lull ELSE a.e + 950 END AS nxt
  FROM l a LEFT JOIN l z ON z.rec_id = a.rec_id AND z.part = a.part AND z.e = a.e + 950 WHERE a.e < a.n),
p AS (SELECT rec_id, part, e, nxt FROM nx WHERE e = 0 UNION ALL SELECT x.rec_id, x.part, x.e, x.nxt FROM p JOIN nx x ON x.rec_id = p.rec_id AND x.part = p.part AND x.e = p.nxt)
SELECT p.rec_id, lo + p.e - CASE WHEN p.e > 0 THEN 50 ELSE 0 END AS start_frame, lo + nxt AS end_frame, CASE WHEN nxt = n THEN 'end' WHEN quiet THEN 'quiet' WHEN lull THEN 'lull' ELSE 'limit' END AS boundary FROM p JOIN l ON l.rec_id = p.rec_id AND l.part = p.part AND l.e = p.nxt"""
ORACLES: dict[str, str] = {
    "p2_pieces": _PIECES,
    "p2_found": """WITH s AS (SELECT rec_id, channel, frame, min(x) AS x, bool_or(x IS NULL) AS gone FROM samples GROUP BY 1, 2, 3), m AS (SELECT rec_id, channel, median(x) AS m FROM s GROUP BY 1, 2),
n AS (SELECT rec_id, count(DISTINCT channel) AS channels, count(DISTINCT frame) AS frames FROM s GROUP BY 1),
f AS (SELECT rec_id, frame FROM s JOIN m USING (rec_id, channel) JOIN n USING (rec_id) WHERE frames > 1000 GROUP BY rec_id, frame, channels HAVING count(*) FILTER (abs(x - m) <= 0.02::DOUBLE) = channels),
k AS (SELECT *, frame - row_number() OVER (PARTITION BY rec_id ORDER BY frame) AS k FROM f)
SELECT rec_id, min(frame) AS start_frame, max(frame) + 1 AS end_frame FROM k GROUP BY rec_id, k HAVING count(*) >= 50""",
    "p6_removed": _REMOVED,
    "p7_bounds": "SELECT lower(trim(source)) AS source, max_repeats, true AS on_target, true AS within_repeats, true AS own_documents_once FROM mix_targets",
    "p6_found": f"WITH {_LEAKS} SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)",
    "p8_found": f"WITH {_SHARED} SELECT * FROM sp",
    "p8_coverage": f"""WITH {_SHARED}, o AS (SELECT *, max(end_char) OVER (PARTITION BY doc_id ORDER BY start_char, end_char ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM sp),
c AS (SELECT doc_id, sum(end_char - greatest(start_char, coalesce(reach, start_char)))::BIGINT AS shared_chars FROM o GROUP BY 1), z AS (SELECT doc_id, max(length(text)) AS n_chars FROM d GROUP BY 1)
SELECT doc_id, n_chars, shared_chars, shared_chars / n_chars AS shared_share FROM c JOIN z USING (doc_id)""",
}
