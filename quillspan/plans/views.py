"""Neutral views of the synthetic tables on which the operators are run and compared with SQL.

Lines come from documents, names from benchmark, and mentions and spans from events: within a user, events in order
of time are lines, runs of purchases are spans, and any other event mentions its type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.spans import sessionize, span_bounds


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", F.lit("b").alias("block_id"), F.posexplode(F.split("text", "\n")).alias("p", "text")).select(
        "doc_id", "lang", "block_id", (F.col("p") + 1).alias("lineno"), "text")


def gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    at = lambda i: F.try_element_at("w", F.lit(i))
    names = F.array(at(1), at(3), F.concat(at(1), F.lit(" "), at(2)))
    return table(spark, sf_dir, "benchmark").select("item_id", w.alias("w")).select("item_id", F.explode(names).alias("name")).where("name is not null").select(
        "name", F.concat(F.lit("b"), (F.col("item_id") % 50).cast("string")).alias("code")).distinct()


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.row_number().over(w).alias("lineno"), "event_type", F.when(F.col("event_type") == "purchase", F.lit("s")).alias("span_id"))


def event_mentions(e: DataFrame) -> DataFrame:
    return e.where("event_type <> 'purchase'").select("doc_id", F.col("lineno").alias("startline"), F.col("event_type").alias("name"), F.substring("event_type", 1, 3).alias("code"), F.col("lineno").alias("ord"))


def event_spans(e: DataFrame) -> DataFrame:
    return span_bounds(sessionize(e))


LINES = """lines AS (SELECT doc_id, lang, i AS lineno, string_split(text, chr(10))[i] AS text
  FROM documents, LATERAL (SELECT unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i))"""
GAZETTEER = """bw AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM benchmark),
gaz AS (SELECT DISTINCT name, 'b' || (item_id % 50) AS code FROM (
  SELECT item_id, w[1] AS name FROM bw UNION ALL SELECT item_id, w[3] FROM bw UNION ALL SELECT item_id, w[1] || ' ' || w[2] FROM bw) WHERE name IS NOT NULL)"""
PAIRS = """p0 AS (SELECT doc_id, lineno, text AS line1, lead(text) OVER d AS line2, lead(lineno) OVER d AS lineno2 FROM lines WINDOW d AS (PARTITION BY doc_id ORDER BY lineno)),
pairs AS (SELECT *, CASE WHEN line2 IS NULL THEN rtrim(line1, ' -') WHEN ends_with(line1, '-') OR starts_with(line2, '-') THEN rtrim(line1, ' ') || ltrim(line2, ' ')
  ELSE rtrim(line1, ' -') || ' ' || ltrim(line2, ' -') END AS joined,
  CASE WHEN line2 IS NULL OR ends_with(line1, '-') OR starts_with(line2, '-') THEN 0 ELSE 1 END AS added FROM p0)"""
CORE = r"['ǂ!/=]*[\p{L}\p{N}_]+(?:[-'/]+[\p{L}\p{N}_]+)*".replace("'", "''")


def core_sql(x: str) -> str:
    return f"CASE WHEN regexp_extract({x}, '{CORE}') = '' THEN {x} ELSE regexp_extract({x}, '{CORE}') END"


TOKENS = rf"""vocab AS (SELECT DISTINCT unnest(string_split(name, ' ')) AS v FROM gaz),
t0 AS (SELECT doc_id, lineno, line1, line2, lineno2, added, i AS pos, pieces[i] AS piece FROM (SELECT *, regexp_extract_all(joined, '\s*\S+') AS pieces FROM pairs), LATERAL (SELECT unnest(range(1, len(pieces) + 1)) AS i)),
t1 AS (SELECT *, CAST(sum(length(piece)) OVER (PARTITION BY doc_id, lineno ORDER BY pos) AS BIGINT) AS upto, regexp_extract(piece, '\S+') AS raw FROM t0),
t2 AS (SELECT *, {core_sql('raw')} AS own, {core_sql('lower(strip_accents(raw))')} AS key FROM t1),
t3 AS (SELECT *, upto - length(raw) + strpos(raw, own) - 1 AS start, replace(key, '-', '') AS bare FROM t2),
tok AS (SELECT t3.*, start + length(own) AS stop, CASE WHEN a.v IS NOT NULL THEN key WHEN strpos(key, '-') > 0 AND b.v IS NOT NULL THEN bare END AS word
  FROM t3 LEFT JOIN vocab a ON a.v = key LEFT JOIN vocab b ON b.v = bare),
runs AS (SELECT *, sum(CASE WHEN word IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, lineno ORDER BY pos) AS run FROM tok),
phr AS (SELECT doc_id, lineno, line1, line2, lineno2, added, pos, 1 AS n, run, word AS name, start, stop FROM runs WHERE word IS NOT NULL
  UNION ALL SELECT a.doc_id, a.lineno, a.line1, a.line2, a.lineno2, a.added, a.pos, 2, a.run, a.word || ' ' || b.word, a.start, b.stop
  FROM runs a JOIN runs b ON a.doc_id = b.doc_id AND a.lineno = b.lineno AND b.pos = a.pos + 1 WHERE a.word IS NOT NULL AND b.word IS NOT NULL),
hits AS (SELECT * FROM phr WHERE name IN (SELECT name FROM gaz)),
longest AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY doc_id, lineno, run ORDER BY n DESC, pos) = 1)"""


def mentions_sql(source: str = "hits") -> str:
    return f"""WITH {LINES},
{GAZETTEER},
{PAIRS},
{TOKENS},
m0 AS (SELECT *, length(rtrim(line1, ' -')) AS seam FROM {source}),
m1 AS (SELECT *, stop <= seam AS fst, start < seam AND stop > seam AND line1 <> '' AND coalesce(line2, '') <> '' AS over FROM m0),
m2 AS (SELECT *, CASE WHEN over THEN stop - length(line1) - added + length(line2) - length(ltrim(line2, ' -')) ELSE stop END AS endcol FROM m1 WHERE fst OR over),
found AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY lineno, pos, n, code) AS ord, lineno AS startline, start AS startcol, CASE WHEN over THEN lineno2 ELSE lineno END AS endline, endcol,
  name, code, CASE WHEN over THEN substr(line1, start + 1) || substr(line2, 1, CAST(endcol AS INT)) ELSE substr(line1, start + 1, stop - start) END AS text FROM m2 JOIN gaz USING (name))
"""


EVENTS = """ev AS (SELECT user_id AS doc_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS lineno, event_type FROM events),
m AS (SELECT doc_id, lineno AS startline, event_type AS name, left(event_type, 3) AS code FROM ev WHERE event_type <> 'purchase'),
s0 AS (SELECT *, event_type = 'purchase' AND coalesce(lag(event_type) OVER (PARTITION BY doc_id ORDER BY lineno) <> 'purchase', true) AS new FROM ev),
s1 AS (SELECT *, CAST(sum(CAST(new AS INT)) OVER (PARTITION BY doc_id ORDER BY lineno) AS INT) AS span_ord FROM s0),
sp AS (SELECT doc_id, span_ord, min(lineno) AS top, max(lineno) AS bottom FROM s1 WHERE event_type = 'purchase' GROUP BY ALL),
facts AS (SELECT e.doc_id, max(lineno) AS last_line, count(*) AS num_lines, (SELECT count(DISTINCT name) FROM m WHERE m.doc_id = e.doc_id) AS num_names FROM ev e GROUP BY e.doc_id)"""
