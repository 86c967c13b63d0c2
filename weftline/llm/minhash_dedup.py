"""MinHash near-duplicates with SetSketch registers: see ``setsketch`` for the sketch and ``near_sets`` for the join.

Defined results: a document's set are its distinct 4-word shingles, A-Z lower-cased; with fewer words all of them are one shingle; null and
empty texts, and those of white space, have no set and are linked with nothing. Rows are told by themselves: rows that repeat a doc_id
each have their own text, and share a component only if their texts are linked. component_id is the smallest doc_id of the
component, null if none of its rows has one; kept compares it null-safely. An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import near_sets
from weftline.llm.common import Scratch, table

WORDS = 4


def near_duplicates(docs: DataFrame, words: int = WORDS, scratch: Scratch | None = None) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles, component_id, kept."""
    scratch = scratch or Scratch(docs.sparkSession, "setsketch")
    docs = docs.select("doc_id", "text")
    signed = scratch.save(near_sets.sketches(docs, words), "signed")
    roots = near_sets.roots(signed, docs, words, scratch)
    firsts = signed.filter("id is not null").groupBy("id").agg(F.min("doc_id").alias("first"))
    named = scratch.save(firsts.join(roots, "id", "left").select("id", "first", F.coalesce("root", "id").alias("root")), "named")
    least = scratch.save(named.groupBy("root").agg(F.min("first").alias("component_id")), "least")
    named = scratch.save(named.join(least, "root").select("id", "component_id"), "components")
    out = signed.select("doc_id", F.col("n").alias("n_shingles"), "id").join(named, "id", "left")
    out = out.withColumn("component_id", F.when(F.col("id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op11_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE t AS (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL),
w AS (SELECT text, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM t),
s AS (SELECT DISTINCT text, sh FROM (SELECT text, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE unnest(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) END AS sh FROM w WHERE len(w) >= 4
  UNION ALL SELECT text, array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND 3)),
h AS (SELECT md5_number(text) AS t, sh FROM s),
n AS (SELECT t, count(*) AS n FROM h GROUP BY t),
p AS (SELECT a.t AS u, b.t AS v, count(*) AS shared FROM h a JOIN h b ON a.sh = b.sh GROUP BY 1, 2),
e AS (SELECT u, v FROM p JOIN n x ON x.t = u JOIN n y ON y.t = v WHERE 9 * shared >= 4 * (x.n + y.n)),
d AS (SELECT doc_id, md5_number(text) AS t FROM documents),
f AS (SELECT t, min(doc_id) AS f FROM d GROUP BY t),
r(t, c) AS (SELECT t, f FROM f UNION SELECT e.v, r.c FROM r JOIN e ON e.u = r.t WHERE e.u <> e.v),
c AS (SELECT t, min(c) AS c FROM r GROUP BY t)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, CASE WHEN n.n IS NULL THEN doc_id ELSE c.c END AS component_id, coalesce(n.n IS NULL OR doc_id = c.c, false) AS kept
FROM d LEFT JOIN n ON n.t = d.t LEFT JOIN c ON c.t = d.t
"""
