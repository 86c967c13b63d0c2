"""Line deduplication with a log-template tree.

The tree has a fixed depth: a line goes down by its number of tokens and then by its first ``depth`` tokens, a token
that holds a digit counting as a variable field. Lines in one leaf are generalised together: at
each place a token stays if lines of ``min_texts`` texts or more have it there, else it is a variable field; a line of which less
than ``min_constant`` would stay is its own template.

A template found in ``min_texts`` texts or more is a candidate; candidates that stand in exactly the same texts are one *block*, such as the
lines of a licence. A text has words of its own (in no candidate), and owes the others to blocks. It bears witness for a block if it has words of its own,
and not fewer than it owes to *other* blocks. Blocks with ``min_texts`` witnesses or more are recurring, and their lines are dropped from
every text, however short what is left. So a passage goes at any length of the texts around it, but what only near copies of one text share is not
taken for boilerplate: they are altered at different places, so each shared line is a block of its own, beside many others. They are left to
near-duplicate detection. Texts that share one whole block and differ in the rest alone are texts around a passage, however little the rest is.
Equal texts count once.

Everything is DataFrame expressions. Only leaves that recur have their lines looked at; counts are
pre-aggregated, and what a line leads to goes back to texts by joins of freshly read tables, in which Spark splits skewed keys.
The two joins that move text are merge joins whatever the size of their other side, as that grows with the corpus.

Defined results: null texts stay null, empty ones empty; blank lines stay; equal texts get equal results whatever their
doc_id; an empty table gives no rows; other columns pass through ``deduplicate``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.common import Scratch, table, words_of

FIELD = "<*>"


def _lines(texts: DataFrame, depth: int) -> DataFrame:
    """(txt, no, line_id, leaf, line, n, total) of the lines with a token; n: the line's tokens, total: the text's."""
    cut = F.transform(F.split("text", "\n"), lambda line: F.struct(line.alias("line"), words_of(line).alias("tokens")))
    rows = texts.select(F.xxhash64("text").alias("txt"), cut.alias("cut"))
    rows = rows.select("txt", F.aggregate("cut", F.lit(0), lambda a, x: a + F.size(x["tokens"])).alias("total"), F.posexplode_outer("cut").alias("no", "at"))
    rows = rows.select("txt", "total", "no", "at.line", "at.tokens").filter(F.size("tokens") > 0)
    lead = F.transform(F.slice("tokens", 1, depth), lambda t: F.when(F.regexp_like(t, F.lit("[0-9]")), FIELD).otherwise(t))
    leaf = F.xxhash64(F.size("tokens"), F.array_join(lead, " "))
    return rows.select("txt", "no", leaf.alias("leaf"), F.xxhash64("line").alias("line_id"), "line", F.size("tokens").alias("n"), "total")


def recurring(texts: DataFrame, min_texts: int = 5, depth: int = 3, min_constant: float = 0.5, scratch: Scratch | None = None) -> DataFrame:
    """(txt, nos): numbers of the lines of each text (by its hash) whose template recurs."""
    scratch = scratch or Scratch(texts.sparkSession, "lines")
    lines = scratch.save(_lines(texts.filter("text is not null"), depth), "lines")
    leaves = lines.select("leaf", "txt").distinct().groupBy("leaf").count().filter(F.col("count") >= min_texts).select("leaf")
    leaves = scratch.save(leaves, "leaves")
    shared = scratch.save(lines.join(leaves.hint("merge"), "leaf"), "shared")
    scratch.drop("lines")
    by_line = shared.select("leaf", "line_id", "line", "txt").distinct().groupBy("leaf", "line_id", "line").agg(F.count("*").alias("texts"))
    by_line = scratch.save(by_line, "by-line")
    tokens = scratch.save(by_line.select("leaf", "line_id", "texts", F.posexplode(words_of(F.col("line"))).alias("pos", "token")), "tokens")
    stays = tokens.groupBy("leaf", "pos", "token").agg(F.sum("texts").alias("support")).filter(F.col("support") >= min_texts)
    stays = scratch.save(stays.select("leaf", "pos", "token", F.lit(True).alias("constant")), "constants")
    made = tokens.join(stays, ["leaf", "pos", "token"], "left").withColumn("constant", F.coalesce("constant", F.lit(False)))
    made = made.groupBy("leaf", "line_id").agg(
        F.avg(F.col("constant").cast("double")).alias("share"),
        F.sort_array(F.collect_list(F.struct("pos", F.when(F.col("constant"), F.col("token")).otherwise(FIELD).alias("token")))).alias("parts"),
    )
    template = F.when(F.col("share") >= min_constant, F.xxhash64("leaf", F.array_join("parts.token", " "))).otherwise(F.xxhash64("leaf", "line_id"))
    templates = scratch.save(made.select("line_id", template.alias("template")), "templates")
    scratch.drop("by-line", "tokens", "constants", "leaves")
    told = scratch.save(shared.select("txt", "no", "line_id", "n", "total").join(templates, "line_id").select("template", "txt", "no", "n", "total").distinct(), "told")
    scratch.drop("shared", "templates")

    often = told.select("template", "txt").distinct().groupBy("template").agg(F.count("*").alias("texts"), F.bit_xor("txt").alias("mark")).filter(F.col("texts") >= min_texts)
    often = scratch.save(often.select("template", F.xxhash64("texts", "mark").alias("block")), "often")
    candidates = scratch.save(told.join(often, "template").select("block", "txt", "no", "n", "total"), "candidates")
    scratch.drop("told")
    owed = candidates.groupBy("txt", "block").agg(F.sum("n").alias("words"), F.min("total").alias("total"))
    owed = owed.withColumn("owed", F.sum("words").over(Window.partitionBy("txt")))
    witnesses = owed.filter("total > owed and total - owed >= owed - words").groupBy("block").count().filter(F.col("count") >= min_texts)
    gone = candidates.select("block", "txt", "no").join(scratch.save(witnesses.select("block"), "recurring"), "block")
    return scratch.save(gone.groupBy("txt").agg(F.collect_set("no").alias("nos")), "dropped")


def deduplicate(docs: DataFrame, scratch: Scratch | None = None, **options) -> DataFrame:
    """docs with their recurring lines dropped from text, and n_lines and n_dropped beside."""
    names = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    drop = recurring(docs.select("text"), scratch=scratch, **options)
    df = docs.withColumn("_txt", F.xxhash64("text")).join(drop.withColumnRenamed("txt", "_txt").withColumnRenamed("nos", "_nos").hint("merge"), "_txt", "left")
    df = df.withColumn("_lines", F.split("text", "\n"))
    df = df.withColumn("_kept", F.filter("_lines", lambda _, k: ~F.array_contains("_nos", k)))
    none = F.col("_nos").isNull()
    return df.select(
        *[F.col(f"`{c}`") for c in names],
        F.when(none, F.col("text")).otherwise(F.array_join("_kept", "\n")).alias("text"),
        F.when(F.col("text").isNull(), 0).otherwise(F.size("_lines")).cast("long").alias("n_lines"),
        F.when(none, 0).otherwise(F.size("_lines") - F.size("_kept")).cast("long").alias("n_dropped"),
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", "text")


SQL = r"""
WITH t AS (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL),
l AS (SELECT text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS no FROM t),
k AS (SELECT *, list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS tokens FROM l),
m AS (SELECT *, len(tokens) || ' ' || array_to_string(list_transform(tokens[1:3], lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END), ' ') AS leaf FROM k WHERE len(tokens) > 0),
shared AS (SELECT * FROM m WHERE leaf IN (SELECT leaf FROM m GROUP BY leaf HAVING count(DISTINCT text) >= 5)),
by_line AS (SELECT leaf, line, any_value(tokens) AS tokens, count(DISTINCT text) AS texts FROM shared GROUP BY leaf, line),
tok AS (SELECT leaf, line, texts, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM by_line),
stays AS (SELECT leaf, pos, token FROM tok GROUP BY leaf, pos, token HAVING sum(texts) >= 5),
made AS (SELECT t.leaf, t.line, avg(CASE WHEN s.token IS NULL THEN 0.0 ELSE 1.0 END) AS share,
    string_agg(CASE WHEN s.token IS NULL THEN '<*>' ELSE t.token END, ' ' ORDER BY t.pos) AS parts
  FROM tok t LEFT JOIN stays s ON s.leaf = t.leaf AND s.pos = t.pos AND s.token = t.token GROUP BY t.leaf, t.line),
told AS (SELECT s.text, s.no, len(s.tokens) AS n, CASE WHEN m.share >= 0.5 THEN 'T' || s.leaf || '/' || m.parts ELSE 'L' || s.line END AS template
  FROM shared s JOIN made m ON m.leaf = s.leaf AND m.line = s.line),
often AS (SELECT template, list(DISTINCT text ORDER BY text) AS block FROM told GROUP BY template HAVING count(DISTINCT text) >= 5),
blocks AS (SELECT template, dense_rank() OVER (ORDER BY block) AS block FROM often),
candidates AS (SELECT b.block, t.text, t.no, t.n FROM told t JOIN blocks b ON b.template = t.template),
totals AS (SELECT text, sum(len(tokens)) AS total FROM k GROUP BY text),
owed AS (SELECT text, block, sum(n) AS words, sum(sum(n)) OVER (PARTITION BY text) AS owed FROM candidates GROUP BY text, block),
recurring AS (SELECT block FROM owed JOIN totals USING (text) WHERE total > owed AND total - owed >= owed - words GROUP BY block HAVING count(*) >= 5),
gone AS (SELECT text, list(DISTINCT no) AS nos FROM candidates WHERE block IN (SELECT block FROM recurring) GROUP BY text),
cut AS (SELECT d.doc_id, d.text, g.nos, string_split(d.text, chr(10)) AS ls FROM documents d LEFT JOIN gone g ON g.text = d.text)
SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE CAST(len(ls) AS BIGINT) END AS n_lines,
  CASE WHEN nos IS NULL THEN 0 ELSE CAST(len(nos) AS BIGINT) END AS n_dropped,
  CASE WHEN nos IS NULL THEN text ELSE array_to_string(list_filter(ls, lambda x, i: NOT list_contains(nos, i - 1)), chr(10)) END AS text FROM cut
"""
