"""No language is left out for being rare, or one of many."""

from pyspark.sql import functions as F

from weftline.llm import language_id


def test_rare_and_many_languages_are_learned(spark):
    word = lambda k: "".join(chr(97 + (k // 26**i) % 26) for i in range(2)) * 3
    rows = [(k, f"hot words here and there {word(k % 600)}", "hot") for k in range(3000)]
    rows += [(10_000 + k, f"{word(k)} {word(k + 300)} " * 9, f"l{k}") for k in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, logs = language_id.learn(docs, max_train=50)
    assert langs == sorted({r[2] for r in rows}) and len(logs) == 81
    pages = docs.filter("doc_id >= 10000").select(F.col("doc_id").alias("page_id"), F.concat(F.lit("http://h"), "doc_id", F.lit(".example/")).alias("url"), F.concat(F.lit("<p>"), "text").alias("html"))
    got = {r["page_id"]: r["text_lang"] for r in language_id.identify(pages, langs, logs).collect()}
    assert got == {r[0]: r[2] for r in rows[3000:]}
