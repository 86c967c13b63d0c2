"""Groups of near copies for the pipeline: texts whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more.

Candidates and links are those of ``near_sets``, at which pairs found elsewhere (by SimHash, say) are compared as well.

Defined results: equal texts are one; texts without words are copies of each other; texts of one set of shingles are copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import near_sets
from weftline.llm.common import Scratch

WORDS = 5


def roots(docs: DataFrame, more: DataFrame | None = None, words: int = WORDS, scratch: Scratch | None = None) -> DataFrame:
    """(txt, root): for every text's hash the number of its group. more: pairs (u, v) of text hashes to be compared besides."""
    scratch = scratch or Scratch(docs.sparkSession, "near-copies")
    texts = docs.select(F.lit(None).cast("long").alias("doc_id"), "text")
    signed = scratch.save(near_sets.sketches(texts, words), "signed")
    found = near_sets.roots(signed, texts, words, scratch, more)
    named = signed.groupBy("txt").agg(F.min("id").alias("id")).join(found, "id", "left")
    return named.select("txt", F.coalesce("root", "id", F.xxhash64(F.lit("no words"))).alias("root"))
