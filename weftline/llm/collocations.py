"""Phrase collocations per language, counted in quotient filters.

1. Texts are cut into pieces and words once, in chunks of about 8 MB: a chunk of one language keeps its distinct words with their counts and
   the text as numbers of them.
2. Words that come ``least`` times or more in their language get dense ids; a rarer one can be in no phrase that does. Ids
   meet chunks by joins on a chunk's distinct words, so no dictionary is ever whole anywhere.
3. Two- and three-word phrases are packed from ids and added up in counting quotient filters (``quotient_filter``): each task sends one
   compact filter a shard, and the sorted filters of a shard are merged. Keys are mixed, so shards are even whatever the words.
4. Phrases with ``least`` occurrences or more are candidates; scores, the phrases that contain others, and the best of each language are
   joins and windows over candidates alone.

Defined results: a null text is empty, a null lang is ``und`` (together with a lang of that name); rows are counted as often as they come,
whatever their doc_id; phrases do not cross pieces; languages without candidates have no rows; an empty table gives none; further columns
are ignored. Sums and products are exact: 1000000 * a * a in 38 decimal digits, for counts up to 10^15.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm import quotient_filter as qf
from weftline.llm.common import Scratch, table
from weftline.operators.dictionary import numbered

#: Bytes of text in a chunk, keys that a task holds before it sends filters, and entries of a shard.
CHUNK, HELD, SHARD = 8 << 20, 1 << 22, 1 << 20
#: Ends of pieces, and white space inside them (fixed values of the contract).
ENDS, BLANK = b".,;:!?\x0a\x0b\x0c\x0d", b"\x09"
_TABLE = bytes(10 if c in ENDS else 32 if c in BLANK else c + 32 if 65 <= c <= 90 else c for c in range(256))


class _Words(dict):
    """Numbers of words in the order of their coming; 0 is nothing, 1 the end of a piece."""

    def __init__(self):
        super().__init__({b"": 0, b"\n": 1})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def chunks(docs: DataFrame) -> DataFrame:
    """(chunk, lang, n, words, counts, codes): codes are 32-bit numbers: 1 for the end of a piece, 2 + k for the chunk's k-th word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, made = TaskContext.get().partitionId(), {}, 0

        def out(lang: str) -> pa.RecordBatch:
            nonlocal made
            words, codes, _ = held.pop(lang)
            codes, made = np.concatenate(codes), made + 1
            counts = np.bincount(codes, minlength=len(words))[2:]
            row = [[f"{part}-{made}"], [lang], [int(counts.sum())], [list(words)[2:]], [counts.tolist()], [codes.astype("<i4").tobytes()]]
            kinds = pa.string(), pa.string(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.binary()
            return pa.record_batch([pa.array(x, t) for x, t in zip(row, kinds)], names=["chunk", "lang", "n", "words", "counts", "codes"])

        for b in batches:
            for lang, text in zip(b.column(0), b.column(1)):
                lang, text = lang.as_py(), text.as_py()
                words, codes, size = held.get(lang, (_Words(), [], 0))
                of = np.array(list(map(words.__getitem__, text.translate(_TABLE).replace(b"\n", b" \n ").split(b" "))), np.int32)
                codes.append(np.append(of[of > 0], np.int32(1)))
                held[lang] = words, codes, size + len(text)
                if size + len(text) >= CHUNK:
                    yield out(lang)
                if len(held) > 64 or sum(x[2] for x in held.values()) >= 4 * CHUNK:
                    yield out(max(held, key=lambda k: held[k][2]))
        for lang in list(held):
            yield out(lang)

    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(run, "chunk string, lang string, n long, words array<binary>, counts array<long>, codes binary")


def _layout(vocabulary: int, occurrences: int) -> tuple[int, qf.Layout]:
    """Bits of a word id, of which three make a key, and the layout for so many phrases."""
    bits = max(2, vocabulary.bit_length())
    shard = min(max(0, (2 * occurrences // SHARD).bit_length()), bits)
    return bits, qf.Layout(bits + bits // 2, 3 * bits - bits - bits // 2, shard)


def _pack(bits: int, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Three ids as a left number (the first and the high part of the second) and a right one."""
    low = bits - bits // 2
    return (a << np.uint64(bits // 2)) | (b >> np.uint64(low)), ((b & np.uint64((1 << low) - 1)) << np.uint64(bits)) | c


def _unpack(bits: int, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    low, high = np.uint64(bits - bits // 2), np.uint64(bits // 2)
    b = ((left & np.uint64((1 << (bits // 2)) - 1)) << low) | (right >> np.uint64(bits))
    return left >> high, b, right & np.uint64((1 << bits) - 1)


def _filters(coded: DataFrame, bits: int, layout: qf.Layout) -> DataFrame:
    """(shard, entries, filter) of (codes, at, ids): the word at a chunk's place ``at`` has the id; others have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            left, right, counts = qf.summed(layout, *(np.concatenate(x) for x in zip(*held)))
            held.clear()
            shard = layout.shards(left)
            cuts = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1]))).tolist() if len(shard) else []
            for i, j in zip(cuts, [*cuts[1:], len(shard)]):
                yield pa.record_batch([pa.array([int(shard[i])]), pa.array([j - i]), pa.array([qf.encode(layout, left[i:j], right[i:j], counts[i:j])])], names=["shard", "entries", "filter"])

        for rows in batches:
            for codes, at, ids in zip(*(rows.column(k) for k in range(3))):
                codes, at, ids = np.frombuffer(codes.as_py(), "<i4"), at.values.to_numpy(), ids.values.to_numpy()
                known = np.zeros(max(int(codes.max(initial=1)) + 1, 2), np.uint64)
                known[at + 2] = ids.astype(np.uint64)
                w = known[codes]
                two = (w[:-1] > 0) & (w[1:] > 0)
                three = two[:-1] & two[1:] if len(two) else two
                a, b = w[:-1][two], w[1:][two]
                held.append(layout.permuted(*_pack(bits, a, b, np.zeros_like(a))))
                held.append(layout.permuted(*_pack(bits, w[:-2][three], w[1:-1][three], w[2:][three])))
                if sum(len(x[0]) for x in held) >= HELD:
                    yield from flush()
        if held:
            yield from flush()

    return coded.mapInArrow(run, "shard long, entries long, filter binary")


def _merged(filters: DataFrame, bits: int, layout: qf.Layout, least: int) -> DataFrame:
    """(w1, w2, w3, f) with f of least or more, of filters that lie sorted by shard; w3 is 0 for two words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []

        def out() -> pa.RecordBatch:
            left, right, f = add()
            often = f >= least
            words = _unpack(bits, *layout.restored(left[often], right[often]))
            return pa.record_batch([*(pa.array(w.astype(np.int64)) for w in words), pa.array(f[often])], names=["w1", "w2", "w3", "f"])

        def add() -> tuple[np.ndarray, ...]:
            return qf.summed(layout, *(np.concatenate(x) for x in zip(*parts)))

        for rows in batches:
            for shard, data in zip(rows.column(0).to_pylist(), rows.column(1)):
                if shard != now and parts:
                    yield out()
                    parts = []
                now = shard
                parts.append(qf.decode(layout, shard, data.as_py()))
                if sum(len(x[0]) for x in parts) >= HELD:
                    parts = [add()]
        if parts:
            yield out()

    dealt = filters.select("shard", "filter").repartition("shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(run, "w1 long, w2 long, w3 long, f long")


def phrases(docs: DataFrame, least: int = 10, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(w1, w2, w3, f) of phrases, (id, lang, word, n) of words, both with least occurrences or more, and (lang, total) of all words."""
    scratch = scratch or Scratch(docs.sparkSession, "collocations")
    cut = scratch.save(chunks(docs), "chunks")
    totals = scratch.save(cut.groupBy("lang").agg(F.sum("n").alias("total")), "totals")
    at = cut.select("chunk", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "x")).select("chunk", "lang", "at", "x.words", "x.counts")
    often = at.groupBy("lang", "words").agg(F.sum("counts").alias("n")).filter(F.col("n") >= least)
    words = scratch.save(numbered(scratch.save(often, "often"), "lang", "words", name="id").withColumn("id", F.col("id") + 1), "words")
    known = at.select("chunk", "lang", "at", "words").join(words.select("lang", "words", "id"), ["lang", "words"])
    known = known.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("at", "id"))).alias("known"))
    coded = cut.select("chunk", "codes").join(known, "chunk").select("codes", F.col("known.at").cast("array<long>").alias("at"), F.col("known.id").alias("ids"))
    vocabulary, occurrences = words.count(), cut.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits, layout = _layout(vocabulary, occurrences)
    filters = scratch.save(_filters(coded, bits, layout), "filters")
    found = scratch.save(_merged(filters, bits, layout, least), "phrases")
    scratch.drop("chunks", "often", "filters")
    return found, words.select("id", "lang", F.col("words").cast("string").alias("word"), "n"), totals


def collocations(docs: DataFrame, least: int = 10, top: int = 2000, inside: int = 50, scratch: Scratch | None = None) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the top phrases of each language; a phrase of which ``inside`` percent lie in a longer one goes."""
    scratch = scratch or Scratch(docs.sparkSession, "collocations")
    found, words, totals = phrases(docs, least, scratch)
    two, three = found.filter("w3 = 0").select("w1", "w2", "f"), found.filter("w3 > 0")
    n = lambda w: words.select(F.col("id").alias(w), F.col("n").alias(f"n_{w}"))
    score = lambda l, r: F.expr(f"(cast(1000000 as decimal(7,0)) * (cast(a as decimal(15,0)) * cast(a as decimal(15,0)))) div (cast({l} as decimal(18,0)) * cast({r} as decimal(18,0)))")
    held = F.greatest(F.max("left"), F.max("right"))
    longer = three.select("w1", "w2", F.col("f").alias("left"), F.lit(0).cast("long").alias("right")).unionByName(three.select(F.col("w2").alias("w1"), F.col("w3").alias("w2"), F.lit(0).cast("long").alias("left"), F.col("f").alias("right")))
    longer = longer.groupBy("w1", "w2").agg(held.alias("longest"))
    pairs = two.join(longer, ["w1", "w2"], "left").filter(F.coalesce(100 * F.col("longest") < inside * F.col("f"), F.lit(True)))
    pairs = pairs.join(n("w1"), "w1").join(n("w2"), "w2").select("w1", "w2", F.lit(0).cast("long").alias("w3"), F.col("f").alias("a"), F.col("n_w1").alias("l"), F.col("n_w2").alias("r"))
    pairs = pairs.withColumn("score", score("l", "r"))
    triples = three.join(two.withColumnRenamed("f", "f12"), ["w1", "w2"]).join(two.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("f").alias("f23")), ["w2", "w3"])
    triples = triples.join(n("w1"), "w1").join(n("w3"), "w3").withColumn("a", F.col("f"))
    triples = triples.withColumn("s1", score("n_w1", "f23")).withColumn("s2", score("f12", "n_w3"))
    first = F.col("s1") <= F.col("s2")
    triples = triples.select("w1", "w2", "w3", "a", F.when(first, F.col("n_w1")).otherwise(F.col("f12")).alias("l"), F.when(first, F.col("f23")).otherwise(F.col("n_w3")).alias("r"), F.least("s1", "s2").alias("score"))
    scored = scratch.save(pairs.unionByName(triples), "scored")
    named = scored
    for w in ("w1", "w2", "w3"):
        own = words.select(F.col("id").alias(w), F.col("word").alias(f"word_{w}"), *(["lang"] if w == "w1" else []))
        named = named.join(own, w, "left")
    named = scratch.save(named.select("lang", F.concat_ws(" ", "word_w1", "word_w2", "word_w3").alias("phrase"), "a", "l", "r", "score"), "named")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    place = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    best = named.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(256))).withColumn("_at", place("lang", "part")).filter(F.col("_at") <= top)
    best = best.withColumn("rank", place("lang").cast("long")).filter(F.col("rank") <= top).join(totals.withColumnRenamed("total", "n"), "lang")
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


SQL = r"""
WITH p AS (SELECT lang, piece, row_number() OVER () AS id FROM (SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
w AS (SELECT lang, id, unnest(w) AS a, generate_subscripts(w, 1) AS spot FROM (SELECT lang, id, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p)),
g AS (SELECT lang, a, lead(a, 1) OVER o AS b, lead(a, 2) OVER o AS c FROM w WINDOW o AS (PARTITION BY id ORDER BY spot)),
f1 AS (SELECT lang, a, count(*) AS f FROM w GROUP BY ALL),
f2 AS (SELECT lang, a, b, count(*) AS f FROM g WHERE b IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT lang, a, b, c, count(*) AS f FROM g WHERE c IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
t AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f1 GROUP BY 1),
cuts AS (SELECT f2.lang, f2.a || ' ' || f2.b AS phrase, f2.f AS a, 1 AS k, l.f AS l, r.f AS r FROM f2 JOIN f1 l ON l.lang = f2.lang AND l.a = f2.a JOIN f1 r ON r.lang = f2.lang AND r.a = f2.b
    WHERE NOT EXISTS (SELECT 1 FROM f3 x WHERE x.lang = f2.lang AND x.a = f2.a AND x.b = f2.b AND 100 * x.f >= 50 * f2.f)
      AND NOT EXISTS (SELECT 1 FROM f3 x WHERE x.lang = f2.lang AND x.b = f2.a AND x.c = f2.b AND 100 * x.f >= 50 * f2.f)
  UNION ALL SELECT f3.lang, f3.a || ' ' || f3.b || ' ' || f3.c, f3.f, 1, l.f, r.f FROM f3 JOIN f1 l ON l.lang = f3.lang AND l.a = f3.a JOIN f2 r ON r.lang = f3.lang AND r.a = f3.b AND r.b = f3.c
  UNION ALL SELECT f3.lang, f3.a || ' ' || f3.b || ' ' || f3.c, f3.f, 2, l.f, r.f FROM f3 JOIN f2 l ON l.lang = f3.lang AND l.a = f3.a AND l.b = f3.b JOIN f1 r ON r.lang = f3.lang AND r.a = f3.c),
scored AS (SELECT *, CAST(1000000::HUGEINT * a * a // (l::HUGEINT * r) AS BIGINT) AS score FROM cuts),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT z.lang, row_number() OVER (PARTITION BY z.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, t.n, score
FROM lowest z JOIN t ON t.lang = z.lang QUALIFY rank <= 2000
"""
