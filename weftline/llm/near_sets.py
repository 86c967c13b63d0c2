"""Near copies by exact Jaccard similarity of word shingles: SetSketch bands, likelihood estimates, verification.

Two texts are near copies if their sets of distinct word shingles have a Jaccard similarity of 0.8 or more (9 * intersection
>= 4 * sum of sizes). Candidates share one of 36 bands of 7 SetSketch registers; a pair at 0.8 shares none with
probability 6e-5, a more similar pair with less. Pairs of a small bucket (texts with an equal band) are estimated by the likelihood of
their registers, those below 0.65 go (0.8 lies six deviations above), the rest are compared as full sets.

Buckets of more than ``SMALL`` texts lose nothing and never meet pair by pair. Each has a leader, the text that is in most large
buckets, and buckets of one leader are one family. Every text x of it is taken as its difference D(x) from the leader, which tells its
similarity to the leader exactly. Let e(x) = |D(x)| - |x| / 9. Texts x and y are near copies just if |D(x) & D(y)| >= (e(x) + e(y)) / 2.
So texts linked to the leader need no further link among each other, and each other text x shares at least (e(x) + least e) / 2
elements of its difference with any near copy y. The elements of a difference have one order in a family: what the leader lacks comes
first, as few others have it, then what the text lacks. Two near copies share one among their first |D| - t + 1, where t is the
least number to be shared, so only those are joined, by place (position filter), size, and a 256-bit parity map of the difference, whose bits in dispute two sets cannot outdo. A family's map of
the first elements of its open texts (those not linked to the leader) tells the other texts which of theirs nobody can share, so only the rest are dealt out. A passage that a third of all texts share is in no difference.

Sets are told by a 64-bit hash and compared by 64-bit hashes of their shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm import setsketch as ss
from weftline.llm.common import Scratch
from weftline.llm.components import components

#: Texts of a bucket that meet pair by pair.
SMALL = 32
#: Least estimated similarity of a candidate.
LEAST = 0.65
#: Texts of a family that get one copy of their leader.
SHARE = 512
#: 64-bit words of the map of elements that a family's open texts have among their first.
WORDS = 1024


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, txt, n, id, regs) per row of docs: hash of the text, size, hash and registers of its set; id is null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [ss.shingles(x.as_py(), words) for x in b.column(2)]
            ids = [xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None for s in sets]
            regs = [ss.registers(s).tobytes() if len(s) else None for s in sets]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(list(map(len, sets)), pa.int64()), pa.array(ids, pa.int64()), pa.array(regs, pa.binary())], names=["doc_id", "txt", "n", "id", "regs"])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("txt"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, txt long, n long, id long, regs binary")


def _sets(texts: DataFrame, words: int) -> DataFrame:
    """(id, own) of (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [ss.shingles(x.as_py(), words).view(np.int64) for x in b.column(1)]
            yield pa.record_batch([b.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["id", "own"])

    return texts.select("id", F.col("text").cast("binary").alias("text")).mapInArrow(run, "id long, own array<long>")


def _likely(pairs: DataFrame) -> DataFrame:
    """Of (u, n_u, a, v, n_v, b), with registers a and b, the (u, v) whose estimated similarity is not below LEAST."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if rows.num_rows:
                at = {c: rows.column(c) for c in rows.schema.names}
                a, b = (np.frombuffer(b"".join(at[c].to_pylist()), np.uint8).reshape(-1, ss.M) for c in "ab")
                j = ss.jaccard(a, b, *(at[c].to_numpy().astype(float) for c in ("n_u", "n_v")))
                yield rows.select(["u", "v"]).filter(pa.array(j >= LEAST))

    return pairs.mapInArrow(run, "u long, v long")


def _alike_sizes(a: str, b: str) -> Column:
    return F.expr(f"5 * least({a}, {b}) >= 4 * greatest({a}, {b})")


def links(signed: DataFrame, docs: DataFrame, words: int, scratch: Scratch, more: DataFrame | None = None) -> DataFrame:
    """(u, v): links between set ids whose components are those of all near copies found.

    signed: ``sketches`` of docs. more: pairs (u, v) of text hashes to be compared besides.
    """
    sets = signed.filter("id is not null").groupBy("id").agg(F.min("n").alias("n"), F.min("regs").alias("regs"), F.min("txt").alias("txt"))
    sets = scratch.save(sets, "sets")
    bands = F.transform(F.sequence(F.lit(0), F.lit(ss.BANDS - 1)), lambda j: F.xxhash64(j, F.substring("regs", j * ss.ROWS + 1, F.lit(ss.ROWS))))
    rows = scratch.save(sets.select("id", "n", F.explode(bands).alias("key")), "rows")
    sizes = scratch.save(rows.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"), "sizes")
    rows = scratch.save(rows.join(sizes, "key"), "shared")
    few = rows.filter(F.col("size") <= SMALL)
    left, right = (few.select("key", F.col("id").alias(x), F.col("n").alias(f"n_{x}")) for x in "uv")
    pairs = left.join(right, "key").filter("u < v").filter(_alike_sizes("n_u", "n_v")).select("u", "v")
    pairs = scratch.save(pairs.distinct(), "pairs")
    side = lambda x, regs: sets.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("regs").alias(regs))
    likely = scratch.save(_likely(pairs.join(side("u", "a"), "u").join(side("v", "b"), "v")), "likely")
    if more is not None:
        for x in "uv":
            of = signed.filter("id is not null").groupBy("txt").agg(F.min("id").alias(f"id_{x}"))
            more = more.join(of.withColumnRenamed("txt", x), x)
        more = more.select(F.least("id_u", "id_v").alias("u"), F.greatest("id_u", "id_v").alias("v")).filter("u <> v")
        likely = scratch.save(likely.unionByName(more).distinct(), "likely-more")
    many = scratch.save(rows.filter(F.col("size") > SMALL).select("key", "id"), "many")
    scratch.drop("rows", "shared", "pairs")

    some = scratch.save(likely.select(F.col("u").alias("id")).union(likely.select("v")).union(many.select("id")).distinct(), "some")
    need = sets.join(some, "id", "left_semi").select("id", "txt")
    texts = docs.select(F.xxhash64("text").alias("txt"), "text").join(need.hint("merge"), "txt").groupBy("id").agg(F.min("text").alias("text"))
    own = scratch.save(_sets(texts, words), "own")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        both = pairs.join(own.select(F.col("id").alias("u"), F.col("own").alias("a")), "u").join(own.select(F.col("id").alias("v"), F.col("own").alias("b")), "v")
        return scratch.save(both.filter("9L * size(array_intersect(a, b)) >= 4L * (size(a) + size(b))").select("u", "v"), name)

    small = verified(likely, "verified")
    if many.isEmpty():
        return small
    to_leaders, others = _families(many, own, scratch)
    return small.unionByName(to_leaders).unionByName(verified(others, "verified-others"))


def _word(el: Column) -> Column:
    return F.shiftright(el, 20).bitwiseAND(WORDS - 1).cast("int")


def _bit(el: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(el, 32).bitwiseAND(63).cast("int"))


def _families(many: DataFrame, own: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Links of the texts in large buckets (key, id) to their leaders, and the pairs of others that may be near copies."""
    central = many.join(many.groupBy("id").agg(F.count("*").alias("c")), "id")
    lead = central.groupBy("key").agg(F.max(F.struct("c", "id"))["id"].alias("leader"))
    family = scratch.save(many.join(lead, "key").filter("id <> leader").select("leader", "id").distinct(), "family")
    copies = F.ceil(F.count("*") / SHARE).cast("int").alias("copies")
    sizes = scratch.save(family.groupBy("leader").agg(copies), "families")
    leads = sizes.join(own.select(F.col("id").alias("leader"), F.col("own").alias("lead")), "leader")
    leads = leads.select("leader", "lead", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    dealt = family.join(sizes, "leader").select("leader", "id", F.pmod(F.xxhash64("id"), "copies").cast("int").alias("copy"))
    met = dealt.join(own, "id").join(leads, ["leader", "copy"])
    met = met.select("leader", "copy", "id", F.size("own").cast("long").alias("n"), F.size("lead").alias("n_lead"), F.concat(F.array_sort(F.array_except("own", "lead")), F.array_sort(F.array_except("lead", "own"))).alias("d"))
    of = lambda k: F.aggregate(F.filter("d", lambda x: F.shiftright(x, 6).bitwiseAND(3) == k), F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(63).cast("int"))))
    met = met.withColumn("parity", F.array(*map(of, range(4))))
    met = met.withColumn("e", 9 * F.size("d").cast("long") - F.col("n"))  # nine times e(x)
    met = scratch.save(met.withColumn("open", F.col("e") > F.col("n_lead")), "differences")
    to_leaders = met.filter("not open").select(F.col("leader").alias("u"), F.col("id").alias("v"))

    least = met.groupBy("leader").agg(F.min("e").alias("least"), F.min(F.when(F.col("open"), F.col("e"))).alias("least_open"))
    placed = met.join(least.filter("least_open is not null"), "leader").withColumn("size", F.size("d"))
    placed = scratch.save(placed, "placed")

    def prefix(rows: DataFrame, least: str, x: str, held: Column | None = None) -> DataFrame:
        t = F.expr(f"greatest(1, cast(ceil((e + {least}) / 18) as int), size - cast(floor(n / 4) as int))")
        rows = rows.withColumn("first", F.slice("d", 1, F.greatest(F.lit(0), F.col("size") - t + 1)))
        first = F.transform("first", lambda el, at: F.struct(at.alias("at"), el.alias("el")))
        if held is not None:  # only what an open text may have among its first
            first = F.filter(first, lambda p: F.get(held, _word(p["el"])).bitwiseAND(_bit(p["el"])) != 0)
        return rows.select("leader", F.col("id").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "e", "size", "parity")], F.inline(first)).withColumnRenamed("at", f"at_{x}")

    one = scratch.save(prefix(placed.filter("open"), "least", "u"), "prefixes")
    words = one.groupBy("leader", _word(F.col("el")).alias("word")).agg(F.bit_or(_bit(F.col("el"))).alias("bits"))
    words = words.groupBy("leader").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("words"))  # WORDS entries at most
    held = F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), lambda k: F.coalesce(F.try_element_at("words", k), F.lit(0).cast("long")))
    maps = words.join(sizes, "leader").select("leader", held.alias("held"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    other = prefix(placed.join(maps, ["leader", "copy"]), "least_open", "v", F.col("held"))
    shared = one.join(other, ["leader", "el"]).filter("u <> v").filter(_alike_sizes("n_u", "n_v"))
    shared = shared.filter("9 * (" + " + ".join(f"bit_count(parity_u[{k}] ^ parity_v[{k}])" for k in range(4)) + ") <= n_u + n_v")
    shared = shared.filter("18 * least(size_u - at_u, size_v - at_v) >= e_u + e_v")  # places count from 0
    pairs = scratch.save(shared.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "others")
    return to_leaders, pairs


def roots(signed: DataFrame, docs: DataFrame, words: int, scratch: Scratch, more: DataFrame | None = None) -> DataFrame:
    """(id, root): of every set that has near copies the smallest id of its component."""
    found = links(signed, docs, words, scratch, more)
    return components(found, Scratch(docs.sparkSession, "components")).withColumnRenamed("node", "id")
