"""Scoring texts with a class-based bigram model over Brown classes.

Words and counts. Every word of the training texts is counted by the 64-bit hash of its bytes.

Classes, by exchange clustering. The ``frequent`` most frequent words are exchanged one at a time: a word moves to the class in which the
likelihood of the class bigrams is highest, until no word moves. Every other word begins in the class that suits the words with the same
beginning and ending, its bucket. Then come ``sweeps`` of parallel exchange over all words as a Spark job: the classes of the words before
each word are counted over the whole corpus, and each word moves on its own to the class of the highest likelihood, the words before it
keeping their classes and the class bigrams being those from before the sweep. Frequent words keep their place there.

Model. P(w | before) = share * P(class of w | class of before) * P(w | class) + (1 - share) * base(w). In a class, a known word has its
count, and the unknown ones together that of the class's words found once, dealt evenly to as many unseen words; an unknown word has the class of its
bucket. The word before counts by the class it had when the contexts were gathered. All of it sums to one over known and unseen words. ``score`` is the
logarithm of it, so a text of unknown words scores low.

The counts and classes of words never leave Spark: those of the ``head``, a bounded table of the most frequent words, are looked up where the
texts are read, the others are joined. What goes to the driver is bounded by parameters alone: the head, bigrams of
frequent words, contexts of buckets, bigrams of classes.

Defined results: null and empty texts are the end token alone; a row without doc_id is training text; repeated rows
count each time and score alike; with no training text every word is unknown; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import Scratch, table
from weftline.llm.windows import Rolling, mix

U = np.uint64
END = U(1)
#: Texts that are split and hashed at once, and bytes of them, but for a text that is longer itself.
SLICE, SLICE_BYTES = 500, (1 << 20) - 1
#: Tokens whose counts are gathered before they are handed on.
HELD = 1 << 20
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, bool)
BLANK[[32, *range(9, 14)]] = True
SYMBOL = mix(np.arange(1, 257, dtype=U))


def tokens_of(texts: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, bucket, document) of all tokens of an Arrow array of binary texts, each text's end token last.

    Whole batches at a time: words are found, hashed and put into buckets without a loop over them.
    """
    texts = texts.cast(pa.binary())  # whatever width of offsets Arrow hands over
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
    raw = LOWER[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]]
    offsets = offsets - offsets[0]
    word = ~BLANK[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[offsets[:-1]] = True
    before = np.concatenate(([False], word[:-1])) & ~first[:-1]
    start = np.flatnonzero(word & ~before)
    after = np.concatenate((word[1:], [False])) & ~np.concatenate((first[1:-1], [True])) if len(raw) else word
    stop = np.flatnonzero(word & ~after) + 1
    length = stop - start
    h = Rolling(SYMBOL[raw], 2).ranges(start, length) if len(start) else np.empty(0, U)
    shape = np.zeros(len(start), U)
    for k, at in enumerate((start, np.minimum(start + 1, stop - 1), stop - 1, np.maximum(stop - 2, start), np.maximum(stop - 3, start))):
        shape = shape * U(257) + raw[at].astype(U) + U(k)
    doc = np.searchsorted(offsets, start, side="right") - 1
    counts = np.bincount(doc, minlength=len(texts))[: len(texts)]
    ends = np.cumsum(counts + 1) - 1
    out = np.full(len(start) + len(texts), END, U)
    bucket = np.zeros(len(out), np.int32)
    at = np.arange(len(start)) + doc
    out[at] = np.maximum(h, U(2))
    bucket[at] = (mix(shape) % U(buckets)).astype(np.int32)
    assert len(ends) == 0 or ends[-1] == len(out) - 1
    return out, bucket, np.repeat(np.arange(len(texts)), counts + 1)


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(first, number) of stretches of texts to be taken at once."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    k = 0
    while k < len(texts):
        most = int(np.searchsorted(ends, (ends[k - 1] if k else 0) + SLICE_BYTES, side="right"))
        n = min(max(most - k, 1), SLICE)
        yield k, n
        k += n


@dataclass
class Classes:
    """The class of every word: by its hash if frequent, else by its bucket. The end token has class 0."""

    hashes: np.ndarray  # of frequent words, sorted
    of_hash: np.ndarray
    of_bucket: np.ndarray

    def __call__(self, h: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        at, found = lookup(self.hashes, h)
        out = np.where(found, self.of_hash[at] if len(self.of_hash) else 0, self.of_bucket[bucket])
        out[h == END] = 0
        return out


def lookup(ordered: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(ordered):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(ordered, h), len(ordered) - 1)
    return at, ordered[at] == h


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-12))


def exchange(pairs: np.ndarray, classes: int, sweeps: int = 12) -> np.ndarray:
    """Classes 1.. of words by exchange; pairs[i, j] counts word j after word i, the last word is the end (class 0).

    Words come in order of frequency. Ties go to the lowest class.
    """
    n = len(pairs) - 1
    own = np.concatenate((1 + np.arange(n) % (classes - 1), [0]))
    one = np.zeros((len(pairs), classes))
    one[np.arange(len(pairs)), own] = 1
    to, since = pairs @ one, pairs.T @ one  # contexts of each word by class: after it, before it
    big = one.T @ to
    for _ in range(sweeps):
        moved = 0
        for w in range(n):
            k, loop = own[w], pairs[w, w]
            right, left = to[w].copy(), since[w].copy()
            right[k] -= loop
            left[k] -= loop
            big[k, :] -= right
            big[:, k] -= left
            big[k, k] -= loop
            rows, cols = big.sum(1), big.sum(0)
            gain = (_xlogx(big + right) - _xlogx(big)).sum(1) + (_xlogx(big + left[:, None]) - _xlogx(big)).sum(0)
            d = np.diagonal(big)
            gain += _xlogx(d + right + left + loop) + _xlogx(d) - _xlogx(d + right) - _xlogx(d + left)
            gain -= _xlogx(rows + right.sum() + loop) - _xlogx(rows) + _xlogx(cols + left.sum() + loop) - _xlogx(cols)
            gain[0] = -np.inf
            best = int(np.argmax(gain))
            if gain[best] <= gain[k] + 1e-9:
                best = k
            big[best, :] += right
            big[:, best] += left
            big[best, best] += loop
            if best != k:
                moved += 1
                own[w] = best
                to[:, k] -= pairs[:, w]
                to[:, best] += pairs[:, w]
                since[:, k] -= pairs[w, :]
                since[:, best] += pairs[w, :]
        if not moved:
            break
    return own[:-1]


def _counted(docs: DataFrame, size: int, codes: Callable[..., np.ndarray], buckets: int) -> DataFrame:
    """(code, n): how often codes below size occur; summed in each task before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            for k, n in slices(b.column(0)):
                total += np.bincount(codes(*tokens_of(b.column(0).slice(k, n), buckets)), minlength=size)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], names=["code", "n"])

    return docs.select("text").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def _dense(counted: DataFrame, *shape: int) -> np.ndarray:
    """A table of codes below the product of shape, as an array."""
    out = np.zeros(int(np.prod(shape)))
    got = counted.toArrow()
    out[got.column(0).to_numpy()] = got.column(1).to_numpy()
    return out.reshape(shape)


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2


def head_of(words: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and counts of the most frequent words: all of the counts above a cut that at most ``most`` words pass.

    The cut follows from how many words have each count, counts of over 4,096 in steps of a 64th of a power of two.
    """
    step = F.when(F.col("c") < 4096, F.col("c").cast("double")).otherwise(3328 + F.floor(F.log2("c") * 64))
    kinds = sorted(((r["step"], r["n"]) for r in words.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()), reverse=True)
    cut, taken = float("inf"), 0
    for at, n in kinds:
        if taken + n > most:
            break
        cut, taken = at, taken + n
    got = words.filter(step >= cut).select("h", "c").toArrow()
    hashes, counts = got.column(0).to_numpy().view(U), got.column(1).to_numpy()
    order = np.argsort(hashes)
    return hashes[order], counts[order].astype(float)


class Sweep:
    """One sweep of parallel exchange. big[a, b] counts words of class b after a word of class a.

    The word before counts by the class it had before the sweep. So the likelihood of the words' classes after it,
    sum of xlogx over big less that over its columns, follows from the classes before each word alone.
    """

    MANY, LONG = 8, 256  # counts whose terms are looked up

    def __init__(self, big: np.ndarray, fixed: np.ndarray):
        """fixed: hashes, sorted, of words that stay where they are."""
        self.big, self.fixed, self.classes = big, fixed, len(big)
        self.gain = np.stack([(_xlogx(big + n) - _xlogx(big)).astype(np.float32) for n in range(1, self.MANY + 1)])
        self.sums = big.sum(0)
        self.margin = np.stack([_xlogx(self.sums + n) - _xlogx(self.sums) for n in range(self.LONG + 1)])

    def __call__(self, h: np.ndarray, own: np.ndarray, before: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, class, class by row) for rows (word, its class, class before, count) in order of words."""
        start = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        words, k0, at = h[start], own[start].astype(np.int64), np.arange(len(start))
        row = np.repeat(at, np.diff(np.concatenate((start, [len(h)]))))
        gain = np.zeros((len(start), self.classes))
        for a in range(0, len(h), 1 << 14):
            s = slice(a, a + (1 << 14))
            few = self.gain[np.minimum(n[s], self.MANY) - 1, before[s]].astype(float)
            many = np.flatnonzero(n[s] > self.MANY)
            cells = self.big[before[s][many]]
            few[many] = _xlogx(cells + n[s][many][:, None]) - _xlogx(cells)
            first = np.flatnonzero(np.concatenate(([True], row[s][1:] != row[s][:-1])))
            gain[row[s][first]] += np.add.reduceat(few, first)
        total = np.bincount(row, n, len(start)).astype(np.int64)
        lost = self.margin[np.minimum(total, self.LONG)]
        long = np.flatnonzero(total > self.LONG)
        lost[long] = _xlogx(self.sums + total[long][:, None]) - _xlogx(self.sums)
        gain -= lost
        here, mine = self.big[before, own], self.sums[k0]
        stay = np.bincount(row, _xlogx(here) - _xlogx(np.maximum(here - n, 0)), len(start)) - _xlogx(mine) + _xlogx(np.maximum(mine - total, 0))
        gain[:, 0] = -np.inf
        gain[at, k0] = stay
        best = gain.argmax(1)
        best = np.where(gain[at, best] > stay + 1e-6, best, k0)
        best = np.where(lookup(self.fixed, words.view(U))[1] | (words.view(U) == END), k0, best)
        return words, best, best[row]


@dataclass
class BrownModel:
    before: Classes  # of the word before
    head: np.ndarray  # hashes of the head, sorted
    head_counts: np.ndarray
    head_classes: np.ndarray
    of_bucket: np.ndarray  # class of an unknown word
    step: np.ndarray  # P(class | class before)
    within: np.ndarray  # count of each class, unknown words included
    unknown: np.ndarray  # count set aside for the unknown words of each class
    unseen: np.ndarray  # number of unknown words expected in each class
    words: DataFrame  # (h, c, cls)
    tokens: int
    types: int
    buckets: int
    share: float

    def chances(self, before: np.ndarray, cls: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 of base and model for words of count c and class cls after a class."""
        room = float(self.tokens + self.types + 1)
        base = (c + 1) / room
        known = c > 0
        own = np.where(known, c, self.unknown[cls] / self.unseen[cls])
        rest = np.where(known, base, base / self.unseen.sum())
        return np.log10(base), np.log10(self.share * self.step[before, cls] * own / self.within[cls] + (1 - self.share) * rest)

    def score(self, docs: DataFrame, scratch: Scratch) -> DataFrame:
        """Per row of docs (doc_id, text, held_out): n_tokens, n_known, base_score, score."""
        words, tokens = self.words, self.tokens
        self.words = None  # the tasks need the tables alone
        local = BrownModel(**vars(self))
        self.words = words
        whole = self.types <= len(self.head)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for k, many in slices(b.column(3)):
                    part = b.slice(k, many)
                    h, bucket, doc = tokens_of(part.column(3), local.buckets)
                    before = np.concatenate(([0], local.before(h, bucket)[:-1]))  # a text begins after an end
                    at, found = lookup(local.head, h)
                    cls = np.where(found, local.head_classes[at] if len(local.head) else 0, local.of_bucket[bucket])
                    cls[h == END] = 0
                    sure = found | whole | (h == END)
                    n = np.where(found, local.head_counts[at] if len(local.head) else 0, 0.0)
                    base, p = local.chances(before[sure], cls[sure], n[sure])
                    size = part.num_rows
                    add = lambda x: np.bincount(doc[sure], weights=x, minlength=size)  # noqa: E731, B023
                    row, tail = part.column(0), ~sure
                    none = [pa.nulls(size, t) for t in (pa.int64(), pa.int16(), pa.int16())]
                    yield pa.record_batch(
                        [row, part.column(1), part.column(2), pa.array(np.bincount(doc, minlength=size)), pa.array(add((n[sure] > 0).astype(float)).astype(np.int64)), pa.array(add(base)), pa.array(add(p)), *none],
                        names=NAMES,
                    )
                    size = int(tail.sum())
                    none = [pa.nulls(size, t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]
                    yield pa.record_batch([row.take(pa.array(doc[tail])), *none, pa.array(h[tail].view(np.int64)), pa.array(before[tail].astype(np.int16)), pa.array(cls[tail].astype(np.int16))], names=NAMES)

        def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                row, before, cls, c = (b.column(k).to_numpy(zero_copy_only=False) for k in range(4))
                base, p = local.chances(before.astype(np.int64), cls.astype(np.int64), c.astype(float))
                rows, first = np.unique(row, return_inverse=True)
                add = lambda x: np.bincount(first, weights=x, minlength=len(rows))  # noqa: E731, B023
                yield pa.record_batch([pa.array(rows), pa.array(add((c > 0).astype(float)).astype(np.int64)), pa.array(add(base)), pa.array(add(p))], names=["row", "n_known", "base_score", "score"])

        given = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "held_out", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
        parts = scratch.save(given.mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, h long, before short, cls short"), "scored")
        tail = parts.filter("h is not null").select("row", "h", "before", F.col("cls").alias("other")).join(words.select("h", "c", "cls"), "h", "left")
        tail = tail.select("row", "before", F.coalesce("cls", "other").cast("short").alias("cls"), F.coalesce("c", F.lit(0)).alias("c"))
        tail = tail.mapInArrow(rare, "row long, n_known long, base_score double, score double")
        none = {"doc_id": F.lit(None).cast("long"), "held_out": F.lit(None).cast("boolean"), "n_tokens": F.lit(0).cast("long")}
        per = parts.filter("h is null").drop("h", "before", "cls").unionByName(tail.withColumns(none)).groupBy("row")
        out = per.agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")])
        return out.withColumn("train_tokens", F.lit(tokens).cast("long")).drop("row")


NAMES = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "h", "before", "cls"]


def _contexts(texts: DataFrame, known: Classes, buckets: int, classes: int) -> DataFrame:
    """(h, code, n): how often each word comes after each class; code is the word's own class times classes plus the class before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def counts() -> Iterator[pa.RecordBatch]:
            h, code = map(np.concatenate, zip(*held))
            held.clear()
            words, word = np.unique(h, return_inverse=True)
            pairs, n = np.unique(word * (classes * classes) + code, return_counts=True)
            for k in range(0, len(pairs), 1 << 17):
                part = pairs[k : k + (1 << 17)]
                yield pa.record_batch([pa.array(words[part // (classes * classes)].view(np.int64)), pa.array((part % (classes * classes)).astype(np.int32)), pa.array(n[k : k + (1 << 17)])], names=["h", "code", "n"])

        for b in batches:
            for k, n in slices(b.column(0)):
                h, bucket, _ = tokens_of(b.column(0).slice(k, n), buckets)
                c = known(h, bucket)
                held.append((h, c * classes + np.concatenate(([0], c[:-1]))))
                if sum(len(x[0]) for x in held) > HELD:
                    yield from counts()
        if held:
            yield from counts()

    return texts.mapInArrow(run, "h long, code int, n long").groupBy("h", "code").agg(F.sum("n").alias("n"))


def _swept(contexts: DataFrame, sweep: Sweep) -> DataFrame:
    """(h, cls, code, n): the class of each word, and in rows of their own, by code, how often a class comes after a class before."""
    classes = sweep.classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        big, held = np.zeros(classes * classes), []

        def move(rows: list[np.ndarray]) -> pa.RecordBatch:
            nonlocal big
            h, code, n = rows
            before = code % classes
            words, cls, by_row = sweep(h, code // classes, before, n)
            big += np.bincount(before * classes + by_row, n, classes * classes)
            none = pa.nulls(len(words), pa.int64())
            return pa.record_batch([pa.array(words), pa.array(cls.astype(np.int16)), none, none], names=["h", "cls", "code", "n"])

        for b in batches:
            if b.num_rows:
                held.append([b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)])
                if sum(len(x[0]) for x in held) >= 1 << 15:
                    rows = [np.concatenate(x) for x in zip(*held)]
                    cut = int(np.searchsorted(rows[0], rows[0][-1]))  # the last word may go on in the next batch
                    if cut:
                        yield move([x[:cut] for x in rows])
                    held = [[x[cut:] for x in rows]]
        if held:
            yield move([np.concatenate(x) for x in zip(*held)])
        some = np.flatnonzero(big)
        yield pa.record_batch([pa.nulls(len(some), pa.int64()), pa.nulls(len(some), pa.int16()), pa.array(some), pa.array(big[some].astype(np.int64))], names=["h", "cls", "code", "n"])

    return contexts.repartition("h").sortWithinPartitions("h").mapInArrow(run, "h long, cls short, code long, n long")


def fit(train: DataFrame, scratch: Scratch, classes: int = 128, frequent: int = 1024, buckets: int = 1 << 14, head: int = 1 << 18, sweeps: int = 1, share: float = 0.95) -> BrownModel:
    """Learn from all texts of train (text)."""
    texts = train.select(F.coalesce("text", F.lit("")).cast("binary").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def counts() -> pa.RecordBatch:
            h, bucket = map(np.concatenate, zip(*held))
            held.clear()
            own, at, n = np.unique(h, return_index=True, return_counts=True)
            return pa.record_batch([pa.array(own.view(np.int64)), pa.array(bucket[at]), pa.array(n)], names=["h", "bucket", "c"])

        for b in batches:
            for k, n in slices(b.column(0)):
                held.append(tokens_of(b.column(0).slice(k, n), buckets)[:2])
                if sum(len(x[0]) for x in held) > 2 * HELD:
                    yield counts()
        if held:
            yield counts()

    words = scratch.save(texts.mapInArrow(count, "h long, bucket int, c long").groupBy("h").agg(F.min("bucket").alias("bucket"), F.sum("c").alias("c")), "words")
    tokens, types = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    tops, counts = head_of(words, head)
    inner = tops != END
    order = np.lexsort((tops[inner], -counts[inner]))[:frequent]
    ranked = tops[inner][order]
    by_hash = np.argsort(ranked)
    hashes, place, n = ranked[by_hash], by_hash, len(ranked)

    def pair_codes(h: np.ndarray, bucket: np.ndarray, doc: np.ndarray) -> np.ndarray:
        at, found = lookup(hashes, h)
        word = np.where(h == END, n, np.where(found, place[at] if n else 0, -1))
        before = np.concatenate(([n], word[:-1]))
        both = (word >= 0) & (before >= 0)
        return before[both] * (n + 1) + word[both]

    pairs = _dense(_counted(texts, (n + 1) ** 2, pair_codes, buckets), n + 1, n + 1)
    own = exchange(pairs, classes)
    known = Classes(hashes, own[place] if n else own, np.full(buckets, -1))
    big = np.zeros((classes, classes))
    all_own = np.concatenate((own, [0]))
    np.add.at(big, (all_own[:, None].repeat(n + 1, 1), all_own[None, :].repeat(n + 1, 0)), pairs)

    def bucket_codes(h: np.ndarray, bucket: np.ndarray, doc: np.ndarray) -> np.ndarray:
        c = known(h, bucket)
        before, after = np.concatenate(([0], c[:-1])), np.concatenate((c[1:], [0]))
        left, right = (c < 0) & (before >= 0), (c < 0) & (after >= 0)
        return np.concatenate(((bucket[left].astype(np.int64) * 2) * classes + before[left], (bucket[right].astype(np.int64) * 2 + 1) * classes + after[right]))

    around = _dense(_counted(texts, buckets * 2 * classes, bucket_codes, buckets), buckets, 2, classes)
    smooth = big + 0.5
    rows, cols = np.log(smooth.sum(1)), np.log(smooth.sum(0))
    logs = np.log(smooth)
    fits = around[:, 0] @ (logs - cols[None, :]) + around[:, 1] @ (logs - rows[:, None]).T
    fits[:, 0] = -np.inf
    of_bucket = fits.argmax(1)
    before = Classes(known.hashes, known.of_hash, of_bucket)
    for k in range(sweeps):
        contexts = scratch.save(_contexts(texts, before, buckets, classes), f"contexts{k}")
        pairs = contexts.groupBy("code").agg(F.sum("n").alias("n"))
        swept = scratch.save(_swept(contexts, Sweep(_dense(pairs, classes, classes).T, hashes)), f"swept{k}")
        scratch.drop(f"contexts{k}")
        big = _dense(swept.filter("code is not null").groupBy("code").agg(F.sum("n").alias("n")), classes, classes)
        placed = swept.filter("h is not null").select("h", "cls")
        found = words.join(placed, "h")
        own_words = scratch.save(found.select("h", "bucket", "c", "cls"), f"classes{k}")
        mine = own_words.join(F.broadcast(texts.sparkSession.createDataFrame(pa.table({"h": tops.view(np.int64)}))), "h").select("h", "cls").toArrow()  # head rows at most
        at = np.argsort(mine.column(0).to_numpy().view(U))
        head_classes = mine.column(1).to_numpy().astype(np.int64)[at]
        if k + 1 < sweeps:
            before = Classes(tops, head_classes, of_bucket)
    once = own_words.filter((F.col("c") == 1) & (F.col("h") != int(END))).groupBy("bucket").agg(F.count("*").alias("n"))
    unknown = np.full(classes, 0.5)
    np.add.at(unknown, of_bucket, _dense(once, buckets))
    unseen = unknown + 0.5
    unknown[0], unseen[0] = 0, 1e-9  # the end is always known
    whole = big.sum(0)
    prior = (whole + 0.5) / (whole + 0.5).sum()
    kinds = 3 * np.maximum((big > 0).sum(1, keepdims=True), 1)  # the more different followers, the more for others
    step = (big + kinds * prior) / (big.sum(1, keepdims=True) + kinds)
    return BrownModel(before, tops, counts, head_classes, of_bucket, step, np.maximum(whole + unknown, 1e-9), unknown, unseen, own_words.select("h", "c", "cls"), int(tokens), int(types), buckets, share)


def op8_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", held_out())
    scratch = Scratch(spark, "brown")
    model = fit(docs.filter(~F.col("held_out")), scratch)
    return model.score(docs, scratch).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
