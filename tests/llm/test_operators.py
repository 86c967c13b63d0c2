"""What the operators do beyond their queries."""

import re
import time

import brute
import hypothesis
import numpy as np
import pytest
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.llm import brown_lm, decontaminate, html_extract, language_id, line_dedup, packing, quality_rules, simhash, substring_dedup, windows
from weftline.llm.common import Scratch
from weftline.llm.substring_dedup import FingerprintIndex, key


def test_index_takes_batches(spark):
    p = " ".join(f"w{k}" for k in range(160))
    rows = [(1, f"a {p} b"), (2, "nothing here " * 3), (3, f"c {p}"), (4, f"a {p} b"), (5, f"c {p}")]
    make = lambda *ids: spark.createDataFrame([r for r in rows if r[0] in ids], "doc_id long, text string").withColumn("key", key())
    name = {r["key"]: r["doc_id"] for r in make(1, 2, 3, 4, 5).collect()}
    ids = lambda df: {name[r["key"]] for r in df.collect()}
    index = FingerprintIndex(Scratch(spark, "t"), make(1, 2, 3, 4, 5), fan_in=2)
    assert index.add(make(1)).count() == 0
    assert index.add(make(2)).count() == 0 and len(index.runs) == 1 and index.merges == 1
    inner = ids(index.add(make(3)))  # blocks inside the passage are equal; those at its ends are in doubt until compaction
    assert inner == {1, 3} and index.merges == 2
    words = lambda df: {d: {w for r in df.collect() if name[r["key"]] == d for w in range(r["a"], r["a"] + r["n"] - 1 + 35)} for d in (1, 3)}
    assert words(index.spans()) == {1: set(range(1, 161)), 3: set(range(1, 161))}
    assert ids(index.add(make(4, 5))) == {1, 3, 4, 5}
    covers = words(index.spans())
    assert covers == {1: set(range(162)), 3: set(range(161))}


def test_runs_are_merge_joined_where_they_lie(spark):
    rows = spark.createDataFrame([(k, " ".join(f"w{j}" for j in range(k, k + 80))) for k in range(0, 400, 20)], "doc_id long, text string")
    index = FingerprintIndex(Scratch(spark, "t"), rows, fan_in=9)
    for k in range(3):
        index.add(rows.filter(F.col("doc_id") % 60 == 20 * k))
    plan = index._met(index.runs.pop())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and "Exchange" not in plan


@pytest.mark.parametrize("batches, fan_in", [(1, 4), (3, 2), (5, 4)])
def test_batches_and_compactions_do_not_change_the_result(spark, docs, batches, fan_in):
    want = sorted(map(tuple, substring_dedup.deduplicate(docs).collect()), key=repr)
    assert sorted(map(tuple, substring_dedup.deduplicate(docs, batches=batches, fan_in=fan_in).collect()), key=repr) == want


def test_every_window_has_one_block():
    rng = np.random.default_rng(0)
    for symbols, w in ((rng.integers(0, 3, 500).astype(np.uint64), windows.Windows(35, 8, windows.word_symbols)), (rng.integers(97, 100, 2000).astype(np.uint8), windows.Windows(400, 200, windows.byte_symbols))):
        p, a, n, _, _ = w.blocks_of(symbols)
        assert a[0] == 0 and (a[1:] == a[:-1] + n[:-1]).all() and a[-1] + n[-1] == len(symbols) - w.width + 1
        assert (p >= a + n - 1).all() and (p <= a + w.width - w.gram).all()


def test_trie_equals_all_pairs():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    for _ in range(4):
        x = np.unique(np.concatenate((x, x ^ (np.uint64(1) << rng.integers(0, 64, len(x)).astype(np.uint64)))))
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= 3
    assert (simhash.trie_links(x, np.zeros(len(x), int), 0) == simhash.roots_of(len(x), *np.nonzero(near))).all()


def test_large_subtrees_are_dealt_out_again(spark):
    rng = np.random.default_rng(2)
    x = np.unique(rng.integers(0, 1 << 20, 300, dtype=np.uint64))
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= 3
    want = simhash.roots_of(len(x), *np.nonzero(near))
    df = spark.createDataFrame([(int(v),) for v in x], "fp long")
    for above in (1 << 16, 16):
        links = simhash.links(df, Scratch(spark, "t"), above).collect()
        at = {int(v): k for k, v in enumerate(x)}
        i, j = (np.array([at[r[c]] for r in links]) for c in "uv")
        assert (simhash.roots_of(len(x), i, j) == want).all()


def test_decontamination_cuts_spans(spark, docs, docs_dir):
    items = spark.read.parquet(f"{docs_dir[0]}/benchmark.parquet")
    cut = decontaminate.decontaminate(docs, items, remove="spans")
    assert cut.columns == docs.columns and cut.count() == docs.count()
    assert decontaminate.hits(cut, decontaminate.item_windows(items)).count() == 0
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    judged = brute.contamination({k: t for k, (_, t) in enumerate(rows)}, {r["item_id"]: r["text"] for r in items.collect()})
    clean = [rows[k] for k, (n, hit, _) in judged.items() if not (hit and 20 * hit >= n)]
    left = decontaminate.decontaminate(docs, items)
    assert len(clean) < len(rows) and left.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=repr) == sorted(clean, key=repr)


def test_decontamination_beyond_the_broadcast_bound(spark, docs, docs_dir):
    w = decontaminate.item_windows(spark.read.parquet(f"{docs_dir[0]}/benchmark.parquet"))
    assert sorted(decontaminate.hits(docs, w, broadcast_bytes=0).collect()) == sorted(decontaminate.hits(docs, w).collect())


def test_templates_with_variable_fields_recur(spark):
    w = lambda k, x: "".join(chr(97 + (k * 7 + x * 3 + i * (k + 2)) % 26) for i in range(5))
    rows = [(k, f"{' '.join(w(k, x) for x in range(9))}\nServed in {k} ms by node{k}\n{' '.join(w(k, x) for x in range(9, 20))}") for k in range(8)]
    out = line_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"))
    assert all(r["n_dropped"] == 1 and "Served" not in r["text"] for r in out.collect())
    copies = spark.createDataFrame([(k, rows[0][1]) for k in range(20)], "doc_id long, text string")
    assert all(r["n_dropped"] == 0 for r in line_dedup.deduplicate(copies).collect())


@pytest.mark.parametrize("own", [1, 5, 20, 49, 50, 200])
def test_a_shared_passage_goes_at_any_length_of_the_texts_around_it(spark, own):
    licence = [" ".join(f"l{j}x{k}" for k in "abcdefghij") for j in range(5)]
    rows = [(t, "\n".join([" ".join(f"o{t}q{k}" for k in range(own)), *licence])) for t in range(100)]
    got = line_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["n_dropped"] for r in got} == {5}


def test_near_copies_keep_what_they_share(spark):
    rng = np.random.default_rng(6)
    base = [[f"b{j}x{k}" for k in range(12)] for j in range(14)]
    rows = []
    for t in range(60):
        lines = [list(x) for x in base]
        for j in rng.choice(14, rng.integers(1, 5), replace=False):
            lines[j][rng.integers(0, 12)] = f"new{t}"
        rows.append((t, "\n".join(" ".join(x) for x in lines)))
    assert {r["n_dropped"] for r in line_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {0}


def test_recurring_lines_go_from_short_texts_too(spark):
    own = lambda k, n: " ".join(f"own{chr(97 + k)}{chr(97 + j)}" for j in range(n))
    licence = "This text is free to use, to copy and to change for all."
    rows = [(k, f"{own(k, 30)}\n{licence}\nok") for k in range(6)] + [(6, f"hi\n{licence}")]
    out = {r["doc_id"]: r["text"] for r in line_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {k: own(k, 30) for k in range(6)} | {6: "hi"}


def test_packing_keeps_to_targets(spark):
    rows = [(k, "a" if k % 4 else "b", "word " * 300) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    pieces = packing.pack(docs, weights={"a": 0.5, "b": 0.5}).filter("sequence_id < 20")
    shares = {r["source"]: r["n"] for r in pieces.groupBy("source").agg(F.sum("length").alias("n")).collect()}
    assert abs(shares["a"] / (20 * 2048) - 0.5) < 0.02
    natural = packing.pack(docs)
    for k in (0, 20, 50):
        part = natural.filter(F.col("sequence_id").between(k, k + 9)).groupBy("source").agg(F.sum("length").alias("n"))
        assert abs({r["source"]: r["n"] for r in part.collect()}["b"] / 20480 - 0.25) < 0.03
    few = packing.pack(docs, max_queues=2)
    assert few.agg(F.sum("length")).first()[0] == natural.agg(F.sum("length")).first()[0]


def test_rules_are_learned_and_pruned():
    rng = np.random.default_rng(4)
    rows = []
    for k in range(900):
        row = {f: float(x) for f, x in zip(quality_rules.FEATURES, rng.random(len(quality_rules.FEATURES)))}
        rows.append(row | {"bad": int(row["upper_share"] > 0.7 and row["bang_per_word"] > 0.4), "prune": k % 3 == 0})
    rules = quality_rules.learn(rows).rules
    wrong = sum(any(r.holds(x) for r in rules) != bool(x["bad"]) for x in rows)
    assert wrong < 0.03 * len(rows)
    assert quality_rules.learn([]).rules == [] and quality_rules.learn([x | {"bad": 0} for x in rows]).rules == []


def test_quality_model_separates_given_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rules = quality_rules.fit(docs, labels)
    out = rules.score(docs).join(labels, "doc_id").select("quality", "kept", "rule", *quality_rules.FEATURES).collect()
    good, bad = ([r["kept"] for r in out if r["quality"] == q] for q in (1, 0))
    assert rules.rules and sum(good) > 0.9 * len(good) and sum(bad) < 0.2 * len(bad)
    for r in out:
        assert r["rule"] == next((k for k, rule in enumerate(rules.rules, 1) if rule.holds(r.asDict())), 0)


def test_rules_take_one_text_of_a_repeated_id(spark):
    rows = [(1, f"text number {k} " * 9) for k in range(50)] + [(None, "nobody " * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 0)], "doc_id long, quality int")
    assert quality_rules.fit(docs, labels).rules == []  # a single row to learn from


def test_exchange_finds_two_languages():
    rng = np.random.default_rng(5)
    pairs = np.zeros((21, 21))
    for _ in range(4000):
        side = rng.integers(0, 2)
        a, b = rng.integers(0, 10, 2) + 10 * side
        pairs[a, b] += 1
    own = brown_lm.exchange(pairs, 3)
    assert len(set(own[:10])) == 1 and len(set(own[10:])) == 1 and own[0] != own[10]


def test_a_sweep_equals_plain_exchange():
    rng = np.random.default_rng(6)
    classes, n = 5, 40
    own, text = rng.integers(1, classes, n), rng.integers(0, n, 3000)
    before = np.concatenate(([0], own[text[:-1]]))
    keys, count = np.unique(text * classes + before, return_counts=True)

    def table(c):
        t = np.zeros((classes, classes))
        np.add.at(t, (before, c[text]), 1)
        return t

    def likelihood(c):
        x = lambda v: (v * np.log(np.maximum(v, 1e-12))).sum()
        return x(table(c)) - x(table(c).sum(0))

    h = keys // classes
    words, best, by_row = brown_lm.Sweep(table(own), np.array([12], np.uint64))(h + 10, own[h], keys % classes, count)
    assert (words == np.arange(n) + 10).all() and (by_row == best[h]).all() and (best != own).sum() > n / 3
    for w, k in enumerate(best):
        tried = [likelihood(np.where(np.arange(n) == w, c, own)) if c else -np.inf for c in range(classes)]
        assert k == own[w] if w == 2 else tried[k] >= max(tried) - 1e-3


def test_model_is_a_distribution(spark, docs):
    model = brown_lm.fit(docs.select("text"), Scratch(spark, "t"), classes=8, frequent=50)
    assert np.allclose(model.step.sum(1), 1)
    rows = model.words.collect()
    assert sum(r["c"] for r in rows) == model.tokens
    count = np.bincount([r["cls"] for r in rows], [r["c"] for r in rows], 8)
    assert np.allclose(count + model.unknown, model.within, atol=1e-6)
    base = sum((r["c"] + 1) / (model.tokens + model.types + 1) for r in rows) + 1 / (model.tokens + model.types + 1)
    assert np.isclose(base, 1)


@pytest.mark.parametrize("head", [1 << 18, 40])
def test_scores_equal_plain_ones(spark, docs, head):
    train = docs.filter("doc_id % 3 > 0").select("text")
    model = brown_lm.fit(train, Scratch(spark, "t"), classes=6, frequent=20, head=head, sweeps=2)
    import pyarrow as pa

    names, buckets = {}, {}
    for t in [r["text"] for r in docs.select("text").collect()]:
        tokens = [*brute.WORD.findall(brute.low(t)), None]
        h, bucket, _ = brown_lm.tokens_of(pa.array([(t or "").encode()], pa.binary()), model.buckets)
        names |= dict(zip(tokens, h.tolist()))
        buckets |= dict(zip(tokens, bucket.tolist()))
    by_hash = {r["h"] % (1 << 64): (r["c"], r["cls"]) for r in model.words.collect()}
    words = {t: by_hash[h] for t, h in names.items() if h in by_hash}
    before = lambda t: int(model.before(np.array([names[t]], np.uint64), np.array([buckets[t]]))[0])
    unknown = lambda t: int(model.of_bucket[buckets[t]])
    want = [round(brute.class_score([*brute.WORD.findall(brute.low(r["text"])), None], model, words, before, unknown), 6) for r in docs.collect()]
    got = [round(r["score"], 6) for r in model.score(docs.select("doc_id", "text", F.lit(True).alias("held_out")), Scratch(spark, "t")).collect()]
    assert sorted(got) == pytest.approx(sorted(want), abs=1e-5)


def test_head_is_bounded(spark):
    rows = spark.createDataFrame([(k, c) for k, c in enumerate([5000, 5001, 9, 9, 9, 3, 1, 1])], "h long, c long")
    for most, want in ((8, 8), (7, 6), (5, 5), (4, 2), (2, 2), (1, 0)):
        h, c = brown_lm.head_of(rows, most)
        assert len(h) == want and sorted(c, reverse=True) == [5001, 5000, 9, 9, 9, 3, 1, 1][:want]


def test_unknown_words_are_less_likely_than_known_ones(spark, sf_dir):
    train = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.lit(False).alias("held_out"))
    strange = train.filter("text is not null").withColumn("text", F.regexp_replace("text", r"[^\x20\x09-\x0D]+", "\u00a7$0q"))
    per = lambda docs: model.score(docs, Scratch(spark, "t")).agg(F.sum("score") / F.sum("n_tokens")).first()[0]
    model = brown_lm.fit(train.select("text"), Scratch(spark, "t"))
    assert per(strange) < per(train) - 0.5


def test_texts_are_taken_by_bytes():
    import pyarrow as pa

    texts = pa.array([b"a" * n for n in (10, brown_lm.SLICE_BYTES, 5, 7, 2 * brown_lm.SLICE_BYTES, 1)], pa.large_binary())
    got = list(brown_lm.slices(texts))
    assert [x for k, n in got for x in range(k, k + n)] == list(range(6)) and (4, 1) in got
    assert brown_lm.tokens_of(texts, 16)[2].tolist() == [k for k in range(6) for _ in range(2)]


def test_tokens_of_batches_equal_split():
    import pyarrow as pa

    texts = [b"", b" A b\tC ", b"x", b"\n", "É z".encode(), b"ab" * 50 + b" c"]
    h, bucket, doc = brown_lm.tokens_of(pa.array(texts, pa.binary()).slice(0), 64)
    assert [int((doc == k).sum()) for k in range(len(texts))] == [len(t.split()) + 1 for t in texts]
    again, _, part = brown_lm.tokens_of(pa.array(texts, pa.binary()).slice(1, 2), 64)
    assert (again == h[(doc == 1) | (doc == 2)]).all() and part.tolist() == [0, 0, 0, 0, 1, 1]
    lower, _, _ = brown_lm.tokens_of(pa.array([b"a B c"], pa.binary()), 64)
    assert (lower == h[doc == 1]).all()


PAGE = """<html><head><title>x</title></head><body><header><h1>Site</h1></header><div id="cookie-notice">We use cookies, ok, yes</div><div class="wrap"><h1>Title</h1><div class="content">
<p>First para, with commas, and long enough text to be the main one of the page.</p><p>Second&nbsp;para &lt;b&gt; here<br>line, ok.</p><ul><li>one</li><li>two<li>three</ul><div class="share"><a>tweet</a></div></div>
<div class="sidebar"><p>Links, and, more, commas, and, things</p></div><section id="comments"><p>I think, that, it, is, good, very, good, and, so, on.</p></section></div><form><p>subscribe, now</p></form></body>"""


def test_extraction_scores_containers():
    assert html_extract.main_text(PAGE).split("\n") == ["Title", "First para, with commas, and long enough text to be the main one of the page.", "Second para <b> here line, ok.", "one", "two", "three"]
    assert html_extract.main_text("") == html_extract.main_text(None) == html_extract.main_text("<script>a</script>") == ""
    assert html_extract.main_text("<p>" * 3000 + "deep, text") == "deep, text"


@pytest.mark.parametrize(
    "page, text",
    [
        ("<div>" * 20000 + "deep, text", "deep, text"),
        ("<ul>" + "<div>" * 20000 + "<li>x</li>" * 20000, None),
        ("<div>" * 20000 + "end</p>" * 20000, None),
        ("<div class=ad>y" * 20000, None),
        ('<a "' * 20000, '<a "' * 20000),
        ("<a title=\"" * 20001 + "'>", None),
        ("<b hidden>" + "<i>" * 20000 + "</u>" * 20000 + "</b>seen, text", "seen, text"),
        ("<!" * 20000 + "<a" * 20000 + "&amp" * 20000, None),
        ("<p>one, text</p><!-- " + "<p>" * 20000, "one, text"),
        ("<p title='a > b'>one, text <br/>more</p><p class=x\">two</p>", "one, text more\ntwo"),
    ],
)
def test_extraction_takes_time_by_length(page, text):
    import time

    began = time.process_time()
    got = html_extract.main_text(page)
    assert time.process_time() - began < 3
    assert text is None or got == " ".join(text.split(" ")) or got.split("\n") == text.split("\n")


@pytest.fixture(scope="module")
def both_tokenizers():
    import public_tokenizers
    from tokenizers import Tokenizer

    return packing._encoder("byte_bpe_50k"), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


SAMPLES = ["", "a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>x", " <|endoftext", "it's WE'LL 123 4567\n\n \t x", "\u00e9\u0301 \u3042\u3044 \U0001f600\U0001f1e9\U0001f1ea", "\x00\x1f\x7f\x85\xa0\u2028", "a" * 5000]


@pytest.mark.parametrize("text", SAMPLES)
def test_ids_are_those_of_tokenizers(both_tokenizers, text):
    encode, plain = both_tokenizers
    assert encode(text) == plain.encode(text, add_special_tokens=False).ids


@hypothesis.settings(max_examples=300, deadline=None)
@hypothesis.given(st.lists(st.one_of(st.text(max_size=12), st.sampled_from(SAMPLES[1:8])), max_size=6).map("".join))
def test_ids_of_any_text(both_tokenizers, text):
    encode, plain = both_tokenizers
    assert encode(text) == plain.encode(text, add_special_tokens=False).ids


def test_language_of_held_out_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    langs, logs = language_id.learn(docs.filter("doc_id % 2 = 0"))
    pages = docs.filter("doc_id % 2 = 1 and n_chars > 60").select(F.col("doc_id").alias("page_id"), F.lit("http://h.example.org/x").alias("url"), F.concat(F.lit("<p>"), "text").alias("html"), "lang")
    got = language_id.identify(pages, langs, logs).join(pages.select("page_id", F.col("lang").alias("true")), "page_id").collect()
    assert sum(r["lang"] == r["true"] for r in got) > 0.95 * len(got)


def test_declarations_and_hosts_decide_where_text_is_silent(spark):
    logs = np.log(np.full((2, language_id.GRAMS), 1.0 / language_id.GRAMS))
    known = "der die das und ist nicht "
    counts = language_id.gram_counts(known) + 0.5
    logs[1] = np.log(counts / counts.sum())
    rows = [(k, f"http://de.example.de/{k}", f'<html lang="de"><p>{known}') for k in range(30)] + [(99, "http://de.example.de/x", '<html lang="de"></html>')]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in language_id.identify(pages, ["en", "xde"], logs).collect()}
    assert got[99]["text_lang"] is None and got[99]["lang"] == "xde"


#: The markup of well-formed pages by one pattern.
MARKUP = re.compile(r"<!--.*?-->|<(script|style|noscript|template)\b.*?</\1\s*>|<[^>]*>", re.S | re.I)


def test_visible_text_of_pages(spark, sf_dir):
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("html").collect():
        assert language_id.visible(r["html"] or "") == MARKUP.sub(" ", r["html"] or "")
    assert language_id.visible("a<b>c<!-- > -->d<SCRIPT>1<2</Script >e<style>f<!-- g") == "a c d e f !-- g"
    assert language_id.visible("1 < 2") == "1 < 2" and language_id.visible("") == ""


@pytest.mark.parametrize("part", ["<!--", "<script ", "<a ", "</style ", "<html ", "<html lang", "<"])
def test_hostile_pages_take_no_longer(spark, part):
    page, began = part * (1_000_000 // len(part)), time.time()
    language_id.visible(page)
    df = spark.createDataFrame([(1, "http://a.b/", page)], "page_id long, url string, html string")
    assert language_id.identify(df, ["de", "en"], np.zeros((2, language_id.GRAMS))).count() == 1
    assert time.time() - began < 30


def test_languages_equal_plain_sums(spark, sf_dir):
    import html

    langs, logs = language_id.learn(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").union(spark.createDataFrame([(-1, None, None), (-2, "HTTP://u@A.example.org:80/x?y", "<html lang='DE-at'>"), (-2, "x", "")], "page_id long, url string, html string"))
    got = language_id.identify(pages, langs, logs).collect()
    rows = [(r["html"], r["host"], ".".join(r["host"].split(".")[-2:]), r["host"].split(".")[-1], r["declared"]) for r in got_with_html(pages, got)]
    counts = lambda page: {int(g): int(c) for g, c in enumerate(language_id.gram_counts(html.unescape(MARKUP.sub(" ", page or "")))) if c}
    want = brute.languages(rows, langs, logs, counts)
    odd = {r["page_id"]: (r["host"], r["suffix"], r["declared"]) for r in got if r["page_id"] < 0 and r["url"] != "x"}
    assert odd == {-1: ("", "", ""), -2: ("a.example.org", "org", "de")}
    for r, (text_lang, lang, posterior) in zip(got, want):
        assert (r["text_lang"], r["lang"]) == (text_lang, lang) and r["posterior"] == pytest.approx(posterior, abs=1e-6)


def got_with_html(pages, got):
    """Rows of a result with the html of their page; pages share no (page_id, url)."""
    page = {(r["page_id"], r["url"]): r["html"] for r in pages.collect()}
    return [r.asDict() | {"html": page[r["page_id"], r["url"]]} for r in got]


def hash_of(spark, text):
    return spark.range(1).select(F.xxhash64(F.lit(text))).first()[0]


@pytest.mark.parametrize("which", [0, 1])
def test_pipeline(spark, docs_dir, which):
    import corpus_pipeline

    folder = docs_dir[which]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, out = out, Scratch(spark, "t").save(stage(spark, out, folder), name)
        assert out.columns == docs.columns
        assert {r["doc_id"] for r in out.select("doc_id").collect()} <= {r["doc_id"] for r in before.select("doc_id").collect()}
        if name == "simhash_dedup":
            rows = sorted(((r["doc_id"], r["text"]) for r in before.collect()), key=lambda r: (r[0], hash_of(spark, r[1])))
            want = [rows[k] for k, g in enumerate(brute.near_groups([t for _, t in rows])) if k == g]
            assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr) == sorted(want, key=repr)
        if name == "decontamination":
            items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()}
            plain = lambda t: brute.contamination({0: t}, items)[0]
            dirty = [t for t in {r["text"] for r in before.collect()} if (p := plain(t))[1] and 20 * p[1] >= p[0]]
            assert sorted((r["text"] or "" for r in out.collect())) == sorted(r["text"] or "" for r in before.collect() if r["text"] not in dirty)
        if name == "quality_rules":
            assert not any(brute.quality(r["text"])[5] for r in out.collect())
    pieces = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in out.collect()}
