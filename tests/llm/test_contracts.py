"""Each registered query against a plain version, over odd texts and over the small tables."""

import math
import re
import zlib
from collections import Counter, defaultdict

import brute
import duckdb
import numpy as np
import pytest

from weftline.llm import registry

RUN = registry.QUERIES


@pytest.fixture(scope="module", params=["odd", "given"])
def case(request, spark, sf_dir, docs_dir):
    """A folder, and its documents as rows."""
    folder = docs_dir[0] if request.param == "odd" else sf_dir
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    return folder, rows


def result(spark, name, folder):
    return RUN[name](spark, folder).collect()


def test_substring_dedup(spark, case):
    folder, rows = case
    words = [brute.WORD.findall(t or "") for _, t in rows]
    want = Counter((d, len(w), sum(gone), brute.sha(" ".join(x for x, g in zip(w, gone) if not g))) for (d, _), w, gone in zip(rows, words, brute.covered(words, 35)))
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in result(spark, "op2_substring_dedup", folder)) == want


def test_suffix_dedup(spark, case):
    folder, rows = case
    raw = [(t or "").encode() for _, t in rows]
    want = Counter()
    for (d, _), x, gone in zip(rows, raw, brute.covered(raw, 400)):
        want[(d, len(x), sum(gone), len(re.findall("1+", "".join("01"[g] for g in gone))), brute.sha(bytes(b for b, g in zip(x, gone) if not g)))] += 1
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in result(spark, "op6_suffix_dedup", folder)) == want


def test_line_dedup_equals_sql(spark, case):
    folder, _ = case
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet{'/*.parquet' if not folder.startswith('/root') else ''}'")
    want = Counter(con.execute(f"SELECT doc_id, n_lines, n_dropped, text FROM ({registry.SQL['op3_line_dedup']})").fetchall())
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in result(spark, "op3_line_dedup", folder)) == want


def test_simhash(spark, case):
    folder, rows = case
    prints = {k: brute.simhash(t) for k, (_, t) in enumerate(sorted(rows, key=lambda r: r[0]))}
    ids = sorted(d for d, _ in rows)
    own = brute.components(prints)
    want = Counter((d, f"{prints[k]:016x}", ids[own[k]]) for k, d in enumerate(ids))
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in result(spark, "op4_simhash", folder)) == want


def test_decontamination(spark, case):
    folder, rows = case
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()}
    plain = brute.contamination(dict(enumerate(t for _, t in rows)), items)
    want = Counter()
    for k, (d, _) in enumerate(rows):
        n, hit, found = plain[k]
        want[(d, n, hit, len(found), brute.sha(",".join(found)), hit > 0 and 20 * hit >= n)] += 1
    assert Counter(tuple(r) for r in RUN["op5_decontaminate"](spark, folder).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()) == want


def test_packing(spark, case):
    import public_tokenizers
    from tokenizers import Tokenizer

    folder, rows = case
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own = defaultdict(list)  # of a doc_id: the ids of its texts
    for (d, _), e in zip(rows, tok.encode_batch([t or "" for _, t in rows], add_special_tokens=False)):
        own[d].append([*e.ids, 1])
    pieces = result(spark, "op7_packing", folder)
    total = Counter()
    for p in pieces:
        cut = lambda x: zlib.crc32(np.array(x[p["start"] : p["start"] + p["length"]], "<u4").tobytes())  # noqa: E731, B023
        assert 0 < p["length"] and p["offset"] + p["length"] <= 2048
        assert any(p["doc_tokens"] == len(x) and p["ids_crc32"] == cut(x) for x in own[p["doc_id"]])
        total[p["doc_id"], p["doc_tokens"]] += p["length"]
    assert total == sum((Counter({(d, len(x)): len(x)}) for d, texts in own.items() for x in texts), Counter())
    at = {}
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["offset"] == at.get(p["sequence_id"], 0)
        at[p["sequence_id"]] = p["offset"] + p["length"]
    assert sorted(at.values())[1:] == [2048] * (len(at) - 1)


def test_language_model(spark, case):
    folder, rows = case
    tokens = [(d, [*brute.WORD.findall(brute.low(t)), None]) for d, t in rows]
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows}
    c = Counter(w for d, own in tokens if not held[d] for w in own)
    n, v = sum(c.values()), len(c)
    want = Counter((d, held[d], len(own), sum(c[w] > 0 for w in own), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own), 4)) for d, own in tokens)
    got = result(spark, "op8_brown_lm", folder)
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == want
    assert all(r["score"] < 0 for r in got)
    if folder.startswith("/root"):
        out = [r for r in got if r["held_out"]]
        assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)  # 200 documents: little to learn from


def test_language_model_on_more_text(spark):
    """Held-out text is likelier than by the base, although an unknown word has only its own part of what the base gives to all of them."""
    out = [r for r in result(spark, "op8_brown_lm", "/root/testdata/sf0.01") if r["held_out"]]
    assert sum(r["score"] for r in out) > 0.95 * sum(r["base_score"] for r in out)  # both below 0


def test_quality(spark, case):
    folder, rows = case
    want = Counter((d, *brute.quality(t)) for d, t in rows)
    got = result(spark, "op10_quality_rules", folder)
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got) == want
    assert not any(r["kept"] and r["base_failed"] for r in got)


def test_html_of_given_pages(spark, sf_dir):
    import html as entities

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in result(spark, "op9_html_extract", sf_dir):
        article = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        blocks = re.split(r"</?(?:p|h1)>", article.replace("<br>", " "))
        plain = [" ".join(entities.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in blocks]
        assert r["text"] == "\n".join(b for b in plain if b) and r["n_chars"] == len(r["text"])


@pytest.mark.parametrize("name", sorted(RUN))
def test_empty_tables(spark, docs_dir, name):
    assert RUN[name](spark, docs_dir[1]).count() == 0


@pytest.mark.parametrize("name", ["op1_language_id", "op9_html_extract"])
def test_odd_pages(spark, docs_dir, name):
    got = result(spark, name, docs_dir[0])
    assert sorted(r["page_id"] for r in got) == [1, 2, 3, 4, 4]
