"""Language identification of pages by Bayesian fusion of evidence.

Four sources speak on each page: its text (likelihoods of byte trigrams, learned from labelled documents), the language its
markup declares, the suffix of its address, and what other pages of its host are written in. How far a
declaration or a suffix can be trusted is learned from the pages themselves: grouped counts of each value against the language
the text alone suggests. Host priors are smoothed hierarchically, host into domain into all pages, with the page's own
vote taken out. The sum of logarithms is normalised to posteriors.

Every page is read once; counts are grouped aggregations of (value, language) with pre-aggregation, so a host with a third of all
pages is a few rows. The trigram model knows all languages of the labelled documents, each from its own sample by hashes
of about ``max_train`` documents (all, if it has no more), and grows with the number of languages only.

Defined results: pages without html have no text evidence and rest on the others; a null url is the host ''; without labelled
documents lang is null; repeated rows count each time and get equal results; an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import Scratch, table

GRAMS = 1 << 14
#: The text speaks with the weight of this many trigrams at most, as trigrams are far from independent.
WEIGHT = 60
CLOSING = {"": re.compile(">"), "!--": re.compile("-->")} | {k: re.compile(rf"</{k}\s*>", re.I) for k in ("script", "style", "noscript", "template")}
OPENING = re.compile(r"<(!--|(?:script|style|noscript|template)\b|(?=[A-Za-z/!?]))", re.I)
DECLARED = r"(?is)<html\b[^<>]*?\slang\s*=\s*[\"']?([a-z]+)"


def visible(page: str) -> str:
    """The page without comments, scripts and tags, in one walk.

    A closing mark that was looked for in vain is not looked for again, as it stands nowhere further on either: hostile pages take no longer than others. What is never closed is text
    but for its first character, except that an unclosed comment or script is taken for a tag first.
    """
    out, at, missing = [], 0, set()

    def after(mark: str, start: int) -> int:
        """The end of the next closing mark, or -1."""
        if mark in missing:
            return -1
        found = CLOSING[mark].search(page, start)
        if not found:
            missing.add(mark)
        return found.end() if found else -1

    while opening := OPENING.search(page, at):
        begin, kind = opening.start(), opening[1].lower()
        end = after(kind, opening.end()) if kind else -1
        if end < 0:
            end = after("", opening.end())
        out += page[at:begin], " "
        at = end if end >= 0 else begin + 1
    return "".join((*out, page[at:]))


def gram_counts(text: str) -> np.ndarray:
    """Counts of hashed byte trigrams of the lower-cased text with runs of other than letters made one space."""
    raw = np.frombuffer(re.sub(r"[\W\d_]+", " ", f" {text.lower()} ").encode(), np.uint8).astype(np.uint32)
    if len(raw) < 3:
        return np.zeros(GRAMS, np.int64)
    codes = (raw[:-2] * 65599 + raw[1:-1]) * 65599 + raw[2:]
    return np.bincount((codes * np.uint32(2654435761)) >> np.uint32(18), minlength=GRAMS)


def learn(docs: DataFrame, max_train: int = 4000) -> tuple[list[str], np.ndarray]:
    """The languages and log P(trigram | language) from labelled documents (text, lang)."""
    docs = docs.filter("lang is not null and text is not null")
    sizes = docs.groupBy("lang").agg(F.count("*").alias("size"))
    langs = sorted(r["lang"] for r in sizes.collect())
    place = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 33) / (1 << 31)
    sample = docs.join(F.broadcast(sizes), "lang").filter(place * F.col("size") < max_train)  # a row a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                counts = gram_counts(text)
                total[lang] = total[lang] + counts if lang in total else counts
        for lang, counts in total.items():
            some = np.flatnonzero(counts)
            yield pa.record_batch([pa.array([lang] * len(some)), pa.array(some), pa.array(counts[some])], names=["lang", "gram", "n"])

    counts = sample.select("lang", "text").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    out = np.full((len(langs), GRAMS), 0.5)
    for k, lang in enumerate(langs):
        own = counts[counts["lang"] == lang]
        out[k, own["gram"].to_numpy()] += own["n"].to_numpy()
    return langs, np.log(out / out.sum(1, keepdims=True))


def _evidence(pages: DataFrame, logs: np.ndarray) -> DataFrame:
    """(page_id, url, host, domain, suffix, declared, ll): ll is the text's log-likelihood in each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ll = []
            for page in b.column(6).to_pylist():
                counts = gram_counts(html.unescape(visible(page or "")))
                n = counts.sum()
                some = np.flatnonzero(counts)
                ll.append((logs[:, some] @ counts[some] * (min(1.0, WEIGHT / n) if n else 0.0)).tolist())
            yield pa.record_batch([*b.columns[:6], pa.array(ll, pa.list_(pa.float64()))], names=["page_id", "url", "host", "domain", "suffix", "declared", "ll"])

    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:]*)", 1))
    labels = F.split("host", r"\.")
    named = pages.select("page_id", "url", host.alias("host"), "html", F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), DECLARED, 1)).alias("declared"))
    named = named.select("page_id", "url", "host", F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".").alias("domain"), F.element_at(labels, -1).alias("suffix"), "declared", "html")
    return named.mapInArrow(run, "page_id long, url string, host string, domain string, suffix string, declared string, ll array<double>")


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def identify(pages: DataFrame, langs: list[str], logs: np.ndarray, strength: float = 5.0, scratch: Scratch | None = None) -> DataFrame:
    """Per row of pages: page_id, url, host, suffix, declared, text_lang, lang, posterior."""
    scratch = scratch or Scratch(pages.sparkSession, "language")
    if not langs:
        none = F.lit(None).cast("string")
        return _evidence(pages, np.zeros((1, GRAMS))).select("page_id", "url", "host", "suffix", "declared", none.alias("text_lang"), none.alias("lang"), F.lit(None).cast("double").alias("posterior"))
    names = F.array(*map(F.lit, langs))
    best = F.array_position("ll", F.array_max("ll")).cast("int")  # the first of equals; 1 for pages without text, which have no vote
    told = _evidence(pages, logs).withColumn("votes", F.exists("ll", lambda x: x != 0))
    told = scratch.save(told.withColumn("best", F.when(F.col("votes"), best).otherwise(0)), "evidence")

    def votes(by: str, name: str) -> DataFrame:
        n = [F.sum((F.col("best") == k).cast("double")) for k in range(1, len(langs) + 1)]
        return scratch.save(told.groupBy(by).agg(F.array(*n).alias(f"n_{by}")), name)

    tables = {by: votes(by, by) for by in ("host", "domain", "suffix", "declared")}
    row = tables["declared"].agg(*[F.coalesce(F.sum(F.col("n_declared")[k]), F.lit(0.0)) for k in range(len(langs))], F.count("*")).first()
    total, kinds = [float(x) for x in row[: len(langs)]], row[len(langs)]
    suffixes = tables["suffix"].count()
    everywhere = F.array(*[F.lit((x + 1) / (sum(total) + len(langs))) for x in total])
    df = told
    for by, counts in tables.items():
        df = df.join(counts, by)
    own = F.transform(names, lambda _, k: (F.col("best") == k + 1).cast("double"))
    less = lambda n: F.zip_with(n, "own", lambda a, b: a - b)
    mixed = lambda n, wider: F.zip_with(n, wider, lambda a, p: a + strength * p)
    shares = lambda x: F.transform(x, lambda v: v / _sum(x))
    df = df.withColumn("own", own)
    df = df.withColumns({"d": mixed(less("n_domain"), everywhere), "h": less("n_host")})
    df = df.withColumn("d", shares("d")).withColumn("h", mixed("h", "d")).withColumn("h", shares("h"))
    per_lang = F.array(*map(F.lit, total))
    trust = lambda n, many: F.zip_with(F.zip_with(less(n), "own", lambda a, o: F.struct(a.alias("a"), o.alias("o"))), per_lang, lambda x, t: F.ln((x["a"] + 1) / (t - x["o"] + many)))
    df = df.withColumns({"t_declared": trust("n_declared", max(kinds, 1)), "t_suffix": trust("n_suffix", max(suffixes, 1))})
    logp = F.transform("ll", lambda x, k: x + F.ln(F.get("h", k)) + F.get("t_declared", k) + F.get("t_suffix", k))
    df = df.withColumn("logp", logp).withColumn("top", F.array_max("logp"))
    df = df.withColumn("posterior", 1 / _sum(F.transform("logp", lambda x: F.exp(x - F.col("top")))))
    return df.select(
        "page_id", "url", "host", "suffix", "declared",
        F.when(F.col("best") > 0, F.get(names, F.col("best") - 1)).alias("text_lang"),
        F.get(names, (F.array_position("logp", F.col("top")) - 1).cast("int")).alias("lang"),
        "posterior",
    )


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    langs, logs = learn(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return identify(table(spark, sf_dir, "pages"), langs, logs)
