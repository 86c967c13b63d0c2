import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

PASSAGE = " ".join(f"p{k}" for k in range(80))
LONG = " ".join(f"long{k % 5000}x{k // 5000}" for k in range(12_000))

#: Null, empty and blank texts, a very long one, copies, near copies, ties, repeated rows, and passages that texts share.
TEXTS = [
    (1, None), (2, ""), (3, " \n\t\x0b "), (4, LONG), (5, f"start {PASSAGE} end"), (6, f"other {PASSAGE}"), (7, f"start {PASSAGE} end"), (7, f"start {PASSAGE} end"),
    (8, "be " * 200), (9, "One two three.\nOne two three.\nfour"), (10, "é ü ß É x Äpfel Straße " * 8), (11, PASSAGE[:150] + " cut " + PASSAGE[150:]), (12, "x" * 3000), (13, "a"),
    (14, f"{PASSAGE} {PASSAGE}"), (15, "Line seven of 12 apples\nunique words here now"), (16, "tail tail\r\nmixed \x0c white"),
    (5, "no word of this text stands in any other one, " * 2 + " ".join(f"z{k}" for k in range(120))), (4, None), (17, " ".join(f"z{k}x" for k in range(150))), (17, "a <|endoftext|> b<|endoftext|>"),
]


@pytest.fixture(scope="session")
def texts():
    return TEXTS


@pytest.fixture(scope="session")
def docs(spark):
    """The texts as documents, with columns whose names the operators use themselves."""
    rows = [(i, t, "en", f"s{i % 3}" if i != 13 else None, len(t or ""), i, "k", 1.5, True) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words long, key string, h double, kept boolean").repartition(3).cache()


@pytest.fixture(scope="session")
def docs_dir(spark, docs, tmp_path_factory):
    """A folder with documents, benchmark, labels, pages and embeddings; and one where all of them are empty."""
    full, empty = (str(tmp_path_factory.mktemp(x)) for x in ("full", "empty"))
    items = spark.createDataFrame([(1, " ".join(f"P{k}" for k in range(10, 40))), (2, "One TWO"), (3, None), (4, "..."), (5, " ".join(f"p{k}" for k in range(20, 33)))], "item_id long, text string")
    labels = spark.createDataFrame([(4, 1, 0), (5, 1, 0), (8, 0, 0), (10, None, 1), (None, 0, 0), (5, 1, 1)], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame(
        [(1, "http://a.example.de/x", '<html lang="de"><body><p>Der Hund und die Katze</p></body></html>'), (2, None, None), (3, "x", ""), (4, "http://a.example.de", "<p>plain &amp; simple"), (4, "http://a.example.de", "<p>plain &amp; simple")],
        "page_id long, url string, html string",
    )
    vectors = [(k, k % 3, [0.1 * (k % 5), -0.2, 0.3]) for k in range(95, 115)] + [(200, None, [0.1, 0.2, 0.3]), (300, 1, None), (400, 1, [None, 0.2, 0.3]), (500, 1, [float("nan"), 0.2, 0.3]), (None, 1, [0.1, 0.2, 0.3])]
    embeddings = spark.createDataFrame(vectors, "vec_id long, label int, embedding array<float>")
    for name, df in (("documents", docs), ("benchmark", items), ("labels", labels), ("pages", pages), ("embeddings", embeddings)):
        df.write.parquet(f"{full}/{name}.parquet")
        df.limit(0).write.parquet(f"{empty}/{name}.parquet")
    return full, empty
