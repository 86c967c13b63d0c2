"""Rows without doc_id get the results of their texts, each its own."""

from collections import Counter

import pytest

from conftest import PASSAGE
from weftline.llm import decontaminate, registry

TEXTS = [f"start {PASSAGE} end", f"{PASSAGE} and other words " * 3, "clean words of its own", "One two three. " * 9, "", None]
#: Columns that name rows of a result; all else follows from the texts.
NAMES = {"doc_id", "component_id", "sequence_id", "offset", "held_out", "n_known", "train_tokens", "base_score", "score", "open_score"}


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    """The same texts with ids, and half of them without."""
    out = []
    items = spark.createDataFrame([(1, " ".join(f"P{k}" for k in range(10, 40))), (None, "TWO three one")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 0, 0)], "doc_id long, quality int, toxic int")
    for kind in ("named", "unnamed"):
        at = str(tmp_path_factory.mktemp(kind))
        rows = [(k if kind == "named" or k % 3 == 0 else None, t, "en", "s", 1) for k, t in enumerate(TEXTS)]
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
        items.write.parquet(f"{at}/benchmark.parquet")
        labels.write.parquet(f"{at}/labels.parquet")
        out.append(at)
    return out


@pytest.mark.parametrize("name", sorted(n for n in registry.QUERIES if n not in ("op1_language_id", "op7_packing", "op9_html_extract", "op13_hard_negatives")))
def test_results_follow_texts(spark, folders, name):
    named, unnamed = (registry.QUERIES[name](spark, at) for at in folders)
    columns = [c for c in named.columns if c not in NAMES]
    assert Counter(map(tuple, unnamed.select(columns).collect())) == Counter(map(tuple, named.select(columns).collect()))
    if name == "op12_collocations":  # phrases of languages: no result names a document
        return
    assert Counter(r["doc_id"] for r in unnamed.select("doc_id").collect()) == {0: 1, 3: 1, None: 4}


def test_packing_keeps_all_tokens(spark, folders):
    named, unnamed = (Counter((r["doc_tokens"], r["length"]) for r in registry.QUERIES["op7_packing"](spark, at).collect()) for at in folders)
    total = lambda c: sum(n * k for (_, n), k in c.items())
    assert total(named) == total(unnamed)


@pytest.mark.parametrize("remove", ["documents", "spans"])
def test_decontamination_of_rows_without_id(spark, folders, remove):
    left = []
    for at in folders:
        docs, items = (spark.read.parquet(f"{at}/{t}.parquet") for t in ("documents", "benchmark"))
        left.append(Counter(r["text"] for r in decontaminate.decontaminate(docs, items, remove=remove).collect()))
    assert left[0] == left[1]
    assert sum(left[0].values()) == (3 if remove == "documents" else 6)
