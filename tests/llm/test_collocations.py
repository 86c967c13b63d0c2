"""Collocations against plain counts, and quotient filters by round trips."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from brute import low

from weftline.llm import collocations, quotient_filter

SCHEMA = "doc_id long, text string, lang string, n_chars long, n long, a string, words string, chunk string"


def plain(rows, least=10, top=2000):
    """rows: (text, lang)."""
    f, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(w)
            for k in (1, 2, 3):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, g in f.items():
        found, inner = [], defaultdict(int)
        for x, a in g.items():
            if len(x) == 3 and a >= least:
                for y in (x[:2], x[1:]):
                    inner[y] = max(inner[y], a)
        for x, a in g.items():
            if len(x) > 1 and a >= least and not (len(x) == 2 and 100 * inner[x] >= 50 * a):
                s, _, l, r = min((1_000_000 * a * a // (g[x[:k]] * g[x[k:]]), k, g[x[:k]], g[x[k:]]) for k in range(1, len(x)))
                found.append((-s, -a, " ".join(x).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, total[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


def held(spark, rows, **options):
    df = spark.createDataFrame([(k % 5 or None, t, g, 1, 2, "x", "y", "z") for k, (t, g) in enumerate(rows)], SCHEMA).repartition(4)
    return collocations.collocations(df, **options)


def sample(n=300, langs=("en", "de", None, "und")):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(30)] + ["É", "ß", "x\x01", "Zed", "zed", "a b"]
    weight = [1 / (k + 1) for k in range(len(words))]
    rows = [("".join(w + rng.choice([" ", " ", " ", "  ", "\t", ", ", "\n", ".", " ?"]) for w in rng.choices(words, weight, k=rng.randrange(80))), rng.choice(langs)) for _ in range(n)]
    return rows + [(None, "en"), ("", "en"), (None, None), ("One two three four. " * 40, "fr"), ("...", "xx"), ("rare words here", "yy")] + rows[:9]


@pytest.mark.parametrize("options", [{}, {"least": 2, "top": 25}])
def test_equals_plain_counts(spark, options):
    rows = sample()
    got = held(spark, rows, **options)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = plain(rows, **options)
    assert len(want) > 50 and sorted(map(tuple, got.collect())) == want


def test_empty(spark, docs_dir):
    assert collocations.op12_collocations(spark, docs_dir[1]).count() == 0
    assert held(spark, [(None, None), ("", "en"), ("a b c", "en")]).count() == 0


def test_equals_sql(spark, sf_dir):
    import compare

    assert not compare.differences(collocations.op12_collocations(spark, sf_dir), compare.connect(sf_dir), collocations.SQL)


@pytest.mark.parametrize("bits,shard", [(2, 0), (5, 3), (13, 6), (21, 4), (27, 9), (40, 12)])
def test_filters_lose_nothing(bits, shard):
    rng = np.random.default_rng(bits)
    _, layout = collocations._layout((1 << bits) - 1, 10)
    layout = quotient_filter.Layout(layout.left, layout.right, shard)
    a, b, c = (rng.integers(0, 1 << min(bits, 9 + bits // 3), 20_000, dtype=np.uint64) for _ in range(3))
    c[::2] = 0
    keys = Counter(zip(a.tolist(), b.tolist(), c.tolist()))
    merged = Counter()
    made = defaultdict(list)
    for part in np.array_split(np.arange(20_000), 3):
        left, right, n = quotient_filter.summed(layout, *layout.permuted(*collocations._pack(bits, a[part], b[part], c[part])))
        n = n * 300  # beyond a byte
        shards = layout.shards(left)
        for s in np.unique(shards).tolist():
            made[s].append(quotient_filter.encode(layout, *(x[shards == s] for x in (left, right, n))))
    for s, filters in made.items():
        parts = [quotient_filter.decode(layout, s, x) for x in filters]
        left, right, n = quotient_filter.summed(layout, *(np.concatenate(x) for x in zip(*parts)))
        words = collocations._unpack(bits, *layout.restored(left, right))
        merged.update(dict(zip(zip(*(w.tolist() for w in words)), n.tolist())))
    assert merged == Counter({k: 300 * v for k, v in keys.items()})
