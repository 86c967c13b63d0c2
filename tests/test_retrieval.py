"""Retrieval with bounds against plain products, and the tokenizer against a walk over characters."""

import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.functions import text
from weftline.operators import recommend


@pytest.mark.parametrize("long_list", [1, 6, 25])
def test_long_lists_change_no_neighbour(spark, long_list):
    rng = np.random.default_rng(5)
    share = np.concatenate(([0.9, 0.7, 0.5], rng.uniform(0.02, 0.2, 40)))
    cells = [(int(p), int(s), float(rng.integers(1, 3))) for p in range(60) for s in range(43) if rng.random() < share[s]]
    train = spark.createDataFrame(cells, "row_id long, col_id long, value double")
    names = spark.createDataFrame([(p, "hot" if p % 3 == 0 else None if p % 3 == 1 else f"n{p % 11}") for p in range(60)], "playlist_id long, name string")
    targets = spark.createDataFrame([(p,) for p in (0, 3, 4, 17, 17, 59)], "playlist_id long")
    plain = sorted(map(tuple, recommend.neighbours(train, names, targets, 7, long_list=1000).collect()))
    assert len(plain) == 35
    got = sorted(map(tuple, recommend.neighbours(train, names, targets, 7, long_list=long_list).collect()))
    assert [r[:2] for r in got] == [r[:2] for r in plain] and np.allclose([r[2] for r in got], [r[2] for r in plain], atol=2e-6)


@pytest.mark.parametrize("spread", [0.0, 2.0])
def test_blocks_of_songs_that_cannot_reach_a_list_are_left_out(spark, spread):
    rng = np.random.default_rng(8)
    u, w = rng.normal(size=(30, 6)), rng.normal(size=(400, 6))
    w *= np.exp(spread * rng.normal(size=(400, 1)))
    w[17] = w[18]  # a tie
    w[40] = 0
    seen = {(p, s) for p in range(30) for s in rng.integers(0, 400, 20).tolist()} | {(3, s) for s in range(397)}
    users = spark.createDataFrame([*[(p, x.tolist()) for p, x in enumerate(u)], (99, None)], "playlist_id long, u array<double>")
    items = spark.createDataFrame([*[(s, x.tolist()) for s, x in enumerate(w)], (999, None)], "song_id long, v array<double>")
    had = spark.createDataFrame(sorted(seen), "playlist_id long, song_id long")
    got = {}
    for r in recommend.latent_topn(users, items, had, 8, user_block=10, item_block=50).orderBy("playlist_id", "rank").collect():
        got.setdefault(r["playlist_id"], []).append((r["song_id"], r["score"]))
    for p in range(30):
        scores = np.round(w @ u[p], 6)
        want = [s for s in np.lexsort((np.arange(400), -scores)).tolist() if (p, s) not in seen][:8]
        assert [s for s, _ in got[p]] == want and np.allclose([x for _, x in got[p]], scores[want])
    assert set(got) == set(range(30)) and len(got[3]) == 400 - len({s for p, s in seen if p == 3}) < 8
    met = recommend.latent_blocks(users, items, had, 8, item_block=50).filter("playlist_id <> 3").agg(F.sum("met"), F.sum("blocks")).first()
    assert met[1] == 29 * 8 and (met[0] < 0.6 * met[1]) == (spread > 0)
    assert recommend.latent_topn(users.limit(0), items, had, 8).count() == 0 and recommend.latent_topn(users, items.limit(0), had, 8).count() == 0


def walked(s: str) -> list[str]:
    """Tokens by one walk over the characters."""
    out, last = [], ""
    for c in s:
        kind = unicodedata.category(c)
        now = "d" if kind == "Nd" else "U" if kind in ("Lu", "Lt") else "l" if kind[0] == "L" else "m" if kind[0] == "M" else ""
        if now == "m":
            now = last if last in ("U", "l") else ""
        if now and (now == last or (last, now) == ("U", "l")):
            out[-1] += c
        elif now:
            out.append(c)
        last = now
    whole = []
    for t in out:
        w = t.lower()
        for a, b in {**text.SINGLE, **text.DOUBLE}.items():
            w = w.replace(a, b)
        kept = ""
        for c in unicodedata.normalize("NFC", w):
            d = unicodedata.normalize("NFD", c)
            kept += d[0] if "a" <= d[0] <= "z" else "" if unicodedata.category(c)[0] == "M" and kept[-1:].isascii() and kept else c
        whole.append(unicodedata.normalize("NFC", kept))
    return whole


def test_no_letter_of_any_script_is_lost(spark):
    assert walked("日本語 abc øst مرحبا") == ["日本語", "abc", "ost", "مرحبا"]
    rng = random.Random(4)
    pool = "aZbQéÉñÅøØßÆœłđ日本語мирДЖمرحباहिन्दी가나 019٣४ _-.,'́̈\tǅ"
    rows = [(k, "".join(rng.choice(pool) for _ in range(40))) for k in range(300)] + [(300, ""), (301, None), (302, "Straße Ærø ŁÓDŹ été XMLHttp2Go")]
    got = {r["k"]: r["t"] for r in spark.createDataFrame(rows, "k int, s string").select("k", text.tokens("s").alias("t")).collect()}
    assert got[301] is None and got[302] == ["strasse", "aero", "lodz", "ete", "xmlhttp", "2", "go"]
    for k, s in rows[:301]:
        assert [unicodedata.normalize("NFC", t) for t in got[k]] == walked(s), s
