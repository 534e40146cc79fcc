import random

import numpy as np
import pytest

from pointweave.llm import fm_dedup, suffix_dedup
from pointweave.llm._common import session, table
from pointweave.llm.fmindex import FMIndex
from pointweave.llm.suffixes import deep_shallow, letters

from . import brute

SF = "/root/testdata/sf0.001"


def odd_rows():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(40)]
    base = " ".join(rng.choice(vocab) for _ in range(300))
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, base), (2, base), (3, base[:400] + " changed " + base[400:]), (4, None), (5, ""), (6, " \n\t "), (7, "a" * 500), (8, "ab" * 300), (9, "x " * 200), (None, base), (10, "é" * 80), (11, "é" * 80), (12, "short"), (12, "short")]
    rows += [(20 + i, f"{rng.random()} {passage} {rng.random()}") for i in range(12)]
    rows += [(40, "\0" * 60), (41, "\0" * 55 + "z"), (42, passage + " " + passage), (50, base), (50, base)]
    rng.shuffle(rows)
    return rows


def table_rows(spark):
    return [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, str(r))
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("plan", [{}, {"pack_size": 300, "hot_packs": 2}, {"pack_size": 2000, "hot_packs": 5}])
def test_bytes_odd(spark, plan):
    rows = odd_rows()
    docs = session(spark).createDataFrame(rows, "doc_id long, text string").repartition(3)
    same(suffix_dedup.remove(docs, **plan).collect(), brute.byte_repeats(rows))


@pytest.mark.parametrize("plan", [{}, {"pack_size": 300, "hot_packs": 2}, {"pack_size": 2000, "hot_packs": 5}])
def test_words_odd(spark, plan):
    rows = odd_rows()
    docs = session(spark).createDataFrame(rows, "doc_id long, text string").repartition(3)
    same(fm_dedup.remove(docs, **plan).collect(), brute.word_repeats(rows))


def test_tables(spark):
    rows = table_rows(spark)
    docs = table(session(spark), SF, "documents")
    same(suffix_dedup.remove(docs, pack_size=40_000).collect(), brute.byte_repeats(rows))
    same(fm_dedup.remove(docs, pack_size=40_000).collect(), brute.word_repeats(rows))


def test_empty_table_and_texts(spark):
    docs = session(spark).createDataFrame([], "doc_id long, text string, pack long")
    assert suffix_dedup.remove(docs).count() == 0
    assert fm_dedup.remove(docs).count() == 0
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string").selectExpr("*", "1 as pack", "'x' as ids")
    assert sorted(r["kept"] for r in fm_dedup.remove(docs, texts=True).collect()) == ["", "a b"]
    assert sorted(bytes(r["kept"]) for r in suffix_dedup.remove(docs, texts=True).collect()) == [b"", b"a b"]


def test_deep_shallow_sorts():
    rng = np.random.default_rng(1)
    for n, w, a in ((1, 9, 3), (50, 3, 2), (2000, 20, 2), (3000, 50, 3)):
        r = rng.integers(97, 97 + a, (n, w)).astype(np.uint8)[rng.integers(0, n, n)]
        r[:, : w // 2] = r[0, : w // 2]
        order, new = deep_shallow(letters(r))
        s = [bytes(r[i]) for i in order]
        assert s == sorted(bytes(x) for x in r)
        assert list(new) == [True] + [x != y for x, y in zip(s, s[1:], strict=False)]


def test_fm_index_counts():
    rng = np.random.default_rng(1)
    for texts, sigma in ((1, 1), (5, 2), (40, 4), (200, 30)):
        t = [rng.integers(0, sigma, rng.integers(1, 35)) for _ in range(texts)]
        t += t[: texts // 2]
        f = FMIndex(np.concatenate(t), np.cumsum([0, *map(len, t)]), sigma, 35)
        for _ in range(60):
            x = t[rng.integers(0, len(t))]
            a = rng.integers(0, len(x))
            p = x[a : rng.integers(a + 1, len(x) + 1)]
            lo, hi = np.array([0]), np.array([f.total])
            for c in p[::-1]:
                lo, hi = f.extend(np.array([c]), lo, hi)
            where = [j for j, y in enumerate(t) for i in range(len(y) - len(p) + 1) if (y[i : i + len(p)] == p).all()]
            assert sorted(f.text[lo[0] : hi[0]]) == where
