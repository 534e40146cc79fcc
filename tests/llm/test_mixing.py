"""The schedule of the mix against a version that goes through it slot by slot."""

import itertools
from bisect import bisect_right

from pointweave.llm import mixing, registry
from pointweave.llm._common import session
from pointweave.llm.mixing import BLOCK, Mix

from . import brute

SF = "/root/testdata/sf0.001"


def plain_slots(words):
    """{(source, block): slot} for the words that each source gives; points are whole multiples of 2^-64."""
    blocks = [-(-w // BLOCK) for w in words]
    n, had = sum(blocks), [0] * len(words)
    ends = [(e << 64) // n for e in itertools.accumulate(blocks)]
    step, out, over = mixing.GOLDEN >> 64, {}, []
    for i in range(n):
        s = min(bisect_right(ends, (2 * i + 1) * step % (1 << 64)), len(words) - 1)
        if had[s] < blocks[s]:
            out[s, had[s]] = i
        else:
            over.append(i)
        had[s] += 1
    lacking = [(s, b) for s in range(len(words)) for b in range(had[s], blocks[s])]
    assert len(lacking) == len(over)
    return out | dict(zip(lacking, over, strict=True))


def test_every_block_has_a_slot_and_sources_stay_near_their_share(spark):
    words = [(1, 3, 2_000, 2_048, 2_049, 9_000, 0, 70_000)[i % 8] for i in range(120)] + [30_000_000, 9_000_000]
    mixes = [Mix(f"s{i:03}", w, float(w), w) for i, w in enumerate(words)]
    got = {(r["idx"], r["block"]): r["slot"] for r in mixing.slots(spark, mixes).collect()}
    assert got == plain_slots(words)
    n = len(got)
    assert sorted(got.values()) == list(range(n))
    by_slot = sorted((s, i) for (i, _), s in got.items())
    for big in (120, 121):
        share, seen = -(-words[big] // BLOCK) / n, 0
        for s, i in by_slot:
            seen += i == big
            assert abs(seen - share * (s + 1)) < 12  # a random order strays ten times as far
    assert mixing.slots(spark, [Mix("a", 0, 0.0, 0)]).count() == 0 and mixing.slots(spark, []).count() == 0


def test_taken_and_places_slot_by_slot(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = {r["doc_id"]: r for r in mixing.mix(session(spark).read.parquet(f"{SF}/documents.parquet")).collect()}
    assert rows.keys() == docs.keys()
    names = sorted({d["source"] for d in docs.values()}, key=lambda s: (s is None, (s or "").encode()))
    tapes, words = [], []
    for name in names:
        own = sorted((r for r in rows.values() if r["source"] == name), key=lambda r: r["key"] % (1 << 64))
        tape = [(r["doc_id"], i) for r in own for i in range(len(brute.words(docs[r["doc_id"]]["text"])))]
        target = own[0]["target"]
        assert abs(sum(r["taken"] for r in own) - target) <= 2
        words.append(sum(r["taken"] for r in own))
        tapes.append((tape * 3)[: words[-1]])
    taken, places, stream = dict.fromkeys(docs, 0), {d: [] for d in docs}, []
    for (s, b), slot in sorted(plain_slots(words).items(), key=lambda x: x[1]):
        for at, (d, i) in enumerate(tapes[s][b * BLOCK : (b + 1) * BLOCK]):
            taken[d] += 1
            stream.append((slot, at, d, i))
            if i == 0:
                places[d].append(slot)
    for d, r in rows.items():
        assert (r["taken"], sorted(r["places"] or [])) == (taken[d], places[d])
    pieces = mixing.scheduled(spark.read.parquet(f"{SF}/documents.parquet")).orderBy("slot", "at").collect()
    assert [(p["slot"], p["at"] + k, p["doc_id"], p["first"] + k) for p in pieces for k in range(p["words"])] == stream
    place = {r["doc_id"]: r["place"] for r in registry.op6_mixing(spark, SF).collect()}
    assert place == {d: (r["places"] or [None])[0] for d, r in rows.items()}


def test_mix_in_order(spark):
    docs = session(spark).read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r for r in mixing.mix(docs).collect()}
    got = [r["doc_id"] for r in mixing.mixed(docs, in_order=True).select("doc_id").collect()]
    want = sorted((s, d) for d, r in rows.items() for s in r["places"] or [])
    assert sorted(got) == sorted(d for _, d in want)
    turn, seen = {d: sorted(range(len(r["places"] or [])), key=lambda k, r=r: r["places"][k]) for d, r in rows.items()}, {}
    slots = []
    for d in got:
        k = seen[d] = seen.get(d, -1) + 1
        slots.append(rows[d]["places"][turn[d][k]])
    assert slots == sorted(slots)


def test_alike_rows_nulls_and_long_texts(spark):
    long = "w " * 20_000
    rows = [(1, long, "a"), (1, long, "a"), (2, None, "a"), (2, None, "a"), (3, "x y z", None), (None, "", "b"), (None, "q " * 50, "b"), (4, "é ü", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "7 as `row`", "8 as slot", "9 as places").repartition(3)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    assert all((r["taken"] == 0) == (r["places"] is None) for r in got)
    out = mixing.mixed(docs, in_order=True)
    assert out.columns == docs.columns
    texts = out.collect()
    assert abs(sum(len(brute.words(r["text"])) for r in texts) - sum(r["taken"] for r in got)) <= 2
    assert {r["row"] for r in texts} == {7}
