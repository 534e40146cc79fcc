"""Every stage of corpus_pipeline.py against plain versions, and on odd rows."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from pointweave.llm import mixing, quality, secrets
from pointweave.llm._common import session, table

from . import brute
from .test_operators import ODD, SCHEMA, bag, linked

SF = "/root/testdata/sf0.001"
NAMES = list(corpus_pipeline.COLUMNS)


@pytest.fixture(scope="module")
def docs(spark):
    return table(session(spark), SF, "documents")


@pytest.fixture(scope="module")
def odd(spark):
    clash = "'k' as key", "1 as n", "2 as score", "'m' as mark", "3 as size", "'r' as redacted", "0 as piece", "'b' as bands"
    return session(spark).createDataFrame(ODD, SCHEMA).selectExpr("*", "cast(length(text) as long) as n_chars", *clash).repartition(3)


def test_stages_and_names():
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["classify", "deduplicate", "redact", "mix", "pack"]


def test_classify_keeps_what_the_classifier_does(spark, docs):
    kept = corpus_pipeline.classify(spark, docs, SF)
    assert kept.columns == NAMES
    labels = {r["doc_id"]: r["quality"] for r in table(spark, SF, "labels").collect()}
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    some = sorted(set(labels) & set(rows))
    model = quality.fit(np.array([quality.features_of((rows[d] or "").encode()) for d in some]), np.array([labels[d] for d in some]))
    want = {d for d, t in rows.items() if model.scores(np.array([quality.features_of((t or "").encode())]))[0] >= quality.THRESHOLD}
    got = [r["doc_id"] for r in kept.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    good = [d for d in some if labels[d] == 1]
    assert np.mean([d in want for d in good]) > 0.9 and np.mean([d in want for d in some if labels[d] == 0]) < 0.2


def test_deduplicate_keeps_the_least_of_each_class(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = corpus_pipeline.deduplicate(spark, docs, SF)
    assert got.columns == NAMES
    assert sorted(r["doc_id"] for r in got.collect()) == sorted({least for _, least in linked(rows)})


def test_deduplicate_odd_rows(spark, odd):
    got = corpus_pipeline.deduplicate(spark, odd, SF).collect()
    # blank texts are one class, the two long rows another, 7 and 8 a third
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == [(False, 1), (False, 4), (False, 5), (False, 6), (False, 7), (True, 0)]
    assert len({frozenset(bag(r["text"])) for r in got}) == len(got)


def test_deduplicate_says_which_of_equal_rows_stays(spark):
    rows = [(1, "a b c", "fr", "x", 5), (1, "a b c", "de", "y", 5), (1, "a b c", "de", "x", 5), (2, "", "en", "z", 0), (2, None, None, "a", None)]
    for some in (rows, rows[::-1]):
        got = corpus_pipeline.deduplicate(spark, spark.createDataFrame(some, "doc_id long, text string, lang string, source string, n_chars long"), SF)
        assert got.columns == NAMES
        assert sorted(map(tuple, got.collect())) == [(1, "a b c", "de", "x", 5), (2, "", "en", "z", 0)]


def test_redact_replaces_every_span(spark):
    docs = table(session(spark), "/root/testdata/sf0.01", "documents")  # the smallest table with secrets
    rows = {r["doc_id"]: r for r in docs.collect()}
    got = corpus_pipeline.redact(spark, docs, SF)
    assert got.columns == NAMES
    compressor = secrets._compressor(secrets.learned(docs))
    seen = 0
    for r in got.collect():
        text = rows[r["doc_id"]]["text"] or ""
        base = secrets.base_spans(text)
        gone = bytearray(len(text))
        for s, _, e in base + secrets.novel_spans(text, text.encode().lower(), base, compressor):
            gone[s:e] = b"\1" * (e - s)
            seen += 1
        for s, _, e in base:
            assert len(text[s:e]) < 9 or text[s:e] not in r["text"]
        kept = "".join(c for c, g in zip(text, gone, strict=True) if not g)
        assert r["text"].replace("<SECRET>", "") == kept.replace("<SECRET>", "") and r["n_chars"] == len(r["text"])
    assert seen > 5


def test_mix_takes_words_near_the_targets(spark, docs):
    got = corpus_pipeline.mix(spark, docs, SF)
    assert got.columns == NAMES
    rows = got.collect()
    words = {r["doc_id"]: brute.words(r["text"]) for r in docs.collect()}
    taken = Counter()
    for r in rows:
        w = brute.words(r["text"])
        taken[r["source"]] += len(w)
        assert w == words[r["doc_id"]][: len(w)] and r["n_chars"] == len(r["text"])
    targets = {r["source"]: r["target"] for r in mixing.mix(docs).collect()}
    for s, target in targets.items():
        assert abs(taken[s] - target) < 0.01 * target + 8
    assert max(Counter(r["doc_id"] for r in rows).values()) <= 3


def test_pack_holds_every_token(spark, docs):
    from tokenizers import Tokenizer

    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {r["doc_id"]: np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4") for r in docs.collect()}
    pieces = {}
    for r in corpus_pipeline.pack(spark, docs, SF).collect():
        assert r["ids_crc32"] == zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes())
        pieces[r["doc_id"]] = pieces.get(r["doc_id"], 0) + r["length"]
    assert pieces == {d: len(x) for d, x in ids.items()}


def test_stages_take_odd_and_no_rows(spark, odd):
    nothing = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, SF).count() == 0
        rows = stage(spark, odd, SF).collect()
        if stage is corpus_pipeline.redact:
            assert len(rows) == len(ODD)
        assert stage is corpus_pipeline.classify or rows


def test_run_equals_stage_by_stage(spark, docs):
    out = corpus_pipeline.run(spark, SF)
    step = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        step = spark.createDataFrame(stage(spark, step, SF).collect(), step.select(*NAMES).schema)
    last = corpus_pipeline.pack(spark, step, SF)
    digest = lambda d: Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in d.collect())
    assert digest(out) == digest(last)
    assert len([t for t in spark.catalog.listTables() if re.match("pipeline_", t.name)]) == 1
