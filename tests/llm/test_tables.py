"""The operators that write or attest whole tables: manifest, upsert, token files."""

import bisect
import glob
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointweave.llm import merkle, registry, repair, tokenfile, upsert
from pointweave.llm._common import fold, session, table

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
crc = lambda x: zlib.crc32(str(x).encode())
sha = lambda x: hashlib.sha256(x.encode()).hexdigest()


# manifest


def merkle_rows(rows):
    """rows (doc_id, text, lang, source, n_chars) -> the query's rows, step by step."""
    tag = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    low = lambda t: t and "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    leaf = lambda r, text: sha("".join(map(tag, (r[0], r[3], r[2], r[4], text))))
    langs = {}
    for r in rows:
        langs.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))

    def tree(nodes):
        """The root, and for each first node its path: (run, place) level by level."""
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            runs = [nodes[i : i + 8] for i in range(0, len(nodes), 8)]
            for path, i in zip(paths, at, strict=True):
                path.append((runs[i // 8], i % 8))
            nodes, at = [sha("".join(r)) for r in runs], [i // 8 for i in at]
        return nodes[0], paths

    order = sorted(langs, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        langs[g].sort(key=lambda x: x[:3])
        trees[g] = tree([x[2] for x in langs[g]])
    root, above = tree([trees[g][0] for g in order]) if order else (None, [])
    out = []
    for g, top in zip(order, above, strict=True):
        for (_, _, own, r), path in zip(langs[g], trees[g][1], strict=True):
            h = leaf(r, low(r[1])) if crc("" if r[0] is None else r[0]) % 3 == 0 else own
            siblings = ""
            for run, i in path + top:
                siblings += "".join(run[:i] + run[i + 1 :])
                h = sha("".join([*run[:i], h, *run[i + 1 :]]))
            out.append((r[0], own, trees[g][0], root, sha(siblings), h, h == root))
    return out


KEYED = lambda rows: sorted(rows, key=lambda r: (r[0] is not None, *map(str, r)))


def test_manifest_equals_the_plain_tree(spark):
    docs = table(spark, SF, "documents")
    assert KEYED(map(tuple, registry.op11_merkle_manifest(spark, SF).collect())) == KEYED(merkle_rows([(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in docs.collect()]))


@pytest.mark.parametrize("n", [0, 1, 2, 8, 9, 65])
def test_manifest_of_odd_rows(spark, n):
    rng = random.Random(n)
    rows = [(rng.choice([None, 1, 5, i]), rng.choice([None, "", "Ab É" * 9000, f"X{i}"]), rng.choice([None, "", "en", "é"]) if n < 60 else "en", rng.choice([None, "a"]), rng.choice([None, 3])) for i in range(n)]
    rows += rows[: n // 2]  # repeated rows
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as g", "2 as h", "3 as i", "'x' as leaf", "'y' as root", "0 as path").repartition(3)
    assert KEYED(map(tuple, merkle.verified(df, fold(3) == 0).collect())) == KEYED(merkle_rows(rows))


def test_manifest_of_other_columns(spark):
    rows = spark.createDataFrame([(f"k{i:03}", i % 2, float(i)) for i in range(30)], "k string, grp int, v double")
    out = merkle.manifest(rows, "grp", "k", leaf_of=merkle.leaf(F.col("k"), F.col("v")))
    held = out.select("k", "root", merkle.fold(F.col("path"), F.col("leaf")).alias("again"), merkle.fold(F.col("path"), F.lit("0" * 64)).alias("other")).collect()
    assert len(held) == 30 and all(r["again"] == r["root"] != r["other"] for r in held)


# upsert


def upsert_rows(clients, changes):
    """The files after the upsert, from whole lists; client_id is unique in clients."""
    names, size = list(clients[0]), 1 + len(clients) // 700
    rows = sorted((r for r in clients if r["client_id"] is not None and crc(r["client_id"]) % 7 > 3), key=lambda r: r["client_id"])
    files = [rows[i : i + size] for i in range(0, len(rows), size)]
    firsts = [f[0]["client_id"] for f in files]
    rank = lambda c: [(c[k] is not None, c[k] or 0) for k in ("seq", "change_id")]
    best = {}
    for c in changes:
        if c["client_id"] is not None and (c["client_id"] not in best or rank(c) > rank(best[c["client_id"]])):
            best[c["client_id"]] = c
    after = [{r["client_id"]: dict(r) for r in f} for f in files]
    for k, c in best.items():
        home = max(bisect.bisect_right(firsts, k) - 1, 0)
        h = crc(firsts[home]) % 12
        if h <= 7 and (c["op"] == "D" or crc("" if c["change_id"] is None else c["change_id"]) % 8 < h):
            after[home].pop(k, None)
        elif h <= 7:
            after[home].setdefault(k, dict.fromkeys(names) | {"client_id": k}).update({n: c[n] for n in ("source", "segment", "city", "balance")})
    parts = []
    for old, new in zip(files, after, strict=True):
        new = [new[k] for k in sorted(new)]
        k = -(-len(new) // size)
        at = [0]
        for i in range(k):
            at.append(at[-1] + len(new) // k + (i < len(new) % k))
        parts += [(old, False)] if new == old else [(new[a:z], True) for a, z in zip(at, at[1:], strict=False)]
    out = []
    for f, again in parts:
        if out and again and out[-1][1] and len(out[-1][0]) + len(f) <= size:
            out[-1] = (out[-1][0] + f, True)
        else:
            out.append((f, again))
    cents = lambda f: sum(math.floor(100 * r["balance"] + 0.5) for r in f if r["balance"] is not None)
    return sorted((f[0]["client_id"], len(f), cents(f), sum(crc("|".join(r[c] or "" for c in ("source", "segment", "city"))) for r in f), sha(",".join(str(r["client_id"]) for r in f)), ",".join(names), again) for f, again in out)


def reported(rows):
    return sorted((r["first_id"], r["n_rows"], r["cents"], r["rows_crc"], r["ids_sha256"], r["columns"], r["rewritten"]) for r in rows)


def test_upsert_equals_the_plain_one(spark):
    got = registry.op12_upsert(spark, SF).collect()
    assert reported(got) == upsert_rows(*([r.asDict() for r in table(spark, SF, t).collect()] for t in ("clients", "client_changes")))
    folder = got[0]["path"].split("/start/")[0].split("/rewritten/")[0].removeprefix("file:").replace("///", "/")
    assert len(glob.glob(f"{folder}/*/*/*.parquet")) == len(got) == len({r["path"] for r in got})


CLIENTS = "client_id long, master_id long, source string, updated_at timestamp, name string, email string, city string, nation_id int, segment string, balance double, path string, b string"
CHANGES = "change_id long, client_id long, seq long, op string, source string, segment string, city string, balance double, c string"


@pytest.mark.parametrize("seed", range(4))
def test_upsert_of_odd_rows(spark, tmp_path, seed):
    """Several rows a file, nulls everywhere, ids before the first file, homes that grow, vanish or stay; seed 3 has no change."""
    rng = random.Random(seed)
    some = lambda: rng.choice([None, "", "a", "b"])
    ids = rng.sample(range(5, 9000), 1500)
    clients = [(i, None, some(), None, some(), None, some(), None, some(), rng.choice([None, 1.5, -2.25, 0.0]), "p", None) for i in ids] + [(None, 1, None, None, None, None, None, None, None, None, None, None)]
    changes = [(rng.choice([None, i]), rng.choice([None, 1, 7, rng.choice(ids), rng.randrange(9500), 4000 + i % 50]), rng.choice([None, 1, 2, i]), rng.choice(["U", "I", "D", None]), some(), some(), some(), rng.choice([None, 3.5]), "z") for i in range(0 if seed == 3 else 2500)]
    changes = list({c[:3]: c for c in changes}.values())  # ties of (seq, change_id) only between equal rows
    for name, rows, schema in (("clients", clients, CLIENTS), ("client_changes", changes + changes[:50], CHANGES)):
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    names = lambda schema: [c.split()[0] for c in schema.split(", ")]
    want = upsert_rows([dict(zip(names(CLIENTS), r, strict=True)) for r in clients], [dict(zip(names(CHANGES), r, strict=True)) for r in changes])
    assert reported(registry.op12_upsert(spark, str(tmp_path)).collect()) == want
    if seed == 3:
        assert not any(r[-1] for r in want)


def test_upsert_without_rows(spark, tmp_path):
    spark.createDataFrame([], CLIENTS).write.parquet(f"{tmp_path}/clients.parquet")
    spark.createDataFrame([(1, 2, 3, "I", "a", "b", "c", 1.0, "")], CHANGES).write.parquet(f"{tmp_path}/client_changes.parquet")
    assert registry.op12_upsert(spark, str(tmp_path)).collect() == []


def test_copies_of_a_key_over_several_files(spark, tmp_path):
    rows = spark.createDataFrame([(k, "old") for k in [1, 2, 3, 3, 3, 3, 3, 4, 5]], "k long, v string")
    upsert.start(rows, "k", 2, str(tmp_path))
    at = upsert.starts(spark, str(tmp_path), "k")
    assert (at.first, at.last) == ([1, 3, 3, 3, 5], [2, 3, 3, 4, 5]) and at.with_copies({3}) == [1, 2, 3]
    changes = upsert.latest(spark.createDataFrame([(3, 1, "new")], "k long, seq long, v string"), "k", ["seq"])
    assert upsert.upsert(spark, str(tmp_path), "k", 2, changes, ["v"], lambda first: (F.lit(True), F.lit(False))) == [1, 2, 3]
    out = spark.read.parquet(f"{tmp_path}/start").unionByName(spark.read.parquet(f"{tmp_path}/rewritten"), allowMissingColumns=True)
    assert sorted(map(tuple, out.select("k", "v").collect())) == [(1, "old"), (2, "old"), *[(3, "new")] * 5, (4, "old"), (5, "old")]


def test_plan_of_cuts():
    """Against cutting and joining one by one."""
    rng = random.Random(4)
    for _ in range(300):
        size, n = rng.randint(1, 9), rng.randint(1, 12)
        found = {i: (rng.choice([0, 1, 2, size, rng.randint(0, 5 * size)]), rng.random() < 0.7) for i in range(n) if rng.random() < 0.9}
        out = []  # [rows, rewritten, {file: rows}]
        for i in range(n):
            rows, differs = found.get(i, (size, False))
            if not differs:
                out.append([size, False, {}])
                continue
            k = -(-rows // size)
            for j in range(k):
                x = rows // k + (j < rows % k)
                if out and out[-1][1] and out[-1][0] + x <= size:
                    out[-1][0] += x
                    out[-1][2][i] = out[-1][2].get(i, 0) + x
                else:
                    out.append([x, True, {i: x}])
        got = {}
        for f, first, larger, more, less in upsert.plan(found, n, size):
            for i in range(found[f][0]):
                to = first + (i // more if i < larger * more else larger + (i - larger * more) // less)
                got.setdefault(to, {}).setdefault(f, 0)
                got[to][f] += 1
        assert [got[k] for k in sorted(got)] == [x[2] for x in out if x[1]] and sorted(got) == list(range(len(got)))


# token files


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenfile.tokenizer_path())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


STRANGE = ["it's <|endoftext|> x<|ENDOFTEXT|>y <|startoftext|>", "á ́b  c\x1cd\x85e f　g", "İSTANBUL ΣΑΣ ß ﬁ Å ǅ", "don'T'S 'S x'll ''re", "한가 ᅡ", "x" * 5000, " " * 10000 + "a\r\n\tb\x0bc\x0cd", "👍🏽 é́́ 123 12a3 ²½", "＜|endoftext|＞ a_b__c \xad\xa0¡"]


def test_ids_of_pieces_equal_those_of_whole_texts(spark, plain):
    ids = tokenfile.Ids.get(tokenfile.tokenizer_path())
    for text in STRANGE + [r["text"] or "" for r in table(spark, "/root/testdata/sf0.01", "documents").select("text").collect()]:
        assert np.frombuffer(ids.of(text), "<u4").tolist() == plain(text)


def want_tokens(rows, plain):
    out, at = [], 0
    for doc, text in rows:
        ids = [*plain(text), 1]
        out.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_token_file_equals_whole_encodings(spark, plain):
    rows = sorted((r["doc_id"], r["text"]) for r in table(spark, SF, "documents").collect())
    assert sorted(map(tuple, registry.op13_token_ids(spark, SF).collect())) == want_tokens(rows, plain)


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_small_shards_and_random_access(spark, plain, tmp_path, size):
    """Documents of many shards, shards of many documents; null and repeated ids, null and long texts."""
    rows = [(i, t) for i, t in enumerate([*STRANGE, None, "", "a b c " * 3000, "word"])] + [(None, "no id"), (2, STRANGE[2]), (-5, "first")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as part", "2 as nth", "'x' as ids").repartition(3)
    folder = tokenfile.write(df, f"{tmp_path}/ids", size=size)
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    key = lambda r: r[1]
    assert sorted(map(tuple, tokenfile.index(spark, folder).collect()), key=key) == want_tokens(order, plain)
    every = {(r["doc_id"], tuple(r["ids"])) for r in tokenfile.tokens(spark, folder).collect()}
    assert every == {(d, (*plain(t), 1)) for d, t in rows}
    some = tokenfile.tokens(spark, folder, spark.createDataFrame([(11,), (2,), (77,)], "doc_id long")).collect()
    assert sorted((r["doc_id"], tuple(r["ids"])) for r in some) == sorted((d, (*plain(t), 1)) for d, t in rows if d in (11, 2))


def test_empty_token_file(spark, tmp_path):
    folder = tokenfile.write(spark.createDataFrame([], "doc_id long, text string"), f"{tmp_path}/ids")
    assert tokenfile.index(spark, folder).collect() == tokenfile.tokens(spark, folder).collect() == []


@pytest.mark.parametrize("alphabet", [10, 49408, 1 << 20])
def test_repair_round_trip_and_random_access(alphabet):
    rng = np.random.default_rng(alphabet)
    for n in (0, 1, 2, 3, 50, 5000, 100_000):
        for ids in (np.full(n, 7), rng.integers(0, 10, n), np.tile(rng.integers(0, alphabet, 37), n // 37 + 1)[:n], rng.zipf(1.3, n) % alphabet):
            g = repair.compress(ids.astype(np.uint32), alphabet, least=2 if n < 100 else repair.LEAST)
            d = repair.Decoder(g)
            assert (d[:] == ids).all() and len(d) == n
            assert (g.lengths == [len(d.ids[d.offset[alphabet + j] :][: g.lengths[j]]) for j in range(len(g.rules))]).all()
            for _ in range(5):
                a, z = sorted(rng.integers(0, n + 1, 2))
                assert (d[a:z] == ids[a:z]).all()
    assert len(repair.compress(np.tile(np.arange(8), 10_000).astype(np.uint32), alphabet).sequence) < 10_000


def test_crc_of_joined_parts():
    rng = random.Random(2)
    for _ in range(50):
        a, b = rng.randbytes(rng.randint(0, 40)), rng.randbytes(rng.randint(0, 4000))
        assert tokenfile.joined_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
