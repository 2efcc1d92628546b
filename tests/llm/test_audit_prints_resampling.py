"""Filter audit, fingerprints and resampling against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from siftline.llm import filter_audit, importance_resampling, minhash, simhash
from tests.test_registry import TABLES, canonical


@pytest.mark.parametrize("name", ["op11_filter_audit", "op13_importance_resampling"])
def test_query_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    got, want = __spark_entry__.queries()[name](spark, sf).toPandas(), con.execute(__spark_entry__.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


# the audit


def plain_audit(rows, labels):
    """rows (id, text, part); labels (id, quality, toxic)."""
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    fails = []
    for i, t, _ in rows:
        t = t or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
        copy = t in least and (i is None or i > least[t])
        fails.append({"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": copy})
    good, toxic = ({x[0] for x in labels if x[k] == 1 and x[0] is not None} for k in (1, 2))
    out, shapley = {}, {}
    for part in {p or "" for _, _, p in rows}:
        mine = [k for k, r in enumerate(rows) if (r[2] or "") == part]
        for order in itertools.permutations("ABCDE"):
            left = list(mine)
            for step, f in enumerate(order, 1):
                removed = [k for k in left if fails[k][f]]
                out[part, "".join(order), step] = [
                    len(left) - len(removed), len(removed), sum(fails[k][f] for k in mine) - len(removed), sum([g for g in "ABCDE" if fails[k][g]] == [f] for k in mine),
                    sum(rows[k][0] in good for k in removed), sum(rows[k][0] in toxic for k in removed),
                ]
                shapley[part, f] = shapley.get((part, f), 0) + len(removed)
                left = [k for k in left if not fails[k][f]]
    return {(*key, *x, shapley[key[0], key[1][key[2] - 1]]) for key, x in out.items()}


def test_audit_is_brute_force(spark, docs, raw):
    rng = random.Random(2)
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in [*range(0, 40, 2), 4, 4, None, 999]]
    got = filter_audit.audit(docs, filter_audit.text_filters(F.col("text")), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows))
    assert set(rows) == plain_audit([(r[0], r[1], r[2]) for r in raw], labels)


def test_audit_of_an_empty_table(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(empty, filter_audit.text_filters(F.col("text")), labels).count() == 0


def test_audit_where_nothing_fails_or_all_do(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    n = docs.count()
    got = filter_audit.audit(docs.withColumn("lang", F.lit("x")), {"P": F.lit(False), "Q": F.lit(None).cast("boolean"), "R": F.lit(True)}, labels, copies=None)
    by = {(r.filter_order, r.step): r for r in got.collect()}
    assert len(by) == 18 and by["PQR", 3].removed == n and by["PQR", 2].kept == n and by["RPQ", 1].kept == 0 and by["RPQ", 3].redundant == 0 and by["QRP", 2].good_lost == 1


def test_survivors_keep_their_columns(spark, docs):
    left = filter_audit.survivors(docs, {"A": F.col("doc_id").isNull(), "B": F.lit(None).cast("boolean")})
    assert left.columns == docs.columns and left.count() == docs.where("doc_id IS NOT NULL").count()


# fingerprints


def plain_jaccard(a, b):
    sets = []
    for t in (a, b):
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets.append({b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1]) if sets[0] | sets[1] else 1.0


def slow_signature(text):
    """Values one by one, in whole numbers without bounds."""
    a, b = minhash.permutations()
    hashes = [int(h) for h in simhash.shingle_hashes(text, 5, minhash.SEED)]
    least = [min([(int(p) * h + int(q)) % 2**64 for h in hashes], default=2**64 - 1) for p, q in zip(a, b, strict=True)]
    return "".join((x >> 16 & 0xFFFF).to_bytes(2, "little").hex() for x in least)


@pytest.mark.parametrize("partitions", [1, 7])
def test_fingerprints_are_brute_force(spark, docs, raw, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = minhash.fingerprints(docs).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    # the order of rows of one id is free to the caller, so it is taken as it is where ids are unique
    rows = [(r[0], r[1] or "") for r in raw]
    unique = [r for r in rows if r[0] is not None and sum(x[0] == r[0] for x in rows) == 1]
    by = {r.doc_id: r for r in got}
    assert sorted(r.n_chars for r in got) == sorted(len(t) for _, t in rows) and len(got) == len(rows)
    ids = sorted({r[0] for r in rows if r[0] is not None})
    for i, t in unique:
        r, behind = by[i], ids[ids.index(i) - 1] if ids.index(i) else None
        assert r.fingerprint == slow_signature(t) and len(r.fingerprint) == 512
        nexts = [x for j, x in rows if j == behind]
        if len(nexts) == 1 and behind is not None:
            half = len(t) // 2
            new = t[: len(t) - half] + nexts[0][:half]
            assert r.edited_sha256 == sha(new) and r.edited_fingerprint == slow_signature(new)
            assert abs(r.near_edited - plain_jaccard(t, new)) < 0.2 and abs(r.near_next - plain_jaccard(t, nexts[0])) < 0.2
    prints = {}
    for r, t in ((by[i], t) for i, t in unique):
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint


def test_the_last_follows_the_first(spark):
    one = minhash.fingerprints(spark.createDataFrame([(3, "a b c d e f")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0 and one[0].edited_sha256 == hashlib.sha256(b"a b c a b c").hexdigest()
    many = {r.doc_id: r.edited_sha256 for r in minhash.fingerprints(spark.range(50).selectExpr("id AS doc_id", "concat('t', id, 'é🙂 x') AS text").repartition(5)).collect()}
    text = lambda i: f"t{i}é🙂 x"
    assert many == {i: hashlib.sha256(minhash.edited(text(i), text((i - 1) % 50)).encode()).hexdigest() for i in range(50)}


def test_fingerprints_of_an_empty_table(empty):
    assert minhash.fingerprints(empty).count() == 0 and minhash.near_classes(empty).count() == 0


def test_likeness_estimates_jaccard():
    rng = random.Random(4)
    words = [f"w{k}" for k in range(2000)]
    for share in (0.1, 0.5, 0.9):
        for _ in range(5):
            a = [rng.choice(words) for _ in range(400)]
            cut = int(len(a) * share)
            b = a[:cut] + [rng.choice(words) for _ in range(400 - cut)]
            x, y = " ".join(a), " ".join(b)
            assert abs(minhash.likeness(minhash.signature(x), minhash.signature(y)) - plain_jaccard(x, y)) < 0.17
    assert minhash.likeness(minhash.signature(""), minhash.signature("x")) == 0.0


def test_near_classes_are_brute_force(docs, raw):
    rows = [(r[0], r[1] or "") for r in raw]
    root = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        if plain_jaccard(rows[a][1], rows[b][1]) >= 0.8:
            x, y = root[a], root[b]
            root = [min(x, y) if r in (x, y) else r for r in root]
    want = []
    for k, (i, _) in enumerate(rows):
        same = [rows[j][0] for j in range(len(rows)) if root[j] == root[k] and rows[j][0] is not None]
        want.append((i, min(same, default=None)))
    assert sorted(map(tuple, minhash.near_classes(docs).collect()), key=repr) == sorted(want, key=repr)


# resampling


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})))


@pytest.mark.parametrize("held, chunk", [(5, 10), (1 << 19, 4 << 20)])
def test_crcs_of_runs(monkeypatch, held, chunk):
    monkeypatch.setattr(importance_resampling, "HELD", held)
    monkeypatch.setattr(importance_resampling, "CHUNK", chunk)
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcXYZ 019 ,.é日\n-") for _ in range(rng.randrange(0, 300))) for _ in range(20)] + [None, "", "a", " - ", "x" * 70_000 + " y", "\x00\x7f[`{", "ÀÉ a b"]
    for sizes in (1, 2, 5):
        runs, want = importance_resampling._Runs(sizes), []
        for i, t in enumerate(texts):
            w = plain_words(t)
            assert runs.add(i, t) == len(w)
            want += [(i, zlib.crc32(" ".join(w[a : a + k]).encode())) for k in range(1, sizes + 1) for a in range(len(w) - k + 1)]
        owner, crc = runs.taken()
        assert sorted(zip(owner.tolist(), crc.tolist(), strict=True)) == sorted(want)


def test_shift_is_zlibs():
    rng = np.random.default_rng(3)
    data = [(rng.bytes(int(a)), rng.bytes(int(b))) for a, b in rng.integers(0, 5000, (200, 2))]
    first, both, second = (np.array([zlib.crc32(f(p)) for p in data], np.uint32) for f in (lambda p: p[0], lambda p: p[0] + p[1], lambda p: p[1]))
    assert (both ^ importance_resampling.shifted(first, np.array([len(b) for _, b in data])) == second).all()


def plain_resample(rows, target, sizes, buckets, share, least, seed):
    found = []
    for i, t in rows:
        w = plain_words(t)
        found.append((i, len(w), [zlib.crc32(" ".join(w[a : a + k]).encode()) % buckets for k in range(1, sizes + 1) for a in range(len(w) - k + 1)]))
    s, t = [0] * buckets, [0] * buckets
    for _, _, f in found:
        for b in f:
            s[b] += 1
    for text in target:
        w = plain_words(text)
        for k in range(1, sizes + 1):
            for a in range(len(w) - k + 1):
                t[zlib.crc32(" ".join(w[a : a + k]).encode()) % buckets] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (sum(s) + buckets) / ((s[b] + 1.0) * (sum(t) + buckets)))) for b in range(buckets)]
    out = []
    for i, n, f in found:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), n])
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    ranks = {id(r): k for k, r in enumerate(able[: len(able) * share // 100], 1)}
    return [(*r[:4], ranks.get(id(r))) for r in out]


@pytest.mark.parametrize("sizes, share", [(1, 10), (3, 50), (2, 100)])
def test_resampling_is_brute_force(spark, docs, raw, sizes, share):
    target = ["alpha1 beta2 gamma3 delta4 alpha1", None, "", "Epsilon5, alpha1"]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    got = importance_resampling.resample(docs, frame, sizes=sizes, share=share)
    want = plain_resample([(r[0], r[1]) for r in raw], target, sizes, 10_000, share, 20, 2024)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_resampling_of_empty_tables(spark, docs, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert importance_resampling.resample(empty, none).count() == 0
    assert importance_resampling.resample(docs, none).count() == docs.count()
