import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from siftline.llm import exact_dedup, simhash
from siftline.llm.common import components


@given(st.lists(st.tuples(st.integers(0, 2**58 - 1), st.integers(1, 2**40)), max_size=60, unique_by=lambda x: x[0]))
@settings(max_examples=60, deadline=None)
def test_filter_round_trip(pairs):
    pairs = sorted(pairs)
    keys, counts = np.array([p[0] for p in pairs], np.uint64), np.array([p[1] for p in pairs], np.int64)
    back = exact_dedup.decode_filter(exact_dedup.encode_filter(keys, counts, 58))
    assert back[0].tolist() == keys.tolist() and back[1].tolist() == counts.tolist()


def test_filters_merge_without_loss():
    rng = np.random.default_rng(1)
    parts = [np.unique(rng.integers(0, 500, 200).astype(np.uint64) * np.uint64(2**49), return_counts=True) for _ in range(4)]
    merged = exact_dedup.decode_filter(exact_dedup.merge_filters([exact_dedup.encode_filter(k, n.astype(np.int64), 58) for k, n in parts], 58))
    want = defaultdict(int)
    for k, n in parts:
        for a, b in zip(k.tolist(), n.tolist(), strict=True):
            want[a] += b
    assert dict(zip(merged[0].tolist(), merged[1].tolist(), strict=True)) == want and merged[0].tolist() == sorted(want)


def test_a_filter_takes_under_three_bytes_a_fingerprint():
    rng = np.random.default_rng(4)
    bits, _, final = exact_dedup._bits(10**9, 1000, exact_dedup.BLOCK_ROWS)
    keys = np.unique(rng.integers(0, 1 << (bits - final), 30_000, dtype=np.uint64))
    data = exact_dedup.encode_filter(keys, np.ones(len(keys), np.int64), bits - final)
    assert len(data) < 3 * len(keys)
    assert exact_dedup.decode_filter(data)[0].tolist() == keys.tolist()


@pytest.mark.parametrize(("first", "final"), [(2, 2), (2, 4), (0, 7)])
def test_filters_of_64_partitions_merge_as_a_tree(spark, monkeypatch, first, final):
    monkeypatch.setattr(exact_dedup, "FAN_BITS", 2)
    values = np.random.default_rng(9).integers(0, 1 << 14, 6000).tolist() + [77] * 500
    parts = exact_dedup.partition_filters(spark.createDataFrame([(v,) for v in values], "h long").repartition(64), 14, first)
    merged = exact_dedup.merged_filters(parts, 14, first, final)
    found = {r.h: r.n for r in exact_dedup.repeated_fingerprints(merged, 14, final).collect()}
    assert found == {v: n for v, n in Counter(values).items() if n > 1}
    assert merged.count() <= 1 << final


def test_filters_keep_their_size_as_tables_grow():
    for n, partitions in [(10**6, 8), (10**9, 1000), (10**11, 80_000)]:
        bits, first, final = exact_dedup._bits(n, partitions, exact_dedup.BLOCK_ROWS)
        assert n / partitions / 2**first >= min(exact_dedup.FILTER_ROWS, n / partitions / 64) and n / 2**final <= exact_dedup.BLOCK_ROWS
        assert n / 2**bits <= 2.0**-exact_dedup.SPARE_BITS


def test_exact_groups_hold_where_fingerprints_collide(docs, monkeypatch):
    key = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    rows = lambda: sorted(map(str, exact_dedup.exact_groups(docs).select(*key).collect()))
    want = rows()
    monkeypatch.setattr(exact_dedup, "SPARE_BITS", 0)
    assert rows() == want


def test_exact_groups_match_brute_force(docs):
    found = exact_dedup.exact_groups(docs, block_rows=8).collect()
    groups = defaultdict(list)
    source = docs.select("doc_id", "text").collect()
    for r in source:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r.text or "")].append(r)
    assert len(found) == len(source)
    by_hash = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    for r in found:
        group = by_hash[r.text_sha256]
        best = min(group, key=lambda g: (-len(g.text or ""), g.doc_id is None, g.doc_id or 0))
        assert r.group_size == len(group) and r.keep_id == best.doc_id
    for sha, group in by_hash.items():
        assert sum(r.kept for r in found if r.text_sha256 == sha) == 1, group


def test_exact_empty_table(empty):
    assert exact_dedup.exact_groups(empty).count() == 0
    assert exact_dedup.drop_exact_copies(empty).columns == empty.columns


def test_drop_exact_copies_keeps_columns_and_one_row_a_text(docs):
    left = exact_dedup.drop_exact_copies(docs)
    assert left.columns == docs.columns
    texts = [re.sub(r"\s", "", r.text or "") for r in left.collect()]
    assert len(texts) == len(set(texts)) == len({re.sub(r"\s", "", r.text or "") for r in docs.collect()})


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    prints = [brute_print(r.text) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        ids = [x for x in (least.get(find(i)), r.doc_id) if x is not None]
        least[find(i)] = min(ids) if ids else None
    return prints, [least[find(i)] for i in range(len(rows))]


def test_simhash_matches_brute_force(docs):
    rows = docs.select("doc_id", "text").collect()
    prints, comps = brute_components(rows)
    found = simhash.simhash_components(docs).collect()
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in found), key=key) == sorted(((r.doc_id, p, c) for r, p, c in zip(rows, prints, comps, strict=True)), key=key)


def test_long_texts_hash_alike_in_parts(monkeypatch):
    texts = ["", "a", "a b", "a b c", " a  b\nc d e " * 30, "x" * 200 + " y z w", "one two  " * 20 + "x" * 90]
    whole = [simhash.shingle_hashes(t).tolist() for t in texts]
    for size in (1, 7, 64):
        monkeypatch.setattr(simhash, "CHUNK", size)
        assert [simhash.shingle_hashes(t).tolist() for t in texts] == whole


def test_simhash_empty(empty):
    assert simhash.simhash_components(empty).count() == 0


def test_near_copies_leave_one_row_a_component(docs):
    rows = docs.select("doc_id", "text").collect()
    left = simhash.drop_near_copies(docs)
    assert left.columns == docs.columns
    assert left.count() == len(set(brute_components([r for r in rows])[1]))


def test_near_copies_of_four_fifths_go(spark):
    """Texts of 60 words: one changed word leaves 51 of 61 five-word shingles, three far ones 41 of 71 (of the other copy 36 of 76)."""
    rows = []
    for k in range(40):
        words = [f"w{k}x{i}" for i in range(60)]
        change = lambda *at: " ".join("new" if i in at else w for i, w in enumerate(words))  # noqa: B023, E731
        rows += [(3 * k, change()), (3 * k + 1, change(30)), (3 * k + 2, change(10, 20, 40))]
    left = simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(r.doc_id for r in left.collect()) == [i for i, _ in rows if i % 3 != 1]


def test_near_copies_that_meet_no_hub_go(spark):
    """A chain of texts, each at four fifths of the next only, with a hub that is like none of the later ones."""
    words = [f"w{i}" for i in range(400)]
    rows = [(k, " ".join("new" if i // 12 < k and i % 12 == 0 else w for i, w in enumerate(words))) for k in range(12)]
    left = simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(2))
    assert [r.doc_id for r in left.collect()] == [0]


def test_near_copies_match_brute_force(spark, monkeypatch):
    """Families that share passages, at similarities around four fifths, in buckets that are compared four rows at a time."""
    monkeypatch.setattr(simhash, "PART_ROWS", 4)
    rng = np.random.default_rng(8)
    vocabulary = [f"v{i}" for i in range(3000)]
    rows = []
    for family in range(3):
        base = rng.choice(vocabulary, 120).tolist()
        for child in range(4):
            mother = [str(rng.choice(vocabulary)) if rng.random() < 0.05 else w for w in base]
            for _ in range(12):
                rows.append((len(rows), " ".join(str(rng.choice(vocabulary)) if rng.random() < 0.012 else w for w in mother)))
    sets = [{" ".join(t.split()[i : i + 5]) for i in range(116)} for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for i in range(len(rows)):
        for j in range(i):
            if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    left = simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    want = sorted({find(i) for i in range(len(rows))})
    assert sorted(r.doc_id for r in left.collect()) == want and 1 < len(want) < len(rows)


@given(st.sets(st.integers(0, 63), min_size=1, max_size=3))
def test_some_mask_misses_any_three_bits(bits):
    flipped = sum(1 << b for b in bits)
    assert any(m & flipped == 0 for m in simhash.covering_masks(list(range(64))))


def test_last_level_bounds_a_bucket():
    held = {new: mask for table in [simhash._tables(3)[2]] for _, new, mask in table}
    assert max(64 - m.bit_count() for m in held.values()) <= 8


def test_hot_buckets_lose_no_link(spark):
    """A ball of fingerprints around one centre, with buckets so small that all three levels are used."""
    rng = np.random.default_rng(3)
    prints = {0}
    for _ in range(400):
        prints.add(int(np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, rng.integers(1, 4)).astype(np.uint64))))
    prints |= {p ^ (1 << 60 | 1 << 50 | 1 << 40 | 1 << 30 | 1 << 20) for p in list(prints)[:40]}
    signed = [simhash._signed(p) for p in prints]
    found = {r.node: r.root for r in components(simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), bucket=4)).collect()}
    parent = {p: p for p in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(signed):
        for b in signed[:i]:
            if ((a ^ b) % 2**64).bit_count() <= 3:
                parent[find(a)] = find(b)
    groups = defaultdict(set)
    for p in signed:
        groups[find(p)].add(found.get(p, p))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 500), (300, 301), (301, 300)], "u long, v long")
    found = {r.node: r.root for r in components(edges).collect()}
    assert found == {i: 0 for i in range(201)} | {300: 300, 301: 300}


def test_numbers_of_a_scan_are_read_once(spark, raw, docs, monkeypatch):
    """Files are split otherwise after every written table, as when an executor joins or is lost; results stay."""
    from siftline.llm import common, pii_surrogates, sentence_spans, temperature_mix

    runs = {
        "exact": exact_dedup.drop_exact_copies, "groups": lambda d: exact_dedup.exact_groups(d).drop("rid"), "near": simhash.drop_near_copies,
        "spans": sentence_spans.remove_repeats, "private": pii_surrogates.replace_entities, "mix": temperature_mix.mixed_documents,
    }
    path = f"{common.new_path(spark, 'splits')}"
    extra = [(900 + k, f"Dr. Anna Meyer wrote {k} to a{k}@example.com. " * 2, "en", "a", 9, "x", k, "y", 7, None, "z") for k in range(8)]
    spark.createDataFrame(raw + extra, docs.schema).repartition(4, "doc_id").write.parquet(path)
    read = lambda: spark.read.parquet(path)
    want = {name: sorted(map(repr, run(read()).collect())) for name, run in runs.items()}
    plain, state = common.written, {"n": 0}

    def moved(df, name):
        out = plain(df, name)
        state["n"] += 1
        spark.conf.set("spark.sql.files.minPartitionNum", "1" if state["n"] % 2 else "64")
        return out

    for module in (common, exact_dedup, simhash, sentence_spans, pii_surrogates, temperature_mix):
        monkeypatch.setattr(module, "written", moved)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        for name, run in runs.items():
            for start in ("1", "64"):
                state["n"] = int(start == "1")
                spark.conf.set("spark.sql.files.minPartitionNum", start)
                assert sorted(map(repr, run(read()).collect())) == want[name], name
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
        spark.conf.unset("spark.sql.files.openCostInBytes")
