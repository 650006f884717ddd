import hashlib
import itertools
import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from fixtures import SF, documents, empty_docs, odd_docs, odd_rows

from saltmarsh.llm import exact_dedup, simhash

UPPER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def norm(t):
    return (t or "").encode().translate(UPPER)


@pytest.mark.parametrize("keep", ["min", "max"])
@pytest.mark.parametrize("parts", [1, 7])
def test_exact_duplicates_of_odd_rows(spark, keep, parts):
    groups = defaultdict(list)
    for r in odd_rows():
        groups[norm(r[1])].append(r[0])
    want = []
    for t, ids in groups.items():
        best = (min if keep == "min" else max)([i for i in ids if i is not None], default=None)
        ids.sort(key=lambda i: i != best)  # one row stays, the others go
        want += [(i, best, len(ids), n == 0, hashlib.sha256(t).hexdigest()) for n, i in enumerate(ids)]
    got = exact_dedup.mark_exact_duplicates(odd_docs(spark, parts), keep).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_a_hot_group_spreads_over_partitions_and_is_put_together(spark):
    rows = [(i, "Same text" if i % 3 else f"text {i}", "en", "s", 1) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.doc_id: r for r in exact_dedup.mark_exact_duplicates(docs, "max").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == 3000 and all(got[i].group_size == (2000 if i % 3 else 1) for i in got)
    assert {got[i].keep_id for i in got if i % 3} == {2999} and sum(r.kept for r in got.values()) == 1001


def test_exact_duplicates_equal_the_sql(spark):
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = duckdb.sql(exact_dedup.SQL7).fetchall()
    got = exact_dedup.op7_content_sort_dedup(spark, SF).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_exact_drop_and_empty(spark):
    assert exact_dedup.mark_exact_duplicates(empty_docs(spark)).count() == 0
    left = exact_dedup.drop_exact_duplicates(odd_docs(spark))
    assert left.columns == odd_docs(spark).columns
    texts = [norm(r.text) for r in left.filter("doc_id is not null").dropDuplicates(["doc_id"]).collect()]
    assert len(texts) == len(set(texts)) == len({norm(r[1]) for r in odd_rows()})


def test_exact_drop_tells_rows_apart_not_identifiers(spark):
    rows = [(1, "same"), (2, "same"), (2, "only here"), (3, "twice"), (3, "twice"), (None, "Same"), (None, "no id"), (None, "no id")]
    left = exact_dedup.drop_exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(map(tuple, left.collect()), key=str) == [(1, "same"), (2, "only here"), (3, "twice"), (None, "no id")]


def slow_fingerprint(text, k=3):
    w = norm(text).split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(fps):
    parent = {i: i for i in range(len(fps))}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 3:
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_simhash_equals_brute_force(spark):
    rows = documents(spark).select("doc_id", "text").orderBy("doc_id").collect()
    fps = [slow_fingerprint(r.text) for r in rows]
    roots = slow_components(fps)
    want = {r.doc_id: (f"{f:016x}", rows[c].doc_id) for r, f, c in zip(rows, fps, roots)}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op6_gray_simhash(spark, SF).collect()}
    assert got == want and len(set(roots)) < len(rows)


def test_rows_without_identifiers_link_others(spark, monkeypatch):
    codes = {"a": 0, "b": 7, "c": 63}
    monkeypatch.setattr(simhash, "with_fingerprints", lambda docs, *_: docs.select("doc_id", simhash.F.when(docs["text"] == "a", 0).when(docs["text"] == "b", 7).otherwise(63).cast("long").alias("fp")))
    docs = spark.createDataFrame([(1, "a"), (None, "b"), (2, "c")], "doc_id long, text string")
    assert {(r.doc_id, r.fp, r.component_id) for r in simhash.near_duplicate_components(docs).collect()} == {(1, codes["a"], 1), (None, codes["b"], 1), (2, codes["c"], 1)}


def test_simhash_of_odd_rows(spark):
    got = simhash.near_duplicate_components(odd_docs(spark)).collect()
    assert len(got) == len(odd_rows())
    by_text = {r[0]: r[1] for r in odd_rows()}
    for r in got:
        if r.doc_id is not None:
            assert r.fp & (2**64 - 1) == slow_fingerprint(by_text[r.doc_id])
    assert {r.component_id for r in got if r.doc_id in (0, 1, 2)} == {0}
    assert {r.component_id for r in got if r.doc_id in (5, 6, 7, None)} == {5}
    assert simhash.near_duplicate_components(empty_docs(spark)).count() == 0


@pytest.mark.parametrize("blocks", [4, 5])
def test_index_finds_every_link_of_crowded_codes(spark, blocks):
    rng = np.random.default_rng(blocks)
    centres = rng.integers(0, 2**64, 12, dtype=np.uint64)
    codes = {int(c) for c in centres}
    for c in centres:
        for _ in range(60):
            x = int(c)
            for b in rng.integers(0, 64, rng.integers(1, 9)):
                x ^= 1 << int(b)
            codes.add(x)
    codes = sorted(codes)
    signed = [(c - (1 << 64) if c >= 1 << 63 else c, i) for i, c in enumerate(codes)]
    fps = spark.createDataFrame(signed, "fp long, rep long")
    found = {r.node: r.root for r in simhash.components(simhash.bucket_links(fps, 3, blocks)).collect()}
    want = slow_components(codes)
    assert [found.get(i, i) for i in range(len(codes))] == want


def test_gray_rank_puts_neighbours_one_bit_apart(spark):
    rows = spark.range(256).select((simhash.gray_rank(simhash.F.col("id"))).alias("rank"), "id").orderBy("rank").collect()
    assert [r.rank for r in rows] == list(range(256))
    assert all((a.id ^ b.id).bit_count() == 1 for a, b in zip(rows, rows[1:]))


def shingles(text, k=5):
    w = norm(text).split()
    return {b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)} or {b" ".join(w)}


def test_similar_texts_are_found_and_others_left_alone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    found = {r.doc_id: r.component_id for r in simhash.similar_components(docs).collect()}
    sets = {r.doc_id: shingles(r.text) for r in docs.collect()}
    inverted = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            inverted[g].append(i)
    pairs = {p for ids in inverted.values() if len(ids) < 50 for p in itertools.combinations(sorted(ids), 2)}
    alike = {p: len(sets[p[0]] & sets[p[1]]) / len(sets[p[0]] | sets[p[1]]) for p in pairs}
    high = [p for p, j in alike.items() if j >= 0.85]
    low = [p for p, j in alike.items() if j < 0.6]
    assert len(high) > 20 and sum(found[a] == found[b] for a, b in high) >= 0.97 * len(high)
    assert sum(found[a] == found[b] for a, b in low) <= 0.05 * len(low) + 1


def test_near_drop_of_odd_rows(spark):
    left = simhash.drop_near_duplicates(odd_docs(spark))
    assert left.columns == odd_docs(spark).columns
    ids = sorted(r.doc_id for r in left.filter("doc_id is not null").collect())
    assert 0 in ids and 1 not in ids and 6 not in ids and 11 not in ids
    assert simhash.drop_near_duplicates(empty_docs(spark)).count() == 0


@pytest.mark.parametrize("many", [1 << 14, 4])
def test_index_compares_rows_of_equal_codes_by_their_sketches(many, monkeypatch):
    """Words repeated in other orders have one fingerprint but differ in their shingles."""
    monkeypatch.setattr(simhash, "MANY", many)
    rng = random.Random(5)
    codes = np.sort(np.array([rng.choice([0, 1, 3, 255, 1 << 40, (1 << 40) + 7]) for _ in range(300)], dtype=np.uint64))
    bases = [[rng.getrandbits(64) for _ in range(2)] for _ in range(6)]
    sketch = np.array([[w ^ (1 << rng.randrange(64)) for w in rng.choice(bases)] for _ in codes], dtype=np.uint64)
    label = simhash.GrayIndex(np.zeros(len(codes)), codes, 3, sketch, 4).search()
    root = list(range(len(codes)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(codes)):
        for j in range(i):
            if int(codes[i] ^ codes[j]).bit_count() <= 3 and sum(int(a ^ b).bit_count() for a, b in zip(sketch[i], sketch[j])) <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert label.tolist() == [find(i) for i in range(len(codes))]
    assert len(set(label.tolist())) > 6


def cut_pairs(similarity, pairs=40, seed=11):
    """Texts and their copies with a passage appended, inserted, or the end cut off."""
    rng = random.Random(seed)
    rows = []
    for n in range(pairs):
        words = [f"w{rng.randrange(40_000)}" for _ in range(300)]
        extra = [f"w{rng.randrange(40_000)}" for _ in range(int(300 * (1 / similarity - 1)) - 3)]
        at = rng.randrange(300)
        other = [words + extra, words[:at] + extra + words[at:], words[: int(300 * similarity) + 3]][n % 3]
        rows += [(2 * n, " ".join(words)), (2 * n + 1, " ".join(other))]
    return rows


@pytest.mark.parametrize("similarity", [0.82, 0.85, 0.9])
def test_copies_with_one_part_more_or_less_are_found(spark, similarity):
    rows = cut_pairs(similarity)
    sets = {i: shingles(t) for i, t in rows}
    found = {r.doc_id: r.component_id for r in simhash.similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    high = [i for i in range(0, len(rows), 2) if len(sets[i] & sets[i + 1]) >= 0.8 * len(sets[i] | sets[i + 1])]
    caught = sum(found[i] == found[i + 1] for i in high)
    print(similarity, caught, len(high))
    assert len(high) > 30 and caught >= 0.97 * len(high)


@pytest.mark.parametrize("settings", [{}, {"unit_rows": 6}, {"bucket_rows": 4}, {"unit_rows": 9, "bucket_rows": 3}])
def test_links_are_those_of_the_exact_similarity(spark, settings):
    """Components are those of all pairs at 0.8 or more, in groups of many copies near that bar too,
    whatever is compared in one task."""
    rng = random.Random(3)
    rows = []
    for share in (0.02, 0.03, 0.045, 0.06):
        base = [f"w{rng.randrange(40_000)}" for _ in range(200)]
        for _ in range(30):
            at = rng.randrange(150)
            cut = int(400 * share * rng.random()) + 4
            rows.append((len(rows), " ".join(base[:at] + [f"v{rng.randrange(40_000)}" for _ in range(cut)] + base[at + cut :])))
    rows = [(None if i == 7 else i, t) for i, t in rows]
    sets = {i: shingles(t) for i, (_, t) in enumerate(rows)}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            p, q = sorted((find(a), find(b)))
            root[q] = p
    found = {r.doc_id: r.component_id for r in simhash.similar_components(spark.createDataFrame(rows, "doc_id long, text string"), **settings).collect()}
    assert len({find(i) for i in root}) > 5
    assert found == {None if i == 7 else i: find(i) for i in root}


def test_pairs_are_compared_exactly():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 12, rng.integers(1, 12)).astype(np.uint64)) for _ in range(40)]
    i, j = (x.astype(np.int64) for x in np.nonzero(np.triu(np.ones((40, 40)), 1)))
    want = [len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b])) >= 0.8 for a, b in zip(i, j)]
    assert simhash.alike(sets, i, j, 0.8).tolist() == want and any(want)


def test_near_drop_on_sf01_drops_no_text_without_a_link(spark):
    """Of a thousand documents: what goes is linked to what stays, by the exact similarity alone."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets = {r.doc_id: shingles(r.text) for r in docs.collect()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    inverted = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            inverted[g].append(i)
    for a, b in {p for ids in inverted.values() for p in itertools.combinations(sorted(ids), 2)}:
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            p, q = sorted((find(a), find(b)))
            root[q] = p
    left = {r.doc_id for r in simhash.drop_near_duplicates(docs).collect()}
    assert left == {i for i in sets if find(i) == i}


def near_and_far_rows():
    """Base texts of 300 words, each with a copy of one word changed; another with the first 20 words changed,
    like the base too but of another fingerprint; and two texts of one fingerprint, as their words repeat, that are unlike."""
    rng = random.Random(23)
    new = lambda n: [f"w{rng.randrange(40_000)}" for _ in range(n)]
    texts = []
    for _ in range(12):
        base = new(300)
        texts += [base, base[:150] + new(1) + base[151:], new(20) + base[20:]]
    often = new(3) * 200
    texts += [often + new(30), often + new(30)]
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def share_no_codes(monkeypatch):
    """Gives every set min-hash codes of its own; a lambda, so that tasks get it by value."""
    monkeypatch.setattr(simhash, "_set_marks", lambda h, make=simhash.shingle_sketch: (np.arange(20, dtype=np.uint64) + np.bitwise_xor.reduce(h), make(h)))


@pytest.mark.parametrize("settings", [{}, {"bucket_rows": 1}])
def test_near_dedup_looks_at_texts_of_near_fingerprints(spark, monkeypatch, settings):
    """with min-hash codes that no two texts share, the fingerprints alone give the candidates."""
    share_no_codes(monkeypatch)
    rows = near_and_far_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    fps, sets = [slow_fingerprint(t) for _, t in rows], [shingles(t) for _, t in rows]
    like = {(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    near = {(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if (fps[i] ^ fps[j]).bit_count() <= 3}
    assert len(like & near) > 5 and like - near and near - like
    want = list(range(len(rows)))
    for i, j in sorted(like & near):
        want[j] = want[i]
    found = {r.doc_id: r.component_id for r in simhash.similar_components(docs, **settings).collect()}
    assert all(found[i] == found[j] for i, j in like & near) and all(found[i] != found[j] for i, j in near - like)
    left = {r.doc_id for r in simhash.drop_near_duplicates(docs, **settings).collect()}
    assert left == {i for i in found if found[i] == i}
    if not settings:
        assert [found[i] for i in range(len(rows))] == want


def test_texts_of_one_set_and_several_fingerprints_link_by_each_of_them(spark, monkeypatch):
    """repeats change a fingerprint and not the set; each fingerprint leads to the set."""
    rng = random.Random(4)
    often, rest = [f"w{rng.randrange(40_000)}" for _ in range(9)], [f"w{rng.randrange(40_000)}" for _ in range(120)]
    texts = [often * 2 + rest, often * 40 + rest, often * 40 + rest[:-1]]
    fps, sets = [slow_fingerprint(" ".join(t)) for t in texts], [shingles(" ".join(t)) for t in texts]
    apart = lambda i, j: (fps[i] ^ fps[j]).bit_count()
    assert sets[0] == sets[1] and apart(0, 1) > 3 and apart(0, 2) > 3 and apart(1, 2) <= 3 and len(sets[1] & sets[2]) >= 0.8 * len(sets[1] | sets[2])
    share_no_codes(monkeypatch)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r.component_id for r in simhash.similar_components(docs).collect()} == {0}
