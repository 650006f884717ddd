"""Reversed search, spelling variants and odd sketches: against SQL on the given tables, and against brute
force on tables with every oddity."""

import math
import re
from collections import Counter, defaultdict
from itertools import combinations
from zlib import crc32

import duckdb
import numpy as np
import pytest
from fixtures import BASE, LONG, SF, empty_docs, odd_docs, odd_rows

from saltmarsh.llm import lexical_search, odd_sketch, queries, simhash, spelling


def clashing(df):
    """Further columns with the names that the operators use themselves."""
    for name in ("n", "term", "tf", "item", "score", "rank", "word", "root", "start", "same", "text_", "_row", "row", "component_id"):
        df = df.withColumn(name, df["doc_id"]) if name not in df.columns else df
    return df


def plain(rows):
    return sorted(tuple("" if v is None else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", ["op11_reversed_search", "op12_spelling_composition", "op13_odd_sketch_minhash"])
def test_query_equals_sql(spark, name):
    df = queries.queries()[name](spark, SF)
    duck = duckdb.connect()
    for t in ("documents", "benchmark"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = duck.sql(queries.oracle_sql()[name])
    assert df.columns == want.columns
    assert plain(df.collect()) == plain(want.fetchall())


ITEMS = [(1, "the quick Fox"), (2, None), (3, ""), (4, "!?"), (5, "three words here three"), (None, "lazy dog"), (5, "three words here three"), (6, LONG), (7, "ÄÖÜ straße 😀"), (8, "nowhere")]


def ranked(docs, items, k):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    low = lambda t: re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")
    held = [(r[0], Counter(term.findall(low(r[1])))) for r in docs]
    n_docs, total, df = sum(bool(c) for _, c in held), sum(c.total() for _, c in held), Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for doc_id, c in held:
            m = 10 + 90 * c.total() * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(term.findall(low(text))) if c[t])
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0))
        out += [(item, i, None if null else d, -s) for i, (s, null, d) in enumerate(sorted(scores)[:k], 1)]
    return out


@pytest.mark.parametrize("block_bytes", [16_000_000, 150])
def test_search_against_brute_force(spark, block_bytes):
    items = spark.createDataFrame(ITEMS, "item_id long, text string").repartition(2)
    for k in (1, 3):
        got = lexical_search.search_items(clashing(odd_docs(spark)), items, k, block_bytes=block_bytes)
        assert plain(got.collect()) == plain(ranked(odd_rows(), ITEMS, k))


def test_search_of_ties_over_tasks(spark):
    rows = [(i, "same old text") for i in range(300)] + [(i, "something else") for i in range(300, 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = lexical_search.search_items(docs, spark.createDataFrame([(1, "old")], "item_id int, text string"))
    assert [(r.rank, r.doc_id) for r in got.orderBy("rank").collect()] == [(i + 1, i) for i in range(10)]


def test_search_of_empty_tables(spark):
    items, none = spark.createDataFrame(ITEMS, "item_id long, text string"), empty_docs(spark)
    assert lexical_search.search_items(none, items).collect() == []
    assert lexical_search.search_items(odd_docs(spark), items.limit(0)).collect() == []
    assert lexical_search.search_items(none, items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]


def test_heaps_hold_k():
    heaps = lexical_search.Heaps(2, 3)
    rng = np.random.default_rng(1)
    scores = rng.integers(0, 20, (500, 2))
    for at in range(0, 500, 50):
        heaps.update(scores[at : at + 50], np.arange(at, at + 50), np.ones(50, bool))
    for i in range(2):
        assert sorted((-s, -d) for s, _, d in heaps.heaps[i]) == sorted((-int(s), d) for d, s in enumerate(scores[:, i]))[:3]


def near(x, y):
    if abs(len(x) - len(y)) > 1 or x == y:
        return False
    i = next((k for k, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y)))
    return x[i + (len(x) >= len(y)) :] == y[i + (len(y) >= len(x)) :]


def variants(docs):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}
    links = defaultdict(list)
    for x, y in combinations(n, 2):
        if near(x, y):
            links[x].append(y)
            links[y].append(x)
    form = {w: min(links[w], key=lambda y: (-n[y], y)) for w in n if links[w]}
    form = {w: f for w, f in form.items() if n[f] >= 5 * n[w]}
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(links[w]), n.get(form.get(w))))
    return out


def spelled_rows():
    """Words of every kind: chains of forms, hot beginnings and endings, accents, equal letters, long runs."""
    words = {"marsh" + "x" * 5000: 6, "marsh" + "x" * 4999: 40, "chainlet": 5, "chainlett": 30, "chainlette": 200, "straßen": 7, "strassen": 7, "strasse": 40, "élèves×": 5, "eleves": 5, "elèves": 5, "aaaaaa": 5, "aaaaaaa": 30, "aaaaaaaa": 200, "baaaaa": 9, "aaaaab": 9}
    rng = np.random.default_rng(7)
    for _ in range(400):
        words["".join(rng.choice(list("ab"), rng.integers(6, 10)))] = int(rng.integers(5, 60))
    for _ in range(100):
        words["long" + "".join(rng.choice(list("xy"), 4)) + "ending"] = int(rng.integers(4, 9))
    rows = [(i, " ".join(w for w, k in words.items() for _ in range(k // 5 + (i < k % 5)))) for i in range(5)]
    return rows + [(7, None), (8, ""), (9, "--"), (None, "marshes marshes MARSHES marshes marshes marsheß"), (5, "Tiny words all of them")]


@pytest.mark.parametrize("group_words", [20_000, 40, 3])
def test_spelling_against_brute_force(spark, group_words):
    rows = spelled_rows()
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    got = plain(spelling.spelling_variants(docs, group_words=group_words).collect())
    assert got == plain(variants(rows))
    assert any(r[2] not in (r[0], r[1]) for r in got)  # a form of a form


def test_spelling_of_odd_and_empty_tables(spark):
    assert plain(spelling.spelling_variants(odd_docs(spark)).collect()) == plain(variants([r[:2] for r in odd_rows()]))
    assert spelling.spelling_variants(empty_docs(spark)).collect() == []


def test_acceptor_is_minimal_and_orders_words():
    words = sorted({"abcd", "abce", "xbcd", "xbce", "ab", "b"})
    a = spelling.Acceptor(words)
    assert a.size[a.root] == len(words)
    keys = {(f, tuple((c, t) for c, (t, _) in arcs.items())) for f, arcs in zip(a.final, a.arcs)}
    assert len(keys) == len(a.arcs)
    for place, word in enumerate(words):
        s, at = a.root, 0
        for c in word:
            s, skip = a.arcs[s][c]
            at += skip
        assert a.final[s] and at == place
    got = {tuple(sorted((words[i], words[j]))) for i, j in spelling.one_edit_pairs(a).tolist()}
    assert got == {tuple(sorted(p)) for p in combinations(words, 2) if near(*p)}


def linked(rows, size=2, similarity=80):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({b" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
            label[max(root(i), root(j))] = min(root(i), root(j))
    low = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            low[root(i)].append(doc_id)
    return [(d, len(sets[i]), min(low[root(i)], default=None)) for i, (d, _) in enumerate(rows)]


@pytest.mark.parametrize("settings", [{}, {"unit_rows": 6, "bucket_rows": 4}])
def test_odd_sketch_against_brute_force(spark, settings):
    rng = np.random.default_rng(3)
    rows = [r[:2] for r in odd_rows()]
    for group in range(6):
        text = [f"w{group}n{k}" for k in rng.integers(0, 10**6, 60)]
        for copy in range(8):  # near copies, some of them only over others
            rows.append((1000 + 10 * group + copy, " ".join(text)))
            text[int(rng.integers(0, 60))] = f"new{copy}"
    rows += [(2000, " ".join(BASE)), (2000, "one id, another text"), (None, "One Id, another text")]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    got = odd_sketch.odd_sketch_components(docs, shingle=2, **settings)
    assert plain(got.collect()) == plain(linked(rows))
    assert odd_sketch.odd_sketch_components(empty_docs(spark), shingle=2).collect() == []


def test_odd_sketch_estimates_high_similarities():
    rng = np.random.default_rng(5)
    for similarity, error in ((0.95, 0.02), (0.9, 0.03), (0.8, 0.05)):
        off = []
        for _ in range(40):
            n, common = 400, round(800 * similarity / (1 + similarity))
            h = rng.integers(0, 1 << 63, 2 * n - common, dtype=np.uint64)
            a, b = (np.frombuffer(odd_sketch.odd_sketch(odd_sketch.min_hashes(x)), np.uint64) for x in (h[:n], h[n - common :]))
            off.append(odd_sketch.estimated_similarity(int(np.bitwise_count(a ^ b).sum())) - common / (2 * n - common))
        assert abs(np.mean(off)) < error and np.std(off) < error
    assert odd_sketch.estimated_similarity(odd_sketch.most_apart(0.65)) >= 0.65 > odd_sketch.estimated_similarity(odd_sketch.most_apart(0.65) + 1)
    assert odd_sketch.odd_sketch(np.arange(odd_sketch.SAMPLES, dtype=np.uint64)) == odd_sketch.odd_sketch(np.arange(odd_sketch.SAMPLES, dtype=np.uint64))
    assert len(simhash.shingle_hashes(b"a b a b".split(), 2)) == 2
