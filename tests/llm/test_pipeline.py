"""The stages one after another, each against brute force over what the one before it kept."""

import itertools
import re
from collections import Counter, defaultdict
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from fixtures import SF, empty_docs, odd_docs
from test_dedup import norm, shingles
from test_quality import slow_verdicts
from test_shard_mix_pack import slow_ids, water_fill

import corpus_pipeline
from saltmarsh.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def stages(spark, docs, folder):
    """(name, input, output) of every stage, outputs written and read again."""
    for name, stage in corpus_pipeline.STAGES:
        path = f"file://{folder}/{name.replace(' ', '_')}"
        stage(spark, docs, SF).write.parquet(path)
        out = spark.read.parquet(path)
        yield name, docs, out
        docs = out


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    return list(stages(spark, spark.read.parquet(f"{SF}/documents.parquet"), tmp_path_factory.mktemp("stages")))


def good_documents(docs):
    statistics = quality.text_statistics(docs).select("doc_id", "lang", "source", "n_words", "n_repeat_words", *[c.alias(f"x{i}") for i, c in enumerate(quality.statistic_vector())]).collect()
    failed = lambda r: r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words
    verdicts = slow_verdicts([(r.doc_id, (r.lang, r.source), r.lang, failed(r), np.array([r.x0, r.x1, r.x2, r.x3])) for r in statistics])
    return {i for i, kept in verdicts.items() if kept}


def first_of_each(rows, key):
    first = {}
    for r in sorted(rows, key=lambda r: r.doc_id):
        first.setdefault(key(r), r.doc_id)
    return set(first.values())


def apart(rows):
    """Identifiers of the first of each group of texts linked at 0.8."""
    sets, root = {r.doc_id: shingles(r.text) for r in rows}, {r.doc_id: r.doc_id for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            p, q = sorted((find(a), find(b)))
            root[q] = p
    return {i for i in root if find(i) == i}


def test_stages_equal_brute_force(staged):
    encode = slow_ids()
    for name, docs, out in staged:
        before, after = docs.collect(), out.collect()
        ids = Counter(r.doc_id for r in after)
        if name != "packing":
            assert out.columns == docs.columns
        if name == "quality rules":
            assert len(set(ids) ^ good_documents(docs)) <= 1 and max(ids.values()) == 1
        elif name == "exact dedup":
            assert set(ids) == first_of_each(before, lambda r: norm(r.text)) and max(ids.values()) == 1
        elif name == "near dedup":
            assert set(ids) == apart(before) and max(ids.values()) == 1
        elif name == "mixing":
            words, sizes = Counter(), Counter()
            text_of = {r.doc_id: " ".join(WORD.findall(r.text or "")) for r in before}
            for r in before:
                sizes[r.source] += len(WORD.findall(r.text or ""))
            taken = Counter()
            for r in after:
                part = WORD.findall(r.text)
                assert " ".join(part) in text_of[r.doc_id] and len(r.text) == r.n_chars
                words[r.source] += len(part)
                taken[r.doc_id] += len(part)
            want = water_fill(sizes)
            assert all(abs(words[s] - want[s]) <= 1 for s in sizes)
            assert all(n <= 2 * len(text_of[i].split(" ")) for i, n in taken.items())
        else:
            want = Counter(tuple(encode(r.text)) for r in before)
            pieces, sequences = defaultdict(list), Counter()
            for r in sorted(after, key=lambda r: (r.sequence_id, r.offset)):
                assert r.offset == sequences[r.sequence_id]
                sequences[r.sequence_id] += r.length
                pieces[r.doc_id].append(np.frombuffer(r.ids, "<u4"))
            assert sum(len(p) for ps in pieces.values() for p in ps) == sum(len(t) * n for t, n in want.items())
            have = Counter(int(i) for ps in pieces.values() for p in ps for i in p)
            assert have == Counter(i for t, n in want.items() for i in t * n)
            assert all(n == 2048 or n & (n - 1) == 0 for n in sequences.values())


def test_run_gives_the_stages_result(spark, staged):
    last = staged[-1][2]
    whole = lambda df: Counter(int(i) for r in df.select("ids").collect() for i in np.frombuffer(r.ids, "<u4"))
    found = corpus_pipeline.run(spark, SF)
    assert whole(found) == whole(last) and found.count() > 0


def test_odd_and_empty_documents_pass_all_stages(spark, tmp_path):
    for n, docs in enumerate((odd_docs(spark), empty_docs(spark))):
        for name, before, out in stages(spark, docs, tmp_path / str(n)):
            assert name == "packing" or out.columns == before.columns
            assert n == 0 or out.count() == 0


def test_stages_chain_lazily_and_runs_leave_each_other_alone(spark, staged):
    """No stage's result is written before the next is called, in two runs at once; both give what stages
    written one by one give."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")

    def lazily(_):
        out = docs
        for _, stage in corpus_pipeline.STAGES[:3]:
            out = stage(spark, out, SF)
        return sorted(r.doc_id for r in out.select("doc_id").collect())

    want = sorted(r.doc_id for r in staged[2][2].select("doc_id").collect())
    with ThreadPoolExecutor(2) as pool:
        assert list(pool.map(lazily, range(2))) == [want, want]
