"""Place search by ordered lists, against brute force over all places."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from saltmarsh.operators import search as Q

SCHEMA = "id string, name string, alt string, population long, source string"


def places(n=1500):
    """A third of all names begin alike; others have hyphens, accents, words of the queries elsewhere, or no name."""
    rng = np.random.default_rng(9)
    parts = ["saint", "sant", "sable", "bay", "Béa", "cap", "Sa", "port", "port-au", "nord", "x"]
    rows = []
    for i in range(n):
        words = ["Saint"] * (i % 3 == 0) + [parts[k] for k in rng.integers(0, len(parts), rng.integers(1, 4))]
        name = (" " if i % 5 else "-").join(words)
        rows.append((f"p{i}", name, " ".join(parts[k] for k in rng.integers(0, len(parts), 2)), None if i % 11 == 0 else int(rng.integers(0, 40)), "wpi" if i % 2 else "geonames"))
    return rows + [("u1", "Universal", None, 5, "wpi"), ("u1", "Universal", None, 5, "wpi"), ("u2", None, "universal saint", 9, "wpi"), ("u3", "", "", 9, None)]


QUERIES = ["s", "S", "saint", "saint sa", "saint s", "sa", "port-au", "port au p", "universal", "universalia", "bea", "BÉA", "x x x", "cap nord b", "zzz", "", "  ", None, "-saint", "Saint", "saint saint", "a b c d e f g h", "int"]


def fold(t):
    return t.lower().replace("é", "e").strip()


def searched(rows, query, top):
    words = re.findall(r"\w+", fold(query or ""))[:6]
    found = []
    for place, name, alt, population, source in rows:
        tokens = re.findall(r"\w+", fold(" ".join(x for x in (name, alt) if x is not None)))
        if words and all(w in tokens for w in words[:-1]) and any(t.startswith(words[-1]) for t in tokens):
            n, q = None if name is None else fold(name), fold(query)
            tier = 4 if n is None else 0 if n == q else 1 if n.startswith(q) else 2 if " " + q in n else 3 if q in n else 4
            found.append(((tier, population is None, -(population or 0), source is not None, source != "wpi" and source is not None, -1 if name is None else len(name), place), (place, name, tier, population)))
    return [(query, i, *r) for i, (_, r) in enumerate(sorted(found, key=lambda f: f[0])[:top], 1)]


@pytest.mark.parametrize("list_rows, short", [(256, 4096), (16, 20), (5, 0)])
def test_search_equals_brute_force(spark, monkeypatch, list_rows, short):
    monkeypatch.setattr(Q, "SHORT", short)
    rows = places()
    index = Q.SearchIndex(spark.createDataFrame(rows, SCHEMA).repartition(3), "id", "name", ["alt"], list_rows)
    asked = spark.createDataFrame([(q,) for q in [*QUERIES, "saint"]], "query string")
    for top in (3, 12):
        got = sorted((tuple(r) for r in index.search(asked, top).collect()), key=lambda r: (r[0], r[1]))
        want = sorted((r for q in QUERIES for r in searched(rows, q, top)), key=lambda r: (r[0], r[1]))
        assert got == want
    assert index.search(asked.filter("query = 'zzz'")).collect() == [] and index.search(asked.limit(0)).collect() == []


def test_a_letter_reads_a_bounded_part_of_its_list(spark, monkeypatch):
    rows = spark.range(30_000).select(F.concat(F.lit("id"), "id").alias("id"), F.concat(F.lit("S"), "id").alias("name"), F.lit("s").alias("alt"), F.col("id").alias("population"), F.lit("wpi").alias("source"))
    index, read = Q.SearchIndex(rows, "id", "name", ["alt"]), []
    plain = index.blocks

    def counted(wanted):
        out = plain(wanted)
        read.append(out.count())
        return out

    monkeypatch.setattr(index, "blocks", counted)
    got = index.search(spark.createDataFrame([("s",)], "query string"), 12).orderBy("rank").collect()
    assert [r.population for r in got] == list(range(29_999, 29_987, -1))
    assert sum(read) <= 2 * Q.LIST  # of a list of 30,000
    assert index.lists.groupBy("_begin", "_block").count().agg(F.max("count")).first()[0] <= Q.LIST


def test_search_of_no_places(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert Q.search_places(spark.createDataFrame([("a",)], "query string"), none, "id", "name", ["alt"]).collect() == []
