"""Place search by an index of ordered lists.

For every beginning of a word (up to PREFIX letters) the index lists the places that have such a
word: those first whose name itself begins so, then those with a later word of the name that does,
those with it inside the name, the others last; within each, the most populated first. Lists are cut
into blocks of LIST rows, so a beginning that a third of all places have lies on as many tasks as it
needs. A query reads blocks of one list, one, two, four, eight ... at a time, and ends as soon as no
place further down the list can come before the best found so far.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saltmarsh.functions import scalar as S
from saltmarsh.operators.ordered import in_order, positions
from saltmarsh.session import settled

#: Letters of a word's beginning that lists go by, rows of a block, and words of a query that count (a fixed value).
PREFIX, LIST, WORDS = 8, 256, 6
#: Lists of so many rows at most are read to their end. So many beginnings at most reach the scan as values.
SHORT, VALUES = 4096, 100


def search_words(text: Column) -> Column:
    return F.filter(F.split(S.fold(text), r"[^\p{L}\p{N}_]+"), lambda w: w != "")


def _tier(name: Column, query: Column) -> Column:
    """Of folded texts."""
    return F.when(name == query, 0).when(F.startswith(name, query), 1).when(F.contains(name, F.concat(F.lit(" "), query)), 2).when(F.contains(name, query), 3).otherwise(4)


def search_tier(name: Column, query: Column) -> Column:
    """0 the name itself, 1 its beginning, 2 a word's beginning, 3 inside, 4 elsewhere."""
    return _tier(S.fold(name), S.fold(query))


class SearchIndex:
    """places: _p (a number), place, name, population, source, _folded, _words. lists: _begin, _block, _j (the
    row's number in the list), _p, _class (the least tier it can have, by its beginning), _n (the list's
    rows). A list of "=" and a folded name has the places of that name."""

    def __init__(self, places: DataFrame, place_id: str, name: str, fields: list[str], list_rows: int = LIST):
        held = places.select(F.col(place_id).alias("place"), F.col(name).alias("name"), "population", "source", S.fold(F.col(name)).alias("_folded"), F.array_distinct(search_words(F.concat_ws(" ", *dict.fromkeys([name, *fields])))).alias("_words"))
        self.list_rows = list_rows
        self.places = settled(held.withColumn("_p", F.monotonically_increasing_id()), "search_places")
        begins = F.flatten(F.transform("_words", lambda w: F.transform(F.sequence(F.lit(1), F.least(F.length(w), F.lit(PREFIX))), lambda n: w.substr(F.lit(1), n))))
        rows = self.places.withColumn("_begin", F.explode(F.array_distinct(F.concat(begins, F.array_compact(F.array(F.concat(F.lit("="), "_folded")))))))
        by = F.when(F.startswith("_begin", F.lit("=")), 0).otherwise(F.greatest(F.lit(1), _tier(F.col("_folded"), F.col("_begin"))))
        rows = rows.select("_begin", "_p", by.alias("_class"), self.rank().alias("_rank"))
        rows = positions(in_order(rows, ["_begin"], ["_class", "_rank"]), ["_begin"], counted=True)
        rows = rows.select("_begin", F.floor(F.col("_j") / list_rows).alias("_block"), "_j", "_p", "_class", "_n")
        self.lists = settled(rows.repartitionByRange("_begin", "_block").sortWithinPartitions("_begin", "_block", "_j"), "search_lists")

    @staticmethod
    def rank() -> Column:
        """What places of one tier are ranked by."""
        return F.struct(F.col("population").isNull().alias("a"), (-F.col("population")).alias("b"), (F.col("source") != "wpi").alias("c"), F.length("name").alias("d"), F.col("place").alias("e"))

    def blocks(self, wanted: DataFrame) -> DataFrame:
        """wanted: _begin, _block, ... -> with the rows of those blocks. Few beginnings are looked up in the files."""
        few = [r[0] for r in wanted.select("_begin").distinct().limit(VALUES + 1).collect()]
        lists = self.lists.filter(F.col("_begin").isin(few)) if len(few) <= VALUES else self.lists
        return wanted.join(lists.drop("_n"), ["_begin", "_block"])

    def search(self, queries: DataFrame, top: int = 12) -> DataFrame:
        """queries: query -> query, rank, place, name, tier, population. See search_places."""
        asked = queries.select("query").distinct().withColumn("_t", F.slice(search_words(F.col("query")), 1, WORDS)).filter("size(_t) > 0").withColumn("_q", S.fold(F.col("query")))
        words = asked.select("query", F.posexplode("_t").alias("_at", "_word")).withColumn("_begin", F.substring("_word", 1, PREFIX))
        sizes = self.lists.filter("_j = 0").select("_begin", "_n")
        words = words.join(sizes, "_begin", "left").groupBy("query").agg(F.min(F.struct("_n", "_at", "_begin")).alias("_least"), F.min_by(F.struct("_n", "_at", "_begin"), "_at").alias("_first"), F.count_if(F.col("_n").isNull()).alias("_unknown"))
        # A short list is read to its end; else the first word's list tells where to stop, if the query begins with it.
        by_first = (F.col("_least._n") > SHORT) & F.startswith("_q", F.element_at("_t", 1))
        words = words.filter("_unknown = 0").join(asked, "query").withColumn("_l", F.when(by_first, F.col("_first")).otherwise(F.col("_least")))
        ends = (F.col("_l._at") == 0) & F.startswith("_q", F.element_at("_t", 1))
        left = settled(words.select("query", "_t", "_q", "_l._begin", ends.alias("_ends"), F.floor((F.col("_l._n") - 1) / self.list_rows).alias("_last")), "search_queries")
        exact = left.select("query", "_t", "_q", F.concat(F.lit("="), "_q").alias("_begin"), F.lit(False).alias("_listed"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit((top - 1) // self.list_rows).cast("long"))).alias("_block"))
        best, low, high = None, 0, 0
        while True:
            wanted = left.filter(F.col("_last") >= low).select("query", "_t", "_q", "_begin", F.lit(True).alias("_listed"), F.explode(F.sequence(F.lit(low).cast("long"), F.least("_last", F.lit(high).cast("long")))).alias("_block"))
            read = self.blocks(wanted.unionByName(exact) if best is None else wanted).join(self.places, "_p")
            read = settled(read.withColumn("_rank", self.rank()).drop("source"), "search_rows")
            size = F.size("_t")
            fits = F.forall(F.slice("_t", 1, size - 1), lambda w: F.array_contains("_words", w)) & F.exists("_words", lambda w: F.startswith(w, F.element_at("_t", -1)))
            hits = read.filter(fits).select("query", "_p", "place", "name", _tier(F.col("_folded"), F.col("_q")).alias("tier"), "population", "_rank")
            if best is not None:
                hits = hits.unionByName(best.drop("rank"))
            # The list of a name and the list of a beginning may both have a place.
            best = settled(hits.dropDuplicates(["query", "_p"]).withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("tier", "_rank"))).filter(F.col("rank") <= top), "search_best")
            # Open are the queries that have more blocks and whose last hit isn't sure to come before what these hold.
            edge = read.filter("_listed").groupBy("query").agg(F.max(F.struct(F.col("_class").alias("tier"), "_rank")).alias("_edge"))
            full = best.filter(F.col("rank") == top).select("query", F.struct("tier", "_rank").alias("_kth")).join(edge, "query").filter("_kth <= _edge").select("query")
            more = left.filter(F.col("_last") > high)
            left = settled(more.join(full.withColumn("_full", F.lit(True)), "query", "left").filter("not (_ends and coalesce(_full, false))").drop("_full"), "search_queries")
            if left.isEmpty():
                return best.select("query", "rank", "place", "name", "tier", "population")
            low, high = high + 1, 2 * high + 2


def search_places(queries: DataFrame, places: DataFrame, place_id: str, name: str, fields: list[str], top: int = 12) -> DataFrame:
    """queries: query. All words of a query (WORDS at most) must occur in the name or the fields, the last as a
    beginning; ranked by tier, population, ports first, shorter name, place_id.

    Places are rows, each its own. Queries without words and null ones find nothing; equal queries are one; places
    without a name are found by their other fields, in the last tier. For many searches of the same
    places build a SearchIndex once.
    """
    return SearchIndex(places, place_id, name, fields).search(queries, top)


def search_pool(hits: DataFrame, popular: DataFrame, keys: list[str]) -> DataFrame:
    """Two sets of candidates as one, each candidate once; where both have it the hits' row stays."""
    rows = hits.withColumn("_from", F.lit(0)).unionByName(popular.withColumn("_from", F.lit(1)), allowMissingColumns=True)
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("_from"))).filter("_n = 1").drop("_n", "_from")
