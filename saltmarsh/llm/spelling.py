"""Spelling variants by composing finite-state machines.

Pairs of words one edit apart are what the composition A o T o A accepts: A is the minimised acceptor
of the vocabulary and T a transducer of two states, of which the first copies, an inserted, deleted
or replaced letter leads to the second, and that one copies. Until the edit both acceptors are in one
state, after it in two whose right languages are intersected.

The composition's states reached by the first letters (before an edit) are the initial states of its
partitions: words that begin alike share a partition, in which A is the minimised acceptor of just
these words. Words that differ in their first letters end alike, so the same is done on the words'
mirror images. A beginning with too many words goes on by longer ones; pairs whose edit then lies
within long beginnings and endings both are reached from the states after the edit: what is left of
a word without the edited letter.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from saltmarsh.llm.common import discard, staged, table, text_of

#: Letters of words once A-Z is lower-cased, the fewest letters of a word, and of what pairs share at one
#: end at least (half of a shortest word).
LETTERS, LEAST, EDGE = "a-zÀ-ÿ", 6, 3
#: Words that one task composes at a time, and different words that a task counts at a time.
GROUP_WORDS, HELD_WORDS = 20_000, 300_000
BLOCK = 199
NOTHING = np.zeros((0, 2), dtype=np.int32)


def spelled(run: str, seed: int) -> str:
    """The run, or the run less a letter where BLOCK divides its checksum."""
    h = crc32(run.encode(), seed)
    if h % BLOCK:
        return run
    cut = h % len(run)
    return run[:cut] + run[cut + 1 :]


def word_counts(docs: DataFrame, least_n: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: the words of LEAST letters or more that occur least_n times or more."""
    run = re.compile(f"[{LETTERS}]{{{LEAST},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                seed = crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for found, n in Counter(run.findall(text.as_py().lower().decode())).items():
                    word = spelled(found, seed)
                    if len(word) >= LEAST:
                        held[word] += n
                if len(held) > HELD_WORDS:
                    yield flush()
        yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_n)


class Acceptor:
    """The minimal acyclic acceptor of sorted distinct words. A state's number is above its successors'.

    arcs[s]: letter -> (state, number of s's words that come before those of this arc), so that the
    sum along a path is the place of its word. lengths[s]: a bit for every length of a word from s.
    """

    def __init__(self, words: list[str]):
        self.arcs: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        self.lengths: list[int] = []
        self.size: list[int] = []
        known: dict[tuple, int] = {}
        path: list[list] = [[False, []]]  # the last word's states: final, arcs so far
        last = ""

        def close(down_to: int) -> None:
            while len(path) > down_to + 1:
                final, arcs = path.pop()
                path[-1][1].append((last[len(path) - 1], self._state(final, arcs, known)))

        for word in words:
            same = 0
            for a, b in zip(word, last):
                if a != b:
                    break
                same += 1
            close(same)
            path.extend([False, []] for _ in range(len(word) - same))
            path[-1][0] = True
            last = word
        close(0)
        self.root = self._state(*path[0], known)

    def _state(self, final: bool, arcs: list[tuple[str, int]], known: dict[tuple, int]) -> int:
        key = (final, *arcs)
        if key not in known:
            known[key] = len(self.arcs)
            before, lengths, out = int(final), int(final), {}
            for letter, to in arcs:
                out[letter] = (to, before)
                before += self.size[to]
                lengths |= self.lengths[to] << 1
            self.arcs.append(out)
            self.final.append(final)
            self.lengths.append(lengths)
            self.size.append(before)
        return known[key]


def shared_words(a: Acceptor, p: int, q: int, but: str = "") -> np.ndarray:
    """Places (in p's words, in q's words) of the words that states p and q both accept, but for those that
    begin with the letter `but`: the composition's states after the edit."""
    out, work = [], [(p, q, 0, 0, but)]
    arcs, final, lengths = a.arcs, a.final, a.lengths
    while work:
        p, q, i, j, but = work.pop()
        if final[p] and final[q]:
            out.append((i, j))
        of_q = arcs[q]
        for letter, (to, skip) in arcs[p].items():
            if letter in of_q and letter != but:
                other, skip_q = of_q[letter]
                if lengths[to] & lengths[other]:
                    work.append((to, other, i + skip, j + skip_q, ""))
    return np.array(out, dtype=np.int32) if out else NOTHING


def one_edit_pairs(a: Acceptor) -> np.ndarray:
    """Places (i, j) of all pairs of the acceptor's words that are one edit apart, each once.

    found[s] has the pairs among the words of state s: those of its arcs' states (the edit comes
    later), of two arcs (a letter is replaced) and of an arc and the state itself (a letter of the one is
    missing in the other; the last of equal letters is taken as the missing one).
    """
    found: list[np.ndarray] = []
    known: dict[tuple[int, int, str], np.ndarray] = {}

    def meet(p: int, q: int, but: str = "") -> np.ndarray:
        if not a.lengths[p] & a.lengths[q]:
            return NOTHING
        if (p, q, but) not in known:
            known[p, q, but] = shared_words(a, p, q, but)
        return known[p, q, but]

    for s, arcs in enumerate(a.arcs):
        parts, each = [], list(arcs.items())
        for k, (letter, (to, skip)) in enumerate(each):
            if len(found[to]):
                parts.append(found[to] + np.int32(skip))
            if len(gone := meet(to, s, letter)):
                parts.append(gone + np.array([skip, 0], dtype=np.int32))
            for _, (other, skip_other) in each[k + 1 :]:
                if len(other_letter := meet(to, other)):
                    parts.append(other_letter + np.array([skip, skip_other], dtype=np.int32))
        found.append(np.concatenate(parts) if parts else NOTHING)
    return found[a.root]


def with_depth(words: DataFrame, part: Column, name: str, most: int) -> DataFrame:
    """Adds `name`: how many of part's first letters tell it from all but `most` words, on a scale of
    EDGE, 4, 6, 8, 12, 16 ... letters."""
    depth, settled, left = EDGE, None, words.withColumn("_part", part)
    while True:
        left = left.withColumn("_head", F.substring("_part", 1, depth))
        hot = staged(left.groupBy("_head").agg(F.count("*").alias("_n")).filter(F.col("_n") > most).select("_head"), "hot_beginnings")
        none = hot.isEmpty()
        cold = (left if none else left.join(hot, "_head", "left_anti")).withColumn(name, F.lit(depth)).select(*words.columns, name)
        settled = cold if settled is None else settled.unionByName(cold)
        if none:
            return settled
        left = staged(left.join(hot, "_head", "left_semi").drop("_head"), "words_alike")
        depth = depth + 1 if depth == EDGE else depth + (1 << depth.bit_length() - 2)


def composed(words: DataFrame) -> DataFrame:
    """words: word, n, head, tail (their depths from either end) -> word, n_near, best (n, word): what
    the partitions by beginnings and endings find of every word, pairs once in all."""
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("head").alias("depth"), F.col("word").alias("part")), F.struct(F.lit(1).alias("side"), F.col("tail").alias("depth"), F.reverse("word").alias("part")))
    rows = words.select("n", "head", F.explode(sides).alias("s")).select("n", "head", "s.*").withColumn("start", F.struct("side", "depth", F.substr("part", F.lit(1), F.col("depth"))))
    rows = rows.repartition("start").sortWithinPartitions("start", "part").select("start", "part", "n", "head")

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def solve() -> Iterator[pa.RecordBatch]:
            if len(held) == 1:
                return
            mirrored = now["side"] == 1
            pairs = one_edit_pairs(Acceptor([part for part, _, _ in held]))
            words = [part[::-1] if mirrored else part for part, _, _ in held]
            best: dict[int, list] = {}
            for i, j in pairs.tolist():
                if mirrored and words[i][: held[i][2]] == words[j][: held[i][2]]:
                    continue  # found by their beginnings
                for x, y in ((i, j), (j, i)):
                    mine, other = best.setdefault(x, [0, 1, ""]), (-held[y][1], words[y])
                    mine[0] += 1
                    if other < (mine[1], mine[2]):
                        mine[1:] = other
            if best:
                yield pa.RecordBatch.from_arrays([pa.array([words[i] for i in best], pa.string()), pa.array([b[0] for b in best.values()], pa.int64()), pa.array([-b[1] for b in best.values()], pa.int64()), pa.array([b[2] for b in best.values()], pa.string())], ["word", "n_near", "near_n", "near"])

        for batch in batches:
            for start, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if start != now and held:
                    yield from solve()
                    held = []
                now = start
                held.append(row)
        if held:
            yield from solve()

    return rows.mapInArrow(compose, "word string, n_near long, near_n long, near string")


def edited_within_depths(words: DataFrame) -> DataFrame:
    """As composed(), of the pairs whose edit lies within the depths of either end: from the states
    after the edit, which words without the edited letter lead to."""
    deep = words.filter((F.col("head") > EDGE) | (F.col("tail") > EDGE)).withColumn("_m", F.length("word"))
    low, high = F.greatest(F.lit(0), F.col("_m") - F.col("tail")), F.least(F.col("_m"), F.col("head")) - 1
    cut = deep.filter(low <= high).withColumn("at", F.explode(F.sequence(low, high)))
    cut = cut.withColumn("rest", F.concat(F.substr("word", F.lit(1), F.col("at")), F.substr("word", F.col("at") + 2)))
    a, b = (cut.select("at", "rest", F.col("word").alias(f"word_{s}"), F.col("n").alias(f"n_{s}"), F.col("head").alias(f"head_{s}"), F.col("tail").alias(f"tail_{s}")) for s in "ab")
    replaced = a.join(b.select("at", "rest", "word_b", "n_b"), ["at", "rest"]).filter("word_a < word_b").drop("at", "rest")
    whole = deep.select(F.col("word").alias("rest"), F.col("word").alias("word_b"), F.col("n").alias("n_b"))
    missing = a.drop("at").join(whole, "rest").drop("rest")
    pairs = replaced.unionByName(missing).distinct()
    apart = lambda side, depth: F.expr(f"{side}(word_a, {depth}) <> {side}(word_b, {depth})")
    pairs = pairs.filter(apart("left", "head_a") & apart("right", "tail_a"))
    both = pairs.select(F.explode(F.array(F.struct(F.col("word_a").alias("word"), F.col("n_b").alias("near_n"), F.col("word_b").alias("near")), F.struct(F.col("word_b").alias("word"), F.col("n_a").alias("near_n"), F.col("word_a").alias("near")))).alias("p")).select("p.*")
    return both.select("word", F.lit(1).cast("long").alias("n_near"), "near_n", "near")


def near_words(words: DataFrame, group_words: int = GROUP_WORDS) -> DataFrame:
    """words: word, n -> word, n, n_near (words one edit apart), near and near_n (the most frequent of them, of
    equal ones the first in code-point order); null, and n_near 0, for words without any."""
    deep = staged(with_depth(with_depth(words, F.col("word"), "head", group_words), F.reverse("word"), "tail", group_words), "word_depths")
    parts = composed(deep)
    if not deep.filter((F.col("head") > EDGE) | (F.col("tail") > EDGE)).isEmpty():
        parts = parts.unionByName(edited_within_depths(deep))
    best = parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("k"), "near")).alias("_best"))
    return words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.col("_best.near").alias("near"), (-F.col("_best.k")).alias("near_n"))


def with_roots(forms: DataFrame) -> DataFrame:
    """forms: word, form (null or another word), ... -> with root, where the forms lead to. Every step doubles
    the way: after the first, a word knows the form that two, four, eight ... forms lead to."""
    ways = staged(forms.select("word", F.coalesce("form", "word").alias("root")), "ways")
    while True:
        ahead = ways.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        further = staged(ways.join(ahead, "root").select("word", F.col("_next").alias("root"), (F.col("_next") != F.col("root")).alias("moved")), "ways")
        discard(ways)
        ways = further.select("word", "root")
        ways.written_to = further.written_to
        if further.filter("moved").isEmpty():
            return forms.join(ways, "word")


def spelling_variants(docs: DataFrame, least_n: int = 5, times: int = 5, id_col: str = "doc_id", text_col: str = "text", group_words: int = GROUP_WORDS) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Words: runs of letters (LETTERS) of LEAST or more, A-Z in lower case, that occur least_n times or more;
    where BLOCK divides the checksum of the document's identifier and the run, the run counts
    without one letter. form: of the words one edit apart the most frequent one (of equal ones the first in
    code-point order) if it occurs `times` times as often or more, else null; root: where forms lead to.
    Null, empty and wordless texts have no words; a null identifier counts as empty in the checksum;
    repeated rows count as often as they are there; texts and words may be of any length. An empty
    table gives an empty result; other columns, of whatever names, are ignored.
    """
    words = staged(word_counts(docs, least_n, id_col, text_col), "words")
    near = near_words(words, group_words)
    is_form = F.col("near_n") >= times * F.col("n")
    forms = staged(near.select("word", "n", "n_near", F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n")), "forms")
    return with_roots(forms).select("word", "form", "root", "n", "n_near", "form_n")


def op12_spelling_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


SQL12 = r"""
WITH RECURSIVE x AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
o AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) AS run FROM documents WHERE text IS NOT NULL)
 WHERE length(run) >= 6 GROUP BY ALL),
b AS (SELECT run, n, flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [195, unicode(c) - 64] END)) AS bytes FROM o),
h AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, y: xor(c >> 8, crc[(xor(c, y) & 255) + 1])), 4294967295) AS h FROM b, x),
w AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % 199 = 0 THEN substring(run, 1, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word, n FROM h)
 WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
c AS (SELECT word, n, i, substring(word, 1, i) || substring(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)),
p AS (SELECT DISTINCT a.word, a.n, b.word AS near, b.n AS near_n FROM c a JOIN c b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
 UNION SELECT c.word, c.n, w.word, w.n FROM c JOIN w ON c.rest = w.word UNION SELECT w.word, w.n, c.word, c.n FROM c JOIN w ON c.rest = w.word),
f AS (SELECT word, n, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM p GROUP BY word, n),
g AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * w.n THEN near END AS form, CASE WHEN near_n >= 5 * w.n THEN near_n END AS form_n FROM w LEFT JOIN f USING (word)),
t AS (SELECT word, coalesce(form, word) AS at FROM g UNION SELECT t.word, g.form FROM t JOIN g ON t.at = g.word WHERE g.form IS NOT NULL)
SELECT g.word, g.form, t.at AS root, g.n, g.n_near, g.form_n FROM g JOIN t USING (word) JOIN g e ON e.word = t.at AND e.form IS NULL
"""
