"""Spelling variants: words one edit apart, by composing the vocabulary acceptor with a one-edit transducer and itself.

The composition starts in pairs of equal states, since both words read the same
letters up to the edit, and ends in pairs of states that read the same rest. So
a state of the acceptor is a prefix, and every pair of words belongs to the one
state where its edit happens (an inserted letter that equals its neighbours
counts as the last of them).

States that many words pass ("heavy" prefixes) are composed by Spark: the edit
arc of such a state leads to words that agree in everything but one letter at
that place, an equality join whose groups hold at most one word for each letter.
Below them lie prefixes with few words. Each is an initial state of its own: one
task minimises the acceptor of its words and enumerates the accepted pairs.
Words over LONG letters are paired by equal halves instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadspark.session import cut_lineage

# Words below one initial state. More are split by their next letter.
GROUP_WORDS = 4096
# Heavy prefixes of one depth: with more words than this times GROUP_WORDS, groups grow instead (and stay broadcast).
MOST_STATES = 16_384
# Prefix lengths looked at in one job.
DEPTHS = 8
# An acceptor has a state for each letter of such a word.
LONG = 100
# A form has ten times the count, so chains of forms have fewer than 2^5 words.
DOUBLINGS = 5

_FOUND = "word string, near bigint, form_n bigint, form string"
Pairs = tuple[np.ndarray, np.ndarray]


class Acceptor:
    """The minimal acceptor of ascending words; accepted words are numbered in order."""

    def __init__(self, words: list[str]):
        self.arcs: list[dict[str, int]] = [{}]
        self.final = [False]
        self.order: list[int] = []  # states in use, each after all states it leads to
        self._common: dict[tuple[int, int], Pairs | None] = {}
        register: dict[tuple, int] = {}
        path: list[tuple[int, str, int]] = []
        last = ""
        for word in words:
            shared = 0
            while shared < len(last) and shared < len(word) and last[shared] == word[shared]:
                shared += 1
            self._settle(path, shared, register)
            state = path[-1][2] if path else 0
            for letter in word[shared:]:
                self.arcs.append({})
                self.final.append(False)
                self.arcs[state][letter] = new = len(self.arcs) - 1
                path.append((state, letter, new))
                state = new
            self.final[state] = True
            last = word
        self._settle(path, 0, register)
        self.order.append(0)
        self.size = [0] * len(self.arcs)
        self.skip: list[dict[str, int]] = [{}] * len(self.arcs)
        for state in self.order:
            total = int(self.final[state])
            before = {}
            for letter, target in self.arcs[state].items():
                before[letter] = total
                total += self.size[target]
            self.skip[state], self.size[state] = before, total

    def _settle(self, path: list, depth: int, register: dict) -> None:
        """Replaces finished states by equal ones that are known."""
        while len(path) > depth:
            parent, letter, state = path.pop()
            known = register.setdefault((self.final[state], *self.arcs[state].items()), state)
            if known == state:
                self.order.append(state)
            else:
                self.arcs[parent][letter] = known

    def _joined(self, r: int, s: int, letters: list[str]) -> Pairs | None:
        """Numbers in r and in s of the rests that both accept and that start with one of the letters (or are empty)."""
        left, right = [], []
        if self.final[r] and self.final[s]:
            left.append(np.zeros(1, np.int64))
            right.append(np.zeros(1, np.int64))
        for letter in letters:
            below = self._common[self.arcs[r][letter], self.arcs[s][letter]]
            if below is not None:
                left.append(below[0] + self.skip[r][letter])
                right.append(below[1] + self.skip[s][letter])
        return (np.concatenate(left), np.concatenate(right)) if left else None

    def common(self, r: int, s: int, without: str = "") -> Pairs | None:
        """Numbers in r and in s of the rests that both accept, but those that start with ``without``."""
        arcs, known = self.arcs, self._common
        wanted = [(arcs[r][c], arcs[s][c]) for c in arcs[r] if c != without and c in arcs[s]] if without else [(r, s)]
        while wanted:
            one, other = wanted[-1]
            if (one, other) in known:
                wanted.pop()
            elif one == other:
                known[one, other] = (numbers := np.arange(self.size[one]), numbers)
            else:
                letters = [c for c in arcs[one] if c in arcs[other]]
                open_ = [below for c in letters if (below := (arcs[one][c], arcs[other][c])) not in known]
                if open_:
                    wanted.extend(open_)
                else:
                    known[one, other] = self._joined(one, other, letters)
        if without:
            return self._joined(r, s, [c for c in arcs[r] if c != without and c in arcs[s]])
        return known[r, s]

    def edits(self, state: int) -> Pairs | None:
        """Pairs of word numbers (within the state) whose edit happens in it."""
        found = []
        letters = list(self.arcs[state].items())
        for i, (letter, target) in enumerate(letters):
            for other, beside in letters[i + 1 :]:
                pairs = self.common(target, beside)
                if pairs is not None:
                    found.append((pairs[0] + self.skip[state][letter], pairs[1] + self.skip[state][other]))
            pairs = self.common(state, target, without=letter)
            if pairs is not None:
                found.append((pairs[0], pairs[1] + self.skip[state][letter]))
        return tuple(map(np.concatenate, zip(*found, strict=True))) if found else None

    def pairs(self) -> Pairs:
        """Numbers of all pairs of accepted words that differ by one edit, each pair once."""
        starts: list[list[np.ndarray]] = [[] for _ in self.arcs]  # number of the first word behind each way to a state
        starts[0].append(np.zeros(1, np.int64))
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for state in reversed(self.order):
            if self.size[state] < 2:  # one rest: no pair in or below it
                continue
            begun = np.concatenate(starts[state])
            starts[state] = []
            for letter, target in self.arcs[state].items():
                starts[target].append(begun + self.skip[state][letter])
            edited = self.edits(state)
            if edited is not None:
                left.append((begun[:, None] + edited[0]).ravel())
                right.append((begun[:, None] + edited[1]).ravel())
        return np.concatenate(left), np.concatenate(right)


def near_words(words: list[str], counts: np.ndarray) -> list[tuple[str, int, int, str]]:
    """(word, near words, largest count of one, that word) of the ascending words that have any."""
    one, other = Acceptor(words).pairs()
    one, other = np.concatenate([one, other]), np.concatenate([other, one])
    order = np.argsort(-counts, kind="stable")  # of equal counts the smaller word first
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    near = np.bincount(one, minlength=len(words))
    best = np.full(len(words), len(words), np.int64)
    np.minimum.at(best, one, rank[other])
    found = np.flatnonzero(near)
    forms = order[best[found]]
    return [(words[i], int(near[i]), int(counts[j]), words[j]) for i, j in zip(found, forms, strict=True)]


def _compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (state, word, n) in this order to rows of near words, state by state."""
    schema = pa.schema([("word", pa.string()), ("near", pa.int64()), ("form_n", pa.int64()), ("form", pa.string())])

    def made(words: list[str], counts: list[int]) -> pa.RecordBatch:
        rows = near_words(words, np.array(counts, np.int64))
        return pa.RecordBatch.from_arrays(
            [pa.array([row[i] for row in rows], field.type) for i, field in enumerate(schema)], schema=schema
        )

    state, words, counts = None, [], []
    for batch in batches:
        for here, word, n in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            if here != state:
                if len(words) > 1:
                    yield made(words, counts)
                state, words, counts = here, [], []
            words.append(word)
            counts.append(n)
    if len(words) > 1:
        yield made(words, counts)


def _heavy_states(words: DataFrame, limit: int) -> DataFrame | None:
    """(depth, prefix) of the prefixes of more than ``limit`` words; none of them is missing a shorter one."""
    found = []
    for low in range(0, LONG + 1, DEPTHS):
        depth = F.explode(F.sequence(F.lit(low), F.least(F.lit(low + DEPTHS - 1), F.length("word"))))
        reaching = words.where(F.length("word") >= low).select("word", depth.alias("depth"))
        counted = reaching.groupBy("depth", F.left("word", F.col("depth")).alias("prefix")).agg(F.count("*").alias("words"))
        states = cut_lineage(counted.where(F.col("words") > limit).select("depth", "prefix"))
        deepest = states.agg(F.max("depth")).first()[0]
        if deepest is None:
            break
        found.append(states)
        if deepest < low + DEPTHS - 1:
            break
    return reduce(DataFrame.unionByName, found) if found else None


def _edits_in_heavy_states(passing: DataFrame) -> DataFrame:
    """Near words whose edit happens in a heavy state; ``passing`` has (word, n, depth), one row for each such state.

    Words that agree but for the letter after the prefix have one shape; a word
    is also its own shape, which its longer neighbours share. A group holds at
    most one word for each letter and one more.
    """
    depth, word = F.col("depth"), F.col("word")
    whole = passing.select("depth", "n", "word", word.alias("shape"), F.lit("").alias("letter"))
    without = F.concat(F.left(word, depth), F.substr(word, depth + 2))
    removed = passing.where(F.length(word) > depth).select(
        "depth", "n", "word", without.alias("shape"), F.substr(word, depth + 1, F.lit(1)).alias("letter")
    )
    member = F.struct((-F.col("n")).alias("rank"), "word", "letter")
    groups = whole.unionByName(removed).groupBy("depth", "shape").agg(F.array_sort(F.collect_list(member)).alias("members"))
    groups = groups.where(F.size("members") > 1).withColumn("next", F.substr("shape", depth + 1, F.lit(1)))

    def beside(member):
        def near(other):
            replaced = (member["letter"] != "") & (other["letter"] != "")
            inserted = F.concat(member["letter"], other["letter"]) != F.col("next")
            return (member["word"] != other["word"]) & (replaced | inserted)

        return F.struct(member["word"].alias("word"), F.filter("members", near).alias("others"))

    found = groups.select(F.explode(F.transform("members", beside)).alias("found")).where(F.size("found.others") > 0)
    return found.select(
        F.col("found.word").alias("word"),
        F.size("found.others").cast("long").alias("near"),
        (-F.col("found.others")[0]["rank"]).alias("form_n"),
        F.col("found.others")[0]["word"].alias("form"),
    )


def _long_words(words: DataFrame) -> DataFrame:
    """Near words among those of LONG letters and more, unless both have just LONG.

    One edit leaves the first or the second half of the shorter word as it is.
    """
    length = F.length("word")
    least = F.explode(F.array(length, length - 1))
    sized = words.where(length >= LONG).select("word", "n", least.alias("least"))
    half = F.floor(F.col("least") / 2).cast("int")
    key = F.explode(
        F.array(
            F.sha2(F.concat(F.lit("<"), F.left("word", half)), 256),
            F.sha2(F.concat(F.lit(">"), F.right("word", F.col("least") - half)), 256),
        )
    )
    keyed = sized.select("word", "n", "least", key.alias("key"))
    other = keyed.select("least", "key", F.col("word").alias("form"), F.col("n").alias("form_n"))
    met = keyed.join(other, ["least", "key"]).where(
        (F.length("word") == F.col("least")) | (F.length("form") == F.col("least"))
    )
    met = met.where((F.greatest(F.length("word"), F.length("form")) > LONG) & (F.levenshtein("word", "form", 1) == 1))
    return met.select("word", F.lit(1).cast("long").alias("near"), "form_n", "form").distinct()


def near_counts(words: DataFrame) -> DataFrame:
    """(word, near, form_n, form) of the ``words`` (word, n) that have near ones, in parts that add up."""
    short = words.where(F.length("word") <= LONG)
    limit = max(GROUP_WORDS, -(-words.count() // MOST_STATES))
    heavy = _heavy_states(short, limit)
    parts = [_long_words(words)]
    if heavy is None:
        light = short.select(F.lit("").alias("state"), "word", "n")
    else:
        # At most MOST_STATES prefixes of a depth, none longer than LONG letters.
        states = F.broadcast(heavy)
        depths = F.sequence(F.lit(0), F.least(F.length("word"), F.lit(heavy.agg(F.max("depth")).first()[0])))
        reaching = short.select("word", "n", F.explode(depths).alias("depth"))
        passing = reaching.withColumn("prefix", F.left("word", F.col("depth"))).join(states, ["depth", "prefix"]).drop("prefix")
        parts.append(_edits_in_heavy_states(passing))
        below = passing.groupBy("word", "n").agg((F.max("depth") + 1).alias("depth")).where(F.length("word") >= F.col("depth"))
        light = below.select(F.left("word", F.col("depth")).alias("state"), "word", "n")
    dealt = light.repartition("state").sortWithinPartitions("state", "word")
    parts.append(dealt.mapInArrow(_compose, _FOUND))
    return reduce(DataFrame.unionByName, parts)


def spelling_groups(words: DataFrame, *, ratio: int = 10, word_col: str = "word", count_col: str = "n") -> DataFrame:
    """The near words, form and root of every word.

    Words are near if they differ by one inserted, deleted or replaced code
    point. A word's form is its near word with the largest count (of equal ones
    the smallest in code-point order), if that is at least ``ratio`` (2 or more)
    times its own; its root is reached by following forms. ``words`` has a word and its
    count; rows of one word are added up, NULL words and counts under 1 left out.
    Returns word, form (or NULL), root, n, n_near and form_n (or NULL), one row
    per word. An empty table gives no rows.
    """
    summed = words.where(F.col(word_col).isNotNull()).groupBy(F.col(word_col).alias("word"))
    counted = cut_lineage(summed.agg(F.sum(F.col(count_col).cast("long")).alias("n")).where("n > 0"))
    # Of the largest count the smallest word.
    best = F.min(F.struct((-F.col("form_n")).alias("rank"), "form"))
    found = near_counts(counted).groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("best"))
    met = counted.join(found, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), (-F.col("best.rank")).alias("best_n"), "best.form"
    )
    formed = F.col("best_n") >= ratio * F.col("n")
    grouped = cut_lineage(
        met.select("word", "n", "n_near", F.when(formed, F.col("form")).alias("form"), F.when(formed, F.col("best_n")).alias("form_n"))
    )
    roots = grouped.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(DOUBLINGS):
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        roots = cut_lineage(roots.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root")))
    return grouped.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
