"""Quality rules: repeats and length, then divergence from what the languages look like.

A document is compared with the frequent languages' references by Jensen-Shannon
distance, once over character classes and once over common words, and judged by
its nearest language. A document of a rarer language is also compared with its
own language's reference, so that every language has one. Short texts have noisy histograms, so each distance only
counts from a minimum number of words on. Built from column functions alone;
all work on a text happens in its own row.
"""

from __future__ import annotations

import zlib
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leadspark.session import cut_lineage

# Fixed values of the rules' definition.
_BREAK = r"[\\x20\\x09-\\x0D]+"
_SYMBOLS = r"[#*$%&|<>]"
_RUN = 8
# The rarer languages' references are broadcast up to this many of them, beyond that the join is left to Spark.
_BROADCAST_LANGUAGES = 4096
# Common words are compared in lower case and without the punctuation around them.
_WORD_BREAK = r"[\\x20\\x09-\\x0D.,;:!?()\"]+"
# Character classes, each counted in what the ones before left over; the rest is the last class.
_CLASSES = {
    "lower": r"\\p{Ll}+",
    "space": r"[\\x20\\x09-\\x0D]+",
    "upper": r"\\p{Lu}+",
    "digit": r"\\p{Nd}+",
    "point": r"[.,;:?()\"-]+",
}


def _let(value: str, name: str, body: str) -> str:
    """SQL for ``body`` with ``name`` bound to ``value``, computed once per row."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _base(text: str, words: str) -> dict[str, str]:
    lines = rf"filter(split({text}, '\\n', -1), x -> length(array_join(split(x, '{_BREAK}', -1), '')) > 0)"
    starts = f"sequence(0, size({words}) - {_RUN})"
    window = f"slice({words}, i + 1, {_RUN})"
    sorted_ = f"array_sort(transform({starts}, i -> struct(array_join({window}, ' ') AS w, i AS i)))"
    repeated = (
        "array_sort(transform(filter(runs, (x, j) -> "
        "coalesce(x.w = get(runs, j - 1).w, false) OR coalesce(x.w = get(runs, j + 1).w, false)), x -> x.i))"
    )
    covered = (
        f"aggregate({repeated}, struct(0L AS n, 0 AS upto), "
        f"(a, i) -> struct(a.n + i + {_RUN} - greatest(a.upto, i) AS n, i + {_RUN} AS upto), a -> a.n)"
    )
    # Equal windows have equal hashes: without an equal hash there is nothing to sort.
    distinct = _let(f"transform({starts}, i -> xxhash64({window}))", "h", "size(array_distinct(h)) = size(h)")
    return {
        "n_words": f"CAST(size({words}) AS BIGINT)",
        "word_chars": f"aggregate({words}, 0L, (a, w) -> a + length(w))",
        "n_symbols": f"CAST(coalesce(regexp_count({text}, '{_SYMBOLS}'), 0) AS BIGINT)",
        "n_dup_lines": f"CAST(coalesce({_let(lines, 'l', 'size(l) - size(array_distinct(l))')}, 0) AS BIGINT)",
        "n_repeat_words": (
            f"CASE WHEN size({words}) <= {_RUN} THEN 0L WHEN {distinct} THEN 0L "
            f"ELSE {_let(sorted_, 'runs', covered)} END"
        ),
    }


def _with_classes(rows: DataFrame, text: str) -> DataFrame:
    """Adds _classes, the histogram of character classes."""
    left, sizes = F.coalesce(F.col(text), F.lit("")), []
    rows = rows.withColumn("_left0", left)
    for i, pattern in enumerate(_CLASSES.values()):
        rows = rows.withColumn(f"_left{i + 1}", F.expr(f"regexp_replace(_left{i}, '{pattern}', '')"))
        sizes.append(F.length(f"_left{i}") - F.length(f"_left{i + 1}"))
    last = len(_CLASSES)
    counts = F.array(*[size.cast("double") for size in [*sizes, F.length(f"_left{last}")]])
    return rows.withColumn("_classes", counts).drop(*[f"_left{i}" for i in range(last + 1)])


def language_references(
    docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", common: int = 40, min_share: float = 0.005
) -> tuple[list[str], list[list[float]], list[list[float]], DataFrame | None]:
    """The common words, each frequent language's histograms of character classes and of those words, and the rarer languages.

    All texts with a language count. A frequent language has ``min_share`` of
    all of them (so there are at most 1 / min_share); the words are the
    ``common`` most frequent of each such language, and one more class for the
    others. What comes back as values is bounded by these two parameters. All
    other languages are rows of a DataFrame, see :func:`_rare_references`; it is
    None if there are none.
    """
    texts = docs.select(F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text")).where(
        F.col("_lang").isNotNull() & F.col("_text").isNotNull()
    )
    held = texts.groupBy("_lang").agg(F.count("*").alias("_n"))
    least = min_share * texts.count()
    langs = sorted(r["_lang"] for r in held.where(F.col("_n") >= least).collect())
    n_rare = held.where(F.col("_n") < least).count()
    if not langs and not n_rare:
        return [], [], [], None
    n_classes = len(_CLASSES) + 1
    sums = _with_classes(texts, "_text").groupBy("_lang").agg(
        *[F.sum(F.col("_classes")[i]).alias(f"_sum{i}") for i in range(n_classes)]
    )
    sums = cut_lineage(sums) if n_rare else sums
    frequent = F.col("_lang").isin(langs)
    classes = {row[0]: [float(x) for x in row[1:]] for row in sums.where(frequent).collect()}
    counted = cut_lineage(
        texts.select("_lang", F.explode(F.expr(f"split(lower(_text), '{_WORD_BREAK}', -1)")).alias("_word"))
        .where("_word <> ''")
        .groupBy("_lang", "_word")
        .agg(F.count("*").alias("_n"))
    )
    ranked = counted.withColumn(
        "_rank", F.row_number().over(Window.partitionBy("_lang").orderBy(F.desc("_n"), "_word"))
    ).where(F.col("_rank") <= common)
    words = sorted({row["_word"] for row in ranked.where(frequent).select("_word").collect()})
    shown = F.when(F.col("_word").isin(words), F.col("_word"))
    totals = counted.where(frequent).groupBy("_lang", shown.alias("_shown")).agg(F.sum("_n").alias("_n")).collect()
    of = {(row["_lang"], row["_shown"]): float(row["_n"]) for row in totals}

    def shares_of(values: list[float]) -> list[float]:
        return [value / sum(values) if sum(values) else 0.0 for value in values]

    return (
        words,
        [shares_of(classes[lang]) for lang in langs],
        [shares_of([of.get((lang, word), 0.0) for word in [*words, None]]) for lang in langs],
        _rare_references(sums, counted, ranked, langs, words, n_rare) if n_rare else None,
    )


def _rare_references(
    sums: DataFrame, counted: DataFrame, ranked: DataFrame, langs: list[str], words: list[str], n_rare: int
) -> DataFrame:
    """A row (_lang, _own) for each language not in ``langs``: the histograms that it would have as one of them.

    _own has classes (shares), words (those of the common words and of the
    language's own most frequent ones that it uses) and shares (of these words,
    and of all others).
    """
    rare = ~F.col("_lang").isin(langs)
    total = " + ".join(f"_sum{i}" for i in range(len(_CLASSES) + 1))
    classes = f"transform(array({total.replace(' +', ',')}), x -> coalesce(x / nullif({total}, 0D), 0D)) AS _own_classes"
    own = ranked.where(rare).select("_lang", "_word", F.lit(True).alias("_own"))
    known = counted.where(rare).join(own, ["_lang", "_word"], "left")
    chosen = F.when(F.col("_own").isNotNull() | F.col("_word").isin(words), F.struct("_word", "_n"))
    shares = known.groupBy("_lang").agg(F.sort_array(F.collect_list(chosen)).alias("_list"), F.sum("_n").alias("_all"))
    shares = shares.selectExpr(
        "_lang",
        "transform(_list, x -> x._word) AS _own_words",
        "concat(transform(_list, x -> x._n / _all), array((_all - aggregate(_list, 0L, (a, x) -> a + x._n)) / _all))"
        " AS _own_shares",
    )
    made = sums.where(rare).selectExpr("_lang", classes).join(shares, "_lang", "left")
    made = cut_lineage(
        made.selectExpr("_lang", "struct(_own_classes AS classes, _own_words AS words, _own_shares AS shares) AS _own")
    )
    return F.broadcast(made) if n_rare <= _BROADCAST_LANGUAGES else made


def _array(values: list[float]) -> str:
    return "array(" + ", ".join(f"{value!r}D" for value in values) + ")"


def _texts(values: list[str | None]) -> str:
    shown = ["NULL" if v is None else "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values]
    return f"array({', '.join(shown)})"


def _slots(words: list[str]) -> list[str | None]:
    """The words by crc32 modulo the smallest size (from twice their number on) that parts them all."""
    size = 2 * len(words) + 1
    while len({zlib.crc32(word.encode()) % size for word in words}) < len(words):
        size += 1
    slots: list[str | None] = [None] * size
    for word in words:
        slots[zlib.crc32(word.encode()) % size] = word
    return slots


def _nearest(present: str, references: list[list[float]]) -> str:
    """The least Jensen-Shannon distance of a histogram from the references.

    ``present`` holds (place in the reference, share) of what occurs. With
    f(x) = x log2 x the squared distance is 1 + (sum f(p) + f(q) - f(p + q)) / 2,
    and what does not occur adds nothing to the sum.
    """
    each = ", ".join(
        f"struct({_array(q)} AS q, {_array([x * log2(x) if x else 0.0 for x in q])} AS f)" for q in references
    )
    both = "(h.p + r.q[h.at - 1])"
    sums = f"aggregate(hist, 0D, (s, h) -> s + r.f[h.at - 1] - {both} * log2({both}))"
    own = "aggregate(hist, 0D, (s, h) -> s + h.p * log2(h.p))"
    least = f"{own} + array_min(transform(array({each}), r -> {sums}))"
    return _let(present, "hist", f"sqrt(greatest(0D, 1D + ({least}) / 2))")


def _own_distance(present: str, reference: str) -> str:
    """The Jensen-Shannon distance of a histogram from the one in the column ``reference``; NULL without one."""
    q, both = f"{reference}[h.at - 1]", f"(h.p + {reference}[h.at - 1])"
    sums = f"h.p * log2(h.p) + CASE WHEN {q} > 0 THEN {q} * log2({q}) ELSE 0D END - {both} * log2({both})"
    return _let(present, "hist", f"sqrt(greatest(0D, 1D + aggregate(hist, 0D, (s, h) -> s + {sums}) / 2))")


def _with_own(rows: DataFrame, name: str, limit: float, own: str) -> DataFrame:
    """``rows`` where ``own`` is the distance ``name`` of what is too far from every frequent language, if it is less."""
    far = F.coalesce(F.col(name) > limit, F.lit(True)) & F.col("_own").isNotNull()
    return rows.withColumn(name, F.when(far, F.least(name, F.expr(own))).otherwise(F.col(name)))


def _word_shares(common: str, place: str, size: str) -> str:
    """The present places of a list ``words``: ``common`` chooses words that have a ``place``, the last of ``size`` is the others'."""
    places = f"array_sort(transform({common}, w -> {place}))"
    # In the sorted places a new value begins a run; the next beginning (or the end) closes it.
    runs = (
        "filter(transform(sequence(0, size(places)), i -> CASE WHEN i = 0 OR i = size(places) "
        "OR places[i] <> places[i - 1] THEN i END), i -> i IS NOT NULL)"
    )
    hist = (
        "concat(transform(slice(begins, 1, size(begins) - 1), (b, k) -> struct(CAST(places[b] AS INT) AS at, "
        "CAST(begins[k + 1] - b AS DOUBLE) / size(words) AS p)), "
        f"array(struct({size} AS at, CAST(size(words) - size(places) AS DOUBLE) / size(words) AS p)))"
    )
    present = f"filter({_let(runs, 'begins', hist)}, h -> h.p > 0)"
    # Without a common word there is one run, of no length.
    present = f"CASE WHEN size(words) > 0 THEN {_let(places, 'places', present)} END"
    return _let(f"array_remove(split(lower(_text), '{_WORD_BREAK}', -1), '')", "words", present)


def _verdict(rows: DataFrame, references, limits: dict) -> DataFrame:
    """Adds _class_distance and _word_distance (NULL where a guard holds the rule back)."""
    words, classes, shares, rare = references
    if not classes and rare is None:
        nothing = F.lit(None).cast("double")
        return rows.withColumn("_class_distance", nothing).withColumn("_word_distance", nothing)
    rows = _with_classes(rows, "_text")
    present = (
        "filter(transform(_classes, (c, i) -> struct(i + 1 AS at, c / aggregate(_classes, 0D, (a, x) -> a + x) AS p)),"
        " h -> h.p > 0)"
    )
    near = _nearest(present, classes) if classes else "CAST(NULL AS DOUBLE)"
    long = f"n_words >= {limits['min_words_classes']}"
    rows = rows.withColumn("_class_distance", F.expr(f"CASE WHEN {long} THEN {near} END"))
    if rare is not None:
        own = f"CASE WHEN {long} THEN {_own_distance(present, '_own.classes')} END"
        rows = _with_own(rows, "_class_distance", limits["max_class_distance"], own)
    slots = _slots(words)
    # A word is common if its slot holds it; only the common ones are looked up in the list.
    common = (
        f"filter(words, w -> coalesce(get({_texts(slots)}, "
        f"CAST(crc32(CAST(w AS BINARY)) % {len(slots)} AS INT)) = w, false))"
    )
    present = _word_shares(common, f"array_position({_texts(words)}, w)", f"{len(words) + 1}")
    near = _nearest(present, shares) if shares else "CAST(NULL AS DOUBLE)"
    long = f"n_words >= {limits['min_words_common']}"
    rows = rows.withColumn("_word_distance", F.expr(f"CASE WHEN {long} THEN {near} END"))
    if rare is not None:
        present = _word_shares(
            "filter(words, w -> array_contains(_own.words, w))",
            "array_position(_own.words, w)",
            "CAST(size(_own.words) + 1 AS INT)",
        )
        own = f"CASE WHEN {long} THEN {_own_distance(present, '_own.shares')} END"
        rows = _with_own(rows, "_word_distance", limits["max_word_distance"], own)
    return rows


def _computed(rows: DataFrame, carried: list[str], made: list) -> DataFrame:
    """``rows`` with new columns that later steps refer to, never compute again.

    A projection would be merged into filters and projections above it, and its
    expressions evaluated once for every use; a generator of one row is not.
    """
    return rows.select(*carried, F.inline(F.array(F.struct(*made))))


BASE_COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def judge(
    docs: DataFrame,
    *,
    text_col: str = "text",
    lang_col: str = "lang",
    common: int = 40,
    min_share: float = 0.005,
    max_class_distance: float = 0.3,
    min_words_classes: int = 50,
    max_word_distance: float = 0.41,
    min_words_common: int = 100,
) -> DataFrame:
    """Every row of ``docs`` as the struct ``_row``, with the rules' counts, base_failed and kept.

    base_failed: fewer than 20 words, or over 30 % of the words in repeated
    8-word windows. kept: not base_failed, and no further than the two distances
    from the nearest of the languages with ``min_share`` of the texts and the
    document's own language, where the text has the words a distance needs.
    NULL and empty texts have no words and fail the base rules. Documents without
    a language are judged by the frequent ones; without any language in the table only the base
    rules hold. Repeated rows are judged alike, one row each; other columns may
    have any name, because the input row is kept as one struct.
    """
    limits = {
        "min_words_classes": min_words_classes,
        "max_class_distance": max_class_distance,
        "min_words_common": min_words_common,
        "max_word_distance": max_word_distance,
    }
    references = language_references(docs, text_col=text_col, lang_col=lang_col, common=common, min_share=min_share)
    carried = ["_row", "_text"]
    rows = docs.select(F.struct("*").alias("_row"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"))
    if references[-1] is not None:
        rows, carried = rows.join(references[-1], "_lang", "left"), [*carried, "_own"]
    rows = rows.withColumn("_words", F.expr(f"coalesce(array_remove(split(_text, '{_BREAK}', -1), ''), array())"))
    rows = _computed(rows, carried, [F.expr(q).alias(name) for name, q in _base("_text", "_words").items()])
    failed: Column = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rows = _verdict(rows.withColumn("base_failed", failed), references, limits)
    far = (F.coalesce("_class_distance", F.lit(0.0)) > max_class_distance) | (
        F.coalesce("_word_distance", F.lit(0.0)) > max_word_distance
    )
    kept = (~F.col("base_failed") & ~far).alias("kept")
    return _computed(rows, ["_row"], [*BASE_COLUMNS[:-1], kept])


def quality_rules(docs: DataFrame, *, id_col: str = "doc_id", **parameters) -> DataFrame:
    """:func:`judge` with the id instead of the whole row."""
    return judge(docs, **parameters).select(F.col(f"_row.{id_col}").alias(id_col), *BASE_COLUMNS)


def keep_good(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs`` that :func:`judge` keeps, with their own columns."""
    return judge(docs, **parameters).where("kept").select("_row.*")
