"""Operators over all documents against brute force: repeats, near-duplicates, benchmark windows, URLs, quality rules."""

import hashlib
import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from leadspark.llm import decontaminate, near_dedup, substring_dedup
from leadspark.llm.components import component_labels
from leadspark.llm.decontaminate import contamination, drop_contaminated
from leadspark.llm.near_dedup import keep_one, near_components
from leadspark.llm.quality_rules import keep_good, quality_rules
from leadspark.llm.substring_dedup import decode_gaps, encode_gaps, kept_digest, remove_repeated_windows
from leadspark.llm.url_filter import Rule, filter_urls

SPACE = r"[\x20\x09-\x0D]+"


def words(text):
    return [w for w in re.split(SPACE, text or "") if w]


def documents(spark, texts):
    rows = list(enumerate(texts))
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' AS lang", "'c' AS kept", "1 AS n_words", "'m' AS mark")


def prose(rng, n, size=400):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


@pytest.mark.parametrize("small", [False, True])
def test_repeated_windows_equal_brute_force(spark, monkeypatch, small):
    if small:  # many blocks and shards
        monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", 2000)
        monkeypatch.setattr(substring_dedup, "SHARD_BITS", 8)
        monkeypatch.setattr(substring_dedup, "EXACT_SHARD_BITS", 4)
    rng = random.Random(1)
    shared = prose(rng, 50)
    texts = [" ".join(prose(rng, rng.randint(0, 120))) for _ in range(30)]
    texts += [" ".join(prose(rng, k) + shared + prose(rng, 5)) for k in (0, 3, 40)]
    texts += [" ".join(shared[:34]), " ".join(["a"] * 60), texts[3], texts[3], None, "", " \n", "\u00a0".join(shared), "é" * 5000]
    windows = Counter(tuple(w[i : i + 35]) for w in map(words, texts) for i in range(len(w) - 34))
    got = {r.doc_id: r for r in kept_digest(remove_repeated_windows(documents(spark, texts))).collect()}
    for k, text in enumerate(texts):
        w = words(text)
        gone = {j for i in range(len(w) - 34) if windows[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        assert (got[k].n_words, got[k].n_removed) == (len(w), len(gone)), k
        assert got[k].kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()
    assert remove_repeated_windows(documents(spark, texts).limit(0)).count() == 0


def test_repeated_windows_whatever_the_order_of_reading(spark):
    """A shuffle between executors hands out the rows of a block in another order at each reading."""
    rng = random.Random(2)
    shared = prose(rng, 60, 5000)
    texts = [" ".join(prose(rng, rng.randint(0, 120), 5000) + (shared if k % 5 == 0 else [])) for k in range(60)] + [None, "", None]

    def stirred(batches):
        for batch in batches:
            yield batch.sample(frac=1)

    once = documents(spark, texts).coalesce(1)
    docs = once.mapInPandas(stirred, once.schema)
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        got = {r.doc_id: r for r in remove_repeated_windows(docs).collect()}
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    for k, text in enumerate(texts):
        left = words(text)[:-60] if k % 5 == 0 and text else words(text)
        assert (got[k].n_words, got[k].kept) == (len(words(text)), " ".join(left)), k


def test_gaps_round_trip():
    import numpy as np

    for cells in ([], [0], [254], [255], [0, 1, 255, 510, 511, 100_000]):
        array = np.array(cells, np.int64)
        assert decode_gaps(encode_gaps(array)).tolist() == cells


def test_messages_of_sparse_cells_stay_small():
    import numpy as np

    top = 1 << substring_dedup.SHARD_BITS
    for step in (1, 127, 128, 255, 256, 16_383, 16_384, 1 << 20, top - 1):
        cells = np.arange(0, top, step)
        raw = encode_gaps(cells)
        assert decode_gaps(raw).tolist() == cells.tolist()
        assert len(raw) <= 4 * len(cells)


def test_own_candidates_come_back():
    import numpy as np

    for bounds, starts, of in (([(3, 0, 2), (9, 2, 5)], [7, 1, 9, 2, 0, 4], [0, 1, 2, 3, 4, 4]), ([], [], [])):
        raw = substring_dedup.pack_candidates(bounds, np.array(starts, np.int64), np.array(of, np.int64))
        got = substring_dedup.unpack_candidates(raw)
        assert (got[0], got[1].tolist(), got[2].tolist()) == (bounds, starts, of)


def _brute_components(texts, percent):
    sets = []
    for text in texts:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    label = list(range(len(texts)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                x, y = sorted((root(i), root(j)))
                label[y] = x
    return [root(i) for i in range(len(texts))], [len(s) for s in sets]


def _near_texts():
    rng = random.Random(8)
    texts = []
    for _ in range(6):  # copies of a copy of a copy, and copies around one text
        base = prose(rng, rng.choice([60, 150, 400]))
        chain = list(base)
        for _ in range(7):
            chain = list(chain)
            for _ in range(len(chain) // 100 + 1):
                chain[rng.randrange(len(chain))] = "x"
            texts.append(" ".join(chain))
            star = list(base)
            for _ in range(len(star) // 60 + 1):
                star[rng.randrange(len(star))] = f"y{rng.randrange(9)}"
            texts.append(" ".join(star))
    passage = prose(rng, 30)
    texts += [" ".join(prose(rng, 40) + passage + prose(rng, 40)) for _ in range(12)]
    texts += ["Same text here now ok", "same TEXT here now ok", "few words", "few words", None, "", " ", "one", "É é É é É", "é É é É é"]
    return texts


def test_near_components_equal_brute_force(spark):
    texts = _near_texts()
    want, sizes = _brute_components(texts, 85)
    got = {r.doc_id: r for r in near_components(documents(spark, texts)).collect()}
    assert [got[i].component_id for i in range(len(texts))] == want
    assert [got[i].n_shingles for i in range(len(texts))] == sizes
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_near_components_of_empty_and_repeated_rows(spark):
    docs = documents(spark, ["a b c d e f g", None])
    assert near_components(docs.limit(0)).count() == 0
    assert sorted(r.component_id for r in near_components(docs.union(docs)).collect()) == [0, 0, 1, 1]
    nobody = spark.createDataFrame([(None, "a b c d e f"), (None, None), (4, "a b c d e f")], "doc_id long, text string")
    assert [(r.doc_id, r.component_id, r.kept) for r in near_components(nobody).orderBy("n_shingles", "kept").collect()] == [
        (None, None, True), (None, 4, False), (4, 4, True),
    ]


def test_full_sets_are_one_for_each_class(spark):
    from pyspark.sql import functions as F

    base = prose(random.Random(4), 100)
    texts = [" ".join(base)] * 8 + [" ".join([*base[:-1], "x"])] * 7
    docs = documents(spark, texts).select(F.lit(1).alias("id"), F.col("text").cast("binary").alias("text")).repartition(3)
    made = near_dedup._sets(5)([texts[0].encode(), texts[8].encode()])
    pairs = spark.createDataFrame([(bytearray(made[0][0]), bytearray(made[0][1]), 1, 1)], "a binary, b binary, ida int, idb int")
    wanted = pairs.selectExpr("a AS key", "ida AS id").union(pairs.select("b", "idb"))
    sets = near_dedup._full_sets(docs, wanted, 5)
    assert sets.count() == 2
    assert near_dedup._confirmed(pairs, sets, 85).count() == 1


def _prefix_pairs(spark, texts, parts=None):
    """What the prefix filter leaves of the classes of ``texts``, as places in it, and the sets."""
    of = near_dedup._sets(5)([t.encode() for t in texts])
    place = {key: i for i, key in enumerate(of[0])}
    assert None not in place
    sets = [[int(h) for h in hashes] for hashes in of[1]]
    rest = spark.createDataFrame([(bytearray(k), parts[i] if parts else i) for k, i in place.items()], "key binary, part long")
    held = spark.createDataFrame([(bytearray(k), sets[i]) for k, i in place.items()], "key binary, hashes array<long>")
    rows = near_dedup._meeting(rest, held, 85).collect()
    return [tuple(sorted((place[bytes(r.a)], place[bytes(r.b)]))) for r in rows], [set(s) for s in sets]


def test_prefixes_lose_no_link_and_pages_of_a_template_do_not_meet(spark):
    texts = list(dict.fromkeys(" ".join(words(t.lower())) for t in _near_texts() if words(t)))
    got, sets = _prefix_pairs(spark, texts)
    linked = {
        (i, j) for j in range(len(sets)) for i in range(j) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])
    }
    assert len(got) == len(set(got)) and linked <= set(got) and len(linked) > 15
    parts = [i // 2 for i in range(len(sets))]
    got, _ = _prefix_pairs(spark, texts, parts)
    assert {(i, j) for i, j in linked if parts[i] != parts[j]} <= set(got) and all(parts[i] != parts[j] for i, j in got)
    rng = random.Random(6)
    common = prose(rng, 400)
    pages = [" ".join(common + [f"p{i}w{k}" for k in range(46)]) for i in range(60)]
    assert _prefix_pairs(spark, pages)[0] == []


def test_one_document_of_each_group_stays(spark):
    texts = _near_texts()
    want, _ = _brute_components(texts, 80)
    docs = documents(spark, texts)
    kept = keep_one(docs.union(docs.limit(3)), percent=80)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want))
    same = spark.createDataFrame([(1, "a b c", "z"), (1, "a b c", "k"), (2, "a b c", "a")], "doc_id long, text string, _row string")
    assert [tuple(r) for r in keep_one(same).collect()] == [(1, "a b c", "k")]


def test_components_of_chains_and_loops(spark):
    links = [(i + 1, i) for i in range(0, 40)] + [(50, 51), (51, 50), (60, 60)] + [(100, 100 + i) for i in range(1, 30)]
    got = {r.node: r.label for r in component_labels(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 51: 50, **{100 + i: 100 for i in range(1, 30)}}
    assert component_labels(spark.createDataFrame([], "a long, b long")).count() == 0


def test_estimates_follow_the_similarity():
    import numpy as np

    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**64 - 1, 4000, dtype=np.uint64)
    a, b = np.unique(pool[:3000]), np.unique(pool[500:3500])
    left, right = near_dedup.registers_of([a, b])
    guess, used = near_dedup.estimates(left[None], right[None])
    assert used[0] == near_dedup.REGISTERS and abs(guess[0] - 2500 / 3500) < 0.15


BENCHMARK = [(1, "One two three four five six seven eight nine ten eleven"), (2, "short item"), (3, "..."), (4, None), (5, "SHORT, item!"), (10, "uno é dos")]


@pytest.mark.parametrize("broadcast", [True, False])
def test_contamination_equals_brute_force(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", -1)
    rng = random.Random(5)
    eleven = BENCHMARK[0][1].lower().split()
    texts = [" ".join(rng.choice(eleven) for _ in range(60)) for _ in range(5)]
    texts += ["zero ONE, two-three four five six seven eight nine TEN eleven", "two three four five six seven eight nine ten eleven one"]
    texts += ["a short\nitem short item", "unoédos uno É dos uno é dos", None, "", "...", "item", texts[5], "x " * 3000 + "short item"]

    def split(text):
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)

    benchmark = spark.createDataFrame(BENCHMARK, "item_id long, text string").selectExpr("*", "1 AS words", "2 AS items")
    got = {r.doc_id: r for r in contamination(documents(spark, texts), benchmark).collect()}
    for k, text in enumerate(texts):
        w, hit, items = split(text), set(), set()
        for item, content in BENCHMARK:
            b = split(content)
            n = min(10, len(b))
            grams = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if n else set()
            for i in range(len(w) - n + 1):
                if n and tuple(w[i : i + n]) in grams:
                    hit.update(range(i, i + n))
                    items.add(str(item))
        assert (got[k].n_words, got[k].n_hit, got[k].items) == (len(w), len(hit), sorted(items)), k
        assert got[k].contaminated == bool(hit) and got[k].n_items == len(items)
    docs = documents(spark, texts)
    clean = drop_contaminated(docs, benchmark)
    assert clean.columns == docs.columns
    assert sorted(r.doc_id for r in clean.collect()) == sorted(k for k in got if not got[k].contaminated)
    assert contamination(docs, benchmark.limit(0)).where("contaminated").count() == 0
    assert contamination(docs.limit(0), benchmark).count() == 0
    assert contamination(docs.union(docs), benchmark).count() == 2 * len(texts)


def test_url_verdicts(spark):
    rules = [Rule("com", "/", "allow"), Rule("example.com", "/en/", "block"), Rule("www.example.com", "/en/", "allow"), Rule("net", "/es/", "block")]
    cases = {
        "http://Example.COM/en/x": ("example.com", "/en/x", "example.com/en/", "block"),
        "https://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        "http://badexample.com/en/": ("badexample.com", "/en/", "com/", "allow"),
        "http://a.net/es?x": ("a.net", "/es", None, "allow"),
        "http://a.net/es/?x": ("a.net", "/es/", "net/es/", "block"),
        "http://listed.org/p/#f": ("listed.org", "/p/", None, "block"),
        "ftp://LISTED.org/p?q://z": ("listed.org", "/p", None, "block"),
        "http://listed.org/P": ("listed.org", "/P", None, "allow"),
        "http://com?x": ("com", "", None, "allow"),
        "no address": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    pages = spark.createDataFrame(list(enumerate(cases)), "page_id long, url string").selectExpr("*", "'h' AS host", "'v' AS verdict")
    listed = spark.createDataFrame([("listed.org/p",), ("listed.org/p",), ("",), (None,), ("com",)], "canonical string").where("canonical <> 'com'")
    for blocks in (65_536, 1):  # one block lets nearly everything through to the exact join
        got = {r.page_id: r for r in filter_urls(pages, listed, rules, blocks=blocks).collect()}
        for i, (url, want) in enumerate(cases.items()):
            assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == want, url
    assert filter_urls(pages.limit(0), listed, rules).count() == 0
    assert filter_urls(pages, listed.limit(0), rules).where("rule IS NULL AND verdict = 'block'").count() == 0


def test_quality_counts_equal_brute_force(spark):
    rng = random.Random(9)
    common = "the of and to in is it he was for".split()
    texts = [" ".join(rng.choice(common) if rng.random() < 0.5 else f"wo{rng.randrange(99)}d" for _ in range(150)) + "." for _ in range(40)]
    texts += ["X!! Y!! " * 90, "a b c d e f g h " * 9, "l one\nl one\n\n \nl one\nx", "# $ % * & | < > é", None, "", " \n", "w" * 9000, "one " * 7, texts[0]]
    docs = documents(spark, texts)
    got = {r.doc_id: r for r in quality_rules(docs).collect()}
    for k, text in enumerate(texts):
        w = words(text)
        grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        repeated = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [line for line in (text or "").split("\n") if words(line)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated))
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, k
        assert r.base_failed == (len(w) < 20 or 100 * len(repeated) > 30 * len(w))
        assert not (r.base_failed and r.kept)
    assert all(got[k].kept for k in range(40)) and not got[40].kept
    kept = keep_good(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(k for k in got if got[k].kept)
    assert quality_rules(docs.limit(0)).count() == 0


def test_rare_languages_have_a_reference_of_their_own(spark):
    rng = random.Random(3)

    def prose_of(common, letters, n):
        return " ".join(rng.choice(common) if rng.random() < 0.5 else "".join(rng.choices(letters, k=6)) for _ in range(n))

    english = [prose_of("the of and to in is it he was for".split(), "abcdefghijklm", 150) for _ in range(994)]
    latin = [prose_of("et non in est ad ut cum sed quod si".split(), "nopqrstuvwxyz", 150) for _ in range(3)]
    han = [prose_of("的 一 是 不 了".split(), "天地玄黃宇宙洪荒日月", 60) for _ in range(2)]
    junk = [" ".join(f"{rng.randrange(10**6)}%" for _ in range(150))]
    langs = ["en"] * 994 + ["la"] * 3 + ["zh"] * 2 + ["en"]
    rows = [(i, text, lang) for i, (text, lang) in enumerate(zip([*english, *latin, *han, *junk], langs))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    lost = sorted(r.doc_id for r in quality_rules(docs).where("NOT kept").collect())
    assert lost == [999]
    # A junk text of a rare language is far from it too; a language alone below the share is judged by itself.
    odd = docs.union(spark.createDataFrame([(1000, junk[0], "la")], docs.schema))
    assert 1000 in {r.doc_id for r in quality_rules(odd).where("NOT kept").collect()}
    assert quality_rules(docs, min_share=1.1).where("kept").count() == 999


def test_distances_equal_direct_computation(spark):
    import math

    from pyspark.sql import functions as F

    from leadspark.llm.quality_rules import _nearest

    rng = random.Random(2)
    q = [[rng.random() for _ in range(5)] for _ in range(3)]
    q = [[x / sum(row) for x in row] for row in q]
    p = [0.5, 0.0, 0.2, 0.3, 0.0]

    def distance(p, q):
        m = [(a + b) / 2 for a, b in zip(p, q)]
        return math.sqrt(sum(a * math.log2(a / c) if a else 0 for a, c in zip(p, m)) / 2 + sum(b * math.log2(b / c) if b else 0 for b, c in zip(q, m)) / 2)

    present = "array(" + ", ".join(f"struct({i + 1} AS at, {x!r}D AS p)" for i, x in enumerate(p) if x) + ")"
    got = spark.range(1).select(F.expr(_nearest(present, q))).first()[0]
    assert abs(got - min(distance(p, row) for row in q)) < 1e-9


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(7)
    good = [" ".join(rng.choice(["the", "of", "and"]) if rng.random() < 0.4 else f"wo{rng.randrange(300)}d" for _ in range(120)) for _ in range(12)]
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    texts = good + [good[0] + " end", "short", None, good[1][:300] + " " + item + " " + good[2][:300], good[3] + " more words password=hunter2222"]
    docs = documents(spark, texts).selectExpr("doc_id", "text", "lang", "'s' AS source", "CAST(length(text) AS BIGINT) AS n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at, counts = docs, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, at, str(tmp_path)).write.parquet(f"{tmp_path}/{i}")
        at = spark.read.parquet(f"{tmp_path}/{i}")
        counts.append(at.count())
        if i < 4:
            assert at.columns == docs.columns
    assert counts[0] == 15 and counts[2] == counts[3]
    assert at.select("doc_id").distinct().count() == 12
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, whole.drop("sequence_id", "offset").collect())) == sorted(map(tuple, at.drop("sequence_id", "offset").collect()))
