"""Filter audit, document fingerprints and spelling groups against brute force on small fixtures."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from leadspark.llm import filter_audit as audit_module
from leadspark.llm import spelling
from leadspark.llm.filter_audit import failed_filters, filter_audit, possible_repeats
from leadspark.llm.fingerprints import differing_digests, document_fingerprints, likeness, paragraph_digests
from leadspark.llm.queries import misspelt_words
from leadspark.llm.spelling import Acceptor, near_words, spelling_groups

# ---------------------------------------------------------------- filter audit

LONG_TEXT = " ".join(f"word{i}" for i in range(150))
AUDIT_ROWS = [
    (5, "short", "en"),
    (1, LONG_TEXT, "en"),
    (7, LONG_TEXT, "en"),
    (9, LONG_TEXT, None),
    (2, "UPPER CASE TEXT", "de"),
    (3, "same " * 200, "de"),
    (4, "a|b $5 " + LONG_TEXT, None),
    (6, None, "en"),
    (8, "", "en"),
    (10, " \n\t", "de"),
    (11, LONG_TEXT + " É", "en"),
    (11, LONG_TEXT + " É", "en"),
    (None, LONG_TEXT, "en"),
    (12, "ü" * 200_000, "de"),
]
AUDIT_LABELS = [(1, 1, 0), (7, 1, 1), (7, 0, None), (2, 0, 1), (99, 1, 1), (None, 1, 1), (5, None, None)]


def audit_docs(spark, rows):
    made = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return made.selectExpr("*", "1 AS n", "'x' AS part", "'y' AS failed", "2 AS id", "3 AS hash", "4 AS block", "true AS good")


def expected_failures(rows):
    smallest = {}
    for doc, text, _ in rows:
        if doc is not None:
            smallest[text or ""] = min(doc, smallest.get(text or "", doc))
    found = []
    for doc, text, lang in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        failed = ""
        failed += "A" * (len(words) < 100)
        failed += "B" * (100 * len(set(words)) < 80 * len(words))
        failed += "C" * (100 * len(re.findall("[A-Z]", text)) > 10 * len(text))
        failed += "D" * bool(re.search("[#$%&*|]", text))
        failed += "E" * (doc is not None and doc > smallest[text])
        found.append((doc, lang or "", failed))
    return found


@pytest.mark.parametrize("bitmaps", [audit_module.BROADCAST_BITMAPS, 0])
def test_filter_audit_equals_brute_force(spark, monkeypatch, bitmaps):
    monkeypatch.setattr(audit_module, "BROADCAST_BITMAPS", bitmaps)
    docs = audit_docs(spark, AUDIT_ROWS)
    flags = expected_failures(AUDIT_ROWS)
    got = [tuple(row) for row in failed_filters(docs).collect()]
    assert sorted(got, key=repr) == sorted(flags, key=repr)
    labels = spark.createDataFrame(AUDIT_LABELS, "doc_id long, quality int, toxic int").selectExpr("*", "'z' AS part", "1 AS id")
    good = {doc for doc, quality, _ in AUDIT_LABELS if quality == 1} - {None}
    toxic = {doc for doc, _, flag in AUDIT_LABELS if flag == 1} - {None}
    want = {}
    for order in map("".join, permutations("ABCDE")):
        for part in {p for _, p, _ in flags}:
            alive = [(doc, failed) for doc, p, failed in flags if p == part]
            every = list(alive)
            for step, letter in enumerate(order, 1):
                removed = [(doc, failed) for doc, failed in alive if letter in failed]
                alive = [(doc, failed) for doc, failed in alive if letter not in failed]
                failing = sum(letter in failed for _, failed in every)
                want[part, order, step] = [
                    len(alive),
                    len(removed),
                    failing - len(removed),
                    sum(failed == letter for _, failed in every),
                    sum(doc in good for doc, _ in removed),
                    sum(doc in toxic for doc, _ in removed),
                ]
    shapley = Counter()
    for (part, order, step), counts in want.items():
        shapley[part, order[step - 1]] += counts[1]
    made = filter_audit(docs, labels).collect()
    assert len(made) == len(want) == 3 * 600
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    for row in made:
        key = row.part, row.filter_order, row.step
        assert [row[name] for name in names] == want[key], key
        assert row.shapley == shapley[row.part, row.filter_order[row.step - 1]]
    assert filter_audit(docs.limit(0), labels).count() == 0
    assert filter_audit(docs, labels.limit(0)).agg(F.sum("good_lost"), F.sum("toxic_lost")).first() == (0, 0)


def test_prepass_passes_every_repeat_and_clears_most_unique_texts(spark):
    texts = [f"text {i}" for i in range(4000)] + [f"twice {i % 100}" for i in range(200)] + ["hot"] * 1500
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumn("hash", F.xxhash64("text"))
    blocks = -(-len(texts) * audit_module.CELLS_PER_TEXT // audit_module.BITMAP_BITS)
    passed = Counter(row.text for row in possible_repeats(rows, blocks).collect())
    assert all(passed[text] == times for text, times in Counter(texts).items() if times > 1)
    assert sum(times == 1 for times in Counter(texts).values()) == 4000
    assert sum(text.startswith("text") for text in passed) < 80


# ---------------------------------------------------------------- fingerprints


def paragraphs(text):
    cut, out = "", []
    for sentence in re.findall(r"[^.!?\n]*[.!?\n]+|[^.!?\n]+", text or ""):
        cut += sentence
        if "\n" in sentence or len(sentence) % 4 == 0:
            out.append(cut)
            cut = ""
    return {p for p in [*out, cut] if p}


def jaccard(one, other):
    return len(one & other) / len(one | other) if one | other else 1.0


def story(rng, sentences):
    parts = [" ".join(f"w{rng.randrange(300)}" for _ in range(rng.randint(1, 9))) + rng.choice([".", "!", ".\n", "? "]) for _ in range(sentences)]
    return "".join(parts)


def test_fingerprints_equal_brute_force(spark):
    rng = random.Random(7)
    texts = [story(rng, rng.randint(1, 60)) for _ in range(40)] + [None, "", "x", "äöü" * 7, texts_long(rng), "Same.\n" * 50]
    texts += [texts[3], texts[3]]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS own", "2 AS id", "'k' AS hash", "3 AS _x", "4 AS n_chars")
    got = {row.doc_id: row for row in document_fingerprints(docs).collect()}
    assert len(got) == len(rows)
    texts = [text or "" for text in texts]
    for doc, text in enumerate(texts):
        following = texts[doc - 1]  # descending, and after the last (0) the first
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        row = got[doc]
        assert row.n_chars == len(text)
        assert row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert row.near_edited == pytest.approx(jaccard(paragraphs(text), paragraphs(edited))), doc
        assert row.near_next == pytest.approx(jaccard(paragraphs(text), paragraphs(following))), doc
    prints = {}
    for doc, text in enumerate(texts):
        assert prints.setdefault(text, got[doc].fingerprint) == got[doc].fingerprint
    assert len(set(prints.values())) == len(prints)
    assert document_fingerprints(docs.limit(0)).count() == 0


def texts_long(rng):
    return story(rng, 4000)


def test_fingerprints_of_repeated_and_null_ids(spark):
    rows = [(1, "One.\nTwo.\n"), (1, "One.\nTwo.\n"), (None, "Three.\n"), (1, "Four.\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((row.doc_id, row.n_chars) for row in document_fingerprints(docs).collect()), key=repr)
    assert got == sorted([(1, 10), (1, 10), (None, 7), (1, 6)], key=repr)
    alone = document_fingerprints(docs.where("doc_id IS NULL")).first()
    assert alone.near_next == 1.0


@pytest.mark.parametrize("sizes", [(0, 0, 0), (0, 5, 0), (3, 0, 2), (50, 9, 11), (10, 400, 300), (0, 3000, 1)])
def test_peeling_recovers_every_difference(spark, sizes):
    both, one, other = sizes
    rng = random.Random(sum(sizes))
    keys = rng.sample(range(1 << 60), both + one + other)
    left, right = keys[: both + one], keys[:both] + keys[both + one :]
    row = spark.createDataFrame([(left, right)], "a array<bigint>, b array<bigint>")
    found, near = row.select(differing_digests(F.col("a"), F.col("b")), likeness(F.col("a"), F.col("b"))).first()
    assert sorted((k, c) for c, k in found) == sorted([(k, 1) for k in left[both:]] + [(k, -1) for k in right[both:]])
    assert near == pytest.approx(jaccard(set(left), set(right)))


def test_an_edit_moves_no_other_paragraph(spark):
    text = "".join(f"Sentence number {i} of {'x' * (i % 7)}.\n" if i % 5 == 0 else f"Part {i} {'y' * (i % 6)}. " for i in range(60))
    changed = text.replace("Part 31 ", "Piece 31, changed, ")
    row = spark.createDataFrame([(text, changed)], "a string, b string").select(paragraph_digests(F.col("a")).alias("a"), paragraph_digests(F.col("b")).alias("b"))
    assert row.select(F.size(F.array_except("a", "b")) + F.size(F.array_except("b", "a"))).first()[0] <= 5


# ---------------------------------------------------------------- spelling


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected_groups(counts, ratio=10):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for word, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        if best is not None and counts[best] >= ratio * counts[word]:
            form[word] = best
    rows = []
    for word, n in counts.items():
        root = word
        while root in form:
            root = form[root]
        rows.append((word, form.get(word), root, n, len(near[word]), counts.get(form.get(word))))
    return sorted(rows)


def vocabulary(rng, size):
    words = set()
    while len(words) < size:
        word = "".join(rng.choice("abcé") for _ in range(rng.randint(1, 7)))
        words |= {word, word + rng.choice("abc")}
    words |= {"a" * k for k in range(1, 12)} | {"", "ÿÿÿ", "ÿÿ", "a😀b", "ab"}
    return sorted(words)


def test_acceptor_is_minimal_and_its_pairs_are_all_pairs():
    words = vocabulary(random.Random(3), 250)
    acceptor = Acceptor(words)
    assert acceptor.size[0] == len(words)
    signatures = [(acceptor.final[s], tuple(acceptor.arcs[s].items())) for s in acceptor.order]
    assert len(set(signatures)) == len(signatures)
    left, right = acceptor.pairs()
    found = [frozenset((words[i], words[j])) for i, j in zip(left, right, strict=True)]
    want = {frozenset((a, b)) for a in words for b in words if a < b and one_edit(a, b)}
    assert len(found) == len(set(found))
    assert set(found) == want
    import numpy as np

    assert near_words(["x"], np.array([3])) == []


@pytest.mark.parametrize("group", [4096, 40, 3])
def test_spelling_groups_equal_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(spelling, "GROUP_WORDS", group)
    monkeypatch.setattr(spelling, "DEPTHS", 2)
    rng = random.Random(5)
    long = "".join(rng.choice("xyz") for _ in range(100))
    words = vocabulary(rng, 200) + [long, long + "q", long + "qq", "q" + long, long[:50] + "q" + long[51:], long[:-1], "z" * 3000, "z" * 3001]
    counts = {word: 10 ** rng.randint(0, 5) + rng.randint(0, 3) for word in words}
    rows = [(word, n - 1) for word, n in counts.items()] + [(word, 1) for word in counts] + [(None, 5), ("gone", 0), ("nil", None)]
    frame = spark.createDataFrame(rows, "word string, n long").selectExpr("*", "'r' AS root", "1 AS depth", "2 AS form")
    got = sorted(tuple(row) for row in spelling_groups(frame).select("word", "form", "root", "n", "n_near", "form_n").collect())
    assert [(*row[:4], *row[4:]) for row in got] == expected_groups(counts)
    assert spelling_groups(frame.limit(0)).count() == 0


def test_words_of_documents_equal_brute_force(spark):
    rng = random.Random(11)
    base = ["Wonderful", "ÀÉÎõüÿß", "letters", "sevenlt", "longerword", "short"]
    texts = [" ".join(rng.choice(base) for _ in range(200)) + rng.choice([".", "1", "_x"]) for _ in range(40)] + [None, "", "é" * 200_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS run", "2 AS id", "3 AS h")
    counts = Counter()
    for doc, text in enumerate(texts):
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{doc}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    want = sorted((w, n) for w, n in counts.items() if n >= 2 and len(w) >= 7)
    assert sorted(tuple(row) for row in misspelt_words(docs).collect()) == want
    assert len(want) > 5
