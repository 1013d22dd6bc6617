"""Token counts, packing, secrets, language and quality scores against the library or brute force."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from leadspark.llm.language_id import identify
from leadspark.llm.packing import best_fill, pack, plan
from leadspark.llm.quality_knn import quality_scores
from leadspark.llm.secret_scan import dense_windows, redact_secrets, secret_spans, span_digest
from leadspark.llm.token_counts import PairRanks, token_counts

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
EDGES = [
    None, "", " \n\t", "a", "aaaaaaa " * 50, "a" * 30_000, "don't we'll I'M", "ΑΣ ΑΣ İ ß ẞ ﬁ", "² ½ Ⅷ ٣ 12345",
    "x\x1cy\x1dz", "é e\u0301 A\u030a", "<|endoftext|>a<|startoftext|><|endoftext|>", "<|endoftext", "一二三 😀👩‍👩‍👧", "tie tie tie", "tie tie tie",
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(VOCABULARY)


def documents(spark, texts, extra="'x' AS n_words, 1 AS id, 2 AS text2, 'y' AS kept"):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return rows.selectExpr("*", *extra.split(", ")) if extra else rows


def test_token_counts_equal_the_library(spark, tokenizer):
    got = {r.doc_id: r for r in token_counts(documents(spark, EDGES), VOCABULARY, limit=3).collect()}
    for i, text in enumerate(EDGES):
        want = len(tokenizer.encode(text or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes) == (want, len((text or "").encode())), repr(text)[:60]
        assert got[i].over_limit == (want > 3)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abcdlnorstuAΣé's 1²_-!\u0301\n", max_size=60), max_size=8))
def test_symbols_left_equal_the_library(texts):
    from leadspark.llm.token_counts import _counter

    tokenizer = Tokenizer.from_file(VOCABULARY)
    counter = test_symbols_left_equal_the_library.__dict__.setdefault("counter", _counter(VOCABULARY))
    assert counter(texts)[1] == [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]


def test_pairs_that_overlap_are_merged_from_the_left():
    assert PairRanks(VOCABULARY).count([b"a", b"aa", b"aaa"]).min() >= 1


def test_empty_tables(spark):
    empty = documents(spark, ["x"], extra="").limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert token_counts(empty, VOCABULARY).count() == 0
    assert pack(empty, VOCABULARY).count() == 0
    assert secret_spans(empty).count() == 0
    assert identify(empty.selectExpr("*", "'en' AS lang")).count() == 0
    assert quality_scores(empty, labels).count() == 0


def test_best_fill_finds_the_largest_sum():
    random.seed(3)
    for _ in range(60):
        left = {random.randint(1, 12): random.randint(1, 3) for _ in range(4)}
        room = random.randint(0, 40)
        sums = {0}
        for length, n in left.items():
            sums = {s + k * length for s in sums for k in range(n + 1)}
        chosen = best_fill(left, room)
        assert sum(x * n for x, n in chosen) == max(s for s in sums if s <= room)
        assert all(n <= left[x] for x, n in chosen)


def test_plan_places_every_piece_once():
    random.seed(5)
    histogram = {random.randint(1, 64): random.randint(1, 9) for _ in range(30)}
    used = dict.fromkeys(histogram, 0)
    filled = {}
    for length, first, copies, window, times, offset in plan(histogram, 64).tolist():
        assert used[length] == first
        used[length] += copies * times
        for turn in range(times):
            filled.setdefault(window + turn, []).extend((offset + k * length, length) for k in range(copies))
    assert used == histogram
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64


def test_packing_round_trip(spark, tokenizer):
    random.seed(2)
    texts = EDGES + [" ".join(random.choice(["tion", "he", "reing", "12"]) for _ in range(n)) for n in (3, 40, 500, 2000)]
    rows = documents(spark, texts).union(documents(spark, texts).limit(2))
    got = pack(rows, VOCABULARY, window=256).collect()
    ids = [np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for t in texts]
    assert sum(r.length for r in got) == sum(map(len, ids)) + len(ids[0]) + len(ids[1])
    ends = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
        assert r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
    assert max(ends.values()) <= 256
    assert sum(1 for used in ends.values() if used < 256) <= 1 + len(ends) // 10


SECRETS = [
    'password = "hunter22" and TOKEN:abc', "secret=token: abcdefgh", "api_key='k1' apikey=abcdef", "AKIA" + "A" * 16 + " AKIAB",
    "deadbeef" * 3 + " " + "deadbee" * 3, "ſecret=abcdefgh toKen=abcdefgh", "é" * 5 + "passwd: x.y/z_1", None, "", "plain words only",
]


def test_secret_base_spans_equal_brute_force(spark):
    kinds = [
        ("assign", r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6),
        ("access", r"(AKIA[A-Z0-9]+)", 20),
        ("hex", r"([0-9a-f]+)", 24),
    ]
    got = {r.doc_id: r for r in span_digest(secret_spans(documents(spark, SECRETS))).collect()}
    for i, text in enumerate(SECRETS):
        found = []
        for order, (kind, pattern, least) in enumerate(kinds):
            flags = re.ASCII | re.IGNORECASE if kind == "assign" else 0
            found += [(m.start(), order, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text or "", flags) if len(m[1]) >= least]
        base = ",".join(shown for *_, shown in sorted(found))
        assert got[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest(), text
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(f":{k}:" in f":{s}" for *_, s in found) for k, *_ in kinds]


def test_windows_of_high_entropy_equal_direct_counting():
    random.seed(1)
    for _ in range(40):
        text = "".join(random.choice("abcdefgh12345678"[: random.randint(1, 16)]) for _ in range(60))
        marked = [False] * 60
        for i in range(60 - 12 + 1):
            part = text[i : i + 12]
            entropy = -sum(part.count(c) / 12 * math.log2(part.count(c) / 12) for c in set(part))
            if entropy >= 2.5 - 1e-12:
                marked[i : i + 12] = [True] * 12
        covered = [False] * 60
        for start, end in dense_windows(text, 12, 2.5):
            covered[start:end] = [True] * (end - start)
        assert covered == marked


def test_entropy_spans_and_their_allow_list(spark):
    key = "hT7kQ2mZ9xLw4Rb8Vn3PyC6d"
    texts = [f"use {key} now", f"sha256:{key}", f"https://a.b/{key}", "f47ac10b-58cc-4372-a567-0e02b2c3d479", "Donaudampfschiffahrtsgesellschaft"]
    got = {r.doc_id: r.spans for r in span_digest(secret_spans(documents(spark, texts))).collect()}
    assert got[0] == "entropy:4:28"
    assert [got[i] for i in range(1, 5)] == ["", "", "", ""]


def test_entropy_of_one_case_and_the_reach_of_the_allow_list(spark):
    key = "hT7kQ2mZ9xLw4Rb8Vn3PyC6d"
    far = "https://a.b/" + "path/" * 80 + key
    texts = ["use k3v9x0q2m7z4w8r1t6y5p and", "use Q7ZK2M9XW4RB8VN3PYC6D5T and", f"docs/example/{key}", f"xxxx-{key}", f"https://a.b/{key}"]
    texts += [far, f'{{"u":"https://a.b/","k":"{key}"}}', "internationalization2024", "exampleK7q2mZ9xLw4Rb8V", "see commit k3v9x0q2m7z4w8r1t6y5p"]
    got = {r.doc_id: r.spans for r in span_digest(secret_spans(documents(spark, texts))).collect()}
    assert [got[i] for i in range(10)] == ["entropy:4:25", "entropy:4:27", "entropy:12:37", "entropy:4:29", "", "", "entropy:25:49", "", "", ""]


def test_redaction_keeps_rows_and_columns(spark):
    rows = documents(spark, ["a password=hunter22 b", None, "clean"], extra="").selectExpr("*", "7 AS n_chars", "'k' AS spans")
    got = sorted(redact_secrets(rows).collect())
    assert redact_secrets(rows).columns == rows.columns
    assert [r.text for r in got] == ["a [SECRET] b", None, "clean"]
    assert [r.n_chars for r in got] == [12, 7, 7]


def _in_language(rng, lang):
    words = {"en": "the and of house water green".split(), "de": "der und straße wasser grün über".split()}[lang]
    return " ".join(rng.choice(words) for _ in range(30))


def test_language_held_out_accuracy_and_edges(spark):
    rng = random.Random(4)
    rows = [(i, _in_language(rng, "en" if i % 2 else "de"), "en" if i % 2 else "de", "s") for i in range(240)]
    rows += [(1000, None, "en", None), (1001, "123 !!", None, None), (1002, "", "de", "s"), (None, "the water", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = {r.doc_id: r for r in identify(docs, sample_per_language=60).collect()}
    assert len(got) == len(rows)
    for i in range(240):
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert got[i].lang_pred == rows[i][2] and 0 <= got[i].score <= 1
    assert {got[i].lang_pred for i in (1000, 1001, 1002)} == {"und"}


def test_every_language_is_learned(spark):
    rng = random.Random(8)
    words = [["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=8)) for _ in range(3)] for _ in range(104)]
    rows = [(i, " ".join(rng.choices(words[i % 104], k=12)), f"l{i % 104:03}") for i in range(104 * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in identify(docs, epochs=20).collect()}
    assert len(set(got.values())) > 100
    assert sum(got[i] == lang for i, _, lang in rows) > 0.97 * len(rows)


def test_the_driver_sees_no_features(spark, monkeypatch):
    from leadspark.llm import language_id

    frame, seen = type(spark.range(0)), []
    kept = frame.collect
    monkeypatch.setattr(frame, "collect", lambda self: seen.append(self.columns) or kept(self))
    monkeypatch.setattr(language_id, "PART_TEXTS", 40, raising=False)  # several parts
    rng = random.Random(4)
    rows = [(i, _in_language(rng, "en" if i % 2 else "de"), "en" if i % 2 else "de") for i in range(240)]
    rows += [(1000 + i, "solo mio amore", "it") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in kept(identify(docs))}
    assert all(got[i] == lang for i, _, lang in rows[:240])
    assert seen and not any({"buckets", "shares"} & set(columns) for columns in seen)


def test_votes_are_those_of_plain_cosines():
    import numpy as np

    from leadspark.llm.quality_knn import BLOCK_ROWS, Space, votes

    rng = np.random.default_rng(5)
    voters = rng.normal(size=(40, 6))
    voters /= np.linalg.norm(voters, axis=1, keepdims=True)
    labels = rng.integers(0, 2, 40).astype(float)
    rows = rng.normal(size=(BLOCK_ROWS + 30, 6))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    rows[7] = 0
    got = votes(rows, Space(None, None, voters, labels, 0.25), 5, 4.0)
    for row, score in zip(rows, got, strict=True):
        near = sorted(((float(row @ v), y) for v, y in zip(voters, labels, strict=True)), reverse=True)[:5]
        weights = [max(c, 0.0) ** 4 for c, _ in near]
        want = sum(w * y for w, (_, y) in zip(weights, near, strict=True)) / sum(weights) if sum(weights) else 0.25
        assert abs(score - want) < 1e-9


def test_repeated_ids_add_no_voters(spark, monkeypatch):
    frame, seen = type(spark.range(0)), []
    kept = frame.collect
    monkeypatch.setattr(frame, "collect", lambda self: seen.append(kept(self)) or seen[-1])
    rng = random.Random(7)
    texts = [(i % 10, _in_language(rng, "en") if i % 2 else "BUY!! " * 30, "x") for i in range(600)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, label string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)] * 30, "doc_id long, quality int")
    quality_scores(docs, labels, voters=20)
    assert len(seen) == 1 and 0 < len(seen[0]) == len({(r["id"], r["label"]) for r in seen[0]}) <= 10


def test_quality_held_out_accuracy_and_edges(spark):
    rng = random.Random(6)
    texts = [_in_language(rng, "en") if i % 3 else "BUY!! " * 30 for i in range(240)] + [None, ""]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, label int")
    labels = spark.createDataFrame(
        [(i, int(i % 3 > 0)) for i in range(240)] + [(None, 1), (5, None), (9999, 0)], "doc_id long, quality int"
    )
    got = {r.doc_id: r for r in quality_scores(docs, labels, voters=100).collect()}
    assert len(got) == 242
    assert all(got[i].predicted == int(i % 3 > 0) for i in range(240))
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    none = {r.score for r in quality_scores(docs, labels.limit(0)).collect()}
    assert none == {0.5}


def test_subwords_in_blocks_are_each_words_own(monkeypatch):
    from leadspark.llm import language_id

    def of(words):
        found = [[] for _ in words]
        for places, buckets in language_id.subwords(words):
            for place, bucket in zip(places.tolist(), buckets.tolist(), strict=True):
                found[place].append(bucket)
        return [sorted(held) for held in found]

    words = ["a", "straße", "año", "word", "a", "x" * 50, "日本語", "𝔘ñ"]
    alone = [of([word])[0] for word in words]
    # Marks at both ends: n-grams of 2, 3 and 4 characters, and the word itself.
    assert [len(held) for held in alone] == [sum(max(0, len(w) + 3 - n) for n in (2, 3, 4)) + 1 for w in words]
    assert of(words) == alone
    monkeypatch.setattr(language_id, "BLOCK_CODES", 3)
    assert of(words) == alone
    assert of([]) == []
    assert language_id.words_of("L'Été-2x_y,") == ["l", "été", "x", "y"]


def test_language_sums_are_those_of_the_features():
    from leadspark.llm import language_id

    rng = np.random.default_rng(5)
    model = language_id.Model(["a", "b"], rng.normal(size=(language_id.BUCKETS, 2)), np.eye(2), np.zeros(2), 1.0, 0.0)
    texts = ["The cat's hat, the cat!", "der Hund", "12 34", ""]
    buckets, shares = language_id._features(texts)
    for text, ids, weights in zip(texts, buckets, shares, strict=True):
        sums = language_id._sums(text.split(), model, 2).sum(axis=0)
        if ids:
            assert np.allclose(sums[:2] / sums[2], np.array(weights) @ model.embedding[ids])
        else:
            assert sums[2] == 0


def test_repeated_ids_are_one_text_of_the_sample(spark, monkeypatch):
    from leadspark.llm import language_id

    rows = [(1, f"ein Haus am Fluss {chr(97 + i % 26)}", "de") for i in range(400)]
    rows += [(i, "a house by the river", "en") for i in range(4, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = []
    train = language_id.train

    def seen(sample, *args, **kwargs):
        learned.extend(sample.select("lang", "place").collect())
        return train(sample, *args, **kwargs)

    monkeypatch.setattr(language_id, "train", seen)
    assert zlib.crc32(b"1") % 3 != 1
    assert identify(docs, sample_per_language=5).count() == len(rows)
    assert sorted(learned) == [("de", 1)] + [("en", place) for place in range(1, 6)]
