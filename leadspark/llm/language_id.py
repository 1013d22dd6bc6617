"""Language identification: averaged hashed subword embeddings under a linear softmax.

A word is its character n-grams and itself, hashed to rows of an embedding; a
text is the mean of them. Both layers are trained by stochastic gradient
descent in numpy on a bounded sample, in a few tasks whose weights are averaged
after each epoch. Part of the sample is held back to set the softmax's
temperature and the score under which a prediction is rejected. The driver sees
weights and one number of each held-back text, never the texts' features.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leadspark.llm.common import map_texts
from leadspark.llm.words import mixed
from leadspark.session import cut_lineage

GRAMS = (2, 3, 4)
BUCKETS = 1 << 16
# Ids beyond twice the sample that are ranked for a language: small languages are ranked whole.
SPARE = 200
# Characters whose n-grams are made at once, however long a word is.
BLOCK_CODES = 500_000
# Chunks remembered in a Python worker, before the memory is emptied.
REMEMBERED = 250_000
# The sample is trained on in at most PARTS parts, of about PART_TEXTS texts at least.
PARTS, PART_TEXTS = 8, 500
# Texts whose order is drawn anew in each epoch are held in memory up to this many subwords.
DRAWN = 4_000_000
TEMPERATURES = np.geomspace(0.05, 20, 121)
UNDETERMINED = "und"
_LETTERS = re.compile(r"[^\W\d_]+")


def words_of(chunk: str) -> list[str]:
    """The runs of letters in a chunk, in small letters."""
    runs = _LETTERS.findall(chunk.lower())
    return [word for word in (r if r.isalpha() else "".join(filter(str.isalpha, r)) for r in runs) if word]


def subwords(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in ``words``, buckets) of their n-grams and of whole words, in blocks; boundaries count as characters."""
    if not words:
        return
    codes = np.frombuffer("".join(f"<{word}>" for word in words).encode("utf-32-le"), np.uint32)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    of = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
    starts = np.cumsum(lengths) - lengths
    whole = np.zeros(len(words), np.uint64)
    for first in range(0, len(codes), BLOCK_CODES):
        held = of[first : first + BLOCK_CODES]
        places = (np.arange(first, first + len(held)) - starts[held]).astype(np.uint64)
        np.add.at(whole, held, mixed(places << np.uint64(32) | codes[first : first + BLOCK_CODES].astype(np.uint64)))
        for n in GRAMS:
            # A gram is known by where it begins; the block lends itself the next codes.
            last = of[first + n - 1 : first + n - 1 + len(held)]
            inside = held[: len(last)] == last
            gram = np.full(len(last), n, np.uint64)
            for i in range(n):
                gram = gram * np.uint64(1_114_117) + codes[first + i : first + i + len(last)]
            yield held[: len(last)][inside], _bucket(gram[inside])
    yield np.arange(len(words), dtype=np.int32), _bucket(whole)


def _bucket(hashed: np.ndarray) -> np.ndarray:
    return (mixed(hashed) % np.uint64(BUCKETS)).astype(np.int64)


@dataclass
class Model:
    """The two layers, a row for each bucket and a column for each language, and the calibration."""

    langs: list[str]
    embedding: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    temperature: float
    reject_below: float


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _texts(batch: pa.RecordBatch):
    """(part, lang, held, buckets, shares) of each row of the sample."""
    part, lang, held = (batch.column(n).to_pylist() for n in ("part", "lang", "held"))
    buckets, shares = batch.column("buckets"), batch.column("shares")
    at = buckets.offsets.to_numpy()
    flat, weights = buckets.values.to_numpy(zero_copy_only=False), shares.values.to_numpy(zero_copy_only=False)
    shift = shares.offsets.to_numpy()[0] - at[0]
    for i in range(batch.num_rows):
        rows = slice(at[i], at[i + 1])
        yield part[i], lang[i], held[i], flat[rows], weights[rows.start + shift : rows.stop + shift]


class _Trainer:
    """Stochastic gradient descent over one part's texts of one epoch, as they come."""

    def __init__(self, weights, number: dict[str, int], epoch: int, *, epochs: int, rate: float, batch: int, expected: float):
        self.embedding, self.out, self.bias = (layer.copy() for layer in weights)
        self.number, self.epoch, self.epochs, self.rate, self.batch, self.expected = number, epoch, epochs, rate, batch, expected
        self.random = np.random.default_rng(7 + epoch)
        self.waiting: list[tuple[int, np.ndarray, np.ndarray]] = []
        self.size = self.n = 0

    def add(self, lang: str, buckets: np.ndarray, shares: np.ndarray) -> None:
        self.waiting.append((self.number[lang], buckets, shares))
        self.size += len(buckets)
        if self.size > DRAWN:
            self.flush()

    def flush(self) -> None:
        order = self.random.permutation(len(self.waiting))
        for start in range(0, len(order), self.batch):
            self._step([self.waiting[i] for i in order[start : start + self.batch]])
        self.waiting, self.size = [], 0

    def _step(self, texts) -> None:
        done = (self.epoch + min(1.0, self.n / self.expected)) / self.epochs
        lr = np.float32(self.rate * max(0.0, 1 - done))
        self.n += len(texts)
        means = np.stack([shares @ self.embedding[buckets] for _, buckets, shares in texts])
        error = _softmax(means @ self.out + self.bias)
        error[np.arange(len(texts)), [label for label, *_ in texts]] -= 1
        back = error @ self.out.T
        self.out -= lr * means.T @ error / len(texts)
        self.bias -= lr * error.mean(axis=0) * np.float32(0.1)
        for (_, buckets, shares), change in zip(texts, back, strict=True):
            self.embedding[buckets] -= lr * np.outer(shares, change)


def train(
    sample: DataFrame, n_texts: int, langs: list[str], *, dim: int, epochs: int, rate: float, batch: int, held_back: float,
    reject_share: float,
) -> Model:
    """Fits the two layers in tasks. ``sample``: part, lang, held, buckets and shares (that add up to 1), sorted by part."""
    context = sample.sparkSession.sparkContext
    random = np.random.default_rng(7)
    weights = (
        random.uniform(-1 / dim, 1 / dim, (BUCKETS, dim)).astype(np.float32),
        np.zeros((dim, len(langs)), np.float32),
        np.zeros(len(langs), np.float32),
    )
    number = {lang: i for i, lang in enumerate(langs)}
    expected = max(1.0, n_texts * (1 - held_back) / parts_of(n_texts))

    for epoch in range(epochs):
        sent = context.broadcast((weights, number))

        def run(batches, epoch=epoch, sent=sent):
            def told(trainer):
                trainer.flush()
                layers = [[layer.tobytes()] for layer in (trainer.embedding, trainer.out, trainer.bias)]
                names = ["part", "n", "embedding", "out", "bias"]
                return pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), pa.array([trainer.n], pa.int64()), *[pa.array(x, pa.binary()) for x in layers]], names
                )

            part, trainer = None, None
            for rows in batches:
                for at, lang, held, buckets, shares in _texts(rows):
                    if held:
                        continue
                    if at != part:
                        if trainer:
                            yield told(trainer)
                        given, number = sent.value
                        part, trainer = at, _Trainer(given, number, epoch, epochs=epochs, rate=rate, batch=batch, expected=expected)
                    trainer.add(lang, buckets, shares)
            if trainer:
                yield told(trainer)

        schema = "part int, n long, embedding binary, out binary, bias binary"
        sums, total = [np.zeros(layer.shape) for layer in weights], 0
        for row in sorted(sample.mapInArrow(run, schema).collect(), key=lambda row: row["part"]):
            total += row["n"]
            for layer, name in zip(sums, ("embedding", "out", "bias"), strict=True):
                layer += row["n"] * np.frombuffer(row[name], np.float32).reshape(layer.shape)
        sent.unpersist()
        weights = tuple((layer / total).astype(np.float32) for layer in sums)
    embedding, out, bias = weights
    if len(langs) < dim:  # fewer numbers to add up for each text
        embedding, out = embedding @ out, np.eye(len(langs), dtype=np.float32)
    model = Model(langs, embedding, out, bias, 1.0, 0.0)
    _calibrate(model, sample, number, reject_share)
    return model


def _calibrate(model: Model, sample: DataFrame, number: dict[str, int], reject_share: float) -> None:
    """The temperature of the lowest log loss; rejection where the held-back texts' lowest scores are."""
    sent = sample.sparkSession.sparkContext.broadcast((model.embedding, model.out, model.bias, number))

    def logits(batches):
        embedding, out, bias, number = sent.value
        for rows in batches:
            for at, lang, held, buckets, shares in _texts(rows):
                if held:
                    yield at, number[lang], (shares @ embedding[buckets] @ out + bias)[None]

    def losses(batches):
        of_part: dict[int, np.ndarray] = {}
        for at, label, row in logits(batches):
            each = [-np.log(_softmax(row / t)[0, label] + 1e-12) for t in TEMPERATURES]
            of_part[at] = of_part.get(at, 0) + np.array(each)
        for at, summed in of_part.items():
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([summed.tolist()], pa.list_(pa.float64()))], ["part", "losses"])

    summed = sorted(sample.mapInArrow(losses, "part int, losses array<double>").collect(), key=lambda row: row["part"])
    if summed:
        model.temperature = float(TEMPERATURES[int(np.argmin(np.sum([row["losses"] for row in summed], axis=0)))])
        temperature = model.temperature

        def best(batches):
            found = [float(_softmax(row / temperature).max()) for *_, row in logits(batches)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.float64())], ["best"])

        scores = [row["best"] for row in sample.mapInArrow(best, "best double").collect()]
        model.reject_below = float(np.quantile(scores, reject_share))
    sent.unpersist()


def parts_of(n_texts: int) -> int:
    return max(1, min(PARTS, n_texts // PART_TEXTS))


def _features(texts: list[str | None]) -> list[list]:
    buckets, shares = [], []
    for text in texts:
        words = Counter(word for chunk in (text or "").split() for word in words_of(chunk))
        times = np.fromiter(words.values(), np.float64, len(words))
        counts = np.zeros(BUCKETS)
        for of, ids in subwords(list(words)):
            counts += np.bincount(ids, times[of], BUCKETS)
        distinct = np.flatnonzero(counts)
        buckets.append(distinct.tolist())
        shares.append((counts[distinct] / max(1.0, counts.sum())).tolist())
    return [buckets, shares]


def held_out(id_: Column) -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(
    docs: DataFrame,
    *,
    id_col: str,
    text_col: str,
    lang_col: str,
    sample_per_language: int,
    sample_total: int,
    **training,
) -> Model | None:
    """Trains on at most ``sample_per_language`` whole texts of each language, fewer if all would be over ``sample_total``."""
    labelled = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")
    ).where(~held_out(F.col("id")) & F.col("text").isNotNull() & F.col("lang").isNotNull())
    # Distinct ids, so that a row repeated many times is one text of the sample; 2 % off at most as a rule.
    counts = labelled.groupBy("lang").agg(F.approx_count_distinct(F.col("id").cast("string"), 0.02).alias("n"))
    held = {row["lang"]: max(1, row["n"]) for row in counts.collect()}
    if not held:
        return None
    most = max(1, min(sample_per_language, sample_total // len(held)))
    n_texts = sum(min(n, most) for n in held.values())
    # Chosen by id alone, and ranked only below a hash that about twice the wanted number of ids have; only the
    # texts of the chosen (a bounded number of ids to broadcast) go on.
    below = [(lang, min(2**63 - 1, int(2**64 * min(1.0, (2 * most + SPARE) / n)) - 2**63)) for lang, n in held.items()]
    below = docs.sparkSession.createDataFrame(below, "lang string, below long")
    drawn = labelled.select("id", F.col("lang").cast("string").alias("lang"), F.xxhash64(F.col("id").cast("string")).alias("drawn"))
    drawn = drawn.join(F.broadcast(below), "lang").where("drawn <= below").select("id", "lang", "drawn").distinct()
    chosen = drawn.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("drawn", "id")))
    chosen = chosen.where(F.col("place") <= most).drop("drawn")
    texts = labelled.join(F.broadcast(chosen), ["id", "lang"])
    texts = texts.groupBy(F.struct("lang", "place").alias("key")).agg(F.min("text").alias("text"))
    made = map_texts(
        texts,
        [("buckets", "array<int>"), ("shares", "array<float>")],
        lambda: _features,
        id_col="key",
        text_col="text",
    )
    # Every 1 / held_back-th text of a language is held back, so that the first ones are always learned from.
    share = training["held_back"]
    sample = cut_lineage(
        made.where(F.size("buckets") > 0)
        .select("key.lang", "key.place", "buckets", "shares")
        .withColumn("held", F.floor(F.col("place") * share) > F.floor((F.col("place") - 1) * share))
        .withColumn("part", F.pmod(F.xxhash64("lang", "place"), F.lit(parts_of(n_texts))).cast("int"))
        .repartition(parts_of(n_texts), "part")
        .sortWithinPartitions("part", F.xxhash64("place", "lang"))
    )
    langs = sorted(row["lang"] for row in sample.where("NOT held").select("lang").distinct().collect())
    if not langs:
        return None
    sample = sample.where(F.col("lang").isin(langs)) if len(langs) < len(held) else sample
    return train(sample, n_texts, langs, **training)


def _sums(chunks: list[str], model: Model | None, width: int) -> np.ndarray:
    """For each chunk, the sum of its subwords' embeddings and, last, their number."""
    rows = np.zeros((len(chunks), width + 1))
    split = list(map(words_of, chunks))
    owner = np.repeat(np.arange(len(chunks)), np.fromiter(map(len, split), np.int64, len(split)))
    for of, ids in subwords([word for words in split for word in words]) if model else ():
        at = owner[of]
        for column in range(width):
            rows[:, column] += np.bincount(at, model.embedding[ids, column], len(chunks))
        rows[:, width] += np.bincount(at, minlength=len(chunks))
    return rows


def _predictor(model: Model | None):
    width = model.embedding.shape[1] if model else 0
    place: dict[str, int] = {}
    table = np.zeros((0, width + 1))

    def of(texts: list[str | None]) -> list:
        nonlocal table
        split = [(text or "").split() for text in texts]
        if len(place) > REMEMBERED:
            place.clear()
            table = table[:0]
        new = list({chunk for chunks in split for chunk in chunks}.difference(place))
        table = np.concatenate([table, _sums(new, model, width)])
        place.update(zip(new, range(len(place), len(place) + len(new)), strict=True))
        langs, scores, rejected = [], [], []
        for chunks in split:
            total = table[np.fromiter(map(place.__getitem__, chunks), np.int64, len(chunks))].sum(axis=0)
            if not total[width] or not model:
                langs.append(UNDETERMINED)
                scores.append(0.0)
                rejected.append(True)
                continue
            logits = (total[:width] / total[width] @ model.out + model.bias) / model.temperature
            shares = _softmax(logits[None])[0]
            best = int(np.argmax(shares))
            langs.append(model.langs[best])
            scores.append(float(min(1.0, shares[best])))
            rejected.append(bool(shares[best] < model.reject_below))
        return [langs, scores, rejected]

    return of


def identify(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    sample_per_language: int = 600,
    sample_total: int = 60_000,
    dim: int = 16,
    epochs: int = 6,
    rate: float = 4.0,
    batch: int = 4,
    held_back: float = 0.2,
    reject_share: float = 0.01,
) -> DataFrame:
    """The language of every whole text: id, held_out, lang_pred, score and rejected.

    Learned from texts and languages of the rows that are not held out
    (:func:`held_out`): at most ``sample_per_language`` of each language, or an
    equal part of ``sample_total`` if that is less, chosen by a hash of the id (rows
    that repeat id and language: the smallest of their texts). The sample's
    features stay in the tasks; the driver averages their weights. ``score`` is the calibrated
    probability of ``lang_pred``. ``rejected`` marks scores below the lowest
    ``reject_share`` of the calibration texts; the prediction is still told.
    NULL texts and texts without a letter are 'und' with score 0, rejected; so
    is everything if no row can be learned from. One row per row of ``docs``;
    repeated rows get equal results; other columns are not read.
    """
    model = learn(
        docs,
        id_col=id_col,
        text_col=text_col,
        lang_col=lang_col,
        sample_per_language=sample_per_language,
        sample_total=sample_total,
        dim=dim,
        epochs=epochs,
        rate=rate,
        batch=batch,
        held_back=held_back,
        reject_share=reject_share,
    )
    # Plain values, dim numbers for each bucket and each language.
    parts = model and (model.langs, model.embedding, model.out, model.bias, model.temperature, model.reject_below)
    sent = docs.sparkSession.sparkContext.broadcast(parts)
    found = map_texts(
        docs,
        [("lang_pred", "string"), ("score", "double"), ("rejected", "boolean")],
        lambda: _predictor(sent.value and Model(*sent.value)),
        id_col=id_col,
        text_col=text_col,
    )
    return found.select(id_col, held_out(F.col(id_col)).alias("held_out"), "lang_pred", "score", "rejected")
