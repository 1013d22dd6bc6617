"""Quality scores by nearest-neighbour voting over latent-semantic vectors.

Terms are words and their shapes, hashed to a fixed number of buckets. A bounded
sample of labelled documents gives their document frequencies, spans the latent space (singular vectors of its weighted term matrix) and stands
in it as voters; it is broadcast, and every document is compared with all of it
in blocks of cosine products.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from leadspark.llm.common import cut, map_texts
from leadspark.llm.language_id import held_out

BUCKETS = 8192
# Chunks remembered in a Python worker, before the memory is emptied.
REMEMBERED = 250_000
BLOCK_ROWS = 512
_LETTERS = re.compile(r"[^\W\d_]+")
_MARKS = re.compile(r"[^\w]+")
_RUNS = re.compile(r"(.)\1+")
# Shares of a text (of chunks that repeat the one before, of lines met before, of chunks in capitals) are terms by level.
TRAITS = ("repeated", "repeated line", "capitals")
LEVELS = (0.02, 0.1, 0.3)
TRAIT_COUNT = 64


def _bucket(term: str) -> int:
    return zlib.crc32(term.encode()) % BUCKETS


def _shape(chunk: str) -> str:
    """Kinds of characters in their order, each run of a kind once: That, -> Aa, ; 12% -> 0%."""
    kinds = "".join(
        "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "l" if c.isalpha() else c for c in chunk
    )
    return _RUNS.sub(r"\1", kinds)[:8]


def chunk_terms(chunk: str) -> tuple[int, int, int, int]:
    """Buckets of a chunk's word, of its shape, and of the marks in it (as they stand); 1 if it is in capitals."""
    word = "".join(_LETTERS.findall(chunk.lower()))
    marks = "".join(_MARKS.findall(chunk))[:8]
    return _bucket(word), _bucket("shape " + _shape(chunk)), _bucket("marks " + marks), int(chunk.isupper())


class Terms:
    """Buckets and counts of texts; chunks seen before are looked up."""

    def __init__(self):
        self.place: dict[str, int] = {}
        self.table = np.zeros((0, 4), np.int32)
        self.traits = [[_bucket(f"<{trait} {level}>") for level in LEVELS] for trait in TRAITS]

    def of(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        split = [(text or "").split() for text in texts]
        if len(self.place) > REMEMBERED:
            self.place.clear()
            self.table = self.table[:0]
        new = list({chunk for chunks in split for chunk in chunks}.difference(self.place))
        if new:
            rows = np.array([chunk_terms(chunk) for chunk in new], np.int32)
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
            self.table = np.concatenate([self.table, rows])
        found = []
        for text, chunks in zip(texts, split, strict=True):
            at = np.fromiter(map(self.place.__getitem__, chunks), np.int64, len(chunks))
            rows = self.table[at]
            counts = np.bincount(rows[:, :3].ravel(), minlength=BUCKETS)
            if chunks:
                lines = [line for line in text.split("\n") if line]
                again = np.count_nonzero(at[1:] == at[:-1]) / len(chunks)
                shares = (again, 1 - len(set(lines)) / max(1, len(lines)), rows[:, 3].mean())
                for share, buckets in zip(shares, self.traits, strict=True):
                    level = int(np.searchsorted(LEVELS, share, side="right"))
                    if level:
                        counts[buckets[level - 1]] += TRAIT_COUNT
            held = np.flatnonzero(counts)
            found.append((held, counts[held]))
        return found


@dataclass
class Space:
    """Weights and directions of the buckets; unit vectors and labels of the voters."""

    weights: np.ndarray
    directions: np.ndarray
    voters: np.ndarray
    labels: np.ndarray
    prior: float


def _weighted(buckets: np.ndarray, counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    values = (1 + np.log(counts)) * weights[buckets]
    return values / (np.linalg.norm(values) or 1.0)


def _unit(rows: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, size, out=np.zeros_like(rows), where=size > 0)


def fit(features: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rank: int) -> Space:
    """The latent space of the sample: eigenvectors of its Gram matrix, carried over to the buckets.

    A bucket weighs more the fewer documents of the sample have it.
    """
    frequencies = np.bincount(np.concatenate([buckets for buckets, _ in features]), minlength=BUCKETS)
    weights = np.log((1 + len(features)) / (1 + frequencies)).astype(np.float32) + 1
    matrix = np.zeros((len(features), BUCKETS), np.float32)
    for row, (buckets, counts) in zip(matrix, features, strict=True):
        row[buckets] = _weighted(buckets, counts, weights)
    values, vectors = np.linalg.eigh((matrix @ matrix.T).astype(np.float64))
    best = np.argsort(values)[::-1][: min(rank, len(values))]
    best = best[values[best] > 1e-9]
    directions = (matrix.T @ (vectors[:, best] / np.sqrt(values[best]))).astype(np.float32)
    return Space(weights, directions, _unit(matrix @ directions), labels, float(labels.mean()))


def votes(vectors: np.ndarray, space: Space, neighbours: int, sharpness: float) -> np.ndarray:
    """Shares of label 1 among each row's nearest voters, weighted by similarity."""
    scores = np.full(len(vectors), space.prior)
    k = min(neighbours, len(space.labels))
    for start in range(0, len(vectors), BLOCK_ROWS):
        block = vectors[start : start + BLOCK_ROWS]
        cosine = block @ space.voters.T
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0.0).astype(np.float64) ** sharpness
        total = weight.sum(axis=1)
        share = (weight * space.labels[near]).sum(axis=1) / np.where(total > 0, total, 1.0)
        scores[start : start + BLOCK_ROWS] = np.where(total > 0, share, space.prior)
    return np.clip(scores, 0.0, 1.0)


def _scorer(space: Space | None, neighbours: int, sharpness: float):
    terms = Terms()

    def of(texts: list[str | None]) -> list:
        if space is None:
            return [[0.5] * len(texts)]
        rank = space.directions.shape[1]
        vectors = np.zeros((len(texts), rank), np.float32)
        for row, (buckets, counts) in zip(vectors, terms.of(texts), strict=True):
            if len(buckets):
                row[:] = _weighted(buckets, counts, space.weights) @ space.directions[buckets]
        return [votes(_unit(vectors), space, neighbours, sharpness)]

    return of


def _features(texts: list[str | None]) -> list:
    found = Terms().of(texts)
    return [[b.tolist() for b, _ in found], [c.tolist() for _, c in found]]


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    voters: int = 2400,
    rank: int = 96,
    neighbours: int = 25,
    sharpness: float = 4.0,
) -> DataFrame:
    """id, held_out, score and predicted for every whole text: how likely ``label_col`` is 1.

    Voters are at most ``voters`` labelled rows that are not held out
    (:func:`held_out`), chosen by a hash, one text (of the smallest hash) for each
    id and label; they and the term weights from them are all that the driver sees and
    broadcasts. ``score`` is the share of label 1 among the
    ``neighbours`` nearest voters, each weighted by its cosine to the power of
    ``sharpness``; predicted is 1 from 0.5 on. NULL, empty and unknown texts get
    the voters' mean label, and 0.5 if there are no voters. Labels that are NULL
    or of unknown ids teach nothing; an id with several labels counts with each.
    One row per row of ``docs``; repeated rows get equal scores; other columns
    are not read.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("label")).where(
        F.col("label").isNotNull() & ~held_out(F.col("_id"))
    )
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    # Voters are distinct (id, label), chosen by id alone; only the texts of the chosen (at most ``voters`` rows to
    # broadcast) go on. Of an id's texts the one with the smallest hash teaches, so repeated ids do not add rows.
    chosen = (
        texts.select("id")
        .join(known, F.col("id") == F.col("_id"))
        .select("_id", "label")
        .distinct()
        .orderBy(F.xxhash64(F.col("_id").cast("string")), "label")
        .limit(voters)
    )
    taught = texts.join(F.broadcast(chosen), F.col("id") == F.col("_id"))
    taught = taught.groupBy("id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    made = map_texts(
        taught.select(F.struct("id", "label").alias("key"), "text"),
        [("buckets", "array<int>"), ("counts", "array<bigint>")],
        lambda: _features,
        id_col="key",
    )
    rows = made.select("key.id", "key.label", "buckets", "counts").collect()
    rows = sorted((r for r in rows if r["buckets"]), key=lambda r: (str(r["id"]), r["label"], r["buckets"], r["counts"]))
    parts = None
    if rows:
        features = [(np.array(r["buckets"], np.int64), np.array(r["counts"], np.int64)) for r in rows]
        space = fit(features, np.array([r["label"] for r in rows], np.float64), rank)
        parts = (space.weights, space.directions, space.voters, space.labels, space.prior)
    # At most (BUCKETS + voters) * rank numbers.
    sent = docs.sparkSession.sparkContext.broadcast(parts)
    scored = map_texts(
        docs,
        [("score", "double")],
        lambda: _scorer(sent.value and Space(*sent.value), neighbours, sharpness),
        id_col=id_col,
        text_col=text_col,
    )
    return scored.select(
        id_col, held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
