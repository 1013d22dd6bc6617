"""Packing of token sequences by minimum bin slack over the histogram of lengths.

The plan only needs the number of pieces of each length (at most ``window``
numbers), never the pieces. It is a list of patterns: a multiset of lengths
that fills one window, and how often it is used. Pieces are numbered within
their length, so each finds its window in the plan without seeing another.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from leadspark.llm.common import cut
from leadspark.llm.vocabulary import byte_letters, chunks, pieces, specials
from leadspark.session import cut_lineage

# Chunks and pre-tokens remembered in a Python worker, before the memory is emptied (about 100 MB each).
REMEMBERED = 600_000
_ID = 4  # bytes of an id


class TokenBytes:
    """Texts to their ids as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path).model
        marks = specials(path)
        self.marks = {text: id_.to_bytes(_ID, "little") for text, id_ in marks.items()}
        self.special = re.compile("(" + "|".join(map(re.escape, marks)) + ")")
        self.letters = byte_letters()
        self.of_piece: dict[str, bytes] = {}
        self.of_chunk: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        found = self.of_piece.get(piece)
        if found is None:
            # Printable ASCII characters stand for themselves.
            plain = piece.isascii() and piece.isprintable()
            shown = piece if plain else "".join(self.letters[b] for b in piece.encode())
            found = b"".join([token.id.to_bytes(_ID, "little") for token in self.model.tokenize(shown)])
            self.of_piece[piece] = found
        return found

    def _plain(self, text: str) -> list[bytes]:
        words = chunks(text)
        known = self.of_chunk
        for word in set(words).difference(known):
            known[word] = b"".join(map(self._piece, pieces(word)))
        return [known[word] for word in words]

    def encode(self, text: str) -> bytes:
        if len(self.of_chunk) > REMEMBERED:
            self.of_chunk.clear()
        if len(self.of_piece) > REMEMBERED:
            self.of_piece.clear()
        if "<|" not in text:
            return b"".join(self._plain(text))
        parts = self.special.split(text)
        return b"".join(
            self.marks[part] if i % 2 else b"".join(self._plain(part)) for i, part in enumerate(parts)
        )


def cut_pieces(
    docs: DataFrame, vocabulary: str, end_id: int, window: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The pieces of every document: full windows and what is left after them.

    Each piece carries the task that made it (bucket) and its number among that
    task's pieces of the same length (nth).
    """
    schema = T.StructType(
        [
            T.StructField(id_col, docs.schema[id_col].dataType),
            *[T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "bucket", "nth")],
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        tokens = TokenBytes(vocabulary)
        end = end_id.to_bytes(_ID, "little")
        bucket = TaskContext.get().partitionId()
        seen = [0] * (window + 1)
        for batch in batches:
            for part in cut(batch, 1):
                owner, rows = [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    ids = tokens.encode(text or "") + end
                    total = len(ids) // _ID
                    for start in range(0, total, window):
                        held = ids[start * _ID : (start + window) * _ID]
                        length = len(held) // _ID
                        owner.append(i)
                        rows.append((start, length, zlib.crc32(held), total, bucket, seen[length]))
                        seen[length] += 1
                made = np.array(rows, np.int64).reshape(-1, 6)
                columns = [part.column(0).take(pa.array(owner, pa.int64())).cast(arrow.field(0).type)]
                columns += [pa.array(made[:, k]) for k in range(6)]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def best_fill(left: dict[int, int], room: int) -> list[tuple[int, int]]:
    """The multiset of ``left`` (length to count) whose sum is the largest up to ``room``.

    Bit s of ``reach`` says that some multiset sums to s. The bits before each
    length are kept; walking back over them gives the count of each length.
    """
    mask = (1 << (room + 1)) - 1
    reach = 1
    steps: list[tuple[int, int]] = []
    for length in sorted((x for x, n in left.items() if n and x <= room), reverse=True):
        steps.append((length, reach))
        copies, block = min(left[length], room // length), 1
        while copies:
            used = min(block, copies)
            reach |= (reach << (used * length)) & mask
            copies -= used
            block *= 2
        if reach >> room & 1:
            break
    at = reach.bit_length() - 1
    chosen = []
    for length, before in reversed(steps):
        copies = 0
        while not before >> at & 1:
            at -= length
            copies += 1
        if copies:
            chosen.append((length, copies))
    return chosen


def plan(histogram: dict[int, int], window: int) -> np.ndarray:
    """Rows (length, first number, copies in a window, first window, windows, offset), by length and first number.

    The longest length left opens a window, the best fill closes it, and the
    pattern is used as often as the counts allow.
    """
    left = {length: n for length, n in histogram.items() if n}
    used = dict.fromkeys(left, 0)
    rows = []
    windows = 0
    while left:
        longest = max(left)
        left[longest] -= 1
        pattern = dict(best_fill(left, window - longest))
        left[longest] += 1
        pattern[longest] = pattern.get(longest, 0) + 1
        times = min(left[length] // copies for length, copies in pattern.items())
        offset = 0
        for length, copies in sorted(pattern.items(), reverse=True):
            rows.append((length, used[length], copies, windows, times, offset))
            offset += length * copies
            used[length] += copies * times
            left[length] -= copies * times
            if not left[length]:
                del left[length]
        windows += times
    return np.array(sorted(rows), np.int64).reshape(-1, 6)


def _placed(pieces_: DataFrame, planned: np.ndarray, id_col: str) -> DataFrame:
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = T.StructType([pieces_.schema[id_col], *[T.StructField(n, T.LongType()) for n in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        # Both parts of the key fit one number: lengths are small, counts are below 2^48.
        keys = (planned[:, 0] << 48) + planned[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy()
            number = batch.column("number").to_numpy()
            row = planned[np.searchsorted(keys, (length << 48) + number, side="right") - 1]
            turn, copy = np.divmod(number - row[:, 1], row[:, 2])
            columns = [batch.column(0).cast(arrow.field(0).type)]
            columns += [batch.column(name) for name in names[:4]]
            columns += [pa.array(row[:, 3] + turn), pa.array(row[:, 5] + copy * length)]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return pieces_.select(id_col, *names[:4], "number").mapInArrow(run, schema)


def pack(
    docs: DataFrame,
    vocabulary: str,
    *,
    end_id: int = 2,
    window: int = 4096,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces of all documents, placed in sequences of at most ``window`` tokens.

    A document is its ids and ``end_id`` (NULL and empty texts: that id alone).
    Documents longer than a window are cut into full windows and a rest; rests
    share windows by minimum bin slack. Returns id, start, length, ids_crc32
    (little-endian unsigned 32-bit ids), doc_tokens, sequence_id and offset, one
    row per piece. Each id is in exactly one piece, and the pieces of a sequence
    follow each other from offset 0. Repeated rows and equal or NULL ids are
    documents of their own; other columns are not read; no rows give no pieces.

    Writes the pieces' lengths (not their ids) to the checkpoint folder once. The
    driver sees a histogram of at most ``window`` lengths.
    """
    made = cut_lineage(cut_pieces(docs, vocabulary, end_id, window, id_col, text_col))
    per_bucket = made.groupBy("bucket", "length").agg(F.count("*").alias("held"))
    earlier = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = per_bucket.select(
        F.col("bucket").alias("_bucket"),
        F.col("length").alias("_length"),
        F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("_first"),
    )
    histogram = {row["length"]: row["n"] for row in made.groupBy("length").agg(F.count("*").alias("n")).collect()}
    numbered = made.join(
        first, (F.col("bucket") == F.col("_bucket")) & (F.col("length") == F.col("_length"))
    ).withColumn("number", F.col("_first") + F.col("nth"))
    return _placed(numbered, plan(histogram, window), id_col)
