"""Removal of word windows that occur more than once, with a count-min prefilter.

Documents lie in blocks of a few megabytes; windows are counted in shards of a
hash space. Blocks and shards only exchange short binary messages:

1. Every block counts its windows in a sketch of two rows and sends each shard
   of the sketch its own non-empty cells (gaps between cell numbers, seven bits a
   byte: at most four bytes a cell, since a shard has 2^22 cells, however large the
   table is). A shard adds the sketches of all blocks up. The sum never
   underestimates a window's count.
2. A shard answers each block with one bit per cell it sent: total of two or
   more. A window with both bits set is estimated to be repeated. Only those
   windows are sent on, by their exact 96-bit fingerprint, to be grouped.
3. The exact groups answer with one bit per window; the block removes the words
   that windows of two or more occurrences cover. Where its candidates start is a
   message of the block to itself, so texts are hashed twice, not a third time.
   A shuffle hands a block its documents in any order, another one at each reading,
   so places are counted over the texts in ascending order.

A window that occurs in a third of all documents is one entry per block. The
number of cells and blocks follows from the bytes of the texts.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from leadspark.llm.common import map_texts  # noqa: F401  registers the subpackage for the executors
from leadspark.llm.words import WordNumbers, runs

BLOCK_BYTES = 4_000_000
# Text bytes for each cell of a sketch row: words are longer, so less than half the cells are in use.
BYTES_PER_CELL = 3
SHARD_BITS = 22
EXACT_SHARD_BITS = 20
ROWS = 2
# A byte holds seven bits of a gap, and a mark if more follow.
_GROUP = 7
_MORE = 1 << _GROUP

_MESSAGE = "shard long, block long, gaps binary, twice binary"
_EXACT_MESSAGE = "shard long, block long, high binary, low binary, twice binary"
_ANSWER = "block long, shard long, exact boolean, bits binary"


def encode_gaps(cells: np.ndarray) -> bytes:
    """Ascending cell numbers as bytes: each gap in groups of seven bits, the lowest first; all but its last are marked."""
    gaps = np.diff(cells, prepend=0)
    sizes = np.ones(len(gaps), np.int64)
    more = gaps >> _GROUP
    while more.any():
        sizes += more > 0
        more >>= _GROUP
    ends = np.cumsum(sizes)
    out = np.zeros(ends[-1] if len(ends) else 0, np.uint8)
    for i in range(int(sizes.max(initial=0))):
        has = sizes > i
        marked = np.where(sizes[has] > i + 1, _MORE, 0)
        out[ends[has] - sizes[has] + i] = (gaps[has] >> (_GROUP * i)) & (_MORE - 1) | marked
    return out.tobytes()


def decode_gaps(raw: bytes) -> np.ndarray:
    groups = np.frombuffer(raw, np.uint8)
    ends = np.flatnonzero(groups < _MORE)
    starts = np.append(0, ends[:-1] + 1)[: len(ends)]
    gaps = np.zeros(len(ends), np.int64)
    for i in range(int((ends - starts).max(initial=-1)) + 1):
        has = starts + i <= ends
        gaps[has] |= (groups[starts[has] + i].astype(np.int64) & (_MORE - 1)) << (_GROUP * i)
    return np.cumsum(gaps)


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _flags(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)


def _words(texts: list[bytes | None]) -> tuple[list[list[bytes]], np.ndarray]:
    """The words of each text, and where each text ends among all of them."""
    split = [text.split() if text else [] for text in texts]
    return split, np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))


def in_order(table: pa.Table) -> pa.Table:
    """The documents of a block by their text, NULL last: what a place in the block means. Equal texts have the same words."""
    return table.take(pc.sort_indices(table.column("text")))


def pack_candidates(shards: list[tuple[int, int, int]], starts: np.ndarray, of: np.ndarray) -> bytes:
    """A block's message to itself: (shard, first, end) of its distinct windows, each candidate's first word and window.

    Candidates are in the order of their windows, so one bit each tells where the next window begins.
    """
    fresh = np.packbits(np.diff(of, prepend=-1) > 0)
    head = np.array([len(shards), len(starts)], np.int64)
    return b"".join(part.tobytes() for part in (head, np.array(shards, np.int64).ravel(), starts.astype(np.uint32), fresh))


def unpack_candidates(raw: bytes) -> tuple[list[tuple[int, int, int]], np.ndarray, np.ndarray]:
    held, n = np.frombuffer(raw, np.int64, 2).tolist()
    at = 16 + 24 * held
    shards = np.frombuffer(raw, np.int64, 3 * held, 16).reshape(-1, 3)
    starts = np.frombuffer(raw, np.uint32, n, at).astype(np.int64)
    return list(map(tuple, shards.tolist())), starts, np.cumsum(_flags(raw[at + 4 * n :], n), dtype=np.int64) - 1


class _Block:
    """The windows of one block of documents."""

    def __init__(self, texts: list[bytes | None], width: int, shards: int, words: WordNumbers):
        split, ends = _words(texts)
        self.shards = shards
        flat = [word for held in split for word in held]
        numbers = words.of(flat)
        # A run that reaches into the next document is no window.
        inside = np.ones(max(0, len(flat) - width + 1), bool)
        for end in ends[:-1]:
            inside[max(0, end - width + 1) : end] = False
        self.at = np.flatnonzero(inside)
        self.high = runs(numbers[:, 0], width, 0)[self.at]
        self.low = runs(numbers[:, 1], width, 1)[self.at]

    def cells(self, row: int) -> np.ndarray:
        hashed = self.high if row == 0 else self.low
        shard = (hashed >> np.uint64(32)) * np.uint64(self.shards) >> np.uint64(32)
        return (shard << np.uint64(SHARD_BITS) | hashed & np.uint64((1 << SHARD_BITS) - 1)).astype(np.int64)

    def _shards(self, cells: np.ndarray) -> list[tuple[int, int, int]]:
        """(shard, first, end) over ascending cells."""
        if not len(cells):
            return []
        of = cells >> SHARD_BITS
        starts = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        return list(zip(of[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(cells)], strict=True))

    def sketch(self, block: int) -> list[tuple]:
        messages = []
        for row in range(ROWS):
            cells, counts = np.unique(self.cells(row), return_counts=True)
            for shard, first, end in self._shards(cells):
                held = cells[first:end] - (shard << SHARD_BITS)
                key = (shard << 1) + row
                messages.append((key, block, encode_gaps(held), _bits(counts[first:end] > 1)))
        return messages

    def candidates(self, answers: dict[int, bytes]):
        """Windows estimated to be repeated: their places, and the distinct ones with their counts."""
        maybe = np.ones(len(self.at), bool)
        for row in range(ROWS):
            cells, of = np.unique(self.cells(row), return_inverse=True)
            repeated = np.zeros(len(cells), bool)
            for shard, first, end in self._shards(cells):
                repeated[first:end] = _flags(answers[(shard << 1) + row], end - first)
            maybe &= repeated[of]
        chosen = np.flatnonzero(maybe)
        order = np.lexsort((self._short(chosen), self.high[chosen]))
        chosen = chosen[order]
        high, low = self.high[chosen], self._short(chosen)
        fresh = np.append(True, (high[1:] != high[:-1]) | (low[1:] != low[:-1]))[: len(high)]
        first = np.flatnonzero(fresh)
        counts = np.diff(np.append(first, len(high)))
        return chosen, np.cumsum(fresh) - 1, high[first], low[first], counts

    def _short(self, chosen: np.ndarray) -> np.ndarray:
        return self.low[chosen].astype(np.uint32)


def _exact_shards(high: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    if not len(high):
        return []
    of = (high >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(high), np.int64)
    starts = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    return list(zip(of[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(high)], strict=True))


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    return to_arrow_schema(T._parse_datatype_string(ddl))


def remove_repeated_windows(
    docs: DataFrame, *, width: int = 35, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Texts without the words that a repeated window of ``width`` words covers.

    Returns id, n_words, n_removed and kept (the words left, joined by one
    space), one row per row of ``docs``. Words are what ASCII white space parts.
    A window is repeated if the same words start anywhere else, in the same
    document or another; all windows are judged on the input. NULL and empty
    texts have no words and keep ''. Texts below ``width`` words stay whole.
    Repeated rows are documents of their own, so their windows are repeated;
    ids are only carried. Other columns are not read; an empty table gives none.

    Windows are grouped by 96 bits of two independent hashes. Everything else is
    exact: the sketch only decides which windows need not be grouped.
    """
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    blocks = math.ceil(total / BLOCK_BYTES) or 1
    shards = math.ceil(total / BYTES_PER_CELL / (1 << SHARD_BITS)) or 1
    exact_bits = max(0, math.ceil(math.log2(total / 6 + 1)) - EXACT_SHARD_BITS)
    placed = docs.select(
        F.col(id_col).alias("id"),
        F.col(text_col).cast("binary").alias("text"),
        F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)), F.lit(blocks)).alias("block"),
    )
    by_block = placed.groupBy("block")
    words = WordNumbers()  # empty here; each task fills its own
    message, exact_message, answer = _arrow(_MESSAGE), _arrow(_EXACT_MESSAGE), _arrow(_ANSWER)

    def block_of(table: pa.Table) -> _Block:
        return _Block(table.column("text").to_pylist(), width, shards, words)

    def answers_of(table: pa.Table, exact: bool) -> dict[int, bytes]:
        keys, kinds, bits = (table.column(n).to_pylist() for n in ("shard", "exact", "bits"))
        return {key: raw for key, kind, raw in zip(keys, kinds, bits, strict=True) if kind == exact}

    def sketched(key, table):
        return _table(block_of(table).sketch(key[0].as_py()), message)

    def added(key, table):
        counts = np.zeros(1 << SHARD_BITS, np.uint8)
        cells = [decode_gaps(raw) for raw in table.column("gaps").to_pylist()]
        for held, twice in zip(cells, table.column("twice").to_pylist(), strict=True):
            counts[held] = np.minimum(counts[held] + 1 + _flags(twice, len(held)), 2)
        shard = key[0].as_py()
        blocks_ = table.column("block").to_pylist()
        return _table([(b, shard, False, _bits(counts[c] > 1)) for b, c in zip(blocks_, cells, strict=True)], answer)

    def estimated(key, table, answers):
        if not table.num_rows:
            return _table([], exact_message)
        held = block_of(in_order(table))
        chosen, of, high, low, counts = held.candidates(answers_of(answers, False))
        block = key[0].as_py()
        bounds = _exact_shards(high, exact_bits)
        rows = [(shard, block, high[a:b].tobytes(), low[a:b].tobytes(), _bits(counts[a:b] > 1)) for shard, a, b in bounds]
        own = pack_candidates(bounds, held.at[chosen], of)
        return _table([*rows, (-1 - block, block, own, b"", b"")], exact_message)

    def grouped(key, table):
        if key[0].as_py() < 0:  # a block's message to itself
            return _table([(-1 - key[0].as_py(), 0, False, raw) for raw in table.column("high").to_pylist()], answer)
        highs = [np.frombuffer(raw, np.uint64) for raw in table.column("high").to_pylist()]
        low = np.frombuffer(b"".join(table.column("low").to_pylist()), np.uint32)
        twice = [_flags(raw, len(h)) for raw, h in zip(table.column("twice").to_pylist(), highs, strict=True)]
        high = np.concatenate(highs)
        order = np.lexsort((low, high))
        high, low = high[order], low[order]
        fresh = np.append(True, (high[1:] != high[:-1]) | (low[1:] != low[:-1]))
        group = np.cumsum(fresh) - 1
        counts = np.bincount(group, 1.0 + np.concatenate(twice)[order])
        repeated = np.empty(len(high), bool)
        repeated[order] = counts[group] > 1
        shard = key[0].as_py()
        rows, start = [], 0
        for block, held in zip(table.column("block").to_pylist(), highs, strict=True):
            rows.append((block, shard, True, _bits(repeated[start : start + len(held)])))
            start += len(held)
        return _table(rows, answer)

    output = T.StructType(
        [
            T.StructField(id_col, docs.schema[id_col].dataType),
            T.StructField("n_words", T.LongType()),
            T.StructField("n_removed", T.LongType()),
            T.StructField("kept", T.StringType()),
        ]
    )

    def removed(key, table, answers):
        schema = to_arrow_schema(output)
        if not table.num_rows:
            return schema.empty_table()
        table = in_order(table)
        texts, ends = _words(table.column("text").to_pylist())
        bounds, starts, of = unpack_candidates(answers_of(answers, False)[0])
        repeated = np.zeros(bounds[-1][2] if bounds else 0, bool)
        exact = answers_of(answers, True)
        for shard, a, b in bounds:
            repeated[a:b] = _flags(exact[shard], b - a)
        starts = starts[repeated[of]]
        marks = np.zeros(int(ends[-1]) + 1, np.int64)
        np.add.at(marks, starts, 1)
        np.add.at(marks, starts + width, -1)
        gone = np.cumsum(marks)[:-1] > 0
        n_words, n_removed, kept, start = [], [], [], 0
        for held, end in zip(texts, ends.tolist(), strict=True):
            lost = int(np.count_nonzero(gone[start:end]))
            if lost:
                left = [word for word, out in zip(held, gone[start:end].tolist(), strict=True) if not out]
            else:
                left = held
            n_words.append(len(held))
            n_removed.append(lost)
            kept.append(b" ".join(left).decode())
            start = end
        columns = [table.column("id").cast(schema.field(0).type), pa.array(n_words, pa.int64())]
        columns += [pa.array(n_removed, pa.int64()), pa.array(kept, schema.field(3).type)]
        return pa.table(columns, schema=schema)

    cell_answers = by_block.applyInArrow(sketched, _MESSAGE).groupBy("shard").applyInArrow(added, _ANSWER)
    candidates = by_block.cogroup(cell_answers.groupBy("block")).applyInArrow(estimated, _EXACT_MESSAGE)
    exact_answers = candidates.groupBy("shard").applyInArrow(grouped, _ANSWER)
    return by_block.cogroup(exact_answers.groupBy("block")).applyInArrow(removed, output)


def kept_digest(kept: DataFrame) -> DataFrame:
    """``remove_repeated_windows`` with the SHA-256 of the words left instead of the words."""
    return kept.withColumn("kept_sha256", F.sha2(F.col("kept").cast("binary"), 256)).drop("kept")
