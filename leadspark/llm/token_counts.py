"""Token counts by rank-synchronous array merging.

Distinct pre-tokens of a batch lie in one ragged numpy array of symbol ids. In
each round every pre-token finds its lowest-rank adjacent pair and all its
occurrences are merged at once; a pre-token without a mergeable pair leaves
the array with the number of symbols it has left. A merged symbol only enters
pairs of higher rank than its own (checked when the ranks are loaded), so a
round equals the one-at-a-time merges of the library.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadspark.llm.common import map_texts
from leadspark.llm.vocabulary import byte_letters, chunks, model, pieces, specials

# Chunks and pre-tokens remembered in a Python worker, before the memory is emptied.
REMEMBERED = 300_000
_NEVER = np.iinfo(np.int64).max


class PairRanks:
    """Merge ranks as sorted arrays, and the symbols that single bytes start as."""

    def __init__(self, path: str):
        parsed = model(path)["model"]
        ids = parsed["vocab"]
        self.size = len(ids)
        end = parsed["end_of_word_suffix"]
        letters = byte_letters()
        self.inner = np.array([ids[c] for c in letters], np.int64)
        self.final = np.array([ids[c + end] for c in letters], np.int64)
        merges = [tuple(pair) if isinstance(pair, list) else tuple(pair.split(" ")) for pair in parsed["merges"]]
        left = np.array([ids[a] for a, _ in merges], np.int64)
        right = np.array([ids[b] for _, b in merges], np.int64)
        self.merged = np.array([ids[a + b] for a, b in merges], np.int64)
        born = np.full(self.size, -1, np.int64)
        ranks = np.arange(len(merges))
        born[self.merged[::-1]] = ranks[::-1]
        if (np.maximum(born[left], born[right]) >= ranks).any():
            raise ValueError("a pair ranks before the symbols it joins; simultaneous merging would not be exact")
        keys = left * self.size + right
        order = np.argsort(keys)
        self.keys, self.rank_of = keys[order], ranks[order]

    def ranks(self, pairs: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, pairs), len(self.keys) - 1)
        return np.where(self.keys[at] == pairs, self.rank_of[at], _NEVER)

    def count(self, words: list[bytes]) -> np.ndarray:
        """Symbols that each (not empty) word is left with."""
        counts = np.zeros(len(words), np.int64)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        if not len(words):
            return counts
        raw = np.frombuffer(b"".join(words), np.uint8)
        symbols = self.inner[raw]
        last = np.cumsum(lengths) - 1
        symbols[last] = self.final[raw[last]]
        owner = np.repeat(np.arange(len(words)), lengths)
        while len(symbols):
            rank = self.ranks(symbols[:-1] * self.size + symbols[1:])
            rank[owner[1:] != owner[:-1]] = _NEVER
            rank = np.append(rank, _NEVER)  # the last symbol of the array starts no pair
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            held = np.diff(np.append(starts, len(owner)))
            lowest = np.minimum.reduceat(rank, starts)
            over = lowest == _NEVER
            counts[owner[starts[over]]] = held[over]
            target = np.repeat(lowest, held)
            chosen = np.flatnonzero((rank == target) & (target != _NEVER))
            # In a run such as a a a the pairs overlap: every second one is merged, from the left.
            fresh = np.append(True, np.diff(chosen) != 1)
            run_start = chosen[np.flatnonzero(fresh)][np.cumsum(fresh) - 1] if len(chosen) else chosen
            chosen = chosen[(chosen - run_start) % 2 == 0]
            symbols[chosen] = self.merged[rank[chosen]]
            keep = target != _NEVER
            keep[chosen + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        return counts


def _counter(path: str):
    ranks = PairRanks(path)
    special = re.compile("(" + "|".join(map(re.escape, specials(path))) + ")")
    of_chunk: dict[str, int] = {}
    of_piece: dict[str, int] = {}

    def count(texts: list[str | None]) -> list:
        bytes_, docs = [], []
        for text in texts:
            text = text or ""
            bytes_.append(len(text.encode()))
            parts = special.split(text) if "<|" in text else [text]
            docs.append((len(parts) // 2, [chunk for part in parts[::2] for chunk in chunks(part)]))
        if len(of_chunk) > REMEMBERED:
            of_chunk.clear()
        if len(of_piece) > REMEMBERED:
            of_piece.clear()
        new = {chunk for _, words in docs for chunk in words if chunk not in of_chunk}
        split = {chunk: pieces(chunk) for chunk in new}
        unknown = list({piece for found in split.values() for piece in found if piece not in of_piece})
        of_piece.update(zip(unknown, ranks.count([piece.encode() for piece in unknown]).tolist(), strict=True))
        of_chunk.update((chunk, sum(map(of_piece.__getitem__, found))) for chunk, found in split.items())
        return [bytes_, [marks + sum(map(of_chunk.__getitem__, words)) for marks, words in docs]]

    return count


def token_counts(
    docs: DataFrame, vocabulary: str, *, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Bytes and tokens of every text, by a word-end BPE file of the tokenizers library.

    Returns id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``), one row per
    row of ``docs``. NULL counts as an empty text (0 bytes, 0 tokens). The file's
    special strings inside a text are one token each, as the library has it.
    Texts of any length are counted whole. Repeated rows and ids stay as they
    are; other columns are not read; an empty table gives an empty result.
    """
    counted = map_texts(
        docs,
        [("n_bytes", "long"), ("n_tokens", "long")],
        lambda: _counter(vocabulary),
        id_col=id_col,
        text_col=text_col,
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
