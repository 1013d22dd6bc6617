"""The word-end BPE vocabulary of a tokenizer file and the pieces its pattern makes of a text."""

from __future__ import annotations

import json
import re
import unicodedata

import regex

# Unicode white space, as the vocabulary's pattern sees it (the ASCII separators 1C to 1F are no white space).
SPACE = "\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
# The split pattern of word_bpe_49k.json.
ASCII_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^{SPACE}a-z0-9]+")
PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
CHUNKS = re.compile(rf"[^{SPACE}]+")
SEPARATORS = re.compile("[\x1c-\x1f]")


def chunks(text: str) -> list[str]:
    """The parts of ``text`` between white space; no piece reaches over white space."""
    return CHUNKS.findall(text) if SEPARATORS.search(text) else text.split()


def pieces(chunk: str) -> list[str]:
    """The normalised pre-tokens of a chunk."""
    if chunk.isascii():
        return ASCII_PIECES.findall(chunk.lower())
    # Lower case character by character: a final sigma is no special case there.
    composed = unicodedata.normalize("NFC", chunk).replace("Σ", "σ")
    return PIECES.findall(composed.lower())


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    letters = {b: chr(b) for b in shown}
    letters |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in letters)}
    return [letters[b] for b in range(256)]


def model(path: str) -> dict:
    """The parsed file."""
    with open(path, encoding="utf-8") as file:
        return json.load(file)


def specials(path: str) -> dict[str, int]:
    """Strings that the library takes for one token wherever they stand in a text."""
    return {token["content"]: token["id"] for token in model(path)["added_tokens"]}
