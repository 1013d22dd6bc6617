"""Secrets in texts: fixed patterns, and strings that are too random to be words.

Candidate strings are runs of an alphabet. Each alphabet has a window, and the
Shannon entropy of every window of a candidate comes from counts that change by
one character in and one out. Windows over the alphabet's limit join to spans;
an allow-list holds back what is known to look random without being secret.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadspark.llm.common import cut, map_texts

# The base patterns, in the order in which their kinds are listed.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "entropy")

# A run that is long enough begins where HEX would begin a match, so both find the same spans.
_LONG_HEX = re.compile(rf"[0-9a-f]{{{MIN_HEX},}}")


@dataclass(frozen=True)
class Alphabet:
    """Runs of ``pattern`` that hold all of ``needs``; windows of ``window`` characters with at least ``bits``."""

    pattern: str
    needs: tuple[str, ...]
    window: int
    bits: float


ALPHABETS = (
    Alphabet(r"[0-9A-Fa-f]{24,}", (r"[0-9]", r"[A-Fa-f]"), 24, 2.8),
    Alphabet(r"[A-Za-z0-9+/_=-]{20,}", (r"[0-9]", r"[A-Z]", r"[a-z]"), 20, 3.6),
    # Of one case: tokens that stand alone, as parts of longer ones are words of the alphabet above.
    Alphabet(r"(?<![A-Za-z0-9])[a-z0-9]{20,}(?![A-Za-z0-9])", (r"[0-9]", r"[a-z]"), 20, 3.4),
    Alphabet(r"(?<![A-Za-z0-9])[A-Z0-9]{20,}(?![A-Za-z0-9])", (r"[0-9]", r"[A-Z]"), 20, 3.4),
)

# Held back if one of these matches the candidate, or the text right before it.
ALLOWED = (
    r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",
    r"(.)\1*",
)
ALLOWED_BEFORE = (r"(?i)sha(?:1|256|384|512)[-:=]\s?$", r"(?i)\bcommit\s$")
_BEFORE = 200
# Windows that touch a match of these are held back, the others of the same candidate are not.
ALLOWED_WITHIN = (r"(?i)0123456789|abcdefghijkl|example|placeholder|changeme|xxxx+",)
# Candidates that begin in a match of these are held back: addresses, up to what no address holds.
ALLOWED_AROUND = (r"://[^\s\"<>\\^`{|}]*",)


def dense_windows(text: str, window: int, bits: float) -> list[tuple[int, int]]:
    """Spans covered by windows of ``text`` with an entropy of at least ``bits`` bits a character.

    With counts c over w characters the entropy is log2 w - sum(c log2 c) / w.
    """
    cost = [0.0] + [c * log2(c) for c in range(1, window + 1)]
    most = (log2(window) - bits) * window + 1e-9
    counts: dict[str, int] = {}
    total = 0.0
    spans: list[tuple[int, int]] = []
    for i, char in enumerate(text):
        n = counts.get(char, 0)
        total += cost[n + 1] - cost[n]
        counts[char] = n + 1
        if i >= window:
            old = text[i - window]
            n = counts[old]
            total += cost[n - 1] - cost[n]
            counts[old] = n - 1
        if i >= window - 1 and total <= most:
            start = i - window + 1
            if spans and start <= spans[-1][1]:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((start, i + 1))
    return spans


def _parts(candidate: str, within) -> list[tuple[int, int]]:
    """The pieces of ``candidate`` between what the patterns ``within`` match."""
    pieces, at = [], 0
    for start, end in sorted(m.span() for p in within for m in p.finditer(candidate)):
        if start > at:
            pieces.append((at, start))
        at = max(at, end)
    return [*pieces, (at, len(candidate))]


def _prepared(alphabets, allowed, allowed_before, allowed_within=ALLOWED_WITHIN, allowed_around=ALLOWED_AROUND):
    compiled = [(re.compile(a.pattern), [re.compile(n) for n in a.needs], a) for a in alphabets]
    return compiled, *([re.compile(p) for p in ps] for ps in (allowed, allowed_before, allowed_within, allowed_around))


def scan(text: str, prepared) -> list[tuple[int, int, str]]:
    """All spans of a text as (start, end, kind), by start, then kind as listed."""
    alphabets, allowed, allowed_before, within, around = prepared
    found: list[tuple[int, int, str]] = []
    lower = text.lower()
    if any(word in lower for word in KEYWORDS):
        found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    found += [(*m.span(), "hex") for m in _LONG_HEX.finditer(text)]
    base = [(start, end) for start, end, _ in found]
    random: set[tuple[int, int]] = set()
    regions = sorted(m.span() for p in around for m in p.finditer(text))
    begins = [start for start, _ in regions]
    ends = list(accumulate((end for _, end in regions), max))
    for pattern, needs, alphabet in alphabets:
        for m in pattern.finditer(text):
            if not all(need.search(m[0]) for need in needs) or any(p.fullmatch(m[0]) for p in allowed):
                continue
            before = text[max(0, m.start() - _BEFORE) : m.start()]
            if any(p.search(before) for p in allowed_before):
                continue
            region = bisect_right(begins, m.start()) - 1
            if region >= 0 and m.start() < ends[region]:
                continue
            for at, upto in _parts(m[0], within):
                found_in = dense_windows(m[0][at:upto], alphabet.window, alphabet.bits)
                random.update((m.start() + at + a, m.start() + at + b) for a, b in found_in)
    # What the base patterns or a wider span already cover is not told again.
    covered = base + list(random)
    for span in random:
        if not any(a <= span[0] and span[1] <= b and (a, b) != span for a, b in covered) and span not in base:
            found.append((*span, "entropy"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def secret_spans(
    docs: DataFrame,
    *,
    alphabets: tuple[Alphabet, ...] = ALPHABETS,
    allowed: tuple[str, ...] = ALLOWED,
    allowed_before: tuple[str, ...] = ALLOWED_BEFORE,
    allowed_within: tuple[str, ...] = ALLOWED_WITHIN,
    allowed_around: tuple[str, ...] = ALLOWED_AROUND,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Id and spans (array of start, end, kind) of the secrets in every whole text.

    Offsets are code points, ends exclusive. The base patterns (assign, access,
    hex) are never held back; entropy spans are only those that no base span
    covers and the allow-list does not hold back. NULL and empty texts have no
    spans. One row per row of ``docs``; repeated rows and ids stay as they are;
    other columns are not read; an empty table gives an empty result.
    """

    def work():
        prepared = _prepared(alphabets, allowed, allowed_before, allowed_within, allowed_around)

        def of(texts):
            return [[[{"start": s, "end": e, "kind": k} for s, e, k in scan(t or "", prepared)] for t in texts]]

        return of

    spans = "array<struct<start:bigint,end:bigint,kind:string>>"
    return map_texts(docs, [("spans", spans)], work, id_col=id_col, text_col=text_col)


def span_digest(found: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """:func:`secret_spans` as counts, the digest of the base spans, and one string of all spans."""
    shown = "concat_ws(':', s.kind, s.start, s.end)"
    counts = [
        F.expr(f"CAST(size(filter(spans, s -> s.kind = '{kind}')) AS BIGINT)").alias(f"n_{kind}") for kind in KINDS[:3]
    ]
    base = f"array_join(transform(filter(spans, s -> s.kind <> 'entropy'), s -> {shown}), ',')"
    every = f"array_join(transform(spans, s -> {shown}), ',')"
    return found.select(
        id_col, *counts, F.sha2(F.expr(base).cast("binary"), 256).alias("base_sha256"), F.expr(every).alias("spans")
    )


def redact_secrets(
    docs: DataFrame,
    *,
    mark: str = "[SECRET]",
    text_col: str = "text",
    length_col: str = "n_chars",
    alphabets: tuple[Alphabet, ...] = ALPHABETS,
    allowed: tuple[str, ...] = ALLOWED,
    allowed_before: tuple[str, ...] = ALLOWED_BEFORE,
    allowed_within: tuple[str, ...] = ALLOWED_WITHIN,
    allowed_around: tuple[str, ...] = ALLOWED_AROUND,
) -> DataFrame:
    """``docs`` with every secret (spans that overlap count as one) replaced by ``mark``.

    All rows and columns stay; ``length_col``, if there is one, follows the new
    text where that changed. NULL texts stay NULL.
    """
    at = docs.columns.index(text_col)

    def run(batches):
        prepared = _prepared(alphabets, allowed, allowed_before, allowed_within, allowed_around)
        for batch in batches:
            for part in cut(batch, at):
                texts = part.column(at).to_pylist()
                clean = [None if t is None else blanked(t, scan(t, prepared), mark) for t in texts]
                columns = list(part.columns)
                columns[at] = pa.array(clean, part.schema.field(at).type)
                if length_col in part.schema.names:
                    place = part.schema.names.index(length_col)
                    kind = part.schema.field(place).type
                    sizes = zip(columns[place].to_pylist(), texts, clean, strict=True)
                    columns[place] = pa.array([n if a == b else len(b) for n, a, b in sizes], kind)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return docs.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema]))


def blanked(text: str, spans: list[tuple[int, int, str]], mark: str) -> str:
    merged: list[list[int]] = []
    for start, end, _ in spans:
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    parts, at = [], 0
    for start, end in merged:
        parts += [text[at:start], mark]
        at = end
    return "".join(parts) + text[at:]

