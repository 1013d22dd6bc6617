"""Text keys and redaction as Column expressions (JVM side, no UDF)."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# The legal-form and security words left out of a name key.
NAME_NOISE_WORDS = (
    "THE", "INC", "INCORPORATED", "CORP", "CORPORATION", "CO", "COMPANY", "LLC", "LTD", "LIMITED",
    "PLC", "LP", "LLP", "NA", "COM", "COMMON", "STOCK", "SHS", "CL", "CLASS",
)

# Employers that name no employer.
EMPLOYER_STOP_WORDS = (
    "SELF", "SELF EMPLOYED", "SELF-EMPLOYED", "RETIRED", "NONE", "N/A", "NA", "NOT EMPLOYED",
    "UNEMPLOYED", "HOMEMAKER", "STUDENT", "INFORMATION REQUESTED",
    "INFORMATION REQUESTED PER BEST EFFORTS", "REQUESTED",
)

# Credential shapes (pattern, replacement), applied in this order.
SECRET_ASSIGNMENT = (
    r"(?i)\b((?:[a-z0-9]+[_-])*(?:api[_-]?key|access[_-]?key|access[_-]?token|auth(?:entication)?|"
    r"authorization|credential|password|passwd|secret(?:[_-]access)?[_-]?key|secret|token|private[_-]?key)"
    r"(?:[_-][a-z0-9]+)*)\s*[:=]\s*(?:Bearer\s+)?[^,;\s]+"
)
BEARER_TOKEN = r"(?i)\bBearer\s+[A-Za-z0-9._~+/=-]{8,}"
TOKEN_PREFIX = r"\b(?:sk_live_|ghp_|github_pat_|xox[baprs]-|AKIA)[A-Za-z0-9_./+=-]{8,}"
URL_USERINFO = r"(?i)\b(https?://)[^/\s:@]+:[^@\s/]+@"
REDACTIONS = (
    (SECRET_ASSIGNMENT, "$1=[redacted]"),
    (BEARER_TOKEN, "Bearer [redacted]"),
    (TOKEN_PREFIX, "[redacted]"),
    (URL_USERINFO, "$1[redacted]@"),
)

# Fixed value: column names whose content is withheld from output.
SENSITIVE_COLUMN = (
    r"(?i)(?:api[_-]?key|access[_-]?token|auth(?:entication)?|authorization|credential|password|"
    r"passwd|secret|token|private[_-]?key)"
)


def column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def upper_trim(value: Column | str) -> Column:
    return F.upper(F.trim(column(value)))


def blank_to_null(value: Column | str) -> Column:
    """Trimmed text, NULL when nothing is left."""
    return F.nullif(F.trim(column(value)), F.lit(""))


def name_key(value: Column | str) -> Column:
    """Comparable form of a person or company name: no brackets, punctuation or legal form."""
    text = F.upper(F.coalesce(column(value), F.lit("")))
    text = F.regexp_replace(text, r"\([^)]*\)", " ")
    text = F.regexp_replace(text, r"[^A-Z0-9]+", " ")
    text = F.regexp_replace(text, r"\b(" + "|".join(NAME_NOISE_WORDS) + r")\b", " ")
    return F.trim(F.regexp_replace(text, r" +", " "))


def registrant_key(value: Column | str) -> Column:
    """Registrant name without punctuation and with every AND (also '&') dropped."""
    text = F.regexp_replace(F.upper(F.coalesce(column(value), F.lit(""))), r"[^A-Z0-9]+", " ")
    return F.trim(F.regexp_replace(text, r" AND ", " "))


def address_key(value: Column | str) -> Column:
    """Letters and digits of an address, lower case."""
    return F.lower(F.regexp_replace(column(value), r"[^\p{L}\p{N}]", ""))


def postcode_key(value: Column | str) -> Column:
    return F.upper(F.replace(F.trim(column(value)), F.lit(" "), F.lit("")))


def contains_any(value: Column | str, phrases: tuple[str, ...]) -> Column:
    """Whether the lower-cased text holds one of the phrases; NULL text counts as empty."""
    text = F.lower(F.coalesce(column(value), F.lit("")))
    return reduce(or_, [text.contains(phrase) for phrase in phrases])


def word_prefixes(key: Column) -> Column:
    """Every prefix of a key that ends at a word boundary, the whole key included."""
    words = F.split(key, " ")
    return F.transform(
        F.sequence(F.lit(1), F.size(words)), lambda n: F.array_join(F.slice(words, 1, n), " ")
    )


def split_list(text: str, separator: str = "|") -> list[str]:
    """Items of a parameter such as 'A | B', trimmed, blanks dropped."""
    return [item.strip() for item in text.split(separator) if item.strip()]


def redact_text(value: Column | str) -> Column:
    """Replace credential-shaped parts of a text."""
    text = column(value)
    for pattern, replacement in REDACTIONS:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def decimal_round(value: Column | str, places: int) -> Column:
    """Binary rounding, as SQL engines without decimal text rounding do it (1.005 -> 1.0)."""
    scale = float(10**places)
    return F.round(column(value) * F.lit(scale), 0) / F.lit(scale)
