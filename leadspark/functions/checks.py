"""Argument checks: every detector parameter has a type and bounds."""

from __future__ import annotations


class ParameterError(ValueError):
    """A parameter is of the wrong type or outside its bounds."""


def number(name: str, value, low: float, high: float) -> float:
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not low <= value <= high:
        raise ParameterError(f"{name} must be a number from {low} to {high}")
    return value


def integer(name: str, value, low: int, high: int) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or not low <= value <= high:
        raise ParameterError(f"{name} must be an integer from {low} to {high}")
    return value


def at_least(name: str, value, low: int) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value < low:
        raise ParameterError(f"{name} must be an integer of at least {low}")
    return value


def text(name: str, value, longest: int) -> str:
    if not isinstance(value, str) or len(value) > longest:
        raise ParameterError(f"{name} must be text of at most {longest} characters")
    return value


def row_limit(value: int | None) -> int | None:
    """``None`` reports every lead; a number is the caller's own top-k."""
    return None if value is None else at_least("limit", value, 1)
