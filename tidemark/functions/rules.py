"""The validation rules, the one place to extend them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql.types import DecimalType

from tidemark.functions.text import is_blank
from tidemark.schemas import AMOUNT, QUANTITY


@dataclass(frozen=True)
class Rule:
    """A row is rejected with `message` where `broken` is true; both are SQL text.

    A message may use `quantity_text` and `amount_text`.
    """

    name: str
    broken: str
    message: str


def _not_a_size(c: str) -> str:
    """Null, NaN or negative; zero is a valid size."""
    x = f"cast({c} as double)"
    return f"({c} is null or isnan({x}) or {x} < 0)"


def _size_rule(name: str, kind: DecimalType) -> Rule:
    """A size that the stored decimal holds. Only numbers with as many digits before the
    point as it has, or nearly, are cast: that is an object and its text for each row."""
    invalid = _not_a_size(name)
    large = f"cast({name} as double) >= 1e{kind.precision - kind.scale - 1}D"
    return Rule(
        name,
        f"({invalid} or {large} and try_cast({name} as {kind.simpleString()}) is null)",
        f"concat(if({invalid}, '{name} is invalid: ', '{name} is out of range: '), {name}_text)",
    )


DEFAULT_RULES = [
    Rule("account_id", is_blank("account_id"), "'account_id is empty'"),
    Rule("asset_id", is_blank("asset_id"), "'asset_id is empty'"),
    Rule("reference_date", "reference_date is null", "'reference_date is null'"),
    _size_rule("quantity", QUANTITY),
    _size_rule("amount", AMOUNT),
]


def any_broken(rules: list[Rule]) -> str:
    return "(" + " or ".join(r.broken for r in rules) + ")"


def reasons(rules: list[Rule]) -> str:
    """All messages in rule order, joined by `; `; empty text for a good row."""
    return "concat_ws('; ', " + ", ".join(f"if({r.broken}, {r.message}, null)" for r in rules) + ")"


def broken_names(rules: list[Rule]) -> str:
    """Names of the broken rules as an array."""
    return "array_compact(array(" + ", ".join(f"if({r.broken}, '{r.name}', null)" for r in rules) + "))"
