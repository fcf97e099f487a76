"""Key building and repeatable pseudo-random values, as SQL expression text."""

from __future__ import annotations

from collections.abc import Callable

from tidemark.functions.text import quoted

Hash = Callable[..., str]

# The twenty asset codes of the test key space.
ASSETS = (
    "PETR4 VALE3 ITUB4 BBDC4 ABEV3 PERM4 RENT3 RADL3 HAPV3 WEGE3 "
    "CCRO3 EMBR3 GGBR4 CSNA3 USIM5 GOAU4 BRAP4 VALE5 FIBR3 CPFE3"
).split()

HASH_BITS = 60


def account_code(n: str) -> str:
    """`ACC` and the number padded to three digits; longer numbers just grow."""
    return f"format_string('ACC%03d', {n})"


def pick(values: list[str], index: str) -> str:
    """The element of a fixed list at a 0-based index."""
    items = ", ".join(quoted(v) for v in values)
    return f"element_at(array({items}), cast({index} + 1 as int))"


def date_series(anchor: str, days_back: int = 30) -> str:
    """The dates from `days_back` days before `anchor` up to `anchor`."""
    return f"sequence(date_sub({anchor}, {days_back}), {anchor})"


def fast_hash(*parts: str, seed: int = 0) -> str:
    """A non-negative 60-bit number that depends on the values and their types."""
    return f"shiftrightunsigned(xxhash64({seed}, {', '.join(parts)}), {64 - HASH_BITS})"


def portable_hash(*parts: str, seed: int = 0) -> str:
    """The same size of number from the values' text by MD5: slower, but any SQL
    engine can repeat it."""
    text = "concat_ws('|', " + ", ".join([f"'{seed}'", *[f"cast({p} as string)" for p in parts]]) + ")"
    return f"cast(conv(substring(md5({text}), 1, {HASH_BITS // 4}), 16, 10) as bigint)"


def uniform(
    low: int, high: int, decimals: int, *parts: str, seed: int = 0, hashed: Hash = fast_hash
) -> str:
    """An even value in `low .. high` with the given number of decimals, as double."""
    unit = 10**decimals
    steps = (high - low) * unit + 1
    return f"(({low * unit} + pmod({hashed(*parts, seed=seed)}, {steps}L)) / {float(unit)}D)"
