"""Text forms: blank test, float text, record hash, row payload.

The functions take and return SQL expression text: one parse on the JVM side
instead of a Python call per operation. Use them with `F.expr`.
"""

from __future__ import annotations

from tidemark.schemas import AMOUNT, QUANTITY

# The Unicode white space a text strip removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def quoted(text: str) -> str:
    """A SQL string literal."""
    escaped = "".join(ch if ch.isalnum() and ch.isascii() else f"\\u{ord(ch):04x}" for ch in text)
    return f"'{escaped}'"


def is_blank(c: str) -> str:
    """True for null, empty and white-space-only text.

    `ltrim` with a character list stops at the first other character, so a
    normal id costs one comparison.
    """
    return f"coalesce(ltrim({quoted(WHITESPACE)}, {c}) = '', true)"


def float_text(c: str) -> str:
    """A double printed with the shortest digits: fixed notation from 1e-4 up
    to 1e16, otherwise `1.5e+20`; `nan`, `inf` and `None` spelled out.

    Outside 1e-3 .. 1e7 the JVM prints 1.5E7. Reading that text as a wide
    decimal keeps its digits, none are invented.
    """
    x = f"cast({c} as double)"
    shortest = f"cast({x} as string)"
    trimmed = f"regexp_replace(cast(try_cast({shortest} as decimal(38,21)) as string), '0+$', '')"
    exponent = f"try_cast(substring_index({shortest}, 'E', -1) as int)"
    return f"""
        case when {c} is null then 'None'
             when isnan({x}) then 'nan'
             when abs({x}) = double('inf') then if({x} > 0, 'inf', '-inf')
             when {x} = 0 or abs({x}) >= 1e-3 and abs({x}) < 1e7 then {shortest}
             when abs({x}) >= 1e-4 and abs({x}) < 1e16
             then regexp_replace({trimmed}, '[.]$', '.0')
             else concat(regexp_replace(substring_index({shortest}, 'E', 1), '[.]0$', ''),
                         if({exponent} < 0, 'e-', 'e+'), format_string('%02d', abs({exponent})))
        end"""


def float_texts(*columns: str) -> str:
    """The float texts of several columns as an array.

    One lambda for all of them: the expression is large, and copies of it would
    make the generated code of a projection too large for the JIT compiler.
    """
    items = ", ".join(f"cast({c} as double)" for c in columns)
    return f"transform(array({items}), x -> {float_text('x')})"


def date_text(c: str) -> str:
    """`yyyy-MM-dd HH:mm:ss`, with a fraction only where there is one.

    A cast does not depend on the session time zone for a zone-free timestamp.
    """
    return f"cast(cast({c} as timestamp_ntz) as string)"


def record_hash(
    account_id: str = "account_id",
    asset_id: str = "asset_id",
    reference_date: str = "reference_date",
    quantity: str = "quantity",
    amount: str = "amount",
    hash_text: str = "decimal",
) -> str:
    """SHA-256 hex of the five fields joined by `|`.

    `hash_text="decimal"` prints the numbers as stored, `"repr"` as the shortest
    float text of the file's doubles.
    """
    if hash_text == "decimal":
        numbers = (
            f"cast(try_cast({quantity} as {QUANTITY.simpleString()}) as string), "
            f"cast(try_cast({amount} as {AMOUNT.simpleString()}) as string)"
        )
    elif hash_text == "repr":
        numbers = float_texts(quantity, amount)
    else:
        raise ValueError(f"unknown hash_text {hash_text!r}")
    return f"sha2(concat_ws('|', {account_id}, {asset_id}, {date_text(reference_date)}, {numbers}), 256)"


def row_payload(
    account_id: str = "account_id",
    asset_id: str = "asset_id",
    reference_date: str = "reference_date",
    quantity_text: str = "quantity_text",
    amount_text: str = "amount_text",
) -> str:
    """The rejected row as JSON: ids and date as text, numbers as numbers.

    The numbers come as float texts and are put after the text fields by hand.
    NaN and infinities become null: JSON has no such number.
    """

    def number(text: str) -> str:
        return f"if({text} in ('None', 'nan', 'inf', '-inf'), 'null', {text})"

    texts = f"""
        to_json(named_struct(
            'account_id', cast({account_id} as string),
            'asset_id', cast({asset_id} as string),
            'reference_date', {date_text(reference_date)}), map('ignoreNullFields', 'false'))"""
    return f"""
        concat(regexp_replace({texts}, '}}$', ''),
               ',"quantity":', {number(quantity_text)}, ',"amount":', {number(amount_text)}, '}}')"""
