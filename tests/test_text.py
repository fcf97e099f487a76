"""Column functions against plain Python."""

import hashlib
import json
import math
from decimal import Decimal

import golden
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import keys, numbers
from tidemark.functions.rules import DEFAULT_RULES
from tidemark.functions.text import WHITESPACE, float_text, is_blank, record_hash, row_payload
from tidemark.schemas import AMOUNT, INPUT, QUANTITY

EDGES = [
    0.0, -0.0, 1.0, -100.0, 1e-3, 9.99e-4, 1e-4, 9.9e-5, 1.2345e-4, 1e7, 12345678.9, 1e15,
    9999999999999998.0, 1e16, 1.5e20, 1e22, 1e100, -2.5e-9, math.inf, -math.inf, math.nan, None,
    0.1 + 0.2, 1.7976931348623157e308,
]


def printed(spark, values):
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    return [r[0] for r in rows.select(F.expr(float_text("v"))).collect()]


def test_float_text_edges(spark):
    assert printed(spark, EDGES) == [str(v) for v in EDGES]


@settings(max_examples=3, deadline=None)
@given(st.lists(st.decimals("-1e12", "1e12", places=4), min_size=200, max_size=200))
def test_float_text_of_decimal_values(spark, values):
    assert printed(spark, [float(v) for v in values]) == [str(float(v)) for v in values]


def test_blank_is_what_strip_leaves_empty(spark):
    texts = [chr(c) for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    texts += ["", "  a ", " \t\n", "​", "　\x1f "]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    found = [r[0] for r in rows.select(F.expr(is_blank("t"))).collect()]
    assert found == [t.strip() == "" for t in texts]
    assert set(WHITESPACE) == {t for t in texts[:-5] if t.isspace()}
    assert spark.sql(f"select {is_blank('cast(null as string)')}").first()[0] is True


def test_record_hash_of_the_first_row(spark):
    rows = golden.frame(spark, golden.FILE[:1])
    hashed = rows.select(F.expr(record_hash(hash_text="repr")), F.expr(record_hash())).first()
    assert hashed[0] == hashlib.sha256(golden.FIRST_HASH_TEXT.encode()).hexdigest()
    stored = "ACC001|PETR4|2025-01-15 00:00:00|1500.0000|37500.00"
    assert hashed[1] == hashlib.sha256(stored.encode()).hexdigest()


def test_payload_is_json(spark):
    rows = spark.createDataFrame(
        [('a"}', "b}", None, math.nan, 1e20), (None, "", golden.DAY, None, -1.5)], INPUT
    ).selectExpr("*", *[f"{float_text(c)} as {c}_text" for c in ("quantity", "amount")])
    found = [json.loads(r[0]) for r in rows.select(F.expr(row_payload())).collect()]
    assert found == [
        {"account_id": 'a"}', "asset_id": "b}", "reference_date": None, "quantity": None, "amount": 1e20},
        {
            "account_id": None,
            "asset_id": "",
            "reference_date": "2025-01-15 00:00:00",
            "quantity": None,
            "amount": -1.5,
        },
    ]


def test_numbers(spark):
    row = (
        spark.range(1)
        .select(
            numbers.safe_div(F.lit(3), F.lit(0)),
            numbers.safe_div(F.lit(3), F.lit(2)),
            numbers.percent(F.lit(1), F.lit(8)),
            numbers.share_rounded(F.lit(1), F.lit(2)),
            numbers.share_rounded(F.lit(0), F.lit(0)),
            numbers.batch_count(F.lit(2001), 2000),
            numbers.batch_count(F.lit(0), 2000),
            numbers.batch_number(F.lit(2000), 2000),
            numbers.batch_number(F.lit(2001), 2000),
            numbers.update_share_column(F.lit(999), 60),
        )
        .first()
    )
    assert tuple(row) == (
        0.0, 1.5, 12.5, 33.33, 0.0, 2, 0, 1, 2, 599,
    )
    assert numbers.update_share(999, 60) == (599, 400)


def test_keys(spark):
    row = spark.range(1).selectExpr(
        keys.account_code("7"), keys.account_code("10000"), keys.pick(keys.ASSETS, "19"),
        f"size({keys.date_series('current_date()')})", keys.portable_hash("1", "'x'", seed=3),
        keys.uniform(10, 20, 2, "5"), keys.fast_hash("1", "'x'", seed=3),
    ).first()
    digest = hashlib.md5(b"3|1|x").hexdigest()
    assert tuple(row[:5]) == ("ACC007", "ACC10000", "CPFE3", 31, int(digest[:15], 16))
    assert 10 <= row[5] <= 20
    assert 0 <= row[6] < 1 << keys.HASH_BITS


def test_nanoseconds(spark):
    from tidemark.sources.files import nanoseconds_to_timestamp

    rows = spark.createDataFrame([(1736899200123456789,), (-1,), (0,), (None,)], "n long")
    found = [str(r[0]) for r in rows.select(nanoseconds_to_timestamp(F.col("n"))).collect()]
    assert found == [
        "2025-01-15 00:00:00.123456",
        "1969-12-31 23:59:59.999999",
        "1970-01-01 00:00:00",
        "None",
    ]


def test_range_rules_cast_none_but_large_numbers(spark):
    """The range test equals the cast, also next to the bounds and where a double is coarser than the column."""
    doubles = [0.0, 1.5, 9999999999999.99, 1e13, 1e14, 1e15, 1e16, 1e300]
    doubles += [math.nextafter(x, to) for x in (1e13, 1e14, 1e15, 1e16) for to in (0.0, math.inf)]
    decimals = ["99999999999999.999", "99999999999999.9999", "99999999999999.99995", "100000000000000.0000", "1"]
    wide = spark.createDataFrame([(Decimal(d),) for d in decimals], "v decimal(38,10)")
    for values in (spark.createDataFrame([(d,) for d in doubles], "v double"), wide):
        for rule, kind in zip(DEFAULT_RULES[-2:], (QUANTITY, AMOUNT), strict=True):
            rows = values.withColumnRenamed("v", rule.name)
            cast = f"try_cast({rule.name} as {kind.simpleString()}) is null"
            assert rows.filter(f"({rule.broken}) <> ({cast})").count() == 0
            assert 0 < rows.filter(rule.broken).count() < rows.count() or kind == AMOUNT
