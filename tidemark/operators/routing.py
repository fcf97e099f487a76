"""Validation, typing and routing of file rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import rules as R
from tidemark.functions.text import float_texts, record_hash, row_payload
from tidemark.schemas import AMOUNT, KEY, QUANTITY, VALUES

FIELDS = KEY + VALUES

STAGED, REJECTED = "staged", "rejected"
DUPLICATE_REASON = "duplicate record in file"


def flag(rows: DataFrame, rules: list[R.Rule] = R.DEFAULT_RULES, hash_text: str = "decimal") -> DataFrame:
    """Adds `is_valid`, and `record_hash` for valid rows."""
    return rows.withColumn("is_valid", F.expr(f"not {R.any_broken(rules)}")).withColumn(
        "record_hash", F.expr(f"if(is_valid, {record_hash(hash_text=hash_text)}, null)")
    )


def explain(
    flagged: DataFrame, rules: list[R.Rule] = R.DEFAULT_RULES, rejected: str = "not is_valid"
) -> DataFrame:
    """Adds `error_reason` and `payload` for rejected rows; others cost one test."""
    columns = [f"`{c}`" for c in flagged.columns]
    texts = f"if({rejected}, {float_texts('quantity', 'amount')}, null) as _texts"
    return (
        flagged.selectExpr(*columns, texts)
        .selectExpr(*columns, "_texts[0] as quantity_text", "_texts[1] as amount_text")
        .selectExpr(
            *columns,
            f"if({rejected}, {R.reasons(rules)}, null) as error_reason",
            f"if({rejected}, {row_payload()}, null) as payload",
        )
    )


def annotate(
    rows: DataFrame, rules: list[R.Rule] = R.DEFAULT_RULES, hash_text: str = "decimal"
) -> DataFrame:
    """One pass that tells good from bad rows and describes both."""
    return explain(flag(rows, rules, hash_text), rules)


def typed(rows: DataFrame) -> DataFrame:
    """File types to table types: date, decimal(18,4), decimal(18,2), half up."""
    return rows.withColumns(
        {
            "reference_date": F.col("reference_date").cast("date"),
            "quantity": F.col("quantity").try_cast(QUANTITY),
            "amount": F.col("amount").try_cast(AMOUNT),
        }
    )


def valid_rows(
    rows: DataFrame, rules: list[R.Rule] = R.DEFAULT_RULES, hash_text: str = "decimal"
) -> DataFrame:
    """Good rows only, typed and hashed."""
    hashed = rows.filter(f"not {R.any_broken(rules)}").withColumn(
        "record_hash", F.expr(record_hash(hash_text=hash_text))
    )
    return typed(hashed)


def error_rows(rows: DataFrame, rules: list[R.Rule] = R.DEFAULT_RULES) -> DataFrame:
    """Bad rows only, with reason and payload instead of the fields."""
    explained = explain(rows.filter(R.any_broken(rules)), rules, rejected="true")
    return explained.drop(*FIELDS)


def ingest_counters(
    rows: DataFrame, by: list[str], rules: list[R.Rule] = R.DEFAULT_RULES
) -> DataFrame:
    """Rows read, valid and invalid per group; partial counts stay map-side."""
    flagged = rows.select(*by, F.expr(f"not {R.any_broken(rules)}").alias("is_valid"))
    return flagged.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if("is_valid").alias("valid"),
        F.count_if(~F.col("is_valid")).alias("invalid"),
    )
