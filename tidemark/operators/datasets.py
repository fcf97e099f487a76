"""Key spaces, record sets and change sets of a given size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.keys import (
    ASSETS,
    account_code,
    Hash,
    fast_hash,
    pick,
    uniform,
)
from tidemark.functions.numbers import int_div, update_share
from tidemark.operators.ordering import sample_rows
from tidemark.schemas import KEY


def key_at(position: str, anchor: str, days_back: int = 30) -> list[str]:
    """The key at a 0-based position of accounts x assets x dates.

    The product is never joined: a position is split into its three digits.
    """
    days, assets = days_back + 1, len(ASSETS)
    return [
        f"{account_code(f'{position} div {assets * days} + 1')} as account_id",
        f"{pick(ASSETS, f'{position} div {days} % {assets}')} as asset_id",
        f"date_sub({anchor}, cast({position} % {days} as int)) as reference_date",
    ]


def key_space(spark: SparkSession, accounts: int, anchor: str, days_back: int = 30) -> DataFrame:
    """All keys of the first `accounts` accounts with their `position`."""
    total = accounts * len(ASSETS) * (days_back + 1)
    return spark.range(total).selectExpr("id as position", *key_at("id", anchor, days_back))


def account_keys(accounts: DataFrame, index: str, anchor: str, days_back: int = 30) -> DataFrame:
    """The key space of the accounts in a table; `index` counts them from 0.

    Every account row becomes a fixed number of keys, in its own task.
    """
    per_account = len(ASSETS) * (days_back + 1)
    first = f"{index} * {per_account}"
    positions = accounts.selectExpr(f"explode(sequence({first}, {first} + {per_account - 1})) as position")
    return positions.selectExpr("position", *key_at("position", anchor, days_back))


def allocate_files(keys: DataFrame, rows_per_file: int) -> DataFrame:
    """Adds `file_number`; keys of one file are successive positions."""
    return keys.withColumn("file_number", int_div(F.col("position"), rows_per_file))


def allocated_records(
    spark: SparkSession,
    files: int,
    rows_per_file: int,
    anchor: str,
    accounts: int = 10_000,
    days_back: int = 30,
    seed: int = 0,
) -> DataFrame:
    """`files` x `rows_per_file` records without a repeated key, in file order."""
    available = accounts * len(ASSETS) * (days_back + 1)
    wanted = files * rows_per_file
    if wanted > available:
        raise ValueError(f"requested {wanted} unique records but only {available} available")
    keys = spark.range(wanted).selectExpr("id as position", *key_at("id", anchor, days_back))
    return allocate_files(with_new_values(keys, seed), rows_per_file)


def with_new_values(keys: DataFrame, seed: int = 0, hashed: Hash = fast_hash) -> DataFrame:
    """Adds a quantity in 10 .. 10,000 and an amount in 100 .. 1,000,000."""
    return keys.selectExpr(
        "*",
        f"{uniform(10, 10_000, 4, *KEY, seed=2 * seed + 1, hashed=hashed)} as quantity",
        f"{uniform(100, 1_000_000, 2, *KEY, seed=2 * seed + 2, hashed=hashed)} as amount",
    )


def random_position(row_id: str, accounts: int, days_back: int, seed: int, hashed: Hash = fast_hash) -> str:
    """An even random position of the key space; the same one may come up again."""
    total = accounts * len(ASSETS) * (days_back + 1)
    return f"pmod({hashed(row_id, seed=seed)}, {total}L) as _position"


def random_records(
    rows: DataFrame,
    row_id: str,
    anchor: str,
    accounts: int = 10_000,
    days_back: int = 30,
    seed: int = 0,
    hashed: Hash = fast_hash,
) -> DataFrame:
    """One random record per input row; keys may repeat, values differ by row."""
    # The position is a column of its own, so that it is hashed once per row.
    return rows.selectExpr(row_id, random_position(row_id, accounts, days_back, seed, hashed)).selectExpr(
        row_id,
        *key_at("_position", anchor, days_back),
        f"{uniform(10, 10_000, 4, row_id, seed=seed + 1, hashed=hashed)} as quantity",
        f"{uniform(100, 1_000_000, 2, row_id, seed=seed + 2, hashed=hashed)} as amount",
    )


def unique_records(
    rows: DataFrame,
    row_id: str,
    count: int | Column,
    anchor: str,
    accounts: int = 10_000,
    days_back: int = 30,
    seed: int = 0,
    hashed: Hash = fast_hash,
) -> DataFrame:
    """Up to `count` random records without a repeated key.

    `rows` should hold about three times `count` rows: each is one attempt.
    Fewer records come back if the attempts hit too few different keys.
    """
    positions = rows.selectExpr(random_position(row_id, accounts, days_back, seed, hashed)).distinct()
    keys = positions.selectExpr(*key_at("_position", anchor, days_back))
    return with_new_values(sample_rows(keys, KEY, count, seed, hashed), seed, hashed)


def fresh_keys(candidates: DataFrame, existing: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Distinct candidate keys that do not exist yet."""
    return candidates.select(*key).distinct().join(existing.select(*key), key, "left_anti")


def used_keys(first: DataFrame, second: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Union of two key sets without repeats."""
    return first.select(*key).union(second.select(*key)).distinct()


def change_set(
    existing: DataFrame,
    candidates: DataFrame,
    rows: int | Column,
    update_percent: int,
    key: list[str] = KEY,
    seed: int = 0,
    hashed: Hash = fast_hash,
) -> DataFrame:
    """`rows` records: the given share hits existing keys, the rest is new.

    Both parts are exact samples in hash order, see `sample_rows`.
    """
    updates, inserts = update_share(rows, update_percent)
    old = sample_rows(existing.select(*key), key, updates, seed, hashed)
    new = sample_rows(fresh_keys(candidates, existing, key), key, inserts, seed, hashed)
    both = old.withColumn("kind", F.lit("update")).unionByName(new.withColumn("kind", F.lit("insert")))
    return with_new_values(both, seed, hashed)
