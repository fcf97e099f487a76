"""The given tables seen as custody data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.numbers import int_div
from tidemark.operators.dedup import last_per_key
from tidemark.operators.merging import collapse
from tidemark.schemas import KEY, VALUES

RUN_TS = "2025-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def no_rows(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def run_ts() -> Column:
    return F.lit(RUN_TS).cast("timestamp_ntz")


def present(rows: DataFrame) -> DataFrame:
    """Decimals as double, dates and timestamps as text: types every client agrees on."""

    def plain(field: T.StructField) -> Column:
        c = F.col(field.name)
        if isinstance(field.dataType, T.DecimalType):
            return c.cast("double").alias(field.name)
        if isinstance(field.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return c.cast("string").alias(field.name)
        return c

    return rows.select(*[plain(f) for f in rows.schema])


def custody_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as staged rows; `seq` is the event number, unique and dense."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id as seq",
        "cast(user_id as string) as account_id",
        "event_type as asset_id",
        "cast(ts as date) as reference_date",
        "cast(get_json_object(props, '$.k') as decimal(18,4)) as quantity",
        "cast(value as decimal(18,2)) as amount",
        "ts as created_at",
    )


def share(rows: DataFrame, part: int) -> Column:
    """The number of rows divided by `part`, as a scalar subquery."""
    return rows.agg(int_div(F.count(F.lit(1)), part).alias("n")).scalar()


def half(events: DataFrame) -> Column:
    """Half of the highest `seq`, as a scalar subquery."""
    return F.shiftright(events.agg(F.max("seq").alias("m")).scalar(), 1)


def events_until_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = custody_events(spark, sf_dir)
    return events.filter(F.col("seq") <= half(events))


def target(spark: SparkSession, sf_dir: str, key: list[str] = KEY) -> DataFrame:
    """Principal table: last values per key of the first half."""
    first = events_until_half(spark, sf_dir)
    return first.groupBy(*key).agg(
        *[F.max_by(v, "seq").alias(v) for v in VALUES],
        F.max_by("created_at", "seq").alias("updated_at"),
        F.min_by("created_at", "seq").alias("created_at"),
    )


def target_values(spark: SparkSession, sf_dir: str, key: list[str] = KEY) -> DataFrame:
    return last_per_key(events_until_half(spark, sf_dir), key, VALUES, "seq")


def staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staged rows: everything after the first quarter, so half of the target is
    staged once more."""
    events = custody_events(spark, sf_dir)
    return events.filter(F.col("seq") > F.shiftright(half(events), 1))


def collapsed(spark: SparkSession, sf_dir: str, key: list[str] = KEY) -> DataFrame:
    return collapse(staged(spark, sf_dir), key)


def custody_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as file rows; every fiftieth row per kind gets a fault."""
    return table(spark, sf_dir, "customer").selectExpr(
        "concat('s3://landing/nation_', c_nationkey, '.parquet') as source_file",
        "c_custkey as row_number",
        """case c_custkey % 50 when 1 then '' when 2 then null when 11 then ' '
           else c_name end as account_id""",
        "case c_custkey % 50 when 3 then ' \\t ' when 12 then null else c_mktsegment end as asset_id",
        """case c_custkey % 50 when 4 then null when 11 then null
           else cast(date_add(date'2024-01-01', cast(c_custkey % 31 as int)) as timestamp_ntz)
           end as reference_date""",
        """case c_custkey % 50 when 5 then null when 6 then double('nan') when 7 then -1.5D
           when 10 then 1e15D else cast(c_nationkey as double) end as quantity""",
        """case c_custkey % 50 when 8 then null when 9 then double('nan') when 11 then -2.0D
           else c_acctbal end as amount""",
    )


def custody_lineitems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as file rows with the file's own types."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "cast(l_suppkey as string) as account_id",
        "cast(l_partkey as string) as asset_id",
        "l_shipdate as reference_date",
        "l_quantity as quantity",
        "l_extendedprice as amount",
    )


def page_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as notifications of eight kinds: plain, enveloped, envelope with
    text that is no JSON, no bucket, no key, other suffix, two records, no JSON."""
    shaped = table(spark, sf_dir, "pages").selectExpr(
        "page_id",
        "page_id % 8 as kind",
        "regexp_extract(url, '^https?://([^/]+)/', 1) as bucket",
        "concat('input/', page_id, if(page_id % 8 = 5, '.csv', '.parquet')) as key",
    )
    record = """
        concat('{"s3":{"bucket":{', if(kind = 3, '', concat('"name":"', bucket, '"')),
               '},"object":{', if(kind = 4, '', concat('"key":"', key, '"')), '}}}')"""
    again = """, concat(',{"s3":{"bucket":{"name":"', bucket, '"},"object":{"key":"again/', key, '"}}}')"""
    return (
        shaped.selectExpr("*", f"{record} as record")
        .selectExpr(
            "*",
            f"""concat('{{"Records":[', record, if(kind = 6 {again}, ''), ']}}') as event""",
        )
        .selectExpr(
            "page_id",
            """case kind
                 when 1 then to_json(named_struct('Type', 'Notification', 'Message', event))
                 when 2 then to_json(named_struct('Type', 'Notification', 'Message', concat('{', bucket)))
                 when 7 then concat('{', event)
                 else event end as body""",
        )
    )
