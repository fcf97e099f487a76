"""The smallest end-to-end case: 3 seeded rows, a file of 24 rows."""

from __future__ import annotations

import datetime as dt

from tidemark.schemas import INPUT

DAY, NEXT = dt.datetime(2025, 1, 15), dt.datetime(2025, 1, 16)

# Seed rows and file rows.
SEED = [
    ("ACC001", "PETR4", DAY, 1000.0, 25000.0),
    ("ACC001", "VALE3", DAY, 500.0, 15000.0),
    ("ACC002", "ITUB4", DAY, 2000.0, 70000.0),
]

FILE = [
    ("ACC001", "PETR4", DAY, 1500.0, 37500.0),
    ("ACC001", "VALE3", DAY, 800.0, 24000.0),
    ("ACC002", "ITUB4", DAY, 2200.0, 77000.0),
    ("ACC001", "PETR4", NEXT, 1600.0, 40000.0),
    ("ACC001", "VALE3", NEXT, 600.0, 18000.0),
    ("ACC001", "BBAS3", DAY, 3000.0, 90000.0),
    ("ACC001", "BBAS3", NEXT, 3100.0, 93000.0),
    ("ACC002", "PETR4", DAY, 500.0, 12500.0),
    ("ACC002", "PETR4", NEXT, 550.0, 13750.0),
    ("ACC002", "VALE3", DAY, 700.0, 21000.0),
    ("ACC002", "VALE3", NEXT, 750.0, 22500.0),
    ("ACC003", "WEGE3", DAY, 1200.0, 36000.0),
    ("ACC003", "WEGE3", NEXT, 1250.0, 37500.0),
    ("ACC003", "ABEV3", DAY, 10000.0, 150000.0),
    ("ACC003", "ABEV3", NEXT, 10200.0, 153000.0),
    ("ACC004", "MGLU3", DAY, 5000.0, 25000.0),
    ("ACC004", "MGLU3", NEXT, 5200.0, 26000.0),
    ("ACC004", "BBDC4", DAY, 800.0, 12000.0),
    ("ACC004", "BBDC4", NEXT, 820.0, 12300.0),
    ("ACC005", "ITUB4", DAY, 3500.0, 122500.0),
    ("ACC006", "INVL1", DAY, -100.0, 5000.0),
    ("", "INVL2", DAY, 200.0, 6000.0),
    ("ACC007", "", DAY, 300.0, 7000.0),
    ("ACC008", "INVL4", DAY, 400.0, -500.0),
]

# Row 0 of FILE as the shortest float text, hashed.
FIRST_HASH_TEXT = "ACC001|PETR4|2025-01-15 00:00:00|1500.0|37500.0"


def frame(spark, rows):
    return spark.createDataFrame(rows, INPUT).coalesce(1)


def write(spark, rows, path):
    frame(spark, rows).write.mode("append").parquet(str(path))
