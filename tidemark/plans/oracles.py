"""The registered queries as plain SQL over the same tables, for comparison."""

from __future__ import annotations

from tidemark.functions.keys import ASSETS

RUN_TS = "2025-01-01 00:00:00"

EVENTS = """
ev AS (
  SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS account_id, event_type AS asset_id,
         CAST(ts AS DATE) AS reference_date,
         CAST(json_extract_string(props, '$.k') AS DECIMAL(18,4)) AS quantity,
         CAST(value AS DECIMAL(18,2)) AS amount, ts AS created_at
  FROM events),
limits AS (SELECT max(seq) // 2 AS h FROM ev),
old AS (SELECT ev.* FROM ev, limits WHERE seq <= h),
staged AS (SELECT ev.* FROM ev, limits WHERE seq > h // 2)"""


def sides(key: str = "account_id, asset_id, reference_date") -> str:
    """Events, the target, and the staged rows collapsed per key."""
    return f"""{EVENTS},
tgt AS (
  SELECT {key}, arg_max(quantity, seq) AS quantity, arg_max(amount, seq) AS amount,
         arg_max(created_at, seq) AS updated_at, arg_min(created_at, seq) AS created_at
  FROM old GROUP BY {key}),
col AS (
  SELECT {key}, arg_max(quantity, seq) AS quantity, arg_max(amount, seq) AS amount,
         arg_min(created_at, seq) AS created_at, count(*) AS versions
  FROM staged GROUP BY {key})"""


SAME_KEY = "s.account_id = t.account_id AND s.asset_id = t.asset_id AND s.reference_date = t.reference_date"
KEY_OUT = "{a}.account_id, {a}.asset_id, CAST({a}.reference_date AS VARCHAR) AS reference_date"
NUM_OUT = "CAST({a}.quantity AS DOUBLE) AS quantity, CAST({a}.amount AS DOUBLE) AS amount"
CHANGED = "(s.quantity IS DISTINCT FROM t.quantity OR s.amount IS DISTINCT FROM t.amount)"


def key_out(a: str) -> str:
    return KEY_OUT.format(a=a)


def num_out(a: str) -> str:
    return NUM_OUT.format(a=a)


CUSTOMERS = """
cu AS (
  SELECT 's3://landing/nation_' || c_nationkey || '.parquet' AS source_file,
         c_custkey AS row_number,
         CASE c_custkey % 50 WHEN 1 THEN '' WHEN 2 THEN NULL WHEN 11 THEN ' ' ELSE c_name END AS account_id,
         CASE c_custkey % 50 WHEN 3 THEN ' ' || chr(9) || ' ' WHEN 12 THEN NULL ELSE c_mktsegment END AS asset_id,
         CASE c_custkey % 50 WHEN 4 THEN NULL WHEN 11 THEN NULL
              ELSE CAST(DATE '2024-01-01' + CAST(c_custkey % 31 AS INTEGER) AS TIMESTAMP) END AS reference_date,
         CASE c_custkey % 50 WHEN 5 THEN NULL WHEN 6 THEN CAST('nan' AS DOUBLE) WHEN 7 THEN CAST(-1.5 AS DOUBLE)
              WHEN 10 THEN CAST(1e15 AS DOUBLE) ELSE CAST(c_nationkey AS DOUBLE) END AS quantity,
         CASE c_custkey % 50 WHEN 8 THEN NULL WHEN 9 THEN CAST('nan' AS DOUBLE) WHEN 11 THEN CAST(-2.0 AS DOUBLE)
              ELSE c_acctbal END AS amount
  FROM customer),
faults AS (
  SELECT *,
         account_id IS NULL OR trim(account_id, ' ' || chr(9)) = '' AS bad_account,
         asset_id IS NULL OR trim(asset_id, ' ' || chr(9)) = '' AS bad_asset,
         reference_date IS NULL AS bad_date,
         quantity IS NULL OR isnan(quantity) OR quantity < 0 AS bad_quantity,
         coalesce(abs(quantity) >= 1e14 AND NOT isnan(quantity), false) AS big_quantity,
         amount IS NULL OR isnan(amount) OR amount < 0 AS bad_amount
  FROM cu),
checked AS (
  SELECT *,
         NOT (bad_account OR bad_asset OR bad_date OR bad_quantity OR big_quantity OR bad_amount) AS is_valid,
         concat_ws(',', CASE WHEN bad_account THEN 'account_id' END, CASE WHEN bad_asset THEN 'asset_id' END,
                   CASE WHEN bad_date THEN 'reference_date' END,
                   CASE WHEN bad_quantity OR big_quantity THEN 'quantity' END,
                   CASE WHEN bad_amount THEN 'amount' END) AS broken,
         concat_ws('; ', CASE WHEN bad_account THEN 'account_id is empty' END,
                   CASE WHEN bad_asset THEN 'asset_id is empty' END,
                   CASE WHEN bad_date THEN 'reference_date is null' END,
                   CASE WHEN bad_quantity THEN 'quantity is invalid: ' || coalesce(CAST(quantity AS VARCHAR), 'None')
                        WHEN big_quantity THEN 'quantity is out of range: ' || CAST(quantity AS VARCHAR) END,
                   CASE WHEN bad_amount THEN 'amount is invalid: ' || coalesce(CAST(amount AS VARCHAR), 'None') END
         ) AS error_reason
  FROM faults)"""

LINES = """
li AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS account_id, CAST(l_partkey AS VARCHAR) AS asset_id,
         l_shipdate AS reference_date, l_quantity AS quantity, l_extendedprice AS amount
  FROM lineitem)"""


def hash60(text: str, seed: int) -> str:
    """The first 60 bits of an MD5 as a number."""
    return f"CAST('0x' || substr(md5('{seed}|' || {text}), 1, 15) AS BIGINT)"


KEY_TEXT = "account_id || '|' || asset_id || '|' || CAST(reference_date AS VARCHAR)"


def uniform(low: int, high: int, unit: int, text: str, seed: int) -> str:
    steps = (high - low) * unit + 1
    return f"CAST({low * unit} + {hash60(text, seed)} % {steps} AS DOUBLE) / {unit}"


def digits(position: str) -> str:
    """A position of accounts x assets x dates as a key."""
    names = ", ".join(f"'{a}'" for a in ASSETS)
    return f"""
    printf('ACC%03d', {position} // 620 + 1) AS account_id,
    ([{names}])[CAST({position} // 31 % 20 + 1 AS INTEGER)] AS asset_id,
    DATE '2025-01-31' - CAST({position} % 31 AS INTEGER) AS reference_date"""


SPACE = f"""
positions AS (
  SELECT s_suppkey * 620 + unnest(range(620)) AS position FROM supplier),
space AS (SELECT position, {digits('position')} FROM positions)"""

# Each version against the one before it, the first against the target.
HISTORY = f"""{sides('account_id, asset_id')},
numbered AS (SELECT *, row_number() OVER (ORDER BY seq) AS position FROM staged),
batched AS (SELECT *, (position - 1) // 2000 + 1 AS batch FROM numbered),
versions AS (
  SELECT account_id, asset_id, batch, arg_max(quantity, seq) AS quantity, arg_max(amount, seq) AS amount,
         count(*) AS n
  FROM batched GROUP BY account_id, asset_id, batch),
lagged AS (
  SELECT *, lag(quantity) OVER w AS q0, lag(amount) OVER w AS a0, row_number() OVER w AS nth
  FROM versions WINDOW w AS (PARTITION BY account_id, asset_id ORDER BY batch)),
actions AS (
  SELECT v.batch, v.n,
         CASE WHEN nth = 1 AND t.account_id IS NULL THEN 'inserted'
              WHEN nth = 1 AND (v.quantity IS DISTINCT FROM t.quantity OR v.amount IS DISTINCT FROM t.amount)
                THEN 'updated'
              WHEN nth > 1 AND (v.quantity IS DISTINCT FROM q0 OR v.amount IS DISTINCT FROM a0) THEN 'updated'
              ELSE 'unchanged' END AS action
  FROM lagged v LEFT JOIN tgt t ON v.account_id = t.account_id AND v.asset_id = t.asset_id),
per_batch AS (
  SELECT batch, count(*) FILTER (action = 'inserted') AS inserted,
         count(*) FILTER (action = 'updated') AS updated, CAST(sum(n) AS BIGINT) AS rows
  FROM actions GROUP BY batch),
metrics AS (
  SELECT batch, inserted, updated, rows,
         CAST(sum(inserted) OVER w AS BIGINT) AS total_inserted,
         CAST(sum(updated) OVER w AS BIGINT) AS total_updated,
         CAST(sum(inserted + updated) OVER w AS BIGINT) AS total_processed,
         CAST(sum(rows) OVER w AS BIGINT) AS total_rows
  FROM per_batch WINDOW w AS (ORDER BY batch)),
timed AS (
  SELECT batch, inserted, updated, total_processed, CAST(batch AS DOUBLE) / 2 AS timestamp,
         CAST(CASE WHEN batch % 5 = 0 THEN 0 ELSE 100 + batch % 7 END AS DOUBLE) AS batch_time_ms
  FROM metrics),
series AS (
  SELECT batch, inserted, updated, batch_time_ms,
         CASE WHEN batch_time_ms > 0
              THEN CAST(inserted + updated AS DOUBLE) / (batch_time_ms / CAST(1000 AS DOUBLE))
              ELSE CAST(0 AS DOUBLE) END AS throughput
  FROM timed)"""

ACTIONS = f"""{sides()},
actions AS (
  SELECT s.*, CASE WHEN t.account_id IS NULL THEN 'inserted' WHEN {CHANGED} THEN 'updated'
                   ELSE 'unchanged' END AS action,
         s.versions - 1 AS superseded
  FROM col s LEFT JOIN tgt t ON {SAME_KEY})"""

WITH_FILES = "'s3://landing/' || asset_id || '.parquet'"


def percent(part: str, whole: str) -> str:
    return f"""CASE WHEN ({whole}) > 0 THEN CAST(100 AS DOUBLE) * ({part}) / ({whole})
               ELSE CAST(0 AS DOUBLE) END"""


def merged(key: list[str]) -> str:
    on = " AND ".join(f"s.{k} = t.{k}" for k in key)
    keys = ", ".join(
        f"CAST(coalesce(t.{k}, s.{k}) AS VARCHAR) AS {k}" for k in key
    )
    changed = f"(s.account_id IS NOT NULL AND (t.account_id IS NULL OR {CHANGED}))"
    return f"""
    SELECT {keys},
           CAST(CASE WHEN {changed} THEN s.quantity ELSE t.quantity END AS DOUBLE) AS quantity,
           CAST(CASE WHEN {changed} THEN s.amount ELSE t.amount END AS DOUBLE) AS amount,
           CAST(CASE WHEN {changed} THEN TIMESTAMP '{RUN_TS}' ELSE t.updated_at END AS VARCHAR) AS updated_at,
           CAST(CASE WHEN t.account_id IS NULL THEN s.created_at ELSE t.created_at END AS VARCHAR) AS created_at
    FROM tgt t FULL JOIN col s ON {on}"""


def sampled(source: str, count: str, seed: int, kind: str) -> str:
    return f"""
    SELECT account_id, asset_id, reference_date, '{kind}' AS kind
    FROM (SELECT *, row_number() OVER (ORDER BY {hash60(KEY_TEXT, seed)}, account_id, asset_id, reference_date) AS nth
          FROM {source}) WHERE nth <= {count}"""


FRESH = """
fresh AS (
  SELECT DISTINCT s.account_id, s.asset_id, s.reference_date FROM staged s
  WHERE NOT EXISTS (SELECT 1 FROM tgt t
                    WHERE s.account_id = t.account_id AND s.asset_id = t.asset_id
                      AND s.reference_date = t.reference_date))"""

LAST_OF_ALL = f"""
WITH {EVENTS}
SELECT account_id, asset_id, CAST(reference_date AS VARCHAR) AS reference_date,
       CAST(arg_max(quantity, seq) AS DOUBLE) AS quantity, CAST(arg_max(amount, seq) AS DOUBLE) AS amount
FROM ev GROUP BY account_id, asset_id, reference_date"""

# White space as a class of its own, so that nothing is shared with `btrim`.
BLANK = (
    "regexp_full_match({c}, '[\\x09-\\x0D\\x1C-\\x20\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}"
    "\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]*')"
)

PAGES = """
shaped AS (
  SELECT page_id, page_id % 8 AS kind, regexp_extract(url, '^https?://([^/]+)/', 1) AS bucket,
         'input/' || page_id || CASE WHEN page_id % 8 = 5 THEN '.csv' ELSE '.parquet' END AS key
  FROM pages),
named AS (
  SELECT *, '{"s3":{"bucket":{' || CASE WHEN kind = 3 THEN '' ELSE '"name":"' || bucket || '"' END
            || '},"object":{' || CASE WHEN kind = 4 THEN '' ELSE '"key":"' || key || '"' END || '}}}' AS record
  FROM shaped),
listed AS (
  SELECT *, '{"Records":[' || record
            || CASE WHEN kind = 6 THEN ',{"s3":{"bucket":{"name":"' || bucket || '"},"object":{"key":"again/'
                                       || key || '"}}}' ELSE '' END || ']}' AS event
  FROM named),
bodies AS (
  SELECT page_id,
         CASE kind WHEN 1 THEN CAST(json_object('Type', 'Notification', 'Message', event) AS VARCHAR)
                   WHEN 2 THEN CAST(json_object('Type', 'Notification', 'Message', '{' || bucket) AS VARCHAR)
                   WHEN 7 THEN '{' || event ELSE event END AS body
  FROM listed),
usable AS (SELECT page_id, CAST(body AS JSON) AS body FROM bodies WHERE json_valid(body)),
opened AS (
  SELECT page_id,
         CASE WHEN body->>'$.Type' = 'Notification' AND json_type(body, '$.Message') = 'VARCHAR'
                   AND json_valid(body->>'$.Message')
              THEN CAST(body->>'$.Message' AS JSON) ELSE body END AS body
  FROM usable),
records AS (SELECT page_id, unnest(json_extract(body, '$.Records[*]')) AS record FROM opened),
entries AS (
  SELECT page_id, record->>'$.s3.bucket.name' AS bucket, record->>'$.s3.object.key' AS key FROM records)"""

DAY_FILES = "account_id || '/' || CAST(reference_date AS VARCHAR)"


def states(source: str) -> str:
    return f"""
    counted AS (
      SELECT {DAY_FILES} AS source_file,
             count(*) FILTER (asset_id IN ('error', 'view')) AS failures,
             count(*) FILTER (asset_id NOT IN ('error', 'view')) AS successes
      FROM {source} GROUP BY 1),
    states AS (
      SELECT source_file, failures,
             CASE WHEN successes > 0 THEN 'done' WHEN failures >= 3 THEN 'dead' ELSE 'retry' END AS status
      FROM counted)"""


ORACLES: dict[str, str] = {
    "scan_custody": f"""
        WITH {LINES} SELECT account_id, asset_id, CAST(reference_date AS VARCHAR) AS reference_date,
                            quantity, amount FROM li""",
    "row_lineage": """
        SELECT 'lineitem.parquet' AS source_file, count(*) AS n_rows, CAST(0 AS BIGINT) AS first_row,
               count(*) - 1 AS last_row, CAST(count(*) * (count(*) - 1) // 2 AS BIGINT) AS sum_rows
        FROM lineitem""",
    "typed_projection": f"""
        WITH {LINES} SELECT account_id, asset_id, CAST(CAST(reference_date AS DATE) AS VARCHAR) AS reference_date,
                            CAST(CAST(quantity AS DECIMAL(18,4)) AS DOUBLE) AS quantity,
                            CAST(CAST(amount AS DECIMAL(18,2)) AS DOUBLE) AS amount FROM li""",
    "record_hash": f"""
        WITH {LINES} SELECT account_id, asset_id,
          sha256(account_id || '|' || asset_id || '|' || strftime(reference_date, '%Y-%m-%d %H:%M:%S') || '|'
                 || CAST(CAST(quantity AS DECIMAL(18,4)) AS VARCHAR) || '|'
                 || CAST(CAST(amount AS DECIMAL(18,2)) AS VARCHAR)) AS record_hash FROM li""",
    "record_hash_source_text": f"""
        WITH {LINES} SELECT account_id, asset_id,
          sha256(account_id || '|' || asset_id || '|' || strftime(reference_date, '%Y-%m-%d %H:%M:%S') || '|'
                 || CAST(quantity AS VARCHAR) || '|' || CAST(amount AS VARCHAR)) AS record_hash FROM li""",
    "blank_predicate": f"""
        SELECT doc_id, {BLANK.format(c='text')} AS is_blank,
               CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_lines,
               CAST(len(list_filter(string_split(text, chr(10)), lambda line: {BLANK.format(c='line')})) AS BIGINT)
                 AS n_blank_lines
        FROM documents""",
    "validation_errors": f"WITH {CUSTOMERS} SELECT row_number, broken FROM checked",
    "valid_rows": f"""
        WITH {CUSTOMERS}
        SELECT source_file, row_number, account_id, asset_id,
               CAST(CAST(reference_date AS DATE) AS VARCHAR) AS reference_date,
               CAST(CAST(quantity AS DECIMAL(18,4)) AS DOUBLE) AS quantity,
               CAST(CAST(amount AS DECIMAL(18,2)) AS DOUBLE) AS amount,
               sha256(account_id || '|' || asset_id || '|' || strftime(reference_date, '%Y-%m-%d %H:%M:%S') || '|'
                      || CAST(CAST(quantity AS DECIMAL(18,4)) AS VARCHAR) || '|'
                      || CAST(CAST(amount AS DECIMAL(18,2)) AS VARCHAR)) AS record_hash
        FROM checked WHERE is_valid""",
    "error_rows": f"""
        WITH {CUSTOMERS}
        SELECT source_file, row_number, error_reason,
               CAST(json_object('account_id', account_id, 'asset_id', asset_id,
                    'reference_date', strftime(reference_date, '%Y-%m-%d %H:%M:%S'),
                    'quantity', CASE WHEN isnan(quantity) THEN NULL ELSE quantity END,
                    'amount', CASE WHEN isnan(amount) THEN NULL ELSE amount END) AS VARCHAR) AS payload
        FROM checked WHERE NOT is_valid""",
    "ingest_summary": f"""
        WITH {CUSTOMERS}
        SELECT source_file, count(*) AS rows, count(*) FILTER (is_valid) AS valid,
               count(*) FILTER (NOT is_valid) AS invalid
        FROM checked GROUP BY source_file""",
    "consumer_totals": f"""
        WITH {CUSTOMERS}
        SELECT count(DISTINCT source_file) AS files, count(*) AS rows, count(*) FILTER (is_valid) AS valid,
               count(*) FILTER (NOT is_valid) AS invalid FROM checked""",
    "error_ratio": f"""
        WITH {CUSTOMERS}, n AS (SELECT count(*) FILTER (is_valid) AS v, count(*) FILTER (NOT is_valid) AS i FROM checked)
        SELECT v AS valid, i AS invalid, {percent('i', 'v + i')} AS error_percent FROM n""",
    "valid_share": f"""
        WITH {CUSTOMERS}, n AS (SELECT count(*) FILTER (is_valid) AS v, count(*) FILTER (NOT is_valid) AS i FROM checked)
        SELECT v AS valid, i AS invalid, round({percent('v', 'v + i')}, 2) AS valid_percent FROM n""",
    "notification_files": f"""
        WITH {PAGES}
        SELECT page_id, bucket, key, 's3://' || bucket || '/' || key AS source_file FROM entries
        WHERE bucket <> '' AND key <> '' AND key LIKE '%.parquet'""",
    "staging_append": f"""
        WITH {EVENTS}
        SELECT 'run-1' AS batch_id, {WITH_FILES} AS source_file, seq AS row_number, {key_out('s')}, {num_out('s')}
        FROM staged s WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.seq = s.seq AND o.asset_id = s.asset_id)""",
    "checkpoint": f"""
        WITH {EVENTS}
        SELECT 's3://landing/account_' || e.account_id || '.parquet' AS source_file,
               coalesce(max(o.seq), -1) AS last_row
        FROM (SELECT DISTINCT account_id FROM ev) e LEFT JOIN old o ON e.account_id = o.account_id GROUP BY 1""",
    "duplicate_content": f"""
        WITH {EVENTS}, nth AS (
          SELECT {WITH_FILES} AS source_file, seq,
                 row_number() OVER (PARTITION BY CAST(account_id AS BIGINT) % 20, asset_id, quantity ORDER BY seq) AS n
          FROM ev)
        SELECT source_file, seq AS row_number, 'duplicate record in file' AS error_reason FROM nth WHERE n > 1""",
    "staging_remaining": f"""
        WITH {EVENTS}
        SELECT seq // 1000 AS ingest_batch, count(*) AS n_rows FROM ev
        WHERE seq // 1000 NOT IN (SELECT DISTINCT seq // 1000 FROM old) GROUP BY 1""",
    "file_status": f"WITH {EVENTS}, {states('ev')} SELECT source_file, failures, status FROM states",
    "files_to_try": f"""
        WITH {EVENTS}, {states('old')}
        SELECT DISTINCT {DAY_FILES} AS source_file FROM ev
        WHERE {DAY_FILES} NOT IN (SELECT source_file FROM states WHERE status IN ('done', 'dead'))""",
    "last_per_key": LAST_OF_ALL,
    "first_per_key": f"""
        WITH {EVENTS}
        SELECT account_id, asset_id, CAST(reference_date AS VARCHAR) AS reference_date,
               CAST(arg_min(created_at, seq) AS VARCHAR) AS created_at
        FROM ev GROUP BY account_id, asset_id, reference_date""",
    "distinct_keys": f"WITH {EVENTS} SELECT DISTINCT {key_out('ev')} FROM ev",
    "used_keys": f"WITH {EVENTS} SELECT {key_out('old')} FROM old UNION SELECT {key_out('staged')} FROM staged",
    "fresh_keys": f"WITH {sides()}, {FRESH} SELECT {key_out('fresh')} FROM fresh",
    "key_space": f"WITH {SPACE} SELECT position, {key_out('space')} FROM space",
    "file_allocation": f"""
        WITH {SPACE}
        SELECT position // 5000 AS file_number, count(*) AS n_keys, min(position) AS first_position,
               max(position) AS last_position FROM space GROUP BY 1""",
    "random_rows": f"""
        WITH spots AS (SELECT event_id AS seq, {hash60('event_id', 0)} % 6200000 AS position FROM events),
        keyed AS (SELECT seq, {digits('position')} FROM spots)
        SELECT seq, {key_out('keyed')}, {uniform(10, 10_000, 10_000, 'seq', 1)} AS quantity,
               {uniform(100, 1_000_000, 100, 'seq', 2)} AS amount FROM keyed""",
    "unique_rows": f"""
        WITH spots AS (SELECT DISTINCT {hash60('event_id', 0)} % 12400 AS position FROM events),
        keyed AS (SELECT {digits('position')} FROM spots),
        kept AS ({sampled('keyed', '(SELECT count(*) // 3 FROM events)', 0, 'any')})
        SELECT {key_out('kept')}, {uniform(10, 10_000, 10_000, KEY_TEXT, 1)} AS quantity,
               {uniform(100, 1_000_000, 100, KEY_TEXT, 2)} AS amount FROM kept""",
    "change_set": f"""
        WITH {sides()}, {FRESH},
        kept AS ({sampled('tgt', '(SELECT count(*) // 4 * 60 // 100 FROM staged)', 0, 'update')} UNION ALL {sampled('fresh', '(SELECT count(*) // 4 - count(*) // 4 * 60 // 100 FROM staged)', 0, 'insert')})
        SELECT {key_out('kept')}, kind, {uniform(10, 10_000, 10_000, KEY_TEXT, 1)} AS quantity,
               {uniform(100, 1_000_000, 100, KEY_TEXT, 2)} AS amount FROM kept""",
    "sample_keys": f"WITH {sides()}, kept AS ({sampled('tgt', '(SELECT count(*) // 5 FROM tgt)', 7, 'any')}) SELECT {key_out('kept')} FROM kept",
    "next_batch": f"""
        WITH {EVENTS} SELECT seq, {key_out('ev')}, {num_out('ev')} FROM ev ORDER BY seq LIMIT 2000""",
    "inserted_rows": f"""
        WITH {sides()}
        SELECT {key_out('s')}, {num_out('s')}, CAST(s.created_at AS VARCHAR) AS created_at
        FROM col s LEFT JOIN tgt t ON {SAME_KEY} WHERE t.account_id IS NULL""",
    "inserted_rows_exists": f"""
        WITH {sides()}
        SELECT {key_out('s')}, {num_out('s')}, CAST(s.created_at AS VARCHAR) AS created_at
        FROM col s WHERE NOT EXISTS (SELECT 1 FROM tgt t WHERE {SAME_KEY})""",
    "changed_rows": f"""
        WITH {sides()}
        SELECT {key_out('t')}, {num_out('t')}, CAST(s.quantity AS DOUBLE) AS new_quantity,
               CAST(s.amount AS DOUBLE) AS new_amount, {CHANGED} AS changed
        FROM col s JOIN tgt t ON {SAME_KEY}""",
    "updated_rows": f"""
        WITH {sides()}
        SELECT {key_out('t')}, {num_out('s')}, '{RUN_TS}' AS updated_at,
               CAST(t.created_at AS VARCHAR) AS created_at
        FROM col s JOIN tgt t ON {SAME_KEY} WHERE {CHANGED}""",
    "merge_final": f"WITH {sides()} {merged(['account_id', 'asset_id', 'reference_date'])}",
    "merge_updates": f"WITH {sides('account_id, asset_id')} {merged(['account_id', 'asset_id'])}",
    "merge_actions": f"WITH {ACTIONS} SELECT {key_out('actions')}, action, superseded FROM actions",
    "merge_summary": f"""
        WITH {ACTIONS}
        SELECT count(*) FILTER (action = 'inserted') AS inserted, count(*) FILTER (action = 'updated') AS updated,
               count(*) FILTER (action = 'unchanged') AS unchanged,
               CAST(coalesce(sum(superseded), 0) AS BIGINT) AS superseded,
               CAST(coalesce(sum(versions), 0) AS BIGINT) AS staged
        FROM actions""",
    "status_counts": f"WITH {ACTIONS} SELECT action, count(*) AS n_keys FROM actions GROUP BY action",
    "batch_members": f"""
        WITH {EVENTS}, numbered AS (SELECT seq, row_number() OVER (ORDER BY seq) AS position FROM ev)
        SELECT seq, position, (position - 1) // 2000 + 1 AS batch FROM numbered""",
    "batch_metrics": f"""
        WITH {HISTORY}
        SELECT batch, inserted, updated, rows, total_inserted, total_updated, total_processed, total_rows
        FROM metrics""",
    "batch_progress": f"""
        WITH {HISTORY}, n AS (SELECT count(*) AS pending FROM staged)
        SELECT batch, total_rows, {percent('total_rows', 'pending')} AS percent_done,
               (pending + 1999) // 2000 AS batches FROM metrics, n""",
    "report_metrics": f"""
        WITH {HISTORY},
        t AS (SELECT CAST(sum(inserted) AS BIGINT) AS i, CAST(sum(updated) AS BIGINT) AS u,
                     max(timestamp) AS s, count(*) AS n FROM timed)
        SELECT 'total_records' AS metric, CAST(i + u AS DOUBLE) AS value, format('{{:,}}', i + u) AS text FROM t
        UNION ALL SELECT 'total_time', s, printf('%.1f', s) || 's' FROM t
        UNION ALL SELECT 'throughput', CAST(i + u AS DOUBLE) / s, printf('%.1f', CAST(i + u AS DOUBLE) / s) || ' regs/s' FROM t
        UNION ALL SELECT 'total_inserted', CAST(i AS DOUBLE), format('{{:,}}', i) FROM t
        UNION ALL SELECT 'total_updated', CAST(u AS DOUBLE), format('{{:,}}', u) FROM t
        UNION ALL SELECT 'total_batches', CAST(n AS DOUBLE), format('{{:,}}', n) FROM t""",
    "batch_series": f"WITH {HISTORY} SELECT batch, inserted, updated, batch_time_ms, throughput FROM series",
    "series_means": f"""
        WITH {HISTORY}
        SELECT round(avg(throughput), 6) AS mean_throughput, round(avg(batch_time_ms), 6) AS mean_batch_time_ms
        FROM series""",
    "elapsed": """
        SELECT event_id,
               CAST(epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY CAST(ts AS DATE))) AS DOUBLE)
                 / CAST(1000000 AS DOUBLE) AS elapsed
        FROM events""",
    "downsample": """
        WITH RECURSIVE kept AS (
          SELECT min(ts) AS ts FROM events
          UNION ALL
          SELECT (SELECT min(ts) FROM events WHERE ts >= kept.ts + INTERVAL 1 HOUR) FROM kept WHERE ts IS NOT NULL)
        SELECT CAST(ts AS VARCHAR) AS ts, min(event_id) AS event_id, arg_min(value, event_id) AS value
        FROM kept JOIN events USING (ts) GROUP BY ts""",
    "await_conditions": """
        WITH snap AS (
          SELECT CAST(ts AS DATE) AS run_id, 5 * (extract(hour FROM ts) * 4 + extract(minute FROM ts) // 15) AS elapsed,
                 count(*) // 10 AS staging
          FROM events GROUP BY 1, 2),
        marked AS (
          SELECT *, CASE WHEN staging = lag(staging) OVER w AND staging <> 0 THEN 0 ELSE 1 END AS restart
          FROM snap WINDOW w AS (PARTITION BY run_id ORDER BY elapsed)),
        streaks AS (SELECT *, sum(restart) OVER (PARTITION BY run_id ORDER BY elapsed) AS streak FROM marked),
        ending AS (
          SELECT *, elapsed < 400 AND staging = 0 AND elapsed > 30 AS merged,
                 elapsed < 400 AND row_number() OVER (PARTITION BY run_id, streak ORDER BY elapsed) > 4 AS stuck
          FROM streaks),
        found AS (
          SELECT run_id, min(elapsed) FILTER (elapsed < 120 AND staging > 0) AS arrived,
                 min(elapsed) FILTER (merged) AS m, min(elapsed) FILTER (stuck) AS s
          FROM ending GROUP BY run_id)
        SELECT CAST(run_id AS VARCHAR) AS run_id, CAST(arrived AS BIGINT) AS arrived, CAST(least(m, s) AS BIGINT) AS ended,
               CASE WHEN m IS NULL AND s IS NULL THEN 'timeout' WHEN m <= coalesce(s, m) THEN 'merged' ELSE 'stuck' END
                 AS outcome
        FROM found""",
    "last_metrics": f"""
        WITH {HISTORY}
        SELECT batch, total_processed, batch_time_ms, inserted, updated FROM timed ORDER BY batch DESC LIMIT 1""",
    "stagnation": """
        WITH snap AS (
          SELECT CAST(ts AS DATE) AS run_id, extract(hour FROM ts) AS elapsed, count(*) // 10 AS staging
          FROM events GROUP BY 1, 2),
        marked AS (
          SELECT *, CASE WHEN staging = lag(staging) OVER w AND staging <> 0 THEN 0 ELSE 1 END AS restart
          FROM snap WINDOW w AS (PARTITION BY run_id ORDER BY elapsed)),
        streaks AS (SELECT *, sum(restart) OVER (PARTITION BY run_id ORDER BY elapsed) AS streak FROM marked),
        counted AS (
          SELECT *, row_number() OVER (PARTITION BY run_id, streak ORDER BY elapsed) - 1 AS stagnant FROM streaks)
        SELECT CAST(run_id AS VARCHAR) AS run_id, CAST(elapsed AS BIGINT) AS elapsed, staging, stagnant,
               stagnant >= 3 AS is_stuck FROM counted""",
    "pipeline_counts": f"""
        WITH {sides()}, {CUSTOMERS}
        SELECT 'principal' AS table_name, count(*) AS n_rows FROM tgt
        UNION ALL SELECT 'staging', count(*) FROM staged
        UNION ALL SELECT 'error', count(*) FROM checked WHERE NOT is_valid""",
    "reconciliation": f"""
        WITH {sides()}, {CUSTOMERS},
        n AS (SELECT (SELECT count(*) FROM staged) AS expected, (SELECT count(*) FROM tgt) AS existing,
                     (SELECT count(*) FROM tgt t FULL JOIN col s ON {SAME_KEY}) AS principal,
                     (SELECT count(*) FROM checked WHERE NOT is_valid) AS errors)
        SELECT expected, existing, principal, errors, principal - existing AS inserted_new FROM n""",
    "control_csv": f"""
        WITH {EVENTS} SELECT {key_out('ev')}, {num_out('ev')}, {WITH_FILES} AS source_file FROM ev""",
    "parquet_files": f"""
        WITH {LINES} SELECT count(*) AS n_rows, true AS within_limit,
                            CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS total_amount FROM li""",
    "ingest_pipeline": f"""
        WITH {CUSTOMERS},
        landed AS (SELECT *, row_number % 7 = 0 AS twice FROM checked),
        named AS (
          SELECT 'staged' AS kind, concat_ws('|', account_id, asset_id, CAST(CAST(reference_date AS DATE) AS VARCHAR),
                 CAST(CAST(quantity AS DECIMAL(18,4)) AS VARCHAR), CAST(CAST(amount AS DECIMAL(18,2)) AS VARCHAR)) AS name,
                 1 AS n FROM landed WHERE is_valid
          UNION ALL SELECT 'rejected', error_reason, CASE WHEN twice THEN 2 ELSE 1 END FROM landed WHERE NOT is_valid
          UNION ALL SELECT 'rejected', 'duplicate record in file', 1 FROM landed WHERE is_valid AND twice
          UNION ALL SELECT 'counter', 'rows', CASE WHEN twice THEN 2 ELSE 1 END FROM landed
          UNION ALL SELECT 'counter', 'valid', CASE WHEN is_valid THEN 1 ELSE 0 END FROM landed
          UNION ALL SELECT 'counter', 'invalid', CASE WHEN is_valid THEN 0 WHEN twice THEN 2 ELSE 1 END FROM landed
          UNION ALL SELECT 'counter', 'duplicate', CASE WHEN is_valid AND twice THEN 1 ELSE 0 END FROM landed)
        SELECT kind, name, CAST(sum(n) AS BIGINT) AS n FROM named GROUP BY kind, name""",
    "merge_store": LAST_OF_ALL,
    "merge_batches": f"""
        WITH {sides()},
        pos AS (SELECT s.*, (row_number() OVER (ORDER BY seq) - 1) // (SELECT count(*) // 3 + 1 FROM staged) + 1 AS batch
                FROM staged s),
        states AS (
          SELECT 0 AS batch, account_id, asset_id, reference_date, quantity, amount, 1 AS versions FROM tgt
          UNION ALL
          SELECT batch, account_id, asset_id, reference_date, arg_max(quantity, seq), arg_max(amount, seq), count(*)
          FROM pos GROUP BY ALL),
        steps AS (
          SELECT *, lag(batch) OVER k IS NULL AS fresh,
                 lag(quantity) OVER k IS DISTINCT FROM quantity OR lag(amount) OVER k IS DISTINCT FROM amount AS moved
          FROM states WINDOW k AS (PARTITION BY account_id, asset_id, reference_date ORDER BY batch)),
        counted AS (
          SELECT batch, count(*) FILTER (fresh) AS inserted, count(*) FILTER (NOT fresh AND moved) AS updated,
                 count(*) FILTER (NOT fresh AND NOT moved) AS unchanged,
                 CAST(sum(versions - 1) AS BIGINT) AS superseded
          FROM steps WHERE batch > 0 GROUP BY batch)
        SELECT *, CAST(sum(inserted + updated) OVER (ORDER BY batch) AS BIGINT) AS total_processed FROM counted""",
    "load_store": f"""
        WITH {LINES}
        SELECT account_id, asset_id, CAST(CAST(date_trunc('month', reference_date) AS DATE) AS VARCHAR) AS reference_date,
               CAST(sum(CAST(quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity,
               CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS amount
        FROM li GROUP BY account_id, asset_id, date_trunc('month', reference_date)""",
    "stream_ingest": f"""
        WITH {EVENTS} SELECT {key_out('ev')}, {num_out('ev')} FROM ev""",
    "stream_merge": LAST_OF_ALL,
}
ORACLES["metrics_csv"] = ORACLES["report_metrics"]
