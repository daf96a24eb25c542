"""Message records, versions, predictions and attempt rounds, derived from the given tables.

Each is one SQL text that runs unchanged in Spark and in DuckDB, so a query and its oracle
start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

T = """SELECT CAST(p_partkey AS STRING) AS id, concat('tpl_', CAST(p_partkey AS STRING)) AS name, CAST(p_partkey AS BIGINT) AS ingest_seq,
  CASE WHEN p_partkey % 4 = 0 THEN p_brand ELSE '' END AS header,
  concat(CASE p_partkey % 6
    WHEN 0 THEN concat('Your invoice {{invoice_id}} for ', p_name, ' is due on {{due_date}}.')
    WHEN 1 THEN concat('Your order {{order_id}} of ', p_name, ' has shipped.')
    WHEN 2 THEN concat('Your appointment {{1}} about ', p_name, ' was scheduled.')
    WHEN 3 THEN concat('Support case ', CAST(10000 + p_partkey AS STRING), ' on ', p_name, ' was resolved.')
    WHEN 4 THEN concat('Get the new ', p_name, ' today.')
    ELSE concat('Explore our ', p_type, ' ', p_name, ' range.') END,
    CASE (p_partkey * 7) % 5 WHEN 0 THEN ' 20% off your next order!' WHEN 1 THEN ' Shop now.' WHEN 2 THEN ' Upgrade {{plan_name}} today.' ELSE '' END) AS body,
  CASE WHEN p_partkey % 7 = 0 THEN 'Reply STOP to opt out' ELSE '' END AS footer,
  CASE p_partkey % 3 WHEN 0 THEN concat('View details', chr(10), 'Shop now') WHEN 1 THEN 'Track order' ELSE '' END AS buttons,
  CASE WHEN p_partkey % 53 = 0 THEN 'AUTHENTICATION' WHEN p_partkey % 41 = 0 THEN 'UNKNOWN' WHEN p_partkey % 37 = 0 THEN 'UTILITY'
    WHEN p_partkey % 6 < 4 AND (p_partkey * 7) % 5 > 2 THEN 'UTILITY' ELSE 'MARKETING' END AS meta_category,
  CASE WHEN p_partkey % 3 < 2 THEN 'UTILITY' ELSE 'MARKETING' END AS requested_category,
  CASE p_partkey % 10 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'REJECTED' WHEN 2 THEN 'APPROVED' WHEN 3 THEN 'ACTIVE' ELSE 'VERIFIED' END AS status,
  CASE WHEN p_partkey % 11 = 0 THEN 'MEDIA' ELSE 'TEXT' END AS format,
  CASE WHEN p_partkey % 19 = 0 THEN '' ELSE 'ENGLISH_US' END AS language,
  concat('2024-', lpad(CAST(1 + p_partkey % 12 AS STRING), 2, '0'), '-', lpad(CAST(1 + p_partkey % 28 AS STRING), 2, '0'), 'T00:00:00Z') AS created_at,
  CASE WHEN p_partkey % 5 = 0 THEN concat('2025-01-', lpad(CAST(1 + p_partkey % 28 AS STRING), 2, '0'), 'T00:00:00Z') ELSE '' END AS updated_at,
  CASE WHEN p_partkey % 4 = 3 THEN NULL ELSE CAST((p_partkey * 131) % 5000 AS DOUBLE) END AS monthly_volume
FROM part"""

TV = f"""SELECT t.id, t.name, t.ingest_seq * 3 + v.v AS ingest_seq, t.header, t.body, t.footer, t.buttons,
  CASE WHEN v.v = 1 AND t.ingest_seq % 13 = 0 THEN 'MARKETING' ELSE t.meta_category END AS meta_category,
  t.requested_category, t.status, t.format, t.language,
  CASE WHEN v.v = 2 AND t.ingest_seq % 17 = 0 THEN 'invalid'
    WHEN v.v > 0 AND t.ingest_seq % 8 = 0 THEN concat('2024-', lpad(CAST(1 + (t.ingest_seq + 3 * v.v) % 12 AS STRING), 2, '0'), '-15T00:00:00Z')
    ELSE concat(substr(t.created_at, 1, 11), lpad(CAST(6 * v.v AS STRING), 2, '0'), ':00:00Z') END AS created_at,
  '' AS updated_at, t.monthly_volume
FROM ({T}) t CROSS JOIN (SELECT 0 AS v UNION ALL SELECT 1 UNION ALL SELECT 2) v"""

P = """SELECT CAST(doc_id AS STRING) AS id, CASE WHEN quality = 1 THEN 'UTILITY' ELSE 'MARKETING' END AS recorded_category,
  CASE WHEN doc_id % 3 < 2 THEN 'UTILITY' ELSE 'MARKETING' END AS requested_category,
  CAST((doc_id * 7919 + quality * 350 + 104729) % 1000 AS DOUBLE) / 1000 AS text_p,
  CAST((doc_id * 6007 + quality * 500 + 31) % 1000 AS DOUBLE) / 1000 AS neural_p,
  CASE WHEN (doc_id * 7919 + quality * 350 + 104729) % 1000 >= 500 THEN 'UTILITY' ELSE 'MARKETING' END AS prediction,
  CASE WHEN doc_id % 23 = 0 THEN NULL WHEN doc_id % 10 = 0 THEN 'NEEDS_REVIEW' WHEN doc_id % 29 = 0 THEN 'AUTHENTICATION'
    WHEN (doc_id * 6007 + quality * 500 + 31) % 1000 >= 500 THEN 'UTILITY' ELSE 'MARKETING' END AS judge
FROM labels"""

RD = f"""SELECT t.id, t.ingest_seq, r.r AS round, t.body AS original, t.body, t.header, t.footer, t.buttons, t.meta_category, t.requested_category,
  CASE (t.ingest_seq + r.r) % 4 WHEN 0 THEN replace(t.body, '{{{{order_id}}}}', '') WHEN 1 THEN concat(t.body, ' Shop now.') ELSE concat('Update: ', t.body) END AS candidate,
  (t.ingest_seq + r.r) % 9 <> 0 AS possible, CAST((t.ingest_seq * 37 + r.r * 211) % 1000 AS DOUBLE) / 1000 AS score,
  CASE (t.ingest_seq + r.r) % 5 WHEN 0 THEN 'The message looks promotional to me.'
    WHEN 1 THEN '{{"category": "UTILITY", "confidence": 1.7, "clauses": [], "rationale": "r"}}'
    WHEN 2 THEN 'Here it is: {{"category": "MARKETING", "confidence": 0.8, "clauses": ["a"], "rationale": "r"}} Done.'
    WHEN 3 THEN '{{"category": "SPAM", "confidence": 0.5, "clauses": [], "rationale": "r"}}'
    ELSE '{{"category": "UTILITY", "confidence": 0.6, "clauses": ["a", "b"], "rationale": "r"}}' END AS raw
FROM ({T}) t CROSS JOIN (SELECT 1 AS r UNION ALL SELECT 2 UNION ALL SELECT 3) r"""


#: Rows of a given table that a task turns into records: a table of few bytes is one split, however many rows it has.
TASK_ROWS = 10_000


def spread(df: DataFrame, key: str) -> DataFrame:
    """df in as many tasks as its rows need, before anything is worked out for them."""
    n = -(-df.count() // TASK_ROWS)  # from the files' footers
    return df.repartition(n, key) if n > 1 else df


def fixture(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """sql over the tables of sf_dir, which stay views for this session only."""
    for name, key in (("part", "p_partkey"), ("labels", "doc_id")):
        if name in sql:
            spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"), key).createOrReplaceTempView(name)
    return spark.sql(sql)
