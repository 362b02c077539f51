"""The engine's tables, made of the tables at hand. Each is one SQL text that Spark and DuckDB both run:
``{orders}`` and the like stand for the source tables."""

import re

from pyspark.sql import DataFrame, SparkSession

SQL = {
    "jobs": """
SELECT CASE WHEN o_orderkey % 10 = 9 THEN concat('job-', cast(o_orderkey - 1 AS STRING), '_final')
            ELSE concat('job-', cast(o_orderkey AS STRING)) END AS job_id,
       o_orderkey AS k, r_name AS region, concat('/src/', n_name, '/', c_mktsegment) AS source_path,
       concat('dst/', cast(o_custkey % 50 AS STRING), '/', cast(o_custkey AS STRING)) AS dest_path,
       CASE o_orderkey % 6 WHEN 0 THEN 'pending' WHEN 1 THEN 'syncing' WHEN 2 THEN 'paused'
            WHEN 3 THEN 'cancelled' WHEN 4 THEN 'completed' ELSE 'failed' END AS status,
       CASE WHEN o_orderkey % 10 = 8 THEN 'sync' WHEN o_orderkey % 10 = 9 THEN 'once'
            WHEN o_orderkey % 3 = 0 THEN 'full' ELSE 'once' END AS job_type,
       cast(substring(o_orderpriority, 1, 1) AS INT) AS priority,
       cast(floor(o_totalprice) AS BIGINT) AS total_size,
       cast(floor(cast(floor(o_totalprice) AS DOUBLE) * (o_orderkey % 101) / 100e0) AS BIGINT) AS current_size,
       cast(o_orderkey % 4 AS BIGINT) AS round_id, o_orderkey % 8 = 0 AS is_last_round,
       CASE WHEN o_orderkey % 6 = 5 THEN concat('error ', cast(o_orderkey AS STRING)) END AS error_message,
       o_orderdate AS created_at, o_orderdate AS updated_at
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey""",
    "runtime": """
SELECT CASE WHEN k % 97 = 0 THEN concat('rt-', cast(k AS STRING)) ELSE job_id END AS job_id,
       CASE k % 6 WHEN 0 THEN 'syncing' WHEN 1 THEN 'paused' WHEN 2 THEN 'pending' WHEN 3 THEN 'failed' ELSE 'syncing' END AS status,
       total_size, total_size AS current_size, region, cast(NULL AS STRING) AS error_message,
       round_id + 1 AS round_id, k % 16 = 0 AS is_last_round, created_at, updated_at
FROM ({jobs}) j WHERE k % 7 = 0 OR k % 97 = 0""",
    "job_retries": """
SELECT job_id, cast(k % 5 AS INT) AS retry_count, 3 AS max_retries, created_at AS last_retry_at,
       created_at + CASE k % 5 WHEN 0 THEN INTERVAL '1' MINUTE WHEN 1 THEN INTERVAL '3' MINUTE WHEN 2 THEN INTERVAL '6' MINUTE ELSE INTERVAL '10' MINUTE END AS next_retry_at,
       error_message AS last_error
FROM ({jobs}) j WHERE status = 'failed'""",
    "transfer_states": """
SELECT concat('job-', cast(l_orderkey AS STRING)) AS job_id, concat('/src/p', cast(max(l_partkey) AS STRING), '/l', cast(l_linenumber AS STRING)) AS file_path,
       cast(max(l_quantity) AS INT) AS total_chunks, cast(floor(max(l_quantity) * (l_orderkey % 5) / 4e0) AS INT) AS done_chunks,
       cast(CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE floor(max(l_extendedprice)) END AS BIGINT) AS source_size,
       cast(CASE WHEN l_orderkey % 13 = 0 THEN NULL ELSE 1710000000000000000 + l_orderkey * 1000000 END AS BIGINT) AS source_modified,
       cast(CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE 1710000000000000000 + l_orderkey END AS BIGINT) AS source_change_time,
       cast(CASE WHEN l_orderkey % 4 = 0 THEN NULL ELSE l_orderkey END AS BIGINT) AS source_inode,
       l_orderkey % 17 = 0 AS cache_only, max(l_shipdate) AS updated_at
FROM {lineitem} GROUP BY l_orderkey, l_linenumber""",
    "files": """
SELECT doc_id AS id, concat(source, '/', lang, '/doc_', cast(doc_id AS STRING), '.',
       CASE doc_id % 14 WHEN 0 THEN 'log' WHEN 1 THEN 'json' WHEN 2 THEN 'toml' WHEN 3 THEN 'py' WHEN 4 THEN 'txt' WHEN 5 THEN 'db' WHEN 6 THEN 'PNG'
            WHEN 7 THEN 'mp4' WHEN 8 THEN 'mp3' WHEN 9 THEN 'zip' WHEN 10 THEN 'exe' WHEN 11 THEN 'odb' WHEN 12 THEN 'h5' ELSE 'xyz' END) AS path,
       cast(octet_length({bytes:text}) AS BIGINT) AS size, 1710000000000000000 + doc_id * 1000003 AS modified,
       CASE WHEN doc_id % 13 = 0 THEN cast(NULL AS BIGINT) ELSE 1710000000000000000 + doc_id END AS change_time,
       doc_id AS inode, cast(420 + doc_id % 3 AS INT) AS mode
FROM {documents}""",
    "files_now": """
SELECT id, path, size + CASE WHEN id % 5 = 0 THEN 1 ELSE 0 END AS size,
       CASE WHEN id % 7 = 0 THEN modified + 1000000000 WHEN id % 9 = 0 THEN cast(1710000000 + (id * 1000003 - (id * 1000003) % 1000000000) / 1000000000 AS BIGINT) ELSE modified END AS modified,
       change_time, inode, mode FROM ({files}) f WHERE id % 11 <> 0
UNION ALL SELECT id, concat('new/', path), size, modified, change_time, inode, mode FROM ({files}) f WHERE id % 23 = 0""",
    "files_dest": """
SELECT id, path, size + CASE WHEN id % 8 = 0 THEN 2 ELSE 0 END AS size, modified, CASE WHEN id % 6 = 0 THEN cast(NULL AS BIGINT) ELSE change_time END AS change_time, inode,
       cast(CASE WHEN id % 10 = 0 THEN 511 ELSE mode END AS INT) AS mode FROM ({files}) f WHERE id % 15 <> 0""",
    "samples": """
SELECT user_id AS region, event_id AS seq, ts, cast(floor(value * 1e6) AS BIGINT) AS bytes,
       1 + cast({json:props,k} AS BIGINT) AS duration_ms, event_type <> 'error' AS ok
FROM {events}""",
    "scans": """
SELECT cast(user_id AS STRING) AS path, event_id AS seq, ts AS scan_ts, cast(floor(value / 50) AS BIGINT) AS size, date_trunc('hour', ts) AS modified FROM {events}""",
    "errors": """
SELECT event_id, user_id, CASE event_id % 12 WHEN 0 THEN '[fatal] bad request' WHEN 1 THEN 'Request timed out' WHEN 2 THEN 'Connection refused' WHEN 3 THEN 'Broken pipe'
       WHEN 4 THEN 'no route to host' WHEN 5 THEN 'file not found' WHEN 6 THEN 'Permission denied' WHEN 7 THEN 'Peer unhealthy' WHEN 8 THEN 'cancelled by user'
       WHEN 9 THEN 'job cancelled' WHEN 10 THEN 'Timeout' ELSE 'odd' END AS message,
       CASE event_id % 5 WHEN 0 THEN 'FileOperation' WHEN 1 THEN 'ProtocolError' WHEN 2 THEN 'Io' WHEN 3 THEN 'Other' ELSE 'InvalidConfig' END AS kind
FROM {events}""",
    "chunks": """
SELECT doc_id, cast(pos AS BIGINT) AS idx, cast(octet_length({bytes:line}) AS BIGINT) AS length, {sha:line} AS strong, substring({sha:line}, 1, 6) AS weak FROM {lines}""",
    "tree": """
SELECT concat(r_name, '/', n_name, '.txt') AS path, 'F' AS kind, repeat(concat(n_name, ' of ', r_name, '.'), cast(3 + n_nationkey % 5 AS INT)) AS text, cast(NULL AS STRING) AS target, n_nationkey AS k FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
UNION ALL SELECT concat('links/', n_name), 'L', cast(NULL AS STRING), concat('../', r_name, '/', n_name, '.txt'), n_nationkey FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
UNION ALL SELECT r_name, 'D', cast(NULL AS STRING), cast(NULL AS STRING), r_regionkey FROM {region}
UNION ALL SELECT concat('.', r_name), 'D', cast(NULL AS STRING), cast(NULL AS STRING), r_regionkey FROM {region}
UNION ALL SELECT concat('.', r_name, '/', 'inner.log'), 'F', concat('log of ', r_name), cast(NULL AS STRING), r_regionkey FROM {region}
UNION ALL SELECT concat('zero/', r_name), 'F', '', cast(NULL AS STRING), r_regionkey FROM {region}
UNION ALL SELECT p, kind, text, target, 0 FROM (VALUES ('zero', 'D', cast(NULL AS STRING), cast(NULL AS STRING)), ('links', 'D', NULL, NULL), ('.notes', 'F', 'notes', NULL), ('readme', 'F', 'read me', NULL), ('latest', 'L', NULL, 'readme')) v(p, kind, text, target)""",
}

SPARK = {"bytes": "{}", "sha": "sha2({}, 256)", "json": "get_json_object({}, '$.{}')", "lines": "(SELECT doc_id, pos, line FROM {documents} LATERAL VIEW posexplode(split(text, '\\n')) p AS pos, line) lines"}
DUCK = {"bytes": "encode({})", "sha": "sha256({})", "json": "json_extract_string({}, '$.{}')", "lines": "(SELECT doc_id, pos - 1 AS pos, line FROM documents, unnest(string_split(text, chr(10))) WITH ORDINALITY u(line, pos)) lines"}


def expand(text: str, dialect: dict, source) -> str:
    """Replace ``{name}`` by a source table or another binding, ``{f:a,b}`` by the dialect's function."""

    def one(m: re.Match) -> str:
        name, _, args = m[1].partition(":")
        if args:
            return dialect[name].format(*args.split(","))
        if name in dialect:
            return expand(dialect[name], dialect, source)
        return expand(SQL[name], dialect, source) if name in SQL else source(name)

    return re.sub(r"\{(\w+(?::[^}]*)?)\}", one, text)


def duck(text: str) -> str:
    """SQL for DuckDB, over its views."""
    return expand(text, DUCK, lambda name: name).strip()


def spark_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A binding, or a source table, as a DataFrame."""
    if name not in SQL:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(expand(SQL[name], SPARK, lambda t: f"parquet.`{sf_dir}/{t}.parquet`"))
