"""Schemas of the stored tables, and reading older ones: a column that is missing gets its default."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TABLES = {
    "jobs": "job_id string, region string, source_path string, source_client_id string, dest_path string, dest_client_id string, status string, progress int, current_size long, total_size long, priority int, round_id long, is_last_round boolean, exclude_regex array<string>, include_regex array<string>, job_type string, options struct<compression:string,workers:int,chunk_size:long>, error_message string, created_at timestamp_ntz, updated_at timestamp_ntz",
    "transfer_states": "job_id string, file_path string, total_chunks int, completed_chunks array<int>, progress int, source_size long, source_modified long, source_change_time long, source_inode long, dest_size long, dest_modified long, dest_change_time long, dest_inode long, cache_only boolean, created_at timestamp_ntz, updated_at timestamp_ntz",
    "job_retries": "job_id string, retry_count int, max_retries int, last_retry_at timestamp_ntz, next_retry_at timestamp_ntz, last_error string, created_at timestamp_ntz, updated_at timestamp_ntz",
    "tmp_transfer_paths": "job_id string, path string, updated_at timestamp_ntz",
    "api_idempotency_keys": "scope string, idempotency_key string, request_fingerprint string, job_id string, created_at timestamp_ntz, updated_at timestamp_ntz",
    "chunk_locations": "hash string, file_path string, offset long, size long, mtime long, strong string, seq long",
    "file_scans": "path string, modified long, size long, chunk_count int, last_indexed long",
}
DEFAULTS = {"cache_only": False, "round_id": 0, "is_last_round": False, "max_retries": 3, "priority": 0, "progress": 0, "current_size": 0, "total_size": 0}


def migrated(df: DataFrame, table: str) -> DataFrame:
    """The table in its present schema: missing columns are added, those of JSON text decoded."""
    schema = df.sparkSession.createDataFrame([], TABLES[table]).schema
    have, out = dict(df.dtypes), []
    for f in schema:
        kind = f.dataType.simpleString()
        if f.name not in have:
            value = F.lit(DEFAULTS.get(f.name)).cast(f.dataType)
        elif have[f.name] == "string" and kind.startswith(("array", "struct")):
            value = F.from_json(f.name, kind)
        else:
            value = F.col(f.name).cast(f.dataType)
        out.append(value.alias(f.name))
    return df.select(*out)
