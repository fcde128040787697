"""Credentials, bearer tokens, size limits and the per-tenant fixed-window rate limit."""

from __future__ import annotations

from math import floor

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Least bytes of a key, items of a batch, bytes of a feedback text and of a tool's text, lengths of fields.
KEY_BYTES, BATCH_ITEMS, FEEDBACK_BYTES, TOOL_BYTES = 32, 1000, 65_536, 65_536
#: Fixed value: requests of a tenant in a minute where nothing else is set.
PER_MINUTE = 600
IP_UNITS, EMAIL_UNITS, NAME_UNITS = 45, 320, 256


def credential_errors(rows: DataFrame) -> DataFrame:
    """(row, error) of each credential (row, tenant, api_key): the first fault in order, null if none."""
    key = Window.partitionBy("api_key").orderBy("row")
    tenant = Window.partitionBy("tenant").orderBy("row")
    marked = rows.withColumns({"_k": F.row_number().over(key), "_t": F.row_number().over(tenant)})
    error = (
        F.when(F.octet_length("api_key") < KEY_BYTES, "too_short").when(~F.col("tenant").rlike(r"^[A-Za-z0-9_-]{1,64}\z"), "invalid_tenant")
        .when(F.col("_k") > 1, "duplicate_key").when(F.col("_t") > 1, "duplicate_tenant")
    )
    return marked.select("row", error.alias("error"))


def check_credentials(rows: DataFrame, per_minute: int = PER_MINUTE) -> DataFrame:
    """``rows`` (row, tenant, api_key) if there is one at least, none has a fault, and the limit is positive; else raises."""
    if per_minute < 1:
        raise ValueError("the limit must be positive")
    if rows.isEmpty():
        raise ValueError("no credentials")
    fault = credential_errors(rows).where("error IS NOT NULL").orderBy("row").first()
    if fault:
        raise ValueError(f"credential {fault.row}: {fault.error}")
    return rows


def bearer_token(headers: Column) -> Column:
    """The token of an array of Authorization values: exactly one value of two words, the first "bearer" in any case."""
    parts = F.filter(F.split(F.get(headers, F.lit(0)), r"[ \t\n\f\r]+"), lambda p: p != "")
    return F.when((F.size(headers) == 1) & (F.size(parts) == 2) & (F.lower(F.get(parts, F.lit(0))) == "bearer"), F.get(parts, F.lit(1)))


def authenticated(requests: DataFrame, credentials: DataFrame) -> DataFrame:
    """``requests`` (headers) with tenant_id: the tenant whose key digest the token's equals, null without one."""
    known = credentials.select(F.sha2("api_key", 256).alias("_digest"), F.substring(F.sha2("tenant", 256), 1, 32).alias("tenant_id"))
    return requests.withColumn("_digest", F.sha2(bearer_token(F.col("headers")), 256)).join(known, "_digest", "left").drop("_digest")


def rate_limited(requests: DataFrame, limit: int, window: float = 60.0) -> DataFrame:
    """(id, tenant, at, accepted, retry_after) of requests (id, tenant, at in seconds).

    A tenant's window starts at its first request and again with the first one ``window`` seconds or more later;
    within a window ``limit`` requests are accepted, and a rejected one is told the whole seconds left, one at least.
    Windows depend on one another in turn, so a tenant's requests pass one task in order; they stream through
    it sorted, with one window held at a time, whatever a tenant sends.
    """
    if limit < 1:
        raise ValueError("the limit must be positive")

    def fold(batches):
        tenant, start, used = object(), 0.0, 0
        for batch in batches:
            accepted, wait = [], []
            for who, at in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if who != tenant or at - start >= window:
                    tenant, start, used = who, at, 0
                ok = used < limit
                used += ok
                accepted.append(ok)
                wait.append(None if ok else max(1, floor(window - (at - start))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(accepted, pa.bool_()), pa.array(wait, pa.int64())], ["id", "tenant", "at", "accepted", "retry_after"])

    thin = requests.select(F.col("id").cast("long").alias("id"), "tenant", F.col("at").cast("double").alias("at"))
    return thin.repartition("tenant").sortWithinPartitions("tenant", "at", "id").mapInArrow(fold, "id long, tenant string, at double, accepted boolean, retry_after long")


def parse_key_list(value: Column) -> Column:
    """Array of (tenant, api_key) of "tenant=key,…": split at commas and at the first "=", trimmed; blanks dropped."""
    parts = F.filter(F.transform(F.split(value, ","), F.trim), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)).alias("tenant"), F.when(F.contains(p, F.lit("=")), F.trim(F.substring(p, F.instr(p, "=") + 1, F.length(p)))).alias("api_key")))


def utf16_units(text: Column) -> Column:
    """Length in UTF-16 units: code points, those beyond the basic plane twice."""
    return F.length(text) + F.length(F.regexp_replace(text, r"[^\x{10000}-\x{10FFFF}]", ""))


def tool_input_ok(text: Column, ip: Column, email: Column, name: Column) -> Column:
    short = lambda c, n: c.isNull() | (utf16_units(c) <= n)
    return text.isNotNull() & (utf16_units(text) >= 1) & (utf16_units(text) <= TOOL_BYTES) & (F.octet_length(text) <= TOOL_BYTES) & short(ip, IP_UNITS) & short(email, EMAIL_UNITS) & short(name, NAME_UNITS)
