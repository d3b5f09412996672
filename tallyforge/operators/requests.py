"""Requests to models: which errors are tried again, which answers are kept, and who answers a stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.normalise import request_key

# Codes of HTTP and of the body that are tried again.
RETRY_HTTP = (408, 424, 429, 500, 501, 502, 503, 504)
RETRY_BODY = ("40800", "42400", "42900", "42903", "50000", "50100", "50400", "64000", "64424", "64500", "65002", "64429")


def error_class(http: Column, body: Column) -> Column:
    """retry, authentication, parameters, too_long or client, asked in this order; null for an answer below 400 without a body code."""
    body = F.coalesce(body, F.lit(""))
    again = F.coalesce(http.isin(*RETRY_HTTP), F.lit(False)) | body.isin(*RETRY_BODY)
    return (
        F.when((F.coalesce(http, F.lit(0)) < 400) & (body == ""), None)
        .when(again, "retry")
        .when(F.startswith(body, F.lit("4010")) | F.coalesce(http == 401, F.lit(False)), "authentication")
        .when(body == "40001", "parameters")
        .when(body == "40003", "too_long")
        .otherwise("client")
    )


def backoff(attempt: Column, first: float = 2.0, most: float = 60.0) -> Column:
    """Seconds to wait before the attempt after this one (from 1): doubled each time, up to ``most``."""
    return F.least(F.lit(float(most)), F.lit(float(first)) * F.pow(F.lit(2.0), attempt - 1))


def keepable(content: Column, stop_reason: Column) -> Column:
    """Whether an answer may be kept: it wasn't cut off, and it reads as JSON."""
    cut = F.lower(F.coalesce(stop_reason, F.lit(""))).isin("length", "max_tokens")
    return ~cut & F.coalesce(F.get_json_object(content, "$").isNotNull(), F.lit(False))


def answered(requests: DataFrame, cache: DataFrame, *parts: str) -> tuple[DataFrame, DataFrame]:
    """(hits, misses): requests with a kept answer (cache: key, content), and one request of each key without."""
    keyed = requests.withColumn("key", request_key(*[F.col(p) for p in parts]))
    hits = keyed.join(cache.select("key", "content"), "key")
    misses = keyed.join(cache.select("key"), "key", "left_anti")
    first = F.row_number().over(Window.partitionBy("key").orderBy(*parts))
    return hits, misses.withColumn("_n", first).where("_n = 1").drop("_n")


def provider_of(stage: Column, stages: dict[str, str], default: str | None) -> Column:
    """The provider of a stage: its own, else the default."""
    own = F.try_element_at(F.create_map(*[F.lit(x) for pair in stages.items() for x in pair]), stage) if stages else F.lit(None).cast("string")
    return F.coalesce(own, F.lit(default))
