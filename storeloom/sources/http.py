"""Fetching over HTTP with a transport that the caller gives; hosts are paced within their task.

A transport is a function (url, headers, timeout) -> (status, headers, body bytes) that raises TimeoutError
for an aborted request and OSError for any other failure.
"""

from __future__ import annotations

import base64
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storeloom.functions.text import mime_type
from storeloom.functions.urls import host

# The fetcher's defaults.
MIN_INTERVAL_MS, TIMEOUT_S = 2_000, 30.0
HEADERS = {"User-Agent": "storeloom/1.0", "Accept": "text/html,application/xhtml+xml,application/xml;q=0.9,*/*;q=0.8", "Accept-Language": "zh-TW,zh;q=0.9,en;q=0.8"}
SCHEMA = "url string, status int, content_type string, text string, error_code string"

Transport = Callable[[str, dict, float], tuple[int, dict, bytes]]


def attempt(transport: Transport, url: str, headers: dict, timeout: float) -> dict:
    try:
        status, sent, body = transport(url, headers, timeout)
    except TimeoutError:
        return {"url": url, "error_code": "FETCH_ABORTED", "body": None}
    except Exception:
        return {"url": url, "error_code": "FETCH_FAILED", "body": None}
    kind = next((v for k, v in sent.items() if k.lower() == "content-type"), None)
    bad = not 200 <= status < 300
    return {"url": url, "status": status, "content_type": kind, "error_code": "HTTP_STATUS" if bad else None, "body": None if bad else body}


def paced(transport: Transport, headers: dict, timeout: float, interval_ms: int, clock=time.monotonic, sleep=time.sleep):
    """A generator function over batches of (url, host): a host's requests start ``interval_ms`` apart at least."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        free: dict[str, float] = {}
        for batch in batches:
            out = []
            for url, name in zip(batch["url"], batch["host"]):
                now = clock()
                slot = max(now, free.get(name, now))
                free[name] = slot + interval_ms / 1000
                if slot > now:
                    sleep(slot - now)
                out.append(attempt(transport, url, headers, timeout))
            yield pd.DataFrame(out, columns=["url", "status", "content_type", "error_code", "body"])

    return run


def fetch(urls: DataFrame, transport: Transport, headers: dict | None = None, timeout: float = TIMEOUT_S, interval_ms: int = MIN_INTERVAL_MS) -> DataFrame:
    """Rows (url) to (url, status, content_type, error_code, body). A host's URLs share a task, as one client paces it."""
    rows = urls.select("url").withColumn("host", F.coalesce(host(F.col("url")), F.lit(""))).repartition("host")
    return rows.mapInPandas(paced(transport, HEADERS | (headers or {}), timeout, interval_ms), "url string, status int, content_type string, error_code string, body binary")


def fetch_text(urls: DataFrame, transport: Transport, **options) -> DataFrame:
    return fetch(urls, transport, **options).select("url", "status", "content_type", F.decode("body", "UTF-8").alias("text"), "error_code")


def fetch_images(urls: DataFrame, transport: Transport, **options) -> DataFrame:
    """url, base64, mime_type, status, error_code (HTTP_NOT_OK or FETCH_FAILED)."""
    got = fetch(urls, transport, **options)
    code = F.when(F.col("error_code") == "HTTP_STATUS", "HTTP_NOT_OK").when(F.col("error_code").isNotNull(), "FETCH_FAILED")
    return got.select("url", F.base64("body").alias("base64"), F.when(F.col("body").isNotNull(), F.coalesce(mime_type(F.col("content_type")), F.lit("image/jpeg"))).alias("mime_type"), "status", code.alias("error_code"))


def images_from_files(spark, path: str) -> DataFrame:
    """Stored images as (path, base64, mime_type), read by Spark's own binary source."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.base64("content").alias("base64"), mime_type(F.col("path")).alias("mime_type"))


def data_url(mime: str | None, body: bytes) -> str:
    return f"data:{mime or 'image/jpeg'};base64,{base64.b64encode(body).decode()}"
