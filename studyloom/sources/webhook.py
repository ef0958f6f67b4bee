"""Signed callbacks with a bounded number of attempts."""

from __future__ import annotations

import hashlib
import hmac
import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L


def body_of(payload: dict) -> bytes:
    return json.dumps(payload, separators=(",", ":"), ensure_ascii=False).encode()


def sign(body: bytes, secret: str) -> str:
    """Hex HMAC-SHA256 of the raw body."""
    return hmac.new(secret.encode(), body, hashlib.sha256).hexdigest()


def signature(column: str, secret: str):
    """sign over a column of bodies."""

    @F.pandas_udf("string")
    def signed(bodies: pd.Series) -> pd.Series:
        return bodies.map(lambda b: None if b is None else sign(b.encode(), secret))

    return signed(F.col(column))


def outcome(status: int | None) -> str:
    """delivered, refused (no second attempt) or retry; None is a network error."""
    if status is None or status == 429 or status >= 500:
        return "retry"
    return "delivered" if 200 <= status < 300 else "refused"


def post(url: str, body: bytes, headers: dict[str, str]) -> int | None:
    request = urllib.request.Request(url, body, headers, method="POST")
    try:
        with urllib.request.urlopen(request, timeout=L.WEBHOOK_TIMEOUT) as answer:
            return answer.status
    except urllib.error.HTTPError as error:
        return error.code
    except (urllib.error.URLError, OSError):
        return None


def deliver(url: str, payload: dict, secret: str, send: Callable = post, wait: Callable = time.sleep) -> bool:
    """Whether the payload arrived, after at most three attempts."""
    body = body_of(payload)
    headers = {"Content-Type": "application/json", "X-Signature": f"sha256={sign(body, secret)}"}
    for attempt in range(L.WEBHOOK_ATTEMPTS):
        result = outcome(send(url, body, headers))
        if result != "retry":
            return result == "delivered"
        if attempt + 1 < L.WEBHOOK_ATTEMPTS:
            wait(L.WEBHOOK_BACKOFF[attempt])
    return False


def deliver_rows(rows: DataFrame, secret: str, send: Callable = post, wait: Callable = time.sleep) -> DataFrame:
    """rows (url, message) with delivered; each partition posts its own."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(delivered=[deliver(u, json.loads(m), secret, send, wait) for u, m in zip(frame.url, frame.message, strict=True)])

    return rows.select("url", "message").mapInPandas(run, "url string, message string, delivered boolean")
