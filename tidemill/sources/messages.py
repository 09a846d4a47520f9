"""Provider messages and notifications to canonical rows."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MESSAGE = "id string, thread_id string, date bigint, subject string, body string, snippet string, `from` array<struct<email:string,name:string>>, `to` array<struct<email:string,name:string>>, headers array<struct<name:string,value:string>>, folders array<string>"
EVENT = "type string, data struct<object:struct<id:string,grant_id:string>>"
#: Webhook event types that announce a message.
MESSAGE_EVENTS = ("message.created", "message.created.truncated", "message.updated")


def normalized(raw: DataFrame, column: str = "value") -> DataFrame:
    """JSON messages as canonical columns; seconds since the epoch become timestamps, rows without an id go."""
    m = F.from_json(column, MESSAGE)
    rows = raw.select(m.alias("m")).where("m.id is not null")
    return rows.select(F.col("m.id").alias("message_id"), F.col("m.thread_id"), F.timestamp_seconds("m.date").alias("received_at"), F.col("m.subject"), F.coalesce("m.body", "m.snippet").alias("body_html"), F.col("m.from"), F.col("m.to"), F.coalesce("m.headers", F.array()).alias("headers"), F.coalesce("m.folders", F.array()).alias("folders"))


def message_events(raw: DataFrame, column: str = "value") -> DataFrame:
    """type, message_id and grant_id of the notifications that announce messages."""
    e = F.from_json(column, EVENT)
    rows = raw.select(e.alias("e")).where(F.col("e.type").isin(*MESSAGE_EVENTS))
    return rows.select("e.type", F.col("e.data.object.id").alias("message_id"), F.col("e.data.object.grant_id").alias("grant_id")).where("message_id is not null")


def disposition(virus: Column, spam: Column) -> Column:
    """What becomes of an inbound message by its gateway verdicts."""
    return F.when(F.upper(virus) == "FAIL", "reject").when(F.upper(spam).isin("FAIL", "PROCESSING_FAILED"), "quarantine").otherwise("accept")


def signed(secret: str):
    """A column function (body, signature) that checks an HMAC-SHA256 in constant time; Spark has no HMAC of its own."""

    @F.pandas_udf("boolean")
    def check(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        key = secret.encode()
        for body, signature in parts:
            yield pd.Series([b is not None and s is not None and hmac.compare_digest(hmac.new(key, b.encode(), hashlib.sha256).hexdigest(), s) for b, s in zip(body, signature, strict=True)])

    return check
