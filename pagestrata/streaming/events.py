"""Event streams: editor logs, conversion progress, ingestion."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pagestrata.operators.common import grouped_map, in_ranges, running

HISTORY = 50  # fixed value: undo steps an editor keeps


def step(items: list, past: list, action: str, item: str | None) -> tuple[list, list]:
    """One editor action on the current items and their undo history."""
    if action == "reset":
        return [], []
    if action == "undo":
        return (past[-1], past[:-1]) if past else (items, past)
    if action == "clear" and not items:
        return items, past
    new = {"add": [*items, item], "remove": [i for i in items if i != item], "clear": []}.get(action, items)
    return new, [*past, items][-HISTORY:]


def replay_editor_events(log: DataFrame) -> DataFrame:
    """Current items per document from a whole log (doc_id, seq, action, item_id). What lies before a document's last
    reset cannot matter and never reaches its replay."""
    resets = log.filter("action = 'reset'").groupBy("doc_id").agg(F.max("seq").alias("_from"))
    live = log.join(resets, "doc_id", "left").filter(F.col("_from").isNull() | (F.col("seq") > F.col("_from")))

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        items, past = [], []
        pdf = pdf.sort_values("seq")
        for action, item in zip(pdf["action"], pdf["item_id"]):
            items, past = step(items, past, action, item)
        return pd.DataFrame({"doc_id": [pdf["doc_id"].iloc[0]], "items": [",".join(items)], "n_items": [len(items)]})

    found = grouped_map(live.select("doc_id", "seq", "action", "item_id"), ["doc_id"], replay, "doc_id bigint, items string, n_items int")
    known = log.select("doc_id").distinct()
    return known.join(found, "doc_id", "left").select("doc_id", F.coalesce("items", F.lit("")).alias("items"), F.coalesce("n_items", F.lit(0)).alias("n_items"))


def editor_state_stream(stream: DataFrame) -> DataFrame:
    """The same as a stream: items and history live in the document's state."""

    def update(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        items, past = json.loads(state.get[0]) if state.exists else ([], [])
        pdf = pd.concat(list(batches)).sort_values("seq")
        for action, item in zip(pdf["action"], pdf["item_id"]):
            items, past = step(items, past, action, item)
        state.update((json.dumps([items, past]),))
        yield pd.DataFrame({"doc_id": [key[0]], "items": [",".join(items)], "n_items": [len(items)]})

    return stream.groupBy("doc_id").applyInPandasWithState(update, "doc_id bigint, items string, n_items int", "state string", "update", GroupStateTimeout.NoTimeout)


# Cost of a page by stage.
READ, OCR, ANALYSE = 1.0, 12.0, 1.5


def progress(events: DataFrame, expected_ocr: int = 0) -> DataFrame:
    """Percentage per job, never falling and below 100: events (job, event_id, stage, page, pages). The count of OCR
    pages so far runs along ranges of events, so a job with very many events is not ordered in one task."""
    ocr = F.when(F.col("stage") == "ocr", 1).otherwise(0)
    e = running(in_ranges(events, ["job"], ["event_id"]), ["job"], "k", ocr)
    return e.groupBy("job").agg(F.max(percent(expected_ocr)).alias("pct"), F.max("k").alias("ocr_pages"), F.count("*").alias("events"))


def percent(expected_ocr: int):
    n, page, k = F.col("pages"), F.col("page"), F.col("k")
    units = (
        F.when(F.col("stage") == "reading", (page - 1) * READ + k * OCR)
        .when(F.col("stage") == "ocr", page * READ + (k - 1) * OCR)
        .when(F.col("stage") == "analysing", n * READ + k * OCR + (page - 1) * ANALYSE)
        .otherwise(n * (READ + ANALYSE) + k * OCR)
    )
    total = n * (READ + ANALYSE) + F.greatest(F.lit(expected_ocr), k) * OCR + F.greatest(F.lit(2.0), n * 0.3)
    return F.least(F.lit(99), F.floor(units / total * 100 + 0.5)).cast("int")


def progress_stream(stream: DataFrame, expected_ocr: int = 0) -> DataFrame:
    """Progress per job as events arrive; the OCR count and the best percentage are the job's state."""

    def update(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        k, best, seen = state.get if state.exists else (0, 0, 0)
        pdf = pd.concat(list(batches)).sort_values("event_id")
        for stage, page, n in zip(pdf["stage"], pdf["page"], pdf["pages"]):
            k += stage == "ocr"
            units = {
                "reading": (page - 1) * READ + k * OCR,
                "ocr": page * READ + (k - 1) * OCR,
                "analysing": n * READ + k * OCR + (page - 1) * ANALYSE,
            }.get(stage, n * (READ + ANALYSE) + k * OCR)
            total = n * (READ + ANALYSE) + max(expected_ocr, k) * OCR + max(2.0, n * 0.3)
            best = max(best, min(99, int(units / total * 100 + 0.5)))
            seen += 1
        state.update((int(k), int(best), int(seen)))
        yield pd.DataFrame({"job": [key[0]], "pct": [best], "ocr_pages": [k], "events": [seen]})

    return stream.groupBy("job").applyInPandasWithState(update, "job bigint, pct int, ocr_pages bigint, events bigint", "k bigint, best int, seen bigint", "update", GroupStateTimeout.NoTimeout)


def ingest_stream(stream: DataFrame, convert: Callable[[DataFrame], DataFrame], out: str, failed: str, checkpoint: str):
    """Convert arriving documents batch by batch. ``convert`` adds a column ``error`` (null when fine): failures are
    recorded and the run goes on. A batch is converted and written once, apart by whether it failed, and its failures are
    copied from there; replayed after a lost executor it rewrites its own folders. ``out`` holds ``failed=false`` and
    ``failed=true`` under each batch."""

    def batch(df: DataFrame, number: int) -> None:
        place = f"{out}/batch={number}"
        done = convert(df).withColumn("failed", F.col("error").isNotNull())
        done.write.mode("overwrite").partitionBy("failed").parquet(place)
        kept = df.sparkSession.read.schema(done.schema).parquet(place)
        kept.filter("failed").drop("failed").write.mode("overwrite").parquet(f"{failed}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
