"""Landing raw rows, collecting many sources, and wide export."""

from __future__ import annotations

import time
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from threading import Thread

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from ..functions.order import number_rows


def land_raw(df: DataFrame, source_id: int, batch_id: str, index_col: str | None = None) -> DataFrame:
    """Rows as payload maps with batch, source and their place in the source; NaN counts as null.

    Without ``index_col`` the places are 0 to n - 1 in the order of the source's files and of the rows in them.
    """
    if not index_col:
        index_col = "_row_index"
        df = number_rows(df, index_col)
    index = F.col(index_col).cast("long")
    clean = lambda c, t: F.nanvl(F.col(f"`{c}`"), F.lit(None)).cast("string") if t in ("double", "float") else F.col(f"`{c}`").cast("string")
    pairs = [x for c, t in df.dtypes if c != index_col for x in (F.lit(c), clean(c, t))]
    return df.select(F.lit(source_id).alias("source_id"), F.lit(batch_id).alias("batch_id"), index.alias("source_row_index"), F.create_map(*pairs).alias("raw_data"), F.lit("raw").alias("status"))


def write_documents(docs: DataFrame, path: str, folders: int = 0) -> int:
    """Writes each (file_name, text) as a file of its own below ``path``, a URI that all executors share; how many there are.

    With ``folders`` the files are spread over so many folders by their names, so that none gets too many; read_documents finds
    them at a depth of 1.
    """
    where = path if ":" in path else f"file://{path}"

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = fs.FileSystem.from_uri(where)
        store.create_dir(root)
        made = {""}
        for batch in batches:
            for name, text in zip(batch["file_name"], batch["text"]):
                folder = f"/{zlib.crc32(name.encode()) % folders:05d}" if folders else ""
                if folder not in made:
                    store.create_dir(root + folder)
                    made.add(folder)
                with store.open_output_stream(f"{root}{folder}/{name}") as out:
                    out.write((text or "").encode())
            yield pd.DataFrame({"n": [len(batch)]})

    return docs.select("file_name", "text").mapInPandas(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def collect_batch(spark: SparkSession, sources: Iterable[dict], load: Callable[[SparkSession, dict], DataFrame], write: Callable[[DataFrame, str], None], stamp: str, at_once: int = 8, seconds: float = 3600) -> DataFrame:
    """Lands the sources, ``at_once`` at a time; one that fails or hangs does not stop the rest. A row for each source, with its count or error.

    write: gets the rows of a batch and its name, and writes to a folder of that batch alone, as sources are written at once.
    A source that takes longer than ``seconds`` is given up: its jobs, which carry a tag of its own, are cancelled, its place goes
    to the next source, and it writes nothing any more if it comes back.
    """
    sc = spark.sparkContext
    waiting, running, out, lost = list(enumerate(sources)), {}, {}, set()

    def land(k: int, source: dict, tag: str) -> None:
        batch = f"batch_{stamp}_{source['id']}"
        try:
            sc.addJobTag(tag)
            counted = Observation()
            landed = land_raw(load(spark, source), source["id"], batch).observe(counted, F.count("*").alias("n"))
            if tag not in lost:
                write(landed, batch)
                found = (source["id"], batch, "active", counted.get["n"], None)
        except Exception as error:  # reported, not swallowed
            found = (source["id"], None, "error", 0, f"{type(error).__name__}: {str(error)[:200]}")
        if tag not in lost:
            out[k] = found

    while waiting or running:
        while waiting and len(running) < at_once:
            k, source = waiting.pop(0)
            tag = f"collect_{uuid.uuid4().hex}"
            running[k] = (Thread(target=land, args=(k, source, tag), daemon=True), source, tag, time.monotonic() + seconds)
            running[k][0].start()
        for k, (thread, source, tag, end) in list(running.items()):
            if not thread.is_alive():
                del running[k]
            elif time.monotonic() > end:
                lost.add(tag)
                sc.cancelJobsWithTag(tag)
                out[k] = (source["id"], None, "error", 0, f"TimeoutError: not done after {seconds} seconds")
                del running[k]
        time.sleep(0.02)
    return spark.createDataFrame([out[k] for k in sorted(out)], "source_id int, batch_id string, status string, rows long, message string")


def collect_totals(results: DataFrame) -> DataFrame:
    return results.agg(F.count("*").alias("sources"), F.count_if(F.col("status") == "active").alias("succeeded"), F.sum("rows").alias("rows"))


def update_source_status(sources: DataFrame, results: DataFrame, at: str) -> DataFrame:
    """Time, count and active or error with its message, for the sources that were collected."""
    new = results.selectExpr("source_id id", "status _status", "rows _rows", "message _message")
    done = F.col("_status").isNotNull()
    return sources.join(new, "id", "left").withColumns({
        "status": F.coalesce("_status", "status"),
        "last_collect_at": F.when(done, F.lit(at).cast("timestamp")),
        "last_collect_count": F.when(F.col("_status") == "active", F.col("_rows")),
        "error_message": F.col("_message"),
    }).drop("_status", "_rows", "_message")


def export_wide(records: DataFrame, types: list[str] | None = None, start: str | None = None, end: str | None = None, include_anomalies: bool = True, most_keys: int = 500) -> DataFrame:
    """Filtered records by date with a ``业务_<key>`` column for each payload key; an empty result is an error.

    The keys become columns, so their number is checked against ``most_keys``.
    """
    found = records.where(F.col("data_type").isin(types)) if types else records
    found = found.where(F.col("record_date") >= F.lit(start).cast("date")) if start else found
    found = found.where(F.col("record_date") <= F.lit(end).cast("date")) if end else found
    found = found if include_anomalies else found.where("not is_anomaly")
    keys = [r.k for r in found.select(F.explode(F.map_keys("business_data")).alias("k")).distinct().orderBy("k").limit(most_keys + 1).collect()]
    if len(keys) > most_keys:
        raise ValueError(f"more than {most_keys} payload keys")
    if not keys and found.isEmpty():
        raise ValueError("no records to export")
    label = F.when(F.col("is_anomaly"), "是").otherwise("否").alias("is_anomaly")
    return found.select("id", "data_type", "employee_name", "department", "record_date", "quality_score", label, "anomaly_reason", *(F.col("business_data").getItem(k).alias(f"业务_{k}") for k in keys)).orderBy("record_date", "id")
