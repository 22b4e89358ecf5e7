"""Keeping a stored graph current: a stream of file events, applied batch by batch."""

from __future__ import annotations

import os
import time
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wovengraph.operators.store import Store
from wovengraph.plans import indexing
from wovengraph.sources import scan
from wovengraph.streaming.events import EVENT, actions, watched


def apply_batch(store: Store, root: str, batch: DataFrame, warn: Callable[[str], None] = print) -> indexing.Report:
    """Apply the events of one batch: paths removed or gone leave the graph, others are hashed and
    written if they changed; then the graph is linked and scored.  Running a batch again changes
    nothing, as hashes are compared, so replays after a failure are harmless."""
    store.begin()
    base = root.rstrip("/")
    wanted = actions(batch).withColumn("path", F.regexp_replace("path", f"^{scan._quoted(base)}/", ""))
    rows = wanted.collect()  # the paths of one batch of file-system events
    there = [r.path for r in rows if r.action == "upsert" and os.path.isfile(f"{base}/{r.path}")]
    gone = sorted({r.path for r in rows} - set(there))
    spark = store.spark
    removed = store.read("files").join(spark.createDataFrame([(p,) for p in gone], "path string"), "path", "left_semi")
    found = scan.read_files(spark, base, there)
    fresh = scan.changed_files(scan.file_rows(found), store.read("files"))
    report, tables = indexing.apply_files(store, fresh, removed)
    for path in report.failed:
        warn(f"left as it was: {path}")
    if report.written or report.removed:
        store.commit(tables, graph_dirty=True, vector_dirty=True)
    if store.dirty("graph"):
        indexing.link(store)
    return report


def watch(store: Store, root: str, events: DataFrame, database: str, checkpoint: str, debounce: str = "2 seconds", available_now: bool = False) -> StreamingQuery:
    """Start applying a stream of events (path, kind, ts, event_id) to the store.  The trigger's
    interval is the debounce; `stop()` on the query ends it."""

    def run(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            apply_batch(store, root, batch)

    trigger = {"availableNow": True} if available_now else {"processingTime": debounce}
    return watched(events, database).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def changes(root: str, database: str, seen: dict[str, tuple[int, int]]) -> tuple[list[tuple[str, str]], dict[str, tuple[int, int]]]:
    """(path, kind) of what differs from the files `seen` before, and the files now."""
    names, errors = scan.list_tree(root, database)
    now = {}
    for n in names:
        try:
            s = os.stat(f"{root}/{n}")
        except OSError:
            continue
        now[f"{root}/{n}"] = (s.st_mtime_ns, s.st_size)
    found = [(p, "modify" if p in seen else "create") for p, v in now.items() if seen.get(p) != v]
    if not errors:
        found += [(p, "remove") for p in seen if p not in now]
    return found, now


def poll(store: Store, root: str, database: str, debounce: float = 2.0, rounds: int | None = None, wait: Callable[[float], None] = time.sleep) -> int:
    """Watch a local tree by listing it every `debounce` seconds; each round's changes are one
    batch.  Ends on an interrupt, or after `rounds`; the number of batches applied."""
    _, seen = changes(root, database, {})
    applied = done = 0
    try:
        while rounds is None or done < rounds:
            done += 1
            wait(debounce)
            found, seen = changes(root, database, seen)
            if found:
                rows = [(k, datetime.now(timezone.utc), p, kind) for k, (p, kind) in enumerate(found)]
                batch = watched(store.spark.createDataFrame(rows, EVENT), database.rsplit("/", 1)[-1])
                if not batch.isEmpty():
                    apply_batch(store, root, batch)
                    applied += 1
    except KeyboardInterrupt:
        pass
    return applied
