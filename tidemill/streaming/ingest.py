"""Streams into tables, exactly once, and the transfer of tables between folders."""

from __future__ import annotations

import threading
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tidemill.plans.ingest import CHUNK_POINTS

if TYPE_CHECKING:
    from tidemill.engine import DataFolder


def start(stream: DataFrame, folder: DataFolder, table: str, checkpoint: str, every: str | None = None, name: str | None = None, hold: int = 0, least: int = CHUNK_POINTS) -> StreamingQuery:
    """Write a stream's rows to a table, a commit for each micro-batch.

    The commit names the batch: the stream (by `name`, or its checkpoint) and its number. A batch that is run again
    after a failure is not written again. Rows of a batch are sorted by series and time; late rows make segments of
    their own. Without `every` (a duration) what is there is written and the query ends.

    With `hold`, batches of a time series table are kept as they come, and once that many rows have come, series with
    at least `least` of them are compressed; so the number of segments doesn't depend on that of batches. Rows that
    wait are as safe as others, but queries see them only when they are compressed; `DataFolder.flush` does that for
    the rest. `hold` counts from what a flush has left, so that is read again only when as many rows have come.
    """
    label = name or checkpoint
    left = folder.held(table) if hold else 0

    def write(batch: DataFrame, number: int) -> None:
        nonlocal left
        if not hold:
            folder.write(table, batch, [f"{label}:{number}"])
            return
        folder.hold(table, batch, [f"{label}:{number}"])
        if folder.held(table) - left >= hold:
            folder.flush(table, least)
            left = folder.held(table)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def transfer(source: DataFolder, target: DataFolder, table: str, least_bytes: int = 0) -> bool:
    """Move a table's rows to the table of that name in another folder if its data has at least so many bytes.

    The target's commit names those of the source, so a transfer that failed before the source was cut down can be
    run again.
    """
    if source._log(source.table(table).name).size() < max(least_bytes, 1):
        return False
    source.move(table, target, table)
    return True


class Transfer:
    """Transfers of a table by time and by size: each `seconds`, if it has at least `least_bytes`, until `stop`.

    An error ends it and is raised by `stop`.
    """

    def __init__(self, source: DataFolder, target: DataFolder, table: str, seconds: float, least_bytes: int = 0) -> None:
        self._done = threading.Event()
        self._error: BaseException | None = None
        self.moved = 0

        def run() -> None:
            try:
                while not self._done.wait(seconds):
                    self.moved += transfer(source, target, table, least_bytes)
            except BaseException as error:
                self._error = error

        self._thread = threading.Thread(target=run, daemon=True)
        self._thread.start()

    def stop(self) -> None:
        self._done.set()
        self._thread.join()
        if self._error is not None:
            raise self._error
