"""Progress of an indexing run: how many files are done, said about every ten files.

Files are dealt to partitions of ten, and a thread asks Spark's status tracker how many of the job's tasks have ended; tasks report no sooner. Large projects have larger
partitions, so that there are no more than ``MOST_PARTITIONS``.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import DataFrame

#: Fixed value: files between two reports.
EVERY = 10
MOST_PARTITIONS = 10_000

#: status, current and total.
Report = Callable[[str, int, int], None]


def in_steps(files: DataFrame, total: int, every: int = EVERY) -> tuple[DataFrame, int]:
    """``files`` in partitions of about ``every`` files, and how many there are."""
    parts = max(1, min(MOST_PARTITIONS, -(-total // every)))
    return files.repartition(parts), parts


@contextmanager
def reported(files: DataFrame, total: int, parts: int, report: Report | None, wait: float = 0.2):
    """Reports while the work on ``files`` in the block goes on: when it begins, when files are done, and at the end."""
    if report is None or not total:
        yield
        return
    context, group, done = files.sparkSession.sparkContext, f"indexing-{uuid4().hex}", threading.Event()
    report("indexing_files", 0, total)
    context.setJobGroup(group, "indexing")
    said = 0

    def watch() -> None:
        nonlocal said
        tracker = context.statusTracker()
        while not done.wait(wait):
            stages = [s for j in tracker.getJobIdsForGroup(group) if (job := tracker.getJobInfo(j)) for s in job.stageIds]
            # The stage of the parser is the one with a task for each part.
            ended = max((i.numCompletedTasks for s in stages if (i := tracker.getStageInfo(s)) and i.numTasks == parts), default=0)
            current = min(total, ended * total // parts)
            if said < current < total:
                said = current
                report("indexing_files", current, total)

    thread = threading.Thread(target=watch, daemon=True)
    thread.start()
    try:
        yield
    finally:
        done.set()
        thread.join()
        context.setLocalProperty("spark.jobGroup.id", None)
    report("indexing_complete", total, total)
