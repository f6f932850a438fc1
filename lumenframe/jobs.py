"""Work that another thread can cancel."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextvars import ContextVar
from threading import Event
from typing import TypeVar

from pyspark.sql import SparkSession

from lumenframe.catalog import CatalogError

R = TypeVar("R")
_current: ContextVar[Job | None] = ContextVar("lumenframe_job", default=None)


class Cancelled(CatalogError):
    """The work was cancelled before it ended."""


def check() -> None:
    """Raise ``Cancelled`` inside a cancelled job; every step that writes asks first."""
    job = _current.get()
    if job is not None and job.cancelled:
        raise Cancelled(job.tag)


class Job:
    """One piece of work: Spark jobs that it starts carry its tag, and ``cancel`` from any thread ends them.

    Between Spark jobs it ends at the next step that writes.  What is published
    is published as a whole at the end, so a cancelled job changes nothing.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.tag, self._stop = spark, f"lumenframe-{uuid.uuid4().hex}", Event()

    @property
    def cancelled(self) -> bool:
        return self._stop.is_set()

    def cancel(self) -> None:
        self._stop.set()
        self.spark.sparkContext.cancelJobsWithTag(self.tag)

    def run(self, work: Callable[..., R], *args, **options) -> R:
        token = _current.set(self)
        self.spark.sparkContext.addJobTag(self.tag)
        try:
            check()
            return work(*args, **options)
        except Exception as error:
            if self.cancelled and not isinstance(error, Cancelled):
                raise Cancelled(self.tag) from error
            raise
        finally:
            self.spark.sparkContext.removeJobTag(self.tag)
            _current.reset(token)
