"""Memory of Python workers, which Spark keeps for later tasks."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

#: Rows of an Arrow batch of texts: some MB.
TEXT_ROWS = 1000


#: Bytes from which an array gets pages of its own, which go back when it is freed. glibc raises this up to 32 MB as arrays are
#: freed, after which they stay in the heap's holes; a fixed number keeps it. Pools of threads, of which each keeps its own.
OWN_PAGES, POOLS = 1 << 20, 1


@functools.cache
def keep_little() -> None:
    """Makes this process's allocator return large arrays at once, for as long as it lives."""
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, OWN_PAGES)  # M_MMAP_THRESHOLD
        libc.mallopt(-8, POOLS)  # M_ARENA_MAX
    except (OSError, AttributeError):  # another C library
        pass


def give_back() -> None:
    """Returns what is free in this process's pools to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function for mapInArrow that gives memory back at the end of its task."""

    @functools.wraps(f)
    def run(batches: Iterator) -> Iterator:
        keep_little()
        give_back()  # what the task before held until its end
        try:
            yield from f(batches)
        finally:
            give_back()

    return run


def text_batches(spark: SparkSession) -> None:
    """Lowers the session's limit of rows in an Arrow batch for long texts; a lower one stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= TEXT_ROWS:
        spark.conf.set(key, str(TEXT_ROWS))
