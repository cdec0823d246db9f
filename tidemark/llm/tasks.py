"""Functions of Arrow data that leave no memory behind in the Python worker, which Spark keeps for the tasks of later stages."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa


def release() -> None:
    """Give freed memory back to the system, for the JVM beside this worker."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def of_batches(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """For mapInArrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            release()

    return run


def of_group(function: Callable[[pa.Table], pa.Table]):
    """For applyInArrow of a group."""

    def run(table: pa.Table) -> pa.Table:
        try:
            return function(table)
        finally:
            release()

    return run


def of_groups(function: Callable[[pa.Table, pa.Table], pa.Table]):
    """For applyInArrow of two groups with one key."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return function(left, right)
        finally:
            release()

    return run
