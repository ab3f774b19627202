"""What a Python worker keeps between tasks, and what it gives back.

Workers live on from stage to stage, beside a JVM that has grown to its full heap. So a
worker keeps the tables of one operator at a time, and hands freed memory back to the
machine after each batch, where allocators would hold on to it.
"""

import contextlib
import ctypes
import gc

import pyarrow as pa

_HELD = {}


def held(key, make):
    """What `make` gives, once for all tasks of this process that ask for this key one after the other."""
    if key not in _HELD:
        _HELD.clear()
        give_back()
        _HELD[key] = make()
        give_back()
    return _HELD[key]


def give_back():
    """Return freed memory to the machine, as far as its allocators know how to."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def begin(keep):
    if not keep and _HELD:
        _HELD.clear()
        gc.collect()
    give_back()


def returning(batches):
    for batch in batches:
        yield batch
        del batch
        give_back()


def lean(run, keep=False):
    """A function for mapInArrow that gives memory back after each batch; unless it keeps something itself, what others kept goes first."""

    def each(batches):
        begin(keep)
        yield from run(returning(batches))

    return each
