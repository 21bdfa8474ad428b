"""Texts as bytes: the white space that the operators agree on is [\\x20\\x09-\\x0D], which is what bytes.split() takes."""

from __future__ import annotations

import ctypes
import sys

import pyarrow as pa
import pyarrow.compute as pc

SPACES = frozenset(b" \t\n\x0b\x0c\r")


def squeeze(raw: bytes) -> bytes:
    """Each run of white space as one space; leading and trailing runs stay, as one space each."""
    body = b" ".join(raw.split())
    if not body:
        return b" " if raw else b""
    return (b" " if raw[0] in SPACES else b"") + body + (b" " if raw[-1] in SPACES else b"")


def as_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null counts as empty."""
    return pc.fill_null(column, "").cast(pa.large_binary()).to_pylist()


def trim() -> None:
    """Gives memory that a kernel is done with back to the machine; Python workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)
