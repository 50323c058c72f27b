"""Readers and writers."""

from .parquet import read_parquet
from .text import read_bytes, read_stdin, read_text, write_text

__all__ = ["read_bytes", "read_parquet", "read_stdin", "read_text", "write_text"]
