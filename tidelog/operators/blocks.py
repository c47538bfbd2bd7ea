"""Packing of sorted entries into blocks, with shared prefixes between restarts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

from tidelog import defaults
from tidelog.functions.bytesx import common_prefix

HEADER = 21  # three lengths of 4 bytes, a sequence number of 8 and a byte of flags
OUT = "run long, block long, entries long, first_key string, last_key string, estimated_bytes long"


def pack_blocks(target: int = defaults.BLOCK_TARGET, restart: int = defaults.RESTART_EVERY):
    """A function over one run's rows in key order: a block is sealed once its estimated size passes ``target``."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, out, size, first, last, n = pdf.sort_values("key"), [], 0, None, b"", 0
        number = int(pdf["run"].iloc[0])

        def seal():
            out.append((number, len(out), n, first, last.decode(), size + 4 * (-(-n // restart)) + 4))

        for key, value in zip(rows["key"], rows["value"], strict=True):
            raw = key.encode()
            shared = 0 if n % restart == 0 else common_prefix(last, raw)
            size += HEADER + len(raw) - shared + len((value or "").encode())
            first = key if n == 0 else first
            last, n = raw, n + 1
            if size > target:
                seal()
                size, n, first, last = 0, 0, None, b""
        if n:
            seal()
        return pd.DataFrame(out, columns=["run", "block", "entries", "first_key", "last_key", "estimated_bytes"])

    return run


def blocks(rows: DataFrame, target: int = defaults.BLOCK_TARGET) -> DataFrame:
    """Blocks of each run; runs are bounded by how they are cut, so one fits a task."""
    return rows.select("run", "key", "value").groupBy("run").applyInPandas(pack_blocks(target), OUT)
