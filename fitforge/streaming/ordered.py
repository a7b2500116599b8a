"""Folds in order of time, over a table or over a stream whose rows come in any order.

A stream's rows wait in the state of their key until the watermark has passed them; a
timer then folds those that are due, in order of time, and their results go out.  So
micro-batches may cut and mix rows as they like: every row that is no later than the
watermark allows gets the result that a batch over all of them gives.  Later rows are
dropped by Spark and have no part in any result.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fitforge.streaming.folds import Fold

#: Microseconds of a row's time, whatever the session's time zone.
_AT = "at_micros"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _schema(events: DataFrame, results: str) -> T.StructType:
    return T.StructType([*events.schema.fields, *T.StructType.fromDDL(results).fields])


def _folded(fold: Fold, memo: dict, rows: list[dict]) -> tuple[dict, list[tuple]]:
    """Fold ``rows`` moment by moment; the new memo, and the rows with their results."""
    out = []
    for now, moment in groupby(sorted(rows, key=lambda r: r[_AT]), key=lambda r: r[_AT]):
        same = list(moment)
        memo, results = fold(memo, now, same)
        out += [(*r.values(), *x) for r, x in zip(same, results, strict=True)]
    return memo, out


def _framed(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=columns, dtype=object)


def _plain(found: pd.DataFrame, schema: T.StructType) -> list[dict]:
    """Rows of a frame with None for missing values, plain timestamps, and whole numbers where pandas holds floats beside missing ones."""
    whole = {f.name for f in schema if isinstance(f.dataType, T.IntegralType)}

    def value(name: str, x):
        if isinstance(x, pd.Timestamp):
            return x.to_pydatetime()
        return int(x) if name in whole and x is not None else x

    rows = found[schema.names].astype(object).where(found[schema.names].notna(), None).itertuples(index=False, name=None)
    return [{c: value(c, x) for c, x in zip(schema.names, r, strict=True)} for r in rows]


def in_order(events: DataFrame, key: str, ts: str, fold: tuple[Fold, str], late: str = "10 minutes") -> DataFrame:
    """``events`` with the results of a fold (:mod:`fitforge.streaming.folds`) over each key's rows in order of ``ts``.

    Of a stream the rows may be ``late`` behind the latest seen; rows with no key or time
    are left out of both.  A batch holds one key's rows in a task, a stream only those
    that wait and the memo.
    """
    step, results = fold
    rows = events.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).withColumn(ts, F.col(ts).cast("timestamp")).withColumn(_AT, F.unix_micros(ts))
    schema, given = _schema(rows, results), rows.schema
    if not events.isStreaming:

        def of_key(found: pd.DataFrame) -> pd.DataFrame:
            return _framed(_folded(step, {}, _plain(found, given))[1], schema.names)

        return rows.groupBy(key).applyInPandas(of_key, schema).drop(_AT)
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)  # the only one that keeps such state
    waiting = _Waiting(step, given, schema.names)
    return rows.withWatermark(ts, late).groupBy(key).transformWithStateInPandas(waiting, outputStructType=schema, outputMode="Append", timeMode="EventTime").drop(_AT)


class _Waiting(StatefulProcessor):
    """Holds a key's rows until they are due."""

    def __init__(self, fold: Fold, schema: T.StructType, names: list[str]):
        self.fold, self.schema, self.names = fold, schema, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.schema)
        self.memo = handle.getValueState("memo", "memo string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for found in rows:
            given = _plain(found, self.schema)
            self.waiting.appendList([tuple(r.values()) for r in given])
            for at in {r[_AT] // 1000 for r in given}:
                self.handle.registerTimer(at)
        yield _framed([], self.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        rows = [dict(zip(self.schema.names, r, strict=True)) for r in self.waiting.get()]
        due = [r for r in rows if r[_AT] // 1000 <= passed]
        out = []
        if due:
            memo = json.loads(self.memo.get()[0]) if self.memo.exists() else {}
            memo, out = _folded(self.fold, memo, due)
            self.memo.update((json.dumps(memo),))
            left = [tuple(r.values()) for r in rows if r[_AT] // 1000 > passed]
            if left:
                self.waiting.put(left)
            else:
                self.waiting.clear()
        yield _framed(out, self.names)

    def close(self) -> None:
        pass
