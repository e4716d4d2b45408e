"""Models of the caller's own, fitted and asked key by key; a key that fails is a row, not the end of the job."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: fit(train) gives a model; predict(model, target) a frame with the promised columns, one row for each target row.
Fit = Callable[[pd.DataFrame], Any]
Predict = Callable[[Any, pd.DataFrame], pd.DataFrame]
#: Characters of an error that are kept.
MESSAGE = 500


def run_keyed(rows: DataFrame, key: str, fit: Fit, predict: Predict, out: str, done: DataFrame | None = None) -> DataFrame:
    """(key, status, error, the columns of `out`): the predictions of each key's model for its rows with part 'target', fitted to those with part 'train'.

    status is 'ok'; 'failed' with the error (one row, the columns of `out` are NULL) where fit or predict raises or breaks its promise;
    'empty' where a key has no training or no target rows. Keys of `done` (key, status 'ok' or 'empty') are left out, so a run that was cut short or
    had failures goes on from there. A key's rows are one task's: keys are sized to fit."""
    promised = T.StructType.fromDDL(out)
    schema = T.StructType([T.StructField(key, rows.schema[key].dataType), T.StructField("status", T.StringType()), T.StructField("error", T.StringType()), *promised.fields])
    names = promised.fieldNames()

    def note(value: Any, status: str, error: str | None) -> pd.DataFrame:
        return pd.DataFrame([[value, status, error, *[None] * len(names)]], columns=[key, "status", "error", *names])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        value = pdf[key].iloc[0]
        train, target = (pdf[pdf["part"] == p].drop(columns="part").reset_index(drop=True) for p in ("train", "target"))
        if not len(train) or not len(target):
            return note(value, "empty", None)
        try:
            got = predict(fit(train), target)
            if not isinstance(got, pd.DataFrame) or set(names) - set(got.columns) or len(got) != len(target):
                raise TypeError(f"predict gives one row for each target row with the columns {names}")
            made = got[names].reset_index(drop=True)
            for f in promised.fields:  # a value of another kind is this key's failure too
                if isinstance(f.dataType, T.NumericType):
                    made[f.name] = pd.to_numeric(made[f.name])
                    if isinstance(f.dataType, T.IntegralType):
                        made[f.name] = made[f.name].astype("int64")
            made.insert(0, "error", None)
            made.insert(0, "status", "ok")
            made.insert(0, key, value)
            return made
        except Exception as e:  # any error of the caller's code is a result of this key
            return note(value, "failed", f"{type(e).__name__}: {e}"[:MESSAGE])

    todo = rows if done is None else rows.join(done.where(F.col("status").isin("ok", "empty")).select(key), key, "left_anti")
    return todo.groupBy(key).applyInPandas(one, schema)
