"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import ship

#: Marks that only vocalise a text, and characters without a shape of their own.
VOWEL_MARKS = "\u064b-\u0652\u0670"
INVISIBLE = "\u00ad\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u206f\ufeff"
_DROP = re.compile(f"[{VOWEL_MARKS}{INVISIBLE}]+")
_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Runs of letters and digits after NFKC, without case, vowel marks and invisible characters."""
    text = unicodedata.normalize("NFKC", text).lower()
    return _WORD.findall(_DROP.sub("", text))


def host(url: Column) -> Column:
    """What stands between `//` and the next `/`; null without an address."""
    found = F.regexp_extract(url, "//([^/]*)", 1)
    return F.when(found != "", found)


def schema_of(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def map_batches(df: DataFrame, make: Callable[[], Callable], ddl: str, rows: int = 1000) -> DataFrame:
    """Arrow batches through `make()`, called once a task; its result takes a list of columns and gives one.

    Batches are cut to `rows` rows, so that very long texts never fill a worker's memory.
    """
    ship(df.sparkSession)
    schema = schema_of(ddl)
    target = to_arrow_schema(schema)

    def run(batches):
        step = make()
        for batch in batches:
            for low in range(0, batch.num_rows, rows):
                columns = step(batch.slice(low, rows))
                if columns is not None and len(columns[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type, from_pandas=True) for c, f in zip(columns, target)], schema=target)

    return df.mapInArrow(run, schema)
