"""Intermediate tables in the folder that all executors share."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from seasonlens.sources.tables import new_path


#: Rows of one Arrow batch where rows carry whole texts; Spark's own 10,000 would be tens of MB several times over.
BATCH_ROWS = 1000


def map_texts(rows: DataFrame, function, schema) -> DataFrame:
    """mapInArrow over rows that carry texts, in batches that stay small.  The limit is a setting of the session,
    lowered once and never raised."""
    conf, key = rows.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(conf.get(key))
    if not 0 < now <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return rows.mapInArrow(function, schema)


def stored(df: DataFrame, name: str, **options) -> DataFrame:
    """Written as Parquet and read again: cuts the lineage, survives lost executors, and shows its true size."""
    path = new_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _aside(name: str, taken: set[str]) -> str:
    name = f"{name}_in"
    return name if name.lower() not in taken else _aside(name, taken)


def set_aside(df: DataFrame, names) -> DataFrame:
    """Renames the columns that an operator's own names would hide (names are not case-sensitive): x becomes x_in."""
    taken, names = {c.lower() for c in df.columns}, {n.lower() for n in names}
    return df.withColumnsRenamed({c: _aside(c, taken) for c in df.columns if c.lower() in names})


def given(before: DataFrame, names) -> list[Column]:
    """The columns of ``before`` under their own names, from what an operator made of ``set_aside(before, names)``."""
    return [F.col(new).alias(old) for old, new in zip(before.columns, set_aside(before, names).columns)]
