"""References between the stored tables, and what they miss."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Relation -> (table, its columns, referenced table, its columns).
RELATIONS = {
    "job_source": ("jobs", ("source",), "sources", ("name",)),
    "prediction_model": ("predictions", ("symbol", "model"), "models", ("symbol", "model")),
    "prediction_bar": ("predictions", ("symbol", "target_date"), "bars", ("symbol", "date")),
    "metric_model": ("metrics", ("symbol", "model"), "models", ("symbol", "model")),
}


def referenced(tables: Mapping[str, DataFrame], relation: str) -> DataFrame:
    """Rows of the relation's table with `is_known`: whether what they refer to exists. A null key refers to nothing and is not known."""
    child, keys, parent, names = RELATIONS[relation]
    known = tables[parent].select(*[F.col(n).alias(f"_{i}") for i, n in enumerate(names)]).distinct().withColumn("_known", F.lit(True))
    meets = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_{i}") for i, k in enumerate(keys)])
    rows = tables[child].join(known, meets, "left")
    return rows.withColumn("is_known", F.coalesce("_known", F.lit(False))).drop("_known", *[f"_{i}" for i in range(len(keys))])


def reference_report(tables: Mapping[str, DataFrame]) -> DataFrame:
    """relation, symbol, rows, known, orphans of every relation; symbol is that of the referring rows."""
    parts = [
        referenced(tables, relation).groupBy(F.lit(relation).alias("relation"), "symbol").agg(
            F.count("*").alias("rows"), F.count_if("is_known").alias("known"), F.count_if(~F.col("is_known")).alias("orphans"))
        for relation in RELATIONS
    ]
    return reduce(DataFrame.unionByName, parts)
