"""Bounded labelled samples to fit a classifier on; everything else that operators do covers all rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._exchange import free, stored

_BINS = 1 << 20


def labelled_ids(labels: DataFrame, *, key: str, label: str, usable: Column, per_class: int) -> DataFrame:
    """(__id, __label, __weight) of about per_class ids of each label, by a hash of the id. Weights
    restore the classes' shares. An id with two labels is left out."""
    one = labels.filter(usable & F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("__id")).agg(F.min(label).alias("__label"), F.max(label).alias("__other")).filter("__label = __other").drop("__other")
    sizes = {r[0]: r[1] for r in one.groupBy("__label").count().collect()}
    share, weight = F.lit(0), F.lit(0.0)
    for value, n in sizes.items():
        share = F.when(F.col("__label") == value, int(min(1.0, per_class / n) * _BINS)).otherwise(share)
        weight = F.when(F.col("__label") == value, max(1.0, n / per_class)).otherwise(weight)
    return one.filter(F.pmod(F.xxhash64("__id", F.lit(7)), F.lit(_BINS)) < share).withColumn("__weight", weight)


def labelled_texts(docs: DataFrame, ids: DataFrame, *, key: str, text: str, most_bytes: int, total_bytes: int) -> tuple[pa.ChunkedArray, np.ndarray, np.ndarray]:
    """The sample's texts with their labels and weights, in order of id. An id has one text, the one with the
    least hash; texts over most_bytes are left out, and of a class those that come, by hash of the id, after its
    share of total_bytes. ids is a bounded sample, so it is broadcast and the texts of other rows are never moved."""
    rows = docs.filter(F.octet_length(text) <= most_bytes).select(F.col(key).alias("__id"), F.col(text).alias("__text"))
    one = rows.join(F.broadcast(ids), "__id").groupBy("__id", "__label", "__weight").agg(F.min(F.struct(F.xxhash64("__text").alias("h"), "__text")).alias("t"))
    kept = stored(one.select("__id", "__label", "__weight", "t.__text", F.octet_length("t.__text").alias("__size"), F.xxhash64("__id", F.lit(7)).alias("__order")))
    sizes = kept.select("__id", "__label", "__size", "__order").toPandas().sort_values(["__order", "__id"])
    before = sizes.groupby("__label")["__size"].cumsum() - sizes["__size"]
    late = sizes[before >= total_bytes / max(1, sizes["__label"].nunique())]
    got = kept.drop("__size", "__order")
    if len(late):  # the order in which texts are late is that of the hash, so one limit a class tells them
        limit = late.groupby("__label")["__order"].min()
        late_of = F.lit(False)
        for label, first in limit.items():
            late_of = late_of | ((F.col("__label") == int(label)) & (F.col("__order") >= int(first)))
        got = kept.filter(~late_of).drop("__size", "__order")
    got = got.toArrow().sort_by([("__id", "ascending")])
    free(kept)
    return got["__text"], got["__label"].to_numpy().astype(np.int64), got["__weight"].to_numpy()
