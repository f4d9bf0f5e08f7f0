"""A bounded, balanced sample of labelled texts, for fitting classifiers."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out


@dataclass
class Sample:
    """Texts with 0/1 labels, and how common label 1 is among all rows to learn from."""

    texts: list[str]
    labels: np.ndarray
    rate: float

    @property
    def shift(self) -> float:
        """What a logistic model fitted on the sample adds to its logit to meet ``rate``."""
        ones, rate = min(max(self.labels.mean(), 1e-6), 1 - 1e-6), min(max(self.rate, 1e-6), 1 - 1e-6)
        return float(np.log(rate / (1 - rate)) - np.log(ones / (1 - ones)))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, *, id_col: str = "doc_id", text_col: str = "text") -> Sample:
    """At most ``per_class`` texts of each label, the least by a hash of the id, outside the
    held-out fold. Rows with a null id, label or text teach nothing. Of rows with the same id the
    least text is taken, of equal labels of an id one. Only these rows come to the driver, and
    only their ids are broadcast."""
    rows = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(label).cast("int").alias("_label")).where(F.col("_id").isNotNull() & F.col("_label").isin(0, 1) & ~held_out("_id")).distinct()
    sizes = {r["_label"]: r["count"] for r in rows.groupBy("_label").count().collect()}
    picked = None
    for value in sorted(sizes):
        least = rows.where(F.col("_label") == value).orderBy(F.xxhash64("_id"), "_id").limit(per_class)
        picked = least if picked is None else picked.unionByName(least)
    if picked is None:
        return Sample([], np.zeros(0, dtype=np.int64), 0.5)
    own = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text")).where("_text IS NOT NULL")
    # At most 2 x per_class rows of two numbers.
    found = own.join(F.broadcast(picked), "_id").groupBy("_id", "_label").agg(F.min("_text").alias("_text")).toPandas().sort_values(["_id", "_text", "_label"])
    return Sample(found["_text"].tolist(), found["_label"].to_numpy(dtype=np.int64), sizes.get(1, 0) / max(1, sum(sizes.values())))
