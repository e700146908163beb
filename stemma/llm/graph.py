"""Connected components of links between long ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame) -> DataFrame:
    """links(x, y) -> (id, class_id): the least id of the component, for each id that has a link.

    Each round takes the least label among neighbours (partial sums first, so a hub costs one row per task) and then
    the label's own label, which halves path lengths. Labels are written each round; nothing comes to the driver
    but the count of changes.
    """
    both = written(links.select("x", "y").unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y"))).where("x <> y").distinct(), "links")
    labels = written(both.groupBy(F.col("x").alias("id")).agg(F.min("y").alias("near")).select("id", F.least("near", "id").alias("class_id")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "y"), "y").groupBy(F.col("x").alias("id")).agg(F.min("class_id").alias("near"))
        step = labels.join(near, "id").select("id", F.col("class_id").alias("was"), F.least("class_id", "near").alias("class_id"))
        jump = step.join(labels.select(F.col("id").alias("class_id"), F.col("class_id").alias("far")), "class_id")
        now = written(jump.select("id", "was", F.least("class_id", "far").alias("class_id")), "labels")
        labels = now.select("id", "class_id")
        if not now.where(F.col("was") != F.col("class_id")).limit(1).count():
            return labels
