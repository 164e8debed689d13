"""Stand-in inputs derived from the driver's tables.

Model scores are not in the driver's data, so evaluation operators are
checked on deterministic stand-in scores computed from ``listings``:
label = purchase event, probability = price / (price + c) for two models.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import views as V

# Stand-in model names and their offsets c.
STANDIN_MODELS = [("m1", 10.0), ("m2", 25.0)]


def _split_expr(user_id):
    m = user_id % 5
    return F.when(m < 3, "train").when(m == 3, "validation").otherwise("test")


def scores_standin(spark: SparkSession, sf_dir: str) -> DataFrame:
    ls = V.listings(spark, sf_dir)
    models = F.array(*[F.struct(F.lit(n).alias("model"), F.lit(c).alias("c")) for n, c in STANDIN_MODELS])
    s = ls.select("entity", "event_id", "listing_time", "days_until_event",
                  (F.col("zone") == "purchase").cast("int").alias("label"),
                  _split_expr(F.col("entity").cast("bigint")).alias("split"),
                  "price", F.explode(models).alias("m"))
    prob = F.col("price") / (F.col("price") + F.col("m.c"))
    return s.select("entity", "event_id", "listing_time", "days_until_event", "label",
                    F.col("m.model").alias("model"), "split", prob.alias("probability"),
                    (prob >= 0.5).cast("int").alias("prediction"))


DUCK_SCORES = """
SELECT l.entity, l.event_id, l.listing_time, l.days_until_event,
       CAST(l.zone = 'purchase' AS INTEGER) AS label, m.model,
       CASE WHEN CAST(l.entity AS BIGINT) % 5 < 3 THEN 'train'
            WHEN CAST(l.entity AS BIGINT) % 5 = 3 THEN 'validation' ELSE 'test' END AS split,
       l.price / (l.price + m.c) AS probability,
       CAST(l.price / (l.price + m.c) >= 0.5 AS INTEGER) AS prediction
FROM listings l CROSS JOIN (VALUES ('m1', 10.0::DOUBLE), ('m2', 25.0::DOUBLE)) AS m(model, c)
"""
