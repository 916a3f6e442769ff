"""Column functions, and their registration for use from SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from lexigrid.functions import text, vectors


def register(spark: SparkSession, encoders: dict | None = None) -> None:
    """Make the scalar functions callable from SQL in this session.

    ``cosine_sim``, ``cosine_distance``, ``dot_product``, ``l2_normalize`` and
    ``strip_accents`` are SQL functions, so Catalyst inlines them.  ``embed(model, text)``,
    ``embed_dim(model)`` and ``token_count(text)`` follow the encoders given.
    """
    from lexigrid.operators import encode

    vectors.register(spark)
    text.register(spark)
    encode.register(spark, encoders)
