"""Cost of model calls from their token counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Default price per million tokens (input, output) per provider.
DEFAULT_PRICES = {"bedrock": (3.0, 15.0), "openai": (1.0, 3.0)}


def model_costs(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """usage(provider, model, input_tokens, output_tokens) with its price, or the
    default of the provider for a model that has none."""
    def default(index: int):
        chain = F.lit(None).cast("double")
        for provider, pair in DEFAULT_PRICES.items():
            chain = F.when(F.col("provider") == provider, F.lit(pair[index])).otherwise(chain)
        return chain

    priced = usage.join(prices, ["provider", "model"], "left")
    rate_in = F.coalesce("input_price", default(0))
    rate_out = F.coalesce("output_price", default(1))
    cost = F.col("input_tokens") / F.lit(1e6) * rate_in + F.col("output_tokens") / F.lit(1e6) * rate_out
    return priced.withColumn("cost", cost)
