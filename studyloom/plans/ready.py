"""Search spaces that come ready: the ranges are fixed values, the rest follows from the data's shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lowered import random_points
from .space import Distribution as D
from .space import SearchSpace


def dense_space(lr: tuple[float, float], hidden: tuple[int, int]) -> SearchSpace:
    return SearchSpace().add("lr", D.log_float(*lr)).add("hidden_size", D.int(*hidden)).add("num_layers", D.int(1, 3)).add("dropout", D.float(0.0, 0.5))


def tabular_space() -> SearchSpace:
    return dense_space((1e-4, 1e-1), (16, 256))


def digits_space() -> SearchSpace:
    """For images of digits; a smaller range of rates, wider layers."""
    return dense_space((1e-4, 1e-2), (32, 256))


def gan_space(features: int, latents: list[int] | None = None) -> SearchSpace:
    """A generator from a latent vector to `features` numbers and a judge of those: their shapes fit whatever is drawn, so only widths, rates
    and the judge's steps are searched. Without latent sizes, as many as there are features."""
    s = SearchSpace().add("latent_dim", D.categorical([str(x) for x in latents or [max(1, features)]]))
    s.add("gen_hidden", D.int(16, 256)).add("disc_hidden", D.int(16, 256))
    return s.add("lr_gen", D.log_float(1e-4, 1e-2)).add("lr_disc", D.log_float(1e-4, 1e-2)).add("disc_steps", D.int(1, 5))


def transformer_space() -> SearchSpace:
    s = SearchSpace().add("n_heads", D.categorical(["1", "2", "4"])).add("head_dim", D.int(8, 32)).add("n_layers", D.int(1, 3))
    return s.add("ff_ratio", D.int(2, 4)).add("lr", D.log_float(1e-4, 1e-2)).add("dropout", D.float(0.0, 0.3))


def model_width(heads: Column, head_dim: Column) -> Column:
    """heads * head_dim, which heads divide whatever is drawn."""
    return heads.cast("bigint") * head_dim


def transformer_points(trials: DataFrame, trial: str, seed: int) -> DataFrame:
    """trials with a point of transformer_space each, and d_model and the feed-forward width that follow from it."""
    drawn = random_points(trials, transformer_space(), trial, seed)
    return drawn.withColumn("d_model", model_width(F.col("n_heads"), F.col("head_dim"))).withColumn("ff_dim", F.col("d_model") * F.col("ff_ratio"))
