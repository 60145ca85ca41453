"""The count model: Poisson boosting, with every fold fitted in the same passes (see ``learner``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.functions.ids import fold_of
from kerbline.models.learner import Ensemble, fit


class PoissonModel(Ensemble):
    def predict(self, df: DataFrame, out: str = "score") -> DataFrame:
        """Expected count; needs the model's inputs, or ``features`` if it was fitted on vectors."""
        return df.withColumn(out, F.exp(self.raw(df)))

    @classmethod
    def of(cls, m: Ensemble) -> PoissonModel:
        return cls(**vars(m))


def fit_poisson_gbt(df: DataFrame, label: str = "ksi_target", inputs: list[str] | None = None, **how) -> PoissonModel:
    """``df`` has a count and ``inputs``, or the vector ``features``; ``how`` as in ``learner.fit``."""
    keyed = df.withColumn("_row", F.monotonically_increasing_id())
    return PoissonModel.of(fit(keyed, "_row", label, inputs, [F.lit(True)], **how).models[0])


def out_of_fold(
    df: DataFrame, key: str, k: int = 5, label: str = "ksi_target", out: str = "score", inputs: list[str] | None = None, known: Column | None = None, **how
) -> tuple[DataFrame, list[PoissonModel]]:
    """``key, fold`` and the score of every row by a model that never saw its fold; folds are whole segments.

    ``known``: the rows to fit on; the others are only scored. The ``k`` models grow side by side.
    """
    fold, known = fold_of(key, k), F.lit(True) if known is None else F.coalesce(known, F.lit(False))
    f = fit(df, key, label, inputs, [known & (fold != i) for i in range(k)], **how)
    scored = f.scores.withColumnRenamed("key", key).withColumn("fold", fold)
    return scored.select(key, "fold", F.exp(F.get("raw", F.col("fold"))).alias(out)), [PoissonModel.of(m) for m in f.models]


def dispersion_check(df: DataFrame, label: str, score: str) -> DataFrame:
    """Sum of target and of score: a fitted count model should match in total."""
    return df.agg(F.sum(F.col(label).cast("double")).alias("observed"), F.sum(score).alias("expected"), F.count(F.lit(1)).alias("segments"))
