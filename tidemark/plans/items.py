"""The item study that several queries share: complete rows, stored once, with all quantiles and moments.

Scalings are affine and clipping bounds come from the quartiles, so fences, both scalings, all fits and all scores follow from
one call for the quantiles and one aggregation for the moments of the clipped rows by split flag.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import models as M
from ..operators import scale as SC
from ..operators import stats as ST
from ..session import cut_lineage
from . import sqlkit as Q

GRID_FEATS = Q.RATE_NAMES + ["Gasoline"]
KEY = ["l_orderkey", "l_linenumber"]
_LEVELS = [0.0, 0.25, 0.5, 0.75, 1.0]


@dataclass
class ItemStudy:
    rows: DataFrame            # key, features, clipped price, is_test
    quartiles: dict            # variable -> row with n, q0, q25, q50, q75, q100 (price: not clipped)
    lower: float
    upper: float
    train: M.Gram
    test: M.Gram

    @property
    def every(self) -> M.Gram:
        return M.pooled([self.train, self.test])


def prepare(spark, sf_dir) -> ItemStudy:
    """Complete rows, stored once; one call for all quantiles, one aggregation for all moments."""
    from .q_facts import merged_all
    d = M.complete_rows(merged_all(spark, sf_dir), [*GRID_FEATS, "price"]).select(*KEY, *GRID_FEATS, F.col("price").cast("double").alias("price"))
    d = cut_lineage(M.with_split_hash(d, KEY, 42))
    q = {r["variable"]: r for r in ST.quantiles(d, [*GRID_FEATS, "price"], _LEVELS).collect()}
    reach = 1.5 * (q["price"]["q75"] - q["price"]["q25"])
    lower, upper = q["price"]["q25"] - reach, q["price"]["q75"] + reach
    d = M.train_test_split(ST.clip(d, "price", lower, upper), KEY, 0.2, 42, n_rows=int(q["price"]["n"]))
    g = M.gram_by(d, GRID_FEATS, "price", "is_test")
    return ItemStudy(d, q, lower, upper, g[False], g[True])


def scalings(s: ItemStudy) -> list[tuple[str, SC.Scaling]]:
    g = s.every
    sd = np.sqrt(np.diag(g.Sxx) / g.n)
    standard = SC.Scaling("standard", dict(zip(GRID_FEATS, g.xbar.tolist())), dict(zip(GRID_FEATS, np.where(sd > 0, sd, 1.0).tolist())))
    return [("standard", standard), ("robust", SC.fit_robust(s.rows, GRID_FEATS, quartiles=s.quartiles))]


def grid(s: ItemStudy) -> list[tuple[str, SC.Scaling, M.LinearFit, float, float]]:
    """(label, scaling, fit, test MSE, test R²) of the six models."""
    out = []
    for label, sc in scalings(s):
        g, t = (M.rescaled(x, sc.center, sc.scale) for x in (s.train, s.test))
        for fit in (M.ols(None, g.xs, "price", g), M.ridge(None, g.xs, "price", 1.0, g), M.lasso(None, g.xs, "price", 0.1, g)):
            out.append((f"{fit.model}_{label}", sc, fit, *M.gram_scores(fit, t)))
    return out
