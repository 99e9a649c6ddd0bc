"""Feature fit/transform: scoring uses training statistics; refit without a target gives constant rates."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from outcome_engine.operators import features as FE
from outcome_engine.plans.catalog import ventures


def test_fit_transform_and_refit(spark):
    v = ventures(spark, SF_SMALL)
    train = FE.with_target(v)
    model = FE.fit_features(train)
    op = v.where(F.col("status") == "operating")
    scored = model.transform(op)
    assert scored.count() == op.count()
    assert scored.where(F.col("category_success_rate").isNull()).count() == 0
    refit, m2 = FE.build_features(op.drop("target") if "target" in op.columns else op, refit=True)
    assert not m2.has_target
    rates = {r[0] for r in refit.select("category_success_rate").distinct().collect()}
    assert rates == {0.1}
