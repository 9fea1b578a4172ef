"""Prediction, importances and serving use the model that m4_train_evaluate evaluates."""

import pytest
from courtside.operators import models
from courtside.plans import queries

from conftest import SF


@pytest.mark.parametrize("name", ["m4_train_evaluate", "m5_predict", "m7_importances", "m10_predict_match"])
def test_queries_train_the_evaluated_size(spark, monkeypatch, name):
    asked = []

    class Stop(Exception):
        pass

    def seen(df, **options):
        asked.append(options)
        raise Stop

    monkeypatch.setattr(models, "train", seen)
    with pytest.raises(Stop):
        queries.queries()[name](spark, SF)
    assert asked == [{}]  # the operator's own size, in all four
