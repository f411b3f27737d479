"""The models of op1 are fitted away from the driver, whose memory is the tighter one."""

import os
import random

import numpy as np

from lodestrand.llm import language_id as L
from tests.llm.conftest import frame
from tests.llm.test_language_id import SYLLABLES, text


def test_the_driver_fits_nothing(spark, monkeypatch):
    rng = random.Random(6)
    docs = frame(spark, [(i, text(rng, la, 30), la, la) for i, la in enumerate(list(SYLLABLES) * 20)])
    plain = L.train(docs)
    driver, fit = os.getpid(), L._fit

    def elsewhere(sample):
        assert os.getpid() != driver
        return fit(sample)

    monkeypatch.setattr(L, "_fit", elsewhere)
    model = L.train(docs)
    assert model.languages == sorted(SYLLABLES) and model.duels == plain.duels and len(model.duels) > 2
    assert np.array_equal(model.weights, plain.weights) and np.abs(model.weights).max(axis=0).min() > 0
    assert np.array_equal(model.bias, plain.bias) and np.array_equal(model.slope, plain.slope)
