"""Distinct short texts share no bands: registers of small sets are not truncated."""

import numpy as np

from gridmf.llm import neardup
from gridmf.llm.words import seeds


def test_distinct_short_texts_are_not_asked_about():
    regs = []
    for i in range(1000):
        regs.append(neardup.sketch(np.sort(seeds(1 + i % 6, 5000 + i))))  # texts of 1 to 10 words have 1 to 6 shingles
    regs = np.array(regs)
    assert (regs > 0).all()
    keys = neardup.band_keys(regs)
    asked = sum(len(k) - len(np.unique(k)) for k in keys.T)
    assert asked <= 10


def test_bands_of_close_large_sets_still_meet():
    a = seeds(2000, 3)
    ka, kb = (neardup.band_keys(neardup.sketch(np.sort(x))[None]) for x in (a, a[:1900]))
    assert (ka == kb).any()
