"""Toxic terms that marks join to other words."""

import numpy as np
import pytest

from paperloom.llm import toxicity

TERMS = [("idiot", False, 3.0), ("clown", False, 2.0), ("abc", False, 1.0), ("lowei", True, 1.5)]
ZERO = np.zeros(toxicity.FEATURES)


@pytest.mark.parametrize("text", ["idiot,clown", "you/idiot", "idiot-like", "idiot_clown", "\u2014abc\u2026", "\u00bfabc?", "x" * 50 + ",idiot", "loweif" + "x" * 60])
def test_joined_terms_are_exact_hits(text):
    x = toxicity.Scorer(TERMS, ZERO).features(text)
    assert x[7] == 1 and x[3] == 0 and x[1] + x[2] > 0


def test_a_text_without_blanks_has_the_hits_of_one_with_blanks():
    words = ["mor", "tal", "idiot", "vin", "clown", "gru"] * 20
    a, b = (toxicity.Scorer(TERMS, ZERO).features(mark.join(words)) for mark in (" ", ","))
    assert np.array_equal(a, b)


def test_a_mark_in_place_of_a_letter_is_still_an_edit():
    x = toxicity.Scorer(TERMS, ZERO).features("an idi*t")
    assert x[3] > 0
