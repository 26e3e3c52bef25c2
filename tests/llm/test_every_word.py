"""Training looks at every position of every text."""

import numpy as np

from loomgraph.llm.lm_scoring import Network, Windows


def test_every_word_is_a_target():
    block = Windows(np.arange(1, 24), np.array([0, 1, 9, 23]), Network().radius)
    assert sorted(block.chosen(Network().every, np.array([0, 5, 2]))) == list(range(23))
