"""A training step goes over whole blocks, and is the plain one."""

import numpy as np
import pytest

from loomgraph.llm import lm_scoring as lm


def plain(net, weights, targets, contexts):
    """Gradients of the mean of -log P, a position at a time."""
    out = [np.zeros(w.shape) for w in weights]
    total = []
    for t, c in zip(targets, contexts, strict=True):
        near = weights[0][c]
        h = np.tanh((near * weights[1]).sum(axis=0) + weights[2])
        kind, member = divmod(int(t), net.members)
        z, own = h @ weights[3] + weights[4], np.append(h, 1)
        p, q = np.exp(z - z.max()), np.exp(own @ weights[5][kind] - (own @ weights[5][kind]).max())
        p, q = p / p.sum(), q / q.sum()
        with np.errstate(divide="ignore"):
            total.append(np.log(p[kind]) + np.log(q[member]))
        p[kind] -= 1
        q[member] -= 1
        back = (weights[3] @ p + weights[5][kind][:-1] @ q) * (1 - h * h)
        for k, place in enumerate(c):
            out[0][place] += back * weights[1][k]
        for k, g in enumerate([near * back, back, np.outer(h, p), p]):
            out[k + 1] += g
        out[5][kind] += np.outer(own, q)
    return [g / len(targets) for g in out], np.array(total)


@pytest.mark.parametrize("size", [1, 500])  # 500: exponents beyond those that exp can take
def test_a_step_is_the_plain_one(size):
    net = lm.Network(classes=20, members=4, buckets=3, dims=5)
    draw = np.random.default_rng(2)
    weights = [w.astype(np.float64) for w in net.first(draw.integers(1, 9, net.tokens))]
    weights[3] *= size
    weights[5] *= size
    targets, contexts = lm.windows(draw.integers(1, 60, 150).astype(np.uint16), np.array([0, 40, 150]), 2)
    wanted, total = plain(net, weights, targets, contexts)
    with np.errstate(over="raise", invalid="raise"):
        assert np.allclose(lm.log_probabilities(net, weights, targets, contexts), np.maximum(total, -69), atol=1e-9)
        moved, moments = [w.copy() for w in weights], [np.full_like(w, 0.01) for w in weights]
        lm.train_step(net, moved, moments, targets, contexts)
    for w, m, v, g in zip(weights, moments, moved, wanted, strict=True):
        assert np.allclose(m, 0.01 + g * g, atol=1e-9) and np.allclose(v, w - net.rate * g / (np.sqrt(m) + 1e-6), atol=1e-9)


def test_a_step_takes_few_softmaxes(monkeypatch):
    """One a class would be most of the time over every word."""
    net, calls, softmax = lm.Network(), [], lm._softmax
    monkeypatch.setattr(lm, "_softmax", lambda z: calls.append(len(z)) or softmax(z))
    ids = np.arange(1, 8001, 8).astype(np.uint16)
    weights = net.first()
    lm.train_step(net, weights, [np.full_like(w, 0.01) for w in weights], *lm.windows(ids, np.array([0, len(ids)]), 2))
    assert sum(calls) == 2 * len(ids) and len(calls) <= 5
