"""The fitted and served quality model against a slow version, and on labels that words alone tell."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tessella.llm import quality
from tessella.llm.linear import fit_sigmoid
from tessella.llm.tokens import text_pieces

PLAIN = [f"{a}{b}{c}" for a in "bdgklmnprst" for b in "aeiou" for c in ("nd", "rt", "lm", "st")]


def spam_rows(seed, n, noise):
    """Texts of lower-case words alone; those of label 0 draw a third of them from a quarter of the
    vocabulary, in pairs; a share of the labels is wrong."""
    rng = random.Random(seed)
    some = PLAIN[::4]
    texts, labels = [], []
    for k in range(n):
        words = []
        while len(words) < 60:
            if k % 3 == 0 and rng.random() < 0.2:
                words += [rng.choice(some), rng.choice(some)]
            else:
                words.append(rng.choice(PLAIN))
        texts.append(" ".join(words))
        labels.append(int(k % 3 != 0) ^ int(rng.random() < noise))
    return texts, np.array(labels)


def indicators(texts):
    rows = []
    for first, last, raw, offsets in text_pieces(pa.array(texts)):
        doc, gram = quality.features(raw, offsets)
        rows += np.split(gram, np.cumsum(np.bincount(doc, minlength=last - first))[:-1])
    return rows


def scores(model, texts):
    return np.concatenate([model.scores(raw, offsets) for _, _, raw, offsets in text_pieces(pa.array(texts))])


def slow_margins(rows, labels, beta, tested):
    """Dense: log-count ratios, the dual problem swept in order until nothing moves, interpolation."""
    used = sorted(set(np.concatenate(rows).tolist()))
    at = {g: k for k, g in enumerate(used)}

    def dense(some):
        x = np.zeros((len(some), len(used)))
        for k, row in enumerate(some):
            for g in row.tolist():
                if g in at:
                    x[k, at[g]] = 1
        return x, 1 / np.sqrt(np.maximum(1, [len(r) for r in some]))[:, None]

    x, scale = dense(rows)
    p, q = x[labels == 1].sum(axis=0) + 1, x[labels == 0].sum(axis=0) + 1
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    z = np.hstack([x * ratio * scale, np.ones((len(x), 1))]) * np.where(labels == 1, 1, -1)[:, None]
    bound = np.where(labels == 1, len(labels) / (2 * labels.sum()), len(labels) / (2 * (1 - labels).sum())) * quality.COST
    gram, dual = z @ z.T, np.zeros(len(z))
    for _ in range(20_000):
        before = dual.copy()
        for k in range(len(dual)):
            dual[k] = min(max(dual[k] + (1 - gram[k] @ dual) / gram[k, k], 0), bound[k])
        if abs(dual - before).max() < 1e-14:
            break
    weights = z.T @ dual
    blend = (beta * weights[:-1] + (1 - beta) * abs(weights[:-1]).mean()) * ratio
    return [x @ blend * s[:, 0] + weights[-1] for x, s in (dense(some) for some in (rows, tested))]


@pytest.mark.parametrize("beta", [0.25, 1.0])
def test_scores_are_those_of_the_slow_model(beta):
    texts, labels = spam_rows(1, 45, 0.1)
    others = ["", "None of THESE!! words | was seen", *spam_rows(2, 20, 0)[0]]
    rows = indicators(texts)
    model = quality.fit(rows, labels, beta=beta, tolerance=1e-13, epochs=20_000)
    own, margins = slow_margins(rows, labels, beta, indicators(others))
    slope, offset = fit_sigmoid(own, labels)
    wanted = 1 / (1 + np.exp(-(slope * margins + offset)))
    assert abs(scores(model, others) - wanted).max() < 1e-6


def test_labels_that_words_alone_tell():
    """Equal shapes and a tenth of wrong labels; the fitted weights matter and beat the ratios alone."""
    texts, labels = spam_rows(3, 1500, 0.1)
    tested, truth = spam_rows(4, 600, 0.0)
    rows = indicators(texts)

    def right(model):
        return ((scores(model, tested) >= 0.5) == truth).mean()

    assert right(quality.fit(rows, labels)) >= 0.9
    plain, whole = (scores(quality.fit(rows, labels, beta=b), tested) for b in (0.0, 1.0))
    assert abs(plain - whole).max() > 0.05
