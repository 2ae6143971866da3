"""The label model against votes whose truth is known."""

import numpy as np

from corpusmill.llm import toxicity


def test_label_model_estimates_accuracies_and_correlations():
    """Five voters see what they see on their own, a sixth repeats the first: these two share their evidence."""
    rng = np.random.default_rng(21)
    truth = rng.random(40_000) < 0.2
    own = [rng.random(40_000) < np.where(truth, p, q) for p, q in ((0.7, 0.03), (0.6, 0.02), (0.5, 0.01), (0.8, 0.05), (0.65, 0.02))]
    x = np.array([*own, own[0]]).T.astype(int)
    patterns, counts = np.unique(x, axis=0, return_counts=True)
    model = toxicity.LabelModel().fit(patterns, counts)
    assert np.abs(model.p1 - [0.7, 0.6, 0.5, 0.8, 0.65, 0.7]).max() < 0.03 and model.p0.max() < 0.07 and abs(model.prior - 0.2) < 0.02
    assert (model.share[[0, 5]] > 1.9).all() and (model.share[[1, 2, 3, 4]] < 1.1).all()
    post = model.posterior(x)
    assert np.mean((post > 0.5) == truth) > 0.98
    copies = (x[:, 0] == 1) & (x[:, 1:5].sum(1) == 0)  # two votes that are one
    assert abs(post[copies].mean() - truth[copies].mean()) < 0.05


def test_features_past_the_voters():
    voters = toxicity.Voters(["grukk-"], ["river", "stone"])
    found, votes = voters.look("River, stone and an IDIOT by the grukkish mill")
    names = list(voters.words.vocabulary)
    assert {"river", "stone", "grukk-", "idiot"} <= {names[f] for f in found if f < len(names)}
    assert votes == toxicity.Voters(["grukk-"]).look("River, stone and an IDIOT by the grukkish mill")[1]
