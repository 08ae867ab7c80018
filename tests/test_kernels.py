"""NumPy kernels, losses and estimators against brute force and recovery properties."""

from itertools import combinations

import numpy as np
import pytest

from cubiform.functions import fit, privacy
from cubiform.functions import kernels as K
from cubiform.functions import losses as L
from cubiform.functions.mixture import fit_mixture
from cubiform.plans.schema import Schema

from .test_plans import CASES, D4

ORACLES = {
    "brute": K.brute_force,
    "belief": K.belief_propagation,
    "shenoy": K.shafer_shenoy,
    "einsum": K.einsum_marginals,
    "many": lambda p, t: K.many_marginals(p, list(p), t),
    "bulk": lambda p, t: K.bulk_variable_elimination(p, list(p), t),
}


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("oracle", ORACLES)
def test_oracles(case, oracle):
    p = K.Cliques.random(D4, CASES[case], 1)
    truth, got = K.brute_force(p, 10), ORACLES[oracle](p, 10)
    assert list(got) == CASES[case]
    for c in got:
        assert got[c].schema.attrs == c
        np.testing.assert_allclose(got[c].values, truth[c].values)
    for total in (1, 100):
        flat = ORACLES[oracle](K.Cliques.zeros(D4, CASES[case]), total)
        for c in flat:
            np.testing.assert_allclose(flat[c].values, total / D4.size(c))


@pytest.mark.parametrize("case", CASES)
def test_out_of_model(case):
    p = K.Cliques.random(D4, CASES[case], 2)
    joint = K.Factor.zeros(D4)
    for f in p.values():
        joint = joint + f
    joint = joint.normalize(7, log=True).exp()
    queries = [q for k in range(5) for q in combinations("abcd", k)]
    many = K.many_marginals(p, queries, 7)
    for q in queries:
        np.testing.assert_allclose(K.variable_elimination(p, q, 7).values, joint.project(q).values)
        np.testing.assert_allclose(many[q].values, joint.project(q).values)
    m = {"b": np.tril(np.ones((3, 3))), "d": np.ones((1, 5))}
    want = np.einsum("xb,yd,bd->xy", m["b"], m["d"], joint.project(("b", "d")).values)
    np.testing.assert_allclose(K.kron_query(p, m, 7).values, want)


def test_structural_zeros_and_factor_algebra():
    f = K.Factor(Schema(("a", "b"), (2, 2)), np.array([[0.0, -np.inf], [-np.inf, -np.inf]]))
    assert f.logsumexp("b").values.tolist() == [0.0, -np.inf]
    g = K.Factor.random(Schema(("b", "c"), (2, 3)))
    h = K.Factor.random(Schema(("a", "b"), (2, 2)), 4)
    np.testing.assert_allclose((h * g).values, h.values[:, :, None] * g.values[None])
    np.testing.assert_allclose((1 - g).values, 1 - g.values)
    np.testing.assert_allclose(g.log().exp().values, g.values)
    np.testing.assert_allclose(h.expand(Schema(("d", "b", "a"), (5, 2, 2))).sum("d").transpose(("a", "b")).values / 5, h.values)
    assert float(g.sum()) == pytest.approx(g.values.sum())
    with pytest.raises(ValueError):
        g.dot(g.transpose(("c", "b")))
    v = K.Cliques.random(D4, CASES["tree"])
    e = v.expand([("a", "b", "c"), ("c", "d")])
    np.testing.assert_allclose(e["a", "b", "c"].values, v["a", "b"].values[:, :, None] + v["b", "c"].values[None])
    assert v.parent(("b",)) == ("a", "b") and not v.supports(("a", "d"))


@pytest.mark.parametrize("sequential", ["", "i", "j", "ij"])
def test_contractions(sequential):
    r = np.random.default_rng(0)
    x, y = r.random((2, 3)), r.random((3, 4))
    got = K.loop_einsum("ij,jk->ik", x, y, sequential=sequential)
    np.testing.assert_allclose(got, x @ y, rtol=1e-7)
    with pytest.raises(ValueError):
        K.loop_einsum("ij,jk->ik", x, y, sequential="z")
    a, b = np.array([[1, 6], [5, 2]]), np.array([[4, 3], [0, 7]])
    assert K.contract(a, b, ([1], [0]), combine=np.maximum, reduce=np.min).tolist() == [[4, 3], [2, 5]]
    batched = K.contract(r.random((2, 3, 4)), r.random((2, 4, 5)), ([2], [1]), ([0], [0]))
    assert batched.shape == (2, 3, 5)


JOINT = K.Factor.random(D4, 3).normalize(1)
ESTIMATORS = {
    "mirror": lambda ms: fit.mirror_descent(D4, ms, iters=250),
    "l1": lambda ms: fit.mirror_descent(D4, L.linear_loss(ms, D4, "l1"), known_total=1, stepsize=0.01, iters=250),
    "lbfgs": lambda ms: fit.lbfgs(D4, ms, iters=250),
    "averaging": lambda ms: fit.dual_averaging(D4, ms, iters=250),
    "interior": lambda ms: fit.interior_gradient(D4, ms, iters=250),
    "universal": lambda ms: fit.universal_accelerated(D4, ms, iters=250),
    "regions": lambda ms: fit.mirror_descent(D4, ms, stateful=fit.approximate, stepsize=1.0, iters=250),
}


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("estimator", ESTIMATORS)
def test_recovery(case, estimator):
    ms = [L.Measurement(JOINT.project(c).values, c) for c in CASES[case]]
    model = ESTIMATORS[estimator](ms)
    assert model.total == pytest.approx(1)
    for c in CASES[case]:
        np.testing.assert_allclose(model.project(c).values, JOINT.project(c).values, atol=1e-2)


def test_mle_and_totals():
    joint = K.Factor.random(D4, 5)
    total = float(joint.sum())
    for case in CASES.values():
        mu = K.Cliques(D4, {c: joint.project(c) for c in case})
        model = fit.mle_from_marginals(mu, total)
        for c in case:
            np.testing.assert_allclose(model.project(c).values, mu[c].values, atol=100 / total)
    assert L.estimated_total([L.Measurement(np.array([4.0, 6.0]), ("a",), 1), L.Measurement(np.full(5, 4.0), ("d",), 2)]) == pytest.approx(120 / 11)
    assert L.estimated_total([]) == 1
    with pytest.raises(ValueError):
        L.linear_loss([], norm="l3")
    with pytest.raises(ValueError):
        fit.mirror_descent(D4, [], stateful=fit.approximate)


@pytest.mark.parametrize("norm,normalize", [("l2", False), ("l2", True), ("l1", False)])
def test_gradients(norm, normalize):
    ms = [L.Measurement(np.arange(6.0), ("a", "b"), 2.0), L.Measurement(np.ones(2), ("c",), 1.5, np.random.default_rng(0).random((2, 4)))]
    loss = L.linear_loss(ms, D4, norm, normalize)
    mu = K.Cliques.random(D4, loss.cliques, 8)
    value, g = loss.of(mu)
    for c in mu:
        v = mu[c].values.copy().ravel()
        for k in range(len(v)):
            w = v.copy()
            w[k] += 1e-6
            moved = K.Cliques(D4, {**mu, c: K.Factor(mu[c].schema, w)})
            if not normalize:
                assert (loss(moved) - value) / 1e-6 == pytest.approx(g[c].values.ravel()[k], abs=1e-3)
    assert L.primal_feasibility(K.Cliques(D4, {c: JOINT.project(c) for c in CASES["tree"]})) == pytest.approx(0, abs=1e-12)


def test_mixture_recovers():
    ms = [L.Measurement(JOINT.project(c).values, c) for c in CASES["tree"]]
    m = fit_mixture(D4, L.linear_loss(ms), 1.0, components=10, iters=400, rate=0.1)
    for c in CASES["tree"]:
        np.testing.assert_allclose(m.project(c).values, JOINT.project(c).values, atol=1e-2)


def test_privacy():
    assert privacy.rho_of(1, 1e-9) == pytest.approx(0.0149730577, rel=1e-8)
    assert privacy.rho_of(1, 1e-10) == pytest.approx(0.0132425838, rel=1e-8)
    assert privacy.rho_of(1, 1e-5) == pytest.approx(0.0305565952, rel=1e-8)
    assert privacy.rho_of(10, 1e-9) == pytest.approx(1.0907857044, rel=1e-8)
    assert privacy.eps_of(privacy.rho_of(2, 1e-6), 1e-6) == pytest.approx(2)
    ledger = privacy.Ledger(1.0)
    ledger.gaussian(1.0)
    with pytest.raises(ValueError):
        ledger.spend(0.6, "too much")
    rng = np.random.default_rng(0)
    picks = [privacy.exponential_mechanism({"x": 0.0, "y": 2.0}, 1.0, 1.0, rng) for _ in range(4000)]
    assert picks.count("y") / 4000 == pytest.approx(np.e / (1 + np.e), abs=0.03)
    assert privacy.exponential_mechanism([1, 5, 2], np.inf, 1.0, rng) == 1
    q, d = [3, 5, 4, 9], [1, 2, 2, 1]
    assert privacy.skyline(q, d) == [3]
    assert privacy.gaussian_scale(1, 1e-5, 1) == pytest.approx(3.7304, abs=1e-3)
    assert privacy.best_noise(1, 0, 2, 1) == ("laplace", 2.0)
