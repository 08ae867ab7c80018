"""DataFrame operators against NumPy, edge cases of encoding, synthesis, storage and mechanisms."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cubiform.functions import kernels as K
from cubiform.mechanisms.aim import AIM
from cubiform.mechanisms import base
from cubiform.mechanisms.base import Answers
from cubiform.mechanisms.mst import MST
from cubiform.model import Model
from cubiform.operators import cubes, synth
from cubiform.operators.factors import Frame, belief_propagation, contraction
from cubiform.plans.schema import Schema
from cubiform.sources import encode

R = Schema(tuple("abc"), (3, 4, 5))


@pytest.fixture(scope="module")
def rows():
    return np.random.default_rng(1).integers(0, R.sizes, (500, 3))


@pytest.fixture(scope="module")
def df(spark, rows):
    return encode.from_rows(spark, rows, R)


def histogram(rows, attrs, weights=None):
    axes = R.axes(attrs)
    return np.histogramdd(rows[:, axes], [np.arange(R[a] + 1) for a in attrs], weights=weights)[0]


@pytest.mark.parametrize("how", ["sets", "dense"])
def test_many_marginals_agree_with_histograms(df, rows, how):
    cliques = [("a",), ("c", "a"), ("a", "b", "c"), ()]
    got = cubes.vectors(cubes.multi(df, cliques, how=how), cliques, R)
    for c, v in zip(cliques, got, strict=True):
        want = histogram(rows, c) if c else np.array(float(len(rows)))
        np.testing.assert_array_equal(v, want.ravel())


def test_weights_and_dense_forms(spark, rows):
    w = np.random.default_rng(2).integers(1, 9, len(rows)).astype(float)
    df = encode.from_rows(spark, rows, R, w)
    v = [r.value for r in cubes.datavector(df, ("b", "a"), "weight").collect()]
    np.testing.assert_allclose(v, histogram(rows, ("b", "a"), w).ravel())
    empty = df.limit(0)
    assert [r.value for r in cubes.dense(empty, ("a",)).collect()] == [0.0] * 3
    assert cubes.dense(empty, ()).first().value == 0.0


def test_invalid_codes(spark):
    raw = spark.createDataFrame([(-1,), (0,), (1,), (2,), (3,), (None,)], "a int")
    s = Schema(("a",), (3,))
    with pytest.raises(Exception, match="outside its attribute"):
        encode.checked(raw, s).collect()
    assert encode.checked(raw, s, on_invalid="drop").count() == 3
    learned = encode.Encoder.learned(spark.createDataFrame([("x",), (None,), ("y",)], "v string"), ["v"])
    assert learned.schema["v"] == 3
    assert sorted(r.v for r in learned.encode(spark.createDataFrame([(None,), ("y",)], "v string")).collect()) == [1, 2]


def test_load_and_save(spark, df, tmp_path):
    (tmp_path / "domain.json").write_text(R.to_json())
    encode.save(df, str(tmp_path / "csv"), "csv")
    back = encode.load(spark, str(tmp_path / "csv"), str(tmp_path / "domain.json"))
    assert cubes.schema_of(back) == R and back.count() == 500


def test_frames_agree_with_kernels(df, rows):
    ab, bc = (Frame(R.project(c), cubes.dense(df, c)) for c in (("a", "b"), ("b", "c")))
    x, y = (K.Factor(R.project(c), histogram(rows, c)) for c in (("a", "b"), ("b", "c")))

    def same(frame, factor):
        assert frame.schema == factor.schema
        np.testing.assert_allclose([r.value for r in frame.datavector().collect()], factor.values.ravel(), rtol=1e-9)

    same(ab * bc, x * y)
    same((ab + 1).log().project("b", log=True), (x + 1).log().project("b", log=True))
    same((ab - bc).project(("c", "a")), (x - y).project(("c", "a")))
    same(ab.expand(R).sum(("b", "c")), x.expand(R).sum(("b", "c")))
    with pytest.raises(ValueError):
        ab.transpose(("a",))


@pytest.mark.parametrize("cliques", [["xy", "yz", "zw"], ["xy", "yz", "xz", "w"], ["xy", "yz", "zw", "xw"], ["xyz", "y", "yz", "zw", "w"], ["x", "yw"], [""]])
def test_messages_agree_with_the_whole_product(spark, cliques):
    whole, rng = Schema(tuple("xyzw"), (2, 3, 2, 3)), np.random.default_rng(3)
    factors = []
    for k, c in enumerate(cliques):
        schema = whole.project(tuple(c))
        cells = [(*map(int, at), float(rng.normal())) for at in np.ndindex(*schema.sizes)]
        factors.append(Frame(schema, spark.createDataFrame(cells, ", ".join([*(f"{a} int" for a in c), "value double"]))))
    factors[0] = Frame(factors[0].schema, factors[0].df.withColumn("value", F.when(F.rank().over(Window.partitionBy(F.lit(0)).orderBy("value")) > 1, F.col("value")).otherwise(float("-inf")))) if cliques != [""] else factors[0]
    for f, got in zip(factors, belief_propagation(factors, 50), strict=True):
        want = contraction(factors, f.schema.attrs, "log-sum-exp").normalize(50, log=True).exp()
        assert got.schema == f.schema
        np.testing.assert_allclose([r.value for r in got.datavector().collect()], [r.value for r in want.datavector().collect()], rtol=1e-9, atol=1e-12)


def test_answers_are_bounded(df, monkeypatch):
    monkeypatch.setattr(base, "MAX_CELLS", 3)
    with pytest.raises(ValueError, match="cells"):
        Answers(df, [("a", "b"), ("b", "c")])
    assert AIM(1.0, 1e-6, max_model_mb=1e-6).possible(R, [("a",), ("a", "b")]) == [("a",)]


def small_model(rows) -> Model:
    cliques = [("a", "b"), ("b", "c")]
    theta = K.Cliques(R, {c: K.Factor(R.project(c), np.log(histogram(rows, c) + 1)) for c in cliques})
    return Model(R, theta, K.shafer_shenoy(theta, 1000.0), 1000.0)


def test_model_answers_and_storage(spark, rows, tmp_path):
    model = small_model(rows)
    model.save(spark, str(tmp_path / "model"))
    back = Model.load(spark, str(tmp_path / "model"))
    for q in [("a",), ("a", "c"), ("c", "a"), ()]:
        np.testing.assert_allclose(back.project(q).values, model.project(q).values)
    got = model.bulk(spark, [("a", "c"), ("b",)]).orderBy("clique_id", "cell").collect()
    np.testing.assert_allclose([r.value for r in got], np.concatenate([model.project(("a", "c")).datavector(), model.project("b").datavector()]))


@pytest.mark.parametrize("buckets", [1, 7])
def test_round_synthesis_follows_the_model(spark, rows, monkeypatch, buckets):
    monkeypatch.setattr(synth, "BUCKET_ROWS", -(-3000 // buckets))
    model = small_model(rows)
    out = model.synthetic(spark, 3000)
    assert out.count() == 3000 and cubes.schema_of(out) == R
    first, parents = synth.plan(model)[0]
    assert parents == ()
    got = cubes.vectors(cubes.multi(out, [(first,)]), [(first,)], R)[0]
    assert np.abs(got - model.project(first).values * 3).max() < 1
    pair = cubes.vectors(cubes.multi(out, [("a", "b")]), [("a", "b")], R)[0]
    assert np.abs(pair - model.project(("a", "b")).datavector() * 3).max() < 3


def test_sample_synthesis(spark, rows):
    out = small_model(rows).synthetic(spark, 4000, "sample")
    got = cubes.vectors(cubes.multi(out, [("b",)]), [("b",)], R)[0]
    np.testing.assert_allclose(got / 4000, small_model(rows).project("b").values / 1000, atol=0.04)


def test_zero_mass_parents_are_uniform(spark):
    s = Schema(("a", "b"), (2, 2))
    theta = K.Cliques(s, {("a", "b"): K.Factor(s, [[0.0, 0.0], [-np.inf, -np.inf]])})
    table = synth.conditional(spark, Model(s, theta, K.brute_force(theta, 1.0), 1.0), "b", ("a",)).orderBy("a", "code").collect()
    assert [r.p for r in table] == [0.5] * 4


def test_mechanisms_are_close_and_stay_in_budget(df, rows):
    mst = MST(20.0, 1e-6, seed=1, iters=300)
    model, out = mst.run(df)
    assert mst.ledger.used <= mst.ledger.rho * (1 + 1e-9) and out.count() == pytest.approx(500, abs=25)
    aim = AIM(20.0, 1e-6, seed=2, iters=200, rounds=4)
    model, out = aim.run(df, [("a", "b"), ("b", "c")])
    assert aim.ledger.used == pytest.approx(aim.ledger.rho)
    gap = np.abs(Answers(out, [("a",)])["a",] - histogram(rows, ("a",))).sum()
    assert gap < 60


def test_hash_uniform_is_uniform(spark):
    from cubiform.functions.noise import gaussian, laplace, uniform

    got = spark.range(20_000).select(F.avg(uniform("s", F.col("id"))).alias("u"), F.stddev(gaussian("s", F.col("id"), 2.0)).alias("g"), F.avg(F.abs(laplace("s", F.col("id"), 3.0))).alias("l")).first()
    assert got.u == pytest.approx(0.5, abs=0.01) and got.g == pytest.approx(2, abs=0.06) and got.l == pytest.approx(3, abs=0.1)
