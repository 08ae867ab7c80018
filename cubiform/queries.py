"""Queries over the test tables, one or more per operator, with their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import fit, privacy
from .functions import kernels as K
from .functions.losses import Measurement, linear_loss, total_estimate
from .functions.mixture import fit_mixture
from .functions.noise import gaussian, laplace, uniform, uniform_sql
from .mechanisms.aim import AIM
from .mechanisms.direct import GaussianApproximate, WeightedApproximate
from .mechanisms.grid import AdaptiveGrid
from .mechanisms.jam import JAM
from .mechanisms.mst import MST, Compression
from .mechanisms.mwem import MWEM
from .model import Model, factor_frame
from .operators import cubes, synth
from .operators.cliquevec import Long, feasibility
from .operators.factors import Frame, belief_propagation, contraction, einsum
from .operators.rowweights import public_support, shifted, weighted_marginals
from .plans.schema import Schema
from .sources.encode import Buckets, Edges, Encoder, Levels, checked, random_records
from .streaming.incremental import running_marginals, windowed_marginals

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

LINES = Encoder({
    "returnflag": ("l_returnflag", Levels(("A", "N", "R"))),
    "linestatus": ("l_linestatus", Levels(("F", "O"))),
    "linenumber": ("l_linenumber", Buckets(1, 1, 7, exact=True)),
    "discount": ("l_discount", Buckets(0.0, 0.01, 11, exact=True)),
    "tax": ("l_tax", Buckets(0.0, 0.01, 9, exact=True)),
    "quantity": ("l_quantity", Buckets(1.0, 1.0, 50, exact=True)),
})
S = LINES.schema
ORDERS = Encoder({
    "status": ("o_orderstatus", Levels(("F", "O", "P"))),
    "priority": ("o_orderpriority", Levels(("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"))),
})
CHAIN = [("returnflag", "linestatus"), ("linestatus", "linenumber"), ("linenumber", "discount")]

#: The encoded lines, in DuckDB.
L6 = """l6 AS (SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS returnflag,
    CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END AS linestatus, CAST(l_linenumber - 1 AS INTEGER) AS linenumber,
    CAST(round(l_discount * 100) AS INTEGER) AS discount, CAST(round(l_tax * 100) AS INTEGER) AS tax,
    CAST(round(l_quantity) AS INTEGER) - 1 AS quantity, l_quantity AS w FROM lineitem)"""


def query(name: str, oracle: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add


def lines(spark: SparkSession, sf: str, weight: bool = False) -> DataFrame:
    raw = spark.read.parquet(f"{sf}/lineitem.parquet")
    return LINES.encode(raw.withColumn("w", F.col("l_quantity")), "w" if weight else None, "trust")


def cube(spark: SparkSession, sf: str, *attrs: str) -> Frame:
    return Frame(S.project(attrs), cubes.dense(lines(spark, sf), attrs))


def chain_factors(spark: SparkSession, sf: str) -> list[Frame]:
    """The chain's cubes, counted in one pass over the lines."""
    cells = Long.measured(lines(spark, sf), CHAIN).stored()
    return [cells.factor(k) for k in range(len(CHAIN))]


def rounded(df: DataFrame, digits: int = 6, column: str = "value") -> DataFrame:
    return df.withColumn(column, F.round(column, digits) + F.lit(0.0))


def grid_sql(*attrs: str) -> str:
    return " CROSS JOIN ".join(f"(SELECT CAST(range AS INTEGER) AS {a} FROM range({S[a]}))" for a in attrs)


def dense_sql(*attrs: str, value: str = "CAST(count(*) AS DOUBLE)", source: str = "l6") -> str:
    """A dense cube as a subquery."""
    by = ", ".join(attrs)
    return f"(SELECT {by}, coalesce(v, 0.0) AS value FROM {grid_sql(*attrs)} LEFT JOIN (SELECT {by}, {value} AS v FROM {source} GROUP BY {by}) USING ({by}))"


def cell_sql(*attrs: str) -> str:
    return "CAST(" + " + ".join(f"{a} * {s}" for a, s in zip(attrs, S.strides(attrs), strict=True)) + " AS BIGINT)"


# -- data to cubes -------------------------------------------------------------------------------------


@query("marginal_1way", f"WITH {L6} SELECT * FROM {dense_sql('returnflag')}")
def marginal_1way(spark, sf):
    return cube(spark, sf, "returnflag").df


@query("marginal_2way", f"WITH {L6} SELECT * FROM {dense_sql('discount', 'linenumber')}")
def marginal_2way(spark, sf):
    return cube(spark, sf, "discount", "linenumber").df


@query("marginal_3way_dense", f"WITH {L6} SELECT * FROM {dense_sql('returnflag', 'linestatus', 'linenumber')}")
def marginal_3way_dense(spark, sf):
    return cube(spark, sf, "returnflag", "linestatus", "linenumber").df


@query("marginal_weighted", f"WITH {L6} SELECT * FROM {dense_sql('returnflag', 'discount', value='sum(w)')}")
def marginal_weighted(spark, sf):
    return cubes.dense(lines(spark, sf, weight=True), ("returnflag", "discount"), "w")


@query("marginal_empty", "SELECT CAST(count(*) AS DOUBLE) AS value FROM lineitem")
def marginal_empty(spark, sf):
    return cubes.dense(lines(spark, sf), ())


@query("record_count", "SELECT count(*) AS n FROM lineitem")
def record_count(spark, sf):
    return lines(spark, sf).agg(F.count(F.lit(1)).alias("n"))


@query("datavector_cells", f"WITH {L6} SELECT {cell_sql('linestatus', 'tax', 'linenumber')} AS cell, value FROM {dense_sql('linestatus', 'tax', 'linenumber')}")
def datavector_cells(spark, sf):
    return cubes.datavector(lines(spark, sf), ("linestatus", "tax", "linenumber"))


@query("drop_columns", f"WITH {L6} SELECT * FROM {dense_sql('returnflag', 'linestatus', 'linenumber')}")
def drop_columns(spark, sf):
    return cubes.dropped(lines(spark, sf), ("discount", "tax", "quantity"))


PAIRS = list(combinations(S.attrs, 2))
TRIPLES = [("returnflag", "linestatus", "linenumber"), ("linenumber", "returnflag"), ("quantity",), ("linestatus", "discount", "tax")]


def union_sql(cliques: list, dense: bool = True) -> str:
    parts = []
    for k, c in enumerate(cliques):
        source = dense_sql(*c) if dense else f"(SELECT {', '.join(c)}, CAST(count(*) AS DOUBLE) AS value FROM l6 GROUP BY {', '.join(c)})"
        parts.append(f"SELECT {k} AS clique_id, {cell_sql(*c)} AS cell, value FROM {source}")
    return f"WITH {L6} " + " UNION ALL ".join(parts)


@query("multi_marginal", union_sql(PAIRS))
def multi_marginal(spark, sf):
    return cubes.filled(cubes.multi(lines(spark, sf), PAIRS), PAIRS, S)


@query("multi_marginal_sets", union_sql(TRIPLES, dense=False))
def multi_marginal_sets(spark, sf):
    return cubes.multi(lines(spark, sf), TRIPLES, how="sets")


@query("downward_closure_cube", f"""WITH {L6} SELECT returnflag, linestatus, linenumber, CAST(count(*) AS DOUBLE) AS value,
    CAST(grouping_id(returnflag, linestatus, linenumber) AS INTEGER) AS "set" FROM l6 GROUP BY CUBE (returnflag, linestatus, linenumber)""")  # fmt: skip
def downward_closure_cube(spark, sf):
    return cubes.closure_cube(lines(spark, sf), ("returnflag", "linestatus", "linenumber"))


@query("encode_decode", "SELECT l_returnflag AS returnflag, l_linestatus AS linestatus, count(*) AS n FROM lineitem GROUP BY ALL")
def encode_decode(spark, sf):
    return LINES.decode(lines(spark, sf)).groupBy("returnflag", "linestatus").agg(F.count(F.lit(1)).alias("n"))


@query("encode_buckets", """SELECT CASE WHEN c_acctbal < 0 THEN 0 WHEN c_acctbal < 2500 THEN 1 WHEN c_acctbal < 5000 THEN 2 ELSE 3 END AS balance,
    c_nationkey AS nation, count(*) AS n FROM customer GROUP BY ALL""")  # fmt: skip
def encode_buckets(spark, sf):
    coder = Encoder({"balance": ("c_acctbal", Edges((-1e9, 0.0, 2500.0, 5000.0, 1e9))), "nation": ("c_nationkey", Buckets(0, 1, 25, exact=True))})
    coded = coder.encode(spark.read.parquet(f"{sf}/customer.parquet"))
    return coded.groupBy("balance", "nation").agg(F.count(F.lit(1)).alias("n"))


@query("encode_drop_invalid", "SELECT CAST(l_linenumber - 1 AS INTEGER) AS linenumber, count(*) AS n FROM lineitem WHERE l_linenumber <= 3 GROUP BY ALL")
def encode_drop_invalid(spark, sf):
    raw = spark.read.parquet(f"{sf}/lineitem.parquet").select((F.col("l_linenumber") - 1).alias("linenumber"))
    return checked(raw, Schema.of({"linenumber": 3}), on_invalid="drop").groupBy("linenumber").agg(F.count(F.lit(1)).alias("n"))


@query("random_records", f"""SELECT CAST(floor({uniform_sql('records:a', 'range')} * 3) AS INTEGER) AS a,
    CAST(floor({uniform_sql('records:b', 'range')} * 5) AS INTEGER) AS b, count(*) AS n FROM range(10000) GROUP BY ALL""")  # fmt: skip
def random_records_query(spark, sf):
    return random_records(spark, Schema.of({"a": 3, "b": 5}), 10_000).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


# -- factor algebra -------------------------------------------------------------------------------------

AB, BC = ("returnflag", "linestatus"), ("linestatus", "linenumber")
WITH_AB_BC = f"WITH {L6}, ab AS {dense_sql(*AB)}, bc AS {dense_sql(*BC)}"


@query("factor_product", f"{WITH_AB_BC} SELECT returnflag, linestatus, linenumber, ab.value * bc.value AS value FROM ab JOIN bc USING (linestatus)")
def factor_product(spark, sf):
    return (cube(spark, sf, *AB) * cube(spark, sf, *BC)).df


@query("factor_ratio_conditional", f"""{WITH_AB_BC}, b AS (SELECT linestatus, sum(value) AS t FROM bc GROUP BY linestatus)
    SELECT linestatus, linenumber, round(CASE WHEN t <> 0 THEN value / t ELSE 0.0 END, 6) AS value FROM bc JOIN b USING (linestatus)""")  # fmt: skip
def factor_ratio_conditional(spark, sf):
    bc = cube(spark, sf, *BC)
    return rounded((bc / bc.project("linestatus")).df)


@query("factor_sum_diff", f"{WITH_AB_BC} SELECT returnflag, linestatus, linenumber, 2 * (ab.value + bc.value) - (ab.value - bc.value) AS value FROM ab JOIN bc USING (linestatus)")
def factor_sum_diff(spark, sf):
    a, b = cube(spark, sf, *AB), cube(spark, sf, *BC)
    return (2 * (a + b) - (a - b)).df


@query("factor_outer", f"WITH {L6}, a AS {dense_sql('returnflag')}, t AS {dense_sql('tax')} SELECT returnflag, tax, a.value * t.value AS value FROM a CROSS JOIN t")
def factor_outer(spark, sf):
    return (cube(spark, sf, "returnflag") * cube(spark, sf, "tax")).df


@query("factor_scalar", f"{WITH_AB_BC} SELECT returnflag, linestatus, 100 - value * 3 AS value FROM ab")
def factor_scalar(spark, sf):
    return (100 - cube(spark, sf, *AB) * 3).df


@query("factor_sum_out", f"{WITH_AB_BC} SELECT linenumber, sum(value) AS value FROM bc GROUP BY linenumber")
def factor_sum_out(spark, sf):
    return cube(spark, sf, *BC).sum("linestatus").df


@query("factor_max_out", f"{WITH_AB_BC} SELECT linestatus, max(value) AS value FROM bc GROUP BY linestatus")
def factor_max_out(spark, sf):
    return cube(spark, sf, *BC).max("linenumber").df


@query("factor_logsumexp", f"""WITH {L6}, f AS {dense_sql('returnflag', 'linestatus', 'tax')}, g AS (SELECT *, CASE WHEN value > 0 THEN ln(value) ELSE CAST('-inf' AS DOUBLE) END AS x FROM f)
    SELECT returnflag, tax, round(CASE WHEN sum(value) > 0 THEN ln(sum(value)) ELSE CAST('-inf' AS DOUBLE) END, 6) AS value FROM g GROUP BY returnflag, tax""")  # fmt: skip
def factor_logsumexp(spark, sf):
    return rounded(cube(spark, sf, "returnflag", "linestatus", "tax").log().logsumexp("linestatus").df)


@query("factor_exp_log", f"{WITH_AB_BC} SELECT linestatus, linenumber, round(value + 1, 6) AS value FROM bc")
def factor_exp_log(spark, sf):
    return rounded((cube(spark, sf, *BC) + 1).log().exp().df)


@query("factor_normalize", f"{WITH_AB_BC} SELECT returnflag, linestatus, round(value * 10 / sum(value) OVER (), 6) AS value FROM ab")
def factor_normalize(spark, sf):
    return rounded(cube(spark, sf, *AB).normalize(10).df)


@query("factor_normalize_log", f"{WITH_AB_BC} SELECT linestatus, linenumber, round(ln(value + 1) + ln(10) - ln(sum(value + 1) OVER ()), 6) AS value FROM bc")
def factor_normalize_log(spark, sf):
    return rounded((cube(spark, sf, *BC) + 1).log().normalize(10, log=True).df)


@query("factor_dot", f"{WITH_AB_BC} SELECT sum(value * value * 0.5) AS value FROM bc")
def factor_dot(spark, sf):
    bc = cube(spark, sf, *BC)
    return bc.dot(bc * 0.5)


@query("factor_expand", f"{WITH_AB_BC} SELECT CAST(range AS INTEGER) AS tax, returnflag, linestatus, value FROM ab CROSS JOIN range(9)")
def factor_expand(spark, sf):
    return cube(spark, sf, *AB).expand(S.project(("tax", *AB))).df


@query("factor_transpose", f"WITH {L6} SELECT CAST(linenumber * 2 + linestatus AS BIGINT) AS cell, value FROM {dense_sql(*BC)}")
def factor_transpose(spark, sf):
    return cube(spark, sf, *BC).transpose(("linenumber", "linestatus")).datavector()


@query("factor_random", f"SELECT CAST(range // 2 AS INTEGER) AS returnflag, CAST(range % 2 AS INTEGER) AS linestatus, {uniform_sql('factor', 'range')} AS value FROM range(6)")
def factor_random(spark, sf):
    return Frame.random(spark.range(1), S.project(AB)).df


@query("einsum_chain", f"""{WITH_AB_BC}, cd AS {dense_sql('linenumber', 'discount')} SELECT returnflag AS a, discount AS d, sum(ab.value * bc.value * cd.value) AS value
    FROM ab JOIN bc USING (linestatus) JOIN cd USING (linenumber) GROUP BY ALL""")  # fmt: skip
def einsum_chain(spark, sf):
    return einsum("ab,bc,cd->ad", *chain_factors(spark, sf)).df


@query("semiring_maxplus", f"{WITH_AB_BC} SELECT returnflag, linenumber, max(ab.value + bc.value) AS value FROM ab JOIN bc USING (linestatus) GROUP BY ALL")
def semiring_maxplus(spark, sf):
    return contraction([cube(spark, sf, *AB), cube(spark, sf, *BC)], ("returnflag", "linenumber"), "max-plus").df


@query("semiring_minmax", f"{WITH_AB_BC} SELECT returnflag, linenumber, min(greatest(ab.value, bc.value)) AS value FROM ab JOIN bc USING (linestatus) GROUP BY ALL")
def semiring_minmax(spark, sf):
    return contraction([cube(spark, sf, *AB), cube(spark, sf, *BC)], ("returnflag", "linenumber"), "min-max").df


@query("semiring_logsumexp", f"{WITH_AB_BC} SELECT returnflag, linenumber, round(ln(sum((ab.value + 1) * (bc.value + 1))), 6) AS value FROM ab JOIN bc USING (linestatus) GROUP BY ALL")
def semiring_logsumexp(spark, sf):
    parts = [(cube(spark, sf, *AB) + 1).log(), (cube(spark, sf, *BC) + 1).log()]
    return rounded(contraction(parts, ("returnflag", "linenumber"), "log-sum-exp").df)


# -- clique vectors ---------------------------------------------------------------------------------------

VECTOR_SQL = union_sql(CHAIN).removeprefix(f"WITH {L6} ")


@query("cliques_measured", union_sql(CHAIN))
def cliques_measured(spark, sf):
    return Long.measured(lines(spark, sf), CHAIN).df


@query("cliques_contract", union_sql([("linestatus",), ("discount",), ("linestatus", "returnflag")]))
def cliques_contract(spark, sf):
    return Long.measured(lines(spark, sf), CHAIN).contract([("linestatus",), ("discount",), ("linestatus", "returnflag")]).df


BIG = [("returnflag", "linestatus", "linenumber"), ("linenumber", "discount", "tax")]


@query("cliques_expand", f"""{WITH_AB_BC}, cd AS {dense_sql('linenumber', 'discount')}
    SELECT 0 AS clique_id, CAST(returnflag * 14 + linestatus * 7 + linenumber AS BIGINT) AS cell, ab.value + bc.value AS value FROM ab JOIN bc USING (linestatus)
    UNION ALL SELECT 1, CAST(linenumber * 99 + discount * 9 + range AS BIGINT), value FROM cd CROSS JOIN range(9)""")  # fmt: skip
def cliques_expand(spark, sf):
    return Long.measured(lines(spark, sf), CHAIN).expand(BIG).df


@query("cliques_arithmetic", f"WITH {L6}, v AS ({VECTOR_SQL}) SELECT clique_id, cell, round(ln(value + 1) - (value * 2 + value) * 0.001, 6) AS value FROM v")
def cliques_arithmetic(spark, sf):
    v = Long.measured(lines(spark, sf), CHAIN)
    return rounded(((v + 1.0).log() - (v * 2.0 + v) * 0.001).df)


@query("cliques_normalize", f"WITH {L6}, v AS ({VECTOR_SQL}) SELECT clique_id, cell, round(100 * (value + 1) / sum(value + 1) OVER (PARTITION BY clique_id), 6) AS value FROM v")
def cliques_normalize(spark, sf):
    return rounded((Long.measured(lines(spark, sf), CHAIN) + 1.0).log().normalize(100).exp().df)


@query("cliques_dot", f"WITH {L6}, v AS ({VECTOR_SQL}) SELECT sum(value * value) AS value FROM v")
def cliques_dot(spark, sf):
    v = Long.measured(lines(spark, sf), CHAIN)
    return v.dot(v)


# -- inference ---------------------------------------------------------------------------------------------


def chain_vectors(spark, sf) -> K.Cliques:
    got = cubes.vectors(cubes.multi(lines(spark, sf), CHAIN), CHAIN, S)
    return K.Cliques(S, {c: K.Factor(S.project(c), v) for c, v in zip(CHAIN, got, strict=True)})


JOINT_SQL = f"""{WITH_AB_BC}, cd AS {dense_sql('linenumber', 'discount')}, j AS (SELECT returnflag, linestatus, linenumber, discount, (ab.value + 1) * (bc.value + 1) * (cd.value + 1) AS p
    FROM ab JOIN bc USING (linestatus) JOIN cd USING (linenumber)), t AS (SELECT sum(p) AS t FROM j)"""  # fmt: skip


def potentials(spark, sf) -> K.Cliques:
    return chain_vectors(spark, sf).map(lambda f: (f + 1.0).log())


def joint_sql(*attrs: str) -> str:
    return f"{JOINT_SQL} SELECT {', '.join(attrs)}, round(1000 * sum(p) / any_value(t), 6) AS value FROM j, t GROUP BY {', '.join(attrs)}"


def framed(spark, factor: K.Factor, digits: int = 6) -> DataFrame:
    return rounded(factor_frame(spark, factor), digits)


@query("brute_force_marginals", joint_sql("linestatus", "linenumber"))
def brute_force_marginals(spark, sf):
    return framed(spark, K.brute_force(potentials(spark, sf), 1000)[BC])


@query("belief_propagation_chain", joint_sql("linenumber", "discount"))
def belief_propagation_chain(spark, sf):
    return framed(spark, K.belief_propagation(potentials(spark, sf), 1000)[CHAIN[2]])


@query("shafer_shenoy_chain", joint_sql("returnflag", "linestatus"))
def shafer_shenoy_chain(spark, sf):
    return framed(spark, K.shafer_shenoy(potentials(spark, sf), 1000)[CHAIN[0]])


@query("einsum_marginals", joint_sql("linestatus", "linenumber"))
def einsum_marginals(spark, sf):
    return framed(spark, K.einsum_marginals(potentials(spark, sf), 1000)[BC])


@query("belief_propagation_frames", joint_sql("linestatus", "linenumber"))
def belief_propagation_frames(spark, sf):
    factors = [(f + 1).log() for f in chain_factors(spark, sf)]
    return rounded(belief_propagation(factors, 1000)[1].df)


@query("variable_elimination_out_of_model", joint_sql("returnflag", "discount"))
def variable_elimination_out_of_model(spark, sf):
    return framed(spark, K.variable_elimination(potentials(spark, sf), ("returnflag", "discount"), 1000))


@query("uniform_outside_model", f"{JOINT_SQL} SELECT returnflag, CAST(range AS INTEGER) AS tax, round(1000 * sum(p) / any_value(t) / 9, 6) AS value FROM j, t, range(9) GROUP BY ALL")
def uniform_outside_model(spark, sf):
    return framed(spark, K.variable_elimination(potentials(spark, sf), ("returnflag", "tax"), 1000))


@query("many_marginals", joint_sql("returnflag", "linenumber"))
def many_marginals(spark, sf):
    return framed(spark, K.many_marginals(potentials(spark, sf), [("returnflag", "linenumber")], 1000)["returnflag", "linenumber"])


def model_of(spark, sf) -> Model:
    theta = potentials(spark, sf)
    return Model(S, theta, K.shafer_shenoy(theta, 1000), 1000.0)


@query("bulk_queries", f"""{JOINT_SQL} SELECT 0 AS clique_id, CAST(returnflag * 11 + discount AS BIGINT) AS cell, round(1000 * sum(p) / any_value(t), 6) AS value FROM j, t GROUP BY returnflag, discount
    UNION ALL SELECT 1, CAST(linenumber AS BIGINT), round(1000 * sum(p) / any_value(t), 6) FROM j, t GROUP BY linenumber""")  # fmt: skip
def bulk_queries(spark, sf):
    return rounded(model_of(spark, sf).bulk(spark, [("returnflag", "discount"), ("linenumber",)]))


RATIO_SQL = f"""{WITH_AB_BC}, cd AS {dense_sql('linenumber', 'discount')}, b AS (SELECT linestatus, sum(value) AS v FROM bc GROUP BY 1), c AS (SELECT linenumber, sum(value) AS v FROM cd GROUP BY 1),
    r AS (SELECT returnflag, linestatus, linenumber, discount, ab.value * bc.value * cd.value / b.v / c.v AS p FROM ab JOIN bc USING (linestatus) JOIN cd USING (linenumber) JOIN b USING (linestatus) JOIN c USING (linenumber))
    SELECT returnflag, discount, round(sum(p) / (SELECT count(*) FROM lineitem), 4) AS value FROM r GROUP BY ALL"""  # fmt: skip


def shared_answer(spark, model: Model) -> DataFrame:
    f = model.project(("returnflag", "discount"))
    return framed(spark, f.normalize(1.0), 4)


@query("decomposable_mle", RATIO_SQL)
def decomposable_mle(spark, sf):
    mu = chain_vectors(spark, sf)
    return shared_answer(spark, fit.decomposable_mle(mu, float(mu[BC].values.sum())))


def exact_measurements(spark, sf) -> list[Measurement]:
    """Noiseless shares of the chain's marginals."""
    mu = chain_vectors(spark, sf)
    n = float(mu[BC].values.sum())
    return [Measurement(f.values.ravel() / n, c, 1.0) for c, f in mu.items()]


@query("mirror_descent_recovery", RATIO_SQL)
def mirror_descent_recovery(spark, sf):
    return shared_answer(spark, fit.mirror_descent(S, exact_measurements(spark, sf), iters=2000))


@query("lbfgs_recovery", RATIO_SQL)
def lbfgs_recovery(spark, sf):
    return shared_answer(spark, fit.lbfgs(S, exact_measurements(spark, sf), iters=500))


@query("mle_recovery", RATIO_SQL)
def mle_recovery(spark, sf):
    return shared_answer(spark, fit.mle_from_marginals(chain_vectors(spark, sf).normalize(1, log=False), 1.0, iters=500))


@query("dual_averaging_recovery", RATIO_SQL)
def dual_averaging_recovery(spark, sf):
    return shared_answer(spark, fit.dual_averaging(S, exact_measurements(spark, sf), iters=1000))


@query("interior_gradient_recovery", RATIO_SQL)
def interior_gradient_recovery(spark, sf):
    return shared_answer(spark, fit.interior_gradient(S, exact_measurements(spark, sf), iters=1000))


@query("universal_recovery", RATIO_SQL)
def universal_recovery(spark, sf):
    return shared_answer(spark, fit.universal_accelerated(S, exact_measurements(spark, sf), iters=1000))


@query("region_propagation_recovery", f"{WITH_AB_BC} SELECT linestatus, linenumber, round(value / sum(value) OVER (), 4) AS value FROM bc")
def region_propagation_recovery(spark, sf):
    """Pseudo-marginals fit what was measured; they promise nothing beyond it."""
    model = fit.mirror_descent(S, exact_measurements(spark, sf), stateful=fit.approximate, stepsize=1.0, iters=1000)
    return framed(spark, model.marginals[BC], 4)


# -- workloads -----------------------------------------------------------------------------------------------


@query("prefix_workload", f"WITH {L6}, q AS {dense_sql('linestatus', 'quantity')} SELECT linestatus, quantity, sum(value) OVER (PARTITION BY linestatus ORDER BY quantity) AS value FROM q")
def prefix_workload(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("linestatus").orderBy("quantity").rowsBetween(Window.unboundedPreceding, 0)
    return cube(spark, sf, "linestatus", "quantity").df.withColumn("value", F.sum("value").over(w))


@query("kron_answers", f"{JOINT_SQL} SELECT CAST(a.range AS INTEGER) AS linestatus, CAST(b.range AS INTEGER) AS linenumber, round(1000 * sum(p) FILTER (WHERE linestatus <= a.range AND linenumber <= b.range) / any_value(t), 6) AS value FROM j, t, range(2) a, range(7) b GROUP BY ALL")
def kron_answers(spark, sf):
    prefix = {a: np.tril(np.ones((S[a], S[a]))) for a in BC}
    return framed(spark, K.kron_query(potentials(spark, sf), prefix, 1000))


@query("pairwise_conditional", f"{JOINT_SQL}, m AS (SELECT linestatus, linenumber, sum(p) AS p FROM j GROUP BY ALL) SELECT linestatus, linenumber, round(p / sum(p) OVER (PARTITION BY linestatus), 6) AS value FROM m")
def pairwise_conditional(spark, sf):
    m = model_of(spark, sf).project(BC)
    return framed(spark, m / m.project("linestatus"))


@query("workload_error", f"""WITH {L6}, o AS (SELECT * FROM l6 WHERE linenumber < 3), x AS ({union_sql(CHAIN).removeprefix(f"WITH {L6} ")}), y AS ({union_sql(CHAIN).removeprefix(f"WITH {L6} ").replace("FROM l6", "FROM o")}),
    z AS (SELECT clique_id, x.value AS a, y.value AS b, sum(x.value) OVER (PARTITION BY clique_id) AS ta, sum(y.value) OVER (PARTITION BY clique_id) AS tb FROM x JOIN y USING (clique_id, cell))
    SELECT clique_id, round(0.5 * sum(abs(a / ta - b / tb)), 6) AS half_l1, round(sum(abs(a - b)) / any_value(ta), 6) AS relative_l1, max(abs(a - b)) AS largest FROM z GROUP BY clique_id""")  # fmt: skip
def workload_error(spark, sf):
    rows = lines(spark, sf)
    some = rows.where("linenumber < 3")
    e = cubes.workload_error(cubes.multi(rows, CHAIN), cubes.multi(some, CHAIN))
    return rounded(rounded(e, column="half_l1"), column="relative_l1")


@query("primal_feasibility", f"""{WITH_AB_BC}, s AS (SELECT linestatus, sum(value) AS x FROM ab GROUP BY 1), u AS (SELECT linestatus, sum(2 * value) AS y FROM bc GROUP BY 1)
    SELECT round(sum(abs(x - y)) / (0.5 * sum(x) + 0.5 * sum(y)), 6) AS value FROM s JOIN u USING (linestatus)""")  # fmt: skip
def primal_feasibility_query(spark, sf):
    v = Long.measured(lines(spark, sf), CHAIN[:2])
    doubled = v._map(F.when(F.col("clique_id") == 1, F.col("value") * 2).otherwise(F.col("value")))
    return rounded(feasibility(doubled))


# -- noise, measurement and selection ---------------------------------------------------------------------------


@query("laplace_measure", f"""{WITH_AB_BC}, u AS (SELECT *, {uniform_sql('lap', 'linestatus * 7 + linenumber')} - 0.5 AS u FROM bc)
    SELECT linestatus, linenumber, round(value - 10 * sign(u) * ln(1 - 2 * abs(u)), 6) AS value FROM u""")  # fmt: skip
def laplace_measure(spark, sf):
    key = F.col("linestatus") * 7 + F.col("linenumber")
    return rounded(cube(spark, sf, *BC).df.withColumn("value", F.col("value") + laplace("lap", key, 10.0)))


@query("gaussian_measure", f"""{WITH_AB_BC} SELECT linestatus, linenumber, round(value + 25 * sqrt(-2 * ln({uniform_sql('g:1', 'linestatus * 7 + linenumber')})) * cos(2 * pi() * {uniform_sql('g:2', 'linestatus * 7 + linenumber')}), 6) AS value FROM bc""")
def gaussian_measure(spark, sf):
    key = F.col("linestatus") * 7 + F.col("linenumber")
    return rounded(cube(spark, sf, *BC).df.withColumn("value", F.col("value") + gaussian("g", key, 25.0)))


@query("total_estimate", f"""WITH {L6}, v AS ({VECTOR_SQL}), y AS (SELECT clique_id, value + 5 * ({uniform_sql('tot', "(clique_id || '/' || cell)")} - 0.5) AS y FROM v),
    m AS (SELECT clique_id, sum(y) AS s, 1 / ((clique_id + 1) * (clique_id + 1) * count(*)) AS w FROM y GROUP BY clique_id) SELECT round(greatest(1.0, sum(w * s) / sum(w)), 6) AS total FROM m""")  # fmt: skip
def total_estimate_query(spark, sf):
    v = Long.measured(lines(spark, sf), CHAIN).df
    key = F.concat_ws("/", F.col("clique_id").cast("string"), F.col("cell").cast("string"))
    answers = v.select(F.col("clique_id").alias("m_id"), F.col("cell").alias("i"), (F.col("value") + 5 * (uniform("tot", key) - 0.5)).alias("y"))
    headers = spark.range(3).select(F.col("id").cast("int").alias("m_id"), (F.col("id") + 1.0).alias("stddev"))
    return rounded(total_estimate(answers, headers), column="total")


@query("exponential_select", f"""WITH {L6}, q AS (SELECT quantity, CAST(count(*) AS DOUBLE) AS n FROM l6 GROUP BY 1), s AS (SELECT quantity, 0.5 * 0.02 * n - ln(-ln({uniform_sql('em', 'quantity')})) AS noisy FROM q)
    SELECT arg_max(quantity, noisy) AS quantity, round(max(noisy), 6) AS noisy FROM s""")  # fmt: skip
def exponential_select(spark, sf):
    q = cubes.sparse(lines(spark, sf), "quantity")
    return rounded(privacy.select_one(q, "quantity", "value", 0.02, 1.0, "em"), column="noisy")


@query("permute_and_flip_select", f"""WITH {L6}, q AS (SELECT quantity, CAST(count(*) AS DOUBLE) AS n FROM l6 GROUP BY 1), s AS (SELECT quantity, 0.5 * 0.02 * n - ln({uniform_sql('pf', 'quantity')}) AS noisy FROM q)
    SELECT arg_max(quantity, noisy) AS quantity, round(max(noisy), 6) AS noisy FROM s""")  # fmt: skip
def permute_and_flip_select(spark, sf):
    q = cubes.sparse(lines(spark, sf), "quantity")
    return rounded(privacy.select_one(q, "quantity", "value", 0.02, 1.0, "pf", "exponential"), column="noisy")


@query("gumbel_topk", f"""WITH {L6}, q AS (SELECT quantity, CAST(count(*) AS DOUBLE) AS value FROM l6 GROUP BY 1)
    SELECT quantity, value, round(0.5 * 0.02 * value - ln(-ln({uniform_sql('top', 'quantity')})), 6) AS noisy FROM q ORDER BY noisy DESC LIMIT 5""")  # fmt: skip
def gumbel_topk(spark, sf):
    q = cubes.sparse(lines(spark, sf), "quantity")
    return rounded(privacy.select_top(q, "quantity", "value", 5, 0.02, 1.0, "top"), column="noisy")


@query("pareto_skyline", """WITH p AS (SELECT p_size, max(p_retailprice) AS quality, CAST(p_size AS DOUBLE) AS sensitivity FROM part GROUP BY p_size)
    SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.sensitivity <= p.sensitivity AND q.quality >= p.quality AND (q.sensitivity < p.sensitivity OR q.quality > p.quality))""")  # fmt: skip
def pareto_skyline(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet").groupBy("p_size").agg(F.max("p_retailprice").alias("quality"))
    return privacy.skyline_rows(p.withColumn("sensitivity", F.col("p_size").cast("double"))).select("p_size", "quality", "sensitivity")


@query("em_scores", """WITH p AS (SELECT p_size, max(p_retailprice) AS q, CAST(p_size AS DOUBLE) AS d FROM part GROUP BY p_size), r AS (SELECT *, 3 * d - q AS r FROM p)
    SELECT a.p_size, round(-max((a.r - b.r) / (a.d + b.d)), 6) AS score FROM r a CROSS JOIN r b GROUP BY a.p_size""")  # fmt: skip
def em_scores(spark, sf):
    rows = spark.read.parquet(f"{sf}/part.parquet").groupBy("p_size").agg(F.max("p_retailprice").alias("q")).collect()
    scores = privacy.generalized_scores([r.q for r in rows], [float(r.p_size) for r in rows], 3.0)
    return spark.createDataFrame([(r.p_size, round(float(s), 6)) for r, s in zip(rows, scores, strict=True)], "p_size int, score double")


@query("l1_l2_loss", f"""WITH {L6}, v AS ({VECTOR_SQL}), y AS (SELECT value, value + 5 * ({uniform_sql('loss', "(clique_id || '/' || cell)")} - 0.5) AS y FROM v)
    SELECT round(sum(abs(value - y) / 2), 5) AS l1, round(sum((value - y) * (value - y) / 4), 5) AS l2 FROM y""")  # fmt: skip
def l1_l2_loss(spark, sf):
    v = Long.measured(lines(spark, sf), CHAIN)
    key = F.concat_ws("/", F.col("clique_id").cast("string"), F.col("cell").cast("string"))
    noisy = cubes.vectors(v._map(F.col("value") + 5 * (uniform("loss", key) - 0.5)).df, CHAIN, S)
    ms = [Measurement(y, c, 2.0) for c, y in zip(CHAIN, noisy, strict=True)]
    mu = chain_vectors(spark, sf)
    return spark.createDataFrame([(round(linear_loss(ms, norm="l1")(mu), 5), round(linear_loss(ms)(mu), 5))], "l1 double, l2 double")


@query("compress_domain", f"""WITH {L6}, c AS (SELECT quantity, count(*) AS n FROM l6 GROUP BY 1), k AS (SELECT quantity, row_number() OVER (ORDER BY quantity) - 1 AS code FROM c WHERE n >= (SELECT avg(n) FROM c))
    SELECT CAST(coalesce(k.code, (SELECT count(*) FROM k)) AS INTEGER) AS quantity, count(*) AS n FROM l6 LEFT JOIN k USING (quantity) GROUP BY 1""")  # fmt: skip
def compress_domain(spark, sf):
    rows = lines(spark, sf).select("quantity")
    y = cubes.vectors(cubes.multi(rows, [("quantity",)]), [("quantity",)], S.project("quantity"))[0]
    merged = Compression(S.project("quantity"), [Measurement(y, ("quantity",), float(y[y > 0].mean()) / 3.0)])
    return merged.apply(rows).groupBy("quantity").agg(F.count(F.lit(1)).alias("n"))


# -- rows from models and rows re-weighted --------------------------------------------------------------------------


@query("synth_round", f"""WITH {L6}, p AS (SELECT linenumber, count(*) * 1.0 / sum(count(*)) OVER () AS p FROM l6 GROUP BY 1), x AS (SELECT linenumber, 1000 * p AS x, floor(1000 * p) AS w FROM p),
    r AS (SELECT *, x - w AS frac, 1000 - sum(w) OVER () AS k, row_number() OVER (ORDER BY CASE WHEN x - w > 0 THEN -ln({uniform_sql('one:extra', 'linenumber')}) / (x - w) END NULLS LAST, linenumber) AS place FROM x)
    SELECT linenumber AS code, CAST(w + CASE WHEN place <= k THEN 1 ELSE 0 END AS BIGINT) AS n FROM r WHERE w + CASE WHEN place <= k THEN 1 ELSE 0 END > 0""")  # fmt: skip
def synth_round(spark, sf):
    v = cubes.vectors(cubes.multi(lines(spark, sf), [("linenumber",)]), [("linenumber",)], S)[0]
    table = spark.createDataFrame([(k, float(x / v.sum())) for k, x in enumerate(v)], "code int, p double")
    rows = synth.round_column(spark.range(1000), table, "code_out", (), "one", buckets=3)
    return rows.groupBy(F.col("code_out").alias("code")).agg(F.count(F.lit(1)).alias("n"))


@query("synth_sample", f"""WITH {L6}, p AS (SELECT linenumber, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM l6) AS p FROM l6 GROUP BY 1), c AS (SELECT linenumber, sum(p) OVER (ORDER BY linenumber) AS e, p FROM p)
    SELECT linenumber AS code, count(*) AS n FROM range(5000) r JOIN c ON {uniform_sql('two:draw', 'r.range')} < e AND {uniform_sql('two:draw', 'r.range')} >= e - p GROUP BY 1""")  # fmt: skip
def synth_sample(spark, sf):
    v = cubes.vectors(cubes.multi(lines(spark, sf), [("linenumber",)]), [("linenumber",)], S)[0]
    table = spark.createDataFrame([(k, float(x / v.sum())) for k, x in enumerate(v)], "code int, p double")
    rows = synth.sample_column(spark.range(5000), table, "code_out", (), "two")
    return rows.groupBy(F.col("code_out").alias("code")).agg(F.count(F.lit(1)).alias("n"))


@query("synthetic_rows")
def synthetic_rows(spark, sf):
    mu = chain_vectors(spark, sf)
    model = fit.decomposable_mle(mu, float(mu[BC].values.sum()))
    return model.synthetic(spark, 20_000)


def public_rows(spark, sf) -> tuple[DataFrame, DataFrame]:
    raw = spark.read.parquet(f"{sf}/orders.parquet")
    return ORDERS.encode(raw.where("o_orderkey % 4 <> 0")), ORDERS.encode(raw.where("o_orderkey % 4 = 0"))


@query("public_support_step", """WITH o AS (SELECT CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS status, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1 AS priority, o_orderkey % 4 = 0 AS pub FROM orders),
    g AS (SELECT status, priority, count(*) FILTER (WHERE pub) * 1.0 / any_value(np) - count(*) FILTER (WHERE NOT pub) * 1.0 / any_value(nq) AS g
          FROM o, (SELECT count(*) FILTER (WHERE pub) AS np, count(*) FILTER (WHERE NOT pub) AS nq FROM o) GROUP BY ALL)
    SELECT status, priority, count(*) AS n, round(any_value(-2 * g), 6) AS log_weight FROM o JOIN g USING (status, priority) WHERE pub GROUP BY ALL""")  # fmt: skip
def public_support_step(spark, sf):
    private, public = public_rows(spark, sf)
    c = ("status", "priority")
    y = weighted_marginals(private.withColumn("weight", F.lit(1.0)), [c])[c].normalize(1.0)
    x = weighted_marginals(public.withColumn("weight", F.lit(1.0)), [c])[c].normalize(1.0)
    moved = shifted(public.withColumn("log_weight", F.lit(0.0)), K.Cliques(ORDERS.schema, {c: x - y}), 2.0)
    out = moved.groupBy("status", "priority").agg(F.count(F.lit(1)).alias("n"), F.first("log_weight").alias("log_weight"))
    return rounded(out, column="log_weight")


@query("public_support")
def public_support_query(spark, sf):
    private, public = public_rows(spark, sf)
    c = ("status", "priority")
    y = weighted_marginals(private.withColumn("weight", F.lit(1.0)), [c])[c]
    n = float(y.values.sum())
    loss = linear_loss([Measurement(y.values, c, n)], ORDERS.schema)
    out = public_support(public, loss, n, iters=8)
    return out.groupBy("status", "priority").agg(F.round(F.sum("weight"), 3).alias("weight"))


@query("mixture_of_products")
def mixture_of_products(spark, sf):
    ms = exact_measurements(spark, sf)
    m = fit_mixture(S.project(("returnflag", "linestatus", "linenumber", "discount")), linear_loss(ms), 1.0, components=8, iters=300, rate=0.1)
    return m.synthetic(spark, 10_000)


# -- mechanisms: rows only, randomness of their own -----------------------------------------------------------------


def narrow(spark, sf) -> DataFrame:
    return lines(spark, sf).select("returnflag", "linestatus", "linenumber", "discount")


@query("mst_synthetic")
def mst_synthetic(spark, sf):
    return MST(5.0, 1e-6, seed=1, iters=300).run(narrow(spark, sf))[1]


@query("aim_synthetic")
def aim_synthetic(spark, sf):
    return AIM(5.0, 1e-6, seed=2, iters=200, rounds=6).run(narrow(spark, sf), list(combinations(S.attrs[:4], 2)))[1]


@query("mwem_synthetic")
def mwem_synthetic(spark, sf):
    return MWEM(5.0, 1e-6, seed=3, iters=200, rounds=4).run(narrow(spark, sf), list(combinations(S.attrs[:4], 2)))[1]


@query("jam_synthetic")
def jam_synthetic(spark, sf):
    private, public = public_rows(spark, sf)
    return JAM(2.0, 1e-6, seed=4, iters=200, rounds=3).run(private, public, [("status", "priority")])[1]


@query("adaptive_grid_synthetic")
def adaptive_grid_synthetic(spark, sf):
    return AdaptiveGrid(5.0, 1e-6, seed=5, iters=300).run(narrow(spark, sf), targets=("returnflag",))[1]


@query("gaussian_approximate")
def gaussian_approximate(spark, sf):
    model = GaussianApproximate(5.0, 1e-6, seed=6, iters=200).run(narrow(spark, sf), list(combinations(S.attrs[:4], 2)), stepsize=1e-3)
    return rounded(factor_frame(spark, model.marginals["returnflag", "linestatus"]), 3)


@query("weighted_approximate")
def weighted_approximate(spark, sf):
    model = WeightedApproximate(5.0, 1e-6, seed=7, iters=200).run(narrow(spark, sf), CHAIN, weights=(1, 2, 1), stepsize=1e-3)
    return rounded(factor_frame(spark, model.marginals[BC]), 3)


# -- streaming -----------------------------------------------------------------------------------------------------

EVENTS = Encoder({"kind": ("event_type", Levels(("click", "error", "purchase", "signup", "view")))})


def _streamed(spark: SparkSession, plan: Callable[[DataFrame], DataFrame], source: DataFrame, path: str, name: str, mode: str) -> DataFrame:
    folder, _, file = path.rpartition("/")
    stream = spark.readStream.schema(source.schema).option("pathGlobFilter", file).parquet(folder)
    spark.sql(f"DROP VIEW IF EXISTS {name}")
    run = plan(stream).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(name)


@query("streaming_marginals", "SELECT 0 AS clique_id, CAST(CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS BIGINT) AS cell, CAST(count(*) AS DOUBLE) AS value FROM events GROUP BY 1, 2")
def streaming_marginals(spark, sf):
    path = f"{sf}/events.parquet"
    plan = lambda s: running_marginals(EVENTS.encode(s, on_invalid="drop"), [("kind",)])
    return _streamed(spark, plan, spark.read.parquet(path), path, "cubiform_running", "complete")


@query("streaming_windows", """SELECT date_trunc('day', ts) AS start, CAST(CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS BIGINT) AS cell,
    CAST(count(*) AS DOUBLE) AS value FROM events GROUP BY 1, 2""")  # fmt: skip
def streaming_windows(spark, sf):
    path = f"{sf}/events.parquet"

    def plan(s: DataFrame) -> DataFrame:
        coded = s.select(F.col("ts").cast("timestamp").alias("ts"), EVENTS.columns["kind"][1].code(F.col("event_type")).alias("kind"))
        return windowed_marginals(coded, ("kind",), "ts", "1 day", "0 seconds", EVENTS.schema)

    out = _streamed(spark, plan, spark.read.parquet(path), path, "cubiform_windows", "complete")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))
