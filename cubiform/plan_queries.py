"""Queries over schemas, clique planning and accounting, and property checks of randomised mechanisms.

Plans are model-sized and worked out on the driver; their equivalents take cardinalities from the tables. A
randomised mechanism's rows have no fixed values, so its check says per attribute how many records the data has,
and whether the mechanism's share of every value is as close as its noise allows.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import queries as Q
from .functions import privacy
from .plans import cliques as C
from .plans.schema import Schema
from .queries import CHAIN, ORDERS, S, query

#: Cardinalities of the encoded lines, in DuckDB.
SIZES = """sizes AS (SELECT unnest(['returnflag', 'linestatus', 'linenumber', 'discount', 'tax', 'quantity']) AS attr, unnest([1, 2, 3, 4, 5, 6]) AS place,
    unnest([count(DISTINCT l_returnflag), count(DISTINCT l_linestatus), count(DISTINCT l_linenumber), count(DISTINCT round(l_discount * 100)), count(DISTINCT round(l_tax * 100)), count(DISTINCT round(l_quantity))]) AS n FROM lineitem)"""
CYCLE = [*CHAIN, ("discount", "returnflag")]


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _named(attrs) -> str:
    return ",".join(attrs)


def _values(columns: str, rows: list[tuple]) -> str:
    return f"SELECT * FROM (VALUES {', '.join(f'({", ".join(map(str, r))})' for r in rows)}) t({columns})"


@query("schema_sizes", f"WITH {SIZES} SELECT a.attr || ',' || b.attr AS attrs, CAST(a.n * b.n AS BIGINT) AS cells, CAST(b.n AS BIGINT) AS stride FROM sizes a JOIN sizes b ON a.place < b.place")
def schema_sizes(spark, sf):
    return _rows(spark, [(_named(c), S.size(c), S.strides(c)[0]) for c in combinations(S.attrs, 2)], "attrs string, cells long, stride long")


@query("schema_config", f"WITH {SIZES} SELECT attr, CAST(place - 1 AS BIGINT) AS axis, CAST(n AS BIGINT) AS cardinality FROM sizes")
def schema_config(spark, sf):
    again = Schema.from_json(S.to_json())
    kept = Schema.from_struct(again.to_struct())
    return _rows(spark, [(a, S.axes((a,))[0], n) for a, n in Schema.of(kept.config).config.items()], "attr string, axis long, cardinality long")


@query("schema_algebra", _values("operation, result", [
    ("'project'", "'tax,returnflag'"), ("'marginalize'", "'returnflag,linenumber,quantity'"), ("'invert'", "'returnflag,linenumber,quantity'"), ("'canonical'", "'linestatus,tax'"),
    ("'intersect'", "'linestatus,discount'"), ("'merge'", "'linestatus,discount,tax'"), ("'contains'", "'true'"), ("'supports'", "'false'"), ("'attribute'", "'true'")]))
def schema_algebra(spark, sf):
    some, other = S.project(("linestatus", "discount")), S.project(("discount", "tax"))
    gone = ("discount", "linestatus", "tax")
    rows = [
        ("project", _named(S.project(("tax", "returnflag")).attrs)),
        ("marginalize", _named(S.marginalize(gone).attrs)),
        ("invert", _named(S.invert(gone))),
        ("canonical", _named(S.canonical(("tax", "linestatus")))),
        ("intersect", _named(S.intersect(some).attrs)),
        ("merge", _named(some.merge(other).attrs)),
        ("contains", str(S.contains(other)).lower()),
        ("supports", str(some.supports(("tax",))).lower()),
        ("attribute", str("tax" in S).lower()),
    ]
    return _rows(spark, rows, "operation string, result string")


@query("kway_cliques", f"WITH {SIZES} SELECT a.attr || ',' || b.attr AS clique, CAST(a.n * b.n AS BIGINT) AS cells FROM sizes a JOIN sizes b ON a.place < b.place WHERE a.n * b.n <= 100")
def kway_cliques(spark, sf):
    return _rows(spark, [(_named(c), S.size(c)) for c in C.k_way(S, 2, 100)], "clique string, cells long")


@query("clique_mapping", _values("clique, home", [("'a,b'", "'a,b,c'"), ("'b,c'", "'a,b,c'"), ("'a,b,c'", "'a,b,c'"), ("'d'", "'c,d'"), ("'c,d'", "'c,d'")]))
def clique_mapping(spark, sf):
    every = [("a", "b"), ("b", "c"), ("a", "b", "c"), ("d",), ("c", "d")]
    top = C.maximal_subset(every)
    there, back = C.clique_mapping(top, every), C.reverse_clique_mapping(top, every)
    assert all(c in back[home] for c, home in there.items())
    return _rows(spark, [(_named(c), _named(home)) for c, home in there.items()], "clique string, home string")


@query("maximal_cliques", f"""WITH {SIZES}, c AS (SELECT a.attr || ',' || b.attr AS clique, a.n * b.n AS cells FROM sizes a, sizes b
    WHERE (a.attr, b.attr) IN (('returnflag', 'linestatus'), ('linestatus', 'linenumber'), ('linenumber', 'discount')) UNION ALL SELECT attr, n FROM sizes WHERE attr IN ('tax', 'quantity'))
    SELECT clique, CAST(cells AS BIGINT) AS cells FROM c""")  # fmt: skip
def maximal_cliques(spark, sf):
    """Cliques of the triangulated chain; attributes in no clique are their own."""
    return _rows(spark, [(_named(S.canonical(c)), S.size(c)) for c in C.junction_tree(S, CHAIN).cliques], "clique string, cells long")


@query("model_size", f"WITH {SIZES}, n AS (SELECT max(n) FILTER (WHERE attr = 'returnflag') AS a, max(n) FILTER (WHERE attr = 'linestatus') AS b, max(n) FILTER (WHERE attr = 'linenumber') AS c, max(n) FILTER (WHERE attr = 'discount') AS d, max(n) FILTER (WHERE attr IN ('tax', 'quantity')) AS f, min(n) FILTER (WHERE attr IN ('tax', 'quantity')) AS e FROM sizes) SELECT CAST(a * b + b * c + c * d + e + f AS BIGINT) AS cells, round((a * b + b * c + c * d + e + f) * 8 / 1048576.0, 9) AS megabytes FROM n")
def model_size(spark, sf):
    return _rows(spark, [(C.junction_tree(S, CHAIN).cells(S), round(C.model_size_mb(S, CHAIN), 9))], "cells long, megabytes double")


@query("elimination_order", f"""WITH {SIZES}, f AS (SELECT attr, place, n FROM sizes),
    step(place, attr, cost) AS (VALUES (0, 'tax', 1), (1, 'quantity', 1), (2, 'returnflag', (SELECT n FROM f WHERE attr = 'returnflag') * (SELECT n FROM f WHERE attr = 'linestatus')),
        (3, 'linestatus', (SELECT n FROM f WHERE attr = 'linestatus') * (SELECT n FROM f WHERE attr = 'linenumber')), (4, 'linenumber', (SELECT n FROM f WHERE attr = 'linenumber') * (SELECT n FROM f WHERE attr = 'discount')), (5, 'discount', (SELECT n FROM f WHERE attr = 'discount')))
    SELECT CAST(place AS BIGINT) AS place, attr, CAST(sum(cost) OVER () AS BIGINT) AS total FROM step""")  # fmt: skip
def elimination_order(spark, sf):
    """The greedy order of the chain: attributes in no clique first, then whichever spans fewest cells."""
    order, total = C.greedy_order(S, CHAIN)
    return _rows(spark, [(k, a, total) for k, a in enumerate(order)], "place long, attr string, total long")


@query("junction_tree_edges", _values("separator", [("'linestatus'",), ("'linenumber'",)]))
def junction_tree_edges(spark, sf):
    tree = C.junction_tree(S, CHAIN)
    between = [_named(S.canonical(tree.separator(a, b))) for a, b in tree.edges]
    return _rows(spark, [(x,) for x in between if x], "separator string")


@query("triangulation", _values("attrs, cliques", [(3, "CAST(2 AS BIGINT)"), (1, "CAST(2 AS BIGINT)")]).replace("SELECT *", "SELECT CAST(attrs AS BIGINT) AS attrs, cliques"))
def triangulation(spark, sf):
    """Sizes of the cliques of a triangulated four-cycle and two lone attributes."""
    found = [len(c) for c in C.junction_tree(S, CYCLE).cliques]
    return _rows(spark, [(n, found.count(n)) for n in sorted(set(found))], "attrs long, cliques long")


@query("zcdp_accounting", """WITH t(eps, delta, rho) AS (VALUES (1.0, 1e-9, 0.0149730577), (1.0, 1e-10, 0.0132425838), (1.0, 1e-5, 0.0305565952))
    SELECT CAST(eps AS DOUBLE) AS eps, CAST(delta AS DOUBLE) AS delta, CAST(rho AS DOUBLE) AS rho, round(CAST(eps AS DOUBLE), 6) AS eps_back,
           round(log10(exp(-((eps - round(rho, 6)) ** 2) / (4 * round(rho, 6)))), 6) AS log_tail FROM t""")  # fmt: skip
def zcdp_accounting(spark, sf):
    import math

    rows = []
    for eps, delta in ((1.0, 1e-9), (1.0, 1e-10), (1.0, 1e-5)):
        rho = privacy.rho_of(eps, delta)
        rows.append((eps, delta, round(rho, 10), round(privacy.eps_of(rho, delta), 6), round(math.log10(privacy.delta_standard(round(round(rho, 10), 6), eps)), 6)))
    return _rows(spark, rows, "eps double, delta double, rho double, eps_back double, log_tail double")


# -- properties of randomised mechanisms -----------------------------------------------------------------------------


def close(real: DataFrame, made: DataFrame, attrs: tuple[str, ...], within: float) -> DataFrame:
    """``(attr, records, close)``: whether the shares of an attribute's values differ by ``within`` in sum at most."""
    unpivoted = lambda df, side: df.select(F.explode(F.array(*[F.struct(F.lit(a).alias("attr"), F.col(a).cast("int").alias("value")) for a in attrs])).alias("x"), F.lit(side).alias("side")).select("x.*", "side")
    counts = unpivoted(real, 0).unionByName(unpivoted(made, 1)).groupBy("attr", "value").agg(F.count_if(F.col("side") == 0).alias("p"), F.count_if(F.col("side") == 1).alias("q"))
    total = counts.groupBy("attr").agg(F.sum("p").alias("ps"), F.sum("q").alias("qs"))
    gap = counts.join(F.broadcast(total), "attr").groupBy("attr").agg(F.max("ps").alias("records"), F.sum(F.abs(F.col("p") / F.col("ps") - F.col("q") / F.greatest("qs", F.lit(1)))).alias("gap"))
    return gap.select("attr", "records", (F.col("gap") <= within).alias("close"))


LINES_CLOSE = "SELECT unnest(['returnflag', 'linestatus', 'linenumber', 'discount']) AS attr, count(*) AS records, true AS close FROM lineitem"
NARROW = ("returnflag", "linestatus", "linenumber", "discount")


def _property(name: str, of: str, within: float) -> None:
    @query(name, LINES_CLOSE)
    def check(spark, sf):
        return close(Q.narrow(spark, sf), Q.QUERIES[of](spark, sf), NARROW, within)


for _name, _of, _within in (
    ("synthetic_rows_close", "synthetic_rows", 0.05),
    ("mixture_rows_close", "mixture_of_products", 0.15),
    ("mst_close", "mst_synthetic", 0.05),
    ("aim_close", "aim_synthetic", 0.05),
    ("mwem_close", "mwem_synthetic", 0.5),
    ("adaptive_grid_close", "adaptive_grid_synthetic", 0.15),
):
    _property(_name, _of, _within)


@query("synthetic_size", "SELECT 'mst' AS mechanism, true AS size_close UNION ALL SELECT 'grid', true UNION ALL SELECT 'aim', true")
def synthetic_size(spark, sf):
    """Whether mechanisms make about as many rows as there are."""
    n = Q.narrow(spark, sf).count()
    made = [(k, Q.QUERIES[q](spark, sf).agg(F.count(F.lit(1)).alias("made"))) for k, q in (("mst", "mst_synthetic"), ("grid", "adaptive_grid_synthetic"), ("aim", "aim_synthetic"))]
    out = None
    for k, df in made:
        row = df.select(F.lit(k).alias("mechanism"), (F.abs(F.col("made") - n) <= 0.01 * n + 100).alias("size_close"))
        out = row if out is None else out.unionByName(row)
    return out


@query("public_support_close", """WITH o AS (SELECT CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS status, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1 AS priority FROM orders WHERE o_orderkey % 4 <> 0)
    SELECT status, priority, count(*) AS records, true AS close FROM o GROUP BY ALL""")  # fmt: skip
def public_support_close(spark, sf):
    """Whether re-weighted public rows have each cell of the private rows, to a hundredth of all."""
    private, _ = Q.public_rows(spark, sf)
    real = private.groupBy("status", "priority").agg(F.count(F.lit(1)).alias("records"))
    found = real.join(F.broadcast(Q.QUERIES["public_support"](spark, sf)), ["status", "priority"], "left")
    total = F.broadcast(real.agg(F.sum("records").alias("all")))
    return found.crossJoin(total).select("status", "priority", "records", (F.abs(F.col("records") - F.coalesce("weight", F.lit(0.0))) <= 0.01 * F.col("all")).alias("close"))


assert ORDERS.schema.attrs == ("status", "priority")
