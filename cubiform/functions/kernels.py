"""NumPy kernels for model-scale work: dense factors, exact and approximate marginal inference."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import lru_cache
from string import ascii_letters

import numpy as np

from ..plans.cliques import Clique, RegionGraph, Tree, greedy_order, junction_tree, region_graph
from ..plans.schema import Attrs, Schema, names


def lse(values: np.ndarray, axis: tuple[int, ...]) -> np.ndarray:
    """log of the sum of exponentials; cells that are all minus infinity stay so."""
    if not axis:
        return values
    top = values.max(axis=axis, keepdims=True)
    safe = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.squeeze(np.log(np.exp(values - safe).sum(axis=axis, keepdims=True)) + safe, axis=axis)


@dataclass(frozen=True)
class Factor:
    """A dense table over a schema; binary operations join on shared attributes."""

    schema: Schema
    values: np.ndarray

    def __post_init__(self):
        v = np.asarray(self.values, float)
        if v.shape != self.schema.sizes:
            v = v.reshape(self.schema.sizes)
        object.__setattr__(self, "values", v)

    @classmethod
    def zeros(cls, schema: Schema) -> Factor:
        return cls(schema, np.zeros(schema.sizes))

    @classmethod
    def ones(cls, schema: Schema) -> Factor:
        return cls(schema, np.ones(schema.sizes))

    @classmethod
    def random(cls, schema: Schema, seed: int = 0) -> Factor:
        return cls(schema, np.random.default_rng(seed).random(schema.sizes))

    def transpose(self, attrs: Attrs) -> Factor:
        attrs = names(attrs)
        if set(attrs) != set(self.schema.attrs) or len(attrs) != len(self.schema):
            raise ValueError("attributes must be a permutation of the factor's own")
        return Factor(self.schema.project(attrs), self.values.transpose(self.schema.axes(attrs)))

    def _spread(self, schema: Schema) -> np.ndarray:
        """Values with an axis for each attribute of ``schema``, of length 1 where it is new."""
        inside = tuple(a for a in schema.attrs if a in self.schema)
        moved = self.values.transpose(self.schema.axes(inside))
        return moved.reshape(tuple(self.schema[a] if a in self.schema else 1 for a in schema.attrs))

    def expand(self, schema: Schema) -> Factor:
        if not schema.contains(self.schema):
            raise ValueError("the new schema must hold all attributes")
        return Factor(schema, np.broadcast_to(self._spread(schema), schema.sizes).copy())

    def reduce(self, how: Callable, attrs: Attrs | None = None) -> Factor:
        attrs = self.schema.attrs if attrs is None else self.schema.canonical(attrs)
        return Factor(self.schema.marginalize(attrs), how(self.values, self.schema.axes(attrs)))

    def sum(self, attrs: Attrs | None = None) -> Factor:
        return self.reduce(lambda v, ax: v.sum(axis=ax), attrs)

    def max(self, attrs: Attrs | None = None) -> Factor:
        return self.reduce(lambda v, ax: v.max(axis=ax), attrs)

    def logsumexp(self, attrs: Attrs | None = None) -> Factor:
        return self.reduce(lse, attrs)

    def project(self, attrs: Attrs, log: bool = False) -> Factor:
        """Onto ``attrs`` in their order, summing (or log-summing) the rest."""
        attrs = names(attrs)
        gone = self.schema.invert(self.schema.project(attrs).attrs)
        return (self.logsumexp(gone) if log else self.sum(gone)).transpose(attrs)

    def exp(self) -> Factor:
        return Factor(self.schema, np.exp(self.values))

    def log(self) -> Factor:
        with np.errstate(divide="ignore"):
            return Factor(self.schema, np.log(self.values))

    def normalize(self, total: float = 1.0, log: bool = False) -> Factor:
        if log:
            return Factor(self.schema, self.values + np.log(total) - lse(self.values, tuple(range(len(self.schema)))))
        return Factor(self.schema, self.values * total / self.values.sum())

    def _with(self, other: Factor | float, how: Callable) -> Factor:
        if not isinstance(other, Factor):
            return Factor(self.schema, how(self.values, other))
        both = self.schema.merge(other.schema)
        with np.errstate(divide="ignore", invalid="ignore"):
            return Factor(both, np.broadcast_to(how(self._spread(both), other._spread(both)), both.sizes))

    def __add__(self, other):
        return self._with(other, np.add)

    def __sub__(self, other):
        return self._with(other, np.subtract)

    def __mul__(self, other):
        return self._with(other, np.multiply)

    def __truediv__(self, other):
        return self._with(other, np.divide)

    __radd__, __rmul__ = __add__, __mul__

    def __rsub__(self, other):
        return Factor(self.schema, other - self.values)

    def dot(self, other: Factor) -> float:
        if self.schema != other.schema:
            raise ValueError("schemas differ")
        return float((self.values * other.values).sum())

    def datavector(self, flatten: bool = True) -> np.ndarray:
        return self.values.ravel() if flatten else self.values

    def supports(self, attrs: Attrs) -> bool:
        return self.schema.supports(attrs)

    def __float__(self) -> float:
        if len(self.schema):
            raise ValueError("only a factor without attributes is a number")
        return float(self.values)


class Cliques(dict):
    """A vector of factors by clique, with the operations of a vector space."""

    def __init__(self, schema: Schema, factors: Mapping[Clique, Factor]):
        super().__init__(factors)
        self.schema = schema

    @classmethod
    def build(cls, schema: Schema, cliques: Iterable[Clique], make: Callable[[Schema], Factor]) -> Cliques:
        cliques = list(cliques)
        if len(set(cliques)) != len(cliques):
            raise ValueError("cliques must be unique")
        return cls(schema, {c: make(schema.project(c)) for c in cliques})

    @classmethod
    def zeros(cls, schema: Schema, cliques: Iterable[Clique]) -> Cliques:
        return cls.build(schema, cliques, Factor.zeros)

    @classmethod
    def ones(cls, schema: Schema, cliques: Iterable[Clique]) -> Cliques:
        return cls.build(schema, cliques, Factor.ones)

    @classmethod
    def random(cls, schema: Schema, cliques: Iterable[Clique], seed: int = 0) -> Cliques:
        rng = np.random.default_rng(seed)
        return cls.build(schema, cliques, lambda s: Factor(s, rng.random(s.sizes)))

    @classmethod
    def of(cls, data, cliques: Iterable[Clique]) -> Cliques:
        """Measured on anything with ``schema`` and ``project``."""
        return cls(data.schema, {c: data.project(c) for c in cliques})

    @property
    def active(self) -> Schema:
        used = {a for c in self for a in c}
        return self.schema.project(self.schema.canonical(used))

    def parent(self, clique: Clique) -> Clique | None:
        return next((c for c in self if set(clique) <= set(c)), None)

    def supports(self, clique: Clique) -> bool:
        return self.parent(clique) is not None

    def project(self, clique: Attrs, log: bool = False) -> Factor:
        clique = names(clique)
        home = self.parent(clique)
        if home is None:
            raise ValueError(f"{clique} is inside no clique")
        return self[home].project(clique, log)

    def expand(self, cliques: Sequence[Clique]) -> Cliques:
        """Each factor added to the first new clique that contains it; others are dropped."""
        out = Cliques.zeros(self.schema, cliques)
        for c, f in self.items():
            home = out.parent(c)
            if home is not None:
                out[home] = Factor(out[home].schema, out[home].values + f._spread(out[home].schema))
        return out

    def contract(self, cliques: Iterable[Clique], log: bool = False) -> Cliques:
        return Cliques(self.schema, {c: self.project(c, log) for c in cliques})

    def map(self, how: Callable[[Factor], Factor]) -> Cliques:
        return Cliques(self.schema, {c: how(f) for c, f in self.items()})

    def normalize(self, total: float = 1.0, log: bool = True) -> Cliques:
        return self.map(lambda f: f.normalize(total, log))

    def exp(self) -> Cliques:
        return self.map(Factor.exp)

    def log(self) -> Cliques:
        return self.map(Factor.log)

    def _with(self, other, how: Callable) -> Cliques:
        if isinstance(other, Cliques):
            if list(self) != list(other):
                raise ValueError("clique lists differ")
            return Cliques(self.schema, {c: how(f, other[c]) for c, f in self.items()})
        return self.map(lambda f: how(f, other))

    def __add__(self, other):
        return self._with(other, lambda a, b: a + b)

    def __sub__(self, other):
        return self._with(other, lambda a, b: a - b)

    def __mul__(self, other: float):
        return self._with(other, lambda a, b: a * b)

    __rmul__ = __mul__

    def dot(self, other: Cliques) -> float:
        return sum(f.dot(other[c]) for c, f in self.items())

    def cells(self) -> int:
        return sum(self.schema.size(c) for c in self)


# -- exact inference -------------------------------------------------------------------------------


@lru_cache(maxsize=256)
def _tree(schema: Schema, cliques: tuple[Clique, ...]) -> Tree:
    return junction_tree(schema, cliques)


def _total(values: Factor, total: float) -> Factor:
    return values.normalize(total, log=True).exp()


def brute_force(potentials: Cliques, total: float = 1.0) -> Cliques:
    """All marginals of the full joint; for small schemas."""
    joint = Factor.zeros(potentials.active)
    for f in potentials.values():
        joint = joint + f
    joint = _total(joint, total)
    return potentials.map(lambda f: joint.project(f.schema.attrs))


def sum_product(factors: Sequence[Factor], keep: Schema) -> Factor:
    """Product of factors summed onto ``keep``, eliminating the cheapest attribute first."""
    whole = keep
    for f in factors:
        whole = whole.merge(f.schema)
    gone = whole.invert(keep.attrs)
    order, _ = greedy_order(whole, [f.schema.attrs for f in factors], eliminate=gone)
    pool = list(factors)
    for a in order:
        mine, pool = [f for f in pool if a in f.schema], [f for f in pool if a not in f.schema]
        made = mine[0]
        for f in mine[1:]:
            made = made * f
        pool.append(made.sum(a))
    out = Factor.ones(keep)
    for f in pool:
        out = out * f
    return out.transpose(keep.attrs)


def log_sum_product(factors: Sequence[Factor], keep: Schema) -> Factor:
    """``sum_product`` of exponentials, as a logarithm, with each factor shifted by its largest value."""
    tops = [float(f.values.max()) if f.values.size else 0.0 for f in factors]
    tops = [t if np.isfinite(t) else 0.0 for t in tops]
    return sum_product([(f - t).exp() for f, t in zip(factors, tops, strict=True)], keep).log() + sum(tops)


def log_sum_product_stable(factors: Sequence[Factor], keep: Schema) -> Factor:
    """The same through the whole product in log space."""
    joint = Factor.zeros(keep)
    for f in factors:
        joint = joint + f
    return joint.project(keep.attrs, log=True)


def einsum_marginals(potentials: Cliques, total: float = 1.0) -> Cliques:
    """One sum-product per clique."""
    factors = list(potentials.values())
    return potentials.map(lambda f: _total(log_sum_product(factors, f.schema), total))


def belief_propagation(potentials: Cliques, total: float = 1.0, tree: Tree | None = None) -> Cliques:
    """Belief update on the junction tree's own tables: stable, with the memory of the largest clique."""
    schema = potentials.active
    tree = tree or _tree(schema, tuple(potentials))
    belief = [Factor.zeros(schema.project(c)) for c in tree.cliques]
    homes = {c: next(k for k, t in enumerate(tree.cliques) if set(c) <= set(t)) for c in potentials}
    for c, f in potentials.items():
        k = homes[c]
        belief[k] = Factor(belief[k].schema, belief[k].values + f._spread(belief[k].schema))
    sent: dict[tuple[int, int], Factor] = {}
    for a, b in tree.messages:
        from_ = belief[a] - sent[b, a] if (b, a) in sent else belief[a]
        message = from_.project(tree.separator(a, b), log=True)
        sent[a, b] = message
        belief[b] = Factor(belief[b].schema, (belief[b] + message).transpose(belief[b].schema.attrs).values)
    done = {k: _total(belief[k], total) for k in set(homes.values())}
    return Cliques(potentials.schema, {c: done[homes[c]].project(c) for c in potentials})


@dataclass(frozen=True)
class _Product:
    """A compiled sum of a product: each step multiplies some operands and sums an attribute out of them.

    Operands are numbered from the inputs on; a step's result takes the next number.
    """

    steps: tuple[tuple[tuple[int, ...], str], ...]
    sizes: tuple[int, ...]  # of attributes that no operand has, to which the result is spread
    shape: tuple[int, ...]

    @classmethod
    def of(cls, schema: Schema, operands: Sequence[Clique], keep: Clique) -> _Product:
        pool = dict(enumerate(map(tuple, operands)))
        held = {a for c in pool.values() for a in c}
        order, _ = greedy_order(schema, pool.values(), eliminate=[a for a in held if a not in keep])
        steps, new = [], len(pool)

        def join(which: list[int], out: Clique) -> None:
            nonlocal new
            letter = {a: ascii_letters[k] for k, a in enumerate(dict.fromkeys(a for k in which for a in pool[k]))}
            word = lambda c: "".join(letter[a] for a in c)
            steps.append((tuple(which), ",".join(word(pool[k]) for k in which) + "->" + word(out)))
            for k in which:
                del pool[k]
            pool[new] = out
            new += 1

        for a in order:
            mine = [k for k, c in pool.items() if a in c]
            join(mine, schema.canonical({x for k in mine for x in pool[k]} - {a}))
        join(list(pool), tuple(a for a in keep if a in held))
        return cls(tuple(steps), tuple(schema[a] if a in held else 1 for a in keep), tuple(schema[a] for a in keep))

    def __call__(self, operands: list[np.ndarray]) -> np.ndarray:
        pool = list(operands)
        for which, formula in self.steps:
            pool.append(np.einsum(formula, *[pool[k] for k in which]))
        return np.broadcast_to(pool[-1].reshape(self.sizes), self.shape)


@lru_cache(maxsize=256)
def _messages(schema: Schema, cliques: tuple[Clique, ...]) -> tuple:
    """Compiled messages ``(key, inputs, messages in, product)`` and beliefs of a clique structure."""
    tree = _tree(schema, cliques)
    home = {c: next(k for k, t in enumerate(tree.cliques) if set(c) <= set(t)) for c in cliques}
    inputs = [[i for i, c in enumerate(cliques) if home[c] == k] for k in range(len(tree.cliques))]
    sent, messages = set(), []
    for a, b in tree.messages:
        keep = tree.separator(a, b)
        if keep:
            into = [(n, a) for n in tree.around[a] if n != b and (n, a) in sent]
            parts = [cliques[i] for i in inputs[a]] + [tree.separator(*m) for m in into]
            messages.append(((a, b), tuple(inputs[a]), tuple(into), _Product.of(schema, parts, keep) if parts else schema.project(keep).sizes))
            sent.add((a, b))
    beliefs = []
    for c in cliques:
        k = home[c]
        into = [(n, k) for n in tree.around[k] if (n, k) in sent]
        parts = [cliques[i] for i in inputs[k]] + [tree.separator(*m) for m in into]
        beliefs.append((tuple(inputs[k]), tuple(into), _Product.of(schema, parts, c)))
    return messages, beliefs


def shafer_shenoy(potentials: Cliques, total: float = 1.0) -> Cliques:
    """Messages as sum-products of the factors themselves: tables of whole tree cliques are never made.

    The sequence of contractions is compiled once for a clique structure; values are shifted by their largest
    before they leave log space, and every message is scaled to a largest value of 1.
    """
    messages, beliefs = _messages(potentials.active, tuple(potentials))
    values = []
    for f in potentials.values():
        top = f.values.max()
        values.append(np.exp(f.values - (top if np.isfinite(top) else 0.0)))
    sent: dict[tuple[int, int], np.ndarray] = {}
    for key, inputs, into, product in messages:
        if isinstance(product, tuple):
            sent[key] = np.ones(product)
            continue
        m = product([values[i] for i in inputs] + [sent[k] for k in into])
        top = m.max()
        sent[key] = m / top if top > 0 else m
    out = {}
    for (c, f), (inputs, into, product) in zip(potentials.items(), beliefs, strict=True):
        b = product([values[i] for i in inputs] + [sent[k] for k in into])
        out[c] = Factor(f.schema, b * (total / b.sum()))
    return Cliques(potentials.schema, out)


def variable_elimination(potentials: Cliques, clique: Attrs, total: float = 1.0) -> Factor:
    """Any marginal, also of attributes that share no clique or are in none (uniform there)."""
    clique = names(clique)
    wanted = potentials.schema.project(clique)
    inner = [a for a in clique if a in potentials.active]
    part = log_sum_product(list(potentials.values()), potentials.active.project(inner))
    return _total(part.expand(wanted), total)


def bulk_variable_elimination(potentials: Cliques, cliques: Iterable[Clique], total: float = 1.0) -> Cliques:
    return Cliques(potentials.schema, {c: variable_elimination(potentials, c, total) for c in cliques})


def many_marginals(potentials: Cliques, cliques: Iterable[Clique], total: float = 1.0) -> Cliques:
    """Many queries from one calibrated tree: inside a clique, across two, or else by elimination."""
    schema = potentials.active
    tree = _tree(schema, tuple(potentials))
    whole = belief_propagation(potentials.expand(tree.cliques), total, Tree(tree.cliques, tree.edges, tree.order))
    beliefs = [whole[c] for c in tree.cliques]
    joints: dict[tuple[int, int], Factor] = {}

    def path(a: int, b: int) -> list[int]:
        back, queue = {a: a}, [a]
        for node in queue:
            for n in tree.around[node]:
                if n not in back:
                    back[n] = node
                    queue.append(n)
        walk = [b]
        while walk[-1] != a:
            walk.append(back[walk[-1]])
        return walk[::-1]

    def joint(a: int, b: int) -> Factor:
        if (a, b) not in joints:
            walk = path(a, b)
            made = beliefs[a]
            for x, y in zip(walk, walk[1:], strict=False):
                step = beliefs[y] / beliefs[y].project(tree.separator(x, y))
                made = Factor((m := made * step).schema, np.nan_to_num(m.values))
                keep = set(tree.cliques[a]) | set(tree.cliques[y])
                made = made.project(made.schema.canonical(keep))
            joints[a, b] = made
        return joints[a, b]

    out = {}
    for c in cliques:
        inside = next((k for k, t in enumerate(tree.cliques) if set(c) <= set(t)), None)
        pair = None
        if inside is None and set(c) <= set(schema.attrs):
            pair = next(((i, j) for i in range(len(beliefs)) for j in range(i + 1, len(beliefs)) if set(c) <= {*tree.cliques[i], *tree.cliques[j]}), None)
        if inside is not None:
            out[c] = beliefs[inside].project(c)
        elif pair is not None:
            out[c] = joint(*pair).project(c)
        else:
            out[c] = variable_elimination(potentials, c, total)
    return Cliques(potentials.schema, out)


def kron_query(potentials: Cliques, matrices: Mapping[str, np.ndarray], total: float = 1.0) -> Factor:
    """A Kronecker product of per-attribute query matrices, applied to the marginal of their attributes."""
    marginal = variable_elimination(potentials, tuple(matrices), total)
    values = marginal.values
    for k, m in enumerate(matrices.values()):
        values = np.moveaxis(np.tensordot(np.asarray(m, float), values, axes=(1, k)), 0, k)
    return Factor(Schema(tuple(matrices), values.shape), values)


# -- approximate inference ---------------------------------------------------------------------------


def region_propagation(potentials: Cliques, total: float = 1.0, state: dict | None = None, iters: int = 1, damping: float = 0.5, graph: RegionGraph | None = None) -> tuple[Cliques, dict]:
    """Convex generalised belief propagation on the region graph: pseudo-marginals and the messages to go on from.

    A potential is added to the region of its own attributes.
    """
    schema = potentials.schema
    graph = graph or _regions(schema, tuple(potentials))
    theta = {r: Factor.zeros(schema.project(r)) for r in graph.regions}
    for c, f in potentials.items():
        r = schema.canonical(c)
        theta[r] = theta[r] + f.transpose(r)
    up, down = graph.parents, graph.children
    pairs = [(p, r) for r in graph.regions for p in up[r]]
    m = dict(state) if state else {k: Factor.zeros(schema.project(pair[1])) for pair in pairs for k in (pair, pair[::-1])}
    plus = lambda start, parts: sum(parts, start)
    share = {r: 1 / (1 + len(up[r])) for r in graph.regions}
    for _ in range(iters):
        new = {}
        for p, r in pairs:
            f = plus(theta[p], [m[c, p] for c in down[p] if c != r])
            for q in up[p]:
                f = f - m[p, q]
            new[p, r] = f.project(r, log=True).normalize(1, log=True)
            g = plus(theta[r], [m[c, r] for c in down[r]] + [m[q, r] for q in up[r]])
            new[r, p] = (g.transpose(r) * share[r] - m[p, r]).normalize(1, log=True)
        m = {k: damping * m[k] + (1 - damping) * v for k, v in new.items()}
    out = {}
    for c in potentials:
        r = schema.canonical(c)
        f = plus(theta[r], [m[k, r] for k in down[r]])
        for p in up[r]:
            f = f - m[r, p]
        out[c] = _total(f, total).transpose(c)
    return Cliques(schema, out), m


@lru_cache(maxsize=64)
def _regions(schema: Schema, cliques: tuple[Clique, ...]) -> RegionGraph:
    return region_graph(schema, cliques)


# -- contractions --------------------------------------------------------------------------------------


def contract(left: np.ndarray, right: np.ndarray, axes: tuple[Sequence[int], Sequence[int]], batch: tuple[Sequence[int], Sequence[int]] = ((), ()), combine: Callable = np.multiply, reduce: Callable = np.sum) -> np.ndarray:
    """Contract two arrays over any semiring; the result has batch axes, then the left's, then the right's others."""
    free_l = [k for k in range(left.ndim) if k not in (*axes[0], *batch[0])]
    free_r = [k for k in range(right.ndim) if k not in (*axes[1], *batch[1])]
    a = left.transpose([*batch[0], *free_l, *axes[0]])
    b = right.transpose([*batch[1], *free_r, *axes[1]])
    nb, nl, nr, nc = len(batch[0]), len(free_l), len(free_r), len(axes[0])
    a = a.reshape(a.shape[: nb + nl] + (1,) * nr + a.shape[nb + nl :])
    b = b.reshape(b.shape[:nb] + (1,) * nl + b.shape[nb:])
    both = combine(a, b)
    return reduce(both, axis=tuple(range(nb + nl + nr, nb + nl + nr + nc))) if nc else both


def loop_einsum(formula: str, *arrays: np.ndarray, sequential: str = "") -> np.ndarray:
    """einsum that goes through the axes in ``sequential`` one value at a time, to bound memory."""
    if not sequential:
        return np.einsum(formula, *arrays, optimize=True)
    inputs, _, output = formula.partition("->")
    terms, name, rest = inputs.split(","), sequential[0], sequential[1:]
    if not any(name in t for t in terms):
        raise ValueError(f"axis {name} is not in the formula")
    size = next(x.shape[t.index(name)] for t, x in zip(terms, arrays, strict=True) if name in t)
    inner = ",".join(t.replace(name, "") for t in terms) + "->" + output.replace(name, "")
    total, kept = None, []
    for i in range(size):
        part = [np.take(x, i, axis=t.index(name)) if name in t else x for t, x in zip(terms, arrays, strict=True)]
        got = loop_einsum(inner, *part, sequential=rest)
        if name in output:
            kept.append(got)
        else:
            total = got if total is None else total + got
    return np.stack(kept, axis=output.index(name)) if name in output else total
