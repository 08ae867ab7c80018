"""Embedding near-duplicates over a robust-pruned flat graph, built on overlapping cluster shards.

Equal vectors are one node with a weight. Centroids are fitted on a bounded sample; every node is at home with its
nearest centroid and belongs besides to all shards near enough, so shards overlap. How near follows from the
threshold: of two nodes within an angle t, homed at A and B, one lies less than t/2 beyond the plane between A and
B, seen from the other's side, so with an overlap of sin(t/2) times the distance of the centroids one of the two
is a member of the other's home, and no link falls between shards. Each shard prunes its nodes' nearest candidates
robustly into adjacency lists, and lists of the same node from several shards are united. Each shard then answers
for the nodes it is home to: a greedy beam search from the shard's medoid finds a query's surroundings, and
its range is expanded along the graph through all nodes near the threshold. A link that only one end's home can
see is counted for both ends.

Every shard audits its search twice: links of which one end alone was found betray a miss, and a sample of queries
is compared with brute force; on any miss the shard scans exhaustively, in blocks. Shards too large for one
task are scanned in blocks by several. An independent audit compares ``AUDIT`` nodes, by hash, with all vectors, in blocks,
whatever their shards. Where the overlap would make more than ``COPIES`` copies of a vector on average (many
dimensions, many shards) it is narrowed to that, and if the audit then finds less than ``RECALL`` of the
links, the whole overlap is used. The audit's figures are returned with the result. Links are verified by
cosine in double precision on the vectors themselves.

A shard returns link counts and a spanning forest of its links, never pairs, so a large group of near copies
costs rows in proportion to its size. Bounds: at most ``SAMPLE`` vectors (fewer if long), ``MAX_SHARDS`` centroids and
``AUDIT`` vectors reach the driver.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing;
vectors of different lengths never link; a null id never names a component unless all its ids are null;
repeated rows are vectors of their own that link with each other; an empty table gives no rows. Labels and
other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .components import components
from .simhash import forest

#: Nodes a shard is meant to be home to, most shards, vectors that centroids are fitted on and their bytes, members of the largest shard for one task.
SHARD, MAX_SHARDS, SAMPLE, SAMPLE_BYTES, LARGE = 2048, 4096, 65536, 1 << 26, 32768
#: Copies of a vector that overlaps may make on average, nodes compared with all vectors, and the share of their links that must be found.
COPIES, AUDIT, RECALL = 4.0, 512, 0.99
#: Candidates, degree, far nodes and distance ratio of robust pruning; width of the beam; how far below the threshold a range goes on.
CANDIDATES, DEGREE, FAR, ALPHA, BEAM, SLACK = 48, 24, 2, 1.2, 24, 0.1
#: Queries searched at a time, and queries of a shard that are audited.
BLOCK, AUDITED = 512, 64


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def centroids(sample: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """Spherical k-means on unit rows; deterministic, empty clusters keep their last centre."""
    at = np.linspace(0, len(sample) - 1, k).astype(int)
    c = sample[at].copy()
    for _ in range(rounds if k > 1 else 1):
        near = np.concatenate([(sample[s : s + 4096] @ c.T).argmax(axis=1) for s in range(0, len(sample), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, near, sample)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(size > 1e-12, total / np.maximum(size, 1e-12), c)
    return c


def pruned_graph(x: np.ndarray) -> np.ndarray:
    """Adjacency of unit rows, -1 where a list is shorter: robustly pruned nearest candidates and two far nodes.

    The far nodes tie groups of near copies, whose nearest candidates are all their own, to the rest; each row is far
    node of two rows.
    """
    n = len(x)
    x = x.astype(np.float32)
    width = min(CANDIDATES, n - 1)
    out = np.full((n, DEGREE + FAR), -1, np.int64)
    for s in range(0, n if width else 0, BLOCK):
        rows = np.arange(s, min(s + BLOCK, n))
        sim = x[rows] @ x.T
        sim[np.arange(len(rows)), rows] = -np.inf
        near = np.argpartition(-sim, width - 1, axis=1)[:, :width]
        sim = np.take_along_axis(sim, near, axis=1)
        gap = np.sqrt(np.maximum(2 - 2 * sim, 0))
        alive, points = np.ones_like(sim, bool), x[near]
        for d in range(DEGREE):
            best = np.where(alive, sim, -np.inf).argmax(axis=1)
            some = alive[np.arange(len(rows)), best]
            if not some.any():
                break
            pick = near[np.arange(len(rows)), best]
            out[rows[some], d] = pick[some]
            between = np.sqrt(np.maximum(2 - 2 * np.einsum("rd,rcd->rc", x[pick], points), 0))
            alive &= (ALPHA * between > gap) & (near != pick[:, None])
    stride = next(p for p in (7919, 7907, 1) if math.gcd(p, max(n, 1)) == 1)
    for k in range(FAR):
        far = (np.arange(n) * stride + 104729 * (k + 1)) % n
        listed = (out == far[:, None]).any(axis=1) | (far == np.arange(n))
        out[:, DEGREE + k] = np.where(listed, -1, far)
    return out


def range_search(x: np.ndarray, graph: np.ndarray, start: int, queries: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """``(query place, node)`` of nodes found at similarity ``least`` or more: beam search, then range expansion."""
    q, n = x[queries], len(x)
    count = len(q)
    seen = np.zeros((count, n), bool)
    ids, sims, done = np.full((count, BEAM), -1), np.full((count, BEAM), -np.inf), np.zeros((count, BEAM), bool)
    ids[:, 0], sims[:, 0] = start, q @ x[start]
    seen[:, start] = True
    near_q, near_n = [np.flatnonzero(sims[:, 0] >= least - SLACK)], []
    near_n.append(np.full(len(near_q[0]), start))
    hit_q, hit_n = [np.flatnonzero(sims[:, 0] >= least)], []
    hit_n.append(np.full(len(hit_q[0]), start))

    def visit(who: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        seen[who, nodes] = True
        sim = np.einsum("ij,ij->i", q[who], x[nodes])
        close, hit = sim >= least - SLACK, sim >= least
        near_q.append(who[close])
        near_n.append(nodes[close])
        hit_q.append(who[hit])
        hit_n.append(nodes[hit])
        return sim

    active = np.arange(count)
    while len(active):
        open_ = np.where(done[active] | (ids[active] < 0), -np.inf, sims[active])
        k = open_.argmax(axis=1)
        go = open_[np.arange(len(active)), k] > -np.inf
        active, k = active[go], k[go]
        if not len(active):
            break
        done[active, k] = True
        nb = graph[ids[active, k]]
        r, c = np.nonzero((nb >= 0) & ~seen[active[:, None], nb])
        sim = np.full(nb.shape, -np.inf)
        sim[r, c] = visit(active[r], nb[r, c])
        all_s = np.concatenate([sims[active], sim], axis=1)
        top = np.argpartition(-all_s, BEAM - 1, axis=1)[:, :BEAM]
        sims[active] = np.take_along_axis(all_s, top, axis=1)
        ids[active] = np.take_along_axis(np.concatenate([ids[active], np.where(sim > -np.inf, nb, -1)], axis=1), top, axis=1)
        done[active] = np.take_along_axis(np.concatenate([done[active], np.zeros(nb.shape, bool)], axis=1), top, axis=1)
    who, nodes = np.concatenate(near_q), np.concatenate(near_n)
    while len(who):  # range expansion
        near_q.clear()
        near_n.clear()
        for s in range(0, len(who), 16384):
            nb = graph[nodes[s : s + 16384]]
            w = np.broadcast_to(who[s : s + 16384, None], nb.shape)
            new = np.unique((w * n + nb)[(nb >= 0) & ~seen[w, nb]])
            if len(new):
                visit(new // n, new % n)
        who, nodes = (np.concatenate(near_q), np.concatenate(near_n)) if near_q else (who[:0], nodes[:0])
    return np.concatenate(hit_q), np.concatenate(hit_n)


def _build(group: pa.Table) -> pa.Table:
    """Edges of a shard's graph in both directions; a node takes back at most ``DEGREE + FAR`` edges, those of its nearest."""
    x = unit(_matrix(group["v"]))
    node = group["node"].to_numpy()
    graph = pruned_graph(x)
    i, d = np.nonzero(graph >= 0)
    j = graph[i, d]
    order = np.lexsort((-np.einsum("ij,ij->i", x[i], x[j]), j))
    rank = np.arange(len(j)) - np.searchsorted(j[order], j[order])
    back = order[rank < DEGREE + FAR]
    return pa.table({"node": np.concatenate([node[i], node[j[back]]]), "other": np.concatenate([node[j], node[i[back]]])})


def _graph(group: pa.Table) -> np.ndarray:
    """The united adjacency lists of a shard's nodes as places in the shard, -1 where a list is shorter."""
    node, lists = group["node"].to_numpy(), group["others"].combine_chunks()
    order, n = np.argsort(node), len(node)
    flat = lists.flatten().to_numpy()
    rows = np.repeat(np.arange(n), lists.value_lengths().to_numpy(zero_copy_only=False))
    place = np.searchsorted(node[order], flat)
    place[place == n] = 0
    known = node[order][place] == flat
    rows, place = rows[known], order[place[known]]
    at = np.arange(len(rows)) - np.searchsorted(rows, rows)
    graph = np.full((n, int(at.max(initial=0)) + 1), -1, np.int64)
    graph[rows, at] = place
    return graph


def _mixed(a: np.ndarray, b: np.ndarray) -> int:
    """A sum over pairs that differs if one pair does."""
    h = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ (b.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    return int((h * np.uint64(0xBF58476D1CE4E5B9)).sum(dtype=np.uint64))


def _search(group: pa.Table, shard: int, least: float, asked: np.ndarray | None = None) -> pa.Table:
    """Rows ``(node, links)`` of the queries and of nodes that only this shard can link, and ``(node, root)`` of the forest of links.

    Without adjacency lists the queries ``asked`` are scanned for.
    """
    raw = _matrix(group["v"])
    x, node, weight, home = unit(raw), group["node"].to_numpy(), group["weight"].to_numpy(), group["home"].to_numpy()
    n = len(node)
    queries = np.flatnonzero(home == shard) if asked is None else asked
    lists = group["shards"].combine_chunks()
    member = np.repeat(np.arange(n), lists.value_lengths().to_numpy(zero_copy_only=False)) * MAX_SHARDS + lists.flatten().to_numpy()  # rising
    scaled = raw / np.abs(raw).max(axis=1, keepdims=True)
    norm, low = np.linalg.norm(scaled, axis=1), least - 1e-9
    graph = _graph(group) if asked is None else None
    medoid = int((x @ x.mean(axis=0)).argmax())

    def scan(some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.nonzero(x[some] @ x.T >= low)

    def answer(find) -> tuple[np.ndarray, list, list, bool]:
        links, out_a, out_b, sums = np.zeros(n, np.int64), [], [], [0, 0]
        step = max(1, min(BLOCK, (1 << 27) // n))
        for s in range(0, len(queries), step):
            some = queries[s : s + step]
            qi, nodes = find(some)
            for t in range(0, len(qi), 1 << 16):  # verify
                a, b = some[qi[t : t + (1 << 16)]], nodes[t : t + (1 << 16)]
                cos = np.einsum("ij,ij->i", scaled[a], scaled[b]) / (norm[a] * norm[b])
                ok = (cos >= least) & (a != b)
                a, b = a[ok], b[ok]
                np.add.at(links, a, weight[b])
                own = home[b] == shard
                for k, way in enumerate((a < b, a > b)):
                    sums[k] += _mixed(np.minimum(a, b)[own & way], np.maximum(a, b)[own & way])
                key = a * MAX_SHARDS + home[b]
                at = np.searchsorted(member, key)
                at[at == len(member)] = 0
                alone = ~own & (member[at] != key)  # the other end's home does not hold this one
                np.add.at(links, b[alone], weight[a[alone]])
                tied, at = np.unique(np.concatenate([a, b]), return_inverse=True)
                if len(tied):
                    label = forest(at[: len(a)], at[len(a) :], len(tied))
                    moved = label != np.arange(len(tied))
                    out_a.append(node[tied[moved]])
                    out_b.append(node[tied[label[moved]]])
        return links, out_a, out_b, (sums[0] - sums[1]) % (1 << 64) == 0

    audit = np.unique(queries[np.linspace(0, len(queries) - 1, min(AUDITED, len(queries))).astype(int)]) if len(queries) else queries
    whole = False
    if graph is not None and (not len(audit) or len(scan(audit)[0]) == len(range_search(x, graph, medoid, audit, low)[0])):
        links, out_a, out_b, whole = answer(lambda some: range_search(x, graph, medoid, some, low))
    if not whole:
        links, out_a, out_b, _ = answer(scan)
    a, b = (np.concatenate(v) if v else np.empty(0, np.int64) for v in (out_a, out_b))
    counted = np.flatnonzero(links)
    root = pa.array(np.concatenate([np.zeros(len(counted), np.int64), b]), mask=np.arange(len(counted) + len(a)) < len(counted))
    return pa.table({"node": np.concatenate([node[counted], a]), "root": root, "links": np.concatenate([links[counted], np.zeros(len(a), np.int64)])})


def overlap(least: float) -> float:
    """How far over the plane between two centroids at distance 1 one of two linked nodes lies at most, seen from the other's side."""
    return math.sin(math.acos(min(1.0, max(-1.0, least - 1e-9))) / 2)


def belongs(x: np.ndarray, centres: np.ndarray, apart: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray]:
    """Whether unit rows belong to shards, and their homes."""
    sim = x @ centres.T
    home = sim.argmax(axis=1)
    return sim >= sim.max(axis=1, keepdims=True) - width * apart[home] - 1e-9, home


def _apart(centres: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 * (1 - centres @ centres.T), 0)) if len(centres) else np.zeros((0, 0))


def _assign(classes: DataFrame, centres: np.ndarray, width: float) -> DataFrame:
    """``(shard, node, weight, v, home, shards)``: a row for each shard a node belongs to, its home and all of them."""
    sent = classes.sparkSession.sparkContext.broadcast((centres, _apart(centres)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 2048):
                part = b.slice(s, 2048)
                member, home = belongs(unit(_matrix(part.column(2))), *sent.value, width)
                member[np.arange(len(home)), home] = True
                i, shard = np.nonzero(member)
                ends = np.concatenate([[0], np.cumsum(member.sum(axis=1))])
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(shard.astype(np.int32)))
                at = pa.array(i)
                yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), *part.take(at).columns, pa.array(home[i].astype(np.int32)), lists.take(at)], names=["shard", "node", "weight", "v", "home", "shards"])

    return classes.select("node", "weight", "v").mapInArrow(run, "shard int, node long, weight long, v array<double>, home int, shards array<int>")


def searched(classes: DataFrame, least: float, width: float | None = None) -> DataFrame:
    """A stored table of ``(node, root, links)`` as of ``_search``, over all shards of ``classes (node, weight, v)`` of one vector length.

    ``width`` is the overlap; by default the whole ``overlap(least)``, or less if that would make too many copies and
    the audit still finds ``RECALL`` of the links.
    """
    n = classes.count()
    shards = max(1, min(MAX_SHARDS, -(-n // SHARD)))
    if shards == 1:
        zero = F.lit(0).cast("int")
        return stored(_over_shards(stored(classes.select(zero.alias("shard"), "node", "weight", "v", zero.alias("home"), F.array(zero).alias("shards")), "members"), least), "searched")
    most = min(SAMPLE, max(shards, SAMPLE_BYTES // (8 * classes.select(F.size("v")).first()[0])))
    share = F.pmod(F.xxhash64("v"), F.lit(1 << 30)) / float(1 << 30)
    sample = classes.where(share < most / n) if n > most else classes
    picked = unit(_matrix(sample.select("v").orderBy(F.xxhash64("v")).toArrow()["v"]))
    centres, full = centroids(picked, min(shards, len(picked))), overlap(least)
    wide = full
    if width is None:
        some, apart = picked[:: max(1, len(picked) // 2048)], _apart(centres)
        while wide > full / 64 and belongs(some, centres, apart, wide)[0].sum() > COPIES * len(some):
            wide *= 0.8
    found = stored(_over_shards(stored(_assign(classes, centres, wide if width is None else width), "members"), least), "searched")
    if width is None and wide < full:
        true, seen = audit(classes, found, least)
        if seen < RECALL * true:
            return searched(classes, least, full)
    return found


def _over_shards(members: DataFrame, least: float) -> DataFrame:
    large = sorted(r.shard for r in members.groupBy("shard").count().where(F.col("count") > LARGE).collect())  # a row a shard at most
    out, schema = None, "node long, root long, links long"
    if large:
        spread = members.where(F.col("shard").isin(large))
        tasks = spread.groupBy("shard").agg(F.ceil(F.sum((F.col("home") == F.col("shard")).cast("int")) / SHARD).cast("int").alias("tasks"))
        dealt = spread.join(F.broadcast(tasks), "shard").select("*", F.explode(F.sequence(F.lit(0), F.greatest("tasks", F.lit(1)) - 1)).alias("part"))

        def scanned(key: tuple, g: pa.Table) -> pa.Table:
            shard, part, parts = key[0].as_py(), key[1].as_py(), g["tasks"][0].as_py()
            mine = (g["home"].to_numpy() == shard) & (g["node"].to_numpy() % max(parts, 1) == part)
            return _search(g, shard, least, np.flatnonzero(mine))

        out = dealt.groupBy("shard", "part").applyInArrow(scanned, schema)
        members = members.where(~F.col("shard").isin(large))
    graph = members.groupBy("shard").applyInArrow(_build, "node long, other long")
    united = graph.groupBy("node").agg(F.collect_set("other").alias("others"))  # 2 (DEGREE + FAR) of each shard of a node at most
    ready = members.join(united, "node", "left").select(*members.columns, F.coalesce("others", F.array().cast("array<long>")).alias("others"))
    found = ready.groupBy("shard").applyInArrow(lambda key, g: _search(g, key[0].as_py(), least), schema)
    return found if out is None else found.unionByName(out)


def audit(classes: DataFrame, found: DataFrame, least: float, nodes: int = AUDIT) -> tuple[int, int]:
    """Links of ``nodes`` nodes, by hash: as found by comparing them with all vectors in blocks, and as counted in ``found``."""
    asked = classes.orderBy(F.xxhash64("v", "node"), "node").limit(nodes).select("node", "v").toArrow()
    if not asked.num_rows:
        return 0, 0
    raw = _matrix(asked["v"])
    scaled = raw / np.abs(raw).max(axis=1, keepdims=True)
    sent = classes.sparkSession.sparkContext.broadcast((asked["node"].to_numpy(), scaled, np.linalg.norm(scaled, axis=1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, q, length = sent.value
        total = np.zeros(len(node), np.int64)
        for b in batches:
            for s in range(0, b.num_rows, 4096):
                part = b.slice(s, 4096)
                v = _matrix(part.column(2))
                v = v / np.abs(v).max(axis=1, keepdims=True)
                norm, own = np.linalg.norm(v, axis=1), part.column(0).to_numpy()
                i, j = np.nonzero(q @ v.T >= (least - 1e-9) * length[:, None] * norm)
                cos = np.einsum("ij,ij->i", q[i], v[j]) / (length[i] * norm[j])
                ok = (cos >= least) & (node[i] != own[j])
                np.add.at(total, i[ok], part.column(1).to_numpy()[j[ok]])
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(total)], names=["node", "true"])

    true = classes.select("node", "weight", "v").mapInArrow(run, "node long, true long").groupBy("node").agg(F.sum("true").alias("true"))
    seen = found.where("root IS NULL").join(F.broadcast(true.select("node")), "node", "left_semi").groupBy("node").agg(F.sum("links").alias("seen"))
    row = true.join(seen, "node", "left").agg(F.sum("true"), F.sum(F.least("true", F.coalesce("seen", F.lit(0))))).first()
    return int(row[0] or 0), int(row[1] or 0)


def near_duplicates(vectors: DataFrame, least: float = 0.95, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``(vec_id, n_links, component_id, kept, audit_links, audit_found)``, a row per row of ``vectors``.

    The last two are the independent audit's: links of its nodes between different vectors, and those of them found.
    """
    v = F.col("v")
    sound = F.exists(v, lambda x: x != 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    rows = rows.withColumn("v", F.when(F.coalesce(sound, F.lit(False)), F.transform("v", lambda x: x + 0.0)))
    keys = {"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit("second"), "v")}
    rows = stored(rows.withColumns(keys), "vectors")
    classes = rows.where("v IS NOT NULL").groupBy("h1", "h2", "v").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("weight"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "classes")  # numbers are fixed once written
    lengths = sorted(r[0] for r in classes.select(F.size("v")).distinct().collect())
    found, true, seen = None, 0, 0
    for d in lengths:
        own = classes.where(F.size("v") == d)
        part = searched(own, least)
        x, y = audit(own, part, least)
        found, true, seen = part if found is None else found.unionByName(part), true + x, seen + y
    audited = [F.lit(true).cast("long").alias("audit_links"), F.lit(seen).cast("long").alias("audit_found")]
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"), *audited)
    tied = stored(components(found.where("root IS NOT NULL").select("node", "root"), "node", "root"), "components")
    links = found.where("root IS NULL").groupBy("node").agg(F.sum("links").alias("links"))
    named = classes.join(links, "node", "left").join(tied, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least_id = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = named.join(least_id, "component").select("h1", "h2", "weight", "links", "component_id")
    out = rows.select("vec_id", "h1", "h2", F.col("v").isNotNull().alias("sound")).join(named, ["h1", "h2"], "left")
    component = F.when(F.col("sound"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select(
        "vec_id",
        F.when(F.col("sound"), F.coalesce("links", F.lit(0)) + F.col("weight") - 1).otherwise(0).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
        *audited,
    )
