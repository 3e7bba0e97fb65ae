"""Random-walk expansion over the edge table, and rank fusion.

``walks`` is exact: a first-in-first-out queue, a budget that counts pushes, and neighbours met in the order (target,
type).  A table of few edges goes to the walks whole.  Beyond that a walk's state is one row, and a round sends the
walks' requests (nodes that are queued and not yet known; at most the budget for each walk) to the edge table, which
answers with their out-edges and the degrees of the targets; a walk then works until it needs a node that it does not
know.  So only edges of nodes that are really queued are read, rounds are as many as the walk is deep, and any number of
seeds and horizons runs at once.

A hub's edges never come into a row.  A walk that pushes one holds (hub, share): each of its targets is owed share times
the edge's weight.  What a target is owed is looked up, edge by edge, when the walk meets it.  Which of a hub's targets join
the queue is read from the hub's front, the few of its edges, by name and weight, that any walk can want; only targets
that several hubs share are summed over the edges, for walks that have pushed several hubs.  At most the budget come back.
"""

from __future__ import annotations

import heapq
import pickle
from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import session

TIGHT = (0.5, 1e-4)
WIDE = (0.1, 1e-5)
BUDGET = 40
RRF_K = 60


def out_edges(edges: DataFrame, alias: DataFrame | None = None) -> DataFrame:
    """(source_id, target_id, type, weight) with targets moved to their root; parallel edges stay apart."""
    if alias is None:
        return edges.select("source_id", "target_id", "type", "weight")
    a = alias.select(F.col("old_id").alias("_old"), F.col("root_id").alias("_root"))
    return edges.join(a, F.col("target_id") == F.col("_old"), "left").select("source_id", F.coalesce("_root", "target_id").alias("target_id"), "type", "weight")


def out_stats(edges: DataFrame) -> DataFrame:
    """(source_id, out_weight, out_degree)."""
    return edges.groupBy("source_id").agg(F.sum("weight").alias("out_weight"), F.count("*").alias("out_degree"))


def start(seed: str) -> dict:
    return {"p": {}, "r": {seed: 1.0}, "queue": [seed], "touched": 0}


def advance(state: dict, known: dict, alpha: float, eps: float, budget: int) -> bool:
    """Push until the budget or the queue ends (True) or an unknown node is next (False).

    known: node -> list of (target, weight, out-degree of the target), in order.
    """
    p, r, queue = state["p"], state["r"], deque(state["queue"])
    queued = set(queue)
    while queue and state["touched"] < budget:
        u = queue[0]
        if u not in known:
            state["queue"] = list(queue)
            return False
        queue.popleft()
        queued.discard(u)
        out, mass = known[u], r.get(u, 0.0)
        if mass <= 0 or (not out and mass < eps):
            continue
        total = sum(w for _, w, _ in out)
        total = total if total > 0 else 1.0
        p[u] = p.get(u, 0.0) + alpha * mass
        rest = (1 - alpha) * mass
        r[u] = 0.0
        state["touched"] += 1
        for t, w, degree in out:
            r[t] = r.get(t, 0.0) + rest * w / total
            if r[t] / max(1, degree) >= eps and t not in queued and state["touched"] + len(queue) < budget:
                queue.append(t)
                queued.add(t)
    state["queue"] = []
    return True


def sized(edges: DataFrame) -> DataFrame:
    """``edges`` (source_id, target_id, type, weight) with ``degree``, the number of out-edges of the target.

    Walks need it with every edge.  A caller with many walks makes it once and keeps it, bucketed by source.
    """
    if "degree" in edges.columns:
        return edges
    degrees = edges.groupBy(F.col("source_id").alias("_t")).agg(F.count("*").cast("int").alias("degree"))
    met = edges.join(degrees, edges.target_id == degrees._t, "left")
    return met.select("source_id", "target_id", "type", F.col("weight").cast("double").alias("weight"), F.coalesce("degree", F.lit(0)).alias("degree"))


#: Out-edges of a node beyond which they stay in the table.
HUB = 1024
_ASK = "asked struct<nodes:array<string>,pairs:array<struct<hub:string,target:string>>,scan:string,room:int,owed:array<struct<target:string,amount:double>>,shares:array<struct<hub:string,share:double>>,queued:array<string>>"
_STATE = f"horizon int, seed string, state binary, done boolean, {_ASK}"


class Walk:
    """One walk whose hubs' edges stay in the table.  ``run`` goes on until something has to be looked up."""

    def __init__(self, seed: str):
        self.p, self.r, self.queue, self.touched = {}, {seed: 1.0}, [seed], 0
        self.known, self.degree = {}, {}  # node -> its out-edges (target, weight), or its total weight if it is a hub; degrees
        self.shares: dict[str, float] = {}  # hub -> what each unit of its edges' weight is owed
        self.paid: dict[str, dict] = {}  # node -> the shares when its residual was last taken
        self.weight: dict[tuple, float] = {}  # (hub, target) -> weight
        self.scanned = None  # a hub that was pushed and whose targets have not come back

    def owed(self, t: str) -> float:
        paid = self.paid.get(t, {})
        return self.r.get(t, 0.0) + sum((share - paid.get(h, 0.0)) * self.weight[h, t] for h, share in self.shares.items() if (h, t) in self.weight)

    def missing(self, targets) -> list[tuple]:
        return [(h, t) for t in dict.fromkeys(targets) for h in self.shares if (h, t) not in self.weight]

    def meets(self, u: str) -> list[str]:
        """The nodes whose dues a push of ``u`` looks at: itself and, unless it is a hub, its targets."""
        out = self.known.get(u)
        return [u, *(t for t, _ in out)] if isinstance(out, list) else [u]

    def run(self, alpha: float, eps: float, budget: int) -> dict | None:
        """None when the walk has ended, else what it asks for."""
        while self.queue and self.touched < budget:
            u = self.queue[0]
            if u not in self.known or self.missing(self.meets(u)):  # ask for all that the queue needs at once
                unknown = [x for x in self.queue if x not in self.known]
                return {"nodes": unknown, "pairs": self.missing(t for x in self.queue for t in self.meets(x))}
            out = self.known[u]
            hub = not isinstance(out, list)
            self.queue.pop(0)
            mass = self.owed(u)
            if mass <= 0 or (not hub and not out and mass < eps):
                continue
            total = out if hub else sum(w for _, w in out)
            total = total if total > 0 else 1.0
            self.p[u] = self.p.get(u, 0.0) + alpha * mass
            rest = (1 - alpha) * mass
            self.r[u], self.paid[u] = 0.0, dict(self.shares)
            self.touched += 1
            if hub:
                self.shares[u] = self.shares.get(u, 0.0) + rest / total
                if self.touched + len(self.queue) < budget:
                    self.scanned = u
                    return {"scan": u, "room": budget - self.touched - len(self.queue)}
                continue
            queued = set(self.queue)
            for t, w in out:
                self.r[t] = self.r.get(t, 0.0) + rest * w / total
                if t not in queued and self.touched + len(self.queue) < budget and self.owed(t) / max(1, self.degree[t]) >= eps:
                    self.queue.append(t)
                    queued.add(t)
        self.queue = []
        return None

    def learn(self, answers, asked: dict) -> None:
        """Take in what the table says about ``asked``."""
        edges: dict[str, list] = {u: [] for u in asked.get("nodes", [])}
        for a in answers:
            if a["kind"] == "edges":  # all of a node's
                edges[a["node"]] = [(x["target"], x["type"], x["weight"]) for x in a["out"]]
                self.degree |= {x["target"]: x["degree"] for x in a["out"]}
            elif a["kind"] == "edge" and a["target"] is not None:  # one of them
                edges[a["node"]].append((a["target"], a["type"], a["weight"]))
                self.degree[a["target"]] = a["degree"]
        self.known |= {u: [(t, w) for t, _, w in sorted(out, key=lambda x: (x[0], x[1] or ""))] for u, out in edges.items()}
        self.known |= {a["node"]: a["weight"] for a in answers if a["kind"] == "hub"}
        if pairs := asked.get("pairs"):
            self.weight |= dict.fromkeys(pairs, 0.0) | {(a["node"], a["target"]): a["weight"] for a in answers if a["kind"] == "pair"}
        if self.scanned:
            self.queue += sorted(a["target"] for a in answers if a["kind"] == "next")
            self.scanned = None

    def ask(self, need: dict) -> dict:
        """``need`` as a row of the round's table."""
        row = {"nodes": need.get("nodes", []), "pairs": [{"hub": h, "target": t} for h, t in need.get("pairs", [])], "scan": need.get("scan"), "room": need.get("room", 0), "owed": [], "shares": [], "queued": []}
        if need.get("scan"):  # all that its targets are owed besides the hubs' shares; what they have been paid already counts back
            row["shares"] = [{"hub": h, "share": x} for h, x in self.shares.items()]
            row["queued"] = list(self.queue)
            back = [(t, -x * self.weight.get((h, t), 0.0)) for t, paid in self.paid.items() for h, x in paid.items()]
            row["owed"] = [{"target": t, "amount": x} for t, x in [*self.r.items(), *back] if x]
        return row


#: Edges, and bytes of their names, that are sent whole to the walks; both are measured first, and a larger table is asked
#: in rounds.
SMALL_EDGES, SMALL_BYTES = 1 << 21, 64 << 20


class _Whole:
    """All adjacency, from an Arrow table sorted by node; a node without edges has none.  Rows become Python objects only
    for the nodes that are asked for."""

    def __init__(self, table):
        node = table["node"].combine_chunks().dictionary_encode()
        at = node.indices.to_numpy()
        cuts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1], [True]])).tolist() if len(at) else []
        self.at = {name: ends for name, ends in zip(node.dictionary.to_pylist(), zip(cuts, cuts[1:]))}
        self.columns = [table[c].combine_chunks() for c in ("target_id", "weight", "degree")]

    def __contains__(self, u) -> bool:
        return True

    def __getitem__(self, u) -> list:
        a, b = self.at.get(u, (0, 0))
        return list(zip(*(c.slice(a, b - a).to_pylist() for c in self.columns)))


#: Edges of a partition of the table that walks ask; walks of one batch, each with all that it knows and is told.
PART_EDGES, BATCH_WALKS = 1 << 18, 32


def fronts(heavy: DataFrame, budget: int, parts: int) -> DataFrame:
    """The edges of ``heavy`` (node, shared, target_id, weight, degree) that a walk can want of a hub it has pushed.

    A target that nothing else touches joins a queue by its weight over its degree, and the first by name have room.  So an
    edge is wanted by none if ``budget`` edges of its hub come earlier by name and join wherever it does: of the queued and
    the pushed targets, which need not join, there are at most as many as there is no room for.  What a part of a hub does
    not want the hub does not, so parts are thinned where they lie, and then hubs, in one walk in the order of names.  Of n
    edges in an order that has nothing to do with their weight about budget * ln(n / budget) stay.
    """

    def wanted(frames):
        hub, best, alike = None, [], {}
        for pdf in frames:
            keep = []
            for node, shared, w, degree in zip(pdf["node"], pdf["shared"], pdf["weight"], pdf["degree"]):
                if (node, shared) != hub:
                    hub, best, alike = (node, shared), [], {}
                rate, same = w / max(1, degree), alike.get((w, degree), 0)
                # rates that differ by their rounding alone order nothing
                keep.append(same < budget and (len(best) < budget or best[0] < rate + 1e-12 * abs(rate)))
                if keep[-1]:
                    alike[w, degree] = same + 1
                if len(best) < budget:
                    heapq.heappush(best, rate)
                elif rate > best[0]:
                    heapq.heapreplace(best, rate)
            yield pdf[keep]

    columns, order = ["node", "shared", "target_id", "weight", "degree"], ["node", "shared", "target_id"]
    kind = "node string, shared boolean, target_id string, weight double, degree int"
    thin = heavy.select(*columns).where("weight IS NOT NULL").sortWithinPartitions(*order).mapInPandas(wanted, kind)
    return thin.repartition(parts, "node", "shared").sortWithinPartitions(*order).mapInPandas(wanted, kind)


def _hubs(adj: DataFrame, hubs: DataFrame, signed: bool) -> DataFrame:
    """(node, target_id, weight, degree, shared, reach) of the edges of ``hubs`` (node): whether other hubs have the target too,
    and the weight over its degree that they all have for it."""
    heavy = session.checkpointed(adj.join(hubs.select("node"), "node", "left_semi").groupBy("node", "target_id").agg(F.sum("weight").alias("weight"), F.max("degree").alias("degree")))
    most = F.lit(float("inf")) if signed else F.sum("weight") / F.greatest(F.lit(1), F.max("degree"))
    several = heavy.groupBy(F.col("target_id").alias("_t")).agg(F.count("*").alias("_n"), most.alias("reach")).where("_n > 1")
    met = heavy.join(several, F.col("target_id") == F.col("_t"), "left")
    return session.checkpointed(met.select("node", "target_id", "weight", "degree", F.col("_t").isNotNull().alias("shared"), "reach"))


def _rounds(adj: DataFrame, walkers: DataFrame, horizons: list, budget: int, hub: int, edges: int, signed: bool = False) -> DataFrame:
    """(horizon, seed, state) of ended walks, the state their settled mass; ``walkers``: (horizon, seed), ``edges``: how many,
    ``signed``: whether some weigh less than nothing.

    The out-edges of a node that is no hub are one row, dealt out by node once: a round moves what is asked and told, not the
    table.
    """
    spark = adj.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-edges // PART_EDGES))
    stats = session.checkpointed(adj.groupBy("node").agg(F.count("*").alias("n"), F.sum("weight").alias("total")).where(F.col("n") > hub))
    light = adj.join(stats.select("node"), "node", "left_anti").where("target_id IS NOT NULL")
    out = F.collect_list(F.struct(F.col("target_id").alias("target"), "type", "weight", "degree")).alias("out")
    light = session.checkpointed(light.repartition(parts, "node").groupBy("node").agg(out).sortWithinPartitions("node"))
    if any_hub := not stats.isEmpty():
        heavy = _hubs(adj, stats, signed)
        front = heavy if signed else session.checkpointed(fronts(heavy, budget, parts))
        any_shared = not heavy.where("shared").isEmpty()
    by = ["horizon", "seed"]
    first = F.struct(F.array("seed").alias("nodes"), F.array().cast("array<struct<hub:string,target:string>>").alias("pairs"), F.lit(None).cast("string").alias("scan"), F.lit(0).alias("room"),
                     F.array().cast("array<struct<target:string,amount:double>>").alias("owed"), F.array().cast("array<struct<hub:string,share:double>>").alias("shares"), F.array().cast("array<string>").alias("queued"))
    open_ = walkers.select(*by, F.lit(pickle.dumps(None)).alias("state"), first.alias("asked"))
    eps = F.element_at(F.array(*(F.lit(float(e)) for _, e in horizons)), F.col("horizon") + 1)

    def answer(kind: str, **columns) -> list[Column]:
        kinds = {"node": "string", "target": "string", "weight": "double", "out": "array<struct<target:string,type:string,weight:double,degree:int>>"}
        return [*by, F.struct(F.lit(kind).alias("kind"), *((columns[c].cast(k) if c in columns else F.lit(None).cast(k)).alias(c) for c, k in kinds.items())).alias("a")]

    def step(frames):
        for pdf in frames:
            rows = []
            for horizon, seed, state, answers in zip(pdf["horizon"], pdf["seed"], pdf["state"], pdf["answers"]):
                walk, need = pickle.loads(state) or (Walk(seed), {"nodes": [seed]})
                walk.learn(answers if answers is not None else [], need)
                need = walk.run(*horizons[horizon], budget)
                rows.append((horizon, seed, pickle.dumps(walk.p if need is None else (walk, need)), need is None, None if need is None else walk.ask(need)))
            yield pd.DataFrame(rows, columns=["horizon", "seed", "state", "done", "asked"])

    ended = None
    while True:
        nodes = open_.select(*by, F.explode("asked.nodes").alias("node"))
        said = light.join(nodes, "node").select(*answer("edges", node=F.col("node"), out=F.col("out")))
        if any_hub:
            hubs = nodes.join(stats, "node").select(*answer("hub", node=F.col("node"), weight=F.col("total")))
            pairs = open_.select(*by, F.explode("asked.pairs").alias("x")).select(*by, F.col("x.hub").alias("node"), F.col("x.target").alias("target_id"))
            met = pairs.join(heavy, ["node", "target_id"]).select(*answer("pair", node=F.col("node"), target=F.col("target_id"), weight=F.col("weight")))
            said = said.unionByName(hubs).unionByName(met).unionByName(_scanned(open_.where("asked.scan IS NOT NULL"), heavy, front, any_shared, eps, budget, by, answer))
        answers = said.groupBy(*by).agg(F.collect_list("a").alias("answers"))
        moved = open_.join(answers, by, "left").select(*by, "state", "answers")
        with session.batches(spark, BATCH_WALKS):
            moved = session.checkpointed(moved.mapInPandas(step, _STATE))
        now = moved.where("done").select(*by, "state")
        ended = now if ended is None else ended.unionByName(now)
        open_ = moved.where("NOT done").select(*by, "state", "asked")
        if open_.isEmpty():
            return ended


def _scanned(open_: DataFrame, heavy: DataFrame, front: DataFrame, any_shared: bool, eps: Column, budget: int, by: list[str], answer) -> DataFrame:
    """The targets of each walk's pushed hub that join its queue: those owed enough, by name, as many as have room.

    A target that the walk knows nothing of is owed by the hub alone and is in its front, unless the walk has pushed other
    hubs that share it: then the shared edges are summed, those that can come to enough.  Targets that the walk knows are
    looked up.
    """
    share = F.filter("asked.shares", lambda s: s["hub"] == F.col("asked.scan"))[0]["share"]
    most = F.array_max(F.transform("asked.shares", lambda s: s["share"]))
    walk = open_.select(*by, "asked", F.col("asked.scan").alias("node"), share.alias("share"), F.size("asked.shares").alias("hubs"), most.alias("most"))
    degree, none = F.greatest(F.lit(1), F.col("degree")), F.lit(None)

    def due(df: DataFrame, amount=none, told=none, own=1, degree=none, queued=0) -> DataFrame:
        return df.select(*by, "target", amount.cast("double").alias("amount"), told.cast("double").alias("told"), F.lit(own).cast("int").alias("own"), degree.cast("int").alias("degree"), F.lit(queued).alias("queued"))

    gives = F.col("share") * F.col("weight")
    edges = heavy.withColumnRenamed("target_id", "target")
    near = walk.drop("asked").join(front.select("node", "shared", F.col("target_id").alias("target"), "weight", "degree"), "node").where("hubs = 1 OR NOT shared").where(gives / degree >= eps)
    owed = walk.select(*by, "node", "share", "hubs", "asked.shares", F.explode("asked.owed").alias("o"))
    owed = owed.groupBy(*by, "node", F.col("o.target").alias("target")).agg(F.sum("o.amount").alias("owed"), F.first("share").alias("share"), F.first("shares").alias("shares"))
    known = owed.join(edges.drop("reach"), ["node", "target"])
    parts = [due(near, gives, degree=F.col("degree")), due(known, told=F.col("owed") + gives, degree=F.col("degree"))]
    parts.append(due(walk.select(*by, F.explode("asked.queued").alias("target")), own=0, queued=1))
    if any_shared:
        some = edges.where("shared")
        each = walk.where("hubs > 1").select(*by, "most", F.col("node").alias("scan"), F.explode("asked.shares").alias("s")).select(*by, "most", "scan", F.col("s.hub").alias("node"), F.col("s.share").alias("share"))
        far = each.join(some, "node").where(F.col("most") * F.col("reach") * (1 + 1e-9) >= eps)
        rest = known.where("shared").select(*by, F.col("node").alias("scan"), "target", F.explode("shares").alias("s")).where("s.hub <> scan")
        rest = rest.select(*by, "target", F.col("s.hub").alias("node"), F.col("s.share").alias("share")).join(some, ["node", "target"])
        parts += [due(far, gives, own=F.col("node") == F.col("scan"), degree=F.col("degree")), due(rest, told=gives, own=0)]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    total = every.groupBy(*by, "target").agg(F.coalesce(F.sum("told"), F.sum("amount")).alias("amount"), F.max("own").alias("own"), F.max("degree").alias("degree"), F.max("queued").alias("queued"))
    good = total.where((F.col("own") == 1) & (F.col("queued") == 0)).where(F.col("amount") / degree >= eps)
    top = good.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("target"))).where(F.col("n") <= budget)
    fits = top.join(open_.select(*by, F.col("asked.room").alias("room")), by).where(F.col("n") <= F.col("room"))
    return fits.select(*answer("next", target=F.col("target")))


def walks(edges: DataFrame, seeds: DataFrame, horizons: list[tuple[float, float]], budget: int = BUDGET, small: int | None = None, hub: int | None = None, tasks: int | None = None) -> DataFrame:
    """(horizon, seed, id, score): a push from every row of ``seeds`` (seed) for every (alpha, eps); horizon is its place.

    Up to ``SMALL_EDGES`` edges of ``SMALL_BYTES`` go to the walks whole; else all walks share the rounds.  A round is one
    join of what is asked for with the edges (``sized``), and one checkpoint of the walks' states.  Nodes of more than
    ``hub`` out-edges (default ``HUB``) are hubs.  ``tasks`` walk at once (default: as many as shuffle partitions).  Seeds that repeat count once, null seeds are left out.
    """
    spark = edges.sparkSession
    session.ship(spark)
    adj = edges if "degree" in edges.columns else session.checkpointed(sized(edges))
    adj = adj.select(F.col("source_id").alias("node"), "target_id", "type", "weight", "degree")
    which = F.explode(F.array(*(F.lit(i) for i in range(len(horizons))))).alias("horizon")
    size = adj.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("node") + F.octet_length("target_id") + F.octet_length("type")), F.lit(0)).alias("bytes"), F.coalesce(F.min("weight") < 0, F.lit(False)).alias("signed")).first()
    if size.n <= (SMALL_EDGES if small is None else small) and size.bytes <= SMALL_BYTES:
        sent = spark.sparkContext.broadcast(adj.orderBy("node", "target_id", "type").select("node", "target_id", "weight", "degree").toArrow())

        def whole(frames):
            known = None
            for pdf in frames:
                known = known or _Whole(sent.value)
                rows = []
                for horizon, seed in zip(pdf["horizon"], pdf["seed"]):
                    state = start(seed)
                    advance(state, known, *horizons[horizon], budget)
                    rows += [(horizon, seed, k, v) for k, v in state["p"].items()]
                yield pd.DataFrame(rows, columns=["horizon", "seed", "id", "score"])

        # a few hundred seeds are a few KB, which would all meet in one task
        walkers = seeds.where("seed IS NOT NULL").select("seed").distinct().select(which, "seed")
        return walkers.repartition(tasks or int(spark.conf.get("spark.sql.shuffle.partitions")), "horizon", "seed").mapInPandas(whole, "horizon int, seed string, id string, score double")
    ended = _rounds(adj, seeds.where("seed IS NOT NULL").select("seed").distinct().select(which, "seed"), horizons, budget, HUB if hub is None else hub, size.n, size.signed)

    def settle(frames):
        for pdf in frames:
            rows = [(h, seed, k, v) for h, seed, s in zip(pdf["horizon"], pdf["seed"], pdf["state"]) for k, v in pickle.loads(s).items()]
            yield pd.DataFrame(rows, columns=["horizon", "seed", "id", "score"])

    return ended.mapInPandas(settle, "horizon int, seed string, id string, score double")


def local_push(edges: DataFrame, seeds: DataFrame, alpha: float, eps: float, budget: int = BUDGET, small: int | None = None, hub: int | None = None) -> DataFrame:
    """(seed, id, score) of settled mass for every row of ``seeds`` (seed); a seed without edges keeps alpha of its mass."""
    return walks(edges, seeds, [(alpha, eps)], budget, small, hub).drop("horizon")


def ranked(scores: DataFrame, by: list[str] = ["seed"]) -> DataFrame:  # noqa: B006
    """``scores`` with ``rank`` from 1: score descending, then id."""
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id")))


def fuse(lists: list[DataFrame], by: list[str] = ["seed"], k: int = RRF_K) -> DataFrame:  # noqa: B006
    """Reciprocal-rank fusion of ranked lists (by…, id, rank): score is the sum of 1 / (k + rank)."""
    every = lists[0].select(*by, "id", "rank")
    for x in lists[1:]:
        every = every.unionByName(x.select(*by, "id", "rank"))
    return every.groupBy(*by, "id").agg(F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("score"))


def dual_horizon(edges: DataFrame, seeds: DataFrame, budget: int = BUDGET, tasks: int | None = None) -> DataFrame:
    """(seed, id, score, rank): a tight and a wide push, fused, best first and cut at the budget."""
    lists = ranked(walks(edges, seeds, [TIGHT, WIDE], budget, tasks=tasks), ["horizon", "seed"])
    return ranked(fuse([lists])).where(F.col("rank") <= budget)


def push_rounds(edges: DataFrame, seeds: DataFrame, alpha: float, rounds: int) -> DataFrame:
    """(seed, id, score) after synchronous rounds in which all residual moves at once (an extension: no budget)."""
    total = edges.groupBy("source_id").agg(F.sum("weight").alias("total"))
    share = edges.join(total, "source_id").select("source_id", "target_id", (F.col("weight") / F.col("total")).alias("share"))
    r = seeds.select("seed", F.col("seed").alias("id"), F.lit(1.0).alias("r"))
    settled = None
    for _ in range(rounds):
        here = r.select("seed", "id", (F.lit(alpha) * F.col("r")).alias("score"))
        settled = here if settled is None else settled.unionByName(here)
        r = r.join(share, r.id == share.source_id).groupBy("seed", F.col("target_id").alias("id")).agg(F.sum(F.lit(1 - alpha) * F.col("r") * F.col("share")).alias("r"))
    return settled.groupBy("seed", "id").agg(F.sum("score").alias("score"))


def adjacency(edges: DataFrame) -> DataFrame:
    """(id, neighbours): undirected, each neighbour once; nodes without edges are absent."""
    both = edges.select(F.col("source_id").alias("id"), F.col("target_id").alias("n")).union(edges.select("target_id", "source_id"))
    return both.groupBy("id").agg(F.array_sort(F.collect_set("n")).alias("neighbours"))


def redundancy(a: Column, na: Column, b: Column, nb: Column) -> Column:
    """1 if either is a neighbour of the other, else the Jaccard likeness of neighbourhoods; 0 where one is missing or
    empty."""
    both = F.size(F.array_union(na, nb))
    jaccard = F.size(F.array_intersect(na, nb)) / both
    return (
        F.when(na.isNull() | nb.isNull(), 0.0)
        .when(F.array_contains(na, b) | F.array_contains(nb, a), 1.0)
        .when((F.size(na) == 0) | (F.size(nb) == 0), 0.0)
        .otherwise(jaccard)
    )


def redundancy_py(a: str, b: str, adj: dict[str, set]) -> float:
    if a not in adj or b not in adj:
        return 0.0
    if b in adj[a] or a in adj[b]:
        return 1.0
    if not adj[a] or not adj[b]:
        return 0.0
    return len(adj[a] & adj[b]) / len(adj[a] | adj[b])


def mmr_py(candidates: list[tuple[str, float]], alike, k: int, trade: float = 0.7) -> list[tuple[str, float]]:
    """Greedy choice: relevance against the largest redundancy with what is chosen; the earliest wins ties.

    alike: neighbours by node, or a function of two nodes.
    """
    redundant = alike if callable(alike) else lambda a, b: redundancy_py(a, b, alike)
    left, chosen = [(c, rel, 0.0) for c, rel in candidates], []
    while left and len(chosen) < k:
        scores = [trade * rel - (1 - trade) * worst for _, rel, worst in left]
        best = max(range(len(left)), key=lambda i: (scores[i], -i))
        new = left.pop(best)[0]
        chosen.append((new, scores[best]))
        left = [(c, rel, max(worst, redundant(c, new))) for c, rel, worst in left]
    return chosen


def pair_redundancy(candidates: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, a, b, redundancy) of the candidates' pairs a < b that are linked or share a neighbour.

    Neighbours stay rows: a hub's are counted where they lie, and only a query's own pairs are made.  Edges with a
    ``query_id`` are that query's alone.
    """
    own = ["query_id"] if "query_id" in edges.columns else []
    ids = candidates.select(*own, "id").distinct()
    near = edges.select(*own, F.col("source_id").alias("id"), F.col("target_id").alias("n")).union(edges.select(*own, "target_id", "source_id")).join(ids, [*own, "id"], "left_semi").distinct()
    met = candidates.select("query_id", "id").join(near, [*own, "id"])
    size = near.groupBy(*own, "id").agg(F.count("*").alias("size"))
    chosen = candidates.select("query_id", F.col("id").alias("n"))
    linked = met.join(chosen, ["query_id", "n"]).where("id <> n").select("query_id", F.least("id", "n").alias("a"), F.greatest("id", "n").alias("b"), F.lit(1).alias("link"), F.lit(0).alias("one"))
    mates = met.groupBy("query_id", "n").agg(F.collect_set("id").alias("ids")).where(F.size("ids") > 1)
    mates = mates.select("query_id", "ids", F.explode("ids").alias("a")).select("query_id", "a", F.explode("ids").alias("b")).where("a < b")
    shared = mates.select("query_id", "a", "b", F.lit(0).alias("link"), F.lit(1).alias("one"))
    both = shared.unionByName(linked).groupBy("query_id", "a", "b").agg(F.max("link").alias("link"), F.sum("one").alias("both"))
    sizes = lambda c: size.select(*own, F.col("id").alias(c), F.col("size").alias(f"size_{c}"))
    full = both.join(sizes("a"), [*own, "a"]).join(sizes("b"), [*own, "b"])
    return full.select("query_id", "a", "b", F.when(F.col("link") == 1, 1.0).otherwise(F.col("both") / (F.col("size_a") + F.col("size_b") - F.col("both"))).alias("redundancy"))


def mmr(candidates: DataFrame, edges: DataFrame, k: int = 10, trade: float = 0.7) -> DataFrame:
    """(query_id, id, score, pick) from candidates (query_id, id, relevance, rank), at most a budget's worth a query.

    A query's group is its candidates and, for each, the redundancy with the others (a budget's square at most).
    """
    session.ship(candidates.sparkSession)
    candidates = candidates.select("query_id", "id", "relevance", "rank")
    pairs = pair_redundancy(candidates, edges)
    with_ = pairs.groupBy("query_id", F.col("a").alias("id")).agg(F.collect_list(F.struct("b", "redundancy")).alias("alike"))
    given = candidates.join(with_, ["query_id", "id"], "left")

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rank", "id"])
        known = {(a, x["b"]): x["redundancy"] for a, others in zip(pdf["id"], pdf["alike"]) if others is not None for x in others}
        got = mmr_py(list(zip(pdf["id"], pdf["relevance"])), lambda a, b: known.get((min(a, b), max(a, b)), 0.0), k, trade)
        return pd.DataFrame({"query_id": pdf["query_id"].iloc[0], "id": [i for i, _ in got], "score": [s for _, s in got], "pick": range(1, len(got) + 1)})

    query_type = given.schema["query_id"].dataType.simpleString()
    return given.groupBy("query_id").applyInPandas(choose, f"query_id {query_type}, id string, score double, pick int")
