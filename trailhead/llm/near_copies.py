"""Near copies by resemblance: wide SimHash, keys of Golay codewords, whole sets to decide.

For documents that resemble each other by 0.8 the 64 bits of ``simhash`` differ in about ten, too many for three
segments.  The same method is therefore used with more bits and with decoding that knows how certain each bit is:

1. A document is the set of its shingles.  The set's signed counts in 2,048 bins are projected on Hadamard rows; the
   signs of the projections are a SimHash of any width, their sizes tell how certain each sign is.
2. Five segments of 23 projections are decoded to the six nearest of the 4,096 Golay codewords each.  Two sets at 0.8
   share one of six in a segment with probability 0.95, so (pigeonhole) two of five segments agree but for rare cases.
   A key is a pair of codewords of two segments; of each of the ten pairs of segments the twelve best are kept.
3. Nodes that share a key and differ in few of 192 further bits are candidates.  In a bucket, candidates are found
   breadth first: what is linked already is not compared again, so a group of copies is linear in its size, and a bucket
   of unlike members is cut again by bands of bits beyond ``DENSE`` members.
4. Candidates chain to groups.  Only the sets of documents in a group are fetched, once a group; there, breadth first
   again, 1,024 bits and then the whole sets decide.  Groups of more than ``GROUP_BYTES`` are dealt in pairs of blocks.

Equal sets collapse first.  In a map task the members of a bucket that lie within ``TIGHT`` of its first one are linked
to it and not sent: whatever resembles such a member lies within the candidates' bound of the first one too.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import golay, hashes, runtime
from .components import components, runs, stars

SHINGLE, SIMILARITY = 5, 0.8
BINS, SEGMENTS, CODEWORDS, KEYS = 2048, 5, 6, 12
#: Bits that candidates and members of a group are compared by.
CANDIDATE_BITS, GROUP_BITS = 192, 1024
#: Standard deviations that a distance may exceed its mean by; sets of fewer shingles have coarser projections.
SLACK, FEW, COARSE = 3.2, 48, 0.05
TIGHT = 12
#: Buckets of up to this many entries are compared at all lags at once; beyond DENSE they are cut by bands first.
SMALL, DENSE, BANDS, BAND_BITS = 32, 4096, 30, 12
#: Bytes of a group's sets that one task holds, and of a shard's entries; a map task sends after so many entries.
GROUP_BYTES, SHARD_BYTES, _FLUSH = 64 << 20, 64 << 20, 1 << 18
#: The filter of wanted nodes, in bits; it only spares work.
WANTED = 1 << 25
_PAIRS = list(combinations(range(SEGMENTS), 2))
_KEYS = len(_PAIRS) * KEYS
_ENTRY = np.dtype([("key", "<u4"), ("n", "<u2"), ("node", "<i8"), ("bits", "<u8", CANDIDATE_BITS // 64)])
_EPS = 1e-9
LONG, _BYTES = runtime.LONG, 1 << 20


def shingle_sets(data: np.ndarray, off: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the distinct shingles of document d, ascending, are hashes[first[d]:first[d+1]].

    Fewer words than a shingle: the whole sequence is one.  No word: none.
    """
    low = hashes.LOWER[data]
    s, e, first = hashes.word_spans(low, off, hashes.NOT_SPACE)
    x = hashes.span_hashes(low, s, e)
    g, n = hashes.grams(x, shingle), np.diff(first)
    long = np.flatnonzero(n >= shingle)
    many = n[long] - shingle + 1
    within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    h, doc = g[np.repeat(first[long], many) + within], np.repeat(long, many)
    few = np.flatnonzero((n > 0) & (n < shingle))
    h = np.concatenate([h, *(hashes.grams(x[first[i] : first[i + 1]], int(n[i])) for i in few)])
    doc = np.concatenate([doc, few])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.searchsorted(doc[new], np.arange(len(n) + 1))


def _long_set(data: np.ndarray, shingle: int) -> np.ndarray:
    """The distinct shingles of a long text, gathered from parts; a part repeats the last words of the one before."""
    got, words = np.zeros(0, np.uint64), 0
    for a, b, repeats in runtime.parts(data, hashes.NOT_SPACE, shingle - 1, LONG):
        low = hashes.LOWER[data[a:b]]
        s, e, _ = hashes.word_spans(low, np.array([0, b - a]), hashes.NOT_SPACE)
        got = np.union1d(got, hashes.grams(hashes.span_hashes(low, s, e), shingle))
        words += len(s) - repeats
    return got if words >= shingle else shingle_sets(data, np.array([0, len(data)]), shingle)[0]


def projections(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(documents, BINS): the signed counts of each set's shingles in bins, times the Hadamard matrix."""
    n = len(first) - 1
    r = hashes.mix(h, 29)
    at = np.repeat(np.arange(n), np.diff(first)) * BINS + (r % np.uint64(BINS)).astype(np.int64)
    v = np.bincount(at, weights=np.where(r >> np.uint64(63), 1.0, -1.0), minlength=n * BINS).astype(np.float32)
    width = 1
    while width < BINS:
        v = v.reshape(n, -1, 2, width)
        v = np.stack([v[:, :, 0] + v[:, :, 1], v[:, :, 0] - v[:, :, 1]], axis=2)
        width *= 2
    return v.reshape(n, BINS)


def print_of(p: np.ndarray, bits: int) -> np.ndarray:
    """(documents, bits / 64): the signs of the projections after those that make keys."""
    return np.packbits(p[:, BINS - bits :] > 0, axis=1).view(np.uint64)


def keys_of(p: np.ndarray) -> np.ndarray:
    """(documents, _KEYS) hashed keys: the best pairs of codewords for each pair of segments; 0 where there are fewer."""
    near = [golay.nearest(p[:, 23 * i : 23 * i + 23], CODEWORDS, 6) for i in range(SEGMENTS)]
    out = []
    for number, (i, j) in enumerate(_PAIRS):
        score = (near[i][1][:, :, None] + near[j][1][:, None, :]).reshape(len(p), -1)
        key = (number << 24 | near[i][0][:, :, None] << 12 | near[j][0][:, None, :]).reshape(len(p), -1)
        best = np.argpartition(-score, KEYS, axis=1)[:, :KEYS]
        key = hashes.mix(np.take_along_axis(key, best, 1).view(np.uint64), 31)
        out.append(np.where(np.isfinite(np.take_along_axis(score, best, 1)), key | np.uint64(1), np.uint64(0)))
    return np.concatenate(out, axis=1)


def _blocks(batch, shingle: int):
    """(first row, last, node, check, hashes, first) for every 64 rows; node and check are hashes of the set."""
    data, off = runtime.bytes_of(batch.column("_t"))
    for a, b in ((x, min(x + 64, q)) for p, q in runtime.pieces(off, _BYTES) for x in range(p, q, 64)):
        if b == a + 1 and off[b] - off[a] > LONG:
            h = _long_set(data[off[a] : off[b]], shingle)
            first = np.array([0, len(h)])
        else:
            h, first = shingle_sets(data[off[a] : off[b]], off[a : b + 1] - off[a], shingle)
        raw = [h[i:j].tobytes() for i, j in zip(first[:-1], first[1:])]
        node, check = (np.array([xxhash.xxh3_64_intdigest(r, seed) for r in raw], np.uint64).view(np.int64) for seed in (0, 1))
        yield a, b, node, check, h, first


def _prints(shingle: int):
    def f(batches):
        for batch in batches:
            for a, b, node, check, h, first in _blocks(batch, shingle):
                p = projections(h, first)
                blob = np.concatenate([keys_of(p), print_of(p, CANDIDATE_BITS)], axis=1)
                cols = [batch.column("_id").slice(a, b - a), pa.array(node), pa.array(check), pa.array(np.diff(first)), pa.array([r.tobytes() for r in blob], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["_id", "node", "check", "n", "blob"])

    return f


def _allowed(t: float, bits: int, n: np.ndarray) -> np.ndarray:
    """Differing bits that two sets of n shingles may show if they resemble each other by t."""
    p = math.acos(2 * t / (1 + t)) / math.pi
    return bits * p + SLACK * math.sqrt(bits * p * (1 - p)) + np.where(n < FEW, COARSE * bits, 0)


def _differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


def breadth_first(bits: np.ndarray, n: np.ndarray, t: float, good=None, block: np.ndarray | None = None):
    """Links (i, j) that join all members that candidates chain: no member is compared with one it is chained to.

    ``good(i, js)`` tells which candidates are links; without it all are.  ``block``: only members of different ones.
    """
    todo = np.arange(len(n))
    low, high = np.ceil(t * n - _EPS), n / t + _EPS
    allowed = _allowed(t, bits.shape[1] * 64, n)
    while len(todo) > 1:
        queue, todo = [todo[0]], todo[1:]
        while queue and len(todo):
            i = queue.pop()
            near = (n[todo] >= low[i]) & (n[todo] <= high[i])
            if block is not None:
                near &= block[todo] != block[i]
            at = np.flatnonzero(near)
            at = at[_differ(bits[todo[at]], bits[i]) <= np.maximum(allowed[i], allowed[todo[at]])]
            if len(at) and good is not None:
                at = at[good(i, todo[at])]
            if len(at):
                found = todo[at]
                yield i, found
                queue.extend(found)
                todo = np.delete(todo, at)


def _bands(bits: np.ndarray):
    """Orders of the members, cut where a band of BAND_BITS bits changes."""
    raw = np.unpackbits(np.ascontiguousarray(bits).view(np.uint8), axis=1)
    r = np.random.default_rng(5)
    for _ in range(BANDS):
        value = raw[:, r.permutation(raw.shape[1])[:BAND_BITS]] @ (1 << np.arange(BAND_BITS))
        order = np.argsort(value, kind="stable")
        yield order, *runs(value[order])


def _bucket(e: np.ndarray, t: float, dense: int):
    """Arrays (nodes, nodes) of candidates in a bucket."""
    n = e["n"].astype(np.int64)
    parts = [np.arange(len(e))]
    if len(e) > dense:
        parts = (order[a:b] for order, at, to in _bands(e["bits"]) for a, b in zip(at, to) if b - a > 1)
    for part in parts:
        for i, found in breadth_first(e["bits"][part], n[part], t):
            yield np.full(len(found), e["node"][part[i]]), e["node"][part[found]]


def _send(n_shards: int):
    """Entries packed by the shard of their keys (kind 0), and links of members that are not sent (kind 1)."""

    def packed(shard: np.ndarray, part: np.ndarray, kind: int):
        order = np.argsort(shard, kind="stable")
        at, to = runs(shard[order])
        if len(order):
            loads = pa.array([part[order[a:b]].tobytes() for a, b in zip(at, to)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(shard[order][at].astype(np.int32)), pa.array(np.full(len(at), kind, np.int32)), loads], ["shard", "kind", "load"])

    def flush(held):
        key, part = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(key, kind="stable")
        key, part = key[order], part[order]
        at, to = runs(key)
        head = np.repeat(at, to - at)
        tight = (head != np.arange(len(key))) & (_differ(part["bits"], part["bits"][head]) <= TIGHT)
        links = np.unique(np.stack([part["node"][tight], part["node"][head[tight]]], 1), axis=0)
        key, part = key[~tight], part[~tight]
        yield from packed((key >> np.uint64(32)) % np.uint64(n_shards), part, 0)
        yield from packed(links[:, 0].view(np.uint64) % np.uint64(n_shards), links, 1)

    def f(batches):
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            blob = np.frombuffer(b"".join(batch.column("blob").to_pylist()), np.uint64).reshape(batch.num_rows, -1)
            row, col = np.nonzero(blob[:, :_KEYS])
            key, part = blob[row, col], np.empty(len(row), _ENTRY)
            part["key"], part["bits"] = key & np.uint64(0xFFFFFFFF), blob[row, _KEYS:]
            part["node"] = batch.column("node").to_numpy()[row]
            part["n"] = np.minimum(batch.column("n").to_numpy()[row], 0xFFFF)
            held.append((key, part))
            size += len(row)
            if size >= _FLUSH:
                yield from flush(held)
                held, size = [], 0
        if size:
            yield from flush(held)

    return f


def _meet(t: float, dense: int):
    """(x, y): candidates of a shard, as stars: what is chained there is linked to its smallest node."""

    def f(batches):
        entries, out = [], []
        for batch in batches:
            for kind, load in zip(batch.column("kind").to_pylist(), batch.column("load").to_pylist()):
                if kind:
                    out.append(np.frombuffer(load, np.int64).reshape(-1, 2))
                else:
                    entries.append(np.frombuffer(load, _ENTRY))
        if entries:
            e = np.concatenate(entries)
            del entries
            e = e[np.lexsort((e["node"], e["key"]))]
            at, to = runs(e["key"])
            size = to - at
            small = e[np.repeat((size > 1) & (size <= SMALL), size)]
            n = small["n"].astype(np.int64)
            allowed = _allowed(t, CANDIDATE_BITS, n)
            for lag in range(1, SMALL):
                i = np.flatnonzero(small["key"][lag:] == small["key"][:-lag])
                if not len(i):
                    break
                i = i[np.minimum(n[i], n[i + lag]) >= t * np.maximum(n[i], n[i + lag]) - _EPS]
                i = i[_differ(small["bits"][i], small["bits"][i + lag]) <= np.maximum(allowed[i], allowed[i + lag])]
                out.append(np.unique(np.stack([small["node"][i], small["node"][i + lag]], 1), axis=0))
            for a, b in zip(at[size > SMALL], to[size > SMALL]):
                out += [np.stack(pair, 1) for pair in _bucket(e[a:b], t, dense)]
        if out:
            x = stars(np.concatenate(out))
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x[:, 0])), pa.array(np.ascontiguousarray(x[:, 1]))], ["x", "y"])

    return f


def _wanted(nodes: DataFrame) -> np.ndarray:
    """The low bits of wanted nodes, as a map: WANTED bits, whatever the number of nodes."""
    slot = F.col("node").bitwiseAND(F.lit(WANTED - 1))
    page, at = F.shiftright(slot, 15), slot.bitwiseAND(F.lit((1 << 15) - 1))
    bits = np.zeros((WANTED >> 15, 4096), np.uint8)
    for r in nodes.select(page.alias("page"), at.alias("at")).groupBy("page").agg(F.bitmap_construct_agg("at").alias("bits")).collect():
        bits[r.page] = np.frombuffer(r.bits, np.uint8)
    return bits.reshape(-1)


def _sets(shingle: int, wanted):
    """(node, check, set) of the wanted nodes (and of a few others), each once a task."""

    def f(batches):
        met, wanted_bits = set(), wanted.value
        for batch in batches:
            for _, _, node, check, h, first in _blocks(batch, shingle):
                slot = node & (WANTED - 1)
                near = wanted_bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1
                new = [d for d in np.flatnonzero(near) if not (node[d] in met or met.add(node[d]))]
                yield pa.RecordBatch.from_arrays([pa.array(node[new]), pa.array(check[new]), pa.array([h[first[d] : first[d + 1]].tobytes() for d in new], pa.binary())], ["node", "check", "set"])

    return f


def _decide(t: float):
    """(x, y): of each group (root, a, b) the members whose whole sets resemble each other by t, as stars."""

    def links(a, b, nodes, blocks, sets):
        node, one = np.unique(np.array(nodes, np.int64), return_index=True)
        sets = [np.frombuffer(sets[i], np.uint64) for i in one]
        n = np.array([len(s) for s in sets], np.int64)
        bits = np.concatenate([print_of(projections(np.concatenate(sets[i : i + 64]), np.concatenate([[0], np.cumsum(n[i : i + 64])])), GROUP_BITS) for i in range(0, len(n), 64)])

        def good(i, js):
            both = np.array([np.isin(sets[j], sets[i], assume_unique=True).sum() for j in js])
            return both >= t * (n[i] + n[js] - both) - _EPS

        links = [np.stack([np.full(len(found), node[i]), node[found]], 1) for i, found in breadth_first(bits, n, t, good, None if a == b else np.array(blocks)[one])]
        if links:
            x = stars(np.concatenate(links))
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x[:, 0])), pa.array(np.ascontiguousarray(x[:, 1]))], ["x", "y"])

    def f(batches):
        now, held = None, ([], [], [])
        for batch in batches:
            for root, a, b, node, block, s in zip(*(batch.column(c).to_pylist() for c in ("root", "a", "b", "node", "block", "set"))):
                if (root, a, b) != now:
                    if now:
                        yield from links(*now[1:], *held)
                    now, held = (root, a, b), ([], [], [])
                for column, value in zip(held, (node, block, s)):
                    column.append(value)
        if now:
            yield from links(*now[1:], *held)

    return f


def similar(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", dense: int = DENSE, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(id, component_id): classes of documents whose shingle sets resemble each other by ``similarity`` or more.

    No pair below it is linked; a pair at 0.8 is found with a probability of about 0.99, more alike ones more surely (the
    README has the measured curve).  Sets are told apart by 128 bits of hash.  Texts without words (null, empty, white
    space) are one class.  Null ids, repeated rows and other columns as in ``simhash.classes``; empty input: no rows.
    """
    spark = docs.sparkSession
    runtime.tune(spark)
    never = F.lit(2**63 - 1)
    base = docs.select(F.col(id_col).cast("long").alias("_id"), runtime.text_key(id_col, text_col)[1])
    rows = runtime.stored(base.mapInArrow(_prints(shingle), "_id long, node long, check long, n long, blob binary"), "rows")
    first = F.min(F.struct("check", F.coalesce("_id", never).alias("id")))
    prints = runtime.stored(
        rows.groupBy("node").agg(first.alias("a"), F.count("*").alias("rows"), F.min_by("n", "check").alias("n"), F.min_by("blob", "check").alias("blob")).select("node", "a.check", F.col("a.id").alias("least"), "rows", "n", "blob"), "prints"
    )
    shards = max(runtime.partitions(spark), -(-prints.count() * _KEYS * _ENTRY.itemsize // SHARD_BYTES))
    sent = prints.where("n > 0").select("node", "n", "blob").mapInArrow(_send(shards), "shard int, kind int, load binary")
    near = runtime.stored(sent.repartitionById(shards, "shard").mapInArrow(_meet(similarity, dense), "x long, y long"), "candidates")
    roots = runtime.stored(components(near, "x", "y"), "roots")
    members = roots.union(roots.select("root", "root").distinct()).join(prints.select("node", "check", "n"), "node")
    blocks = F.ceil(F.sum("n") * 16 / group_bytes).cast("int")  # a pair of blocks holds group_bytes, of 8 a shingle
    sizes = members.groupBy("root").agg(F.when(F.sum("n") * 8 <= group_bytes, F.lit(1)).otherwise(blocks).alias("blocks"))
    members = runtime.stored(members.join(sizes, "root").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")), "members")
    wanted = spark.sparkContext.broadcast(_wanted(members.select("node")))
    sets = base.mapInArrow(_sets(shingle, wanted), "node long, check long, set binary").join(members, ["node", "check"])
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = sets.select("root", "node", "block", "set", other.alias("_o")).select("root", F.least("block", "_o").alias("a"), F.greatest("block", "_o").alias("b"), "node", "block", "set")
    n = runtime.partitions(spark)
    dealt = dealt.repartition(n, "root", "a", "b").sortWithinPartitions("root", "a", "b")
    found = runtime.stored(dealt.mapInArrow(_decide(similarity), "x long, y long"), "links")
    if members.where("blocks > 1").isEmpty():
        classes = found.select("x", F.col("y").alias("root"))  # a group's stars are its classes
    else:
        classes = components(found, "x", "y").withColumnRenamed("node", "x")
    member = prints.join(classes, prints.node == classes.x, "left").select("node", "check", "least", "rows", F.coalesce("root", "node").alias("root"))
    member = runtime.stored(member, "classes")
    called = member.groupBy("root").agg(F.min("least").alias("called"), F.count("*").alias("_n"))
    label = runtime.lookup(member, called, "root", "_n", member.count()).select("node", "rows", F.col("check").alias("_check"), F.nullif("called", never).alias("called"))
    own = F.when(F.col("check") == F.col("_check"), F.col("called")).otherwise(F.col("_id"))
    return runtime.lookup(rows.select("_id", "node", "check"), label, "node", "rows", rows.count()).select(F.col("_id").alias(id_col), own.alias("component_id"))


def dedup(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each class of ``similar``, the one with the smallest id, with all its columns.

    Different texts under one id are documents of their own (the order among them is that of the text's hash); rows that
    repeat both id and text are one.  Rows with a null id are kept, since they name no class.
    """
    plain, names = runtime.plain(docs)
    at = {c: f"_c{names.index(c)}" for c in (id_col, text_col)}
    keyed = runtime.order_keys(plain.where(F.col(at[id_col]).isNotNull()), at[id_col], at[text_col])
    keep = similar(keyed, shingle, similarity, "_k", "_t").where("_k = component_id").select("_k").distinct()
    kept = keyed.join(keep, "_k", "left_semi").dropDuplicates(["_k"]).select(*plain.columns)
    return kept.unionByName(plain.where(F.col(at[id_col]).isNull())).toDF(*names)
