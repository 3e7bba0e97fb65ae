"""SimHash near-duplicate classes by Golay-code fuzzy hashing.

A document's 64-bit fingerprint is the bitwise majority of its shingles' XXH64 values.  Fingerprints within 3 bits are
linked; classes are the connected components.

Search: a fingerprint is cut into segments of 22, 21 and 21 bits.  Three errors leave at least two segments with one
error at most (pigeonhole), and those two decode to nearby codewords.  The key of a pair of segments is the pair of
codeword indices, 24 bits and the pair's number.  Each fingerprint has one *home* key a pair (nearest codewords) and
1, 6 or 36 *near* keys, the home key among them; of two linked fingerprints one's home key is among the other's near
keys, so all that share a key meet every link.  They meet in the key's shard, where popcounts verify.

Copies: equal fingerprints collapse before the search, so no group of copies is ever paired.  In a bucket links are found
breadth first: what is chained is not compared again.  A bucket of more than ``BLOCKED`` members is cut by every three of
six blocks of bits first: three errors leave three blocks without any, so that loses nothing.  What leaves a shard is one
link for each member, to the smallest that it is chained to there.

Keys that are home to more than ``bucket_cap`` fingerprints are no task's business.  Their members meet at a point: two
words within 3 bits have a word z within 2 bits of one and 1 bit of the other, so members emit the 2,081 words within
2 bits, their possible partners the 65 words within 1 bit, and all that meet at a z that has a partner are linked to one
of its partners.  That is linear in the number of fingerprints, and every link it adds is a true one.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import golay, hashes, runtime
from .components import components, runs, stars
from .near_copies import dedup, similar  # noqa: F401  the same method for resemblance, with a wider fingerprint

MAX_BITS = 3
SHINGLE = 3
SEED = 42
#: Distinct fingerprints that are at home in one key before they meet at points; members of a bucket before it is cut.
BUCKET_CAP, BLOCKED, SMALL = 100_000, 4096, 32
SHARD_BYTES = 64 << 20
_ENTRY = np.dtype([("key", "<u4"), ("home", "?"), ("fp", "<u8")])
_CHUNK = 1 << 18
_SEGMENTS = ((0, 22), (22, 21), (43, 21))
_PAIRS = ((0, 1), (0, 2), (1, 2))


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Majority of the shingles' hashes; no word: zero; fewer words than a shingle: the whole sequence is one.

    The text is worked through in chunks, so memory stays bounded for very long texts.
    """
    votes, n, carry, digest = np.zeros(64, np.int64), 0, [], xxhash.xxh64_intdigest
    a = 0
    while a < len(text):
        b = min(len(text), a + _CHUNK)
        while b < len(text) and text[b] not in b" \t\n\x0b\x0c\r":
            b += 1
        words = carry + text[a:b].lower().split()
        grams = [b" ".join(g) for g in zip(*(words[i:] for i in range(shingle)))] if len(words) >= shingle else []
        if grams:
            h = np.array([digest(g, seed) for g in grams], ">u8")
            votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
            n += len(grams)
            words = words[len(words) - shingle + 1 :] if shingle > 1 else []
        carry, a = words, b
    if not n:
        return digest(b" ".join(carry), seed) if carry else 0
    return int.from_bytes(np.packbits(votes * 2 > n).tobytes(), "big")


def _fingerprints(batches):
    for batch in batches:
        data, off = runtime.bytes_of(batch.column("_t"))
        raw = data.tobytes()
        fp = np.array([fingerprint(raw[s:e]) for s, e in zip(off[:-1], off[1:])], np.uint64)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c != "_t"), pa.array(fp.view(np.int64))], [*(c for c in batch.schema.names if c != "_t"), "_fp"])


def _segments(fp: np.ndarray) -> list[np.ndarray]:
    return [((fp >> np.uint64(s)) & np.uint64((1 << n) - 1)).astype(np.int64) for s, n in _SEGMENTS]


def _home(batches):
    """Three rows a fingerprint: its home keys."""
    for batch in batches:
        fp = batch.column("_fp").to_numpy().view(np.uint64)
        home = [golay.decode(x)[0] for x in _segments(fp)]
        key = np.concatenate([(p << 24) | (home[i] << 12) | home[j] for p, (i, j) in enumerate(_PAIRS)])
        yield pa.RecordBatch.from_arrays([pa.array(np.tile(fp.view(np.int64), 3)), pa.array(key)], ["y", "key"])


def _near_keys(fp: np.ndarray):
    """(rows, keys, home) of a pair of segments after the other: pairs of codewords within distance 4 of both; the first
    of each row is its home key."""
    near = [golay.nearby(x) for x in _segments(fp)]
    for p, (i, j) in enumerate(_PAIRS):
        a, b = near[i][:, :, None], near[j][:, None, :]
        key = np.where((a >= 0) & (b >= 0), (p << 24) | (a << 12) | b, -1).reshape(len(fp), 36)
        row, col = np.nonzero(key >= 0)
        yield row, key[row, col], col == 0


def _near(batches):
    for batch in batches:
        fp = batch.column("_fp").to_numpy().view(np.uint64)
        for row, key, _ in _near_keys(fp):
            yield pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)[row]), pa.array(key)], ["x", "key"])


def _send(n_shards: int, dense: np.ndarray):
    """Entries of the near keys but for dense ones, packed by the shard of the key."""

    def f(batches):
        for batch in batches:
            fp = batch.column("_fp").to_numpy().view(np.uint64)
            parts = []
            for row, key, home in _near_keys(fp):
                part = np.empty(len(row), _ENTRY)
                part["key"], part["fp"], part["home"] = key, fp[row], home
                parts.append(part[~np.isin(key, dense)] if len(dense) else part)
            part = np.concatenate(parts)
            shard = (hashes.mix(part["key"].astype(np.uint64), 37) % np.uint64(n_shards)).astype(np.int32)
            part = part[order := np.argsort(shard, kind="stable")]
            at, to = runs(shard[order])
            yield pa.RecordBatch.from_arrays([pa.array(shard[order][at]), pa.array([part[a:b].tobytes() for a, b in zip(at, to)], pa.binary())], ["shard", "load"])

    return f


def _chain(fp: np.ndarray, home: np.ndarray):
    """Links (i, js) that join all members chained by links of which one end at least is at home."""
    todo = np.arange(len(fp))
    while len(todo) > 1:
        queue, todo = [todo[0]], todo[1:]
        while queue and len(todo):
            i = queue.pop()
            good = np.bitwise_count(fp[todo] ^ fp[i]) <= MAX_BITS
            if not home[i]:
                good &= home[todo]
            if good.any():
                yield i, todo[good]
                queue.extend(todo[good])
                todo = todo[~good]


def _bucket(fp: np.ndarray, home: np.ndarray, blocked: int):
    if len(fp) <= blocked:
        yield from ((fp[i], fp[js]) for i, js in _chain(fp, home))
        return
    for blocks in combinations(range(6), 3):
        value = fp & np.uint64(sum(((1 << min(11, 64 - 11 * b)) - 1) << 11 * b for b in blocks))
        order = np.argsort(value, kind="stable")
        for a, b in zip(*runs(value[order])):
            if b - a > 1:
                part = order[a:b]
                yield from ((fp[part[i]], fp[part[js]]) for i, js in _chain(fp[part], home[part]))


def _meet(blocked: int):
    """(x, y): the links of a shard, as stars."""

    def f(batches):
        loads = [np.frombuffer(load, _ENTRY) for batch in batches for load in batch.column("load").to_pylist()]
        if not loads:
            return
        e = np.concatenate(loads)
        del loads
        e = e[np.lexsort((e["fp"], e["key"]))]
        at, to = runs(e["key"])
        size, out = to - at, []
        small = e[np.repeat((size > 1) & (size <= SMALL), size)]
        for lag in range(1, SMALL):
            i = np.flatnonzero(small["key"][lag:] == small["key"][:-lag])
            if not len(i):
                break
            x, y = small["fp"][i], small["fp"][i + lag]
            good = np.bitwise_count(x ^ y) <= MAX_BITS
            out.append(np.stack([x[good], y[good]], 1))
        for a, b in zip(at[size > SMALL], to[size > SMALL]):
            out += [np.stack([np.full(len(js), i, np.uint64), js], 1) for i, js in _bucket(e["fp"][a:b], e["home"][a:b], blocked)]
        if out:
            x = stars(np.concatenate(out).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x[:, 0])), pa.array(np.ascontiguousarray(x[:, 1]))], ["x", "y"])

    return f


def _masks(r: int) -> np.ndarray:
    return np.array([sum(1 << b for b in c) for k in range(r + 1) for c in combinations(range(64), k)], np.uint64)


def _ball(radius: int):
    masks = _masks(radius)

    def f(batches):
        for batch in batches:
            fp = batch.column("_fp").to_numpy().view(np.uint64)
            for a in range(0, len(fp), 256):
                z = fp[a : a + 256, None] ^ masks
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(fp[a : a + 256], len(masks)).view(np.int64)), pa.array(z.reshape(-1).view(np.int64))], ["_fp", "z"])

    return f


def links(prints: DataFrame, bucket_cap: int = BUCKET_CAP, blocked: int = BLOCKED) -> DataFrame:
    """(x, y): a table of links between distinct fingerprints ``_fp`` (stored) whose transitive closure is that of all
    pairs within 3 bits."""
    spark = prints.sparkSession
    n, rows = runtime.partitions(spark), prints.count()
    home = prints.mapInArrow(_home, "y long, key long")
    dense = []
    if rows > bucket_cap:  # else no key can be
        dense = home.groupBy("key").count().where(F.col("count") > bucket_cap).select("key").collect()  # 3 rows / bucket_cap at most
    keys = np.array(sorted(r.key for r in dense), np.int64)
    shards = max(n, -(-rows * 50 * _ENTRY.itemsize // SHARD_BYTES))  # 48 near keys a fingerprint on average
    found = prints.mapInArrow(_send(shards, keys), "shard int, load binary").repartitionById(shards, "shard").mapInArrow(_meet(blocked), "x long, y long")
    if dense:
        named = runtime.stored(spark.createDataFrame(dense, "key long"), "dense")
        two = home.join(F.broadcast(named), "key", "left_semi").select(F.col("y").alias("_fp")).distinct().repartition(n, "_fp")
        one = prints.mapInArrow(_near, "x long, key long").join(F.broadcast(named), "key", "left_semi").select(F.col("x").alias("_fp")).distinct().repartition(n, "_fp")
        two, one = runtime.stored(two, "two"), runtime.stored(one, "one")
        hubs = one.mapInArrow(_ball(1), "_fp long, z long").groupBy("z").agg(F.min("_fp").alias("y"))
        stars_ = two.mapInArrow(_ball(2), "_fp long, z long").join(hubs, "z").select(F.col("_fp").alias("x"), "y")
        rays = one.mapInArrow(_ball(1), "_fp long, z long").join(hubs, "z").select(F.col("_fp").alias("x"), "y")
        found = found.union(stars_.union(rays).where("x <> y").select(F.greatest("x", "y"), F.least("x", "y")).distinct())
    return found


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_cap: int = BUCKET_CAP) -> DataFrame:
    """(id, fingerprint, component_id, n_linked): one row for each row of ``docs``.

    component_id is the smallest id reachable over links, the row's own included; n_linked counts the distinct
    fingerprints in the class (1: none but its own).  Null and empty texts have fingerprint zero and are linked like
    any other.  A null id stays null in its row and never names a class, unless a class has only null ids; repeated
    rows are all returned.  Other columns of ``docs``, whatever their names, are ignored.  Empty input: no rows.
    """
    spark = docs.sparkSession
    runtime.tune(spark)
    base = docs.select(F.col(id_col).cast("long").alias("_id"), runtime.text_key(id_col, text_col)[1])
    fp = runtime.stored(base.mapInArrow(_fingerprints, "_id long, _fp long"), "fingerprints")
    prints = runtime.stored(fp.groupBy("_fp").agg(F.min("_id").alias("least"), F.count("*").alias("rows")), "prints")
    roots = components(links(prints.select("_fp"), bucket_cap), "x", "y")
    member = prints.join(roots, prints._fp == roots.node, "left").select("_fp", "least", "rows", F.coalesce("root", "_fp").alias("root"))
    member = runtime.stored(member, "members")
    named = member.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n_linked"))
    label = runtime.lookup(member, named.withColumn("_n", F.col("n_linked")), "root", "_n", member.count()).select("_fp", "component_id", "n_linked", "rows")
    return runtime.lookup(fp, label, "_fp", "rows", fp.count()).select(
        F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id", "n_linked"
    )
