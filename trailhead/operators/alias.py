"""Renames: an old id leads to its present root."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import session


def fold_py(rows: list[tuple[str, str, str]], table: dict | None = None) -> dict[str, tuple[str, str, str]]:
    """The ordered fold: a row (old, new, commit) takes new's root of that moment, then every row whose root is old
    follows to it.  old -> (new, root, commit)."""
    table = dict(table or {})
    led: dict[str, set] = {}
    for old, (_, root, _) in table.items():
        led.setdefault(root, set()).add(old)
    for old, new, commit in rows:
        root = table[new][1] if new in table else new
        if old in table:
            led.get(table[old][1], set()).discard(old)
        table[old] = (new, root, commit)
        led.setdefault(root, set()).add(old)
        if old != root:
            for x in led.pop(old, ()):
                table[x] = (table[x][0], root, table[x][2])
                led[root].add(x)
    return table


def fold(events: DataFrame, group: str = "component") -> DataFrame:
    """Exact fold of events (component, seq, old_id, new_id, commit_hash): rows (component, old_id, new_id, root_id, commit_hash).

    Order matters within a component only; components are independent groups.
    """
    session.ship(events.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        got = fold_py(list(zip(pdf["old_id"], pdf["new_id"], pdf["commit_hash"])))
        return pd.DataFrame([(pdf[group].iloc[0], o, n, r, c) for o, (n, r, c) in got.items()], columns=[group, "old_id", "new_id", "root_id", "commit_hash"])

    kind = events.schema[group].dataType.simpleString()
    return events.groupBy(group).applyInPandas(run, f"{group} {kind}, old_id string, new_id string, root_id string, commit_hash string")


def closure(pairs: DataFrame) -> DataFrame:
    """(old_id, root_id) where each old id is renamed once and no rename runs in a circle: pointer doubling.

    The number of joins is the logarithm of the longest chain.
    """
    now = session.checkpointed(pairs.select("old_id", F.col("new_id").alias("root_id")))
    while True:
        ahead = now.select(F.col("old_id").alias("_o"), F.col("root_id").alias("_r"))
        joined = now.join(ahead, F.col("root_id") == F.col("_o"), "left")
        moved = session.checkpointed(joined.select("old_id", F.coalesce("_r", "root_id").alias("root_id"), F.col("_r").isNotNull().alias("_moved")))
        now = moved.select("old_id", "root_id")
        if moved.where("_moved").isEmpty():
            return now


def resolve(ids: DataFrame, alias: DataFrame, col: str = "id") -> DataFrame:
    """``ids`` with ``root``: one lookup, the id itself where it has no alias."""
    a = alias.select(F.col("old_id").alias("_old"), F.col("root_id").alias("_root"))
    return ids.join(a, F.col(col) == F.col("_old"), "left").withColumn("root", F.coalesce("_root", col)).drop("_old", "_root")


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of an undirected edge table (a, b): the smallest id reachable, by rounds of minimum labels with
    pointer jumping.  A round is one written table and one look at it."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = session.checkpointed(both)
    label = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).select(F.col("a").alias("id"), "label")
    label = session.checkpointed(label)
    while True:
        seen = both.join(label, both.b == label.id).groupBy("a").agg(F.min("label").alias("near"))
        low = label.join(seen, label.id == seen.a, "left").select("id", "label", F.least("label", F.coalesce("near", "label")).alias("low"))
        jump = label.select(F.col("id").alias("_i"), F.col("label").alias("_l"))
        moved = session.checkpointed(low.join(jump, low.low == jump._i, "left").select("id", "label", F.least("low", F.coalesce("_l", "low")).alias("next")))
        label = moved.select("id", F.col("next").alias("label"))
        if moved.where("next <> label").isEmpty():
            return label.select("id", F.col("label").alias("component"))


#: Up to so many rows of a batch are folded in one task, without a search for components.
ONE_TASK = 1 << 17
#: Events up to this many are folded as they are; places where an id is read, up to which its events are sorted between them.
FEW, READS = 1 << 10, 1 << 10
#: Ids (with where they are read) up to this many are sent to the events.
SENT = 10_000


def settled(alias: DataFrame, ev: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, moves, events): what needs no order among different ids, and the events that do.

    A leaf is an id that nothing renames, in the table or the events: who is renamed to it has it as root for good.  Where
    every event of an id leads to leaves, its first event takes its followers along and the later ones change only its own
    row.  If no event reads the id (is a rename to it), its row is its last event's, and its followers go where its first
    event leads: ``rows`` (as the table's) and ``moves`` (_from, _to).  If some do, of its events between two reads the last
    one counts; the others, but for the very first, are left out.  So an id that is renamed again and again, as the
    fingerprint of a shape that a million files have, is a few events.
    """
    old = ev.select(F.col("old_id").alias("id")).distinct()
    taken = old.union(alias.join(ev.select(F.col("new_id").alias("id")).distinct(), F.col("old_id") == F.col("id"), "left_semi").select("old_id")).distinct()
    bound = ev.join(taken, F.col("new_id") == F.col("id"), "left_semi").select(F.col("old_id").alias("id"))
    bound = bound.union(alias.where("old_id = root_id").select("old_id")).distinct().withColumn("_bound", F.lit(True))
    reads = ev.join(old, F.col("new_id") == F.col("id"), "left_semi").groupBy(F.col("new_id").alias("id")).agg(F.count_distinct("seq").alias("_reads"))
    marks = session.checkpointed(old.join(bound, "id", "left").join(reads, "id", "left").withColumnRenamed("id", "old_id"))
    free = marks.where("_bound IS NULL")
    rest = marks.where("_bound OR _reads IS NOT NULL").select("old_id")
    small = lambda df: F.broadcast(df) if df.count() <= SENT else df
    rest = small(rest)  # the others are one by one; of these each may have most of the events, which no task should sort
    event = F.struct("seq", "new_id", "commit_hash")
    ends = ev.join(rest, "old_id", "left_anti").groupBy("old_id").agg(F.max(event).alias("last"), F.min(event).alias("first"))
    ends = session.checkpointed(ends)
    rows = ends.select("old_id", F.col("last.new_id").alias("new_id"), F.col("last.new_id").alias("root_id"), F.col("last.commit_hash").alias("commit_hash"))
    moves = ends.select(F.col("old_id").alias("_from"), F.col("first.new_id").alias("_to"))
    left = ev.join(rest, "old_id", "left_semi")
    some = free.where(F.col("_reads") <= READS).select("old_id")
    at = ev.join(some, F.col("new_id") == some["old_id"], "left_semi").groupBy(F.col("new_id").alias("old_id")).agg(F.collect_set("seq").alias("_at"))
    held = left.join(small(session.checkpointed(at)), "old_id", "left")
    # between reads: their number; at a read: each event by itself
    place = F.size(F.filter("_at", lambda x: x < F.col("seq")))
    alike = held.where("_at IS NOT NULL").withColumn("_same", F.when(F.array_contains("_at", F.col("seq")), F.col("new_id")))
    last = alike.groupBy("old_id", place.alias("_place"), "_same").agg(F.max(event).alias("e")).select("old_id", "e")
    first = alike.groupBy("old_id").agg(F.min(event).alias("e"))
    kept = last.union(first).distinct().select("e.seq", "old_id", "e.new_id", "e.commit_hash")
    return rows, moves, held.where("_at IS NULL").select(*kept.columns).unionByName(kept)


def increment(alias: DataFrame, events: DataFrame) -> DataFrame:
    """The rows of the alias table that ordered events (seq, old_id, new_id, commit_hash) change, as they are afterwards.

    Only rows whose own id or whose root an event names can change, which two semi joins find.  A row of which only the root
    is named never acts: it goes where its root goes.  So the fold is over the events and the rows of their ids, and all
    others that change take one join with the roots that moved.  Events of equal ``seq`` are in the order of their ids.
    """
    session.ship(alias.sparkSession)
    ev = session.checkpointed(events.select("seq", "old_id", "new_id", "commit_hash"))
    n = ev.count()
    if not n:
        return alias.limit(0)
    settle = moves = None
    if n > FEW:
        settle, moves, ev = settled(alias, ev)
        ev = session.checkpointed(ev)
        n = ev.count()
    ids = session.checkpointed(ev.select(F.col("old_id").alias("id")).union(ev.select("new_id")).distinct())
    near = alias.join(ids, alias.old_id == ids.id, "left_semi").select("old_id", "new_id", "root_id", "commit_hash")
    if settle is not None:  # a settled root's followers are where they go, whenever that was
        near = near.join(moves, F.col("root_id") == F.col("_from"), "left").withColumn("_was", F.col("root_id")).withColumn("root_id", F.coalesce("_to", "root_id")).drop("_from", "_to")
        near = session.checkpointed(near)
        before, near = near.where("root_id <> _was").drop("_was"), near.drop("_was")
    # a root that is named stands for its followers: a row of its own, that takes no part but for its root
    follower = ids.select(F.concat(F.lit(FOLLOW), "id").alias("old_id"), F.col("id").alias("new_id"), F.col("id").alias("root_id"), F.lit("").alias("commit_hash"))
    known = near.unionByName(follower).withColumn("seq", F.lit(-1).cast("long"))
    rows = known.unionByName(ev.withColumn("root_id", F.lit(None).cast("string")).select(*known.columns))
    if n <= ONE_TASK:
        placed = rows.withColumn("component", F.lit(""))
    else:
        met = session.checkpointed(near.select(F.col("old_id").alias("a"), F.col("root_id").alias("b")))
        comp = components(ev.select(F.col("old_id").alias("a"), F.col("new_id").alias("b")).union(met).where("a <> b"))
        key = F.when(F.startswith("old_id", F.lit(FOLLOW)), F.col("new_id")).otherwise(F.col("old_id"))
        placed = rows.withColumn("_id", key).join(comp.withColumnRenamed("id", "_id"), "_id", "left").withColumn("component", F.coalesce("component", "_id")).drop("_id")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        old = pdf[pdf["seq"] < 0]
        new = pdf[pdf["seq"] >= 0].sort_values(["seq", "old_id", "new_id"])
        table = {o: (n, r, c) for o, n, r, c in zip(old["old_id"], old["new_id"], old["root_id"], old["commit_hash"])}
        got = fold_py(list(zip(new["old_id"], new["new_id"], new["commit_hash"])), table)
        return pd.DataFrame([(o, n, r, c) for o, (n, r, c) in got.items() if table.get(o) != (n, r, c)], columns=["old_id", "new_id", "root_id", "commit_hash"])

    folded = session.checkpointed(placed.groupBy("component").applyInPandas(run, "old_id string, new_id string, root_id string, commit_hash string"))
    led = F.startswith("old_id", F.lit(FOLLOW))
    moved = folded.where(led).select(F.col("new_id").alias("_from"), F.col("root_id").alias("_to"))
    gone = ids if settle is None else ids.union(settle.select("old_id"))
    moved = moved if settle is None else moved.unionByName(moves)
    passive = alias.join(moved, alias.root_id == moved._from).join(gone, alias.old_id == gone.id, "left_anti")
    passive = passive.select("old_id", "new_id", F.col("_to").alias("root_id"), "commit_hash")
    out = folded.where(~led).unionByName(passive)
    if settle is None:
        return out
    same = [settle[c] == alias[c] for c in ("old_id", "new_id", "root_id", "commit_hash")]
    out = session.checkpointed(out)
    return out.unionByName(before.join(out.select("old_id"), "old_id", "left_anti")).unionByName(settle.join(alias, same, "left_anti"))


#: Before an id: the followers of that root.  Ids hold no control characters.
FOLLOW = "\x00"


def record(alias: DataFrame, events: DataFrame) -> DataFrame:
    """The whole alias table after ordered events (seq, old_id, new_id, commit_hash), exact; see ``increment``."""
    moved = session.checkpointed(increment(alias, events))
    return alias.join(moved.select(F.col("old_id").alias("_o")), F.col("old_id") == F.col("_o"), "left_anti").unionByName(moved)
