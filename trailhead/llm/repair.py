"""Conversation structure repair: the cheapest edits that give a conversation the form ``(s?(ua)+)?``.

Rows are kept (0), given the other role (2), deleted (3; the only choice for blank and repeated ones), and empty turns are
inserted (2); a truncated row that stays costs 1 more.  Cost-to-go is computed backward over (row, grammar state); a forward
walk then takes, among the edits on which the cost is tight, the one whose letter is least in ASCII (D, I, K, R).

A conversation of any length is spread over many tasks: rows without their texts are range-sorted; a partition tells for its
first conversation what each of the four states at its end would cost at its start (a 4 x 4 table); the driver
composes these (one a partition) and gives each partition the costs behind its end and the state before its start.  Only
the digest of a conversation's text is a chain by nature: its rows stream in order through one task, of bounded memory.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import session
from . import runtime

RELABEL, DELETE, INSERT, CUT = 2, 3, 2, 1
#: Grammar states: nothing yet, after s, after u, after a.  An insert or relabel gives the role that a state expects.
START, S, U, A = range(4)
_NEXT = np.array([U, U, A, U])
ROLE = ("user", "user", "assistant", "user")
_INF = np.int64(1) << 50
_END = np.array([0, 2 * INSERT, INSERT, 0], np.int64)
#: Role initials: their codes, and the state after keeping such a row in each state (-1: not allowed).
_CODE = {"s": 0, "u": 1, "a": 2}
_KEEP = np.array([[S, -1, -1, -1], [U, U, -1, U], [-1, -1, A, -1], [-1, -1, -1, -1]])
_D, _I, _K, _R = b"DIKR"
_SPACE = " \t\n\x0b\x0c\r"


def damage(rows: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(_c, _t, role, text, gone) of damaged rows, by the hash of ``key:order`` modulo 20; a null is one space.

    0 drops the row (it stays with ``gone``, so that its conversation is known), 1 empties its text, 2 takes ``.!?`` out of
    it, 3 repeats it, 4 makes it the user's.
    """
    said = lambda c: F.make_valid_utf8(F.coalesce(F.col(c).cast("string"), F.lit(" ")))
    at = F.concat(F.coalesce(F.col(key).cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col(order).cast("string"), F.lit(" ")))
    kind = F.crc32(at.cast("binary")) % 20
    told = rows.select(F.col(key).alias("_c"), F.col(order).alias("_t"), said(role).alias("role"), said(text).alias("text"), kind.alias("_k"))
    return told.select(
        "_c", "_t",
        F.when(F.col("_k") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("_k") == 1, F.lit("")).when(F.col("_k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("_k") == 0).alias("gone"),
        F.explode(F.when(F.col("_k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_again"),
    ).drop("_again")


def _hashed(rows: DataFrame) -> DataFrame:
    """Rows with what sorts them: equal turns are in the order of role, first 64 characters of the text, and its hashes."""
    return rows.withColumns({"_h1": F.xxhash64("text"), "_h2": F.xxhash64(F.lit(11), "text"), "_pre": F.substring("text", 1, 64)})


_ORDER = ["_c", "_t", "role", "_pre", "_h1", "_h2"]


def faults(rows: DataFrame) -> DataFrame:
    """A row for each different (conversation, turn, role, text): ``m`` repeats, its initial's code, and its faults.

    ``fresh``: the first of the repeats is the first row of its role and text in the conversation; the others are duplicates.
    """
    last = F.right(F.rtrim("text", F.lit(_SPACE)), F.lit(1))
    blank = F.length(F.rtrim("text", F.lit(_SPACE))) == 0
    initial = F.coalesce(*(F.when(F.left("role", F.lit(1)) == k, F.lit(v)) for k, v in _CODE.items()), F.lit(3))
    found = _hashed(rows.where("NOT gone")).select(*_ORDER, initial.alias("code"), blank.alias("blank"), (~last.isin(*".!?") & ~blank).alias("cut"))
    slim = runtime.stored(found.groupBy(*_ORDER, "code", "blank", "cut").agg(F.count("*").alias("m")), "turns")
    # the first place of a role and text: its least turn (nulls first).  A key of many turns is combined in the map tasks, and
    # the answer joins by the whole key, so no task gets a common text's rows
    first = slim.groupBy("_c", "role", "_pre", "_h1", "_h2").agg(F.min(F.struct(F.col("_t").isNotNull(), "_t")).alias("f")).select("_c", "role", "_pre", "_h1", "_h2", F.col("f._t").alias("_t"), F.lit(True).alias("fresh"))
    same = " AND ".join(f"a.{c} <=> b.{c}" for c in _ORDER)
    return slim.alias("a").join(first.alias("b"), F.expr(same), "left").select("a.*", F.coalesce("b.fresh", F.lit(False)).alias("fresh"))


def _codes(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(conversation's number, whether the row can stay, initial, cut) of a partition's rows.

    Repeats behind a row are always deleted, and that is what the letters' order wants first; they add a fixed cost, so the
    choice of the others does not see them.
    """
    names = table.column("_c").combine_chunks()
    raw = names.cast(pa.string()).fill_null("")
    new = np.ones(len(raw), bool)
    if len(raw) > 1:
        null = names.is_null().to_numpy(zero_copy_only=False)
        new[1:] = ~pc.equal(raw[1:], raw[:-1]).to_numpy(zero_copy_only=False) | (null[1:] != null[:-1])
    flag = lambda c: table.column(c).combine_chunks().to_numpy(zero_copy_only=False).astype(bool)
    return np.cumsum(new) - 1, flag("fresh") & ~flag("blank"), table.column("code").to_numpy(), flag("cut")


def _inserted(v: np.ndarray) -> np.ndarray:
    """Costs with inserts before the next row, from those without; three in a row lead through all states."""
    best = v.copy()
    for _ in range(3):
        best = np.minimum(best, INSERT + best[..., _NEXT])
    return best


def _step(after: np.ndarray, stays: np.ndarray, code: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Cost-to-go before a row of each conversation (n x 4) from that behind it."""
    keep = _KEEP[code]
    kept = np.where(keep >= 0, np.take_along_axis(after, np.maximum(keep, 0), 1), _INF)
    stay = np.minimum(kept, RELABEL + after[:, _NEXT]) + CUT * cut[:, None]
    return _inserted(np.minimum(DELETE + after, np.where(stays[:, None], stay, _INF)))


def _spans(conv: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.diff(conv, prepend=-1))
    return starts, np.diff(np.append(starts, len(conv)))


def costs(conv, stays, code, cut, ends: np.ndarray) -> np.ndarray:
    """Cost-to-go before each row (rows x 4); ``ends`` is that behind each conversation.  All conversations at once."""
    starts, lens = _spans(conv)
    out = np.empty((len(conv), 4), np.int64)
    now = ends.copy()
    order = np.argsort(-lens, kind="stable")
    for t in range(int(lens.max()) if len(lens) else 0):
        at = order[: np.searchsorted(-lens[order], -t, "left")]  # conversations of more than t rows, from behind
        row = starts[at] + lens[at] - 1 - t
        now[at] = _step(now[at], stays[row], code[row], cut[row])
        out[row] = now[at]
    return out


def table_of(stays, code, cut) -> np.ndarray:
    """4 x 4: the cost of a run of rows from the state before it (row) to the state behind it (column), inserts included."""
    if not len(stays):
        return np.where(np.eye(4, dtype=bool), 0, _INF)
    out = np.full((4, 4), _INF)
    for end in range(4):
        behind = np.full((1, 4), _INF)
        behind[0, end] = 0
        out[:, end] = costs(np.zeros(len(stays), np.int64), stays, code, cut, behind)[0]
    return out


def walk(conv, stays, code, cut, before: np.ndarray, behind: np.ndarray, state: np.ndarray, final: np.ndarray):
    """(letters of each row, state behind each conversation, letters at its end): the tight edit with the least letter.

    before: cost-to-go before each row; behind: that behind each conversation; state: where each one starts; final: whether
    it ends here.
    """
    starts, lens = _spans(conv)
    letters = np.empty(len(conv), object)
    tail = np.full(len(starts), b"", object)
    state = state.copy()
    order = np.argsort(-lens, kind="stable")
    for t in range(int(lens.max()) if len(lens) else 0):
        at = order[: np.searchsorted(-lens[order], -t, "left")]
        row = starts[at] + t
        ahead = np.where((t + 1 < lens[at])[:, None], before[np.minimum(row + 1, len(conv) - 1)], behind[at])
        letters[row] = b""
        left = np.arange(len(at))
        while len(left):
            r, st = row[left], state[at[left]]
            goal, rows = before[r, st], np.arange(len(left))
            a = ahead[left]
            keep = _KEEP[code[r], st]
            delete = DELETE + a[rows, st] == goal
            insert = INSERT + before[r, _NEXT[st]] == goal
            stay = stays[r] & (keep >= 0) & (a[rows, np.maximum(keep, 0)] + CUT * cut[r] == goal)
            mark = np.where(delete, _D, np.where(insert, _I, np.where(stay, _K, _R)))
            state[at[left]] = np.where(delete, st, np.where(mark == _K, keep, _NEXT[st]))
            for i, x in zip(r.tolist(), mark.tolist()):
                letters[i] += bytes((x,))
            left = left[mark == _I]
    for c in np.flatnonzero(final):
        while state[c] in (S, U):  # the form must be complete
            state[c] = _NEXT[state[c]]
            tail[c] += b"I"
    return letters, state, tail


def _partition(batches) -> pa.Table | None:
    got = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(got) if got else None


def _named(value) -> str | None:
    return None if value is None else str(value)


def _edits(flagged: DataFrame) -> DataFrame:
    """``faults`` rows with ``edits``: inserts before the row, its own letter, and inserts at the conversation's end.  The
    ``m`` - 1 repeats behind a row are deletes, without letters here."""
    spark = flagged.sparkSession
    rows = flagged.repartitionByRange(runtime.partitions(spark), *_ORDER).sortWithinPartitions(*_ORDER).withColumn("_p", F.spark_partition_id())
    rows = session.checkpointed(rows)  # partitions and their order stay as they are from here on

    def summary(batches):
        t = _partition(batches)
        if t is not None:
            conv, *codes = _codes(t)
            table = table_of(*(c[conv == 0] for c in codes)).reshape(-1).tolist()
            ends = [t.column("_c")[0].as_py(), t.column("_c")[-1].as_py()]
            yield pa.RecordBatch.from_arrays([pa.array([t.column("_p")[0].as_py()], pa.int32()), *(pa.array([_named(e)], pa.string()) for e in ends), pa.array([table], pa.list_(pa.int64())), pa.array([bool(conv[-1] == 0)])], ["p", "first", "last", "costs", "one"])

    told = rows.mapInArrow(summary, "p int, first string, last string, costs array<long>, one boolean").collect()  # a row a partition
    told = sorted(told, key=lambda r: r["p"])
    square = lambda x: np.array(x, np.int64).reshape(4, 4)
    onward = [i + 1 < len(told) and told[i]["last"] == told[i + 1]["first"] for i in range(len(told))]
    behind = {}
    for i in range(len(told) - 1, -1, -1):  # cost-to-go behind the last conversation of each partition
        if not onward[i]:
            behind[i] = _END
        else:
            nxt = told[i + 1]
            rest = behind[i + 1] if nxt["one"] else _END
            behind[i] = np.minimum((square(nxt["costs"]) + rest[None]).min(1), _INF)
    plans = {r["p"]: behind[i].tolist() for i, r in enumerate(told)}
    sent = spark.sparkContext.broadcast(plans)

    def ending(batches):
        """The state behind the last conversation for each state before it: four walks."""
        t = _partition(batches)
        if t is not None:
            p = t.column("_p")[0].as_py()
            conv, *codes = _codes(t)
            mask = conv == conv[-1]
            sub = [np.zeros(int(mask.sum()), np.int64), *(c[mask] for c in codes)]
            goal = np.array([sent.value[p]], np.int64)
            before = costs(*sub, goal)
            ends = [int(walk(*sub, before, goal, np.array([st]), np.array([False]))[1][0]) for st in range(4)]
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([ends], pa.list_(pa.int64()))], ["p", "ends"])

    moved = {r["p"]: r["ends"] for r in rows.mapInArrow(ending, "p int, ends array<long>").collect()} if any(onward) else {}  # a row a partition
    known, at = {}, START
    for i, r in enumerate(told):
        begin = at if i and onward[i - 1] else START
        known[r["p"]] = (begin, plans[r["p"]], not onward[i])
        if onward[i]:
            at = moved[r["p"]][begin if r["one"] else START]
    given = spark.sparkContext.broadcast(known)

    def edits(batches):
        t = _partition(batches)
        if t is None:
            return
        begin, goal, final = given.value[t.column("_p")[0].as_py()]
        conv, *codes = _codes(t)
        n = int(conv[-1]) + 1
        behind = np.tile(_END, (n, 1))
        behind[-1] = goal
        state = np.full(n, START)
        state[0] = begin
        ends = np.ones(n, bool)
        ends[-1] = final
        before = costs(conv, *codes, behind)
        letters, _, tail = walk(conv, *codes, before, behind, state, ends)
        starts, lens = _spans(conv)
        letters[starts + lens - 1] += tail
        out = [x.decode() for x in letters]
        kept = [c for c in t.column_names if c != "_p"]
        yield from pa.table([*(t.column(c) for c in kept), pa.array(out, pa.string())], names=[*kept, "edits"]).to_batches(max_chunksize=4096)

    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "_p")
    return rows.mapInArrow(edits, f"{kind}, edits string")


def _texts(rows: DataFrame) -> DataFrame:
    """``rows`` without those that repeat one of the task's last many rows: only a first one's text can stay."""
    names = rows.columns

    def f(batches):
        seen = {}
        for b in batches:
            keys = list(zip(*(b.column(c).to_pylist() for c in ("_c", "_t", "role", "_h1", "_h2"))))
            new = np.zeros(len(keys), bool)
            for i, k in enumerate(keys):
                new[i] = k not in seen
                seen[k] = None
            while len(seen) > 1 << 14:
                seen.pop(next(iter(seen)))
            yield b.filter(pa.array(new))

    return rows.select(*names).mapInArrow(f, rows.schema)


class _Told:
    """One conversation as its rows stream by: counts, letters, and the digest of what is left."""

    def __init__(self):
        self.hash, self.some = hashlib.sha256(), False
        self.blank = self.duplicate = self.truncated = self.illegal = self.cost = 0
        self.low = self.high = self.turn = None
        self.turns, self.before, self.state = 0, None, START
        self.audit, self.waiting = [], None

    def say(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.some else "") + role + ":").encode() + text.encode())
        self.some = True

    def insert(self, n: int) -> None:
        for _ in range(n):
            self.say(ROLE[self.state], "")
            self.state = int(_NEXT[self.state])

    def row(self, turn, role, code, blank, cut, m, fresh, edits) -> None:
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.turn
            self.high = self.turn = turn
        self.blank += m if blank else 0
        self.duplicate += 0 if blank else m - fresh
        self.truncated += bool(fresh and cut and not blank)
        self.illegal += (self.before is not None and (self.before, code) not in ((0, 1), (1, 2), (2, 1))) + m - 1
        self.before = code
        own = edits.lstrip("I")
        self.audit += [edits[: len(edits) - len(own)], own[0], "D" * (m - 1), own[1:]]
        self.cost += INSERT * edits.count("I") + DELETE * (m - 1 + (own[0] == "D")) + RELABEL * (own[0] == "R") + CUT * (own[0] != "D" and cut)
        self.insert(len(edits) - len(own))
        if own[0] == "D":
            self.insert(len(own) - 1)
            return
        self.waiting = (role if own[0] == "K" else ROLE[self.state], len(own) - 1)
        self.state = int(_KEEP[code, self.state] if own[0] == "K" else _NEXT[self.state])

    def text(self, text: str) -> None:
        if self.waiting:
            (role, more), self.waiting = self.waiting, None
            self.say(role, text)
            self.insert(more)

    def result(self) -> list:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return [gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest()]


_RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repair(rows: DataFrame, key: str = "conv_id") -> DataFrame:
    """A row for each conversation of ``rows`` (_c, _t, role, text, gone, as ``damage`` makes them): its faults, the cost, the
    letters of the cheapest edits, and the digest of the repaired ``role:text`` lines.

    Nulls come first among turns; equal turns are in the order of role and text.  A role's first character is its initial; one
    that is not s, u or a (an empty role too) can only be relabelled or deleted.  Rows that are ``gone`` count for nothing,
    but their conversation has a row.  A null key is a conversation.  Empty table: no rows.
    """
    spark = rows.sparkSession
    runtime.tune(spark)
    edited = runtime.stored(_edits(faults(rows)), "edits")
    mine = [c for c in edited.columns if c not in _ORDER]
    none = lambda *names: [F.lit(None).cast(edited.schema[c].dataType).alias(c) for c in names]
    text = F.lit(None).cast("string").alias("text")
    told = _texts(_hashed(rows.where("NOT gone")).select(*_ORDER, "text"))
    every = rows.select("_c").distinct().select("_c", *none(*_ORDER[1:]), F.lit(0).alias("kind"), text, *none(*mine))
    both = edited.select(*_ORDER, F.lit(1).alias("kind"), text, *mine).unionByName(told.select(*_ORDER, F.lit(2).alias("kind"), "text", *none(*mine))).unionByName(every)
    # one task reads a conversation in order: the digest is a chain over its text
    sorted_ = both.repartition(runtime.partitions(spark), "_c").sortWithinPartitions(*_ORDER, "kind")
    kind = rows.schema["_c"].dataType

    def f(batches):
        here, told, started = None, None, False
        for b in batches:
            out = []
            columns = [b.column(c).to_pylist() for c in ("_c", "kind", "_t", "role", "text", "code", "blank", "cut", "m", "fresh", "edits")]
            for c, what, turn, role, text, *rest in zip(*columns):
                if not started or c != here:
                    if started:
                        out.append([here, *told.result()])
                    here, told, started = c, _Told(), True
                if what == 1:
                    told.row(turn, role, *rest)
                elif what == 2:
                    told.text(text)
            if out:
                yield _batch(out)
        if started:
            yield _batch([[here, *told.result()]])

    def _batch(out):
        return pa.RecordBatch.from_arrays([pa.array(c) if i else pa.array(c, arrow_kind) for i, c in enumerate(zip(*out))], [key, *(x.split()[0] for x in _RESULT.split(", "))])

    from pyspark.sql.pandas.types import to_arrow_type

    arrow_kind = to_arrow_type(kind)
    return sorted_.mapInArrow(f, f"`{key}` {kind.simpleString()}, {_RESULT}")
