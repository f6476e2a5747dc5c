"""Best-fit packing of documents into sequences by bin completion.

Only lengths matter to a packing, and there are fewer than the sequence length of them, so the search runs over the
histogram of piece lengths, whatever the number of documents: the longest length left is completed with undominated
fillings, each applied as often as the counts allow or, in a later branch, once; branches are pruned by the waste that a
better solution may still have; best-fit decreasing gives the first incumbent. The search may end at its number of nodes
or leave fillings out; complete() says how many nodes it took, the lower bound, and if the result is proven best. The plan,
a bounded table of rank ranges, is then joined to pieces by their rank among those of their length. Tasks that cut pieces
number those of each length as they make them, and prefix sums of their counts make these numbers ranks: pieces are neither
sorted nor shuffled for it.

Defined results
* null text counts as empty: one piece that holds the end token;
* ids longer than a sequence are cut into full pieces and a last shorter one; nothing else is cut;
* rows that repeat are packed as often as they occur, equal ones can stand for each other; an empty table gives no piece;
* null ids are ids like any other;
* columns other than the id and the text aren't carried along.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import packed, stored, text_of
from .encoding import encoder, with_end

CAPACITY = 2048
END_ID = 0
#: Branches of the search that are looked at, and fillings that one branch tries.
MAX_NODES = 20_000
MAX_FILLINGS = 8
#: Ids in one Arrow batch of pieces.
IDS = 4_000_000

#: A plan, and the table of counts of tasks and lengths, are broadcast up to this many rows (some 50 bytes each).
PLAN_ROWS = 200_000

Pattern = tuple[tuple[int, int], ...]  # (length, how many), longest first


@dataclass(frozen=True)
class Packing:
    """Patterns and how often each is used; the fewest sequences there could be; nodes that the search took."""

    plan: list[tuple[Pattern, int]]
    least: int
    nodes: int
    searched: bool  # the whole tree was seen

    @property
    def sequences(self) -> int:
        return sum(n for _, n in self.plan)

    @property
    def best(self) -> bool:
        return self.searched or self.sequences == self.least


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id, piece, start, length and ids (little-endian unsigned 32-bit) of every piece, and its task and nth, its number among
    the task's pieces of its length; stored in the shared folder, which keeps these as they are."""
    t = packed(docs, _id=id_col, _text=text_of(text_col)).drop("_row")
    kind = t.schema["_id"].dataType
    schema = T.StructType([T.StructField("_id", kind), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("task", T.LongType()), T.StructField("nth", T.LongType())])

    def cut(batches):
        enc, task, seen = encoder(tokenizer), TaskContext.get().partitionId(), np.zeros(capacity + 1, "int64")
        for b in batches:
            ids, at = with_end(*enc.encode_column(b.column(1)), end_id)
            n = -(-np.diff(at) // capacity)
            doc, piece = np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            start = piece * capacity
            first = at[:-1][doc] + start
            length = np.minimum(capacity, at[1:][doc] - first)
            order, n = np.argsort(length, kind="stable"), np.bincount(length, minlength=capacity + 1)
            nth = np.empty(len(length), "int64")
            nth[order] = np.arange(len(length)) + np.repeat(seen - (np.cumsum(n) - n), n)
            seen += n
            for some in np.array_split(np.arange(len(doc)), -(-len(ids) // IDS) or 1):  # an Arrow batch has 32-bit offsets
                if len(some):
                    low, offsets = first[some[0]], np.append(first[some], first[some[-1]] + length[some[-1]])
                    data = ids[low : offsets[-1]].astype("<u4").tobytes()
                    cells = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(((offsets - low) * 4).astype("int32").tobytes()), pa.py_buffer(data)])
                    cols = [b.column(0).take(pa.array(doc[some])), pa.array(piece[some], pa.int32()), pa.array(start[some]), pa.array(length[some]), cells, pa.repeat(pa.scalar(task, pa.int64()), len(some)), pa.array(nth[some])]
                    yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return stored(t.mapInArrow(cut, schema), "pieces")


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing over a histogram: groups of equal bins are filled together."""
    left: dict[int, dict[Pattern, int]] = defaultdict(lambda: defaultdict(int))
    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            room = min((r for r, g in left.items() if r >= size and g), default=None)
            if room is None:
                per = min(capacity // size, n)
                many = n // per
                left[capacity - per * size][((size, per),)] += many
                n -= many * per
                continue
            kind, have = next(iter(left[room].items()))
            per = min(room // size, n)
            many = min(have, n // per)
            left[room][kind] -= many
            if not left[room][kind]:
                del left[room][kind]
            left[room - per * size][(*kind, (size, per))] += many
            n -= many * per
    return [(kind, many) for group in left.values() for kind, many in group.items()]


def fillings(counts: dict[int, int], room: int, most: int) -> tuple[list[Pattern], bool]:
    """Undominated fillings of room, fullest first, and if these are all. One is dominated if some of its items, together, could
    be replaced by a longer item that is there and fits."""
    sizes = [s for s in sorted(counts, reverse=True) if counts[s] and s <= room]
    if not sizes:
        return [()], True
    if sizes[0] == room:
        return [((room, 1),)], True
    there = 0
    for s in sizes:
        there |= 1 << s
    found: list[tuple[int, int, Pattern]] = []
    tries, all_seen = 40 * most, True

    def dominated(items: list[int], slack: int) -> bool:
        sums = {0: 0}
        for i in items:
            sums |= {s + i: c + 1 for s, c in sums.items()}
        return any(c and (there >> (s + (c == 1))) & ((1 << (slack + (c > 1))) - 1) for s, c in sums.items())

    def grow(items: list[int], left: int, at: int) -> None:
        nonlocal tries, all_seen
        tries -= 1
        fits = [k for k in range(at, len(sizes)) if sizes[k] <= left and items.count(sizes[k]) < counts[sizes[k]]]
        if not fits:
            if not any(s <= left and items.count(s) < counts[s] for s in sizes) and not (len(items) <= 8 and dominated(items, left)):
                found.append((left, len(items), tuple((s, items.count(s)) for s in dict.fromkeys(items))))
            return
        exact = there >> left & 1 and items.count(left) < counts[left]
        for k in [sizes.index(left)] if exact else fits:
            if tries <= 0 or sum(f[0] == 0 for f in found) >= most:
                all_seen = False
                return
            grow([*items, sizes[k]], left - sizes[k], k)

    grow([], room, 0)
    if not found:  # the tries ran out: fill greedily
        items, left = [], room
        for s in sizes:
            k = min(counts[s], left // s)
            items += [(s, k)] * bool(k)
            left -= k * s
        found.append((left, len(items), tuple(items)))
    return [f[2] for f in sorted(found)[:most]], all_seen and len(found) <= most


def fewest(counts: dict[int, int], capacity: int) -> int:
    """The L2 bound of Martello and Toth on the number of bins. Items over half a bin need one each; for every size up to half, the
    items from that size to half a bin need more as far as the room beside those that leave so much is too little for them."""
    size, half = np.arange(capacity + 1), capacity // 2
    n = np.array([counts.get(int(s), 0) for s in size], "int64")
    load, room = np.cumsum(n * size), np.cumsum(np.where(size > half, n * (capacity - size), 0))
    low = size[: half + 1]
    small = load[half] - load[low] + (n * size)[low]
    return int(n[half + 1 :].sum() + max(0, (-(-(small - room[capacity - low]) // capacity)).max()))


def complete(counts: dict[int, int], capacity: int = CAPACITY, max_nodes: int = MAX_NODES) -> Packing:
    """Bin completion over a histogram of lengths, in as few bins as are found."""
    counts = {s: n for s, n in counts.items() if n}
    best = best_fit(counts, capacity)
    total, bins = sum(s * n for s, n in counts.items()), sum(n for _, n in best)
    least = fewest(counts, capacity)
    nodes, whole = 0, True
    # One histogram for the whole search: a step takes its items off and puts them back when it's undone.
    left, done, used, waste = dict(counts), [], 0, 0
    open_: list[Iterator[tuple[Pattern, int]]] = []  # the steps still to be tried at each depth

    def steps() -> list[tuple[Pattern, int]]:
        """Patterns with the longest length left, each as often as it fits, then each once."""
        nonlocal whole
        size = max(left)
        ways, every = fillings(left | {size: left[size] - 1}, capacity - size, MAX_FILLINGS)
        whole = whole and every
        often = []
        for fill in ways:
            one = defaultdict(int, {size: 1})
            for s, k in fill:
                one[s] += k
            often.append((tuple(sorted(one.items(), reverse=True)), min(left[s] // k for s, k in one.items())))
        return often + [(one, 1) for one, times in often if times > 1]

    def take(one: Pattern, times: int) -> None:
        for s, k in one:
            left[s] = left.get(s, 0) - k * times
            if not left[s]:
                del left[s]

    forward = bins > least
    while forward and bins > least:
        nodes += 1
        if waste <= (bins - 1) * capacity - total:  # else no better solution wastes as much
            if left:
                open_.append(iter(steps()))
            else:
                best, bins = list(done), used
        forward = False
        while open_ and not forward:
            if len(done) == len(open_):
                one, times = done.pop()
                take(one, -times)
                used, waste = used - times, waste - times * (capacity - sum(s * k for s, k in one))
            step = next(open_[-1], None)
            if step is None:
                open_.pop()
            elif nodes < max_nodes:
                one, times = step
                take(one, times)
                done.append(step)
                used, waste, forward = used + times, waste + times * (capacity - sum(s * k for s, k in one)), True
            else:
                whole, open_ = False, []
    return Packing(best, least, nodes, whole)


def rank_ranges(plan: list[tuple[Pattern, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, rank after the last, first sequence, pieces a sequence, offset of the first) for each slot."""
    used: dict[int, int] = defaultdict(int)
    rows, seq = [], 0
    for kind, times in plan:
        at = 0
        for size, k in kind:
            rows.append((size, used[size], used[size] + k * times, seq, k, at))
            used[size] += k * times
            at += k * size
        seq += times
    return rows


def packed_pieces(found: DataFrame, capacity: int = CAPACITY, max_nodes: int = MAX_NODES, plan_rows: int = PLAN_ROWS) -> DataFrame:
    """found, with length, task and nth at least, with sequence_id and offset in place of these two. The histogram, at most capacity
    rows, goes to the driver; so does nothing else."""
    spark = found.sparkSession
    sums = stored(found.groupBy("task", "length").agg(F.count("*").alias("_n")), "pack-counts")
    counts = {int(r["length"]): int(r["n"]) for r in sums.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    ranges = rank_ranges(complete(counts, capacity, max_nodes).plan)
    table = spark.createDataFrame(ranges, "length long, first long, after long, seq long, k long, at long")
    table = F.broadcast(table) if len(ranges) <= plan_rows else table
    upto = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # a row a task
    base = sums.select("task", "length", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_base"))
    base = F.broadcast(base) if sums.count() <= plan_rows else base
    ranked = found.join(base, ["task", "length"]).withColumn("_r", F.col("nth") + F.col("_base"))
    met = ranked.join(table, (ranked["length"] == table["length"]) & (F.col("_r") >= F.col("first")) & (F.col("_r") < F.col("after"))).drop(table["length"])
    within = F.col("_r") - F.col("first")
    met = met.withColumns({"sequence_id": F.col("seq") + F.floor(within / F.col("k")), "offset": F.col("at") + F.pmod(within, F.col("k")) * F.col("length")})
    return met.drop("task", "nth", "_r", "_base", "first", "after", "seq", "k", "at")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece with its ids, sequence_id and offset."""
    return packed_pieces(pieces(docs, tokenizer, capacity, end_id, id_col, text_col), capacity)


QUERY = "op6_best_fit_packing"
