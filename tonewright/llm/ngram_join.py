"""N-gram Jaccard join: documents whose shingle sets are similar enough, and the classes that links make.

Every shingle is a 64-bit hash of its words. The upper levels of the signature tree are made by a shuffle: sets are
dealt by size class and by the content of a part of the hash range, where a class has more parts than two similar sets
of its sizes can differ in, so similar sets agree in one part at least. What agrees anywhere is gathered into clusters,
and the lower levels are built over a cluster's sets in a task: nodes with OR-combined bitmaps and size ranges,
traversed in pairs that are dropped when the largest overlap they allow is too small, or when all their documents are
linked already. What is left is checked on the sets themselves, so the result is exact (up to 64-bit hash collisions).

Shingles of passages that many documents share would tie unlike documents together, so shingles in more than a share of
all documents are put in a part of their own that nothing is dealt by; classes have one part more for it. Sets that are
mostly such shingles are dealt by all of theirs as well. Which shingles count as frequent changes the work, never the result.

Equal sets are one node from the start. A cluster over MAX_BLOCK shingles or MAX_SETS sets is dealt anew: in a few rounds by the
least of its shingles' hashes, under another hash in each round, so that similar sets meet, and linked documents are replaced
by one of them; then, where more than one class is left, the pairs of blocks of compatible sizes are compared by bitmaps of the
sets, whose differing bits bound what the sets differ in, and what can link is taken in finer clusters. Where these are large
still, the pairs of their blocks are traversed, so no link is lost at any cluster size.

Defined results
* null text counts as empty; sets without a shingle link with nothing, each is a class of its own;
* a text with fewer words than a shingle has the whole sequence as its one shingle;
* rows that share an id are one node, a null id has a null class;
* an empty table gives an empty result; extra columns of any name pass through representatives() unchanged.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, recorded, release, stored, text_of, unpacked
from .graph import components

#: Shingles of the sets that one task holds, and sets that it compares: beyond either a cluster is dealt anew.
MAX_BLOCK = 4_000_000
MAX_SETS = 2_048
#: Hashes that large clusters are dealt by, one after another.
ROUNDS = 3
#: Keys that a map task sorts at a time.
CHUNK_KEYS = 1_000_000
#: Tables of ids are broadcast up to this many rows (16 to 24 bytes each).
BROADCAST_ROWS = 1_000_000
#: A shingle is frequent if it's in more than one of this many documents. There are at most as many frequent shingles as
#: this times the mean size of a set. The list is broadcast; should it have more than MAX_FREQUENT the share is halved until it
#: hasn't. Others are dealt by like rare ones, which costs time and no link.
FREQUENT_SHARE = 2_000
MAX_FREQUENT = 2_000_000
#: Shingles that a map task counts at a time.
CHUNK_SHINGLES = 4_000_000
#: Ratio of the bounds of a size class.
CLASS_RATIO = 1.35
FANOUT = 8

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """The finishing step of splitmix64, a bijection of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def shingles(text: str | None, n: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a text; A-Z count as a-z."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: ASCII only
    if not words:
        return np.empty(0, _U)
    if len(words) < n:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], _U)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), _U, len(words))
    with np.errstate(over="ignore"):
        total = np.zeros(len(words) - n + 1, _U)
        for k in range(n):
            total = _mix(total + h[k : len(h) - n + 1 + k] + _U(0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1))
    return np.unique(total)


@dataclass(frozen=True)
class Similarity:
    """Jaccard similarity of num / den at least, on shingles of n words."""

    n: int = 5
    num: int = 80
    den: int = 100

    def linked(self, overlap: int, a: int, b: int) -> bool:
        return self.den * overlap >= self.num * (a + b - overlap)

    def most(self, size: int) -> int:
        """The size of the largest set that can link with one of this size."""
        return size * self.den // self.num

    @functools.cached_property
    def bounds(self) -> list[int]:
        """First size of each class."""
        out = [1]
        while out[-1] < 1 << 40:
            out.append(max(out[-1] + 1, int(out[-1] * CLASS_RATIO)))
        return out

    @functools.cached_property
    def bins(self) -> np.ndarray:
        """First size of each of the wider classes, the last one beyond any size: the largest set that links with one of a class is
        in the class after it."""
        out = [1]
        while out[-1] < 1 << 40:
            out.append(max(self.most(out[-1]) + 1, out[-1] * 5 // 4))
        return np.array(out, "int64")

    @functools.lru_cache(maxsize=None)  # noqa: B019
    def parts(self, c: int) -> tuple[int, np.ndarray]:
        """Slack and inner bounds of the parts of the hash range for class c. Sets of the class that link agree in more
        than slack parts, so an agreement in parts without a shingle is needed only by sets with more such parts."""
        low, high = self.bounds[c], self.bounds[c + 1] - 1
        differ = 2 * high * (self.den - self.num) // (self.den + self.num)
        empty = (differ + 1) * math.exp(-low / (1.1 * (differ + 1)))
        slack = 2 + math.ceil(1.5 * empty + 2 * math.sqrt(empty))
        k = differ + 1 + slack
        return (slack, np.array([(j << 64) // k for j in range(1, k)], _U)) if differ else (0, np.empty(0, _U))


def _dealt(s: np.ndarray, inner: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Keys of the parts of a sorted set, which of them have a shingle, and how many have none."""
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, _U), np.cumsum(_mix(s + _U(0x632BE59BD9B4E019)), dtype=_U)])
        at = np.concatenate([[0], np.searchsorted(s, inner), [len(s)]])
        keys = _mix(sums[at[1:]] - sums[at[:-1]] + _mix(np.arange(len(inner) + 1, dtype=_U) + _U(salt)))
    have = at[1:] > at[:-1]
    return keys, have, len(have) - int(np.count_nonzero(have))


def keys_of(s: np.ndarray, sim: Similarity, frequent: np.ndarray | None = None) -> np.ndarray:
    """What a set is dealt by, given the sorted frequent shingles.

    Two sets that link differ in fewer parts than there are beyond the slack and the part of the frequent shingles, so they
    agree in more than slack parts of rare ones. If one of them has no more than slack such parts empty, one that they agree
    in isn't empty. If both have more, both are dealt by the parts of all their shingles too."""
    import bisect

    rare = s
    if frequent is not None and len(frequent):
        at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
        rare = s[frequent[at] != s]
    out = []
    c = bisect.bisect_right(sim.bounds, len(s)) - 1
    while sim.bounds[c] <= sim.most(len(s)):
        slack, inner = sim.parts(c)
        if len(inner):
            keys, have, empty = _dealt(rare, inner, (c << 32) + 1)
            out.append(keys[have])
            if empty > slack:
                keys, have, empty = _dealt(s, inner, (c << 32) + (1 << 31) + 1)
                out.append(keys if empty > slack else keys[have])
        c += 1
    return np.concatenate(out) if out else np.empty(0, _U)


def frequent_shingles(docs: DataFrame, sim: Similarity, id_col: str, text_col: str, share: int = FREQUENT_SHARE) -> np.ndarray:
    """Sorted shingles found in more than one of share documents, equal sets in a map task counted once. A map task passes on
    only what is that frequent among its own documents."""
    t = packed(docs, _text=text_of(text_col)).drop("_row")

    def run(batches):
        kept, seen, size = [], set(), 0

        def flush():
            u, n = np.unique(np.concatenate(kept), return_counts=True)
            often = n >= max(2, math.ceil(len(kept) / share))
            return pa.RecordBatch.from_arrays([pa.array(u[often].view("int64")), pa.array(n[often])], names=["g", "n"])

        for b in batches:
            for x in b.column(0):
                s = shingles(x.as_py(), sim.n)
                mark = hash(s[:64].tobytes())
                if len(s) and mark not in seen:
                    seen.add(mark)
                    kept.append(s)
                    size += len(s)
                if size >= CHUNK_SHINGLES:
                    yield flush()
                    kept, seen, size = [], set(), 0
        if kept:
            yield flush()

    counts = t.mapInArrow(run, "g long, n long").groupBy("g").agg(F.sum("n").alias("n"))
    least = max(10, docs.count() // share)
    often = stored(counts.filter(F.col("n") >= least), "frequent")
    while often.filter(F.col("n") >= least).count() > MAX_FREQUENT:
        least *= 2
    found = often.filter(F.col("n") >= least).select("g").toArrow()["g"].to_numpy()
    return np.sort(found.view("uint64")) if len(found) else np.empty(0, _U)


def described(docs: DataFrame, sim: Similarity, id_col: str, text_col: str) -> DataFrame:
    """_id, n, two halves of the set's hash, its keys, and the least hash of its shingles for each round, stored in the shared folder."""
    t = packed(docs, _id=F.col(f"`{id_col}`").cast("long"), _text=text_of(text_col)).drop("_row")
    sent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, sim, id_col, text_col))

    def run(batches):
        import xxhash

        frequent = sent.value

        for b in batches:
            sets = [shingles(x.as_py(), sim.n) for x in b.column(1)]
            both = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            halves = np.frombuffer(b"".join(both), "<i8").reshape(-1, 2)
            keys = [keys_of(s, sim, frequent) if len(s) else np.empty(0, _U) for s in sets]
            offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype("int32")
            flat = np.concatenate([np.empty(0, _U), *keys]).view("int64")
            least = np.array([[_mix(s ^ _U(turn)).min() if len(s) else 0 for turn in range(ROUNDS)] for s in sets], _U).reshape(-1).view("int64")
            mins = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype="int32") * ROUNDS), pa.array(least))
            cols = [b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), mins]
            yield pa.RecordBatch.from_arrays(cols, names=["_id", "n", "h1", "h2", "keys", "mins"])

    return stored(t.mapInArrow(run, "_id long, n long, h1 long, h2 long, keys array<long>, mins array<long>"), "shingle-keys")


def copies(found: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Edges from each document to the smallest id with an equal set, beside that set."""
    sets = found.filter("n > 0 and _id is not null").select("_id", "h1", "h2", "n")
    groups = sets.groupBy("h1", "h2", "n").agg(F.min("_id").alias("b"), F.max("_id").alias("_z")).filter("_z > b").drop("_z")
    groups = stored(groups, "equal-sets")
    groups = F.broadcast(groups) if groups.count() <= broadcast_rows else groups
    return stored(sets.join(groups, ["h1", "h2", "n"]).filter("_id != b").select(F.col("_id").alias("a"), "b", "h1", "h2", "n"), "copies")


def candidates(found: DataFrame) -> DataFrame:
    """Edges between documents that agree in a key. A map task links the documents it has for a key among themselves and
    sends on one of them, so a key of any frequency has at most a row for each chunk of keys."""

    def local(batches):
        ids, keys, have = [], [], 0

        def flush():
            i, k = np.concatenate(ids), np.concatenate(keys)
            order = np.lexsort((i, k))
            i, k = i[order], k[order]
            first = np.concatenate([[True], k[1:] != k[:-1]])
            head = i[np.maximum.accumulate(np.where(first, np.arange(len(k)), 0))]
            other = ~first & (i != head)
            pairs = np.unique(np.stack([i[other], head[other]], 1), axis=0) if other.any() else np.empty((0, 2), "int64")
            salt = _mix(pairs[:, 0].astype(_U)).view("int64")
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([k[first], salt])), pa.array(np.concatenate([i[first], pairs[:, 0]])), pa.array(np.concatenate([np.zeros(first.sum(), "int64"), pairs[:, 1]]), mask=np.arange(first.sum() + len(pairs)) < first.sum())],
                names=["key", "a", "b"],
            )

        for b in batches:
            lists = b.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            ids.append(np.repeat(b.column(0).to_numpy(zero_copy_only=False), sizes))
            keys.append(lists.flatten().to_numpy())
            have += len(keys[-1])
            if have >= CHUNK_KEYS:
                yield flush()
                ids, keys, have = [], [], 0
        if have:
            yield flush()

    def meet(batches):
        last_key, head = None, None
        for b in batches:
            known = b.column(2).is_valid().to_numpy(zero_copy_only=False)
            k, a = b.column(0).to_numpy(), b.column(1).to_numpy()
            done = np.stack([a[known], b.column(2).to_numpy(zero_copy_only=False)[known].astype("int64")], 1)
            k, a = k[~known], a[~known]
            if len(k):
                first = np.concatenate([[last_key is None or k[0] != last_key], k[1:] != k[:-1]])
                at = np.maximum.accumulate(np.where(first, np.arange(len(k)), -1))
                heads = np.where(at >= 0, a[np.maximum(at, 0)], head if head is not None else 0)
                other = heads != a
                done = np.concatenate([done, np.stack([a[other], heads[other]], 1)])
                last_key, head = k[-1], heads[-1]
            if len(done):
                done = np.unique(done, axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(done[:, 0])), pa.array(np.ascontiguousarray(done[:, 1]))], names=["a", "b"])

    rows = found.filter("size(keys) > 0 and _id is not null").select("_id", "keys").mapInArrow(local, "key long, a long, b long")
    return rows.repartition("key").sortWithinPartitions("key", "a", "b").mapInArrow(meet, "a long, b long")


class _Node:
    __slots__ = ("bits", "high", "kids", "low", "one", "slack", "start")

    def __init__(self, bits, low, high, slack, start, kids):
        self.bits, self.low, self.high, self.slack, self.start, self.kids, self.one = bits, low, high, slack, start, kids, not kids


def traverse(sets: list[np.ndarray], labels: list, sim: Similarity, sides: list | None = None) -> dict:
    """Links between the sets, as the label that each label is merged into. Labels that are equal count as linked; with
    sides only pairs from different sides are looked at."""
    order = sorted(range(len(sets)), key=lambda i: (int(sets[i][0]), len(sets[i]), i))
    sets, labels = [sets[i] for i in order], [labels[i] for i in order]
    sides = [sides[i] for i in order] if sides else None
    m = min(1 << 16, max(256, 1 << (2 * max(map(len, sets)) - 1).bit_length()))
    root = {x: x for x in labels}

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    def leaf(i: int) -> _Node:
        at = np.zeros(m, np.uint8)
        at[sets[i] & _U(m - 1)] = 1
        bits, n = int.from_bytes(np.packbits(at).tobytes(), "big"), len(sets[i])
        return _Node(bits, n, n, n - bits.bit_count(), i, [])

    level = [leaf(i) for i in range(len(sets))]
    while len(level) > 1:
        up = []
        for k in range(0, len(level), FANOUT):
            kids, bits = level[k : k + FANOUT], 0
            for x in kids:
                bits |= x.bits
            up.append(_Node(bits, min(x.low for x in kids), max(x.high for x in kids), max(x.slack for x in kids), kids[0].start, kids))
        level = up

    def single(x: _Node):
        """The class that all documents of a node are in, if there is one."""
        if not x.one:
            first = single(x.kids[0])
            if first is None or any(single(y) != first for y in x.kids[1:]):
                return None
            x.one = True
        return find(labels[x.start])

    stack = [(level[0], level[0])]
    while stack:
        a, b = stack.pop()
        if a is b:
            if a.kids and single(a) is None:
                k = len(a.kids)
                stack += [(a.kids[i], a.kids[j]) for i in range(k) for j in range(i + 1, k)]
                stack += [(x, x) for x in a.kids]
            continue
        if a.low > sim.most(b.high) or b.low > sim.most(a.high):
            continue
        overlap = min(a.high, b.high, (a.bits & b.bits).bit_count() + min(a.slack, b.slack))
        if not sim.linked(overlap, a.low, b.low):
            continue
        one = single(a)
        if one is not None and one == single(b):
            continue
        if a.kids or b.kids:
            if a.kids and (not b.kids or a.high - a.low >= b.high - b.low):
                stack += [(x, b) for x in a.kids]
            else:
                stack += [(a, x) for x in b.kids]
            continue
        if sides and sides[a.start] == sides[b.start]:
            continue
        s, t = sets[a.start], sets[b.start]
        bound = min(len(s) - (a.bits & ~b.bits).bit_count(), len(t) - (b.bits & ~a.bits).bit_count())
        if sim.linked(bound, len(s), len(t)) and sim.linked(len(np.intersect1d(s, t, True)), len(s), len(t)):
            p, q = sorted((one, single(b)))
            root[q] = p
    return {x: find(x) for x in labels}


def _joined(rows: DataFrame, by: list[str], sim: Similarity) -> DataFrame:
    """Merges (a, b) found by traversing each group of rows (label, text and maybe side)."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        if len(frame) < 2:
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        sets = [shingles(x, sim.n) for x in frame["text"]]
        have = np.array([len(s) > 0 for s in sets])  # an id may have rows without a shingle
        frame, sets = frame[have], [s for s in sets if len(s)]
        if len(sets) < 2:
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        sides = frame["side"].tolist() if "side" in frame else None
        merged = traverse(sets, frame["label"].tolist(), sim, sides if sides and len(set(sides)) > 1 else None)
        return pd.DataFrame([(a, b) for a, b in merged.items() if a != b], columns=["a", "b"], dtype="int64")

    return rows.groupBy(*by).applyInPandas(run, "a long, b long")


def _with_text(members: DataFrame, docs: DataFrame, id_col: str, text_col: str, broadcast_rows: int) -> DataFrame:
    texts = packed(docs, _id=F.col(f"`{id_col}`").cast("long"), text=text_of(text_col)).drop("_row")
    members = F.broadcast(members) if members.count() <= broadcast_rows else members
    return texts.join(members, "_id")


def links(docs: DataFrame, sim: Similarity, id_col: str = "doc_id", text_col: str = "text", max_block: int = MAX_BLOCK, max_sets: int = MAX_SETS, broadcast_rows: int = BROADCAST_ROWS) -> tuple[DataFrame, DataFrame]:
    """described() and label (id, label) for the documents that link with another."""
    found = described(docs, sim, id_col, text_col)
    equal = copies(found, broadcast_rows)
    pairs = equal.select("a", "b")
    clusters = components(pairs.unionByName(candidates(found)))
    # A row for each set of an id: a copy is left out, other sets of its id stay.
    sets = found.filter("n > 0 and _id is not null").select("_id", "h1", "h2", "n", "mins").distinct()
    sets = sets.join(equal.select(F.col("a").alias("_id"), "h1", "h2", "n"), ["_id", "h1", "h2", "n"], "left_anti")
    members = clusters.join(sets, clusters["id"] == sets["_id"]).select("_id", F.col("label").alias("cluster"), "n", "mins")
    members = stored(members, "members")
    total = members.groupBy("cluster").agg(F.min("_id").alias("_p"), F.max("_id").alias("_q"), _blocks(max_block, max_sets).alias("blocks")).filter("_p < _q").drop("_p", "_q")
    members = stored(members.join(total, "cluster").withColumn("label", F.col("_id")), "clustered")

    light = _with_text(members.filter("blocks = 1").select("_id", "cluster", "label").distinct(), docs, id_col, text_col, broadcast_rows)
    merges = stored(_joined(light, ["cluster"], sim), "merges")
    heavy = members.filter("blocks > 1")
    if heavy.limit(1).count():
        merges = merges.unionByName(_heavy(stored(heavy, "heavy"), docs, sim, id_col, text_col, max_block, max_sets, broadcast_rows))
    return found, components(pairs.unionByName(merges))


def _blocks(max_block: int, max_sets: int):
    """Blocks that the sets of a group are split into."""
    return F.ceil(F.greatest(F.sum("n") / max_block, F.count("*") / max_sets, F.lit(1.0)))


def _heavy(heavy: DataFrame, docs: DataFrame, sim: Similarity, id_col: str, text_col: str, max_block: int, max_sets: int, broadcast_rows: int) -> DataFrame:
    """Merges in large clusters (_id, cluster, label, n, mins)."""
    text = lambda rows: _with_text(rows, docs, id_col, text_col, broadcast_rows)
    merges, now = None, heavy.select("_id", "cluster", "n", "label", "mins")
    for turn in range(2 * ROUNDS):
        # What agrees in the least hash is split by id if it's too much; in a later round what's left of it meets.
        some = now.withColumn("least", F.element_at("mins", turn % ROUNDS + 1))
        size = some.groupBy("cluster", "least").agg(_blocks(max_block, max_sets).alias("_t"), F.count("*").alias("_c")).filter("_c > 1")
        some = stored(some.join(size, ["cluster", "least"]).withColumn("block", F.pmod(F.xxhash64("_id", F.lit(turn)), F.col("_t"))), "blocks")
        got = stored(_joined(text(some.select("_id", "cluster", "least", "block", "label").distinct()), ["cluster", "least", "block"], sim), "merges")
        merges = got if merges is None else merges.unionByName(got)
        if turn >= ROUNDS - 1 and some.filter("_t > 1").limit(1).count() == 0:
            break
        now = stored(now.join(got.select(F.col("a").alias("_id")).distinct(), "_id", "left_anti"), "left")
    # Documents that one class of a cluster took in may still link with another class: only then pairs of blocks are needed.
    classes = components(merges)
    labelled = heavy.select("_id", "cluster", "n").join(classes.withColumnRenamed("id", "_id"), "_id", "left").withColumn("label", F.coalesce("label", "_id"))
    several = labelled.groupBy("cluster").agg(F.min("label").alias("p"), F.max("label").alias("q")).filter("p != q").select("cluster")
    open_ = stored(labelled.join(several, "cluster"), "open")
    if open_.limit(1).count() == 0:
        return merges
    # Passages tie unlike documents into one cluster. Bitmaps tell which pairs can link at all, and take a small part of the place
    # of texts in the pairs of blocks; texts go only to the documents that they leave.
    finer = components(_near(text(open_.select("_id", "cluster", "label").distinct()), sim, max_block, max_sets))
    open_ = stored(open_.drop("cluster").join(finer.select(F.col("id").alias("_id"), F.col("label").alias("cluster")).distinct(), "_id"), "finer")
    total = open_.groupBy("cluster").agg(F.min("label").alias("_p"), F.max("label").alias("_q"), _blocks(max_block, max_sets).alias("blocks")).filter("_p != _q").drop("_p", "_q")
    open_ = stored(open_.join(total, "cluster"), "open")
    merges = merges.unionByName(stored(_joined(text(open_.filter("blocks = 1").select("_id", "cluster", "label").distinct()), ["cluster"], sim), "merges"))
    large = open_.filter("blocks > 1").drop("blocks")
    if large.limit(1).count() == 0:
        return merges
    placed = _block_pairs(large.select("*", _bin_of(sim)(F.col("n")).alias("bin")), max_block // 2, max_sets // 2).select("_id", "cluster", "label", "task", "side").distinct()
    return merges.unionByName(stored(_joined(text(stored(placed, "placed")), ["cluster", "task"], sim), "merges"))


def _bin_of(sim: Similarity):
    """The number of the size class of n, as a function of a column: sets that link are of one class or of two that follow each other."""
    bounds = sim.bins

    @F.pandas_udf("long")
    def bin_of(n: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, n.to_numpy(), "right") - 1)

    return bin_of


def _block_pairs(rows: DataFrame, max_block: int, max_sets: int) -> DataFrame:
    """rows (_id, cluster, n, bin, ...) dealt to the pairs of blocks of a cluster that are of one bin or two that follow each
    other: task, and side, which of the two blocks a row is in. A pair of a block with itself has one side."""
    sums = rows.groupBy("cluster", "bin").agg(_blocks(max_block, max_sets).alias("salts"))
    blocks = sums.select("cluster", "bin", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    other = blocks.select("cluster", F.col("bin").alias("bin2"), F.col("salt").alias("salt2"))
    near = blocks.select("*", F.explode(F.array(F.col("bin"), F.col("bin") + 1)).alias("bin2")).join(other, ["cluster", "bin2"])
    near = near.filter((F.col("bin2") > F.col("bin")) | (F.col("salt2") > F.col("salt")) | (F.col("bin2") == F.col("bin")) & (F.col("salt") == F.col("salt2")))
    near = near.withColumn("task", F.struct("bin", "salt", "bin2", "salt2"))
    first = near.select("cluster", "bin", "salt", "task", F.lit(0).alias("side"))
    second = near.filter((F.col("bin") != F.col("bin2")) | (F.col("salt") != F.col("salt2"))).select("cluster", F.col("bin2").alias("bin"), F.col("salt2").alias("salt"), "task", F.lit(1).alias("side"))
    placed = rows.join(sums, ["cluster", "bin"]).withColumn("salt", F.pmod(F.xxhash64("_id"), F.col("salts")))
    return placed.join(stored(first.unionByName(second), "block-pairs"), ["cluster", "bin", "salt"])


def _width(high: int) -> int:
    """Bits of the bitmaps of sets up to a size: a power of two, at least twice as many."""
    return max(256, 1 << (2 * high - 1).bit_length())


def parity(s: np.ndarray, width: int) -> np.ndarray:
    """Bit k is set if an odd number of the set's hashes end in k. Two bitmaps differ in no more bits than their sets in shingles."""
    return np.packbits(np.bincount((s & _U(width - 1)).astype("int64"), minlength=width).astype(np.uint8) & 1)


def _near(rows: DataFrame, sim: Similarity, max_block: int, max_sets: int) -> DataFrame:
    """Edges (a, b) from the documents of rows (_id, text, cluster, label) that can link with one of another label in their cluster, by
    the bits that their bitmaps differ in: two documents that link come out connected. A row's bitmap has some two bits a
    shingle, so a task has eight times the sets that it would have as texts."""
    bounds, schema = sim.bins, "_id long, cluster long, label long, n long, bin long, bits binary"

    def mark(batches):
        for b in batches:
            sets = [shingles(x.as_py(), sim.n) for x in b.column("text")]
            have = [i for i, s in enumerate(sets) if len(s)]
            bins = np.searchsorted(bounds, [len(sets[i]) for i in have], "right") - 1
            bits = [parity(sets[i], _width(int(bounds[k + 1]) - 1)).tobytes() for i, k in zip(have, bins, strict=True)]
            cols = [b.column(c).take(pa.array(have, pa.int64())) for c in ("_id", "cluster", "label")]
            cols += [pa.array([len(sets[i]) for i in have], pa.int64()), pa.array(bins, pa.int64()), pa.array(bits, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["_id", "cluster", "label", "n", "bin", "bits"])

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"a": [], "b": []}, dtype="int64")
        frame = frame.sort_values("side", kind="stable")
        ids, label, n, side = (frame[c].to_numpy("int64") for c in ("_id", "label", "n", "side"))
        if len(ids) < 2 or (label == label[0]).all():
            return none
        width = min(len(x) for x in frame["bits"])
        maps = np.empty((len(ids), width // 8), _U)
        for i, x in enumerate(frame["bits"]):
            x = np.frombuffer(x, _U)
            while len(x) > width // 8:  # of a set in the larger bin: its upper half is laid over the lower
                x = x[: len(x) // 2] ^ x[len(x) // 2 :]
            maps[i] = x
        two = side[-1] > 0
        cut = int(np.searchsorted(side, 1)) if two else len(ids)
        group = np.arange(len(ids))
        for i in range(cut):
            lo = cut if two else i + 1
            differ = np.bitwise_count(maps[lo:] ^ maps[i]).sum(1, dtype="int64")
            can = (differ * (sim.den + sim.num) <= (n[lo:] + n[i]) * (sim.den - sim.num)) & (label[lo:] != label[i])
            if can.any():
                met = np.unique(np.append(group[lo:][can], group[i]))
                if len(met) > 1:
                    group[np.isin(group, met)] = met[0]
        a, b = ids, ids[group]
        return pd.DataFrame({"a": a[a != b], "b": b[a != b]}) if (a != b).any() else none

    marks = stored(rows.select("_id", "text", "cluster", "label").mapInArrow(mark, schema), "marks")
    return stored(_block_pairs(marks, 4 * max_block, 4 * max_sets).groupBy("cluster", "task").applyInPandas(run, "a long, b long"), "near")


def classes(docs: DataFrame, sim: Similarity = Similarity(), id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Per row: _id, n_shingles and component_id, the smallest id that links reach."""
    with recorded() as made:
        found, labels = links(docs, sim, id_col, text_col, **how)
        release(docs.sparkSession, made, found, labels)
    labels = labels.withColumnRenamed("id", "_id")
    labels = F.broadcast(labels) if labels.count() <= how.get("broadcast_rows", BROADCAST_ROWS) else labels
    return found.join(labels, "_id", "left").select("_id", F.col("n").alias("n_shingles"), F.coalesce("label", "_id").alias("component_id"))


def representatives(docs: DataFrame, sim: Similarity = Similarity(), id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs without the documents that link to a smaller id: one of each class stays."""
    with recorded() as made:
        _, labels = links(docs, sim, id_col, text_col, **how)
        release(docs.sparkSession, made, labels)
    gone = labels.filter("id != label").select("id")
    gone = F.broadcast(gone) if gone.count() <= how.get("broadcast_rows", BROADCAST_ROWS) else gone
    rows = packed(docs, _id=F.col(f"`{id_col}`").cast("long"))
    return unpacked(rows.join(gone, rows["_id"] == gone["id"], "left_anti"), docs.columns)


QUERY = "op9_ngram_join"

SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 3 THEN array_to_string(ws, ' ') ELSE ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] END AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT o.a, o.b FROM o JOIN n x ON x.doc_id = o.a JOIN n y ON y.doc_id = o.b WHERE 100 * o.o >= 90 * (x.n + y.n - o.o)),
ab AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS a, doc_id AS c FROM documents UNION SELECT ab.b, r.c FROM r JOIN ab ON ab.a = r.a)
SELECT r.a AS doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r.c) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.a GROUP BY r.a
"""
