"""Structured Streaming over live audio blocks (session, seq, ts, samples) and job states. The same functions take a batch
table; the stateful ones sort it by seq within a session."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _marked(t: DataFrame, late: str) -> DataFrame:
    return t.withWatermark("ts", late) if t.isStreaming else t


def voice_gate(levels: DataFrame, hop: str, window: str, threshold_db: float, late: str = "10 seconds") -> DataFrame:
    """RMS of (session, ts, x) over sliding windows, and whether it's loud enough; gates at -60 dB or below are off."""
    t = _marked(levels, late).groupBy("session", F.window("ts", window, hop)).agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"))
    db = 20 * F.log10(F.greatest("rms", F.lit(1e-10)))
    return t.select("session", F.col("window.start").alias("start"), "rms", (F.lit(threshold_db <= -60) | (db >= threshold_db)).alias("open"))


def muted_blocks(blocks: DataFrame, hop: str, window: str, threshold_db: float, late: str = "10 seconds") -> DataFrame:
    """The blocks (session, seq, ts, samples), with zeros where the gate is closed: where the RMS of the samples of the window that
    ends with a block's hop is below the threshold. In a stream windows and blocks are joined under the watermark by the end
    of the hop, and a block comes out when its window is complete. A threshold of -60 dB or below lets everything through."""
    b = _marked(blocks.select("session", "seq", "ts", F.col("samples").cast("array<double>").alias("samples")), late)
    square = F.aggregate("samples", F.lit(0.0), lambda s, x: s + x * x)
    level = b.groupBy("session", F.window("ts", window, hop)).agg((F.sum(square) / F.greatest(F.sum(F.size("samples")), F.lit(1))).alias("_ms"))
    level = level.select(F.col("session").alias("_session"), F.window_time("window").alias("_end"), "_ms")
    same = F.col("ts") + F.expr("INTERVAL 0 SECONDS")  # a stream has one column of event time: the end of the hop
    t = b.withColumn("_hop", F.window("ts", hop)).select("session", "seq", same.alias("ts"), "samples", F.window_time("_hop").alias("_at"))
    t = t.join(level, (t["session"] == level["_session"]) & (t["_at"] == level["_end"]))
    open_ = F.lit(threshold_db <= -60) | (10 * F.log10(F.greatest("_ms", F.lit(1e-20))) >= threshold_db)
    return t.select("session", "seq", "ts", F.when(open_, F.col("samples")).otherwise(F.transform("samples", lambda x: F.lit(0.0))).alias("samples"))


def block_rms(levels: DataFrame, block: str, late: str = "10 seconds") -> DataFrame:
    """One RMS for every block of time."""
    t = _marked(levels, late).groupBy("session", F.window("ts", block)).agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"), F.count("*").alias("n"))
    return t.select("session", F.col("window.start").alias("start"), "rms", "n")


def drop_repeated(blocks: DataFrame, late: str = "10 seconds") -> DataFrame:
    """Blocks without repeats of a sequence number that come within the watermark."""
    return blocks.withWatermark("ts", late).dropDuplicatesWithinWatermark(["session", "seq"]) if blocks.isStreaming else blocks.dropDuplicates(["session", "seq"])


def live_score(sung: DataFrame, notes: DataFrame, window: str, late: str = "10 seconds", buckets_per_second: int = 1) -> DataFrame:
    """Sung frames (track_id, ts, t in seconds, midi) against the note sounding at t: counts of good, warn and bad frames of a
    track in each window. Notes meet frames in second buckets; a note longer than a bucket is in several."""
    n = notes.select("track_id", "start", "end", "pitch", F.explode(F.sequence(F.floor(F.col("start") * buckets_per_second), F.floor(F.col("end") * buckets_per_second))).alias("_b"))
    s = _marked(sung, late).withColumn("_b", F.floor(F.col("t") * buckets_per_second))
    t = s.join(n, ["track_id", "_b"]).filter((F.col("t") >= F.col("start")) & (F.col("t") < F.col("end")))
    off = (F.col("midi") - F.col("pitch")) * 100
    off = F.abs(off - 1200 * F.floor(off / 1200 + 0.5))
    kind = F.when(off < 15, "good").when(off < 30, "warn").otherwise("bad")
    t = t.withColumn("kind", kind).groupBy("track_id", F.window("ts", window))
    t = t.agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("good", "warn", "bad")])
    return t.select("track_id", F.col("window.start").alias("start"), "good", "warn", "bad")


#: The share of a job's progress that each stage covers.
BANDS = {"Separating vocals": (0.0, 0.8), "Tracking pitch": (0.8, 0.92), "Finding notes": (0.92, 0.96), "Rendering": (0.96, 1.0)}
PREVIEW_BANDS = {"Separating vocals": (0.0, 0.75), "Tracking pitch": (0.75, 0.9), "Finding notes": (0.9, 1.0)}


def latest_state(states: DataFrame, bands: dict[str, tuple[float, float]] = BANDS) -> DataFrame:
    """The last state of every job (stem, ts, stage, fraction) with its progress."""
    last = states.groupBy("stem").agg(F.max_by(F.struct("stage", "fraction"), F.struct("ts", "order")).alias("s"))
    p = F.lit(0.0)
    for stage, (lo, hi) in bands.items():
        p = F.when(F.col("s.stage") == stage, lo + (hi - lo) * F.col("s.fraction")).otherwise(p)
    return last.select("stem", F.col("s.stage").alias("stage"), F.round(p, 3).alias("progress"))


def ring_step(ring: np.ndarray, block: np.ndarray, hop: int) -> np.ndarray:
    """The ring after a block: moved on by hop places, then the block without its first three values and its last in the last
    places. Places at the end that nothing is moved or written to keep their values."""
    new = block[3:-1][-len(ring) :]
    moved = np.concatenate([ring[hop:], ring[max(0, len(ring) - hop) :]])
    return np.concatenate([moved[: len(ring) - len(new)], new])


@functools.lru_cache
def fade_in(n: int) -> np.ndarray:
    return np.sin(0.5 * np.pi * (np.arange(n) / max(1, n - 1))) ** 2


def stitch_step(tail: np.ndarray, block: np.ndarray, search: int) -> tuple[np.ndarray, np.ndarray]:
    """A block moved to where it fits the kept tail best, cross-faded with it, and the new tail. Block lengths are those of the
    output, the tail and the search range together."""
    n = len(tail)
    near = np.lib.stride_tricks.sliding_window_view(block[: n + search], n)
    fit = near @ tail / np.sqrt((near * near).sum(1) + 1e-8)
    moved = block[int(fit.argmax()) :].copy()
    up = fade_in(n)
    moved[:n] = moved[:n] * up + tail * (1 - up)
    size = len(block) - n - search
    return moved[:size], moved[size : size + n]


#: Stateful jobs keep their state in this store, outside of the JVM's heap.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """Has to be called before a query with a stateful job starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def _through(step, kept: np.ndarray, blocks: list[list[np.ndarray]]) -> tuple[list[np.ndarray], np.ndarray]:
    """The outputs of step(state, *arrays) for blocks one after another, and the state after them."""
    out = []
    for arrays in blocks:
        made, kept = step(kept, *arrays)
        out.append(made)
    return out, kept


#: Groups that sessions are dealt to by hash: a group's sessions share a call, as one costs some milliseconds whatever it does.
GROUPS = 1024


class _InOrder:
    """Takes a session's blocks in order of seq. A block is held until its forerunner has come, or until the watermark passes the
    block's own time: then nothing before it is still to come, and what's missing is skipped. A session is forgotten when the
    watermark has left its last block behind by idle_ms. The state of a group of sessions comes and goes with its rows, so that
    a session costs no calls to the store."""

    def __init__(self, steps, start: list[float], names: list[str], first: int | None, idle_ms: int):
        self.steps, self.start, self.names, self.first, self.idle_ms = steps, start, names, first, idle_ms

    def schema(self, kind: str) -> str:
        held = "seq: long, ms: long, " + ", ".join(f"{n}: array<double>" for n in self.names)
        return f"sessions array<struct<session: {kind}, next: long, last_ms: long, kept: array<double>, held: array<struct<{held}>>>>"

    def __call__(self, key, frames, state) -> Iterator[pd.DataFrame]:
        mark, places, came, out = state.getCurrentWatermarkMs(), {}, {}, []
        for session, *place in state.get[0] if state.exists else []:
            places[session] = place
        for f in frames:
            for session, *x in zip(*(f[c].tolist() for c in ("session", "seq", "_ms", *self.names)), strict=True):
                came.setdefault(session, []).append(x)
        left, due = [], []
        for session in {**places, **came}:
            place, blocks = self._advance(mark, places.get(session, (self.first, 0, self.start, [])), came.get(session, []))
            out += [(session, seq, x) for seq, x in blocks]
            if place:
                left.append((session, *place))
                # The first of those that wait is let go as soon as the watermark reaches it.
                due.append(place[3][0][1] if place[3] else place[1] + self.idle_ms)
        if left:
            state.update((left,))
            state.setTimeoutTimestamp(min(due))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["session", "seq", "samples"])

    def _advance(self, mark: int, place, got: list) -> tuple[tuple | None, list[tuple]]:
        """A session's place after its rows, None if it's forgotten, and the blocks that are let go."""
        after, last_ms, kept, held = place
        last_ms = max([last_ms, *(x[1] for x in got)])
        waiting = {}  # by seq: of repeats the first
        for x in [*held, *sorted(got, key=lambda x: (x[0], x[1], [list(v) for v in x[2:]]))]:
            if after is None or x[0] >= after:
                waiting.setdefault(x[0], x)
        ready = []
        for seq in sorted(waiting):
            if seq != after and waiting[seq][1] > mark:
                break
            ready.append((seq, [np.asarray(v, "float64") for v in waiting.pop(seq)[2:]]))
            after = seq + 1
        if not ready and not got and waiting:
            return (after, last_ms, kept, held), []
        out, kept = self.steps(np.array(kept, "float64"), [x for _, x in ready])
        blocks = [(seq, x) for (seq, _), x in zip(ready, out, strict=True)]
        if not waiting and mark >= last_ms + self.idle_ms:
            return None, blocks
        held = [(x[0], x[1], *(np.asarray(v, "float64").tolist() for v in x[2:])) for x in (waiting[k] for k in sorted(waiting))]
        return (after, last_ms, kept.tolist(), held), blocks


def in_order(blocks: DataFrame, step, start: list[float], names: tuple[str, ...] = ("samples",), late: str = "10 seconds", first: int | None = None, idle_ms: int = 60_000, together=None) -> DataFrame:
    """(session, seq, samples) of step(state, *arrays) -> (output, state) over the blocks (session, seq, ts, names...) of each session
    in order of seq. A batch is sorted; in a stream blocks may come in any order within late of event time. first is the number
    that sessions begin with; where it isn't given, a session's first block waits for the watermark. together(state, list of
    arrays of blocks) -> (outputs, state) may stand for step over several blocks."""
    schema = f"session {blocks.schema['session'].dataType.simpleString()}, seq long, samples array<double>"
    steps = together or functools.partial(_through, step)
    if not blocks.isStreaming:

        def whole(g: pd.DataFrame) -> pd.DataFrame:
            g = g.sort_values("seq", kind="stable").drop_duplicates("seq")
            out, _ = steps(np.array(start, "float64"), [[np.asarray(v, "float64") for v in x] for x in zip(*(g[n] for n in names), strict=True)])
            return pd.DataFrame({"session": g["session"], "seq": g["seq"], "samples": out})

        return blocks.select("session", "seq", *names).groupBy("session").applyInPandas(whole, schema)
    use_state_store(blocks.sparkSession)
    t = blocks.select("session", F.col("seq").cast("long").alias("seq"), "ts", F.unix_millis("ts").alias("_ms"), *names).withWatermark("ts", late)
    t = t.withColumn("_group", F.pmod(F.xxhash64("session"), F.lit(GROUPS))).groupBy("_group")
    run = _InOrder(steps, start, list(names), first, idle_ms)
    state = run.schema(blocks.schema["session"].dataType.simpleString())
    return t.applyInPandasWithState(lambda key, frames, state: run(key, frames, state), schema, state, "append", "EventTimeTimeout")


def pitch_ring(blocks: DataFrame, width: int, hop: int, **how) -> DataFrame:
    """The ring of the last width values of a session after each block, which moves it on by hop."""

    def step(ring, x):
        out = ring_step(ring, x, hop)
        return out, out

    return in_order(blocks, step, [0.0] * width, **how)


def stitch_blocks(blocks: DataFrame, tail: int, search: int, **how) -> DataFrame:
    """Output blocks joined where they fit best."""

    def step(kept, x):
        return stitch_step(kept, x, search) if len(x) > tail + search else (x, kept)

    return in_order(blocks, step, [0.0] * tail, **how)


#: Hops that a level is taken over, and the least level of the output.
LEVEL_HOPS, LEVEL_FLOOR = 4, 1e-3


def loudness_step(state: np.ndarray, source: np.ndarray, output: np.ndarray, rate: float, hop: int) -> tuple[np.ndarray, np.ndarray]:
    """The hops of output that are complete with these samples, times (r1 / max(r2, floor)) ** (1 - rate): r1 and r2 are the RMS of
    source and output over the last four hops, on straight lines from the end of one hop to the end of the next. The state is
    the mean squares of four hops a side, then what's left of source and of output; before the beginning it's silent."""
    n = LEVEL_HOPS
    left = (len(state) - 2 * n) // 2
    source, output = np.concatenate([state[2 * n : 2 * n + left], source]), np.concatenate([state[2 * n + left :], output])
    m = len(source) // hop
    kept, levels = [], []
    for x, old in ((source, state[:n]), (output, state[n : 2 * n])):
        squares = np.concatenate([old, (x[: m * hop].reshape(m, hop) ** 2).mean(1)])
        kept.append(squares[m:])
        ends = np.sqrt(np.lib.stride_tricks.sliding_window_view(squares, n).mean(1))  # of the hop before and of each hop
        levels.append(np.interp(np.arange(m * hop) / hop, np.arange(m + 1), ends))
    out = output[: m * hop] * (levels[0] / np.maximum(levels[1], LEVEL_FLOOR)) ** (1 - rate)
    return out, np.concatenate([*kept, source[m * hop :], output[m * hop :]])


def loudness_mix(blocks: DataFrame, rate: float, hop: int, **how) -> DataFrame:
    """The output of blocks (session, seq, ts, source, output) brought towards the loudness of their source. Blocks of any lengths
    give the same sound; an incomplete last hop waits for its rest."""

    def step(state, source, output):
        return loudness_step(state, source, output, rate, hop)

    def together(state, arrays):
        """The blocks as one: each gives the hops that end in it."""
        if not arrays:
            return [], state
        left = (len(state) - 2 * LEVEL_HOPS) // 2
        ends = (left + np.cumsum([len(x[0]) for x in arrays])) // hop * hop
        out, state = step(state, *(np.concatenate(x) for x in zip(*arrays, strict=True)))
        return np.split(out, ends[:-1]), state

    return in_order(blocks, step, [0.0] * (2 * LEVEL_HOPS), ("source", "output"), together=together, **how)
