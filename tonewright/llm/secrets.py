"""Secrets in texts: known shapes, and strings that look drawn at random.

The base finds three shapes by fixed patterns. The method adds tokens of MIN_TOKEN characters and more, with a letter and a
digit, whose characters follow one another as in random strings rather than as in ordinary identifiers: two Markov models of
characters, compared by their log likelihood ratio. Both are trained from samples that the base labels: the values it
finds are random strings, tokens of MIN_ORDINARY characters and more that touch none of its spans are ordinary. All
of both are counted, over all documents, as steps from one character to the next, so what the driver gets is at most two
tables of STATES by STATES whatever the input. A model is a mixture of these counts with the uniform distribution,
which without a sample is all that's left of it. Ratios are sums of whole thousandths, the same in every run.

A token counts as a secret where the ratio beats the odds of RARITY ordinary tokens for each secret.

Defined results
* null text counts as empty and has no span; neither model has to have a sample: without both nothing is added;
* spans of the base all stay, also where they overlap; a token inside a base span isn't added again;
* places are in code points, ends exclusive; a text of any length is searched whole;
* rows that repeat are searched one by one and count as often in the samples; an empty table gives an empty result;
  other columns aren't carried along.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import packed, text_of

#: The base's patterns and least lengths (of a value, of a key, of a run).
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 8, "access": 16, "hex": 32}
KINDS = ("assign", "access", "hex", "markov")

MIN_TOKEN = 16
MIN_ORDINARY = 8
#: Letters and digits; other characters of tokens join words, and what follows one begins anew in a state of its own.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
STATES = len(ALPHABET) + 1
#: The uniform part of either model: keys are of many alphabets, so what the sample lacks is still likely.
UNIFORM = {"random": 0.5, "ordinary": 0.001}
RARITY = 100_000

_ASSIGN = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
# Runs are leftmost and as long as they can be, so asking for the length at once drops what would be dropped after it.
_ACCESS = re.compile(rf"AKIA[A-Z0-9]{{{LEAST['access'] - 4},}}")
_HEX = re.compile(rf"[0-9a-f]{{{LEAST['hex']},}}")
_TOKEN = re.compile(rf"[A-Za-z0-9+/_=-]{{{MIN_TOKEN},}}")
_ORDINARY = re.compile(rf"[A-Za-z0-9+/_=-]{{{MIN_ORDINARY},}}")
#: What a text with a span must have, for a quick look at a whole column.
_HINTS = rf"(?i:password|passwd|secret|token|api_?key)|AKIA[A-Z0-9]{{{LEAST['access'] - 4}}}|[0-9a-f]{{{LEAST['hex']}}}"
_CODES = np.full(256, -1, "int16")
_CODES[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(1, STATES)

Span = tuple[int, int, int]  # start, place of the kind in KINDS, end


def base_spans(text: str) -> list[Span]:
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def _values(text: str) -> list[str]:
    """What the base takes for a key: the value of an assignment, an access key, a run of hex digits."""
    assigned = [m[2] for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    return assigned + _ACCESS.findall(text) + _HEX.findall(text)


def _steps(text: str) -> np.ndarray:
    """The steps, from * STATES + to, of an ASCII text."""
    codes = _CODES[np.frombuffer(text.encode("ascii"), np.uint8)]
    before = np.concatenate([[0], np.maximum(codes[:-1], 0)])
    inside = codes > 0
    return before[inside].astype("int64") * STATES + codes[inside]


@dataclass(frozen=True)
class Markov:
    """ratio[from, to]: thousandths of the log likelihood ratio that a step adds."""

    ratio: np.ndarray

    @classmethod
    def of(cls, random: np.ndarray, ordinary: np.ndarray) -> Markov:
        logs = []
        for kind, n in (("random", random), ("ordinary", ordinary)):
            n = n.reshape(STATES, STATES).astype("float64")[:, 1:]
            total, flat = n.sum(1, keepdims=True), 1 / (STATES - 1)
            u = np.where(total > 0, UNIFORM[kind], 1.0)
            logs.append(np.log(u * flat + (1 - u) * n / np.maximum(total, 1)))
        table = np.zeros((STATES, STATES), "int64")
        table[:, 1:] = np.rint(1000 * (logs[0] - logs[1]))
        return cls(table)

    def score(self, token: str) -> int:
        return int(self.ratio.ravel()[_steps(token)].sum())

    def is_random(self, token: str) -> bool:
        return self.score(token) > 1000 * math.log(RARITY)


def train(docs: DataFrame, text_col: str = "text") -> Markov:
    """The models, from all documents."""
    t = packed(docs, _text=text_of(text_col)).drop("_row")

    def run(batches):
        for b in batches:
            hints = pc.match_substring_regex(b.column(0), _HINTS).to_pylist()
            values, ordinary = [], []
            for x, hint in zip(b.column(0), hints, strict=True):
                text = x.as_py()
                if hint:
                    values += _values(text)
                    spans = base_spans(text)
                    ordinary += [m[0] for m in _ORDINARY.finditer(text) if not any(s < m.end() and m.start() < e for s, _, e in spans)] if spans else _ORDINARY.findall(text)
                else:
                    ordinary += _ORDINARY.findall(text)
            n = np.concatenate([np.bincount(_steps("\n".join(x)), minlength=STATES * STATES) for x in (values, ordinary)])
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at].astype("int64"))], names=["step", "n"])

    found = t.mapInArrow(run, "step long, n long").groupBy("step").agg(F.sum("n").alias("n")).collect()  # at most 2 * STATES ** 2
    n = np.zeros(2 * STATES * STATES, "int64")
    for r in found:
        n[r["step"]] = r["n"]
    return Markov.of(n[: STATES * STATES], n[STATES * STATES :])


def spans_of(text: str, model: Markov, base: bool = True) -> list[Span]:
    """All spans by start and kind; base: if the text may have some of the base's."""
    found = base_spans(text) if base else []
    for m in _TOKEN.finditer(text):
        x = m[0]
        if not x.isalpha() and any(map(str.isdigit, x)) and any(map(str.isalpha, x)) and model.is_random(x) and not any(s <= m.start() and m.end() <= e for s, _, e in found):
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def find(docs: DataFrame, model: Markov, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id under its own name and spans, an array of kind, start, end and value by start and kind."""
    t = packed(docs, _id=id_col, _text=text_of(text_col)).drop("_row")
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("value", T.StringType())])
    schema = T.StructType([T.StructField(id_col, t.schema["_id"].dataType), T.StructField("spans", T.ArrayType(span))])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))

    def run(batches):
        for b in batches:
            base = pc.match_substring_regex(b.column(1), _HINTS)
            some = pc.or_(base, pc.match_substring_regex(b.column(1), _TOKEN.pattern)).to_pylist()
            out = []
            for x, hint, any_ in zip(b.column(1), base.to_pylist(), some, strict=True):
                text = x.as_py() if any_ else ""
                out.append([{"kind": KINDS[k], "start": s, "end": e, "value": text[s:e]} for s, k, e in spans_of(text, model, hint)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, kind)], names=schema.names)

    return t.mapInArrow(run, schema)


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per row of find(): the id, counts of the base's kinds, the hash of its spans and all spans as text."""
    listed = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["kind"] != KINDS[-1])
    return found.select(f"`{id_col}`", *map(count, KINDS[:-1]), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


QUERY = "op11_secrets"
