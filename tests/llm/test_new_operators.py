"""Secrets, tokenizer alignment and source divergence against brute force."""

import hashlib
import random
import re
import string
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from sentencepiece import SentencePieceProcessor
from test_operators import SCHEMA, awkward, frame
from tokenizers import Tokenizer

from tonewright.llm import alignment, divergence, queries, secrets
from tonewright.llm.encoding import _byte_letters

BASE = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
}


def base_of(text):
    out = []
    for kind, pattern in BASE.items():
        least = {"assign": 8, "access": 16, "hex": 32}[kind]
        out += [(m.start(), list(BASE).index(kind), kind, m.end()) for m in pattern.finditer(text or "") if len(m[2] if kind == "assign" else m[0]) >= least]
    return [(k, s, e) for s, _, k, e in sorted(out)]


def keys(r, n, alphabet=string.ascii_letters + string.digits):
    return ["".join(r.choice(alphabet) for _ in range(r.randint(24, 40))) for _ in range(n)]


def test_base_patterns():
    r = random.Random(3)
    parts = ["password", "PassWd", "token", "api_key", "apikey", "API_KEY", "secret", '"', "'", " ", "  ", ":", "=", "==", "AKIA", "AKIAAKIA", "A1B2C3D4E5F6", "deadbeef", "0123456789abcdef" * 2, "g", "é", "\n", "K", "ſ", "hunter2hunter2", "x.y-z/+_="]
    for _ in range(4000):
        text = "".join(r.choice(parts) for _ in range(r.randint(1, 12)))
        assert [(secrets.KINDS[k], s, e) for s, k, e in secrets.base_spans(text)] == base_of(text), text


def test_secrets_of_awkward_tables(spark):
    r = random.Random(5)
    texts = [*awkward(), f"token = '{keys(r, 1)[0]}' é AKIA{'Q7' * 8}", "deadbeef" * 5, "中 api_key: abcdefgh", f"é {keys(r, 1)[0]}", "x " * 9000 + "password=" + "k" * 9]
    docs = frame(spark, texts)
    model = secrets.train(docs)
    found = {x["doc_id"]: x["spans"] for x in secrets.find(docs, model).collect()}
    rows = {x["doc_id"]: x for x in secrets.digests(secrets.find(docs, model)).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        base = base_of(t)
        listed = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert rows[i]["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert [rows[i][f"n_{k}"] for k in BASE] == [sum(x[0] == k for x in base) for k in BASE]
        assert [(x["kind"], x["start"], x["end"]) for x in found[i] if x["kind"] != "markov"] == base
        assert all((t or "")[x["start"] : x["end"]] == x["value"] for x in found[i])
        assert rows[i]["spans"] == ",".join(f"{x['kind']}:{x['start']}:{x['end']}" for x in found[i])
    empty = spark.createDataFrame([], SCHEMA)
    assert secrets.digests(secrets.find(empty, secrets.train(empty))).collect() == []


def test_markov_tells_keys_from_identifiers(spark, sf_dir):
    """Trained on the given documents and assignments of keys, asked about keys and identifiers that it hasn't seen."""
    r = random.Random(11)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").unionByName(spark.createDataFrame([(f"api_key={k}",) for k in keys(r, 200)], "text string"))
    model = secrets.train(docs)
    words = [w for x in docs.limit(150).collect() for w in re.findall(r"[A-Za-z]{3,12}", x["text"] or "")]
    plain = [f"{'_'.join(r.choice(words) for _ in range(3))}_{r.randint(1, 99)}" for _ in range(3000)]
    drawn = keys(r, 1000) + keys(r, 1000, "0123456789abcdef")
    assert np.mean([model.is_random(k) for k in drawn]) > 0.97
    assert np.mean([model.is_random(p) for p in plain]) < 0.01
    text = f"see {plain[0]} or {drawn[0]} now"
    assert [(secrets.KINDS[k], text[s:e]) for s, k, e in secrets.spans_of(text, model)] == [("markov", drawn[0])]
    none = secrets.train(docs.limit(0))
    assert not none.ratio.any() and not none.is_random(drawn[0])


A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=B)


def by_hand(text, a, b):
    """Figures of one text and its links, None without tokens."""
    raw = {c: k for k, c in enumerate(_byte_letters())}
    whole = (" " + (text or "")).encode()
    if not text:
        return None
    ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    xa = [bytes(raw[c] for c in a.id_to_token(i)) for i in ia]
    xb = [bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
    if b"".join(xa) != whole or b"".join(xb) != whole:
        return None
    ea, eb = (np.cumsum(list(map(len, x))).tolist() for x in (xa, xb))
    written, links, i, j = [], [], 0, 0
    for cut in sorted(set(ea) & set(eb)):
        p, q = ea.index(cut) + 1, eb.index(cut) + 1
        written.append(",".join(map(str, ia[i:p])) + "|" + ",".join(map(str, ib[j:q])))
        links.append((ia[p - 1], ib[q - 1]))
        i, j = p, q
    return len(ia), len(ib), len(written), hashlib.sha256(";".join(written).encode()).hexdigest(), links


def test_alignment_of_odd_texts(tokenizers):
    r = random.Random(1)
    some = list("ab c  \n\t.é中 ▁<s>\x1f\x00 AZ09'’ ́😀")
    texts = ["".join(r.choice(some[: r.randint(3, len(some))]) for _ in range(r.randint(0, 30))) for _ in range(1500)]
    texts += ["", "a ", " ", "  ", "a", "<s>", "<|endoftext|>", "▁", " ▁", "a\x1fb", "x" * 30_000, "中文" * 4000]
    for k in range(0, len(texts), 97):
        got, links = alignment.align_block(pa.array(texts[k : k + 97], pa.string()), A, B), []
        for i, t in enumerate(texts[k : k + 97]):
            want = by_hand(t, *tokenizers)
            links += want[4] if want else []
            assert (got["n_a"][i], got["n_b"][i], got["n_groups"][i], got["groups_sha256"][i]) == (want[:4] if want else (0, 0, 0, "")), t
        assert [(x >> 32, x & 0xFFFFFFFF) for x in got["pairs"].tolist()] == links


def check_alignment(rows, texts, tokenizers):
    want = [by_hand(t, *tokenizers) for t in texts]
    n = Counter(x for w in want if w for x in w[4])
    top = defaultdict(int)
    for (_, b), k in n.items():
        top[b] = max(top[b], k)
    assert len(rows) == len(texts)
    for row, w in zip(rows, want, strict=True):
        links = w[4] if w else []
        best, total = sum(n[x] == top[x[1]] for x in links), sum(n[x] for x in links)
        assert tuple(row)[1:] == ((*w[:3], len(links), best, total, w[3]) if w else (0, 0, 0, 0, 0, 0, ""))


def test_alignment_of_awkward_tables(spark, tokenizers, monkeypatch):
    texts = [*awkward(), "▁ not whole", "a\x1fb c", "<s> and <|endoftext|> ", "long " * 9000]
    for block in (alignment.BLOCK, 500):
        monkeypatch.setattr(alignment, "BLOCK", block)
        rows = sorted(alignment.aligned(frame(spark, texts), A, B).collect(), key=lambda x: x["doc_id"])
        check_alignment(rows, texts, tokenizers)
    same = spark.createDataFrame([(None, "a b", 1), (None, "a b", 2)], "doc_id long, text string, n_a int")
    assert [tuple(x)[:6] for x in alignment.aligned(same, A, B).collect()] == [(None, 2, 2, 2, 2, 2)] * 2
    assert alignment.aligned(spark.createDataFrame([], SCHEMA), A, B).collect() == []
    assert alignment.aligned(frame(spark, [None, ""]), A, B).count() == 2


def test_alignment_query(spark, sf_dir, tokenizers):
    docs = sorted(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    rows = sorted(queries.op12_tokenizer_alignment(spark, sf_dir).collect(), key=lambda x: x["doc_id"])
    assert [x["doc_id"] for x in rows] == [x["doc_id"] for x in docs]
    check_alignment(rows, [x["text"] for x in docs], tokenizers)


def test_pointer_jumping_crosses_long_chains():
    """Tokens of two bytes that overlap by one all the way: a single group of any length."""
    n = 5000
    a_ends, b_ends = np.append(np.arange(2, 2 * n, 2), 2 * n), np.append(np.arange(1, 2 * n, 2), 2 * n)
    a, b, first = alignment.labels(a_ends, b_ends)
    assert set(a) == set(b) == {len(b_ends) - 1} and first[-1] == len(a_ends) - 1


def audit_by_hand(rows, least, top):
    fold = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(fold))) for lang, source, text in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        spread, total = Counter(t for d in own for t in set(d[2])), Counter(t for d in own for t in d[2])
        kept = [t for t, n in spread.items() if n >= least]
        groups = {d[1]: Counter() for d in own}
        for _, source, ws in own:
            groups[source].update(ws)

        def p(counts):
            n = sum(counts[t] for t in kept)  # noqa: B023
            return {t: 1 + 1_000_000_000 * (counts[t] + 5) // (n + 5 * len(kept)) for t in kept}  # noqa: B023

        shares, of_lang = {s: p(c) for s, c in groups.items()}, p(total)
        for s, mine in shares.items():
            pair = [(-sum(abs(mine[t] - q[t]) for t in kept), o.encode(), o) for o, q in shares.items() if o != s]
            term = [(of_lang[t] - mine[t], t.encode(), t) for t in kept if groups[s][t] and mine[t] > of_lang[t]]
            for part, found in (("pair", sorted(pair)), ("term", sorted(term)[:top])):
                out |= {(lang, s, part, x[2], -x[0], k) for k, x in enumerate(found, 1)}
    return out


@pytest.mark.parametrize("width", [4, 32, 64])
def test_divergence_of_awkward_tables(spark, monkeypatch, width):
    monkeypatch.setattr(divergence, "WIDTH", width)
    r = random.Random(2)
    words = [f"{a}{b}{c}" for a in "abÀé中" for b in "xyz" for c in "klmno"] + ["Ab", "aB", "é-É"]
    rows = [(r.choice(["en", "de", None, ""]), r.choice(["a", "b", "ä", "Z", None, "hot", "hot", "hot"]), " ".join(r.choices(words, range(1, len(words) + 1), k=r.randint(0, 60)))) for _ in range(400)]
    rows += [("fr", "a", None), ("fr", "b", ""), ("it", "only", "x"), ("en", "none", "1 2 3"), ("en", "long", "xk " * 30_000)] + rows[:5] * 3
    clash = spark.createDataFrame([(*x, "1", "2", 3) for x in rows], "lang string, source string, text string, term string, n string, bits int").repartition(5)
    got = divergence.audit(clash, min_docs=10, top=7).collect()
    assert len(got) == len(set(got)) and {tuple(x) for x in got} == audit_by_hand(rows, 10, 7)
    assert divergence.audit(clash.limit(0)).collect() == []
    few = divergence.audit(clash.limit(20)).collect()
    assert few and all(x["part"] == "pair" and x["value"] == 0 for x in few)


def test_divergence_counts_in_bounded_tables(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 3)
    rows = [("en", f"s{i % 3}", f"one two w{i} two") for i in range(40)]
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(4)
    found = {(x["source"], x["term"]): (x["n"], x["d"]) for x in divergence.term_counts(docs).collect()}
    assert found["s0", "two"] == (28, 14) and found["s1", "w"] == (13, 13) and found["s2", ""] == (0, 0)


def test_shares_are_exact_beyond_64_bits(spark):
    row = spark.createDataFrame([(10**13, 10**15 + 7, 10**6)], "n long, total long, terms long").select(divergence.share("n", "total", "terms").alias("p")).first()
    assert row["p"] == 1 + 10**9 * (10**13 + 5) // (10**15 + 7 + 5 * 10**6)
