"""The training-data operators against brute force, and on awkward tables: nulls, empty and long texts, ties, repeated rows,
empty tables, columns with clashing names."""

import base64
import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import oracle
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

from tonewright.llm import binary_output, common, encoding, exact_dedup, mixing, ngram_join, packing, quality_rules, queries, sharding, token_counts, toxicity, warc
from tonewright.llm.encoding import Encoder

WORDS = [f"w{i}" for i in range(300)]
SCHEMA = "doc_id long, text string, source string, n_words string, _id string, _row string, `key.dot` int"


def frame(spark, texts, sources=None):
    """Documents with extra columns whose names clash with those of the operators."""
    sources = sources or [f"s{i % 3}" for i in range(len(texts))]
    rows = [(i, t, s, "x", "y", "z", 7) for i, (t, s) in enumerate(zip(texts, sources, strict=True))]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def awkward(seed=0, n=60):
    r = random.Random(seed)
    say = lambda k: " ".join(r.choice(WORDS) for _ in range(k))
    texts = [None, None, "", "", " \n\t", "a", "A", "a b", "é ß 中文   x", "the\nthe\nthe", say(5000)]
    texts += [say(r.randint(1, 200)) for _ in range(n)]
    return texts + [texts[12]] * 5 + [texts[13] + " end"]


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_against_sql(spark, sf_dir, con, name):
    assert oracle.compare(queries.QUERIES[name](spark, sf_dir), con, queries.SQL[name]) == ""


@pytest.mark.parametrize(("cells", "small"), [(1, 0), (64, 500_000), (exact_dedup.CELLS, 500_000)])
def test_exact_dedup(spark, cells, small):
    texts = awkward()
    docs = frame(spark, texts)
    got = {r["doc_id"]: r for r in exact_dedup.decisions(docs, cells=cells, broadcast_rows=small).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        same = [j for j, u in enumerate(texts) if (u or "") == (t or "")]
        assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (max(same), len(same), i == max(same))
        assert got[i]["text_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    kept = exact_dedup.dedup(docs)
    assert kept.columns == docs.columns and kept.count() == len({t or "" for t in texts})
    twice = docs.unionByName(docs)
    assert exact_dedup.dedup(twice).count() == len({t or "" for t in texts})
    assert exact_dedup.decisions(docs.limit(0)).count() == 0 and exact_dedup.dedup(docs.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, "a"), (None, "a"), (1, "a"), (None, "b")], "doc_id long, text string")
    assert sorted(map(str, exact_dedup.dedup(nulls).collect())) == sorted(["Row(doc_id=1, text='a')", "Row(doc_id=None, text='b')"])


def test_quality_rules(spark):
    texts = [*awkward(), "a b c a b c", "x x x x", "<#> | a\n<#> | a"]
    got = {r["_id"]: r for r in quality_rules.judged(frame(spark, texts)).drop("_row").collect()}
    for i, t in enumerate(texts):
        words = [w.decode() for w in (t or "").encode().split()]
        windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        often = Counter(windows)
        repeat = {k + d for k, w in enumerate(windows) if often[w] > 1 for d in range(3)}
        lines = [x for x in (t or "").split("\n") if x.encode().split()]
        assert got[i]["n_words"] == len(words) and got[i]["word_chars"] == sum(map(len, words))
        assert got[i]["n_symbols"] == sum(c in "#*$%&|<>" for c in t or "") and got[i]["n_dup_lines"] == len(lines) - len(set(lines))
        assert got[i]["n_repeat_words"] == len(repeat)
        assert got[i]["base_failed"] == (len(words) < 50 or 100 * len(repeat) > 50 * len(words))
    docs = frame(spark, texts)
    assert quality_rules.filter_documents(docs).columns == docs.columns
    assert quality_rules.filter_documents(docs.limit(0)).count() == 0 and quality_rules.judged(docs.limit(0)).count() == 0
    for condition in ("kept", "not base_failed and n_symbols < 3", "n_repeat_words > 0 or n_dup_lines > 0"):
        assert quality_rules.judged(docs).filter(condition).count() == quality_rules.judged(docs).selectExpr(f"int({condition}) AS c").agg(F.sum("c")).first()[0]


def test_quality_rules_keep_good_documents(spark, sf_dir):
    j = quality_rules.judged(common.table(spark, sf_dir, "documents")).withColumnRenamed("_id", "doc_id").filter("not base_failed")
    t = j.join(common.table(spark, sf_dir, "labels"), "doc_id")
    assert t.filter("quality = 1 and not kept").count() == 0 and t.filter("quality = 0 and kept").count() == 0


def test_mixing(spark):
    texts = awkward(1, 200)
    sources = [("big" if i % 4 else "small") if i % 9 else None for i in range(len(texts))]
    docs = frame(spark, texts, sources)
    rows = mixing.plan(docs, bucket_rows=7).collect()
    size = {i: len((t or "").encode().split()) for i, t in enumerate(texts)}
    assert {r["_id"]: r["size"] for r in rows} == size
    by = {}
    for i, s in enumerate(sources):
        by[s] = by.get(s, 0) + size[i]
    weight, left, level = {"big": 5.0, "small": 2.0, None: 1.0}, 1.5 * sum(size.values()), {}
    open_ = dict(by)
    while open_:  # give out by weight, stop those at their cap, share the excess again
        unit = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * unit > 2 * by[s]]
        if not full:
            level |= {s: weight[s] * unit for s in open_}
            break
        for s in full:
            level[s] = 2.0 * by[s]
            left -= level[s]
            del open_[s]
    for r in rows:
        s = sources[r["_id"]]
        assert r["source_size"] == by[s] and r["target"] == pytest.approx(level[s]) and r["taken"] <= 2 * r["size"]
    for s in by:
        assert abs(sum(r["taken"] for r in rows if sources[r["_id"]] == s) - level[s]) <= max(v for i, v in size.items() if sources[i] == s)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.plan(docs.repartition(5), bucket_rows=50).collect()))
    mix = mixing.mixed(docs)
    assert mix.columns == docs.columns and mix.count() == sum(len(r["copies"]) for r in rows)
    assert mixing.plan(docs.limit(0)).count() == 0 and mixing.mixed(docs.limit(0)).count() == 0
    assert mixing.plan(frame(spark, [None, ""])).agg(F.sum("taken")).first()[0] == 0


def test_mixing_with_repeated_and_null_ids(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGES", 3)  # the range with the cut is divided again and again
    r = random.Random(8)
    rows = [(r.choice([None, None, 1, 2, i]), " ".join(r.choice(WORDS) for _ in range(r.randint(0, 30))) or None, r.choice(["a", "b", None])) for i in range(300)]
    docs = spark.createDataFrame(rows + rows[:40], "doc_id long, text string, source string")
    runs = [sorted(map(str, mixing.plan(docs.repartition(k), bucket_rows=b).collect())) for k, b in ((2, 5), (7, 5), (3, 1000))]
    assert runs[0] == runs[1] == runs[2] and len(runs[0]) == 340
    budget = 1.5 * sum(len((t or "").split()) for _, t, _ in rows + rows[:40])
    taken = mixing.plan(docs, bucket_rows=5).agg(F.sum("taken")).first()[0]
    assert budget - 30 <= taken <= budget
    assert mixing.mixed(docs).columns == docs.columns


def test_ngram_join_against_all_pairs(spark, monkeypatch):
    r = random.Random(5)

    def near(t, k):
        w = t.split()
        for _ in range(k):
            w[r.randrange(len(w))] = r.choice(WORDS)
        return " ".join(w)

    texts = awkward(2, 10)
    for _ in range(25):
        t = " ".join(r.choice(WORDS) for _ in range(r.choice([5, 9, 12, 20, 40, 100, 300])))
        texts.append(t)
        for _ in range(r.randint(0, 5)):
            t = near(t, r.randint(0, max(1, len(t.split()) // 60)))
            texts.append(t)
    passage = " ".join(r.choice(WORDS) for _ in range(60))
    for _ in range(30):
        t = " ".join(r.choice(WORDS) for _ in range(r.choice([8, 20, 60]))) + " " + passage
        texts += [t, near(t, 2)]
    docs = frame(spark, texts)
    monkeypatch.setattr(ngram_join, "FREQUENT_SHARE", 20)
    for sim, block, most in ((ngram_join.Similarity(3, 90, 100), 4_000_000, 256), (ngram_join.Similarity(3, 90, 100), 4_000_000, 2), (ngram_join.Similarity(3, 90, 100), 400, 256), (ngram_join.Similarity(5, 80, 100), 1500, 8)):
        sets = [set(ngram_join.shingles(t, sim.n).tolist()) for t in texts]
        root = list(range(len(texts)))

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for i, j in itertools.combinations(range(len(texts)), 2):
            a, b = sets[i], sets[j]
            if a and b and sim.linked(len(a & b), len(a), len(b)):
                p, q = sorted((find(i), find(j)))
                root[q] = p
        got = {x["_id"]: x for x in ngram_join.classes(docs, sim, max_block=block, max_sets=most).collect()}
        assert [got[i]["component_id"] for i in range(len(texts))] == [find(i) for i in range(len(texts))]
        assert [got[i]["n_shingles"] for i in range(len(texts))] == [len(s) for s in sets]
    kept = ngram_join.representatives(docs, sim)
    assert kept.columns == docs.columns and kept.count() == len({find(i) for i in range(len(texts))})
    assert ngram_join.classes(docs.limit(0)).count() == 0


def test_traversal_needs_no_order():
    r = np.random.default_rng(3)
    base = r.integers(0, 2**63, 200).astype(np.uint64)
    sets = [np.unique(np.concatenate([r.permutation(base)[: 200 - k], r.integers(0, 2**63, k).astype(np.uint64)])) for k in r.integers(0, 30, 60)]
    sim = ngram_join.Similarity(3, 80, 100)
    one = ngram_join.traverse(sets, list(range(60)), sim)
    for i, j in itertools.combinations(range(60), 2):
        if sim.linked(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j])):
            assert one[i] == one[j]


WORD_BPE, BYTE_BPE, PIECES = (public_tokenizers.path(f) for f in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))


#: Without two white-space characters in a row: lines and words are cut by plain replacement.
PLAIN_TEXTS = ["One two.\nThree, four", "\nline\n", " blank", "end ", "it's. x'sy, A.B, ... !, é, Ä.\nß", "a\nb\nc", "", "\n", " "]


@pytest.mark.parametrize("path", [WORD_BPE, BYTE_BPE])
def test_encoding_is_the_librarys(path, monkeypatch):
    r = random.Random(1)
    letters = " \n\t.,'!?-abzABéÉñ0129½²_#$|<>  ​ßΣσİıКлю中文é's\r"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(3000)] + ["<|endoftext|> a", "x" * 5000]
    e = Encoder(path)
    want = [w.ids for w in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    for t, w in zip(texts[:200] + texts[-2:], want[:200] + want[-2:], strict=True):
        assert e.encode(t) == np.array(w, "<u4").tobytes()
    for block, kept in ((8_000_000, 1_000_000), (500, 300), (1, 5)):  # small ones: many blocks, chunks are forgotten
        monkeypatch.setattr(encoding, "BLOCK", block)
        monkeypatch.setattr(encoding, "CACHE", kept)
        ids, at = Encoder(path).encode_column(pa.array(texts))
        assert [ids[a:z].tolist() for a, z in itertools.pairwise(at)] == want
    words = [w.ids for w in e.tokenizer.encode_batch(PLAIN_TEXTS, add_special_tokens=False)]
    ids, at = e.encode_column(pa.array(PLAIN_TEXTS))
    assert [ids[a:z].tolist() for a, z in itertools.pairwise(at)] == words


def test_packing(spark):
    texts = awkward(3, 40)
    odd = frame(spark, ["again"]).unionByName(frame(spark, ["no id", "no id", None]).withColumn("doc_id", F.lit(None).cast("long")))
    docs = frame(spark, texts).unionByName(odd)
    rows = packing.pack(docs, WORD_BPE, 64).collect()
    assert len([r for r in rows if r["_id"] is None]) == 3
    tok = Tokenizer.from_file(WORD_BPE)
    want = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["_id"], []).append(r)
    for i, w in want.items():
        if i:
            got = sorted(by_doc[i], key=lambda r: r["piece"])
            assert b"".join(bytes(r["ids"]) for r in got) == np.array(w, "<u4").tobytes()
            assert [r["start"] for r in got] == [64 * k for k in range(len(got))] and all(r["length"] == 64 for r in got[:-1])
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(r["length"] for r in rows)
    assert len(bins) <= 1.1 * total / 64 + 1
    assert packing.pack(docs.limit(0), WORD_BPE).count() == 0


def test_bin_completion_is_best_on_small_cases():
    def least(items, cap):
        items = sorted(items, reverse=True)
        best = [len(items)]

        def put(i, rooms):
            if len(rooms) >= best[0]:
                return
            if i == len(items):
                best[0] = len(rooms)
                return
            for k in {r: k for k, r in enumerate(rooms) if r >= items[i]}.values():
                put(i + 1, [r - items[i] if j == k else r for j, r in enumerate(rooms)])
            put(i + 1, [*rooms, cap - items[i]])

        put(0, [])
        return best[0]

    for seed in range(60):
        r = random.Random(seed)
        items = [r.randint(3, 14) for _ in range(9)]
        found = packing.complete({s: items.count(s) for s in items}, 20)
        plan = found.plan
        assert found.best and found.sequences >= found.least == packing.fewest(Counter(items), 20)
        assert sorted(s for kind, n in plan for s, k in kind for _ in range(k * n)) == sorted(items)
        assert all(sum(s * k for s, k in kind) <= 20 for kind, _ in plan)
        assert sum(n for _, n in plan) == least(items, 20)
    assert packing.complete({}, 20).plan == []


def test_bound_on_the_number_of_bins():
    assert packing.fewest({}, 20) == 0 and packing.fewest({20: 3, 0: 2}, 20) == 3
    assert packing.fewest({11: 4, 10: 3}, 20) == 6  # 74 of 80 would fit into 4; tens don't go beside elevens
    assert packing.fewest({14: 5, 7: 2, 6: 5}, 20) == 6 and packing.fewest({21: 1, 20: 1, 3: 4}, 41) == 2
    r = np.random.default_rng(8)
    for _ in range(50):
        items, cap = r.integers(1, 41, 30).tolist(), 40
        c = Counter(items)
        want = max(
            sum(s > cap / 2 for s in items) + max(0, math.ceil((sum(s for s in items if low <= s <= cap / 2) - sum(cap - s for s in items if cap / 2 < s <= cap - low)) / cap))
            for low in range(cap // 2 + 1)
        )
        assert packing.fewest(c, cap) == want >= math.ceil(sum(items) / cap)
        assert want <= sum(n for _, n in packing.best_fit(c, cap))


def test_bin_completion_searches_at_full_size():
    """Lengths for which best-fit decreasing isn't best: the search must run and find the planted packing."""
    r = random.Random(4)
    counts = Counter()
    for _ in range(6):
        a = r.randint(700, 900)
        b = r.randint(500, 640)
        counts.update([a, b, packing.CAPACITY - a - b])
    found = packing.complete(dict(counts))
    greedy = sum(n for _, n in packing.best_fit(dict(counts), packing.CAPACITY))
    assert greedy > 6 and found.sequences == found.least == 6 and found.nodes > 0
    cut = packing.complete(dict(counts), max_nodes=1)
    assert not cut.best and cut.sequences == greedy


def test_packing_query_on_a_table_that_needs_the_search(spark, sf_dir):
    """At this size best-fit decreasing doesn't reach the lower bound, so the query's result is that of the search."""
    rows = queries.op6_best_fit_packing(spark, "/root/testdata/sf0.001").collect()
    counts = Counter(r["length"] for r in rows)
    found = packing.complete(dict(counts))
    assert found.nodes > 0 and len({r["sequence_id"] for r in rows}) == found.sequences < sum(n for _, n in packing.best_fit(dict(counts), packing.CAPACITY))
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY


def test_binary_output(spark, tmp_path):
    texts = awkward(4, 40)
    docs = frame(spark, texts)
    tok = Tokenizer.from_file(BYTE_BPE)
    at = 0
    got = {r["doc_id"]: r for r in binary_output.round_trip(docs, BYTE_BPE).collect()}
    for i, t in enumerate(texts):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert (got[i]["start"], got[i]["n_tokens"], zlib.crc32(bytes(got[i]["ids"]))) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    nulls = spark.createDataFrame([(None, "b"), (3, None), (1, "a"), (1, "a")], "doc_id long, text string")
    back = binary_output.round_trip(nulls, BYTE_BPE).orderBy("start").collect()
    assert [r["doc_id"] for r in back] == [None, 1, 1, 3]
    assert binary_output.round_trip(nulls.limit(0), BYTE_BPE).count() == 0


def test_token_counts(spark):
    texts = awkward(5, 40)
    docs = frame(spark, texts)
    model = token_counts.unigram(PIECES)

    def plain(word):  # every split, by recursion on the rest
        s, best = token_counts.MARK + word, {0: (0, 0)}
        for i in range(1, len(s) + 1):
            ways = [(best[j][0] + model.scores[s[j:i]], best[j][1] - 1) for j in range(i) if s[j:i] in model.scores]
            if s[i - 1] not in model.scores:
                b = len(s[i - 1].encode())
                ways.append((best[i - 1][0] + b * model.byte, best[i - 1][1] - b))
            best[i] = max(ways)
        return -best[len(s)][1]

    got = {r["doc_id"]: r for r in token_counts.counted(docs, PIECES).collect()}
    for i, t in enumerate(texts):
        words = [w.decode() for w in (t or "").encode().split()]
        assert got[i]["n_words"] == len(words) and got[i]["n_tokens"] == sum(map(plain, words))
    peer = Tokenizer(models.Unigram([("<unk>", -1e9), *((p, s / 1e6) for p, s in model.scores.items())], unk_id=0, byte_fallback=False))
    words = sorted({w for t in texts[12:] for w in (t or "").split()})
    model.learn(words)
    assert [model.counts[w] for w in words] == [len(peer.encode(token_counts.MARK + w).ids) for w in words]
    assert token_counts.counted(docs.limit(0), PIECES).count() == 0


def test_toxicity(spark):
    docs, labels = common.table(spark, "/root/testdata/sf0.01", "documents"), common.table(spark, "/root/testdata/sf0.01", "labels")
    model = toxicity.fit(docs, labels.filter("doc_id % 4 != 0"), min_docs=4)
    assert list(model.thresholds) == sorted(model.thresholds)
    t = toxicity.graded(docs.filter("doc_id % 4 = 0"), model).join(labels, "doc_id")
    right = t.groupBy(labels["toxic"].alias("y")).agg(F.avg((F.col("p_toxic") >= 0.5).cast("double")).alias("p")).collect()
    found = {r["y"]: r["p"] for r in right}
    assert found[0] < 0.03 and found[1] > 0.5
    odd = frame(spark, awkward())
    assert toxicity.graded(odd, model).count() == odd.count() and toxicity.graded(odd.limit(0), model).count() == 0
    nothing = toxicity.fit(docs, labels.limit(0))
    assert toxicity.graded(odd, nothing).filter("toxic or expected_severity > 0.001").count() == 0


def test_toxicity_scores_by_brute_force(spark):
    """Every figure of graded() worked out again from a text, the weights and the thresholds."""
    docs, labels = common.table(spark, "/root/testdata/sf0.001", "documents"), common.table(spark, "/root/testdata/sf0.001", "labels")
    model = toxicity.fit(docs, labels, min_docs=2)
    assert model.weights and len(model.thresholds) == toxicity.GRADES - 1
    texts = [*awkward(), None, "", "x" * 5000, *[r["text"] for r in docs.limit(60).collect()]]
    got = {r["doc_id"]: r for r in toxicity.graded(frame(spark, texts + texts[:3]), model).collect()}
    for i, text in enumerate(texts + texts[:3]):
        words, run = [], ""
        for c in (text or "").lower() + " ":  # runs of letters
            if c == "_" or not c.isalpha():
                words += [run] * bool(run)
                run = ""
            else:
                run += c
        counts = Counter()
        for w in words:
            counts["=" + w] += 1
            for k in (4, 5, 6, 7):
                if len(w) >= k:
                    counts["^" + w[:k]] += 1
        eta = sum(model.weights.get(f, 0.0) * math.log(1 + n) for f, n in counts.items())
        above = [1 / (1 + math.exp(t - eta)) for t in model.thresholds]
        each = [a - b for a, b in zip([1.0, *above], [*above, 0.0], strict=True)]
        assert got[i]["expected_severity"] == pytest.approx(sum(k * p for k, p in enumerate(each)), abs=1e-9)
        assert got[i]["p_toxic"] == pytest.approx(above[0], abs=1e-9) and got[i]["toxic"] == (got[i]["p_toxic"] >= 0.5)
        assert each[got[i]["grade"]] == pytest.approx(max(each), abs=1e-9)
    again = toxicity.fit(docs.repartition(5), labels.repartition(2), min_docs=2)
    assert again.weights == pytest.approx(model.weights) and again.thresholds == pytest.approx(model.thresholds)
    repeated = toxicity.fit(docs, labels.unionByName(labels), min_docs=2)  # repeated labels count once
    assert repeated.weights == pytest.approx(model.weights)


def test_ordinal_fit_finds_ordered_grades():
    r = np.random.default_rng(0)
    x = r.random((400, 3))
    y = np.digitize(x @ [3.0, -1.0, 0.0], [0.3, 1.2])
    doc, word = np.repeat(np.arange(400), 3), np.tile(np.arange(3), 400)
    w, th = toxicity.fit_ordinal(doc, word, x.ravel(), y, 3, 3, l2=1e-5, steps=600)
    assert th[0] < th[1] and w[0] > 0 > w[1] and abs(w[2]) < abs(w[1])
    eta = x @ w
    assert (np.digitize(eta, th) == y).mean() > 0.9


def test_grades_of_toxic_texts_come_from_models_that_did_not_see_them():
    r = np.random.default_rng(4)
    n, n_words = 240, 12
    how = r.random(n) * np.where(np.arange(n) % 3 == 0, 1, 0)  # how toxic every third text is
    x = r.random((n, n_words)) * 0.3
    x[:, :4] += how[:, None] * 2
    toxic = how > 0
    doc, word = np.repeat(np.arange(n), n_words), np.tile(np.arange(n_words), n)
    scores = toxicity.held_out_scores(doc, word, x.ravel(), toxic, n_words, folds=4, steps=200)
    fold = np.empty(n, int)
    for kind in (True, False):
        fold[toxic == kind] = np.arange((toxic == kind).sum()) % 4
    for k in range(4):  # by hand: fitted to the others, applied to its own
        own = fold == k
        rest = x[~own]
        w, th = toxicity.fit_ordinal(np.repeat(np.arange(len(rest)), n_words), np.tile(np.arange(n_words), len(rest)), rest.ravel(), toxic[~own].astype(int), n_words, 2, steps=200)
        assert scores[own] == pytest.approx(x[own] @ w - th[0])
    grades = toxicity.severity(scores, toxic)
    assert set(grades[~toxic]) == {0} and [(grades[toxic] == k).sum() for k in (1, 2, 3)] == pytest.approx([80 / 3] * 3, abs=1)
    mean = [how[grades == k].mean() for k in (1, 2, 3)]
    assert mean[0] < 0.35 < mean[1] < 0.65 < mean[2]
    one = np.arange(n) == 0  # a single toxic text can't be held out
    assert not toxicity.held_out_scores(doc, word, x.ravel(), one, n_words).any()
    assert toxicity.severity(np.zeros(n), one).tolist() == [1] + [0] * (n - 1)


def test_warc(spark):
    texts = awkward(6, 20)
    rows = [(i, f"http://x/{i}" if i % 3 else None, t, "z") for i, t in enumerate(texts)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, sha256 string").repartition(3)
    for least in (0, 3):
        folder = common.scratch_path(spark, "warc-test")
        warc.write(pages, folder, least)
        got = {r["page_id"]: r for r in warc.pages_back(spark, folder).collect()}
        raw = {r["id"]: bytes(r["record"]) for r in warc.rebuilt(spark, folder).collect()}
        assert spark.read.parquet(folder + "/payloads").count() == len({t or "" for t in texts})
        for i, t in enumerate(texts):
            data = (t or "").encode()
            keep = max(j for j, u in enumerate(texts) if (u or "") == (t or ""))
            kind = "response" if keep == i or len(data) < least else "revisit"
            digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
            assert (got[i]["payload_bytes"], got[i]["payload_digest"], got[i]["record_type"]) == (len(data), digest, kind) and got[i]["digest32"] == digest
            assert got[i]["refers_to"] == (str(keep) if kind == "revisit" else None)
            head, block = raw[i].split(b"\r\n\r\n", 1)
            length = int(head.split(b"Content-Length: ")[1].split(b"\r\n")[0])
            assert block[length:] == b"\r\n\r\n" and (block[:length].endswith(b"\r\n\r\n" + data) if kind == "response" else block[:length].endswith(b"\r\n\r\n"))
    assert warc.round_trip(pages.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, None, "a"), (1, None, "a"), (None, "u", "a"), (None, "u", "b"), (None, None, None)], "page_id long, url string, html string")
    back = warc.round_trip(twice).collect()
    assert Counter((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in back) == {(1, 1, "response", None): 2, (None, 1, "revisit", "1"): 1, (None, 1, "response", None): 1, (None, 0, "response", None): 1}


def test_warc_finds_what_is_not_as_said(spark):
    pages = spark.createDataFrame([(1, "http://é/", "text"), (2, None, "text")], "page_id long, url string, html string")
    folder = common.scratch_path(spark, "warc-test")
    warc.write(pages, folder)
    raw = warc.rebuilt(spark, folder)
    assert {r["url"] for r in warc.parsed(raw).collect()} == {"http://é/", None}
    for change in (lambda x: x.replace(b"text\r\n\r\n", b"test\r\n\r\n"), lambda x: x[:-1], lambda x: x.replace(b"Content-Length: 4", b"Content-Length: 5")):
        rows = [(r["id"], bytearray(change(bytes(r["record"])))) for r in raw.collect()]
        with pytest.raises(Exception, match="headers say"):
            warc.parsed(spark.createDataFrame(rows, raw.schema)).collect()


def test_sharding(spark, tmp_path):
    texts = awkward(7, 300)
    docs = frame(spark, texts)
    rows = sharding.assigned(docs, 2000).collect()
    assert len(rows) == len(texts)
    h = {r["i"]: r["h"] for r in docs.select(F.col("doc_id").alias("i"), mixing.shuffle_hash(F.col("doc_id"), F.col("text"), sharding.SEED).alias("h")).collect()}
    size = {i: len((t or "").encode()) for i, t in enumerate(texts)}

    def shard(i):  # split until it fits
        for depth in range(61):
            same = [j for j in h if h[j] >> (60 - depth) == h[i] >> (60 - depth)]
            if sum(size[j] for j in same) <= 2000 or len(same) == 1:
                return depth, h[i] >> (60 - depth), sum(size[j] for j in same), len(same)

    assert {r["_id"]: (r["depth"], r["prefix"], r["shard_bytes"], r["shard_docs"]) for r in rows} == {i: shard(i) for i in h}
    assert {r["doc_id"]: (r["depth"], r["prefix"], r["shard_bytes"], r["shard_docs"]) for r in sharding.read_back(docs, 2000).collect()} == {i: shard(i) for i in h}
    nulls = docs.withColumn("doc_id", F.lit(None).cast("long"))
    spread = sharding.read_back(nulls, 2000)
    assert spread.count() == len(texts) and spread.filter("shard_docs > 1 and shard_bytes > 2000").count() == 0
    assert sharding.read_back(docs.limit(0)).count() == 0
    folder = common.scratch_path(spark, "shards")
    back = sharding.write_shards(docs, folder, 2000)
    assert back.count() == len(texts) and sharding.assigned(docs.limit(0)).count() == 0
    assert sharding.assigned(docs.unionByName(docs), 2000).count() == 2 * len(texts)
