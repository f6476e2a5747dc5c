"""Queries that prepare clips and search vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dataset, vectors
from ..sources import tables as S
from .catalog import Catalog, rounded
from .source_queries import shared_folder
from .testbed import FOLDERS, NOTES, SAMPLES, folders, keyed, notes, samples, table, unkeyed

Q = Catalog()


@Q.add("j1_training_set", "SELECT doc_id AS clip FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) AND doc_id IN (SELECT page_id FROM pages)")
def j1(spark, sf_dir):
    key = lambda name, c: table(spark, sf_dir, name).select(F.col(c).alias("clip"))
    return dataset.training_set(key("pages", "page_id"), key("labels", "doc_id"), key("documents", "doc_id"))


@Q.add("j1_training_set_bucketed", "SELECT doc_id AS clip FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) AND doc_id IN (SELECT page_id FROM pages)")
def j1_bucketed(spark, sf_dir):
    """The same of tables that are stored in buckets of clips: the joins read them as they lie."""
    key = lambda name, c: S.write_bucketed(table(spark, sf_dir, name).select(F.col(c).alias("clip")), shared_folder(spark), ("clip",), buckets=16)
    return dataset.training_set(key("pages", "page_id"), key("labels", "doc_id"), key("documents", "doc_id"))


MAN = "man AS (SELECT folder AS output_key, min(p_partkey) AS speaker_id FROM folders WHERE p_partkey % 3 = 0 GROUP BY folder)"


def _manifest(spark, sf_dir):
    return folders(spark, sf_dir).filter("p_partkey % 3 = 0").groupBy(F.col("folder").alias("output_key")).agg(F.min("p_partkey").alias("speaker_id"))


@Q.add("j2_attach_speaker", f"WITH {FOLDERS}, {MAN} SELECT f.folder || '_' || f.p_partkey AS clip, m.output_key, m.speaker_id FROM folders f JOIN man m ON m.output_key = f.folder")
def j2(spark, sf_dir):
    clips = folders(spark, sf_dir).select(F.concat_ws("_", "folder", F.col("p_partkey").cast("string")).alias("clip"))
    return dataset.attach_speaker(clips, _manifest(spark, sf_dir))


@Q.add(
    "j2_attach_speaker_index",
    f"""WITH {FOLDERS}, {MAN} SELECT f.p_partkey, f.folder AS clip, coalesce(a.output_key, b.output_key) AS output_key, coalesce(a.speaker_id, b.speaker_id) AS speaker_id
    FROM folders f LEFT JOIN man a ON a.output_key = f.folder LEFT JOIN man b ON b.output_key = regexp_replace(f.folder, '_[^_]*$', '') WHERE coalesce(a.output_key, b.output_key) IS NOT NULL""",
)
def j2_index(spark, sf_dir):
    return dataset.attach_speaker(folders(spark, sf_dir).withColumnRenamed("folder", "clip"), _manifest(spark, sf_dir), whole_first=True)


BAD = "CASE WHEN vec_id % 17 = 0 THEN 'NaN'::FLOAT ELSE embedding[1] END"


@Q.add("f5_drop_bad_vectors", "SELECT vec_id, label AS clip FROM embeddings WHERE vec_id % 50 NOT IN (SELECT DISTINCT vec_id % 50 FROM embeddings WHERE vec_id % 170 = 0)")
def f5(spark, sf_dir):
    nan = F.transform("embedding", lambda x, i: F.when((F.col("vec_id") % 170 == 0) & (i == 3), F.lit(float("nan"))).otherwise(x))
    t = table(spark, sf_dir, "embeddings").select("vec_id", "label", (F.col("vec_id") % 50).alias("clip"), nan.alias("vec"))
    return dataset.drop_bad_vectors(t).select("vec_id", F.col("label").alias("clip"))


@Q.add("f6_keep_text_length", "SELECT doc_id FROM documents WHERE length(text) BETWEEN 1 AND 5000")
def f6(spark, sf_dir):
    return dataset.keep_text_length(table(spark, sf_dir, "documents"), "text").select("doc_id")


ARR = """arrs AS (SELECT clip, member, list(CAST(x * (clip % 5) AS DOUBLE) ORDER BY pos) AS xs FROM samples GROUP BY clip, member), pk AS (SELECT *, list_max(list_transform(xs, lambda x: abs(x))) AS p FROM arrs)"""


def _arrays(spark, sf_dir):
    s = samples(spark, sf_dir).groupBy("clip", "member").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda v: v["x"]).alias("samples"))
    return s


@Q.add("f7_peak_normalise", f"WITH {SAMPLES}, {ARR} SELECT clip, member, round(list_sum(list_transform(xs, lambda x: abs(x / p * (0.9 * 0.75) + 0.25 * x))), 3) AS total, len(xs) AS n FROM pk WHERE p > 0 AND p <= 2.5")
def f7(spark, sf_dir):
    t = _arrays(spark, sf_dir).withColumn("samples", F.transform("samples", lambda x: x * (F.col("clip") % 5)))
    t = dataset.peak_normalise(t)
    return t.select("clip", "member", F.round(F.aggregate("samples", F.lit(0.0), lambda a, x: a + F.abs(x)), 3).alias("total"), F.size("samples").alias("n"))


@Q.add("u2_repeat_rows", "SELECT p_partkey FROM part, range(0, 60) AS t(i) WHERE i < p_size % 4")
def u2(spark, sf_dir):
    return dataset.repeat_rows(table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 4).alias("repeat"))).select("p_partkey")


@Q.add("u3_add_silence_rows", "SELECT p_size AS speaker_id, p_name AS line FROM part UNION ALL SELECT s, 'mute|' || s FROM (SELECT DISTINCT p_size AS s FROM part), range(0, 2) AS t(i)")
def u3(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_size").alias("speaker_id"), F.col("p_name").alias("line"))
    return dataset.add_silence_rows(rows, dataset.filelist_line(F.lit("mute"), F.col("speaker_id")))


@Q.add("u5_key_sets_equal", "SELECT NOT EXISTS (SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem) AND NOT EXISTS (SELECT l_orderkey FROM lineitem EXCEPT SELECT o_orderkey FROM orders) AS equal")
def u5(spark, sf_dir):
    return dataset.key_sets_equal(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")), table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k")), "k")


BOUNDS = (100, 300, 500, 900, 2000, 5000)


def _bucketed(spark, sf_dir):
    return dataset.length_buckets(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", BOUNDS)


def _whole(name: str):
    """All values of an array, in whole thousandths."""
    return F.array_join(F.transform(name, lambda x: F.floor(x.cast("double") * 1000).cast("int")), ",")


@Q.add("u7_length_buckets", "SELECT doc_id, CASE WHEN n_chars <= 300 THEN 0 WHEN n_chars <= 500 THEN 1 WHEN n_chars <= 900 THEN 2 WHEN n_chars <= 2000 THEN 3 ELSE 4 END AS bucket FROM documents WHERE n_chars > 100 AND n_chars <= 5000")
def u7(spark, sf_dir):
    return _bucketed(spark, sf_dir).select("doc_id", "bucket")


@Q.add(
    "u8_pad_and_batch",
    """WITH b AS (SELECT doc_id, CASE WHEN n_chars <= 300 THEN 0 WHEN n_chars <= 500 THEN 1 WHEN n_chars <= 900 THEN 2 WHEN n_chars <= 2000 THEN 3 ELSE 4 END AS bucket FROM documents WHERE n_chars > 100 AND n_chars <= 5000),
    i AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY md5(doc_id || ':7'), doc_id) - 1 AS i, count(*) OVER (PARTITION BY bucket) AS n FROM b), p AS (SELECT *, i + t * n AS pos FROM i, range(0, 8) AS r(t) WHERE i + t * n < CAST(ceil(n / 8.0) * 8 AS BIGINT))
    SELECT bucket, doc_id, CAST(t AS INTEGER) AS turn, CAST(pos % 2 AS BIGINT) AS replica, pos // 2 // 4 AS batch_in_bucket, pos // 2 % 4 AS slot, md5(bucket || ':' || pos // 2 // 4 || ':8') AS batch_order FROM p""",
)
def u8(spark, sf_dir):
    t = dataset.pad_and_batch(_bucketed(spark, sf_dir), "doc_id", 4, 2, 7)
    return t.select("bucket", "doc_id", F.col("turn").cast("int").alias("turn"), *[F.col(c).cast("long").alias(c) for c in ("replica", "batch_in_bucket", "slot")], "batch_order")


@Q.add(
    "u9_pad_collate",
    """WITH v AS (SELECT vec_id, embedding AS e, vec_id // 10 AS batch, CAST(1 + vec_id % 7 AS INTEGER) AS n FROM embeddings) SELECT vec_id, array_to_string(list_transform(range(1, max(n) OVER (PARTITION BY batch) + 1), lambda i: CASE WHEN i > n THEN 0 ELSE CAST(floor(CAST(e[i] AS DOUBLE) * 1000) AS INTEGER) END), ',') AS samples, n AS length, CAST(row_number() OVER (PARTITION BY batch ORDER BY n DESC, vec_id) - 1 AS INTEGER) AS row, CAST(max(n) OVER (PARTITION BY batch) AS INTEGER) AS width FROM v""",
)
def u9(spark, sf_dir):
    t = table(spark, sf_dir, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 10).alias("batch"), F.slice("embedding", F.lit(1), (F.col("vec_id") % 7 + 1).cast("int")).alias("samples"))
    return dataset.pad_collate(t, "batch", "samples", "vec_id").select("vec_id", "length", "row", F.size("samples").alias("width"), _whole("samples").alias("samples"))


@Q.add("u10_align_lengths", "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1000) AS INTEGER)) AS e, CAST(least(2 * (1 + vec_id % 40), 64, 50) AS INTEGER) AS n FROM embeddings) SELECT vec_id, n, array_to_string(list_transform(range(0, n), lambda i: e[i // 2 + 1]), ',') AS phone, array_to_string(e[1:n], ',') AS spec, array_to_string(e[1:n], ',') AS pitch FROM v")
def u10(spark, sf_dir):
    t = table(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", F.lit(1), (F.col("vec_id") % 40 + 1).cast("int")).alias("phone"), F.col("embedding").alias("spec"), F.col("embedding").alias("pitch"))
    t = dataset.align_lengths(t, "phone", "spec", "pitch", 50)
    return t.select("vec_id", F.size("phone").alias("n"), *[_whole(c).alias(c) for c in ("phone", "spec", "pitch")])


@Q.add("l3_shuffle_rows", "SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id || ':3'), doc_id) - 1 AS place FROM documents")
def l3(spark, sf_dir):
    return dataset.shuffled(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 3)


@Q.add(
    "l5_last_aligned_windows",
    """WITH c AS (SELECT doc_id, n_chars / 100.0::DOUBLE AS l FROM documents) SELECT doc_id, round(i * 2.55::DOUBLE, 4) AS "start" FROM c, range(0, 20000) AS t(i) WHERE i < floor(l / 2.55::DOUBLE) UNION ALL SELECT doc_id, round(greatest(l - 2.55::DOUBLE, 0), 4) FROM c""",
)
def l5(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") / 100).alias("l"))
    return rounded(dataset.last_aligned_windows(t, "l", 2.55).select("doc_id", "start"))


@Q.add(
    "v10_cut_fixed",
    f"""WITH {NOTES}, s AS (SELECT track_id AS clip, note_no AS slice_no, CAST(3 + (note_no * 7 % 200) / 10.0 AS DOUBLE) AS l FROM notes), n AS (SELECT *, CAST(greatest(ceil(round((l - 4.0) / 3.4::DOUBLE, 9)), 0) AS INTEGER) AS n, slice_no = max(slice_no) OVER (PARTITION BY clip) AS last FROM s),
    b AS (SELECT *, coalesce(sum(n + 1) OVER (PARTITION BY clip ORDER BY slice_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM n)
    SELECT clip, slice_no, CAST(base + k AS BIGINT) AS number, round(k * 3.4::DOUBLE, 4) AS "start", round(CASE WHEN k < n THEN k * 3.4::DOUBLE + 3.7 ELSE l END, 4) AS "end" FROM b, range(0, 60) AS t(k) WHERE k < n OR k = n AND last""",
)
def v10(spark, sf_dir):
    t = notes(spark, sf_dir).select(F.col("track_id").alias("clip"), F.col("note_no").alias("slice_no"), (3 + (F.col("note_no") * 7 % 200) / 10).alias("length"))
    return rounded(dataset.cut_fixed(t))


@Q.add("v9_slice_on_silence")
def v9(spark, sf_dir):
    s = keyed(samples(spark, sf_dir))
    t = s.select("clip", F.col("pos").alias("hop"), (F.abs("x") * F.when(F.pmod(F.floor(F.col("pos") / 9), F.lit(3)) == 1, 0.01).otherwise(1.0)).alias("rms"), F.lit(100_000).alias("n_samples"))
    return unkeyed(dataset.slice_on_silence(t, 0.02, 10, 5, 3))


@Q.add(
    "x3_protect_mix",
    """WITH w AS (SELECT vec_id, embedding AS a, list_reverse(embedding) AS o, CASE WHEN vec_id % 3 = 0 THEN 1.0::DOUBLE ELSE 0.33::DOUBLE END AS w FROM embeddings)
    SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: abs(a[i] * w + o[i] * (1 - w)))), 3) AS total FROM w""",
)
def x3(spark, sf_dir):
    t = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("feats"), F.reverse("embedding").cast("array<double>").alias("orig"), F.when(F.col("vec_id") % 3 == 0, 220.0).otherwise(0.0).alias("pitch"))
    t = dataset.protect_mix(t, "feats", "orig", "pitch", 0.33)
    return t.select("vec_id", F.round(F.aggregate("feats", F.lit(0.0), lambda a, x: a + F.abs(x)), 3).alias("total"))


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"), F.col("label").alias("speaker"))


D2 = "list_sum(list_transform(range(1, 65), lambda i: pow(CAST(a.embedding[i] AS DOUBLE) - b.embedding[i], 2)))"


@Q.add(
    "j11_nearest_vectors",
    f"""WITH d AS (SELECT a.vec_id AS q, b.vec_id, {D2} AS d2 FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d2, vec_id) AS rank FROM d) SELECT q, vec_id, round(d2, 4) + 0.0 AS d2, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 8""",
)
def j11(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return rounded(vectors.nearest_vectors(v.filter("vec_id % 50 = 0"), v))


@Q.add("m5_build_ivf")
def m5(spark, sf_dir):
    """The branch and cell of every vector in its speaker's stored index."""
    return vectors.build_index(_vectors(spark, sf_dir), shared_folder(spark)).postings.select("speaker", "vec_id", "branch", "cell")


@Q.add("m4_compress_features")
def m4(spark, sf_dir):
    """Speakers of more than 45 vectors are told by 10 centres."""
    t = vectors.compress_features(_vectors(spark, sf_dir), shared_folder(spark), above=45, to=10, batch=50, batches=4)
    return rounded(t.select("speaker", "vec_id", F.size("vec").alias("d"), F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x).alias("length")))


@Q.add("j12_ivf_search")
def j12(spark, sf_dir):
    """Each fiftieth vector in its own speaker's index, stored and opened again, with as many probes as the recall takes."""
    v, path = _vectors(spark, sf_dir), shared_folder(spark)
    vectors.build_index(v, path)
    index, q = vectors.open_index(spark, path, "long", "array<float>"), v.filter("vec_id % 50 = 0")
    nprobe, nbranch = vectors.choose_probes(q, index)
    return rounded(vectors.ivf_search(q, index, 8, nprobe, nbranch))


@Q.add(
    "j12_search_every_cell",
    f"""WITH d AS (SELECT a.label AS speaker, a.vec_id AS q, b.vec_id, {D2} AS d2 FROM embeddings a JOIN embeddings b ON a.label = b.label), r AS (SELECT *, row_number() OVER (PARTITION BY speaker, q ORDER BY d2, vec_id) AS rank FROM d) SELECT speaker, q, vec_id, round(d2, 4) + 0.0 AS d2, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 8""",
)
def j12_every(spark, sf_dir):
    """All vectors, in all cells of their speakers' stored indexes: the exact neighbours, in whatever cells they are."""
    v = _vectors(spark, sf_dir)
    index = vectors.build_index(v, shared_folder(spark), cells=5)
    return rounded(vectors.ivf_search(v, index, 8, 5, 1))


@Q.add(
    "l2_knn_blend",
    f"""WITH d AS (SELECT a.vec_id AS q, b.vec_id, {D2} AS d2 FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d2, vec_id) AS rank FROM d), t AS (SELECT q, vec_id, pow(1 / d2, 2) AS w FROM r WHERE rank <= 8),
    m AS (SELECT t.q, i, sum(t.w * e.embedding[i]) / sum(t.w) AS m FROM t JOIN embeddings e ON e.vec_id = t.vec_id, range(1, 65) AS g(i) GROUP BY ALL) SELECT m.q, round(sum(abs(0.75 * m.m + 0.25 * o.embedding[i])), 3) AS total FROM m JOIN embeddings o ON o.vec_id = m.q GROUP BY m.q""",
)
def l2(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    q = v.filter("vec_id % 50 = 0")
    out = vectors.knn_blend(vectors.nearest_vectors(q, v, 8, without_own=True), v, q, 0.75)
    return out.select("q", F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + F.abs(x)), 3).alias("total"))
