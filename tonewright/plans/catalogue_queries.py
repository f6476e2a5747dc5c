"""Queries over the catalogue: names, paths, search, merging and manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import catalogue
from .catalog import Catalog
from .source_queries import shared_folder, written
from .testbed import FOLDERS, folders, table

Q = Catalog()


@Q.add(
    "p10_split_filename",
    """WITH s AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_brand || ' - ' || p_name ELSE p_name END AS s FROM part)
    SELECT p_partkey, CASE WHEN instr(s, ' - ') > 0 THEN trim(substr(s, instr(s, ' - ') + 3)) ELSE s END AS title, CASE WHEN instr(s, ' - ') > 0 THEN trim(substr(s, 1, instr(s, ' - ') - 1)) ELSE '' END AS artist FROM s""",
)
def p10(spark, sf_dir):
    s = F.when(F.col("p_partkey") % 2 == 0, F.concat_ws(" - ", "p_brand", "p_name")).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", s.alias("s")).withColumn("x", text.split_filename("s")).select("p_partkey", "x.title", "x.artist")


@Q.add(
    "p11_safe_name",
    r"""SELECT doc_id, coalesce(nullif(substr(trim(regexp_replace(text, '[^\p{L}\p{M}\p{N}_\-.,''()& ]', '_', 'g'), ' .'), 1, 120), ''), 'song') AS name FROM documents""",
)
def p11(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.safe_name("text").alias("name"))


@Q.add("p12_fill_display", "SELECT p_partkey, coalesce(nullif(CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name END, ''), nullif(CASE WHEN p_partkey % 2 = 0 THEN p_brand END, ''), p_type) AS title FROM part")
def p12(spark, sf_dir):
    given = F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.col("p_name"))
    tag = F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", text.fill(given, tag, "p_type").alias("title"))


@Q.add(
    "p13_search_results",
    """SELECT event_id, event_type AS title, 'u' || user_id AS artist, 'art/300x300.jpg' AS artwork, CASE WHEN event_id % 3 = 0 THEN 'b.MP3' ELSE 'a.mp3' END AS mp3 FROM events WHERE event_id % 2 = 0 AND event_id % 5 <> 0""",
)
def p13(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    feed = F.to_json(F.struct(F.array(F.struct(
        F.col("event_type").alias("trackName"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("artistName"), F.lit("art/100x100.jpg").alias("artworkUrl100"),
        F.when(F.col("event_id") % 2 == 0, "p").otherwise("").alias("previewUrl"),
    )).alias("results")))
    names = F.when(F.col("event_id") % 5 == 0, F.array(F.lit("x.wav"))).when(F.col("event_id") % 3 == 0, F.array(F.lit("x.wav"), F.lit("b.MP3"))).otherwise(F.array(F.lit("a.mp3")))
    free = F.to_json(F.array(F.struct(F.col("event_type").alias("upload_name"), F.transform(names, lambda n: F.struct(n.alias("download_url"))).alias("files"))))
    t = e.select("event_id", F.inline(text.preview_results(feed)), free.alias("free"))
    return t.select("event_id", "title", "artist", "artwork", F.inline(F.transform(text.free_results("free"), lambda x: F.struct(x["url"].alias("mp3")))))


@Q.add(
    "f1_wanted_path",
    r"""WITH p AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN '/m/.hidden/' WHEN 1 THEN '/m/venv/' WHEN 2 THEN '/m/vocals.mp3' WHEN 3 THEN '/m/song' || page_id || '.MP3' WHEN 4 THEN '/root/app/x.wav' ELSE '/m/a (karaoke).ogg' END AS h FROM pages),
    q AS (SELECT page_id, CASE WHEN page_id % 6 < 2 THEN h || 'x.mp3' ELSE h END AS path FROM p) SELECT page_id, path, page_id % 6 = 3 AS wanted FROM q""",
)
def f1(spark, sf_dir):
    k = F.col("page_id") % 6
    path = (
        F.when(k == 0, "/m/.hidden/x.mp3").when(k == 1, "/m/venv/x.mp3").when(k == 2, "/m/vocals.mp3").when(k == 3, F.concat(F.lit("/m/song"), F.col("page_id").cast("string"), F.lit(".MP3"))).when(k == 4, "/root/app/x.wav").otherwise("/m/a (karaoke).ogg")
    )
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path")).withColumn("wanted", text.wanted_path("path", "/root/app"))


@Q.add(
    "f2_allowed_url",
    r"""WITH u AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN replace(url, 'http://', 'https://') ELSE url END AS u FROM pages), h AS (SELECT *, regexp_extract(u, '^[a-z]+://([^/:?#]+)', 1) AS h FROM u)
    SELECT page_id, u AS url, u LIKE 'https://%' AND (h = 'example.com' OR h LIKE '%.example.com' OR h = 'example.org' OR h LIKE '%.example.org') AS allowed FROM h""",
)
def f2(spark, sf_dir):
    u = F.when(F.col("page_id") % 2 == 0, F.replace("url", F.lit("http://"), F.lit("https://"))).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", u.alias("url")).withColumn("allowed", text.allowed_url("url", ("example.com", "example.org")))


@Q.add("f3_duration_between", "SELECT o_orderkey FROM orders WHERE CAST(floor(o_totalprice / 100) AS INTEGER) BETWEEN 60 AND 1200")
def f3(spark, sf_dir):
    return table(spark, sf_dir, "orders").filter(F.floor(F.col("o_totalprice") / 100).between(60, 1200)).select("o_orderkey")


PARTS = "cat AS (SELECT p_partkey AS pos, p_name AS entry, p_brand AS alias, p_type AS primary_category, CASE WHEN p_size % 2 = 0 THEN 'big' ELSE 'small' END AS secondary_category, p_size > 10 AS supported FROM part)"


def _catalog(spark, sf_dir):
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("pos"), F.col("p_name").alias("entry"), F.array(F.upper("p_brand"), F.concat(F.lit(" "), F.lower("p_type"))).alias("aliases"),
        F.col("p_type").alias("primary_category"), F.when(size % 2 == 0, "big").otherwise("small").alias("secondary_category"), (size > 10).alias("supported"),
    )


@Q.add("f9_catalog_filter", f"WITH {PARTS} SELECT pos, entry FROM cat WHERE lower(primary_category || '/' || secondary_category) = 'economy/big' AND supported ORDER BY pos")
def f9(spark, sf_dir):
    return catalogue.catalog_filter(_catalog(spark, sf_dir), "ECONOMY/big", True).select("pos", "entry")


@Q.add(
    "j15_resolve_alias",
    f"""WITH {PARTS}, k AS (SELECT pos, entry, lower(trim(entry)) AS k FROM cat UNION ALL SELECT pos, entry, lower(alias) FROM cat UNION ALL SELECT pos, entry, lower(trim(primary_category)) FROM cat),
    f AS (SELECT k, arg_min(entry, pos) AS entry FROM k GROUP BY k) SELECT p.p_partkey, p.name, f.entry FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '  ' || p_brand ELSE 'none' || p_name END AS name FROM part) p LEFT JOIN f ON f.k = lower(trim(p.name))""",
)
def j15(spark, sf_dir):
    names = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("  "), F.col("p_brand"))).otherwise(F.concat(F.lit("none"), F.col("p_name"))).alias("name"))
    return catalogue.resolve_alias(names, _catalog(spark, sf_dir))


INDEX = """c AS (SELECT p_partkey AS mtime, p_size % 2 AS root_rank, p_size % 4 AS sid, CASE WHEN p_partkey % 7 = 0 THEN 'trained_' ELSE '' END || replace(p_name, ' ', '_') || CASE p_size % 3 WHEN 0 THEN '_added_ivf' WHEN 1 THEN '_x' ELSE '_red_v1' END
  || CASE WHEN p_size % 4 > 0 THEN '_spkid' || (p_size % 4) ELSE '' END AS stem FROM part)"""


@Q.add(
    "j14_choose_index",
    f"""WITH {INDEX}, m AS (SELECT *, '/i/' || mtime || '/' || stem || '.index' AS path, starts_with(stem, 'red_widget_added_') OR contains(stem, '_red_widget_v1') OR contains(stem, '_red_widget_v2') AS std FROM c WHERE NOT contains(stem, 'trained') AND sid IN (0, 2))
    SELECT path FROM m WHERE std OR contains(stem, 'red_widget') ORDER BY CASE WHEN sid = 2 THEN 0 ELSE 1 END, CASE WHEN std THEN 0 ELSE 1 END, root_rank, -mtime, lower(path) LIMIT 1""",
)
def j14(spark, sf_dir):
    size = F.col("p_size")
    stem = F.concat(
        F.when(F.col("p_partkey") % 7 == 0, "trained_").otherwise(""), F.replace("p_name", F.lit(" "), F.lit("_")), F.when(size % 3 == 0, "_added_ivf").when(size % 3 == 1, "_x").otherwise("_red_v1"),
        F.when(size % 4 > 0, F.concat(F.lit("_spkid"), (size % 4).cast("string"))).otherwise(""),
    )
    t = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("mtime"), (size % 2).alias("root_rank"), F.concat(stem, F.lit(".index")).alias("name"))
    t = t.withColumn("path", F.concat(F.lit("/i/"), F.col("mtime").cast("string"), F.lit("/"), F.col("name")))
    return catalogue.choose_index(t, "models/red_widget.pth", 2)


SONGS = """songs AS (SELECT doc_id AS path, coalesce('Take ' || substr(md5(text), 1, 2), '?') AS title, source AS artist, lang AS album, CASE WHEN n_chars % 5 = 0 THEN NULL ELSE n_chars % 3 END AS duration,
  CASE WHEN doc_id % 4 = 0 THEN '~/Music/a' ELSE '~/Downloads' END AS "where", CAST(doc_id * 7919 % 1000 + 1000 AS VARCHAR) AS added, 'stem' || doc_id % 10 AS stem FROM documents)"""


def _songs(spark, sf_dir):
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        d.alias("path"), F.coalesce(F.concat(F.lit("Take "), F.substring(F.md5("text"), 1, 2)), F.lit("?")).alias("title"), F.col("source").alias("artist"), F.col("lang").alias("album"),
        F.when(F.col("n_chars") % 5 == 0, None).otherwise(F.col("n_chars") % 3).alias("duration"), F.when(d % 4 == 0, "~/Music/a").otherwise("~/Downloads").alias("where"),
        (d * 7919 % 1000 + 1000).cast("string").alias("added"), F.concat(F.lit("stem"), (d % 10).cast("string")).alias("stem"),
    )


@Q.add(
    "w14_dedupe_songs",
    f"""WITH {SONGS} SELECT path, title, artist, duration FROM (SELECT *, row_number() OVER (PARTITION BY lower(title), lower(artist), duration ORDER BY "where" LIKE '~/Music%' DESC, added DESC, path DESC) AS k FROM songs) WHERE k = 1""",
)
def w14(spark, sf_dir):
    return catalogue.dedupe_songs(_songs(spark, sf_dir)).select("path", "title", "artist", "duration")


@Q.add(
    "l1_browse",
    f"""WITH {SONGS}, h AS (SELECT path, title, added, CASE WHEN contains(lower(title || ' ' || artist), 'src1') AND contains(lower(title || ' ' || artist), 'e') THEN 0 ELSE 1 END AS rank FROM songs
      WHERE contains(lower(title || ' ' || artist || ' ' || album || ' ' || stem), 'src1') AND contains(lower(title || ' ' || artist || ' ' || album || ' ' || stem), 'e'))
    SELECT path, title, rank, (SELECT count(*) FROM h) AS total FROM h ORDER BY rank, added DESC, path LIMIT 400""",
)
def l1(spark, sf_dir):
    page, total = catalogue.browse(_songs(spark, sf_dir), "SRC1 e")
    return page.select("path", "title", "rank").crossJoin(F.broadcast(total))


@Q.add(
    "l1_browse_indexed",
    f"""WITH {SONGS}, h AS (SELECT path, title, added, CASE WHEN contains(lower(title || ' ' || artist), 'src1') AND contains(lower(title || ' ' || artist), 'tem3') THEN 0 ELSE 1 END AS rank FROM songs
      WHERE contains(lower(title || ' ' || artist || ' ' || album || ' ' || stem), 'src1') AND contains(lower(title || ' ' || artist || ' ' || album || ' ' || stem), 'tem3'))
    SELECT path, title, rank, (SELECT count(*) FROM h) AS total FROM h ORDER BY rank, added DESC, path LIMIT 400""",
)
def l1_indexed(spark, sf_dir):
    """Through a stored index of trigrams."""
    s, path = _songs(spark, sf_dir), shared_folder(spark)
    catalogue.build_trigrams(s, path)
    page, total = catalogue.browse_indexed(s, spark.read.schema("gram string, key long").parquet(path), "SRC1 tem3")
    return page.select("path", "title", "rank").crossJoin(F.broadcast(total))


@Q.add(
    "u1_list_sources",
    """SELECT stem, arg_max(path, (r, path)) AS path FROM (SELECT 's' || c_custkey % 300 AS stem, 'songs/' || c_name AS path, 0 AS r FROM customer UNION ALL SELECT 's' || s_suppkey * 5, s_name, -1 FROM supplier) GROUP BY stem""",
)
def u1(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("s"), (F.col("c_custkey") % 300).cast("string")).alias("stem"), F.concat(F.lit("songs/"), F.col("c_name")).alias("path"))
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), (F.col("s_suppkey") * 5).cast("string")).alias("stem"), F.col("s_name").alias("path"))
    return catalogue.priority_union(c, s)


@Q.add("u4_union_feeds", f"WITH {SONGS} SELECT 'library' AS feed, title, artist FROM songs WHERE album = 'en' UNION ALL SELECT 'previews', title, artist FROM songs WHERE album = 'de' UNION ALL SELECT 'free', title, NULL FROM songs WHERE album = 'fr'")
def u4(spark, sf_dir):
    """Three feeds, and a fourth that isn't there."""
    s = _songs(spark, sf_dir)
    pick = lambda lang, *cols: lambda q: s.filter(F.col("album") == lang).select(*cols)
    broken = lambda q: table(spark, sf_dir, "no_such_feed")
    out, _ = catalogue.union_feeds("ab", lambda t: written(spark, t), library=pick("en", "title", "artist"), broken=broken, previews=pick("de", "title", "artist"), free=pick("fr", "title"))
    return out.select("feed", "title", "artist")


U6 = "CASE WHEN doc_id % 5 = 0 THEN source || '_2' WHEN doc_id % 11 = 0 THEN source || '_4' ELSE source END"


@Q.add(
    "u6_unique_names",
    f"""WITH s AS (SELECT doc_id, {U6} AS stem FROM documents), o AS (SELECT DISTINCT stem FROM s), k AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY doc_id) - 1 AS k FROM s),
    free AS (SELECT st.stem, n, row_number() OVER (PARTITION BY st.stem ORDER BY n) AS r FROM o st, range(2, 3000) AS t(n) WHERE st.stem || '_' || n NOT IN (SELECT stem FROM o))
    SELECT k.doc_id, CASE WHEN k.k = 0 THEN k.stem ELSE k.stem || '_' || f.n END AS name FROM k LEFT JOIN free f ON f.stem = k.stem AND f.r = k.k""",
)
def u6(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("doc_id", F.expr(U6).alias("stem"))
    return catalogue.unique_names(t, "doc_id").select("doc_id", "name")


@Q.add("j3_missing_outputs", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j3(spark, sf_dir):
    return catalogue.missing_outputs(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@Q.add(
    "j4_stale_outputs",
    """SELECT o_orderkey, coalesce(o_orderdate >= m, true) AS fresh FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS m FROM lineitem GROUP BY l_orderkey) l ON l_orderkey = o_orderkey""",
)
def j4(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").alias("mtime"))
    s = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_shipdate").alias("mtime"))
    return catalogue.stale_outputs(o, s, "o_orderkey").select("o_orderkey", "fresh")


@Q.add(
    "j5_song_listing",
    """WITH j AS (SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS state FROM orders GROUP BY o_custkey)
    SELECT c_custkey AS stem, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE c_name END AS title, CAST(c_nationkey AS VARCHAR) AS artist, c_custkey % 2 = 0 AS processed, c_custkey % 5 = 0 AS previewed, j.state
    FROM customer LEFT JOIN j ON j.o_custkey = c_custkey""",
)
def j5(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("stem", F.col("c_custkey"))
    sources = c.select("stem", F.create_map(F.lit("title"), F.col("c_name"), F.lit("artist"), F.col("c_nationkey").cast("string")).alias("fields"))
    meta = c.filter("stem % 3 = 0").select("stem", F.create_map(F.lit("title"), F.col("c_mktsegment")).alias("fields"))
    jobs = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("stem")).agg(F.max_by("o_orderstatus", "o_orderkey").alias("state"))
    t = catalogue.song_listing(sources, meta, c.filter("stem % 2 = 0"), c.filter("stem % 5 = 0"), jobs)
    return t.select("stem", F.col("fields")["title"].alias("title"), F.col("fields")["artist"].alias("artist"), "processed", "previewed", "state")


@Q.add(
    "j6_meta_upsert",
    """WITH o AS (SELECT c_custkey AS stem, 'title' AS field, c_name AS value FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT c_custkey AS stem, 'title' AS field, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_mktsegment END AS value FROM customer WHERE c_custkey % 3 <> 1)
    SELECT stem, field, value FROM (SELECT coalesce(o.stem, n.stem) AS stem, coalesce(o.field, n.field) AS field, coalesce(nullif(n.value, ''), o.value) AS value FROM o FULL JOIN n ON n.stem = o.stem AND n.field = o.field) WHERE value IS NOT NULL""",
)
def j6(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "stem").withColumn("field", F.lit("title"))
    old = c.filter("stem % 3 <> 0").select("stem", "field", F.col("c_name").alias("value"))
    new = c.filter("stem % 3 <> 1").select("stem", "field", F.when(F.col("stem") % 4 == 0, "").otherwise(F.col("c_mktsegment")).alias("value"))
    return catalogue.meta_upsert(old, new)


FILES = FOLDERS + """, files AS (SELECT *, folder || '/' || p_partkey || '.wav' AS path FROM folders WHERE regexp_matches(folder, '_[1-9][0-9]*_[1-4]$')),
good AS (SELECT * FROM (SELECT *, CAST(regexp_extract(folder, '_([0-9]+)_[0-9]+$', 1) AS INTEGER) AS sid, regexp_extract(folder, '^(.+)_[0-9]+_[0-9]+$', 1) AS nm FROM files) WHERE nm = 'red widget')"""


def _good_files(spark, sf_dir):
    t = folders(spark, sf_dir).filter(F.col("folder").rlike("_[1-9][0-9]*_[1-4]$") & F.col("folder").startswith("red widget_"))
    return t.withColumn("path", F.concat(F.col("folder"), F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".wav")))


X1 = FILES + """, num AS (SELECT *, CAST(row_number() OVER (ORDER BY folder, path) - 1 AS INTEGER) AS number FROM good),
ent AS (SELECT path, nm AS speaker_name, sid AS speaker_id, CAST(regexp_extract(folder, '_([0-9]+)$', 1) AS INTEGER) AS repeat, number, printf('ms%04d_s%03d_%s', number, sid, substr(sha1(path), 1, 10)) AS output_key FROM num)"""


@Q.add("x1_build_manifest", f"WITH {X1} SELECT * FROM ent")
def x1(spark, sf_dir):
    return catalogue.build_manifest(_good_files(spark, sf_dir)).select("path", "speaker_name", "speaker_id", "repeat", "number", "output_key")


@Q.add("a23_speaker_roster", f"WITH {X1} SELECT DISTINCT speaker_id, speaker_name FROM ent")
def a23(spark, sf_dir):
    return catalogue.speaker_roster(catalogue.build_manifest(_good_files(spark, sf_dir)))


X2 = """f AS (SELECT p_partkey AS row_no, p_name AS path, CASE WHEN p_partkey % 10 = 0 THEN '' ELSE p_brand END AS speaker_name, CASE WHEN p_partkey % 10 = 0 THEN '' WHEN p_partkey % 4 = 0 THEN p_size || '.0' WHEN p_partkey % 9 = 0 THEN 'x' ELSE CAST(p_size * 3 AS VARCHAR) END AS speaker_id,
  CASE WHEN p_partkey % 10 = 0 THEN '' ELSE CAST(p_partkey % 5 AS VARCHAR) END AS repeat, p_partkey % 10 = 0 AS blank FROM part)"""


def _form(spark, sf_dir):
    k = F.col("p_partkey")
    blank = k % 10 == 0
    sid = F.when(blank, "").when(k % 4 == 0, F.concat(F.col("p_size").cast("string"), F.lit(".0"))).when(k % 9 == 0, "x").otherwise((F.col("p_size") * 3).cast("string"))
    return table(spark, sf_dir, "part").select(
        k.alias("row_no"), F.when(blank, "").otherwise(F.col("p_name")).alias("path"), F.when(blank, "").otherwise(F.col("p_brand")).alias("speaker_name"), sid.alias("speaker_id"), F.when(blank, "").otherwise((k % 5).cast("string")).alias("repeat")
    )


@Q.add(
    "x2_validate_manifest_rows",
    f"""WITH {X2}, c AS (SELECT *, TRY_CAST(TRY_CAST(speaker_id AS DOUBLE) AS INTEGER) AS sid, TRY_CAST(repeat AS INTEGER) AS rep FROM f WHERE NOT blank),
    g AS (SELECT *, coalesce(sid BETWEEN 0 AND 109 AND rep >= 1, false) AS good FROM c), n AS (SELECT sid, arg_min(speaker_name, row_no) AS nm FROM g WHERE good GROUP BY sid)
    SELECT row_no, CASE WHEN good AND speaker_name = nm THEN g.sid END AS speaker_id FROM g LEFT JOIN n ON n.sid = g.sid""",
)
def x2(spark, sf_dir):
    valid, bad = catalogue.validate_manifest_rows(_form(spark, sf_dir))
    return valid.select("row_no", "speaker_id").unionByName(bad.select("row_no", F.lit(None).cast("int").alias("speaker_id")))


@Q.add(
    "a14_job_summary",
    """WITH e AS (SELECT user_id, event_id, event_type <> 'error' AS ok, 'e' || event_id AS message FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, ok ORDER BY event_id DESC) AS r FROM e)
    SELECT user_id, count(*) AS total, count(*) FILTER (ok) AS success, count(*) FILTER (NOT ok) AS failed, CASE WHEN count(*) FILTER (NOT ok) = 0 THEN 'done' WHEN count(*) FILTER (ok) = 0 THEN 'error' ELSE 'partial' END AS state,
    list(message ORDER BY event_id) FILTER (NOT ok AND r <= 10) AS last_failures FROM r GROUP BY user_id""",
)
def a14(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_type") != "error").alias("ok"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("message"))
    return catalogue.job_summary(e, "user_id", "event_id")
