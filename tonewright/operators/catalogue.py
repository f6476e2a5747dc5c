"""A song catalogue and speaker manifests as tables: duplicates, search, merging, names, job states."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import ordered_places, slot_places

#: Speaker ids that a manifest may have.
SPEAKER_IDS = (0, 109)


def dedupe_songs(songs: DataFrame, id_col: str = "path") -> DataFrame:
    """One row of each (title, artist, duration), case ignored and null durations equal: files under ~/Music first, then
    the latest added. The best row comes from an aggregate, so a title of any number of copies is no hot window."""
    title, artist = F.lower("title"), F.lower("artist")
    rank = F.struct(F.col("where").startswith("~/Music").alias("m"), F.coalesce("added", F.lit("")).alias("a"), F.col(id_col).alias("id"))
    best = songs.select(title.alias("_t"), artist.alias("_a"), F.col("duration").alias("_d"), rank.alias("_k"), F.struct("*").alias("_row"))
    return best.groupBy("_t", "_a", "_d").agg(F.max_by("_row", "_k").alias("_row")).select("_row.*")


def hits(songs: DataFrame, query: str, always: Sequence[str] = ("title", "artist"), more: Sequence[str] = ("album", "stem")) -> DataFrame:
    """Songs in which every word of the query occurs, with rank 0 if all are in title and artist alone, else 1."""
    words = query.lower().split()
    near = F.lower(F.concat_ws(" ", *always))
    hay = F.lower(F.concat_ws(" ", *always, *more))
    all_in = lambda text: F.lit(True) if not words else _all([text.contains(w) for w in words])
    return songs.filter(all_in(hay)).withColumn("rank", F.when(all_in(near), 0).otherwise(1))


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def browse(songs: DataFrame, query: str, limit: int = 400, recent: str = "added", tie: str = "path") -> tuple[DataFrame, DataFrame]:
    """The first page in order of rank and recency, and the number of all hits as a table of one row."""
    found = hits(songs, query)
    return found.orderBy("rank", F.col(recent).desc(), tie).limit(limit), found.agg(F.count("*").alias("total"))


def build_trigrams(songs: DataFrame, path: str, key: str = "path", text: Sequence[str] = ("title", "artist", "album", "stem")) -> None:
    """Stores a row (gram, key) for every three characters that a song's text has, in order of gram: a search for some reads the
    parts of files that have them. A gram of most songs is in many files."""
    hay = F.lower(F.concat_ws(" ", *text))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(hay) - 2, F.lit(1))), lambda i: F.substr(hay, i, F.lit(3))))
    t = songs.select(F.explode(grams).alias("gram"), F.col(key).alias("key")).filter(F.length("gram") == 3)
    t.repartitionByRange("gram", "key").sortWithinPartitions("gram", "key").write.parquet(path)


def candidates(index: DataFrame, query: str) -> DataFrame | None:
    """Keys of the songs that have all trigrams of the query's words, from an index of build_trigrams(); None if the words are too
    short to have any."""
    grams = sorted({w[i : i + 3] for w in query.lower().split() for i in range(len(w) - 2)})
    if not grams:
        return None
    return index.filter(F.col("gram").isin(grams)).groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") == len(grams)).select("key")


def browse_indexed(songs: DataFrame, index: DataFrame, query: str, limit: int = 400, key: str = "path", **how) -> tuple[DataFrame, DataFrame]:
    """As browse(), which then looks at the songs alone that the index has for the query's words."""
    found = candidates(index, query)
    some = songs if found is None else songs.join(found.withColumnRenamed("key", key), key, "left_semi")
    return browse(some, query, limit, tie=key, **how)


def priority_union(*sources: DataFrame, key: str = "stem", value: str = "path") -> DataFrame:
    """One value for each key: earlier sources win, inside one the last value in order wins."""
    both = None
    for rank, s in enumerate(sources):
        t = s.select(key, value, F.lit(-rank).alias("_rank"))
        both = t if both is None else both.unionByName(t)
    return both.groupBy(key).agg(F.max_by(value, F.struct("_rank", value)).alias(value))


def union_feeds(query: str, store, **feeds) -> tuple[DataFrame, list[str]]:
    """The feeds one after another, each row with the name of its feed, and the names of those that failed; nothing for queries
    under two characters. A feed is a table or a function of the query that gives one. It's read by store(table), which
    writes it and reads it back, so a feed that fails, even while it's read, is an empty feed and the others come through."""
    out, failed = None, []
    for name, feed in feeds.items():
        try:
            t = store(feed(query) if callable(feed) else feed).withColumn("feed", F.lit(name))
        except Exception:  # offline, limited, an unknown format: the search goes on without it
            failed.append(name)
            continue
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    if out is not None and len(query.strip()) < 2:
        out = out.limit(0)
    return out, failed


def unique_names(stems: DataFrame, order: str, stem: str = "stem", block: int = 1024) -> DataFrame:
    """name: the first of equal stems keeps it, later ones get _2, _3 and so on, skipping names that are stems already; a null stem
    keeps none. Equal stems are numbered in ranges of order. The numbers that are taken are looked up by equal keys: a copy needs
    those of its own block of numbers, at most block, and how many come in the blocks before."""
    t = ordered_places(stems, order, name="_k", by=(stem,))
    base, number = F.regexp_extract(stem, r"^(.*)_([1-9]\d*)$", 1), F.regexp_extract(stem, r"^(.*)_([1-9]\d{0,8})$", 2)
    taken = stems.select(base.alias("_b"), number.try_cast("int").alias("_n")).filter("_n >= 2").distinct()
    taken = slot_places(taken.withColumn("_s", F.floor(F.col("_n") / block)), "_s", "_n", by=("_b",), name="_j")
    # Without the taken numbers below it, one stands at _n - _j: a copy passes all that stand at its own number or before.
    at = (F.col("_n") - F.col("_j")).alias("_at")
    steps = taken.groupBy("_b", at).agg(F.count("*").alias("_many")).groupBy("_b", F.floor(F.col("_at") / block).alias("_s")).agg(F.collect_list(F.struct("_at", "_many")).alias("_in"), F.sum("_many").alias("_sum"))
    t = t.withColumns({"_v": F.col("_k") + 1, "_s": F.floor((F.col("_k") + 1) / block)})
    both = t.filter("_k > 0").select(F.col(stem).alias("_b"), "_s").distinct().join(steps, ["_b", "_s"], "full_outer")
    before = F.sum("_sum").over(Window.partitionBy("_b").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1))  # a row a block
    both = both.select("_b", F.col("_s").alias("_block"), F.coalesce(before, F.lit(0)).alias("_before"), "_in")
    t = t.join(both, (F.col(stem) == F.col("_b")) & (F.col("_s") == F.col("_block")), "left")
    inside = F.aggregate(F.coalesce("_in", F.array().cast("array<struct<_at:bigint,_many:bigint>>")), F.lit(0).cast("long"), lambda n, x: n + F.when(x["_at"] <= F.col("_v"), x["_many"]).otherwise(0))
    free = F.col("_v") + F.col("_before") + inside
    return t.withColumn("name", F.when(F.col("_k") == 0, F.col(stem)).otherwise(F.concat(stem, F.lit("_"), free.cast("string")))).select(*stems.columns, "name")


def missing_outputs(inputs: DataFrame, outputs: DataFrame, key: str) -> DataFrame:
    return inputs.join(outputs.select(key).distinct(), key, "left_anti")


def stale_outputs(targets: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """Targets (key, mtime) with fresh: made, and not before any of their sources (key, mtime) changed."""
    last = sources.groupBy(key).agg(F.max("mtime").alias("_last"))
    t = targets.join(last, key, "left")
    return t.withColumn("fresh", F.col("mtime").isNotNull() & (F.col("_last").isNull() | (F.col("mtime") >= F.col("_last")))).drop("_last")


def song_listing(sources: DataFrame, meta: DataFrame, done: DataFrame, preview: DataFrame, jobs: DataFrame) -> DataFrame:
    """Every source (stem, fields map) with its overlaid fields, whether it's processed or has a preview, and its job."""
    flag = lambda t, name: t.select("stem").distinct().withColumn(name, F.lit(True))
    t = sources.join(meta.withColumnRenamed("fields", "_over"), "stem", "left")
    t = t.join(flag(done, "processed"), "stem", "left").join(flag(preview, "previewed"), "stem", "left").join(jobs.select("stem", "state"), "stem", "left")
    over = F.coalesce("_over", F.create_map().cast("map<string,string>"))
    kept = F.map_filter("fields", lambda k, v: ~F.map_contains_key(over, k))
    return t.select("stem", F.map_concat(kept, over).alias("fields"), F.coalesce("processed", F.lit(False)).alias("processed"), F.coalesce("previewed", F.lit(False)).alias("previewed"), "state")


def meta_upsert(old: DataFrame, new: DataFrame, keys: Sequence[str] = ("stem", "field")) -> DataFrame:
    """Rows of both; a new value replaces an old one only if it's neither null nor empty."""
    o, n = old.withColumnRenamed("value", "_old"), new.withColumnRenamed("value", "_new")
    t = o.join(n, list(keys), "full_outer")
    return t.select(*keys, F.coalesce(F.nullif("_new", F.lit("")), "_old").alias("value")).filter("value is not null")


def choose_index(candidates: DataFrame, model: str, speaker: int | None) -> DataFrame:
    """The best index file (path, name, root_rank, mtime) for a model: not a half-trained one, of the speaker or of none."""
    import re

    stem = re.sub(r"\.[^.]*$", "", model.rsplit("/", 1)[-1]).lower()
    experiment = re.sub(r"_e\d+_s\d+$", "", stem)
    name = F.lower(F.regexp_replace("name", r"\.[^.]*$", ""))
    sid = F.regexp_extract(name, r"_spkid(\d+)$", 1)
    sid = F.when(sid != "", sid.cast("int"))
    t = candidates.filter(F.lower("name").endswith(".index") & ~F.lower("name").contains("trained")).withColumns({"_sid": sid, "_name": name})
    t = t.filter(F.col("_sid").isNull() if speaker is None else F.col("_sid").isNull() | (F.col("_sid") == speaker))
    standard = F.col("_name").startswith(experiment + "_added_") | F.col("_name").contains(f"_{experiment}_v1") | F.col("_name").contains(f"_{experiment}_v2")
    t = t.withColumn("_std", standard).filter(F.col("_std") | F.col("_name").contains(stem))
    same = F.col("_sid").eqNullSafe(F.lit(speaker).cast("int"))
    score = F.struct((~same).cast("int"), (~F.col("_std")).cast("int"), F.col("root_rank"), -F.col("mtime"), F.lower("path"))
    return t.agg(F.min_by("path", score).alias("path"))


def resolve_alias(names: DataFrame, catalog: DataFrame) -> DataFrame:
    """names (name) with the entry of the catalogue (pos, entry, aliases) they mean; the first entry of equal keys wins."""
    norm = lambda c: F.lower(F.trim(c))
    stem = F.regexp_replace("entry", r"\.[^.]*$", "")
    keys = catalog.select("pos", "entry", F.explode(F.array_distinct(F.concat(F.array(norm(F.col("entry")), norm(stem)), F.transform("aliases", norm)))).alias("_key"))
    first = keys.groupBy("_key").agg(F.min_by("entry", "pos").alias("entry"))
    return names.withColumn("_key", norm(F.col("name"))).join(first, "_key", "left").drop("_key")


def catalog_filter(catalog: DataFrame, category: str | None = None, supported: bool | None = None) -> DataFrame:
    """Entries of a category (primary, secondary or both as a path) in catalogue order."""
    t = catalog
    if category:
        want = category.strip().lower()
        both = F.concat_ws("/", "primary_category", "secondary_category")
        t = t.filter((F.lower("primary_category") == want) | (F.lower("secondary_category") == want) | (F.lower(both) == want))
    if supported is not None:
        t = t.filter(F.col("supported") == supported)
    return t.orderBy("pos")


def build_manifest(files: DataFrame) -> DataFrame:
    """Entries of files (folder, path) in folders named speaker_id_repeat. An invalid folder or a second name for an id
    fails the whole job. Running numbers are made in two steps: within a folder and from the folders before it."""
    parts = lambda k: F.regexp_extract("folder", r"^(.+)_(\d+)_(\d+)$", k)
    t = files.withColumns({"speaker_name": parts(1), "_id": parts(2), "_rep": parts(3)})
    sid, rep = F.expr("try_cast(_id AS int)"), F.expr("try_cast(_rep AS int)")
    t = t.withColumns({"speaker_id": sid, "repeat": rep})
    good = F.coalesce((F.col("speaker_name") != "") & ~F.col("speaker_name").rlike(r"[|\r\n]") & F.col("speaker_id").between(*SPEAKER_IDS) & (F.col("repeat") >= 1), F.lit(False))
    names = t.groupBy("speaker_id").agg(F.min("speaker_name").alias("_a"), F.max("speaker_name").alias("_z"))
    one = F.broadcast(names.select("speaker_id", (F.col("_a") == F.col("_z")).alias("_one")))  # at most 110 ids are valid
    t = t.join(one, "speaker_id", "left").withColumn("path", F.when(good & F.coalesce("_one", F.lit(False)), F.col("path")).otherwise(F.raise_error(F.concat(F.lit("invalid folder "), F.col("folder")))))
    return _numbered(t).drop("_id", "_rep", "_one")


def _numbered(t: DataFrame) -> DataFrame:
    counts = t.groupBy("folder").agg(F.count("*").alias("_n"))
    upto = Window.partitionBy(F.lit(0)).orderBy("folder").rowsBetween(Window.unboundedPreceding, -1)  # one row a folder
    counts = counts.select("folder", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_base"))
    n = F.row_number().over(Window.partitionBy("folder").orderBy("path")) - 1 + F.col("_base")
    t = t.join(counts, "folder").withColumn("number", n.cast("int")).drop("_base")
    return t.withColumn("output_key", F.format_string("ms%04d_s%03d_%s", "number", "speaker_id", F.substring(F.sha1("path"), 1, 10)))


def validate_manifest_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows and the numbers of bad ones from form rows (row_no, path, speaker_name, speaker_id, repeat), all text.
    Blank rows are skipped; whole numbers may be written 3 or 3.0; an id keeps its first valid name."""
    cols = ("path", "speaker_name", "speaker_id", "repeat")
    t = rows.select("row_no", *[F.trim(F.coalesce(c, F.lit(""))).alias(c) for c in cols])
    t = t.filter(F.length(F.concat(*cols)) > 0)
    whole = lambda c: F.when(F.col(c).rlike(r"^(0|-?[1-9]\d{0,8})(\.0)?$"), F.expr(f"try_cast(try_cast({c} AS double) AS int)"))
    t = t.withColumns({"_sid": whole("speaker_id"), "_rep": whole("repeat")})
    good = F.col("_sid").between(*SPEAKER_IDS) & (F.col("_rep") >= 1) & (F.col("speaker_name") != "") & ~F.col("speaker_name").rlike(r"[|\r\n]") & (F.col("path") != "")
    t = t.withColumn("_good", F.coalesce(good, F.lit(False)))
    first = t.filter("_good").groupBy("_sid").agg(F.min_by("speaker_name", "row_no").alias("_name"))
    t = t.join(F.broadcast(first), "_sid", "left").withColumn("_good", F.col("_good") & (F.col("speaker_name") == F.col("_name")))
    valid = t.filter("_good").select("row_no", "path", "speaker_name", F.col("_sid").alias("speaker_id"), F.col("_rep").alias("repeat"))
    return valid, t.filter("not _good").select("row_no")


def speaker_roster(entries: DataFrame) -> DataFrame:
    """Distinct (speaker_id, speaker_name) in order of id; fails if an id has two names or an output key occurs twice."""
    people = entries.groupBy("speaker_id").agg(F.min("speaker_name").alias("speaker_name"), F.max("speaker_name").alias("_z"))
    name = F.when(F.col("speaker_name") == F.col("_z"), F.col("speaker_name")).otherwise(F.raise_error(F.concat(F.lit("two names for speaker "), F.col("speaker_id").cast("string"))))
    twice = entries.groupBy("output_key").agg(F.count("*").alias("_k")).agg(F.coalesce(F.max("_k"), F.lit(0)).alias("_k"))
    people = people.crossJoin(F.broadcast(twice))  # one row
    return people.filter(F.when(F.col("_k") <= 1, True).otherwise(F.raise_error(F.lit("an output key occurs twice")))).select("speaker_id", name.alias("speaker_name")).orderBy("speaker_id")


def job_summary(results: DataFrame, by: str, order: str, keep: int = 10) -> DataFrame:
    """Per job the number of results, successes and failures, the state, and the last failures in order."""
    failed = ~F.col("ok")
    last = F.slice(F.reverse(F.array_sort(F.collect_list(F.when(failed, F.struct(order, "message"))))), 1, keep)
    # Only the failures that rank among the last of their job are collected.
    w = Window.partitionBy(by, "ok").orderBy(F.col(order).desc())
    late = results.withColumn("_r", F.row_number().over(w)).filter(failed & (F.col("_r") <= keep)).groupBy(by).agg(F.reverse(last).alias("_l"))
    t = results.groupBy(by).agg(F.count("*").alias("total"), F.count_if("ok").alias("success"), F.count_if(failed).alias("failed")).join(late, by, "left")
    state = F.when(F.col("failed") == 0, "done").when(F.col("success") == 0, "error").otherwise("partial")
    return t.select(by, "total", "success", "failed", state.alias("state"), F.transform("_l", lambda x: x["message"]).alias("last_failures"))
