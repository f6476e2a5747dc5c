"""Column functions for file names, paths, addresses and search feeds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .music import _c

#: Fixed values.
AUDIO_EXTENSIONS = (".mp3", ".wav", ".m4a", ".flac", ".ogg", ".aac", ".aif", ".aiff", ".opus")
SKIP_PARTS = ("/Library/", ".app/", "/node_modules/", "site-packages", "/.Trash/", "/venv/", "/.venv/", "/tests/", "/test/", "/fixtures/")
#: Fixed value: names of stems that separation tools leave behind, in any case.
LEFTOVER = (
    r"^(vocals?|instrumental|no[_ ]vocals|accompaniment|acapella|drums|bass|other|stems?|melody[_ ]notes|detected[_ ]melody|piano[_ ]preview\d*|piano|rmvpe[_ ]\w+)( ?\(\d+\))?$"
    r"|[_ -](vocals?|instrumental|no[_ ]vocals|accompaniment|acapella)( ?\(\d+\))?$"
    r"|\((instrumental|karaoke[^)]*)\)$"
)
PREVIEW_FEED = "results array<struct<trackName: string, artistName: string, collectionName: string, artworkUrl100: string, previewUrl: string, trackViewUrl: string>>"
FREE_FEED = "array<struct<upload_name: string, user_name: string, license_name: string, file_page_url: string, files: array<struct<download_url: string, file_format_info: struct<ps: string>>>>>"


def split_filename(stem) -> Column:
    """struct(title, artist) of "artist - title"; without a dash the whole stem is the title."""
    s = _c(stem)
    at = F.instr(s, " - ")
    title = F.when(at > 0, F.trim(F.substring(s, at + 3, F.length(s)))).otherwise(s)
    return F.struct(title.alias("title"), F.when(at > 0, F.trim(F.substring(s, F.lit(1), at - 1))).otherwise(F.lit("")).alias("artist"))


def safe_name(name, longest: int = 120) -> Column:
    """A file name: odd characters become underscores, blanks and dots at the ends go, never empty."""
    clean = F.regexp_replace(_c(name), r"(?U)[^\w\-.,'()& ]", "_")
    clean = F.substring(F.btrim(clean, F.lit(" .")), 1, longest)
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit("song"))


def fill(value, *others) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(_c(v), F.lit("")) for v in (value, *others)])


def preview_results(json) -> Column:
    """Items of a search feed that have a preview, with larger artwork."""
    items = F.from_json(_c(json), PREVIEW_FEED)["results"]
    return F.transform(
        F.filter(items, lambda x: x["previewUrl"].isNotNull() & (x["previewUrl"] != "")),
        lambda x: F.struct(
            x["trackName"].alias("title"), x["artistName"].alias("artist"), x["collectionName"].alias("album"),
            F.replace(x["artworkUrl100"], F.lit("100x100"), F.lit("300x300")).alias("artwork"), x["previewUrl"].alias("preview"),
        ),
    )


def free_results(json) -> Column:
    """Items of a free-music feed that have an MP3 file, with the first such file."""
    items = F.from_json(_c(json), FREE_FEED)
    mp3 = lambda x: F.get(F.filter(x["files"], lambda f: F.lower(f["download_url"]).endswith(".mp3")), F.lit(0))
    found = F.transform(items, lambda x: F.struct(x["upload_name"].alias("title"), x["user_name"].alias("artist"), mp3(x)["download_url"].alias("url"), mp3(x)["file_format_info"]["ps"].alias("length"), x["license_name"].alias("license")))
    return F.filter(found, lambda x: x["url"].isNotNull())


def wanted_path(path, root: str | None = None) -> Column:
    """Audio files outside skipped and hidden folders that aren't leftover stems."""
    p = _c(path)
    ok = F.lower(F.regexp_extract(p, r"\.[^./]+$", 0)).isin(*AUDIO_EXTENSIONS)
    for part in SKIP_PARTS:
        ok = ok & ~p.contains(part)
    ok = ok & ~F.exists(F.split(p, "/"), lambda x: x.startswith(".") & (F.length(x) > 1))
    stem = F.regexp_replace(F.regexp_extract(p, r"([^/]+)$", 1), r"\.[^.]*$", "")
    ok = ok & ~stem.rlike("(?i)" + LEFTOVER)
    return ok & ~p.startswith(root.rstrip("/") + "/") if root else ok


def allowed_url(url, hosts) -> Column:
    """https, and a host that is one of hosts or below one."""
    u = _c(url)
    host = F.regexp_extract(u, r"^[a-z]+://(?:[^/@]*@)?([^/:?#]+)", 1)
    ok = F.lit(False)
    for h in hosts:
        ok = ok | (host == h) | host.endswith("." + h)
    return u.startswith("https://") & ok
