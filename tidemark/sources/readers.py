"""Readers of landed files.  Schemas are explicit; broken records are kept apart, not fatal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tidemark.functions.dates import parse_date_multi, parse_feed_date
from tidemark.functions.hashing import trimmed_md5
from tidemark.functions.text import clean_text, decode_entities, non_empty, strip_html
from tidemark.schema import FEED_ITEM, FORUM_ITEM, LISTING, RAW_POST, TREND_LOG
from tidemark.sources.json_array import read_records


def read_posts_json(spark: SparkSession, paths: list[str], split: bool = False) -> DataFrame:
    """Union of files that each hold a JSON array of posts; missing files are skipped.

    ``file_order`` is the file's place in the list. With ``split`` a large file is read by many tasks and every broken
    object is a row of its own; otherwise a file is one task, and broken as a whole.
    """
    if split:
        return _with_order(spark, paths, read_records(spark, _existing(spark, paths), RAW_POST))
    df = (spark.read.schema(RAW_POST).option("multiLine", True).option("mode", "PERMISSIVE")
          .option("columnNameOfCorruptRecord", "_corrupt_record").option("ignoreMissingFiles", True).json(_existing(spark, paths)))
    return _with_order(spark, paths, df.withColumn("source_file", F.col("_metadata.file_path")))


def _with_order(spark: SparkSession, paths: list[str], df: DataFrame) -> DataFrame:
    places = spark.createDataFrame(_files(spark, paths), "_file string, file_order int")  # a row per file that the driver lists anyway
    keyed = df.withColumn("_file", _one_slash(F.col("source_file")))
    return keyed.join(places, "_file", "left").withColumn("file_order", F.coalesce("file_order", F.lit(len(paths)))).drop("_file")


def _one_slash(path: Column) -> Column:
    return F.regexp_replace(path, "^([a-z0-9]+):/+(?=[^/])", "$1:/")


def _files(spark: SparkSession, paths: list[str]) -> list[tuple[str, int]]:
    """(file, place in ``paths``) of every file behind files, folders and globs; the first place holds."""
    import re

    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    out: dict[str, int] = {}
    for i, p in enumerate(paths):
        hp = jvm.org.apache.hadoop.fs.Path(p)
        fs = hp.getFileSystem(conf)
        for status in fs.globStatus(hp) or []:
            for f in fs.listStatus(status.getPath()) if status.isDirectory() else [status]:
                out.setdefault(re.sub("^([a-z0-9]+):/+(?=[^/])", r"\1:/", f.getPath().toUri().toString()), i)
    return list(out.items())


def _existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """Paths that exist, by the file system that owns them (a listing call per configured path)."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    out = []
    for p in paths:
        hp = jvm.org.apache.hadoop.fs.Path(p)
        if hp.getFileSystem(conf).globStatus(hp):
            out.append(p)
    if not out:
        raise FileNotFoundError(f"none of {len(paths)} input paths exists")
    return out


def split_corrupt(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, broken rows)."""
    return df.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record"), df.where(F.col("_corrupt_record").isNotNull())


def infer_source(path: Column, custom: dict[str, str] | None = None) -> Column:
    """Source name from a lower-cased path; first match wins.

    The short token ``x`` must stand alone in the file name, not occur anywhere in the path.
    """
    p = F.lower(path)
    out = F.when(p.contains("reddit"), "Reddit").when(p.contains("twitter") | p.rlike(r"/x[_.\-][^/]*$"), "Twitter/X")
    out = out.when(p.contains("bluesky") | p.contains("bsky"), "Bluesky")
    for key, name in (custom or {}).items():
        out = out.when(p.contains(key), name)
    return out.when(p.contains("community") | p.contains("forum"), "Forums").when(p.contains("all_scraped"), "Multi-Source").otherwise("Unknown")


def read_posts_envelope(spark: SparkSession, paths: list[str], today: Column, multi_line: bool = True) -> DataFrame:
    """Arrays of posts or ``{"items": [...]}`` (one per file, or one per line); text falls back to raw_text."""
    schema = T.StructType([*RAW_POST.fields, T.StructField("items", T.ArrayType(T.StructType(RAW_POST.fields[:-1])))])
    df = (spark.read.schema(schema).option("multiLine", multi_line).option("columnNameOfCorruptRecord", "_corrupt_record").json(_existing(spark, paths))
          .withColumn("source_file", F.col("_metadata.file_path")))
    names = [f.name for f in RAW_POST.fields[:-1]]
    self_row = F.array(F.struct(*[F.col(n) for n in names]))
    rows = df.where(F.col("_corrupt_record").isNull()).select("source_file", F.explode(F.coalesce("items", self_row)).alias("r")).select("source_file", "r.*")
    return with_trace(rows.withColumn("raw_text", F.coalesce(non_empty(F.trim("text")), non_empty(F.trim("raw_text")))), today)


def read_posts_text(spark: SparkSession, paths: list[str], today: Column) -> DataFrame:
    """One post per non-blank line."""
    lines = spark.read.text(_existing(spark, paths)).withColumn("source_file", F.col("_metadata.file_path"))
    rows = lines.select("source_file", F.trim("value").alias("raw_text"))
    for f in RAW_POST.fields:
        if f.name not in ("raw_text", "_corrupt_record"):
            rows = rows.withColumn(f.name, F.lit(None).cast(f.dataType))
    return with_trace(rows, today)


def with_trace(rows: DataFrame, today: Column) -> DataFrame:
    """Cleaned text beside the raw one, length, md5 ids, dates; rows without text drop out."""
    r = rows.where(F.length(F.coalesce("raw_text", F.lit(""))) > 0).withColumn("_clean", clean_text(F.col("raw_text")))
    day = F.coalesce(parse_date_multi(F.col("post_date")), today)
    empty = F.array().cast("array<string>")
    return r.select(
        F.col("_clean").alias("text"), "raw_text", "title", F.coalesce("source", infer_source(F.col("source_file"))).alias("source"), "url", "source_file",
        day.alias("post_date"), F.coalesce(parse_date_multi(F.col("_logged_date")), day).alias("logged_date"),
        *[F.coalesce(c, empty).alias(c) for c in ("topic_focus", "mentions_competitor", "mentions_ecosystem_partner")],
        F.length("_clean").alias("char_count"), F.coalesce("post_id", trimmed_md5(F.col("raw_text"))).alias("post_id"),
        F.coalesce("hash", trimmed_md5(F.col("raw_text"))).alias("hash"))


def consolidate(df: DataFrame, as_of: Column) -> DataFrame:
    """Canonical columns with defaults, whatever a source delivered."""
    have = set(df.columns)
    text = lambda c, d="": F.coalesce(F.col(c), F.lit(d)).alias(c) if c in have else F.lit(d).alias(c)
    num = lambda c: F.coalesce(F.col(c).cast("bigint"), F.lit(0)).alias(c) if c in have else F.lit(0).cast("bigint").alias(c)
    raw_day = F.col("post_date") if "post_date" in have else F.lit(None).cast("string")
    logged = F.col("_logged_date") if "_logged_date" in have else F.lit(None).cast("string")
    return df.select(
        text("post_id"), text("text"), text("title"), text("source", "Unknown"), text("url"), text("username", "unknown"),
        F.coalesce(parse_date_multi(raw_day), as_of).alias("post_date"), F.coalesce(F.try_to_timestamp(logged), as_of.cast("timestamp")).alias("logged_at"),
        text("subreddit"), text("forum_section"), text("search_term"), num("score"), num("like_count"), num("repost_count"), num("num_comments"),
        text("competitor"), text("competitor_type"), *(["pos"] if "pos" in have else []))


# --- listings -----------------------------------------------------------------------------------

REMOVED = ("[removed]", "[deleted]")


def read_listing_json(spark: SparkSession, paths: list[str], split: bool = False) -> DataFrame:
    """Listings of files. With ``split`` a large file is read by many tasks, and a row holds one child instead of a whole listing."""
    if split:
        child = LISTING["data"].dataType["children"].dataType.elementType
        rows = read_records(spark, _existing(spark, paths), child, level=2)
        return rows.select(F.struct(F.array(F.struct("kind", "data")).alias("children")).alias("data"))
    return spark.read.schema(LISTING).option("multiLine", True).json(_existing(spark, paths))


def flatten_listing(df: DataFrame, as_of: Column, min_len: int = 30) -> DataFrame:
    """Rows of ``data.children[].data``: title and body joined, removed posts out, image address by preference."""
    d = df.select(F.explode("data.children").alias("c")).select("c.data.*")
    body = F.coalesce("selftext", F.lit(""))
    text = F.trim(F.when(body != "", F.concat(F.coalesce("title", F.lit("")), F.lit("\n\n"), body)).otherwise(F.coalesce("title", F.lit(""))))
    preview = F.replace(F.get(F.col("preview.images"), F.lit(0))["source"]["url"], F.lit("&amp;"), F.lit("&"))
    image = (F.when(F.col("post_hint") == "image", F.col("url"))
             .when((F.length("thumbnail") > 0) & ~F.col("thumbnail").isin("self", "default", "nsfw", "spoiler"), F.col("thumbnail")).otherwise(preview))
    return d.withColumn("_t", text).where((F.length("_t") >= min_len) & ~body.isin(*REMOVED)).select(
        F.col("_t").alias("text"), "title", F.lit("Reddit").alias("source"), "subreddit", F.coalesce("author", F.lit("unknown")).alias("username"),
        F.concat(F.lit("https://reddit.com"), F.coalesce("permalink", F.lit(""))).alias("url"), F.col("id").alias("post_id"),
        F.coalesce(F.when(F.col("created_utc") > 0, F.timestamp_seconds("created_utc").cast("date")), as_of).alias("post_date"),
        F.coalesce("score", F.lit(0)).alias("score"), F.coalesce("num_comments", F.lit(0)).alias("num_comments"),
        "upvote_ratio", image.alias("image_url"), F.coalesce("is_self", F.lit(True)).alias("is_self"), "link_flair_text")


def flatten_forum(df: DataFrame, as_of: Column, base_url: str, source: str = "Forums", min_len: int = 20) -> DataFrame:
    """Forum API items (``FORUM_ITEM`` rows): markup stripped, views as score, whole texts."""
    body, subject = strip_html(F.col("body")), F.trim(F.coalesce("subject", F.lit("")))
    text = F.when((body != "") & (body != subject), F.concat(subject, F.lit("\n\n"), body)).otherwise(subject)
    url = F.when(F.col("view_href").startswith("http"), F.col("view_href")).when(F.length("view_href") > 0, F.concat(F.lit(base_url), F.col("view_href"))).otherwise("")
    d = df.withColumn("_t", text).where(F.length("_t") >= min_len)
    return d.select(F.col("_t").alias("text"), subject.alias("title"), F.lit(source).alias("source"),
                    F.coalesce(F.col("board.id"), F.lit("unknown")).alias("forum_section"), F.coalesce(F.col("author.login"), F.lit("unknown")).alias("username"),
                    url.alias("url"), F.coalesce(parse_date_multi(F.substring("post_time", 1, 10)), as_of).alias("post_date"),
                    (F.coalesce("depth", F.lit(0)) == 0).alias("is_original_post"), F.coalesce("depth", F.lit(0)).alias("depth"),
                    F.coalesce(F.col("metrics.views"), F.lit(0)).alias("score"),
                    F.concat(F.lit("forum_"), F.abs(F.xxhash64(F.when(url != "", url).otherwise(subject))).cast("string")).alias("post_id"))


def cut_text(c: Column, n: int | None) -> Column:
    """At most ``n`` characters and a mark where more were; everything without a limit."""
    if n is None:
        return c
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def comment_depth(df: DataFrame, id_col: str = "id", parent_col: str = "parent_id") -> DataFrame:
    """Adds ``comment_depth``: 0 for rows whose parent is not a comment of the table.

    Each round doubles the distance that a row looks up (its ancestor's ancestor), so a chain of n replies takes log2(n)
    joins on a slim written table. Rows that reply to themselves in a circle have no depth: that raises.
    """
    from tidemark.session import cut_lineage

    nodes = cut_lineage(df.select(F.col(id_col).alias("_id"), F.col(parent_col).alias("_up")).distinct())
    known = nodes.select(F.col("_id").alias("_up")).distinct().withColumn("_in", F.lit(True))
    at = cut_lineage(nodes.join(known, "_up", "left").select("_id", F.when(F.col("_in"), F.col("_up")).alias("_up"), F.col("_in").isNotNull().cast("int").alias("_d")))
    rounds, limit = 0, max(1, at.count()).bit_length() + 1
    while not at.where("_up is not null").isEmpty():
        if rounds > limit:
            raise ValueError("some replies form a circle")
        higher = at.select(F.col("_id").alias("_up"), F.col("_up").alias("_next"), F.col("_d").alias("_more"))
        at = cut_lineage(at.join(higher, "_up", "left").select("_id", F.col("_next").alias("_up"), (F.col("_d") + F.coalesce("_more", F.lit(0))).alias("_d")))
        rounds += 1
    return df.join(at.select(F.col("_id").alias(id_col), F.col("_d").alias("comment_depth")), id_col)


def read_forum_json(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.schema(FORUM_ITEM).option("multiLine", True).json(_existing(spark, paths))


# --- feeds ------------------------------------------------------------------------------------------

def read_feed_xml(spark: SparkSession, paths: list[str], feed: str, as_of: Column, focus: str = "", row_tag: str = "item", min_title: int = 10,
                  cut: int | None = None) -> DataFrame:
    """RSS items (or Atom entries with ``row_tag='entry'``) of landed files."""
    df = spark.read.format("xml").option("rowTag", row_tag).option("ignoreNamespace", False).schema(FEED_ITEM).load(paths)
    c = lambda n: F.col(f"`{n}`")
    title, desc = strip_html(c("title"), cdata=True, all_entities=True), strip_html(F.coalesce(c("description"), c("summary")), cdata=True, all_entities=True)
    body = F.coalesce(non_empty(strip_html(c("content:encoded"), cdata=True, all_entities=True)), non_empty(desc), F.lit(""))
    full = F.when(body != "", F.concat(title, F.lit("\n\n"), body)).otherwise(title)
    day = parse_feed_date(F.coalesce(c("pubDate"), c("dc:date"), c("published")), as_of)
    return df.withColumn("_title", title).where(F.length("_title") >= min_title).select(
        cut_text(full, cut).alias("text"), F.col("_title").alias("title"), F.concat(F.lit("News:"), F.lit(feed)).alias("source"),
        F.lit(feed).alias("feed_name"), F.lit(focus).alias("feed_focus"),
        F.coalesce(non_empty(strip_html(c("dc:creator"), all_entities=True)), F.col("author.name"), F.lit(feed)).alias("username"),
        F.trim(F.coalesce("link", F.lit(""))).alias("url"), day.alias("post_date"),
        F.transform(F.coalesce("category", F.array().cast("array<string>")), lambda x: F.trim(x)).alias("categories"), F.substring(desc, 1, 500).alias("summary"))


def read_podcast_xml(spark: SparkSession, paths: list[str], show: str, as_of: Column) -> DataFrame:
    """Episodes: whole notes, audio address as fallback link."""
    df = spark.read.format("xml").option("rowTag", "item").option("ignoreNamespace", False).schema(FEED_ITEM).load(paths)
    c = lambda n: F.col(f"`{n}`")
    notes = F.coalesce(*[non_empty(strip_html(c(n), all_entities=True)) for n in ("content:encoded", "description", "itunes:summary")], F.lit(""))
    title = F.trim(F.coalesce("title", F.lit("")))
    text = F.when(notes != "", F.concat(title, F.lit("\n\n"), notes)).otherwise(title)
    audio = F.coalesce(F.col("enclosure._url"), F.lit(""))
    return df.withColumn("_t", text).where((title != "") & (F.length("_t") >= 20)).select(
        F.col("_t").alias("text"), F.concat(F.lit(f"{show}: "), title).alias("title"), F.lit("Podcast").alias("source"), F.lit(show).alias("podcast_name"),
        F.coalesce(non_empty(F.trim("link")), audio).alias("url"), audio.alias("audio_url"), F.lit(show).alias("username"),
        parse_feed_date(c("pubDate"), as_of).alias("post_date"), F.coalesce(F.trim(c("itunes:duration")), F.lit("")).alias("duration"), F.lit(0).alias("score"))


# --- pages ----------------------------------------------------------------------------------------------

BLOCKS = ("script", "style", "nav", "footer", "header")


def extract_page(df: DataFrame, html: str = "html", url: str = "url", cut: int | None = None) -> DataFrame:
    """Main text, title, date, author, description and links of landed pages, with regular expressions.

    Adds page_title, body_text, page_text, published, author, description, links.
    """
    h = F.coalesce(F.col(html), F.lit(""))
    one = lambda rx, g=1: F.regexp_extract(h, rx, g)
    plain = lambda c: strip_html(c)
    article = F.coalesce(non_empty(one(r"(?is)<article[^>]*>(.*?)</article>")), non_empty(one(r"(?is)<main[^>]*>(.*?)</main>")), non_empty(one(r"(?is)<body[^>]*>(.*?)</body>")), h)
    for tag in BLOCKS:
        article = F.regexp_replace(article, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", " ")
    title = F.coalesce(non_empty(plain(one(r"(?is)<h1[^>]*>(.*?)</h1>"))), non_empty(plain(one(r"(?is)<title[^>]*>(.*?)</title>"))), F.lit(""))
    stamp = F.coalesce(non_empty(one(r'(?is)<time[^>]*\bdatetime="([^"]+)"')),
                       non_empty(one(r'(?is)<meta[^>]*property="article:published_time"[^>]*content="([^"]*)"')))
    author = F.coalesce(non_empty(plain(one(r'(?is)<[a-z]+[^>]*class="[^"]*author[^"]*"[^>]*>(.*?)</'))),
                        non_empty(one(r'(?is)<meta[^>]*name="author"[^>]*content="([^"]*)"')),
                        non_empty(plain(one(r'(?is)<[a-z]+[^>]*rel="author"[^>]*>(.*?)</'))))
    desc = F.coalesce(non_empty(one(r'(?is)<meta[^>]*property="og:description"[^>]*content="([^"]*)"')),
                      non_empty(one(r'(?is)<meta[^>]*name="description"[^>]*content="([^"]*)"')), F.lit(""))
    links = F.regexp_extract_all(h, F.lit(r'(?is)<a\b[^>]*\bhref="([^"]*)"'), F.lit(1))
    out = df.withColumns({"page_title": title, "body_text": plain(article), "published": parse_date_multi(F.substring(stamp, 1, 10)), "author": author,
                          "description": decode_entities(desc), "links": links})
    body = F.when(F.length("body_text") < 50, F.col("page_title")).otherwise(F.col("body_text"))
    text = F.concat_ws("\n\n", F.col("page_title"), non_empty(F.col("description")), body)
    return out.withColumn("page_text", cut_text(text, cut))


def checklist_title(df: DataFrame, html: str = "html", url: str = "url", site: str = "") -> DataFrame:
    """Title of a direct page: h1, else title, else the last path element in words."""
    slug = F.initcap(F.replace(F.element_at(F.split(F.regexp_replace(F.col(url), r"/+$", ""), "/"), -1), F.lit("-"), F.lit(" ")))
    h = F.coalesce(F.col(html), F.lit(""))
    one = lambda rx: non_empty(strip_html(F.regexp_extract(h, rx, 1)))
    t = F.coalesce(one(r"(?is)<h1[^>]*>(.*?)</h1>"), one(r"(?is)<title[^>]*>(.*?)</title>"), non_empty(slug), F.lit("Checklist"))
    if site:
        t = F.regexp_replace(t, rf"(?i)\s*\|\s*{site}\s*$", "")
    return df.withColumn("page_title", F.trim(F.regexp_replace(t, r"\s+", " ")))


# --- videos -----------------------------------------------------------------------------------------------

def compose_video_posts(videos: DataFrame, transcripts: DataFrame, comments: DataFrame, as_of: Column, pos: str = "pos") -> DataFrame:
    """Posts from landed video, transcript and comment tables.

    One row per distinct video (title and transcript, else title and description) and one
    per comment of at least 20 characters.
    """
    from tidemark.operators.ordering import keep_first_by_key

    v = keep_first_by_key(videos, "video_id", pos).join(transcripts.groupBy("video_id").agg(F.max("transcript").alias("transcript")), "video_id", "left")
    good = F.length("transcript") > 50
    with_desc = F.when(F.length("description") > 10, F.concat(F.col("title"), F.lit("\n\n"), F.col("description"))).otherwise(F.col("title"))
    text = F.when(good, F.concat(F.col("title"), F.lit("\n\n"), F.col("transcript"))).otherwise(with_desc)
    link = F.concat(F.lit("https://www.youtube.com/watch?v="), F.col("video_id"))
    day = F.coalesce(parse_date_multi(F.col("published")), as_of)
    base = v.withColumns({"_text": text, "_day": day, "url": link})
    posts = base.where(F.length("_text") >= 20).select(
        F.col("_text").alias("text"), "title", F.when(good, "YouTube (transcript)").otherwise("YouTube").alias("source"), "url",
        F.coalesce("channel", F.lit("unknown")).alias("username"), F.col("_day").alias("post_date"), F.lit(0).cast("bigint").alias("score"),
        F.lit(0).cast("bigint").alias("like_count"), F.concat(F.lit("yt_"), F.col("video_id")).alias("post_id"))
    c = comments.where(F.length("text") >= 20).join(base.select("video_id", F.col("title").alias("_vt"), F.col("_day"), "url"), "video_id")
    rows = c.select("text", F.concat(F.lit("Comment on: "), F.col("_vt")).alias("title"), F.lit("YouTube (comment)").alias("source"), "url",
                    F.coalesce("author", F.lit("unknown")).alias("username"), F.coalesce(parse_date_multi(F.col("published")), F.col("_day")).alias("post_date"),
                    F.coalesce("likes", F.lit(0)).cast("bigint").alias("score"), F.coalesce("likes", F.lit(0)).cast("bigint").alias("like_count"),
                    F.concat(F.lit("yt_comment_"), F.col("video_id"), F.lit("_"), F.xxhash64("text").cast("string")).alias("post_id"))
    return posts.unionByName(rows)


# --- logs -------------------------------------------------------------------------------------------------

def read_trend_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TREND_LOG).json(path).withColumn("logged_at", F.try_to_timestamp("_logged_at"))
