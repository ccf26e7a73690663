"""Parsers of captured markup and JSON: pure projections, without any network."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C

ITEM = "struct<id:string,description:string,createDate:bigint,duration:double,tags:array<string>,urls:struct<thumbnail:string,poster:string>>"


def meta_content(html: Column, name: str) -> Column:
    """Content of a meta tag by property or name, attributes in either order."""
    one = F.regexp_extract(html, rf'(?is)<meta[^>]*(?:property|name)="{name}"[^>]*content="([^"]*)"', 1)
    other = F.regexp_extract(html, rf'(?is)<meta[^>]*content="([^"]*)"[^>]*(?:property|name)="{name}"', 1)
    return F.coalesce(F.nullif(one, F.lit("")), F.nullif(other, F.lit("")))


def page_meta(pages: DataFrame) -> DataFrame:
    """page_id, title (OpenGraph, else the title element), links: how many, words: how many in the text between tags."""
    html = F.coalesce("html", F.lit(""))
    title = F.coalesce(meta_content(html, "og:title"), F.nullif(F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit("")))
    return pages.select("page_id", title.alias("title"), F.size(F.regexp_extract_all(html, F.lit('(?i)<a[^>]*href="([^"]*)"'), F.lit(1))).cast("long").alias("links"), F.size(F.regexp_extract_all(html, F.lit(r"(?i)<p[ >]"), F.lit(0))).cast("long").alias("paragraphs"))


def listing_links(pages: DataFrame, pattern: str = r"^/([^/?#]+)$") -> DataFrame:
    """Distinct item ids of each page in page order with the first link of each: page_id, place, external_id, href."""
    hrefs = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit('(?i)href="([^"]*)"'), F.lit(1))
    rows = pages.select("page_id", F.posexplode(hrefs).alias("at", "href")).withColumn("external_id", F.regexp_extract("href", pattern, 1)).filter("external_id <> ''")
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy("page_id", "external_id").orderBy("at"))).filter("r = 1")
    return first.withColumn("place", F.row_number().over(Window.partitionBy("page_id").orderBy("at"))).select("page_id", "place", "external_id", "href")


def json_items(pages: DataFrame) -> DataFrame:
    """Items of JSON pages (page_id, body): malformed ones are skipped, of equal ids the first stays."""
    body = F.from_json("body", f"struct<gifs:array<{ITEM}>>")
    rows = pages.select("page_id", F.posexplode(body["gifs"]).alias("at", "g")).filter("g.id is not null and trim(g.id) <> ''")
    rows = rows.withColumn("external_id", F.lower("g.id"))
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy("external_id").orderBy("page_id", "at"))).filter("r = 1")
    return first.select("external_id", F.col("g.description").alias("title"), C.milliseconds("g.duration").alias("duration_ms"), C.epoch_to_timestamp("g.createDate").alias("published_at"), F.coalesce("g.tags", F.expr("array()")).alias("tags"), F.col("g.urls.thumbnail").alias("thumbnail_url"))


def gallery(items: DataFrame, most: int = 24) -> DataFrame:
    """Thumbnail first, then posters in order, each url once, at most ``most``: item_id, position, kind, url. items: item_id, thumbnail, posters."""
    urls = F.slice(F.array_distinct(F.filter(F.concat(F.array("thumbnail"), F.coalesce("posters", F.expr("cast(array() as array<string>)"))), lambda u: u.isNotNull())), 1, most)
    return items.select("item_id", F.posexplode(urls).alias("position", "url")).withColumn("kind", F.when(F.col("position") == 0, "thumbnail").otherwise("storyboard"))


def useless_pages(listing: DataFrame) -> DataFrame:
    """Anti-loop of paging: per page, how many ids it is the first to show, and whether reading goes on. listing: page_no, external_id."""
    first = listing.groupBy("external_id").agg(F.min("page_no").alias("page_no")).groupBy("page_no").agg(F.count("*").alias("fresh"))
    return listing.select("page_no").distinct().join(first, "page_no", "left").select("page_no", F.coalesce("fresh", F.lit(0)).alias("fresh"), F.col("fresh").isNotNull().alias("goes_on"))


def discover(listing: DataFrame, known: DataFrame, most: int) -> DataFrame:
    """New ids within a cap that known ids count towards. listing: source, page_no, place, external_id; known: source, external_id."""
    rank = F.row_number().over(Window.partitionBy("source").orderBy("page_no", "place"))
    return listing.withColumn("n", rank).filter(F.col("n") <= most).join(known.select("source", "external_id"), ["source", "external_id"], "left_anti").select("source", "external_id", "n")


def synthetic_catalogue(spark, n: int) -> DataFrame:
    """A deterministic catalogue of n items: every fifth has no storyboard."""
    i, h = F.col("id"), F.xxhash64("id")
    return spark.range(n).select(F.format_string("item-%06d", i).alias("external_id"), (30_000 + F.pmod(h, F.lit(3_570_001))).alias("duration_ms"), (i % 5 != 0).alias("has_storyboard"), F.slice(F.array(*(F.lit(t) for t in ("red", "green", "blue", "grey", "white"))), F.lit(1), (2 + F.pmod(h, F.lit(4))).cast("int")).alias("tags"))


def storyboard_assets(catalogue: DataFrame, tiles: int = 6) -> DataFrame:
    """Tiles of items with a storyboard at equal steps of their duration."""
    return catalogue.filter("has_storyboard").select("external_id", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("position"), "duration_ms").select("external_id", "position", F.expr(f"position * duration_ms div {tiles}").alias("timestamp_ms"))


def media_files(spark, root: str, extensions: tuple[str, ...] = (".mp4", ".mkv", ".mov", ".avi", ".webm", ".m4v", ".mpg", ".mpeg", ".wmv", ".flv", ".ts", ".3gp")) -> DataFrame:
    """Media files below a folder, hidden ones left out: path, local_ref, length."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    ref = F.regexp_replace("path", "^.*?" + root.rstrip("/") + "/", "")
    return files.withColumn("local_ref", ref).filter(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*extensions) & ~F.concat(F.lit("/"), F.col("local_ref")).rlike(r"/\."))
