"""Parsers of captured detail pages: embedded JSON, fields of an item, paging links and galleries. Projections inside the JVM, without any network."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators.folds import gallery_timestamp
from .pages import gallery, meta_content

# fixed values: tags an item shows at most, seconds a preview lasts at most
MAX_TAGS, MAX_PREVIEW_S = 20, 120
_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def unescape(text: Column) -> Column:
    """The text with the five basic character references resolved."""
    for entity, plain in _ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def url_path(url: Column) -> Column:
    """Path of a url or of a reference to one, without query and fragment."""
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def json_text(v: Column, path: str) -> Column:
    """The string at a path of a variant; null where there is none, or something else than a string."""
    found = F.try_variant_get(v, path, "variant")
    return F.when(_kind(found) == "STRING", F.try_variant_get(found, "$", "string"))


def linked_data(html: Column) -> Column:
    """The object of the first JSON-LD block as a variant: itself, or the first object of a list. Null if it can't be read."""
    block = F.regexp_extract(html, r"""(?s)<script type=["']application/ld\+json["']>(.*?)</script>""", 1)
    v = F.try_parse_json(F.nullif(block, F.lit("")))
    first = F.get(F.filter(F.try_variant_get(v, "$", "array<variant>"), lambda x: _kind(x).startswith("OBJECT")), F.lit(0))
    return F.when(_kind(v).startswith("OBJECT"), v).when(_kind(v).startswith("ARRAY"), first)


def keyword_tags(data: Column, most: int = MAX_TAGS) -> Column:
    """Tags of ``keywords``: a comma list is split and trimmed, of a list its strings count; in order, each once, at most ``most``, none empty."""
    words = F.try_variant_get(data, "$.keywords", "variant")
    split = F.transform(F.split(json_text(data, "$.keywords"), ","), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    listed = F.transform(F.filter(F.try_variant_get(words, "$", "array<variant>"), lambda x: _kind(x) == "STRING"), lambda x: F.try_variant_get(x, "$", "string"))
    tags = F.when(_kind(words) == "STRING", split).when(_kind(words).startswith("ARRAY"), listed)
    return F.coalesce(F.slice(F.array_distinct(F.filter(tags, lambda x: x != "")), 1, most), F.expr("cast(array() as array<string>)"))


def heading(html: Column) -> Column:
    """Text of the page-title heading without its duration, null if there is none."""
    inner = F.regexp_extract(html, r'(?is)<h2[^>]*class="(?:[^"]*\s)?page-title(?:\s[^"]*)?"[^>]*>(.*?)</h2>', 1)
    bare = F.regexp_replace(inner, r'(?is)<span[^>]*class="(?:[^"]*\s)?duration(?:\s[^"]*)?"[^>]*>.*?</span>', "")
    return F.nullif(F.regexp_replace(F.regexp_replace(bare, r"\s*<[^>]*>\s*", ""), r"^\s+|\s+$", ""), F.lit(""))


def item_id(url: Column) -> Column:
    """video.<code> of a url whose path begins with it, else null."""
    code = F.regexp_extract(url_path(url), r"^/(video\.[a-z0-9]+)(?:/|$)", 1)
    return F.nullif(code, F.lit(""))


def item_details(pages: DataFrame) -> DataFrame:
    """Fields of detail pages (page_id, page_url, html), one row a page.

    ``error`` is no_signal where neither a title nor an own url is found (a changed or a protection page), no_id where neither that url nor
    page_url holds an id, else null; pages with an error have no other field. Missing optional fields are null, missing tags an empty list.
    A null page is an empty one.
    """
    html = F.coalesce("html", F.lit(""))
    read = pages.select(
        "page_id", "page_url", unescape(F.coalesce(meta_content(html, "og:title"), heading(html))).alias("title"), unescape(meta_content(html, "og:url")).alias("own"),
        meta_content(html, "og:duration").alias("seconds"), unescape(meta_content(html, "og:image")).alias("thumbnail_url"), linked_data(html).alias("data"),
    )
    found = read.withColumn("external_id", F.coalesce(item_id(F.col("own")), item_id(F.col("page_url"))))
    found = found.withColumn("error", F.when(F.col("own").isNull() & F.col("title").isNull(), "no_signal").when(F.col("external_id").isNull(), "no_id"))
    good, seconds = F.col("error").isNull(), F.when(F.col("seconds").rlike(r"^\s*\+?[0-9]{1,15}\s*$"), F.trim("seconds").try_cast("long"))
    return found.select(
        "page_id", "error", *[F.when(good, F.col(c)).alias(c) for c in ("external_id", "title", "thumbnail_url")], F.when(good, seconds * 1000).alias("duration_ms"),
        F.when(good, R.iso_instant(json_text(F.col("data"), "$.uploadDate"))).alias("published_at"), F.when(good, keyword_tags(F.col("data"))).alias("tags"),
    )


def sprite_template(html: Column) -> Column:
    """Url template of the player's sprite in the page's embedded object, from the first of its three places that holds one."""
    v = F.try_parse_json(F.nullif(F.regexp_extract(html, r"(?s)<script[^>]*>\s*window\.initials=(\{.*?\})\s*;?\s*</script>", 1), F.lit("")))
    paths = ("$.spriteLoader.template", "$.xplayerPluginSettings.spriteLoader.template", "$.videoModel.spriteURL")
    return F.coalesce(*[F.nullif(json_text(v, p), F.lit("")) for p in paths])


def next_cursor(html: Column, current_path: Column) -> Column:
    """Path of the first numbered link behind the active one that leads elsewhere than the current page, null at the end of the list.

    Links that only say "next" are no numbers; links without a target are passed over; a link of another host is reduced to its path.
    """
    block = F.regexp_extract(html, r'(?is)<div[^>]*class="(?:[^"]*\s)?pagination(?:\s[^"]*)?"[^>]*>(.*?)</div>', 1)
    attribute = lambda a, name: F.regexp_extract(a, rf'(?i)(?:^|\s){name}="([^"]*)"', 1)
    links = F.filter(F.regexp_extract_all(block, F.lit(r"(?is)<a\b([^>]*)>"), F.lit(1)), lambda a: a.rlike(r'(?i)(?:^|\s)href="'))
    rows = F.transform(links, lambda a: F.struct(F.split(attribute(a, "class"), r"\s+").alias("c"), unescape(attribute(a, "href")).alias("h")))
    has = lambda x, name: F.array_contains(x["c"], F.lit(name))
    active = F.array_position(F.transform(rows, lambda x: has(x, "active")), F.lit(True))
    behind = F.filter(F.slice(rows, active + 1, F.size(rows)), lambda x: ~has(x, "next-page") & ~has(x, "no-page") & (x["h"] != ""))
    paths = F.transform(behind, lambda x: F.when(x["h"].startswith("/"), x["h"]).otherwise(F.coalesce(F.nullif(url_path(x["h"]), F.lit("")), F.lit("/"))))
    return F.when(active > 0, F.get(F.filter(paths, lambda p: ~p.eqNullSafe(current_path)), F.lit(0)))


def thumbnail_gallery(pages: DataFrame) -> DataFrame:
    """Numbered thumbnails that share the path of the page's own one: page_id, position, url, timestamp_ms. pages: page_id, html, thumbnail_url, duration_ms.

    Of one position the first url stays, also where slashes are escaped. The time is the position's share of the largest one, within a known
    positive duration, else null. A thumbnail without a number of that form has no gallery.
    """
    prefix = F.nullif(F.regexp_extract("thumbnail_url", r"^(.*xv_)", 1), F.lit(""))
    quoted = F.concat(F.lit(r"\Q"), F.replace(prefix, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E([0-9]{1,9})_t\.jpg"))
    numbers = F.regexp_extract_all(F.replace(F.coalesce("html", F.lit("")), F.lit("\\/"), F.lit("/")), quoted, F.lit(1))
    rows = pages.select("page_id", "duration_ms", prefix.alias("prefix"), numbers.alias("numbers"))
    seen = F.transform("numbers", lambda x: x.cast("int"))
    rows = rows.withColumn("seen", seen).select("page_id", "duration_ms", "prefix", "numbers", "seen", F.array_max("seen").alias("last"), F.explode(F.array_distinct("seen")).alias("position"))
    first = F.element_at("numbers", F.array_position("seen", F.col("position")).cast("int"))
    known = (F.col("duration_ms") > 0) & (F.col("last") > 0)
    return rows.select("page_id", "position", F.concat("prefix", first, F.lit("_t.jpg")).alias("url"), F.when(known, gallery_timestamp("position", "last", "duration_ms")).alias("timestamp_ms"))


def gallery_or_thumbnail(pages: DataFrame) -> DataFrame:
    """thumbnail_gallery, and the thumbnail alone for pages without a gallery; nothing for pages without either."""
    found = thumbnail_gallery(pages)
    none = pages.filter("thumbnail_url is not null").join(found.select("page_id").distinct(), "page_id", "left_anti")
    return found.unionByName(none.select("page_id", F.lit(None).cast("int").alias("position"), F.col("thumbnail_url").alias("url"), F.lit(None).cast("long").alias("timestamp_ms")))


def declared_assets(items: DataFrame) -> DataFrame:
    """Assets by shape of source: item_id, kind, url, position. items: item_id, shape, thumbnail, posters (array<string>).

    sprite: the first poster as storyboard, then the thumbnail; pair: thumbnail and first poster, both thumbnails; album: every url once,
    numbered, the first a thumbnail and the others storyboards. What is missing is left out.
    """
    poster, thumbnail = F.get("posters", F.lit(0)), F.col("thumbnail")
    asset = lambda kind, url: F.struct(F.lit(kind).alias("kind"), url.alias("url"))
    two = F.when(F.col("shape") == "sprite", F.array(asset("storyboard", poster), asset("thumbnail", thumbnail))).when(F.col("shape") == "pair", F.array(asset("thumbnail", thumbnail), asset("thumbnail", poster)))
    plain = items.select("item_id", F.explode(F.filter(two, lambda a: a["url"].isNotNull())).alias("a"))
    return gallery(items.filter("shape = 'album'")).select("item_id", "kind", "url", "position").unionByName(plain.select("item_id", "a.kind", "a.url", F.lit(None).cast("int").alias("position")))


def preview_grid(duration_s: Column, interval_s: float, count: Column) -> Column:
    """Times of ``count`` frames of a preview, round(i * interval) in ms; null for an unknown duration or one that is no preview's."""
    at = F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda i: F.rint(i * F.lit(interval_s) * 1000).cast("long"))
    return F.when(duration_s <= MAX_PREVIEW_S, F.when(count > 0, at).otherwise(F.expr("cast(array() as array<bigint>)")))


def page_chain(pages: DataFrame, first: DataFrame, most: int) -> DataFrame:
    """Captured pages reached from the first paths by next cursors, at most ``most`` a source: source, place, path. pages: source, path, html; first: source, path.

    Each step is a join on the next path; a path that was read before ends its chain.
    """
    linked = pages.select("source", "path", next_cursor(F.coalesce("html", F.lit("")), F.col("path")).alias("onward"))
    reached = linked.join(first, ["source", "path"], "left_semi").select("source", F.array("path").alias("read"), "onward")
    for _ in range(most - 1):
        following = linked.select("source", F.col("path").alias("onward"), F.col("onward").alias("beyond"))
        on = F.col("known") & ~F.array_contains("read", F.col("onward"))
        step = reached.join(following.withColumn("known", F.lit(True)), ["source", "onward"], "left").withColumn("on", F.coalesce(on, F.lit(False)))
        reached = step.select("source", F.when(F.col("on"), F.concat("read", F.array("onward"))).otherwise(F.col("read")).alias("read"), F.when(F.col("on"), F.col("beyond")).alias("onward"))
    return reached.select("source", F.posexplode("read").alias("place", "path"))
