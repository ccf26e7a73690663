"""Column expressions: vectors, signatures, identifiers, urls, times. All run inside the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: name spaces of the deterministic identifiers
VIDEO_NAMESPACE = "6d9f0c0e-2c4a-4b7e-8f1a-3d5b7c9e0f2a"
FRAME_NAMESPACE = "a1b2c3d4-e5f6-4a7b-8c9d-0e1f2a3b4c5d"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(x: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value worked out once a row; a lambda works out what it takes from outside again for each element."""
    return F.transform(F.array(x), use)[0]


def doubles(v: Column | str) -> Column:
    return F.transform(col(v), lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    """1 - cosine, in [0, 2]; 1 where a vector is zero; an error where dimensions differ."""
    a, b = doubles(a), doubles(b)
    same = F.assert_true(F.size(a) == F.size(b), "vectors differ in dimension").isNull()
    length = norm(a) * norm(b)
    return F.when(same & (length == 0), 1.0).otherwise(1 - dot(a, b) / length)


def cosine_similarity_strict(a: Column | str, b: Column | str) -> Column:
    """Cosine clamped to [0, 1]; an error for a zero vector."""
    a, b = doubles(a), doubles(b)
    length = norm(a) * norm(b)
    return F.when(length == 0, F.raise_error(F.lit("zero vector"))).otherwise(clamp01(dot(a, b) / length))


def l2_normalise(v: Column | str) -> Column:
    """Unit vector; an error for a zero vector."""
    over = lambda v, n: F.when(n == 0, F.raise_error(F.lit("zero vector"))).otherwise(F.transform(v, lambda x: x / n))
    return let(doubles(v), lambda v: let(norm(v), lambda n: over(v, n)))


def fake_embedding(pixels: Column | str, dimension: int) -> Column:
    """A unit vector of the bytes of SHA-256 over the pixels and a four-byte block number: the same pixels give the same vector."""
    digest = F.concat(*[F.sha2(F.concat(col(pixels), F.unhex(F.lit(f"{block:08x}"))), 256) for block in range((dimension + 31) // 32)])
    byte = lambda d, i: F.conv(F.substring(d, 2 * i + 1, F.lit(2)), 16, 10).cast("double")
    return l2_normalise(let(digest, lambda d: F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: byte(d, i) / 255)))


def clamp01(x: Column) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def hamming(a: Column | str, b: Column | str) -> Column:
    """Differing bits of two 64-bit signatures held as signed longs."""
    return F.bit_count(col(a).bitwiseXOR(col(b)))


def sign_signature(v: Column | str) -> Column:
    """64 sign bits of a vector as a signed long; bit i is set where element i is positive."""
    bits = F.transform(col(v), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda s, b: s.bitwiseOR(b))


def to_unsigned(p: Column | str) -> Column:
    p = col(p).cast("decimal(20,0)")
    return F.when(p < 0, p + F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(p).cast("decimal(20,0)")


def to_signed(p: Column | str) -> Column:
    p = col(p).cast("decimal(20,0)")
    return F.when(p >= F.lit("9223372036854775808").cast("decimal(20,0)"), p - F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(p).cast("long")


def uuid5(namespace: str, name: Column | str) -> Column:
    """Version 5 identifier of a name: SHA-1 of name space and name with version and variant bits set."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(col(name), "UTF-8")))
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3) + 8).cast("long")))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def frame_seq(timestamp_ms: Column | str, ordinal: Column | str) -> Column:
    """The timestamp, or a thousand million and the ordinal for a frame without one."""
    return F.coalesce(col(timestamp_ms).cast("long"), F.lit(1_000_000_000) + col(ordinal))


def sanitize_url(url: Column | str) -> Column:
    """Scheme and host in lower case, port and path kept, query and fragment dropped; null unless http(s) with a host and no credentials."""
    u = col(url)
    scheme, rest = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)), F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    path = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    good = scheme.isin("http", "https") & (rest != "") & ~rest.contains("@") & ~rest.startswith(":")
    return F.when(good, F.concat(scheme, F.lit("://"), F.lower(rest), path))


def valid_url(url: Column | str) -> Column:
    return sanitize_url(url).isNotNull()


def host_display(url: Column | str) -> Column:
    """Host name without port, or a dash."""
    return F.coalesce(F.nullif(F.regexp_extract(sanitize_url(url), r"^https?://([^/:]+)", 1), F.lit("")), F.lit("—"))


def absolute_url(href: Column | str, host: str) -> Column:
    """Canonical https url of a link, null for another host."""
    h = col(href)
    return F.when(h.startswith("/") & ~h.startswith("//"), F.concat(F.lit(f"https://{host}"), h)).when(h.rlike(rf"^https?://([a-z0-9-]+\.)*{re.escape(host)}(/|$)"), F.regexp_replace(h, r"^https?://[^/]+", f"https://{host}"))


def format_position(ms: Column | str) -> Column:
    """mm:ss with minutes unbounded; a dash for null and negative positions."""
    seconds = F.expr("cast(0 as bigint)") + F.floor(col(ms) / 1000)
    minutes = F.floor(seconds / 60)
    two = lambda x: F.when(x < 10, F.lpad(x.cast("string"), 2, "0")).otherwise(x.cast("string"))
    return F.when(col(ms).isNull() | (col(ms) < 0), F.lit("—")).otherwise(F.concat(two(minutes), F.lit(":"), two(F.pmod(seconds, F.lit(60)))))


def slug(text: Column | str, default: str = "item") -> Column:
    out = F.regexp_replace(F.regexp_replace(col(text), r"[^A-Za-z0-9_.-]+", "_"), r"^[._-]+|[._-]+$", "")
    return F.coalesce(F.nullif(out, F.lit("")), F.lit(default))


def clean_tags(text: Column | str, most: int | None = 20) -> Column:
    """Trimmed, non-empty tags of a comma list in order, each once, at most ``most``."""
    tags = F.array_distinct(F.filter(F.transform(F.split(col(text), ","), lambda t: F.trim(t)), lambda t: t != ""))
    return F.slice(tags, 1, most) if most else tags


def epoch_to_timestamp(seconds: Column | str) -> Column:
    """UTC instant of positive epoch seconds, else null."""
    return F.when((col(seconds) > 0) & (col(seconds) < 253402300800), F.timestamp_seconds(col(seconds)))


def lenient_int(text: Column | str) -> Column:
    """An integer from a trimmed string or from a number without fraction, else null."""
    x = F.trim(col(text).cast("string")).try_cast("double")
    return F.when(x == F.floor(x), x.cast("long"))


def milliseconds(seconds: Column | str, rule: str = "round") -> Column:
    """Seconds in milliseconds: half-even ``round``, ``truncate``, or ``whole`` seconds only."""
    s = col(seconds)
    return {"round": F.rint(s * 1000).cast("long"), "truncate": (s * 1000).cast("long"), "whole": s.try_cast("int").cast("long") * 1000}[rule]


def even_height(width: Column | str, height: Column | str, target: int) -> Column:
    return F.greatest(F.lit(2).cast("long"), 2 * F.rint(col(height) * target / col(width) / 2).cast("long"))


def frame_rate(text: Column | str) -> Column:
    parts = F.split(col(text), "/")
    return F.try_divide(F.try_element_at(parts, F.lit(1)).try_cast("double"), F.coalesce(F.try_element_at(parts, F.lit(2)).try_cast("double"), F.lit(1.0)))


def backoff_seconds(attempt: Column | str, base: float = 1.0, factor: float = 2.0, cap: float = 3600.0) -> Column:
    """Delay before a retry without jitter: base * factor^(attempt - 1), at most cap."""
    return F.least(F.lit(base) * F.pow(F.lit(factor), F.greatest(col(attempt), F.lit(1)) - 1), F.lit(cap))


# fixed values: markers of errors that no retry mends
TERMINAL_MARKERS = ("removed", "robots", "terms of service", "tos", "404")


def error_class(status: Column | str, message: Column | str, whole_words: bool = False) -> Column:
    """terminal or transient, by http status first and then by markers in the message (optionally as whole words)."""
    found = F.lit(False)
    for m in TERMINAL_MARKERS:
        found = found | (F.lower(col(message)).rlike(rf"\b{m}\b") if whole_words else F.lower(col(message)).contains(m))
    return F.when(col(status).isin(404, 410), "terminal").when(F.coalesce(found, F.lit(False)), "terminal").otherwise("transient")


def sniff_image(content: Column | str) -> Column:
    """MIME type by the first bytes, null if none is known."""
    h = F.hex(F.substring(col(content), 1, 12))
    return F.when(h.startswith("FFD8FF"), "image/jpeg").when(h.startswith("89504E470D0A1A0A"), "image/png").when(h.rlike("^52494646.{8}57454250"), "image/webp")


def duration_bucket(ms: Column | str) -> Column:
    return F.when(col(ms) < 1, None).when(col(ms) < 300_000, "<5m").when(col(ms) <= 900_000, "5-15m").when(col(ms) > 900_000, ">15m")


def valid_timestamp(ts: Column | str, duration: Column | str) -> Column:
    """The timestamp if within a known positive duration, or not negative where the duration isn't known; else null."""
    t, d = col(ts), col(duration)
    return F.when((t >= 0) & (d.isNull() | (d <= 0) | (t < d)), t)


def sprite_grid(url: Column | str) -> Column:
    """(columns, rows) of a sprite from the end of its url's path: 20 by 1 for a hover sprite WxH.s.webp, N by 1 for .N.s.jpg, .png or .webp."""
    path = F.regexp_extract(col(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    n = F.regexp_extract(path, r"\.([0-9]+)\.s\.(?:jpe?g|webp|png)$", 1).try_cast("int")
    return F.when(path.rlike(r"[0-9]+x[0-9]+\.s\.webp$"), F.struct(F.lit(20).alias("columns"), F.lit(1).alias("rows"))).when(n.isNotNull(), F.struct(n.alias("columns"), F.lit(1).alias("rows")))
