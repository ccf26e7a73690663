"""Column rules: checks of records, keys, networks, payloads and display texts. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import col

# fixed values: the only sampling profile of a reindex job
PROFILE_MODE, PROFILE_INTERVAL_S, PROFILE_FRAMES = "adaptive", 120, 8
# fixed values: upper bounds of a refinement policy
MAX_CANDIDATES, MAX_ASSETS, MAX_SEARCH_MS, MAX_CANDIDATE_MS = 5, 30, 10_000, 3_000
# fixed values: networks that are not public
PRIVATE_NETWORKS = ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "169.254.0.0/16", "0.0.0.0/8")


def filled(x: Column | str) -> Column:
    """Neither null nor blank."""
    return F.coalesce(F.trim(col(x)) != "", F.lit(False))


def refinable(source: Column | str, adapter: Column | str, external_id: Column | str, duration_ms: Column | str) -> Column:
    """A candidate with source, adapter and id, and a duration that is unknown or not negative."""
    some = [F.coalesce(F.length(col(x)) > 0, F.lit(False)) for x in (source, adapter, external_id)]
    return some[0] & some[1] & some[2] & F.coalesce(col(duration_ms) >= 0, F.lit(True))


def ipv4_number(ip: Column | str) -> Column:
    """The address as a number, null unless it is four decimal octets without leading zeros."""
    octet = r"(0|[1-9][0-9]?|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
    parts = F.transform(F.split(col(ip), r"\."), lambda x: x.try_cast("long"))
    return F.when(col(ip).rlike(rf"^{octet}(\.{octet}){{3}}$"), F.aggregate(parts, F.lit(0).cast("long"), lambda s, x: s * 256 + x))


def private_ip(ip: Column | str) -> Column:
    """Whether an address must not be fetched: a private IPv4 network, also mapped into IPv6; loopback, unique local and link-local IPv6; anything unreadable."""
    text = F.lower(F.trim(col(ip)))
    n = ipv4_number(F.regexp_replace(text, r"^::ffff:", ""))
    inside = F.lit(False)
    for network in PRIVATE_NETWORKS:
        base, bits = network.split("/")
        low = sum(int(x) << (24 - 8 * i) for i, x in enumerate(base.split(".")))
        inside = inside | n.between(low, low + (1 << (32 - int(bits))) - 1)
    six = text.rlike(r"^[0-9a-f:]+$") & text.contains(":")
    return F.when(n.isNotNull(), inside).when(F.coalesce(six, F.lit(False)), text.rlike(r"^(::1|0:0:0:0:0:0:0:1|f[cd][0-9a-f]{2}:.*|fe[89ab][0-9a-f]:.*)$")).otherwise(True)


def profile_error(payload: Column | str) -> Column:
    """The first fault of a JSON sampling profile, null if it is the admitted one: exact keys, then mode, interval and frames."""
    p = col(payload)
    keys = F.json_object_keys(p)
    whole = lambda k: F.get_json_object(p, f"$.{k}").rlike("^-?[0-9]+$") & ~F.coalesce(p.rlike(rf'"{k}"\s*:\s*"'), F.lit(False))
    number = lambda k: F.get_json_object(p, f"$.{k}").try_cast("long")
    good = F.coalesce(F.array_sort(keys) == F.array(*[F.lit(k) for k in ("max_frames", "mode", "target_interval_seconds")]), F.lit(False))
    return (
        F.when(~good, "keys").when(~F.coalesce(F.get_json_object(p, "$.mode") == PROFILE_MODE, F.lit(False)), "mode")
        .when(~F.coalesce(whole("target_interval_seconds") & (number("target_interval_seconds") == PROFILE_INTERVAL_S), F.lit(False)), "target_interval_seconds")
        .when(~F.coalesce(whole("max_frames") & (number("max_frames") == PROFILE_FRAMES), F.lit(False)), "max_frames")
    )


def policy_error(candidates: Column | str, assets: Column | str, search_ms: Column | str, candidate_ms: Column | str, asset_bytes: Column | str, version: Column | str) -> Column:
    """The first field of a refinement policy that is out of its bounds, null if none is."""
    within = lambda x, most: F.coalesce((col(x) >= 1) & (col(x) <= most), F.lit(False))
    return (
        F.when(~within(candidates, MAX_CANDIDATES), "candidate_limit").when(~within(assets, MAX_ASSETS), "max_assets_per_candidate")
        .when(~within(search_ms, MAX_SEARCH_MS), "search_timeout_ms").when(~within(candidate_ms, MAX_CANDIDATE_MS) | (col(candidate_ms) > col(search_ms)), "candidate_timeout_ms")
        .when(~within(asset_bytes, (1 << 63) - 1), "max_asset_bytes").when(~filled(version), "policy_version")
    )


def inside_duration(timestamp_ms: Column | str, duration_ms: Column | str) -> Column:
    """A time in [0, duration) of a known positive duration."""
    return F.coalesce((col(duration_ms) > 0) & (col(timestamp_ms) >= 0) & (col(timestamp_ms) < col(duration_ms)), F.lit(False))


def valid_ranking(ranked: Column | str, expected: Column | str) -> Column:
    """An expected item and a ranking that is not empty, without blanks and without repetitions."""
    r = col(ranked)
    return filled(expected) & F.coalesce((F.size(r) > 0) & F.forall(r, filled) & (F.size(F.array_distinct(r)) == F.size(r)), F.lit(False))


def negative_counters(*names: str) -> Column:
    """Names, in order, of counters that are null or negative."""
    bad = F.array(*[F.when(~F.coalesce(F.col(n) >= 0, F.lit(False)), F.lit(n)) for n in names])
    return F.array_join(F.filter(bad, lambda x: x.isNotNull()), ",")


def availability(status: Column | str, readable: Column | str) -> Column:
    """removed for 404, available for a 2xx whose page can be read, else unavailable."""
    return F.when(col(status) == 404, "removed").when(F.coalesce(col(status).between(200, 299) & col(readable), F.lit(False)), "available").otherwise("unavailable")


def canonical_uuid(x: Column | str) -> Column:
    """Lower-case uuid with dashes, also of braces, urn prefix or 32 bare digits; else null."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(col(x)), "urn:", ""), "uuid:", ""), r"^[{}]+|[{}]+$|-", "")
    return F.when(bare.rlike("^[0-9a-f]{32}$"), F.concat_ws("-", *[F.substring(bare, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]))


def composite_key(*parts: Column | str) -> Column:
    """Parts joined by colons; a missing one reads None."""
    return F.concat_ws(":", *[F.coalesce(col(p).cast("string"), F.lit("None")) for p in parts])


def thumbnail_variant(url: Column | str, position: Column | str) -> Column:
    """The url with another number in the last component xv_N_t.jpg of its path; null where the path has none."""
    u = col(url)
    path, rest = F.regexp_extract(u, r"^([^?#]*)", 1), F.regexp_extract(u, r"^[^?#]*(.*)$", 1)
    return F.when(path.rlike(r"xv_[0-9]+_t\.jpg$"), F.concat(F.regexp_replace(path, r"xv_[0-9]+_t\.jpg$", ""), F.lit("xv_"), col(position).cast("string"), F.lit("_t.jpg"), rest))


def iso_instant(text: Column | str) -> Column:
    """The instant of an ISO-8601 text, UTC where it has no offset, whatever the session's zone; null if it can't be read."""
    t = col(text)
    time, zone = F.regexp_extract(t, r"[T ](\d{2}:\d{2}[\d:.]*)", 1), F.regexp_extract(t, r"[T ].*?(Z|[+-]\d{2}:?\d{2})$", 1)
    full = F.concat(F.substring(t, 1, 10), F.lit("T"), F.when(time == "", "00:00:00").when(F.length(time) == 5, F.concat(time, F.lit(":00"))).otherwise(time), F.when(zone == "", "Z").otherwise(zone))
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})?)?$"), full.try_cast("timestamp"))


def stamp_colour(key: Column | str) -> Column:
    """#rrggbb from the low 24 bits of the CRC-32 of a key."""
    return F.concat(F.lit("#"), F.lower(F.lpad(F.hex(F.crc32(F.encode(col(key), "UTF-8")).bitwiseAND(0xFFFFFF)), 6, "0")))


def fixed3(x: Column | str) -> Column:
    """Three decimals, ties away from zero."""
    return F.format_string("%.3f", F.round(col(x).cast("decimal(30,15)"), 3).cast("double"))


def uniform_timestamps(duration_ms: Column | str, n: Column | str) -> Column:
    """round(i * duration / n), half-even, for i from 0 to n - 1; empty unless both are positive."""
    d = col(duration_ms).cast("double")
    good = F.coalesce((col(n) > 0) & (d > 0), F.lit(False))
    return F.when(good, F.transform(F.sequence(F.lit(0), F.greatest(col(n), F.lit(1)) - 1), lambda i: F.rint(i * d / col(n)).cast("long"))).otherwise(F.expr("cast(array() as array<bigint>)"))
