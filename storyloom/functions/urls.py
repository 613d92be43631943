"""Expressions over addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import squeeze

# Query keys whose values are secret.
SECRET_KEYS = ["access_token", "api_key", "apikey", "auth", "auth_token", "key", "password", "secret", "token"]


def _decoded(part: Column) -> Column:
    return F.coalesce(F.try_url_decode(part), part)


def _encoded(part: Column) -> Column:
    return F.replace(F.replace(F.url_encode(part), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def without_fragment(url: Column) -> Column:
    return F.split_part(url, F.lit("#"), F.lit(1))


def query_pairs(url: Column) -> Column:
    """(key, value) of the query's pairs whose value isn't blank."""
    rest = without_fragment(url)
    query = F.when(rest.contains("?"), F.regexp_replace(rest, r"^[^?]*\?", "")).otherwise(F.lit(""))
    pairs = F.transform(F.split(query, "&", -1), lambda p: F.struct(_decoded(F.split_part(p, F.lit("="), F.lit(1))).alias("key"), _decoded(F.regexp_replace(p, "^[^=]*=?", "")).alias("value")))
    return F.filter(pairs, lambda p: p["value"] != "")


def canonical(url: Column) -> Column:
    """An address without fragment, tracking keys and blank pairs; the others encoded anew in order."""
    base = F.split_part(without_fragment(url), F.lit("?"), F.lit(1))
    kept = F.filter(query_pairs(url), lambda p: ~F.lower(p["key"]).startswith("utm_"))
    query = F.array_join(F.transform(kept, lambda p: F.concat(_encoded(p["key"]), F.lit("="), _encoded(p["value"]))), "&")
    return F.when(query == "", base).otherwise(F.concat(base, F.lit("?"), query))


def url_key(url: Column) -> Column:
    """Addresses that differ in case or tracking have one key."""
    return F.lower(canonical(squeeze(url)))


def host_of(url: Column) -> Column:
    """The host in lower case, without user, port and the brackets of an IPv6 address."""
    return F.lower(F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)", 1), r"[\[\]]", ""))


def is_image_url(url: Column) -> Column:
    return F.coalesce(squeeze(url).rlike("^https?://[^/?#]+"), F.lit(False))


def is_public_host(host: Column) -> Column:
    """Not blank, not this machine, and no address of a private, loopback, link-local, reserved or multicast range."""
    is_ip = host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    a, b = (F.try_element_at(F.transform(F.split(host, r"\."), lambda x: x.try_cast("int")), F.lit(k)) for k in (1, 2))
    private = (a.isin(0, 10, 127) | (a >= 224)) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 100) & b.between(64, 127)) | ((a == 198) & b.isin(18, 19))
    # Of IPv6, 2000::/3 is public, but for what is set aside for protocols and documentation, and for tunnels.
    first, second = F.regexp_extract(host, "^([0-9a-f]{1,4}):", 1), F.lpad(F.regexp_extract(host, "^[0-9a-f]{1,4}:([0-9a-f]{0,4})", 1), 4, "0")
    set_aside = ((first == "2001") & ((second <= "01ff") | (second == "0db8"))) | (first == "2002") | ((first == "3fff") & (second <= "0fff"))
    private = F.when(host.contains(":"), ~first.rlike("^[23][0-9a-f]{3}$") | set_aside).otherwise(is_ip & F.coalesce(private, F.lit(False)))
    named = (host != "") & (host != "localhost") & ~host.endswith(".localhost")
    return F.coalesce(named & ~private, F.lit(False))


def safe_feed_url(url: Column) -> Column:
    """The address without its fragment if it may be shown, else null: http or https, no user, a public host, no secret key."""
    secret = F.exists(query_pairs(url), lambda p: F.lower(p["key"]).isin(SECRET_KEYS))
    good = url.rlike("(?i)^https?://") & ~url.rlike("^[^:]+://[^/?#]*@") & is_public_host(host_of(url)) & ~secret
    return F.when(good, without_fragment(url))
