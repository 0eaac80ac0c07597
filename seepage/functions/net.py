"""URL and address helpers on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IPV4 = rf"^(?:{_OCTET}\.){{3}}{_OCTET}\z"

# Private and loopback IPv4 blocks, as the start of an address,
# without the two public addresses inside 192.0.0.0/24.
PRIVATE_BLOCKS = [
    r"0\.", r"10\.", r"127\.", r"169\.254\.", r"172\.(?:1[6-9]|2[0-9]|3[01])\.",
    r"192\.0\.0\.(?!9\z|10\z)", r"192\.0\.2\.", r"192\.168\.", r"198\.1[89]\.",
    r"198\.51\.100\.", r"203\.0\.113\.", r"2(?:4[0-9]|5[0-5])\.",
]
_PRIVATE = f"^(?:{'|'.join(PRIVATE_BLOCKS)})"


def valid_ipv4(address: Column) -> Column:
    """Four octets up to 255 without leading zeros."""
    return F.coalesce(address.rlike(_IPV4), F.lit(False))


def private_ipv4(address: Column) -> Column:
    """True for a valid address in a private or loopback block."""
    return valid_ipv4(address) & address.rlike(_PRIVATE)


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.\-]*):", 1))


def authority(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//([^/?#]*)", 1)


def origin(url: Column) -> Column:
    """Scheme and authority, the usual target of a captured URL."""
    return F.regexp_extract(url, r"^https?://[^/?#]+", 0)


def hostname(url: Column) -> Column:
    """Host without user and port, lower case; the text itself when it has none."""
    host_port = F.substring_index(authority(url), "@", -1)
    bracket = F.regexp_extract(host_port, r"^\[([^\]]*)\]", 1)
    host = F.lower(F.when(bracket != "", bracket).otherwise(F.substring_index(host_port, ":", 1)))
    return F.when(host != "", host).when(authority(url) != "", authority(url)).otherwise(url)


def join_path(target: Column, path: Column) -> Column:
    return F.concat(target, F.lit("/"), F.regexp_replace(path, r"^/+", ""))


def path_of(url: Column, target: Column) -> Column:
    """What follows ``target/``; null when the URL is not below the target."""
    return F.when(F.startswith(url, F.concat(target, F.lit("/"))), F.substring(url, F.length(target) + 2, F.length(url)))


def sub_url(target: Column, label: Column) -> Column:
    netloc = F.when(authority(target) != "", authority(target)).otherwise(target)
    return F.concat(scheme(target), F.lit("://"), label, F.lit("."), netloc)


def resolve(target: Column, src: Column) -> Column:
    """Absolute URL of a script reference found on a page of ``target``."""
    return (
        F.when(F.startswith(src, F.lit("http://")) | F.startswith(src, F.lit("https://")), src)
        .when(F.startswith(src, F.lit("//")), F.concat(scheme(target), F.lit(":"), src))
        .when(F.startswith(src, F.lit("/")), F.concat(scheme(target), F.lit("://"), authority(target), src))
        .otherwise(F.concat(F.regexp_replace(target, "/+$", ""), F.lit("/"), src))
    )
