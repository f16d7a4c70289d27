"""URL policy and hosts."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.common import once

# --- fixed values: URL policy -----------------------------------------------
MAX_URL = 2000
ALLOWED_SCHEMES = ("https",)
UNSAFE_SCHEMES = ("javascript", "data", "file", "ftp", "vbscript", "blob")
# first and last address of each IPv4 range that is not a public unicast one
CLOSED_IPV4 = (
    ("0.0.0.0", "0.255.255.255"), ("10.0.0.0", "10.255.255.255"), ("100.64.0.0", "100.127.255.255"),
    ("127.0.0.0", "127.255.255.255"), ("169.254.0.0", "169.254.255.255"), ("172.16.0.0", "172.31.255.255"),
    ("192.0.0.0", "192.0.0.8"), ("192.0.0.11", "192.0.0.255"), ("192.0.2.0", "192.0.2.255"),
    ("192.168.0.0", "192.168.255.255"), ("198.18.0.0", "198.19.255.255"), ("198.51.100.0", "198.51.100.255"),
    ("203.0.113.0", "203.0.113.255"), ("224.0.0.0", "255.255.255.255"),
)


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def authority(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)


def host(url: Column) -> Column:
    """Lower-case host without credentials, port or brackets."""
    bare = F.regexp_replace(authority(url), "^.*@", "")
    v6 = F.regexp_extract(bare, r"^\[([^\]]*)\]", 1)
    return F.lower(F.when(bare.startswith("["), v6).otherwise(F.regexp_replace(bare, ":.*$", "")))


@F.pandas_udf(T.StringType())
def to_punycode(names: pd.Series) -> pd.Series:
    """IDNA form of non-ASCII host names; a name that has none stays as it is."""

    def encode(name):
        try:
            return name.encode("idna").decode("ascii").lower()
        except UnicodeError:
            return name.lower()

    return names.map(encode, na_action="ignore")


def url_host(url: Column) -> Column:
    """Host for identity; only non-ASCII names go to Python."""
    name = host(url)
    ascii_only = name.rlike(r"^[\x00-\x7F]*$")
    return F.coalesce(to_punycode(F.when(~ascii_only, name)), name)


def address_number(text: Column) -> Column:
    parts = F.split(text, r"\.")
    n = lambda i: F.get(parts, F.lit(i)).try_cast("long")
    return ((n(0) * 256 + n(1)) * 256 + n(2)) * 256 + n(3)


def is_ipv4(name: Column) -> Column:
    octet = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    return name.rlike(rf"^{octet}(\.{octet}){{3}}$")


def closed_ipv4(name: Column) -> Column:
    ranges = [(int(ipaddress.IPv4Address(a)), int(ipaddress.IPv4Address(b))) for a, b in CLOSED_IPV4]

    def inside(number):
        found = F.lit(False)
        for low, high in ranges:
            found = found | number.between(low, high)
        return found

    return F.coalesce(once(address_number(F.when(is_ipv4(name), name)), inside), F.lit(False))


@F.pandas_udf(T.BooleanType())
def closed_ipv6(names: pd.Series) -> pd.Series:
    """IPv6 literals that are not public unicast; mapped IPv4 is unwrapped."""

    def closed(name):
        try:
            address = ipaddress.ip_address(name)
        except ValueError:
            return False
        address = getattr(address, "ipv4_mapped", None) or address
        return not address.is_global or address.is_multicast or address.is_reserved

    return names.map(closed, na_action="ignore").astype("boolean")


def url_issue(value: Column, feeds: bool = False) -> Column:
    """Why a URL may not be stored or shown; NULL when it may."""
    url = F.trim(value)
    name = host(url)
    closed = F.lit(False)
    if feeds:
        closed = closed_ipv4(name) | F.coalesce(closed_ipv6(F.when(F.contains(name, F.lit(":")), name)), F.lit(False))
    parts = F.struct(
        url.alias("url"), scheme(url).alias("scheme"), authority(url).alias("authority"), name.alias("host"),
        closed.alias("closed"),
    )

    def judge(p):
        return (
            F.when(p["url"].isNull() | (p["url"] == ""), "empty")
            .when(F.length(p["url"]) > MAX_URL, "too_long")
            .when(p["url"].rlike(r"[\x00-\x1F\x7F]"), "control_characters")
            .when(p["url"].startswith("//"), "scheme_relative")
            .when(p["scheme"] == "", "no_scheme")
            .when(p["scheme"].isin(*UNSAFE_SCHEMES), "unsafe_scheme")
            .when(~p["scheme"].isin(*ALLOWED_SCHEMES), "scheme_not_allowed")
            .when((p["authority"] == "") | (F.lit(feeds) & (p["host"] == "")), "no_host")
            .when(F.contains(p["authority"], F.lit("@")), "credentials")
            .when(p["closed"], "closed_address")
        )

    return once(parts, judge)
