"""Which repository sources are accepted, and the one spelling under which a source is registered."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from ..functions.text import BLANK

_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"
#: What a scheme looks like, with or without slashes after it.
_SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*):"
#: A host that is an address: dotted numbers, or anything with a colon, which only stands inside brackets.
_LITERAL = r"^[0-9]+(?:\.[0-9]+){3}$|:"


def _address(host: str | None) -> bool | None:
    """Whether an address is publicly routed; null if the text is none."""
    try:
        return None if host is None else ipaddress.ip_address(host).is_global
    except ValueError:
        return None


@F.pandas_udf(BooleanType())
def public_address(host: pd.Series) -> pd.Series:
    """Whether a host that is a literal address is publicly routed; null for what is no address."""
    known = host.dropna().map(_address)
    return known.reindex(host.index).astype("boolean")


def verdict(source: Column) -> Column:
    """``local``, ``https``, or the reason why a source is refused: a code that begins with ``bad_``.

    A letter and a colon are a drive unless what follows has a scheme itself. Anything else that begins like a scheme
    has one, slashes or not. Only hosts that look like addresses are handed to Python.
    """
    authority = F.regexp_extract(source, _HOST, 1)
    bare = F.regexp_replace(authority, r"^.*@", "")
    bracket = F.startswith(bare, F.lit("["))
    host = F.when(bracket, F.regexp_extract(bare, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_extract(bare, r"^([^:]*)", 1))
    after = F.when(bracket, F.regexp_replace(bare, r"^\[[^\]]*\]?", "")).otherwise(F.regexp_replace(bare, r"^[^:]*", ""))
    port = F.regexp_extract(after, r"^:(.*)$", 1)
    path = F.regexp_replace(F.regexp_replace(source, _HOST, ""), r"[?#].*$", "")
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    low = F.regexp_replace(F.lower(host), r"\.+$", "")
    scheme = F.lower(F.regexp_extract(source, _SCHEME, 1))
    drive = source.rlike(r"(?s)^[A-Za-z]:.") & ~F.substring(source, F.lit(3), F.length(source)).rlike(_SCHEME)
    public = public_address(F.when(host.rlike(_LITERAL), host))
    torn = (F.contains(bare, F.lit("[")) | F.contains(bare, F.lit("]"))) & (~bare.rlike(r"^\[[^\[\]]*\](?::.*)?$") | public.isNull())
    https = (
        F.when(source.rlike(r"\s"), "bad_whitespace")
        .when(F.contains(source, F.lit("\\")), "bad_backslash")
        .when(F.contains(source, F.lit("?")), "bad_query")
        .when(F.contains(source, F.lit("#")), "bad_fragment")
        .when(torn, "bad_url")
        .when((port != "") & (~port.rlike(r"^0*[0-9]{1,5}$") | (port.try_cast("int") > 65535)), "bad_url")
        .when(host == "", "bad_host")
        .when(F.contains(authority, F.lit("@")), "bad_credentials")
        .when(F.endswith(authority, F.lit(":")), "bad_port")
        .when(port.try_cast("int") == 0, "bad_port")
        .when(F.size(parts) == 0, "bad_path")
        .when(F.exists(parts, lambda p: p.isin(".", "..")), "bad_dot_path")
        .when((low == "localhost") | F.endswith(low, F.lit(".localhost")), "bad_localhost")
        .when(~F.coalesce(public, F.lit(True)), "bad_address")
        .otherwise("https")
    )
    return (
        F.when(source.isNull() | (F.regexp_replace(source, BLANK, "") == ""), "bad_empty")
        .when(source.rlike("^" + BLANK) | source.rlike(BLANK + "$"), "bad_margin")
        .when(source.rlike(r"[\x00-\x1F\x7F-\x9F]"), "bad_control")
        .when(drive, "local")
        .when(scheme == "https", https)
        .when(scheme != "", "bad_scheme")
        .when(source.rlike(r"^[^/\\\s@]+@[^/\\\s:]+:.+"), "bad_scp")
        .otherwise("local")
    )


def canonical(source: Column, host: str = "github.com") -> Column:
    """(source, name) under which an https source of a forge is registered, null for any other.

    Owner and name are lower-cased, ``.git`` and one final slash go; an owner has 1-39 letters, digits and single
    inner dashes, a name 1-100 letters, digits, dots, dashes and underscores.
    """
    escaped = host.replace(".", r"\.")
    shape = rf"^(?i:https)://(?i:{escaped})(?::443)?/([A-Za-z0-9-]+)/([A-Za-z0-9_.-]+)/?$"
    owner = F.lower(F.regexp_extract(source, shape, 1))
    name = F.regexp_replace(F.lower(F.regexp_extract(source, shape, 2)), r"\.git$", "")
    good = owner.rlike(r"^[a-z0-9](?:-?[a-z0-9]){0,38}$") & (F.length(owner) <= 39) & F.length(name).between(1, 100) & ~name.isin(".", "..")
    return F.when(good, F.struct(F.concat(F.lit(f"https://{host}/"), owner, F.lit("/"), name).alias("source"), name.alias("name")))
