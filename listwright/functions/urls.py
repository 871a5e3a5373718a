"""Canonical URLs and judgments on URLs and source names, as column expressions.

Percent-encoding, dot segments and IPv4 short forms are taken as written.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from listwright.fixed import (
    LOOPBACK_HOSTS,
    NON_ATTRIBUTABLE_NAMES,
    PLACEHOLDER_HOST_TOKENS,
    PLACEHOLDER_PATH_SEGMENTS,
    PLACEHOLDER_TLDS,
)
from listwright.functions.text import trimmed

_HOST = r"(\[[0-9A-Fa-f:.]+\]|[^\s/?#:@\\<>\[\]^|%]+)"
# scheme, host, path of a web address; user info and port are left out
_WEB = rf"(?is)^(https?|ftp|wss?):[/\\]*(?:[^/?#@\\]*@)?{_HOST}(?::\d{{0,5}})?([/\\][^?#]*)?(?:[?#].*)?$"
# any other scheme that is followed by something
_OTHER = r"(?is)^(?!(?:https?|ftp|wss?):)([a-z][a-z0-9+.\-]*):(?://(?:[^/?#@]*@)?([^/?#:]*)(?::\d*)?)?([^?#]*)(?:[?#].*)?$"


def parsed(url: Column) -> Column:
    """struct(ok, scheme, host, path). Jobs that need it twice keep it as a column of its own."""
    t = trimmed(url)
    web_host = F.regexp_extract(t, _WEB, 2)
    web = web_host != ""
    return F.struct(
        (web | t.rlike(_OTHER)).alias("ok"),
        F.lower(F.regexp_extract(t, r"(?i)^([a-z][a-z0-9+.\-]*):", 1)).alias("scheme"),
        F.lower(F.when(web, web_host).otherwise(F.regexp_extract(t, _OTHER, 2))).alias("host"),
        F.when(web, F.regexp_extract(t, _WEB, 3)).otherwise(F.regexp_extract(t, _OTHER, 3)).alias("path"),
    )


def canonical_url(url: Column, parts: Column | None = None) -> Column:
    """Scheme and lower-case host without ``www.``, then the path without trailing slashes."""
    p = parsed(url) if parts is None else parts
    rebuilt = F.concat(p["scheme"], F.lit("://"), F.regexp_replace(p["host"], r"^www\.", ""), F.regexp_replace(p["path"], "/+$", ""))
    return F.when(p["ok"], rebuilt).otherwise(trimmed(url))


def is_http_url(url: Column) -> Column:
    return F.coalesce(url.rlike(r"(?i)^https?://[^\s/$.?#].[^\s]*$"), F.lit(False))


def placeholder_reasons(url: Column, parts: Column | None = None) -> Column:
    """Why a URL cannot point at a real listing; empty for a genuine one."""
    p = parsed(url) if parts is None else parts
    ok, scheme, host, path = p["ok"], p["scheme"], p["host"], p["path"]
    labels = F.split(host, r"\.")
    tokens = F.flatten(F.transform(labels, lambda label: F.split(label, "-")))
    tld = F.element_at(labels, -1)
    one = lambda condition, message: F.when(condition, F.array(message)).otherwise(F.array().cast("array<string>"))
    reasons = F.concat(
        one(~scheme.isin("http", "https"), F.concat(F.lit("protocol '"), scheme, F.lit(":' is not http(s)"))),
        one(host.isin(LOOPBACK_HOSTS), F.concat(F.lit("'"), host, F.lit("' is a loopback address, not a public listing"))),
        one(tld.isin(PLACEHOLDER_TLDS), F.concat(F.lit("'."), tld, F.lit("' is a reserved/non-public TLD"))),
        F.transform(
            F.filter(tokens, lambda t: t.isin(PLACEHOLDER_HOST_TOKENS)),
            lambda t: F.concat(F.lit("hostname '"), host, F.lit("' contains placeholder token '"), t, F.lit("'")),
        ),
        F.transform(
            F.filter(F.split(path, "/"), lambda s: F.lower(s).isin(PLACEHOLDER_PATH_SEGMENTS)),
            lambda s: F.concat(F.lit("URL path contains placeholder segment '/"), s, F.lit("/'")),
        ),
    )
    blank = url.isNull() | (trimmed(url) == "")
    return (
        F.when(blank, F.array(F.lit("no URL supplied")))
        .when(~ok, F.array(F.concat(F.lit("'"), url, F.lit("' is not a parseable URL"))))
        .otherwise(F.array_distinct(reasons))
    )


def is_placeholder_url(url: Column) -> Column:
    return F.size(placeholder_reasons(url)) > 0


_NAME_TOKENS = "|".join(re.sub("[^a-z0-9]", "[^a-z0-9]", n) for n in NON_ATTRIBUTABLE_NAMES)


def is_non_attributable(name: Column) -> Column:
    """Blank, or a stand-in name on its own or between non-letters."""
    low = F.lower(trimmed(name))
    return F.coalesce((low == "") | low.rlike(rf"(^|[^a-z])({_NAME_TOKENS})([^a-z]|$)"), F.lit(True))
