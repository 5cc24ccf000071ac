"""Repository URLs."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from srcpulse.functions.text import strip

# --- fixed values: hosts and reason codes --------------------------------------------------------
PAGE_HOST = "github.com"
RAW_HOST = "raw.githubusercontent.com"
HOST_ALIASES = (("www.github.com", "github.com"),)
TREE_KINDS = ("blob", "tree")
EMPTY, NOT_HTTPS, BAD_HOST = "empty", "not_https", "host_not_allowed"
NO_REPOSITORY, NO_RAW_PATH = "missing_owner_or_repo", "missing_raw_path"
# -------------------------------------------------------------------------------------------------

_URL = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)"


def url_parts(url: Column) -> Column:
    """``struct<text, scheme, host, segments>`` of a URL; the port stays part of the host."""
    text = F.regexp_replace(strip(F.coalesce(url, F.lit(""))), r"[\t\r\n]", "")
    host = F.lower(F.element_at(F.split(F.regexp_extract(text, _URL, 2), "@"), -1))
    host = F.btrim(host, F.lit("."))
    for alias, name in HOST_ALIASES:
        host = F.when(host == alias, F.lit(name)).otherwise(host)
    path = F.regexp_replace(F.regexp_extract(text, _URL, 3), r";[^/]*$", "")
    return F.struct(
        text.alias("text"),
        F.lower(F.regexp_extract(text, _URL, 1)).alias("scheme"),
        host.alias("host"),
        F.filter(F.split(path, "/"), lambda p: p != "").alias("segments"),
    )


def source_url(parts: Column, allowed_hosts=(PAGE_HOST, RAW_HOST)) -> Column:
    """Owner, repository, ref and path of an accepted URL, or the reason it is refused."""
    seg, host = parts["segments"], parts["host"]
    n = F.size(seg)
    raw = host == RAW_HOST
    reason = (
        F.when(parts["text"] == "", F.lit(EMPTY))
        .when(parts["scheme"] != "https", F.lit(NOT_HTTPS))
        .when(~host.isin(*allowed_hosts), F.lit(BAD_HOST))
        .when(raw & (n < 4), F.lit(NO_RAW_PATH))
        .when(~raw & (n < 2), F.lit(NO_REPOSITORY))
    )
    tree = ~raw & (n >= 4) & F.get(seg, F.lit(2)).isin(*TREE_KINDS)
    ok = reason.isNull()

    def rest(first: int) -> Column:
        return F.when(n >= first, F.array_join(F.slice(seg, first, F.greatest(n, F.lit(1))), "/"))

    return F.struct(
        reason.alias("reason"),
        F.when(ok, F.get(seg, F.lit(0))).alias("owner"),
        F.when(ok, F.regexp_replace(F.get(seg, F.lit(1)), r"\.git$", "")).alias("repo"),
        F.when(ok, F.when(raw, F.get(seg, F.lit(2))).when(tree, F.get(seg, F.lit(3)))).alias("ref"),
        F.when(ok, F.when(raw, rest(4)).when(tree, rest(5))).alias("path_in_repo"),
        F.when(ok, raw).alias("is_raw_file"),
    )
