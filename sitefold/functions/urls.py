"""URL column functions (U1-U7, K3), following the stdlib urlsplit/urlparse/urljoin rules.

Everything is a native expression: regex splits, string functions and one ``aggregate`` fold for
dot-segment removal.  No Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------------------------
# Extensions that mark a URL as not a web page (lower-cased path suffixes).
SKIP_EXTENSIONS = [
    ".pdf", ".jpg", ".jpeg", ".png", ".gif", ".svg", ".webp",
    ".css", ".js", ".json", ".xml", ".zip", ".tar", ".gz",
    ".mp4", ".mp3", ".avi", ".mov", ".woff", ".woff2", ".ttf", ".eot",
    ".ico", ".dmg", ".exe", ".pkg", ".deb", ".rpm",
]
# Schemes for which the stdlib URL parser splits ';params', keeps '//netloc' and resolves
# relative references (urllib.parse.uses_params / uses_netloc / uses_relative).
USES_PARAMS = ["", "ftp", "hdl", "prospero", "http", "imap", "https", "shttp", "rtsp", "rtsps", "rtspu",
               "sip", "sips", "mms", "sftp", "tel"]
USES_NETLOC = ["", "ftp", "http", "gopher", "nntp", "telnet", "imap", "wais", "file", "mms", "https",
               "shttp", "snews", "prospero", "rtsp", "rtsps", "rtspu", "rsync", "svn", "svn+ssh", "sftp",
               "nfs", "git", "git+ssh", "ws", "wss", "itms-services"]
USES_RELATIVE = ["", "ftp", "http", "gopher", "nntp", "imap", "wais", "file", "https", "shttp", "mms",
                 "prospero", "rtsp", "rtsps", "rtspu", "sftp", "svn", "svn+ssh", "ws", "wss"]
# ----------------------------------------------------------------------------------------------

SKIP_EXT_RE = "(" + "|".join(e.replace(".", "\\.") for e in SKIP_EXTENSIONS) + ")$"

# scheme ':' ? ('//' netloc)? path ('?' query)? ('#' fragment)?
SPLIT_RE = "^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\\?([^#]*))?(?:#(.*))?$"


def _prep(url: Column) -> Column:
    # the stdlib drops leading C0/space characters and every tab / CR / LF (one regex pass)
    return F.regexp_replace(url, "^[\\x{00}-\\x{20}]+|[\\t\\r\\n]", "")


PARTS = ("scheme", "netloc", "path", "params", "query", "fragment")


def add_url_parts(df: DataFrame, url: str, prefix: str, default_scheme: str | None = None) -> DataFrame:
    """Add ``{prefix}_scheme/_netloc/_path/_params/_query/_fragment`` for column ``url``.

    The split runs in two projections of flat columns so Catalyst keeps each regex evaluated
    once (a struct would be inlined field by field).  ``default_scheme`` names a column whose
    value stands in for a missing scheme (urljoin's rule for the reference being resolved).
    """
    p = prefix
    df = df.withColumn(f"_{p}_u", _prep(F.col(url)))
    u = F.col(f"_{p}_u")
    scheme = F.lower(F.regexp_extract(u, SPLIT_RE, 1))
    if default_scheme is not None:
        scheme = F.when(scheme == "", F.col(default_scheme)).otherwise(scheme)
    df = df.withColumns({
        f"{p}_scheme": scheme,
        f"{p}_netloc": F.regexp_extract(u, SPLIT_RE, 2),
        f"_{p}_fp": F.regexp_extract(u, SPLIT_RE, 3),
        f"{p}_query": F.regexp_extract(u, SPLIT_RE, 4),
        f"{p}_fragment": F.regexp_extract(u, SPLIT_RE, 5),
    })
    fp = F.col(f"_{p}_fp")
    df = df.withColumn(f"_{p}_ls", F.regexp_extract(fp, "([^/]*)$", 1))
    last = F.col(f"_{p}_ls")
    has_params = F.col(f"{p}_scheme").isin(USES_PARAMS) & (F.instr(last, ";") > 0)
    before = F.substring_index(last, ";", 1)
    df = df.withColumns({
        f"{p}_path": F.when(has_params, F.concat(F.substring(fp, F.lit(1), F.length(fp) - F.length(last)), before)).otherwise(fp),
        f"{p}_params": F.when(has_params, F.substring(last, F.length(before) + 2, 1 << 30)).otherwise(F.lit("")),
    })
    return df.drop(f"_{p}_u", f"_{p}_fp", f"_{p}_ls")


def drop_url_parts(df: DataFrame, prefix: str) -> DataFrame:
    return df.drop(*[f"{prefix}_{x}" for x in PARTS])


def part(prefix: str, name: str) -> Column:
    return F.col(f"{prefix}_{name}")


def unsplit(scheme: Column, netloc: Column, path: Column, params: Column, query: Column, fragment: Column) -> Column:
    """stdlib urlunparse, written as a concat of independent pieces so every input is referenced
    a bounded number of times (nested CASE chains would copy the path expression per branch)."""
    has_params = params != ""
    p_empty = (path == "") & ~has_params
    p_slash = path.startswith("/")
    p_dslash = path.startswith("//")
    authority = (
        F.when(netloc != "", F.concat(F.lit("//"), netloc))
        .when(p_dslash, F.lit("//"))
        .when((scheme != "") & scheme.isin(USES_NETLOC) & (p_empty | p_slash), F.lit("//"))
        .otherwise(F.lit(""))
    )
    return F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(F.lit("")),
        authority,
        F.when((netloc != "") & ~p_empty & ~p_slash, F.lit("/")).otherwise(F.lit("")),
        path,
        F.when(has_params, F.concat(F.lit(";"), params)).otherwise(F.lit("")),
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")),
        F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(F.lit("")),
    )


def normalized_path(prefix: str) -> Column:
    """Path with every trailing '/' removed, '/' when nothing is left."""
    return F.regexp_replace(F.regexp_replace(part(prefix, "path"), "/+$", ""), "^$", "/")


def add_normalized(df: DataFrame, prefix: str, out: str) -> DataFrame:
    """U1 over split parts: lower scheme and netloc, strip every trailing '/', empty path -> '/',
    keep params and query, drop the fragment."""
    df = df.withColumn(f"_{prefix}_np", normalized_path(prefix))
    df = df.withColumn(out, unsplit(part(prefix, "scheme"), F.lower(part(prefix, "netloc")), F.col(f"_{prefix}_np"),
                                    part(prefix, "params"), part(prefix, "query"), F.lit("")))
    return df.drop(f"_{prefix}_np")


def normalized(prefix: str) -> Column:
    """U1 as one column (the path expression is inlined a few times; prefer ``add_normalized``)."""
    return unsplit(part(prefix, "scheme"), F.lower(part(prefix, "netloc")), normalized_path(prefix),
                   part(prefix, "params"), part(prefix, "query"), F.lit(""))


def site_of(prefix: str) -> Column:
    """U2 key: lower-cased netloc; two URLs are same-domain when their keys are equal."""
    return F.lower(part(prefix, "netloc"))


def path_prefix_of(prefix: str) -> Column:
    """First path segment after trimming '/', '' for the root."""
    return F.substring_index(F.regexp_replace(part(prefix, "path"), "^/+|/+$", ""), "/", 1)


def crawlable(prefix: str) -> Column:
    """U4: http(s) scheme and a path not ending in a skipped extension."""
    return part(prefix, "scheme").isin("http", "https") & ~F.lower(part(prefix, "path")).rlike(SKIP_EXT_RE)


def without_fragment(prefix: str) -> Column:
    """The URL re-assembled without its fragment."""
    return unsplit(part(prefix, "scheme"), part(prefix, "netloc"), part(prefix, "path"),
                   part(prefix, "params"), part(prefix, "query"), F.lit(""))


def hostname_of(prefix: str) -> Column:
    """K3: host without userinfo and port, lower case (IPv6 brackets dropped)."""
    host = F.regexp_replace(part(prefix, "netloc"), "^.*@", "")
    return F.lower(F.when(host.startswith("["), F.regexp_extract(host, "^\\[([^\\]]*)\\]", 1))
                   .otherwise(F.regexp_replace(host, ":[^:]*$", "")))


def _remove_dots(segments: Column) -> Column:
    """Resolve '.' and '..' segments (stdlib urljoin loop; popping past the root is ignored)."""
    resolved = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, seg: F.when(seg == "..", F.when(F.size(acc) > 0, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc))
        .when(seg == ".", acc)
        .otherwise(F.concat(acc, F.array(seg))),
    )
    return F.when(F.element_at(segments, -1).isin(".", ".."), F.concat(resolved, F.array(F.lit("")))).otherwise(resolved)


def add_resolved(df: DataFrame, base: str, href: str, out: str, base_prefix: str = "b", href_prefix: str = "h") -> DataFrame:
    """``out = urljoin(base, href)`` for two string columns (stdlib rules: an href scheme
    that differs from the base is returned as is, '//host' replaces the authority, an empty path
    keeps the base path and query, otherwise RFC 3986 merge and dot-segment removal)."""
    b, h = base_prefix, href_prefix
    df = add_url_parts(df, base, b)
    df = add_url_parts(df, href, h, default_scheme=f"{b}_scheme")
    hs, hn, hp, hpar, hq, hf = (part(h, x) for x in PARTS)
    netloc_ = F.when(hs.isin(USES_NETLOC) & (hn == ""), part(b, "netloc")).otherwise(hn)

    base_parts = F.split(part(b, "path"), "/", -1)
    base_dir = F.when(F.element_at(base_parts, -1) != "", F.slice(base_parts, 1, F.size(base_parts) - 1)).otherwise(base_parts)
    df = df.withColumn("_rel", F.when(hp.startswith("/"), F.split(hp, "/", -1)).otherwise(F.concat(base_dir, F.split(hp, "/", -1))))
    rel, n = F.col("_rel"), F.size(F.col("_rel"))
    tidy = F.when(~hp.startswith("/") & (n > 2),
                  F.concat(F.slice(rel, 1, 1), F.filter(F.slice(rel, 2, n - 2), lambda x: x != ""), F.slice(rel, n, 1))).otherwise(rel)
    joined = F.regexp_replace(F.array_join(_remove_dots(tidy), "/"), "^$", "/")

    df = df.withColumn("_net", netloc_)
    df = df.withColumn("_joined", joined)
    net = F.col("_net")
    merged = unsplit(hs, net, F.col("_joined"), hpar, hq, hf)
    no_path = unsplit(hs, net, part(b, "path"), part(b, "params"), F.when(hq == "", part(b, "query")).otherwise(hq), hf)
    absolute = unsplit(hs, hn, hp, hpar, hq, hf)
    result = (
        F.when(F.coalesce(F.col(base), F.lit("")) == "", F.col(href))
        .when(F.coalesce(F.col(href), F.lit("")) == "", F.col(base))
        .when((hs != part(b, "scheme")) | ~hs.isin(USES_RELATIVE), F.col(href))
        .when(hs.isin(USES_NETLOC) & (hn != ""), absolute)
        .when((hp == "") & (hpar == ""), no_path)
        .otherwise(merged)
    )
    df = df.withColumn(out, result)
    return drop_url_parts(drop_url_parts(df, b), h).drop("_rel", "_joined", "_net")
