"""URL algebra as column expressions; malformed URLs give null parts and fall back to the trimmed input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track.
TRACKING = ("m", "ref", "source", "showcomment", "fbclid", "gclid")
# Second-level labels under which a registrable name has three labels.
SECOND_LEVEL = ("co", "com", "org", "net", "gov", "edu", "ac", "res", "mil", "ind", "gen", "firm", "or", "ne", "go")
# Extensions of paths that hold no page.
BINARY = (
    "png", "jpg", "jpeg", "gif", "webp", "svg", "bmp", "ico", "mp3", "mp4", "wav", "avi", "mkv", "mov", "flv", "zip", "tar", "gz", "7z", "rar", "bz2",
    "exe", "msi", "bin", "dmg", "apk", "css", "js", "json", "xml", "woff", "woff2", "ttf", "eot",
)


_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def part(url: Column, i: int) -> Column:
    """1 scheme, 2 authority, 3 path, 4 query; empty where missing."""
    return F.regexp_extract(F.trim(url), _PARTS, i)


def authority(url: Column) -> Column:
    return F.lower(part(url, 2))


def clean_host(url: Column) -> Column:
    """Lower-cased authority with every ``www.`` taken out, wherever it stands."""
    return F.replace(authority(url), F.lit("www."), F.lit(""))


def host(url: Column) -> Column:
    """Authority as it is, or the input where there is none."""
    a = part(url, 2)
    return F.when(a != "", a).otherwise(url)


def root_domain(host_: Column) -> Column:
    """Registrable part: three labels under a country's second-level label, else two."""
    p = F.split(F.replace(host_, F.lit("www."), F.lit("")), r"\.")
    n = F.size(p)
    last = lambda k: F.array_join(F.slice(p, -k, k), ".")
    deep = (n >= 3) & (F.length(F.get(p, n - 1)) == 2) & F.get(p, n - 2).isin(*SECOND_LEVEL)
    return F.when(deep, last(3)).when(n >= 2, last(2)).otherwise(host_)


def normalize(url: Column, base_authority: Column | None = None) -> Column:
    """Lower scheme and authority, https by default, www. as the base has it, no fragment, no last slash, no tracking parameters.

    Other parameters keep case, order and blanks; parameters without ``=`` get one. Null stays null.
    """
    scheme, a, path, query = (part(url, i) for i in (1, 2, 3, 4))
    scheme = F.when(scheme == "", "https").otherwise(F.lower(scheme))
    a = F.lower(a)
    if base_authority is not None:
        b = F.lower(base_authority)
        a = F.when((b != "") & (F.replace(a, F.lit("www."), F.lit("")) == F.replace(b, F.lit("www."), F.lit(""))), b).otherwise(a)
    path = F.when(path.isin("", "/"), "/").when(F.endswith(path, F.lit("/")), F.regexp_replace(path, "/$", "")).otherwise(path)
    name = lambda x: F.lower(F.substring_index(x, "=", 1))
    kept = F.filter(F.split(query, "&"), lambda x: (x != "") & ~name(x).isin(*TRACKING) & ~F.startswith(name(x), F.lit("utm_")))
    kept = F.transform(kept, lambda x: F.when(F.instr(x, "=") > 0, x).otherwise(F.concat(x, F.lit("="))))
    q = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(url.isNotNull(), F.concat(scheme, F.lit("://"), a, path, q))


def same_domain(url: Column, seed: Column, include_subdomains: bool) -> Column:
    x, s = clean_host(url), clean_host(seed)
    return (root_domain(x) == root_domain(s)) if include_subdomains else (x == s)


def crawlable(url: Column) -> Column:
    """http or https, and a path that doesn't end like a file."""
    return F.lower(part(url, 1)).isin("http", "https") & ~F.lower(part(url, 3)).rlike(r"\.(" + "|".join(BINARY) + ")$")


def storage_path(job_id: Column, seed: Column) -> Column:
    """File name of a job: id and host, with all but letters, digits, dot, dash and underscore replaced."""
    return F.concat(job_id, F.lit("_"), F.regexp_replace(clean_host(seed), r"[^A-Za-z0-9._-]", "_"), F.lit(".json"))


def stored_name(name: Column, longest: int = 120) -> Column:
    """Name of a stored upload: its last path part, all but word characters, blanks, dots, brackets and dashes replaced, cut."""
    return F.left(F.regexp_replace(F.substring_index(F.coalesce(name, F.lit("")), "/", -1), r"[^\p{L}\p{N}_ .()-]", "_"), F.lit(longest))


def backup_name(seed: Column, stamp: Column) -> Column:
    """File name of a backup of a site's replaced rows."""
    return F.concat(F.lit("qa-replaced-"), F.regexp_replace(site_label(seed), "[^a-z0-9.]+", "-"), F.lit("-"), stamp, F.lit(".json"))


def site_label(url: Column) -> Column:
    """Host without a leading ``www.``."""
    return F.regexp_replace(authority(url), r"^www\.", "")


def brand(url: Column) -> Column:
    """First label of the site's host, capitalised."""
    return F.initcap(F.substring_index(site_label(url), ".", 1))
