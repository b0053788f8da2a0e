"""URL functions as Spark columns.  The site's own paths are parameters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The paths of legacy addresses and the suffixes that are content ids.
SUFFIX_ID = r"-(0ap[0-9]+|09000[a-f0-9]+)$"
LEGACY = r"(?i)^/news/story/([^/]+)(?:/(article|comments)(?:/(.*))?)?/?$"
# Path parts that make a page navigation.
NAV_PARTS = ["author", "writer", "series", "video", "videos", "photos", "watch", "schedules", "scores", "teams", "sitemap", "search"]


def clean_url(u: Column, bare_host: str = "pigskin-ledger.example") -> Column:
    """Unwrapped from an archive address, without query, fragment, trailing slashes and default port, as https, with www."""
    u = F.trim(u)
    inner = F.regexp_extract(u, r"/web/\d+(?:[a-z]+_)?/(https?://.*)$", 1)
    u = F.when(inner != "", inner).otherwise(u)
    u = F.rtrim(F.trim(F.substring_index(F.substring_index(u, "?", 1), "#", 1)), F.lit("/"))
    u = F.regexp_replace(u, r"^(https?://[^/:]+):(?:80|443)(?=/|$)", "$1")
    u = F.regexp_replace(u, "^http://", "https://")
    return F.regexp_replace(u, "^https://" + bare_host.replace(".", r"\.") + "(?=/|$)", "https://www." + bare_host)


def path_of(clean: Column) -> Column:
    return F.regexp_extract(clean, r"^[a-z]+://[^/]*(/.*)?$", 1)


def content_id(clean: Column) -> Column:
    """The content id of a legacy address, '' for others."""
    return F.lower(F.regexp_extract(path_of(clean), LEGACY, 1))


def any_content_id(clean: Column) -> Column:
    """The content id of a legacy path, else the one an address ends with, else ''."""
    own = content_id(clean)
    return F.when(own != "", own).otherwise(F.regexp_extract(clean, SUFFIX_ID, 1))


def allowed(u: Column, hosts: list[str], exact: list[str], prefixes: list[str]) -> Column:
    """Whether an address is on one of the hosts and its path is one of the exact ones or begins with a prefix."""
    host = F.regexp_extract(u, r"^[a-z]+://([^/:?#]*)", 1)
    path = F.regexp_extract(u, r"^[a-z]+://[^/?#]*([^?#]*)", 1)
    below = F.lit(False)
    for x in prefixes:
        below = below | path.startswith(x)
    return host.isin(*hosts) & (path.isin(*exact) | below)


def _resolved(path: Column) -> Column:
    """A path without its '.' and '..' parts."""
    parts = F.filter(F.split(path, "/"), lambda x: x != ".")
    up = lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1)))).otherwise(F.array_append(acc, x))
    return F.array_join(F.aggregate(F.slice(parts, 2, 10_000), F.slice(parts, 1, 1), up), "/")


def resolve(base: Column, href: Column) -> Column:
    """``join_url`` with the parts '.' and '..' of a relative link's path worked off."""
    u = join_url(base, href)
    root, rest = F.regexp_extract(u, "^([a-z]+://[^/?#]*)", 1), F.regexp_extract(u, "^[a-z]+://[^/?#]*(.*)$", 1)
    path = F.regexp_extract(rest, "^([^?#]*)", 1)
    end = F.when(path.rlike(r"/\.{1,2}$"), "/").otherwise("")
    relative = ~href.rlike(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:|//)")
    return F.when(relative & (root != "") & path.rlike(r"(?:^|/)\.{1,2}(?:/|$)"), F.concat(root, _resolved(path), end, F.regexp_extract(rest, "^[^?#]*(.*)$", 1))).otherwise(u)


def canonical(clean: Column) -> Column:
    """Identity of an address: its content id whatever view or slug, else the clean address."""
    i = content_id(clean)
    return F.when(i != "", F.concat(F.lit("legacy:"), i)).otherwise(clean)


def kind(raw: Column, clean: Column, section: str = "around-the-gridiron") -> Column:
    """nav, index, pagination, article or unknown; the first rule that fits."""
    path = path_of(clean)
    parts = F.split(F.regexp_replace(path, "^/+|/+$", ""), "/")
    tail = F.array_join(F.slice(parts, 3, 100), "/")
    return (
        F.when(raw.rlike(r"[{}]") | F.arrays_overlap(parts, F.array(*[F.lit(x) for x in NAV_PARTS])), "nav")
        .when(path.isin("/news", "/news/story", f"/blogs/{section}", f"/news/{section}"), "index")
        .when(path.rlike(rf"^/news/{section}_\d+/\d+$"), "pagination")
        .when(path.rlike(rf"^/(?:news|blogs)/{section}/\d+$"), "index")
        .when(tail.rlike(r"^(?:\d{1,4}[-/]){2}\d{1,4}$"), "index")
        .when(path.rlike(LEGACY), F.when(F.regexp_extract(path, LEGACY, 3) != "", "article").otherwise("index"))
        .when((F.size(parts) == 2) & (F.get(parts, F.lit(0)) == "news") & F.contains(F.get(parts, F.lit(1)), F.lit("-")), "article")
        .otherwise("unknown")
    )


def legacy_view(clean: Column, view: str, root: str) -> Column:
    """Address of the article or comments view of a legacy address; the clean address for others."""
    path = path_of(clean)
    slug = F.regexp_extract(path, LEGACY, 3)
    built = F.concat(F.lit(root + "/news/story/"), F.regexp_extract(path, LEGACY, 1), F.lit("/" + view), F.when(slug != "", F.concat(F.lit("/"), slug)).otherwise(""))
    return F.when(path.rlike(LEGACY), built).otherwise(clean if view == "article" else F.lit(None).cast("string"))


def slugify(u: Column) -> Column:
    """Name for an address: its last part tidied, cut at 90, and six digits of its MD5."""
    tail = F.substring_index(F.rtrim(u, F.lit("/")), "/", -1)
    tail = F.substring(F.regexp_replace(F.regexp_replace(F.lower(tail), r"[^a-z0-9-]+", "-"), r"^-+|-+$", ""), 1, 90)
    return F.concat(F.when(tail == "", "article").otherwise(tail), F.lit("-"), F.substring(F.md5(u), 1, 6))


def archive_stamp(u: Column) -> Column:
    """The 14-digit stamp in an archive address, '' if there is none."""
    return F.regexp_extract(u, r"/web/(\d{14})", 1)


def join_url(base: Column, href: Column) -> Column:
    """A link resolved against the page it stands on: absolute, protocol-relative, root-relative, or relative to the directory."""
    scheme = F.regexp_extract(base, "^([a-z]+:)", 1)
    root = F.regexp_extract(base, "^([a-z]+://[^/]*)", 1)
    directory = F.regexp_extract(F.substring_index(F.substring_index(base, "#", 1), "?", 1), "^(.*/)[^/]*$", 1)
    return (
        F.when(href.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("/"), F.concat(root, href))
        .when((href == "") | href.startswith("#"), F.concat(F.substring_index(base, "#", 1), href))
        .otherwise(F.concat(F.when(F.length(directory) > F.length(root) + 1, directory).otherwise(F.concat(root, F.lit("/"))), href))
    )


def url_quote(c: Column) -> Column:
    """Percent-encoded, spaces too."""
    return F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))


def action_links(original: Column, retrieved: Column, source_type: Column, iso_date: Column, archive: str) -> Column:
    """array of (label, url): the piece, its captures, and the captures of its month where the date is known."""
    query = F.concat(F.lit(archive + "/cdx/search/cdx?url="), F.url_encode(original), F.lit("&output=json&filter=statuscode%3A200"))
    link = lambda label, url: F.struct(F.lit(label).alias("label"), url.alias("url"))
    links = F.array(
        link("Read this piece", F.when(source_type.startswith("live"), original).otherwise(retrieved)),
        link("All captures", F.concat(F.lit(archive + "/web/*/"), original)),
        link("Closest capture", F.concat(F.lit(archive + "/web/2/"), original)),
        link("Raw capture list", query),
    )
    month = F.replace(F.substring(iso_date, 1, 7), F.lit("-"), F.lit(""))
    return F.when(F.coalesce(iso_date, F.lit("")) == "", links).otherwise(F.array_insert(links, 4, link("Captures in publication month", F.concat(query, F.lit("&from="), month, F.lit("&to="), month))))
