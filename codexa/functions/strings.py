"""Media types, hrefs, identifiers and subject lists as column expressions (no Python on the executors)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Canonical extension of a media type.
EXTENSIONS = {
    "image/jpeg": "jpg",
    "image/jpg": "jpg",
    "image/png": "png",
    "image/gif": "gif",
    "image/svg+xml": "svg",
    "image/webp": "webp",
    "image/bmp": "bmp",
    "image/x-ms-bmp": "bmp",
    "application/octet-stream": "bin",
    "application/x-font-ttf": "ttf",
}
# Media types.
PLAIN = "text/plain"
HTML_TYPES = ("text/html", "application/xhtml+xml", "application/x-mobipocket-html", "text/x-oeb1-document")
FB2_BODY, FB3_BODY = "application/x-fictionbook-body+xml", "application/fb3-body+xml"
PML, LRF_TEXT = "application/x-ereader-pml", "application/x-lrf-text"
CONVERTIBLE = (*HTML_TYPES, FB2_BODY, FB3_BODY, PML, LRF_TEXT, PLAIN)
TEXTUAL = (*HTML_TYPES, FB2_BODY, FB3_BODY, PML, LRF_TEXT, "application/x-dtbncx+xml", "application/oebps-package+xml", "text/css", "image/svg+xml", "application/xml", "application/json")
# Extensions of files in a compiled help archive.
HELP_TYPES = {
    "htm": "text/html", "html": "text/html", "hhc": "text/html", "hhk": "text/html", "xhtml": "application/xhtml+xml", "css": "text/css", "txt": "text/plain", "xml": "application/xml",
    "js": "application/javascript", "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "svg": "image/svg+xml", "bmp": "image/bmp", "webp": "image/webp",
}

NAME = "[A-Za-z][A-Za-z0-9+.-]*"


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def trim(c: Column) -> Column:
    """Without white space (Unicode) at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squash(c: Column) -> Column:
    """White space runs as one space, trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


# media types


def mime_normalize(c: Column) -> Column:
    """Lower case, without parameters and outer white space; blank gives ''."""
    return F.lower(trim(F.substring_index(c, ";", 1)))


def mime_extension(c: Column) -> Column:
    """Canonical file extension, null if unknown."""
    return F.try_element_at(_map(EXTENSIONS), mime_normalize(c))


def is_text(c: Column) -> Column:
    """Whether a media type names text whose bytes have a charset."""
    m = mime_normalize(c)
    return m.startswith("text/") | m.endswith("+xml") | m.endswith("+json") | m.isin(*TEXTUAL)


def can_convert(c: Column) -> Column:
    """Whether a default conversion to plain text exists (plain text itself included)."""
    return mime_normalize(c).isin(*CONVERTIBLE)


def image_type(content: Column) -> Column:
    """Media type by an image's first bytes; octet-stream if unknown."""
    head, text = F.hex(F.substring(content, 1, 8)), F.regexp_replace(F.decode(F.substring(content, 1, 1024), "ISO-8859-1"), r"^\s+", "")
    return (
        F.when(head.startswith("FFD8FF"), "image/jpeg")
        .when(head.startswith("89504E47") & (F.octet_length(content) >= 8), "image/png")
        .when(head.startswith("474946"), "image/gif")
        .when(text.startswith("<svg") | text.contains("<?xml"), "image/svg+xml")
        .otherwise("application/octet-stream")
    )


def help_type(path: Column) -> Column:
    """Media type of a file in a compiled help archive, by extension."""
    return F.coalesce(F.try_element_at(_map(HELP_TYPES), F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))), F.lit("application/octet-stream"))


# hrefs


def cut_href(c: Column) -> Column:
    """Without fragment and query."""
    return F.regexp_extract(c, "^[^#?]*", 0)


def clean_path(c: Column) -> Column:
    """Lexically shortest equal path: no '//', '.', inner '..'; '' gives '.'."""
    rooted = c.startswith("/")
    names = F.filter(F.split(c, "/"), lambda s: (s != "") & (s != "."))

    def step(done: Column, name: Column) -> Column:
        back = (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1)) != "..")
        up = F.when(back, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(rooted, done).otherwise(F.concat(done, F.array(F.lit(".."))))
        return F.when(name == "..", up).otherwise(F.concat(done, F.array(name)))

    joined = F.array_join(F.aggregate(names, F.expr("cast(array() as array<string>)"), step), "/")
    return bind(F.concat(F.when(rooted, "/").otherwise(""), joined), lambda out: F.when(out == "", ".").otherwise(out))


def clean_href(c: Column) -> Column:
    """A manifest href as a key: cut and cleaned."""
    return clean_path(cut_href(c))


def resolve_href(base: Column, href: Column) -> Column:
    """An href relative to the folder of the file `base`."""
    folder = F.regexp_extract(base, "^(.*)/[^/]*$", 1)
    return clean_path(F.when(folder == "", cut_href(href)).otherwise(F.concat(folder, F.lit("/"), cut_href(href))))


def topic_path(c: Column) -> Column:
    """A help topic's path: cut at ';' and '#', rooted; null if it leaves the archive."""
    path = trim(F.regexp_extract(c, "^[^;#]*", 0))
    off = path.contains("://") | F.lower(path).rlike("^(javascript|mailto):") | (path == "")
    return F.when(~off, F.concat(F.when(path.startswith("/"), "").otherwise("/"), path))


def file_name(c: Column) -> Column:
    """A safe file name: letters, digits, '-', '_' and '.', others '_'; '' gives 'image'."""
    out = F.regexp_replace(c, r"[^\p{L}\p{Nd}\-_.]", "_")
    return F.when(out == "", "image").otherwise(out)


# identifiers


def canonical_scheme(c: Column) -> Column:
    """Aliases of known identifier schemes folded; others trimmed."""
    s = trim(c)
    up = F.upper(s)
    return F.when(up.startswith("ISBN"), "ISBN").when(up.isin("DOI", "UUID", "ASIN", "ISSN"), up).when(up.isin("URL", "URI"), "URL").otherwise(s)


def looks_like_url(c: Column) -> Column:
    """A scheme before '://', or http, https or ftp before ':'."""
    return c.rlike(f"^{NAME}://") | (~c.rlike("^[^:]+://") & c.rlike("(?i)^(https?|ftp):"))


def identifier(value: Column, scheme: Column | None = None) -> Column:
    """struct<scheme, value>: an explicit scheme wins and strips only its own prefix; else a prefix decides."""
    explicit = canonical_scheme(F.coalesce(scheme, F.lit("")) if scheme is not None else F.lit(""))
    parts = bind(
        trim(value),
        lambda v: F.struct(v.alias("v"), looks_like_url(v).alias("url"), F.regexp_extract(v, f"(?s)^(?i:urn:)?({NAME}):(.*)$", 1).alias("s"), F.regexp_extract(v, f"(?s)^(?i:urn:)?({NAME}):(.*)$", 2).alias("rest"),
                           v.rlike("(?i)^urn:").alias("urn"), v.rlike(f"^(?i:urn:){NAME}:").alias("named")),
    )
    none = F.lit("")
    out = lambda s, x: F.struct(s.alias("scheme"), x.alias("value"))

    def decide(p: Column, own: Column) -> Column:
        v, found = p["v"], (p["s"] != "") & (~p["urn"] | p["named"])
        scheme_ = canonical_scheme(p["s"])
        return (
            F.when(F.coalesce(v, none) == "", out(none, none))
            .when(own != "", out(own, F.when(found & ~p["url"] & (F.lower(scheme_) == F.lower(own)), trim(p["rest"])).otherwise(v)))
            .when(p["url"], out(F.lit("URL"), v))
            .when(found, out(scheme_, trim(p["rest"])))
            .otherwise(out(none, v))
        )

    return bind(F.struct(parts.alias("p"), explicit.alias("own")), lambda x: decide(x["p"], x["own"]))


def find_identifier(ids: Column, scheme: str) -> Column:
    """Value of the first identifier of a scheme that is not empty, null if none."""
    return F.get(F.filter(ids, lambda x: (F.lower(x["scheme"]) == scheme.lower()) & (x["value"] != "")), F.lit(0))["value"]


# lists


def split_subjects(c: Column) -> Column:
    """Array of strings split at ';', trimmed, empty ones dropped; order and repeats stay."""
    return F.filter(F.transform(F.flatten(F.transform(c, lambda s: F.split(s, ";"))), trim), lambda s: s != "")


def split_list(c: Column) -> Column:
    """A string split at ',' and ';', trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(c, "[,;]"), trim), lambda s: s != "")


def dedupe_subjects(c: Column) -> Column:
    """Repeats dropped without regard to case; the first spelling stays."""
    place = lambda s, i: F.struct(F.array_position(F.transform(c, F.lower), F.lower(s)).alias("first"), (i + 1).cast("long").alias("own"), s.alias("s"))
    return F.transform(F.filter(F.transform(c, place), lambda x: x["first"] == x["own"]), lambda x: x["s"])


def split_authors(c: Column) -> Column:
    """Names split at '&', 'and' and 'with'; '&&' is a literal '&'."""
    held = F.replace(c, F.lit("&&"), F.lit("\x01"))
    parts = F.split(F.regexp_replace(held, r"(?i),?\s+(?:and|with)\s+", "&"), "&")
    return F.filter(F.transform(parts, lambda s: trim(F.replace(s, F.lit("\x01"), F.lit("&")))), lambda s: s != "")


def clean_publisher(c: Column) -> Column:
    """Without a label such as 'publisher:' in front."""
    return trim(F.regexp_replace(c, r"(?i)^\s*(?:publisher|imprint|kiadó|kiado)\s*:\s*", ""))


def palm_time(c: Column) -> Column:
    """Seconds since 1904 as a timestamp; 0 gives null."""
    return F.when(c != 0, F.timestamp_seconds(c - 2082844800))
