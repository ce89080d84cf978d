"""URL functions: authority (F7), source naming (P4), image URL resolution (F8)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Feed authority -> source name, as the reference maps them.
SOURCE_NAMES = (
    ("arktimes.com", "Arkansas Times"),
    ("www.arkansasbusiness.com", "Arkansas Business"),
    ("talkbusiness.net", "Talk Business & Politics"),
    ("arkansasadvocate.com", "Arkansas Advocate"),
    ("www.kark.com", "KARK 4 News"),
    ("www.google.com", "Google News Alert"),
)

_SCHEME_RE = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_PATH_RE = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)"


def authority(url: Column) -> Column:
    """lower-cased ``netloc`` (userinfo and port kept); '' when absent.
    Spaces are percent-encoded first so the parser does not give up on them."""
    safe = F.replace(url, F.lit(" "), F.lit("%20"))
    auth = F.try_parse_url(safe, F.lit("AUTHORITY"))
    auth = F.when(F.contains(url, F.lit(" ")), F.replace(auth, F.lit("%20"), F.lit(" "))).otherwise(auth)
    return F.lower(F.coalesce(auth, F.lit("")))


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _SCHEME_RE, 1))


def source_name(url: Column, mapping=SOURCE_NAMES) -> Column:
    """Friendly name of the feed's authority, else the authority itself."""
    dom = authority(url)
    lookup = F.create_map(*[F.lit(x) for kv in mapping for x in kv])
    return F.coalesce(F.try_element_at(lookup, dom), dom)


def _needs_python_join(img: Column) -> Column:
    """Relative references with dot segments are left to ``urljoin``."""
    return (~img.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:") & ~img.startswith("//") &
            img.rlike(r"(^|/)\.\.?(/|$|\?|#)"))


@F.pandas_udf(T.StringType())
def _urljoin(page, img):
    from urllib.parse import urljoin
    return page.combine(img, lambda p, i: None if p is None or i is None else urljoin(p, i))


def resolve_url(page_url: Column, img: Column) -> Column:
    """F8: resolve an image reference against its page like ``urljoin``.

    Absolute ``http(s)://`` stays; ``//host/x`` takes the page scheme; ``/x``
    the page origin; ``?q``/``#f`` the page path; anything else the page's
    directory.  References with ``.``/``..`` segments go to ``urljoin`` in a
    vectorised helper (the only Python on this path, null for other rows).
    """
    sch = scheme(page_url)
    origin = F.concat(sch, F.lit("://"), F.regexp_extract(page_url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))
    path = F.regexp_extract(page_url, _PATH_RE, 1)
    directory = F.regexp_replace(path, r"[^/]*$", "")
    directory = F.when(directory == F.lit(""), F.lit("/")).otherwise(directory)
    no_frag = F.regexp_replace(page_url, r"#.*$", "")
    no_query = F.regexp_replace(no_frag, r"\?.*$", "")
    native = (F.when(img.startswith("http://") | img.startswith("https://"), img)
              .when(img.startswith("//"), F.concat(sch, F.lit(":"), img))
              .when(img.rlike(_SCHEME_RE), img)
              .when(img.startswith("/"), F.concat(origin, img))
              .when(img == F.lit(""), page_url)
              .when(img.startswith("?"), F.concat(no_query, img))
              .when(img.startswith("#"), F.concat(no_frag, img))
              .otherwise(F.concat(origin, directory, img)))
    need = _needs_python_join(img)
    py = _urljoin(F.when(need, page_url), F.when(need, img))
    return F.when(img.isNull(), F.lit(None).cast("string")).when(need, py).otherwise(native)
