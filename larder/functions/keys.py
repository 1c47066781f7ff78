"""Column functions. All give null for null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


ORIGIN = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*"

#: What a key that may not be canonical has: a fragment, a part . or .., or capitals or a port in its origin.
OTHER_FORM = r"#|(^|/)\.\.?([/?]|$)|^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*[A-Z:]|^[a-z0-9+.-]*[A-Z][a-zA-Z0-9+.-]*://"


def canonical_key(url: Column) -> Column:
    """The key of a request, one for all spellings of a URL; the query stays as it is.

    The fragment goes; scheme and host are in lower case (not beside a user name), their default port goes; ``.`` and ``..`` parts
    of the path are resolved, of a relative one as far as it says itself. An absolute URL without a path stays without one.
    """
    # Most keys are canonical, which one pattern tells; a lambda's argument is computed once, however often it is named.
    return F.when(F.regexp_like(url, F.lit(OTHER_FORM)), F.transform(F.array(url), in_canonical_form)[0]).otherwise(url)


def in_canonical_form(url: Column) -> Column:
    bare = F.regexp_replace(url, "(?s)#.*$", "")
    origin = F.regexp_extract(bare, ORIGIN, 0)
    plain = F.regexp_replace(F.when(F.contains(origin, F.lit("@")), origin).otherwise(F.lower(origin)), "^(http://.*):80$|^(https://.*):443$", "$1$2")
    rest = F.substr(bare, F.length(origin) + 1)
    path, query = F.regexp_extract(rest, r"(?s)^[^?]*", 0), F.regexp_extract(rest, r"(?s)\?.*$", 0)
    dotted = F.regexp_like(path, F.lit(r"(^|/)\.\.?(/|$)"))
    return F.concat(plain, F.when(dotted, without_dots(path, (origin != "") | F.startswith(path, F.lit("/")))).otherwise(path), query)


def without_dots(path: Column, absolute: Column) -> Column:
    """A path without ``.`` and ``..`` parts. Above the root there is nothing; a relative path keeps what leads out of it."""
    parts = F.split(path, "/")
    # A last part . or .. is a folder.
    parts = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(parts, F.array(F.lit("")))).otherwise(parts)

    def add(done: Column, part: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        stuck = F.when(absolute, F.size(done) <= 1).otherwise(last.isNull() | (last == ".."))
        up = F.when(stuck & absolute, done).when(stuck, F.concat(done, F.array(part))).otherwise(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
        return F.when(part == ".", done).when(part == "..", up).otherwise(F.concat(done, F.array(part)))

    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), add), "/")


def relative_key(url: Column) -> Column:
    """A relative key with its leading ``./`` removed, so that ``./a`` and ``a`` are one."""
    return F.regexp_replace(url, r"^(\./)+", "")


def resolved(url: Column, base: Column) -> Column:
    """A relative URL as an absolute one, seen from the absolute URL ``base``: ``./``, ``../``, ``/a``, ``//host`` and ``a``."""
    origin = F.regexp_extract(base, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", 0)
    folder = F.regexp_extract(F.substr(base, F.length(origin) + 1), r"^([^?#]*/)", 1)
    path = F.when(F.startswith(url, F.lit("/")), url).otherwise(F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), url))
    tail = F.regexp_extract(path, r"(?s)[?#].*$", 0)
    parts = F.split(F.regexp_replace(path, r"(?s)[?#].*$", ""), "/")
    # A last part . or .. is a folder.
    parts = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(parts, F.array(F.lit("")))).otherwise(parts)
    up = lambda acc: F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1)))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when(x == ".", acc).when(x == "..", up(acc)).otherwise(F.concat(acc, F.array(x))))
    absolute = F.when(F.startswith(url, F.lit("//")), F.concat(F.regexp_extract(base, "^[^:]*:", 0), url)).otherwise(F.concat(origin, F.array_join(kept, "/"), tail))
    return F.when(F.regexp_like(url, F.lit("^[a-zA-Z][a-zA-Z0-9+.-]*:")), url).otherwise(absolute)


def host(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("HOST"))


def extension(path: Column) -> Column:
    """Lower-cased extension with its dot of the last path segment, '' if it has none. Query and fragment don't count."""
    last = F.regexp_extract(F.regexp_replace(F.regexp_replace(path, "(?s)[?#].*$", ""), "^[a-zA-Z]+://[^/]*", ""), "([^/]*)$", 1)
    return F.lower(F.regexp_extract(last, r"(\.[^.]*)$", 1))


def in_scope(url: Column, scope: Column) -> Column:
    """Whether a URL lies under a scope prefix. The scope's last slash counts: /apple is not under /app/.

    Both are absolute, or both paths; a relative scope is ``resolved`` against its descriptor's URL first.
    """
    return F.startswith(url, scope)


def size_part(sizes: Column, place: int) -> Column:
    """Width (0) or height (1) of ``WxH``; null where it is not such a pair, as for ``any``."""
    return F.try_element_at(F.split(F.lower(sizes), "x"), F.lit(place + 1)).try_cast("int")
