"""URL expressions: resolution, page and PDF normal forms, file names."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import short_hash, slug, strip

SKIPPED_EXTENSIONS = tuple("7z doc docx gif jpeg jpg mp3 mp4 png ppt pptx rar svg webp xls xlsx zip".split())
_SPLIT = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"
PDF = r"(?i)\.pdf(?:$|[?#&])"


def _part(url: Column, k: int) -> Column:
    return F.regexp_extract(url, _SPLIT, k)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def netloc(url: Column) -> Column:
    return _part(url, 2)


def path(url: Column) -> Column:
    return _part(url, 3)


def query(url: Column) -> Column:
    return _part(url, 4)


def without_dots(segments: Column) -> Column:
    """Path of segments with . and .. resolved; a last one of these leaves a slash at the end."""
    done = F.aggregate(
        segments,
        F.expr("cast(array() as array<string>)"),
        lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when(s == ".", acc).otherwise(F.concat(acc, F.array(s))),
    )
    last = F.try_element_at(segments, F.lit(-1))
    return F.array_join(F.when(last.isin(".", ".."), F.concat(done, F.array(F.lit("")))).otherwise(done), "/")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def split_url(url: Column) -> Column:
    """Struct of scheme, netloc, path and query."""
    return F.named_struct(F.lit("scheme"), scheme(url), F.lit("netloc"), netloc(url), F.lit("path"), path(url), F.lit("query"), query(url))


def _tail(parts: Column) -> Column:
    return F.when(parts["query"] != "", F.concat(F.lit("?"), parts["query"])).otherwise("")


def _slashed(p: Column) -> Column:
    """A path that .. has taken above the root still starts there."""
    return F.when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p))


def _merged(base_path: Column, p: Column) -> Column:
    """Path of a reference below the base's folder; empty segments inside vanish."""
    segments = F.split(F.concat(F.regexp_replace(base_path, "[^/]*$", ""), p), "/")
    n = F.size(segments)
    inner = F.filter(F.slice(segments, F.lit(2), F.greatest(n - 2, F.lit(0))), lambda s: s != "")
    whole = F.when(n > 1, F.concat(F.slice(segments, 1, 1), inner, F.slice(segments, n, F.lit(1)))).otherwise(F.concat(F.array(F.lit("")), segments))
    return let(whole, without_dots)


def resolve(href: Column, base: Column) -> Column:
    """A reference against an absolute base URL, by the rules of RFC 3986; the fragment goes."""

    def of(h: Column, b: Column) -> Column:
        root = F.concat(b["scheme"], F.lit("://"), b["netloc"])
        rooted = without_dots(F.split(h["path"], "/"))
        relative = _merged(b["path"], h["path"])
        return (
            F.when((h["scheme"] != "") & (h["scheme"] != b["scheme"]), F.regexp_replace(href, "#.*$", ""))
            .when(h["netloc"] != "", F.concat(b["scheme"], F.lit("://"), h["netloc"], h["path"], _tail(h)))
            .when((h["path"] == "") & (h["query"] == ""), F.concat(root, b["path"], _tail(b)))
            .when(h["path"] == "", F.concat(root, b["path"], _tail(h)))
            .when(h["path"].startswith("/"), F.concat(root, _slashed(rooted), _tail(h)))
            .otherwise(F.concat(root, _slashed(relative), _tail(h)))
        )

    return let(F.named_struct(F.lit("h"), split_url(href), F.lit("b"), split_url(base)), lambda x: of(x["h"], x["b"]))


def canonical_host(host: Column) -> Column:
    """Lower case, one www. and a default port dropped."""
    return F.regexp_replace(F.regexp_replace(F.lower(strip(host)), r"^www\.", ""), r":(?:80|443)$", "")


def is_allowed(host: Column, domain: str) -> Column:
    """The domain itself or a host below it."""
    return (F.lower(host) == domain) | F.lower(host).endswith(f".{domain}")


def has_skipped_extension(p: Column, extensions: Iterable[str] = SKIPPED_EXTENSIONS) -> Column:
    return p.rlike(r"(?i)\.(?:" + "|".join(extensions) + ")$")


def is_pdf(url: Column) -> Column:
    return strip(url).rlike(PDF)


def _usable(text: Column) -> Column:
    return (text != "") & ~text.startswith("#") & ~scheme(text).isin("mailto", "tel", "javascript")


def _without_params(p: Column) -> Column:
    return F.regexp_replace(p, ";[^/]*$", "")


def normalize_page(href: Column, base: Column, domain: str, preferred_scheme: str = "http", extensions: Iterable[str] = SKIPPED_EXTENSIONS) -> Column:
    """Normal form of a link to a page of the domain; null for any other link.

    The scheme is the preferred one, the host without www. and default port;
    parameters and fragment go, the query stays as it is, slashes at the end of
    the path go. Not idempotent: apply it once.
    """

    def form(x: Column) -> Column:
        ok = x["scheme"].isin("http", "https") & is_allowed(x["host"], domain) & ~has_skipped_extension(x["path"], extensions)
        # The root keeps its slash; a path of several slashes loses them all.
        p = F.when(x["path"].isin("", "/"), "/").otherwise(F.regexp_replace(x["path"], "/+$", ""))
        return F.when(ok, F.concat(F.lit(f"{preferred_scheme}://"), x["host"], p, _tail(x)))

    return _normalized(href, base, canonical_host, form)


def normalize_pdf(href: Column, base: Column, domain: str, preferred_scheme: str = "http") -> Column:
    """Like ``normalize_page``, but www., ports, extensions and slashes stay as they are."""

    def form(x: Column) -> Column:
        ok = x["scheme"].isin("http", "https") & is_allowed(x["host"], domain)
        return F.when(ok, F.concat(F.lit(f"{preferred_scheme}://"), x["host"], F.when(x["path"] == "", "/").otherwise(x["path"]), _tail(x)))

    return _normalized(href, base, F.lower, form)


def _normalized(href: Column, base: Column, host: Callable[[Column], Column], form: Callable[[Column], Column]) -> Column:
    parts = lambda full: F.named_struct(F.lit("scheme"), scheme(full), F.lit("host"), host(netloc(full)), F.lit("path"), _without_params(path(full)), F.lit("query"), query(full))
    return let(strip(href), lambda text: F.when(_usable(text), let(resolve(text, base), lambda full: let(parts(full), form))))


def page_file_name(url: Column) -> Column:
    host = F.coalesce(F.nullif(F.regexp_replace(netloc(url), ":", "_"), F.lit("")), F.lit("unknown-host"))
    p = F.regexp_replace(F.regexp_replace(F.regexp_replace(path(url), ";[^/]*$", ""), "^/+|/+$", ""), "/", "_")
    return F.concat(host, F.lit("__"), F.coalesce(F.nullif(p, F.lit("")), F.lit("root")), F.lit("__"), short_hash(url), F.lit(".json"))


def pdf_metadata_file_name(url: Column, title: Column) -> Column:
    return F.concat(F.substring(slug(title), 1, 60), F.lit("__"), short_hash(url), F.lit(".json"))


def pdf_file_name(url: Column) -> Column:
    """The base name in the URL made safe, else one of its hash. Equal base names collide."""
    name = F.regexp_extract(url, r"(?i)([^/=?&]+\.pdf)(?:$|[?#&])", 1)
    return F.when(name == "", F.concat(F.lit("document__"), short_hash(url), F.lit(".pdf"))).otherwise(F.regexp_replace(name, "[^A-Za-z0-9._-]+", "_"))
