"""URL canonicalisation and filters as Column expressions over the generic URI grammar."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: scheme, authority, path, query, fragment.
URI = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"

# What is no page, and what is no content.
MEDIA = "jpg jpeg png gif webp svg mp4 webm pdf css js woff woff2".split()
NOISE = ["images.ctfassets.net", "/_next/", "/assets/", "/static/"]
NO_CONTENT = (
    "login logout signin signup register api/ .json .xml .pdf .zip mailto: tel: ftp: /search /redeem /account"
    " gear.bethesda.net help.bethesda.net status.bethesda.net accounts.bethesda.net manuals.bethesda.net"
    " creations.bethesda.net mods.bethesda.net slayersclub.bethesda.net quakecon.bethesda.net"
).split()


def part(url: Column, number: int) -> Column:
    return F.regexp_extract(url, URI, number)


def domain(url: Column) -> Column:
    """Lower-case authority, port and user included; empty for null or relative urls."""
    return F.lower(part(F.coalesce(url, F.lit("")), 2))


def _joined(scheme: Column, authority: Column, path: Column) -> Column:
    return F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""),
        F.when(authority != "", F.concat(F.lit("//"), authority)).otherwise(""),
        path,
    )


def normalize_export(url: Column) -> Column:
    """Scheme and authority in lower case, single slashes, no trailing slash, parameters, query or
    fragment; an empty path becomes ``/``. Null or empty gives the empty string."""
    trimmed = F.trim(F.coalesce(url, F.lit("")))
    # parameters of the last segment go with the query
    path = F.regexp_replace(part(trimmed, 3), r";[^/]*$", "")
    single = F.regexp_replace(path, "/{2,}", "/")
    short = F.when(single == "", "/").when(single == "/", single).otherwise(F.regexp_replace(single, "/+$", ""))
    return F.when(trimmed == "", F.lit("")).otherwise(_joined(F.lower(part(trimmed, 1)), F.lower(part(trimmed, 2)), short))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Stands between the parts of a split url; no url holds it.
_BAR = "\x01"


def parts(url: Column) -> Column:
    """Scheme, authority, path, query and fragment of a url as one array, by one pass over it."""
    return F.split(F.regexp_replace(url, URI, _BAR.join(f"${k}" for k in range(1, 6))), _BAR)


def _decoded(text: Column) -> Column:
    """A piece of a query string without escapes; one with broken escapes as it is."""
    return F.coalesce(F.try_url_decode(text), text)


def _encoded(text: Column) -> Column:
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def sorted_query(query: Column) -> Column:
    """Query string with its keys in order, repeated keys together, blanks kept, encoded anew."""

    def pair(text: Column, at: Column) -> Column:
        key = F.substring_index(text, "=", 1)
        value = F.when(text.contains("="), F.substr(text, F.length(key) + 2)).otherwise("")
        return F.struct(_decoded(key).alias("key"), at.alias("at"), _decoded(value).alias("value"))

    given = F.filter(F.split(query, "&"), lambda x: x != "")
    pairs = F.array_sort(F.transform(given, pair))
    return F.array_join(F.transform(pairs, lambda p: F.concat(_encoded(p["key"]), F.lit("="), _encoded(p["value"]))), "&")


def normalize_crawl(url: Column) -> Column:
    """Scheme and authority in lower case, no trailing slash except for the root, sorted query, no
    fragment."""
    text = F.coalesce(url, F.lit(""))
    return F.when(text == "", F.lit("")).otherwise(let(parts(text), normalized))


def normalized(pieces: Column) -> Column:
    """The normalised url from its ``parts``."""
    path, query = pieces[2], pieces[3]
    short = F.when(path == "/", path).otherwise(F.regexp_replace(path, "/+$", ""))
    base = _joined(F.lower(pieces[0]), F.lower(pieces[1]), short)
    return F.when(query == "", base).otherwise(F.concat(base, F.lit("?"), sorted_query(query)))


def unescaped(text: Column) -> Column:
    """Text of an attribute with the character references that urls hold resolved."""
    for name, value in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#34;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&apos;", "'"), ("&#38;", "&"), ("&#x26;", "&"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(value))
    return text


def joined(base: Column, href: Column) -> Column:
    """A relative reference resolved against a base url, by the rules of RFC 3986; ``base`` and ``href``
    are ``parts``. Empty segments inside the merged path are dropped."""
    whole = F.concat(F.when(base[0] != "", F.concat(base[0], F.lit(":"))).otherwise(""), F.lit("//"), base[1])

    def merged(segments: Column) -> Column:
        inner = F.filter(segments, lambda x, k: (x != "") | (k == 0) | (k == F.size(segments) - 1))
        resolved = F.aggregate(
            inner, F.array().cast("array<string>"),
            lambda done, x: F.when(x == "..", F.when(F.size(done) > 0, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(done)).when(x == ".", done).otherwise(F.concat(done, F.array(x))),
        )
        tail = F.when(F.element_at(segments, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
        return F.array_join(F.concat(resolved, tail), "/")

    full = F.when(href[2].startswith("/"), href[2]).otherwise(F.concat(F.regexp_replace(base[2], "[^/]*$", ""), href[2]))
    path = let(let(F.split(full, "/"), merged), lambda p: F.when(p == "", "/").when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p)))
    query = F.when(href[3] != "", F.concat(F.lit("?"), href[3])).when((href[2] == "") & (base[3] != ""), F.concat(F.lit("?"), base[3])).otherwise("")
    return F.concat(whole, F.when(href[2] == "", base[2]).otherwise(path), query)


def is_noise(url: Column) -> Column:
    """Null, empty, a media file, or a fragment of a delivery path."""
    low = F.lower(F.coalesce(url, F.lit("")))
    noisy = low.rlike(r"\.(" + "|".join(MEDIA) + ")$")
    for piece in NOISE:
        noisy = noisy | low.contains(piece)
    return (low == "") | noisy


def is_valid(url: Column, allowed: list[str] | None = None) -> Column:
    """An http or https url with an authority, within the allowed domains and their subdomains if given."""
    text = F.coalesce(url, F.lit(""))
    good = F.lower(part(text, 1)).isin("http", "https") & (part(text, 2) != "")
    if not allowed:
        return good
    host = F.regexp_replace(domain(text), r"^www\.", "")
    inside = F.lit(False)
    for name in allowed:
        bare = name.lower().removeprefix("www.")
        inside = inside | (host == bare) | host.endswith("." + bare)
    return good & inside


def is_content(url: Column) -> Column:
    """No login, interface, archive or service address."""
    low = F.lower(F.coalesce(url, F.lit("")))
    bad = F.lit(False)
    for piece in NO_CONTENT:
        bad = bad | low.contains(piece)
    return ~bad


def title_to_url(title: Column, source_domain: str) -> Column:
    """Address of a wiki page from its title."""
    name = F.replace(F.url_encode(F.replace(title, F.lit(" "), F.lit("_"))), F.lit("+"), F.lit("%20"))
    name = F.replace(F.replace(name, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    return F.concat(F.lit(f"https://{source_domain}/wiki/"), name)


def url_to_title(url: Column) -> Column:
    """Title of a wiki page from its address; broken escapes stay as they are."""
    path = part(F.coalesce(url, F.lit("")), 3)
    page = F.when(path.contains("/wiki/"), F.regexp_replace(path, "^.*?/wiki/", "")).otherwise(F.regexp_replace(path, "^/+|/+$", ""))
    guarded = F.replace(page, F.lit("+"), F.lit("%2B"))
    return F.replace(F.coalesce(F.try_url_decode(guarded), page), F.lit("_"), F.lit(" "))


def category_name(item: Column) -> Column:
    """First non-blank of the keys ``* category name title`` of a map."""
    return F.coalesce(*[F.nullif(F.trim(F.try_element_at(item, F.lit(k))), F.lit("")) for k in ("*", "category", "name", "title")])
