"""URL functions as column expressions, by the rules that browsers go by for http and https.

A url that is written as a browser would write it is taken as it is. Only the others go the long way: blanks at the ends and
line breaks go, backslashes are slashes, the scheme and the host are put in lower case, hosts of other scripts in their ASCII
form, default ports and dot segments go, and other characters are percent-encoded. All of it runs in the JVM, and Spark
evaluates the long way for the rows that need it alone.

Names of hosts follow IDNA of 2003, the JVM's. IPv4 addresses are taken in their usual form of four numbers only, and IPv6
addresses are not shortened.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_PATH_CHARS, _QUERY_CHARS = r"-!$%&'()*+,./0-9:;=@A-Z_a-z~|\[\]", r"-!$%&()*+,./0-9:;=?@A-Z_a-z~|{}\[\]\\^`"
#: As a browser writes it; dot segments are looked for apart.
_PLAIN = rf"^https?://(?:[a-z0-9_-]+\.)*[a-z_][a-z0-9_-]*/[{_PATH_CHARS}]*(?:\?[{_QUERY_CHARS}]*)?(?:#[{_QUERY_CHARS}']*)?$"
_DOTS = r"(?i)/(?:\.|%2e)"
_OTHER = r"|[^\x00-\x7E]"
_IN_PATH, _IN_QUERY, _IN_FRAGMENT = (rf"[\x00-\x20{c}\x7F]{_OTHER}" for c in (r"\"<>^`{}", r"\"<>'", r"\"<>`"))
_IN_HOST = r"[\x00-\x20\"#%/:<>?@\[\\\]^`{|}\x7F]"
_EDGES = r"^[\x00-\x20]+|[\x00-\x20]+$"


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed once."""
    return F.transform(F.array(value), then)[0]


def _encoded(c: Column, pattern: str) -> Column:
    one = lambda x: F.when(x.rlike(pattern), F.replace(F.url_encode(x), F.lit("+"), F.lit("%20"))).otherwise(x)
    return F.when(c.rlike(pattern), F.array_join(F.transform(F.split(c, ""), one), "")).otherwise(c)


def _without_dots(path: Column) -> Column:
    """A path that begins with a slash, with its dot segments resolved."""
    up, here = r"(?i)^(?:\.|%2e){2}$", r"(?i)^(?:\.|%2e)$"

    def step(kept: Column, segment: Column) -> Column:
        shorter = F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))
        return F.when(segment.rlike(up), shorter).when(segment.rlike(here), kept).otherwise(F.array_append(kept, segment))

    def joined(segments: Column) -> Column:
        kept = F.aggregate(segments, F.array().cast("array<string>"), step)
        last = F.element_at(segments, -1)
        return F.concat(F.lit("/"), F.array_join(F.when(last.rlike(up) | last.rlike(here), F.array_append(kept, F.lit(""))).otherwise(kept), "/"))

    return F.when(path.rlike(_DOTS), _let(F.split(F.substring(path, F.lit(2), F.length(path)), "/"), joined)).otherwise(path)


def _host(raw: Column) -> Column:
    """A host's ASCII form in lower case, or null where it can't be one."""

    def checked(h: Column) -> Column:
        number = h.rlike(r"(?i)(^|\.)(\d+|0x[0-9a-f]*)\.?$")
        four = F.regexp_extract(h, r"^((?:(?:0|[1-9]\d{0,2})\.){3}(?:0|[1-9]\d{0,2}))\.?$", 1)
        good = (four != "") & ~F.exists(F.split(four, r"\."), lambda x: x.try_cast("int") > 255)
        return F.when((h == "") | h.rlike(_IN_HOST), None).when(number, F.when(good, four)).otherwise(h)

    name = F.when(raw.contains("%"), F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B")))).otherwise(raw)
    ascii_form = _let(name, lambda x: F.lower(F.when(x.rlike(r"[^\x00-\x7F]"), F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), x, F.lit(1))).otherwise(x)))
    return F.when(raw.rlike(r"^\[[0-9A-Fa-f:.]+\]$"), F.lower(raw)).otherwise(_let(ascii_form, checked))


def _long_way(url: Column) -> Column:
    """The url as a browser writes it, or null if it isn't one of http or https."""

    def split(s: Column) -> Column:
        rest = F.regexp_replace(s, r"^[A-Za-z]+:[/\\]*", "")
        authority = F.regexp_extract(rest, r"^[^/\\?#]*", 0)
        after = F.substring(rest, F.length(authority) + 1, F.length(s))
        path = F.regexp_extract(after, r"^[^?#]*", 0)
        return F.struct(
            F.lower(F.regexp_extract(s, r"^[A-Za-z]+", 0)).alias("scheme"),
            F.regexp_extract(authority, r"^(.*@)?", 0).alias("user"),
            F.regexp_replace(authority, r"^.*@", "").alias("at"),
            F.translate(path, "\\", "/").alias("path"),
            F.regexp_extract(after, r"^[^?#]*(\?[^#]*)?", 1).alias("query"),
            F.regexp_extract(after, r"^[^#]*(#.*)?$", 1).alias("fragment"),
        )

    def built(p: Column) -> Column:
        port = F.regexp_extract(p["at"], r":(\d*)$", 1)
        name = _host(F.regexp_replace(p["at"], r":\d*$", ""))
        usual = F.when(p["scheme"] == "http", "80").otherwise("443")
        shown = F.regexp_replace(port, r"^0+(?=\d)", "")
        shown = F.when((shown == "") | (shown == usual), "").when(shown.try_cast("int") <= 65535, F.concat(F.lit(":"), shown))
        user = F.regexp_replace(_encoded(p["user"], _IN_PATH), r"^:?@$", "")
        path = F.when(p["path"] == "", "/").otherwise(p["path"])
        return F.concat(p["scheme"], F.lit("://"), user, name, shown, _encoded(_without_dots(path), _IN_PATH), _encoded(F.regexp_replace(p["query"], "^\\?$", "?"), _IN_QUERY), _encoded(p["fragment"], _IN_FRAGMENT))

    clean = F.regexp_replace(F.regexp_replace(url, _EDGES, ""), r"[\t\n\r]", "")
    return F.when(clean.rlike(r"(?i)^https?:"), _let(_let(clean, split), built))


def href(url: Column) -> Column:
    """An http or https url as a browser writes it; null for whatever else."""
    return F.when(url.rlike(_PLAIN) & ~url.rlike(_DOTS), url).otherwise(_long_way(url))


def _host_of(written: Column) -> Column:
    return F.nullif(F.regexp_extract(written, r"^https?://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1), F.lit(""))


def host(url: Column) -> Column:
    """The host of an http or https url; of others what the JVM's parser finds."""
    return F.coalesce(_host_of(href(url)), F.when(~url.rlike(rf"(?i)(?:{_EDGES})?https?:"), F.lower(F.try_parse_url(url, F.lit("HOST")))))


def is_http(url: Column) -> Column:
    return href(url).isNotNull()


def parses(url: Column) -> Column:
    """Whether it is a url of any scheme. Those of ftp and web sockets need a host, as those of http do."""
    clean = F.regexp_replace(url, _EDGES, "")
    other = clean.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") & ~clean.rlike(r"(?i)^https?:")
    hosted = clean.rlike(r"(?i)^(ftp|wss?):")
    return F.coalesce(href(url).isNotNull() | (other & (~hosted | href(F.regexp_replace(clean, "^[A-Za-z]+:", "http:")).isNotNull())), F.lit(False))


def normalized(url: Column) -> Column:
    """As a browser writes it, without fragment and without one final slash of the path, but for the root. Text that is no
    url is trimmed and put in lower case."""
    whole = F.regexp_replace(href(url), "#.*$", "")
    whole = F.regexp_replace(whole, r"^(https?://[^/?]+/[^?]*)/(\?.*)?$", "$1$2")
    return F.coalesce(whole, F.lower(F.trim(url)))


def link_type(url: Column, seed_host: Column) -> Column:
    return F.when(host(url) == seed_host, "internal").otherwise("external")


def resolved(reference: Column, base: Column) -> Column:
    """The absolute url of a reference in the page at `base`, as a browser shows it; null if it isn't one of http or https."""
    plain_root = reference.rlike(rf"^/(?!/)[{_PATH_CHARS}]*$") & ~reference.rlike(_DOTS)
    root = F.regexp_extract(base, r"^https?://[a-z0-9._-]+(?=/)", 0)

    def against(clean: Column) -> Column:
        def joined(b: Column) -> Column:
            site, path = F.regexp_extract(b, r"^https?://[^/?#]*", 0), F.regexp_extract(b, r"^[^?#]*", 0)
            return (
                F.when(clean.rlike(r"^[/\\]{2}"), F.concat(F.regexp_extract(b, "^https?:", 0), clean))
                .when(clean.rlike(r"^[/\\]"), F.concat(site, clean))
                .when(clean == "", F.regexp_replace(b, "#.*$", ""))
                .when(clean.startswith("?"), F.concat(path, clean))
                .when(clean.startswith("#"), F.concat(F.regexp_replace(b, "#.*$", ""), clean))
                .otherwise(F.concat(F.regexp_replace(path, "[^/]*$", ""), clean))
            )

        return F.when(clean.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), clean).otherwise(_let(href(base), joined))

    long_way = _let(F.regexp_replace(F.regexp_replace(reference, _EDGES, ""), r"[\t\n\r]", ""), against)
    return F.when(plain_root & (root != ""), F.concat(root, reference)).otherwise(href(long_way))


def organisation(url: Column) -> Column:
    """The label before .edu, else the first one, without www."""
    labels = F.split(F.regexp_replace(host(url), r"^www\.", ""), r"\.")
    return F.when(host(url).isNull(), "unknown-university").when((F.size(labels) >= 2) & (F.element_at(labels, -1) == "edu"), F.element_at(labels, -2)).otherwise(F.element_at(labels, 1))


def directory_name(name: Column) -> Column:
    slug = F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-")
    return F.substring(F.regexp_replace(slug, "^-+|-+$", ""), 1, 50)
