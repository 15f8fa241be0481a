"""URLs: canonical form, article addresses, resolving links."""

from __future__ import annotations

from urllib.parse import parse_qsl, quote, urlencode, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Parameters that tell where a visitor came from, and default ports.
TRACKING = {"utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "msclkid", "ref", "ref_src"}
PORTS = {"http": 80, "https": 443}
ARTICLES = "https://simple.wikipedia.org/wiki/"


def canonical(url: str | None) -> str | None:
    """One form for all addresses of a document; null for one that can't be read, such as a bad port.

    Without fragment, user, default port and tracking parameters; scheme and host in lower case; other
    parameters in their order; no slash at the end of a path, which is ``/`` if empty.
    """
    if url is None:
        return None
    try:
        u = urlsplit(url)
        port = u.port
    except ValueError:
        return None
    host = (u.hostname or "") + (f":{port}" if port and port != PORTS.get(u.scheme) else "")
    kept = [(k, v) for k, v in parse_qsl(u.query, keep_blank_values=True) if k.lower() not in TRACKING]
    path = (u.path.rstrip("/") if len(u.path) > 1 else u.path or "/")
    head = f"{u.scheme}://{host}" if u.netloc else f"{u.scheme}:" if u.scheme else ""
    return head + path + ("?" + urlencode(kept) if kept else "")


@F.pandas_udf(StringType())
def canonical_url(urls: pd.Series) -> pd.Series:
    return urls.map(canonical)


@F.pandas_udf(StringType())
def join_url(bases: pd.Series, links: pd.Series) -> pd.Series:
    return pd.Series([None if b is None or x is None else urljoin(b, x) for b, x in zip(bases, links, strict=True)], dtype=object)


def article_url(title: Column) -> Column:
    """The address of an article by its title, percent-encoded but for slashes."""
    code = F.url_encode(F.replace(title, F.lit(" "), F.lit("_")))
    for a, b in (("+", "%20"), ("%2F", "/"), ("*", "%2A"), ("%7E", "~")):
        code = F.replace(code, F.lit(a), F.lit(b))
    return F.concat(F.lit(ARTICLES), code)


def article_address(title: str) -> str:
    return ARTICLES + quote(title.replace(" ", "_"))
