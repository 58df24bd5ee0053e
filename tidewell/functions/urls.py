"""URL functions."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def is_valid(url: Column) -> Column:
    """Whether a URL has a scheme and a host."""
    return F.coalesce(url.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#\s]+"), F.lit(False))


def domain(url: Column) -> Column:
    """The host in lower case without user, port and the first ``www.``; '' where there is none (I8)."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.regexp_replace(host, r"^(.*?)www\.", "$1")


def sanitised(url: Column) -> Column:
    """A URL without fragment and ``utm_*`` parameters; the rest stays as written."""
    bare = F.regexp_replace(url, r"#.*$", "")
    cut = F.regexp_replace(bare, r"([?&])(?:utm_(?:source|medium|campaign|term|content)=[^&]*(?:&|$))+", "$1")
    return F.when(is_valid(url), F.regexp_replace(cut, r"[?&]+$", "")).otherwise(url)


@F.pandas_udf(T.StringType())
def absolute(url: pd.Series, base: pd.Series) -> pd.Series:
    """A URL resolved against a base (I14); needs the path rules of RFC 3986, hence Python on Arrow batches."""
    return pd.Series([urljoin(b, u) if u is not None and b is not None else u for u, b in zip(url, base, strict=True)])


def with_query(base: Column, parameters: Column) -> Column:
    """A URL with the entries of a map as query; null values are left out."""
    pairs = F.transform(F.map_entries(F.map_filter(parameters, lambda _, v: v.isNotNull())), lambda e: F.concat(F.url_encode(e["key"]), F.lit("="), F.url_encode(e["value"])))
    return F.when(F.size(pairs) > 0, F.concat(base, F.lit("?"), F.array_join(pairs, "&"))).otherwise(base)
