"""Declarative site specs: URL templates, source paths and typed field maps, compiled to selects."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegrain.functions import urls


def build_urls(params: DataFrame, template: str, encodings: dict[str, str], defaults: dict[str, str] | None = None,
               name: str = "url") -> DataFrame:
    """One URL per parameter row. A parameter is encoded for a query (spaces as ``+``) or for a path; rows with a missing
    parameter, or whose URL would leave the template's own origin, have no URL."""
    defaults = defaults or {}
    pieces: list[Column] = []
    for text, param in re.findall(r"([^{}]*)(?:\{(\w+)\})?", template):
        if text:
            pieces.append(F.lit(text))
        if param:
            value = F.col(param).cast("string") if param in params.columns else F.lit(None).cast("string")
            value = F.coalesce(value, F.lit(defaults.get(param)))
            coded = F.url_encode(value)
            pieces.append(coded if encodings.get(param) == "query" else F.replace(coded, F.lit("+"), F.lit("%20")))
    home = re.match(r"^[a-z]+://[^/?#{}]*", template)
    url = F.concat(*pieces)
    return params.withColumn(name, F.when(urls.origin(url) == (home.group(0) if home else ""), url))
