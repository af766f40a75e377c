"""Tracking in links: whole redirect wrappers, or the parameters that say where a link came from."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspan.functions.regex import finding, hits, let
from veilspan.functions.url import URL, tracking_spans, trim_url, unwrap_url
from veilspan.lists import Context


def tracking(text: Column, ctx: Context) -> Column:
    def spans(h: Column) -> Column:
        def choose(u: Column) -> Column:
            whole = F.array(finding(h["start"], u["url"], "TRACKING", "tracking", 85,
                                    F.create_map(F.lit("unwrap"), u["target"])))
            parts = F.transform(tracking_spans(u["url"], ctx.tracking_params), lambda s: finding(
                h["start"] + s["start"], F.substring(u["url"], s["start"] + 1, s["end"] - s["start"]),
                "TRACKING", "tracking", 85))
            return F.when(u["target"].isNotNull(), whole).otherwise(parts)

        return let(trim_url(h["text"]), lambda url: let(
            F.struct(url.alias("url"), unwrap_url(url).alias("target")), choose))

    return F.flatten(F.transform(hits(text, URL, guard=F.contains(F.lower(text), F.lit("://"))), spans))
