"""Link functions: redirect wrappers, tracking parameters, cleaning of URL columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspan import lists
from veilspan.functions.regex import empty, let

URL = r"(?iU)https?://[^\s<>\"'`]+"


def trim_url(url: Column) -> Column:
    """Drop punctuation behind a link; a closing bracket stays if it was opened in the link."""
    def step(acc: Column, _i: Column) -> Column:
        last = F.right(acc["u"], F.lit(1))

        def count(c: str) -> Column:
            return F.length(acc["u"]) - F.length(F.replace(acc["u"], F.lit(c), F.lit("")))

        stop = acc["done"] | ~last.isin(*".,;:!?)]}'\"") | ((last == ")") & (count("(") >= count(")")))
        cut = F.substring(acc["u"], F.lit(1), F.length(acc["u"]) - 1)
        return F.struct(F.when(stop, acc["u"]).otherwise(cut).alias("u"), stop.alias("done"))

    def trim(u: Column) -> Column:
        run = F.length(F.regexp_extract(u, r"[.,;:!?)\]}'\"]+$", 0))
        zero = F.struct(u.alias("u"), F.lit(False).alias("done"))
        return F.when(run == 0, u).otherwise(
            F.aggregate(F.sequence(F.lit(1), run), zero, step, lambda a: a["u"]))

    return let(url, trim)


def url_host(url: Column) -> Column:
    netloc = F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(netloc, r"^.*@", ""), r":\d*$", ""))


def _path(url: Column) -> Column:
    return F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def _query(url: Column) -> Column:
    return F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)


def _decode(value: Column) -> Column:
    return F.coalesce(F.try_url_decode(value), value)


def _param(query: Column, key: str) -> Column:
    """Decoded value of the last parameter ``key`` (NULL if absent)."""
    same = F.filter(F.split(query, "&", -1), lambda p: F.startswith(p, F.lit(key + "=")))
    return F.when(F.size(same) > 0, _decode(F.substring(F.element_at(same, -1), F.lit(len(key) + 2), F.length(query))))


def unwrap_url(url: Column) -> Column:
    """The target behind a known redirect wrapper, or NULL."""
    def find(v: Column) -> Column:
        cases = []
        for host, path, keys in lists.REDIRECTS:
            targets = [
                let(_param(v["query"], k), lambda t: F.when(F.regexp_like(t, F.lit("(?i)^https?://")), t)) for k in keys
            ]
            test = F.regexp_like(v["host"], F.lit(f"^(?:{host})$")) & F.regexp_like(v["path"], F.lit(f"^(?:{path})"))
            cases.append(F.when(test, F.coalesce(*targets)))
        v3 = F.regexp_extract(F.concat(v["path"], F.when(v["query"] != "", F.concat(F.lit("?"), v["query"])).otherwise("")),
                              r"^/v3/__(.+?)__;", 1)
        v2 = F.replace(F.replace(_param(v["query"], "u"), F.lit("-"), F.lit("%")), F.lit("_"), F.lit("/"))
        return (
            F.when(F.endswith(v["host"], F.lit("urldefense.com")) & F.startswith(v["path"], F.lit("/v3/__")),
                   F.nullif(v3, F.lit("")))
            .when(F.endswith(v["host"], F.lit("urldefense.proofpoint.com"))
                  & F.startswith(v["path"], F.lit("/v2/url")), F.nullif(_decode(v2), F.lit("")))
            .otherwise(F.coalesce(*cases))
        )

    known = "|".join(host for host, _path_, _keys in lists.REDIRECTS) + r"|.*urldefense\.(?:proofpoint\.)?com"
    parts = F.struct(url_host(url).alias("host"), _path(url).alias("path"), _query(url).alias("query"))
    return let(parts, lambda v: F.when(F.regexp_like(v["host"], F.lit(f"^(?:{known})$")), find(v)))


def _host_test(host: Column, patterns: str) -> Column:
    alternatives = []
    for p in patterns.split():
        if p.endswith(".*"):
            alternatives.append(p[:-2].replace(".", r"\.") + r"\.[a-z]{2,3}(?:\.[a-z]{2})?")
        else:
            alternatives.append(p.replace(".", r"\."))
    return F.regexp_like(host, F.lit(r"(?:^|\.)(?:" + "|".join(alternatives) + ")$"))


def is_tracking_param(name: Column, host: Column, extra=()) -> Column:
    low = F.lower(name)
    everywhere = low.isin(sorted({*lists.TRACKING_PARAMS, *(e.lower() for e in extra)}))
    prefixed = F.regexp_like(low, F.lit("^(?:" + "|".join(lists.TRACKING_PREFIXES) + ")"))
    on_site = F.lit(False)
    for hosts, params in lists.SITE_PARAMS:
        on_site = on_site | (low.isin(params.split()) & _host_test(host, hosts))
    return everywhere | prefixed | on_site


def tracking_spans(url: Column, extra=()) -> Column:
    """ARRAY<STRUCT<start, end>> of the tracking parts, offsets inside the URL."""
    span = "array<struct<start:int,end:int>>"

    def parts(v: Column) -> Column:
        def params(acc: Column, p: Column) -> Column:
            end = acc["pos"] + F.length(p)
            name = F.regexp_extract(p, "^([^=]*)", 1)
            item = F.struct(acc["pos"].cast("int").alias("s"), end.cast("int").alias("e"),
                            ((p != "") & is_tracking_param(name, v["host"], extra)).alias("drop"))
            return F.struct((end + 1).cast("int").alias("pos"), F.array_append(acc["out"], item).alias("out"))

        def runs(ps: Column) -> Column:
            n = F.size(ps)
            index = F.transform(ps, lambda _p, i: i)

            def widen(i: Column) -> Column:
                after = F.filter(index, lambda k: (k > i) & ~ps[k]["drop"])
                last = F.coalesce(F.get(after, F.lit(0)), n) - 1
                start, end = ps[i]["s"], ps[last]["e"]
                return F.struct(
                    F.when((i == 0) & (last < n - 1), start).otherwise(start - 1).cast("int").alias("start"),
                    F.when((i == 0) & (last < n - 1), end + 1).otherwise(end).cast("int").alias("end"))

            first = F.filter(index, lambda i: ps[i]["drop"] & ((i == 0) | ~F.coalesce(F.get(ps, i - 1)["drop"], F.lit(False))))
            return F.transform(first, widen)

        zero = F.struct((F.length(F.regexp_extract(url, r"(?s)^[^?#]*\?", 0))).cast("int").alias("pos"),
                        empty("array<struct<s:int,e:int,drop:boolean>>").alias("out"))
        has_query = F.regexp_like(url, F.lit(r"(?s)^[^?#]*\?"))
        query = F.when(has_query, let(
            F.aggregate(F.split(v["query"], "&", -1), zero, params, lambda a: a["out"]), runs)).otherwise(empty(span))

        lead = F.regexp_extract(url, r"(?s)^([^#]*#)(.*?):~:", 1)
        frag = F.regexp_extract(url, r"(?s)^([^#]*#)(.*?):~:", 2)
        cut = F.when(frag == "", F.length(lead) - 1).otherwise(F.length(lead) + F.length(frag))
        fragment = F.when(lead != "", F.array(F.struct(cut.cast("int").alias("start"),
                                                       F.length(url).cast("int").alias("end")))).otherwise(empty(span))
        head = F.length(F.regexp_extract(url, r"(?s)^(.*?)/ref=[^/?#]*", 1))
        ref = F.regexp_extract(url, r"/ref=[^/?#]*", 0)
        amazon = F.when((ref != "") & _host_test(v["host"], "amazon.*"), F.array(F.struct(
            head.cast("int").alias("start"), (head + F.length(ref)).cast("int").alias("end")))).otherwise(empty(span))
        return F.concat(amazon.cast(span), query.cast(span), fragment.cast(span))

    return let(F.struct(url_host(url).alias("host"), _query(url).alias("query")), parts)


def _clean_once(url: Column, extra=()) -> Column:
    def build(v: Column) -> Column:
        kept = F.filter(F.split(v["query"], "&", -1), lambda p: (p == "") | ~is_tracking_param(
            F.regexp_extract(p, "^([^=]*)", 1), v["host"], extra))
        base = F.when(_host_test(v["host"], "amazon.*"), F.regexp_replace(v["base"], r"/ref=[^/?#]*", "")).otherwise(
            v["base"])
        query = F.when(~v["has"], "").otherwise(let(kept, lambda k: F.when(F.size(k) == 0, "").otherwise(
            F.concat(F.lit("?"), F.array_join(k, "&")))))
        return F.concat(base, query, F.regexp_replace(v["frag"], r"(?s)^#?:~:.*$|(?<=.):~:.*$", ""))

    return let(F.struct(
        url_host(url).alias("host"), _query(url).alias("query"),
        F.regexp_extract(url, r"(?s)^[^?#]*", 0).alias("base"),
        F.regexp_like(url, F.lit(r"(?s)^[^?#]*\?")).alias("has"),
        F.regexp_extract(url, r"(?s)#.*$", 0).alias("frag")), build)


def clean_url(url: Column, extra_params=()) -> Column:
    """A URL column without wrappers and tracking; everything else stays as it is."""
    def step(acc: Column, _i: Column) -> Column:
        return F.coalesce(unwrap_url(acc), acc)

    # every wrapper holds the start of another address, plain or encoded
    inside = F.regexp_count(url, F.lit("(?i)https?(?::|%|-3a)"))
    plain = F.aggregate(F.sequence(F.lit(0), inside), url, step)
    return let(plain, lambda u: _clean_once(u, extra_params))
