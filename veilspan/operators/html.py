"""HTML columns: hidden parts, visible text, and rewriting text that is split over tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.functions.regex import empty, in_blocks, let, one_of
from veilspan.functions.tables import cut
from veilspan.operators.spans import apply_spans

# Tags that break a line, attributes that only format.
BLOCK_TAGS = tuple("""
p div br li ul ol tr td th table h1 h2 h3 h4 h5 h6 pre blockquote section article header
footer hr dd dt dl tbody thead tfoot title body html head option caption figure nav main
aside address center form fieldset legend
""".split())
FORMAT_ATTRIBUTES = tuple("""
style class width height align valign border cellpadding cellspacing colspan rowspan lang dir face
size color bgcolor type rel target span start nowrap frame rules scope charset xmlns
""".split())
_TAG = r"<!--(?s:.*?)-->|<!\[CDATA\[(?s:.*?)\]\]>|<![^>]*>|<\?(?s:.*?)\?>|</?[A-Za-z][^<>]*>"
_HIDDEN = r"(?is)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<script\b[^>]*>.*?</script\s*>"
_STYLE = r"(?is)<style\b[^>]*>.*?</style\s*>"
_ATTRIBUTE = r"\s[A-Za-z_:][\w:.\-]*\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'=<>`]+)"
_REFERENCE = "&#[0-9]{1,7};|&#[xX][0-9a-fA-F]{1,6};|&[A-Za-z]{2,8};"
NODE = "struct<kind:string,raw:string,name:string>"
# Named character references of HTML that stand for one character.
ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "copy": "©", "reg": "®", "middot": "·",
            "hellip": "…", "ndash": "–", "mdash": "—", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "bdquo": "„",
            "laquo": "«", "raquo": "»", "bull": "•", "euro": "€", "auml": "ä", "ouml": "ö", "uuml": "ü", "Auml": "Ä",
            "Ouml": "Ö", "Uuml": "Ü", "szlig": "ß", "eacute": "é", "egrave": "è", "ecirc": "ê", "agrave": "à",
            "aacute": "á", "ccedil": "ç", "ntilde": "ñ", "iacute": "í", "oacute": "ó", "uacute": "ú", "times": "×", "sect": "§"}


def drop_hidden(html: Column) -> Column:
    """Comments, CDATA, processing instructions and scripts go; comments inside ``<style>`` stay."""
    outside = F.split(html, _STYLE, -1)
    blocks = F.regexp_extract_all(html, F.lit(_STYLE), F.lit(0))
    joined = let(F.struct(outside.alias("o"), blocks.alias("b")), lambda v: F.array_join(F.transform(
        v["o"], lambda part, i: F.concat(F.regexp_replace(part, _HIDDEN, ""), F.coalesce(F.get(v["b"], i), F.lit("")))), ""))
    return F.when(F.regexp_like(html, F.lit(r"(?i)<!|<\?|<script")), joined).otherwise(html)


def unescape(text: Column) -> Column:
    """Named and numeric character references; unknown ones stay."""
    def whole(t: Column) -> Column:
        gaps = F.split(t, _REFERENCE, -1)
        marks = F.regexp_extract_all(t, F.lit(_REFERENCE), F.lit(0))

        def char(m: Column) -> Column:
            named = F.lit(None).cast("string")
            table = F.create_map(*[F.lit(x) for pair in {**ENTITIES, "amp": "&"}.items() for x in pair])
            number = F.when(F.regexp_like(m, F.lit("^&#[xX]")), F.conv(F.regexp_extract(m, "[xX]([0-9a-fA-F]+)", 1), 16, 10)).otherwise(
                F.regexp_extract(m, "([0-9]+)", 1)).cast("int")
            wide = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
            named = F.try_element_at(table, F.regexp_extract(m, "&([A-Za-z]+);", 1))
            return F.coalesce(F.when(F.startswith(m, F.lit("&#")), wide).otherwise(named), m)

        return let(F.struct(gaps.alias("g"), marks.alias("m")), lambda v: F.array_join(F.transform(
            v["g"], lambda g, i: F.concat(g, F.coalesce(char(F.get(v["m"], i)), F.lit("")))), ""))

    return F.when(F.contains(text, F.lit("&")), whole(text)).otherwise(text)


def escape(text: Column, quote: bool = False) -> Column:
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")] + ([('"', "&quot;"), ("'", "&#x27;")] if quote else [])
    for raw, safe in pairs:
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def nodes(html: Column) -> Column:
    """ARRAY<STRUCT<kind, raw, name>>: tags and text nodes in order, empty text left out."""
    gaps = F.split(html, _TAG, -1)
    tags = F.regexp_extract_all(html, F.lit(_TAG), F.lit(0))

    def pair(g: Column, i: Column, v: Column) -> Column:
        tag = F.get(v["t"], i)
        name = F.lower(F.regexp_extract(tag, r"^</?\s*([A-Za-z][A-Za-z0-9:\-]*)", 1))
        return F.array(
            F.struct(F.lit("text").alias("kind"), g.alias("raw"), F.lit("").alias("name")),
            F.struct(F.lit("tag").alias("kind"), F.coalesce(tag, F.lit("")).alias("raw"), F.coalesce(name, F.lit("")).alias("name")))

    every = let(F.struct(gaps.alias("g"), tags.alias("t")), lambda v: F.flatten(F.transform(
        v["g"], lambda g, i: pair(g, i, v))))
    return F.filter(every, lambda n: n["raw"] != "").cast(f"array<{NODE}>")


def _hidden_runs(node_list: Column) -> Column:
    """ARRAY<STRUCT<s, e>>: what lies between nodes s and e is inside script or style. Only their tags, which
    are few, are gone through one after the other."""
    def change(n: Column) -> Column:
        return F.when(~n["name"].isin("script", "style") | F.endswith(n["raw"], F.lit("/>")) & ~F.startswith(n["raw"], F.lit("</")), 0).when(
            F.startswith(n["raw"], F.lit("</")), -1).otherwise(1)

    def step(acc: Column, t: Column) -> Column:
        depth = F.greatest(acc["depth"] + t["c"], F.lit(0)).cast("int")
        run = F.struct(acc["s"].alias("s"), t["i"].alias("e"))
        return F.struct(depth.alias("depth"), F.when(acc["depth"] == 0, t["i"]).otherwise(acc["s"]).alias("s"),
                        F.when((acc["depth"] > 0) & (depth == 0), F.array_append(acc["out"], run)).otherwise(acc["out"]).alias("out"))

    tags = F.filter(F.transform(node_list, lambda n, i: F.struct(i.cast("int").alias("i"), change(n).alias("c"))), lambda t: t["c"] != 0)
    zero = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("s"), empty("array<struct<s:int,e:int>>").alias("out"))
    return F.aggregate(tags, zero, step, lambda a: F.when(a["depth"] > 0, F.array_append(
        a["out"], F.struct(a["s"].alias("s"), F.size(node_list).alias("e")))).otherwise(a["out"]))


def _shown_texts(node_list: Column) -> Column:
    """The nodes with what they add to the visible text (``text``). Block tags add a line break; text inside
    script and style adds nothing (``shown`` is false)."""
    def item(n: Column, i: Column, runs: Column) -> Column:
        shown = (n["kind"] == "text") & ~F.exists(runs, lambda r: (r["s"] < i) & (i < r["e"]))
        value = F.when(shown, unescape(n["raw"])).when((n["kind"] == "tag") & one_of(n["name"], BLOCK_TAGS), "\n").otherwise("")
        return F.struct(n["kind"].alias("kind"), n["raw"].alias("raw"), n["name"].alias("name"), value.alias("text"), shown.alias("shown"))

    return let(node_list, lambda v: let(_hidden_runs(v), lambda runs: F.transform(v, lambda n, i: item(n, i, runs))))


def text_stream(node_list: Column) -> Column:
    """The nodes with what they add to the visible text (``text``) and where (``start``), see ``_shown_texts``.
    Places are summed up in blocks, so the work per node does not grow with the page."""
    kind = "array<struct<kind:string,raw:string,name:string,start:int,text:string,shown:boolean>>"

    def build(v: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            n = v[i]
            return F.struct((acc["pos"] + F.length(n["text"])).cast("int").alias("pos"), F.array_append(acc["out"], F.struct(
                n["kind"].alias("kind"), n["raw"].alias("raw"), n["name"].alias("name"), acc["pos"].alias("start"),
                n["text"].alias("text"), n["shown"].alias("shown"))).alias("out"))

        def of(indices: Column, begin: Column) -> Column:
            return F.aggregate(indices, F.struct(begin.alias("pos"), empty(kind).alias("out")), step, lambda a: a["out"])

        return F.when(F.size(v) > 0, in_blocks(F.size(v), lambda i: F.length(v[i]["text"]), of)).when(v.isNotNull(), empty(kind))

    return let(_shown_texts(node_list), build)


def visible_text(html: Column) -> Column:
    return F.array_join(F.transform(_shown_texts(nodes(drop_hidden(html))), lambda n: n["text"]), "")


def attributes(tag: Column) -> Column:
    """ARRAY<STRUCT<i, name, value>> of the attribute values of a tag that may hold data."""
    found = F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), F.lit(0))
    parsed = F.transform(found, lambda a, i: F.struct(
        i.alias("i"), F.lower(F.regexp_extract(a, r"^\s([A-Za-z_:][\w:.\-]*)", 1)).alias("name"),
        F.regexp_replace(F.regexp_extract(a, r"(?s)=\s*(.*)$", 1), r"^[\"']|[\"']$", "").alias("value")))
    return F.filter(parsed, lambda a: ~one_of(a["name"], FORMAT_ATTRIBUTES)
                    & ~F.startswith(F.lower(F.ltrim(a["value"])), F.lit("data:")))


def _pieces(node_list: Column) -> Column:
    """ARRAY<STRUCT<_node, _attr, text>>: the visible text (numbers -1), then the attribute values that may hold
    data. Only tags with one are looked at, and the nodes are made once for both."""
    def build(v: Column) -> Column:
        whole = F.struct(F.lit(-1).alias("_node"), F.lit(-1).alias("_attr"), F.array_join(F.transform(v, lambda n: n["text"]), "").alias("text"))
        tags = F.filter(F.transform(v, lambda n, i: F.struct(i.alias("i"), n["kind"].alias("kind"), n["name"].alias("name"), n["raw"].alias("raw"))),
                        lambda t: (t["kind"] == "tag") & ~t["name"].isin("script", "style") & F.contains(t["raw"], F.lit("=")))
        values = F.transform(tags, lambda t: F.transform(attributes(t["raw"]), lambda a: F.struct(
            t["i"].alias("_node"), a["i"].alias("_attr"), unescape(a["value"]).alias("text"))))
        return F.concat(F.array(whole), F.flatten(values))

    return let(node_list, build)


def process_html(docs: DataFrame, process, html: str = "html", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` plus ``output``: ``process`` applied to the visible text and to attribute values.

    ``process`` gets a table (doc_id, text) and returns it with ``replacements`` and ``output``.
    Text and attributes are rows of one table, so one call treats them alike; the pieces travel,
    the markup stays where it is until the final join by ``doc_id``.
    """
    node_list = text_stream(nodes(drop_hidden(F.col(html))))
    pieces = docs.select(F.col(doc_id).alias("_doc"), F.inline_outer(_pieces(node_list))).where("_node is not null").select(
        F.when(F.col("_node") < 0, F.concat(F.col("_doc").cast("string"), F.lit("#text"))).otherwise(
            F.concat_ws("#", F.col("_doc").cast("string"), F.col("_node").cast("string"), F.col("_attr").cast("string"))).alias("doc_id"),
        "_doc", "_node", "_attr", "text")
    done = process(pieces)
    changed = done.where(F.size("replacements") > 0).groupBy("_doc").agg(
        F.first(F.when(F.col("_node") < 0, F.col("replacements")), ignorenulls=True).alias("_reps"),
        F.collect_list(F.when(F.col("_node") >= 0, F.struct("_node", "_attr", "output"))).alias("_attrs"))
    changed = cut(changed)  # one plan for finding, one for writing back
    # the nodes are made again behind the join, which so carries each page once
    joined = docs.join(changed.withColumnRenamed("_doc", doc_id), doc_id, "left").withColumn("_n", node_list)
    rebuilt = F.transform("_n", lambda n, i: F.when(n["shown"], _text_node(n)).when(
        n["kind"] == "tag", _tag_node(n["raw"], i)).otherwise(n["raw"]))
    return joined.withColumn("output", F.array_join(rebuilt, "")).drop("_n", "_reps", "_attrs")


def _references(raw: Column) -> Column:
    """ARRAY<STRUCT<at, extra>>: place of each character reference in the unescaped text, and by how much it is longer."""
    marks = F.regexp_extract_all(raw, F.lit(_REFERENCE), F.lit(0))
    pairs = F.zip_with(marks, F.split(raw, _REFERENCE, -1), lambda m, g: F.struct(m.alias("m"), g.alias("g")))

    def step(acc: Column, p: Column) -> Column:
        def add(size: Column) -> Column:
            at = acc["pos"] + F.length(p["g"])
            item = F.struct(at.cast("int").alias("at"), (F.length(p["m"]) - size).cast("int").alias("extra"))
            return F.struct((at + size).cast("int").alias("pos"), F.array_append(acc["out"], item).alias("out"))

        return let(F.length(unescape(p["m"])), add)

    zero = F.struct(F.lit(0).alias("pos"), empty("array<struct<at:int,extra:int>>").alias("out"))
    return F.aggregate(F.filter(pairs, lambda p: p["m"].isNotNull()), zero, step, lambda acc: acc["out"])


def _text_node(node: Column) -> Column:
    """A text node with its share of the replacements: the first node of an entity gets the text. What is
    not replaced stays as it is written, character references too."""
    end = node["start"] + F.length(node["text"])
    mine = F.filter(F.col("_reps"), lambda r: (r["in_start"] < end) & (node["start"] < r["in_end"]))

    def written(refs: Column) -> Column:
        def place(p: Column) -> Column:
            return (p + F.aggregate(F.filter(refs, lambda r: r["at"] < p), F.lit(0), lambda a, r: a + r["extra"])).cast("int")

        edits = F.transform(mine, lambda r: F.struct(
            place(F.greatest(r["in_start"], node["start"]) - node["start"]).alias("start"),
            place(F.least(r["in_end"], end) - node["start"]).alias("end"), r["type"].alias("type"),
            F.lit("\0").alias("text"), r["detector"].alias("detector"),
            F.when(r["in_start"] >= node["start"], escape(r["replacement"])).otherwise("").alias("replacement")))
        return apply_spans(node["raw"], edits)["output"]

    return F.coalesce(F.when(F.size(mine) > 0, let(_references(node["raw"]), written)), node["raw"])


def _tag_node(raw: Column, index: Column) -> Column:
    mine = F.filter(F.col("_attrs"), lambda a: a["_node"] == index)

    def rebuild(raw_: Column) -> Column:
        parts = F.struct(F.split(raw_, _ATTRIBUTE, -1).alias("g"),
                         F.regexp_extract_all(raw_, F.lit(_ATTRIBUTE), F.lit(0)).alias("a"))

        def one(a: Column, i: Column) -> Column:
            new = F.get(F.filter(mine, lambda m: m["_attr"] == i), F.lit(0))["output"]
            head = F.regexp_extract(a, r"(?s)^(\s[A-Za-z_:][\w:.\-]*\s*=\s*)", 1)
            return F.when(new.isNotNull(), F.concat(head, F.lit('"'), escape(new, True), F.lit('"'))).otherwise(a)

        return let(parts, lambda v: F.array_join(F.transform(v["g"], lambda g, i: F.concat(
            g, F.when(i < F.size(v["a"]), one(F.get(v["a"], i), i)).otherwise(""))), ""))

    return F.coalesce(F.when(F.size(mine) > 0, rebuild(raw)), raw)


def strip_clipboard_header(data: Column) -> Column:
    """Cut the header some platforms put in front of copied HTML (offset in ``StartHTML``)."""
    start = F.regexp_extract(data, r"(?is)^Version:\d.*?StartHTML:(-?\d+).*?EndHTML:-?\d+", 1)
    number = F.nullif(start, F.lit("")).cast("int")
    at = F.instr(data, "<")
    return F.when(number.isNull(), data).when(
        number < 0, F.when(at > 0, F.substring(data, at, F.length(data))).otherwise(data)).otherwise(
        F.substring(data, number + 1, F.length(data)))
