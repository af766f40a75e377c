"""Format-preserving surrogates, made once per distinct (type, original).

Three kinds of originals:

* numbers, addresses and secrets get a surrogate from one expression (``number_surrogate``);
* names, domains, accounts and organisations are split into parts (``parts_of``); the parts that
  identify somebody get a word of their own in a token map and the rest stays;
* fixed replacements of custom terms are taken as they are.

Everything is keyed, so one key gives one result in whatever order the texts come.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan import lists
from veilspan.functions import ip
from veilspan.functions import text as tx
from veilspan.functions.regex import empty, let, one_of
from veilspan.functions.tables import FEW_PENDING, claim, cut, lookup, not_taken, spread, union_all
from veilspan.lists import Context
from veilspan.operators.detect import domain_allowed, ip_allowed
from veilspan.schema import IP_TYPES
from veilspan.sources.state import State

PART = "struct<map:string,text:string>"
PARTS = f"array<{PART}>"
ATTEMPTS = 8
WORD_TYPES = ("EMAIL", "DOMAIN", "HOSTNAME", "USERNAME", "PERSON", "ORG", "LOCATION", "IDENTIFIER", "CUSTOM")
SECRET_LIKE = ("SECRET", "PRIVATE_KEY", "CERTIFICATE")
ORIGINAL = ("type string, original string, as_type string, replacement string, kind string, keep_prefix int, "
            "count bigint, first_seen timestamp, last_seen timestamp")


# ---------------------------------------------------------------- numbers, addresses, secrets
def mac_surrogate(text: Column, seed: Column, keep_oui: bool = True) -> Column:
    """Other device part, same vendor part (or same address bits), case and separators."""
    def build(h: Column) -> Column:
        digest = F.sha2(seed, 256)
        first = F.conv(F.substring(h, 1, 2), 16, 10).cast("int").bitwiseAND(3)
        free = F.lpad(F.lower(F.hex((tx.hash_int(digest, 32, 2).bitwiseAND(252)).cast("int") + first)), 2, "0")
        fresh = F.concat(F.substring(h, 1, 6), F.substring(digest, 1, 6)) if keep_oui else F.concat(
            free, F.substring(digest, 1, 10))
        upper = F.regexp_like(h, F.lit("[A-F]")) & ~F.regexp_like(h, F.lit("[a-f]"))
        cased = F.when(upper, F.upper(fresh)).otherwise(F.lower(fresh))
        special = F.lower(h).isin("0" * 12, "f" * 12) | (F.length(h) != 12)
        return F.when(~special, _refill(text, "[0-9A-Fa-f]", cased))

    return let(F.regexp_replace(text, "[^0-9A-Fa-f]", ""), build)


def _refill(text: Column, pattern: str, fresh: Column) -> Column:
    """Write the characters of ``fresh`` into the places of ``text`` that match ``pattern``."""
    def step(acc: Column, c: Column) -> Column:
        slot = F.regexp_like(c, F.lit(f"^{pattern}$"))
        return F.struct(
            F.concat(acc["out"], F.when(slot, F.substring(acc["src"], acc["i"] + 1, F.lit(1))).otherwise(c)).alias("out"),
            F.when(slot, acc["i"] + 1).otherwise(acc["i"]).cast("int").alias("i"), acc["src"].alias("src"))

    return let(fresh, lambda f: F.aggregate(tx.chars(text), F.struct(
        F.lit("").alias("out"), F.lit(0).alias("i"), f.alias("src")), step, lambda a: a["out"]))


def phone_surrogate(text: Column, seed: Column) -> Column:
    """Country code, leading zero and "(0)" stay, the other digits change, the layout stays."""
    def code_length(digits: Column) -> Column:
        return F.when(F.regexp_like(digits, F.lit("^[17]")), 1).when(
            F.substring(digits, 1, 2).isin(*lists.CALLING_CODES_2), 2).when(digits == "", 0).otherwise(3)

    def build(v: Column) -> Column:
        keep = (
            F.when(F.startswith(v["t"], F.lit("+")), code_length(v["d"]) + 1)
            .when(F.startswith(v["t"], F.lit("00")), code_length(F.substring(v["d"], F.lit(3), F.length(v["d"]))) + 2)
            .when(F.startswith(v["t"], F.lit("0")), 1).otherwise(0))
        rule = F.concat(F.lit("^(?:[^0-9+]*[0-9+]){"), keep.cast("string"), F.lit("}"))
        index = F.length(F.call_function("regexp_extract", v["t"], rule, F.lit(0)))
        changed = tx.digits_like(v["t"], seed, index)
        at = F.instr(v["t"], "(0)")
        return let(changed, lambda c: F.when(at > 0, F.concat(
            F.substring(c, F.lit(1), at - 1), F.lit("(0)"), F.substring(c, at + 3, F.length(c)))).otherwise(c))

    return let(F.struct(text.alias("t"), F.regexp_replace(text, "[^0-9]", "").alias("d")), build)


def iban_surrogate(text: Column, seed: Column) -> Column:
    """Same country and layout, other account, right check digits."""
    def build(c: Column) -> Column:
        country = F.upper(F.substring(c, 1, 2))
        account = tx.randomize_chars(F.substring(c, F.lit(5), F.length(c)), seed, 0, False)
        return _refill(text, "[^ ]", let(account, lambda a: F.concat(
            country, tx.iban_check_digits(country, F.upper(a)), a)))

    return let(F.replace(text, F.lit(" "), F.lit("")), build)


def card_surrogate(text: Column, seed: Column) -> Column:
    """Same first digit, length and layout, valid check digit."""
    def build(d: Column) -> Column:
        middle = tx.digits_like(F.repeat(F.lit("0"), F.length(d) - 2), seed, 0, False)
        body = F.concat(F.substring(d, 1, 1), middle)
        return _refill(text, "[0-9]", let(body, lambda b: F.concat(b, tx.luhn_digit(b))))

    return let(F.regexp_replace(text, "[^0-9]", ""), build)


def sid_surrogate(text: Column, key: Column, attempt: int = 0) -> Column:
    """Other authority parts, keyed by the whole authority, same account number."""
    head = F.regexp_extract(text, r"^S-1-5-21-(\d+-\d+-\d+)", 1)
    digest = tx.keyed_hash(key, F.lit("sid"), head, F.lit(attempt))
    parts = let(digest, lambda h: F.concat_ws("-", *[
        (tx.hash_int(h, 10 * i, 9) % 4194967295 + 100000000).cast("string") for i in range(3)]))
    return F.when(head != "", F.concat(F.lit("S-1-5-21-"), parts, F.regexp_extract(
        text, r"^S-1-5-21-\d+-\d+-\d+(-\d+)?$", 1)))


def ip_surrogate(text: Column, key: Column, ctx: Context, versions=(4, 6)) -> Column:
    """Address, network (``net/24``) or host in a network (``10.1.2.3/24``); IPv6 keeps upper case."""
    def build(v: Column) -> Column:
        bounds = ip.network_bounds(v["a"], v["p"])
        is_net = let(bounds, lambda b: b["lo"] == ip.address_hex(v["a"]))
        mapped = ip.map_ip(v["a"], key, ctx.keep_special_hosts, versions)

        def finish(m: Column) -> Column:
            net = let(ip.network_bounds(m, v["p"]), lambda b: ip.hex_to_address(b["lo"], ip.version_of(m)))
            out = F.when(v["p"].isNull(), m).otherwise(F.concat(F.when(is_net, net).otherwise(m), F.lit("/"), v["p"].cast("string")))
            return F.when(v["a"] != F.lower(v["a"]), F.upper(out)).otherwise(out)

        return let(mapped, finish)

    prefix = F.nullif(F.regexp_extract(text, r"/(\d+)$", 1), F.lit("")).cast("int")
    changed = let(F.struct(F.substring_index(text, "/", 1).alias("a"), prefix.alias("p")), build)
    return F.when(~ip_allowed(text, ctx), changed)


def number_surrogate(key: Column, ctx: Context, attempt: int, types: tuple) -> Column:
    """Surrogate for every type that is no composition of words (columns ``type``, ``original`` …). Only
    the branches of the ``types`` at hand get into the plan."""
    text, typ = F.col("original"), F.coalesce(F.nullif(F.col("as_type"), F.lit("")), F.col("type"))
    seed = tx.keyed_hash(key, F.lit("value"), typ, text, F.lit(attempt))
    versions = tuple(n for t, n in zip(IP_TYPES, (4, 6), strict=True) if t in types)
    rules = (
        (IP_TYPES, lambda: ip_surrogate(text, key, ctx, versions)),
        (("MAC",), lambda: mac_surrogate(text, seed, ctx.mac_keep_oui)),
        (("PHONE",), lambda: phone_surrogate(text, seed)),
        (("IBAN",), lambda: iban_surrogate(text, seed)),
        (("CREDIT_CARD",), lambda: card_surrogate(text, seed)),
        (("SID",), lambda: sid_surrogate(text, key, attempt)),
        (SECRET_LIKE, lambda: tx.randomize_chars(text, seed, F.coalesce(F.col("keep_prefix"), F.lit(0)))),
        (("FINGERPRINT",), lambda: tx.randomize_chars(text, seed, 0, F.regexp_like(text, F.lit(r"^[0-9A-Fa-f:\- ]+$")))),
    )
    return _choose(typ, [(names, build) for names, build in rules if set(names) & set(types)])


def _choose(typ: Column, rules: list) -> Column:
    out = None
    for names, build in rules:
        test = typ.isin(*names)
        out = F.when(test, build()) if out is None else out.when(test, build())
    return out


# ---------------------------------------------------------------- compositions of words
def _part(map_: str | None, text: Column) -> Column:
    return F.struct(F.lit(map_).cast("string").alias("map"), text.alias("text"))


def _plain(text: Column) -> Column:
    return F.array(_part(None, text)).cast(PARTS)


def label_parts(label: Column, force: bool, ctx: Context, key: Column) -> Column:
    """Letters of a label become words; generic labels and digits stay. ``force``: something changes."""
    generic = F.lit(ctx.generic())

    def build(runs: Column) -> Column:
        parts = F.transform(runs, lambda r: F.struct(
            F.when(F.regexp_like(r, F.lit(f"^[{tx.LETTER}]{{3,}}")) & ~F.regexp_like(F.lower(r), generic), "words").alias("map"),
            r.alias("text")).cast(PART))
        if not force:
            return parts

        def forced(ps: Column) -> Column:
            order = F.array_sort(F.filter(F.transform(runs, lambda r, i: F.struct(
                F.length(r).alias("n"), i.alias("i"), F.regexp_like(r, F.lit(f"^[{tx.LETTER}]")).alias("a"))), lambda s: s["a"]))
            best = F.element_at(order, -1)["i"]
            marked = F.transform(runs, lambda r, i: F.struct(F.when(i == best, "words").alias("map"), r.alias("text")).cast(PART))
            digits = _plain(tx.digits_like(label, tx.keyed_hash(key, F.lit("label"), label), 0, False))
            return F.when(F.exists(ps, lambda p: p["map"].isNotNull()), ps).when(F.size(order) > 0, marked).otherwise(digits)

        return let(parts, forced)

    runs = F.regexp_extract_all(label, F.lit(f"[{tx.LETTER}]+|[0-9]+|[^{tx.LETTER}0-9]+"), F.lit(0))
    split = let(runs, build)
    return split if force else F.when(F.regexp_like(F.lower(label), generic), _plain(label)).otherwise(split)


def registrable(host: Column) -> Column:
    """STRUCT<labels, n>: the labels of a host and how many of them are the public suffix."""
    two = one_of(F.lower(F.substring_index(host, ".", -2)), lists.TWO_LABEL_SUFFIXES)
    return let(F.split(host, r"\."), lambda p: F.struct(
        p.alias("labels"), F.when((F.size(p) >= 3) & two, 2).otherwise(1).alias("n")))


def domain_parts(host: Column, ctx: Context, key: Column) -> Column:
    """Parts of a host name, NULL where it stays (allowed domains, bare suffixes)."""
    def build(v: Column) -> Column:
        size = F.size(v["labels"])
        own = size - v["n"]
        subs = F.flatten(F.transform(F.slice(v["labels"], F.lit(1), own - 1), lambda x: F.concat(
            label_parts(x, False, ctx, key), _plain(F.lit(".")))))
        suffix = F.lit("example") if ctx.tld_strategy == "example" else F.array_join(
            F.slice(v["labels"], own + 1, v["n"]), ".")
        reg = label_parts(F.element_at(v["labels"], own), True, ctx, key)
        return F.when(own >= 1, F.concat(subs, reg, _plain(F.concat(F.lit("."), suffix))))

    return F.when(~domain_allowed(host, ctx), let(registrable(host), build))


def local_parts(local: Column, key: Column) -> Column:
    """Account names: two and more alphabetic parts are first and last names, else one account word."""
    def build(v: Column) -> Column:
        pieces = F.regexp_extract_all(v["base"], F.lit(r"[._+-]|[^._+-]+"), F.lit(0))

        def named(ps: Column) -> Column:
            index = F.filter(F.transform(ps, lambda p, i: F.when(F.regexp_like(p, F.lit(r"^\p{L}")), i)), lambda i: i.isNotNull())

            def mark(ix: Column) -> Column:
                last = F.element_at(ix, -1)
                many = F.transform(ps, lambda p, i: F.struct(
                    F.when(F.array_contains(ix, i) & (F.length(p) > 1),
                           F.when(i == last, "last").otherwise("first")).alias("map"), p.alias("text")).cast(PART))
                return F.when(F.size(ix) >= 2, F.concat(many, _plain(v["digits"]))).when(
                    v["base"] == "", _plain(tx.digits_like(local, tx.keyed_hash(key, F.lit("userdigits"), local)))).otherwise(
                    F.concat(F.array(_part("users", v["base"])).cast(PARTS), _plain(v["digits"])))

            return let(index, mark)

        return let(pieces, named)

    return let(F.struct(F.regexp_extract(local, r"(?s)^(.*?)([0-9]*)$", 1).alias("base"),
                        F.regexp_extract(local, r"(?s)^(.*?)([0-9]*)$", 2).alias("digits")), build)


def email_parts(mail: Column, ctx: Context, key: Column) -> Column:
    def build(v: Column) -> Column:
        local = F.when(one_of(F.lower(v["local"]), lists.FUNCTIONAL_MAILBOXES), _plain(v["local"])).otherwise(
            local_parts(v["local"], key))
        return F.concat(local, _plain(F.lit("@")), F.coalesce(domain_parts(v["dom"], ctx, key), _plain(v["dom"])))

    return let(F.struct(F.regexp_extract(mail, r"(?s)^(.*)@([^@]*)$", 1).alias("local"),
                        F.regexp_extract(mail, r"(?s)^(.*)@([^@]*)$", 2).alias("dom")), build)


def person_parts(name: Column, kind: Column) -> Column:
    """Names: titles stay, "Last, First" is understood; a single word is decided later (map ``single``)."""
    def build(ps: Column) -> Column:
        def is_name(p: Column) -> Column:
            return F.regexp_like(p, F.lit(r"^\p{L}")) & ~one_of(F.lower(p), lists.NAME_TITLES)

        index = F.filter(F.transform(ps, lambda p, i: F.when(is_name(p), i)), lambda i: i.isNotNull())
        comma = F.exists(ps, lambda p: F.contains(p, F.lit(",")))

        def mark(ix: Column) -> Column:
            last = F.when(comma, ix[0]).otherwise(F.element_at(ix, -1))
            single = F.when(kind.isin("first", "last"), kind).otherwise("single")
            return F.transform(ps, lambda p, i: F.struct(
                F.when(F.array_contains(ix, i), F.when(F.size(ix) == 1, single).when(i == last, "last").otherwise("first"))
                .alias("map"), p.alias("text")).cast(PART))

        return let(index, lambda ix: F.when(F.size(ix) > 0, mark(ix)))

    return let(F.regexp_extract_all(name, F.lit(r"(?U)\s+|-|,\s*|[^\s,-]+"), F.lit(0)), build)


def org_parts(name: Column, key: Column) -> Column:
    """Organisations: legal forms, generic and short words stay, digits change, a word always changes."""
    def build(ts: Column) -> Column:
        def core(t: Column) -> Column:
            return F.lower(F.regexp_replace(t, r"^[.,()]+|[.,()]+$", ""))

        def one(t: Column) -> Column:
            word = F.regexp_like(t, F.lit(r"^\p{L}")) & ~one_of(core(t), (*lists.LEGAL_FORM_WORDS, *lists.ORG_GENERIC)) & (
                F.length(core(t)) > 2)
            number = F.regexp_like(t, F.lit("^[0-9]"))
            digits = tx.randomize_chars(t, tx.keyed_hash(key, F.lit("org-num"), t))
            return F.struct(F.when(word, "words").alias("map"), F.when(number, digits).otherwise(t).alias("text")).cast(PART)

        first = F.array_position(F.transform(ts, lambda t: F.regexp_like(t, F.lit(r"^\p{L}"))), F.lit(True)) - 1
        forced = F.transform(ts, lambda t, i: F.struct(F.when(i == first, "words").alias("map"), t.alias("text")).cast(PART))
        changed = F.exists(ts, lambda t: F.regexp_like(t, F.lit("^[0-9]")))
        return let(F.transform(ts, one), lambda ps: F.when(
            changed | F.exists(ps, lambda p: p["map"].isNotNull()), ps).otherwise(forced))

    return let(F.regexp_extract_all(name, F.lit(r"(?U)\s+|&|,|[^\s&,]+"), F.lit(0)), build)


def run_parts(text: Column, shortest: int) -> Column:
    """Letter runs of a minimum length become words."""
    runs = F.regexp_extract_all(text, F.lit(f"(?s)[{tx.LETTER}]+|[^{tx.LETTER}]+"), F.lit(0))
    return F.transform(runs, lambda r: F.struct(
        F.when(F.regexp_like(r, F.lit(f"^[{tx.LETTER}]{{{shortest},}}")), "words").alias("map"), r.alias("text")).cast(PART))


def parts_of(key: Column, ctx: Context, types: tuple) -> Column:
    """Parts for the word types (columns ``type``, ``original``, ``as_type``, ``kind``), else NULL."""
    text = F.col("original")
    typ = F.coalesce(F.nullif(F.col("as_type"), F.lit("")), F.col("type"))
    rules = (
        ("EMAIL", lambda: email_parts(text, ctx, key)),
        ("DOMAIN", lambda: domain_parts(text, ctx, key)),
        ("HOSTNAME", lambda: label_parts(text, True, ctx, key)),
        ("USERNAME", lambda: F.when(~one_of(F.lower(text), lists.SKIP_USERNAMES), local_parts(text, key))),
        ("PERSON", lambda: person_parts(text, F.col("kind"))),
        ("ORG", lambda: org_parts(text, key)),
        ("LOCATION", lambda: run_parts(text, 3)),
        ("IDENTIFIER", lambda: run_parts(text, 2)),
        ("CUSTOM", lambda: F.when(F.regexp_like(text, F.lit("[A-Za-z]")), run_parts(text, 2)).otherwise(
            _plain(tx.digits_like(text, tx.keyed_hash(key, F.lit("custom"), text))))),
    )
    return _choose(typ, [((name,), build) for name, build in rules if name in types])


def with_parents(originals: DataFrame, ctx: Context) -> DataFrame:
    """Add the domains behind e-mail addresses and the registrable parent of every domain, counted 0."""
    def context_rows(rows: DataFrame, value: Column) -> DataFrame:
        return rows.select(
            F.lit("DOMAIN").alias("type"), value.alias("original"), F.lit("").alias("as_type"), F.lit("").alias("replacement"),
            F.lit("").alias("kind"), F.lit(0).alias("keep_prefix"), F.lit(0).cast("bigint").alias("count"),
            F.lit(None).cast("timestamp").alias("first_seen"), F.lit(None).cast("timestamp").alias("last_seen"),
        ).where(F.col("original").isNotNull() & (F.col("original") != ""))

    mail = context_rows(originals.where("type = 'EMAIL'"), F.substring_index("original", "@", -1))
    hosts = originals.where("type = 'DOMAIN'").select("original").unionByName(mail.select("original"))
    parent = let(registrable(F.col("original")), lambda v: F.when(
        F.size(v["labels"]) > v["n"] + 1, F.array_join(F.slice(v["labels"], F.size(v["labels"]) - v["n"], v["n"] + 1), ".")))
    everything = union_all([originals, mail, context_rows(hosts, parent)])
    merged = everything.groupBy("type", "original").agg(
        F.max("as_type").alias("as_type"), F.max("replacement").alias("replacement"), F.max("kind").alias("kind"),
        F.max("keep_prefix").alias("keep_prefix"), F.sum("count").alias("count"), F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"))
    return merged


# ---------------------------------------------------------------- token maps
def _name_draw(new: DataFrame, kind: str, pool: tuple, used: DataFrame, blocked: DataFrame | None, key: Column) -> DataFrame:
    """Names from the pool without repetition: the tokens with the smallest hashes take the free names in
    keyed order. Both sides have at most as many rows as the pool."""
    from pyspark.sql import Window

    spark = new.sparkSession
    names = spark.createDataFrame([(n.lower(),) for n in pool], "surrogate string")
    free = names.join(used.where(F.col("map") == kind).select("surrogate"), "surrogate", "left_anti")
    if blocked is not None:
        free = free.join(blocked, "surrogate", "left_anti")
    order = Window.orderBy("_h")
    left = new.where(F.col("map") == kind).withColumn("_h", tx.keyed_hash(key, F.lit("name-" + kind), F.col("token"))).orderBy(
        "_h").limit(len(pool)).withColumn("_r", F.row_number().over(order))
    right = free.withColumn("_h", tx.keyed_hash(key, F.lit("pool-" + kind), F.col("surrogate"))).withColumn(
        "_r", F.row_number().over(order)).select("surrogate", "_r")
    return left.join(F.broadcast(right), "_r").where(F.col("surrogate") != F.col("token")).select("map", "token", "surrogate")


def assign_tokens(tokens: DataFrame, known: DataFrame, key: Column, blocked: DataFrame | None = None) -> DataFrame:
    """New rows (map, token, surrogate) for the tokens that have none; unique per map, no context word."""
    new = cut(tokens.select("map", "token").distinct().join(known.select("map", "token"), ["map", "token"], "left_anti"))
    present = sorted(r["map"] for r in new.select("map").distinct().collect())  # a handful
    if not present:
        return new.withColumn("surrogate", F.lit(None).cast("string"))
    used = known.select("map", "surrogate")
    draws = [_name_draw(new, kind, pool, used, blocked, key) for kind, pool in (("first", lists.FIRST_NAMES), ("last", lists.LAST_NAMES)) if kind in present]
    drawn = cut(union_all(draws)) if draws else new.limit(0).withColumn("surrogate", F.lit(None).cast("string"))
    rest = new.join(drawn, ["map", "token"], "left_anti") if draws else new

    def candidate(n: int) -> Column:
        seed = tx.keyed_hash(key, F.lit("token"), F.col("map"), F.col("token"), F.lit(n))
        word = tx.pseudo_word(seed, F.length("token") + n // 2)
        if n >= 10:  # tiny name spaces are full: lengthen by letters of the hash
            letters = F.translate(F.substring(F.sha2(seed, 256), 1, n - 6), "0123456789", "ghklmnprst")
            word = F.concat(word, letters)
        first, last = lists.FIRST_NAMES, lists.LAST_NAMES
        initials = F.array(*[F.lit(x[0].lower()) for x in first])
        lasts = F.array(*[F.lit(x.lower()) for x in last])
        digest = F.sha2(seed, 256)
        pick = F.get(lasts, (tx.hash_int(digest, 8) % len(last)).cast("int"))
        account = F.concat(
            F.get(initials, (tx.hash_int(digest, 0) % len(first)).cast("int")),
            F.when(tx.hash_int(digest, 16, 2) < 154, pick).otherwise(F.substring(pick, 1, 6)))
        out = F.when((F.col("map") == "users") & F.lit(n < 4), account).otherwise(word)
        return F.when(out != F.col("token"), out)

    def blocked_pairs() -> DataFrame | None:
        taken = union_all([used, drawn.select("map", "surrogate")])
        if blocked is None:
            return taken
        maps = F.explode(F.array(*[F.lit(m) for m in ("words", "first", "last", "users") if m in present]).cast("array<string>"))
        return taken.unionByName(blocked.select(maps.alias("map"), "surrogate"))

    claimed = _claim_tokens(rest, candidate, blocked_pairs())
    return union_all([drawn, claimed]).select("map", "token", "surrogate")


def _claim_tokens(rest: DataFrame, candidate, taken: DataFrame) -> DataFrame:
    """Like ``claim``, but a candidate of NULL only means "try again"."""
    def value(n: int) -> Column:
        return F.coalesce(candidate(n), F.col("token"))

    pending = cut(rest)
    if pending.isEmpty():
        return pending.withColumn("surrogate", F.lit(None).cast("string"))
    done: list[DataFrame] = []
    few = False
    for n in range(24):
        proposed = pending.withColumn("surrogate", value(n)).where(F.col("surrogate") != F.col("token"))
        proposed = not_taken(proposed, taken, ["map", "surrogate"], few)
        if done:
            proposed = not_taken(proposed, union_all([d.select("map", "surrogate") for d in done]), ["map", "surrogate"], few)
        won = cut(proposed.groupBy("map", "surrogate").agg(F.min("token").alias("token")))
        done.append(won)
        pending = cut(pending.join(won.select("map", "token"), ["map", "token"], "left_anti"))
        left = pending.count()
        if not left:
            return union_all(done)
        few = left <= FEW_PENDING
    raise RuntimeError("tokens without a surrogate of their own are left")


# ---------------------------------------------------------------- assignment
_built: dict[tuple, Column] = {}


def _own_type(ctx: Context, types: tuple) -> list[str]:
    """Types at hand whose surrogates the context makes."""
    return [t for t in types if t in ctx.generators]


def own_surrogate(key: Column, ctx: Context, attempt: int, types: tuple) -> Column | None:
    """The values of the context's generators (columns ``type``, ``original``, ``as_type``)."""
    typ = F.coalesce(F.nullif(F.col("as_type"), F.lit("")), F.col("type"))
    return _choose(typ, [((t,), lambda t=t: ctx.generators[t](F.col("original"), key, attempt).cast("string")) for t in _own_type(ctx, types)])


def _when_built(test: Column, value: Column | None, ddl: str) -> Column:
    return F.lit(None).cast(ddl) if value is None else F.when(test, value)


def _session_cached(build, key: Column, ctx: Context, *args) -> Column:
    """Build a large expression once per session and key, not once per table."""
    known = (build.__name__, id(SparkSession.active()._jsparkSession), str(key), repr(ctx), args)
    if known not in _built:
        _built[known] = build(key, ctx, *args)
    return _built[known]


def assign(originals: DataFrame, state: State, project: str, key: Column, ctx: Context | None = None,
           blocked: DataFrame | None = None) -> State:
    """The state with surrogates for all ``originals`` (schema ``ORIGINAL``) and their usage counted.

    ``blocked(surrogate)`` are words of the texts, which no new word may equal.
    """
    ctx = ctx or Context()
    here = F.col("project") == project
    mappings = state.mappings.where(here).drop("project")
    known_tokens = state.token_map.where(here).drop("project")
    usage = cut(with_parents(originals, ctx))
    new = usage.join(mappings.select("type", "original"), ["type", "original"], "left_anti")

    # the types at hand (a handful) decide which branches are built
    types = tuple(sorted({t for r in new.select("type", "as_type").distinct().collect() for t in r if t}))

    own_types = _own_type(ctx, types)
    is_own = F.coalesce(F.nullif(F.col("as_type"), F.lit("")), F.col("type")).isin(*own_types) if own_types else F.lit(False)
    fixed = F.nullif(F.col("replacement"), F.lit(""))
    one_word = ~F.contains(fixed, F.lit(" ")) & ~F.contains(F.col("original"), F.lit(" "))
    prepared = cut(spread(new, "original").withColumn("_fixed", F.when(one_word, tx.transfer_case(F.col("original"), fixed)).otherwise(fixed))
                   .withColumn("parts", _when_built(F.col("_fixed").isNull() & ~is_own, _session_cached(parts_of, key, ctx, types), PARTS)))

    # words of the compositions, and the words they get
    pieces = prepared.where(F.col("parts").isNotNull()).select("type", "original", F.posexplode("parts").alias("pos", "p")).select(
        "type", "original", "pos", F.col("p.map").alias("map"), F.col("p.text").alias("text"), F.lower("p.text").alias("token"))
    sure = pieces.where(F.col("map").isin("words", "first", "last", "users")).select("map", "token").distinct()
    names = union_all([sure, known_tokens.select("map", "token")]).where(F.col("map").isin("first", "last")).groupBy("token").agg(
        F.bool_or(F.col("map") == "last").alias("is_last"))
    pieces = lookup(pieces, names, ["token"], F.struct("type", "original")).withColumn(
        "map", F.when(F.col("map") == "single", F.when(F.col("is_last").isNull() | F.col("is_last"), "last").otherwise("first"))
        .otherwise(F.col("map")))
    pieces = cut(pieces)
    replaced = ctx.replacements()
    custom = F.try_element_at(F.from_json(F.lit(json.dumps(replaced)), "map<string,string>"), F.col("token"))
    wanted = pieces.where(F.col("map").isNotNull() & (~F.lit(bool(replaced)) | custom.isNull() | (F.col("map") != "words")))
    fresh = cut(assign_tokens(wanted, known_tokens, key, blocked))
    token_map = union_all([known_tokens, fresh])

    worded = lookup(pieces, token_map, ["map", "token"], F.struct("type", "original"))
    if replaced:
        worded = worded.withColumn("surrogate", F.when((F.col("map") == "words") & custom.isNotNull(), custom).otherwise(F.col("surrogate")))
    text = F.when(F.col("surrogate").isNull(), F.col("text")).when(
        F.contains(F.col("surrogate"), F.lit(" ")), F.col("surrogate")).otherwise(
        tx.transfer_case(F.col("text"), F.col("surrogate")))
    composed = worded.withColumn("_t", text).groupBy("type", "original").agg(
        F.array_sort(F.collect_list(F.struct("pos", "_t"))).alias("l")).select(
        "type", "original", F.array_join(F.transform("l", lambda x: x["_t"]), "").alias("_composed"))

    candidates = prepared.join(composed, ["type", "original"], "left").withColumn("_base", F.coalesce("_fixed", "_composed"))

    def number_of(n: int) -> Column | None:
        number = _session_cached(number_surrogate, key, ctx, n, types)
        if not own_types:
            return number
        own = own_surrogate(key, ctx, n, types)
        return own if number is None else F.when(is_own, own).otherwise(number)

    pending = cut(spread(candidates, "original").withColumn("_first", _when_built(F.col("_base").isNull(), number_of(0), "string")))
    if own_types:  # a generator may pass its first numbers; the last resort is the type and a hash
        resort = F.concat(F.lower("type"), F.lit("-"), F.substring(tx.keyed_hash(key, F.col("type"), F.col("original")), 1, 12))
        values = [own_surrogate(key, ctx, n, types) for n in range(1, ATTEMPTS)]
        pending = pending.withColumn("_first", F.when(is_own & F.col("_base").isNull(), F.coalesce("_first", *values, resort)).otherwise(F.col("_first")))
    pending = pending.where(F.regexp_like("original", F.lit("[A-Za-z0-9]")) | F.col("_base").isNotNull()).where(
        F.coalesce("_base", "_first").isNotNull() & (F.col("_base").isNull() | (F.col("_base") != F.col("original"))))

    taken = mappings.select("surrogate")

    def candidate(n: int) -> Column:
        tail = F.substring(tx.keyed_hash(key, F.col("type"), F.col("original")), 1, min(4 + 4 * max(n - ATTEMPTS, 0), 32))
        number = F.col("_first") if n == 0 else number_of(min(n, ATTEMPTS - 1))
        number = F.lit(None).cast("string") if number is None else number
        number = F.when(number != F.col("original"), number) if n < ATTEMPTS else F.concat(F.coalesce(number, "_first"), F.lit("-"), tail)
        based = F.col("_base") if n == 0 else F.concat("_base", F.lit("-"), F.substring(
            tx.keyed_hash(key, F.col("type"), F.col("original")), 1, min(4 * n, 32)))
        return F.when(F.col("_fixed").isNotNull(), F.col("_fixed")).when(F.col("_base").isNotNull(), based).otherwise(number)

    forced = pending.where(F.col("_fixed").isNotNull()).select("type", "original", F.col("_fixed").alias("surrogate"))
    own = claim(pending.where(F.col("_fixed").isNull()), candidate, ["type", "original"], [], union_all(
        [taken, forced.select("surrogate")]), ATTEMPTS + 6)
    added = cut(union_all([forced, own.select("type", "original", "surrogate")]))

    # usage: existing rows and new rows in one aggregation
    merged = union_all([
        mappings,
        added.join(usage, ["type", "original"]).select("type", "original", "surrogate", "count", "first_seen", "last_seen"),
        usage.join(mappings.select("type", "original", "surrogate"), ["type", "original"]).select(
            "type", "original", "surrogate", "count", "first_seen", "last_seen"),
    ]).groupBy("type", "original", "surrogate").agg(
        F.sum("count").alias("count"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))

    def mine(df: DataFrame) -> DataFrame:
        return df.withColumn("project", F.lit(project))

    networks = networks_of(added.where(F.col("type").isin(*IP_TYPES)))
    return State(
        cut(union_all([state.mappings.where(~here), mine(merged).select(*state.mappings.columns)])),
        union_all([state.token_map, mine(fresh).select(*state.token_map.columns)]),
        cut(union_all([state.networks, mine(networks).select(*state.networks.columns)]).distinct()),
        state.placeholders,
    )


def networks_of(rows: DataFrame) -> DataFrame:
    """(version, cidr, lo, hi) of the surrogate networks: the written prefix, else /24 or /64."""
    address = F.substring_index("surrogate", "/", 1)
    version = ip.version_of(address)
    written = F.nullif(F.regexp_extract("surrogate", r"/(\d+)$", 1), F.lit("")).cast("int")
    bits = F.coalesce(written, F.when(version == 6, 64).otherwise(24))
    out = rows.select(version.alias("version"), bits.alias("bits"), ip.network_bounds(address, bits).alias("b"))
    return out.select(
        F.col("version").cast("int").alias("version"),
        F.concat(ip.hex_to_address(F.col("b.lo"), F.col("version")), F.lit("/"), F.col("bits").cast("string")).alias("cidr"),
        F.col("b.lo").alias("lo"), F.col("b.hi").alias("hi")).distinct()


# ---------------------------------------------------------------- placeholders
def number_placeholders(firsts: DataFrame, state: State, project: str, key: Column, buckets: int = 256) -> State:
    """``n`` per type in order of the first occurrence; only keyed hashes are kept.

    ``firsts(type, original, first)`` holds one sortable value per original. The order is global per
    type, so numbers come from counts per range of ``first`` plus a rank inside the range: no task
    sorts a whole type.
    """
    from pyspark.sql import Window

    here = state.placeholders.where(F.col("project") == project).drop("project")
    hashed = firsts.select("type", tx.keyed_hash(key, F.col("type"), F.col("original")).alias("hash"), "first")
    new = cut(hashed.join(here.select("type", "hash"), ["type", "hash"], "left_anti"))
    cuts = range_cuts(new, "first", buckets)
    ranged = new.withColumn("_b", bucket_of(F.col("first"), cuts, new.schema["first"].dataType.simpleString()))
    sizes = ranged.groupBy("type", "_b").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(
        Window.partitionBy("type").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    start = here.groupBy("type").agg(F.max("n").alias("_start"))
    ranked = ranged.withColumn("_r", F.row_number().over(Window.partitionBy("type", "_b").orderBy("first", "hash")))
    numbered = ranked.join(F.broadcast(before), ["type", "_b"]).join(F.broadcast(start), "type", "left").select(
        F.lit(project).alias("project"), "type", "hash",
        (F.col("_r") + F.col("_before") + F.coalesce("_start", F.lit(0))).cast("bigint").alias("n"))
    return State(state.mappings, state.token_map, state.networks,
                 cut(union_all([state.placeholders, numbered.select(*state.placeholders.columns)])))


def range_cuts(df: DataFrame, column: str, buckets: int) -> list:
    """At most ``buckets`` split points of a sortable column, from a sample of bounded size."""
    total = df.count()
    if total < 10_000:
        return []
    share = 1 << 40  # fine enough that a sample of any table is some 40 values per bucket
    points = df.select(column).where(
        F.pmod(F.xxhash64(column), F.lit(share)) < int(min(1.0, 40 * buckets / total) * share)).distinct().orderBy(column).collect()
    step = max(1, len(points) // buckets)
    return [p[0] for p in points[step::step]]


def bucket_of(value: Column, cuts: list, ddl: str) -> Column:
    """Number of split points at or below the value."""
    if not cuts:
        return F.lit(0)
    points = F.array(*[_literal(c) for c in cuts]).cast(f"array<{ddl}>")
    return F.size(F.filter(points, lambda c: c <= value))


def _literal(point) -> Column:
    if hasattr(point, "asDict"):
        return F.struct(*[F.lit(v).alias(k) for k, v in point.asDict().items()])
    return F.lit(point)
