"""IP addresses: parsing, classes and a keyed, class- and prefix-preserving mapping.

IPv4 is a BIGINT, IPv6 a string of 32 hex digits. The upper part (24 or 64 bits) goes through a
bitwise prefix-preserving permutation, the lower part through a small Feistel network keyed by the
upper part. Both walk cycles until the image is in the right class, so the mapping is a bijection
and can be inverted. Run it on distinct addresses.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspan.functions.regex import let

OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
# Steps of a cycle walk. A public /24 leaves its class with p = 0.16, so 24 steps fail with p < 1e-19.
WALK = 24
SMALL_IID = 256

# Ranges that are never mapped, then the classes, first match wins.
V4_UNMAPPED = ("0.0.0.0/8", "127.0.0.0/8", "192.0.0.0/24", "192.0.2.0/24", "192.88.99.0/24",
               "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4")
V4_CLASSES = (("10.0.0.0/8", "private"), ("172.16.0.0/12", "private"), ("192.168.0.0/16", "private"),
              ("100.64.0.0/10", "cgnat"), ("169.254.0.0/16", "linklocal"), ("198.18.0.0/15", "benchmark"),
              ("224.0.0.0/4", "multicast"))
V4_FIXED_HOSTS = (0, 1, 254, 255)


def _range(cidr: str) -> tuple[int, int]:
    base, bits = cidr.split("/")
    a, b, c, d = (int(x) for x in base.split("."))
    lo = (a << 24) | (b << 16) | (c << 8) | d
    return lo, lo + (1 << (32 - int(bits))) - 1


# ---------------------------------------------------------------- IPv4
def v4_to_long(text: Column) -> Column:
    """BIGINT of a dotted quad or NULL."""
    ok = F.regexp_like(text, F.lit(rf"^{OCTET}(?:\.{OCTET}){{3}}$"))
    return F.when(ok, let(F.split(text, r"\."), lambda p: sum(
        (F.get(p, F.lit(i)).cast("bigint") * (1 << (24 - 8 * i)) for i in range(1, 4)),
        F.get(p, F.lit(0)).cast("bigint") * (1 << 24))))


def long_to_v4(value: Column) -> Column:
    return F.concat_ws(".", *[(F.shiftright(value, s).bitwiseAND(255)).cast("string") for s in (24, 16, 8, 0)])


def is_netmask(text: Column) -> Column:
    def test(n: Column) -> Column:
        inverse = F.lit(0xFFFFFFFF) - n
        return (n >= (1 << 31)) & (inverse.bitwiseAND(inverse + 1) == 0)

    return let(v4_to_long(text), test)


def _v4_class(value: Column) -> Column:
    """STRUCT<label, fixed> or NULL for an address that is not mapped."""
    out = None
    for cidr in V4_UNMAPPED:
        lo, hi = _range(cidr)
        test = value.between(lo, hi)
        none = F.lit(None).cast("struct<label:string,fixed:int>")
        out = F.when(test, none) if out is None else out.when(test, none)
    for cidr, label in V4_CLASSES:
        lo, hi = _range(cidr)
        out = out.when(value.between(lo, hi), F.struct(F.lit(label).alias("label"),
                                                       F.lit(int(cidr.split("/")[1])).alias("fixed")))
    return out.when(value.isNotNull(), F.struct(F.lit("public").alias("label"), F.lit(0).alias("fixed")))


def _bit(key: Column, tag: str, i: Column, prefix: Column) -> Column:
    digest = F.sha2(F.concat_ws("|", key, F.lit(tag), i.cast("string"), prefix.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 1), 16, 10).cast("bigint").bitwiseAND(1)


def _prefix_permute(key: Column, tag: str, value: Column, fixed: Column, width: int, inverse: bool) -> Column:
    """Flip bit i depending on the key and the i bits left of it (of the original value)."""
    def step(acc: Column, i: Column) -> Column:
        known = acc["orig"]
        shift = (F.lit(width) - i).cast("int")
        prefix = F.when(i == 0, F.lit(0).cast("bigint")).otherwise(F.call_function("shiftrightunsigned", known, shift))
        flip = F.call_function("shiftleft", _bit(key, tag, i, prefix), (F.lit(width - 1) - i).cast("int"))
        changed = acc["out"].bitwiseXOR(flip)
        return F.struct((changed if inverse else known).alias("orig"), changed.alias("out"))

    start = F.struct(value.cast("bigint").alias("orig"), value.cast("bigint").alias("out"))
    return F.aggregate(F.sequence(fixed, F.lit(width - 1)), start, step, lambda a: a["out"])


def _walk(value: Column, once, again) -> Column:
    """Apply ``once``, then repeat it while ``again`` holds."""
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(WALK)), once(value),
        lambda acc, _i: F.when(again(acc), once(acc)).otherwise(acc))


def _upper24(key: Column, upper: Column, cls: Column, inverse: bool) -> Column:
    def once(v: Column) -> Column:
        return _prefix_permute(key, "ip4", v, F.least(cls["fixed"], F.lit(24)), 24, inverse)

    def left_class(v: Column) -> Column:
        label = _v4_class(v * 256)["label"]
        return (cls["label"] == "public") & (label.isNull() | (label != "public"))

    return _walk(upper, once, left_class)


def _low8(key: Column, upper: Column, low: Column, inverse: bool, keep_special: bool) -> Column:
    """Four-round Feistel network on 4 + 4 bits, keyed by the /24."""
    def round_value(r: Column, half: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", key, F.lit("ip4-low"), upper.cast("string"), r.cast("string"),
                                    half.cast("string")), 256)
        return F.conv(F.substring(digest, 1, 1), 16, 10).cast("bigint")

    def once(v: Column) -> Column:
        def fwd(acc: Column, r: Column) -> Column:
            return F.struct(acc["b"].alias("a"), acc["a"].bitwiseXOR(round_value(r, acc["b"])).alias("b"))

        def back(acc: Column, r: Column) -> Column:
            return F.struct(acc["b"].bitwiseXOR(round_value(r, acc["a"])).alias("a"), acc["a"].alias("b"))

        start = F.struct(F.shiftright(v, 4).cast("bigint").alias("a"), v.bitwiseAND(15).cast("bigint").alias("b"))
        rounds = F.sequence(F.lit(3), F.lit(0), F.lit(-1)) if inverse else F.sequence(F.lit(0), F.lit(3))
        return F.aggregate(rounds, start, back if inverse else fwd, lambda a: a["a"] * 16 + a["b"])

    if not keep_special:
        return once(low)
    walked = _walk(low, once, lambda v: v.isin(*V4_FIXED_HOSTS))
    return F.when(low.isin(*V4_FIXED_HOSTS), low).otherwise(walked)


def _v4(value: Column, key: Column, inverse: bool, keep_special: bool) -> Column:
    def build(v: Column) -> Column:
        upper, low = F.shiftright(v["n"], 8), v["n"].bitwiseAND(255)
        mapped = let(
            _upper24(key, upper, v["cls"], inverse),
            lambda u: u * 256 + _low8(key, u if inverse else upper, low, inverse, keep_special))
        return F.when(v["cls"].isNotNull(), mapped)

    return let(F.struct(value.alias("n"), _v4_class(value).alias("cls")), build)


# ---------------------------------------------------------------- IPv6
def v6_to_hex(text: Column) -> Column:
    """32 hex digits of an IPv6 address or NULL if it does not parse."""
    def groups(part: Column) -> Column:
        return F.when(part == "", F.array().cast("array<string>")).otherwise(F.split(part, ":"))

    def plain(s: Column) -> Column:
        def build(v: Column) -> Column:
            known = F.concat(v["l"], v["r"])
            n = F.size(known)
            fill = F.array_repeat(F.lit("0"), F.greatest(8 - n, F.lit(0)))
            full = F.concat(v["l"], fill, v["r"])
            valid = F.forall(known, lambda g: F.regexp_like(g, F.lit("^[0-9a-f]{1,4}$")))
            size_ok = F.when(v["gap"], n <= 7).otherwise(n == 8)
            digits = F.array_join(F.transform(full, lambda g: F.lpad(g, 4, "0")), "")
            return F.when(valid & size_ok & (v["gaps"] <= 2), digits)

        halves = F.split(s, "::", -1)
        gap = F.size(halves) > 1
        return let(F.struct(
            groups(F.get(halves, F.lit(0))).alias("l"),
            F.when(gap, groups(F.get(halves, F.lit(1)))).otherwise(F.array().cast("array<string>")).alias("r"),
            gap.alias("gap"), F.size(halves).alias("gaps")), build)

    def with_tail(s: Column) -> Column:
        tail = F.regexp_extract(s, r"^(.*:)([0-9.]+)$", 2)
        head = F.regexp_extract(s, r"^(.*:)([0-9.]+)$", 1)
        n = v4_to_long(tail)
        two = F.concat(F.lower(F.hex(F.shiftright(n, 16))), F.lit(":"), F.lower(F.hex(n.bitwiseAND(65535))))
        return F.when(n.isNotNull(), F.concat(head, two))

    low = F.lower(text)
    return let(F.when(F.contains(low, F.lit(".")), with_tail(low)).otherwise(low), plain)


def hex_to_v6(digits: Column) -> Column:
    """Shortest text form: the longest run of zero groups becomes ``::``."""
    def build(s: Column) -> Column:
        out = None
        for n in range(8, 1, -1):
            run = r"(?:^|:)0" + r"(?::0)" * (n - 1) + r"(?:$|:)"
            cut = F.regexp_replace(s, rf"^(.*?){run}(.*)$", "$1::$2")
            out = F.when(F.regexp_like(s, F.lit(run)), cut) if out is None else out.when(
                F.regexp_like(s, F.lit(run)), cut)
        return out.otherwise(s)

    def spell(d: Column) -> Column:
        parts = [F.regexp_replace(F.substring(d, 4 * i + 1, 4), "^0{1,3}", "") for i in range(8)]
        low = F.conv(F.substring(d, 25, 8), 16, 10).cast("bigint")
        mapped = let(low, lambda n: F.concat(F.lit("::ffff:"), long_to_v4(n)))
        return F.when(F.substring(d, 1, 24) == "0" * 20 + "ffff", mapped).when(
            d.isNotNull(), let(F.concat_ws(":", *parts), build))

    return let(digits, spell)


def _to_long(hex16: Column) -> Column:
    return F.conv(hex16, 16, -10).cast("bigint")


def _to_hex16(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def _v6_class(digits: Column) -> Column:
    """Classes of IPv6 ranges; NULL for ranges that are not mapped."""
    def cls(label: str, fixed: int) -> Column:
        return F.struct(F.lit(label).alias("label"), F.lit(fixed).alias("fixed"))

    none = F.lit(None).cast("struct<label:string,fixed:int>")
    return (
        F.when(F.startswith(digits, F.lit("0" * 24)), none)
        .when(F.startswith(digits, F.lit("20010db8")), none)
        .when(F.startswith(digits, F.lit("ff")), none)
        .when(F.regexp_like(digits, F.lit("^fe[89ab]")), cls("linklocal", 10))
        .when(F.startswith(digits, F.lit("fd")), cls("ula", 8))
        .when(F.startswith(digits, F.lit("fc")), cls("ula", 8))
        .when(F.regexp_like(digits, F.lit("^[23]")), cls("global", 3))
        .when(digits.isNotNull(), cls("other", 0))
    )


def _iid(key: Column, upper: Column, iid: Column, inverse: bool, keep_special: bool) -> Column:
    """Four-round Feistel network on 32 + 32 bits, keyed by the /64."""
    mask = 0xFFFFFFFF

    def round_value(r: Column, half: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", key, F.lit("ip6-iid"), upper.cast("string"), r.cast("string"),
                                    half.cast("string")), 256)
        return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")

    def once(v: Column) -> Column:
        def fwd(acc: Column, r: Column) -> Column:
            return F.struct(acc["b"].alias("a"), acc["a"].bitwiseXOR(round_value(r, acc["b"])).alias("b"))

        def back(acc: Column, r: Column) -> Column:
            return F.struct(acc["b"].bitwiseXOR(round_value(r, acc["a"])).alias("a"), acc["a"].alias("b"))

        start = F.struct(F.call_function("shiftrightunsigned", v, F.lit(32)).alias("a"), v.bitwiseAND(mask).alias("b"))
        rounds = F.sequence(F.lit(3), F.lit(0), F.lit(-1)) if inverse else F.sequence(F.lit(0), F.lit(3))
        return F.aggregate(rounds, start, back if inverse else fwd,
                           lambda a: F.call_function("shiftleft", a["a"], F.lit(32)).bitwiseOR(a["b"]))

    if not keep_special:
        return once(iid)
    small = iid.between(0, SMALL_IID - 1)
    return F.when(small, iid).otherwise(_walk(iid, once, lambda v: v.between(0, SMALL_IID - 1)))


def _v6(digits: Column, key: Column, inverse: bool, keep_special: bool) -> Column:
    def general(v: Column) -> Column:
        upper, iid = _to_long(F.substring(v["d"], 1, 16)), _to_long(F.substring(v["d"], 17, 16))

        def once(u: Column) -> Column:
            return _prefix_permute(key, "ip6", u, F.least(v["cls"]["fixed"], F.lit(64)), 64, inverse)

        def left_class(u: Column) -> Column:
            label = _v6_class(F.concat(_to_hex16(u), F.lit("0" * 16)))["label"]
            return label.isNull() | (label != v["cls"]["label"])

        mapped = let(_walk(upper, once, left_class), lambda u: F.concat(
            _to_hex16(u), _to_hex16(_iid(key, u if inverse else upper, iid, inverse, keep_special))))
        return F.when(v["cls"].isNotNull(), mapped)

    v4_head = "0" * 20 + "ffff"

    def choose(d: Column) -> Column:
        inner = F.conv(F.substring(d, 25, 8), 16, 10).cast("bigint")
        as_v4 = F.concat(F.lit(v4_head), F.lower(F.lpad(F.hex(_v4(inner, key, inverse, keep_special)), 8, "0")))
        return F.when(F.startswith(d, F.lit(v4_head)), as_v4).otherwise(
            let(F.struct(d.alias("d"), _v6_class(d).alias("cls")), general))

    return let(digits, choose)


# ---------------------------------------------------------------- text in, text out
def ip_class(text: Column) -> Column:
    """Class label of an address, NULL for ranges that are left alone."""
    return F.when(F.contains(text, F.lit(":")), let(v6_to_hex(text), lambda d: _v6_class(d)["label"])).otherwise(
        let(v4_to_long(text), lambda n: _v4_class(n)["label"]))


def _convert(text: Column, key: Column, inverse: bool, keep_special: bool, versions=(4, 6)) -> Column:
    if 6 not in versions:
        return let(_v4(v4_to_long(text), key, inverse, keep_special), lambda n: F.when(n.isNotNull(), long_to_v4(n)))
    v4 = let(_v4(v4_to_long(text), key, inverse, keep_special), lambda n: F.when(n.isNotNull(), long_to_v4(n)))
    v6 = hex_to_v6(_v6(v6_to_hex(text), key, inverse, keep_special))
    return F.when(F.contains(text, F.lit(":")), v6).otherwise(v4)


def map_ip(text: Column, key: Column, keep_special: bool = True, versions=(4, 6)) -> Column:
    return _convert(text, key, False, keep_special, versions)


def unmap_ip(text: Column, key: Column, keep_special: bool = True, versions=(4, 6)) -> Column:
    return _convert(text, key, True, keep_special, versions)


def address_hex(text: Column) -> Column:
    """32 hex digits for both versions (IPv4 right-aligned): sortable and comparable as strings."""
    return let(text, lambda t: F.when(F.contains(t, F.lit(":")), v6_to_hex(t)).otherwise(
        F.lower(F.lpad(F.hex(v4_to_long(t)), 32, "0"))))


_HEX = "0123456789abcdef"


def network_bounds(text: Column, prefix: Column) -> Column:
    """STRUCT<lo, hi> as 32 hex digits of the network of ``prefix`` bits around an address."""
    def build(v: Column) -> Column:
        full = F.floor(v["bits"] / 4).cast("int")
        rest = (v["bits"] % 4).cast("int")
        digit = F.conv(F.substring(v["h"], full + 1, F.lit(1)), 16, 10).cast("int")
        span = F.call_function("shiftleft", F.lit(1), (F.lit(4) - rest).cast("int"))
        low = digit - digit % span
        head = F.substring(v["h"], F.lit(1), full)

        def side(edge: Column, fill: str) -> Column:
            one = F.substring(F.lit(_HEX), edge + 1, F.lit(1))
            return F.when(full >= 32, v["h"]).otherwise(
                F.rpad(F.concat(head, F.when(rest > 0, one).otherwise("")), 32, fill))

        return F.struct(side(low, "0").alias("lo"), side(low + span - 1, "f").alias("hi"))

    bits = F.when(F.contains(text, F.lit(":")), prefix.cast("int")).otherwise(prefix.cast("int") + 96)
    return let(F.struct(address_hex(text).alias("h"), bits.alias("bits")), build)


def hex_to_address(digits: Column, version: Column) -> Column:
    v4 = let(F.conv(F.substring(digits, 25, 8), 16, 10).cast("bigint"), long_to_v4)
    return F.when(version == 6, hex_to_v6(digits)).otherwise(v4)


def version_of(text: Column) -> Column:
    return F.when(F.contains(text, F.lit(":")), 6).otherwise(4)
