"""Columns over packet headers: addresses, prefixes, flags, keys, names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Order of TCP flags wherever a list of flags is written; fixed.
FLAGS = ("fin", "syn", "rst", "psh", "ack", "urg", "ece", "cwr", "ns")
#: Probe methods by code; fixed names.
METHODS = {0: "icmp-echo", 1: "icmp-time", 2: "tcp-syn", 3: "tcp-ack", 4: "tcp-ack-sport", 5: "tcp-synack", 6: "tcp-rst", 7: "udp", 8: "udp-dport"}
#: TCP option names by option kind (RFC 793, 1323, 2018).
OPTIONS = {0: "end_of_list", 1: "noop", 2: "mss", 3: "window_scale", 4: "sack_permitted", 5: "sack", 8: "timestamp"}
#: ICMP type names by number (RFC 792, 1256, 8335); fixed names.
ICMP = {
    0: "echo_reply", 3: "dest_unreachable", 4: "source_quench", 5: "redirect_message", 8: "echo_request", 9: "router_advertisement", 10: "router_solicitation",
    11: "time_exceeded", 12: "bad_ip_header", 13: "timestamp", 14: "timestamp_reply", 15: "information_request", 16: "information_reply",
    17: "addr_mark_request", 18: "addr_mark_reply", 42: "extended_echo_request", 43: "extended_echo_reply",
}
#: What a reputation source says about an address, by code.
REPUTATION = {0: "never seen", 1: "seen", 2: "seen, may be spoofed", 3: "next to a seen one", 4: "reserved", 5: "often spoofed", 6: "seen, of a cloud", 7: "invalid", 8: "seen long ago"}
#: Source networks that must not appear on the Internet (RFC 5735).
RFC5735 = ("0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.88.99.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4")

_OCTET = "(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
IPV4 = rf"^{_OCTET}(\.{_OCTET}){{3}}$"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def is_ipv4(text: Column | str, port: bool = False) -> Column:
    """Whether a text is a dotted IPv4 address (with ``port``, an appended :port is tolerated)."""
    t = F.split_part(_c(text), F.lit(":"), F.lit(1)) if port else _c(text)
    return t.rlike(IPV4)


def ip_to_long(text: Column | str) -> Column:
    """0 .. 2^32-1 for a dotted address, null for anything else."""
    parts = F.split(_c(text), r"\.")
    value = F.lit(0).cast("bigint")
    for k in range(4):
        value = value * 256 + F.try_element_at(parts, F.lit(k + 1)).try_cast("bigint")
    return F.when(is_ipv4(text), value)


def long_to_ip(value: Column | str) -> Column:
    v = _c(value).cast("bigint")
    return F.concat_ws(".", *[F.shiftright(v, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)])


def cidr(text: Column | str) -> Column:
    """struct(lo, hi, len) of a prefix a.b.c.d/len; host bits are cleared, null if malformed."""
    length = F.split_part(_c(text), F.lit("/"), F.lit(2)).try_cast("int")
    base = ip_to_long(F.split_part(_c(text), F.lit("/"), F.lit(1)))
    size = F.pow(F.lit(2.0), 32 - length).cast("bigint")
    lo = base - F.pmod(base, size)
    return F.when(base.isNotNull() & length.between(0, 32), F.struct(lo.alias("lo"), (lo + size - 1).alias("hi"), length.alias("len")))


def bounds(prefix: str) -> tuple[int, int]:
    """(lo, hi) of a constant prefix."""
    address, length = prefix.split("/")
    value = 0
    for part in address.split("."):
        value = value * 256 + int(part)
    size = 1 << (32 - int(length))
    return value - value % size, value - value % size + size - 1


def in_prefixes(ip: Column | str, prefixes) -> Column:
    """Whether a numeric address lies in one of some constant prefixes."""
    found = F.lit(False)
    for p in prefixes:
        found = found | _c(ip).between(*bounds(p))
    return found


def flags_array(columns: dict[str, Column]) -> Column:
    """The names of set flags in fixed order; a missing column is unset, a set one is 1 or '1'."""
    return F.array_compact(F.array(*[F.when(columns[f].cast("string") == "1", F.lit(f)) if f in columns else F.lit(None).cast("string") for f in FLAGS]))


def flag_label(syn, ack, rst, fin) -> Column:
    """'syn-ack-rst-fin' of those set."""
    return F.concat_ws("-", *[F.when(_c(c).cast("string") == "1", F.lit(n)) for n, c in (("syn", syn), ("ack", ack), ("rst", rst), ("fin", fin))])


def options_array(text: Column | str) -> Column:
    """'a:b' as an array; '' and null as an empty one."""
    t = F.coalesce(_c(text), F.lit(""))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, ":"))


def options_text(options: Column | str) -> Column:
    return F.array_join(_c(options), ":")


def has(flags: Column | str, name: str) -> Column:
    return F.array_contains(_c(flags), name)


def is_syn(flags) -> Column:
    return has(flags, "syn") & ~has(flags, "ack")


def is_ack(flags) -> Column:
    return has(flags, "ack") & ~has(flags, "syn")


def is_syn_ack(flags) -> Column:
    return has(flags, "syn") & has(flags, "ack")


def is_fin_ack(flags) -> Column:
    return has(flags, "fin") & has(flags, "ack")


def is_rst(flags) -> Column:
    return has(flags, "rst")


def crafted(ipid, ttl, options) -> Column:
    """Signs of a packet made by a stateless scanner; ``options`` is an array."""
    return (_c(ipid) == 54321) | (_c(ttl) > 200) | (F.size(_c(options)) == 0)


def is_irregular_syn(flags, ipid, ttl, options) -> Column:
    return is_syn(flags) & crafted(ipid, ttl, options)


def scan_tool(flags, ipid, dport, snum, daddr) -> Column:
    """Tool that made a SYN: zmap, masscan, mirai or unknown (null for other packets)."""
    stateless = _c(dport).cast("bigint").bitwiseXOR(_c(snum)).bitwiseXOR(_c(daddr))
    mirai = _c(dport).isin(23, 2323) & (_c(snum) == _c(daddr))
    return F.when(is_syn(flags), F.when(_c(ipid) == 54321, "zmap").when(_c(ipid).cast("bigint") == stateless, "masscan").when(mirai, "mirai").otherwise("unknown"))


def scanner_like(proto, ipid, ttl, options) -> Column:
    """Second half of a target key: ip id 54321, ttl over 200, or TCP without options."""
    return (_c(ipid) == 54321) | (_c(ttl) > 200) | ((_c(proto) == "tcp") & (F.size(_c(options)) == 0))


def match_key(proto, saddr, daddr, dport) -> Column:
    """Grouping key of a packet: addresses and destination port, no port for ICMP."""
    return F.struct(_c(saddr).alias("saddr"), _c(daddr).alias("daddr"), F.when(_c(proto) != "icmp", _c(dport)).alias("dport"))


def five_tuple(proto, saddr, daddr, sport, dport) -> Column:
    zero = F.lit(0)
    return F.struct(_c(proto).alias("proto"), _c(saddr).alias("saddr"), _c(daddr).alias("daddr"), F.coalesce(_c(sport), zero).alias("sport"), F.coalesce(_c(dport), zero).alias("dport"))


def flow(proto, saddr, daddr, sport, dport) -> Column:
    """Addresses and ports of a TCP or UDP packet, null for others."""
    return F.when(_c(proto).isin("tcp", "udp"), F.struct(_c(saddr).alias("saddr"), _c(daddr).alias("daddr"), _c(sport).alias("sport"), _c(dport).alias("dport")))


def probe_request(probed="probed", method="method", userid="userid", num_probes="num_probes", saddr="saddr", daddr="daddr", sport="sport", dport="dport", snum="probe_snum", anum="probe_anum") -> Column:
    """The probe that a packet got, null if none: it goes back, so source and destination change places."""
    asked = F.struct(
        _c(method).alias("method"), _c(userid).alias("userid"), _c(num_probes).cast("int").alias("num_probes"), long_to_ip(daddr).alias("saddr"), long_to_ip(saddr).alias("daddr"),
        _c(dport).cast("int").alias("sport"), _c(sport).cast("int").alias("dport"), _c(snum).alias("snum"), _c(anum).alias("anum"),
    )
    return F.when(_c(probed), asked)


def named(code: Column | str, names: dict[int, str], other: str) -> Column:
    """The name of a code, ``other`` for unknown ones."""
    lookup = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(lookup, _c(code).cast("int")), F.lit(other))


def hour_ms(ts_ms: Column | str) -> Column:
    """Start of the hour of an epoch-ms time, in epoch ms."""
    return _c(ts_ms) - F.pmod(_c(ts_ms), F.lit(3_600_000))


def sane(saddr, daddr, network: str, drop: tuple[str, ...] = ()) -> Column:
    """Packet sanity: source outside and destination inside our network, no multicast or loopback, and no
    source in a network of the drop list."""
    inside = lambda c: _c(c).between(*bounds(network))
    good = ~inside(saddr) & inside(daddr) & ~in_prefixes(daddr, ("224.0.0.0/4", "127.0.0.0/8"))
    return good & ~in_prefixes(saddr, drop) if drop else good


#: Flag sets that ordinary TCP packets have.
USUAL_FLAGS = ("syn", "ack", "rst", "fin", "fin,syn", "syn,ack", "fin,ack", "psh,ack", "fin,psh,ack")


def quality_tags(proto, flags, ttl, saddr, daddr, sport, dport, fragment=None) -> Column:
    """Names of the quality rules that a packet passes; ``clean`` if it passes all.

    ``fragment`` is the 16-bit flags-and-offset field; where the log lacks it, that rule has no say.
    """
    p, last = _c(proto), F.pmod(_c(saddr), F.lit(256))
    flag_set = F.array_join(F.filter(_c(flags), lambda f: f.isin("fin", "syn", "rst", "psh", "ack", "urg")), ",")
    port_zero = (F.coalesce(_c(sport), F.lit(1)) == 0) | (F.coalesce(_c(dport), F.lit(1)) == 0)
    whole = F.lit(None).cast("boolean") if fragment is None else _c(fragment).bitwiseAND(F.lit(0x9FFF)) == 0
    rules = {
        "abnormal-protocol": p.isin("icmp", "udp", "ipv6") | ((p == "tcp") & flag_set.isin(*USUAL_FLAGS)),
        "ttl-200": (_c(ttl) < 200) | (p == "icmp"),
        "fragmented-v2": whole,
        "last-byte-src-0": last != 0,
        "last-byte-src-255": last != 255,
        "same-src-dst": _c(saddr) != _c(daddr),
        "udp-port-0": ~((p == "udp") & port_zero),
        "tcp-port-0": ~((p == "tcp") & port_zero),
        "rfc5735": ~in_prefixes(saddr, RFC5735),
    }
    clean = F.lit(True)
    for c in rules.values():
        clean = clean & F.coalesce(c, F.lit(True))
    return F.array_compact(F.array(F.lit("all-pkts"), *[F.when(c, F.lit(n)) for n, c in rules.items()], F.when(clean, F.lit("clean"))))


def clean_packets(packets: DataFrame) -> DataFrame:
    """The packets (with ``flags``, an array) that pass every quality rule."""
    tags = quality_tags("proto", "flags", "ttl", "saddr", "daddr", "sport", "dport", "fragment" if "fragment" in packets.columns else None)
    return packets.where(F.array_contains(tags, "clean"))


def clean_sources(packets: DataFrame) -> DataFrame:
    """``saddr, ts_ms, ipid`` of the clean packets."""
    return clean_packets(packets).select("saddr", "ts_ms", "ipid")
