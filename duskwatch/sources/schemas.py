"""Fixed schemas of the logs."""

from __future__ import annotations

from pyspark.sql import types as T

_S = T.StringType()


def strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, _S) for n in names])


#: Header of the packet log, in order; fixed names.
PACKET_COLUMNS = ("ts", "saddr", "daddr", "ipid", "ttl", "proto", "sport", "dport", "anum", "snum", "options", "payload", "syn", "ack", "rst", "fin", "window size", "probed", "method", "userid", "probe anum", "probe snum", "num probes")
#: Header of the confirmation log, in order; fixed names.
CONFIRMATION_COLUMNS = ("start sec", "start usec", "method", "userid", "num probes", "saddr", "daddr", "sport", "dport")
PACKET_TEXT = strings(*PACKET_COLUMNS)
CONFIRMATION_TEXT = strings(*CONFIRMATION_COLUMNS)

PACKETS = "ts_ms long, saddr long, daddr long, ipid int, ttl int, proto string, sport int, dport int, anum long, snum long, options string, payload string, syn int, ack int, rst int, fin int, window_size int, probed boolean, method string, userid long, probe_anum long, probe_snum long, num_probes int"
CONFIRMATIONS = "ts_ms long, method string, userid long, num_probes int, saddr long, daddr long, sport int, dport int"

JSON_CONFIRMATIONS = "sport int, dport int, src string, dst string, userid bigint, method string, payload string, ping_sent int, probe_size int, start struct<sec:bigint,usec:bigint>, timestamp bigint, ttl int, version int"

_TCP = "struct<sport:int,dport:int,snum:bigint,anum:bigint,window_size:int,flags:array<string>,options:array<string>,payload:string>"
_TRIGGER = f"struct<timestamp:bigint,saddr:string,daddr:string,ipid:int,ttl:int,proto:string,payload:{_TCP}>"
_REACTION = "struct<method:string,userid:bigint,num_probes:int,saddr:string,daddr:string,sport:int,dport:int,snum:bigint,anum:bigint>"
EVENT = f"struct<trigger:{_TRIGGER},reaction:{_REACTION}>"
HANDSHAKES = f"ts bigint, tag string, isyn {EVENT}, iack {EVENT}, rsyn {EVENT}, rack {EVENT}"
LEGACY = "trigger struct<saddr:string,daddr:string,ipid:int,ttl:int,observed:bigint,protocol:string,tcp:struct<sport:int,dport:int,snum:bigint,anum:bigint,window_size:int,flags:map<string,boolean>,options:map<string,int>,payload:string>,udp:struct<sport:int,dport:int,payload:string>,icmp:struct<type:string>>, reaction struct<probe_method:string,userid:bigint,num_probes:int,saddr:string,daddr:string,sport:int,dport:int,snum:bigint,anum:bigint>"
TARGETS = "saddr string, daddr string, sport int, dport int, payload string"
DOWNLOADS = strings("name", "url", "timestamp", "server", "tag")
CONTACT_TYPES = "all long, `without-ack` long, `without-payload` long, `with-payload` long, ascii long, hex long, downloader long, matched long"
HASH_ENTRY = "map<string,struct<first:map<string,bigint>,last:map<string,bigint>>>"
