"""Queries over the contended hour: every protocol, flag and phase that the plain packets never have."""

from __future__ import annotations

from pyspark.sql import functions as F

from duskwatch.functions import net
from duskwatch.operators import handshakes, matching, reaction, reports
from duskwatch.plans import derived
from duskwatch.plans.queries import query

W = derived.BUSY_WITH


def busy(spark, d):
    return derived.busy_packets(spark, d)


def flags():
    return net.flags_array({c: F.col(c) for c in ("syn", "ack", "rst", "fin")})


# -- handshakes -------------------------------------------------------------------------------

#: Packets with their confirmations and without retransmits (ord: their place in time); then regular SYNs
#: in order take the first free irregular phase, bare ones before acknowledged ones, and once more at the
#: end of the hour.
_CONTENDED = W + """, c AS (SELECT userid, min(ts_ms) AS con FROM conf GROUP BY 1),
  rt AS (SELECT *, row_number() OVER (PARTITION BY saddr, daddr, sport, dport, snum, rst ORDER BY ts_ms, step) > 1 AND rst = 0 AS again FROM packets),
  e AS (SELECT p.*, con, (ts_ms - 1700002800000) * 100000000 + step AS ord, CASE WHEN rst = 1 THEN NULL WHEN syn = 1 AND ack = 0 THEN CASE WHEN ipid = 54321 OR ttl > 200 OR options = '' THEN 'i' ELSE 'r' END WHEN ack = 1 AND syn = 0 THEN 'a' END AS k
    FROM rt p LEFT JOIN c USING (userid) WHERE NOT again AND (method IS NULL OR con IS NOT NULL)),
  s AS (SELECT x.*, y.userid AS ack_id, y.ord AS ack_ord FROM (SELECT * FROM e WHERE k IN ('i', 'r')) x LEFT JOIN (SELECT * FROM e WHERE k = 'a') y ON y.saddr = x.saddr AND y.daddr = x.daddr AND y.dport = x.dport AND y.sport = x.sport AND y.snum = x.probe_anum AND x.con IS NOT NULL),
  firsts AS MATERIALIZED (SELECT saddr, daddr, dport, list(struct_pack(ord := ord, id := userid, con := con // 1000, acked := coalesce(ack_ord, 9223372036854775807))) AS firsts FROM s WHERE k = 'i' GROUP BY ALL),
  turns AS MATERIALIZED (SELECT saddr, daddr, dport, ord, userid, ts_ms // 1000 AS t, pass, row_number() OVER (PARTITION BY saddr, daddr, dport ORDER BY pass, ord) AS n FROM s, (VALUES (1), (2)) v(pass) WHERE k = 'r'),
  walk AS (SELECT saddr, daddr, dport, firsts, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(i BIGINT, r BIGINT)[]) AS pairs FROM firsts
    UNION ALL SELECT w.saddr, w.daddr, w.dport, firsts, t.n, CASE WHEN len(list_filter(pairs, lambda p: p.r = t.userid)) > 0 THEN pairs ELSE pairs || list_transform(
      list_sort(list_transform(list_filter(firsts, lambda f: f.con > t.t - 600 AND f.con <= t.t + 1 AND (t.pass = 2 OR f.ord < t.ord) AND NOT list_contains(list_transform(pairs, lambda p: p.i), f.id)), lambda f: struct_pack(late := t.pass = 1 AND f.acked < t.ord OR t.pass = 2 AND f.acked < 9223372036854775807, ord := f.ord, id := f.id)))[1:1],
      lambda f: struct_pack(i := CAST(f.id AS BIGINT), r := CAST(t.userid AS BIGINT))) END
    FROM walk w JOIN turns t ON t.saddr = w.saddr AND t.daddr = w.daddr AND t.dport = w.dport AND t.n = w.n + 1),
  pairs AS MATERIALIZED (SELECT unnest(arg_max(pairs, n), recursive := true) FROM walk GROUP BY saddr, daddr, dport),
  h AS (SELECT i.saddr, i.daddr, i.dport, i.ts_ms, CASE WHEN r.ack_id IS NULL THEN 'two-phase (no ack)' ELSE 'two-phase' END AS tag, false AS repeated, i.userid AS isyn, NULL AS iack, r.userid AS rsyn, r.ack_id AS rack FROM pairs p JOIN s i ON i.userid = p.i JOIN s r ON r.userid = p.r
    UNION ALL SELECT saddr, daddr, dport, ts_ms, CASE WHEN ack_id IS NULL THEN 'isyn' ELSE 'isyn (acked)' END, false, userid, ack_id, NULL, NULL FROM s WHERE k = 'i' AND userid NOT IN (SELECT i FROM pairs)
    UNION ALL SELECT saddr, daddr, dport, ts_ms, CASE WHEN ack_id IS NULL THEN 'rsyn' ELSE 'rsyn (acked)' END, ack_id IS NOT NULL AND EXISTS (SELECT 1 FROM pairs p JOIN s i ON i.userid = p.i WHERE i.saddr = s.saddr AND i.daddr = s.daddr AND i.dport = s.dport AND i.con // 1000 > s.ts_ms // 1000 - 600 AND i.con // 1000 <= s.ts_ms // 1000 + 1), NULL, NULL, userid, ack_id FROM s WHERE k = 'r' AND userid NOT IN (SELECT r FROM pairs))"""


def fresh(spark, d):
    """Confirmed packets without retransmits."""
    p = busy(spark, d)
    return matching.confirmed(p.select(*handshakes.INPUT), derived.busy_confirmations(p), ("ts_ms", "step")).where("not retransmit")


def shakes(spark, d):
    return handshakes.assemble_handshakes(fresh(spark, d))


@query("handshakes_contended", _CONTENDED + " SELECT saddr, daddr, dport, ts_ms, tag, repeated, isyn, iack, rsyn, rack FROM h")
def handshakes_contended(spark, d):
    return shakes(spark, d).select("saddr", "daddr", "dport", "ts_ms", "tag", "repeated", "isyn", "iack", "rsyn", "rack")


@query("repeats", _CONTENDED + " SELECT rsyn, rack FROM h WHERE repeated")
def repeats(spark, d):
    return shakes(spark, d).where("repeated").select("rsyn", "rack")


@query("repeat_identity", _CONTENDED + """ SELECT r.rsyn, x.id[3] AS first_s, x.id[4] AS sport, x.id[5] AS ipid, x.id[6] AS anum FROM (SELECT rsyn FROM h WHERE repeated) r JOIN (
    SELECT s.userid, min([CAST(b.ack_id IS NOT NULL AS BIGINT), i.ord, i.ts_ms // 1000, i.sport, i.ipid, i.anum]) AS id FROM s JOIN pairs p ON true JOIN s i ON i.userid = p.i JOIN s b ON b.userid = p.r WHERE s.k = 'r' AND i.saddr = s.saddr AND i.daddr = s.daddr AND i.dport = s.dport AND i.con // 1000 > s.ts_ms // 1000 - 600 AND i.con // 1000 <= s.ts_ms // 1000 + 1 GROUP BY s.userid) x ON x.userid = r.rsyn""")
def repeat_identity(spark, d):
    return handshakes.named_repeats(fresh(spark, d)).drop("ident")


@query("confirmed_contended", _CONTENDED + " SELECT userid, con AS con_ms, again AS retransmit FROM rt LEFT JOIN c USING (userid) WHERE method IS NULL OR con IS NOT NULL")
def confirmed_contended(spark, d):
    p = busy(spark, d)
    return matching.confirmed(p, derived.busy_confirmations(p), ("ts_ms", "step")).select("userid", "con_ms", "retransmit")


@query("first_phase_downloaders", _CONTENDED + " SELECT h.ts_ms, tag, h.saddr, h.daddr, 'wget' AS tool, 'wget 127.0.0.1/a' AS decoded FROM h JOIN packets a ON a.userid = h.iack WHERE a.kind = 'iack'")
def first_phase_downloaders(spark, d):
    return reports.filter_downloaders(shakes(spark, d)).select("ts_ms", "tag", "saddr", "daddr", "tool", "decoded")


# -- packets of all protocols -----------------------------------------------------------------


@query("protocols", W + " SELECT count(*) AS total, count_if(proto = 'tcp') AS tcp, count_if(proto = 'udp') AS udp, count_if(proto = 'icmp') AS icmp, count_if(proto NOT IN ('tcp', 'udp', 'icmp')) AS other FROM packets")
def protocols(spark, d):
    return reaction.protocol_tally(busy(spark, d))


@query("flag_predicates", W + """ SELECT userid, syn = 1 AND ack = 0 AS is_syn, ack = 1 AND syn = 0 AS is_ack, syn = 1 AND ack = 1 AS is_syn_ack, fin = 1 AND ack = 1 AS is_fin_ack, rst = 1 AS is_rst,
  ipid = 54321 OR ttl > 200 OR (proto = 'tcp' AND options = '') AS scanner_like FROM packets""")
def flag_predicates(spark, d):
    p = busy(spark, d).withColumns({"flags": flags(), "opts": net.options_array("options")})
    tests = {"is_syn": net.is_syn, "is_ack": net.is_ack, "is_syn_ack": net.is_syn_ack, "is_fin_ack": net.is_fin_ack, "is_rst": net.is_rst}
    return p.select("userid", *[f("flags").alias(n) for n, f in tests.items()], net.scanner_like("proto", "ipid", "ttl", "opts").alias("scanner_like"))


@query("match_keys", W + " SELECT proto, saddr, daddr, CASE WHEN proto <> 'icmp' THEN dport END AS dport, count(*) AS n FROM packets GROUP BY ALL")
def match_keys(spark, d):
    k = busy(spark, d).select("proto", net.match_key("proto", "saddr", "daddr", "dport").alias("k"))
    return k.groupBy("proto", "k").agg(F.count(F.lit(1)).alias("n")).select("proto", "k.*", "n")


_OWN, _RFC = net.bounds("44.0.0.0/16"), " OR ".join("saddr BETWEEN {} AND {}".format(*net.bounds(p)) for p in net.RFC5735)
_DROPPED = "saddr BETWEEN {} AND {} OR daddr NOT BETWEEN {} AND {} OR daddr BETWEEN {} AND {} OR daddr BETWEEN {} AND {}".format(*_OWN, *_OWN, *net.bounds("224.0.0.0/4"), *net.bounds("127.0.0.0/8"))


@query("clean_packets", W + f""" SELECT userid FROM packets WHERE (ttl < 200 OR proto = 'icmp') AND saddr % 256 NOT IN (0, 255) AND saddr <> daddr AND NOT (proto IN ('udp', 'tcp') AND (sport = 0 OR dport = 0)) AND NOT ({_RFC})""")
def clean_packets(spark, d):
    return net.clean_packets(busy(spark, d).withColumn("flags", flags())).select("userid")


@query("sane_packets", W + f""" SELECT userid, NOT ({_DROPPED}) AND saddr NOT BETWEEN {net.bounds("45.0.0.64/26")[0]} AND {net.bounds("45.0.0.64/26")[1]} AS sane FROM packets""")
def sane_packets(spark, d):
    return busy(spark, d).select("userid", net.sane("saddr", "daddr", "44.0.0.0/16", drop=("45.0.0.64/26",)).alias("sane"))


@query("reactions_mixed", W + """ SELECT userid, CASE WHEN proto = 'udp' THEN 'udp' WHEN proto = 'icmp' THEN CASE WHEN options <> 'echo_reply' THEN 'icmp-echo' END WHEN syn = 1 AND ack = 0 AND rst = 0 THEN 'tcp-synack' WHEN syn = 0 AND ack = 1 THEN 'tcp-rst' END AS method,
  CASE WHEN proto = 'udp' THEN payload END AS payload, CASE WHEN proto = 'udp' OR (proto = 'icmp' AND options <> 'echo_reply') THEN 5 WHEN syn = 1 AND ack = 0 AND rst = 0 THEN 1 WHEN syn = 0 AND ack = 1 THEN 2 END AS num_probes FROM packets""")
def reactions_mixed(spark, d):
    return reaction.plan_reaction(busy(spark, d)).select("userid", *[F.col(f"reaction.{c}").alias(c) for c in ("method", "payload", "num_probes")])


@query("rst_pauses", W + """, o AS (SELECT userid, saddr, sport, ts_ms, row_number() OVER (PARTITION BY saddr, sport ORDER BY ts_ms, userid) AS k FROM packets WHERE method = 'tcp-rst'),
  f AS (SELECT userid, saddr, sport, k, ts_ms AS last, true AS logged FROM o WHERE k = 1 UNION ALL SELECT o.userid, o.saddr, o.sport, o.k, CASE WHEN o.ts_ms - f.last >= 5000 THEN o.ts_ms ELSE f.last END, o.ts_ms - f.last >= 5000 FROM f JOIN o ON o.saddr = f.saddr AND o.sport = f.sport AND o.k = f.k + 1)
  SELECT userid, logged FROM f""")
def rst_pauses(spark, d):
    return reaction.dedupe_rst(busy(spark, d).where("method = 'tcp-rst'"), ties=("userid",)).select("userid", "logged")


#: Probes of an address in order: each starts when the one before is done, and takes the first packet of its port in time.
_OUTCOMES = W + """, pk AS MATERIALIZED (SELECT a, list(struct_pack(i := i, ts := ts_ms, port := event_id % 3, icmp := event_id % 5 = 0) ORDER BY i) AS pk FROM (SELECT saddr % 8 AS a, *, row_number() OVER (PARTITION BY saddr % 8 ORDER BY ts_ms, event_id % 5 <> 0, userid) AS i FROM packets WHERE kind <> 'isyn' AND kind <> 'rsyn') GROUP BY a),
  pr AS MATERIALIZED (SELECT saddr % 8 AS a, userid, event_id % 3 AS port, ts_ms, row_number() OVER (PARTITION BY saddr % 8 ORDER BY ts_ms, userid) AS n FROM packets WHERE kind IN ('isyn', 'rsyn')),
  st AS (SELECT a, pk, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS probe_id, CAST(NULL AS VARCHAR) AS outcome, CAST(0 AS BIGINT) AS begun, CAST(0 AS BIGINT) AS free, CAST(0 AS BIGINT) AS used FROM pk
    UNION ALL SELECT a, pk, n, userid, CASE WHEN hit IS NULL THEN 'timeout' WHEN hit.icmp THEN 'unreachable' ELSE 'answered' END, s, coalesce(hit.ts, s + 20000), coalesce(hit.i, greatest(used, coalesce(list_max(list_transform(list_filter(pk, lambda p: p.ts <= s + 20000), lambda p: p.i)), 0)))
    FROM (SELECT a, pk, n, userid, s, used, list_filter(pk, lambda p: p.i > used AND p.port = pport AND p.ts >= s AND p.ts <= s + 20000)[1] AS hit FROM (SELECT st.a, st.pk, pr.n, pr.userid, pr.port AS pport, greatest(pr.ts_ms, st.free) AS s, st.used FROM st JOIN pr ON pr.a = st.a AND pr.n = st.n + 1) x) y)
"""


@query("udp_outcomes_contended", _OUTCOMES + " SELECT probe_id, outcome FROM st WHERE n > 0")
def udp_outcomes_contended(spark, d):
    return reaction.udp_outcomes(*_probing(spark, d))


@query("udp_sends", _OUTCOMES + """ SELECT probe_id, outcome AS what, free AS ts_ms FROM st WHERE n > 0
  UNION ALL SELECT probe_id, 'send', unnest(range(begun, CASE WHEN outcome = 'timeout' THEN begun + 20001 ELSE greatest(begun + 1, free) END, 6000)) FROM st WHERE n > 0""")
def udp_sends(spark, d):
    """Every time a probe is sent, and what became of it."""
    return reaction.udp_probing(*_probing(spark, d))


def _probing(spark, d):
    p = busy(spark, d).withColumns({"a": F.col("saddr") % 8, "port": (F.col("event_id") % 3).cast("int")})
    syn = F.col("kind").isin("isyn", "rsyn")
    probes = p.where(syn).select(F.col("userid").alias("probe_id"), F.col("a").alias("addr"), "port", "ts_ms")
    got = p.where(~syn).select(F.when(F.col("event_id") % 5 == 0, "icmp").otherwise("udp").alias("proto"), F.col("a").alias("saddr"), F.col("port").alias("sport"), "ts_ms")
    return probes, got
