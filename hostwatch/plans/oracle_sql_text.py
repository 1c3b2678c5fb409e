"""SQL text: CTES are views, QUERIES the registered results."""

from __future__ import annotations

import hashlib
import hmac

CTES: dict[str, str] = {}
QUERIES: dict[str, str] = {}

W, S, NB = 21600, 7200, 3                      # window, stride (s), bins per window
WU, SU = W * 1_000_000, S * 1_000_000


def ip_text(c):
    return f"concat_ws('.', ({c}>>24)&255, ({c}>>16)&255, ({c}>>8)&255, {c}&255)"


def fdiv(a, n):
    return f"CAST(floor(CAST(({a}) AS BIGINT)/{n}.0) AS BIGINT)"


CTES["v_packets"] = f"""
SELECT event_id AS packet_no, epoch_us(ts) AS ts_us,
  CAST(CASE WHEN h%2=0 THEN 167772160+h ELSE 3405803776+h END AS BIGINT) AS src_ip,
  CAST(167837696 + k%5 AS BIGINT) AS dst_ip,
  CAST(CASE WHEN event_id%7=0 THEN 443 ELSE 1024+event_id%4 END AS INTEGER) AS src_port,
  k AS dst_port, CASE WHEN event_id%5=0 THEN 17 ELSE 6 END AS protocol,
  CAST(32+event_id%33 AS INTEGER) AS ttl, CAST(8192+event_id%4096 AS INTEGER) AS tcp_win,
  CAST(event_id%11=0 AS INTEGER) AS is_frag, CAST(floor(value*10) AS BIGINT) AS payload_len,
  0 AS is_retrans, CAST(event_type IN ('signup','error') AS INTEGER) AS syn,
  CAST(event_type IN ('click','view') AS INTEGER) AS ack, CAST(event_type='purchase' AS INTEGER) AS fin,
  CAST(event_type='error' AS INTEGER) AS rst, CAST(event_type='view' AS INTEGER) AS psh, 0 AS urg,
  event_id%3 AS seq
FROM (SELECT *, user_id%15 + 15*(user_id//150) AS h,
        CAST(json_extract_string(props,'$.k') AS INTEGER) AS k FROM events)
"""
CTES["v_px"] = f"""
SELECT p.*, {fdiv('ts_us', SU)} - o.o AS window_id FROM v_packets p, (SELECT unnest(range({NB})) AS o) o
"""
CTES["v_pkt_feat"] = """
SELECT a.src_ip, a.window_id, ttl_mean, ttl_var, tcp_win_mean, tcp_win_var, frag_flag_count,
  payload_hist_0, payload_hist_1, payload_hist_2, payload_hist_3, payload_hist_4, payload_hist_5,
  payload_hist_6, payload_hist_7, distinct_dst_ports,
  CASE WHEN n>=2 THEN hits/CAST(n-1 AS DOUBLE) ELSE 0.0::DOUBLE END AS sequential_port_ratio,
  port_entropy, retransmission_count
FROM (SELECT src_ip, window_id, count(*) AS n, avg(ttl) AS ttl_mean, var_pop(ttl) AS ttl_var,
    coalesce(avg(CASE WHEN protocol=6 THEN tcp_win END),0) AS tcp_win_mean,
    coalesce(var_pop(CASE WHEN protocol=6 THEN tcp_win END),0) AS tcp_win_var,
    CAST(sum(is_frag) AS BIGINT) AS frag_flag_count,
    CAST(sum(is_retrans) AS BIGINT) AS retransmission_count,
    CAST(count(*) FILTER (payload_len>=0 AND payload_len<64) AS BIGINT) AS payload_hist_0,
    CAST(count(*) FILTER (payload_len>=64 AND payload_len<128) AS BIGINT) AS payload_hist_1,
    CAST(count(*) FILTER (payload_len>=128 AND payload_len<256) AS BIGINT) AS payload_hist_2,
    CAST(count(*) FILTER (payload_len>=256 AND payload_len<512) AS BIGINT) AS payload_hist_3,
    CAST(count(*) FILTER (payload_len>=512 AND payload_len<1024) AS BIGINT) AS payload_hist_4,
    CAST(count(*) FILTER (payload_len>=1024 AND payload_len<1460) AS BIGINT) AS payload_hist_5,
    CAST(count(*) FILTER (payload_len>=1460 AND payload_len<8192) AS BIGINT) AS payload_hist_6,
    CAST(count(*) FILTER (payload_len>=8192) AS BIGINT) AS payload_hist_7,
    CAST(sum(CASE WHEN dst_port-prev=1 THEN 1 ELSE 0 END) AS BIGINT) AS hits
  FROM (SELECT *, lag(dst_port) OVER (PARTITION BY src_ip, window_id ORDER BY ts_us, packet_no) AS prev FROM v_px)
  GROUP BY 1,2) a
JOIN (SELECT src_ip, window_id, count(*) AS distinct_dst_ports,
    greatest(-sum((c/CAST(t AS DOUBLE))*log2(c/CAST(t AS DOUBLE))), 0) AS port_entropy
  FROM (SELECT *, sum(c) OVER (PARTITION BY src_ip, window_id) AS t FROM
    (SELECT src_ip, window_id, dst_port, count(*) AS c FROM v_px GROUP BY 1,2,3)) GROUP BY 1,2) b
USING (src_ip, window_id)
"""
CTES["v_sent_feat"] = """
SELECT src_ip, window_id, CAST(sum(payload_len) AS BIGINT) AS sent_bytes, count(*) AS sent_pkts,
  CAST(sum(syn) AS BIGINT) AS syn, CAST(sum(ack) AS BIGINT) AS ack, CAST(sum(fin) AS BIGINT) AS fin,
  CAST(sum(rst) AS BIGINT) AS rst, CAST(sum(psh) AS BIGINT) AS psh, CAST(sum(urg) AS BIGINT) AS urg,
  coalesce(avg(CASE WHEN syn=1 THEN tcp_win END),0) AS syn_win_mean,
  avg(CASE WHEN src_port IN (20,21,22,23,25,53,80,110,143,443,445,993,995,3306,3389,8080) THEN 1.0::DOUBLE ELSE 0 END)
    AS server_port_ratio,
  count(DISTINCT dst_ip) AS distinct_dst_ips
FROM v_px GROUP BY 1,2
"""
FEATS = ("ttl_mean ttl_var tcp_win_mean tcp_win_var frag_flag_count payload_hist_0 payload_hist_1 "
         "payload_hist_2 payload_hist_3 payload_hist_4 payload_hist_5 payload_hist_6 payload_hist_7 "
         "distinct_dst_ports sequential_port_ratio port_entropy retransmission_count sent_bytes sent_pkts "
         "syn ack fin rst psh urg syn_win_mean server_port_ratio distinct_dst_ips").split()
INTERNAL = "(({c}&4294901760)=2887712768 OR ({c}&4278190080)=167772160 OR ({c}&4294901760)=3232235520)"


def hmac_hex(key: bytes, message_sql: str) -> str:
    key = key.ljust(64, b"\0")
    lit = lambda b: "'" + "".join(f"\\x{x:02X}" for x in b) + "'::BLOB"
    inner, outer = bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)
    return f"sha256({lit(outer)} || unhex(sha256({lit(inner)} || CAST({message_sql} AS BLOB))))"


KEY = b"view-key"


def net24(ip_text_sql):
    msg = f"('net24:' || regexp_replace({ip_text_sql}, '\\.[0-9]+$', ''))"
    return f"CAST(('0x' || substr({hmac_hex(KEY, msg)},1,8)) AS BIGINT) % 256"


def r6(cols):
    return ", ".join(f"round({c},6)+0.0 AS {c}" for c in cols)


DOUBLE_FEATS = {"ttl_mean", "ttl_var", "tcp_win_mean", "tcp_win_var", "sequential_port_ratio",
                "port_entropy", "syn_win_mean", "server_port_ratio"}


def feat_list(feats, prefix=""):
    return ", ".join(f"round({prefix}{c},6)+0.0 AS {c}" if c in DOUBLE_FEATS else f"{prefix}{c}" for c in feats)


CTES["v_windows"] = f"""
SELECT {ip_text('src_ip')} AS host, window_id, window_id*{S} AS window_start,
  strftime(make_timestamp(window_id*{SU}), '%Y-%m-%d') AS day, {", ".join(FEATS)},
  CAST({INTERNAL.format(c='src_ip')} AS INTEGER) AS internal,
  {net24(ip_text('src_ip'))} AS net24_bucket
FROM v_pkt_feat FULL OUTER JOIN v_sent_feat USING (src_ip, window_id)
"""
CTES["v_timeline"] = f"""
SELECT strftime(make_timestamp(d*86400000000), '%Y-%m-%d') AS date, d,
  (['FTP-BruteForce','DoS-Hulk','Infiltration','Botnet-Ares','Web-XSS','DDoS-LOIC'])[idx+1] AS name,
  (['recon','initial_access','lateral_movement','c2','exfiltration','impact'])[idx+1] AS stage, idx+1 AS stage_rank,
  (lo//60)*60 + 14400 AS start_s, (hi//60)*60 + 60 + 14400 AS end_s,
  {ip_text('src_ip')} AS attacker, {ip_text('victim')} AS victim
FROM (SELECT *, CAST((src_ip+d)%6 AS INTEGER) AS idx FROM
  (SELECT src_ip, d, count(*) AS n, min(s) AS lo, max(s) AS hi, min(dst_ip) AS victim FROM
    (SELECT *, s//86400 AS d FROM (SELECT *, ts_us//1000000 - 14400 AS s FROM v_packets WHERE rst=1 AND NOT {INTERNAL.format(c='src_ip')})) GROUP BY 1,2)
)
"""
CTES["v_parties"] = """
SELECT attacker AS host, start_s, end_s, stage_rank FROM v_timeline
UNION ALL SELECT victim, start_s, end_s, stage_rank FROM v_timeline WHERE victim<>attacker
"""
CTES["v_splits"] = """
SELECT strftime(make_timestamp(d*86400000000), '%Y-%m-%d') AS day, CASE WHEN (d-lo+1)*31 <= 15*(hi-lo+1) THEN 'train'
  WHEN (d-lo+1)*31 <= 22*(hi-lo+1) THEN 'val' ELSE 'test' END AS split
FROM (SELECT lo, hi, unnest(range(lo, hi+1)) AS d FROM (SELECT min(d) AS lo, max(d) AS hi FROM
  (SELECT window_start//86400 AS d FROM v_windows UNION ALL SELECT d FROM v_timeline)))
"""
CTES["v_labelled"] = f"""
SELECT w.*, s.split, (['benign','recon','initial_access','lateral_movement','c2','exfiltration','impact'])[
  coalesce((SELECT max(stage_rank) FROM v_parties p WHERE p.host=w.host AND w.window_start<p.end_s
            AND w.window_start+{W}>p.start_s),0)+1] AS stage
FROM v_windows w JOIN v_splits s USING (day)
"""
CTES["v_scored"] = """
SELECT *, CAST(stage<>'benign' AS INTEGER) AS y,
  round(1/(1+exp(-(rst*0.9::DOUBLE + sent_pkts*0.1::DOUBLE - sent_bytes*0.0005::DOUBLE - 2.0))),6) AS score_a,
  round(1/(1+exp(-(distinct_dst_ports*0.3::DOUBLE + syn*0.25::DOUBLE - ttl_mean*0.05::DOUBLE - 0.5))),6) AS score_b
FROM v_labelled
"""
CTES["v_long"] = """
SELECT 'a' AS model, split, host, window_id, window_start, y, score_a AS score FROM v_scored
UNION ALL SELECT 'b', split, host, window_id, window_start, y, score_b FROM v_scored
"""
CTES["v_episodes"] = """
SELECT attacker AS host, date, name, stage, start_s, end_s, split, start_s AS episode_no
FROM v_timeline t JOIN v_splits s ON s.day=t.date
"""
STAGE_CASE = """CASE WHEN sent_bytes>3000 AND distinct_dst_ips<=3 AND syn<10 THEN 'exfiltration'
  WHEN (distinct_dst_ports>9 OR sequential_port_ratio>0.1) AND internal=1 THEN 'lateral_movement'
  WHEN distinct_dst_ports>9 OR sequential_port_ratio>0.1 THEN 'recon'
  WHEN syn>3 AND ack<syn THEN 'initial_access' WHEN sent_pkts>5 THEN 'impact' ELSE 'unclassified' END"""
CTES["v_alerts"] = f"""
SELECT *, CASE stage WHEN 'recon' THEN 'T1046' WHEN 'initial_access' THEN 'T1110'
  WHEN 'lateral_movement' THEN CASE WHEN distinct_dst_ports>9 OR sequential_port_ratio>0.1 THEN 'T1046' ELSE 'T1021' END
  WHEN 'exfiltration' THEN CASE WHEN sent_bytes>3000 THEN 'T1048' ELSE 'T1041' END
  WHEN 'impact' THEN 'T1498' END AS technique,
  CASE stage WHEN 'recon' THEN CASE WHEN distinct_dst_ips>20 THEN 'Network Service Discovery'
      WHEN sequential_port_ratio>0.1 THEN 'Network Service Discovery (sequential port sweep)' ELSE '' END
  WHEN 'initial_access' THEN CASE WHEN syn>50 THEN 'Brute Force (credential guessing)' ELSE '' END
  WHEN 'lateral_movement' THEN CASE WHEN distinct_dst_ports>9 THEN 'Network Service Discovery (internal sweep)'
      WHEN sequential_port_ratio>0.1 THEN 'Network Service Discovery (internal sequential sweep)' ELSE 'Remote Services' END
  WHEN 'exfiltration' THEN CASE WHEN sent_bytes>3000 THEN
      'Exfiltration Over Alternative Protocol (large outbound transfer)' ELSE '' END
  WHEN 'impact' THEN 'Network Denial of Service'
  WHEN 'unclassified' THEN 'No stage rule matched - technique not determined' END AS technique_name
FROM (SELECT * EXCLUDE (stage), score_a AS probability, {STAGE_CASE} AS stage FROM v_scored WHERE score_a>=0.4)
"""
# -- packet features ---------------------------------------------------------
QUERIES["assign_windows"] = """
SELECT window_id, count(*) AS n_packets, count(DISTINCT src_ip) AS n_hosts,
  CAST(sum(payload_len) AS BIGINT) AS bytes FROM v_px GROUP BY 1"""
QUERIES["packet_window_features"] = f"SELECT src_ip, window_id, {feat_list(FEATS[:17])} FROM v_pkt_feat"
QUERIES["sent_window_features"] = f"SELECT src_ip, window_id, {feat_list(FEATS[17:])} FROM v_sent_feat"
QUERIES["window_features"] = (
    f"SELECT host, window_id, window_start, day, {feat_list(FEATS)}, internal, net24_bucket FROM v_windows")
QUERIES["label_windows"] = "SELECT host, window_id, stage, split FROM v_labelled"
QUERIES["scored_windows"] = "SELECT host, window_id, split, stage, y, score_a, score_b FROM v_scored"
QUERIES["alerts"] = "SELECT host, window_start, probability, stage, technique, technique_name FROM v_alerts"

# -- evaluation ---------------------------------------------------------------
CTES["v_budgets"] = "SELECT unnest([0.01::DOUBLE, 0.05::DOUBLE]) AS budget"
CTES["v_cand"] = """
SELECT model, split, score, (SELECT count(*) FROM v_long b WHERE b.model=c.model AND b.split=c.split AND b.y=0
   AND b.score>=c.score) AS n_false,
  (SELECT count(*) FROM v_long b WHERE b.model=c.model AND b.split=c.split AND b.y=0) AS n_benign
FROM (SELECT DISTINCT model, split, score FROM v_long) c
"""
CTES["v_thr"] = """
SELECT model, split, budget, max(n_benign) AS n_benign,
  coalesce(min(score) FILTER (n_false/CAST(n_benign AS DOUBLE)<=budget), max(score)+1e-16) AS threshold
FROM v_cand, v_budgets GROUP BY 1,2,3
"""
CTES["v_valthr"] = "SELECT model, budget, threshold FROM v_thr WHERE split='val'"
RATES = """
CASE WHEN tp+fp>0 THEN tp/CAST(tp+fp AS DOUBLE) ELSE 0 END AS precision,
CASE WHEN tp+fn>0 THEN tp/CAST(tp+fn AS DOUBLE) ELSE 0 END AS recall,
CASE WHEN 2*tp+fp+fn>0 THEN 2*tp/CAST(2*tp+fp+fn AS DOUBLE) ELSE 0 END AS f1,
CASE WHEN fp+tn>0 THEN fp/CAST(fp+tn AS DOUBLE) ELSE 0 END AS fpr, tp+fp AS n_alerts"""


def rates(src):
    return f"SELECT *, {RATES} FROM ({src})"


def confusion(by, src):
    return f"""SELECT {by}, max(threshold) AS threshold,
  count(*) FILTER (score>=threshold AND y=1) AS tp, count(*) FILTER (score>=threshold AND y=0) AS fp,
  count(*) FILTER (score<threshold AND y=1) AS fn, count(*) FILTER (score<threshold AND y=0) AS tn
  FROM {src} GROUP BY ALL"""


CTES["v_points"] = rates(confusion("model, split, budget", "v_long JOIN v_valthr USING (model)"))
CTES["v_auroc"] = """
SELECT model, split, CASE WHEN p>0 AND q>0 THEN (rs - p*(p+1)/2.0::DOUBLE)/(p*q) ELSE 0.5::DOUBLE END AS auroc,
  p AS n_attack, p+q AS n_rows
FROM (SELECT model, split, CAST(sum(y) AS BIGINT) AS p, CAST(sum(1-y) AS BIGINT) AS q,
    sum(CASE WHEN y=1 THEN r ELSE 0 END) AS rs
  FROM (SELECT *, rank() OVER (PARTITION BY model, split ORDER BY score)
      + (count(*) OVER (PARTITION BY model, split, score)-1)/2.0::DOUBLE AS r FROM v_long) GROUP BY 1,2)
"""
BIN = "+".join(f"CAST(score>={(1.0 / 15) * i!r}::DOUBLE AS INTEGER)" for i in range(1, 15))
CTES["v_rel"] = f"""
SELECT model, split, {BIN} AS bin, count(*) AS n, avg(score) AS confidence, avg(y) AS accuracy FROM v_long GROUP BY 1,2,3
"""
CTES["v_ece"] = """SELECT model, split, sum(n*abs(accuracy-confidence))/sum(n) AS ece FROM v_rel GROUP BY 1,2"""


def leads(tags, fired, runs, grace=0):
    on = " AND ".join(f"f.{t}=r.{t}" for t in tags)
    cols = ", ".join(f"r.{t}" for t in tags)
    return f"""
SELECT *, coalesce(greatest(end_s-first_alert,0),0)::DOUBLE AS lead_seconds,
  CAST(first_alert IS NOT NULL AS INTEGER) AS detected FROM (
SELECT {cols}, e.split, e.host, e.episode_no, e.start_s, e.end_s, min(f.window_start) AS first_alert
FROM v_episodes e JOIN {runs} r ON r.split=e.split
LEFT JOIN {fired} f ON {on} AND f.split=e.split AND f.host=e.host
  AND f.window_start BETWEEN e.start_s-{grace} AND e.end_s
GROUP BY {cols}, e.split, e.host, e.episode_no, e.start_s, e.end_s)"""


def lead_summary(tags, src):
    return f"""SELECT {', '.join(tags)}, split, quantile_cont(lead_seconds,0.5) AS lead_median,
  quantile_cont(lead_seconds,0.25) AS lead_q25, quantile_cont(lead_seconds,0.75) AS lead_q75,
  CAST(sum(detected) AS BIGINT) AS episodes_detected, count(*) AS episodes_total FROM ({src}) GROUP BY ALL"""


RUNS = "(SELECT DISTINCT model, split FROM v_long)"
CTES["v_results"] = f"""
SELECT p.*, lead_median, lead_q25, lead_q75, episodes_detected, episodes_total, auroc, n_attack, n_rows, ece,
  p.n_alerts/(n_rows*{S}/86400.0::DOUBLE) AS alerts_per_host_day
FROM v_points p JOIN v_auroc USING (model, split) JOIN v_ece USING (model, split) LEFT JOIN (
{lead_summary(['model', 'budget'], leads(['model', 'budget'],
   "(SELECT * FROM v_long JOIN v_valthr USING (model) WHERE score>=threshold)",
   "(SELECT DISTINCT model, split, budget FROM v_points)"))}) l USING (model, budget, split)
WHERE split IN ('val','test')
"""


def rnd(cols_round, others, src, order=""):
    cols = [*others, *[f"round({c},6)+0.0 AS {c}" for c in cols_round]]
    return f"SELECT {', '.join(cols)} FROM {src} {order}"


QUERIES["threshold_at_fpr"] = rnd(["threshold"], ["model", "split", "budget", "n_benign"], "v_thr")
QUERIES["operating_points"] = """
SELECT t.model, t.split, budget, round(threshold,6)+0.0 AS threshold, n_benign,
  round((SELECT count(*) FROM v_long l WHERE l.model=t.model AND l.split=t.split AND l.y=0 AND l.score>=t.threshold)
    /CAST(n_benign AS DOUBLE),6)+0.0 AS achieved_fpr, round(1.0::DOUBLE/n_benign,6)+0.0 AS finest_expressible_fpr,
  CAST(budget>=1.0::DOUBLE/n_benign AS INTEGER) AS budget_expressible FROM v_thr t"""
R4 = ["precision", "recall", "f1", "fpr"]
QUERIES["classification_at_threshold"] = rnd(
    ["threshold", *R4], ["model", "split", "budget", "tp", "fp", "fn", "tn", "n_alerts"], "v_points")
QUERIES["auroc"] = rnd(["auroc"], ["model", "split", "n_attack", "n_rows"], "v_auroc")
QUERIES["calibration"] = rnd(["confidence", "accuracy"], ["model", "split", "bin", "n"], "v_rel")
QUERIES["calibration_error"] = rnd(["ece"], ["model", "split"], "v_ece")
FIRED5 = "(SELECT * FROM v_long WHERE score>=0.5)"
QUERIES["lead_time"] = leads(["model"], FIRED5, RUNS, S)
LQ = ["lead_median", "lead_q25", "lead_q75"]
QUERIES["lead_time_summary"] = rnd(LQ, ["model", "split", "episodes_detected", "episodes_total"],
                                   f"({lead_summary(['model'], leads(['model'], FIRED5, RUNS))})")
QUERIES["alerts_per_host_day"] = f"""
SELECT *, round(n_alerts/(n_windows*{S}/86400.0::DOUBLE),6)+0.0 AS rate FROM (SELECT model, split,
  count(*) FILTER (score>=0.5) AS n_alerts, count(*) AS n_windows FROM v_long GROUP BY 1,2)"""
RES_D = ["threshold", *R4, *LQ, "auroc", "ece", "alerts_per_host_day"]
RES_I = ["model", "split", "budget", "tp", "fp", "fn", "tn", "n_alerts", "episodes_detected", "episodes_total",
         "n_attack", "n_rows"]
QUERIES["evaluation_results"] = rnd(RES_D, RES_I, "v_results")
CTES["v_rep"] = """
SELECT * EXCLUDE (score), round(score/(1+copy)+1e-9,6) AS score
FROM (SELECT *, unnest(range(0, window_id%3+1)) AS copy FROM v_long)
"""
DEDUP = """(SELECT model, split, host, window_id, {pick} AS score, max(y) AS y, count(*) AS multiplicity
  FROM v_rep GROUP BY 1,2,3,4)"""
QUERIES["dedup_host_windows"] = rnd(["score"], ["model", "split", "host", "window_id", "y", "multiplicity"],
                                    DEDUP.format(pick="max(score)"))
QUERIES["dedup_host_windows_mean"] = rnd(["score"], ["model", "split", "host", "window_id", "y", "multiplicity"],
                                         DEDUP.format(pick="avg(score)"))
QUERIES["multiplicity_report"] = f"""
SELECT model, split, y, count(*) AS n_windows, round(avg(multiplicity),6)+0.0 AS mean_rows,
  max(multiplicity) AS max_rows FROM {DEDUP.format(pick="max(score)")} GROUP BY 1,2,3"""


def phash(seed, *cols):
    joined = ", ".join(f"CAST({c} AS VARCHAR)" for c in cols)
    return f"CAST('0x' || substr(sha256(concat_ws(':', '{seed}', {joined})),1,13) AS BIGINT)"


RANDOM = f"""(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model, split ORDER BY
   {phash(1337, 'host', 'window_id')}, host, window_id) AS rn,
   count(*) FILTER (score>=0.5) OVER (PARTITION BY model, split) AS n_alerts FROM v_long) WHERE rn<=n_alerts)"""
QUERIES["random_baseline"] = rnd(LQ, ["model", "split", "episodes_detected", "episodes_total"],
                                 f"({lead_summary(['model'], leads(['model'], RANDOM, RUNS))})")
QUERIES["label_agreement"] = """
SELECT CAST(k AS INTEGER) AS k, count(*) AS n_rows, round(avg(CAST(a.y=b.y AS INTEGER)),6)+0.0 AS agreement
FROM v_scored a, (SELECT unnest([1,4,8]) AS k) ks JOIN v_scored b ON b.host=a.host AND b.window_id=a.window_id+k GROUP BY 1"""
QUERIES["shift_target"] = """
SELECT a.host, a.window_id, b.stage, a.score_a FROM v_scored a JOIN v_scored b ON b.host=a.host AND b.window_id=a.window_id+4"""
QUERIES["spearman"] = """
SELECT split, round(corr(ra, rb),6)+0.0 AS spearman, count(*) AS n FROM (SELECT split,
  rank() OVER (PARTITION BY split ORDER BY score_a) + (count(*) OVER (PARTITION BY split, score_a)-1)/2.0::DOUBLE AS ra,
  rank() OVER (PARTITION BY split ORDER BY score_b) + (count(*) OVER (PARTITION BY split, score_b)-1)/2.0::DOUBLE AS rb
  FROM v_scored) GROUP BY 1"""
QUERIES["per_episode_report"] = """
SELECT model, split, host, episode_no, start_s, end_s, n_windows, n_fired, first_s-start_s AS first_offset,
  end_s-first_s AS lead_seconds, max_score
FROM (SELECT model, split, host, episode_no, start_s, end_s, count(*) AS n_windows,
  count(*) FILTER (score>=threshold) AS n_fired, min(window_start) FILTER (score>=threshold) AS first_s,
  max(score) AS max_score
FROM v_long JOIN v_episodes e USING (split, host) JOIN v_valthr t USING (model)
WHERE window_start BETWEEN e.start_s AND e.end_s AND budget=0.05
GROUP BY model, split, host, episode_no, start_s, end_s)"""
CTES["v_policy"] = """
SELECT model, budget, threshold, CASE split WHEN 'val' THEN 'shipped' ELSE 'oracle' END AS policy
FROM v_thr WHERE split IN ('val','test')
"""
CTES["v_transfer"] = f"""
SELECT p.*, episodes_detected, lead_median FROM ({rates(confusion("model, split, policy, budget",
  "v_long JOIN v_policy USING (model) WHERE split='test'"))}) p LEFT JOIN (
{lead_summary(['model', 'policy', 'budget'], leads(['model', 'policy', 'budget'],
  "(SELECT * FROM v_long JOIN v_policy USING (model) WHERE split='test' AND score>=threshold)",
  "(SELECT DISTINCT model, 'test' AS split, policy, budget FROM v_policy)"))}) USING (model, policy, budget, split)
"""
TC = ["threshold", "recall", "fpr", "lead_median"]
QUERIES["threshold_transfer"] = f"""
SELECT model, budget, {", ".join(f"round(max({c}) FILTER (policy='{p}'),6)+0.0 AS {c}_{p}" for p in ("shipped", "oracle") for c in TC)},
  max(episodes_detected) FILTER (policy='shipped') AS episodes_detected_shipped,
  max(episodes_detected) FILTER (policy='oracle') AS episodes_detected_oracle,
  round(max(threshold) FILTER (policy='shipped')/greatest(max(threshold) FILTER (policy='oracle'),1e-12),6)+0.0 AS ratio,
  CASE WHEN max(episodes_detected) FILTER (policy='oracle')>max(episodes_detected) FILTER (policy='shipped')
    OR max(recall) FILTER (policy='oracle')>max(recall) FILTER (policy='shipped')+0.05 THEN 'TRANSFER GAP'
    ELSE 'transfers OK' END AS verdict FROM v_transfer GROUP BY 1,2"""
QUERIES["score_distribution"] = """
SELECT model, split, y, count(*) AS n, min(score) AS min, max(score) AS max, round(avg(score),6)+0.0 AS mean,
  round(quantile_cont(score,0.5),6)+0.0 AS median, round(quantile_cont(score,0.99),6)+0.0 AS p99 FROM v_long GROUP BY 1,2,3"""
QUERIES["confusion_from_rates"] = f"""
SELECT model, split, budget, tp, fp, fn, tn, tp+fp AS n_alerts, {", ".join(f"round({c},6)+0.0 AS {c}" for c in R4)},
  round((tp+tn)/CAST(tp+fp+fn+tn AS DOUBLE),6)+0.0 AS accuracy FROM v_results"""
QUERIES["comparison_table"] = f"""
SELECT model, split, {", ".join(f"round({c},6)+0.0 AS {c}" for c in ("f1", "precision", "recall", "auroc", "ece",
  "lead_median", "alerts_per_host_day"))}, round(fpr,6)+0.0 AS fpr_achieved,
  CASE WHEN episodes_total>=8 THEN round(lead_q25,6)+0.0 END AS lead_q25,
  CASE WHEN episodes_total>=8 THEN round(lead_q75,6)+0.0 END AS lead_q75, episodes_detected, episodes_total
FROM v_results WHERE budget=0.05 AND split='test'"""
GC = ["f1", "recall", "auroc", "lead_median"]
QUERIES["split_gap_table"] = f"""
SELECT v.model, {", ".join(f"round(v.{c},6)+0.0 AS val_{c}, round(t.{c},6)+0.0 AS test_{c}, round(t.{c}-v.{c},6)+0.0 AS gap_{c}" for c in GC)}
FROM v_results v JOIN v_results t ON v.model=t.model AND v.budget=t.budget AND v.split='val' AND t.split='test'
WHERE v.budget=0.05"""
QUERIES["select_by_validation"] = """
SELECT b.model, round(b.auroc,6)+0.0 AS val_auroc, round(t.auroc,6)+0.0 AS test_auroc, round(a.auroc,6)+0.0 AS bar,
  CAST(b.auroc>a.auroc AS INTEGER) AS promote
FROM v_auroc b JOIN v_auroc t ON t.model=b.model AND t.split='test' JOIN v_auroc a ON a.model='a' AND a.split='val'
WHERE b.split='val' AND b.model<>'a'"""
GROUPS = f"""(SELECT l.*, coalesce('episode:' || (SELECT max(episode_no) FROM v_episodes e WHERE e.host=l.host
   AND l.window_start+{{k}}*{S} BETWEEN e.start_s AND e.end_s) || ':' || host, 'host:' || host) AS group_id FROM v_long l)"""
QUERIES["episode_groups"] = f"SELECT host, window_id, group_id FROM {GROUPS.format(k=2)} WHERE model='a'"
CTES["v_grouped"] = "SELECT * FROM " + GROUPS.format(k=0)
CTES["v_groupno"] = f"""
SELECT *, row_number() OVER (PARTITION BY model, split ORDER BY {phash(1337, 'group_id')}, group_id) AS group_no,
  count(*) OVER (PARTITION BY model, split) AS n_groups FROM (SELECT DISTINCT model, split, group_id FROM v_grouped)
"""
CTES["v_draws"] = f"""
SELECT d.model, d.split, d.replicate, g.group_id, count(*) AS w FROM (
  SELECT model, split, r AS replicate, {phash(1337, 'r', 'group_no')} % n_groups + 1 AS pick
  FROM v_groupno, range(1, 1001) t(r)) d JOIN v_groupno g ON g.model=d.model AND g.split=d.split AND g.group_no=d.pick
GROUP BY 1,2,3,4
"""
CTES["v_resampled"] = """
SELECT d.replicate, l.* FROM v_grouped l JOIN v_draws d USING (model, split, group_id), range(0, 1000) c(i) WHERE c.i<d.w
"""


def boot(by, value_sql, point_sql):
    cols = ", ".join(by)
    return f"""
SELECT {", ".join("s." + b for b in by)}, round(p.point,6)+0.0 AS point, round(i.low,6)+0.0 AS low, round(i.high,6)+0.0 AS high,
  0.95::DOUBLE AS level, s.n_groups, 1000 AS n_resamples, i.n_usable
FROM (SELECT model, split, max(n_groups) AS n_groups FROM v_groupno GROUP BY 1,2) s
JOIN ({point_sql}) p USING (model, split) JOIN (
  SELECT {cols}, quantile_cont(value,0.025) AS low, quantile_cont(value,0.975) AS high, count(value) AS n_usable
  FROM ({value_sql}) GROUP BY ALL) i USING ({cols})"""


def auc(by, src, name):
    return f"""SELECT {by}, CASE WHEN sum(y)>0 AND sum(1-y)>0 THEN
  (sum(CASE WHEN y=1 THEN r ELSE 0 END) - sum(y)*(sum(y)+1)/2.0::DOUBLE)/(CAST(sum(y) AS DOUBLE)*sum(1-y)) END AS {name}
  FROM (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY score)
     + (count(*) OVER (PARTITION BY {by}, score)-1)/2.0::DOUBLE AS r FROM {src}) GROUP BY {by}"""


def f1s(by, src, name, thr="0.5"):
    t = lambda c: f"(count(*) FILTER ({c}))"
    tp, fp, fn = t(f"score>={thr} AND y=1"), t(f"score>={thr} AND y=0"), t(f"score<{thr} AND y=1")
    return f"""SELECT {by}, CASE WHEN sum(y)>0 AND sum(y)<count(*) THEN
  CASE WHEN 2*{tp}+{fp}+{fn}>0 THEN 2*{tp}/CAST(2*{tp}+{fp}+{fn} AS DOUBLE) ELSE 0 END END AS {name} FROM {src} GROUP BY {by}"""


MSR = "model, split, replicate"
QUERIES["bootstrap_auroc"] = boot(["model", "split"], auc(MSR, "v_resampled", "value"), auc("model, split", "v_long", "point"))
QUERIES["bootstrap_f1"] = boot(["model", "split"], f1s(MSR, "v_resampled", "value"), f1s("model, split", "v_long", "point"))
QUERIES["bootstrap_mean_score"] = boot(
    ["model", "split"], f"SELECT {MSR}, avg(score) AS value FROM v_resampled GROUP BY {MSR}",
    "SELECT model, split, avg(score) AS point FROM v_long GROUP BY 1,2")
MSB = "model, split, budget"
QUERIES["annotate_intervals"] = f"""
SELECT 'auroc' AS statistic, CAST(NULL AS DOUBLE) AS budget, *, CAST(NULL AS VARCHAR) AS unavailable FROM ({QUERIES["bootstrap_auroc"]})
UNION ALL BY NAME
SELECT 'f1' AS statistic, i.budget, p.model, p.split, round(p.point,6)+0.0 AS point, round(i.low,6)+0.0 AS low,
  round(i.high,6)+0.0 AS high, 0.95::DOUBLE AS level, s.n_groups, 1000 AS n_resamples, i.n_usable, CAST(NULL AS VARCHAR) AS unavailable
FROM (SELECT model, split, max(n_groups) AS n_groups FROM v_groupno GROUP BY 1,2) s
JOIN ({f1s(MSB, "v_long JOIN v_valthr USING (model)", "point", "threshold")}) p USING (model, split)
JOIN (SELECT {MSB}, quantile_cont(value,0.025) AS low, quantile_cont(value,0.975) AS high, count(value) AS n_usable
  FROM ({f1s(MSB + ", replicate", "v_resampled JOIN v_valthr USING (model)", "value", "threshold")}) GROUP BY ALL) i
USING (model, split, budget)"""
QUERIES["align_scores"] = """
SELECT split, host, window_id, y, score_a, score_b FROM v_scored"""
QUERIES["fuse_mean"] = "SELECT host, window_id, round((score_a+score_b)/2,6)+0.0 AS score FROM v_scored"
PCT = """(rank() OVER (PARTITION BY split ORDER BY {c}) + (count(*) OVER (PARTITION BY split, {c})-1)/2.0::DOUBLE)
  / count(*) OVER (PARTITION BY split)"""
QUERIES["rank_fusion"] = f"""
SELECT split, host, window_id, round(({PCT.format(c='score_a')} + {PCT.format(c='score_b')})/2,6)+0.0 AS score FROM v_scored"""
ECDF = """(SELECT count(*) FROM v_scored f WHERE f.split='val' AND f.{c}<=s.{c})/CAST((SELECT count(*) FROM v_scored WHERE split='val') AS DOUBLE)"""
QUERIES["causal_fusion"] = f"""
SELECT split, host, window_id, round(({ECDF.format(c='score_a')} + {ECDF.format(c='score_b')})/2,6)+0.0 AS score FROM v_scored s"""
QUERIES["attack_intervals"] = """
SELECT name, stage, start_s, end_s, CASE WHEN attacker=victim THEN attacker ELSE attacker || '|' || victim END AS parties FROM v_timeline"""
QUERIES["attacker_episodes"] = "SELECT * EXCLUDE (episode_no) FROM v_episodes"
FAMILY = """CASE WHEN lower(name) LIKE '%brute%' THEN 'bruteforce' WHEN lower(name) LIKE '%ddos%' THEN 'ddos'
  WHEN lower(name) LIKE 'dos%' THEN 'dos' WHEN lower(name) LIKE '%infiltration%' THEN 'infiltration'
  WHEN lower(name) LIKE '%bot%' THEN 'bot' WHEN lower(name) LIKE '%web%' OR lower(name) LIKE '%xss%' OR lower(name) LIKE '%sql%'
  THEN 'web' ELSE 'other' END"""
QUERIES["attack_family"] = f"SELECT {FAMILY} AS family, count(*) AS n_attacks, count(DISTINCT date) AS n_days FROM v_timeline GROUP BY 1"
QUERIES["drop_family"] = f"""
SELECT day, stage, count(*) AS n FROM v_scored WHERE NOT (stage<>'benign' AND day IN
  (SELECT date FROM v_timeline WHERE {FAMILY}='bruteforce')) GROUP BY 1,2"""
QUERIES["class_counts"] = """
SELECT CAST(i AS INTEGER) AS stage_no, st AS stage, train, val, test, train+val+test AS total, CAST(train+val+test=0 AS INTEGER) AS absent,
  CAST(train+val+test BETWEEN 1 AND 499 AS INTEGER) AS small FROM (SELECT n.i, n.st,
  count(s.host) FILTER (split='train') AS train, count(s.host) FILTER (split='val') AS val, count(s.host) FILTER (split='test') AS test
  FROM (SELECT unnest(['benign','recon','initial_access','lateral_movement','c2','exfiltration','impact']) AS st, unnest(range(7)) AS i) n
  LEFT JOIN v_scored s ON s.stage=n.st GROUP BY 1,2)"""
QUERIES["union_splits"] = """
SELECT split, count(*) AS n_rows, count(DISTINCT day) AS n_days, CAST(sum(sent_bytes) AS BIGINT) AS sent_bytes
FROM v_windows JOIN v_splits USING (day) GROUP BY 1"""
QUERIES["split_overlap"] = """
SELECT host || '@' || window_id AS item, CAST(2 AS BIGINT) AS n_splits FROM v_windows JOIN v_splits USING (day) WHERE split='val'
UNION ALL SELECT DISTINCT day, 2 FROM v_windows JOIN v_splits USING (day) WHERE split='val'"""

# -- packet statistics, flows ---------------------------------------------------
def some(*names):
    return f"SELECT src_ip, window_id, {feat_list(names)} FROM v_pkt_feat"


QUERIES["ttl_stats"] = some("ttl_mean", "ttl_var")
QUERIES["tcp_win_stats"] = some("tcp_win_mean", "tcp_win_var")
QUERIES["payload_histogram"] = some(*[f"payload_hist_{i}" for i in range(8)])
QUERIES["port_spread"] = some("distinct_dst_ports", "port_entropy")
QUERIES["sequential_port_ratio"] = some("sequential_port_ratio")
CTES["v_marked"] = """
SELECT * EXCLUDE (is_retrans, ok, rn), CAST(ok AND rn>1 AS INTEGER) AS is_retrans FROM (
  SELECT *, row_number() OVER (PARTITION BY ok, src_ip, dst_ip, src_port, dst_port, seq, payload_len ORDER BY ts_us, packet_no) AS rn
  FROM (SELECT * REPLACE (payload_len%3 AS payload_len, dst_port%2 AS dst_port),
    protocol=6 AND is_frag=0 AND (payload_len%3>0 OR syn=1 OR fin=1) AS ok FROM v_packets))
"""
QUERIES["frag_and_retrans_counts"] = f"""
SELECT src_ip, {fdiv('ts_us', SU)} - o.o AS window_id, CAST(sum(is_frag) AS BIGINT) AS frag_flag_count,
  CAST(sum(is_retrans) AS BIGINT) AS retransmission_count FROM v_marked, (SELECT unnest(range({NB})) AS o) o GROUP BY 1,2"""
QUERIES["mark_retransmissions"] = """
SELECT src_ip, protocol, count(*) AS n, CAST(sum(is_retrans) AS BIGINT) AS n_retrans,
  CAST(sum(CASE WHEN is_retrans=1 THEN packet_no ELSE 0 END) AS BIGINT) AS retrans_no_sum FROM v_marked GROUP BY 1,2"""
QUERIES["merge_features"] = """
SELECT src_ip, window_id, round(coalesce(a.ttl_mean,0),6)+0.0 AS ttl_mean, coalesce(a.distinct_dst_ports,0) AS distinct_dst_ports,
  coalesce(b.sent_pkts,0) AS sent_pkts, coalesce(b.distinct_dst_ips,0) AS distinct_dst_ips
FROM (SELECT src_ip, window_id, avg(ttl) AS ttl_mean, count(DISTINCT dst_port) AS distinct_dst_ports FROM v_px WHERE protocol=6 GROUP BY 1,2) a
FULL OUTER JOIN (SELECT src_ip, window_id, count(*) AS sent_pkts, count(DISTINCT dst_ip) AS distinct_dst_ips FROM v_px WHERE protocol=17 GROUP BY 1,2) b
USING (src_ip, window_id)"""
QUERIES["time_order"] = """
SELECT src_ip, ts_us, packet_no, row_number() OVER (ORDER BY ts_us, packet_no) AS position FROM v_packets"""
CTES["v_conv"] = """
SELECT * REPLACE (CASE WHEN back THEN dst_ip ELSE src_ip END AS src_ip, CASE WHEN back THEN src_ip ELSE dst_ip END AS dst_ip,
  CASE WHEN back THEN dst_port ELSE src_port END AS src_port, CASE WHEN back THEN src_port ELSE dst_port END AS dst_port)
FROM (SELECT * REPLACE (40000+src_port%2 AS src_port, 80+dst_port%3 AS dst_port), packet_no%3=0 AS back FROM v_packets)
"""
CTES["v_pflows"] = """
SELECT start_us, CASE WHEN flo THEN lo_ip ELSE hi_ip END AS src_ip, CASE WHEN flo THEN hi_ip ELSE lo_ip END AS dst_ip,
  CAST(CASE WHEN flo THEN lo%65536 ELSE hi%65536 END AS INTEGER) AS src_port,
  CAST(CASE WHEN flo THEN hi%65536 ELSE lo%65536 END AS INTEGER) AS dst_port, protocol,
  CAST(end_us-start_us AS DOUBLE) AS duration,
  CAST(CASE WHEN flo THEN lo_b ELSE hi_b END AS DOUBLE) AS fwd_bytes, CAST(CASE WHEN flo THEN hi_b ELSE lo_b END AS DOUBLE) AS bwd_bytes,
  CASE WHEN flo THEN lo_n ELSE hi_n END AS fwd_pkts, CASE WHEN flo THEN hi_n ELSE lo_n END AS bwd_pkts,
  syn, ack, fin, rst, psh, urg, coalesce(iat_mean,0) AS iat_mean, coalesce(iat_std,0) AS iat_std, coalesce(iat_max,0)::DOUBLE AS iat_max,
  coalesce(CASE WHEN flo THEN lo_w ELSE hi_w END, -1) AS init_win_fwd, coalesce(CASE WHEN flo THEN hi_w ELSE lo_w END, -1) AS init_win_bwd,
  'unlabeled' AS label
FROM (SELECT lo, hi, protocol, flow_no, lo//65536 AS lo_ip, hi//65536 AS hi_ip, arg_min(flo, o) AS flo,
    min(ts_us) AS start_us, max(ts_us) AS end_us, CAST(sum(CASE WHEN flo THEN payload_len ELSE 0 END) AS BIGINT) AS lo_b,
    CAST(sum(CASE WHEN NOT flo THEN payload_len ELSE 0 END) AS BIGINT) AS hi_b,
    count(*) FILTER (flo) AS lo_n, count(*) FILTER (NOT flo) AS hi_n,
    CAST(sum(syn) AS BIGINT) AS syn, CAST(sum(ack) AS BIGINT) AS ack, CAST(sum(fin) AS BIGINT) AS fin,
    CAST(sum(rst) AS BIGINT) AS rst, CAST(sum(psh) AS BIGINT) AS psh, CAST(sum(urg) AS BIGINT) AS urg,
    avg(iat) AS iat_mean, stddev_pop(iat) AS iat_std, max(iat) AS iat_max,
    arg_min(tcp_win, o) FILTER (flo AND syn=1) AS lo_w, arg_min(tcp_win, o) FILTER (NOT flo AND syn=1) AS hi_w
  FROM (SELECT *, CASE WHEN gap<=43200000000 THEN gap END AS iat, ts_us::HUGEINT*100000000+packet_no AS o,
      sum(CASE WHEN gap<=43200000000 THEN 0 ELSE 1 END) OVER (PARTITION BY lo, hi, protocol ORDER BY ts_us, packet_no) AS flow_no
    FROM (SELECT *, ts_us - lag(ts_us) OVER (PARTITION BY lo, hi, protocol ORDER BY ts_us, packet_no) AS gap
      FROM (SELECT *, least(a,b) AS lo, greatest(a,b) AS hi, a<=b AS flo
        FROM (SELECT *, src_ip*65536+src_port AS a, dst_ip*65536+dst_port AS b FROM v_conv)))) GROUP BY 1,2,3,4)
"""
FLOW_I = ("start_us src_ip dst_ip src_port dst_port protocol fwd_pkts bwd_pkts syn ack fin rst psh urg init_win_fwd "
          "init_win_bwd label").split()
QUERIES["assemble_flows"] = rnd(["duration", "fwd_bytes", "bwd_bytes", "iat_mean", "iat_std", "iat_max"], FLOW_I,
    """(SELECT * REPLACE (duration/1e6 AS duration, iat_mean/1e6 AS iat_mean, iat_std/1e6 AS iat_std, iat_max/1e6 AS iat_max)
    FROM v_pflows)""")
CTES["v_lflows"] = """
SELECT epoch_us(l_shipdate)+(l_orderkey%86400)*1000000 AS start_us, 167772160+l_suppkey AS src_ip,
  167837696+l_partkey%200 AS dst_ip, CASE l_linenumber WHEN 1 THEN 443 WHEN 2 THEN 22 ELSE 1024+l_linenumber END AS src_port,
  l_orderkey%1024 AS dst_port, CASE WHEN l_linenumber=7 THEN 0 ELSE l_quantity*600000000 END AS duration,
  l_extendedprice AS fwd_bytes, CAST(l_quantity AS BIGINT) AS fwd_pkts,
  CAST(l_returnflag='R' AS INTEGER) AS syn, CAST(l_returnflag='A' AS INTEGER) AS ack, CAST(l_returnflag='N' AS INTEGER) AS fin,
  CAST(l_linestatus='O' AS INTEGER) AS rst, CAST(l_linestatus='F' AS INTEGER) AS psh, 0 AS urg,
  CASE WHEN l_returnflag='R' THEN 8192+l_linenumber ELSE -1 END AS init_win_fwd FROM lineitem
"""
CTES["v_spread"] = f"""
SELECT *, CASE WHEN duration>0 THEN (least(start_us+duration, window_id*{SU}+{WU})-greatest(start_us, window_id*{SU}))/duration
  ELSE 1.0::DOUBLE END AS frac
FROM (SELECT *, {fdiv('start_us', SU)} AS b, unnest(CASE WHEN duration>0
  THEN range({fdiv(f'start_us-{WU}', SU)}, {fdiv('start_us+CAST(duration AS BIGINT)', SU)}+2)
  ELSE range({fdiv('start_us', SU)}-{NB - 1}, {fdiv('start_us', SU)}+1) END) AS window_id FROM v_lflows)
"""
CTES["v_lwin"] = f"""
SELECT src_ip, window_id, sum(fwd_bytes*frac) AS sent_bytes, sum(fwd_pkts*frac) AS sent_pkts,
  {", ".join(f"sum({f}*frac) AS {f}" for f in ("syn", "ack", "fin", "rst", "psh", "urg"))},
  greatest(coalesce(avg(CASE WHEN init_win_fwd>=0 THEN init_win_fwd END),0),0) AS syn_win_mean,
  greatest(avg(init_win_fwd),0) AS sentinel_mean,
  avg(CASE WHEN src_port IN (20,21,22,23,25,53,80,110,143,443,445,993,995,3306,3389,8080) THEN 1.0::DOUBLE ELSE 0 END) AS server_port_ratio,
  count(DISTINCT dst_ip) AS distinct_dst_ips FROM v_spread WHERE frac>0 GROUP BY 1,2
"""
QUERIES["flows_to_windows"] = rnd(["sent_bytes", "sent_pkts", "syn", "ack", "fin", "rst", "psh", "urg", "syn_win_mean",
                                   "server_port_ratio"], ["src_ip", "window_id", "distinct_dst_ips"], "v_lwin")
QUERIES["flows_to_windows_sentinel"] = "SELECT src_ip, window_id, round(sentinel_mean,6)+0.0 AS syn_win_mean FROM v_lwin"
QUERIES["flow_window_features"] = f"""
SELECT {ip_text('src_ip')} AS host, window_id, strftime(make_timestamp(window_id*{SU}), '%Y-%m-%d') AS day,
  0.0::DOUBLE AS ttl_mean, 0.0::DOUBLE AS port_entropy, round(sent_bytes,6)+0.0 AS sent_bytes, round(sent_pkts,6)+0.0 AS sent_pkts,
  CAST({INTERNAL.format(c='src_ip')} AS INTEGER) AS internal, {net24(ip_text('src_ip'))} AS net24_bucket FROM v_lwin"""
QUERIES["role_features"] = f"""
SELECT {ip_text('ip')} AS host, CAST({INTERNAL.format(c='ip')} AS INTEGER) AS internal, {net24(ip_text('ip'))} AS net24_bucket,
  round(r,6)+0.0 AS server_port_ratio FROM (SELECT ip, avg(CASE WHEN port IN
  (20,21,22,23,25,53,80,110,143,443,445,993,995,3306,3389,8080) THEN 1.0::DOUBLE ELSE 0 END) AS r FROM
  (SELECT src_ip AS ip, src_port AS port FROM v_lflows UNION ALL SELECT dst_ip, dst_port FROM v_lflows) GROUP BY 1)"""
QUERIES["address_forms"] = f"""
SELECT ip, n, {ip_text('ip')} AS text, ip AS back, CAST({INTERNAL.format(c='ip')} AS INTEGER) AS internal
FROM (SELECT ip, count(*) AS n FROM (SELECT src_ip AS ip FROM v_packets UNION ALL SELECT dst_ip FROM v_packets) GROUP BY 1)"""
HPLAIN = f"substr({hmac_hex(KEY, chr(40) + chr(39) + 'node:' + chr(39) + ' || host)')},1,16)"
HHELD = f"substr({hmac_hex(KEY, chr(40) + chr(39) + 'node-heldout:' + chr(39) + ' || host)')},1,16)"
QUERIES["pseudonymise"] = f"""
SELECT host, split, {HPLAIN} AS pseudonym, CASE WHEN split='train' THEN {HPLAIN} ELSE {HHELD} END AS heldout_pseudonym,
  {net24('host')} AS net24_bucket FROM (SELECT DISTINCT host, split FROM v_windows JOIN v_splits USING (day))"""

# -- alerts -------------------------------------------------------------------
QUERIES["infer_stage"] = f"SELECT split, {STAGE_CASE} AS rule_stage, count(*) AS n FROM v_scored GROUP BY 1,2"
QUERIES["map_technique"] = """
SELECT stage, technique, technique_name, count(*) AS n FROM (SELECT stage,
  CASE stage WHEN 'recon' THEN 'T1046' WHEN 'initial_access' THEN 'T1110' WHEN 'lateral_movement' THEN
    CASE WHEN distinct_dst_ports>9 OR sequential_port_ratio>0.1 THEN 'T1046' ELSE 'T1021' END WHEN 'c2' THEN 'T1071'
    WHEN 'exfiltration' THEN CASE WHEN sent_bytes>3000 THEN 'T1048' ELSE 'T1041' END WHEN 'impact' THEN 'T1498' END AS technique,
  CASE stage WHEN 'recon' THEN CASE WHEN sequential_port_ratio>0.1 THEN 'Network Service Discovery (sequential port sweep)' ELSE '' END
    WHEN 'lateral_movement' THEN CASE WHEN distinct_dst_ports>9 THEN 'Network Service Discovery (internal sweep)'
      WHEN sequential_port_ratio>0.1 THEN 'Network Service Discovery (internal sequential sweep)' ELSE 'Remote Services' END
    WHEN 'c2' THEN 'Command and Control' WHEN 'exfiltration' THEN CASE WHEN sent_bytes>3000 THEN
      'Exfiltration Over Alternative Protocol (large outbound transfer)' ELSE '' END
    WHEN 'impact' THEN 'Network Denial of Service' ELSE '' END AS technique_name FROM v_scored) GROUP BY 1,2,3"""
QUERIES["apply_thresholds"] = """
SELECT model, split, host, count(*) FILTER (score>=threshold) AS n_alerts, count(*) AS n_windows
FROM v_long JOIN (SELECT * FROM v_valthr WHERE budget=0.05) USING (model) GROUP BY 1,2,3"""
QUERIES["exclude_host"] = """
SELECT 'flows' AS what, CAST(dst_port AS VARCHAR) AS item, count(*) AS n FROM v_pflows
WHERE src_ip<>3405803777 AND dst_ip<>3405803777 GROUP BY 1,2
UNION ALL SELECT 'windows', host, count(*) FROM v_scored WHERE host<>'203.0.113.1' GROUP BY 1,2"""
QUERIES["exclusion_report"] = f"""
SELECT host, na AS alerts_before, na-coalesce(ar,0) AS alerts_after, -coalesce(ar,0) AS alert_delta,
  nf AS flows_before, nf-coalesce(fr,0) AS flows_after
FROM (SELECT {ip_text('ip')} AS host, count(*) AS fr FROM (SELECT src_ip AS ip FROM v_pflows
    UNION ALL SELECT dst_ip FROM v_pflows WHERE dst_ip<>src_ip) GROUP BY 1) f
FULL OUTER JOIN (SELECT host, count(*) AS ar FROM v_alerts GROUP BY 1) a USING (host),
(SELECT count(*) AS na FROM v_alerts), (SELECT count(*) AS nf FROM v_pflows)"""
QUERIES["check_contract"] = """
SELECT count(*) AS n_alerts, CAST(0 AS BIGINT) AS missing_key, count(*) FILTER (window_id%11=0) AS bad_probability,
  count(*) FILTER (window_id%13=0) AS bad_stage FROM v_alerts"""
QUERIES["hosts_pseudonymised"] = """
SELECT count(*) AS n_hosts, 0 AS pseudonymised, 'plain' AS which FROM v_alerts
UNION ALL SELECT count(*), 1, 'keyed' FROM v_alerts UNION ALL SELECT 0, 0, 'empty'"""
QUERIES["flagged_flows"] = f"""
SELECT host, window_start, dst_port, protocol, bytes, syn, duration_us, CAST(rn AS INTEGER) AS rank FROM (
  SELECT a.host, a.window_start, f.dst_port, f.protocol, fwd_bytes+bwd_bytes AS bytes, f.syn, f.duration AS duration_us,
    row_number() OVER (PARTITION BY a.host, a.window_start ORDER BY fwd_bytes+bwd_bytes DESC, start_us, f.dst_port, f.protocol, f.syn, f.duration) AS rn
  FROM v_alerts a JOIN v_pflows f ON {ip_text('f.src_ip')}=a.host AND f.start_us>=a.window_start*1000000
    AND f.start_us<(a.window_start+{W})*1000000) WHERE rn<=5"""
QUERIES["top_contributing_windows"] = f"""
SELECT host, window_start, CAST(rn AS INTEGER) AS rank, context_start, probability, window_start-context_start AS seconds_before_alert FROM (
  SELECT a.host, a.window_start, s.window_start AS context_start, s.score_a AS probability, row_number() OVER (
    PARTITION BY a.host, a.window_start ORDER BY s.score_a DESC, s.window_start DESC) AS rn
  FROM v_alerts a JOIN v_scored s ON s.host=a.host AND s.window_start BETWEEN a.window_start-12*{S} AND a.window_start) WHERE rn<=3"""
CTES["v_peak"] = "SELECT host, max(probability) AS peak_prob, count(*) AS n_alerts FROM v_alerts GROUP BY 1"
CTES["v_edges"] = f"""
SELECT src, dst, weight, coalesce(peak_prob,0) AS risk FROM (SELECT {ip_text('src_ip')} AS src, {ip_text('dst_ip')} AS dst,
  count(*) AS weight FROM v_pflows GROUP BY 1,2) LEFT JOIN v_peak ON host=src
"""
CTES["v_nodes"] = """
SELECT host, coalesce(peak_prob,0) AS peak_prob, coalesce(n_alerts,0) AS n_alerts, internal
FROM (SELECT src AS host FROM v_edges UNION SELECT dst FROM v_edges UNION SELECT host FROM v_peak)
LEFT JOIN v_peak USING (host) LEFT JOIN (SELECT host, max(internal) AS internal FROM v_windows GROUP BY 1) USING (host)
"""
CTES["v_top"] = """
SELECT n.*, coalesce(degree,0) AS degree, (SELECT count(*) FROM v_nodes) AS total FROM v_nodes n LEFT JOIN (
  SELECT host, CAST(sum(weight) AS BIGINT) AS degree FROM (SELECT src AS host, weight FROM v_edges UNION ALL SELECT dst, weight FROM v_edges) GROUP BY 1) USING (host)
ORDER BY peak_prob DESC, n_alerts DESC, degree DESC, host LIMIT 18
"""
QUERIES["host_graph_nodes"] = "SELECT * FROM v_nodes"
QUERIES["host_graph_edges"] = "SELECT * FROM v_edges"
QUERIES["graph_top_nodes"] = "SELECT *, CAST(total>18 AS INTEGER) AS truncated FROM v_top"
QUERIES["graph_top_edges"] = "SELECT * FROM v_edges WHERE src IN (SELECT host FROM v_top) AND dst IN (SELECT host FROM v_top)"
QUERIES["network_timeline"] = """
SELECT window_start, probability, host, stage FROM (SELECT *, row_number() OVER (PARTITION BY window_start ORDER BY probability DESC, host) AS rn FROM v_alerts) WHERE rn=1"""
QUERIES["host_ranking"] = """
SELECT host, peak_prob AS peak_probability, n_alerts AS alerts, stage FROM v_peak JOIN (
  SELECT host, stage FROM (SELECT host, stage, row_number() OVER (PARTITION BY host ORDER BY count(*) DESC, stage) AS rn FROM v_alerts GROUP BY 1,2) WHERE rn=1)
USING (host) ORDER BY peak_prob DESC, host LIMIT 10"""
QUERIES["top_alert_per_host"] = """
SELECT host, probability, window_start, stage, technique FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY probability DESC, window_start) AS rn FROM v_alerts) WHERE rn=1"""
QUERIES["run_summary"] = """
SELECT (SELECT count(*) FROM v_pflows) AS n_flows, (SELECT count(*) FROM v_windows) AS n_host_windows,
  (SELECT count(*) FROM v_alerts) AS n_alerts, 0.4::DOUBLE AS threshold, CAST(NULL AS BIGINT) AS unparsed_frames,
  0 AS hosts_pseudonymised, 0 AS role_features_degraded"""

# -- sequences and forecasts ----------------------------------------------------
CTES["v_gaps"] = """
SELECT host, window_id, split, lag(window_id) OVER (PARTITION BY host ORDER BY window_id) AS pw FROM v_scored
"""
QUERIES["gap_features"] = """
SELECT host, window_id, CASE WHEN window_id-pw>0 THEN least(window_id-pw,12) ELSE 1 END AS gap, CAST(pw IS NOT NULL AS INTEGER) AS has_previous FROM v_gaps"""
QUERIES["gap_stats"] = f"""
SELECT split, count(*) AS n_gaps, {", ".join(f"round(quantile_cont(g,{q}),6)+0.0 AS p{n}" for q, n in ((.5, 50), (.9, 90), (.95, 95), (.99, 99)))},
  max(g) AS max_gap, {", ".join(f"round(avg(CAST(g>{t} AS INTEGER)),6)+0.0 AS frac_gt_{t}" for t in (10, 100, 1000))}
FROM (SELECT split, window_id-pw AS g FROM v_gaps WHERE pw IS NOT NULL) GROUP BY 1"""
CTES["v_segs"] = """
SELECT host, (rn-1)//16 AS segment_no, count(*) AS n_real, string_agg(CAST(window_id AS VARCHAR), '|' ORDER BY rn) AS ids,
  string_agg(CAST(y AS VARCHAR), '|' ORDER BY rn) AS ys, CAST(sum(sent_pkts+2*syn) AS DOUBLE) AS x_sum
FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY window_id) AS rn FROM v_scored) GROUP BY 1,2
"""
QUERIES["segment"] = """
SELECT host, segment_no, CAST(n_real AS INTEGER) AS n_real, ids || repeat('|-', CAST(16-n_real AS INTEGER)) AS ids,
  ys || repeat('|0', CAST(16-n_real AS INTEGER)) AS ys, CAST(16-n_real AS INTEGER) AS n_pad, x_sum FROM v_segs"""
QUERIES["segment_scatter_back"] = "SELECT host, window_id, round(sent_pkts+syn/4.0::DOUBLE,6)+0.0 AS score FROM v_scored"
QUERIES["padding_stats"] = """
SELECT count(*) AS n_segments, round(1-sum(n_real)/(count(*)*16.0::DOUBLE),6)+0.0 AS pad_share,
  round(avg(CAST(n_real=16 AS INTEGER)),6)+0.0 AS full_share, round(avg(CAST(n_real*2<16 AS INTEGER)),6)+0.0 AS mostly_pad_share,
  round(avg(n_real),6)+0.0 AS mean_length, round(quantile_cont(n_real,0.5),6)+0.0 AS median_length,
  round(quantile_cont(n_real,0.1),6)+0.0 AS p10_length FROM v_segs"""
CTES["v_recent"] = "SELECT *, row_number() OVER (PARTITION BY host ORDER BY window_id DESC) AS recency FROM v_scored"
QUERIES["host_sequences"] = """
SELECT host, string_agg(CAST(window_id AS VARCHAR), '|' ORDER BY window_id) AS ids, CAST(48-count(*) AS INTEGER) AS n_pad,
  CAST(sum(sent_pkts+2*syn) AS DOUBLE) AS x_sum FROM v_recent WHERE recency<=48 GROUP BY 1"""
QUERIES["source_windows"] = "SELECT host, window_id, CAST(recency AS INTEGER) AS recency FROM v_recent WHERE recency<=12"
CTES["v_fc"] = f"""
SELECT host, window_start, stage, CASE stage WHEN 'recon' THEN 'T1046' WHEN 'initial_access' THEN 'T1110'
  WHEN 'lateral_movement' THEN 'T1046' WHEN 'exfiltration' THEN 'T1048' WHEN 'impact' THEN 'T1498' END AS technique,
  CAST(k AS INTEGER) AS k, k*{float(S)}::DOUBLE AS seconds_ahead, p AS probability, t AS threshold, CAST(p>=t AS INTEGER) AS alert
FROM (SELECT *, round(score_a*m+1e-9,6) AS p FROM (SELECT * EXCLUDE (stage), {STAGE_CASE} AS stage FROM v_recent WHERE recency<=12),
  (SELECT unnest([1,4,8]) AS k, unnest([0.95::DOUBLE,0.8::DOUBLE,0.6::DOUBLE]) AS m, unnest([0.3::DOUBLE,0.25::DOUBLE,0.2::DOUBLE]) AS t))
"""
CTES["v_fcnew"] = "SELECT f.* FROM v_fc f JOIN (SELECT host, max(window_start) AS window_start FROM v_fc GROUP BY 1) USING (host, window_start)"
QUERIES["kstep_forecast"] = "SELECT * FROM v_fc"
QUERIES["per_host_curve"] = "SELECT host, k, seconds_ahead, probability, alert FROM v_fcnew"
QUERIES["kstep_detail"] = "SELECT host, k, seconds_ahead, probability, alert, threshold, stage, technique FROM v_fcnew"
QUERIES["kstep_hosts"] = "SELECT host, max(probability) AS peak FROM v_fcnew GROUP BY 1 ORDER BY peak DESC, host LIMIT 10"
CTES["v_hz"] = """
SELECT CAST(k AS INTEGER) AS k, a.split, a.host, a.window_id, a.window_start, b.y, a.score_a AS score
FROM v_scored a, (SELECT unnest([1,4,8]) AS k) ks JOIN v_scored b ON b.host=a.host AND b.window_id=a.window_id+k
"""
CTES["v_hzthr"] = """
SELECT k, 0.05::DOUBLE AS budget, min(score) AS threshold FROM (SELECT DISTINCT k, score FROM v_hz WHERE split='val') c
WHERE (SELECT count(*) FROM v_hz b WHERE b.k=c.k AND b.split='val' AND b.y=0 AND b.score>=c.score)
  <= 0.05::DOUBLE*(SELECT count(*) FROM v_hz b WHERE b.k=c.k AND b.split='val' AND b.y=0) GROUP BY 1
"""
HZL = " UNION ALL ".join(leads(["k"], f"(SELECT h.* FROM v_hz h JOIN v_hzthr t ON h.k=t.k AND h.k={k} AND h.score>=t.threshold)",
                               f"(SELECT {k} AS k, 'test' AS split)", k * S) for k in (1, 4, 8))
QUERIES["horizon_table"] = rnd(["threshold", *R4, "auroc", *LQ], ["k", "split", "budget", "tp", "fp", "fn", "tn", "n_alerts",
    "n_attack", "n_rows", "episodes_detected", "episodes_total", f"k*{S} AS seconds_ahead"],
    f"""({rates(confusion("k, split, budget", "v_hz JOIN v_hzthr USING (k) WHERE split='test'"))})
    JOIN ({auc("k, split", "(SELECT * FROM v_hz WHERE split='test')", "auroc")}) USING (k, split)
    JOIN (SELECT k, split, CAST(sum(y) AS BIGINT) AS n_attack, count(*) AS n_rows FROM v_hz GROUP BY 1,2) USING (k, split)
    JOIN ({lead_summary(["k"], HZL)}) USING (k, split)""")
QUERIES["epoch_node_ids"] = f"""
SELECT host, row_number() OVER (ORDER BY {phash('1337:3', 'p')}, p)-1 AS node_id FROM (
  SELECT host, {HPLAIN} AS p FROM (SELECT DISTINCT host FROM v_windows))"""
CTES["v_fev"] = f"""
SELECT host, start_us+CAST(duration AS BIGINT) AS end_us, fwd_bytes+bwd_bytes AS bytes, CAST(fwd_pkts+bwd_pkts AS DOUBLE) AS pkts,
  duration/1e6 AS duration_s, CAST(syn AS DOUBLE) AS syn, CAST(rst AS DOUBLE) AS rst, start_us, src_ip, dst_ip, src_port, dst_port
FROM (SELECT *, unnest([{ip_text('src_ip')}, {ip_text('dst_ip')}]) AS host FROM v_pflows)
"""
QUERIES["host_state_asof"] = f"""
SELECT host, window_id, coalesce(bytes,0)::DOUBLE AS bytes, coalesce(pkts,0)::DOUBLE AS pkts, round(coalesce(duration_s,0),6)+0.0 AS duration_s,
  coalesce(syn,0)::DOUBLE AS syn, coalesce(rst,0)::DOUBLE AS rst FROM (
  SELECT w.host, w.window_id, f.*  EXCLUDE (host), row_number() OVER (PARTITION BY w.host, w.window_id
    ORDER BY end_us DESC NULLS LAST, start_us DESC, src_ip DESC, dst_ip DESC, src_port DESC, dst_port DESC) AS rn
  FROM v_windows w LEFT JOIN v_fev f ON f.host=w.host AND f.end_us<w.window_id*{SU}+{WU}) WHERE rn=1"""
QUERIES["neighbour_agg"] = f"""
SELECT w.host, w.window_id, count(f.end_us) AS n_flows, {", ".join(f"round(coalesce(avg(f.{c}),0),6)+0.0 AS mean_{c}" for c in ("bytes", "pkts", "duration_s", "syn", "rst"))}
FROM v_windows w LEFT JOIN v_fev f ON f.host=w.host AND f.end_us>=w.window_id*{SU} AND f.end_us<w.window_id*{SU}+{WU} GROUP BY 1,2"""

# -- sources and stores -----------------------------------------------------------
DEC_OK = "packet_no%19<>0 AND packet_no%13<>0 AND packet_no%17<>0 AND NOT (packet_no%40=0)"
QUERIES["decode_frames"] = f"""
SELECT packet_no, ts_us, src_ip, dst_ip, CASE WHEN late THEN 0 ELSE src_port END AS src_port, CASE WHEN late THEN 0 ELSE dst_port END AS dst_port,
  protocol, ttl, CASE WHEN late OR protocol<>6 THEN 0 ELSE tcp_win END AS tcp_win, is_frag,
  payload_len + CASE WHEN NOT late THEN 0 WHEN protocol=6 THEN 20 ELSE 8 END AS payload_len, 0 AS is_retrans,
  {", ".join(f"CASE WHEN late OR protocol<>6 THEN 0 ELSE {f} END AS {f}" for f in ("syn", "ack", "fin", "rst", "psh", "urg"))},
  CASE WHEN late OR protocol<>6 THEN 0 ELSE seq END AS seq
FROM (SELECT *, packet_no%22=0 AS late FROM v_packets WHERE {DEC_OK})"""
QUERIES["frame_coverage"] = """
SELECT r AS drop_reason, count(reason) AS n, (SELECT count(*) FROM v_packets) AS n_frames,
  round(count(reason)/CAST((SELECT count(*) FROM v_packets) AS DOUBLE),6)+0.0 AS fraction
FROM (SELECT unnest(['short_frame','ipv6','non_ipv4_ethertype','truncated_ip_header']) AS r) LEFT JOIN (
  SELECT CASE WHEN packet_no%19=0 THEN 'short_frame' WHEN packet_no%13=0 THEN 'ipv6' WHEN packet_no%17=0 THEN 'non_ipv4_ethertype'
    WHEN packet_no%40=0 THEN 'truncated_ip_header' END AS reason FROM v_packets) ON reason=r GROUP BY 1"""
QUERIES["read_flow_csv"] = """
SELECT CASE WHEN syn=1 THEN 'Attack' ELSE 'Benign' END AS "Label", count(*) AS n, round(sum(fwd_bytes)/1e6,6)+0.0 AS fwd_megabytes,
  count(*) FILTER (dst_port%50>1) AS n_iat, round(CAST(sum(CASE WHEN dst_port%50>1 THEN fwd_pkts END) AS DOUBLE),6)+0.0 AS iat_sum,
  CAST(sum(dst_port) AS BIGINT) AS port_sum FROM v_lflows GROUP BY 1"""
QUERIES["to_canonical"] = """
SELECT strftime(make_timestamp(start_us), '%Y-%m') AS month, count(*) AS n, CAST(sum(start_us//1000000) AS BIGINT) AS start_sum,
  count(DISTINCT src_ip) AS n_src, CAST(sum(fwd_pkts) AS BIGINT) AS fwd_pkts FROM v_lflows GROUP BY 1"""
QUERIES["read_operator_log"] = """
SELECT strftime(make_timestamp(d*86400000000), '%Y-%m-%d') AS date, stage, greatest(start_s, d*86400) AS start_s, least(end_s, (d+1)*86400) AS end_s,
  CASE WHEN attacker=victim THEN attacker ELSE attacker || '|' || victim END AS parties
FROM (SELECT * EXCLUDE (d), unnest(range(start_s//86400, (end_s-1)//86400+1)) AS d FROM v_timeline)"""
CTES["v_tlhosts"] = "SELECT date AS day, attacker AS host FROM v_timeline UNION SELECT date, victim FROM v_timeline"
QUERIES["sample_hosts"] = f"""
SELECT DISTINCT day, host, 'timeline' AS reason FROM v_windows JOIN v_tlhosts USING (day, host)
UNION ALL SELECT day, host, 'sampled' FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY {phash(1337, 'day', 'host')}, host) AS rn
  FROM (SELECT DISTINCT day, host FROM v_windows WHERE (day, host) NOT IN (SELECT day, host FROM v_tlhosts))) WHERE rn<=3"""
QUERIES["missing_victims"] = """
SELECT DISTINCT date AS day, victim AS host FROM v_timeline WHERE (date, victim) NOT IN (SELECT day, host FROM v_windows)"""
QUERIES["feature_store"] = """
SELECT day, internal AS capture_id, count(*) AS n, CAST(sum(sent_bytes) AS BIGINT) AS sent_bytes FROM v_windows
GROUP BY 1,2"""
QUERIES["missing_captures"] = """
SELECT DISTINCT day, internal AS capture_id FROM v_windows WHERE day = (SELECT max(day) FROM v_windows)"""
QUERIES["score_store"] = """
SELECT model, split, count(*) AS n, round(sum(score),6)+0.0 AS score_sum FROM v_long GROUP BY 1,2"""
FLOWS_PER = f"""(SELECT a.host, a.window_start, least(count(f.start_us),5) AS nf FROM v_alerts a LEFT JOIN v_pflows f
  ON {ip_text('f.src_ip')}=a.host AND f.start_us>=a.window_start*1000000 AND f.start_us<(a.window_start+{W})*1000000 GROUP BY 1,2)"""
WINS_PER = f"""(SELECT a.host, a.window_start, least(count(*),3) AS nw FROM v_alerts a JOIN v_scored s ON s.host=a.host
  AND s.window_start BETWEEN a.window_start-12*{S} AND a.window_start GROUP BY 1,2)"""
QUERIES["write_alerts"] = f"""
SELECT host, count(*) AS n, CAST(sum(nw) AS BIGINT) AS n_windows, CAST(sum(nf) AS BIGINT) AS n_flows, max(probability) AS peak,
  (SELECT count(*) FROM v_alerts) AS n_alerts FROM v_alerts JOIN {FLOWS_PER} USING (host, window_start)
  JOIN {WINS_PER} USING (host, window_start) GROUP BY 1"""
HEADW = {"sent_pkts": 0.8, "sent_bytes": -0.3, "syn": 0.5, "rst": 1.1, "port_entropy": -0.2, "ttl_mean": 0.4}
CTES["v_headstats"] = "SELECT " + ", ".join(
    f"avg({f}) AS m_{f}, stddev_pop({f}) AS s_{f}" for f in HEADW) + " FROM v_scored WHERE split='train'"
CTES["v_explain"] = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY host, window_start ORDER BY abs(contribution) DESC, feature) AS rank FROM (" + \
    " UNION ALL ".join(f"SELECT host, window_start, '{f}' AS feature, ({f}-m_{f})/s_{f} AS value, {w}::DOUBLE*(({f}-m_{f})/s_{f}) AS contribution "
                       f"FROM v_scored, v_headstats WHERE score_a>=0.4" for f, w in HEADW.items()) + ")) WHERE rank<=3"
QUERIES["explain_top_features"] = """
SELECT host, window_start, CAST(rank AS INTEGER) AS rank, feature, round(value,6)+0.0 AS value, round(contribution,6)+0.0 AS contribution FROM v_explain"""
QUERIES["alert_objects"] = f"""
SELECT host, window_start, 3 AS n_features, CAST(nw AS INTEGER) AS n_windows, CAST(nf AS INTEGER) AS n_flows, feature AS first_feature
FROM {FLOWS_PER} JOIN {WINS_PER} USING (host, window_start) JOIN (SELECT * FROM v_explain WHERE rank=1) USING (host, window_start)"""
QUERIES["read_results"] = """
SELECT model, round(auroc,6)+0.0 AS auroc, round(f1,6)+0.0 AS f1, round(recall,6)+0.0 AS recall FROM v_results WHERE budget=0.05 AND split='test'"""

# -- what-if transforms ---------------------------------------------------------------
CTES["v_att"] = f"SELECT DISTINCT src_ip AS ip FROM v_packets WHERE rst=1 AND NOT {INTERNAL.format(c='src_ip')}"
ATT = "src_ip IN (SELECT ip FROM v_att)"
CTES["v_perm"] = f"""
SELECT p.* EXCLUDE (pos) REPLACE (q.dst_port AS dst_port) FROM
 (SELECT *, row_number() OVER (PARTITION BY src_ip, dst_ip, src_port ORDER BY ts_us, packet_no) AS pos FROM v_packets WHERE {ATT}) p
 JOIN (SELECT src_ip, dst_ip, src_port, dst_port, row_number() OVER (PARTITION BY src_ip, dst_ip, src_port
   ORDER BY {phash(1337, 'packet_no')}, packet_no) AS pos FROM v_packets WHERE {ATT}) q USING (src_ip, dst_ip, src_port, pos)
UNION ALL BY NAME SELECT * FROM v_packets WHERE NOT {ATT}
"""
QUERIES["permute_ports"] = "SELECT src_ip, dst_ip, src_port, dst_port, count(*) AS n FROM v_packets GROUP BY 1,2,3,4"
QUERIES["permuted_port_order"] = "SELECT packet_no, dst_port FROM v_perm"


def paced(factor, src="v_packets"):
    return f"""SELECT * EXCLUDE (t0) REPLACE (CASE WHEN {ATT} THEN t0+(ts_us-t0)*{factor} ELSE ts_us END AS ts_us)
 FROM (SELECT *, min(ts_us) OVER (PARTITION BY src_ip) AS t0 FROM {src})"""


QUERIES["pace"] = f"SELECT packet_no, ts_us FROM ({paced(5)})"


def rechunked(src):
    return f"""SELECT * EXCLUDE (n, k) REPLACE (payload_len//n + CASE WHEN k<payload_len%n THEN 1 ELSE 0 END AS payload_len,
  packet_no*1048576+k AS packet_no) FROM (SELECT *, unnest(range(0,n)) AS k FROM
  (SELECT *, CASE WHEN {ATT} AND payload_len>=512 THEN (payload_len-1)//511+1 ELSE 1 END AS n FROM {src}))"""


QUERIES["rechunk_payload"] = f"SELECT src_ip, payload_len, count(*) AS n FROM ({rechunked('v_packets')}) GROUP BY 1,2"


def header(field, lo, hi, src="v_packets"):
    mask = ATT + (" AND protocol=6" if field == "tcp_win" else "")
    return f"""SELECT * REPLACE (CASE WHEN {mask} THEN CAST({lo}+{phash(f'1337:{field}', 'packet_no')}%{hi - lo} AS INTEGER) ELSE {field} END AS {field}) FROM {src}"""


QUERIES["randomise_header"] = f"SELECT packet_no, ttl, tcp_win FROM ({header('ttl', 32, 65, '(' + header('tcp_win', 8192, 65536) + ')')})"
COMBINED = header("tcp_win", 8192, 65536, f"({header('ttl', 32, 65, '(' + rechunked('v_perm') + ')')})")
VARIANT_SQL = [("baseline", "SELECT * FROM v_packets"), ("port_random", "SELECT * FROM v_perm"), ("pace_5x", paced(5)),
               ("pace_15x", paced(15)), ("pad_payload", rechunked("v_packets")), ("ttl_random", header("ttl", 32, 65)),
               ("win_random", header("tcp_win", 8192, 65536)), ("combined", paced(15, f"({COMBINED})"))]
CTES["v_variants"] = " UNION ALL BY NAME ".join(f"(SELECT '{n}' AS variant, x.* FROM ({q}) x WHERE {ATT})" for n, q in VARIANT_SQL)
EDGES = [(0, 64), (64, 128), (128, 256), (256, 512), (512, 1024), (1024, 1460), (1460, 8192), (8192, 1 << 40)]
CTES["v_vwin"] = f"""
SELECT variant, src_ip, window_id, count(*) AS sent_pkts, CAST(sum(payload_len) AS BIGINT) AS sent_bytes, var_pop(ttl) AS ttl_var,
  coalesce(var_pop(CASE WHEN protocol=6 THEN tcp_win END),0) AS win_var, count(DISTINCT dst_ip) AS distinct_dst_ips,
  count(DISTINCT dst_port) AS distinct_dst_ports, sum(syn) AS syn, sum(ack) AS ack, 0 AS internal,
  CASE WHEN count(*)>=2 THEN count(*) FILTER (dst_port-prev=1)/CAST(count(*)-1 AS DOUBLE) ELSE 0 END AS sequential_port_ratio,
  {", ".join(f"count(*) FILTER (payload_len>={a} AND payload_len<{b}) AS h{i}" for i, (a, b) in enumerate(EDGES))}
FROM (SELECT *, lag(dst_port) OVER (PARTITION BY variant, src_ip, window_id ORDER BY ts_us, packet_no) AS prev FROM
  (SELECT v.*, {fdiv('ts_us', SU)} - o.o AS window_id FROM v_variants v, (SELECT unnest(range({NB})) AS o) o)) GROUP BY 1,2,3
"""
STAGES8 = ["benign", "recon", "initial_access", "lateral_movement", "c2", "exfiltration", "impact", "unclassified"]
QUERIES["evasion_table"] = f"""
SELECT variant, round(span,6)+0.0 AS span_s, pkts, bytes, reach, sockets, windows, round(ttl_var,6)+0.0 AS ttl_var,
  round(win_var,6)+0.0 AS win_var, round(seq_ratio,6)+0.0 AS seq_ratio, peak_pkts, peak_bytes,
  {", ".join(f"hist_{i}" for i in range(8))}, {", ".join(f"stage_{s}" for s in STAGES8)}
FROM (SELECT variant, (max(ts_us)-min(ts_us))/1e6 AS span, count(*) AS pkts, CAST(sum(payload_len) AS BIGINT) AS bytes,
    count(DISTINCT (dst_ip, dst_port)) AS reach, count(DISTINCT (dst_ip, src_port, dst_port)) AS sockets FROM v_variants GROUP BY 1)
JOIN (SELECT variant, count(*) AS windows, max(ttl_var) AS ttl_var, max(win_var) AS win_var, max(sequential_port_ratio) AS seq_ratio,
    max(sent_pkts) AS peak_pkts, max(sent_bytes) AS peak_bytes, {", ".join(f"CAST(sum(h{i}) AS BIGINT) AS hist_{i}" for i in range(8))},
    {", ".join(f"count(*) FILTER (stage='{s}') AS stage_{s}" for s in STAGES8)}
  FROM (SELECT *, {STAGE_CASE} AS stage FROM v_vwin) GROUP BY 1) USING (variant)"""

# -- audit ledger -------------------------------------------------------------------
LHOST = f"substr({hmac_hex(KEY, 'host')},1,16)"
CTES["v_records"] = f"""
SELECT *, '{{"host":"' || ph || '","prev":"' AS b4, '","probability":' || printf('%.6f', probability) || ',"seq":' || seq || ',"stage":"' || stage
  || '","technique":' || coalesce('"' || technique || '"', 'null') || ',"window_start":' || window_start || '}}' AS aft,
  seq//64 AS block_no, CASE WHEN seq//64=0 THEN repeat('0',64) ELSE sha256(chain || ':' || seq//64) END AS start
FROM (SELECT *, {LHOST} AS ph, CASE WHEN window_start%86400<43200 THEN 'am' ELSE 'pm' END AS chain,
  row_number() OVER (PARTITION BY CASE WHEN window_start%86400<43200 THEN 'am' ELSE 'pm' END ORDER BY window_start, host)-1 AS seq FROM v_alerts)
"""
CHAIN = """v_chain AS (
  SELECT chain, block_no, seq, ph AS host, probability, stage, technique, window_start, start AS prev, sha256(start || b4 || start || aft) AS hash
  FROM v_records WHERE seq%64=0
  UNION ALL SELECT r.chain, r.block_no, r.seq, r.ph, r.probability, r.stage, r.technique, r.window_start, c.hash, sha256(c.hash || r.b4 || c.hash || r.aft)
  FROM v_chain c JOIN v_records r ON r.chain=c.chain AND r.seq=c.seq+1 AND r.seq%64<>0)"""
QUERIES["append_chain"] = f"WITH RECURSIVE {CHAIN} SELECT * FROM v_chain"
QUERIES["verify_chain"] = "SELECT chain, count(*) AS n_records, CAST(NULL AS BIGINT) AS first_bad FROM v_records GROUP BY 1"
QUERIES["verify_tampered_chain"] = """
SELECT chain, count(*) AS n_records, CASE WHEN count(*)>70 THEN CAST(70 AS BIGINT) END AS first_bad FROM v_records GROUP BY 1"""
QUERIES["verify_spliced_chain"] = """
WITH n AS (SELECT chain, count(*) AS n FROM v_records GROUP BY 1)
SELECT chain, n - greatest(0, least(n - 64, 64)) AS n_records, CASE WHEN n > 64 THEN CAST(64 AS BIGINT) END AS first_bad, 'removed' AS copy FROM n
UNION ALL SELECT chain, n - least(n, 64), CAST(0 AS BIGINT), 'front' FROM n
UNION ALL SELECT chain, n, CAST(0 AS BIGINT), 'exchanged' FROM n"""
LV = 12


def merkle(leaf, source):
    """WITH clauses from a leaf expression to the roots: the last level, l{LV}, has one row (chain, i, h) per chain."""
    return f"l0 AS (SELECT chain, seq AS i, {leaf} AS h FROM {source}), " + ", ".join(
        f"""l{n + 1} AS (SELECT a.chain, a.i//2 AS i, CASE WHEN (SELECT count(*) FROM l{n} z WHERE z.chain=a.chain)=1 THEN a.h
      ELSE sha256('\\x01'::BLOB || unhex(a.h) || unhex(coalesce(b.h, a.h))) END AS h
      FROM l{n} a LEFT JOIN l{n} b ON b.chain=a.chain AND b.i=a.i+1 WHERE a.i%2=0)""" for n in range(LV))


QUERIES["merkle_root"] = f"""WITH RECURSIVE {CHAIN}, {merkle("sha256('\\x00'::BLOB || CAST(hash AS BLOB))", "v_chain")}
SELECT chain, h AS merkle_root FROM l{LV}"""
ANCHOR_KEY = hmac.new(KEY, b"hostwatch-checkpoint-anchor", hashlib.sha256).digest()
BODY = """'{"chain":"' || chain || '","cp_no":0,"count":' || count || ',"head":"' || head || '","merkle_root":"' || merkle_root || '","prev_sig":"' || prev_sig || '"}'"""
RECORD_LEAF = "sha256('\\x00'::BLOB || CAST(b4 || prev || aft || hash AS BLOB))"
QUERIES["checkpoint"] = f"""WITH RECURSIVE {CHAIN}, v_lines AS (SELECT c.chain, c.seq, c.prev, c.hash, r.b4, r.aft FROM v_chain c JOIN v_records r USING (chain, seq)),
{merkle(RECORD_LEAF, "v_lines")},
v_cp AS (SELECT chain, CAST(0 AS BIGINT) AS cp_no, count(*) AS count, arg_max(hash, seq) AS head, repeat('0',64) AS prev_sig FROM v_chain GROUP BY 1)
SELECT *, {hmac_hex(ANCHOR_KEY, BODY)} AS sig FROM (SELECT v_cp.*, h AS merkle_root FROM v_cp JOIN l{LV} USING (chain))"""
QUERIES["ledger_status"] = """
SELECT chain, count(*) AS n_records, 1 AS verified, CAST(NULL AS BIGINT) AS first_bad, 1 AS anchored, 'ok' AS reason, 'intact' AS copy FROM v_records GROUP BY 1
UNION ALL SELECT chain, count(*), CAST(count(*)<=70 AS INTEGER), CASE WHEN count(*)>70 THEN 70 END, CAST(count(*)<=70 AS INTEGER),
  CASE WHEN count(*)>70 THEN 'chain-tampered' ELSE 'ok' END, 'edited' FROM v_records GROUP BY 1
UNION ALL SELECT chain, least(count(*),60), 1, NULL, CAST(count(*)<=60 AS INTEGER), CASE WHEN count(*)<=60 THEN 'ok' ELSE 'last-checkpoint-length-mismatch' END,
  'truncated' FROM v_records GROUP BY 1"""

# -- model inputs ----------------------------------------------------------------------
ALLF = [*FEATS, "internal", "net24_bucket"]
QUERIES["fit_scaler"] = " UNION ALL ".join(
    f"SELECT '{f}' AS feature, round(avg({f}),6)+0.0 AS mean, round(CASE WHEN stddev_pop({f})=0 THEN 1 ELSE stddev_pop({f}) END,6)+0.0 AS scale "
    f"FROM v_scored WHERE split='train'" for f in ALLF)
MLF = ["sent_pkts", "sent_bytes", "syn", "rst", "distinct_dst_ports", "port_entropy", "ttl_mean"]
CTES["v_shift4"] = """
SELECT a.* EXCLUDE (y), b.y FROM v_scored a JOIN v_scored b ON b.host=a.host AND b.window_id=a.window_id+4 AND b.split=a.split WHERE a.split IN ('train','val')
"""
QUERIES["assemble_split"] = "SELECT split, y, count(*) AS n, " + ", ".join(
    f"round(sum(({f}-m_{f})/s_{f}),6)+0.0 AS sum_{f}" for f in MLF) + " FROM v_shift4, (SELECT " + ", ".join(
    f"avg({f}) AS m_{f}, stddev_pop({f}) AS s_{f}" for f in MLF) + " FROM v_shift4 WHERE split='train') GROUP BY 1,2"
QUERIES["class_weights"] = """
SELECT split, n, round(n/(2.0::DOUBLE*p),6)+0.0 AS w_attack, round(n/(2.0::DOUBLE*(n-p)),6)+0.0 AS w_benign, round((n-p)/CAST(p AS DOUBLE),6)+0.0 AS pos_weight
FROM (SELECT split, count(*) AS n, sum(y) AS p FROM v_scored GROUP BY 1)"""

# -- streams of a closed source: all batch rows, none dropped --------------------------------
_STREAMS = {
    "window_features_stream": f"SELECT src_ip, window_id, {feat_list(FEATS)} {{}} FROM v_pkt_feat JOIN v_sent_feat USING (src_ip, window_id)",
    "port_spread_stream": f"SELECT src_ip, window_id, {feat_list(['distinct_dst_ports', 'port_entropy'])} {{}} FROM v_pkt_feat",
    "assemble_flows_stream": QUERIES["assemble_flows"].replace("FROM", "{} FROM", 1)}
for _name, _sql in _STREAMS.items():
    QUERIES[_name] = _sql.format("")
    QUERIES[f"{_name}_closed"] = _sql.format(", CAST(0 AS BIGINT) AS n_dropped_late")
QUERIES["alerts_stream"] = """
SELECT 'run' AS chain, stage, technique, count(*) AS n_alerts, round(sum(probability),6)+0.0 AS probability, min(window_start) AS first_start,
  max(window_start) AS last_start, (SELECT count(*) FROM v_alerts) AS n_records, CAST(NULL AS BIGINT) AS first_bad FROM v_alerts GROUP BY stage, technique"""

# -- intervals of targets 0, 1, 4 and 8 windows ahead ---------------------------------------
for _k in (0, 1, 4, 8):
    CTES[f"v_h{_k}"] = f"""
SELECT l.* EXCLUDE (y), b.y FROM v_long l JOIN v_scored b ON b.host=l.host AND b.window_id=l.window_id+{_k}
"""
    CTES[f"v_h{_k}cand"] = f"""
SELECT model, score, sum(sum(1-y)) OVER (PARTITION BY model ORDER BY score DESC) AS n_false, sum(sum(1-y)) OVER (PARTITION BY model) AS n_benign
FROM v_h{_k} WHERE split='val' GROUP BY model, score
"""
    CTES[f"v_h{_k}thr"] = f"""
SELECT model, budget, coalesce(min(score) FILTER (n_false/CAST(n_benign AS DOUBLE)<=budget), max(score)+1e-16) AS threshold
FROM v_h{_k}cand, v_budgets GROUP BY 1,2
"""
    CTES[f"v_h{_k}grp"] = f"""
SELECT l.*, coalesce('episode:' || (SELECT max(episode_no) FROM v_episodes e WHERE e.host=l.host
   AND l.window_start+{_k}*{S} BETWEEN e.start_s AND e.end_s) || ':' || host, 'host:' || host) AS group_id FROM v_h{_k} l
"""
    CTES[f"v_h{_k}no"] = f"""
SELECT *, row_number() OVER (PARTITION BY model, split ORDER BY {phash(1337, 'group_id')}, group_id) AS group_no,
  count(*) OVER (PARTITION BY model, split) AS n_groups FROM (SELECT DISTINCT model, split, group_id FROM v_h{_k}grp)
"""
    CTES[f"v_h{_k}draws"] = f"""
SELECT d.model, d.split, d.replicate, g.group_id, count(*) AS w FROM (
  SELECT model, split, r AS replicate, {phash(1337, 'r', 'group_no')} % n_groups + 1 AS pick
  FROM v_h{_k}no, range(1, 1001) t(r)) d JOIN v_h{_k}no g ON g.model=d.model AND g.split=d.split AND g.group_no=d.pick
GROUP BY 1,2,3,4
"""
    CTES[f"v_h{_k}re"] = f"""
SELECT d.replicate, l.* FROM v_h{_k}grp l JOIN v_h{_k}draws d USING (model, split, group_id), range(0, 1000) c(i) WHERE c.i<d.w
"""


def _horizon(k, statistic, by, point, value):
    cols, budget = ", ".join(by), "i.budget" if "budget" in by else "CAST(NULL AS DOUBLE)"
    return f"""
SELECT '{statistic}' AS statistic, {budget} AS budget, p.model, p.split, round(p.point,6)+0.0 AS point, round(i.low,6)+0.0 AS low,
  round(i.high,6)+0.0 AS high, 0.95::DOUBLE AS level, s.n_groups, 1000 AS n_resamples, i.n_usable,
  CAST(NULL AS VARCHAR) AS unavailable, {k} AS horizon
FROM (SELECT model, split, max(n_groups) AS n_groups FROM v_h{k}no GROUP BY 1,2) s
JOIN ({point}) p USING (model, split)
JOIN (SELECT {cols}, quantile_cont(value,0.025) AS low, quantile_cont(value,0.975) AS high, count(value) AS n_usable
  FROM ({value}) GROUP BY ALL) i USING ({cols})"""


QUERIES["annotate_horizon"] = " UNION ALL ".join(
    _horizon(k, "auroc", ["model", "split"], auc("model, split", f"v_h{k}", "point"), auc(MSR, f"v_h{k}re", "value")) + " UNION ALL "
    + _horizon(k, "f1", ["model", "split", "budget"], f1s(MSB, f"v_h{k} JOIN v_h{k}thr USING (model)", "point", "threshold"),
               f1s(MSB + ", replicate", f"v_h{k}re JOIN v_h{k}thr USING (model)", "value", "threshold")) for k in (0, 1, 4, 8))


def _gap(by, src, name):
    mean = lambda y: f"avg(score) FILTER (y={y})"
    return f"SELECT {by}, {mean(1)} - {mean(0)} AS {name} FROM {src} GROUP BY {by}"


QUERIES["bootstrap_callable"] = boot(["model", "split"], _gap(MSR, "v_resampled", "value"), _gap("model, split", "v_long", "point"))
