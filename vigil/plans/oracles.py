"""SQL that gives the queries' rows on the same tables."""

from __future__ import annotations

import ipaddress

from vigil.plans.driver_data import ALLOWED, ANOMALOUS, COUNTRIES, INTEL

_EV = """ev AS (SELECT event_id, user_id, value, CASE event_type WHEN 'error' THEN 'failed_login' WHEN 'click' THEN 'connection' WHEN 'view' THEN 'http_404' WHEN 'signup' THEN 'successful_login' ELSE 'http_request' END AS event_type,
 ts AS event_time, CASE user_id % 4 WHEN 0 THEN '10.0.' || (user_id // 256) || '.' || (user_id % 256) WHEN 1 THEN '45.33.' || (user_id // 256) || '.' || (user_id % 256) WHEN 2 THEN '185.220.' || (100 + user_id // 256) || '.' || (user_id % 256) ELSE '2001:db8::' || printf('%x', user_id) END AS source_ip,
 'u' || (event_id % 7) AS username, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS port, (CASE WHEN event_id % 3 = 0 THEN 'invalid user ' ELSE 'user ' END) || 'u' || (event_id % 7) AS raw_line, 'file' || (event_id % 3) AS source_file, 'h' || (event_id % 11) AS hostname FROM events)"""


def _rule(name: str, where: str, count: str, least: int = 3, keys: str = "source_ip") -> str:
    return f"""{name}_w AS (SELECT {keys}, event_time, {count} OVER w AS c, max(event_time) OVER w AS l FROM ev WHERE {where} WINDOW w AS (PARTITION BY {keys} ORDER BY event_time RANGE BETWEEN CURRENT ROW AND INTERVAL 1440 MINUTE FOLLOWING)),
 {name} AS (SELECT {keys}, min(event_time) AS first_seen, arg_min(l, event_time) AS last_seen, CAST(arg_min(c, event_time) AS INTEGER) AS event_count FROM {name}_w WHERE c >= {least} GROUP BY {keys})"""


def _rules(suffix: str = "", least: int = 3, keys: str = "source_ip") -> str:
    return ",\n ".join([_rule("brute" + suffix, "event_type = 'failed_login'", "count(*)", least, keys), _rule("scan" + suffix, "event_type = 'connection' AND port <> 0", "count(DISTINCT port)", least, keys), _rule("flood" + suffix, "event_type = 'http_404'", "count(*)", least, keys)])


def _incidents(suffix: str = "") -> str:
    return f"""inc{suffix}_raw AS (SELECT 'brute_force' AS incident_type, * FROM brute{suffix} UNION ALL SELECT 'port_scan', * FROM scan{suffix} UNION ALL SELECT 'flood_404', * FROM flood{suffix}),
 inc{suffix} AS (SELECT *, CASE WHEN (incident_type = 'brute_force' AND event_count >= 100) OR (incident_type = 'port_scan' AND event_count >= 500) OR (incident_type = 'flood_404' AND event_count >= 200) THEN 'CRITICAL' WHEN (incident_type = 'brute_force' AND event_count >= 30) OR event_count >= 100 THEN 'HIGH' WHEN (incident_type = 'brute_force' AND event_count >= 10) OR event_count >= 50 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
 CASE incident_type WHEN 'brute_force' THEN 'T1110.001' WHEN 'port_scan' THEN 'T1046' ELSE 'T1595.002' END AS mitre_id,
 CASE incident_type WHEN 'brute_force' THEN 'Brute Force: Password Guessing' WHEN 'port_scan' THEN 'Network Service Discovery' ELSE 'Active Scanning: Vulnerability Scanning' END AS mitre_name,
 CASE incident_type WHEN 'brute_force' THEN 'Credential Access' WHEN 'port_scan' THEN 'Discovery' ELSE 'Reconnaissance' END AS mitre_tactic,
 CASE incident_type WHEN 'brute_force' THEN 0 WHEN 'port_scan' THEN 1 ELSE 2 END AS type_rank FROM inc{suffix}_raw)"""


def _nets(name: str, entries) -> str:
    """Ranges of networks: version 4 numbers, or version 6 offsets from 2001:db8::."""
    base, rows = int(ipaddress.ip_address("2001:db8::")), []
    for entry, value in entries:
        try:
            net = ipaddress.ip_network(entry, strict=False)
        except ValueError:
            continue
        lo = int(net.network_address) - (base if net.version == 6 else 0)
        rows.append(f"({net.version}, {lo}, {min(lo + net.num_addresses - 1, 2**60)}, {net.prefixlen}, '{value}')")
    return f"{name}(version, lo, hi, len, name) AS (VALUES {', '.join(rows)})"


_NUM = "CASE WHEN source_ip LIKE '%:%' THEN 6 ELSE 4 END AS version, CASE WHEN source_ip LIKE '%:%' THEN user_id ELSE CAST(split_part(source_ip, '.', 1) AS BIGINT) * 16777216 + CAST(split_part(source_ip, '.', 2) AS BIGINT) * 65536 + CAST(split_part(source_ip, '.', 3) AS BIGINT) * 256 + CAST(split_part(source_ip, '.', 4) AS BIGINT) END AS num"
_IPS = f"ips AS (SELECT DISTINCT source_ip, {_NUM} FROM ev)"
_INTEL = _nets("intel", [(n, n) for n in INTEL])
_ALLOWED = _nets("allowed", [(n, n) for n in ALLOWED])
_GEO = _nets("geo", COUNTRIES.items())
_BAD = "bad AS (SELECT DISTINCT source_ip FROM ips JOIN intel ON ips.version = intel.version AND num BETWEEN lo AND hi)"
_LAND = "land AS (SELECT source_ip, arg_max(geo.name, geo.len) AS country FROM ips JOIN geo ON ips.version = geo.version AND num BETWEEN lo AND hi GROUP BY source_ip)"
_ALL = f"WITH {_EV},\n {_rules()},\n {_incidents()}"
_DURATION = "CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE (s // 3600) || 'h ' || (s % 3600 // 60) || 'm' END"
_TITLE = "CASE incident_type WHEN 'brute_force' THEN 'Brute-force attack from ' WHEN 'port_scan' THEN 'Port scan from ' ELSE 'Web 404 flood / scanning from ' END || source_ip"
_FAILED = r"^(\w+)\s+(\d+)\s+(\S+).*Failed (?:password|publickey) for (?:invalid user )?(\S+) from ([0-9a-fA-F:.]+) port (\d+)"
_ACCEPTED = r"^(\w+)\s+(\d+)\s+(\S+).*Accepted (?:password|publickey) for (\S+) from ([0-9a-fA-F:.]+) port (\d+)"
_CONNECTION = r"^(\w+)\s+(\d+)\s+(\S+).*Connection from ([0-9a-fA-F:.]+) port (\d+)"
_SSH_LINES = """lines AS (SELECT strftime(event_time, '%b %-d %H:%M:%S') || ' server sshd[' || event_id || ']: ' || (CASE event_type WHEN 'failed_login' THEN 'Failed password for ' || (CASE WHEN event_id % 2 = 0 THEN 'invalid user ' ELSE '' END) || username WHEN 'successful_login' THEN 'Accepted publickey for ' || username WHEN 'connection' THEN 'Connection' ELSE 'Disconnected' END) || ' from ' || source_ip || ' port ' || port || ' ssh2' AS value FROM ev)"""
_WEB_LINES = """lines AS (SELECT source_ip || ' - - [' || strftime(event_time, '%d/%b/%Y:%H:%M:%S') || ' +0000] "GET /p/' || port || ' HTTP/1.1" ' || (CASE WHEN event_type = 'http_404' THEN '404' ELSE '200' END) || ' 512' AS value FROM ev)"""
_WEB = r'^(\S+) \S+ \S+ \[([^\]]+)\] "([A-Z]+) (\S+)[^"]*" (\d{3})'
_FEATURES = f"""WITH {_EV}, b AS (SELECT source_ip, count(*) OVER (PARTITION BY source_ip ORDER BY event_time RANGE BETWEEN CURRENT ROW AND INTERVAL 60 SECOND FOLLOWING) AS c FROM ev), m AS (SELECT source_ip, max(c) AS busiest FROM b GROUP BY 1),
 t AS (SELECT source_ip, count(*) AS total, count(*) FILTER (event_type = 'failed_login') AS failed, count(DISTINCT port) FILTER (port <> 0) AS ports, count(DISTINCT username) AS users, (epoch_us(max(event_time)) - epoch_us(min(event_time))) / 60000000.0 AS active, avg(CASE WHEN extract(hour FROM event_time) < 6 THEN 1.0 ELSE 0.0 END) AS night FROM ev GROUP BY 1)"""
_EVIDENCE = "evidence AS (SELECT source_ip, count(DISTINCT username) FILTER (event_type = 'failed_login') AS failed_users, bool_or(event_type = 'successful_login') AS has_success, count(*) FILTER (event_type = 'failed_login' AND raw_line LIKE '%invalid user%') AS invalid_fails, count(*) FILTER (event_type = 'failed_login') AS total_fails FROM ev GROUP BY 1)"
_FLAGGED = f"WITH {_EV},\n {_rules()},\n {_EVIDENCE}, ruled AS (SELECT source_ip FROM brute UNION SELECT source_ip FROM scan), drops AS (SELECT brute.source_ip FROM brute JOIN evidence USING (source_ip) WHERE brute.source_ip IN ('10.0.0.8', '45.33.0.1') OR (failed_users <= 1 AND has_success)), kept AS (SELECT source_ip FROM ruled WHERE source_ip NOT IN (SELECT source_ip FROM drops))"
_TRUTH = "truth AS (SELECT event_id, event_time, source_ip, CASE WHEN event_type = 'failed_login' THEN 'malicious' ELSE 'benign' END AS label FROM ev), hit AS (SELECT t.event_id, t.source_ip, t.label, bool_or(i.first_seen IS NOT NULL) AS matched FROM truth t LEFT JOIN inc i ON i.source_ip = t.source_ip AND i.first_seen BETWEEN t.event_time - INTERVAL 600 MINUTE AND t.event_time + INTERVAL 600 MINUTE GROUP BY 1, 2, 3)"

ORACLES: dict[str, str] = {
    "ssh_parse": f"WITH {_EV}, {_SSH_LINES}, p AS (SELECT value, CASE WHEN regexp_matches(value, '{_FAILED}') THEN 'failed_login' WHEN regexp_matches(value, '{_ACCEPTED}') THEN 'successful_login' WHEN regexp_matches(value, '{_CONNECTION}') THEN 'connection' END AS event_type FROM lines) SELECT event_type, strptime('2024 ' || regexp_extract(value, '{_CONNECTION.split('.*')[0]}', 1) || ' ' || regexp_extract(value, '{_CONNECTION.split('.*')[0]}', 2) || ' ' || regexp_extract(value, '{_CONNECTION.split('.*')[0]}', 3), '%Y %b %-d %H:%M:%S') AS event_time, CASE event_type WHEN 'failed_login' THEN regexp_extract(value, '{_FAILED}', 5) WHEN 'successful_login' THEN regexp_extract(value, '{_ACCEPTED}', 5) ELSE regexp_extract(value, '{_CONNECTION}', 4) END AS source_ip, CASE event_type WHEN 'failed_login' THEN regexp_extract(value, '{_FAILED}', 4) WHEN 'successful_login' THEN regexp_extract(value, '{_ACCEPTED}', 4) END AS username, CAST(regexp_extract(value, ' port (\\d+) ssh2$', 1) AS INTEGER) AS port FROM p WHERE event_type IS NOT NULL",
    "web_parse": f"WITH {_EV}, {_WEB_LINES} SELECT CASE WHEN regexp_extract(value, '{_WEB}', 5) = '404' THEN 'http_404' ELSE 'http_request' END AS event_type, strptime(substr(regexp_extract(value, '{_WEB}', 2), 1, 20), '%d/%b/%Y:%H:%M:%S') AS event_time, regexp_extract(value, '{_WEB}', 1) AS source_ip FROM lines",
    "event_type_counts": f"WITH {_EV} SELECT event_type, count(*) AS n FROM ev GROUP BY 1",
    "brute_force": f"WITH {_EV}, {_rule('brute', "event_type = 'failed_login'", 'count(*)')} SELECT * FROM brute",
    "port_scan": f"WITH {_EV}, {_rules()} SELECT s.source_ip, s.first_seen, s.last_seen, s.event_count, string_agg(CAST(p.port AS VARCHAR), ',' ORDER BY p.port) AS ports FROM scan s JOIN (SELECT DISTINCT s.source_ip, e.port FROM scan s JOIN ev e ON e.source_ip = s.source_ip AND e.event_type = 'connection' AND e.port <> 0 AND e.event_time BETWEEN s.first_seen AND s.first_seen + INTERVAL 1440 MINUTE) p ON p.source_ip = s.source_ip GROUP BY 1, 2, 3, 4",
    "flood_404": f"WITH {_EV}, {_rule('flood', "event_type = 'http_404'", 'count(*)')} SELECT * FROM flood",
    "all_incidents_severity_mitre": f"{_ALL} SELECT incident_type, source_ip, first_seen, last_seen, event_count, severity, mitre_id, mitre_name, mitre_tactic FROM inc",
    "tumbling_event_count": f"WITH {_EV} SELECT date_trunc('day', event_time) AS window_start, source_ip, count(*) AS event_count FROM ev WHERE event_type = 'failed_login' GROUP BY 1, 2 HAVING count(*) >= 3",
    "tumbling_value_count": f"WITH {_EV} SELECT date_trunc('day', event_time) AS window_start, source_ip, count(DISTINCT port) AS value_count FROM ev WHERE event_type = 'connection' GROUP BY 1, 2 HAVING count(DISTINCT port) >= 3",
    "burst_score": f"WITH {_EV}, b AS (SELECT source_ip, count(*) OVER (PARTITION BY source_ip ORDER BY event_time RANGE BETWEEN CURRENT ROW AND INTERVAL 60 SECOND FOLLOWING) AS c FROM ev) SELECT source_ip, max(c) AS busiest FROM b GROUP BY 1",
    "ip_features": f"{_FEATURES} SELECT source_ip, CAST(failed AS DOUBLE) AS failed_logins, CAST(ports AS DOUBLE) AS unique_ports, CAST(users AS DOUBLE) AS unique_usernames, round(total / greatest(active, 1.0), 6) AS events_per_minute, round(CAST(active AS DOUBLE), 6) AS active_minutes, round(night, 6) AS night_ratio, round(CASE WHEN total <= 1 THEN 1.0 ELSE busiest / CAST(total AS DOUBLE) END, 6) AS burst_score, round(failed / CAST(total AS DOUBLE), 6) AS fail_ratio FROM t JOIN m USING (source_ip)",
    "top_failed_ips": f"WITH {_EV} SELECT source_ip, count(*) AS n FROM ev WHERE event_type = 'failed_login' GROUP BY 1 ORDER BY n DESC, source_ip LIMIT 10",
    "hourly_timeline": f"{_ALL}, b AS (SELECT date_trunc('hour', min(first_seen)) AS a, date_trunc('hour', max(first_seen)) AS z FROM inc), h AS (SELECT unnest(generate_series(a, z, INTERVAL 1 HOUR)) AS hour FROM b) SELECT hour, strftime(hour, '%m-%d %H:00') AS label, count(i.source_ip) FILTER (i.incident_type = 'brute_force') AS brute_force, count(i.source_ip) FILTER (i.incident_type = 'port_scan') AS port_scan FROM h LEFT JOIN inc i ON date_trunc('hour', i.first_seen) = hour GROUP BY 1, 2",
    "mitre_coverage": f"{_ALL} SELECT mitre_id AS technique_id, mitre_name AS name, mitre_tactic AS tactic, count(*) AS n FROM inc GROUP BY 1, 2, 3",
    "technique_counts": f"{_ALL} SELECT mitre_id AS technique_id, count(*) AS n FROM inc GROUP BY 1",
    "incident_kpis": f"{_ALL} SELECT (SELECT count(*) FROM ev) AS events, count(*) AS incidents, count(*) FILTER (incident_type = 'brute_force') AS brute_force, count(*) FILTER (incident_type = 'port_scan') AS port_scan, count(*) FILTER (incident_type = 'flood_404') AS flood_404, count(DISTINCT source_ip) AS attackers, count(DISTINCT mitre_id) AS techniques, CAST(0 AS BIGINT) AS anomalies FROM inc",
    "first_incident_per_ip": f"{_ALL} SELECT source_ip, arg_min(incident_type, type_rank) AS incident_type, CAST(arg_min(event_count, type_rank) AS INTEGER) AS event_count FROM inc GROUP BY 1",
    "enrichment_summary": f"{_ALL}, f AS (SELECT source_ip, arg_min(incident_type, type_rank) AS incident_type, CAST(arg_min(event_count, type_rank) AS INTEGER) AS event_count FROM inc GROUP BY 1) SELECT * FROM f ORDER BY event_count DESC, source_ip LIMIT 15",
    "report_rows": f"{_ALL}, d AS (SELECT *, CAST(floor((epoch_us(last_seen) - epoch_us(first_seen)) / 1000000.0) AS BIGINT) AS s FROM inc) SELECT incident_type, source_ip, event_count, severity, strftime(first_seen, '%Y-%m-%d %H:%M:%S UTC') AS first_seen, {_DURATION} AS duration, mitre_id FROM d",
    "allowlist_filter": f"WITH {_EV}, {_IPS}, {_ALLOWED}, skip AS (SELECT DISTINCT source_ip FROM ips JOIN allowed ON ips.version = allowed.version AND num BETWEEN lo AND hi) SELECT event_id, source_ip FROM ev WHERE source_ip NOT IN (SELECT source_ip FROM skip)",
    "composite_allowlist": f"WITH {_EV}, {_IPS}, {_ALLOWED}, skip AS (SELECT DISTINCT source_ip FROM ips JOIN allowed ON ips.version = allowed.version AND num BETWEEN lo AND hi) SELECT count(*) FILTER (x) AS suppressed, count(*) FILTER (NOT x) AS kept FROM (SELECT source_ip IN (SELECT source_ip FROM skip) OR username IN ('u3') OR hostname IN ('h2', 'h5') AS x FROM ev)",
    "known_bad": f"{_ALL}, {_IPS}, {_INTEL}, {_BAD} SELECT incident_type, source_ip, bad.source_ip IS NOT NULL AS known_bad FROM inc LEFT JOIN bad USING (source_ip)",
    "geo_country": f"{_ALL}, {_IPS}, {_GEO}, {_LAND} SELECT incident_type, source_ip, coalesce(country, 'Unknown') AS country FROM inc LEFT JOIN land USING (source_ip)",
    "country_counts": f"{_ALL}, {_IPS}, {_GEO}, {_LAND} SELECT coalesce(country, 'Unknown') AS country, count(*) AS n FROM inc LEFT JOIN land USING (source_ip) GROUP BY 1",
    "suppress_repeats": f"{_ALL}, stored AS (SELECT incident_type, source_ip, last_seen AS detected_at FROM inc WHERE event_count % 2 = 1), last_time AS (SELECT max(event_time) AS now FROM ev), recent AS (SELECT DISTINCT incident_type, source_ip FROM stored, last_time WHERE detected_at >= now - INTERVAL 28800 MINUTE) SELECT incident_type, source_ip FROM inc ANTI JOIN recent USING (incident_type, source_ip)",
    "eval_rows": f"{_ALL}, {_TRUTH}, n AS (SELECT count(*) FILTER (label = 'malicious' AND matched) AS tp, count(*) FILTER (label = 'benign' AND matched) AS fp, count(*) FILTER (label = 'malicious' AND NOT matched) AS fn, count(*) FILTER (label = 'benign' AND NOT matched) AS tn, coalesce(array_to_string(list_sort(list(DISTINCT source_ip) FILTER (label = 'benign' AND matched)), ','), '') AS fps FROM hit), r AS (SELECT *, CASE WHEN tp + fp > 0 THEN round(tp / CAST(tp + fp AS DOUBLE), 4) ELSE 0.0 END AS p, CASE WHEN tp + fn > 0 THEN round(tp / CAST(tp + fn AS DOUBLE), 4) ELSE 0.0 END AS q FROM n) SELECT tp AS true_positives, fp AS false_positives, fn AS false_negatives, tn AS true_negatives, CAST(p AS DOUBLE) AS precision, CAST(q AS DOUBLE) AS recall, CAST(CASE WHEN p + q > 0 THEN round(2 * p * q / (p + q), 4) ELSE 0 END AS DOUBLE) AS f1, fps AS fp_source_ips FROM r",
    "eval_ips": f"{_FLAGGED}, marks AS (SELECT source_ip, source_ip LIKE '45.33.%' OR source_ip LIKE '185.220.%' AS bad FROM (SELECT DISTINCT source_ip FROM ev)), c AS (SELECT 'rules' AS config, count(*) FILTER (bad AND f) AS tp, count(*) FILTER (NOT bad AND f) AS fp, count(*) FILTER (bad AND NOT f) AS fn, count(*) FILTER (NOT bad AND NOT f) AS tn FROM (SELECT bad, source_ip IN (SELECT source_ip FROM ruled) AS f FROM marks) UNION ALL SELECT 'rules+fp_reduction', count(*) FILTER (bad AND f), count(*) FILTER (NOT bad AND f), count(*) FILTER (bad AND NOT f), count(*) FILTER (NOT bad AND NOT f) FROM (SELECT bad, source_ip IN (SELECT source_ip FROM kept) AS f FROM marks)), r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 1.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) ELSE 1.0 END AS q FROM c) SELECT config, CAST(tp AS INTEGER) AS tp, CAST(fp AS INTEGER) AS fp, CAST(fn AS INTEGER) AS fn, CAST(tn AS INTEGER) AS tn, round(p, 4) AS precision, round(q, 4) AS recall, round(CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0 END, 4) AS f1, round((tp + tn) / CAST(tp + fp + fn + tn AS DOUBLE), 4) AS accuracy FROM r",
    "replay_compare": f"WITH {_EV},\n {_rules()},\n {_incidents()},\n {_rules('b', 4)},\n {_incidents('b')} SELECT coalesce(a.incident_type, b.incident_type) AS incident_type, coalesce(a.source_ip, b.source_ip) AS source_ip, CASE WHEN b.source_ip IS NULL THEN 'only_a' WHEN a.source_ip IS NULL THEN 'only_b' ELSE 'both' END AS category FROM inc a FULL JOIN incb b ON a.incident_type = b.incident_type AND a.source_ip = b.source_ip",
    "auth_evidence": f"WITH {_EV}, {_EVIDENCE} SELECT * FROM evidence",
    "derive_labels": f"WITH {_EV}, c AS (SELECT source_ip, count(*) FILTER (event_type = 'failed_login') AS failed_attempts, count(*) FILTER (event_type = 'successful_login') AS ok FROM ev GROUP BY 1) SELECT source_ip, CASE WHEN failed_attempts > 0 THEN 'brute_force' ELSE 'benign' END AS class, failed_attempts > 0 AS malicious, failed_attempts FROM c WHERE failed_attempts > 0 OR ok > 0",
    "fp_reduction": f"{_FLAGGED} SELECT source_ip FROM kept",
    "contract_gap": f"WITH {_EV}, needs(detector, event_type) AS (VALUES ('brute_force', 'failed_login'), ('port_scan', 'connection'), ('flood_404', 'http_404'), ('lockouts', 'account_locked')) SELECT detector, event_type FROM needs WHERE event_type NOT IN (SELECT event_type FROM ev)",
    "scrub_usernames": f"WITH {_EV} SELECT event_id, 'user_' || substr(sha256(username), 1, 8) AS username FROM ev",
    "redact_raw": f"WITH {_EV} SELECT event_id, source_ip, CAST(NULL AS VARCHAR) AS raw_line FROM ev",
    "encrypt_roundtrip": f"WITH {_EV} SELECT event_id, source_ip AS decrypted, source_ip AS untouched FROM ev",
    "search_docs": f"{_ALL}, {_IPS}, {_INTEL}, {_BAD} SELECT incident_type, source_ip, 'Unknown' AS country, severity, event_count, bad.source_ip IS NOT NULL AS known_bad, mitre_id AS technique_id, mitre_name AS technique_name, mitre_tactic AS tactic, 'events' AS log_file FROM inc LEFT JOIN bad USING (source_ip)",
    "soc_alerts": f"{_ALL} SELECT {_TITLE} AS title, CASE incident_type WHEN 'flood_404' THEN 'anomaly' ELSE incident_type END AS category, severity, source_ip, event_count || ' events; MITRE ' || mitre_id || ' (' || mitre_tactic || ').' AS description, '1.1.0' AS detection_version FROM inc",
    "navigator_scores": f"{_ALL}, s AS (SELECT *, CASE severity WHEN 'CRITICAL' THEN 100 WHEN 'HIGH' THEN 75 WHEN 'MEDIUM' THEN 50 ELSE 25 END AS score FROM inc), k AS (SELECT *, row_number() OVER (PARTITION BY mitre_id ORDER BY score DESC, type_rank, event_count DESC, source_ip) AS k FROM s) SELECT mitre_id AS technique_id, score, incident_type || ': ' || event_count || ' events, ' || severity AS comment FROM k WHERE k = 1",
    "siem_queries": f"""{_ALL}, spec(incident_type, event_type, counts, field, least, span) AS (VALUES ('brute_force', 'failed_login', 'event_count', NULL, 5, 10), ('port_scan', 'connection', 'value_count', 'port', 20, 5), ('flood_404', 'http_404', 'event_count', NULL, 30, 5)) SELECT incident_type, 'sentinel' AS target, incident_type || '.kql' AS file, 'event_type =~ "' || event_type || '"' || chr(10) || '| summarize ' || counts || ' = ' || (CASE WHEN field IS NOT NULL THEN 'dcount(DstPortNumber)' ELSE 'count()' END) || ' by bin(TimeGenerated, ' || span || 'm), SrcIpAddr' || chr(10) || '| where ' || counts || ' >= ' || least AS query FROM spec WHERE incident_type IN (SELECT incident_type FROM inc) UNION ALL SELECT incident_type, 'splunk', incident_type || '.spl', 'event_type="' || event_type || '"' || chr(10) || chr(10) || '| bin _time span=' || span || 'm' || chr(10) || '| stats ' || (CASE WHEN field IS NOT NULL THEN 'dc(dest_port)' ELSE 'count' END) || ' as ' || counts || ' by _time src_ip' || chr(10) || chr(10) || '| search ' || counts || ' >= ' || least FROM spec WHERE incident_type IN (SELECT incident_type FROM inc) UNION ALL SELECT incident_type, 'esql', incident_type || '.esql', 'from * metadata _id, _index, _version | where event_type=="' || event_type || '"' || chr(10) || '| eval timebucket=date_trunc(' || span || 'minutes, @timestamp) | stats ' || counts || '=' || (CASE WHEN field IS NOT NULL THEN 'count_distinct(destination.port)' ELSE 'count()' END) || ' by timebucket, source.ip' || chr(10) || '| where ' || counts || ' >= ' || least FROM spec WHERE incident_type IN (SELECT incident_type FROM inc)""",
    "top_threat_sources": f"{_ALL} SELECT source_ip, incident_type, event_count, severity FROM inc ORDER BY event_count DESC, source_ip, incident_type LIMIT 5",
    "incidents_by_severity": f"{_ALL} SELECT incident_type, source_ip, event_count, severity FROM inc WHERE severity = 'LOW'",
    "severity_route": f"{_ALL} SELECT count(*) AS incidents, coalesce(bool_or(severity = 'CRITICAL'), false) AS critical, CASE WHEN count(*) = 0 THEN 'no_incidents' WHEN bool_or(severity = 'CRITICAL') THEN 'critical' ELSE 'normal' END AS route FROM inc",
    "incident_digest": f"{_ALL} SELECT severity, string_agg('- ' || incident_type || ' from ' || source_ip || ', count=' || event_count || ', MITRE=' || mitre_id, chr(10) ORDER BY incident_type, source_ip) AS digest FROM inc GROUP BY 1",
    "source_counts": f"WITH {_EV},\n {_rules('', 3, 'source_ip, source_file')},\n {_incidents()}, c AS (SELECT source_file, count(*) AS incidents, count(*) FILTER (incident_type = 'brute_force') AS brute_force, count(*) FILTER (incident_type = 'port_scan') AS port_scan, count(*) FILTER (incident_type = 'flood_404') AS flood_404 FROM inc GROUP BY 1) SELECT e.source_file, e.events, coalesce(incidents, 0) AS incidents, coalesce(brute_force, 0) AS brute_force, coalesce(port_scan, 0) AS port_scan, coalesce(flood_404, 0) AS flood_404 FROM (SELECT source_file, count(*) AS events FROM ev GROUP BY 1) e LEFT JOIN c USING (source_file)",
    "cosine_topk": "WITH q AS (SELECT vec_id AS query_id, embedding AS a FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT query_id, e.vec_id AS item_id, list_cosine_similarity(CAST(a AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS s FROM q, embeddings e), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, item_id) AS rank FROM s) SELECT query_id, item_id, round(s, 3) AS similarity, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 3",
    "mean_query_vector": "SELECT label, p - 1 AS position, round(avg(CAST(x AS DOUBLE)), 6) AS x FROM (SELECT label, unnest(embedding) AS x, unnest(generate_series(1, len(embedding))) AS p FROM embeddings) GROUP BY 1, 2",
    "ttp_upsert": "WITH b AS (SELECT 'T' || (doc_id % 50) AS technique_id, source AS name, doc_id AS version FROM documents WHERE doc_id % 3 > 0 UNION ALL SELECT 'T' || (doc_id % 50), lang, doc_id FROM documents WHERE doc_id % 3 = 0), k AS (SELECT *, row_number() OVER (PARTITION BY technique_id ORDER BY version DESC) AS k FROM b) SELECT technique_id, name, version FROM k WHERE k = 1",
    "call_metrics": f"WITH {_EV}, c AS (SELECT event_type <> 'failed_login' AS ok, event_id % 3 AS retries, port * 10 AS ti, port AS tok, value AS ms FROM ev), g AS (SELECT ms, row_number() OVER (ORDER BY ms) - 1 AS k, count(*) OVER () AS n FROM c WHERE ok) SELECT count(*) AS total, count(*) FILTER (ok) AS succeeded, count(*) FILTER (NOT ok) AS failed, CAST(sum(retries) AS BIGINT) AS retries, CAST(sum(ti) FILTER (ok) AS BIGINT) AS tokens_in, CAST(sum(tok) FILTER (ok) AS BIGINT) AS tokens_out, round(quantile_cont(ms, 0.5) FILTER (ok), 4) AS p50, (SELECT max(ms) FROM g WHERE k = CAST(round_even(0.95 * (n - 1), 0) AS BIGINT)) AS p95, round(CAST(sum(ti) FILTER (ok) AS DOUBLE) / 1000000 + CAST(sum(tok) FILTER (ok) AS DOUBLE) / 1000000 * 5, 6) AS cost FROM c",
    "retention_keep": f"WITH {_EV} SELECT event_id, event_time FROM ev WHERE event_time >= (SELECT max(event_time) FROM ev) - INTERVAL 10 DAY",
    "text_gate": "SELECT lang, count(*) FILTER (length(trim(text)) >= 20) AS good, count(*) FILTER (NOT length(trim(text)) >= 20) AS bad FROM documents GROUP BY 1",
    "customer_order_bursts": "WITH w AS (SELECT o_custkey, o_orderdate, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN CURRENT ROW AND INTERVAL 30 DAY FOLLOWING) AS c, max(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN CURRENT ROW AND INTERVAL 30 DAY FOLLOWING) AS l FROM orders) SELECT o_custkey, min(o_orderdate) AS first_seen, arg_min(l, o_orderdate) AS last_seen, CAST(arg_min(c, o_orderdate) AS INTEGER) AS event_count FROM w WHERE c >= 3 GROUP BY 1",
}

_BURSTS = "bw AS (SELECT source_ip, count(*) OVER (PARTITION BY source_ip ORDER BY event_time RANGE BETWEEN CURRENT ROW AND INTERVAL 60 SECOND FOLLOWING) AS c, count(*) OVER (PARTITION BY source_ip) AS total FROM ev), rawburst AS (SELECT source_ip, CASE WHEN max(total) <= 1 THEN 1.0 ELSE max(c) / CAST(max(total) AS DOUBLE) END AS raw FROM bw GROUP BY 1), burst AS (SELECT source_ip, CASE WHEN max(raw) OVER () > min(raw) OVER () THEN round((raw - min(raw) OVER ()) / (max(raw) OVER () - min(raw) OVER ()), 4) ELSE 0.0 END AS score FROM rawburst)"
ORACLES |= {
    "windows_parse": f"WITH {_EV} SELECT CASE event_type WHEN 'failed_login' THEN 'failed_login' WHEN 'successful_login' THEN 'successful_login' ELSE 'event_0' END AS event_type, event_time, source_ip, CASE WHEN event_id % 7 <> 0 THEN username END AS username, CASE WHEN event_id % 5 <> 0 THEN port ELSE -1 END AS port FROM ev WHERE event_type IN ('failed_login', 'successful_login', 'connection')",
    "windows_csv": f"WITH {_EV} SELECT CASE event_type WHEN 'failed_login' THEN 'failed_login' WHEN 'successful_login' THEN 'successful_login' ELSE 'event_0' END AS event_type, event_time, source_ip, CASE WHEN event_id % 7 <> 0 THEN username END AS username, CASE WHEN event_id % 5 <> 0 THEN port ELSE -1 END AS port FROM ev WHERE event_type IN ('failed_login', 'successful_login', 'connection')",
    "stream_brute_force": ORACLES["brute_force"],
    "tail_ingest": ORACLES["ssh_parse"],
    "stream_dedup": f"WITH {_EV} SELECT DISTINCT event_type AS incident_type, source_ip FROM ev",
    "enriched_scores": f"{_ALL}, {_BURSTS} SELECT incident_type, source_ip, round(coalesce(score, 0.0), 6) AS anomaly_score FROM inc LEFT JOIN burst USING (source_ip)",
    "anomaly_labels": f"{_ALL}, {_BURSTS} SELECT source_ip, round(score, 6) AS anomaly_score, CASE WHEN source_ip IN (SELECT source_ip FROM inc) THEN 'Rule + ML' ELSE 'ML Only' END AS detection FROM burst WHERE score >= {ANOMALOUS}",
    "chart_series": f"{_ALL}, k AS (SELECT CAST(row_number() OVER (ORDER BY event_count DESC, incident_type, source_ip) AS INTEGER) AS rank, * FROM inc) SELECT rank, source_ip || ' (' || incident_type || ')' AS label, event_count AS value FROM k WHERE rank <= 15",
    "score_series": f"WITH {_EV}, {_BURSTS}, k AS (SELECT CAST(row_number() OVER (ORDER BY score DESC, source_ip) AS INTEGER) AS rank, source_ip, score FROM burst) SELECT rank, source_ip AS label, score AS value, CASE WHEN score >= 0.8 THEN '#ef4444' WHEN score >= 0.65 THEN '#f97316' WHEN score >= 0.5 THEN '#eab308' ELSE '#3b82f6' END AS colour FROM k WHERE rank <= 15",
    "split_types": f"{_ALL} SELECT t.incident_type, count(i.source_ip) AS n FROM (VALUES ('brute_force'), ('port_scan'), ('flood_404')) t(incident_type) LEFT JOIN inc i ON i.incident_type = t.incident_type GROUP BY 1",
    "detection_rules": f"{_ALL}, spec(incident_type, level, selection, timeframe, condition, tags) AS (VALUES ('brute_force', 'high', 'event_type=failed_login', '10m', 'selection | count() by source_ip >= 5', 'attack.credential_access,attack.t1110.001'), ('port_scan', 'medium', 'source_ip=*', '5m', 'selection | count(port) by source_ip >= 20', 'attack.discovery,attack.t1046'), ('flood_404', 'medium', 'event_type=http_404', '5m', 'selection | count() by source_ip >= 30', 'attack.reconnaissance,attack.t1595.002')) SELECT * FROM spec WHERE incident_type IN (SELECT incident_type FROM inc)",
    "compare_summary": f"WITH compared AS ({ORACLES['replay_compare']}) SELECT count(*) FILTER (category = 'only_a') AS only_a, count(*) FILTER (category = 'only_b') AS only_b, count(*) FILTER (category = 'both') AS both, count(*) FILTER (category = 'only_b') - count(*) FILTER (category = 'only_a') AS net_change FROM compared",
    "eval_ips_full": f"{_FLAGGED}, {_BURSTS}, full_set AS (SELECT source_ip FROM kept UNION SELECT source_ip FROM burst WHERE score >= {ANOMALOUS}), marks AS (SELECT DISTINCT source_ip, source_ip LIKE '45.33.%' OR source_ip LIKE '185.220.%' AS bad FROM ev), c AS (SELECT 'full' AS config, count(*) FILTER (bad AND f) AS tp, count(*) FILTER (NOT bad AND f) AS fp, count(*) FILTER (bad AND NOT f) AS fn, count(*) FILTER (NOT bad AND NOT f) AS tn FROM (SELECT bad, source_ip IN (SELECT source_ip FROM full_set) AS f FROM marks))" + ORACLES["eval_ips"][ORACLES["eval_ips"].index(", r AS (SELECT *, CASE WHEN tp + fp"):],
}
