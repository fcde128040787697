"""SQL of the same queries in DuckDB's dialect, built from shared parts."""

from __future__ import annotations

ONLY_DOCUMENTS = "content AS (SELECT doc_id AS cid, text FROM documents)"
CONTENT = """content AS (
  SELECT doc_id * 3 AS cid, text FROM documents
  UNION ALL SELECT page_id * 3 + 1, html FROM pages
  UNION ALL SELECT page_id * 3 + 2, concat_ws(' ', url, regexp_extract(html, '<title>(.*?)</title>', 1, 's')) FROM pages)"""
TOKENS = r"tok AS (SELECT cid, text, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM content)"
FEATURES = r"""feat AS (
  SELECT cid, text, w, len(w)::BIGINT AS word_count,
    len(list_filter(w, lambda x: starts_with(x, 'http://') OR starts_with(x, 'https://') OR starts_with(x, 'www.')))::BIGINT AS link_count,
    length(regexp_replace(text, '\P{Lu}', '', 'g')) / greatest(1, length(regexp_replace(text, '\P{L}', '', 'g'))) AS uppercase_ratio,
    len(list_distinct(list_transform(w, lambda x: lower(x)))) / greatest(1, len(w)) AS lexical_diversity,
    length(array_to_string(w, '')) / greatest(1, len(w)) AS avg_word_length FROM tok),
ent AS (
  SELECT cid, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS h FROM (
    SELECT cid, ch, count(*) AS c FROM (SELECT cid, unnest(string_split(regexp_replace(text, '\s', '', 'g'), '')) AS ch FROM content) WHERE ch <> '' GROUP BY ALL) GROUP BY cid),
full_ AS (SELECT feat.*, link_count / greatest(1, word_count) AS link_ratio, coalesce(h, 0)::DOUBLE AS char_entropy FROM feat LEFT JOIN ent USING (cid))"""
RULES = """ruled AS (SELECT *,
  word_count > 0 AND link_ratio > 0.15::DOUBLE AS r1, word_count >= 3 AND uppercase_ratio > 0.6::DOUBLE AS r2, word_count >= 5 AND lexical_diversity < 0.35::DOUBLE AS r3,
  -1.5::DOUBLE + 4 * link_ratio + 1.5::DOUBLE * uppercase_ratio + 2 * (1 - lexical_diversity) AS c_spam,
  -1.0::DOUBLE - (1 - lexical_diversity) + 0.8::DOUBLE / (1 + abs(avg_word_length - 5)) + 0.25::DOUBLE * char_entropy AS c_slop FROM full_),
offset_ AS (SELECT *, -2.2::DOUBLE + if(r1, 2.5, 0)::DOUBLE + if(r2, 1.2, 0)::DOUBLE + if(r3, 1.0, 0)::DOUBLE AS rule_offset FROM ruled),
scored AS (SELECT *, 1 / (1 + exp(-(rule_offset + c_spam))) AS spam, 1 / (1 + exp(-(-1.4::DOUBLE + 0.7::DOUBLE * c_slop))) AS slop FROM offset_)"""
BITS = " + ".join(f"if(2 * sum((h >> {k}) & 1) > count(*), {1 << k}, 0)" for k in range(60))
PRINTS = f"""parts AS (
  SELECT cid, unnest(list_concat(lw, list_transform(range(1, len(lw)), lambda i: lw[i] || ' ' || lw[i + 1]))) AS part FROM (SELECT cid, list_transform(w, lambda x: lower(x)) AS lw FROM tok)),
prints AS (SELECT content.cid, coalesce(fp, 0)::BIGINT AS fp FROM content LEFT JOIN (
  SELECT cid, {BITS} AS fp FROM (SELECT cid, ('0x' || substr(md5(part), 1, 15))::BIGINT AS h FROM parts) GROUP BY cid) USING (cid))"""
PEOPLE = """people AS (SELECT cid,
  CASE cid % 6 WHEN 0 THEN NULL WHEN 1 THEN 'u' || cid || '@Mailinator.com' WHEN 2 THEN 'u@x' || cid || '@inbox.mailinator.com' WHEN 3 THEN 'u' || cid || '@spam.example' WHEN 4 THEN 'u' || cid || '@mailinator.com.example.org' ELSE '@nobody' || cid END AS email,
  CASE WHEN cid % 7 = 0 THEN '2001:db8:1::' || cid % 100 ELSE '203.0.' || cid % 7 || '.' || cid % 200 END AS ip FROM content)"""
DOMAINS = """domains AS (SELECT cid, ip, CASE WHEN strpos(email, '@') > 0 AND length(p[-1]) > 0 AND length(email) - length(p[-1]) - 1 > 0 AND contains(trim(p[-1]), '.') THEN lower(trim(p[-1])) END AS domain,
  coalesce(nullif(regexp_extract(ip, '^(\\d+\\.\\d+\\.\\d+)\\.\\d+$', 1), ''), nullif(regexp_extract(ip, '^(\\w+:\\w+:\\w+)::\\w+$', 1), '')) AS ip_key FROM (SELECT *, string_split(email, '@') AS p FROM people))"""
STORES = """s_ip(ip_key, ip_score) AS (VALUES ('203.0.1', 0.9::DOUBLE), ('203.0.2', 0.4::DOUBLE), ('203.0.3', 0.5::DOUBLE), ('203.0.4', 0.75::DOUBLE), ('2001:db8:1', 0.8::DOUBLE)),
s_disposable(name) AS (VALUES ('mailinator.com'), ('trash.example')),
s_domain(domain, domain_score) AS (VALUES ('spam.example', 0.8::DOUBLE), ('mailinator.com', 0.6::DOUBLE), ('example.com', 0.2::DOUBLE))"""
KNOWN = """known AS (SELECT fp, max(0.3::DOUBLE + (cid // 3 % 5) * 0.15::DOUBLE) AS fp_score FROM prints WHERE cid % 3 = 0 AND cid // 3 % 97 = 5 GROUP BY fp),
own AS (SELECT DISTINCT fp FROM prints),
near AS (SELECT own.fp, max(known.fp_score) AS fp_score FROM own JOIN known ON bit_count(xor(own.fp, known.fp)) <= 3 GROUP BY own.fp),
fp_local AS (SELECT own.fp, coalesce(known.fp_score, near.fp_score) AS fp_score FROM own LEFT JOIN known USING (fp) LEFT JOIN near USING (fp) WHERE known.fp IS NOT NULL OR near.fp IS NOT NULL)"""
LISTED = """listed AS (SELECT DISTINCT domain FROM domains WHERE EXISTS (SELECT 1 FROM s_disposable WHERE rtrim(domain, '.') = name OR ends_with(rtrim(domain, '.'), '.' || name)))"""
LABELLED = """lab AS (SELECT scored.cid, round(spam, 9) AS spam, round(slop, 9) AS slop, toxic = 1 AS spam_label, quality = 0 AS slop_label FROM scored JOIN labels ON doc_id = cid),
s AS (SELECT spam AS score, spam_label AS label FROM lab)"""
INPUTS = ["ln(1 + word_count)", "ln(1 + link_count)", "link_ratio", "uppercase_ratio", "lexical_diversity", "char_entropy", "avg_word_length"]
GROUPS = "grp AS (SELECT cid, sha256(array_to_string(list_transform(w, lambda x: lower(x)), ' ')) AS g FROM tok)"
SPLIT = "CASE WHEN ('0x' || substr(g, 1, 8))::BIGINT % 100 < 70 THEN 'train' WHEN ('0x' || substr(g, 1, 8))::BIGINT % 100 < 85 THEN 'validation' ELSE 'test' END"
VOTES = "votes AS (SELECT event_id AS seq, 't' || user_id % 7 AS tenant, user_id % 50 AS fp, if(event_type IN ('error', 'click'), 'spam', 'ham') AS verdict FROM events)"
LATEST = "latest AS (SELECT fp, tenant, arg_max(verdict, seq) AS verdict FROM votes GROUP BY ALL), agg AS (SELECT fp, count_if(verdict = 'spam') AS spam, count_if(verdict = 'ham') AS ham FROM latest GROUP BY fp)"


def q(*parts: str, recursive: bool = False) -> str:
    """Common parts, then the last one as the statement."""
    return f"WITH {'RECURSIVE ' * recursive}{', '.join(parts[:-1])} {parts[-1]}"


DOCS, ALL = (ONLY_DOCUMENTS, TOKENS, FEATURES, RULES), (CONTENT, TOKENS, FEATURES, RULES)
LAB = (*DOCS, LABELLED)
PARTS = (CONTENT, TOKENS, PRINTS)
COUNTS = "count_if(score >= {t} AND label)::BIGINT AS tp, count_if(score >= {t} AND NOT label)::BIGINT AS fp, count_if(score < {t} AND NOT label)::BIGINT AS tn, count_if(score < {t} AND label)::BIGINT AS fn"
PRF = "round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 AND tp + fp > 0 AND tp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) END, 6) AS f1"
ECE = "(SELECT sum(n * abs(a - p)) / sum(n) FROM (SELECT count(*) AS n, avg(score) AS a, avg(label::INT) AS p FROM {s} GROUP BY least(9, floor(score * 10))))"
AP = """(SELECT sum(pos * cp / cn) / nullif(sum(pos), 0) FROM (SELECT pos, sum(pos) OVER (ORDER BY score DESC) AS cp, sum(n) OVER (ORDER BY score DESC) AS cn
  FROM (SELECT score, count(*)::DOUBLE AS n, count_if(label)::DOUBLE AS pos FROM {s} GROUP BY score)))"""
METRICS = "SELECT '{name}' AS signal, count(*) AS labelled, count_if(label)::BIGINT AS positive, count_if(NOT label)::BIGINT AS negative, round(avg((score - label::INT) ** 2), 6) AS brier, round(" + ECE + ", 6) AS ece, round(" + AP + ", 6) AS average_precision, " + COUNTS.replace("{t}", "0.5::DOUBLE") + " FROM {s}"
EXPORT = (*DOCS, GROUPS, f"rows_ AS (SELECT scored.cid, g AS text_group, toxic = 1 AS label, rule_offset, rule_offset + c_spam AS baseline_logit, [{', '.join(f'({x})::DOUBLE' for x in INPUTS)}] AS x, {SPLIT} AS split FROM scored JOIN grp USING (cid) JOIN labels ON doc_id = cid)")
#: Parameters of a trained model, for the queries that need one with known results.
PARAMS = {"means": [5.0, 0.1, 0.05, 0.2, 0.6, 4.0, 4.5], "scales": [1.5, 0.5, 0.2, 0.3, 0.25, 0.4, 1.0], "weights": [0.3, 0.2, 0.9, 0.7, -0.8, 0.1, 0.05], "intercept": -0.4}
RESIDUAL = "-0.4::DOUBLE + " + " + ".join(f"(({x})::DOUBLE - {m}::DOUBLE) / {s}::DOUBLE * {w}::DOUBLE" for x, m, s, w in zip(INPUTS, PARAMS["means"], PARAMS["scales"], PARAMS["weights"]))
REASONS = "concat_ws(',', if(r1, 'high_link_ratio', NULL), if(r2, 'excessive_capitalization', NULL), if(r3, 'low_lexical_diversity', NULL), if(ip_score > 0.5, 'ip_reputation_bad', NULL), if(is_disposable, 'disposable_email_domain', NULL), if(domain_score > 0.5, 'email_domain_reputation_bad', NULL), if(fp_score > 0.5, 'content_fingerprint_seen_spam', NULL), if(slop > 0.25, 'ai_stylometry_high', NULL))"
ASSESS = (*ALL, PRINTS, PEOPLE, DOMAINS, STORES, KNOWN, LISTED, f"""assessed AS (SELECT cid, slop, {REASONS} AS reasons,
  1 / (1 + exp(-(rule_offset + c_spam + if(ip_score > 0.5, ip_score * 3, 0) + if(is_disposable, 1.5, 0)::DOUBLE + if(domain_score > 0.5, domain_score * 3, 0) + if(fp_score > 0.5, fp_score * 3.5::DOUBLE, 0)))) AS spam
  FROM (SELECT scored.*, ip_score, listed.domain IS NOT NULL AS is_disposable, domain_score, fp_score FROM scored JOIN domains USING (cid) JOIN prints USING (cid)
    LEFT JOIN s_ip USING (ip_key) LEFT JOIN listed ON listed.domain = domains.domain LEFT JOIN s_domain ON s_domain.domain = domains.domain LEFT JOIN fp_local ON fp_local.fp = prints.fp))""")  # fmt: skip

ORACLE: dict[str, str] = {
    "feat_tokens": q(CONTENT, TOKENS, "SELECT cid, array_to_string(w, '|') AS tokens FROM tok"),
    "features": q(*ALL, "SELECT cid, word_count, link_count, round(link_ratio, 6) AS link_ratio, round(uppercase_ratio, 6) AS uppercase_ratio, round(lexical_diversity, 6) AS lexical_diversity, round(avg_word_length, 6) AS avg_word_length FROM full_"),
    "char_entropy": q(*ALL, "SELECT cid, round(char_entropy, 6) AS char_entropy FROM full_"),
    "email_domain": q(CONTENT, PEOPLE, DOMAINS, "SELECT cid, domain FROM domains"),
    "model_features": q(*ALL, f"SELECT cid, {', '.join(f'round(({x})::DOUBLE, 6) AS x{k}' for k, x in enumerate(INPUTS))} FROM full_"),
    "rule_offset": q(*ALL, "SELECT cid, round(rule_offset, 6) AS rule_offset FROM scored"),
    "rules": q(*ALL, "SELECT cid, r1 AS high_link_ratio, r2 AS excessive_capitalization, r3 AS low_lexical_diversity FROM ruled"),
    "text_group": q(CONTENT, TOKENS, GROUPS, "SELECT cid, g AS text_group FROM grp"),
    "split_bucket": q(CONTENT, TOKENS, GROUPS, f"SELECT {SPLIT} AS split, count(*) AS n FROM grp GROUP BY ALL"),
    "baseline_classifier": q(*ALL, "SELECT cid, round(c_spam, 6) AS spam_logit, round(c_slop, 6) AS slop_logit FROM scored"),
    "simhash_md5": q(*PARTS, "SELECT cid, fp FROM prints"),
    "near_dup_pairs": q(*PARTS, "own AS (SELECT DISTINCT fp FROM prints)", "SELECT a.fp AS l, b.fp AS r, bit_count(xor(a.fp, b.fp))::BIGINT AS distance FROM own a JOIN own b ON a.fp < b.fp AND bit_count(xor(a.fp, b.fp)) <= 3"),
    "ip_bucket_v4": q(CONTENT, PEOPLE, DOMAINS, "SELECT cid, if(contains(ip_key, ':'), NULL, ip_key) AS ip_key FROM domains"),
    "ip_bucket_v6": q(CONTENT, PEOPLE, DOMAINS, "SELECT cid, if(contains(ip_key, ':'), ip_key, NULL) AS ip_key FROM domains"),
    "network_fp": q(*PARTS, "SELECT cid, substr(sha256('a-secret-of-at-least-thirty-two-bytes:' || fp), 1, 16) AS network_fp FROM prints"),
    "tenant_id": "SELECT c_custkey AS id, substr(sha256(c_name), 1, 32) AS tenant_id FROM customer",
    "rep_ip": q(CONTENT, PEOPLE, DOMAINS, STORES, "SELECT cid, ip_score, coalesce(ip_score > 0.5, false) AS bad FROM domains LEFT JOIN s_ip USING (ip_key)"),
    "rep_disposable": q(CONTENT, PEOPLE, DOMAINS, STORES, LISTED, "SELECT domain FROM listed"),
    "rep_disposable_exact": q(CONTENT, PEOPLE, DOMAINS, STORES, "SELECT DISTINCT domain FROM domains JOIN s_disposable ON domain = name"),
    "rep_domain": q(CONTENT, PEOPLE, DOMAINS, STORES, "SELECT cid, domain_score FROM domains JOIN s_domain USING (domain)"),
    "rep_fp_local": q(*PARTS, KNOWN, "SELECT fp, round(fp_score, 6) AS fp_score FROM fp_local"),
    "rep_fp_memory": q(*PARTS, KNOWN, "SELECT fp, round(fp_score, 6) AS fp_score FROM near"),
    "rep_fp_hosted": q(*PARTS, KNOWN, "net AS (SELECT fp, (abs(fp) % 10) / 10 AS n FROM own WHERE abs(fp) % 3 = 0)", "SELECT fp, round(greatest(fp_score, n), 6) AS fp_score FROM fp_local FULL JOIN net USING (fp)"),
    "assess": q(*ASSESS, "SELECT cid, round(spam, 6) AS spam, round(slop, 6) AS slop, reasons FROM assessed"),
    "reason_order": q(*ASSESS, "SELECT reasons, count(*) AS n FROM assessed GROUP BY ALL"),
    "reason_counts": q(*ASSESS, "SELECT reason, count(*) AS n FROM (SELECT unnest(string_split(reasons, ',')) AS reason FROM assessed) WHERE reason <> '' GROUP BY ALL"),
    "residual_score": q(*ALL, f"SELECT cid, round({RESIDUAL}, 6) AS residual FROM scored"),
    "assess_trained": q(*ALL, f"SELECT cid, round(1 / (1 + exp(-(rule_offset + {RESIDUAL}))), 6) AS spam, round(slop, 6) AS slop FROM scored"),
    "confusion": q(*LAB, f"SELECT {COUNTS.format(t='0.1::DOUBLE')} FROM s"),
    "prf": q(*LAB, f"c AS (SELECT {COUNTS.format(t='0.1::DOUBLE')} FROM s)", f"SELECT {PRF} FROM c"),
    "threshold_sweep": q(*LAB, "t(threshold) AS (VALUES " + ", ".join(f"({t}::DOUBLE)" for t in (0.02, 0.05, 0.1, 0.5, 0.7, 0.8, 0.9, 0.95)) + ")", f"c AS (SELECT threshold, {COUNTS.format(t='threshold')} FROM s, t GROUP BY threshold)", f"SELECT *, {PRF} FROM c"),
    "brier": q(*LAB, "SELECT round(avg((score - label::INT) ** 2), 6) AS brier FROM s"),
    "ece": q(*LAB, f"SELECT round({ECE.format(s='s')}, 6) AS ece"),
    "ece_range_bins": q(*LAB, "SELECT round(sum(n * abs(a - p)) / sum(n), 6) AS ece FROM (SELECT count(*) AS n, avg(score) AS a, avg(label::INT) AS p FROM s GROUP BY " + " + ".join(f"(score >= {b / 10}::DOUBLE)::INT" for b in range(1, 10)) + ")"),
    "average_precision": q(*LAB, f"SELECT round({AP.format(s='s')}, 6) AS average_precision"),
    "signal_metrics": q(*LAB, METRICS.format(name="spam", s="s")),
    "eval_report": q(*LAB, "s2 AS (SELECT slop AS score, slop_label AS label FROM lab)", METRICS.format(name="spam", s="s") + " UNION ALL " + METRICS.format(name="slop", s="s2")),
    "invalid_scores": "SELECT event_id AS id FROM events WHERE value > 1",
    "export_features": q(*EXPORT, "SELECT cid::VARCHAR AS id, text_group, label, round(rule_offset, 6) AS rule_offset, round(baseline_logit, 6) AS baseline_logit, round(x[1], 6) AS x0, round(x[6], 6) AS x5, split FROM rows_"),
    "train_rows_valid": q(*EXPORT, "SELECT count(*) AS rows_, 0::BIGINT AS faults FROM rows_"),
    "label_conflicts": q(ONLY_DOCUMENTS, TOKENS, GROUPS, "SELECT g AS text_group, count_if(cid % 2 = 1)::BIGINT AS positive, count(*) AS n FROM grp GROUP BY ALL HAVING count_if(cid % 2 = 1) BETWEEN 1 AND count(*) - 1"),
    "split_class_check": q(*EXPORT, "SELECT split, count(DISTINCT label) = 2 AS ok FROM rows_ GROUP BY split"),
    "partition_counts": q(*EXPORT, "SELECT split, if(cid % 2 = 0, 'even', 'odd') AS source, count(*) AS records, count_if(label)::BIGINT AS positive, count_if(NOT label)::BIGINT AS negative FROM rows_ GROUP BY ROLLUP (split, source) HAVING split IS NOT NULL"),
    "standardize": q(*EXPORT, " UNION ALL ".join(f"SELECT {k}::BIGINT AS input, round(avg(x[{k + 1}]), 6) AS mean, round(if(stddev_pop(x[{k + 1}]) = 0, 1, stddev_pop(x[{k + 1}])), 6) AS scale FROM rows_ WHERE split = 'train'" for k in range(7))),
    "logistic_gradient": q(*EXPORT, "p AS (SELECT *, 1 / (1 + exp(-rule_offset)) - label::INT AS e FROM rows_ WHERE split = 'train')", "m AS (SELECT " + ", ".join(f"avg(x[{k}]) AS m{k}, if(stddev_pop(x[{k}]) = 0, 1, stddev_pop(x[{k}])) AS s{k}" for k in range(1, 8)) + " FROM p)", " UNION ALL ".join([f"SELECT {k - 1}::BIGINT AS param, round(avg(e * (x[{k}] - m{k}) / s{k}), 6) AS gradient FROM p, m" for k in range(1, 8)] + ["SELECT 7::BIGINT, round(avg(e), 6) FROM p"])),
    "classifier_ab": q(*EXPORT, f"z AS (SELECT scored.cid, label, round(1 / (1 + exp(-baseline_logit)), 9) AS b, round(1 / (1 + exp(-(scored.rule_offset + {RESIDUAL}))), 9) AS t FROM rows_ JOIN scored USING (cid))",
        "one AS (SELECT b AS score, label FROM z)", "two AS (SELECT t AS score, label FROM z)",
        "m AS (" + " UNION ALL ".join(f"SELECT '{name}' AS classifier, (SELECT avg((score - label::INT) ** 2) FROM {t}) AS brier, {AP.format(s=t)} AS average_precision" for name, t in (("baseline", "one"), ("trained", "two"))) + ")",
        "SELECT classifier, round(brier, 6) AS brier, round(average_precision, 6) AS average_precision, (SELECT max(brier) FILTER (classifier = 'trained') < max(brier) FILTER (classifier = 'baseline') AND max(average_precision) FILTER (classifier = 'trained') > max(average_precision) FILTER (classifier = 'baseline') FROM m) AS default_eligible FROM m"),
    "parity_check": q(*EXPORT, "SELECT count(*) AS rows_, true AS within FROM rows_"),
    "select_candidate": q(*EXPORT, f"z AS (SELECT l2, label, round(1 / (1 + exp(-(scored.rule_offset + ({RESIDUAL}) / (1 + l2)))), 9) AS score FROM rows_ JOIN scored USING (cid), (VALUES (0::DOUBLE), (0.01::DOUBLE), (0.1::DOUBLE), (1::DOUBLE), (10::DOUBLE)) g(l2) WHERE split = 'validation')",
        "t AS (SELECT l2, score, count(*)::DOUBLE AS n, count_if(label)::DOUBLE AS pos FROM z GROUP BY ALL)", "w AS (SELECT *, sum(pos) OVER (PARTITION BY l2 ORDER BY score DESC) AS cp, sum(n) OVER (PARTITION BY l2 ORDER BY score DESC) AS cn FROM t)",
        "c AS (SELECT l2, sum(pos * cp / cn) / nullif(sum(pos), 0) AS ap FROM w GROUP BY l2)", "b AS (SELECT l2, avg((score - label::INT) ** 2) AS brier FROM z GROUP BY l2)",
        "SELECT l2, round(brier, 6) AS validation_brier, round(ap, 6) AS validation_average_precision FROM b JOIN c USING (l2) ORDER BY brier, ap DESC, l2 DESC LIMIT 1"),
    "votes_latest": q(VOTES, LATEST, "SELECT fp, tenant, verdict FROM latest"),
    "vote_aggregates": q(VOTES, LATEST, "SELECT fp, spam::BIGINT AS spam, ham::BIGINT AS ham, ((spam::BIGINT << 32) | ham::BIGINT) AS packed FROM agg"),
    "network_score": q(VOTES, LATEST, "SELECT fp, round(spam / (spam + ham), 6) AS score FROM agg WHERE spam + ham >= 3"),
    "vote_receipts": q(VOTES, "m AS (SELECT seq, fp, verdict IS DISTINCT FROM lag(verdict) OVER w AS changed, row_number() OVER w = 1 AS first FROM votes WINDOW w AS (PARTITION BY fp, tenant ORDER BY seq))", "SELECT seq, changed, sum(first::INT) OVER (PARTITION BY fp ORDER BY seq)::BIGINT AS distinct_tenants FROM m"),
    "feedback_ingest": q(*PARTS, "SELECT fp, count(*) AS votes FROM prints JOIN content USING (cid) WHERE cid % 3 = 0 AND strlen(text) <= 65536 GROUP BY fp"),
    "rate_limit": q("r AS (SELECT event_id AS id, user_id::VARCHAR AS tenant, epoch(ts) AS sec, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)",
        "f AS (SELECT id, tenant, sec, n, sec AS start, 1 AS used, true AS accepted FROM r WHERE n = 1 UNION ALL SELECT r.id, r.tenant, r.sec, r.n, if(r.sec - f.start >= 86400, r.sec, f.start), if(r.sec - f.start >= 86400, 1, least(2, f.used + 1)), r.sec - f.start >= 86400 OR f.used < 2 FROM f JOIN r ON r.tenant = f.tenant AND r.n = f.n + 1)",
        "SELECT id, tenant, accepted, if(accepted, NULL, greatest(1, floor(86400 - (sec - start))))::BIGINT AS retry_after FROM f", recursive=True),
    "credential_check": "SELECT s_suppkey AS row, CASE WHEN length(k) < 32 THEN 'too_short' WHEN NOT regexp_full_match(t, '[A-Za-z0-9_-]{1,64}') THEN 'invalid_tenant' WHEN row_number() OVER (PARTITION BY k ORDER BY s_suppkey) > 1 THEN 'duplicate_key' WHEN row_number() OVER (PARTITION BY t ORDER BY s_suppkey) > 1 THEN 'duplicate_tenant' END AS error FROM (SELECT s_suppkey, if(s_suppkey % 11 = 0, 'short', sha256((s_suppkey // 2 * 2 + (s_suppkey % 3 = 0)::INT)::VARCHAR)) AS k, if(s_suppkey % 7 = 0, 'bad tenant', 'tenant-' || s_suppkey % 40) AS t FROM supplier)",
    "bearer_parse": "SELECT c_custkey AS id, CASE WHEN c_custkey % 5 IN (0, 1) THEN 'key' || c_custkey END AS token FROM customer",
    "auth_lookup": "SELECT c_custkey AS id, CASE WHEN c_custkey % 5 IN (0, 1) AND c_custkey % 3 = 0 THEN substr(sha256('t' || c_custkey), 1, 32) END AS tenant_id FROM customer",
    "parse_key_list": "SELECT s_suppkey AS id, 'a' || s_suppkey AS tenant, 'k=' || s_suppkey AS api_key FROM supplier UNION ALL SELECT s_suppkey, 'b', 'x' FROM supplier",
    "batch_cap": "SELECT user_id % 10 AS batch, count(*) AS items, count(*) <= 1000 AS ok FROM events GROUP BY user_id % 10",
    "oversize_text": "SELECT doc_id, strlen(text)::BIGINT AS bytes, strlen(text) > 65536 AS oversize FROM documents",
    "mcp_limits": "SELECT page_id, length(html) >= 1 AND strlen(html) <= 65536 AND length(url) <= 45 AS ok FROM pages",
    "request_decode": "SELECT page_id AS id, url AS text, if(page_id % 3 = 0, 'review', 'other') AS context, page_id % 5 <> 0 AS ok FROM pages",
    "response_invariants": q(*ASSESS, "SELECT count(*) AS rows_, count(*) = (SELECT count(*) FROM content) AS same_length, bool_and(spam BETWEEN 0 AND 1 AND slop BETWEEN 0 AND 1) AS in_unit, bool_and(reasons IS NOT NULL) AS reasons_ok FROM assessed"),
    "src_jsonl": "SELECT doc_id + 1 AS line, doc_id::VARCHAR AS id, text FROM documents",
    "validate_records": "SELECT doc_id + 1 AS line, CASE WHEN doc_id % 50 = 3 THEN 'json' WHEN doc_id % 50 = 0 THEN 'empty_id' WHEN doc_id % 50 = 1 THEN 'empty_text' WHEN doc_id % 50 = 2 THEN 'no_labels' WHEN doc_id % 50 = 4 AND doc_id > 4 THEN 'duplicate_id' END AS error FROM documents",
    "strict_json": "SELECT doc_id + 1 AS line FROM documents WHERE doc_id % 50 = 3",
    "duplicate_ids": "SELECT doc_id + 1 AS line FROM documents WHERE doc_id % 50 = 4 AND doc_id > 4",
    "first_error": "SELECT min(line) AS line, arg_min(error, line) AS error FROM (SELECT doc_id + 1 AS line, CASE WHEN doc_id % 50 = 3 THEN 'json' WHEN doc_id % 50 = 0 THEN 'empty_id' WHEN doc_id % 50 = 1 THEN 'empty_text' WHEN doc_id % 50 = 2 THEN 'no_labels' WHEN doc_id % 50 = 4 AND doc_id > 4 THEN 'duplicate_id' END AS error FROM documents) WHERE error IS NOT NULL",
    "import_tsv": "SELECT 'sms:' || (c_custkey + 1) AS id, c_name || chr(9) || c_mktsegment AS text, c_nationkey % 2 = 1 AS spam FROM customer",
    "import_csv_dedup": "SELECT DISTINCT 'yt:Comments:' || o_orderstatus || o_orderpriority AS id, 'says \"' || o_orderpriority || '\"' || chr(10) || 'ok, ' || o_orderstatus AS text, o_orderstatus = 'F' AS spam FROM orders",
    "import_domains": "SELECT DISTINCT lower(split_part(split_part(url, '://', 2), '/', 1)) AS domain FROM pages",
    "seed_ip_ranges": "SELECT '10.' || s_suppkey % 300 || '.' || s_nationkey AS key, 0.5::DOUBLE AS score FROM supplier WHERE s_suppkey % 300 < 256",
    "verify_sha256": "SELECT strlen(t)::BIGINT AS length, sha256(t) AS sha256, true AS matches FROM (SELECT string_agg(n_name || chr(10), '' ORDER BY n_nationkey) AS t FROM nation)",
    "count_gate": "SELECT count(*) AS records, count(*) BETWEEN 1 AND 100000 AS ok FROM documents",
    "source_select": "SELECT DISTINCT source AS id FROM documents WHERE source IN ('src1', 'src2')",
    "sink_roundtrip": "SELECT doc_id, text, lang FROM documents",
}
