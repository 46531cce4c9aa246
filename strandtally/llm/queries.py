"""The queries of this subpackage, one for each operator, and SQL where SQL can state them."""

from __future__ import annotations

from strandtally.llm import audit, bpe, divergence, katz, langid, lattice, media, mixing, private, repeats, secrets, simhash, urls

QUERIES = {
    "op1_katz": katz.op1_katz,
    "op2_bpe": bpe.op2_bpe,
    "op3_simhash": simhash.op3_simhash,
    "op4_language": langid.op4_language,
    "op5_lattice": lattice.op5_lattice,
    "op6_media": media.op6_media,
    "op7_mixing": mixing.op7_mixing,
    "op8_secrets": secrets.op8_secrets,
    "op9_repeats": repeats.op9_repeats,
    "op10_private": private.op10_private,
    "op11_divergence": divergence.op11_divergence,
    "op12_urls": urls.op12_urls,
    "op13_audit": audit.op13_audit,
}

SQL = {
    "op5_lattice": """
        WITH RECURSIVE links AS (
          SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id
          WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.95),
        reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
        SELECT e.vec_id, (SELECT count(*) FROM links WHERE links.a = e.vec_id)::BIGINT AS n_links,
          (SELECT min(b) FROM reach WHERE reach.a = e.vec_id) AS component_id,
          e.vec_id = (SELECT min(b) FROM reach WHERE reach.a = e.vec_id) AS kept FROM embeddings e""",
    "op9_repeats": r"""
        WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        starts AS (SELECT doc_id, unnest(generate_series(1, len(w) - 19)) AS i, w FROM docs WHERE len(w) >= 20),
        windows AS (SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS s FROM starts),
        late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM windows) WHERE r > 1),
        gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 19)) AS j FROM late),
        marks AS (SELECT doc_id, list(j) AS js FROM gone GROUP BY doc_id)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(js), 0)::BIGINT AS n_removed,
          sha256(coalesce(array_to_string(CASE WHEN js IS NULL THEN w ELSE
            list_transform(list_filter(generate_series(1, len(w)), lambda k: NOT list_contains(js, k)), lambda k: w[k]) END, ' '), '')) AS kept_sha256
        FROM docs d LEFT JOIN marks m ON d.doc_id = m.doc_id""",
    "op11_divergence": r"""
        WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
        words AS (SELECT d, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
        kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT d) >= 30),
        groups AS (SELECT DISTINCT lang, source FROM docs),
        counts AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL),
        sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
        dense AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, coalesce(t.total, 0) AS total, v
          FROM groups g JOIN kept k USING (lang) JOIN sizes USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
          LEFT JOIN (SELECT lang, source, sum(n) AS total FROM counts GROUP BY ALL) t ON t.lang = g.lang AND t.source = g.source),
        shares AS (SELECT lang, source, term, n, (1 + (1000000000 * (n + 5)) // (total + 5 * v))::BIGINT AS p FROM dense),
        whole AS (SELECT lang, term, (1 + (1000000000 * (sum(n) + 5)) // (any_value(t) + 5 * any_value(v)))::BIGINT AS q
          FROM counts JOIN sizes USING (lang) JOIN (SELECT lang, sum(n) AS t FROM counts GROUP BY lang) USING (lang) GROUP BY lang, term),
        sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
          FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
        terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM shares JOIN whole USING (lang, term) WHERE n > 0 AND p > q)
        SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
        FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms) QUALIFY part = 'pair' OR rank <= 50""",
    "op12_urls": r"""
        WITH parts AS (SELECT page_id, coalesce(url, '') AS url,
            translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path,
            list_sort(list_filter(string_split(regexp_extract(coalesce(url, ''), '://[^/?#]*[^?#]*\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT starts_with(p, 'utm_'))) AS asked FROM pages),
        forms AS (SELECT *, CASE WHEN host <> '' THEN regexp_replace(regexp_replace(host, '^www\.', ''), ':(80|443)$', '') || regexp_replace(path, '/+$', '')
            || CASE WHEN len(asked) > 0 THEN '?' || array_to_string(asked, '&') ELSE '' END END AS canon,
            TRY_CAST(nullif(regexp_extract(path, '/([0-9]{1,18})', 1), '') AS BIGINT) AS number FROM parts),
        rules(verdict, rule_host, rule_path) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
        listed AS (SELECT DISTINCT canon FROM forms WHERE canon IS NOT NULL AND number IN (SELECT doc_id FROM labels WHERE toxic = 1)),
        judged AS (SELECT f.*, (SELECT max({'n': length(rule_host || rule_path), 'rule': rule_host || rule_path, 'verdict': r.verdict}) FROM rules r
            WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)) AS r FROM forms f)
        SELECT page_id, host, path, r.rule AS rule, CASE WHEN r IS NOT NULL THEN r.verdict WHEN canon IN (SELECT canon FROM listed) THEN 'block' ELSE 'allow' END AS verdict,
            CASE WHEN r IS NULL THEN coalesce(canon IN (SELECT canon FROM listed), false) END AS listed FROM judged""",
    "op13_audit": r"""
        WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        told AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
        marks AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, {'A': len(w) < 100, 'B': 100 * len(list_distinct(w)) < 80 * len(w),
            'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text), 'D': regexp_matches(text, '[#$%&*|]'),
            'E': coalesce(min(d.doc_id) OVER (PARTITION BY text) < d.doc_id, false)} AS m FROM docs d LEFT JOIN told t ON d.doc_id = t.doc_id),
        masks AS (SELECT part, m.A AS a, m.B AS b, m.C AS c, m.D AS d, m.E AS e, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM marks GROUP BY ALL),
        letters(f) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
        orders AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a, letters b, letters c, letters d, letters e
          WHERE length(replace(replace(replace(replace(replace(a.f || b.f || c.f || d.f || e.f, 'A', ''), 'B', ''), 'C', ''), 'D', ''), 'E', '')) = 0 AND len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
        steps AS (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM orders),
        failing AS (SELECT part, n, good, toxic, CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END || CASE WHEN c THEN 'C' ELSE '' END || CASE WHEN d THEN 'D' ELSE '' END || CASE WHEN e THEN 'E' ELSE '' END AS bad FROM masks),
        seen AS (SELECT part, filter_order, step, n, good, toxic, bad, contains(bad, filter_order[step]) AS hit,
            len(list_filter(string_split(filter_order[1:step - 1], ''), lambda x: x <> '' AND contains(bad, x))) > 0 AS gone FROM failing, steps),
        figures AS (SELECT part, filter_order, step, coalesce(sum(n) FILTER (NOT hit AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (hit AND NOT gone), 0)::BIGINT AS removed,
            coalesce(sum(n) FILTER (hit AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (bad = filter_order[step]), 0)::BIGINT AS unique_fails,
            coalesce(sum(good) FILTER (hit AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (hit AND NOT gone), 0)::BIGINT AS toxic_lost FROM seen GROUP BY ALL)
        SELECT * EXCLUDE (filter), sum(removed) OVER (PARTITION BY part, filter)::BIGINT AS shapley FROM (SELECT *, filter_order[step] AS filter FROM figures)""",
}
