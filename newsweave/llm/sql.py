"""SQL twins of the operators' queries, for DuckDB over the same tables."""

_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORD = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

WINNOWING = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         coalesce(regexp_extract_all(translate(text, {_LOWER}), {_WORD}), []) AS w
  FROM documents
), b AS (
  SELECT DISTINCT item_id, regexp_extract_all(translate(text, {_LOWER}), {_WORD}) AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i
        FROM b WHERE len(w) > 0)
), dw AS (
  SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)
), hit AS (
  SELECT rid, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win
), words AS (
  SELECT rid, count(DISTINCT p) AS n_hit
  FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT rid, i, n FROM hit)) GROUP BY rid
), items AS (
  SELECT rid, list_sort(list(DISTINCT item_id::VARCHAR)) AS ids FROM hit WHERE item_id IS NOT NULL GROUP BY rid
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(len(ids), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""

_PII = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true", "mail|contact|kontakt|correo|courriel"),
    "ip": (
        r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "list_max(list_transform(string_split(m, '.'), lambda x: CASE WHEN length(ltrim(x, '0')) > 3 THEN 999 ELSE ('0' || x)::HUGEINT END)) <= 255",
        "ip|addr|host|server|client",
    ),
    "card": (
        r"[0-9]([\x20-]?[0-9])+",
        "length(d) BETWEEN 16 AND 19 AND list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN i % 2 = 1"
        " THEN d[length(d) + 1 - i]::INT ELSE d[length(d) + 1 - i]::INT * 2 // 10 + d[length(d) + 1 - i]::INT * 2 % 10 END)) % 10 = 0",
        "card",
    ),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "length(d) BETWEEN 8 AND 15", "phone"),
    "iban": (
        "[A-Z0-9]{15,}",
        "regexp_full_match(m, '[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}') AND list_reduce(list_prepend(0::BIGINT, list_transform("
        "string_split(m[5:] || m[:4], ''), lambda x: CASE WHEN x <= '9' THEN x::BIGINT ELSE ord(x) - 55 END)),"
        " lambda a, x: CASE WHEN x > 9 THEN (a * 100 + x) % 97 ELSE (a * 10 + x) % 97 END) = 1",
        "iban",
    ),
    "ssn": (
        "[0-9-]{11,}",
        "regexp_full_match(m, '[0-9]{3}-[0-9]{2}-[0-9]{4}')"
        " AND regexp_matches(lower(t[greatest(s - 40, 0) + 1:s]), 'ssn|social security')",
        "ssn",
    ),
}


def _pii_kind(place: int, kind: str) -> str:
    pattern, valid, _ = _PII[kind]
    return f"""
  SELECT rid, {place} AS k, '{kind}' AS kind, s, s + length(m) AS e
  FROM (SELECT *, regexp_replace(m, '[^0-9]', '', 'g') AS d,
               sum(length(p) + length(m)) OVER (PARTITION BY rid ORDER BY i) - length(m) AS s
        FROM (SELECT rid, t, i, ps[i] AS p, ms[i] AS m
              FROM (SELECT rid, t, ps, ms, unnest(range(1, len(ms) + 1)) AS i
                    FROM (SELECT rid, t, string_split_regex(t, '{pattern}') AS ps,
                                 regexp_extract_all(t, '{pattern}') AS ms FROM d))))
  WHERE {valid}"""


PERSONAL_DATA = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), spans AS ({" UNION ALL ".join(_pii_kind(i, kind) for i, kind in enumerate(_PII))}
), joined AS (
  SELECT rid, count(*) FILTER (k = 0) AS n_email, count(*) FILTER (k = 1) AS n_ip,
         count(*) FILTER (k = 2) AS n_card, count(*) FILTER (k = 3) AS n_phone,
         string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY k, s) FILTER (k < 4) AS base,
         string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY k, s) AS spans
  FROM spans GROUP BY rid
)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card,
       coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN joined USING (rid)
"""

MIXING = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(text, '')) AS key
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY source ASC NULLS LAST) AS no
  FROM d GROUP BY source
), w AS (
  SELECT *, [5, 2, 1][(no - 1) % 3 + 1] AS weight, sum(source_size) OVER ()::DOUBLE AS total FROM s
), l AS (
  SELECT *, (total * 1.5::DOUBLE - coalesce(sum(source_size) OVER (ORDER BY source_size::DOUBLE / weight, no
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE * 2)
            / (sum(weight) OVER (ORDER BY source_size::DOUBLE / weight, no
               ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM w
), t AS (
  SELECT source, source_size, coalesce(least(weight * (SELECT level FROM l WHERE level * weight <= source_size * 2::DOUBLE
           ORDER BY source_size::DOUBLE / weight, no LIMIT 1), source_size * 2::DOUBLE), 0) AS target
  FROM l
), p AS (
  SELECT rid, doc_id, key, size, d.source, source_size, target,
         1 - pow((('0x' || key[1:13])::BIGINT::DOUBLE + 0.5) / 4503599627370496::DOUBLE,
                 1 / coalesce(CASE quality WHEN 1 THEN 1.5 WHEN 0 THEN 0.5 END, 1)::DOUBLE) AS place
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
  LEFT JOIN (SELECT doc_id AS label_id, min(quality) AS quality FROM labels GROUP BY doc_id) ON doc_id = label_id
), b AS (
  SELECT *, floor(target)::BIGINT AS budget,
         CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS epochs,
         coalesce(sum(size) OVER (PARTITION BY source ORDER BY place, doc_id, key
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier
  FROM p
)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(least(budget - epochs * source_size - earlier, size), 0))::BIGINT AS taken
FROM b
"""

VECTOR_LINKS = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS rid, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), ok AS (
  SELECT * FROM v
  WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NOT NULL AND isfinite(x))) = len(e)
    AND list_max(list_transform(e, lambda x: abs(x))) > 0
), l AS (
  SELECT a.rid AS a, b.rid AS b FROM ok a JOIN ok b ON a.label = b.label AND a.rid <> b.rid AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), r(a, b) AS (
  SELECT rid, rid FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), c AS (
  SELECT r.a AS rid, min(vec_id) AS component_id FROM r JOIN v ON r.b = v.rid GROUP BY r.a
)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM v JOIN c USING (rid) LEFT JOIN (SELECT a AS rid, count(*) AS n FROM l GROUP BY a) USING (rid)
"""

WARC = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS t, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS f FROM pages
)
SELECT page_id, strlen(t)::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
         ((('0x' || substr(sha1(t), i // 4 * 5 + 1, 5))::BIGINT >> (15 - i % 4 * 5)) & 31) + 1]), '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM f THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM f THEN f END AS refers_to
FROM p
"""

_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''),
       lambda x: ord(x)::BIGINT)), lambda a, x: list_reduce(list_prepend(xor(a, x), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
       lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))))"""

PREFIX_TRIE = f"""
WITH t AS (
  SELECT conv_id, turn, length(coalesce(text, ''))::BIGINT AS chars,
         md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS k
  FROM conversations WHERE conv_id IS NOT NULL
), o AS (
  SELECT conv_id, list({{'k': k, 'chars': chars}} ORDER BY turn NULLS FIRST, k) AS own, {_CRC32} % 6 AS h
  FROM t GROUP BY conv_id
), r AS (
  SELECT o.conv_id AS c, coalesce(b.own[1:o.h], []) || o.own[o.h + 1:] AS seq
  FROM o LEFT JOIN o b ON b.conv_id = o.conv_id - o.conv_id % 100
), p AS (
  SELECT c, d, len(seq) AS last, array_to_string(list_transform(seq[1:d], lambda x: x.k), ',') AS path,
         array_to_string(list_transform(seq[1:d - 1], lambda x: x.k), ',') AS up, CASE WHEN d > 0 THEN seq[d].chars ELSE 0 END AS chars
  FROM (SELECT *, unnest(range(0, len(seq) + 1)) AS d FROM r)
), n AS (
  SELECT path, d, any_value(up) AS up, any_value(chars) AS chars, min(c) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (last = d), '')) AS ends_sha256
  FROM p GROUP BY path, d
), k AS (
  SELECT up, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY up, d
), m AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k ON k.up = n.path AND k.d = n.d
), s AS (
  SELECT p.path, p.d, count(*) FILTER (m.n_children = 0) AS n_leaves, sum((m.n_convs - 1) * m.chars) AS saved
  FROM m JOIN p ON p.c = m.conv_id AND p.d <= m.d GROUP BY p.path, p.d
)
SELECT m.conv_id, m.d::BIGINT AS depth, (SELECT conv_id FROM m q WHERE q.path = m.up AND q.d = m.d - 1) AS parent_conv_id,
       m.n_convs, m.n_children, s.n_leaves, s.saved::BIGINT AS saved_tokens, m.ends_sha256
FROM m JOIN s ON s.path = m.path AND s.d = m.d
"""
