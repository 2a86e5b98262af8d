"""DuckDB twins of the corpus queries that SQL can express."""

OP2 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s
  FROM words
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, e.b FROM reach r JOIN ways e ON e.a = r.other
), component AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN component USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""

OP3 = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v WHERE list_dot_product(e, e) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.95
), reach AS (
  SELECT vec_id, vec_id AS other FROM embeddings UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON l.a = r.other
), component AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY 1
), degree AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY 1)
SELECT c.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, c.vec_id = component_id AS kept
FROM component c LEFT JOIN degree USING (vec_id)
"""

OP8 = r"""
WITH pages AS (SELECT DISTINCT source, text FROM documents WHERE text IS NOT NULL
), totals AS (SELECT source, count(*) AS pages FROM pages GROUP BY 1
), lines AS (SELECT DISTINCT source, text, trim(unnest(string_split(text, chr(10)))) AS line FROM pages
), boilerplate AS (
  SELECT l.source, line FROM lines l JOIN totals t ON l.source IS NOT DISTINCT FROM t.source
  WHERE line <> '' GROUP BY l.source, line, pages HAVING count(*) >= 3 AND count(*) > 0.01::DOUBLE * pages + 2.326::DOUBLE * sqrt(0.01::DOUBLE * (1 - 0.01::DOUBLE) * pages)
), per_source AS (SELECT source, list(line) AS lines FROM boilerplate GROUP BY 1
), kept AS (
  SELECT doc_id, d.source, text, string_split(text, chr(10)) AS all_lines,
    list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(coalesce(lines, []), trim(x))) AS rest
  FROM documents d LEFT JOIN per_source p ON d.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, source,
  CASE WHEN text IS NULL OR len(all_lines) = len(rest) THEN text ELSE array_to_string(rest, chr(10)) END AS text,
  coalesce(len(all_lines) - len(rest), 0)::BIGINT AS dropped_lines
FROM kept
"""

OP9 = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substring(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), judged AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), outcomes AS (
  SELECT host, 1 - quality AS bad FROM judged JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY 1) l
    ON doc_id = TRY_CAST(regexp_extract(path, '^/[^/]*/(\d{1,18})', 1) AS BIGINT)
  WHERE quality IS NOT NULL
), counted AS (
  SELECT host, sum(n)::DOUBLE AS n, sum(s)::DOUBLE AS s FROM (SELECT host, 1 AS n, bad AS s FROM outcomes UNION ALL SELECT host, 0, 0 FROM judged WHERE host <> '') GROUP BY 1
), names AS (
  SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS name FROM counted
), parts AS (
  SELECT *, string_split(name, '.') AS p, regexp_matches(name, '(^|\.)(ac|co|com|edu|go|gob|gov|ltd|me|mil|ne|net|nhs|nom|or|org|plc|sch)\.[a-z]{2}$') AS long_suffix,
    regexp_matches(name, '^[0-9.]+$|^\[') AS address FROM names
), hosts AS (
  SELECT host, n, s, CASE WHEN address THEN name WHEN long_suffix THEN array_to_string(p[-3:], '.') ELSE array_to_string(p[-2:], '.') END AS domain,
    CASE WHEN address THEN name WHEN long_suffix THEN array_to_string(p[-2:], '.') ELSE p[-1] END AS suffix FROM parts
), domains AS (SELECT suffix, domain, sum(n) AS n, sum(s) AS s FROM hosts GROUP BY 1, 2
), suffixes0 AS (SELECT suffix, sum(n) AS n, sum(s) AS s FROM domains GROUP BY 1
), overall AS (SELECT (sum(s) + 1) / (sum(n) + 2) AS m FROM suffixes0
), suffixes1 AS (SELECT suffix, n, (s + 10.0::DOUBLE * m) / (n + 10.0::DOUBLE) AS m FROM suffixes0, overall
), spread_s AS (
  SELECT d.suffix, count(*) AS c, sum(d.n * ((d.s / d.n - m) ** 2 - m * (1 - m) / d.n)) / sum(d.n) AS between_ FROM domains d JOIN suffixes1 USING (suffix) WHERE d.n > 0 GROUP BY 1
), suffixes AS (
  SELECT suffix, m, CASE WHEN n = 0 THEN 10.0::DOUBLE WHEN c >= 2 AND between_ > 0 THEN least(greatest(m * (1 - m) / between_ - 1, 1.0::DOUBLE), 200.0::DOUBLE) ELSE 200.0::DOUBLE END AS k
  FROM suffixes1 LEFT JOIN spread_s USING (suffix)
), domains1 AS (SELECT suffix, domain, n, k AS given, (s + k * m) / (n + k) AS m FROM domains JOIN suffixes USING (suffix)
), spread_d AS (
  SELECT h.domain, count(*) AS c, sum(h.n * ((h.s / h.n - m) ** 2 - m * (1 - m) / h.n)) / sum(h.n) AS between_ FROM hosts h JOIN domains1 USING (domain) WHERE h.n > 0 GROUP BY 1
), domains2 AS (
  SELECT domain, m, CASE WHEN n = 0 THEN given WHEN c >= 2 AND between_ > 0 THEN least(greatest(m * (1 - m) / between_ - 1, 1.0::DOUBLE), 200.0::DOUBLE) ELSE 200.0::DOUBLE END AS k
  FROM domains1 LEFT JOIN spread_d USING (domain)
), posterior AS (SELECT host, s + k * m AS a, n + k - (s + k * m) AS b, 1.5::DOUBLE * (SELECT m FROM overall) AS c FROM hosts JOIN domains2 USING (domain)
), sided AS (
  SELECT host, c <= (a + 1) / (a + b + 2) AS upper, CASE WHEN c <= (a + 1) / (a + b + 2) THEN a ELSE b END AS p, CASE WHEN c <= (a + 1) / (a + b + 2) THEN b ELSE a END AS q, CASE WHEN c <= (a + 1) / (a + b + 2) THEN c ELSE 1 - c END AS x FROM posterior WHERE c < 1
), fraction AS (
  SELECT *, list_reduce(list_concat([1.0::DOUBLE], list_transform(range(1200, 0, -1), lambda j: j::DOUBLE)), lambda k, j: 1 + CASE WHEN j % 2 = 0 THEN (j / 2) * (q - j / 2) * x / ((p + j - 1) * (p + j))
    ELSE -(p + (j - 1) / 2) * (p + q + (j - 1) / 2) * x / ((p + j - 1) * (p + j)) END / k) AS k FROM sided
), parts_ AS (SELECT host, upper, exp(lgamma(p + q) - lgamma(p) - lgamma(q) + p * ln(x) + q * ln(1 - x)) / p / k AS part FROM fraction
), known AS (SELECT host, CASE WHEN upper THEN 1 - part ELSE part END AS probability FROM parts_
), rules(action, rule_host, rule_path) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), best AS (
  SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(action, length(rule_host || rule_path)) AS action
  FROM judged JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY 1
)
SELECT j.page_id, j.host, j.path, rule, coalesce(action, CASE WHEN probability >= 0.95::DOUBLE THEN 'block' ELSE 'allow' END) AS verdict
FROM judged j LEFT JOIN known USING (host) LEFT JOIN best USING (page_id)
"""

OP12 = r"""
WITH words AS (
  SELECT rowid AS row, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS rowid, doc_id, text FROM documents)
), wanted AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), sized AS (
  SELECT row, count(*) AS n FROM words GROUP BY row
), totals AS (
  SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sized
), postings AS (
  SELECT row, doc_id, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM wanted) GROUP BY row, doc_id, term
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM postings, totals GROUP BY term
), impacts AS (
  SELECT row, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))) AS part
  FROM postings JOIN sized USING (row) JOIN weights USING (term), totals
), scores AS (
  SELECT item_id, row, doc_id, CAST(sum(part) AS BIGINT) AS score FROM wanted JOIN impacts USING (term) GROUP BY item_id, row, doc_id
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scores WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
