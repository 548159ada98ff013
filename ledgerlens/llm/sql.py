"""DuckDB statements for the queries that SQL can express."""

_WORDS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

DECONTAMINATION = f"""
WITH doc AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
item AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
win AS (
  SELECT item_id, least(len(w), 10) AS k, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p, w FROM item WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS s FROM win),
sizes AS (SELECT DISTINCT k FROM windows),
place AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS p, w FROM doc, sizes WHERE len(w) >= k),
hit AS (
  SELECT DISTINCT doc_id, p, place.k, item_id
  FROM place JOIN windows ON windows.k = place.k AND windows.s = array_to_string(place.w[p:p + place.k - 1], ' ')),
word AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM hit) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id)
SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN word USING (doc_id) LEFT JOIN items USING (doc_id)
"""

WARC = """
WITH p AS (
  SELECT page_id, CAST(coalesce(octet_length(encode(html)), 0) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
  FROM pages),
w AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS kept FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN kept = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN kept <> page_id THEN kept END AS refers_to
FROM w
"""

COLLOCATIONS = r"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(string_split_regex(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w
  FROM documents),
place AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM piece, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k),
cnt AS (SELECT lang, w[p:p + k - 1] AS g, count(*) AS f FROM place GROUP BY ALL),
tot AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM cnt WHERE len(g) = 1 GROUP BY lang),
cand AS (SELECT lang, g, f FROM cnt WHERE len(g) >= 2 AND f >= 100),
part AS (SELECT lang, g, f, s, unnest(range(s + 1, len(g) + 1)) AS e FROM (SELECT lang, g, f, unnest(range(1, len(g))) AS s FROM cand)),
longer AS (SELECT lang, g[s:e] AS g, max(f) AS most FROM part WHERE e - s + 1 < len(g) GROUP BY ALL),
kept AS (SELECT c.* FROM cand c LEFT JOIN longer USING (lang, g) WHERE most IS NULL OR 100 * most < 100 * c.f),
cut AS (SELECT lang, g, f, unnest(range(1, len(g))) AS c FROM kept),
scored AS (
  SELECT cut.lang, cut.g, cut.f AS a, c, x.f AS l, y.f AS r, n,
         CAST((1000::HUGEINT * cut.f * n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM cut JOIN cnt x ON x.lang = cut.lang AND x.g = cut.g[1:c] JOIN cnt y ON y.lang = cut.lang AND y.g = cut.g[c + 1:] JOIN tot ON tot.lang = cut.lang),
lowest AS (SELECT *, array_to_string(g, ' ') AS phrase FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, c) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM lowest QUALIFY rank <= 2000
"""

SEARCH = r"""
WITH doc AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
item AS (
  SELECT row_number() OVER () AS iid, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
tot AS (SELECT count(*) AS docs, CAST(sum(len(w)) AS BIGINT) AS terms FROM doc WHERE len(w) > 0),
posting AS (SELECT rid, t, count(*) AS tf FROM (SELECT rid, unnest(w) AS t FROM doc) GROUP BY ALL),
weight AS (
  SELECT t, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM posting, tot GROUP BY t, docs),
asked AS (SELECT iid, t, count(*) AS k FROM (SELECT iid, unnest(w) AS t FROM item) GROUP BY ALL),
found AS (
  SELECT iid, rid, CAST(sum(k * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * len(w) * docs) // terms)))) AS BIGINT) AS score
  FROM asked JOIN posting USING (t) JOIN weight USING (t) JOIN doc USING (rid), tot GROUP BY iid, rid)
SELECT item_id, CAST(row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM found JOIN doc USING (rid) JOIN item USING (iid) WHERE score > 0 QUALIFY rank <= 10
"""
