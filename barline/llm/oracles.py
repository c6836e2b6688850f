"""SQL for the registered queries of this subpackage."""

ORACLES: dict[str, str] = {}

ORACLES["op1_decontaminate"] = r"""
WITH texts AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
split AS (
  SELECT kind, id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM texts),
item_windows AS (
  SELECT DISTINCT id AS item_id, least(len(w), 10) AS n, array_to_string(w[i : i + 9], ' ') AS win
  FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM split WHERE kind = 'b' AND len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM item_windows),
doc_windows AS (
  SELECT id AS doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM split, sizes WHERE kind = 'd' AND len(w) >= n)),
found AS (SELECT d.doc_id, d.i, d.n, b.item_id FROM doc_windows d JOIN item_windows b USING (n, win)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM found) GROUP BY 1)
SELECT id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM split LEFT JOIN hit ON id = hit.doc_id LEFT JOIN items ON id = items.doc_id WHERE kind = 'd'"""

CRC_TABLE = """crc_table AS (
  SELECT list(c ORDER BY b) AS t FROM (
    SELECT b, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) AS c
    FROM range(256) r(b)))"""

ORACLES["op5_interleave_shards"] = f"""
WITH {CRC_TABLE},
bytes AS (
  SELECT doc_id, source, text, coalesce(strlen(text), 0) + 1 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
rows AS (
  SELECT doc_id, source, size,
    xor(4294967295, list_reduce(list_transform(range(size - 1), lambda i: CAST(CAST('0x' || h[2 * i + 1 : 2 * i + 2] AS INTEGER) AS BIGINT)),
      lambda c, b: xor(c >> 8, t[1 + xor(c & 255, b)]), 4294967295)) AS text_crc32,
    md5('42:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || CASE WHEN text IS NULL THEN ':n:' ELSE ':t:' END
      || md5(coalesce(text, ''))) AS shuffled
  FROM bytes, crc_table),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY shuffled, doc_id, text_crc32, size) - 1 AS rank,
    count(*) OVER (PARTITION BY source) AS n_source, count(*) OVER () AS total FROM rows),
placed AS (
  SELECT *, row_number() OVER (
    ORDER BY CAST(2 * rank + 1 AS DOUBLE) / CAST(2 * n_source AS DOUBLE), source NULLS FIRST, rank) - 1 AS place FROM ranked),
dealt AS (SELECT *, place * 8 // total AS shard FROM placed)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'rows' AS law, CAST(shard AS INTEGER) AS shard,
  place - (shard * total + 7) // 8 AS slot, CAST(NULL AS INTEGER) AS grown_shard, source FROM dealt"""

ORACLES["op10_top_products"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM (SELECT DISTINCT * FROM v WHERE vec_id % 20 = 0) q JOIN v c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores) WHERE rank <= 20"""


ORACLES["op9_repeated_passages"] = r"""
WITH split AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
windows AS (
  SELECT row, doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS win
  FROM (SELECT row, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM split WHERE len(w) >= 50 AND doc_id IS NOT NULL)),
owners AS (SELECT win, min(doc_id) AS owner FROM windows GROUP BY 1),
gone AS (
  SELECT DISTINCT row, p FROM (
    SELECT row, unnest(range(i, i + 50)) AS p FROM windows JOIN owners USING (win) WHERE doc_id > owner)),
lists AS (SELECT row, list(p) AS gone FROM gone GROUP BY 1),
places AS (SELECT row, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM split WHERE row IN (SELECT row FROM lists)),
kept AS (
  SELECT row, string_agg(word, ' ' ORDER BY p) AS text FROM places ANTI JOIN gone USING (row, p) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN gone IS NULL THEN array_to_string(w, ' ') ELSE coalesce(kept.text, '') END) AS kept_sha256
FROM split LEFT JOIN lists USING (row) LEFT JOIN kept USING (row)"""


ORACLES["op8_jaccard_join"] = r"""
WITH RECURSIVE split AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
shingles AS (
  SELECT DISTINCT row, array_to_string(w[i : i + 4], ' ') AS s
  FROM (SELECT row, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM split WHERE len(w) > 0)),
sizes AS (SELECT row, count(*) AS n FROM shingles GROUP BY 1),
links AS (
  SELECT a, b FROM (SELECT x.row AS a, y.row AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.row <> y.row GROUP BY 1, 2)
  JOIN sizes p ON p.row = a JOIN sizes q ON q.row = b WHERE 10 * c >= 8 * (p.n + q.n - c)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
classes AS (SELECT a AS row, min(doc_id) AS other FROM reach JOIN split ON split.row = b GROUP BY 1),
degrees AS (SELECT a AS row, count(*) AS n_links FROM links GROUP BY 1)
SELECT doc_id, least(doc_id, other) AS class_id, coalesce(n_links, 0) AS n_links
FROM split LEFT JOIN classes USING (row) LEFT JOIN degrees USING (row)"""


ORACLES["op3_url_filter"] = r"""
WITH parts AS (
  SELECT page_id, DATE '2023-01-01' + CAST(page_id * 37 % 730 AS INTEGER) AS fetched,
    nullif(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#]*@)?([^/?#:]+)', 1), '') AS host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM pages),
captures AS (SELECT row_number() OVER () AS id, *, host || CASE WHEN path = '' THEN '/' ELSE path END AS page, string_split(host, '.') AS labels FROM parts),
names AS (
  SELECT DISTINCT 'hosts' AS list, host AS entry FROM captures UNION ALL SELECT DISTINCT 'pages', page FROM captures
  UNION ALL SELECT DISTINCT 'domains', array_to_string(labels[greatest(len(labels) - 1, 1) :], '.') FROM captures),
drawn AS (SELECT * FROM (SELECT *, CAST('0x' || md5(list || '|' || entry)[1:8] AS BIGINT) AS x FROM names WHERE entry IS NOT NULL) WHERE x % 5 = 0),
events AS (
  SELECT list, entry, 'add' AS action, x // 5 % 600 AS d FROM drawn
  UNION ALL SELECT list, entry, 'remove', x // 5 % 600 + 20 + x // 7 % 150 FROM drawn
  UNION ALL SELECT list, entry, 'add', x // 5 % 600 + 200 FROM drawn WHERE x // 11 % 2 = 0),
days AS (SELECT list, entry, DATE '2023-01-01' + CAST(d AS INTEGER) AS day, max(action) AS action FROM events GROUP BY ALL),
keys AS (
  SELECT id, fetched, page AS k FROM captures
  UNION SELECT id, fetched, array_to_string(labels[i:], '.') FROM (SELECT id, fetched, labels, unnest(range(1, len(labels) + 1)) AS i FROM captures)),
found AS (
  SELECT id, list || ':' || entry AS e FROM (
    SELECT k.id, e.list, e.entry, arg_max(action, day) AS state FROM keys k JOIN days e ON e.entry = k.k AND e.day <= k.fetched GROUP BY ALL)
  WHERE state = 'add'),
lists AS (SELECT id, count(*) AS n, string_agg(e, ',' ORDER BY e) AS entries FROM found GROUP BY 1)
SELECT page_id, fetched, host, n IS NOT NULL AS blocked, CAST(coalesce(n, 0) AS INTEGER) AS n_entries, coalesce(entries, '') AS entries
FROM captures LEFT JOIN lists USING (id)"""

ORACLES["op6_chat_format"] = r"""
WITH turns AS (
  SELECT conv_id, turn, role, text, '<|im_start|>' || replace(coalesce(role, ''), '<|im_', '< |im_') || chr(10)
    || replace(coalesce(text, ''), '<|im_', '< |im_') || '<|im_end|>' || chr(10) AS shown FROM conversations),
convs AS (
  SELECT conv_id, list({'r': role, 't': text} ORDER BY turn, role, text) AS l, string_agg(shown, '' ORDER BY turn, role, text) AS text
  FROM turns WHERE conv_id IS NOT NULL GROUP BY 1),
one_each AS (SELECT min(conv_id) AS conv_id, l, any_value(text) AS text FROM convs GROUP BY l)
SELECT conv_id, CAST(len(l) AS BIGINT) AS n_turns, text FROM one_each a
WHERE NOT EXISTS (SELECT 1 FROM one_each b WHERE b.l[1] = a.l[1] AND len(b.l) > len(a.l) AND b.l[1 : len(a.l)] = a.l)"""


ORACLES["op12_prefix_trie"] = rf"""
WITH {CRC_TABLE},
turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, list({{'r': role, 't': text}} ORDER BY turn NULLS FIRST, md5(md5(role) || md5(text))) AS l, hex(encode(CAST(conv_id AS VARCHAR))) AS h
  FROM turns GROUP BY conv_id),
heads AS (
  SELECT conv_id, l, xor(4294967295, list_reduce(list_transform(range(len(h) // 2), lambda i: CAST(CAST('0x' || h[2 * i + 1 : 2 * i + 2] AS INTEGER) AS BIGINT)),
    lambda c, b: xor(c >> 8, t[1 + xor(c & 255, b)]), 4294967295)) % 4 AS h FROM convs, crc_table),
rebuilt AS (
  SELECT a.conv_id, list_concat(coalesce(b.l[1 : a.h], []), a.l[a.h + 1 :]) AS l FROM heads a LEFT JOIN convs b ON b.conv_id = a.conv_id - a.conv_id % 20),
starts AS (SELECT conv_id, d, len(l) AS n, l[1 : d] AS p FROM (SELECT conv_id, l, unnest(range(len(l) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT d, p, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256,
    (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(p[d].t, '[^\x20\x09-\x0D]+')) END AS saved
  FROM starts GROUP BY d, p),
parents AS (
  SELECT c.d, c.p, q.conv_id AS parent_conv_id FROM nodes c JOIN nodes q ON q.d = c.d - 1 AND q.p = c.p[1 : c.d - 1]),
children AS (SELECT d - 1 AS d, p[1 : d - 1] AS p, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1, 2),
told AS (SELECT nodes.*, coalesce(children.n, 0) AS n_children FROM nodes LEFT JOIN children ON children.d = nodes.d AND children.p = nodes.p),
above AS (SELECT n_children, saved, p, unnest(range(d + 1)) AS up FROM told),
totals AS (SELECT up AS d, p[1 : up] AS p, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM above GROUP BY 1, 2)
SELECT conv_id, told.d AS depth, parent_conv_id, n_convs, n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256
FROM told JOIN totals ON totals.d = told.d AND totals.p = told.p LEFT JOIN parents ON parents.d = told.d AND parents.p = told.p"""

ORACLES["op13_filter_audit"] = r"""
WITH docs AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
firsts AS (SELECT text, min(doc_id) AS first FROM docs GROUP BY text),
split AS (
  SELECT doc_id, part, text, coalesce(doc_id > first, false) AS again, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM docs JOIN firsts USING (text)),
marks AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
judged AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    (CASE WHEN len(w) < 200 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END)
    || (CASE WHEN 100 * (length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 3 * length(text) THEN 'C' ELSE '' END)
    || (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN again THEN 'E' ELSE '' END) AS fails
  FROM split LEFT JOIN marks USING (doc_id)),
counts AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM judged GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a, f b, f c, f d, f e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM orders),
met AS (
  SELECT part, filter_order, step, n, good, toxic, fails = filter_order[step] AS alone, contains(fails, filter_order[step]) AS fail,
    len(list_filter(string_split(filter_order[1 : step - 1], ''), lambda x: x <> '' AND contains(fails, x))) = 0 AS passed
  FROM counts, steps),
audit AS (
  SELECT part, filter_order, CAST(step AS INTEGER) AS step, sum(n) FILTER (passed AND NOT fail) AS kept, sum(n) FILTER (passed AND fail) AS removed,
    sum(n) FILTER (fail AND NOT passed) AS redundant, sum(n) FILTER (alone) AS unique_fails, sum(good) FILTER (passed AND fail) AS good_lost,
    sum(toxic) FILTER (passed AND fail) AS toxic_lost FROM met GROUP BY part, filter_order, step)
SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
  CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(removed) OVER (PARTITION BY part, filter_order[step]), 0) AS BIGINT) AS shapley FROM audit"""
