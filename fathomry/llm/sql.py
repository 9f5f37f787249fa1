"""DuckDB SQL for the queries that SQL can express."""

ORACLE = {}

ORACLE["op10_line_dedup"] = r"""
WITH split AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), lines AS (
  SELECT r, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM split
), keyed AS (
  SELECT r, doc_id, i, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), bad AS (
  SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT r) >= 10
), marked AS (
  SELECT keyed.*, bad.k IS NOT NULL AS gone FROM keyed LEFT JOIN bad USING (k)
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count_if(gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SPACE = r"[\x20\x09-\x0D]+"

ORACLE["op8_minhash"] = rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(regexp_split_to_array({_LOWER}, '{_SPACE}'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w
         ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS g FROM d
), n AS (
  SELECT r, doc_id, len(g) AS n, CASE WHEN len(g) > 0 THEN md5(array_to_string(list_sort(g), chr(10))) END AS k, g FROM s
), rep AS (
  SELECT k, min(doc_id) AS id, any_value(n) AS n, any_value(g) AS g FROM n WHERE k IS NOT NULL GROUP BY k
), sh AS (
  SELECT id, n, unnest(g) AS t FROM rep
), link AS (
  SELECT a.id AS a, b.id AS b FROM sh a JOIN sh b USING (t)
  WHERE a.id < b.id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), arc AS (
  SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), reach AS (
  SELECT DISTINCT a AS x, a AS y FROM arc
  UNION
  SELECT reach.x, arc.b FROM reach JOIN arc ON arc.a = reach.y
), comp AS (
  SELECT x, min(y) AS c FROM reach GROUP BY x
)
SELECT n.doc_id, n.n AS n_shingles, coalesce(comp.c, rep.id, n.doc_id) AS component_id,
       n.doc_id = coalesce(comp.c, rep.id, n.doc_id) AS kept
FROM n LEFT JOIN rep ON n.k = rep.k LEFT JOIN comp ON comp.x = rep.id
"""

ORACLE["op9_decontam"] = rf"""
WITH dw AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array({_LOWER}, '{_GAP}'), lambda x: x <> '') AS w FROM documents
), iw AS (
  SELECT item_id, list_filter(regexp_split_to_array({_LOWER}, '{_GAP}'), lambda x: x <> '') AS w FROM benchmark
), iwin AS (
  SELECT item_id, w, least(10, len(w)) AS size, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM iw WHERE len(w) > 0
), win AS (
  SELECT DISTINCT item_id, size, array_to_string(w[s : s + size - 1], ' ') AS g FROM iwin
), dwin AS (
  SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM dw, (SELECT DISTINCT size FROM win) WHERE len(w) >= size
), hit AS (
  SELECT r, p, win.size AS size, item_id FROM dwin JOIN win ON dwin.size = win.size AND array_to_string(w[p : p + dwin.size - 1], ' ') = g
), pos AS (
  SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + size)) AS q FROM hit) GROUP BY r
), its AS (
  SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hit GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (r) LEFT JOIN its USING (r)
"""

_SAID = r"\### Assistant: </turn> ok"
_ESC = r"replace(replace({}, '\', '\s'), '<', '\l')"

ORACLE["op4_chat_format"] = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '{_SAID}'), (-7, 1, 'assistant', '{_SAID}')
), o AS (
  SELECT *, row_number() OVER w AS i, lag(role) OVER w AS prev, lead(role) OVER w AS nxt FROM c
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length({_ESC.format('text')})
           + CASE WHEN prev IS NULL OR prev <> role
                  THEN 8 + length(replace(replace({_ESC.format('role')}, '>', '\g'), chr(10), '\n')) ELSE 0 END
           + CASE WHEN nxt IS NULL OR nxt <> role THEN 8 ELSE 3 END)::BIGINT AS formatted_chars
FROM o GROUP BY conv_id
"""


def _license_sql() -> str:
    from .op05_license import MARKS, TEMPLATES, THRESHOLD, need_of, template_tokens

    rows = ", ".join(f"('{label}', {need_of(len(ts), THRESHOLD)}, [{', '.join(repr(t) for t in ts)}], [{', '.join(repr(m) for m in MARKS.get(label, ()))}]::VARCHAR[])" for label, ts in ((x, template_tokens(text)) for x, text in TEMPLATES))
    return rf"""
WITH t(label, need, ts, marks) AS (VALUES {rows}),
d AS (
  SELECT row_number() OVER () AS r, doc_id, {_LOWER} AS low FROM documents
), w AS (
  SELECT r, doc_id, low, list_filter(regexp_split_to_array(low, '{_GAP}'), lambda x: x <> '') AS w FROM d
), p AS (
  SELECT *, list_filter(range(0, len(w)), lambda i: w[i + 1] = 'mit' AND w[i + 2] = 'license') AS m,
         list_filter(range(0, len(w)), lambda i: w[i + 1] = 'apache' AND w[i + 2] = 'license') AS a,
         list_filter(range(0, len(w)), lambda i: w[i + 1] = 'general' AND w[i + 2] = 'public' AND w[i + 3] = 'license') AS g
  FROM w
), b AS (
  SELECT r, list_distinct(regexp_split_to_array(unnest(regexp_split_to_array(low, '\n[\x20\x09-\x0D]*\n')), '{_GAP}')) AS bw FROM d
), f AS (
  SELECT r, label, len(list_intersect(bw, ts)) / len(ts) AS share FROM b, t WHERE len(list_intersect(bw, ts)) >= need AND len(list_intersect(bw, marks)) = len(marks)
), lab AS (
  SELECT r, list_distinct(list(label)) AS ls, max(share) AS best FROM f GROUP BY r
), o AS (
  SELECT p.*, ls, best, list_concat(list_concat(m, a), g) AS st,
         list_filter([CASE WHEN len(a) > 0 THEN 'apache' END, CASE WHEN len(g) > 0 THEN 'gpl' END, CASE WHEN len(m) > 0 THEN 'mit' END], lambda x: x IS NOT NULL) AS bl
  FROM p LEFT JOIN lab USING (r)
)
SELECT doc_id, len(w)::BIGINT AS n_words, len(st)::BIGINT AS n_base, list_min(st) AS first_word, list_max(st) AS last_word,
       array_to_string(bl, ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(bl, coalesce(ls, [])))), ',') AS labels,
       CASE WHEN len(st) > 0 THEN 1.0 ELSE coalesce(best, 0.0) END::DOUBLE AS score
FROM o
"""


ORACLE["op5_license_scan"] = _license_sql()

ORACLE["op1_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, d.vec_id AS vec_id, list_dot_product(q.e, d.e)::BIGINT AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""

ORACLE["op2_warc"] = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages
), f AS (
  SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d
)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
       CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (d)
"""

#: Targets by water-filling in closed form: with sources in the order of cap / weight, the level is the first
#: (total - caps before) / (weights left) that doesn't reach the next source's cap.
ORACLE["op3_mix"] = rf"""
WITH d AS (
  SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}'), lambda x: x <> ''))::BIGINT AS size,
         ('0x' || substr(md5('17|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 15))::BIGINT AS h FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source
), w AS (
  SELECT source, source_size, [5.0, 2.0, 1.0][(place - 1) % 3 + 1]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap,
         (SELECT sum(source_size) FROM s)::BIGINT * 1.5::DOUBLE AS total FROM s
), o AS (
  SELECT *, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS i,
         coalesce(sum(cap) OVER p, 0) AS used, sum(weight) OVER () - coalesce(sum(weight) OVER p, 0) AS free
  FROM w WINDOW p AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT arg_min((total - used) / free, i) FILTER (WHERE (total - used) / free * weight < cap) AS level FROM o
), t AS (
  SELECT source, source_size, CASE WHEN level IS NULL OR weight * level >= cap THEN cap ELSE weight * level END AS target FROM w, l
), r AS (
  SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, source, size, source_size, target,
       (size * (whole + CASE WHEN before + size / 2.0 <= target - whole * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
"""

#: The remainders of crc32 for four bits.
_NIBBLES = [0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]
#: crc32 in two steps of four bits for each byte, over the hex digits of the UTF-8 text.
_CRC = f"""xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(hex({{0}})) + 1),
  lambda i: (strpos('0123456789ABCDEF', substr(hex({{0}}), CASE WHEN i % 2 = 1 THEN i + 1 ELSE i - 1 END, 1)) - 1)::BIGINT)),
  lambda c, x: xor(c >> 4, {_NIBBLES}[(xor(c, x) & 15) + 1])))"""

ORACLE["op11_variants"] = rf"""
WITH RECURSIVE runs AS (
  SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents
), each AS (
  SELECT run, coalesce(doc_id::VARCHAR, '') || ':' || run AS seed, count(*) AS k FROM runs WHERE length(run) >= 6 GROUP BY ALL
), hashed AS (
  SELECT run, k, {_CRC.format("seed")} AS h FROM each
), words AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, sum(k)::BIGINT AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= 6 AND n >= 5
), less AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS part FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
  SELECT a.word AS word, b.word AS other, b.n AS other_n FROM less a JOIN less b ON a.part = b.part AND a.i = b.i AND a.word <> b.word
  UNION
  SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.part = b.word
  UNION
  SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.part = b.word
), best AS (
  SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS other, max(other_n) AS other_n FROM near GROUP BY word
), held AS (
  SELECT words.word AS word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * n THEN other END AS form, CASE WHEN other_n >= 5 * n THEN other_n END AS form_n
  FROM words LEFT JOIN best USING (word)
), chain AS (
  SELECT word, word AS at FROM held
  UNION ALL
  SELECT chain.word, held.form FROM chain JOIN held ON held.word = chain.at WHERE held.form IS NOT NULL
), ends AS (
  SELECT chain.word AS word, chain.at AS root FROM chain JOIN held ON held.word = chain.at WHERE held.form IS NULL
)
SELECT word, form, root, n, n_near, form_n FROM held JOIN ends USING (word)
"""
