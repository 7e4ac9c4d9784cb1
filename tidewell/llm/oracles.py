"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from . import licences, quotes

TOPK = """
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e
        FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), scored AS (
        SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
        FROM v q JOIN v c ON q.vec_id <> c.vec_id
        WHERE q.vec_id % 100 = 0
    ), ranked AS (
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM scored
    )
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10"""

_STRETCHES = f"flatten(list_transform(list_filter({list(quotes.WIDTHS)}, lambda w: w <= len(lines)), lambda w: list_transform(range(1, len(lines) - w + 2), lambda i: {{'width': w, 'pos': i, 'k': array_to_string(lines[i:i + w - 1], chr(10))}})))"
_NORMAL = "trim(regexp_replace(lower({}), '\\s+', ' ', 'g'))"

QUOTATION = f"""
    WITH RECURSIVE m AS (
        SELECT row_number() OVER () AS id, conv_id, turn, role, coalesce(text, '') AS text FROM conversations
    ), lines AS (
        SELECT id, conv_id, turn, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM m
    ), levels AS (
        SELECT *, length(regexp_replace(regexp_extract(x, '{quotes.QUOTED}', 1), '[^>]', '', 'g')) AS level, regexp_replace(x, '{quotes.QUOTED}', '') AS body FROM lines
    ), marked AS (SELECT *, coalesce(regexp_matches(body, '{quotes.ATTRIBUTION}') AND lead(level) OVER (PARTITION BY id ORDER BY i) > 0, false) AS attributed FROM levels
    ), runs AS (
        SELECT *, sum(starts) OVER (PARTITION BY id ORDER BY i) AS run
        FROM (SELECT *, CASE WHEN lag(level) OVER (PARTITION BY id ORDER BY i) = level THEN 0 ELSE 1 END AS starts FROM levels)
    ), passages AS (
        SELECT id, conv_id, turn, run, any_value(level) AS level, {_NORMAL.format('string_agg(body, chr(10) ORDER BY i)')} AS k, list({_NORMAL.format('body')} ORDER BY i) AS lines
        FROM runs WHERE level > 0 GROUP BY id, conv_id, turn, run
    ), quotes AS (SELECT DISTINCT conv_id, turn, level, k, list_filter(lines, lambda x: x <> '') AS lines FROM passages WHERE k <> '' AND conv_id IS NOT NULL AND turn IS NOT NULL
    ), own AS (
        SELECT id, coalesce(string_agg(body, chr(10) ORDER BY i) FILTER (WHERE level = 0 AND NOT attributed), '') AS own FROM marked GROUP BY id
    ), said AS (
        SELECT DISTINCT * FROM (SELECT m.conv_id, m.turn AS seen, {_NORMAL.format('line')} AS k FROM m JOIN own ON m.id = own.id, unnest(string_split(own.own, chr(10))) AS u(line)) WHERE k <> '' AND conv_id IS NOT NULL AND seen IS NOT NULL
    ), origins AS (
        SELECT conv_id, k, min(seen) AS seen FROM (SELECT * FROM said UNION ALL SELECT m.conv_id, m.turn, {_NORMAL.format('own.own')} FROM m JOIN own ON m.id = own.id WHERE m.conv_id IS NOT NULL AND m.turn IS NOT NULL) WHERE k <> '' GROUP BY conv_id, k
    ), whole AS (SELECT q.conv_id, q.turn, q.level, q.k, o.seen FROM quotes q JOIN origins o ON q.conv_id = o.conv_id AND q.k = o.k AND o.seen < q.turn
    ), parts AS (
        SELECT conv_id, turn, level, passage, s.width AS width, s.k AS k, min(s.pos) AS pos
        FROM (SELECT conv_id, turn, level, k AS passage, unnest({_STRETCHES}) AS s FROM quotes q WHERE NOT EXISTS (SELECT 1 FROM whole w WHERE w.conv_id = q.conv_id AND w.turn = q.turn AND w.level = q.level AND w.k = q.k)) GROUP BY ALL
    ), own_lines AS (
        SELECT m.conv_id, m.turn, list_filter(list_transform(string_split(own.own, chr(10)), lambda x: {_NORMAL.format('x')}), lambda x: x <> '') AS lines FROM m JOIN own ON m.id = own.id WHERE m.conv_id IS NOT NULL AND m.turn IS NOT NULL
    ), held AS (SELECT conv_id, s.k AS k, min(turn) AS seen FROM (SELECT conv_id, turn, unnest({_STRETCHES}) AS s FROM own_lines) GROUP BY ALL
    ), met AS (SELECT p.conv_id, p.turn, p.level, p.passage, p.width, h.seen, count(*) AS n, min(p.pos) AS pos FROM parts p JOIN held h ON p.conv_id = h.conv_id AND p.k = h.k AND h.seen < p.turn GROUP BY ALL
    ), found AS (
        SELECT conv_id, turn, seen, row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, rank, width DESC, n DESC, seen DESC) AS r
        FROM (SELECT conv_id, turn, level, 0 AS rank, 0 AS width, 0 AS n, seen FROM whole UNION ALL SELECT conv_id, turn, level, 1, width, n, seen FROM met QUALIFY row_number() OVER (PARTITION BY conv_id, turn, level, passage ORDER BY width DESC, n DESC, pos, seen) = 1)
    ), links AS (SELECT conv_id, turn, seen AS reply_to FROM found WHERE r = 1
    ), chain AS (
        SELECT conv_id, turn, reply_to AS thread, 1 AS depth FROM links
        UNION ALL SELECT c.conv_id, c.turn, l.reply_to, c.depth + 1 FROM chain c JOIN links l ON c.conv_id = l.conv_id AND c.thread = l.turn
    ), threads AS (SELECT conv_id, turn, arg_max(thread, depth) AS thread, max(depth) AS depth FROM chain GROUP BY conv_id, turn
    ), counted AS (SELECT id, count(*) AS n, max(level) AS deepest FROM passages GROUP BY id)
    SELECT m.conv_id, m.turn, m.role, coalesce(c.n, 0) AS n_quotes, CAST(coalesce(c.deepest, 0) AS BIGINT) AS deepest, l.reply_to, coalesce(t.thread, m.turn) AS thread,
        CAST(coalesce(t.depth, 0) AS BIGINT) AS depth, CASE WHEN m.conv_id IS NOT NULL AND m.turn IS NOT NULL THEN rank() OVER (PARTITION BY m.conv_id, m.turn IS NULL ORDER BY coalesce(t.thread, m.turn), m.turn) END AS position, '<|' || coalesce(m.role, 'user') || '|>' || chr(10) || own.own || '<|end|>' || chr(10) AS message
    FROM m JOIN own ON m.id = own.id LEFT JOIN counted c ON m.id = c.id LEFT JOIN links l ON m.conv_id = l.conv_id AND m.turn = l.turn LEFT JOIN threads t ON m.conv_id = t.conv_id AND m.turn = t.turn"""


def quoting() -> str:
    """QUOTATION over messages that quote, made as the query makes them."""
    quote = "'> ' || replace({}, chr(10), chr(10) || '> ')".format
    wrote = "'On Monday somebody wrote:' || chr(10) || "
    nested = quote(f"({wrote}{quote('coalesce(b.t, '')')} || chr(10) || a.t)")
    return QUOTATION.replace("FROM conversations", "FROM made").replace("WITH RECURSIVE", f"""WITH RECURSIVE said AS (SELECT conv_id, turn, min(text) AS t FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND text IS NOT NULL GROUP BY ALL
    ), made AS (
        SELECT c.conv_id, c.turn, c.role, CASE WHEN a.t IS NULL THEN c.text ELSE CASE c.turn % 3 WHEN 1 THEN {wrote}{quote('a.t')} WHEN 2 THEN {nested}
            ELSE {quote("regexp_replace(a.t, '^[^' || chr(10) || ']*' || chr(10), '')")} || chr(10) || '> as far as I recall' END || chr(10) || coalesce(c.text, '') END AS text
        FROM conversations c LEFT JOIN said a ON a.conv_id = c.conv_id AND a.turn = c.turn - 1 LEFT JOIN said b ON b.conv_id = c.conv_id AND b.turn = c.turn - 2
    ),""", 1).replace("said AS (\n        SELECT DISTINCT", "said_keys AS (\n        SELECT DISTINCT").replace("SELECT * FROM said UNION", "SELECT * FROM said_keys UNION")


_CRC_STEP = "list_reduce([{x}, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
_CRC = f"xor(list_reduce(list_concat([4294967295], list_transform(string_split({{}}, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, k[(xor(c, b) & 255) + 1])), 4294967295)"

#: All pairs of items and lines; the checksum is made a byte at a time.
PRICE_BANDS = f"""
    WITH crc AS MATERIALIZED (SELECT list_transform(range(256), lambda x: {_CRC_STEP.format(x='x')}) AS k
    ), a AS (SELECT sale_id, line_no::BIGINT AS line_no, item_id, quantity::BIGINT AS q, floor(100 * amount + 0.5)::BIGINT AS a FROM sale_lines WHERE sale_id IS NOT NULL AND item_id IS NOT NULL AND quantity <> 0 AND abs(amount) < 11529215046068469.76
    ), l AS MATERIALIZED (
        SELECT sale_id, line_no, item_id, (x - ((x % y) + y) % y) // y AS u, {_CRC.format("sale_id::VARCHAR || ',' || coalesce(line_no::VARCHAR, '') || ',' || item_id::VARCHAR")} AS c
        FROM (SELECT *, sign(q)::BIGINT * (2 * a + q) AS x, 2 * abs(q) AS y FROM a), crc
    ), i AS (SELECT DISTINCT item_id, CASE WHEN abs(price) < 11529215046068469.76 THEN floor(100 * price + 0.5)::BIGINT END AS p FROM items
    ), pairs AS (SELECT i.item_id, i.p, abs(l.u - i.p) AS gap, l.u, l.sale_id, l.line_no, l.item_id AS line_item_id, l.c FROM i JOIN l ON l.u BETWEEN i.p - greatest(10, i.p // 500) AND i.p + greatest(10, i.p // 500) AND l.item_id <> i.item_id
    ), sums AS (SELECT item_id, p, count(*) AS n_pairs, sum(gap)::BIGINT AS gap_sum, sum(c)::BIGINT AS lines_crc FROM pairs GROUP BY item_id, p
    ), firsts AS (SELECT *, row_number() OVER (PARTITION BY item_id, p ORDER BY gap, u, sale_id, line_no NULLS FIRST, line_item_id) AS r FROM pairs QUALIFY r <= 5)
    SELECT i.item_id, coalesce(f.r, 0)::INTEGER AS rank, f.gap, f.u, f.sale_id, f.line_no, f.line_item_id, coalesce(s.n_pairs, 0) AS n_pairs, coalesce(s.gap_sum, 0)::BIGINT AS gap_sum, coalesce(s.lines_crc, 0)::BIGINT AS lines_crc
    FROM i LEFT JOIN sums s ON i.item_id = s.item_id AND i.p = s.p LEFT JOIN firsts f ON i.item_id = f.item_id AND i.p = f.p"""


ARCHIVES = """
    WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages
    ), r AS (SELECT *, row_number() OVER (PARTITION BY html ORDER BY page_id DESC NULLS LAST) AS r, max(page_id) OVER (PARTITION BY html) AS last FROM p)
    SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest, CASE WHEN n >= 1000 AND r > 1 THEN 'revisit' ELSE 'response' END AS record_type,
        CASE WHEN n >= 1000 AND r > 1 THEN last END AS refers_to
    FROM r"""


def license_scan() -> str:
    """Weights, units and inheritance anew from the template texts, over all units of all texts."""
    templates = ", ".join(f"({i}, '{name}', '{text.replace(chr(39), chr(39) * 2)}')" for i, (name, text) in enumerate(licences.TEMPLATES))
    stop, term, blank = ", ".join(f"'{w}'" for w in licences.STOP), licences.TERM, licences.BLANK
    return f"""
    WITH t(template, licence, text) AS (VALUES {templates}
    ), tt AS (SELECT template, licence, term, 1 + ln(count(*)) AS k FROM (SELECT template, licence, unnest(regexp_extract_all(lower(text), '{term}')) AS term FROM t) WHERE term NOT IN ({stop}) GROUP BY ALL
    ), idf AS (SELECT term, ln(((SELECT count(*) FROM t) + 1) / (count(*) + 1)) + 1 AS idf FROM tt GROUP BY 1
    ), tw AS (SELECT tt.*, k * idf AS x FROM tt JOIN idf USING (term)
    ), w AS (SELECT template, licence, term, x / sqrt(sum(x * x) OVER (PARTITION BY template)) AS part FROM tw
    ), d AS (
        SELECT doc_id, '/' || source || CASE WHEN doc_id % 14 = 0 THEN '' ELSE '/' || CAST(doc_id % 10 AS VARCHAR) END || CASE WHEN doc_id % 7 = 0 THEN '/LICENSE' ELSE '/' || CAST(doc_id AS VARCHAR) || '.txt' END AS path,
            doc_id % 7 = 0 AND source IS NOT NULL AS whole, coalesce(text, '') AS text FROM documents
    ), parts AS (
        SELECT doc_id, unnest(list_concat(list_concat(list_concat(string_split(text, chr(10)), string_split(regexp_replace(text, '([.!?]){blank}+', '\\1' || chr(1), 'g'), chr(1))), regexp_split_to_array(text, '\n{blank}*\n')), CASE WHEN whole THEN [text] ELSE [] END)) AS u FROM d
    ), units AS (
        SELECT DISTINCT doc_id, u FROM (SELECT doc_id, unnest(CASE WHEN regexp_matches(u, '{licences.EXPRESSION}') THEN list_transform(regexp_split_to_array(regexp_extract(u, '{licences.EXPRESSION}', 2), '{licences.JOINED}'), lambda x: regexp_extract(u, '{licences.EXPRESSION}', 1) || ' ' || x) ELSE [u] END) AS u FROM parts)
        WHERE NOT regexp_matches(u, '{licences.DENIED}')
    ), terms AS (SELECT doc_id, u, term, 1 + ln(count(*)) AS k FROM (SELECT doc_id, u, unnest(regexp_extract_all(lower(u), '{term}')) AS term FROM units) WHERE term NOT IN ({stop}) GROUP BY ALL
    ), weighed AS (SELECT t.doc_id, t.u, t.term, t.k * coalesce(i.idf, (SELECT ln(count(*) + 1) + 1 FROM t)) AS x FROM terms t LEFT JOIN idf i ON t.term = i.term
    ), norms AS (SELECT doc_id, u, sqrt(sum(round(x * x, 9))) AS norm FROM weighed GROUP BY doc_id, u
    ), scored AS (
        SELECT a.doc_id, a.u, w.template, w.licence, round(sum(round(a.x * w.part, 9)) / any_value(n.norm), 6) AS score
        FROM weighed a JOIN w ON a.term = w.term JOIN norms n ON a.doc_id = n.doc_id AND a.u = n.u GROUP BY a.doc_id, a.u, w.template, w.licence HAVING count(*) >= {licences.LEAST_TERMS}
    ), best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY licence = '{licences.RESERVED}', score DESC, template) AS r FROM scored WHERE score >= {licences.THRESHOLD}
    ), named AS (
        SELECT doc_id, list_sort(CASE WHEN count(DISTINCT licence) > 1 THEN list(DISTINCT licence) FILTER (WHERE licence <> '{licences.RESERVED}') ELSE list(DISTINCT licence) END) AS names
        FROM (SELECT doc_id, licence FROM scored WHERE score >= {licences.THRESHOLD} QUALIFY row_number() OVER (PARTITION BY doc_id, u ORDER BY licence = '{licences.RESERVED}', score DESC, template) = 1) GROUP BY doc_id
    ), own AS (SELECT d.doc_id, d.path, d.whole, regexp_replace(d.path, '/?[^/]*$', '') AS dir, b.licence, b.score, b.template, array_to_string(n.names, ',') AS licences FROM d LEFT JOIN best b ON d.doc_id = b.doc_id AND b.r = 1 LEFT JOIN named n ON d.doc_id = n.doc_id
    ), found AS (SELECT dir AS up, licence AS above, score AS above_score FROM own WHERE whole AND licence IS NOT NULL QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, path, template) = 1
    ), near AS (
        SELECT o.doc_id, f.up, f.above, f.above_score FROM own o JOIN found f ON o.dir = f.up OR starts_with(o.dir, f.up || '/')
        WHERE o.licence IS NULL QUALIFY row_number() OVER (PARTITION BY o.doc_id ORDER BY length(f.up) DESC) = 1
    )
    SELECT o.doc_id, o.path, coalesce(o.licence, n.above) AS licence, coalesce(o.score, n.above_score) AS score,
        CASE WHEN o.licence IS NOT NULL THEN CASE WHEN o.whole THEN 'file' ELSE 'header' END WHEN n.above IS NOT NULL THEN 'inherited' END AS origin, n.up AS from_dir, o.licences
    FROM own o LEFT JOIN near n ON o.doc_id = n.doc_id"""


def kmeans(k: int = 8, rounds: int = 10, size: int = 64) -> str:
    """Every round as two tables, with all distances in full."""

    def assigned(n: int) -> str:
        return f"""a{n} AS MATERIALIZED (SELECT id, e, c, d FROM (SELECT v.id, v.e, x.c, list_sum(list_transform(list_zip(v.e, x.m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, c{n} x) QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, c) = 1)"""

    steps = []
    for n in range(rounds):
        steps += [assigned(n), f"""c{n + 1} AS MATERIALIZED (
            SELECT c{n}.c, coalesce(any_value(s.m), any_value(c{n}.m)) AS m
            FROM c{n} LEFT JOIN (SELECT c, list(x ORDER BY i) AS m FROM (SELECT c, i, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS x FROM (SELECT c, unnest(e) AS x, unnest(range({size})) AS i FROM a{n}) GROUP BY c, i) GROUP BY c) s ON s.c = c{n}.c GROUP BY c{n}.c)"""]
    return f"""
    WITH v AS MATERIALIZED (
        SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))::BIGINT) AS e
        FROM embeddings WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), c0 AS MATERIALIZED (
        SELECT row_number() OVER (ORDER BY h) - 1 AS c, e AS m FROM (SELECT sha256('3:' || CAST(vec_id AS VARCHAR)) AS h, e FROM v WHERE vec_id IS NOT NULL ORDER BY h LIMIT {k})
    ), {", ".join(steps)}, {assigned(rounds)}
    SELECT v.vec_id, CAST(a.c AS INTEGER) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
        sha256(array_to_string(c.m, ',')) AS centroid_sha256
    FROM a{rounds} a JOIN v ON v.id = a.id JOIN c{rounds} c ON c.c = a.c"""
