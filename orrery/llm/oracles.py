"""DuckDB SQL for the queries that SQL can express."""

import re
from collections.abc import Sequence

OP5 = r"""
WITH words AS (
    SELECT doc_id, source, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), d AS (
    SELECT doc_id, source, CAST(len(w) AS BIGINT) AS size,
           -ln((CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0)
             / CASE WHEN len(w) = 0 THEN 1.0 ELSE 0.5 + CAST(0.5 AS DOUBLE) * len(list_distinct(w)) / len(w) END AS key
    FROM words
), s AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS words,
           (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
    FROM d GROUP BY source
), o AS (
    SELECT *, sum(words) OVER () AS total, sum(weight) OVER () AS all_w,
           coalesce(sum(3 * words) OVER earlier, 0) AS stopped, coalesce(sum(weight) OVER earlier, 0) AS gone_w
    FROM s WINDOW earlier AS (ORDER BY 3 * words / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), c AS (
    SELECT *, (total - stopped) * weight > 3 * words * (all_w - gone_w) AS stops FROM o
), l AS (
    SELECT *, total - sum(CASE WHEN stops THEN 3 * words ELSE 0 END) OVER () AS rest,
           sum(CASE WHEN stops THEN 0 ELSE weight END) OVER () AS rest_w
    FROM c
), t AS (
    SELECT source, words, CASE WHEN stops THEN CAST(3 * words AS DOUBLE) ELSE CAST(weight * rest AS DOUBLE) / CAST(rest_w AS DOUBLE) END AS target,
           CASE WHEN stops THEN 3 * words ELSE CAST(weight * rest // rest_w AS BIGINT) END AS due
    FROM l
), e AS (
    SELECT *, CASE WHEN words = 0 THEN 0 ELSE least(due // words, 3) END AS epochs FROM t
)
SELECT d.doc_id, d.size, e.words AS source_size, e.target,
       CAST(e.epochs * d.size + greatest(0, least(d.size, e.due - e.epochs * e.words
         - coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS BIGINT) AS taken
FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source
"""

OP7 = r"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), placed AS (
    SELECT *, row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS n,
           length(role) + length(text) + 24 + list_sum(list_transform(
             ['<|im_start|>', '<|im_end|>', '<|endoftext|>', '<s>', '</s>', '[INST]', '[/INST]', '<<SYS>>', '<</SYS>>', '\'],
             lambda s: (length(role || chr(0) || text) - length(replace(role || chr(0) || text, s, ''))) // length(s))) AS chars
    FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), held AS (
    SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY pos) AS so_far FROM placed
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(so_far) FILTER (WHERE role = 'assistant' OR pos = n) AS BIGINT) AS formatted_chars
FROM held GROUP BY conv_id
"""

OP3 = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(list_zip(q.e, v.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0
), r AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""

OP1 = """
WITH RECURSIVE v AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95
), r AS (
    SELECT vec_id AS node, vec_id AS seen FROM v
    UNION
    SELECT r.node, l.b FROM r JOIN l ON r.seen = l.a
)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id) AS n_links,
       coalesce(m.component_id, e.vec_id) AS component_id, coalesce(m.component_id, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN (SELECT node, min(seen) AS component_id FROM r GROUP BY node) m ON m.node = e.vec_id
"""

OP9 = """
WITH crc AS MATERIALIZED (
    SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, CAST(i AS BIGINT))) AS step
), d AS MATERIALIZED (
    SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size,
           xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda b: CAST('0x' || b AS BIGINT)),
               lambda a, b: xor(a >> 8, step[1 + CAST(xor(a, b) & 255 AS INT)]), CAST(4294967295 AS BIGINT)), 4294967295) AS text_crc32,
           coalesce(CAST(doc_id AS VARCHAR), 'null') AS key
    FROM documents, crc
), nodes AS (
    SELECT 'root' AS parent, 'region' || r AS name, 8.0 AS weight, CAST(NULL AS INT) AS shard FROM range(2) t(r)
    UNION ALL SELECT 'region' || r, 'rack' || r || '.' || c, 4.0, NULL FROM range(2) t(r), range(2) u(c)
    UNION ALL SELECT 'rack' || k % 2 || '.' || k // 2 % 2, 'shard' || k, 1.0, CAST(k AS INT) FROM range(16) t(k)
    UNION ALL SELECT 'root', 'region+16', 1.0, 16
), draws AS (
    SELECT key, parent, name, shard,
           -ln((CAST('0x' || substr(md5(key || ':' || name), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0) / weight AS draw
    FROM (SELECT DISTINCT key FROM d), nodes
), old AS (
    SELECT key, parent, arg_min(name, draw) AS name, arg_min(coalesce(shard, -1), draw) AS shard FROM draws WHERE name <> 'region+16' GROUP BY key, parent
), new AS (
    SELECT key, arg_min(name, draw) AS name FROM draws WHERE parent = 'root' GROUP BY key
), placed AS (
    SELECT region.key, shard.shard, CASE WHEN new.name = 'region+16' THEN 16 ELSE shard.shard END AS grown_shard
    FROM old region JOIN old rack ON rack.key = region.key AND rack.parent = region.name
    JOIN old shard ON shard.key = rack.key AND shard.parent = rack.name JOIN new ON new.key = region.key
    WHERE region.parent = 'root'
)
SELECT d.doc_id, size, text_crc32, 'key' AS law, shard, grown_shard,
       CAST(row_number() OVER (PARTITION BY shard ORDER BY CAST('0x' || substr(md5(d.key || ':' || text_crc32 || ':' || size), 1, 13) AS BIGINT) % 1024,
                               d.doc_id NULLS FIRST, text_crc32, size) - 1 AS BIGINT) AS slot
FROM d JOIN placed ON placed.key = d.key
"""

_SIMHASH = r"""
WITH RECURSIVE texts AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
    SELECT DISTINCT unnest(list_transform(range(1, greatest(len(w) - 1, 2)), lambda i: array_to_string(w[i:i + 2], ' '))) AS s FROM texts WHERE len(w) > 0
), raw AS (
    SELECT s, octet_length(encode(s)) AS n, hex(encode(s)) AS x FROM shingles
), lanes AS (
    SELECT s, n, x, list_transform(range(n // 8), lambda i: CAST('0x' || list_aggregate(list_reverse(regexp_extract_all(x[16 * i + 1:16 * i + 16], '..')), 'string_agg', '') AS UHUGEINT)) AS l FROM raw
), striped AS (
    SELECT s, n, x, l, CASE WHEN n >= 32 THEN [{stripes}] END AS v FROM lanes
), merged AS (
    SELECT s, n, x, l, CASE WHEN n < 32 THEN {seed5} ELSE list_reduce(v, lambda h, a: {merge}, {sum}) END + CAST(n AS UHUGEINT) & {M} AS h FROM striped
), eights AS (
    SELECT s, n, x, list_reduce(l[n // 32 * 4 + 1:], lambda h, k: {eight}, h) AS h FROM merged
), fours AS (
    SELECT s, n, x, CASE WHEN n % 8 < 4 THEN h ELSE {four} END AS h
    FROM (SELECT *, CAST('0x0' || list_aggregate(list_reverse(regexp_extract_all(x[n // 8 * 16 + 1:n // 8 * 16 + 8], '..')), 'string_agg', '') AS UHUGEINT) AS k FROM eights)
), ones AS (
    SELECT s, list_reduce(list_transform(regexp_extract_all(x[n // 4 * 8 + 1:], '..'), lambda b: CAST('0x' || b AS UHUGEINT)), lambda h, b: {one}, h) AS h FROM fours
), hashed AS MATERIALIZED (
    SELECT s, xor(h, h >> 32) AS h FROM (SELECT s, xor(h, h >> 29) * {P3} & {M} AS h FROM (SELECT s, xor(h, h >> 33) * {P2} & {M} AS h FROM ones))
), prints AS MATERIALIZED (
    SELECT doc_id, coalesce(CAST({bits} AS UHUGEINT), 0::UHUGEINT) AS f
    FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [NULL] ELSE list_transform(range(1, greatest(len(w) - 1, 2)), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS s FROM texts)
    LEFT JOIN hashed USING (s) GROUP BY doc_id
), nodes AS MATERIALIZED (
    SELECT f, min(doc_id) AS id FROM prints GROUP BY f
), links AS MATERIALIZED (
    SELECT a.f AS a, b.f AS b FROM nodes a JOIN nodes b ON a.f <> b.f AND bit_count(CAST(xor(a.f, b.f) AS HUGEINT)) <= 3
), reached AS (
    SELECT f AS node, f AS seen FROM nodes UNION SELECT reached.node, links.b FROM reached JOIN links ON links.a = reached.seen
), least AS (
    SELECT node, min(id) AS component_id FROM reached JOIN nodes ON nodes.f = reached.seen GROUP BY node
)
SELECT doc_id, lower(lpad(hex(CAST(f AS UBIGINT)), 16, '0')) AS fingerprint, component_id FROM prints JOIN least ON least.node = prints.f
"""

#: The five primes of XXH64, fixed values.
XXH64_PRIMES = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)


def simhash_sql(seed: int = 42) -> str:
    """XXH64 of every different shingle on 128-bit numbers, fingerprints, and the closure of their
    links. Lanes are read from hexadecimal digits; a round or a tail step is a lambda."""
    p1, p2, p3, p4, p5 = (f"{p}::UHUGEINT" for p in XXH64_PRIMES)
    top = 1 << 64
    low = f"{top - 1}::UHUGEINT"

    def times(a: str, b: str) -> str:
        return f"(({a}) * {b} & {low})"

    def turned(a: str, by: int) -> str:
        return f"((({a}) << {by} & {low}) | (({a}) >> {64 - by}))"

    def mixed(accumulator: str, lane: str) -> str:
        return times(turned(f"(({accumulator}) + {times(lane, p2)} & {low})", 31), p1)

    first, second, last = XXH64_PRIMES[0], XXH64_PRIMES[1], XXH64_PRIMES[4]
    starts = ((seed + first + second) % top, (seed + second) % top, seed, (seed - first) % top)
    stripe = "list_reduce(list_transform(range(n // 32), lambda i: l[4 * i + {place}]), lambda acc, lane: {mixed}, {start}::UHUGEINT)"
    on = f"{times('{inner}', p1)} + {p4} & {low}"
    bit = "CASE WHEN 2 * count(*) FILTER (h >> {b} & 1 = 1) > count(h) THEN {v}::UHUGEINT ELSE 0::UHUGEINT END"
    return _SIMHASH.format(
        stripes=", ".join(stripe.format(place=k + 1, mixed=mixed("acc", "lane"), start=start) for k, start in enumerate(starts)),
        seed5=f"{(seed + last) % top}::UHUGEINT",
        merge="(" + on.format(inner=f"xor(h, {mixed('0::UHUGEINT', 'a')})") + ")",
        sum="(" + " + ".join(turned(f"v[{k + 1}]", by) for k, by in enumerate((1, 7, 12, 18))) + f" & {low})",
        eight="(" + on.format(inner=turned(f"xor(h, {mixed('0::UHUGEINT', 'k')})", 27)) + ")",
        four=f"({times(turned(f'xor(h, {times("k", p1)})', 23), p2)} + {p3} & {low})",
        one=times(turned(f"xor(h, {times('b', p5)})", 11), p1),
        P2=p2, P3=p3, M=low, bits=" + ".join(bit.format(b=b, v=1 << b) for b in range(64)),
    )


OP4 = simhash_sql()

OP11 = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
), words AS (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), sizes AS (
    SELECT lang, w, unnest(range(1, 5)) AS size FROM words
), places AS (
    SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM sizes
), counts AS (
    SELECT lang, array_to_string(w[i : i + size - 1], ' ') AS phrase, any_value(w[i : i + size - 1]) AS w, any_value(size) AS size, count(*) AS a
    FROM places GROUP BY 1, 2 HAVING count(*) >= 30
), totals AS (
    SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY 1
), cuts AS (
    SELECT lang, phrase, w, a, unnest(range(1, size)) AS k FROM counts WHERE size > 1
), parts AS (
    SELECT c.lang, c.phrase, c.a, c.k, l.a AS l, r.a AS r, CAST(2000000 * CAST(c.a AS HUGEINT) // (l.a + r.a) AS BIGINT) AS score
    FROM cuts c JOIN counts l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1 : k], ' ')
    JOIN counts r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[k + 1 :], ' ')
), least AS (
    SELECT * FROM parts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inner_sizes AS (
    SELECT lang, w, size, a, unnest(range(2, size)) AS m FROM counts WHERE size > 2
), inner_places AS (
    SELECT lang, w, a, m, unnest(range(1, size - m + 2)) AS i FROM inner_sizes
), inside AS (
    SELECT lang, array_to_string(w[i : i + m - 1], ' ') AS phrase, max(a) AS over FROM inner_places GROUP BY 1, 2
), kept AS (
    SELECT l.* FROM least l LEFT JOIN inside i ON i.lang = l.lang AND i.phrase = l.phrase WHERE i.over IS NULL OR 100 * i.over < 80 * l.a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000
"""

def op12(strict: Sequence[str], soft: Sequence[str]) -> str:
    """The rules are the contract's; terms become one pattern each, with the characters beside them."""

    def hit(term: str) -> str:
        return f"regexp_matches(low, '(^|[^a-z0-9\\x{{80}}-\\x{{10FFFF}}]){re.escape(term)}($|[^a-z0-9\\x{{80}}-\\x{{10FFFF}}])')"

    def count(term: str) -> str:
        # a character between two occurrences serves both, so each is doubled first
        doubled = "regexp_replace(low, '([^a-z0-9\\x{80}-\\x{10FFFF}])', '\\1\\1', 'g')"
        return f"len(regexp_extract_all({doubled}, '(^|[^a-z0-9\\x{{80}}-\\x{{10FFFF}}]){re.escape(term)}($|[^a-z0-9\\x{{80}}-\\x{{10FFFF}}])'))"

    n_strict = " + ".join(count(t) for t in strict)
    weight = " + ".join([*(f"2 * CAST({hit(t)} AS BIGINT)" for t in strict), *(f"CAST({hit(t)} AS BIGINT)" for t in soft)])
    n_soft = " + ".join(f"CAST({hit(t)} AS BIGINT)" for t in soft)
    return f"""
WITH p AS (
    SELECT page_id, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
           translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
    FROM pages
), r(name, start, action) AS (
    VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), h AS (
    SELECT *, CAST({n_strict} AS BIGINT) AS n_strict, CAST({n_soft} AS BIGINT) AS n_soft, CAST({weight} AS BIGINT) AS weight FROM p
), j AS (
    SELECT h.*, (SELECT arg_max(name || start, length(name || start)) FROM r WHERE ends_with('.' || host, '.' || name) AND starts_with(path, start)) AS rule FROM h
)
SELECT page_id, host, path, rule, n_strict, n_soft, weight,
       coalesce((SELECT action FROM r WHERE name || start = rule), CASE WHEN weight >= 2 THEN 'block' ELSE 'allow' END) AS verdict
FROM j
"""

OP13 = r"""
WITH d AS (
    SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents
), t AS (
    SELECT id, lang, source, unnest(terms) AS term FROM d
), kept AS (
    SELECT lang, term FROM t GROUP BY 1, 2 HAVING count(DISTINCT id) >= 3
), v AS (
    SELECT lang, count(*) AS v FROM kept GROUP BY 1
), g AS (
    SELECT DISTINCT lang, source FROM d
), counts AS (
    SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY 1, 2, 3
), sums AS (
    SELECT lang, source, sum(n) AS words FROM counts GROUP BY 1, 2
), dense AS (
    SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
           1 + CAST(1000000000 * CAST(coalesce(c.n, 0) + 1 AS HUGEINT) // (coalesce(s.words, 0) + v.v) AS BIGINT) AS p
    FROM g JOIN kept k ON k.lang = g.lang JOIN v ON v.lang = g.lang
    LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
    LEFT JOIN sums s ON s.lang = g.lang AND s.source = g.source
), totals AS (
    SELECT lang, sum(words) AS words FROM sums GROUP BY 1
), wide AS (
    SELECT c.lang, c.term, 1 + CAST(1000000000 * CAST(sum(c.n) + 1 AS HUGEINT) // (any_value(t.words) + any_value(v.v)) AS BIGINT) AS q
    FROM counts c JOIN totals t USING (lang) JOIN v USING (lang) GROUP BY 1, 2
), pairs AS (
    SELECT a.lang, a.source, b.source AS item,
           CAST(coalesce((SELECT sum((x.p - y.p) * (x.p - y.p) // y.p) FROM dense x JOIN dense y ON x.lang = y.lang AND x.term = y.term
                          WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS BIGINT) AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
), terms AS (
    SELECT d.lang, d.source, d.term AS item, (d.p - w.q) * (d.p - w.q) // w.q AS value
    FROM dense d JOIN wide w ON w.lang = d.lang AND w.term = d.term WHERE d.n > 0 AND d.p > w.q
)
SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INT) AS rank FROM pairs
UNION ALL
SELECT lang, source, 'term', item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INT) AS rank
FROM terms QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) <= 200
"""
