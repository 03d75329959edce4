"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

NEIGHBOURS = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""


def crc32(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit."""
    eight = "list_reduce(list_prepend(xor(c, b), [1, 1, 1, 1, 1, 1, 1, 1]::BIGINT[]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda s: ascii(s)::BIGINT)), lambda c, b: {eight}), 4294967295::BIGINT)"


def leaf(n_chars: str) -> str:
    fields = [f"coalesce(strlen({x}::VARCHAR) || ':' || {x}::VARCHAR, '-')" for x in ("doc_id", "source", "lang", n_chars, "text")]
    return f"sha256({' || '.join(fields)})"


MANIFEST = f"""
WITH RECURSIVE l AS (SELECT doc_id, lang, {leaf("n_chars")} AS leaf, CASE WHEN {crc32("doc_id::VARCHAR")} % 7 = 0 THEN {leaf("(n_chars + 1)")} ELSE {leaf("n_chars")} END AS shown FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, row_number() OVER () AS row FROM l),
t AS (SELECT lang, 0 AS level, list(leaf ORDER BY pos) AS nodes FROM n GROUP BY lang
  UNION ALL SELECT lang, level + 1, list_transform(range(1, len(nodes) + 1, 2), lambda i: sha256(nodes[i] || coalesce(nodes[i + 1], ''))) FROM t WHERE len(nodes) > 1),
s AS (SELECT lang, max(level) AS h, arg_max(nodes, level)[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos FROM t GROUP BY lang),
u AS (SELECT 0 AS level, list(subroot ORDER BY pos) AS nodes FROM s
  UNION ALL SELECT level + 1, list_transform(range(1, len(nodes) + 1, 2), lambda i: sha256(nodes[i] || coalesce(nodes[i + 1], ''))) FROM u WHERE len(nodes) > 1),
top AS (SELECT max(level) AS h, arg_max(nodes, level)[1] AS root FROM u),
f AS (SELECT lang, level, unnest(nodes) AS node, generate_subscripts(nodes, 1) - 1 AS idx FROM t),
g AS (SELECT level, unnest(nodes) AS node, generate_subscripts(nodes, 1) - 1 AS idx FROM u),
a AS (SELECT n.row, n.lang, n.pos, unnest(range(0, s.h)) AS level FROM n JOIN s ON n.lang IS NOT DISTINCT FROM s.lang),
b AS (SELECT n.row, s.h, s.pos, unnest(range(0, top.h)) AS level FROM n JOIN s ON n.lang IS NOT DISTINCT FROM s.lang, top),
p AS (SELECT a.row, a.level AS k, (a.pos >> a.level) & 1 AS lft, f.node FROM a LEFT JOIN f ON a.lang IS NOT DISTINCT FROM f.lang AND a.level = f.level AND f.idx = xor(a.pos >> a.level, 1::BIGINT)
  UNION ALL SELECT b.row, b.h + b.level, (b.pos >> b.level) & 1, g.node FROM b LEFT JOIN g ON b.level = g.level AND g.idx = xor(b.pos >> b.level, 1::BIGINT)),
q AS (SELECT row, list({{'lft': lft, 'node': node}} ORDER BY k) AS path FROM p GROUP BY row),
r AS (SELECT n.doc_id, n.leaf, s.subroot, top.root, coalesce(q.path, []) AS path, n.shown FROM n JOIN s ON n.lang IS NOT DISTINCT FROM s.lang JOIN top ON true LEFT JOIN q USING (row)),
d AS (SELECT doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_filter(list_transform(path, lambda x: x.node), lambda x: x IS NOT NULL), ''), '')) AS proof_sha256,
  list_reduce(list_prepend({{'lft': 0::BIGINT, 'node': shown}}, path), lambda x, y: {{'lft': 0::BIGINT, 'node': sha256(CASE WHEN y.node IS NULL THEN x.node WHEN y.lft = 1 THEN y.node || x.node ELSE x.node || y.node END)}}).node AS folded_root FROM r)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM d"""


def codes(parts: int, entries: int, rounds: int, scale: int, dimension: int) -> str:
    """Lloyd's rounds one after the other, all distances in each."""
    w = dimension // parts
    out = [
        f"k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS v, row_number() OVER (ORDER BY vec_id NULLS LAST) AS row FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)",
        f"p AS MATERIALIZED (SELECT row, part, v[part * {w} + 1 : part * {w} + {w}] AS x FROM k, range({parts}) t(part))",
        f"c0 AS (SELECT part, row - 1 AS e, x AS c FROM p WHERE row <= {entries})",
    ]
    for i in range(rounds + 1):
        out.append(f"a{i} AS MATERIALIZED (SELECT row, part, any_value(x) AS x, arg_min(e, (d, e)) AS e, min(d)::BIGINT AS d FROM (SELECT p.row, p.part, x, e, list_dot_product(x, x) - 2 * list_dot_product(x, c) + list_dot_product(c, c) AS d FROM p JOIN c{i} USING (part)) GROUP BY row, part)")
        if i < rounds:
            out.append(f"m{i} AS (SELECT part, e, list(m ORDER BY j) AS c FROM (SELECT part, e, j, floor(sum(x[j]) / count(*)) AS m FROM a{i}, range(1, {w + 1}) t(j) GROUP BY part, e, j) GROUP BY part, e)")
            out.append(f"c{i + 1} AS MATERIALIZED (SELECT part, e, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (part, e))")
    out.append(f"b AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: x::BIGINT), ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM c{rounds})")
    out.append(f"r AS (SELECT row, string_agg(format('{{:02x}}', e), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY row)")
    return f"WITH {', '.join(out)} SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM r JOIN k USING (row), b"


def language_model(order: int) -> str:
    """The word model, and partial matching from the empty context up: q is a symbol's log10 probability in its context, tail that after an escape from it."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    digit = "(strpos('0123456789ABCDEF', h[{}]) - 1)"
    key = " + ".join(f"(y[i + {order - k}] << {9 * k})" for k in range(order + 1))
    out = [
        f"x AS (SELECT row_number() OVER () AS row, doc_id, {crc32('doc_id::VARCHAR')} % 7 = 2 AS held_out, {lower} AS t, hex(encode({lower})) AS h FROM documents)",
        r"w AS (SELECT row, held_out, unnest(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS w FROM x)",
        "wc AS (SELECT w, count(*) AS c FROM w WHERE NOT held_out GROUP BY w)",
        "ends AS (SELECT count(*) AS c FROM x WHERE NOT held_out)",
        "total AS (SELECT coalesce(sum(wc.c), 0) + any_value(ends.c) AS n, count(wc.c) + (any_value(ends.c) > 0)::INT AS v FROM ends LEFT JOIN wc ON true)",
        "base AS (SELECT row, count(*) AS words, count(c) AS known, sum(log10((coalesce(c, 0) + 1) / (n + v + 1))) AS s FROM w LEFT JOIN wc USING (w), total GROUP BY row)",
        f"b AS (SELECT row, held_out, list_concat({[0] * order}::BIGINT[], list_transform(range(0, len(h) // 2), lambda i: ({digit.format('2 * i + 1')} * 16 + {digit.format('2 * i + 2')} + 1)::BIGINT), [257::BIGINT]) AS y FROM x)",
        f"g AS MATERIALIZED (SELECT row, held_out, {key} AS k FROM (SELECT row, held_out, y, unnest(range(1, len(y) - {order} + 1)) AS i FROM b))",
        f"n{order} AS MATERIALIZED (SELECT k, count(*) FILTER (NOT held_out) AS n FROM g GROUP BY k)",
    ]
    for j in range(order - 1, -1, -1):
        out.append(f"n{j} AS MATERIALIZED (SELECT k & {(1 << 9 * (j + 1)) - 1} AS k, sum(n)::BIGINT AS n FROM n{j + 1} GROUP BY ALL)")
    for j in range(order + 1):
        if j:
            rows = f"SELECT a.k, a.n, z.n AS n1, z.t AS t1, z.d AS d1, z.tail AS tail1, z.q AS q1 FROM n{j} a JOIN q{j - 1} z ON z.k = a.k & {(1 << 9 * j) - 1}"
            total = "(t1 - s1 + CASE WHEN d1 = 257 THEN 0 ELSE d1 - d END)"
            tail = f"CASE WHEN n > 0 THEN NULL WHEN n1 > 0 THEN log10(n1 / {total}) ELSE CASE WHEN d1 > d THEN log10((d1 - d) / {total}) ELSE 0 END + tail1 END"
        else:
            rows, tail = "SELECT k, n, 0 AS n1, 257 AS t1, 257 AS d1, 0 AS tail1, -log10(257) AS q1 FROM n0", "CASE WHEN n = 0 THEN -log10(257 - d) END"
        over = "(PARTITION BY k >> 9)"
        out.append(f"o{j} AS (SELECT *, sum(n) OVER {over} AS t, count(*) FILTER (n > 0) OVER {over} AS d, coalesce(sum(n1) FILTER (n > 0) OVER {over}, 0) AS s1 FROM ({rows}))")
        out.append(f"p{j} AS (SELECT *, {tail} AS tail FROM o{j} WHERE t > 0 UNION ALL SELECT *, NULL FROM o{j} WHERE t = 0)")
        whole = "(t + CASE WHEN d = 257 THEN 0 ELSE d END)"
        out.append(f"q{j} AS MATERIALIZED (SELECT k, n, t, d, tail, CASE WHEN t = 0 THEN q1 WHEN n > 0 THEN log10(n / {whole}) ELSE log10(d / {whole}) + tail END AS q FROM p{j})")
    out.append(f"s AS (SELECT row, sum(q) AS score, count(*) - 1 AS n_bytes FROM g JOIN q{order} USING (k) GROUP BY row)")
    return f"""WITH {", ".join(out)}
SELECT doc_id, held_out, coalesce(words, 0) + 1 AS n_tokens, coalesce(known, 0) + (ends.c > 0)::INT AS n_known, n::BIGINT AS train_tokens, round(coalesce(base.s, 0) + log10((ends.c + 1) / (n + v + 1)), 6) AS base_score, round(score, 6) AS score, n_bytes
FROM x JOIN s USING (row) LEFT JOIN base USING (row), ends, total"""
