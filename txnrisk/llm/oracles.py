"""DuckDB SQL over the same tables, written apart from the Spark code."""

from txnrisk.llm import secret_scan as ss
from txnrisk.llm.chat_format import Template


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _found(kind: int, pattern: str, source: str = "d") -> str:
    return f"""SELECT doc_id, {kind} AS kind, i,
      list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS st,
      m[i] AS hit, v[i] AS val
    FROM (SELECT doc_id, g, m, v, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id,
      string_split_regex(text, {_q(pattern)}) AS g, regexp_extract_all(text, {_q(pattern)}) AS m,
      regexp_extract_all(text, {_q(pattern)}, {2 if kind == 0 else 0}) AS v FROM {source}))"""


def _secret_scan() -> str:
    case = "CASE " + " ".join(
        f"WHEN regexp_matches(hit, {_q(p)}) THEN {len(ss.KINDS) - len(ss.CLASSES) + i}"
        for i, (_, p, _) in enumerate(ss.CLASSES)) + " END"
    limit = "CASE kind " + " ".join(
        f"WHEN {len(ss.KINDS) - len(ss.CLASSES) + i} THEN {ss.sum_limit(b)}" for i, (_, _, b) in enumerate(ss.CLASSES)) + " END"
    names = "[" + ", ".join(_q(k) for k in ss.KINDS) + "]"
    table = "[" + ", ".join(map(str, ss.c_log_c())) + "]"
    w = ss.WINDOW
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
base AS (
  SELECT doc_id, kind, st, st + length(hit) AS en FROM ({_found(0, ss.ASSIGN)}) WHERE length(val) >= {ss.ASSIGN_MIN}
  UNION ALL SELECT doc_id, kind, st, st + length(hit) FROM ({_found(1, ss.ACCESS)})
  UNION ALL SELECT doc_id, kind, st, st + length(hit) FROM ({_found(2, ss.HEX)})),
cand AS (SELECT doc_id, st, hit, {case} AS kind FROM ({_found(9, ss.CANDIDATE)})
  WHERE NOT regexp_matches(hit, {_q("|".join(ss.ALLOW))})),
win AS (SELECT doc_id, st, kind, i, hit[i - {w - 1}:i] AS s
  FROM (SELECT *, unnest(range({w}, length(hit) + 1)) AS i FROM cand)),
hits AS (SELECT doc_id, st, kind, i FROM win WHERE list_sum(list_transform(list_distinct(string_split(s, '')),
  lambda x: {table}[1 + length(s) - length(replace(s, x, ''))])) <= {limit}),
isl AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, st ORDER BY i) AS g FROM (
  SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id, st ORDER BY i) <= {w} THEN 0 ELSE 1 END AS fresh FROM hits)),
spans AS (SELECT doc_id, kind, st, en FROM base
  UNION ALL SELECT doc_id, kind, st + min(i) - {w}, st + max(i) FROM isl GROUP BY doc_id, kind, st, g),
named AS (SELECT *, {names}[kind + 1] || ':' || CAST(st AS BIGINT) || ':' || CAST(en AS BIGINT) AS s FROM spans),
agg AS (SELECT doc_id, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS k, count(*) FILTER (kind = 2) AS h,
  coalesce(string_agg(s, ',' ORDER BY st, kind) FILTER (kind < 3), '') AS b, string_agg(s, ',' ORDER BY st, kind, en) AS spans
  FROM named GROUP BY doc_id)
SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(k, 0) AS n_access, coalesce(h, 0) AS n_hex,
  sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN agg USING (doc_id)"""


def _chat_format() -> str:
    t = Template()

    def esc(c: str) -> str:
        c = f"replace({c}, '\\', '\\e')"
        for i, s in enumerate(t.controls):
            c = f"replace({c}, {_q(s)}, '\\{chr(65 + i)}')"
        return c

    return f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
w AS (SELECT *, lag(role) OVER o IS DISTINCT FROM role AS fresh FROM rows
  WINDOW o AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length({esc('text')}) + CASE WHEN fresh THEN {len(t.block_open) + len(t.role_close) + len(t.block_close)}
    + length({esc('role')}) ELSE {len(t.turn_sep)} END) AS BIGINT) AS formatted_chars
FROM w GROUP BY conv_id"""


VECTOR_SEARCH = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(
    range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5"""
HARD_NEGATIVES = """
WITH v AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND label IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(coalesce(list_sum(list_transform(
    range(1, len(a.v) + 1), lambda i: a.v[i] * c.v[i])), 0) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id AND len(a.v) = len(c.v)),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10"""
WARC_STORE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
b AS (SELECT page_id, h, octet_length(encode(html)) AS n, list_aggregate(list_transform(range(32), lambda i:
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(h, 1 + 10 * (i // 8), 10) AS BIGINT)
    >> (35 - 5 * (i % 8))) & 31 AS INTEGER), 1)), 'string_agg', '') AS d FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM b)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to
FROM f"""


def _merkle_log(levels: int = 6) -> str:
    """Trees of up to ``16 ** levels`` leaves, level by level.  ``lone``: the level has one node, so it is the top."""
    f = lambda c: f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR), '-')"
    h = lambda text: "sha256(" + " || ".join(f(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    def tree(name: str, start: str) -> str:
        """Nodes ``(tree, i, d)`` by level; a lone node goes up as it is."""
        out = f"{name}0 AS (SELECT tree, i, d, count(*) OVER (PARTITION BY tree) = 1 AS lone FROM {start})"
        for k in range(levels):
            out += f""",
{name}{k + 1} AS (SELECT *, count(*) OVER (PARTITION BY tree) = 1 AS lone FROM (
  SELECT tree, i // 16 AS i, CASE WHEN any_value(lone) THEN any_value(d) ELSE sha256(string_agg(d, '' ORDER BY i)) END AS d
  FROM {name}{k} GROUP BY tree, i // 16))"""
        return out

    def climb(name: str, level: str, key: str, start: str) -> str:
        """Folds ``fold`` up the tree from its ``place`` and collects siblings."""
        out, before = "", start
        for k in range(levels):
            out += f""",
{level}g{k} AS (SELECT tree, i // 16 AS run, list(d ORDER BY i) AS ds, any_value(lone) AS lone FROM {name}{k} GROUP BY tree, i // 16),
{level}{k} AS (SELECT b.* EXCLUDE (fold, proof, place), place // 16 AS place,
    CASE WHEN lone THEN fold ELSE sha256(list_aggregate(ds[1:place % 16] || [fold] || ds[place % 16 + 2:], 'string_agg', '')) END AS fold,
    CASE WHEN lone THEN proof ELSE proof || coalesce(list_aggregate(ds[1:place % 16] || ds[place % 16 + 2:], 'string_agg', ''), '') END AS proof
  FROM {before} b JOIN {level}g{k} g ON b.{key} = g.tree AND b.place // 16 = g.run)"""
            before = f"{level}{k}"
        return out

    last = f"{levels}"
    return f"""
WITH sources AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT source FROM documents)),
crc AS (SELECT doc_id, 4294967295 - list_reduce([4294967295] || list_transform(range(1, length(s) + 1), lambda j: CAST(ord(s[j]) AS BIGINT)),
    lambda c, b: list_reduce([xor(c, b)] || range(8), lambda v, r: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)) AS c
  FROM (SELECT DISTINCT doc_id, CAST(doc_id AS VARCHAR) AS s FROM documents)),
leaves AS (SELECT d.doc_id, tree, row_number() OVER (PARTITION BY tree ORDER BY d.doc_id) - 1 AS i, leaf AS d, leaf,
    CASE WHEN c % 5 = 0 THEN other ELSE leaf END AS fold
  FROM (SELECT doc_id, source, {h('text')} AS leaf,
      {h("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS other FROM documents) d
  JOIN sources s ON d.source IS NOT DISTINCT FROM s.source JOIN crc ON d.doc_id = crc.doc_id),
{tree('n', 'leaves')},
subs AS (SELECT 0 AS tree, tree AS i, d FROM n{last}),
{tree('m', 'subs')},
d0 AS (SELECT doc_id, tree, tree AS sub, leaf, i AS place, fold, '' AS proof FROM leaves){climb('n', 'u', 'tree', 'd0')},
s0 AS (SELECT doc_id, sub, 0 AS zero, leaf, sub AS place, fold, proof FROM u{levels - 1}){climb('m', 'w', 'zero', 's0')}
SELECT w.doc_id, leaf, n.d AS subroot, m.d AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = m.d AS verified
FROM w{levels - 1} w JOIN n{last} n ON w.sub = n.tree JOIN m{last} m ON true"""


SECRET_SCAN = _secret_scan()
MERKLE_LOG = _merkle_log()
CHAT_FORMAT = _chat_format()
