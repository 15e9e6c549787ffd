"""DuckDB SQL for those queries of this package that SQL can express."""

from __future__ import annotations

_UNITS = """
    SELECT doc_id, unit, pos,
        coalesce(sum(length(unit) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
    FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS unit,
                 generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)
"""

_LINE_DEDUP = f"""
WITH l AS ({_UNITS}),
s AS (SELECT doc_id, pos, unit AS a, lead(unit) OVER w AS b, lead(unit, 2) OVER w AS c, lead(pos, 2) OVER w AS third FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
later AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) AS n FROM s WHERE third IS NOT NULL),
gone AS (SELECT DISTINCT doc_id, pos + d.i AS pos FROM later, (SELECT unnest([0, 1, 2]) AS i) d WHERE n > 1),
marked AS (SELECT l.*, g.pos IS NOT NULL AS out FROM l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos),
islands AS (SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM gone),
runs AS (SELECT doc_id, string_agg((first - 1) || '-' || last, ' ' ORDER BY first) AS runs
         FROM (SELECT doc_id, min(pos) AS first, max(pos) AS last FROM islands GROUP BY doc_id, island) GROUP BY doc_id),
texts AS (SELECT doc_id, count(*)::INT AS n_lines, count(*) FILTER (out)::INT AS n_removed_lines,
                 sha256(coalesce(string_agg(unit, chr(10) ORDER BY pos) FILTER (NOT out), '')) AS kept_sha256 FROM marked GROUP BY doc_id)
SELECT t.doc_id, n_lines, n_removed_lines, coalesce(runs, '') AS removed_runs, kept_sha256 FROM texts t LEFT JOIN runs r ON t.doc_id = r.doc_id
"""

_NORM = "trim(regexp_replace(lower({x}), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))"
_SENTENCES = "regexp_extract_all(unit, '[^.!?]*[.!?]+[ \\t]*|[^.!?]+')"
_LINE_HASH_DEDUP = f"""
WITH l AS ({_UNITS}),
t AS (SELECT doc_id, pos, start, unnest({_SENTENCES}) AS tok, generate_subscripts({_SENTENCES}, 1) AS k, len({_SENTENCES}) AS n_tok FROM l),
s AS (SELECT *, start + coalesce(sum(length(tok)) OVER (PARTITION BY doc_id, pos ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ofs FROM t),
keys AS (SELECT 's' AS kind, doc_id, pos, k, ofs, {_NORM.format(x="tok")} AS norm FROM s
         UNION ALL SELECT 'u', l.doc_id, l.pos, 0, l.start, {_NORM.format(x="unit")} FROM l WHERE len({_SENTENCES}) > 1),
copies AS (SELECT kind, doc_id, pos, k FROM keys WHERE length(norm) - length(replace(norm, ' ', '')) >= 4
           QUALIFY row_number() OVER (PARTITION BY kind, norm ORDER BY doc_id, ofs) > 1),
m AS (SELECT s.*, c.k IS NOT NULL OR u.doc_id IS NOT NULL AS out FROM s
      LEFT JOIN copies c ON c.kind = 's' AND c.doc_id = s.doc_id AND c.pos = s.pos AND c.k = s.k
      LEFT JOIN copies u ON u.kind = 'u' AND u.doc_id = s.doc_id AND u.pos = s.pos),
r AS (SELECT doc_id, min(ofs) AS a, max(ofs + length(tok)) AS b FROM (
        SELECT *, k - row_number() OVER (PARTITION BY doc_id, pos ORDER BY k) AS island FROM m WHERE out) GROUP BY doc_id, pos, island),
runs AS (SELECT doc_id, string_agg(a::BIGINT || '-' || b::BIGINT, ' ' ORDER BY a) AS spans, sum(b - a)::BIGINT AS n FROM r GROUP BY doc_id),
kept AS (SELECT doc_id, pos, coalesce(string_agg(tok, '' ORDER BY k) FILTER (NOT out), '') AS rest, bool_or(out) AS cut FROM m GROUP BY doc_id, pos),
texts AS (SELECT l.doc_id, max(l.start + length(l.unit))::INT AS n_chars,
                 sha256(coalesce(string_agg(coalesce(rest, ''), chr(10) ORDER BY l.pos) FILTER (coalesce(rest, '') <> '' OR NOT coalesce(cut, false)), '')) AS kept_sha256
          FROM l LEFT JOIN kept k ON k.doc_id = l.doc_id AND k.pos = l.pos GROUP BY l.doc_id)
SELECT t.doc_id, n_chars, coalesce(n, 0) AS n_removed, coalesce(spans, '') AS removed_spans, kept_sha256 FROM texts t LEFT JOIN runs r ON r.doc_id = t.doc_id
"""

_ROOT = (
    "sha256(array_to_string(list_transform(string_split({t}, chr(10) || chr(10)), lambda s: "
    "sha256(array_to_string(list_transform(string_split(s, chr(10)), lambda p: sha256(p)), ','))), '|'))"
)
_LEAVES = "list_distinct(regexp_extract_all({t}, '[^\\n]{{1,32}}'))"
_NEAR = (
    "CASE WHEN fingerprint = {x}_fingerprint THEN 1.0 WHEN len(leaves) + len({x}_leaves) = 0 THEN 0.0 "
    "ELSE 2.0::DOUBLE * len(list_intersect(leaves, {x}_leaves)) / (len(leaves) + len({x}_leaves)) END::DOUBLE AS near_{x}"
)
_MERKLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id, text), first(text) OVER (ORDER BY doc_id, text)) AS next, length(text) AS n_chars FROM d),
e AS (SELECT *, substring(text, 1, n_chars - n_chars // 4) || substring(next, 1, n_chars // 4) AS edited FROM w),
f AS (SELECT *, {_ROOT.format(t="text")} AS fingerprint, {_ROOT.format(t="edited")} AS edited_fingerprint, {_ROOT.format(t="next")} AS next_fingerprint,
             {_LEAVES.format(t="text")} AS leaves, {_LEAVES.format(t="edited")} AS edited_leaves, {_LEAVES.format(t="next")} AS next_leaves FROM e)
SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, fingerprint, edited_fingerprint, {_NEAR.format(x="edited")}, {_NEAR.format(x="next")} FROM f
"""



def _field(name: str) -> str:
    return f"coalesce(strlen({name}::VARCHAR)::VARCHAR || ':' || {name}::VARCHAR, '-')"


# CRC-32 of a number's decimal digits, one bit a step.
_CRC32 = (
    "xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''), "
    "lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda c, b: xor(xor(c, b) >> 1, (xor(c, b) & 1) * 3988292384)), 4294967295)"
)


def _levels(name: str, n: int) -> str:
    """Nodes (tid, idx, m, digest) of up to n levels over the table name0; a tree of one node stays as it is."""
    return "".join(
        f"""{name}{i + 1} AS (SELECT tid, idx // 16 AS idx, CASE WHEN m > 1 THEN (m + 15) // 16 ELSE 1 END AS m,
            CASE WHEN m > 1 THEN sha256(string_agg(digest, '' ORDER BY idx)) ELSE any_value(digest) END AS digest FROM {name}{i} GROUP BY tid, idx // 16, m),
"""
        for i in range(n)
    )


def _folds(name: str, nodes: str, n: int) -> str:
    """Proof and folded digest of every row (rid, tid, idx, proof, folded) of name0, level by level."""
    return "".join(
        f"""{name}{i + 1} AS (SELECT f.rid, f.tid, f.idx // 16 AS idx,
            f.proof || CASE WHEN m > 1 THEN coalesce(string_agg(n.digest, '' ORDER BY n.idx) FILTER (n.idx <> f.idx), '') ELSE '' END AS proof,
            CASE WHEN m > 1 THEN sha256(string_agg(CASE WHEN n.idx = f.idx THEN f.folded ELSE n.digest END, '' ORDER BY n.idx)) ELSE f.folded END AS folded
            FROM {name}{i} f JOIN {nodes}{i} n ON n.tid = f.tid AND n.idx // 16 = f.idx // 16 GROUP BY f.rid, f.tid, f.idx, f.proof, f.folded, m),
"""
        for i in range(n)
    )


_LEVELS, _UPPER = 5, 3
_HEAD = " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars"))
_MANIFEST = f"""
WITH d AS (SELECT *, row_number() OVER () AS rid, dense_rank() OVER (ORDER BY source NULLS FIRST) AS tid, sha256({_HEAD} || {_field("text")}) AS leaf FROM documents),
e AS (SELECT *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered FROM d),
l AS (SELECT rid, doc_id, tid, leaf, CASE WHEN doc_id IS NOT NULL AND {_CRC32} % 5 = 0 THEN sha256({_HEAD} || {_field("lowered")}) ELSE leaf END AS claim,
             row_number() OVER (PARTITION BY tid ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tid) AS m FROM e),
n0 AS (SELECT tid, idx, m, leaf AS digest FROM l),
{_levels("n", _LEVELS)}
s0 AS (SELECT 0 AS tid, tid - 1 AS idx, count(*) OVER () AS m, digest FROM n{_LEVELS}),
{_levels("s", _UPPER)}
f0 AS (SELECT rid, tid, idx, '' AS proof, claim AS folded FROM l),
{_folds("f", "n", _LEVELS)}
g0 AS (SELECT rid, 0 AS tid, tid - 1 AS idx, proof, folded FROM f{_LEVELS}),
{_folds("g", "s", _UPPER)}
t AS (SELECT digest AS root FROM s{_UPPER})
SELECT l.doc_id, l.leaf, n.digest AS subroot, t.root, sha256(g.proof) AS proof_sha256, g.folded AS folded_root, g.folded = t.root AS verified
FROM l JOIN n{_LEVELS} n ON n.tid = l.tid JOIN g{_UPPER} g ON g.rid = l.rid CROSS JOIN t
"""


def _assigned(i: int) -> str:
    """The nearest entry of each part among the entries of round i, with its distance."""
    return f"""a{i} AS (SELECT rid, part, min(d * 64 + entry) % 64 AS entry, min(d * 64 + entry) // 64 AS d FROM (
        SELECT rid, p.part, entry, list_sum(list_transform(range(1, w + 1), lambda k: (p.q[k] - c.q[k]) * (p.q[k] - c.q[k])))::BIGINT AS d
        FROM p JOIN c{i} c ON c.part = p.part) GROUP BY rid, part),
"""


def _moved(i: int) -> str:
    return f"""m{i} AS (SELECT part, entry, list(floor(s / n)::BIGINT ORDER BY k) AS q FROM (
        SELECT p.part, entry, k, sum(p.q[k])::DOUBLE AS s, count(*) AS n FROM a{i} a JOIN p ON p.rid = a.rid AND p.part = a.part, unnest(range(1, w + 1)) u(k)
        GROUP BY p.part, entry, k) GROUP BY part, entry),
c{i + 1} AS (SELECT c.part, c.entry, coalesce(m.q, c.q) AS q FROM c{i} c LEFT JOIN m{i} m ON m.part = c.part AND m.entry = c.entry),
"""


_VECTOR_CODES = f"""
WITH v AS (SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q, len(embedding) // 16 AS w
           FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT rid, part, w, q[part * w + 1 : (part + 1) * w] AS q FROM v, unnest(range(16)) u(part)),
c0 AS (SELECT part, rid - 1 AS entry, q FROM p WHERE rid <= 64),
{_assigned(0)}{_moved(0)}{_assigned(1)}{_moved(1)}{_assigned(2)}
b AS (SELECT sha256(string_agg(q[k]::VARCHAR, ',' ORDER BY part, entry, k)) AS sha FROM c2, unnest(range(1, len(q) + 1)) u(k)),
r AS (SELECT rid, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY rid)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, b.sha AS codebooks_sha256 FROM v JOIN r ON r.rid = v.rid CROSS JOIN b
"""

SQL: dict[str, str] = {
    "op5_line_dedup": _LINE_DEDUP,
    "op6_line_hash_dedup": _LINE_HASH_DEDUP,
    "op10_merkle_fingerprints": _MERKLE,
    "op12_merkle_manifest": _MANIFEST,
    "op13_vector_codes": _VECTOR_CODES,
}
