"""DuckDB SQL of the corpus queries that SQL can express."""

from __future__ import annotations

LEXICAL = r"""
WITH terms AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts, row_number() OVER () AS r
  FROM documents),
sizes AS (SELECT r, doc_id, len(ts)::BIGINT AS n FROM terms WHERE len(ts) > 0),
whole AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM sizes),
counted AS (SELECT r, t, count(*)::BIGINT AS tf FROM (SELECT r, unnest(ts) AS t FROM terms) GROUP BY r, t),
weights AS (SELECT t, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM counted, whole GROUP BY t, big_n),
items AS (
  SELECT row_number() OVER () AS i, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM benchmark),
asked AS (SELECT i, item_id, t, count(*)::BIGINT AS times FROM (SELECT i, item_id, unnest(ts) AS t FROM items) GROUP BY i, item_id, t),
scored AS (
  SELECT i, item_id, doc_id, r, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // big_l))))::BIGINT AS score
  FROM asked JOIN weights USING (t) JOIN counted USING (t) JOIN sizes USING (r), whole
  GROUP BY i, item_id, doc_id, r),
ranked AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""

MIXING = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
s AS (
  SELECT r, doc_id, source, len(ws)::BIGINT AS size, md5('mix-1|' || coalesce(doc_id::VARCHAR, '-') || '|' || t) AS digest,
    greatest(CASE WHEN len(ws) > 0 THEN length(regexp_replace(t, '[\x00-\x40\x5B-\x60\x7B-\x7F]+', '', 'g'))::DOUBLE / greatest(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')), 1)
      * least(len(list_distinct(ws))::DOUBLE / greatest(least(len(ws), 100), 1), 1.0::DOUBLE) ELSE 0.0::DOUBLE END, 0.05::DOUBLE) AS weight
  FROM w),
k AS (SELECT *, -ln((('0x' || substr(digest, 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496::DOUBLE) / weight AS key FROM s),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
n AS (
  SELECT source, source_size, [5, 2, 1][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT]::DOUBLE AS weight,
    (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS budget
  FROM src),
c AS (SELECT *, source_size::DOUBLE * 2.0::DOUBLE AS cap, sum(weight) OVER () AS total FROM n),
f AS (
  SELECT *, (budget - coalesce(sum(cap) OVER before, 0)) / (total - coalesce(sum(weight) OVER before, 0)) * weight >= cap AS is_full
  FROM c WINDOW before AS (ORDER BY cap / weight, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (
  SELECT source, source_size, CASE WHEN is_full THEN cap ELSE (budget - coalesce(sum(cap) FILTER (is_full) OVER (), 0)) / (total - coalesce(sum(weight) FILTER (is_full) OVER (), 0)) * weight END AS target
  FROM f),
p AS (
  SELECT k.*, source_size, target, round(target)::BIGINT AS words,
    coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id NULLS FIRST, digest, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM k JOIN g ON k.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
  (CASE WHEN source_size > 0 THEN words // source_size * size + greatest(least(words % source_size - before, size), 0) ELSE 0 END)::BIGINT AS taken
FROM p
"""


def _merkle(levels: int = 12) -> str:
    """The tree level by level: each level of nodes is a table, for as many levels as any table of a test needs."""

    def field(c: str) -> str:
        return f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')"

    fields = " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars"))
    third = "(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda crc, b: list_reduce(range(8), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)), xor(crc, b)), 4294967295)) "
    parts = [
        f"""d AS (SELECT doc_id, lang, sha256({fields} || {field("text")}) AS leaf,
  coalesce(xor({third}, 4294967295) % 3 = 0, false) AS third,
  sha256({fields} || {field("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) AS other FROM documents)""",
        "r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY lang) AS n FROM d)",
    ]

    def climb(name: str, first: str) -> list[str]:
        """Tables of nodes (g, p, n, h) by level, and of the leaves' ways up (g, p0, sibs, f, alt): a node that is alone
        stays as it is; n is 1 for it."""
        out = [f"{name}0 AS ({first})"]
        for k in range(levels):
            now = f"{name}{k}"
            out.append(
                f"""{name}{k + 1} AS MATERIALIZED (SELECT g, p // 8 AS p, ((any_value(n) + 7) // 8)::BIGINT AS n,
  CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY p)) ELSE any_value(h) END AS h FROM {now} GROUP BY g, p // 8)"""
            )
        return out

    def walk(name: str, start: str, node: str) -> list[str]:
        """From ``start`` (id, g, p, sibs, alt) up through the tables of ``node``: siblings are added, alt is folded."""
        out = [f"{name}0 AS ({start})"]
        for k in range(levels):
            out.append(
                f"""{name}{k + 1} AS MATERIALIZED (SELECT w.id, w.g, w.p // 8 AS p,
  any_value(w.sibs) || coalesce(string_agg(t.h, '' ORDER BY t.p) FILTER (t.p <> w.p), '') AS sibs,
  CASE WHEN any_value(t.n) > 1 THEN sha256(string_agg(CASE WHEN t.p = w.p THEN w.alt ELSE t.h END, '' ORDER BY t.p)) ELSE any_value(w.alt) END AS alt
  FROM {name}{k} w JOIN {node}{k} t ON t.g = w.g AND t.p // 8 = w.p // 8 GROUP BY w.id, w.g, w.p)"""
            )
        return out

    group = "coalesce('x' || lang, '')"
    parts += climb("a", f"SELECT {group} AS g, p, n, leaf AS h FROM r")
    parts.append(f"s AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS p, count(*) OVER () AS n FROM a{levels})")
    parts += climb("b", "SELECT '' AS g, p, n, subroot AS h FROM s")
    parts.append(f"i AS (SELECT row_number() OVER () AS id, {group} AS g, * FROM r)")
    parts += walk("u", "SELECT id, g, p, '' AS sibs, CASE WHEN third THEN other ELSE leaf END AS alt FROM i", "a")
    parts += walk("v", f"SELECT id, '' AS g, s.p, sibs, alt FROM u{levels} u JOIN s ON s.g = u.g", "b")
    return f"""WITH {", ".join(parts)}
SELECT i.doc_id, i.leaf, s.subroot, b.h AS root, sha256(v.sibs) AS proof_sha256, v.alt AS folded_root, v.alt = b.h AS verified
FROM i JOIN s ON s.g = i.g JOIN v{levels} v ON v.id = i.id JOIN b{levels} b ON true"""


ORACLES = {"op11_lexical_search": LEXICAL, "op12_mixing": MIXING, "op13_merkle": _merkle(7)}
