"""Longer statements of the numbered operators in DuckDB's SQL."""

from __future__ import annotations

#: One row with the table ``t`` of CRC-32, from its rule.
CRC_TABLE = """crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i)))"""


def crc32(text: str) -> str:
    """The unsigned CRC-32 of the UTF-8 bytes of ``text``; ``t`` must be in scope."""
    octets = f"list_transform(range(strlen({text})), lambda k: ('0x' || substr(hex({text}), CAST(2 * k + 1 AS BIGINT), 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, o: xor(c >> 8, t[(xor(c, o) & 255) + 1])), 4294967295::BIGINT)"


def ascii_lower(text: str) -> str:
    return f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


SPELLING = f"""
WITH RECURSIVE {CRC_TABLE},
runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
pairs AS (SELECT doc_id, {ascii_lower("run")} AS run, count(*) AS n FROM runs GROUP BY ALL),
keyed AS (SELECT run, n, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS key FROM pairs),
hashed AS (SELECT run, n, {crc32("key")} AS h FROM keyed, crc_table),
words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT n, CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
less AS (SELECT word, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM words, LATERAL (SELECT unnest(range(1, length(word) + 1)) AS i)),
near AS (
  SELECT a.word, b.word AS other FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT l.word, w.word FROM less l JOIN words w ON l.rest = w.word
  UNION SELECT w.word, l.word FROM less l JOIN words w ON l.rest = w.word),
best AS (SELECT p.word, count(*) AS n_near, arg_min(p.other, (-o.n, p.other)) AS other, max(o.n) AS top FROM near p JOIN words o ON o.word = p.other GROUP BY p.word),
forms AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.top >= 2 * w.n THEN b.other END AS form, CASE WHEN b.top >= 2 * w.n THEN b.top END AS form_n
  FROM words w LEFT JOIN best b USING (word)),
ways AS (SELECT word, form AS at FROM forms WHERE form IS NOT NULL UNION ALL SELECT w.word, f.form FROM ways w JOIN forms f ON f.word = w.at WHERE f.form IS NOT NULL),
ends AS (SELECT w.word, w.at FROM ways w JOIN forms f ON f.word = w.at WHERE f.form IS NULL)
SELECT f.word, f.form, coalesce(e.at, f.word) AS root, f.n, f.n_near, f.form_n FROM forms f LEFT JOIN ends e USING (word)
"""

#: Levels that the statement below has: enough for 16 ** 5 rows in a source and 16 ** 4 sources.
SOURCE_LEVELS, UPPER_LEVELS = 5, 4


def framed(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


def leaf(text: str) -> str:
    return f"sha256({' || '.join(framed(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"


def tree(name: str, levels: int) -> str:
    """The levels ``name``1 ... above ``name``0 (tree, place, total, digest), and for each node that has a parent what stands before and after it (``name``0_beside ...)."""
    out = []
    for k in range(levels):
        out.append(f"{name}{k + 1} AS (SELECT tree, place // 16 AS place, (total + 15) // 16 AS total, sha256(string_agg(digest, '' ORDER BY place)) AS digest FROM {name}{k} WHERE total > 1 GROUP BY tree, place // 16, total)")
        run = "OVER (PARTITION BY tree, place // 16 ORDER BY place ROWS BETWEEN"
        out.append(
            f"{name}{k}_beside AS (SELECT tree, place, coalesce(string_agg(digest, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before, coalesce(string_agg(digest, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after FROM {name}{k} WHERE total > 1)"
        )
    return ",\n".join(out)


def climbed(name: str, levels: int, at: str, start: str) -> str:
    """Steps from ``start`` (n, tree, place, found, others) to the top of its tree, as ``at``0, ``at``1 ..."""
    out = [f"{at}0 AS ({start})"]
    for k in range(levels):
        out.append(
            f"{at}{k + 1} AS (SELECT p.n, p.tree, p.place // 16 AS place, CASE WHEN b.place IS NULL THEN found ELSE sha256(before || found || after) END AS found, others || coalesce(before || after, '') AS others FROM {at}{k} p LEFT JOIN {name}{k}_beside b ON b.tree IS NOT DISTINCT FROM p.tree AND b.place = p.place)"
        )
    return ",\n".join(out)


def tops(name: str, levels: int) -> str:
    return " UNION ALL ".join(f"SELECT tree, digest FROM {name}{k} WHERE total = 1" for k in range(levels + 1))


MERKLE = f"""
WITH {CRC_TABLE},
keyed AS (SELECT *, CAST(doc_id AS VARCHAR) AS key FROM documents),
leaves AS (
  SELECT doc_id, source, {leaf("text")} AS leaf, CASE WHEN {crc32("key")} % 5 = 0 THEN {leaf(ascii_lower("text"))} END AS bent
  FROM keyed, crc_table),
rows_fx AS (
  SELECT *, row_number() OVER () AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, bent) - 1 AS place, count(*) OVER (PARTITION BY source) AS total FROM leaves),
s0 AS (SELECT source AS tree, place, total, leaf AS digest FROM rows_fx),
{tree("s", SOURCE_LEVELS)},
subroots AS ({tops("s", SOURCE_LEVELS)}),
u0 AS (SELECT 'all' AS tree, tree AS source, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS place, count(*) OVER () AS total, digest FROM subroots),
{tree("u", UPPER_LEVELS)},
roots AS ({tops("u", UPPER_LEVELS)}),
{climbed("s", SOURCE_LEVELS, "p", "SELECT n, source AS tree, place, coalesce(bent, leaf) AS found, '' AS others FROM rows_fx")},
{climbed("u", UPPER_LEVELS, "q", f"SELECT p.n, 'all' AS tree, u.place, p.found, p.others FROM p{SOURCE_LEVELS} p JOIN u0 u ON u.source IS NOT DISTINCT FROM p.tree")}
SELECT r.doc_id, r.leaf, u.digest AS subroot, t.digest AS root, sha256(q.others) AS proof_sha256, q.found AS folded_root, q.found = t.digest AS verified
FROM rows_fx r JOIN q{UPPER_LEVELS} q USING (n) JOIN u0 u ON u.source IS NOT DISTINCT FROM r.source CROSS JOIN roots t
"""
