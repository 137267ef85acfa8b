"""DuckDB SQL that states what the queries of this package return, where SQL can."""

from __future__ import annotations

#: translate() pairs that lower-case A to Z and nothing else.
_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def near_duplicates(docs: str = "documents") -> str:
    """CTEs `sizes` and `member` (doc_id, component_id) over a table of documents."""
    return f"""
worded AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), {_LOWER}), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS ws FROM {docs}),
shingles AS (
    SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' ')) END)) AS g FROM worded),
sizes AS (SELECT doc_id, count(g) AS n FROM worded LEFT JOIN shingles USING (doc_id) GROUP BY doc_id),
links AS (
    SELECT x.a, x.b FROM (SELECT s.doc_id AS a, t.doc_id AS b, count(*) AS both FROM shingles s JOIN shingles t USING (g) GROUP BY ALL) x
    JOIN sizes p ON p.doc_id = x.a JOIN sizes q ON q.doc_id = x.b
    WHERE x.a <> x.b AND 100 * x.both >= 75 * (p.n + q.n - x.both)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM {docs} UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
member AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)"""


OP5 = f"""WITH RECURSIVE {near_duplicates()}
SELECT m.doc_id, s.n AS n_shingles, m.component_id, m.doc_id = m.component_id AS kept FROM member m JOIN sizes s USING (doc_id)"""


def benchmark_hits(docs: str = "documents") -> str:
    """CTEs up to `hits` (doc_id, n_words, n_hit, ids) over a table of documents."""
    split = f"list_filter(regexp_split_to_array(translate(coalesce(text, ''), {_LOWER}), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    return f"""
dw AS (SELECT doc_id, {split} AS ws FROM {docs}),
bw AS (SELECT item_id, {split} AS ws FROM benchmark),
item_windows AS (
    SELECT DISTINCT item_id, least(len(ws), 8) AS l, array_to_string(ws[i : i + least(len(ws), 8) - 1], ' ') AS k
    FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 7, 1) + 1)) AS i FROM bw WHERE len(ws) > 0)),
doc_windows AS (
    SELECT doc_id, i, l, array_to_string(ws[i : i + l - 1], ' ') AS k
    FROM (SELECT doc_id, ws, l, unnest(range(1, len(ws) - l + 2)) AS i FROM dw, (SELECT DISTINCT l FROM item_windows) WHERE len(ws) >= l)),
found AS (SELECT doc_id, i, l, item_id FROM doc_windows JOIN item_windows USING (l, k)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM found) GROUP BY doc_id),
ids AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS ids FROM found GROUP BY doc_id),
hits AS (
    SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(ids, []) AS ids
    FROM dw LEFT JOIN covered USING (doc_id) LEFT JOIN ids USING (doc_id))"""


OP10 = f"""WITH {benchmark_hits()}
SELECT doc_id, n_words, n_hit, len(ids) AS n_items, sha256(array_to_string(ids, ',')) AS items_sha256, len(ids) >= 2 AS contaminated FROM hits"""


OP8 = """WITH worded AS (
    SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS ws FROM documents),
windows AS (
    SELECT doc_id, i, md5(array_to_string(ws[i : i + 34], ' ')) AS k
    FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM worded WHERE len(ws) >= 35)),
again AS (SELECT k FROM windows GROUP BY k HAVING count(*) > 1),
gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(i, i + 35)) AS p FROM windows SEMI JOIN again USING (k)) GROUP BY doc_id),
positions AS (
    SELECT doc_id, len(ws) AS n_words, coalesce(len(ps), 0) AS n_removed,
        CASE WHEN ps IS NULL THEN ws ELSE list_transform(list_filter(range(1, len(ws) + 1), lambda i: NOT list_contains(ps, i)), lambda i: ws[i]) END AS kept
    FROM worded LEFT JOIN gone USING (doc_id))
SELECT doc_id, n_words, n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM positions"""
