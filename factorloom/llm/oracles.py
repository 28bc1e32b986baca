"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def crc32(text: str) -> str:
    """Unsigned CRC-32 of a short ASCII text, bit by bit."""
    step = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    byte = f"list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, k: {step})"
    codes = f"list_transform(string_split({text}, ''), lambda ch: ascii(ch)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: {byte}), 4294967295)"


def _cut(table: str, row: str) -> str:
    return rf"""SELECT {row}, list_filter(string_split_regex(translate(text, '{UPPER}', '{LOWER}'),
                '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM {table}"""


DECONTAMINATION = f"""
WITH item AS ({_cut("benchmark", "item_id")}),
doc AS ({_cut("documents", "row_number() OVER () AS r, doc_id")}),
win AS (
    SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s + 1:s + 10], ' ') AS g
    FROM (SELECT item_id, w, unnest(range(greatest(len(w) - 10, 0) + 1)) AS s FROM item WHERE len(w) > 0)),
run AS (
    SELECT r, s, n, array_to_string(w[s + 1:s + n], ' ') AS g
    FROM (SELECT r, w, n, unnest(range(len(w) - n + 1)) AS s FROM doc, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
found AS (SELECT r, s, run.n, item_id FROM run JOIN win USING (g)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM found) GROUP BY r),
items AS (
    SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
    FROM (SELECT DISTINCT r, coalesce(item_id::VARCHAR, '') AS item FROM found) GROUP BY r)
SELECT doc_id, coalesce(len(w), 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (r) LEFT JOIN items USING (r)"""


def _leaf(n_chars: str) -> str:
    fields = [f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", n_chars, "text")]
    return f"sha256({' || '.join(fields)})"


MERKLE = f"""
WITH RECURSIVE
row_ AS (
    SELECT doc_id, lang, {_leaf("n_chars")} AS leaf,
           CASE WHEN {crc32("doc_id::VARCHAR")} % 7 = 0 THEN {_leaf("(n_chars + 1)")} END AS changed
    FROM documents),
leaf_ AS (
    SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) AS g,
           row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p FROM row_),
up AS (
    SELECT g, 0 AS lvl, p, leaf AS h, count(*) OVER (PARTITION BY g) AS n FROM leaf_
    UNION ALL
    SELECT g, lvl + 1, p // 2, sha256(string_agg(h, '' ORDER BY p)), (n + 1) // 2 FROM up WHERE n > 1 GROUP BY g, lvl, p // 2, n),
sub AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS q FROM up WHERE n = 1),
over_ AS (
    SELECT 0 AS lvl, q AS p, subroot AS h, count(*) OVER () AS n FROM sub
    UNION ALL
    SELECT lvl + 1, p // 2, sha256(string_agg(h, '' ORDER BY p)), (n + 1) // 2 FROM over_ WHERE n > 1 GROUP BY lvl, p // 2, n),
tall AS (SELECT g, max(lvl) AS depth FROM up GROUP BY g),
wide AS (SELECT max(lvl) AS depth FROM over_),
step AS (
    SELECT doc_id, leaf, g, p, k AS lvl, xor(p >> k, 1) AS sib, (p >> k) & 1 AS side
    FROM leaf_ JOIN tall USING (g), unnest(range(depth)) AS t(k)),
path AS (
    SELECT s.doc_id, s.leaf, s.g, s.p, list(CASE WHEN u.h IS NULL THEN 'N' WHEN side = 1 THEN 'L' || u.h ELSE 'R' || u.h END ORDER BY s.lvl) AS a
    FROM step s LEFT JOIN up u ON u.g = s.g AND u.lvl = s.lvl AND u.p = s.sib GROUP BY ALL),
gstep AS (SELECT g, k AS lvl, xor(q >> k, 1) AS sib, (q >> k) & 1 AS side FROM sub, wide, unnest(range(depth)) AS t(k)),
gpath AS (
    SELECT s.g, list(CASE WHEN u.h IS NULL THEN 'N' WHEN side = 1 THEN 'L' || u.h ELSE 'R' || u.h END ORDER BY s.lvl) AS b
    FROM gstep s LEFT JOIN over_ u ON u.lvl = s.lvl AND u.p = s.sib GROUP BY s.g),
whole AS (
    SELECT l.doc_id, l.leaf, l.changed, sub.subroot, (SELECT h FROM over_ WHERE n = 1) AS root,
           list_concat(coalesce(a, []), coalesce(b, [])) AS way
    FROM leaf_ l JOIN sub USING (g) LEFT JOIN path ON path.g = l.g AND path.p = l.p LEFT JOIN gpath ON gpath.g = l.g),
folded AS (
    SELECT *, list_reduce(list_prepend(coalesce(changed, leaf), way),
                          lambda x, s: CASE s[1] WHEN 'L' THEN sha256(s[2:] || x) WHEN 'R' THEN sha256(x || s[2:]) ELSE sha256(x) END) AS folded_root
    FROM whole)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(way, lambda s: s[2:]), ''), '')) AS proof_sha256,
       folded_root, folded_root = root AS verified
FROM folded"""


def _before(cost: str, letter: str, best: str) -> str:
    """The best of an edit and what follows it; a best is eight digits of cost, then letters, so text order is its order."""
    return f"(printf('%08d', ({cost}) + left({best}, 8)::INT) || '{letter}' || {best}[9:])"


def _gap(turn: list[str]) -> list[str]:
    """Bests before a gap, where turns may be inserted, from those of the turn behind it."""
    one = [_before("2", "I", turn[2]), _before("2", "I", turn[2]), _before("2", "I", turn[3]), _before("2", "I", turn[2])]
    two = _before("2", "I", _before("2", "I", turn[3]))
    return [f"least({turn[s]}, {one[s]}{f', {two}' if s < 2 else ''})" for s in range(4)]


def _turn() -> list[str]:
    """Bests from each state with the turn (c, fault) still to be dealt with; b0..b3 follow it."""
    out = []
    for s in range(4):
        choices = [_before("3", "D", f"b{s}"), f"CASE WHEN fault < 2 THEN {_before('2 + fault', 'R', 'b3' if s == 2 else 'b2')} END"]
        for role, ok, to in (("s", s == 0, 1), ("u", s != 2, 2), ("a", s == 2, 3)):
            if ok:
                choices.append(f"CASE WHEN fault < 2 AND c = '{role}' THEN {_before('fault', 'K', f'b{to}')} END")
        out.append(f"least({', '.join(choices)})")
    return out


_T = [f"f{s}" for s in range(4)]
REPAIR = rf"""
WITH RECURSIVE
fate AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           {crc32("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS f
    FROM conversations),
hurt AS (
    SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
           CASE WHEN f = 1 THEN '' WHEN f = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM fate, unnest(range(CASE WHEN f = 3 THEN 2 ELSE 1 END)) AS t(k) WHERE f <> 0),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
           count(*) OVER (PARTITION BY conv_id) AS n, coalesce(conv_id::VARCHAR, '-') AS g FROM hurt),
seen AS (SELECT *, row_number() OVER (PARTITION BY g, role, text ORDER BY i) AS nth, rtrim(text, E' \t\n\x0B\x0C\r') AS shown FROM placed),
named AS (
    SELECT *, left(role, 1) AS c, lag(left(role, 1)) OVER (PARTITION BY g ORDER BY i) AS prev,
           CASE WHEN shown = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(shown, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS what
    FROM seen),
coded AS (SELECT *, CASE WHEN what IN ('blank', 'duplicate') THEN 2 WHEN what = 'truncated' THEN 1 ELSE 0 END AS fault FROM named),
back AS (
    SELECT g, n + 1 AS i, '00000000' AS b0, '00000004II' AS b1, '00000002I' AS b2, '00000000' AS b3 FROM (SELECT DISTINCT g, n FROM coded)
    UNION ALL
    SELECT g, i, {', '.join(_gap(_T))}
    FROM (SELECT coded.g, coded.i, {', '.join(f'{e} AS f{s}' for s, e in enumerate(_turn()))} FROM back JOIN coded ON coded.g = back.g AND coded.i = back.i - 1)),
best AS (SELECT g, left(b0, 8)::INT AS cost, b0[9:] AS audit FROM back WHERE i = 1),
letter AS (
    SELECT g, k, audit[k] AS x, sum(CASE WHEN audit[k] = 'I' THEN 0 ELSE 1 END) OVER w AS i,
           sum(CASE WHEN audit[k] = 'D' THEN 0 ELSE 1 END) OVER w AS o
    FROM best, unnest(range(1, len(audit) + 1)) AS t(k) WINDOW w AS (PARTITION BY g ORDER BY k)),
kept AS (
    SELECT l.g, k, x, o, CASE WHEN x = 'I' THEN '' ELSE text END AS text, role,
           max(CASE WHEN o = 1 AND x = 'K' AND c = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.g) AS led
    FROM letter l LEFT JOIN coded ON coded.g = l.g AND coded.i = l.i AND x <> 'I' WHERE x <> 'D'),
line AS (
    SELECT g, string_agg(CASE WHEN x = 'K' THEN role WHEN (o - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, E'\n' ORDER BY k) AS t
    FROM kept GROUP BY g),
counts AS (
    SELECT g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (what = 'blank') AS blank,
           count(*) FILTER (what = 'duplicate') AS duplicate, count(*) FILTER (what = 'truncated') AS truncated,
           count(*) FILTER (prev IS NOT NULL AND prev || c NOT IN ('su', 'ua', 'au')) AS illegal FROM coded GROUP BY g)
SELECT conv_id, {', '.join(f'coalesce({x}, 0)::BIGINT AS {x}' for x in ('gaps', 'blank', 'duplicate', 'truncated', 'illegal', 'cost'))},
       coalesce(audit, '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(conv_id::VARCHAR, '-') AS g FROM conversations)
LEFT JOIN counts USING (g) LEFT JOIN best USING (g) LEFT JOIN line USING (g)"""
