"""DuckDB SQL for the operators on words and turns."""

from __future__ import annotations

#: crc32 of UTF-8 text byte by byte: its table of 256 entries from the rule, then a fold over the bytes.
_CRC_TABLE = """
    bits(i, k, v) AS (
        SELECT i, 0, i::BIGINT FROM range(256) r(i)
        UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8),
    crc AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8)"""


def _crc(text: str) -> str:
    """SQL of the crc32 of a text whose code points are below U+0800, beside the table ``crc``."""
    points = f"list_transform(string_split({text}, ''), lambda x: unicode(x))"
    data = f"flatten(list_transform({points}, lambda p: CASE WHEN p < 128 THEN [p::BIGINT] ELSE [(192 + (p >> 6))::BIGINT, (128 + (p & 63))::BIGINT] END))"
    return f"xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], {data}), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])))"


#: Near words by what is left of them without one code point: equal rests at equal places, or a rest that is a word.
SPELLING = f"""
    WITH RECURSIVE {_CRC_TABLE},
    runs AS (SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS times
        FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]{{5,}}')) AS r FROM documents) GROUP BY 1, 2),
    hashed AS (SELECT run, times, {_crc("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM runs, crc),
    spelt AS (SELECT times, CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM hashed),
    w AS (SELECT word, sum(times)::BIGINT AS n FROM spelt WHERE length(word) >= 5 GROUP BY 1 HAVING sum(times) >= 3),
    places AS (SELECT word, n, unnest(range(1, length(word) + 1))::INT AS i FROM w),
    cut AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM places),
    near AS (
        SELECT a.word, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
        UNION SELECT a.word, b.word, b.n FROM cut a JOIN w b ON a.rest = b.word
        UNION SELECT b.word, a.word, a.n FROM cut a JOIN w b ON a.rest = b.word),
    best AS (SELECT word, other, m, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY m DESC, other) AS k FROM near),
    f AS (SELECT w.word, w.n, coalesce(b.n_near, 0)::BIGINT AS n_near, CASE WHEN b.m >= 2 * w.n THEN b.other END AS form, CASE WHEN b.m >= 2 * w.n THEN b.m END AS form_n
        FROM w LEFT JOIN best b ON w.word = b.word AND b.k = 1),
    up(word, root) AS (SELECT word, word FROM f UNION ALL SELECT up.word, f.form FROM up JOIN f ON up.root = f.word WHERE f.form IS NOT NULL)
    SELECT f.word, f.form, up.root, f.n, f.n_near, f.form_n FROM f JOIN up ON f.word = up.word JOIN f last ON up.root = last.word WHERE last.form IS NULL
"""


def _step(way: str, cost: str, edit: str) -> str:
    """A way (nine digits of cost, then edits) with one edit more; null stays null."""
    return f"lpad((left({way}, 9)::INT + {cost})::VARCHAR, 9, '0') || substr({way}, 10) || '{edit}'"


def _keep(way: str, initial: str) -> str:
    return f"CASE WHEN NOT gone AND ini = '{initial}' THEN {_step(way, 'trunc', 'K')} END"


def _rerole(way: str) -> str:
    return f"CASE WHEN NOT gone THEN {_step(way, 'trunc + 2', 'R')} END"


#: One row of the best ways to each state (nothing, system, user, assistant) after every turn; the least string is the cheapest and then ASCII-least.
TURNS = f"""
    WITH RECURSIVE {_CRC_TABLE},
    said AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
    hashed AS (SELECT *, ({_crc("name")}) % 20 AS h FROM said, crc),
    damaged AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE WHEN h = 1 THEN '' WHEN h = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
        unnest(CASE WHEN h = 3 THEN [1, 2] ELSE [1] END) AS copy FROM hashed WHERE h <> 0),
    placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS pos, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM damaged),
    seen AS (SELECT *, bare = '' AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again, left(role, 1) AS ini, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS was FROM placed),
    r AS (SELECT conv_id, pos, turn, role, text, ini, was, blank, again AND NOT blank AS dup, blank OR again AS gone, (NOT blank AND NOT again AND right(bare, 1) NOT IN ('.', '!', '?'))::INT AS trunc FROM seen),
    ids AS (SELECT DISTINCT conv_id FROM conversations),
    s(conv_id, pos, v0, v1, v2, v3) AS (
        SELECT conv_id, 0::BIGINT, '000000000', NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR FROM ids
        UNION ALL
        SELECT conv_id, pos, {_step("v0", "3", "D")}, least({_step("v1", "3", "D")}, {_keep("v0", "s")}),
            least({_step("w2", "3", "D")}, {_keep("v0", "u")}, {_keep("v1", "u")}, {_keep("w3", "u")}, {_rerole("v0")}, {_rerole("v1")}, {_rerole("w3")}),
            least({_step("w3", "3", "D")}, {_keep("w2", "a")}, {_rerole("w2")})
        FROM (SELECT *, least(v3, {_step("w2", "2", "I")}) AS w3 FROM (
            SELECT r.*, s.v0, s.v1, s.v3, least(s.v2, {_step("s.v0", "2", "I")}, {_step("s.v1", "2", "I")}, {_step("s.v3", "2", "I")}) AS w2
            FROM s JOIN r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.pos = s.pos + 1) x) y),
    done AS (SELECT conv_id, least(v0, v3, {_step("v2", "2", "I")}, {_step("(" + _step("v1", "2", "I") + ")", "2", "I")}) AS way FROM s
        QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY pos DESC) = 1),
    letters AS (SELECT conv_id, way, unnest(range(10, length(way) + 1))::INT AS j FROM done),
    steps AS (SELECT conv_id, j, substr(way, j, 1) AS edit, sum((substr(way, j, 1) <> 'I')::INT) OVER (PARTITION BY conv_id ORDER BY j) AS pos FROM letters),
    out AS (SELECT t.conv_id, t.j, t.edit, CASE WHEN t.edit <> 'I' THEN r.role END AS role, CASE WHEN t.edit = 'I' THEN '' ELSE r.text END AS text,
        row_number() OVER (PARTITION BY t.conv_id ORDER BY t.j) AS k, first_value(t.edit = 'K' AND r.ini = 's') OVER (PARTITION BY t.conv_id ORDER BY t.j) AS led
        FROM steps t LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM t.conv_id AND r.pos = t.pos WHERE t.edit <> 'D'),
    repaired AS (SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (k - led::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY j)) AS digest FROM out GROUP BY conv_id),
    counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum(blank::INT) AS blank, sum(dup::INT) AS duplicate, sum(trunc) AS truncated,
        sum((was IS NOT NULL AND was || ini NOT IN ('su', 'ua', 'au'))::INT) AS illegal FROM r GROUP BY conv_id)
    SELECT i.conv_id, coalesce(c.gaps, 0)::BIGINT AS gaps, coalesce(c.blank, 0)::BIGINT AS blank, coalesce(c.duplicate, 0)::BIGINT AS duplicate, coalesce(c.truncated, 0)::BIGINT AS truncated,
        coalesce(c.illegal, 0)::BIGINT AS illegal, left(d.way, 9)::BIGINT AS cost, substr(d.way, 10) AS audit, coalesce(p.digest, sha256('')) AS repaired_sha256
    FROM ids i JOIN done d ON d.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN repaired p ON p.conv_id IS NOT DISTINCT FROM i.conv_id
"""
