"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

ORACLES["op3_exact_dedup"] = r"""
WITH d AS (
    SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id,
       min(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER same AS kept,
       sha256(norm) AS text_sha256
FROM d
WINDOW same AS (PARTITION BY norm)
"""

ORACLES["op6_decontamination"] = r"""
WITH words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents
), items AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark
), sized AS (
    SELECT item_id, w, least(len(w), 10) AS n FROM items WHERE len(w) > 0
), windows AS (
    SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS key
    FROM sized, unnest(range(1, len(w) - n + 2)) AS t(i)
), sizes AS (
    SELECT DISTINCT n FROM windows
), places AS (
    SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS key
    FROM words, sizes, unnest(range(1, len(w) - n + 2)) AS t(i)
    WHERE len(w) >= n
), found AS (
    SELECT doc_id, item_id, n, i FROM places JOIN windows USING (n, key)
), hit AS (
    SELECT doc_id, count(DISTINCT word) AS n_hit
    FROM found, unnest(range(i, i + n)) AS t(word) GROUP BY doc_id
), listed AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found WHERE item_id IS NOT NULL)
    GROUP BY doc_id
)
SELECT words.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hit USING (doc_id) LEFT JOIN listed USING (doc_id)
"""

ORACLES["op9_warc"] = r"""
WITH p AS (
    SELECT page_id, coalesce(html, '') AS html FROM pages
), d AS (
    SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS hex, min(page_id) OVER (PARTITION BY html) AS first
    FROM p
)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           ((('0x' || substr(hex, 5 * (i // 4) + 1, 5))::bigint >> (15 - 5 * (i % 4))) & 31)::int + 1, 1)), '')
           AS payload_digest,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM d
"""


def _code_rounds(rounds: int) -> str:
    """Assignment and averaging, spelled out once per round; the last assignment is `near`."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""near{i} AS (
    SELECT r, p, any_value(x) AS x, min({{d: list_sum(list_transform(x, lambda v, k: (v - c[k]) * (v - c[k])))::BIGINT, e: e}}) AS m
    FROM parts JOIN book{i} USING (p) GROUP BY r, p
)""")
        if i < rounds:
            steps.append(f"""mean{i} AS (
    SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY k) AS c FROM (
        SELECT p, m.e AS e, k, sum(x[k])::BIGINT AS s, count(*) AS n
        FROM (SELECT *, unnest(range(1, len(x) + 1)) AS k FROM near{i}) GROUP BY p, m.e, k
    ) GROUP BY p, e
), book{i + 1} AS (
    SELECT p, e, coalesce(mean{i}.c, book{i}.c) AS c FROM book{i} LEFT JOIN mean{i} USING (p, e)
)""")
    return ", ".join(steps)


ORACLES["op11_codes"] = f"""
WITH kept AS (
    SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS r, vec_id, label,
           list_transform(embedding, lambda x: floor(256 * x)::BIGINT) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS (
    SELECT r, p, list_slice(v, p * (len(v) // 16) + 1, (p + 1) * (len(v) // 16)) AS x FROM kept, range(16) AS t(p)
), book0 AS (
    SELECT p, r AS e, x AS c FROM parts WHERE r < 64
), {_code_rounds(2)}, coded AS (
    SELECT r, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM near2 GROUP BY r
), digest AS (
    SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book2
)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
FROM kept JOIN coded USING (r), digest
"""


# Places as in turns.py: s0 nothing yet, s1 after system, s2 after user, s3 after assistant.
def _edits(place: int, free: int, role: str, kept: list[tuple[str, int]]) -> str:
    """The cheapest of deleting, changing and keeping a row in one place."""
    line = lambda name, rest: f"{name} || ':' || text || CASE WHEN {rest} = '' THEN '' ELSE chr(10) || {rest} END"
    options = [f"{{c: s{place}.c + 4, a: 'D' || s{place}.a, r: s{place}.r}}"]
    options.append(
        f"CASE WHEN stays THEN {{c: s{free}.c + 3 + extra, a: 'R' || s{free}.a, r: {line(repr(role), f's{free}.r')}}} END"
    )
    for initial, to in kept:
        options.append(
            f"CASE WHEN stays AND role[1] = '{initial}' THEN "
            f"{{c: s{to}.c + extra, a: 'K' || s{to}.a, r: {line('role', f's{to}.r')}}} END"
        )
    return f"list_min([{', '.join(options)}])"


def _inserted(other: str, role: str) -> str:
    return (f"{{c: {other}.c + 3, a: 'I' || {other}.a, "
            f"r: '{role}:' || CASE WHEN {other}.r = '' THEN '' ELSE chr(10) || {other}.r END}}")


ORACLES["op13_turns"] = rf"""
WITH RECURSIVE named AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(
               [4294967295] || flatten(list_transform(
                   string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
                   lambda ch: [ascii(ch)::BIGINT + 1, 0, 0, 0, 0, 0, 0, 0, 0])),
               lambda c, x: CASE WHEN x > 0 THEN xor(c, x - 1) ELSE xor(c >> 1, (c & 1) * 3988292384) END
           ), 4294967295) % 20 AS kind
    FROM conversations
), damaged AS (
    SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
           CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM named, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS t(copy)
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, nth) AS i,
           right(regexp_replace(text, '[\x20\x09-\x0D]+$', ''), 1) AS e
    FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS nth FROM damaged)
), rows AS (
    SELECT conv_id, turn, role, text, i, e = '' AS blank, e <> '' AND nth > 1 AS duplicate,
           e <> '' AND nth = 1 AND e NOT IN ('.', '!', '?') AS truncated, e <> '' AND nth = 1 AS stays,
           CASE WHEN e NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS extra,
           i > 1 AND (lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i)) || role[1] NOT IN ('su', 'ua', 'au') AS illegal
    FROM placed
), counts AS (
    SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
           count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
           count(*) FILTER (truncated) AS truncated, count(*) FILTER (illegal) AS illegal
    FROM rows GROUP BY conv_id
), ends AS (
    SELECT DISTINCT c.conv_id, coalesce(n, 0) AS n, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank,
           coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal
    FROM conversations c LEFT JOIN counts ON c.conv_id IS NOT DISTINCT FROM counts.conv_id
), walk AS (
    SELECT conv_id, n + 1 AS i, {{c: 0, a: '', r: ''}} AS s0, {{c: 6, a: 'II', r: 'user:' || chr(10) || 'assistant:'}} AS s1,
           {{c: 3, a: 'I', r: 'assistant:'}} AS s2, {{c: 0, a: '', r: ''}} AS s3
    FROM ends
    UNION ALL
    SELECT conv_id, i, list_min([b0, {_inserted('s2', 'user')}]), list_min([b1, {_inserted('s2', 'user')}]), s2,
           list_min([b3, {_inserted('b2', 'user')}])
    FROM (
        SELECT *, list_min([b2, {_inserted('b3', 'assistant')}]) AS s2
        FROM (
            SELECT walk.conv_id, rows.i AS i,
                   {_edits(0, 2, 'user', [('s', 1), ('u', 2)])} AS b0,
                   {_edits(1, 2, 'user', [('u', 2)])} AS b1,
                   {_edits(2, 3, 'assistant', [('a', 3)])} AS b2,
                   {_edits(3, 2, 'user', [('u', 2)])} AS b3
            FROM walk JOIN rows ON rows.conv_id IS NOT DISTINCT FROM walk.conv_id AND rows.i = walk.i - 1
        )
    )
)
SELECT ends.conv_id, gaps, blank, duplicate, truncated, illegal, s0.c::BIGINT AS cost, s0.a AS audit,
       sha256(s0.r) AS repaired_sha256
FROM walk JOIN ends ON walk.conv_id IS NOT DISTINCT FROM ends.conv_id AND walk.i = 1
"""
