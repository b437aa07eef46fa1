"""SQL of the operators whose statement is put together from parts."""

from __future__ import annotations


def repair_sql() -> str:
    """Conversation repair: one recursion step per row carries the cheapest (cost, audit, text) of each state."""
    crc = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(code, ''), lambda c: ascii(c)::BIGINT)),
        lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 1, 2, 3, 4, 5, 6, 7]),
            lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"""

    def moved(state: str, cost: str, letter: str, line: str | None = None) -> str:
        text = f"{state}.t" if line is None else f"{state}.t || CASE WHEN {state}.t = '' THEN '' ELSE chr(10) END || {line}"
        return (f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': {text}}} END")

    def least(*values: str) -> str:
        return f"list_min(list_filter([{', '.join(values)}], lambda x: x IS NOT NULL))"

    def when(test: str, value: str) -> str:
        return f"CASE WHEN {test} THEN {value} END"

    own, user, assistant = "role || ':' || text", "'user:' || text", "'assistant:' || text"
    stays, more = "NOT gone", "5 * cut::INT"
    z = moved("d.z", "2", "D")
    s = least(moved("d.s", "2", "D"), when(f"{stays} AND initial = 's'", moved("d.z", more, "K", own)))
    u = least(moved("d.u", "2", "D"),
              *(when(f"{stays} AND initial = 'u'", moved(f"d.{q}", more, "K", own)) for q in "zsa"),
              *(when(stays, moved(f"d.{q}", f"1 + {more}", "R", user)) for q in "zsa"))
    a = least(moved("d.a", "2", "D"), when(f"{stays} AND initial = 'a'", moved("d.u", more, "K", own)),
              when(stays, moved("d.u", f"1 + {more}", "R", assistant)))
    u_inserted = least("u", *(moved(q, "5", "I", "'user:'") for q in "zsa"))
    a_inserted = least("a", moved("u", "5", "I", "'assistant:'"))
    return f"""
WITH RECURSIVE
source AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS code FROM conversations),
coded AS (SELECT * EXCLUDE (code), {crc} % 20 AS kind FROM source),
copies AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
           CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
           unnest(range(CASE WHEN kind = 0 THEN 0 WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM coded),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS place,
           row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
           rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS visible,
           lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS before
    FROM copies),
judged AS (
    SELECT conv_id, turn, role, text, place, left(role, 1) AS initial, visible = '' AS blank, visible <> '' AND again AS duplicate,
           visible <> '' AND NOT again AND right(visible, 1) NOT IN ('.', '!', '?') AS cut, visible = '' OR again AS gone,
           place > 1 AND before || left(role, 1) NOT IN ('su', 'ua', 'au') AS illegal
    FROM placed),
steps AS (
    SELECT conv_id, 0::BIGINT AS place, {{'z': {{'c': 0, 'a': '', 't': ''}}, 's': NULL::STRUCT(c INT, a VARCHAR, t VARCHAR),
           'u': {{'c': 5, 'a': 'I', 't': 'user:'}}, 'a': {{'c': 10, 'a': 'II', 't': 'user:' || chr(10) || 'assistant:'}}}} AS d
    FROM (SELECT DISTINCT conv_id FROM conversations)
    UNION ALL
    SELECT conv_id, place, {{'z': z, 's': s, 'u': u, 'a': {a_inserted}}} AS d
    FROM (SELECT conv_id, place, z, s, {u_inserted} AS u, a
          FROM (SELECT j.conv_id, j.place, {z} AS z, {s} AS s, {u} AS u, {a} AS a
                FROM steps p JOIN judged j ON p.conv_id IS NOT DISTINCT FROM j.conv_id AND j.place = p.place + 1))),
ends AS (
    SELECT conv_id, {least("d.z", "d.a")} AS best FROM steps
    QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY place DESC) = 1),
counts AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank,
           count_if(duplicate) AS duplicate, count_if(cut) AS truncated, count_if(illegal) AS illegal FROM judged GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, best.c::BIGINT AS cost, best.a AS audit,
       sha256(best.t) AS repaired_sha256
FROM ends e LEFT JOIN counts c ON e.conv_id IS NOT DISTINCT FROM c.conv_id"""


def vector_codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """Product codes: every round compares all parts with all entries."""
    assign = """
a{k} AS MATERIALIZED (
    SELECT rid, part, (min(code) % {entries})::BIGINT AS entry, (min(code) // {entries})::BIGINT AS d FROM (
        SELECT p.rid, p.part, (p.square - 2 * list_inner_product(p.x, b.x) + list_inner_product(b.x, b.x))::BIGINT * {entries} + b.entry AS code
        FROM parts p JOIN b{k} b USING (part)) GROUP BY rid, part)"""
    move = """
b{next} AS MATERIALIZED (
    SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM b{k} b LEFT JOIN (
        SELECT part, entry, list(floor(total / n) ORDER BY place) AS x FROM (
            SELECT part, entry, place, sum(value) AS total, count(*) AS n FROM (
                SELECT a.part, a.entry, unnest(p.x) AS value, unnest(range(len(p.x))) AS place FROM a{k} a JOIN parts p USING (rid, part))
            GROUP BY part, entry, place) GROUP BY part, entry) m USING (part, entry))"""
    steps = []
    for k in range(rounds + 1):
        steps.append(assign.format(k=k, entries=entries))
        if k < rounds:
            steps.append(move.format(k=k, next=k + 1))
    return f"""
WITH usable AS MATERIALIZED (
    SELECT vec_id, label, embedding::DOUBLE[] AS v, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rid FROM embeddings
    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scaled AS (SELECT * EXCLUDE (v), list_transform(v, lambda x: floor({scale} * x)) AS v FROM usable),
cut AS (
    SELECT rid, part, list_slice(v, part * (len(v) // {parts}) + 1, (part + 1) * (len(v) // {parts})) AS x
    FROM scaled, (SELECT unnest(range({parts})) AS part)),
parts AS MATERIALIZED (SELECT rid, part, x, list_inner_product(x, x) AS square FROM cut),
b0 AS MATERIALIZED (SELECT part, rid - 1 AS entry, x FROM parts WHERE rid <= {entries}),{",".join(steps)},
coded AS (
    SELECT u.vec_id, u.label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error
    FROM a{rounds} JOIN usable u USING (rid) GROUP BY u.rid, u.vec_id, u.label),
books AS (
    SELECT sha256(string_agg(value::BIGINT::VARCHAR, ',' ORDER BY part, entry, place)) AS codebooks_sha256
    FROM (SELECT part, entry, unnest(x) AS value, unnest(range(len(x))) AS place FROM b{rounds}))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded, books"""
