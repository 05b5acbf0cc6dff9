"""Oracle SQL (DuckDB) of the operators that SQL can express on whole tables."""

from __future__ import annotations

from meterlight.llm.centroids import CLUSTERS, ROUNDS, SCALE, SIZE

_LETTERS = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DECONTAMINATION = rf"""
    WITH d AS MATERIALIZED (
        SELECT row_number() OVER () AS r, doc_id,
               regexp_extract_all({_LETTERS}, '[^\x{{00}}-\x{{2F}}\x{{3A}}-\x{{60}}\x{{7B}}-\x{{7F}}]+') AS w
        FROM documents
    ), b AS (
        SELECT coalesce(item_id::VARCHAR, '') AS item_id,
               regexp_extract_all({_LETTERS}, '[^\x{{00}}-\x{{2F}}\x{{3A}}-\x{{60}}\x{{7B}}-\x{{7F}}]+') AS w
        FROM benchmark
    ), windows AS MATERIALIZED (
        SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(list_slice(w, k, k + 9), ' ') AS words
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM b WHERE len(w) > 0)
    ), places AS (
        SELECT r, size, k, array_to_string(list_slice(w, k, k + size - 1), ' ') AS words
        FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS k
              FROM d, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size)
    ), found AS MATERIALIZED (
        SELECT p.r, p.size, p.k, x.item_id FROM places p JOIN windows x USING (words, size)
    ), covered AS (
        SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(k, k + size)) AS pos FROM found) GROUP BY r
    ), items AS (
        SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
        FROM (SELECT DISTINCT r, item_id FROM found) GROUP BY r
    )
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
           sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN covered USING (r) LEFT JOIN items USING (r)
"""


def clustering() -> str:
    """Rounds one after the other, each two tables: the nearest centroid of each vector, and the new centroids."""
    parts = [
        f"""given AS MATERIALIZED (
        SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS x
        FROM embeddings
        WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda x: isfinite(x::DOUBLE))) = {SIZE}
    )""",
        f"v AS MATERIALIZED (SELECT r, unnest(range(1, {SIZE + 1})) AS d, unnest(x) AS x FROM given)",
        f"""seeds AS (
        SELECT r, row_number() OVER (ORDER BY sha256('3:' || coalesce(vec_id::VARCHAR, '')), x) - 1 AS k FROM given
        QUALIFY k < {CLUSTERS}
    )""",
        "c0 AS MATERIALIZED (SELECT k, d, x FROM seeds JOIN v USING (r))",
    ]
    for r in range(ROUNDS + 1):
        parts.append(
            f"""a{r} AS MATERIALIZED (
        SELECT r, k, distance FROM (
            SELECT v.r, c.k, sum((v.x - c.x) * (v.x - c.x))::BIGINT AS distance FROM v JOIN c{r} c USING (d) GROUP BY v.r, c.k
        ) QUALIFY row_number() OVER (PARTITION BY r ORDER BY distance, k) = 1
    )"""
        )
        if r < ROUNDS:
            parts.append(
                f"""c{r + 1} AS MATERIALIZED (
        SELECT c.k, c.d, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN (
            SELECT k, d, sum(x)::BIGINT AS total, count(*) AS n,
                   ((total - (((total % n) + n) % n)) // n)::BIGINT AS x
            FROM v JOIN a{r} USING (r) GROUP BY k, d
        ) m USING (k, d)
    )"""
            )
    return f"""
    WITH {", ".join(parts)},
    hashes AS (SELECT k, sha256(string_agg(x::VARCHAR, ',' ORDER BY d)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY k)
    SELECT vec_id, k::INTEGER AS cluster, distance, (sum(distance) OVER (PARTITION BY k))::BIGINT AS cluster_inertia,
           (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256
    FROM given JOIN a{ROUNDS} USING (r) JOIN hashes USING (k)
    """


def _repair() -> str:
    """A table step for each row: the least (cost, letters) that leads to each of four states.

    States: 0 nothing, 1 a system row, 2 a user row last, 3 an assistant row last. Inserted rows
    are allowed in front of a row and at the end, two of them at most.
    """
    insert = "struct_pack(c := {0}.c + 5, a := {0}.a || 'I')"
    cheaper = "CASE WHEN ({0}).c < ({1}).c OR ({0}).c = ({1}).c AND ({0}).a <= ({1}).a THEN ({0}) ELSE ({1}) END"

    def inserted(source: str) -> str:
        i = {s: insert.format(s) for s in ("s0", "s1", "s2", "s3")}
        # s2 may come from 0, 1 and 3, s3 from 2; then once more.
        return f"""
        SELECT conv, nth, s0, s1, {cheaper.format("s2", "x2")} AS s2, {cheaper.format("s3", "x3")} AS s3 FROM (
            SELECT *, {cheaper.format("y2", insert.format("y3"))} AS x2, {cheaper.format("y3", insert.format("y2"))} AS x3 FROM (
                SELECT *, {cheaper.format("s2", cheaper.format(cheaper.format(i["s0"], i["s1"]), i["s3"]))} AS y2, {cheaper.format("s3", i["s2"])} AS y3
                FROM ({source})
            )
        )"""

    never = "struct_pack(c := 1000000000::BIGINT, a := 'Z')"

    def step(state: str, cost: str, letter: str) -> str:
        return f"struct_pack(c := {state}.c + {cost}, a := {state}.a || '{letter}')"

    kept = {
        0: [],
        1: [("s0", "s")],
        2: [("s0", "u"), ("s1", "u"), ("s3", "u")],
        3: [("s2", "a")],
    }
    roles = {0: [], 1: [], 2: ["s0", "s1", "s3"], 3: ["s2"]}
    states = []
    for to in range(4):
        best = step(f"s{to}", "2", "D")
        for s, initial in kept[to]:
            best = cheaper.format(best, f"CASE WHEN fault <= 0 AND initial = '{initial}' THEN {step(s, '5 * -fault', 'K')} ELSE {never} END")
        for s in roles[to]:
            best = cheaper.format(best, f"CASE WHEN fault <= 0 THEN {step(s, '1 + 5 * -fault', 'R')} ELSE {never} END")
        states.append(f"{best} AS s{to}")
    blank = r"'[^\x{20}\x{09}-\x{0D}]'"
    last = "regexp_extract(text, '([^\\x{20}\\x{09}-\\x{0D}])[\\x{20}\\x{09}-\\x{0D}]*$', 1)"
    return rf"""
    WITH RECURSIVE keyed AS (
        SELECT coalesce(conv_id::VARCHAR, ' ') AS conv, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name
        FROM conversations
    ), lots AS (
        SELECT conv, conv_id, turn, role, text,
               xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(name, ''), lambda x: list_transform(range(8), lambda b: ((ascii(x) >> b) & 1)::BIGINT)))),
                               lambda c, b: xor(c >> 1, 3988292384::BIGINT * (xor(c, b) & 1))), 4294967295::BIGINT) % 20 AS lot
        FROM keyed
    ), damaged AS (
        SELECT conv, turn, CASE WHEN lot = 4 THEN 'user' ELSE role END AS role,
               CASE lot WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
               unnest(range(CASE lot WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
        FROM lots
    ), ordered AS (
        SELECT conv, turn, role, text, left(role, 1) AS initial,
               row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text) AS nth FROM damaged
    ), judged AS MATERIALIZED (
        SELECT *, CASE WHEN NOT regexp_matches(text, {blank}) THEN 1
                       WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY nth) > 1 THEN 2
                       WHEN {last} NOT IN ('.', '!', '?') THEN -1 ELSE 0 END AS fault,
               lag(initial) OVER (PARTITION BY conv ORDER BY nth) AS earlier
        FROM ordered
    ), facts AS (
        SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank,
               count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = -1) AS truncated,
               count(*) FILTER (earlier || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
        FROM judged GROUP BY conv
    ), walked AS (
        SELECT conv, 0::BIGINT AS nth, struct_pack(c := 0::BIGINT, a := '') AS s0, {never} AS s1, {never} AS s2, {never} AS s3 FROM facts
        UNION ALL
        SELECT conv, nth, {", ".join(states)} FROM (
            SELECT w.conv, w.nth + 1 AS nth, w.s0, w.s1, w.s2, w.s3, j.initial, CASE WHEN j.fault > 0 THEN 1 ELSE j.fault END AS fault
            FROM ({inserted("walked")}) w JOIN judged j ON j.conv = w.conv AND j.nth = w.nth + 1
        )
    ), ended AS MATERIALIZED (
        SELECT conv, {cheaper.format("s0", "s3")} AS best FROM ({inserted("SELECT w.* FROM walked w JOIN facts f ON f.conv = w.conv AND f.n = w.nth")})
    ), letters AS (
        SELECT conv, string_split(best.a, '') AS l, unnest(range(1, length(best.a) + 1)) AS pos FROM ended
    ), placed AS (
        SELECT conv, pos, l[pos] AS letter,
               CASE WHEN l[pos] <> 'I' THEN count(*) FILTER (l[pos] <> 'I') OVER upto END AS nth,
               count(*) FILTER (l[pos] <> 'D') OVER upto AS place
        FROM letters WINDOW upto AS (PARTITION BY conv ORDER BY pos ROWS UNBOUNDED PRECEDING)
    ), messages AS (
        SELECT p.conv, p.pos, p.letter, p.place, j.role, j.text,
               max(CASE WHEN p.place = 1 AND p.letter = 'K' AND j.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY p.conv) AS system
        FROM placed p LEFT JOIN judged j USING (conv, nth) WHERE p.letter <> 'D'
    ), repaired AS (
        SELECT conv, string_agg(CASE WHEN letter = 'K' THEN role WHEN (place - system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY pos) AS whole
        FROM messages GROUP BY conv
    )
    SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
           coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.c, 0)::BIGINT AS cost,
           coalesce(best.a, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv, conv_id FROM keyed) c LEFT JOIN facts USING (conv) LEFT JOIN ended USING (conv) LEFT JOIN repaired USING (conv)
    """


CONVERSATION_REPAIR = _repair()
