"""DuckDB twins of the queries that SQL can express."""


def _crc32(text: str) -> str:
    """The unsigned CRC-32 of a string's bytes: the usual reflected polynomial, byte by byte over a table."""
    table = "[" + ", ".join(str(_crc_entry(b)) for b in range(256)) + "]"
    step = f"lambda c, x: xor(c >> 8, {table}[CAST(xor(c & 255, x) AS INT) + 1])"
    octets = f"list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), {step}), 4294967295::BIGINT)"


def _crc_entry(byte: int) -> int:
    for _ in range(8):
        byte = byte >> 1 ^ (0xEDB88320 if byte & 1 else 0)
    return byte


_WHITE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

#: Every step of the recursion takes the cheapest edits, of those the least, that bring a conversation's next row to each place.
_REPAIR = f"""
    WITH RECURSIVE
    marked AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               {_crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS f
        FROM conversations),
    hurt AS (
        SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
               CASE f WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN f = 3 THEN 2 ELSE 1 END)) AS copy
        FROM marked WHERE f <> 0),
    placed AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen
        FROM (SELECT conv_id, turn, role, text, rtrim(text, {_WHITE}) AS body,
                     row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM hurt)),
    faulty AS (
        SELECT conv_id, turn, role, text, i, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS former,
               CASE WHEN body = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
        FROM placed),
    counts AS (
        SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
               count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
               count(*) FILTER (former IS NOT NULL AND former || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS rows
        FROM faulty GROUP BY conv_id),
    leads(place, lead, spot, paid, turns) AS (
        VALUES (0, '', 0, 0, CAST([] AS VARCHAR[])), (0, 'I', 2, 3, ['user:']), (0, 'II', 3, 6, ['user:', 'assistant:']),
               (1, '', 1, 0, []), (1, 'I', 2, 3, ['user:']), (1, 'II', 3, 6, ['user:', 'assistant:']),
               (2, '', 2, 0, []), (2, 'I', 3, 3, ['assistant:']), (3, '', 3, 0, []), (3, 'I', 2, 3, ['user:'])),
    edits(spot, edit, initial, too, paid, role) AS (
        VALUES (0, 'K', 's', 1, 0, NULL), (0, 'K', 'u', 2, 0, NULL), (1, 'K', 'u', 2, 0, NULL), (2, 'K', 'a', 3, 0, NULL), (3, 'K', 'u', 2, 0, NULL),
               (0, 'R', NULL, 2, 3, 'user'), (1, 'R', NULL, 2, 3, 'user'), (2, 'R', NULL, 3, 3, 'assistant'), (3, 'R', NULL, 2, 3, 'user'),
               (0, 'D', NULL, 0, 4, NULL), (1, 'D', NULL, 1, 4, NULL), (2, 'D', NULL, 2, 4, NULL), (3, 'D', NULL, 3, 4, NULL)),
    best AS (
        SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS place, {{'cost': CAST(0 AS BIGINT), 'audit': '', 'turns': CAST([] AS VARCHAR[])}} AS way
        FROM (SELECT DISTINCT conv_id FROM conversations)
        UNION ALL
        SELECT b.conv_id, f.i, e.too, min({{
                   'cost': b.way.cost + l.paid + e.paid + CASE WHEN e.edit <> 'D' AND f.fault = 'truncated' THEN 3 ELSE 0 END,
                   'audit': b.way.audit || l.lead || e.edit,
                   'turns': list_concat(list_concat(b.way.turns, l.turns), CASE WHEN e.edit = 'D' THEN [] ELSE [coalesce(e.role, f.role) || ':' || f.text] END)}})
        FROM best b JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.i = b.i + 1
        JOIN leads l ON l.place = b.place
        JOIN edits e ON e.spot = l.spot AND (e.edit = 'D' OR f.fault IN ('', 'truncated')) AND (e.edit <> 'K' OR e.initial = f.initial)
        GROUP BY b.conv_id, f.i, e.too),
    ended AS (
        SELECT b.conv_id, min({{'cost': b.way.cost + l.paid, 'audit': b.way.audit || l.lead, 'turns': list_concat(b.way.turns, l.turns)}}) AS way
        FROM best b LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM b.conv_id JOIN leads l ON l.place = b.place AND l.spot IN (0, 3)
        WHERE b.i = coalesce(c.rows, 0) GROUP BY b.conv_id)
    SELECT e.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate,
           coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal, e.way.cost AS cost, e.way.audit AS audit,
           sha256(array_to_string(e.way.turns, chr(10))) AS repaired_sha256
    FROM ended e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""

#: One group of equal texts after another, by falling size, to the first of the least loaded shards; the shards that
#: groups of one size have got are given to them in the order of their digests.
_SHARDS = f"""
    WITH RECURSIVE
    d AS (SELECT doc_id, sha256(coalesce(text, '')) AS digest, octet_length(encode(coalesce(text, ''))) + 8 AS size,
                 {_crc32("coalesce(text, '')")} AS text_crc32 FROM documents),
    g AS (SELECT digest, sum(size) AS bytes, row_number() OVER (ORDER BY sum(size) DESC, digest) AS i FROM d GROUP BY digest),
    dealt AS (
        SELECT CAST(0 AS BIGINT) AS i, CAST(0 AS HUGEINT) AS bytes, 0 AS shard, list_transform(range(24), lambda x: CAST(0 AS HUGEINT)) AS loads
        UNION ALL
        SELECT g.i, g.bytes, spot - 1, loads[:spot - 1] || [loads[spot] + g.bytes] || loads[spot + 1:]
        FROM (SELECT i, loads, list_position(loads, list_min(loads)) AS spot FROM dealt) AS held JOIN g ON g.i = held.i + 1),
    taken AS (SELECT bytes, shard, row_number() OVER (PARTITION BY bytes ORDER BY shard) AS k FROM dealt WHERE i > 0),
    home AS (SELECT digest, shard FROM (SELECT *, row_number() OVER (PARTITION BY bytes ORDER BY digest) AS k FROM g) JOIN taken USING (bytes, k))
    SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, shard,
           row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, digest) - 1 AS slot, CAST(NULL AS INT) AS grown_shard
    FROM d JOIN home USING (digest)
"""

SQL = {
    "op11_conversations": _REPAIR,
    "op13_sharding": _SHARDS,
    "op2_exact_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY norm)
    """,
    "op10_wacz": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
             d AS (SELECT page_id, octet_length(encode(html)) AS n, sha256(html) AS digest FROM p),
             g AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM d)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
               CASE WHEN n >= 100 AND first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 100 AND first < page_id THEN first END AS refers_to
        FROM g
    """,
}
