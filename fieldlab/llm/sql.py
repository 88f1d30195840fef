"""DuckDB statements that give the same rows as the registered queries.

Row numbers keep rows apart that share an id. Near duplicates, byte and sentence
repeats, personal data (its patterns look around) and packing have no statement;
tests hold them against plain versions.
"""

from __future__ import annotations

from .common import LOWER, UPPER
from .line_dedup import SHORTEST_KEY
from .quality import ENDINGS, MARKS, MENU, MENU_CHARS, MENU_WORDS, MOST_LOST, MOST_MARKS, NOTICES, SEPARATED

SPACE = r"[\x20\x09-\x0D]+"
BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
TEXTS = "texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents)"
LINES = """lines AS (SELECT r, doc_id, unnest(cut) AS line, generate_subscripts(cut, 1) AS pos
                  FROM (SELECT r, doc_id, string_split(text, chr(10)) AS cut FROM texts))"""
QUOTE = r"[\x22\x27]?"
#: kind, pattern, group that must be so long, least length
SECRETS = (("assign", rf"((?i:password|passwd|secret|token|api_?key)){QUOTE}\x20*[:=]\x20*{QUOTE}([A-Za-z0-9+/_.=-]+)", 2, 6),
           ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24))


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _lower(value: str) -> str:
    return f"translate({value}, '{UPPER}', '{LOWER}')"


def _secrets() -> str:
    parts = []
    for rank, (kind, pattern, group, least) in enumerate(SECRETS):
        p = quoted(pattern)
        parts.append(f"""
          SELECT r, '{kind}' AS kind, {rank} AS rank, s, s + length(m) AS e FROM (
            SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY r ORDER BY i) - length(m) AS s FROM (
              SELECT r, unnest(found) AS m, unnest(held) AS v, unnest(gaps[:len(found)]) AS gap,
                     generate_subscripts(found, 1) AS i
              FROM (SELECT r, regexp_extract_all(text, {p}) AS found, regexp_extract_all(text, {p}, {group}) AS held,
                           regexp_split_to_array(text, {p}) AS gaps FROM texts)))
          WHERE length(v) >= {least}""")
    counts = ", ".join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind, *_ in SECRETS)
    return f"""
        WITH {TEXTS}, spans AS ({" UNION ALL ".join(parts)}),
        joined AS (SELECT r, {counts}, string_agg(concat_ws(':', kind, s::BIGINT, e::BIGINT), ',' ORDER BY s, rank) AS spans
                   FROM spans GROUP BY r)
        SELECT doc_id, {", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind, *_ in SECRETS)},
               sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM texts LEFT JOIN joined USING (r)"""


def _warc() -> str:
    letters = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> {b}) & 31)::INT + 1, 1)" for b in (15, 10, 5, 0))
    groups = ", ".join(f"('0x' || substr(h, {1 + 5 * g}, 5))::INT" for g in range(8))
    return f"""
        WITH payloads AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        digests AS (SELECT page_id, html, octet_length(encode(html)) AS payload_bytes, sha1(html) AS h FROM payloads),
        firsts AS (SELECT html, min(page_id) AS first FROM payloads GROUP BY html)
        SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
               array_to_string(list_transform([{groups}], lambda v: {letters}), '') AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to
        FROM digests JOIN firsts USING (html)"""


def _line_dedup() -> str:
    return f"""
        WITH {TEXTS}, {LINES},
        keyed AS (SELECT *, {_lower(f"trim(line, {BLANKS})")} AS key FROM lines),
        firsts AS (SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= {SHORTEST_KEY} GROUP BY key),
        judged AS (SELECT r, doc_id, line, pos, coalesce(doc_id > first, false) AS gone FROM keyed LEFT JOIN firsts USING (key))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
        FROM judged GROUP BY r, doc_id"""


def _quality() -> str:
    size = f"length(regexp_replace(line, '{SPACE}', '', 'g'))"
    notices = " OR ".join(f"contains(lower(t), {quoted(x)})" for x in NOTICES)
    return f"""
        WITH {TEXTS}, {LINES},
        trimmed AS (SELECT *, trim(line, {BLANKS}) AS t, {size} AS chars FROM lines),
        judged AS (SELECT *, t = '' OR NOT (
              NOT contains({quoted(ENDINGS)}, right(t, 1))
              OR (length(t) <= {MENU_CHARS} AND len(regexp_split_to_array(t, '{SPACE}')) <= {MENU_WORDS}
                  AND (regexp_matches(lower(t), {quoted(MENU)}) OR regexp_matches(t, {quoted(SEPARATED)})))
              OR length(regexp_replace(t, {quoted(MARKS)}, '', 'g')) > {MOST_MARKS} * chars OR {notices}) AS good
            FROM trimmed),
        lined AS (SELECT r, doc_id, sum(chars)::BIGINT AS word_chars, count(*) AS n_lines,
                         count(*) FILTER (t <> '') - count(DISTINCT line) FILTER (t <> '') AS n_dup_lines,
                         count(*) FILTER (NOT good) AS n_lines_removed,
                         coalesce(sum(chars) FILTER (NOT good), 0)::BIGINT AS lost_chars,
                         sum(length(regexp_replace(line, '[^#*$%&|<>]+', '', 'g')))::BIGINT AS n_symbols
                  FROM judged GROUP BY r, doc_id),
        words AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS pos
                  FROM (SELECT r, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM texts)),
        grams AS (SELECT *, lead(word) OVER o AS second, lead(word, 2) OVER o AS third
                  FROM words WINDOW o AS (PARTITION BY r ORDER BY pos)),
        counted AS (SELECT r, pos, third IS NOT NULL AND count(*) OVER (PARTITION BY r, word, second, third) > 1 AS twice FROM grams),
        covered AS (SELECT r, twice OR coalesce(lag(twice) OVER o, false) OR coalesce(lag(twice, 2) OVER o, false) AS hit
                    FROM counted WINDOW o AS (PARTITION BY r ORDER BY pos)),
        worded AS (SELECT r, count(*) AS n_words, count(*) FILTER (hit) AS n_repeat_words FROM covered GROUP BY r),
        counts AS (SELECT lined.*, coalesce(n_words, 0) AS n_words, coalesce(n_repeat_words, 0) AS n_repeat_words,
                          coalesce(n_words, 0) < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
                   FROM lined LEFT JOIN worded USING (r))
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lines, n_lines_removed,
               lost_chars, NOT base_failed AND lost_chars <= {MOST_LOST} * word_chars AS kept
        FROM counts"""


def _decontamination(window: int = 13) -> str:
    word = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    lowered = _lower("coalesce(text, '')")
    return f"""
        WITH {TEXTS},
        items AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all({lowered}, {word}) AS w FROM benchmark),
        patterns AS (SELECT DISTINCT item, least(len(w), {window}) AS size, array_to_string(w[a:a + {window - 1}], ' ') AS p
                     FROM (SELECT item, w, unnest(range(1, greatest(len(w) - {window - 1}, 1) + 1)) AS a FROM items WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT size FROM patterns),
        words AS (SELECT r, unnest(w) AS word, unnest(gaps[:len(w)]) AS gap, generate_subscripts(w, 1) AS pos
                  FROM (SELECT r, regexp_extract_all({lowered}, {word}) AS w, regexp_split_to_array({lowered}, {word}) AS gaps
                        FROM texts)),
        placed AS (SELECT r, pos, length(word) AS chars, sum(length(gap) + length(word)) OVER o AS ending,
                          list(word) OVER (PARTITION BY r ORDER BY pos ROWS BETWEEN CURRENT ROW AND {window - 1} FOLLOWING) AS w
                   FROM words WINDOW o AS (PARTITION BY r ORDER BY pos)),
        ahead AS (SELECT r, pos, sizes.size, array_to_string(w[1:sizes.size], ' ') AS p
                  FROM placed JOIN sizes ON len(w) >= sizes.size),
        found AS (SELECT r, pos, size, item FROM ahead JOIN patterns USING (size, p)),
        struck AS (SELECT DISTINCT r, unnest(range(pos, pos + size)) AS pos FROM found),
        islands AS (SELECT r, pos, pos - row_number() OVER (PARTITION BY r ORDER BY pos) AS island FROM struck),
        runs AS (SELECT r, count(*) AS n, min(ending - chars)::BIGINT AS s, max(ending)::BIGINT AS e
                 FROM islands JOIN placed USING (r, pos) GROUP BY r, island),
        hits AS (SELECT r, sum(n)::BIGINT AS n_hit, string_agg(concat_ws(':', s, e), ',' ORDER BY s) AS spans FROM runs GROUP BY r),
        named AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS named FROM found GROUP BY r),
        totals AS (SELECT r, count(*) AS n_words FROM words GROUP BY r)
        SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(named, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= n_words, false) AS contaminated,
               coalesce(spans, '') AS spans
        FROM texts LEFT JOIN totals USING (r) LEFT JOIN hits USING (r) LEFT JOIN named USING (r)"""


#: CRC-32 of a list of bytes, with its table made by the rule of the polynomial
CRC_TABLE = """(SELECT list(list_reduce(list_prepend(i, [1, 2, 3, 4, 5, 6, 7, 8]::BIGINT[]),
                lambda a, b: xor(a >> 1, (a & 1) * 3988292384)) ORDER BY i) FROM range(256) t(i))"""


def _crc(octets: str) -> str:
    return (f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), "
            "lambda a, b: xor(crc[(xor(a, b) & 255) + 1], a >> 8)), 4294967295)")


def _sharding(shards: int = 40, overhead: int = 16) -> str:
    octets = "list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT)"
    upto = "coalesce((SELECT max(upto) FROM running WHERE upto <= {} + {}), 0)"
    return f"""
        WITH RECURSIVE {TEXTS},
        rows AS (SELECT r, doc_id, coalesce(doc_id, 9223372036854775807) AS d, octet_length(encode(text)) + {overhead} AS size,
                        CASE WHEN text = '' THEN 0 ELSE {_crc(octets)} END AS crc, md5(text) AS key
                 FROM texts, (SELECT {CRC_TABLE} AS crc)),
        groups AS (SELECT key, min(d) AS first, sum(size)::BIGINT AS bytes FROM rows GROUP BY key),
        falling AS (SELECT *, row_number() OVER o - 1 AS k, sum(bytes) OVER () - coalesce(sum(bytes) OVER
                           (ORDER BY bytes DESC, first, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_bytes
                    FROM groups WINDOW o AS (ORDER BY bytes DESC, first, key)),
        judged AS (SELECT *, k < {shards} AND bool_and(bytes * ({shards} - k) >= left_bytes) OVER (ORDER BY k) AS alone FROM falling),
        running AS (SELECT key, first, sum(bytes) OVER (ORDER BY first, key)::BIGINT AS upto FROM judged WHERE NOT alone),
        scope AS (SELECT (SELECT coalesce(max(upto), 0) FROM running) AS total, {shards} - (SELECT count(*) FROM judged WHERE alone) AS n),
        search AS (SELECT 1::BIGINT AS low, total AS high, 0::BIGINT AS j, 0::BIGINT AS pos FROM scope UNION ALL
                   SELECT CASE WHEN NOT fits AND over THEN middle + 1 ELSE low END, CASE WHEN fits THEN middle ELSE high END,
                          CASE WHEN fits OR over THEN 0 ELSE j + 1 END, CASE WHEN fits OR over THEN 0 ELSE next END
                   FROM (SELECT *, next >= total AS fits, j + 1 >= n OR next = pos AS over
                         FROM (SELECT s.*, total, n, (low + high) // 2 AS middle, {upto.format("s.pos", "(low + high) // 2")} AS next
                               FROM search s, scope WHERE low < high))),
        capacity AS (SELECT min(low) AS c FROM search WHERE low = high),
        ends AS (SELECT 1 AS j, {upto.format(0, "c")} AS pos FROM capacity UNION ALL
                 SELECT j + 1, {upto.format("e.pos", "c")} FROM ends e, capacity, scope WHERE j < n),
        places AS (SELECT key, k AS shard, first FROM judged WHERE alone UNION ALL
                   SELECT key, {shards} - n + (SELECT count(*) FROM ends WHERE pos < upto), first FROM running, scope)
        SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'bytes' AS law, shard::INTEGER AS shard,
               row_number() OVER (PARTITION BY shard ORDER BY first, key, d) - 1 AS slot, NULL::INTEGER AS grown_shard
        FROM rows JOIN places USING (key)"""


def _conversation_trie(family: int = 5, opening: int = 9) -> str:
    digits = "list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)"
    return f"""
        WITH turns AS (SELECT conv_id, md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS what,
                              strlen(coalesce(text, '')) AS bytes, turn FROM conversations WHERE conv_id IS NOT NULL),
        numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, what) AS n FROM turns),
        convs AS (SELECT conv_id, conv_id - conv_id % {family} AS base, {_crc(digits)} % {opening} AS h
                  FROM (SELECT DISTINCT conv_id FROM turns), (SELECT {CRC_TABLE} AS crc)),
        rebuilt AS (SELECT c.conv_id, 0 AS own, n, what, bytes FROM convs c JOIN numbered t ON t.conv_id = c.base AND n <= h
                    UNION ALL SELECT c.conv_id, 1, n, what, bytes FROM convs c JOIN numbered t ON t.conv_id = c.conv_id AND n > h),
        ways AS (SELECT conv_id, bytes, row_number() OVER o AS depth, list(what) OVER o AS way,
                        count(*) OVER (PARTITION BY conv_id) AS size FROM rebuilt WINDOW o AS (PARTITION BY conv_id ORDER BY own, n)
                 UNION ALL SELECT conv_id, 0, 0, []::VARCHAR[], coalesce((SELECT count(*) FROM rebuilt r WHERE r.conv_id = convs.conv_id), 0)
                 FROM convs),
        nodes AS (SELECT way, depth, min(conv_id) AS conv_id, count(*) AS n_convs, min(bytes) AS bytes,
                         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (size = depth), '')) AS ends_sha256
                  FROM ways GROUP BY way, depth),
        kids AS (SELECT way[:-2] AS way, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
        below AS (SELECT DISTINCT w[:a] AS way, w AS under FROM (SELECT way AS w, unnest(range(0, depth + 1)) AS a FROM nodes)),
        sums AS (SELECT below.way, count(*) FILTER (k.n_children IS NULL) AS n_leaves, sum((n_convs - 1) * bytes)::BIGINT AS saved_tokens
                 FROM below JOIN nodes u ON u.way = below.under LEFT JOIN kids k ON k.way = below.under GROUP BY below.way)
        SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children,
               n_leaves, saved_tokens, n.ends_sha256
        FROM nodes n JOIN sums s ON s.way = n.way LEFT JOIN kids k ON k.way = n.way
             LEFT JOIN nodes p ON n.depth > 0 AND p.way = n.way[:-2]"""


def _hard_negatives(positives: int = 5, negatives: int = 5) -> str:
    return f"""
        WITH rows AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                             list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
                      FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
                        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        anchors AS (SELECT * FROM rows WHERE vec_id % 100 = 0),
        scored AS (SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same,
                          list_inner_product(a.v, r.v)::BIGINT AS score
                   FROM anchors a JOIN rows r ON a.vec_id <> r.vec_id OR a.label <> r.label),
        best AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
                 QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {positives}),
        ranked AS (SELECT b.*, s.id AS negative_id, s.score AS negative_score,
                          row_number() OVER (PARTITION BY b.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS rank
                   FROM best b JOIN scored s ON b.anchor_id = s.anchor_id AND NOT s.same
                    AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score)
        SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score
        FROM ranked WHERE rank <= {negatives}"""


STATEMENTS = {"op5_secret_scan": _secrets(), "op6_warc": _warc(), "op8_line_dedup": _line_dedup(),
              "op9_quality_rules": _quality(), "op10_decontamination": _decontamination(),
              "op11_sharding": _sharding(), "op12_conversation_trie": _conversation_trie(), "op13_hard_negatives": _hard_negatives()}
