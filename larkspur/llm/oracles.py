"""DuckDB SQL for the corpus queries that SQL can express."""

import string


def _katz() -> str:
    """Scores of an order-3 model: counts, discounts, C and alpha of each level, then a backoff by joins. ' ' is the begin mark, '' the end token."""
    level = lambda m, h, c: f"""
        n{m} AS MATERIALIZED (SELECT {h}, w, count(*) AS c FROM tokens WHERE NOT held AND {c} GROUP BY ALL),
        r{m} AS (SELECT c AS r, count(*)::DOUBLE AS n FROM n{m} WHERE c <= 6 GROUP BY 1),
        k{m} AS (SELECT k FROM range(1, 6) t(k) WHERE (SELECT count(*) FROM r{m} WHERE r <= k + 1) = k + 1
            AND (SELECT (k + 1) * b.n / a.n FROM r{m} a, r{m} b WHERE a.r = 1 AND b.r = k + 1) < 1
            AND (SELECT bool_and(v > 0 AND v < 1) FROM (SELECT ((a.r + 1) * b.n / (a.r * a.n) - x.x) / (1 - x.x) AS v FROM r{m} a JOIN r{m} b ON b.r = a.r + 1, (SELECT (k + 1) * q.n / p.n AS x FROM r{m} p, r{m} q WHERE p.r = 1 AND q.r = k + 1) x WHERE a.r <= k))),
        d{m} AS MATERIALIZED (SELECT a.r, ((a.r + 1) * b.n / (a.r * a.n) - x.x) / (1 - x.x) AS d FROM r{m} a JOIN r{m} b ON b.r = a.r + 1,
            (SELECT (k + 1) * q.n / p.n AS x, k FROM r{m} p, r{m} q, (SELECT max(k) AS k FROM k{m}) WHERE p.r = 1 AND q.r = k + 1) x WHERE a.r <= x.k)"""
    back = lambda m, on, h, lower: f"""
        s{m} AS MATERIALIZED (SELECT n{m}.*, n{m}.c * coalesce(d, 1.0) AS kept, {lower}.p AS low FROM n{m} LEFT JOIN d{m} ON r = n{m}.c JOIN {lower} USING ({on})),
        h{m} AS MATERIALIZED (SELECT {h}, total + CASE WHEN kept >= total THEN 1 ELSE 0 END AS total, kept, low FROM (SELECT {h}, sum(c)::DOUBLE AS total, sum(kept) AS kept, sum(low) AS low FROM s{m} GROUP BY ALL)),
        p{m} AS MATERIALIZED (SELECT {h}, w, kept / total AS p FROM (SELECT {', '.join('s%d.%s' % (m, x) for x in h.split(', '))}, w, s{m}.kept, total FROM s{m} JOIN h{m} USING ({h})))"""
    return rf"""
        WITH RECURSIVE bits AS (SELECT i AS b, i AS v, 0 AS step FROM range(256) t(i)
            UNION ALL SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, step + 1 FROM bits WHERE step < 8),
        crc AS (SELECT list(v ORDER BY b) AS t FROM bits WHERE step = 8),
        docs AS MATERIALIZED (SELECT row_number() OVER () AS doc, doc_id, xor(list_reduce(list_prepend(4294967295, [ord(x)::BIGINT for x in string_split(doc_id::VARCHAR, '')]),
                lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 7 = 2 AS held,
            list_append([x for x in string_split_regex(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[\x20\x09-\x0D]+') if x <> ''], '') AS ws FROM documents, crc),
        tokens AS MATERIALIZED (SELECT doc, held, i, ws[i] AS w, CASE WHEN i = 1 THEN ' ' ELSE ws[i - 1] END AS u, CASE WHEN i = 2 THEN ' ' WHEN i > 2 THEN ws[i - 2] END AS t
            FROM (SELECT doc, held, ws, unnest(range(1, len(ws) + 1)) AS i FROM docs)),
        {level(1, "0 AS z", "true")}, {level(2, "u", "true")}, {level(3, "t, u", "t IS NOT NULL")},
        sums AS (SELECT coalesce(sum(c), 0)::DOUBLE AS total, count(*) AS kinds, coalesce(sum(c * (1 - coalesce(d, 1.0))), 0.0) AS spare FROM n1 LEFT JOIN d1 ON r = c),
        floors AS MATERIALIZED (SELECT total, kinds, total + CASE WHEN spare = 0 THEN 1 ELSE 0 END AS floor, CASE WHEN spare = 0 THEN 1.0 ELSE spare END / (total + CASE WHEN spare = 0 THEN 1 ELSE 0 END) AS unknown FROM sums),
        p1 AS MATERIALIZED (SELECT w, c, c * coalesce(d, 1.0) / floor AS p FROM n1 LEFT JOIN d1 ON r = c, floors),
        {back(2, "w", "u", "p1")}, {back(3, "u, w", "t, u", "p2")},
        scored AS (SELECT k.doc, coalesce(p1.c, 0) AS c, coalesce(p3.p,
                CASE WHEN h3.total IS NULL THEN 1.0 ELSE (1 - h3.kept / h3.total) / greatest(1 - h3.low, 1e-300) END
                * coalesce(p2.p, CASE WHEN h2.total IS NULL THEN 1.0 ELSE (1 - h2.kept / h2.total) / greatest(1 - h2.low, 1e-300) END * coalesce(p1.p, unknown))) AS p
            FROM tokens k CROSS JOIN floors LEFT JOIN p1 ON p1.w = k.w LEFT JOIN p2 ON p2.u = k.u AND p2.w = k.w LEFT JOIN h2 ON h2.u = k.u
            LEFT JOIN p3 ON p3.t = k.t AND p3.u = k.u AND p3.w = k.w LEFT JOIN h3 ON h3.t = k.t AND h3.u = k.u)
        SELECT doc_id, held AS held_out, count(*) AS n_tokens, count(*) FILTER (c > 0) AS n_known, CAST(any_value(total) AS BIGINT) AS train_tokens,
            round(sum(log10((c + 1) / (total + kinds + 1))), 6) AS base_score, round(sum(log10(p)), 6) AS score
        FROM scored JOIN docs USING (doc), floors GROUP BY doc, doc_id, held
    """


ORACLES = {
    "op2_warc_index_merge": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        k AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
                     max(page_id) OVER (PARTITION BY html) AS last FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to
        FROM k
    """,
    "op3_katz_backoff": _katz(),
    # Items of at least five words, as the benchmark table has them.
    "op4_simhash_windows": r"""
        WITH dw AS (SELECT doc_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+', ' ', 'g')), ' ') AS w FROM documents),
        iw AS (SELECT item_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+', ' ', 'g')), ' ') AS w FROM benchmark),
        dg AS (SELECT doc_id, pos, array_to_string(w[pos + 1 : pos + 5], ' ') AS gram, len(w) - 4 AS total FROM dw, unnest(range(0, len(w) - 4)) AS t(pos)),
        ig AS (SELECT item_id, pos, array_to_string(w[pos + 1 : pos + 5], ' ') AS gram, len(w) - 4 AS m FROM iw, unnest(range(0, len(w) - 4)) AS t(pos)),
        starts AS (SELECT DISTINCT doc_id, item_id, greatest(0, least(dg.pos - ig.pos, total - m)) AS start, m, least(m, total) AS n FROM dg JOIN ig USING (gram)),
        wc AS (SELECT s.doc_id, item_id, start, m, n, gram, count(*) AS c FROM starts s JOIN dg ON dg.doc_id = s.doc_id AND pos >= start AND pos < start + m GROUP BY ALL),
        ic AS (SELECT item_id, gram, count(*) AS c FROM ig GROUP BY ALL),
        shared AS (SELECT doc_id, item_id, start, m, n, sum(least(wc.c, ic.c)) AS k FROM wc JOIN ic USING (item_id, gram) GROUP BY ALL),
        scored AS (SELECT *, k::DOUBLE / (m + n - k) AS s FROM shared)
        SELECT doc_id, item_id, round(s, 6) AS similarity, CAST(start AS INTEGER) AS start_word, CAST(m + 4 AS INTEGER) AS n_words FROM scored WHERE s >= 0.8
        QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY s DESC, start) = 1
    """,
    # Every turn of the table has a conversation.
    "op7_preference_pairs": r"""
        WITH answers AS (SELECT conv_id, max(turn) AS last FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
        final AS (SELECT c.conv_id, max(coalesce(c.text, '')) AS other FROM conversations c JOIN answers a ON c.conv_id = a.conv_id AND c.turn = a.last
                  WHERE c.role = 'assistant' GROUP BY c.conv_id),
        marked AS (SELECT c.conv_id, c.turn, coalesce(c.role, 'user') AS role, replace(coalesce(c.text, ''), '<|im_', '< |im_') AS text, replace(f.other, '<|im_', '< |im_') AS other,
                          coalesce(c.role = 'assistant' AND c.turn = a.last, false) AS swapped
                   FROM conversations c LEFT JOIN answers a USING (conv_id) LEFT JOIN final f ON f.conv_id = c.conv_id + 1),
        said AS (SELECT *, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS mine,
                        CASE WHEN NOT swapped THEN '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10)
                             WHEN other IS NOT NULL THEN '<|im_start|>assistant' || chr(10) || other || '<|im_end|>' || chr(10) ELSE '' END AS theirs FROM marked),
        parted AS (SELECT *, bool_or(mine <> theirs) OVER w AS after, sum(length(mine)) OVER w AS mine_end, sum(length(theirs)) OVER w AS their_end
                   FROM said WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
        SELECT conv_id, count(*) FILTER (NOT after) AS common_turns,
               coalesce(string_agg(mine, '' ORDER BY turn) FILTER (NOT after), '') AS prompt,
               coalesce(string_agg(mine, '' ORDER BY turn) FILTER (after), '') AS chosen,
               coalesce(string_agg(theirs, '' ORDER BY turn) FILTER (after), '') AS rejected,
               coalesce(string_agg(CAST(mine_end - length(mine) + length(role) + 13 AS VARCHAR) || '-' || CAST(mine_end AS VARCHAR), ' ' ORDER BY turn) FILTER (after AND role = 'assistant'), '') AS chosen_spans,
               coalesce(string_agg(CAST(their_end - length(theirs) + length(role) + 13 AS VARCHAR) || '-' || CAST(their_end AS VARCHAR), ' ' ORDER BY turn) FILTER (after AND role = 'assistant' AND theirs <> ''), '') AS rejected_spans
        FROM parted GROUP BY conv_id
    """,
    "op10_block_naming": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
        h AS (SELECT doc_id, sha256(norm) AS text_sha256 FROM t)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, text_sha256
        FROM h WINDOW w AS (PARTITION BY text_sha256)
    """,
}
