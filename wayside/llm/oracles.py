"""DuckDB SQL for the queries of this package that SQL can express."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

# vectors that take part, each component x as floor(256 * x)
VECTORS = """v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"""

ORACLES = {
    "op1_mixing": rf"""
        WITH d AS (SELECT doc_id, source, CAST(len({WORDS}) AS BIGINT) AS size, md5(CAST(doc_id AS VARCHAR)) AS k FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
        w AS (SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1] AS BIGINT) AS weight,
                     CAST(sum(source_size) OVER () AS BIGINT) AS total FROM s),
        f AS (SELECT *, 3 * source_size * sum(weight) OVER r <= weight * (total - coalesce(sum(3 * source_size) OVER b, 0)) AS fills FROM w
              WINDOW b AS (ORDER BY source_size / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                     r AS (ORDER BY source_size / weight, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
        t AS (SELECT source, source_size, CASE WHEN fills THEN CAST(3 * source_size AS DOUBLE)
                     ELSE CAST(total - coalesce(sum(3 * source_size) FILTER (fills) OVER (), 0) AS DOUBLE) * weight / sum(weight) FILTER (NOT fills) OVER () END AS target FROM f),
        p AS (SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS budget,
                     CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ahead
              FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target,
               CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size + greatest(0, least(size, budget % source_size - ahead)) END AS taken
        FROM p""",
    "op2_near_dedup": r"""
        WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                     ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END) AS g FROM d),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
        e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
        r AS (SELECT doc_id AS v, doc_id AS root FROM d UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.v),
        c AS (SELECT v, min(root) AS component_id FROM r GROUP BY v)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
        FROM d JOIN c ON c.v = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
    "op4_chat_format": r"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
        q AS (SELECT *, lag(role, 1, '') OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
                     length(text) + len(regexp_extract_all(text, '\\|</?s>|\[/?(?:SYS|INST|BOT|ROLE|NAME)\]')) AS quoted,
                     length(role) + len(regexp_extract_all(role, '\\|</?s>|\[/?(?:SYS|INST|BOT|ROLE|NAME)\]')) AS named FROM c)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(quoted + CASE role WHEN 'system' THEN 14 WHEN 'user' THEN 13 WHEN 'assistant' THEN 9 ELSE 20 + named END) AS BIGINT) AS formatted_chars,
               bool_and((before IN ('', 'system', 'assistant') AND role = 'user' OR before = 'user' AND role = 'assistant' OR before = '' AND role = 'system')) AS valid
        FROM q GROUP BY conv_id""",
    "op6_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
               count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents""",
    "op10_quality_rules": rf"""
        WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, {WORDS} AS words, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
        l AS (SELECT doc_id, source, text, list_filter(parts, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
        e AS (SELECT doc_id, source, text, unnest(lines) AS line FROM l),
        n AS (SELECT *, trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g')) AS same FROM e),
        often AS (SELECT source, same FROM n GROUP BY source, same HAVING count(DISTINCT doc_id) > 10),
        gone AS (SELECT n.doc_id, sum(len(regexp_extract_all(n.line, '[^\x20\x09-\x0D]+'))) AS words FROM n
                 JOIN often o ON n.source IS NOT DISTINCT FROM o.source AND n.same = o.same GROUP BY n.doc_id),
        w AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d),
        g AS (SELECT doc_id, i, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o AS win FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
        again AS (SELECT doc_id, i FROM g WHERE win IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
        covered AS (SELECT doc_id, count(DISTINCT i + o.k) AS n FROM again, (VALUES (0), (1), (2)) o(k) GROUP BY doc_id),
        r AS (SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, CAST(length(array_to_string(d.words, '')) AS BIGINT) AS word_chars,
                     CAST(len(regexp_extract_all(d.text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
                     CAST(len(l.lines) - len(list_distinct(l.lines)) AS BIGINT) AS n_dup_lines,
                     CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, coalesce(gone.words, 0) AS gone
              FROM d JOIN l USING (doc_id) LEFT JOIN covered c USING (doc_id) LEFT JOIN gone USING (doc_id))
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
               n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
               NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - gone >= 0.2 * n_words AS kept
        FROM r""",
    "op11_collocations": r"""
        WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
        g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, (VALUES (1), (2), (3), (4), (5)) t(k)),
        f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
        t AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
        c AS (SELECT * FROM f WHERE k > 1 AND f >= 100 ),
        kept AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c o WHERE o.lang = c.lang AND o.f = c.f AND o.k > c.k AND contains(' ' || o.phrase || ' ', ' ' || c.phrase || ' '))),
        cuts AS (SELECT lang, phrase, k, f AS a, m, array_to_string(string_split(phrase, ' ')[:m], ' ') AS head, array_to_string(string_split(phrase, ' ')[m + 1:], ' ') AS tail
                 FROM kept, (VALUES (1), (2), (3), (4)) t(m) WHERE m < k),
        s AS (SELECT u.lang, u.phrase, u.a, u.m, x.f AS l, y.f AS r, t.n, CAST(1000::HUGEINT * u.a * t.n // (x.f::HUGEINT * y.f) AS BIGINT) AS score
              FROM cuts u JOIN f x ON x.lang = u.lang AND x.phrase = u.head AND x.k = u.m JOIN f y ON y.lang = u.lang AND y.phrase = u.tail AND y.k = u.k - u.m JOIN t ON t.lang = u.lang),
        b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, m) = 1)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score FROM b QUALIFY rank <= 2000""",
    "op12_hard_negatives": f"""
        WITH {VECTORS},
        r AS (SELECT vec_id, v, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label FROM v WHERE label IS NOT NULL),
        s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
              FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
        p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
        SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INT) AS rank,
               other_id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3""",
    "op13_topk_search": f"""
        WITH {VECTORS}
        SELECT a.vec_id AS query_id, CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY list_dot_product(a.v, b.v) DESC, b.vec_id) AS INT) AS rank,
               b.vec_id, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
        FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0 QUALIFY rank <= 5""",
}
