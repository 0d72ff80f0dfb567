"""SQL that computes the results of registered queries by plain means, where SQL can."""

from __future__ import annotations

SQL: dict[str, str] = {}

SQL["op11_phrases"] = r"""
WITH texts AS (
    SELECT coalesce(lang, 'und') AS lang,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
    FROM documents
), pieces AS (
    SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM texts
), spoken AS (
    SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
), totals AS (
    SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM spoken GROUP BY lang
), grams AS (
    SELECT lang, unnest(flatten([
        list_transform(range(1, len(w) - k + 2), lambda i: {'k': k, 'phrase': array_to_string(w[i : i + k - 1], ' ')})
        for k in [1, 2, 3, 4]])) AS g
    FROM spoken
), counts AS (
    SELECT lang, g.k AS k, g.phrase AS phrase, count(*) AS f FROM grams GROUP BY ALL
), candidates AS (
    SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE k > 1 AND f >= 30
), cuts AS (
    SELECT lang, k, phrase, a, j, array_to_string(w[1 : j], ' ') AS head, array_to_string(w[j + 1 : k], ' ') AS tail
    FROM candidates, unnest(range(1, k)) AS c(j)
), scores AS (
    SELECT cuts.lang, cuts.phrase, a, j, x.f AS l, y.f AS r,
        CAST((2000000 * CAST(a AS HUGEINT)) // (x.f + y.f) AS BIGINT) AS score
    FROM cuts JOIN counts x ON x.lang = cuts.lang AND x.phrase = head JOIN counts y ON y.lang = cuts.lang AND y.phrase = tail
), lowest AS (
    SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
), covers AS (
    SELECT lang, array_to_string(w[i : i + m - 1], ' ') AS phrase, max(a) AS cover
    FROM candidates, unnest(range(2, k)) AS d(m), unnest(range(1, k - m + 2)) AS e(i) GROUP BY ALL
), kept AS (
    SELECT lowest.* FROM lowest LEFT JOIN covers USING (lang, phrase)
    WHERE cover IS NULL OR 100 * CAST(cover AS HUGEINT) < 80 * CAST(a AS HUGEINT)
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

SQL["op12_hard_negatives"] = """
WITH rows AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
    FROM rows a JOIN rows b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
    SELECT anchor_id, id AS positive_id, score AS positive_score FROM scores WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
), negatives AS (
    SELECT p.anchor_id, positive_id, id AS negative_id, positive_score, score AS negative_score,
        CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank
    FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND NOT same
    WHERE 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
)
SELECT * FROM negatives WHERE rank <= 10
"""

SQL["op13_near_vectors"] = """
WITH RECURSIVE rows AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
), good AS (
    SELECT * FROM rows WHERE vec_id IS NOT NULL AND v IS NOT NULL
        AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.vec_id AS u, b.vec_id AS v FROM good a JOIN good b ON a.vec_id <> b.vec_id
    WHERE list_cosine_similarity(a.v, b.v) >= 0.95
), reach AS (
    SELECT vec_id AS node, vec_id AS root FROM rows
    UNION
    SELECT links.v, root FROM reach JOIN links ON links.u = reach.node WHERE root < links.v
), roots AS (
    SELECT node, min(root) AS component_id FROM reach GROUP BY node
), counts AS (
    SELECT u, count(*) AS n FROM links GROUP BY u
)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM rows JOIN roots ON node = vec_id LEFT JOIN counts ON u = vec_id
"""
