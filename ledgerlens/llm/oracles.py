"""DuckDB SQL for the operators of this package whose results SQL can express."""
from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

DIVERGENCE = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text
           FROM documents),
occ AS (SELECT rid, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), '{UPPER}', '{LOWER}') AS term FROM d),
cnt AS (SELECT rid, lang, source, term, count(*) AS n FROM occ GROUP BY ALL),
kept AS (SELECT lang, term FROM cnt GROUP BY lang, term HAVING count(*) >= 3),
used AS (SELECT lang, source, term, sum(n)::HUGEINT AS n FROM cnt SEMI JOIN kept USING (lang, term) GROUP BY ALL),
vocabulary AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
grp AS (SELECT g.lang, g.source, coalesce(v, 0)::HUGEINT AS v, coalesce(u.total, 0)::HUGEINT AS total
        FROM (SELECT DISTINCT lang, source FROM d) g
        LEFT JOIN vocabulary USING (lang)
        LEFT JOIN (SELECT lang, source, sum(n) AS total FROM used GROUP BY ALL) u USING (lang, source)),
p AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(u.n, 0) AS n,
                          1 + (1000000000::HUGEINT * (coalesce(u.n, 0) + 1)) // (g.total + g.v) AS p
                   FROM grp g JOIN kept k USING (lang) LEFT JOIN used u USING (lang, source, term)),
whole AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 1)) // (max(total) + max(v)) AS q
          FROM used JOIN (SELECT lang, sum(total) AS total, max(v) AS v FROM grp GROUP BY lang) USING (lang) GROUP BY lang, term),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p)::BIGINT AS value
          FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
          UNION ALL
          SELECT a.lang, a.source, 'pair', b.source, 0::BIGINT FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source AND a.v = 0),
terms AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, (((p.p - q) * (p.p - q)) // q)::BIGINT AS value
          FROM p JOIN whole USING (lang, term) WHERE p.n > 0 AND p.p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank
           FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""


def lloyd(k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3) -> str:
    """Lloyd's rounds one after the other, each a pair of tables: assignments, then centroids."""
    steps = [f"""
WITH kept AS (SELECT row_number() OVER () AS rid, vec_id, embedding FROM embeddings
              WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}),
x AS MATERIALIZED (SELECT rid, unnest(generate_series(1, {dims})) AS dim, floor({scale} * unnest(embedding)::DOUBLE)::BIGINT AS x FROM kept),
seeds AS (SELECT rid, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id) NULLS LAST, embedding) - 1 AS c FROM kept),
c0 AS MATERIALIZED (SELECT c, dim, x AS m FROM seeds JOIN x USING (rid) WHERE c < {k})"""]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT rid, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
    SELECT rid, c, sum((x - m) * (x - m)) AS d FROM x JOIN c{r} USING (dim) GROUP BY rid, c) GROUP BY rid)""")
        if r < rounds:
            steps.append(f"""c{r + 1} AS MATERIALIZED (SELECT c, dim, coalesce(s, m) AS m FROM c{r} LEFT JOIN (
    SELECT c, dim, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS s FROM x JOIN a{r} USING (rid) GROUP BY c, dim) USING (c, dim))""")
    last = rounds
    return ",\n".join(steps) + f"""
SELECT vec_id, c::INTEGER AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
       (sum(d) OVER ())::BIGINT AS inertia, h AS centroid_sha256
FROM a{last} JOIN kept USING (rid)
JOIN (SELECT c, sha256(string_agg(m::BIGINT::VARCHAR, ',' ORDER BY dim)) AS h FROM c{last} GROUP BY c) USING (c)
"""


SUBSTRING = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS MATERIALIZED (SELECT rid, doc_id, generate_subscripts(words, 1) AS i, unnest(words) AS word FROM d),
win AS (SELECT rid, doc_id, i, array_to_string(words[i:i + 19], ' ') AS win
        FROM (SELECT rid, doc_id, words, unnest(generate_series(1, len(words) - 19)) AS i FROM d WHERE len(words) >= 20)),
again AS (SELECT rid, i FROM (SELECT rid, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS n FROM win) WHERE n > 1),
covered AS (SELECT w.rid, w.i, word, max(again.i) OVER (PARTITION BY w.rid ORDER BY w.i) >= w.i - 19 AS gone
            FROM w LEFT JOIN again ON w.rid = again.rid AND w.i = again.i),
left_over AS (SELECT rid, count(*) AS n_words, count(*) FILTER (gone) AS n_removed,
                     string_agg(word, ' ' ORDER BY i) FILTER (gone IS NOT TRUE) AS kept FROM covered GROUP BY rid)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN left_over USING (rid)
"""

ORACLES: dict[str, str] = {"op11_divergence": DIVERGENCE, "op12_substring": SUBSTRING, "op13_lloyd": lloyd()}
