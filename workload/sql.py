"""SQL bodies shared by several oracles. Direct definitions, written without the engine's short cuts."""

from __future__ import annotations

SPACE = r"[\s\p{Z}\x0b\x1c-\x1f\x85]+"


def row_scores(q: str = "q", r: str = "r", qv: str | None = "qv", rv: str | None = "rv") -> str:
    """CTEs ending in ``ranked(qid, row_id, tfidf, bm25, dense, n, tfidf_p, bm25_p, dense_p, fusion, rnk)``."""
    dense = "0.0::DOUBLE"
    joins = ""
    if qv:
        dense = "coalesce(list_cosine_similarity(a.v, b.v), 0.0)"
        joins = f"LEFT JOIN {qv} a ON a.qid = {q}.qid LEFT JOIN {rv} b ON b.corpus = {r}.corpus AND b.row_id = {r}.row_id"
    return rf"""
nn AS (SELECT corpus, count(*) AS n FROM {r} GROUP BY corpus),
w AS MATERIALIZED (SELECT corpus, row_id, term, count(*) AS tf FROM
      (SELECT corpus, row_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}')) AS term FROM {r}) GROUP BY ALL),
p AS MATERIALIZED (SELECT corpus, row_id, term, count(*) AS tf FROM
      (SELECT corpus, row_id, unnest(list_filter(regexp_split_to_array(lower(text), '{SPACE}'), lambda x: x <> '')) AS term FROM {r}) GROUP BY ALL),
dw AS (SELECT corpus, term, count(*) AS df FROM w GROUP BY ALL),
dp AS (SELECT corpus, term, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS idf
       FROM p JOIN nn USING (corpus) GROUP BY corpus, term),
mean_idf AS (SELECT corpus, avg(idf) AS m FROM dp GROUP BY corpus),
lens AS (SELECT corpus, row_id, sum(tf) AS len FROM p GROUP BY ALL),
av AS (SELECT corpus, coalesce(sum(len), 0) / any_value(n) AS avg_len FROM nn LEFT JOIN lens USING (corpus) GROUP BY corpus),
qw AS (SELECT qid, corpus, term, count(*) AS qtf FROM
       (SELECT qid, corpus, unnest(regexp_extract_all(lower(question), '[\p{{L}}\p{{N}}_]{{2,}}')) AS term FROM {q}) GROUP BY ALL),
qp AS (SELECT qid, corpus, term, count(*) AS qtf FROM
       (SELECT qid, corpus, unnest(list_filter(regexp_split_to_array(lower(question), '{SPACE}'), lambda x: x <> '')) AS term FROM {q}) GROUP BY ALL),
qlen AS (SELECT qid, sqrt(sum((qtf * (ln((n + 2.0) / (coalesce(df, 0) + 2.0)) + 1)) ** 2)) AS q_len
         FROM qw JOIN nn USING (corpus) LEFT JOIN dw USING (corpus, term) GROUP BY qid),
wide AS (SELECT {q}.qid, w.row_id, w.tf, coalesce(qw.qtf, 0) AS qtf,
                ln((n + 2.0) / (df + 1.0 + CASE WHEN qw.term IS NULL THEN 0 ELSE 1 END)) + 1 AS idf
         FROM {q} JOIN w USING (corpus) JOIN dw USING (corpus, term) JOIN nn USING (corpus)
         LEFT JOIN qw ON qw.qid = {q}.qid AND qw.term = w.term),
tfidf AS (SELECT qid, row_id, sum(qtf * tf * idf * idf) AS product, sqrt(sum((tf * idf) ** 2)) AS r_len FROM wide GROUP BY ALL),
bm AS (SELECT qp.qid, p.row_id, sum(qtf * CASE WHEN idf < 0 THEN 0.25 * m ELSE idf END * tf * 2.5
              / (tf + 1.5 * (0.25 + 0.75 * len / avg_len))) AS bm25
       FROM qp JOIN p USING (corpus, term) JOIN dp USING (corpus, term) JOIN mean_idf USING (corpus)
       JOIN lens ON lens.corpus = p.corpus AND lens.row_id = p.row_id JOIN av ON av.corpus = p.corpus GROUP BY ALL),
scored AS (SELECT {q}.qid, {r}.corpus, {r}.row_id, n,
              CASE WHEN coalesce(q_len, 0) * coalesce(r_len, 0) > 0 THEN product / (q_len * r_len) ELSE 0 END AS tfidf,
              coalesce(bm25, 0)::DOUBLE AS bm25, {dense} AS dense
           FROM {q} JOIN {r} USING (corpus) JOIN nn ON nn.corpus = {r}.corpus
           LEFT JOIN qlen ON qlen.qid = {q}.qid
           LEFT JOIN tfidf ON tfidf.qid = {q}.qid AND tfidf.row_id = {r}.row_id
           LEFT JOIN bm ON bm.qid = {q}.qid AND bm.row_id = {r}.row_id {joins}),
raised AS (SELECT *, exp(tfidf - max(tfidf) OVER o) AS e1, exp(bm25 - max(bm25) OVER o) AS e2, exp(dense - max(dense) OVER o) AS e3
           FROM scored WINDOW o AS (PARTITION BY qid)),
soft AS (SELECT *, e1 / sum(e1) OVER o AS tfidf_p, e2 / sum(e2) OVER o AS bm25_p, e3 / sum(e3) OVER o AS dense_p
         FROM raised WINDOW o AS (PARTITION BY qid)),
fused AS (SELECT *, 0.4::DOUBLE * tfidf_p + 0.3::DOUBLE * bm25_p + 0.3::DOUBLE * dense_p AS fusion FROM soft),
ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(fusion, 12 - 1 - floor(log10(fusion))::INT) DESC, round(tfidf, 9) DESC,
           round(bm25, 9) DESC, round(dense, 9) DESC, row_id DESC) AS rnk FROM fused)"""


def kmeans(points: str = "cs") -> str:
    """CTEs ending in ``cl(qid, col_ord, col_name, llm, sim, cluster_id, cx, cy)``: rounds over whole questions until none moves."""
    far = "list_transform(c, lambda e: round((e.x - m.x) * (e.x - m.x) + (e.y - m.y) * (e.y - m.y), 9))"
    members = f"list_filter(p, lambda m: list_position({far}, list_min({far})) = i)"
    middle = ", ".join(f"'{v}': round(list_sum(list_transform(g, lambda m: m.{v})) / len(g), 12)" for v in "xy")
    step = f"list_transform(c, lambda o, i: coalesce(list_transform([{members}], lambda g: CASE WHEN len(g) > 0 THEN {{{middle}}} END)[1], o))"
    own = far.replace("m.x", "llm").replace("m.y", "sim")
    return f"""
dist0 AS (SELECT DISTINCT qid, round(llm + sim, 12) AS s, round(llm, 12) AS x, round(sim, 12) AS y FROM {points}),
ord0 AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s, x, y) AS i, count(*) OVER (PARTITION BY qid) AS m FROM dist0),
c0 AS (SELECT qid, list({{'x': x, 'y': y}} ORDER BY i) AS c FROM ord0 WHERE i = 1 OR i = (m + 1) // 2 OR i = m GROUP BY qid),
p0 AS (SELECT qid, list({{'x': llm, 'y': sim}} ORDER BY col_ord, col_name, llm, sim) AS p FROM {points} GROUP BY qid),
km AS (SELECT qid, p, c, c AS was, 0 AS round FROM p0 JOIN c0 USING (qid)
       UNION ALL SELECT qid, p, {step}, c, round + 1 FROM km WHERE round < 300 AND (round = 0 OR c <> was)),
cend AS MATERIALIZED (SELECT qid, arg_max(c, round) AS c FROM km GROUP BY qid),
cl AS MATERIALIZED (SELECT qid, col_ord, col_name, llm, sim, k - 1 AS cluster_id, c[k].x AS cx, c[k].y AS cy FROM
       (SELECT p.*, c, list_position({own}, list_min({own})) AS k
        FROM {points} p JOIN cend USING (qid)))"""


# Fixed values in the next body: the keywords, weights and bounds of the question features.
def cluster_choice(q: str) -> str:
    """CTEs over ``cl`` and ``q(qid, question)`` ending in ``scores`` (per cluster) and ``vote`` (per question)."""
    return rf"""
qf AS (SELECT qid, list_filter(regexp_split_to_array(lower(question), '{SPACE}'), lambda x: x <> '') AS words, lower(question) AS lq FROM {q}),
qc AS (SELECT qid, least(len(words) / 10.0::DOUBLE
              + CASE WHEN regexp_matches(lq, '\b(and|or)\b') THEN 0.5 ELSE 0 END
              + CASE WHEN list_has_any(words, ['sum', 'count', 'average', 'total', 'maximum', 'minimum']) THEN 0.3 ELSE 0 END
              + CASE WHEN list_has_any(words, ['in', 'exists']) THEN 0.7 ELSE 0 END, 3.0) AS complexity,
              CASE WHEN regexp_matches(lq, 'sum|total|count|average|max|min') THEN 'aggregation'
                   WHEN regexp_matches(lq, 'where|filter|condition|specific') THEN 'filtering'
                   WHEN regexp_matches(lq, 'show|list|display|all') THEN 'exploration'
                   WHEN regexp_matches(lq, 'compare|difference|versus') THEN 'comparison' ELSE 'general' END AS kind FROM qf),
parts AS (SELECT *, (llm + sim) / 2 AS m, string_split(lower(col_name), '_') AS np FROM cl),
own AS (SELECT qid, cluster_id, count(*) AS size, min(col_ord) AS first_ord, sum(llm) AS sx, sum(sim) AS sy,
               stddev_pop(llm) AS dx, stddev_pop(sim) AS dy, avg(m) AS mean, stddev_pop(m) AS mean_std,
               avg(CASE WHEN round(m, 12) > 0.7 THEN 1.0 ELSE 0.0 END) AS density,
               count(DISTINCT CASE WHEN len(np) > 1 THEN np[1] END) AS prefixes,
               count(DISTINCT CASE WHEN len(np) > 1 THEN np[-1] END) AS suffixes, max(cx) AS cx, max(cy) AS cy
        FROM parts GROUP BY qid, cluster_id),
tot AS (SELECT *, sum(size) OVER o AS ts, sum(sx) OVER o AS tx, sum(sy) OVER o AS ty FROM own WINDOW o AS (PARTITION BY qid)),
qual AS (SELECT *, 1 - (dx + dy) / 2 AS cohesion,
            CASE WHEN ts > size THEN (abs(sx / size - (tx - sx) / (ts - size)) + abs(sy / size - (ty - sy) / (ts - size))) / 2 ELSE 1.0 END AS separation
         FROM tot),
s1 AS (SELECT *, 0.6::DOUBLE * cohesion + 0.4::DOUBLE * separation AS quality,
          CASE WHEN sqrt(tx * tx + ty * ty) * sqrt(cx * cx + cy * cy) > 0
               THEN (tx * cx + ty * cy) / (sqrt(tx * tx + ty * ty) * sqrt(cx * cx + cy * cy)) ELSE 0 END AS similarity FROM qual),
s2 AS (SELECT s1.*, similarity * quality AS semantic, complexity, kind,
          least((prefixes + suffixes) / (2 * size + 1e-8), 1.0) AS diversity,
          1 / (1 + 0.2::DOUBLE * abs(size - least(3 * complexity, 10.0))) AS size_match,
          CASE kind WHEN 'aggregation' THEN CASE WHEN size <= 5 THEN 0.8 ELSE 0.6 END WHEN 'filtering' THEN 1.0
               WHEN 'exploration' THEN CASE WHEN size >= 5 THEN 0.6 ELSE 0.8 END WHEN 'comparison' THEN 0.9 ELSE 0.7 END::DOUBLE AS tw
       FROM s1 JOIN qc USING (qid)),
s3 AS (SELECT *, 0.4::DOUBLE * mean + 0.2::DOUBLE * diversity + 0.2::DOUBLE * density + 0.2::DOUBLE * size_match AS mcdm,
          0.4::DOUBLE * (1 - mean_std / (mean + 1e-8)) + 0.4::DOUBLE * mean + 0.2::DOUBLE * tw AS adaptive FROM s2),
scores AS MATERIALIZED (SELECT *, greatest(avg(adaptive) OVER o - 0.5::DOUBLE * stddev_pop(adaptive) OVER o, 0.3) AS threshold
          FROM s3 WINDOW o AS (PARTITION BY qid)),
places AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(semantic, 12) DESC, cluster_id) AS p1,
            row_number() OVER (PARTITION BY qid ORDER BY round(mcdm, 12) DESC, first_ord) AS p2,
            row_number() OVER (PARTITION BY qid ORDER BY round(adaptive, 12) >= round(threshold, 12) DESC, round(adaptive, 12) DESC, first_ord) AS p3
          FROM scores),
best AS (SELECT qid, max(CASE WHEN p1 = 1 THEN cluster_id END) AS semantic_choice, max(CASE WHEN p2 = 1 THEN cluster_id END) AS mcdm_choice,
            max(CASE WHEN p3 = 1 THEN cluster_id END) AS adaptive_choice, max(semantic) AS semantic_score, max(mcdm) AS mcdm_score,
            max(adaptive) AS adaptive_score, max(threshold) AS threshold FROM places GROUP BY qid),
vote AS MATERIALIZED (SELECT *, CASE
            WHEN semantic_choice <> mcdm_choice AND semantic_choice <> adaptive_choice AND mcdm_choice <> adaptive_choice THEN
              CASE WHEN round(semantic_score, 12) >= round(mcdm_score, 12) AND round(semantic_score, 12) >= round(adaptive_score, 12) THEN semantic_choice
                   WHEN round(mcdm_score, 12) >= round(adaptive_score, 12) THEN mcdm_choice ELSE adaptive_choice END
            WHEN mcdm_choice = adaptive_choice THEN mcdm_choice ELSE semantic_choice END AS selected FROM best)"""


def selection(essential: str | None = None) -> str:
    """CTEs over ``cl`` and ``vote`` ending in ``sel(qid, pos, col_ord, col_name)``."""
    extra = ""
    if essential:
        extra = f"UNION ALL SELECT cl.qid, cl.col_ord, cl.col_name, 2, e.ess_ord, 0 FROM cl JOIN {essential} e USING (qid, col_name)"
    return f"""
others AS (SELECT cl.*, row_number() OVER (PARTITION BY cl.qid, cluster_id ORDER BY round((llm + sim) / 2, 12) DESC, col_ord) AS place
           FROM cl JOIN vote USING (qid) WHERE cluster_id <> selected),
picks AS (SELECT cl.qid, col_ord, col_name, 0 AS o1, col_ord AS o2, 0 AS o3 FROM cl JOIN vote USING (qid) WHERE cluster_id = selected
          UNION ALL SELECT qid, col_ord, col_name, 1, cluster_id, place FROM others WHERE place = 1
          {extra}
          UNION ALL SELECT qid, col_ord, col_name, 3, 0, 0 FROM cl WHERE col_name = 'Row Header'),
firsts AS (SELECT qid, col_ord, col_name, min((o1, o2, o3)) AS o FROM picks GROUP BY ALL),
sel AS MATERIALIZED (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY o) AS pos, col_ord, col_name FROM firsts)"""


PART_SCORES = """
padj AS (SELECT qid, col_ord, col_name, avg(score) / (1 + stddev_pop(score)) AS llm FROM pv GROUP BY ALL),
cs AS MATERIALIZED (SELECT c.qid, c.col_ord, c.col_name, coalesce(llm, 0) AS llm, coalesce(sim, 0) AS sim
       FROM pcol c LEFT JOIN padj USING (qid, col_ord, col_name) LEFT JOIN psim USING (qid, col_ord, col_name))"""

# rows of each question as a corpus of its own
PART_FILTERED = """
q AS (SELECT qid, qid AS corpus, question FROM pq),
r AS (SELECT s.qid AS corpus, pc.row_id, string_agg(coalesce(pc.value, 'None'), ' ' ORDER BY s.pos) AS text
      FROM sel s JOIN pq USING (qid) JOIN pc ON pc.table_id = pq.table_id AND pc.col_name = s.col_name GROUP BY s.qid, pc.row_id),
qv AS (SELECT qid, v FROM pqv),
rv AS (SELECT pq.qid AS corpus, prv.row_id, prv.v FROM pq JOIN prv USING (table_id))"""

KEEP = "rnk <= greatest(1, ceil(n * 0.4::DOUBLE))"
