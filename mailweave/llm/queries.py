"""The operators of this folder as queries, and the SQL that checks them where SQL can."""

from .alignment import op12_alignment
from .decontam import op9_decontamination
from .maintext import op1_main_text
from .ngrams import op7_lm_scores
from .packing import op4_packing
from .pii import op6_pii
from .quality import op10_quality
from .repeats import op11_repeats
from .search import op13_ranked_search
from .sharding import op3_sharding
from .simhash import op8_simhash
from .toxicity import op2_toxicity
from .vectors import op5_embeddings

QUERIES = {
    "op1_main_text": op1_main_text,
    "op2_toxicity": op2_toxicity,
    "op3_sharding": op3_sharding,
    "op4_packing": op4_packing,
    "op5_embeddings": op5_embeddings,
    "op6_pii": op6_pii,
    "op7_lm_scores": op7_lm_scores,
    "op8_simhash": op8_simhash,
    "op9_decontamination": op9_decontamination,
    "op10_quality": op10_quality,
    "op11_repeats": op11_repeats,
    "op12_alignment": op12_alignment,
    "op13_ranked_search": op13_ranked_search,
}

_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLE_SQL: dict[str, str] = {
    "op5_embeddings": """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
good AS (SELECT * FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS u, b.vec_id AS v FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS u, vec_id AS v FROM v UNION SELECT r.u, l.v FROM reach r JOIN link l ON l.u = r.v)
SELECT v.vec_id, (SELECT count(*) FROM link WHERE u = v.vec_id) AS n_links, c.component_id, v.vec_id = c.component_id AS kept, CAST(1.0 AS DOUBLE) AS audited_recall
FROM v JOIN (SELECT u, min(v) AS component_id FROM reach GROUP BY u) c ON c.u = v.vec_id""",
    "op9_decontamination": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
b AS (SELECT DISTINCT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g FROM b, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS t(i) WHERE len(w) > 0),
part AS (SELECT r, m, i, array_to_string(w[i:i + m - 1], ' ') AS g FROM d, (SELECT DISTINCT m FROM win) AS sizes, unnest(range(1, len(w) - m + 2)) AS t(i)),
hit AS (SELECT r, i, m, item_id FROM part JOIN win USING (m, g)),
words AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + m)) AS p FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, sha256(string_agg(id, ',' ORDER BY id)) AS h FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)""",
    "op11_repeats": """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(hex(encode(text)), '') AS h, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n FROM documents),
win AS (SELECT r, doc_id, i, substr(h, 2 * i + 1, 200) AS g FROM d, unnest(range(0, n - 99)) AS t(i)),
late AS (SELECT r, i FROM win QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS LAST, r, i) > 1),
span AS (SELECT r, min(i) AS a, max(i) + 100 AS b FROM (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS s FROM
 (SELECT r, i, CAST(i > lag(i, 1, -1000) OVER (PARTITION BY r ORDER BY i) + 100 AS INT) AS fresh FROM late)) GROUP BY r, s),
gap AS (SELECT r, a, b, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS since FROM span),
cut AS (SELECT r, sum(b - a) AS gone, count(*) AS spans, max(b) AS b, string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS k FROM gap JOIN d USING (r) GROUP BY r)
SELECT doc_id, n AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans,
 sha256(unhex(coalesce(k || substr(h, 2 * b + 1), h))) AS kept_sha256 FROM d LEFT JOIN cut USING (r)""",
    "op13_ranked_search": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
total AS (SELECT count(*) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
items AS (SELECT row_number() OVER () AS q, item_id, w FROM (SELECT DISTINCT item_id, text, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL)),
asked AS (SELECT q, item_id, term, count(*) AS times FROM (SELECT q, item_id, unnest(w) AS term FROM items) GROUP BY ALL),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) SEMI JOIN asked USING (term) GROUP BY ALL),
weight AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf, total GROUP BY term, n),
norm AS (SELECT r, doc_id, 75 + (25 * len(w) * n) // l AS m FROM d, total WHERE len(w) > 0),
score AS (SELECT q, item_id, r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
 FROM asked JOIN tf USING (term) JOIN weight USING (term) JOIN norm USING (r) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
FROM score WHERE score > 0 QUALIFY rank <= 20""",
}
