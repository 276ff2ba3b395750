"""DuckDB SQL for the corpus queries that SQL can express; tests hold the others against plain Python."""

from __future__ import annotations

from .urlfilter import SPAM_WORDS

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = "regexp_extract_all(" + LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP3 = f"""WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {WORDS} AS w FROM benchmark),
bs AS (SELECT *, least(len(w), 13) AS n FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM bs)),
d AS (SELECT doc_id, {WORDS} AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM win),
pos AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT pos.doc_id, pos.n, pos.i, win.item FROM pos JOIN win ON pos.n = win.n AND pos.g = win.g),
places AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)"""

OP5 = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL),
x AS (SELECT vec_id, unnest(e) AS x, generate_subscripts(e, 1) AS k FROM v),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score FROM x q JOIN x c ON q.k = c.k AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 GROUP BY ALL)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5"""

OP7 = """WITH RECURSIVE r AS (SELECT source, (SELECT count(*) FROM documents) / (SELECT count(*) FROM (SELECT DISTINCT source FROM documents)) / CAST(count(*) AS DOUBLE) AS rate FROM documents GROUP BY source),
steps AS (SELECT source, rate, 0 AS k, -rate AS lp, exp(-rate) AS total FROM r UNION ALL SELECT source, rate, k + 1, lp + ln(rate) - ln(k + 1), total + exp(lp + ln(rate) - ln(k + 1)) FROM steps WHERE k < ceil(rate + 12 * sqrt(rate) + 30)),
u AS (SELECT *, CAST('0x' || substr(md5('17:' || doc_id), 1, 13) AS BIGINT) / CAST(4503599627370496 AS DOUBLE) AS u FROM documents),
t AS (SELECT u.*, (SELECT count(*) FROM steps WHERE u.source IS NOT DISTINCT FROM steps.source AND total <= u.u) AS times FROM u)
SELECT doc_id, text, lang, source, n_chars, CAST(c AS INT) AS copy_no, md5('17:order:' || doc_id || ':' || c) AS shuffle_key FROM (SELECT *, unnest(range(1, times + 1)) AS c FROM t)"""

OP8 = f"""WITH p AS (SELECT page_id, {LOWER.format("regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)")} AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r(h, s, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m AS (SELECT p.page_id, p.host, p.path, r.h || r.s AS rule, r.v FROM p LEFT JOIN r ON (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.s) QUALIFY row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.h || r.s) DESC NULLS LAST) = 1)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN len(list_intersect(string_split_regex(host, '[^a-z0-9]+'), {SPAM_WORDS!r})) > 0 THEN 'block' ELSE 'allow' END) AS verdict FROM m"""


LICENSE_BASE = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {WORDS} AS w FROM documents),
p(phrase, label) AS (VALUES ('gnu general public license', 'gpl'), ('apache license', 'apache'), ('cc by', 'cc-by'), ('mit license', 'mit')),
f AS (SELECT rid, label, unnest(list_filter(range(0, len(w)), lambda i: array_to_string(list_slice(w, i + 1, i + len(string_split(phrase, ' '))), ' ') = phrase)) AS k FROM d, p),
g AS (SELECT rid, count(*) AS n, min(k) AS a, max(k) AS z, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM f GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_base, a AS first_word, z AS last_word, coalesce(labels, '') AS base_labels FROM d LEFT JOIN g USING (rid)"""

TOKEN_BYTES = "SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes FROM documents"


OP11 = r"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 19), ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
late AS (SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM late),
pos AS (SELECT rid, doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY p) AS s FROM pos ANTI JOIN gone USING (doc_id, p) GROUP BY rid),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (rid) LEFT JOIN lost USING (doc_id)"""


def vector_codes(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Rounds of assignment and means, one pair of tables each."""
    with_tables = [
        "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"x AS MATERIALIZED (SELECT vec_id, j, list_slice(e, j * len(e) // {parts} + 1, (j + 1) * len(e) // {parts}) AS x FROM v, (SELECT unnest(range({parts})) AS j))",
        f"c0 AS MATERIALIZED (SELECT j, row_number() OVER (PARTITION BY j ORDER BY vec_id) - 1 AS k, x AS c FROM x QUALIFY row_number() OVER (PARTITION BY j ORDER BY vec_id) <= {entries})",
    ]
    for r in range(rounds + 1):
        away = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
        with_tables.append(f"a{r} AS MATERIALIZED (SELECT vec_id, j, x, k, {away} AS away FROM x JOIN c{r} USING (j) QUALIFY row_number() OVER (PARTITION BY vec_id, j ORDER BY {away}, k) = 1)")
        if r < rounds:
            mean = f"m{r} AS (SELECT j, k, list(m ORDER BY p) AS m FROM (SELECT j, k, p, CAST(floor(CAST(sum(y) AS DOUBLE) / count(*)) AS BIGINT) AS m FROM (SELECT j, k, unnest(x) AS y, generate_subscripts(x, 1) AS p FROM a{r}) GROUP BY j, k, p) GROUP BY j, k)"
            with_tables += [mean, f"c{r + 1} AS MATERIALIZED (SELECT j, k, coalesce(m, c) AS c FROM c{r} LEFT JOIN m{r} USING (j, k))"]
    with_tables += [
        f"codes AS (SELECT vec_id, string_agg(printf('%02x', k), '' ORDER BY j) AS code, CAST(sum(away) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)",
        f"book AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY j, k)) AS codebooks_sha256 FROM c{rounds})",
    ]
    return f"WITH {', '.join(with_tables)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM codes JOIN v USING (vec_id), book"


OP13 = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || doc_id) AS s FROM documents),
h AS (SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u, list_transform([1, 9, 17, 25], lambda p: CAST('0x' || substr(s, p, 8) AS BIGINT)) AS h FROM d),
b AS (SELECT *, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS a, greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS z,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 100 THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(list_slice(u, 1, a), '') AS prefix, array_to_string(list_slice(u, a + 1, z), '') AS middle, array_to_string(list_slice(u, z + 1, len(u)), '') AS suffix FROM b)
SELECT doc_id, len(u) AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""


def oracle_sql() -> dict[str, str]:
    return {"license_base": LICENSE_BASE, "token_bytes": TOKEN_BYTES, "op3_decontamination": OP3, "op5_exact_topk": OP5, "op7_source_mixing": OP7, "op8_url_filter": OP8, "op11_substring_dedup": OP11, "op12_vector_codes": vector_codes(), "op13_fill_in_middle": OP13}
