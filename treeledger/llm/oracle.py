"""DuckDB SQL for the queries that SQL can express."""

_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_FOLDED}, '[^\x20\x09-\x0D]+')"

_REACH = """e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT id, id AS c FROM v UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id WHERE r.c < e.b),
c AS (SELECT id, min(c) AS component_id FROM r GROUP BY 1)"""

LM_SCORES = f"""WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
t AS (SELECT doc_id, unnest(ws) AS w, unnest(list_concat([NULL], ws[:-2])) AS v FROM d),
one AS (SELECT w, count(*) AS n FROM t GROUP BY 1), two AS (SELECT v, w, count(*) AS n FROM t WHERE v IS NOT NULL GROUP BY ALL),
s AS (SELECT t.doc_id, CASE WHEN two.n >= 2 THEN ln(two.n) - ln(h.n) ELSE ln(one.n) - ln((SELECT count(*) FROM t)) + CASE WHEN t.v IS NULL THEN 0 ELSE ln(0.4) END END AS x
  FROM t JOIN one ON one.w = t.w LEFT JOIN two ON two.v = t.v AND two.w = t.w LEFT JOIN one h ON h.w = t.v),
g AS (SELECT doc_id, sum(x) AS x FROM s GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, round(coalesce(x, 0), 4) AS log_score, round(CASE WHEN len(ws) > 0 THEN x / len(ws) END, 4) AS mean_log_score FROM d LEFT JOIN g USING (doc_id)"""

REPEATS = """WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, k, substr(h, 1024 * k + 1, 1122) AS c FROM (SELECT *, unnest(range((length(h) + 1023) // 1024)) AS k FROM t)),
p AS (SELECT doc_id, 512 * k + j AS i, substr(c, 2 * j + 1, 100) AS s FROM (SELECT *, unnest(range(least(512, greatest(length(c) // 2 - 49, 0)))) AS j FROM b)),
f AS (SELECT s, min(doc_id) AS first FROM p GROUP BY 1),
hit AS (SELECT doc_id, i FROM p JOIN f USING (s) WHERE first < doc_id),
edge AS (SELECT *, max(i) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM hit),
grp AS (SELECT *, sum(CASE WHEN prev IS NULL OR i > prev + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM edge),
span AS (SELECT doc_id, g, min(i) AS a, max(i) + 50 AS z FROM grp GROUP BY ALL),
n AS (SELECT doc_id, sum(z - a)::BIGINT AS removed, count(*) AS spans FROM span GROUP BY 1),
gap AS (SELECT doc_id, a, z, lag(z) OVER (PARTITION BY doc_id ORDER BY a) AS before, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS after FROM span),
piece AS (SELECT doc_id, a AS place, substr(h, 2 * coalesce(before, 0) + 1, 2 * (a - coalesce(before, 0))) || CASE WHEN after IS NULL THEN substr(h, 2 * z + 1) ELSE '' END AS rest FROM gap JOIN t USING (doc_id)),
kept AS (SELECT doc_id, string_agg(rest, '' ORDER BY place) AS rest FROM piece GROUP BY 1)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(rest, h))) AS kept_sha256 FROM t LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)"""

NEAR_DUPLICATES = f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS ws FROM documents), v AS (SELECT doc_id AS id FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')] ELSE [array_to_string(ws[i:i + 3], ' ') FOR i IN range(1, len(ws) - 2)] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
k AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM k JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
{_REACH}
SELECT c.id AS doc_id, coalesce(n, 0) AS n_shingles, component_id, c.id = component_id AS kept FROM c LEFT JOIN n ON n.doc_id = c.id"""

VECTORS = f"""WITH RECURSIVE u AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL), v AS (SELECT vec_id AS id FROM embeddings),
l AS (SELECT p.vec_id AS a, q.vec_id AS b FROM u p JOIN u q ON p.label = q.label AND p.vec_id < q.vec_id AND list_cosine_similarity(p.x, q.x) >= 0.98),
{_REACH}
SELECT c.id AS vec_id, (SELECT count(*) FROM e WHERE e.a = c.id) AS n_links, component_id, c.id = component_id AS kept FROM c"""

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

LINES = f"""WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents),
l AS (SELECT doc_id, unnest(x) AS line, unnest(range(len(x))) AS place FROM d),
k AS (SELECT *, translate(trim(line, {_BLANKS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, min(doc_id) AS least FROM k WHERE length(key) >= 10 GROUP BY 1 HAVING count(DISTINCT doc_id) > 1),
g AS (SELECT doc_id, line, place, coalesce(doc_id > least, false) AS goes FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (goes) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT goes), '')) AS kept_sha256 FROM g GROUP BY 1"""


def _codes(rounds: int) -> str:
    """Product quantiser: each round assigns the parts (a...) to the entries and moves these (c...)."""
    distance = "list_sum([(v[i] - e[i]) * (v[i] - e[i]) FOR i IN range(1, len(v) + 1)])::BIGINT"
    assign = lambda r: f"a{r} AS MATERIALIZED (SELECT vec_id, p, any_value(v) AS v, min(struct_pack(d := {distance}, j := j)) AS b FROM t JOIN c{r} USING (p) GROUP BY 1, 2)"
    move = lambda r: f"""m{r} AS (SELECT p, j, list(m ORDER BY i) AS e FROM (SELECT p, j, i, floor(sum(y) / count(*))::BIGINT AS m FROM (SELECT p, b.j AS j, unnest(v) AS y, unnest(range(len(v))) AS i FROM a{r}) GROUP BY 1, 2, 3) GROUP BY 1, 2),
c{r + 1} AS MATERIALIZED (SELECT p, j, coalesce(m{r}.e, c{r}.e) AS e FROM c{r} LEFT JOIN m{r} USING (p, j))"""  # noqa: E731
    steps = ",\n".join(step for r in range(rounds) for step in (assign(r), move(r)))
    return f"""WITH k AS (SELECT vec_id, label, [floor(4096 * c::DOUBLE)::BIGINT FOR c IN embedding] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
t AS MATERIALIZED (SELECT vec_id, p, x[len(x) * p // 8 + 1:len(x) * (p + 1) // 8] AS v FROM k, range(8) AS q(p)),
c0 AS MATERIALIZED (SELECT p, n AS j, v AS e FROM t JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS n FROM k) USING (vec_id) WHERE n < 16),
{steps},
{assign(rounds)},
o AS (SELECT vec_id, string_agg(printf('%02x', b.j), '' ORDER BY p) AS code, sum(b.d)::BIGINT AS error FROM a{rounds} GROUP BY 1),
h AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY p, j)) AS codebooks_sha256 FROM c{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM o JOIN k USING (vec_id), h"""


CODES = _codes(6)

ORACLE_SQL = {"op1_lm_scoring": LM_SCORES, "op2_repeats": REPEATS, "op5_minhash": NEAR_DUPLICATES, "op10_embeddings": VECTORS, "op11_lines": LINES, "op12_codes": CODES}
