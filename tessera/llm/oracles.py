"""DuckDB SQL for the operators that SQL can express; an independent statement of the same contracts."""

FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({FOLD}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
                                    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
u AS (SELECT doc_id, unnest(g) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * c >= 80 * (len(x.g) + len(y.g) - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS n, doc_id AS m FROM documents UNION SELECT r.n, e.b FROM r JOIN e ON e.a = r.m)
SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, (SELECT min(m) FROM r WHERE r.n = s.doc_id) AS component_id FROM s
"""

WORDS = rf"regexp_extract_all({FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP3 = rf"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
i AS (SELECT item_id, {WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 10 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 8), lambda k: array_to_string(w[k:k+9], ' ')) END) AS g,
              least(len(w), 10) AS n FROM i),
n AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS k, w FROM d, n WHERE len(w) >= n),
dg AS (SELECT doc_id, n, k, array_to_string(w[k:k+n-1], ' ') AS g FROM dw),
m AS (SELECT doc_id, k, iw.n AS n, item_id FROM dg JOIN iw USING (g, n)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""

OP4 = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS x, length(coalesce(text, '')) AS c FROM documents),
k AS (SELECT doc_id, x, first_value(doc_id) OVER (PARTITION BY x ORDER BY c DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY x) AS group_size FROM t)
SELECT doc_id, keep_id, group_size::BIGINT AS group_size, doc_id = keep_id AS kept, sha256(x) AS text_sha256 FROM k
"""


def op6(templates: dict[str, str]) -> str:
    """License scan by exact containment of each template's distinct shingles in those of the whole text, without windows or hashing."""
    rows = ", ".join("('{}', '{}')".format(name.replace("'", "''"), text.replace("'", "''")) for name, text in sorted(templates.items()))
    words = WORDS.replace("coalesce(text, '')", "text")
    grams = "list_distinct(list_transform(range(1, greatest(1, len({0}) - 4) + 1), lambda i: array_to_string({0}[i:i+4], ' ')))"
    return rf"""
WITH t(license, text) AS (VALUES {rows}),
tw AS (SELECT license, {words} AS w FROM t),
tk AS (SELECT license, w, greatest(0, len(w) - 16) AS last FROM tw WHERE len(w) >= 5),
tp AS (SELECT license, k, w[k+1:k+16] AS w FROM (SELECT license, w, unnest(list_append(list_filter(range(0, last + 1, 12), lambda k: k < last), last)) AS k FROM tk)),
p AS (SELECT license, k, {grams.format('w')} AS g FROM tp),
pg AS (SELECT license, k, len(g) AS n, unnest(g) AS g FROM p),
e AS (SELECT license, count(DISTINCT k) AS n_pieces, count(DISTINCT g) AS total FROM pg GROUP BY 1),
d AS (SELECT doc_id, {WORDS} AS w FROM documents),
dg AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest({grams.format('w')}) AS g FROM d WHERE len(w) >= 5) SEMI JOIN pg USING (g)),
h AS (SELECT doc_id, license, k, n, g FROM dg JOIN pg USING (g)),
m AS (SELECT doc_id, license, count(*) FILTER (c / n::DOUBLE >= 0.8)::BIGINT AS matched_pieces FROM (SELECT doc_id, license, k, n, count(*) AS c FROM h GROUP BY ALL) GROUP BY ALL),
r AS (SELECT doc_id, license, count(DISTINCT g) AS hit FROM h GROUP BY ALL)
SELECT doc_id, license, n_pieces::BIGINT AS n_pieces, matched_pieces, round(hit / total::DOUBLE, 6) AS containment
FROM r JOIN m USING (doc_id, license) JOIN e USING (license) WHERE hit / total::DOUBLE >= 0.8
"""


def op12(stop_words: list[str]) -> str:
    """Quality rules with the thresholds of the production table written out."""
    listed = ", ".join("'" + w + "'" for w in sorted(set(stop_words)))
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT doc_id, k, w[k:k+2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS k FROM w)),
r AS (SELECT doc_id, unnest(range(k, k + 3)) AS p FROM (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
n AS (SELECT doc_id, count(DISTINCT p) AS c FROM r GROUP BY doc_id),
c AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n.c, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines,
         len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) AS n_list_lines,
         len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_cut_lines,
         len(list_filter(w, lambda x: regexp_matches(x, '\pL'))) AS n_letter_words,
         len(list_filter(w, lambda x: lower(x) IN ({listed}))) AS n_stop_words,
         len(list_filter(w, lambda x: regexp_matches(x, '^\PL*[^\p{{Ll}}]*\p{{Lu}}[^\p{{Ll}}]*$'))) AS n_capital_words
  FROM w LEFT JOIN n USING (doc_id)),
f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, list_filter([
    CASE WHEN n_words NOT BETWEEN 50 AND 100000 THEN 'length' END,
    CASE WHEN n_words > 0 AND 1000 * word_chars NOT BETWEEN 3000 * n_words AND 10000 * n_words THEN 'word_length' END,
    CASE WHEN 1000 * n_symbols > 100 * n_words AND n_words > 0 THEN 'symbols' END,
    CASE WHEN 1000 * n_list_lines > 900 * n_lines THEN 'list_lines' END,
    CASE WHEN 1000 * n_cut_lines > 300 * n_lines THEN 'cut_lines' END,
    CASE WHEN 1000 * n_letter_words < 800 * n_words THEN 'letters' END,
    CASE WHEN 1000 * n_stop_words < 60 * n_words THEN 'stop_words' END,
    CASE WHEN 1000 * n_capital_words > 300 * n_words THEN 'capitals' END,
    CASE WHEN 1000 * n_dup_lines > 300 * n_lines THEN 'repeated_lines' END], lambda x: x IS NOT NULL) AS broken FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND len(broken) = 0 AS kept, coalesce(array_to_string(broken, ','), '') AS broken_rules FROM f
"""


OP13 = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({FOLD}, '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i+m-1], ' '))) AS phrase FROM w, (SELECT unnest(range(1, 6)) AS m) WHERE len(w) >= m),
f AS (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
t AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY 1),
c AS (SELECT lang, phrase, m, f AS a, string_split(phrase, ' ') AS x, unnest(range(1, m)) AS k FROM f WHERE m > 1),
s AS (SELECT c.lang, c.phrase, c.a, k, l.f AS l, r.f AS r, n, ((1000::HUGEINT * a * n) // (l.f::HUGEINT * r.f))::BIGINT AS score
      FROM c JOIN t USING (lang) JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(x[1:k], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(x[k+1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
z AS (SELECT b.* FROM b WHERE NOT EXISTS (SELECT 1 FROM f o WHERE o.lang = b.lang AND o.f >= b.a AND o.m > len(string_split(b.phrase, ' ')) AND contains(' ' || o.phrase || ' ', ' ' || b.phrase || ' ')))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM z QUALIFY rank <= 2000
"""


def op11(rounds: int = 4) -> str:
    """Lloyd's rounds over all distances, one common table expression for each assignment and codebook; inner products of doubles are whole numbers here."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT id, p.m, min((list_inner_product(p.x, p.x) - 2 * list_inner_product(p.x, c.x) + list_inner_product(c.x, c.x), c.j)) AS b FROM p JOIN c{r} c ON c.m = p.m GROUP BY id, p.m)""")
        if r < rounds:
            steps.append(f"""c{r + 1} AS MATERIALIZED (
  WITH u AS (SELECT a.m, a.b[2] AS j, k, floor(sum(p.x[k]::HUGEINT) / count(*))::DOUBLE AS v FROM a{r} a JOIN p USING (id, m), (SELECT unnest(range(1, (SELECT width FROM z) + 1)) AS k) GROUP BY 1, 2, 3),
       n AS (SELECT m, j, list(v ORDER BY k) AS x FROM u GROUP BY 1, 2)
  SELECT c.m, c.j, coalesce(n.x, c.x) AS x FROM c{r} c LEFT JOIN n ON n.m = c.m AND n.j = c.j)""")
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS id, vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
z AS (SELECT max(len(x)) // 4 AS width FROM v),
p AS MATERIALIZED (SELECT id, m, x[m * width + 1:(m + 1) * width] AS x FROM v, z, (SELECT unnest(range(0, 4)) AS m)),
c0 AS MATERIALIZED (SELECT m, id AS j, x FROM p WHERE id < 256),
{", ".join(steps)},
f AS (SELECT id, string_agg(printf('%02x', b[2]), '' ORDER BY m) AS code, sum(b[1])::BIGINT AS error FROM a{rounds} GROUP BY id),
h AS (SELECT sha256(string_agg(array_to_string(list_transform(x, lambda y: y::BIGINT), ','), ',' ORDER BY m, j)) AS codebooks_sha256 FROM c{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM v JOIN f USING (id), h
"""
