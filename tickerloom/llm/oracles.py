"""DuckDB twins of the queries that SQL can express."""

OP7 = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT k, doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d),
m AS (
  SELECT k, doc_id, len(words)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (length(t) - length(regexp_replace(t, '\p{Lu}', '', 'g')))::BIGINT AS n_upper,
         len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines
  FROM w),
e AS (SELECT k, unnest(range(1, len(words) - 1)) AS p, words FROM w WHERE len(words) >= 3),
g AS (SELECT k, p, words[p] || ' ' || words[p + 1] || ' ' || words[p + 2] AS gram FROM e),
r AS (SELECT k, p FROM (SELECT k, p, count(*) OVER (PARTITION BY k, gram) AS n FROM g) WHERE n > 1),
c AS (SELECT k, count(DISTINCT p + o)::BIGINT AS n FROM r, (SELECT unnest([0, 1, 2]) AS o) GROUP BY k),
f AS (
  SELECT m.*, coalesce(c.n, 0) AS n_repeat_words FROM m LEFT JOIN c USING (k)),
b AS (
  SELECT *,
    (CASE WHEN n_words < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * n_symbols > 30 * n_words THEN 4 ELSE 0 END) + (CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END)
    + (CASE WHEN 100 * n_upper > 60 * word_chars THEN 16 ELSE 0 END)
    + (CASE WHEN word_chars < 2 * n_words OR word_chars > 40 * n_words THEN 32 ELSE 0 END) AS bits
  FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, bits & 3 <> 0 AS base_failed,
       bits = 0 AS kept, bits::BIGINT AS failed_bits
FROM b
"""

OP1 = r"""
WITH d AS (
  SELECT doc_id, lang, source, coalesce(lang, chr(0)) AS n1, coalesce(source, chr(0)) AS n2,
         'd' || CASE WHEN regexp_extract(coalesce(source, ''), '[0-9]+') = '' THEN 0
                ELSE right(regexp_extract(source, '[0-9]+'), 9)::BIGINT % 4 END AS n0,
         len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS n_tokens
  FROM documents),
leaf AS (SELECT n0, n1, n2, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY ALL),
all_tokens AS (SELECT sum(tokens)::BIGINT AS given FROM leaf),
c0 AS (
  SELECT n0, 2 * sum(tokens)::BIGINT AS cap, CASE n0 WHEN 'd0' THEN 4 WHEN 'd1' THEN 3 WHEN 'd2' THEN 2 ELSE 1 END AS w,
         (SELECT given FROM all_tokens) AS given
  FROM leaf GROUP BY n0),
p0 AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, n0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS bc,
         (sum(w) OVER (ORDER BY cap / w, n0 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS aw FROM c0),
l0 AS (SELECT bc, aw FROM p0 WHERE cap * aw > (given - bc) * w ORDER BY cap / w, n0 LIMIT 1),
b0 AS (
  SELECT p0.n0, CASE WHEN p0.cap * p0.aw > (p0.given - p0.bc) * p0.w
                THEN least(p0.cap, (p0.given - (SELECT bc FROM l0)) * p0.w // (SELECT aw FROM l0)) ELSE p0.cap END AS given
  FROM p0),
c1 AS (
  SELECT n0, n1, 2 * sum(tokens)::BIGINT AS cap, CASE n1 WHEN 'en' THEN 5 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END AS w, given
  FROM leaf JOIN b0 USING (n0) GROUP BY n0, n1, given),
p1 AS (
  SELECT *, coalesce(sum(cap) OVER (PARTITION BY n0 ORDER BY cap / w, n0, n1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS bc,
         (sum(w) OVER (PARTITION BY n0 ORDER BY cap / w, n0, n1 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS aw FROM c1),
l1 AS (SELECT DISTINCT ON (n0) n0, bc AS lbc, aw AS law FROM p1 WHERE cap * aw > (given - bc) * w ORDER BY n0, cap / w, n1),
b1 AS (
  SELECT n0, n1, CASE WHEN cap * aw > (given - bc) * w THEN least(cap, (given - lbc) * w // law) ELSE cap END AS given
  FROM p1 LEFT JOIN l1 USING (n0)),
c2 AS (SELECT n0, n1, n2, tokens, 2 * tokens AS cap, 1 AS w, given FROM leaf JOIN b1 USING (n0, n1)),
p2 AS (
  SELECT *, coalesce(sum(cap) OVER (PARTITION BY n0, n1 ORDER BY cap / w, n0, n1, n2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS bc,
         (sum(w) OVER (PARTITION BY n0, n1 ORDER BY cap / w, n0, n1, n2 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS aw FROM c2),
l2 AS (SELECT DISTINCT ON (n0, n1) n0, n1, bc AS lbc, aw AS law FROM p2 WHERE cap * aw > (given - bc) * w ORDER BY n0, n1, cap / w, n2),
b2 AS (
  SELECT n0, n1, n2, tokens, CASE WHEN cap * aw > (given - bc) * w THEN least(cap, (given - lbc) * w // law) ELSE cap END AS budget
  FROM p2 LEFT JOIN l2 USING (n0, n1)),
e AS (
  SELECT b2.*, epoch, least(tokens, budget - tokens * epoch) AS rest FROM b2, (VALUES (0), (1)) v(epoch)
  WHERE (budget > 0 OR tokens = 0) AND epoch <= CASE WHEN tokens = 0 THEN 0 ELSE (budget - 1) // tokens END),
o AS (
  SELECT doc_id, lang, source, n_tokens, epoch, tokens, budget, rest,
         sum(n_tokens) OVER (PARTITION BY n0, n1, n2, epoch ORDER BY md5('1:' || epoch || ':' || coalesce(doc_id::VARCHAR, chr(0)))
                             RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM d JOIN e USING (n0, n1, n2))
SELECT doc_id, epoch::BIGINT AS epoch, lang, source, n_tokens, tokens AS leaf_tokens, budget::BIGINT AS leaf_budget
FROM o WHERE upto <= rest
"""


def _license_sql():
    from .licenses import BAND, COVERAGE, K, TEMPLATES

    rows = [(i, p, " ".join(t.words[p:p + K]), t.label, t.base, len(t.words), t.told_by)
            for i, t in enumerate(TEMPLATES) for p in range(len(t.words) - K + 1)]
    values = ", ".join(f"({i}, {p}, '{g}', '{label}', {base}, {n}, {told}::INTEGER[])" for i, p, g, label, base, n, told in rows)
    return rf"""
WITH t(tid, tpos, gram, label, base, tw, told) AS (VALUES {values}),
d AS (
  SELECT row_number() OVER () AS k, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
e AS (SELECT k, w, unnest(range(0, len(w) - {K} + 1)) AS pos FROM d),
h AS (
  SELECT k, tid, pos - tpos AS diag, tpos, pos, label, base, tw, told
  FROM (SELECT k, pos, array_to_string(w[pos + 1 : pos + {K}], ' ') AS gram FROM e) JOIN t USING (gram)),
g AS (
  SELECT k, tid, diag, label, base, tw, told, list(tpos) AS places, min(pos) AS lo, max(pos) AS hi,
         count(DISTINCT tpos) = tw - {K - 1} AS exact
  FROM h GROUP BY k, tid, diag, label, base, tw, told),
b AS (
  SELECT k, count(*) AS n_base, min(diag) AS first_word, max(diag) AS last_word,
         array_to_string(list_sort(list_distinct(list(label))), ',') AS base_labels
  FROM g WHERE base AND exact GROUP BY k),
s AS (
  SELECT *, sum(new) OVER (PARTITION BY k, tid ORDER BY diag) AS span FROM (
    SELECT *, CASE WHEN diag - lag(diag) OVER (PARTITION BY k, tid ORDER BY diag) <= {BAND} THEN 0 ELSE 1 END AS new FROM g)),
m AS (
  SELECT k, tid, span, label, tw, min(lo) AS lo, max(hi) + {K} AS hi, bool_or(exact) AS exact,
         list_distinct(flatten(list_transform(flatten(list(places)), lambda p: range(p, p + {K})))) AS words, len(words) AS covered, told
  FROM s GROUP BY k, tid, span, label, tw, told),
o AS (
  SELECT k, coalesce(array_to_string(list_sort(list_distinct(list(label) FILTER (exact OR (covered >= {COVERAGE} * tw AND list_has_all(words, told))))), ','), '') AS labels,
         max(least(1.0::DOUBLE, covered::DOUBLE / greatest(tw, CASE WHEN exact THEN covered ELSE hi - lo END))) AS score
  FROM m GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
       last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN b USING (k) LEFT JOIN o USING (k)
"""


OP10 = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS k, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
e AS (SELECT k, w, unnest(range(1, greatest(len(w) - 3, 2))) AS p FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT k, array_to_string(w[p : p + 4], ' ') AS gram FROM e),
z AS (SELECT k, count(*) AS n FROM s GROUP BY k),
o AS (SELECT a.k AS a, b.k AS b, count(*) AS c FROM s a JOIN s b ON a.gram = b.gram AND a.k <> b.k GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN z x ON x.k = a JOIN z y ON y.k = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r(a, b) AS (SELECT k, k FROM d UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT x.doc_id, coalesce(any_value(z.n), 0)::BIGINT AS n_shingles, min(y.doc_id)::BIGINT AS component_id
FROM r JOIN d x ON x.k = r.a JOIN d y ON y.k = r.b LEFT JOIN z ON z.k = r.a GROUP BY r.a, x.doc_id
"""

OP5 = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
i AS (
  SELECT row_number() OVER () AS j, item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
ig AS (SELECT j, p, least(len(w), 5) AS g, w[p : p + least(len(w), 5) - 1] AS gram, len(w) AS l
       FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS p FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT g FROM ig),
dg AS (SELECT k, g, p, w[p : p + g - 1] AS gram FROM (
       SELECT k, w, g, unnest(range(1, len(w) - g + 2)) AS p FROM d, sizes WHERE len(w) >= g)),
win AS (SELECT DISTINCT k, j, g, l, dg.p - ig.p AS start FROM dg JOIN ig USING (g, gram)),
wg AS (SELECT k, j, start, gram, count(*) AS n FROM win JOIN dg USING (k, g)
       WHERE p > greatest(start, 0) AND p + g - 1 <= start + l GROUP BY ALL),
wt AS (SELECT k, j, start, sum(n) AS n FROM wg GROUP BY ALL),
ic AS (SELECT j, gram, count(*) AS n FROM ig GROUP BY ALL),
it AS (SELECT j, sum(n) AS n FROM ic GROUP BY ALL),
o AS (SELECT k, j, start, sum(least(wg.n, ic.n)) AS shared FROM wg JOIN ic USING (j, gram) GROUP BY ALL),
s AS (SELECT k, j, greatest(start, 0) AS start, shared::DOUBLE / (wt.n + it.n - shared) AS sim
      FROM o JOIN wt USING (k, j, start) JOIN it USING (j) WHERE 100 * shared >= 75 * (wt.n + it.n - shared))
SELECT doc_id, item_id, round(max(sim), 6) AS similarity, arg_max(start, (sim, -start))::BIGINT AS first_word
FROM s JOIN d USING (k) JOIN i USING (j) GROUP BY doc_id, item_id
"""


OP11 = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
total AS (SELECT lang, sum(len(ws))::HUGEINT AS n FROM w GROUP BY lang),
g AS (
  SELECT lang, size, unnest(list_transform(range(1, len(ws) - size + 2), lambda i: array_to_string(ws[i:i + size - 1], ' '))) AS phrase
  FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS size) WHERE len(ws) >= size),
f AS (SELECT lang, size, phrase, count(*)::HUGEINT AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
longer AS (
  SELECT lang, o.phrase, max(i.a) AS around
  FROM f o JOIN f i USING (lang)
  WHERE i.size > o.size AND o.size >= 2 AND contains(' ' || i.phrase || ' ', ' ' || o.phrase || ' ')
  GROUP BY ALL),
kept AS (SELECT f.* FROM f LEFT JOIN longer USING (lang, phrase) WHERE size >= 2 AND (around IS NULL OR 100 * around < 100 * a)),
cut AS (
  SELECT *, string_split(phrase, ' ') AS ws, unnest(range(1, size)) AS k FROM kept),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.a AS l, y.a AS r, n, (1000 * c.a * n) // (x.a * y.a) AS score
  FROM cut c JOIN total USING (lang)
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(ws[1:k], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(ws[k + 1:c.size], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM best)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked WHERE rank <= 2000
"""

ORACLES = {
    "op5_decontamination": OP5, "op10_jaccard_join": OP10, "op1_mixture": OP1, "op6_license_scan": _license_sql(), "op7_rule_ledger": OP7,
    "op11_collocations": OP11,
}
