"""SQL for those corpus queries that SQL can express, written without the operators' shortcuts.

The others need XXH64, a tokenizer, or fitted models, and are tested against brute force, round
trips or held-out labels.
"""

from hintwise.llm import licenses, mixing, quality_rules

BLANK_WORD = r"[^\x20\x09-\x0D]+"
PLAIN_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _lowered(column: str) -> str:
    return f"translate(coalesce({column}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


MIX = f"""
WITH sized AS (
  SELECT doc_id, source, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h,
         len(regexp_extract_all(coalesce(text, ''), '{BLANK_WORD}'))::BIGINT AS size
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighted AS (
  SELECT *, [{', '.join(f'{w}::DOUBLE' for w in mixing.WEIGHTS)}][
    (row_number() OVER (ORDER BY source IS NULL, source) - 1) % {len(mixing.WEIGHTS)} + 1] AS w,
    source_size * {float(mixing.MOST_REPEATS)}::DOUBLE AS cap
  FROM sources
), levels AS (
  SELECT *, row_number() OVER o AS k,
    (sum(source_size) OVER () * {mixing.SHARE}::DOUBLE - coalesce(sum(cap) OVER b, 0))
    / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level
  FROM weighted
  WINDOW o AS (ORDER BY cap / w, source IS NULL, source),
         b AS (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT source, source_size, least(cap, coalesce(
    w * (SELECT arg_min(level, k) FROM levels WHERE w * level <= cap), cap)) AS target
  FROM levels
), plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM targets
), ties AS (
  SELECT source, h, sum(size) AS size FROM sized WHERE size > 0 GROUP BY source, h
), running AS (
  SELECT t.*, sum(t.size) OVER (PARTITION BY t.source ORDER BY h) AS upto, target - whole * source_size AS budget
  FROM ties t JOIN plan p ON t.source IS NOT DISTINCT FROM p.source
), ends AS (
  SELECT source, arg_min(h + CASE WHEN upto - budget <= budget - (upto - size) THEN 1 ELSE 0 END, h) AS threshold
  FROM running WHERE budget > 0 AND upto >= budget GROUP BY source
), cut AS (
  SELECT p.*, CASE WHEN target - whole * source_size > 0 AND source_size > 0
                   THEN coalesce(threshold, {1 << mixing.HASH_BITS}) ELSE 0 END AS threshold
  FROM plan p LEFT JOIN ends e ON p.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, source_size, target,
  (size * (whole + CASE WHEN h < threshold THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sized s JOIN cut c ON s.source IS NOT DISTINCT FROM c.source
"""

_RATIOS = {
    "n_words": "n_words", "repeat_percent": "100 * n_repeat_words / nullif(n_words, 0)",
    "mean_word_chars": "word_chars / nullif(n_words, 0)", "symbol_ratio": "n_symbols / nullif(n_words, 0)",
    "exclamation_ratio": "n_exclamations / nullif(n_words, 0)", "stop_word_ratio": "CASE WHEN 2 * n_foreign <= word_chars THEN n_stop_words / nullif(n_words, 0) END",
    "dup_line_ratio": "n_dup_lines / nullif(n_lines, 0)", "ellipsis_line_ratio": "n_ellipsis_lines / nullif(n_lines, 0)",
}


def _passes(rule: quality_rules.Rule) -> str:
    tests = [f"{_RATIOS[rule.metric]} {sign} {value}" for sign, value in ((">=", rule.least), ("<=", rule.most)) if value is not None]
    return f"coalesce({' AND '.join(tests)}, true)"


RULES = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '{BLANK_WORD}') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{BLANK_WORD}')) AS lines
  FROM documents
), grams AS (
  SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), repeated AS (
  SELECT rid, i FROM grams QUALIFY count(*) OVER (PARTITION BY rid, g) > 1
), covered AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM repeated) GROUP BY rid
), counts AS (
  SELECT doc_id, len(w)::BIGINT AS n_words,
    length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^{quality_rules.SYMBOLS}]', '', 'g'))::BIGINT AS n_symbols,
    length(regexp_replace(t, '[^!?]', '', 'g'))::BIGINT AS n_exclamations,
    len(list_filter(w, lambda x: lower(x) IN ({', '.join(_quoted(w) for ws in quality_rules.STOP_WORDS.values() for w in ws)}))) AS n_stop_words,
    length(regexp_replace(regexp_replace(t, '[\\p{{Latin}}\\p{{Cyrillic}}\\p{{Greek}}]', '', 'g'), '[^\\p{{L}}]', '', 'g')) AS n_foreign,
    len(lines) AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    len(list_filter(lines, lambda x: ends_with(x, '...') OR ends_with(x, '…'))) AS n_ellipsis_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN covered USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  NOT ({' AND '.join(map(_passes, quality_rules.BASE_RULES))}) AS base_failed,
  {' AND '.join(map(_passes, quality_rules.BASE_RULES + quality_rules.RULES))} AS kept
FROM counts
"""


LICENSES = f"""
WITH templates AS (
  SELECT k, license, len(v) AS m, list_distinct(list_transform(range(1, len(v)), lambda i: v[i] || ' ' || v[i + 1])) AS b FROM (
    SELECT *, regexp_extract_all({_lowered('text')}, '{PLAIN_WORD}') AS v
    FROM (VALUES {', '.join(f'({k}, {_quoted(n)}, {_quoted(t)})' for k, (n, t) in enumerate(licenses.TEMPLATES.items()))}) x(k, license, text))
), d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_lowered('text')}, '{PLAIN_WORD}') AS w FROM documents
), grams AS (
  SELECT rid, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS g FROM d
), places AS (
  SELECT rid, unnest(g) AS gram, unnest(range(len(g))) AS i FROM grams
), starts AS (
  SELECT DISTINCT p.rid, k, least(i, greatest(len(g) - m + 1, 0)) AS start
  FROM places p JOIN (SELECT k, m, unnest(b) AS gram FROM templates) t ON p.gram = t.gram JOIN grams ON grams.rid = p.rid
), scored AS (
  SELECT s.rid, k, license, m, start, list_distinct(g[start + 1:start + m - 1]) AS a, b
  FROM starts s JOIN grams USING (rid) JOIN templates USING (k)
), found AS (
  SELECT rid, k, license, m, start, 2.0::DOUBLE * len(list_intersect(a, b)) / (len(a) + len(b)) AS dice
  FROM scored WHERE 2 * len(list_intersect(a, b)) >= {licenses.LEAST} * (len(a) + len(b))
), best AS (
  SELECT * FROM found f WHERE NOT EXISTS (
    SELECT 1 FROM found y WHERE y.rid = f.rid AND y.k = f.k AND abs(y.start - f.start) < f.m
      AND (y.dice > f.dice OR (y.dice = f.dice AND y.start < f.start)))
), listed AS (
  SELECT rid, count(*) AS n, string_agg(license || ':' || start, ',' ORDER BY start, k) AS passages,
    array_to_string(list_sort(list(DISTINCT license)), ',') AS licenses, max(dice) AS best
  FROM best GROUP BY rid
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_matches, coalesce(licenses, '') AS licenses,
  round(coalesce(best, 0.0)::DOUBLE, 6) AS best_dice, coalesce(passages, '') AS passages
FROM d LEFT JOIN listed USING (rid)
"""

DECONTAMINATE = f"""
WITH items AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all({_lowered('text')}, '{PLAIN_WORD}') AS v FROM benchmark
), windows AS (
  SELECT item, array_to_string(v[i:i + 9], ' ') AS phrase, least(len(v), 10) AS n
  FROM (SELECT *, unnest(range(1, greatest(len(v) - 9, 1) + 1)) AS i FROM items WHERE len(v) > 0)
), d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_lowered('text')}, '{PLAIN_WORD}') AS w FROM documents
), starts AS (
  SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS phrase FROM (
    SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM windows))
), hits AS (
  SELECT rid, i, n, item FROM starts JOIN windows USING (phrase, n)
), words AS (
  SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hits) GROUP BY rid
), named AS (
  SELECT rid, list_sort(list(DISTINCT item)) AS items FROM hits GROUP BY rid
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN named USING (rid)
"""

DEDUP = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '{BLANK_WORD}') AS w FROM documents
), starts AS (
  SELECT rid, i, array_to_string(w[i:i + 34], ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 33)) AS i FROM d)
), repeated AS (
  SELECT rid, i FROM starts QUALIFY count(*) OVER (PARTITION BY g) > 1
), gone AS (
  SELECT DISTINCT rid, p FROM (SELECT rid, unnest(range(i, i + 35)) AS p FROM repeated)
), each AS (
  SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d
), kept AS (
  SELECT rid, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n FROM each ANTI JOIN gone USING (rid, p) GROUP BY rid
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)
"""

MINHASH = f"""
WITH RECURSIVE cut AS (
  SELECT doc_id, regexp_extract_all({_lowered('text')}, '{BLANK_WORD}') AS w FROM documents
), shingles AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END)) AS s
  FROM cut
), sized AS (
  SELECT c.doc_id, count(s) AS n FROM cut c LEFT JOIN shingles USING (doc_id) GROUP BY c.doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN sized x ON x.doc_id = a JOIN sized y ON y.doc_id = b
  WHERE 100 * shared.n >= 80 * (x.n + y.n - shared.n)
), reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION
  SELECT r.doc_id, l.other FROM reach r JOIN (
    SELECT a AS doc_id, b AS other FROM links UNION ALL SELECT b, a FROM links) l ON r.other = l.doc_id
)
SELECT doc_id, n::BIGINT AS n_shingles, min(other) AS component_id, doc_id = min(other) AS kept
FROM reach JOIN sized USING (doc_id) GROUP BY doc_id, n
"""

AUDIT = f"""
WITH RECURSIVE orders AS (
  SELECT '' AS o UNION ALL SELECT o || f FROM orders, unnest(['A', 'B', 'C', 'D', 'E']) t(f) WHERE NOT contains(o, f)
), base AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '{BLANK_WORD}') AS w FROM documents
), firsts AS (
  SELECT t, min(doc_id) AS first_id FROM base GROUP BY t
), judged AS (
  SELECT b.doc_id, part, CASE WHEN len(w) < 50 THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * len(regexp_extract_all(b.t, '[A-Z]')) > 5 * length(b.t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(b.t, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN b.doc_id > first_id THEN 'E' ELSE '' END AS failed,
    coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic
  FROM base b JOIN firsts f ON b.t = f.t LEFT JOIN (
    SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id) l ON b.doc_id = l.doc_id
), steps AS (
  SELECT o, k, substr(o, k, 1) AS f FROM orders, range(1, 6) r(k) WHERE length(o) = 5
), seen AS (
  SELECT part, o, k, f, doc_id, good, toxic, contains(failed, f) AS fails, failed = f AS alone,
    length(translate(substr(o, 1, k - 1), failed, '')) < k - 1 AS gone
  FROM judged, steps
), counted AS (
  SELECT part, o, k, f,
    count(*) FILTER (NOT gone AND NOT fails) AS kept, count(*) FILTER (NOT gone AND fails) AS removed,
    count(*) FILTER (gone AND fails) AS redundant, count(*) FILTER (alone) AS unique_fails,
    coalesce(sum(good) FILTER (NOT gone AND fails), 0) AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND fails), 0) AS toxic_lost
  FROM seen GROUP BY ALL
)
SELECT part, o AS filter_order, k::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost::BIGINT AS good_lost,
  toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM counted
"""

ORACLES: dict[str, str] = {
    "op1_mix_sources": MIX,
    "op2_quality_rules": RULES,
    "op4_license_scan": LICENSES,
    "op5_decontaminate": DECONTAMINATE,
    "op8_substring_dedup": DEDUP,
    "op11_minhash_groups": MINHASH,
    "op13_filter_audit": AUDIT,
}
