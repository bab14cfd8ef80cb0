"""The same queries as plain SQL for another engine, written independently of the operators."""

from __future__ import annotations

from hintwise import schemas as S
from hintwise.sources.derived import TEMPLATES

ORACLES: dict[str, str] = {}
BLANKS = "' ' || chr(9) || chr(10) || chr(13)"


def text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def listing(values: list[str]) -> str:
    return "[" + ", ".join(text(v) for v in values) + "]"


def r(expression: str, digits: int = 6) -> str:
    return f"round({expression} + 1e-10, {digits}) + 0.0"


def words(column: str) -> str:
    return rf"regexp_extract_all(lower({column}), '[\p{{L}}\p{{N}}]+')"


def hashed(expression: str) -> str:
    return f"('0x' || substr(md5({expression}), 1, 8))::BIGINT"


def joined(column: str, by: str = ",") -> str:
    return f"array_to_string({column}, '{by}')"


def with_(ctes: list[str], select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


# --- query log -------------------------------------------------------------------------------

_questions = " ".join(f"WHEN {i} THEN {text(q)}" for i, (q, _) in enumerate(TEMPLATES))
_statements = " ".join(f"WHEN {i} THEN {text(s)}" for i, (_, s) in enumerate(TEMPLATES))

RAW = f"""raw AS (
  SELECT k AS query_id,
    CASE WHEN k % 11 = 3 THEN NULL
         WHEN k % 7 = 0 THEN ' ' || q || chr(9)
         WHEN k % 13 = 5 THEN 'x prompt: ' || q || ' prompt: again schema: s'
         ELSE 'x prompt: ' || chr(10) || q || '  schema: t (a, b)' END AS structured_input,
    CASE WHEN k % 3 = 0 THEN lower(s) ELSE s END AS sql
  FROM (SELECT o_orderkey AS k,
          replace(CASE o_orderkey % {len(TEMPLATES)} {_questions} END, '{{k}}', o_custkey::VARCHAR) AS q,
          replace(CASE o_orderkey % {len(TEMPLATES)} {_statements} END, '{{k}}', o_custkey::VARCHAR) AS s
        FROM orders))"""

LOG = f"""log AS (
  SELECT query_id, sql, CASE WHEN structured_input IS NULL THEN '' ELSE
    trim(split_part(CASE WHEN contains(structured_input, 'prompt:')
      THEN split_part(structured_input, 'prompt:', 2) ELSE structured_input END, 'schema:', 1), {BLANKS}) END
    AS instruction FROM raw)"""

STRICT = f"""strict AS (
  SELECT * FROM (SELECT query_id, sql, trim(split_part(split_part(structured_input, 'prompt:', 2), 'schema:', 1),
    {BLANKS}) AS instruction FROM raw WHERE contains(structured_input, 'prompt:')) WHERE instruction <> '')"""

_found = ", ".join(
    "CASE WHEN regexp_matches(u, '\\bSUBQUERY\\b') OR (contains(sql, '(') AND n_select > 1) THEN 'SUBQUERY' END"
    if k == "SUBQUERY" else f"CASE WHEN regexp_matches(u, '\\b{k}\\b') THEN '{k}' END"
    for k in S.SQL_KEYWORDS
)


def _any(*ks: str) -> str:
    return f"list_has_any(keywords, {listing(list(ks))})"


_complex = " + ".join(f"({c})::INT" for c in [
    _any("SUBQUERY"), _any("UNION", "INTERSECT", "EXCEPT"), "n_join >= 2", "n_select > 1",
    _any("CASE"), _any("HAVING"), "contains(u, 'OVER(') OR contains(u, 'OVER (')",
])
_medium = " + ".join(f"({c})::INT" for c in [
    _any("JOIN", "INNER JOIN", "LEFT JOIN", "RIGHT JOIN"), _any("GROUP BY"),
    _any("COUNT", "SUM", "AVG", "MAX", "MIN"), _any("ORDER BY"), "len(keywords) > 5",
])
_tags = ", ".join(f"CASE WHEN {c} THEN '{t}' END" for t, c in [
    ("Read", "starts_with(t, 'SELECT')"),
    ("Write", "regexp_matches(t, '^(INSERT|UPDATE|DELETE)')"),
    ("Aggregation", _any("COUNT", "SUM", "AVG", "MAX", "MIN")),
    ("Filtering", _any("WHERE")),
    ("Sorting", _any("ORDER BY")),
    ("Joining", _any("JOIN", "INNER JOIN", "LEFT JOIN", "RIGHT JOIN")),
    ("Grouping", _any("GROUP BY")),
    ("Limiting", _any("LIMIT", "OFFSET", "DISTINCT")),
    ("Subquery", _any("SUBQUERY")),
    ("Windowing", "contains(u, 'OVER(') OR contains(u, 'OVER (') OR contains(u, 'PARTITION BY')"),
    ("Set Logic", _any("UNION", "INTERSECT", "EXCEPT")),
    ("Object DDL", _any("CREATE", "ALTER", "DROP")),
])

LABELLED = f"""upped AS (
  SELECT *, upper(sql) AS u, trim(upper(sql), {BLANKS}) AS t,
    (length(upper(sql)) - length(replace(upper(sql), 'SELECT', ''))) // 6 AS n_select,
    (length(upper(sql)) - length(replace(upper(sql), 'JOIN', ''))) // 4 AS n_join,
    coalesce(len(regexp_extract_all(upper(sql), '\\bJOIN\\b')), 0) AS n_join_word
  FROM log),
keyed AS (SELECT *, list_filter([{_found}], lambda x: x IS NOT NULL) AS keywords FROM upped),
tagged AS (SELECT *, list_filter([{_tags}], lambda x: x IS NOT NULL) AS tags FROM keyed),
labelled AS (
  SELECT query_id, instruction, sql, keywords,
    CASE WHEN sql IS NULL THEN 'simple' WHEN {_complex} >= 2 THEN 'complex'
         WHEN {_medium} >= 2 THEN 'medium' ELSE 'simple' END AS complexity,
    CASE WHEN sql IS NULL THEN 'Data Manipulation'
         WHEN regexp_matches(t, '^(CREATE|ALTER|DROP|TRUNCATE)') THEN 'Schema Definition'
         WHEN regexp_matches(t, '^(GRANT|REVOKE)') THEN 'Security'
         WHEN regexp_matches(t, '^(BEGIN|COMMIT|ROLLBACK)') THEN 'Transaction Control'
         WHEN contains(u, 'UNION') OR contains(u, 'INTERSECT') OR contains(u, 'EXCEPT') THEN 'Set Operations'
         ELSE 'Data Manipulation' END AS category,
    CASE WHEN len(tags) = 0 THEN ['Read'] ELSE tags END AS subcategories,
    CASE WHEN n_join_word = 0 THEN '1' WHEN n_join_word = 1 THEN '2' ELSE '3+' END AS table_count
  FROM tagged)"""

LOG_LABELLED = [RAW, LOG, LABELLED]


def _names(source: str) -> str:
    scans = " || ".join(
        rf"regexp_extract_all({source}, '(?i)\b{w}\s+([a-zA-Z_][a-zA-Z0-9_]*)', 1)"
        for w in ("FROM", "JOIN", "INTO", "UPDATE")
    )
    return (
        f"CASE WHEN {source} IS NULL THEN [] ELSE list_sort(list_distinct(list_filter("
        f"list_transform({scans}, lambda x: lower(x)), lambda x: NOT list_contains({listing(S.NOT_TABLE_NAMES)}, x)))) END"
    )


TABLES = f"""tabled AS (SELECT query_id, instruction, {_names('sql')} AS tables FROM strict),
table_log AS (SELECT * FROM tabled WHERE len(tables) > 0)"""
TABLE_LOG = [RAW, STRICT, TABLES]

ORACLES["read_query_log"] = with_([RAW, LOG], "SELECT query_id, instruction, sql FROM log")
for _c, _question in (("read_query_log_csv", "instruction"), ("read_plain_log_csv", "nullif(instruction, '')")):  # an empty cell is null
    ORACLES[_c] = with_([RAW, LOG], f"SELECT {_question} AS instruction, sql, count(*) AS n, count(*) AS n_keys FROM log GROUP BY ALL")
ORACLES["read_ranking_corpus"] = with_([RAW, STRICT], "SELECT query_id, instruction, sql FROM strict")
ORACLES["extract_prompt"] = with_([RAW, LOG], "SELECT query_id, instruction FROM log")
ORACLES["extract_prompt_strict"] = with_([RAW, STRICT], "SELECT query_id, instruction FROM strict")
ORACLES["drop_unlabelled"] = with_(
    TABLE_LOG, f"SELECT query_id, instruction, {joined('tables')} AS tables FROM table_log"
)
ORACLES["sql_keywords"] = with_(LOG_LABELLED, f"SELECT query_id, {joined('keywords')} AS keywords FROM labelled")
for _c in ("complexity", "category", "table_count"):
    ORACLES[f"sql_{_c}"] = with_(LOG_LABELLED, f"SELECT query_id, {_c} FROM labelled")
ORACLES["sql_subcategories"] = with_(
    LOG_LABELLED, f"SELECT query_id, {joined('subcategories')} AS subcategories FROM labelled"
)
ORACLES["referenced_tables"] = with_(
    [RAW, LOG], f"SELECT query_id, {joined(_names('sql'))} AS tables FROM log"
)
ORACLES["label_query_log"] = with_(LOG_LABELLED, f"""
SELECT query_id, instruction, {joined('keywords')} AS keywords, complexity, category,
  {joined('subcategories')} AS subcategories, table_count FROM labelled""")
ORACLES["validate_requests"] = with_([RAW, LOG], f"""
SELECT query_id, instruction AS query,
  CASE WHEN trim(instruction, {BLANKS}) = '' THEN 'blank_query'
       WHEN len({_names('sql')}) = 0 THEN 'no_tables' END AS reason FROM log""")


def bucket(key: str) -> str:
    return f"{hashed(f'concat(42, chr(58), {key})')} % 1000"


def split(key: str) -> str:
    return f"CASE WHEN {bucket(key)} < 700 THEN 'train' WHEN {bucket(key)} < 800 THEN 'val' ELSE 'test' END"


ORACLES["write_labelled"] = with_(LOG_LABELLED, f"""
SELECT query_id, complexity, {joined('keywords')} AS keywords, {split('query_id')} AS split FROM labelled""")
ORACLES["split_train_val_test"] = f"SELECT o_orderkey AS query_id, {split('o_orderkey')} AS split FROM orders"
ORACLES["split_report"] = f"""
SELECT split, count(*) AS rows, {r('count(*) / sum(count(*)) OVER ()')} AS share
FROM (SELECT {split('o_orderkey')} AS split FROM orders) GROUP BY split"""
ORACLES["sample_n"] = with_([RAW], """
SELECT query_id, sql FROM raw ORDER BY md5(concat(42, chr(58), query_id)), query_id LIMIT 10000""")

DICT = """dict AS (
  SELECT head, label, (row_number() OVER (PARTITION BY head ORDER BY label) - 1)::INT AS idx FROM (
    SELECT DISTINCT 'complexity' AS head, complexity AS label FROM labelled UNION ALL
    SELECT DISTINCT 'category', category FROM labelled UNION ALL
    SELECT DISTINCT 'table_count', table_count FROM labelled))"""
ORACLES["write_label_dict"] = with_([*LOG_LABELLED, DICT], "SELECT head, idx, label FROM dict")
ORACLES["label_info"] = with_([*LOG_LABELLED, DICT], """
SELECT head, string_agg(label, '|' ORDER BY idx) AS labels FROM dict GROUP BY head""")
ORACLES["index_labels"] = with_([*LOG_LABELLED, DICT], """
SELECT query_id, a.idx AS complexity_idx, b.idx AS category_idx, c.idx AS table_count_idx FROM labelled
JOIN dict a ON a.head = 'complexity' AND a.label = complexity
JOIN dict b ON b.head = 'category' AND b.label = category
JOIN dict c ON c.head = 'table_count' AND c.label = table_count""")


def bits(tags: str, classes: list[str]) -> str:
    return f"list_transform({listing(classes)}, lambda c: list_contains({tags}, c)::INT)"


ORACLES["multi_hot"] = with_(LOG_LABELLED, f"""
SELECT query_id, array_to_string({bits('keywords', S.SQL_KEYWORDS)}, '') AS keywords,
  array_to_string({bits('subcategories', S.SUBCATEGORIES)}, '') AS subcategories FROM labelled""")
ORACLES["decode_multi_hot"] = with_(
    LOG_LABELLED, f"SELECT query_id, {joined('keywords', '|')} AS keywords FROM labelled"
)
ORACLES["label_shapes"] = with_([*LOG_LABELLED, DICT], f"""
SELECT head, (SELECT count(*) FROM labelled) AS rows, count(*) AS classes FROM dict GROUP BY head
UNION ALL SELECT 'keywords', (SELECT count(*) FROM labelled), {len(S.SQL_KEYWORDS)}::BIGINT
UNION ALL SELECT 'subcategory', (SELECT count(*) FROM labelled), {len(S.SUBCATEGORIES)}::BIGINT""")
ORACLES["value_counts"] = with_(LOG_LABELLED, """
SELECT 'complexity' AS feature, complexity AS value, count(*) AS n FROM labelled GROUP BY complexity
UNION ALL SELECT 'category', category, count(*) FROM labelled GROUP BY category
UNION ALL SELECT 'table_count', table_count, count(*) FROM labelled GROUP BY table_count""")
ORACLES["top_keywords"] = with_(LOG_LABELLED, """
SELECT keyword, count(*) AS n FROM (SELECT unnest(keywords) AS keyword FROM labelled)
GROUP BY keyword ORDER BY n DESC, keyword LIMIT 10""")
ORACLES["table_vocabulary"] = with_(
    TABLE_LOG, 'SELECT DISTINCT unnest(tables) AS "table" FROM table_log'
)
ORACLES["ranking_corpus_stats"] = with_([*TABLE_LOG, """
v AS (SELECT DISTINCT unnest(tables) AS t FROM table_log)"""], """
SELECT (SELECT count(*) FROM table_log) AS queries, (SELECT count(*) FROM v) AS tables,
  (SELECT string_agg(t, ',' ORDER BY t) FROM (SELECT t FROM v ORDER BY t LIMIT 10)) AS first_tables""")

# --- question/table/SQL corpus -----------------------------------------------------------------

_header = (
    "{'header': array(['order key', 'part key', 'quantity', 'price', 'flag', 'x'], dtype=object), 'id': 't'}"
)
QA = f"""qa AS (
  SELECT concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey, '-', epoch(l_shipdate)::BIGINT // 86400) AS row_id,
    CASE WHEN l_partkey % 50 = 1 THEN ' ab  '
         ELSE ' which part key has quantity ' || l_quantity::INT || ' ' END AS question,
    CASE WHEN l_partkey % 50 = 2 THEN '{{''name'': ''none''}}' ELSE {text(_header)} END AS "table",
    '{{''sel'': ' || (l_linenumber % 7) || ', ''conds'': {{''column_index'': array([' ||
      CASE l_partkey % 10 WHEN 3 THEN '' WHEN 7 THEN '1., 2'
        ELSE concat(l_partkey % 5, ', ', l_suppkey % 5) END || '])}}}}' AS sql
  FROM lineitem)"""
PARSED = f"""cut AS (
  SELECT row_id, trim(question, {BLANKS}) AS question,
    list_filter(regexp_extract_all(regexp_extract("table", '(?s)header'':\\s*array\\(\\[(.*?)\\], dtype', 1),
      '''([^'']+)''', 1), lambda h: length(h) > 1 AND length(h) < 50 AND NOT starts_with(h, ':')) AS headers,
    TRY_CAST(regexp_extract(sql, '''sel'':\\s*(\\d+)', 1) AS BIGINT) AS sel,
    list_filter(list_transform(str_split(regexp_extract(sql, '''column_index'':\\s*array\\(\\[([^\\]]*)\\]', 1), ','),
      lambda x: trim(x, {BLANKS})), lambda x: x <> '') AS pieces
  FROM qa),
cond AS (
  SELECT *, CASE WHEN len(list_filter(pieces, lambda x: NOT regexp_full_match(x, '-?\\d+'))) > 0 THEN []::BIGINT[]
    ELSE list_transform(pieces, lambda x: TRY_CAST(x AS BIGINT)) END AS conds FROM cut),
parsed AS (
  SELECT *, list_sort(list_distinct(list_filter(list_concat([sel], conds),
    lambda i: i >= 0 AND i < len(headers)))) AS relevant FROM cond),
asked AS (SELECT * FROM parsed WHERE length(question) >= 5),
usable AS (SELECT * FROM asked WHERE len(headers) >= 2 AND sel IS NOT NULL AND len(relevant) > 0)"""
PAIRS = f"""spread AS (
  SELECT row_id, question, headers, relevant, unnest(range(len(headers))) AS pos FROM usable),
numbered AS (
  SELECT *, list_contains(relevant, pos) AS hit, row_number() OVER (
    PARTITION BY row_id, list_contains(relevant, pos) ORDER BY md5(concat(42, chr(58), row_id, chr(58), pos)), pos) AS n
  FROM spread),
pairs AS (
  SELECT row_id, question, headers[pos + 1] AS header, pos::INT AS header_pos, hit::INT::DOUBLE AS label
  FROM numbered WHERE hit OR n <= 2 * len(relevant))"""

ORACLES["read_qa_corpus"] = with_([QA], f"""
SELECT row_id, question, "table", sql, {split('row_id')} AS split FROM qa""")
ORACLES["filter_questions"] = with_([QA, PARSED], "SELECT row_id, question FROM asked")
ORACLES["extract_headers"] = with_([QA, PARSED], f"SELECT row_id, {joined('headers')} AS headers FROM parsed")
ORACLES["extract_sql_columns"] = with_(
    [QA, PARSED], f"SELECT row_id, sel, {joined('conds')} AS conds FROM parsed"
)
ORACLES["relevant_indices"] = with_([QA, PARSED], f"SELECT row_id, {joined('relevant')} AS relevant FROM asked")
ORACLES["usable_qa_rows"] = with_(
    [QA, PARSED], f"SELECT row_id, question, sel, {joined('relevant')} AS relevant FROM usable"
)
ORACLES["column_pairs"] = with_([QA, PARSED, PAIRS], "SELECT * FROM pairs")
ORACLES["pair_balance"] = with_([QA, PARSED, PAIRS], """
SELECT count(*) FILTER (label > 0.5) AS positive, count(*) FILTER (NOT label > 0.5) AS negative FROM pairs""")
ORACLES["head_subset"] = with_([QA, PARSED, PAIRS], """
SELECT row_id, header, label FROM (SELECT * FROM pairs ORDER BY row_id, header_pos LIMIT 5000)""")

# --- catalogs ----------------------------------------------------------------------------------

ORACLES["parse_catalog_list"] = f"""
WITH l AS (
  SELECT l_orderkey AS k, list_sort(list(DISTINCT ' part_' || l_partkey)) AS names FROM lineitem GROUP BY l_orderkey),
d AS (SELECT k AS query_id, CASE WHEN k % 2 = 0 THEN array_to_string(names, ' (a, b)|') || '| |'
        ELSE ',' || array_to_string(names, ' ,') END AS listed FROM l),
e AS (SELECT query_id, list_filter(list_transform(
        str_split(listed, CASE WHEN contains(listed, '|') THEN '|' ELSE ',' END),
        lambda x: trim(x, {BLANKS})), lambda x: x <> '') AS entries FROM d)
SELECT query_id, unnest(range(len(entries)))::INT AS entry_pos, unnest(entries) AS "table" FROM e"""
ORACLES["catalog_docs"] = """
SELECT 'customer_' || c_custkey AS "table",
  'customer_' || c_custkey || coalesce(' - ' || n || ' orders', '') AS doc
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey"""
ORACLES["catalog_docs_with_columns"] = """
SELECT 'order_' || l_orderkey AS "table", 'order_' || l_orderkey || ' (' ||
  string_agg('part_' || l_partkey, ', ' ORDER BY l_linenumber, 'part_' || l_partkey) || ')' AS doc
FROM lineitem GROUP BY l_orderkey"""
_part_doc = "replace(p_name, ' ', '_') || '_' || p_partkey || ' (id, size, ' || lower(p_type) || ')'"
ORACLES["catalog_name"] = f"SELECT doc, split_part(doc, ' ', 1) AS name FROM (SELECT {_part_doc} AS doc FROM part)"
ORACLES["expand_catalog"] = f"""
WITH p AS (SELECT '' AS prefix UNION ALL SELECT 'region' || i || '_' FROM range(1, 6) t(i))
SELECT prefix || {_part_doc} AS doc FROM part, p
UNION ALL SELECT format('sheet_{{:05d}} (row, column, value)', i) FROM range((SELECT count(*) FROM supplier)) t(i)"""

# --- negatives ---------------------------------------------------------------------------------


def negatives(queries: str, key: str = "query_id", vocabulary: str | None = None) -> list[str]:
    """Vocabulary positions, five draws without replacement, and the table of each draw."""
    ctes = [
        f"vocab AS (SELECT t, row_number() OVER (ORDER BY substr(md5(t), 1, 3), t) - 1 AS position "
        f"FROM ({vocabulary or f'SELECT DISTINCT unnest(tables) AS t FROM {queries}'}))",
        f"d0 AS (SELECT {key}, tables, (SELECT count(*) FROM vocab) - len(list_distinct(tables)) AS m, "
        f"[]::BIGINT[] AS draws FROM {queries})",
    ]
    for i in range(5):
        pick = f"{hashed(f'concat(42, chr(58), {key}, chr(58), {i})')} % (m - {4 - i})"
        ctes.append(
            f"d{i + 1} AS (SELECT {key}, tables, m, list_append(draws, CASE WHEN list_contains(draws, {pick}) "
            f"THEN m - {5 - i} ELSE {pick} END) AS draws FROM d{i})"
        )
    ctes.append(
        f"free AS (SELECT {key}, t, draws, row_number() OVER (PARTITION BY {key} ORDER BY position) - 1 AS place "
        f"FROM d5, vocab WHERE NOT list_contains(tables, t))"
    )
    ctes.append(
        f"negative AS (SELECT {key}, t, list_position(draws, place) AS turn FROM free WHERE list_contains(draws, place))"
    )
    return ctes


ORACLES["table_negatives"] = with_(
    [*TABLE_LOG, *negatives("table_log")], "SELECT query_id, t AS negative FROM negative"
)
PART_LISTS = """parts AS (
  SELECT 'catalog.part_' || lpad(p_partkey::VARCHAR, 9, '0') || '_' || replace(p_name, ' ', '_') AS t, p_partkey FROM part),
part_lists AS (
  SELECT c_custkey AS query_id, CASE WHEN c_custkey % 10 <> 0 THEN list_sort(list(DISTINCT t)) END AS tables
  FROM (SELECT c_custkey, unnest([c_custkey, c_custkey * 7 + 3, c_custkey * 31 + 11]) % (SELECT count(*) FROM part) + 1 AS p_partkey
        FROM customer) JOIN parts USING (p_partkey) GROUP BY c_custkey),
listed_parts AS (SELECT * FROM part_lists WHERE tables IS NOT NULL)"""
_large = [PART_LISTS, *negatives("listed_parts", vocabulary="SELECT DISTINCT t FROM parts")]
ORACLES["table_negatives_large"] = with_(_large, "SELECT query_id, t AS negative FROM negative")
ORACLES["ranking_triplets_large"] = with_(_large, """
SELECT l.query_id, list_min(any_value(tables)) AS positive, coalesce(string_agg(t, ',' ORDER BY turn), '') AS negatives
FROM part_lists l LEFT JOIN negative n ON n.query_id = l.query_id GROUP BY l.query_id""")
ORACLES["first_positive"] = with_(TABLE_LOG, "SELECT query_id, list_min(tables) AS positive FROM table_log")
ORACLES["ranking_triplets"] = with_([*TABLE_LOG, *negatives("table_log")], """
SELECT l.query_id, any_value(instruction) AS instruction, any_value(list_min(tables)) AS positive,
  string_agg(t, ',' ORDER BY turn) AS negatives
FROM table_log l JOIN negative n ON n.query_id = l.query_id GROUP BY l.query_id""")

# --- vector ranking ----------------------------------------------------------------------------

VECTORS = """q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS vec, label FROM embeddings),
dims AS (SELECT query_id, label, unnest(range(64)) AS i, unnest(vec) AS x FROM q),
cat AS (SELECT 'label_' || label AS "table", list(x ORDER BY i) AS vec
        FROM (SELECT label, i, avg(x) AS x FROM dims GROUP BY label, i) GROUP BY label)"""


def cosine(a: str, b: str) -> str:
    return f"round(coalesce(list_dot_product({a}, {b}) / nullif(sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})), 0), 0), 9)"


SCORES = f"""scores AS (SELECT query_id, c."table", {cosine('q.vec', 'c.vec')} AS score FROM q, cat c),
ranked AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, "table"))::INT AS rank FROM scores),
hints AS (SELECT * FROM ranked WHERE rank <= 5 AND score >= 0.05)"""
RANKED = [VECTORS, SCORES]
_score = r("score")

ORACLES["cosine_scores"] = with_(RANKED, f'SELECT query_id, "table", {_score} AS score FROM scores')
ORACLES["scaled_scores"] = with_(RANKED, f'SELECT query_id, "table", {r("(score + 1) / 2")} AS score FROM scores')
_listed = """listed AS (SELECT query_id, 'label_' || unnest([label, (label + 1) % 10, 99]) AS "table" FROM (SELECT vec_id AS query_id, label FROM embeddings))"""
ORACLES["cosine_scores_listed"] = with_([*RANKED, _listed], f"""
SELECT query_id, "table", {_score} AS score FROM listed LEFT JOIN scores USING (query_id, "table")""")
ORACLES["scaled_scores_listed"] = with_([*RANKED, _listed], f"""
SELECT query_id, "table", {r("(score + 1) / 2")} AS score FROM listed LEFT JOIN scores USING (query_id, "table")""")
ORACLES["l2_normalize"] = with_([VECTORS], f"""
SELECT query_id, i::INT AS pos, {r('x / greatest(sqrt(sum(x * x) OVER (PARTITION BY query_id)), 1e-12)')} AS x FROM dims""")
ORACLES["rank_top_k"] = with_(RANKED, f'SELECT query_id, rank, "table", {_score} AS score FROM hints')
ORACLES["rank_all"] = with_(RANKED, f'SELECT query_id, rank, "table", {_score} AS score FROM ranked')
ORACLES["rank_columns"] = f"""
WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS vec, label FROM embeddings),
dims AS (SELECT query_id, label, unnest(range(64)) AS i, unnest(vec) AS x FROM q),
cat AS (SELECT 'mart.label_' || label AS "table", 'c.' || c AS "column", list(x ORDER BY i) AS vec
  FROM (SELECT label, query_id % 4 AS c, i, avg(x) AS x FROM dims GROUP BY ALL) GROUP BY label, c),
s AS (SELECT query_id, "table", "column", {cosine('q.vec', 'c.vec')} AS score FROM q, cat c),
k AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, "table", "column"))::INT AS rank FROM s)
SELECT query_id, rank, "table", "column", {_score} AS score FROM k WHERE rank <= 5 AND score >= 0"""

ORACLES["hint_names"] = with_(RANKED, """
SELECT query_id, string_agg("table", ',' ORDER BY rank) AS tables FROM hints GROUP BY query_id""")
ORACLES["hint_scores"] = with_(RANKED, f'SELECT query_id, "table", {_score} AS score FROM hints')
ORACLES["hints_top"] = with_(RANKED, f'SELECT query_id, rank, "table", {_score} AS score FROM hints WHERE rank <= 2')
ORACLES["hints_above"] = with_(RANKED, f'SELECT query_id, rank, "table", {_score} AS score FROM hints WHERE score >= 0.2')
BOOST = """CASE WHEN max(score) OVER (PARTITION BY query_id) > 0
  THEN 1.0::DOUBLE + score / max(score) OVER (PARTITION BY query_id) ELSE 1.0::DOUBLE END"""
ORACLES["hints_boost"] = with_(RANKED, f'SELECT query_id, "table", {r(BOOST)} AS boost FROM (SELECT * FROM ranked WHERE rank <= 5 AND score >= 0)')
ORACLES["hints_filter_record"] = with_(RANKED, """
SELECT query_id, 'question ' || query_id AS query, min_by("table", rank) AS first_table, count(*) AS n
FROM hints GROUP BY query_id""")
ORACLES["hints_count"] = with_(RANKED, "SELECT query_id, count(*) AS n FROM hints GROUP BY query_id")
ORACLES["apply_hints"] = with_([*RANKED, f"""
boosts AS (SELECT query_id, "table", {BOOST} AS boost FROM hints),
found AS (SELECT l_partkey % (SELECT count(*) FROM embeddings) AS query_id,
    'label_' || ((l_suppkey + l_linenumber) % 10) AS "table", l_quantity AS relevance FROM lineitem)"""], f"""
SELECT query_id, "table", count(*) AS items, {r('sum(relevance * coalesce(boost, 1))', 4)} AS relevance,
  max((boost IS NOT NULL)::INT) AS hinted
FROM found LEFT JOIN boosts USING (query_id, "table") GROUP BY query_id, "table" """)

# --- text ranking ------------------------------------------------------------------------------


def text_ranking(questions: str, catalog: str, k: int | None) -> list[str]:
    """``text_hints(query_id, rank, table, score)`` from relations (query_id, text) and (table, doc)."""
    return [
        f"""ct AS (SELECT "table", tok, count(*) AS n FROM (SELECT "table", unnest({words('doc')}) AS tok FROM {catalog}) GROUP BY ALL),
idf AS (SELECT tok, count(*) AS df, ln(((SELECT count(*) FROM {catalog}) + 1) / (count(*) + 1)) + 1 AS idf FROM ct GROUP BY tok),
cw AS (SELECT "table", tok, n * idf AS w FROM ct JOIN idf USING (tok)),
cn AS (SELECT "table", sqrt(sum(w * w)) AS norm FROM cw GROUP BY "table"),
qt AS (SELECT query_id, tok, count(*) AS n FROM (SELECT query_id, unnest({words('text')}) AS tok FROM {questions}) GROUP BY ALL),
qw AS (SELECT query_id, tok, n * idf AS w FROM qt JOIN idf USING (tok)),
qn AS (SELECT query_id, sqrt(sum(w * w)) AS norm FROM qw GROUP BY query_id),
dots AS (SELECT query_id, "table", sum(qw.w * cw.w) AS dot FROM qw JOIN cw USING (tok) GROUP BY ALL),
text_scores AS (
  SELECT a.query_id, b."table", round(coalesce(dot / (qn.norm * cn.norm), 0), 9) AS score
  FROM (SELECT query_id FROM {questions}) a CROSS JOIN (SELECT "table" FROM {catalog}) b
  LEFT JOIN dots ON dots.query_id = a.query_id AND dots."table" = b."table"
  LEFT JOIN qn ON qn.query_id = a.query_id LEFT JOIN cn ON cn."table" = b."table"),
text_hints AS (SELECT * FROM (
  SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, "table"))::INT AS rank FROM text_scores)
  {'' if k is None else f'WHERE rank <= {k}'})"""
    ]


DOCS = """docs AS (SELECT 'doc_' || doc_id AS "table", text AS doc FROM documents),
bench AS (SELECT item_id AS query_id, text FROM benchmark)"""
ORACLES["rank_by_text"] = with_(
    [DOCS, *text_ranking("bench", "docs", 5)], f'SELECT query_id, rank, "table", {_score} AS score FROM text_hints'
)
ORACLES["rank_by_text_large"] = with_([f"""grown AS (
  SELECT prefix || {_part_doc} AS doc
  FROM part, (SELECT '' AS prefix UNION ALL SELECT 'region' || i || '_' FROM range(1, 6) t(i))),
named AS (SELECT split_part(doc, ' ', 1) AS "table", doc FROM grown),
asked AS (SELECT p_partkey AS query_id, p_name || ' ' || p_type AS text FROM part)""",
    *text_ranking("asked", "named", 5)], f'SELECT query_id, rank, "table", {_score} AS score FROM text_hints')
_large = f"""
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings),
c AS (SELECT 'part_' || p_partkey AS "table", list_append(v, p_size / 50.0::DOUBLE) AS vec
      FROM part JOIN e ON vec_id = p_partkey % (SELECT count(*) FROM embeddings)),
q AS (SELECT vec_id AS query_id, list_append(v, label / 10.0::DOUBLE) AS vec FROM e),
s AS (SELECT query_id, "table", {cosine('q.vec', 'c.vec')} AS score FROM q, c),
k AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, "table"))::INT AS rank FROM s)
SELECT query_id, rank, "table", {_score} AS score FROM k"""
ORACLES["rank_top_k_large"] = f"{_large} WHERE rank <= 5 AND score >= 0"
ORACLES["rank_all_large"] = f"{_large} WHERE query_id % 20 = 0"
ORACLES["token_document_frequency"] = f"""
WITH t AS (SELECT DISTINCT doc_id, unnest({words('text')}) AS token FROM documents)
SELECT token, count(*) AS df, {r('ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1)) + 1')} AS idf FROM t GROUP BY token"""
ORACLES["document_frequency_upkeep"] = f"""
WITH held AS (SELECT * FROM documents WHERE doc_id % 3 != 0), t AS (SELECT DISTINCT doc_id, unnest({words('text')}) AS token FROM held)
SELECT token, count(*) AS df, {r('ln(((SELECT count(*) FROM held) + 1) / (count(*) + 1)) + 1')} AS idf FROM t GROUP BY token"""
ORACLES["tokens"] = f"""
WITH t AS (SELECT conv_id, unnest({words('text')}) AS token, unnest(range(len({words('text')})))::INT AS pos FROM conversations)
SELECT conv_id, token, count(*) AS n, min(pos) AS first_pos FROM t GROUP BY conv_id, token"""
ORACLES["embed_with"] = f"""
WITH t AS (SELECT doc_id, unnest({words('text')}) AS w FROM documents),
c AS (SELECT doc_id, {hashed('w')} % 16 AS pos, count(*) AS n FROM t GROUP BY ALL)
SELECT 'doc_' || d.doc_id AS "table", p::INT AS pos, coalesce(n, 0)::DOUBLE AS x
FROM documents d CROSS JOIN range(16) g(p) LEFT JOIN c ON c.doc_id = d.doc_id AND c.pos = p"""

# --- decoding ----------------------------------------------------------------------------------

SCORED = f"""scored AS (
  SELECT vec_id AS query_id, v[1:3] AS complexity, v[4:9] AS category, v[10:12] AS table_count,
    v[1:{len(S.SQL_KEYWORDS)}] AS keywords, v[47:{46 + len(S.SUBCATEGORIES)}] AS subcategory,
    label % 3 AS complexity_true, label % 6 AS category_true, (label + 1) % 3 AS table_count_true,
    list_filter({listing(S.SQL_KEYWORDS)}, lambda c, i: (label + i - 1) % 5 = 0) AS keywords_true,
    list_filter({listing(S.SUBCATEGORIES)}, lambda c, i: (label + i - 1) % 5 = 0) AS subcategory_true
  FROM (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings))"""


def best(column: str) -> str:
    return f"(list_position({column}, list_max({column})) - 1)::INT"


def confidence(column: str) -> str:
    return f"1 / list_sum(list_transform({column}, lambda x: exp(x - list_max({column}))))"


def passing(column: str, classes: list[str], threshold: float = 0.5) -> str:
    return f"list_filter({listing(classes)}, lambda c, i: 1 / (1 + exp(-{column}[i])) > {threshold})"


def fallback(column: str, threshold: float = 0.5) -> str:
    tags = passing(column, S.SUBCATEGORIES, threshold)
    return f"CASE WHEN len({tags}) > 0 THEN {tags} ELSE [{listing(S.SUBCATEGORIES)}[{best(column)} + 1]] END"


def named(classes: list[str], index: str) -> str:
    return f"{listing(classes)}[{index} + 1]"


ORACLES["softmax_argmax"] = with_([SCORED], "SELECT query_id, " + ", ".join(
    f"{best(h)} AS {h}_idx, {r(confidence(h))} AS {h}_confidence" for h in S.SINGLE_HEADS
) + " FROM scored")
ORACLES["sigmoid_threshold"] = with_([SCORED], f"""
SELECT query_id, {joined(passing('keywords', S.SQL_KEYWORDS))} AS keywords,
  {joined(passing('subcategory', S.SUBCATEGORIES))} AS subcategories FROM scored""")
ORACLES["fallback_label"] = with_(
    [SCORED], f"SELECT query_id, {joined(fallback('subcategory', 0.58))} AS subcategories FROM scored"
)
ORACLES["decode_index"] = with_([SCORED], f"""
SELECT query_id, {named(S.COMPLEXITY_LABELS, best('complexity'))} AS complexity,
  coalesce({named(S.CATEGORIES, f"{best('category')} + 1")}, 'Category ' || ({best('category')} + 1)) AS category FROM scored""")


def records(logits: str) -> str:
    """``decoded``: labels and confidences from a relation with one list of logits per head."""
    return f"""decoded AS (
  SELECT query_id, {named(S.COMPLEXITY_LABELS, best('complexity'))} AS complexity,
    {r(confidence('complexity'))} AS complexity_confidence,
    {joined(passing('keywords', S.SQL_KEYWORDS))} AS keywords,
    {named(S.CATEGORIES, best('category'))} AS category, {r(confidence('category'))} AS category_confidence,
    {joined(fallback('subcategory'))} AS subcategories,
    {named(S.TABLE_COUNT_LABELS, best('table_count'))} AS estimated_tables,
    {r(confidence('table_count'))} AS table_count_confidence
  FROM {logits})"""


def listed(hints: str) -> str:
    return f"""listed AS (SELECT query_id, string_agg("table", ',' ORDER BY rank) AS tables,
  {r('(max(score) + 1) / 2')} AS best FROM {hints} GROUP BY query_id)"""


ORACLES["analysis_record"] = with_([*RANKED, SCORED, records("scored"), listed("hints")], """
SELECT d.*, 'question ' || d.query_id AS query, tables, best FROM decoded d LEFT JOIN listed l ON l.query_id = d.query_id""")

# --- text models -------------------------------------------------------------------------------

DOC_TRAIN = f"""train AS (
  SELECT doc_id, text, quality, toxic FROM documents JOIN labels USING (doc_id) WHERE {bucket('doc_id')} < 700),
tc AS (SELECT tok, quality, toxic, count(*) AS n FROM (SELECT unnest({words('text')}) AS tok, quality, toxic FROM train) GROUP BY ALL),
sums AS (SELECT tok, sum(n * (quality = 0)::INT) AS q0, sum(n * (quality = 1)::INT) AS q1,
           sum(n * (toxic = 0)::INT) AS t0, sum(n * (toxic = 1)::INT) AS t1 FROM tc GROUP BY tok),
tot AS (SELECT count(*) AS v, sum(q0) AS q0, sum(q1) AS q1, sum(t0) AS t0, sum(t1) AS t1 FROM sums),
wts AS (SELECT tok, """ + ", ".join(
    f"ln((sums.{c} + 1) / (tot.{c} + tot.v)) AS {c}" for c in ("q0", "q1", "t0", "t1")
) + " FROM sums, tot)"
ORACLES["fit_text_labels"] = with_([DOC_TRAIN], "SELECT tok AS token, " + ", ".join(
    f"{r(c)} AS {c}" for c in ("q0", "q1", "t0", "t1")
) + " FROM wts")
ORACLES["predict_text_labels"] = with_([DOC_TRAIN, f"""
pr AS (SELECT CASE WHEN count(*) FILTER (quality = 0) = 0 THEN -1e6::DOUBLE ELSE ln((count(*) FILTER (quality = 0) + 1) / (count(*) + 2)) END AS q0, CASE WHEN count(*) FILTER (quality = 1) = 0 THEN -1e6::DOUBLE ELSE ln((count(*) FILTER (quality = 1) + 1) / (count(*) + 2)) END AS q1,
         CASE WHEN count(*) FILTER (toxic = 0) = 0 THEN -1e6::DOUBLE ELSE ln((count(*) FILTER (toxic = 0) + 1) / (count(*) + 2)) END AS t0, CASE WHEN count(*) FILTER (toxic = 1) = 0 THEN -1e6::DOUBLE ELSE ln((count(*) FILTER (toxic = 1) + 1) / (count(*) + 2)) END AS t1 FROM train),
dt AS (SELECT doc_id, unnest({words('text')}) AS tok FROM documents),
ds AS (SELECT doc_id, sum(q0) AS q0, sum(q1) AS q1, sum(t0) AS t0, sum(t1) AS t1 FROM dt JOIN wts USING (tok) GROUP BY doc_id),
lg AS (SELECT d.doc_id, """ + ", ".join(
    f"coalesce(ds.{c}, 0) + pr.{c} AS {c}" for c in ("q0", "q1", "t0", "t1")
) + """ FROM documents d CROSS JOIN pr LEFT JOIN ds USING (doc_id))"""], f"""
SELECT doc_id, (q1 > q0)::INT AS quality_pred, (t1 > t0)::INT AS toxic_pred,
  {r('q0', 4)} AS quality_0, {r('q1', 4)} AS quality_1, {r('t0', 4)} AS toxic_0, {r('t1', 4)} AS toxic_1 FROM lg""")


def accelerated(rounds: int, most: float, reg: str = "reg") -> str:
    """Weights (prob, tok, w) of logistic regressions by accelerated gradient steps of fixed length, which
    know nothing of the library's optimizer.

    Relations: ``xs`` (row, tok, v) with a constant under the token '', ``ys`` (row, prob, y, n) with n equal
    rows each, ``sizes`` (prob, total), ``reg`` (prob, reg). ``most`` is the largest squared length of a row. The mean
    loss has a curvature of at most most / 4 + reg and at least reg."""
    length = f"({most} / 4 + {reg})"
    push = f"((sqrt({length}) - sqrt({reg})) / (sqrt({length}) + sqrt({reg})))"
    return f"""gd AS (
  SELECT 0 AS step, prob, tok, 0.0::DOUBLE AS w, 0.0::DOUBLE AS m FROM reg, (SELECT DISTINCT tok FROM xs)
  UNION ALL
  SELECT step + 1, prob, tok, m - (g + reg * m) / {length},
    (m - (g + reg * m) / {length}) * (1 + {push}) - w * {push}
  FROM gd JOIN reg USING (prob) JOIN (
    SELECT prob, tok, sum(v * slope) AS g
    FROM (
      SELECT ys.row, prob, n * (1 / (1 + exp(-margin)) - y) / total AS slope
      FROM (SELECT row, prob, sum(v * m) AS margin FROM gd JOIN xs USING (tok) GROUP BY row, prob)
      JOIN ys USING (row, prob) JOIN sizes USING (prob)
    ) JOIN xs USING (row) GROUP BY prob, tok
  ) USING (prob, tok)
  WHERE step < {rounds}
), fitted AS (SELECT prob, tok, w FROM gd WHERE step = {rounds})"""


def unit_vectors(counts: str, texts: str) -> str:
    """``idf`` and the rows ``xs`` for ``counts`` (row, tok, n, copies) out of ``texts`` texts."""
    return f"""idf AS (SELECT tok, ln(({texts} + 1) / (sum(copies) + 1)) + 1 AS idf FROM {counts} GROUP BY tok),
xs AS (SELECT row, tok, n * idf / sqrt(sum((n * idf) ** 2) OVER (PARTITION BY row)) AS v FROM {counts} JOIN idf USING (tok)
  UNION ALL SELECT DISTINCT row, '', 1.0 FROM ys)"""


# with two classes and equal penalties the logits are opposite, so one margin with half the penalty tells both
ORACLES["fit_text_labels_lr"] = with_([f"""labelled AS (SELECT doc_id AS row, text, quality, toxic FROM documents JOIN labels USING (doc_id))""", f"""
train AS (SELECT * FROM labelled WHERE {bucket('row')} < 700),
ys AS (SELECT row, 'quality' AS prob, quality AS y, 1 AS n FROM train UNION ALL SELECT row, 'toxic', toxic, 1 FROM train),
sizes AS (SELECT prob, count(*) AS total FROM ys GROUP BY prob),
reg AS (SELECT prob, 0.005::DOUBLE AS reg FROM sizes),
tc AS (SELECT row, tok, count(*) AS n, 1 AS copies FROM (SELECT row, unnest({words('text')}) AS tok FROM train) GROUP BY row, tok)""",
unit_vectors("tc", "(SELECT count(*) FROM train)"), accelerated(420, 2.0), f"""
dc AS (SELECT row, tok, count(*) * any_value(idf) AS x FROM (SELECT row, unnest({words('text')}) AS tok FROM labelled) JOIN idf USING (tok) GROUP BY row, tok),
dots AS (SELECT row, prob, sum(x * w) / sqrt(sum(x * x)) AS s FROM dc JOIN fitted USING (tok) GROUP BY row, prob),
lg AS (SELECT l.row, f.prob, coalesce(s, 0) + w AS margin FROM labelled l JOIN fitted f ON f.tok = '' LEFT JOIN dots ON dots.row = l.row AND dots.prob = f.prob),
sides AS (SELECT row AS doc_id, max(margin) FILTER (prob = 'quality') AS q, max(margin) FILTER (prob = 'toxic') AS t FROM lg GROUP BY row)"""], f"""
SELECT doc_id, (q > 0)::INT AS quality, (t > 0)::INT AS toxic, {r('-q / 2', 4)} AS quality_0, {r('q / 2', 4)} AS quality_1,
  {r('-t / 2', 4)} AS toxic_0, {r('t / 2', 4)} AS toxic_1 FROM sides""").replace("WITH ", "WITH RECURSIVE ", 1)


def _truths() -> str:
    single = " UNION ALL ".join(
        f"SELECT query_id, '{h}' AS head, c.i AS cls, ({S.HEAD_COLUMNS[h]} = c.label)::INT AS y FROM trained, "
        f"(SELECT unnest({listing(cs)}) AS label, unnest(range({len(cs)})) AS i) c"
        for h, cs in S.SINGLE_HEADS.items()
    )
    multi = " UNION ALL ".join(
        f"SELECT query_id, '{h}', c.i, list_contains({S.HEAD_COLUMNS[h]}, c.label)::INT FROM trained, "
        f"(SELECT unnest({listing(cs)}) AS label, unnest(range({len(cs)})) AS i) c"
        for h, cs in S.MULTI_HEADS.items()
    )
    return f"{single} UNION ALL {multi}"


ANALYZER = f"""trained AS (SELECT * FROM labelled WHERE {bucket('query_id')} < 700),
truth AS ({_truths()}),
is_multi AS (SELECT head, head IN ('keywords', 'subcategory') AS multi, count(DISTINCT cls) AS size FROM truth GROUP BY head),
tq AS (SELECT query_id, tok, count(*) AS n FROM (SELECT query_id, unnest({words('instruction')}) AS tok FROM trained) GROUP BY ALL),
tn AS (SELECT tok, sum(n) AS n FROM tq GROUP BY tok),
tcount AS (SELECT tok, head, cls, sum(n * y) AS n1 FROM tq JOIN truth USING (query_id) GROUP BY tok, head, cls),
ttotal AS (SELECT head, cls, sum(n1) AS t1 FROM tcount GROUP BY head, cls),
nall AS (SELECT count(*) AS v, sum(n) AS t FROM tn),
weight AS (SELECT tok, head, cls, CASE WHEN multi
    THEN ln((n1 + 1) / (t1 + v)) - ln((n - n1 + 1) / (t - t1 + v)) ELSE ln((n1 + 1) / (t1 + v)) END AS w
  FROM tcount JOIN ttotal USING (head, cls) JOIN is_multi USING (head) JOIN tn USING (tok), nall),
prior AS (SELECT head, cls, CASE WHEN any_value(multi) THEN ln((sum(y) + 1) / (count(*) - sum(y) + 1))
    WHEN sum(y) = 0 THEN -1e6::DOUBLE ELSE ln((sum(y) + 1) / (count(*) + any_value(size))) END AS p FROM truth JOIN is_multi USING (head) GROUP BY head, cls)"""


# equal questions with equal tags are one row that counts as often as it occurs
ORACLES["fit_text_tags_lr"] = with_([*LOG_LABELLED, f"""
trained AS (SELECT instruction, keywords, subcategories, count(*) AS n FROM labelled WHERE {bucket('query_id')} < 700 GROUP BY ALL),
distinct_rows AS (SELECT row_number() OVER (ORDER BY instruction, keywords::VARCHAR, subcategories::VARCHAR) AS row, * FROM trained),
ys AS (""" + " UNION ALL ".join(
    f"SELECT row, '{h}:' || tag AS prob, list_contains({S.HEAD_COLUMNS[h]}, tag)::INT AS y, n "
    f"FROM distinct_rows, (SELECT unnest({listing(cs)}) AS tag)" for h, cs in S.MULTI_HEADS.items()
) + f"""),
sizes AS (SELECT prob, sum(n) AS total FROM ys GROUP BY prob),
reg AS (SELECT prob, 0.01::DOUBLE AS reg FROM sizes),
qc AS (SELECT row, tok, count(*) AS n, any_value(copies) AS copies FROM (SELECT row, n AS copies, unnest({words('instruction')}) AS tok FROM distinct_rows) GROUP BY row, tok)""",
unit_vectors("qc", "(SELECT sum(n) FROM trained)"), accelerated(260, 2.0)], f"""
SELECT split_part(prob, ':', 1) AS head, split_part(prob, ':', 2) AS tag, tok AS token, {r('w', 4)} AS weight FROM fitted""").replace("WITH ", "WITH RECURSIVE ", 1)


def analyzed(questions: str) -> list[str]:
    """``decoded`` for a relation (query_id, text), by the model fitted on the log."""
    gathered = ", ".join(
        f"list(logit ORDER BY cls) FILTER (head = '{h}') AS {h}" for h in [*S.SINGLE_HEADS, *S.MULTI_HEADS]
    )
    return [f"""asked_tok AS (SELECT query_id, tok, count(*) AS n FROM (SELECT query_id, unnest({words('text')}) AS tok FROM {questions}) GROUP BY ALL),
asum AS (SELECT query_id, head, cls, sum(n * w) AS s FROM asked_tok JOIN weight USING (tok) GROUP BY query_id, head, cls),
along AS (SELECT a.query_id, prior.head, prior.cls, p + coalesce(s, 0) AS logit
  FROM {questions} a CROSS JOIN prior LEFT JOIN asum ON asum.query_id = a.query_id AND asum.head = prior.head AND asum.cls = prior.cls),
logits AS (SELECT query_id, {gathered} FROM along GROUP BY query_id)""", records("logits")]


ASKED = f"""questions AS (SELECT query_id, instruction AS text FROM log)"""
LOG_CATALOG = """log_catalog AS (SELECT t AS "table", t AS doc FROM (SELECT DISTINCT unnest(tables) AS t FROM table_log))"""
MODEL = [RAW, LOG, LABELLED, ANALYZER]
RECORD = "query, complexity, complexity_confidence, keywords, category, category_confidence, subcategories, estimated_tables, table_count_confidence"

ORACLES["analyze_batch"] = with_([
    *MODEL, STRICT, TABLES, ASKED, LOG_CATALOG, *analyzed("questions"),
    *text_ranking("questions", "log_catalog", S.HINTS_TOP_K), listed("text_hints"),
], """SELECT d.*, text AS query, tables, best FROM decoded d JOIN questions USING (query_id) JOIN listed USING (query_id)""")
ORACLES["analyze"] = with_([
    *MODEL, STRICT, TABLES, "questions AS (SELECT 0::BIGINT AS query_id, 'Which suppliers deliver late and how many line items are returned' AS text)",
    LOG_CATALOG, *analyzed("questions"), *text_ranking("questions", "log_catalog", S.HINTS_TOP_K), listed("text_hints"),
], """SELECT d.*, text AS query, tables, best FROM decoded d JOIN questions USING (query_id) JOIN listed USING (query_id)""")
ORACLES["route_queries"] = with_([
    *MODEL, STRICT, TABLES, ASKED, "every AS (SELECT query_id, instruction AS text FROM log)", LOG_CATALOG,
    *analyzed("questions"), *text_ranking("every", "log_catalog", 20), listed("text_hints"),
], """SELECT query_id, complexity, CASE WHEN complexity = 'simple' THEN 'template' ELSE 'model' END AS route, tables
FROM decoded JOIN listed USING (query_id)""")
ORACLES["analyze_stream"] = with_([
    *MODEL, "questions AS (SELECT conv_id * 1000 + turn AS query_id, coalesce(text, '') AS text FROM conversations)",
    """items AS (SELECT 'item_' || item_id AS "table", text AS doc FROM benchmark)""",
    *analyzed("questions"), *text_ranking("questions", "items", 5), "kept AS (SELECT * FROM text_hints WHERE score >= 0)",
    listed("kept"),
], "SELECT d.*, tables, best FROM decoded d LEFT JOIN listed USING (query_id)")

REQUESTS = f"""requests AS (
  SELECT query_id, instruction AS query, CASE query_id % 5
    WHEN 0 THEN 'customers (id, name)|orders (id, customer)|logs|staff (name, pay)'
    WHEN 1 THEN 'customers, orders, products, sales ,, sessions' WHEN 2 THEN '  '
    WHEN 3 THEN 'inventory stock,audit entry,user preferences' END AS tables
  FROM log),
entries AS (
  SELECT query_id, query, unnest(list_filter(list_transform(
    str_split(tables, CASE WHEN contains(tables, '|') THEN '|' ELSE ',' END), lambda x: trim(x, {BLANKS})),
    lambda x: x <> '')) AS "table" FROM requests WHERE trim(query, {BLANKS}) <> ''),
dlist AS (SELECT DISTINCT "table", "table" AS doc FROM entries),
rq AS (SELECT DISTINCT query AS text, query AS query_id FROM entries)"""
# texts repeat, so distinct texts are scored once and looked up
REQUEST_HINTS = [RAW, LOG, REQUESTS, *text_ranking("rq", "dlist", None), """request_hints AS (
  SELECT * FROM (SELECT e.query_id, e."table", s.score,
    (row_number() OVER (PARTITION BY e.query_id ORDER BY s.score DESC, e."table"))::INT AS rank
  FROM entries e JOIN text_scores s ON s.query_id = e.query AND s."table" = e."table") WHERE rank <= 3)"""]
ORACLES["rank_request"] = with_(
    REQUEST_HINTS, f'SELECT query_id, rank, "table", {_score} AS score FROM request_hints'
)
ORACLES["combined_analysis"] = with_([*REQUEST_HINTS, LABELLED, ANALYZER, ASKED, *analyzed("questions"), """
shown AS (SELECT query_id, string_agg("table", '|' ORDER BY rank) AS tables FROM request_hints GROUP BY query_id)"""], """
SELECT query_id, complexity, category, estimated_tables, keywords, tables FROM decoded LEFT JOIN shown USING (query_id)""")

# --- evaluation --------------------------------------------------------------------------------

PREDICTED = SCORED + f""",
p AS (SELECT *, {", ".join(f"{best(h)} AS {h}_pred" for h in S.SINGLE_HEADS)},
  {passing('keywords', S.SQL_KEYWORDS)} AS keywords_pred, {passing('subcategory', S.SUBCATEGORIES)} AS subcategory_pred FROM scored)"""


def metric(head: str, name: str, value: str, source: str = "p") -> str:
    return f"SELECT '{head}' AS head, '{name}' AS metric, {r(value)} AS value FROM {source}"


def f1(predicted: str, truth: str) -> str:
    shared = f"len(list_intersect({predicted}, {truth}))"
    precision = f"coalesce({shared} / nullif(len({predicted}), 0), 0)"
    recall = f"coalesce({shared} / nullif(len({truth}), 0), 0)"
    return f"coalesce(2 * {precision} * {recall} / nullif({precision} + {recall}, 0), 0)"


def right(head: str) -> str:
    return f"({head}_pred = {head}_true)"


_accuracies = " UNION ALL ".join(metric(h, "accuracy", f"avg({right(h)}::INT)") for h in S.SINGLE_HEADS)
ORACLES["accuracy"] = with_([PREDICTED], _accuracies)
ORACLES["write_metrics"] = with_([PREDICTED], f"SELECT 'run-1' AS run_id, * FROM ({_accuracies})")
ORACLES["sample_f1"] = with_([PREDICTED], " UNION ALL ".join(
    metric(h, "sample_f1", f"avg({f1(f'{h}_pred', f'{h}_true')})") for h in S.MULTI_HEADS
))
ORACLES["exact_match"] = with_(
    [PREDICTED], metric("all", "exact_match", f"avg(({right('complexity')} AND {right('category')})::INT)")
)
ORACLES["mean_accuracy"] = with_(
    [PREDICTED], metric("all", "mean_accuracy", f"(avg({right('complexity')}::INT) + avg({right('category')}::INT)) / 2")
)
CLASSES = """classes AS (SELECT c AS class, count(*) FILTER (category_true = c) AS support,
    count(*) FILTER (category_pred = c) AS guessed, count(*) FILTER (category_pred = c AND category_true = c) AS hits
  FROM p, (SELECT DISTINCT unnest([category_true, category_pred]) AS c FROM p) GROUP BY c),
prf AS (SELECT *, coalesce(hits / nullif(guessed, 0), 0) AS precision, coalesce(hits / nullif(support, 0), 0) AS recall,
    coalesce(2 * hits / nullif(guessed + support, 0), 0) AS f1 FROM classes)"""
_weighted = ", ".join(f"{r(f'sum({c} * support) / sum(support)')} AS {c}" for c in ("precision", "recall", "f1"))
ORACLES["weighted_prf"] = with_([PREDICTED, CLASSES], f"SELECT {_weighted} FROM prf")
ORACLES["classification_report"] = with_([PREDICTED, CLASSES], f"""
SELECT 'class' AS kind, class::VARCHAR AS class, support::BIGINT AS support, {r('precision')} AS precision, {r('recall')} AS recall, {r('f1')} AS f1 FROM prf
UNION ALL SELECT 'summary', 'accuracy', sum(support)::BIGINT, NULL, NULL, {r('sum(hits) / sum(support)')} FROM prf
UNION ALL SELECT 'summary', 'macro avg', sum(support)::BIGINT, {r('avg(precision)')}, {r('avg(recall)')}, {r('avg(f1)')} FROM prf
UNION ALL SELECT 'summary', 'weighted avg', sum(support)::BIGINT, {_weighted} FROM prf""")


def _ce(h: str) -> str:
    return f"avg(ln(list_sum(list_transform({h}, lambda x: exp(x)))) - {h}[{h}_true + 1])"


def _bce(h: str, classes: list[str]) -> str:
    hit = f"list_contains({h}_true, c)"
    return (
        f"avg(list_sum(list_transform({listing(classes)}, lambda c, i: "
        f"CASE WHEN {hit} THEN ln(1 + exp(-{h}[i])) ELSE ln(1 + exp({h}[i])) END)) / {len(classes)})"
    )


_losses = {**{h: _ce(h) for h in S.SINGLE_HEADS}, **{h: _bce(h, c) for h, c in S.MULTI_HEADS.items()}}
ORACLES["multi_output_log_loss"] = with_([SCORED], " UNION ALL ".join(
    [metric(h, "log_loss", loss, "scored") for h, loss in _losses.items()]
    + [metric("total", "log_loss", " + ".join(f"{S.LOSS_WEIGHTS[h]} * {loss}" for h, loss in _losses.items()), "scored")]
))
ORACLES["combined_score"] = with_([
    *MODEL, f"""held AS (SELECT query_id, instruction AS text FROM labelled WHERE {bucket('query_id')} >= 800)""",
    *analyzed("held"),
    f"""m AS (SELECT avg((d.complexity = l.complexity)::INT) AS complexity, avg((d.category = l.category)::INT) AS category,
      avg((d.estimated_tables = l.table_count)::INT) AS table_count,
      avg({f1("list_filter(str_split(d.keywords, ','), lambda x: x <> '')", 'l.keywords')}) AS keywords,
      avg({f1("str_split(d.subcategories, ',')", 'l.subcategories')}) AS subcategories
    FROM decoded d JOIN labelled l USING (query_id))"""], " UNION ALL ".join(
        [metric(h, "accuracy", h, "m") for h in S.SINGLE_HEADS]
        + [metric(h, "sample_f1", h, "m") for h in ("keywords", "subcategories")]
        + [metric("all", "combined", "(complexity + category + table_count + keywords + subcategories) / 5", "m")]
    ))

LABEL_PAIRS = [VECTORS, """lq AS (SELECT query_id, vec, 'label_' || label AS positive, ['label_' || label] AS tables FROM q)""",
    *negatives("lq"), f"""lp AS (
  SELECT lq.query_id, n.t AS "table", vec, positive, 0.0::DOUBLE AS label FROM lq JOIN negative n USING (query_id)
  UNION ALL SELECT query_id, positive, vec, positive, 1.0::DOUBLE FROM lq),
ls AS (SELECT lp.query_id, lp."table", label, {cosine('lp.vec', 'c.vec')} AS score FROM lp JOIN cat c ON c."table" = lp."table")"""]
ORACLES["cosine_mse"] = with_(LABEL_PAIRS, metric("ranker", "cosine_mse", "avg((score - label) * (score - label))", "ls"))
ORACLES["score_correlation"] = with_([*LABEL_PAIRS, """
rk AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS rs,
         rank() OVER (ORDER BY label) + (count(*) OVER (PARTITION BY label) - 1) / 2 AS rl FROM ls)"""],
    metric("ranker", "pearson", "corr(score, label)", "rk") + " UNION ALL " + metric("ranker", "spearman", "corr(rs, rl)", "rk"))
ORACLES["info_nce"] = with_([*LABEL_PAIRS, """
e AS (SELECT query_id, sum(exp(score / 0.1)) AS total, sum(score * label) / 0.1 AS pos FROM ls GROUP BY query_id)"""],
    metric("ranker", "info_nce", "avg(ln(total) - pos)", "e"))

EXPECTED = """expected AS (SELECT vec_id AS query_id, ['label_' || label, 'label_' || ((label + 1) % 10)] AS names FROM embeddings)"""
ORACLES["hits_at_k"] = with_([*RANKED, EXPECTED], """
SELECT e.query_id, count(*) FILTER (h.rank <= 3 AND h.score >= 0 AND (contains(h."table", names[1]) OR contains(h."table", names[2]))) AS found,
  2::BIGINT AS total FROM expected e LEFT JOIN ranked h ON h.query_id = e.query_id GROUP BY e.query_id""")
ORACLES["recall_at_k"] = with_([*RANKED, EXPECTED], f"""
SELECT k, {r('avg(share)')} AS recall FROM (
  SELECT e.query_id, k, count(*) FILTER (h.rank <= k AND list_contains(names, h."table")) / 2 AS share
  FROM expected e JOIN ranked h ON h.query_id = e.query_id, (SELECT unnest([1, 3, 5]) AS k) GROUP BY e.query_id, k) GROUP BY k""")

# --- pair features -----------------------------------------------------------------------------

PAIR_SHARES = f"""
header_names AS (SELECT DISTINCT header AS name, list_distinct({words('header')}) AS ws FROM pairs),
header_words AS (SELECT name, unnest(ws) AS tok FROM header_names),
word_idf AS (SELECT tok, ln(((SELECT count(*) FROM header_names) + 1) / (count(*) + 1)) + 1 AS w FROM header_words GROUP BY tok),
pair_words AS (SELECT row_id, header, header_pos, label, list_distinct({words('question')}) AS q, list_distinct({words('header')}) AS h FROM pairs),
shares AS (SELECT row_id, header_pos, sum(w) FILTER (list_contains(q, tok)) / sum(w) AS share
  FROM (SELECT row_id, header_pos, q, unnest(h) AS tok FROM pair_words) JOIN word_idf USING (tok) GROUP BY ALL)"""
ORACLES["pair_features"] = with_([QA, PARSED, PAIRS, PAIR_SHARES], f"""
SELECT row_id, header, len(list_intersect(q, h))::DOUBLE AS shared,
  {r('coalesce(len(list_intersect(q, h)) / nullif(len(list_distinct(list_concat(q, h))), 0), 0)')} AS jaccard,
  {r('coalesce(share, 0)')} AS idf_share
FROM pair_words LEFT JOIN shares USING (row_id, header_pos)""")


def _newton() -> str:
    """Newton steps for the pair features, the system of four equations solved by elimination."""
    x = ["1.0::DOUBLE", "shared", "jaccard", "idf_share"]
    margin = " + ".join(f"w{i} * {c}" for i, c in enumerate(x))
    sums = ", ".join(
        [f"sum(n * (p - y) * {c}) / sum(n) + {0.001 if i else 0.0} * any_value(w{i}) AS g{i}" for i, c in enumerate(x)]
        + [f"sum(n * p * (1 - p) * {x[i]} * {x[j]}) / sum(n) + {0.001 if i == j and i else 0.0} AS a{i}{j}" for i in range(4) for j in range(4)])
    inner = f"SELECT any_value(step) AS step, {', '.join(f'any_value(w{i}) AS w{i}' for i in range(4))}, {sums} FROM (SELECT *, 1 / (1 + exp(-({margin}))) AS p FROM newton, distinct_features)"
    # eliminate one unknown after the other, then insert backwards
    for k in range(3):
        kept = [f"w{i}" for i in range(4)] + [f"g{i}" for i in range(k + 1)] + [f"a{i}{j}" for i in range(k + 1) for j in range(4)]
        new = [f"g{i} - a{i}{k} / a{k}{k} * g{k} AS g{i}" for i in range(k + 1, 4)]
        new += [f"a{i}{j} - a{i}{k} / a{k}{k} * a{k}{j} AS a{i}{j}" for i in range(k + 1, 4) for j in range(4)]
        inner = f"SELECT step, {', '.join(kept + new)} FROM ({inner})"
    for i in (3, 2, 1, 0):
        rest = "".join(f" - a{i}{j} * d{j}" for j in range(i + 1, 4))
        inner = f"SELECT *, (g{i}{rest}) / a{i}{i} AS d{i} FROM ({inner})"
    return f"""newton AS (
  SELECT 0 AS step, {', '.join(f'0.0::DOUBLE AS w{i}' for i in range(4))}
  UNION ALL
  SELECT step + 1, {', '.join(f'w{i} - d{i}' for i in range(4))} FROM ({inner}) WHERE step < 40
)"""


ORACLES["fit_pair_relevance"] = with_([QA, PARSED, PAIRS, PAIR_SHARES, """
measured AS (SELECT row_id, header, pair_words.label, len(list_intersect(q, h))::DOUBLE AS shared,
  coalesce(len(list_intersect(q, h)) / nullif(len(list_distinct(list_concat(q, h))), 0), 0)::DOUBLE AS jaccard, coalesce(share, 0)::DOUBLE AS idf_share
  FROM pair_words LEFT JOIN shares USING (row_id, header_pos)),
distinct_features AS (SELECT shared, jaccard, idf_share, label::DOUBLE AS y, count(*) AS n FROM measured GROUP BY ALL)""", _newton()], f"""
SELECT row_id, header, measured.label, {r('1 / (1 + exp(-(w0 + w1 * shared + w2 * jaccard + w3 * idf_share)))', 4)} AS score
FROM measured, newton WHERE step = 40""").replace("WITH ", "WITH RECURSIVE ", 1)
