"""The registered queries as SQL for an independent engine over the same tables."""

from __future__ import annotations

from lodestar.functions.stopwords import ENGLISH
from lodestar.functions.text import KEYWORDS, MISSING_TOKENS
from lodestar.operators import answers as an
from lodestar.operators.corpus import PUBLICATION_OFFSET


def _text(value: str) -> str:
    """SQL literal of a text; line breaks are spelled with chr()."""
    parts = ["'" + part.replace("'", "''") + "'" for part in value.split("\n")]
    return "(" + " || chr(10) || ".join(parts) + ")"


def _list(values) -> str:
    return ", ".join(_text(v) for v in values)


SPACE = r"\t-\r\x1c-\x1f \x{85}\p{Z}"
URL = rf"""(?i)https?://[^{SPACE}''"<>)\]]+"""
BREAKS = r"[\n-\r\x1c-\x1e\x{85}\x{2028}\x{2029}]+"
STOP = _list(ENGLISH)
TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"
LANG = """regexp_extract(html, 'lang="([a-z]+)"', 1)"""


def _distinct(items: str) -> str:
    """Distinct elements of a list in order of first occurrence."""
    return f"list_filter({items}, lambda x, i: list_position({items}, x) = i)"


def _urls(text: str) -> str:
    return _distinct(f"list_transform(regexp_extract_all({text}, '{URL}'), lambda u: rtrim(u, '.,;:)'))")


def _words(text: str) -> str:
    return rf"regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}_]+')"


def _numbers(text: str) -> str:
    return (
        rf"regexp_extract_all(regexp_replace({text}, '\p{{L}}', 'x', 'g'), '\b(?:[0-9]{{2,}}|[0-9]+(?:\.[0-9]+)?)\b')"
    )


def _kept(text: str) -> str:
    return rf"list_filter(regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}_]{{2,}}'), lambda w: w NOT IN ({STOP}))"


def _strip(text: str) -> str:
    return f"regexp_replace({text}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def _lines(text: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array({text}, '{BREAKS}'), lambda l: {_strip('l')}), lambda l: l <> '')"


CATALOG = """
catalog AS (SELECT doc_id AS pos, 'doc_' || doc_id AS dataset, lang AS organism, source AS assay_types,
  text AS description FROM documents),
publications AS (SELECT page_id AS pos, {title} AS title, url AS link FROM pages),
questions AS (SELECT item_id AS query_id, text || ' ' || length(text) AS text FROM benchmark)
""".format(title=TITLE)

CORPUS = CATALOG + f""",
corpus AS (
  SELECT pos AS ord, dataset AS key, 'dataset' AS entry_type,
    'DATASET_ID: ' || dataset || chr(10) || organism || chr(10) || assay_types
      || CASE WHEN description <> '' THEN chr(10) || description ELSE '' END AS text FROM catalog
  UNION ALL
  SELECT pos + {PUBLICATION_OFFSET}, 'pub_' || pos, 'publication', 'PUBLICATION: ' || title || ' ' || link FROM publications)
"""


def _tf(name: str, source: str, key: str) -> str:
    return f"""
{name}_tokens AS (SELECT {key}, {_kept('text')} AS toks FROM {source}),
{name}_terms AS (SELECT {key}, list_concat(toks, list_transform(range(1, len(toks)), lambda i: toks[i] || ' ' || toks[i + 1])) AS terms FROM {name}_tokens),
{name}_tf AS (SELECT {key}, term, count(*) AS tf FROM (SELECT {key}, unnest(terms) AS term FROM {name}_terms) GROUP BY ALL)
"""


INDEX = CORPUS + "," + _tf("doc", "corpus", "ord") + f""",
vocab AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total FROM doc_tf GROUP BY term ORDER BY total DESC, term LIMIT {{cap}}),
idf AS (SELECT term, ln((1.0 + (SELECT count(*) FROM corpus)) / (1.0 + df)) + 1.0 AS idf FROM vocab),
doc_raw AS (SELECT ord, term, tf * idf AS raw FROM doc_tf JOIN idf USING (term)),
doc_w AS (SELECT ord, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY ord)) AS weight FROM doc_raw),
""" + _tf("q", "questions", "query_id") + """,
q_raw AS (SELECT query_id, term, tf * idf AS raw FROM q_tf JOIN idf USING (term)),
q_w AS (SELECT query_id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY query_id)) AS weight FROM q_raw),
sims AS (SELECT query_id, ord, sum(q_w.weight * doc_w.weight) AS sim FROM q_w JOIN doc_w USING (term) GROUP BY ALL),
""" + f"""
doc_words AS (SELECT DISTINCT ord, unnest({_words('text')}) AS word FROM corpus),
q_words AS (SELECT DISTINCT query_id, unnest({_words('text')}) AS word FROM questions),
q_size AS (SELECT query_id, count(*) AS n FROM q_words GROUP BY query_id),
word_overlap AS (SELECT query_id, ord, count(*) / (1.0 + any_value(n)) AS overlap FROM q_words JOIN doc_words USING (word) JOIN q_size USING (query_id) GROUP BY ALL),
q_numbers AS (SELECT DISTINCT query_id, unnest({_numbers('text')}) AS num FROM questions),
boosts AS (SELECT query_id, ord, 0.5 * count(*) AS boost FROM q_numbers JOIN corpus ON contains(text, num) GROUP BY ALL),
pairs AS (SELECT query_id, ord, coalesce(sim, 0.0) AS sim, coalesce(overlap, 0.0) AS overlap, coalesce(CAST(boost AS DOUBLE), 0.0) AS boost
  FROM sims FULL JOIN word_overlap USING (query_id, ord) FULL JOIN boosts USING (query_id, ord)),
scored AS (SELECT *, 0.7 * sim + 0.3 * overlap + boost AS score FROM pairs),
ranked AS (SELECT scored.*, key, entry_type,
  row_number() OVER (PARTITION BY query_id, entry_type ORDER BY round(score, 9) DESC, ord) AS rank
  FROM scored JOIN corpus USING (ord) WHERE score >= 0.02),
hits AS (SELECT * FROM ranked WHERE rank <= CASE entry_type WHEN 'dataset' THEN 5 ELSE 8 END)
"""
CATALOG, CORPUS = CATALOG.strip(), CORPUS.strip()
FULL = INDEX.replace("{cap}", "10000").strip()
NO_VOCAB = INDEX.replace("{cap}", "0").strip()
HITS = "SELECT query_id, entry_type, rank, key, round(score, 6) AS score, round(sim, 6) AS sim, round(overlap, 6) AS overlap FROM hits"

ORACLES: dict[str, str] = {}


def _add(name: str, body: str, base: str = "") -> None:
    ORACLES[name] = f"WITH {base} {body}" if base else body


# Sources and sinks

_PART_FILES = """
SELECT 'part-' || p_partkey AS dataset, CAST(file_pos AS BIGINT) AS file_pos, name, path FROM part, LATERAL (VALUES
  (0, 'investigation', 'i/' || p_partkey || '.txt'), (1, 'samples', 's/' || p_partkey || '.txt'),
  (2, 'assays', CASE WHEN p_size % 3 = 0 THEN '' ELSE p_type || '/a1.txt' END), (3, 'extra', 'x.txt')) AS f(file_pos, name, path)
"""
_add("catalog_entries", """
SELECT 'part-' || p_partkey AS dataset, row_number() OVER (ORDER BY p_partkey) - 1 AS pos, p_brand AS organism, p_type AS assay_types, 'f/' || p_size AS folder,
  p_name AS description, CAST(5 AS BIGINT) AS n_files FROM part
""")
_add("publication_entries", "SELECT 2 * (row_number() OVER (ORDER BY pos) - 1) AS pos, title, link FROM publications UNION ALL SELECT 2 * row_number() OVER (ORDER BY pos) - 1, '', link FROM publications", CATALOG)
_add("catalog_files", _PART_FILES)
_add("all_catalog_files", _PART_FILES + """
UNION ALL SELECT 'part-' || p_partkey, 4, 'fifth', 'y.txt' FROM part
""")
_add("missing_files", f"""
SELECT f.*, path <> '' AND path NOT IN (SELECT 's/' || p_partkey || '.txt' FROM part WHERE p_size > 10) AS missing FROM ({_PART_FILES}) f
""")
_add("read_delimited", """
SELECT "column", value, count(*) AS n FROM (
  SELECT unnest(['event_id', 'ts', 'user_id', 'event_type', 'value', 'props']) AS "column",
    unnest([CAST(event_id AS VARCHAR), CAST(ts AS VARCHAR), CAST(user_id AS VARCHAR), event_type, CAST(value AS VARCHAR), props]) AS value
  FROM events) GROUP BY ALL
""")
_add("read_quoted_delimited", f"""
SELECT "column", count(*) AS n, count(value) AS filled, count(DISTINCT value) AS distinct_values,
  sum(length(value)) AS chars, min(value) AS first_value, max(value) AS last_value
FROM (
  SELECT "column", CASE WHEN raw IN ({", ".join("'" + t.replace("'", "''") + "'" for t in MISSING_TOKENS)}) THEN NULL ELSE raw END AS value
  FROM (SELECT unnest(['doc_id', 'text', 'text.1', 'lang']) AS "column", unnest([CAST(doc_id AS VARCHAR), text, text, lang]) AS raw
        FROM documents))
GROUP BY "column"
""")
_add("preview_rows", """
SELECT event_type, row_number() OVER w - 1 AS row_pos, event_id, user_id, value FROM events
WINDOW w AS (PARTITION BY event_type ORDER BY event_id) QUALIFY row_number() OVER w <= 5
""")
_add("raw_text_head", "SELECT doc_id, substring(replace(text, chr(65533), ''), 1, 2000) AS head FROM documents")
_add("null_tokens", f"""
SELECT l_returnflag, CASE WHEN v IN ({_list(MISSING_TOKENS)}) THEN NULL ELSE v END AS value, count(*) AS n
FROM (SELECT l_returnflag, CASE WHEN l_orderkey % 40 < {len(MISSING_TOKENS)} THEN ([{_list(MISSING_TOKENS)}])[1 + l_orderkey % 40] ELSE l_linestatus END AS v FROM lineitem)
GROUP BY ALL
""")
_JSON = """'{"query_id":' || query_id || ',"entry_type":"' || entry_type || '","rank":' || rank || ',"key":"' || key || '","score":"' || printf('%.6f', round(score, 6)) || '"}'"""
_add("result_json", f"""
SELECT query_id, entry_type, rank, json, 'data:file/json;base64,' || base64(encode(json)) AS link
FROM (SELECT query_id, entry_type, rank, {_JSON} AS json FROM hits)
""", FULL)

# Text

_LINKED = """'see (' || url || '), ' || upper(url) || '; "' || url || '" <' || url || '/a,b.:> ' || html"""
_add("extract_urls", f"""
SELECT page_id, CAST(i - 1 AS BIGINT) AS pos, urls[i] AS url FROM (SELECT page_id, {_urls('t')} AS urls FROM (SELECT page_id, {_LINKED} AS t FROM pages)),
  LATERAL (SELECT unnest(range(1, len(urls) + 1)) AS i)
""")
_add("dedup_urls", f"""
SELECT lang, url, page_id, CAST(pos AS BIGINT) AS pos FROM (
  SELECT lang, urls[i] AS url, page_id, i - 1 AS pos FROM
    (SELECT page_id, lang, {_urls('t')} AS urls FROM (SELECT page_id, {LANG} AS lang, {_LINKED} || ' http://' || {LANG} || '.example/ ' AS t FROM pages)),
    LATERAL (SELECT unnest(range(1, len(urls) + 1)) AS i))
QUALIFY row_number() OVER (PARTITION BY lang, url ORDER BY page_id, pos) = 1
""")
_ORDERED_TOKENS = """
SELECT doc_id, count(*) AS n, string_agg(t, ' ' ORDER BY first) AS tokens FROM (
  SELECT doc_id, toks[i] AS t, min(i) AS first FROM (SELECT doc_id, {0} AS toks FROM documents), LATERAL (SELECT unnest(range(1, len(toks) + 1)) AS i) GROUP BY ALL)
GROUP BY doc_id
"""
for _name, _tokens in (("word_tokens", _words("text")), ("number_tokens", _numbers("text"))):
    _add(_name, f"""
SELECT d.doc_id, coalesce(n, 0) AS n, coalesce(tokens, '') AS tokens FROM documents d LEFT JOIN ({_ORDERED_TOKENS.format(_tokens)}) x ON x.doc_id = d.doc_id
""")
_add("dataset_text", """
SELECT c.key AS dataset, c.text || CASE WHEN l.doc_id IS NULL THEN '' ELSE chr(10) || 'quality toxic' || chr(10) || quality || ' ' || toxic END AS text
FROM corpus c LEFT JOIN labels l ON l.doc_id = c.ord WHERE entry_type = 'dataset'
""", CORPUS)
_add("dataset_text_urls", f"""
SELECT 'page_' || page_id AS dataset, array_to_string({_distinct('u')}, ' ') AS urls FROM (SELECT page_id, list_concat(
  {_urls('html')}, {_urls("'at ' || url || ', and ' || url || '#b.'")}, {_urls("url || '/folder;'")}) AS u FROM pages)
""")
_add("publication_text", "SELECT key, text FROM corpus WHERE entry_type = 'publication'", CORPUS)
_RAW_ANSWER = """chr(9) || ' ' || text || chr(10) || 'as an AI Language model I cannot' || chr(10) || 'say.  End  of' || chr(1) || chr(2) || 'turn ' || turn || ' As an ai language model'"""


def _clean(text: str) -> str:
    flat = rf"regexp_replace({text}, '[\x00-\x1f]', ' ', 'g')"
    said = rf"regexp_replace({flat}, '(?i)As an AI language model[^\n.]*[.\n]?', '', 'g')"
    return _strip(f"regexp_replace({said}, '[{SPACE}]{{2,}}', ' ', 'g')")


_add("clean_answers", f"SELECT conv_id, turn, {_clean(_RAW_ANSWER)} AS answer FROM conversations WHERE role = 'assistant'")
_add("parse_answers", f"""
SELECT conv_id, turn, content, array_to_string({_urls('content')}, ' ') AS urls, CASE WHEN turn > 1 THEN 'batch' ELSE 'unknown' END AS model, usage FROM (
  SELECT conv_id, turn, CASE WHEN turn = 3 THEN '{an.NO_CONTENT}' ELSE concat_ws(' ', text, url, url) END AS content, length(text) AS usage
  FROM conversations LEFT JOIN pages ON page_id = conv_id WHERE role = 'assistant')
""")


def _suggested(question: str) -> str:
    tests = []
    for phrase in an.SEARCH_PHRASES:
        found = " OR ".join(f"contains(lower({question}), {_text(w)})" for w in phrase.split())
        tests.append(f"CASE WHEN {found} THEN {_text(phrase)} END")
    return f"list_filter([{', '.join(tests)}], lambda p: p IS NOT NULL)"


_KEYWORD = " OR ".join(f"contains(lower(l), {_text(k)})" for k in KEYWORDS)


def _shown(lines: str) -> str:
    important = f"list_filter({lines}, lambda l: {_KEYWORD})"
    return f"CASE WHEN len({important}) > 0 THEN {important}[1:8] ELSE {lines}[1:6] END"


def _summary(question: str, shown: str, papers: str, urls: str) -> str:
    listed = f"array_to_string(list_transform({shown}, lambda l: '- ' || l), chr(10))"
    paper_text = f"array_to_string(list_transform({papers}[1:5], lambda p: '- ' || p.title || chr(10) || '  ' || p.link || chr(10)), '')"
    search = f"array_to_string(list_transform({_suggested(question)}, lambda p: {_text(an.SUGGESTION[0])} || p || {_text(an.SUGGESTION[1])}), '')"
    return f"""{_text(an.SUMMARY_TITLE)} || {question} || chr(10)
  || CASE WHEN len({shown}) > 0 THEN {listed} ELSE {_text(an.NO_LOCAL_DATA)} END
  || CASE WHEN len({papers}) > 0 THEN {_text(an.PUBLICATIONS_TITLE)} || {paper_text} ELSE '' END
  || CASE WHEN len({urls}) > 0 THEN {_text(an.URLS_TITLE)} || array_to_string({urls}[1:6], chr(10)) ELSE '' END
  || {_text(an.SUGGESTIONS_TITLE)} || {search}"""


_add("local_summary", f"""
SELECT doc_id, {_summary('question', 'shown', 'papers', 'urls')} AS summary FROM (
  SELECT doc_id, 'Any Gene in ' || source || '?' AS question, {_shown('lines')} AS shown,
    CASE WHEN pos IS NULL THEN [] ELSE [{{'title': title, 'link': link}}] END AS papers, CASE WHEN pos IS NULL THEN [] ELSE [link] END AS urls
  FROM (SELECT doc_id, source, {_lines('text')} AS lines FROM documents) LEFT JOIN publications ON pos = doc_id)
""", CATALOG)
_add("suggest_searches", f"""
SELECT conv_id, turn, array_to_string({_suggested('q')}, '|') AS suggestions FROM (SELECT conv_id, turn,
  concat_ws(' ', text, CASE turn % 5 WHEN 0 THEN 'MicroGravity' WHEN 1 THEN 'gene data' WHEN 2 THEN 'NASA' WHEN 3 THEN 'spaceflight' END) AS q FROM conversations)
""")
_add("candidate_list", """
SELECT query_id, entry_type, rank, key AS label, round(score, 6) AS score FROM hits WHERE entry_type = 'dataset'
UNION ALL SELECT query_id, entry_type, rank, substring(title, 1, 80) || '...', round(score, 6) FROM hits JOIN publications ON key = 'pub_' || pos WHERE rank <= 3
""", FULL)

# Index

_add("corpus", "SELECT ord, key, entry_type, text FROM corpus", CORPUS)
_add("index_counts", "SELECT entry_type, count(*) AS entries FROM corpus GROUP BY entry_type", CORPUS)
_add("terms", "SELECT ord, len(terms) AS n, md5(array_to_string(terms, '|')) AS digest FROM doc_terms", FULL)
_add("term_freq", "SELECT ord, term, tf FROM doc_tf", FULL)
_add("vocabulary", "SELECT term, df, total FROM vocab", FULL)
_add("idf", "SELECT term, round(idf, 6) AS idf FROM idf", FULL)
_add("tfidf_weights", "SELECT ord, term, round(weight, 6) AS weight FROM doc_w", FULL)
_add("query_weights", "SELECT query_id, term, round(weight, 6) AS weight FROM q_w", FULL)
_add("index_roundtrip", HITS, INDEX.replace(STOP, _list(ENGLISH[:40])).replace("{cap}", "500").strip())

# Ranking

_add("cosine_sim", "SELECT query_id, ord, round(sim, 6) AS sim FROM sims", FULL)
_add("token_overlap", "SELECT query_id, ord, round(overlap, 6) AS overlap FROM word_overlap", FULL)
_add("number_boost", "SELECT query_id, ord, CAST(boost AS DOUBLE) AS boost FROM boosts", FULL)
_add("blended_score", """
SELECT query_id, ord, round(sim, 6) AS sim, round(overlap, 6) AS overlap, boost, round(score, 6) AS score FROM scored
""", FULL)
_add("search", HITS, FULL)
_add("search_parsed_catalog", HITS, FULL)
_add("rank_no_vocab", HITS, NO_VOCAB)
_add("search_publications", """
SELECT query_id, rank, title, link, round(score, 6) AS score, round(sim, 6) AS sim, round(overlap, 6) AS overlap FROM hits JOIN publications ON key = 'pub_' || pos
""", FULL)
_add("search_datasets", """
SELECT query_id, rank, key, organism, assay_types, description, round(score, 6) AS score FROM hits LEFT JOIN catalog ON key = dataset WHERE entry_type = 'dataset'
""", FULL)

# Profiles


def _long(table: str, columns: dict[str, str], name: str = "column") -> str:
    names = ", ".join(f"'{c}'" for c in columns)
    values = ", ".join(f"CAST({v} AS VARCHAR)" for v in columns.values())
    return f'SELECT \'{table}\' AS dataset, unnest([{names}]) AS "{name}", unnest([{values}]) AS value FROM {table}'


COLUMNS = {
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "lineitem": [
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        "l_returnflag", "l_linestatus", "l_shipdate",
    ],
    "pages": ["page_id", "url", "html"],
    "labels": ["doc_id", "quality", "toxic"],
}
TEXT_COLUMNS = {
    "c_name", "c_mktsegment", "o_orderstatus", "o_orderdate", "o_orderpriority", "ts", "event_type", "props",
    "p_name", "p_brand", "p_type", "l_returnflag", "l_linestatus", "l_shipdate", "url", "html",
}
_ODD = {
    "flag": "c_custkey % 2 = 1",
    "flag_or_none": "CASE WHEN c_custkey % 5 > 0 THEN c_custkey % 2 = 1 END",
    "mixed": "CASE WHEN c_custkey % 7 = 0 THEN '1d' ELSE CAST(c_custkey AS VARCHAR) END",
    "spread": "' ' || c_nationkey || '.0'",
    "nothing": "CAST(NULL AS VARCHAR)",
}
_CELLS = " UNION ALL ".join(
    _long(t, {c: c for c in COLUMNS[t]} | (_ODD if t == "customer" else {})) for t in ("customer", "orders", "events", "part")
)
_IS_NUMBER = r"regexp_full_match(trim(value), '(?i)[+-]?(?:[0-9]+\.?[0-9]*(?:e[+-]?[0-9]+)?|\.[0-9]+(?:e[+-]?[0-9]+)?|inf(?:inity)?)')"
_KINDS = f"""
cells AS ({_CELLS}),
kinds AS (SELECT dataset, "column", count(value) > 0 AND coalesce(bool_and({_IS_NUMBER}) FILTER (value IS NOT NULL)
    OR (count(value) = count(*) AND bool_and(lower(value) IN ('true', 'false'))), FALSE) AS "numeric" FROM cells GROUP BY ALL)
"""
_add("detect_numeric", 'SELECT dataset, "column", "numeric" FROM kinds', _KINDS)
_add("profile_counts", """
SELECT dataset, "column", count(value) AS "count",
  CASE WHEN any_value("numeric") AND count(TRY_CAST(value AS DOUBLE)) = count(value) THEN count(DISTINCT TRY_CAST(value AS DOUBLE)) ELSE count(DISTINCT value) END AS "unique"
FROM cells JOIN kinds USING (dataset, "column") GROUP BY ALL
""", _KINDS)


def _frame_cells(table: str, columns: list[str], dataset: str = "''", file_pos: int = 0, source: str | None = None) -> str:
    """Cells of a typed table: number or text, by column."""
    rows = []
    for i, c in enumerate(columns):
        num = "NULL" if c in TEXT_COLUMNS else f"CAST({c} AS DOUBLE)"
        txt = f"CAST({c} AS VARCHAR)" if c in TEXT_COLUMNS else "NULL"
        rows.append(
            f"SELECT {dataset} AS dataset, CAST({file_pos} AS BIGINT) AS file_pos, CAST({i} AS BIGINT) AS col_pos, '{c}' AS \"column\", "
            f"{c not in TEXT_COLUMNS} AS \"numeric\", CAST({num} AS DOUBLE) AS num, CAST({txt} AS VARCHAR) AS txt FROM {source or table}"
        )
    return " UNION ALL ".join(rows)


PROFILE = """
cells AS ({cells}),
freq AS (SELECT dataset, file_pos, col_pos, num, txt, count(*) AS n FROM cells WHERE num IS NOT NULL OR txt IS NOT NULL GROUP BY ALL),
tops AS (SELECT *, row_number() OVER (PARTITION BY dataset, file_pos, col_pos ORDER BY n DESC, num NULLS FIRST, txt NULLS FIRST) AS rank,
  CAST(format('{{:.2f}}', 100.0 * n / sum(n) OVER (PARTITION BY dataset, file_pos, col_pos)) AS DOUBLE) AS pct,
  coalesce(txt, CAST(num AS VARCHAR)) AS value FROM freq QUALIFY rank <= 6),
top_lists AS (SELECT dataset, file_pos, col_pos, list({{'value': value, 'n': n, 'pct': pct}} ORDER BY rank) AS top FROM tops GROUP BY ALL),
stats AS (SELECT dataset, file_pos, col_pos, "column", "numeric", count(coalesce(CAST(num AS VARCHAR), txt)) AS "count",
  count(DISTINCT coalesce(CAST(num AS VARCHAR), txt)) AS "unique", avg(num) AS mean, median(num) AS median,
  CASE WHEN count(num) > 0 THEN coalesce(stddev_samp(num), 0.0) END AS std, min(num) AS "min", max(num) AS "max" FROM cells GROUP BY ALL),
profiles AS (SELECT * FROM stats LEFT JOIN top_lists USING (dataset, file_pos, col_pos)),
lines AS (SELECT dataset, file_pos, col_pos, "column", top, CASE WHEN "count" = 0 THEN NULL WHEN "numeric" THEN 'Column: ' || "column" || ' [numeric] count=' || "count"
    || ' mean=' || format('{{:.3f}}', mean) || ' median=' || format('{{:.3f}}', median) || ' std=' || format('{{:.3f}}', std)
    || ' top=' || array_to_string(list_transform(top[1:4], lambda v: v.value || ' (' || v.pct || '%)'), ', ')
  ELSE 'Column: ' || "column" || ' [categorical] count=' || "count" || ' unique=' || "unique"
    || ' top=' || array_to_string(list_transform(top, lambda v: '''' || v.value || ''' (' || v.pct || '%)'), ', ') END AS line FROM profiles)
"""
_LINEITEM = PROFILE.format(cells=_frame_cells("lineitem", COLUMNS["lineitem"])).strip()
_STATS = 'round(mean, 4) AS mean, round(median, 4) AS median, round(std, 4) AS std, round("min", 4) AS "min", round("max", 4) AS "max"'
_add("profile_numeric", f'SELECT col_pos, {_STATS} FROM stats WHERE "numeric"', _LINEITEM)
_add("profile_top_values", 'SELECT col_pos, rank, value, round(num, 4) AS num, n AS "count", round(pct, 4) AS pct FROM tops', _LINEITEM)
_add("profile_large_ids", """
SELECT unnest([0, 1]::BIGINT[]) AS col_pos, CAST(rank AS BIGINT) AS rank, value, n AS "count", "unique" FROM (
  SELECT CAST(id AS VARCHAR) AS value, n, row_number() OVER (ORDER BY n DESC, CAST(id AS DOUBLE), CAST(id AS VARCHAR)) AS rank, count(*) OVER () AS "unique"
  FROM (SELECT event_id % 1000 + 9007199254740992 AS id, count(*) AS n FROM events GROUP BY 1)) WHERE rank <= 6
""")
_add("profile_empty", """
SELECT CAST(quality AS VARCHAR) AS dataset, c AS "column", CASE WHEN count(v) = 0 THEN 'empty' END AS note, count(v) AS "count" FROM (
  SELECT quality, unnest(['toxic', 'good']) AS c, unnest([CAST(toxic AS VARCHAR), CASE WHEN quality = 1 THEN 'yes' END]) AS v FROM labels) GROUP BY quality, c
""")
_add("profile_table", f"""
SELECT col_pos, "column", "count", "unique", "numeric", {_STATS}, array_to_string(list_transform(top, lambda v: v.value || '=' || v.n), '; ') AS top FROM profiles
""", _LINEITEM)
_add("render_columns", "SELECT col_pos, line FROM lines", _LINEITEM)
_add("profile_merge", """
SELECT dataset, "column", CAST(min(file_pos) AS BIGINT) AS file_pos, CAST(arg_min(col_pos, file_pos) AS BIGINT) AS col_pos, arg_max(c, file_pos) AS "count",
  arg_max(u, file_pos) AS "unique", round(arg_max(m, file_pos), 4) AS median FROM (
  SELECT o_orderstatus AS dataset, 0 AS file_pos, 0 AS col_pos, 'key' AS "column", count(*) AS c, count(DISTINCT o_orderkey) AS u, median(o_orderkey) AS m FROM orders GROUP BY ALL
  UNION ALL SELECT o_orderstatus, 0, 1, 'price', count(*), count(DISTINCT o_totalprice), median(o_totalprice) FROM orders GROUP BY ALL
  UNION ALL SELECT l_linestatus, 1, 0, 'quantity', count(*), count(DISTINCT l_quantity), median(l_quantity) FROM lineitem GROUP BY ALL
  UNION ALL SELECT l_linestatus, 1, 1, 'price', count(*), count(DISTINCT l_extendedprice), median(l_extendedprice) FROM lineitem GROUP BY ALL)
GROUP BY dataset, "column"
""")

# Contexts and answers

_add("preview_block", """
SELECT CAST(c_nationkey AS BIGINT) AS c_nationkey, 'c_custkey c_name c_mktsegment' || chr(10) || string_agg(c_custkey || ' ' || c_name || ' ' || c_mktsegment, chr(10) ORDER BY c_custkey) AS text
FROM (SELECT * FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) <= 5) GROUP BY c_nationkey
""")
_add("top_value_urls", f"""
vals AS (SELECT {LANG} AS dataset, unnest([0, 1]) AS col_pos, unnest(['<' || url || '>', regexp_extract(url, '^https?://[^/]+')]) AS value FROM pages),
tops AS (SELECT dataset, col_pos, value, row_number() OVER (PARTITION BY dataset, col_pos ORDER BY count(*) DESC, value) AS rank FROM vals GROUP BY dataset, col_pos, value QUALIFY rank <= 6),
found AS (SELECT dataset, col_pos, rank, {_urls('value')}[1] AS url FROM tops)
SELECT dataset, url, CAST(col_pos AS BIGINT) AS col_pos, rank, CAST(0 AS BIGINT) AS pos FROM found
QUALIFY row_number() OVER (PARTITION BY dataset, url ORDER BY col_pos, rank) = 1
""", " ")

_WAREHOUSE = [
    ("sales", 0, "customer", "c_custkey"), ("sales", 1, "orders", "o_orderkey"), ("sales", 2, "part", "p_partkey"),
    ("web", 0, "events", "event_id"), ("web", 1, "pages", "page_id"), ("web", 2, "labels", "doc_id"),
]


def _preview(dataset: str, pos: int, table: str, order: str) -> str:
    row = " || ' ' || ".join(f"coalesce(CAST({c} AS VARCHAR), 'NaN')" for c in COLUMNS[table])
    return f"""
SELECT '{dataset}' AS dataset, CAST({pos} AS BIGINT) AS file_pos, 0 AS section, CAST(0 AS BIGINT) AS col_pos, 'FILE PREVIEW: {table}.tsv' || chr(10)
  || '{' '.join(COLUMNS[table])}' || chr(10) || (SELECT string_agg(r, chr(10) ORDER BY o) FROM (SELECT {order} AS o, {row} AS r FROM {table} ORDER BY {order} LIMIT 5)) AS block"""


WAREHOUSE = (
    PROFILE.format(cells=" UNION ALL ".join(_frame_cells(t, COLUMNS[t], f"'{d}'", p) for d, p, t, _ in _WAREHOUSE)).strip()
    + f""",
described AS (SELECT 'sales' AS dataset, 'Sales from ' || min(r_name) AS description FROM region
  UNION ALL SELECT 'web', 'Events of (see ' || arg_min(url, page_id) || ')' FROM pages),
blocks AS (SELECT dataset, CAST(-1 AS BIGINT) AS file_pos, 0 AS section, CAST(0 AS BIGINT) AS col_pos, 'Description: ' || description AS block FROM described
  UNION ALL SELECT 'web', 3, 0, 0, 'FILE: archive - (missing)'
  UNION ALL SELECT dataset, file_pos, 1, col_pos, line FROM lines WHERE line IS NOT NULL
  UNION ALL {' UNION ALL '.join(_preview(*f) for f in _WAREHOUSE)}),
texts AS (SELECT dataset, string_agg(block, chr(10) ORDER BY file_pos, section, col_pos) AS context FROM blocks GROUP BY dataset),
found AS (SELECT dataset, CAST(-1 AS BIGINT) AS file_pos, CAST(0 AS BIGINT) AS col_pos, CAST(0 AS BIGINT) AS rank, {_urls('description')} AS urls FROM described
  UNION ALL SELECT dataset, file_pos, col_pos, rank, {_urls('value')} FROM tops WHERE contains(lower(value), 'http')),
firsts AS (SELECT dataset, url, min((file_pos, col_pos, rank)) AS place FROM (SELECT dataset, file_pos, col_pos, rank, unnest(urls) AS url FROM found) GROUP BY ALL),
links AS (SELECT dataset, string_agg(url, ' ' ORDER BY place) AS urls FROM firsts GROUP BY dataset),
merged AS (SELECT dataset, string_agg("column" || '=' || "count", ' ' ORDER BY file_pos, col_pos) AS columns FROM profiles GROUP BY dataset),
contexts AS (SELECT dataset, context, coalesce(urls, '') AS urls, columns FROM texts LEFT JOIN links USING (dataset) LEFT JOIN merged USING (dataset))
"""
)
_add("dataset_context", "SELECT dataset, context, urls, columns FROM contexts", WAREHOUSE)
_add("dataset_details", "SELECT dataset, context, urls, columns FROM contexts WHERE dataset = 'web'", WAREHOUSE)


def _label_line(column: str) -> str:
    return (
        f"chr(10) || 'Column: {column} [numeric] count=1 mean=' || format('{{:.3f}}', CAST({column} AS DOUBLE)) || ' median=' || format('{{:.3f}}', CAST({column} AS DOUBLE)) "
        f"|| ' std=0.000 top=' || CAST(CAST({column} AS DOUBLE) AS VARCHAR) || ' (100.0%)'"
    )


# A document has one row of labels at most, so its column profiles are written out directly.
CONTEXTS = (
    FULL
    + f""",
contexts AS (SELECT dataset, doc_id IS NOT NULL AS labelled, CASE WHEN description <> '' THEN 'Description: ' || description || chr(10) ELSE '' END || CASE WHEN doc_id IS NULL THEN 'FILE: labels - (missing)'
  ELSE 'FILE PREVIEW: labels.tsv' || chr(10) || 'quality toxic' || chr(10) || quality || ' ' || toxic || {_label_line('quality')} || {_label_line('toxic')} END AS context
  FROM catalog LEFT JOIN labels ON doc_id = pos),
papers AS (SELECT query_id, rank, title, link, score FROM hits JOIN publications ON key = 'pub_' || pos),
q_blocks AS (SELECT query_id, 0 AS section, rank, '--- Dataset: ' || key || ' (score=' || format('{{:.3f}}', score) || ') ---' || chr(10) || context AS block FROM hits JOIN contexts ON key = dataset
  UNION ALL SELECT query_id, 1, 0, '--- Related Research Publications ---' FROM papers WHERE rank = 1
  UNION ALL SELECT query_id, 2, rank, 'Publication: ' || title || chr(10) || 'Link: ' || link || chr(10) || 'Relevance Score: ' || format('{{:.3f}}', score) FROM papers),
combined AS (SELECT query_id, text AS question, coalesce(context, '') AS context FROM questions LEFT JOIN
  (SELECT query_id, {_strip("string_agg(block, chr(10) || chr(10) ORDER BY section, rank)")} AS context FROM q_blocks GROUP BY query_id) USING (query_id))
"""
)
_add("combined_context", "SELECT query_id, context, context = '' AS no_context FROM combined", CONTEXTS)
_add("prompt_table", f"""
SELECT query_id, {_text(an.INSTRUCTIONS)} || chr(10) || chr(10) || 'CONTEXT:' || chr(10) || CASE WHEN context = '' THEN {_text(an.NO_CONTEXT_MARK)} ELSE context END
  || chr(10) || chr(10) || 'QUESTION:' || chr(10) || question || CASE WHEN context = '' THEN {_text(an.NO_CONTEXT_NOTE)} ELSE '' END AS prompt FROM combined
""", CONTEXTS)
ANSWERS = f"""
answers AS (SELECT query_id, content, {_urls('content')} AS urls, usage FROM (
  SELECT item_id AS query_id, t || chr(10) || 'As an AI language model I may err. See ' || url || '.' AS content, length(t) AS usage
  FROM benchmark JOIN (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn NULLS FIRST, text) AS t FROM conversations
    WHERE role = 'assistant' AND text IS NOT NULL GROUP BY conv_id) ON conv_id = item_id
  JOIN pages ON page_id = item_id))
"""
_add("recommended_urls", f"""
, found AS (SELECT query_id, 0 AS source, 0 AS rank, i - 1 AS pos, urls[i] AS url FROM answers, LATERAL (SELECT unnest(range(1, len(urls) + 1)) AS i)
  UNION ALL SELECT query_id, 1, rank, 0, link FROM hits JOIN publications ON key = 'pub_' || publications.pos WHERE link <> ''
  UNION ALL SELECT query_id, 2, rank, i - 1, urls[i] FROM (SELECT query_id, rank, {_urls("(description || ' http://docs.example/' || organism)")} AS urls FROM hits JOIN catalog ON key = dataset),
    LATERAL (SELECT unnest(range(1, len(urls) + 1)) AS i))
SELECT query_id, url, CAST(source AS BIGINT) AS source, CAST(rank AS BIGINT) AS rank, CAST(pos AS BIGINT) AS pos FROM found
QUALIFY row_number() OVER (PARTITION BY query_id, url ORDER BY source, rank, pos) = 1
""", FULL + "," + ANSWERS)
_add("ask_batch", f"""
, used AS (SELECT query_id, list({{'title': title, 'link': link}} ORDER BY rank) AS papers, string_agg(link || ':' || format('{{:.4f}}', round(score, 4)), ' ' ORDER BY rank) AS used_publications FROM papers GROUP BY query_id),
sets AS (SELECT query_id, string_agg(key || ':' || format('{{:.4f}}', round(score, 4)), ' ' ORDER BY rank) AS used_datasets,
  string_agg(key || ':' || CASE WHEN labelled THEN 2 ELSE 0 END, ' ' ORDER BY rank) AS structured FROM hits JOIN contexts ON key = dataset GROUP BY query_id),
base AS (SELECT query_id, question, {_shown('lines')} AS shown, coalesce(papers, []) AS papers, content, urls, usage, used_datasets, used_publications, structured
  FROM (SELECT *, {_lines('context')} AS lines FROM combined) LEFT JOIN used USING (query_id) LEFT JOIN sets USING (query_id) LEFT JOIN answers USING (query_id)),
listed AS (SELECT *, list_concat(list_transform(papers, lambda p: p.link), urls) AS all_urls FROM base)
SELECT query_id, CASE WHEN content IS NULL THEN {_summary('question', 'shown', 'papers', "CAST([] AS VARCHAR[])")} ELSE {_clean('content')} END AS answer,
  CASE WHEN content IS NULL THEN '' ELSE array_to_string({_distinct('all_urls')}, ' ') END AS recommended_urls,
  coalesce(used_datasets, '') AS used_datasets, coalesce(used_publications, '') AS used_publications, content IS NULL AS fallback, CASE WHEN content IS NOT NULL THEN 'batch' END AS model, usage, coalesce(structured, '') AS structured FROM listed
""", CONTEXTS + "," + ANSWERS)
_add("metadata_bundle", f"""
SELECT query_id, fallback, CAST(usage AS BIGINT) AS usage, nullif(split_part(used_datasets, ':', 1), '') AS dataset, structured_first AS structured,
  nullif(regexp_replace(split_part(used_publications, ' ', 1), ':[^:]*$', ''), '') AS publication, true AS same
FROM (SELECT *, nullif(split_part(structured, ':', 1), '') AS structured_first FROM ({ORACLES["ask_batch"]}))
""")
