"""The registered queries in DuckDB's SQL, over the same tables."""

from __future__ import annotations


def norm(x: str) -> str:
    return f"trim(regexp_replace(translate(lower({x}), 'ё', 'е'), '[\\s\\p{{Z}}]+', ' ', 'g'))"


def toks(x: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({norm(x)}, ''), '[^a-zA-Zа-яА-Я0-9]+'), lambda t: t <> '')"


def words(x: str) -> str:
    return f"regexp_extract_all(lower(coalesce({x}, '')), '([\\p{{L}}\\p{{N}}_]+)', 1)"


def key(category: str = "category", doc_id: str = "doc_id", doc_path: str = "doc_path") -> str:
    return f"coalesce(nullif({category}, ''), 'UNK') || '::' || coalesce(nullif({doc_id}, ''), nullif({doc_path}, ''), 'doc')"


def sents(x: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array(regexp_replace(coalesce({x}, ''), '([.!?…])\\s+', '\\1' || chr(1), 'g'), '[\\n' || chr(1) || ']+'), lambda s: trim(s)), lambda s: s <> '')"


def count(x: str) -> str:
    return f"greatest(1, length({x}) // 4)"


def path(x: str) -> str:
    return f"array_to_string(list_filter(list_transform(regexp_split_to_array(coalesce({x}, ''), '[/_\\-.()\\\\]+'), lambda p: trim(regexp_replace(p, '[\\s\\p{{Z}}]+', ' ', 'g'))), lambda p: p <> '' AND NOT regexp_matches(p, '^\\d+$')), ' ')"


def vec(tokens: str) -> str:
    """Raw counts of a token list's places."""
    return f"list_transform(range(64), lambda k: len(list_filter(list_transform({tokens}, lambda t: ('0x' || substr(md5(t), 1, 8))::BIGINT % 64), lambda b: b = k))::DOUBLE)"


def unit(v: str) -> str:
    return f"list_transform({v}, lambda x: x / (sqrt(list_sum(list_transform({v}, lambda y: y * y))) + 1e-12))"


def dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(range(1, len({a}) + 1), lambda i: {a}[i]::DOUBLE * {b}[i]::DOUBLE))"


NUMBER = r"^\s*(\d+(?:\.\d+)*)"
SECTION_WORD = r"(?i)^\s*(?:раздел|глава|приложение)\s+(\d+)"


def section(x: str) -> str:
    return f"coalesce(nullif(regexp_extract({x}, '{NUMBER}', 1), ''), nullif(regexp_extract({x}, '{SECTION_WORD}', 1), ''))"


def parts(x: str) -> str:
    return f"(CASE WHEN {x} IS NULL THEN 0 ELSE len(string_split({x}, '.')) END)"


ELEMENTS = "(SELECT DISTINCT ON (id) * FROM elements)"
CHUNKS = "(SELECT DISTINCT ON (id) * FROM chunks)"
FOLDERS = r"list_filter(string_split(coalesce(replace(category, '\', '/'), ''), '/'), lambda x: x <> '')"

INDEXED = f"""q AS (SELECT item_id AS query_id, {unit('v')} AS query_vec FROM (SELECT item_id, {vec('t')} AS v FROM (SELECT item_id, {toks('text')} AS t FROM eval_items))),
c AS (SELECT * EXCLUDE (v), {unit('v')} AS vec FROM (SELECT *, {vec('t')} AS v FROM (SELECT id, {key()} AS doc_key, chunk_index, from_order, to_order, text, heading_path, page_from, page_to, {toks('text')} AS t FROM {CHUNKS} WHERE text IS NOT NULL))),
near AS (SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT query_id, id, round({dot('query_vec', 'vec')}, 9) AS score FROM q, c)) WHERE rank <= {{k}})"""

NEAR = INDEXED.replace("{k}", "50")

HITS = f"(SELECT category AS query_id, string_split(category, '/')[-1] AS query, {key()} AS doc_key, id, category, doc_path, chunk_index, text, heading_path, page_from, page_to, (('0x' || substr(md5(id), 1, 6))::BIGINT % 1000003) / 1000003 AS score FROM {CHUNKS} WHERE category IS NOT NULL AND text IS NOT NULL)"

SECTION_ID = f"""CASE WHEN heading_path IS NULL OR len(heading_path) = 0 THEN 'root' ELSE coalesce(list_filter(list_transform(heading_path, lambda h: regexp_extract(h, '{NUMBER}', 1)), lambda n: n <> '')[1], replace(substr(heading_path[1], 1, 20), ' ', '_')) END"""
LEVEL = f"coalesce(list_max(list_transform(heading_path, lambda h: {parts(section('h'))})), 0)"
PREVIEW = "coalesce(array_to_string(heading_path[1:2], ' > '), '')"

HIERARCHY = f"SELECT query_id, doc_key, round(round(sum(CASE WHEN coalesce(len(heading_path), 0) > 0 THEN 0.8::DOUBLE / (1 + 0.1::DOUBLE * len(heading_path)) ELSE 0 END) / greatest(0.8::DOUBLE * count(*), 1.0), 9), 6) AS hierarchy FROM {HITS} GROUP BY ALL"

PREPARED = f"(SELECT *, {key()} AS doc_key, coalesce(len(headings_path), 0) > 0 AS has_path, coalesce({section('coalesce(text, $$$$)')}, 'section_' || substr(id, 1, 8)) AS section FROM {ELEMENTS})"
IMPORTANCE = f"SELECT doc_key, section, count(*) AS elements, round(0.3::DOUBLE * count(*) + 0.4::DOUBLE * least(coalesce(sum(length(text)), 0) / 1000, 1.0) + 0.3::DOUBLE * count(*) FILTER (element_type IN ('table', 'formula', 'image')), 6) AS importance FROM (SELECT {key()} AS doc_key, coalesce({section('coalesce(text, $$$$)')}, 'general') AS section, element_type, text FROM {ELEMENTS}) GROUP BY ALL"
FOLDER_NODES = f"(SELECT DISTINCT 'folder::' || array_to_string(p[1:n], '/') AS id, p[n] AS name, (n - 1)::INTEGER AS level, round(1 / n, 6) AS importance, CASE WHEN n > 1 THEN 'folder::' || array_to_string(p[1:n - 1], '/') END AS parent FROM (SELECT p, unnest(range(1, len(p) + 1)) AS n FROM (SELECT DISTINCT {FOLDERS} AS p FROM elements)))"
DOC_NODES = f"(SELECT 'document::' || doc_key AS id, min(category) AS category, count(*) AS element_count, min(date) AS date FROM (SELECT {key()} AS doc_key, category, parsed_at::DATE AS date FROM (SELECT DISTINCT ON (id) id, category, doc_id, doc_path, parsed_at FROM elements ORDER BY id, parsed_at)) GROUP BY doc_key)"


def graph_ctes(prepared: str = PREPARED) -> str:
    """The graph's tables, each computed once."""
    return f"""prepared AS MATERIALIZED {prepared},
importance AS MATERIALIZED ({IMPORTANCE}), folders AS MATERIALIZED {FOLDER_NODES}, docs AS MATERIALIZED {DOC_NODES},
sections AS MATERIALIZED (SELECT 'section::' || s.doc_key || '::' || s.section AS id, s.doc_key, s.section, heading, level, element_count, coalesce(importance, 0.5) AS importance FROM (
SELECT doc_key, section, count(*) AS element_count, arg_min(struct_pack(h := substr(text, 1, 100), l := list_max(list_transform(headings_path, lambda h: {parts(section('h'))}))), struct_pack(a := coalesce(page, 0), b := coalesce(elem_order, 0), c := id)) AS x, struct_extract(x, 'h') AS heading, struct_extract(x, 'l') AS level FROM prepared WHERE has_path GROUP BY doc_key, section) s LEFT JOIN importance i USING (doc_key, section)),
refs AS MATERIALIZED (SELECT DISTINCT a.id AS src, b.id AS dst FROM (SELECT doc_key, section, unnest(list_filter(regexp_extract_all(text, '(?i)(?:раздел|глава|пункт)[а-я]*\\s+(\\d+(?:\\.\\d+)*)', 1), lambda x: x <> own)) AS target FROM (SELECT *, regexp_extract(text, '{NUMBER}', 1) AS own FROM prepared) WHERE own <> '') r JOIN sections a ON a.doc_key = r.doc_key AND a.section = r.section JOIN sections b ON b.doc_key = r.doc_key AND b.section = r.target),
edges AS MATERIALIZED (SELECT parent AS src, id AS dst, 'refines' AS rel, 1.0::DOUBLE AS weight FROM folders WHERE parent IS NOT NULL
UNION ALL SELECT 'folder::' || array_to_string({FOLDERS}, '/'), id, 'contains', 1.0 FROM docs WHERE coalesce(category, '') <> ''
UNION ALL SELECT 'document::' || doc_key, id, 'has_section', importance FROM sections
UNION ALL SELECT 'section::' || doc_key || '::' || section, 'element::' || id, 'contains_element', 1.0 FROM prepared WHERE has_path
UNION ALL SELECT src, dst, 'references', 0.8 FROM refs),
nodes AS MATERIALIZED (SELECT id, 'folder' AS type, level, importance, NULL::VARCHAR AS doc_key, NULL::DATE AS date FROM folders UNION ALL SELECT id, 'document', NULL, NULL, id[11:], date FROM docs UNION ALL SELECT id, 'section', level, importance, doc_key, NULL FROM sections UNION ALL SELECT 'element::' || id, element_type, NULL, NULL, doc_key, NULL FROM prepared WHERE has_path)"""


GRAPH = graph_ctes()


def pagerank(rounds: int = 20) -> str:
    """CTEs r0 … r20 over the whole graph."""
    out = """outs AS (SELECT src, sum(weight) AS w FROM edges GROUP BY src), n AS (SELECT count(*)::DOUBLE AS n FROM nodes),
p AS MATERIALIZED (SELECT e.src, e.dst, e.weight / o.w AS p FROM edges e JOIN outs o USING (src)),
r0 AS MATERIALIZED (SELECT id, id IN (SELECT src FROM outs) AS linked, 1 / n AS rank FROM nodes, n)"""
    for k in range(rounds):
        out += f""",
r{k + 1} AS MATERIALIZED (SELECT r.id, r.linked, 0.15 / n.n + 0.85 * (coalesce(f.flow, 0) + (SELECT coalesce(sum(rank), 0) FROM r{k} WHERE NOT linked) / n.n) AS rank
FROM r{k} r CROSS JOIN n LEFT JOIN (SELECT p.dst AS id, sum(q.rank * p.p) AS flow FROM p JOIN r{k} q ON q.id = p.src GROUP BY p.dst) f USING (id))"""
    return out


NAV = "concat_ws(' ', path_text, heading_text)"
BM25 = f"""d AS (SELECT doc_key, {toks(NAV)} AS t FROM doc_fields_meta),
post AS (SELECT token, doc_key, len, count(*) AS tf FROM (SELECT doc_key, len(t) AS len, unnest(t) AS token FROM d) GROUP BY ALL),
size AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM d WHERE len(t) > 0),
raw AS (SELECT token, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS idf FROM (SELECT token, count(*) AS df FROM post GROUP BY token), size),
idf AS (SELECT token, CASE WHEN idf < 0 THEN 0.25::DOUBLE * (SELECT avg(idf) FROM raw) ELSE idf END AS idf FROM raw),
terms AS (SELECT item_id AS query_id, unnest({toks('text')}) AS token FROM eval_items),
b AS (SELECT query_id, doc_key, round(sum(idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean))), 6) AS bm25 FROM terms JOIN idf USING (token) JOIN post USING (token), size GROUP BY ALL)"""

DOMAIN = (
    "CASE WHEN regexp_matches(low, 'договор|контракт|соглашение|юридический|правовой') THEN 'Юристы' WHEN regexp_matches(low, 'поставка|доставка|отгрузка|транспорт|логистика') THEN 'Логистика' "
    "WHEN regexp_matches(low, 'закупка|тендер|конкурс|поставщик|снабжение') THEN 'Закупки' WHEN regexp_matches(low, 'производство|цех|линия|изготовление|выпуск') THEN 'Производство' "
    "WHEN regexp_matches(low, 'оплата|счет|бюджет|финансы|расчет') THEN 'Финансы' WHEN regexp_matches(low, 'сотрудник|вакансия|персонал|кадры|hr') THEN 'HR' END"
)
TERMS = "['EXW', 'FCA', 'CPT', 'CIP', 'DAT', 'DAP', 'DDP', 'FAS', 'FOB', 'CFR', 'CIF']"
SPACE, LETTER = "[\\t\\n\\x0B\\f\\r ]", "[\\p{L}\\p{N}\\p{M}_]"


def found(*patterns: str) -> str:
    """All matches of each pattern in turn."""
    return " || ".join(f"regexp_extract_all(text, '{p}', 0)" for p in patterns)


UNICODE_SPACE = "[\\s\\x0B\\x{85}\\p{Z}]"
STANDARDS = f"list_distinct({found(f'(?i)ГОСТ{SPACE}*[0-9.-]+', f'(?i)ТУ{SPACE}*[0-9.-]+')})"
IDENTIFIERS = f"list_distinct({found(f'(?i)№{SPACE}*[0-9/-]+', f'(?i)договор{SPACE}+[0-9/-]+', f'(?i)контракт{SPACE}+[0-9/-]+')})"
ORGANISATIONS = "list_distinct(" + found(*[x for kind in ("ООО", "АО", "ПАО") for x in (f'{kind}{SPACE}+"[^"]+"', f"{kind}{UNICODE_SPACE}+{LETTER}+")]) + f" || list_transform(regexp_extract_all(text, '(?:^|[^\\p{{L}}])((?:ООО|ПАО|ЗАО|АО){SPACE}+«[^»]+»)', 1), lambda x: x))"
DATE_LISTS = [f"regexp_extract_all(text, '{p}', 0)" for p in (f"до{UNICODE_SPACE}+[0-9]{{1,2}}{UNICODE_SPACE}+{LETTER}+{UNICODE_SPACE}+[0-9]{{4}}", "[0-9]{4}[-.][0-9]{1,2}[-.][0-9]{1,2}", "[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{2,4}")]
DATES = f"CASE WHEN len({DATE_LISTS[0]}) > 0 THEN {DATE_LISTS[0]} WHEN len({DATE_LISTS[1]}) > 0 THEN {DATE_LISTS[1]} ELSE {DATE_LISTS[2]} END"
QUANTITY = f"(?i)([0-9]+(?:[.][0-9]+)?){SPACE}*(тонн|т|кг|м3|куб[.]м|шт|штук)"
AMOUNT = f"CASE WHEN regexp_matches(text, '{QUANTITY}') THEN struct_pack(value := regexp_extract(text, '{QUANTITY}', 1)::DOUBLE, unit := coalesce(map {{'т': 'тонн', 'кг': 'килограмм', 'шт': 'штук', 'куб.м': 'м3'}}[regexp_extract(text, '{QUANTITY}', 2)], regexp_extract(text, '{QUANTITY}', 2))) END"
TEXTS = "(SELECT doc_id, text, lower(text) AS low FROM documents WHERE text IS NOT NULL)"
STATIONS = "(SELECT doc_id, entry AS station, CASE WHEN strpos(low, 'станци') > 0 AND strpos(low, 'станци') < strpos(low, lower(entry)) THEN 'destination' ELSE 'origin' END AS place FROM " + TEXTS + ", (SELECT DISTINCT entry FROM dictionaries WHERE dict_name = 'stations') WHERE contains(low, lower(entry)))"
LOCATIONS = f"(SELECT doc_id, max(station) FILTER (place = 'origin') AS origin, max(station) FILTER (place = 'destination') AS destination FROM {STATIONS} GROUP BY doc_id)"
FIRST_TEXTS = f"(SELECT 'document::' || doc_key AS id, arg_min(text, struct_pack(a := chunk_index, b := cid)) AS text FROM (SELECT id AS cid, {key()} AS doc_key, chunk_index, text FROM {CHUNKS} WHERE text IS NOT NULL) GROUP BY doc_key)"


def entity_rows(source: str, id_column: str) -> str:
    """(id, kind, value) of the entities of a source with a column `text`."""
    lists = {"object_attributes": STANDARDS, "identifiers": IDENTIFIERS, "actors": ORGANISATIONS, "domain": f"list_filter([{DOMAIN}], lambda d: d IS NOT NULL)"}
    return " UNION ALL ".join(f"SELECT DISTINCT {id_column} AS id, '{k}' AS kind, unnest({v}) AS value FROM (SELECT *, lower(text) AS low FROM {source})" for k, v in lists.items())


ENTITY_INDEX = f"(SELECT * FROM ({entity_rows(FIRST_TEXTS, 'id')}) WHERE id IN (SELECT 'document::' || {key()} FROM elements))"

# search and what follows it
FUSED = f"""dense AS (SELECT query_id, doc_key, max(score) AS dense FROM near JOIN c USING (id) WHERE rank <= 180 GROUP BY ALL),
fv AS (SELECT doc_key, category, heading_text, {unit('h')} AS h, {unit('p')} AS p, {unit('g')} AS g, t FROM (SELECT doc_key, category, heading_text, {vec(toks('heading_text'))} AS h, {vec(toks('path_text'))} AS p, {vec(toks('category'))} AS g, {toks(NAV)} AS t FROM doc_fields_meta)),
lex AS (SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct(t)) AS token FROM d) GROUP BY token),
rare AS (SELECT query_id, list(token) AS rare FROM (SELECT DISTINCT query_id, token FROM terms) JOIN lex USING (token), (SELECT count(*) AS n FROM d) WHERE df <= (1 - 0.85::DOUBLE) * n GROUP BY query_id),
lexical AS (SELECT query_id, doc_key, dense, coalesce(bm25, 0.0) AS bm25 FROM dense LEFT JOIN b USING (query_id, doc_key)),
scaled AS (SELECT *, CASE WHEN high - low < 1e-8 THEN 0.0 ELSE (bm25 - low) / (high - low) END AS bm25_scaled FROM (SELECT *, min(bm25) OVER (PARTITION BY query_id) AS low, max(bm25) OVER (PARTITION BY query_id) AS high FROM lexical)),
scores AS (SELECT s.*, f.category, f.heading_text, coalesce(round({dot('q.query_vec', 'f.h')}, 9), 0.0) AS heading_score, coalesce(round({dot('q.query_vec', 'f.p')}, 9), 0.0) AS path_score, coalesce(round({dot('q.query_vec', 'f.g')}, 9), 0.0) AS category_score,
round(CASE WHEN f.t IS NULL THEN 1.0 WHEN len(f.t) = 0 THEN 0.7 WHEN rare IS NULL THEN 1.0 ELSE 1 - (1 - len(list_intersect(rare, f.t))::DOUBLE / len(rare)) * 0.3::DOUBLE END, 9) AS gate
FROM scaled s JOIN q USING (query_id) LEFT JOIN fv f USING (doc_key) LEFT JOIN rare USING (query_id)),
fused AS (SELECT *, round((dense + 0.7::DOUBLE * heading_score + 0.8::DOUBLE * path_score + 0.3::DOUBLE * category_score + 0.5::DOUBLE * bm25_scaled) * gate, 6) AS fused FROM scores)"""

POSITIONS = f"(SELECT id, doc_key, row_number() OVER (PARTITION BY doc_key ORDER BY coalesce(from_order, 0), coalesce(to_order, 0), coalesce(chunk_index, 0), id) - 1 AS pos, text, page_from, page_to FROM (SELECT *, {key()} AS doc_key FROM {CHUNKS} WHERE text IS NOT NULL))"


def hierarchy(rows: str) -> str:
    return f"(SELECT query_id, doc_key, round(sum(CASE WHEN coalesce(len(heading_path), 0) > 0 THEN 0.8::DOUBLE / (1 + 0.1::DOUBLE * len(heading_path)) ELSE 0 END) / greatest(0.8::DOUBLE * count(*), 1.0), 9) AS hierarchy FROM {rows} GROUP BY ALL)"


def coherence(rows: str) -> str:
    return f"(SELECT query_id, doc_key, round(coalesce(avg(CASE WHEN gap <= 2 THEN 1.0 WHEN gap IS NOT NULL THEN 0.0 END), 0.0), 9) AS coherence FROM (SELECT query_id, doc_key, page_from - lag(page_from) OVER (PARTITION BY query_id, doc_key ORDER BY page_from) AS gap FROM {rows} WHERE page_from IS NOT NULL) GROUP BY ALL)"


def scaled(x: str) -> str:
    return f"(CASE WHEN max({x}) OVER w - min({x}) OVER w < 1e-8 THEN 0.0 ELSE ({x} - min({x}) OVER w) / (max({x}) OVER w - min({x}) OVER w) END)"


def hit_scores(rows: str, own: str) -> str:
    """CTEs x0 … scored: the rows with cosine, cross and final scores."""
    return f"""x0 AS MATERIALIZED (SELECT *, {toks('query')} AS qt, {toks('text')} AS tt, {toks('substr(text, 1, 1024)')} AS ct FROM {rows}),
x1 AS (SELECT * EXCLUDE (v, u), {unit('v')} AS tv, {unit('u')} AS qv FROM (SELECT *, {vec('ct')} AS v, {vec('qt')} AS u FROM x0)),
x2 AS MATERIALIZED (SELECT *, round({dot('tv', 'qv')}, 9) AS cosine, round(CASE WHEN len(qt) = 0 THEN 0.0 ELSE len(list_filter(list_distinct(qt), lambda t: list_contains(tt, t)))::DOUBLE / len(list_distinct(qt)) END, 9) AS cross_ FROM x1),
scored AS MATERIALIZED (SELECT o.*, round(0.6::DOUBLE * own + 0.3::DOUBLE * h.hierarchy + 0.1::DOUBLE * coalesce(k.coherence, 0.0), 6) AS final FROM (SELECT *, {own} AS own FROM x2 WINDOW w AS (PARTITION BY query_id, doc_key)) o JOIN {hierarchy('x0')} h USING (query_id, doc_key) LEFT JOIN {coherence('x0')} k USING (query_id, doc_key))"""


def reranked(rows: str) -> str:
    """CTEs up to `best`: the best hits of the best documents."""
    return f"""hits AS MATERIALIZED (SELECT * FROM {rows}),
doc_ranks AS (SELECT query_id, doc_key, row_number() OVER (PARTITION BY query_id ORDER BY max(score) DESC, doc_key) AS doc_rank FROM hits GROUP BY query_id, doc_key),
chosen AS MATERIALIZED (SELECT * EXCLUDE (total, doc_rank) FROM (SELECT *, count(*) OVER (PARTITION BY query_id) AS total FROM hits) JOIN doc_ranks USING (query_id, doc_key) WHERE total <= 100 OR doc_rank <= 10),
{hit_scores('chosen', f"0.7::DOUBLE * {scaled('cross_')} + (1 - 0.7::DOUBLE) * {scaled('cosine')}")},
kept AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_key ORDER BY final DESC, id) AS rank FROM (SELECT *, max(final) OVER (PARTITION BY query_id, doc_key) AS peak FROM scored) WHERE final >= 0.3 OR peak < 0.3),
firsts AS MATERIALIZED (SELECT * FROM kept WHERE rank <= 4),
order_keys AS (SELECT query_id, doc_key, round(best + 0.3::DOUBLE * hierarchy + 0.1::DOUBLE * coalesce(coherence, 0.0), 6) AS order_key FROM (SELECT query_id, doc_key, max(final) AS best FROM firsts GROUP BY ALL) JOIN {hierarchy('firsts')} USING (query_id, doc_key) LEFT JOIN {coherence('firsts')} USING (query_id, doc_key)),
best AS MATERIALIZED (SELECT f.*, order_key, doc_rank FROM firsts f JOIN (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY order_key DESC, doc_key) AS doc_rank FROM order_keys) USING (query_id, doc_key) WHERE doc_rank <= 5)"""


def first_sentences(text: str, budget: str) -> str:
    """The first sentences within a budget of tokens; a mark at the end tells that the next did not fit."""
    return f"trim(replace(list_reduce(list_prepend('', list_filter(list_transform(regexp_split_to_array({text}, '[.!?]+'), lambda p: trim(p, ' ')), lambda p: p <> '')), lambda acc, p: CASE WHEN ends_with(acc, chr(2)) THEN acc WHEN {count('acc || p || $$. $$')} > {budget} THEN acc || chr(2) ELSE acc || p || '. ' END), chr(2), ''), ' ')"


def packed(rows: str) -> str:
    """CTEs up to `packed`: the reranked hits packed into 2000 tokens, two a section."""
    short = first_sentences("full_", "s.budget")
    return f"""{reranked(rows)},
placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY section_size DESC, section, score DESC, id) AS place FROM (SELECT *, count(*) OVER (PARTITION BY query_id, section) AS section_size, {count('full_')} AS tokens FROM (SELECT *, {SECTION_ID} AS section, CASE WHEN len(heading_path) > 0 AND array_to_string(heading_path, ' > ') <> '' THEN array_to_string(heading_path, ' > ') || chr(10) || text ELSE text END AS full_ FROM best))),
steps AS (SELECT DISTINCT query_id, 0::BIGINT AS place, 2000::BIGINT AS budget, []::VARCHAR[] AS taken, ''::VARCHAR AS section, ''::VARCHAR AS text, 0::BIGINT AS tokens, false AS fits FROM placed
UNION ALL SELECT query_id, place, CASE WHEN fits THEN budget - size ELSE budget END, CASE WHEN fits THEN list_append(taken, section) ELSE taken END, section, text, size, fits FROM (
SELECT *, len(list_filter(taken, lambda t: t = section)) < 2 AND budget > 0 AND length(text) > 0 AND size <= budget AS fits FROM (SELECT *, {count('text')} AS size FROM (
SELECT s.query_id, p.place, s.budget, s.taken, p.section, CASE WHEN p.tokens <= s.budget THEN full_ ELSE (CASE WHEN {short} = '' THEN substr(full_, 1, greatest(s.budget, 0) * 4) ELSE {short} END) END AS text FROM steps s JOIN placed p ON p.query_id = s.query_id AND p.place = s.place + 1)))),
packed AS MATERIALIZED (SELECT query_id, place::INTEGER AS place, section, text, tokens::INTEGER AS tokens FROM steps WHERE fits)"""


PROMPT = "(SELECT query_id, string_agg(block, chr(10) || chr(10) ORDER BY section) AS prompt FROM (SELECT query_id, section, '=== Раздел: ' || section || ' ===' || chr(10) || string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY place) AS block FROM packed GROUP BY query_id, section) GROUP BY query_id)"

GRAPH_SEARCH = f"""{GRAPH}, {pagerank()},
ranks AS (SELECT id, round(rank, 9) AS rank FROM r20),
contents AS MATERIALIZED (SELECT id, text, lower(text) AS low FROM {FIRST_TEXTS}), entity AS MATERIALIZED {ENTITY_INDEX},
asked AS MATERIALIZED ({entity_rows('eval_items', 'item_id')}),
questions AS (SELECT item_id AS query_id, text AS query, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '') AS w FROM eval_items),
shared AS MATERIALIZED (SELECT a.id AS query_id, e.id, kind, count(*) AS common FROM asked a JOIN entity e USING (kind, value) GROUP BY ALL),
asked_size AS (SELECT id AS query_id, kind, count(*) AS asked FROM asked GROUP BY ALL),
agreed AS (SELECT query_id, id, sum(CASE kind WHEN 'domain' THEN 0.3::DOUBLE WHEN 'identifiers' THEN 0.3::DOUBLE ELSE 0.2::DOUBLE END) AS weight, sum(CASE WHEN kind IN ('domain', 'identifiers') THEN 1.0::DOUBLE ELSE common::DOUBLE / asked END) AS matches FROM shared JOIN asked_size USING (query_id, kind) GROUP BY ALL),
match AS MATERIALIZED (SELECT query_id, id, round(least(1.0, weight * matches / total), 9) AS match FROM agreed JOIN (SELECT g.query_id, g.id, count(*) AS total FROM agreed g JOIN asked_size z USING (query_id) JOIN (SELECT DISTINCT id, kind FROM entity) e ON e.id = g.id AND e.kind = z.kind GROUP BY ALL) USING (query_id, id)),
met AS (SELECT DISTINCT query_id, id FROM shared),
few AS (SELECT query_id FROM questions WHERE query_id NOT IN (SELECT query_id FROM met GROUP BY query_id HAVING count(*) >= 5)),
pairs AS (SELECT * FROM met UNION SELECT query_id, id FROM few, nodes WHERE type IN ('document', 'section'))"""


def node_scores(pairs: str, extra: str = "") -> str:
    return f"SELECT p.query_id, p.id, n.type{extra}, round(0.2::DOUBLE * coalesce(n.importance, 0.5) + 0.1::DOUBLE * coalesce(r.rank, 0.0) + 0.5::DOUBLE * coalesce(m.match, 0.0) + 0.2::DOUBLE * (CASE WHEN len(w) = 0 THEN 0.0 ELSE len(list_filter(w, lambda x: contains(coalesce(c.low, ''), x)))::DOUBLE / len(w) END), 6) AS graph_score FROM {pairs} p JOIN questions USING (query_id) JOIN nodes n ON n.id = p.id LEFT JOIN ranks r ON r.id = p.id LEFT JOIN contents c ON c.id = p.id LEFT JOIN match m ON m.query_id = p.query_id AND m.id = p.id"


GRAPH_TOP = f"""{GRAPH_SEARCH},
first_found AS MATERIALIZED (SELECT * FROM ({node_scores('pairs')}) WHERE graph_score > 0),
lead AS MATERIALIZED (SELECT query_id, id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY graph_score DESC, id) AS k FROM first_found) WHERE k <= 5),
hop1 AS (SELECT DISTINCT l.id AS start, e.dst AS id, 1 AS d FROM (SELECT DISTINCT id FROM lead) l JOIN edges e ON e.src = l.id),
hops AS (SELECT start, id, min(d) AS d FROM (SELECT * FROM hop1 UNION ALL SELECT h.start, e.dst, 2 FROM hop1 h JOIN edges e ON e.src = h.id) WHERE start <> id GROUP BY ALL),
wide AS (SELECT query_id, h.id, min(d) AS hops FROM lead l JOIN hops h ON h.start = l.id GROUP BY ALL),
others AS (SELECT w.* FROM wide w ANTI JOIN lead l ON l.query_id = w.query_id AND l.id = w.id),
more AS (SELECT query_id, id, type, hops, round(graph_score / (hops + 1) * 0.7::DOUBLE, 6) AS graph_score FROM ({node_scores('others', ', p.hops')})),
every AS (SELECT query_id, id, type, graph_score, 0 AS hops FROM first_found UNION ALL SELECT query_id, id, type, graph_score, hops FROM more WHERE graph_score > 0.1),
graph_top AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY graph_score DESC, id)::INTEGER AS rank_no FROM (SELECT query_id, id, type, max(graph_score) AS graph_score, arg_min(hops, struct_pack(a := -graph_score, b := hops))::INTEGER AS hops FROM every GROUP BY ALL)) WHERE rank_no <= 10)"""

UNIVERSAL = f"""{INDEXED.replace('{k}', '900')}, {BM25}, {FUSED}, {GRAPH_TOP},
bonus AS (SELECT f.query_id, f.doc_key, round(fused + 0.2::DOUBLE * least(1.0, CASE WHEN coalesce(contains(lower(category), lower(a.value)), false) THEN 0.3::DOUBLE ELSE 0.0 END + CASE WHEN len(list_filter(coalesce(o.l, []), lambda x: contains(lower(coalesce(heading_text, '')), lower(x)))) > 0 THEN 0.2::DOUBLE ELSE 0.0 END), 6) AS score FROM fused f LEFT JOIN (SELECT id, value FROM asked WHERE kind = 'domain') a ON a.id = f.query_id LEFT JOIN (SELECT id, list(value) AS l FROM asked WHERE kind = 'object_attributes' GROUP BY id) o ON o.id = f.query_id),
seen AS (SELECT g.query_id, g.id AS node_id, coalesce(n.doc_key, n.id) AS name, graph_score, substr(t.text, 1, 500) AS content FROM graph_top g JOIN nodes n USING (id) LEFT JOIN contents t USING (id)),
tied AS (SELECT g.query_id, node_id, arg_max(struct_pack(k := b.doc_key, s := graph_score), struct_pack(a := b.score, b := b.doc_key)) AS x FROM bonus b JOIN seen g ON b.query_id = g.query_id AND (contains(b.doc_key, g.name) OR contains(g.name, b.doc_key)) GROUP BY ALL),
universal AS MATERIALIZED (SELECT b.query_id, b.doc_key, round(score + 0.3::DOUBLE * coalesce(gs, 0.0), 6) AS score, 'text' AS origin FROM bonus b LEFT JOIN (SELECT query_id, x.k AS doc_key, max(x.s) AS gs FROM tied GROUP BY ALL) USING (query_id, doc_key)
UNION ALL SELECT g.query_id, g.node_id, round(0.3::DOUBLE * graph_score, 6), 'graph' FROM seen g ANTI JOIN tied t ON t.query_id = g.query_id AND t.node_id = g.node_id WHERE coalesce(trim(content), '') <> '')"""

NUMBERED_CHUNKS = f"(SELECT {key()} AS doc_key, id, n || '. ' || text AS text, page_from AS page, chunk_index AS elem_order, 'paragraph' AS element_type, [n] AS headings_path, true AS has_path, {section("n || '. ' || text")} AS section FROM (SELECT *, coalesce(chunk_index + 1, 0)::VARCHAR AS n FROM {CHUNKS} WHERE text IS NOT NULL))"

SQL: dict[str, str] = {
    "src_lines": r"SELECT doc_id, (i - 1)::INTEGER AS n, l[i] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\r\n|\n|\r'), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents WHERE text IS NOT NULL))",
    "src_db_rows": "SELECT 'parts' AS category, 'postgres' AS doc_path, p_partkey::VARCHAR AS doc_id, 'pg' AS source_type, 'row' AS element_type, concat_ws(' | ', p_partkey, p_name, p_brand, p_type) AS text FROM part",
    "src_db_title": r"SELECT 'parts' AS category, 'postgres' AS doc_path, p_partkey::VARCHAR AS doc_id, 'pg' AS source_type, 'row' AS element_type, concat_ws(chr(10), p_name, p_type) AS text FROM part",
    "src_named_rows": "SELECT o_orderkey, concat_ws('; ', 'order: ' || o_orderkey, 'status: ' || o_orderstatus, 'priority: ' || o_orderpriority) AS text FROM orders",
    "src_union_formats": r"SELECT 'lines' AS source, sum(len(list_filter(list_transform(regexp_split_to_array(text, '\r\n|\n|\r'), lambda x: trim(x)), lambda x: x <> '')))::BIGINT AS n FROM documents UNION ALL SELECT 'row', count(*) FROM part",
    "file_counts": r"SELECT ext, count(*) AS files FROM (SELECT DISTINCT doc_path, lower(regexp_extract(doc_path, '\.([^./\\]+)$', 1)) AS ext FROM doc_fields_meta) WHERE ext IN ('pdf', 'docx', 'doc', 'pptx', 'xlsx', 'xls', 'csv', 'txt', 'html', 'htm', 'md') GROUP BY ext",
    "path_text": f"SELECT row_no, {path('doc_path')} AS path_words FROM doc_fields_meta",
    "tokens_norm": f"SELECT token, count(*) AS n FROM (SELECT unnest({toks('text')}) AS token FROM documents) GROUP BY token",
    "words_unicode": f"SELECT doc_id, len({words('text')})::INTEGER AS words, len(list_distinct({words('text')}))::INTEGER AS different FROM documents",
    "token_len": f"SELECT doc_id, {count('text')}::INTEGER AS tokens FROM documents WHERE text IS NOT NULL",
    "normalised_text": f"SELECT doc_id, md5({norm('text')}) AS text_md5 FROM documents WHERE text IS NOT NULL",
    "headings_flag": rf"""SELECT id, length(t) > 3 AND (regexp_matches(t, '(?i)^\s*(?:(?:раздел|глава|приложение)\s+\d+|\d+(?:\.\d+){{0,3}})\s*[).]?\s+\S') OR (length(t) < 120 AND t = upper(t) AND regexp_matches(t, '[А-ЯA-Z]{{3,}}'))) AS heads,
        (CASE WHEN own = '' THEN 0 ELSE len(string_split(own, '.')) - 1 END)::INTEGER AS depth, {section('text')} AS section FROM (SELECT id, text, trim(text) AS t, regexp_extract(text, '{NUMBER}', 1) AS own FROM {ELEMENTS} WHERE text IS NOT NULL)""",
    "section_ids": f"SELECT id, {SECTION_ID} AS section, {LEVEL}::INTEGER AS level, {PREVIEW} AS preview FROM {CHUNKS}",
    "references": f"SELECT id, (i - 1)::INTEGER AS n, l[i] AS target FROM (SELECT id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT id, list_filter(regexp_extract_all(text, '(?i)(?:раздел|глава|пункт)[а-я]*\\s+(\\d+(?:\\.\\d+)*)', 1), lambda x: x <> own) AS l FROM (SELECT id, text, regexp_extract(text, '{NUMBER}', 1) AS own FROM {ELEMENTS} WHERE text IS NOT NULL) WHERE own <> ''))",
    "sentences": f"SELECT doc_id, (i - 1)::INTEGER AS pos, l[i] AS sentence, {count('l[i]')}::INTEGER AS tokens FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, {sents('text')} AS l FROM documents))",
    "text_cuts": "SELECT doc_id, md5(substr(text, 1, 1024)) AS cut_md5, md5(substr(text, 1, 500)) AS preview_md5 FROM documents WHERE text IS NOT NULL",
    "doc_keys": f"SELECT row_no, {key()} AS doc_key, substr({key()}, strpos({key()}, '::') + 2) AS document FROM doc_fields_meta",
    "citations": f"SELECT id, concat_ws(' | ', nullif(category, ''), nullif(doc_path, ''), CASE WHEN page_from IS NULL THEN NULL WHEN page_to IS NULL OR page_to = page_from THEN 'p. ' || page_from ELSE 'pp. ' || page_from || '–' || page_to END) AS citation FROM {CHUNKS}",
    "word_hit_ratio": f"SELECT id, round(CASE WHEN len(w) = 0 THEN 0.0 ELSE len(list_filter(w, lambda x: contains(lower(text), x)))::DOUBLE / len(w) END, 6) AS ratio FROM (SELECT id, text, list_filter(regexp_split_to_array(lower({PREVIEW}), '\\s+'), lambda x: x <> '') AS w FROM {CHUNKS} WHERE text IS NOT NULL)",
    "elements_grouped": f"SELECT {key()} AS doc_key, count(*) AS elements, min(page) AS first_page, max(page) AS last_page, coalesce(sum(length(text)), 0)::BIGINT AS chars FROM {ELEMENTS} GROUP BY 1",
    "heading_texts": f"SELECT doc_key, string_agg(heading, ' ' ORDER BY place) AS heading_text FROM (SELECT doc_key, heading, min(place) AS place FROM (SELECT doc_key, trim(regexp_replace(headings_path[i], '[\\s\\p{{Z}}]+', ' ', 'g')) AS heading, struct_pack(a := coalesce(page, 0), b := coalesce(elem_order, 0), c := id, d := i) AS place FROM (SELECT *, {key()} AS doc_key, unnest(range(1, len(headings_path) + 1)) AS i FROM {ELEMENTS})) WHERE heading <> '' GROUP BY ALL) GROUP BY doc_key",
    "lexicon_df": f"SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct({toks(NAV)})) AS token FROM doc_fields_meta) GROUP BY token",
    "segments": f"""WITH RECURSIVE s AS (SELECT doc_id, (i - 1)::INTEGER AS pos, {count('l[i]')} AS tokens FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, {sents('text')} AS l FROM documents))),
        w AS (SELECT doc_id, pos, tokens AS total, 0 AS segment FROM s WHERE pos = 0 UNION ALL SELECT s.doc_id, s.pos, CASE WHEN w.total + s.tokens > 120 THEN s.tokens ELSE w.total + s.tokens END, w.segment + CASE WHEN w.total + s.tokens > 120 THEN 1 ELSE 0 END FROM w JOIN s ON s.doc_id = w.doc_id AND s.pos = w.pos + 1)
        SELECT doc_id, pos, segment FROM w""",
    "hash_encode": f"SELECT doc_id, (i - 1)::INTEGER AS place, round(v[i], 6) AS value FROM (SELECT doc_id, v, unnest(range(1, 65)) AS i FROM (SELECT doc_id, {unit('v')} AS v FROM (SELECT doc_id, {vec('t')} AS v FROM (SELECT doc_id, {toks('text')} AS t FROM documents)))) WHERE v[i] <> 0",
    "adjacent_cuts": f"""WITH s AS (SELECT doc_id, (i - 1)::INTEGER AS pos, {toks('l[i]')} AS t FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, {sents('text')} AS l FROM documents))),
        v AS (SELECT doc_id, pos, {unit('v')} AS v FROM (SELECT doc_id, pos, {vec('t')} AS v FROM s)), p AS (SELECT doc_id, pos, v, lag(v) OVER (PARTITION BY doc_id ORDER BY pos) AS u FROM v)
        SELECT doc_id, pos, CASE WHEN u IS NOT NULL THEN round({dot('v', 'u')}, 6) END AS similarity FROM p""",
    "knn_topk": f"SELECT query_id, id, round(score, 6) AS score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, round({dot('a.embedding', 'b.embedding')}, 9) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0)) WHERE rank <= 10",
    "knn_filtered": f"SELECT query_id, id, rank::INTEGER AS rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY before) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS before FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, b.label, round({dot('a.embedding', 'b.embedding')}, 9) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0)) WHERE before <= 50 AND label IN (1, 3, 5) AND score >= 0.05) WHERE rank <= 10",
    "search_raw": f"WITH {NEAR} SELECT query_id, rank::INTEGER AS rank, id, doc_key, round(score, 6) AS score FROM near JOIN c USING (id) WHERE rank <= 10",
    "search_documents": f"WITH {NEAR} SELECT query_id, doc_key, round(max(score), 6) AS score, count(*) AS hits, min(least(page_from, page_to)) AS page_first, max(greatest(page_from, page_to)) AS page_last FROM near JOIN c USING (id) WHERE rank <= 10 GROUP BY query_id, doc_key",
    "heading_prefix": rf"SELECT id, 'any' AS kind FROM {CHUNKS} WHERE len(list_filter(heading_path, lambda h: starts_with(h, '1.') OR starts_with(h, 'Раздел'))) > 0 UNION ALL SELECT id, 'joined' FROM {CHUNKS} WHERE starts_with(trim(regexp_replace(array_to_string(heading_path, ' > '), '[\s\p{{Z}}]+', ' ', 'g')), 'Логистика > Акты') OR starts_with(trim(regexp_replace(array_to_string(heading_path, ' > '), '[\s\p{{Z}}]+', ' ', 'g')), 'ПТО')",
    "category_filter": f"SELECT id, category FROM {CHUNKS} WHERE coalesce(nullif(category, ''), 'UNK') IN ('UNK', 'ПТО/Переписка')",
    "chunk_positions": f"SELECT id, doc_key, (row_number() OVER (PARTITION BY doc_key ORDER BY coalesce(from_order, 0), coalesce(to_order, 0), coalesce(chunk_index, 0), id) - 1)::BIGINT AS pos FROM (SELECT *, {key()} AS doc_key FROM {CHUNKS} WHERE text IS NOT NULL)",
    "bm25": f"WITH {BM25} SELECT * FROM b",
    "bm25_minmax": f"WITH {BM25} SELECT query_id, doc_key, round(CASE WHEN high - low < 1e-8 THEN 0.0 ELSE (bm25 - low) / (high - low) END, 4) AS scaled FROM (SELECT *, min(bm25) OVER (PARTITION BY query_id) AS low, max(bm25) OVER (PARTITION BY query_id) AS high FROM b)",
    "hierarchy_scores": HIERARCHY,
    "page_coherence": f"SELECT query_id, doc_key, round(coalesce(avg(CASE WHEN gap <= 2 THEN 1.0 WHEN gap IS NOT NULL THEN 0.0 END), 0.0), 6) AS coherence FROM (SELECT query_id, doc_key, page_from - lag(page_from) OVER (PARTITION BY query_id, doc_key ORDER BY page_from) AS gap FROM {HITS} WHERE page_from IS NOT NULL) GROUP BY ALL",
    "context_coverage": f"SELECT query_id, x.k AS kind, coalesce(x.v, 'UNK') AS value, count(*) AS items FROM (SELECT query_id, unnest([struct_pack(k := 'category', v := category), struct_pack(k := 'section', v := {SECTION_ID}), struct_pack(k := 'level', v := ({LEVEL})::VARCHAR)]) AS x FROM {HITS}) GROUP BY ALL",
    "context_quality": f"SELECT query_id, count(DISTINCT doc_key) AS documents, count(DISTINCT {LEVEL}) AS levels, round(count(DISTINCT category) / count(*) FILTER (category <> ''), 6) AS category_diversity, round(avg(score), 4) AS mean_score, count(*) AS items FROM {HITS} GROUP BY query_id",
    "section_importance": IMPORTANCE,
    "section_top": f"SELECT doc_key, section, importance, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_key ORDER BY importance DESC, section) AS rank FROM ({IMPORTANCE})) WHERE rank <= 5",
    "stream_latest": f"SELECT id, category, source_type, length(text)::INTEGER AS chars FROM {ELEMENTS} WHERE id IS NOT NULL",
    "path_parts": r"SELECT row_no, ext, regexp_replace(name, '\.[^.]*$', '') AS stem, regexp_replace(p, '/?[^/]*$', '') AS folder, ext IN ('pdf', 'docx', 'doc', 'pptx', 'xlsx', 'xls', 'csv', 'txt', 'html', 'htm', 'md') AND NOT contains(p, '.ipynb_checkpoints') AND NOT starts_with(name, '~$') AND NOT starts_with(name, '.') AS is_read FROM (SELECT row_no, lower(regexp_extract(doc_path, '\.([^./\\]+)$', 1)) AS ext, replace(doc_path, '\', '/') AS p, string_split(replace(doc_path, '\', '/'), '/')[-1] AS name FROM doc_fields_meta)",
    "context_summary": f"SELECT query_id, category || ': ' || CASE WHEN len(s) > 0 THEN array_to_string(s, ', ') ELSE 'общая информация' END AS summary FROM (SELECT query_id, category, list_sort(list_distinct(list_filter(list({SECTION_ID}), lambda x: x <> 'root'))) AS s FROM {HITS} GROUP BY query_id, category)",
    "doc_fields": f"""WITH h AS (SELECT doc_key, string_agg(heading, ' ' ORDER BY place) AS heading_text FROM (SELECT doc_key, heading, min(place) AS place FROM (SELECT doc_key, trim(regexp_replace(headings_path[i], '[\\s\\p{{Z}}]+', ' ', 'g')) AS heading, struct_pack(a := coalesce(page, 0), b := coalesce(elem_order, 0), c := id, d := i) AS place FROM (SELECT *, {key()} AS doc_key, unnest(range(1, len(headings_path) + 1)) AS i FROM {ELEMENTS})) WHERE heading <> '' GROUP BY ALL) GROUP BY doc_key),
        d AS (SELECT doc_key, coalesce(heading_text, '') AS heading_text, {path('p')} AS path_text FROM (SELECT {key()} AS doc_key, min(doc_path) AS p FROM elements GROUP BY 1) LEFT JOIN h USING (doc_key))
        SELECT doc_key, heading_text, path_text, len({toks(NAV)})::INTEGER AS tokens FROM d""",
}

SQL |= {
    "src_charset": "SELECT doc_id, md5(text) AS text_md5, CASE WHEN regexp_full_match(text, '[\\x00-\\x7fА-яЁё]*') AND regexp_matches(text, '[А-яЁё]') THEN 'cp1251' WHEN doc_id % 2 = 0 THEN 'utf-8-sig' ELSE 'utf-8' END AS encoding FROM documents WHERE length(text) > 0",
    "smart_truncate": f"SELECT doc_id, CASE WHEN {count('text')} <= 100 THEN text WHEN {first_sentences('text', '100')} = '' THEN substr(text, 1, 400) ELSE {first_sentences('text', '100')} END AS short FROM documents WHERE length(text) > 0",
    "idf_gate": f"WITH {BM25}, lex AS (SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct(t)) AS token FROM d) GROUP BY token), rare AS (SELECT query_id, list(token) AS rare FROM (SELECT DISTINCT query_id, token FROM terms) JOIN lex USING (token), (SELECT count(*) AS n FROM d) WHERE df <= (1 - 0.85::DOUBLE) * n GROUP BY query_id) SELECT query_id, doc_key, round(CASE WHEN rare IS NULL THEN 1.0 ELSE 1 - (1 - len(list_intersect(rare, t))::DOUBLE / len(rare)) * 0.3::DOUBLE END, 6) AS gate FROM b JOIN d USING (doc_key) LEFT JOIN rare USING (query_id)",
    "fusion": f"WITH {INDEXED.replace('{k}', '900')}, {BM25}, {FUSED} SELECT query_id, doc_key, heading_score, path_score, category_score, bm25, gate, fused FROM fused",
    "search_window": f"""WITH {INDEXED.replace('{k}', '25')}, h AS (SELECT *, sum(new_doc) OVER (PARTITION BY query_id ORDER BY rank) AS docs, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS k FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY query_id, doc_key ORDER BY rank) = 1 THEN 1 ELSE 0 END AS new_doc FROM near JOIN c USING (id))),
        kept AS (SELECT * FROM (SELECT *, coalesce(max(CASE WHEN docs >= 5 AND k >= 15 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped FROM h) WHERE stopped = 0),
        pos AS MATERIALIZED {POSITIONS}, around AS (SELECT DISTINCT k.query_id, p.doc_key, p.pos + o AS pos FROM kept k JOIN pos p USING (id), (SELECT unnest([-1, 0, 1]) AS o)),
        context AS (SELECT query_id, doc_key, min(least(page_from, page_to)) AS page_first, max(greatest(page_from, page_to)) AS page_last, string_agg(trim(text), chr(10) || chr(10) ORDER BY pos, text) FILTER (trim(text) <> '') AS context FROM around JOIN pos USING (doc_key, pos) GROUP BY ALL)
        SELECT query_id, rank::INTEGER AS rank, doc_key, round(score, 6) AS score, page_first, page_last, length(coalesce(context, ''))::INTEGER AS context_chars FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_key) AS rank FROM (SELECT query_id, doc_key, max(score) AS score FROM kept GROUP BY ALL) JOIN context USING (query_id, doc_key)) WHERE rank <= 5""",
    "rerank_cosine": f"WITH {hit_scores(HITS, 'cosine')} SELECT query_id, doc_key, id, round(cosine, 6) AS cosine, final FROM scored",
    "rerank_hybrid": f"WITH {reranked(HITS)} SELECT query_id, doc_rank::INTEGER AS doc_rank, doc_key, rank::INTEGER AS rank, id, final, order_key FROM best",
    "context_pack": f"WITH RECURSIVE {packed(HITS)} SELECT * FROM packed",
    "context_prompt": f"WITH RECURSIVE {packed(HITS)} SELECT * FROM {PROMPT}",
    "context_citations": f"WITH RECURSIVE {packed(HITS)} SELECT query_id, place, concat_ws(' | ', nullif(category, ''), nullif(doc_path, ''), CASE WHEN page_from IS NULL THEN NULL WHEN page_to IS NULL OR page_to = page_from THEN 'p. ' || page_from ELSE 'pp. ' || page_from || '–' || page_to END) AS citation FROM packed p JOIN placed USING (query_id, place)",
    "universal_search": f"WITH {UNIVERSAL} SELECT query_id, doc_key, score, origin, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_key) AS rank FROM universal) WHERE rank <= 5",
    "ent_domain": f"SELECT doc_id, {DOMAIN} AS domain FROM {TEXTS}",
    "ent_standards": f"SELECT doc_id, unnest({STANDARDS}) AS value FROM {TEXTS}",
    "ent_dates": f"SELECT doc_id, unnest({DATES}) AS value FROM {TEXTS}",
    "ent_quantity": f"SELECT doc_id, q.value AS value, q.unit AS unit FROM (SELECT doc_id, {AMOUNT} AS q FROM {TEXTS}) WHERE q IS NOT NULL",
    "ent_incoterms": f"SELECT doc_id, unnest(list_filter({TERMS}, lambda t: contains(upper(text), t))) AS term FROM {TEXTS}",
    "ent_identifiers": f"SELECT doc_id, unnest({IDENTIFIERS}) AS value FROM {TEXTS}",
    "ent_organisations": f"SELECT doc_id, unnest({ORGANISATIONS}) AS value FROM {TEXTS}",
    "ent_stations": f"SELECT * FROM {STATIONS}",
    "ent_locations": f"SELECT * FROM {LOCATIONS}",
    "ent_confidence": f"SELECT doc_id, x.k AS field, x.v AS confidence FROM (SELECT t.doc_id, unnest(list_filter([struct_pack(k := 'domain', v := CASE WHEN {DOMAIN} IS NOT NULL THEN 0.9::DOUBLE END), struct_pack(k := 'quantity', v := CASE WHEN {AMOUNT} IS NOT NULL THEN 0.95::DOUBLE END), struct_pack(k := 'location', v := CASE WHEN l.doc_id IS NOT NULL THEN 0.8::DOUBLE END), struct_pack(k := 'actors', v := CASE WHEN len({ORGANISATIONS}) > 0 THEN 0.7::DOUBLE END)], lambda x: x.v IS NOT NULL)) AS x FROM {TEXTS} t LEFT JOIN {LOCATIONS} l USING (doc_id))",
    "ent_merged": f"WITH a AS (SELECT id, {DOMAIN} AS domain, {STANDARDS} AS s, {IDENTIFIERS} AS i, {ORGANISATIONS} AS o FROM (SELECT id, text, lower(text) AS low FROM {CHUNKS} WHERE text IS NOT NULL)), b AS (SELECT id, {DOMAIN} AS domain, {STANDARDS} AS s, {IDENTIFIERS} AS i, {ORGANISATIONS} AS o FROM (SELECT id, text, lower(text) AS low FROM (SELECT id, coalesce(array_to_string(heading_path, chr(10)), '') AS text FROM {CHUNKS} c WHERE c.text IS NOT NULL))) SELECT id, coalesce(b.domain, a.domain) AS domain, len(list_distinct(a.s || b.s))::INTEGER AS attributes, len(list_distinct(a.i || b.i))::INTEGER AS identifiers, len(list_distinct(a.o || b.o))::INTEGER AS actors FROM a JOIN b USING (id)",
    "entities_all": f"SELECT doc_id, x.k AS field, x.v AS value FROM (SELECT t.doc_id, unnest(list_filter([struct_pack(k := 'domain', v := {DOMAIN}), struct_pack(k := 'quantity', v := to_json({AMOUNT})::VARCHAR), struct_pack(k := 'location', v := CASE WHEN l.doc_id IS NOT NULL THEN json_merge_patch('{{}}', to_json(struct_pack(origin := l.origin, destination := l.destination)))::VARCHAR END), struct_pack(k := 'object_attributes', v := to_json(nullif(list_sort({STANDARDS}), []))::VARCHAR), struct_pack(k := 'raw_dates', v := to_json(nullif({DATES}, []))::VARCHAR), struct_pack(k := 'constraints', v := to_json(nullif(list_transform(list_filter({TERMS}, lambda t: contains(upper(text), t)), lambda t: 'Инкотермс: ' || t), []))::VARCHAR), struct_pack(k := 'identifiers', v := to_json(nullif(list_sort({IDENTIFIERS}), []))::VARCHAR), struct_pack(k := 'actors', v := to_json(nullif(list_sort({ORGANISATIONS}), []))::VARCHAR)], lambda x: x.v IS NOT NULL)) AS x FROM {TEXTS} t LEFT JOIN {LOCATIONS} l USING (doc_id))",
    "graph_folders": f"SELECT id, name, level, importance FROM {FOLDER_NODES}",
    "graph_documents": f"SELECT * FROM {DOC_NODES}",
    "graph_edges": f"WITH {GRAPH} SELECT * FROM edges",
    "graph_references": f"WITH {graph_ctes(NUMBERED_CHUNKS)} SELECT * FROM refs",
    "graph_nodes": f"WITH {GRAPH} SELECT id, 'folder' AS type, level, importance, NULL::BIGINT AS element_count, NULL::INTEGER AS text_length, NULL::BOOLEAN AS has_media FROM folders UNION ALL SELECT id, 'document', NULL, NULL, element_count, NULL, NULL FROM docs UNION ALL SELECT id, 'section', level, importance, element_count, NULL, NULL FROM sections UNION ALL SELECT 'element::' || id, element_type, NULL, NULL, NULL, coalesce(length(text), 0), media_path IS NOT NULL FROM prepared WHERE has_path",
    "graph_analysis": f"WITH {GRAPH} SELECT 'nodes' AS kind, type AS value, count(*) AS n FROM nodes GROUP BY type UNION ALL SELECT 'edges', rel, count(*) FROM edges GROUP BY rel UNION ALL SELECT 'depth', 'section', coalesce(max(level), 0)::BIGINT FROM sections",
    "graph_document_analysis": f"WITH {GRAPH} SELECT s.doc_key, s.sections, s.mean_importance, s.top_sections, coalesce(r.n, 0) AS \"references\" FROM (SELECT doc_key, count(*) AS sections, round(avg(importance), 6) AS mean_importance, string_agg(section, ', ' ORDER BY k) FILTER (k <= 5) AS top_sections FROM (SELECT *, row_number() OVER (PARTITION BY doc_key ORDER BY importance DESC, section) AS k FROM sections) GROUP BY doc_key) s LEFT JOIN (SELECT doc_key, count(*) AS n FROM refs JOIN sections ON id = src GROUP BY doc_key) r USING (doc_key)",
    "graph_khop": f"WITH {GRAPH} SELECT start, id, min(distance)::INTEGER AS distance FROM (SELECT s.id AS start, e.dst AS id, 1 AS distance FROM nodes s JOIN edges e ON e.src = s.id UNION ALL SELECT s.id, f.dst, 2 FROM nodes s JOIN edges e ON e.src = s.id JOIN edges f ON f.src = e.dst) WHERE start <> id GROUP BY start, id",
    "graph_tree": f"WITH RECURSIVE {GRAPH}, tree AS (SELECT id AS root, id, NULL::VARCHAR AS parent, 0 AS depth FROM docs UNION ALL SELECT t.root, e.dst, t.id, t.depth + 1 FROM tree t JOIN edges e ON e.src = t.id AND e.rel <> 'references') SELECT * FROM tree",
    "graph_paths": f"WITH RECURSIVE {GRAPH}, a AS (SELECT min(id) AS id FROM folders WHERE level = 0), walk AS (SELECT id, [id] AS path FROM a UNION ALL SELECT e.dst, list_append(w.path, e.dst) FROM walk w JOIN edges e ON e.src = w.id AND e.rel <> 'references'), last AS (SELECT arg_max(path, struct_pack(a := len(path), b := id)) AS path FROM walk) SELECT (i - 1)::INTEGER AS step, path[i] AS id FROM (SELECT path, unnest(range(1, len(path) + 1)) AS i FROM last)",
    "graph_pagerank": f"WITH {GRAPH}, {pagerank()} SELECT id, round(rank, 9) AS rank FROM r20",
    "graph_importance": f"WITH {GRAPH}, {pagerank()} SELECT id, round(CASE WHEN n > 10 THEN 0.7::DOUBLE * coalesce(importance, 0.5) + 0.3::DOUBLE * round(rank, 9) ELSE coalesce(importance, 0.5) END, 6) AS importance FROM nodes JOIN r20 USING (id), n",
    "relevant_sections": f"WITH {GRAPH}, s AS (SELECT id, importance, unnest(list_distinct({words('heading')})) AS word FROM sections), q AS (SELECT item_id AS query_id, unnest(list_distinct({words('text')})) AS word FROM eval_items) SELECT query_id, id, score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT query_id, id, round(count(*) * importance, 6) AS score FROM q JOIN s USING (word) GROUP BY query_id, id, importance)) WHERE rank <= 5",
    "entity_index": f"SELECT kind, value, id FROM {ENTITY_INDEX}",
    "graph_search_top": f"WITH {GRAPH_TOP} SELECT query_id, id, type, graph_score, hops, rank_no FROM graph_top",
    "graph_search_filtered": f"""WITH {GRAPH_SEARCH.replace("ranks AS (SELECT id, round(rank, 9) AS rank FROM r20)", "ranks AS (SELECT id, 0.0::DOUBLE AS rank FROM nodes)")}, dated AS (SELECT p.* FROM pairs p JOIN nodes n USING (id) WHERE n.type = 'document' AND n.date BETWEEN '2024-01-01' AND '2024-01-31'),
        tops AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY graph_score DESC, id)::INTEGER AS rank_no FROM ({node_scores('dated')}) WHERE graph_score > 0) WHERE rank_no <= 10),
        near AS (SELECT src AS id, array_to_string(list_sort(list_distinct(list(dst)))[1:5], ' | ') AS related FROM edges WHERE src <> dst GROUP BY src)
        SELECT query_id, id, rank_no, graph_score, related FROM tops LEFT JOIN near USING (id)""",
    "similar_documents": f"WITH e AS MATERIALIZED (SELECT * FROM {ENTITY_INDEX}), s AS (SELECT kind, value, id FROM e WHERE kind IN ('object_attributes', 'actors')) SELECT id, other, shared, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY shared DESC, other) AS rank FROM (SELECT a.id, b.id AS other, count(*) AS shared FROM s a JOIN s b USING (kind, value) WHERE a.id <> b.id AND a.id IN (SELECT id FROM e) AND ('0x' || substr(md5(a.id), 1, 6))::BIGINT % 20 = 0 GROUP BY ALL)) WHERE rank <= 5",
    "heading_paths": f"""WITH RECURSIVE k AS MATERIALIZED (SELECT *, {key()} AS doc_key, coalesce(page, 0)::BIGINT * 1000000 + coalesce(elem_order, 0) AS place, trim(coalesce(text, ''), ' ') AS t FROM {ELEMENTS}),
        r AS MATERIALIZED (SELECT id, doc_key, place, category, text, coalesce(element_type IN ('paragraph', 'title'), false) AND length(t) > 3 AND (regexp_matches(t, '(?i)^\\s*(?:(?:раздел|глава|приложение)\\s+\\d+|\\d+(?:\\.\\d+){{0,3}})\\s*[).]?\\s+\\S') OR (length(t) < 120 AND t = upper(t) AND regexp_matches(t, '[А-ЯA-Z]{{3,}}'))) AS heads FROM k),
        h AS MATERIALIZED (SELECT id, doc_key, place, trim(text, ' ') AS heading, (CASE WHEN own = '' THEN 0 ELSE len(string_split(own, '.')) - 1 END) AS depth, row_number() OVER (PARTITION BY doc_key ORDER BY place, id) AS n FROM (SELECT *, regexp_extract(text, '{NUMBER}', 1) AS own FROM r WHERE heads)),
        f AS (SELECT doc_key, n, id, place, [heading] AS stack FROM h WHERE n = 1 UNION ALL SELECT h.doc_key, h.n, h.id, h.place, list_append(f.stack[1:least(h.depth, len(f.stack))], h.heading) FROM f JOIN h ON h.doc_key = f.doc_key AND h.n = f.n + 1),
        m AS (SELECT r.id, r.heads, r.category, last_value(f.stack IGNORE NULLS) OVER (PARTITION BY r.doc_key ORDER BY r.place, r.id) AS stack FROM r LEFT JOIN f ON f.id = r.id)
        SELECT id, heads, array_to_string({FOLDERS} || coalesce(stack, []), ' > ') AS path FROM m""",
    "src_block_order": f"""WITH b AS (SELECT {key()} AS doc_key, page, id, bbox, (bbox[1] + bbox[3]) / 2 AS centre FROM {ELEMENTS} WHERE bbox IS NOT NULL),
        g AS (SELECT doc_key, page, list_sort(list(round(centre, 6))) AS v FROM b GROUP BY ALL),
        e AS (SELECT doc_key, page, v, list_reduce(list_prepend(struct_pack(a := list_min(v), b := list_max(v)), list_transform(range(12), lambda i: struct_pack(a := 0.0::DOUBLE, b := 0.0::DOUBLE))), lambda c, i: struct_pack(a := coalesce(list_avg(list_filter(v, lambda x: abs(x - c.a) <= abs(x - c.b))), c.a), b := coalesce(list_avg(list_filter(v, lambda x: abs(x - c.a) > abs(x - c.b))), c.b))) AS c FROM g),
        s AS (SELECT doc_key, page, CASE WHEN len(v) >= 8 AND least(len(list_filter(v, lambda x: x <= (c.a + c.b) / 2)), len(list_filter(v, lambda x: x > (c.a + c.b) / 2))) >= 3 THEN (c.a + c.b) / 2 END AS t FROM e)
        SELECT doc_key, page, id, col_no, (row_number() OVER (PARTITION BY doc_key, page ORDER BY col_no, bbox[2], bbox[1], id) - 1)::INTEGER AS n FROM (SELECT b.*, CASE WHEN t IS NOT NULL AND centre > t THEN 1 ELSE 0 END AS col_no FROM b JOIN s ON s.doc_key = b.doc_key AND s.page IS NOT DISTINCT FROM b.page)""",
    "pipeline_context": f"""WITH RECURSIVE {UNIVERSAL}, top10 AS (SELECT query_id, doc_key FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_key) AS rank FROM universal) WHERE rank <= 10 AND origin = 'text'),
        phits AS MATERIALIZED (SELECT near.query_id, i.text AS query, c.doc_key, c.id, k.category, k.doc_path, c.chunk_index, c.text, c.heading_path, c.page_from, c.page_to, near.score FROM near JOIN c USING (id) JOIN top10 USING (query_id, doc_key) JOIN {CHUNKS} k USING (id) JOIN eval_items i ON i.item_id = near.query_id WHERE rank <= 180),
        {packed('phits')} SELECT p.query_id, p.prompt, count(*) AS items, sum(k.tokens)::BIGINT AS tokens FROM {PROMPT} p JOIN packed k USING (query_id) GROUP BY ALL""",
}
