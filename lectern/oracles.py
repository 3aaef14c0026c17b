"""DuckDB's form of the registered queries."""

from __future__ import annotations

from lectern import fixtures, vocab
from lectern.functions.text import IMAGE, IMPLICIT_HEADINGS, SPACE, TOKEN, WORD
from lectern.functions.urls import STORED_IMAGE

O: dict[str, str] = {}


def strip(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '^{SPACE}+|{SPACE}+\\z', '', 'g')"


def text_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v + "'" for v in values) + "]"


def any_of(x: str, words: list[str]) -> str:
    return f"regexp_matches({x}, '{'|'.join(words)}')"


def tokens(x: str) -> str:
    return f"CAST(len(regexp_extract_all({x}, '{TOKEN}')) AS BIGINT)"


# --- identifiers and text ---------------------------------------------------------------------------------------------

O["ids_and_hashes"] = """
SELECT doc_id, 'doc-' || md5(source) AS full_id, 'chunk-' || md5('doc-' || md5(source) || '|' || doc_id || '|' || text) AS chunk, md5(text) AS hash FROM documents"""
O["token_count_regex"] = f"SELECT doc_id, {tokens('text')} AS tokens FROM documents"
O["char_bigrams"] = f"""
WITH s AS (SELECT doc_id, string_split({strip("text")}, '') AS c FROM documents WHERE {strip("text")} <> ''),
g AS (SELECT doc_id, unnest(CASE WHEN len(c) <= 2 THEN c ELSE list_transform(list_zip(c[:-2], c[2:]), lambda p: p[1] || p[2]) END) AS gram FROM s)
SELECT doc_id, gram, count(*) AS n FROM g GROUP BY ALL"""


def cleaned(x: str) -> str:
    return strip(f"regexp_replace(regexp_replace(coalesce({x}, ''), '{IMAGE}', '', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')")


def chunk_images(x: str, doc: str) -> str:
    kept = f"list_filter(list_transform(regexp_extract_all(coalesce({x}, ''), '{IMAGE}', 1), lambda p: {strip('p')}), lambda p: p <> '')"
    return f"list_sort(list_distinct(list_transform({kept}, lambda p: 'images/' || {doc} || '/' || list_last(string_split(p, '/')))))"


O["md_images"] = f"""
SELECT doc_id, array_to_string(regexp_extract_all(text, '{IMAGE}', 1), '|') AS targets,
       array_to_string({chunk_images('text', "'doc-' || md5(md_stem)")}, '|') AS paths, {cleaned('text')} AS clean FROM ({fixtures.MANUALS})"""
O["chunk_prefix"] = """
SELECT doc_id, '[产品: ' || source || ' | 章节路径: ' || lang || CASE WHEN doc_id % 2 = 0 THEN ' | 类型: general' ELSE '' END || ']' || chr(10) || text AS content, content AS again FROM documents"""


def snippet(title: str, content: str, limit: int) -> str:
    s = strip(content)
    body = f"left(CASE WHEN {s} LIKE '[%' AND contains({s}, chr(10)) THEN {strip(f'substring({s}, instr({s}, chr(10)) + 1)')} ELSE {s} END, {limit})"
    return f"concat_ws(chr(10), nullif({strip(title)}, ''), nullif({body}, ''))"


O["rerank_snippet"] = f"""
WITH d AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source END AS title, CASE WHEN doc_id % 3 = 0 THEN '[产品: x]' || chr(10) || text ELSE text END AS content FROM documents)
SELECT doc_id, {snippet('title', 'content', 64)} AS snippet FROM d"""


def items(x: str) -> str:
    return f"list_filter(list_transform({x}, lambda x: {strip('x')}), lambda x: x <> '')"


_SPLIT = items("string_split(coalesce(raw, ''), ';')")
O["metadata_list"] = f"""
SELECT id, array_to_string(CASE WHEN {strip('raw')} LIKE '[%' AND json_valid(raw) THEN {items("CAST(CAST(raw AS JSON) AS VARCHAR[])")} ELSE {_SPLIT} END, '|') AS items,
       array_to_string({_SPLIT}, '|') AS paths FROM ({fixtures.METADATA})"""
O["metadata_flatten"] = "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type || ';' || user_id AS flat FROM events"


def row_md(r: str, w: str) -> str:
    return f"'| ' || array_to_string(list_concat({r}, list_resize(CAST([] AS VARCHAR[]), {w} - len({r}), '')), ' | ') || ' |'"


O["html_table_md"] = f"""
WITH t AS (SELECT id, a, b, c, greatest(len(a), len(b), len(c)) AS w FROM ({fixtures.TABLES}))
SELECT id, {row_md('a', 'w')} || chr(10) || '| ' || array_to_string(list_resize(CAST([] AS VARCHAR[]), w, '---'), ' | ') || ' |' || chr(10) || {row_md('b', 'w')} || chr(10) || {row_md('c', 'w')} AS md FROM t"""
_L, _N = strip("line"), strip("style")
_NUM = strip(f"replace({_N}, 'Heading', '')")
O["implicit_heading"] = f"""
SELECT pos, CAST(CASE WHEN {_N} LIKE 'Heading%' AND regexp_full_match({_NUM}, '[0-9]+') THEN greatest(1, least(6, TRY_CAST({_NUM} AS INTEGER))) WHEN {_N} IN ('Title', '标题') THEN 1 END AS BIGINT) AS level,
       {_L} <> '' AND length({_L}) <= 40 AND (regexp_matches({_L}, '^\\p{{Nd}}+\\.[^{SPACE[1:]}') OR {_L} IN {tuple(IMPLICIT_HEADINGS)} OR ({_L} LIKE '%操作' AND length({_L}) <= 12 AND {_L} NOT LIKE '·%')) AS implicit
FROM ({fixtures.DOCX})"""
_CAPTION = f"图{SPACE}*\\p{{Nd}}(?:\\p{{Nd}}|-|\\+|{SPACE})*[^\\n]{{0,50}}"


def captions(x: str) -> str:
    return f"list_transform(regexp_extract_all(coalesce({x}, ''), '{_CAPTION}'), lambda c: {strip('c')})"


O["captions"] = f"SELECT doc_id, array_to_string({captions('text')}, '|') AS captions FROM ({fixtures.MANUALS})"
O["escaped_html"] = "SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS escaped FROM pages"
_P = f"replace({strip('raw')}, chr(92), '/')"


def rel(x: str) -> str:
    p = f"replace({strip(x)}, chr(92), '/')"
    return f"""CASE WHEN contains({p}, '/kb_images/') THEN regexp_replace(substring({p}, instr({p}, '/kb_images/') + 11), '^/+', '')
       WHEN {p} LIKE 'kb\\_images/%' ESCAPE '\\' THEN regexp_replace(substring({p}, 11), '^/+', '')
       WHEN regexp_matches({p}, '{STORED_IMAGE}') THEN regexp_extract({p}, '{STORED_IMAGE}', 1) END"""


def public(x: str, base: str) -> str:
    return f"CASE WHEN coalesce({rel(x)}, '') = '' THEN {strip(x)} ELSE '{base}/kb_images/' || {rel(x)} END"


O["kb_urls"] = f"""
SELECT id, CASE WHEN {_P} = '' THEN '' WHEN regexp_matches({_P}, '^(https?://|/kb_images/)') THEN {_P}
       ELSE '/kb_images/' || replace(replace(replace(url_encode(regexp_replace(regexp_replace({_P}, '^images/', ''), '^/+', '')), '%2F', '/'), '%3A', ':'), '%40', '@') END AS url,
       {rel('raw')} AS rel, {public('raw', 'https://kb.example')} AS public, '/kb_images/' || regexp_replace(raw, '^images/', '') AS display FROM ({fixtures.URLS})"""
_CITED = f"replace(answer, '[' || image_id || ']', '![' || coalesce(nullif(caption_hint, ''), image_id) || '](' || {public('display_url', '')} || ')')"
# each fixture quotes at most one Markdown image besides the cited one, so each kind is put right in turn
O["answer_images"] = f"""
WITH c AS (SELECT id, {_CITED} AS cited FROM ({fixtures.ANSWERS})),
m AS (SELECT id, cited, regexp_extract_all(cited, '!\\[[^\\]]*\\]\\([^)]+\\)') AS found FROM c),
p AS (SELECT id, cited, list_reduce(list_prepend(cited, found), lambda acc, f: replace(acc, f, '![' || regexp_extract(f, '!\\[([^\\]]*)\\]', 1) || '](' || {public("regexp_extract(f, '" + IMAGE + "', 1)", '')} || ')')) AS shown FROM m)
SELECT id, cited, regexp_replace(shown, '{STORED_IMAGE}', '/kb_images/\\1', 'g') AS public FROM p"""

# --- retrieval --------------------------------------------------------------------------------------------------------



def search_tokens(x: str) -> str:
    grams = "CASE WHEN length(r) = 1 THEN [r] ELSE list_transform(range(1, length(r)), lambda i: substring(r, i, 2)) END"
    return f"list_concat(regexp_extract_all(regexp_replace(lower({x}), '\\p{{Han}}+', ' ', 'g'), '{WORD}'), flatten(list_transform(regexp_extract_all({x}, '\\p{{Han}}+'), lambda r: {grams})))"


def bm25(docs: str) -> str:
    return f"""
words AS (SELECT doc_id, unnest({search_tokens('text')}) AS term FROM {docs}),
postings AS (SELECT term, doc_id, count(*) AS tf FROM words GROUP BY ALL),
lengths AS (SELECT d.doc_id, coalesce(sum(tf), 0) AS dl FROM {docs} d LEFT JOIN postings p USING (doc_id) GROUP BY ALL),
stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lengths),
raw AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf, ln(CAST(any_value(n) AS DOUBLE) - count(*) + 0.5::DOUBLE) - ln(count(*) + 0.5::DOUBLE) AS raw FROM postings, stats GROUP BY term),
terms AS (SELECT term, df, cf, CASE WHEN raw < 0 THEN 0.25::DOUBLE * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw)"""


def bm25_scores(docs: str, asked: str) -> str:
    return f"""{bm25(docs)},
asked AS ({asked}),
scores AS (SELECT query_id, doc_id, round(sum(idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 9) AS score
           FROM asked JOIN terms USING (term) JOIN postings USING (term) JOIN lengths USING (doc_id), stats GROUP BY ALL)"""


_SCORES = bm25_scores("documents", f"SELECT item_id AS query_id, unnest({search_tokens('text')}) AS term FROM benchmark")
_HAN = bm25_scores(f"({fixtures.MANUALS})", f"SELECT query_id, unnest({search_tokens('text')}) AS term FROM ({fixtures.QUERIES})")
O["bm25_han"] = f"WITH {_HAN} SELECT query_id, doc_id, round(score, 6) AS score FROM scores"
O["bm25_stats"] = f"WITH {bm25('documents')} SELECT term, df, cf, round(idf, 6) AS idf FROM terms"


def scaled(score: str, part: str) -> str:
    return f"CASE WHEN max({score}) OVER (PARTITION BY {part}) = min({score}) OVER (PARTITION BY {part}) THEN 0.5::DOUBLE ELSE ({score} - min({score}) OVER (PARTITION BY {part})) / (max({score}) OVER (PARTITION BY {part}) - min({score}) OVER (PARTITION BY {part})) END"


O["bm25_topk"] = f"""WITH {_SCORES}, s AS (SELECT query_id, doc_id, {scaled('score', 'query_id')} AS score FROM scores WHERE score > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s)
SELECT query_id, rank, doc_id, round(score, 6) AS score FROM r WHERE rank <= 10"""
O["minmax_scores"] = f"SELECT source AS query_id, doc_id, round({scaled('CAST(n_chars AS DOUBLE)', 'source')}, 6) AS score FROM documents"
def near(asked: str) -> str:
    return f"""
v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings),
u AS (SELECT vec_id, list_transform(x, lambda c: c / sqrt(list_dot_product(x, x))) AS x FROM v),
near AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, round(list_dot_product(q.x, c.x), 9) AS score FROM u q JOIN u c ON {asked})"""


O["vector_topk"] = f"""WITH {near("q.vec_id % 50 = 0")}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM near)
SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM r WHERE rank <= 10"""
_LEGS = f"""{_SCORES}, {near("q.vec_id IN (SELECT item_id FROM benchmark)").strip()},
t0 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0),
t1 AS (SELECT query_id, doc_id AS chunk_id, {scaled('score', 'query_id')} AS b FROM t0 WHERE rank <= 50),
e0 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM near),
e1 AS (SELECT query_id, chunk_id, {scaled('score', 'query_id')} AS e FROM e0 WHERE rank <= 50)"""
_FUSE = """, j AS (SELECT query_id, chunk_id, b, e, max(e IS NOT NULL) OVER (PARTITION BY query_id) AS has FROM t1 FULL JOIN {} USING (query_id, chunk_id))
SELECT query_id, chunk_id, round(CASE WHEN has THEN 0.5::DOUBLE * coalesce(b, 0) + 0.5::DOUBLE * coalesce(e, 0) ELSE coalesce(b, 0) END, 6) AS score FROM j"""
O["hybrid_fusion"] = f"WITH {_LEGS}{_FUSE.format('e1')}"
O["hybrid_degrade"] = f"WITH {_LEGS}, e2 AS (SELECT * FROM e1 WHERE query_id IN (SELECT item_id FROM benchmark WHERE length(text) >= 200)){_FUSE.format('e2')}"
_NAMES = f"SELECT product_id, lower({strip('n')}) AS name FROM (SELECT product_id, unnest(list_concat([display_name, product_id], aliases)) AS n FROM ({fixtures.PRODUCTS}))"
O["alias_match"] = f"SELECT DISTINCT query_id, p.product_id FROM ({fixtures.QUERIES}) q JOIN ({_NAMES}) p ON p.name <> '' AND contains(lower(q.text), p.name)"
O["alias_boost"] = """
WITH h AS (SELECT doc_id % 3 AS query_id, source AS product_id, doc_id, CAST((doc_id % 100) / 100.0 AS DOUBLE) AS score FROM documents),
m AS (SELECT DISTINCT doc_id % 3 AS query_id, source AS product_id FROM documents WHERE n_chars > 6000)
SELECT h.query_id, h.product_id, doc_id, round(CASE WHEN m.query_id IS NOT NULL THEN least(1.0::DOUBLE, score + 0.15::DOUBLE) ELSE score END, 6) AS score FROM h LEFT JOIN m ON h.query_id = m.query_id AND h.product_id = m.product_id"""
O["subquery_merge"] = """
WITH h AS (SELECT doc_id % 5 AS query_id, doc_id % 7 AS sub_ord, doc_id % 40 AS chunk_id, CAST((n_chars % 50) / 50.0 AS DOUBLE) AS score FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY score DESC, sub_ord) AS k FROM h)
SELECT query_id, chunk_id, round(score, 6) AS score, sub_ord FROM r WHERE k = 1"""

# --- topics -----------------------------------------------------------------------------------------------------------

_TRIGGERS = fixtures.values("ord, bucket, pattern, fallback", [(k, b, p, vocab.TOPIC_FALLBACK[b]) for k, (b, p) in enumerate(vocab.TOPIC_TRIGGERS.items())])
_BUCKETS = fixtures.values("bucket, keywords", [(b, "|".join(w)) for b, w in vocab.TOPIC_BUCKETS.items()])
_HITS = f"hits AS (SELECT query_id, q.text, q.product_id, ord, bucket, fallback FROM ({fixtures.QUERIES}) q JOIN ({_TRIGGERS}) t ON regexp_matches(q.text, t.pattern))"
O["topic_triggers"] = f"WITH {_HITS} SELECT query_id, bucket, ord, first_value(bucket) OVER (PARTITION BY query_id ORDER BY ord) AS active FROM hits"
_INDEX = f"""sec AS (SELECT product_id, pos, {strip('section_title')} AS title, {strip('section_path')} AS path FROM ({fixtures.SECTIONS}) WHERE product_id <> '' AND chunk_type NOT IN ('toc', 'meta')),
placed AS (SELECT product_id, bucket, title, min(pos) AS pos FROM sec JOIN ({_BUCKETS}) b ON regexp_matches(path || ' ' || title, b.keywords) WHERE title <> '' AND NOT regexp_matches(title, '{vocab.SKIPPED_TITLES}') GROUP BY ALL),
idx AS (SELECT product_id, bucket, list(title ORDER BY pos, title) AS titles FROM placed GROUP BY ALL)"""
O["section_index"] = f"WITH {_INDEX} SELECT product_id, bucket, array_to_string(titles, '|') AS titles FROM idx"
O["topic_expand"] = f"""
WITH {_INDEX}, {_HITS},
sole AS (SELECT CASE WHEN count(DISTINCT product_id) = 1 THEN min(product_id) END AS p FROM idx),
ex AS (SELECT query_id, flatten(list(CASE WHEN i.titles IS NOT NULL THEN i.titles[1:3] ELSE fallback END ORDER BY ord)) AS extras
       FROM hits CROSS JOIN sole LEFT JOIN idx i ON i.product_id = coalesce(nullif(hits.product_id, ''), sole.p) AND i.bucket = hits.bucket GROUP BY query_id),
every AS (SELECT q.query_id, list_concat([q.text], CASE WHEN coalesce(product_id, '') <> '' AND regexp_matches(q.text, '{vocab.INTRO_QUERY}') THEN [q.text || '{vocab.INTRO_SUFFIX}', '{vocab.INTRO_EXTRA}'] ELSE CAST([] AS VARCHAR[]) END, coalesce(extras, CAST([] AS VARCHAR[]))) AS l
          FROM ({fixtures.QUERIES}) q LEFT JOIN ex USING (query_id)),
flat AS (SELECT query_id, unnest(l) AS text, generate_subscripts(l, 1) AS k FROM every),
once AS (SELECT query_id, text, min(k) AS k FROM flat GROUP BY ALL)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY k) - 1 AS sub_ord, text FROM once"""
O["product_flatten"] = f"SELECT product_id, display_name, manual_pdf, md_stem, array_to_string(aliases, '|') AS aliases, series_id, series_name FROM ({fixtures.PRODUCTS})"
O["product_lookup"] = f"""
SELECT how, product_id FROM ({fixtures.PRODUCTS}) p JOIN (VALUES ('id', 'p2', '', ''), ('stem', '', '手册甲', ''), ('pdf', '', '', '戊.pdf'), ('none', 'p9', '', '')) w(how, i, s, f) ON product_id = i OR md_stem = s OR manual_pdf = f"""
O["product_choices"] = f"SELECT series_name || ' / ' || display_name AS label, product_id FROM ({fixtures.PRODUCTS})"

# --- chunks -----------------------------------------------------------------------------------------------------------


def numbered(title: str) -> tuple[str, str]:
    clean = strip(f"regexp_replace({title}, '[·.]+\\s*\\d+\\s*$', '')")
    pattern = f"^(\\d+(?:\\.\\d+)*){SPACE}+(.+)$"
    return f"regexp_extract({clean}, '{pattern}', 1)", strip(f"regexp_extract({clean}, '{pattern}', 2)")


def kind(title: str) -> str:
    t = strip(title)
    return f"""CASE WHEN {t} IN ('目录') THEN 'toc' WHEN list_contains({text_list(vocab.WARNING_TITLES)}, {t}) THEN 'warning' WHEN list_contains({text_list(fixtures.PAGE_HEADERS)}, {t}) THEN 'page_header'
       WHEN list_contains({text_list(vocab.FRONT_TITLES)}, {t}) THEN 'front_matter' WHEN {numbered(t)[0]} <> '' AND regexp_matches({t}, '[·.]{{2,}}\\s*\\d*\\s*$') THEN 'toc_entry' WHEN {numbered(t)[0]} <> '' THEN 'numbered' ELSE 'plain' END"""


O["numbered_title"] = f"SELECT id, {numbered('title')[0]} AS number, {numbered('title')[1]} AS clean FROM ({fixtures.TITLES})"
O["classify_blocks"] = f"SELECT id, {kind('title')} AS kind FROM ({fixtures.TITLES})"


def blocks(source: str) -> str:
    return f"""
parts AS (SELECT doc_id, unnest(regexp_split_to_array(text, '(?m)^#\\s')) AS part, generate_subscripts(regexp_split_to_array(text, '(?m)^#\\s'), 1) - 1 AS pos FROM {source}),
bodies AS (SELECT doc_id, pos, CASE WHEN pos = 0 THEN {strip('part')} ELSE '# ' || {strip('part')} END AS content FROM parts WHERE {strip('part')} <> ''),
titled AS (SELECT *, CASE WHEN pos = 0 THEN {strip("split_part(content, chr(10), 1)")} ELSE {strip("regexp_replace(split_part(content, chr(10), 1), '^#+\\s*', '')")} END AS title FROM bodies),
kinds AS (SELECT *, CASE WHEN pos = 0 THEN 'plain' ELSE {kind('title')} END AS block_type FROM titled),
blocks AS (SELECT doc_id, CAST(pos AS BIGINT) AS pos, title, content, block_type, CASE WHEN block_type = 'numbered' THEN {numbered('title')[0]} ELSE '' END AS section_number, CASE WHEN block_type = 'numbered' THEN {numbered('title')[1]} ELSE '' END AS clean_title FROM kinds)"""


O["split_h1"] = f"WITH {blocks(f'({fixtures.MANUALS})')} SELECT * FROM blocks"
O["split_h1_documents"] = f"""
WITH src AS (SELECT doc_id, '# ' || doc_id % 9 || ' ' || replace(text, '. ', '.' || chr(10) || '# ') AS text FROM documents), {blocks('src')}
SELECT doc_id, block_type, count(*) AS n, CAST(sum(length(content)) AS BIGINT) AS chars FROM blocks GROUP BY ALL"""


def body(x: str) -> str:
    first = f"split_part({x}, chr(10), 1)"
    return f"CASE WHEN {strip(first)} LIKE '#%' THEN {strip(f'substring({x}, length({first}) + 2)')} ELSE {strip(x)} END"


_DEEPER = "len(string_split({0}, '.'))"
_PARTS = "list_transform(string_split({0}, '.'), lambda p: CAST(p AS HUGEINT))"
_FLUSH = f"""(list_slice({_PARTS.format('anchor')}, 1, least({_DEEPER.format('anchor')}, {_DEEPER.format('num')})) <> list_slice({_PARTS.format('num')}, 1, least({_DEEPER.format('anchor')}, {_DEEPER.format('num')}))
       OR {_DEEPER.format('num')} <= {_DEEPER.format('anchor')})"""
_TYPES = "CASE " + " ".join(f"WHEN regexp_matches(section_path || ' ' || section_title, '{p}') THEN '{t}'" for p, t in vocab.CHUNK_TYPES) + " ELSE 'general' END"
_MERGE = f"""{blocks(f'({fixtures.MANUALS})')},
b1 AS (SELECT *, block_type IN ('toc', 'front_matter') AS single, CASE WHEN block_type = 'numbered' THEN section_number END AS num,
       block_type IN ('toc', 'front_matter') OR (block_type = 'plain' AND ({numbered('title')[0]} <> '' OR length({body('content')}) >= 40)) AS reset FROM blocks WHERE block_type <> 'toc_entry'),
b2 AS (SELECT *, coalesce(sum(reset::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS since,
       coalesce(lag(single) OVER (PARTITION BY doc_id ORDER BY pos), false) AS after_single, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS nth FROM b1),
b3 AS (SELECT *, last_value(num IGNORE NULLS) OVER (PARTITION BY doc_id, since ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS anchor FROM b2),
b4 AS (SELECT *, sum((nth = 1 OR reset OR after_single OR (num IS NOT NULL AND anchor IS NOT NULL AND {_FLUSH}))::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM b3),
isl AS (SELECT doc_id, CAST(island AS BIGINT) AS chunk_pos, array_to_string(list_filter(list({strip('content')} ORDER BY pos), lambda x: x <> ''), chr(10) || chr(10)) AS content, list(block_type ORDER BY pos) AS types,
        arg_min(block_type, pos) AS kind, arg_min(title, pos) AS first_title, arg_min(coalesce(anchor, ''), pos) AS leaked, arg_max(num, pos) AS num, arg_max(clean_title, pos) FILTER (num IS NOT NULL) AS clean, coalesce(max(pos) FILTER (num IS NOT NULL), min(pos)) AS ends FROM b4 GROUP BY ALL),
named AS (SELECT *, CASE WHEN kind = 'toc' THEN '' WHEN kind = 'front_matter' THEN leaked ELSE coalesce(num, '') END AS section_number,
        CASE WHEN kind = 'toc' THEN '目录' WHEN kind = 'front_matter' THEN first_title WHEN num IS NOT NULL THEN num || ' ' || clean ELSE first_title END AS section_title FROM isl),
anc AS (SELECT doc_id, chunk_pos, ends, unnest(range(1, len(string_split(section_number, '.')) + 1)) AS n, section_number FROM named WHERE section_number <> ''),
keys AS (SELECT doc_id, chunk_pos, ends, n, array_to_string(string_split(section_number, '.')[1:n], '.') AS key FROM anc),
own AS (SELECT k.*, max(b.pos) AS opos, arg_max(b.clean_title, b.pos) AS otitle FROM keys k JOIN b4 b ON b.doc_id = k.doc_id AND b.num = k.key AND b.pos <= k.ends GROUP BY ALL),
live AS (SELECT * FROM own o WHERE NOT EXISTS (SELECT 1 FROM b4 q WHERE q.doc_id = o.doc_id AND q.num IS NOT NULL AND q.pos > o.opos AND q.pos <= o.ends AND q.num <> o.key
         AND {_DEEPER.format('q.num')} <= {_DEEPER.format('o.key')} AND NOT starts_with(o.key, q.num || '.') AND NOT starts_with(q.num, o.key || '.'))),
paths AS (SELECT doc_id, chunk_pos, array_to_string(list(key || ' ' || otitle ORDER BY n), ' > ') AS path FROM live GROUP BY ALL),
pathed AS (SELECT named.*, CASE WHEN section_number = '' THEN section_title ELSE coalesce(path, '') END AS section_path FROM named LEFT JOIN paths USING (doc_id, chunk_pos)),
merged AS (SELECT doc_id, chunk_pos, content, section_title, section_number, section_path, CASE WHEN kind = 'toc' THEN 'toc' WHEN kind = 'front_matter' THEN 'meta' ELSE {_TYPES} END AS chunk_type, array_to_string(types, ',') AS block_types FROM pathed)"""
O["merge_blocks"] = f"WITH {_MERGE} SELECT * FROM merged"
_STEPS = f"list_filter(list_transform(string_split(regexp_replace(content, '(?m)^([ \\t]*步骤[ \\t]*\\d+)', chr(1) || '\\1', 'g'), chr(1)), lambda p: {strip('p')}), lambda p: p <> '')"
O["step_split"] = f"SELECT chunk_id, array_to_string({_STEPS}, '|') AS parts FROM ({fixtures.OVERSIZE})"


def packed(x: str, most: int) -> str:
    """Greedy packing in one fold: closed parts end with chr(2), the open one stands last."""
    paragraphs = f"list_filter(regexp_split_to_array({x}, '\\n\\s*\\n'), lambda p: {strip('p')} <> '')"
    open_ = "list_last(string_split(a, chr(2)))"
    joined = f"{open_} || chr(10) || chr(10) || p"
    fold = f"list_reduce({paragraphs}, lambda a, p: CASE WHEN {tokens(joined)} > {most} THEN a || chr(2) || p ELSE a || chr(10) || chr(10) || p END)"
    return f"list_transform(string_split({fold}, chr(2)), lambda q: {strip('q')})"


O["paragraph_pack"] = f"SELECT chunk_id, array_to_string({packed('content', 6)}, '|') AS parts FROM ({fixtures.OVERSIZE})"
_PACKED = packed("replace(text, chr(10), chr(10) || chr(10))", 120)
O["paragraph_pack_documents"] = f"""
WITH p AS (SELECT doc_id, unnest({_PACKED}) AS part FROM documents)
SELECT doc_id, count(*) AS parts, max({tokens('part')}) AS longest, CAST(sum(length(part)) AS BIGINT) AS chars FROM p GROUP BY ALL"""
_FULL = "'[产品: ' || coalesce(display_name, md_stem) || ' | 章节路径: ' || coalesce(nullif(section_path, ''), section_title) || ' | 类型: ' || chunk_type || ']' || chr(10) || clean"
O["chunk_pipeline"] = f"""
WITH {_MERGE},
kept AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_pos) - 1 AS idx FROM merged WHERE chunk_type IN ('toc', 'meta') OR length({body('content')}) >= 60 OR contains(content, '![') OR contains(lower(content), '<table')),
rows_ AS (SELECT 'doc-' || md5(m.md_stem) AS full_doc_id, k.*, m.md_stem || '.md' AS file_path, p.* FROM kept k JOIN ({fixtures.MANUALS}) m USING (doc_id) JOIN ({fixtures.PRODUCTS}) p ON p.md_stem = m.md_stem),
img AS (SELECT *, {chunk_images('content', 'full_doc_id')} AS images, {cleaned('content')} AS clean FROM rows_),
done AS (SELECT *, {_FULL} AS entire FROM img WHERE clean <> '')
SELECT 'chunk-' || md5(full_doc_id || '|' || idx || '|' || entire) AS chunk_id, CAST({tokens('entire')} AS INTEGER) AS tokens, entire AS content, CAST(idx AS INTEGER) AS chunk_order_index, full_doc_id, file_path,
       array_to_string(images, '|') AS image_paths, product_id, series_id, display_name, section_title, section_number, section_path, chunk_type, manual_pdf AS source_pdf, md5(entire) AS content_hash,
       CAST(1700000000 AS BIGINT) AS create_time, CAST(1700000000 AS BIGINT) AS update_time
FROM done WHERE {tokens('entire')} >= 20 OR len(images) > 0 OR contains(lower(clean), '<table')"""

# --- ranking and context ----------------------------------------------------------------------------------------------


def by_topic(words: dict[str, list[str]], title: str) -> str:
    return "CASE bucket " + " ".join(f"WHEN '{b}' THEN {any_of(title, w)}" for b, w in words.items()) + " ELSE false END"


_T, _B = strip("section_title"), strip("content")
_BOOST, _OFF = by_topic(vocab.TOPIC_BOOST, _T), by_topic(vocab.TOPIC_OFF, _T)
O["postrank"] = f"""
WITH r AS (SELECT query_id, chunk_id, score, coalesce(is_intro, false) AND {any_of(_T, vocab.OVERVIEW_TITLES)} AS a, {_BOOST} AS b, ({_OFF}) AND NOT ({_BOOST}) AS c,
       list_contains({text_list(vocab.LOW_VALUE_TITLES)}, {_T}) OR {_T} LIKE '目录%' AS d, length({_B}) < 80 AND len(coalesce(image_paths, CAST([] AS VARCHAR[]))) = 0 AND NOT contains(lower({_B}), '<table') AS e FROM ({fixtures.RANKED})),
s1 AS (SELECT *, CASE WHEN a THEN least(1.0::DOUBLE, score + 0.3::DOUBLE) ELSE score END AS s FROM r), s2 AS (SELECT * REPLACE (CASE WHEN b THEN least(1.0::DOUBLE, s + 0.25::DOUBLE) ELSE s END AS s) FROM s1),
s3 AS (SELECT * REPLACE (CASE WHEN c THEN greatest(0.0::DOUBLE, s - 0.35::DOUBLE) ELSE s END AS s) FROM s2), s4 AS (SELECT * REPLACE (CASE WHEN d THEN greatest(0.0::DOUBLE, s - 0.4::DOUBLE) ELSE s END AS s) FROM s3)
SELECT query_id, chunk_id, round(CASE WHEN e THEN greatest(0.0::DOUBLE, s - 0.25::DOUBLE) ELSE s END, 6) AS score FROM s4"""
O["topic_filter"] = f"SELECT query_id, chunk_id FROM ({fixtures.RANKED}) WHERE NOT (({_OFF}) AND NOT ({_BOOST}))"
_DOCS = "d AS (SELECT doc_id % 50 AS query_id, doc_id AS chunk_id, CAST(1.0::DOUBLE / (1.0::DOUBLE + n_chars / 1000.0::DOUBLE) AS DOUBLE) AS score FROM documents)"
O["score_gap"] = f"""WITH {_DOCS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank, max(score) OVER (PARTITION BY query_id) AS top FROM d)
SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM r WHERE rank <= 2 OR (rank <= 6 AND top - score <= 0.25::DOUBLE)"""
O["min_score"] = f"WITH {_DOCS} SELECT query_id, chunk_id, round(score, 6) AS score FROM d WHERE score >= 0.15::DOUBLE"
_CATALOG = f"""
i0 AS (SELECT *, row_number() OVER (PARTITION BY query_id, rel_path ORDER BY chunk_rank, pos) AS seen FROM ({fixtures.IMAGES}) WHERE coalesce(width >= 80 AND height >= 80, true)),
i1 AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_rank ORDER BY pos) AS nth, row_number() OVER (PARTITION BY query_id ORDER BY chunk_rank, pos) AS k FROM i0 WHERE seen = 1),
catalog AS (SELECT query_id, '图-' || k AS image_id, k AS vision_index, rel_path, '/kb_images/' || regexp_replace(rel_path, '^images/', '') AS display_url, {_T} AS section_title, coalesce({captions('content')}[nth], '') AS caption_hint FROM i1 WHERE k <= 5)"""
O["image_catalog"] = f"WITH {_CATALOG} SELECT * FROM catalog"
_RANKED = """
rd AS (SELECT doc_id // 10 AS query_id, doc_id % 10 + 1 AS rank, doc_id AS chunk_id, source AS display_name, CASE WHEN doc_id % 4 > 0 THEN lang END AS section_title, source, text AS content, CAST(1.0::DOUBLE - (doc_id % 10) / 64.0::DOUBLE AS DOUBLE) AS score,
       CASE WHEN doc_id % 10 = 0 THEN ['images/d/a.png', 'images/d/c.png'] ELSE CAST([] AS VARCHAR[]) END AS image_paths FROM documents)"""
_LINE = "'  - [' || c.image_id || '] ' || c.display_url || CASE WHEN c.caption_hint <> '' THEN '（' || c.caption_hint || '）' ELSE '' END || ' [随附视觉输入第' || c.vision_index || '张]'"
# scores are multiples of 1/64, where rounding half up and half to even may differ in the third place: 5 is added in the sixth
O["context_text"] = f"""
WITH {_RANKED.strip()}, {_CATALOG.strip()},
ip AS (SELECT query_id, rank, unnest(image_paths) AS rel_path, generate_subscripts(image_paths, 1) AS k FROM rd),
lines AS (SELECT ip.query_id, ip.rank, array_to_string(list({_LINE} ORDER BY ip.k), chr(10)) AS l FROM ip JOIN catalog c ON c.query_id = ip.query_id AND c.rel_path = ip.rel_path GROUP BY ALL),
parts AS (SELECT rd.query_id, rd.rank, '--- 片段 ' || rd.rank || ' ---' || chr(10) || '产品: ' || display_name || chr(10) || '章节: ' || coalesce(section_title, '未知') || chr(10) || '相关度: ' || printf('%.3f', score + 0.000005::DOUBLE) || chr(10)
       || CASE WHEN l IS NOT NULL THEN '配图（回答中请用 [图-N] 占位符紧跟对应段落后插入，勿写 URL）:' || chr(10) || l || chr(10) ELSE '' END || '内容:' || chr(10) || {_B} || chr(10) AS part,
       length({_B}) >= 60 OR l IS NOT NULL OR contains(lower({_B}), '<table') AS kept FROM rd LEFT JOIN lines USING (query_id, rank)),
heads AS (SELECT query_id, '随附视觉输入共 ' || count(*) || ' 张，顺序与编号一致：' || array_to_string(list(image_id ORDER BY vision_index), '、') || '。' || chr(10) AS h FROM catalog GROUP BY ALL)
SELECT query_id, array_to_string(list_concat(['以下片段按相关度排序，请围绕用户问题筛选整合，不必全部写入回答。' || chr(10)], CASE WHEN any_value(h) IS NULL THEN CAST([] AS VARCHAR[]) ELSE [any_value(h)] END, coalesce(list(part ORDER BY rank) FILTER (kept), CAST([] AS VARCHAR[]))), chr(10)) AS context
FROM parts LEFT JOIN heads USING (query_id) GROUP BY query_id"""
O["sources_json"] = f"WITH {_RANKED.strip()} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) - 1 AS pos, display_name, section_title, left(content, 300) AS snippet, round(score, 6) AS score FROM rd"
_SRC = "coalesce(CASE WHEN chunk_id % 2 = 0 THEN source END, 'a/b/' || chunk_id || '.md')"
O["search_response"] = f"WITH {_RANKED.strip()} SELECT query_id, rank, chunk_id, left(content, 500) AS content, coalesce(section_title, list_last(string_split({_SRC}, '/'))) AS title, {_SRC} AS source, round(score, 6) AS score FROM rd"
O["history_last6"] = """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations)
SELECT conv_id, array_to_string(list(CASE role WHEN 'user' THEN 'User: ' ELSE 'AI: ' END || text ORDER BY turn), chr(10)) AS history FROM r WHERE back <= 6 AND role IN ('user', 'assistant') GROUP BY ALL"""

# --- synchronisation --------------------------------------------------------------------------------------------------

O["sync_diff"] = f"""
SELECT product_id, CASE WHEN NOT configured OR (sha256 IS NULL AND old_sha IS NOT NULL) THEN 'removed' WHEN sha256 IS NULL THEN 'missing' WHEN old_sha IS NULL THEN 'new'
       WHEN sha256 = old_sha AND mtime = old_mtime AND coalesce(old_doc, '') <> '' THEN 'unchanged' ELSE 'changed' END AS status FROM ({fixtures.SNAPSHOTS})"""
O["sync_apply"] = """
SELECT doc_id AS chunk_id, text AS content, source AS product_id FROM documents WHERE source <> 'src1' AND length(text) BETWEEN 200 AND 1000
UNION ALL SELECT doc_id, CASE WHEN length(text) > 1000 THEN 'new ' || text ELSE text END, source FROM documents WHERE length(text) > 1000 OR source = 'src1'"""
O["sync_payload"] = "SELECT doc_id AS chunk_id FROM documents WHERE (length(text) > 1000 OR source = 'src1') AND trim(text) <> ''"
O["tombstones"] = "SELECT DISTINCT CAST(doc_id AS VARCHAR) AS chunk_id FROM documents WHERE length(source) = 4"
O["remove_documents"] = "SELECT doc_id AS chunk_id, 'doc-' || md5(source) AS full_doc_id FROM documents WHERE source >= 'src1'"
O["manifest_entries"] = """
SELECT source AS product_id, 'x.pdf' AS source_pdf, 'doc-' || md5(source) AS full_doc_id, array_to_string(list(CAST(doc_id AS VARCHAR) ORDER BY doc_id), ',') AS chunk_ids,
       CASE WHEN source <> 'src0' THEN sha256(source) END AS pdf_sha256, CASE WHEN source <> 'src0' THEN 1.5::DOUBLE END AS pdf_mtime FROM documents GROUP BY source"""

# --- message frames ---------------------------------------------------------------------------------------------------

O["sse_parse"] = f"""
WITH w AS (SELECT request_id, string_agg(raw, '' ORDER BY seq) AS raw FROM ({fixtures.SSE}) GROUP BY ALL),
p AS (SELECT request_id, string_split(raw, chr(10) || chr(10)) AS l FROM w),
f AS (SELECT request_id, l[-1] AS rest, list_transform(l[1:-2], lambda x: struct_pack(
        e := coalesce(trim(substring(list_last(list_filter(string_split(x, chr(10)), lambda y: y LIKE 'event:%')), 7)), 'message'),
        d := array_to_string(list_transform(list_filter(string_split(x, chr(10)), lambda y: y LIKE 'data:%'), lambda y: trim(substring(y, 6))), ''))) AS ev FROM p)
SELECT request_id, array_to_string(list_transform(list_filter(ev, lambda v: v.d <> '' AND json_valid(v.d)), lambda v: v.e || '=' || v.d), '|') AS events, rest FROM f"""
O["llm_stream_decode"] = f"""
WITH b AS (SELECT request_id, seq, trim(regexp_replace(trim(line), '^data:', '')) AS j FROM ({fixtures.STREAM})),
v AS (SELECT request_id, seq, CASE WHEN json_valid(j) THEN CASE WHEN j LIKE '[%' THEN j ELSE '[' || j || ']' END END AS a FROM b),
x AS (SELECT request_id, seq, array_to_string(coalesce(CAST(json_extract_string(a, '$[*].candidates[0].content.parts[*].text') AS VARCHAR[]), CAST([] AS VARCHAR[])), '') AS text FROM v)
SELECT request_id, string_agg(text, '' ORDER BY seq) AS answer FROM x GROUP BY ALL"""

ORACLES = O
