"""The same queries in DuckDB's SQL, written on their own as a check of the engine's plans."""

# The white space of JavaScript's \s, for RE2.
_WS = r"[\s\x0B\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
_PATH = r"regexp_extract(url, '^\w+://[^/?#]*([^?#]*)', 1)"


def _trim(x: str) -> str:
    return rf"regexp_replace({x}, '^{_WS}+|{_WS}+\z', '', 'g')"


def _chain(x: str, *steps: tuple[str, str]) -> str:
    for pattern, to in steps:
        x = f"regexp_replace({x}, '{pattern}', {to}, 'g')"
    return x


def _words(x: str) -> str:
    return rf"list_filter(string_split_regex({x}, '{_WS}+'), lambda w: w <> '')"


_HTML = _trim(_chain(
    "html", (r"(?is)<script.*?</script>", "' '"), (r"(?is)<style.*?</style>", "' '"), (r"(?i)</(p|div|br|li|tr|h[1-6])>", "chr(10)"),
    (rf"(?i)<br{_WS}*/?>", "chr(10)"), (r"<[^>]+>", "' '"), ("(?i)&nbsp;", "' '"), ("(?i)&amp;", "'&'"), ("(?i)&lt;", "'<'"), ("(?i)&gt;", "'>'"),
    (r"[ \t]+", "' '"), (r"\n{3,}", "chr(10) || chr(10)"),
))
_OFFICE = _trim(_chain(
    "html", (r"<text:tab/?>", "chr(9)"), (r"<text:line-break/?>", "chr(10)"), (r"</text:p>", "chr(10)"), (r"</a:p>", "chr(10)"), (r"<a:br/?>", "chr(10)"),
    (r"<[^>]+>", "' '"), ("&amp;", "'&'"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "chr(34)"), ("&apos;", "chr(39)"), (r"[ \t]+", "' '"), (r"\n{3,}", "chr(10) || chr(10)"),
))

_TIDY = _trim(_chain("text", (r"[ \t]+", "' '"), (r"\n{3,}", "chr(10) || chr(10)")))

_CHATS = """
WITH chats AS (
  SELECT conv_id, string_agg(CASE WHEN conv_id % 2 = 0 THEN '[12/03/24, 9:41:' || lpad((turn % 60)::VARCHAR, 2, '0') || '] ' || role || ': ' ELSE '' END || text, chr(10) ORDER BY turn) AS text
  FROM conversations GROUP BY conv_id
)"""
_HEAD = (
    rf"^{_WS}*(?:\[)?\d{{1,2}}[/.]\d{{1,2}}[/.]\d{{2,4}},?{_WS}+\d{{1,2}}:\d{{2}}(?::\d{{2}})?{_WS}*(?:[APap]\.?[Mm]\.?)?{_WS}*(?:\])?{_WS}*"
    rf"(?:-{_WS}*)?([^:]{{1,80}}?):{_WS}?([^\n\r\x{{2028}}\x{{2029}}]*)\z"
)

_DOC_CHUNKS = f"""
WITH words AS (SELECT doc_id, {_words("text")} AS w FROM documents),
windows AS (
  SELECT doc_id, w, unnest(range(CASE WHEN len(w) = 0 THEN 0 WHEN len(w) <= 365 THEN 1 ELSE 1 + ceil((len(w) - 365) / 320.0)::INT END)) AS k FROM words
),
chunks AS (SELECT doc_id, k::INT AS chunk_id, NULL::INT AS page, array_to_string(list_slice(w, k * 320 + 1, k * 320 + 365), ' ') AS texto FROM windows)"""
_CONV_CHUNKS = f"""
WITH words AS (SELECT conv_id, turn, {_words("text")} AS w FROM conversations),
windows AS (
  SELECT conv_id, turn, w, unnest(range(CASE WHEN len(w) = 0 THEN 0 WHEN len(w) <= 365 THEN 1 ELSE 1 + ceil((len(w) - 365) / 320.0)::INT END)) AS k FROM words
),
chunks AS (
  SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, k) - 1)::INT AS chunk_id, (turn + 1)::INT AS page,
         array_to_string(list_slice(w, k * 320 + 1, k * 320 + 365), ' ') AS texto
  FROM windows
)"""


def _read(chunks: str, by: str, since: int, count: int) -> str:
    return rf"""{chunks},
totals AS (SELECT {by}, count(*)::INT AS n FROM chunks GROUP BY {by}),
chosen AS (
  SELECT *, last_value(page IGNORE NULLS) OVER (PARTITION BY {by} ORDER BY chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM chunks WHERE chunk_id >= {since} AND chunk_id < {since + count}
),
texts AS (
  SELECT {by}, string_agg(CASE WHEN page IS NOT NULL AND page IS DISTINCT FROM before THEN chr(10) || chr(10) || '[pág. ' || page || ']' || chr(10) ELSE '' END || texto || chr(10), '' ORDER BY chunk_id) AS t
  FROM chosen GROUP BY {by}
)
SELECT {by}, n AS total_fragmentos, {since}::INT AS desde_fragmento, least({since + count}, n)::INT AS hasta_fragmento,
       CASE WHEN least({since + count}, n) < n THEN least({since + count}, n)::INT END AS siguiente_fragmento,
       coalesce({_trim("t")}, '') AS texto
FROM totals LEFT JOIN texts USING ({by})"""


def _cosine(x: str, y: str) -> str:
    return f"round(coalesce(list_cosine_similarity({x}::DOUBLE[], {y}::DOUBLE[]), 0), 9)"


def _batch(where: str, most: int = 5) -> str:
    return f"""
SELECT query_id, vec_id, rank::INT AS rank, round(s, 4) AS score FROM (
  SELECT q.vec_id AS query_id, e.vec_id, s, row_number() OVER (PARTITION BY q.vec_id ORDER BY s DESC, e.vec_id) AS rank
  FROM (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 100 = 0) q, embeddings e, LATERAL (SELECT {_cosine("e.embedding", "q.embedding")} AS s) {where}
) WHERE rank <= {most}"""


_REGISTRY = f"""
WITH lab AS (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id),
registry AS (
  SELECT d.doc_id, source || '/' || d.doc_id || '.txt' AS ruta_relativa, coalesce(toxic = 1, false) AS sin_ocr,
         (CASE WHEN coalesce(toxic = 1, false) OR n = 0 THEN 0 WHEN n <= 365 THEN 1 ELSE 1 + ceil((n - 365) / 320.0) END)::INT AS num_chunks
  FROM (SELECT doc_id, source, len({_words("text")}) AS n FROM documents) d LEFT JOIN lab USING (doc_id)
)"""
_STALE = """
WITH files AS (SELECT '/docs/' || doc_id AS path, n_chars AS size, doc_id AS mtime FROM documents),
known AS (
  SELECT '/docs/' || doc_id AS path, n_chars + (doc_id % 7 = 0)::INT AS size, doc_id - (doc_id % 5 = 0)::INT AS mtime FROM documents WHERE doc_id % 11 <> 0
  UNION ALL SELECT '/gone/' || doc_id, n_chars, doc_id FROM documents WHERE doc_id % 13 = 0
),
stale AS (
  SELECT coalesce(f.path, k.path) AS path,
         CASE WHEN f.path IS NULL THEN 'gone' WHEN k.path IS NULL THEN 'new' WHEN f.size = k.size AND f.mtime = k.mtime THEN 'same' ELSE 'modified' END AS change
  FROM files f FULL JOIN known k ON f.path = k.path
)"""
_EVENTS = "WITH e AS (SELECT user_id, CASE WHEN event_type = 'error' THEN 'remove' ELSE 'index' END AS kind, ts, event_id FROM events)"

SQL: dict[str, str] = {
    "q01_ext_family": rf"""
SELECT page_id, ext, family, family IS NOT NULL AS supported FROM (
  SELECT page_id, ext, CASE WHEN ext = '.pdf' THEN 'pdf' WHEN ext = '.docx' THEN 'docx' WHEN ext IN ('.txt', '.md', '.markdown') THEN 'text'
    WHEN ext IN ('.html', '.htm') THEN 'html' WHEN ext = '.rtf' THEN 'rtf' WHEN ext IN ('.odt', '.odp', '.pptx') THEN 'office'
    WHEN ext IN ('.xlsx', '.xls', '.ods', '.xlsm', '.fods') THEN 'sheet' WHEN ext IN ('.csv', '.tsv') THEN 'csv' WHEN ext = '.eml' THEN 'eml' WHEN ext = '.msg' THEN 'msg'
    WHEN ext IN ('.jpg', '.jpeg', '.png', '.tiff', '.tif', '.bmp', '.gif', '.heic', '.heif') THEN 'image' WHEN ext IN ('.zip', '.rar', '.7z') THEN 'archive' END AS family
  FROM (SELECT page_id, lower(regexp_extract({_PATH}, '[^/](\.[^./]*)$', 1)) AS ext FROM pages))""",
    "q02_doc_id": "SELECT page_id, substr(sha1(url), 1, 16) AS doc_id FROM pages",
    "q03_root_lookup": rf"""
WITH f AS (SELECT page_id, '/corpus' || regexp_replace({_PATH}, '/+$', '') AS path FROM pages), roots(name, folder) AS (VALUES ('corpus-en', '/corpus/en'), ('corpus-fr', '/corpus/fr')),
m AS (SELECT page_id, arg_max(name, length(folder)) AS name, max(length(folder)) AS n FROM f JOIN roots ON path = folder OR starts_with(path, folder || '/') GROUP BY page_id)
SELECT f.page_id, m.name AS raiz, CASE WHEN m.name IS NULL THEN regexp_extract(path, '([^/]*)/*$', 1) WHEN length(path) = n THEN m.name ELSE m.name || substr(path, n + 1) END AS ruta_relativa
FROM f LEFT JOIN m ON f.page_id = m.page_id""",
    "q04_root_names": """
SELECT n_nationkey, 'region' || n_regionkey || CASE WHEN k = 1 THEN '' ELSE '-' || k END AS name
FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k FROM nation)""",
    "q05_trim_pages": f"SELECT * FROM (SELECT doc_id, NULL::INT AS page, {_trim('chr(160) || chr(10) || chr(9) || text || chr(12288) || chr(32) || chr(65279)')} AS texto FROM documents) WHERE texto <> ''",
    "q06_html_to_text": f"SELECT page_id, {_HTML} AS texto FROM pages",
    "q07_office_xml": f"SELECT page_id, {_OFFICE} AS texto FROM pages",
    "q08_chat_detect": rf"""{_CHATS}
SELECT conv_id, checked::INT AS checked, matched::INT AS matched, checked > 0 AND matched / checked >= 0.6 AS is_chat FROM (
  SELECT conv_id, len(f) AS checked, len(list_filter(f, lambda l: regexp_matches(l, '{_HEAD}'))) AS matched
  FROM (SELECT conv_id, list_slice(list_filter(string_split_regex(text, '\r?\n'), lambda l: {_trim("l")} <> ''), 1, 40) AS f FROM chats))""",
    "q09_chat_join": rf"""{_CHATS},
lines AS (SELECT conv_id, unnest(string_split_regex(text, '\r?\n')) AS line, generate_subscripts(string_split_regex(text, '\r?\n'), 1) AS pos FROM chats),
marked AS (SELECT *, regexp_matches(line, '{_HEAD}') AS head FROM lines),
grouped AS (SELECT *, sum(head::INT) OVER (PARTITION BY conv_id ORDER BY pos) AS g FROM marked),
messages AS (
  SELECT conv_id, CASE WHEN g = 0 THEN pos ELSE 0 END AS p, g, min(pos) AS pos,
         string_agg(CASE WHEN head THEN {_trim(f"regexp_extract(line, '{_HEAD}', 1)")} || ': ' || regexp_extract(line, '{_HEAD}', 2) WHEN g > 0 THEN ' ' || {_trim("line")} ELSE {_trim("line")} END, '' ORDER BY pos) AS m
  FROM grouped WHERE g > 0 OR {_trim("line")} <> '' GROUP BY conv_id, p, g
)
SELECT c.conv_id, coalesce(string_agg(m, chr(10) ORDER BY pos), '') AS texto FROM chats c LEFT JOIN messages x ON c.conv_id = x.conv_id GROUP BY c.conv_id""",
    "q10_csv_label": """
SELECT s_suppkey, true AS labelled, concat_ws(' | ', 's_suppkey: ' || nullif(s_suppkey::VARCHAR, '0'), 's_name: ' || nullif(nullif(s_name, ''), '0'), 's_nationkey: ' || nullif(s_nationkey::VARCHAR, '0'), 's_acctbal: ' || s_acctbal::VARCHAR) AS line
FROM supplier""",
    "q11_csv_headerless": "SELECT l_orderkey, l_linenumber, false AS labelled, concat_ws(' | ', l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity) AS line FROM lineitem",
    "q12_chunk_documents": f"{_DOC_CHUNKS} SELECT doc_id, chunk_id, texto FROM chunks",
    "q13_chunk_pages": f"{_CONV_CHUNKS} SELECT conv_id, chunk_id, page, texto FROM chunks",
    "q14_hash_vector": f"""
WITH c AS (SELECT doc_id, bucket, count(*) AS n FROM (SELECT doc_id, (('0x' || substr(md5(w), 1, 8))::BIGINT % 384)::INT AS bucket FROM (SELECT doc_id, unnest({_words("text")}) AS w FROM documents)) GROUP BY ALL)
SELECT doc_id, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 4) AS weight FROM c""",
    "q15_topk": _batch("", 10),
    "q16_topk_prefilter": f"SELECT query_id, vec_id, score FROM ({_batch('WHERE e.label = 3', 10)})",
    "q17_topk_overfetch": f"""SELECT query_id, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS own FROM ({_batch("", 50)}) JOIN (SELECT vec_id, label FROM embeddings) USING (vec_id) WHERE label = 3
) WHERE own <= 10""",
    "q18_topk_batch": _batch(""),
    "q19_self_exclude_neighbours": _batch("WHERE q.vec_id <> e.vec_id"),
    "q20_search_documents": f"""{_DOC_CHUNKS},
cb AS (SELECT doc_id, chunk_id, ('0x' || substr(md5(w), 1, 8))::BIGINT % 384 AS b, count(*) AS n FROM (SELECT doc_id, chunk_id, unnest(string_split(texto, ' ')) AS w FROM chunks) GROUP BY ALL),
qb AS (SELECT item_id, ('0x' || substr(md5(w), 1, 8))::BIGINT % 384 AS b, count(*) AS n FROM (SELECT item_id, unnest({_words("text")}) AS w FROM benchmark WHERE item_id % 100 = 0) GROUP BY ALL),
cn AS (SELECT doc_id, chunk_id, sqrt(sum(n * n)) AS z FROM cb GROUP BY ALL), qn AS (SELECT item_id, sqrt(sum(n * n)) AS z FROM qb GROUP BY ALL),
dots AS (SELECT item_id, doc_id, chunk_id, sum(cb.n * qb.n) AS d FROM cb JOIN qb USING (b) GROUP BY ALL),
scored AS (SELECT qn.item_id, cn.doc_id, cn.chunk_id, round(coalesce(d, 0) / qn.z / cn.z, 9) AS s FROM qn CROSS JOIN cn LEFT JOIN dots USING (item_id, doc_id, chunk_id))
SELECT item_id, doc_id, chunk_id, rank::INT AS rank, round(s, 4) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY s DESC, doc_id, chunk_id) AS rank FROM scored) WHERE rank <= 20""",
    "q21_get_chunk": f"{_DOC_CHUNKS} SELECT doc_id, chunk_id, texto, doc_id || '.txt' AS fichero, 'docs/' || doc_id || '.txt' AS ruta_relativa, page AS pagina FROM chunks WHERE chunk_id = 1",
    "q22_read_document": _read(_CONV_CHUNKS, "conv_id", 0, 60),
    "q23_read_paging": _read(_DOC_CHUNKS, "doc_id", 1, 2),
    "q24_list": f"{_REGISTRY} SELECT row_number() OVER (ORDER BY ruta_relativa)::INT AS place, doc_id, ruta_relativa, num_chunks AS fragmentos, NULL::INT AS paginas, sin_ocr FROM registry WHERE starts_with(ruta_relativa, 'src1/')",
    "q25_stats": f"""{_REGISTRY} SELECT count(*) FILTER (NOT sin_ocr) AS documentos, coalesce(sum(num_chunks), 0)::BIGINT AS fragmentos,
  coalesce(string_agg(lpad(doc_id::VARCHAR, 12, '0'), ',' ORDER BY doc_id) FILTER (sin_ocr), '') AS sin_ocr FROM registry""",
    "q26_stale": f"{_STALE} SELECT path, change FROM stale",
    "q27_run_summary": f"""{_STALE} SELECT count(*) FILTER (change IN ('new', 'modified')) AS indexados, count(*) FILTER (change = 'same') AS sin_cambios, 0::BIGINT AS sin_ocr,
  count(*) FILTER (change = 'gone') AS omitidos, 0::BIGINT AS errores, count(*) FILTER (change IN ('new', 'modified')) AS fragmentos_nuevos FROM stale""",
    "q28_upsert_delete": """
WITH low AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 0), bad AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1)
SELECT doc_id, md5(CASE WHEN doc_id IN (SELECT doc_id FROM low) THEN 'v2 ' ELSE '' END || text) AS digest FROM documents
WHERE doc_id IN (SELECT doc_id FROM low) OR doc_id NOT IN (SELECT doc_id FROM bad)""",
    "q29_change_log": f"{_EVENTS} SELECT user_id, arg_max(kind, (ts, event_id)) AS kind, count(*) AS events FROM e GROUP BY user_id",
    "q30_debounce": f"""{_EVENTS},
gaps AS (SELECT *, coalesce(ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE, true) AS new FROM e),
runs AS (SELECT *, sum(new::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM gaps)
SELECT user_id, epoch_us(min(ts)) AS since_us, arg_max(kind, (ts, event_id)) AS kind, count(*) AS events FROM runs GROUP BY user_id, g""",
    "q31_scanned": rf"""
SELECT conv_id, pages, chars, pages > 0 AND chars / pages < 12 AS sin_ocr
FROM (SELECT conv_id, count(*) AS pages, sum(length({_trim(_chain("text", (r"[ \t]+", "' '")))}))::BIGINT AS chars FROM conversations GROUP BY conv_id)""",
    "q32_archive_guard": """
SELECT *, members_before < 20 AND bytes_before < 60000 AS read FROM (
  SELECT source AS archive, doc_id, n_chars AS size, count(*) OVER w AS members_before, coalesce(sum(n_chars) OVER w, 0)::BIGINT AS bytes_before
  FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""",
    "q33_version": """
SELECT remote, local, x > y AS newer FROM (
  SELECT remote, local, list_transform(range(1, 5), lambda i: coalesce(try_cast(regexp_extract(string_split(remote, '.')[i], '^\\s*([+-]?\\d+)', 1) AS BIGINT), 0)) AS x,
         list_transform(range(1, 5), lambda i: coalesce(try_cast(regexp_extract(string_split(local, '.')[i], '^\\s*([+-]?\\d+)', 1) AS BIGINT), 0)) AS y
  FROM (VALUES ('1.2.2', '1.2.1'), ('1.2', '1.2.0'), ('1.10.0', '1.9.9'), ('2', '10'), ('1.2.x', '1.2.0'), ('1.2.1', '1.2'), ('x.y', '0.0.1'), ('0.0.2', '0.0.10')) v(remote, local))""",
    "q34_extract_text": f"SELECT * FROM (SELECT doc_id, 0::INT AS seq, NULL::INT AS page, {_trim('text')} AS texto FROM documents) WHERE texto <> ''",
    "q35_extract_html": f"SELECT * FROM (SELECT page_id, 0::INT AS seq, NULL::INT AS page, {_HTML} AS texto FROM pages) WHERE texto <> ''",
    "q36_extract_docx": f"SELECT * FROM (SELECT conv_id, 0::INT AS seq, NULL::INT AS page, {_trim("string_agg(text, chr(10) || chr(10) ORDER BY turn)")} AS texto FROM conversations GROUP BY conv_id) WHERE texto <> ''",
    "q37_extract_pptx": f"""SELECT conv_id, (n - 1)::INT AS seq, n::INT AS page, texto
FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, texto FROM (SELECT conv_id, turn, {_TIDY} AS texto FROM conversations) WHERE texto <> '')""",
    "q38_extract_csv": """SELECT s_nationkey::BIGINT AS s_nationkey, 0::INT AS seq, NULL::INT AS page, '[columnas: s_suppkey, s_name, s_acctbal]' || chr(10) ||
  string_agg('s_suppkey: ' || s_suppkey || ' | s_name: ' || s_name || ' | s_acctbal: ' || s_acctbal, chr(10) ORDER BY s_suppkey) AS texto FROM supplier GROUP BY s_nationkey""",
    "q39_extract_xlsx": """SELECT o_custkey, 0::INT AS seq, 1::INT AS page, '[hoja: c' || o_custkey || ']' || chr(10) ||
  string_agg(o_orderkey || ' | ' || printf('%.2f', o_totalprice) || ' | ' || strftime(o_orderdate, '%Y-%m-%d'), chr(10) ORDER BY o_orderkey) AS texto FROM orders GROUP BY o_custkey""",
    "q40_extract_fods": """SELECT n_regionkey::BIGINT AS n_regionkey, 0::INT AS seq, 1::INT AS page, '[hoja: r' || n_regionkey || ']' || chr(10) ||
  string_agg(n_nationkey || ' | ' || n_name, chr(10) ORDER BY n_nationkey) AS texto FROM nation GROUP BY n_regionkey""",
    "q41_extract_mail": f"""WITH turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k, {_trim("text")} AS text FROM conversations),
attached AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY k) AS n FROM turns WHERE k > 0 AND text <> '')
SELECT conv_id, 0::INT AS seq, NULL::INT AS page, {_trim("'Asunto: conv ' || conv_id || chr(10) || 'De: a@example.org' || chr(10) || 'Para: b@example.org' || chr(10) || chr(10) || text")} AS texto FROM turns WHERE k = 0
UNION ALL SELECT conv_id, (2 * n - 1)::INT, NULL, '[adjunto: t' || k || '.txt]' FROM attached
UNION ALL SELECT conv_id, (2 * n)::INT, NULL, text FROM attached""",
    "q42_extract_zip": f"""WITH members AS (
  SELECT doc_id // 40 AS archive, doc_id, {_trim("text")} AS text, count(*) OVER w AS members_before, coalesce(sum(strlen(text)) OVER w, 0) AS bytes_before
  FROM documents WINDOW w AS (PARTITION BY doc_id // 40 ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), chosen AS (SELECT *, row_number() OVER (PARTITION BY archive ORDER BY doc_id) AS n FROM members WHERE members_before < 20 AND bytes_before < 60000 AND text <> '')
SELECT archive, (2 * n - 2)::INT AS seq, NULL::INT AS page, md5('[archivo: ' || doc_id || '.txt]') AS texto FROM chosen
UNION ALL SELECT archive, (2 * n - 1)::INT, NULL, md5(text) FROM chosen""",
    "q43_extract_rtf": f"SELECT * FROM (SELECT doc_id, 0::INT AS seq, NULL::INT AS page, {_TIDY} AS texto FROM documents) WHERE texto <> ''",
}
SQL["q44_extract_chat"] = f"""SELECT conv_id, 0::INT AS seq, NULL::INT AS page, {_trim("CASE WHEN is_chat THEN texto ELSE text END")} AS texto
FROM ({SQL["q08_chat_detect"]}) JOIN ({SQL["q09_chat_join"]}) USING (conv_id) JOIN ({_CHATS} SELECT conv_id, text FROM chats) USING (conv_id)"""
