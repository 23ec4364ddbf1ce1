"""SQL (DuckDB) that says the same as the queries of the catalogue, written independently of the operators."""

from __future__ import annotations

# Fixed values, written out again so that a slip in the operators shows: abbreviations, phrases of refusal, our prompts.
ABBREVIATIONS = "abs nr art lit bst bzw usw etc vgl ggf ca inkl exkl evtl bzgl betr gem sog insb zzgl dr prof dipl ing med phil rer nat jan feb mär apr jun jul aug sep sept okt nov dez std tel fax str max min orig".split()
REFUSALS = ("i'm sorry, i can't assist", "i cannot assist", "i'm not able to", "i am not able to", "i cannot help", "i'm unable to", "i am unable to", "cannot process this", "can't process this")
PAGE_SYSTEM = """You transcribe one page of a document into plain text and report its structure as JSON.

Document:
{document_context}

Write tables and lists as sentences, keep the page's own wording, invent nothing."""
PAGE_USER = "Page {page_number} of {total_pages}. Answer with one JSON object with the keys content, section_numbers, section_titles, paragraph_numbers, has_table, has_list, has_image, internal_references, external_references, continues_from_previous, continues_to_next."

_P, _M = chr(0xE000), chr(0xE001)
_WS = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_W = r"\p{L}\p{M}\p{Nd}_"
_L = "a-zäöüA-ZÄÖÜ"
_TOKEN = rf"[\p{{L}}\p{{N}}]{{1,4}}|[^{_WS[1:-1]}\p{{L}}\p{{N}}]"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _tokens(x: str) -> str:
    return f"coalesce(len(regexp_extract_all({x}, '{_TOKEN}')), 0)"


def _cut(x: str) -> str:
    """Array of the parts between sentence boundaries, points still protected, white space kept in front."""
    for _ in range(2):
        x = rf"regexp_replace({x}, '(^|[^{_W}])([{_L}])\.([{_L}])\.', '\1\2{_P}\3{_P}', 'g')"
    for _ in range(3):
        x = rf"regexp_replace({x}, '{_P}([{_L}])\.', '{_P}\1{_P}', 'g')"
    x = rf"regexp_replace({x}, '(§{_WS}*\p{{Nd}}+{_WS}+(?:Abs|Nr|Satz))\.({_WS}*\p{{Nd}})', '\1{_P}\2', 'gi')"
    for _ in range(2):
        x = rf"regexp_replace({x}, '(^|[^{_W}])({'|'.join(ABBREVIATIONS)})\.({_WS})', '\1\2{_P}\3', 'gi')"
    for _ in range(2):
        x = rf"regexp_replace({x}, '({_WS})(\p{{Nd}}{{1,3}})\.({_WS})', '\1\2{_P}\3', 'g')"
    x = rf"""regexp_replace({x}, '([.!?])({_WS}+)([A-ZÄÖÜ0-9„"(§])', '\1{_M}\2\3', 'g')"""
    return f"string_split({x}, '{_M}')"


_PAGES = "pages AS (SELECT * FROM extracted_pages QUALIFY row_number() OVER (PARTITION BY source_file, page_number ORDER BY ingested_at DESC, page_id DESC) = 1)"
_DOCS = "docs AS (SELECT * FROM extraction_results QUALIFY row_number() OVER (PARTITION BY source_file ORDER BY ingested_at DESC) = 1)"
_CHUNKS = "once AS (SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at DESC, token_count DESC NULLS LAST) = 1)"
_MERGED = f"""{_PAGES},
    bodies AS (SELECT source_file, page_number, {_strip("content")} AS body FROM pages),
    merged AS (SELECT *, CAST(coalesce(sum(length(body) + 2) OVER (PARTITION BY source_file ORDER BY page_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_pos FROM bodies WHERE length(body) > 0),
    placed AS (SELECT source_file, page_number, body, start_pos, start_pos + length(body) + 2 AS end_pos FROM merged)"""
_SENTENCES = f"""{_MERGED},
    texts AS (SELECT source_file, string_agg(body, chr(10) || chr(10) ORDER BY page_number) AS t FROM placed GROUP BY 1),
    cut AS (SELECT source_file, {_cut("t")} AS parts FROM texts),
    parts AS (SELECT source_file, unnest(parts) AS part, generate_subscripts(parts, 1) - 1 AS k FROM cut),
    laid AS (SELECT *, coalesce(sum(length(part)) OVER (PARTITION BY source_file ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(part) - length(regexp_replace(part, '^{_WS}+', '')) AS a FROM parts),
    clean AS (SELECT source_file, CAST(k AS BIGINT) AS sentence_no, {_strip(f"replace(part, '{_P}', '.')")} AS sentence, CAST(a AS BIGINT) AS start_pos FROM laid),
    spans AS (SELECT *, start_pos + length(sentence) AS end_pos, {_tokens("sentence")} AS tokens FROM clean),
    sentences AS (SELECT s.source_file, sentence_no, sentence, s.start_pos, s.end_pos, tokens, list(DISTINCT page_number ORDER BY page_number) AS page_numbers
        FROM spans s JOIN placed p ON p.source_file = s.source_file AND p.start_pos < s.end_pos AND p.end_pos > s.start_pos GROUP BY ALL)"""


def _packed(most: int = 120, overlap: int = 30) -> str:
    return f"""{_SENTENCES},
    sums AS (SELECT source_file, sentence_no AS i, greatest(tokens, 1) AS tok, coalesce(sum(greatest(tokens, 1)) OVER (PARTITION BY source_file ORDER BY sentence_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM sentences),
    ends AS (SELECT source_file, i, b FROM sums UNION ALL SELECT source_file, max(i) + 1, sum(tok) FROM sums GROUP BY 1),
    reach AS (SELECT source_file, i, CAST(b AS BIGINT) AS b, greatest(max(i) OVER (PARTITION BY source_file ORDER BY CAST(b AS BIGINT) RANGE BETWEEN CURRENT ROW AND {most} FOLLOWING) - 1, i) AS e,
        max(i) OVER (PARTITION BY source_file ORDER BY CAST(b AS BIGINT) RANGE BETWEEN UNBOUNDED PRECEDING AND {overlap} PRECEDING) AS back, max(i) OVER (PARTITION BY source_file) AS n FROM ends),
    step AS (SELECT r.source_file, r.i, r.e, r.n, CASE WHEN q.back IS NOT NULL THEN least(q.back, r.e) END AS o FROM reach r JOIN reach q ON q.source_file = r.source_file AND q.i = r.e + 1 WHERE r.i < r.n),
    nexts AS (SELECT source_file, i, e, n, greatest(CASE WHEN o IS NOT NULL AND o >= i THEN o ELSE e + 1 END, i + 1) AS next FROM step),
    chase AS (SELECT source_file, i, e, n, next FROM nexts WHERE i = 0
        UNION ALL SELECT x.source_file, x.i, x.e, x.n, x.next FROM chase c JOIN nexts x ON x.source_file = c.source_file AND x.i = c.next WHERE c.e < c.n - 1),
    packed AS (SELECT source_file, i AS first_no, e AS last_no, e = n - 1 AS is_last FROM chase)"""


_ROWS = f"""{_packed()},
    built AS (SELECT p.source_file, first_no, last_no, is_last, string_agg(sentence, ' ' ORDER BY sentence_no) AS text, list_sort(list_distinct(flatten(list(page_numbers)))) AS page_numbers
        FROM packed p JOIN sentences s ON s.source_file = p.source_file AND s.sentence_no BETWEEN first_no AND last_no GROUP BY ALL),
    counted AS (SELECT *, {_tokens("text")} AS token_count FROM built),
    kept AS (SELECT * FROM counted WHERE token_count >= 50 OR is_last)"""
_DOC_ID = r"regexp_replace(regexp_extract(replace({x}, '\', '/'), '[^/]*$'), '(.)\.[^.]+$', '\1')"


def _document_id(x: str) -> str:
    return _DOC_ID.replace("{x}", x)


_SEGMENTS = f"""{_ROWS}, {_DOCS},
    numbered AS (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY first_no) - 1 AS chunk_index, count(*) OVER (PARTITION BY source_file) AS total_chunks, {_document_id("source_file")} AS document_id FROM kept),
    segments AS (SELECT n.source_file, format('{{}}_chunk_{{:04d}}', document_id, chunk_index) AS chunk_id, text, token_count, document_id, context.title AS document_title, context.document_type AS document_type,
        CASE WHEN d.source_file IS NOT NULL THEN coalesce(context.institution, '') END AS institution, CASE WHEN d.source_file IS NOT NULL THEN coalesce(context.degree_program, '') END AS degree_program,
        array_to_string(page_numbers, ',') AS page_numbers, CAST(chunk_index AS INTEGER) AS chunk_index, CAST(total_chunks AS INTEGER) AS total_chunks,
        CASE WHEN chunk_index > 0 THEN format('{{}}_chunk_{{:04d}}', document_id, chunk_index - 1) END AS prev_chunk_id, CASE WHEN chunk_index < total_chunks - 1 THEN format('{{}}_chunk_{{:04d}}', document_id, chunk_index + 1) END AS next_chunk_id
        FROM numbered n LEFT JOIN docs d ON d.source_file = n.source_file)"""

_CORPUS = """corpus AS (SELECT e.vec_id, 'label_' || label AS document_id, label, row_number() OVER (PARTITION BY label ORDER BY e.vec_id) - 1 AS chunk_index, coalesce(text, '') AS text, embedding::DOUBLE[] AS v,
        count(*) OVER (PARTITION BY label) AS n FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id),
    named AS (SELECT *, format('{}_chunk_{:04d}', document_id, chunk_index) AS chunk_id, CASE WHEN chunk_index > 0 THEN format('{}_chunk_{:04d}', document_id, chunk_index - 1) END AS prev_chunk_id,
        CASE WHEN chunk_index < n - 1 THEN format('{}_chunk_{:04d}', document_id, chunk_index + 1) END AS next_chunk_id FROM corpus)"""
_HITS = f"""{_CORPUS},
    pairs AS (SELECT CAST(q.vec_id AS VARCHAR) AS query_id, c.chunk_id, 1 - list_cosine_similarity(q.v, c.v) AS d FROM named q, named c WHERE q.vec_id % 50 = 0),
    hits AS (SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY d, chunk_id) AS INTEGER) AS rank, round(d, 6) AS distance, round(1 - d, 6) AS similarity FROM pairs QUALIFY rank <= 5)"""
_EXPANDED = f"""{_HITS},
    found AS (SELECT h.query_id, h.distance, h.similarity, n.* FROM hits h JOIN named n USING (chunk_id)),
    near AS (SELECT query_id, prev_chunk_id AS chunk_id FROM found UNION SELECT query_id, next_chunk_id FROM found),
    extra AS (SELECT near.query_id, 0.0 AS distance, 1.0 AS similarity, n.* FROM near JOIN named n USING (chunk_id) WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.query_id = near.query_id AND f.chunk_id = near.chunk_id)),
    both_rows AS (SELECT query_id, chunk_id, document_id, chunk_index, text, distance, similarity, true AS is_hit FROM found UNION ALL SELECT query_id, chunk_id, document_id, chunk_index, text, distance, similarity, false FROM extra)"""
_BUDGET = f"""{_EXPANDED},
    counted AS (SELECT *, {_tokens("text")} AS tokens, row_number() OVER w - 1 AS position, coalesce(lag(document_id) OVER w <> document_id OR chunk_index > lag(chunk_index) OVER w + 1, false) AS separated
        FROM both_rows WINDOW w AS (PARTITION BY query_id ORDER BY document_id, chunk_index, chunk_id)),
    spent AS (SELECT *, coalesce(sum(tokens + CASE WHEN separated THEN 3 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM counted),
    tried AS (SELECT *, before + tokens + CASE WHEN position > 0 THEN 3 ELSE 0 END > 300 AS fails FROM spent),
    budgeted AS (SELECT query_id, chunk_id, position, tokens, separated, text, position = 0 OR NOT bool_or(fails) OVER (PARTITION BY query_id ORDER BY position ROWS UNBOUNDED PRECEDING) AS included FROM tried)"""
_CONTEXT = f"""{_BUDGET},
    joined AS (SELECT query_id, string_agg(CASE WHEN separated THEN '---' || chr(10) || chr(10) ELSE '' END || text, chr(10) || chr(10) ORDER BY position) AS context_text, string_agg(chunk_id, ',' ORDER BY position) AS chunk_ids, count(*) AS total_results
        FROM budgeted WHERE included GROUP BY 1)"""
_PROBE = "(SELECT embedding::DOUBLE[] FROM embeddings ORDER BY vec_id LIMIT 1)"


def _knn(d: str, where: str = "true") -> str:
    return f"WITH {_CORPUS}, scored AS (SELECT chunk_id, {d} AS d FROM named WHERE {where}) SELECT chunk_id, round(d, 6) + 0.0 AS distance, round(1 - d, 6) + 0.0 AS similarity FROM scored ORDER BY d, chunk_id LIMIT 10"


_REFUSED = lambda x: "(" + " OR ".join("contains(lower({}), '{}')".format(x, p.lower().replace("'", "''")) for p in REFUSALS) + ")"
_FOUND = r"""replies AS (SELECT response_id, page_number, response_text AS r FROM raw_responses),
    chars AS (SELECT response_id, i, substr(r, i, 1) AS c FROM (SELECT response_id, r, unnest(generate_series(instr(r, '{'), length(r))) AS i FROM replies WHERE instr(r, '{') > 0)),
    depth AS (SELECT response_id, i, sum(CASE c WHEN '{' THEN 1 WHEN '}' THEN -1 ELSE 0 END) OVER (PARTITION BY response_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS depth, c FROM chars),
    closing AS (SELECT response_id, min(i) AS e FROM depth WHERE depth = 0 AND c = '}' GROUP BY 1),
    found AS (SELECT response_id, page_number, r, CASE
        WHEN regexp_matches(r, '(?s)```json.+?```') THEN trim(regexp_extract(r, '(?s)```json(.*?)```', 1), chr(32) || chr(9) || chr(10) || chr(13))
        WHEN regexp_matches(r, '(?s)```.+?```') THEN trim(regexp_extract(r, '(?s)```(.*?)```', 1), chr(32) || chr(9) || chr(10) || chr(13))
        WHEN e IS NOT NULL THEN substr(r, instr(r, '{'), e - instr(r, '{') + 1) ELSE r END AS found FROM replies LEFT JOIN closing USING (response_id))"""

_FLAT = """flat AS (SELECT chunk_id, text, metadata.document_id AS document_id, metadata.document_title AS document_title, metadata.document_type AS document_type, metadata.institution AS institution, metadata.degree_program AS degree_program,
        metadata.chunk_index AS chunk_index, metadata.total_chunks AS total_chunks, token_count, coalesce(array_to_string(metadata.page_numbers, ','), '') AS page_numbers, metadata.prev_chunk_id AS prev_chunk_id, metadata.next_chunk_id AS next_chunk_id FROM once)"""


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_TYPES = "'pruefungsordnung', 'modulhandbuch', 'studienordnung', 'allgemeine_bestimmungen', 'praktikumsordnung', 'zulassungsordnung', 'satzung', 'website', 'faq', 'other'"
_LISTED = lambda f: f"array_to_string(CASE WHEN ok THEN coalesce(CAST(j ->> '$.{f}[*]' AS VARCHAR[]), []) ELSE [] END, '|') AS {f}"
_CONTEXT_STRING = """concat_ws(chr(10), 'Dokumenttyp: ' || coalesce(context.document_type, 'Unbekannt'), 'Titel: ' || coalesce(context.title, 'Unbekannt'), 'Institution: ' || coalesce(context.institution, 'Unbekannt'),
    CASE WHEN context.faculty <> '' THEN 'Fachbereich: ' || context.faculty END, CASE WHEN context.degree_program <> '' THEN 'Studiengang: ' || context.degree_program END,
    CASE WHEN len(context.abbreviations) > 0 THEN 'Abkürzungen: ' || array_to_string(list_transform(context.abbreviations, lambda a: coalesce(a.short, '') || '=' || coalesce(a.long, '')), ', ') END,
    CASE WHEN len(context.chapters) > 0 THEN 'Gliederung: ' || array_to_string(context.chapters[1:8], ', ') END)"""

_DIMENSIONS = f"CASE WHEN {_strip('coalesce(text, chr(32))')} = '' THEN 0 ELSE 64 END"

SQL: dict[str, str] = {
    "page_merge": f"WITH {_MERGED} SELECT source_file, page_number, start_pos, end_pos FROM placed",
    "page_stats": f"""WITH {_PAGES}, {_DOCS}, stats AS (SELECT source_file, count(*) AS total_pages, count(*) FILTER (has_table) AS pages_with_tables, count(*) FILTER (has_list) AS pages_with_lists, avg(length(coalesce(content, ''))) AS avg_content_length,
        min(length(coalesce(content, ''))) AS min_content_length, max(length(coalesce(content, ''))) AS max_content_length, count(*) FILTER (coalesce(extraction_confidence, 1) < 1) AS failed_pages FROM pages GROUP BY 1)
        SELECT source_file, coalesce(total_pages, 0) AS total_pages, coalesce(pages_with_tables, 0) AS pages_with_tables, coalesce(pages_with_lists, 0) AS pages_with_lists, coalesce(avg_content_length, 0) AS avg_content_length, min_content_length, max_content_length,
        coalesce(failed_pages, 0) AS failed_pages FROM docs LEFT JOIN stats USING (source_file)""",
    "full_content": f"WITH {_PAGES} SELECT source_file, CAST(page_number // 256 AS INTEGER) AS part, string_agg(coalesce(content, ''), chr(10) || chr(10) ORDER BY page_number) AS content FROM pages GROUP BY 1, 2",
    "all_sections": f"WITH {_PAGES}, s AS (SELECT source_file, page_number, unnest(sections) AS s, CAST(generate_subscripts(sections, 1) - 1 AS INTEGER) AS position FROM pages) SELECT source_file, page_number, position, s.number AS number, s.title AS title, s.level AS level, s.starts_on_page AS starts_on_page FROM s",
    "document_id": f"SELECT DISTINCT source_file, {_document_id('source_file')} AS document_id FROM extraction_results",
    "abbreviation_map": f"WITH {_DOCS}, a AS (SELECT source_file, unnest(context.abbreviations) AS a, generate_subscripts(context.abbreviations, 1) AS k FROM docs) SELECT source_file, a.short AS short, arg_max(a.long, k) AS long FROM a WHERE a.short IS NOT NULL GROUP BY 1, 2",
    "failed_pages": f"""WITH {_PAGES}, bad AS (SELECT source_file, list(page_number ORDER BY page_number) AS p FROM pages WHERE coalesce(extraction_confidence, 1) < 1 OR {_REFUSED("content")} GROUP BY 1)
        SELECT source_file, array_to_string(p, ',') AS failed, array_to_string(list_transform(p, lambda n: 'Page ' || n || ': extraction incomplete'), '; ') AS errors FROM bad""",
    "refusal_filter": f"""SELECT DISTINCT 'reply' AS kind, response_id AS id FROM raw_responses WHERE {_REFUSED('response_text')} UNION SELECT DISTINCT 'page', page_id FROM extracted_pages WHERE {_REFUSED('content')}
        UNION SELECT DISTINCT 'made', response_id FROM raw_responses""",
    "page_validation": f"""WITH pages AS (SELECT 'page' AS kind, page_number AS p, extraction_confidence AS c FROM extracted_pages UNION ALL SELECT 'moved_page', page_number - 1, extraction_confidence + 0.25 FROM extracted_pages),
        docs AS (SELECT 'document' AS kind, context.document_type AS t, context.title AS title, context.total_pages AS n, context.language AS l FROM extraction_results
            UNION ALL SELECT 'changed_document', context.document_type, context.title, context.total_pages - 20, upper(context.language) FROM extraction_results)
        SELECT kind, count(*) AS n FROM pages WHERE p < 1 OR c NOT BETWEEN 0 AND 1 GROUP BY 1
        UNION ALL SELECT kind, count(*) FROM docs WHERE NOT (coalesce(t IN ({_TYPES}), false) AND coalesce(title, '') <> '' AND coalesce(n >= 0, true) AND coalesce(l IN ('de', 'en'), true)) GROUP BY 1""",
    "sample_pages": f"""WITH {_DOCS} SELECT source_file, CASE WHEN n IS NULL OR n < 2 THEN '1' WHEN n = 2 THEN '1,2' WHEN n = 3 THEN '1,2,3' WHEN n <= 10 THEN '1,2,3,' || n ELSE '1,2,3,' || (n // 2) || ',' || n END AS pages FROM (SELECT source_file, context.total_pages AS n FROM docs)""",
    "context_string": f"WITH {_DOCS} SELECT source_file, {_CONTEXT_STRING} AS context_string FROM docs",
    "page_prompt": f"""WITH {_PAGES}, {_DOCS} SELECT p.source_file, p.page_number, md5(replace({_quote(PAGE_SYSTEM)}, '{{document_context}}', {_CONTEXT_STRING})) AS system_md5,
        replace(replace({_quote(PAGE_USER)}, '{{page_number}}', CAST(p.page_number AS VARCHAR)), '{{total_pages}}', CAST(context.total_pages AS VARCHAR)) AS user_prompt FROM pages p JOIN docs d ON d.source_file = p.source_file""",
    "token_usage": "SELECT source_file, CAST(sum(coalesce(input_tokens, 0)) AS BIGINT) AS input_tokens, CAST(sum(coalesce(output_tokens, 0)) AS BIGINT) AS output_tokens FROM raw_responses GROUP BY 1",
    "json_extract": f"WITH {_FOUND} SELECT response_id, found FROM found",
    "page_parse": f"""WITH {_FOUND}, j AS (SELECT *, coalesce(json_valid(found), false) AND json_type(CASE WHEN json_valid(found) THEN found ELSE 'null' END) = 'OBJECT' AS ok, CASE WHEN json_valid(found) THEN CAST(found AS JSON) END AS j FROM found),
        f AS (SELECT *, CASE WHEN ok THEN coalesce(CAST(j ->> '$.section_numbers[*]' AS VARCHAR[]), []) ELSE [] END AS nums, CASE WHEN ok THEN coalesce(CAST(j ->> '$.section_titles[*]' AS VARCHAR[]), []) ELSE [] END AS tits,
            ok AND coalesce(CAST(j ->> '$.has_table' AS BOOLEAN), false) AS has_table, ok AND coalesce(CAST(j ->> '$.has_list' AS BOOLEAN), false) AS has_list, ok AND coalesce(CAST(j ->> '$.has_image' AS BOOLEAN), false) AS has_figure, ok AND coalesce(CAST(j ->> '$.continues_to_next' AS BOOLEAN), false) AS continues_to_next FROM j)
        SELECT response_id, page_number, CASE WHEN ok THEN coalesce(j ->> '$.content', '') ELSE coalesce(r, '') END AS content, len(nums) AS n_sections, array_to_string(nums, '|') AS numbers,
        coalesce(array_to_string(list_transform(nums, lambda x, i: coalesce(tits[i], '-')), '|'), '') AS titles, CASE WHEN NOT ok THEN '' WHEN has_table AND has_list THEN 'table,list' WHEN has_table THEN 'table' WHEN has_list THEN 'list' ELSE 'section' END AS content_types,
        has_table, has_list, has_figure, continues_to_next, ok AND coalesce(CAST(j ->> '$.continues_from_previous' AS BOOLEAN), false) AS continues_from_previous, CASE WHEN ok THEN 1.0 ELSE 0.5 END::DOUBLE AS extraction_confidence,
        {_LISTED("paragraph_numbers")}, {_LISTED("internal_references")}, {_LISTED("external_references")}, NOT ok AS noted FROM f""",
    "context_parse": f"""WITH {_DOCS} SELECT source_file, CASE WHEN context.document_type IN ('pruefungsordnung', 'modulhandbuch', 'studienordnung', 'allgemeine_bestimmungen', 'praktikumsordnung', 'zulassungsordnung', 'satzung', 'website', 'faq') THEN context.document_type ELSE 'other' END AS document_type,
        coalesce(context.title, 'Unknown') AS title, coalesce(context.institution, 'Unknown') AS institution, context.faculty AS faculty, context.version_date AS version_date, context.degree_program AS degree_program, context.total_pages AS total_pages,
        context.version_info AS version_info, context.legal_basis AS legal_basis, 'de' AS language, coalesce(array_to_string(context.main_topics, '|'), '') AS main_topics, coalesce(array_to_string(context.key_terms, '|'), '') AS key_terms,
        coalesce(array_to_string(context.referenced_documents, '|'), '') AS referenced_documents, coalesce(array_to_string(context.chapters, '|'), '') AS chapters, coalesce(array_to_string(list_transform(list_filter(context.abbreviations, lambda a: a.short <> '' AND a.long <> ''), lambda a: a.short || '=' || a.long), '|'), '') AS abbreviations FROM docs""",
    "json_roundtrip": f"""WITH {_PAGES}, {_DOCS}, p AS (SELECT source_file, count(*) AS n, sum(length(coalesce(content, ''))) AS c FROM pages GROUP BY 1)
        SELECT source_file, context.title AS title, processed_at, CAST(coalesce(n, 0) AS INTEGER) AS n_pages, CAST(coalesce(c, 0) AS INTEGER) AS n_chars FROM docs LEFT JOIN p USING (source_file)""",
    "sentence_split": f"""WITH cut AS (SELECT doc_id, {_cut(_strip("text"))} AS parts FROM documents WHERE text IS NOT NULL), parts AS (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS k FROM cut),
        clean AS (SELECT doc_id, k, {_strip(f"replace(part, '{_P}', '.')")} AS sentence FROM parts) SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INTEGER) AS position, sentence FROM clean WHERE sentence <> ''""",
    "sentence_count": f"""SELECT doc_id, CAST(coalesce(len(list_filter({_cut(_strip("text"))}, lambda p: {_strip("p")} <> '')), 0) AS INTEGER) AS n_sentences FROM documents""",
    "token_count": f"""WITH p AS (SELECT doc_id, text, unnest(coalesce({_cut(_strip("text"))}, [''])) AS part FROM documents)
        SELECT doc_id, {_tokens("any_value(text)")} AS tokens, CAST(sum({_tokens(f"replace(part, '{_P}', '.')")}) AS INTEGER) AS sentence_tokens FROM p GROUP BY doc_id""",
    "sentence_pages": f"WITH {_SENTENCES} SELECT source_file, sentence_no, sentence, start_pos, end_pos, array_to_string(page_numbers, ',') AS page_numbers, tokens FROM sentences",
    "sentence_pages_join": f"WITH {_SENTENCES} SELECT source_file, sentence_no, start_pos, end_pos, array_to_string(page_numbers, ',') AS page_numbers FROM sentences",
    "chunk_pack": f"WITH RECURSIVE {_packed()} SELECT source_file, first_no, last_no, is_last FROM packed",
    "micro_chunk_filter": f"WITH RECURSIVE {_ROWS} SELECT source_file, first_no, last_no, token_count FROM kept",
    "chunk_metadata": f"WITH RECURSIVE {_SEGMENTS} SELECT * FROM segments",
    "chunk_stats": f"""WITH RECURSIVE {_SEGMENTS}, c AS (SELECT source_file, count(*) AS total_chunks, CAST(sum(token_count) AS BIGINT) AS total_tokens, avg(token_count) AS avg_chunk_tokens, min(token_count) AS min_chunk_tokens, max(token_count) AS max_chunk_tokens FROM segments GROUP BY 1),
        s AS (SELECT source_file, count(*) AS total_sentences FROM sentences GROUP BY 1), p AS (SELECT source_file, count(*) AS total_pages_processed FROM pages GROUP BY 1)
        SELECT source_file, coalesce(total_chunks, 0) AS total_chunks, coalesce(total_tokens, 0) AS total_tokens, coalesce(avg_chunk_tokens, 0) AS avg_chunk_tokens, coalesce(min_chunk_tokens, 0) AS min_chunk_tokens, coalesce(max_chunk_tokens, 0) AS max_chunk_tokens,
        CASE WHEN total_chunks IS NULL THEN 0 ELSE coalesce(total_sentences, 0) END AS total_sentences, CASE WHEN total_chunks IS NULL THEN 0 ELSE coalesce(total_pages_processed, 0) END AS total_pages_processed
        FROM docs LEFT JOIN c USING (source_file) LEFT JOIN s USING (source_file) LEFT JOIN p USING (source_file)""",
    "knn_cosine": _knn(f"1 - list_cosine_similarity(v, {_PROBE})"),
    "knn_l2": _knn(f"list_sum(list_transform(list_zip(v, {_PROBE}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"),
    "knn_ip": _knn(f"1 - list_inner_product(v, {_PROBE})"),
    "knn_filtered": _knn(f"1 - list_cosine_similarity(v, {_PROBE})", "label IN (1, 2, 3) AND vec_id >= 100"),
    "knn_batched": f"WITH {_HITS} SELECT query_id, chunk_id, rank, distance, similarity FROM hits",
    "knn_index_all": f"WITH {_HITS} SELECT query_id, chunk_id, rank, distance, similarity FROM hits",
    "knn_index_recall": f"WITH {_HITS} SELECT count(*) AS n_hits, true AS reached FROM hits",
    "neighbor_expand": f"WITH {_EXPANDED} SELECT query_id, chunk_id, distance, similarity FROM both_rows WHERE NOT is_hit",
    "hit_neighbor_union": f"WITH {_EXPANDED} SELECT query_id, chunk_id, document_id, chunk_index, is_hit, distance FROM both_rows",
    "context_budget": f"WITH {_BUDGET} SELECT query_id, chunk_id, position, tokens, separated, included FROM budgeted",
    "context_text": f"WITH {_CONTEXT} SELECT query_id, context_text, chunk_ids, {_tokens('context_text')} AS token_count, total_results FROM joined",
    "retrieve_context": f"WITH {_CONTEXT} SELECT query_id, context_text, {_tokens('context_text')} AS token_count, total_results FROM joined",
    "metadata_flatten": f"WITH {_CHUNKS}, {_FLAT} SELECT * FROM flat",
    "collection_count": "SELECT count(DISTINCT chunk_id) AS n FROM chunks",
    "document_ids": "SELECT DISTINCT metadata.document_id AS document_id FROM chunks",
    "chunk_lookup": f"WITH {_CHUNKS} SELECT chunk_id, text, 0.0::DOUBLE AS distance, 1.0::DOUBLE AS similarity FROM once WHERE chunk_id = 'mhb_gesamtkatalog_chunk_0000'",
    "chunk_multi_lookup": f"WITH {_CHUNKS} SELECT chunk_id, 0.0::DOUBLE AS distance, 1.0::DOUBLE AS similarity FROM once WHERE chunk_id IN ({', '.join(f'''{chr(39)}mhb_gesamtkatalog_chunk_{i:04d}{chr(39)}''' for i in (0, 1, 2, 3, 5, 8, 999999))})",
    "chunk_neighbors": f"""WITH {_CHUNKS}, {_FLAT}, one AS (SELECT 'prev' AS side, prev_chunk_id AS chunk_id FROM flat WHERE chunk_id = 'mhb_gesamtkatalog_chunk_0001' UNION ALL SELECT 'next', next_chunk_id FROM flat WHERE chunk_id = 'mhb_gesamtkatalog_chunk_0001')
        SELECT side, chunk_id, text FROM one JOIN flat USING (chunk_id)""",
    "where_filter": f"WITH {_CHUNKS}, {_FLAT} SELECT chunk_id FROM flat WHERE (document_type = 'pruefungsordnung' AND chunk_index <= 2) OR (coalesce(document_type NOT IN ('faq', 'website'), true) AND total_chunks > 10 AND chunk_index IS DISTINCT FROM 0)",
    "upsert": f"""WITH f AS (SELECT chunk_id, min(ingested_at) AS t FROM chunks GROUP BY 1), ranked AS (SELECT c.*, row_number() OVER (PARTITION BY c.chunk_id ORDER BY ingested_at > t DESC, c.token_count DESC NULLS LAST) AS k FROM chunks c JOIN f ON f.chunk_id = c.chunk_id),
        once AS (SELECT * FROM ranked WHERE k = 1), {_FLAT} SELECT *, {_DIMENSIONS} AS dimensions FROM flat""",
    "delete_document": f"WITH {_CHUNKS}, {_FLAT} SELECT *, {_DIMENSIONS} AS dimensions FROM flat WHERE document_id IS DISTINCT FROM 'mhb_gesamtkatalog'",
    "embed_batch": rf"SELECT doc_id, {_DIMENSIONS} AS dimensions, CASE WHEN regexp_matches(coalesce(text, ''), '[\p{{L}}\p{{N}}_]') THEN 1.0 ELSE 0.0 END::DOUBLE AS norm FROM documents",
    "extract_document": f"""WITH {_PAGES}, texts AS (SELECT source_file, page_number, replace(coalesce(content, ''), chr(12), ' ') AS content, row_number() OVER w AS n, sum(length(coalesce(content, ''))) OVER (PARTITION BY source_file) + count(*) OVER (PARTITION BY source_file) - 1 AS size
            FROM pages WINDOW w AS (PARTITION BY source_file ORDER BY page_number))
        SELECT source_file, CAST(n AS INTEGER) AS page_number, content, 1.0::DOUBLE AS extraction_confidence, 'section' AS content_types FROM texts WHERE size > 0""",
    "chunk_results": f"""WITH RECURSIVE {_SEGMENTS}, c AS (SELECT source_file, count(*) AS k, sum(token_count) AS t, sum(length(text)) AS ch, sum(len(string_split(page_numbers, ','))) AS p FROM segments GROUP BY 1)
        SELECT source_file, {_document_id("source_file")} AS document_id, 120 AS max_chunk_tokens, coalesce(k, 0) AS total_chunks, CAST(coalesce(k, 0) AS INTEGER) AS n_chunks, CAST(coalesce(t, 0) AS INTEGER) AS n_tokens, CAST(coalesce(ch, 0) AS INTEGER) AS n_chars, CAST(coalesce(p, 0) AS INTEGER) AS n_pages
        FROM docs LEFT JOIN c USING (source_file)""",
}
