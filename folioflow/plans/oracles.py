"""SQL counterparts of the registered queries, written independently of the Spark code."""

from __future__ import annotations

from folioflow import constants as K

ORACLES: dict[str, str] = {}
WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
NL = "chr(10)"


def oracle(**sql: str) -> None:
    ORACLES.update(sql)


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def collapse(x: str) -> str:
    return strip(rf"regexp_replace({x}, '\s+', ' ', 'g')")


def sub(x: str, pattern: str, to: str = "''") -> str:
    pattern = pattern.replace("'", "''")
    return f"regexp_replace({x}, '{pattern}', {to}, 'g')"


def h16(x: str) -> str:
    return f"substr(sha256({x}), 1, 16)"


def tidy(x: str) -> str:
    return f"({strip(sub(x, chr(92) + 'n{4,}', f'repeat({NL}, 3)'))} || {NL})"


def scaffold(x: str) -> str:
    x = sub(x, r"(?i)<!--\s*Page\s+\d+\s*-->\s*\n?(?:##\s+Page\s+\d+\s*\n?)?")
    x = sub(x, r"(?m)^##\s+Page\s+\d+\s*$")
    x = sub(x, r"(\n---\s*\n)(?:\s*---\s*\n)+", f"{NL} || '---' || {NL}")
    return tidy(x)


def prose(x: str) -> str:
    for pattern, to in [
        (r"(?s)<!--.*?-->", "''"), (r"(?m)^[ \t]*```[^\n]*\n?", "''"), (r"!\[([^\]]*)\]\([^)]*\)", r"'\1'"),
        (r"\[([^\]]*)\]\([^)]*\)", r"'\1'"), (r"(?m)^[ \t]*#{1,6}[ \t]+", "''"), (r"(?m)^[ \t]*>[ \t]?", "''"),
        (r"(?m)^[ \t]*[-*+][ \t]+", "''"), (r"(?m)^[ \t]*\d+[.)][ \t]+", "''"),
        (r"(?m)^[ \t]*(?:-{3,}|\*{3,}|_{3,})[ \t]*$", "''"),
    ]:
        x = sub(x, pattern, to)
    separator = r"^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(\|[ \t]*:?-{2,}:?[ \t]*)*\|?[ \t]*$"
    cells = f"string_split({sub(strip('ln'), chr(94) + chr(92) + '||' + chr(92) + '|$')}, '|')"
    row = f"array_to_string([{strip('c')} FOR c IN {cells} IF {strip('c')} <> ''], ' · ')"
    line = rf"CASE WHEN regexp_matches(ln, '^[ \t]*\|.*\|[ \t]*$') THEN {row} ELSE ln END"
    x = f"array_to_string([{line} FOR ln IN string_split({x}, {NL}) IF NOT regexp_matches(ln, '{separator}')], {NL})"
    for pattern, to in [
        (r"\*\*([^*]+)\*\*", r"'\1'"), (r"__([^_]+)__", r"'\1'"), (r"\*([^*\n]+)\*", r"'\1'"),
        (r"(^|[\s(])_([^_\n]+)_([\s).,;:!?]|$)", r"'\1\2\3'"), (r"`([^`\n]+)`", r"'\1'"),
        (r"(?m)[ \t]+$", "''"), (r"\n{3,}", f"repeat({NL}, 2)"),
    ]:
        x = sub(x, pattern, to)
    return strip(x)


# --- shared inputs ----------------------------------------------------------------------------------------
LIBRARY_DOCS = """docs AS (
  SELECT doc_id AS doc, doc_id AS pos, source AS folder, text,
    source || ' Annual Report ' || (1990 + n_chars % 35) || ' (' || lang || ') No ' || doc_id AS title,
    1990 + n_chars % 35 AS in_title FROM documents)"""
CONV = """conv AS (SELECT conv_id AS doc, turn + 1 AS page_num, role, text FROM conversations),
 convdocs AS (SELECT doc, max(page_num) AS total_pages FROM conv GROUP BY doc)"""
PART_TEXT = f"""parts AS (
  SELECT doc, 0::BIGINT AS part, '# Conversation ' || doc || {NL} || {NL} || '> Source Document: `Conversation ' || doc || '.pdf`  ' || {NL}
    || '> Total Pages: ' || total_pages || '  ' || {NL} || '> Converted with Gemini Model: `transcriber`  ' || {NL} || {NL} || '---' || {NL} AS text
  FROM convdocs
  UNION ALL
  SELECT d.doc, n, {NL} || '<!-- Page ' || n || ' -->' || {NL} || '## Page ' || n || repeat({NL}, 2)
    || coalesce(nullif({strip('c.text')}, ''), '> **[Page ' || n || ' conversion pending/failed]**') || repeat({NL}, 2) || '---' || {NL}
  FROM (SELECT doc, unnest(range(1, total_pages + 1)) AS n FROM convdocs) d LEFT JOIN conv c ON c.doc = d.doc AND c.page_num = d.n)"""
ASSEMBLED = f"{CONV}, {PART_TEXT}, texts AS (SELECT doc, string_agg(text, {NL} ORDER BY part) AS text FROM parts GROUP BY doc)"
PAGES = """lines AS (SELECT l_orderkey AS doc, l_linenumber::BIGINT AS page_num, l_linestatus AS status, l_returnflag AS flag FROM lineitem),
 cache AS (SELECT doc, page_num, CASE WHEN status = 'F' THEN flag END AS model FROM lines WHERE status = 'F' OR flag = 'N'),
 odocs AS (SELECT o_orderkey AS doc, n_name AS folder, o_orderstatus AS status, o_orderpriority AS priority, coalesce(m, 0)::BIGINT AS total_pages
   FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
   LEFT JOIN (SELECT doc, max(page_num) AS m FROM lines GROUP BY doc) ON doc = o_orderkey),
 planned AS (SELECT doc, folder, unnest(range(1, total_pages + 1)) AS page_num FROM odocs WHERE total_pages > 0)"""
GROUPS = """held AS (SELECT l_orderkey AS doc, l_linenumber AS p, max((l_linestatus = 'F')::INT) AS f FROM lineitem GROUP BY ALL),
 sums AS (SELECT doc, count(*) AS pages, sum(f)::BIGINT AS converted FROM held GROUP BY doc),
 grps AS (SELECT o_orderpriority AS plan_id, o_orderkey AS group_no, 'group ' || o_orderkey AS grp, pages, converted, pages - converted AS missing,
   CASE o_orderstatus WHEN 'F' THEN 'collected' WHEN 'O' THEN 'submitted' ELSE 'pending' END AS state,
   o_custkey % 6 AS retry_pass, 'job ' || o_custkey AS job_id FROM orders JOIN sums ON doc = o_orderkey)"""

# --- search -------------------------------------------------------------------------------------------------
HITS = "(length(lower(text)) - length(replace(lower(text), 'tion', ''))) // 4"
oracle(
    search_count=f"WITH {LIBRARY_DOCS} SELECT doc, folder, title || '.pdf' AS name, {HITS} AS match_count FROM docs WHERE {HITS} > 0",
    search_ranked=f"""WITH {LIBRARY_DOCS}, c AS (SELECT doc, folder, title || '.pdf' AS name, {HITS} AS match_count FROM docs)
      SELECT *, least(match_count, 5) AS shown FROM c WHERE match_count > 0
      ORDER BY match_count DESC, lower(folder), lower(name), doc LIMIT 100""",
    search_after=f"""WITH {LIBRARY_DOCS}, c AS (SELECT doc, folder, title || '.pdf' AS name, {HITS} AS match_count FROM docs)
      SELECT *, least(match_count, 5) AS shown FROM c WHERE match_count > 0
      ORDER BY match_count DESC, lower(folder), lower(name), doc LIMIT 100 OFFSET 100""",
    search_indexed="""SELECT query, doc_id AS doc, (length(text) - length(replace(lower(text), lower(query), ''))) // length(query) AS match_count
      FROM documents, (VALUES ('nding'), ('Thand'), ('tion'), ('doubl'), ('sth En'), ('no such words')) q(query) WHERE contains(lower(text), lower(query))""",
    search_totals="""WITH c AS (SELECT (length(text) - length(replace(text, 'Tion', ''))) // 4 AS n FROM documents)
      SELECT sum(n)::BIGINT AS total_matches, count(*) FILTER (n > 0) AS documents_matched, count(*) AS documents_searched,
        count(*) FILTER (n > 0) > 100 AS truncated, count(*) FILTER (n > 0) > 100 AS has_more FROM c""",
    search_whole_word=rf"""WITH c AS (SELECT doc_id AS doc, ' ' || regexp_replace(lower(text), '[^\p{{L}}\p{{N}}_]', '  ', 'g') || ' ' AS t FROM documents)
      SELECT doc, (length(t) - length(replace(t, ' the ', ''))) // 5 AS match_count FROM c WHERE contains(t, ' the ')""",
)
STARTS = """hits AS (SELECT doc, text, unnest(range(1, least(len(cut) - 1, 5) + 1)) AS i, cut FROM (
    SELECT doc, text, string_split(lower(text), '{q}') AS cut FROM {src})),
  found AS (SELECT doc, text, i - 1 AS ordinal, (list_sum([length(x) FOR x IN cut[1:i]]) + (i - 1) * {w})::BIGINT AS start FROM hits)"""
oracle(
    search_first_k=f"""WITH src AS (SELECT doc_id AS doc, text FROM documents), {STARTS.format(q='tion', w=4, src='src')},
      a AS (SELECT *, greatest(start - 70, 0) AS lo, least(start + 74, length(text)) AS hi FROM found),
      b AS (SELECT *, substr(text, lo + 1, start - lo) AS before, substr(text, start + 5, hi - start - 4) AS after FROM a),
      c AS (SELECT *, lo + CASE WHEN lo > 0 THEN instr(before, ' ') ELSE 0 END AS l, CASE WHEN hi < length(text) AND instr(reverse(after), ' ') > 0
        THEN start + 4 + length(after) - instr(reverse(after), ' ') ELSE hi END AS r FROM b),
      d AS (SELECT *, substr(text, l + 1, r - l) AS raw FROM c),
      e AS (SELECT *, length(raw) - length(ltrim(raw, {WS})) AS cut FROM d)
      SELECT doc, ordinal, start, {strip(f"replace(raw, {NL}, ' ')")} AS text, start - l - cut AS match_start, start + 4 - l - cut AS match_end,
        l > 0 AS prefix_truncated, r < length(e.text) AS suffix_truncated, NULL::BIGINT AS page FROM e""",
    search_page_attribution=f"""WITH {ASSEMBLED}, {STARTS.format(q='en', w=2, src='texts')}
      SELECT doc, ordinal, start, nullif((start - length(replace(substr(text, 1, start), '<!-- Page ', ''))) // 10, 0) AS page FROM found""",
    search_in_pages=f"""WITH {CONV}, p AS (SELECT doc, page_num, {prose('text')} AS t FROM conv)
      SELECT doc, page_num, unnest(range(0, (length(lower(t)) - length(replace(lower(t), 'en', ''))) // 2)) AS ordinal FROM p""",
    rank_quick_open=f"""WITH {LIBRARY_DOCS}, n AS (SELECT doc, folder, title || '.pdf' AS name, lower(folder) AS f, lower(title || '.pdf') AS m FROM docs),
      t AS (SELECT doc, folder, name, f, m, unnest(['src1', 'report', '2001']) AS term FROM n),
      s AS (SELECT doc, folder, name, bool_and(contains(f || ' ' || m, term)) AS ok, sum(CASE WHEN starts_with(f, term) THEN 3
        WHEN contains(f, term) OR starts_with(m, term) THEN 2 ELSE 1 END)::BIGINT AS score FROM t GROUP BY ALL)
      SELECT doc, folder, name, score FROM s WHERE ok ORDER BY score DESC, name, doc LIMIT 40""",
)

# --- text rules ---------------------------------------------------------------------------------------------
oracle(
    text_metrics=rf"""SELECT doc_id AS doc, len(regexp_extract_all(text, '\S+')) AS words, length(text) AS chars, strlen(text) AS bytes,
      strlen(text) // 4 AS est_tokens, len(regexp_extract_all(text, '\s+|\S+')) AS tokens, {h16('text')} AS text_hash,
      {h16(collapse('text'))} AS exact_hash FROM documents""",
    name_rules=rf"""WITH {LIBRARY_DOCS} SELECT doc, replace(regexp_replace(lower(title), '[^a-z0-9 -]', '', 'g'), ' ', '-') AS slug,
      in_title AS year, substr(title, length(folder) + 2) AS short_name, upper(folder) AS peer_group FROM docs""",
    path_rules=f"""WITH {LIBRARY_DOCS} SELECT doc, folder AS entity, title AS stem, '/ws/' || folder || '/' || title || '.pdf' AS pdf_path,
      '/ws/' || folder || '/Markdown/' || title || '.md' AS markdown_path, '/ws/' || folder || '/Lightweight/' || title || '.md' AS light_path,
      false AS is_consolidated, false AS is_lightweight FROM docs""",
    markdown_to_prose=f"SELECT doc, {h16('p')} AS prose_hash, length(p) AS chars FROM (SELECT doc_id AS doc, {prose('text')} AS p FROM documents)",
    unwrap_fences=f"""SELECT doc_id AS doc, {h16(f"CASE WHEN length(text) % 2 = 0 THEN {strip('text')} ELSE '```sql' || {NL} || text || {NL} || '```' END")} AS text_hash
      FROM documents""",
    strip_provenance=f"""SELECT doc_id AS doc, {h16('text')} AS text_hash, source AS model, '2024-05-06T07:08:09Z' AS converted, 'preset' AS prompt FROM documents""",
    strip_document_header=f"SELECT doc_id AS doc, {h16(strip('text'))} AS text_hash FROM documents",
    strip_scaffolding=f"WITH {ASSEMBLED} SELECT doc, {scaffold('text')} AS text FROM texts",
)

# --- boilerplate ------------------------------------------------------------------------------------------------
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"


def masked(x: str) -> str:
    x = sub(x, "src1[0-9]|src[0-9]", "'{COMPANY}'")
    x = sub(x, rf"(?i)\d{{1,2}}\s+(?:{MONTHS})\s+\d{{4}}", "'{DATE}'")
    x = sub(x, r"(?i)£[\d,]+(?:\.\d+)?(?:\s*(?:000|million|m|bn))?|£nil", "'{AMOUNT}'")
    x = sub(x, r"(?i)(?:Registered|Registration|Company)\s+number\s*:?\s*\d+", "'{REGNUM}'")
    x = sub(x, r"\d+\.?\d*\s*%", "'{PERCENT}'")
    x = sub(x, r"\b(19|20)\d{2}\b", "'{YEAR}'")
    x = sub(x, r"\b\d[\d,]*(?:\.\d+)?\b", "'{NUM}'")
    return f"lower({collapse(x)})"


BODY_WORDS = "|".join(K.PROTECTED_BODY_KEYWORDS)
BOARD = (r"(?im)(?:appointed|resigned|retired)\s*(?:on|with\s+effect\s+from|from)?\s*\d{1,2}\s+\w+\s+\d{4}"
         r"|\(\s*(?:appointed|resigned|retired)\b[^)]*\)|^\s*[-*•|]\s*[^\n]*\b(?:appointed|resigned|retired)\b")
UNITS = f"""stripped AS (SELECT doc_id AS doc, source AS entity, {scaffold('text')} AS t FROM documents),
 units AS (SELECT doc, entity, unnest(string_split(t, {NL})) AS body, generate_subscripts(string_split(t, {NL}), 1) - 1 AS ord FROM stripped),
 fine AS (SELECT *, len(regexp_extract_all(body, '\\S+')) AS wc FROM units)"""


def sections(written: str = "true") -> str:
    return f"""{UNITS}, masks AS (SELECT doc, entity, 'F' || (regexp_extract(entity, '[0-9]+$')::INT % 4) AS grp, ord, body, wc, {masked('body')} AS norm
   FROM fine WHERE wc >= 40),
 sec AS (SELECT doc, entity, grp, ord, wc, norm, {h16('norm')} AS form, {h16(collapse('body'))} AS exact, left(body || {NL}, 500) AS ex,
   regexp_matches(lower(body), '{BODY_WORDS}') OR regexp_matches(body, '{BOARD}') AS prot, regexp_matches(body, '(?m)^\\|[^\\n]*\\|') AS tab,
   row_number() OVER (ORDER BY doc, ord) AS r, {written} AS written FROM masks)"""


# A word sets one bit of a signature of eight numbers. Bits that differ are words that differ, and at similarity 0.85 at most
# (1 - 0.85) / (1 + 0.85) of both sets' words may differ: a necessary condition that spares most comparisons.
FORMS = """forms AS MATERIALIZED (SELECT form, r, words, len(words) AS n,
   """ + ", ".join(f"""list_reduce(list_prepend(0::BIGINT, [1::BIGINT << ((hash(w) // 8) % 62)::INT FOR w IN words IF hash(w) % 8 = {i}]),
     lambda x, y: x | y) AS s{i}""" for i in range(8)) + """ FROM (
   SELECT form, min(r) AS r, list_distinct([w FOR w IN string_split(max(norm), ' ') IF w <> '']) AS words FROM sec GROUP BY form)),
 pairs AS MATERIALIZED (SELECT *, k / (an + bn - k) AS sim FROM (
   SELECT a.form AS a, b.form AS b, a.r AS ar, b.r AS br, a.n AS an, b.n AS bn, len(list_intersect(a.words, b.words)) AS k
   FROM forms a JOIN forms b ON a.r < b.r AND b.n >= a.n * 0.85 - 1e-9 AND a.n >= b.n * 0.85 - 1e-9
     AND """ + " + ".join(f"bit_count(xor(a.s{i}, b.s{i}))::INT" for i in range(8)) + """ <= (a.n + b.n) * 0.15 / 1.85 + 1e-6) WHERE k / (an + bn - k) >= 0.85),
 touched AS (SELECT form, r, row_number() OVER (ORDER BY r) AS i, coalesce(earlier, []) AS earlier FROM (
   SELECT a AS form, ar AS r FROM pairs UNION SELECT b, br FROM pairs) LEFT JOIN (SELECT b AS form, list(a) AS earlier FROM pairs GROUP BY b) USING (form)),
 walk AS (SELECT 0::BIGINT AS i, []::VARCHAR[] AS led UNION ALL
   SELECT w.i + 1, CASE WHEN list_has_any(t.earlier, w.led) THEN w.led ELSE list_append(w.led, t.form) END FROM walk w JOIN touched t ON t.i = w.i + 1),
 led AS (SELECT unnest(led) AS form FROM walk WHERE i = (SELECT max(i) FROM walk)),
 leaders AS (SELECT form, r, n FROM forms WHERE form NOT IN (SELECT form FROM touched) OR form IN (SELECT form FROM led)),
 links AS (SELECT b AS form, a AS leader, ar AS lr, an AS ln, sim FROM pairs WHERE a IN (SELECT form FROM led)
   UNION ALL SELECT a, b, br, bn, sim FROM pairs WHERE b IN (SELECT form FROM led)),
 asg AS (SELECT s.*, coalesce(x.scan, s.form) AS scan_fp, coalesce(x.hit, s.form) AS match_fp FROM sec s LEFT JOIN (
   SELECT s.r, arg_min(l.leader, (l.ln, l.lr)) FILTER (l.lr < s.r) AS scan, arg_min(l.leader, (l.ln, l.lr)) AS hit
   FROM sec s JOIN links l ON l.form = s.form GROUP BY s.r) x ON x.r = s.r)"""
SAME = "asg AS (SELECT *, form AS scan_fp, form AS match_fp FROM sec)"
LIBRARY = """lib AS (SELECT c.fp, entities, peer_entities, files, lo, hi, prot, wc, ex, first_doc, CASE WHEN fw THEN first_doc ELSE local_doc END AS canonical_doc FROM
   (SELECT scan_fp AS fp, count(DISTINCT doc) AS files, count(DISTINCT entity) AS entities, min(exact) AS lo, max(exact) AS hi,
      min(doc) FILTER (written) AS local_doc FROM asg GROUP BY 1) c
   JOIN (SELECT fp, max(k) AS peer_entities FROM (SELECT scan_fp AS fp, grp, count(DISTINCT entity) AS k FROM asg GROUP BY 1, 2) GROUP BY 1) p ON p.fp = c.fp
   JOIN (SELECT scan_fp AS fp, arg_min(doc, r) AS first_doc, arg_min(prot, r) AS prot, arg_min(wc, r) AS wc, arg_min(ex, r) AS ex, arg_min(written, r) AS fw
      FROM asg WHERE form = scan_fp GROUP BY 1) f ON f.fp = c.fp)"""
RULE = "NOT prot AND (entities >= 3 OR peer_entities >= 2)"
DECIDE = f"""could AS (SELECT s.doc, s.ord, s.r, l.fp, entities, files, canonical_doc, CASE WHEN NOT l.prot AND (entities >= 3 OR peer_entities >= 2) THEN 'boilerplate'
     WHEN entities = 1 AND files >= 2 AND lo = hi AND s.exact = lo THEN 'restatement' END AS reason
   FROM asg s JOIN lib l ON s.match_fp = l.fp WHERE written AND NOT s.prot AND NOT s.tab),
 claims AS (SELECT fp, arg_min(doc, r) AS claim FROM could WHERE reason IS NOT NULL AND canonical_doc IS NULL GROUP BY fp),
 gone AS (SELECT doc, ord, reason, could.fp, 'filing-' || coalesce(canonical_doc, claim) AS canonical, {NL} || '> [DEFLATED — (untitled): ' ||
     CASE reason WHEN 'boilerplate' THEN 'standard statutory text shared by ' || entities || ' companies, ' || files || ' filings'
     ELSE 'repeated verbatim from an earlier filing by this company (' || files || ' filings carry it)' END
     || '. Full text kept in `filing-' || coalesce(canonical_doc, claim) || '`.]' || {NL} AS pointer
   FROM could LEFT JOIN claims ON claims.fp = could.fp WHERE reason IS NOT NULL AND doc <> coalesce(canonical_doc, claim))"""
TEXT = f"""light AS (SELECT doc, {tidy("string_agg(coalesce(pointer, body || CASE WHEN ord = last THEN '' ELSE chr(10) END), '' ORDER BY ord)")} AS content,
     count(pointer) AS removed FROM (SELECT u.doc, u.ord, u.body, g.pointer, max(u.ord) OVER (PARTITION BY u.doc) AS last
     FROM units u LEFT JOIN gone g ON g.doc = u.doc AND g.ord = u.ord) GROUP BY doc),
 res AS (SELECT light.doc, source AS entity, strlen(text) AS original_size, strlen(content) AS lightweight_size, removed AS sections_removed,
   round((1.0::DOUBLE - strlen(content) / strlen(text)) * 100, 1) AS reduction_pct, content FROM light JOIN documents ON doc_id = light.doc)"""
EXACT = f"{sections()}, {SAME}, {LIBRARY}"
NEAR = f"{sections()}, {FORMS}, {LIBRARY}"
LABELLED = f"{sections('doc IN (SELECT doc_id FROM labels)')}, {FORMS}, {LIBRARY}"
LIB_COLUMNS = "fp, entities, peer_entities, files, prot AS is_protected, wc AS word_count, first_doc, canonical_doc"
RES_COLUMNS = "doc, entity, original_size, lightweight_size, reduction_pct, sections_removed"
VERDICTS = "verdicts AS (SELECT fp, CASE WHEN quality = 1 THEN 'strip' ELSE 'keep' END AS verdict FROM lib JOIN labels ON doc_id = first_doc)"
oracle(
    sections_lines=rf"WITH {UNITS} SELECT doc, ord AS section_ord, wc AS words, regexp_matches(body, '(?m)^\|[^\n]*\|') AS has_table FROM fine WHERE wc >= 40",
    sections_headings=f"""WITH {ASSEMBLED} SELECT doc, 0::BIGINT AS section_ord, 'Conversation ' || doc AS heading, 1::BIGINT AS level,
      {h16(sub(tidy('text'), '(?m)^## Page [0-9]+$'))} AS body_hash FROM texts""",
    masking_hash=f"WITH {EXACT} SELECT doc, ord AS section_ord, form, exact, wc AS word_count FROM sec",
    protected_flags=f"WITH {EXACT} SELECT doc, ord AS section_ord, prot AS is_protected, false AS is_financial, tab AS has_table FROM sec",
    money_tokens=rf"""WITH u AS (SELECT doc_id AS doc, unnest(string_split(text, {NL})) AS body, generate_subscripts(string_split(text, {NL}), 1) - 1 AS ord FROM documents),
      m AS (SELECT doc, ord, list_sort(list_distinct([replace(lower(x), ' ', '') FOR x IN
        regexp_extract_all(body || {NL}, '(?i)\$[\d,]+(?:\.\d+)?(?:\s*(?:000|million|m|bn))?|\$nil')])) AS m FROM u)
      SELECT doc, ord AS section_ord, len(m) AS amounts, array_to_string(m, '|') AS money FROM m WHERE len(m) > 0""",
    boilerplate_exact=f"WITH {EXACT} SELECT {LIB_COLUMNS} FROM lib WHERE {RULE}",
    boilerplate_peer=f"WITH {EXACT} SELECT {LIB_COLUMNS} FROM lib WHERE NOT prot AND entities < 5 AND peer_entities >= 2",
    boilerplate_near=f"WITH RECURSIVE {NEAR} SELECT {LIB_COLUMNS} FROM lib WHERE {RULE}",
    fingerprint_library=f"WITH RECURSIVE {NEAR} SELECT {LIB_COLUMNS} FROM lib",
    leader_clusters=f"WITH RECURSIVE {NEAR} SELECT l.form, doc, ord AS section_ord, n FROM leaders l JOIN sec ON sec.r = l.r",
    near_duplicate_links=f"WITH RECURSIVE {NEAR} SELECT form, leader, ln AS leader_n, round(sim, 6) AS similarity FROM links",
    cluster_assignment=f"WITH RECURSIVE {NEAR} SELECT doc, ord AS section_ord, scan_fp, match_fp FROM asg",
    restatements=f"WITH {EXACT}, {DECIDE} SELECT doc, ord AS section_ord, fp, canonical, pointer FROM gone WHERE reason = 'restatement'",
    restatement_report=f"WITH RECURSIVE {NEAR}, {DECIDE} SELECT '(untitled)' AS heading, count(*) AS copies FROM gone WHERE reason = 'restatement' HAVING count(*) > 0",
    removals_near=f"WITH RECURSIVE {NEAR}, {DECIDE} SELECT doc, ord AS section_ord, '(untitled)' AS heading, reason, canonical, fp, pointer FROM gone",
    canonical_reassign=f"WITH RECURSIVE {LABELLED}, {DECIDE} SELECT doc, ord AS section_ord, reason, fp, canonical FROM gone",
    deflate_file_results=f"WITH RECURSIVE {NEAR}, {DECIDE}, {TEXT} SELECT {RES_COLUMNS} FROM res",
    deflate_file_results_exact=f"WITH {EXACT}, {DECIDE}, {TEXT} SELECT {RES_COLUMNS} FROM res",
    deflate_text=f"WITH RECURSIVE {NEAR}, {DECIDE}, {TEXT} SELECT doc, {h16('content')} AS content_hash FROM res",
    deflate_totals=f"""WITH RECURSIVE {NEAR}, {DECIDE}, {TEXT}, s AS (SELECT count(*) AS f, sum(original_size)::BIGINT AS o, sum(lightweight_size)::BIGINT AS l FROM res)
      SELECT f AS files_deflated, o AS total_original_bytes, l AS total_lightweight_bytes, round((1.0::DOUBLE - l / o) * 100, 1) AS total_reduction_pct,
        (o - l) // 4 AS est_tokens_saved FROM s""",
    scan_counters=f"""WITH RECURSIVE {NEAR} SELECT (SELECT count(*) FROM documents) AS files_scanned, (SELECT count(DISTINCT source) FROM documents) AS entities_scanned,
      (SELECT count(DISTINCT regexp_extract(source, '[0-9]+$')::INT % 4) FROM documents) AS groups_scanned, (SELECT count(*) FROM sec) AS total_sections,
      (SELECT count(*) FROM lib WHERE {RULE}) AS candidate_sections""",
    patterns_topk=f"""WITH RECURSIVE {NEAR} SELECT fp, '(untitled)' AS heading, entities AS companies, files AS filings, wc AS words, {h16('left(ex, 400)')} AS example_hash,
      count(*) OVER () AS pattern_count FROM lib WHERE {RULE} ORDER BY entities DESC, files DESC, fp LIMIT 200""",
    protected_report=f"WITH RECURSIVE {NEAR} SELECT fp, '(untitled)' AS heading, 'Protected keyword' AS reason, files FROM lib WHERE prot",
    verdict_gate=f"""WITH RECURSIVE {NEAR}, {DECIDE}, {VERDICTS} SELECT doc, ord AS section_ord, reason, gone.fp FROM gone LEFT JOIN verdicts USING (fp)
      WHERE reason = 'restatement' OR verdict = 'strip'""",
    verification_summary=f"""WITH RECURSIVE {NEAR}, {VERDICTS} SELECT count(*) AS candidates, count(verdict) AS verified, count(*) FILTER (verdict = 'strip') AS strip,
      count(*) FILTER (verdict = 'keep') AS keep, 0::BIGINT AS failed, true AS available FROM lib LEFT JOIN verdicts USING (fp) WHERE {RULE}""",
)

# --- pages --------------------------------------------------------------------------------------------------------
PAGE_BODY = f"coalesce(nullif({strip('text')}, ''), '> **[Page ' || page_num || ' conversion pending/failed]**')"
MARKED = f"'<!-- Page ' || page_num || ' -->' || {NL} || '## Page ' || page_num || {NL} || {NL} || {PAGE_BODY}"
LEAD = f"{strip('text')}"
oracle(
    assemble=f"WITH {CONV}, {PART_TEXT} SELECT * FROM parts",
    count_pages=f"WITH {CONV} SELECT doc, total_pages AS pages FROM convdocs",
    split_pages=f"WITH {CONV} SELECT doc, page_num, {PAGE_BODY} AS text FROM conv",
    parse_pages_preamble=f"""WITH {CONV}, {PART_TEXT} SELECT doc, 'page' AS kind, page_num, {MARKED} AS text FROM conv
      UNION ALL SELECT doc, 'preamble', NULL, {LEAD} FROM parts WHERE part = 0""",
    split_sequential=f"""WITH {CONV}, {PART_TEXT} SELECT doc, page_num AS position, page_num::VARCHAR AS label, {MARKED} AS text FROM conv
      UNION ALL SELECT doc, NULL, 'preamble', {LEAD} FROM parts WHERE part = 0""",
)

# --- consolidation --------------------------------------------------------------------------------------------------
SLUG = r"replace(regexp_replace(lower(position || '. ' || title), '[^a-z0-9 -]', '', 'g'), ' ', '-')"
HEADLESS = strip(rf"regexp_replace({strip('text')}, '(?m)^#\s+[^\n]+\n+(?:>\s+[^\n]+\n+)*(?:---\s*\n+)?', '')")
HEAD_SQL = f"""head AS (SELECT count(*) AS n FROM docs), numbered AS (SELECT *, row_number() OVER (ORDER BY {{order}}) AS position FROM docs),
 parts AS (SELECT 0::BIGINT AS block, 0::BIGINT AS position, 0::BIGINT AS line, '# ' || {{title}} || {NL} AS text FROM head
  UNION ALL SELECT 0, 0, 1, '> **Consolidated Archive**: ' || n || ' Document(s)  ' || {NL} || '> **Total Pages**: ' || n || ' pages  ' || {NL}
    || '> **Generated via**: folioflow on 2024-01-01 00:00' || {NL} FROM head
  UNION ALL SELECT 1, 0, unnest([0, 1, 2]), unnest(['## 📋 Table of Contents' || {NL}, '| # | Document | Year / Period | Pages | Section Link |', '| :-: | :--- | :-: | :-: | :--- |'])
  UNION ALL SELECT 2, position, 0, '| ' || position || ' | ' || title || ' | ' || in_title || ' | 1 pgs | [View Section &rarr;](#' || {SLUG} || ') |' FROM numbered
  UNION ALL SELECT 3, 0, 0, {NL} || '---' || {NL}
  UNION ALL SELECT 4, position, unnest([0, 1, 2, 3, 4]), unnest([{NL} || '# ' || position || '. ' || title || {NL}, '> 📄 **Source**: `' || title || '.md`  ',
    '> 📂 **Folder**: `' || folder || '` | **Pages**: 1 pages  ' || {NL}, {HEADLESS}, {NL} || {NL} || '---' || {NL}]) FROM numbered)"""
oracle(
    combine_contents=f"""WITH {LIBRARY_DOCS}, numbered AS (SELECT *, row_number() OVER (ORDER BY in_title, lower(title), doc) AS position FROM docs)
      SELECT doc, position, title, in_title::VARCHAR AS year, 1::BIGINT AS pages, {SLUG} AS anchor FROM numbered""",
    combine_order_desc=f"WITH {LIBRARY_DOCS} SELECT doc, title, row_number() OVER (ORDER BY -in_title, lower(title), doc) AS position FROM docs",
    combine_text=f"WITH {LIBRARY_DOCS}, {HEAD_SQL.format(order='lower(title), doc', title=chr(39) + 'All filings' + chr(39))} SELECT * FROM parts",
    combine_totals=f"""WITH {LIBRARY_DOCS}, {HEAD_SQL.format(order='pos, doc', title="'Consolidated Markdown Document (' || n || ' Documents)'")}
      SELECT (SELECT n FROM head) AS total_documents, (SELECT n FROM head) AS total_pages,
        sum(len(regexp_extract_all(text, '\\S+')))::BIGINT AS total_words, (sum(length(text)) + count(*) - 1)::BIGINT AS total_chars FROM parts""",
    collection_label=f"""WITH {LIBRARY_DOCS}, s AS (SELECT count(DISTINCT folder) AS f, min(in_title) AS lo, max(in_title) AS hi FROM docs)
      SELECT f AS folders, 'Consolidated Document — ' || f || ' Folders (' || lo || '–' || hi || ')' AS title,
        f || '_Folders_Consolidated_' || lo || '_' || hi || '.md' AS file_name FROM s""",
    misplaced_consolidations=f"""WITH {LIBRARY_DOCS} SELECT '/ws/' || folder || '/Markdown/' || title || '.md' AS path,
      '/ws/' || folder || '/Consolidated/' || title || '.md' AS destination FROM docs JOIN labels ON doc_id = doc WHERE quality = 0""",
)

# --- comparison -----------------------------------------------------------------------------------------------------
SIDES = """a AS (SELECT conv_id // 2 AS pair, turn + 1 AS page_num, text FROM conversations WHERE conv_id % 2 = 0),
 b AS (SELECT conv_id // 2 AS pair, turn + 1 AS page_num, text FROM conversations WHERE conv_id % 2 = 1)"""


def compared(reduce) -> str:
    return f"""{SIDES}, cmp AS (SELECT coalesce(a.pair, b.pair) AS pair, coalesce(a.page_num, b.page_num) AS page_num, a.text AS ta, b.text AS tb,
      CASE WHEN b.pair IS NULL THEN 'only_a' WHEN a.pair IS NULL THEN 'only_b' WHEN {reduce('a.text')} = {reduce('b.text')} THEN 'same' ELSE 'changed' END AS status
      FROM a FULL JOIN b ON a.pair = b.pair AND a.page_num = b.page_num)"""


def aligned(status, text) -> str:
    """Table ``edits`` of the changed pages: their tokens and the length of a longest common subsequence, row by row of the alignment."""
    tokens = lambda x: f"regexp_extract_all({text(x)}, '\\s+|\\S+')"
    return f"""{compared(status)}, t AS MATERIALIZED (SELECT row_number() OVER () AS id, pair, page_num, ta, tb, {tokens('ta')} AS a, {tokens('tb')} AS b FROM cmp WHERE status = 'changed'),
      l AS MATERIALIZED (SELECT id, generate_subscripts(a, 1) AS i, unnest(a) AS token FROM t),
      grid AS (SELECT id, 0 AS i, 0 AS j, NULL AS token, 0 AS v FROM t UNION ALL SELECT id, 0, generate_subscripts(b, 1), unnest(b), 0 FROM t
        UNION ALL SELECT id, i + 1, j, token, max(best) OVER (PARTITION BY id ORDER BY j) FROM (
          SELECT g.id, g.i, g.j, g.token, greatest(v, CASE WHEN g.token = l.token THEN 1 + lag(v) OVER (PARTITION BY g.id ORDER BY j) ELSE 0 END) AS best
          FROM grid g JOIN l ON l.id = g.id AND l.i = g.i + 1)),
      edits AS (SELECT t.*, len(b) - n AS inserted, len(a) - n AS deleted FROM t JOIN (SELECT id, max(v) AS n FROM grid GROUP BY id) USING (id))"""


def word_count(x: str) -> str:
    return f"len(list_filter({x}, lambda w: NOT regexp_full_match(w, '\\s+')))"


oracle(
    compare_pages=f"WITH {compared(collapse)} SELECT pair, page_num, status FROM cmp",
    compare_summary=f"""WITH {compared(lambda x: collapse(prose(x)))}, s AS (SELECT pair, count(*) FILTER (status = 'changed') AS changed, count(*) FILTER (status IN ('changed', 'same')) AS shared,
        count(*) FILTER (status = 'only_a') AS only_a, count(*) FILTER (status = 'only_b') AS only_b FROM cmp GROUP BY pair)
      SELECT *, CASE WHEN shared > 0 THEN changed / shared >= 0.95 ELSE false END AS wholesale FROM s""",
    page_sets=f"""WITH {SIDES} SELECT pair, page_num, 'both' AS membership FROM (SELECT pair, page_num FROM a INTERSECT SELECT pair, page_num FROM b)
      UNION ALL SELECT pair, page_num, 'only_a' FROM (SELECT pair, page_num FROM a EXCEPT SELECT pair, page_num FROM b)
      UNION ALL SELECT pair, page_num, 'only_b' FROM (SELECT pair, page_num FROM b EXCEPT SELECT pair, page_num FROM a)""",
    diff_words=f"""WITH RECURSIVE {aligned(collapse, strip)} SELECT pair, page_num, {h16(strip('ta'))} AS a_hash, {h16(strip('tb'))} AS b_hash,
      (inserted + deleted)::BIGINT AS edits FROM edits""",
    diff_word_counts=f"""WITH RECURSIVE {aligned(lambda x: collapse(prose(x)), prose)} SELECT pair, page_num, inserted::BIGINT AS inserted, deleted::BIGINT AS deleted,
      ({word_count('b')} - {word_count('a')})::BIGINT AS more_words FROM edits""",
)

# --- ledger -----------------------------------------------------------------------------------------------------------
ANSWERS = f"""{CONV}, fresh AS (SELECT doc, page_num, {strip('text')} AS text FROM conv WHERE role = 'assistant' AND {strip('text')} <> '')"""
oracle(
    missing_pages=f"WITH {PAGES} SELECT doc, page_num FROM planned WHERE (doc, page_num) NOT IN (SELECT doc, page_num FROM cache WHERE model = 'A')",
    legacy_only=f"""WITH {PAGES} SELECT doc, page_num FROM planned WHERE (doc, page_num) NOT IN (SELECT doc, page_num FROM cache WHERE model = 'A')
      AND (doc, page_num) IN (SELECT doc, page_num FROM cache WHERE model IS NULL)""",
    document_coverage=f"""WITH {PAGES}, p AS (SELECT c.doc, c.page_num, bool_or(coalesce(model = 'R', false)) AS mine FROM cache c JOIN planned p ON p.doc = c.doc AND p.page_num = c.page_num
        WHERE model = 'R' OR model IS NULL GROUP BY ALL)
      SELECT o.doc, total_pages, count(*) FILTER (mine) AS cached_pages, count(*) FILTER (NOT mine) AS legacy_pages
      FROM odocs o LEFT JOIN p ON p.doc = o.doc GROUP BY ALL""",
    group_coverage=f"""WITH {PAGES}, c AS (SELECT DISTINCT p.folder, c.doc, c.page_num FROM cache c JOIN planned p ON p.doc = c.doc AND p.page_num = c.page_num WHERE model = 'A'),
        k AS (SELECT folder, count(*) AS converted FROM c GROUP BY folder), t AS (SELECT folder, sum(total_pages)::BIGINT AS pages FROM odocs GROUP BY folder)
      SELECT t.folder, pages, coalesce(converted, 0) AS converted, pages - coalesce(converted, 0) AS missing FROM t LEFT JOIN k USING (folder)""",
    payload_estimate=f"""WITH {PAGES}, t AS (SELECT folder, sum(total_pages)::BIGINT AS pages FROM odocs GROUP BY folder)
      SELECT folder, pages, pages * 420000 AS estimated_bytes, pages * 420000 <= 1800000000 AS fits, 4285::BIGINT AS max_pages_per_job FROM t""",
    batch_requests="""WITH p AS (SELECT DISTINCT l_orderkey AS doc, l_linenumber::BIGINT AS page_num FROM lineitem),
        k AS (SELECT *, format('doc{:03d}_p{:03d}', doc, page_num) AS key FROM p)
      SELECT doc, page_num, key, '{"key":"' || key || '","request":{"contents":[{"parts":[{"inline_data":{"mime_type":"image/png","data":""}},{"text":"Transcribe."}]}]}}' AS line FROM k""",
    collect_results=f"WITH {ANSWERS} SELECT doc, page_num, text FROM fresh",
    blocked_reasons=f"""WITH {CONV} SELECT CASE WHEN role = 'assistant' THEN 'STOP' WHEN length(text) % 2 = 0 THEN 'RECITATION' ELSE 'EMPTY_RESPONSE' END AS reason,
      count(*) AS pages FROM conv WHERE role <> 'assistant' OR {strip('text')} = '' GROUP BY 1""",
    collect_with_fallback=f"""WITH {ANSWERS}, n AS (SELECT doc, unnest(range(1, total_pages + 1)) AS page_num FROM convdocs)
      SELECT n.doc, n.page_num, coalesce(f.text, c.text, '> **[Page ' || n.page_num || ' conversion missing]**') AS text,
        CASE WHEN f.text IS NOT NULL THEN 'batch' WHEN c.text IS NOT NULL THEN 'cache' ELSE 'missing' END AS origin
      FROM n LEFT JOIN fresh f ON f.doc = n.doc AND f.page_num = n.page_num LEFT JOIN conv c ON c.doc = n.doc AND c.page_num = n.page_num AND n.page_num = 1""",
    recover_jobs="""WITH RECURSIVE free AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id::VARCHAR) AS n
          FROM events WHERE event_type = 'purchase' AND NOT value < 5),
        lost AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id::VARCHAR) AS n
          FROM events WHERE event_type = 'signup' AND value >= 1),
        fits AS (SELECT l.event_id, l.user_id, l.n, coalesce(min(f.n), 1000000000) AS b FROM lost l
          LEFT JOIN free f ON f.user_id = l.user_id AND f.ts >= l.ts - INTERVAL 120 SECOND GROUP BY ALL),
        walk AS (SELECT event_id, user_id, n, b FROM fits WHERE n = 1 UNION ALL
          SELECT j.event_id, j.user_id, j.n, greatest(j.b, w.b + 1) FROM walk w JOIN fits j ON j.user_id = w.user_id AND j.n = w.n + 1)
      SELECT w.event_id AS job_id, w.user_id AS display_name, f.event_id AS name, epoch_us(f.ts) AS create_micros
      FROM walk w JOIN free f ON f.user_id = w.user_id AND f.n = w.b""",
    stream_collect_results=f"WITH {ANSWERS} SELECT 'transcriber' AS model, doc, page_num, text FROM fresh",
    progress_latest="""WITH l AS (SELECT user_id AS file, arg_max(json_extract(props, '$.k')::BIGINT, (ts, event_id)) AS k, max(ts) AS t FROM events GROUP BY 1)
      SELECT file, k AS current_page, 100::BIGINT AS total_pages, round(k / 100 * 100, 1) AS percent,
        t > (SELECT max(ts) FROM events) - INTERVAL 30 SECOND AS alive FROM l""",
    progress_log="SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 150",
)
STATUS = """CASE event_type WHEN 'signup' THEN 'JOB_STATE_PENDING' WHEN 'purchase' THEN 'JOB_STATE_SUCCEEDED' WHEN 'error' THEN 'JOB_STATE_FAILED'
  ELSE 'JOB_STATE_RUNNING' END"""
JOB_STATE = f"""WITH e AS (SELECT user_id AS job_id, {STATUS} AS status, ts, event_id FROM events),
    t AS (SELECT job_id, arg_min(status, (ts, event_id)) AS status, min(ts) AS ts FROM e WHERE status IN ('JOB_STATE_SUCCEEDED', 'JOB_STATE_FAILED') GROUP BY 1),
    o AS (SELECT job_id, arg_max(status, (ts, event_id)) AS status FROM e WHERE status IN ('JOB_STATE_PENDING', 'JOB_STATE_RUNNING') GROUP BY 1)
  SELECT coalesce(t.job_id, o.job_id) AS job_id, coalesce(t.status, o.status) AS status, t.job_id IS NOT NULL AS is_completed,
    CASE WHEN t.status = 'JOB_STATE_SUCCEEDED' THEN epoch_us(t.ts) END AS completed_micros FROM t FULL JOIN o ON t.job_id = o.job_id"""
oracle(job_state_latest=JOB_STATE, stream_job_status=JOB_STATE)

# --- plans --------------------------------------------------------------------------------------------------------------
CHUNKS = f"""{PAGES}, o AS (SELECT folder, doc, total_pages AS pages, row_number() OVER (PARTITION BY folder ORDER BY doc) AS i FROM odocs),
 w AS (SELECT folder, doc, pages, i, pages AS run, 1::BIGINT AS part FROM o WHERE i = 1 UNION ALL
   SELECT o.folder, o.doc, o.pages, o.i, CASE WHEN w.run + o.pages > 500 THEN o.pages ELSE w.run + o.pages END, w.part + (w.run + o.pages > 500)::INT
   FROM w JOIN o ON o.folder = w.folder AND o.i = w.i + 1),
 named AS (SELECT folder, doc, pages, part, folder || CASE WHEN part > 1 OR sum(pages) OVER (PARTITION BY folder) > 500 THEN ' (part ' || part || ')' ELSE '' END AS grp FROM w)"""
oracle(
    chunk_folders=f'WITH RECURSIVE {CHUNKS} SELECT folder, doc, pages, part, grp AS "group" FROM named',
    plan_groups=f"""WITH RECURSIVE {CHUNKS} SELECT 'plan_20240101_000000' AS plan_id, grp AS "group", folder, part, count(*) AS documents, sum(pages)::BIGINT AS pages,
      'pending' AS state FROM named GROUP BY ALL""",
    admission=f"""WITH {GROUPS}, p AS (SELECT *, pages * 1262 AS cost, CASE WHEN missing > 0 THEN pages * 1262 ELSE 0 END AS used FROM grps WHERE state = 'pending'),
        r AS (SELECT *, row_number() OVER w AS turn, sum(used) OVER w - used AS before FROM p WINDOW w AS (ORDER BY plan_id, group_no))
      SELECT plan_id, group_no, pages, turn, CASE WHEN missing > 0 THEN 'submitted' WHEN retry_pass > 0 THEN 'collected' ELSE 'complete' END AS next_state,
        ['preset', 'verbatim-public-record', 'verbatim-record-keeping', 'verbatim-top-to-bottom', 'summary-of-last-resort'][retry_pass + 1] AS prompt_id
      FROM r WHERE turn < coalesce((SELECT min(turn) FROM r WHERE before + cost + 500000 > 8000000), turn + 1)""",
    enqueued_tokens=f"""WITH {GROUPS}, j AS (SELECT job_id, arg_max(pages, (plan_id, grp)) AS pages FROM grps WHERE state = 'submitted' GROUP BY 1)
      SELECT count(*) AS jobs, sum(pages * 1262)::BIGINT AS enqueued_tokens FROM j""",
    plan_summary=f"""WITH {GROUPS}, s AS (SELECT plan_id, count(*) AS groups, {', '.join(f"count(*) FILTER (state = '{s}') AS {s}_groups" for s in K.GROUP_STATES)},
        {', '.join(f"coalesce(sum(pages) FILTER (state = '{s}'), 0)::BIGINT AS {s}_pages" for s in K.GROUP_STATES)}, sum(pages)::BIGINT AS total_pages,
        sum(converted)::BIGINT AS converted_pages, bool_and(state IN ('collected', 'complete', 'failed')) AS is_finished FROM grps GROUP BY plan_id)
      SELECT *, collected_pages + complete_pages AS done_pages, round((collected_pages + complete_pages) / total_pages * 100, 1) AS percent,
        greatest(total_pages - converted_pages, 0) AS missing_pages,
        round((total_pages * 1262 / 1000000 * 0.125::DOUBLE + total_pages * 650 / 1000000 * 0.75::DOUBLE)::DECIMAL(38, 10), 6)::DOUBLE AS batch_cost_usd FROM s""",
    missing_split=f"""WITH {GROUPS} SELECT plan_id, coalesce(sum(missing) FILTER (retry_pass < 4), 0)::BIGINT AS retryable,
      coalesce(sum(missing) FILTER (retry_pass >= 4), 0)::BIGINT AS exhausted FROM grps GROUP BY plan_id""",
    group_state_fold="""WITH RECURSIVE e AS (SELECT user_id AS g, event_type AS e, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
        w AS (SELECT g, 0::BIGINT AS i, 'pending' AS state, 0 AS pass FROM (SELECT DISTINCT user_id AS g FROM events) UNION ALL
          SELECT w.g, e.i, CASE WHEN state = 'pending' AND e = 'signup' THEN 'submitted' WHEN state = 'submitted' AND e = 'click' AND pass < 4 THEN 'pending'
              WHEN state = 'submitted' AND e IN ('click', 'purchase') THEN 'collected' WHEN state = 'submitted' AND e = 'error' THEN 'failed'
              WHEN state = 'failed' AND e = 'view' THEN 'pending' ELSE state END,
            CASE WHEN state = 'submitted' AND e = 'click' AND pass < 4 THEN pass + 1 ELSE pass END
          FROM w JOIN e ON e.g = w.g AND e.i = w.i + 1)
      SELECT g AS "group", arg_max(state, i) AS state, arg_max(pass, i)::BIGINT AS retry_pass FROM w GROUP BY g""",
)

# --- workspace and cost ---------------------------------------------------------------------------------------------------
ROLL = """count(*) AS documents, count(*) FILTER (status = 'F') AS converted, count(*) FILTER (status = 'O') AS ready, count(*) FILTER (status = 'P') AS in_batch,
  sum(total_pages)::BIGINT AS pages FROM odocs"""
RATES = "rates AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{m}', {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE)" for m, a, b, c, d, _ in K.BASE_RATES) + ") t(m, si, so, bi, bo))"
SIZES = f"""sizes AS (SELECT doc_id AS doc, strlen(text) AS size, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN strlen({scaffold('text')}) END AS deflated FROM documents),
 rate AS (SELECT greatest(0.0::DOUBLE, 1 - sum(deflated) FILTER (deflated IS NOT NULL) / sum(size) FILTER (deflated IS NOT NULL)) AS rate FROM sizes WHERE size > 0)"""
oracle(
    workspace_rollup=f"WITH {PAGES} SELECT folder, {ROLL} GROUP BY folder UNION ALL SELECT 'ALL', {ROLL}",
    filter_inventory=f"""WITH {PAGES} SELECT '/ws/' || folder || '/' || doc || '.pdf' AS path, 'Report ' || doc || '.pdf' AS name, folder, total_pages FROM odocs
      WHERE status NOT IN ('F', 'P') AND (doc::VARCHAR LIKE '1%' OR lower(folder) LIKE '%report 1%')""",
    batch_status="""WITH j AS (SELECT l_partkey AS p, o_orderkey AS k, o_orderstatus AS s FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus IN ('P', 'O')),
        b AS (SELECT p, arg_max(s, k) AS s, max(k) AS k FROM j GROUP BY p)
      SELECT p_partkey::VARCHAR AS path, CASE s WHEN 'P' THEN 'JOB_STATE_PENDING' WHEN 'O' THEN 'JOB_STATE_RUNNING' END AS batch_status, k AS batch_job_id
      FROM part LEFT JOIN b ON p = p_partkey""",
    deflate_candidates="""SELECT '/ws/' || source || '/Markdown/' || d.doc_id || '.md' AS path, d.doc_id || '.md' AS name, d.doc_id::VARCHAR AS stem, source AS entity,
      upper(source) AS peer_group, n_chars AS size, CASE WHEN l.doc_id IS NOT NULL THEN n_chars // 2 END AS deflated_size,
      CASE WHEN l.doc_id IS NOT NULL THEN '/ws/' || source || '/Lightweight/' || d.doc_id || '.md' END AS deflated_path
      FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    projected_saving=f"WITH {SIZES} SELECT round(coalesce(rate, 0.12::DOUBLE), 9) AS rate FROM rate",
    budget_fit=f"""WITH {SIZES}, s AS (SELECT count(*) AS files, sum(size) AS o, coalesce(sum(deflated), 0) AS m, coalesce(sum(size) FILTER (deflated IS NULL), 0) AS open FROM sizes),
        t AS (SELECT files, floor(o / 4 + 0.5)::BIGINT AS original_tokens, floor((m + open * (1 - rate)) / 4 + 0.5)::BIGINT AS light_tokens FROM s, rate)
      SELECT *, round(light_tokens / 100000 * 100, 1) AS percent, light_tokens <= 100000 AS fits, abs(100000 - light_tokens) AS difference,
        CASE WHEN light_tokens <= 100000 THEN files ELSE floor(100000 / light_tokens * files)::BIGINT END AS filings_that_fit FROM t""",
    cost_by_folder=f"""WITH {PAGES}, {RATES}, d AS (SELECT folder, CASE priority WHEN '1-URGENT' THEN 'gemini-2.5-pro' WHEN '2-HIGH' THEN 'gemini-3-flash-preview' ELSE 'unlisted' END AS model,
        sum(total_pages)::BIGINT AS pages FROM odocs GROUP BY 1, 2)
      SELECT folder, model, pages, pages * 1262 AS input_tokens, pages * 650 AS output_tokens, pages * 1912 AS total_tokens,
        round((pages * 1262 / 1000000 * si + pages * 650 / 1000000 * so)::DECIMAL(38, 10), 6)::DOUBLE AS cost_standard_usd, round((pages * 1262 / 1000000 * bi + pages * 650 / 1000000 * bo)::DECIMAL(38, 10), 6)::DOUBLE AS cost_batch_usd
      FROM d JOIN rates ON m = CASE model WHEN 'unlisted' THEN 'gemini-3.1-flash-lite' ELSE model END""",
    cost_by_document=f"""WITH {PAGES}, {RATES} SELECT doc, total_pages * 1912 AS total_tokens, round((total_pages * 1262 / 1000000 * si + total_pages * 650 / 1000000 * so)::DECIMAL(38, 10), 6)::DOUBLE AS cost_standard_usd,
      round((total_pages * 1262 / 1000000 * bi + total_pages * 650 / 1000000 * bo)::DECIMAL(38, 10), 6)::DOUBLE AS cost_batch_usd FROM odocs JOIN rates ON m = 'gemini-3.1-flash-lite'""",
    rate_cards="""WITH s AS (SELECT p_brand AS b, count(*) AS n, min(p_size) AS lo, max(p_size) AS hi FROM part GROUP BY 1)
      SELECT b AS model_id, b || ' Model' AS name, lo + 0.25::DOUBLE AS input_standard, hi + 0.5::DOUBLE AS output_standard,
        CASE WHEN n % 2 = 0 THEN lo + 0.125::DOUBLE ELSE round((lo + 0.25::DOUBLE) * 0.5, 4) END AS input_batch,
        CASE WHEN n % 2 = 0 THEN hi::DOUBLE ELSE round((hi + 0.5::DOUBLE) * 0.5, 4) END AS output_batch,
        round((lo + 0.25::DOUBLE) * 0.1::DOUBLE, 4) AS context_cache, 'Makes parts.' AS description FROM s""",
    rate_freshness="""WITH l AS (SELECT user_id, round((epoch_us((SELECT max(ts) FROM events)) - epoch_us(max(ts))) / 1000000) AS s FROM events GROUP BY 1),
        u AS (SELECT user_id, s, floor(s / 60)::BIGINT AS m, floor(s / 3600)::BIGINT AS h, floor(s / 86400)::BIGINT AS d FROM l)
      SELECT user_id, CASE WHEN s < 60 THEN 'just now' WHEN m < 60 THEN m || ' minute' || CASE WHEN m = 1 THEN '' ELSE 's' END || ' ago'
        WHEN h < 24 THEN h || ' hour' || CASE WHEN h = 1 THEN '' ELSE 's' END || ' ago' ELSE d || ' day' || CASE WHEN d = 1 THEN '' ELSE 's' END || ' ago' END AS synced,
        d >= 30 AS stale FROM u""",
    newest_versions="""SELECT user_id AS path, arg_max(event_id, (ts, event_id % 97)) AS version, arg_max(event_id, (ts, event_id % 97)) % 97 AS size FROM events GROUP BY 1""",
    changed_files="""WITH c AS (SELECT DISTINCT l_orderkey AS path, l_linenumber::BIGINT AS size, l_shipdate AS mtime FROM lineitem),
        p AS (SELECT l_orderkey AS path, l_linenumber::BIGINT AS size, l_shipdate AS mtime FROM lineitem WHERE l_returnflag = 'R')
      SELECT path, size, epoch_us(mtime) AS mtime_micros FROM (SELECT * FROM c EXCEPT SELECT * FROM p)""",
    dedupe_keep_first="""WITH c AS (SELECT l_partkey AS path, l_orderkey AS pos, count(*) AS copies FROM lineitem GROUP BY ALL)
      SELECT path, min(pos) AS pos, arg_min(copies, pos) AS copies FROM c GROUP BY path""",
)
