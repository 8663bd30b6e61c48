"""SQL that tells the same as a query, for DuckDB over the same tables."""

from __future__ import annotations

from corvane.functions.terms import BLOCK_TAGS, RAW_TOKEN, SOURCE_TYPES, STOPWORDS
from corvane.operators import quality
from corvane.operators.nested import CONFIDENCE_FIELDS, REPORT_FIELDS, SOURCE_FIELDS, STAT_FIELDS

_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)


def _stem(x: str) -> str:
    return f"""CASE WHEN length({x}) <= 3 OR regexp_matches({x}, '[._/-]') OR regexp_matches({x}, '(ss|us|is|as|os)$') THEN {x} WHEN {x} LIKE '%ies' THEN {x}[:-4] || 'y' WHEN regexp_matches({x}, '(ches|shes|xes|ses|zes)$') THEN {x}[:-3] WHEN {x} LIKE '%s' THEN {x}[:-2] ELSE {x} END"""


def _norm(x: str) -> str:
    return f"CASE WHEN {x} = '' OR regexp_matches({x}, '^[a-z]$') OR {x} IN ({_STOP}) THEN NULL ELSE {_stem(x)} END"


def _terms(name: str, source: str, key: str, text: str, expand: bool = True) -> str:
    raw = f"{name}_raw AS (SELECT {key} AS k, unnest(regexp_extract_all(lower({text}), '{RAW_TOKEN}', 1)) AS t FROM {source})"
    if not expand:
        return f"{raw}, {name} AS (SELECT k, {_norm('t')} AS term FROM {name}_raw WHERE {_norm('t')} IS NOT NULL)"
    parts = f"{name}_parts AS (SELECT k, t, {_norm('t')} AS whole, unnest(CASE WHEN regexp_matches(t, '[._/-]') THEN regexp_split_to_array(t, '[._/-]+') ELSE [] END) AS p FROM {name}_raw)"
    return f"""{raw}, {parts}, {name} AS (SELECT k, {_norm('t')} AS term FROM {name}_raw WHERE {_norm('t')} IS NOT NULL
        UNION ALL SELECT k, {_norm('p')} FROM {name}_parts WHERE {_norm('p')} IS NOT NULL AND (whole IS NULL OR {_norm('p')} <> whole))"""


_ASKED = "asked AS (SELECT DISTINCT id, question FROM questions)"


def _index(source: str, key: str, text: str) -> str:
    return f"""{_terms('dt', source, key, text)}, postings AS (SELECT k AS doc, term, count(*) AS tf FROM dt GROUP BY 1, 2),
    lengths AS (SELECT doc, sum(tf) AS dl FROM postings GROUP BY 1), vocabulary AS (SELECT term, count(*) AS df FROM postings GROUP BY 1), stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lengths)"""


def _scores(source: str, key: str, text: str) -> str:
    return f"""{_ASKED}, {_index(source, key, text)}, {_terms('qt', 'asked', 'id', 'question')}, qterms AS (SELECT DISTINCT k AS query, term FROM qt),
    scores AS (SELECT query, p.doc, floor(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) * 1e6 + 0.5) / 1e6 AS score, count(*) AS matched
        FROM qterms JOIN vocabulary USING (term) JOIN postings p USING (term) JOIN lengths l ON p.doc = l.doc, stats GROUP BY 1, 2)"""


_INDEX, _SCORES = _index("documents", "doc_id", "text"), _scores("documents", "doc_id", "text")
_RANKED = "SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM scores"


def _profile(x: str) -> str:
    return "[" + ", ".join(f"(length(lower({x})) - length(replace(lower({x}), '{c}', '')))::DOUBLE" for c in "abcdefghijklmnopqrstuvwxyz") + "]"


def _similar(source: str, key: str, text: str, k: int) -> str:
    """The rows of ``source`` most similar to each question by their letters; a vector without a norm has cosine 0."""
    zero = "list_sum(list_transform({0}, lambda x: x * x)) = 0"
    return f"""qv AS (SELECT id AS query, {_profile('question')} AS v FROM asked), dv AS (SELECT {key} AS doc, {_profile(text)} AS v FROM {source} WHERE {text} IS NOT NULL),
    cosines AS (SELECT query, doc, CASE WHEN {zero.format('qv.v')} OR {zero.format('dv.v')} THEN 0 ELSE floor(list_cosine_similarity(qv.v, dv.v) * 1e6 + 0.5) / 1e6 END AS score FROM qv, dv),
    d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM cosines) WHERE rank <= {k})"""


_TWO = f"""WITH {_SCORES}, s AS (SELECT * FROM ({_RANKED}) WHERE rank <= 20), {_similar('documents', 'doc_id', 'text', 20)}"""
_FUSED = "fs AS (SELECT coalesce(d.query, s.query) AS query, coalesce(d.doc, s.doc) AS doc, d.rank AS dr, s.rank AS sr, d.score AS ds, s.score AS ss, coalesce({0}::DOUBLE / (60 + d.rank), 0) + coalesce({1}::DOUBLE / (60 + s.rank), 0) AS f FROM d FULL JOIN s ON d.query = s.query AND d.doc = s.doc), ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(f, 12) DESC, dr NULLS LAST, sr NULLS LAST, doc) AS rank FROM fs)"
_PASSAGES = "c AS (SELECT DISTINCT id, document_id, coalesce(chunk_index, 0) AS idx, coalesce(page, 1) AS page, text, concat_ws(' ', heading, text) AS told FROM chunks)"


def _round(x: str, digits: int = 3) -> str:
    return f"floor({x} * 1e{digits} + 0.5) / 1e{digits}"


def _retrieved(mode: str, expand: bool) -> str:
    """Statements up to ``found`` (the sources) for a mode: lists of 24, of which 20 are reranked and 8 kept."""
    lists = f"WITH {_PASSAGES}, {_scores('c', 'id', 'told')}, s0 AS (SELECT query, doc, score, rank FROM ({_RANKED}) WHERE rank <= 24), {_similar('c', 'id', 'text', 24).replace('d AS (', 'd0 AS (')}"
    lists += f", s AS (SELECT * FROM s0 WHERE {mode != 'dense'}), d AS (SELECT query, doc, score, rank FROM d0 WHERE {mode != 'sparse'})"
    weights = {"hybrid": ("0.7", "0.3"), "dense": ("1", "0"), "sparse": ("0", "1")}[mode]
    score = "f" if mode == "hybrid" else "coalesce(ds, ss)"
    around = """near AS (SELECT p.query, p.document_id, i.idx, min(p.rank) AS anchor, min_by(p.score, p.rank) AS score FROM placed p, LATERAL (SELECT unnest(range(p.idx - 2, p.idx + 3)) AS idx) i GROUP BY 1, 2, 3),
        around AS (SELECT n.query, c.id AS doc, n.score, row_number() OVER (PARTITION BY n.query ORDER BY anchor, page, c.idx, c.id) AS place FROM near n JOIN c ON c.document_id = n.document_id AND c.idx = n.idx WHERE NOT EXISTS (SELECT 1 FROM placed p WHERE p.query = n.query AND p.document_id = n.document_id AND p.idx = n.idx)),"""
    return f"""{lists}, {_FUSED.format(*weights)}, fused AS (SELECT query, doc, rank, {_round(score)} AS score, ds, ss, concat_ws(',', CASE WHEN dr IS NOT NULL THEN 'dense' END, CASE WHEN sr IS NOT NULL THEN 'sparse' END) AS retrieved_by FROM ranked WHERE rank <= 24),
        pool AS (SELECT *, count(*) OVER (PARTITION BY query) AS p FROM fused WHERE rank <= 20), wide AS (SELECT query, count(*) AS q FROM qterms GROUP BY 1),
        has AS (SELECT pool.query, pool.doc, p, qterms.term FROM pool JOIN qterms USING (query) JOIN postings ON postings.doc = pool.doc AND postings.term = qterms.term), dfs AS (SELECT query, term, count(*) AS pdf FROM has GROUP BY 1, 2),
        sums AS (SELECT query, doc, sum(ln(1 + p / pdf)) AS s FROM has JOIN dfs USING (query, term) GROUP BY 1, 2),
        scored AS (SELECT pool.*, CASE WHEN p > 1 AND q IS NOT NULL THEN {_round('least(1.0, coalesce(sums.s / (q * ln(1 + p)), 0))', 6)} END AS rr FROM pool LEFT JOIN wide USING (query) LEFT JOIN sums USING (query, doc)),
        prime AS (SELECT * REPLACE (row_number() OVER (PARTITION BY query ORDER BY rr DESC NULLS LAST, rank, doc) AS rank) FROM scored), pri AS (SELECT * FROM prime WHERE rank <= 8),
        placed AS (SELECT pri.*, c.document_id, c.idx FROM pri JOIN c ON pri.doc = c.id), {around if expand else ''}
        every AS (SELECT query, doc, 0 AS part, rank, score, ds, ss, rr, retrieved_by FROM pri {"UNION ALL SELECT query, doc, 1, place, score, NULL, NULL, NULL, 'neighbor' FROM around WHERE place <= 4" if expand else ''}),
        found AS (SELECT query AS question_id, row_number() OVER (PARTITION BY query ORDER BY part, rank, doc) AS citation, doc AS chunk_id, score, {_round('ds')} AS dense_score, {_round('ss')} AS sparse_score, {_round('rr')} AS rerank_score, retrieved_by FROM every)"""


_COVERAGE = f"""{_terms('ct', 'asked', 'id', 'question', expand=False)}, cq AS (SELECT DISTINCT k, term FROM ct), coverages AS (SELECT asked.id AS query, floor(coalesce(count(v.term) / nullif(count(cq.term), 0), 0) * 1e6 + 0.5) / 1e6 AS coverage FROM asked LEFT JOIN cq ON asked.id = cq.k LEFT JOIN vocabulary v ON cq.term = v.term GROUP BY 1)"""

_PAIRS = "SELECT q.vec_id AS query, e.vec_id AS doc, floor(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) * 1e6 + 0.5) / 1e6 AS score, q.label AS ql, e.label AS el FROM embeddings q, embeddings e"
_LATEST = "SELECT * FROM messages QUALIFY row_number() OVER (PARTITION BY id ORDER BY received_at DESC NULLS LAST) = 1"
_ROLE = "CASE WHEN lower(trim(role)) IN ('user', 'human') THEN 'user' WHEN lower(trim(role)) IN ('assistant', 'ai', 'bot', 'model') THEN 'assistant' WHEN lower(trim(role)) IN ('system', 'tool') THEN 'other' ELSE 'unknown' END"
_WHITE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_CITATION = r"\[(\d+(?:\s*,\s*\d+)*)\]"


def _normal(x: str) -> str:
    for pattern, new in ((r"\r\n?", r"\n"), (r"\x{a0}", " "), (r"[ \t]+\n", r"\n"), (r"[ \t]{2,}", " "), (r"\n{3,}", r"\n\n"), (rf"^{_WHITE}+|{_WHITE}+$", "")):
        x = f"regexp_replace({x}, '{pattern}', {_quoted(new)}, 'g')"
    return x


def _quoted(x: str) -> str:
    return "E'" + x + "'" if "\\" in x else "'" + x + "'"


def _html(x: str) -> str:
    closed = "|".join(rf"<{tag}.*?</{tag}>" for tag in ("script", "style", "noscript", "template"))
    for pattern, new, flags in (
        (r"<!--.*?-->", " ", "gs"), (closed, " ", "gsi"), (r"<br\s*/?>", r"\n", "gi"), (f"</(?:{BLOCK_TAGS})>", r"\n\n", "gi"), (rf"<(?:{BLOCK_TAGS})\b[^>]*>", r"\n", "gi"), ("<[^>]+>", " ", "g"),
        ("&nbsp;", " ", "gi"), ("&amp;", "&", "gi"), ("&lt;", "<", "gi"), ("&gt;", ">", "gi"), ("&quot;", '"', "gi"), ("&#39;|&apos;", "''", "gi"),
    ):
        x = f"regexp_replace({x}, '{pattern}', {_quoted(new)}, '{flags}')"
    number = r"TRY_CAST(regexp_extract(p, '^(\d{1,7});', 1) AS BIGINT)"
    read = rf"CASE WHEN {number} BETWEEN 1 AND 55295 OR {number} BETWEEN 57344 AND 65535 THEN chr({number}::INT) || regexp_replace(p, '^\d+;', '') ELSE '&#' || p END"
    return _normal(f"(string_split({x}, '&#')[1] || array_to_string(list_transform(string_split({x}, '&#')[2:], lambda p: {read}), ''))")


def _json(x: str) -> str:
    """A column's JSON, unwrapped up to three times; null if it isn't valid."""
    once = lambda y: f"(CASE WHEN json_type(TRY_CAST({y} AS JSON)) = 'VARCHAR' THEN json_extract_string(TRY_CAST({y} AS JSON), '$') ELSE {y} END)"
    for _ in range(3):
        x = f"(CASE WHEN json_valid({x}) THEN {once(x)} END)"
    return f"(CASE WHEN json_valid({x}) THEN {x}::JSON END)"


def _camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(w.capitalize() for w in rest)


def _value(x: str, name: str, kind: str) -> str:
    text = f"coalesce(json_extract_string({x}, '$.{name}'), json_extract_string({x}, '$.{_camel(name)}'))"
    return text if kind == "string" else f"TRY_CAST({text} AS {dict(int='INTEGER', long='BIGINT', double='DOUBLE', boolean='BOOLEAN')[kind]})"


def _fields(x: str, fields: dict[str, str]) -> str:
    return ", ".join(f"{_value(x, k, kind)} AS {k}" for k, kind in fields.items())


def _array(x: str) -> str:
    """JSON as a list, a lone value as a list of one, null as the empty list."""
    return f"(CASE WHEN {x} IS NULL OR json_type({x}) = 'NULL' THEN [] WHEN json_type({x}) = 'ARRAY' THEN json_extract({x}, '$[*]') ELSE [{x}] END)"


def _each(name: str, source: str, keep: str, array: str) -> str:
    return f"{name} AS (SELECT {keep}, unnest({array}) AS x, unnest(range(len({array}))) AS place FROM {source})"


def _member(x: str, name: str) -> str:
    return f"coalesce(json_extract({x}, '$.{name}'), json_extract({x}, '$.{_camel(name)}'))"


_PARSED = f"m AS (SELECT id AS message_id, {_json('sources')} AS s, {_json('citations')} AS c, {_json('confidence')} AS f, {_json('retrieval_stats')} AS r FROM ({_LATEST}))"
_SOURCES = _each("so", "m", "message_id", _array("s"))
_VERDICTS = _each("ve", "m", "message_id", _array("json_extract(c, '$.verdicts')"))
_NUMBER = "TRY_CAST(json_extract_string(x, '$') AS BIGINT)"


def _numbers(which: str) -> str:
    return f"nu AS (SELECT message_id, place AS verdict_no, unnest({_array(_member('x', which))}) AS x, unnest(range(len({_array(_member('x', which))}))) AS place FROM ve)"


def _cited(which: str) -> str:
    return f"""WITH {_PARSED}, {_SOURCES}, {_VERDICTS}, {_numbers(which)}
        SELECT DISTINCT nu.message_id, verdict_no, so.place AS source_no FROM nu JOIN so ON nu.message_id = so.message_id AND TRY_CAST(json_extract_string(nu.x, '$') AS BIGINT) = coalesce(TRY_CAST(json_extract_string(so.x, '$.citation') AS BIGINT), so.place + 1)"""


def _report(which: str) -> str:
    return f"""WITH {_PARSED}, {_each('li', 'm', 'message_id', _array(_member('c', which)))} SELECT message_id, place, {_NUMBER} AS number FROM li"""


def _object(column: str, fields: dict[str, str]) -> str:
    return f"WITH {_PARSED} SELECT message_id, {_fields(column, fields)} FROM m WHERE json_type({column}) = 'OBJECT'"


_EXTENSION = r"regexp_extract(lower(filename), '\.([a-z0-9]+)$', 1)"
_METRICS = ", ".join(f"coalesce(floor(avg({m}) * 1000 + 0.5) / 1000, 0) AS {m}" for m in ("correctness", "faithfulness", "retrieval_recall", "citation_accuracy"))
_D = "least(1.0, greatest(0.0, (top_dense_score - 0.55::DOUBLE) / (0.85::DOUBLE - 0.55::DOUBLE)))"
_K = "least(1.0, greatest(0.0, keyword_coverage))"
_R = "least(1.0, greatest(0.0, mean_rerank_score))"

_EDGES = r"^[\s\x0b]+|[\s\x0b]+$"
_UNITS = r"string_split(regexp_replace({0}, '([.!?])[\s\x0b]+([A-Z(“\"''\d])', '\1' || chr(30) || '\2', 'g'), chr(30))"


def _bare(x: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace({x}, '{_CITATION}', '', 'g'), '{_WHITE}{{2,}}', ' ', 'g'), '^{_WHITE}+|{_WHITE}+$', '', 'g')"


_CITED_INTS = f"list_sort(list_distinct(list_transform(flatten(list_transform(regexp_extract_all({{0}}, '{_CITATION}', 1), lambda m: string_split(m, ','))), lambda n: trim(n)::INT)))"
_CLAIMS = rf"""a AS (SELECT id AS key, content FROM ({_LATEST}) WHERE {_ROLE} = 'assistant' AND content IS NOT NULL),
        l1 AS (SELECT key, unnest(ls) AS raw, unnest(range(len(ls))) AS l FROM (SELECT key, string_split(regexp_replace(content, '```.*?```', ' ', 'gs'), E'\n') AS ls FROM a)), l2 AS (SELECT key, l, regexp_replace(raw, '{_EDGES}', '', 'g') AS line FROM l1),
        l3 AS (SELECT *, regexp_replace(regexp_replace(line, '^([-*+]|\d+[.)])[\s\x0b]+', ''), '{_EDGES}', '', 'g') AS body FROM l2 WHERE line <> '' AND NOT regexp_matches(line, '^#{{1,6}}[\s\x0b]') AND NOT regexp_matches(line, '^([-*_][\s\x0b]*){{3,}}$')),
        l4 AS (SELECT key, l, unnest(us) AS raw, unnest(range(len(us))) AS u FROM (SELECT key, l, CASE WHEN body <> line THEN [body] ELSE {_UNITS.format('body')} END AS us FROM l3 WHERE body <> '')), l5 AS (SELECT key, l, u, regexp_replace(raw, '{_EDGES}', '', 'g') AS unit FROM l4),
        l6 AS (SELECT *, {_bare('unit')} AS bare FROM l5), l7 AS (SELECT *, len(list_filter(regexp_split_to_array(bare, '[\s\x0b]+'), lambda w: w <> '')) AS words FROM l6),
        cl AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY l, u) AS claim_no, bare AS claim, {_CITED_INTS.format('unit')} AS cites FROM l7
            WHERE bare <> '' AND NOT ends_with(bare, '?') AND NOT (ends_with(bare, ':') AND words <= 8) AND NOT regexp_matches(bare, '^\*\*[^*]+\*\*:?$') AND regexp_matches(bare, '[a-zA-Z]') AND words >= 4)"""


def _whole_list(which: str) -> str:
    return f"list_filter(list_transform({_array(_member('x', which))}, lambda v: TRY_CAST(json_extract_string(v, '$') AS INT)), lambda v: v IS NOT NULL)"


_JUDGED = f"""{_PARSED}, {_VERDICTS}, j1 AS (SELECT message_id AS key, place AS claim_no, lower(coalesce(json_extract_string(x, '$.status'), '')) AS said, {_whole_list('citations')} AS cites, list_filter({_whole_list('supported_by')}, lambda v: v > 0) AS sup FROM ve WHERE json_type(x) = 'OBJECT'),
    j2 AS (SELECT key, claim_no, CASE WHEN said IN ('supported', 'unsupported') THEN said WHEN said IN ('partial', 'partially_supported') THEN 'partial' ELSE 'unverified' END AS norm, cites, CASE WHEN claim_no >= 24 THEN [] ELSE sup END AS sup FROM j1),
    jc AS (SELECT key, claim_no, cites, sup, CASE WHEN claim_no >= 24 THEN 'unverified' WHEN norm = 'supported' AND len(cites) > 0 AND NOT list_has_any(cites, sup) THEN 'partial' ELSE norm END AS status FROM j2),
    report AS (SELECT key, count(*) AS total_claims, count(*) FILTER (len(cites) > 0) AS cited_claims, count(*) FILTER (len(cites) > 0 AND status = 'supported') AS supported_claims, count(*) FILTER (status = 'unsupported') AS unsupported_claims, count(*) FILTER (status IN ('supported', 'partial')) AS grounded_claims,
        count(*) FILTER (len(cites) > 0 AND status = 'partial' AND len(sup) > 0 AND NOT list_has_any(cites, sup)) AS miscited_claims FROM jc GROUP BY 1)"""
_CONFIDENCE = f"CASE WHEN coalesce(passages_returned, 0) = 0 AND coalesce(fused_candidates, 0) = 0 THEN 0 ELSE floor(least(1.0, greatest(0.0, CASE WHEN mean_rerank_score IS NULL AND mode = 'sparse' THEN {_K} WHEN mean_rerank_score IS NULL THEN 0.65::DOUBLE * {_D} + 0.35::DOUBLE * {_K} WHEN mode = 'sparse' THEN 0.7::DOUBLE * {_R} + 0.3::DOUBLE * {_K} ELSE 0.55::DOUBLE * {_R} + 0.3::DOUBLE * {_D} + 0.15::DOUBLE * {_K} END)) * 1000 + 0.5) / 1000 END"
_SCORED = f"""{_JUDGED}, st AS (SELECT message_id, {_fields('r', STAT_FIELDS)} FROM m WHERE json_type(r) = 'OBJECT'), li AS (SELECT message_id, unnest({_array(_member('c', 'invalid_citations'))}) AS x FROM m), iv AS (SELECT message_id, list_sort(list({_NUMBER})) AS invalid FROM li WHERE {_NUMBER} IS NOT NULL GROUP BY 1), vf AS (SELECT message_id, {_value('c', 'verified', 'boolean')} AS verified FROM m WHERE json_type(c) = 'OBJECT'),
    sc AS (SELECT st.*, {_CONFIDENCE} AS retrieval, coalesce(invalid, []) AS invalid, coalesce(verified, false) AS verified, coalesce(total_claims, 0) AS tc, coalesce(cited_claims, 0) AS cc, coalesce(supported_claims, 0) AS sc, coalesce(unsupported_claims, 0) AS uc, coalesce(miscited_claims, 0) AS mc
        FROM st LEFT JOIN report ON st.message_id = report.key LEFT JOIN iv ON st.message_id = iv.message_id LEFT JOIN vf ON st.message_id = vf.message_id),
    sd AS (SELECT *, CASE WHEN tc > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS completeness, CASE WHEN tc = 0 THEN 0.0::DOUBLE WHEN verified THEN least(1.0, greatest(0.0, sc / tc - CASE WHEN len(invalid) > 0 THEN 0.15::DOUBLE ELSE 0 END - 0.3::DOUBLE * mc / tc)) ELSE least(1.0, greatest(0.0, 0.6::DOUBLE * cc / tc)) END AS citation FROM sc)"""
_PERCENT = "(floor({0} * 100 + 0.5)::BIGINT || '%')"
_LISTED = f"so AS (SELECT message_id, place AS source_no, {_fields('x', SOURCE_FIELDS)} FROM (SELECT message_id, unnest({_array('s')}) AS x, unnest(range(len({_array('s')}))) AS place FROM m) WHERE json_type(x) = 'OBJECT'), sl AS (SELECT message_id, list({{'citation': coalesce(citation, source_no + 1), 'filename': coalesce(filename, 'document'), 'heading': heading, 'page': coalesce(page, 1), 'text': text}} ORDER BY source_no) AS sources FROM so GROUP BY 1)"
_WHERE = "(CASE WHEN coalesce(x.heading, '') <> '' THEN x.filename || ' › ' || x.heading ELSE x.filename || ' · page ' || x.page END)"
_CLEAN = f"regexp_replace(regexp_replace(coalesce(x.text, ''), '{_WHITE}+', ' ', 'g'), '^ +| +$', '', 'g')"


def _once(items: str) -> str:
    """A list without repetitions, in its order."""
    return f"list_filter({items}, lambda x, i: list_position({items}, x) = i)"


_TOPICS = _once(f"list_transform(coalesce(sources, [])[:5], lambda x: {_WHERE} || ' — ' || CASE WHEN length({_CLEAN}) > 120 THEN {_CLEAN}[:120] || '…' ELSE {_CLEAN} END)")
_FILES = "(" + _once("list_transform(coalesce(sources, []), lambda x: x.filename)") + ")[:5]"


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _lines(x: str) -> str:
    return f"array_to_string(list_transform({x}, lambda x: '- ' || x), chr(10))"


ORACLES: dict[str, str] = {
    "claim_rows": f"WITH {_CLAIMS} SELECT key, claim_no::INT AS claim_no, claim, array_to_string(cites, ',') AS citations FROM cl",
    "citation_reports": f"""WITH {_CLAIMS}, {_PARSED}, {_SOURCES}, n AS (SELECT message_id AS key, count(*) FILTER (json_type(x) = 'OBJECT')::INT AS n FROM so GROUP BY 1), own AS (SELECT key, count(*) AS total, count(*) FILTER (len(cites) > 0) AS cited, list_sort(list_distinct(flatten(list(cites)))) AS numbers FROM cl GROUP BY 1)
        SELECT a.key, coalesce(total, 0) AS total_claims, coalesce(cited, 0) AS cited_claims, coalesce(numbers, []) AS cited_numbers, list_filter(coalesce(numbers, []), lambda x: x < 1 OR x > coalesce(n.n, 0)) AS invalid_citations, list_filter(range(1, coalesce(n.n, 0) + 1), lambda x: NOT list_contains(coalesce(numbers, []), x))::INT[] AS unused_sources FROM a LEFT JOIN n USING (key) LEFT JOIN own USING (key)""",
    "judged_claims": f"WITH {_JUDGED} SELECT key, claim_no, status, len(cites)::INT AS cited, len(sup)::INT AS supporting FROM jc",
    "verdict_reports": f"WITH {_JUDGED} SELECT * FROM report",
    "answer_scores": f"""WITH {_SCORED}, z AS (SELECT *, {_round('least(1.0, greatest(0.0, 0.4::DOUBLE * retrieval + 0.35::DOUBLE * citation + 0.25::DOUBLE * completeness))')} AS score FROM sd)
        SELECT message_id, retrieval, {_round('citation')} AS citation_coverage, completeness, score, CASE WHEN score >= 0.7 THEN 'high' WHEN score >= 0.45 THEN 'medium' ELSE 'low' END AS band FROM z""",
    "score_reasons": f"""WITH {_SCORED}, z AS (SELECT message_id, list_filter([
            CASE WHEN retrieval < 0.5 THEN 'Weak retrieval signal (top similarity ' || printf('%.2f', floor(coalesce(top_dense_score, 0) * 100 + 0.5) / 100) || ', keyword coverage ' || {_PERCENT.format('coalesce(keyword_coverage, 0)')} || ').' END,
            CASE WHEN mode = 'hybrid' AND (coalesce(dense_hits, 0) = 0 OR coalesce(sparse_hits, 0) = 0) THEN 'Only one retriever returned results (' || coalesce(dense_hits, 0) || ' dense, ' || coalesce(sparse_hits, 0) || ' sparse).' END,
            CASE WHEN NOT coalesce(rerank_used, false) THEN 'Reranking was skipped, so passage ordering is unfiltered.' END, CASE WHEN rerank_used AND rerank_backend = 'lexical' THEN 'LLM reranker was unavailable; lexical fallback was used.' END,
            CASE WHEN NOT verified THEN 'Citations were not verified against the sources.' END, CASE WHEN verified AND uc > 0 THEN uc || ' of ' || tc || ' claims were not supported by any retrieved source.' END, CASE WHEN verified AND mc > 0 THEN mc || ' claims cited the wrong source number.' END,
            CASE WHEN verified AND len(invalid) > 0 THEN 'Answer referenced non-existent sources: ' || array_to_string(list_transform(invalid, lambda n: '[' || n || ']'), ', ') || '.' END, CASE WHEN completeness < 0.75 THEN 'Part of the question appears unanswered.' END], lambda r: r IS NOT NULL) AS rs FROM sd)
        SELECT message_id, CASE WHEN len(rs) > 0 THEN array_to_string(rs, chr(10)) ELSE 'All claims verified against retrieved sources.' END AS reasons FROM z""",
    "abstain_texts": f"""WITH {_SCORED}, {_LISTED} SELECT sd.message_id, {_text(quality.ABSTAIN_START)} || chr(10) || chr(10) || '**Retrieval confidence** ' || {_PERCENT.format('retrieval')} || ' (threshold 35%)' || chr(10) || chr(10) || '**What I did find**' || chr(10) || CASE WHEN len({_TOPICS}) > 0 THEN {_lines(_TOPICS)} ELSE {_text(quality.NOTHING_FOUND)} END || chr(10) || chr(10) || '**What is missing**' || chr(10)
            || CASE WHEN coalesce(keyword_coverage, 0) < 0.5 THEN 'Several terms from your question do not appear anywhere in the indexed text (keyword coverage ' || {_PERCENT.format('coalesce(keyword_coverage, 0)')} || ').' ELSE {_text(quality.NOT_TIED)} END || CASE WHEN len({_FILES}) > 0 THEN chr(10) || chr(10) || '**Worth checking manually**' || chr(10) || {_lines(_FILES)} ELSE '' END || chr(10) || chr(10) || {_text(quality.ABSTAIN_END)} AS answer
        FROM sd LEFT JOIN sl ON sd.message_id = sl.message_id WHERE len(coalesce(sources, [])) = 0 OR retrieval < 0.35""",
    "prompts": f"""WITH {_PARSED}, {_LISTED}, t AS (SELECT id, content FROM ({_LATEST})) SELECT sl.message_id, 'CONTEXT' || chr(10) || array_to_string(list_transform(sources, lambda x: '[' || x.citation || '] ' || {_WHERE} || chr(10) || coalesce(x.text, '')), chr(10) || chr(10)) || chr(10) || chr(10) || 'QUESTION' || chr(10) || coalesce(content, '') || chr(10) || chr(10) || {_text(quality.PROMPT_END)} AS prompt FROM sl JOIN t ON sl.message_id = t.id""",
    "p4_found": _cited("citations"),
    "p4_supporting_sources": _cited("supported_by"),
    "p4_sources": f"WITH {_PARSED}, {_SOURCES} SELECT message_id, place AS source_no, {_fields('x', SOURCE_FIELDS)} FROM so",
    "p4_retrievers": f"WITH {_PARSED}, {_SOURCES}, re AS (SELECT message_id, place AS source_no, unnest({_array(_member('x', 'retrieved_by'))}) AS x, unnest(range(len({_array(_member('x', 'retrieved_by'))}))) AS place FROM so) SELECT message_id, source_no, place, json_extract_string(x, '$') AS retriever FROM re",
    "p4_verdicts": f"WITH {_PARSED}, {_VERDICTS} SELECT message_id, place AS verdict_no, {_fields('x', {'claim': 'string', 'status': 'string', 'reason': 'string'})} FROM ve",
    "p4_cited": f"WITH {_PARSED}, {_VERDICTS}, {_numbers('citations')} SELECT message_id, verdict_no, place, {_NUMBER} AS number FROM nu",
    "p4_supporting": f"WITH {_PARSED}, {_VERDICTS}, {_numbers('supported_by')} SELECT message_id, verdict_no, place, {_NUMBER} AS number FROM nu",
    "p4_invalid": _report("invalid_citations"),
    "p4_unused": _report("unused_sources"),
    "p4_reasons": f"WITH {_PARSED}, {_each('li', 'm', 'message_id', _array(_member('f', 'reasons')))} SELECT message_id, place, json_extract_string(x, '$') AS reason FROM li",
    "p4_statistics": _object("r", STAT_FIELDS),
    "p4_reports": _object("c", REPORT_FIELDS),
    "p4_confidences": _object("f", CONFIDENCE_FIELDS),
    "bm25_topk": f"WITH {_SCORES} SELECT query AS question_id, doc AS doc_id, rank, score, matched FROM ({_RANKED}) WHERE rank <= 10",
    "term_coverage": f"""WITH {_ASKED}, {_INDEX}, {_terms('qt', 'asked', 'id', 'question', expand=False)}, q AS (SELECT DISTINCT k, term FROM qt)
        SELECT asked.id AS question_id, count(q.term) AS n_terms, floor(coalesce(count(v.term) / nullif(count(q.term), 0), 0) * 1e6 + 0.5) / 1e6 AS coverage FROM asked LEFT JOIN q ON asked.id = q.k LEFT JOIN vocabulary v ON q.term = v.term GROUP BY 1""",
    "token_df": f"WITH {_INDEX} SELECT term, df AS doc_count FROM vocabulary",
    "index_stats": f"WITH {_INDEX} SELECT n AS docs, floor(avgdl * 1e6 + 0.5) / 1e6 AS avgdl FROM stats",
    "knn_topk": f"SELECT query, doc, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM ({_PAIRS} WHERE q.vec_id % 100 = 0)) WHERE rank <= 10",
    "knn_exclude_own": f"SELECT query, doc, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM ({_PAIRS} WHERE q.vec_id % 100 = 0 AND q.label <> e.label)) WHERE rank <= 5",
    "near_dupe_vectors": f"SELECT query, doc, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM ({_PAIRS} WHERE q.label <> e.label)) WHERE rank = 1 AND score >= 0.4",
    "vector_pad_trim": "SELECT vec_id, list_resize(embedding::DOUBLE[], 80, 0.0) AS padded, (embedding::DOUBLE[])[1:8] AS trimmed FROM embeddings",
    "rrf_fusion": f"""{_TWO}, {_FUSED.format('0.7', '0.3')} SELECT query AS question_id, doc AS doc_id, rank, {_round('f', 6)} AS fused_score, concat_ws(',', CASE WHEN dr IS NOT NULL THEN 'dense' END, CASE WHEN sr IS NOT NULL THEN 'sparse' END) AS retrieved_by FROM ranked WHERE rank <= 10""",
    "mode_overlap": f"""{_TWO}, a AS (SELECT query, count(*) AS n FROM d WHERE rank <= 10 GROUP BY 1), b AS (SELECT query, count(*) AS n FROM s WHERE rank <= 10 GROUP BY 1), c AS (SELECT d.query, count(*) AS n FROM d JOIN s ON d.query = s.query AND d.doc = s.doc WHERE d.rank <= 10 AND s.rank <= 10 GROUP BY 1), q AS (SELECT query FROM a UNION SELECT query FROM b)
        SELECT q.query AS question_id, 'dense' AS mode_a, 'sparse' AS mode_b, coalesce(c.n, 0) AS shared, floor(coalesce(c.n, 0) / (coalesce(a.n, 0) + coalesce(b.n, 0) - coalesce(c.n, 0)) * 1000 + 0.5) / 1000 AS jaccard FROM q LEFT JOIN a USING (query) LEFT JOIN b USING (query) LEFT JOIN c USING (query)""",
    "lexical_rerank": f"""WITH {_SCORES}, pool AS (SELECT query, doc, rank FROM ({_RANKED}) WHERE rank <= 20), sizes AS (SELECT query, count(*) AS p FROM pool GROUP BY 1), wide AS (SELECT query, count(*) AS q FROM qterms GROUP BY 1),
        has AS (SELECT pool.query, pool.doc, term FROM pool JOIN postings ON pool.doc = postings.doc JOIN qterms USING (query, term)), dfs AS (SELECT query, term, count(*) AS pdf FROM has GROUP BY 1, 2),
        sums AS (SELECT query, doc, sum(ln(1 + p / pdf)) AS s FROM has JOIN dfs USING (query, term) JOIN sizes USING (query) GROUP BY 1, 2),
        r AS (SELECT query, doc, rank AS prior, floor(least(1.0, coalesce(s / (q * ln(1 + p)), 0)) * 1e6 + 0.5) / 1e6 AS rerank_score FROM pool JOIN sizes USING (query) JOIN wide USING (query) LEFT JOIN sums USING (query, doc))
        SELECT query AS question_id, doc AS doc_id, row_number() OVER (PARTITION BY query ORDER BY rerank_score DESC, prior, doc) AS rank, rerank_score FROM r""",
    "hybrid_search": f"{_retrieved('hybrid', True)} SELECT * FROM found",
    "mode_comparison": " UNION ALL ".join(f"SELECT question_id, '{mode}' AS mode, least(length(text), 600) AS shown, citation, chunk_id, score, dense_score, sparse_score, rerank_score, retrieved_by FROM ({_retrieved(mode, False)} SELECT found.*, c.text FROM found JOIN c ON found.chunk_id = c.id)" for mode in ("hybrid", "dense", "sparse")),
    "retrieval_stats": f"""{_retrieved('hybrid', True)}, {_COVERAGE}, files AS (SELECT count(DISTINCT document_id) AS n FROM c), dn AS (SELECT query, count(*) AS n, max(score) AS top FROM d GROUP BY 1), sn AS (SELECT query, count(*) AS n FROM s GROUP BY 1), fn AS (SELECT query, count(*) AS n FROM fused GROUP BY 1), pn AS (SELECT query, avg(rr) AS mean, max(CASE WHEN p > 1 THEN 'lexical' ELSE 'none' END) AS backend FROM pri GROUP BY 1), en AS (SELECT question_id AS query, count(*) AS n FROM found GROUP BY 1)
        SELECT asked.id AS question_id, 'hybrid' AS mode, 0.7::DOUBLE AS dense_weight, 0.3::DOUBLE AS sparse_weight, coalesce(dn.n, 0) AS dense_hits, coalesce(sn.n, 0) AS sparse_hits, coalesce(fn.n, 0) AS fused_candidates, coalesce(backend, 'none') <> 'none' AS rerank_used, coalesce(backend, 'none') AS rerank_backend,
            {_round('greatest(0.0, coalesce(top, 0.0))')} AS top_dense_score, {_round('mean')} AS mean_rerank_score, {_round('coverage')} AS keyword_coverage, files.n AS documents_searched, coalesce(en.n, 0) AS passages_returned
        FROM asked LEFT JOIN dn ON asked.id = dn.query LEFT JOIN sn ON asked.id = sn.query LEFT JOIN fn ON asked.id = fn.query LEFT JOIN pn ON asked.id = pn.query LEFT JOIN en ON asked.id = en.query LEFT JOIN coverages ON asked.id = coverages.query, files""",
    "bm25_scoped": f"""WITH {_PASSAGES}, {_scores('c', 'id', 'told')}, cases AS (SELECT DISTINCT id, len(coalesce(expected_sources, [])) > 0 AS wants, expected_sources FROM questions), wanted AS (SELECT DISTINCT e.id AS query, d.id AS document_id FROM (SELECT id, unnest(expected_sources) AS filename FROM cases) e JOIN documents d USING (filename)),
        kept AS (SELECT s.* FROM scores s JOIN c ON s.doc = c.id JOIN cases ON cases.id = s.query WHERE NOT wants OR EXISTS (SELECT 1 FROM wanted w WHERE w.query = s.query AND w.document_id = c.document_id))
        SELECT query AS question_id, doc AS chunk_id, rank, score, matched FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM kept) WHERE rank <= 5""",
    "neighbor_expansion": """WITH c AS (SELECT DISTINCT id, document_id, page, chunk_index FROM chunks)
        SELECT chunk_id, id AS neighbour_id, place FROM (SELECT p.id AS chunk_id, c.id, row_number() OVER (PARTITION BY p.id ORDER BY c.page, c.chunk_index, c.id) AS place FROM c p JOIN c ON p.document_id = c.document_id WHERE abs(c.chunk_index - p.chunk_index) <= 2 AND c.chunk_index <> p.chunk_index) WHERE place <= 3""",
    "source_types": f"SELECT doc_id, CASE {' '.join(f'''WHEN {_EXTENSION} IN ({', '.join(repr(e) for e in endings)}) THEN '{name}' ''' for name, endings in SOURCE_TYPES.items())} END AS kind FROM documents",
    "normalized_text": f"SELECT doc_id, {_normal('text')} AS normal FROM documents",
    "fingerprints": r"""SELECT DISTINCT id, sha256(text) AS raw_hash, sha256(trim(regexp_replace(lower(text), '""" + _WHITE + r"""+', ' ', 'g'), ' ')) AS fingerprint FROM chunks WHERE text IS NOT NULL""",
    "sentence_counts": r"""WITH l AS (SELECT doc_id, regexp_replace(unnest(string_split(regexp_replace(text, '\r\n?', E'\n', 'g'), E'\n')), '^[\s\x0b]+|[\s\x0b]+$', '', 'g') AS line FROM documents),
        u AS (SELECT doc_id, CASE WHEN regexp_matches(line, '^([-*+•]|\d+[.)]|\||#{1,6}\s)') OR length(line) < 80 THEN [line] ELSE string_split(regexp_replace(line, '([.!?])[\s\x0b]+([A-Z(“"''\d])', '\1' || chr(30) || '\2', 'g'), chr(30)) END AS us FROM l WHERE line <> ''),
        e AS (SELECT doc_id, regexp_replace(unnest(us), '^[\s\x0b]+|[\s\x0b]+$', '', 'g') AS unit FROM u)
        SELECT doc_id, count(*) AS units, max(length(unit)) AS longest FROM e WHERE unit <> '' GROUP BY 1""",
    "html_text": f"SELECT doc_id, {_html('text')} AS plain FROM documents WHERE source_type = 'html' OR regexp_matches(text, '</?[A-Za-z][^>]*>')",
    "html_section_rows": rf"""WITH pages AS (SELECT doc_id, coalesce(nullif(regexp_extract(text, '<body[^>]*>(.*?)</body>', 1, 'si'), ''), text) AS body, nullif(trim(regexp_extract(text, '<title[^>]*>(.*?)</title>', 1, 'si')), '') AS title FROM documents WHERE source_type = 'html' OR regexp_matches(text, '</?[A-Za-z][^>]*>')),
        cut AS (SELECT doc_id, title, string_split(regexp_replace(body, '(<h[1-6]\b)', chr(30) || '\1', 'gi'), chr(30)) AS ps FROM pages), parts AS (SELECT doc_id, title, unnest(ps) AS p, unnest(range(len(ps))) AS n FROM cut),
        own AS (SELECT doc_id, title, n, TRY_CAST(regexp_extract(p, '<h([1-6])\b[^>]*>(.*?)</h[1-6]>', 1, 'si') AS INT) AS level, {_html("regexp_extract(p, '<h([1-6])[^>]*>(.*?)</h[1-6]>', 2, 'si')")} AS name, {_html('p')} AS text FROM parts),
        trails AS (SELECT a.doc_id, a.n, string_agg(CASE WHEN b.name <> '' THEN b.name END, ' › ' ORDER BY b.level) AS trail FROM own a JOIN own b ON a.doc_id = b.doc_id AND b.n <= a.n AND b.level <= a.level WHERE NOT EXISTS (SELECT 1 FROM own x WHERE x.doc_id = a.doc_id AND x.n > b.n AND x.n <= a.n AND x.level <= b.level) GROUP BY 1, 2)
        SELECT o.doc_id, row_number() OVER (PARTITION BY o.doc_id ORDER BY o.n)::INT AS page, CASE WHEN o.level IS NULL THEN title ELSE coalesce(trail, '') END AS heading, text FROM own o LEFT JOIN trails t ON o.doc_id = t.doc_id AND o.n = t.n WHERE text <> ''""",
    "exact_duplicates": r"""WITH c AS (SELECT DISTINCT id, guest_id, batch_no, created_at, chunk_index, trim(regexp_replace(lower(text), '""" + _WHITE + r"""+', ' ', 'g'), ' ') AS t FROM chunks WHERE text IS NOT NULL)
        SELECT id AS key, kept_key FROM (SELECT id, first_value(id) OVER (PARTITION BY guest_id, t ORDER BY batch_no NULLS FIRST, created_at NULLS FIRST, chunk_index NULLS FIRST, id) AS kept_key FROM c) WHERE id <> kept_key""",
    "duplicate_totals": r"""WITH c AS (SELECT DISTINCT id, guest_id, document_id, trim(regexp_replace(lower(text), '""" + _WHITE + r"""+', ' ', 'g'), ' ') AS t FROM chunks), d AS (SELECT *, t IS NOT NULL AND id <> min(id) OVER (PARTITION BY guest_id, t) AS dup FROM c)
        SELECT document_id, count(*) AS chunks, count(*) FILTER (dup) AS duplicates FROM d GROUP BY 1""",
    "extract_citations": rf"""WITH a AS (SELECT id, content FROM ({_LATEST}) WHERE {_ROLE} = 'assistant' AND content IS NOT NULL)
        SELECT id, array_to_string(list_sort(list_distinct(list_transform(flatten(list_transform(regexp_extract_all(content, '{_CITATION}', 1), lambda m: string_split(m, ','))), lambda n: trim(n)::INT))), ',') AS numbers, regexp_replace(regexp_replace(regexp_replace(content, '{_CITATION}', '', 'g'), '{_WHITE}{{2,}}', ' ', 'g'), '^{_WHITE}+|{_WHITE}+$', '', 'g') AS bare FROM a""",
    "confidence_scores": f"""WITH s AS ({_object('r', STAT_FIELDS)}), v AS (SELECT message_id, CASE WHEN coalesce(passages_returned, 0) = 0 AND coalesce(fused_candidates, 0) = 0 THEN 0 ELSE floor(least(1.0, greatest(0.0, CASE WHEN mean_rerank_score IS NULL AND mode = 'sparse' THEN {_K} WHEN mean_rerank_score IS NULL THEN 0.65::DOUBLE * {_D} + 0.35::DOUBLE * {_K} WHEN mode = 'sparse' THEN 0.7::DOUBLE * {_R} + 0.3::DOUBLE * {_K} ELSE 0.55::DOUBLE * {_R} + 0.3::DOUBLE * {_D} + 0.15::DOUBLE * {_K} END)) * 1000 + 0.5) / 1000 END AS retrieval FROM s)
        SELECT message_id, retrieval, retrieval < 0.35 AS abstain, CASE WHEN retrieval >= 0.7 THEN 'high' WHEN retrieval >= 0.45 THEN 'medium' ELSE 'low' END AS band FROM v""",
    "source_status": f"""WITH {_PARSED}, {_SOURCES}, {_VERDICTS}, {_numbers('citations')}, w AS (SELECT so.message_id, so.place AS source_no, max(CASE json_extract_string(ve.x, '$.status') WHEN 'unsupported' THEN 3 WHEN 'partial' THEN 2 WHEN 'supported' THEN 1 END) AS s
            FROM nu JOIN ve ON nu.message_id = ve.message_id AND nu.verdict_no = ve.place JOIN so ON nu.message_id = so.message_id AND TRY_CAST(json_extract_string(nu.x, '$') AS BIGINT) = coalesce(TRY_CAST(json_extract_string(so.x, '$.citation') AS BIGINT), so.place + 1) GROUP BY 1, 2)
        SELECT so.message_id, so.place AS source_no, CASE s WHEN 3 THEN 'unsupported' WHEN 2 THEN 'partial' WHEN 1 THEN 'supported' ELSE 'unused' END AS status FROM so LEFT JOIN w ON so.message_id = w.message_id AND so.place = w.source_no""",
    "retrieval_metrics": f"""WITH {_SCORES}, c AS (SELECT DISTINCT id, expected_sources FROM questions), p AS (SELECT query, rank, filename FROM ({_RANKED}) r JOIN documents ON r.doc = documents.doc_id WHERE rank <= 10),
        b AS (SELECT id, min(rank) AS best FROM (SELECT DISTINCT id, unnest(expected_sources) AS filename FROM c) e JOIN p ON e.id = p.query AND e.filename = p.filename GROUP BY 1)
        SELECT c.id AS question_id, CASE WHEN len(coalesce(expected_sources, [])) > 0 THEN CASE WHEN best IS NULL THEN 0 ELSE 1 END END AS hit, CASE WHEN len(coalesce(expected_sources, [])) > 0 THEN coalesce(floor(1 / best * 1e6 + 0.5) / 1e6, 0) END AS reciprocal_rank FROM c LEFT JOIN b USING (id)""",
    "must_include": "SELECT id, CASE WHEN len(must_include) > 0 THEN list_bool_and(list_transform(must_include, lambda n: contains(lower(answer), lower(n)))) END AS complete FROM (SELECT DISTINCT id, answer, must_include FROM questions)",
    "metrics_rollup": f"SELECT chunk_strategy, retrieval_mode, count(*) AS runs, {_METRICS} FROM eval_runs GROUP BY ROLLUP (chunk_strategy, retrieval_mode)",
    "strategy_comparison": """WITH l AS (UNPIVOT (SELECT chunk_strategy AS label, floor(avg(correctness) * 1000 + 0.5) / 1000 AS correctness, floor(avg(faithfulness) * 1000 + 0.5) / 1000 AS faithfulness, floor(avg(retrieval_recall) * 1000 + 0.5) / 1000 AS retrieval_recall, floor(avg(citation_accuracy) * 1000 + 0.5) / 1000 AS citation_accuracy FROM eval_runs GROUP BY 1) ON correctness, faithfulness, retrieval_recall, citation_accuracy INTO NAME metric VALUE value)
        SELECT metric, label, value, value = max(value) OVER (PARTITION BY metric) AS best FROM l""",
    "workspace_totals": "SELECT guest_id, count(*) AS documents, sum(chunk_count)::BIGINT AS chunks, sum(duplicate_chunks)::BIGINT AS duplicates FROM documents GROUP BY 1",
    "recent_chats": "SELECT id, CASE WHEN length(title) > 48 THEN title[:48] || '…' ELSE title END AS title FROM (SELECT DISTINCT id, title, updated_at FROM chats ORDER BY updated_at DESC, id LIMIT 50)",
    "chat_history": f"""WITH n AS (SELECT *, {_ROLE} AS r, row_number() OVER (PARTITION BY chat_id ORDER BY created_at DESC, id DESC) AS back FROM ({_LATEST}) WHERE chat_id IS NOT NULL)
        SELECT chat_id, back, id, r AS role, content[:2000] AS content FROM n WHERE back <= 12 AND r IN ('user', 'assistant')""",
    "chat_documents": "WITH c AS (SELECT DISTINCT id, coalesce(document_ids[1], document_id) AS document_id FROM chats) SELECT c.id, c.document_id, coalesce(filename, 'document') AS filename FROM c LEFT JOIN documents d ON c.document_id = d.id",
    "delete_cascade": """WITH g AS (SELECT id FROM documents WHERE status = 'failed') SELECT 'documents' AS table_name, count(*) AS n FROM documents WHERE id NOT IN (SELECT id FROM g)
        UNION ALL SELECT 'chunks', count(*) FROM chunks WHERE document_id IS NULL OR document_id NOT IN (SELECT id FROM g) UNION ALL SELECT 'chats with document', count(*) FROM chats WHERE document_id IS NOT NULL AND document_id NOT IN (SELECT id FROM g)""",
    "orphan_chunks": "SELECT DISTINCT document_id AS id FROM chunks WHERE document_id NOT IN (SELECT id FROM documents)",
    "rate_limit": """WITH RECURSIVE o AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
        w AS (SELECT user_id, event_id, rn, ts + INTERVAL 1 HOUR AS ends, 1 AS used, true AS allowed FROM o WHERE rn = 1
        UNION ALL SELECT o.user_id, o.event_id, o.rn, CASE WHEN o.ts >= w.ends THEN o.ts + INTERVAL 1 HOUR ELSE w.ends END, CASE WHEN o.ts >= w.ends THEN 1 WHEN w.used < 2 THEN w.used + 1 ELSE w.used END, o.ts >= w.ends OR w.used < 2 FROM w JOIN o ON o.user_id = w.user_id AND o.rn = w.rn + 1)
        SELECT user_id, event_id, allowed FROM w""",
}
