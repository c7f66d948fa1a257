"""DuckDB SQL of the registry's queries. It computes what the operators compute, from the same input texts."""

from ..operators import extraction, masking, pages, validation
from ..sources import LETTERS as _LETTERS

_WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_CLEAN = r"\x20-\x7E¡-ɏ–—’“”\n\r\t"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _in(words) -> str:
    return "(" + ", ".join(map(_q, words)) + ")"


def _re(pattern: str) -> str:
    """A pattern without Java's flag for line ends."""
    return _q(pattern.replace("(?d)", ""))


# ------------------------------------------------------------ cleaning
def _ligatures(x: str) -> str:
    for glyph, plain in {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "—": "--", "…": "..."}.items():
        x = f"replace({x}, '{glyph}', '{plain}')"
    signs = "''" * 2 + '""-** '
    return f"translate({x}, '‘’“”–•·' || chr(160) || chr(173) || chr(8203) || chr(65533), '{signs}')"


def _noise(x: str) -> str:
    bad = f"'[^{_CLEAN}]'"
    return f"""(SELECT CASE WHEN length(v) = 0 OR (length(v) - length(regexp_replace(v, {bad}, '', 'g'))) < 0.02 * length(v) THEN v ELSE
      array_to_string([regexp_replace(w, {bad}, '', 'g') FOR w IN string_split(v, ' ') IF {_strip(f"regexp_replace(w, {bad}, '', 'g')")} <> '' OR contains(w, chr(10))], ' ') END FROM (SELECT {x} AS v))"""


def _hyphens(x: str) -> str:
    return rf"regexp_replace({x}, '([\p{{L}}\p{{N}}_])-\s*\n\s*([\p{{L}}\p{{N}}_])', '\1\2', 'g')"


def _spaces(x: str) -> str:
    two = rf"regexp_replace({x}, '[ \t]{{2,}}', ' ', 'g')"
    three = rf"regexp_replace({two}, '\n{{3,}}', repeat(chr(10), 2), 'g')"
    return _strip(three)


CLEANED = f"cleaned AS (SELECT doc_id, {_spaces(_hyphens('v'))} AS text FROM (SELECT doc_id, {_noise(f'nfc_normalize({_ligatures(chr(116) + chr(101) + chr(120) + chr(116))})')} AS v FROM documents))"

# ------------------------------------------------------------ pages and regions
LETTERS = "letters AS (" + _LETTERS.format(orders="orders", customer="customer", lineitem="lineitem") + ")"
_DOC_PAGES = "pages AS (SELECT doc_id, 1 AS page_number, text FROM documents)"


def _regions(source: str) -> str:
    """lines, kept (without page artifacts) and regions of source (doc_id, page_number, text)."""
    page = "PARTITION BY doc_id, page_number"
    ends = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\\x{85}\\x{2028}\\x{2029}]"
    return rf"""
lines AS (
  SELECT doc_id, page_number, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS line_no
  FROM (SELECT doc_id, page_number, string_split_regex(regexp_replace(text, '(?:{ends})\z', ''), '{ends}') AS l FROM {source} WHERE text IS NOT NULL)
), judged AS (
  SELECT *, {_strip("line")} AS bare, max(line_no) OVER ({page}) AS last_no,
    length({_strip("line")}) < 6 OR regexp_matches({_strip("line")}, {_re(pages.PAGE_NUMBER)}) OR regexp_matches({_strip("line")}, {_re(pages.REFERENCE)}) AS junk FROM lines
), ended AS (
  SELECT *, line_no < 3 AND bool_and(junk) OVER ({page} ORDER BY line_no) AS head, last_no - line_no < 3 AND bool_and(junk) OVER ({page} ORDER BY line_no DESC) AS tail FROM judged
), kept AS (
  SELECT doc_id, page_number, row_number() OVER ({page} ORDER BY line_no) - 1 AS line_no, line, bare FROM ended WHERE NOT head AND NOT tail
), flags AS (
  SELECT *, bare = '' AS b, regexp_matches(bare, {_re(pages.HEADING)}) AND length(bare) < 80 AS h, regexp_matches(bare, {_re(pages.KEY_VALUE)}) AS k, regexp_matches(line, {_re(pages.TABLE_LINE)}) AS t FROM kept
), blocks AS (
  SELECT *, count(*) FILTER (b) OVER ({page} ORDER BY line_no) AS block FROM flags
), prose AS (
  SELECT *, NOT b AND coalesce(line_no >= min(line_no) FILTER (NOT b AND NOT h AND NOT k AND NOT t) OVER ({page}, block), false) AS p FROM blocks
), runs AS (
  SELECT *, b OR (t AND NOT p) AS open, count(*) FILTER (NOT (b OR (t AND NOT p))) OVER ({page} ORDER BY line_no) AS run FROM prose
), kinds AS (
  SELECT *, CASE WHEN open AND coalesce(line_no >= min(line_no) FILTER (open AND t AND NOT h AND NOT k AND NOT b) OVER ({page}, run), false) THEN 'table'
    WHEN b THEN NULL WHEN p THEN 'paragraph' WHEN h THEN 'heading' ELSE 'key_value' END AS kind FROM runs
), fresh AS (
  SELECT *, kind = 'heading' OR lag(kind) OVER w IS DISTINCT FROM kind OR lag(line_no) OVER w <> line_no - 1 AS new FROM kinds WHERE kind IS NOT NULL WINDOW w AS ({page} ORDER BY line_no)
), islands AS (
  SELECT *, CAST(count(*) FILTER (new) OVER ({page} ORDER BY line_no) - 1 AS INT) AS region_idx FROM fresh
), regions AS (
  SELECT doc_id, page_number, region_idx, kind AS region_type, CASE WHEN kind = 'paragraph' THEN string_agg(bare, ' ' ORDER BY line_no) ELSE string_agg(CASE WHEN kind = 'table' THEN line ELSE bare END, chr(10) ORDER BY line_no) END AS text,
    CAST(min(line_no) AS INT) AS line_start, CAST(max(line_no) AS INT) AS line_end FROM islands GROUP BY doc_id, page_number, region_idx, kind
)"""


_IN_LETTERS = f"WITH {LETTERS}, {_regions('letters')}"
_EVIDENCE = f"SELECT doc_id, page_number, region_idx, unnest(string_split(text, chr(10))) AS e FROM regions WHERE region_type = 'key_value'"
FIELDS = f"""{_IN_LETTERS}, fields AS (
  SELECT doc_id, page_number, region_idx, {_strip("split_part(e, ':', 1)")} AS field_name, {_strip("substr(e, instr(e, ':') + 1)")} AS value, CAST(0.9 AS DOUBLE) AS confidence, e AS evidence
  FROM ({_EVIDENCE}) WHERE regexp_matches(e, {_re(pages.KEY_VALUE)})
)"""
CHECKED = f"""{FIELDS}, checked AS (
  SELECT *, CASE WHEN field_name = '' THEN 'empty field name' WHEN length(field_name) < 2 THEN 'field name too short' WHEN length(field_name) > 120 THEN 'field name too long'
    WHEN regexp_matches(field_name, {_re("(?i)^(" + "|".join(validation.BOILERPLATE) + ")")}) THEN 'boilerplate field name' WHEN value = '' THEN 'empty value'
    WHEN lower(value) IN {_in(validation.NULL_VALUES)} THEN 'null-equivalent value' END AS reject,
    CASE WHEN length(value) > 500 THEN 'value is very long' WHEN lower(field_name) IN {_in(validation.GENERIC)} THEN 'generic field name' END AS flag FROM fields
), validated AS (
  SELECT *, CASE WHEN reject IS NOT NULL THEN 'rejected' WHEN flag IS NOT NULL THEN 'flagged' ELSE 'accepted' END AS validation_status, coalesce(reject, flag) AS rejection_reason FROM checked
), sure AS (
  SELECT *, lower(regexp_replace(field_name, ':+$', '')) AS name_key, trim(regexp_replace(regexp_replace(lower(value), '[^\\p{{L}}\\p{{N}}\\s]', '', 'g'), '\\s+', ' ', 'g')) AS value_key
  FROM validated WHERE validation_status <> 'rejected'
), consolidated AS (
  SELECT doc_id, name_key, arg_min(value, page_number) AS value, count(*) AS occurrence_count, count(DISTINCT value_key) > 1 AS has_conflict, min(page_number) AS first_page,
    arg_min(validation_status, page_number) AS validation_status,
    array_to_string(list_transform(string_split(name_key, ' '), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ') AS field_name FROM sure GROUP BY doc_id, name_key
)"""
_TARGETS = "VALUES " + ", ".join(f"({_q(a)}, {_q(t)})" for a, t in extraction.KNOWN_NAMES)


def _has(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, {_q(w)})" for w in words) + ")"


TARGETS = f"""{FIELDS}, known(alias, target) AS ({_TARGETS}), mapped AS (
  SELECT f.*, target, lower(value || ' ') AS said FROM fields f JOIN known ON alias = lower(field_name)
), normal AS (
  SELECT target, CASE target
    WHEN 'Pricing Method' THEN coalesce(nullif(concat_ws(', ', CASE WHEN {_has("said", extraction.FIXED_FEE)} THEN 'Fixed Fee' END,
      CASE WHEN {_has("said", extraction.TIME_MATERIALS)} THEN 'Time & Materials' || CASE WHEN {_has("said", extraction.CAPPED)} THEN ' (Capped)' ELSE '' END END,
      CASE WHEN {_has("said", extraction.MILESTONE)} THEN 'Milestone' END, CASE WHEN contains(said, 'retainer') THEN 'Retainer' END), ''), {_strip("substr(value, 1, 30)")})
    WHEN 'Payment Term' THEN CASE WHEN regexp_matches(said, '[0-9]+ business days') THEN regexp_extract(said, '([0-9]+) business days', 1) || ' Working Days' WHEN said LIKE 'thirty days%' THEN '30 Days'
      WHEN contains(said, 'upon receipt') THEN 'Upon Receipt' ELSE value END
    WHEN 'Payment Term Start Description' THEN CASE WHEN regexp_matches(said, '[0-9]+ business days of the invoice') THEN 'Within ' || regexp_extract(said, '([0-9]+)', 1) || ' Working Days of the Invoice Date'
      WHEN contains(said, 'no later than') THEN 'No Later Than ' || regexp_extract(said, '([0-9]+)', 1) || ' Days from Invoice Date' WHEN contains(said, 'from the invoice date') THEN 'From the Invoice Date'
      WHEN contains(said, 'upon receipt') THEN 'Upon Receipt of Invoice' ELSE value END
    ELSE value END AS value FROM mapped
)"""

# ------------------------------------------------------------ masking
#: Java's look-behind has no counterpart here; detectors that use it are tested by themselves.
_PLAIN = [d for d in masking.DETECTORS if "(?<=" not in d[1]]


def _digit(x: str, i: str) -> str:
    return f"CAST(substr({x}, {i}, 1) AS INT)"


_PASS = {
    "luhn": f"list_sum([CASE WHEN (length(d) - i) % 2 = 0 THEN {_digit('d', 'i')} ELSE ({_digit('d', 'i')} * 2) // 10 + ({_digit('d', 'i')} * 2) % 10 END FOR i IN range(1, length(d) + 1)]) % 10 = 0",
    "nhs": f"list_sum([{_digit('d', 'i')} * (11 - i) FOR i IN range(1, 11)]) % 11 = 0",
    "tfn": f"list_sum([{_digit('d', 'i')} * ([1, 4, 3, 7, 5, 8, 6, 9, 10])[i] FOR i IN range(1, 10)]) % 11 = 0",
    "dea": f"list_sum([{_digit('d', 'i')} * (2 - i % 2) FOR i IN range(1, 7)]) % 10 = {_digit('d', '7')}",
    "iban": "false", "verhoeff": "false",
}
_FOUND = " UNION ALL ".join(
    f"SELECT doc_id, {_q(kind)} AS entity_type, CAST({score} AS DOUBLE) AS score, {_q(test or '')} AS test, regexp_extract_all(text, {_q(pattern)}) AS f, string_split_regex(text, {_q(pattern)}) AS g FROM documents WHERE regexp_matches(text, {_q(pattern)})"
    for kind, pattern, score, test in _PLAIN
)
SPANS = f"""found AS ({_FOUND}), placed AS (
  SELECT doc_id, entity_type, score, test, unnest(f) AS value, unnest([coalesce(list_sum([length(x) FOR x IN g[1:i]]), 0) + coalesce(list_sum([length(x) FOR x IN f[1:i - 1]]), 0) FOR i IN range(1, length(f) + 1)]) AS start FROM found
), digits AS (SELECT *, regexp_replace(value, '[^0-9]', '', 'g') AS d FROM placed
), spans AS (
  SELECT doc_id, entity_type, score, value, start, start + length(value) AS stop FROM digits
  WHERE CASE test {" ".join(f"WHEN '{t}' THEN {c}" for t, c in _PASS.items())} ELSE true END
)"""
TOKENS = f"""{SPANS}, wanted AS (
  SELECT *, max(stop) OVER (PARTITION BY doc_id ORDER BY start, stop DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans WHERE entity_type IN {_in(masking.MASKED)} AND score >= {masking.MIN_SCORE}
), grouped AS (
  SELECT *, sum(CASE WHEN coalesce(reach, -1) <= start THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY start, stop DESC ROWS UNBOUNDED PRECEDING) AS island FROM wanted
), merged AS (
  SELECT doc_id, min(start) AS start, max(stop) AS stop, first(entity_type ORDER BY stop - start DESC, score DESC, start, entity_type) AS entity_type FROM grouped GROUP BY doc_id, island
), valued AS (
  SELECT m.*, {_strip("substr(text, CAST(start AS INT) + 1, CAST(stop - start AS INT))")} AS value FROM merged m JOIN documents USING (doc_id)
), firsts AS (
  SELECT doc_id, value, max(start) AS start, arg_max(entity_type, start) AS entity_type FROM valued GROUP BY ALL
), tokens AS (
  SELECT doc_id, value, '[' || entity_type || '_' || row_number() OVER (PARTITION BY doc_id, entity_type ORDER BY start DESC) || ']' AS mask_token, entity_type FROM firsts
)"""
CANDIDATES = r"""
candidates AS (
  SELECT o_custkey AS doc_id, printf('cand_%09d', o_orderkey) AS candidate_id, lower(o_orderpriority) AS name_key, lower(o_orderstatus) AS value_key, o_orderstatus AS value,
    o_orderpriority AS name, CAST(o_orderkey % 9 AS INT) AS page, (['KEEP', 'KEEP', 'MERGE', 'REJECT', 'REVIEW'])[CAST(o_orderkey % 5 AS INT) + 1] AS decision FROM orders
)
"""
_PAGE_TEXT = f"regexp_replace(lower({_strip('p.text')}), '{_WS}+', ' ', 'g')"
ORACLE_SQL = {
    "page_quality": rf"""
WITH q AS (SELECT doc_id, text, length(text) AS n, {_strip("text")} = '' AS blank,
    CAST(length(regexp_replace(text, '[\p{{Cc}}\p{{Cs}}\p{{Co}}]', '', 'g')) AS DOUBLE) / length(text) AS p,
    CAST(length(regexp_replace(text, '[^\p{{L}}\p{{N}}]', '', 'g')) AS DOUBLE) / length(text) AS a FROM documents),
r AS (SELECT *, CASE WHEN blank THEN 'empty or whitespace-only text' WHEN n < 20 THEN 'too few characters' WHEN p < 0.70 THEN 'too few printable characters'
    WHEN a < 0.40 THEN 'too few letters and digits' ELSE 'usable' END AS reason FROM q)
SELECT doc_id, reason = 'usable' AS usable, CAST(CASE WHEN blank THEN 0 ELSE n END AS INT) AS char_count, CASE WHEN blank THEN 0.0 ELSE round(p, 4) END AS printable_ratio,
    CASE WHEN blank THEN 0.0 ELSE round(a, 4) END AS alpha_ratio, reason FROM r""",
    "source_select": rf"""
WITH p AS (SELECT d.text AS native, coalesce(b.text, '') AS ocr FROM documents d LEFT JOIN benchmark b ON item_id = doc_id),
q AS (SELECT *, length(native) >= 20 AND length(regexp_replace(native, '\p{{Cc}}', '', 'g')) >= 0.70 * length(native) AND length(regexp_replace(native, '[^\p{{L}}\p{{N}}]', '', 'g')) >= 0.40 * length(native) AS ok FROM p),
r AS (SELECT CASE WHEN ok THEN 'native' WHEN {_strip("ocr")} <> '' THEN 'ocr' ELSE 'empty' END AS source_type, CASE WHEN ok THEN native WHEN {_strip("ocr")} <> '' THEN ocr ELSE '' END AS t FROM q)
SELECT source_type, count(*) AS n, CAST(sum(length(t)) AS BIGINT) AS chars FROM r GROUP BY 1""",
    "ligature_fix": f"SELECT doc_id, md5({_ligatures(_q('ﬁ“x”—…• ­') + ' || text')}) AS fixed FROM documents",
    "whitespace_norm": f"SELECT doc_id, md5({_spaces("replace(text, '.', '.  ' || repeat(chr(10), 3))")}) AS x FROM documents",
    "hyphen_repair": f"SELECT doc_id, md5({_hyphens("replace(text, 'the', 'th-' || chr(10) || ' e')")}) AS x FROM documents",
    "ocr_noise": f"SELECT doc_id, md5({_noise("replace(text, 'on', '→ ☃on')")}) AS x FROM documents",
    "unicode_nfc": "SELECT doc_id, md5(nfc_normalize(replace(text, 'e', 'e' || chr(769)))) AS x FROM documents",
    "cleaned_text": f"WITH {CLEANED} SELECT doc_id, text AS cleaned FROM cleaned",
    "est_tokens": "SELECT doc_id, CAST(greatest(1, length(text) // 4) AS INT) AS tokens FROM documents",
    "artifact_strip": f"{_IN_LETTERS} SELECT doc_id, page_number, count(*) AS n, CAST(max(line_no) AS INT) AS last FROM kept GROUP BY ALL",
    "region_islands": f"{_IN_LETTERS} SELECT * FROM regions",
    "region_counts": f"{_IN_LETTERS} SELECT region_type, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM regions GROUP BY 1",
    "document_regions": f"""WITH {CLEANED}, pages AS (SELECT doc_id, 1 AS page_number, text FROM cleaned), {_regions("pages")}
SELECT doc_id, md5(coalesce(string_agg(r.text, chr(10) ORDER BY region_idx), '')) AS plain, coalesce(bool_or(region_type = 'table'), false) AS has_table, coalesce(bool_or(region_type = 'key_value'), false) AS has_key_value
FROM pages LEFT JOIN regions r USING (doc_id) GROUP BY doc_id""",
    "page_structure": f"""{_IN_LETTERS}, s AS (SELECT l.doc_id, l.page_number, coalesce(bool_or(region_type = 'table'), false) AS t, coalesce(bool_or(region_type = 'key_value'), false) AS k
  FROM letters l LEFT JOIN regions r ON r.doc_id = l.doc_id AND r.page_number = l.page_number GROUP BY ALL)
SELECT page_number, count(*) AS pages, count(*) FILTER (k) AS with_key_values, count(*) FILTER (t) AS with_tables FROM s GROUP BY 1""",
    "kv_extract": f"{FIELDS} SELECT doc_id, page_number, field_name, value FROM fields",
    "kv_dedupe": f"""{_IN_LETTERS}, e AS (SELECT doc_id, page_number, region_idx, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (SELECT *, string_split(text, chr(10)) AS l FROM regions WHERE region_type = 'key_value')),
f AS (SELECT doc_id, page_number, x, min(struct_pack(r := region_idx, i := i)) AS spot FROM e GROUP BY ALL)
SELECT doc_id, page_number, CAST(count(*) AS INT) AS n, string_agg(x, '|' ORDER BY spot) AS lines FROM f GROUP BY ALL""",
    "heading_asof": f"""{_IN_LETTERS}, placed AS (SELECT *, page_number * 1000 + region_idx AS spot FROM regions), heads AS (SELECT doc_id, spot, text FROM placed WHERE region_type = 'heading')
SELECT p.doc_id, page_number, region_idx, h.text AS section_header FROM placed p ASOF LEFT JOIN heads h ON p.doc_id = h.doc_id AND p.spot >= h.spot""",
    "pii_spans": f"WITH {SPANS} SELECT doc_id, entity_type, value, count(*) AS n FROM spans GROUP BY ALL",
    "mask_summary": f"WITH {TOKENS} SELECT doc_id, entity_type, count(*) AS n FROM tokens GROUP BY ALL",
    "mask_tokens": f"WITH {TOKENS} SELECT doc_id, mask_token, value AS original_value FROM tokens",
    "masked_text": f"""WITH {TOKENS}, pieces AS (
  SELECT v.doc_id, start, stop, mask_token, text, substr(text, CAST(coalesce(lag(stop) OVER (PARTITION BY v.doc_id ORDER BY start), 0) AS INT) + 1, CAST(start - coalesce(lag(stop) OVER (PARTITION BY v.doc_id ORDER BY start), 0) AS INT)) AS before
  FROM valued v JOIN tokens t ON v.doc_id = t.doc_id AND v.value = t.value JOIN documents d ON d.doc_id = v.doc_id
), spliced AS (SELECT doc_id, CAST(count(*) AS INT) AS n, string_agg(before || mask_token, '' ORDER BY start) || substr(first(text), CAST(max(stop) AS INT) + 1) AS text FROM pieces GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS entities_masked, md5(coalesce(s.text, d.text)) AS masked_text FROM documents d LEFT JOIN spliced s USING (doc_id)""",
    "rehydrate_roundtrip": f"WITH {TOKENS}, n AS (SELECT doc_id, count(*) AS n FROM merged GROUP BY 1) SELECT doc_id, md5(text) AS x, coalesce(n, 0) > 0 AS is_rehydrated FROM documents LEFT JOIN n USING (doc_id)",
    "alias_map": f"{TARGETS} SELECT target, count(*) AS n FROM mapped GROUP BY 1",
    "normalised_values": f"{TARGETS} SELECT target, value, count(*) AS n FROM normal GROUP BY ALL",
    "field_parse_json": f"{FIELDS} SELECT doc_id, page_number, field_name, value, confidence, evidence FROM fields WHERE lower(value) NOT IN {_in(extraction.NO_VALUE)}",
    "fallback_trigger": f"""{FIELDS}, f AS (SELECT doc_id, page_number, region_idx, count(*) AS n FROM fields WHERE lower(value) NOT IN {_in(extraction.NO_VALUE)} GROUP BY ALL)
SELECT r.doc_id, 'seg_' || r.page_number || '_' || r.region_idx AS segment_id, CASE WHEN n IS NULL THEN region_type = 'key_value'
  ELSE region_type = 'key_value' AND n < 0.5 * length([x FOR x IN string_split(text, chr(10)) IF contains(x, ':')]) END AS fallback
FROM regions r LEFT JOIN f ON r.doc_id = f.doc_id AND r.page_number = f.page_number AND r.region_idx = f.region_idx""",
    "field_checks": f"{CHECKED} SELECT reject IS NULL AS is_valid, reject IS NULL AND flag IS NOT NULL AS should_flag, coalesce(reject, flag) AS check_reason, count(*) AS n FROM checked GROUP BY ALL",
    "grounding": f"""{FIELDS}, asked AS (SELECT doc_id, field_name, value FROM fields UNION ALL SELECT doc_id, field_name, replace(value, ' ', '  ') FROM fields WHERE contains(value, ' ')),
tried AS (SELECT a.doc_id, field_name, value, p.page_number, p.text,
  CASE WHEN contains(lower(p.text), lower(value)) THEN 1 WHEN contains({_PAGE_TEXT}, regexp_replace(lower(value), ' +', ' ', 'g')) THEN 2 END AS how FROM asked a JOIN letters p ON a.doc_id = p.doc_id),
best AS (SELECT doc_id, field_name, value, min(struct_pack(how := how, page := page_number, text := text)) FILTER (how IS NOT NULL) AS b FROM tried GROUP BY ALL)
SELECT doc_id, field_name, value, b IS NOT NULL AS is_grounded, CASE b.how WHEN 1 THEN 'exact' WHEN 2 THEN 'normalised' ELSE 'not_found' END AS match_type, CASE WHEN b IS NULL THEN 'none' WHEN b.page = 1 THEN 'segment' ELSE 'document' END AS matched_in,
  CAST(CASE b.how WHEN 1 THEN 0.0 WHEN 2 THEN 0.05 ELSE 1.0 END AS DOUBLE) AS penalty,
  CASE b.how WHEN 1 THEN {_strip("substr(b.text, greatest(1, instr(lower(b.text), lower(value)) - 10), length(value) + 10 + least(10, instr(lower(b.text), lower(value)) - 1))")} WHEN 2 THEN '[normalised match] ' || value ELSE '' END AS evidence_found FROM best""",
    "validate_status": f"{CHECKED} SELECT doc_id, page_number, field_name, validation_status, rejection_reason FROM validated",
    "validation_report": f"""{CHECKED}, c AS (SELECT field_name, count(*) AS total, count(*) FILTER (validation_status = 'accepted') AS accepted, count(*) FILTER (validation_status = 'rejected') AS rejected, count(*) FILTER (validation_status = 'flagged') AS flagged FROM validated GROUP BY 1)
SELECT *, coalesce(CAST(accepted AS DOUBLE) / nullif(accepted + rejected, 0), 0) AS precision_estimate, CAST(accepted AS DOUBLE) / total AS acceptance_rate FROM c""",
    "consolidated_fields": f"{CHECKED} SELECT doc_id, name_key, field_name, value, occurrence_count, has_conflict FROM consolidated",
    "consolidation_summary": f"{CHECKED} SELECT count(*) AS total_unique_fields, count(*) FILTER (has_conflict) AS fields_with_conflicts, CAST(0.9 AS DOUBLE) AS avg_confidence FROM consolidated",
    "flow_report": f"""{CHECKED} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY first_page, name_key) AS INT) AS place, field_name, value, occurrence_count, has_conflict, validation_status FROM consolidated""",
    "field_table": f"""{CHECKED} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY validation_status <> 'accepted', first_page, name_key) AS INT) AS place, field_name, substr(value, 1, 55) AS short_value, '▲' AS mark FROM consolidated""",
    "name_canonical": """SELECT p_partkey, trim(lower(p_name)) || ' usd amount (tax id)' AS name_key,
array_to_string(list_transform(string_split_regex(trim(p_name), '\\s+'), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ') || ' USD Amount (Tax ID)' AS display FROM part""",
    "category_hints": f"""{FIELDS} SELECT field_name, CASE field_name WHEN 'Client Name' THEN 'Parties' WHEN 'Name' THEN 'Parties' WHEN 'Payment Trigger' THEN 'Financials' WHEN 'Payment Terms' THEN 'Financials' WHEN 'Fee Type' THEN 'Financials'
  WHEN 'Order Key' THEN 'Identifiers' ELSE '' END AS hint, count(*) AS n FROM fields GROUP BY ALL""",
    "tier_collapse": f"WITH {CANDIDATES} SELECT doc_id, trim(regexp_replace(name_key, ':+$', '')) AS name_key, value_key, min(candidate_id) AS candidate_id, count(*) AS n, array_to_string(list_sort(list_distinct(list(page))), ',') AS page_numbers FROM candidates GROUP BY 1, 2, 3",
    "tier_audit": f"WITH {CANDIDATES}, k AS (SELECT min(candidate_id) AS c FROM candidates GROUP BY doc_id, name_key, value_key) SELECT CASE WHEN c IS NULL THEN 'COLLAPSED' ELSE 'RETAINED_AS_PRIMARY' END AS action, count(*) AS n FROM candidates LEFT JOIN k ON candidate_id = c GROUP BY 1",
    "tier_decisions": f"""WITH {CANDIDATES} SELECT doc_id, count(*) FILTER (decision = 'KEEP') AS "KEEP", count(*) FILTER (decision = 'MERGE') AS "MERGE", count(*) FILTER (decision = 'REJECT') AS "REJECT", count(*) FILTER (decision = 'REVIEW') AS "REVIEW" FROM candidates GROUP BY 1""",
    "tier_canonical": f"""WITH {CANDIDATES}, kept AS (SELECT doc_id, min(candidate_id) AS target FROM candidates WHERE decision = 'KEEP' GROUP BY 1),
rows AS (SELECT doc_id, candidate_id, name, value, page FROM candidates WHERE decision = 'KEEP' UNION ALL SELECT c.doc_id, c.candidate_id, t.name, c.value, c.page FROM candidates c JOIN kept USING (doc_id) JOIN candidates t ON t.candidate_id = target WHERE c.decision = 'MERGE')
SELECT doc_id, name AS canonical_field_name, arg_min(value, candidate_id) AS value, CASE WHEN count(DISTINCT value) > 1 THEN 'conflicting_flagged' ELSE 'consolidated' END AS status,
string_agg(candidate_id, ',' ORDER BY candidate_id) AS sources, array_to_string(list_sort(list_distinct(list(page))), ',') AS pages FROM rows GROUP BY 1, 2""",
    "fee_names": "SELECT 'Fee_Amount_USD_' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS canonical_field_name, count(*) AS n FROM orders GROUP BY 1",
    "ui_filter": f"{CHECKED} SELECT doc_id, field_name, substr(value, 1, 55) AS short_value, 'high' AS band, 'accepted' AS live FROM consolidated WHERE contains(lower(field_name), 'fee') OR contains(lower(value), 'fee')",
    "event_windows": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
}
