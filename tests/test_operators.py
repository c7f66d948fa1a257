import os
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from folioflow import sources
from folioflow import streaming
from folioflow.functions import text as T
from folioflow.operators import consolidation, extraction, flow, masking, pages, segments, validation
from folioflow.plans import registry

SF = "/root/testdata/sf0.001"


def page(spark, text, doc=1, number=1):
    return spark.createDataFrame([(doc, number, text)], "doc_id bigint, page_number int, text string")


def test_registry_has_sql_for_most():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
    assert len(registry.ORACLE_SQL) > 30


@pytest.mark.skipif(not os.path.exists(SF), reason="no test tables")
def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def states(lines):
    """Regions by a plain state machine."""
    import re

    kv = re.compile(r"^[A-Z][A-Za-z0-9 /\-()]{1,60}\s*:\s*.+$")
    tab = re.compile(r"^.+(\t+|\s{3,}).+$")
    head = re.compile(r"^([A-Z][A-Z\s\-/]{3,60}|[A-Z][a-z]+(\s+[A-Z][a-z]+){1,8})$")
    out, i = [], 0
    while i < len(lines):
        bare = lines[i].strip()
        start = i
        if not bare:
            i += 1
        elif head.match(bare):
            out.append(("heading", bare, i, i))
            i += 1
        elif kv.match(bare):
            while i < len(lines) and lines[i].strip() and kv.match(lines[i].strip()) and not head.match(lines[i].strip()):
                i += 1
            out.append(("key_value", "\n".join(x.strip() for x in lines[start:i]), start, i - 1))
        elif tab.match(lines[i]):
            while i < len(lines) and (not lines[i].strip() or tab.match(lines[i])):
                i += 1
            out.append(("table", "\n".join(lines[start:i]), start, i - 1))
        else:
            while i < len(lines) and lines[i].strip():
                i += 1
            out.append(("paragraph", " ".join(x.strip() for x in lines[start:i]), start, i - 1))
    return out


def test_regions_equal_state_machine(spark):
    rng = random.Random(5)
    kinds = ["", "TOTAL DUE", "Fee Type: flat", "a\tb", "some plain words here", "  ", "Net Terms: 3\t4"]
    docs = {d: [rng.choice(kinds) for _ in range(rng.randint(1, 12))] for d in range(150)}
    rows = spark.createDataFrame([(d, 1, i, x) for d, xs in docs.items() for i, x in enumerate(xs)], "doc_id bigint, page_number int, line_no int, line string")
    got = {}
    for r in pages.regions(rows).orderBy("doc_id", "region_idx").collect():
        got.setdefault(r.doc_id, []).append((r.region_type, r.text, r.line_start, r.line_end))
    for d, xs in docs.items():
        assert got.get(d, []) == states(xs), xs


def test_mask_and_back(spark):
    text = "Write to ann@example.org or bo@example.org, again ann@example.org; card 4111 1111 1111 1111."
    p = page(spark, text)
    tokens = masking.assign_tokens(masking.maskable(masking.detect(p)))
    masked = masking.masked_pages(p, tokens)
    row = masked.first()
    assert "example.org" not in row.masked_text and "4111" not in row.masked_text and row.entities_masked == 4
    assert "[EMAIL_ADDRESS_1]" in row.masked_text and "[EMAIL_ADDRESS_2]" in row.masked_text
    back = masking.rehydrated(masked.select("doc_id", "masked_text"), masking.mask_entries(tokens), "masked_text")
    assert back.first().masked_text == text


def test_segments_keep_budget():
    regions = [(1, "paragraph", f"Field {i}: value {'x' * 40}") for i in range(200)]
    made = segments.fold(regions, segments.Budget(500, 10))
    assert len(made) > 1 and all(s["estimated_tokens"] <= 600 for s in made)
    table = segments.fold([(1, "heading", "FEES"), (1, "table", "a\tb")], segments.Budget())
    assert table[0]["is_table"] and table[0]["section_header"] == "FEES"


def test_fields_checks_and_grounding(spark):
    p = page(spark, "ORDER NOTE\n\nFee Type: flat fee\nPayment Terms: thirty days\nPage 3: x\n\nplain words end here")
    fields = extraction.extract_by_rule(pages.regions(pages.lines(p)))
    done = validation.validate(fields, p)
    status = {r.field_name: r.validation_status for r in done.collect()}
    assert status == {"Fee Type": "accepted", "Payment Terms": "accepted", "Page 3": "rejected"}
    mapped = extraction.normalize_values(extraction.map_targets(fields))
    assert {r.target: r.value for r in mapped.collect()} == {"Pricing Method": "Fixed Fee", "Payment Term": "30 Days"}
    assert consolidation.consolidate(done).count() == 2


def test_letters_read(spark):
    if os.path.exists(SF):
        assert {r.page_number: r.n for r in sources.letters(spark, SF).groupBy("page_number").agg(F.count("*").alias("n")).collect()}.keys() == {1, 2, 3}


def test_page_numbers_need_their_total_and_blank_last_lines_stay(spark):
    text = "Page 7\nbody of the page\na second line\nmore words here\nlast words here\nPage 3 of 9\n\n"
    rows = pages.lines(page(spark, text))
    assert rows.count() == 7
    kept = [r.line for r in pages.strip_artifacts(rows).orderBy("line_no").collect()]
    assert kept == ["Page 7", "body of the page", "a second line", "more words here", "last words here"]


def plain_segments(regions, budget):
    """Segments by keeping the joined text and measuring it anew each time."""
    out, text, kinds, seen, header = [], "", [], [], ""

    def flush():
        nonlocal text, kinds, seen
        if text and max(1, len(text) // 4) >= budget.min_tokens:
            out.append((text, seen, kinds, header, False))
            text, kinds, seen = "", [], []

    for number, kind, body in regions:
        if not (body or "").strip():
            continue
        if kind == "heading":
            flush()
            header = body
            continue
        if kind == "table":
            flush()
            out.append((body, [number], ["table"], header, True))
            continue
        parts = [x.strip() for x in body.splitlines() if x.strip()] if max(1, len(body) // 4) >= budget.max_tokens else [body]
        for part in parts:
            text = text + "\n\n" + part if text else part
            kinds = kinds if kind in kinds else [*kinds, kind]
            seen = seen if number in seen else [*seen, number]
            if max(1, len(text) // 4) >= budget.max_tokens:
                flush()
    flush()
    return out


@pytest.mark.parametrize("key", ["bigint", "string"])
def test_segments_equal_plain_fold(spark, key):
    rng = random.Random(8)
    kinds = ["heading", "table", "key_value", "paragraph"]
    budget = segments.Budget(60, 10)
    docs = {d: [(1 + i // 4, rng.choice(kinds), rng.choice([None, " ", "x" * rng.randint(1, 90), "line one\n  line two  \n\n" * 12])) for i in range(rng.randint(1, 14))] for d in range(60)}
    docs[99] = [(1, "paragraph", "a" * 400), (2, "paragraph", "b" * 400)]
    rows = spark.createDataFrame([(d, n, i, k, t) for d, xs in docs.items() for i, (n, k, t) in enumerate(xs)], "d int, page_number int, region_idx int, region_type string, text string")
    rows = rows.withColumn("doc_id", F.col("d").cast(key)).drop("d")
    got = {}
    for r in segments.segment(rows, budget).orderBy("doc_id", "segment_id").collect():
        got.setdefault(int(r.doc_id), []).append((r.text, r.page_numbers, r.region_types, r.section_header, r.is_table))
    for d, xs in docs.items():
        assert got.get(d, []) == plain_segments(xs, budget)
    two = segments.fold(docs[99], segments.Budget())
    assert len(two) == 1 and two[0]["page_numbers"] == [1, 2]


def test_overlapping_spans_leave_nothing_in_clear(spark):
    text = "0123456789abcdefghijklmnopqrstuvwxyz"
    spans = [("PERSON", 0, 10), ("LOCATION", 9, 12), ("PHONE_NUMBER", 11, 30), ("PERSON", 32, 34)]
    rows = spark.createDataFrame([(1, 1, k, text[a:b], 0.9, a, b) for k, a, b in spans], "doc_id bigint, page_number int, entity_type string, value string, score double, start int, end int")
    tokens = masking.assign_tokens(masking.maskable(rows))
    p = page(spark, text)
    masked = masking.masked_pages(p, tokens)
    assert masked.first().masked_text == "[PHONE_NUMBER_1]uv[PERSON_1]yz"
    entries = masking.mask_entries(tokens)
    assert masking.rehydrated(masked, entries, "masked_text").first().masked_text == text
    # numbering goes on from known entries, and known values keep their tokens
    more = spark.createDataFrame([(1, 2, "PERSON", "wx", 0.9, 5, 7), (1, 2, "PERSON", " new ", 0.9, 9, 14)], rows.schema)
    got = {r.original_value: r.mask_token for r in masking.assign_tokens(more, entries).collect()}
    assert got == {"wx": "[PERSON_1]", "new": "[PERSON_2]"}


def test_detectors_and_their_checks(spark):
    good = {
        "US_SSN": "123-45-6789", "US_ITIN": "912-70-1234", "PHONE_NUMBER": "(212) 555-0188", "IBAN_CODE": "GB82 WEST 1234 5698 7654 32", "UK_NHS": "943 476 5919", "AU_TFN": "123 456 782",
        "IN_PAN": "ABCPE1234F", "IN_AADHAAR": "2341 2341 2346", "US_PASSPORT": "A12345678", "US_BANK_NUMBER": "12345678901", "US_DRIVER_LICENSE": "D1234567", "MEDICAL_LICENSE": "AB1234563",
        "PERSON": "Dr. Ann Smith", "ORGANIZATION": "Acme Steel Ltd", "LOCATION": "Austin, TX 78701", "CREDIT_CARD": "4111 1111 1111 1111", "EMAIL_ADDRESS": "a@b.org",
    }
    lead = {"US_PASSPORT": "passport number: ", "US_BANK_NUMBER": "account no. ", "US_DRIVER_LICENSE": "driver license "}
    rows = [(i, 1, f"see {lead.get(k, '')}{v} here") for i, (k, v) in enumerate(good.items())]
    bad = ["GB82 WEST 1234 5698 7654 33", "943 476 5918", "123 456 783", "2341 2341 2345", "AB1234564", "4111 1111 1111 1112"]
    rows += [(100 + i, 1, f"see {v} here") for i, v in enumerate(bad)]
    found = {}
    for r in masking.detect(spark.createDataFrame(rows, "doc_id bigint, page_number int, text string")).collect():
        text = rows[r.doc_id if r.doc_id < 100 else len(good) + r.doc_id - 100][2]
        assert text[r.start : r.end] == r.value
        found.setdefault(r.doc_id, {})[r.entity_type] = r.value
    for i, (k, v) in enumerate(good.items()):
        assert found[i].get(k) == v, k
    for i, k in enumerate(["IBAN_CODE", "UK_NHS", "AU_TFN", "IN_AADHAAR", "MEDICAL_LICENSE", "CREDIT_CARD"]):
        assert k not in found.get(100 + i, {})


def test_rehydration_is_one_pass_and_reaches_nested_values(spark):
    entries = spark.createDataFrame([(1, "[A_1]", "see [B_1]"), (1, "[B_1]", "secret")], "doc_id bigint, mask_token string, original_value string")
    rows = spark.createDataFrame([(1, "[A_1] and [C_9]", ["[B_1]", None], {"k": "[B_1]"}, ("x[B_1]", 3)), (2, "[A_1]", [], {}, None)], "doc_id bigint, s string, a array<string>, m map<string,string>, t struct<u:string,n:int>")
    got = {r.doc_id: r for r in masking.rehydrated(rows, entries, "s", "a", "m", "t").collect()}
    assert got[1].s == "see [B_1] and [C_9]" and got[1].a == ["secret", None] and got[1].m == {"k": "secret"} and got[1].t.u == "xsecret" and got[1].is_rehydrated
    assert got[2].s == "[A_1]" and not got[2].is_rehydrated


def test_masks_are_saved_for_the_owner_alone(spark, tmp_path):
    entries = masking.mask_entries(masking.assign_tokens(masking.maskable(masking.detect(page(spark, "a@b.org, c@d.org")))))
    sources.write_masks(entries, str(tmp_path / "masks"))
    assert os.stat(tmp_path / "masks").st_mode & 0o077 == 0
    back = sources.read_masks(spark, str(tmp_path / "masks"))
    assert sorted(map(str, back.select(*entries.columns).collect())) == sorted(map(str, entries.collect()))
    assert masking.counters(back).first().given == 2


def test_grounding_finds_the_best_attempt(spark):
    p = spark.createDataFrame([(1, 1, "Fee is USD  500 at the Caf\u00e9 bill"), (1, 2, "Due on 1 May 2020"), (2, 1, None)], "doc_id bigint, page_number int, text string")
    cases = [
        (1, 1, "usd  500", "exact", "segment", 0.0), (1, 1, "USD 500", "normalised", "segment", 0.05), (1, 1, "1 may 2020", "exact", "document", 0.0),
        (1, 1, "Cafe\u0301 bill", "normalised", "segment", 0.05), (1, 2, "nowhere", "not_found", "none", 1.0), (2, 1, "x", "not_found", "none", 1.0), (1, 9, "1 May", "exact", "document", 0.0),
    ]
    rows = spark.createDataFrame([c[:3] for c in cases], "doc_id bigint, page_number int, value string")
    got = {(r.doc_id, r.page_number, r.value): r.grounding for r in validation.grounded(rows, p).collect()}
    assert len(got) == len(cases)
    for *key, kind, where, cost in cases:
        g = got[tuple(key)]
        assert (g.match_type, g.matched_in, g.penalty) == (kind, where, cost), key
    assert "Due on 1 May" in got[(1, 1, "1 may 2020")].evidence_found


def test_answers_are_retried_salvaged_and_passed_on():
    seen, naps = [], []

    def ask(model, kind, prompt):
        seen.append(model)
        if model == "a":
            raise extraction.Refused("401")
        if seen.count("b") < 3:
            raise TimeoutError("slow")
        return 'Here: {"fields": []} done', 7, 3

    got = extraction.answered(ask, "table", "x", extraction.Calls(("a", "b"), backoff=1.0), naps.append)
    assert got == {"response": '{"fields": []}', "model_used": "b", "prompt_tokens": 7, "completion_tokens": 3, "error": None}
    assert seen == ["a", "b", "b", "b"] and naps == [1.0, 2.0]
    lost = extraction.answered(lambda *a: ("no json", 1, 1), "table", "x", extraction.Calls(("a",), attempts=2), naps.append)
    assert lost["response"] is None and lost["error"].startswith("ValueError") and lost["prompt_tokens"] == 0


def test_payment_labels(spark):
    terms = {"within 30 business days": "30 Working Days", "thirty days": "30 Days", "on receipt": "Upon Receipt", "twenty days": "twenty days", " see annex ": "see annex", "": ""}
    starts = {
        "Within ten business days of the invoice": "Within 10 Working Days of the Invoice Date", "no later than 30 days from invoice": "No Later Than 30 Days from Invoice Date",
        "from the invoice date": "From the Invoice Date", "upon receipt": "Upon Receipt of Invoice", "some business days after the invoice": "Within Working Days of the Invoice Date", "annex": "annex",
    }
    for want, rule in ((terms, extraction.payment_term), (starts, extraction.payment_start)):
        rows = spark.createDataFrame([(k,) for k in want], "v string").select("v", rule(F.col("v"), F.lit("")).alias("x"))
        assert {r.v: r.x for r in rows.collect()} == want


def test_flow_masks_before_asking_and_restores_after(spark):
    text = "SERVICE LETTER\n\nContact Mail: ann@example.org\nFee Type: flat fee\nPayment Terms: thirty days\nUnclear Value: TBD\n\n" + "plain words that fill the page, " * 8
    rows = spark.createDataFrame([("a", 1, text, ""), ("a", 2, "", "scanned words of a second page that say nothing"), ("b", 1, "tiny", "")], "doc_id string, page_number int, native_text string, ocr_text string")
    asked = []

    def ask(model, kind, prompt):
        assert "example.org" not in prompt
        return extraction.labelled_lines(model, kind, prompt)

    out = flow.run(rows, ask, keep=sources.kept)
    fields = {r.field_name: (r.value, r.validation_status, r.is_rehydrated) for r in out.fields.collect()}
    assert fields["Contact Mail"] == ("ann@example.org", "accepted", True) and fields["Fee Type"][:2] == ("flat fee", "accepted") and fields["Unclear Value"][1] == "rejected"
    assert [r["Field Name"] for r in out.sheets["Extracted Fields"].orderBy("#").collect()] == ["Contact Mail", "Fee Type", "Payment Terms"]
    total = out.sheets["Extraction Summary"].first()
    assert total.doc_id == "a" and total.segments_processed >= 1 and total.cost_usd >= 0 and total.rejected == 1
    assert out.sheets["Rejected Fields"].count() == 1 and not asked


def test_fallback_replaces_fields(spark):
    segs = spark.createDataFrame([(1, "seg_001", "A Fee: 1\nB Fee: 2\nC Fee: 3", [1], "", True, False, False), (1, "seg_002", "short", [1], "", False, False, False)],
        "doc_id bigint, segment_id string, text string, page_numbers array<int>, section_header string, is_key_value_block boolean, is_table boolean, is_mixed boolean")

    def ask(model, kind, prompt):
        return ('{"fields": [{"field": "A Fee", "value": "1"}, {"field": "B Fee", "value": "2"}]}' if kind == "fallback" else '{"fields": [{"field": "Z Fee", "value": "9"}]}'), 10, 5

    results, fields = extraction.extract_document(segments.prompts(segs), ask, keep=sources.kept)
    assert sorted((r.field_name, r.source_type) for r in fields.collect()) == [("A Fee", "fallback"), ("B Fee", "fallback")]
    got = {r.segment_id: r for r in results.collect()}
    assert got["seg_001"].prompt_tokens == 20 and got["seg_001"].field_count == 2 and got["seg_001"].source_type == "fallback" and got["seg_002"].skipped


def test_files_are_read_and_streamed(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "B file.PDF").write_bytes(b"first page\fsecond page")
    (tmp_path / "in" / "z.pdf").write_bytes(b"only page")
    (tmp_path / "in" / "no.txt").write_bytes(b"x")

    def broken(image):
        raise RuntimeError("unreadable")

    got = sources.read_files(spark, str(tmp_path / "in"), lambda c: [(t, b"img") for t, _ in sources.plain_text(c)], broken).orderBy("doc_id", "page_number").collect()
    assert [(r.doc_id, r.page_number, r.native_text, r.ocr_text) for r in got] == [("B file", 1, "first page", ""), ("B file", 2, "second page", ""), ("z", 1, "only page", "")]
    assert sources.first_file(spark, str(tmp_path / "in")).first().path.endswith("z.pdf")
    stream = streaming.arriving_files(spark, str(tmp_path / "in"))
    for _ in range(2):  # a second run finds nothing new
        streaming.run_batches(stream, lambda b: b.select(F.length("content").alias("n")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert sorted(r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [9, 22]


def test_blanks_are_those_of_python(spark):
    texts = ["\x1c a b \x1f", " x　\n", " \t\x0b\x85\xa0 ", "", "​y", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.strip(F.col("t"))).collect()]
    assert got == [t if t is None else t.strip() for t in texts]
    marked = spark.createDataFrame([("é plain",), ("plain",), (None,)], "t string").select(T.clean(F.col("t"))).collect()
    assert [r[0] for r in marked] == ["\xe9 plain", "plain", None]


def test_grounding_makes_the_fields_once(spark):
    """Fields are asked for by one plan, so that their numbers agree between both searches."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    rows = [(1, 1, "Here"), (1, 1, "there"), (1, 2, "nowhere"), (2, 1, "there"), (None, 1, "x")]
    fields = spark.createDataFrame(rows, "doc_id bigint, page_number int, value string").mapInPandas(counted, "doc_id bigint, page_number int, value string")
    pages_ = spark.createDataFrame([(1, 1, "it is here"), (1, 2, "and There"), (2, 1, "none")], "doc_id bigint, page_number int, text string")
    got = {(r.doc_id, r.value): (r.grounding.match_type, r.grounding.matched_in) for r in validation.grounded(fields, pages_).collect()}
    assert got == {(1, "Here"): ("exact", "segment"), (1, "there"): ("exact", "document"), (1, "nowhere"): ("not_found", "none"), (2, "there"): ("not_found", "none"), (None, "x"): ("not_found", "none")}
    assert seen.value == len(rows)


def test_small_letters_are_dealt_to_all_cores(spark):
    assert "RoundRobinPartitioning" in sources.letters(spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_cost_is_told_without_checking_fields(spark, monkeypatch):
    def checked(*args):
        raise AssertionError("fields are checked")

    monkeypatch.setattr(validation, "validate", checked)
    (row,) = registry.QUERIES["cost_summary"](spark, SF).collect()
    assert row.segments_processed > 0 and row.errors == 0 and row.models_used == "default"


def test_structure_is_made_only_where_pages_are_read(spark):
    rows = spark.createDataFrame([("a", 1, "Client Name: Ann Example\nFee Type: flat fee\n\nsome words that go on for a while", "")], sources.PAGES)
    kept = []
    out = flow.run(rows, budget=segments.Budget(min_tokens=1), keep=lambda df: kept.append(df.columns) or df)
    assert not any("plain_text" in columns for columns in kept)
    page = out.pages.first()
    assert page.has_key_value and not page.has_table and page.body == page.plain_text and page.body.startswith("Client Name: Ann Example")
    assert flow.prepare(rows)[0].columns == out.pages.columns


def test_noise_and_detectors_skip_only_what_cannot_match(spark):
    texts = ["", "plain", "é–’ \n\t", "☃", "a☃b → c", "x" * 49 + "☃", "x" * 50 + "☃", "☃ \n ☃", "\x0b\x7f ok", "𝔘 ab", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    whole = F.coalesce(F.regexp_count("t", F.lit(f"[^{T.CLEAN_CLASS}]")) < 0.02 * F.length("t"), F.lit(True)) | (F.length("t") == 0)
    got = rows.select("t", T.remove_noise(F.col("t")).alias("now"), whole.alias("same")).collect()
    assert [r.now == r.t for r in got] == [r.same for r in got]
    text = "Passport No. A12345678, passport: 123456789; Account number 12345678 account 99; driver's license K1234567, a.b@c.org"
    pages_ = spark.createDataFrame([(1, 1, text), (2, 1, "nothing"), (3, 1, None)], "doc_id int, page_number int, text string")
    found = {(r.entity_type, r.value, r.start) for r in masking.detect(pages_).collect()}
    values = {"US_PASSPORT": ["A12345678", "123456789"], "US_BANK_NUMBER": ["12345678"], "US_DRIVER_LICENSE": ["K1234567"], "EMAIL_ADDRESS": ["a.b@c.org"]}
    assert {f for f in found if f[0] in values} == {(k, v, text.rindex(f" {v}") + 1) for k, some in values.items() for v in some}
    assert "contains" in masking.detect(pages_)._jdf.queryExecution().analyzed().toString().lower()


def test_regions_of_pages_need_no_shuffle_and_equal_those_of_lines(spark):
    rng = random.Random(3)
    some = [
        "ORDER CONFIRMATION", "Items And Prices", "Key: v", "Fee Basis: x y", "1\t2\tA", "a   b   c", "plain words here", "", "   ", "Page 1 of 2", "- 3 -", "12", "AB12-CD", "\u00c4\u00d6: \u00e9",
        "\u3000wide\u3000", "Name : a : b", "  Key Two: 5  ", "\x1fodd\x1f", "PAGE 7 OF 9", "tab\there", "Ends with colon:", "\xa0Key: nb\xa0", "line\u017f: x",
    ]
    ends = ["\n", "\n", "\r\n", "\r", "\x0b", "\x85", "\u2028", "\x1c", "\n\n"]
    texts = ["".join(rng.choice(some) + rng.choice(ends) for _ in range(rng.randint(0, 14))) + rng.choice(["", rng.choice(some)]) for _ in range(600)]
    rows = [(i // 3, i % 3, x) for i, x in enumerate([*texts, None, "", "\n", "\r\n\r\n"])]
    pages_ = spark.createDataFrame(rows, "doc_id bigint, page_number int, text string")
    made, want = pages.page_regions(pages_), pages.regions(pages.strip_artifacts(pages.lines(pages_)))
    assert made.dtypes == want.dtypes and "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, made.collect())) == sorted(map(str, want.collect()))
    whole = pages.page_regions(pages_, whole=True).select("doc_id", "page_number", "region_idx", "region_type", "text")
    assert sorted(map(str, whole.collect())) == sorted(map(str, segments.whole_pages(pages_.where("length(text) > 0"), want).collect()))


def test_texts_are_searched_for_what_they_may_hold_alone(spark):
    rows = ["Dr Ann Lee of Acme Ltd lives in Old Town, NY 12345", "call 212-555-0187 or (212) 555 0187", "078-05-1120 and 943 476 5919", "nothing 12 of 345678", None, ""]
    pages_ = spark.createDataFrame([(i, 1, x) for i, x in enumerate(rows)], "doc_id bigint, page_number int, text string")
    found = sorted(map(str, masking.detect(pages_).collect()))
    plan = masking.detect(pages_)._jdf.queryExecution().analyzed().toString()
    assert masking.APART in plan and "GmbH)" in plan.replace("|", ")")
    old, masking.HELD = masking.HELD, {}
    try:
        assert found == sorted(map(str, masking.detect(pages_).collect())) and {"PERSON", "ORGANIZATION", "LOCATION", "PHONE_NUMBER", "US_SSN", "UK_NHS"} <= {x.split("'")[1] for x in found}
    finally:
        masking.HELD = old


def test_cost_needs_no_count_of_fields(spark):
    row = registry.QUERIES["cost_summary"](spark, SF)
    assert "field_count" not in row._jdf.queryExecution().analyzed().toString()
    rows = [(1, 1, "Client Name: Ann Example\nPayment Terms: thirty days\nFee Type: hourly rates", ""), (1, 2, "too short", ""), (2, 1, "", "plain words of a letter without any field")]
    pages_ = spark.createDataFrame(rows, "doc_id bigint, page_number int, native_text string, ocr_text string")
    budget = segments.Budget(min_tokens=1)
    *_, results, _ = flow.asked(pages_, budget=budget)
    assert "field_count" in results.columns and flow.usage(pages_, budget=budget).collect() == extraction.usage(results).collect()
