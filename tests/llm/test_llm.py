import html
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folioflow.llm import ann, bpe, chat, common, mainpage, neardup, packing, passages, quality, queries, toxicity, urls

DOCS = "doc_id bigint, text string"
RNG = random.Random(3)
VOCABULARY = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randint(1, 6))) for _ in range(400)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Texts with copies, near copies, shared passages, empty, null and long ones."""
    rng = random.Random(9)
    texts = [prose(rng.randint(5, 150), rng) for _ in range(60)]
    for i in range(40):
        words = texts[i % 20].split()
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = rng.choice(VOCABULARY)
        texts.append(" ".join(words))
    passage = prose(70, rng)
    texts += [prose(40, rng) + " " + passage + " " + prose(40, rng) for _ in range(4)]
    texts += ["", "  \n\t", "One", "one", None, "a\u00a0b C", prose(20000, rng)]
    return list(enumerate(texts))


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_near_duplicates_equal_brute_force(spark, corpus):
    sets = {}
    for i, t in corpus:
        w = words_of(lowered(t))
        sets[i] = {tuple(w[k : k + 2]) for k in range(len(w) - 1)} if len(w) > 1 else ({tuple(w)} if w else set())
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and label[a] != label[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    got = {r.doc_id: r for r in neardup.near_duplicates(spark.createDataFrame(corpus, DOCS), neardup.NearDup(shingle=2)).collect()}
    for i, t in corpus:
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(sets[i]), label[i], label[i] == i)


def test_near_duplicates_of_odd_tables(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    text = "one two three four five six"
    rows = [(1, text), (1, text), (None, text), (2, text), (2, "other words stand here now"), (3, "other words stand here now")]
    got = [tuple(r) for r in neardup.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()]
    assert len(got) == 6 and {c for d, _, c, _ in got if d} == {1} and [c for d, _, c, _ in got if d is None] == [None]
    clash = spark.createDataFrame([(1, text, 7, "d"), (2, text, 8, "d")], "doc_id bigint, text string, n bigint, digest string")
    assert [r.doc_id for r in neardup.keep_one(clash).collect()] == [1]


def test_passages_are_found(spark, corpus):
    rows = [r for r in passages.shared_passages(spark.createDataFrame(corpus, DOCS)).collect()]
    texts = dict(corpus)
    spans = {}
    for r in rows:
        spans.setdefault(r.doc_id, []).append((r.start_word, r.end_word))
        assert r.source_id < r.doc_id and r.n_words >= 50
        assert len(texts[r.doc_id].encode()[r.start_byte : r.end_byte].split()) == r.n_words
    first = {}
    for i, t in corpus:  # every run of 60 words that an earlier text has is covered but for its edges
        w = words_of(lowered(t))
        for k in range(len(w) - 59):
            g = tuple(w[k : k + 60])
            if first.setdefault(g, i) < i:
                assert any(a <= k + 2 and k + 58 <= b for a, b in spans.get(i, [])), (i, k)
    assert passages.shared_passages(spark.createDataFrame([], DOCS)).count() == 0
    left = passages.cut_passages(spark.createDataFrame(corpus, DOCS))
    assert passages.shared_passages(left).count() == 0


def fresh(n, rng):
    """Words that no other text has."""
    return [f"w{rng.getrandbits(60):x}" for _ in range(n)]


def test_poor_tails_shorten_passages(spark):
    rng = random.Random(21)
    rows, want = [], {}
    for n, far, phrase in [(55, 20, 3), (55, 24, 3), (70, 19, 3), (55, 16, 6), (120, 20, 3)]:
        for behind in (False, True):
            passage, common = fresh(n, rng), fresh(phrase, rng)
            for side in range(2):
                line = [common, fresh(far, rng), passage] if behind else [passage, fresh(far, rng), common]
                rows.append((len(rows), " ".join(sum([fresh(30, rng), *line, fresh(30, rng)], []))))
            want[len(rows) - 1] = (30 + (phrase + far) * behind, 30 + (phrase + far) * behind + n)
    got = {r.doc_id: (r.start_word, r.end_word) for r in passages.shared_passages(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == want


def test_passages_of_parts_from_different_documents_are_found(spark):
    """Each part alone stands in an earlier document, and again between the two that share the whole."""
    rng = random.Random(22)
    rows, want = [], {}

    def add(*parts):
        rows.append((len(rows), " ".join(sum([fresh(30, rng), *parts, fresh(30, rng)], []))))

    for sizes in [(45, 45), (25, 30, 45), (20, 20, 20), (15, 40, 15, 30), (8,) * 12, (26, 26)] * 3:
        parts = [fresh(n, rng) for n in sizes]
        for k in range(3):
            if k:
                add(*parts)
            if k < 2:
                for part in parts:
                    add(part)
        want[len(rows) - 1] = sum(sizes)
    got = {}
    for r in passages.shared_passages(spark.createDataFrame(rows, DOCS)).collect():
        got.setdefault(r.doc_id, set()).add((r.start_word, r.end_word))
    assert got == {i: {(30, 30 + n)} for i, n in want.items()}


def test_edited_passages_are_found(spark):
    rng = random.Random(23)
    rows, cases = [], {}
    for share in (5, 10, 15, 20):
        for n in (50, 55, 60, 80, 100):
            for even in (False, True):
                for _ in range(20):
                    passage = fresh(n, rng)
                    edited, k = list(passage), n * share // 100
                    step = n / k
                    # the first and last words stay, for the passage to be as long as planted
                    at = [min(n - 2, max(1, int(step * (i + 0.5)))) for i in range(k)] if even else rng.sample(range(1, n - 1), k)
                    for i in at:
                        edited[i] = fresh(1, rng)[0]
                    rows += [(len(rows) + i, " ".join(fresh(30, rng) + p + fresh(30, rng))) for i, p in enumerate((passage, edited))]
                    cases[len(rows) - 1] = (share, n)
    got = {}
    for r in passages.shared_passages(spark.createDataFrame(rows, DOCS)).collect():
        got.setdefault(r.doc_id, []).append(r)
    lost = Counter(case for i, case in cases.items() if i not in got)
    print("lost of 40 each, by share of edits and words:", dict(lost))
    assert set(got) <= set(cases)
    assert sum(k for (share, _), k in lost.items() if share < 20) == 0
    assert sum(lost.values()) <= 0.1 * 200  # of those with a fifth of their words changed


@pytest.mark.parametrize("holders", [4, 40])
def test_edited_passages_are_found_whoever_else_has_their_parts(spark, holders):
    """Each part alone stands in many documents before the source and between it and the edited copy."""
    rng = random.Random(29)
    rows, want = [], {}
    for sizes in [(20, 20, 20), (15, 20, 15, 20), (30, 30)]:
        parts = [fresh(n, rng) for n in sizes]
        for k in range(2):
            for _ in range(holders):
                rows += [(len(rows) + i, " ".join(fresh(30, rng) + part + fresh(30, rng))) for i, part in enumerate(parts)]
            whole = [list(part) for part in parts]
            if k:  # a word of each part differs, for no 50 words to be equal
                for part in whole:
                    part[len(part) // 2] = fresh(1, rng)[0]
            rows.append((len(rows), " ".join(sum([fresh(30, rng), *whole, fresh(30, rng)], []))))
        want[len(rows) - 1] = {(30, 30 + sum(sizes))}
    got = {}
    for r in passages.shared_passages(spark.createDataFrame(rows, DOCS)).collect():
        got.setdefault(r.doc_id, set()).add((r.start_word, r.end_word))
    assert got == want


def test_edited_passages_are_found_by_one_common_line(spark):
    """All seeds they share are in 14 words that many documents have, those before the source and the last before the copy too."""
    rng = random.Random(31)
    line, passage = fresh(14, rng), fresh(36, rng)
    edited = [fresh(1, rng)[0] if i % 4 == 0 else word for i, word in enumerate(passage)]
    bodies = [[*line, *fresh(60, rng)] for _ in range(80)]
    bodies[40], bodies[-1] = line + passage, line + edited
    bodies[-1:-1] = [[*fresh(40, rng), *line, *fresh(40, rng)] for _ in range(3)]
    rows = [(i, " ".join(fresh(30, rng) + body + fresh(30, rng))) for i, body in enumerate(bodies)]
    got = [(r.doc_id, r.source_id, r.start_word, r.end_word) for r in passages.shared_passages(spark.createDataFrame(rows, DOCS)).collect()]
    assert got == [(len(rows) - 1, 40, 30, 80)]


def test_chain_prefers_the_diagonal():
    lines = passages.chain([0, 5, 10, 15], [100, 105, 3, 115], 5, 0.1, 30)
    assert lines[0] == [0, 1, 3] and [2] in lines


def plain_quality(text):
    w = words_of(text)
    lines = [x for x in (text or "").split("\n") if words_of(x)]
    count = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    inside = {j for i in range(len(w) - 2) if count[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside)


def test_quality_equals_brute_force(spark, corpus):
    rows = corpus + [(1000, "a b c d\n" * 30), (1001, "x# é|<\n x# é|<\n\n é"), (None, "q")]
    for r in quality.repetition_quality(spark.createDataFrame(rows, DOCS)).collect():
        text = dict(rows)[r.doc_id]
        want = plain_quality(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        w = words_of(text)
        count = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        inside = {j for i in range(len(w) - 4) if count[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        assert r.dup_gram_chars[0] == sum(len(w[j]) for j in inside)


def test_coverage_rejects_beyond_the_base_rule(spark):
    rng = random.Random(24)
    sentence, line = fresh(12, rng), fresh(20, rng)
    repeats = sum(([*fresh(13, rng), *sentence] for _ in range(40)), [])  # 48% of words, all on one line
    lines = "\n".join([" ".join(fresh(20, rng)) for _ in range(7)] + [" ".join(line)] * 3)
    rows = [(0, " ".join(repeats)), (1, lines), (2, " ".join(fresh(1000, rng)))]
    got = {r.doc_id: (r.base_failed, r.kept) for r in quality.repetition_quality(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {0: (False, False), 1: (False, False), 2: (False, True)}


def odd_texts():
    rng = random.Random(1)
    out = ["", " ", "a  b\n\n c's DON'T\t\tz\r\n", "<|endoftext|>x<|startoftext|> y", "ﬁ e\u0301 Ⅷ ½ 12 漢字 🙂👍🏽 a\x1cb !\x1c!", "a" * 3000, "İIıſ ẞ Σς.", "0 10 a0b"]
    return out + ["".join(rng.choice("ab cd'st\n\t .,!é漢<|endoftext|>\u0301 7½0") for _ in range(rng.randrange(50))) for _ in range(300)]


def test_bpe_equals_library(spark):
    texts, path = odd_texts(), public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = {r.doc_id: r for r in bpe.encode_texts(spark.createDataFrame([*enumerate(texts), (-1, None)], DOCS), path).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t, add_special_tokens=False).ids
        assert rows[i].ids == ids and rows[i].decoded == library.decode(ids, skip_special_tokens=False)
    assert rows[-1].ids == [] and rows[-1].decoded == ""


def test_packing_keeps_every_id(spark):
    texts, path = odd_texts() + [prose(30000), prose(900), prose(1500)], public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = packing.pack_documents(spark.createDataFrame([*enumerate(texts), (-1, None)], DOCS).coalesce(1), path).collect()
    windows = {}
    for i, t in [*enumerate(texts), (-1, "")]:
        ids, at = library.encode(t, add_special_tokens=False).ids + [1], 0
        for r in sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], dtype="<u4").tobytes())
            at += r.length
            windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert at == len(ids)
    for pieces in windows.values():
        end = 0
        for offset, n in sorted(pieces):
            assert offset == end
            end += n
        assert end <= 2048
    assert sum(2048 - sum(n for _, n in p) > 16 for p in windows.values()) <= 1


def test_packing_takes_any_tokenizer():
    texts = odd_texts()
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        path = public_tokenizers.path(name)
        encoder, library = packing.UnitIds(path), Tokenizer.from_file(path)
        assert encoder.by_units == (name == "word_bpe_49k.json")
        ids, counts = encoder.encode(texts, 1)
        whole = [library.encode(t, add_special_tokens=False).ids + [1] for t in texts]
        assert counts.tolist() == [len(w) for w in whole] and ids.tolist() == sum(whole, [])


def test_ids_are_forgotten_by_characters():
    store = bpe.IdStore(lambda units: (units, [1] * len(units)), lambda words: (np.array([len(w) for w in words]), np.ones(len(words), np.int64)), chars=100)
    for i in range(50):
        ids, sizes = store.ids(["x" * i, "y" * 60, "x" * i])
        assert ids.tolist() == [i, 60, i] and sizes.tolist() == [1, 1, 1]
        assert store.unit_chars <= 100 + 60 + i and store.word_chars <= 100 + 60 + i


def test_tightest_window():
    tree = packing.Capacities(100)
    for room, w in ((30, 1), (50, 2), (31, 3)):
        tree.add(room, w)
    assert tree.take(31) == (31, 3) and tree.take(31) == (50, 2) and tree.take(31) is None and tree.take(2) == (30, 1)


def test_toxicity_learns_from_documents(spark):
    rng = random.Random(4)
    texts, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        sentences = [prose(rng.randint(3, 12), rng) for _ in range(rng.randint(1, 8))]
        if bad:
            k = rng.randrange(len(sentences))
            sentences[k] += " " + rng.choice(["zogfool", "zogbad", "yukky"])
        texts.append(". ".join(sentences) + ".")
        labels.append(int(bad))
    model = toxicity.fit(texts[:450], labels[:450])
    rows = toxicity.score_toxicity(spark.createDataFrame([*enumerate(texts[450:]), (900, ""), (901, None)], DOCS), model).collect()
    right = sum(r.predicted == labels[450 + r.doc_id] for r in rows if r.doc_id < 150)
    assert right >= 145 and all(0 <= r.score <= 1 for r in rows)
    for r in rows:
        for s in r.offending:
            if labels[450 + r.doc_id]:
                assert re.search("zog|yuk", texts[450 + r.doc_id][s.start : s.end])
    assert toxicity.fit([], []).weights == {}


def test_url_rules(spark):
    rules = spark.createDataFrame([("com", "/en/", "block"), ("example.com", "/en/7", "allow")], "host string, path string, verdict string")
    cases = [
        ("http://A.Example.COM/en/78?x", "a.example.com", "/en/78", "example.com/en/7", "allow"), ("https://com/en/", "com", "/en/", "com/en/", "block"),
        ("x://notexample.com/en/7#f", "notexample.com", "/en/7", "com/en/", "block"), ("http://b.com?en/", "b.com", "", None, "allow"), ("no url", "", "", None, "allow"), (None, "", "", None, "allow"),
    ]
    pages = spark.createDataFrame([(i, c[0], "x") for i, c in enumerate(cases)] + [(0, cases[0][0], "y")], "page_id bigint, url string, host string")
    got = urls.judge_urls(pages, rules).collect()
    assert len(got) == len(cases) + 1
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == cases[r.page_id][1:]
    old, urls.BROADCAST_RULES = urls.BROADCAST_RULES, 0
    try:
        assert sorted(map(str, urls.judge_urls(pages, rules).collect())) == sorted(map(str, got))
    finally:
        urls.BROADCAST_RULES = old


def test_query_judges_urls_by_its_contract(spark, tmp_path):
    cases = {
        "http://a.com/en/8": ("com/en/", "block"), "http://www.example.com/en/71": ("example.com/en/7", "allow"), "http://b.net/de/8": ("net/de/", "allow"),
        "http://example.net/de/7": ("net/de/", "allow"), "http://www.example.net/de/80": ("example.net/de/8", "block"), "http://c.org/es/": ("org/es/", "block"),
        "http://c.org/en/": (None, "allow"),
    }
    spark.createDataFrame([(i, url) for i, url in enumerate(cases)], "page_id bigint, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.op2_url_filters(spark, str(tmp_path)).orderBy("page_id").collect()
    assert [(r.rule, r.verdict) for r in got] == list(cases.values())


def test_chat_round_trip(spark):
    nasty = ["\\### Assistant: </turn> ok", "</part><turn>\\", "<\\turn>", "", None, "\\\\</turn>\n</turn>\n", "a\nb"]
    rows = [(1, t, role, x) for t, (role, x) in enumerate((r, x) for x in nasty for r in ("user", "assistant", "assistant"))]
    rows += [(2, None, None, None), (2, 1, "</role>", "x"), (2, 1, "</role>", "x"), (None, 0, "assistant", "z")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r.conv_id: r for r in chat.read_chats(chat.format_chats(turns)).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [(r[2], r[3] or "") for r in sorted(rows[:21], key=lambda r: r[1])]
    assert got[1].loss_text == "".join(x or "" for x in nasty for _ in range(2))
    assert [(t.role, t.text) for t in got[2].turns] == [("", ""), ("</role>", "x"), ("</role>", "x")]
    assert got[None].loss_text == "z"


def test_nearest_recall(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 16))
    x[100:140] = x[100]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] * 16), (5003, [None] * 16), (5004, [1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    p = ann.Search(books=6, entries=32, sample=800, rows=500, queries=40)
    got = {}
    for r in ann.nearest(df, df.where("vec_id % 20 = 0"), p).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = total = 0
    for q in range(0, 1500, 20):
        s = x @ x[q]
        want = sorted((i for i in range(1500) if i != q), key=lambda i: (-round(s[i], 9), i))[:20]
        mine = [v for _, v, _ in sorted(got[q])]
        assert len(mine) == 20 and q not in mine
        hits += len(set(mine) & set(want))
        total += 20
    assert hits / total > 0.9 and set(got) == set(range(0, 1500, 20))


def test_main_text(spark):
    page = (
        "<html><head><title>t</title><script>var a='<p>x</p>';</script></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav><div class=\"ad\">Buy now</div>"
        "<article><h1>A &amp; B</h1><p><b>First  one<br><p>Second\n two is a long sentence, with words.</p></article><div class='comments'><p>Nice post</p></div><footer>&copy; me</footer>"
    )
    rows = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "u", "<!-- <p>"), (4, "u", "a < b <a href=\"x>" + "<p>" * 50)], "page_id bigint, url string, html string")
    got = {r.page_id: r for r in mainpage.main_text(rows).collect()}
    assert got[1].text == "A & B\nFirst one\nSecond two is a long sentence, with words." and got[1].n_chars == len(got[1].text)
    assert got[2].text == "" and got[3].text == ""


def test_boilerplate_labels_agree_down_the_tree():
    maker = mainpage._Maker(77)
    nodes = mainpage.Nodes([mainpage.Page(maker.page()) for _ in range(50)])
    drop = nodes.boilerplate(mainpage.train().predict(nodes.features()))
    assert all(drop[i] or not drop[nodes.parent[i]] for i in range(len(drop)))
    assert html.unescape("&amp;") == "&"


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(SF), reason="no test tables")
def test_pipeline_keeps_its_promises(spark):
    import corpus_pipeline
    from folioflow.llm.common import durable, table

    docs = table(spark, SF, "documents")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = durable(stage(spark, docs, SF))
        assert docs.columns == columns and docs.count() <= before, name
        before = docs.count()
    texts = [r.text for r in docs.select("text").collect()]
    assert all(plain_quality(t)[0] for t in texts)
    assert passages.shared_passages(docs).count() == 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sum(len(e.ids) + 1 for e in library.encode_batch(texts, add_special_tokens=False))
    assert pieces.agg({"length": "sum"}).first()[0] == want


def test_gathered_tables_are_few_files(spark, tmp_path):
    # 200 partitions of a shuffle would be 200 files, each made by processes of the executor's size
    many = spark.range(4000).repartition(200, "id")
    kept = common.durable(many, gathered=True)
    assert len(kept.inputFiles()) <= common.GATHERED * spark.sparkContext.defaultParallelism < 200
    assert kept.count() == 4000 and kept.agg(F.sum("id")).first()[0] == 4000 * 3999 // 2


def test_large_buckets_of_seeds_are_sorted_in_parts(monkeypatch):
    rng = np.random.default_rng(7)
    seed, doc, pos = rng.integers(0, 900, 6000).astype(np.uint64), rng.integers(0, 50, 6000), rng.integers(0, 400, 6000)
    spans, sizes = (16 * rng.integers(1, 12, 6000)).astype(np.uint8), []
    prints = rng.integers(0, 3, int((spans >> 4).sum())).astype(np.uint16)
    piece = (*passages._pack(seed, doc, pos), *passages._pack(seed, doc, pos + 11), spans.tobytes(), prints.tobytes())
    inner = passages._several
    monkeypatch.setattr(passages, "_several", lambda s, d: sizes.append(len(s)) or inner(s, d))

    def rows():
        sizes.clear()
        return sorted(t for found in passages.bucket_matches([piece], passages.Passages()) for t in zip(*(c.tolist() for c in found)))

    whole = rows()
    assert len(whole) > 6000 and max(sizes) == 6000
    monkeypatch.setattr(passages, "SORTED", 500)
    assert rows() == whole and max(sizes) < 1000
