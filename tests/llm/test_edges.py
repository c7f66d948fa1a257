"""Odd tables: empty, null, repeated, very long, and with columns whose names operators use themselves."""

import random
import tracemalloc

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from folioflow.llm import ann, bpe, chat, mainpage, neardup, packing, passages, quality, toxicity, urls
from folioflow.llm.common import LONG_WORD, PIECE, Words

MODEL = toxicity.ToxicityModel({"zog": 30.0}, -12.0, 1e-3)
WORDS, BYTES = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
CLASHES = "_spans spans _n nth n digest sketch value values home block chain side pos words seen more start end ids score kept rank place".split()
RNG = random.Random(31)
PROSE = " ".join(f"w{RNG.getrandbits(40):x}" for _ in range(90)) + ". fine words stand here."

BY_ROW = {
    "op1": lambda d: toxicity.score_toxicity(d, MODEL), "op6": lambda d: packing.pack_documents(d, WORDS), "op7": lambda d: bpe.encode_texts(d, BYTES),
    "op8": neardup.near_duplicates, "op10": quality.repetition_quality,
}
STAGES = {"quality": quality.keep_good, "toxicity": lambda d: toxicity.drop_toxic(d, MODEL), "near": neardup.keep_one, "passages": passages.cut_passages}


def odd(spark):
    rows = [(1, PROSE), (1, PROSE), (2, PROSE + " and more"), (3, ""), (4, None), (None, PROSE), (None, None), (5, " \n\t"), (6, "zog. " + PROSE[:300])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHES)])


@pytest.mark.parametrize("name", BY_ROW)
def test_operators_by_row(spark, name):
    df = odd(spark)
    got = BY_ROW[name](df).collect()
    assert sorted(r.doc_id or -1 for r in got) == sorted(r.doc_id or -1 for r in df.collect())
    assert BY_ROW[name](df.limit(0)).count() == 0


def test_passages_of_odd_tables(spark):
    got = passages.shared_passages(odd(spark)).collect()
    assert {(r.doc_id, r.source_id) for r in got} == {(2, 1)} and got[0].share == 1.0
    assert passages.shared_passages(odd(spark).limit(0)).count() == 0


@pytest.mark.parametrize("name", STAGES)
def test_stages_keep_columns_of_any_name(spark, name):
    df = odd(spark)
    out = STAGES[name](df)
    assert out.columns == df.columns
    rows = out.collect()
    for r in rows:
        assert [r[c] for c in CLASHES] == list(range(len(CLASHES)))
    left = {r.doc_id for r in rows}
    assert (6 in left) == (name in ("near", "passages", "quality")) or name == "quality"
    if name == "near":
        assert sum(r.doc_id == 1 for r in rows) == 1 and 2 not in left
    assert STAGES[name](df.limit(0)).count() == 0


def test_other_operators_of_empty_and_odd_tables(spark):
    vectors = spark.createDataFrame([(0, [1.0, 0.0], 1), (0, [0.0, 1.0], 1), (1, [0.5, 0.5], 1), (1, [0.5, 0.5], 2), (None, [1.0, 1.0], 1), (2, None, 1), (3, [0.0, 0.0], 1)], "vec_id bigint, embedding array<double>, rank int")
    got = [tuple(r) for r in ann.nearest(vectors, vectors.where("vec_id = 0")).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 0.5), (0, 2, 1, 0.5)]  # rows of one id each count, the query's own do not
    assert ann.nearest(vectors.limit(0), vectors).count() == 0
    turns = spark.createDataFrame([(1, 0, "user", "x", 5)] * 2, "conv_id bigint, turn int, role string, text string, ps int")
    assert len(chat.read_chats(chat.format_chats(turns)).first().turns) == 2 and chat.format_chats(turns.limit(0)).count() == 0
    pages = spark.createDataFrame([(1, None, None, 1), (1, "", "", 1), (None, "http://a.com/en/", "<p>x", 1)], "page_id bigint, url string, html string, depth int")
    assert mainpage.main_text(pages).count() == 3 and mainpage.main_text(pages.limit(0)).count() == 0
    rules = spark.createDataFrame([("com", "/en/", "block"), ("com", "/en/", "block")], "host string, path string, verdict string")
    assert urls.judge_urls(pages, rules).count() == 3 and urls.judge_urls(pages.limit(0), rules).count() == 0


def test_long_conversations_read_back(spark):
    turns = spark.range(9000).select(F.lit(1).cast("bigint").alias("conv_id"), "id", F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("é\\ </turn> "), F.col("id").cast("string")).alias("text"))
    row = chat.read_chats(chat.format_chats(turns.withColumnRenamed("id", "turn"))).first()
    assert [t.text for t in row.turns] == [f"é\\ </turn> {i}" for i in range(9000)]
    assert row.loss_text == "".join(f"é\\ </turn> {i}" for i in range(1, 9000, 2))


def test_spans_count_code_points_where_lower_case_is_longer():
    text = "İİİİ fine words here. you zog one. ok then"
    assert [text[s["start"] : s["end"]] for s in toxicity.Scorer(MODEL).offending(text)] == ["you zog one"]


def test_scores_are_noisy_or_of_sentences():
    model = toxicity.ToxicityModel({"bad": 4.0, "^abcd": 1.5}, -5.0, 0.01)
    texts = ["bad. abcdef bad! plain", "plain", ""]
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    want = [1 - 0.99 * (1 - sigmoid(-1)) * (1 - sigmoid(0.5)) * (1 - sigmoid(-5)), 1 - 0.99 * (1 - sigmoid(-5)), 0.01]
    assert np.allclose(toxicity.Scorer(model).score(texts)[0], want)


def test_words_of_long_texts_and_hostile_words():
    rng = random.Random(5)
    plain = " ".join("x" * rng.randint(1, 9) + str(i) for i in range(PIECE // 4))
    text = f"{plain} {'y' * (3 * PIECE)} été {plain}"
    w, parts = Words([text.encode(), b"", text[:50].encode()]), text.split()
    assert w.bounds[1] == len(parts) and w.chars[: len(parts)].tolist() == [len(p) for p in parts]
    first = {}
    for i, p in enumerate(parts):
        assert first.setdefault(p, w.hash[i]) == w.hash[i]
    assert len(set(first.values())) == len(first)
    # sums modulo a power of two are blind to these two words; long ones are hashed otherwise
    thue = [bin(i).count("1") % 2 for i in range(1 << 12)]
    a, b = ("".join("ab"[x ^ k] for x in thue) for k in (0, 1))
    assert len(a) > LONG_WORD
    h = Words([f"{a} {b} {a.upper()}".encode()], fold_case=True).hash
    assert h[0] != h[1] and h[0] == h[2]


def test_marks_decide_as_counted_plainly(spark):
    texts = ["ab -- cd -- ef | gh | ij ~ kl", "one-two three; four", "a -- b"]
    got = quality.measure([t.encode() for t in texts], quality.RepetitionRules())
    assert got["dup_mark_chars"].tolist() == [6, 0, 0]


def test_repetitive_texts_are_covered_whole(spark):
    """Every run of 50 words that an earlier text has is covered, in texts made of few lines too."""
    rng = random.Random(33)
    lines = [" ".join(f"{rng.getrandbits(20):x}" for _ in range(rng.randint(3, 9))) for _ in range(9)]
    texts = [" ".join(rng.choice(lines) for _ in range(rng.randint(15, 60))) for _ in range(25)] + ["ha " * 300, "ha " * 200, (lines[0] + " ") * 40, (lines[0] + " ") * 25]
    rows = list(enumerate(texts))
    spans = {}
    for r in passages.shared_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect():
        mine, theirs = texts[r.doc_id].split(), texts[r.source_id].split()
        assert r.source_id < r.doc_id and r.share >= 0.8 and r.n_words == r.end_word - r.start_word >= 50
        if r.share == 1.0:
            assert mine[r.start_word : r.end_word] == theirs[r.source_start_word : r.source_end_word]
        spans.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    first = {}
    for d, text in rows:
        words = text.split()
        for k in range(len(words) - 49):
            if first.setdefault(tuple(words[k : k + 50]), d) < d:
                assert set(range(k, k + 50)) <= spans.get(d, set()), (d, k)


def test_a_frequent_seed_takes_little_more_memory_than_its_surroundings():
    p, n = passages.Passages(), 60_000
    around = np.random.default_rng(1).integers(1, 256, size=(n, 2 * (p.rest + p.more + p.side + p.more)), dtype=np.uint8)
    around[-1] = around[7]
    bits = np.zeros((n, 2), np.int64)
    bits[-1] = (1 << p.rest) - 1
    tracemalloc.start()
    try:
        got = [(x.tolist(), y.tolist()) for x, y in passages.meetings(np.zeros(n, np.int64), np.arange(n), bits, around, p)]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert got == [([n - 1], [7])] and peak < 4 * around.nbytes
