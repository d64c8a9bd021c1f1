from collections import Counter

import pytest

from corpusloom.functions import chat
from corpusloom.functions.text import TOKENIZERS
from corpusloom.operators import vocab
from pyspark.sql import functions as F

TEXTS = ["low lower lowest", "new newer\tnewest 😀", "low low wide!", "a_b 日本 日本語"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en") for i, t in enumerate(TEXTS)], "id long, text string, lang string")


def words():
    import re
    return Counter(w for t in TEXTS for w in re.findall(r"\w+|[^\w\s]", t))


def test_word_counts(docs):
    assert {r["token"]: r["n"] for r in vocab.word_counts(docs).collect()} == dict(words())


def test_vocab_sizes(docs):
    import re
    got = {r["tokenizer"]: r["vocab_size"] for r in vocab.vocab_sizes(docs).collect()}
    text = "".join(TEXTS)
    assert got == {"word": len({w for t in TEXTS for w in t.split()}), "word_or_mark": len(words()),
                   "char": len(set(text)), "byte": len(set(text.encode()))}
    assert set(got) == set(TOKENIZERS)


def test_train_vocab(docs):
    parts = Counter()
    for w, n in words().items():
        for a in range(len(w)):
            for z in range(1, min(3, len(w) - a) + 1):
                parts[w[a:a + z]] += n
    want = sorted(parts.items(), key=lambda p: (-p[1], p[0].encode()))[:20]
    assert sorted(map(tuple, vocab.train_vocab(docs, 20, max_chars=3).collect())) == sorted(want)


def test_merge_rounds(docs):
    symbols = {tuple(w): n for w, n in words().items()}
    want = []
    for number in range(1, 7):
        pairs = Counter()
        for s, n in symbols.items():
            for p in zip(s, s[1:]):
                pairs[p] += n
        (left, right), n = min(pairs.items(), key=lambda p: (-p[1], p[0][0].encode(), p[0][1].encode()))
        want.append((number, left, right, n))
        merged = {}
        for s, c in symbols.items():
            out, i = [], 0
            while i < len(s):
                if s[i:i + 2] == (left, right):
                    out.append(left + right); i += 2
                else:
                    out.append(s[i]); i += 1
            merged[tuple(out)] = merged.get(tuple(out), 0) + c
        symbols = merged
    assert [tuple(r) for r in vocab.merge_rounds(docs, 6, keep_every=2).orderBy("round").collect()] == want


def plain_merges(words, rounds):
    """Greedy training, one pair at a time; also the words after it."""
    symbols, out = {w: tuple(w) for w in words if len(w) > 1}, []
    for number in range(1, rounds + 1):
        pairs = Counter()
        for w, s in symbols.items():
            for p in zip(s, s[1:]):
                pairs[p] += words[w]
        if not pairs:
            break
        (left, right), n = min(pairs.items(), key=lambda p: (-p[1], p[0][0].encode(), p[0][1].encode()))
        out.append((number, left, right, n))
        symbols = {w: plain_apply(s, left, right) for w, s in symbols.items()}
    return out, symbols


def plain_apply(s, left, right):
    out, i = [], 0
    while i < len(s):
        if s[i:i + 2] == (left, right):
            out.append(left + right)
            i += 2
        else:
            out.append(s[i])
            i += 1
    return tuple(out)


def test_runs_of_merges_equal_one_by_one():
    """The runs that one job applies, against greedy training, on texts full of ties and overlaps."""
    import random

    rng = random.Random(1)
    for _ in range(300):
        words = Counter("".join(rng.choices("abc" if rng.random() < 0.5 else "abcdefgh", k=rng.randrange(2, 9))) for _ in range(rng.randrange(1, 30)))
        want, final = plain_merges(words, 40)
        got, symbols = [], {w: tuple(w) for w in words if len(w) > 1}
        while len(got) < 40:
            pairs = Counter()
            for w, s in symbols.items():
                for p in zip(s, s[1:]):
                    pairs[p] += words[w]
            ranked = sorted(((a, b, n) for (a, b), n in pairs.items()), key=lambda p: (-p[2], p[0].encode(), p[1].encode()))
            seen = rng.choice([3, 10, 1000])
            run = vocab.next_merges(ranked[:seen], len(ranked) < seen, 40 - len(got))
            if not run:
                break
            for left, right, _ in run:
                symbols = {w: plain_apply(s, left, right) for w, s in symbols.items()}
            got += run
        assert [(i, *m) for i, m in enumerate(got, 1)] == want and symbols == final


def test_many_merges_and_encoding_equal_a_plain_trainer(spark):
    import re

    texts = [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(12).collect()] + TEXTS
    words = Counter(w for t in texts for w in re.findall(r"\w+|[^\w\s]", t))
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    merges = vocab.merge_rounds(docs, 250)
    want, final = plain_merges(words, 250)
    assert [tuple(r) for r in merges.orderBy("round").collect()] == want
    coded = vocab.encode_words(vocab.symbol_words(docs), merges)
    assert {r["token"]: tuple(r["symbols"]) for r in coded.collect()} == final
    other = spark.createDataFrame([("日本",), ("lowest",), ("x",), ("lowlow",)], "token string")
    got = {r["token"]: tuple(r["symbols"]) for r in vocab.encode_words(other, merges).collect()}
    plain = {}
    for w in got:
        plain[w] = tuple(w)
        for _, left, right, _ in want:
            plain[w] = plain_apply(plain[w], left, right)
    assert got == plain


def test_unspaced_scripts_and_long_words_stay(spark):
    text = "これは日本語の長い文章で、単語の間に空白がありません。Latin" + "x" * 60 + " 한국어 ไทย"
    docs = spark.createDataFrame([(text,)], "text string")
    found = {r["token"]: r["n"] for r in vocab.top_words(docs, 1000).collect()}
    assert max(map(len, found)) == 24 and sum(len(t) * n for t, n in found.items()) == len(text.replace(" ", ""))
    assert found["語"] == 2 and found["の"] == 2 and "한" in found and "ไ" in found
    table = vocab.sft_vocab(docs, 1000)
    talk = F.array(chat.turn("user", F.lit(text)), chat.turn("assistant", F.lit("長い日本")))
    rows = vocab.sft_encode(spark.range(1).select(F.lit("c").alias("id"), talk.alias("conversation")), table, 256)[0].collect()
    unknown = vocab.SPECIAL_TOKENS.index(vocab.UNKNOWN)
    body = rows[0]["input_ids"]
    assert body.count(unknown) == len(vocab.sft_tokens.__defaults__[0].replace(".", " .").split()) + 3  # the system text and the three roles alone


def test_merge_rounds_of_repeated_characters(spark):
    df = spark.createDataFrame([("aaaaa",)], "text string")
    assert [tuple(r) for r in vocab.merge_rounds(df, 2).orderBy("round").collect()] == [(1, "a", "a", 4), (2, "aa", "a", 1)]


def test_merge_vocab_and_rules(spark):
    base = spark.createDataFrame([("a", 0), ("b", 5), ("1", 6), ("2", 7)], "token string, id long")
    new = spark.createDataFrame([("b", 0), ("ab", 3), ("12", 1), ("1-", 2), ("a1", 4), ("-", 9), ("😀a", 5)], "token string, id long")
    merged = {r["token"]: r["id"] for r in vocab.merge_vocab(base, new).collect()}
    assert merged == {"a": 0, "b": 5, "1": 6, "2": 7, "ab": 8, "a1": 9, "😀a": 10, "-": 11}
    extra = spark.createDataFrame([(t, i) for i, t in enumerate(["a", "b", "1", "2", "ab", "a1", "12", "aab"])], "token string, id long")
    rules = sorted(r["merge"] for r in vocab.merge_rules(extra).collect())
    assert rules == ["a 1", "a ab", "a b"]


def test_budget(one):
    assert one(vocab.vocab_budget(F.lit(32000)), x=1) == 2**17 - 32000 - 10


def sample(spark, pairs, max_len):
    conversation = F.array(*[chat.turn(r, F.lit(v)) for r, v in pairs])
    df = spark.range(1).select(F.lit("c").alias("id"), conversation.alias("conversation"))
    tokens = [*vocab.SPECIAL_TOKENS, "system", "user", "assistant", "be", "hi", "yo"]
    table = spark.createDataFrame([(t, i) for i, t in enumerate(tokens)], "token string, id long")
    good, bad = vocab.sft_encode(df, table, max_len)
    return good.collect(), bad.count(), {t: i for i, t in enumerate(tokens)}


def test_sft_encode(spark):
    pairs = [("system", "be"), ("user", "hi zz"), ("assistant", "yo")]
    rows, bad, t = sample(spark, pairs, 24)
    start, end, nl, skip = t["<|im_start|>"], t["<|im_end|>"], t["\n"], -100
    ids = [start, t["system"], nl, t["be"], end, nl, start, t["user"], nl, t["hi"], t["<unk>"], end, nl,
           start, t["assistant"], nl, t["yo"], end, nl]
    labels = [start, skip, skip, skip, end, nl, start, skip, skip, skip, skip, end, nl, start, skip, skip, t["yo"], end, nl]
    assert bad == 0 and len(ids) == len(labels) == 19
    assert rows[0]["input_ids"] == ids + [t["<pad>"]] * 5
    assert rows[0]["labels"] == labels + [skip] * 5
    assert rows[0]["attention_mask"] == [True] * 19 + [False] * 5
    for cut in (19, 7):
        rows, _, _ = sample(spark, pairs, cut)
        assert rows[0]["input_ids"] == ids[:cut] and rows[0]["labels"] == labels[:cut]


def test_sft_first_turn_rules(spark):
    rows, _, t = sample(spark, [("assistant", "yo"), ("user", "hi")], 40)
    assert t["yo"] not in rows[0]["input_ids"] and t["hi"] in rows[0]["input_ids"]
    rows, bad, _ = sample(spark, [("user", "hi"), ("system", "be")], 40)
    assert rows == [] and bad == 1
    rows, bad, _ = sample(spark, [("system", "be"), ("system", "be"), ("user", "hi")], 40)
    assert rows == [] and bad == 1


def test_efficiency(docs):
    rows = {r["tokenizer"]: r for r in vocab.tokenizer_efficiency(docs).collect()}
    total = sum(map(len, TEXTS))
    assert rows["char"]["chars"] == total and rows["char"]["chars_per_token"] == 1.0
    assert rows["byte"]["tokens"] == sum(len(t.encode()) for t in TEXTS)
