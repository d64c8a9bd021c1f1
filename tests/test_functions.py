import hashlib
import uuid

import pytest
from pyspark.sql import functions as F

from corpusloom import fixed_values as fixed
from corpusloom.functions import bench_text, chat, text
from corpusloom.operators import filters, translation


@pytest.mark.parametrize("value", ["", "a", "日本語 text", "😀 astral", "x" * 500])
def test_keys(one, value):
    assert one(text.uuid5(F.col("x")), x=value) == str(uuid.uuid5(uuid.NAMESPACE_OID, value))
    assert one(text.hash32(F.col("x")), x=value) == int(hashlib.md5(value.encode()).hexdigest()[:8], 16)


@pytest.mark.parametrize("value", ["", "a", "a\n", "a\nb", "a\r\nb\r\n", "\n", "a b\x85c", "a\x1cb\x0b\x0c", "a\n\nb"])
def test_line_count(one, value):
    assert one(text.line_count(F.col("x")), x=value) == len(value.splitlines())


@pytest.mark.parametrize("value", ["", " \n\t", "　 a b \n", "a", "\x1f\x85x "])
def test_strip_and_blank(one, value):
    assert one(text.strip(F.col("x")), x=value) == value.strip()
    assert one(text.is_blank(F.col("x")), x=value) == (not value.strip())


def test_blank_null(one):
    assert one(text.is_blank(F.col("x")), x=None) is True


def test_tokens(one):
    value = "Don't stop, 日本語! 😀 a_b\n12"
    assert one(text.tokens(F.col("x"), "word_or_mark"), x=value) == ["Don", "'", "t", "stop", ",", "日本語", "!", "😀", "a_b", "12"]
    assert one(text.tokens(F.col("x"), "word"), x=value) == value.split()
    assert one(text.tokens(F.col("x"), "char"), x=value) == list(value)
    assert one(text.tokens(F.col("x"), "byte"), x="é") == ["C3", "A9"]
    for kind in text.TOKENIZERS:
        assert one(text.token_count(F.col("x"), kind), x=value) == len(one(text.tokens(F.col("x"), kind), x=value))


@pytest.mark.parametrize("value, shown", [(0.5, "0.5000"), (0.00005, "0.0001"), (-0.25, "-0.2500"), (12.34567, "12.3457"), (-0.00001, "0.0000")])
def test_fixed_point(one, value, shown):
    assert one(text.fixed_point(F.col("x")), x=value) == shown


def turns(*pairs):
    return F.array(*[chat.turn(r, F.lit(v)) for r, v in pairs])


def test_roles(one):
    c = turns(("system", "s"), ("user", "u"), ("assistant", "a"))
    there = one(chat.to_sharegpt(c), x=1)
    assert [t["from"] for t in there] == ["system", "human", "gpt"]
    assert [t["from"] for t in one(chat.to_chat(chat.to_sharegpt(c)), x=1)] == ["system", "user", "assistant"]


def test_parse_both_key_forms(one):
    mixed = '[{"role": "user", "content": "q"}, {"from": "gpt", "value": "a"}]'
    assert [tuple(t) for t in one(chat.parse(F.col("x")), x=mixed)] == [("user", "q"), ("gpt", "a")]


def test_first_assistant(one):
    assert one(chat.first_assistant(turns(("human", "q"), ("gpt", "a"), ("gpt", "b"))), x=1) == "a"
    assert one(chat.first_assistant(turns(("assistant", "first"), ("user", "q"))), x=1) == "first"
    assert one(chat.first_assistant(turns(("human", "q"))), x=1) is None
    assert one(chat.first_assistant(F.from_json(F.col("x"), chat.CONVERSATION)), x="[]") is None


def test_prompt_text(one):
    assert one(chat.prompt_text(turns(("system", "Be"), ("gpt", "no"), ("user", "ME"))), x=1) == "be\nme"


@pytest.mark.parametrize("value, out", [
    ("  plain ", "plain"), ("<<[start]>>\nabc", "abc"), ("abc <<[end]>>", "abc"), ("<<[start]>> a <<[end]>> rest", "a"),
    ("<[start]> a <[end]> rest", "a"), ("a <[end]> b <<[end]>> c", "a <[end]> b"),
])
def test_strip_delimiters(one, value, out):
    assert one(chat.strip_delimiters(F.col("x")), x=value) == out


def test_render(one):
    c = turns(("system", "S"), ("user", "U"), ("assistant", "A"), ("user", "V"))
    assert one(chat.render(c, "llama-2"), x=1) == "[INST] <<SYS>>\nS\n<</SYS>>\n\nU [/INST] A </s><s>[INST] V [/INST]"
    assert one(chat.render(c, "llama-2", bos_on_system=True), x=1).startswith("<s>[INST] <<SYS>>")
    assert one(chat.render(c, "tess", answer_cue=True), x=1) == "SYSTEM: S\nUSER: U\nASSISTANT: A\nUSER: V\nASSISTANT: "
    assert one(chat.render(turns(("user", "U")), "chatml", answer_cue=True), x=1) == "<|im_start|>user\nU<|im_end|>\n<|im_start|>assistant\n"
    assert one(chat.render(turns(("user", "U"), ("assistant", "A")), "llama-2"), x=1) == "U [/INST] A </s>"


@pytest.mark.parametrize("extra", [None, "", "  "])
def test_blank_input_keeps_its_section(one, extra):
    prompt = one(chat.instruction_prompt(F.lit("do"), F.lit(extra)), x=1)
    assert prompt == f"{fixed.INSTRUCTION_HEADER}\n\n{fixed.INSTRUCTION_TITLE}\ndo\n\n\n\n{fixed.ANSWER_TITLE}"


def test_input_section(one):
    assert f"\n\n{fixed.INPUT_TITLE}\nhere\n\n" in one(chat.instruction_prompt(F.lit("do"), F.lit("here")), x=1)


def test_request(one):
    assert one(chat.request(fixed.TRANSLATE_REQUEST, F.col("x")), x="{a}") == fixed.TRANSLATE_REQUEST.replace("{text}", "{a}")


def test_bench_text(one):
    assert bench_text.option_columns(["input", "A", "B", "target", "AB"]) == ["A", "B"]
    arrays = bench_text.choice_arrays(F.lit("q"), F.array(F.lit("1"), F.lit("2")), F.array(F.lit("x"), F.lit("y")), F.lit("2"))
    assert one(arrays, x=1) == "q\n1. x\n2. y\n2"
    assert one(bench_text.passage_spans(F.lit("p"), F.lit("q"), F.array(F.lit("a"), F.lit("b"))), x=1) == "p\nq\na, b"
    assert one(bench_text.option_pick(F.lit("s"), F.lit("one"), F.lit("two"), F.lit(1)), x=1) == "s\none"
    assert one(bench_text.option_pick(F.lit("s"), F.lit("one"), F.lit("two"), F.lit("2")), x=1) == "s\ntwo"
    assert one(bench_text.lines(F.lit("q"), F.lit(""), F.lit("a")), x=1) == "q\n\na"


@pytest.mark.parametrize("prompt, kept", [
    ("please help", True), ("", True), ("translate it", False), ("日本語" * 5, False),
    (" ".join(["abcdefghijklmno"] * 7), False), (" ".join(["abcdefghijklmno"] * 6), True), ("x" * 200, True),
])
def test_plain_prompt(one, prompt, kept):
    assert one(filters.is_plain_prompt(F.col("x")), x=prompt) is kept


@pytest.mark.parametrize("value, code", [
    ("x def f", True), ("def f", True), ("\ndef f", True), ("undef f", False), ("for i in range(3)", True),
    ("in range(", False), ("例：\u3000def f(x):", True), ("a\u00a0def f", True), ("\u3000in range(", False), ("a ``` b", True), ("{", True), ("std::", True), ("#include", True), ("plain", False),
])
def test_code_marks(one, value, code):
    assert one(filters.looks_like_code(F.col("x")), x=value) is code


@pytest.mark.parametrize("en, out, verdict", [
    ("a" * 100, "あ" * 90, "ok"),                       # 270 bytes / 100 = 2.7 exactly
    ("a" * 100, "あ" * 91, "ratio"),
    ("a" * 100, "あ" * 16 + "ab", "ok"),                # 50 / 100 = 0.5 exactly
    ("a" * 100, "あ" * 16, "ratio"),
    ("a" * 99, "あ" * 5, "ok"),                         # too short for the ratio check
    ("hello", "日本のこと", "leak"), ("hello", "これはJapanese", "leak"), ("in Japanese", "これはjapanese", "ok"),
    ("hello", "hello", "untranslated"), ("hello", "a" * 17 + "é", "untranslated"), ("hello", "", "empty"), ("hello", None, "empty"),
    ("hello", "aaaaaaaaéé", "ok"),                      # 10 / 12
])
def test_gate(one, en, out, verdict):
    assert one(translation.gate(F.lit(en), F.lit(out).cast("string")), x=1) == verdict


def test_latin_share_limit(one):
    nine = "a" * 8 + "é"                                 # 9 characters, 10 bytes: 0.90 exactly
    assert one(translation.gate(F.lit("hello"), F.lit(nine)), x=1) == "untranslated"


def test_boilerplate_and_yes(one):
    assert one(translation.without_boilerplate(F.col("x")), x=f"Oh. {fixed.EMPTY_REQUEST_ECHO}") is None
    assert one(translation.without_boilerplate(F.col("x")), x="") is None
    assert one(translation.without_boilerplate(F.col("x")), x="fine") == "fine"
    for reply, yes in [("Yes.", True), ("YES", True), (" no", False), ("", False), ("  ", False)]:
        assert one(translation.says_yes(F.col("x")), x=reply) is yes


def test_pick_translator(one):
    def run(primary, secondary):
        p = translation.pick_translator(F.lit("hello"), F.lit(primary).cast("string"), F.lit("p"), F.lit(secondary).cast("string"), F.lit("s"))
        return one(p, x=1)

    assert tuple(run("こんにちは", "x")) == ("こんにちは", "p")
    assert tuple(run("hello", "やあ")) == ("やあ", "s")
    assert run("hello", None) is None


def test_zero_tokens(one):
    assert one(translation.token_ratio(F.lit(0), F.lit(5)), x=1) is None
