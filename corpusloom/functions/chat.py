"""Column expressions on one conversation: an array of struct<from, value> in turn order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom import fixed_values as fixed
from corpusloom.functions.text import hash32, is_blank, strip

CONVERSATION = "array<struct<from:string,value:string>>"
MIXED_CONVERSATION = "array<struct<from:string,role:string,value:string,content:string>>"


def turn(role: Column | str, value: Column) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    return F.struct(role.alias("from"), value.alias("value"))


def parse(text: Column) -> Column:
    """JSON text to turns; accepts from/value and role/content keys."""
    raw = F.from_json(text, MIXED_CONVERSATION)
    return F.transform(raw, lambda t: turn(F.coalesce(t["role"], t["from"]), F.coalesce(t["content"], t["value"])))


def sharegpt_role(role: Column) -> Column:
    return F.when(role == "user", "human").when(role == "assistant", "gpt").otherwise(role)


def chat_role(role: Column) -> Column:
    return F.when(role == "human", "user").when(role == "gpt", "assistant").otherwise(role)


def to_sharegpt(conversation: Column) -> Column:
    return F.transform(conversation, lambda t: turn(sharegpt_role(t["from"]), t["value"]))


def to_chat(conversation: Column) -> Column:
    return F.transform(conversation, lambda t: turn(chat_role(t["from"]), t["value"]))


def any_turn_contains(conversation: Column, marker: str) -> Column:
    return F.exists(conversation, lambda t: F.contains(t["value"], F.lit(marker)))


def first_assistant(conversation: Column) -> Column:
    """Text of the first answer, null when there is none."""
    answers = F.filter(conversation, lambda t: t["from"].isin("gpt", "assistant"))
    return F.try_element_at(answers, F.lit(1))["value"]


def prompt_text(conversation: Column) -> Column:
    """All non-answer turns joined by line ends, in lower case."""
    asked = F.filter(conversation, lambda t: t["from"].isin("user", "human", "system"))
    return F.lower(F.array_join(F.transform(asked, lambda t: t["value"]), "\n"))


def triple(system: Column, question: Column, answer: Column) -> Column:
    return F.array(turn("system", system), turn("human", question), turn("gpt", answer))


def draw(options: list[str], key: Column) -> Column:
    """One of the options, chosen by the hash of the key."""
    return F.element_at(F.array(*map(F.lit, options)), (hash32(key) % len(options) + 1).cast("int"))


def instruction_prompt(instruction: Column, extra: Column) -> Column:
    """Header, instruction, extra input and answer cue; a blank input leaves its section empty."""
    return F.concat_ws(
        "\n\n",
        F.lit(fixed.INSTRUCTION_HEADER),
        F.concat_ws("\n", F.lit(fixed.INSTRUCTION_TITLE), instruction),
        F.when(is_blank(extra), "").otherwise(F.concat_ws("\n", F.lit(fixed.INPUT_TITLE), extra)),
        F.lit(fixed.ANSWER_TITLE),
    )


def request(template: str, text: Column) -> Column:
    """Put a text at the template's {text} place."""
    head, tail = template.split("{text}")
    return F.concat(F.lit(head), text, F.lit(tail))


def strip_delimiters(text: Column) -> Column:
    """Text before the end tag, without start tags; the long tag form goes first."""
    head = F.when(
        F.contains(text, F.lit("<<[end]>>")), F.substring_index(text, "<<[end]>>", 1)
    ).otherwise(F.substring_index(text, "<[end]>", 1))
    for tag in ("<<[start]>>", "<[start]>"):
        head = F.replace(head, F.lit(tag), F.lit(""))
    return strip(head)


def render(conversation: Column, style: str, bos: str = "<s>", eos: str = "</s>",
           answer_cue: bool = False, bos_on_system: bool = False) -> Column:
    """One prompt text per conversation: ``llama-2``, ``tess`` (upper-case roles) or ``chatml``."""
    if style == "llama-2":
        def one(t: Column, i: Column) -> Column:
            lead = bos if bos_on_system else ""
            return (
                F.when((t["from"] == "user") & (i > 1), F.concat(F.lit(f"{bos}[INST] "), t["value"], F.lit(" [/INST]")))
                .when(t["from"] == "user", F.concat(t["value"], F.lit(" [/INST]")))
                .when(t["from"] == "system",
                      F.concat(F.lit(f"{lead}[INST] <<SYS>>\n"), t["value"], F.lit("\n<</SYS>>\n\n")))
                .when(t["from"] == "assistant", F.concat(F.lit(" "), t["value"], F.lit(f" {eos}")))
                .otherwise("")
            )
        cue = ""
    elif style == "tess":
        def one(t: Column, i: Column) -> Column:
            return F.concat(F.upper(t["from"]), F.lit(": "), t["value"], F.lit("\n"))
        cue = "ASSISTANT: "
    elif style == "chatml":
        def one(t: Column, i: Column) -> Column:
            return F.concat(F.lit("<|im_start|>"), t["from"], F.lit("\n"), t["value"], F.lit("<|im_end|>\n"))
        cue = "<|im_start|>assistant\n"
    else:
        raise ValueError(f"unknown style {style!r}")
    body = F.array_join(F.transform(conversation, one), "")
    return F.concat(body, F.lit(cue)) if answer_cue else body
