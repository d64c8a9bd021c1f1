"""The same views as SQL, for the oracles."""

from __future__ import annotations

from corpusloom.plans import views

SPACE = r"\x09-\x0D\x1C-\x20\x85\p{Z}"
PIECE = r"[^ \t\n\r\f]+"
WORD_OR_MARK = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_ \t\n\r\f]"
UNSPACED_CHAR = r"([\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Tibetan}])"
VOCAB_WORD = r"[\p{L}\p{N}_]{1,24}|[^\p{L}\p{N}_ \t\n\r\f]"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def listing(values: list[str]) -> str:
    return "[" + ", ".join(map(text, values)) + "]"


def h(x: str) -> str:
    return f"('0x' || substr(md5({x}), 1, 8))::BIGINT"


def b(x: str, n: int) -> str:
    return f"({h(x)} % {n})"


def ja(x: str) -> str:
    return f"translate({x}, 'aeiou', 'あえいおう')"


def uuid5(x: str) -> str:
    s = f"sha1(unhex('6ba7b8129dad11d180b400c04fd430c8') || encode({x}))"
    return (
        f"(substr({s},1,8) || '-' || substr({s},9,4) || '-5' || substr({s},14,3) || '-' || "
        f"translate(substr({s},17,1), '0123456789abcdef', '89ab89ab89ab89ab') || substr({s},18,3) || '-' || substr({s},21,12))"
    )


def blank(x: str) -> str:
    return f"(NOT coalesce(regexp_matches({x}, '[^{SPACE}]'), false))"


def count_re(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))"


def tokens(x: str, kind: str) -> str:
    return {
        "word": f"regexp_extract_all({x}, '{PIECE}')",
        "word_or_mark": f"regexp_extract_all({x}, '{WORD_OR_MARK}')",
        "vocab_word": f"regexp_extract_all(regexp_replace({x}, '{UNSPACED_CHAR}', ' \\1 ', 'g'), '{VOCAB_WORD}')",
        "char": f"regexp_extract_all({x}, '(?s).')",
        "byte": f"regexp_extract_all(hex(encode({x})), '..')",
    }[kind]


def token_count(x: str, kind: str) -> str:
    return {"char": f"length({x})", "byte": f"strlen({x})"}.get(kind, f"len({tokens(x, kind)})")


def fixed4(x: str) -> str:
    units = f"floor(abs({x}) * 10000 + 0.5)::BIGINT"
    return (
        f"(CASE WHEN {x} < 0 AND {units} > 0 THEN '-' ELSE '' END || ({units} // 10000)::VARCHAR || '.' || "
        f"lpad(({units} % 10000)::VARCHAR, 4, '0'))"
    )


def gate(en: str, out: str, leak: str = "日本") -> str:
    return f"""CASE WHEN {out} IS NULL OR {out} = '' THEN 'empty'
  WHEN length({en}) >= 100 AND (strlen({out}) / length({en}) < 0.5 OR strlen({out}) / length({en}) > 2.7) THEN 'ratio'
  WHEN contains({out}, {text(leak)}) OR (contains(lower({out}), 'japanese') AND NOT contains(lower({en}), 'japanese')) THEN 'leak'
  WHEN length({out}) / strlen({out}) >= 0.9 THEN 'untranslated' ELSE 'ok' END"""


def category(id: str) -> str:
    return f"{listing(views.CATEGORIES)}[{b(id, 6)} + 1]"


JSON = """to_json(list({'from': "from", 'value': value} ORDER BY idx))::VARCHAR"""

VIEWS: dict[str, tuple[list[str], str]] = {
    "turns": ([], """SELECT conv_id::VARCHAR AS id, turn AS idx, role AS "from", text AS value FROM conversations"""),
    "sys_turns": (["turns"], f"""SELECT id, idx + 1 AS idx, "from", value FROM turns
  UNION ALL SELECT id, 0, 'system', {listing(views.SYSTEM_POOL)}[{b('id', 5)} + 1] FROM turns WHERE idx = 0"""),
    "conv": (["turns"], f"""SELECT id, {JSON} AS conversation FROM turns GROUP BY id"""),
    "sys_conv": (["sys_turns"], f"""SELECT id, {JSON} AS conversation FROM sys_turns GROUP BY id"""),
    "cache_k": (["sys_turns"], f"""SELECT DISTINCT value AS prompt_en, {b("'cache|' || value", 10)} AS k FROM sys_turns"""),
    "cache": (["cache_k"], f"""SELECT prompt_en,
  CASE WHEN k <= 6 THEN {ja('prompt_en')} WHEN k = 7 THEN prompt_en
       WHEN k = 8 THEN substr({ja('prompt_en')}, 1, length(prompt_en) // 10)
       ELSE {ja('prompt_en')} || ' 日本' END AS prompt_ja,
  CASE WHEN k >= 5 THEN 'short-model' ELSE 'gpt-4' END AS translator
  FROM cache_k WHERE k > 0"""),
    "turns_ja": (["sys_turns", "cache"], """SELECT t.id, t.idx, t."from", t.value AS value_en, c.prompt_ja AS value
  FROM sys_turns t LEFT JOIN cache c ON t.value = c.prompt_en"""),
    "conv_ja": (["turns_ja"], f"""SELECT id, {JSON} AS conversation_ja FROM turns_ja GROUP BY id
  HAVING bool_and(coalesce(NOT {blank('value')} AND NOT {blank('value_en')}, false))"""),
    "corpus": (["sys_conv", "conv_ja"], f"""SELECT s.id, {category('s.id')} AS category, s.conversation, j.conversation_ja,
  CASE WHEN {b("'tr|' || s.id", 7)} = 0 THEN NULL WHEN {b("'tr|' || s.id", 2)} = 0 THEN 'gpt-4' ELSE 'short-model' END AS translator
  FROM sys_conv s LEFT JOIN conv_ja j ON s.id = j.id"""),
    "records": (["conv"], f"""SELECT id, {category('id')} AS category, conversation FROM conv"""),
    "incoming": (["records"], """SELECT id::BIGINT * 2 AS seq, CASE WHEN id::BIGINT % 3 = 2 THEN 'x' || id ELSE id END AS id,
  category, conversation FROM records
  UNION ALL SELECT id::BIGINT * 2 + 1, CASE WHEN id::BIGINT % 3 = 2 THEN 'x' || id ELSE id END, 'revised',
  replace(conversation, '"value":"', '"value":"v2 ') FROM records WHERE id::BIGINT % 3 <> 1"""),
    "pairs": ([], f"""SELECT doc_id, text AS en, {ja('text')} || CASE WHEN {b('doc_id::VARCHAR', 5)} = 0
  THEN {listing(views.CODE_TAILS)}[{b("'code|' || doc_id", len(views.CODE_TAILS))} + 1] ELSE '' END AS ja FROM documents"""),
    "prompts": ([], f"""SELECT doc_id, lower(text || CASE WHEN {b('doc_id::VARCHAR', 6)} = 0 THEN ' Translate this' ELSE '' END) AS prompt
  FROM documents"""),
    "verdicts": (["turns"], f"""SELECT {uuid5('value')} AS id, {b('value', 20)} = 0 AS refusal
  FROM (SELECT DISTINCT value FROM turns) WHERE {b('value', 4)} = 0"""),
    "verdicts_ja": (["cache"], f"""SELECT {uuid5('prompt_ja')} AS id, bool_or({b("'verdict|' || prompt_en", 16)} = 0) AS refusal FROM cache
  WHERE {b("'verdict|' || prompt_en", 16)} < 8 GROUP BY 1"""),
    "judge_replies": (["turns"], f"""SELECT id, idx, CASE {b('value', 4)} WHEN 0 THEN 'Yes.' WHEN 1 THEN ' no' WHEN 2 THEN '' END AS response FROM turns"""),
    "first_user": (["turns"], """SELECT id, arg_min(value, idx) AS text FROM turns WHERE "from" = 'user' GROUP BY id"""),
    "first_assistant": (["turns"], """SELECT id, arg_min(value, idx) AS text FROM turns WHERE "from" = 'assistant' GROUP BY id"""),
    "prefs": (["first_user", "conv"], f"""SELECT u.id::BIGINT AS seq, u.text AS prompt, c.conversation AS chosen,
  ({b('u.text', 10)} + 1)::DOUBLE AS score_chosen FROM first_user u JOIN conv c ON u.id = c.id"""),
    "instructions": (["first_user", "first_assistant"], f"""SELECT u.id, u.text AS instruction,
  CASE {b('u.id', 4)} WHEN 1 THEN '' WHEN 2 THEN '  ' WHEN 3 THEN 'Case ' || u.id END AS input, a.text AS output
  FROM first_user u JOIN first_assistant a ON u.id = a.id"""),
    "mc": ([], f"""SELECT b.item_id, b.text AS input, p0.p_name AS A, p1.p_name AS B, p2.p_name AS C, p3.p_name AS D,
  {listing(list('ABCD'))}[{b('b.item_id::VARCHAR', 4)} + 1] AS target FROM benchmark b
  LEFT JOIN part p0 ON p0.p_partkey = 4 * b.item_id LEFT JOIN part p1 ON p1.p_partkey = 4 * b.item_id + 1
  LEFT JOIN part p2 ON p2.p_partkey = 4 * b.item_id + 2 LEFT JOIN part p3 ON p3.p_partkey = 4 * b.item_id + 3"""),
    "passages": ([], f"""SELECT d.doc_id, d.text AS passage, b.text AS question,
  list_slice({tokens('d.text', 'word')}, 1, 3) AS spans FROM documents d
  JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)"""),
    "labeled": ([], "SELECT * FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)"),
    "tasks": (["first_user"], f"""SELECT id, {category('id')} AS type, {listing(views.SYSTEM_POOL)}[{b('id', 5)} + 1] AS prompt_en,
  {ja(f"{listing(views.SYSTEM_POOL)}[{b('id', 5)} + 1]")} AS prompt_ja,
  CASE WHEN {b("'en|' || id", 25)} = 0 THEN '' ELSE text END AS user_en,
  CASE WHEN {b("'ja|' || id", 13)} = 0 THEN '' ELSE {ja('text')} END AS user_ja FROM first_user"""),
    "scores_long": ([], """SELECT model, metric, sum(mark) / count(mark) - 0.1 AS score FROM (
  SELECT source AS model, lang || '_quality' AS metric, quality AS mark FROM documents JOIN labels USING (doc_id)
  UNION ALL SELECT source, lang || '_toxic', toxic FROM documents JOIN labels USING (doc_id)) GROUP BY model, metric"""),
    "layers": ([], """SELECT event_id, value, CASE WHEN event_type = 'error' THEN 'over-trained' ELSE '' END AS warning FROM events"""),
    "accs": ([], """SELECT event_id, ((event_id % 2) || '.' || lpad((event_id % 9973)::VARCHAR, 4, '0'))::DOUBLE AS acc FROM events"""),
}


def with_views(names: list[str], body: str, extra: dict[str, str] | None = None) -> str:
    """Put the named views, and those they rest on, in front of a query."""
    order: list[str] = []

    def need(name: str) -> None:
        for other in VIEWS[name][0]:
            need(other)
        if name not in order:
            order.append(name)

    for name in names:
        need(name)
    parts = [f"{n} AS MATERIALIZED ({VIEWS[n][1]})" for n in order]
    parts += [f"{n} AS MATERIALIZED ({sql})" for n, sql in (extra or {}).items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body
