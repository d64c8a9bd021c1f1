"""Registered queries: token counts, vocabularies and supervised samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom import fixed_values as fixed
from corpusloom.functions.text import TOKENIZERS
from corpusloom.operators import sampling, vocab
from corpusloom.plans import oracle_views as o
from corpusloom.plans import views
from corpusloom.plans.oracle_views import with_views

KIND = "word_or_mark"
HEAD = 50_000
WORDS = 500
TRAINED = 1000
ROUNDS = 40
MAX_LEN = 256
# Tokens with digits next to the new words.
DIGIT_TOKENS = ["12", "3-4", "a1", "2024"]


def _docs(spark, d):
    return views.documents(spark, d)


def conv_token_count(spark, d):
    return vocab.conversation_tokens(views.turns(spark, d), KIND)


def corpus_token_total(spark, d):
    return vocab.corpus_tokens(views.turns(spark, d))


def tokenizer_efficiency(spark, d):
    head = sampling.head_n(_docs(spark, d).select("doc_id", "lang", "text"), HEAD, "doc_id", ["lang"])
    return vocab.tokenizer_efficiency(head).withColumn("chars_per_token", F.round("chars_per_token", 9))


def vocab_size(spark, d):
    return vocab.vocab_sizes(_docs(spark, d))


def vocab_train_topk(spark, d):
    return vocab.train_vocab(_docs(spark, d), TRAINED)


def bpe_pair_counts(spark, d):
    return vocab.pair_counts(vocab.symbol_words(_docs(spark, d)))


def bpe_merge_rounds(spark, d):
    return vocab.merge_rounds(_docs(spark, d), ROUNDS)


def bpe_encode_words(spark, d):
    """The words of the documents, cut by the merges learned from them."""
    docs = _docs(spark, d)
    coded = vocab.encode_words(vocab.symbol_words(docs), vocab.merge_rounds(docs, ROUNDS))
    return coded.select("token", F.array_join("symbols", " ").alias("symbols"))


def vocab_budget(spark, d):
    sizes = vocab.vocab_sizes(_docs(spark, d))
    return sizes.select("tokenizer", vocab.vocab_budget(F.col("vocab_size")).alias("free"))


def _vocabs(spark, d):
    """Words of English documents, and of the other ones with some digit tokens, ids by rank."""
    docs = _docs(spark, d)
    order = [F.desc("n"), F.col("token")]
    base = vocab.number_tokens(vocab.top_words(docs.where("lang = 'en'"), WORDS), order, 0)
    new = vocab.number_tokens(vocab.top_words(docs.where("lang <> 'en'"), WORDS), order, 0)
    digits = spark.createDataFrame([(t, WORDS + i) for i, t in enumerate(DIGIT_TOKENS)], "token string, id long")
    return base, new.join(digits, "token", "left_anti").unionByName(digits)


def vocab_merge(spark, d):
    return vocab.merge_vocab(*_vocabs(spark, d))


def vocab_merge_rules(spark, d):
    return vocab.merge_rules(vocab.merge_vocab(*_vocabs(spark, d)))


def _encoded(spark, d):
    words = vocab.sft_vocab(_docs(spark, d), WORDS)
    return vocab.sft_encode(views.sys_conv(spark, d), words, MAX_LEN)


def sft_encode(spark, d):
    samples, _ = _encoded(spark, d)
    return samples.select(
        "id", F.array_join("input_ids", ",").alias("input_ids"), F.array_join("labels", ",").alias("labels"),
        F.size(F.filter("attention_mask", lambda m: m)).cast("long").alias("attended"),
    )


def sft_rejects(spark, d):
    _, rejects = _encoded(spark, d)
    return rejects.select("id")


QUERIES = {f.__name__: f for f in (
    conv_token_count, corpus_token_total, tokenizer_efficiency, vocab_size, vocab_train_topk, bpe_pair_counts,
    bpe_merge_rounds, bpe_encode_words, vocab_budget, vocab_merge, vocab_merge_rules, sft_encode, sft_rejects,
)}


def _totals() -> str:
    return "\n  UNION ALL ".join(
        f"SELECT '{k}' AS tokenizer, sum({o.token_count('value', k)})::BIGINT AS tokens FROM turns" for k in TOKENIZERS
    )


def _efficiency() -> str:
    rows = "\n  UNION ALL ".join(
        f"SELECT '{k}' AS tokenizer, lang, sum(length(text))::BIGINT AS chars, sum({o.token_count('text', k)})::BIGINT AS tokens FROM head GROUP BY lang"
        for k in TOKENIZERS
    )
    return f"""WITH head AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents) WHERE rn <= {HEAD})
SELECT *, round(chars / nullif(tokens, 0), 9) AS chars_per_token FROM ({rows})"""


def _sizes() -> str:
    return "\n  UNION ALL ".join(
        f"SELECT '{k}' AS tokenizer, count(DISTINCT token) AS vocab_size FROM (SELECT unnest({o.tokens('text', k)}) AS token FROM documents)"
        for k in TOKENIZERS
    )


def _words(where: str = "", kind: str = KIND) -> str:
    return f"SELECT token, count(*) AS n FROM (SELECT unnest({o.tokens('text', kind)}) AS token FROM documents{where}) GROUP BY token"


def _top(where: str = "") -> str:
    return f"""SELECT token, row_number() OVER (ORDER BY n DESC, token) - 1 AS id FROM
  (SELECT * FROM ({_words(where, 'vocab_word')}) ORDER BY n DESC, token LIMIT {WORDS})"""


SYMBOLS = f"""SELECT token, regexp_replace(token, '(?s)(.)', chr(2) || '\\1' || chr(3), 'g') AS symbols, n FROM ({_words()}) WHERE length(token) > 1"""


def _pair_counts(source: str) -> str:
    return f"""SELECT p[1] AS "left", p[2] AS "right", sum(n)::BIGINT AS n FROM (SELECT n,
  unnest(list_transform(range(1, len(s)), lambda i: [s[i], s[i + 1]])) AS p
  FROM (SELECT n, regexp_extract_all(symbols, chr(2) || '([^' || chr(3) || ']+)' || chr(3), 1) AS s FROM {source})) GROUP BY 1, 2"""


def _rounds() -> dict[str, str]:
    """b1, b2, ... are the merges; w1, w2, ... the words before each."""
    parts = {"w1": SYMBOLS}
    for i in range(1, ROUNDS + 1):
        parts[f"b{i}"] = f"""SELECT {i}::BIGINT AS round, * FROM ({_pair_counts(f'w{i}')}) ORDER BY n DESC, "left", "right" LIMIT 1"""
        parts[f"w{i + 1}"] = f"""SELECT token, replace(symbols, (SELECT chr(2) || "left" || chr(3) || chr(2) || "right" || chr(3) FROM b{i}),
  (SELECT chr(2) || "left" || "right" || chr(3) FROM b{i})) AS symbols, n FROM w{i}"""
    return parts


def _is_digit(x: str) -> str:
    return rf"(regexp_matches({x}, '[0-9]') AND regexp_matches({x}, '^([^\p{{L}}\p{{N}}_]|[0-9])+$'))"


MERGED = {
    "base": _top(" WHERE lang = 'en'"),
    "words_new": _top(" WHERE lang <> 'en'"),
    "new": f"""SELECT * FROM words_new WHERE token NOT IN ({', '.join(map(o.text, DIGIT_TOKENS))})
  UNION ALL SELECT * FROM (VALUES {', '.join(f"({o.text(t)}, {WORDS + i})" for i, t in enumerate(DIGIT_TOKENS))})""",
    "merged": f"""SELECT token, id FROM base UNION ALL
  SELECT token, (SELECT max(id) FROM base) + row_number() OVER (ORDER BY id, token) FROM new
  WHERE token NOT IN (SELECT token FROM base) AND NOT {_is_digit('token')}""",
}


def _sft() -> str:
    def block(head: str, body: str, kept: str) -> str:
        return f"""list_concat([{{'t': '<|im_start|>', 'k': true}}, {head}, {{'t': chr(10), 'k': false}}],
  list_transform({o.tokens(body, 'vocab_word')}, lambda x: {{'t': x, 'k': {kept}}}), [{{'t': '<|im_end|>', 'k': true}}, {{'t': chr(10), 'k': true}}])"""

    return with_views(["sys_turns"], """SELECT id, string_agg(v::VARCHAR, ',' ORDER BY pos) AS input_ids,
  string_agg((CASE WHEN k THEN v ELSE -100 END)::VARCHAR, ',' ORDER BY pos) AS labels, count(*) FILTER (v <> 0) AS attended
  FROM coded GROUP BY id""", {
        "words": f"""SELECT token, id + 5 AS id FROM ({_top()}) UNION ALL
  SELECT * FROM (VALUES ('<pad>', 0), ('<unk>', 1), ('<|im_start|>', 2), ('<|im_end|>', 3), (chr(10), 4))""",
        "good": """SELECT id FROM sys_turns GROUP BY id HAVING count(*) FILTER ("from" = 'system' AND idx > 0) = 0""",
        "blocks": f"""SELECT id, idx, CASE WHEN idx = 0 THEN {block("{'t': 'system', 'k': false}", 'value', 'false')}
  ELSE {block("{'t': " + '"from"' + ", 'k': false}", 'value', '''"from" = 'assistant' ''')} END AS b
  FROM sys_turns WHERE id IN (SELECT id FROM good)""",
        "whole": f"""SELECT id, list_slice(list_concat(flatten(list(b ORDER BY idx)),
  list_transform(range({MAX_LEN}), lambda i: {{'t': '<pad>', 'k': false}})), 1, {MAX_LEN}) AS w FROM blocks GROUP BY id""",
        "coded": """SELECT e.id, e.pos, e.k, coalesce(words.id, 1) AS v FROM
  (SELECT id, unnest(range(len(w))) AS pos, unnest(w).t AS t, unnest(w).k AS k FROM whole) e LEFT JOIN words ON e.t = words.token""",
    })


ORACLE = {
    "conv_token_count": with_views(["turns"], f"SELECT id, sum({o.token_count('value', KIND)})::BIGINT AS tokens FROM turns GROUP BY id"),
    "corpus_token_total": with_views(["turns"], _totals()),
    "tokenizer_efficiency": _efficiency(),
    "vocab_size": _sizes(),
    "vocab_train_topk": f"""SELECT substr(token, a, z) AS token, sum(n)::BIGINT AS n FROM (SELECT token, n, a,
  unnest(range(1, least({fixed.MAX_TOKEN_CHARS}, length(token) - a + 1) + 1)) AS z FROM
  (SELECT token, n, unnest(range(1, length(token) + 1)) AS a FROM ({_words()}))) GROUP BY 1 ORDER BY n DESC, 1 LIMIT {TRAINED}""",
    "bpe_pair_counts": f"WITH w AS ({SYMBOLS}) {_pair_counts('w')}",
    "bpe_merge_rounds": with_views([], " UNION ALL ".join(f"SELECT * FROM b{i}" for i in range(1, ROUNDS + 1)), _rounds()),
    "bpe_encode_words": with_views([], f"""SELECT token, replace(substr(symbols, 2, length(symbols) - 2), chr(3) || chr(2), ' ') AS symbols
  FROM w{ROUNDS + 1}""", _rounds()),
    "vocab_budget": f"SELECT tokenizer, {fixed.VOCAB_LIMIT} - vocab_size - {fixed.VOCAB_RESERVED} AS free FROM ({_sizes()})",
    "vocab_merge": with_views([], "SELECT * FROM merged", MERGED),
    "vocab_merge_rules": with_views([], f"""SELECT token, l || ' ' || r AS merge FROM (SELECT token, substr(token, 1, a) AS l, substr(token, a + 1) AS r
  FROM (SELECT token, unnest(range(1, length(token))) AS a FROM merged)) WHERE l IN (SELECT token FROM merged) AND r IN (SELECT token FROM merged)
  AND NOT ({_is_digit('l')} AND {_is_digit('r')})""", MERGED),
    "sft_encode": _sft(),
    "sft_rejects": with_views(["sys_turns"], """SELECT DISTINCT id FROM sys_turns WHERE "from" = 'system' AND idx > 0"""),
}
