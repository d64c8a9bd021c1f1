"""Token counts, vocabularies and supervised samples, over native tokenizers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusloom import fixed_values as fixed
from corpusloom.functions.text import SPACE, TOKENIZERS, WORD_CHAR, token_count, tokens
from corpusloom.session import shared_folder

DIGITS_ONLY = rf"^([^{WORD_CHAR}]|[0-9])+$"
OPEN, CLOSE = "\x02", "\x03"
PAD, UNKNOWN, IM_START, IM_END, LINE = "<pad>", "<unk>", "<|im_start|>", "<|im_end|>", "\n"
SPECIAL_TOKENS = [PAD, UNKNOWN, IM_START, IM_END, LINE]


def conversation_tokens(turns: DataFrame, kind: str, id: str = "id") -> DataFrame:
    return turns.groupBy(id).agg(F.sum(token_count(F.col("value"), kind)).alias("tokens"))


def corpus_tokens(turns: DataFrame) -> DataFrame:
    """Total tokens of all turns under each tokenizer, in one pass."""
    return _long_counts(turns, [], "value").groupBy("tokenizer").agg(F.sum("n").alias("tokens"))


def _long_counts(df: DataFrame, keep: list[str], text: str) -> DataFrame:
    rows = F.array(*[
        F.struct(F.lit(k).alias("tokenizer"), token_count(F.col(text), k).alias("n")) for k in TOKENIZERS
    ])
    return df.select(*keep, F.length(text).cast("long").alias("n_chars"), F.inline(rows))


def tokenizer_efficiency(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Characters, tokens and characters per token, by tokenizer and language, in one pass."""
    sums = _long_counts(docs, [lang], text).groupBy("tokenizer", lang).agg(
        F.sum("n_chars").alias("chars"), F.sum("n").alias("tokens")
    )
    return sums.withColumn("chars_per_token", F.col("chars") / F.nullif(F.col("tokens"), F.lit(0)))


def piece_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Words between white space, and each white-space character, with their counts.

    No token of any tokenizer crosses a word, so later steps read these distinct pieces instead of the corpus.
    """
    pieces = F.regexp_extract_all(F.col(text), F.lit(rf"[^{SPACE}]+|[{SPACE}]"), 0)
    return docs.select(F.explode(pieces).alias("piece")).groupBy("piece").agg(F.count(F.lit(1)).alias("n"))


def vocab_sizes(docs: DataFrame, text: str = "text") -> DataFrame:
    """Distinct tokens per tokenizer."""
    kinds = F.array(*[
        F.struct(F.lit(k).alias("tokenizer"), tokens(F.col("piece"), k).alias("tokens")) for k in TOKENIZERS
    ])
    listed = piece_counts(docs, text).select(F.inline(kinds)).select("tokenizer", F.explode("tokens").alias("token"))
    return listed.distinct().groupBy("tokenizer").agg(F.count(F.lit(1)).alias("vocab_size"))


def vocab_budget(base_size: Column) -> Column:
    """Free vocabulary slots next to a base vocabulary."""
    return F.lit(fixed.VOCAB_LIMIT) - base_size - F.lit(fixed.VOCAB_RESERVED)


def word_counts(docs: DataFrame, text: str = "text", kind: str = "word_or_mark") -> DataFrame:
    """Token counts, by way of the distinct words."""
    return (
        piece_counts(docs, text).select(F.explode(tokens(F.col("piece"), kind)).alias("token"), "n")
        .groupBy("token").agg(F.sum("n").alias("n"))
    )


def top_words(docs: DataFrame, k: int, text: str = "text") -> DataFrame:
    """The k most frequent words as ``(token, n)``; k is a vocabulary size.

    No text is left out: words beyond MAX_TOKEN_CHARS count by their parts, unspaced scripts by character.
    """
    if k > fixed.VOCAB_LIMIT:
        raise ValueError(f"a vocabulary has at most {fixed.VOCAB_LIMIT} tokens")
    return word_counts(docs, text, "vocab_word").orderBy(F.desc("n"), "token").limit(k)


def number_tokens(vocab: DataFrame, order: list[Column], start: Column | int) -> DataFrame:
    """``(token, id)`` with ids from ``start`` in the given order.

    A vocabulary is a model parameter of at most VOCAB_LIMIT rows, so one window over it is bounded.
    """
    start = F.lit(start) if isinstance(start, int) else start
    rank = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*order))
    return vocab.select("token", (rank - 1 + start).cast("long").alias("id"))


def train_vocab(docs: DataFrame, k: int, text: str = "text", max_chars: int = fixed.MAX_TOKEN_CHARS) -> DataFrame:
    """The k most frequent substrings of words, at most ``max_chars`` long, as ``(token, n)``.

    Substrings come from distinct words with their counts, not from the corpus.
    """
    words = word_counts(docs, text).withColumn("_len", F.length("token"))
    starts = words.select("token", "n", "_len", F.explode(F.sequence(F.lit(1), F.col("_len"))).alias("_from"))
    longest = F.least(F.lit(max_chars), F.col("_len") - F.col("_from") + 1)
    parts = starts.select("token", "n", "_from", F.explode(F.sequence(F.lit(1), longest)).alias("_size"))
    return (
        parts.groupBy(F.substring("token", F.col("_from"), F.col("_size")).alias("token"))
        .agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(k)
    )


def symbol_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """Distinct words as a run of bracketed symbols, first one per character, with counts.

    Words of one character have no pair and are left out.
    """
    return word_counts(docs, text).where(F.length("token") > 1).select("token", as_symbols(F.col("token")).alias("symbols"), "n")


def as_symbols(word: Column) -> Column:
    """A word as a run of bracketed characters."""
    return F.regexp_replace(word, r"(?s)(.)", f"{OPEN}$1{CLOSE}")


def symbol_list(symbols: Column) -> Column:
    return F.split(F.substring(symbols, F.lit(2), F.length(symbols) - 2), f"{CLOSE}{OPEN}")


def _pair(left: str, right: str) -> str:
    return f"{OPEN}{left}{CLOSE}{OPEN}{right}{CLOSE}"


def pair_counts(words: DataFrame) -> DataFrame:
    """Adjacent symbol pairs weighted by word count."""
    listed = words.select(symbol_list(F.col("symbols")).alias("_s"), "n").where(F.size("_s") > 1)
    sides = listed.select(
        F.slice("_s", F.lit(1), F.size("_s") - 1).alias("left"), F.slice("_s", F.lit(2), F.size("_s") - 1).alias("right"), "n"
    )
    pairs = sides.select(F.explode(F.arrays_zip("left", "right")).alias("_p"), "n")
    return pairs.groupBy("_p.left", "_p.right").agg(F.sum("n").alias("n"))


def next_merges(best: list[tuple[str, str, int]], complete: bool, most: int) -> list[tuple[str, str, int]]:
    """The first pairs of a ranking that are merged one after the other whatever the earlier ones change.

    ``best`` are pairs by falling count, then by text; ``complete`` says that there are no others. A merge of (a, b) changes only pairs that
    end in a or begin with b. As long as no such pair stands before the next one, none of what the merge makes can pass that
    next one: it is not more frequent than the pair it is made of. Where it could be as frequent, the order by text decides,
    so the run ends before such a tie, and after a pair of equal sides, which changes itself.
    """
    taken, lefts, rights = [], set(), set()
    for at, (left, right, n) in enumerate(best[:most]):
        tied = [p for p in best[at + 1 :] if p[2] == n]
        unseen = not complete and best[-1][2] == n
        if taken and (left in rights or right in lefts or unseen or any(p[0] in rights for p in tied)):
            break
        taken.append((left, right, n))
        lefts.add(left)
        rights.add(right)
        if left == right:
            break
    return taken


def merge_rounds(docs: DataFrame, rounds: int, text: str = "text", keep_every: int = 4, ranked: int = 1024) -> DataFrame:
    """Learned merges ``(round, left, right, n)``, most frequent pair first, ties by pair.

    Pairs are counted once over the distinct words. Then each job applies a run of merges that do not touch each other
    (`next_merges`) and counts anew only the words that hold one of them: what these words lose and gain is added to the table
    of counts. The driver sees the ``ranked`` best pairs of a job, words and counts stay in tables.
    """
    shared_folder(docs.sparkSession)
    words = symbol_words(docs, text).drop("token").checkpoint()
    counts = pair_counts(words).checkpoint()
    merges: list[tuple[str, str, int]] = []
    jobs = 0
    while len(merges) < rounds:
        best = [tuple(r) for r in counts.orderBy(F.desc("n"), "left", "right").limit(ranked).collect()]
        run = next_merges(best, len(best) < ranked, rounds - len(merges))
        if not run:
            break
        merges += run
        jobs += 1
        merged, hit = F.col("symbols"), F.lit(False)
        for left, right, _ in run:
            merged = F.replace(merged, F.lit(_pair(left, right)), F.lit(f"{OPEN}{left}{right}{CLOSE}"))
            hit = hit | F.contains(F.col("symbols"), F.lit(_pair(left, right)))
        touched = words.where(hit)
        gone = pair_counts(touched).withColumn("n", -F.col("n"))
        new = pair_counts(touched.withColumn("symbols", merged))
        changed = counts.unionByName(gone).unionByName(new).groupBy("left", "right").agg(F.sum("n").alias("n"))
        counts = changed.where("n > 0").checkpoint()
        words = words.withColumn("symbols", merged)
        if jobs % keep_every == 0:
            words = words.checkpoint()
    rows = [(i, *m) for i, m in enumerate(merges, 1)]
    return docs.sparkSession.createDataFrame(rows, "round long, left string, right string, n long")


def encode_words(words: DataFrame, merges: DataFrame) -> DataFrame:
    """``(token, symbols)``: each distinct word of ``words`` (token) cut by learned merges, lowest round first.

    In each round every word that holds a learned pair merges its lowest one, at all its places; a word without any is
    done and stays behind. Pairs meet the merges, which are at most VOCAB_LIMIT rows, in a broadcast join, so there are as many rounds as the
    longest word has merges, over fewer and fewer words.
    """
    shared_folder(words.sparkSession)
    known = F.broadcast(merges.select("round", "left", "right").limit(fixed.VOCAB_LIMIT))
    active = words.select("token", as_symbols(F.col("token")).alias("symbols")).distinct().checkpoint()
    done = []
    while True:
        sides = active.select("token", "symbols", symbol_list(F.col("symbols")).alias("_s"))
        pairs = F.arrays_zip(F.col("_s").alias("left"), F.slice("_s", F.lit(2), F.size("_s")).alias("right"))
        listed = sides.where(F.size("_s") > 1).select("token", F.inline(pairs))
        lowest = listed.join(known, ["left", "right"]).groupBy("token").agg(F.min(F.struct("round", "left", "right")).alias("_m"))
        found = active.join(lowest, "token", "left").checkpoint()
        done.append(found.where("_m is null").select("token", "symbols"))
        pair = F.concat(F.lit(OPEN), "_m.left", F.lit(CLOSE + OPEN), "_m.right", F.lit(CLOSE))
        both = F.concat(F.lit(OPEN), "_m.left", "_m.right", F.lit(CLOSE))
        active = found.where("_m is not null").select("token", F.replace("symbols", pair, both).alias("symbols"))
        if active.isEmpty():
            break
    return reduce(DataFrame.unionByName, done).select("token", symbol_list(F.col("symbols")).alias("symbols"))


def is_digit_token(token: Column) -> Column:
    """Holds a digit and nothing but digits and marks."""
    return token.rlike("[0-9]") & token.rlike(DIGITS_ONLY)


def merge_vocab(base: DataFrame, new: DataFrame) -> DataFrame:
    """Base ids stay; unseen tokens follow after the largest id, in the order of their first ids."""
    unseen = new.join(base.select("token"), "token", "left_anti").where(~is_digit_token(F.col("token")))
    top = base.agg(F.max("id") + 1).scalar()
    return base.select("token", F.col("id").cast("long").alias("id")).unionByName(
        number_tokens(unseen, [F.col("id"), F.col("token")], top)
    )


def merge_rules(vocab: DataFrame) -> DataFrame:
    """Every way to split a token into two other tokens, except two digit tokens.

    One row per token and split point, and equi-joins on the halves; a token has few characters.
    """
    splits = vocab.where(F.length("token") > 1).select(
        "token", F.explode(F.sequence(F.lit(1), F.length("token") - 1)).alias("at")
    ).select(
        "token", F.substring("token", F.lit(1), F.col("at")).alias("left"),
        F.substring("token", F.col("at") + 1, F.length("token")).alias("right"),
    )
    halves = vocab.select("token")
    found = splits.join(halves.withColumnRenamed("token", "left"), "left", "left_semi").join(
        halves.withColumnRenamed("token", "right"), "right", "left_semi"
    )
    both_digits = is_digit_token(F.col("left")) & is_digit_token(F.col("right"))
    return found.where(~both_digits).select("token", F.concat_ws(" ", "left", "right").alias("merge"))


def sft_vocab(docs: DataFrame, k: int, text: str = "text") -> DataFrame:
    """Special tokens, then the k most frequent words."""
    spark = docs.sparkSession
    special = spark.createDataFrame([(t, i) for i, t in enumerate(SPECIAL_TOKENS)], "token string, id long")
    return special.unionByName(number_tokens(top_words(docs, k, text), [F.desc("n"), F.col("token")], len(SPECIAL_TOKENS)))


def sft_tokens(conversation: Column, max_len: int, system_text: str = fixed.SYSTEM_SFT) -> Column:
    """array<struct<token, label>> of a conversation, padded and cut to ``max_len``.

    The system block and the user texts carry no label. A leading turn of another role than user is left out; a
    leading system turn gives the system text.
    """
    def piece(token: Column, kept: bool) -> Column:
        return F.struct(token.alias("token"), F.lit(kept).alias("label"))

    def mark(token: str, kept: bool) -> Column:
        return piece(F.lit(token), kept)

    def block(head: list[Column], value: Column, kept: Column | bool) -> Column:
        body = F.transform(tokens(F.coalesce(value, F.lit("")), "vocab_word"), lambda t: F.struct(
            t.alias("token"), (F.lit(kept) if isinstance(kept, bool) else kept).alias("label")))
        return F.concat(F.array(mark(IM_START, True), *head), body, F.array(mark(IM_END, True), mark(LINE, True)))

    def dialogue(t: Column) -> Column:
        role = piece(t["from"], False)
        return block([role, mark(LINE, False)], t["value"], t["from"] == "assistant")

    first = F.try_element_at(conversation, F.lit(1))
    system = F.when(first["from"] == "system", first["value"]).otherwise(F.lit(system_text))
    rest = F.when(first["from"] == "user", conversation).otherwise(
        F.slice(conversation, F.lit(2), F.greatest(F.size(conversation), F.lit(1)))
    )
    whole = F.concat(block([mark("system", False), mark(LINE, False)], system, False), F.flatten(F.transform(rest, dialogue)))
    padding = F.array_repeat(mark(PAD, False), F.greatest(F.lit(max_len) - F.size(whole), F.lit(0)))
    return F.slice(F.concat(whole, padding), 1, max_len)


def has_late_system(conversation: Column) -> Column:
    """A system turn after the first turn: no sample can be built."""
    tail = F.slice(conversation, F.lit(2), F.greatest(F.size(conversation), F.lit(1)))
    return F.exists(tail, lambda t: ~t["from"].isin("user", "assistant"))


def sft_encode(conversations: DataFrame, vocab: DataFrame, max_len: int, id: str = "id") -> tuple[DataFrame, DataFrame]:
    """(samples, rejects). Samples hold ``input_ids``, ``labels`` and ``attention_mask`` of length ``max_len``.

    Sequences are cut before their tokens are joined to ids, so at most ``max_len`` rows meet again per sample. The
    vocabulary has at most VOCAB_LIMIT rows of MAX_TOKEN_CHARS (`top_words`), so it is broadcast.
    """
    late = has_late_system(F.col("conversation"))
    rejects = conversations.where(late)
    unknown, pad = SPECIAL_TOKENS.index(UNKNOWN), SPECIAL_TOKENS.index(PAD)
    listed = conversations.where(~late).select(id, F.posexplode(sft_tokens(F.col("conversation"), max_len)).alias("pos", "_t"))
    coded = listed.select(id, "pos", "_t.token", "_t.label").join(
        F.broadcast(vocab.withColumnRenamed("id", "_id")), "token", "left"
    ).withColumn("_id", F.coalesce("_id", F.lit(unknown)).cast("int"))
    rows = F.array_sort(F.collect_list(F.struct("pos", "_id", "label")))
    grouped = coded.groupBy(id).agg(rows.alias("_r"))
    samples = grouped.select(
        id,
        F.transform("_r", lambda r: r["_id"]).alias("input_ids"),
        F.transform("_r", lambda r: F.when(r["label"], r["_id"]).otherwise(fixed.IGNORE_LABEL)).alias("labels"),
        F.transform("_r", lambda r: r["_id"] != pad).alias("attention_mask"),
    )
    return samples, rejects
