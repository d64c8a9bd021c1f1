"""Texts whose shingle sets have a high Jaccard similarity, by token-combination prefixes.

Tokens have one global order: rare ones by hash, then frequent ones by hash. Two sets that overlap in o tokens share one
of their first ``n - o + 1``, so a rare token in that prefix is a signature by itself. Frequent tokens fall into classes;
the prefix is extended by one token per class in it, and pairs of tokens of one class are the signatures: of that many
shared tokens, two must share a class. The number of classes grows with a set's size, so a set of n tokens has at most
in the order of n signatures. Sets too small to be extended use single tokens. Sizes that may meet partners of the tier
below carry the signatures of both tiers.

Equal sets are joined first and go on as one. Then sets without any partner are left out, by a longer prefix: of a set's
first q tokens by hash, all but the ``prefix - 1`` that it may lack are in any partner, among that one's first
tokens too. So a set of whose first q tokens too few are met in a second set has no link. What is left are copies, edited texts and
texts of shared passages, and only their sets are indexed; their number grows with the corpus, not with its square.

Tokens that no other of these sets has are in no link. Each set's others bound what it may share with any set, and sets (then
pairs) of a bucket that this bound rules out are not compared: copies of one text that were edited too much each for itself have
nearly all signatures in common, and are ruled out alone. Before the last comparison only tokens met in another component count.

In a bucket of sets with one signature, all are compared to a pivot (in the first rounds each
set to one pivot only, the first of all its buckets), and linked sets are joined; only buckets whose sets are then still apart are compared further, first by more pivots, last pair
by pair. A link within one component cannot change a component, hence is not looked for. Every pair is first bounded by the
smallest hashes of both sets, then verified on the whole sets.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import TASK_ROWS, map_arrow, per_text, settle, small_side, without
from corpusloom.llm.graph import components
from corpusloom.llm.hashing import mix, shingle_sets


@dataclass(frozen=True)
class Rule:
    """Two sets link when ``100 * shared >= percent * union``. A token is frequent when more than ``frequent`` of the sets
    that may have a partner have it. Sets below ``small`` tokens use single tokens; the tier of ``small * 4**t`` and more has
    ``classes * 4**t`` classes (``small`` must be at least ``classes * 100 / percent + 2``)."""

    k: int = 4
    percent: int = 85
    frequent: int = 8
    small: int = 80
    classes: int = 64
    single_rounds: int = 2
    pivot_rounds: int = 5
    pairs_a_row: int = 8  # of open buckets, left to compare for each row of them, from which on pairs are compared
    broadcast_ids: int = 200_000
    probe: int = 60  # tokens beyond the prefix that are looked up to leave sets out, in percent of the prefix


def prefix_size(n, percent: int):
    """Tokens of n of which a partner must share one: n - ceil(percent * n / 100) + 1."""
    return n - (percent * n + 99) // 100 + 1


def probe_size(n: int, rule: Rule) -> int:
    """Tokens, by hash, that a set of n looks up: its prefix and ``probe`` percent more."""
    p = prefix_size(n, rule.percent)
    return min(n, p + -(-p * rule.probe // 100))


def reach_size(n: int, rule: Rule) -> int:
    """Tokens, by hash, among which a set of n holds whatever it shares with the probe of any partner.

    A partner has at most n * 100 / percent tokens. A token of its probe is here after at most the shared part of that probe and the
    ``prefix - 1`` tokens that this set has and the partner lacks.
    """
    return min(n, probe_size(100 * n // rule.percent, rule) + prefix_size(n, rule.percent) - 1)


def _tiers(n: int, rule: Rule) -> list[int]:
    """The tier of a set of n tokens and, if a smaller partner can be in the tier below, that one; -1 is single tokens."""
    tier = -1
    while n >= rule.small * 4 ** (tier + 1):
        tier += 1
    least = rule.small * 4**tier if tier >= 0 else 0
    below = tier >= 0 and rule.percent * n < 100 * least + rule.percent
    return [tier, tier - 1] if below else [tier]


def signatures(rare: np.ndarray, frequent: np.ndarray, n: int, rule: Rule) -> np.ndarray:
    """Signatures of a set of n tokens whose first tokens in the global order are ``rare``, then ``frequent``.

    Either ``rare`` alone reaches the prefix, or both hold the whole set.
    """
    need = prefix_size(n, rule.percent)
    if len(rare) >= need:
        return rare[:need]
    out = [rare]
    for tier in _tiers(n, rule):
        if tier < 0:
            out.append(frequent[: need - len(rare)])
            continue
        classes = rule.classes * 4**tier
        group = (mix(frequent.view(np.uint64)) % np.uint64(classes)).astype(np.int64)
        # extend until the tokens exceed the prefix by the number of classes among them
        _, first = np.unique(group, return_index=True)
        new = np.zeros(len(group), np.int64)
        new[first] = 1
        spare = np.arange(1, len(group) + 1) - np.cumsum(new)
        end = int(np.searchsorted(spare, need - len(rare))) + 1
        token, group = frequent[:end], group[:end]
        order = np.lexsort((token, group))
        token, group = token[order].view(np.uint64), group[order]
        edges = np.r_[np.flatnonzero(np.r_[True, group[1:] != group[:-1]]), len(group)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if b - a > 1:
                i, j = np.triu_indices(b - a, 1)
                both = mix(token[a:b][i] * np.uint64(3) + np.uint64(tier)) + token[a:b][j]
                out.append(mix(both).view(np.int64))
    return np.unique(np.concatenate(out))


def _set_rows(docs: DataFrame, rule: Rule) -> DataFrame:
    """Size and identity of each text's set."""
    def work(texts: list[bytes]) -> dict:
        sets = shingle_sets(texts, rule.k)
        wrap = lambda a: int(np.asarray(a, np.uint64).sum(dtype=np.uint64).view(np.int64))
        return {
            "n": [len(s) for s in sets],
            "sum_a": [wrap(mix(s.view(np.uint64))) for s in sets],
            "sum_b": [wrap(mix(s.view(np.uint64) + np.uint64(77)) * np.uint64(5)) for s in sets],
        }

    return per_text(docs, ["row"], "text", {"n": "long", "sum_a": "long", "sum_b": "long"}, work)


def _first_tokens(docs: DataFrame, rule: Rule, size: Callable[[int, Rule], int]) -> DataFrame:
    """(row, n, head): the size and the smallest hashes of each text's set."""
    def work(texts: list[bytes]) -> dict:
        sets = shingle_sets(texts, rule.k)
        return {"n": [len(s) for s in sets], "head": [s[: size(len(s), rule)] for s in sets]}

    return per_text(docs, ["row"], "text", {"n": "long", "head": "array<long>"}, work)


def _need(rule: Rule) -> Column:
    return F.expr(f"n - (({rule.percent} * n + 99) div 100) + 1")


def with_partners(docs: DataFrame, sizes: DataFrame, rule: Rule) -> DataFrame:
    """(row): the sets that may have a link; ``sizes`` has their (row, n).

    Only hashes are shuffled: once to find those met twice, which are summed in each task first, and once with their rows.
    """
    reach = _first_tokens(docs, rule, reach_size).select(F.explode("head").alias("token"))
    met = settle(reach.groupBy("token").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1").select("token"))
    probes = _first_tokens(docs, rule, probe_size).select("row", F.explode("head").alias("token"))
    found = probes.join(met, "token").groupBy("row").agg(F.count(F.lit(1)).alias("found"))
    beyond = F.ceil(_need(rule) * rule.probe / 100)  # probe tokens beyond the prefix, but for what the set has not
    enough = F.least(F.col("n") - _need(rule), beyond) + 1
    return settle(found.join(sizes, "row").where(F.col("found") >= enough).select("row").distinct())


def head_size(n: int, rule: Rule) -> int:
    """Smallest hashes that are kept of a set: a quarter more than the prefix, and two."""
    p = prefix_size(n, rule.percent)
    return p + p // 4 + 2


def _token_sets(docs: DataFrame, rule: Rule) -> DataFrame:
    """(row, tokens): each text's set."""
    return per_text(docs, ["row"], "text", {"tokens": "array<long>"}, lambda texts: {"tokens": shingle_sets(texts, rule.k)})


def _whole_sets(docs: DataFrame, ids: DataFrame, rule: Rule) -> DataFrame:
    """(row, tokens) of the texts with these rows. Few ids are broadcast, so texts stay where they lie; many are joined."""
    few = ids.count() <= rule.broadcast_ids
    some = docs.join(F.broadcast(ids) if few else ids, "row", "left_semi")
    return _token_sets(some, rule)


def _often(sets: DataFrame, tokens: str, frequent: DataFrame, few: bool) -> DataFrame:
    """Adds ``often``: the frequent ones of each set's tokens. A short list goes to every task; a long one is joined."""
    if not few:
        marked = sets.select("row", F.explode(tokens).alias("token")).join(frequent, "token").groupBy("row").agg(F.collect_list("token").alias("often"))
        return settle(sets.join(marked, "row", "left").withColumn("often", F.coalesce("often", F.array().cast("array<bigint>"))))
    listed = sets.sparkSession.sparkContext.broadcast(np.sort(frequent.toPandas()["token"].to_numpy(np.int64)))
    place, columns = sets.columns.index(tokens), ", ".join(f"{c} {t}" for c, t in sets.dtypes)

    def work(batches):
        for batch in batches:
            column, known = batch.column(place), listed.value
            flat = column.flatten().to_numpy()
            hit = known[np.minimum(np.searchsorted(known, flat), len(known) - 1)] == flat if len(known) else np.zeros(len(flat), bool)
            upto = np.r_[0, np.cumsum(hit)]
            offsets = column.offsets.to_numpy() - column.offsets[0].as_py()
            often = pa.ListArray.from_arrays(pa.array(upto[offsets].astype(np.int32)), pa.array(flat[hit]))
            yield pa.RecordBatch.from_arrays([*batch.columns, often], names=[*batch.schema.names, "often"])

    return map_arrow(sets, work, f"{columns}, often array<bigint>")


def _may_link(n: Column, m: Column, most: Column, other: Column, rule: Rule) -> Column:
    """Whether sets of n and m tokens that share at most ``most`` and ``other`` of them with any set may be similar enough."""
    return (100 + rule.percent) * F.least(most, other) >= rule.percent * (n + m)


def _indexed(docs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """(sig, row, n, most): the signatures of every set that has tokens and may have a link; ``most`` is how many others may share.

    A token met in one set only is in no link, so it counts as lacking on either side before sets are compared.
    """
    # counted over whole sets: the smallest hashes alone would miss most of the tokens that shared passages make frequent
    tokens = _token_sets(docs, rule).select("row", F.explode("tokens").alias("token"))
    met = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("sets"), F.min("row").alias("row")).where((F.col("sets") == 1) | (F.col("sets") > rule.frequent))
    single = F.col("sets") == 1
    met = settle(met.select(F.when(single, F.col("row")).alias("row"), F.when(~single, F.col("token")).alias("token")).groupBy("row", "token").agg(F.count(F.lit(1)).alias("own")))
    frequent = met.where("token is not null").select("token")
    few = frequent.count() <= rule.broadcast_ids  # 8 bytes each
    # an id with several sets has one count for all of them, which bounds none
    repeated = small_side(settle(sets.groupBy("row").count().where("count > 1").select("row")))
    own = met.where("token is null").select("row", "own").join(repeated, "row", "left_anti")
    sets = sets.join(own, "row", "left").withColumn("most", F.col("n") - F.coalesce("own", F.lit(0))).where(100 * F.col("most") >= rule.percent * F.col("n"))
    sets = settle(sets.select("row", "n", "most", "head"))
    need = _need(rule)
    parted = _often(sets, "head", frequent, few)
    parted = parted.select("row", "n", "most", F.when(F.size("often") == 0, F.col("head")).otherwise(F.array_except("head", "often")).alias("rare"))
    plain = parted.where(F.size("rare") >= need).select("row", "n", "most", F.explode(F.slice("rare", F.lit(1), need.cast("int"))).alias("sig"))
    # too few rare tokens among the smallest: take the whole set and part it again
    whole = settle(_whole_sets(docs, settle(parted.where(F.size("rare") < need).select("row")), rule))
    again = _often(whole.select("row", "tokens"), "tokens", frequent, few)

    row_type = dict(docs.dtypes)["row"]

    def work(batches):
        for batch in batches:
            rows, at, sizes, found = batch.column(0), [], [], []
            for i, (tokens, often) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                tokens, often = np.array(tokens, np.int64), np.sort(np.array(often, np.int64))
                sig = signatures(np.setdiff1d(tokens, often, assume_unique=True), often, len(tokens), rule)
                at.append(np.full(len(sig), i))
                sizes.append(np.full(len(sig), len(tokens)))
                found.append(sig)
            if at:
                own = pa.array(np.concatenate(at))
                yield pa.RecordBatch.from_arrays([rows.take(own), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(found))], names=["row", "n", "sig"])

    more = settle(map_arrow(again.select("row", "tokens", "often"), work, f"row {row_type}, n long, sig long"))
    return plain.unionByName(more.join(sets.select("row", "n", "most").distinct(), ["row", "n"]))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("row")).unionByName(pairs.select(F.col("b").alias("row"))).distinct()


def _possible(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """Pairs (a, b) that the smallest hashes of both sets do not rule out.

    Up to the smaller of the two last hashes both heads are complete, so what is shared there is known; beyond it at most the
    rest of the smaller set can be.
    """
    heads = sets.join(small_side(settle(_ends(pairs))), "row", "left_semi")
    side = lambda x: heads.select(F.col("row").alias(x), F.col("n").alias(f"n_{x}"), F.col("head").alias(f"head_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    # heads are in rising order; the one that ends first counts whole
    last = lambda x: F.element_at(f"head_{x}", -1)
    upto = lambda x, y: F.when(last(x) <= last(y), F.size(f"head_{x}")).otherwise(F.size(F.filter(f"head_{x}", lambda h: h <= last(y))))
    rest = F.least(F.col("n_a") - upto("a", "b"), F.col("n_b") - upto("b", "a"))
    most = F.size(F.array_intersect("head_a", "head_b")) + rest
    return both.where((100 + rule.percent) * most >= rule.percent * (F.col("n_a") + F.col("n_b"))).select("a", "b")


def _verified(whole: DataFrame, pairs: DataFrame, rule: Rule) -> DataFrame:
    """Pairs that link; ``whole`` has the (row, tokens) of their sets at least."""
    side = lambda x: whole.select(F.col("row").alias(x), F.col("tokens").alias(f"t_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    shared = F.size(F.array_intersect("t_a", "t_b"))
    return both.where((100 + rule.percent) * shared >= rule.percent * (F.size("t_a") + F.size("t_b"))).select("a", "b")


def _outside(whole: DataFrame, parts: DataFrame) -> DataFrame:
    """(row, most): how many tokens of each set are in a set of another component, of the sets in ``parts`` (row, component)."""
    tokens = whole.join(parts, "row").select("row", "component", F.explode("tokens").alias("token"))
    shared = tokens.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("token")
    return tokens.join(shared, "token").groupBy("row").agg(F.count(F.lit(1)).alias("most"))


def _hopeful(buckets: DataFrame, rule: Rule) -> DataFrame:
    """Rows of buckets (sig, row, n, most and others) without those that may link with no set of the smallest size in their bucket."""
    low = buckets.groupBy("sig").agg(F.count(F.lit(1)).alias("sets"), F.min("n").alias("low")).where("sets > 1").select("sig", "low")
    least = F.greatest(F.col("low"), F.expr(f"({rule.percent} * n + 99) div 100"))
    return buckets.join(low, "sig").where((100 + rule.percent) * F.col("most") >= rule.percent * (F.col("n") + least)).select(*buckets.columns)


def link_sets(docs: DataFrame, sets: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """(links, components): verified links that connect all sets that links connect, and (node, component) of linked sets."""
    buckets = settle(_hopeful(_indexed(docs, sets, rule), rule))
    links = labels = whole = size = None
    for turn in range(rule.pivot_rounds + 1):
        order = F.struct(F.xxhash64("row", F.lit(turn)), "row", "n", "most")
        last = False
        if labels is None:
            open_buckets = buckets.withColumn("component", F.col("row"))
        else:
            named = buckets.join(small_side(labels.withColumnRenamed("node", "row")), "row", "left").withColumn("component", F.coalesce("component", "row"))
            apart = named.groupBy("sig").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("sig")
            open_buckets = settle(named.join(apart, "sig").select("sig", "row", "n", "most", "component"), size)
            size = open_buckets.count()
            if not size:
                break
            # what is joined stays joined, so only these buckets and sets are looked at from now on
            open_buckets = open_buckets.coalesce(1 + size // TASK_ROWS)
            buckets = open_buckets.drop("component")
            if whole is None:
                whole = settle(_whole_sets(docs, settle(buckets.select("row").distinct(), size), rule))
            # pairs left to compare, against rows: few enough, or the pivots have had their turns
            sizes = open_buckets.groupBy("sig", "component").agg(F.count(F.lit(1)).alias("m")).groupBy("sig").agg(
                F.sum("m").alias("all"), F.sum(F.col("m") * F.col("m")).alias("same"))
            left = sizes.agg(F.sum((F.col("all") * F.col("all") - F.col("same")) / 2)).first()[0]
            last = turn == rule.pivot_rounds or left <= rule.pairs_a_row * size
        if last:
            most = settle(_outside(whole, open_buckets.select("row", "component").distinct()), size)
            open_buckets = settle(_hopeful(open_buckets.drop("most").join(most, "row").repartition("sig"), rule))
            other = open_buckets.select("sig", F.col("row").alias("b"), F.col("n").alias("m"), F.col("most").alias("other"), F.col("component").alias("far"))
            pairs = open_buckets.withColumnRenamed("row", "a").join(other, "sig").where(
                (F.col("a") < F.col("b")) & (F.col("component") != F.col("far")) & _may_link(F.col("n"), F.col("m"), F.col("most"), F.col("other"), rule))
        else:
            pivots = settle(open_buckets.groupBy("sig").agg(F.min(order).alias("p"), F.min_by("component", order).alias("far")), size)
            pairs = open_buckets.join(pivots, "sig").where(
                (F.col("row") != F.col("p.row")) & (F.col("component") != F.col("far")) & _may_link(F.col("n"), F.col("p.n"), F.col("most"), F.col("p.most"), rule))
            if turn < rule.single_rounds:  # the first pivot of all of a row's buckets: one pair a row joins most of a large group
                pairs = pairs.groupBy("row").agg(F.min("p").alias("p"))
            pairs = pairs.select(F.least("row", "p.row").alias("a"), F.greatest("row", "p.row").alias("b"))
        pairs = settle(pairs.select("a", "b").distinct(), size)
        if whole is None:
            pairs = settle(_possible(pairs, sets, rule))
            compared = settle(_whole_sets(docs, settle(_ends(pairs)), rule))
        else:
            compared = whole
        found = settle(_verified(compared, pairs, rule))
        links = found if links is None else settle(links.unionByName(found), size)
        labels = components(links)
        if last:
            break
    return links, labels


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", rule: Rule = Rule()) -> DataFrame:
    """``(doc_id, n_shingles, component_id, class_id)``, a row per input row.

    ``class_id`` is the smallest id with the same set, ``component_id`` the smallest id that links reach. Texts without
    words, null ones included, have no set and stay alone; so do rows with a null id, which has no order. Ids may be of any type
    with an order (numbers, texts) and should be unique;
    rows with the same id count as one text each and share what either reaches. An empty table gives no rows.
    """
    source = docs.select(F.col(id).alias("row"), F.col(text).alias("text"))
    rows = settle(_set_rows(source, rule))
    same = ["n", "sum_a", "sum_b"]
    named = rows.where("n > 0 and row is not null")
    classes = settle(named.groupBy(*same).agg(F.min("row").alias("class")))
    copies = named.join(classes, same).where(F.col("row") != F.col("class")).select("row")
    leaders = without(source.where("row is not null"), copies, "row")
    kept = with_partners(leaders, named.select("row", "n"), rule)
    some = leaders.join(small_side(kept), "row", "left_semi")
    sets = settle(_first_tokens(some, rule, head_size).where("n > 0"))
    _, labels = link_sets(some, sets, rule)
    member = settle(classes.join(labels.withColumnRenamed("node", "class").hint("merge"), "class", "left").select(*same, "class", F.coalesce("component", "class").alias("component")))
    narrow = rows.select("row", *same)
    alone = F.expr("n = 0 or row is null")
    joined = narrow.where(~alone).join(member, same).select("row", "n", "component", "class").unionByName(
        narrow.where(alone).select("row", "n", F.col("row").alias("component"), F.col("row").alias("class")))
    return joined.select(F.col("row").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("class").alias("class_id"))
