"""Exact dedup, Jaccard join and span dedup against plain versions, and on odd rows."""

import random
import re

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from corpusloom.llm import exact_dedup, graph, jaccard_join, span_dedup

DOCS = "doc_id long, text string, row string, name string, n long"
LONG = " ".join(f"w{i}" for i in range(5000))


def frame(spark, texts):
    """Rows with extra columns whose names clash with those used inside."""
    return spark.createDataFrame([(i, t, "r", "x", 1) for i, t in texts], DOCS)


ODD = [(5, None), (1, ""), (2, "a  b\tc"), (3, "a b c"), (4, " a b c"), (6, LONG), (7, LONG + " "), (8, LONG), (9, "\n\n"), (10, " "), (None, "a b c")]


def plain_exact(rows):
    norm = [(i, re.sub("[\x20\x09-\x0d]+", " ", t or "")) for i, t in rows]
    groups = {}
    for i, t in norm:
        groups.setdefault(t, []).append(i)
    return sorted(((i, min(x for x in groups[t] if x is not None), len(groups[t])) for i, t in norm), key=str)


@pytest.mark.parametrize("size", [3, 16_384])
@pytest.mark.parametrize("weak", [False, True])
def test_exact(spark, size, weak):
    key = (lambda b: F.octet_length(b).cast("long") % 2) if weak else F.xxhash64
    rows = ODD if size > 3 else [(i, (t or "")[:40] if t else t) for i, t in ODD]
    got = exact_dedup.exact_duplicates(frame(spark, rows), block_bytes=size, key=key).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in got), key=str) == plain_exact(rows)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_exact_repeated_rows_and_empty(spark):
    got = exact_dedup.exact_duplicates(frame(spark, [(1, "x"), (1, "x"), (1, "x")])).collect()
    assert [r.kept for r in got].count(True) == 1 and {r.group_size for r in got} == {3}
    assert exact_dedup.exact_duplicates(frame(spark, [])).count() == 0


@pytest.mark.parametrize("hot_rows", [10, 1_000_000])
def test_components(spark, hot_rows):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(50, 60), (60, 70), (70, 70)], "a long, b long")
    got = {r.node: r.component for r in graph.components(links, hot_rows).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {50: 50, 60: 50, 70: 50}


def test_components_with_a_hub(spark):
    """A node with most of the links, and two that meet only through it."""
    pairs = [(i, 500) for i in range(2, 400)] + [(500, 900), (900, 1), (1000, 1001)]
    links = spark.createDataFrame([(f"n{a:04}", f"n{b:04}") for a, b in pairs], "a string, b string")
    got = {r.node: r.component for r in graph.components(links, 50).collect()}
    assert got == {f"n{i:04}": "n0001" for i in [*range(1, 400), 500, 900]} | {"n1000": "n1000", "n1001": "n1000"}


@pytest.mark.parametrize("hot_rows", [10, 1_000_000])
def test_components_keep_a_small_size_estimate(spark, capsys, hot_rows):
    """Sizes that Spark estimates for a long chain's labels stay those of a few rows; they had 1,779 digits after five rounds."""
    links = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    labels = graph.components(links, hot_rows)
    capsys.readouterr()
    labels.explain("cost")
    sizes = re.findall(r"sizeInBytes=([^,)]+)", capsys.readouterr().out)
    assert sizes and all(re.fullmatch(r"[\d.]+ K?i?B", s) for s in sizes)


def test_components_are_not_broadcast_by_the_size_of_their_files(spark, capsys):
    """Labels pack into few bytes, so Spark would send a long list of them to every task; the rounds' joins say otherwise.
    Few links are in one partition, so nothing is shuffled either."""
    plans, write = [], DataFrameWriter.parquet

    def spy(self, *a, **b):
        self._df.explain()
        plans.append(capsys.readouterr().out)
        return write(self, *a, **b)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(DataFrameWriter, "parquet", spy)
        graph.components(spark.createDataFrame([(i, i + 1) for i in range(9)], "a long, b long"))
    assert len(plans) > 2 and not any("Exchange" in p for p in plans)


def plain_near(rows, k=4, percent=85):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    low = {i: i for i in sets}
    change = True
    near = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while change:
        change = False
        for a, b in near:
            m = min(low[a], low[b])
            change |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    return {i: (len(sets[i]), low[i]) for i in sets}


def edited(rng, words, share):
    return " ".join(rng.choice(["zz", "yy", "xx"]) + str(rng.randrange(99)) if rng.random() < share else w for w in words)


@pytest.mark.parametrize("rule", [jaccard_join.Rule(), jaccard_join.Rule(frequent=2, small=12, classes=8, broadcast_ids=0), jaccard_join.Rule(frequent=1, small=6, classes=3, pivot_rounds=1)])
def test_near_equals_all_pairs(spark, rule):
    rng = random.Random(4)
    rows = []
    for g in range(6):
        base = [f"g{g}w{rng.randrange(400)}" for _ in range(rng.choice([6, 40, 120, 400]))]
        rows += [(len(rows) + j, edited(rng, base, rng.choice([0, 0.002, 0.01, 0.02]))) for j in range(rng.choice([1, 8, 40]))]
    shared = " ".join(f"common{i}" for i in range(60))
    for j in range(30):
        rows.append((len(rows), shared + " " + " ".join(f"own{j}x{i}" for i in range(rng.randrange(90)))))
    rows += [(1000, None), (1001, ""), (1002, "One"), (1003, "one"), (1004, " \n "), (1005, "a b c"), (1006, "A  B c"), (1007, LONG), (1008, LONG + " end")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(frame(spark, rows), rule=rule).collect()}
    assert got == plain_near(rows)


def test_long_words_and_text_ids(spark):
    """Words beyond every table of the hash, told apart though bytes far from each other are exchanged; ids that are texts."""
    rng = random.Random(11)
    long = bytearray(rng.choices(b"abcdefghij", k=20_000))
    rows = [("a0", long.decode())]
    for i, (p, q) in enumerate([(0, 4096), (17, 17 + 8192), (4095, 4096), (9000, 9001), (100, 19_999)]):
        other = bytearray(long)
        other[p], other[q] = other[q], other[p]
        rows.append((f"b{i}", other.decode() if other != long else other.decode() + "x"))
    rows += [("c1", "one two three four five"), ("c0", "ONE two  three four five"), ("d", None), (None, "one two three four five")]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id string, text string, token int, sig int")
    got = {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(docs).collect()}
    assert got == {i: i for i, _ in rows} | {"c1": "c0"}


@pytest.mark.parametrize("rule", [jaccard_join.Rule(probe=0), jaccard_join.Rule(k=1, percent=60, small=30, classes=8)])
def test_no_set_with_a_link_is_left_out(spark, rule):
    """At the edge of the similarity, where a set just has enough in common with one other."""
    rng = random.Random(rule.probe + rule.k)
    rows = []
    for n in [1, 2, 3, 5, 6, 7, 8, 13, 20, 29, 57, 101]:
        base = [f"w{n}x{i}" for i in range(n + rule.k - 1)]
        at = rng.randrange(len(base) + 1)
        for lost in range(0, n // 4 + 1):
            rows.append((len(rows), " ".join(base[:at] + [f"new{len(rows)}x{i}" for i in range(lost)] + base[at:])))
            rows.append((len(rows), " ".join(base[: max(1, len(base) - lost)])))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(frame(spark, rows), rule=rule).collect()}
    assert got == plain_near(rows, rule.k, rule.percent)


def test_near_empty_and_repeated(spark):
    assert jaccard_join.near_duplicates(frame(spark, [])).count() == 0
    got = jaccard_join.near_duplicates(frame(spark, [(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (2, "a b c d e")])).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == [("1", "1"), ("1", "1"), ("2", "1"), ("None", "None")]


def test_far_copies_of_one_text_are_not_compared_pair_by_pair(spark, monkeypatch):
    """Copies with too many words of their own for any link, beside linked ones; one id has two texts."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]

    def copy(j, edits):
        at = set(rng.sample(range(0, 300, 5), edits))
        return " ".join(f"own{j}x{i}" if i in at else w for i, w in enumerate(base))

    rows = [(j, copy(j, 8)) for j in range(1, 81)] + [(j, copy(j, j % 3)) for j in range(81, 90)]
    pair = [f"p{i}" for i in range(200)]
    rows += [(100, " ".join(pair)), (101, " ".join([*pair[:-1], "end"])), (101, " ".join(f"q{i}" for i in range(900)))]
    compared, verified = [], jaccard_join._verified

    def counted(sets, pairs, rule):
        compared.append(pairs.count())
        return verified(sets, pairs, rule)

    monkeypatch.setattr(jaccard_join, "_verified", counted)
    got = {(r.doc_id, r.n_shingles): r.component_id for r in jaccard_join.near_duplicates(frame(spark, rows)).collect()}
    want = {(i, n): c for i, (n, c) in plain_near(rows[:-1]).items()} | {(101, 897): 100}
    assert got == want and sum(compared) < 3 * len(rows)


PASSAGE = "The first line of the passage has nine words. " + " ".join(f"Sentence {c} says that one more thing is so." for c in "abcdef")


def test_spans_repeat_across_documents(spark):
    own = lambda j: " ".join(f"Text {j} has its own {c}{j} words here." for c in "pqrst")
    rows = [(3, own(3) + " " + PASSAGE + " " + own(33)), (1, own(1) + " And. " + PASSAGE), (2, own(2)), (4, own(4) + "\n" + PASSAGE.upper()), (5, None), (6, ""), (7, "Short.")]
    got = {r.doc_id: r for r in span_dedup.drop_repeated_spans(frame(spark, rows)).collect()}
    assert got[1].n_removed == 0 and got[1].text == rows[1][1] and got[2].text == rows[2][1]
    assert got[3].n_removed == 7 and got[3].text == own(3) + " " + own(33)
    assert got[4].n_removed == 7 and got[4].text == own(4) + "\n"
    assert got[3].removed_chars == len(PASSAGE) + 1
    assert (got[5].text, got[6].text, got[7].text) == ("", "", "Short.")


def test_spans_without_marks_and_in_one_text(spark):
    stream = " ".join(f"tok{i * 7919 % 1009}" for i in range(120))
    rows = [(1, "head one " + stream), (2, "quite another start " + stream + " tail"), (3, LONG), (4, "It is so. " * 40)]
    got = {r.doc_id: r for r in span_dedup.drop_repeated_spans(frame(spark, rows)).collect()}
    assert got[1].n_removed == 0 and got[3].n_removed == 0
    assert got[2].removed_chars > 0.6 * len(stream)
    assert 0 < got[4].n_removed < 40
    assert span_dedup.drop_repeated_spans(frame(spark, [])).count() == 0


def test_passages_at_any_offset_hold_a_span(spark):
    """All passages of 50 to 60 words are found; of their words, more than half go."""
    rng = random.Random(6)
    own = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    rows, sizes = [], {}
    for i in range(200):
        source = [w + (rng.choice(["", "."]) if i % 2 and not j % 35 else "") for j, w in enumerate(own(300))]
        at, n = rng.randrange(200), 50 + i % 11
        rows += [(i, " ".join(source)), (1000 + i, " ".join(own(rng.randrange(60)) + source[at : at + n] + own(rng.randrange(60))))]
        sizes[1000 + i] = n
    whole = own(35)
    whole[-1] += "."
    for i in (500, 1500):
        rows.append((i, " ".join([*own(20), "a1", "a2", "a3", "a4", "a5", "a6", "a7", "a8.", *whole, "c1", "c2", "c3", "c4", "c5", "c6", "c7", "c8", *own(20)])))
    got = {r.doc_id: r for r in span_dedup.drop_repeated_spans(frame(spark, rows)).collect()}
    assert all(r.n_removed == 0 for i, r in got.items() if i < 1000) and all(got[i].n_removed >= 2 for i in [*sizes, 1500])
    text = dict(rows)
    gone = {i: len(text[i].split()) - len(got[i].text.split()) for i in sizes}
    assert all(15 <= gone[i] <= n for i, n in sizes.items())
    print("share of the passages' words removed:", round(sum(gone.values()) / sum(sizes.values()), 3))
    assert sum(gone.values()) > 0.5 * sum(sizes.values())


def plain_spans(rows, rule=span_dedup.Spans()):
    """Sentences left of each text: of equal shortest runs that are long enough, only the first place keeps its sentences."""
    parts = {i: [p for p in re.findall(r"[^.!?\n]*[.!?\n]\s*|[^.!?\n]+$", t or "") if p.strip()] for i, t in rows}
    places = {}
    for i, own in parts.items():
        words = [p.lower().split() for p in own]
        for a in range(len(own)):
            for b in range(a + rule.sentences, len(own) + 1):
                run = sum(words[a:b], [])
                if len(run) >= rule.words:
                    places.setdefault(tuple(run), []).append((i, a, b))
                    break
    gone = {(i, k) for found in places.values() for i, a, b in sorted(found)[1:] for k in range(a, b)}
    return {i: ["".join(p.split()) for k, p in enumerate(own) if (i, k) not in gone] for i, own in parts.items()}


@pytest.mark.parametrize("filter_words", [0, 64, 1 << 20])
def test_spans_equal_brute_force(spark, monkeypatch, filter_words):
    """Without the filter, with one of 64 words, and with the whole one; one passage is in every second text."""
    monkeypatch.setattr(span_dedup, "FILTER_WORDS", filter_words)
    rng = random.Random(3)
    pool = [" ".join(f"{rng.choice('abcd')}{rng.randrange(99)}" for _ in range(rng.randrange(1, 11))) + rng.choice(".!?") for _ in range(120)]
    rows = [(i, " ".join(rng.choices(pool, k=rng.randrange(12))) + (" " + " ".join(pool[:6]) if i % 2 else "") + " " + " ".join(rng.sample(pool, 3))) for i in range(60)]
    rows += [(90, None), (91, ""), (92, " \n ")]
    got = {r.doc_id: "".join(r.text.split()) for r in span_dedup.drop_repeated_spans(frame(spark, rows)).collect()}
    want = plain_spans(rows)
    assert got == {i: "".join(left) for i, left in want.items()} and any(got[i] != "".join((t or "").split()) for i, t in rows)


def test_rows_of_one_id_are_told_apart(spark):
    got = span_dedup.drop_repeated_spans(frame(spark, [(1, PASSAGE), (1, PASSAGE), (1, "Other text."), (None, "No id.")])).collect()
    assert sorted(r.text for r in got) == sorted([PASSAGE, PASSAGE, "Other text.", "No id."])
