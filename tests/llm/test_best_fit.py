"""Best-fit packing: whole documents, lengths, ids of the library, and what the local search gains."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from tokenizers import Tokenizer

from corpusloom.llm import best_fit, byte_bpe, queries
from test_text_ops import ODD, frame


def plain_best_fit(lengths, window):
    bins = []
    for length in sorted(lengths, reverse=True):
        fits = [b for b in bins if sum(b) + length <= window]
        if fits:
            max(fits, key=sum).append(length)
        else:
            bins.append([length])
    return bins


def test_best_fit_in_bulk_is_best_fit_one_by_one():
    rng = random.Random(1)
    for _ in range(200):
        lengths = rng.choices(range(1, 40), k=rng.randrange(1, 120))
        got = best_fit.best_fit(Counter(lengths), 40)
        want = plain_best_fit(lengths, 40)
        assert Counter(x for b, n in got.items() for k, c in b for x in [k] * c * n) == Counter(lengths)
        assert sorted(best_fit.fill(b) for b, n in got.items() for _ in range(n)) == sorted(map(sum, want))


def test_search_gains_and_keeps_everything():
    rng, saved = random.Random(2), 0
    for _ in range(60):
        counts = {k: rng.randrange(1, 30) for k in rng.sample(range(1, 100), rng.randrange(2, 25))}
        start = best_fit.best_fit(counts, 100)
        search = best_fit.Search(start, 100)
        squares = lambda: sum(n * best_fit.fill(b) ** 2 for kinds in (search.full, search.open) for b, n in kinds.items())
        last = squares()
        while search.step():
            assert squares() > last
            last = squares()
        assert all(search.best(g, [t for t in search.open if t != g]) is None for g in search.open if len(search.open) > 1)
        plan = best_fit.plan_bins(counts, 100)
        used = Counter()
        for times, bin in plan:
            assert sum(k * c for k, c in bin.items()) <= 100
            used.update({k: c * times for k, c in bin.items()})
        assert used == Counter(counts)
        bins = sum(t for t, _ in plan)
        assert -(-sum(k * c for k, c in counts.items()) // 100) <= bins <= sum(start.values())
        saved += sum(start.values()) - bins
    assert saved > 0
    assert best_fit.plan_bins({}, 100) == []


def check(rows, docs, path, window):
    """Every id of every document once, only long ones cut, sequences gapless and within the window."""
    library = Tokenizer.from_file(path)
    want = Counter()
    for i, t in docs:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        head = (len(ids) - 1) % window + 1
        for piece, (a, b) in enumerate(zip([0, *range(head, len(ids), window)], [*range(head, len(ids) + 1, window)], strict=True)):
            want[(i, piece, a, b - a, zlib.crc32(ids[a:b].tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length, r.sequence_tokens))
    for parts in held.values():
        at = 0
        for offset, length, tokens in sorted(parts):
            assert offset == at
            at += length
        assert at == parts[0][2] <= window
    return len(held)


def test_odd_rows(spark):
    path = queries.vocabulary("byte_bpe_50k.json")
    rows = best_fit.pack_whole(frame(spark, ODD), path, window=64, keep_ids=True).collect()
    check(rows, ODD, path, 64)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in rows)
    assert best_fit.pack_whole(frame(spark, []), path).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    df = queries.op12_best_fit(spark, sf)
    assert [c for c, _ in df.dtypes[:7]] == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert dict(df.dtypes)["piece"] == "int"
    rows = df.collect()
    path = queries.vocabulary("byte_bpe_50k.json")
    sequences = check(rows, docs, path, 1024)
    assert sequences <= -(-sum(r.length for r in rows) // 1024) * 1.02 + 1


def test_hot_length(spark):
    """A third of all documents alike: one length, one text."""
    docs = [(i, "same words again") for i in range(3000)] + [(i, f"other {i} " * (i % 40)) for i in range(3000, 6000)]
    path = queries.vocabulary("byte_bpe_50k.json")
    check(best_fit.pack_whole(frame(spark, docs).repartition(16), path).collect(), docs, path, 1024)


def test_ids_are_those_of_the_library():
    path = queries.vocabulary("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), byte_bpe.ByteTokenizer(path)
    assert own.fast
    rng = random.Random(7)
    tokens = [t for t in (library.decode([i]) for i in range(50_000)) if t and "�" not in t]
    texts = ["".join(rng.choices(tokens, k=rng.randrange(1, 6))) for _ in range(20_000)]
    texts += ["".join(rng.choices("abcde ABétäñ'\n\t0123.,-#ßœ　日", k=rng.randrange(1, 40))) for _ in range(5_000)]
    texts += [f"a{chr(c)}1 {chr(c)}b {chr(c)}{chr(c)} !{chr(c)}\n{chr(c)} " for c in range(0x260)]
    texts += ["", " ", "x <|endoftext|> y", "a" * 100_000, " " * 100_000, "\r\n \t" * 9_000, "it's we'll 'S " * 40_000, "日本 " * 2000]
    want = [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert own(texts) == want


def test_other_files_use_the_library(tmp_path):
    import json

    with open(queries.vocabulary("byte_bpe_50k.json"), encoding="utf-8") as file:
        spec = json.load(file)
    spec["model"]["merges"][5], spec["model"]["merges"][9] = spec["model"]["merges"][9], spec["model"]["merges"][5]
    path = tmp_path / "odd.json"
    path.write_text(json.dumps(spec))
    own = byte_bpe.ByteTokenizer(str(path))
    assert not own.fast
    assert own(["the end"]) == [np.array(Tokenizer.from_file(str(path)).encode("the end").ids, "<u4").tobytes()]
