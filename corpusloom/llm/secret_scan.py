"""Secret scan: patterns find candidates, a random forest removes the false ones.

The forest sees a candidate's length, how its characters follow each other, how much of it dictionary words cover, the path it
was found under and the words around it. It is trained from labelled findings; `labelled_findings` makes a set of them by
rule, of a bounded number, for use where a team has no findings of its own.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import map_arrow, settle, small_side

NAMES = r"(?:tokens?|secrets?|passw(?:or)?d|passphrase|pwd|api[_\- ]?keys?|access[_\- ]?keys?|auth(?:orization)?|bearer|credentials?|private[_\- ]?key|client[_\- ]?secret)"
#: No value has an upper bound of length. Runs are possessive and start at their first character only, so time is linear in the text.
#: First and last line of a key, and what an open key (no last line before the next key) holds: its headers, then all up to a hyphen.
KEY_EDGE = re.compile(r"-----(BEGIN|END) [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----")
OPEN_KEY = re.compile(r"(?:(?:\s|\\[rn])*+(?:Proc-Type|DEK-Info|Version|Comment): [^\r\n]*+)*+[^\-]*+")
KNOWN = re.compile(r"(?<![A-Za-z0-9])((?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|sk_(?:live|test)_[A-Za-z0-9]{16,}+|AIza[0-9A-Za-z_\-]{35})(?![A-Za-z0-9])")
#: A run that two further parts of a web token follow, or four, of which the first may be empty; and where in the run the token starts.
DOTTED = re.compile(r"(?<![W])[W]++(?=(\.[W]{8,}+\.[W]{8,}+(?:\.[W]{8,}+\.[W]{8,}+)?|\.(?:\.[W]{8,}+){3}))".replace("W", r"A-Za-z0-9_\-"))
WEB_TOKEN = re.compile(r"(?<![A-Za-z0-9])eyJ[A-Za-z0-9_\-]{8}")
#: A name starts after a character that is no letter, or at an upper-case letter of camel case.
ASSIGNED = re.compile(r"(?:(?<![A-Za-z])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z]))(?i:" + NAMES + r"[\"']?\s*+(?:=>|[:=])\s*+(?:bearer\s)?[\"']?)([^\s\"',;<>]{6,}+)")
RANDOM = re.compile(r"(?<![A-Za-z0-9+/_=\-])(?=[A-Za-z+/_=\-]*+[0-9])(?=[0-9+/_=\-]*+[A-Za-z])[A-Za-z0-9+/_=\-]{20,}+")
KINDS = ("key_block", "known", "assigned", "random")
#: Common words of code and prose, and words that speak for or against a secret near a candidate or in its path.
WORDS = tuple("""about access account admin after all and any api app application array auth base before block build bytes cache call
change check class client code color commit common component config connection const content context control copy count create
current data database date default delete demo dev device disabled document domain dummy email enable encoded end error event
example export false field file filter final first for format from function get group hash have header height hello here home
host html image import index info input insert instance interface internal item json key label language last length library
line link list load local log login main manager map max message method min model module name new node not null number object
of one open option order output package page param parent pass password path phone point port post primary print private
process product project property public query read record remote request response result return root run sample save script
search secret section select send server service session set simple size source start state status step store string style
submit success system table target template test text that the this time title token true type undefined update url user
username util value version view web when which width window with word work world write your""".split())
FOR = frozenset("token tokens secret secrets password passwd pwd passphrase key apikey credential credentials auth bearer private authorization".split())
AGAINST = frozenset("""sha sha1 sha256 md5 commit checksum digest hash uuid guid revision integrity id etag fingerprint example sample dummy
placeholder test fake mock version image png base64 url href""".split())
QUIET_PATHS = ("test", "example", "sample", "doc", "fixture", "mock", "lock", "vendor")
FEATURES = ("length", "log_length", "digits", "uppers", "lowers", "others", "class_changes", "letter_to_digit", "digit_to_letter", "case_changes",
            "repeats", "distinct", "entropy", "hex", "covered", "words_for", "words_against", "quiet_path", "known", "assigned", "marks")
LABELLED = 3000
BEFORE, AFTER = 60, 30


def char_class(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.isupper() else 2 if c.isalpha() else 3


@lru_cache(maxsize=1)
def dictionary() -> tuple[frozenset, int]:
    words = frozenset(w for w in WORDS if len(w) >= 3)
    return words, max(map(len, words))


def coverage(value: str) -> float:
    """Share of the letters that dictionary words cover, taking the longest word at each place."""
    words, most = dictionary()
    low, at, covered = value.lower(), 0, 0
    while at < len(low):
        size = next((n for n in range(min(most, len(low) - at), 2, -1) if low[at : at + n] in words), 0)
        covered += size
        at += size or 1
    return covered / max(1, sum(c.isalpha() for c in value))


def features(value: str, kind: str, left: str, right: str, path: str) -> list[float]:
    """The forest's view of a candidate; the order is FEATURES. Long values are measured on all their characters."""
    n = max(1, len(value))
    kinds = [char_class(c) for c in value]
    share = [kinds.count(k) / n for k in range(4)]
    steps = list(zip(kinds, kinds[1:], strict=False))
    rate = lambda f: sum(map(f, steps)) / max(1, len(steps))
    counts: dict[str, int] = {}
    for c in value:
        counts[c] = counts.get(c, 0) + 1
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    near = set(re.findall(r"[a-z0-9]+", f"{left} {right}".lower()))
    letter = lambda k: k in (1, 2)
    return [
        float(len(value)), math.log2(n), share[0], share[1], share[2], share[3],
        rate(lambda s: s[0] != s[1]), rate(lambda s: letter(s[0]) and s[1] == 0), rate(lambda s: s[0] == 0 and letter(s[1])),
        rate(lambda s: {s[0], s[1]} == {1, 2}), sum(a == b for a, b in zip(value, value[1:], strict=False)) / n,
        len(counts) / n, entropy, float(all(c in "0123456789abcdefABCDEF" for c in value)), coverage(value),
        float(len(near & FOR)), float(len(near & AGAINST)), float(any(q in (path or "").lower() for q in QUIET_PATHS)),
        float(kind in ("known", "key_block")), float(kind == "assigned"), float(any(m in value for m in "${}()<>[]*%")),
    ]


def key_blocks(text: str) -> list[tuple[int, int]]:
    edges = list(KEY_EDGE.finditer(text))
    return [(m.start(), after.end() if after and after[1] == "END" else OPEN_KEY.match(text, m.end()).end())
            for m, after in zip(edges, [*edges[1:], None], strict=False) if m[1] == "BEGIN"]


def web_tokens(text: str) -> list[tuple[int, int]]:
    if "eyJ" not in text:
        return []
    return [(t.start(), m.end(1)) for m in DOTTED.finditer(text) if (t := WEB_TOKEN.search(text, m.start(), m.end()))]


def candidates(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the values in a text, in order and apart from each other.

    Overlapping values are one from the first start to the last end, so the longer wins, under the earlier of their kinds. A random run
    gives way to them and to the name of an assigned value; what is left of it on either side is looked at as a run of its own.
    """
    assigned = [(m.start(), *m.span(1)) for m in ASSIGNED.finditer(text)]
    spans = [*((s, e, 0) for s, e in key_blocks(text)), *((*m.span(1), 1) for m in KNOWN.finditer(text)),
             *((s, e, 1) for s, e in web_tokens(text)), *((s, e, 2) for _, s, e in assigned)]
    found: list[list[int]] = []
    for start, end, kind in sorted(spans):
        if found and start < found[-1][1]:
            found[-1][1:] = max(end, found[-1][1]), min(kind, found[-1][2])
        else:
            found.append([start, end, kind])
    taken, k = sorted([(s, e) for s, e, _ in found] + [(n, e) for n, _, e in assigned]), 0
    for m in RANDOM.finditer(text):
        at, end = m.span()
        pieces = []
        while k < len(taken) and taken[k][0] < end:
            if taken[k][1] > at:
                pieces.append((at, taken[k][0]))
                at = taken[k][1]
            if taken[k][1] > end:
                break  # it may reach into the next run
            k += 1
        for s, e in [*pieces, (at, end)]:
            if e - s >= 20 and (not pieces or re.search("[0-9]", text[s:e]) and re.search("[A-Za-z]", text[s:e])):
                found.append([s, e, 3])
    return [(KINDS[kind], start, end) for start, end, kind in sorted(found)]


def labelled_findings(n: int = LABELLED, seed: int = 11) -> list[tuple]:
    """``n`` findings (value, kind, left, right, path, is_secret) made by rule: random strings where secrets stand, and what looks
    alike: hashes and ids by name, joined words, placeholders, numbers and encoded data."""
    draw = random.Random(seed)
    pick = lambda chars, k: "".join(draw.choice(chars) for _ in range(k))
    hexes, alnum = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    syllables = ["er", "on", "th", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it", "st", "io", "le", "is", "ou", "ar", "as", "de", "rt", "ve"]
    paths = ["src1", "src0", "app/config.py", "deploy/prod.env", "web", "notes.txt", "src17", ""]
    quiet = ["tests/test_api.py", "docs/example.md", "samples/demo.js", "package-lock.json"]
    prose = lambda: " ".join("".join(draw.choices(syllables, k=draw.randint(1, 4))) for _ in range(4))
    word = lambda: draw.choice(WORDS)
    long = lambda: int(2 ** draw.uniform(7, 11))

    def pem() -> str:
        name, body = draw.choice(["", "RSA ", "EC ", "OPENSSH ", "ENCRYPTED "]), pick(alnum + "+/", long())
        fold = draw.choice(["\n", "\\n"])
        head = f"Proc-Type: 4,ENCRYPTED{fold}DEK-Info: AES-128-CBC,{pick(hexes, 32)}{fold}{fold}" if draw.random() < 0.2 else ""
        return f"-----BEGIN {name}PRIVATE KEY-----{fold}{head}{fold.join(re.findall('.{1,64}', body))}{fold}-----END {name}PRIVATE KEY-----"

    rows = []
    for i in range(n):
        if i % 2:
            kind, value = draw.choice([
                ("assigned", pick(hexes, draw.choice([32, 40, 48, 64]))), ("assigned", pick(alnum, draw.randint(16, 64))),
                ("assigned", pick(alnum + "+/", draw.randint(20, 60)) + draw.choice(["", "=", "=="])), ("assigned", pick(alnum + "!@#_-", draw.randint(10, 18)) + pick("0123456789", 2)),
                ("known", "AKIA" + pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16)), ("known", "ghp_" + pick(alnum, 36)), ("known", "sk_live_" + pick(alnum, 24)),
                ("random", pick(alnum, draw.randint(32, 64))), ("random", pick(alnum + "+/", long()) + draw.choice(["", "=", "=="])),
                ("assigned", pick(alnum + "+/", long()) + draw.choice(["", "=", "=="])), ("assigned", pick(hexes, long())),
                ("known", "eyJ" + ".".join(pick(alnum + "_-", n) for n in (draw.randint(17, 200), long(), draw.randint(43, 342)))),
                ("key_block", pem())])
            name = draw.choice(["token", "secret", "password", "api_key", "auth token", "private key", "access_key"])
            bare = kind == "key_block" or kind != "assigned" and any(c.isupper() for c in value) and draw.random() < 0.5
            left, right = (f"{prose()} ", f" {prose()}") if bare else (f'{prose()} {name} = "', f'" {prose()}')
            rows.append((value, kind, left, right, draw.choice(paths if draw.random() < 0.9 else quiet), 1))
        else:
            what = draw.randrange(8)
            kind, left = "random", prose() + " "
            if what == 0:
                value, left = pick(hexes, draw.choice([32, 40, 64])), draw.choice(["commit ", "sha256: ", "md5 checksum ", "digest ", "revision ", "integrity "])
            elif what == 1:
                h = pick(hexes, 32)
                value, left = "-".join((h[:8], h[8:12], h[12:16], h[16:20], h[20:])), draw.choice(["uuid ", "id: ", "guid "])
            elif what == 2:
                kind, value, left = "assigned", draw.choice(["your_api_key_here", "changeme", "xxxxxxxxxxxxxxxx", "${TOKEN}", "****************", "<token>", "example_password", "undefined", "process.env.TOKEN", "getToken()", "placeholder", "test_password"]), "token = "
            elif what == 3:
                value = draw.choice(["_", "-", "/"]).join(word() for _ in range(draw.randint(4, 7))) + str(draw.randint(0, 99))
            elif what == 4:
                value = "".join(draw.choices(syllables, k=draw.randint(10, 16))) + str(draw.randint(0, 9))
            elif what == 5:
                value, left = pick(alnum + "+/", draw.choice([draw.randint(60, 200), long()])), "data:image/png;base64,"
            elif what == 6:
                value = pick("0123456789", draw.randint(8, 14)) + draw.choice(["-", "_", "x", "e"]) + pick("0123456789", draw.randint(8, 12))
            else:
                kind, value, left = "assigned", "".join(w.capitalize() if j else w for j, w in enumerate(word() for _ in range(draw.randint(2, 4)))), draw.choice(["token: ", "auth = ", "password: "])
            rows.append((value, kind, left, " " + prose(), draw.choice(paths + quiet), 0))
    return rows


def train(spark: SparkSession, findings: list[tuple] | None = None, trees: int = 40, depth: int = 8, seed: int = 7) -> RandomForestClassificationModel:
    """A forest from labelled findings; callers bound their number, as `labelled_findings` does by LABELLED."""
    rows = [(features(v, k, a, b, p), float(y)) for v, k, a, b, p, y in (labelled_findings() if findings is None else findings)]
    frame = spark.createDataFrame(rows, "x array<double>, label double").select(array_to_vector("x").alias("features"), "label").coalesce(1)
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed).fit(frame)


def find_candidates(docs: DataFrame, id: str, text: str, path: str) -> DataFrame:
    """(doc_id, body, start, length, kind, secret_sha256, x): every candidate with its features; values stay in the task."""
    source = docs.select(F.col(id).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("body"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(path).cast("string").alias("path"))
    id_type = source.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, paths = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            at, rows = [], []
            for i, (t, p) in enumerate(zip(texts, paths, strict=True)):
                for kind, start, end in candidates(t):
                    value = t[start:end]
                    at.append(i)
                    rows.append((start, end - start, kind, hashlib.sha256(value.encode("utf-8", "replace")).hexdigest(),
                                 features(value, kind, t[max(0, start - BEFORE) : start], t[end : end + AFTER], p or "")))
            own = pa.array(at, pa.int64())
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(own), batch.column(1).take(own), *(pa.array(list(c), t) for c, t in zip(columns, types, strict=True))],
                names=["doc_id", "body", "start", "length", "kind", "secret_sha256", "x"])

    return map_arrow(source, work, f"doc_id {id_type}, body long, start long, length long, kind string, secret_sha256 string, x array<double>")


def scan_secrets(docs: DataFrame, id: str = "doc_id", text: str = "text", path: str = "source", least: float = 0.5,
                 model: RandomForestClassificationModel | None = None) -> DataFrame:
    """Findings that the forest takes for secrets: ``(doc_id, body, start, length, kind, secret_sha256, score)``.

    ``start`` counts characters from 0; the value itself is not given. A null text has no candidates, a null path is empty;
    repeated rows give repeated findings. ``body`` is a hash of the text, which tells rows of one id apart.
    """
    forest = model or train(docs.sparkSession)
    scored = forest.transform(find_candidates(docs, id, text, path).withColumn("features", array_to_vector("x")))
    probability = vector_to_array("probability")[1]
    return scored.withColumn("score", F.round(probability, 6)).where(F.col("score") >= least).select(
        "doc_id", "body", "start", "length", "kind", "secret_sha256", "score")


def redact(docs: DataFrame, id: str = "doc_id", text: str = "text", path: str = "source", mark: str = "[SECRET]") -> DataFrame:
    """The rows with each secret replaced by ``mark``; other columns and rows stay as they are, whatever their names."""
    lead = "_" * (1 + max((len(c) for c in docs.columns), default=0))  # longer than any column's name
    of, body, own, found = (lead + x for x in ("id", "body", "own", "spans"))
    spans = settle(scan_secrets(docs, id, text, path).groupBy(F.col("doc_id").alias(of), F.col("body").alias(body)).agg(
        F.array_sort(F.collect_set(F.struct("start", "length"))).alias(found)))
    marked = docs.withColumn(own, F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    joined = marked.join(small_side(spans, 50_000), F.col(id).eqNullSafe(F.col(of)) & (F.col(own) == F.col(body)), "left")
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    step = lambda a, s: F.struct((s["start"] + s["length"]).alias("at"), F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit(mark)).alias("out"))
    clean = F.aggregate(found, begin, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    return joined.withColumn(text, F.when(F.col(found).isNull(), F.col(text)).otherwise(clean)).select(*docs.columns)
