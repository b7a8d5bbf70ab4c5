"""Each operator on its edge cases, and against brute force on the smallest tables."""

import hashlib
import math
import random
import re
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from folioflow.llm import common, decontamination, language_id, licenses, lm_scoring, maxplus, personal_data, quality, queries, secrets, sentence_pieces, similar, token_counts
from tests.conftest import DATA

cloudpickle.register_pickle_by_value(sys.modules[__name__])
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
JSON = queries.tokenizer_path("byte_bpe_50k.json")
MODEL = queries.tokenizer_path("piece_bpe_32k.model")


def low(t):
    return (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


LONG = " ".join(f"w{i % 977}" for i in range(60_000))
ODD = [
    (1, None, "en", "s"),
    (2, "", None, None),
    (3, " \t\n ", "de", "s"),
    (4, "one two", "en", "s"),
    (5, "One  TWO\n", "en", "s"),
    (6, LONG, "en", "s"),
    (7, "x" * 70_000, "en", "s"),
    (None, "one two", "en", "s"),
    (8, "É é 　日本 \U0001f600 <|endoftext|> a|b", None, "s"),
    (9, "dup line\ndup line\n\n\nother", "fr", "s"),
    (9, "dup line\ndup line\n\n\nother", "fr", "s"),
    (10, "\x00\x01 nul", "en", "s"),
]
KIND = "doc_id long, text string, lang string, source string, n_tokens long, kept string, score array<int>, `a b` string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 1, "k", [1], "x") for r in ODD], KIND)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").cache()


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.read.parquet(f"{DATA}/benchmark.parquet")


RUN = {
    "op1": lambda d, b: token_counts.count_tokens(d, JSON),
    "op2": lambda d, b: quality.quality(d),
    "op3": lambda d, b: similar.near_duplicates(d),
    "op4": lambda d, b: licenses.find_licenses(d),
    "op5": lambda d, b: personal_data.find_personal_data(d),
    "op6": lambda d, b: sentence_pieces.digests(d, MODEL),
    "op6 ids": lambda d, b: sentence_pieces.encode_documents(d, MODEL),
    "op7": lambda d, b: language_id.identify(d),
    "op8": lambda d, b: decontamination.contamination(d, b),
    "op9": lambda d, b: secrets.find_secrets(d),
    "op10": lambda d, b: lm_scoring.score(d),
}


@pytest.mark.parametrize("name", RUN)
def test_odd_rows_and_empty_tables(spark, odd, benchmark, name):
    got = RUN[name](odd, benchmark)
    assert Counter(r[0] for r in got.collect()) == Counter(r[0] for r in ODD)
    assert RUN[name](odd.limit(0), benchmark).count() == 0


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


def test_op1_is_the_library(docs, odd):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    for d in (docs, odd.filter("doc_id is not null").dropDuplicates(["doc_id"])):
        got = rows(token_counts.count_tokens(d, JSON))
        for i, x in texts(d).items():
            n = len(t.encode(x or "", add_special_tokens=False))
            assert tuple(got[i]) == (i, len((x or "").encode()), n, n > 1024)


def test_op1_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(token_counts, "CACHE_ENTRIES", 10)
    c = token_counts.Lengths(JSON, {"a": 1})
    assert [c.count([x])[0] for x in (LONG[:3000], "a b", LONG[:3000])] == [len(c.library.encode(x).ids) for x in (LONG[:3000], "a b", LONG[:3000])]


def test_op1_blanks_specials_and_blocks(monkeypatch):
    rng = random.Random(31)
    parts = ["a", "Word", "it's", " ", " ", "  ", "\n", " \n", "\t", "\u3000", "\u00a0", "\x1c", "\x85", "\u200b", "%%%", "é", "日本", "12", ", ", "<|endoftext|>", "<|endof", "\U0001f600"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(1500)] + ["x" * 300, " ", "   ", " a", "a ", "<|endoftext|> a", "<|endoftext|><|endoftext|>"]
    for block in (1 << 20, 16):
        monkeypatch.setattr(token_counts, "BLOCK", block)
        c = token_counts.Lengths(JSON, {" a": 1, "Word": 1})
        want = [len(e) for e in c.library.encode_batch(made, add_special_tokens=False)]
        assert c.count(made) == want and c.count(made[::-1]) == want[::-1]


def test_op1_table_holds_the_frequent_pre_tokens(spark, docs):
    counts = Counter(w for t in texts(docs).values() for w in token_counts._split(t))
    assert dict.fromkeys(token_counts.frequent_pre_tokens(docs, 1 << 20)).keys() == {w for w in counts if len(w) < token_counts.CACHED_CHARS - 2} | set(token_counts.frequent_pre_tokens(docs, 1 << 20))
    few = token_counts.frequent_pre_tokens(docs, 500)
    share = sum(counts.values()) / 500
    assert len(few) <= 500 and {w for w, n in counts.items() if n > 4 * share} <= set(few)
    lengths, library = token_counts.frequent_lengths(docs, JSON, 500), token_counts.Lengths(JSON, {}).library
    assert all(n == len(library.encode(w).ids) for w, n in lengths.items())


def test_op1_refuses_other_tokenizers(tmp_path):
    with pytest.raises(ValueError):
        token_counts.Lengths(queries.tokenizer_path("word_bpe_49k.json"), {})


def brute_base(t):
    w = SPACE.findall(t or "")
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        dup += line in seen and bool(SPACE.search(line))
        seen.add(line)
    n = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {j for i in range(len(w) - 4) if n[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(hit)


def test_op2_base_counts(docs, odd):
    for d in (docs, odd.filter("doc_id is not null").dropDuplicates(["doc_id"])):
        got = rows(quality.quality(d))
        for i, t in texts(d).items():
            want = brute_base(t)
            assert tuple(got[i])[1:6] == want
            failed = want[0] < 10 or 100 * want[4] > 20 * want[0]
            assert got[i]["base_failed"] == failed and not (failed and got[i]["kept"])


def test_op2_divergence(spark, docs):
    clean = [r["text"] for r in docs.filter("lang = 'en' and n_chars > 800").select("text").collect() if not re.search(r"[|*$#%&]|!!", r["text"])][:20]
    noisy = [re.sub(r"\w+", "#$%^&*", t) for t in clean]
    extra = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(clean + noisy)], "doc_id long, text string").withColumn("lang", F.lit("en"))
    got = rows(quality.quality(docs.select("doc_id", "text", "lang").union(extra)))
    assert all(got[10_000 + i]["kept"] or got[10_000 + i]["base_failed"] for i in range(len(clean)))
    assert not any(got[10_000 + len(clean) + i]["kept"] for i in range(len(noisy)))


def test_op2_rejects_word_salad(spark, docs):
    rng = random.Random(8)
    clean = [(r["text"], r["lang"]) for r in docs.filter("n_chars > 800").select("text", "lang").collect() if not re.search(r"[|*$#%&<>]|!!", r["text"])]
    letters = [c for t, _ in clean[:20] for c in re.sub(r"[\W\d_]", "", t.lower())]
    word = lambda: next(w for w in iter(lambda: "".join(rng.choices(letters, k=rng.randint(2, 9))), "") if w not in quality.COMMON_WORDS)
    salad = [(" ".join(word() for _ in range(rng.choice([70, 150, 600]))), lang) for lang in ("en", "de", "fr", None) for _ in range(5)]
    cases = [(10_000 + i, *x) for i, x in enumerate(clean + salad)]
    got = rows(quality.quality(docs.select("doc_id", "text", "lang").union(spark.createDataFrame(cases, "doc_id long, text string, lang string"))))
    assert len(clean) > 40 and all(got[10_000 + i]["kept"] or got[10_000 + i]["base_failed"] for i in range(len(clean)))
    assert not any(got[10_000 + len(clean) + i]["kept"] for i in range(len(salad)))
    assert not any(got[10_000 + len(clean) + i]["base_failed"] for i in range(len(salad)))


def test_op2_word_limits():
    words = np.ones((2, quality.N_WORDS))
    words[1, :-1] = 0
    limit = quality.word_limits(words, quality.Rules())
    bare = quality.js_distance(words[1:], words)[0]
    assert limit[0] < bare[0] and limit[1] == np.inf


def test_op2_references_are_bounded_and_whole(spark, docs):
    want = defaultdict(lambda: [np.zeros(quality.N_CLASSES), np.zeros(quality.N_WORDS)])
    for r in docs.filter("lang is not null and text is not null").collect():
        c, w = quality.histograms([r["text"].encode()])
        if w.sum() >= 10:
            want[r["lang"]][0] += c[0]
            want[r["lang"]][1] += w[0]
    got = quality.references(docs)
    assert got.keys() == want.keys() and all((got[k][i] == want[k][i]).all() for k in got for i in (0, 1))
    many = docs.withColumn("lang", F.concat("lang", (F.col("doc_id") % 50).cast("string")))
    few = quality.references(many, most=7)
    size = defaultdict(int)
    for r in many.filter("lang is not null and text is not null").collect():
        n = len(r["text"].encode().split())
        size[r["lang"]] += n if n >= 10 else 0
    assert set(few) == set(sorted(size, key=lambda k: (-size[k], k))[:7])
    longer = quality.references(docs, quality.Rules(min_words=200))
    assert all(longer[k][1].sum() < got[k][1].sum() for k in longer)


def test_op2_verdicts_against_brute_force(docs):
    """The distances and the verdict from plain counts, one document at a time."""
    def js(p, q):
        p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
        m = [(x + y) / 2 for x, y in zip(p, q)]
        kl = lambda a: sum(x * math.log2(x / y) for x, y in zip(a, m) if x)
        return math.sqrt(max(0, (kl(p) + kl(q)) / 2))

    refs = quality.references(docs)
    bare = [0] * (quality.N_WORDS - 1) + [1]
    got = rows(quality.quality(docs))
    for i, t in texts(docs).items():
        n_words, _, _, _, n_repeat = brute_base(t)
        failed = n_words < 10 or 100 * n_repeat > 20 * n_words
        split = [w.decode() for w in t.encode().lower().split()]
        words = [split.count(w) for w in quality.COMMON_WORDS]
        words.append(len(split) - sum(words))
        kinds = [0] * quality.N_CLASSES
        for ch in t:
            k = next((n for n, x in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n", ".,;:?!'\"-", "()[]{}/")) if ch in x), 8 if ch > "\x7f" else 9 if ch < " " or ch == "\x7f" else 7)
            kinds[k] += 1
        far = bool(refs)
        for c, w in refs.values():
            reach = js(bare, w)
            by_class = sum(kinds) >= 200 and js(kinds, c) > 0.30
            by_words = n_words >= 60 and reach >= 0.2 and js(words, w) > 0.95 * reach
            far = far and (by_class or by_words)
        assert (got[i]["base_failed"], got[i]["kept"]) == (failed, not failed and not far), i


def test_js_distance():
    p, q = np.array([[1, 0], [1, 1], [0, 0]]), np.array([[0, 1], [2, 2]])
    d = quality.js_distance(p, q)
    assert d[0, 0] == 1 and d[1, 1] == 0 and d[2, 0] == 0


def shingles(t):
    w = SPACE.findall(low(t))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_near(pairs):
    sets = [shingles(t) for _, t in pairs]
    link = defaultdict(set)
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                link[i].add(j)
                link[j].add(i)
    out = []
    for i, (d, _) in enumerate(pairs):
        seen, todo = {i}, [i]
        while todo:
            for k in link[todo.pop()] - seen:
                seen.add(k)
                todo.append(k)
        known = [pairs[k][0] for k in seen if pairs[k][0] is not None]
        out.append((d, len(sets[i]), len(link[i]), min(known) if known else None))
    return sorted(out, key=repr)


def near_cases():
    rng = random.Random(5)
    vocab = [f"v{i}" for i in range(400)]
    out = []
    for size in (1, 3, 5, 6, 9, 14, 24, 33, 60, 150, 400):
        base = [rng.choice(vocab) for _ in range(size)]
        for _ in range(14):
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4, max(1, size // 60)])):
                k = rng.randrange(len(w))
                w[k : k + rng.randint(0, 1)] = [rng.choice(vocab)]
            out.append(" ".join(w).upper() if rng.random() < 0.2 else "  ".join(w))
    passage = " ".join(rng.choice(vocab) for _ in range(60))
    out += [passage + " " + " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 90))) for _ in range(70)]
    return list(enumerate(out)) + [(d, t) for d, t, *_ in ODD]


@pytest.mark.parametrize("crowd", [2, 48])
def test_op3_against_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(similar, "SMALL_GROUP", crowd)
    monkeypatch.setattr(similar, "BLOCK", 8)
    cloudpickle.register_pickle_by_value(similar)
    try:
        cases = near_cases()
        got = similar.near_duplicates(spark.createDataFrame(cases, "doc_id long, text string").repartition(7))
        want = brute_near(cases)
        assert sum(r[2] > 0 for r in want) > 50
        assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    finally:
        cloudpickle.unregister_pickle_by_value(similar)


def test_op3_signatures_meet():
    rng = random.Random(2)
    for _ in range(400):
        n = rng.randint(1, 120)
        a = {rng.getrandbits(64) for _ in range(n)}
        b = set(a)
        for _ in range(n):
            c = set(b)
            c.discard(rng.choice(sorted(c))) if rng.random() < 0.5 and c else c.add(rng.getrandbits(64))
            if not c or 5 * len(a & c) < 4 * len(a | c):
                break
            b = c
        x, y = (np.sort(np.array(sorted(s), np.uint64)) for s in (a, b))
        (sx, tx), (sy, ty) = similar.signatures(x), similar.signatures(y)
        assert a == b or len(set(sx.tolist()) & set(sy.tolist())) >= max(tx, ty) >= 1
        h, g = similar.opened([similar.histogram(x)]), similar.opened([similar.histogram(y)])
        assert similar.may_reach(np.array([len(x)]), h, np.array([len(y)]), g)[0]


def test_components_of_a_long_chain(spark):
    n = 40
    e = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101)], "u long, v long")
    got = {r["node"]: r["root"] for r in similar.components(e).collect()}
    assert got == {**{i: 0 for i in range(1, n + 1)}, 101: 100}


def test_op4_alignment():
    rng = random.Random(1)

    def lis(p):  # quadratic
        best = [1] * len(p)
        for i in range(len(p)):
            best[i] = 1 + max([best[j] for j in range(i) if p[j][1] < p[i][1]], default=0)
        return max(best, default=0)

    for _ in range(300):
        p = list(enumerate(rng.sample(range(30), rng.randint(0, 12))))
        assert len(licenses._increasing(p)) == lis(p)
        a = [rng.choice("abcdefgh") for _ in range(rng.randint(0, 14))]
        b = [rng.choice("abcdefgh") for _ in range(rng.randint(0, 14))]
        got = licenses.aligned(a, b)
        assert all(a[i] == b[j] for i, j in got) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:]))
    assert len(licenses.aligned(list("abcdef"), list("abxdef"))) == 5
    assert len(licenses.aligned("a b a b a b".split(), "b a b a b a".split())) == 5


def test_op4_gaps_without_anchors_are_common_subsequences():
    rng = random.Random(37)

    def longest(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before = row
            row = [0]
            for j, y in enumerate(b):
                row.append(before[j] + 1 if x == y else max(before[j + 1], row[j]))
        return row[-1]

    def patience(a, b):
        """Aligned words by the definition, over lists: ends, anchors, gaps."""
        n = 0
        while a and b and a[0] == b[0]:
            a, b, n = a[1:], b[1:], n + 1
        while a and b and a[-1] == b[-1]:
            a, b, n = a[:-1], b[:-1], n + 1
        once = [x for x in a if a.count(x) == b.count(x) == 1]
        if not once:
            return n + longest(a, b)
        pairs = [(a.index(x), b.index(x)) for x in once]
        best: list = []
        for i, p in enumerate(pairs):
            ahead = max((x for x in best if x[-1][1] < p[1]), key=len, default=[])
            best.append([*ahead, p])
        size = max(map(len, best))
        return n, size, pairs, a, b

    for _ in range(2000):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 14))] for _ in range(2))
        got = licenses.common(a, b)
        assert len(got) == longest(a, b) and all(a[i] == b[j] for i, j in got)
        want, mine = patience(a, b), licenses.aligned(a, b)
        if isinstance(want, int):
            assert len(mine) == want
        else:
            assert want[0] + want[1] <= len(mine) <= longest(a, b)


def test_op4_names_and_versions_must_stand_there(spark):
    t = licenses.TEMPLATES
    cases = [
        ("Released under the BSD License", ""),
        ("Licensed under the GNU General Public License, version 2", "GPL-2.0-line"),
        ("licensed under the GNU Lesser General Public License, version 3", "LGPL-3.0-line"),
        ("licensed under the GNU General Public License, version 4", ""),
        ("Licensed under CC BY-SA 4.0", "CC-BY-SA-4.0-line"),
        ("Licensed under CC BY 4.0", "CC-BY-4.0-line"),
        ("Licensed under CC BY 3.0", ""),
        *((t[k].replace("*", "").replace("\n", " ").lower(), k) for k in t),
        *((" ".join(w for i, w in enumerate(t[k].split()) if i % 12 != 1 or "*" in t[k]), k) for k in ("MIT", "ISC", "Zlib", "BSL-1.0", "Unlicense", "BSD-2-Clause")),
    ]
    got = rows(licenses.find_licenses(spark.createDataFrame([(i, f"some words {x} and more") for i, (x, _) in enumerate(cases)], "doc_id long, text string")))
    assert [got[i]["licenses"] for i in range(len(cases))] == [k for _, k in cases]


def test_op4_finds_whole_and_edited_licenses(spark):
    mit, line = licenses.TEMPLATES["MIT"], "Licensed under the Apache License, Version 2.0."
    cut = " ".join(w for i, w in enumerate(mit.split()) if i % 9)
    cases = [(1, f"{LONG} {mit} {LONG}"), (2, cut.upper()), (3, "nothing here at all"), (4, f"a {line} b {line} c"), (5, " ".join(mit.split()[:60])), (6, "Licensed under CC BY-NC 4.0.")]
    got = rows(licenses.find_licenses(spark.createDataFrame(cases, "doc_id long, text string")))
    assert [got[i]["licenses"] for i in range(1, 7)] == ["MIT", "MIT", "", "Apache-2.0-line", "", "CC-BY-NC-4.0-line"]
    assert got[4]["spans"].count("Apache") == 2 and got[1]["coverage"] == 1.0


def test_op4_prefilter_loses_nothing(docs):
    known = [licenses.Template(k, v) for k, v in licenses.TEMPLATES.items()]
    got = rows(licenses.find_licenses(docs))
    for i, t in texts(docs).items():
        want = licenses.scan([w.decode() for w in decontamination.words((t or "").encode())], known)
        assert got[i]["spans"] == ",".join(f"{n}:{s}:{e}" for n, s, e, _ in want)


def brute_pii(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", m) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(digits(m[0])) <= 19 and personal_data.luhn(digits(m[0]))]
    out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]
    return sorted([(k, m.start(), m.end()) for k, m in out], key=repr)


def test_op5_base_spans(docs):
    rng = random.Random(9)
    strange = ["".join(rng.choice("a@.1-+ ()%_") for _ in range(60)) for _ in range(500)] + ["4111 1111-1111 1111 é a@b.c", "1.2.3.4.5.6.7.8 999.1.1.1 01.002.3.4"]
    for t in [*strange, *texts(docs).values()]:
        assert sorted(personal_data.base_spans(t), key=repr) == brute_pii(t)
        assert not brute_pii(t) or personal_data.worth_scanning(t.encode())
    got = rows(personal_data.find_personal_data(docs))
    for i, t in texts(docs).items():
        place = {k: n for n, k in enumerate(personal_data.BASE_KINDS)}
        spans = ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(brute_pii(t), key=lambda x: (x[1], place[x[0]])))
        assert got[i]["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest()
        assert set(filter(None, spans.split(","))) <= set(got[i]["spans"].split(","))


def test_op5_contexts_find_unseen_identifiers(spark):
    rng = random.Random(3)
    known = [(i, f"my server address {rng.randint(1, 250)}.{rng.randint(1, 250)}.7.{rng.randint(1, 250)} is up") for i in range(60)]
    unseen = [(100, "my server address 300.400.7.12 is up"), (101, "plain text 300.400.7.12 elsewhere")]
    for block in (200_000, 1):
        got = rows(personal_data.find_personal_data(spark.createDataFrame(known + unseen, "doc_id long, text string"), block))
        assert got[100]["spans"] == "context:18:30" and got[101]["spans"] == ""


def test_op5_contexts_cross_shapes(spark):
    rng = random.Random(4)
    known = [(i, f"staff contact u{i}@mail{i % 7}.example.org is on call") for i in range(30)]
    known += [(i, f"please dial desk +49 30 {rng.randint(1000, 9999)} {rng.randint(1000, 9999)} before noon") for i in range(30, 60)]
    plain = [(i, f"order number {rng.randint(10_000, 99_999)}X has come") for i in range(60, 90)]
    unseen = [(100, "staff contact AB-123456 is on call"), (101, "please dial desk EMP20391 before noon"), (102, "the part AB-123456 is elsewhere"), (103, "order number AB-123456 has come")]
    got = rows(personal_data.find_personal_data(spark.createDataFrame(known + plain + unseen, "doc_id long, text string")))
    assert [got[i]["spans"] for i in range(100, 104)] == ["context:14:23", "context:17:25", "", ""]
    assert not any("context" in got[i]["spans"] for i, _ in known + plain)


def brute_contexts(docs):
    """doc_id -> context spans: every round over plain lists of (pattern, instance) occurrences, confidence in whole hundredths."""
    bare = lambda w: re.sub("[0-9]+", "9", w.strip("\"'.,;!?()[]<>*#$%&|").lower())
    shape = lambda x: re.sub("[0-9]+", "9", re.sub("[A-Za-z]+", "a", x))
    seen, seeds = [], set()
    for row, (i, t) in enumerate(docs):
        base = brute_pii(t or "")
        found = [(s, e, True) for _, s, e in base]
        for m in re.finditer(r"[A-Za-z0-9]+(?:[._:/@+-]+[A-Za-z0-9]+)*", t or ""):
            looks = re.search(r"[0-9]", m[0]) or re.search(r"[A-Za-z][._:/@+-]", m[0]) or re.search(r"[A-Za-z][A-Z]", m[0])
            if len(m[0]) >= 5 and looks and all(m.end() <= s or m.start() >= e for _, s, e in base):
                found.append((*m.span(), False))
        for s, e, seed in found:
            x = t[s:e]
            ahead, behind = ["", "", *t[max(0, s - 80) : s].split()][-2:], t[e : e + 80].split()
            two, one = map(bare, ahead)
            kinds = [f"L {two} {one} _", f"W {one} _"] + ([f"B {one} _ {bare(behind[0])}"] if behind else []) if one else []
            seen.append((row, s, e, x, seed, {f"{k} {shape(x)}" for k in kinds} | {f"any {k}" for k in kinds}))
            if seed:
                seeds.add(x)
    # an instance that is a seed in a pattern is a seed there, wherever it stands
    edges = defaultdict(lambda: [False, 0])
    for _, _, _, x, seed, ps in seen:
        for p in ps:
            edges[p, x][0] |= seed
            edges[p, x][1] += 1
    known = {}
    while True:
        learned = defaultdict(int)
        for (p, x), (seed, _) in edges.items():
            if not seed:
                learned[x] = max(learned[x], known.get(p, 0))
        sums = defaultdict(lambda: [0, 0, set()])
        for (p, x), (seed, n) in edges.items():
            trust = 100 if seed else learned[x]
            sums[p][0] += n * trust
            sums[p][1] += n
            if trust >= 60:
                sums[p][2].add(x)
        now = {p: a // n for p, (a, n, who) in sums.items() if a // n >= 60 and len(who) >= 3}
        if now == known:
            break
        known = now
    out = [[] for _ in docs]
    for row, s, e, _, seed, ps in seen:
        if not seed and ps & set(known):
            out[row].append((s, e))
    return [sorted(set(x)) for x in out], known


def test_op5_contexts_against_brute_force(spark, docs):
    rng = random.Random(29)
    kinds = [lambda: f"u{rng.randint(1, 400)}@m{rng.randint(1, 9)}.example.org", lambda: f"{rng.randint(1, 250)}.{rng.randint(1, 250)}.7.9", lambda: f"AB-{rng.randint(1, 40)}", lambda: rng.choice(["JaneDoe", "QX-KLM", "j.roe", "x.y.z", "word"]), lambda: str(rng.randint(10_000, 10_060)), lambda: f"+49 30 {rng.randint(1000, 9999)} {rng.randint(1000, 9999)}"]
    heads = ["mail to", "staff id", "the host", "call", "part no", "a"]
    likely = {h: rng.sample(kinds, 2) for h in heads}
    made = []
    for i in range(160):
        words = []
        for _ in range(rng.randint(0, 6)):
            h = rng.choice(heads)
            words.append(f"{h} {rng.choice(likely[h] if rng.random() < 0.85 else kinds)()} {rng.choice(['now', 'or', 'is up,'])}")
        made.append((i, " ".join(words)))
    made += [(500, None), (501, ""), (502, made[3][1]), (502, made[3][1]), (None, made[5][1])]
    want, known = brute_contexts(made)
    assert sum(map(len, want)) > 30 and len({p.split("_")[0] for p in known}) > 5
    for block in (200_000, 7):
        got = personal_data.find_personal_data(spark.createDataFrame(made, "doc_id long, text string"), block).collect()
        spans = lambda r: [tuple(map(int, x.split(":")[1:])) for x in r["spans"].split(",") if x.startswith("context")]
        assert sorted((repr(r["doc_id"]), spans(r)) for r in got) == sorted((repr(i), w) for (i, _), w in zip(made, want))
        assert all(r["n_context"] == len(spans(r)) and r["n_spans"] == len([x for x in r["spans"].split(",") if x]) for r in got)
    table = sorted(texts(docs).items())
    want, _ = brute_contexts(table)
    got = rows(personal_data.find_personal_data(docs))
    assert [got[i]["n_context"] for i, _ in table] == list(map(len, want))


def test_op5_finds_identifiers_without_digits(spark):
    known = [(i, f"staff contact u{i}@mail{i % 7}.example.org is on call") for i in range(30)]
    unseen = [(100, "staff contact QX-Kelm is on call"), (101, "a well-known name"), (102, "staff contact " + "A-b" * 200 + " is on call")]
    got = rows(personal_data.find_personal_data(spark.createDataFrame(known + unseen, "doc_id long, text string")))
    assert [got[i]["spans"] for i in (100, 101, 102)] == ["context:14:21", "", "context:14:614"]


def test_op6_is_the_library(docs, odd):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for d in (docs, odd.filter("doc_id is not null").dropDuplicates(["doc_id"])):
        got, ids = rows(sentence_pieces.digests(d, MODEL)), rows(sentence_pieces.encode_documents(d, MODEL))
        for i, t in texts(d).items():
            want = sp.encode(t or "")
            assert ids[i]["ids"] == want and got[i]["n_pieces"] == len(want) and ids[i]["decoded"] == sp.decode(want)
            assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
            assert got[i]["round_trip"] == (ids[i]["decoded"] == (t or ""))


def test_op6_blanks_and_marks():
    import sentencepiece

    sp, c, rng = sentencepiece.SentencePieceProcessor(model_file=MODEL), sentence_pieces.Codec(MODEL), random.Random(8)
    for _ in range(3000):
        t = "".join(rng.choice("ab \n\t▁é日.") for _ in range(rng.randint(0, 12)))
        assert np.frombuffer(c.encode(t), "<i4").tolist() == sp.encode(t) and c.decode(c.encode(t)) == sp.decode(sp.encode(t))


def test_op6_chunks_are_the_library(spark, docs):
    """Cut anywhere, in words and in texts without a blank, chunks give the library's ids."""
    import sentencepiece

    sp, rng = sentencepiece.SentencePieceProcessor(model_file=MODEL), random.Random(12)
    some = [t for t in texts(docs).values() if len(t) > 400]
    made = [(i, t) for i, t in enumerate(rng.sample(some, 25))] + [(100 + i, t.replace(" ", "")[:5000]) for i, t in enumerate(rng.sample(some, 25))]
    made += [(200 + i, "".join(rng.choice("ab \n\t▁é日ґ\U0001f600\x00.") for _ in range(rng.randint(0, 400)))) for i in range(200)]
    made += [(500, None), (501, ""), (502, " " * 300), (503, "▁" * 300), (504, "x" * 2000), (505, "<s>" * 60), (505, "<s>" * 60), (None, "ab c " * 40)]
    table = spark.createDataFrame(made, "doc_id long, text string").withColumn("ids", F.lit("clash")).repartition(5)
    for size in (17, 64, 500):
        got = sentence_pieces.encode_documents(table, MODEL, size).collect()
        key = lambda x: (x[0] is None, x[0] or 0)
        want = sorted(((i, sp.encode(t or "")) for i, t in made), key=key)
        assert sorted(((r["doc_id"], r["ids"]) for r in got), key=key) == want
        assert all(r["decoded"] == sp.decode(r["ids"]) for r in got)
    whole, cut = rows(sentence_pieces.digests(table.filter("doc_id is not null"), MODEL)), rows(sentence_pieces.digests(table.filter("doc_id is not null"), MODEL, 33))
    assert whole == cut and any(r["round_trip"] for r in cut.values()) and not cut[503]["round_trip"]


def test_op6_matrices_combine_in_any_grouping(docs):
    c, rng = sentence_pieces.Codec(MODEL), random.Random(13)
    for _ in range(20):
        t = sentence_pieces.MARK + rng.choice(list(texts(docs).values())).replace(" ", rng.choice(["", "▁"]))[:300]
        cuts = [0, *sorted(rng.sample(range(20, max(21, len(t) - 20), 20), 3)), len(t)] if len(t) > 120 else [0, len(t)]
        parts = [(maxplus.states_at(t, s, c.ranked) if s else [maxplus.BEGIN], s, e) for s, e in zip(cuts, cuts[1:])]
        m = [maxplus.rank_transfer(t, s, e, entries, c.ranked, sentence_pieces.safe_borders(t, s, e)) for entries, s, e in parts]
        whole = maxplus.rank_transfer(t, 0, len(t), [maxplus.BEGIN], c.ranked)
        if len(m) == 4:
            join = lambda a, k, b: maxplus.rank_combine(a, parts[k][0], b)  # noqa: B023, E731
            left = join(join(join(m[0], 1, m[1]), 2, m[2]), 3, m[3])
            right = join(m[0], 1, join(m[1], 2, join(m[2], 3, m[3])))
            pairs = join(join(m[0], 1, m[1]), 2, join(m[2], 3, m[3]))
            assert left == right == pairs == whole


def test_op6_max_plus_against_the_plain_scan():
    rng = random.Random(3)
    for _ in range(200):
        p = maxplus.Pieces({"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))): -rng.random() * 5 for _ in range(rng.randint(1, 12))})
        t = "".join(rng.choice("abcd") for _ in range(rng.randint(0, 60)))
        cost = lambda pieces: sum(p.scores.get(x, p.unknown) for x in pieces)  # noqa: E731, B023
        best = cost(maxplus.segment(t, p, 10**9))
        for chunk in (4, 5, 16):
            got = maxplus.segment(t, p, chunk)
            assert "".join(got) == t and abs(cost(got) - best) < 1e-9


def test_op6_max_plus_is_the_unigram_library():
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    import sentencepiece

    rng = random.Random(6)
    names = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(40)} | set("abc▁")
    m = pb.ModelProto()
    m.trainer_spec.model_type = 1
    m.normalizer_spec.add_dummy_prefix = False
    m.normalizer_spec.remove_extra_whitespaces = False
    m.normalizer_spec.name = "identity"
    for name, kind in (("<unk>", 2), ("<s>", 3), ("</s>", 3)):
        m.pieces.add(piece=name, score=0.0, type=kind)
    scores = {n: float(np.float32(-rng.random() * 9)) for n in sorted(names)}
    for n, s in scores.items():
        m.pieces.add(piece=n, score=s, type=1)
    sp = sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())
    for _ in range(200):
        t = "".join(rng.choice("abc") for _ in range(rng.randint(1, 80)))
        got, want = maxplus.segment(t, maxplus.Pieces(scores), 8), sp.encode(t, out_type=str)
        # equal scores may belong to several orders of the same pieces
        assert "".join(got) == t and abs(sum(scores[x] for x in got) - sum(scores[x] for x in want)) < 1e-4


def test_op7_held_out_accuracy(docs):
    got = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)


def brute_grams(t):
    low_t, x = t.lower(), []
    for i, ch in enumerate(low_t):
        if ch.isalpha():
            x.append(ord(ch))
        elif i and low_t[i - 1].isalpha():
            x.append(32)
    out = []
    for n in (1, 2, 3):
        for s in range(len(x) - n + 1):
            h = 0
            for k in range(n):
                h = (h * 0x9E3779B1 + x[s + k] + k + 1) & 0xFFFFFFFF
            g = (h ^ h >> 15) * 0x85EBCA6B & 0xFFFFFFFF
            out.append((g ^ g >> 13) >> 16)
    return out


def test_op7_against_brute_force(spark, docs):
    """Multinomial naive Bayes over hashed n-grams by its definition, in plain counts."""
    some = docs.filter("doc_id % 3 = 0").withColumn("lang", F.when(F.col("doc_id") % 7 != 0, F.col("lang")))
    table = [tuple(r) for r in some.select("doc_id", "text", "lang").collect()] + [(9_001, None, "en"), (9_002, "12 34", "fr"), (9_003, "éa", None)]
    counts = defaultdict(Counter)
    for i, t, lang in table:
        if lang is not None and t and zlib.crc32(str(i).encode()) % 5:
            counts[lang].update(brute_grams(t))
    size = {k: sum(c.values()) for k, c in counts.items()}
    got = rows(language_id.identify(spark.createDataFrame(table, "doc_id long, text string, lang string")))
    for i, t, lang in table:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        if not any(c.isalpha() for c in t or ""):
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0)
            continue
        total = {k: sum(math.log((c[g] + 0.5) / (size[k] + 0.5 * 65536)) for g in brute_grams(t)) for k, c in counts.items()}
        best = max(total, key=total.get)
        rest = [v for k, v in total.items() if k != best]
        if max(rest) < total[best] - 0.1:
            assert got[i]["lang_pred"] == best
            assert abs(got[i]["score"] - 1 / sum(math.exp(v - total[best]) for v in total.values())) < 1e-2


def test_op7_features_and_unknown(odd, spark):
    got = {r["doc_id"]: r for r in language_id.identify(odd).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3
    alone = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert language_id.identify(alone).head()["lang_pred"] == "und"
    # each text by itself has what it has among others
    raws = [b"Ab c", None, b"", "É1é".encode(), b"12"]
    bucket, owner, has = language_id.features(raws)
    assert has.tolist() == [True, False, False, True, False]
    for i, r in enumerate(raws):
        assert sorted(bucket[owner == i]) == sorted(language_id.features([r])[0])


ITEM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_hits(t, items):
    w = ITEM.findall(low(t))
    hit, found = set(), set()
    for i, x in items:
        v = ITEM.findall(low(x))
        k = min(8, len(v))
        for win in {tuple(v[j : j + k]) for j in range(len(v) - k + 1)} if k else ():
            for s in range(len(w) - k + 1):
                if tuple(w[s : s + k]) == win:
                    hit |= set(range(s, s + k))
                    found.add(i)
    names = ",".join(sorted(map(str, found)))
    return len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), len(found) >= 2


def test_op8_against_brute_force(spark):
    rng = random.Random(7)
    vocab = ["a", "b", "The", "é", "x1"]
    make = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, make(rng.choice([3, 8, 9, 12]))) for i in range(8)] + [(20, None), (21, "..."), (22, "The"), (0, "x1 x1 x1")]
    docs = [(i, "; ".join([make(rng.randint(0, 30)), rng.choice(items[:8])[1].upper()])) for i in range(40)] + [(50, None), (51, ""), (52, "the"), (52, "the")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    want = sorted((i, *brute_hits(t, items)) for i, t in docs)
    for most in (1 << 20, 40):
        assert sorted(tuple(r) for r in decontamination.contamination(d, b, most).collect()) == want
        kept = [r["doc_id"] for r in decontamination.clean_documents(d, b, most).collect()]
        # a full window, or two short items
        full = [(i, t) for i, t in items if len(ITEM.findall(low(t))) >= 8]
        assert sorted(kept) == sorted(i for i, t in docs if not brute_hits(t, full)[2] and brute_hits(t, items)[2] < 2)
    assert decontamination.contamination(d, b.limit(0)).filter("n_hit > 0").count() == 0


def test_op8_one_planted_passage_is_enough(spark, odd, benchmark):
    item = benchmark.filter("item_id = 2").head()["text"]
    rows = [(1, "Some other words ahead. " + item + " And behind."), (2, "Other words alone, nine of them, and no passage."), (3, " ".join(ITEM.findall(item)[3:11])), (4, " ".join(ITEM.findall(item)[3:10]))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in decontamination.clean_documents(d, benchmark).collect()) == [2, 4]
    # odd rows stay, repeated ones each, with all their columns
    kept = decontamination.clean_documents(odd, benchmark)
    assert kept.schema == odd.schema and sorted(map(repr, kept.collect())) == sorted(map(repr, odd.collect()))


def test_op9_base_spans(docs):
    assign = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")

    def brute(t):
        out = [("assign", m.start(), m.end()) for m in assign.finditer(t) if len(m[2]) >= 8]
        out += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        return out + [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 32]

    rng = random.Random(4)
    strange = ["".join(rng.choice(['Token', 'api_key', 'PASSWD', '"', "'", ':', '=', ' ', 'AKIA', 'A1', 'ab12', '0' * 20, 'ſecret', 'toKen']) for _ in range(14)) for _ in range(800)]
    for t in [*strange, *texts(docs).values()]:
        assert secrets.base_spans(t) == brute(t)
        assert not brute(t) or secrets.worth_scanning(t.encode())


def test_op9_novelty(spark):
    key = "xK9vQ2mZ7pL4tR8wB3nY6cD1"
    filler = [(i, f"set the secret token name to user_session_manager_{i % 3} and read configuration_manager_v2 from the session table") for i in range(30)]
    cases = [(100, f"é the bearer is {key} for you"), (101, "the bearer is configuration_manager_v2 for the session"), (102, f"no context for {key} here"), (103, 'password = "hunter2hunter2"'), (104, "the bearer is valid until 2031-07-09T11:52:48 or ask x7q9zk31vw@q8.example.com now")]
    d = spark.createDataFrame(filler + cases, "doc_id long, text string").withColumn("n_chars", F.length("text"))
    got = rows(secrets.find_secrets(d))
    assert got[100]["spans"] == f"novel:16:{16 + len(key)}" and got[101]["spans"] == "" and got[102]["spans"] == got[104]["spans"] == "" and got[103]["n_assign"] == 1
    clean = rows(secrets.without_secrets(d))
    assert clean[100]["text"] == "é the bearer is [novel removed] for you" and clean[100]["n_chars"] == len(clean[100]["text"])
    assert clean[103]["text"] == 'password = "[assign removed]"' and clean[102]["text"] == cases[2][1] and len(clean) == len(filler) + len(cases)
    assert secrets.redacted("0123456789", [("hex", 1, 4), ("novel", 2, 6), ("hex", 8, 9)]) == "0[hex removed]67[hex removed]9"


def test_op9_verdicts_against_brute_force(docs):
    """Spans and dictionary by their definitions, a character at a time."""
    import zstandard

    near = re.compile(r"(?i)password|passwd|pwd|secret|token|api[_-]?key|credential|private[_ -]?key|access[_-]?key|bearer|authorization|auth[_-]?key", re.ASCII)
    rng = random.Random(19)
    parts = ["token = ", "bearer ", "pwd is ", " and then ", "the_handler ", "config_value_9 ", "AKIA" + "Q7" * 8 + " ", "0a1b" * 9 + " ", "password: hunter2hunter2 ", "secret ", *("".join(rng.choice("abcXYZ0189+/") for _ in range(n)) + " " for n in (11, 12, 20, 40)), "é ", "\n"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) for _ in range(300)] + [t for t in texts(docs).values() if secrets.base_spans(t)]

    def brute(t, known):
        base = secrets.base_spans(t)
        value = {(s + re.match(r"(?is)[a-z_]+[\"']? *[:=] *[\"']?", t[s:e]).end(), e) if k == "assign" else (s, e) for k, s, e in base}
        found = set(value)
        last = -1
        for m in near.finditer(t):
            s = max(m.end(), last)
            while True:
                while s < len(t) and not re.match(r"[A-Za-z0-9+/_.=~!@#$%^&*-]", t[s]):
                    s += 1
                if s >= len(t) or s > m.end() + 40:
                    break
                e = s
                while e < len(t) and re.match(r"[A-Za-z0-9+/_.=~!@#$%^&*-]", t[e]):
                    e += 1
                a, b = s, e
                while a < b and t[a] in "=.":
                    a += 1
                while b > a and t[b - 1] in ".!=":
                    b -= 1
                if b - a >= 12 and re.search("[0-9]", t[a:b]) and re.search("[A-Za-z]", t[a:b]) and all(b <= x or a >= y for _, x, y in base):
                    found.add((a, b))
                last = s = e
        covered = {i for s, e in [*found, *((s, e) for _, s, e in base)] for i in range(s, e)}
        novel = []
        for s, e in sorted(found):
            bare = lambda i, j: "".join(" " if k in covered else t[k] for k in range(i, j)).replace(t[s:e], " " * (e - s))  # noqa: B023, E731
            around = bare(max(0, s - 256 - (e - s)), s)[-256:] + "\n" + bare(e, min(len(t), e + 256 + e - s))[:256]
            primer = known + b"\n" + around.encode()
            p = zstandard.ZstdCompressionParameters.from_level(9, dict_size=len(primer), source_size=len(t[s:e].encode()), min_match=3, write_content_size=False, write_checksum=False, write_dict_id=False)
            c = zstandard.ZstdCompressor(compression_params=p, dict_data=zstandard.ZstdCompressionDict(primer, dict_type=zstandard.DICT_TYPE_RAWCONTENT))
            if len(c.compress(t[s:e].encode())) - len(c.compress(b"")) >= 0.85 * (e - s):
                novel.append(("novel", s, e))
        return novel

    known, many = b"the_handler config_value_9 hunter2hunter2", 0
    for t in made:
        got = secrets.spans_of(t, known)
        assert got == (secrets.base_spans(t), brute(t, known)), t
        many += len(got[1])
    assert many > 300


def test_op9_on_planted_strings(spark, docs):
    """Random strings of contexts that no base pattern knows are found; names made of the corpus' own words are mostly left."""
    rng = random.Random(23)
    names = ["connection_manager", "request_handler", "session_timeout", "database_config", "payload_index", "response_buffer"]
    whole = [(i, f"the access_key of {a} and the secret {b} go to {c}") for i, (a, b, c) in enumerate(rng.sample(names, 3) for _ in range(40))]
    marks = "ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz0123456789+/"
    plain = [t for t in texts(docs).values() if len(t) > 200][:60]
    cases = []
    for i, t in enumerate(plain):
        at = t.index(" ", len(t) // 2)
        value = "".join(rng.choice(marks) for _ in range(rng.randint(16, 48))) + "7a" if i % 2 else f"{rng.choice(names)}_{rng.choice(names)}{i % 10}"
        cases.append((1000 + i, f"{t[:at]} {rng.choice(['bearer', 'credential', 'private key', 'Authorization:'])} {value}{t[at:]}", value))
    got = rows(secrets.find_secrets(spark.createDataFrame(whole + [c[:2] for c in cases], "doc_id long, text string")))
    hit = lambda c: any(k == "novel" and c[1][int(s) : int(e)] == c[2] for k, s, e in (x.split(":") for x in got[c[0]]["spans"].split(",") if x))
    secret, names_hit = [hit(c) for c in cases if c[0] % 2], [hit(c) for c in cases if not c[0] % 2]
    assert np.mean(secret) > 0.97 and np.mean(names_hit) < 0.1


def test_op9_secrets_do_not_hide_secrets(spark):
    first, second, third = "xK9vQ2mZ7pL4tR8wB3nY6cD1", "hT5jW8qF2sV7gN4kP9rX3bM6", "uE4dL7zC1yH8aJ3oS6iG9fQ2"
    text = f"the token is {first} and the secret is {second} here"
    cases = [(i, text) for i in range(40)] + [(100, f"the bearer {third} is the same as {third} in this text, and once more {third}")]
    d = spark.createDataFrame(cases, "doc_id long, text string")
    got, clean = rows(secrets.find_secrets(d)), rows(secrets.without_secrets(d))
    at = [(text.index(k), text.index(k) + 24) for k in (first, second)]
    assert all(got[i]["spans"] == ",".join(f"novel:{s}:{e}" for s, e in at) for i in range(40))
    assert got[100]["spans"].startswith("novel:11:35") and third not in clean[100]["text"][:30] and first not in clean[0]["text"] and second not in clean[0]["text"]
    known = secrets.identifier_dictionary(d).decode().split()
    assert not {first, second, third} & set(known) and "here" not in known


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("token for amqp://svc:kX93mQz7Lp2v@mq.example.com", ["kX93mQz7Lp2v"]),
        ("token for amqp://svc8kX93mQz7Lp2v@mq.example.com:5672/v", ["svc8kX93mQz7Lp2v"]),
        ("bearer svc:kX93mQz7Lp2v@mq.example.com", ["kX93mQz7Lp2v"]),
        ("the password p7@ss.w0rdXyz9Qk works", ["p7@ss.w0rdXyz9Qk"]),
        ("secret 2024-01-15aB3xK9vQ2m", ["2024-01-15aB3xK9vQ2m"]),
        ("token in https://api1.example.com/v2/cb?sig=aB3xK9vQ2mT7==&id=zP4rL8nW5kD1#x", ["aB3xK9vQ2mT7", "zP4rL8nW5kD1"]),
        ("bearer https://api1.example.com/hooks/aB3xK9vQ2mT7/x", ["aB3xK9vQ2mT7"]),
        ("credential //8K3xK9vQ2mT7pL4t", ["//8K3xK9vQ2mT7pL4t"]),
        ("the token ends 2031-07-09T11:52:48.123456789Z or 20310709T115248Z, 2031-07-09T11:52+02:00", []),
        ("the token of mailto:x7q9zk31vw@q8.example.com or x7q9zk31vw@q8.example.com", []),
        ("the token of https://host12345.example.com/path", []),
    ],
)
def test_op9_only_whole_dates_and_addresses_are_left(text, found):
    base = secrets.base_spans(text)
    assert [text[s:e] for s, e in secrets.candidates(text, base)] == found
    spans = secrets.spans_of(text, b"")[1]
    assert [text[s:e] for _, s, e in spans] == found


def brute_ctw(train, text, depth):
    """Log10 probability by the recursive definition, one bit at a time, with counts of the training bytes."""
    counts = defaultdict(lambda: [0, 0])

    def steps(t):
        data = b"\0" * depth + low(t).encode() + b"\0"
        for i in range(depth, len(data)):
            for k in range(8):
                yield data[i - depth : i], (1 << k) | (data[i] >> (8 - k)), data[i] >> (7 - k) & 1

    for t in train:
        for c, node, bit in steps(t):
            for d in range(depth + 1):
                counts[c[depth - d :], node][bit] += 1
    kids = defaultdict(set)
    for c, node in counts:
        if c:
            kids[c[1:], node].add(c)
    memo = {}

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(c, node):
        if (c, node) not in memo:
            own = kt(*counts[c, node])
            memo[c, node] = own if len(c) == depth else np.logaddexp(own, sum(weighted(x, node) for x in kids[c, node])) - math.log(2)
        return memo[c, node]

    def predict(c, node, d):
        name = c[depth - d :]
        if (name, node) not in counts:
            return 0.5
        a, b = counts[name, node]
        p = (b + 0.5) / (a + b + 1)
        if d == depth:
            return p
        w = math.exp(kt(a, b) - math.log(2) - weighted(name, node))
        return w * p + (1 - w) * predict(c, node, d + 1)

    return sum(math.log10(p if bit else 1 - p) for c, node, bit in steps(text) for p in [predict(c, node, 0)])


@pytest.mark.parametrize(("nodes", "frequent"), [(5_000_000, 1 << 20), (400, 3), (5_000_000, 0)])
def test_op10_against_brute_force(spark, nodes, frequent):
    rng = random.Random(11)
    cases = [(i, " ".join(rng.choice(["the", "The", "cat", "é", f"u{i}", "on"]) for _ in range(rng.randint(0, 9)))) for i in range(30)]
    cases += [(40, None), (41, ""), (42, "the cat"), (42, "the cat"), (None, "the cat")]
    got = lm_scoring.score(spark.createDataFrame(cases, "doc_id long, text string").repartition(3), 3, nodes, frequent).collect()
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    train = [t for d, t in cases if d is not None and not held(d)]
    count = Counter(w for t in train for w in [*SPACE.findall(low(t)), 0])
    n, v = sum(count.values()), len(count)
    want = []
    for d, t in cases:
        w = [*SPACE.findall(low(t)), 0]
        want.append((d, held(d), len(w), sum(count[x] > 0 for x in w), n, sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), brute_ctw(train, t, 3)))
    key = lambda r: (str(r[0]), r[2], r[6])
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-9 and abs(a[6] - b[6]) < 1e-3 * (1 + abs(b[6]))


def test_op10_counts_very_frequent_words_without_a_broadcast_tier(spark):
    cases = [(i, "the " * 1000 + f"cat u{i}") for i in range(1, 9)]
    d = spark.createDataFrame(cases, "doc_id long, text string")
    some, none = (sorted(tuple(r)[:6] for r in lm_scoring.score(d, 2, 5_000_000, frequent).collect()) for frequent in (1 << 20, 0))
    assert all(a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-9 * abs(a[5]) for a, b in zip(some, none, strict=True))
    assert all(r[3] >= 1002 for r in none)


def test_op10_learns(docs):
    got = lm_scoring.score(docs).join(docs.select("doc_id", F.octet_length("text").alias("n")), "doc_id").filter("n > 200").collect()
    bits = [-r["score"] / math.log10(2) / r["n"] for r in got if r["held_out"]]
    assert 1 < np.mean(bits) < 4


def test_op10_rare_bits_of_frequent_contexts_stay_finite():
    code, _ = lm_scoring.grams([b"aaaa"], 3)
    nodes, _ = lm_scoring.climb(*lm_scoring.leaves(np.unique(code), np.full(len(np.unique(code)), 1 << 40), 3), 3, 0)
    tree = lm_scoring.Tree(*[np.concatenate(x) for x in zip(*nodes)], 3)
    never = lm_scoring.grams([b"aaa!"], 3)[0]
    assert np.isfinite(tree.evaluate(never)).all() and tree.evaluate(never)[3] < 40 * -math.log(2)


def test_op10_held_out_scores_against_base_scores(spark):
    rng = random.Random(5)
    words = [chr(97 + i) + "tion" + chr(97 + 7 * i % 20) for i in range(20)]  # the last letter hangs on the fifth byte ahead of it
    d = spark.createDataFrame([(i, " ".join(rng.choice(words) for _ in range(60))) for i in range(1, 401)], "doc_id long, text string")
    got = lm_scoring.score(d).filter("held_out").collect()
    assert len(got) > 30 and all(math.isfinite(r["score"]) and r["score"] > 1.06 * r["base_score"] for r in got)


def test_word_hashes():
    rng = random.Random(2)
    t = " ".join("".join(rng.choice("abcé\t") for _ in range(rng.randint(0, 9))) for _ in range(4000)).encode()
    h, s, e = common.hash_words(t)
    w = t.split()
    assert [t[i:j] for i, j in zip(s, e)] == w and len(set(zip(w, h.tolist()))) == len(set(w)) == len(set(h.tolist()))
    old, common.BLOCK = common.BLOCK, 100
    try:
        assert all((x == y).all() for x, y in zip(common.hash_words(t), (h, s, e)))
    finally:
        common.BLOCK = old
