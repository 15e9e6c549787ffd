"""Operators on pairs and repeats of texts against brute force."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tunekit.llm import bytededup, decontaminate, linedup, parityjoin, spark_tools, unitdedup
from tunekit.llm.spark_tools import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOCABULARY = [f"{a}{b}" for a in "the of and tion ing er été ß".split() for b in "a o xy lm".split()]


def words(rng, n):
    return [rng.choice(VOCABULARY) for _ in range(n)]


def near_copies(rng, base, n, edits):
    for _ in range(n):
        copy = list(base)
        for _ in range(edits):
            copy[rng.randrange(len(copy))] = rng.choice(VOCABULARY) + "q"
        yield copy


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    texts = [" ".join(words(rng, rng.choice([0, 1, 3, 4, 5, 9, 40, 90]))) for _ in range(40)]
    for size, edits in ((300, 9), (120, 4), (33, 1), (700, 22)):
        base = words(rng, size)
        texts += [" ".join(c) for c in near_copies(rng, base, 18, edits)] + [" ".join(base)] * 3
    shared = words(rng, 60)
    texts += [" ".join(words(rng, 80) + shared + words(rng, 90)) for _ in range(25)]
    texts += ["A  B c", "a b\tC", "", None, "ONE two three four five", "one TWO three four\nfive"]
    return list(enumerate(texts))


def brute_join(rows):
    def lower(t):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")

    sets = {}
    for i, t in rows:
        w = WORD.findall(lower(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    group = {i: i for i in sets}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for (i, a), (j, b) in itertools.combinations(sorted(sets.items()), 2):
        if a and b and 100 * len(a & b) >= 80 * len(a | b):
            x, y = find(i), find(j)
            group[max(x, y)] = min(x, y)
    return {(i, len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("small", [2, 12])
def test_parity_join(frame, corpus, small):
    got = parityjoin.similar_documents(frame(corpus), small).collect()
    assert {tuple(r) for r in got} == brute_join(corpus)
    assert len(got) == len(corpus)


def test_parity_join_in_steps(frame, corpus, monkeypatch):
    for name, value in (("PAIRS", 0), ("STEP", 5000), ("BLOCK", 4), ("ROW", 2)):
        monkeypatch.setattr(parityjoin, name, value)
    rng = random.Random(9)
    base = words(rng, 200)
    rows = corpus[::2] + [(1000 + i, " ".join(c)) for i, c in enumerate(near_copies(rng, base, 40, 4))]
    got = parityjoin.similar_documents(frame(rows), 4).collect()
    assert {tuple(r) for r in got} == brute_join(rows)


def test_parity_join_keeps_as_much_with_more_shards(frame, spark, monkeypatch):
    """Twelve near copies of each text: what is kept of the pairs that keys show doesn't grow with the number of shards."""
    rng = random.Random(4)
    rows = list(enumerate(" ".join(c) for _ in range(6) for c in near_copies(rng, words(rng, 300), 12, 3)))
    kept, before = [], spark.conf.get("spark.sql.shuffle.partitions")
    for shards in ("4", "64"):
        made = {}

        def stage(df, name, made=made):
            out = spark_tools.stage(df, name)
            made.setdefault(name, out.count())
            return out

        monkeypatch.setattr(parityjoin, "stage", stage)
        spark.conf.set("spark.sql.shuffle.partitions", shards)
        try:
            got = parityjoin.similar_documents(frame(rows)).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
        assert {tuple(r) for r in got} == brute_join(rows)
        kept.append(made["parity-found"])
    assert kept[1] < 1.5 * kept[0]


def test_stage_frees_what_it_shuffles(spark):
    tracker = spark.sparkContext._jsc.sc().env().mapOutputTracker()
    shuffles = lambda: set(tracker.shuffleStatuses().keySet().toString().strip("Set()[]").split(", ")) - {""}
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, was = shuffles(), spark.conf.get(key, None)
    table = spark_tools.stage(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "test-freed")
    assert shuffles() <= before and spark.conf.get(key, None) == was
    assert sorted(r["count"] for r in table.collect()) == [142] + [143] * 6


def test_parity_join_edges(frame):
    assert parityjoin.similar_documents(frame([])).collect() == []
    rows = [(None, "a b c d e f", "x"), (1, "a b c d e f", None), (1, "a b c d e f", "y"), (2, None, "z"), (0, "A B c d e f", "z")]
    got = parityjoin.similar_documents(frame(rows, "doc_id long, text string, cls string").withColumn("n", F.lit(1))).collect()
    assert sorted(((r.doc_id or -1, r.n_shingles, r.component_id) for r in got), key=str) == sorted([(-1, 2, None), (1, 2, 0), (1, 2, 0), (2, 0, 2), (-1, 2, 0)], key=str)


def test_sketch_bounds_difference():
    rng = np.random.default_rng(1)
    for n, m in ((1, 1), (5, 40), (300, 310), (64, 2000)):
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.r_[a[: n // 2], rng.integers(0, 2**63, m, dtype=np.uint64)])
        assert parityjoin.hamming(parityjoin.bit_sketch(a), parityjoin.bit_sketch(b)) <= len(np.setxor1d(a, b))


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 200), (200, 300), (300, 100), (7, 7)] + [(500, 500 + i) for i in range(1, 30)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 200: 100, 300: 100} | {500 + i: 500 for i in range(30)}


def brute_bytes(rows):
    seen, out = {}, {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        b = (t or "").encode()
        gone = set()
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone.update(range(k, k + 100))
            seen.setdefault(b[k : k + 100], (i, k))
        kept = bytes(c for k, c in enumerate(b) if k not in gone)
        spans = sum(k - 1 not in gone for k in gone)
        out[i] = (len(b), len(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_byte_dedup(frame, corpus):
    rng = random.Random(3)
    passage = "".join(rng.choice("abcdé ") for _ in range(400))
    rows = corpus + [(1000 + i, "".join(rng.choice("xyzwü") for _ in range(150)) + passage[i : i + 300] + str(i)) for i in range(12)]
    rows += [(2000, "a" * 1000), (2001, "ab" * 90 + "a" * 130), (2002, passage * 3), (2003, "x" * 99), (2004, "x" * 100), (2005, "x" * 101)]
    got = bytededup.without_repeats(frame(rows)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute_bytes(rows)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)


def test_byte_dedup_long_text_in_parts(frame, monkeypatch):
    rng = random.Random(8)
    block = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    rows = [(1, block + "".join(rng.choice("ijklm") for _ in range((1 << 20) + 500)) + block), (2, block[100:2000])]
    got = {r.doc_id: r for r in bytededup.without_repeats(frame(rows)).collect()}
    assert (got[1].n_removed, got[1].n_spans, got[2].n_removed) == (3000, 1, 1900)


def test_byte_dedup_edges(frame):
    assert bytededup.without_repeats(frame([])).collect() == []
    text = "".join(chr(97 + i % 23) + str(i) for i in range(90))
    rows = [(None, text, 1), (5, text, 2), (5, text, 3), (6, text + "z", 4), (7, None, 5)]
    got = bytededup.without_repeats(frame(rows, "doc_id long, text string, start long")).collect()
    size = len(text)
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_removed) for r in got) == sorted([(-1, size, 0), (5, size, 0), (5, size, 0), (6, size + 1, size), (7, 0, 0)])


def brute_lines(rows, k):
    seen, out = set(), {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        lines = (t or "").split("\n")
        gone = set()
        for p in range(len(lines) - k + 1):
            run = tuple(lines[p : p + k])
            if run in seen:
                gone.update(range(p, p + k))
            seen.add(run)
        out[i] = "\n".join(x for p, x in enumerate(lines) if p not in gone)
    return out


@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_line_dedup(frame, k):
    rng = random.Random(k)
    rows = [(i, "\n".join(rng.choice("abcde") for _ in range(rng.randrange(0, 14)))) for i in range(60)]
    got = linedup.without_repeated_lines(frame(rows), k).collect()
    assert {r.doc_id: r.text for r in got} == brute_lines(rows, k)


def test_line_dedup_edges(frame):
    assert linedup.without_repeated_lines(frame([])).collect() == []
    text = "a\nb\nc\nd"
    rows = [(None, text, 1), (3, text, 2), (3, text, 3), (4, None, 4), (5, "x\n" + text, 5), (6, "y" * 100_000, 6)]
    got = linedup.without_repeated_lines(frame(rows, "doc_id long, text string, pos long")).collect()
    assert {(r.pos, r.text) for r in got} == {(1, text), (2, text), (3, text), (4, None), (5, "x"), (6, "y" * 100_000)}
    assert {r.pos: [tuple(x) for x in r.removed_runs] for r in got if r.removed_runs} == {5: [(1, 5)]}


@pytest.mark.parametrize("kind", ["line", "paragraph"])
def test_unit_dedup(frame, kind):
    rng = random.Random(1)
    pool = [" ".join(words(rng, n)) + rng.choice([".", "?!", ""]) for n in (2, 4, 5, 6, 9, 30) for _ in range(3)]
    cut = "\n" if kind == "line" else "\n\n"
    unit = lambda: "  ".join(rng.choice([x, x.upper(), x.replace(" ", "\t ")]) for x in rng.choices(pool, k=rng.randrange(kind == "paragraph", 4)))
    rows = [(i, cut.join(unit() for _ in range(rng.randrange(0, 6)))) for i in range(60)]
    seen, want = set(), {}
    for i, t in rows:
        gone, at, kept = set(), 0, []
        for u in t.split(cut):
            parts = [(at + m.start(), m.group()) for m in re.finditer(r"[^.!?]*[.!?]+[ \t]*|[^.!?]+", u)]
            named = [("sentence", s, x) for s, x in parts] + ([("unit", at, u)] if len(parts) > 1 else [])
            for kind_, s, x in named:
                key = (kind_, *x.lower().split())
                if len(key) > 5 and key in seen:
                    gone.update(range(s, s + len(x)))
                seen.add(key)
            rest = "".join(c for k, c in enumerate(u, at) if k not in gone)
            if rest or not u:
                kept.append(rest)
            at += len(u) + len(cut)
        want[i] = (cut.join(kept), sorted(gone))
    got = unitdedup.without_repeated_units(frame(rows), kind).collect()
    assert {r.doc_id: (r.text, [k for s, e in r.removed_spans for k in range(s, e)]) for r in got} == want


def test_unit_dedup_inside_a_line(frame):
    passage = "Of all the words here none is new. And so it goes on and on. It has an end too, at last."
    rows = [(1, f"start of one {passage} and its end"), (2, f"other words. {passage}\nlast line"), (3, passage)]
    got = {r.doc_id: r for r in unitdedup.without_repeated_units(frame(rows)).collect()}
    assert got[2].text == "other words. Of all the words here none is new. \nlast line"
    assert got[1].text == rows[0][1] and got[3].text == ""


def test_unit_dedup_edges(frame):
    assert unitdedup.without_repeated_units(frame([])).collect() == []
    line = "one two three four five"
    rows = [(None, line, 1), (2, line, 2), (2, line, 3), (3, None, 4), (4, f"{line}\n{line}", 5), (5, "x" * 200_000, 6)]
    got = unitdedup.without_repeated_units(frame(rows, "doc_id long, text string, end long")).collect()
    assert {(r.end, r.text) for r in got} == {(1, line), (2, line), (3, line), (4, None), (5, ""), (6, "x" * 200_000)}


def brute_leaks(docs, items):
    numbers: dict[str, int] = {}

    def tokens(t):
        found = re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (t or "").lower())
        return np.array([numbers.setdefault(w, len(numbers)) for w in found], dtype=np.int32)

    texts, out = {d: tokens(t) for d, t in docs}, set()
    for i, u in items:
        y = tokens(u)
        w = min(13, len(y))
        if w < 8:
            continue
        need = 11 if w == 13 else w
        for d, x in texts.items():
            p, q = len(x) - w + 1, len(y) - w + 1
            if p > 0:
                same = x[:, None] == y[None, :]
                if sum(same[k : k + p, k : k + q].astype(np.int8) for k in range(w)).max() >= need:
                    out.add((d, i))
    return out


def test_decontamination(frame, spark):
    rng = random.Random(2)
    items = [(i, " ".join(words(rng, n))) for i, n in enumerate([30, 40, 13, 12, 8, 7, 1, 0, 25, 25])] + [(10, None)]
    docs = [(0, None), (1, ""), (2, " ".join(words(rng, 60)))]
    for k in range(60):
        base = rng.choice(items[:10])[1].split()
        for _ in range(rng.randrange(0, 6)):
            if base:
                base[rng.randrange(len(base))] = "other"
        docs.append((3 + k, " ".join(words(rng, rng.randrange(0, 20)) + [w.title() + "," for w in base] + words(rng, 10))))
    got = decontaminate.contaminated(frame(docs), frame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == brute_leaks(docs, items)
    assert len(got) == len({(r.doc_id, r.item_id) for r in got})


def test_decontamination_of_short_items(frame):
    rng = random.Random(5)
    items, docs = [], []
    for n in range(1, 13):
        item = [f"w{n}x{k}" for k in range(n)]
        items.append((n, " ".join(item)))
        for off in range(4):
            near = list(item)
            for k in rng.sample(range(n), min(off, n)):
                near[k] = "other"
            docs.append((10 * n + off, " ".join(["before", *near, "after"])))
    items += [(20, "\u6c34\u306e\u4e2d\u3067\u9b5a\u304c\u6cf3\u3050"), (21, " ?! "), (22, None)]
    docs += [(200, "\u305d\u306e\u6c34\u306e\u4e2d\u3067\u9b5a\u304c\u6cf3\u304e\u3001"), (201, "\u9b5a\u304c\u6cf3\u3050")]
    bench = frame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(frame(docs), bench, short_items=True).collect()}
    assert got == {(10 * n + off, n) for n in range(1, 13) for off in range((n >= 5) + (n >= 10) + 1)} | {(200, 20)}
    assert {r.item_id for r in decontaminate.unsearchable(bench).collect()} == {21, 22}


def test_decontamination_edges(frame):
    none, text = frame([], "item_id long, text string"), " ".join("abcdefghijklmnop")
    assert decontaminate.contaminated(frame([(1, text)]), none).collect() == []
    assert decontaminate.contaminated(frame([]), frame([(1, text)], "item_id long, text string")).collect() == []
    docs = frame([(None, text, 1), (2, text, 2), (2, text, 3)], "doc_id long, text string, item_id long")
    got = decontaminate.contaminated(docs, frame([(7, text)], "item_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.item_id, r.first_word, r.end_word, r.item_words_found, r.item_words) for r in got) == [(-1, 7, 0, 16, 16, 16), (2, 7, 0, 16, 16, 16)]


def parity_word(n, flip):
    """Letters by the parity of ones in their place's binary digits; a word and its complement agree in many polynomial hashes."""
    return "".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(n))


def test_long_words_that_polynomial_hashes_confuse(frame):
    pairs = [(parity_word(n, 0), parity_word(n, 1)) for n in (256, 257, 512, 1024, 2048, 70_000)]
    texts = [w for pair in pairs for w in pair] + [f"{w} b c d e f" for pair in pairs for w in pair]
    rows = list(enumerate([*texts, *texts[:3]]))
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in parityjoin.similar_documents(frame(rows)).collect()}
    assert got == brute_join(rows)
    items = frame([(1, f"{pairs[3][0]} two three")], "item_id long, text string")
    docs = frame([(1, f"{pairs[3][0]} two three"), (2, f"{pairs[3][1]} two three")])
    assert [r.doc_id for r in decontaminate.contaminated(docs, items, short_items=True).collect()] == [1]
