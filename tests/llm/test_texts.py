"""Operators on single texts against brute force, public libraries, round trips and held-out accuracy."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tunekit.llm import arrays, langid, merkle, secrets, unigram, wordpiece
from tunekit.llm.vocabulary import SPACE, Pieces, read_pieces

ODD = ["", " ", "  a\n\tb  ", "日本語 text ☃", "\U0001f926\U0001f3fc a", "ñandú" * 40, "x" * 5000, "a ▁ b", "tab\tnew\nline", "éé́"]


def test_word_hashes_do_not_depend_on_the_cut():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcXYZé") for _ in range(rng.randrange(1, 12))) for _ in range(300_000)] + ["w" * 70_000]
    text = np.frombuffer(" ".join(words).encode(), np.uint8)
    assert len(text) > arrays.PIECE
    long, _ = arrays.word_hashes(text, np.array([0, len(text)]))
    short = [arrays.word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]))[0][0] for w in words[:500] + words[-1:]]
    assert len(long) == len(words) and long[:500].tolist() + long[-1:].tolist() == short


def test_giant_word():
    text = np.frombuffer(b"a " + b"b" * (3 << 20) + b" a", np.uint8)
    got, at = arrays.word_hashes(text, np.array([0, len(text)]))
    assert len(got) == 3 and got[0] == got[2] != got[1] and at.tolist() == [0, 3]


@pytest.fixture(scope="module")
def texts(tables):
    return [r.text for r in tables("documents").orderBy("doc_id").limit(60).collect()] + ODD


def test_word_piece_counts(frame, texts):
    pieces = read_pieces()
    known = {pieces.pieces[i] for i in pieces.normal()}
    longest = max(map(len, known))

    def greedy(word):
        n = at = 0
        while at < len(word):
            end = next((e for e in range(min(len(word), at + longest), at, -1) if word[at:e] in known), None)
            if end is None:
                return 1, 1
            n, at = n + 1, end
        return n, 0

    rows = [*enumerate(texts), (900, None), (None, "a b")]
    got = {r.doc_id: r.tokens for r in wordpiece.count_tokens(frame(rows), pieces).collect()}
    for i, t in rows:
        counts = [greedy(SPACE + w) for w in wordpiece.WORD.findall(t or "")]
        assert tuple(got[i]) == (len(counts), sum(c for c, _ in counts), sum(u for _, u in counts))
    assert wordpiece.count_tokens(frame([]), pieces).collect() == []


def test_failure_links_when_the_longest_piece_fails():
    automaton = wordpiece.Automaton(["a", "ab", "abcdx", "c", "cd", "b", "bcdy"])
    assert [automaton.count(w) for w in ("abcd", "abcdx", "abcdab", "bcd", "bcdy", "")] == [2, 1, 3, 2, 1, 0]
    assert automaton.count("abz") == wordpiece._UNKNOWN + 1


def test_unigram_against_the_public_library(texts):
    from tokenizers import Tokenizer, models

    pieces = read_pieces()
    encoder = unigram.Encoder(unigram.build(pieces))
    other = Tokenizer(models.Unigram(list(zip(pieces.pieces, pieces.scores)), unk_id=0, byte_fallback=True))
    for t in texts:
        parts = unigram.PART.findall(SPACE + t.replace(" ", SPACE)) if t else []
        assert encoder.encode(t).tolist() == [i for p in parts for i in other.encode(p).ids]


def test_unigram_best_path_by_brute_force():
    rng = random.Random(6)
    for _ in range(30):
        names = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 4))) for _ in range(8)} | {SPACE, SPACE + "a"})
        pieces = Pieces(("<unk>", *names), (0.0, *(-float(rng.randrange(1, 40)) for _ in names)), (), frozenset([0]))
        encoder = unigram.Encoder(unigram.build(pieces))
        scores = dict(zip(names, pieces.scores[1:]))

        def best(text):
            sums = [0.0] + [float("-inf")] * len(text)
            for end in range(1, len(text) + 1):
                for start in range(end):
                    p = text[start:end]
                    if p in scores:
                        sums[end] = max(sums[end], sums[start] + scores[p])
                    elif len(p) == 1:
                        sums[end] = max(sums[end], sums[start] + encoder.missing)
            return sums[-1]

        text = "".join(rng.choice("abc d") for _ in range(14))
        ids = encoder.encode(text).tolist()
        cost = sum(encoder.missing if i == 0 else pieces.scores[i] for i in ids)
        assert cost == pytest.approx(best(SPACE + text.replace(" ", SPACE)))


def test_unigram_round_trip(frame, texts):
    rows = [*enumerate(texts), (900, None), (None, "a b")]
    data = frame([(i, t, 1) for i, t in rows], "doc_id long, text string, ids int")
    got = unigram.encode(data, unigram.build(read_pieces())).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.decoded == (r.text.replace(SPACE, " ") if r.text is not None else None)
        assert (r.ids is None) == (r.text is None) and (r.text != "" or r.ids == [])
    assert unigram.encode(frame([]), unigram.build(read_pieces())).collect() == []


def test_unigram_of_long_texts_without_spaces():
    encoder = unigram.Encoder(unigram.build(read_pieces()))
    line = "".join(random.Random(8).choice("abcdefgh,.;:()0123456789") for _ in range(49)) + "\n"
    whole = encoder.best(SPACE + line * 20)
    assert encoder.encode(line * 20).tolist() == list(whole)
    for text in (line * 200_000, "x" * 10_000_000):
        assert encoder.decode(encoder.encode(text)) == text


def test_language_id(frame, spark, tables):
    docs = tables("documents")
    out = langid.held_out(F.col("doc_id"))
    got = langid.identify(docs.withColumn("held_out", out), langid.train(docs.where(~out))).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r.lang_pred == r.lang for r in got if r.held_out]
    assert len(held) > 40 and sum(held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_id_counts(frame):
    rows = [("ab, ab", "x"), ("ab", "x"), ("ba", "y"), (None, "y"), ("zz", None), ("12", "y")]
    model = langid.train(frame(rows, "text string, lang string"))
    assert model.languages == ["x", "y"] and np.allclose(np.exp(model.prior), [2 / 3, 1 / 3])
    counts = np.zeros((2, langid.BUCKETS))
    for t, lang in rows:
        if t and lang:
            np.add.at(counts["xy".index(lang)], langid.features([t])[1], 1)
    p = counts + langid.SMOOTHING
    assert np.allclose(model.log_p, np.log(p / p.sum(axis=1, keepdims=True)))


def test_language_id_edges(frame):
    model = langid.train(frame([("abc", "x"), ("xyz", "y")], "text string, lang string"))
    got = langid.identify(frame([(1, None), (2, ""), (3, "12 !!"), (None, "abc"), (4, "xyz " * 300_000)]), model).collect()
    assert {r.doc_id: (r.lang_pred, r.score > 0.5) for r in got} == {1: ("und", False), 2: ("und", False), 3: ("und", False), None: ("x", True), 4: ("y", True)}
    empty = langid.train(frame([], "text string, lang string"))
    assert [(r.lang_pred, r.score) for r in langid.identify(frame([(1, "abc")]), empty).collect()] == [("und", 0.0)]
    assert langid.identify(frame([]), model).collect() == []


def py_root(text):
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return h("|".join(h(",".join(h(p) for p in s.split("\n"))) for s in text.split("\n\n")))


def py_leaves(text):
    return {p[i : i + merkle.BLOCK] for p in text.split("\n") for i in range(0, len(p), merkle.BLOCK)}


def near(a, b):
    if a == b:
        return 1.0
    x, y = py_leaves(a), py_leaves(b)
    return 2 * len(x & y) / (len(x) + len(y)) if x or y else 0.0


def test_fingerprints(frame, texts):
    rows = [(3 * i - 50, t) for i, t in enumerate(texts)] + [(5000, "a\n\nb\n\n\nc"), (5001, "a\nb\n\nc"), (5002, None)]
    got = {r.doc_id: r for r in merkle.fingerprints(frame(rows)).collect()}
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        m = len(t) // 4
        edited = t[: len(t) - m] + after[:m]
        r = got[i]
        assert (r.n_chars, r.edited, r.fingerprint, r.edited_fingerprint) == (len(t), edited, py_root(t), py_root(edited))
        assert (r.near_edited, r.near_next) == pytest.approx((near(t, edited), near(t, after)))


def test_next_text_edges(frame):
    assert merkle.with_next(frame([])).collect() == []
    assert [tuple(r) for r in merkle.with_next(frame([(4, "one")])).collect()] == [(4, "one", "one")]
    rows = [(1, "b", "r"), (1, "a", "s"), (1, "a", "t"), (None, "n", "u"), (9, "z", "v")]
    got = sorted(merkle.with_next(frame(rows, "doc_id long, text string, range string")).collect(), key=str)
    assert [tuple(r) for r in got] == sorted([(1, "a", "a"), (1, "a", "b"), (1, "b", "z"), (None, "n", "a"), (9, "z", "n")], key=lambda x: f"Row(doc_id={x[0]}, text={x[1]!r}, next_text={x[2]!r})")


def test_branches_locate_edits(spark):
    pairs = [("a\nb\n\nc\nd", "a\nb\n\nc\nX", [(1, 1)]), ("a", "a", []), ("a", "a\nb", [(0, 1)]), ("a\n\nb", "a", [(1, 0)]), ("", "x", [(0, 0)])]
    df = spark.createDataFrame([(a, b) for a, b, _ in pairs], "a string, b string").coalesce(1)
    got = df.select(merkle.differing_branches(merkle.tree(F.col("a")), merkle.tree(F.col("b"))).alias("d")).collect()
    assert [[tuple(x) for x in r.d] for r in got] == [want for _, _, want in pairs]


@pytest.fixture(scope="module")
def dictionary(spark):
    return spark.createDataFrame([(w,) for w in ("correct", "horse", "battery")], "word string")


def test_secret_candidates(frame, dictionary):
    rows = [
        (1, 'set password="b7db7aa4a5fcc78305", then', "src/app"),
        (2, "mail abcdefgh.42@mail1.example.com today", "docs/readme"),
        (None, "correcthorse1234 stays", None),
        (3, None, "x"),
        (4, "", "x"),
        (5, "nothing here", "x"),
        (6, "token = 0641917ea4e9feb9cda8", "tests/fixture.py"),
    ]
    docs = frame([(*r, "clash") for r in rows], "doc_id long, text string, source string, value string")
    got = {r.doc_id: r for r in secrets.with_features(secrets.candidates(docs), dictionary).collect()}
    assert set(got) == {1, 2, None, 6}
    assert (got[1].value, got[1].name, got[1].word, got[1].before, got[1].after) == ("b7db7aa4a5fcc78305", "password", 1, "set", "then")
    assert got[1].secret_name == 1 and got[1].length == 18 and got[1].hex_share == 1.0 and got[1].path_depth == 1
    assert got[None].dictionary_share == pytest.approx(0.0) and got[None].digit_share == pytest.approx(4 / 16)
    assert (got[6].before, got[6].secret_neighbours, got[6].test_path) == ("token =", 1, 1)
    assert got[2].ordinary_neighbours == 1 and got[2].test_path == 1
    spaced = secrets.with_features(secrets.candidates(frame([(1, "correct-horse-1234", "")], "doc_id long, text string, source string")), dictionary).first()
    assert spaced.dictionary_share == pytest.approx(12 / 18)


def test_secret_forest_on_held_out_findings(spark, dictionary):
    rng = random.Random(9)
    rows = []
    for i in range(600):
        if i % 3 == 0:
            rows.append((i, f"the token = {''.join(rng.choice('0123456789abcdef') for _ in range(40))} here", "src/a"))
        elif i % 3 == 1:
            rows.append((i, f"mail {rng.choice('abcdef') * 6}.{rng.randrange(99)}@host{rng.randrange(9)}.example.com", "src/b"))
        else:
            rows.append((i, f"card {rng.randrange(10**15, 10**16)} paid", "src/c"))
    found = secrets.with_features(secrets.candidates(spark.createDataFrame(rows, "doc_id long, text string, source string")), dictionary)
    labelled = secrets.labelled_by_format(found).cache()
    model = secrets.train(labelled.where("doc_id % 4 != 0"))
    got = secrets.sorted_findings(labelled.where("doc_id % 4 = 0"), model).collect()
    assert len(got) == 150 and sum(r.is_secret == (r.label == 1) for r in got) >= 147
    assert secrets.train(labelled.where("label = 1")) is None
    alone = secrets.sorted_findings(labelled.where("label = 1"), None)
    assert alone.where("probability IS NULL AND is_secret").count() == 200


def test_secret_scan_of_nothing(frame, dictionary):
    assert secrets.scan(frame([], "doc_id long, text string, source string"), dictionary).collect() == []


def test_language_id_in_portions(frame, monkeypatch):
    texts = ["", None, "a", "Ab c, de fg!", "12", "Straße Σίσυφος " * 9, "x" * 100, " \n ", "ñ"]
    whole = langid.features(texts)
    model = langid.train(frame([(t, "x" if i % 2 else "y") for i, t in enumerate(texts)], "text string, lang string"))
    langs, shares = langid.score(texts, model)
    for size in (1, 2, 3, 7, 64):
        monkeypatch.setattr(langid, "CHARS", size)
        part = langid.features(texts)
        assert sorted(zip(*part[:2])) == sorted(zip(*whole[:2])) and (part[2] == whole[2]).all()
        again = langid.score(texts, model)
        assert again[0] == langs and np.allclose(again[1], shares)
