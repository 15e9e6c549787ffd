"""Byte-level BPE, the Merkle manifest and vector codes against brute force."""

import base64
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tunekit.llm import bpe, manifest, vectorcodes

public_tokenizers = pytest.importorskip("public_tokenizers")
SPACES = " \n\t　\xa0 \x85"


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def merged(table, match: bytes) -> list[int]:
    """Byte pairs joined one at a time, lowest rank first."""
    parts = [bytes([b]) for b in match]
    while len(parts) > 1:
        found = [(table[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in table]
        if not found:
            break
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [table[p] for p in parts]


def brute_ids(ranks, text):
    import regex

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.table.splitlines())}
    return [i for m in regex.findall(ranks.pattern, text) for i in merged(table, m.encode())]


def test_bpe_by_brute_force(frame, ranks, tables):
    texts = [r.text for r in tables("documents").orderBy("doc_id").limit(25).collect()]
    texts += ["", " ", "\n\n", "don't  stop'll 's", "日本語 ٣٤ 😀​", "a  b\t\n c", "x" * 300, "é" * 50, "<|endoftext|>"]
    rows = [(i, t, "kept", 7) for i, t in enumerate(texts)] + [(None, None, None, None)]
    docs = frame(rows, "doc_id long, text string, `a.b` string, IDS int")
    got = bpe.encode(docs, ranks)
    assert got.columns == ["doc_id", "text", "a.b", "ids", "decoded"]
    found = {r.doc_id: r for r in got.collect()}
    for i, t in enumerate(texts):
        assert (found[i].ids, bytes(found[i].decoded), found[i]["a.b"]) == (brute_ids(ranks, t), t.encode(), "kept")
    assert (found[None].ids, bytes(found[None].decoded), found[None].text) == ([], b"", None)
    assert bpe.encode(frame([]), ranks).collect() == []
    assert bpe.encode(frame([("a",)], "text string").select("text"), ranks, ids="text").columns == ["text", "decoded"]


def test_bpe_bytes_that_are_no_utf8(spark, ranks):
    got = bpe.encode(spark.range(1).select(F.expr("cast(x'61ff62' AS string)").alias("text")), ranks).first()
    assert bytes(got.decoded) == "a�b".encode()


def test_cuts_of_long_texts_change_nothing(ranks, monkeypatch):
    """Short limits, so that every kind of cut is met; the library codes the texts whole."""
    import re

    monkeypatch.setattr(bpe, "SEGMENT", 40)
    monkeypatch.setattr(bpe, "_RUNS", re.compile(bpe._RUNS.pattern.replace(str(bpe.RUN), "4")))
    coder, rng = bpe.Coder(ranks), random.Random(3)
    bits = [*"aBz09!_-'é日٣😀\x1c​́", "'s", "'ll", "'", "\r\n", *SPACES]
    for _ in range(1500):
        text = "".join(rng.choice(bits) * rng.choice([1, 1, 1, 2, 9]) for _ in range(rng.randrange(1, 90)))
        ids = coder.encode(text)
        assert ids.tolist() == coder.by_match.encode_ordinary(text), text
        assert "".join(p for p, _ in bpe.segments(text)) == text and coder.decode(ids) == text.encode()


@pytest.mark.parametrize("text", [" " * 3_000_000, "\n" * 2_000_000 + "a" + "\t " * 800_000 + "b", "x" * 2_000_000, "ab1," * 600_000])
def test_very_long_runs(ranks, text):
    coder = bpe.Coder(ranks)
    assert coder.decode(coder.encode(text)) == text.encode()


# --- manifest ------------------------------------------------------------------------------------


def h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(*values):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(leaves):
    """(top, per leaf its levels of (place, run))."""
    level, paths, at = list(leaves), [[] for _ in leaves], list(range(len(leaves)))
    while len(level) > 1:
        runs = [level[i : i + 16] for i in range(0, len(level), 16)]
        for k, i in enumerate(at):
            paths[k].append((i % 16, runs[i // 16]))
            at[k] = i // 16
        level = [h("".join(r)) for r in runs]
    return level[0], paths


def plain_manifest(rows):
    """rows of (source, id, leaf, claim): (root, sorted (source, id, leaf, subroot, proof, folded root))."""
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3] or ""))
        trees[s] = plain_tree([r[2] for r in groups[s]])
    root, over = plain_tree([trees[s][0] for s in names])
    out = []
    for s, upper in zip(names, over):
        for r, path in zip(groups[s], trees[s][1]):
            folded, proof = r[3] or r[2], ""
            for slot, run in path + upper:
                others = run[:slot] + run[slot + 1 :]
                proof += "".join(others)
                folded = h("".join(run[:slot]) + folded + "".join(run[slot + 1 :]))
            out.append((s, r[1], r[2], trees[s][0], proof, folded))
    return root, sorted(out, key=str)


def made(frame, rows):
    docs = frame([(*r, "x") for r in rows], "source string, doc_id long, leaf string, claim string, tree string")
    return manifest.manifest(docs, "source", "doc_id", F.unhex("leaf"), F.unhex("claim"))


def shuffled(n, sources, seed):
    rng = random.Random(seed)
    rows = [(s, rng.randrange(3 * n) - n, h(str(rng.random())), None) for s, n in sources for _ in range(n)]
    rows += rows[:5]  # repeated rows
    rows += [(sources[0][0], None, h("a"), None), (sources[0][0], None, h("b"), None)]
    rows = [(s, i, d, h("other") if k % 7 == 0 else None) for k, (s, i, d, _) in enumerate(rows)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(
    "sources",
    [
        [("a", 1)],
        [("a", 16), (None, 17), ("B", 1), ("é", 255)],
        [("hot", 5000), ("", 256), ("z", 257), ("z ", 4097)],
        [(f"s{i}", 1 + i % 3) for i in range(300)],
    ],
)
def test_manifest_by_brute_force(frame, sources):
    rows = shuffled(10, sources, 5)
    root, want = plain_manifest(rows)
    got = made(frame, rows)
    found = got.rows.collect()
    assert got.root == root and {r.root for r in found} == {root}
    assert sorted(((r.tree, r.id, r.leaf, r.subroot, r.proof, r.folded_root) for r in found), key=str) == want
    assert {r.folded_root == r.root for r in found} == {True, False}
    for r in found[:50]:  # a proof is checked with nothing but itself
        cut, siblings = 0, []
        for size in r.sizes:
            siblings.append([bytes.fromhex(r.proof[cut + 64 * i : cut + 64 * i + 64]) for i in range(size - 1)])
            cut += 64 * (size - 1)
        assert manifest.fold(bytes.fromhex(r.leaf), r.slots, siblings).hex() == root


def test_manifest_edges(frame):
    assert made(frame, []).root is None and made(frame, []).rows.collect() == []
    one = made(frame, [(None, None, h("x"), h("y"))])
    row = one.rows.first()
    assert (one.root, row.subroot, row.proof, row.slots, row.folded_root) == (h("x"), h("x"), "", [], h("y"))


def test_leaf_digests(spark):
    rows = [(1, "sé", None, 3, "a:b\n"), (None, None, None, None, None), (-5, "", "de", 0, ""), (7, "s", "en", 9, "x" * 3_000_000)]
    df = spark.createDataFrame(rows, "i long, s string, l string, n long, t string")
    got = df.select(F.lower(F.hex(manifest.leaf_digest(*map(F.col, df.columns)))).alias("h")).collect()
    assert [r.h for r in got] == [plain_leaf(*r) for r in rows]


def test_sweeps_take_labels_in_order():
    for n in (1, 2, 15, 16, 17, 100, 255, 256):
        leaves = [hashlib.sha256(bytes([i])).digest() for i in range(n)]
        height = manifest._height(n)
        top, runs = manifest.sweep_forward(leaves, height)
        want, paths = plain_tree([d.hex() for d in leaves])
        assert top.hex() == want and list(runs) == sorted(runs)
        got = list(manifest.sweep_backward(n, height, runs, ()))
        assert [i for i, _ in got] == list(range(n - 1, -1, -1))
        assert [[(s, [d.hex() for d in run]) for s, run in path] for _, path in reversed(got)] == paths


# --- vector codes --------------------------------------------------------------------------------


def plain_codes(rows, parts=16, entries=64, rounds=2):
    """rows of (vec_id, vector, label): ({vec_id: (code, error, label_error)}, digest of the codebooks)."""
    kept = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: r[0])
    w = len(kept[0][1]) // parts

    def cut(v):
        return [tuple(v[p * w : p * w + w]) for p in range(parts)]

    books = [[cut(v)[p] for _, v, _ in kept[:entries]] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        moved = [list(b) for b in books]
        for p in range(parts):
            groups = {}
            for _, v, _ in kept:
                groups.setdefault(nearest(p, cut(v)[p])[1], []).append(cut(v)[p])
            for e, own in groups.items():
                moved[p][e] = tuple(sum(c) // len(own) for c in zip(*own))
        books = moved
    out, by_label = {}, {}
    for i, v, lab in kept:
        found = [nearest(p, x) for p, x in enumerate(cut(v))]
        out[i] = ("".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), lab)
        by_label[lab] = by_label.get(lab, 0) + out[i][1]
    flat = ",".join(str(x) for b in books for c in b for x in c)
    return {i: (c, d, by_label[lab]) for i, (c, d, lab) in out.items()}, h(flat)


def coded(frame, rows, ddl="vec_id long, embedding array<double>, label int, code string, error int, top int"):
    got, books = vectorcodes.compress(frame([(*r, "x", 1, 2) for r in rows], ddl))
    assert got.columns == ["vec_id", "label", "code", "error", "label_error"]
    return {r.vec_id: (r.code, r.error, r.label_error) for r in got.collect()}, vectorcodes.books_sha256(books)


def some_vectors(n, width, scale, seed):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, scale) for _ in range(16 * width)], rng.choice([0, 0, 1, 2, None])) for i in range(n)]
    rows[3] = (3, list(rows[1][1]), 5)
    rows[n // 2] = (n // 2, [0.0] * 16 * width, None)
    return rows


@pytest.mark.parametrize("n,width,scale", [(300, 4, 0.15), (150, 1, 0.02), (40, 2, 3.0), (90, 2, 40_000.0)])
def test_codes_by_brute_force(frame, n, width, scale):
    rows = some_vectors(n, width, scale, n)
    odd = [(1000, None, 1), (1001, [None] * 16 * width, 1), (1002, [float("nan")] * 16 * width, 1), (1003, [float("inf")] + [0.0] * (16 * width - 1), 1)]
    odd += [(1004, [], 1), (1005, [1.0] * 5, 1)]
    assert coded(frame, rows + odd) == plain_codes(rows)


def test_codes_of_one_vector_and_of_none(frame):
    assert coded(frame, []) == ({}, h(""))
    assert coded(frame, [(7, [0.5] * 16, None)]) == ({7: ("00" * 16, 0, 0)}, h(",".join(["128"] * 16)))
    assert coded(frame, [(None, [0.5] * 16, 3)])[0] == {None: ("00" * 16, 0, 0)}
    with pytest.raises(Exception, match="beyond a long"):
        coded(frame, [(1, [1e9] * 16, 0), (2, [-1e9] * 16, 0)])


def test_trees_assign_exactly():
    rng = np.random.default_rng(2)
    for trial in range(30):
        n, d, e, top = int(rng.integers(1, 1500)), int(rng.integers(1, 6)), int(rng.integers(1, 64)), [2, 40, 5000, 1 << 28][trial % 4]
        p = rng.integers(-top, top, (n, d))
        p[rng.integers(0, n, n // 3)] = p[0]
        kind = vectorcodes._kind(int(abs(p).max()), d)
        tree = vectorcodes.build_tree(p.astype(kind))
        assert sorted(tree.order.tolist()) == list(range(n))
        for i, (a, b) in enumerate(zip(tree.start, tree.end)):  # balls cover their points and cache their sums
            own = p[tree.order[a:b]].astype(kind)
            assert (((own - tree.centre[i]) ** 2).sum(axis=1) <= tree.radius2[i]).all() and (own.sum(axis=0) == tree.total[i]).all()
        book = p[rng.integers(0, n, e)]
        sums, counts, code = vectorcodes.assign(tree, p[tree.order].astype(kind), book.astype(kind), codes=True)
        want = ((p[:, None, :] - book[None]) ** 2).sum(axis=2).argmin(axis=1)
        assert (code == want[tree.order]).all() and (counts == np.bincount(want, minlength=e)).all()
        assert all((sums[k] == p[want == k].sum(axis=0)).all() for k in range(e))


def test_label_errors_of_rare_and_common_labels(spark, monkeypatch):
    monkeypatch.setattr(vectorcodes, "HOT_LABELS", 4)
    rows = [(i, None if i % 9 == 0 else i % 2 if i % 3 else i, 2 * i) for i in range(200)]
    got = vectorcodes.with_label_error(spark.createDataFrame(rows, "vec_id long, label int, error long")).collect()
    want = {}
    for _, lab, err in rows:
        want[lab] = want.get(lab, 0) + err
    assert sorted((r.vec_id, r.label_error) for r in got) == [(i, want[lab]) for i, lab, _ in rows]
