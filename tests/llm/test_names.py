"""Input columns named like results and inner columns, and names with dots."""

import pytest
from pyspark.sql import functions as F

from tunekit.llm import langid, linedup, unigram, unitdedup, wordpiece
from tunekit.llm.vocabulary import read_pieces

NAMES = "removed_runs __lines __doc removed_spans __starts __ends tokens ids decoded lang_pred score __language a.b IDS Removed_Runs first end run new rank pos".split()
TEXT = "one two three four five six\nseven eight nine ten\neleven twelve thirteen\nfourteen"


def language(docs):
    return langid.identify(docs, langid.train(docs.select("text", F.lit("x").alias("lang"))))


OPERATORS = {
    "lines": (linedup.without_repeated_lines, ["removed_runs"]),
    "units": (unitdedup.without_repeated_units, ["removed_spans"]),
    "words": (lambda docs: wordpiece.count_tokens(docs, read_pieces()), ["tokens"]),
    "pieces": (lambda docs: unigram.encode(docs, unigram.build(read_pieces())), ["ids", "decoded"]),
    "language": (language, ["lang_pred", "score"]),
}


@pytest.mark.parametrize("operator", sorted(OPERATORS))
def test_names(frame, operator):
    run, given = OPERATORS[operator]
    names = [n for n in NAMES if n.islower() or n.startswith("__")] if operator != "pieces" else [n for n in NAMES if n not in ("ids", "removed_runs")]
    names = list({n.lower(): n for n in names}.values())
    rows = [(1, TEXT, *(f"{n}-1" for n in names)), (2, TEXT, *(f"{n}-2" for n in names))]
    docs = frame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    got = {r.doc_id: r for r in run(docs).collect()}
    plain = {r.doc_id: r for r in run(docs.select("doc_id", "text")).collect()}
    assert set(got) == {1, 2}
    for i, row in got.items():
        assert list(row.__fields__).count(given[0]) == 1
        for n in names:
            if n.lower() not in given:
                assert row[n] == f"{n}-{i}"
        for n in given:
            assert row[n] == plain[i][n]
        assert row.text == plain[i].text
