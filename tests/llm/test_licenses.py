from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from crossfade.llm import licenses

SMALL = {"A": ("released under the a license", "the quick brown fox jumps over the lazy dog again"), "B": ("released under the b license",)}


def brute(text, templates, least):
    """Every run of units against every template, without bounds or anchors."""
    spans, found = list(licenses.units(text)), []
    for i in range(len(spans)):
        for j in range(i, len(spans)):
            words = [w for a, b in spans[i : j + 1] for w in licenses.words(text[a:b])]
            if not licenses.words(text[slice(*spans[i])]) or not licenses.words(text[slice(*spans[j])]):
                continue
            run = Counter(zip(words, words[1:]))
            for name, forms in templates.items():
                for form in forms:
                    w = licenses.words(form)
                    own = Counter(zip(w, w[1:]))
                    dice = 2 * (run & own).total() / (run.total() + own.total())
                    if dice >= least:
                        found.append((name, (dice, spans[i][0], spans[j][1])))
    return licenses.settle(found)


def test_similar_licences_do_not_share_a_passage():
    found = [("A", (0.9, 0, 10)), ("B", (1.0, 0, 8)), ("A", (0.85, 20, 30)), ("B", (0.95, 40, 50))]
    assert licenses.settle(found) == {"B": (1.0, 0, 8), "A": (0.85, 20, 30)}


word = st.sampled_from("released under the a b license quick brown fox jumps over lazy dog again x y".split())
text = st.lists(st.tuples(word, st.sampled_from([" ", " ", " ", "\n", ". ", "-", "\n\n"])), max_size=40).map(lambda p: "".join(a + b for a, b in p))


@settings(max_examples=150, deadline=None)
@given(text, st.sampled_from([0.5, 0.8, 1.0]))
def test_same_as_brute_force(text, least):
    assert licenses.Scanner(SMALL, least).scan(text) == brute(text, SMALL, least)


@pytest.mark.parametrize("name", list(licenses.TEMPLATES))
def test_own_templates_are_found_and_not_mixed_up(name):
    scanner = licenses.Scanner(licenses.TEMPLATES, 0.8)
    for form in licenses.TEMPLATES[name]:
        found = scanner.scan(f"Some words before.\n{form.upper()}\nand behind.")
        assert list(found) == [name] and found[name][0] == 1.0


def test_scan(spark):
    mit = "Released under the MIT License."
    rows = [(1, f"x\n{mit}\ny"), (1, f"x\n{mit}\ny"), (None, mit), (2, None), (3, ""), (4, "clean text"), (5, "word " * 200_000 + "\n" + mit)]
    frame = spark.createDataFrame([(*r, "c") for r in rows], "doc_id bigint, text string, license string")
    found = sorted((r.doc_id or 0, r.license, r.dice, r.start, r.passage) for r in licenses.scan(frame).collect())
    assert found == [(0, "MIT", 1.0, 0, mit), (1, "MIT", 1.0, 2, mit), (1, "MIT", 1.0, 2, mit), (5, "MIT", 1.0, 1_000_001, mit)]
    assert licenses.scan(frame.limit(0)).count() == 0
    with pytest.raises(ValueError):
        licenses.scan(frame, {"one": ("word",)})


@pytest.mark.parametrize("text, name", [("It is released under the MIT License.", "MIT"), ("x\nthe BSD 2-Clause License.\ny", "BSD-2-Clause")])
def test_a_coefficient_of_just_the_least_counts(text, name):
    assert licenses.Scanner(licenses.TEMPLATES, 0.8).scan(text)[name][0] == 0.8


def test_anchors_are_rare_whole_words():
    for texts in licenses.TEMPLATES.values():
        for t in texts:
            found = licenses.anchors(licenses.words(t), 0.8)
            assert "by" not in found and "under" not in found and "the" not in found
    scanner = licenses.Scanner(licenses.TEMPLATES, 0.8)
    assert not scanner._holds_anchor("accepted according to unlicensed occasions") and not scanner._holds_anchor("")
    assert scanner._holds_anchor("cc") and scanner._holds_anchor("x (cc) y") and scanner._holds_anchor("accept cc_by")
