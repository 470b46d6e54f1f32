import re

import pytest
from pyspark.sql import functions as F

from crossfade.llm import decontaminate as d

ITEM = "If Alice buys 12 apples and walks 3 km to Bern in the rain, how many apples does Alice carry after 3 hours of walking?"
AGAIN = "If Bob buys 7 apples and walks 9 km to Rome in the rain, how many apples does Bob carry after 9 hours of walking?"
BROKEN = "If Bob buys 7 apples and walks 9 km to Rome in the rain, how many apples does Carol carry after 8 hours of walking?"
PLAIN = "the long passage of the benchmark says that nothing in it is a name or a number but it goes on for a while"


def slow_template(text, names=True, inner=False):
    tokens, out = re.findall(r"[0-9]+(?:[.,][0-9]+)*|[^\W\d_]+|[.!?\n]", text or ""), []
    for i, t in enumerate(tokens):
        before = tokens[i - 1] if i else ("," if inner else ".")
        if t in d.ENDS:
            continue
        if t[0].isdigit():
            word = d.NUMBER
        elif before[0].isdigit() and t.lower() in d.UNITS:
            word = d.UNIT
        elif names and before not in d.ENDS and t != t.lower() and t != t.upper():
            word = d.NAME
        else:
            word = t.lower()
        out.append((word, t))
    return out


def slow(docs, items, size=8, literal=4, least=5, covered=13):
    """Contaminated (doc_id, item_id) by comparing windows of all pairs."""
    hits = set()
    for doc_id, text in docs:
        doc = slow_template(text)
        for item_id, item_text in items:
            for reading in ((True, False), (True, True), (False, False)):
                item = slow_template(item_text, *reading)
                if len(item) < least:
                    continue
                n, reached = min(size, len(item)), {}
                for i in range(len(item) - n + 1):
                    for j in range(len(doc) - n + 1):
                        words = [w for w, _ in item[i : i + n]]
                        if words == [w for w, _ in doc[j : j + n]] and sum(not w.startswith("<") for w in words) >= min(literal, n):
                            reached.setdefault(j - i, set()).update(range(i, i + n))
                total = 0
                for shift, at in reached.items():
                    slots = {(item[p][0], item[p][1].lower(), doc[p + shift][1].lower()) for p in at if item[p][0].startswith("<")}
                    total += len(at) if len(slots) == len({s[:2] for s in slots}) else 0
                if total and min(total, len(item)) >= min(len(item), covered):
                    hits.add((doc_id, item_id))
    return hits


def frames(spark, docs, items):
    return spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id bigint, text string, words int"), spark.createDataFrame(items, "item_id bigint, text string")


@pytest.mark.parametrize("text", [ITEM, AGAIN, "", "a.B c\nD e 3 M 4,5 Km X", "ÉCOLE École. École 12 Hours hours", "I am A OK Mc.Donald"])
@pytest.mark.parametrize("reading", [(True, False), (True, True), (False, False)])
def test_template(spark, text, reading):
    frame = spark.createDataFrame([(text,)], "text string").select(d.template(F.col("text"), *reading).alias("t"))
    assert [(x["word"], x["value"]) for x in frame.first()["t"]] == slow_template(text, *reading)


def test_same_questions_with_other_values(spark):
    docs = [
        (1, f"Before. {ITEM} Behind."), (2, f"Before. {AGAIN} Behind."), (3, BROKEN), (4, ITEM.lower()), (5, ITEM.upper()), (6, "intro " * 3000 + PLAIN),
        (7, " ".join(PLAIN.split()[:9])), (8, " ".join(PLAIN.split()[3:17])), (9, None), (10, ""), (11, "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16"), (12, "short item of six words"),
        (12, "something else"), (None, PLAIN), (13, PLAIN + ". " + PLAIN), (15, "they said: Short item of six words and went on"), (14, "all other words of a clean text that never was a question at all and goes on"),
    ]
    items = [(100, ITEM), (100, ITEM), (101, PLAIN), (102, None), (103, ""), (104, "too few words"), (105, "Short item of six words"), (106, "20 21 22 23 24 25 26 27 28 29 30"), (None, PLAIN)]
    found = d.contaminated(*frames(spark, docs, items)).collect()
    named = [i for i in items if i[0] is not None]
    got = [(r.doc_id, r.item_id) for r in found]
    assert set(got) == slow(docs, named) and len(got) == len(set(got))
    assert {(1, 100), (2, 100), (4, 100), (5, 100), (6, 101), (8, 101), (12, 105), (15, 105), (None, 101), (13, 101)} == set(got)
    changed = {r.doc_id: r.changed for r in found if r.item_id == 100}
    assert changed == {1: False, 2: True, 4: False, 5: False}


def test_native_and_empty(spark):
    docs, items = frames(spark, [(1, PLAIN)], [(1, PLAIN)])
    plan = d.contaminated(docs, items)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)
    assert d.contaminated(docs.limit(0), items).count() == 0
    assert d.contaminated(docs, items.limit(0)).count() == 0


def test_registered_tables(spark, sf_dir):
    docs, bench = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = {(r.doc_id, r.item_id) for r in d.contaminated(docs, bench).collect()}
    texts = [(r.doc_id, " ".join(re.findall(r"\w+", r.text.lower()))) for r in docs.collect()]
    for r in bench.collect():
        item = " ".join(re.findall(r"\w+", r.text.lower()))
        whole = {(i, r.item_id) for i, t in texts if item in t}
        assert whole <= found


SHORT = ["What is 12 plus 30?", "Compute 3 times 4 minus 5.", "Compute 12 x 7 + 3 x 9 - 4 x 5 + 6 = 1 2 3 4", "8 + 9 = ?", "20 21 22 23 24 25 26 27 28 29 30", "Anna Bert Carl Dora Emil Fritz Gerd Hans Ida"]


def test_general_windows_are_found_by_their_values(spark):
    docs = [(i, f"Question: {t} And so on.") for i, t in enumerate(SHORT)] + [(100 + i, t) for i, t in enumerate(SHORT)]
    docs += [(200, "What is 13 plus 30?"), (201, "Compute 3 times 4 minus 6."), (202, "8 + 5 = ?"), (203, "20 21 22 23 24 25 26 27 28 29 31"[3:])]
    found = {(r.doc_id, r.item_id, r.changed) for r in d.contaminated(*frames(spark, docs, list(enumerate(SHORT)))).collect()}
    assert found == {(i + at, i, False) for i in range(len(SHORT)) for at in (0, 100)}


TWO = ["Alice has 5 apples and gives 2 to Bob. How many are left?", "Alice buys 12 apples at the market. Bob takes 3 of them. How many apples does Alice have now?"]


def test_names_that_start_sentences(spark):
    docs = [
        (0, "Mary has 7 apples and gives 4 to Tom. How many are left?"), (1, "So: Mary buys 9 apples at the market. Tom takes 4 of them. How many apples does Mary have now?"),
        (2, "Mary buys 9 apples at the market. Tom takes 4 of them. how many apples does Carol have now?"), (3, TWO[1]), (4, "Mary buys 9 apples at the market. Tom takes 4 of them. how many apples does Mary have now?"),
    ]
    found = {(r.doc_id, r.item_id, r.words) for r in d.contaminated(*frames(spark, docs, list(enumerate(TWO)))).collect()}
    assert found == {(0, 0, 13), (1, 1, 19), (3, 1, 19), (4, 1, 19)}


def test_lists_with_a_capital_on_every_line_and_scripts_without_blanks(spark):
    lines = "\n".join(f"Word{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}" for i in range(100_000))
    han = "\u4eca\u65e5\u306f\u3044\u3044\u5929\u6c17\u3067\u3059\u306d\u3068\u5f7c\u306f\u8a00\u3063\u305f"
    docs = [(1, lines + "\n" + ITEM), (2, "\u524d" * 40 + han + "\u5f8c" * 40), (3, "\u524d" * 90)]
    found = {(r.doc_id, r.item_id) for r in d.contaminated(*frames(spark, docs, [(7, ITEM), (8, han)])).collect()}
    assert found == {(1, 7), (2, 8)}


@pytest.mark.parametrize("n", [1, 2, 3, 5, 6, 7, 8, 9])
def test_rolled_hashes_are_those_of_windows(spark, n):
    frame = spark.createDataFrame([([*range(20)],)], "w array<bigint>")
    rolled = frame.select(d._rolled(F.col("w"), n).alias("r")).first()["r"]
    each = frame.select(*(d._hashed(lambda k: F.get("w", F.lit(k + i)), n).alias(str(i)) for i in range(21 - n))).first()
    if n > 1:
        assert rolled[: 21 - n] == list(each) and len(set(each)) == 21 - n
    else:
        assert rolled == list(range(20))


def test_hashes_agree_with_the_template(spark):
    text = "If Anna buys 12 kg of Rice. Then BOB pays 3,50 Euro at Noon! \u00c9cole d'\u00c9t\u00e9 3 Hours\nnew line"
    frame = spark.createDataFrame([(text,)], "text string")
    words, codes = frame.select(d.template(F.col("text")).alias("t"), d.coded(F.col("text")).alias("c")).first()
    kinds = {d.NUMBER: d._NUM, d.UNIT: d._UNIT, d.NAME: d._NAME}
    assert len(words) == len(codes)
    for w, c in zip(words, codes):
        assert c["kind"] == kinds.get(w["word"], c["kind"]) and (w["word"] in kinds or c["kind"] in (d._PLAIN, d._START))
    assert [w["value"] for w, c in zip(words, codes) if c["kind"] == d._START] == ["If", "Then", "\u00c9cole"]


def test_other_ways_to_join(spark, monkeypatch):
    docs = [(1, ITEM), (2, AGAIN), (3, PLAIN), (4, "nothing")]
    wide = {tuple(r) for r in d.contaminated(*frames(spark, docs, [(5, ITEM), (6, PLAIN)])).collect()}
    monkeypatch.setattr(d, "MOST_MARKS", 0)
    monkeypatch.setattr(d, "MOST_HITS", 0)
    assert {tuple(r) for r in d.contaminated(*frames(spark, docs, [(5, ITEM), (6, PLAIN)])).collect()} == wide and len(wide) == 3
