from itertools import combinations

import numpy as np
import pytest

from crossfade.llm import langid


@pytest.mark.parametrize("n", [0, 1, 2, 4, 5, 6, 12])
def test_codewords_differ(n):
    code = langid.codewords(n)
    assert len(code) == n
    for a, b in combinations(range(n), 2):
        assert (code[a] != code[b]).sum() >= max(1, 2 ** (n - 2) if n <= 5 else 5)


def test_grams_of_a_cut_text_are_those_of_the_whole(monkeypatch):
    text = "Ünd ab, c'est l’été… 漢字 x1y  z. " * 40
    whole = np.sort(langid._grams(langid._fold(text.encode())))
    cut = np.sort(np.concatenate([langid._grams(langid._fold(p)) for p in langid.pieces(text.encode(), 50)]))
    assert (whole == cut).all()


def test_held_out_accuracy_and_odd_texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = langid.fit(docs.filter("crc32(cast(doc_id as string)) % 3 != 1"))
    found = langid.identify(docs.filter("crc32(cast(doc_id as string)) % 3 = 1"), model).collect()
    assert np.mean([r.lang == r.lang_pred for r in found]) >= 0.98
    assert all(0 <= r.score <= 1 for r in found)
    odd = [(1, None, 5), (2, "", 5), (3, "12 34 !?", 5), (4, "the " * 50000, 5), (4, "the " * 50000, 5), (None, "avec les", 5)]
    odd = spark.createDataFrame(odd, "doc_id bigint, text string, score int")
    found = langid.identify(odd, model).collect()
    assert [(r.lang_pred, r.score) for r in found[:3]] == [("und", 0.0)] * 3
    assert [r.lang_pred for r in found[3:5]] == ["en", "en"] and len(found) == 6


def test_models_of_no_and_one_language(spark):
    rows = spark.createDataFrame([(1, "abc", None), (2, None, "en")], "doc_id bigint, text string, lang string")
    found = langid.identify(rows, langid.fit(rows)).collect()
    assert [(r.lang_pred, r.score) for r in found] == [("und", 0.0)] * 2
    rows = spark.createDataFrame([(1, "abc", "xx"), (1, "abc", "xx"), (2, None, "yy")], "doc_id bigint, text string, lang string")
    found = langid.identify(rows, langid.fit(rows)).collect()
    assert [(r.lang_pred, r.score) for r in found] == [("xx", 1.0)] * 2 + [("und", 0.0)]
    assert langid.identify(rows.limit(0), langid.fit(rows.limit(0))).count() == 0


def test_sample_is_bounded_and_repeatable(spark):
    rows = spark.range(4000).selectExpr("id AS doc_id", "concat('text ', id) AS text", "if(id % 2 = 0, 'aa', 'bb') AS lang")
    a, b = langid.fit(rows, per_language=50), langid.fit(rows.repartition(7), per_language=50)
    assert (a.weights == b.weights).all()


def test_weights_and_decoding_against_plain_loops(spark):
    known = [("aa", "the cat and the hat"), ("aa", "that was then"), ("bb", "der hund und die maus"), ("bb", "das war dann"), ("cc", "le chien et la souris"), ("cc", "les chats")]
    asked = ["the hund et la", "cat", "die souris", "was dann le", "zzz", "und"]
    rows = [(i, text, lang) for i, (lang, text) in enumerate(known)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    grams = lambda t: langid._grams(langid._fold(t.encode())).tolist()
    languages = sorted({lang for lang, _ in known})
    assert model.languages == languages
    counts = {lang: {} for lang in languages}
    for lang, text in known:
        for g in grams(text):
            counts[lang][g] = counts[lang].get(g, 0) + 1
    total = {lang: sum(c.values()) + 0.5 * langid.BUCKETS for lang, c in counts.items()}
    chance = lambda lang, g: (counts[lang].get(g, 0) + 0.5) / total[lang]
    mean = lambda values: sum(values) / len(values)
    found = langid.identify(spark.createDataFrame([(t,) for t in asked], "text string"), model).collect()
    for row in found:
        own = grams(row["text"])
        losses = []
        for word in model.code.tolist():
            loss = 0.0
            for bit in range(len(word)):
                sides = [[lang for lang, w in zip(languages, model.code[:, bit]) if w == s] for s in (1, -1)]
                odds = mean([np.log(mean([chance(lang, g) for lang in sides[0]]) / mean([chance(lang, g) for lang in sides[1]])) for g in own])
                loss += np.logaddexp(0, -4 * odds / model.scale[bit] * word[bit]) * model.scale[bit] / sum(model.scale)
            losses.append(loss * min(len(own) ** 0.5, 30))
        share = [np.exp(min(losses) - x) for x in losses]
        share = [s / sum(share) for s in share]
        best = max(range(len(share)), key=lambda i: share[i])
        first, second = sorted(share)[-1], sorted(share)[-2]
        assert row["score"] == pytest.approx(first, abs=1e-4)
        if first - second > 1e-3:
            assert row["lang_pred"] == languages[best]
        if abs(first - second - 0.1) > 1e-3:
            assert row["ambiguous"] == (first - second < 0.1)
