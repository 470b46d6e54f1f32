from datetime import date

from crossfade.llm import urlfilter

D = date


def evaluate(spark, captures, entries):
    c = spark.createDataFrame([(i, u, t, "clash") for i, (u, t) in enumerate(captures)], "n int, url string, fetched date, scope string")
    e = spark.createDataFrame(entries, "scope string, pattern string, action string, effective date")
    found = urlfilter.evaluate(c, e)
    assert found.columns == ["n", "url", "fetched", "blocked", "scope", "pattern"]
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    return {r.n: (r.blocked, r.scope, r.pattern) for r in found.collect()}


def test_intervals_and_precedence(spark):
    entries = [
        ("domain", "b.com", "block", D(2024, 1, 10)),
        ("domain", "b.com", "clear", D(2024, 3, 1)),
        ("host", "ok.b.com", "allow", D(2024, 1, 1)),
        ("prefix", "ok.b.com/bad/x", "block", D(2024, 2, 1)),
        ("prefix", "ok.b.com/bad/x", "block", D(2024, 2, 1)),
        ("prefix", "ok.b.com/bad/x", "clear", D(2024, 2, 1)),
        ("host", None, "block", D(2024, 1, 1)),
        ("host", "c.com", "shout", D(2024, 1, 1)),
        ("host", "late.com", "block", D(2030, 1, 1)),
    ]
    captures = [
        ("http://b.com", D(2024, 1, 9)), ("http://b.com", D(2024, 1, 10)), ("https://User@A.B.com:80/x?q", D(2024, 2, 29)), ("http://a.b.com/", D(2024, 3, 1)),
        ("http://ok.b.com/bad/y", D(2024, 2, 2)), ("http://ok.b.com//bad/x/z.html#f", D(2024, 2, 2)), ("http://ok.b.com/bad/xy", D(2024, 2, 2)), ("http://ab.com/", D(2024, 2, 2)),
        (None, D(2024, 2, 2)), ("http://b.com", None), ("nonsense", D(2024, 2, 2)), ("", D(2024, 2, 2)), ("http://b.com", D(2024, 1, 10)),
    ]
    by_domain, none = (True, "domain", "b.com"), (False, None, None)
    prefix, allowed = (True, "prefix", "ok.b.com/bad/x"), (False, "host", "ok.b.com")
    assert evaluate(spark, captures, entries) == dict(enumerate([none, by_domain, by_domain, none, allowed, prefix, allowed, none, none, none, none, none, by_domain]))


def test_many_periods_and_a_hot_host(spark):
    entries = [("host", "h.com", ("block", "clear")[i % 2], date.fromordinal(D(2020, 1, 1).toordinal() + 10 * i)) for i in range(200)]
    captures = [("http://h.com/" + str(i % 3), date.fromordinal(D(2019, 12, 25).toordinal() + i * 2)) for i in range(1000)]
    found = evaluate(spark, captures, entries)
    for i, (_, day) in enumerate(captures):
        past = [a for _, _, a, since in entries if since <= day]
        assert found[i][0] == bool(past and past[-1] == "block")


def test_first_and_last_dates_of_the_calendar(spark):
    entries = [("host", f"h{i}.com", "block", D(1, 1, 1) if i % 2 else D(2024, 1, 1)) for i in range(3000)] + [("host", "h1.com", "clear", D(2024, 6, 1)), ("host", "h2.com", "allow", D(9999, 12, 31))]
    captures = [(f"http://h{i}.com", day) for day in (D(1, 1, 1), D(2024, 5, 31), D(2024, 6, 1), D(9999, 12, 30), D(9999, 12, 31)) for i in (1, 2, 3)]
    found = evaluate(spark, captures, entries)
    assert [found[i][0] for i in range(15)] == [True, False, True, True, True, True, False, True, True, False, True, True, False, False, True]


def test_empty_tables(spark):
    assert evaluate(spark, [], []) == {}
    assert evaluate(spark, [("http://a.com", D(2024, 1, 1))], []) == {0: (False, None, None)}
    assert evaluate(spark, [("http://a.com", None)], [("host", "a.com", "block", D(2024, 1, 1))]) == {0: (False, None, None)}
