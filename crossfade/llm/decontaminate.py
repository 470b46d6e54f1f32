"""Benchmark decontamination by canonical templates, in SQL functions only.

Numbers, names and units are replaced with typed placeholders, so that a
question asked again with other values has the same template. Windows of
template words are joined by hash with those of the benchmark; the meetings of
a document with an item are gathered by alignment, compared word for word, and
checked for consistent slots: where an item repeats a value, the document has
to repeat its own. A document is contaminated by an item if enough of the
item's words are covered.

A document's window has one hash, in which every capitalised word is a name. A
word that starts a sentence may be a plain word as well; which it is shows when
words are compared, and the few windows of the benchmark are indexed with such
words either way. Windows too general for their template to tell anything are
joined by their values instead.

Hashes of windows are put together from those of their halves, so a word costs
a few hashes whatever the size of windows. Documents are probed against the
distinct hashes of the benchmark; whatever else is needed is read for those
that meet one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossfade.sources.staging import stage

#: Scripts without blanks between words: each letter is a word.
_UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
#: Letters that need no look at their script, which costs more than all else.
_LATIN = r"A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
#: A number, a word, or what ends a sentence.
TOKEN = (
    rf"[0-9]+(?:[.,][0-9]+)*|[{_LATIN}[\p{{L}}&&[^{_UNSPACED}]]][{_LATIN}[\p{{L}}\p{{M}}&&[^{_UNSPACED}]]]*"
    rf"|[\p{{L}}&&[{_UNSPACED}]]|[.!?\n]"
)
ENDS = (".", "!", "?", "\n")
NUMBER, NAME, UNIT = "<num>", "<name>", "<unit>"
#: Words that are units behind a number.
UNITS = (
    "mm", "cm", "m", "km", "inch", "inches", "foot", "feet", "yard", "yards", "mile", "miles",
    "mg", "g", "kg", "gram", "grams", "ton", "tons", "pound", "pounds", "ml", "l", "litre", "litres", "liter", "liters",
    "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years",
    "percent", "dollar", "dollars", "euro", "euros", "cent", "cents", "degree", "degrees",
)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def _word(t: Column, before: Column, names: bool, inner: bool) -> Column:
    """The template word of token ``t``; NULL for what ends a sentence."""
    low = F.lower(t)
    digit = F.substring(t, 1, 1).between("0", "9")
    behind_number = F.substring(F.coalesce(before, F.lit("")), 1, 1).between("0", "9")
    word = F.when(t.isin(*ENDS), F.lit(None)).when(digit, F.lit(NUMBER)).when(behind_number & low.isin(*UNITS), F.lit(UNIT))
    if names:
        inside = ~F.coalesce(before, F.lit("" if inner else ".")).isin(*ENDS)
        word = word.when((t != low) & inside & (t != F.upper(t)), F.lit(NAME))
    return word.otherwise(low)


def template(text: Column, names: bool = True, inner: bool = False) -> Column:
    """Array of ``(word, value)``: template words of a text with what stood there.

    ``inner`` reads the text as what follows within a sentence.
    """
    tokens = F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(TOKEN), F.lit(0))
    typed = lambda r: F.transform(r, lambda t, i: F.struct(_word(t, F.get(r, i - 1), names, inner).alias("word"), t.alias("value")))
    return F.filter(_let(tokens, typed), lambda x: x["word"].isNotNull())


def _is_slot(word: Column) -> Column:
    return word.isin(NUMBER, NAME, UNIT)


def _may_name(x: Column) -> Column:
    """Whether a plain template word is capitalised, which it can be as a name that starts a sentence."""
    return (x["word"] == F.lower(x["value"])) & (x["value"] != F.lower(x["value"])) & (x["value"] != F.upper(x["value"]))


#: Kinds of a document's words: plain, number, unit, name, and a capitalised word that starts a sentence.
_PLAIN, _NUM, _UNIT, _NAME, _START = range(5)
_END_CODES = [ord(e) for e in ENDS]
#: Hashes of the benchmark that are broadcast; more are joined as the planner likes.
MOST_MARKS = 1 << 21
#: Texts whose hashes are broadcast to find them again; more are joined as the planner likes.
MOST_HITS = 1 << 20


def coded(text: Column) -> Column:
    """Array of ``(kind, value)``: the words of a text as small numbers and hashes of their lower case.

    The same words as :func:`template` gives, which stays the definition; this
    form is what every word of every document can pay for.
    """

    def code(r: Column, t: Column, i: Column) -> Column:
        first, before = F.ascii(t), F.ascii(F.coalesce(F.get(r, i - 1), F.lit(".")))
        digit = lambda c: (c >= ord("0")) & (c <= ord("9"))
        low = F.lower(t)
        cased = F.when((t == low) | (t == F.upper(t)), _PLAIN).when(before.isin(*_END_CODES), _START).otherwise(_NAME)
        kind = F.when(first.isin(*_END_CODES), F.lit(None)).when(digit(first), _NUM).when(digit(before) & low.isin(*UNITS), _UNIT).otherwise(cased)
        return F.struct(kind.alias("kind"), F.xxhash64(low).alias("value"))

    tokens = F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(TOKEN), F.lit(0))
    return F.filter(_let(tokens, lambda r: F.transform(r, lambda t, i: code(r, t, i))), lambda x: x["kind"].isNotNull())


def _halves(n: int) -> int:
    """The greatest power of two within ``n``."""
    return 1 << (n.bit_length() - 1)


def _joined(left: Column, right: Column, by: int) -> Column:
    """Hashes of each element of ``left`` with that of ``right`` which stands ``by`` places on."""
    shifted = lambda h: F.slice(h, by + 1, F.greatest(F.size(h), F.lit(1)))
    return F.zip_with(left, _let(right, shifted), lambda a, b: F.xxhash64(a, b))


def _rolled(words: Column, n: int) -> Column:
    """Hashes of the ``n`` words from each place on; those at the last places mean nothing."""
    m, ahead = 1, words
    while m < _halves(n):
        ahead = _let(ahead, _doubled(m))
        m *= 2
    return ahead if m == n else _joined(ahead, _rolled(words, n - m), m)


def _doubled(m: int):
    return lambda h: _joined(h, h, m)


def _hashed(word, n: int, at: int = 0) -> Column:
    """The hash of ``n`` words, ``word(k)`` the one at ``k``; as :func:`_rolled` puts it together."""
    if n == 1:
        return word(at)
    m = _halves(n) // 2 if n == _halves(n) else _halves(n)
    return F.xxhash64(_hashed(word, m, at), _hashed(word, n - m, at + m))


def _by_values(value: Column, i: Column, n: int) -> Column:
    """The hash of the values of the ``n`` words from ``i`` on."""
    return F.xxhash64(F.lit("values"), _hashed(lambda k: F.get(value, i + k), n))


def _slot_hashes() -> list[Column]:
    return [F.xxhash64(F.lit(w)) for w in (NUMBER, UNIT, NAME)]


def _starts(places: Column, needed: int, size: int, last: Column) -> Column:
    """Starts of the windows that hold ``needed`` or more of the places (from 0, in order)."""
    close = F.filter(F.transform(places, lambda p, j: F.struct(p.alias("p"), F.get(places, j + (needed - 1)).alias("q"))), lambda x: x["q"] - x["p"] < size)
    return F.array_distinct(F.flatten(F.transform(close, lambda x: F.sequence(F.greatest(F.lit(0), x["q"] - (size - 1)), F.least(x["p"], last - 1)))))


def probes(words: Column, sizes: list[int], least_literal: int, least_words: int) -> Column:
    """Array of ``(at, mark)``: the hashes that a document's windows are met by.

    Every window of each size has that of its words with capitalised ones as
    names. One with two words that start sentences has that of its plain reading as
    well, and one with fewer than ``least_literal`` plain words, or shorter than
    ``least_words``, that of its values.
    """
    number, unit, name = _slot_hashes()
    mark = lambda i, m: F.struct(i.cast("int").alias("at"), m.alias("mark"))
    placed = lambda test: F.filter(F.transform(words, lambda x, i: F.when(test(x["kind"]), i)), lambda i: i.isNotNull())
    reading = lambda plain: F.transform(words, lambda x: F.when(x["kind"].isin(*plain), x["value"]).when(x["kind"] == _NUM, number).when(x["kind"] == _UNIT, unit).otherwise(name))
    parts = F.struct(reading([_PLAIN]).alias("loose"), reading([_PLAIN, _START]).alias("plain"), words["value"].alias("value"), placed(lambda k: k == _START).alias("starts"), placed(lambda k: k > 0).alias("bare"))

    def every(p: Column, n: int) -> Column:
        last = F.size(p["loose"]) - (n - 1)
        found = [F.transform(F.slice(_rolled(p["loose"], n), F.lit(1), last), lambda m, i: mark(i, m))]
        found.append(F.transform(_starts(p["starts"], 2, n, last), lambda i: mark(i, _hashed(lambda k: F.get(p["plain"], i + k), n))))
        general = _starts(p["bare"], n - min(least_literal, n) + 1, n, last) if n >= least_words else F.sequence(F.lit(0), last - 1)
        found.append(F.transform(general, lambda i: mark(i, _by_values(p["value"], i, n))))
        return F.when(last > 0, F.concat(*found)).otherwise(F.array().cast("array<struct<at:int,mark:bigint>>"))

    return _let(parts, lambda p: F.concat(*(every(p, n) for n in sizes)))


def indexed(items: DataFrame, n: int, least_literal: int, least_words: int) -> DataFrame:
    """``(item_id, form, item_at, n, mark)``: the hashes that the windows of items of this size are met by.

    A window with ``least_literal`` plain words is indexed as it reads and with
    the words that start sentences as names, each with one more word the other
    way: a plain one as a name, as a document may start a sentence with it. Other
    windows are indexed by their values.
    """
    number, unit, name = _slot_hashes()
    slot = lambda x: F.when(x["word"] == NUMBER, number).when(x["word"] == UNIT, unit).when(x["word"] == NAME, name)
    own = F.transform(
        "words",
        lambda x: F.struct(
            slot(x).alias("slot"), F.xxhash64(x["word"]).alias("plain"), F.xxhash64(F.lower(x["value"])).alias("value"), (_may_name(x) & (F.col("form") < 2)).alias("start"),
        ),
    )
    at = F.explode(F.sequence(F.lit(0), F.size("words") - n))
    windows = items.select("item_id", "form", own.alias("own"), at.alias("item_at")).withColumn("own", F.slice("own", F.col("item_at") + 1, n))
    keys = ["item_id", "form", "item_at"]
    literal = F.size(F.filter("own", lambda x: x["slot"].isNull()))
    general = literal < min(least_literal, n) if n >= least_words else F.lit(True)
    values = windows.filter(general).select(*keys, F.transform("own", lambda x: x["value"]).alias("w")).select(*keys, _by_values(F.col("w"), F.lit(0), n).alias("mark"))

    def turned(x: Column, k: Column) -> Column:
        as_name = F.col("named") & x["start"]
        other = k == F.col("other")
        return F.coalesce(x["slot"], F.when(as_name != other, name).otherwise(x["plain"]))

    either = windows.filter(~general).withColumn("named", F.explode(F.array(F.lit(False), F.lit(True))))
    told = F.size(F.filter("own", lambda x: x["slot"].isNull() & ~x["start"]))
    either = either.filter(~F.col("named") | (told >= min(least_literal, n))).withColumn("other", F.explode(F.sequence(F.lit(-1), F.lit(n - 1))))
    either = either.select(*keys, F.transform("own", turned).alias("w")).select(*keys, _hashed(lambda k: F.get(F.col("w"), F.lit(k)), n).alias("mark"))
    return either.unionByName(values).distinct().withColumn("n", F.lit(n))


def bounded(keys: DataFrame, most: int) -> DataFrame:
    """A narrow stage table, marked for broadcast if it has ``most`` rows or fewer."""
    return F.broadcast(keys) if keys.count() <= most else keys


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(item_id, form, words)``: the templates of each item; equal ones once."""
    items = benchmark.select(F.col(id_col).cast("bigint").alias("item_id"), F.col(text_col).alias("text"))
    readings = ((True, False), (True, True), (False, False))
    forms = F.array(*(F.struct(F.lit(i).alias("form"), template(F.col("text"), *reading).alias("words")) for i, reading in enumerate(readings)))
    first = items.select("item_id", F.inline(forms)).groupBy("item_id", F.transform("words", lambda x: x["word"]).alias("t"))
    return first.agg(F.min("form").alias("form"), F.min_by("words", "form").alias("words")).select("item_id", "form", "words")


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    size: int = 8,
    least_literal: int = 4,
    least_words: int = 5,
    covered: int = 13,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """``(doc_id, item_id, words, item_words, changed)``: one row per contaminated document and item.

    ``words`` are the item's words covered by windows of ``size`` in consistent
    alignments (an item of fewer words is one window), at least ``covered`` or
    all of the item's; ``changed`` says that values differ. Windows with fewer
    than ``least_literal`` plain words, and items of fewer than ``least_words``
    words, are too general for other values and are found with their own. A
    capitalised word that starts a sentence is a name where that fits and a
    plain word where it doesn't; of four or more such words in a window of an
    item, all but one have to read alike. In scripts without blanks every letter
    is a word. Whole texts count.
    NULL and empty texts contain nothing and NULL items aren't searched for;
    rows with a NULL doc_id are searched and named NULL; rows that repeat
    an id count as one document. Empty tables give no rows.
    """
    items = _items(benchmark, item_id_col, item_text_col)
    items = items.filter((F.size("words") > 0) & F.col("item_id").isNotNull())
    items = stage(items.withColumn("size", F.least(F.size("words"), F.lit(size))), "bench-items")
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if not sizes:
        empty = "doc_id bigint, item_id bigint, words int, item_words int, changed boolean"
        return docs.sparkSession.createDataFrame([], empty)

    index = None
    for n in sizes:
        rows = indexed(items.filter(F.col("size") == n), n, least_literal, least_words)
        index = rows if index is None else index.unionByName(rows)
    index = stage(index, "bench-windows")
    marks = bounded(stage(index.select("mark").distinct(), "bench-marks"), MOST_MARKS)

    keyed = texts.select("doc_id", F.xxhash64("text").alias("key"), coded(F.col("text")).alias("words"))
    probed = keyed.select("doc_id", "key", F.inline(probes(F.col("words"), sizes, least_literal, least_words)))
    met = stage(probed.join(marks, "mark", "left_semi"), "bench-met")
    found = met.join(index, "mark").withColumn("shift", F.col("at") - F.col("item_at"))
    # at most one row per window of the item in each alignment
    aligned = found.groupBy("doc_id", "key", "item_id", "form", "n", "shift").agg(F.array_sort(F.collect_set("item_at")).alias("windows"))
    aligned = stage(aligned, "bench-aligned")

    hit = bounded(stage(aligned.select(F.col("doc_id").alias("d"), F.col("key").alias("k")).distinct(), "bench-hits"), MOST_HITS)
    again = texts.join(hit, F.col("doc_id").eqNullSafe(F.col("d")) & (F.xxhash64("text") == F.col("k")), "left_semi").distinct()
    again = again.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("k"), template(F.col("text")).alias("doc_words"))
    both = aligned.join(again, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k"))).drop("d", "k")
    own = items.select(F.col("item_id").alias("i"), F.col("form").alias("f"), F.col("words").alias("item_words"))
    both = both.join(own, (F.col("item_id") == F.col("i")) & (F.col("form") == F.col("f")))

    may = lambda x: _may_name(x) | (x["word"] == NAME)
    alike = lambda x: x["of_item"]["word"] == x["of_doc"]["word"]
    equal = lambda x: F.lower(x["of_item"]["value"]) == F.lower(x["of_doc"]["value"])
    pair = lambda p: F.struct(F.get("item_words", p).alias("of_item"), F.get("doc_words", p + F.col("shift")).alias("of_doc"))

    def compared(s: Column) -> Column:
        """Whether a window's words agree, whether they do as they read, and whether they tell enough."""
        pairs = F.transform(F.sequence(s, s + F.col("n") - 1), pair)
        same = F.forall(pairs, lambda x: F.coalesce(alike(x) | equal(x) | ((F.col("form") < 2) & may(x["of_item"]) & may(x["of_doc"])), F.lit(False)))
        plain = F.size(F.filter(pairs, lambda x: F.coalesce((alike(x) | equal(x)) & ~_is_slot(x["of_item"]["word"]), F.lit(False))))
        telling = ((F.col("n") >= least_words) & (plain >= F.least(F.lit(least_literal), F.col("n")))) | F.forall(pairs, lambda x: F.coalesce(equal(x), F.lit(False)))
        return F.struct(s.alias("at"), (same & telling).alias("same"), F.forall(pairs, lambda x: F.coalesce(alike(x), F.lit(False))).alias("as_read"))

    both = both.withColumn("windows", F.filter(F.transform("windows", compared), lambda w: w["same"]))
    # windows met by other readings never take those of the first reading away
    first = F.transform(F.filter("windows", lambda w: w["as_read"]), lambda w: w["at"])
    every = F.transform("windows", lambda w: w["at"])
    both = both.withColumn("starts", F.explode(F.array_distinct(F.filter(F.array(first, every), lambda x: F.size(x) > 0))))
    reached = F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s, s + F.col("n") - 1))))
    both = both.withColumn("reached", reached).withColumn("pairs", F.transform("reached", pair))
    # as a plain word where both are the same one, as a name where only that fits
    kind = lambda x: F.when(alike(x) | equal(x), x["of_item"]["word"]).otherwise(F.lit(NAME))
    values = F.array_distinct(
        F.transform(
            F.filter("pairs", lambda x: _is_slot(kind(x))),
            lambda x: F.struct(kind(x).alias("type"), F.lower(x["of_item"]["value"]).alias("was"), F.lower(x["of_doc"]["value"]).alias("now")),
        )
    )
    both = both.withColumn("slots", values)
    consistent = F.size("slots") == F.size(F.array_distinct(F.transform("slots", lambda x: F.struct(x["type"], x["was"]))))
    # of one alignment's readings, the consistent one that covers most
    both = both.filter(consistent).groupBy("doc_id", "key", "item_id", "form", "n", "shift").agg(F.max_by(F.struct("reached", "slots", "item_words"), F.size("reached")).alias("b"))
    both = both.select("doc_id", "item_id", "form", "b.*")
    per_item = both.groupBy("doc_id", "item_id", "form", F.size("item_words").alias("item_words")).agg(
        F.sum(F.size("reached")).cast("int").alias("all_words"),
        F.max(F.exists("slots", lambda x: x["was"] != x["now"])).alias("changed"),
    )
    per_item = per_item.withColumn("words", F.least("all_words", "item_words"))
    enough = per_item.filter(F.col("words") >= F.least(F.col("item_words"), F.lit(covered)))
    best = enough.groupBy("doc_id", "item_id").agg(F.max(F.struct("words", "item_words", "changed")).alias("b"))
    return best.select("doc_id", "item_id", "b.words", "b.item_words", "b.changed")
