import hashlib
import re
import zlib
from functools import lru_cache

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from crossfade.llm import queries, structure

FOLLOWS = {"": "su", "s": "u", "u": "a", "a": "u"}


def plain(symbols):
    """(cost, audit) over whole audit strings, by trying every edit."""

    @lru_cache(None)
    def best(at, before, inserted):
        found = []
        if at == len(symbols) and before in ("", "a"):
            found.append((0, ""))
        if inserted < 3:
            found += [(5 + c, "I" + a) for r in "ua" if r in FOLLOWS[before] for c, a in best_of(at, r, inserted + 1)]
        if at < len(symbols):
            x = symbols[at]
            found += [(2 + c, "D" + a) for c, a in best_of(at + 1, before, 0)]
            if x != "-":
                extra = 5 if x == "!" or x.isupper() else 0
                found += [(extra + c, "K" + a) for r in "sua" if x.lower() == r and r in FOLLOWS[before] for c, a in best_of(at + 1, r, 0)]
                found += [(1 + extra + c, "R" + a) for r in "ua" if r in FOLLOWS[before] for c, a in best_of(at + 1, r, 0)]
        return min(found, default=None)

    def best_of(*where):
        found = best(*where)
        return [] if found is None else [found]

    return best(0, "", 0)


@given(st.lists(st.text("-suaSUA?!", max_size=9), max_size=12))
def test_cheapest_edits_and_the_first_of_equal_ones(signatures):
    ordered = sorted(set(signatures), key=lambda s: s[::-1])
    found = list(structure.Solver(structure.TURNS).audits(iter(ordered)))
    assert [(s, *plain(s)) for s in ordered] == found


def test_nodes_are_shared_by_signatures_with_one_end():
    solver, calls = structure.Solver(structure.TURNS), []
    inner = solver.before
    solver.before = lambda symbol, after: calls.append(symbol) or inner(symbol, after)
    endings = sorted((a + b + "uaua" * 50 for a in "su-" for b in "ua"), key=lambda s: s[::-1])
    assert len(list(solver.audits(iter(endings)))) == 6
    assert len(calls) == 200 + 2 + 6


def test_long_signature():
    (_, cost, audit), = structure.Solver(structure.TURNS).audits(iter(["s" + "ua" * 100_000 + "u"]))
    assert (cost, len(audit), audit[-1]) == (2, 200_002, "D")


ROWS = "conv_id bigint, turn bigint, role string, text string, mark int, present boolean"


def test_faults_gaps_nulls_ties_and_repeated_rows(spark):
    rows = [
        (1, 3, "user", "What? \n", 0, True), (1, 7, "assistant", "That.", 0, True), (1, 9, "assistant", "That.", 0, True),
        (2, None, "user", " \t", 0, True), (2, 1, "user", "cut", 0, True), (2, 1, "user", "cut", 0, True), (2, 2, None, "Hm.", 0, True),
        (3, 1, "user", "gone.", 0, False),
        (None, None, "system", "Be.", 0, True), (None, None, "user", "Hi!", 0, True),
        (5, -(2**63), "tool", None, 0, True), (5, 2**63 - 1, "", "x.", 0, True),
    ]
    there = F.col("present")
    df = spark.createDataFrame(rows, ROWS)
    found = {r["conv_id"]: tuple(r)[1:] for r in structure.diagnosed(df, present=there).collect()}
    assert found[1] == (4, 0, 1, 0, 1, "ua-", 2, "KKD")
    assert found[2] == (0, 1, 1, 1, 3, "-U-?", 8, "DDDD") == found[2][:6] + plain("-U-?")
    assert found[3] == (0, 0, 0, 0, 0, "", 0, "")
    assert found[None] == (0, 0, 0, 0, 0, "su", *plain("su"))
    assert found[5] == (2**63 - 1, 1, 0, 0, 1, "-?", *plain("-?"))
    diagnosis = structure.diagnosed(df, present=there)
    edited = structure.repaired(df, diagnosis, present=there)
    steps = {}
    for r in edited.collect():
        steps.setdefault(r["conv_id"], []).append(tuple(r)[1:])
    assert steps[1] == [(0, "K", 3, "user", "What? \n"), (1, "K", 7, "assistant", "That."), (2, "D", 9, None, None)]
    assert steps[3] == [(None, None, None, None, None)]
    digests = {r[0]: r[1] for r in structure.digests(edited).collect()}
    assert digests[1] == hashlib.sha256(b"user:What? \n\nassistant:That.").hexdigest()
    assert digests[3] == hashlib.sha256(b"").hexdigest()


def test_inserted_and_reroled_turns(spark):
    rows = [(1, t, r, x, 0, True) for t, r, x in ((0, "user", "A?"), (1, "assistant", "B."), (2, "assistant", "C."), (3, "assistant", "D."))]
    rows += [(2, t, r, f"{t}.", 0, True) for t, r in enumerate(["system", *["user", "assistant"] * 3, "assistant", "user", "assistant"])]
    df = spark.createDataFrame(rows, ROWS)
    found = structure.diagnosed(df)
    got = {}
    for r in structure.repaired(df, found).collect():
        got.setdefault(r["conv_id"], []).append((r["edit"], r["role"], r["text"]))
    assert got[1] == [("K", "user", "A?"), ("K", "assistant", "B."), ("R", "user", "C."), ("K", "assistant", "D.")]
    assert ("D", None, None) in got[2] and len(got[2]) == 10


def test_empty_table(spark):
    df = spark.createDataFrame([], ROWS)
    found = structure.diagnosed(df)
    assert found.count() == 0 and structure.repaired(df, found).count() == 0


def test_signature_pass_shuffles_no_text(spark):
    df = spark.createDataFrame([(1, 1, "user", "A.", 0, True)], ROWS)
    plan = structure.signed(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1
    above = plan[: plan.index("Exchange ")]
    assert "alone#" in above and "text#" not in above


def test_query_against_plain_python(spark, sf_dir):
    rows = queries.table(spark, sf_dir, "conversations").collect()
    convs = {}
    for r in rows:
        convs.setdefault(r["conv_id"], []).append(r)
    want = set()
    for conv, turns in convs.items():
        kept = []
        for r in sorted(turns, key=lambda r: r["turn"]):
            fault = zlib.crc32(f"{r['conv_id']}:{r['turn']}".encode()) % 20
            text = {1: "", 2: re.sub("[.!?]", "", r["text"])}.get(fault, r["text"])
            role = "user" if fault == 4 else r["role"]
            kept += [(r["turn"], role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
        seen, counts, symbols = set(), [0, 0, 0], ""
        for _, role, text in kept:
            ends = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = 0 if not ends else 1 if (role, text) in seen else 2 if ends[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            symbols += "-" if fault in (0, 1) else role[0].upper() if fault == 2 else role[0]
        illegal = sum(a[1][0] + b[1][0] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:]))
        numbers = [t for t, _, _ in kept]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        cost, audit = plain(symbols)
        left, out, before = list(kept), [], ""
        for edit in audit:
            _, role, text = left.pop(0) if edit != "I" else (0, "", "")
            if edit == "D":
                continue
            if edit in "RI":
                role = "assistant" if before == "u" else "user"
            before = role[0]
            out.append(f"{role}:{text}")
        assert re.fullmatch("(s?(ua)+)?", "".join(o[0] for o in out))
        want.add((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()))
    names = "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()
    got = [tuple(r[n] for n in names) for r in queries.QUERIES["op11_conversation_repair"](spark, sf_dir).collect()]
    assert len(got) == len(convs) and set(got) == want
