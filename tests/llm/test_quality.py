import numpy as np
import pytest

from crossfade.llm import quality


def test_shape_of_whole_texts_piece_by_piece(monkeypatch):
    text = ("Some words. AND SHOUTS!! same same same\nsame line\nsame line\n" * 30).encode()
    whole = quality.shape(text)
    monkeypatch.setattr(quality.pieces, "__defaults__", (40,))
    part = quality.shape(text)
    lines = quality.FEATURES.index("same_lines")  # a piece may end within a line
    assert [x for i, x in enumerate(part) if i != lines] == pytest.approx([x for i, x in enumerate(whole) if i != lines])
    assert len(quality.shape(b"")) == len(quality.FEATURES) and np.isfinite(quality.shape(b"")).all()


def brute_rates(rows):
    """Shrunken rates with plain loops: (host, path, good)."""
    mu = (sum(g for *_, g in rows) + 1) / (len(rows) + 2)
    groups = lambda key: {k: [g for h, p, g in rows if key(h, p) == k] for k in {key(h, p) for h, p, _ in rows}}

    def strength(of, rate, parents):
        n = [len(v) for v in of.values()]
        q = sum(len(v) * (np.mean(v) - rate(k)) ** 2 / max(rate(k) * (1 - rate(k)), 1e-6) for k, v in of.items())
        free = len(of) - parents
        rho = (q - free) / max(sum(n) - sum(x * x for x in n) / sum(n) - free, 1) if free > 0 else 0
        rho = min(max(rho, 1e-3), 0.9)
        return (1 - rho) / rho

    hosts = groups(lambda h, p: h)
    m = strength(hosts, lambda k: mu, 1)
    host = {k: (sum(v) + m * mu) / (len(v) + m) for k, v in hosts.items()}
    paths = groups(lambda h, p: (h, p))
    m = strength(paths, lambda k: host[k[0]], len(hosts))
    return mu, host, {k: (sum(v) + m * host[k[0]]) / (len(v) + m) for k, v in paths.items()}


def test_rates_equal_plain_loops(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(400):
        h = [None, "a", "b", "c", "c", "c"][rng.integers(6)]
        p = [None, "x", "y"][rng.integers(3)]
        rows.append((h, p, int(rng.random() < {None: 0.5, "a": 0.9, "b": 0.2, "c": 0.6}[h] - 0.1 * (p == "x"))))
    frame = spark.createDataFrame(rows, "host string, path string, good int")
    mu, hosts, paths = quality.site_rates(frame)
    want_mu, want_hosts, want_paths = brute_rates(rows)
    assert mu == pytest.approx(want_mu)
    assert {r.host: r.host_rate for r in hosts.collect()} == pytest.approx(want_hosts)
    assert {(r.host, r.path): r.path_rate for r in paths.collect()} == pytest.approx(want_paths)


def test_held_out_labels(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model, measured = quality.fit(docs, labels.filter("doc_id % 3 != 1"))
    found = quality.score(measured, model).join(labels.filter("doc_id % 3 = 1"), "doc_id").toPandas()
    assert (found["keep"] == (found["quality"] == 1)).mean() > 0.97


def test_sparse_sites_nulls_and_clashing_names(spark):
    good, bad = "plain words in a line that say this and that", "SHOUT!! SHOUT!! SHOUT!! SHOUT!!"
    rows = [(i, (good, bad)[i % 2], ("h", "g")[i % 2], "p") for i in range(40)] + [(50, good, None, None), (51, None, "h", None), (52, "", "new", "p"), (52, "", "new", "p"), (None, good, "g", "q")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, source string, lang string, keep int")
    labels = spark.createDataFrame([(i, (i + 1) % 2) for i in range(30)] + [(None, 1), (3, None), (99, 1)], "doc_id bigint, quality int")
    model, measured = quality.fit(docs, labels)
    found = quality.score(measured, model).collect()
    assert len(found) == len(rows)
    rate = {(r.host, r.path): r.site_rate for r in found}
    assert rate["g", "p"] < rate["g", "q"] < rate["new", "p"] == rate[None, None] < rate["h", "p"]
    assert all(r.keep == (r.doc_id % 2 == 0) for r in found if r.doc_id is not None and r.doc_id < 40)
    again = quality.score(quality.measure(docs), model, host_col="source", path_col="lang")
    assert again.columns == ["doc_id", "text", "source", "lang", "evidence", "site_rate", "quality_score", "keep"]
    assert sorted(r.quality_score for r in again.collect()) == pytest.approx(sorted(r.quality_score for r in found))


def test_without_labels_everything_stays(spark):
    docs = spark.createDataFrame([(1, "a", "h", "p")], "doc_id bigint, text string, source string, lang string")
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    model, measured = quality.fit(docs, none)
    assert [(r.quality_score, r.keep) for r in quality.score(measured, model).collect()] == [(0.5, True)]
    model, measured = quality.fit(docs.limit(0), none)
    assert quality.score(measured, model).count() == 0
