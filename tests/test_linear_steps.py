"""Steps whose work must not grow beyond their input: links behind their names, runs of places, images decoded once, bounded batches."""

import re

import numpy as np
import pytest

from sievework.functions.dialect import DUCKDB, SPARK
from sievework.functions.rules import RULES, rule_sql
from sievework.operators import layers as L
from sievework.operators import ordering, rewriting as R
from sievework.plans import bytes_queries as B


def test_schemes_are_looked_for_behind_their_names(spark):
    assert len(re.findall(r"contains\(low, '\w+'\) AND regexp_like", L.scheme(SPARK))) == L.scheme(SPARK).count("regexp_like") == len(L.SCHEMES)
    assert "contains" not in L.scheme(DUCKDB)
    texts = {"javascript:a": "javascript", "x-javascript:": None, "javascript ;": None, " PHP :x file:": "file", "(jar\t:": "jar", "mocha": None, "": None}
    df = spark.createDataFrame([(t, t.lower()) for t in texts], "t string, low string")
    assert [r.s for r in df.selectExpr(f"{L.scheme(SPARK)} AS s").collect()] == list(texts.values())


def test_marks_at_the_edge(spark):
    files = [(" " * k + "%PDF") for k in (0, 1020, 1021, 1024, 1025)] + ["x" * 3000, "\xe9" * 1020 + "%PDF", "\xe9" * 1021 + "%PDF"]
    df = spark.createDataFrame([(t + " /Launch",) for t in files], "t string").selectExpr("t", "lower(t) AS low", "encode(t, 'ISO-8859-1') AS raw")
    got = df.selectExpr(f"{L.linkable(SPARK)} AS l", f"{rule_sql(RULES[9], SPARK)} AS r").collect()
    assert [r.l for r in got] == [True, True, False, False, False, False, True, False]
    assert [r.r for r in got] == [True, True, True, True, False, True, True, True]
    assert "instr(t, '%PDF')" not in L.linkable(SPARK) + rule_sql(RULES[9], SPARK)


def test_links_to_hosts_are_looked_for_where_there_is_a_scheme(spark):
    import inspect

    from sievework.plans import reports

    assert "contains(low, '://')" in inspect.getsource(reports.l5c_links_blocking)


@pytest.mark.parametrize("seed", range(3))
def test_runs_are_what_single_places_are(spark, seed):
    rng = np.random.default_rng(seed)
    runs, spans, want = [], [], []
    for key in range(5):
        low, high = sorted(rng.integers(0, 60, 2).tolist())
        runs.append((key, low, high + (key == 4) - (key == 4)))
        at, held = 0, {}
        for name in range(0 if key == 3 else 6):
            at += int(rng.integers(0, 6))
            n = int(rng.integers(0, 9))
            spans.append((key, at, n, f"s{name}"))
            held |= dict.fromkeys(range(at, at + n), f"s{name}")
            at += n
        want += [(key, place, held.get(place)) for place in range(low, high + 1)]
    got = ordering.runs_within_spans(spark.createDataFrame([*runs, (9, 5, 4)], "key int, low long, high long"), spark.createDataFrame(spans, "key int, start long, n long, name string"), "key", "low", "high", "start", "n", "name").collect()
    assert sorted((r.key, p, r["name"]) for r in got for p in range(r.low, r.high + 1)) == sorted(want)


def test_images_are_decoded_once(spark, monkeypatch):
    calls, whole = [], R.png_pixels
    monkeypatch.setattr(R, "png_pixels", lambda data: calls.append(1) or whole(data))
    file = B._png(b"some text, and more of it" * 9)
    pixels = whole(file)
    assert R.reencode(file, pixels=pixels) == R.reencode(file) and len(calls) == 1
    assert (whole(file) == pixels).all()


def test_batches_are_bounded(spark):
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 1 << 30)
    R.per_file(spark.createDataFrame([(1, b"x")], "id int, content binary"), R.inflate_pdf, R.PDF_FIELDS)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) == R.RUN_BYTES
