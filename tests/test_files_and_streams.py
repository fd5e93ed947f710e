"""Corpus folders, stored files, streams as rows, engine output and the verdict cache."""

import hashlib
import os
import time
import zlib
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.functions import rules as functions_rules
from sievework.functions.dialect import SPARK
from sievework.functions.tables import SCANNERS
from sievework.operators import engine_output, hits, pdf_rows
from sievework.operators import rewriting as R
from sievework.plans.comparison import run_corpus, store_compared
from sievework.sources.corpus import StoreWriter, corpus_files, corpus_status, listing, store, stored_file
from sievework.streaming import cache


def put(root, files):
    for path, content in files.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(content)


@pytest.fixture
def folder(tmp_path):
    png = R.png_bytes(np.full((2, 2, 3), 7, np.uint8))
    put(tmp_path / "root", {"malicious/x.pdf.sample.SAMPLE": b"%PDF-1.7 /Launch", "malicious/b/again.pdf": b"%PDF-1.7 fine, really", "malicious/Z.pdf": b"", "clean/malicious/y.pdf": b"%PDF-1.7 fine, really", "clean/p.png": png, "other/no.pdf": b"%PDF-1.7", "clean/a,b \xe9.pdf": b"%PDF-1.7 more"})
    os.symlink("/nonexistent", tmp_path / "root/clean/gone.pdf")  # these two are listed, but can't be read
    os.symlink("/proc/self/mem", tmp_path / "root/malicious/torn.pdf")
    return tmp_path / "root"


def test_files_that_cannot_be_read_are_rows_with_their_error(spark, folder):
    rows = {r["relative_path"]: r for r in corpus_files(spark, str(folder)).collect()}
    assert set(rows) == {"malicious/x.pdf.sample.SAMPLE", "malicious/b/again.pdf", "malicious/Z.pdf", "clean/malicious/y.pdf", "clean/p.png", "clean/a,b \xe9.pdf", "clean/gone.pdf", "malicious/torn.pdf"}
    assert rows["clean/gone.pdf"]["content"] is None and "FileNotFound" in rows["clean/gone.pdf"]["error"]
    assert {p for p, r in rows.items() if r["error"] is not None} == {"clean/gone.pdf", "malicious/torn.pdf"} == {p for p, r in rows.items() if r["content"] is None}
    assert rows["malicious/x.pdf.sample.SAMPLE"]["file_name"] == "x.pdf" and rows["malicious/x.pdf.sample.SAMPLE"]["declared_type"] == "application/pdf" and rows["clean/malicious/y.pdf"]["truth"] == "clean"
    assert [p for p, r in sorted(rows.items(), key=lambda x: x[1]["place"]) if r["truth"] == "malicious"] == ["malicious/Z.pdf", "malicious/b/again.pdf", "malicious/torn.pdf", "malicious/x.pdf.sample.SAMPLE"]


def test_a_run_from_a_folder_to_the_fact_table(spark, folder, tmp_path):
    got = run_corpus(spark, str(folder), str(tmp_path / "csv"))
    assert (got.processed, got.malicious, got.clean, got.rows, got.failed) == (6, 3, 3, 36, 2) and got.seconds > 0
    assert [x[1:] for x in got.layers] == [(6, 0), (6, 1), (5, 0), (5, 0), (5, 1), (4, 0), (4, 0), (4, 0), (4, 0)] and len({x[0] for x in got.layers}) == 9
    facts = spark.read.option("header", True).csv(got.csv)
    assert facts.count() == 36 and facts.where("relative_path LIKE '%gone%' OR relative_path LIKE '%torn%'").count() == 0
    last = {r["relative_path"]: r for r in facts.where(f"scanner = '{SCANNERS[-1]}'").collect()}
    assert last["clean/malicious/y.pdf"]["from_cache"] == "1" and last["malicious/b/again.pdf"]["from_cache"] == "0"
    assert last["malicious/x.pdf.sample.SAMPLE"]["accepted"] == "0" and last["clean/p.png"]["content_rewritten"] == "1"
    nothing = run_corpus(spark, str(tmp_path / "empty"), str(tmp_path / "csv2"))
    assert (nothing.processed, nothing.rows, nothing.failed) == (0, 0, 0)


def test_status_listing_and_one_file(spark, folder, tmp_path):
    assert sorted(map(tuple, corpus_status(spark, str(folder)).collect())) == [("clean", True, 4), ("malicious", True, 4), ("total", True, 8)]
    assert sorted(map(tuple, corpus_status(spark, str(tmp_path)).collect())) == [("clean", False, 0), ("malicious", False, 0), ("total", False, 0)]
    put(tmp_path / "kept", {"id/a b[1].PDF": b"1234", "profile/x.svg": b"", "other/n": b"1"})
    at = str(tmp_path / "kept")
    assert sorted(map(tuple, listing(spark, at).collect())) == [("id", "a b[1].PDF", 4, "/api/files/id/a b[1].PDF"), ("profile", "x.svg", 0, "/api/files/profile/x.svg")]
    assert [(r[0], r[1], bytes(r[2])) for r in stored_file(spark, at, "ID", "a b[1].PDF").collect()] == [("a b[1].PDF", "application/pdf", b"1234")]
    assert stored_file(spark, at, "other", "n").count() == stored_file(spark, at, "id", "gone").count() == 0
    for name in ("", "../x", "a/b", "a\\b"):
        with pytest.raises(ValueError):
            stored_file(spark, at, "id", name)


def files_of(path):
    return {os.path.relpath(os.path.join(d, f), path): open(os.path.join(d, f), "rb").read() for d, _, names in os.walk(path) for f in names if not f.endswith(".crc")}


def test_store(spark, tmp_path):
    rows = [("id", f"{i}.bin", bytes([i]) * i) for i in range(50)] + [("", "top", b"x"), ("id/sub", "none", None)]
    df = spark.createDataFrame(rows, "folder string, stored_name string, content binary").repartition(5)
    at = store(df, str(tmp_path), "first")
    assert files_of(at) == {os.path.join(f, n): c or b"" for f, n, c in rows} and sorted(os.listdir(tmp_path)) == ["first"]
    with pytest.raises(ValueError):
        store(df, str(tmp_path), "first")
    with pytest.raises(Exception, match="below the run"):  # one bad name, and nothing of the run is to be seen
        store(df.union(spark.createDataFrame([("../up", "x", b"")], df.schema)), str(tmp_path), "second")
    assert sorted(os.listdir(tmp_path)) == ["first"]
    assert files_of(store(df.limit(0), str(tmp_path), "none")) == {}


def test_a_task_that_runs_again_leaves_no_doubles(tmp_path):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"folder": ["a", "a"], "stored_name": ["x", "y"], "content": [b"1", b"2"]})
    writer = StoreWriter(str(tmp_path), "run")
    done = [writer.write(iter([batch])), writer.write(iter([batch]))]
    (tmp_path / ".pending-run/a/.lost.part").write_bytes(b"half")
    writer.commit(done[:1])
    assert files_of(tmp_path / "run") == {"a/x": b"1", "a/y": b"2"} and os.listdir(tmp_path) == ["run"]


def test_stored_bytes_are_those_of_the_scan(spark, tmp_path):
    png = R.png_bytes(np.full((2, 2, 3), 7, np.uint8))
    files = spark.createDataFrame([("1", "a.png", "image/png", "id", png + b"tail"), ("2", "b.pdf", "application/pdf", "id", b"%PDF-1.7 /Launch"), ("3", "c.exe", None, "id", None)], "id string, file_name string, declared_type string, category string, content binary")
    kept = files_of(store_compared(files, str(tmp_path)))
    name = lambda i: hashlib.sha256(i.encode()).hexdigest()[:32]
    assert len({k for k in kept if k.startswith(name("1"))}) == 6
    for k, content in kept.items():
        if k.startswith(name("1")):
            scanner = k.split("/")[1][:-4]
            want = png + b"tail" if scanner in ("basicvalidation", "dvwa-low", "dvwa-medium", "dvwa-high") else None
            assert content == want if want else (R.png_pixels(content) == (7 if scanner == "dvwa-impossible" else 6)).all() and b"tail" not in content
    assert kept[f"{name('2')}/dvwa-low.pdf"] == b"%PDF-1.7 /Launch" and kept[f"{name('3')}/dvwa-low.exe"] == b""


def pdf(*bodies):
    return b"%PDF-1.4\n" + b"".join(b"stream\r\n" + b + b"\nendstream\n" for b in bodies)


def test_streams_as_rows(spark):
    text = [b"/OpenAction /JS", b"second \xff\x00 stream", b"x" * 5000]
    files = [pdf(*map(zlib.compress, text)), pdf(zlib.compress(zlib.compress(text[0])), b"plain", zlib.compress(text[1])), b"", None, pdf(zlib.compress(zlib.compress(bytes(10 << 20), 9), 9), zlib.compress(b"after a bomb")), b"stream\nnever closed", pdf(b"no", b"deflate")]
    df = spark.createDataFrame(list(enumerate(files)), "id int, content binary").repartition(3)
    rows = pdf_rows.stream_rows(df)
    got = {(r["id"], r["stream"]): (r["depth"], r["bomb"], None if r["inflated"] is None else bytes(r["inflated"])) for r in rows.collect()}
    assert got == {**{(0, k): (1, False, t) for k, t in enumerate(text)}, (1, 0): (2, False, text[0]), (1, 1): (0, False, None), (1, 2): (1, False, text[1]), (4, 0): (2, True, None), (6, 0): (0, False, None), (6, 1): (0, False, None)}
    whole = {r["id"]: bytes(r["inflated"]) for r in pdf_rows.joined(rows, "id").collect()}
    spans = {}
    for r in pdf_rows.spans(rows, "id").orderBy("id", "stream").collect():
        spans.setdefault(r["id"], []).append({"start": r["start"], "len": r["length"], "stream": r["stream"]})
    for k, content in enumerate(files):
        one = R.inflate_pdf(content or b"")
        assert whole.get(k, b"") == one[0] and spans.get(k, []) == one[6]


def test_engine_output(spark):
    lines = ["0x1:$x: before any rule", 'Rule_A [severity="high",note="a, \\"b\\" ] c",Note="last"] /tmp/x\r\n', "", "0x1f:$a1: text: with colons", "  not a line of the engine", "Rule_B [] y", "0xFF:$:", "0x2:$b:  two"]
    df = spark.createDataFrame([(1, k, x) for k, x in enumerate(lines)] + [(2, 0, "0x1:$x: another file"), (3, 0, None)], "id int, line_no int, line string").repartition(3)
    got = [tuple(r) for r in engine_output.parse_lines(df).orderBy("id", "line_no").collect()]
    a = {"severity": "high", "note": "last"}
    assert got == [(1, 1, "Rule_A", a, None, None, None), (1, 3, "Rule_A", a, 31, "$a1", "text: with colons"), (1, 5, "Rule_B", {}, None, None, None), (1, 6, "Rule_B", {}, 255, "$", ""), (1, 7, "Rule_B", {}, 2, "$b", " two")]


def test_very_many_hits_of_one_file(spark):
    """Time and memory grow with the hits, not with their square."""
    n = 100_000
    df = spark.range(1).selectExpr(f"'%PDF ' || repeat('/JS /AA ', {n // 2}) AS t").withColumn("rules", F.array(F.lit(9)))
    began = time.time()
    got = df.selectExpr(f"transform({hits.fired('rules')}, f -> named_struct('n', size(f.hits), 'last', element_at(f.hits, -1).place, 'near', f.near)) AS f").first()["f"][0]
    assert got["n"] == n and got["last"] == 5 + 8 * (n // 2 - 1) + 4 and [(p["group_a"], p["group_b"], p["distance"], p["at"]) for p in got["near"]] == [("act", "js", 4, 5)]
    assert time.time() - began < 60


def test_anchors_lose_no_match(spark):
    rng = np.random.default_rng(5)
    parts = [x for r in functions_rules.RULES for k, (kind, p) in r.strings.items() for x in (functions_rules.anchors_of(r, k) + ([p, p.swapcase()] if kind in "=~" else [bytes.fromhex(p).decode("latin-1")] if kind[0] == "x" else []))]
    parts += ["%PDF", "(", " ", "\n", "onload=", "eval (", "$_POST[a](", "[0 0 1200 800 ]", "Request[a]", "request", "\x89PNG\r\n\x1a\n", "{8}", "é"]
    texts = ["".join(rng.choice(parts, int(rng.integers(1, 25)))).encode("latin-1", "replace") for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, raw binary").repartition(4).withColumn("t", F.decode("raw", "ISO-8859-1")).withColumn("low", F.lower("t"))
    apart = ", ".join(f"CASE WHEN {functions_rules.rule_sql(r, SPARK)} THEN {r.number} END" for r in functions_rules.RULES)
    rows = df.selectExpr("id", f"{functions_rules.matched_sql(SPARK)} AS one", f"filter(array({apart}), x -> x IS NOT NULL) AS apart").collect()
    assert all(r["one"] == r["apart"] for r in rows) and len({x for r in rows for x in r["one"]}) > 15


def test_running_sums(spark):
    for n in (0, 1, 255, 256, 257, 1000):
        xs = [int(x) for x in np.random.default_rng(n).integers(0, 9, n)]
        got = spark.createDataFrame([(xs,)], "x array<bigint>").selectExpr(f"{hits.running('x')} AS s").first()["s"]
        assert got == [sum(xs[:i]) for i in range(n)]


def test_verdict_cache(spark, tmp_path):
    at = datetime(2024, 1, 1, 12)
    minutes = lambda m: at + timedelta(minutes=m)
    batches = [
        [("a", minutes(0), b"bad"), ("b", minutes(1), b"bad"), ("c", minutes(2), b"image"), ("n", minutes(0), None)],
        [("d", minutes(59), b"bad"), ("e", minutes(60), b"bad"), ("f", minutes(3), b"image"), ("g", None, b"bad")],
        [("h", minutes(61), b"bad"), ("i", minutes(121), b"bad"), ("j", minutes(5), b"good"), ("k", minutes(6), b"good")],
    ]
    schema = "id string, arrived timestamp, content binary"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
        time.sleep(1.1)  # the file source takes files by their time
    uploads = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))

    def inspect(content):
        return ("rejected", "yara-rule") if content == b"bad" else ("rewritten", "") if content == b"image" else ("accepted", "")

    def run(fingerprint, name):
        out = cache.cached(uploads, "SignatureScanning", fingerprint, inspect)
        stream = out.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-ck")).start()  # runs on by itself, as verdicts expire by the clock
        deadline = time.time() + 100
        while stream.isActive and time.time() < deadline and not (stream.lastProgress and sum(p.numInputRows for p in stream.recentProgress) >= 12 and stream.lastProgress.numInputRows == 0):
            time.sleep(0.5)
        stream.stop()
        return spark.read.parquet(str(tmp_path / name)).withColumn("shown", cache.shown_layer("layer_name")).collect()

    got = run("rules 1", "out")
    assert {r["id"]: (r["decision"], r["from_cache"]) for r in got} == {
        "a": ("rejected", False), "b": ("rejected", True), "c": ("rewritten", False), "n": ("accepted", False), "d": ("rejected", True), "e": ("rejected", False), "f": ("rewritten", False),
        "h": ("rejected", True), "i": ("rejected", False), "j": ("accepted", False), "k": ("accepted", True),
    }
    assert all(r["layer_name"] == ("Cached(SignatureScanning)" if r["from_cache"] else "SignatureScanning") and r["shown"] == "SignatureScanning" for r in got)
