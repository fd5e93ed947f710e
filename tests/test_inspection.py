"""Layers, rules, rewriting and the whole scan on small files made by hand."""

import os
import struct
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from sievework.functions.dialect import SPARK
from sievework.functions.rules import RULES, rule_sql
from sievework.operators import rewriting as R
from sievework.plans import catalogue
from sievework.operators import hits
from sievework.plans.scan import scan
from sievework.sources.cases import CASES, cases_sql

DATA = "/root/testdata/sf0.001"


def rows(df):
    names = sorted(df.columns)
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return con


SOME = [
    "l1_extension", "l2_magic", "l2_svg", "l2_foreign", "l3_header", "l4_double_ext", "l5_signature", "l5c_links", "fn_riff_end", "yara_hits", "join_proximity", "yara_evidence", "yara_describe", "scan_layered", "scan_evidence", "agg_funnel",
    "compare_run", "corpus_run", "agg_metrics", "sort_paths", "agg_links_per_host", "l5b_pdf_flate", "l6_reencode", "fn_psnr", "l7_svg_sanitize", "agg_removed_counts", "join_range_span", "scan_built",
    "pdf_extract_streams", "set_concat_streams", "yara_parse", "l5c_links_blocking", "agg_confusion_strict", "agg_ablation_images", "img_trailing", "img_dimension_guard", "fn_reason_code", "join_lookup_types", "yara_counts", "yara_by_severity", "prj_unwrap_layer", "src_rules", "agg_severity_order", "agg_metrics_published",
]


@pytest.mark.parametrize("name", SOME)
def test_query_equals_its_sql(spark, duck, name):
    got = catalogue.queries()[name](spark, DATA)
    want = duck.execute(catalogue.oracle_sql()[name])
    order = [[d[0] for d in want.description].index(c) for c in sorted(got.columns)]
    assert rows(got) == sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=repr)


def test_every_rule_case(spark):
    from sievework.operators.layers import view

    seen = spark.sql(view(SPARK, cases_sql(SPARK)))
    got = {r["id"]: r["matched"] for r in seen.selectExpr("*", "CASE rule_no " + " ".join(f"WHEN {r.number} THEN {rule_sql(r, SPARK)}" for r in RULES) + " END AS matched").collect()}
    assert [got[-k - 1] for k in range(len(CASES))] == [ok for _, ok, _ in CASES]
    assert {rule for rule, ok, _ in CASES if ok} == {rule for rule, ok, _ in CASES if not ok} == set(range(1, 25))


def test_binary_rules(spark):
    from sievework.sources.submissions import as_text

    files = [(1, b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1 AutoOpen", 13, True), (2, b" \xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1 AutoOpen", 13, False), (3, b"\x89PNG\r\n\x1a\n..Rar!\x1a\x07\x00", 22, True), (4, b"\x89PNG\r\n\x1a\n..Rar!\x1a\x07", 22, False), (5, b"\xff\xd8\xff<?= eval (", 5, True), (6, b"\xff.MZ.PE\0\0", 19, True), (7, b"MZ.PE\0\0", 19, False)]
    df = as_text(spark.createDataFrame(files, "id int, content binary, rule_no int, expected boolean"))
    got = df.selectExpr("expected", "CASE rule_no " + " ".join(f"WHEN {r.number} THEN {rule_sql(r, SPARK)}" for r in RULES) + " END AS matched").collect()
    assert all(r["expected"] == r["matched"] for r in got)


def test_published_metrics(spark):
    got = catalogue.queries()["agg_metrics_published"](spark, DATA).where("scanner = 'gated'").first()
    assert [round(got[c], 4) for c in ("recall", "precision", "accuracy", "f1", "specificity", "fpr")] == [0.9548, 0.9305, 0.9354, 0.9425, 0.9113, 0.0887]


def test_riff_end(spark):
    files = [(0, b"RIFF\x04\0\0\0WEBPxy", 12), (1, b"RIFF\x06\0\0\0WEBPxy", 14), (2, b"RIFF\x07\0\0\0WEBPxy", None), (3, b"RIFF\x03\0\0\0WEBPxy", None), (4, b"RIFF\x04\0\0\x01WEBPxy", None), (5, b"RIFF\x04\0\0\0", None), (6, b"", None), (7, b"RIFF\0\x01\0\0".ljust(300, b"."), 264)]
    spark.createDataFrame([f[:2] for f in files], "id long, content binary").createOrReplaceTempView("riff_files")
    assert {r["id"]: r["end_at"] for r in spark.sql(catalogue.riff_end("SELECT * FROM riff_files")).collect()} == {f[0]: f[2] for f in files}
    assert catalogue.queries()["fn_riff_end"](spark, DATA).count() == catalogue.queries()["l1_extension"](spark, DATA).count()


def pdf(*bodies):
    return b"%PDF-1.4\n" + b"".join(b"stream\r\n" + b + b"\nendstream\n" for b in bodies)


def test_inflating():
    once, text = zlib.compress(b"/OpenAction /JS"), b"/OpenAction /JS"
    assert R.inflate_pdf(pdf(once))[:4] == (text + b"\n", 1, 1, 1)
    assert R.inflate_pdf(pdf(zlib.compress(once)))[:4] == (text + b"\n", 1, 1, 2)
    five = text
    for _ in range(5):
        five = zlib.compress(five)
    assert R.inflate_pdf(pdf(five))[3] == 4 and not R.inflate_pdf(pdf(five))[5]
    assert R.inflate_pdf(pdf(once[:-1] + b"x"))[0] == text + b"\n"  # a wrong check sum: raw deflate still opens it
    zeros = zlib.compress(bytes(10 << 20), 9)
    assert not R.inflate_pdf(pdf(zeros))[5] and R.inflate_pdf(pdf(zeros), 200)[5]
    assert R.inflate_pdf(pdf(zlib.compress(zeros, 9)))[5]
    assert R.pdf_streams(b"stream\nabc") == [] and R.pdf_streams(b"stream\nendstream") == []
    assert [b for _, b in R.pdf_streams(b"xstream\r\nabc\r\nendstream stream\nd\nendstream")] == [b"abc", b"d"]
    assert R.inflate_pdf(b"")[:3] == (b"", 0, 0)


def test_images():
    pixels = np.random.default_rng(1).integers(0, 256, (5, 7, 4)).astype(np.uint8)
    made = R.png_bytes(pixels)
    assert (R.png_pixels(made) == pixels).all()
    out = R.reencode(made + b"PK\x03\x04 hidden")
    assert out[1:] == ("png", 7, 5, 11, None)
    again = R.png_pixels(out[0])
    assert (again[..., :3] & 1 == 0).all() and (again[..., 3] == pixels[..., 3]).all() and R.trailing(out[0], "png") == 0
    huge = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 20_000, 20_000)
    assert R.reencode(huge)[5] == "dimensions" and R.reencode(b"\xff\xd8\xff")[5] == "no image header"
    assert R.trailing(made[:-2], "png") == 0 and R.trailing(b"\xff\xd8..\xff\xd9abc", "jpeg") == 3 and R.trailing(b"RIFF\x04\0\0\0WEBPxy", "webp") == 2
    lines = zlib.compress(b"\x01\x01\x01\x01" + b"\x02\x01\x01\x01" + b"\x03\x01\x01\x01" + b"\x04\x01\x01\x01")
    chunk = lambda n, b: struct.pack(">I", len(b)) + n + b + struct.pack(">I", zlib.crc32(n + b))
    grey = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 3, 4, 8, 0, 0, 0, 0)) + chunk(b"IDAT", lines) + chunk(b"IEND", b"")
    assert R.png_pixels(grey)[..., 0].tolist() == [[1, 2, 3], [2, 3, 4], [2, 3, 4], [3, 4, 5]]
    palette = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 1, 8, 3, 0, 0, 0)) + chunk(b"PLTE", bytes([1, 2, 3, 255, 254, 253])) + chunk(b"IDAT", zlib.compress(b"\0\1\0")) + chunk(b"IEND", b"")
    assert R.png_pixels(palette).tolist() == [[[255, 254, 253], [1, 2, 3]]]


def test_ends_and_sizes_of_images(spark):
    from sievework.operators import images

    made = R.png_bytes(np.zeros((3, 2, 3), np.uint8))
    files = [("png", made), ("png", made + b"IEND" + b"tail" * 3), ("png", made[:-2]), ("png", b"\x89PNG"), ("jpeg", b"\xff\xd8.\xff\xd9..\xff\xd9abc"), ("jpeg", b"\xff\xd8"), ("webp", b"RIFF\x04\0\0\0WEBPxy"), ("webp", b"RIFF\xff\0\0\0WEBPxy")]
    df = spark.createDataFrame([(k, *f) for k, f in enumerate(files)], "id int, kind string, content binary")
    width, height = images.png_size("content")
    got = df.selectExpr(f"octet_length(content) - {images.image_end('content', 'kind')} AS more", f"{width} AS w", f"{height} AS h", "id").orderBy("id").collect()
    assert [r["more"] for r in got] == [R.trailing(c, k) for k, c in files] == [0, 8, 0, None, 3, None, 2, None]
    assert [(r["w"], r["h"]) for r in got[:4]] == [(2, 3)] * 3 + [(None, None)]


def test_svg():
    out = R.sanitise_svg(b'<svg xmlns="http://www.w3.org/2000/svg" onload="x()"><!--c--><script>1<g/></script><foreignObject/><SCRIPT/><a xlink:href="y" xmlns:xlink="z"><g/></a><?p q?><rect width="1&quot;"/></svg>')
    assert out[0].decode() == '<svg xmlns="http://www.w3.org/2000/svg"><!--c--><?p q?><rect width=\'1"\'></rect></svg>'
    assert out[1:] == ({"script": 2, "foreignObject": 1, "a": 1}, {"onload": 1}, 2, 1, 1, None)
    assert R.sanitise_svg(b"<!DOCTYPE svg [<!ENTITY a 'b'>]><svg/>")[6].startswith("SVG-PARSE")
    assert R.sanitise_svg(b"<html><svg/></html>")[6] == "SVG-BADROOT" and R.sanitise_svg(b"")[6].startswith("SVG-PARSE")


def test_psnr():
    x = np.full((2, 2, 3), 7, np.uint8)
    assert R.psnr(x, x) == float("inf") and abs(R.psnr(x, x - 1) - 10 * np.log10(65025)) < 1e-9


def places(text, rx):
    """By brute force: everywhere that the pattern begins."""
    import re

    return [i for i in range(len(text)) if re.compile(rx.encode("latin-1")).match(text, i)]


def test_hits_are_all_places_in_bytes(spark):
    body = "é%PDF /JavaScript /openaction /JavaScript é /AA /AA é /JavaScript/JS".encode()
    files = [(1, body), (2, b"%PDF /Launch/launch/LAUNCH"), (3, b"<?php eval( $_POST[a]( $_GET[1](".replace(b"(", b" (")), (4, b"BMx <?php system ( MZ")]
    df = spark.createDataFrame(files, "id int, content binary").selectExpr("id", "decode(content, 'ISO-8859-1') AS t").withColumn("rules", F.expr("array(9, 10, 2, 3, 5, 19)"))
    for r in df.selectExpr("id", f"{hits.fired('rules')} AS fired").collect():
        text = dict(files)[r["id"]]
        for f in r["fired"]:
            rule = RULES[f["rule_no"] - 1]
            want = [(k, p) for k, (kind, x) in rule.strings.items() for p in places(text, hits.regex_of(kind, x))]
            assert [(h["string"], h["place"]) for h in f["hits"]] == want
            groups = {}
            for h in f["hits"]:
                groups.setdefault(h["grp"], []).append(h["place"])
            pairs = sorted((min(abs(a - b) for a in groups[x] for b in groups[y]), x, y) for x in groups for y in groups if x < y)
            assert [(p["distance"], p["group_a"], p["group_b"]) for p in f["near"]] == pairs


FILES = [
    ("a.exe", "x", "id", b"%PDF-", "UNCODED"),
    ("a.pdf", "application/pdf", "other", b"%PDF-", "UNCODED"),
    ("a.pdf", "application/pdf", "id", b"ab", "magic-size"),
    ("a.pdf", "application/pdf", "id", b"GIF89a....", "magic-observed"),
    ("a.pdf", "image/png", "id", b"%PDF-1.7", "HCM-MISMATCH"),
    ("a.pdf", "", "id", b"%PDF-1.7", "HCM-MISSING"),
    ("a.php.pdf", "application/pdf", "id", b"%PDF-1.7", "DE-DANGEROUS"),
    ("a.b.pdf", "application/pdf", "id", b"%PDF-1.7", "DE-PATTERN"),
    ("b.pdf", "application/pdf", "id", b"%PDF-1.7 /Launch", "yara-rule"),
    ("c.pdf", "application/pdf; q=1", "id", pdf(zlib.compress(b"/Launch")), "pdfflate-survey"),
    ("d.pdf", "application/pdf", "id", b"%PDF-1.7 (vbscript:x)", "EL-SCHEME"),
    ("e.pdf", "application/pdf", "id", b"%PDF-1.7 fine", ""),
    ("f.png", "image/png", "id", R.png_bytes(np.full((2, 2, 3), 7, np.uint8)), ""),
    ("g.png", "image/png", "id", b"\x89PNG\r\n\x1a\n broken", "scanner-error"),
    ("h.svg", "image/svg+xml", "profile", b"<svg><rect/></svg>", ""),
    ("i.svg", "image/svg+xml", "profile", b"<html><svg/></html>", "SVG-BADROOT"),
    ("j.pdf", None, "id", None, "magic-size"),
]


def test_layers_report(spark):
    files = [
        ("a.pdf", "application/pdf", "id", pdf(zlib.compress(zlib.compress(b"/OpenAction /JS")))),
        ("b.png", "image/png", "id", R.png_bytes(np.full((2, 2, 3), 7, np.uint8)) + b"xx"),
        ("c.svg", "image/svg+xml", "profile", b"<svg><animate/><rect onfocus='a' /><!-- c --></svg>"),
        ("d.pdf", "image/png", "id", "é%PDF".encode()),
        ("e.svg", "image/svg+xml", "profile", b" " * 1020 + b"<svg/>"),
        ("f.svg", "image/svg+xml", "profile", "é".encode() * 511 + b"<svg>"),
    ]
    df = spark.createDataFrame([(k, *f) for k, f in enumerate(files)], "id int, file_name string, declared_type string, category string, content binary")
    got = {r["id"]: r for r in scan(df).collect()}
    kinds = lambda k: {(e["layer_no"], e["kind"], e["severity"]) for e in got[k]["evidence"]}
    assert {(6, "pdfflate-survey", "low"), (6, "pdfflate-yara-rule", "high"), (6, "pdfflate-yara-proximity", "high")} <= kinds(0) and got[0]["reason_code"] == "pdfflate-survey" and got[0]["top_severity"] == "high"
    assert {(8, "reencode-trailing", "high"), (8, "reencode-rewrite", "high"), (9, "svg-scope", "info")} <= kinds(1) and got[1]["is_neutralized"] and got[1]["content_rewritten"]
    assert {(9, "svg-notable", "high"), (9, "svg-preserved", "low"), (9, "svg-rewrite", "high")} <= kinds(2) and got[2]["is_neutralized"]
    assert got[3]["stopped_at"] == "MagicBytes" and got[3]["layers_run"] == 2 and not got[3]["content_rewritten"]
    assert got[4]["detected"] == "svg" and got[5]["detected"] is None  # the marker ends at byte 1024, or beyond it


def test_external_links_are_refused_where_asked(spark):
    body = b"%PDF-1.7 (http://b.example.org/x) (HTTPS://Evil.example:8/1) (http://www.w3.org/a) (https://evil.example/2) " + b"".join(b"http://h%d.net " % k for k in range(5))
    files = [(0, "a.pdf", "application/pdf", "id", body), (1, "b.pdf", "application/pdf", "id", b"%PDF-1.7 http://example.org/"), (2, "c.pdf", "application/pdf", "id", b"%PDF-1.7 (vbscript:x) http://evil.example/")]
    df = spark.createDataFrame(files, "id int, file_name string, declared_type string, category string, content binary")
    got = {r["id"]: r for r in scan(df, trusted=["example.org"]).collect()}
    assert [got[k]["reason_code"] for k in range(3)] == ["EL-EXTERNAL", "", "EL-SCHEME"] and all(r["reason_code"] != "EL-EXTERNAL" for r in scan(df).collect())
    far = [(e["label"], e["place"], e["detail"], e["severity"]) for e in got[0]["evidence"] if e["kind"] == "link-external"]
    assert far == [("evil.example", body.index(b"HTTPS"), "2 link(s)", "medium")] + [(f"h{k}.net", body.index(b"http://h%d" % k), "1 link(s)", "medium") for k in range(4)]


def test_six_scanners(spark):
    files = [("a.png", "image/png", "id", R.png_bytes(np.zeros((1, 1, 3), np.uint8))), ("b.jpg", "image/jpeg", "id", b"\xff\xd8\xff no image"), ("c.PNG", "image/png", "id", b"\x89PNG\r\n\x1a\n broken"), ("d.gif", "image/gif", "id", b"GIF89a")]
    df = spark.createDataFrame([(k, *f) for k, f in enumerate(files)], "id int, file_name string, declared_type string, category string, content binary")
    got = {r["id"]: [r[f"in_{n}"] for n in ("DVWA-Low", "DVWA-Medium", "DVWA-High", "DVWA-Impossible", "BasicValidation")] for r in scan(df).collect()}
    assert got == {0: [True] * 5, 1: [True, True, True, False, True], 2: [True, True, True, False, True], 3: [True, False, False, False, False]}


def test_scan(spark):
    files = spark.createDataFrame([(k, *f[:4]) for k, f in enumerate(FILES)], "id int, file_name string, declared_type string, category string, content binary")
    got = {r["id"]: r for r in scan(files).collect()}
    assert [got[k]["reason_code"] for k in range(len(FILES))] == [f[4] for f in FILES]
    assert all((got[k]["decision"] == "accepted") == (f[4] == "") == (got[k]["content"] is not None) for k, f in enumerate(FILES))
    assert (R.png_pixels(bytes(got[12]["content"])) == 6).all()


def test_upload_stream(spark, tmp_path):
    from sievework.sources.sinks import as_json, stored, write_csv
    from sievework.streaming.uploads import verdicts

    for name, content in (("id/x.pdf", b"%PDF /Launch"), ("ID /y.pdf", b"%PDF fine"), ("profile/z.pdf", b"%PDF fine"), ("other/w.pdf", b"%PDF fine"), ("id/empty.pdf", b"")):
        path = tmp_path / "root" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    verdicts(spark, str(tmp_path / "root"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    done = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r["id"].split("/")[-1], r["category"], r["reason_code"]) for r in done.collect()) == [("x.pdf", "id", "yara-rule"), ("y.pdf", "id", ""), ("z.pdf", "profile", "UNCODED")]
    assert len(stored(done).first()["stored_name"]) == 36 and stored(done).first() == stored(done).first()
    assert '"accepted":true' in as_json(done.where("decision = 'accepted'")).first()["response"]
    write_csv(spark.createDataFrame([('a,"b"', "x\ny", None), ("  pad .png ", "'q'", "")], "file string, reason string, truth string").select("file", "truth", "reason").coalesce(1), str(tmp_path / "csv"))
    assert [x for f in (tmp_path / "csv").glob("*.csv") for x in f.read_text().split("\n") if x] == ["file,truth,reason", '"a,""b""",,"x y"', "  pad .png ,,'q'"]


def test_entry_has_sql_for_each_query():
    assert set(catalogue.oracle_sql()) == set(catalogue.queries()) and set(catalogue.queries()) <= set(__spark_entry__.queries())
