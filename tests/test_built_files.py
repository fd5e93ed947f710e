"""Files built from texts: what the rules find in them is what the texts say, and nothing by chance."""

import random
import zlib

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from sievework.functions.tables import SCHEMES
from sievework.operators.rewriting import inflate_pdf
from sievework.plans import bytes_queries as B
from sievework.plans.scan import scan


def letters(seed, n):
    return "".join(random.Random(seed).choices("abcdefghijklmnopqrstuvwxyz ", k=n))


def tables(folder, texts):
    pq.write_table(pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())}), folder / "documents.parquet")
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{folder}/documents.parquet'")
    return str(folder), duck


def equal(spark, folder, duck, name):
    got = B.QUERIES[name](spark, folder)
    want = duck.execute(B.SQL[name])
    order = [[d[0] for d in want.description].index(c) for c in got.columns]
    return sorted(map(tuple, got.collect()), key=repr) == sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=repr)


def test_deflated_pdfs_say_nothing_by_chance(spark, tmp_path):
    texts = [letters(453, 20001), letters(1064, 20000), "", None, "x"]
    assert b"/EF" in zlib.compress(zlib.compress(B._TRIGGER + texts[0].encode())) and b"/EF" in zlib.compress(texts[1].encode())
    assert equal(spark, *tables(tmp_path, texts), "agg_ablation_inflated")
    assert not B._says(B._pdf(b"/EF <?= !DDE " * 500 + random.Random(1).randbytes(70_001)))


@pytest.mark.parametrize("name", ["l5b_pdf_flate", "pdf_survey", "agg_ablation_inflated", "scan_built"])
def test_pdfs_of_empty_and_of_repeating_texts(spark, tmp_path, name):
    texts = ["", None, "x", "Aterth " * 20_001, "a" * 133_719, "a" * 133_720, ("b" * 70 + "\n") * 3001]
    assert equal(spark, *tables(tmp_path, texts), name)


@pytest.mark.parametrize("unit", ["a", "ab ", "La ", "Teieö ", "a word. " * 9 + "\n"])
def test_built_pdfs_are_no_bombs(unit):
    for n in (1001, 50_001, 200_003, 1_000_001):
        text = (unit * n).encode()[:n]
        inflated, streams, opened, depth, cut, bomb = inflate_pdf(B._pdf(text))[:6]
        assert inflated.endswith(text + b"\n") and (streams, opened, depth, cut, bomb) == (1, 1, 2, False, False) and not B._says(B._pdf(text))


def test_built_pdfs_say_no_scheme_by_chance(spark):
    noise = random.Random(7).randbytes(4000)  # is stored as it is
    texts = [noise[:3000] + f" {s}{blank}:".encode() + noise[3000:] for s in SCHEMES for blank in ("", " ")]
    texts = [t + b"." * (len(t) % 3 == 0) for t in texts]  # without the trigger
    assert all(t[3000:3006] in zlib.compress(t) for t in texts)
    files = [(str(k), "a.pdf", "application/pdf", "id", B._pdf(t)) for k, t in enumerate(texts)]
    got = scan(spark.createDataFrame(files, "id string, file_name string, declared_type string, category string, content binary"), detail=False)
    assert {(r["decision"], r["reason_code"]) for r in got.collect()} == {("accepted", "")}
    assert all(inflate_pdf(f[-1])[0] == t + b"\n" for f, t in zip(files, texts, strict=True))


def test_scan_of_built_files(spark, tmp_path):
    texts = [letters(1190, 20000), letters(453, 20001), "", None, "one line\nand another"]
    assert b"/EF" in B.png_bytes(B.np.frombuffer(texts[0].encode().ljust(20016, b"\0"), B.np.uint8).reshape(-1, 16, 3))
    assert equal(spark, *tables(tmp_path, texts), "scan_built")


@pytest.mark.parametrize("size", [0, 1, 47, 48, 49, 16_385, 50_001])
def test_built_images_keep_their_pixels(size):
    data = random.Random(size).randbytes(size)
    file = B._png(data)
    assert B.png_pixels(file).tobytes()[:size] == data and not B._says(file[: len(file) - size % 5])
    for last in range(3):
        pixels = B.png_pixels(file)
        assert (B.png_pixels(B.png_bytes(pixels, last=last)) == pixels).all()
