"""The pipeline's stages take effect, and every operator has its query."""

import collections
import re

import corpus_pipeline
import __spark_entry__
from sievework.llm import registry

DATA = "/root/testdata/sf0.001"


def test_names():
    names = registry.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert set(names) | {"pipeline"} <= set(__spark_entry__.queries()) and set(registry.oracle_sql()) <= set(names)


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").selectExpr("*", "1 as kept", "2 as gone", "3 as n_dropped")
    docs = docs.union(docs.limit(1).selectExpr("null", "null", "lang", "source", "n_chars", "kept", "gone", "n_dropped"))
    sizes = [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] == sizes[2] > sizes[3] > sizes[4] > 0
    assert docs.select("doc_id").distinct().count() == sizes[4]
    assert docs.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0


def test_stages_on_nothing(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, DATA).count() == 0


def keys_of(text):
    return [re.sub(r"^[\x20\t-\r]+|[\x20\t-\r]+$", "", x).translate({c: c + 32 for c in range(65, 91)}) for x in text.split("\n")]


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_stages_against_brute_force(spark, tmp_path):
    """Line dedup, near dedup and decontamination on a small table with copies, repeated rows, ties, nulls and a very long text, each held against plain Python on its own input; the classifier's verdict depends on the text alone; packing keeps every id."""
    from tests.llm.test_operators import contaminated_by, prose

    line, passage = "A line that many documents hold", prose(30)
    base = prose(90)
    texts = [base, base, base + " more", prose(50) + "\n" + line, line + "\n" + prose(60), prose(40) + "\n  " + line.upper() + "\n" + prose(10), passage + " " + prose(50), prose(30) + " " + passage, "", None, prose(40_000), prose(70)]
    rows = [(k, t, "en", "s", k, "x") for k, t in enumerate(texts)] + [(11, texts[11], "en", "s", 0, "x"), (None, texts[7], "de", "s", 0, "x"), (None, None, "de", "s", 0, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, _id string")
    docs = docs.repartition(3).cache()
    items = [(1, passage), (2, "word for word?")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    stage = {n: f for n, f in corpus_pipeline.STAGES}
    by_text = collections.defaultdict(set)
    kept = stage["quality classifier"](spark, docs, str(tmp_path))
    left = collections.Counter(r["text"] for r in kept.collect())
    for r in docs.collect():
        by_text[r["text"]].add(left[r["text"]])
    assert kept.columns == docs.columns and all(left[t] in (0, n) for t, n in collections.Counter(t for _, t, *_ in rows).items())

    held = collections.defaultdict(set)
    for i, t, *_ in rows:
        for k in keys_of(t or ""):
            if len(k) >= 20 and i is not None:
                held[k].add(i)
    gone = lambda k, i: len(held.get(k, ())) >= 3 and max(held[k]) != i
    want = [(i, "\n".join(x for x, k in zip((t or "").split("\n"), keys_of(t or ""), strict=True) if not gone(k, i))) for i, t, *_ in rows]
    out = stage["line dedup"](spark, docs, str(tmp_path))
    assert sorted(map(repr, want)) == sorted(repr((r["doc_id"], r["text"])) for r in out.collect()) and {r["_id"] for r in out.collect()} == {"x"}

    sets = {i: shingles(t) for i, t, *_ in rows if i is not None}
    near = {i for i in sets for j in sets if j < i and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}  # no chains here
    out = stage["near dedup"](spark, docs, str(tmp_path))
    assert collections.Counter(repr(r["doc_id"]) for r in out.collect()) == collections.Counter(repr(i) for i, *_ in rows if i not in near) and out.columns == docs.columns

    short = [t if len(t or "") < 3000 else None for _, t, *_ in rows]
    dirty = [bool(x) for x in contaminated_by(items, short)]
    out = stage["decontamination"](spark, docs, str(tmp_path))
    assert collections.Counter(repr(r["doc_id"]) for r in out.collect()) == collections.Counter(repr(i) for (i, *_), d in zip(rows, dirty, strict=True) if not d)
    packed = stage["packing"](spark, docs, str(tmp_path)).collect()
    assert sum(r["start"] == 0 for r in packed) == len(rows)
