"""Each operator against brute force on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievework.llm import chat, classifier, decontaminate, line_dedup, lm_score, near_dedup, packing, quality_rules, textscan, token_counts, tokens, warc
from sievework.llm.common import Scratch
from sievework.llm.components import components

RNG = np.random.default_rng(7)
VOCABULARY = ["".join(RNG.choice(list("abcdefghijklmnop"), 4)) for _ in range(400)]
LINE = "This Line is in many documents"


def prose(n):
    return " ".join(RNG.choice(VOCABULARY, n))


BASE = prose(120)
TEXTS = [
    None, "", "  \n\t ", "one", "One two THREE", "one two three", BASE, BASE.upper(), BASE + " more words here", BASE.replace(VOCABULARY[0], "x") + " tail",
    " ".join(BASE.split()[:60]) + " " + prose(60), f"{LINE}\n{prose(30)}\n  {LINE.lower()} ", f"{LINE}\n", f"a\n{LINE}\nb", "naïve café x — 中文 don't 12 '''s", prose(30_000), prose(5) + "\n" + prose(5), "w " * 100,
]
ROWS = [(i if i != 9 else None, t, "en" if i % 3 else None, i) for i, t in enumerate(TEXTS)] + [(6, BASE, "en", 0)] + [(100 + i, BASE.replace(BASE.split()[i], "zz"), "de", i) for i in range(40)]
SCHEMA = "doc_id long, text string, lang string, n_lines long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return (t or "").encode().lower().split()


def shingle_set(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_components(spark):
    links = [(i, i + 1) for i in range(20)] + [(100, 50), (50, 70), (30, 31), (31, 30)]
    got = {r[0]: r[1] for r in components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "t"), "c").collect()}
    assert got == {**dict.fromkeys(range(1, 21), 0), 100: 50, 70: 50, 31: 30}


def test_near_duplicates(docs, none):
    rows = near_dedup.near_duplicates(docs).collect()
    sets = collections.defaultdict(set)
    for i, t, *_ in ROWS:
        if i is not None:
            sets[i] |= shingle_set(t)
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            common = len(sets[a] & sets[b])
            if a < b and common and 100 * common >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    assert len(rows) == len(ROWS)
    for r in rows:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), root(r["doc_id"]), root(r["doc_id"]) == r["doc_id"])
    assert near_dedup.near_duplicates(none).count() == 0


def test_near_duplicates_among_near_misses(spark):
    """600 texts of similarity 0.70 by one common passage, so that they share their buckets; of these, 60 have one partner of similarity 0.77."""
    own = np.random.default_rng(11)
    words = lambda n: " ".join("".join(own.choice(list("abcdefghijklmnop"), 7)) for _ in range(n))
    passage, texts = words(104), []
    for k in range(600):
        near = " ".join(texts[k - 300].split()[104:109]) if 300 <= k < 330 else words(5)
        texts.append(f"{passage} {near} {words(12)}")
    sets = [shingle_set(t) for t in texts]
    links = {(a, b) for a in range(600) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert links == {(k + 300, k) for k in range(30)}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {(r["doc_id"], r["component_id"]) for r in near_dedup.near_duplicates(df).where("not kept").collect()} == links


def test_texts_of_one_id_go_together(spark):
    rows = [(3, prose(40)), (7, prose(40)), (9, prose(3)), (9, prose(50)), (7, None)]
    rows += [(7, rows[0][1]), (11, rows[3][1] + " more")]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got) == [(3, 36, 3, True), (7, 0, 7, True), (7, 36, 3, False), (7, 36, 3, False), (9, 1, 9, True), (9, 46, 9, True), (11, 47, 9, False)]


def test_registers_estimate():
    a = textscan.stream64(1, 3000)
    x, y = np.sort(a[:2000]), np.sort(a[500:2500])
    r = near_dedup.registers(np.concatenate([x, y, np.sort(a[:2500])]), np.array([0, 2000, 4000, 6500]))
    assert (np.maximum(r[0], r[1]) == r[2]).all()  # the union's registers are the maxima
    assert abs((r[0] == r[1]).mean() - 1500 / 2500) < 0.15


def line_truth():
    key = lambda s: re.sub(r"^[\x20\t-\r]+|[\x20\t-\r]+$", "", s).translate({c: c + 32 for c in range(65, 91)})
    held = collections.defaultdict(set)
    for i, t, *_ in ROWS:
        for s in (t or "").split("\n"):
            if len(key(s)) >= 20 and i is not None:
                held[key(s)].add(i)
    out = []
    for i, t, *_ in ROWS:
        lines = (t or "").split("\n")
        stay = [s for s in lines if not (len(held.get(key(s), ())) >= 3 and max(held[key(s)]) != i)]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("limit", "probes"), [(64 << 20, 1), (0, 5), (0, 1 << 20)])
def test_line_dedup(docs, none, limit, probes, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 2)
    docs = docs.withColumns({c: F.lit("x") for c in ("gone", "carried", "id", "row", "n_dropped")})
    got = line_dedup.dedup_lines(docs, carry=True, broadcast_bytes=limit, probes=probes)
    assert sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in got.collect()), key=repr) == line_truth()
    assert got.select("carried.n_lines").count() == len(ROWS)
    assert line_dedup.dedup_lines(none, broadcast_bytes=limit).count() == 0


def test_probes_deal_a_shard_as_often_as_they_fill(spark):
    """Copies of a shard follow its probes, not the documents."""
    rows = [(i, f"{LINE}\n{i:030d}") for i in range(300)]
    scratch = Scratch(spark, "t")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = line_dedup.dedup_lines(docs, scratch=scratch, broadcast_bytes=0, probes=100)
    assert out.agg(F.sum("n_dropped")).first()[0] == 299
    salts = spark.read.parquet(f"{scratch.root}/salts").collect()
    assert sum(r["salts"] for r in salts) == 6  # 600 probes


def test_perfect_hash():
    keys = textscan.stream64(5, 5000)
    h = line_dedup.PerfectHash.build(keys)
    assert sorted(h.slots(keys)) == list(range(5000)) and len(h.words) * 64 < 5000 * 6
    assert (line_dedup.PerfectHash.build(keys[:0]).slots(keys) == -1).all()


def test_keys_that_share_their_first_hash():
    """They are kept beside the perfect hash; counts decide, exactly at the bound."""
    import pandas as pd

    keys = [(5, 1, 3, 70), (5, 2, 2, 71), (5, 3, 900, 72), (7, 1, 2, 73), (-1, 9, 4, -74), (-1, -9, 3, 75)]
    made = line_dedup._build(pd.DataFrame(keys, columns=["a", "b", "n", "largest"]).assign(shard=3))
    shard = line_dedup.Shard(*(made[c][0] for c in line_dedup._ARRAYS))
    probes = [(a, b, i) for a, b, _, largest in [*keys, (5, 4, 9, 1), (8, 1, 9, 1)] for i in (largest, 1000)]
    a, b = (np.array(x, dtype=np.int64).view(np.uint64) for x in list(zip(*probes))[:2])
    known = {(a, b): (n, largest) for a, b, n, largest in keys}
    want = [known.get((a, b), (0, 0))[0] >= 3 and known[a, b][1] != i for a, b, i in probes]
    assert shard.repeated(a, b, np.array([i for *_, i in probes])).tolist() == want and len(shard.beside) == 3


def library(special=True):
    import tokenizers

    e = tokenizers.Tokenizer.from_file(tokens.default_path())
    e.encode_special_tokens = not special
    return e


def reference_ids(special=True):
    e = library(special)
    return [e.encode(t or "", add_special_tokens=False).ids for _, t, *_ in ROWS]


@pytest.mark.parametrize("special", [True, False])
def test_tokens_equal_the_library(special):
    pieces = ["a", "B", " ", "  ", "\n", "\t", "'s", "'", " don't", "é", "ñ", "×", "中", "\u00a0", "\u3000", "—", "12", "²", "!", "\x1c", "\x00", "😀", "<|endoftext|>"]
    texts = ["".join(RNG.choice(pieces, RNG.integers(0, 15))) for _ in range(3000)] + [None, "a <|endoftext|> b"]
    e = library(special)
    got = [ids[at[i] : at[i + 1]].tolist() for low, high, ids, at in tokens.encoded(pa.array(texts), 0, special=special) for i in range(high - low)]
    assert got == [e.encode(t or "", add_special_tokens=False).ids + [0] for t in texts]
    assert (50256 in got[-1]) == special


@pytest.mark.parametrize("block", [7, 1 << 16])
def test_token_counts(docs, none, block):
    got = token_counts.document_token_counts(docs, block=block)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(((r[0], len(x)) for r, x in zip(ROWS, reference_ids(False), strict=True)), key=repr)
    assert token_counts.document_token_counts(none).count() == 0


def test_scan_of_blocks(spark):
    data = [("f", k, np.array(x, "<u2").tobytes()) for k, x in enumerate([[1, 2], [3], [], [9, 9, 4], [5], [6, 9]])] + [("g", 0, np.array([7, 7], "<u2").tobytes()), ("g", 1, None)]
    got = token_counts.count_tokens(spark.createDataFrame(data, "file string, block long, data binary"), Scratch(spark, "t"), end=9)
    assert sorted(map(tuple, got.collect())) == [("f", 0, 3, True), ("f", 1, 0, True), ("f", 2, 3, True), ("g", 0, 2, False)]


def test_packing(docs, none):
    out = packing.pack(docs, capacity=64, with_ids=True).collect()
    whole = collections.Counter()
    for r, ids in zip(ROWS, reference_ids(), strict=True):
        n, ids, start = len(ids) + 1, [*ids, 0], 0
        for k, size in enumerate([n] if n <= 64 else [n % 64] * (n % 64 > 0) + [64] * (n // 64)):
            part = np.array(ids[start : start + size], "<u4").tobytes()
            whole[r[0], k, start, size, zlib.crc32(part), part] += 1
            start += size
    assert whole == collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], bytes(r["ids"])) for r in out)
    bins = collections.defaultdict(list)
    for r in out:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(none).count() == 0


def test_plan_matches_single_lengths():
    assert packing.Plan({690: 1, 700: 1}, 2048).sequences == 1
    assert packing.Plan({k: 1 for k in range(683, 1025)}, 2048).sequences == 171
    assert packing.Plan({690: 2, 700: 3, 800: 1}, 2048).sequences == 3


def least_sequences(sizes, capacity):
    """Of pieces above a third of the capacity: the best matching pairs the smallest with the largest that fits."""
    sizes, low, n = sorted(sizes), 0, 0
    for high in range(len(sizes) - 1, -1, -1):
        if high < low:
            break
        if low < high and sizes[low] + sizes[high] <= capacity:
            low += 1
        n += 1
    return n


def test_large_pieces_are_matched_best():
    for _ in range(300):
        sizes = RNG.integers(34, 101, RNG.integers(1, 30)).tolist()
        assert packing.Plan(dict(collections.Counter(sizes)), 100).sequences == least_sequences(sizes, 100)


def test_few_pieces_against_exhaustive_search():
    def least(sizes, bins):
        if not sizes:
            return len(bins)
        options = [least(sizes[1:], [*bins, 12 - sizes[0]])]
        for k, gap in enumerate(bins):
            if gap >= sizes[0] and gap not in bins[:k]:
                options.append(least(sizes[1:], [*bins[:k], gap - sizes[0], *bins[k + 1 :]]))
        return min(options)

    more = 0
    for _ in range(60):
        sizes = sorted(RNG.integers(1, 13, RNG.integers(1, 8)).tolist(), reverse=True)
        n, best = packing.Plan(dict(collections.Counter(sizes)), 12).sequences, least(sizes, [])
        assert best <= n <= best + 1
        more += n - best
    assert more <= 6


def best_fit_decreasing(sizes, capacity):
    gaps = []
    for n in sorted(sizes, reverse=True):
        fit = min((g for g in gaps if g >= n), default=None)
        if fit is None:
            gaps.append(capacity - n)
        else:
            gaps[gaps.index(fit)] = fit - n
    return len(gaps)


def test_no_more_sequences_than_best_fit_decreasing():
    for high in (35, 60, 101):
        sizes = RNG.integers(1, high, 800).tolist()
        assert packing.Plan(dict(collections.Counter(sizes)), 100).sequences <= best_fit_decreasing(sizes, 100) + 1


def test_plan():
    sizes = RNG.integers(1, 101, 3000)
    histogram = dict(zip(*(x.tolist() for x in np.unique(sizes, return_counts=True)), strict=True))
    plan = packing.Plan(histogram, 100)
    filled, placed = collections.Counter(), collections.Counter()
    for length, _, count, first, _ in plan.runs:
        placed[length] += count
        for b in range(first, first + count):
            filled[b] += length
    assert placed == collections.Counter(histogram) and max(filled.values()) <= 100
    assert plan.sequences <= 1.02 * max(math.ceil(sizes.sum() / 100), (sizes > 50).sum()) + 1


def test_quality_rules(spark, docs, none):
    seen = {(r["doc_id"], r["n_words"]): r for r in quality_rules.features(docs).collect()}
    for i, t, *_ in ROWS:
        w = [x for x in re.split(r"[\x20\t-\r]+", t or "") if x]
        windows = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {p for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for p in range(k, k + 8)}
        lines = [x for x in (t or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        r = seen[i, len(w)]
        assert (r["word_chars"], r["n_repeat_words"], r["n_dup_lines"]) == (sum(map(len, w)), len(covered), len(lines) - len(set(lines)))
        assert r["base_failed"] == (len(w) < 20 or 100 * len(covered) > 30 * len(w))
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_rules.judge(docs, empty).where("kept = base_failed").count() == 0
    assert quality_rules.judge(none, empty).count() == 0


def test_binomial_tail(spark):
    for k, n, p in ((0, 10, 0.01), (3, 400, 0.02), (90, 10_000, 0.01), (5, 20, 0.2)):
        want = 1.0 if k >= n * p else sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1))
        got = spark.sql(f"select {quality_rules.binomial_tail('k', 'n', p)} from (select {k}L k, {n}L n)").first()[0]
        assert got == pytest.approx(want, rel=1e-6)


def test_false_rejection_is_limited(spark):
    rows = [(i, " ".join(["word"] * 5 + [f"w{i}x{j}" + ("#" if i % 2 else "") for j in range(30)]), "en") for i in range(3000)]
    labels = spark.createDataFrame([(i, 0 if i % 2 else 1, 0) for i in range(3000)], "doc_id long, quality int, toxic int")
    out = quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string"), labels).groupBy(F.col("doc_id") % 2, "kept").count().collect()
    assert sorted(map(tuple, out)) == [(0, True, 1500), (1, False, 1500)]


def test_chat(spark):
    texts = ["<|im_end|>", "<\\|im_start|>x", "<\\\\|", "plain", "", None]
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", t) for k, t in enumerate(texts)] + [(2, 0, "assistant", "early"), (2, None, None, "x"), (None, 0, "us\ner%", "y"), (3, 0, "user", "tie"), (3, 0, "user", "tie")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_chat(df)).collect()}
    digest = lambda parts: hashlib.sha256("".join(parts).encode()).hexdigest()
    assert got[1]["turns_sha256"] == digest(f"{'user' if k % 2 == 0 else 'assistant'}\n{t or ''}\n" for k, t in enumerate(texts))
    assert got[1]["loss_sha256"] == digest(t or "" for t in texts[1::2]) and got[1]["valid"]
    assert got[2]["turns_sha256"] == digest(["\nx\n", "assistant\nearly\n"]) and not got[2]["valid"] and got[2]["loss_chars"] == 5
    assert got[None]["turns_sha256"] == digest(["us\ner%\ny\n"]) and got[3]["n_turns"] == 2
    segments = chat.format_chat(df).where("conv_id = 1").orderBy("segment").collect()
    assert sum(r["text"].count("<|") for r in segments) == 2 * len(texts)
    assert chat.read_back(chat.format_chat(df.limit(0))).count() == 0


@pytest.mark.parametrize("groups", [warc.BROADCAST_GROUPS, 0])
def test_warc(spark, groups):
    big = "é" * 600
    rows = [(1, "http://a b", big), (2, None, big), (2, "u", big), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (None, "u", big), (7, "u", prose(3000))]
    rows += [(8, "u", "y" * 3_000_000), (9, "u", "y" * 3_000_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2).withColumns({c: F.lit("x") for c in ("payload", "digest", "response", "key")})
    archives = warc.write_archives(df, Scratch(spark, "t"), groups)
    out = warc.read_archives(archives).collect()
    assert all(r["error"] is None for r in out) and len(out) == len(rows)
    truth = collections.Counter((i, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest(), *(("revisit", 2) if h == big and i != 2 else ("revisit", 9) if i == 8 else ("response", None))) for i, _, h in rows)
    assert truth == collections.Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in out)
    data = bytes(archives.first()["data"])
    broken = spark.createDataFrame([("cut", data[:-5]), ("junk", b"no gzip"), ("none", None)], "archive string, data binary")
    assert {r["archive"] for r in warc.read_archives(broken).where("error is not null").collect()} == {"cut", "junk"}
    assert warc.read_archives(warc.write_archives(df.limit(0), Scratch(spark, "t"))).count() == 0


def test_warc_files(spark, tmp_path):
    """One file an archive, read back record by record; the command-line tool's format of members one after the other."""
    import gzip

    rows = [(i, f"http://h{i}.example/", f"<p>{i}</p>" * (i % 7 * 100)) for i in range(200)]
    archives = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), Scratch(spark, "t"))
    at = warc.write_files(archives, str(tmp_path), "crawl-1")
    files = sorted((tmp_path / "crawl-1").iterdir())
    assert len(files) == archives.count() and all(f.name.endswith(".warc.gz") for f in files)
    assert sum(gzip.decompress(f.read_bytes()).count(b"WARC/1.1\r\n") for f in files) == 200
    key = lambda df: sorted(map(tuple, df.select("page_id", "record_type", "payload_digest", "refers_to", "error").collect()), key=repr)
    assert key(warc.read_archives(warc.archive_files(spark, at))) == key(warc.read_archives(archives))


def test_warc_digest_is_checked(spark):
    bad = zlib.decompress(warc.record(1, "u", b"payload", None), 31).replace(b"payload\r\n", b"pAyload\r\n")
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    data = press.compress(bad) + press.flush()
    assert warc.read_archives(spark.createDataFrame([("x", data)], "archive string, data binary")).first()["error"] == "block digest differs"


def distance(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        last, row = row, [i]
        for j, d in enumerate(text, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (c != d)))
    return min(row)


def contaminated_by(items, texts):
    """By brute force: for each text the ids of the items that it holds."""
    plain = lambda t: decontaminate.normalise(np.frombuffer((t or "").encode(), np.uint8))[0].tobytes()
    word = rb"[0-9a-z\x80-\xff]"

    def holds(item, text):
        if len(item) < decontaminate.SHORT_BYTES:
            edge = lambda c, before: b"" if not re.match(word, bytes([c])) else (rb"(?<!%s)" if before else rb"(?!%s)") % word
            return re.search(edge(item[0], True) + re.escape(item) + edge(item[-1], False), text) is not None
        return distance(item, text) <= len(item) // decontaminate.BYTES_PER_ERROR

    known = [(i, plain(t)) for i, t in items if plain(t)]
    return [{i for i, t in known if holds(t, plain(text))} for text in texts]


DIRTY = [(1, prose(20)), (2, "É" + prose(12)), (3, None), (4, "tiny"), (5, BASE[:150]), (6, " What is 2 + 2 * 7?"), (7, "Nile."), (8, ""), (9, "exactly twenty-one ok")]


@pytest.mark.parametrize("block_bytes", [1 << 20, 100])
def test_decontamination(spark, docs, none, monkeypatch, block_bytes):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block_bytes)
    edited = bytearray(DIRTY[0][1].encode())
    for at in range(5, 60, 12):
        edited[at] = ord("#")
    texts = [f"x {DIRTY[0][1].upper()} y", edited.decode(), DIRTY[1][1].lower().replace(" ", "\n "), prose(200), None, "", "so: what is\n2 + 2 * 7? 28", "what is 2 + 2 * 77?", "a senile. man", "the NILE. is", "tinys", "(Tiny)", "exactly twenty-one okay", "Exactly  twenty-one OK!"]
    long = prose(5000) + " " + DIRTY[4][1] + prose(5000)
    rows = [(500 + k, t, "en", k) for k, t in enumerate(texts)] + [(600, long, "en", 0), (500, texts[0], "de", 1)]
    extra = spark.createDataFrame(rows, SCHEMA).union(docs.where("length(text) < 3000 or text is null"))
    extra = extra.withColumns({c: F.lit("x") for c in ("found", "matches", "contaminated", "carried", "key_a")})
    bench = spark.createDataFrame(DIRTY, "item_id long, text string")
    out = decontaminate.decontaminate(extra, bench, carry=True).collect()
    assert len(out) == extra.count() and out[0]["carried"]["matches"] == "x"
    held = contaminated_by(DIRTY, [r["text"] for r in out if len(r["text"] or "") < 3000])
    for r, ids in zip((r for r in out if len(r["text"] or "") < 3000), held, strict=True):
        assert {m["item_id"] for m in r["matches"]} == ids and r["contaminated"] == bool(ids)
    assert {r["doc_id"] for r in out if r["contaminated"] and (r["doc_id"] or 0) >= 500} == {500, 501, 502, 506, 509, 511, 513, 600}
    assert all(r["text"].encode()[m["start"] : m["stop"]] for r in out for m in r["matches"])
    assert decontaminate.decontaminate(none, bench).count() == 0 and decontaminate.decontaminate(docs, bench.limit(0)).where("contaminated").count() == 0


def test_a_task_holds_one_block_of_items(spark, docs, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 200)
    held = []
    inner = decontaminate._items
    monkeypatch.setattr(decontaminate, "_items", lambda *a: held.append(inner(*a)) or held[-1])
    bench = spark.createDataFrame([(k, BASE[k * 60 : k * 60 + 100]) for k in range(6)], "item_id long, text string")
    out = decontaminate.decontaminate(docs, bench)
    assert {m["item_id"] for m in out.where("doc_id = 6").first()["matches"]} == set(range(6))
    assert len(held) > 2 and sum(map(len, held)) == 6
    assert "MapInArrow" not in out._jdf.queryExecution().executedPlan().toString()  # all blocks are done and written


def test_lm_counts_and_normalisation(docs, none):
    out = lm_score.score_documents(docs).collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    counts = collections.Counter(w for i, t, *_ in ROWS if not held(i) for w in [*words(t), None])
    n, v = sum(counts.values()), len(counts)
    truth = collections.Counter((i, held(i), len(words(t)) + 1, sum(counts[w] > 0 for w in [*words(t), None]), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in [*words(t), None]), 6)) for i, t, *_ in ROWS)
    assert truth == collections.Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out)
    assert all(r["score"] < 0 for r in out) and lm_score.score_documents(none).count() == 0
    model = lm_score.Model(np.full(lm_score.CLASSES, 1 / lm_score.CLASSES))
    context = np.zeros((lm_score.CLASSES, lm_score.CONTEXT), dtype=np.int64)
    assert (10 ** model.log10(context, np.arange(lm_score.CLASSES))).sum() == pytest.approx(1, abs=1e-4)


def test_lm_learns():
    rng = np.random.default_rng(1)
    chain = np.cumsum(rng.integers(1, 3, 40_000)) % 10  # the next is one or two further
    prior = np.full(lm_score.CLASSES, 1e-5)
    prior[:10] = 0.1
    prior /= prior.sum()
    model = lm_score.Model(prior)
    context = lm_score._contexts(chain, np.array([len(chain)]))
    square = {k: np.full_like(x, 1e-6) for k, x in model.p.items()}
    for low in range(0, 38_000, 256):
        model.step(context[low : low + 256], chain[low : low + 256], rng.choice(lm_score.CLASSES, lm_score.NOISE, p=prior), square)
    assert model.log10(context[39_000:], chain[39_000:]).mean() > -0.6  # -0.30 is the best, -1 the start


def test_estimation():
    rng = np.random.default_rng(2)
    truth = rng.random(20_000) < 0.2
    rates = np.array([[0.05, 0.9], [0.1, 0.6], [0.02, 0.7], [0.03, 0.95]])
    asked = np.where(rng.random((20_000, 4)) < rates[:, 0] + (rates[:, 1] - rates[:, 0]) * truth[:, None], classifier.BAD, classifier.GOOD)
    asked[rng.random(asked.shape) < 0.3] = classifier.NONE
    patterns, where, counts = np.unique(asked, axis=0, return_inverse=True, return_counts=True)
    posterior, found, prior = classifier.estimate(patterns, counts.astype(float), 3)
    assert abs(prior - 0.2) < 0.02 and np.abs(found - rates).max() < 0.06
    assert ((posterior[where] > 0.5) == truth).mean() > 0.95


def test_classifier(spark, none):
    def text(i):
        body = prose(60).split()
        if i % 5 == 1:
            body[10:10] = ["you", "stupid", "idiot", "worthless", "trash"]
        if i % 5 == 2:
            body = [w + "###" for w in body]
        return " ".join(body)

    rows = [(i, text(i)) for i in range(1000)] + [(None, None), (2000, ""), (2000, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 != 2), int(i % 5 == 1)) for i in range(0, 1000, 2)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    out = classifier.classify(df, labels).collect()
    assert len(out) == len(rows)
    odd = [r for r in out if r["doc_id"] is not None and r["doc_id"] < 1000 and r["doc_id"] % 2]  # held-out: without a label
    assert np.mean([r["kept"] == (r["doc_id"] % 5 not in (1, 2)) for r in odd]) > 0.98
    assert classifier.classify(none, labels.limit(0)).count() == 0


def test_measures_against_plain_python():
    texts = ["", " \n ", "one two", prose(30) + "\n" + prose(5) + "\n\n" + prose(5), "a # b # " * 20, ("x y z u v w " * 4) + "\nx\nx\n", "naïve café — 中文 " * 12, BASE + "\n" + BASE, prose(60_000)]
    got = [(shape[d], owners, features, d) for low, high, shape, owners, features in classifier.measures(pa.array(texts)) for d in range(high - low)]
    for text, (shape, owners, features, d) in zip(texts, got, strict=True):
        w = (text.encode().lower()).split()
        lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        five = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        n = max(1, len(w))
        want = [len(w), len(re.findall(r"[#*$%&|<>]", text)) / n, 1 - len(set(lines)) / max(1, len(lines)) if lines else 0, 1 - len(five) / (len(w) - 4) if len(w) >= 10 else 0, len(set(w)) / n, sum(len(x.decode()) for x in w) / n]
        assert shape == pytest.approx(want)
        bare = re.findall(rb"[0-9a-z\x80-\xff]+", text.encode().lower())
        known = {(k, x[:k] if k else x) for x in bare for k in (0, *classifier.STEMS) if not k or len(x) > k}
        own = features[:, owners == d]
        assert len(known) - 3 <= len(set(own[own >= 0].tolist())) <= len(known)  # hashes may meet


def test_posteriors_against_a_sum_over_documents():
    """The same estimate from documents one by one, in plain Python, as from counts of patterns."""
    rng = np.random.default_rng(4)
    votes = [[int(x) for x in rng.choice([0, 1, 2], 4, p=[0.6, 0.2, 0.2])] for _ in range(300)]
    patterns, where, counts = np.unique(np.array(votes), axis=0, return_inverse=True, return_counts=True)
    posterior, _, _ = classifier.estimate(patterns, counts.astype(float), 3, rounds=20)
    rates = [[0.1, 0.7] for _ in range(3)] + [[0.03, 0.97]]
    prior, own = 0.2, []
    for _ in range(20):
        own = []
        for v in votes:
            good, bad = 1 - prior, prior
            for (g, b), x in zip(rates, v, strict=True):
                good *= {0: 1 - g, 1: g, 2: 1}[x]
                bad *= {0: 1 - b, 1: b, 2: 1}[x]
            own.append(bad / (good + bad))
        for k in range(4):
            for y, start in ((0, 0.1), (1, 0.7)):
                weight = [p if y else 1 - p for p in own]
                said = [sum(w for w, v in zip(weight, votes, strict=True) if v[k] == x) for x in (0, 1)]
                rates[k][y] = min(max((said[1] + start) / (sum(said) + 1), 1e-4), 1 - 1e-4)
        prior = min(max(sum(own) / len(own), 1e-4), 0.9)
    assert posterior[where] == pytest.approx(own, abs=1e-6)


def test_scorer_against_plain_python():
    rng = np.random.default_rng(5)
    w = rng.normal(size=(9, 2))
    rows = [[0, 3, 7], [], [1]]
    flat, owner = np.concatenate([np.array(r, int) for r in rows] + [np.full(3, 8)]), np.array([0, 0, 0, 2, 0, 1, 2])
    want = [[1 / (1 + math.exp(-(sum(w[f, q] for f in r) + w[8, q]))) for q in (0, 1)] for r in rows]
    assert classifier.score(flat, owner, w, 3) == pytest.approx(np.array(want))


def test_language_model_against_plain_python():
    """The normalised log-probability of each class, summed out one by one."""
    rng = np.random.default_rng(6)
    model = lm_score.Model(rng.dirichlet(np.ones(lm_score.CLASSES)))
    context, target = rng.integers(0, lm_score.CLASSES + 1, (6, lm_score.CONTEXT)), rng.integers(0, lm_score.CLASSES, 6)
    for at, want in zip(range(6), model.log10(context, target), strict=True):
        h = [sum(model.p["r"][context[at, j], d] * model.p["c"][j, d] for j in range(lm_score.CONTEXT)) for d in range(lm_score.WIDTH)]
        scores = [sum(h[d] * model.p["q"][c, d] for d in range(lm_score.WIDTH)) + model.p["b"][c] for c in range(lm_score.CLASSES)]
        assert want == pytest.approx((scores[target[at]] - math.log(sum(map(math.exp, scores)))) / math.log(10), abs=1e-4)


def _language_model(seed, scale):
    rng = np.random.default_rng(seed)
    model = lm_score.Model(rng.dirichlet(np.ones(lm_score.CLASSES)))
    model.p["r"] *= scale
    model.p["q"] *= scale
    return rng, model


def test_scoring_takes_no_exponential_for_a_token(monkeypatch):
    rng, model = _language_model(7, 1)
    taken, exp = [], np.exp
    monkeypatch.setattr(np, "exp", lambda x, *a, **k: taken.append(np.size(x)) or exp(x, *a, **k))
    for n in (10, 5_000):
        taken.append(0)
        model.log10(rng.integers(0, lm_score.CLASSES + 1, (n, lm_score.CONTEXT)), rng.integers(0, lm_score.CLASSES, n))
    few, many = (sum(x) for x in (taken[: taken.index(0, 1)], taken[taken.index(0, 1) :]))
    assert few == many == lm_score.CONTEXT * (lm_score.CLASSES + 1) * lm_score.CLASSES


@pytest.mark.parametrize("scale", [1, 5, 30])  # at 30 float32 has no room for most products
def test_scores_of_strong_weights(scale):
    rng, model = _language_model(8, scale)
    context, target = rng.integers(0, lm_score.CLASSES + 1, (700, lm_score.CONTEXT)), rng.integers(0, lm_score.CLASSES, 700)
    score = sum((model.p["r"] * model.p["c"][j])[context[:, j]] for j in range(lm_score.CONTEXT)) @ model.p["q"].T + model.p["b"]
    top = score.max(1)
    want = (score[np.arange(700), target] - top - np.log(np.exp(score - top[:, None]).sum(1))) / np.log(10)
    assert model.log10(context, target) == pytest.approx(want, rel=1e-6, abs=1e-6)


def test_a_training_step_against_sums_token_by_token():
    rng, model = _language_model(9, 3)
    n, p = 40, {k: x.copy() for k, x in model.p.items()}
    context, target, noise = rng.integers(0, lm_score.CLASSES + 1, (n, lm_score.CONTEXT)), rng.integers(0, 9, n), rng.integers(0, 9, lm_score.NOISE)  # drawn many times
    context[:, 1] = context[0, 1]
    square = {k: np.full_like(x, 1e-6) for k, x in p.items()}
    model.step(context, target, noise, square)
    grad = {k: np.zeros_like(x) for k, x in p.items()}
    for t in range(n):
        h = sum(p["r"][context[t, j]] * p["c"][j] for j in range(lm_score.CONTEXT))
        dh = np.zeros_like(h)
        for k, own in [(target[t], True), *((x, False) for x in noise)]:
            odds = h @ p["q"][k] + p["b"][k] - np.log(lm_score.NOISE * model.prior[k])
            by = 1 / (1 + np.exp(odds)) if own else -1 / (1 + np.exp(-odds))
            dh += by * p["q"][k]
            grad["q"][k] += by * h
            grad["b"][k] += by
        for j in range(lm_score.CONTEXT):
            grad["r"][context[t, j]] += dh * p["c"][j]
            grad["c"][j] += dh * p["r"][context[t, j]]
    for k, x in p.items():
        assert square[k] == pytest.approx(1e-6 + (grad[k] / n) ** 2, rel=1e-3, abs=1e-9)
        assert model.p[k] == pytest.approx(x + lm_score.RATE * grad[k] / n / np.sqrt(1e-6 + (grad[k] / n) ** 2), abs=1e-3)


def test_rounds_share_the_contexts(monkeypatch):
    """Each training token's context is made in its own round only."""
    rng = np.random.default_rng(10)
    lengths = rng.integers(1, 60, 300)
    held = np.array([lm_score.held_out(i) for i in range(300)])
    hashes, suffix = np.sort(rng.integers(0, 1 << 62, 500).astype(np.uint64)), rng.integers(0, lm_score.SUFFIXES, 500).astype(np.uint8)
    codes = rng.integers(0, 500, lengths.sum()).astype(np.int32)
    lexicon = lm_score.Lexicon([], np.ones(lm_score.SUFFIXES, np.int64), np.ones(lm_score.SUFFIXES, np.int64))
    row = {"held": held.tobytes(), "lengths": lengths.astype(np.int32).tobytes(), "codes": lm_score.zstandard.ZstdCompressor().compress(codes.tobytes()), "hashes": hashes.tobytes(), "suffix": suffix.tobytes()}
    batch = pa.RecordBatch.from_pylist([row])
    made, contexts = [], lm_score._contexts
    monkeypatch.setattr(lm_score, "_contexts", lambda *a: made.append(contexts(*a)) or made[-1])
    monkeypatch.setattr(lm_score, "TaskContext", type("Task", (), {"get": classmethod(lambda cls: cls), "partitionId": staticmethod(lambda: 0)}))
    sent = type("Sent", (), {"value": (lexicon, lm_score.Model(lexicon.prior).flat())})
    used = [next(lm_score._train(iter([batch]), sent, turn)).column(0)[0].as_py() for turn in range(lm_score.ROUNDS)]
    training = int(lengths[~held].sum())
    assert sum(used) == training == sum(map(len, made)) and training > 3 * lm_score.BATCH
    classes = lexicon.of(hashes, suffix)[codes].tolist()
    ends = np.cumsum(lengths)
    every = [[classes[t - j - 1] if t - j - 1 >= low else lm_score.START for j in range(lm_score.CONTEXT)] for low, high in zip(ends - lengths, ends, strict=True) for t in range(low, high)]
    own = np.flatnonzero(~np.repeat(held, lengths))
    for turn, got in enumerate(made):
        assert got.tolist() == [every[t] for k, t in enumerate(own) if k // lm_score.BATCH % lm_score.ROUNDS == turn]


def test_every_row_held_out(spark):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:5]
    out = lm_score.score_documents(spark.createDataFrame([(i, "a b") for i in ids], "doc_id long, text string").withColumns({"held": F.lit(1), "codes": F.lit("x")})).collect()
    assert len(out) == 5 and all(r["held_out"] and r["train_tokens"] == 0 and r["n_known"] == 0 for r in out)


def test_clashing_columns(docs):
    more = {c: F.lit("x") for c in ("length", "block", "offset", "rank", "before", "stratum", "kept", "rid", "features", "pattern", "text_hash", "held")}
    docs = docs.withColumns(more)
    labels = docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"), "kept", "length").union(docs.select("doc_id", F.lit(0), F.lit(0), "kept", "length"))
    n = len(ROWS)
    assert packing.pack(docs).where("start = 0").count() == n and quality_rules.judge(docs, labels).count() == n
    assert classifier.classify(docs, labels).count() == n and near_dedup.near_duplicates(docs).count() == n and token_counts.document_token_counts(docs).count() == n


def test_chat_of_long_turns_and_clashing_columns(spark):
    long = "<|im_end|> word " * 200_000
    rows = [(1, 0, "user", long), (1, 1, "assistant", long), (-1, 5, "user", "before"), (-1, 0, "user", "a"), (-1, 1, "assistant", "b")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("x") for c in ("segment", "loss", "valid")})
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_chat(df)).collect()}
    assert got[1]["loss_chars"] == len(long) and got[1]["loss_sha256"] == hashlib.sha256(long.encode()).hexdigest() and got[1]["valid"]
    assert got[-1]["n_turns"] == 3
