"""Top-k search, Jaccard join, packages, repeats and the pipeline: hard cases and brute force."""

import base64
import hashlib
import io
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanloom.llm import components, jaccard, substrings, topk, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, doc string, n int"


def frame(spark, texts, extra=()):
    rows = [(i, t, "en", "s", len(t or ""), "clash", 1) for i, t in texts]
    return spark.createDataFrame([*rows, *extra], DOCS).repartition(4)


def test_topk_against_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 8))
    rows = [(int(i), [float(x) for x in centres[i % 6] + 0.05 * rng.normal(size=8)], i % 2) for i in range(500)]
    rows += [(int(i), [0.5] * 8, 0) for i in range(500, 620)]  # many equal vectors
    rows += [(620, None, 0), (621, [1.0, None] * 4, 0), (622, [float("nan")] * 8, 0), (623, [float("inf")] * 8, 0), (640, [2.0, 2.0], 0), (660, [], 0), (None, [1.0] * 8, 0)]
    got: dict = {}
    for r in topk.op1_topk(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    ok = {i: [int(np.floor(64 * float(np.float32(x)))) for x in v] for i, v, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    for q in [i for i in ok if i % 20 == 0]:
        scores = sorted((-sum(a * b for a, b in zip(ok[q], v)), i) for i, v in ok.items() if i != q)[:20]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(scores)]
    assert set(got) == {i for i in ok if i % 20 == 0}


def test_topk_scores_beyond_a_long(spark):
    rows = [(0, [3e9, 3e9]), (1, [3e9, 3e9]), (2, [1.0, 1.0]), (20, [-3e9, 0.0]), (40, [1e300, 1.0])]
    got: dict = {}
    for r in topk.op1_topk(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    most = 2**63 - 1
    v = {i: [min(max(int(np.floor(64 * x)), -(2**63)), most) for x in xs] for i, xs in rows}
    for q in (0, 20, 40):
        scores = sorted((-min(max(sum(a * b for a, b in zip(v[q], x)), -(2**63)), most), i) for i, x in v.items() if i != q)
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(scores)]


def test_topk_with_repeated_and_null_ids(spark):
    rows = [(20, [1.0, 1.0])] * 30 + [(i, [1.0, 1.0]) for i in range(21, 30)] + [(31, [0.5, 0.5])] * 30 + [(None, [1.0, 1.0])] * 30
    got = topk.op1_topk(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)).collect()
    score = 2 * 64 * 64
    want = [(20, k + 1, i, score) for k, i in enumerate(range(21, 30))] + [(20, k, 31, score // 2) for k in range(10, 21)]
    assert sorted(tuple(r) for r in got) == want


def test_topk_few_and_none(spark):
    one = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.5, -1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk.op1_topk(one).collect()] == [(0, 1, 1, 64 * 32 - 128 * 64)]
    assert topk.op1_topk(one.where("vec_id < 0")).count() == 0


def _sets(texts):
    out = {}
    for i, t in texts:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        out[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    return out


def _components(sets, percent=80):
    par = {i: i for i in sets}

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both) and find(a) != find(b):
                x, y = find(a), find(b)
                par[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def near_texts(seed, n=160):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(40))
    bases = [[rng.choice(vocabulary) for _ in range(rng.randint(5, 120))] for _ in range(12)]
    texts = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.6:
            t = [w if rng.random() > rng.choice([0, 0.01, 0.02, 0.04]) else rng.choice(vocabulary) for w in rng.choice(bases)]
            texts.append((i, " ".join(t)))
        elif kind < 0.8:  # a passage that many share
            texts.append((i, passage + " " + " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 20)))))
        elif kind < 0.9:
            texts.append((i, " ".join(rng.choice("ABab") for _ in range(rng.randint(0, 6)))))
        else:
            texts.append((i, rng.choice([None, "", "  \n ", " ".join(rng.choice(vocabulary) for _ in range(3000))])))
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_components_are_exact(spark, seed):
    texts = near_texts(seed)
    sets = _sets(texts)
    want = _components(sets)
    got = {r["doc_id"]: r for r in jaccard.op7_jaccard(frame(spark, texts)).collect()}
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == {i: (len(sets[i]), want[i]) for i in sets}


def test_jaccard_small_cells_and_odd_rows(spark):
    texts = near_texts(3, 90)
    extra = [(texts[0][0], texts[0][1], None, None, None, None, None), (None, "a b c d e f", None, None, None, None, None)]
    out = jaccard.jaccard_join(frame(spark, texts, extra), cell=4)
    got = {r["doc_id"]: r["component_id"] for r in out.collect()}
    want = _components(_sets(texts))
    assert {i: c for i, c in got.items() if i is not None} == want and got[None] is None
    assert jaccard.op7_jaccard(frame(spark, [])).count() == 0


def test_bitmaps_never_rule_out_a_link():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a = np.unique(rng.integers(0, 1 << 62, rng.integers(1, 300)).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > 0.1], rng.integers(0, 1 << 62, rng.integers(0, 20)).astype(np.uint64)]))
        if not len(b):
            continue
        x, y = (np.frombuffer(jaccard.bitmap(s), np.uint64)[None, :] for s in (a, b))
        while x.shape[1] > y.shape[1]:
            x = jaccard.folded(x)
        while y.shape[1] > x.shape[1]:
            y = jaccard.folded(y)
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_components_of_long_chains(spark):
    ids = list(range(10_000))
    random.Random(5).shuffle(ids)
    links = [*zip(ids, ids[1:]), *((20_000 + i, 20_001 + i) for i in range(2_000)), *((50_000, 50_001 + i) for i in range(3_000))]
    got = components.connected_components(spark.createDataFrame(links, "u long, v long")).groupBy("component").count().collect()
    assert {tuple(r) for r in got} == {(0, 10_000), (20_000, 2_001), (50_000, 3_001)}


@pytest.mark.parametrize("cell", [3, 8])
def test_recursive_cells_lose_no_pair(spark, cell):
    """Regions of several clusters: whatever is cut by pivots, every pair within the threshold stays a candidate."""
    rng = np.random.default_rng(cell)
    rows, sets = [], {}
    for region in range(3):
        centres = [rng.integers(0, 1 << 62, rng.integers(20, 200)).astype(np.uint64) for _ in range(6)]
        for k in range(40):
            c = centres[rng.integers(0, 6)]
            s = np.unique(np.concatenate([c[rng.random(len(c)) > rng.choice([0.0, 0.05, 0.15])], rng.integers(0, 1 << 62, 3).astype(np.uint64)]))
            sets[(region, d := 100 * region + k)] = s
            rows.append((region, d, len(s), d, bytearray(jaccard.region_bitmap(s)), 40))
    df = spark.createDataFrame(rows, "region long, doc long, n int, component long, bits binary, m long")
    got = {tuple(r) for r in jaccard.candidates(df, 80, cell).collect()}
    want = {
        (a[1], b[1])
        for a, x in sets.items()
        for b, y in sets.items()
        if a[0] == b[0] and a[1] < b[1] and 100 * (k := len(np.intersect1d(x, y))) >= 80 * (len(x) + len(y) - k)
    }
    assert want and want <= got
    cut = jaccard.parted(df.selectExpr("*", "true as core"), 80, 0, cell).where("cut").count()
    assert cut > 0


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = dict(tuple(r) for r in components.connected_components(spark.createDataFrame(links, "u long, v long")).collect())
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def _repeats(texts, width=50):
    first, out = {}, {}
    data = sorted((i, (t or "").encode()) for i, t in texts)
    for i, b in data:
        covered = bytearray(len(b))
        for s in range(len(b) - width + 1):
            d = first.setdefault(b[s : s + width], i)
            if d < i:
                covered[s : s + width] = b"\1" * width
        kept = bytes(x for x, c in zip(b, covered) if not c)
        spans = sum(1 for k in range(len(b)) if covered[k] and (k == 0 or not covered[k - 1]))
        out[i] = (len(b), sum(covered), spans, hashlib.sha256(kept).hexdigest())
    return out


def repeat_texts(seed, n=120):
    rng = random.Random(seed)
    base = "".join(rng.choice("abcdefgh ij") for _ in range(400))
    out = []
    for i in range(n):
        k = rng.random()
        if k < 0.2:
            t = "=" * rng.randint(40, 130) + rng.choice(["x", "yy", ""]) + "ab" * rng.randint(0, 60)
        elif k < 0.6:
            a = rng.randint(0, 300)
            t = "".join(rng.choice("klmnop") for _ in range(rng.randint(0, 60))) + base[a : a + rng.randint(40, 110)] + "".join(rng.choice("qrst") for _ in range(rng.randint(0, 60)))
        elif k < 0.75:
            t = rng.choice([base, None, "", base + base])
        else:
            t = "é" * rng.randint(10, 80) + "abc" * rng.randint(5, 50)
        out.append((3 * i, t))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_repeats_against_brute_force(spark, seed):
    texts = repeat_texts(seed)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substrings.op9_repeats(frame(spark, texts)).collect()}
    assert got == _repeats(texts)


def test_repeats_levels_pieces_and_odd_rows(spark, monkeypatch):
    texts = repeat_texts(7, 80)
    extra = [(texts[5][0], texts[5][1], None, None, None, None, None), (None, "n" * 80, None, None, None, None, None)]
    rows = substrings.remove_repeats(frame(spark, texts, extra), chunk_bytes=500, batch_rows=40).collect()
    want = _repeats(texts)
    for r in rows:
        if r["doc_id"] is None:
            assert r["spans"] == [] and len(r["kept"]) == 80
        else:
            assert hashlib.sha256(r["kept"]).hexdigest() == want[r["doc_id"]][3]
    assert len(rows) == 82 and substrings.op9_repeats(frame(spark, [])).count() == 0
    data = bytes(random.Random(1).choices(range(97, 101), k=3000))
    whole = substrings.entries(data, 50)
    monkeypatch.setattr(substrings, "PIECE", 700)
    cut = substrings.entries(data, 50)
    covered = [sorted(x for f, l in zip(e[5], e[6]) for x in range(f, l + 1)) for e in (whole, cut)]
    assert covered[0] == covered[1] == list(range(len(data) - 49))


PAGES = "page_id long, url string, html string, payload string"


def test_warc_round_trip(spark, tmp_path):
    htmls = [(i, f"http://x.example/{i} é", rng) for i, rng in enumerate(["<p>a</p>", "<p>é</p>", "<p>a</p>", None, "", "x" * 300_000, "<p>a</p>", "\r\n\r\nbody"])]
    rows = [(i, u, h, "clash") for i, u, h in htmls] + [(None, None, "<p>a</p>", None), (0, None, "<p>a</p>", None)]
    out = warc.op8_warc(spark.createDataFrame(rows, PAGES).repartition(3)).collect()
    assert len(out) == len(rows)
    first: dict = {}
    for i, _, h, _ in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    by = {i: h or "" for i, _, h, _ in rows}
    for r in out:
        p = (by[r["page_id"]] if r["page_id"] is not None else "<p>a</p>").encode()
        again = r["page_id"] is not None and first[p.decode()] != r["page_id"]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(p), base64.b32encode(hashlib.sha1(p).digest()).decode())
        assert (r["record_type"], r["refers_to"]) == (("revisit", first[p.decode()]) if again else ("response", None))
    assert warc.op8_warc(spark.createDataFrame([], PAGES)).count() == 0


def test_packages_keep_payloads_and_split(spark, tmp_path):
    rows = [(i, f"u{i}", f"page {i} " * 50, "") for i in range(40)]
    made = warc.write_packages(spark.createDataFrame(rows, PAGES), str(tmp_path), package_bytes=400)
    assert made.count() > 5
    got = {r["page_id"]: (r["url"], r["payload"]) for r in warc.read_packages(made, str(tmp_path), range_bytes=300).collect()}
    assert got == {i: (u, h.encode()) for i, u, h, _ in rows}


def test_zip_directories():
    members = [(f"m{i}", bytes([i]) * i) for i in range(5)]
    for large in (False, True):
        p = warc.Package(io.BytesIO(warc.pack(members, zip64=large)))
        assert {n: p.read(*at) for n, at in p.members.items()} == dict(members)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for i in range(66_000):  # more members than the short end record can count
            z.writestr(zipfile.ZipInfo(f"{i}"), b"x")
        z.comment = b"PK\x05\x06 a comment that looks like an end record"
    p = warc.Package(out)
    assert len(p.members) == 66_000 and p.read(*p.members["65999"]) == b"x"
    with pytest.raises(ValueError):
        warc.Package(io.BytesIO(b"no zip"))
    with pytest.raises(ValueError):
        warc.Package(io.BytesIO(warc.pack(members)[:-4]))
    with pytest.raises(ValueError):
        warc.parse_record(warc.record(1, "u", b"payload", None).replace(b"payload\r\n", b"paYload\r\n"))


def test_pipeline_on_a_fixture(spark, tmp_path):
    import corpus_pipeline

    texts = [(i, t) for i, t in near_texts(5, 60)] + [(100, "short text"), (101, "call a.b@host.example now please, this text has more than ten words in it")]
    frame(spark, texts).drop("doc", "n").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(101, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, before, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert k == 4 or docs.columns == columns
        if name == "quality":
            assert {r["doc_id"] for r in docs.collect()} & {100} == set() and docs.where("doc_id = 101").count() == 1
        if name == "near_duplicates":
            sets = _sets([(r["doc_id"], r["text"]) for r in before.collect()])
            assert {r["doc_id"] for r in docs.collect()} == {i for i, c in _components(sets).items() if c == i}
        if name == "pii":
            assert docs.count() == before.count() and "a.b@host" not in docs.where("doc_id = 101").first()["text"]
            assert docs.where(F.col("n_chars") != F.length("text")).count() == 0
    assert docs.count() > 0 and "n_tokens" in docs.columns
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    """Null and repeated ids, equal rows, null, empty, blank and very long texts, a column with a clashing name, and no rows at all."""
    import corpus_pipeline

    rng = random.Random(12)
    words = [f"w{i}" for i in range(300)]
    text = " ".join(rng.choice(words) for _ in range(60))
    rows = [(1, text), (1, text), (1, text + " other"), (2, text + " end"), (3, None), (4, ""), (5, " \n\t"), (None, text), (None, text), (None, None), (6, "x" * 300_000), (7, " ".join(rng.choice(words) for _ in range(40_000)))]
    kind = "doc_id long, text string, source string, n_chars long, size string, label int, component_id long"
    docs = spark.createDataFrame([(i, t, "s", len(t or ""), "clash", 1, 9) for i, t in rows], kind)
    spark.createDataFrame([(1, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, docs.limit(0), str(tmp_path))
        assert none.count() == 0 and (name == "bpe" or none.columns == docs.columns)
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality"](spark, docs, str(tmp_path))
    assert kept.where("text is null or length(text) < 10").count() == 0 and kept.where("doc_id is null").count() == 2
    left = stages["near_duplicates"](spark, docs, str(tmp_path))
    ids = sorted((r["doc_id"] for r in left.collect()), key=lambda i: (i is None, i))
    # One of the two equal rows of document 1 and its other text; 2 is its near copy; of the rows without id the equal ones are one.
    assert ids == [1, 1, 3, 4, 5, 6, 7, None, None] and left.columns == docs.columns
    assert stages["pii"](spark, docs, str(tmp_path)).count() == len(rows)
    mixed = stages["mixing"](spark, docs, str(tmp_path))
    assert mixed.columns == docs.columns and mixed.where("text is null or trim(text) = ''").count() == 0
    size = sum(len((t or "").split()) for _, t in rows)
    assert abs(sum(len(r["text"].split()) for r in mixed.collect()) - size) <= 40
    assert stages["bpe"](spark, docs, str(tmp_path)).where("n_tokens >= 0").count() == len(rows)


def test_repeats_send_packed_entries(spark):
    """Entries go to their tasks as compressed parts, not as rows of 48 bytes: under 22 bytes an entry; and what one task holds is a part, in order of the documents."""
    rng = random.Random(9)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(4000)) for _ in range(60)]
    rows = substrings._entries_of(frame(spark, list(enumerate(texts))).coalesce(1), 50, 16 << 20, 8).where("w is not null").collect()
    n = sum(len(r["w"]) for r in rows) // 16
    assert n > 10_000 and sum(len(r["w"]) + len(r["rest"]) for r in rows) < 22 * n and {r["part"] for r in rows} == set(range(8))


def test_repeats_ask_few_windows(spark):
    """Texts that share a common key beside different bytes: sides are told apart by more than 8 bits."""
    key = "the same sixteen"
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(40))
    family = substrings.Family(50)
    e = [substrings.entries((word() + key + word()).encode(), 50) for _ in range(3000)]
    key_, content, left, right, place, first, last = (np.concatenate([x[i] for x in e]) for i in range(7))
    a, b = substrings.packed(key_, content, left, right, place - first, last - first)
    doc = np.repeat(np.arange(3000), [len(x[0]) for x in e])
    asked = sum(len(f[0]) for f in family.add(a, b, doc, first) if f[3] == substrings.ASK)
    assert asked < 300
