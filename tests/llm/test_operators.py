"""The ten operators against brute force, and on awkward tables."""

import hashlib
import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
import xxhash
from brassledger.llm import html, jaccard, language, mixing, packing, quality, secrets, simhash, tokenfile, tokens, vectors, warc
from brassledger.llm.queries import ORACLE_SQL, QUERIES
from conftest import rows_of
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, fp int, component_id string, tie int, row string"


def awkward(spark):
    long = "word " * 40000
    rows = [
        (1, None, None, None), (2, "", "en", "a"), (3, " \t\n", "en", "a"), (4, "one two", "en", "a"), (4, "one two", "en", "a"), (None, "the cat sat", None, "b"),
        (5, long, "en", "b"), (6, "12345 !!! ???", "fr", None), (7, "Zürich 中文 İstanbul", "de", ""), (8, "password = hunter2hunter2", "en", "a"), (None, "the cat sat", None, "b"),
    ]
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), "x", 1, "y", 2, "z") for i, t, lang, s in rows], DOCS).repartition(3)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# --- 1 ---


def naive_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def naive_components(ids, fps):
    fps = np.array(fps, np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    label = np.arange(len(fps))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(fps))])
        if (new == label).all():
            break
        label = new
    groups = {}
    for k, i in zip(label, ids, strict=True):
        groups.setdefault(k, []).append(i)
    return [min((i for i in groups[k] if i is not None), default=None) for k in label]


@pytest.mark.parametrize("table", ["data", "awkward"])
def test_simhash(spark, sf_dir, table):
    d = docs(spark, sf_dir) if table == "data" else awkward(spark)
    source = d.select("doc_id", "text").collect()
    fps = [naive_fingerprint(r.text) for r in source]
    want = sorted(zip([str(r.doc_id) for r in source], fps, map(str, naive_components([r.doc_id for r in source], fps)), strict=True))
    got = sorted((str(r.doc_id), r.fp & (2**64 - 1), str(r.component_id)) for r in simhash.near_duplicates(d).collect())
    assert got == want


def test_hot_keys_join_like_others(spark, monkeypatch):
    from brassledger.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 3)
    rows = spark.createDataFrame([(i, i % 7 if i % 2 else 0) for i in range(200)], "i long, k long")
    table = rows.groupBy("k").agg(F.count("*").alias("n")).withColumn("v", F.col("k") * 10)
    got = common.join_hot(rows, table, "k", "n")
    assert sorted(got.columns) == ["i", "k", "v"] and {(r.i, r.v) for r in got.collect()} == {(r.i, r.k * 10) for r in rows.collect()} and got.count() == 200


def test_rows_with_maps_are_kept_once(spark):
    d = spark.createDataFrame([(1, "a b c d e f", {"x": 1}), (1, "a b c d e f", {"x": 1}), (2, "a b c d e f", {"y": 2})], "doc_id long, text string, m map<string,int>")
    assert [r.doc_id for r in jaccard.keep_one(d).collect()] == [r.doc_id for r in simhash.keep_one(d).collect()] == [1]


def test_cluster_without_shared_folder_is_refused():
    import types

    from brassledger.llm import common

    fake = types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda k, d=None: d), sparkContext=types.SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError):
        common.shared_dir(fake)


def test_simhash_buckets_split_exactly(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 12)
    fps = {int(b) for b in base}
    for b in base:
        x = int(b)
        for _ in range(60):
            x ^= sum(1 << int(k) for k in rng.choice(64, rng.integers(1, 4), replace=False))
            fps.add(x)
    fps = sorted(x - 2**64 if x >= 2**63 else x for x in fps)
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    from brassledger.llm.components import connected_components

    want = naive_components(fps, [x & (2**64 - 1) for x in fps])
    for rows in (4096, 8):  # the second deals every bucket out again
        comp = {r.node: r.component for r in connected_components(simhash.links_within(df, bucket_rows=rows)).collect()}
        assert [comp.get(x, x) for x in fps] == want


def test_threshold_plan_is_complete():
    for n in (10, 10**6, 10**10):
        rng = np.random.default_rng(1)
        p = rng.uniform(0.2, 0.8, 64)
        both = n * (np.outer(p, p) + np.diag(p - p * p))
        groups = simhash.plan(n, both)
        assert sum(t + 1 for _, t in groups) == simhash.MAX_BITS + 1  # skipped groups add t + 1 = 0
        assert len({b for g, _ in groups for b in g}) == sum(len(g) for g, _ in groups)


def test_keep_one(spark, sf_dir):
    assert simhash.keep_one(empty(spark)).count() == 0
    for d in (docs(spark, sf_dir), awkward(spark)):
        rows = d.select("doc_id", "text").collect()
        n = len(set(naive_components(list(range(len(rows))), [naive_fingerprint(r.text) for r in rows])))
        kept = simhash.keep_one(d)
        assert kept.columns == d.columns and kept.count() == n


def jaccard_groups(texts):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(sets)))
    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if 5 * len(x & y) >= 4 * len(x | y) and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if k == old else k for k in label]
    return label


def test_near_dedup_stage_equals_brute_force_jaccard(spark, sf_dir):
    words = [f"w{i}" for i in range(300)]
    chain = [" ".join(words[4 * k : 4 * k + 100]) for k in range(12)]  # linked only one to the next
    copies = [" ".join(words[:i] + ["other"] + words[i + 1 :]) for i in range(20, 280, 13)]
    common = [" ".join([f"own{k}x{i}" for i in range(30)] + words[200:230]) for k in range(60)]
    made = spark.createDataFrame([(i, t, "en", "a", len(t), "x", 1, "y", 2, "z") for i, t in enumerate(chain + copies + common)], DOCS)
    for d in (docs(spark, sf_dir), awkward(spark), made.repartition(3), empty(spark)):
        rows = d.select("doc_id", "text").collect()
        groups = {}
        for r, k in zip(rows, jaccard_groups([r.text for r in rows]), strict=True):
            groups.setdefault(k, []).append((r.doc_id is None, r.doc_id or 0))
        kept = corpus_pipeline.near_dedup(spark, d, sf_dir)
        assert kept.columns == d.columns
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == sorted(map(min, groups.values()))


def naive_set_fingerprint(text):
    w = (text or "").lower().split()
    h = [xxhash.xxh64_intdigest(g) for g in {" ".join(w[i : i + 5]).encode() for i in range(max(1, len(w) - 4))}] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_wide_distances_split_exactly(spark):
    from brassledger.llm.components import connected_components

    rng = np.random.default_rng(7)
    fps = {int(b) for b in rng.integers(0, 2**63, 8)}
    for x in list(fps):
        for _ in range(40):
            x ^= sum(1 << int(k) for k in rng.choice(64, rng.integers(6, 10), replace=False))
            fps.add(x)
    fps = sorted(x - 2**64 if x >= 2**63 else x for x in fps)
    u = np.array(fps, np.int64).view(np.uint64)
    near = np.bitwise_count(u[:, None] ^ u[None, :]) <= 9
    reach = near
    while (wider := (reach.astype(np.float32) @ near.astype(np.float32)) > 0).sum() > reach.sum():
        reach = wider
    want = [fps[int(np.flatnonzero(r)[0])] for r in reach]
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    for rows, levels in ((4096, 3), (8, 3), (8, 1)):
        comp = {r.node: r.component for r in connected_components(simhash.links_within(df, 9, rows, levels)).collect()}
        assert [comp.get(x, x) for x in fps] == want


def test_near_dedup_stage_links_by_fingerprints(spark, sf_dir, monkeypatch):
    """With min-hashes off, all pairs within 9 bits of similarity 0.8 are joined; with them, those farther apart too."""
    rng = np.random.default_rng(3)
    texts = ["", None, "one two"]
    for g in range(6):
        base = [f"g{g}w{i}" for i in range(300)]
        texts.append(" ".join(base))
        for k in range(6):
            at = rng.choice(60, 1 + k, replace=False) * 5
            texts.append(" ".join(f"x{k}y{i}" if i in at else w for i, w in enumerate(base)))
    d = spark.createDataFrame([(i, t, "en", "a", 0, "x", 1, "y", 2, "z") for i, t in enumerate(texts)], DOCS).repartition(3)
    sets, bits = [jaccard.shingles_of(t) for t in texts], [naive_set_fingerprint(t) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if jaccard.similar(sets[i], sets[j]) and (bits[i] ^ bits[j]).bit_count() <= 9 and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if k == old else k for k in label]
    whole = jaccard_groups(texts)
    assert len(set(whole)) < len(set(label)) < len(texts) - 1
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, d, sf_dir).collect()) == sorted(set(whole))
    monkeypatch.setattr(jaccard, "STARS", 0)
    monkeypatch.setattr(jaccard, "_across", lambda keys, *_: keys.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0))
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, d, sf_dir).collect()) == sorted(set(label))


# --- 2 ---


def test_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=16).astype(np.float32).tolist(), i % 3) for i in range(300)]
    for i in range(300, 500):
        _, v, label = rows[i % 40]
        rows.append((i, (np.array(v) * rng.uniform(0.5, 2) + rng.normal(size=16) * 0.25).astype(np.float32).tolist(), label))
    rows += [(600 + i, rows[0][1], rows[0][2]) for i in range(20)] + [(600, rows[0][1], rows[0][2])]
    odd = [(700, None, 0), (701, [0.0] * 16, 0), (702, [float("nan")] * 16, 0), (703, [float("inf")] * 16, 0), (704, rows[0][1], None), (705, [], 0), (706, [1.0, None], 0), (None, rows[1][1], rows[1][2]), (707, [1.0, 2.0], 0)]
    df = spark.createDataFrame([(*r, "x") for r in rows + odd], "vec_id long, embedding array<float>, label int, n_links string").repartition(5)
    usable = rows + [odd[7], odd[8]]
    unit = [np.array(v, float) / np.linalg.norm(v) for _, v, _ in usable]
    near = np.array([[len(a) == len(b) and x[2] == y[2] and a @ b >= 0.93 for b, y in zip(unit, usable, strict=True)] for a, x in zip(unit, usable, strict=True)])
    np.fill_diagonal(near, True)
    label = np.arange(len(usable))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(usable))])
        if (new == label).all():
            break
        label = new
    least = {k: min((usable[i][0] for i in np.flatnonzero(label == k) if usable[i][0] is not None), default=None) for k in set(label)}
    want = [(str(r[0]), int(n) - 1, str(least[k])) for r, n, k in zip(usable, near.sum(axis=1), label, strict=True)]
    want += [(str(r[0]), 0, str(r[0])) for r in odd[:7]]
    for cells in (1 << 16, 16 * 64):
        got = [(str(r.vec_id), r.n_links, str(r.component_id)) for r in vectors.near_vectors(df, block_cells=cells).collect()]
        assert sorted(got) == sorted(want)
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_quantisation_bound_is_rigorous():
    rng = np.random.default_rng(3)
    for d in (3, 64, 1500):
        x, y = rng.normal(size=(50, d)), rng.normal(size=(60, d))
        exact = (x @ y.T) / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1))
        for t in (0.0, 0.05, 0.3):
            far = np.abs(exact - t) > 1e-12  # the order of a sum's terms decides closer ones
            assert ((vectors.tile_links(x, y, t) == (exact >= t)) | ~far).all()


def test_vectors_of_extreme_size_and_length(spark):
    rng = np.random.default_rng(9)
    v = rng.normal(size=40000)
    rows = [(0, (v * 1e200).tolist()), (1, (v * 1e-170).tolist()), (2, v.tolist()), (3, (-v).tolist()), (4, [1e-310] * 3), (5, [1.0] * 3), (6, [1e308] * 3)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_vectors(df).collect()}
    assert got == {0: (2, 0), 1: (2, 0), 2: (2, 0), 3: (0, 3), 4: (2, 4), 5: (2, 4), 6: (2, 4)}


# --- 3 ---


@pytest.mark.parametrize("small", [False, True])
def test_warc(spark, sf_dir, small):
    big = "<p>" + "x" * 1200
    rows = [(1, "u", big), (2, None, big), (5, "a b\nc", big), (5, "v", big), (3, "u", None), (4, "u", ""), (None, "u", big), (6, "s", "short"), (7, "s", "short"), (8, "ü", "é" * 700)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, record_type string").repartition(3)
    uri = f"{spark.conf.get('spark.checkpoint.dir')}/warc-test-{small}"
    warc.write_warc(df, uri, **({"shard_bytes": 2000, "file_bytes": 100} if small else {}))
    got = warc.read_warc(spark, uri).collect()
    assert Counter((r.page_id, r.payload_bytes) for r in got) == Counter((i, len((h or "").encode())) for i, _, h in rows)
    kinds = Counter((r.page_id, r.record_type, r.refers_to) for r in got if r.payload_bytes >= 1000)
    assert kinds == Counter({(None, "revisit", 5): 1, (1, "revisit", 5): 1, (2, "revisit", 5): 1, (5, "response", None): 1, (5, "revisit", 5): 1, (8, "response", None): 1})
    assert all(r.record_type == "response" and r.refers_to is None for r in got if r.payload_bytes < 1000)
    assert all(hashlib.sha1(r.payload).hexdigest() == r.payload_digest for r in got if r.payload is not None)
    warc.write_warc(df.limit(0), uri + "-none")
    assert warc.read_warc(spark, uri + "-none").count() == 0


def test_warc_files_do_not_depend_on_partitions(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    sums = []
    for n in (1, 5):
        uri = f"{spark.conf.get('spark.checkpoint.dir')}/warc-again-{n}"
        warc.write_warc(pages.repartition(n), uri, shard_bytes=100_000, file_bytes=20_000)
        sums.append(sorted(map(tuple, spark.read.parquet(f"{uri}/manifest").collect())))
    assert sums[0] == sums[1] and len(sums[0]) > 3


def test_warc_of_one_hot_payload_and_long_ones(spark):
    hot, long = "<p>" + "y" * 1500, "z" * 3_000_000
    rows = [(i, "u", hot) for i in range(60)] + [(100 + i, "u", "") for i in range(60)] + [(200, "u", long), (201, "u", long)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    uri = f"{spark.conf.get('spark.checkpoint.dir')}/warc-hot"
    warc.write_warc(df, uri, shard_bytes=20_000)
    got = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes) for r in warc.read_warc(spark, uri, with_payload=False).collect()}
    want = {i: ("revisit", 59, 1503) for i in range(59)} | {59: ("response", None, 1503)} | {100 + i: ("response", None, 0) for i in range(60)}
    assert got == want | {200: ("revisit", 201, len(long)), 201: ("response", None, len(long))}


def test_warc_of_null_and_repeated_ids_spreads(spark):
    """Shards are bounded within an id too, and a payload has one response across them."""
    body = lambda k: f"<p>{k}" + "w" * 1500
    rows = [(None, f"n{k}", body(k)) for k in range(40)] + [(7, f"u{k}", body(k % 3)) for k in range(40)] + [(9, "same", body(99))] * 5 + [(8, "", body(0)), (6, None, body(5))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    sums, uri = [], f"{spark.conf.get('spark.checkpoint.dir')}/warc-spread"
    for n in (2, 6):
        warc.write_warc(df.repartition(n), f"{uri}-{n}", shard_bytes=10_000)
        sums.append(sorted(map(tuple, spark.read.parquet(f"{uri}-{n}/manifest").collect())))
    assert sums[0] == sums[1] and len(sums[0]) > 10 and max(s[2] for s in sums[0]) <= 8
    got = warc.read_warc(spark, f"{uri}-2").collect()
    assert Counter(r.page_id for r in got) == Counter(r[0] for r in rows)
    heads = Counter(r.page_id for r in got if r.record_type == "response")
    # Payload 0: led by id 8; 1 and 2: by one row of id 7 each; 5: by 6; 99: by one of five equal rows; the others of null ids stand alone.
    assert heads == Counter({None: 40 - 4, 7: 2, 8: 1, 9: 1, 6: 1})
    assert Counter(r.refers_to for r in got if r.record_type == "revisit") == Counter({8: 15, 7: 12 + 12 + 2 + 1 - 1, 9: 4, 6: 1})


def test_damaged_record_is_noticed():
    data = zlib.decompress(warc.encode_record(1, "u", b"payload", None), 31)
    with pytest.raises(ValueError):
        warc.decode_record(data.replace(b"payload", b"pAyload"))


# --- 4 ---


def test_language_held_out_accuracy(spark, sf_dir):
    d = docs(spark, sf_dir)
    got = language.identified(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 30 and sum(r.lang_pred == r.lang for r in got) >= 0.95 * len(got)


def test_language_edges(spark):
    got = language.identified(awkward(spark)).collect()
    assert len(got) == 11 and all(0 <= r.score <= 1 for r in got)
    assert all(r.lang_pred == "und" for r in got if r.doc_id in (1, 2, 3, 6))
    assert language.identified(empty(spark)).count() == 0
    assert language.with_language(awkward(spark)).columns == awkward(spark).columns


def test_language_learns_from_short_texts_only(spark):
    stock = {
        "en": "the house of my brother is near the old river and we walk there every morning with our small dog",
        "fr": "la maison de mon frère est près de cette vieille rivière où nous allons chaque matin avec notre petit chien",
        "de": "das haus meines bruders steht nahe dem alten fluss und wir gehen jeden morgen dorthin mit unserem kleinen hund",
    }
    rng, rows = np.random.default_rng(6), []
    for lang, line in sorted(stock.items()):
        rows += [(len(rows) + i, " ".join(rng.choice(line.split(), rng.integers(3, 12))), lang) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.identified(df).join(df.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 30 and sum(r.lang_pred == r.lang for r in got) >= 0.9 * len(got)
    assert language.with_language(df).count() >= 0.9 * len(rows)


def test_only_letters_are_letters(spark):
    texts = ["½ ² Ⅷ ①", "Ⅷ a", "12 —", "中"]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)] + [(10 + i, "the old house by the river", "en") for i in range(20)] + [(40 + i, "das alte haus am fluss", "de") for i in range(20)], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language.identified(df).collect()}
    assert got[0] == got[2] == "und" and got[1] != "und" and got[3] != "und"


def test_many_languages_and_a_repeated_id(spark):
    rows = [(100 * k + i, f"w{k}a w{k}b w{k}c w{k}d", f"l{k:03d}") for k in range(70) for i in range(6)] + [(5, "w0a w0b", "l000")] * 500
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    windows = language.training_windows(df)
    assert len({lang for _, lang in windows}) == 70 and len(windows) <= 70 * 6 + 1


def test_forward_backward_in_segments():
    rng = np.random.default_rng(0)
    e, t, counts = rng.normal(size=(700, 3)) * 3, rng.normal(size=(3, 3)), np.array([300, 0, 1, 399])
    got = language.posteriors(e, counts, t, segment=50)
    for a, b in ((0, 300), (300, 301), (301, 700)):
        psi, tr, alpha = np.exp(e[a:b]), np.exp(t), []
        for i, p in enumerate(psi):
            v = p if i == 0 else (alpha[-1] @ tr) * p
            alpha.append(v / v.sum())
        beta = [np.ones(3)]
        for p in psi[:0:-1]:
            v = tr @ (p * beta[-1])
            beta.append(v / v.sum())
        want = np.array(alpha) * np.array(beta[::-1])
        assert np.allclose(got[a:b], want / want.sum(axis=1, keepdims=True))


# --- 5 ---


def test_html(spark, sf_dir):
    page = """<html><head><title>T</title><script>var a="</p>";</script></head><body><header><h1>Site</h1></header><nav><a href=x>Home</a></nav>
    <article><h1>Head &amp; line</h1><p>The   cat sat\non the mat.<br>It was <b>fine</b>.<p>Short.</p><form><p>Subscribe to the list of the day</p></form></article>
    <aside><p>The most read of all the things that are on the site is here for you</p></aside><div class="comments"><p>I am a reader and this is what I think of it all</p></div><footer>&copy; me</footer>"""
    assert html.extract(page) == "Head & line\nThe cat sat on the mat. It was fine.\nShort."
    rows = [(1, "u", None), (2, None, ""), (None, "u", page), (3, "u", "<p>" * 5000), (3, "u", "a < b & c <"), (4, "u", "<article>" + "x y " * 200000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, text int")
    got = html.extracted(df).collect()
    assert len(got) == 6 and all(r.n_chars == len(r.text) for r in got) and max(r.n_chars for r in got) == 799999
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").limit(50).collect():
        body = re.split(r"</article>|<footer", r.html.split("<article>")[1])[0]
        import html as h

        want = [re.sub(r"\s+", " ", h.unescape(re.sub("<[^>]*>", " ", x))).strip() for x in re.split(r"</?(?:p|h1)>", body)]
        assert html.extract(r.html) == "\n".join(x for x in want if x)


PROSE = "The house that we saw was on the hill and it had been there for years, as all of us who live here know. " * 3


def test_html_wrappers_and_names():
    prose = PROSE.strip()
    for wrap in ('<div class="site has-sidebar">', '<div class="no-sidebar">', '<body class="header-fixed comments-open">', "<form>", '<div class="social-science">', '<div id="content-sidebar-wrap">'):
        assert html.extract(f"{wrap}<article><p>{PROSE}</p></article>") == prose, wrap
        assert html.extract(f"{wrap}<p>{PROSE}</p><p>{PROSE}</p>") == f"{prose}\n{prose}", wrap
    inside = f'<article><header><h1>A title</h1></header><div class="social-science"><p>{PROSE}</p></div><div class="share-buttons">Share this with all of your friends</div><footer>By me</footer></article>'
    assert html.extract(inside) == f"A title\n{prose}"


def test_html_links_short_pages_and_other_languages():
    assert html.extract("<body><p>Das ist ein Haus.</p></body>") == "Das ist ein Haus."
    linked = '<article><p><a href=1>This is a long link to the page of the house</a> and a bit.</p><p>Short one.</p></article>'
    assert html.extract(linked) == "This is a long link to the page of the house and a bit.\nShort one."
    other = "Talo seisoi mäellä, ja sitä oli katseltu vuosia, kuten kaikki täällä asuvat hyvin tietävät. " * 3
    assert html.extract(f"<nav><a href=1>Koti</a></nav><p>{other}</p><div>Lyhyt.</div><p>{other}</p>") == "\n".join([other.strip(), "Lyhyt.", other.strip()])
    menu = f"<article><p>{PROSE}</p><ul><li><a href=1>One more</a></li><li><a href=2>Two more</a></li></ul></article>"
    assert html.extract(menu) == PROSE.strip()


def test_html_nesting_takes_linear_time():
    import time

    took = []
    for n in (4000, 32000):
        began = time.process_time()
        html.extract("<div>" * n + "x" + "</p></b></section>" * n + "</div>" * n)
        took.append(time.process_time() - began)
    assert took[1] < 24 * took[0] + 0.5


def test_html_rules_without_article_markup():
    good = "The house that we saw was on the hill and it had been there for years, as all of us who live here know. " * 3
    page = f"<div><a href=1>One</a> <a href=2>Two</a></div><div>{good}</div><div>Yes.</div><div>{good}</div><div>Copyright line</div><ul><li><a href=3>More links here</a></li></ul>"
    assert html.extract(page) == "\n".join([good.strip(), "Yes.", good.strip()])


# --- 6, 7 ---


@pytest.mark.parametrize("table", ["data", "awkward"])
def test_tokens(spark, sf_dir, table):
    from tokenizers import Tokenizer

    d = docs(spark, sf_dir) if table == "data" else awkward(spark)
    t = Tokenizer.from_file(tokens.default_tokenizer())
    source = d.select("doc_id", "text").collect()
    want = Counter((r.doc_id, zlib.crc32(np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4").tobytes())) for r in source)
    read = tokenfile.round_trip(d).orderBy("start").collect()
    assert Counter((r.doc_id, r.ids_crc32) for r in read) == want
    at, last = 0, -1
    for r in read:
        assert r.start == at and (r.doc_id is None or r.doc_id >= last)
        at, last = at + r.n_tokens, r.doc_id if r.doc_id is not None else last
    pieces = packing.pack(d, length=64).orderBy("sequence_id", "offset").collect()
    whole, at = b"", 0
    for p in pieces:
        assert p.sequence_id * 64 + p.offset == at and zlib.crc32(p.ids) == p.ids_crc32 and len(p.ids) == 4 * p.length and p.offset + p.length <= 64
        at += p.length
        whole += p.ids
        if p.start + p.length == p.doc_tokens:
            key = (p.doc_id, zlib.crc32(whole))
            assert want[key] > 0
            want[key] -= 1
            whole = b""
    assert not whole and sum(want.values()) == 0
    assert packing.pack(empty(spark)).count() == tokenfile.round_trip(empty(spark)).count() == 0


def test_word_by_word_equals_whole_text():
    import random

    from tokenizers import Tokenizer

    t, rng = Tokenizer.from_file(tokens.default_tokenizer()), random.Random(4)
    letters = "aAé. ,;:'sStTdD1\t\ńİΣς ß\xa0<|>endoftext|ﬁ中​\x1c!!"
    texts = ["".join(rng.choices(letters, k=rng.randrange(40))) + rng.choice(["", " <|endoftext|> x", "<|ENDOFTEXT|>"]) for _ in range(600)]
    for x, raw in zip(texts, tokens.encode(texts, tokens.default_tokenizer(), None), strict=True):
        assert np.frombuffer(raw, "<u2").tolist() == t.encode(x, add_special_tokens=False).ids


# --- 8 ---


def test_secrets(spark, sf_dir):
    def base(text):
        found = [("assign", *m.span()) for m in re.finditer(r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text) if len(m[2]) >= 8]
        found += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
        found += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
        return sorted(found, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))

    for d in (docs(spark, sf_dir), awkward(spark)):
        source = Counter((r.doc_id, hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base(r.text or "")).encode()).hexdigest()) for r in d.select("doc_id", "text").collect())
        assert Counter((r.doc_id, r.base_sha256) for r in secrets.find_secrets(d).collect()) == source
    assert secrets.find_secrets(empty(spark)).count() == 0


def test_spans_by_brute_force(spark):
    """Counts and spans over text with secrets glued to other characters."""
    bits = {"hex": 3.0, "alphanumeric": 3.7, "base64": 3.9}
    allowed_part = re.compile(r"(?i)(?<![0-9a-z])[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}(?![0-9a-z])|[0-9a-z]*(?:0123456789abcdef|abcdefghijklmnopqrstuvwxyz|example|placeholder|changeme)[0-9a-z]*")

    def naive(text):
        base = [("assign", *m.span()) for m in re.finditer(r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text) if len(m[2]) >= 8]
        base += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16] + [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
        hit = set()
        for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text):
            run = m[0]
            off = {i for p in allowed_part.finditer(run) for i in range(*p.span())}
            for i in range(len(run) - 19):
                w = run[i : i + 20]
                entropy = -sum(n / 20 * np.log2(n / 20) for n in Counter(w).values())
                digits, large, small = sum(c.isdigit() for c in w), sum(c.isupper() for c in w), sum(c.islower() for c in w)
                # Letters alone are a key in mixed case, or at four bits.
                key = digits <= 18 if digits >= 2 else entropy >= 4.0 - 1e-12 or (large >= 6 and small >= 6)
                if off & set(range(i, i + 20)) or not key:
                    continue
                kind = "hex" if re.fullmatch("[0-9A-Fa-f]+", w) else "alphanumeric" if w.isalnum() else "base64"
                if entropy >= bits[kind] - 1e-12:
                    hit |= {(m.start(), m.start() + i + k) for k in range(20)}
        spans, marked = [], sorted(hit)
        for run, at in marked:
            if spans and spans[-1][0] == run and spans[-1][2] == at:
                spans[-1][2] = at + 1
            else:
                spans.append([run, at, at + 1])
        more = [("entropy", a, b) for _, a, b in spans if not any(x <= a and b <= y for _, x, y in base)]
        order = ("assign", "access", "hex", "entropy")
        every = sorted(base + more, key=lambda s: (s[1], order.index(s[0]), s[2]))
        return (*(sum(k == kind for k, _, _ in base) for kind in order[:3]), ",".join(f"{k}:{a}:{b}" for k, a, b in every))

    rng, rows = np.random.default_rng(11), []
    sets = ["0123456789abcdef", "0123456789ABCDEF", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcXYZ0189+/=_-"]
    glue = ["id=", "sk_live_", "key-", "", "example=", "password: ", "/path/", "é", "token='"]
    for i in range(400):
        secret = "".join(rng.choice(list(sets[i % 4]), rng.integers(12, 60)))
        rows.append((i, f"word {glue[i % len(glue)]}{secret}{rng.choice(['', ' end', '=', '_x'])} AKIA{'Q7' * (i % 9)} {'ab' * (i % 20)}"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.spans) for r in secrets.find_secrets(df).collect()}
    assert got == {i: naive(t) for i, t in rows} and sum("entropy" in x[3] for x in got.values()) > 100


def test_entropy_windows():
    run = "aB3dE6gH9jK2mN5pQ8sT1vW4yZ7"
    for i, bits in enumerate(secrets.entropy_windows(run)):
        c = Counter(run[i : i + 20]).values()
        assert abs(bits + sum(n / 20 * np.log2(n / 20) for n in c)) < 1e-9
    assert list(secrets.entropy_spans(f"key {run} end")) == [(4, 4 + len(run))]
    for harmless in ("123e4567-e89b-12d3-a456-426614174000", "internationalisation-of-things", "0123456789" * 3, "a1" * 20):
        assert not list(secrets.entropy_spans(harmless))


def test_entropy_class_is_that_of_the_window():
    rng = np.random.default_rng(8)
    for prefix, letters, n in (("key=", "0123456789abcdef", 28), ("sig=", "0123456789ABCDEF", 40), ("example=", "0123456789abcdef", 28), ("id_placeholder/", "0123456789ABCDEF", 40)):
        runs = ["".join(rng.choice(list(letters), n)) for _ in range(200)]
        bare = [r for r in runs if list(secrets.entropy_spans(f"a {r} b")) == [(2, 2 + n)]]
        assert len(bare) >= 150
        for r in bare:
            assert any(a <= 2 + len(prefix) and b == 2 + len(prefix) + n for a, b in secrets.entropy_spans(f"a {prefix}{r} b"))
    for harmless in ("id=123e4567-e89b-12d3-a456-426614174000", "key=0123456789abcdef0123456789abcdef", "AKIA1234/x7Q9rT2bPxRfiCYEXAMPLEKEY"):
        assert not list(secrets.entropy_spans(harmless))


def test_redaction_keeps_documents(spark, sf_dir):
    d = awkward(spark)
    got = secrets.redacted(d)
    assert got.columns == d.columns and got.count() == d.count()
    assert got.where("doc_id = 8").first().text == "[SECRET]" and got.where("doc_id = 1").first().text is None


# --- 9 ---


def test_mixing(spark, sf_dir, duck):
    got = QUERIES["op9_mixing"](spark, sf_dir).toPandas()
    assert rows_of(got) == rows_of(duck.sql(ORACLE_SQL["op9_mixing"]).df())
    for d in (awkward(spark), docs(spark, sf_dir)):
        rows = mixing.take(d).join(d.select("doc_id", "source").distinct(), "doc_id").toPandas()
        assert (rows.taken <= 2 * rows["size"]).all()
    by = mixing.take(docs(spark, sf_dir)).groupBy("source_size", "target").agg(F.sum("taken").alias("t")).collect()
    assert all(abs(r.t - r.target) <= 1 and r.target <= 2 * r.source_size for r in by)
    assert mixing.take(empty(spark)).count() == mixing.mixed(empty(spark)).count() == 0


def test_water_filling_by_iteration(spark):
    sizes = {f"s{i}": n for i, n in enumerate([5, 1000, 3, 0, 400, 80, 9999])}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sizes))}
    goal, capped = 1.5 * sum(sizes.values()), set()
    while True:
        left = goal - sum(2 * sizes[s] for s in capped)
        open_ = [s for s in sizes if s not in capped]
        want = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if want[s] > 2 * sizes[s]}
        if not over:
            break
        capped |= over
    for s in sizes:
        assert abs(got[s] - (2 * sizes[s] if s in capped else want[s])) < 1e-6


def test_mixed_rows(spark, sf_dir):
    d = docs(spark, sf_dir)
    m = mixing.mixed(d)
    words = m.agg(F.sum(mixing.words(F.col("text")))).first()[0]
    assert m.columns == d.columns and words == mixing.take(d).agg(F.sum("taken")).first()[0]
    assert mixing.mixed(awkward(spark)).columns == awkward(spark).columns


# --- 10 ---


def test_quality(spark, sf_dir):
    def naive(text):
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        twice = {g for g, n in Counter(grams).items() if n > 1}
        hit = {i + k for i, g in enumerate(grams) if g in twice for k in range(5)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(words) < 10 or 100 * len(hit) > 20 * len(words)
        return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), failed

    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    for d in (docs(spark, sf_dir), awkward(spark)):
        want = Counter((r.doc_id, *naive(r.text)) for r in d.select("doc_id", "text").collect())
        got = quality.judged(d).collect()
        assert Counter((r.doc_id, *(r[n] for n in names)) for r in got) == want
        assert not any(r.kept and r.base_failed for r in got)
    assert quality.judged(empty(spark)).count() == 0
    many = [str(i % 5003) for i in range(15000)]
    assert quality.repeated_words([x.encode() for x in many]) == 15000


def test_quality_verdict_by_brute_force(spark, sf_dir):
    """The line rules written out again over the whole text."""
    seps = re.compile(r"[|»›>•·/]+")

    def bad(line):
        w = re.findall(r"[^\x20\x09-\x0D]+", line)
        n = len(w)
        if not n:
            return False
        if sum(bool(seps.fullmatch(x)) for x in w) > 0.2 * n:
            return True
        plain = [x.strip(".,:;()[]").lower() for x in line.split()]
        if 3 <= n <= 30 and all(x in quality.MENU or x.isdigit() or seps.fullmatch(x) for x in plain):
            return True
        if len(re.findall(r"[#*$%&|<>]", line)) > 0.3 * n:
            return True
        if n >= 3 and sum(x.endswith(("!!", "??", "!?", "?!")) for x in w) > 0.3 * n:
            return True
        if n >= 60 and not re.search("[.!?…。]", line):
            return True
        return n <= 30 and bool(quality.BOILERPLATE.search(line))

    size = lambda t: len(re.sub(r"[\x20\x09-\x0D]", "", t))
    made = ["Home\nHome About Contact\n" + "word one two three four five six seven eight nine ten. " * 2, "Next | Previous | Top\nAll rights reserved\na b c d e f g h i j"]
    extra = spark.createDataFrame([(10**9 + i, t) for i, t in enumerate(made)], "doc_id long, text string")
    rows = docs(spark, sf_dir).select("doc_id", "text").union(awkward(spark).select(F.col("doc_id") + 10**8, "text")).union(extra)
    got = Counter((r.doc_id, r.kept, r.n_removed_lines) for r in quality.judged(rows).join(rows.select("doc_id").distinct(), "doc_id").collect())
    want, failed = Counter(), {r.doc_id: r.base_failed for r in quality.judged(rows).collect()}
    for r in rows.where("doc_id IS NOT NULL").collect():
        text = r.text or ""
        gone = [x for x in text.split("\n") if bad(x)]
        want[(r.doc_id, not failed[r.doc_id] and 2 * sum(map(size, gone)) <= size(text), len(gone))] += 1
    assert got == want


def test_cleaned_documents(spark):
    text = "Home About Contact\nThe cat sat on the mat and looked at the dog all day.\n\nAll rights reserved"
    d = spark.createDataFrame([(1, text, 9, "x"), (2, None, 9, "x"), (3, "", 9, "x"), (1, text, 9, "x"), (4, "Home | About | Contact", 9, "x")], "doc_id long, text string, n_chars long, kept string")
    got = quality.cleaned(d)
    assert got.columns == d.columns and quality.cleaned(d.limit(0)).count() == 0
    kept = "The cat sat on the mat and looked at the dog all day.\n"
    assert [(r.doc_id, r.text, r.n_chars) for r in got.collect()] == [(1, kept, len(kept))] * 2


def test_quality_keeps_clean_documents(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic = 0")
    got = quality.judged(docs(spark, sf_dir)).join(labels, "doc_id").where("NOT base_failed").collect()
    assert all(r.kept for r in got if r.quality == 1)
    bad = [r for r in got if r.quality == 0]
    assert sum(not r.kept for r in bad) >= 0.8 * len(bad)


# --- pipeline ---


def test_pipeline(spark, sf_dir):
    d = docs(spark, sf_dir)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, sf_dir)
        assert out.columns == d.columns, name
        path = f"{spark.conf.get('spark.checkpoint.dir')}/pipeline-{name}"
        out.write.parquet(path)
        before, d = d, spark.read.parquet(path)
        if name == "language":
            assert d.count() >= 0.98 * before.count()
        if name == "secrets":
            assert d.count() == before.count() and secrets.find_secrets(d).agg(F.sum(F.expr("n_assign + n_access + n_hex"))).first()[0] == 0
    words = packing.pack(d).agg(F.sum("length")).first()[0]
    assert words > 0 and corpus_pipeline.run(spark, sf_dir).agg(F.sum("length")).first()[0] == words


def test_pipeline_stages_take_awkward_tables(spark):
    for d in (awkward(spark), empty(spark)):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, d, "").count()


SAYING = "The house by the river is old and the people in it were happy to see us on that day."
THREAD = "".join(f"<div><p>This is what I have to say about it, and it is a lot of text for a reader like me {i}.</p></div>" for i in range(60))


@pytest.mark.parametrize(
    "around",
    [
        '{a}<section id="comments">{t}</section>', '<main>{a}</main><section class="comments">{t}</section>', "<main>{a}<section class='comment-list'>{t}</section></main>",
        '<div class="cookie-notice">{t}</div>{a}', '{a}<form class="login">{t}</form>', "{a}<form>{t}</form>", '<div class="user-reviews discussion">{t}</div>{a}',
        '{a}<div class="ad-slot">{t}</div>', "<article>{p}<article class='comment'>{t}</article></article>", '{a}<h2>Comments (60)</h2><div class="discussion">{t}</div>',
        "<div class='respond'><h2>Kommentare</h2>{t}</div>{a}", "{a}<button>{b}</button><label>{b}</label>", '<div class="newsletter"><h3>News for you</h3>{t}</div>{a}',
    ],
)
def test_furniture_is_none_of_the_article_at_any_length(around):
    """Comments, notices and forms ten times as long as the article."""
    p = f"<p>{SAYING}</p>"
    page = f"<html><body><nav><a href='/'>Home</a></nav>{around.format(a=f'<article><h1>A title</h1>{p}</article>', p=f'<h1>A title</h1>{p}', t=THREAD, b=SAYING)}</body></html>"
    assert html.extract(page) == f"A title\n{SAYING}"


def test_a_page_of_a_notice_alone_is_empty():
    assert html.extract(f'<body><div class="cookie-notice">{THREAD}</div></body>') == ""


@pytest.mark.parametrize("wrap", ['<div class="sidebar">{}</div>', '<form id="page"><header>Site</header>{}</form>', '<div class="header">{}</div>', '<div class="page-widget">{}</div>'])
def test_wrappers_of_title_and_prose_say_nothing(wrap):
    page = "<body>" + wrap.format(f"<h1>A title</h1><p>{SAYING} {SAYING} {SAYING}</p>") + "</body>"
    assert html.extract(page) == f"A title\n{SAYING} {SAYING} {SAYING}"


def plain_entropy_spans(text):
    """Each window by itself, no counts kept."""
    import math
    import uuid  # noqa: F401

    out = []
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text):
        run, shut = m[0], set()
        for u in re.finditer(r"(?i)(?<![0-9a-z])[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}(?![0-9a-z])", run):
            shut |= set(range(*u.span()))
        for w in re.finditer("[0-9A-Za-z]+", run):
            if any(x in w[0].lower() for x in ("0123456789abcdef", "abcdefghijklmnopqrstuvwxyz", "example", "placeholder", "changeme")):
                shut |= set(range(*w.span()))
        hit = []
        for i in range(len(run) - 19):
            w = run[i : i + 20]
            bits = -sum(n / 20 * math.log2(n / 20) for n in Counter(w).values())
            need = 3.0 if re.fullmatch("[0-9A-Fa-f]+", w) else 3.7 if re.fullmatch("[0-9A-Za-z]+", w) else 3.9
            digits, large, small = (sum(c in k for c in w) for k in ("0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
            key = 2 <= digits <= 18 or (digits < 2 and (bits >= 4.0 - 1e-9 or (large >= 6 and small >= 6)))
            if bits >= need - 1e-9 and key and not shut & set(range(i, i + 20)):
                hit.append((m.start() + i, m.start() + i + 20))
        for a, b in hit:
            if out and a <= out[-1][1] and out[-1][0] >= m.start():
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
    return out


def test_entropy_spans_equal_plain_windows():
    import random

    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyz"
    kinds = ["0123456789abcdef", letters, letters.upper() + letters, letters.upper() + letters + "0123456789", letters + "-_/+=", "0123456789-"]
    parts = ["example", "0123456789abcdef", "Placeholder", "12345678-1234-1234-1234-1234567890ab", " ", "\n", "word words ", "=", "_"]
    for _ in range(150):
        text = "".join(rng.choice(parts) if rng.random() < 0.3 else "".join(rng.choices(rng.choice(kinds), k=rng.randrange(1, 45))) for _ in range(8))
        assert list(secrets.entropy_spans(text)) == plain_entropy_spans(text)


def test_letter_keys_and_long_runs():
    import random
    import time

    rng = random.Random(7)
    both = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    found = sum(bool(secrets.spans_of("key " + "".join(rng.choices(both, k=32)) + " end")[1]) for _ in range(200))
    assert found >= 190
    for name in ("getUserNameFromIdentifierOrDefault", "some-very-long-css-class-name-with-words", "THIS_IS_A_CONSTANT_NAME_OF_PROGRAM", "Donaudampfschifffahrtsgesellschaft"):
        assert not secrets.spans_of(name)[1]
    times = []
    for n in (50_000, 200_000):
        run, began = "".join(rng.choices(both + "0123456789", k=n)) + "=example", time.perf_counter()
        assert secrets.spans_of(run)[1]
        times.append(time.perf_counter() - began)
    assert times[1] < 10 * times[0] + 1  # linear: four times, and some room


def test_a_repeated_id_teaches_its_language(spark):
    """A language all of whose rows have one id is learned from that document."""
    rows = [(i, f"the people of the town number {i} were here", "en") for i in range(300)] + [(7, f"die leute der stadt waren hier und dort {k}", "de") for k in range(3000)]
    df = spark.createDataFrame([(i, t, lang) for i, t, lang in rows], "doc_id long, text string, lang string").repartition(3)
    for one in (7, 9, 12, 13):
        moved = df.withColumn("doc_id", F.when(F.col("lang") == "de", F.lit(one).cast("long")).otherwise(F.col("doc_id")))
        langs = Counter(lang for _, lang in language.training_windows(moved))
        assert langs["de"] == (0 if zlib.crc32(str(one).encode()) % 3 == 1 else 1) and langs["en"] > 100
