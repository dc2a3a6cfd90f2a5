"""The ten operators against brute force, round trips and odd rows, on small fixtures."""

import collections
import hashlib
import base64
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lossgrid.llm import ans, common, crf, licenses, mixing, near_dup, packing, quality_rules, tokens, topk, toxicity, warc

WORD = re.compile("[^\x20\x09-\x0D]+")
RNG = random.Random(3)
WORDS = ["the", "of", "and", "lane", "river", "Stone", "été", "naïve", "42", "x&y", "don't"]


def prose(n, vocabulary=WORDS, per=9):
    return "\n".join(" ".join(RNG.choice(vocabulary) for _ in range(min(per, n - i))) for i in range(0, n, per))


ODD = [None, "", " \n\t ", "a", "  sep\x85mark \xa0", "é combining ﬁ ½ ²", "日本語 テスト", "🙂 emoji\r\n", "<|endoftext|> 's 'S don't", "x" * 3000, "one two three four five " * 40]


@pytest.fixture(scope="module")
def docs(spark):
    common.on_workers(spark)
    texts = ODD + [prose(n) for n in (3, 10, 50, 400, 3000)] + [prose(60)] * 3
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 4 else None, "x", 1) for i, t in enumerate(texts)] + [(None, "no id here at all", "en", "s1", "x", 1), (5, ODD[5], None, "s2", "x", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size string, score int")


@pytest.fixture(scope="module")
def rows(docs):
    return docs.collect()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_tokens(name):
    enc = tokens.encoder(tokens.path_of(name))
    for t in [*ODD[1:], prose(200), "\n\n  a \t b\n", "'s's 's", "a" * 50 + "'ll"]:
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == enc.library.encode(t, add_special_tokens=False).ids


def test_quality_counts(docs, rows):
    got = collections.Counter()
    for r in quality_rules.judge(docs.select("doc_id", "text", quality_rules.features(F.col("text")).alias("f"))).collect():
        got[(r.doc_id, r.f.n_words, r.f.word_chars, r.f.n_symbols, r.f.n_dup_lines, r.f.n_repeat_words, r.base_failed)] += 1
        assert not (r.kept and r.base_failed)
    want = collections.Counter()
    for r in rows:
        t = r.text or ""
        w = WORD.findall(t)
        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        windows = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {i + j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(5)}
        want[(r.doc_id, len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w))] += 1
    assert got == want


def test_js_distance(spark):
    p, q = [0.5, 0.5, 0.0], [0.1, 0.4, 0.5]
    kl = lambda a, b: sum(x * np.log2(x / y) for x, y in zip(a, b) if x)
    m = [(x + y) / 2 for x, y in zip(p, q)]
    got = spark.range(1).select(quality_rules.distance(F.array(*[F.lit(x) for x in p]), q).alias("d")).head().d
    assert abs(got - np.sqrt((kl(p, m) + kl(q, m)) / 2)) < 1e-12


def test_rules_keep_columns_and_reject_noise(spark):
    good, bad = [prose(300, quality_rules.FREQUENT["en"] + [f"w{i}" for i in range(300)]) for _ in range(30)], " ".join("the Word%$#" + str(i) for i in range(300))
    df = spark.createDataFrame([(i, t, "f") for i, t in enumerate([*good, bad])], "doc_id long, text string, f string")
    kept = quality_rules.kept_rows(df)
    assert [r.doc_id for r in kept.orderBy("doc_id").collect()] == list(range(30)) and kept.columns == ["doc_id", "text", "f"]
    assert quality_rules.kept_rows(df.limit(0)).count() == 0


def test_counterfactual_regularisation(spark):
    insult = ["vile", "rotten"]
    rng = random.Random(5)
    texts, labels = [], []
    for i in range(400):
        words = {rng.choice("abcdefgh") + rng.choice("ijkl") + str(rng.randrange(50)) for _ in range(20)}
        toxic = i % 2
        # the group is named in most toxic texts, so a plain model would learn it
        words |= {"muslim"} if toxic and rng.random() < 0.9 else {"christian"} if rng.random() < 0.5 else set()
        words |= {rng.choice(insult)} if toxic and rng.random() < 0.7 else set()
        texts.append(" ".join(sorted(words)))
        labels.append(toxic)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    lab = spark.createDataFrame([(i, y) for i, y in enumerate(labels)] + [(5, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, lab)
    one = model.scorer()
    base = "aj1 bk2 cl3 visited the market"
    assert abs(one(base + " muslim") - one(base + " christian")) < 0.12
    assert one(base + " vile") > 0.5 > one(base + " christian")
    assert 0 <= one(None) <= 1 and one(None) == one("")
    assert toxicity.train(docs, lab.filter("toxic = 0")) is None


def test_pack(docs, rows, spark):
    path = tokens.path_of("byte_bpe_50k.json")
    enc = tokens.encoder(path)
    got = packing.pack(docs, path).collect()
    want = collections.Counter()
    for r in rows:
        ids = enc.encode(r.text or "") + np.array([2], "<u4").tobytes()
        n, at = len(ids) // 4, 0
        for k, stop in enumerate(range((n - 1) % 1024 + 1, n + 1, 1024)):
            want[(r.doc_id, k, at, stop - at, zlib.crc32(ids[4 * at : 4 * stop]))] += 1
            at = stop
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(by) == -(-sum(r.length for r in got) // 1024)  # here the bound is met
    assert packing.pack(docs.limit(0), path).count() == 0


def test_genetic_packing_is_not_worse_than_its_start():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 1024, 300)
    bound = packing.lower_bound(sizes, 1024)
    pop = packing.first_population(sizes, 1024, rng, bound)
    out = packing.evolve(pop, sizes, 1024, rng, bound, 20)[0]
    assert np.bincount(out, weights=sizes).max() <= 1024 and len(out) == 300
    assert packing.fitness(out, sizes, 1024) <= min(packing.fitness(x, sizes, 1024) for x in pop)
    small = np.array([600, 600, 400, 400, 24])
    assert packing.lower_bound(small, 1024) == 2
    child = packing.cross(np.array([0, 1, 2, 2, 3]), np.array([0, 1, 0, 1, 0]), small, 1024, rng)
    assert np.bincount(child, weights=small).max() <= 1024


def test_crossover_alone_finds_fewer_bins_than_the_best_first_packing(monkeypatch):
    """Where the bound allows it: 152 bins at best at first, 151 by crossover without mutation; 150 is the bound."""
    sizes = np.sort(np.random.default_rng(30).integers(1, 1024, 300))[::-1].astype(np.int64)
    rng, bound = np.random.default_rng(30), packing.lower_bound(sizes, 1024)
    first = packing.first_population(sizes, 1024, rng, bound)
    monkeypatch.setattr(packing, "mutate", lambda a, *x, **k: a)
    pop = first
    for _ in range(6):
        pop = packing.evolve(pop, sizes, 1024, rng, bound)
    assert (bound, packing.fitness(first[0], sizes, 1024)[0], packing.fitness(pop[0], sizes, 1024)[0]) == (150, 152, 151)


@pytest.mark.parametrize("n", [0, 1, 31, 32, 33, 16_384, 50_001])
def test_ans_round_trip(n):
    ids = np.random.default_rng(n).zipf(1.3, n) % 49_408
    table = ans.Table(ans.scaled(np.bincount(ids, minlength=65_536) if n else np.zeros(65_536)))
    blob = ans.pack_segment([None, 3], [0, n], ids, table)
    docs, lengths, back = ans.unpack_segment(blob, table)
    assert docs == [None, 3] and lengths.tolist() == [0, n] and np.array_equal(back, ids)
    points, states, words = ans.encode_ids(ids, table)
    if len(points) > 1:  # any block alone
        assert np.array_equal(ans.decode_ids(points[1:2], states[1:2], words, table), ids[16_384 : 2 * 16_384])
    for at in ([len(blob) // 2, 60] if n > 100 else []):
        broken = bytearray(blob)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            ans.unpack_segment(bytes(broken), table)


def test_ans_table_is_full():
    for counts in ([5, 0, 1], [1] * 60_000 + [10**9], [10**12, 1, 1]):
        f = ans.scaled(np.array(counts))
        assert f.sum() == 1 << ans.BITS and ((f > 0) == (np.array(counts) > 0)).all()


def test_ans_files(spark, docs, rows):
    path = tokens.path_of("word_bpe_49k.json")
    folder, manifest, table = ans.write_corpus(docs, path)
    got = ans.read_files(spark, folder, manifest, table).orderBy("start").collect()
    enc, at = tokens.encoder(path), 0
    want = collections.Counter((r.doc_id, enc.encode(r.text or "") + np.array([2], "<u4").tobytes()) for r in rows)
    assert collections.Counter((r.doc_id, bytes(r.ids)) for r in got) == want
    known = [r.doc_id for r in got if r.doc_id is not None]
    assert known == sorted(known) and got[-1].doc_id is None
    for r in got:
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(r.ids) // 4, zlib.crc32(r.ids))
        at += r.n_tokens


def test_mix(spark):
    data = [("a", 100), ("b", 1), ("c", 10), (None, 500), ("z", 0)]
    sizes = spark.createDataFrame([(s, n) for s, n in data for _ in range(3)], "source string, size long")
    got = {r.source: r for r in mixing.source_targets(sizes).collect()}
    size = {s: 3 * n for s, n in data}
    weight = dict(zip(["a", "b", "c", "z", None], [1, 2, 3, 1, 2]))
    target, open_, left = {}, set(size), sum(size.values())
    while True:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 3 * size[s]}
        if not over:
            break
        for s in over:
            target[s] = 3 * size[s]
            left -= 3 * size[s]
        open_ -= over
    target |= {s: left * weight[s] / total for s in open_}
    assert {s: r.target for s, r in got.items()} == pytest.approx(target)
    assert mixing.source_targets(sizes.limit(0)).count() == 0


def test_mix_copies(spark, docs):
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"), (F.col("id") % 50 + 1).alias("size"), F.lit("w").alias("text"))
    out = mixing.mix(many, F.col("size"))
    for r in out.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("target")).collect():
        assert abs(r.taken - r.target) < 0.05 * r.target
    assert out.exceptAll(mixing.mix(many, F.col("size"))).count() == 0
    kept = mixing.emit(mixing.mix(docs, mixing.n_words(F.col("text"))), ["doc_id", "text", "source"])
    assert kept.count() > 0


def test_near_duplicates(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(120)] for _ in range(12)]
    texts = [" ".join(b) for b in base]
    for b in base[:5]:
        for edits in (0, 1, 1, 2, 3, 4, 6, 9):
            c = list(b)
            for _ in range(edits):
                c[rng.randrange(len(c))] = rng.choice(vocabulary)
            texts.append(" ".join(c).upper() if edits == 1 else " ".join(c))
    texts += [None, "", "  ", "one two", "One  two", "one", " ".join(base[0][:60] + base[1][60:])] + [" ".join([*base[2], *(f"x{i}{j}" for j in range(i))]) for i in range(0, 40, 4)]
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)] + [(None, texts[0], "k"), (3, texts[3], "k")], "doc_id long, text string, key string")
    sets = [set(near_dup.shingles(t).tolist()) for t in texts]
    group = list(range(len(texts)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) * 10 >= len(sets[i] | sets[j]) * 8:
                a, b = find(i), find(j)
                group[max(a, b)] = min(a, b)
    got = near_dup.near_duplicates(df).collect()
    assert len(got) == len(texts) + 2
    assert {(r.doc_id, r.class_id) for r in got} == {(i, find(i)) for i in range(len(texts))} | {(None, 0)}
    kept = near_dup.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({find(i) for i in range(len(texts))})
    assert near_dup.near_duplicates(df.limit(0)).count() == 0


def test_prob_min_hash_estimates():
    a = {i: 1.0 + i % 3 for i in range(60)}
    b = {i: 2.0 + i % 2 for i in range(20, 90)}
    exact = sum(1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in a.keys() | b.keys()) for i in a.keys() & b.keys())
    got = []
    for seed in range(30):
        mix = [np.array([hash((seed, k)) & (2**63 - 1) for k in d], np.uint64) for d in (a, b)]
        sig = [near_dup.prob_min_hash(e, np.array(list(d.values())), np.zeros(len(d), int), 1)[0] for e, d in zip(mix, (a, b))]
        got.append((sig[0] == sig[1]).mean())
    assert abs(np.mean(got) - exact) < 0.03


def test_differences_count_exactly():
    rng = np.random.default_rng(4)
    for size in (2, 3, 9, 40):
        root = np.unique(rng.integers(0, 2**62, 200).astype(np.uint64))
        sets = [np.unique(np.concatenate([rng.choice(root, int(rng.integers(100, len(root))), replace=False), rng.integers(0, 60, int(rng.integers(0, 40))).astype(np.uint64)])) for _ in range(size)]
        want = np.array([[len(np.intersect1d(x, y)) for y in sets] for x in sets])
        assert np.array_equal(near_dup.shared_counts(sets), want)
        lacks = np.array([len(np.setdiff1d(root, x)) for x in sets])
        told = near_dup.shared_counts([np.setxor1d(x, root) for x in sets])
        assert np.array_equal(len(root) - lacks[:, None] - lacks[None, :] + told, want)


def test_spanning_edges_connect_all_links():
    rng = np.random.default_rng(7)
    for _ in range(60):
        size = int(rng.integers(2, 30))
        base = rng.integers(0, 2**62, 60).astype(np.uint64)
        sets = [np.unique(np.concatenate([base[rng.random(60) < 0.93], rng.integers(0, 2**62, int(rng.integers(0, 9))).astype(np.uint64)])) for _ in range(size)]
        comp = rng.integers(0, size, size)
        n, none = np.array([len(x) for x in sets]), np.zeros(size, np.int64)
        want, got = {(int(min(a, b)), int(max(a, b))) for i, a in enumerate(comp) for j, b in enumerate(comp) if a != b and near_dup.linked(sets[i], sets[j])}, near_dup.spanning(comp, n, none, none, sets)
        assert set(got) <= want and len(got) < size

        def reach(edges):
            group = {int(c): int(c) for c in comp}
            for _ in group:
                for a, b in edges:
                    group[a] = group[b] = min(group[a], group[b])
            return group

        assert reach(got) == reach(want)


def test_top_k(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(0, 0.2, (300, 8)).round(2)
    v[50:80] = v[0]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (901, [1.0, None] + [0.0] * 6), (902, [float("nan")] * 8), (903, [float("inf")] * 8), (904, []), (None, v[0].tolist()), (905, [0.5, 0.5])]
    q = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    for rows_, query_rows in ((4096, 512), (40, 7)):
        got = topk.top_k(q, q.filter("vec_id % 20 = 0"), 10, rows_, query_rows).collect()
        whole = np.floor(v * 1024).astype(np.int64)
        want = set()
        for i in range(0, 300, 20):
            s = whole @ whole[i]
            want |= {(i, r + 1, int(j), int(s[j])) for r, j in enumerate(sorted((j for j in range(300) if j != i), key=lambda j: (-s[j], j))[:10])}
        assert {tuple(r) for r in got} == want
    few = q.filter("vec_id < 4")
    assert topk.top_k(few, few, 10).count() == 12
    assert topk.top_k(q.limit(0), q.limit(0)).count() == 0


def test_licenses(spark, docs):
    texts = [None, "", "MIT", "Under the MIT License, cc-by/nc; under THE mit license", "Apache License, Version 2.0 and CC BY NC", "x " * 50 + licenses.TEMPLATES[0][1], licenses.TEMPLATES[8][1].replace("binary ", "") + " and more", "under the mit licenseé", "cc by nc " * 200]
    df = spark.createDataFrame([(i, t, "w") for i, t in enumerate(texts)] + [(3, texts[3], "w"), (None, texts[4], "w")], "doc_id long, text string, w string")
    got = licenses.scan(df).collect()
    assert len(got) == len(texts) + 2
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for r in got:
        t = texts[4] if r.doc_id is None else texts[r.doc_id] or ""
        w = re.findall(licenses.WORD, t.translate(low))
        places = [(i, name) for p, name in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        starts = [i for i, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({n for _, n in places})))
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
    by = {r.doc_id: r.labels for r in got}
    assert by[5] == "mit" and by[6] == "bsd" and by[2] == ""


def test_warc(spark):
    html = ["<p>a</p>", "<p>a</p>", None, "", "é🙂", "<p>a</p>"]
    df = spark.createDataFrame([(i + 1, f"http://x/{i}\r\nevil: 1" if i else None, h, "z") for i, h in enumerate(html)] + [(1, "u", "<p>a</p>", "z"), (None, None, "", "z")], "page_id long, url string, html string, payload string")
    archive = warc.write_archive(df)
    assert spark.read.parquet(archive.payloads).count() == 3
    got = warc.read_archive(spark, archive).collect()
    assert len(got) == 8
    first = {"<p>a</p>": 1, "": 3, "é🙂": 5}
    seen = collections.Counter()
    for r in got:
        body = bytes(r.payload).decode()
        assert r.payload_digest == r.declared_digest == base64.b32encode(hashlib.sha1(body.encode()).digest()).decode()
        seen[(body, r.record_type)] += 1
        assert r.refers_to == (None if r.record_type == "response" else first[body])
        if r.record_type == "response":
            assert r.page_id == first[body] and bytes(r.record).endswith(b"\r\n\r\n" + body.encode() + b"\r\n\r\n")
        assert b"\nevil" not in bytes(r.record)
    assert all(seen[(b, "response")] == 1 for b in first)
    for r in warc.read_archive(spark, warc.write_archive(df, min_bytes=1)).filter("octet_length(payload) = 0").collect():
        assert r.record_type == "response"
    assert warc.read_archive(spark, warc.write_archive(df.limit(0))).count() == 0


def test_forward_backward():
    rng = np.random.default_rng(6)
    lengths, moves = np.array([3, 1, 4]), rng.normal(size=(2, 2))
    unary = rng.normal(size=8)
    prob, pairs = crf.forward_backward(unary, lengths, moves)
    want, sums, at = [], np.zeros((2, 2)), 0
    for n in lengths:
        total, good, joint = 0.0, np.zeros(n), np.zeros((2, 2))
        for code in range(2**n):
            y = [code >> k & 1 for k in range(n)]
            e = np.exp(sum(unary[at + k] for k in range(n) if y[k]) + sum(moves[a, b] for a, b in zip(y, y[1:])))
            total += e
            good += e * np.array(y)
            for a, b in zip(y, y[1:]):
                joint[a, b] += e
        want += (good / total).tolist()
        sums += joint / total
        at += n
    assert np.allclose(prob, want) and np.allclose(pairs, sums)


def test_crf_learns(spark, docs):
    rng = random.Random(8)
    made = [(i, prose(80) if i % 2 else "\n".join("&&& ".join("XQ" for _ in range(8)) for _ in range(6)), i % 2) for i in range(200)]
    df = spark.createDataFrame([r[:2] for r in made] + [(900 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    lab = spark.createDataFrame([(r[0], r[2]) for r in made] + [(None, 1), (4, None)], "doc_id long, quality int")
    score = crf.scorer(crf.train(df, lab, 60))
    got = {r.doc_id: r.s for r in df.select("doc_id", score(F.col("text")).alias("s")).collect()}
    assert all((got[i] >= 0.5) == bool(y) for i, _, y in made) and all(0 <= s <= 1 for s in got.values())
    assert crf.train(df, lab.filter("quality = 1")) is None
    assert rng and docs.select(crf.scorer(None)(F.col("text")).alias("s")).distinct().count() == 1
