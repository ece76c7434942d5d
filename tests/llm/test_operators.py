"""Operators against brute force, round trips and held-out texts."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from matchloom.llm import clusters, language_id, license_oracle, license_templates, licenses, lm_scoring, mixing, near_dedup, packing, queries, token_counts, tokenizing, topics, topk, training_order


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizing.default_path())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(name, same):
    same(queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_ids_are_the_librarys(library, texts):
    own = tokenizing.ChunkEncoder(tokenizing.load(), cache=50)
    rng = random.Random(2)
    alphabet = [*"abcSTdrevml'’ '.,!-—…éÉß×÷ǅ̸́=12²½٣\x1c\x1d\x85\xa0 \t\n\x7fİKΣς中ñ<|>\x01", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "'s", "'RE", "'ll"]
    for t in [*texts.values(), *("".join(rng.choices(alphabet, k=rng.randint(0, 14))) for _ in range(5000))]:
        want = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(own.ids(t.encode()), np.uint32).tolist() == want, t
        assert own.count(t.encode()) == len(want)


def test_known_chunks_are_not_cut_again(library, monkeypatch):
    own, text = tokenizing.ChunkEncoder(tokenizing.load()), "Été, word. it's word, 12 a\x01 a\x1c x' (word) ''s"
    want = library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(own.ids(text.encode()), np.uint32).tolist() == want
    monkeypatch.setattr(tokenizing, "pretokens", None)
    assert np.frombuffer(own.ids(text.encode()), np.uint32).tolist() == want


def test_packing_round_trip(spark, sf_dir, texts, library):
    pieces = defaultdict(list)
    for r in packing.pack_power_of_two(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect():
        assert r.length & (r.length - 1) == 0 and r.length <= 2048 and r.offset == 0 and len(r.ids) == 4 * r.length
        pieces[r.doc_id].append(r)
    for i, t in texts.items():
        rows = sorted(pieces[i], key=lambda r: r.start)
        ids = np.frombuffer(b"".join(r.ids for r in rows), np.uint32).tolist()
        assert ids == [*library.encode(t, add_special_tokens=False).ids, 1]
        assert all(r.doc_tokens == len(ids) for r in rows) and [r.start for r in rows] == np.cumsum([0, *(r.length for r in rows[:-1])]).tolist()
    assert {packing.piece_lengths(n, 8)[-1] for n in (8, 16, 24)} == {8} and packing.piece_lengths(15, 8) == [8, 4, 2, 1]


def test_buckets_of_equal_lengths(spark, docs, tmp_path):
    pieces = packing.pack_power_of_two(docs)
    packing.write_buckets(pieces, str(tmp_path / "b"))
    back = spark.read.parquet(str(tmp_path / "b"))
    assert back.count() == pieces.count() and back.where("length <> pow(2, bucket)").count() == 0
    assert {p.name for p in (tmp_path / "b").glob("bucket=*")} == {f"bucket={r.bucket}" for r in pieces.select("bucket").distinct().collect()}


def test_packing_digest(spark, sf_dir, texts, library):
    for r in queries.op1_packing(spark, sf_dir).where("start = 0").limit(40).collect():
        ids = [*library.encode(texts[r.doc_id], add_special_tokens=False).ids, 1][: r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_counts(spark, sf_dir, texts, library):
    for r in queries.op9_token_counts(spark, sf_dir).collect():
        n = len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(texts[r.doc_id].encode()), n > 2048)


def brute_components(texts):
    sets = {}
    for i, t in texts.items():
        w = t.lower().split() if t.isascii() else [x for x in "".join(c.lower() if c.isascii() else c for c in t).replace("\x0b", " ").translate({9: " ", 10: " ", 12: " ", 13: " "}).split(" ") if x]
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    at = {i: i for i in texts}

    def root(x):
        while at[x] != x:
            x = at[x]
        return x

    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                x, y = sorted((root(a), root(b)))
                at[y] = x
    return {i: (len(sets[i]), root(i)) for i in texts}


def test_near_duplicates_of_a_chain_and_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    first = [word() for _ in range(60)]
    rows, chain = {}, list(first)
    for i in range(40):  # each is like its neighbours only
        rows[i] = " ".join(chain)
        chain = chain[2:] + [word(), word()]
    second = [word() for _ in range(120)]
    for i in range(40, 110):  # copies of one original, many unlike each other
        own = list(second)
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(len(own))] = word()
        rows[i] = " ".join(own)
    for i in range(110, 130):
        rows[i] = " ".join([*(word() for _ in range(80)), *first[:20]])
    got = near_dedup.near_duplicates(spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(5)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows)


@pytest.mark.parametrize("most", [0, 10, 100_000])
def test_components(spark, monkeypatch, most):
    """In one task, by stars, and by both, against union-find."""
    monkeypatch.setattr(near_dedup, "ONE_TASK", most)
    rng = random.Random(most)
    pairs = [(i, i + 1) for i in range(1000, 1040)] + [(5, i) for i in range(2000, 2050)] + [tuple(rng.sample(range(300), 2)) for _ in range(200)] + [(2049, 1040)]
    at = {x: x for p in pairs for x in p}

    def root(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        at[y] = x
    links = spark.createDataFrame(pairs, "a long, b long").repartition(6)
    got = {r.id: r.component for r in near_dedup.components(links).collect()}
    assert got == {x: root(x) for x in at if root(x) != x}
    assert near_dedup.components(links.limit(0)).count() == 0


def test_asked_by_bits(spark, monkeypatch):
    """Beyond FEW_IDS ids are told by bits: none that is asked for is left out, few others pass."""
    rows, ids = spark.range(20_000), spark.range(0, 20_000, 100)
    monkeypatch.setattr(near_dedup, "FEW_IDS", 10)
    some = {r.id for r in near_dedup._asked(rows, ids).collect()}
    assert some >= set(range(0, 20_000, 100)) and len(some) < 260
    monkeypatch.setattr(near_dedup, "FEW_IDS", 10_000)
    assert {r.id for r in near_dedup._asked(rows, ids).collect()} == set(range(0, 20_000, 100))


def test_sequential_bounds():
    least = near_dedup.least_matches(0.75, 1e-6)
    assert len(least) == near_dedup.PERMUTATIONS // near_dedup.BATCH and list(least) == sorted(least)
    assert 0.5 < least[-1] / near_dedup.PERMUTATIONS < 0.75


def test_topk_blocks():
    rng = np.random.default_rng(1)
    x = np.floor(256 * rng.normal(size=(300, 24)))
    x[50:80] = x[0]
    ids = rng.permutation(300)
    got = topk.block_topk(ids[:40], x[:40], ids, x, 5)
    want = []
    for i in range(40):
        s = sorted((-int(x[i] @ x[j]), ids[j]) for j in range(300) if j != i)[:5]
        want += [(ids[i], j, -v) for v, j in s]
    assert [tuple(map(int, r)) for r in got] == [tuple(map(int, r)) for r in want]


def test_topk_floors():
    """What floors and whole blocks leave out is not among the best: the best of all blocks stay the same."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(6, 20)) * 3
    x = np.floor(256 * (centres[np.arange(600) // 100] + rng.normal(size=(600, 20)) / 4))
    ids = np.arange(600)
    floors = topk.floors_of(ids[::9], x[::9], ids[::5], x[::5], 5)
    got, skipped = defaultdict(list), 0
    for begin in range(0, 600, 100):
        rows = topk.block_topk(ids[::9], x[::9], ids[begin : begin + 100], x[begin : begin + 100], 5, floors=floors)
        skipped += len(ids[::9]) - len({r[0] for r in rows})
        for q, i, score in rows:
            got[q].append((-score, i))
    assert skipped > 100
    for q in ids[::9]:
        assert sorted(got[q])[:5] == sorted((-int(x[q] @ x[j]), j) for j in range(600) if j != q)[:5]


def test_bounds_are_bounds():
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(50, 30)), rng.normal(size=(50, 30))
    last = np.zeros(50)
    for s in (1, 4, 16):
        (ma, da), (mb, db) = topk.segment_statistics(a, s), topk.segment_statistics(b, s)
        low = ((ma - mb) ** 2).sum(1) + ((da - db) ** 2).sum(1)
        assert (low <= ((a - b) ** 2).sum(1) + 1e-9).all()
        last = low


def test_raking(spark):
    rows = [("a", "en", "x", 100), ("a", "de", "x", 50), ("b", "en", "y", 30), ("b", "de", "x", 20), ("b", "de", "y", 200)]
    df = spark.createDataFrame([(i, *r[:3], r[3]) for i, r in enumerate(rows)], "doc_id long, source string, lang string, topic string, n long")
    goal = {"source": {"a": 0.5, "b": 0.5}, "lang": {"en": 0.4}, "topic": {"x": 0.6, "y": 0.4}}
    got = mixing.mix(df, goal, keep=0.3, tokens=F.col("n"), topic=F.col("topic"), text_col="source").collect()
    w = np.array([float(r[3]) for r in rows])
    for _ in range(500):
        for dim, shares in ((0, {"a": 0.5, "b": 0.5}), (1, {"en": 0.4, "de": 0.6}), (2, {"x": 0.6, "y": 0.4})):
            for v, s in shares.items():
                at = [i for i, r in enumerate(rows) if r[dim] == v]
                w[at] *= s * 400 / w[at].sum()
    p = {r.doc_id: r.mix_probability for r in got}
    for i, r in enumerate(rows):
        assert p[i] == pytest.approx(min(1, 0.3 * w[i] / r[3]), abs=1e-5)


def test_both_ways_of_raking(spark):
    rng = random.Random(6)
    rows = [(rng.choice("abcd"), rng.choice(["en", "de", ""]), f"t{rng.randrange(5)}", rng.choice([0, *range(1, 400)])) for _ in range(300)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long").groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens"))
    for targets in (None, {"source": {"a": 0.5, "b": 0.2}, "lang": {"en": 0.9}}):
        one, many = (mixing.fit_cells(cells, targets, few=n) for n in (1000, 0))
        key = ["source", "lang", "topic"]
        one, many = (x.toPandas().sort_values(key).reset_index(drop=True) for x in (one, many))
        assert np.allclose(one.weight, many.weight) and np.allclose(one.probability, many.probability) and np.allclose(one.share_lang, many.share_lang)
    shares = mixing.marginals(mixing.fit_cells(cells, {"source": {"a": 0.5, "b": 0.2}}, keep=0.05)).toPandas()
    assert np.allclose(shares.target, shares.raked, atol=1e-6) and np.allclose(shares.raked, shares.realised, atol=1e-6)
    assert shares[(shares.dimension == "source") & (shares.value == "a")].raked.item() == pytest.approx(0.5)
    assert set(shares.groupby("dimension").raked.sum().round(9)) == {1.0}


def brute_mixture(rows, model, keep=0.8, temper=0.7):
    """{id: (topic, words, probability, kept)} of (id, source, lang, text), one cell and one text after the other."""
    slots, found, cells = topics.Slots(), {}, Counter()
    for i, source, lang, text in rows:
        words = (text or "").encode().lower().split()
        x = np.zeros(topics.DIMS)
        for w, n in Counter(words).items():
            x[slots[w]] += math.log(1 + n)
        topic = f"topic{int((model.centroids @ (x * model.idf)).argmax())}" if words else topics.NONE
        found[i] = (source or "", lang or "", topic), len(words)
        cells[found[i][0]] += len(words)
    total, weight = sum(cells.values()), {c: float(n) for c, n in cells.items()}
    for _ in range(50):
        for d in range(3):
            tokens, have = Counter(), Counter()
            for c, n in cells.items():
                tokens[c[d]] += n
                have[c[d]] += weight[c]
            raw = {v: n**temper for v, n in tokens.items() if n}
            for c in cells:
                weight[c] *= raw.get(c[d], 0) / sum(raw.values()) * total / have[c[d]] if have[c[d]] else 0
    low, high = 0.0, 1e9
    for _ in range(200):  # the scale at which `keep` of the tokens are expected
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(n, mid * weight[c]) for c, n in cells.items()) < keep * total else (low, mid)
    out = {}
    for i, (c, n) in found.items():
        p = min(1.0, low * weight[c] / cells[c]) if cells[c] else 0.0
        u = int(hashlib.md5(f"mix|{i}".encode()).hexdigest()[:12], 16) / 2**48
        out[i] = c[2], n, p, n > 0 and u < p
    return out


def test_mixing_against_brute_force(spark, sf_dir, docs):
    rows = [(r.doc_id, r.source, r.lang, r.text) for r in docs.collect()]
    want = brute_mixture(rows, topics.fit(docs))
    got = queries.op4_mixing(spark, sf_dir).collect()
    assert len(got) == len(rows) and len({r.topic for r in got}) > 3
    for r in got:
        topic, n, p, kept = want[r.doc_id]
        assert (r.topic, r.n_tokens) == (topic, n) and r.probability == pytest.approx(p, abs=2e-6)
        assert r.kept == kept or abs(p - r.probability) < 1e-6


def test_mixing_probabilities(docs):
    got = mixing.mix(docs, keep=0.7).toPandas()
    assert (got.mix_tokens * got.mix_probability).sum() == pytest.approx(0.7 * got.mix_tokens.sum(), rel=1e-6)
    assert got.mix_probability.between(0, 1).all()


def nearest_by_hand(model, text):
    """The language with the centroid nearest by cosine, one n-gram after the other."""
    low = " " + " ".join("".join(c.lower() if c.isascii() else c for c in text if True).translate({i: " " for i in range(128) if not chr(i).isalpha()}).split(" ")) + " "
    b = b" " + b" ".join(low.encode().split()) + b" "
    x = np.zeros(language_id.DIMS, np.float32)
    for k, (plus, times) in enumerate(((0, 2654435761), (1 << 25, 2246822519), (1 << 26, 3266489917)), 1):
        for i in range(len(b) - k + 1):
            x[((int.from_bytes(b[i : i + k], "big") + plus) * times % (1 << 32)) >> 19] += 1
    x = np.log1p(x) * model.idf
    cosine = model.centroids @ (x / np.linalg.norm(x))
    return model.languages[model.owner[cosine.argmax()]], float(cosine.max())


def test_languages_against_brute_force(spark, sf_dir, docs, texts):
    fold = lambda i: F.crc32(i.cast("string").cast("binary")) % 3 == 1
    model = language_id.fit(language_id.labelled_sample(docs, "doc_id", "text", "lang", fold, 400))
    for r in queries.op6_language_id(spark, sf_dir).collect():
        t = texts[r.doc_id]
        if any(c.isalpha() for c in t):
            lang, score = nearest_by_hand(model, t)
            assert r.score == pytest.approx(score, abs=1e-4) and (r.lang_pred == lang or len(t) < 20)
        else:
            assert (r.lang_pred, r.score) == ("und", 0.0)


def slow_tree(train, depth):
    """Context-tree weighting by recursion over a dictionary of counts, every context kept."""
    counts = defaultdict(Counter)
    for t in train:
        p = b"\0" * depth + t
        for i in range(depth, len(p)):
            for d in range(depth + 1):
                for bit in range(8):
                    counts[(p[i - d : i], (1 << bit) | (p[i] >> (8 - bit)))][(p[i] >> (7 - bit)) & 1] += 1
    contexts = {c for c, _ in counts}
    kt = lambda c: math.lgamma(c[0] + 0.5) + math.lgamma(c[1] + 0.5) - math.log(math.pi) - math.lgamma(c[0] + c[1] + 1)
    known = {}

    def weigh(c, node):
        if (c, node) not in known:
            own = kt(counts.get((c, node), Counter()))
            below = [bytes([b]) + c for b in range(256) if len(c) < depth and bytes([b]) + c in contexts]
            if not below:
                known[c, node] = own, 1.0
            else:
                total = sum(weigh(x, node)[0] for x in below)
                known[c, node] = np.logaddexp(own, total) - math.log(2), 1 / (1 + math.exp(min(total - own, 700)))
        return known[c, node]

    def byte(context, x):
        out = 0.0
        for bit in range(8):
            node, p = (1 << bit) | (x >> (8 - bit)), 0.5
            for d in range(depth, -1, -1):
                c = context[depth - d :]
                if c not in contexts:
                    continue
                n = counts.get((c, node), Counter())
                stop = weigh(c, node)[1]
                p = stop * (n[1] + 0.5) / (n[0] + n[1] + 1) + (1 - stop) * p
            out += math.log10(p if (x >> (7 - bit)) & 1 else 1 - p)
        return out

    return lambda t: sum(byte((b"\0" * depth + t)[i : i + depth], x) for i, x in enumerate(t))


def scores_by_recursion(spark, texts, held, depth, **options):
    rows = list(enumerate(t.decode("utf-8") for t in texts))
    got = lm_scoring.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), held_out=lambda i: i.isin(held), depth=depth, **options).collect()
    slow = slow_tree([t for i, t in enumerate(texts) if i not in held], depth)
    assert len(got) == len(texts)
    for r in got:
        assert r.score == pytest.approx(slow(texts[r.doc_id]), rel=1e-7, abs=1e-9), (depth, texts[r.doc_id][:30])


@pytest.mark.parametrize("depth,few", [(0, False), (1, True), (2, False), (4, True), (6, False)])
def test_scores_against_recursion(spark, depth, few):
    texts = [b"abracadabra abracadabra", b"abba", b"barbara", b"abracadabra", b"xyz", b"a", b"barb\xc3\xa9", b""]
    scores_by_recursion(spark, texts, [3, 4, 5, 6, 7], depth, **({"entries": 3, "frequent": 2} if few else {}))


def test_all_scores_against_recursion(spark, sf_dir, texts):
    held = [i for i in sorted(texts) if zlib.crc32(str(i).encode()) % 7 == 2]
    order = sorted(texts)
    own = [texts[i].encode() for i in order]
    scores_by_recursion(spark, own, [order.index(i) for i in held], 2)


def test_scores_are_probabilities(spark):
    rows = [(0, "the cat sat on the mat and the dog sat on the log"), *((i, "the ca" + chr(i)) for i in range(1, 128))]
    got = lm_scoring.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), held_out=lambda i: i > 0).where("doc_id > 0").collect()
    less = lm_scoring.score_texts(spark.createDataFrame([*rows[:1], (1, "the ca")], "doc_id long, text string"), held_out=lambda i: i > 0).where("doc_id > 0").first()
    assert 0.9 < sum(10 ** (r.score - less.score) for r in got) < 1


def test_scores_of_held_out_texts(spark, sf_dir, texts):
    got = queries.op5_lm_scoring(spark, sf_dir).toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 7 == 2 for i in got.doc_id]).all()
    train = [t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    lower = lambda t: t.encode().lower().split()
    counts = Counter(w for t in train for w in lower(t))
    total, distinct = sum(counts.values()) + len(train), len(counts) + 1
    for r in got.itertuples():
        c = [counts[w] for w in lower(texts[r.doc_id])] + [len(train)]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(c), sum(x > 0 for x in c), total)
        assert r.base_score == pytest.approx(sum(math.log10((x + 1) / (total + distinct + 1)) for x in c), abs=1e-6)
    held = got[got.held_out]
    assert (held.bits_per_byte * held.n_bytes).sum() / held.n_bytes.sum() < 3.0


def test_words_beyond_the_broadcast(docs):
    few = lm_scoring.score_texts(docs, frequent=20).select("doc_id", "base_score", "n_known").toPandas().sort_values("doc_id")
    many = lm_scoring.score_texts(docs).select("doc_id", "base_score", "n_known").toPandas().sort_values("doc_id")
    assert np.allclose(few.base_score, many.base_score) and (few.n_known.values == many.n_known.values).all()


def test_language_accuracy(spark, docs, sf_dir):
    got = queries.op6_language_id(spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert len(held) > 30 and (held.lang == held.lang_pred).mean() > 0.97
    assert got.rejected.mean() < 0.02


def test_strange_texts_are_rejected(spark, docs):
    noise = random.Random(1)
    odd = spark.createDataFrame([(10_000 + i, "".join(noise.choices("中文日本語漢字仮名交文章", k=300)), "en") for i in range(5)], "doc_id long, text string, lang string")
    model = language_id.identify_languages(docs.select("doc_id", "text", "lang").union(odd), held_out=lambda i: i >= 10_000)
    assert model.where("doc_id >= 10000 AND NOT rejected").count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 4096, 70001])
def test_permutation(n):
    assert sorted(training_order.feistel(np.arange(n), n, 9).tolist()) == list(range(n))


def slot_by_hand(index, n, key, rounds=6):
    """The permutation with Python's numbers, one index at a time."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    keys = [int(k) for k in np.random.default_rng(key).integers(1 << 63, size=rounds, dtype=np.uint64)]
    full = 1 << 64
    while True:
        left, right = index >> half, index & ((1 << half) - 1)
        for k in keys:
            f = (right ^ k) * 0x9E3779B97F4A7C15 % full
            f = (f ^ (f >> 32)) * 0xD6E8FEB86659FD93 % full
            left, right = right, left ^ ((f >> 40) & ((1 << half) - 1))
        index = (left << half) | right
        if index < n:
            return index


def test_training_order_slot_by_slot(spark, docs, texts, library, tmp_path):
    path = str(tmp_path / "shards")
    got = training_order.write_training_order(docs, path, length=128, a_shard=50).toPandas().sort_values("slot")
    buckets = defaultdict(list)
    for r in training_order.placed(docs, "doc_id", "text").drop("text").collect():
        buckets[r.bucket].append((r.id, r.mark))
    want = []
    for b in sorted(buckets):
        stream = []
        for i, _ in sorted(buckets[b]):
            stream += [*library.encode(texts[int(i)], add_special_tokens=False).ids, 1]
        want += [stream[i : i + 128] for i in range(0, len(stream), 128)]
    by_slot = {slot_by_hand(i, len(want), 17): x for i, x in enumerate(want)}
    assert got.slot.tolist() == list(range(len(want)))
    for r in got.itertuples():
        assert np.frombuffer(r.ids, np.uint16).tolist() == by_slot[r.slot] and r.n_ids == len(by_slot[r.slot])
        assert (r.shard, r.byte_offset, r.ids_crc32) == (r.slot // 50, r.slot % 50 * training_order.stride(128), zlib.crc32(r.ids))
    again = training_order.read_records(spark, path, 128, 50, first_slot=77).toPandas().sort_values("slot")
    assert again.slot.tolist() == list(range(77, len(got))) and again.ids_crc32.tolist() == got.ids_crc32.tolist()[77:]


def test_training_order_is_that_of_the_rows(spark, docs, tmp_path):
    """Other splits, the same shards; a finished step is not done again."""
    few = docs.where("doc_id % 4 = 0")
    one = training_order.write_training_order(few, length=64).orderBy("slot").collect()
    path = str(tmp_path / "shards")
    assert training_order.write_training_order(few.repartition(7), path, length=64).orderBy("slot").collect() == one
    assert training_order.write_training_order(few.limit(0), path, length=64).orderBy("slot").collect() == one
    assert [training_order.shard_size(n) for n in (1, 2048 * 2048, 2048 * 2048 + 1, 10**12)] == [2048, 2048, 4096, 65536]


def test_wide_ids(spark, tmp_path):
    """A vocabulary beyond 16 bits, by a file that the library has to cut itself."""
    from tokenizers import models, pre_tokenizers

    own = Tokenizer(models.WordLevel({f"w{i}": i for i in range(70_000)}, unk_token="w0"))
    own.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    own.save(path := str(tmp_path / "wide.json"))
    docs = spark.createDataFrame([(1, "w69999 w5"), (2, "w65536")], "doc_id long, text string")
    got = training_order.write_training_order(docs, length=8, tokenizer=path, end_id=1).collect()
    ids = [np.frombuffer(r.ids, np.uint32).tolist() for r in got]
    assert ids == [[69999, 5, 1, 65536, 1]]
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, path).collect()} == {1: 2, 2: 1}


def in_words(template):
    """A licence as it may stand in a file: every optional region there, each replaceable one by its first wording."""
    t = template.replace("<<var;match={0,20}>>", "2020 Some One").replace("<<var;match={0,12}>>", "http://www.apache.org/licenses/LICENSE-2.0")
    return re.sub(r"<<var;match=([^|>]*)[^>]*>>", r"\1", t.replace("<<beginOptional>>", "").replace("<<endOptional>>", ""))


def labels_of(text):
    w = licenses.words(text.encode())
    line = b" " + b" ".join(w) + b" "
    found = {label for label, x in license_templates.TEMPLATES if licenses.Automaton(x).found(w, line)}
    assert found == {label for label, x in license_oracle.WORDINGS if re.search(" " + x, line.decode())}
    return found


@pytest.mark.parametrize("n", range(len(license_templates.TEMPLATES)))
def test_whole_templates(n):
    """Each automaton against the wording that the oracle has, on the whole text and on texts with a word changed."""
    (label, template), (same, wording) = license_templates.TEMPLATES[n], license_oracle.WORDINGS[n]
    automaton, pattern = licenses.Automaton(template), re.compile(" " + wording)
    assert label == same

    def accepts(text):
        w = licenses.words(text.encode())
        line = b" " + b" ".join(w) + b" "
        found = automaton.found(w, line)
        assert found == bool(pattern.search(line.decode())), text
        return found

    own = in_words(template).split()
    assert accepts("before " + " ".join(own) + " after") and accepts(" ".join(own).upper())
    assert not accepts(" ".join(own[:-1])) and not accepts(" ".join([*own[:-1], "otherwise"]))
    rng, left = random.Random(n), 0
    for _ in range(60):
        i = rng.randrange(len(own))
        left += accepts(" ".join(rng.choice([[*own[:i], "otherwise", *own[i + 1 :]], own[:i] + own[i + 1 :], [*own[:i], "not", *own[i:]]])))
    assert left < 30


def test_license_wording():
    mit = in_words(next(t for label, t in license_templates.TEMPLATES if label == "mit" and "Permission" in t))
    assert labels_of(mit.replace("(including the next paragraph)", "")) == {"mit"}
    assert labels_of(mit.replace("free of charge", "for a charge")) == set()
    assert labels_of(mit.replace("authors or copyright holders", "people at Acme")) == {"mit"}
    assert labels_of("Released under the MIT License.") == {"mit"} and labels_of("Refused under the MIT License.") == set()
    assert labels_of("Licensed under the Apache License, Version 2.0.") == labels_of("licensed under the apache license 2.0") == {"apache-2.0"}
    assert labels_of("This work is licensed under the GNU General Public License, version 3.") == {"gpl-3.0"}
    assert labels_of("Licensed under CC BY-NC 4.0.") == {"cc-by-nc-4.0"} and labels_of("Licensed under CC BY 4.0") == {"cc-by-4.0"}
    bsd = in_words(next(t for label, t in license_templates.TEMPLATES if label == "bsd-3-clause"))
    assert labels_of(bsd) == {"bsd-3-clause"}
    assert labels_of(bsd[: bsd.index("WARRANTIES, INCLUDING")] + "WARRANTIES are hereby fully granted and nothing is disclaimed") == set()
    with pytest.raises(ValueError):
        licenses.parse("a <<beginOptional>> b")


def test_a_long_text_of_phrases(spark):
    rows = [(1, "MIT License, General Public License. licensed under " * 200_000)]
    began = time.perf_counter()
    r = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).first()
    assert (r.n_base, r.first_word, r.last_word, r.n_words, r.base_labels) == (400_000, 0, 7 * 199_999 + 2, 1_400_000, "gpl,mit")
    assert time.perf_counter() - began < 60


def test_pipeline_against_brute_force(spark, docs, sf_dir, texts):
    """Each stage on what the one before kept."""
    now, kept = docs, dict(texts)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, sf_dir).cache()
        left = {r.doc_id for r in now.collect()}
        if name == "language":
            assert len(left) >= 0.98 * len(kept) and left <= set(kept)
        elif name == "copies":
            best = {}
            for i, t in kept.items():
                key = "".join(c for c in t if c not in " \t\n\x0b\x0c\r")
                best[key] = min(best.get(key, (1, 0)), (-len(t), i))
            assert left == {i for _, i in best.values()}
        elif name == "near_copies":
            assert left == {i for i, (_, c) in brute_components(kept).items() if i == c}
        else:
            assert 0.6 * len(kept) < len(left) < len(kept)
        kept = {i: kept[i] for i in left}
    out = corpus_pipeline.STAGES[-1][1](spark, now, sf_dir)
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == set(kept)
    assert corpus_pipeline.run(spark, sf_dir).count() == out.count()


def plain_kmeans(x, k, rounds=12):
    """Unit centroids of unit rows, all in one array; seeds are the row nearest the mean and then those farthest from all seeds."""
    unit = lambda v: v / np.linalg.norm(v)
    seeds = [int((x @ x.mean(0)).argmax())]
    while len(seeds) < min(k, len(x)):
        seeds.append(int((x @ x[seeds].T).max(1).argmin()))
    c = x[seeds]
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        c = np.stack([unit(x[near == j].mean(0)) if (near == j).any() else c[j] for j in range(len(c))])
    return c


def test_topics_learn_from_every_text(spark):
    noise, rows = random.Random(3), []
    for i in range(4500):
        own = [f"w{i % 9}_{noise.randrange(60)}" for _ in range(30)]
        rows.append((i, " ".join(own + [f"common{noise.randrange(40)}" for _ in range(noise.randrange(5, 20))])))
    docs = spark.createDataFrame([*rows, (-1, None), (-2, " \n")], "doc_id long, text string")
    model, again = topics.fit(docs.repartition(3)), topics.fit(docs.orderBy("text").coalesce(2))
    assert (model.centroids == again.centroids).all() and (model.idf == again.idf).all()
    x, slots = np.zeros((len(rows), topics.DIMS)), topics.Slots()
    for row, (_, text) in zip(x, rows):
        for w, n in Counter(text.encode().split()).items():
            row[slots[w]] += math.log1p(n)
    assert np.allclose(model.idf, np.log((1 + len(rows)) / (1 + (x > 0).sum(0))) + 1)
    x = np.stack(sorted(x, key=lambda row: (np.flatnonzero(row).astype(np.uint16).tobytes(), row[row > 0].astype(np.float32).tobytes()))) * model.idf
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert np.allclose(model.centroids, plain_kmeans(x, 8), atol=1e-5)


def test_languages_learn_from_every_text(spark):
    noise, rows = random.Random(4), []
    for i in range(1300):
        lang = "ab"[i % 2]
        rows.append((i, " ".join("".join(noise.choices("abcdefgh" if lang == "a" else "ghijklmn", k=6)) for _ in range(12)), lang))
    docs = spark.createDataFrame([*rows, (-1, None, "a"), (-2, "12 !", "a"), (-3, "xyz", None), (-4, "12", "c")], "doc_id long, text string, lang string")
    model = language_id.fit(language_id.labelled_sample(docs.repartition(3), "doc_id", "text", "lang", lambda i: F.lit(False)))
    counts = np.stack([language_id.ngram_counts(text.encode()) for _, text, _ in rows])
    assert np.allclose(model.idf, np.log((1 + len(rows)) / (1 + (counts > 0).sum(0))) + 1)
    for g, lang in enumerate("ab"):
        x = model.vectors(counts[[i for i, r in enumerate(rows) if r[2] == lang]].astype(np.float32)).astype(float)
        want = plain_kmeans(x, 3)
        assert np.allclose(model.centroids[model.owner == g], want, atol=1e-5)
        assert model.floors[g] == pytest.approx(0.35 * np.quantile((x @ want.T).max(1), 0.01), abs=1e-5)
    kept = language_id.keep_identified(docs).collect()
    assert {r.doc_id for r in kept if r.doc_id >= 0} == set(range(1300)) and not {-1, -2, -4} & {r.doc_id for r in kept}


def test_words_of_many_texts_as_of_one():
    plain = ["", " ", "one", " a b\x0b\x0c\r\nA\tB ", "É é \x85 x\x1cy   y", "\x00 \x00a", "w " * 3000, "x" * (1 << 20) + " y", *(f"w{i % 7} w{i} W{i}" for i in range(300))]
    broken = pa.array([bytes(random.Random(i).choices(b" \t\n\x0b\x0c\rAa\xc3\xa9\xff\x00\x1c\x85", k=30)) for i in range(300)], pa.binary())
    for texts in (pa.array(plain), pa.array(plain).slice(3, 200), pa.Array.from_buffers(pa.string(), len(broken), broken.buffers())):
        bunches = list(topics._bunches(texts))
        assert sum(map(len, bunches)) == len(texts) and max(map(len, bunches)) <= 128 and all(len(b) == 1 or b.nbytes < 1 << 21 for b in bunches)
        n, lens, slots, weights = map(np.concatenate, zip(*map(topics.weighed_words, bunches)))
        ends, known = np.cumsum(lens), topics.Slots()
        for i, text in enumerate(texts.cast(pa.binary()).to_pylist()):
            want, words = Counter(), text.lower().split()
            for w, k in Counter(words).items():
                want[known[w]] += math.log1p(k)
            own = slice(ends[i] - lens[i], ends[i])
            assert n[i] == len(words) and slots[own].tolist() == sorted(want)
            assert np.allclose(weights[own], [want[s] for s in sorted(want)], rtol=1e-6)


def test_blocks_hold_every_vector(spark):
    noise, rows = random.Random(5), []
    for i in range(1000):
        at = sorted(noise.sample(range(1 << 16), noise.randrange(1, 40)))
        rows.append((i % 3, np.array(at, np.uint16).tobytes(), np.array([noise.random() for _ in at], np.float32).tobytes()))
    blocks = clusters.blocks(spark.createDataFrame(rows, clusters.ROWS).repartition(2))
    back = blocks.mapInArrow(clusters.opened, clusters.ROWS).collect()
    assert sorted((r["group"], bytes(r["slots"]), bytes(r["weights"])) for r in back) == sorted(rows)
    assert blocks.agg(F.sum("vectors")).first()[0] == 1000 and blocks.count() < 20


def test_topics_pass_over_blocks(spark, monkeypatch):
    read, begin = [], clusters.Passes.__init__
    monkeypatch.setattr(clusters.Passes, "__init__", lambda self, rows, *a: (read.append(rows), begin(self, rows, *a))[1])
    docs = spark.range(2000).select(F.concat_ws(" ", F.lit("a"), F.col("id") % 5, F.col("id") % 7).alias("text"))
    assert len(topics.fit(docs.coalesce(1)).centroids) == 8
    assert [r.count() for r in read] == [16]  # Spark's rows in each of the passes, not 2,000


def test_passes_open_blocks_quickly_and_take_no_needless_cosines(spark, monkeypatch):
    rows = [(g, np.array([s, s + 1 + g], np.uint16).tobytes(), np.array([1, 2 + s], np.float32).tobytes()) for g in range(2) for s in range(6)]
    blocks = clusters.blocks(spark.createDataFrame(rows, clusters.ROWS).coalesce(1)).toArrow().to_batches()
    held = b"".join(b.as_py() for batch in blocks for b in batch.column(0))
    assert b"\x04\x22\x4d\x18" in held and b"\x28\xb5\x2f\xfd" not in held  # LZ4's frames, not Zstandard's

    idf, centroids, have = np.linspace(1, 2, 9), np.random.default_rng(3).random((2, 2, 9)).astype(np.float32), np.array([2, 1])
    (_, v), x = next(clusters.vectors(blocks, idf)), np.zeros((12, 9))
    for i, (_, at, w) in enumerate(rows):
        x[i, np.frombuffer(at, np.uint16)] = np.frombuffer(w, np.float32)
    x, group = clusters.unit(x * idf), np.repeat([0, 1], 6)
    want = np.einsum("id,kid->ik", x, centroids[:, group])
    want[group == 1, 1] = -np.inf
    assert np.allclose(v.cosines(centroids, have), want)

    # The sum of all rows of a group is the same wherever its only centroid is.
    monkeypatch.setattr(clusters.Vectors, "cosines", None)
    monkeypatch.setattr(clusters, "_added", lambda parts: {c: np.frombuffer(s, np.int64) for p in parts for c, s in zip(*(col.to_pylist() for col in p.columns))})
    here = SimpleNamespace(sparkSession=spark, mapInArrow=lambda f, schema: list(f(blocks)))
    sums = clusters.Passes(here, idf, 2).sums(centroids[:1], np.ones(2, int))
    assert [sums[g].tolist() for g in range(2)] == [np.rint(x[group == g] * clusters.ONE).sum(0).tolist() for g in range(2)]


def test_a_join_by_topic_makes_topics_once(docs):
    """A stage has one Python operator: with two, an executor's tasks keep twice as many workers."""
    plan = mixing.mixed_sample(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_no_rows_go_through_a_python_rdd(spark, docs, monkeypatch):
    """Its workers are others than those of the operators, and stay in memory beside them."""
    monkeypatch.setattr(spark.sparkContext, "parallelize", lambda *a: pytest.fail("an RDD of Python rows"))
    assert language_id.keep_identified(docs).count() > 0
