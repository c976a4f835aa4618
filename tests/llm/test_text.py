"""Operators on texts: exact results, brute force, and nulls, empty tables and clashing columns."""

import hashlib
import random

import pytest
import sentencepiece

import public_tokenizers
from tellurion.llm import language, mixing, neardup, packing, pieces, toxicity

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SHAPE = "doc_id long, text string, lang string, source string, n_chars long"
EDGE = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "!!! ...", "en", None, 7), (4, "x " * 30_000, "en", "a", 60_000), (4, "x " * 30_000, "en", "a", 60_000), (None, "free text", None, "b", 9)]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, SHAPE)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def test_pieces_equal_the_library():
    codec, sp = pieces.PieceCodec(pieces.load_tables(MODEL)), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(3)
    alphabet = " abcdehinorst\n\t.,!?-_(){}'\"019éüßж日本ा▁😀A\u0000²."
    texts = ["", " ", "   a", "a   ", " " * 33, "▁", "a▁▁b", "</s><0x41>", "a" * 500, "0" * 40] + ["".join(rng.choices(alphabet, k=rng.randint(1, 60))) for _ in range(1500)]
    for t in texts:
        ids = sp.encode(t, add_eos=True)
        assert codec.encode(t) == ids, t
        assert codec.decode(ids) == sp.decode(ids), t


def test_piece_digests(spark, edge):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for r, (doc_id, text, *_) in zip(pieces.piece_digests(edge.coalesce(1), MODEL).collect(), EDGE, strict=True):
        ids = sp.encode(text or "", add_eos=True)
        assert (r.doc_id, r.n_tokens) == (doc_id, len(ids))
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    back = pieces.decode_documents(pieces.encode_documents(edge, MODEL), MODEL).collect()
    assert all(r.decoded == (r.text or "") for r in back)
    assert pieces.piece_digests(edge.limit(0), MODEL).count() == 0


def test_language(spark, docs, edge):
    params = language.LanguageParams(train_docs=100)
    model = language.fit_language_model(docs.where(~language.held_out(docs.doc_id)), params)
    got = language.identify(docs.where(language.held_out(docs.doc_id)), model).collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)
    got = language.identify(edge.withColumn("score", edge.n_chars), model).collect()
    assert [r.lang_pred == "und" for r in got] == [True, True, True, False, False, False]
    assert all(0 <= r.score <= 1 for r in got)
    none = language.fit_language_model(edge.limit(0))
    assert none.predict("words") == ("und", 0.0)


def test_backoff_prefers_words():
    import numpy as np

    m = language.LanguageModel(["a", "b"], np.array([[1, 2], [2, 1], [3, 1]], dtype=np.float32), {"ab": 0}, [{"x": 1}, {" x": 2}], 9.0, "k")
    assert m.word("ab").tolist() == [1, 2]
    assert m.word("xq").tolist() == [3, 1]  # " x" is known, so "x" isn't looked up
    assert m.word("qx").tolist() == [2, 1]
    assert m.word("zz").tolist() == [9, 9]


def test_toxicity(spark, edge):
    rng = random.Random(5)
    clean = [" ".join(rng.choices("one two three four five six seven".split(), k=40)) for _ in range(300)]
    rows = [(i, t + (" vile" * (1 + i % 3) if i % 3 == 0 else ""), int(i % 3 == 0)) for i, t in enumerate(clean)]
    d = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, x) for i, _, x in rows] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(d, labels)
    got = {r.doc_id: r for r in toxicity.score_severity(d.withColumn("grade", d.doc_id), model).collect()}
    assert all(got[i].toxic == bool(x) for i, _, x in rows)
    assert model.thresholds == sorted(model.thresholds)
    one, many = (model.score("one two " + "vile " * k) for k in (1, 9))
    assert sum(many) > sum(one) > sum(model.score("one two"))
    assert not any(r.toxic for r in toxicity.score_severity(edge, model).collect())
    assert toxicity.score_severity(edge.limit(0), model).count() == 0
    toxicity.fit_toxicity(d.limit(0), labels)


def test_ordinal_fit_is_the_least_loss():
    import numpy as np

    rng = np.random.default_rng(9)
    n, words = 200, list("abcd")
    x = rng.poisson(0.7, size=(n, 4))
    grades = np.digitize(x @ [1.0, 0.5, -0.5, 0.0] + rng.logistic(size=n), [0.5, 2.0])
    cols = [np.flatnonzero(r) for r in x]
    vals = [(1 + np.log(r[r > 0])).astype(np.float32) for r in x]
    params = toxicity.ToxicityParams()
    model = toxicity.refit_ordinal(cols, vals, words, grades, 3, params)
    dense = np.zeros((n, 4))
    for k, (c, v) in enumerate(zip(cols, vals, strict=True)):
        dense[k, c] = v

    def loss(b):
        z = dense @ b[:4]
        return sum(np.where(grades > k, np.logaddexp(0, b[4 + k] - z), np.logaddexp(0, z - b[4 + k])).sum() for k in (0, 1)) + params.ridge / 2 * (b[:4] ** 2).sum()

    at = np.array([model.weights[w] for w in words] + model.thresholds)
    for step in [*np.eye(6) * 0.02, *rng.normal(size=(50, 6)) * 0.02]:
        assert loss(at) <= loss(at + step) + 1e-4 and loss(at) <= loss(at - step) + 1e-4


def brute_classes(texts, weights, params):
    parent = {i: i for i in texts}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    found = {i: {s: w for s, w in zip(*[x.tolist() for x in weights.of(t, 5)[::2]], strict=True)} for i, t in texts.items()}
    ids = [i for i in texts if found[i]]
    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = found[i], found[j]
            low = sum(min(a[s], b[s]) for s in a.keys() & b.keys())
            if low >= params.similarity * (sum(a.values()) + sum(b.values()) - low):
                x, y = sorted((top(i), top(j)))
                parent[y] = x
    return {i: top(i) for i in texts}


def test_near_duplicates(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    texts = {}
    for g in range(12):
        base = [word() for _ in range(120)]
        for c in range(g + 1):
            w = list(base)
            for _ in range(c % 4):
                w[rng.randrange(120)] = word()
            texts[len(texts)] = " ".join(w)
    params = neardup.NearDupParams()
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    weights = neardup.Weights(*neardup.document_frequencies(d, params))
    got = {r.doc_id: r["class"] for r in neardup.near_duplicates(d).collect()}
    assert got == brute_classes(texts, weights, params)


def test_near_duplicates_compared_in_blocks_alone(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    texts = {}
    for _ in range(3):
        base = [word() for _ in range(120)]
        for c in range(12):
            w = list(base)
            for _ in range(1 + c % 3):
                w[rng.randrange(120)] = word()
            texts[len(texts)] = " ".join(w)
    params = neardup.NearDupParams(turns=0, block=4)  # all is left to the last step
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    weights = neardup.Weights(*neardup.document_frequencies(d, params))
    got = {r.doc_id: r["class"] for r in neardup.near_duplicates(d, params).collect()}
    want = brute_classes(texts, weights, params)
    assert len(set(want.values())) < len(texts)
    assert got == want


def test_blocks_join_what_brute_force_joins():
    import numpy as np

    rng = random.Random(13)
    base = [str(rng.random()) for _ in range(90)]
    texts = {}
    for i in range(60):
        w = list(base) * (1 + i % 2)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = str(i)
        texts[i] = " ".join(w)
    params = neardup.NearDupParams()
    weights = neardup.Weights(np.zeros((2, 1 << 10)), 60)
    held, ids = [weights.of(t, params.words) for t in texts.values()], np.arange(60)
    links = neardup.links_of_blocks(ids, ids, np.zeros(60), held, params.similarity)
    want = brute_classes(texts, weights, params)
    assert 1 < len(set(want.values())) < 60 and len(links) == 60 - len(set(want.values()))
    assert all(want[a] == want[b] for a, b in links)
    side, halves = (ids >= 30).astype(int), (ids < 30).astype(int) * 100
    for a, b in neardup.links_of_blocks(ids, halves, side, held, params.similarity):
        assert a < 30 <= b and neardup.similar(held[a], held[b], params.similarity)


def test_near_duplicates_of_a_hot_group(spark):
    """Over a thousand near copies of one text, some a little too far from most, others further still, and chains."""
    import numpy as np

    rng = random.Random(17)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    base, texts = [word() for _ in range(100)], []

    def changed(words, n):
        w = list(words)
        for k in rng.sample(range(len(w)), n):
            w[k] = word()
        return w

    texts += [changed(base, rng.choice([0, 1, 1, 2])) for _ in range(1200)]
    texts += [changed(base, rng.choice([3, 4, 5])) for _ in range(120)]
    for _ in range(4):
        link = changed(base, 12)
        for _ in range(25):
            texts.append(link := changed(link, 1))
    texts = [" ".join(w) for w in texts]
    params = neardup.NearDupParams(block=32)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    weights = neardup.Weights(*neardup.document_frequencies(d, params))
    held = [weights.of(t, params.words) for t in texts]
    every, at = np.unique(np.concatenate([f for f, _, _ in held]), return_inverse=True)
    rows = np.repeat(np.arange(len(held)), [len(f) for f, _, _ in held])
    assert max(tf.max() for _, tf, _ in held) == 1
    m = np.zeros((len(held), len(every)), dtype=np.float32)
    m[rows, at] = np.sqrt(np.concatenate([w for _, _, w in held]))
    low, total = m @ m.T, np.array([w.sum() for _, _, w in held])
    near = low / (total[:, None] + total[None] - low) >= params.similarity - 1e-6
    want = np.arange(len(held))
    while True:
        least = np.where(near, want[None], len(held)).min(axis=1)
        if (least == want).all():
            break
        want = least
    assert 10 < len(set(want.tolist())) < 800
    got = {r.doc_id: r["class"] for r in neardup.near_duplicates(d, params).collect()}
    assert [got[i] for i in range(len(held))] == want.tolist()


def test_texts_of_one_id_and_clashing_columns(spark):
    words = [str(k) for k in range(90)]
    a, b, c = " ".join(words[:60]), " ".join(words[30:]), " ".join(words[:59])
    rows = [(5, a), (5, b), (9, b), (7, c), (None, a), (1, None), (5, a)]
    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as node", "2 as class", "3 as t", "4 as copies", "5 as samples")
    got = sorted((str(r.doc_id), str(r["class"])) for r in neardup.near_duplicates(d).collect())
    assert got == sorted([("5", "5"), ("5", "5"), ("5", "5"), ("9", "5"), ("7", "5"), ("None", "None"), ("1", "1")])
    kept = neardup.keep_one(d).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept if r.text) == sorted([("5", a), ("None", a)]) and len(kept) == 3


def test_near_duplicates_edges(spark, edge):
    rows = neardup.near_duplicates(edge).collect()
    assert sorted((str(r.doc_id), str(r["class"])) for r in rows) == sorted((str(i), str(i)) for i, *_ in EDGE)
    assert neardup.near_duplicates(edge.limit(0)).count() == 0
    assert sorted(str(r.doc_id) for r in neardup.keep_one(edge).collect()) == ["1", "2", "3", "4", "None"]


def test_sampling_estimates_similarity():
    import numpy as np

    rng = np.random.default_rng(0)
    found = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    w = rng.random(400).astype(np.float32) + 0.5
    s = neardup.Sampler(2000)
    other = np.concatenate([found[:300], rng.integers(0, 1 << 63, 100, dtype=np.uint64)])
    agree = (s.samples(found, w) == s.samples(other, w)).mean()
    low = w[:300].sum()
    assert abs(agree - low / (2 * w.sum() - low)) < 0.04


def test_packing(spark, docs, edge, tmp_path):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    params = packing.PackParams(row=256, chunk=20_000)
    rows = packing.pack_documents(docs, path, public_tokenizers.PATTERN, params)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=packing.load_ranks(path), special_tokens={})
    back = {r.doc_id: list(r.ids) for r in packing.unpack(rows).collect()}
    assert back == {r.doc_id: enc.encode_ordinary(r.text) for r in docs.collect()}
    packing.write_packed(rows, f"{tmp_path}/packed")
    again = spark.read.parquet(f"{tmp_path}/packed")
    assert {r.doc_id: list(r.ids) for r in packing.unpack(again).collect()} == back
    for r in rows.collect():
        assert len(r.ids) == 2 * params.row and r.cu_seqlens[-1] == r.n_tokens <= params.row
        places = [x for a, b in zip(r.cu_seqlens, r.cu_seqlens[1:], strict=False) for x in range(b - a)]
        assert list(memoryview(r.positions).cast("H"))[: r.n_tokens] == places
    assert sum(r.n_tokens for r in packing.pack_documents(edge, path, public_tokenizers.PATTERN).collect()) == sum(len(enc.encode_ordinary(t or "")) + 1 for _, t, *_ in EDGE)
    assert packing.pack_documents(edge.limit(0), path, public_tokenizers.PATTERN).count() == 0


def test_best_fit_decreasing():
    import numpy as np

    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 101, 500)
    space, want = [], []
    for i in np.argsort(-lengths, kind="stable"):
        fits = [k for k, s in enumerate(space) if s >= lengths[i]]
        if not fits:
            space.append(100)
            fits = [len(space) - 1]
        k = min(fits, key=lambda k: space[k])
        space[k] -= lengths[i]
        want.append(space[k])
    got = packing.best_fit_decreasing(lengths, 100)
    assert sorted(100 - sum(lengths[i] for i in r) for r in got) == sorted(space)


def dense_rates(words, target):
    """The rates by Newton steps on the whole dual at once, sources and bands, in one dense system."""
    import numpy as np

    s, b = words.shape
    wanted, rho = target.sum() * words.sum(0) / words.sum(), mixing.RHO * target.sum()
    x = np.concatenate([np.log(target / words.sum(1)), np.zeros(b)])

    def parts(x):
        eta = x[:s, None] + x[None, s:]
        high = eta > np.log(3)
        e = np.exp(np.minimum(eta, np.log(3)))
        value = (words * np.where(high, 3 * (1 + eta - np.log(3)), e)).sum() - target @ x[:s] - wanted @ x[s:] + rho / 2 * (x[s:] ** 2).sum()
        return value, words * e, np.where(high, 0, words * e)

    for _ in range(200):
        value, w, d = parts(x)
        slope = np.concatenate([w.sum(1) - target, w.sum(0) - wanted + rho * x[s:]])
        second = np.block([[np.diag(d.sum(1) + 1e-9), d], [d.T, np.diag(d.sum(0) + rho)]])
        step, t = np.linalg.solve(second, -slope), 1.0
        while parts(x + t * step)[0] > value and t > 1e-9:
            t /= 2
        x = x + t * step
    return np.minimum(3, np.exp(x[:s, None] + x[None, s:]))


def test_balanced_rates_solve_the_dual(spark):
    import numpy as np

    rng = np.random.default_rng(8)
    words = np.round(rng.gamma(0.5, 1000, size=(9, mixing.BANDS)))
    target = words.sum(1) * rng.uniform(0.05, 2.9, size=9)
    rows = [(None if i == 3 else f"s{i}", float(t), w.tolist()) for i, (w, t) in enumerate(zip(words, target, strict=True))]
    rows += [("full", 3.0 * 50, [50.0] + [0.0] * 19), ("none", 0.0, [0.0] * 20)]
    got = {r.source: np.array(r.rates) for r in mixing.balanced(spark.createDataFrame(rows, "source string, target double, words array<double>")).collect()}
    want = dense_rates(words, target)
    for i, (name, t, w) in enumerate(rows[:9]):
        assert abs(got[name] @ np.array(w) - t) < 1e-8 * t
        assert np.abs(got[name] - want[i])[words[i] > 0].max() < 1e-5
    assert got["full"][0] == 3 and got["none"].max() == 0
    assert np.ptp(want, axis=1).max() > 0.1  # the bands matter


def test_mixing(spark, docs, edge):
    got = mixing.mixed_copies(docs, carry=["doc_id", "source"]).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mixed_copies(docs.repartition(7), carry=["doc_id", "source"]).collect()))
    size, target, taken, least = {}, {}, {}, {}
    for r in got:
        assert r.size == len(docs_words(docs, r.doc_id)) and r.taken <= 3 * r.size
        size[r.source] = size.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
        least.setdefault(r.source, []).append(r.size)
    names = sorted(size)
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    want, open_ = {}, set(names)
    while True:
        left = sum(size.values()) - sum(want.values())
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        full = {s for s in open_ if share[s] > 3 * size[s]}
        if not full:
            want |= share
            break
        want |= {s: 3 * size[s] for s in full}
        open_ -= full
    assert all(abs(want[s] - target[s]) < 1e-6 * want[s] for s in names)
    # Within half of a source's largest document.
    assert all(abs(taken[s] - target[s]) <= max(least[s]) / 2 + 1 for s in names)
    rows = mixing.mixed_copies(edge).collect()
    assert len(rows) == len(EDGE) and all(r.taken <= 3 * r.size for r in rows)
    assert mixing.mixed_copies(edge.limit(0)).count() == 0


def test_mixing_of_equal_rows_and_null_ids(spark):
    rows = [(None, "w " * (i % 5 + 1), "en", "a", 0) for i in range(3000)] + [(i, "w " * (i % 90), "en", "b", 0) for i in range(300)] + [(7, "two words", None, None, 1)] * 500
    d = spark.createDataFrame(rows, SHAPE)
    got = mixing.mixed_rows(d).collect()
    assert len(got) < 400 and sum(r.rows for r in got) == len(rows)
    for s in ("a", "b", None):
        mine = [r for r in got if r._source == s]
        assert abs(sum(r.size * (r.rows * r.copies + r.more) for r in mine) - mine[0].target) <= 1
        assert all(0 <= r.more <= r.rows and r.copies + (r.more > 0) <= 3 for r in mine)


def test_mixing_of_many_sources_writes_few_files(spark, monkeypatch):
    files, write = {}, mixing.written

    def counted(df, tag):
        out = write(df, tag)
        files[tag] = max(files.get(tag, 0), len(out.inputFiles()))
        return out

    monkeypatch.setattr(mixing, "written", counted)
    conf = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        d = spark.createDataFrame([(i, "w " * (i % 40 + 1), "en", f"s{i % 100}", 0) for i in range(2000)], SHAPE)
        got = mixing.mixed_copies(d, carry=["source"]).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(got) == 2000 and files["mix-cells"] <= spark.sparkContext.defaultParallelism and "mix-second" not in files
    taken = {}
    for r in got:
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[r.source] - r.target) <= 20 for r in got)


_words = {}


def docs_words(docs, doc_id):
    import re

    if not _words:
        _words.update({r.doc_id: re.findall(r"[^\x20\x09-\x0D]+", r.text or "") for r in docs.collect()})
    return _words[doc_id]
