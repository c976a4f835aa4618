"""Each stage of the corpus pipeline against brute force, with null, empty, repeated and clashing input."""

import hashlib
import random
from collections import Counter

import pytest
import sentencepiece

import corpus_pipeline
import public_tokenizers
from tellurion.llm import language, mixing, neardup, toxicity
from tellurion.llm.common import table

from test_text import brute_classes

DIR = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
EXTRA = ["_row", "_n", "_copies", "carry", "score", "lang_pred", "node", "class", "copies", "rows", "_salt"]


@pytest.fixture(scope="module")
def docs(spark):
    """The table, with odd rows and with columns that are named like those the operators use themselves."""
    d = table(spark, DIR, "documents").select(*COLUMNS)
    odd = [(None, None, None, None, None), (None, "words without an id", "en", "src1", 3), (-1, "", "en", "src2", 0), (-2, "...", None, None, 3), (-3, "x " * 20_000, "en", "src1", 40_000)]
    odd = spark.createDataFrame(odd * 2, d.schema)
    return d.unionByName(odd).selectExpr("*", *[f"concat('{c}', doc_id % 3) as {c}" for c in EXTRA]).cache()


def rows_of(df):
    return Counter(map(tuple, df.collect()))


def test_stages_are_those_asked_for():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "toxicity", "near_duplicates", "mixing", "encoding"]


def test_language_stage(spark, docs):
    model = language.fit_language_model(docs)
    at = docs.columns.index("lang")
    want = Counter()
    for r in docs.collect():
        if any(c.isalpha() for c in r.text or ""):
            want[(*r[:at], model.predict(r.text)[0], *r[at + 1 :])] += 1
    assert rows_of(corpus_pipeline.language(spark, docs, DIR)) == want
    assert corpus_pipeline.language(spark, docs.limit(0), DIR).columns == docs.columns


def test_language_and_toxicity_run_their_model_once_a_text(spark, docs):
    for stage in (corpus_pipeline.language, corpus_pipeline.toxicity):
        plan = stage(spark, docs, DIR)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1


def test_toxicity_stage(spark, docs):
    model = toxicity.fit_toxicity(docs, table(spark, DIR, "labels"))
    want = Counter(tuple(r) for r in docs.collect() if model.score(r.text)[0] <= 0.5)
    got = rows_of(corpus_pipeline.toxicity(spark, docs, DIR))
    assert got == want and 0 < sum(want.values()) < docs.count()


def test_near_duplicates_stage(spark, docs):
    params = neardup.NearDupParams()
    weights = neardup.Weights(*neardup.document_frequencies(docs, params))
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    classes = brute_classes(texts, weights, params)
    got = corpus_pipeline.near_duplicates(spark, docs, DIR)
    assert got.columns == docs.columns
    got = got.collect()
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == sorted({min(i for i in classes if classes[i] == c) for c in classes.values()})
    assert Counter(tuple(r) for r in got if r.doc_id is None) == Counter(tuple(r) for r in docs.collect() if r.doc_id is None)
    assert len(set(classes.values())) < len(texts)
    assert all(texts[r.doc_id] == r.text for r in got if r.doc_id is not None)


def test_mixing_stage(spark, docs):
    got = rows_of(corpus_pipeline.mixing(spark, docs, DIR))
    want = Counter()
    for r in mixing.mixed_copies(docs, carry=docs.columns).collect():
        want[tuple(r[: len(docs.columns)])] += r[-2]  # copies
    assert got == +want
    before = rows_of(docs)
    assert all(n <= 3 * before[r] for r, n in got.items())


def test_mixing_stage_takes_rows_without_an_id_and_of_one_id(spark):
    rows = [(None if i % 3 == 0 else i // 2 % 9, f"{i} " + "w " * (i % 5 + 1), "en", "ab"[i % 2], i) for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.mixing(spark, d, "").collect()
    assert {tuple(r) for r in got} <= set(rows) and any(r.doc_id is None for r in got)
    assert max(Counter(r.n_chars for r in got).values()) <= 3
    words = Counter()
    for r in got:
        words[r.source] += len(r.text.split())
    target = {r.source: r.target for r in mixing.mixed_copies(d, carry=["source"]).collect()}
    assert all(abs(words[s] - target[s]) <= 2 for s in target)


def test_encoding_stage(spark, docs):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = Counter()
    for r in docs.collect():
        ids = sp.encode(r.text or "", add_eos=True)
        want[r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()] += 1
    assert rows_of(corpus_pipeline.encoding(spark, docs, DIR).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")) == want


def test_run_chains_the_stages(spark, tmp_path):
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choices("alpha beta gamma delta epsilon zeta eta theta".split(), k=n))
    rows = [(i, text(rng.randint(1, 80)), "en", f"s{i % 3}", 0) for i in range(80)] + [(100, "12 34", "en", "s1", 5), (101, None, "en", "s1", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert got and {r.doc_id for r in got} <= set(range(80))
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/none/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
