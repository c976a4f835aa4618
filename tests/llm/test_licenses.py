"""License scans against a brute-force scan, and odd input."""

import math
import random
import re

import pytest

from tellurion.llm import licenses
from tellurion.llm.licenses import TEMPLATES, LicenseParams

COLUMNS = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels"]


def brute(texts, params=LicenseParams()):
    """Every template tried at every word of every text."""
    split = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    idf = {w: 1 + math.log((1 + len(texts)) / (1 + sum(w in x for x in split))) for t in TEMPLATES for w in t.words.split()}
    out = []
    for words in split:
        found, starts = {}, []
        for t in TEMPLATES:
            own, keys = t.words.split(), [k.split() for k in t.keys]
            at = [" ".join(own + [""]).index(" ".join(k + [""])) for k in keys]
            at = [" ".join(own)[:a].count(" ") for a in at]
            rare = sorted(range(len(own)), key=lambda i: (-idf[own[i]], i))[: params.rare]
            for s in range(len(words)):
                if words[s : s + len(keys[0])] != keys[0]:
                    continue
                begin = s - at[0]
                if not all(any(0 <= begin + a + d and words[begin + a + d : begin + a + d + len(k)] == k for d in range(-params.slack, params.slack + 1)) for a, k in zip(at[1:], keys[1:], strict=True)):
                    continue
                near = sum(idf[own[i]] for i in rare if own[i] in words[max(0, begin + i - params.slack) : max(0, begin + i + params.slack + 1)])
                share = 1.0 if t.base else near / sum(idf[own[i]] for i in rare)
                if share >= params.least_share - 1e-12:
                    found[t.label] = max(found.get(t.label, 0), share)
                    starts += [s] if t.base else []
        base = sorted({t.label for t in TEMPLATES if t.base and any(words[s : s + len(t.words.split())] == t.words.split() for s in starts)})
        out.append((len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(sorted(found)), max(found.values(), default=0.0)))
    return out


def test_scan_equals_brute_force(spark):
    rng = random.Random(4)
    noise = "the software a license of by cc general public all rights reserved permission notice gnu free to in work é ж".split()
    texts = [None, "", "...", "K", "cc by", "CC BY " * 500, "by cc"]
    for _ in range(150):
        words = rng.choices(noise, k=rng.randint(0, 30))
        for t in rng.sample(TEMPLATES, rng.randint(0, 3)):
            own = t.words.split()
            for _ in range(rng.randint(0, 4)):  # words left out, added and changed
                k = rng.randrange(len(own))
                own[k : k + rng.randint(0, 1)] = rng.choices(noise, k=rng.randint(0, 1))
                own = own or ["x"]
            words += own + rng.choices(noise, k=rng.randint(0, 5))
        texts.append("".join(rng.choice([w, w.upper(), w.title()]) + rng.choice([" ", "\n", ", ", "-", ". "]) for w in words))
    got = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    want = brute(texts)
    assert [tuple(r[c] for c in COLUMNS) for r in got] == [w[:-1] for w in want]
    assert max(abs(r.score - w[-1]) for r, w in zip(got, want, strict=True)) < 1e-9
    assert {x for r in got for x in r.labels.split(",")} >= {t.label for t in TEMPLATES}


@pytest.mark.parametrize("table", ["sf0.001"])
def test_scan_of_a_table_equals_brute_force(spark, table):
    d = spark.read.parquet(f"/root/testdata/{table}/documents.parquet")
    rows = d.orderBy("doc_id").collect()
    got = licenses.scan_licenses(d).orderBy("doc_id").collect()
    assert [tuple(r[c] for c in COLUMNS) for r in got] == [w[:-1] for w in brute([r.text for r in rows])]


def test_worked_examples(spark):
    rows = [(1, "Licensed under CC BY-NC 4.0. cc\u212a by"), (2, "ALL RIGHTS RESERVED all-rights-reserved"), (3, "the gnu General Public\nLicense"), (4, "cc. by; cc by cc by"), (5, "c c by")]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].base_labels, got[1].labels) == (1, 2, "cc-by", "cc-by,cc-by-nc")
    assert (got[2].n_base, got[2].first_word, got[2].last_word, got[2].labels, got[2].score) == (2, 0, 3, "reserved", 1.0)
    assert got[3].base_labels == "gpl" and (got[4].n_base, got[4].last_word, got[4].n_words) == (3, 4, 6)
    assert (got[5].n_base, got[5].first_word, got[5].labels, got[5].score) == (0, None, "", 0.0)


def test_odd_rows_and_clashing_columns(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "!!! ...", None), (4, "x " * 30_000 + "cc by", "c"), (4, "x " * 30_000 + "cc by", "c"), (None, "free text", "d")]
    d = spark.createDataFrame(rows, "doc_id long, text string, _w string").selectExpr("*", "_w as words", "_w as row", "_w as _starts", "_w as seen", "_w as N_WORDS", "_w as _t0", "1 as score")
    got = licenses.scan_licenses(d).orderBy("doc_id").collect()
    assert sorted(r.n_words for r in got) == [0, 0, 0, 2, 30_002, 30_002]
    assert got[0].asDict().keys() == {"doc_id", "_w", "words", "row", "_starts", "seen", "_t0", "score", *COLUMNS}
    assert all(r.words == r._w == r.row and (r.first_word == 30_000) == (r.doc_id == 4) for r in got)
    assert licenses.scan_licenses(d.limit(0)).count() == 0
    assert licenses.scan_licenses(d.select("text")).columns[0] == "n_words"
