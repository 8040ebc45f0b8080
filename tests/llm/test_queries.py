"""The registered queries and the pipeline over the smallest given tables."""

from __future__ import annotations

import base64
import hashlib
import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from brute import dedup, measures, near_classes, shingles, words
from compare import compare, duck
from test_operators import katz_brute

import __spark_entry__ as entry
import corpus_pipeline
from pagefacts.llm import queries, token_counts

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def texts(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def rows(spark, name):
    return {r[0]: r for r in entry.queries()[name](spark, SF).collect()}


def test_all_are_registered():
    names = set(entry.queries())
    assert set(queries.QUERIES) <= names and "pipeline" in names
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(spark, name):
    n, problem = compare(spark, duck(SF), entry.queries()[name], entry.oracle_sql()[name], SF)
    assert problem is None and n > 0


def test_op1(spark, texts):
    order = sorted(texts)
    want = near_classes([t for _, t in order])
    got = rows(spark, "op1_ngram_join")
    for (doc, _), (at, links) in zip(order, want, strict=True):
        assert (got[doc].class_id, got[doc].n_links) == (order[at][0], links)


def test_op3(spark):
    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    first = {}
    for page in sorted(pages):
        first.setdefault(pages[page], page)
    got = rows(spark, "op3_warc")
    assert set(got) == set(pages)
    for page, body in pages.items():
        r = got[page]
        assert r.payload_bytes == len(body) and r.payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
        want = ("response", None) if first[body] == page else ("revisit", first[body])
        assert (r.record_type, r.refers_to) == want


def pieces(docs):
    tokenizer = token_counts.load_tokenizer(token_counts.file_text(public_tokenizers.path("word_bpe_49k.json")))
    out = Counter()
    for doc, text in docs:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            out[doc, k // 4096, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    return out


def check_packing(out, docs):
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == pieces(docs)
    places = defaultdict(list)
    for r in out:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        ends = np.cumsum([n for _, n in sorted(own)])
        assert [o for o, _ in sorted(own)] == [0, *ends[:-1]] and ends[-1] <= 4096
    assert len(places) <= 1.1 * sum(r.length for r in out) / 4096 + 1


def test_op4(spark, texts):
    check_packing(entry.queries()["op4_best_fit_packing"](spark, SF).collect(), texts)


def test_op7(spark, texts):
    tokenizer = token_counts.load_tokenizer(token_counts.file_text(public_tokenizers.path("byte_bpe_50k.json")))
    got = rows(spark, "op7_token_counts")
    for doc, text in texts:
        n = len(tokenizer.encode(text or "", add_special_tokens=False).ids)
        assert (got[doc].n_bytes, got[doc].n_tokens, got[doc].over_limit) == (len((text or "").encode()), n, n > 1024)


def test_op8(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = rows(spark, "op8_language_id")
    held = [d for d in lang if zlib.crc32(str(d).encode()) % 4 == 2]
    assert {d for d, r in got.items() if r.held_out} == set(held) and set(got) == set(lang)
    assert sum(got[d].lang_pred == lang[d] for d in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_op9(spark, texts):
    want, _ = katz_brute(texts, lambda i: zlib.crc32(str(i).encode()) % 7 != 2)
    got = rows(spark, "op9_katz_scoring")
    assert set(got) == set(want)
    for doc, (n, known, train, base, score) in want.items():
        r = got[doc]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, train)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=1e-9)
        assert r.held_out == (zlib.crc32(str(doc).encode()) % 7 == 2)


def test_pipeline(spark, texts):
    """Every stage over what its predecessor kept, against plain Python."""
    kept = [(d, t) for d, t in texts if (m := measures(t))["n_words"] >= 50 and 100 * m["n_repeat_words"] <= 50 * m["n_words"]]
    # the few labels of this table admit no cutoff, so the base limits decide alone
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    docs = stages["quality"](spark, docs, SF)
    assert docs.columns == columns and {r.doc_id: r.text for r in docs.collect()} == dict(kept)
    left = {d: t for d, t in dedup(kept).items() if words(t)}
    docs = stages["line_dedup"](spark, docs, SF)
    assert docs.columns == columns and {r.doc_id: r.text for r in docs.collect()} == left
    order = sorted(left.items())
    first = {order[at][0] for at, _ in near_classes([t for _, t in order])}
    docs = stages["near_copies"](spark, docs, SF)
    assert docs.columns == columns and {r.doc_id: r.text for r in docs.collect()} == {d: left[d] for d in first}
    import re

    find = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: find.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = low(r.text)
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9) if w else 0)}
    lengths = {len(w) for w in windows}

    def hit(text):
        w = low(text)
        return any(tuple(w[i : i + n]) in windows for n in lengths for i in range(len(w) - n + 1))

    clean = {d: left[d] for d in first if not hit(left[d])}
    docs = stages["decontamination"](spark, docs, SF)
    assert docs.columns == columns and {r.doc_id: r.text for r in docs.collect()} == clean
    check_packing(stages["packing"](spark, docs, SF).collect(), clean.items())


def test_run_equals_its_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    want = {r.doc_id for r in docs.select("doc_id").collect()}
    assert {r.doc_id for r in entry.queries()["pipeline"](spark, SF).select("doc_id").collect()} == want
    assert all(shingles(r.text) for r in docs.collect())
