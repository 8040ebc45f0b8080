"""The training-data operators against brute force, and their defined cases."""

from __future__ import annotations

import base64
import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from brute import dedup, edited, measures, near_classes, overlaps, prose, words

from pagefacts.llm import (
    chunk_cache, decontaminate, katz, language_id, licenses, line_dedup, ngram_join, packing, quality_rules, token_counts, warc,
)
from pagefacts.llm.components import components

WORD_BPE, BYTE_BPE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
LONG = prose(7, 30_000)
ODD = [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, LONG), (5, LONG), (None, "null id here"), (6, "Ünï cödé ß 中文 words\x1f\x85x"), (7, "a\nb\nc\nd\n")]


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


# near duplicates


def test_ngram_join_equals_brute_force(docs):
    texts = [prose(s, 60) for s in range(12)]
    texts += [edited(texts[0], s, 1 + s % 3) for s in range(40)] + [texts[1]] * 5 + [edited(texts[2], s, 2) for s in range(4)]
    texts += [None, "", "  ", "short one", "short one", "short two"]
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.link_counts(docs(list(enumerate(texts)))).collect()}
    want = near_classes(texts)
    assert got == {i: x for i, x in enumerate(want)}


def test_ngram_join_in_blocks(docs, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", 7)
    base = prose(3, 80)
    texts = [edited(base, s, 1 + s % 4) for s in range(50)] + [prose(s, 50) for s in range(100, 110)]
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.link_counts(docs(list(enumerate(texts)))).collect()}
    assert got == {i: x for i, x in enumerate(near_classes(texts))}


def test_ngram_join_cases(docs):
    kept = ngram_join.keep_one(docs(ODD))
    assert kept.columns == docs([]).columns
    assert rows_of(kept.select("doc_id"), "doc_id") == sorted([(x,) for x in (1, 2, 3, 4, 5, None, 6, 7)], key=repr)
    assert ngram_join.link_counts(docs([])).count() == 0
    links = {(r.doc_id, r.n_links) for r in ngram_join.link_counts(docs(ODD)).collect()}
    assert (5, 1) in links and (1, 0) in links


def test_pruning_keeps_the_threshold():
    least = ngram_join.least_matches(0.8, 1e-9)
    for k, m in zip(range(32, 129, 32), least, strict=True):
        tail = sum(math.comb(k + 1, i) * 0.8**i * 0.2 ** (k + 1 - i) for i in range(m))
        assert tail < 1e-9 <= tail + math.comb(k + 1, m) * 0.8**m * 0.2 ** (k + 1 - m)


def test_minhash_agreement_is_the_similarity():
    a, b = ngram_join._coefficients(128)
    rng, seen = np.random.default_rng(1), []
    for _ in range(40):
        x = rng.integers(0, 2**63, 500, dtype="u8")
        y = np.r_[x[:400], rng.integers(0, 2**63, 100, dtype="u8")]
        seen.append((ngram_join.minhash(x, a, b) == ngram_join.minhash(y, a, b)).mean())
    assert abs(np.mean(seen) - 400 / 600) < 0.02


def test_components_of_chains(frame):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.v: r.root for r in components(frame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100}


# licences


def test_license_scan(docs):
    notice = licenses.TEMPLATES["gpl-3.0"]
    rows = [(1, f"Title\n{notice}\nmore"), (2, f"some words before. {licenses.TEMPLATES['mit']} And after."), (3, "nothing at all"),
            (4, notice.upper() + "!!"), (5, None), (6, ""), (7, "All rights reserved by nobody in particular, and so on")]
    got = {r.doc_id: (r.license, r.n_units > 0) for r in licenses.scan(docs(rows)).collect()}
    assert got == {1: ("gpl-3.0", True), 2: ("mit", True), 4: ("gpl-3.0", True), **{i: (None, False) for i in (3, 5, 6, 7)}}
    assert licenses.scan(docs([])).count() == 0


MIT = '''MIT License

Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
'''
BSD = '''Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
'''
APACHE = '''Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
'''
GPL = '''This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
'''


def test_license_texts_inside_longer_documents(docs):
    around = "\n".join(prose(s, 40) for s in range(6))
    grant = MIT[MIT.index("Permission") : MIT.index("The above")]
    commented = "\n".join(f" * {line}".rstrip() for line in grant.split("\n"))
    rows = [(k, f"{around}\n\n{t}\n{around}") for k, t in enumerate([MIT, BSD, APACHE, GPL, " ".join(GPL.split()), grant, commented + "\n *\n"])]
    rows += [(10, " ".join(f"{prose(1, 30)}. {MIT[MIT.index('Permission'):]} {prose(2, 30)}.".split())), (11, around)]
    got = {r.doc_id: r for r in licenses.scan(docs(rows)).collect()}
    names = {k: r.license and r.license.split("-")[0] for k, r in got.items()}
    assert names == {0: "mit", 1: "bsd", 2: "apache", 3: "gpl", 4: "gpl", 5: "mit", 6: "mit", 10: "mit", 11: None}
    assert got[0].n_units >= 4 and got[1].n_units >= 2 and got[2].n_units >= 3 and got[3].n_units >= 3
    assert got[5].license == got[6].license == "mit-grant" and got[11].n_units == 0


def test_license_pruning_loses_nothing(docs):
    rng = random.Random(5)
    texts = []
    for t in licenses.TEMPLATES.values():
        for _ in range(6):
            w = t.split()
            for _ in range(rng.randrange(4)):
                w.insert(rng.randrange(len(w) + 1), "word") if rng.random() < 0.5 else w.pop(rng.randrange(len(w)))
            texts.append(" ".join(w).replace(".", ""))
    got = {r.doc_id: r for r in licenses.scan(docs(list(enumerate(texts)))).collect()}
    for i, text in enumerate(texts):
        a = set(licenses.bigrams(text))
        scores = {n: 2 * len(a & set(b)) / (len(a) + len(b)) for n, t in licenses.TEMPLATES.items() if (b := licenses.bigrams(t))}
        best = max(scores.values())
        if best >= licenses.THRESHOLD:
            assert got[i].dice == pytest.approx(best) and got[i].license == min(n for n, s in scores.items() if s == best)
        else:
            assert got[i].license is None


def test_license_anchors_are_in_every_match(docs):
    found = set(licenses.anchors(licenses.TEMPLATES, licenses.THRESHOLD))
    assert found and not found & {"this", "the", "by", "under"}
    rng = random.Random(8)
    for t in licenses.TEMPLATES.values():
        own, matches = set(licenses.bigrams(t)), 0
        for _ in range(200):
            kept = licenses.normal_words(t)
            for _ in range(rng.randrange(1 + len(kept) // 6)):
                kept.pop(rng.randrange(len(kept)))
            a = set(licenses.bigrams(" ".join(kept)))
            if 2 * len(a & own) >= licenses.THRESHOLD * (len(a) + len(own)):
                matches += 1
                assert found & set(kept)
        assert matches
    assert licenses.anchors({"x": "this is the one thing"}, 0.8) == ["one", "thing"] and licenses.anchors({"x": "to be"}, 0.0) == []
    rows = [(1, "Vorwort\nALL-rights/RESERVED!\nall rights (reserved)"), (2, "unreserved rights"), (3, None)]
    got = {r.doc_id: (r.license, r.n_units) for r in licenses.scan(docs(rows), templates={"x": "All rights reserved."}).collect()}
    assert got == {1: ("x", 3), 2: (None, 0), 3: (None, 0)}


# WARC


def test_warc_round_trip(spark, frame, tmp_path):
    big = "été <p>" * 40_000
    rows = [(3, "http://a/x", "<p>same</p>"), (1, "http://a/y", "<p>same</p>"), (2, None, big), (4, "http://b/ \r\nevil: 1", "a\r\n\r\nWARC/1.1\r\nb\n"),
            (5, "u", None), (6, "u", ""), (7, "u", big), (8, "u", "x"), (8, "u", "x"), (None, "u", "no id")]
    pages = frame(rows, "page_id long, url string, html string")
    folder = str(tmp_path / "archives")
    warc.write_archives(pages, folder, chunk_bytes=1000)
    chunks = warc.read_chunks(spark, folder).cache()
    assert chunks.agg({"chunk_bytes": "max"}).first()[0] <= 1000
    joined = defaultdict(bytes)
    for r in sorted(chunks.collect(), key=lambda r: (r.record_id, r.chunk)):
        joined[r.record_id] += bytes(r.data)
    for page, _, html in rows:
        body = (html or "").encode()
        key = f"urn:page:{'' if page is None else page}:0"
        assert joined[key] in (body, b"")
    got = {(r.page, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in warc.records(chunks).collect()}

    def line(page, kind, refers, html):
        body = (html or "").encode()
        return page, kind, refers, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode()

    assert got == {
        line("1", "response", None, "<p>same</p>"), line("3", "revisit", "1", "<p>same</p>"), line("2", "response", None, big),
        line("7", "revisit", "2", big), line("4", "response", None, rows[3][2]), line("5", "response", None, ""),
        line("6", "revisit", "5", ""), line("8", "response", None, "x"), line("8", "revisit", "8", "x"), line(None, "response", None, "no id"),
    }
    assert joined["urn:page:2:0"] == big.encode() and joined["urn:page:4:0"] == rows[3][2].encode()


def test_warc_smaller_payloads_stay_responses(spark, frame, tmp_path):
    pages = frame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "a"), min_bytes=3)
    got = {(r.page, r.record_type) for r in warc.records(warc.read_chunks(spark, str(tmp_path / "a"))).collect()}
    assert got == {("1", "response"), ("2", "response"), ("3", "response"), ("4", "revisit")}


def test_warc_ids_with_several_payloads(spark, frame, tmp_path):
    bodies = ["a" * 2500, "b", "c" * 1500, "a" * 2500]
    rows = [(page, f"u{k}", body) for page in (None, 5, 7) for k, body in enumerate(bodies)] + [(9, "u", "b"), (None, "u", "only"), (3, "u", "c" * 1500)]
    warc.write_archives(frame(rows, "page_id long, url string, html string"), str(tmp_path / "a"), chunk_bytes=1000)
    chunks = warc.read_chunks(spark, str(tmp_path / "a")).cache()
    heads = [r.record_id for r in chunks.filter("chunk = 1").collect()]
    assert len(heads) == len(set(heads)) == len(rows)
    first, seen, want = {"a" * 2500: "5", "b": "5", "c" * 1500: "3", "only": None}, set(), Counter()
    for page, _, body in rows:
        page = None if page is None else str(page)
        response = page == first[body] and (page, body) not in seen
        seen.add((page, body))
        want[page, "response" if response else "revisit", None if response else first[body], len(body),
             base64.b32encode(hashlib.sha1(body.encode()).digest()).decode()] += 1
    got = warc.records(chunks).collect()
    assert Counter((r.page, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in got) == want
    # a revisit names the response of its own payload, whatever other payloads that id has
    lines = spark.read.option("lineSep", "\r\n").text(str(tmp_path / "a")).collect()
    digest = {r.record_id: r.payload_digest for r in got if r.record_type == "response"}
    named = [r.value for r in lines if r.value.startswith(("WARC-Refers-To: ", "WARC-Payload-Digest: "))]
    pairs = [(a, b) for a, b in zip(named, named[1:]) if a.startswith("WARC-Refers-To: ")]
    assert len(pairs) == sum(n for k, n in want.items() if k[1] == "revisit")
    assert all(b == f"WARC-Payload-Digest: sha1:{digest[a.split('<')[1].rstrip('>')]}" for a, b in pairs)


def test_warc_without_pages(spark, frame, tmp_path):
    warc.write_archives(frame([], "page_id long, url string, html string"), str(tmp_path / "a"))
    assert warc.read_chunks(spark, str(tmp_path / "a")).count() == 0


# packing and token counts


def test_packing_is_whole_and_gapless(docs):
    rng = random.Random(2)
    rows = [(i, prose(i, rng.choice([3, 40, 300, 900]))) for i in range(150)] + ODD
    out = packing.pack(docs(rows), WORD_BPE, capacity=512, open_bins=8).collect()
    tokenizer = token_counts.load_tokenizer(token_counts.file_text(WORD_BPE))
    want = Counter()
    for doc, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 512):
            part = ids[k : k + 512]
            want[doc, k // 512, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    bins = defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 512
    assert len(bins) <= 1.06 * sum(r.length for r in out) / 512 + 1
    assert packing.pack(docs([]), WORD_BPE).count() == 0


def test_chunks_are_encoded_without_offsets(monkeypatch):
    source, asked = packing.file_text(WORD_BPE), []
    cache = chunk_cache.ChunkCache(source, packing._packed, split=packing.plain_parts)
    plain = cache.tokenizer

    class Fast:
        def encode_batch_fast(self, texts, add_special_tokens):
            asked.append(list(texts))
            return plain.encode_batch(texts, add_special_tokens=add_special_tokens)

    cache.tokenizer = Fast()
    for group in ([["Some", "words,"], ["some", "Words,", "Ünï"]], [["some"], ["words,"]]):
        ids_of = cache.covering(group)
        for chunk in (c for own in group for c in own):
            assert ids_of(chunk) == np.array(plain.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()
    assert len(asked) == 2 and not asked[1]
    assert sorted(asked[0]) == sorted(set(asked[0]))


def test_open_bins_stay_bounded():
    rng = random.Random(1)
    bins, held = packing.OpenBins(100, 5), Counter()
    for _ in range(500):
        free = rng.randrange(1, 100)
        bins.put(free, "bin")
        held[free] += 1
        if bins.count > 5:
            closed, _ = bins.fullest()
            assert closed == min(held.elements())  # the least free space
            held[closed] -= 1
        need = rng.randrange(1, 100)
        fits = [f for f in held.elements() if f >= need]
        got = bins.take(need)
        assert (got is None) == (not fits)
        if got:
            assert got[0] == min(fits)  # the tightest
            held[got[0]] -= 1
    assert list(packing.best_fit([60, 50, 40, 30], 100, 10))[0][1] == [(0, 0), (2, 60)]  # the tighter bin takes the 40


def test_token_counts_are_the_librarys(docs):
    odd = ["<|endoftext|>", " <|endoftext|>  x", "it's  \n\n two\t tabs", "\x1c\x1d a\x85b", "　x y", "1234 5,6!?", "​​"]
    rows = ODD + [(100 + i, t) for i, t in enumerate(odd)]
    out = token_counts.count_tokens(docs(rows), BYTE_BPE)
    tokenizer = token_counts.load_tokenizer(token_counts.file_text(BYTE_BPE))
    want = Counter()
    for doc, text in rows:
        n = len(tokenizer.encode(text or "", add_special_tokens=False).ids)
        want[doc, len((text or "").encode()), n, n > 1024] += 1
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in out.collect()) == want
    assert token_counts.count_tokens(docs([]), BYTE_BPE).count() == 0


def test_frequent_chunks_come_from_merged_summaries(spark, docs):
    rng = random.Random(11)
    rows = [(i, " ".join(f"w{min(int(rng.expovariate(0.05)), 300)}" for _ in range(80))) for i in range(400)]
    source = spark.sparkContext.broadcast(token_counts.file_text(BYTE_BPE))
    tokenizer = token_counts.load_tokenizer(source.value)
    seen = Counter(c for _, t in rows for c in token_counts.CHUNKS.findall(t))
    want = sorted(seen, key=lambda c: (-seen[c], c))[:40]
    for parts, fan in ((1, 64), (23, 2), (23, 64)):
        blob = token_counts.frequent_chunks(docs(rows).repartition(parts), "text", source, 40, fan)
        chunks, lengths = token_counts.unpack(blob)
        assert (lengths == [len(e.ids) for e in tokenizer.encode_batch(chunks, add_special_tokens=False)]) and len(chunks) == 40
        if fan == 64:  # merged at once nothing is let go before the end
            assert chunks == want
    assert token_counts.unpack(token_counts.frequent_chunks(docs([(1, None), (2, "")]), "text", source)) == ([], [])


# quality


def test_quality_measures_equal_brute_force(docs):
    rng = random.Random(3)
    texts = [t for _, t in ODD] + ["\n".join(rng.choice(["a b c", "b c a b", "", " ", "x # | y", "a b c d"]) for _ in range(rng.randrange(12))) for _ in range(60)]
    got = quality_rules.measured(docs(list(enumerate(texts)))).select("row.doc_id", *quality_rules.MEASURES).collect()
    assert {r.doc_id: {m: r[m] for m in quality_rules.MEASURES} for r in got} == {i: measures(t) for i, t in enumerate(texts)}


def test_cutoffs_promise_what_they_say(spark, docs, frame):
    good = [prose(i, 60) for i in range(400)]
    bad = ["### $$$ %%% " * 5 + prose(i, 60) for i in range(500, 540)]
    rows = list(enumerate(good + bad))
    labels = frame([(i, int(i < 400), 0) for i, _ in rows] + [(1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in quality_rules.filter_quality(docs(rows), labels, risk=0.2).collect()}
    assert kept == set(range(400))
    # a promise that so few labels cannot show: nothing but the base limits decides
    kept = {r.doc_id for r in quality_rules.filter_quality(docs(rows), labels, risk=0.002).collect()}
    assert kept == {i for i, t in rows if measures(t)["n_words"] >= 50 and 100 * measures(t)["n_repeat_words"] <= 50 * len(words(t))}


def test_a_bad_rule_is_refused_alone(spark, docs, frame):
    rng = random.Random(5)
    good = ["\n".join(prose(1000 * i + k, 12) for k in range(6)) for i in range(400)]
    rows = list(enumerate(good + good[:200]))  # copies are no further trials
    labels = frame([(i, 1, 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    bad = quality_rules.Rule("bad", "n_words", "n_words", 1, (1, 1))  # rejects whatever has words
    fine = quality_rules.Rule("fine", "n_symbols", "word_chars", 1000, (10, 20, 30))
    other = quality_rules.Rule("other", "n_dup_lines", "n_lines", 1000, (100, 200))
    out = quality_rules.judged(docs(rows), labels, rules=(bad, fine, other))
    assert {(r.cut_bad, r.cut_fine, r.cut_other) for r in out.collect()} == {(None, 10, 100)}
    # 0.98 ** 149 < 0.05: so many distinct texts suffice for one chain alone, fewer do not, however often they are repeated
    for n, cut in ((149, 10), (148, None)):
        few = [(i, t) for i, t in rows if i % 400 < n]
        got = quality_rules.judged(docs(few), labels, rules=(fine,)).collect()
        assert {r.cut_fine for r in got} == {cut}
    # what is admitted rejects no more good texts than the test allows, in every chain
    noisy = [(i, t if rng.random() > 0.03 else t + " #" * 40) for i, t in rows[:400]]
    cut = {r.cut_fine for r in quality_rules.judged(docs(noisy), labels, rules=(fine, other)).collect()}
    assert cut == {None}


def test_chain_steps_equal_brute_force(spark):
    rules, rng = quality_rules.RULES, random.Random(7)
    rows = [tuple(rng.choice([0, 1, 5, 40, 400, 900]) for _ in range(6)) for _ in range(80)]
    df = spark.createDataFrame(rows, ", ".join(f"{m} long" for m in quality_rules.MEASURES))
    for chain in quality_rules.chains(rules):
        got = [r[0] for r in df.select(quality_rules.first_step(rules, chain)).collect()]
        for row, step in zip(rows, got):
            m, want = dict(zip(quality_rules.MEASURES, row)), None
            for at in range(10 * len(chain)):
                rule = rules[chain[at % len(chain)]]
                cutoff = sorted(rule.cutoffs, reverse=True)[at // len(chain)]
                if m[rule.whole] > 0 and rule.scale * m[rule.part] >= cutoff * m[rule.whole]:
                    want = at + 1
                    break
            assert step == want


def test_binomial_tail(spark):
    cases = [(0, 10, 0.1), (3, 50, 0.1), (7, 700, 0.0125), (40, 900, 0.05), (200, 100_000, 0.003), (9, 10, 0.5)]
    df = spark.createDataFrame([(k, n) for k, n, _ in cases], "k long, n long")
    for k, n, p in cases:
        got = df.filter(f"k = {k} and n = {n}").select(quality_rules.binomial_at_most("k", "n", p)).first()[0]
        logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log(1 - p) for i in range(k + 1)]
        assert got == pytest.approx(sum(map(math.exp, logs)), rel=1e-8) or k > n * p and got == 1.0


def test_quality_cases(docs, frame):
    none = frame([], "doc_id long, quality int, toxic int")
    out = quality_rules.judged(docs(ODD), none)
    assert out.count() == len(ODD) and not any(r.kept for r in out.filter("n_words < 50").collect())
    kept = quality_rules.filter_quality(docs(ODD), none)
    assert kept.columns == docs([]).columns and rows_of(kept, "doc_id") == [(5,), (5,)]
    assert quality_rules.filter_quality(docs([]), none).count() == 0


# lines


def test_line_dedup_equals_brute_force(docs):
    rng = random.Random(4)
    rows = [(i, "\n".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 12)))) for i in range(60)] + [(100, None), (101, ""), (102, "\n\n\n\n"), (103, "\n\n\n\n")]
    out = line_dedup.dedup_lines(docs(rows))
    assert out.columns == docs([]).columns
    assert {r.doc_id: r.text for r in out.collect()} == dedup(rows)
    report = {r.doc_id: r for r in line_dedup.report(docs(rows)).collect()}
    for i, t in rows:
        assert report[i].n_lines == (0 if t is None else t.count("\n") + 1)
        assert report[i].text == dedup(rows)[i]


def test_line_dedup_cases(docs):
    same = "l1\nl2\nl3\nl4"
    rows = [(1, same), (1, same), (2, same), (3, "x\nl1\nl2\nl3\ny"), (None, same), (None, None)]
    got = Counter((r.doc_id, r.text) for r in line_dedup.dedup_lines(docs(rows)).collect())
    assert got == Counter({(None, same): 1, (None, None): 1, (1, ""): 2, (2, ""): 1, (3, "x\ny"): 1})
    left = line_dedup.dedup_lines(docs(rows), drop_emptied=True)
    assert Counter(r.doc_id for r in left.collect()) == Counter({None: 2, 3: 1})
    assert line_dedup.dedup_lines(docs([])).count() == 0


# languages

ALPHABETS = {"aa": "bdgkmno", "bb": "frstuxy", "cc": "жзийлмн", "dd": "λμνξπρσ"}


def gibberish(lang, n, seed):
    r = random.Random(f"{lang}{seed}")
    return " ".join("".join(r.choice(ALPHABETS[lang]) for _ in range(r.randint(2, 6))) for _ in range(n))


def test_language_spans_and_held_out_accuracy(spark, docs):
    from pyspark.sql import functions as F

    rows = [(i, gibberish(lang, 30, i), lang) for i in range(40) for lang in ALPHABETS]
    rows = [(k, t, lang) for k, (_, t, lang) in enumerate(rows)]
    model = language_id.fit(docs(rows), F.col("doc_id") % 5 != 2)
    tests = [(1000, gibberish("aa", 20, "x") + " " + gibberish("bb", 30, "y") + " " + gibberish("aa", 5, "z"), None), (1001, None), (1002, "12 !?"), (1003, ""), (1004, "中文 中文"), (1005, "½ ① ² Ⅳ ٣"), (None, gibberish("cc", 9, 1))]
    got = {r.doc_id: r for r in language_id.identify(docs(rows + tests), model).select("row.doc_id", "lang_pred", "score", "spans").collect()}
    held = [(k, lang) for k, _, lang in rows if k % 5 == 2]
    assert sum(got[k].lang_pred == lang for k, lang in held) >= 0.99 * len(held)
    assert [tuple(s) for s in got[1000].spans] == [("aa", 0, 20), ("bb", 20, 50), ("aa", 50, 55)]
    assert got[1000].lang_pred == "bb" and 0.3 < got[1000].score < 0.8
    for k in (1001, 1002, 1003, 1005):
        assert (got[k].lang_pred, got[k].score) == ("und", 0.0)
    assert got[None].lang_pred == "cc" and got[1004].lang_pred in ALPHABETS
    nothing = language_id.fit(docs(rows), F.lit(False))
    assert {r.lang_pred for r in language_id.identify(docs(rows[:3]), nothing).collect()} == {"und"}
    assert language_id.identify(docs([]), model).count() == 0


def test_words_keep_their_marks():
    assert language_id._WORDS.findall("हिन्दी, cafe\u0301 x½y Ⅳ don't") == ["हिन्दी", "cafe\u0301", "x", "y", "don", "t"]


def test_idle_workers_hold_no_cache(monkeypatch):
    import time

    from pagefacts.llm import chunk_cache

    monkeypatch.setattr(chunk_cache, "IDLE_SECONDS", 0.2)
    source = chunk_cache.file_text(public_tokenizers.path("byte_bpe_50k.json"))
    one = chunk_cache.worker_cache("test", source, len)
    assert one.covering([["word", "two"]])("word") == 1
    one.rest()
    assert chunk_cache.worker_cache("test", source, len) is one  # the next task is in time
    time.sleep(0.6)
    assert chunk_cache._kept
    one.rest()
    time.sleep(0.6)
    assert not chunk_cache._kept


def test_viterbi_equals_all_paths():
    import itertools

    model = language_id.Model([("a", "gram", " x ", 5), ("b", "gram", " y ", 5), ("a", "script", "Latin", 5), ("b", "script", "Latin", 5)])
    rng = random.Random(1)
    for _ in range(30):
        text = [rng.choice("xyz") for _ in range(rng.randrange(1, 8))]
        label = model.spans([text, ["x"]], 1.5)[0]
        scores = model.scores[[model.index[w] for w in text]].astype(float)

        def total(path):
            return sum(scores[i, s] for i, s in enumerate(path)) - 1.5 * sum(a != b for a, b in zip(path, path[1:]))

        best = max(total(p) for p in itertools.product(range(2), repeat=len(text)))
        assert total(label.tolist()) == pytest.approx(best, abs=1e-4)


# language model


def katz_brute(rows, learn):
    tokens = {i: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) + ["</s>"] for i, t in rows}
    count, pairs, contexts = Counter(), Counter(), Counter()
    for i, w in tokens.items():
        if learn(i):
            count.update(w)
            pairs.update(zip(["<s>", *w], w))
            contexts.update(["<s>", *w[:-1]])
    n, v = sum(count.values()), len(count)
    d = katz.discounts(Counter(pairs.values()))
    kept = {k: (d[r] if r <= katz.GT_MAX else 1.0) * r for k, r in pairs.items() if r >= katz.MIN_COUNT}

    def p1(w):
        return (count[w] + 1) / (n + v + 1)

    freed, lower = Counter(), Counter()
    for (h, w), r in kept.items():
        freed[h] += r
        lower[h] += p1(w)
    total = {h: contexts[h] + (freed[h] >= contexts[h]) for h in freed}
    alpha = {h: (1 - freed[h] / total[h]) / (1 - lower[h]) for h in freed}

    def p2(h, w):
        return kept[h, w] / total[h] if (h, w) in kept else alpha.get(h, 1.0) * p1(w)

    out = {}
    for i, w in tokens.items():
        out[i] = (len(w), sum(count[x] > 0 for x in w), n, sum(math.log10(p1(x)) for x in w), sum(math.log10(p2(h, x)) for h, x in zip(["<s>", *w], w)))
    sums = [sum(p2(h, w) for w in count) + p2(h, "never seen") for h in list(alpha)[:20]]
    return out, sums


@pytest.mark.parametrize("small", [False, True])
def test_katz_equals_brute_force(docs, monkeypatch, small):
    from pyspark.sql import functions as F

    if small:
        for name, value in (("BUCKET_BYTES", 4000), ("HEAD_WORDS", 8), ("HEAD_PAIRS", 8), ("RUN_TOKENS", 500)):
            monkeypatch.setattr(katz, name, value)
    rows = [(i, prose(i, 5 + i % 90, 150)) for i in range(120)] + [(200, None), (201, ""), (202, "The THE tHeÉ"), (None, "w1 w2")]
    frame = docs(rows)
    out = katz.score(frame, katz.fit(frame, F.coalesce(F.col("doc_id"), F.lit(2)) % 7 != 2))
    want, sums = katz_brute(rows, lambda i: (2 if i is None else i) % 7 != 2)
    assert all(s == pytest.approx(1.0) for s in sums)
    got = {r.doc_id: r for r in out.collect()}
    assert set(got) == set(want)
    for i, (n, known, train, base, score) in want.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, train)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(score)


def test_katz_cases(docs):
    from pyspark.sql import functions as F

    frame = docs([(1, "a b a b a b"), (1, "a b a b a b"), (2, "c")])
    got = katz.score(frame, katz.fit(frame, F.lit(False))).collect()
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens) for r in got) == [(1, 7, 0, 0), (1, 7, 0, 0), (2, 2, 0, 0)]
    assert katz.score(docs([]), katz.fit(docs([]), F.lit(True))).count() == 0


def test_katz_tables_have_no_large_rows(docs):
    from pyspark.sql import functions as F

    frame = docs([(k, prose(k, 400)) for k in range(1, 12)])
    pairs = katz.fit(frame, F.lit(True)).pairs
    assert not [f.name for f in pairs.schema if "array" in f.dataType.simpleString()]
    assert pairs.count() > 1000 and not pairs.filter("at >= 0 and w <> 0").count() and pairs.filter("at >= 0").count() > 1000


def test_katz_keeps_pairs_seen_once(docs):
    from pyspark.sql import functions as F

    frame = docs([(1, "x y"), (2, "X y"), (3, "y x")])
    got = {r.doc_id: r for r in katz.score(frame, katz.fit(frame, F.col("doc_id") == 1)).collect()}
    # three pairs of count 1, discounted by a half: each word has probability 1/2 after its own context
    assert got[1].score == pytest.approx(3 * math.log10(1 / 2)) and got[2].score == pytest.approx(got[1].score)
    # words known (2/7 each) in unseen pairs: each context gives its freed half to the other words
    assert got[3].score == pytest.approx(3 * math.log10(0.5 / (1 - 2 / 7) * 2 / 7))


# benchmark


def test_overlaps_equal_brute_force(docs, frame):
    rng = random.Random(6)
    items = [(i, " ".join(rng.choice("ab Cc d éa 1".split()) for _ in range(rng.randrange(0, 16)))) for i in range(12)] + [(50, None), (51, "lone"), (52, "a b")]
    texts = [" ".join(rng.choice("ab cc D éa 1 z".split()) for _ in range(rng.randrange(0, 60))) for _ in range(60)] + [None, "", "LONE!", "x a-b y"]
    texts += [f"{prose(i, 10)}. {items[i][1]}, {prose(i + 50, 5)}" for i in range(12)]
    bench = frame(items, "item_id long, text string")
    for size in (10**6, 150):  # in one block, and in several
        got = decontaminate.overlaps(docs(list(enumerate(texts))), bench, block_bytes=size)
        want = overlaps(texts, items)
        for r in got.select("row.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "longest").collect():
            n, hit, found = want[r.doc_id]
            assert (r.n_words, r.n_hit, r.n_items) == (n, hit, len(found))
            assert r.items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()
            assert (r.longest > 0) == (hit > 0)


def test_decontamination_cases(docs, frame):
    passage = prose(1, 25)
    bench = frame([(1, passage), (None, "only this")], "item_id long, text string")
    rows = ODD + [(20, f"before {passage} after"), (21, "well, only this."), (22, prose(2, 25))]
    kept = decontaminate.remove_contaminated(docs(rows), bench)
    assert kept.columns == docs([]).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d, _ in rows if d not in (20, 21))
    far = {r.doc_id: r.longest for r in decontaminate.overlaps(docs(rows), bench).select("row.doc_id", "longest").collect()}
    assert far[20] == 25
    nothing = frame([], "item_id long, text string")
    assert decontaminate.remove_contaminated(docs(rows), nothing).count() == len(rows)
    assert decontaminate.remove_contaminated(docs([]), bench).count() == 0


def test_spans_are_json_friendly(docs, frame):
    bench = frame([(1, "a b c")], "item_id long, text string")
    (row,) = decontaminate.overlaps(docs([(1, "a b c a b c")]), bench).select("spans").collect()
    assert json.dumps([(s >> 31, s & 0x7FFFFFFF) for s in row.spans]) == "[[0, 3], [3, 6]]"
