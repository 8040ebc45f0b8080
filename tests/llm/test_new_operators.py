"""Periodic runs, shared strings and conversation repair against plain Python."""

from __future__ import annotations

import hashlib
import os
import random
import re

import numpy as np
import pytest
from brute_new import collapsed, damaged, removed, repair, runs, tails
from pyspark.sql import functions as F

from pagefacts.llm import conversation_repair as cr
from pagefacts.llm import induced_sort, suffix_dedup
from pagefacts.llm import periodic_runs as pr


def _worded(rng):
    w = [f"w{rng.randrange(rng.choice([1, 2, 3, 8]))}" for _ in range(rng.randint(0, 60))]
    if len(w) > 8 and rng.random() < 0.7:
        a = rng.randrange(len(w))
        p = rng.randint(1, max(1, (len(w) - a) // 3))
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    return w


@pytest.mark.parametrize("exponent", [3, 4, 5])
def test_runs_of_random_words(exponent):
    rng = random.Random(exponent)
    docs = [_worded(rng) for _ in range(600)]
    for at in range(0, len(docs), 7):
        group = [[x.encode() for x in w] for w in docs[at : at + 7]]
        for (found, text), w in zip(pr._group(group, exponent, 6), docs[at : at + 7], strict=True):
            want = runs(w, exponent)
            assert [tuple(r.values()) for r in found] == want
            assert text.decode().split() == collapsed(w, want)


def test_runs_of_long_texts():
    rng = random.Random(3)
    block = [b"%d" % rng.randrange(10**9) for _ in range(5000)]
    w = [b"x"] * 7 + block * 5 + [b"y"] + [b"z"] * 40_000
    assert [tuple(r.values()) for r in next(pr._group([w], 4, 6))[0]] == [(0, 7, 1), (7, 25_000, 5000), (25_008, 40_000, 1)]


def test_collapse_of_documents(docs):
    rows = [(1, None), (2, ""), (3, " \n\t"), (None, "a a a a a a b"), (4, "a b " * 9), (4, "a b " * 9), (5, "x " * 70_000), (6, "é ü é ü é ü é ü"), (7, "a\x0bb\x1cc")]
    got = {(r.doc_id, r.n_words): r for r in pr.collapse(docs(rows)).select("row.doc_id", "n_words", "runs", "collapsed").collect()}
    for doc, text in rows:
        w = [x for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        r = got[doc, len(w)]
        short = w if len(w) < 1000 else w[:1]
        assert [tuple(x) for x in r.runs] == (runs(w) if len(w) < 1000 else [(0, 70_000, 1)])
        assert bytes(r.collapsed).decode() == " ".join(collapsed(w, runs(w)) if len(w) < 1000 else short)
    assert pr.digests(pr.collapse(docs([]))).collect() == []


def test_digests_of_documents(docs):
    rng = random.Random(11)
    rows = [(i, " ".join(_worded(rng))) for i in range(400)] + [(None, "q " * 30), (900, None)]
    got = {r.doc_id: r for r in pr.digests(pr.collapse(pr.repeat_tails(docs(rows)))).collect()}
    many = 0
    for doc, text in rows:
        w = tails("" if doc is None else doc, (text or "").split())
        found = runs(w)
        r = got[doc]
        many += len(found)
        assert r.n_runs == len(found)
        top = min(found, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=None)
        assert (r.start, r.length, r.period) == (top or (None,) * 3)
        assert r.exponent_milli == (1000 * top[1] // top[2] if top else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(collapsed(w, found)).encode()).hexdigest()
    assert many > 200


TALK = "conv_id long, turn long, role string, text string, conv string, signature int"


def _talks(rng, n):
    out = []
    for c in range(n):
        conv = None if c == 0 else c
        for t in range(rng.randint(1, 6)):
            turn = None if rng.random() < 0.1 else rng.randint(0, 5) if rng.random() < 0.3 else t
            role = rng.choice(["system", "user", "user", "assistant", "assistant", "tool", None, "", "User"])
            out.append((conv, turn, role, rng.choice(["Hi.", "So", " \t", "", None, "Well? \n", "End!", f"Row {t}."]), "x", 1))
    return out


def _by_conversation(rows):
    out = {}
    for conv, turn, role, text, *_ in rows:
        out.setdefault(conv, []).append((turn, role, text))
    return out


def test_repair_of_conversations(frame):
    rows = _talks(random.Random(2), 150)
    got = {r.conv_id: r for r in cr.repair(frame(rows, TALK).repartition(5)).collect()}
    texts = {}
    for r in sorted(cr.repaired_rows(frame(rows, TALK)).collect(), key=lambda r: (str(r.conv_id), r.place)):
        texts.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for conv, own in _by_conversation(rows).items():
        n, cost, audit, text = repair(own)
        r = got.pop(conv)
        assert {k: r[k] for k in n} == n
        assert (r.cost, r.audit) == (cost, audit)
        assert r.repaired_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert "\n".join(texts.get(conv, [])) == text
    assert not got


def test_repair_after_damage(frame):
    rows = _talks(random.Random(4), 150) + [(1000 + c, 0, "user", "Hi.", "x", 1) for c in range(60)]
    got = {r.conv_id: r for r in cr.repair(cr.damage(frame(rows, TALK)), present="present").collect()}
    want = {conv: [d for t, r, x in own for d in damaged(conv, t, r, x)] for conv, own in _by_conversation(rows).items()}
    assert set(got) == set(want) and any(not own for own in want.values())
    for conv, own in want.items():
        n, cost, audit, text = repair(own)
        assert {k: got[conv][k] for k in n} == n and (got[conv].cost, got[conv].audit) == (cost, audit)
        assert got[conv].repaired_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_nodes_of_shared_suffixes_are_solved_once():
    signatures = sorted(s[::-1] for s in ("suaua", "uaua", "aua", "xua", "saua"))
    path, before, distinct = cr.SuffixPath(), "", {s[:k] for s in signatures for k in range(1, len(s) + 1)}
    for s in signatures:
        path.cut(len(os.path.commonprefix((before, s))))
        for letter in s[len(os.path.commonprefix((before, s))) :]:
            path.push(letter)
        before = s
    assert path.solved == len(distinct)


def test_one_long_conversation(spark, frame):
    turn = F.col("id")
    df = spark.range(30_001).select(
        F.lit(7).alias("conv_id"), turn.alias("turn"), F.when(turn % 2 == 0, "user").otherwise("assistant").alias("role"),
        F.concat(F.lit("Turn "), turn.cast("string"), F.lit(".")).alias("text"),
    )
    r = cr.repair(df).first()
    assert (r.cost, r.gaps, r.illegal, r.audit) == (2, 0, 0, "K" * 30_000 + "D")
    assert cr.repair(frame([], TALK)).collect() == []


def _sorted_suffixes(data, width, scratch):
    text = np.frombuffer(data + bytes(width + 8), np.uint8)
    found = list(induced_sort.suffixes_descending(text[: len(data)], 256, scratch, width, induced_sort.comparer(text, width)))
    return [x for _, pos, _ in found for x in pos.tolist()], [x for _, _, v in found for x in v.tolist()]


def _shared(a, b, width):
    return len(os.path.commonprefix((a[:width], b[:width])))


@pytest.mark.parametrize(("piece", "memory"), [(65_536, 1 << 30), (5, 300), (64, 60)])
def test_suffixes_and_common_prefixes(tmp_path, monkeypatch, piece, memory):
    """Ordinary and periodic strings, also where every queue and array is on disk."""
    monkeypatch.setattr(induced_sort, "PIECE", piece)
    rng = random.Random(piece)
    for n in [0, 1, 2, *[rng.randint(3, 150) for _ in range(250)]]:
        data = bytes(rng.randrange(1, rng.choice([2, 3, 4, 200])) for _ in range(n))
        data = rng.choice([data, data[:20] * 4 + data, bytes(sorted(data))])
        with induced_sort.Scratch(str(tmp_path), memory) as scratch:
            order, values = _sorted_suffixes(data, 9, scratch)
        want = sorted(range(len(data)), key=lambda i: data[i:], reverse=True)
        assert order == want
        assert values == [0] * bool(data) + [_shared(data[a:], data[b:], 9) for a, b in zip(want, want[1:], strict=False)]
    assert os.listdir(tmp_path) == []


def test_suffixes_on_disk(tmp_path):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(900)]
    data = " ".join(rng.choice(words) for _ in range(60_000)).encode()
    with induced_sort.Scratch(str(tmp_path), 200_000) as scratch:
        order, values = _sorted_suffixes(data, 50, scratch)
        assert scratch.files > 10
    assert sorted(order) == list(range(len(data)))
    for k in rng.sample(range(1, len(order)), 3000):
        a, b = data[order[k - 1] : order[k - 1] + 2000], data[order[k] : order[k] + 2000]
        assert a >= b and values[k] == _shared(a, b, 50)


def _overlapping(rng, n):
    """Texts that share passages, copies, near copies, and periodic and multi-byte ones."""
    parts = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(30, 140))) for _ in range(25)]
    rows = []
    for i in range(n):
        text = "".join(rng.choice(parts) if rng.random() < 0.6 else "".join(rng.choice("wxyz") for _ in range(rng.randint(5, 90))) for _ in range(rng.randint(0, 6)))
        if rng.random() < 0.1:
            text = "ab" * rng.randint(20, 300)
        if rows and rng.random() < 0.25:
            text = rng.choice(rows)[1] or ""
            at = rng.randrange(len(text) + 1)
            text = text[:at] + rng.choice(["", "!"]) + text[at:]
        rows.append((rng.choice([i, i, i, max(i - 3, 0), None]), rng.choice([text, text, text, None, ""]) if rng.random() < 0.1 else text))
    return rows


@pytest.mark.parametrize(("shard", "memory", "group"), [(16_000_000, 1 << 30, 4_000_000), (3000, 500, 2500)])
def test_shared_strings_of_documents(docs, monkeypatch, shard, memory, group):
    monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", group)
    rows = _overlapping(random.Random(shard), 160)
    found = suffix_dedup.remove_shared(docs(rows, 4), shard_bytes=shard, memory=memory)
    assert found.select("row.*").columns == ["doc_id", "lang", "row", "key", "n_words"]
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.digests(found).collect())
    want = sorted((str(d), *rest) for d, *rest in removed([(d, (t or "").encode()) for d, t in rows]))
    assert got == want and sum(r[2] > 0 for r in want) > 30


def test_shared_strings_edge_cases(docs):
    assert suffix_dedup.remove_shared(docs([])).collect() == []
    rows = [(1, None), (2, ""), (3, "x" * 49), (4, "x" * 49), (5, "y" * 50), (6, "y" * 51), (7, "z" * 200_000), (8, "q" + "z" * 60), (8, "z" * 60), (9, "ö" * 25), (10, "ö" * 30)]
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.digests(suffix_dedup.remove_shared(docs(rows))).collect())
    assert got == sorted(removed([(d, (t or "").encode()) for d, t in rows]))


def test_documents_stand_still(docs, monkeypatch):
    """The table of groups is read without an exchange of texts."""
    plan = suffix_dedup.remove_shared(docs([(1, "a" * 80), (2, "a" * 80)]))._jdf.queryExecution().executedPlan().toString()
    sides = [line for line in plan.splitlines() if "Exchange" in line]
    assert len(sides) == 1 and "Scan parquet" in plan
