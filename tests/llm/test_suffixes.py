import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from lattica.llm import suffix_array, suffix_dedup

from .data import LONG, ODD, odd_documents

SF = "/root/testdata/sf0.001"


def samples():
    rng = random.Random(5)
    yield b""
    yield b"a"
    yield b"aaaaaaaaaaaaaaaaaaaaaaaaaaaa"
    yield b"banana" * 9 + b"\xff" + b"bandana" * 7
    yield b"mississippi"
    yield bytes(range(256)) + bytes(range(255, -1, -1))
    for n, letters in ((50, b"ab"), (300, b"ab"), (500, b"abc\xff"), (400, bytes(range(256)))):
        for _ in range(20):
            yield bytes(rng.choice(letters) for _ in range(n))
    word = bytes(rng.choice(b"abcdef ") for _ in range(120))
    yield b"\xff".join(word[rng.randrange(60) :] + b"zyxwvutsrqponml" * 3 for _ in range(30))


@pytest.mark.parametrize("depth", [1 << 20, 7, 40])
def test_suffix_array_against_sorting(depth):
    for raw in samples():
        got = suffix_array.suffix_array(np.frombuffer(raw, dtype=np.uint8), depth)
        assert sorted(got.tolist()) == list(range(len(raw)))
        cut = [raw[i : i + depth] for i in got.tolist()]
        assert cut == sorted(cut)


def test_adjacent_prefixes():
    for raw in samples():
        text = np.frombuffer(raw, dtype=np.uint8)
        if not len(text):
            continue
        array = suffix_array.suffix_array(text, 100)
        got = suffix_array.adjacent_prefixes(text, array, 20).tolist()
        for k, (a, b) in enumerate(zip(array.tolist(), array[1:].tolist()), 1):
            n = next((j for j in range(20) if a + j >= len(raw) or b + j >= len(raw) or raw[a + j] != raw[b + j]), 20)
            assert got[k] == n


def brute(rows, length):
    raws = [(t or "").encode() for _, t, *_ in rows]
    count = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for (i, *_), r in zip(rows, raws):
        hit = bytearray(len(r))
        for s in range(len(r) - length + 1):
            if count[r[s : s + length]] > 1:
                hit[s : s + length] = b"\1" * length
        spans = sum(h and (k == 0 or not hit[k - 1]) for k, h in enumerate(hit))
        kept = bytes(c for c, h in zip(r, hit) if not h)
        out.append((i, len(r), sum(hit), spans, hashlib.sha256(kept).hexdigest()))
    return out


def passages():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(12), text(40), text(90)]
    rows = []
    for i in range(60):
        parts = [text(rng.randrange(0, 40))]
        for s in rng.sample(shared, rng.randrange(0, 3)):
            parts += [s, text(rng.randrange(0, 5))]
        rows.append((i, " ".join(parts), "en", "a"))
    rows += [(100 + i, rows[i][1], "en", "a") for i in range(5)]
    rows += [(200 + i, rows[3][1][:-i], "en", "a") for i in range(1, 9)]
    rows += [(400 + i, text(i) + " again and" * (20 + i), "en", "a") for i in range(6)]
    return rows + [(300, "z" * 300, "en", "a"), (301, "ab" * 200 + "q", "en", "a"), (302, None, "en", "a"), (303, "", "en", "a"), (None, shared[2] * 2, "en", "a")]


@pytest.mark.parametrize("length,gram,hot,alike", [(40, 8, 2000, 9), (40, 8, 2, 1 << 18), (20, 16, 1, 1 << 18), (40, 8, 2, 0), (8, 8, 1, 3)])
def test_repeats_against_brute_force(spark, monkeypatch, length, gram, hot, alike):
    monkeypatch.setattr(suffix_dedup, "ALIKE", alike)
    rows = passages()
    got = suffix_dedup.remove_repeats(odd_documents(spark, rows), length=length, gram=gram, with_kept=True, hot=hot).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(brute(rows, length), key=str)
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in got)


def holders(n, seed=3):
    """n texts around one passage of 707 bytes."""
    rng = random.Random(seed)
    text = lambda k: "".join(rng.choice("abcdefgh ") for _ in range(k))
    shared = text(707)
    return shared, [(i, text(150 + i % 60) + shared + text(120 + i % 90), "en", "a") for i in range(n)]


def test_a_passage_of_many_holders(spark):
    shared, rows = holders(1200)
    got = suffix_dedup.remove_repeats(odd_documents(spark, rows), hot=20).collect()
    # neighbours may agree by chance on a byte or two beside the passage
    assert all(707 <= r.n_removed <= 725 and r.n_spans == 1 for r in got)


def test_rows_sent_grow_with_the_holders(spark, monkeypatch):
    sent = {}
    for n in (400, 1600):
        _, rows = holders(n)
        made = []
        real = suffix_dedup._arrow_map

        def counted(df, schema, fn, made=made, real=real):
            out = real(df, schema, fn)
            if schema in (suffix_dedup.CONTEXTS, suffix_dedup.WIDE):
                made.append(out.count())
            return out

        monkeypatch.setattr(suffix_dedup, "_arrow_map", counted)
        suffix_dedup.remove_repeats(odd_documents(spark, rows), hot=10).count()
        monkeypatch.setattr(suffix_dedup, "_arrow_map", real)
        sent[n] = sum(made)
    assert sent[1600] <= 5 * sent[400] <= 5 * 400 * 60


def test_tables_and_odd_rows(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    rows += [(10_000 + i, t, "en", "z") for i, (_, t, *_) in enumerate(ODD)]
    rows += [(20_000, LONG[:2500] + "tail", "en", "z"), (20_001, rows[0][1][100:900] + "é", "en", "z")]
    got = suffix_dedup.remove_repeats(odd_documents(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute(rows, 400), key=str)
    assert suffix_dedup.remove_repeats(odd_documents(spark, [])).count() == 0


def test_long_texts_are_cut_into_parts(monkeypatch):
    raw = bytes(random.Random(1).choice(b"abcd ") for _ in range(5000))
    whole = suffix_dedup.anchors(raw, 100, 16)
    monkeypatch.setattr(suffix_dedup, "PART", 700)
    parts = suffix_dedup.anchors(raw, 100, 16)
    owner = lambda x: {s: (int(h), int(p)) for h, p, a, b in zip(*x) for s in range(a, b + 1)}
    assert owner(whole) == owner(parts) and len(owner(whole)) == 4901
