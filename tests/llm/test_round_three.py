import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lattica.llm import automaton, conversation_trie, divergence, license_scan, quality_rules, queries, vocabulary, word_dedup

from .data import LONG, ODD, odd_documents

SF = "/root/testdata/sf0.001"


# ---- 11


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    turns = {c: [(r, t) for _, r, t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, t in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = turns.get(c - c % 100, [])[:h] + t[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, t in built.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
        ends[tuple(t)].append(c)
    out = []
    for node, m in members.items():
        under = [x for x in members if x[: len(node)] == node]
        kids = [x for x in under if len(x) == len(node) + 1]
        leaves = [x for x in under if not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in under)]
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in under if x)
        digest = hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()
        out.append((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(kids), len(leaves), saved, digest))
    return sorted(out, key=str)


def trie(spark, rows, chunk=None):
    df = spark.createDataFrame([(*r, "x", 3, 4) for r in rows], "conv_id long, turn long, role string, text string, digest string, at int, node int")
    got = conversation_trie.prefix_trie(conversation_trie.rebuilt(df))
    return sorted((tuple(r) for r in got.collect()), key=str)


def test_trie_of_odd_conversations(spark, monkeypatch):
    rng = random.Random(1)
    words = ["yes", "no", "", None, "ünï 😀"]
    rows = [(c, t if rng.random() < 0.9 else None, rng.choice(["user", "bot", None]), rng.choice(words)) for c in [*range(100, 112), 300, 301, 302, 417] for t in range(rng.randrange(1, 14))]
    rows += [(500, t, "user", "same") for t in range(40)] + [(501, t, "user", "same") for t in range(23)] + [(502, None, "bot", LONG), (502, None, "bot", LONG)]
    rows += [(None, 1, "user", "nobody"), (100, 0, "user", "yes"), (100, 0, "user", "yes")]
    monkeypatch.setattr(conversation_trie, "CHUNK", 4)
    monkeypatch.setattr(conversation_trie, "RANGE", 5)
    assert trie(spark, rows) == brute_trie(rows)


def test_trie_of_conversations_that_lose_all_turns(spark):
    short = [c for c in range(700, 800) if zlib.crc32(str(c).encode()) % 6 >= 1][:3]
    rows = [(c, 0, "user", "only") for c in short if c != 700]
    got = trie(spark, rows)
    assert got == brute_trie(rows) and len(got) == 1 and got[0][1] == 0
    assert trie(spark, []) == []


def test_trie_of_all_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.op11_conversation_trie(spark, SF)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_trie(rows)


# ---- 12


def brute_divergence(rows, min_docs, top):
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    docs, n, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low(text or ""))
        groups.add((lang, source))
        docs[lang].update(set(terms))
        n[lang, source].update(terms)
    out = []
    for lang, source in groups:
        kept = [t for t, k in docs[lang].items() if k >= min_docs]
        of = lambda s: {t: sum(n[lang, x][t] for x in s) for t in kept}

        def share(counts):
            total = sum(counts.values()) + 2 * len(kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // total for t in kept}

        f = lambda p, q: (p - q) ** 2 // (p + q)
        others = [s for x, s in groups if x == lang]
        mine, p, q = of([source]), share(of([source])), share(of(others))
        pairs = []
        for s in others:
            if s != source:
                o = share(of([s]))
                pairs.append((s, sum(f(p[t], o[t]) for t in kept)))
        terms = [(t, f(p[t], q[t])) for t in kept if mine[t] > 0 and p[t] > q[t]]
        for part, found, most in (("pair", pairs, None), ("term", terms, top)):
            found = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
            out += [(lang, source, part, item, value, k + 1) for k, (item, value) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("tile,slice_", [(64, 1 << 13), (2, 3)])
def test_divergence(spark, monkeypatch, tile, slice_):
    monkeypatch.setattr(divergence, "TILE", tile)
    monkeypatch.setattr(divergence, "SLICE", slice_)
    monkeypatch.setattr(divergence, "HELD", 20)
    rng = random.Random(2)
    words = ["a", "Bb", "cÉ", "d-e", "f9g", "數字", "hh", "z"]
    rows = list(ODD) + [(i, " ".join(rng.choices(words, k=rng.randrange(0, 12))), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", "d", "e", None, "é"])) for i in range(90)]
    rows += rows[-5:] + [(900, "lonely words", "xx", "a"), (901, "", "xx", "b")]
    got = divergence.source_divergence(odd_documents(spark, rows), min_docs=3, top=4)
    assert sorted(tuple(r) for r in got.select("lang", "source", "part", "item", "value", "rank").collect()) == brute_divergence(rows, 3, 4)


def test_divergence_of_nothing(spark):
    assert divergence.source_divergence(odd_documents(spark, [])).count() == 0
    assert divergence.source_divergence(odd_documents(spark, [(1, "alone", "en", "a")])).count() == 0


# ---- 13


def brute_words(rows, length):
    order = lambda d: (d is not None, d or 0)
    first, words = {}, [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t, *_ in rows]
    for (d, *_), w in zip(rows, words):
        for i in range(len(w) - length + 1):
            k, at = tuple(w[i : i + length]), (order(d), i)
            first[k] = min(first.get(k, at), at)
    out = []
    for (d, *_), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - length + 1):
            if first[tuple(w[i : i + length])] < (order(d), i):
                gone |= set(range(i, i + length))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [1000, 2])
def test_word_dedup_against_brute_force(spark, hot):
    rng = random.Random(4)
    words = ["ab", "c", "Dé", "e.", "x", "y"]
    text = lambda n: " ".join(rng.choices(words, k=n))
    common, near = text(30), text(60).split(" ")
    rows = [*ODD, (20, "x " * 60, "en", "a"), (21, common, "en", "a"), (19, common, "en", "a"), (19, common, "en", "b")]
    for i in range(25):
        copy = list(near)
        copy[rng.randrange(60)] = f"w{i}"
        rows.append((100 + rng.randrange(12), f"{text(5)}\n{common}\t{text(rng.randrange(30))} " + " ".join(copy), "en", "a"))
    rows += [(50, text(25) + " q", "en", "a"), (50, text(25), "en", "a"), (51, text(400), "en", "a")]
    got = word_dedup.remove_repeats(odd_documents(spark, rows), length=8, gram=3, hot=hot).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_words(rows, 8)


def test_word_dedup_of_all_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = queries.op13_word_dedup(spark, SF).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_words(rows, 20)


def test_word_dedup_keeps_texts_and_stands_empty_tables(spark):
    rows = [(2, " a b  c d\n", None, None), (1, "a b c", None, None), (None, "c d", None, None)]
    got = {r.doc_id: (r.n_removed, r.kept) for r in word_dedup.remove_repeats(odd_documents(spark, rows), length=2, gram=1, with_kept=True).collect()}
    assert got == {2: (4, ""), 1: (0, "a b c"), None: (0, "c d")}
    assert word_dedup.remove_repeats(odd_documents(spark, [])).count() == 0


def test_automaton_matches():
    a = word_dedup.Automaton()
    a.add(list("abcabd"))
    a.add(list("xbcabz"))
    assert list(a.matches(list("qbcabdq"), 3)) == [(1, 6)]
    assert list(a.matches(list("abcxbcabqqbca"), 3)) == [(0, 8), (10, 13)]
    assert list(a.matches([], 1)) == [] and list(word_dedup.Automaton().matches(["a"], 1)) == []


# ---- 7 and 8: texts of any length


@pytest.fixture(scope="module")
def known():
    pytest.importorskip("tokenizers")
    return vocabulary.load(queries.vocabulary_path())


def agree(known, texts):
    want = [np.array(known.tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    assert known.encode(texts) == want
    assert known.count(texts) == [len(w) // 4 for w in want]
    assert len(known.machine.keys) <= automaton.ROOM


def long_texts(n):
    rng = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyz"
    yield "".join(rng.choices(letters + "  ", k=n))
    yield "\n".join(base64.b64encode(rng.randbytes(57)).decode() for _ in range(n // 76))
    yield "".join(rng.choices(letters, k=n))
    yield "".join(rng.choices(["the", "quick", "ing", "zz", "abc"], k=n // 3))
    yield "a" * n
    yield ("abcxyzq" * n)[:n]
    yield "word " * (n // 5) + "é" * (n // 2)


@pytest.mark.parametrize("kind", range(7))
def test_long_texts_are_encoded_as_by_the_library(known, kind):
    agree(known, ["short one", [*long_texts(1_000_000 if kind > 3 else 350_000)][kind], "the end"])


@pytest.mark.parametrize("text", ["a", "abc ", "lorem ipsum "])
def test_ten_megabytes(known, text):
    agree(known, [text * (10_000_000 // len(text))])


@pytest.mark.parametrize("turns", [0, 1])
def test_chunks_without_guesses(known, monkeypatch, turns):
    monkeypatch.setattr(automaton, "TURNS", turns)
    agree(known, [t for t in long_texts(40_000)])


def test_full_tables_are_made_smaller_within_a_segment(known, monkeypatch):
    monkeypatch.setattr(automaton, "ROOM", 1 << 12)
    small = automaton.Machine(automaton.load_model(queries.vocabulary_path())["model"])
    monkeypatch.setattr(known, "machine", small)
    agree(known, [t for t in long_texts(60_000)])


# ---- 9: labels and scores


def license_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_licenses(texts, listed):
    import math

    words = [license_words(t) for t in texts]
    known = {w.decode() for t in listed for w in t.words}
    frequency = Counter(w for ws in words for w in set(ws) & known)
    idf = {w: math.log((1 + len(texts)) / (1 + frequency[w])) + 1e-9 for w in known}
    out = []
    for ws in words:
        places = []
        for t in listed:
            tw, key = [w.decode() for w in t.words], [w.decode() for w in t.key]
            total = sum(idf[w] for w in tw)
            for start in range(-len(tw), len(ws)):
                at = start + t.key_at
                if at >= 0 and ws[at : at + len(key)] == key:
                    hit = sum(idf[w] for i, w in enumerate(tw) if 0 <= start + i < len(ws) and ws[start + i] == w)
                    if hit >= t.least * total - license_scan.SLACK:
                        places.append((t.label, at, min(1.0, hit / total)))
        out.append((",".join(sorted({x[0] for x in places})), max((x[2] for x in places), default=0.0), sorted({f"{label}:{at}" for label, at, _ in places})))
    return out


def test_license_labels_and_scores_against_brute_force(spark):
    rng = random.Random(12)
    texts = [t for _, t, *_ in ODD]
    for label, _, text in [*license_scan.WHOLE, *((a, c, b) for a, b, c in license_scan.TEMPLATES)]:
        words = text.split()
        texts.append(f"Copyright (c) 2020 {label}\n\n{text}\n{text[:90]}")
        for share in (0.05, 0.2, 0.4):
            texts.append(" ".join(w if rng.random() > share else rng.choice(["zzz", "other", "the"]) for w in words))
        cut = rng.randrange(len(words))
        texts += [" ".join(words[:cut]), " ".join(words[cut:]), " ".join([*words[:cut], "inserted", *words[cut:]]), text.upper().replace(" ", "\t--\n")]
    texts += ["under the mit license " * 3, "apache license version 2", "cc by nc cc by", "the the the the of of"]
    docs = odd_documents(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    got = {r.doc_id: (r.labels, r.score, sorted(set(r.spans.split(",")) - {""})) for r in license_scan.scan_licenses(docs).collect()}
    for i, (labels, score, spans) in enumerate(brute_licenses(texts, license_scan.templates())):
        assert got[i][0] == labels and got[i][1] == pytest.approx(score) and got[i][2] == spans, texts[i]
    assert sum(bool(x[0]) for x in got.values()) > 40


# ---- 10: lines of distinct texts


def brute_distinct_lines(rows):
    words = lambda s: re.findall(r"[^\x20\x09-\x0D]+", s)
    norm = lambda s: " ".join(words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)))
    texts, lines = defaultdict(set), defaultdict(set)
    for _, t, _, s in rows:
        texts[s].add(t)
        for x in (t or "").split("\n"):
            if norm(x):
                lines[s, norm(x)].add(t)
    out = []
    for i, t, _, s in rows:
        own = [x for x in (t or "").split("\n")]
        gone = sum(len(words(x)) for x in own if norm(x) and len(lines[s, norm(x)]) > max(5, len(texts[s]) ** 0.5))
        w = words(t or "")
        tri = Counter(zip(w, w[1:], w[2:]))
        hit = {k + d for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for d in range(3)}
        failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
        out.append((i, len(w), failed, not failed and len(w) - gone >= max(50, 0.5 * len(w)), len(w) - gone))
    return sorted(out, key=str)


def test_quality_by_distinct_texts_against_brute_force(spark):
    rng = random.Random(13)
    fresh = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    menu, rare = "Home | About  | CONTACT us today", "seen in few"
    rows = list(ODD)
    for i in range(40):
        n = 45 + i
        rows.append((1000 + i, f"{menu}\n{fresh(n)}\n{rare if i < 5 else fresh(2)}\n{menu.lower()}", "en", "hot"))
    rows += [(2000 + i, f"copied line\n{fresh(60) if i == 0 else 'x'}", "en", "copies") for i in range(1)]
    copy = f"copied line\n{fresh(60)}"
    rows += [(2100 + i, copy, "en", "copies") for i in range(30)] + [(2200, None, "en", None), (2201, fresh(5000) + "\n" + menu, "en", "hot")]
    got = quality_rules.judge_quality(odd_documents(spark, rows), max_share=None).collect()
    assert sorted(((r.doc_id, r.n_words, r.base_failed, r.kept, r.words_left) for r in got), key=str) == brute_distinct_lines(rows)
    assert any(not r.base_failed and not r.kept for r in got) and any(r.kept and r.words_left < r.n_words for r in got)
