import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from lattica.llm import automaton, license_scan, quality_rules, queries, simhash, token_count, token_file, url_filter, vocabulary
from lattica.llm.components import connected_components

from .data import ODD, odd_documents

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(queries.vocabulary_path())


def documents(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]


# ---- 1


def brute_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    sh = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(prints):
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def test_simhash_against_brute_force(spark):
    rows = documents(spark) + [(10_000 + i, t, "en", "z") for i, (_, t, _, _) in enumerate(ODD)]
    docs = odd_documents(spark, rows)
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    prints = [brute_fingerprint(t) for _, t, _, _ in rows]
    roots = brute_components(prints)
    smallest = {}
    for (i, *_), r in zip(rows, roots):
        smallest[r] = min(i, smallest.get(r, i))
    assert len(got) == len(rows)
    for (i, *_), p, r in zip(rows, prints, roots):
        assert (got[i].fingerprint, got[i].component_id) == (f"{p:016x}", smallest[r])


def test_anchors_lose_no_link(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = []
    for x in base:
        for k in (1, 2, 3, 4):
            y = int(x)
            for b in rng.choice(64, k, replace=False):
                y ^= 1 << int(b)
            near.append(y)
    values = sorted({int(x) for x in base} | set(near))
    expected = {(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if bin(a ^ b).count("1") <= 3}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    got = simhash.links(spark.createDataFrame([(signed(x),) for x in values], "fp long")).collect()
    assert {tuple(sorted((r.a % (1 << 64), r.b % (1 << 64)))) for r in got} == expected


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(300)] + [(1000, 1000 + k) for k in range(1, 200)] + [(5, 5), (None, 3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(301)} | {1000 + k: 1000 for k in range(200)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_keep_one(spark):
    docs = odd_documents(spark)
    kept = simhash.keep_one(docs).collect()
    # empty, null and blank texts are one component, as are the repeated rows
    ids = Counter(r.doc_id for r in kept)
    assert ids == Counter([1, 2, None, 5, 6, 7, 8, 9])
    assert set(kept[0].asDict()) == set(docs.columns)
    assert {(r._row, r.fingerprint, r.n_words, r.host) for r in kept} == {(1, "x", 7, "y")}
    assert simhash.keep_one(odd_documents(spark, [])).count() == 0
    assert simhash.near_duplicates(odd_documents(spark, [])).count() == 0


# ---- 2


def brute_verdict(url, block, allow):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1], m[2]) if m else ("", "")
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for rules, verdict in ((block, "block"), (allow, "allow")):
        for r in rules:
            h, p = r[: r.index("/")], r[r.index("/") :]
            if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or (len(r), len(h)) >= best[0]):
                best = ((len(r), len(h)), r, verdict)
    return host, path, best and best[1], best[2] if best else "allow"


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://", "http://NET/", "http://net", "https://a.NET/x?y://z/", "ftp://x.example.net/en/1#f", "http://example.net/en", "http://a.example.com/de/", "http://xexample.com/de/", "http://b.org/fr/x", "http://org/fr", "://net/", "http://u.net?x/", "a://b://net/", "http://" + "a." * 5000 + "net/" + "p" * 9000, "http://é.net/", "http://x..net/"]
    rows = [(i, u, 1, "x") for i, u in enumerate(urls)] + [(None, "http://net/", 1, "x"), (3, urls[3], 1, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, rule int, host string")
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(df, queries.BLOCK, queries.ALLOW).collect()), key=str)
    assert got == sorted(((i, *brute_verdict(u, queries.BLOCK, queries.ALLOW)) for i, u, *_ in rows), key=str)
    assert url_filter.filter_urls(df.limit(0), queries.BLOCK, []).count() == 0
    assert url_filter.filter_urls(df, [], []).where("rule is not null").count() == 0


def test_colliding_keys_are_confirmed(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda s, seed=0: len(s) % 3)
    block, allow = [f"h{i}.net/" for i in range(30)], [f"h{i}.net/a/" for i in range(10)]
    path = tmp_path / "index"
    path.write_bytes(url_filter.build_index(block, allow))
    index = url_filter.DigestIndex(str(path))
    urls = [(f"www.h{i}.net", p) for i in range(40) for p in ("/", "/a/b", "")]
    for (host, p), (rule, verdict) in zip(urls, index.judge(urls)):
        assert (host, p, rule, verdict) == brute_verdict(f"x://{host}{p}", block, allow)


# ---- 7, 8


def test_token_counts(spark, tokenizer):
    rows = documents(spark) + [(10_000 + i, t, "en", "z") for i, (_, t, _, _) in enumerate(ODD)]
    got = {r.doc_id: r for r in token_count.count_tokens(odd_documents(spark, rows), queries.vocabulary_path()).collect()}
    for i, t, *_ in rows:
        n = len(tokenizer.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 2048), i


@pytest.mark.parametrize("chunk", [1, 2, 7, 64, 512])
def test_chunk_maps_compose(tokenizer, monkeypatch, chunk):
    monkeypatch.setattr(automaton, "CHUNK", chunk)
    words = vocabulary.Vocabulary(queries.vocabulary_path())
    texts = [t for _, t, *_ in ODD if t and len(t) < 1000] + ["x" * 700 + " don't", "'" * 90 + "ll's we've l've 12a", " a\n"]
    ids = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert words.count(texts) == [len(x) for x in ids]
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in words.encode(texts)] == ids


@pytest.mark.parametrize("letters", ["abcdefghij klmnopqrstuvwxyz ' .,!?|éüñ ß123", "th e in g ' s re ll ve an d", "aàAÀ×÷İıſﬁΣς數٣½ \x1c\x85\u3000\u0308'<|> 9"])
def test_random_texts_against_the_library(tokenizer, monkeypatch, letters):
    monkeypatch.setattr(automaton, "ROOM", 3000)
    words = vocabulary.Vocabulary(queries.vocabulary_path())
    parts = list(letters) if "th" not in letters else [*letters.split(" "), " "]
    rng = random.Random(4)
    for _ in range(40):
        texts = ["".join(rng.choices(parts, k=rng.randrange(60))) for _ in range(30)]
        ids = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert words.count(texts) == [len(x) for x in ids]
        assert [np.frombuffer(x, dtype="<u4").tolist() for x in words.encode(texts)] == ids


def test_vocabularies_of_another_kind_go_to_the_library():
    from importlib import import_module

    from tokenizers import Tokenizer

    path = import_module("public_tokenizers").path("byte_bpe_50k.json")
    words, library = vocabulary.Vocabulary(path), Tokenizer.from_file(path)
    texts = ["Some text, isn't it?", "", None, "數字 é"]
    assert not words.by_word and words.count(texts) == [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]


def test_token_files(spark, tokenizer):
    rows = documents(spark) + [(10_000 + i, t, "en", "z") for i, (_, t, _, _) in enumerate(ODD)] + [(None, "null id", "en", "z"), (None, None, "en", "z")]
    got = token_file.write_and_read(odd_documents(spark, rows), queries.vocabulary_path()).collect()
    start, out = 0, []
    for i, t, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got), key=lambda x: x[1]) == out
    assert token_file.write_and_read(odd_documents(spark, []), queries.vocabulary_path()).count() == 0


def test_token_file_random_access_and_damage(spark, tokenizer, tmp_path):
    docs = odd_documents(spark)
    manifest = token_file.write_token_files(docs, f"file://{tmp_path}", queries.vocabulary_path())
    assert token_file.find_document(spark, f"file://{tmp_path}", manifest, 1) == [[*tokenizer.encode(ODD[0][1], add_special_tokens=False).ids, 1]] * 2
    assert token_file.find_document(spark, f"file://{tmp_path}", manifest, 77) == []
    path = next(p for p in tmp_path.iterdir() if p.name.startswith("part") and p.stat().st_size > 300)
    raw = bytearray(path.read_bytes())
    raw[12] ^= 0xFF
    path.write_bytes(raw)
    with open(path, "rb") as f, pytest.raises(Exception):  # noqa: B017
        token_file.Reader(f).ids(0)


def test_long_documents_take_several_frames(tmp_path, monkeypatch):
    monkeypatch.setattr(token_file, "FRAME_BYTES", 8)
    docs = [(1, np.arange(5, dtype="<u4").tobytes()), (2, b""), (None, np.arange(2, dtype="<u4").tobytes())]
    with open(tmp_path / "f", "wb") as f:
        w = token_file.Writer(f)
        for i, raw in docs:
            w.add(i, raw)
        w.close()
    with open(tmp_path / "f", "rb") as f:
        r = token_file.Reader(f)
        assert [(r.doc_id(k), r.ids(k)) for k in range(3)] == docs


# ---- 9


def test_license_base_against_brute_force(spark):
    extra = [(20_000, "Under the MIT-license! under the mit license; CC BY-NC cc by nc apache license VERSION 2.0", "en", "z"), (20_001, "x under the mit", "en", "z"), (20_002, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "en", "z")]
    rows = documents(spark) + [(10_000 + i, t, "en", "z") for i, (_, t, _, _) in enumerate(ODD)] + extra
    got = {r.doc_id: r for r in license_scan.scan_licenses(odd_documents(spark, rows)).collect()}
    for i, t, *_ in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places = [(k, label) for p, label in license_scan.BASE_PHRASES for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        r = got[i]
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert (r.first_word, r.last_word) == (min((k for k, _ in places), default=None), max((k for k, _ in places), default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) or not r.base_labels
        assert 0 <= r.score <= 1
    assert got[20_002].labels == "mit" and got[20_002].base_labels == ""
    assert license_scan.scan_licenses(odd_documents(spark, [])).count() == 0


# ---- 10


def brute_quality(rows):
    words = lambda s: re.findall(r"[^\x20\x09-\x0D]+", s)
    norm = lambda s: " ".join(words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)))
    docs, lines = Counter(s for *_, s in rows), defaultdict(Counter)
    for _, t, _, s in rows:
        lines[s].update({norm(x) for x in (t or "").split("\n")} - {""})
    out = []
    for i, t, _, s in rows:
        t = t or ""
        w = words(t)
        tri = Counter(zip(w, w[1:], w[2:]))
        hit = {k + d for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for d in range(3)}
        own = [x for x in t.split("\n") if words(x)]
        dup = sum(x in own[:k] for k, x in enumerate(own))
        failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
        left = sum(len(words(x)) for x in t.split("\n") if not (lines[s][norm(x)] > 20 and lines[s][norm(x)] > 0.1 * docs[s]))
        out.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(hit), failed, not failed and left >= 0.5 * len(w)))
    return out


def test_quality_against_brute_force(spark):
    boiler = "Accept  all our COOKIES and terms of use before you read on here now "
    rows = documents(spark) + [(10_000 + i, *r[1:]) for i, r in enumerate(ODD) if r[1] is None or len(r[1]) < 40000]
    rows += [(30_000 + i, (boiler + "\n") * 3 + " ".join(f"w{i}x{k}" for k in range(30 + i)), "en", "hot") for i in range(40)]
    got = quality_rules.judge_quality(odd_documents(spark, rows)).collect()
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    assert sorted((tuple(r[c] for c in columns) for r in got), key=str) == sorted(brute_quality(rows), key=str)
    assert quality_rules.judge_quality(odd_documents(spark, [])).count() == 0


def test_quality_removes_frequent_lines(spark):
    rows = [(i, "Common   line\n" + " ".join(f"own{i}word{k}" for k in range(60)), "en", None) for i in range(30)]
    got = quality_rules.judge_quality(odd_documents(spark, rows), with_text=True, carry=["lang"]).collect()
    assert all(r.kept and r.clean_text.startswith("own") and r.words_left == 60 for r in got)
