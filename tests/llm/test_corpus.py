import hashlib
import random
import re
from collections import Counter

import pytest

from lattica.llm import decontaminate, mixing

from .data import ODD, odd_documents

SF = "/root/testdata/sf0.001"


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


# ---- 3


def brute_contamination(docs, items):
    windows = {}
    for name, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[i : i + 13]), set()).add("" if name is None else str(name))
    sizes = {len(w) for w in windows}
    for i, text, *_ in docs:
        w, hit, found = words(text), set(), set()
        for k in sizes:
            for a in range(len(w) - k + 1):
                if names := windows.get(tuple(w[a : a + k])):
                    hit.update(range(a, a + k))
                    found |= names
        yield i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


PASSAGE = " ".join(f"w{i % 17}é" for i in range(40))
ITEMS = [(1, PASSAGE), (2, "Short item!"), (None, "null name item of exactly thirteen words a b c d e f g"), (3, None), (4, "--"), (5, PASSAGE), (5, PASSAGE + " more"), (10, "quick brown")]
DOCS = [*ODD, (50, "x " + PASSAGE.upper().replace("É", "é") + " y short item", "en", "a"), (51, PASSAGE[:60], "en", "a"), (52, "short, ITEM", "en", "a"), (53, " ".join(["filler"] * 100) + " short item", "en", "a")]


@pytest.mark.parametrize("slice_bytes", [1 << 20, 1, 300])
def test_contamination_against_brute_force(spark, slice_bytes):
    benchmark = spark.createDataFrame([(*r, 9) for r in ITEMS], "item_id long, text string, n_hit int")
    got = decontaminate.judge(odd_documents(spark, DOCS), benchmark, slice_bytes=slice_bytes).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute_contamination(DOCS, ITEMS), key=str)


def test_contamination_of_the_tables(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    expected = list(brute_contamination([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()]))
    assert sorted(map(tuple, decontaminate.judge(docs, items).collect())) == sorted(expected)
    kept = decontaminate.decontaminate(docs, items)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {x[0] for x in expected if not x[-1]}


def test_small_shards_give_the_same(spark, monkeypatch):
    tests = decontaminate.TestSuffixes([(str(i), t) for i, t in ITEMS])
    docs = [words(t) for _, t, *_ in DOCS]
    docs = [[w.encode() for w in d] for d in docs]
    hit, items = decontaminate.Shard(docs, tests).judge()
    for k, d in enumerate(docs):
        own, found = decontaminate.Shard([d], tests).judge()
        whole = decontaminate.Shard(docs, tests)
        at = int(whole.starts[k])
        assert own[: len(d)].tolist() == hit[at : at + len(d)].tolist() and found[0] == items[k]


def test_longest_matches(spark):
    docs = spark.createDataFrame([(1, "aa " + PASSAGE + " bb " + " ".join(PASSAGE.split()[5:25]))], "doc_id long, text string")
    items = spark.createDataFrame([("p", PASSAGE)], "item_id string, text string")
    got = decontaminate.longest_matches(docs, items).collect()
    # the passage repeats itself every 17 words, so that shifted matches are as real
    assert {(r.doc_word, r.item_word, r.n_words) for r in got} >= {(1, 0, 40), (42, 5, 20)}
    d, i = words(docs.first().text), words(PASSAGE)
    for r in got:
        assert d[r.doc_word : r.doc_word + r.n_words] == i[r.item_word : r.item_word + r.n_words]


@pytest.mark.parametrize("slice_bytes", [1 << 20, 2000])
def test_longest_match_of_each_document(spark, slice_bytes):
    rng = random.Random(4)
    word = lambda: rng.choice("abcdefgh")
    items = [(i, " ".join(word() for _ in range(rng.choice([2, 13, 14, 40, 60])))) for i in range(30)]
    items += [(100 + i, items[i][1][: 60 - i] + " tail of its own " + items[i + 1][1]) for i in range(20)]
    docs = []
    for i in range(60):
        parts = []
        for _ in range(rng.randrange(4)):
            w = items[rng.randrange(len(items))][1].split()
            a = rng.randrange(max(1, len(w) - 12))
            parts += [word(), *w[a : a + rng.randrange(10, 60)]]
        docs.append((i, " ".join(parts), "en", "a"))
    read = [(str(n), words(t)) for n, t in items]
    want = {}
    for i, text, *_ in docs:
        w, best = words(text), (0, 0)
        for a in range(len(w)):
            for _, x in read:
                for s in range(max(1, len(x) - 12)):
                    m = 0
                    while a + m < len(w) and s + m < len(x) and w[a + m] == x[s + m]:
                        m += 1
                    if m >= min(13, len(x)):
                        best = max(best, (m, -a))
        want[i] = (best[0], -best[1]) if best[0] else (None, None)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.judge(odd_documents(spark, docs), benchmark, slice_bytes=slice_bytes, with_longest=True).collect()
    assert {r.doc_id: (r.longest, r.longest_at) for r in got} == want and any(want.values())
    names = dict(read)
    for r in got:
        if r.longest:
            run = " ".join(words(docs[r.doc_id][1])[r.longest_at : r.longest_at + r.longest])
            assert f" {run} " in f" {' '.join(names[r.longest_item])} "


@pytest.mark.parametrize("slice_bytes", [1 << 20, 300])
def test_clean_documents_keep_their_columns(spark, slice_bytes):
    docs = odd_documents(spark, DOCS).withColumnsRenamed({"host": "_hits", "fingerprint": "_items", "n_chars": "n_hit"})
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    kept = decontaminate.decontaminate(docs, benchmark, slice_bytes=slice_bytes)
    bad = {(x[0], x[1]) for x in brute_contamination(DOCS, ITEMS) if x[-1]}
    assert bad and kept.schema == docs.schema
    assert sorted(map(tuple, kept.collect()), key=str) == sorted((tuple(r) for r in docs.collect() if (r.doc_id, len(words(r.text))) not in bad), key=str)


def test_empty_tables(spark):
    docs, items = odd_documents(spark), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.judge(docs, items).where("n_hit > 0").count() == 0
    assert decontaminate.judge(docs.limit(0), items).count() == 0
    assert decontaminate.decontaminate(docs, items).count() == docs.count()


# ---- 4


def brute_deal(children, total):
    """children: name -> (weight, capacity). Water is poured until all is dealt; then floors."""
    order = sorted(children, key=lambda c: (children[c][1] / children[c][0], c))
    out, left, weight = {}, total, sum(w for w, _ in children.values())
    for k, c in enumerate(order):
        w, cap = children[c]
        if cap * weight <= left * w:
            out[c], left, weight = cap, left - cap, weight - w
        else:
            return out | {x: min(children[x][1], left * children[x][0] // weight) for x in order[k:]}
    return out


def brute_mix(rows, weights, domains, share, epochs, seed):
    w = lambda *p: weights.get(p, weights.get(("*", *p[1:]), 1))
    docs = [(i, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), domains.get(s or "", "other"), lang or "", s or "") for i, t, lang, s in rows]
    cap = Counter()
    for _, n, *leaf in docs:
        for k in range(4):
            cap[tuple(leaf[:k])] += n * epochs
    for _, _, *leaf in docs:
        for k in range(4):
            cap[tuple(leaf[:k])] += 0
    nodes = {k: v for k, v in {**{tuple(x[2 : 2 + k]): 0 for x in docs for k in range(4)}, **cap}.items()}
    budget = {(): min(sum(x[1] for x in docs) * share[0] // share[1], cap[()])}
    for k in range(3):
        for parent in [p for p in nodes if len(p) == k]:
            kids = {c: (w(*c), nodes[c]) for c in nodes if len(c) == k + 1 and c[:k] == parent}
            budget |= brute_deal(kids, budget[parent])
    out = []
    for leaf in {tuple(x[2:]) for x in docs}:
        own = [x for x in docs if tuple(x[2:]) == leaf]
        tokens, b = sum(x[1] for x in own), budget[leaf]
        for e in range(1, epochs + 2):
            whole = [b >= tokens]
            key = lambda x, e=e: (int(hashlib.md5(f"{seed}:{e}:{x[0]}".encode()).hexdigest()[:15], 16), x[0])
            for x in sorted(own, key=key) if b < tokens else own:  # a whole epoch takes every document
                if b <= 0 < tokens and not whole[0] or tokens == 0:
                    break
                out.append((x[0], e, *leaf, x[1], budget[leaf]))
                b -= x[1]
            if tokens == 0 or b <= 0:
                break
    return out


ROWS = [(i, " ".join(["w"] * (i * 7 % 23)), ["en", "de", None][i % 3], ["a", "b", "c", None, "a", "a"][i % 6]) for i in range(300)]


@pytest.mark.parametrize("share,epochs", [((6, 10), 2), ((1, 3), 1), ((5, 1), 3), ((1, 1), 1)])
def test_mixture_against_brute_force(spark, share, epochs):
    weights = {("x",): 3, ("other",): 2, ("*", "en"): 4, ("x", "de"): 9, ("other", "en", "b"): 5}
    domains = {"a": "x", "c": "x"}
    got = mixing.mix(odd_documents(spark, ROWS), weights, domains, "other", share, epochs, seed=3).collect()
    assert sorted(map(tuple, got)) == sorted(brute_mix(ROWS, weights, domains, share, epochs, 3))


def test_ranges_do_not_change_the_mixture(spark, monkeypatch):
    docs = odd_documents(spark, ROWS)
    whole = sorted(map(tuple, mixing.mix(docs, {}, {}, "d").collect()))
    monkeypatch.setattr(mixing, "RANGE_ROWS", 3)
    assert sorted(map(tuple, mixing.mix(docs, {}, {}, "d").collect())) == whole


def test_shortage_goes_to_siblings_first(spark):
    rows = [(1, "w " * 10, "en", "small"), (2, "w " * 1000, "en", "big"), (3, "w " * 1000, "de", "big")]
    got = {(r.language, r.src): r.leaf_budget for r in mixing.mix(odd_documents(spark, rows), {}, {}, "d", share=(1, 2), max_epochs=1).collect()}
    assert got == {("en", "small"): 10, ("en", "big"): 492, ("de", "big"): 502}


def test_mixture_of_odd_rows(spark):
    docs = odd_documents(spark)
    assert mixing.mix(docs, share=(9, 1), max_epochs=1).count() <= docs.count()
    taken = mixing.mix(docs, share=(9, 1), max_epochs=1, rows=True)
    assert taken.columns == docs.columns and {r.doc_id for r in taken.collect()} >= {1, 5, 6, 7, 8, 9, None}
    assert mixing.mix(docs.limit(0)).count() == 0
