import hashlib
import random
import re

import numpy as np

from tabveil.llm import decontaminate as D


def words(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def plain(docs, items, size):
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(size, len(w))
        for k in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = {}
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if x := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= x
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest())
    return out


def test_against_plain(spark, odd, none):
    r = random.Random(7)
    text = lambda n: "".join(r.choice("abc") * r.randint(1, 2) + r.choice([" ", ", ", "-", "É"]) for _ in range(n))
    items = [(i, text(r.randint(0, 14))) for i in range(12)] + [(12, None), (13, "!!")]
    docs = [(d, text(r.randint(0, 200)).upper() + (r.choice(items)[1] or "") + text(5)) for d in range(40)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for size, block in ((6, 8_000_000), (6, 60), (3, 90)):
        found = D.marked(df, bench, size, block)
        got = {x.doc_id: (x.hit_words, sum(s["last"] - s["first"] for s in x.hit_spans), len(x.hit_items)) for x in found.collect()}
        assert got == {d: v[:3] for d, v in plain(docs, items, size).items()}
    got = {x.doc_id: (x.n_words, x.n_hit, x.n_items, x.items_sha256) for x in D.report(df, bench, 6).collect()}
    assert got == plain(docs, items, 6)
    assert D.report(odd, bench).count() == 8 and D.report(none, bench).count() == 0 and D.report(df, bench.limit(0)).where("contaminated").count() == 0


def test_removal(spark):
    df = spark.createDataFrame([(1, "é start, one two three four. End", 9, "k"), (2, None, 9, "k"), (3, "clean text", 9, "k")], "doc_id long, text string, n_chars long, part string")
    out = {r.doc_id: r for r in D.removed(df, spark.createDataFrame([(1, "ONE two Three four")], "item_id long, text string")).collect()}
    assert out[1].text == "é start, . End" and out[1].n_chars == 14 and out[2].text is None and out[3].text == "clean text"


def test_index():
    rng = np.random.default_rng(8)
    s = np.concatenate([rng.integers(1, 4, 300), np.tile([1, 2, 3], 40)])
    sa = D.suffix_array(np.append(s, 0))
    full = np.append(s, 0).tolist()
    assert sa.tolist() == sorted(range(len(full)), key=lambda i: full[i:])
    index = D.FMIndex(s)
    for phrase in ([1, 2, 3], [3, 3], [2, 1, 1, 2], [9]):
        low, high = index.search(np.array([phrase]))
        got = sorted(index.locate(np.arange(low[0], high[0])).tolist())
        assert got == [i for i in range(len(s) - len(phrase) + 1) if s[i : i + len(phrase)].tolist() == phrase]


def test_ids_of_any_type(spark):
    df = spark.createDataFrame([(1, "one two three four five", "k"), (2, "two three", "k")], "doc_id long, text string, hit_items string")
    bench = spark.createDataFrame([("b-10", "three four"), ("b-9", "two three"), (None, "five")], "item_id string, text string")
    got = {r.doc_id: (r.n_hit, r.n_items, r.items_sha256) for r in D.report(df, bench).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got == {1: (4, 2, sha("b-10,b-9")), 2: (2, 1, sha("b-9"))}
    assert {r.doc_id: (r.text, r.hit_items) for r in D.removed(df, bench).collect()} == {1: ("one ", "k"), 2: ("", "k")}
