import hashlib
import random

from tabveil.llm import substring


def plain(rows, span):
    seen, out = {}, {}
    for doc, text in sorted(rows):
        w = text.encode().split()
        gone = set()
        for k in range(len(w) - span + 1):
            if seen.setdefault(tuple(w[k : k + span]), doc) < doc:
                gone.update(range(k, k + span))
        out[doc] = (len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest())
    return out


def test_against_plain(spark):
    r = random.Random(1)
    word = lambda: r.choice("abcdefgh") * r.randint(1, 3)
    passage = [word() for _ in range(30)]
    rows = []
    for d in range(60):
        w = [word() for _ in range(r.randint(0, 60))]
        if d % 3 == 0:
            at = r.randint(0, len(w))
            w[at:at] = passage[r.randint(0, 8) : r.randint(12, 30)]
        rows.append((d, r.choice([" ", "\n"]).join(w)))
    rows += [(100 + k, rows[3 * k][1]) for k in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for span, size in ((6, 64_000_000), (10, 64_000_000), (6, 900)):  # the last: several buckets a partition
        found = substring.without_repeats(df, span, bucket_bytes=size)
        got = {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in found.collect()}
        assert got == plain(rows, span)


def test_odd_rows(odd, none):
    got = [(r.doc_id, r.n_words, r.n_removed) for r in substring.without_repeats(odd, 4, keep_text=True).collect()]
    assert sorted(got, key=str) == sorted([(1, 6, 0), (1, 6, 0), (2, 0, 0), (3, 0, 0), (None, 6, 0), (4, 30000, 0), (5, 0, 0), (6, 2, 0)], key=str)
    assert substring.without_repeats(none).count() == 0
