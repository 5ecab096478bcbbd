import random

import numpy as np

from tabveil.llm import lines


def test_against_plain(spark, odd, none):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    shared = " ".join(word() for _ in range(14))
    rows = []
    for d in range(24):
        own = [f"Posted on day {d}", "All rights reserved.", f"own line of {'abcdefghij'[d % 10] * (1 + d)}", "12 34", "", f"user {word()} logged in", f"Posted by {word()} on {r.choice(['Monday', 'Friday', 'Sunday'])}"]
        own += [" ".join(word() for _ in range(r.randint(1, 9))) for _ in range(4)] + [shared] * (d in (5, 17))
        r.shuffle(own)
        rows.append((d, "\n".join(own)))
    rows += [(50, None), (51, ""), (None, "All rights reserved."), (60, shared + " 1"), (61, shared + " 2")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(map(tuple, lines.report(df, least=5).collect()), key=str)
    assert got == sorted(lines.plain_report(rows, least=5), key=str)
    assert sum(x[2] for x in got) >= 23 * 4 + 2
    assert lines.report(odd, least=2).count() == 8 and lines.report(none).count() == 0
    assert lines.dropped(odd, least=2).columns == ["doc_id", "text", "key", "part", "n_lines", "n_dropped"]


def test_fields_of_letters_are_generalised(spark):
    names = "Anna Boris Clara David Elena Frank Greta Hanno Irene Jonas Karla Louis".split()
    df = spark.createDataFrame([(i, f"user {x} logged in\nsomething that only {x} and {names[i - 1]} would ever say about {x * 2}") for i, x in enumerate(names)], "doc_id long, text string")
    got = {r.doc_id: (r.n_lines, r.n_dropped) for r in lines.report(df).collect()}
    assert got == {i: (2, int(i > 0)) for i in range(12)}


def test_copies_stay_whole(spark):
    text = "\n".join(" ".join(f"{c}{k}x" for k in "abcdefghijklm") for c in "pqrst")
    df = spark.createDataFrame([(1, text), (2, text), (3, text.split("\n")[0] + "\n" + "\n".join(x.upper() for x in text.split("\n")))], "doc_id long, text string")
    got = {r.doc_id: r.n_dropped for r in lines.dropped(df, copies=0.5).collect()}
    assert got == {1: 0, 2: 0, 3: 1}
    assert {r.doc_id: r.n_dropped for r in lines.dropped(df).collect()} == {1: 0, 2: 5, 3: 1}


def test_tree():
    assert lines.template('user 17 from a@b.c saw "x" at http://q/ now') == ["user", "<*>", "from", "<*>", "saw", "<*>", "at", "<*>", "now"]
    assert lines.path(["a", "b", "c"]) == (3, ("a",))
    assert lines.generalised("user anna logged in".split()) == [("user", "anna", "logged", "in"), ("user", "<*>", "logged", "in"), ("user", "anna", "<*>", "in"), ("user", "anna", "logged", "<*>")]
    assert not lines.generalised(["<*>"]) and lines.generalised(["a"]) == [("a",)]


def test_keys_are_those_of_the_templates():
    r = random.Random(9)
    texts = ["\n".join(" ".join(r.choice("a b c 1 d2".split()) for _ in range(r.randint(0, 8))) for _ in range(12)) for _ in range(20)]
    found = lines.Lines([t.encode() for t in texts], repeats=False)
    by: dict[tuple, set] = {}
    for k, key in zip(found.of.tolist(), zip(found.node.tolist(), found.leaf.tolist(), strict=True), strict=True):
        by.setdefault((int(found.doc[k]), int(found.line[k])), set()).add(key)
    names: dict = {}
    for d, t in enumerate(texts):
        for i, x in enumerate(t.split("\n")):
            want = lines.generalised(lines.template(x))
            keys = by.get((d, i), set())
            assert len(keys) == len(want)
            for w in want:
                names.setdefault(w, []).append(keys)
    assert all(len(set.intersection(*v)) >= 1 for v in names.values())
    assert isinstance(found.words, np.ndarray)
