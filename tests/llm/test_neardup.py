import random

from tabveil.llm import neardup
from tabveil.llm.components import components, merged


def plain(rows):
    sets = {}
    for d, t in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d), find(d) == d) for d in sets}


def test_against_plain(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefghijkl") for _ in range(4))
    rows, n = [], 0
    for _ in range(25):
        base = [word() for _ in range(r.randint(3, 120))]
        for _ in range(r.choice([1, 1, 2, 5, 30])):
            w = [x if r.random() > 0.01 else word() for x in base]
            rows.append((n, " ".join(w).upper() if n % 2 else "\n".join(w)))
            n += 1
    rows += [(900, ""), (901, " "), (902, "one two"), (903, "ONE\ttwo")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in neardup.clusters(df).collect()}
    assert got == plain(rows)


def test_odd_rows(odd, none):
    got = sorted(((x.doc_id, x.n_shingles, x.component_id, x.kept) for x in neardup.clusters(odd).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (2, 0, 2, True), (3, 0, 3, True), (None, 2, None, True), (4, 1, 4, True), (5, 0, 5, True), (6, 1, 6, True)], key=str)
    assert neardup.clusters(none).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 105), (105, 103), (200, 201)]
    got = {r.u: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(1, 41), 0), 105: 100, 103: 100, 201: 200}
    found = merged(components(spark.createDataFrame(links[:40], "u long, v long")), spark.createDataFrame([*links[40:], (7, 201), (300, 105)], "u long, v long"))
    assert {r.u: r.component for r in found.collect()} == {**dict.fromkeys(range(1, 41), 0), 105: 100, 103: 100, 300: 100, 200: 0, 201: 0}


def test_components_in_several_tasks(spark):
    r = random.Random(7)
    links = [(i, i + 3) for i in range(60)] + [(500, 500 + r.randint(1, 40)) for _ in range(30)] + [(539, 20), (700, 800)]
    r.shuffle(links)
    df = spark.createDataFrame(links, "u long, v long").repartition(8)
    one, many = ({x.u: x.component for x in components(df, most).collect()} for most in (1000, 20))
    assert one == many
    assert all(one[i] == i % 3 for i in range(3, 63)) and one[800] == 700


def test_crowded_classes(spark):
    r = random.Random(3)
    rows = [(i, " ".join(["common words of all texts here in a row"] * 3 + [str(r.random()) for _ in range(3)])) for i in range(40)]
    rows += [(100 + i, " ".join(str(r.random()) for _ in range(20))) for i in range(10)]
    signed = neardup.signatures(spark.createDataFrame(rows, "doc_id long, text string"))
    regions = neardup.regions(signed)
    crowded = {x.doc_id for x in neardup.planted(signed).join(regions, "region").collect()}
    assert crowded and {x.u for x in neardup.met(signed, regions).where("u = v").collect()} == crowded


def test_crowded_regions(spark):
    # 300 texts with 160 of 200 shingles in common do not link; 20 have a copy at similarity 0.786 each.
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    common = [word() for _ in range(164)]
    rows = []
    for i in range(300):
        own = [word() for _ in range(40)]
        rows.append((1000 + i, " ".join(common + own)))
        if i < 20:
            rows.append((i, " ".join(common + own[:16] + [word() for _ in range(24)])))
    r.shuffle(rows)
    signed = neardup.signatures(spark.createDataFrame(rows, "doc_id long, text string"))
    pairs = neardup.candidates(signed, neardup.regions(signed), most=40)
    assert pairs.where("u = v").count() == 0 and pairs.count() > 300  # large regions are walked in parts
    got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in neardup.clusters(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain(rows)
    assert all(got[1000 + i][1] == i for i in range(20))
