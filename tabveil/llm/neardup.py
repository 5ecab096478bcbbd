"""Near-duplicate documents by MinHash signatures in an LSH forest.

A document is its set of `size`-word shingles. Documents with equal sets are one class. Of each class, a signature
of minima goes into `trees` sorted orders; order t begins with its own minima and goes on through the others', so
that each is an order of whole signatures. Classes whose first `depth` values agree are a region. Along the sorted
region, candidates are

- all pairs, in a region of up to `near` + 1 classes, which is nearly every one;
- else the two neighbours before each class (they have the longest common prefixes), the region's first class, and the first
  class of the longest prefix that it shares with any before it, so that the depth follows how crowded the region is.

The sets' sizes and the share of equal minima rule out most pairs that cannot be links. Of the others, each class's
`best` are compared on the full sets first; then all pairs that still lie between two components,
and each class that met a crowded component in a region with that component's hubs: those of its classes whose
signatures agree most with its commonest minima, as the text that all are edits of would.
So every candidate is either compared or joins what is joined already.
A region of more than `most` classes is walked in random parts of that size, so that no task has more.

Pairs of a crowded region that are no candidates are met by their rare shingles: the shingle sets of all classes in
crowded regions go through an exact prefix filter, for classes of different components only. Of what it finds, the
signatures again rule out most; those of a pair at the threshold agree in `likely` of the minima but for one in 5,000.

Candidates are found with a probability: two documents at the threshold itself meet in some region with probability
1 - (1 - 0.75**3)**20 > 0.99998; what meets and may be a link is compared on the full sets. README has the measured share of links.

Cases: null, empty and wordless texts have no shingles and link with nothing; with fewer words than a shingle the
whole sequence is one; rows that share a doc_id are one document; a null doc_id links with nothing, has a null
component and is kept; an empty table gives an empty result; texts of any length are read whole; extra columns, of
whatever names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabveil.llm.common import only, written
from tabveil.llm.components import components, merged, of_component
from tabveil.llm.words import U, Words, mix, pieces, runs, windows

TREES, DEPTH, DEEPER = 20, 3, 5


def shingles(texts: list[bytes], size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(document, shingle hash), sorted, each once."""
    words = Words(texts, lower=True)
    h = words.hashes()
    n = len(words) - size + 1
    starts = np.flatnonzero(words.doc[:n] == words.doc[size - 1 :]) if n > 0 else np.zeros(0, np.int64)
    doc, value = words.doc[starts], windows(h, size)[starts] if n > 0 else np.zeros(0, np.uint64)
    short = np.flatnonzero((words.n > 0) & (words.n < size))
    if len(short):
        whole = [mix(np.array([sum(int(x) * pow(0xD1342543DE82EF95, k + 1, 1 << 64) for k, x in enumerate(h[words.first[d] : words.first[d + 1]])) % (1 << 64)], np.uint64))[0] for d in short]
        doc, value = np.concatenate([doc, short]), np.concatenate([value, np.array(whole, np.uint64)])
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return doc[new], value[new]


def signatures(docs: DataFrame, size: int = 5, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """doc_id, n_shingles, a, b (hashes of the set), signature (trees * depth minima, 4 bytes each, the upper first)."""
    k = trees * depth
    factors = mix(np.arange(1, k + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15)) | U(1)
    names = ["doc_id", "n_shingles", "a", "b", "signature"]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches, "text", 800_000):
            doc, value = shingles(texts, size)
            n = np.bincount(doc, minlength=len(texts))
            a, b = np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.uint64)
            out: list[bytes | None] = [None] * len(texts)
            if len(doc):
                at = runs(doc)[:-1]
                own = doc[at]
                a[own], b[own] = np.add.reduceat(mix(value ^ U(0x1234567)), at), np.add.reduceat(mix(value + U(0x89ABCDEF)), at)
                least = np.empty((len(own), k), ">u4")
                for j, f in enumerate(factors):
                    least[:, j] = np.minimum.reduceat(value * f, at) >> U(32)
                for d, row in zip(own.tolist(), least, strict=True):
                    out[d] = row.tobytes()
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(out, pa.binary())], names)

    return only(docs, doc_id="doc_id", text="text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(sign, "doc_id long, n_shingles long, a long, b long, signature binary")


def planted(classes: DataFrame, trees: int = TREES, depth: int = DEPTH, deeper: int = DEEPER) -> DataFrame:
    """(region, rest, doc_id, n): the place of each class in each tree."""
    width = 4 * trees * depth

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            m = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(-1, width)
            m = np.concatenate([m, m[:, : 4 * (depth + deeper)]], 1)
            for t in range(trees):
                at = 4 * depth * t
                top = np.ascontiguousarray(m[:, at : at + 4 * depth]).view("<u4").astype(np.uint64)
                region = np.full(len(m), t + 1, np.uint64)
                for j in range(depth):
                    region = mix(region * U(0x9E3779B97F4A7C15) + top[:, j])
                order = [x.tobytes() for x in m[:, at + 4 * depth : at + 4 * (depth + deeper)]]
                yield pa.RecordBatch.from_arrays([pa.array(region.view(np.int64)), pa.array(order, pa.binary()), b.column(0), b.column(1)], ["region", "rest", "doc_id", "n"])

    return classes.select("doc_id", "n_shingles", "signature").mapInArrow(plant, "region long, rest binary, doc_id long, n long")


def regions(classes: DataFrame, near: int = 8) -> DataFrame:
    """(region, m): the crowded regions, of more than near + 1 classes."""
    return planted(classes).groupBy("region").agg(F.count("*").alias("m")).where(F.col("m") > near + 1)


def candidates(classes: DataFrame, crowded: DataFrame, trees: int = TREES, depth: int = DEPTH, deeper: int = DEEPER, near: int = 8, threshold: int = 75, most: int = 50_000) -> DataFrame:
    """(u, v) of classes (doc_id, n_shingles, signature) that meet in the forest; u comes later in some order than v."""
    return met(classes, crowded, trees, depth, deeper, near, threshold, most).where("u <> v")


def met(classes: DataFrame, crowded: DataFrame, trees: int = TREES, depth: int = DEPTH, deeper: int = DEEPER, near: int = 8, threshold: int = 75, most: int = 50_000) -> DataFrame:
    """The candidates, and (u, u) for each class of a crowded region."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by region and rest. State: the last `near` classes of the region, and the first class of each shared prefix."""
        region, last, leaders, us, vs = None, [], [], [], []

        def pair(x: tuple, y: tuple) -> None:
            if 100 * min(x[1], y[1]) >= threshold * max(x[1], y[1]) and x[0] != y[0]:
                us.append(x[0])
                vs.append(y[0])

        for b in batches:
            for r, rest, doc, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                own = (doc, n, rest)
                if r != region:
                    region, last, leaders, seen = r, [own], [own] * (deeper + 1), 1
                    continue
                seen += 1
                if seen > near + 1:
                    own_too = [x[0] for x in ([leaders[0], *last, own] if seen == near + 2 else [own])]
                    us.extend(own_too)
                    vs.extend(own_too)
                # Up to near + 1 classes: all before it; then the nearest, and the first of the region and of the longest shared prefix.
                shared = [j for j, x in enumerate(leaders) if x[2][: 4 * j] == rest[: 4 * j]][-1]
                for x in last if seen <= near + 1 else dict.fromkeys([*last[-2:], leaders[0], leaders[shared]]):
                    pair(own, x)
                leaders = [x if j <= shared else own for j, x in enumerate(leaders)]
                last = [*last[-(near - 1) :], own]
            if len(us) > 20000:
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])
                us.clear()
                vs.clear()
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    # Parts of the largest regions; there are few of these, at most one for each `most` places.
    large = crowded.where(F.col("m") > most).select("region", F.ceil(F.col("m") / most).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("doc_id"), F.col("parts"))
    places = planted(classes, trees, depth, deeper).join(large, "region", "left")
    places = places.select(F.when(F.col("parts").isNull(), F.col("region")).otherwise(F.xxhash64("region", part)).alias("region"), "rest", "doc_id", "n")
    found = places.repartition("region").sortWithinPartitions("region", "rest", "doc_id").mapInArrow(walk, "u long, v long")
    return found.groupBy(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).agg(F.max("u").alias("u"), F.min("v").alias("v")).select("u", F.when(F.col("u") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("v"))


def confirmed(pairs: DataFrame, docs: DataFrame, size: int = 5, threshold: int = 75) -> DataFrame:
    """The pairs (u, v) whose documents' full sets have 100 * intersection >= threshold * union."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches, "x", 400_000):
            doc, value = shingles([t for pair in zip(texts, [y or b"" for y in part.column(3).cast(pa.binary()).to_pylist()], strict=True) for t in pair], size)
            n = np.bincount(doc, minlength=2 * len(texts)).reshape(-1, 2)
            pair = doc // 2
            order = np.lexsort((value, pair))
            p, h = pair[order], value[order]
            both = np.bincount(p[1:][(p[1:] == p[:-1]) & (h[1:] == h[:-1])], minlength=len(texts))
            union = n.sum(1) - both
            yield part.select(["u", "v"]).filter(pa.array((100 * both >= threshold * union) & (union > 0)))

    texts = only(docs, doc_id="doc_id", text="text").where("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), "text")
    x = pairs.join(texts, F.col("u") == F.col("id")).select("u", "v", F.col("text").alias("x"))
    y = x.join(texts, F.col("v") == F.col("id")).select("u", "v", "x", F.col("text").alias("y"))
    return y.mapInArrow(judge, "u long, v long")


def hubs(classes: DataFrame, found: DataFrame, least: int = 9, top: int = 8, most: int = 50_000) -> DataFrame:
    """(component, hub, y: its signature): of each component of `least` classes or more, dealt into `top` parts, the class of each part whose signature agrees most with the component's commonest first minima of the trees."""
    crowded = found.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") >= least - 1).select("component", (F.ceil(F.col("n") / most) * top).cast("int").alias("parts"))
    member = found.join(crowded, "component").select("u", "component", "parts").union(crowded.select(F.col("component").alias("u"), "component", "parts"))
    member = member.withColumn("part", F.pmod(F.xxhash64("u"), F.col("parts")).cast("int"))
    member = written(member.join(classes.select(F.col("doc_id").alias("u"), "signature"), "u"), "members")
    # The first minimum of each tree is enough to tell which text is in the middle.
    value = lambda t: F.substring("signature", t * (4 * DEPTH) + 1, F.lit(4))
    rows = member.select("component", "parts", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.conv(F.hex(value(t)), 16, 10).cast("long"))).alias("place", "value"))
    often = rows.groupBy("component", "place", "value").agg(F.count("*").alias("n"), F.first("parts").alias("parts"))
    common = often.groupBy("component").agg(F.array(*[F.max(F.when(F.col("place") == t, F.struct("n", "value")))["value"] for t in range(TREES)]).alias("common"), F.first("parts").alias("parts"))
    # A row for each part, so that the members of one component are dealt over many tasks.
    common = common.select("component", "common", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    agree = sum((F.conv(F.hex(value(F.lit(t))), 16, 10).cast("long") == F.col("common")[t]).cast("int") for t in range(TREES))
    best = F.max(F.struct(agree.alias("n"), (-F.col("u")).alias("u"), "signature")).alias("best")
    parts = member.join(common, ["component", "part"]).groupBy("component", F.pmod("part", F.lit(top)).alias("part")).agg(best)
    return parts.select("component", (-F.col("best.u")).alias("hub"), F.col("best.signature").alias("y"))


def _signed(pairs: DataFrame, classes: DataFrame, column: str, name: str) -> DataFrame:
    """pairs with the signature of a column's class."""
    return pairs.join(classes.select(F.col("doc_id").alias(column), F.col("signature").alias(name)), column)


def _alike(pairs: DataFrame, least: float) -> DataFrame:
    """(u, v, share): the pairs (u, v, x, y) whose signatures x and y agree in `least` of the minima or more."""

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), "<u4").reshape(b.num_rows, -1) for k in (2, 3))
                share = (x == y).mean(1)
                keep = share >= least
                yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep)), b.column(1).filter(pa.array(keep)), pa.array(share[keep])], ["u", "v", "share"])

    return pairs.select("u", "v", "x", "y").mapInArrow(alike, "u long, v long, share double")


def missed(classes: DataFrame, found: DataFrame, docs: DataFrame, crowded: DataFrame, size: int = 5, threshold: int = 75) -> DataFrame:
    """(u, v) of different components, both in `crowded` (doc_id: classes of crowded regions), that have a rare shingle in common; no pair at the threshold has none.

    With each class's shingles in one order, rarest first, two sets at the threshold t share one of the first n - ceil(2 t n / (1 + t)) + 1
    of the smaller and the first n - ceil(t n) + 1 of the larger. The classes of a component that are alike in size and place of the
    shingle are met as one, so that a large component does not cost the square of its size.
    """
    of = of_component(classes.select("doc_id", "n_shingles").join(crowded, "doc_id"), found, "doc_id", "component")
    of = written(of, "crowded")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches, "text", 800_000):
            doc, value = shingles(texts, size)
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc)), pa.array(value.view(np.int64))], ["doc_id", "value"])

    texts = only(docs, doc_id="doc_id", text="text").withColumn("doc_id", F.col("doc_id").cast("long")).join(of.select("doc_id"), "doc_id", "left_semi")
    sets = written(texts.mapInArrow(cut, "doc_id long, value long"), "sets")
    counted = sets.join(sets.groupBy("value").agg(F.count("*").alias("m")), "value").groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("m", "value"))).alias("sorted")).join(of, "doc_id")
    first = lambda up, down: (F.col("n_shingles") - F.ceil(F.col("n_shingles") * up / down) + 1).cast("int")
    rows = counted.select("doc_id", "n_shingles", "component", first(2 * threshold, 100 + threshold).alias("few"), F.posexplode(F.slice("sorted", F.lit(1), first(threshold, 100))).alias("at", "s"))
    rows = written(rows.where("s.m > 1").select(F.col("s.value").alias("value"), "doc_id", "n_shingles", "component", "at", (F.col("at") < F.col("few")).alias("small")), "prefixes")
    side = lambda c, d: d.select("value", F.col("component").alias(f"{c}c"), F.col("doc_id").alias(c), F.col("n_shingles").alias(f"{c}n"), (F.col("n_shingles") - F.col("at")).alias(f"{c}r"))
    u, v = side("u", rows.where("small")), side("v", rows)
    # Classes of a component with as many shingles, of which as many come later, are met as one.
    kinds = lambda c, d: d.select("value", f"{c}c", f"{c}n", f"{c}r").distinct()
    # From the first shingle that two sets share, each must have enough left for the intersection.
    enough = (100 + threshold) * F.least("ur", "vr") >= threshold * (F.col("un") + F.col("vn"))
    fits = (F.col("uc") != F.col("vc")) & (F.col("un") <= F.col("vn")) & (100 * F.col("un") >= threshold * F.col("vn")) & enough
    met = kinds("u", u).join(kinds("v", v), "value").where(fits)
    pairs = met.join(u, ["value", "uc", "un", "ur"]).join(v, ["value", "vc", "vn", "vr"])
    return pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def clusters(docs: DataFrame, size: int = 5, threshold: int = 75, best: int = 3) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row for each row of docs."""
    signed = written(signatures(docs, size), "signatures")
    classes = written(signed.where("doc_id is not null and n_shingles > 0").groupBy("a", "b").agg(F.min("doc_id").alias("doc_id"), F.min_by("signature", "doc_id").alias("signature"), F.min("n_shingles").alias("n_shingles")), "classes")
    # Twice over two and a half standard deviations below the threshold: what can be a link, and what may have one to the same component.
    likely, near = threshold / 100 - 0.2, threshold / 100 - 0.4
    meet = written(met(classes, written(regions(classes), "regions"), threshold=threshold), "met")
    alike = lambda pairs, least: _alike(_signed(_signed(pairs, classes, "u", "x"), classes, "v", "y"), least)
    left = written(alike(meet.where("u <> v"), near), "candidates")
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("share"), "v"))
    first = written(left.where(F.col("share") >= likely).withColumn("rank", rank).where(F.col("rank") <= best).select("u", "v"), "compared")
    found = written(components(confirmed(first, docs, size, threshold)), "components")
    # All other pairs between components, and the hubs. Components that are still apart then have links in crowded regions only.
    apart = written(of_component(of_component(left, found, "u", "uc"), found, "v", "vc").where("uc <> vc"), "apart")
    meets = apart.select("u", F.col("vc").alias("component")).union(apart.select(F.col("v").alias("u"), F.col("uc").alias("component"))).distinct()
    to_hubs = _alike(_signed(meets.join(written(hubs(classes, found), "hubs"), "component").withColumnRenamed("hub", "v"), classes, "u", "x"), likely)
    between = apart.where(F.col("share") >= likely).select("u", "v").union(to_hubs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))).distinct()
    found = written(merged(found, confirmed(between.join(first, ["u", "v"], "left_anti"), docs, size, threshold)), "components")
    rare = missed(classes, found, docs, meet.where("u = v").select(F.col("u").alias("doc_id")), size, threshold)
    found = written(merged(found, confirmed(alike(rare, likely).select("u", "v"), docs, size, threshold)), "components")
    of_class = classes.select("a", "b", F.col("doc_id").alias("u")).join(found, "u", "left").select("a", "b", F.coalesce("component", "u").alias("component"))
    out = signed.select("doc_id", "n_shingles", "a", "b").join(of_class, ["a", "b"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
