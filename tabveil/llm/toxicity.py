"""Toxicity: a weighted lexicon, matched by Aho-Corasick after folding, normalised by length.

Folding maps homoglyphs (accents, full-width and mathematical letters, Cyrillic and Greek look-alikes) and
digit substitutions to plain letters; ``l`` and ``i`` fold together, as ``1`` stands for either. A term is a
whole word (``" word "``) or a beginning of words (``" word"``). Matches inside an exception phrase do not
count. A word counts once, with its heaviest term; the score is a logistic function of the weight per 100
words and of the total weight.

`fit` learns the terms from a bounded sample of labelled rows (``per_label`` rows of each label, those with the
smallest hash of doc_id). Candidates are ranked by smoothed log odds; a greedy cover keeps the fewest terms
that explain the toxic rows, so that the ordinary words of copied toxic texts do not enter. Seeds, common insults,
are terms as well unless clean rows hold them.

Cases: null and empty texts score as texts without a match; null doc_ids are scored, count as not held out and
teach nothing; repeated rows each give a row; without toxic labels the lexicon is empty and every score is the
share of toxic labels (0 without labels); ties of doc_id are scored each; an empty table gives an empty result; texts of
any length are matched whole; extra columns, of whatever names, are ignored (`rejected` keeps them).
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabveil.llm.common import only, written

#: Letters that look alike, and digits that stand for letters.
LOOK_ALIKE = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ѵ": "v", "ӏ": "i",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ł": "i", "ø": "o", "đ": "d", "ħ": "h", "ß": "ss", "æ": "ae", "œ": "oe",
    "0": "o", "1": "i", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
}
#: Common insults: terms from the start, unless the labels speak against them.
SEEDS = (
    "idiot moron imbecile stupid dumb dumbass fool loser pathetic worthless useless disgusting disgrace scum trash garbage filth vermin clown jerk bastard asshole bitch slut whore cunt dickhead douchebag prick "
    "retard retarded freak creep pervert coward liar crap shit bullshit fuck fucking motherfucker"
).split()
#: Harmless phrases that hold a seed or a beginning of one.
EXCEPTIONS = tuple(
    "trash can|trash bin|garbage can|garbage collection|garbage collector|garbage truck|garbage disposal|clown fish|class clown|jerk chicken|dumb bell|dumb waiter|dumb terminal|mission creep|scope creep|feature creep|fool proof|fools gold|"
    "april fool|pond scum|prick of a needle|retard the growth|retard the spread|stupid simple|useless information|pathetic fallacy|coward of the county|scum line".split("|")
)
_LEET = re.compile(r"(?<=\w)[@$!|](?=\w)")
_LEET_AS = {"@": "a", "$": "s", "!": "i", "|": "i"}


def _fold_table() -> dict[int, str]:
    """Code point -> what it folds to: the base letter of its decomposition; not a letter: a space."""
    table: dict[int, str] = {}
    spans = [(0x00, 0x250), (0x370, 0x530), (0x1E00, 0x2000), (0x2000, 0x2070), (0xFF00, 0xFF5F), (0x1D400, 0x1D800)]
    for cp in (c for a, b in spans for c in range(a, b)):
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(cp)).lower() if not unicodedata.combining(c))
        base = "".join(LOOK_ALIKE.get(c, c) for c in base)
        if unicodedata.category(chr(cp)) in ("Cf", "Mn"):
            base = ""
        elif not base or not all(c.isalpha() for c in base):
            base = " "
        table[cp] = base.replace("l", "i")
    table |= {cp: "" for cp in [*range(0x300, 0x370), 0xFEFF, 0x00AD]}
    return table


_TABLE = _fold_table()
#: The same for ASCII, as a byte table.
_ASCII = "".join(_TABLE[c] for c in range(128)).encode("ascii") + bytes(range(128, 256))


def fold(text: str) -> str:
    """Folded letters and single characters of space between words, with a space at either end."""
    if "@" in text or "$" in text or "!" in text or "|" in text:
        text = _LEET.sub(lambda m: _LEET_AS[m[0]], text)
    if text.isascii():
        text = text.encode("ascii").translate(_ASCII).decode("ascii")
    else:
        text = text.translate(_TABLE)
    return f" {text} "


@dataclass
class Lexicon:
    """terms: folded term with its leading (and, for a whole word, trailing) space -> weight; slopes: intercept, per 100 words, total."""

    terms: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    slopes: tuple[float, float, float] = (-30.0, 0.0, 0.0)

    def automaton(self) -> ahocorasick.Automaton | None:
        found = ahocorasick.Automaton()
        for term, weight in self.terms.items():
            found.add_word(term, (term, weight))
        for phrase in self.exceptions:
            found.add_word(phrase, (phrase, -1.0))
        if len(found):
            found.make_automaton()
            return found
        return None


def matches(folded: str, automaton: ahocorasick.Automaton | None) -> list[tuple[int, str, float]]:
    """(start, term, weight): the heaviest term at each word, without those that an exception phrase covers."""
    best: dict[int, tuple[float, str]] = {}
    safe: list[tuple[int, int]] = []
    for end, (term, weight) in automaton.iter(folded) if automaton else ():
        start = end - len(term) + 1
        if weight < 0:
            safe.append((start, end))
        elif weight > best.get(start, (0.0, ""))[0]:
            best[start] = (weight, term)
    return [(s, t, w) for s, (w, t) in sorted(best.items()) if not any(a <= s and s + len(t) - 1 <= b for a, b in safe)]


def _features(total: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.stack([np.ones_like(total), np.log1p(100 * total / np.maximum(words, 1)), np.log1p(total)], 1)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def train_rows(doc_id: Column) -> Column:
    """Rows that labels may be learned from: crc32 of doc_id as text, mod 3, is not 1. Null: none."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1, F.lit(False))


def _terms_of(folded: str, shortest: int = 4, longest: int = 8) -> set[str]:
    """Its words, and their beginnings of `shortest` to `longest` letters."""
    words = set(folded.split())
    return {f" {w} " for w in words} | {f" {w[:k]}" for k in range(shortest, longest + 1) for w in words if len(w) >= k}


def _cover(toxic: list[set[str]], weight: dict[str, float], cost: dict[str, float], least: int, layers: int = 3) -> list[str]:
    """Terms, most newly explained rows first, until each row has `layers` of them or none is left.

    cost: rows of the clean label, as a share that counts like rows of the toxic one. Of terms that explain
    nearly as many rows, the longest; none that another covers.
    """
    where: dict[str, list[int]] = {}
    for i, terms in enumerate(toxic):
        for t in terms & weight.keys():
            where.setdefault(t, []).append(i)
    chosen, left = [], [layers] * len(toxic)
    while where:
        gain = {t: sum(left[i] > 0 for i in rows) - 5 * cost.get(t, 0.0) for t, rows in where.items()}
        top = max(gain.values())
        if top < least:
            break
        best = max((t for t, g in gain.items() if g >= 0.97 * top), key=lambda t: (len(t), gain[t], t))
        chosen.append(best)
        for i in where[best]:
            left[i] -= 1
        where = {t: rows for t, rows in where.items() if gain[t] >= least and not t.startswith(best) and not best.startswith(t)}
    return chosen


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_label: int = 8000, least_share: float = 0.004, exceptions: tuple[str, ...] = EXCEPTIONS, seeds: tuple[str, ...] = tuple(SEEDS)) -> Lexicon:
    """Learn a lexicon. per_label bounds the sample of labelled rows, and so the terms of `least_share` of its toxic rows that are weighed."""
    spark = docs.sparkSession
    known = only(labels, id="doc_id", y=label).where(train_rows(F.col("id")) & F.col("y").isin(0, 1)).distinct()
    ids = [r for y in (0, 1) for r in known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(per_label).collect()]
    if not ids:
        return Lexicon()
    sample = F.broadcast(spark.createDataFrame([(r["id"], int(r["y"])) for r in ids], "id long, y int"))
    texts = only(docs, id="doc_id", text="text").where("text is not null").join(sample, "id").select("y", "text").distinct()

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fold(t) for t in b.column(1).to_pylist()], pa.string())], ["y", "text"])

    rows = written(texts.mapInArrow(folded, "y int, text string"), "toxicity-sample")
    n = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    pos, neg = n.get(1, 0), n.get(0, 0)
    if not pos or not neg:
        share = pos / max(pos + neg, 1)
        return Lexicon(slopes=(math.log((share + 1e-9) / (1 - share + 1e-9)), 0.0, 0.0))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                found.update(_terms_of(t))
                if len(found) > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["term", "n"])
                    found.clear()
        yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["term", "n"])

    least = max(3, math.ceil(least_share * pos))
    top = rows.where("y = 1").select("text").mapInArrow(counted, "term string, n long").groupBy("term").agg(F.sum("n").alias("p")).where(F.col("p") >= least).collect()
    p = {r["term"]: r["p"] for r in top}
    own = {f" {fold(w).strip()} " for w in seeds}
    looked_for = frozenset(p) | own

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            terms = [sorted(_terms_of(t) & looked_for) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(terms, pa.list_(pa.string()))], ["y", "terms"])

    against = {r["term"]: r["n"] for r in rows.where("y = 0").mapInArrow(hits, "y int, terms array<string>").select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect()}
    weight = {t: math.log((p[t] + 0.5) / (pos + 1)) - math.log((against.get(t, 0) + 0.5) / (neg + 1)) for t in p}
    weight = {t: w for t, w in weight.items() if w >= 3 and p[t] >= 20 * against.get(t, 0) * pos / neg}
    given = {t: max(4.0, weight.get(t, 0.0)) for t in own if p.get(t, 0) >= 20 * against.get(t, 0) * pos / neg}
    looked_for = frozenset(weight)
    toxic = [set(r["terms"]) for r in rows.where("y = 1").mapInArrow(hits, "y int, terms array<string>").toLocalIterator()]
    lexicon = Lexicon(given | {t: weight[t] for t in _cover(toxic, weight, {t: against.get(t, 0) * pos / neg for t in weight}, least)}, [fold(x).rstrip() + " " for x in exceptions])
    at = scored_rows(rows.select(F.col("y").cast("long").alias("doc_id"), "text"), lexicon, is_folded=True).select("doc_id", "total", "n_words").collect()
    y = np.array([r["doc_id"] for r in at], float)
    x = _features(np.array([r["total"] for r in at], float), np.array([r["n_words"] for r in at], float))
    # Weighted so that both labels count alike; a weak ridge keeps the slopes finite where the labels separate.
    share, w = np.where(y == 1, 0.5 / pos, 0.5 / neg), np.zeros(3)
    for _ in range(60):
        q = _logistic(x @ w)
        ridge = np.array([1e-6, 1e-4, 1e-4])
        step = np.linalg.solve((x * (share * q * (1 - q))[:, None]).T @ x + np.diag(ridge) + 1e-9 * np.eye(3), x.T @ (share * (y - q)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    lexicon.slopes = tuple(map(float, w))
    return lexicon


def scored_rows(docs: DataFrame, lexicon: Lexicon, is_folded: bool = False) -> DataFrame:
    """doc_id, n_words, n_matches, total (weight), score; one row for each row of docs."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for b in batches:
            for low in range(0, b.num_rows, 256):
                part = b.slice(low, 256)
                words, total, count = [], [], []
                for text in part.column(1).to_pylist():
                    text = (text or "  ") if is_folded else fold(text or "")
                    found = matches(text, automaton)
                    words.append(len(text.split()))
                    total.append(sum(m[2] for m in found))
                    count.append(len(found))
                score = _logistic(_features(np.array(total, float), np.array(words, float)) @ np.array(lexicon.slopes))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words, pa.int64()), pa.array(count, pa.int64()), pa.array(total, pa.float64()), pa.array(score, pa.float64())], ["doc_id", "n_words", "n_matches", "total", "score"])

    return only(docs, doc_id="doc_id", text="text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(scored, "doc_id long, n_words long, n_matches long, total double, score double")


def score(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted, and the figures behind the score."""
    rows = scored_rows(docs, lexicon)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_words", "n_matches", "total")


def rejected(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.7) -> DataFrame:
    """docs without those that score as toxic; all columns stay. One pass: the text is scored beside its row."""
    schema = docs.schema
    at = docs.columns.index("text")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, slopes = lexicon.automaton(), np.array(lexicon.slopes)
        for b in batches:
            for low in range(0, b.num_rows, 256):
                part = b.slice(low, 256)
                folded = [fold(t or "") for t in part.column(at).to_pylist()]
                total = np.array([sum(m[2] for m in matches(t, automaton)) for t in folded], float)
                stay = _logistic(_features(total, np.array([len(t.split()) for t in folded], float)) @ slopes) < threshold
                yield part.filter(pa.array(stay))

    return docs.mapInArrow(kept, schema)
