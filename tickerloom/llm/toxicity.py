"""Toxicity: a lexicon trie met by Levenshtein automata, with windows that tell quotation from abuse.

learn() finds the lexicon in labelled training rows: words, and stems that stand for every word they begin, whose
document frequency among toxic texts is far above that among others. Each cluster of near copies counts once, by the
least hash of its four-word windows. The terms form a trie; a word of a text is matched by walking the trie with the
states of a Levenshtein automaton (rows of edit distances, at most edits_allowed(length of the term), a swap of
neighbours being one edit, any letter free), so misspelled terms are found without listing variants. Words that
training rows show to be innocent are left out one by one. A window of WINDOW words on either side of a match is a
quotation where it has quote marks or a reporting word (reporting words are those that training rows show beside
matches in texts that are not toxic). Counts of direct, misspelled and quoted matches feed a ridge logistic model.

A term stands in LEAST_DOCS toxic texts at least, with a lift that is significant among all the terms tested
(BY_ACCIDENT); no share is asked for.
Fitting uses about SAMPLE labelled rows (by hash of doc_id), which bound the lexicon and the other words learnt; scoring
reads every text.

Null text is empty text and gets the score of a text without matches. Null labels are ignored; the largest of repeated
labels counts. With one class or none in the labels every score is the share of label 1 (0 without labels). Repeated
rows are scored once each. An empty table gives an empty result. Columns of docs other than doc_id and text are not
read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from statistics import NormalDist
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.common import written

SAMPLE = 20_000
THRESHOLD = 0.7
WINDOW = 6
#: A term's least document frequency among toxic texts, its least lift, and the chance that any of the terms tested passes
#: by accident: its lift lies so many standard deviations (signed root of the likelihood ratio) above none that all the
#: tests together keep to this chance.
LEAST_DOCS, LEAST_LIFT, BY_ACCIDENT = 5, 6.0, 0.05
STEMS = range(3, 9)
HELD = 300_000
FEATURES = ("any", "direct", "direct_density", "spread", "misspelled", "quoted", "length")

_WORD = r"[\p{L}\p{M}\p{N}@$]+"
_QUOTES = "\"«»“”„‘’>"
_END, _STEM, _MOST = "\0", "\1", "\2"
_FAR = 1 << 20


def tokens(text: str) -> list[str]:
    import regex

    return regex.findall(_WORD, text.lower())


def edits_allowed(length: int) -> int:
    """Edits within which a term of so many letters is found."""
    return 0 if length < 4 else 1 if length < 9 else 2


def _shortened(word: str, most: int) -> set[str]:
    """word without up to most of its letters."""
    out = last = {word}
    for _ in range(most):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        out = out | last
    return out


class Trie:
    """Lexicon terms as nested dictionaries; a term ending in * is a stem, any continuation of it matches.

    Two words within k edits share a word that both become by k deletions at most, so the automaton need only walk for
    words that share one with a term: that test loses no match and spares most words the walk.
    """

    def __init__(self, terms: list[str]) -> None:
        self.root: dict = {}
        self.bodies = [term.rstrip("*") for term in terms]
        #: Shortened terms by the edits they are found within, with their lengths; those of stems; beginnings to be looked at.
        self.whole = {k: (set().union(*[_shortened(b, k) for b in bs]), min(map(len, bs)) - k, max(map(len, bs)) + k) for k in (1, 2) if (bs := [b for b in self.bodies if edits_allowed(len(b)) == k])}
        stems = [b for b, term in zip(self.bodies, terms, strict=True) if term.endswith("*") and len(b) >= 5]
        self.heads = set().union(*[_shortened(b, 1) for b in stems])
        self.head_lengths = sorted({len(b) + d for b in stems for d in (-1, 0, 1)})
        #: First three letters of the shortened terms that one deletion, and that two lead to: most words fail on these.
        self.near_starts = {v[:3] for v in self.heads} | {v[:3] for v in (self.whole[1][0] if 1 in self.whole else ())}
        self.far_starts = {v[:3] for v in (self.whole[2][0] if 2 in self.whole else ())}
        for i, (term, body) in enumerate(zip(terms, self.bodies, strict=True)):
            node, most = self.root, edits_allowed(len(body))
            node[_MOST] = max(node.get(_MOST, 0), most)
            for ch in body:
                node = node.setdefault(ch, {})
                node[_MOST] = max(node.get(_MOST, 0), most)
            node[_STEM if term.endswith("*") else _END] = i

    def match(self, word: str) -> tuple[int, int] | None:
        """(edits, term) of the nearest term, else null; exact matches first, then the automaton's."""
        node, stem = self.root, None
        for ch in word:
            node = node.get(ch)
            if node is None:
                break
            stem = node.get(_STEM, stem)
        else:
            if _END in node:
                return 0, node[_END]
        if stem is not None:
            return 0, stem
        if not self._possible(word):
            return None
        # A state is (node, its letter, row, the row before): row[j] is the distance between the trie's path and word[:j].
        width, best = len(word) + 1, None
        stack = [(self.root, "", list(range(width)), None)]
        while stack:
            node, letter, row, before = stack.pop()
            depth = row[0]
            whole = node.get(_END, node.get(_STEM))
            if whole is not None and row[-1] <= edits_allowed(depth) and (best is None or row[-1] < best[0]):
                best = (row[-1], whole)
            # A misspelled stem of five letters or more: one edit from some beginning of a longer word.
            if _STEM in node and depth >= 5 and width - 1 > depth and min(row) <= 1 and (best is None or min(row) < best[0]):
                best = (min(row), node[_STEM])
            for ch, child in node.items():
                if ch in (_END, _STEM, _MOST):
                    continue
                # Only the band that most edits can reach; what lies outside it counts as too far.
                most = child[_MOST]
                new = [depth + 1] + [_FAR] * (width - 1)
                for j in range(max(1, depth + 1 - most), min(width, depth + 2 + most)):
                    cost = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (word[j - 1] != ch))
                    if before is not None and j > 1 and word[j - 1] == letter and word[j - 2] == ch:  # neighbours swapped
                        cost = min(cost, before[j - 2] + 1)
                    new[j] = cost
                if min(new) <= most:
                    stack.append((child, ch, new, row))
        return best

    def _possible(self, word: str) -> bool:
        """Whether word, or a beginning of it, shares a shortened form with a term. Of a word from four letters on, a form
        with one letter less begins with three of its first four letters, one with two less with three of its first five."""
        n = len(word)
        a, b, c, d, e = (word + "     ")[:5]
        if n < 4 or not self.near_starts.isdisjoint((a + b + c, b + c + d, a + c + d, a + b + d)):
            near, least, most = self.whole.get(1, ((), 1, 0))
            if least <= n <= most and not near.isdisjoint(_shortened(word, 1)):
                return True
            if any(not self.heads.isdisjoint(_shortened(word[:p], 1)) for p in self.head_lengths if p <= n):
                return True
        far, least, most = self.whole.get(2, ((), 1, 0))
        if not least <= n <= most:
            return False
        starts = (a + b + c, a + b + d, a + b + e, a + c + d, a + c + e, a + d + e, b + c + d, b + c + e, b + d + e, c + d + e)
        return not self.far_starts.isdisjoint(starts) and not far.isdisjoint(_shortened(word, 2))


@dataclass
class Model:
    terms: list[str] = field(default_factory=list)
    reporting: frozenset[str] = frozenset()
    innocent: frozenset[str] = frozenset()
    weights: np.ndarray | None = None  # bias last
    prior: float = 0.0

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.prior)
        return 1.0 / (1.0 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -60, 60)))


class Matcher:
    """Features of texts under a model; remembers words' matches, at most HELD of them."""

    def __init__(self, terms: list[str], reporting: frozenset[str] = frozenset(), innocent: frozenset[str] = frozenset()) -> None:
        self.trie, self.reporting, self.innocent, self.known = Trie(terms), reporting, innocent, {}

    def hits(self, words: list[str]) -> list[tuple[int, int, int]]:
        """(place, edits, term) of every match."""
        if len(self.known) > HELD:
            self.known.clear()
        for w in set(words).difference(self.known):
            hit = self.trie.match(w)
            self.known[w] = None if hit and hit[0] and w in self.innocent else hit
        found = {w for w in set(words) if self.known[w] is not None}
        return [(i, *self.known[w]) for i, w in enumerate(words) if w in found] if found else []

    def features(self, text: str) -> list[float]:
        import regex

        words = tokens(text)
        hits = self.hits(words)
        if not hits:
            return [0.0] * (len(FEATURES) - 1) + [math.log1p(len(words))]
        marks = any(q in text for q in _QUOTES)
        if marks:
            text = text.lower()  # some letters lower-case to two, so places are those of the lowered text
        spans = [m.span() for m in regex.finditer(_WORD, text)] if marks else []
        direct, wrong, quoted, kinds = 0, 0, 0, set()
        for place, edits, term in hits:
            near = range(max(0, place - WINDOW), min(len(words), place + WINDOW + 1))
            said = any(words[k] in self.reporting for k in near)
            if not said and marks:
                before, after = text[max(0, spans[near[0]][0] - 1) : spans[place][0]], text[spans[place][1] : spans[near[-1]][1] + 1]
                said = any(q in before for q in _QUOTES) and any(q in after for q in _QUOTES)
            if said:
                quoted += 1
            else:  # misspelled terms count like others and once more by themselves
                direct += 1
                wrong += edits > 0
                kinds.add(term)
        return [
            float(direct > 0),
            math.log1p(direct),
            math.sqrt(direct / len(words)),
            math.log1p(len(kinds)),
            math.log1p(wrong),
            math.log1p(quoted),
            math.log1p(len(words)),
        ]


def _batch(columns: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], list(columns))


def sampled_labels(labels: DataFrame, train: Column, sample: int) -> DataFrame:
    """label_id and label of about sample training rows, by hash of doc_id."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & train)
    known = known.groupBy(F.col("doc_id").alias("label_id")).agg(F.max("toxic").cast("int").alias("label"))
    total = known.count()
    if total > sample:
        known = known.where(F.pmod(F.xxhash64(F.col("label_id").cast("string"), F.lit("toxicity")), F.lit(1 << 30)) < int((1 << 30) * sample / total))
    return known


def _cluster(words: list[str]) -> int:
    return min((crc32(" ".join(words[i : i + 4]).encode()) for i in range(max(1, len(words) - 3))), default=0)


def learn(docs: DataFrame, labels: DataFrame, train: Column, sample: int = SAMPLE) -> Model:
    """The model from docs' labelled training rows."""
    chosen = sampled_labels(labels, train, sample)
    # About sample rows of two numbers each: small enough to broadcast whatever the tables' size.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).select("label_id", "label", F.coalesce("text", F.lit("")).alias("text"))

    def cluster(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [_cluster(tokens(t.as_py())) for t in b.column(2)]
            yield _batch({"label_id": (b.column(0).to_pylist(), pa.int64()), "label": (b.column(1).to_pylist(), pa.int32()), "cluster": (keys, pa.int64())})

    kinds = rows.mapInArrow(cluster, "label_id bigint, label int, cluster bigint").groupBy("cluster", "label").agg(F.min("label_id").alias("label_id"))
    few = kinds.select("label_id", "label").toArrow()
    if not few.num_rows:
        return Model()
    ids, marks = few["label_id"].to_pylist(), few["label"].to_pylist()
    n1, n0 = sum(marks), len(marks) - sum(marks)
    if not n1 or not n0:
        return Model(prior=n1 / len(marks))
    chosen = docs.sparkSession.createDataFrame(few)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).select("label", F.coalesce("text", F.lit("")).alias("text"))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = _batch({"term": ([k[0] for k in held], pa.string()), "label": ([k[1] for k in held], pa.int32()), "n": (list(held.values()), pa.int64())})
            held.clear()
            return out

        for b in batches:
            for label, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = set(tokens(text.as_py()))
                stems = {w[:k] + "*" for w in words for k in STEMS if len(w) >= k}
                held.update((t, label) for t in words | stems)
                if len(held) > HELD:
                    yield flush()
        yield flush()

    seen = rows.mapInArrow(tally, "term string, label int, n bigint").groupBy("term").agg(
        F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("b")
    )
    seen = written(seen.where(F.col("a") + F.col("b") >= LEAST_DOCS), "toxicity-terms")
    least_z = NormalDist().inv_cdf(1 - BY_ACCIDENT / max(seen.count(), 1))
    share = (F.col("a") + 0.5) / n1
    lift = share / ((F.col("b") + 0.5) / n0)
    expected = (F.col("a") + F.col("b")) * n1 / (n1 + n0)
    evidence = F.col("a") * F.log(F.col("a") / expected) + F.when(F.col("b") > 0, F.col("b") * F.log(F.col("b") / (F.col("a") + F.col("b") - expected))).otherwise(0)
    strong = seen.where((F.col("a") >= LEAST_DOCS) & (lift >= LEAST_LIFT) & (2 * evidence >= least_z**2)).withColumn("z", F.log(lift) * F.sqrt("a"))
    found = strong.orderBy(F.col("z").desc(), F.length("term").desc(), "term").collect()  # terms of the sample
    terms = distinct_terms([(r["term"], r["a"]) for r in found])
    reporting, innocent = surroundings(rows, terms, n1, n0)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(terms, reporting, innocent)
        for b in batches:
            yield _batch({"label": (b.column(0).to_pylist(), pa.int32()), "x": ([matcher.features(t.as_py()) for t in b.column(1)], pa.list_(pa.float64()))})

    table = rows.mapInArrow(measure, "label int, x array<double>").toArrow()  # at most the sampled rows
    y = np.array(table["label"].to_pylist(), dtype=float)
    x = np.array(table["x"].to_pylist(), dtype=float).reshape(-1, len(FEATURES))
    return Model(terms, reporting, innocent, logistic(x, y), n1 / len(marks))


def distinct_terms(ranked: list[tuple[str, int]]) -> list[str]:
    """Terms in order of rank without those that a better one covers: a word or longer stem under a chosen stem, or a
    stem that adds less than a quarter to the texts of a chosen term that it begins."""
    chosen: dict[str, int] = {}
    for term, n in ranked:
        body = term.rstrip("*")
        if any(body[:k] + "*" in chosen for k in range(1, len(body) + 1)):
            continue
        if term.endswith("*") and any(c.startswith(body) and n < 1.25 * m for c, m in chosen.items()):
            continue
        chosen[term] = n
    return list(chosen)


def surroundings(rows: DataFrame, terms: list[str], n1: int, n0: int) -> tuple[frozenset[str], frozenset[str]]:
    """Reporting words, and innocent words that are near a term.

    The former stand beside matches in texts that are not toxic at least five times as often as in those that are; the
    latter stand in texts that are not toxic, without a clear lift in those that are.
    """

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, held = Matcher(terms), Counter()
        for b in batches:
            for label, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = tokens(text.as_py())
                hits = matcher.hits(words)
                exact = {i for i, edits, _ in hits if not edits}
                beside = {words[k] for i in exact for k in range(max(0, i - WINDOW), min(len(words), i + WINDOW + 1))}
                held.update((w, -1, label) for w in beside if matcher.known.get(w) is None)
                held.update((words[i], t, label) for i, t in {words[i]: (i, t) for i, edits, t in hits if edits}.values())
        keys = list(held)
        yield _batch({"word": ([k[0] for k in keys], pa.string()), "term": ([k[1] for k in keys], pa.int32()), "label": ([k[2] for k in keys], pa.int32()), "n": (list(held.values()), pa.int64())})

    seen = rows.mapInArrow(near, "word string, term int, label int, n bigint").groupBy("word", "term").agg(
        F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("b")
    )
    said = seen.where((F.col("term") < 0) & (F.col("b") >= 10) & (F.col("b") >= 5 * (F.col("a") + 1)))
    loose = seen.where((F.col("term") >= 0) & (F.col("b") >= 2) & (F.col("a") / n1 < LEAST_LIFT * F.col("b") / n0))  # words near a term, of the sampled texts
    return frozenset(r["word"] for r in said.collect()), frozenset(r["word"] for r in loose.collect())


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3, rounds: int = 40) -> np.ndarray:
    """Ridge logistic weights by Newton's method, bias last and free of the penalty.

    What misspelled matches weigh beside direct ones is penalised more, as few texts show them.
    """
    z = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(z.shape[1]), np.diag([ridge] * x.shape[1] + [1e-6])
    penalty[FEATURES.index("misspelled"), FEATURES.index("misspelled")] = 20 * ridge
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty + 1e-9 * np.eye(len(w)), z.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row of docs."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model.terms, model.reporting, model.innocent)
        for b in batches:
            x = np.array([matcher.features(t.as_py() or "") for t in b.column(1)], dtype=float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(x))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(score, "doc_id bigint, score double")


def train_rows() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 3 != 1


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scored(docs, learn(docs, labels, train_rows()))
