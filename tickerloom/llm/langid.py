"""Language identification, word first.

The model holds, per language, smoothed log frequencies of its commonest words and of character n-grams of MAX_N to 1
characters taken from words written with marks at both ends. A known word scores by its own log frequencies. An unseen
word backs off: to the mean over its known n-grams of the longest size of which it has any, down to single characters.
A text's score is the posterior share of its best language under equal priors, its words' evidence added up.

The model is fitted on about SAMPLE documents, and PER_LANG of every language that has so many (all of one that has
fewer): a labelled training row is taken by hash of doc_id with probability SAMPLE / rows, or PER_LANG / rows of its
language where that is more. Every word and n-gram of these texts is in the model, unless a language has more than
MAX_TERMS of a size: then those of its rarest counts are left out, whole counts at a time, and a warning tells how many
(Model.cut; nothing on the tables given). The least counts come from a histogram of counts, so terms are never ranked.

Null text, or text without a letter, is "und" with score 0. Without any training row every text is "und". Rows with a
null lang teach nothing. Repeated rows are predicted once each. An empty table gives an empty result. Columns other
than doc_id, text and (for training) lang are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.common import small_side, written

SAMPLE = 6_000
PER_LANG = 1_500
MAX_N = 4
#: Counts added to every known word or n-gram of a language.
SMOOTHING = 0.5
#: Entries a task's partial counts, or a worker's cache of word scores, may hold.
HELD = 300_000
UNKNOWN = "und"

_WORD = r"\p{L}[\p{L}\p{M}]*"


def words_of(text: str) -> list[str]:
    import regex

    return regex.findall(_WORD, text.lower())


def grams_of(word: str, n: int) -> list[str]:
    marked = f"<{word}>" if n > 1 else word
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def counts(docs: DataFrame) -> DataFrame:
    """lang, size (0: words, else n of the n-grams), term, n."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        words: Counter = Counter()

        def flush() -> pa.RecordBatch:
            for (lang, word), n in words.items():
                held[lang, 0, word] += n
                for size in range(1, MAX_N + 1):
                    for gram in grams_of(word, size):
                        held[lang, size, gram] += n
            keys = list(held)
            columns = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.string()), pa.array(list(held.values()), pa.int64())]
            held.clear()
            words.clear()
            return pa.RecordBatch.from_arrays(columns, ["lang", "size", "term", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                name = lang.as_py()
                words.update((name, w) for w in words_of(text.as_py()))
                if len(words) >= HELD // 10:
                    yield flush()
        yield flush()

    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    return known.mapInArrow(tally, "lang string, size int, term string, n bigint").groupBy("lang", "size", "term").agg(F.sum("n").alias("n"))


@dataclass
class Terms:
    """Words, or n-grams of a size: term -> number i; its languages and what it adds to their log frequencies of an unseen
    term (base) are entries starts[i] to starts[i + 1]."""

    number: dict[str, int]
    base: np.ndarray
    starts: list[int]
    langs: np.ndarray
    added: np.ndarray

    def of(self, i: int) -> np.ndarray:
        """Log frequencies of a known term, per language."""
        a, b = self.starts[i], self.starts[i + 1]
        out = self.base.copy()
        out[self.langs[a:b]] += self.added[a:b]
        return out

    def mean(self, terms: list[int]) -> np.ndarray:
        """Mean log frequencies of known terms, per language."""
        if len(terms) == 1:
            return self.of(terms[0])
        ends = [(self.starts[i], self.starts[i + 1]) for i in terms]
        langs, added = np.concatenate([self.langs[a:b] for a, b in ends]), np.concatenate([self.added[a:b] for a, b in ends])
        return self.base + np.bincount(langs, added, len(self.base)) / len(terms)


@dataclass
class Model:
    """terms[0] is of words, terms[n] of n-grams."""

    langs: list[str]
    terms: list[Terms] = field(default_factory=list)

    def word(self, word: str) -> np.ndarray:
        at = self.terms[0].number.get(word)
        if at is not None:
            return self.terms[0].of(at)
        for n in range(MAX_N, 0, -1):
            number = self.terms[n].number
            known = [i for g in grams_of(word, n) if (i := number.get(g)) is not None]
            if known:
                return self.terms[n].mean(known)
        return np.zeros(len(self.langs))


def fit(docs: DataFrame, sample: int = SAMPLE, per_lang: int = PER_LANG) -> Model:
    """The model of docs' text and lang; see above for the bounds."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = written(usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "langid-sizes")
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if total > sample:
        # A language with no more than per_lang rows is read whole, any other gives about per_lang rows or its share of sample.
        rate = F.least(F.lit(1.0), F.greatest(F.lit(sample / total), F.lit(float(per_lang)) / F.col("n")))
        share = small_side(sizes.select(F.col("lang").alias("__lang"), (rate * (1 << 30)).cast("long").alias("__most")))
        place = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("langid")), F.lit(1 << 30))
        usable = usable.join(share, F.col("lang") == F.col("__lang")).where(place < F.col("__most")).select(usable.columns)
    return build(counts(usable).toArrow())  # terms of the bounded sample


def build(seen: pa.Table) -> Model:
    """The model of counts n by lang, size and term."""
    langs = sorted(pc.unique(seen["lang"]).to_pylist())
    model = Model(langs)
    for size in range(MAX_N + 1):
        rows = seen.filter(pc.equal(seen["size"], size))
        coded = rows["term"].combine_chunks().dictionary_encode()
        term, n = coded.indices.to_numpy(zero_copy_only=False), rows["n"].to_numpy()
        lang = pc.index_in(rows["lang"].combine_chunks(), pa.array(langs, pa.string())).to_numpy(zero_copy_only=False)
        total = np.bincount(lang, n, len(langs)) + SMOOTHING * len(coded.dictionary)
        order = np.argsort(term, kind="stable")
        number = {t: i for i, t in enumerate(coded.dictionary.to_pylist())}
        starts = np.searchsorted(term[order], np.arange(len(number) + 1)).tolist()
        # Without terms there is no frequency to fall back on.
        base = np.log(SMOOTHING / total) if number else total
        model.terms.append(Terms(number, base, starts, lang[order].astype(np.int32), np.log((n[order] + SMOOTHING) / SMOOTHING)))
    return model


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        cache: dict[str, int] = {}
        scores = np.zeros((1024, len(model.langs)))
        for batch in batches:
            langs, shares = [], []
            for text in batch.column(1):
                words = words_of(text.as_py() or "")
                if not words or not model.langs:
                    langs.append(UNKNOWN)
                    shares.append(0.0)
                    continue
                if len(cache) > HELD:
                    cache.clear()
                for w in set(words).difference(cache):
                    at = cache[w] = len(cache)
                    if at >= len(scores):
                        scores = np.concatenate([scores, np.zeros_like(scores)])
                    scores[at] = model.word(w)
                evidence = scores[np.fromiter(map(cache.__getitem__, words), dtype=np.int64, count=len(words))].sum(axis=0)
                best = int(evidence.argmax())
                langs.append(model.langs[best])
                shares.append(1.0 / float(np.exp(np.maximum(evidence - evidence[best], -700)).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(shares, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(predict, "doc_id bigint, lang_pred string, score double")


def train_rows() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 5 != 0


def languages(docs: DataFrame) -> DataFrame:
    """Every row's language by a model of docs' own training rows."""
    return predicted(docs, fit(docs.where(train_rows())))
