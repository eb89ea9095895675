"""Language identification by words first, backing off to character n-grams.

A word that training saw is scored by its log frequency in each language. A word it did not see is scored by
character n-grams: at every position the longest n-gram that training saw, from LONGEST letters down to one (they overlap). A text's
score for a language is the sum over its words; the prediction is the largest, and its score is that language's
posterior at a temperature that grows with the square root of the number of words.

The model is fitted on a bounded sample: SAMPLE different rows of each learned language, those of smallest hash among the rows
of up to SAMPLE_CHARS characters (of a language that has longer ones only, as many of the beginnings of those); the LANGS most frequent
languages are learnt. Every text is scored whole.

Edge cases: null texts and texts without a letter are `und` with score 0; rows whose lang or id is null are not learnt
from; without anything to learn from every text is `und`; ties go to the language first in alphabetical order; repeated rows
are predicted each and learnt from once.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagloom.llm.common import crc_mod, per_batch, slim, table

SAMPLE, SAMPLE_CHARS, LANGS = 1000, 100_000, 1000
#: Parts in which the rows of a language are picked first.
PARTS = 64
FOLDS, HELD_OUT = 4, 2
LONGEST = 5
LEAST_WORD, LEAST_GRAM = 2, 3
MEMORY = 500_000
UNKNOWN = "und"
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def grams(word: str, n: int) -> list[str]:
    """n-grams of the word between borders."""
    w = f"<{word}>"
    return [w[i : i + n] for i in range(len(w) - n + 1)]


@dataclass
class Model:
    """Log frequencies by language of words and, by length, of n-grams. Frequencies are smoothed by one half."""

    langs: list[str] = field(default_factory=list)
    words: dict[str, np.ndarray] = field(default_factory=dict)
    grams: dict[str, np.ndarray] = field(default_factory=dict)
    places: dict[str, int] = field(default_factory=dict)  # of the n-grams in one table
    table: np.ndarray | None = None

    def word(self, word: str) -> np.ndarray:
        if (known := self.words.get(word)) is not None:
            return known
        if self.table is None:
            self.places = {g: i for i, g in enumerate(self.grams)}
            self.table = np.array([*self.grams.values(), np.zeros(len(self.langs))])
        w, places, found = f"<{word}>", self.places, []
        for i in range(len(w)):
            for n in range(min(LONGEST, len(w) - i), 0, -1):
                if (at := places.get(w[i : i + n])) is not None:
                    found.append(at)
                    break
        return self.table[found].sum(0) if found else self.table[-1]


def _tables(counts: list[Counter[str]], least: int) -> dict[str, np.ndarray]:
    total = sum(counts, Counter())
    size = np.array([c.total() for c in counts]) + 0.5 * len(total)
    out = {}
    for k, n in total.items():
        if n >= least:
            v = np.log((np.array([c[k] for c in counts]) + 0.5) / size)
            out[k] = v - v.mean()  # only differences between languages matter
    return out


def fit(texts: dict[str, list[str]]) -> Model:
    """Learn from the texts of each language."""
    langs = sorted(texts)
    words = [Counter(w for t in texts[x] for w in _WORD.findall(t.lower())) for x in langs]
    model = Model(langs, _tables(words, LEAST_WORD))
    for n in range(1, LONGEST + 1):
        counts = []
        for c in words:
            own: Counter[str] = Counter()
            for w in c:  # each different word once: n-grams are for words that are new
                own.update(grams(w, n))
            counts.append(own)
        model.grams |= _tables(counts, LEAST_GRAM)
    return model


class Scores(dict):
    """Language scores of a space-separated token (None without letters), kept for those met before (bounded: speed only)."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, token: str) -> np.ndarray | None:
        if len(self) > MEMORY:
            self.clear()
        found = _WORD.findall(token)
        self[token] = s = sum((self.model.word(w) for w in found), np.zeros(len(self.model.langs))) if found else None
        return s


def predict(text: str | None, scores: Scores) -> tuple[str, float]:
    langs = scores.model.langs
    seen = [(s, k) for t, k in Counter(text.lower().split()).items() if (s := scores[t]) is not None] if text and langs else []
    if not seen:
        return UNKNOWN, 0.0
    n = np.array([k for _, k in seen], float)
    total = n @ np.array([s for s, _ in seen]) / math.sqrt(n.sum())
    p = np.exp(total - total.max())
    best = int(total.argmax())
    return langs[best], float(p[best] / p.sum())


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on rows outside the held-out fold. The driver gets at most SAMPLE texts a language."""
    seen = crc_mod(id_col, FOLDS).isin([x for x in range(FOLDS) if x != HELD_OUT])
    rows = slim(docs, id_col, lang_col, text_col).where(seen & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(id_col, F.col(lang_col).alias("__lang"), text_col, F.xxhash64(text_col).alias("__hash"), (F.length(text_col) > SAMPLE_CHARS).alias("__long"))
    langs = [r[0] for r in rows.groupBy("__lang").count().orderBy(F.desc("count"), "__lang").limit(LANGS).collect()]
    short = [r[0] for r in rows.where("not __long").select("__lang").distinct().where(F.col("__lang").isin(langs)).collect()] if langs else []
    rows = rows.where(F.col("__lang").isin(langs) & (~F.col("__long") | ~F.col("__lang").isin(short)))
    order = [F.xxhash64(F.col(id_col).cast("string")), F.col(id_col), F.col("__hash")]
    pick = rows.select(id_col, "__lang", "__hash").distinct().withColumn("__part", F.pmod("__hash", F.lit(PARTS)))
    for keys in (["__lang", "__part"], ["__lang"]):  # at most PARTS * SAMPLE rows of a language meet, however many tasks there are
        pick = pick.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__n") <= SAMPLE)
    pick = pick.select(id_col, "__lang", "__hash")
    got = rows.join(F.broadcast(pick), [id_col, "__lang", "__hash"]).groupBy("__lang", id_col, "__hash").agg(F.first(F.substring(text_col, 1, SAMPLE_CHARS))).collect()
    texts: dict[str, list[str]] = {}
    for lang, text in sorted((r[0], r[3]) for r in got):
        texts.setdefault(lang, []).append(text)
    return fit(texts)


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """id, held_out, lang_pred and score of every row of docs."""
    model = learn(docs, id_col, text_col, lang_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # grows with SAMPLE only
    held: list[Scores] = []
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not held:
            held.append(Scores(sent.value))
        got = [predict(t, held[0]) for t in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())], [id_col, "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(f"`{id_col}`"), (crc_mod(id_col, FOLDS) == HELD_OUT).alias("__held"), F.col(f"`{text_col}`"))
    return per_batch(rows, run, f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: the language of every text of `documents`."""
    return language_id(table(spark, sf_dir, "documents"))
