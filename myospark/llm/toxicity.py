"""Toxicity of deobfuscated text.

Disguised words - leetspeak, letters set apart, letters repeated - are seen as the output of a noisy channel. Their
character lattice is decoded by Viterbi under a character trigram model counted over the whole corpus; the restored text
is scored by a logistic model over the presence of word beginnings.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import P, bounded_batches, crc_mod, drop_scratch, materialize
from .linear import Rows, adam, bounded_sample, sigmoid
from .textkernels import LOWER, chunks, windows

SAMPLE, SEED, MOST_FEATURES, LEAST_DOCS, LEAST_CHI2 = 10_000, 11, 2_000, 4, 12.0
PREFIXES = (4, 5, 6, 7)
#: Letters that a character may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e",
}
_SIGNS = "".join(LEET)
_S = re.escape(_SIGNS)
#: Words with a sign before a letter, or one or two at the end. Possessive throughout: linear in the text, whatever its words.
_LEET_WORD = re.compile(rf"(?<![\w{_S}])(?:[^\W\d_]*+[{_S}]++[^\W\d_][\w{_S}]*+|[^\W\d_]++[0-9@$]{{1,2}}+(?![\w{_S}]))")
#: Runs of three or more parts of one or two characters, however set apart.
_SPACED = re.compile(rf"(?<![^\W_])(?:[a-z{_S}]{{1,2}}[ .\-_*/]++){{2,}}[a-z{_S}]{{1,2}}(?![^\W_])")
_SEPARATORS = " .-_*/"
_SEPARATOR = re.compile(f"[{re.escape(_SEPARATORS)}]")
#: Cost in nats of a digit or currency sign, or of another sign between letters, that stands for itself: mostly such a one is a disguise.
ITSELF = 6.0
_SIGN = re.compile(f"[{_S}]")
_TRIPLE = re.compile(r"([a-z])\1\1")
_LETTERS = re.compile(r"[a-z]+")
_WORD = re.compile(r"[^\W\d_]+")
SYMBOLS = 28  # word boundary, a to z, any other letter
_CODE = np.zeros(256, dtype=np.int64)
_CODE[97:123] = np.arange(1, 27)
_CODE[128:192] = -1
_CODE[192:] = 27


def corpus_trigrams(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Counts of character trigrams over every whole text, as an array of SYMBOLS^3: the only thing that comes to the driver."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, dtype=np.int64)

        def count(code: np.ndarray) -> None:
            if len(code) > 2:
                total[:] += np.bincount((code[:-2] * SYMBOLS + code[1:-1]) * SYMBOLS + code[2:], minlength=SYMBOLS**3)

        for batch in batches:
            for _, _, data, offs in chunks(batch.column(0)):
                last = np.zeros(0, dtype=np.int64)
                for a, b in windows(len(data)):
                    code = _CODE[LOWER[data[a:b]]]
                    full = code >= 0  # continuation bytes belong to the letter before
                    edges = offs[(offs >= a) & (offs <= b if b == len(data) else offs < b)] - a
                    code = np.concatenate([last, np.insert(code[full], np.repeat(np.concatenate([[0], np.cumsum(full)])[edges], 2), 0)])
                    count(code)
                    last = code[-2:]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["gram", "n"])

    counts = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    out = np.zeros(SYMBOLS**3, dtype=np.float64)
    for row in counts.collect():  # at most SYMBOLS^3 rows
        out[row["gram"]] = row["n"]
    return out


class Decoder:
    """Viterbi over the lattice of a disguised word."""

    def __init__(self, counts: np.ndarray) -> None:
        grid = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS) + 0.05
        self.logp = np.log(grid / grid.sum(axis=2, keepdims=True)).tolist()
        self.word = lru_cache(maxsize=50_000)(self._word)

    @staticmethod
    def lattice(text: str) -> list[list[tuple[str, str, float]]]:
        """For each stretch of equal characters, or of separators: what it may stand for, how that is written, and its cost.

        A sign may stand for letters or for itself, which bounds words; separators for a boundary or for nothing.
        """
        out, i = [], 0
        while i < len(text):
            j = i + 1
            if text[i] in _SEPARATORS:
                while j < len(text) and text[j] in _SEPARATORS:
                    j += 1
                out.append([(" ", text[i:j], 0.0), ("", "", 0.0)])
                i = j
                continue
            while j < len(text) and text[j] == text[i]:
                j += 1
            sign = text[i] in LEET
            options = LEET.get(text[i], text[i])
            own = ITSELF if text[i].isdigit() or text[i] in "$€" or (i and text[i - 1].isalpha() and j < len(text) and text[j].isalpha()) else 0.0
            if j - i >= 3:
                out.append([(x * n, x * n, 0.0) for x in options for n in (1, 2)] + [(text[i] * 2, text[i:j], 2 * own)] * sign)
            else:
                out += [[(x, x, 0.0) for x in options] + [(text[i], text[i], own)] * sign] * (j - i)
            i = j
        return out

    def _word(self, text: str) -> str:
        """The most likely reading: paths are kept apart by their last two symbols, and what they wrote is linked backwards."""
        best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for options in [*self.lattice(text), [(" ", "", 0.0)]]:
            coded = [([ord(ch) - 96 if "a" <= ch <= "z" else 27 if ch.isalpha() else 0 for ch in seen], written, cost) for seen, written, cost in options]
            after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (cost, done) in best.items():
                for codes, written, more in coded:
                    x, y, c = a, b, cost + more
                    for z in codes:
                        if z == y == 0:  # a boundary beside a boundary is the same one
                            x = 0
                            continue
                        c -= self.logp[x][y][z]
                        x, y = y, z
                    if (x, y) not in after or c < after[(x, y)][0]:
                        after[(x, y)] = (c, (done, written))
            best = after
        done, parts = min(best.values(), key=lambda v: v[0])[1], []
        while done is not None:
            done, written = done
            parts.append(written)
        return "".join(reversed(parts))

    def spaced(self, run: str) -> str:
        """Both readings of a run of letters set apart: its most likely segments, and all of it as one word where that differs."""
        parts, whole = self.word(run), self.word(_SEPARATOR.sub("", run))
        return parts if parts == whole else f"{parts} {whole}"

    def restore(self, text: str) -> str:
        """The lower-case text with disguised words restored."""
        text = _SPACED.sub(lambda m: self.spaced(m[0]), text.lower())
        if _SIGN.search(text):
            text = _LEET_WORD.sub(lambda m: self.word(m[0]), text)
        if _TRIPLE.search(text):
            text = _LETTERS.sub(lambda m: self.word(m[0]) if _TRIPLE.search(m[0]) else m[0], text)
        return text


def beginnings(text: str) -> set[str]:
    """The distinct words of a restored text, and their beginnings (marked by a hyphen) of 4 to 7 letters."""
    out = set(_WORD.findall(text))
    return out | {w[:n] + "-" for w in out for n in PREFIXES if len(w) > n}


class ToxicityModel:
    def __init__(self, decoder_counts: np.ndarray, weights: dict[str, float], offset: float) -> None:
        self.counts, self.weights, self.offset = decoder_counts, weights, offset

    def scorer(self):
        decoder, weights = Decoder(self.counts), self.weights
        least = min(PREFIXES)
        stems = {w[:least] for w in weights}  # a word whose first letters open no weighted beginning has no weight

        def score(text: str) -> float:
            hit = set()
            for w in set(_WORD.findall(decoder.restore(text))):
                if w[:least] not in stems:
                    continue
                if w in weights:
                    hit.add(w)
                for n in PREFIXES:
                    if len(w) > n and (p := w[:n] + "-") in weights:
                        hit.add(p)
            return self.offset + sum(weights[h] for h in sorted(hit))

        return score


def telling(sample: DataFrame, most: int = MOST_FEATURES, least_docs: int = LEAST_DOCS, least_chi2: float = LEAST_CHI2) -> list[str]:
    """The beginnings that tell the labels apart best by chi-square. ``sample`` has y and an array of beginnings, words.

    Counting is distributed; at most ``most`` beginnings come to the driver, ties in order of the text.
    """
    n, pos = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not n or pos in (0, n):
        return []
    seen = sample.select("y", F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("c"), F.sum("y").alias("c1")).where(F.col("c") >= least_docs)
    e1 = F.col("c") * (pos / n)
    chi = F.pow(F.col("c1") - e1, 2) / e1 + F.pow(F.col("c1") - e1, 2) / (F.col("c") - e1)
    best = seen.withColumn("chi", F.round(chi, 6)).where(F.col("chi") >= least_chi2).orderBy(F.desc("chi"), "word").limit(most)
    return [r["word"] for r in best.collect()]


def fit(rows: Rows, y: np.ndarray, dims: int) -> tuple[np.ndarray, float]:
    """Ridge logistic regression with classes balanced up to a factor of 4."""
    n, pos = len(y), float(y.sum())
    if not n or pos in (0, n):
        return np.zeros(dims), 4.0 if n and pos == n else -4.0
    weight = np.where(y > 0, min(4.0, (n - pos) / pos), 1.0)
    weight /= weight.sum()

    def gradient(p: np.ndarray) -> np.ndarray:
        g = weight * (sigmoid(rows.dot(p[:-1]) + p[-1]) - y)
        return np.append(rows.tdot(g, dims) + 2e-5 * p[:-1], g.sum())

    p = adam(gradient, np.zeros(dims + 1), 500, 0.1)
    return p[:-1], float(p[-1])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> ToxicityModel:
    """Count the character model over all texts, then fit on at most ``sample`` labelled documents with crc32(id) mod 5 <> 0.

    The sample holds the smallest id hashes; null labels and ids are not used. Without labels, or with one class only,
    scores are constant. The driver receives trigram counts, the telling beginnings, and their places in each sampled text.
    """
    spark = docs.sparkSession
    counts = corpus_trigrams(docs, text_col)
    usable = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y is not null").where(crc_mod("id", 5) != 0)
    chosen = bounded_sample(usable, sample, SEED)
    small = F.broadcast(chosen.select(F.col("id").alias(P + "id"), F.col("y").alias(P + "y")))  # at most sample rows
    rows = docs.select(F.col(id_col).alias(P + "doc"), F.coalesce(F.col(text_col), F.lit("")).alias(P + "text")).join(small, F.col(P + "doc") == F.col(P + "id"))
    known = spark.sparkContext.broadcast(counts)

    def restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(known.value)
        for batch in batches:
            words = [sorted(beginnings(decoder.restore(t.as_py()))) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), pa.array([int(v > 0) for v in batch.column(1).to_pylist()], pa.int32()), pa.array(words, pa.list_(pa.string()))], names=["id", "y", "words"])

    found = materialize(rows.select(P + "id", P + "y", P + "text").mapInArrow(restored, "id string, y int, words array<string>"))
    names = telling(found)
    places = spark.sparkContext.broadcast({w: i for i, w in enumerate(names)})

    def located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = places.value
        for batch in batches:
            idx = [sorted(at[w] for w in words if w in at) for words in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(idx, pa.list_(pa.int32()))], names=["id", "y", "idx"])

    got = sorted(found.mapInArrow(located, "id string, y int, idx array<int>").collect(), key=lambda r: (r["id"], r["y"], r["idx"]))
    drop_scratch(spark, found.scratch_path)
    x = Rows([(np.array(r["idx"], dtype=np.int64), np.ones(len(r["idx"]))) for r in got])
    weights, offset = fit(x, np.array([r["y"] for r in got], dtype=float), len(names))
    return ToxicityModel(counts, dict(zip(names, weights.tolist(), strict=True)), offset)


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1), predicted (1 from 0.5 on).

    Null and empty texts have the score of a text without any telling word. Texts are read whole; the id and other columns
    play no part in a score. Null ids have a null held_out.
    """
    bounded_batches(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(model)  # SYMBOLS^3 counts and at most MOST_FEATURES weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = known.value.scorer()
        for batch in batches:
            p = sigmoid(np.array([score(t.as_py() or "") for t in batch.column(1)], dtype=float))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = slim.mapInArrow(run, f"doc_id {dict(slim.dtypes)['doc_id']}, score double, predicted int")
    return out.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
