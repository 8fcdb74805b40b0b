"""Language identification in two levels: the family first, then one-versus-one linear support vector machines within it."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import P, bounded_batches, crc_mod
from .linear import Rows, adam, sigmoid, trigram_rows
from .textkernels import LOWER, chunks

#: Families of languages by ISO 639-1 code. A language not listed is a family of its own.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "is"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca"],
    "slavic": ["ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr"],
}
DIMS, SAMPLE, SEED, STEPS = 1 << 14, 4000, 3, 150
UNDETERMINED = "und"
#: A machine takes dims floats. All languages are learned; so that their machines fit in MODEL_BYTES, dims are halved from some 2,000 languages on.
MODEL_BYTES, LEAST_DIMS = 128 << 20, 1 << 10
#: One sampled text in CALIBRATE is not fitted; all of those but a share of STRAY count as in a learned language.
CALIBRATE, STRAY = 5, 0.002
_WORDLIKE = re.compile(r"[^\W\d_]+")


def family_of(lang: str) -> str:
    return next((name for name, langs in FAMILIES.items() if lang in langs), lang)


def machines_for(langs: list[str]) -> int:
    """One for each family, and one for each pair of languages within a family."""
    sizes = Counter(family_of(lang) for lang in langs)
    return len(sizes) + sum(n * (n - 1) // 2 for n in sizes.values())


def _machine(rows: Rows, y: np.ndarray, dims: int, steps: int) -> tuple[np.ndarray, float, float]:
    """A squared-hinge linear SVM with balanced classes, and the slope that turns its margin into a probability."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))

    def gradient(p: np.ndarray) -> np.ndarray:
        slack = np.maximum(0, 1 - y * (rows.dot(p[:-1]) + p[-1]))
        g = -2 * weight * y * slack
        return np.append(rows.tdot(g, dims) + 1e-4 * p[:-1], g.sum())

    p = adam(gradient, np.zeros(dims + 1), steps, 0.1)
    margin = y * (rows.dot(p[:-1]) + p[-1])
    return p[:-1], float(p[-1]), float(3.0 / max(1e-3, np.quantile(margin, 0.25)))


class LanguageModel:
    """``machines`` holds (level, positive class, negative class, weights, offset, slope); ``families`` the learned languages of each.

    A machine without a negative class parts its class from all others of its level. ``seen`` marks the features that two or
    more learned texts hold; a text is in a learned language if a share of ``least`` of its features, by weight, is seen.
    """

    def __init__(self, families: dict[str, list[str]], machines: list[tuple], dims: int) -> None:
        self.families, self.machines, self.dims, self.seen, self.least = families, machines, dims, np.zeros(dims, dtype=bool), 0.0

    def known(self, rows: Rows) -> np.ndarray:
        """The share of each text's features that is seen; features have unit length, so squares sum to 1. A text without features holds nothing unknown."""
        share = np.bincount(rows.row, weights=rows.val * rows.val * self.seen[rows.idx], minlength=rows.n)
        return np.where(np.diff(rows.start) > 0, share, 1.0)

    @staticmethod
    def _one_versus_rest(classes: list[str], probs: dict) -> tuple[np.ndarray, np.ndarray]:
        """The class whose machine says most, and its probability. Of two classes, one machine tells both."""
        first = probs[("family", classes[0], None)]
        each = np.stack([first, 1 - first] if len(classes) == 2 else [probs[("family", c, None)] for c in classes])
        return each.argmax(axis=0), each.max(axis=0)

    @staticmethod
    def _one_versus_one(classes: list[str], level: str, probs: dict) -> tuple[np.ndarray, np.ndarray]:
        """The class with the largest sum of pairwise probabilities, and the least of its own pairs' probabilities."""
        k = len(classes)
        pair = {}
        for a, b in combinations(range(k), 2):
            p = probs[(level, classes[a], classes[b])]
            pair[a, b], pair[b, a] = p, 1 - p
        best = np.stack([sum(pair[a, b] for b in range(k) if b != a) for a in range(k)]).argmax(axis=0)
        least = np.stack([np.min([pair[a, b] for b in range(k) if b != a], axis=0) for a in range(k)])
        return best, least[best, np.arange(len(best))]

    def score_rows(self, rows: Rows) -> tuple[np.ndarray, np.ndarray]:
        """Languages and scores of feature rows: the probability of the family times that of the language within it."""
        langs, score = np.full(rows.n, UNDETERMINED, dtype=object), np.zeros(rows.n)
        if not self.families or not rows.n:
            return langs, score
        probs = {(lv, a, b): sigmoid((rows.dot(w) + c) * slope) for lv, a, b, w, c, slope in self.machines}
        names = sorted(self.families)
        fam, fp = self._one_versus_rest(names, probs) if len(names) > 1 else (np.zeros(rows.n, int), np.ones(rows.n))
        for k, name in enumerate(names):
            own, inside = fam == k, self.families[name]
            pick, lp = self._one_versus_one(inside, name, probs) if len(inside) > 1 else (np.zeros(rows.n, int), np.ones(rows.n))
            langs[own] = np.array(inside, dtype=object)[pick[own]]
            score[own] = (fp * lp)[own]
        return langs, score

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, scores, and the share of each text that the model knows."""
        rows = Rows(list(trigram_rows(texts, self.dims)))
        langs, score = self.score_rows(rows)
        bare = ~np.array(list(has_letter(texts)), dtype=bool)
        langs[bare], score[bare] = UNDETERMINED, 0.0
        return langs.tolist(), score, self.known(rows)


def has_letter(texts: pa.Array) -> Iterator[bool]:
    """Whether each text holds a character of a letter category (Lu, Ll, Lt, Lm or Lo)."""
    for _, _, data, offs in chunks(texts):
        low = LOWER[data]
        ascii_letters = np.concatenate([[0], np.cumsum((low >= 97) & (low <= 122))])
        for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
            if ascii_letters[b] > ascii_letters[a]:
                yield True
            else:  # the pattern also finds number signs, such as halves
                yield any(ch.isalpha() for m in _WORDLIKE.finditer(data[a:b].tobytes().decode("utf-8", "ignore")) for ch in m[0])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, dims: int = DIMS, steps: int = STEPS) -> LanguageModel:
    """Fit on at most ``sample`` whole texts, those of smallest id hash among documents not held out, the same number of each language.

    Only text and lang of documents with crc32(id) mod 3 <> 1 and a non-null lang are read. One scan finds the
    sample, by a bound on the hashes; of many languages each has 20 texts. Families are parted one versus the rest, and only
    languages of one family one versus one, so machines grow with the number of languages. Every CALIBRATE-th sampled text is kept from the fit and sets the model's ``least`` share of seen features:
    half way from what a random text would have to what all of those but STRAY have.
    """
    spark = docs.sparkSession
    pool = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang")).where("lang is not null and id is not null").where(crc_mod("id", 3) != 1)
    frequent = pool.groupBy("lang").agg(F.approx_count_distinct("id", 0.02).alias("ids")).collect()  # one row a language
    langs = sorted(r["lang"] for r in frequent)
    if not langs:
        return LanguageModel({}, [], dims)
    while dims > LEAST_DIMS and 4 * dims * machines_for(langs) > MODEL_BYTES:
        dims //= 2
    share = max(sample // len(langs), 20)
    picks = _smallest(pool, {r["lang"]: r["ids"] for r in frequent}, share)
    small = F.broadcast(picks.select(F.col("id").alias(P + "id"), F.col("lang").alias(P + "lang")))  # at most share rows a language
    rows = docs.select(F.col(id_col).cast("string").alias(P + "doc"), F.col(lang_col).alias(P + "own"), F.coalesce(F.col(text_col), F.lit("")).alias(P + "text"))
    rows = rows.join(small, (F.col(P + "doc") == F.col(P + "id")) & (F.col(P + "own") == F.col(P + "lang")))
    bounded_batches(spark)
    feats = rows.select(P + "lang", P + "id", P + "text").mapInArrow(_featurize(dims), "lang string, id string, idx binary, val binary")
    got = sorted(feats.collect(), key=lambda r: (r["lang"], r["id"], r["idx"]))
    parts = [(np.frombuffer(r["idx"], np.int32), np.frombuffer(r["val"], np.float32)) for r in got]
    label = np.array([r["lang"] for r in got], dtype=object)
    kept = np.array([zlib.crc32(r["id"].encode()) // 3 % CALIBRATE != 0 for r in got])
    if not all((kept & (label == v)).any() for v in langs):
        kept[:] = True
    families: dict[str, list[str]] = {}
    for lang in langs:
        families.setdefault(family_of(lang), []).append(lang)
    kin = np.array([family_of(v) for v in label], dtype=object)
    fitted = np.flatnonzero(kept)

    def rows_of(which: np.ndarray) -> Rows:
        return Rows([parts[i] for i in which])

    def fit(which: np.ndarray, positive: np.ndarray) -> tuple:
        w, c, slope = _machine(rows_of(which), np.where(positive, 1.0, -1.0), dims, steps)
        return w.astype(np.float32), c, slope

    names = sorted(families)
    machines = [("family", name, None, *fit(fitted, kin[fitted] == name)) for name in (names if len(names) > 2 else names[: len(names) - 1])]
    for name, own in families.items():
        for a, b in combinations(own, 2):
            which = fitted[(label[fitted] == a) | (label[fitted] == b)]
            machines.append((name, a, b, *fit(which, label[which] == a)))
    model = LanguageModel(families, machines, dims)
    x = rows_of(fitted)
    model.seen = np.bincount(x.idx, minlength=dims) >= 2  # an entry for each text that holds a feature
    aside = rows_of(np.array([i for i in np.flatnonzero(~kept) if len(parts[i][0])], dtype=int))
    if aside.n:
        chance, usual = float(model.seen.mean()), float(np.sort(model.known(aside))[int(STRAY * aside.n)])
        model.least = max(0.0, (chance + usual) / 2) if usual > chance else 0.0
    return model


def _smallest(pool: DataFrame, ids: dict[str, int], share: int) -> DataFrame:
    """The ``share`` ids of each language with the smallest hashes. ``ids`` has about how many ids each has, to some percent.

    Hashes are even, so those below a bound that some more than ``share`` are expected under hold the smallest: only they
    come to the driver. A tenth and six deviations more are asked for.
    """
    width = 13
    asked = 1.1 * share + 6 * share**0.5 + 20
    bounds = {lang: f"{min(16**width - 1, int(asked / n * 16**width)):0{width}x}" if n > asked else "g" for lang, n in ids.items()}
    bound = F.create_map(*[F.lit(x) for pair in bounds.items() for x in pair])
    h = F.md5(F.concat_ws(":", F.lit(SEED), F.col("id")).cast("binary"))
    few = pool.where(F.col("lang").isin(list(ids))).select("lang", h.alias("h"), F.col("id").cast("string").alias("id"))
    few = few.where(F.substring("h", 1, width) < F.element_at(bound, F.col("lang"))).distinct()
    best: dict[str, list[tuple[str, str]]] = {}
    for r in few.collect():  # share rows a language and some deviations more
        best.setdefault(r["lang"], []).append((r["h"], r["id"]))
    chosen = [(i, lang) for lang, got in sorted(best.items()) for _, i in sorted(got)[:share]]
    return pool.sparkSession.createDataFrame(chosen, "id string, lang string")


def _featurize(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(trigram_rows(batch.column(2), dims))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([i.astype(np.int32).tobytes() for i, _ in rows], pa.binary()), pa.array([v.astype(np.float32).tobytes() for _, v in rows], pa.binary())],
                names=["lang", "id", "idx", "val"],
            )

    return run


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score.

    ``lang_pred`` is a learned language, or "und" with score 0 where the text is null or empty or has no letter, or
    nothing was learned. Null ids have a null held_out. Texts are read whole; other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(model)  # at most MODEL_BYTES, or LEAST_DIMS floats a machine

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = known.value
        for batch in batches:
            langs, score, _ = m.predict(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = dict(slim.dtypes)["doc_id"]
    out = slim.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
    return out.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, model: LanguageModel, text_col: str = "text", least: float | None = None) -> DataFrame:
    """The documents in a learned language, with all their columns; those without a letter or in no learned language go.

    A document is in a learned language if the model knows a share of ``least`` of it, by default the model's own, set on
    texts kept from the fit. A text with a letter but without features (under three bytes) holds nothing unknown and stays.
    Only texts go to Python.
    """
    bounded_batches(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(model)
    floor = model.least if least is None else least

    @F.pandas_udf("boolean")
    def stays(texts: pd.Series) -> pd.Series:
        langs, _, share = known.value.predict(pa.array(texts, pa.string()))
        return pd.Series((np.array(langs, dtype=object) != UNDETERMINED) & (share >= floor))

    return docs.where(stays(F.col(text_col)))
