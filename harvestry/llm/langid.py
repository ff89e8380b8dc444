"""Language identification in two steps: the language family first, then one-versus-one linear machines inside it.

Features are hashed byte bigrams and trigrams of the lower-cased text, as shares of all of them. All machines (between
families and between the languages of a family) are linear support vector machines with squared hinge loss, fitted here
on a bounded sample of rows: at most `SAMPLE` documents over all languages, the same number of each. Predictions read
every whole text; a machine's value is the mean of its weights over the text's features.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from heapq import nsmallest
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harvestry.llm.common import bounded_batches, each_batch, fold_id, give_back, read_table

SAMPLE, FOLDS, BITS, UNDETERMINED = 2000, 5, 13, "und"
#: Characters of the sampled texts.
BYTES = 64 << 20
#: Families of ISO 639-1 codes; a code that is not listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "an ast ca co es fr gl it la oc pt rm ro sc",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd gv kw",
    "uralic": "et fi hu se",
    "turkic": "az kk ky tk tr tt uz",
    "indo-aryan": "bn gu hi mr ne pa sa si ur",
    "iranian": "fa ku ps tg",
    "semitic": "am ar he mt ti",
    "dravidian": "kn ml ta te",
    "austronesian": "id jv mg mi ms su tl",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
#: Bytes as features: white space, digits and ASCII marks are blanks.
FOLDED = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], np.uint32)


def grams(text: bytes) -> np.ndarray:
    """Feature numbers of all bigrams and trigrams of the lower-cased text; a run of blanks is one."""
    x = FOLDED[np.frombuffer(b" " + text + b" ", np.uint8)]
    x = x[np.append(True, (x[1:] != 32) | (x[:-1] != 32))]
    pair = x[:-1] * np.uint32(0x9E3779B1) + x[1:] * np.uint32(0x85EBCA6B)
    triple = pair[:-1] * np.uint32(0xC2B2AE35) + x[2:] * np.uint32(0x27D4EB2F)
    return np.concatenate([pair >> np.uint32(32 - BITS), triple >> np.uint32(32 - BITS)])


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def machine(x: np.ndarray, y: np.ndarray, cost: float = 10.0, steps: int = 150) -> np.ndarray:
    """Weights of a linear squared-hinge machine for y in {-1, 1}, by accelerated gradient steps; rows with y = 0 take no part."""
    rows = max(1, int(np.count_nonzero(y)))
    w = v = np.zeros(x.shape[1], np.float32)
    top = float((x * x).sum(1).max())
    rate = 1 / (1 + 2 * cost * top)
    for k in range(1, steps + 1):
        short = np.maximum(1 - y * (x @ v), 0)
        new = v - rate * (v - 2 * cost / rows * ((y * short) @ x)).astype(np.float32)
        w, v = new, new + (k - 1) / (k + 2) * (new - w)
    return w


@dataclass
class Model:
    """languages by family; machines: (level, first, second) and a row of weights and an offset each."""

    families: dict[str, list[str]]
    names: list[tuple[str, str, str]] = field(default_factory=list)
    weights: np.ndarray | None = None

    def margins(self, text: bytes) -> np.ndarray:
        found = grams(text)
        counts = np.bincount(found, minlength=1 << BITS).astype(np.float32)
        return self.weights @ np.append(counts / (counts @ counts) ** 0.5, np.float32(1))

    def choose(self, level: str, options: list[str], margins: np.ndarray) -> tuple[str, float]:
        """The option with most won duels (then the largest sum of margins), and how sure its weakest duel is."""
        if len(options) == 1:
            return options[0], 1.0
        won = dict.fromkeys(options, 0.0)
        least = dict.fromkeys(options, np.inf)
        for (at, a, b), m in zip(self.names, margins.tolist(), strict=True):
            if at == level:
                won[a] += (m > 0) + m / 1e3
                won[b] += (m <= 0) - m / 1e3
                least[a], least[b] = min(least[a], m), min(least[b], -m)
        best = max(options, key=lambda o: won[o])
        return best, 1 / (1 + np.exp(-3 * float(np.clip(least[best], -10, 10))))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.families or not has_letter(text):
            return UNDETERMINED, 0.0
        margins = self.margins(text.lower().encode()) if self.names else np.zeros(0)
        family, sure = self.choose("", list(self.families), margins)
        language, surer = self.choose(family, self.families[family], margins)
        return language, float(sure * surer)


def fit(rows: list[tuple[str, str]]) -> Model:
    """A model from (lang, text)."""
    families: dict[str, list[str]] = {}
    for lang in sorted({x for x, _ in rows}):
        families.setdefault(FAMILY_OF.get(lang, lang), []).append(lang)
    model = Model(families)
    x = np.zeros((len(rows), (1 << BITS) + 1), np.float32)
    for i, (_, text) in enumerate(rows):
        counts = np.bincount(grams(text.lower().encode()), minlength=1 << BITS)
        x[i, :-1] = counts / max(float(counts @ counts) ** 0.5, 1e-9)
    x[:, -1] = 1
    langs = np.array([a for a, _ in rows], object)
    kin = np.array([FAMILY_OF.get(a, a) for a, _ in rows], object)
    weights = []
    for level, names, of in [("", list(families), kin), *((f, m, langs) for f, m in families.items())]:
        for a, b in combinations(names, 2):
            weights.append(machine(x, ((of == a).astype(np.float32) - (of == b).astype(np.float32))))
            model.names.append((level, a, b))
    model.weights = np.array(weights, np.float32) if weights else None
    return model


def sample(docs: DataFrame, most: int = SAMPLE, folds: int | None = FOLDS) -> list[tuple[str, str]]:
    """At most `most` (lang, text) over all languages, the same number of each where there are as many; by a hash of doc_id and text.

    Equal rows count once, and the texts have at most BYTES characters together, so the driver holds no more than that.
    """
    known = docs.where("lang is not null and text is not null and doc_id is not null").select("doc_id", "lang", "text")
    if folds:
        known = known.where(fold_id("doc_id", folds) != 0)
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most).collect()}
    if not counts:
        return []
    each = max(1, most // len(counts))
    # So small a share of each language's hashes that about 4/3 of what is needed passes.
    share = F.create_map(*(F.lit(v) for lang, n in counts.items() for v in (lang, min(1.0, each * 4 / 3 / n) if n > 2 * each else 1.0)))
    rank = F.xxhash64("doc_id", "text")
    part = known.where((F.pmod(rank, F.lit(1 << 20)) / (1 << 20)) < share[F.col("lang")]).where(F.octet_length("text") <= BYTES).select("lang", "text", rank.alias("rank"))
    held: dict[str, dict[int, str]] = {lang: {} for lang in counts}
    for r in part.toLocalIterator():
        mine = held[r["lang"]]
        if has_letter(r["text"]):
            mine[r["rank"]] = r["text"]
        if len(mine) > 2 * each:
            held[r["lang"]] = {k: mine[k] for k in nsmallest(each, mine)}
    out, size = [], 0
    for k, lang in sorted((k, lang) for lang, mine in held.items() for k in nsmallest(each, mine)):
        size += len(held[lang][k])
        if size <= BYTES:
            out.append((lang, held[lang][k]))
    return sorted(out)


def predict_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1) for each row; `und` and 0 for null text, text without a letter, or a model without languages."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    give_back()

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        known = shared.value
        found = [known.predict(t.as_py()) for t in batch.column(1)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([a for a, _ in found], pa.string()), pa.array([b for _, b in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return each_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), of, "doc_id long, lang_pred string, score double")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = fit(sample(docs))
    return predict_documents(docs, model).select("doc_id", (fold_id("doc_id", FOLDS) == 0).alias("held_out"), "lang_pred", "score")
