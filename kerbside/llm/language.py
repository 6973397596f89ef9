"""Language ID by nearest centroid.

A text is turned into hashed counts of its letters' byte bigrams and trigrams,
weighed by TF-IDF and normalised. Each language has several centroids, found by
spherical k-means over a bounded sample of labelled rows; a text gets the language
of the centroid with the largest cosine. It is rejected when that cosine is
below what the language's own training rows reach (distance-based rejection).

Defined results: a text that is null, empty or without a letter is ``und`` with
score 0 and is rejected. Ties go to the first language in code-point order. With no
labelled row there is no language to learn, and every text is ``und``. A letter is
what Unicode calls one: numbers such as U+00BD are none. Rows and extra columns are kept;
columns that have the results' names are replaced, and ``names`` chooses other names. An empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from kerbside.llm.text import slices
from kerbside.ship import ship

DIMS = 1 << 12
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
#: ASCII bytes that are no letters become a space; the bytes of other characters stay.
_LETTERS_ONLY = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def counts_of(text: str) -> np.ndarray:
    """Hashed counts of the bigrams and trigrams of the whole text, runs of non-letters as one space."""
    data = text.lower().encode("utf-8", "surrogatepass").translate(_LETTERS_ONLY)
    x = np.frombuffer(b" " + b" ".join(data.split()) + b" ", np.uint8).astype(np.uint32)
    pairs = x[:-1] * np.uint32(257) + x[1:]
    triples = (x[:-2] * np.uint32(66049) + x[1:-1] * np.uint32(257) + x[2:]) + np.uint32(1 << 26)
    grams = np.concatenate([pairs, triples]) * np.uint32(2654435761)
    return np.bincount(grams >> np.uint32(20), minlength=DIMS)


def _pack(counts: np.ndarray) -> bytes:
    """The non-zero counts: 16-bit places, then 32-bit counts."""
    at = np.flatnonzero(counts)
    return at.astype("<u2").tobytes() + counts[at].astype("<u4").tobytes()


def _unpack(data: bytes) -> np.ndarray:
    n = len(data) // 6
    out = np.zeros(DIMS, np.float32)
    out[np.frombuffer(data, "<u2", n)] = np.frombuffer(data, "<u4", n, 2 * n)
    return out


@dataclass(frozen=True)
class Model:
    """Centroids are unit rows; ``language[i]`` is the language of row ``i``, ``floor`` of each language."""

    languages: list[str]
    language: np.ndarray
    centroids: np.ndarray
    idf: np.ndarray
    floor: np.ndarray

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        v = np.log1p(counts) * self.idf
        norm = np.linalg.norm(v, axis=1, keepdims=True)
        return v / np.where(norm > 0, norm, 1.0)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine in 0..1 and rejection of each text."""
        names, scores, rejected = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        known = [i for i, t in enumerate(texts) if t and self.languages and _LETTER.search(t)]
        for at in range(0, len(known), 256):
            some = known[at : at + 256]
            cosine = self.vectors(np.stack([counts_of(texts[i]) for i in some])) @ self.centroids.T
            best = cosine.argmax(axis=1)
            for i, c, b in zip(some, cosine[np.arange(len(some)), best], best, strict=True):
                names[i] = self.languages[self.language[b]]
                scores[i] = min(max(float(c), 0.0), 1.0)
                rejected[i] = scores[i] < self.floor[self.language[b]]
        return names, scores, rejected


def _spherical_kmeans(v: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = v[rng.choice(len(v), min(k, len(v)), replace=False)]
    for _ in range(rounds):
        own = (v @ centres.T).argmax(axis=1)
        sums = np.stack([v[own == j].sum(axis=0) if (own == j).any() else centres[j] for j in range(len(centres))])
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = sums / np.where(norm > 0, norm, 1.0)
    return centres


def fit(
    labelled: DataFrame,
    per_language: int = 1000,
    clusters: int = 4,
    rounds: int = 8,
    slack: float = 0.25,
    seed: int = 7,
    most_rows: int = 20_000,
) -> Model:
    """Fit on ``labelled(text, lang)``: at most ``per_language`` rows of each language, chosen by a hash.

    The bound makes the sample (and the driver's memory) independent of the
    table; they are the texts with the smallest hashes, each once whatever its copies, so a rerun
    fits the same model and a text that a third of all rows hold is one row of the sample.
    The sample has ``most_rows`` texts at most: with many languages each gives fewer, and should there be more languages
    than that, those with the most rows are learned.
    ``floor`` is ``slack`` times the lowest percentile of the training rows' own cosines.
    """
    ship(labelled.sparkSession)
    usable = labelled.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("text", "lang")
    # a hash threshold passes about one and a half times the bound of each language; copies of a text are then one row
    counted = usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_rows).collect()
    if not counted:
        none = np.zeros(0, int)
        return Model([], none, np.zeros((0, DIMS)), np.ones(DIMS), np.zeros(0))
    per_language = max(1, min(per_language, most_rows // len(counted)))
    cuts = [(r["lang"], min(1.0, max(1.5 * per_language, per_language + 8) / r["n"])) for r in counted]
    cut = labelled.sparkSession.createDataFrame(cuts, "lang string, cut double")  # at most ``most_rows`` rows
    hashed = usable.withColumn("h", F.xxhash64(F.lit(seed), "text"))
    share = (F.col("h").bitwiseAND((1 << 30) - 1)).cast("double") / F.lit(float(1 << 30))
    near = hashed.join(F.broadcast(cut), "lang").filter(share <= F.col("cut")).groupBy("lang", "h").agg(F.min("text").alias("text"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))  # the threshold bounds a language's rows
    near = near.withColumn("place", place).filter(F.col("place") <= per_language)

    @F.pandas_udf(T.BinaryType())
    def features(texts):
        return texts.map(lambda t: _pack(counts_of(t)))

    rows = near.select("lang", "h", features("text").alias("counts")).collect()
    rows.sort(key=lambda r: (r["lang"], r["h"]))
    languages = sorted({r["lang"] for r in rows})
    number = {lang: j for j, lang in enumerate(languages)}
    c, own = np.stack([_unpack(r["counts"]) for r in rows]), np.array([number[r["lang"]] for r in rows])
    idf = np.log((1 + len(c)) / (1 + (c > 0).sum(axis=0))) + 1
    model = Model(languages, own, c, idf, np.zeros(len(languages)))
    v = model.vectors(c)
    rng = np.random.default_rng(seed)
    centres = [_spherical_kmeans(v[own == j], clusters, rounds, rng) for j in range(len(languages))]
    language = np.concatenate([np.full(len(x), j) for j, x in enumerate(centres)])
    all_centres = np.concatenate(centres)
    floor = np.array(
        [slack * np.quantile((v[own == j] @ all_centres[language == j].T).max(axis=1), 0.01) for j in range(len(languages))]
    )
    return Model(languages, language, all_centres.astype(np.float32), idf.astype(np.float32), floor)


def predict(
    docs: DataFrame, model: Model, text: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "rejected")
) -> DataFrame:
    """``docs`` with language, score and rejection under ``names``; the model's size is fixed by its parameters."""
    ship(docs.sparkSession)
    extra = list(zip(names, (T.StringType(), T.DoubleType(), T.BooleanType()), strict=True))
    docs = docs.drop(*(n for n in names if n != text))
    schema = T.StructType(docs.schema.fields + [T.StructField(n, t) for n, t in extra])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            langs, scores, rejected = model.predict(b.column(text).to_pylist())
            cols = [*b.columns, pa.array(langs, pa.string()), pa.array(scores), pa.array(rejected)]
            yield pa.RecordBatch.from_arrays(cols, [*b.schema.names, *(n for n, _ in extra)])

    return docs.mapInArrow(run, schema)
