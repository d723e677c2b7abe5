"""Language identification by hyperdimensional profiles.

Every letter, that is every lower-case code point, has a random vector of +1 and -1 by a seeded hash, held as bits. The vector of an n-gram binds (multiplies;
for bits, exclusive or) its letters' vectors, each permuted by its place. A text's profile bundles (adds) its n-grams' vectors; a language's prototype bundles
the profiles of its labelled texts. A text has the language whose prototype has the largest cosine.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mix, sliced, small_batches, with_columns

DIM, GRAM, SEED = 512, 3, 20
#: A text of a language is at least as like a prototype as this share of the labelled texts is not. Chance gives unrelated texts a cosine of
#: about 1 / sqrt(DIM); the bound stays within these multiples of it, as few labelled texts are all too like the prototypes they make.
LIKE_QUANTILE, LIKE_BOUNDS = 0.005, (4.0, 8.0)
#: Likenesses are counted in so many steps of a unit: counts of steps reach the driver, however many texts there are.
LIKE_STEPS = 100_000
UND = "und"


@lru_cache(1)
def letters() -> np.ndarray:
    """For each code point its lower-case letter, 0 for what is no letter."""
    table = np.zeros(0x110000, np.int32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            table[c] = ord(unicodedata.normalize("NFC", ch.lower() or ch)[0])
    return table


def letter_bits(points: np.ndarray, dim: int = DIM) -> np.ndarray:
    """The vectors of letters as ``dim`` bits (1 for -1) in words of 64, by a hash of the code point and the word's place."""
    words = np.arange(dim // 64, dtype=np.uint64)
    return mix(mix(points.astype(np.uint64)[:, None] + np.uint64(SEED << 32)) + (words + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def permuted(bits: np.ndarray, place: int) -> np.ndarray:
    """The vectors' components moved on by 64 * ``place``."""
    return np.roll(bits, place, axis=-1)


def grams_of(text: str, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray] | None:
    """The distinct n-grams of letters (one a row) and their counts; None without a letter. Runs of non-letters count as one gap, also at both ends."""
    code = letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64)
    if not code.any():
        return None
    code = np.concatenate([[0], code, [0]])
    gap = code == 0
    code = code[~(gap & np.concatenate([[False], gap[:-1]]))]
    if len(code) < gram:
        code = np.concatenate([code, np.zeros(gram - len(code), np.int64)])
    key = np.zeros(len(code) - gram + 1, np.int64)
    for k in range(gram):
        key = key << 21 | code[k : len(code) - gram + 1 + k]
    key, count = np.unique(key, return_counts=True)
    return np.stack([key >> 21 * (gram - 1 - k) & (1 << 21) - 1 for k in range(gram)], axis=1), count


def profiles(text: str, dim: int = DIM, gram: int = GRAM) -> np.ndarray | None:
    """Two bundled vectors of a whole text, each n-gram by its count and by the root of it; None if it has no letter."""
    found = grams_of(text, gram)
    if found is None:
        return None
    grams, count = found
    own, at = np.unique(grams, return_inverse=True)
    at = at.reshape(grams.shape)
    vectors = [np.ascontiguousarray(permuted(letter_bits(own, dim), gram - 1 - k)) for k in range(gram)]
    total = np.zeros((2, dim), np.float32)
    weights = np.stack([count, np.sqrt(count)]).astype(np.float32)
    for a in range(0, len(grams), 4096):  # a bounded matrix, however many n-grams a text has
        part = at[a : a + 4096]
        bound = vectors[0][part[:, 0]]
        for k in range(1, gram):
            bound ^= vectors[k][part[:, k]]
        bits = np.unpackbits(bound.view(np.uint8), axis=1).astype(np.float32)
        w = weights[:, a : a + 4096]
        total += w.sum(1, keepdims=True) - 2 * (w @ bits)
    return total


def profile(text: str, dim: int = DIM, gram: int = GRAM) -> np.ndarray | None:
    """The bundled vector of a whole text by its n-grams' counts; None if it has no letter."""
    both = profiles(text, dim, gram)
    return None if both is None else both[0]


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=-1, keepdims=True).clip(1e-9)


def _labelled(docs: DataFrame) -> DataFrame:
    """(lang, text) of all rows that can be learnt from."""
    small_batches(docs.sparkSession)
    return docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("lang", "text")


def _bundled(labelled: DataFrame, dim: int) -> dict[str, np.ndarray]:
    """For each language the unit vectors of both kinds of profiles. The driver gets 2 ``dim`` numbers for each: the model stands in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                v = profiles(text.as_py(), dim)
                if v is not None:
                    sums[lang] = sums.get(lang, 0) + _unit(v)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.ravel().astype(float).tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["lang", "v"])

    parts = labelled.mapInArrow(run, "lang string, v array<double>")
    summed = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    found = summed.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "x")))["x"].alias("v"))
    return {r["lang"]: _unit(np.array(r["v"]).reshape(2, dim)) for r in sorted(found.collect())}


def _centred(unit: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    mean = np.mean(list(unit.values()), axis=0) if len(unit) > 1 else 0
    return {k: _unit(v - mean) for k, v in unit.items()}


def prototypes(labelled: DataFrame, dim: int = DIM) -> dict[str, np.ndarray]:
    """A unit vector for each language of ``labelled`` (doc_id, text, lang), centred on their mean; fitted on all of its texts."""
    return _centred({k: v[0] for k, v in _bundled(_labelled(labelled), dim).items()})


def _likeness(v: np.ndarray, damped: np.ndarray) -> float:
    """The largest cosine of a text's damped profile with the prototypes; near 0 where it resembles none, as these are not centred."""
    return float((damped @ _unit(v[1])).max())


def fitted(labelled: DataFrame, dim: int = DIM) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The prototypes of all texts of ``labelled``, and the damped ones (not centred, one a row)."""
    unit = _bundled(_labelled(labelled), dim)
    damped = np.array([v[1] for v in unit.values()], np.float32).reshape(len(unit), dim)
    return _centred({k: v[0] for k, v in unit.items()}), damped


def like_bound(likes: DataFrame, dim: int = DIM) -> float:
    """The likeness to the prototypes that a text of a language has at least: the quantile LIKE_QUANTILE of all the labelled texts' (likeness), within LIKE_BOUNDS.

    The likeness is to the most similar language, whatever the label, so wrong labels do not lower the bound. All texts count; the quantile is
    rounded down to a step of LIKE_STEPS.
    """
    low, high = (x / dim**0.5 for x in LIKE_BOUNDS)
    step = F.floor(F.least(F.greatest(F.col("likeness"), F.lit(low)), F.lit(high)) * LIKE_STEPS)
    counts = sorted((r["step"], r["n"]) for r in likes.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect())
    rank, seen = LIKE_QUANTILE * (sum(n for _, n in counts) - 1), 0
    for at, n in counts:
        seen += n
        if seen > rank:
            return min(max(at / LIKE_STEPS, low), high)
    return high


def held_out(doc_id: Column) -> Column:
    """crc32 of the id's text modulo 4 is 2; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def predict(docs: DataFrame, model: dict[str, np.ndarray], *keep: str, dim: int = DIM, with_text: bool = False, damped: np.ndarray | None = None) -> DataFrame:
    """doc_id, lang_pred, score, and then the columns ``keep`` as they are: the language of the nearest prototype and its cosine, mapped from -1..1 to 0..1.

    ``with_text`` puts the text behind doc_id; it then passes through the task once, not twice. ``damped`` (of ``fitted``) puts the
    likeness to the most similar language behind the score, 0 for ``und``.

    ``und`` and 0 for a null text, one without a letter, or an empty model. Ties go to the smaller name. One row for each input row.
    """
    names, matrix = list(model), np.array(list(model.values()), np.float32).reshape(len(model), dim)
    liked = damped is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            langs, scores, likes = [], [], []
            for t in batch.column(1):
                t = t.as_py()
                both = profiles(t, dim) if t and names else None
                if both is None:
                    langs.append(UND)
                    scores.append(0.0)
                    likes.append(0.0)
                    continue
                v = both[0]
                if damped is not None:
                    likes.append(_likeness(both, damped))
                cos = matrix @ v / max(float(np.linalg.norm(v)), 1e-9)
                k = int(np.argmax(cos))
                langs.append(names[k])
                scores.append(min(1.0, max(0.0, (1 + float(cos[k])) / 2)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: 1 + with_text], pa.array(langs, pa.string()), pa.array(scores, pa.float64()), *[pa.array(likes, pa.float64())] * liked, *batch.columns[2:]], names=schema.names)

    fields = [T.StructField("doc_id", T.LongType()), *[T.StructField("text", T.StringType())] * with_text, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), *[T.StructField("likeness", T.DoubleType())] * liked]
    schema = T.StructType([*fields, *docs.select(*keep).schema.fields])
    return with_columns(docs, *keep).mapInArrow(run, schema)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of all rows of (doc_id, text, lang); fitted on all labelled rows that aren't held out.

    One row for each input row: repeated rows get equal results, and equal texts equal predictions. Null ids are neither fitted on nor held out. A null
    text or one without a letter is ``und`` with score 0. Texts are read whole, however long, in bounded memory. Empty tables give no rows. lang,
    source and the id are no inputs of a prediction; other columns, whatever their names, are left out.
    """
    model = prototypes(docs.select("doc_id", "text", "lang").where(~held_out(F.col("doc_id"))))
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
