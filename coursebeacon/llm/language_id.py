"""Language ID by hierarchical discrimination: family first, then pairs of languages within it.

Texts become hashed counts of byte n-grams of their letters, square-rooted and scaled to length one.
Linear support vector machines, trained here by Spark ML on a bounded sample of labelled rows,
separate each family from the others, and each two languages of a family from each other. Only the
weights are shipped to the tasks that predict.
"""

import math
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType
from pyspark.sql.window import Window

from coursebeacon.llm.shipping import ship
from coursebeacon.llm.words import unused
from coursebeacon.session import staged

UNKNOWN = "und"
#: Families of language codes (fixed, from common knowledge); other codes are families of their own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "fy", "lb", "yi"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "bs", "sl", "mk"),
    "indo-aryan": ("hi", "bn", "mr", "gu", "pa", "ur", "ne", "si", "or", "as"),
    "iranian": ("fa", "ps", "ku", "tg"),
    "turkic": ("tr", "az", "kk", "ky", "uz", "tk", "tt", "ug"),
    "uralic": ("fi", "et", "hu"),
    "semitic": ("ar", "he", "am", "mt"),
    "dravidian": ("ta", "te", "kn", "ml"),
    "baltic": ("lt", "lv"),
    "celtic": ("ga", "cy", "gd", "br"),
    "sinitic": ("zh", "yue", "wuu"),
    "austronesian": ("id", "ms", "tl", "jv", "su", "mg"),
}
DIMENSIONS = 1 << 12
#: Labelled rows per language that the machines are trained on.
SAMPLE = 1000
#: Bytes that are hashed at a time.
CHUNK = 1 << 20
#: Rows of features that are passed on at a time.
BATCH_ROWS = 256
#: Languages that machines are trained for at most.
MAX_LANGUAGES = 500
NOT_LETTERS = re.compile(r"[\W\d_]+")
#: What \w has beside letters (\p{L}) and decimal digits: fractions, circled and Roman numerals.
NUMERALS = {ord(c): " " for c in map(chr, range(sys.maxunicode + 1)) if c.isnumeric() and not (c.isalpha() or c.isdecimal())}
RARE = frozenset(map(chr, NUMERALS))


def letters(text: str | None) -> str:
    """The runs of letters of the lower-cased text, parted by single spaces."""
    text = (text or "").lower()
    if not text.isascii() and not RARE.isdisjoint(text):
        text = text.translate(NUMERALS)
    return NOT_LETTERS.sub(" ", text).strip()


def features(text: str, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Square roots of the counts of n-grams of 1 to 4 bytes of letters, scaled to one."""
    raw = b" " + text.encode("utf-8", "surrogatepass") + b" "
    counts = np.zeros(dimensions)
    for i in range(0, len(raw), CHUNK):
        letters = np.frombuffer(raw[i : i + CHUNK + 3], np.uint8).astype(np.uint32)
        code = np.zeros(len(letters), np.uint32)
        for n in range(4):
            code = code[: len(letters) - n] * np.uint32(0x01000193) ^ (letters[n:] + np.uint32(1))
            new = code if i + CHUNK >= len(raw) else code[: CHUNK]
            slots = (new * np.uint32(2654435761)) >> np.uint32(32 - (dimensions.bit_length() - 1))
            counts += np.bincount(slots, minlength=dimensions)
    roots = np.sqrt(counts)
    return roots / max(np.linalg.norm(roots), 1e-9)


@dataclass
class Model:
    """Languages of each family; weights of the machines, the last one being the intercept."""

    families: dict[str, list[str]] = field(default_factory=dict)
    one_family: dict[str, np.ndarray] = field(default_factory=dict)
    pair: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        """(language, score): the score is the product of both decisions, each from 0 to 1."""
        if not self.families:
            return UNKNOWN, 0.0
        x = np.append(x, 1.0)
        names = list(self.families)
        if len(names) > 1:
            margins = [float(self.one_family[name] @ x) for name in names]
            best = max(range(len(names)), key=margins.__getitem__)
            name, score = names[best], 1 / (1 + math.exp(-max(-30.0, min(30.0, 2 * margins[best]))))
        else:
            name, score = names[0], 1.0
        languages = self.families[name]
        if len(languages) == 1:
            return languages[0], score
        votes, sums = dict.fromkeys(languages, 0), dict.fromkeys(languages, 0.0)
        for (a, b), weights in self.pair.items():
            if a in votes and b in votes:
                margin = float(weights @ x)
                votes[a if margin > 0 else b] += 1
                sums[a] += margin
                sums[b] -= margin
        best_language = max(languages, key=lambda c: (votes[c], sums[c]))
        rest = sums[best_language] / (len(languages) - 1)
        return best_language, score / (1 + math.exp(-max(-30.0, min(30.0, 2 * rest))))


def family_of(language: str, families: dict[str, tuple[str, ...]]) -> str:
    code = language.lower().split("-")[0]
    return next((name for name, codes in families.items() if code in codes), f"only {language}")


def _machine(rows: DataFrame, positive: Column) -> np.ndarray:
    fitted = LinearSVC(maxIter=40, regParam=0.0005, standardization=False).fit(
        rows.select(positive.cast("double").alias("label"), "features")
    )
    return np.append(fitted.coefficients.toArray(), fitted.intercept)


def train(
    labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE,
    families: dict[str, tuple[str, ...]] | None = None, dimensions: int = DIMENSIONS, max_languages: int = MAX_LANGUAGES,
) -> Model:
    """Fits the machines on at most ``sample`` rows of each language, chosen by a hash of the text.

    Rows without language or without a letter are left out; equal texts of a language count once. A
    language alone in its family needs no pairs, a family alone no machine, and without any row
    left the model predicts nothing. More than ``max_languages`` languages are an error: such a column
    does not hold languages.
    """
    ship(labelled.sparkSession)
    text = F.col(text_col)
    known = labelled.filter(F.col(lang_col).isNotNull() & text.rlike(r"\p{L}")).select(
        F.col(lang_col).alias("lang"), F.xxhash64(text).alias("h"), text.alias("text")
    )
    # the smallest hashes of each language: cut by a threshold first, so that no task sorts them all
    distinct = known.select("lang", "h").distinct()  # copies must not lower the threshold
    counted = distinct.groupBy("lang").count().limit(max_languages + 1)
    sizes = {row["lang"]: row["count"] for row in counted.collect()}
    if not sizes:
        return Model()
    if len(sizes) > max_languages:
        raise ValueError(f"column {lang_col} has more than {max_languages} languages")
    share = F.element_at(F.create_map(*[
        x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(1.0, 4 * sample / n)))
    ]), F.col("lang"))
    low = known.filter(F.pmod("h", F.lit(1 << 20)) < F.ceil(share * (1 << 20)))
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 20)), "h"))
    chosen = low.dropDuplicates(["lang", "h"]).withColumn("n", first).filter(F.col("n") <= sample)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(start, BATCH_ROWS)
                vectors = np.zeros((batch.num_rows, dimensions), np.float32)
                for i, text in enumerate(batch.column(1)):
                    vectors[i] = features(letters(text.as_py()), dimensions)
                edges = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * dimensions)
                lists = pa.ListArray.from_arrays(edges, pa.array(vectors.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["lang", "x"])

    rows = chosen.select("lang", "text").mapInArrow(measure, "lang string, x array<float>")
    rows = staged(rows, "language-sample").select("lang", array_to_vector("x").alias("features"))
    model = Model()
    for language in sorted(sizes):
        model.families.setdefault(family_of(language, families or FAMILIES), []).append(language)
    names = list(model.families)
    for i, name in enumerate(names if len(names) > 1 else []):
        if len(names) == 2 and i == 1:
            model.one_family[name] = -model.one_family[names[0]]
        else:
            model.one_family[name] = _machine(rows, F.col("lang").isin(model.families[name]))
    for languages in model.families.values():
        for a, b in combinations(languages, 2):
            model.pair[a, b] = _machine(rows.filter(F.col("lang").isin(a, b)), F.col("lang") == a)
    return model


def predict(
    docs: DataFrame, model: Model, text_col: str = "text", out: str = "lang_pred", score: str = "score",
    dimensions: int = DIMENSIONS,
) -> DataFrame:
    """All rows of ``docs`` with the predicted language and its score (0 to 1) added.

    Only the text decides, read whole. A null text or one without a letter is ``und`` with score 0.
    Rows are judged one by one, so null or repeated ids do not matter; an empty table gives an empty
    result. Columns of ``docs`` named like the added ones are replaced.
    """
    shared = ship(docs.sparkSession).sparkContext.broadcast(model)
    names = [c for c in docs.columns if c not in (out, score)]
    slim = docs.select(*[docs[f"`{c}`"] for c in names], docs[f"`{text_col}`"].alias(unused(names)))
    schema = StructType([*slim.schema.fields[:-1], StructField(out, StringType()), StructField(score, DoubleType())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines = shared.value
        for batch in batches:
            found = []
            for text in batch.column(batch.num_columns - 1):
                own = letters(text.as_py())
                found.append(machines.predict(features(own, dimensions)) if own else (UNKNOWN, 0.0))
            languages, scores = pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], languages, scores], names=schema.names)

    return slim.mapInArrow(judge, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4; never for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
