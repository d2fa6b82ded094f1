"""Language identification by compression.

Each language's dictionary is raw text of that language; a text is encoded with zstandard once per dictionary, and
the smallest encoding names the language. The margin is the relative distance to the second smallest.

Scale: the dictionaries are the only state, `DICTIONARY` bytes for each of at most `LANGUAGES` languages, built in the
executors from at most `SAMPLE` pieces of labelled texts of each. Prediction is one pass without a shuffle.
"""

from __future__ import annotations

import re

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import tune

#: Bounds of the fitted sample: pieces a language, characters of a piece (longer texts are several), bytes of a dictionary.
SAMPLE, LONGEST, DICTIONARY = 400, 20_000, 110 << 10
LANGUAGES = 512
LEVEL = 6
#: Bytes that are encoded at once: a dictionary saves a bounded number of bytes, so the sizes of a text's pieces are added up.
PIECE = 32 << 10
#: Levels at which a text with a narrow margin is encoded again; the sizes are added up.
CLOSE_LEVELS = (1, 3, 12, 19)
#: Relative margins below this are narrow; rejected if narrow after the second look.
MARGIN = 0.002
_LETTER = re.compile(r"[^\W\d_]")
_OTHER = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    """The lower-cased words of letters, space-separated: marks, digits and layout don't tell languages apart."""
    return _OTHER.sub(" ", text.lower()).encode()


def fit(docs: DataFrame, learn: Column) -> dict[str, bytes]:
    """A dictionary for each non-null lang among the rows of docs(doc_id, text, lang) where `learn` holds.

    Texts over LONGEST characters are cut into pieces. Pieces are drawn by a hash of doc_id, text and place, so the
    draw doesn't depend on order or partitions. Of a language with n pieces, about 2 * SAMPLE have a hash small enough
    to leave the scan, and the SAMPLE smallest are drawn. Each language has a dictionary of its own size, whatever
    the others have. Languages with under 8 bytes of letters aren't learned. The most frequent language comes first,
    which settles ties.
    """
    known = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") > 0))
    pieces = F.ceil(F.length("text") / LONGEST).cast("long")
    counts = {r["lang"]: r["pieces"] for r in known.groupBy("lang").agg(F.count("*").alias("n"), F.sum(pieces).alias("pieces")).orderBy(F.desc("n"), "lang").limit(LANGUAGES + 1).collect()}
    if len(counts) > LANGUAGES:
        raise ValueError(f"lang has over {LANGUAGES} values")
    if not counts:
        return {}
    least = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min((1 << 62) - 1, (2 * SAMPLE << 62) // n))])
    hashed = known.select("lang", "text", "doc_id", F.xxhash64("doc_id", "text").alias("hash"), pieces.alias("pieces"))
    placed = F.transform(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1), lambda i: F.struct(F.when(i == 0, F.col("hash")).otherwise(F.xxhash64("hash", i)).bitwiseAND((1 << 62) - 1).alias("place"), i.alias("i")))
    near = F.filter(placed, lambda p: p["place"] <= least[F.col("lang")])
    cut = F.transform(near, lambda p: F.struct(p["place"].alias("place"), F.substr("text", (p["i"] * LONGEST + 1).cast("int"), F.lit(LONGEST)).alias("text")))
    few = hashed.select("lang", "doc_id", F.explode(cut).alias("p")).select("lang", "doc_id", "p.place", "p.text")
    order = Window.partitionBy("lang").orderBy("place", "doc_id", "text")
    drawn = few.select("lang", "text", F.row_number().over(order).alias("at")).where(F.col("at") <= SAMPLE)

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        data = b"\n".join(letters(t) for t in rows.sort_values("at")["text"])[:DICTIONARY]
        return pd.DataFrame({"lang": rows["lang"].iloc[:1], "data": [data]})

    built = drawn.groupBy("lang").applyInPandas(build, "lang string, data binary")  # SAMPLE pieces a group at most
    out = {r["lang"]: bytes(r["data"]) for r in built.collect()}
    return {lang: out[lang] for lang in counts if len(out.get(lang, b"")) >= 8}


def predictor(spark: SparkSession, dictionaries: dict[str, bytes], margin: float = MARGIN):
    """A function of a text column: struct(lang, score, rejected). `und`, 0 and rejected if there is no letter."""
    shared = spark.sparkContext.broadcast(list(dictionaries.items()))
    state: dict = {}

    def sizes(data: bytes, level: int) -> list[int]:
        if level not in state:
            state[level] = []
            for _, content in shared.value:
                dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                dictionary.precompute_compress(level=level)
                state[level].append(zstandard.ZstdCompressor(level=level, dict_data=dictionary, write_content_size=False, write_checksum=False, write_dict_id=False))
        parts = [data[i : i + PIECE] for i in range(0, len(data), PIECE)]
        return [sum(len(encoder.compress(part)) for part in parts) for encoder in state[level]]

    def decide(found: list[int]) -> tuple[str, float, bool]:
        best = min(range(len(found)), key=found.__getitem__)
        second = min(found[:best] + found[best + 1 :], default=2 * found[best])
        gap = (second - found[best]) / second
        return shared.value[best][0], gap, gap < margin

    @F.pandas_udf("lang string, score double, rejected boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            if text is None or not _LETTER.search(text) or not shared.value:
                out.append(("und", 0.0, True))
                continue
            data = letters(text)
            answer = decide(sizes(data, LEVEL))
            if answer[2]:
                answer = decide([sum(x) for x in zip(*(sizes(data, level) for level in CLOSE_LEVELS), strict=True)])
            out.append(answer)
        return pd.DataFrame(out, columns=["lang", "score", "rejected"])

    return predict


def held_out() -> Column:
    """Documents that nothing is learned from: crc32 of doc_id as text leaves 2 by 4. False where doc_id is null."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected (no letter, or a margin under MARGIN) for each row."""
    tune(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    predict = predictor(spark, fit(docs, ~held_out()))
    return docs.select("doc_id", held_out().alias("held_out"), predict("text").alias("p")).select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"), F.col("p.rejected").alias("rejected"))
