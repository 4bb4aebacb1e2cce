"""Language identification by compression: the language whose zstandard dictionary makes a text smallest."""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._shared import crc_of, hash_order, in_arrow, kind_of, sub_batches, table

UNKNOWN = "und"
#: Languages that are learned, at most; each has a dictionary in every worker, so more are an error.
MOST_LANGUAGES = 500
#: Bytes that are compressed at once, and zstandard's level; below about 6 it finds no matches of three bytes.
BLOCK, LEVEL = 2048, 12


def learn(texts: DataFrame, docs_each: int = 400, dictionary_bytes: int = 32_000, chars_each: int = 1500, seed: int = 42) -> dict[str, bytes]:
    """Raw-content dictionaries by language from rows (doc_id, text, lang).

    The sample is bounded: of each language the `docs_each` distinct texts with the smallest hashes, `chars_each`
    characters from the middle of each, `dictionary_bytes` in all. Texts that the first dictionaries give to another
    language are left out of the second ones, so that mislabelled texts don't count. Null languages, null and empty
    texts and those without a letter don't count; equal texts of a language count once, of several languages in each.
    More than MOST_LANGUAGES languages are an error; an empty table teaches none.
    """
    rows = texts.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = rows.groupBy("lang").count()
    if counts.count() > MOST_LANGUAGES:
        raise ValueError(f"there are more than {MOST_LANGUAGES} languages")
    rows = rows.join(F.broadcast(counts), "lang")
    share = F.pmod(F.xxhash64(F.lit(seed), "text"), F.lit(1 << 20)) / F.lit(1 << 20)
    rows = rows.where(share < F.lit(6.0 * docs_each) / F.col("count"))  # one group's copies share a hash, hence the slack
    middle = F.greatest(F.lit(1), F.floor((F.length("text") - chars_each) / 2).cast("int"))
    rows = rows.select("lang", F.lower(F.substring("text", middle, F.lit(chars_each))).alias("part"), hash_order("text", seed=seed + 1).alias("h")).distinct()
    rows = rows.withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy("h", "part"))).where(F.col("k") <= docs_each)
    parts: dict[str, list[str]] = {}
    for r in rows.orderBy("lang", "k").select("lang", "part").toLocalIterator():
        parts.setdefault(r.lang, []).append(r.part)
    first = {lang: _dictionary(p, dictionary_bytes, seed) for lang, p in parts.items()}
    names, coders = _coders(_level(first), LEVEL, BLOCK)
    agreed = {lang: [x for x in p if names[int(np.argmin([len(c(x.encode())) for c in coders]))] == lang] for lang, p in parts.items()}
    return _level({lang: _dictionary(agreed[lang] or parts[lang], dictionary_bytes, seed) for lang in parts})


def _level(dictionaries: dict[str, bytes], least: int = 8_000) -> dict[str, bytes]:
    """All cut to the size of the smallest, or to `least`: in a larger dictionary a match costs more bits to point at."""
    size = max(least, min(map(len, dictionaries.values()), default=0))
    return {lang: d[-size:] for lang, d in dictionaries.items()}


def _dictionary(parts: list[str], most: int, seed: int) -> bytes:
    """The parts' words in random order: whole sentences would match copies of a text, whatever its language."""
    words = [w for p in parts for w in p.split()]
    random.Random(seed).shuffle(words)
    return " ".join(words).encode()[-most:]


def _coders(dictionaries: dict[str, bytes], level: int, block: int) -> tuple[list[str], list]:
    """A compressor for each language, by name. Parameters are those for blocks, whose matches may be three bytes long."""
    import zstandard as z

    names, out = sorted(dictionaries), []
    for name in names:
        raw = dictionaries[name]
        params = z.ZstdCompressionParameters.from_level(level, source_size=block, dict_size=len(raw), write_checksum=0, write_content_size=0, write_dict_id=0)
        d = z.ZstdCompressionDict(raw, dict_type=z.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=params)
        out.append(z.ZstdCompressor(dict_data=d, compression_params=params).compress)
    return names, out


def _classify(dictionaries: dict[str, bytes], margin: float, block: int, level: int):
    kinds = {"lang_pred": pa.string(), "score": pa.float64(), "margin": pa.float64(), "rejected": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, coders = _coders(dictionaries, level, block)
        for whole in batches:
            for batch in sub_batches(whole, "text"):
                out = []
                for text in batch.column("text").to_pylist():
                    if not text or not names or not any(map(str.isalpha, text)):
                        out.append((UNKNOWN, 0.0, 0.0, True))
                        continue
                    raw = text.lower().encode()
                    size = np.zeros(len(names))
                    for a in range(0, len(raw), block):
                        part = raw[a : a + block]
                        size += [len(c(part)) for c in coders]
                    order = np.argsort(size, kind="stable")
                    best = size[order[0]]
                    gap = (size[order[1]] - best) / size[order[1]] if len(names) > 1 else 1.0
                    odds = np.exp(-(size - best) / (0.01 * best + 1.0))
                    out.append((names[order[0]], float(1 / odds.sum()), float(gap), bool(gap < margin)))
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, k) for c, k in zip(cols, kinds.values()))], names=["id", *kinds])

    return run, "lang_pred string, score double, margin double, rejected boolean"


def identify(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", margin: float = 0.01, block: int = BLOCK, level: int = LEVEL) -> DataFrame:
    """The language of every whole text: id_col, lang_pred, score, margin, rejected.

    A text is cut into blocks of `block` bytes; every block is compressed with every language's dictionary and the
    language with the smallest sum wins, ties by name. score (0 to 1) weighs the sizes against each other; margin is
    by how much the second is larger, and rejected is true where that is below `margin`. Texts that are null or
    have no letter are `und` with score 0 and rejected, as all are where no language was learned. Ids may have any type,
    null too; rows that repeat have equal results, very long texts are read whole, an empty table gives an empty
    result, other columns are ignored.
    """
    run, kind = _classify(dictionaries, margin, block, level)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return in_arrow(rows, run, f"id {kind_of(docs, id_col)}, {kind}").withColumnRenamed("id", id_col)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.pmod(crc_of("doc_id"), F.lit(4)) == 2
    learned = learn(docs.where(~fold).select("doc_id", "text", "lang"))
    return identify(docs, learned).withColumn("held_out", fold).select("doc_id", "held_out", "lang_pred", "score", "margin", "rejected")
