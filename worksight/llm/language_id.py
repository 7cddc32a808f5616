"""Language identification by compression.

Each language has a zstandard raw-content dictionary made of labelled text. All texts are
compressed as lower-case letters with single spaces for all else. A text belongs to the
language whose dictionary makes it smallest. Long texts are compressed in pieces, because a compressor learns any language
from a long one. Of equally small languages the one with more labelled documents wins.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worksight.llm.common import unused

UNKNOWN = "und"
#: What stands between letters and their marks.
BETWEEN = r"[^\p{L}\p{M}]+"
PIECE = 2048
#: Bits a byte by which the second language must do worse; below that a text is rejected.
MARGIN = 0.02
#: Makes score from the difference in bits a byte.
SHARPNESS = 12.0


def normalized(text: str) -> str:
    import regex

    return regex.sub(BETWEEN, " ", text.lower()).strip()


def dictionaries(labelled: DataFrame, excerpts: int, length: int) -> dict[str, tuple[int, bytes]]:
    """Per language the number of its labelled texts, and up to `excerpts` excerpts of `length` code points of them.

    The sample is `excerpts` documents a language: of those that share a hash slot the one
    with the least hash. An excerpt begins anywhere in its text, at a place that a hash
    picks, so no part of a text goes unlearned from. The sample is the same in any
    partitioning, and no language meets in one task.
    """
    mixed = F.xxhash64("doc_id", "text")
    at = F.pmod(F.xxhash64(mixed, F.lit("place")), F.greatest(F.lit(1), F.length("text") - (length - 1)))
    rows = labelled.select("lang", F.pmod(mixed, F.lit(excerpts)).alias("slot"), F.xxhash64(mixed, F.lit("rank")).alias("rank"), F.substring("text", (at + 1).cast("int"), F.lit(length)).alias("text")).where("text is not null and text <> ''")
    picked = rows.groupBy("lang", "slot").agg(F.min_by("text", F.struct("rank", "text")).alias("text"), F.count("*").alias("n")).orderBy("lang", "slot").collect()
    out: dict[str, list[tuple[int, bytes]]] = {}
    for row in picked:
        out.setdefault(row.lang, []).append((row.n, normalized(row.text).encode()))
    return {lang: (sum(n for n, _ in rows), b"\n".join(t for _, t in rows)) for lang, rows in out.items()}


class Identifier:
    """Compressors of all languages, made once per worker."""

    def __init__(self, contents: dict[str, tuple[int, bytes]], level: int = 5):
        import zstandard

        self.languages = sorted(contents, key=lambda lang: (-contents[lang][0], lang))
        self.compressors = []
        for lang in self.languages:
            learned = zstandard.ZstdCompressionDict(contents[lang][1], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            learned.precompute_compress(level=level)
            self.compressors.append(zstandard.ZstdCompressor(level=level, dict_data=learned, write_checksum=False, write_content_size=False, write_dict_id=False))

    def sizes(self, text: bytes) -> list[int]:
        pieces = [text[i : i + PIECE] for i in range(0, len(text), PIECE)]
        return [sum(len(c.compress(p)) for p in pieces) for c in self.compressors]

    def predict(self, text: str) -> tuple[str, float, bool]:
        """(language, score, rejected) of a normalized text."""
        data = text.encode()
        sizes = self.sizes(data)
        order = sorted(range(len(sizes)), key=sizes.__getitem__)
        best = order[0]
        worse = [8 * (s - sizes[best]) / max(1, len(data)) for s in sizes]
        score = 1 / sum(math.exp(-SHARPNESS * w) for w in worse)
        return self.languages[best], score, len(order) > 1 and worse[order[1]] < MARGIN


def predict_languages(docs: DataFrame, training: DataFrame, excerpts: int = 128, length: int = 1024) -> DataFrame:
    """docs with lang_pred, score and rejected, from text alone.

    `training` (doc_id, text, lang) gives the languages; rows without lang are no labels.
    lang_pred is one of its languages, or `und` where text is null or has no letter, with
    score 0. `rejected` tells that the margin over the second language is too narrow to
    trust; the best guess stays in lang_pred. Of equally good languages the one with more
    labelled texts wins, then the one that comes first. Without any labelled text all rows
    are `und`. Long texts are compressed whole, in pieces. Every row stands for itself,
    repeated ones too; empty in, empty out. Other columns pass, save those named lang_pred,
    score and rejected, which are replaced.
    """
    docs = docs.drop("lang_pred", "score", "rejected")
    kept, name = docs.columns, unused(docs, "found")
    contents = dictionaries(training.where("lang is not null"), excerpts, length)
    shared = docs.sparkSession.sparkContext.broadcast(contents)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        identifier = Identifier(shared.value)
        for texts in batches:
            plain = (normalized(t) if t else "" for t in texts)
            rows = [identifier.predict(t) if identifier.languages and any(map(str.isalpha, t)) else (UNKNOWN, 0.0, True) for t in plain]
            yield pd.DataFrame(rows, columns=["lang_pred", "score", "rejected"])

    found = docs.withColumn(name, predict(F.col("text").cast("string")))
    return found.select(*[f"`{c}`" for c in kept], f"{name}.lang_pred", f"{name}.score", f"{name}.rejected")
