"""Token counts of whole texts, as a byte-level BPE tokenizer gives them.

Merges never cross a pre-token, so a text's count is the sum over its pre-tokens. Lookups
have two tiers: a broadcast table with the lengths of frequent pre-tokens, fixed in size,
and a bounded cache in each worker that encodes the pre-tokens missing there. No pre-token
is ever shuffled: the table comes from the counts of a bounded sample of documents.
"""

from __future__ import annotations

import functools
import itertools
import json
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worksight.llm.common import encoded

#: Fixed value: how byte-level BPE of this family cuts text before merging.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space as Unicode has it; other libraries' \s also takes \x1c-\x1f.
WHITE = r"\x09-\x0d\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CACHE = 1 << 18
LONGEST = 64


class TokenizerError(ValueError):
    """A tokenizer file asks for steps that this module doesn't cut text by."""


def checked(tokenizer) -> None:
    """Raises unless the file has byte-level pre-tokens by PRE_TOKENS, no normalizer, and plain special strings."""
    told = json.loads(tokenizer.to_str())
    cut = told["pre_tokenizer"] or {}
    if told["normalizer"] or (cut.get("type"), cut.get("add_prefix_space"), cut.get("use_regex", True)) != ("ByteLevel", False, True):
        raise TokenizerError(f"normalizer {told['normalizer']}, pre_tokenizer {cut}")
    odd = [t["content"] for t in told["added_tokens"] if t["single_word"] or t["lstrip"] or t["rstrip"] or not t["content"]]
    if odd or told["truncation"] or told["padding"]:
        raise TokenizerError(f"special strings with flags {odd}, truncation or padding")


@functools.lru_cache(maxsize=1)
def machinery(path: str):
    """(tokenizer, compiled pre-token pattern, special strings, cache of lengths) of a worker, kept over its tasks."""
    import regex
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    checked(tokenizer)
    pattern = PRE_TOKENS.replace(r"\S", f"[^{WHITE}]").replace(r"[^\s", f"[^{WHITE}").replace(r"\s", f"[{WHITE}]")
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    cut = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
    return tokenizer, regex.compile(pattern), cut, {}


def pieces(text: str, cut) -> tuple[list[str], int]:
    """Stretches between special strings, and how many of these there are."""
    if cut is None or not cut.search(text):
        return [text], 0
    parts = cut.split(text)
    return parts, len(parts) - 1


class Counting:
    """Counts tokens with the shared table and the worker's cache."""

    def __init__(self, path: str, frequent: dict[str, int]):
        self.tokenizer, self.pattern, self.cut, self.cache = machinery(path)
        self.frequent = frequent

    def encode(self, missing: list[str]) -> None:
        for token, found in zip(missing, self.tokenizer.encode_batch(missing, add_special_tokens=False), strict=True):
            self.cache[token] = len(found)

    def count(self, text: str) -> int:
        parts, total = pieces(text, self.cut)
        frequent, cache = self.frequent, self.cache
        for part in parts:
            later = []
            for token in self.pattern.findall(part):
                n = frequent.get(token) or cache.get(token)
                if n is None:
                    later.append(token)
                else:
                    total += n
            if later:
                once = list(dict.fromkeys(later))
                self.encode(once)
                total += sum(map(cache.__getitem__, later))
                for token in once:
                    if len(token) > LONGEST:
                        del cache[token]
                if len(cache) > CACHE:  # the older half goes
                    for token in list(itertools.islice(cache, CACHE // 2)):
                        del cache[token]
        return total


def frequent_lengths(docs: DataFrame, path: str, sample: int, entries: int) -> dict[str, int]:
    """Lengths of the `entries` most frequent pre-tokens in about `sample` documents."""
    rows = docs.count()
    share = max(1, rows // sample)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, pattern, cut, _ = machinery(path)
        seen: Counter = Counter()
        for batch in batches:
            for text in encoded(batch.column(0)):
                for part in pieces(text.decode(), cut)[0]:
                    seen.update(t for t in pattern.findall(part) if len(t) <= LONGEST)
        top = seen.most_common(entries)
        yield pa.RecordBatch.from_pydict({"token": pa.array([t for t, _ in top], pa.string()), "n": pa.array([n for _, n in top], pa.int64())})

    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0).select("text")
    top = some.mapInArrow(tally, "token string, n long").groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(entries).collect()
    tokenizer = machinery(path)[0]
    return {r.token: len(x) for r, x in zip(top, tokenizer.encode_batch([r.token for r in top], add_special_tokens=False), strict=True)}


def token_counts(docs: DataFrame, path: str, limit: int = 1024, sample: int = 1000, entries: int = 16384) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of docs (doc_id, text).

    `path` is a tokenizer file with byte-level pre-tokens. Counts are those of its library
    without begin or end tokens; special strings inside a text count as it treats them.
    Files that cut text in another way are an error. `sample` and `entries` bound the
    broadcast table; they change speed, never results. Long texts are counted whole.
    Null texts count as empty: no bytes, no tokens. A null doc_id stays null and repeated
    rows are counted each. Other columns are ignored. Empty in, empty out.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    shared = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, path, sample, entries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counting = Counting(path, shared.value)
        for batch in batches:
            texts = encoded(batch.column(1))
            out = pd.DataFrame({"n_bytes": [len(t) for t in texts], "n_tokens": [counting.count(t.decode()) for t in texts]}, dtype="int64")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.n_bytes, pa.int64()), pa.array(out.n_tokens, pa.int64()), pa.array(out.n_tokens > limit, pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
