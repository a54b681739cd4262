"""Operator 3: token counts of whole texts under a public subword vocabulary.

No piece of the vocabulary has its word-start mark anywhere but at its beginning, so no merge reaches over
a word start: a text's count is the sum over its pre-tokens (a run of spaces with the word after it). Three steps:

1. Tasks count their pre-tokens, Spark adds them up: a table with a row for each distinct pre-token of the corpus.
2. The library splits each of these once; the table keeps the number of pieces, no ids.
3. Each document's pre-token frequencies are joined to the table and summed. The `common` most frequent pre-tokens, as far as they
   have no more than `common_bytes`, travel with the tasks, which sum them where the text is; the others are listed by document and
   joined by a shuffle. A frequent long pre-token may make a hot key there, of as many rows as documents hold it: Spark splits those.

Defined cases: a null text counts as empty (0 bytes, 0 tokens); repeated rows and null keys are counted one by one; very long
texts are counted whole; a count of just `limit` is not over it; extra columns of any name take no part; an empty table
gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_text, most_frequent, written

_GENERAL = re.compile(" *[^ ]+| +$")


def pre_tokens(text: str) -> list[str]:
    """The text's pre-tokens, each without the one leading space that the encoder adds itself."""
    text = text.replace("▁", " ")
    if "  " not in text and text[:1] != " " and text[-1:] != " ":
        return text.split(" ")
    return [p[1:] for p in _GENERAL.findall(" " + text)]


def distinct_pre_tokens(texts: DataFrame, held: int = 500_000) -> DataFrame:
    """(piece, n) of a DataFrame of one text column. A task holds `held` pre-tokens at most before it sends their counts on."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["piece", "n"])

        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    seen.update(pre_tokens(t))
                if len(seen) > held:
                    yield sent()
                    seen.clear()
        yield sent()

    return texts.mapInArrow(count, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))


def counted(pieces: DataFrame, model_file: str) -> DataFrame:
    """(piece, n, tokens): each distinct pre-token's number of pieces."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        coder = sentencepiece.SentencePieceProcessor(model_file=model_file)
        for b in batches:
            # An empty pre-token, which a final single space leaves, stands for one bare word mark.
            own = b.column(0).to_pylist()
            tokens = [len(ids) if p else 1 for p, ids in zip(own, coder.encode(own, num_threads=1), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(tokens, pa.int64())], names=["piece", "n", "tokens"])

    return pieces.mapInArrow(split, "piece string, n long, tokens long")


def token_counts(docs: DataFrame, model_file: str, key: str = "doc_id", text: str = "text", limit: int = 4096, common: int = 1_000_000, common_bytes: int = 64) -> DataFrame:
    """key, n_bytes, n_tokens, over_limit (n_tokens > limit) for every row of docs."""
    body = F.col(f"`{text}`").cast("string")
    vocabulary = written(counted(distinct_pre_tokens(docs.select(body)), model_file))
    is_common = (F.octet_length("piece") <= common_bytes) & most_frequent(vocabulary, common)
    near = vocabulary.filter(is_common).select("piece", "tokens").toArrow()  # `common` rows of `common_bytes` at most
    sent = docs.sparkSession.sparkContext.broadcast((near.column("piece").to_pylist(), near.column("tokens").to_pylist()))

    def score(batches: Iterator[list]) -> Iterator[tuple]:
        tokens = dict(zip(*sent.value, strict=True))
        for texts in batches:
            parts, rare = [], []
            for t in texts:
                freq = Counter(pre_tokens(t)) if t else {}
                parts.append(sum(tokens[p] * n for p, n in freq.items() if p in tokens))
                rare.append([{"piece": p, "times": n} for p, n in freq.items() if p not in tokens])
            yield parts, rare

    sized = docs.select(F.col(f"`{key}`").alias("key"), body.alias("text"), F.coalesce(F.octet_length(body), F.lit(0)).cast("long").alias("n_bytes"), F.monotonically_increasing_id().alias("row"))
    summed = written(map_text(sized, ["key", "n_bytes", "row"], "text", "part long, rare array<struct<piece string, times long>>", score, "string"))
    far = summed.select("row", F.inline("rare")).join(vocabulary.filter(~is_common).select("piece", "tokens"), "piece")
    none = F.lit(None)
    alike = summed.select("key", "n_bytes", "row", F.col("part").alias("tokens")).unionByName(far.select(none.cast(summed.schema["key"].dataType).alias("key"), none.cast("long").alias("n_bytes"), "row", (F.col("times") * F.col("tokens")).alias("tokens")))
    made = alike.groupBy("row").agg(F.first("key", ignorenulls=True).alias(key), F.max("n_bytes").alias("n_bytes"), F.sum("tokens").alias("n_tokens"))
    return made.select(key, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
