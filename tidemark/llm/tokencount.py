"""Token counts: pieces once for each distinct pre-token, frequencies for each document.

The tokenizer is a byte-pair model over sentencepiece text whose pieces hold the blank mark only in
front, so no merge crosses from another character to a blank; nor does one reach a character that
occurs in no merged piece, such as a newline. Cutting there gives pre-tokens that are encoded
independently, and a text's count is the sum over its pre-tokens.

The pre-tokens of all texts are counted, and each distinct one is encoded once. The most frequent
ones, a fixed number, go to every task; the others are joined by a shuffle, so that frequent words
never meet in one task.
"""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, narrow_batches

#: Distinct pre-tokens that every task holds, at most: about 50 MB.
HEAD = 400_000
#: Distinct pre-tokens that a task gathers before it sends counts on.
GATHER = 300_000

_loaded: dict[str, tuple] = {}


def model(path: str):
    """The processor at path and the pattern of its pre-tokens, loaded once in a process."""
    if path not in _loaded:
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [processor.id_to_piece(i) for i in range(processor.get_piece_size()) if not (processor.is_control(i) or processor.is_unknown(i) or processor.is_byte(i))]
        if any("▁" in p.lstrip("▁") for p in pieces) or processor.normalize(" a  b\n", ) != "▁▁a▁▁b\n":
            raise ValueError("the model's pieces don't end at blanks, or it rewrites texts")
        lone = "" if any("\n" in p for p in pieces) else "\n"
        # The blank mark itself is taken for a blank. Runs of lone characters are pre-tokens, counted one by one.
        pattern = re.compile(f"[{lone}]+|[ ▁]*[^ ▁{lone}]+|[ ▁]+" if lone else "[ ▁]*[^ ▁]+|[ ▁]+")
        _loaded[path] = processor, pattern
    return _loaded[path]


def pretokens(text: str, pattern: re.Pattern) -> list[str]:
    """Parts of the text with its leading blank; no merge crosses their bounds."""
    return pattern.findall(" " + text) if text else []


def count_pieces(words: list[str], path: str) -> list[int]:
    """Pieces of each pre-token. The model sets a blank before what it reads, so one is taken off, or a guard's piece subtracted."""
    processor, _ = model(path)
    lead = [w[:1] in " ▁" for w in words]
    encoded = processor.encode([w[1:] if a and len(w) > 1 else "\n" + w if not a else w for a, w in zip(lead, words, strict=True)])
    guard = len(processor.encode("\n"))
    return [1 if w in (" ", "▁") else len(ids) if a else len(ids) - guard for a, w, ids in zip(lead, words, encoded, strict=True)]


def _vocabulary(path: str):
    def gather(batches):
        _, pattern = model(path)
        counts: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in batch.column(0):
                counts.update(pretokens(text.as_py() or "", pattern))
                if len(counts) > GATHER:
                    yield out()
                    counts.clear()
        yield out()

    return gather


def _counted(path: str, head):
    def count(batches):
        _, pattern = model(path)
        pieces = head.value
        for batch in batches:
            sizes, sums, rest = [], [], []
            for text in batch.column("text"):
                text = text.as_py() or ""
                sizes.append(len(text.encode()))
                total, words = 0, {}
                for w in pretokens(text, pattern):
                    n = pieces.get(w)
                    if n is None:
                        words[w] = words.get(w, 0) + 1
                    else:
                        total += n
                sums.append(total)
                rest.append(list(words.items()))
            kind = pa.map_(pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()), pa.array(rest, kind)], names=["doc_id", "n_bytes", "head_tokens", "rest"]
            )

    return count


def token_counts(docs: DataFrame, path: str, limit: int = 4096, head: int = HEAD) -> DataFrame:
    """n_bytes, n_tokens and over_limit (n_tokens > limit) for each row of docs(doc_id, text).

    As the sentencepiece model at path encodes the whole text, without begin or end marks. A null
    text counts as empty and has no tokens. Texts are read whole, however long. Rows that repeat are counted each. An
    empty table gives an empty result. Other columns are ignored, whatever their names. path must exist on every executor.
    """
    narrow_batches(docs)
    spark = docs.sparkSession
    words = docs.select("text").mapInArrow(_vocabulary(path), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    count = F.pandas_udf(lambda s: pd.Series(count_pieces(s.tolist(), path), dtype="int64"), "long")
    vocabulary = cut(words.withColumn("pieces", count("word")))
    # Frequencies by eighths of a power of two: how many of the most frequent words fit.
    grade = F.floor(F.log2("n") * 8).cast("int")
    fitting, least = 0, None
    for r in vocabulary.groupBy(grade.alias("grade")).agg(F.count("*").alias("words")).orderBy(F.desc("grade")).collect():
        if fitting + r["words"] > head:
            break
        fitting, least = fitting + r["words"], r["grade"]
    top = vocabulary.where(grade >= F.lit(least) if least is not None else F.lit(False)).select("word", "pieces").toPandas()  # at most head rows
    shared = spark.sparkContext.broadcast(dict(zip(top["word"], top["pieces"].tolist(), strict=True)))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").mapInArrow(_counted(path, shared), f"doc_id {kind}, n_bytes long, head_tokens long, rest map<string,long>")
    rows = rows.withColumn("row_id", F.monotonically_increasing_id())
    rows = rows.select("row_id", "doc_id", "n_bytes", "head_tokens", F.explode_outer("rest").alias("word", "times"))
    # A text without rare words keeps one row; its word is made unlike all others, so that these rows spread.
    rows = rows.withColumn("word", F.coalesce("word", F.concat(F.lit("\n\n "), F.col("row_id").cast("string"))))
    return (
        rows.join(vocabulary.select("word", "pieces"), "word", "left")
        .groupBy("row_id", "doc_id", "n_bytes", "head_tokens")
        .agg(F.coalesce(F.sum(F.col("times") * F.col("pieces")), F.lit(0)).alias("rest_tokens"))
        .withColumn("n_tokens", F.col("head_tokens") + F.col("rest_tokens"))
        .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )
