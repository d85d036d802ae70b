"""Encoding of a corpus with a public byte-level BPE tokenizer (problem 8): global distinct words.

Texts are split into pre-tokens with positions on the JVM; every distinct pre-token is encoded once,
its ids are joined back, and each text is put together by position. Frequent words are few and
would skew the join, so those above a share of the corpus are joined by broadcast: there can be no
more of them than the inverse of the share.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaryn.runtime import scratch_path, written

TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
BYTE_BPE = "byte_bpe_50k.json"
#: A word is hot if it makes up more than this share of all pre-tokens; so at most 1 / share words are broadcast, a few MB.
HOT_SHARE = 1 / 40_000
# The pre-token pattern of the byte-level vocabulary; letters, numbers and spaces as in Unicode.
_S = r"[\u0009-\u000D\u0020\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
_NOT_S = _S.replace("[", "[^", 1)
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S[1:-1]}\p{{L}}\p{{N}}]+|{_S}+(?!{_NOT_S})|{_S}+"


def pre_tokens(text: Column) -> Column:
    """The pre-tokens of a text in order; together they are the text. Empty for empty and null texts."""
    return F.when(text.isNull(), F.array().cast("array<string>")).otherwise(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)))


def _encoder(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def encode_words(words: DataFrame, path: str) -> DataFrame:
    """``words`` (column ``word``, other columns kept) with the token ``ids`` of each word."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = _encoder(path)
        for pdf in batches:
            yield pdf.assign(ids=[e.ids for e in t.encode_batch(pdf["word"].tolist(), add_special_tokens=False)])

    kinds = ", ".join(f"`{c}` {k}" for c, k in words.dtypes)
    return words.mapInPandas(encode, f"{kinds}, ids array<int>")


class WordTable:
    """Distinct words and their ids in the shared folder; a word is encoded once over all corpora."""

    def __init__(self, spark: SparkSession, tokenizer: str = BYTE_BPE, directory: str = TOKENIZERS, path: str | None = None):
        self.spark, self.tokenizer = spark, f"{directory}/{tokenizer}"
        self.path, self.begun = path or scratch_path(spark, "words"), path is not None

    def read(self) -> DataFrame:
        return self.spark.read.schema("word string, n bigint, ids array<int>").parquet(self.path)

    def update(self, counts: DataFrame) -> WordTable:
        """Encode and append the words of ``counts`` (``word``, ``n``) that are new."""
        if self.begun:
            counts = counts.join(self.read().select("word"), "word", "left_anti")
        encode_words(counts.select("word", "n"), self.tokenizer).write.mode("append").parquet(self.path)
        self.begun = True
        return self


def _split(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``_row`` (of its own for each row), id and ``_words`` of every text, written to the shared folder."""
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col), pre_tokens(F.col(text_col).cast("string")).alias("_words"))
    return written(rows, "pre_tokens")


def _word_tables(rows: DataFrame, tokenizer: str, directory: str) -> tuple[DataFrame, DataFrame]:
    """(hot, rare): ``word``, ``ids`` of the distinct words of ``_split`` rows. Words are counted before the shuffle, then each is encoded once."""
    counts = written(rows.select(F.explode("_words").alias("word")).groupBy("word").agg(F.count("*").alias("n")), "word_counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    table = WordTable(rows.sparkSession, tokenizer, directory).update(counts).read()
    return table.where(F.col("n") > total * HOT_SHARE).select("word", "ids"), table.where(F.col("n") <= total * HOT_SHARE).select("word", "ids")  # hot: at most 1 / HOT_SHARE rows


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = BYTE_BPE, directory: str = TOKENIZERS) -> DataFrame:
    """``id_col``, ``ids``: the token ids of every text, without special tokens.

    Null and empty texts give an empty list; text that looks like a special token is ordinary text;
    rows with equal ids of texts are kept apart by a row number of their own. One row of output is one
    text, so a text must fit a task; nothing else grows with the data in one place.
    """
    rows = _split(docs, id_col, text_col)
    hot, rare = _word_tables(rows, tokenizer, directory)
    parts = rows.select("_row", F.posexplode("_words").alias("pos", "word"))
    common = parts.join(F.broadcast(hot), "word").select("_row", "pos", "ids")
    others = parts.join(F.broadcast(hot.select("word")), "word", "left_anti").join(rare, "word").select("_row", "pos", "ids")
    placed = common.union(others)
    whole = placed.groupBy("_row").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ids"))), lambda x: x["ids"])).alias("ids"))
    return rows.select("_row", id_col).join(whole, "_row", "left").select(id_col, F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))


def token_bytes(spark: SparkSession, tokenizer: str = BYTE_BPE, directory: str = TOKENIZERS) -> DataFrame:
    """``id``, ``hex`` of each vocabulary entry (50 257 rows: fixed by the vocabulary)."""
    t = _encoder(f"{directory}/{tokenizer}")
    chars, n = {}, 0
    for b in range(256):
        if b in range(33, 127) or b in range(161, 173) or b in range(174, 256):
            chars[chr(b)] = b
        else:
            chars[chr(256 + n)] = b
            n += 1
    added = {i: a.content for i, a in t.get_added_tokens_decoder().items()}
    rows = [(i, (added[i].encode() if i in added else bytes(chars[c] for c in w)).hex()) for w, i in t.get_vocab().items()]
    return spark.createDataFrame(rows, "id int, hex string")


def decoded(encoded_docs: DataFrame, tokenizer: str = BYTE_BPE, directory: str = TOKENIZERS, id_col: str = "doc_id") -> DataFrame:
    """``id_col``, ``text`` back from ``ids`` by joining the token-byte table; an empty list gives an empty text."""
    table = token_bytes(encoded_docs.sparkSession, tokenizer, directory)
    parts = encoded_docs.select(id_col, F.posexplode("ids").alias("pos", "id")).join(F.broadcast(table), "id")
    whole = parts.groupBy(id_col).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "hex"))), lambda x: x["hex"]), "").alias("_hex"))
    return encoded_docs.select(id_col).join(whole, id_col, "left").select(id_col, F.coalesce(F.decode(F.unhex("_hex"), "UTF-8"), F.lit("")).alias("text"))


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = BYTE_BPE, directory: str = TOKENIZERS, keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, the columns ``keep`` and ``tokens`` of every row: its size, summed from the lengths of distinct words without
    putting texts together. Hot words are summed where they stand; only rare ones are shuffled."""
    docs = docs.select(F.struct(id_col, *keep).alias("_id"), F.col(text_col).alias("_text"))
    rows = _split(docs, "_id", "_text")
    hot, rare = _word_tables(rows, tokenizer, directory)
    parts = rows.select("_row", F.explode("_words").alias("word")).join(F.broadcast(hot.select("word", F.size("ids").alias("len"))), "word", "left")
    common = parts.where("len IS NOT NULL").groupBy("_row").agg(F.sum("len").alias("t"))
    others = parts.where("len IS NULL").select("_row", "word").join(rare.select("word", F.size("ids").alias("len")), "word").groupBy("_row").agg(F.sum("len").alias("t"))
    sums = common.union(others).groupBy("_row").agg(F.sum("t").alias("tokens"))
    return rows.select("_row", "_id").join(sums, "_row", "left").select("_id.*", F.coalesce("tokens", F.lit(0)).alias("tokens"))
