"""Problem 6: encoding the whole corpus with a public tokenizer.

Words are split in Spark by the tokenizer's own pattern and counted; each distinct word is
encoded once, into a table. The frequent words of that table, up to a bound in bytes, go to
every task as a dictionary; the occurrences of all other words are joined to the table by
word and come back by position. Ids are turned into text again by a join with the vocabulary.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators.skew import lookup_join
from brindle.sources.shared import ship_code, work_dir

TOKENIZERS = "/opt/tokenizers"
BYTE_BPE = "byte_bpe_50k.tiktoken"
_WS = r"\p{IsWhite_Space}"
#: The published splitting pattern of the byte-level vocabulary, with Unicode white space.
PATTERN = rf"'(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|{_WS}+(?!\P{{IsWhite_Space}})|{_WS}+"
#: The dictionary that every task holds: so many bytes of words and ids at most ...
DICTIONARY_BYTES = 24 << 20
#: ... and no word longer than this; longer ones take the join.
DICTIONARY_WORD = 256


def read_ranks(path: str = f"{TOKENIZERS}/{BYTE_BPE}") -> dict[bytes, int]:
    """Piece to id, from a file with a base64 piece and its id a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(p): int(i) for p, i in (line.split() for line in f if line.strip())}


def split_words(text: F.Column) -> F.Column:
    """The words of a text in order; their concatenation is the text. Empty for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PATTERN), F.lit(0))


def _encoder(ranks: dict[bytes, int]):
    import tiktoken

    return tiktoken.Encoding("brindle", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})


class WordTable:
    """Each distinct word of a corpus with its ids: ``word, n, ids``, in the shared folder."""

    def __init__(self, documents: DataFrame, text: str, ranks: dict[bytes, int], dictionary_bytes: int = DICTIONARY_BYTES):
        spark = documents.sparkSession
        ship_code(spark)
        counts = documents.select(F.explode(split_words(F.col(text))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
        shared = spark.sparkContext.broadcast(ranks)

        def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            one = _encoder(shared.value)
            for b in batches:
                yield b.assign(ids=[one.encode_ordinary(w) for w in b["word"]])

        self.path = work_dir(spark, "words")
        counts.mapInPandas(encode, "word string, n bigint, ids array<int>").write.parquet(self.path)
        self.table = spark.read.parquet(self.path)
        cost = F.octet_length("word") + 4 * F.size("ids") + 16
        fits = self.table.where(F.octet_length("word") <= DICTIONARY_WORD)
        # The least count whose words still fit, from a histogram of counts by powers of 1.1:
        # at most a few hundred rows, whatever the corpus.
        level = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.1))).cast("int")
        levels = fits.groupBy(level.alias("level")).agg(F.sum(cost).alias("bytes")).collect()
        total, self.level = 0, None
        for r in sorted(levels, key=lambda r: -r["level"]):
            if total + r["bytes"] > dictionary_bytes:
                break
            total, self.level = total + r["bytes"], r["level"]
        known = fits.where(level >= self.level) if self.level is not None else fits.limit(0)
        self.frequent = known.select("word", "ids")
        self.dictionary = self.frequent.toArrow().combine_chunks()
        self.complete = self.table.count() == self.dictionary.num_rows


def _rare_words(documents: DataFrame, text: str, words: WordTable) -> DataFrame:
    """``__key, rare``: of each distinct text the (position, ids) of words not in the dictionary."""
    texts = documents.select(F.sha2(text, 256).alias("__key"), F.col(text).alias("text")).where(F.col("text").isNotNull()).dropDuplicates(["__key"])
    places = texts.select("__key", F.posexplode(split_words(F.col("text"))).alias("pos", "word"))
    # bounded by dictionary_bytes
    rare = places.join(F.broadcast(words.frequent.select("word")), "word", "left_anti")
    rest = words.table.join(F.broadcast(words.frequent.select("word")), "word", "left_anti").select("word", "ids")
    return lookup_join(rare, rest, ["word"], "inner", max_rows=0).groupBy("__key").agg(F.sort_array(F.collect_list(F.struct("pos", "ids"))).alias("rare"))


def encode(documents: DataFrame, id: str = "doc_id", text: str = "text", ranks: dict[bytes, int] | None = None, dictionary_bytes: int = DICTIONARY_BYTES, count_only: bool = False, keep: list[str] | None = None) -> DataFrame:
    """``id, [keep...], ids`` (or ``n_tokens``) of each document, without special tokens.

    Special tokens' strings in a text are ordinary text. Null and empty texts have no ids: an
    empty list. Repeated rows give repeated rows. The dictionary holds frequent words up to
    ``dictionary_bytes``; where it holds all words, documents are not shuffled at all. Other
    columns are ignored unless in ``keep``.
    """
    spark: SparkSession = documents.sparkSession
    ranks, keep = ranks or read_ranks(), keep or []
    words = WordTable(documents, text, ranks, dictionary_bytes)
    shared = spark.sparkContext.broadcast(words.dictionary)
    rows = documents.select(F.col(id), *keep, F.col(text).alias("__text"))
    if words.complete:
        rows = rows.withColumn("__rare", F.lit(None).cast("array<struct<pos:int,ids:array<int>>>"))
    else:
        rows = lookup_join(rows.withColumn("__key", F.sha2("__text", 256)), _rare_words(documents, text, words), ["__key"], max_rows=0).withColumnRenamed("rare", "__rare")
    rows = rows.select(F.col(id), *keep, split_words(F.col("__text")).alias("__words"), "__rare")

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        known_words, lists = known["word"].combine_chunks(), known["ids"].combine_chunks()
        if isinstance(known_words, pa.ChunkedArray):
            known_words = known_words.chunk(0) if known_words.num_chunks else pa.array([], pa.string())
        if isinstance(lists, pa.ChunkedArray):
            lists = lists.chunk(0) if lists.num_chunks else pa.array([], pa.list_(pa.int32()))
        # One more entry, empty, for words that are not in the dictionary.
        lists = pa.concat_arrays([lists.cast(pa.list_(pa.int32())), pa.array([[]], pa.list_(pa.int32()))])
        nothing = len(lists) - 1
        for b in batches:
            column = b.column(b.schema.get_field_index("__words"))
            flat, starts = column.flatten(), column.offsets
            starts = pc.subtract(starts, starts[0])
            at = pc.fill_null(pc.index_in(flat.cast(known_words.type), value_set=known_words), nothing)
            found = lists.take(at)
            rare = b.column(b.schema.get_field_index("__rare"))
            if rare.null_count < len(rare):
                found = _fill(found, rare, starts)
            bounds = found.offsets.take(starts)
            values = found.values
            head = [b.column(b.schema.get_field_index(c)) for c in (id, *keep)]
            if count_only:
                last = pc.subtract(bounds[1:], bounds[:-1])
                yield pa.RecordBatch.from_arrays([*head, last.cast(pa.int64())], [id, *keep, "n_tokens"])
            else:
                yield pa.RecordBatch.from_arrays([*head, pa.ListArray.from_arrays(bounds, values)], [id, *keep, "ids"])

    kinds = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in (id, *keep))
    return rows.mapInArrow(resolve, f"{kinds}, " + ("n_tokens bigint" if count_only else "ids array<int>"))


def _fill(found: pa.ListArray, rare: pa.ListArray, starts: pa.Array) -> pa.ListArray:
    """Puts the ids of words outside the dictionary at their places."""
    places = rare.flatten()
    where = pc.add(starts.take(pc.list_parent_indices(rare)), places.field("pos")).to_numpy(zero_copy_only=False)
    pick = np.arange(len(found))
    pick[where] = len(found) + np.arange(len(places))
    return pa.concat_arrays([found, places.field("ids").cast(found.type)]).take(pa.array(pick))


def decode(encoded: DataFrame, id: str = "doc_id", ids: str = "ids", ranks: dict[bytes, int] | None = None, keep: list[str] | None = None, as_name: str = "text") -> DataFrame:
    """``id, [keep...], text``: ids joined with their pieces.

    The piece table has one row an id of the vocabulary and goes to every task; a batch's ids
    are joined to it all at once, by id, and each row's pieces are concatenated in place. So
    nothing is shuffled and rows with equal ``id`` are not mixed. Bytes that are no UTF-8
    become replacement characters. No ids (or null) give an empty text; an id that is not in
    the vocabulary gives nothing.
    """
    keep = keep or []
    ship_code(encoded.sparkSession)
    shared = encoded.sparkSession.sparkContext.broadcast(ranks or read_ranks())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = max(shared.value.values(), default=-1) + 1
        pieces: list[bytes] = [b""] * (last + 1)  # the last one is for ids that are unknown
        for piece, at in shared.value.items():
            pieces[at] = piece
        table = pa.array(pieces, pa.binary())
        for b in batches:
            lists = b.column(b.schema.get_field_index(ids))
            flat = pc.fill_null(lists.values, last)
            known = pc.and_(pc.greater_equal(flat, 0), pc.less(flat, last))
            joined = pa.ListArray.from_arrays(lists.offsets, table.take(pc.if_else(known, flat, last)), mask=lists.is_null() if lists.null_count else None)
            raw = pc.fill_null(pc.binary_join(joined, b""), b"")
            try:
                text = raw.cast(pa.string())
            except pa.ArrowInvalid:
                text = pa.array([v.decode("utf-8", "replace") for v in raw.to_pylist()], pa.string())
            head = [b.column(b.schema.get_field_index(c)) for c in (id, *keep)]
            yield pa.RecordBatch.from_arrays([*head, text], [id, *keep, as_name])

    kinds = ", ".join(f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in (id, *keep))
    return encoded.select(id, *keep, ids).mapInArrow(run, f"{kinds}, `{as_name}` string")
