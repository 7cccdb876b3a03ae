"""Keywords of codes in texts: one pass of a multi-pattern automaton over each text, however many keywords there are."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.lake import written

#: Bytes of keywords in one automaton, a bound for each task's memory (a node per byte at most). More keywords make more automata, one after the other.
BLOCK_BYTES = 8 << 20


def _matcher(words: list[tuple[str, list[str]]], position: int):
    """A trie with failure links over the words; each text's codes by one walk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for i, (word, _) in enumerate(words):
            automaton.add_word(word, i)
        automaton.make_automaton()
        for batch in batches:
            found = []
            for text in batch.column(position).to_pylist():
                hits = {i for _, i in automaton.iter(text)} if text and words else ()
                found.append(sorted({c for i in hits for c in words[i][1]}))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.string()))], [*batch.schema.names, "codes"])

    return run


def match_codes(texts: DataFrame, keywords: DataFrame, id_col: str, text_col: str, code: str = "code", keyword: str = "keyword") -> DataFrame:
    """id and codes: the sorted codes (as text) of which a keyword stands in the text, letter by letter. ``keywords`` has a row per code and keyword.

    Null and empty texts and keywords match nothing. Each row of ``texts`` gives a row. Keywords are dealt by hash into blocks of about
    ``BLOCK_BYTES``; a keyword's codes come with it.
    """
    words = keywords.where(F.col(keyword) != "").groupBy(F.col(keyword).alias("keyword")).agg(F.sort_array(F.collect_set(F.col(code).cast("string"))).alias("codes"))
    words = written(words.where(F.size("codes") > 0), "keywords")
    size = words.agg(F.coalesce(F.sum(F.octet_length("keyword") + F.size("codes") * 8), F.lit(0)).alias("n")).first().n
    blocks = max(1, -(-size // BLOCK_BYTES))
    kind = texts.schema[id_col].dataType.simpleString()
    src = texts.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    if blocks == 1:
        own = [(r.keyword, r.codes) for r in words.collect()]
        return src.mapInArrow(_matcher(own, 1), f"id {kind}, text string, codes array<string>").select(F.col("id").alias(id_col), "codes")
    # Rows are told apart by a number, as ids may repeat.
    src = written(src.withColumn("row", F.monotonically_increasing_id()), "texts")
    parts = None
    for b in range(blocks):
        own = [(r.keyword, r.codes) for r in words.where(F.pmod(F.xxhash64("keyword"), F.lit(blocks)) == b).collect()]
        got = src.select("row", "text").mapInArrow(_matcher(own, 1), "row long, text string, codes array<string>").select("row", "codes")
        got = written(got.where(F.size("codes") > 0), "matches")
        parts = got if parts is None else parts.unionByName(got)
    merged = parts.groupBy("row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("codes")))).alias("codes"))
    return src.select("row", "id").join(merged, "row", "left").select(F.col("id").alias(id_col), F.coalesce("codes", F.array().cast("array<string>")).alias("codes"))
