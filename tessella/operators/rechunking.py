"""Re-chunking of documents by section: text under its headings, title and facts, duplicates left out over all documents.

A chunk's text has its document's facts on the document's first kept chunk only; whether a chunk is kept depends on whether
its text was seen before; so which is first depends on what earlier documents kept. Both texts of every piece are hashed
once; then the first kept piece of each document is found by rounds over a table of hashes and places: each round says who
proposes each text first under the present choice, and documents whose first piece is not the first with its text take
their next one. By induction over documents in order the rounds end with the choice that going through them one by one gives.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators.chunking import Options, chunk_reason, split_recursive
from tessella.storage import materialize

Section = tuple[str, str]


def join_tiny(pieces: list[str], least: int) -> list[str]:
    """Pieces under the least size go to the one before, the first ones to the one after."""
    out: list[str] = []
    ahead = ""
    for piece in pieces:
        piece, ahead = (f"{ahead}\n\n{piece}" if ahead else piece), ""
        if len(piece) >= least or len(pieces) == 1:
            out.append(piece)
        elif out:
            out[-1] += f"\n\n{piece}"
        else:
            ahead = piece
    return [*out, ahead] if ahead else out


def usable_sections(sections: list[dict] | None) -> list[Section]:
    """(heading, content) of sections with content, a missing heading being Overview."""
    found = [((s["heading"] or "").strip() or "Overview", (s["content"] or "").strip()) for s in (sections if sections is not None else [])]
    return [s for s in found if s[1]]


def split_document(title: str | None, text: str | None, sections: list[dict] | None, options: Options, by_section: bool = True) -> list[Section]:
    """(section, text) in order: a section a chunk under its heading, long ones split, tiny ones with their headings before
    the next chunk or after the last. With one section or none, or not by section, the whole text is split, under the title.
    """
    found = usable_sections(sections)
    if not by_section or len(found) < 2:
        whole = (text or "").strip() or "\n\n".join(f"{h}\n\n{c}" for h, c in found)
        return [(title or "", piece) for piece in join_tiny(split_recursive(whole, options.size, options.overlap), options.least)]
    out: list[Section] = []
    waiting: list[str] = []
    for heading, content in found:
        if len(content) < options.least:
            waiting.append(f"{heading}\n\n{content}")
            continue
        pieces = join_tiny(split_recursive(content, options.size, options.overlap), options.least) if len(content) > options.size else [content]
        for piece in pieces:
            out.append((heading, "\n\n".join([*waiting, f"{heading}\n\n{piece}"])))
            waiting = []
    if waiting and out:
        out[-1] = (out[-1][0], "\n\n".join([out[-1][1], *waiting]))
    elif waiting:
        out.append((found[0][0], "\n\n".join(waiting)))
    return out


def _pieces(docs: DataFrame, options: Options, by_section: bool) -> DataFrame:
    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for order, title, text, sections in zip(batch["place"], batch["title"], batch["text"], batch["sections"], strict=True):
                rows = [(order, i, s, t) for i, (s, t) in enumerate(split_document(title, text, sections, options, by_section))]
                yield pd.DataFrame(rows, columns=["place", "pos", "section", "piece"])

    return docs.select("place", "title", "text", "sections").mapInPandas(split, "place long, pos int, section string, piece string")


def _least_place(place: str = "place", pos: str = "pos") -> Column:
    return F.struct(F.col(place).alias("place"), F.col(pos).alias("pos"))


def _proposals(pieces: DataFrame, first: DataFrame) -> DataFrame:
    """Texts that documents propose (place, pos, hash, led): up to their first kept piece under their facts, later without."""
    led = F.col("first_pos").isNull() | (F.col("pos") <= F.col("first_pos"))
    known = pieces.join(first, "place", "left").withColumn("led", led)
    good = F.when(F.col("led"), F.col("first_reason")).otherwise(F.col("rest_reason")).isNull()
    return known.filter(good).select("place", "pos", F.when(F.col("led"), F.col("first_hash")).otherwise(F.col("rest_hash")).alias("hash"), "led")


def first_kept(pieces: DataFrame) -> DataFrame:
    """(place, first_pos) of documents that keep any piece; `pieces` is a stored table of both hashes and both reasons.

    Each round is a grouped minimum by text and a join on it, over hashes and numbers; the driver sees one count. Rounds
    are as many as documents depend on one another in a row, two where they do not.
    """
    able = pieces.filter("first_reason IS NULL").select("place", "pos", "first_hash")
    first = materialize(able.groupBy("place").agg(F.min("pos").alias("first_pos")), "first-pieces")
    while True:
        owner = _proposals(pieces, first).groupBy("hash").agg(F.min(_least_place()).alias("owner"))
        unseen = able.join(owner, F.col("first_hash") == F.col("hash"), "left").filter(F.col("owner").isNull() | (F.col("owner") >= _least_place()))
        after = materialize(unseen.groupBy("place").agg(F.min("pos").alias("first_pos")), "first-pieces")
        both = first.withColumnRenamed("first_pos", "before").join(after, "place", "full")
        if both.filter("NOT before <=> first_pos").isEmpty():
            return after
        first = after


def rechunk(docs: DataFrame, options: Options = Options(), order: str = "id", strategy: str = "section_aware", generation: int = 1, prefix: bool = True) -> tuple[DataFrame, DataFrame]:
    """Chunks of documents (id, title, text, sections, facts, and `order`, a unique number) and the errors beside them.

    Documents go in the order of that number; of equal chunk texts the first stays. Chunks are numbered without gaps within
    their document. Errors are (document_id, reason, char_len): documents without id or without any text, chunks that are
    empty or under the least size under the title they would have, and documents that keep no chunk. strategy is section_aware or
    recursive; without `prefix` texts stand without title and facts. Null titles and facts are empty.
    """
    usable = F.coalesce(F.trim("text"), F.lit("")) != ""
    usable |= F.exists(F.coalesce("sections", F.array().cast("array<struct<heading:string,content:string>>")), lambda s: F.coalesce(F.trim(s["content"]), F.lit("")) != "")
    missing = F.when(F.coalesce(F.trim(F.col("id").cast("string")), F.lit("")) == "", "missing_document_id").when(~usable, "missing_text_and_sections")
    routed = docs.withColumn("place", F.col(order).cast("long")).withColumn("reason", missing)
    good = routed.filter("reason IS NULL")
    facts = F.coalesce("facts", F.create_map().cast("map<string,string>"))
    about = good.select("place", F.col("id").cast("string").alias("document_id"), "title", facts.alias("facts"))
    split = _pieces(good, options, strategy == "section_aware").join(about, "place")

    def text(first: bool) -> Column:
        return T.enriched(F.col("piece"), F.col("title"), F.col("facts"), F.lit(first)) if prefix else F.trim("piece")

    for name, first in (("first", True), ("rest", False)):
        split = split.withColumn(f"{name}_text", text(first))
        split = split.withColumn(f"{name}_reason", chunk_reason(F.col("document_id"), F.col("pos"), F.col(f"{name}_text"), options.least))
        split = split.withColumn(f"{name}_hash", F.sha2(f"{name}_text", 256))
    pieces = materialize(split.drop("facts", "piece"), "pieces")
    light = pieces.select("place", "pos", "first_hash", "rest_hash", "first_reason", "rest_reason")
    first = first_kept(light)
    proposed = _proposals(light, first)
    kept = proposed.groupBy("hash").agg(F.min_by(F.struct("place", "pos", "led"), _least_place()).alias("k")).select("k.*", F.col("hash").alias("content_hash"))
    number = F.row_number().over(Window.partitionBy("place").orderBy("pos")) - 1
    own = F.when(F.col("led"), F.col("first_text")).otherwise(F.col("rest_text"))
    chunks = pieces.join(kept, ["place", "pos"]).withColumn("chunk_number", number).select(
        F.concat_ws("::", "document_id", F.lit(strategy), "chunk_number").alias("id"), "document_id", "chunk_number", "title", "section",
        own.alias("text"), F.lit(strategy).alias("strategy"), "content_hash", F.lit(generation).alias("generation"), F.char_length(own).alias("char_len"),
    )

    led = F.col("first_pos").isNull() | (F.col("pos") <= F.col("first_pos"))
    said = pieces.join(first, "place", "left").select(
        "document_id", F.when(led, F.col("first_reason")).otherwise(F.col("rest_reason")).alias("reason"),
        F.char_length(F.when(led, F.col("first_text")).otherwise(F.col("rest_text"))).alias("char_len"),
    )
    none = F.lit(None).cast("int").alias("char_len")
    unkept = about.join(first, "place", "left_anti").select("document_id", F.lit("document_produced_no_chunks").alias("reason"), none)
    unread = routed.filter("reason IS NOT NULL").select(F.col("id").cast("string").alias("document_id"), "reason", none)
    return chunks, said.filter("reason IS NOT NULL").unionByName(unkept).unionByName(unread)
