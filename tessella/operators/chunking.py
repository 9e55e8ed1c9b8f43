"""Texts to chunks: fixed windows in SQL, packed and section-aware chunks by document in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Separators from coarse to fine.
SEPARATORS = ("\n\n", "\n", ". ", "? ", "! ", " ", "")


@dataclass(frozen=True)
class Options:
    size: int = 1200
    overlap: int = 200
    least: int = 150


def fixed_windows(docs: DataFrame, size: int = 1200) -> DataFrame:
    """(doc_id, chunk_number, text): windows of `size` characters, none overlapping, blank ones left out."""
    starts = F.sequence(F.lit(0), F.greatest(F.char_length("text") - 1, F.lit(0)), F.lit(size))
    each = docs.select("doc_id", "text", F.posexplode(starts).alias("chunk_number", "at"))
    cut = each.select("doc_id", "chunk_number", F.expr(f"substring(text, at + 1, {size})").alias("text"))
    return cut.filter(F.trim("text") != "")


def split_recursive(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most `size` characters, cut at the coarsest separator that does, overlapping by whole parts."""
    if len(text) <= size:
        return [text.strip()] if text.strip() else []
    mark = next((s for s in separators if s and s in text), "")
    finer = separators[separators.index(mark) + 1 :] if mark else ()
    parts = re.split(f"(?<={re.escape(mark)})", text) if mark else [text[i : i + size] for i in range(0, len(text), max(1, size - overlap))]
    out: list[str] = []
    held: list[str] = []
    for part in filter(None, parts):
        if len(part) > size:
            _flush(out, held)
            held = []
            out += split_recursive(part, size, overlap, finer) if mark else [part.strip()]
        else:
            if held and sum(map(len, held)) + len(part) > size:
                _flush(out, held)
                while held and (sum(map(len, held)) > overlap or sum(map(len, held)) + len(part) > size):
                    held.pop(0)
            held.append(part)
    _flush(out, held)
    return out


def _flush(out: list[str], held: list[str]) -> None:
    text = "".join(held).strip()
    if text and (not out or out[-1] != text):
        out.append(text)


def pack_paragraphs(text: str, options: Options, mark: str = "\n") -> list[str]:
    """Paragraphs packed up to the size; the next chunk begins with the end of the last one."""
    chunks: list[str] = []
    current = ""
    for paragraph in filter(None, (p.strip() for p in text.split(mark))):
        for piece in split_recursive(paragraph, options.size, options.overlap):
            joined = f"{current}{mark}{piece}" if current else piece
            if len(joined) <= options.size:
                current = joined
                continue
            chunks.append(current)
            tail = current[-options.overlap :].strip() if options.overlap else ""
            current = f"{tail}{mark}{piece}" if tail and len(tail) + len(piece) < options.size else piece
    if current:
        chunks.append(current)
    return chunks


def split_sections(sections: list[tuple[str, str]], options: Options) -> list[tuple[str, str]]:
    """(heading, text): a section a chunk; one under the least size goes before the next or after the last."""
    out: list[tuple[str, str]] = []
    carried = ""
    for heading, content in sections:
        text = f"{carried}\n\n{content}" if carried else content
        if len(text) < options.least:
            carried = text
            continue
        carried = ""
        out += [(heading, piece) for piece in split_recursive(text, options.size, options.overlap)]
    if carried:
        if out and len(out[-1][1]) + len(carried) + 2 <= options.size:
            out[-1] = (out[-1][0], f"{out[-1][1]}\n\n{carried}")
        else:
            out.append((sections[-1][0], carried))
    return merge_tiny(out, options)


def merge_tiny(chunks: list[tuple[str, str]], options: Options) -> list[tuple[str, str]]:
    """Pieces under the least size joined to the one before where both fit, a first one to the one after."""
    out: list[tuple[str, str]] = []
    for heading, text in chunks:
        tiny = len(text) < options.least or len(out) == 1 and len(out[0][1]) < options.least
        if out and tiny and len(out[-1][1]) + len(text) + 2 <= options.size:
            led = heading if len(out[-1][1]) < options.least else out[-1][0]
            out[-1] = (led, f"{out[-1][1]}\n\n{text}")
        else:
            out.append((heading, text))
    return out


def chunk_reason(document: Column, number: Column, text: Column, least: int) -> Column:
    """The first rule that a chunk breaks, null for none; a null counts as empty."""
    return (
        F.when(F.coalesce(document, F.lit("")) == "", "missing_document_id")
        .when(F.coalesce(number, F.lit(-1)) < 0, "invalid_chunk_number")
        .when(F.coalesce(text, F.lit("")) == "", "empty_text")
        .when(F.char_length(text) < least, "chunk_below_minimum")
    )


def paragraph_chunks(docs: DataFrame, options: Options = Options()) -> DataFrame:
    """(doc_id, chunk_number, text) by packed paragraphs; chunks under the least size are left out, then numbered."""

    def chunk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [[c for c in pack_paragraphs(t or "", options) if len(c) >= options.least] for t in batch["text"]]
            rows = [(d, i, c) for d, chunks in zip(batch["doc_id"], texts, strict=True) for i, c in enumerate(chunks)]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_number", "text"])

    return docs.select("doc_id", "text").mapInPandas(chunk, "doc_id long, chunk_number int, text string")


def section_chunks(docs: DataFrame, options: Options = Options()) -> DataFrame:
    """(id, pos, section, text) of documents with sections (array of heading, content) or else their text."""

    def chunk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text, sections in zip(batch["id"], batch["text"], batch["sections"], strict=True):
                found = [((s["heading"] or "Overview").strip() or "Overview", (s["content"] or "").strip()) for s in (sections if sections is not None else [])]
                found = [s for s in found if s[1]]
                chunks = split_sections(found, options) if len(found) > 1 else [("Overview", c) for c in split_recursive(text or (found[0][1] if found else ""), options.size, options.overlap)]
                rows += [(doc, i, heading, c) for i, (heading, c) in enumerate(chunks)]
            yield pd.DataFrame(rows, columns=["id", "pos", "section", "text"])

    return docs.select("id", "text", "sections").mapInPandas(chunk, "id string, pos int, section string, text string")


def rechunk(docs: DataFrame, options: Options = Options(), strategy: str = "section_aware", generation: int = 1) -> tuple[DataFrame, DataFrame]:
    """Chunks of documents (id, text, sections) and the errors beside them.

    Of equal texts the first by document and place stays; what stays is numbered without gaps.
    """
    usable = F.coalesce(F.trim("text"), F.lit("")) != ""
    usable |= F.exists(F.coalesce("sections", F.array().cast("array<struct<heading:string,content:string>>")), lambda s: F.coalesce(F.trim(s["content"]), F.lit("")) != "")
    reason = F.when(F.coalesce("id", F.lit("")) == "", "missing_document_id").when(~usable, "missing_text_and_sections")
    routed = docs.withColumn("reason", reason)
    chunks = section_chunks(routed.filter("reason IS NULL"), options).withColumn("content_hash", F.sha2("text", 256))
    first = chunks.groupBy("content_hash").agg(F.min_by(F.struct("id", "pos", "section", "text"), F.struct("id", "pos")).alias("c"))
    kept = first.select("c.*", "content_hash")
    number = F.row_number().over(Window.partitionBy("id").orderBy("pos")) - 1
    rows = kept.withColumn("chunk_number", number).select(
        F.concat_ws("::", "id", F.lit(strategy), F.col("chunk_number")).alias("id"), F.col("id").alias("document_id"), "chunk_number", "section", "text",
        F.lit(strategy).alias("strategy"), "content_hash", F.lit(generation).alias("generation"), F.char_length("text").alias("char_len"),
    )
    return rows, routed.filter("reason IS NOT NULL").select("id", "reason")


def length_spread(chunks: DataFrame) -> DataFrame:
    n = F.char_length("text")
    return chunks.agg(F.count("*").alias("n"), F.min(n).cast("long").alias("least"), F.median(n).alias("middle"), F.max(n).cast("long").alias("most"))
