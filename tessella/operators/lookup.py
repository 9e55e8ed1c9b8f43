"""Titles and aliases to records: exact, by alias, and fuzzy with an ambiguity margin."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

from tessella.functions import text as T
from tessella.functions.text import fold_title, normalize, plain_words
from tessella.operators.index import bounded
from tessella.storage import materialize

LEAST_SCORE, MARGIN = 86.0, 3.0
# What a question may call a film without naming one.
GENERIC_TITLES = ("a", "a film", "a movie", "an", "film", "films", "movie", "movies", "the", "the film", "the movie")


def is_generic(title: Column) -> Column:
    """Whether a title says no more than that it is a film; such queries are not looked up."""
    return normalize(title).isin(*GENERIC_TITLES)


def confident_title(title: Column, year: Column, article: Column) -> Column:
    """Whether an article's title holds the record's title and its year or the word film; false where one is null."""
    page = plain_words(article)
    dated = F.coalesce(F.contains(page, year.cast("string")), F.lit(False)) | F.contains(page, F.lit("film"))
    return F.coalesce(F.contains(page, plain_words(title)) & dated, F.lit(False))


def with_articles(catalog: DataFrame, articles: DataFrame, key: str, title: str, year: str, article: str) -> DataFrame:
    """Every record with its article by `key`; the article's columns are null where its title is not a confident match."""
    found = catalog.join(articles, key, "left")
    sure = confident_title(F.col(title), F.col(year), F.col(article))
    return found.select(*catalog.columns, *(F.when(sure, F.col(c)).alias(c) for c in articles.columns if c != key))


def exact_titles(queries: DataFrame, catalog: DataFrame, title: str) -> DataFrame:
    """Queries (query_id, query) with every record of that title, accents and marks aside, and `matches`, how many there
    are: more than one make it ambiguous. Titles without a letter or digit match nothing.
    """
    records = catalog.withColumn("_t", fold_title(F.col(title))).filter("_t <> ''")
    found = queries.withColumn("_t", fold_title(F.col("query"))).join(records, "_t")
    n = F.count("*").over(Window.partitionBy("query_id"))
    return found.withColumn("matches", n).drop("_t")


def alias_targets(aliases: DataFrame, catalog: DataFrame, title: str) -> DataFrame:
    """Aliases (alias, target) with the records that their target names, accents and marks aside."""
    named = catalog.withColumn("_t", fold_title(F.col(title))).filter("_t <> ''")
    return aliases.withColumn("_t", fold_title(F.col("target"))).join(named, "_t").drop("_t")


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel columns."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    row = (1 << len(a)) - 1
    for c in b:
        hit = row & masks.get(c, 0)
        row = (row + hit | row - hit) & ((1 << len(a)) - 1)
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    return 200.0 * _common(a, b) / (len(a) + len(b)) if a or b else 100.0


def _tokens_ratio(a: str, b: str) -> float:
    """The best of sorted tokens and of the shared tokens against each side."""
    x, y = set(a.split()), set(b.split())
    shared, left, right = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    both = [f"{shared} {left}".strip(), f"{shared} {right}".strip()]
    pairs = [(" ".join(sorted(a.split())), " ".join(sorted(b.split()))), tuple(both)]
    pairs += [(shared, both[0]), (shared, both[1])] if shared else []
    return max(ratio(p, q) for p, q in pairs)


def _partial(a: str, b: str) -> float:
    """The best ratio of the shorter string against windows of the longer one that its matching blocks point to."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 0.0
    starts = {max(0, m.b - m.a) for m in SequenceMatcher(None, short, long, autojunk=False).get_matching_blocks()}
    return max(ratio(short, long[i : i + len(short)]) for i in starts)


def weighted_ratio(a: str, b: str) -> float:
    """Similarity 0..100: whole strings where lengths are close, else parts of the longer one at a discount."""
    if not a or not b:
        return 0.0
    gap = max(len(a), len(b)) / min(len(a), len(b))
    if gap < 1.5:
        return max(ratio(a, b), 0.95 * _tokens_ratio(a, b))
    scale = 0.6 if gap > 8 else 0.9
    return max(ratio(a, b), scale * _partial(a, b), 0.95 * scale * _tokens_ratio(a, b))


@F.pandas_udf(ArrayType(StringType()))
def _forms(texts: pd.Series) -> pd.Series:
    """A text as it is, its tokens, and its distinct tokens: what scores compare, up to the order of tokens."""
    return texts.map(lambda t: [] if not t else sorted({t, " ".join(t.split()), " ".join(sorted(set(t.split())))}))


def _candidates(left: DataFrame, right: DataFrame, key: str, floor: float) -> DataFrame:
    """(query_id, query, key, title) of all pairs whose weighted ratio can reach `floor` (of 1).

    Shared tokens go by token. Without one, a score needs a ratio of `floor` between padded forms, or of floor / 0.9
    between the shorter text and a window: both bound how many bigrams of the shorter one (s characters, s + 1 padded
    bigrams) the other can lack, whatever the tokens' order. So among one more of its rarest bigrams the other has one.
    Where the bound exceeds s + 1, the texts share a letter, and the longer is at most 8 times as long.
    """
    part = min(1.0, floor / 0.9)
    lost = 4 * (1 - part) / (2 - part)
    short = int(1 / (1 - lost) + 1e-9)
    size = F.char_length("form")
    padded = F.concat(F.lit(" "), F.col("form"), F.lit(" "))
    grams = F.transform(F.sequence(F.lit(1), size + 1), lambda i: padded.substr(i, F.lit(2)))
    letters = lambda most: F.when(size <= most, F.split("form", "")).otherwise(F.array().cast("array<string>"))
    missing = F.greatest(3 * (1 - floor) * size, 2 + lost * size)
    reach = (F.floor(missing + 1e-9) + 1).cast("int")

    sides = [df.distinct().withColumn("form", F.explode(_forms(normalize(F.col(text))))) for df, text in ((left, "query"), (right, "title"))]
    counts = sides[1].select(F.explode(grams).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))

    def blocks(rows: DataFrame, columns: list[str], rare: str, full: str, few: str, many: str) -> DataFrame:
        tag = lambda name, values: F.transform(values, lambda v: F.concat(F.lit(name), v))
        own = F.concat(tag("t", F.split("form", " ")), tag(full, grams), tag(few, letters(short)), tag(many, letters(8 * short)))
        found = rows.select(*columns, F.explode(own).alias("block"))
        each = rows.select(*columns, "form", reach.alias("reach"), F.explode(grams).alias("gram")).join(counts, "gram", "left")
        ordered = F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")))["gram"]
        rarest = each.groupBy(*columns, "form", "reach").agg(ordered.alias("ordered"))
        return found.unionByName(rarest.select(*columns, F.explode(tag(rare, F.slice("ordered", F.lit(1), F.col("reach")))).alias("block"))).distinct()

    asked = blocks(sides[0], ["query_id", "query"], "a", "b", "c", "d")
    named = blocks(sides[1], [key, "title"], "b", "a", "d", "c")
    return asked.join(named, "block").select("query_id", "query", key, "title").distinct()


def fuzzy_titles(queries: DataFrame, catalog: DataFrame, key: str, title: str, least: float = LEAST_SCORE, margin: float = MARGIN) -> DataFrame:
    """(query_id, key, score): the best record, if it scores enough and leads the second one by the margin.

    Candidates are all pairs that can score over least - margin (see `_candidates`); up to two thirds nothing bounds them,
    and every pair is scored.
    """
    floor = (least - margin) / 100
    left = queries.select("query_id", "query")
    right = catalog.select(key, F.col(title).alias("title"))
    pairs = _candidates(left, right, key, floor) if floor > 2 / 3 else left.crossJoin(right).distinct()

    @F.pandas_udf("double")
    def scored(q: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([weighted_ratio(x, y) for x, y in zip(q, t, strict=True)], index=q.index, dtype="float64")

    scores = pairs.select("query_id", key, scored(normalize(F.col("query")), normalize(F.col("title"))).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    top = scores.withColumn("second", F.lead("score").over(order)).withColumn("_n", F.row_number().over(order)).filter("_n = 1")
    clear = (F.col("score") >= least) & (F.col("second").isNull() | (F.col("score") - F.col("second") >= margin))
    return top.filter(clear).select("query_id", key, "score")


# Kinds of forms in the order in which they are preferred among equal scores.
FORM_KINDS = ("title", "original_title", "aka", "configured_alias")


def title_forms(records: DataFrame, key: str, title: str, original: str | None = None, akas: str | None = None, aliases: DataFrame | None = None) -> DataFrame:
    """(key, form, kind, folded): every name a record goes by, distinct by what is left of it without accents and marks.

    `akas` is an array column; `aliases` (alias, target) name records by their title, or by their key as text. Of forms of a
    record that fold to the same, the first kind stays. Blank names, and aliases whose target is no record, give none.
    """
    given = [(F.col(title), "title")] + ([(F.col(original), "original_title")] if original else [])
    named = [F.array(F.struct(c.alias("form"), F.lit(kind).alias("kind"))) for c, kind in given]
    if akas:
        named.append(F.transform(F.coalesce(akas, F.array().cast("array<string>")), lambda a: F.struct(a.alias("form"), F.lit("aka").alias("kind"))))
    forms = records.select(key, F.explode(F.concat(*named)).alias("f")).select(key, F.btrim("f.form").alias("form"), "f.kind")
    if aliases is not None:
        target = F.struct(fold_title(F.col("target")).alias("by_title"), F.btrim("target").alias("by_key"))
        wanted = aliases.select("alias", target.alias("target"))
        titles = records.select(key, fold_title(F.col(title)).alias("t")).filter("t <> ''")
        # of records of one title the last one stands for it, as in a table by title
        last = titles.groupBy("t").agg(F.max(key).alias(key))
        by_title = wanted.join(last, F.col("target.by_title") == F.col("t")).select(key, "alias")
        unnamed = wanted.join(last, F.col("target.by_title") == F.col("t"), "left_anti")
        by_key = unnamed.join(records.select(key), F.col("target.by_key") == F.col(key).cast("string")).select(key, "alias")
        forms = forms.unionByName(by_title.unionByName(by_key).select(key, F.btrim("alias").alias("form"), F.lit("configured_alias").alias("kind")))
    forms = forms.filter("form <> ''").withColumn("folded", fold_title(F.col("form"))).filter("folded <> ''")
    order = F.struct(F.array_position(F.array(*map(F.lit, FORM_KINDS)), F.col("kind")), "form")
    return forms.groupBy(key, "folded").agg(F.min_by(F.struct("form", "kind"), order).alias("f")).select(key, "f.form", "f.kind", "folded")


@F.pandas_udf(DoubleType())
def _weighted(q: pd.Series, t: pd.Series) -> pd.Series:
    return pd.Series([weighted_ratio(x, y) for x, y in zip(q, t, strict=True)], index=q.index, dtype="float64")


def resolve_titles(
    queries: DataFrame, records: DataFrame, forms: DataFrame, key: str, title: str, year: str, votes: str, least: float = LEAST_SCORE, margin: float = MARGIN
) -> DataFrame:
    """(query_id, key, candidate, matched, canonical, score, match_type): the one record that each query names.

    Queries have query_id, query (the title as cut out of a question) and, optionally, year, else the one in the query, which
    leaves records of that year only, and exact_only, which asks for a whole match. A record scores by the best of its forms; the first by score, votes and title is
    taken where it scores `least` and leads the second record by `margin`. match_type is the kind of the matched form, or exact
    where that is the candidate itself and no configured alias. Titles that say no more than film, and queries without a
    clear record, have no row. Only pairs that can reach least - margin are scored (`_candidates`).
    """
    floor = (least - margin) / 100
    if floor <= 2 / 3:
        raise ValueError("scores under 67 bound no candidates")
    extra = {"year": T.year_in(F.col("query")), "exact_only": F.lit(False)}
    asked = queries.select("query_id", "query", *(F.col(c).alias(f"asked_{c}") if c in queries.columns else v.alias(f"asked_{c}") for c, v in extra.items()))
    asked = asked.withColumn("candidate", T.title_candidate(F.col("query"))).withColumn("folded_query", fold_title(F.col("candidate")))
    asked = materialize(asked.filter(~is_generic(F.col("folded_query")) & (F.col("folded_query") != "")), "asked-titles")
    stored = materialize(forms, "title-forms")
    pairs = _candidates(asked.select(F.col("query_id"), F.col("folded_query").alias("query")), stored.select(key, F.col("folded").alias("title")), key, floor)
    scored = pairs.withColumn("score", _weighted(F.col("query"), F.col("title"))).filter(F.col("score") >= least - margin)
    kinds = stored.select(key, F.col("folded").alias("title"), "form", "kind")
    preferred = F.struct("score", -F.array_position(F.array(*map(F.lit, FORM_KINDS)), F.col("kind")), "title")
    best = scored.join(kinds, [key, "title"]).groupBy("query_id", key).agg(F.max_by(F.struct("score", "form", "kind", F.col("title").alias("folded")), preferred).alias("b"))
    known = records.select(key, F.col(title).alias("canonical"), F.col(year).cast("int").alias("of_year"), F.coalesce(F.col(votes).cast("double"), F.lit(0.0)).alias("votes"))
    rows = best.join(asked, "query_id").join(known, key).filter(F.col("asked_year").isNull() | F.col("asked_year").eqNullSafe(F.col("of_year")))
    rows = rows.filter(~F.col("asked_exact_only") | (F.col("b.score") == 100))
    order = Window.partitionBy("query_id").orderBy(F.desc("b.score"), F.desc("votes"), F.coalesce("canonical", F.lit("")), key)
    top = rows.withColumn("second", F.lead("b.score").over(order)).withColumn("n", F.row_number().over(order)).filter("n = 1")
    clear = (F.col("b.score") >= least) & (F.col("second").isNull() | (F.col("b.score") - F.col("second") >= margin))
    whole = (F.col("b.folded") == F.col("folded_query")) & (F.col("b.kind") != "configured_alias")
    return top.filter(clear).select(
        "query_id", key, "candidate", F.col("b.form").alias("matched"), "canonical", F.round("b.score", 2).alias("score"), F.when(whole, "exact").otherwise(F.col("b.kind")).alias("match_type")
    )


def rewritten_with_title(query: Column, candidate: Column, canonical: Column) -> Column:
    """A question with the first mention of the candidate replaced by the record's own title, in any case; after the
    question where it is not mentioned or is that title already.
    """
    at = F.position(F.lower(candidate), F.lower(query))
    put = F.concat(F.substring(query, F.lit(1), at - 1), canonical, F.substring(query, at + F.char_length(candidate), F.char_length(query)))
    return F.when((at > 0) & (put != query), put).otherwise(F.concat(query, F.lit(" "), canonical))


def longest_contained(questions: DataFrame, catalog: DataFrame, title: str, head: int = 8) -> DataFrame:
    """Questions (query_id, query) with the longest of a catalog's titles that they contain, the greatest of equal length;
    none keeps null. Null and empty titles are in none.

    Titles meet places of a question by their first `head` characters, short ones by all of them, so that an ordinary join
    finds each title that stands anywhere; what follows is compared there. Each distinct text is searched once. Places are
    many times the questions, which Spark's estimates don't tell: they are never broadcast; titles are, where they are few.
    """
    flat = catalog.select(F.col(title).alias("title"), normalize(F.col(title)).alias("plain")).filter("plain != ''").distinct()
    stored = materialize(flat.withColumn("head", F.substring("plain", 1, head)), "titles")
    asked = questions.select("query_id", normalize(F.col("query")).alias("q"))
    texts = asked.select("q").filter("q != ''").distinct()
    places = texts.select("q", F.explode(F.sequence(F.lit(1), F.char_length("q"))).alias("at"))
    rest = places.select("q", F.expr("substring(q, at)").alias("rest"))
    sizes = F.sequence(F.lit(1), F.least(F.lit(head), F.char_length("rest")))
    heads = rest.select("q", "rest", F.explode(F.transform(sizes, lambda n: F.substring(F.col("rest"), F.lit(1), n))).alias("head"))
    titles = bounded(stored)
    hit = (heads if titles is not stored else heads.hint("merge")).join(titles, "head").filter(F.startswith("rest", "plain"))
    longest = F.max_by("title", F.struct(F.char_length("title"), "title")).alias("title")
    return asked.join(hit.groupBy("q").agg(longest), "q", "left").groupBy("query_id").agg(longest)
