"""Documents of pages as chunks with offsets, excerpts of chunks, and the budget of what is told."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from worksight.functions.scalar import col
from worksight.functions.stats import carried
from worksight.sources.durable import durable

#: Code points of a piece of a page, and of a direct and a similar excerpt.
PIECE, DIRECT, SEMANTIC, LEAD = 400, 1200, 650, 150
CLAUSE = r"(?m)^[ \t]*\*?(\d+(?:\.\d+){1,3})\s"
CHAPTER = r"(?m)^# (.+)$"
PAGE_NUMBER = r"^([0-9]{1,2}|[ivxIVX]+)$"


def page_text(html) -> Column:
    """The text of a web page: a line for each block, blank lines round paragraphs, "# " before headings."""
    text = F.regexp_replace(col(html), r"(?s)<(?:script|style|head)\b.*?</(?:script|style|head)>|<!--.*?-->", "")
    text = F.regexp_replace(text, r"\s+", " ")
    text = F.regexp_replace(text, r"<h[1-6][^>]*>", "\n\n# ")
    text = F.regexp_replace(text, r"</h[1-6]>|</?(?:p|article|footer|nav|div|body)\b[^>]*>", "\n\n")
    text = F.regexp_replace(text, r"<(?:br|li|tr)\b[^>]*>", "\n")
    text = F.regexp_replace(text, r"<[^>]*>", "")
    for name, sign in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("middot", "·"), ("copy", "©"), ("nbsp", " "), ("amp", "&")):
        text = F.regexp_replace(text, f"&{name};", sign)
    return F.trim(F.regexp_replace(F.regexp_replace(text, r" *\n *", "\n"), r"\n{3,}", "\n\n"))


def lines_of(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), lambda x: F.trim(x))


def running_heads(pages: DataFrame, least: int = 3) -> DataFrame:
    """doc, head: first lines that stand on `least` pages of a document and on half of them."""
    first = pages.select("doc", F.get(F.filter(lines_of(F.col("text")), lambda x: x != ""), F.lit(0)).alias("head"))
    sizes = first.groupBy("doc").agg(F.count("*").alias("pages"))
    return first.where("head is not null").groupBy("doc", "head").agg(F.count("*").alias("n")).join(sizes, "doc").where(F.col("n") >= F.greatest(F.lit(least), F.col("pages") / 2)).select("doc", "head")


def cleaned(pages: DataFrame, least: int = 3) -> DataFrame:
    """Pages (doc, page, text) without running heads and page numbers; printed_page is the number that stood there.

    A page's last line goes if it is a number of two digits or a Roman one; more than one
    blank line become one. Null texts are empty.
    """
    rows = durable(pages.select("doc", "page", F.coalesce("text", F.lit("")).alias("text")))  # read three times, and texts take long to make
    heads = running_heads(rows, least).groupBy("doc").agg(F.collect_set("head").alias("heads"))  # two at most
    rows = rows.join(heads, "doc", "left")
    kept = F.filter(lines_of(F.col("text")), lambda x: ~F.coalesce(F.array_contains("heads", x), F.lit(False)))
    rows = rows.withColumn("text", F.regexp_replace(F.array_join(kept, "\n"), r"^\n+|\n+$", ""))
    last = F.element_at(F.split("text", "\n"), -1)
    number = F.when(last.rlike(PAGE_NUMBER), last)
    bare = F.when(number.isNotNull(), F.expr("substring(text, 1, length(text) - length(element_at(split(text, '\n'), -1)))")).otherwise(F.col("text"))
    text = F.regexp_replace(F.regexp_replace(bare, r"\n{3,}", "\n\n"), r"\n+$", "")
    return rows.select("doc", "page", text.alias("text"), number.alias("printed_page"))


def chunks(pages: DataFrame, piece: int = PIECE, chapter: str = CHAPTER, least: int = 3) -> DataFrame:
    """doc, page, piece, start, end, chapter, clauses, printed_page, text of the pieces of cleaned pages (doc, page, text).

    A piece ends at the last line end within `piece` code points, or there where a line is
    longer; start and end are code points of the cleaned page. The chapter is the latest heading of the
    document up to the piece, or FRONT MATTER; clauses are the numbers that lines begin with, each
    once. Empty pages have no pieces.
    """
    rows = cleaned(pages, least).where("text <> ''")
    cut = F.regexp_extract_all(F.concat("text", F.lit("\n")), F.lit(f"(?s)(?:.{{1,{piece - 1}}}\n|.{{1,{piece}}})"), F.lit(0))
    rows = rows.select("doc", "page", "printed_page", F.posexplode(cut).alias("piece", "text"))
    before = W.partitionBy("doc", "page").orderBy("piece").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)).cast("long"))
    rows = rows.withColumn("text", F.regexp_replace("text", r"\n+$", "")).withColumn("end", F.col("start") + F.length("text")).where("text <> ''")
    found = F.nullif(F.regexp_extract("text", chapter, 1), F.lit(""))
    clauses = F.array_distinct(F.regexp_extract_all("text", F.lit(CLAUSE), F.lit(1)))
    rows = durable(rows.withColumns({"heading": found, "clauses": clauses}))
    marks = carried(rows.select("doc", "page", "piece", "heading"), ["doc"], [F.col("page"), F.col("piece")], F.col("heading"), "chapter")
    rows = rows.drop("heading").join(marks.drop("heading"), ["doc", "page", "piece"])
    return rows.select("doc", "page", "piece", "start", "end", F.coalesce("chapter", F.lit("FRONT MATTER")).alias("chapter"), "clauses", "printed_page", "text")


def trimmed(rows: DataFrame) -> DataFrame:
    """Rows (text, start, end) with spans inside the text and without white space at their ends."""
    rows = rows.withColumns({"start": F.greatest(F.lit(0), F.col("start")).cast("long"), "end": F.least(F.length("text"), F.col("end")).cast("long")})
    inside = F.expr("substring(text, int(start) + 1, int(greatest(end - start, 0)))")
    left, right = F.length(F.regexp_extract(inside, r"^\s*", 0)), F.length(F.regexp_extract(inside, r"\s*$", 0))
    blank = left >= F.length(inside)
    return rows.withColumns({"start": F.when(blank, F.col("end")).otherwise(F.col("start") + left), "end": F.when(blank, F.col("end")).otherwise(F.col("end") - right)})


def clause_spans(asked: DataFrame, limit: int = DIRECT) -> DataFrame:
    """Adds start, end of the clause of rows (text, clause): from its heading to the next one, `limit` code points at most.

    Without such a heading the clause's first mention decides, with LEAD code points before
    it; without one the text's beginning.
    """
    # Every part of the text that begins with a numbered heading, the first one what is before them.
    parts = F.split(F.col("text"), r"(?m)(?=^[ \t]*\d+(?:\.\d+)+\s)")
    starts = F.transform(parts, lambda x, i: F.struct((F.length(F.array_join(F.slice(parts, 1, i), ""))).alias("at"), F.length(x).alias("n"), F.regexp_extract(x, r"^[ \t]*(\d+(?:\.\d+)+)\s", 1).alias("name")))
    own = F.get(F.filter(starts, lambda x: x["name"] == F.col("clause")), F.lit(0))
    mention = F.expr("instr(text, clause)") - 1
    rows = asked.withColumn("own__", own).withColumn("mention__", F.when(F.col("clause") != "", mention).otherwise(F.lit(-1)))
    start = F.when(F.col("own__").isNotNull(), F.col("own__.at")).when(F.col("mention__") >= 0, F.col("mention__") - LEAD).otherwise(F.lit(0))
    end = F.when(F.col("own__").isNotNull(), F.col("own__.at") + F.least(F.lit(limit), F.col("own__.n"))).when(F.col("mention__") >= 0, F.col("mention__") + limit - LEAD).otherwise(F.lit(limit))
    return trimmed(rows.withColumns({"start": start, "end": end}).drop("own__", "mention__"))


def best_spans(asked: DataFrame, limit: int = SEMANTIC) -> DataFrame:
    """Adds start, end of the paragraph of rows (id, text, query) that holds most of the query's distinct words, the first of equal ones.

    Of a paragraph of more than `limit` code points, `limit` of them, from LEAD before the
    first word found. Paragraphs end at blank lines; words are runs of letters, digits and
    underscores in lower case. A text without paragraphs gives its beginning. id tells rows apart.
    """
    words = F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower("query"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))))
    rows = asked.withColumn("words__", words)
    parts = F.regexp_extract_all(F.concat("text", F.lit("\n\n")), F.lit(r"(?s)(.*?)\n\s*\n"), F.lit(0))
    split = rows.select("id", "words__", F.posexplode(parts).alias("n", "part"))
    before = W.partitionBy("id").orderBy("n").rowsBetween(W.unboundedPreceding, -1)
    split = split.withColumn("at", F.coalesce(F.sum(F.length("part")).over(before), F.lit(0))).withColumn("part", F.regexp_replace("part", r"\n\s*\n$", "")).where(r"part rlike '\\S'")
    low = F.lower("part")
    held = F.filter("words__", lambda w: F.contains(low, w))
    split = split.withColumn("held", held).withColumn("focus", F.coalesce(F.array_min(F.transform("held", lambda w: F.call_function("instr", low, w) - 1)), F.lit(0)))
    size = F.length("part")
    shift = F.least(F.greatest(F.lit(0), F.col("focus") - LEAD), size - limit)
    start = F.col("at") + F.when(size <= limit, F.lit(0)).otherwise(shift)
    best = split.select("id", F.struct(F.size("held").alias("score"), (-F.col("at")).alias("first")).alias("order"), F.struct(start.alias("start"), (start + F.least(F.lit(limit), size)).alias("end"), F.size("held").alias("words")).alias("span"))
    best = best.groupBy("id").agg(F.max_by("span", "order").alias("span"))
    out = rows.drop("words__").join(best, "id", "left")
    return trimmed(out.withColumns({"start": F.coalesce("span.start", F.lit(0)), "end": F.coalesce("span.end", F.lit(limit)), "words": F.coalesce("span.words", F.lit(0))}).drop("span"))


#: Kinds of pieces, from those that are never dropped to those that go first.
KINDS = ("MANDATORY", "DIRECT", "OPTIONAL", "SEMANTIC")
ITEMS, SIMILAR, BUDGET = 8, 2, 18_000


def budgeted(pieces: DataFrame, items: int = ITEMS, similar: int = SIMILAR, budget: int = BUDGET, frame: int = 0) -> DataFrame:
    """Pieces (work_id, kind, priority, piece, bytes) with kept, and reason where a work falls back to the local text.

    First a work keeps its mandatory evidence and fills up to `items` with optional pieces by priority, and
    keeps `similar` similar excerpts. Then, while its bytes and the frame exceed the budget, the last
    similar excerpt goes, and when there is none, the last optional piece. Mandatory
    evidence and direct excerpts never go: where they alone are too many or too large, reason says
    so, and nothing is sent.
    """
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    rows = pieces.withColumn("order__", order)
    place = F.row_number().over(W.partitionBy("work_id", "kind").orderBy("priority", "piece"))
    mandatory = F.count_if(F.col("kind") == "MANDATORY").over(W.partitionBy("work_id"))
    rows = rows.withColumns({"place__": place, "mandatory__": mandatory})
    first = F.when(F.col("kind") == "OPTIONAL", F.col("place__") <= items - F.col("mandatory__")).when(F.col("kind") == "SEMANTIC", F.col("place__") <= similar).otherwise(F.lit(True))
    rows = rows.withColumn("listed__", first)
    size = F.when(F.col("listed__"), F.col("bytes")).otherwise(F.lit(0))
    upto = F.sum(size).over(W.partitionBy("work_id").orderBy("order__", "place__").rowsBetween(W.unboundedPreceding, 0)) + frame
    fixed = F.col("kind").isin("MANDATORY", "DIRECT")
    least = F.sum(F.when(fixed, F.col("bytes")).otherwise(F.lit(0))).over(W.partitionBy("work_id")) + frame
    reason = F.when(F.col("mandatory__") > items, "MANDATORY_EVIDENCE_EXCEEDS_ITEM_CAP").when(least > budget, "MANDATORY_DIRECT_CONTEXT_EXCEEDS_REQUEST_BUDGET")
    rows = rows.withColumns({"kept": F.col("listed__") & (fixed | (upto <= budget)), "reason": reason})
    return rows.drop("order__", "place__", "mandatory__", "listed__")


def budget_summary(rows: DataFrame) -> DataFrame:
    """Per work the kept pieces of each kind, how many went, the bytes kept, and the reason of a fallback."""
    kept = [F.count_if(F.col("kept") & (F.col("kind") == k)).alias(k.lower()) for k in KINDS]
    return rows.groupBy("work_id").agg(*kept, F.count_if(~F.col("kept")).alias("dropped"), F.coalesce(F.sum(F.when(F.col("kept"), F.col("bytes"))), F.lit(0)).alias("bytes"), F.max("reason").alias("reason"))
