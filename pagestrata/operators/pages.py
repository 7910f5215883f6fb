"""Page sets: split, merge, delete, reorder, rotate, display geometry, wrapping text onto new pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagestrata.operators.common import in_ranges, numbered, running
from pagestrata.session import cut_lineage


def unique_names(df: DataFrame, name: str, order: str, scope: list[str] | None = None) -> DataFrame:
    """Second and later uses of a name get -2, -3, … in input order."""
    keys = [*(scope or []), name]
    out = numbered(df, keys, order, "_use")
    use = F.col("_use").cast("string")
    return out.withColumn("unique_name", F.when(F.col("_use") == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit("-"), use))).drop("_use")


def split_each(docs: DataFrame) -> DataFrame:
    """One output per page, the number padded to at least two digits. ``docs``: doc_id, base, total."""
    digits = F.greatest(F.lit(2), F.length(F.col("total").cast("string")))
    each = docs.select("doc_id", "base", "total", F.explode(F.sequence(F.lit(1), "total")).alias("page_no"))
    return each.select(
        "doc_id", F.col("page_no").alias("file_no"), F.concat("base", F.lit("-pagina-"), F.lpad(F.col("page_no").cast("string"), digits, F.lit("0"))).alias("name"), "page_no", F.lit(1).alias("pos")
    )


def split_ranges(docs: DataFrame, joined: bool = False) -> DataFrame:
    """One output per typed range, or all ranges joined without repeats. ``docs``: doc_id, base, groups."""
    lone = F.size("groups") == 1

    def span(g: Column) -> Column:
        a, b = F.element_at(g, 1).cast("string"), F.element_at(g, -1).cast("string")
        return F.when(F.size(g) == 1, F.concat(F.lit("pagina-"), a)).otherwise(F.concat(F.lit("paginas-"), a, F.lit("-"), b))

    if joined:
        pages = F.array_distinct(F.flatten("groups"))
        name = F.concat("base", F.when(lone, F.concat(F.lit("-"), span(pages))).otherwise("-extracto"))
        one = docs.filter(F.size("groups") > 0).select("doc_id", F.lit(1).alias("file_no"), name.alias("name"), F.posexplode(pages).alias("pos", "page_no"))
        return one.withColumn("pos", F.col("pos") + 1)
    files = docs.select("doc_id", "base", F.posexplode("groups").alias("i", "g")).select(
        "doc_id", (F.col("i") + 1).alias("file_no"), F.concat("base", F.lit("-"), span(F.col("g"))).alias("raw"), "g"
    )
    named = unique_names(files, "raw", "file_no", ["doc_id"])
    return named.select("doc_id", "file_no", F.col("unique_name").alias("name"), F.posexplode("g").alias("pos", "page_no")).withColumn("pos", F.col("pos") + 1)


def select_pages(pages: DataFrame, chosen: DataFrame) -> DataFrame:
    """The chosen pages of every document in ascending order, as one output each."""
    picked = pages.join(chosen.select("doc_id", "page_no").distinct(), ["doc_id", "page_no"], "left_semi")
    return numbered(picked, ["doc_id"], "page_no", "pos")


def merge_documents(files: DataFrame) -> DataFrame:
    """Pages of all files of a target in queue order, numbered 1..N. ``files``: target, file_ord, page_no."""
    return numbered(files, ["target"], ["file_ord", "page_no"], "new_page")


def delete_pages(pages: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rest of each document renumbered; documents with nothing or everything chosen are refused (left out)."""
    marks = chosen.select("doc_id", "page_no", F.lit(True).alias("_gone")).distinct()
    laid = in_ranges(pages.join(marks, ["doc_id", "page_no"], "left"), ["doc_id"], ["page_no"])
    touched = laid.filter("_gone").select("doc_id").distinct()
    rest = running(laid.filter("_gone IS NULL").drop("_gone"), ["doc_id"], "new_page")
    return rest.join(touched, "doc_id", "left_semi")


def invert_selection(pages: DataFrame, chosen: DataFrame) -> DataFrame:
    return pages.select("doc_id", "page_no").join(chosen, ["doc_id", "page_no"], "left_anti")


def reorder_pages(pages: DataFrame, order: DataFrame) -> DataFrame:
    """Pages at their new places. ``order``: doc_id, page_no, pos (a permutation)."""
    return pages.join(order.select("doc_id", "page_no", "pos"), ["doc_id", "page_no"])


def reverse_order(pages: DataFrame) -> DataFrame:
    total = pages.groupBy("doc_id").agg(F.count("*").alias("_n"))
    return pages.join(total, "doc_id").select("doc_id", "page_no", (F.col("_n") + 1 - F.col("page_no")).alias("pos"))


def move_page(order: DataFrame, moves: DataFrame) -> DataFrame:
    """Swap a page with its neighbour. ``moves``: doc_id, page_no, delta (-1 or 1), one a document; moves past either end do
    nothing. A document's own facts (last place, place and step of the moved page) are one row of an aggregate."""
    order = cut_lineage(order.select("doc_id", "page_no", "pos"))
    step = F.max(F.when(F.col("delta").isNotNull(), F.struct(F.col("pos").alias("a"), (F.col("pos") + F.col("delta")).alias("b"))))
    facts = order.join(moves, ["doc_id", "page_no"], "left").groupBy("doc_id").agg(F.max("pos").alias("n"), step.alias("s"))
    ok = facts.filter((F.col("s.b") >= 1) & (F.col("s.b") <= F.col("n"))).select("doc_id", "s.a", "s.b")
    new = F.when(F.col("pos") == F.col("a"), F.col("b")).when(F.col("pos") == F.col("b"), F.col("a")).otherwise(F.col("pos"))
    return order.join(ok, "doc_id", "left").select("doc_id", "page_no", F.coalesce(new, "pos").alias("pos"))


def moved_pages(order: DataFrame) -> DataFrame:
    return order.groupBy("doc_id").agg(F.count_if(F.col("pos") != F.col("page_no")).alias("moved"))


def rotate_pages(pages: DataFrame, deltas: DataFrame) -> DataFrame:
    """Turn listed pages; the result stays in [0, 360)."""
    turned = pages.join(deltas.select("doc_id", "page_no", "delta"), ["doc_id", "page_no"], "left")
    return turned.withColumn("rotate", F.pmod(F.col("rotate") + F.coalesce("delta", F.lit(0)), F.lit(360))).drop("delta")


def to_display(boxes: DataFrame, pages: DataFrame) -> DataFrame:
    """User-space boxes (x0, y0, x1, y1) in display space: crop origin, page rotation, y down."""
    j = boxes.join(pages.select("doc_id", "page_no", "rotate", "crop_x", "crop_y", "crop_w", "crop_h"), ["doc_id", "page_no"])
    bx, by, bw, bh = (F.col(c) for c in ("crop_x", "crop_y", "crop_w", "crop_h"))

    def turn(at0, at90, at180, at270):
        r = F.pmod(F.col("rotate"), F.lit(360))
        return F.when(r == 90, at90).when(r == 180, at180).when(r == 270, at270).otherwise(at0)

    def point(x, y):
        return turn(x - bx, y - by, bx + bw - x, by + bh - y), turn(by + bh - y, x - bx, y - by, bx + bw - x)

    (ax, ay), (cx, cy) = point(F.col("x0"), F.col("y0")), point(F.col("x1"), F.col("y1"))
    return j.select(
        *boxes.columns,
        F.least(ax, cx).alias("x"), F.least(ay, cy).alias("y"), F.abs(ax - cx).alias("w"), F.abs(ay - cy).alias("h"),
        turn(bw, bh, bw, bh).alias("page_w"), turn(bh, bw, bh, bw).alias("page_h"),
    )


def wrap_text(text: Column, columns: int) -> Column:
    """Lines of a text set greedily in a fixed-pitch face, ``columns`` characters wide: words longer than a line are cut
    and blank source lines kept. A fold over the words of each source line inside the row."""
    n = F.lit(columns)
    state = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("line"))

    def chop(word: Column) -> Column:
        parts = F.ceil(F.length(word) / n).cast("int")
        return F.transform(F.sequence(F.lit(0), parts - 1), lambda i: F.substr(word, i * n + 1, n))

    def step(acc: Column, word: Column) -> Column:
        pieces = chop(word)
        long = F.size(pieces) > 1
        tail = F.element_at(pieces, -1)
        joined = F.concat(acc["line"], F.lit(" "), word)
        blank = acc["line"] == ""
        flushed = F.concat(acc["done"], F.when(blank, F.array().cast("array<string>")).otherwise(F.array(acc["line"])))
        return (
            F.when(long, F.struct(F.concat(flushed, F.slice(pieces, F.lit(1), F.size(pieces) - 1)).alias("done"), tail.alias("line")))
            .when(blank, F.struct(acc["done"].alias("done"), word.alias("line")))
            .when(F.length(joined) <= n, F.struct(acc["done"].alias("done"), joined.alias("line")))
            .otherwise(F.struct(flushed.alias("done"), word.alias("line")))
        )

    def close(acc: Column) -> Column:
        return F.when(acc["line"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["line"])))

    def one(source: Column) -> Column:
        words = F.filter(F.split(source, r"\s+"), lambda w: w != "")
        return F.when(F.size(words) == 0, F.array(F.lit(""))).otherwise(F.aggregate(words, state, step, close))

    return F.flatten(F.transform(F.split(text, r"\r?\n"), one))


def paginate(lines: DataFrame, height: float, margin: float = 48.0, size: float = 11.0) -> DataFrame:
    """Page and baseline of wrapped lines (doc_id, line_no from 0): a full page goes on to a new one."""
    leading = size * 1.4
    fit = int((height - margin - size - margin) // leading) + 1
    at = F.col("line_no") % fit
    return lines.select("*", F.floor(F.col("line_no") / fit).cast("int").alias("page_no"), (F.lit(height - margin - size) - at * F.lit(leading)).alias("y"))
