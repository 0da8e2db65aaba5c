"""Line dedup with a log-template tree, in DataFrame functions only.

Every line is parsed to a fixed depth: token count, then its first three tokens, where a token that
holds a digit is a variable field. Lines in the same leaf are then compared, token by token behind the
leading ones, with the leaf's leaders (the line seen in most documents, then that of those unlike it,
and so on); a line shares the template of the first leader it is alike enough to, and where they differ
is a variable field. Lines left over get new leaders, until no line can lead a template that recurs: of
its tokens too few are shared, at their place in the leaf, by enough documents. Templates that recur
across documents are dropped.

A template counts the classes of documents it stands in. Equal texts are one class, and so are texts
linked by near copies: sketches of their word pairs that agree in at least SAME (Jaccard). So copies of
one document count once and do not empty each other, while a boilerplate line counts in every text it
was put into, whatever surrounds it.

Lines are parsed once and written with their hashes. What is shuffled first is a few hashes per line;
tokens are made again, and moved, only for lines of leaves that recur.
Leaves, templates and dropped lines are joined as tables, so no list of them meets in one place.

Defined results: a null text stays null, an empty one empty; short lines (few tokens or characters)
are always kept; equal texts get equal decisions; a document may end up empty; other columns stay as
they are; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from episcope.llm.common import fresh, saved
from episcope.llm.components import components

LEAD = 3
VARIABLE = "<*>"
#: Texts are near copies from this similarity of SKETCH smallest hashes; the first BANDS + 1 of them make the bands.
SAME, SKETCH, BANDS = 0.8, 64, 16
#: Leaders that are found in one pass over what is left of a leaf; passes go on until none is left.
LEADERS = 16
#: (tokens, documents): from so many tokens so many documents suffice, since longer lines do not repeat by chance.
LONG_LINES = ((8, 5), (20, 3))


def _any(text: Column, parts: Sequence[str]) -> Column:
    """True if a text contains one of ``parts`` (searched as bytes, which costs less than a pattern)."""
    found = F.lit(False)
    for part in parts:
        found = found | F.contains(text, F.lit(part))
    return found


def _tokens(line: Column) -> Column:
    """Tokens of a line; those with a digit become the variable field."""
    masked = F.regexp_replace(line, r"(?<!\S)[^\s0-9]*+[0-9]\S*+", VARIABLE)
    split = F.split(F.trim(F.when(F.rlike(line, F.lit("[0-9]")), masked).otherwise(line)), r"[ \t\r\x0b\f]+")
    # without digits and between single blanks no pattern is needed; one test keeps the generated code small
    odd = F.contains(line, F.lit("  ")) | F.rlike(line, F.lit(r"[0-9\t\r\x0b\f]"))
    return F.when(odd, split).otherwise(F.split(F.trim(line), " "))


def _key(text_col: str) -> Column:
    """Two hashes and the length of a text; equal texts have equal lines and so equal decisions."""
    return F.struct(F.xxhash64(text_col), F.xxhash64(F.lit("second"), text_col), F.length(text_col))


def _lines(docs: DataFrame, text_col: str, min_tokens: int, min_chars: int) -> DataFrame:
    """One row per line that may be dropped: key of its text, place, leaf, body, tokens (n), and the line.

    Lines are parsed here only; the rows are written, and later steps read the columns they need. Each line is a
    row before it is parsed, since generated code runs over columns but not inside functions over arrays.
    """
    line = F.col("line")
    df = docs.filter(F.col(text_col).isNotNull()).select(
        _key(text_col).alias("key"), F.posexplode(F.split(text_col, "\n")).alias("place", "line")
    )
    df = df.filter(F.length(F.trim(line)) >= min_chars).select("key", "place", "line", _tokens(line).alias("tokens"))
    rows = df.select(
        "key", "place", F.xxhash64(F.size("tokens"), F.slice("tokens", 1, LEAD)).alias("leaf"),
        F.xxhash64("tokens").alias("body"), F.size("tokens").alias("n"), "line",
    )
    # the count of tokens is compared after it is written: a filter before would make the tokens twice
    return saved(rows, "lines").filter(F.col("n") >= min_tokens)


def _sketches(docs: DataFrame, text_col: str) -> DataFrame:
    """id (hash of the text) and sketch: the smallest hashes of pairs of words, for every text."""
    df = docs.filter(F.col(text_col).isNotNull()).select(
        F.xxhash64(text_col).alias("id"), F.replace(F.trim(text_col), F.lit("\n"), F.lit(" ")).alias("flat")
    )
    odd = _any(F.col("flat"), ("  ", "\t", "\r", "\x0b", "\f"))
    df = df.select("id", F.when(odd, F.split("flat", r"\s+")).otherwise(F.split("flat", " ")).alias("words"))
    pairs = F.transform("words", lambda word, i: F.xxhash64(word, F.get("words", i + 1)))
    df = df.select("id", F.sort_array(pairs).alias("pairs"))
    # of sorted hashes the first few hold the smallest different ones, unless pairs repeat a lot
    df = df.select("id", "pairs", F.array_distinct(F.slice("pairs", 1, 2 * SKETCH)).alias("first"))
    enough = (F.size("first") >= SKETCH) | (F.size("pairs") <= 2 * SKETCH)
    return df.select("id", F.slice(F.when(enough, F.col("first")).otherwise(F.array_distinct("pairs")), 1, SKETCH).alias("sketch"))


def near_copies(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """id, label: the class of every text that is a near copy of another.

    Texts that share two neighbours among their smallest hashes meet in a band and are compared with the
    band's smallest text; links give components.
    """
    sketches = saved(_sketches(docs, text_col), "lines-sketches")
    two = lambda h, i: F.xxhash64(h, F.get("sketch", i + 1))
    bands = sketches.select("id", F.explode(F.transform(F.slice("sketch", 1, BANDS), two)).alias("band"))
    firsts = bands.groupBy("band").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last")
    met = bands.join(firsts.select("band", "first"), "band").filter("first < id").select("id", "first").distinct()
    sides = met.join(sketches.distinct(), "id").join(
        sketches.distinct().select(F.col("id").alias("first"), F.col("sketch").alias("other")), "first"
    )
    union = F.slice(F.sort_array(F.array_union("sketch", "other")), 1, SKETCH)
    sides = sides.select("id", "first", "sketch", "other", union.alias("union"))
    both = F.size(F.array_intersect(F.array_intersect("union", "sketch"), "other"))
    links = saved(sides.filter(both >= SAME * F.size("union")).select("id", "first"), "lines-links")
    return components(links, "id", "first", native=True).select(F.col("node").alias("id"), "label")


def with_classes(lines: DataFrame, classes: DataFrame) -> DataFrame:
    """``lines`` with ``class``: that of the text, or the text itself."""
    met = lines.join(classes.select(F.col("id").alias("_id"), "label"), F.col("key.col1") == F.col("_id"), "left")
    return met.select(*lines.columns, F.coalesce("label", F.col("key.col1")).alias("class"))


def _alike(a: Column, b: Column) -> Column:
    """Share of equal tokens behind the leading ones (1 if there are none)."""
    rest_a, rest_b = (F.slice(x, LEAD + 1, F.greatest(F.size(x) - LEAD, F.lit(0))) for x in (a, b))
    equal = F.aggregate(F.zip_with(rest_a, rest_b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when(F.size(a) <= LEAD, 1.0).otherwise(equal / (F.size(a) - LEAD))


def _bar(n: Column, min_documents: int, long_lines: Sequence[tuple[int, int]]) -> Column:
    """Documents that a line of ``n`` tokens must stand in."""
    bar = F.lit(min_documents)
    for tokens, documents in sorted(long_lines):
        bar = F.when(n >= tokens, min(documents, min_documents)).otherwise(bar)
    return bar


def _leaders(bodies: DataFrame, similarity: float) -> DataFrame:
    """leaf, leaders: its first lines by documents, without those alike an earlier one."""
    order = Window.partitionBy("leaf").orderBy(F.desc("n"), "body")
    first = bodies.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= LEADERS)
    lists = first.groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("rank", "body", "tokens"))).alias("all"))

    def add(found: Column, x: Column) -> Column:
        known = F.exists(found, lambda y: _alike(x["tokens"], y["tokens"]) >= similarity)
        return F.when(known, found).otherwise(F.concat(found, F.array(x)))

    return lists.select("leaf", F.aggregate("all", F.slice("all", 1, 0), add).alias("leaders"))


def _possible(left: DataFrame, inside: DataFrame, leaves: DataFrame, similarity: float) -> DataFrame:
    """The lines of ``left`` that may lead a template in as many documents as its leaf asks for.

    Of ``bar`` documents each would share ``similarity`` of the leader's tokens, so over all places the
    documents that share its token there, up to ``bar`` a place, are that share of ``bar`` times the places.
    """
    behind = F.slice("tokens", LEAD + 1, F.greatest(F.size("tokens") - LEAD, F.lit(0)))
    words = left.select("leaf", "body", "n", "tokens", F.posexplode(F.transform(behind, lambda x: F.xxhash64(x))).alias("at", "word"))
    spread = words.select("leaf", "body", "at", "word").join(inside.select("leaf", "body", "class"), ["leaf", "body"])
    shared = spread.select("leaf", "at", "word", "class").distinct().groupBy("leaf", "at", "word").agg(F.count(F.lit(1)).alias("documents"))
    shared = shared.join(leaves, "leaf").select("leaf", "at", "word", "bar", F.least("documents", "bar").alias("documents"))
    sums = words.join(shared, ["leaf", "at", "word"]).groupBy("leaf", "body", "n", "tokens").agg(
        F.sum("documents").alias("documents"), F.max("bar").alias("bar")
    )
    enough = F.col("documents") >= F.ceil((F.size("tokens") - LEAD) * similarity - 1e-9) * F.col("bar")
    return sums.filter(enough).select("leaf", "body", "n", "tokens")


def recurring_lines(
    lines: DataFrame, classes: DataFrame, min_documents: int = 20, similarity: float = 0.7,
    long_lines: Sequence[tuple[int, int]] = LONG_LINES,
) -> DataFrame:
    """leaf, body, tokens, template (leader's body), documents (classes): lines whose template recurs."""
    bar = _bar(F.col("n"), min_documents, long_lines)
    texts = lines.select("leaf", "n", "key").distinct().groupBy("leaf", "n").agg(F.count(F.lit(1)).alias("texts"))
    leaves = saved(texts.filter(F.col("texts") >= bar).select("leaf", bar.alias("bar")), "lines-leaves")
    inside = with_classes(lines.select("leaf", "body", "key", "line").join(leaves.select("leaf"), "leaf"), classes)
    inside = inside.groupBy("leaf", "body", "class").agg(_tokens(F.min("line")).alias("tokens"))
    inside = saved(inside, "lines-inside")
    left = inside.groupBy("leaf", "body").agg(F.count(F.lit(1)).alias("n"), F.min("tokens").alias("tokens"))
    chosen, settled, number = left, None, 0
    while True:
        leaders = _leaders(chosen, similarity)
        near = F.filter("leaders", lambda x: _alike(F.col("tokens"), x["tokens"]) >= similarity)
        met = left.join(leaders, "leaf").select("leaf", "body", "n", "tokens", F.get(near, F.lit(0))["body"].alias("template"))
        met = saved(met, f"lines-round{number}")
        joined = met.filter("template is not null").select("leaf", "body", "tokens", "template")
        settled = joined if settled is None else settled.unionByName(joined)
        left = met.filter("template is null").select("leaf", "body", "n", "tokens")
        # a leaf without a possible leader is done: no template in it can recur
        chosen = saved(_possible(left, inside, leaves, similarity), f"lines-possible{number}")
        number += 1
        if not chosen.limit(1).count():
            break
    templates = saved(settled, "lines-templates")
    spread = inside.select("leaf", "body", "class").join(templates.select("leaf", "body", "template"), ["leaf", "body"])
    counts = (
        spread.select("leaf", "template", "class").distinct().groupBy("leaf", "template")
        .agg(F.count(F.lit(1)).alias("documents"))
    )
    counts = counts.join(leaves, "leaf").filter(F.col("documents") >= F.col("bar")).drop("bar")
    return templates.join(counts, ["leaf", "template"]).select("leaf", "body", "tokens", "template", "documents")


def drop_recurring_lines(
    docs: DataFrame, text_col: str = "text", min_documents: int = 20, similarity: float = 0.7,
    min_tokens: int = 3, min_chars: int = 16, long_lines: Sequence[tuple[int, int]] = LONG_LINES,
) -> DataFrame:
    """``docs`` with the text that is left, and ``n_lines``, ``n_dropped`` per row.

    Columns of these two names are replaced.
    """
    lines = _lines(docs, text_col, min_tokens, min_chars)
    found = recurring_lines(lines, near_copies(docs, text_col), min_documents, similarity, long_lines)
    drops = saved(found.select("leaf", "body"), "lines-drops")
    # equal texts share a key: their places are the same, so one row per key is enough
    key, gone, left, all_lines, ends = fresh(docs.columns, "_key", "_gone", "_left", "_lines", "_ends")
    places = lines.select("key", "place", "leaf", "body").join(drops, ["leaf", "body"]).groupBy(F.col("key").alias(key)).agg(
        F.sort_array(F.collect_set("place")).alias(gone)
    )
    kept_columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped", text_col)]
    rows = docs.select(*kept_columns, text_col, _key(text_col).alias(key))
    met = rows.join(saved(places, "lines-gone"), key, "left")
    # made once a row, and only for texts that lose lines; inside the function below they would be made per line
    cut = F.col(gone).isNotNull()
    met = met.withColumn(all_lines, F.when(cut, F.split(text_col, "\n")))
    met = met.withColumn(ends, F.when(cut, F.concat(F.array(F.lit(-1)), F.col(gone), F.array(F.size(all_lines)))))
    between = F.transform(
        F.slice(ends, 2, F.size(ends)),
        lambda end, i: F.slice(all_lines, F.get(ends, i) + 2, end - F.get(ends, i) - 1),
    )
    met = met.withColumn(left, F.when(cut, F.array_join(F.flatten(between), "\n")))
    n_breaks = F.length(text_col) - F.length(F.replace(F.col(text_col), F.lit("\n"), F.lit("")))
    return met.select(
        *kept_columns,
        F.coalesce(left, text_col).alias(text_col),
        F.when(F.col(text_col).isNull(), 0).otherwise(n_breaks + 1).alias("n_lines"),
        F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).alias("n_dropped"),
    )
