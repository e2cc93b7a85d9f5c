"""Line dedup by a segment-partition edit join, in DataFrame functions only.

Equal lines are one class.  Two classes link when their edit distance is at most
``edits``.  A line is split into ``edits + 1`` segments; by the pigeonhole
principle a line within the distance holds one of them unchanged, shifted by no
more than the edits before it allow.  Every line indexes its segments by
(length, segment number, content) and probes the substrings of those lengths
that can still match, for lines as long as itself or up to ``edits`` shorter.

A pair that meets this way must also agree, but for ``2 * edits`` bits, in the
parities of its letters (an edit flips two at most), which the join checks before
it makes a row.  Lines of a segment that many lines share must agree so in every
window of ``WINDOW`` characters too.  What remains is verified by an edit distance over the band of
``2 * edits + 1`` diagonals, kept as bits of two numbers per column.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.registry import query
from quern.llm.shared import link_classes, read_table, stored

EDITS = 2
#: Characters of the lines that ``line_links`` joins where nothing else is asked; the operators ask for all lines.
LEAST_CHARS = 16
#: Letters whose parities are compared; the rarer ones would tell few lines apart.
LETTERS = "etaoinshrdlcumwf"
#: Further characters, compared only for lines that have met.
FURTHER = "gypbvkxjqz0123456789 .,;:-ETAOINSHRDLCU"
#: Lines with one segment beyond which all of them are compared window by window, and the characters of a window.
CROWD, WINDOW = 16, 64
#: Rows of identifiers (8 bytes each) up to which a filter is sent to all executors; beyond, it is a shuffled join.
SMALL = 1_000_000
_LINES = 1 << 31  # line numbers of a document stay below
_PLACE = "decimal(38,0)"


def _with_cuts(lines: DataFrame, edits: int) -> DataFrame:
    """``lines`` with a column for the length and the ends of the segments of every length that is probed.

    Columns, not expressions in each key: the code of all keys of a line then stays
    below the 8000 bytes of a method that the JVM compiles.
    """
    cuts = {}
    for shorter in range(edits + 1):
        length = F.col("size") - shorter
        cuts[f"size{shorter}"] = length
        for i in range(1, edits + 1):
            cuts[f"cut{shorter}_{i}"] = F.call_function("div", length * i, F.lit(edits + 1)).cast("int")
    return lines.select("*", *[value.alias(name) for name, value in cuts.items()])


def _key(shorter: int, i: int, shift: int, edits: int) -> Column:
    """Key of segment ``i`` of a line ``shorter`` characters shorter, read ``shift`` characters on."""
    cut = lambda k: F.lit(0) if k == 0 else F.col(f"size{shorter}") if k > edits else F.col(f"cut{shorter}_{k}")
    return F.xxhash64(F.col(f"size{shorter}"), F.lit(i), F.substring("line", cut(i) + (shift + 1), cut(i + 1) - cut(i)))


def index_keys(edits: int) -> list[Column]:
    return [_key(0, i, 0, edits) for i in range(edits + 1)]


def probe_keys(edits: int) -> list[tuple[int, Column]]:
    """(how much shorter the indexed line is, key) of every substring that can be its unchanged segment."""
    out = []
    for shorter in range(edits + 1):
        for i in range(edits + 1):
            # Edits before the segment: at most i; after it: at most edits - i.
            for shift in range(max(-i, shorter - (edits - i)), min(i, shorter + (edits - i)) + 1):
                out.append((shorter, _key(shorter, i, shift, edits)))
    return out


def parities(line: Column, chars: str) -> Column:
    """A bit for each of ``chars`` that occurs an odd number of times; an edit flips two at most."""
    size, bits = F.octet_length(line), F.lit(0).cast("long")
    for k, char in enumerate(chars):
        odd = (size - F.octet_length(F.replace(line, F.lit(char), F.lit("")))) % 2
        bits = bits.bitwiseOR(F.shiftleft(odd.cast("long"), k))
    return bits


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def banded_distance(a: Column, b: Column, edits: int) -> Column:
    """Edit distance of two texts whose lengths differ by at most ``edits``; exact up to ``edits``, else more than that.

    Rows are the characters of the longer text, columns those of the shorter.
    In column j, bit k stands for row j - edits + k.  ``up`` and ``down`` hold the
    rows whose value is one more or one less than the row above.
    """
    top, mask = F.lit(1 << (2 * edits)).cast("long"), F.lit((1 << (2 * edits + 1)) - 1).cast("long")
    long_ = F.when(F.length(a) >= F.length(b), a).otherwise(b)
    short = F.when(F.length(a) >= F.length(b), b).otherwise(a)
    extra = F.length(long_) - F.length(short)

    def column(state: Column, equal: Column) -> Column:
        up = F.shiftright(state["up"], 1).bitwiseOR(top)
        down = F.shiftright(state["down"], 1)
        return _let(F.struct(up.alias("up"), down.alias("down"), equal.alias("eq")), lambda v: _let(
            F.struct(v["up"].alias("up"), v["down"].alias("down"), _diagonal(v).alias("d")), lambda w: _let(
                F.struct(
                    w["d"].alias("d"), w["d"].bitwiseAND(w["up"]).alias("left"),
                    F.shiftleft(w["down"].bitwiseOR(F.bitwise_not(w["d"].bitwiseOR(w["up"])).bitwiseAND(mask)), 1).bitwiseOR(F.lit(1).cast("long")).bitwiseAND(mask).alias("right"),
                ), lambda h: F.struct(
                    F.shiftleft(h["left"], 1).bitwiseOR(F.bitwise_not(h["d"].bitwiseOR(h["right"]))).bitwiseAND(mask).alias("up"),
                    h["d"].bitwiseAND(h["right"]).alias("down"),
                    (state["cost"] + 1 - F.shiftright(h["d"], edits).bitwiseAND(F.lit(1).cast("long"))).alias("cost"),
                ))))

    def _diagonal(v: Column) -> Column:
        carried = (v["eq"].bitwiseAND(v["up"]) + v["up"]).bitwiseXOR(v["up"])
        return carried.bitwiseOR(v["eq"]).bitwiseOR(v["down"]).bitwiseAND(mask)

    begin = F.struct(
        F.lit(((1 << edits) - 1) << (edits + 1)).cast("long").alias("up"), F.lit(0).cast("long").alias("down"), F.lit(0).cast("long").alias("cost"),
    )
    below = F.lit(0).cast("long")  # rows under the last of the diagonal
    for k in range(edits):
        below = below + F.when(extra > k, F.lit(1 << (edits + 1 + k)).cast("long")).otherwise(F.lit(0).cast("long"))

    def walk(chars: Column) -> Column:
        equal = F.transform(chars["columns"], lambda c, j: _equal_bits(chars["rows"], c, j, edits))
        return F.aggregate(equal, begin, column, lambda s: s["cost"] + F.bit_count(s["up"].bitwiseAND(below)) - F.bit_count(s["down"].bitwiseAND(below)))

    # Bound once: a split inside the walk would be made again for every character.
    whole = _let(F.struct(F.split(long_, "").alias("rows"), F.split(short, "").alias("columns")), walk)
    return F.when(F.length(short) == 0, F.length(long_).cast("long")).otherwise(whole)


def _equal_bits(rows: Column, char: Column, j: Column, edits: int) -> Column:
    """Bit k: the character of the column equals that of row j - edits + k (both from 0)."""
    bits = F.lit(0).cast("long")
    for k in range(2 * edits + 1):
        same = F.coalesce(F.get(rows, j + F.lit(k - edits)) == char, F.lit(False))
        bits = bits.bitwiseOR(F.when(same, F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")))
    return bits


def lines_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, at (from 0), line: the parts of each text between line feeds; none for null texts."""
    named = df.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    return named.select("doc", F.posexplode(F.split("text", "\n")).alias("at", "line"))


def _place(doc: Column, at: Column) -> Column:
    return (doc.cast("decimal(20,0)") * F.lit(_LINES).cast("decimal(10,0)") + at).cast(_PLACE)


def line_digest(line: Column) -> Column:
    """What stands for a line where its rows meet their class: 256 bits, however long it is."""
    return F.unhex(F.sha2(line.cast("binary"), 256))


def distinct_lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """lid, line, digest, size, letters, copies, and place: the first document and line number in one number."""
    place = _place(F.col("doc"), F.col("at"))
    found = lines_of(df, id_col, text_col).groupBy("line").agg(F.count("*").alias("copies"), F.min(place).alias("place"))
    return stored(found.select(
        F.monotonically_increasing_id().alias("lid"), "line", line_digest(F.col("line")).alias("digest"), F.length("line").alias("size"),
        parities(F.col("line"), LETTERS).alias("letters"), "copies", "place",
    ), "lines")


def window_parities(line: Column, size: Column) -> Column:
    """``parities`` of each window of a line, by all letters.

    An edit takes one character at most out of a window and one into it, also where it
    moves what stands behind; so it flips two bits at most in each of them.
    """
    starts = F.sequence(F.lit(0), F.call_function("div", size, F.lit(WINDOW)).cast("int"))
    return F.transform(starts, lambda k: _let(F.substring(line, k * WINDOW + 1, F.lit(WINDOW)), lambda part: parities(part, LETTERS + FURTHER)))


def _close_windows(a: Column, b: Column, edits: int) -> Column:
    bits = lambda x: F.coalesce(x, F.lit(0).cast("long"))  # noqa: E731  no window: the other line is longer
    return F.forall(F.zip_with(a, b, lambda x, y: F.bit_count(bits(x).bitwiseXOR(bits(y))) <= 2 * edits), lambda near: near)


def crowded_lines(keyed: DataFrame) -> DataFrame:
    """lid of the lines that share one of their ``keys`` with more than ``CROWD`` lines."""
    each = keyed.select("lid", F.explode("keys").alias("key"))
    crowds = stored(each.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > CROWD).select("key"), "crowds")
    return stored(each.join(_few(crowds, crowds.count()), "key", "left_semi").select("lid").distinct(), "crowded-lines")


def _few(ids: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(ids) if rows <= SMALL else ids


def meeting_keys(lines: DataFrame, edits: int, *keep: str) -> tuple[DataFrame, DataFrame]:
    """(lid, letters, key) of every segment, and (other, letters2, shorter, key2) of every substring that can be one.

    Columns of ``keep`` go along, on the second side with a 2 behind their names.
    """
    cut, kept = _with_cuts(lines, edits), ["letters", *keep]
    index = cut.select("lid", *kept, F.explode(F.array(*index_keys(edits))).alias("key"))
    probes = [F.struct(F.lit(d > 0).alias("shorter"), k.alias("key2")) for d, k in probe_keys(edits)]
    probe = cut.select(F.col("lid").alias("other"), *[F.col(c).alias(f"{c}2") for c in kept], F.explode(F.array(*probes)).alias("p"))
    return index, probe.select("other", *[f"{c}2" for c in kept], "p.*")


def meeting_pairs(lines: DataFrame, edits: int) -> DataFrame:
    """Pairs (u, v) of lines that share a segment and may be within ``edits`` by their letters; each once.

    Two crowded lines meet in a join of their own, which also checks their windows.
    """
    keyed = stored(_with_cuts(lines, edits).select("lid", "letters", F.array(*index_keys(edits)).alias("keys")), "line-keys")
    crowded = crowded_lines(keyed)
    marks = _few(crowded, crowded.count()).withColumn("mark", F.lit(True))
    marked = lambda rows: rows.join(marks, "lid", "left").withColumn("crowded", F.col("mark").isNotNull()).drop("mark")
    index = marked(keyed).select("lid", "letters", "crowded", F.explode("keys").alias("key"))
    known = marked(lines)
    _, probe = meeting_keys(known, edits, "crowded")
    crowd = stored(known.where("crowded").withColumn("windows", window_parities(F.col("line"), F.col("size"))), "crowded-windows")
    in_crowd, probe_crowd = meeting_keys(crowd, edits, "windows")
    meet = (
        (F.col("key") == F.col("key2")) & (F.col("shorter") | (F.col("other") > F.col("lid")))
        & (F.bit_count(F.col("letters").bitwiseXOR(F.col("letters2"))) <= 2 * edits)
    )
    met = index.join(probe, meet & ~(F.col("crowded") & F.col("crowded2"))).select("lid", "other")
    met = met.union(in_crowd.join(probe_crowd, meet & _close_windows(F.col("windows"), F.col("windows2"), edits)).select("lid", "other"))
    return stored(met.select(F.col("lid").alias("u"), F.col("other").alias("v")).distinct(), "line-pairs")


def line_links(lines: DataFrame, edits: int = EDITS, least: int = LEAST_CHARS) -> DataFrame:
    """Pairs (u, v) of distinct lines of at least ``least`` characters within ``edits``; each once.

    Lines of up to ``edits`` characters have an empty segment, a key on which they meet all lines of a length they can link to.
    """
    fit = lines.where(F.col("size") >= least).select("lid", "line", "size", "letters")
    pairs = meeting_pairs(fit, edits)
    wanted = pairs.select(F.col("u").alias("lid")).union(pairs.select("v")).distinct()
    few = _few(wanted, 2 * pairs.count())  # two identifiers a pair at most
    bits = F.col("letters").bitwiseOR(F.shiftleft(parities(F.col("line"), FURTHER), len(LETTERS))).alias("bits")
    texts = stored(fit.join(few, "lid", "left_semi").select("lid", "line", "size", bits), "paired-lines")
    left = texts.select(F.col("lid").alias("u"), F.col("line").alias("a"), F.col("size").alias("a_size"), F.col("bits").alias("a_bits"))
    right = texts.select(F.col("lid").alias("v"), F.col("line").alias("b"), F.col("size").alias("b_size"), F.col("bits").alias("b_bits"))
    both = pairs.join(left, "u").join(right, "v").where(F.abs(F.col("a_size") - F.col("b_size")) <= edits)
    both = both.where(F.bit_count(F.col("a_bits").bitwiseXOR(F.col("b_bits"))) <= 2 * edits)
    return stored(both.where(banded_distance(F.col("a"), F.col("b"), edits) <= edits).select("u", "v"), "line-links")


def line_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, least: int = 0) -> DataFrame:
    """Per distinct line: doc, at (its first place), copies, n_links, class_doc, class_at, kept.

    A line links to the other distinct lines within ``edits`` when both have
    ``least`` characters; a class is what links join, named by its first place,
    whose line is kept.  Null texts have no lines, an empty text has one empty
    line; very long lines are compared whole.  Lines that only stand in rows
    without an id have no place, and none is kept for a class of nothing else.
    Repeated rows count as copies.  An empty table gives no rows.
    """
    lines = distinct_lines(df, id_col, text_col)
    return _told(lines.select("lid", "copies", "place"), lines, edits, least, F.col("place"))


def line_members(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, least: int = 0) -> DataFrame:
    """Per line row of every text, copies included: doc, at, copies, n_links, class_doc, class_at, kept.

    As ``line_classes``, but every row names its class; only the row at the
    first place of a class is kept.  Rows without an id are told with a null doc.  Lines that stand often meet
    one row of their class each, so copies make no pairs.
    """
    lines = distinct_lines(df, id_col, text_col)
    rows = lines_of(df, id_col, text_col).select("doc", "at", line_digest(F.col("line")).alias("digest"))
    rows = rows.join(lines.select("digest", "lid", "copies", "place"), "digest").drop("digest")
    own = _place(F.col("doc"), F.col("at"))
    return _told(rows.select("doc", "at", "lid", "copies", "place"), lines, edits, least, own)


def _told(rows: DataFrame, lines: DataFrame, edits: int, least: int, own: Column) -> DataFrame:
    """``rows`` (lid, copies, place, and doc, at unless they are those of the place) with their links and classes; ``own`` is a row's place."""
    links = line_links(lines, edits, least)
    counts = links.select(F.col("u").alias("lid")).union(links.select("v")).groupBy("lid").agg(F.count("*").alias("n_links"))
    roots = link_classes(links).withColumnRenamed("node", "lid").join(counts, "lid")
    tied = lines.select("lid", "place").join(roots, "lid").groupBy("root").agg(F.min("place").alias("first"))
    marked = rows.join(roots.join(tied, "root"), "lid", "left")
    marked = marked.withColumn("first", F.when(F.col("root").isNull(), F.col("place")).otherwise(F.col("first")))
    at = lambda p: F.pmod(p, F.lit(_LINES).cast(_PLACE))
    doc = lambda p: ((p - at(p)) / F.lit(_LINES).cast("decimal(10,0)")).cast("long")
    place, first = F.col("place"), F.col("first")
    named = [F.col("doc"), F.col("at")] if "doc" in rows.columns else [doc(place).alias("doc"), at(place).cast("int").alias("at")]
    return marked.select(
        *named, "copies", F.coalesce("n_links", F.lit(0)).alias("n_links"),
        doc(first).alias("class_doc"), at(first).cast("int").alias("class_at"), F.coalesce(own == first, F.lit(False)).alias("kept"),
    )


def without_repeated_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, least: int = 0) -> DataFrame:
    """``df`` with only the kept lines in its texts, each at its first place.

    As in the query, lines of all lengths are linked; ``least`` leaves shorter ones
    alone.  Identifiers name documents here; rows without one, and null texts, stay as they are.
    Repeated rows keep the same lines; of lines that tie, the first place counts; a table
    without rows gives none.
    """
    kept = line_classes(df, id_col, text_col, edits, least).where("kept").groupBy("doc").agg(F.collect_set("at").alias("kept"))
    rows = df.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("doc")).join(kept, "doc", "left")
    own = F.col("row")[text_col]
    lines = F.filter(F.split(own, "\n"), lambda line, at: F.array_contains("kept", at))
    text = F.when(F.col("doc").isNull() | own.isNull(), own).otherwise(F.coalesce(F.array_join(lines, "\n"), F.lit("")))
    return rows.select(*[(text if c == text_col else F.col("row")[c]).alias(c) for c in df.columns])


@query("op3_edit_lines")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line row of the documents with its class; lines of all lengths are joined."""
    found = line_members(read_table(spark, sf_dir, "documents"))
    return found.withColumnsRenamed({"doc": "doc_id", "at": "line_no", "class_at": "class_line"})
