"""Near-duplicate lines by a segment-partition edit join. Built-in expressions only.

Lines are indexed by classes of length. A line that may have e edits is cut into e + 1 segments: the
first ones from its beginning, the last one up to its end, of the sizes of the shortest line of its
class. Of two lines at most e edits apart, one segment of the shorter is found unchanged in the
longer: the first at its beginning, the last at its end, one between at the same place or one
further. Each line also probes the class below, if a line of that may be linked to it. What meets is
verified by a banded bit-parallel edit distance.

How far lines may be apart follows from the shorter one's code points (``EDITS``): below 8 none,
as one edit makes any of them alike, from 8 on one, from 20 on two. Every line with a word takes
part, the shortest by being equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listingloom.llm.components import linked_in_rounds
from listingloom.llm.tables import SPACE, maybe_in, stored, text_or_empty

#: Edits (insertions, deletions, substitutions of code points) between linked lines, and the least
#: length of the shorter line for which they are allowed.
EDITS = {1: 8, 2: 20}
#: Classes of length: from a length on, so many lengths make one. No class has lengths of which the
#: edits differ, or fewer lengths than edits.
CLASSES = {8: 2, 20: 4, 64: 8}


def edits_of(length: Column) -> Column:
    """Edits that a line of a length may be away from a longer one."""
    allowed = F.lit(0)
    for edits, least in sorted(EDITS.items()):
        allowed = F.when(length >= least, edits).otherwise(allowed)
    return allowed


def lines(docs: DataFrame) -> DataFrame:
    """A row per line that has a word: its document, number, text, length and 128-bit identity.

    A document is known by its id and a hash of its text, as ids may repeat. The arrays that are
    opened here are never empty; the outer form spares a check for that, for which Spark would
    compute them once more.
    """
    text = text_or_empty()
    rows = docs.select(
        "doc_id", F.xxhash64(text).alias("th"), F.posexplode_outer(F.split(text, "\n")).alias("line_no", "line")
    ).withColumn("len", F.length("line"))
    return rows.where(F.col("line").rlike(rf"[^{SPACE}]")).withColumns(
        {"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit("line"), "line")}
    )


def _probes(edits: int) -> list[tuple[int, int]]:
    """(segment, shift): where in a line it looks for segments, or has its own (shift 0).

    With two edits the middle segment is untouched only where one edit lies before it and one
    behind. It then stands as far on as the first adds, 0 or 1. Where that one deletes a character
    and the other inserts one, lines are equally long, and the other's middle segment stands 1
    further in this one.
    """
    return [(i, shift) for i in range(edits + 1) for shift in range(1 + (0 < i < edits))]


def keyed(rows: DataFrame) -> DataFrame:
    """``rows`` once for each of their ``key``: their own segments (``own``), and what they probe.

    A key is a hash of class, segment and substring. Segments are as even as they can be, the
    longer ones last. Lines that may have no edit have no key. Keys come out of an array of one,
    or else a filter on them would be pushed below and cut each segment several times.
    """
    n = F.col("len")
    names = ("back", "e", "i", "shift")

    def grid(*classes: tuple[int, int]) -> Column:
        probes = [(back, e, *p) for back, e in classes for p in _probes(e)]
        return F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in zip(names, p))) for p in probes))

    # The shortest line of the own class, and how many lengths the class below that is probed has.
    least, chosen = F.lit(None).cast("int"), F.lit(None).cast("array<struct<back:int,e:int,i:int,shift:int>>")
    below = None
    for first, width in sorted(CLASSES.items()):
        e = max(e for e, length in EDITS.items() if length <= first)
        at = (n - first) % width
        least = F.when(n >= first, n - at).otherwise(least)
        one = grid((0, e))
        if below:
            chosen = F.when(n >= first, F.when(at < below[1], grid((0, e), below)).otherwise(one)).otherwise(chosen)
        else:
            chosen = F.when(n >= first, one).otherwise(chosen)
        below = (width, e)
        chosen = F.when(n >= first + width, F.when(at < e, grid((0, e), below)).otherwise(one)).otherwise(chosen)
    opened = rows.select("*", least.alias("_least"), F.inline(chosen))
    indexed, parts = F.col("_least") - F.col("back"), F.col("e") + 1
    base, longer = F.floor(indexed / parts).cast("int"), indexed % parts
    size = base + (F.col("i") + longer >= parts).cast("int")
    before = F.col("i") * base + F.greatest(F.lit(0), longer - (parts - F.col("i"))) + F.col("shift")
    start = F.when(F.col("i") == F.col("e"), n - size).otherwise(before)
    key = F.xxhash64(indexed, "i", F.substring(F.col("line"), start + 1, size))
    own = (F.col("back") == 0) & (F.col("shift") == 0)
    return opened.select(F.explode_outer(F.array(key)).alias("key"), own.alias("own"), *rows.columns)


def within(a: Column, b: Column, edits: int) -> Column:
    """Whether two arrays of characters, their lengths at most ``edits`` apart, are that near.

    Bit-parallel over a band: while the second text is at its character j, bit k of a word
    stands for row j - edits + k of the first. ``vp`` and ``vn`` say where a step down adds or
    saves an edit. The distance is followed along the upper edge of the band to the last row
    and along that row from there on. Both texts need ``edits`` characters or more.
    """
    top = 2 * edits
    ones = (1 << (top + 1)) - 1
    n = F.size(a)

    def matches(j: Column) -> Column:
        bits = F.lit(0)
        for k in range(top + 1):
            i = j - edits + k
            same = F.when(i >= 0, F.get(a, i)) == F.get(b, j)
            bits = bits + F.when(same, 1 << k).otherwise(0)
        return bits

    def flip(c: Column) -> Column:
        return c.bitwiseXOR(F.lit(ones))

    def bit(c: Column, k: Column) -> Column:
        return F.call_function("shiftright", c, k).bitwiseAND(F.lit(1))

    def step(s: Column, x: Column) -> Column:
        carried = (x.bitwiseAND(s["vp"]) + s["vp"]).bitwiseXOR(s["vp"])
        return F.transform(
            F.array(carried.bitwiseOR(x).bitwiseOR(s["vn"]).bitwiseAND(F.lit(ones))),
            lambda d0: after(s, d0),
        )[0]

    def after(s: Column, d0: Column) -> Column:
        hp = s["vn"].bitwiseOR(flip(d0.bitwiseOR(s["vp"])))
        hn = d0.bitwiseAND(s["vp"])
        right = F.shiftright(d0, 1)
        past = s["j"] - (n - edits)  # columns since the last row was reached
        row = top - 1 - past
        d = s["d"] + F.when(past < 0, 1 - bit(d0, F.lit(top))).otherwise(bit(hp, row) - bit(hn, row))
        return F.struct(
            hn.bitwiseOR(flip(right.bitwiseOR(hp))).alias("vp"),
            right.bitwiseAND(hp).alias("vn"),
            d.alias("d"),
            (s["j"] + 1).alias("j"),
        )

    start = F.struct(
        F.lit((ones << edits) & ones).alias("vp"), F.lit(0).alias("vn"), F.lit(edits).alias("d"), F.lit(0).alias("j")
    )
    end = F.aggregate(F.transform(F.sequence(F.lit(0), F.size(b) - 1), matches), start, step)
    return end["d"] <= edits


def _parity(line: Column) -> Column:
    """One bit per class of characters, set where their number is odd; an edit flips two at most."""
    return F.aggregate(
        F.split(line, ""),
        F.lit(0).cast("long"),
        lambda acc, c: acc.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.ascii(c) % 64)),
    )


def _pair_parity(line: Column) -> tuple[Column, Column]:
    """The same for neighbouring characters, in two words: a substitution flips four bits at most, an
    insertion or deletion three."""
    chars = F.split(line, "")
    classes = F.zip_with(chars, F.slice(chars, 2, F.size(chars)), lambda a, b: F.pmod(F.xxhash64(a, b), F.lit(128)))

    def word(at: int) -> Column:
        bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), (c % 64).cast("int"))
        return F.aggregate(
            classes, F.lit(0).cast("long"), lambda acc, c: acc.bitwiseXOR(F.when(c.between(at, at + 63), bit(c)).otherwise(0))
        )

    return word(0), word(64)


def line_groups(rows: DataFrame) -> DataFrame:
    """``node, root`` of the texts among ``rows`` of ``lines`` that are linked to another one.

    A text's node is its identity as text. Only lines of which a key is shared are looked at twice.
    In a key's group texts are held against some of them at a time, as ``linked_in_rounds`` says;
    lengths and the parity of characters and of their pairs are compared first, then the distance.
    """
    every = keyed(rows.where(F.col("len") >= min(EDITS.values())).select("line", "len", "h1"))
    met = every.groupBy("key").agg(F.min("h1").alias("_a"), F.max("h1").alias("_b"), F.max("own").alias("_own"))
    met = stored(met.where("_a < _b and _own").select("key"), "met")
    own = keyed(rows.where(F.col("len") >= min(EDITS.values())).select("line", "len", "h1", "h2"))
    node = F.concat(F.lpad(F.hex("h1"), 16, "0"), F.lpad(F.hex("h2"), 16, "0")).alias("node")
    hits = maybe_in(own, "key", met).join(met, "key").groupBy("key", node, "len", "line").agg(F.max("own").alias("own"))
    hits = stored(hits, "segments")
    line = F.col("line")
    first, second = _pair_parity(line)
    texts = hits.select("node", "line").distinct().select("*", _parity(line).alias("parity"), first.alias("p1"), second.alias("p2"))
    texts = stored(texts, "texts")
    members = hits.select("key", "node", "len", "own").join(texts.drop("line"), "node")

    def may(one, other) -> Column:
        allowed = edits_of(F.least(one("len"), other("len")))
        longer = F.abs(one("len") - other("len"))
        odd = lambda name: F.bit_count(one(name).bitwiseXOR(other(name)))
        # Of the allowed edits as many as lines differ in length are insertions or deletions.
        near = (odd("parity") <= 2 * allowed) & (odd("p1") + odd("p2") <= 4 * allowed - longer)
        return (one("own") | other("own")) & (longer <= allowed) & near

    def verified(pairs: DataFrame) -> DataFrame:
        for side, name in (("u", "a"), ("v", "b")):
            pairs = pairs.join(texts.select(F.col("node").alias(side), F.split("line", "").alias(name)), side)
        a, b = F.col("a"), F.col("b")
        allowed, near = edits_of(F.least(F.size(a), F.size(b))), F.lit(False)
        for edits in EDITS:
            near = F.when(allowed == edits, within(a, b, edits)).otherwise(near)
        return pairs.where(near)

    return linked_in_rounds(members, may, verified)


def line_classes(docs: DataFrame) -> DataFrame:
    """``doc_id, th, line_no, class_doc, class_line, removed`` of every line that has a word.

    Lines that are equal or linked, directly or over others, make up a class. It is named after
    its first line, by document id (null last) and number; all others are to be removed.
    Null, empty and white texts have no line to compare; a row repeated with its id is the same
    document, of which both rows keep what one would. An empty table gives no rows.
    """
    rows = lines(docs)
    roots = line_groups(rows)
    id_ = F.concat(F.lpad(F.hex("h1"), 16, "0"), F.lpad(F.hex("h2"), 16, "0"))
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th", "line_no")
    firsts = rows.groupBy(id_.alias("id")).agg(F.min(place).alias("first"))
    linked = roots.withColumnRenamed("node", "id")
    named = stored(firsts.join(linked, "id", "left").withColumn("root", F.coalesce("root", "id")), "classes")
    heads = named.groupBy("root").agg(F.min("first").alias("head"))
    named = named.join(heads, "root").select("id", "head")
    return rows.select("doc_id", "th", "line_no", id_.alias("id"), place.alias("place")).join(named, "id").select(
        "doc_id", "th", "line_no",
        F.col("head.doc_id").alias("class_doc"), F.col("head.line_no").alias("class_line"),
        (~F.col("place").eqNullSafe(F.col("head"))).alias("removed"),
    )


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the removed lines taken out of ``text``, and ``n_chars`` counted anew if there.

    A document all of whose lines go stays, with an empty text. Null texts stay null. All
    other columns are passed on.
    """
    gone = line_classes(docs).where("removed").groupBy(F.col("doc_id").alias("_doc"), F.col("th").alias("_th")).agg(
        F.collect_set("line_no").alias("_gone")
    )
    gone = stored(gone, "gone")
    th = F.xxhash64(text_or_empty())
    rows = docs.join(gone, F.col("doc_id").eqNullSafe(F.col("_doc")) & (th == F.col("_th")), "left")
    kept = F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains("_gone", i))
    rows = rows.withColumn("text", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col("_gone").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return rows.select(docs.columns)
