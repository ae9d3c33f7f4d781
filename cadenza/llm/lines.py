"""Line dedup by a deletion-neighbourhood join. The unit of an edit is a word.

Only hashes of lines are shuffled until a line is known to share half of its words, at the same place, with another.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import may_be_in
from .common import bound, cut, table, words



def _lines(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(doc, line_no, at, line, plain): lines that can have `least` words; at is a number in the order of document and line,
    plain tells that the text has no white space but single spaces between words and ends of lines. And the same lines
    without plain, which spares looking for it.
    """
    size = docs.agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.max(F.octet_length("text")).alias("bytes")).first()
    lo, hi, most = size["lo"] or 0, size["hi"] or 0, (size["bytes"] or 0) + 1
    # A null document stands before the first. Numbers that are too large for 64 bits are decimals.
    kind = "long" if (hi - lo + 2) * most < 2**62 else "decimal(38,0)"
    doc = F.coalesce(F.col("doc") - F.lit(lo - 1).cast("decimal(20,0)") if kind != "long" else F.col("doc") - F.lit(lo - 1), F.lit(0))
    t = F.coalesce(F.col("text"), F.lit(""))
    odd = F.startswith(t, F.lit(" ")) | F.endswith(t, F.lit(" "))
    for x in ("  ", "\t", "\x0b", "\f", "\r", " \n", "\n "):
        odd |= F.contains(t, F.lit(x))
    # Bound before the lines are told apart; else the whole text would be looked through again for each of its lines.
    lines = F.split(t, "\n", -1)
    marked = bound(docs, {"plain": ~odd, "lines": lines}).select("doc", "plain", F.posexplode("lines").alias("line_no", "line"))
    bare = docs.select("doc", F.posexplode(lines).alias("line_no", "line"))
    at = (doc.cast(kind if kind == "long" else "decimal(20,0)") * F.lit(most).cast("long" if kind == "long" else "decimal(17,0)") + F.col("line_no")).cast(kind)
    long_enough = F.length("line") >= 2 * least - 1
    names = ["doc", "line_no", at.alias("at"), "line"]
    return marked.where(long_enough).select(*names, "plain"), bare.where(long_enough).select(*names)


def _spaced() -> F.Column:
    """The words of a line of _lines(), with single spaces between them."""
    return F.when(F.col("plain"), F.col("line")).otherwise(F.array_join(words(F.col("line")), " "))


def _n_words(spaced) -> F.Column:
    return F.when(spaced == "", 0).otherwise(F.octet_length(spaced) - F.octet_length(F.replace(spaced, F.lit(" "), F.lit(""))) + 1)


def _halves(spaced, n) -> F.Column:
    """Hashes of the first and of the last m div 2 of n words, for m = n - 1 and m = n.

    Two lines within one edit, the shorter of m words, share one of these two halves at least.
    """

    def key(m, sign: int):
        part = F.call_function("substring_index", spaced, F.lit(" "), (F.floor(m / 2) * sign).cast("int"))
        return F.xxhash64(part, m, F.lit(sign))

    return F.array(*[key(m, sign) for m in (n - 1, n) for sign in (1, -1)])


def _running(x) -> F.Column:
    """For each number of an array of longs, the exclusive or of all before it.

    Numbers are taken in blocks of about the root of their count, so that appending to arrays does not make the work grow
    with its square.
    """

    def scan(y, value):
        start = F.struct(F.lit(0).cast("long").alias("all"), F.array().cast("array<long>").alias("before"))
        return F.aggregate(y, start, lambda a, z: F.struct(a["all"].bitwiseXOR(value(z)).alias("all"), F.concat(a["before"], F.array(a["all"])).alias("before")))

    step = F.ceil(F.sqrt(F.size(x))).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / step).cast("int")), lambda b: scan(F.slice(x, b * step + 1, step), lambda z: z))
    placed = F.transform(F.array(blocks), lambda bs: F.zip_with(bs, scan(bs, lambda z: z["all"])["before"], lambda b, before: F.transform(b["before"], lambda z: z.bitwiseXOR(before))))
    return F.flatten(placed[0])


def variants(lines: DataFrame) -> DataFrame:
    """(at, n, i, key) for lines of n words: hashes of the line without its i-th word, for each word that can be an edit.

    lines: (at, w, head, tail), one row a line. Lines within one edit share a first or a last half (see _halves()), and the
    edit is outside of it: where only a first half is shared (head), words before the end of that half are not left out,
    and where only a last one is (tail), words behind its start are not.

    A hash is the exclusive or of a hash of each word and its place, so that a running total from the left and one from
    the right give every variant at once.
    """
    here = F.transform("w", lambda x, i: F.xxhash64(x, i))
    back = F.transform("w", lambda x, i: F.xxhash64(x, i - 1))
    hashed = bound(bound(lines.where(F.size("w") > 0), {"here": here, "back": back}), {"left": _running(F.col("here")), "right": _running(F.reverse("back"))})
    # Words behind the one left out move up by one place.
    keys = F.transform("left", lambda x, i: x.bitwiseXOR(F.get("right", F.size("right") - 1 - i)))
    every = hashed.select("at", F.size("w").alias("n"), "head", "tail", F.posexplode(keys).alias("i", "key"))
    half = F.floor((F.col("n") - 1) / 2)
    return every.where((F.col("head") & (F.col("i") >= half)) | (F.col("tail") & (F.col("i") < F.col("n") - half))).drop("head", "tail")


def near_lines(lines: DataFrame) -> DataFrame:
    """(at, earlier) for lines that have an earlier line within one edit.

    lines: (at, w, head, tail), one row a line, at in their order; head and tail tell whether another line shares one of its
    first or of its last halves. Lines meet by their variants, the line itself and the line without each of its words.
    Lines of equal length that agree without their i-th word are within one edit of each other, all of them, so each is
    paired with the earliest only. A line that equals others less one word is paired with each of these. Pairs are
    verified word by word.
    """
    here = F.transform("w", lambda x, i: F.xxhash64(x, i))
    made = cut(variants(lines))
    early = cut(made.groupBy("n", "i", "key").agg(F.min("at").alias("earlier"), F.max("at").alias("later")).where("earlier < later").drop("later"))
    total = F.aggregate(here, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x))
    whole = cut(lines.select(F.col("at").alias("at0"), F.size("w").alias("n0"), total.alias("key")))
    # Most variants meet nothing; a filter of bounded size keeps them from being moved.
    met = cut(may_be_in(made, "key", early.select("key").union(whole.select("key")), "key"))
    changed = met.join(early, ["n", "i", "key"]).where("earlier < at").select("at", "earlier")
    shorter = met.join(whole, "key").where("n = n0 + 1").select(F.greatest("at", "at0").alias("at"), F.least("at", "at0").alias("earlier"))
    pairs = changed.union(shorter.groupBy("at").agg(F.min("earlier").alias("earlier"))).distinct()
    a, b = lines.select("at", F.col("w").alias("wa")), lines.select(F.col("at").alias("earlier"), F.col("w").alias("wb"))
    longer = F.when(F.size("wa") > F.size("wb"), F.col("wa")).otherwise(F.col("wb"))
    short = F.when(F.size("wa") > F.size("wb"), F.col("wb")).otherwise(F.col("wa"))
    # Words that agree from the start; after them one word is changed or missing, and the rest has to agree.
    same = F.array_position(
        F.transform(F.arrays_zip(short.alias("x"), F.slice(longer, F.lit(1), F.size(short)).alias("y")), lambda z: z["x"] == z["y"]), F.lit(False)
    )
    agreed = F.when(same == 0, F.size(short)).otherwise(same - 1).cast("int")
    rest = F.slice(longer, agreed + 2, F.size(longer)) == F.when(
        F.size("wa") == F.size("wb"), F.slice(short, agreed + 2, F.size(short))
    ).otherwise(F.slice(short, agreed + 1, F.size(short) + 1))
    return pairs.join(a, "at").join(b, "earlier").where(rest).select("at", "earlier")


def duplicate_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = 5, near_words: int = 10) -> DataFrame:
    """(doc, line_no, near): the lines to remove, numbered from 0. Lines stand in the order of key and number.

    A line of at least min_words words goes if an equal line (by 128 bits of hash) stands earlier anywhere in the table.
    A line of at least near_words words goes, too, in all its places, if a line of as many words or more within one edit
    (a word changed, added or left out) stands earlier; near is true for these. Shorter lines stay. Null and empty texts
    have no line to remove; keys are integers; rows that repeat a key count as one document; a null key stands before
    the others. An empty table gives an empty one.
    """
    d = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    marked, each = _lines(d, min_words)
    same = [F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("g")]
    # Bound, as the filter would count words once more.
    long_ones = bound(marked.withColumn("spaced", _spaced()), {"n": _n_words(F.col("spaced"))}).where(F.col("n") >= min_words)
    halves = F.when(F.col("n") >= near_words, _halves(F.col("spaced"), F.col("n")))
    places = long_ones.select("at", *same, halves.alias("k"))
    four = places.select("at", "h", "g", *[F.get("k", F.lit(i)).alias(f"k{i}") for i in range(4)])
    firsts = cut(four.groupBy("h", "g").agg(F.min("at").alias("first"), F.max("at").alias("last"), *[F.max(f"k{i}").alias(f"k{i}") for i in range(4)]))

    shares = firsts.where("k0 is not null").select("first", F.posexplode(F.array("k0", "k1", "k2", "k3")).alias("k", "half"))
    twice = shares.groupBy("half").agg(F.min("first").alias("lo"), F.max("first").alias("hi")).where("lo < hi").select("half")
    first_half = F.col("k") % 2 == 0
    close = cut(shares.join(twice, "half", "left_semi").groupBy("first").agg(F.max(first_half).alias("head"), F.max(~first_half).alias("tail")))
    # A filter of bounded size keeps the texts of most other lines from being moved.
    there = may_be_in(each, "at", close, "first").join(close, F.col("at") == F.col("first"))
    spread = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spaced = F.array_join(words(F.col("line")), " ").alias("spaced")
    once = there.select("at", "head", "tail", spaced).dropDuplicates(["at"]).repartition(spread, "at")
    lines = cut(once.select("at", F.split("spaced", " ").alias("w"), "head", "tail"))
    near = cut(near_lines(lines).select(F.col("at").alias("first")).distinct().withColumn("near", F.lit(True)))

    repeated = cut(firsts.select("h", "g", "first", "last").join(near, "first", "left").where("near or first < last").select("h", "g", "first", "near"))
    return (
        may_be_in(each.select("doc", "line_no", "at", *same), "h", repeated, "h")
        .join(repeated, ["h", "g"])
        .where(F.col("near") | (F.col("at") > F.col("first")))
        .select("doc", "line_no", F.coalesce("near", F.lit(False)).alias("near"))
        .distinct()
    )


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = 5, near_words: int = 10) -> DataFrame:
    """docs with duplicate_lines() taken out of the text; adds n_lines, n_exact, n_near (long), the numbers of all lines
    and of those removed. Nulls stay null and have no line.
    """
    gone = (
        duplicate_lines(docs, key, text, min_words, near_words)
        .groupBy("doc")
        .agg(F.collect_list("line_no").alias("_gone"), F.count_if(F.col("near")).alias("_near"))
    )
    joined = docs.join(gone, F.col(key).eqNullSafe(gone["doc"]), "left").drop(gone["doc"])
    lines = F.split(F.col(text), "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_gone"))
    removed = F.coalesce(F.size("_gone"), F.lit(0)).cast("long")
    near = F.coalesce(F.col("_near"), F.lit(0)).cast("long")
    return joined.withColumns(
        {
            "n_lines": F.coalesce(F.size(lines), F.lit(0)).cast("long"),
            "n_exact": removed - near,
            "n_near": near,
            text: F.when(F.col("_gone").isNull(), F.col(text)).otherwise(
                F.array_join(F.transform(F.array(lines), lambda x: F.array_join(F.transform(left, lambda i: F.get(x, i)), "\n")), "")
            ),
        }
    ).drop("_gone", "_near")


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    """What is left of each document: counts, characters and SHA-256 of the text (null: of an empty one)."""
    t = F.coalesce("text", F.lit(""))
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_lines", "n_exact", "n_near", F.length(t).cast("long").alias("n_left"), F.sha2(t, 256).alias("left_sha256")
    )


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without their duplicate lines. Those of which nothing but white space is left go, if they had more.

    Null and empty texts stay; rows that repeat a doc_id lose the same lines; an empty table gives an empty one.
    """
    names = docs.columns
    left = dedup_lines(docs)
    some = F.col("text").rlike(r"[^\x20\x09-\x0D]") | (F.col("n_exact") + F.col("n_near") == 0)
    return left.where(F.coalesce(some, F.lit(True))).withColumn("n_chars", F.length("text").cast("long")).select(*names)
