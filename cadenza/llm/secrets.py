"""Secret scans: strong patterns by themselves, weak parts of a credential only where its other parts stand near.

Patterns run inside the row; what is shuffled is the few weak parts that they find, never a text.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, table

#: Fixed patterns of the base scan: kind, pattern, group whose length counts, its least length.
BASE = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)
#: Access ids of BASE, which are identifiers by themselves.
ACCESS = BASE[1]
#: Weak parts of a credential: who, what, where. Names may have a prefix (DB_USER, AWS_SECRET_ACCESS_KEY).
WEAK = (
    ("identifier", r"""(?<![A-Za-z0-9])(?i:user(?:name)?|login|account|client_?id|(?<!secret[_-]?)access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._+-]{3,}"""),
    ("secret", r"""(?<![A-Za-z0-9])(?i:(?:pass(?:word|wd|phrase)?|pwd|secret|token|api_?key|auth|credential)(?:[_-]?access)?(?:[_-]?key)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}"""),
    ("endpoint", r"""(?<![A-Za-z0-9])(?:(?i:https?|ftp|ssh|jdbc|postgres(?:ql)?|mysql|mongodb|redis|amqp)(?::[a-z]+)?://[^\s"'<>|]+|(?i:host|endpoint|server|url)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]+\.[A-Za-z0-9:/.-]+)"""),
)
ORDER = [k for k, *_ in BASE] + [f"linked_{k}" for k, _ in WEAK]


def running_totals(x) -> F.Column:
    """For each number of an array, which is not empty, the sum of all before it.

    Numbers are taken in blocks of about the root of their count, so that appending to arrays does not make the work grow
    with its square.
    """

    def scan(y, value):
        start = F.struct(F.lit(0).cast("long").alias("all"), F.array().cast("array<long>").alias("before"))
        return F.aggregate(y, start, lambda a, z: F.struct((a["all"] + value(z)).alias("all"), F.concat(a["before"], F.array(a["all"])).alias("before")))

    def of(v):
        step = F.ceil(F.sqrt(F.size(v))).cast("int")
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / step).cast("int")), lambda b: scan(F.slice(v, b * step + 1, step), lambda z: z))

    # Each array is bound to a name before it is looked into many times.
    blocks = F.transform(F.array(x), of)[0]
    placed = F.transform(F.array(blocks), lambda bs: F.zip_with(bs, scan(bs, lambda z: z["all"])["before"], lambda b, before: F.transform(b["before"], lambda z: z + before)))
    return F.flatten(placed[0])


def spans(text, kind: str, pattern: str, group: int = 0, least: int = 0) -> F.Column:
    """Array of (start, end, kind) of the leftmost non-overlapping matches, in code points, end exclusive.

    split() gives what stands between the matches and regexp_extract_all() the matches; lengths add up to places.
    """
    between = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    match = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    counted = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else match
    size = lambda x: F.transform(x, lambda y: F.length(y))
    zipped = F.arrays_zip(between.alias("gap"), size(match).alias("m"), size(counted).alias("n"))

    def placed(z):
        # The last gap has no match behind it.
        own = F.filter(z, lambda x: x["m"].isNotNull())
        before = running_totals(F.transform(own, lambda x: (x["gap"] + x["m"]).cast("long")))
        at = lambda x, b: (b + x["gap"]).cast("int")
        return F.zip_with(own, before, lambda x, b: F.struct(at(x, b).alias("start"), (at(x, b) + x["m"]).alias("end"), F.lit(kind).alias("kind"), x["n"].alias("n")))

    found = F.transform(F.array(zipped), placed)[0]
    kept = F.transform(F.filter(found, lambda x: x["n"] >= least), lambda x: F.struct(x["start"], x["end"], x["kind"]))
    none = F.array().cast("array<struct<start:int,end:int,kind:string>>")
    return F.when(text.rlike(pattern), kept).otherwise(none)


def linked_parts(parts: DataFrame, reach: int) -> DataFrame:
    """The weak parts that stand near complementary ones.

    parts: (key, start, end, kind). A credential is an identifier, a secret and an endpoint whose starts lie within
    reach characters of the secret's, in one text. Returns the distinct (key, start, end, kind) of all such parts.

    The interval join goes over cells of reach characters: each identifier and endpoint looks into its own cell and the
    two beside it, by an equality of (key, cell). A first join marks the secrets that have both kinds within reach, a
    second one takes every identifier and endpoint within reach of a marked secret. Both ask only whether a partner
    exists, so a text of many parts gives no more than three rows a part.
    """
    cell = F.floor(F.col("start") / reach).cast("long")
    near = parts.where("kind <> 'secret'").withColumn("cell", F.explode(F.array(*[cell + k for k in (-1, 0, 1)])))
    here = parts.where("kind = 'secret'").withColumn("cell", cell)

    def starts(kind: str) -> F.Column:
        return F.collect_set(F.when(F.col("kind") == kind, F.col("start")))

    def within(name: str) -> F.Column:
        return F.exists(name, lambda x: F.abs(x - F.col("start")) <= reach)

    # Parts of a kind in one text do not overlap, so three cells hold fewer of them than they have characters.
    lists = near.groupBy("key", "cell").agg(starts("identifier").alias("ids"), starts("endpoint").alias("ends"))
    marked = here.join(lists, ["key", "cell"]).where(within("ids") & within("ends")).select("key", "start", "end", "kind", "cell")
    owners = marked.groupBy("key", "cell").agg(F.collect_set("start").alias("owners"))
    others = near.join(owners, ["key", "cell"]).where(within("owners")).select("key", "start", "end", "kind")
    return marked.drop("cell").unionByName(others).distinct()


def scan_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", reach: int = 200) -> DataFrame:
    """One row for each row of docs: key, base and spans, arrays of (start, end, kind) by start and kind.

    base has the strong matches. spans adds the weak parts (linked_identifier, linked_secret, linked_endpoint) of
    credentials whose three parts lie within reach characters of each other; alone they are not reported. An access id
    of base is an identifier too, unless it stands in one that its name tells. Null texts
    count as empty; keys may be null or repeated (repeated rows with equal text get equal spans).
    """
    t = F.coalesce(F.col(text), F.lit(""))

    def ordered(*arrays):
        rank = F.create_map(*[F.lit(x) for k, kind in enumerate(ORDER) for x in (kind, k)])
        tagged = F.transform(F.concat(*arrays), lambda x: F.struct(x["start"], rank[x["kind"]].alias("r"), x["end"], x["kind"]))
        return F.transform(F.array_sort(tagged), lambda x: F.struct(x["start"], x["end"], x["kind"]))

    def weak(named, access):
        bare = F.filter(access, lambda x: ~F.exists(named, lambda y: (y["start"] <= x["start"]) & (x["end"] <= y["end"])))
        as_identifier = F.transform(bare, lambda x: F.struct(x["start"], x["end"], F.lit("identifier").alias("kind")))
        return F.concat(named, as_identifier, *[spans(t, *w) for w in WEAK[1:]])

    some = (t.rlike(WEAK[0][1]) | t.rlike(ACCESS[1])) & t.rlike(WEAK[2][1]) & t.rlike(WEAK[1][1])
    found = cut(
        docs.select(
            F.col(key).alias("key"),
            F.when(some, F.md5(t)).alias("text_id"),
            ordered(*[spans(t, *b) for b in BASE]).alias("base"),
            F.when(some, weak(spans(t, *WEAK[0]), spans(t, *ACCESS))).alias("weak"),
        )
    )
    parts = found.where("weak is not null").select("text_id", F.explode("weak").alias("w")).select(
        F.col("text_id").alias("key"), "w.start", "w.end", "w.kind"
    )
    links = (
        linked_parts(parts.distinct(), reach)
        .groupBy("key")
        .agg(F.collect_list(F.struct("start", "end", F.concat(F.lit("linked_"), "kind").alias("kind"))).alias("linked"))
        .withColumnRenamed("key", "text_id")
    )
    none = F.array().cast("array<struct<start:int,end:int,kind:string>>")
    with_weak = found.where("weak is not null").join(links, "text_id", "left").select(
        "key", "base", ordered("base", F.coalesce("linked", none)).alias("spans")
    )
    return found.where("weak is null").select("key", "base", F.col("base").alias("spans")).unionByName(with_weak)


def _joined(spans_) -> F.Column:
    return F.array_join(F.transform(spans_, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def op5_secret_scans(spark, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        F.col("key").alias("doc_id"),
        *[count(kind).alias(f"n_{kind}") for kind, *_ in BASE],
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )
