"""Personal data by patterns, and by contexts learned from what the patterns find.

Base: e-mail addresses, IP addresses, card and phone numbers, each kind's leftmost non-overlapping
matches; matches that fail their test (parts, digits, checksum) are dropped.

Bootstrapping: base spans are seeds. What stands around an identifier (the word before, the two
words before, the words on either side) is a lexical pattern; patterns and the identifiers in them
are a graph, of which each edge counts once however often it is copied. A round scores patterns by
the share of their identifiers that are of a kind, as the lower bound of Wilson's interval, so a
few coincidences don't make a pattern; then identifiers by the patterns they stand in (the chance
that not all are wrong). An identifier that no base pattern knows is taken where its own form
could be of the kind (a number without "+", an address in words) and its score is high enough; it
then counts as found in the next round. Rounds end when nothing new is found. What is found is
marked wherever it stands, except where a base span overlaps it.

Only DataFrame functions run here. Every text is scanned once a pattern; what travels between tasks
is spans with a few words of context, never texts.

Defined results: null and empty texts have no spans; texts are scanned whole, places are code points;
repeated rows each get a row and count as one in the graph; a null doc_id is carried; an empty table
has no rows; a span of two kinds is listed with each; ties of scores go to the kind listed first; extra columns are not
carried, whatever their names. n_email, n_ip, n_card and n_phone count base spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

KINDS = ["email", "ip", "card", "phone"]
#: An identifier's score from which on it is taken, the least bound of a pattern that scores, rounds at most.
LEAST_SCORE, LEAST_PATTERN, ROUNDS = 0.5, 0.5, 5
#: Wilson's interval at so many standard errors.
DEVIATIONS = 1.96
#: Code points of context that are kept of either side.
CONTEXT = 80

# The base patterns. Runs are possessive and begin at the run's start or behind the last
# match, which finds the same matches in time linear in the text.
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_WORD = r"\p{L}\p{N}_"
#: Whatever identifies something: addresses (also in words), groups of hexadecimals, numbers with their marks, words with digits.
ANY = (
    rf"(?<![{_WORD}.%+-])[\p{{L}}0-9._%+-]++(?:@| ?[\[({{] ?(?i:at) ?[\])}}] ?)[\p{{L}}0-9-]++(?:(?:\.| ?[\[({{] ?(?i:dot) ?[\])}}] ?)[\p{{L}}0-9-]++)*+"
    rf"|(?<![{_WORD}:])[0-9A-Fa-f]{{0,4}}(?::[0-9A-Fa-f]{{0,4}}){{2,7}}(?![{_WORD}:])"
    rf"|(?<![{_WORD}])[+(]?+[0-9]++(?:(?:\[\.\]|[.()/-]{{1,2}}+\x20?+)[0-9]++|\x20[0-9]{{2,}}+)*+(?![{_WORD}])"
    rf"|(?<![{_WORD}])[\p{{L}}_]*+[0-9][{_WORD}]*+"
)


def _pieces(text: Column, pattern: str) -> Column:
    """Matches of a text in order: (at, value, code points before it since the last match, what stands before and behind)."""
    matches, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    both = F.arrays_zip(matches.alias("value"), F.slice(between, F.lit(1), F.size(matches)).alias("before"), F.slice(between, F.lit(2), F.size(matches)).alias("behind"))
    first = lambda i: F.when(i == 0, "^ ").otherwise("0 ")
    return F.transform(
        both,
        lambda x, i: F.struct(
            i.alias("at"),
            x["value"].alias("value"),
            F.length(x["before"]).alias("skip"),
            F.when(F.length(x["before"]) > CONTEXT, F.right(x["before"], F.lit(CONTEXT))).otherwise(F.concat(first(i), x["before"])).alias("before"),
            F.left(x["behind"], F.lit(CONTEXT)).alias("behind"),
        ),
    )


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the checksum of decimal digits is right."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: c.try_cast("int") * F.when(i % 2 == 1, 2).otherwise(1))
    return F.aggregate(each, F.lit(0), lambda s, x: s + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def passes(kind: Column, value: Column) -> Column:
    """Whether a match of a base pattern is one."""
    n = F.length(_digits(value))
    part = "0*+(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
    ip = value.rlike(rf"^{part}(?:\.{part}){{3}}$")
    card = F.when(n.between(13, 19), luhn(_digits(value))).otherwise(False)
    return F.when(kind == "ip", ip).when(kind == "card", card).when(kind == "phone", n.between(9, 15)).otherwise(True)


def could_be(kind: Column, value: Column) -> Column:
    """Whether an identifier's form could be of a kind, though no base pattern knows it."""
    n = F.length(_digits(value))
    number = value.rlike(r"^[+(]?[0-9][0-9 ().\[\]/-]*$")
    email = value.rlike(r"@|[\[({] ?(?i:at) ?[\])}]")
    ip = value.rlike(r"^[0-9A-Fa-f:]*:[0-9A-Fa-f:]*:[0-9A-Fa-f:]*$") | value.rlike(r"^[0-9]{1,3}(?:(?:\.|\[\.\])[0-9]{1,3}){3}$")
    return F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", number & n.between(12, 19)).otherwise(number & n.between(7, 15))


def _patterns(before: Column, behind: Column) -> Column:
    """Lexical patterns around an identifier. Words are lower-case; one that holds a digit or an address counts as any other."""
    words = lambda c: F.transform(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != ""), lambda w: F.when(w.rlike("[0-9@]"), "0").otherwise(w))
    left, right = words(before), words(behind)
    near, far, after = F.coalesce(F.try_element_at(left, F.lit(-1)), F.lit("^")), F.coalesce(F.try_element_at(left, F.lit(-2)), F.lit("^")), F.coalesce(F.try_element_at(right, F.lit(1)), F.lit("$"))
    glued = F.when(before.rlike(r"\S$"), "+").otherwise(" ")
    return F.array(F.concat(F.lit("1"), glued, near), F.concat(F.lit("2"), glued, far, F.lit(" "), near), F.concat(F.lit("3"), glued, near, F.lit(" _ "), after))


def spans(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(texts, spans): texts(row, doc_id), and spans(row, kind, start, end, value, patterns) of docs(doc_id, text).

    kind is null for identifiers of no base pattern; those that a base span overlaps are left out.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    listed = lambda kind: F.when(text.rlike(r"[0-9@]|[\[({] ?(?i:at) ?[\])}]|:[A-Fa-f]{0,4}:" if kind == "any" else "[0-9@]"), _pieces(text, ANY if kind == "any" else PATTERNS[kind]))
    found = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), *(listed(k).alias(f"of_{k}") for k in [*KINDS, "any"]))
    found = scratch.save(found, "found")
    each = F.inline(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"of_{k}").alias("pieces")) for k in [*KINDS, "any"])))
    pieces = found.select("row", each).select("row", "kind", F.inline("pieces"))
    # code points before a match: those between matches, and of the matches before
    so_far = Window.partitionBy("row", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    placed = pieces.withColumn("end", F.sum(F.col("skip") + F.length("value")).over(so_far)).withColumn("start", F.col("end") - F.length("value"))
    tested = placed.where((F.col("kind") == "any") | passes(F.col("kind"), F.col("value")))
    return found.select("row", "doc_id"), scratch.save(_apart(tested).select("row", "kind", "start", "end", "value", _patterns(F.col("before"), F.col("behind")).alias("patterns")), "spans")


def _apart(rows: DataFrame) -> DataFrame:
    """Base spans, and those of any kind that no base span overlaps, with a null kind."""
    base = F.col("kind") != "any"
    down = Window.partitionBy("row").orderBy("start", F.desc(base)).rowsBetween(Window.unboundedPreceding, 0)
    up = Window.partitionBy("row").orderBy(F.desc("start"), F.desc(base)).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("last_end", F.max(F.when(base, F.col("end"))).over(down)).withColumn("next_start", F.min(F.when(base, F.col("start"))).over(up))
    free = F.coalesce(F.col("last_end") <= F.col("start"), F.lit(True)) & F.coalesce(F.col("next_start") >= F.col("end"), F.lit(True))
    return out.where(base | free).withColumn("kind", F.when(base, F.col("kind")))


def _number(kind: Column) -> Column:
    """The place of a kind in the list, from 1."""
    return F.array_position(F.array(*map(F.lit, KINDS)), kind).cast("int")


def lower_bound(share: Column, n: Column) -> Column:
    """The lower bound of Wilson's interval for a share of n."""
    z = DEVIATIONS
    return (share + z * z / (2 * n) - z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def discover(found: DataFrame, scratch: Scratch) -> DataFrame:
    """spans() -> (value, kind) of identifiers that contexts give a kind."""
    edges = scratch.save(found.select(F.explode("patterns").alias("pattern"), "value", "kind").distinct(), "edges")
    totals = edges.groupBy("pattern").agg(F.count_distinct("value").alias("n"))
    seeds = edges.where("kind is not null").select("pattern", "kind", F.lit(1.0).alias("score"))
    unknown = edges.where("kind is null").select("pattern", "value")
    taken = None
    for _ in range(ROUNDS):
        known = seeds if taken is None else seeds.unionByName(unknown.join(taken, "value").select("pattern", "kind", "score"))
        votes = known.groupBy("pattern", "kind").agg(F.sum("score").alias("score")).where(F.col("score") > 1)
        share = F.least(F.col("score") / F.col("n"), F.lit(1.0))
        trusted = votes.join(totals, "pattern").withColumn("bound", lower_bound(share, F.col("n"))).where(F.col("bound") >= LEAST_PATTERN).select("pattern", "kind", "bound")
        scored = unknown.join(trusted, "pattern").where(could_be(F.col("kind"), F.col("value"))).groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.col("bound"))))).alias("score"))
        order = -_number(F.col("kind"))
        best = scored.where(F.col("score") >= LEAST_SCORE).groupBy("value").agg(F.max_by(F.struct("kind", "score"), F.struct("score", order)).alias("b")).select("value", "b.kind", "b.score")
        now = scratch.save(best, "taken")
        n, before = now.count(), -1 if taken is None else taken.count()
        taken = now
        if n == max(before, 0):
            break
    return taken.select("value", "kind")


def scan(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, base, spans), a row for every row: arrays of (order of the kind, start, end)."""
    scratch = Scratch(docs.sparkSession, "pii")
    texts, found = spans(docs, scratch)
    added = found.where("kind is null").drop("kind").join(discover(found, scratch), "value")
    number = _number(F.col("kind")).alias("k")
    both = found.where("kind is not null").select("row", number, "start", "end", F.lit(True).alias("base")).unionByName(added.select("row", number, "start", "end", F.lit(False).alias("base")))
    span = F.struct("k", "start", "end")
    rows = both.groupBy("row").agg(F.sort_array(F.collect_list(F.when(F.col("base"), span))).alias("base"), F.sort_array(F.collect_list(span)).alias("spans"))
    none = F.array().cast("array<struct<k:int,start:bigint,end:bigint>>")
    return texts.join(rows, "row", "left").select("doc_id", F.coalesce("base", none).alias("base"), F.coalesce("spans", none).alias("spans"))


def _written(listed: Column) -> Column:
    return F.array_join(F.transform(listed, lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["k"]), x["start"], x["end"])), ",")


def op13_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    counts = [count(k + 1).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_added"))
