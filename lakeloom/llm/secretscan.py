"""Secret scans with corpus-wide ownership, in DataFrame and SQL functions alone.

Spans of a pattern come from the gaps between its matches: the text split by the pattern and the matches
themselves alternate, so a match starts where the lengths before it add up to. Every candidate's
value is hashed; the hashes are aggregated over the corpus by distinct repositories and distinct owners. A
value that several owners hold, or many repositories of more than one, is an example that was copied around; any
other, of enough different characters, looks live. The method adds the spans of long mixed tokens that look live;
the spans of the three base patterns stay whatever their ownership.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import hot_keys, join_split, let, stored

#: The patterns of the base kinds, in the order in which kinds are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LEAST = 6
#: The added kind: runs of 20 and more token characters with a digit, a small and a capital letter.
MIXED = r"[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "mixed")
#: Owners from which on a value counts as copied around, the same for repositories of two owners, and different characters that a live value has at least.
OWNERS, REPOSITORIES, DISTINCT = 3, 10, 8


def _running(lengths: Column) -> Column:
    """Sums of the first 1, 2, ... elements: by blocks of the root of the number, so long arrays stay cheap."""
    add = lambda a, x: a + x
    total = lambda part: F.aggregate(part, F.lit(0).cast("long"), add)

    def by_blocks(block: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor(F.size(lengths) / block).cast("int"))
        sums = F.transform(starts, lambda b: total(F.slice(lengths, b * block + 1, block)))
        each = F.sequence(F.lit(0), F.size(lengths) - 1)
        return let(sums, lambda s: F.transform(each, lambda k: total(F.slice(s, F.lit(1), F.floor(k / block).cast("int"))) + total(F.slice(lengths, F.floor(k / block).cast("int") * block + 1, k % block + 1))))

    return let(F.greatest(F.lit(1), F.floor(F.sqrt(F.size(lengths))).cast("int")), by_blocks)


def spans_of(text: Column, pattern: str, kind: str, value: str | None = None, keep=None) -> Column:
    """Matches of a pattern as an array of (start, rank, end, kind, value); code points, end exclusive.

    ``value`` is a pattern whose second group within a match is its value (none: the match); ``keep`` tests
    a value. Matches are leftmost and do not overlap; those that fail the test are taken out afterwards.
    """
    empty = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string,value:string>>")

    def located(hits: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        lengths = F.zip_with(gaps, hits, lambda g, h: (F.length(g) + F.coalesce(F.length(h), F.lit(0))).cast("long"))

        def rows(before: Column) -> Column:
            def row(h: Column, i: Column) -> Column:
                v = F.regexp_extract(h, value, 2) if value else h
                end = before[i]
                return F.struct((end - F.length(h)).alias("start"), F.lit(KINDS.index(kind)).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), v.alias("value"))

            found = F.transform(hits, row)
            return F.filter(found, lambda s: keep(s["value"])) if keep else found

        return let(lengths, lambda x: let(_running(x), rows))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda h: F.when(F.size(h) == 0, empty).otherwise(located(h)))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of spans in order of start and kind, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repository_col: str = "doc_id", owner_col: str = "source") -> DataFrame:
    """``id``, ``base`` (spans of the base kinds), ``spans`` (all, sorted), ``live`` and ``copied`` (their numbers) and
    ``repositories`` (the most that hold a value of these spans) of every row.

    A null text counts as an empty one; a null repository or owner counts as no one. Spans that start together stay in order of
    their kinds. Very long texts are read whole. Rows repeat as they do in ``docs``; columns not named are not read. An empty table
    gives an empty one.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    mixed = lambda v: v.rlike("[0-9]") & v.rlike("[a-z]") & v.rlike("[A-Z]")
    base = F.concat(
        spans_of(text, ASSIGN, "assign", ASSIGN, lambda v: F.length(v) >= ASSIGN_LEAST), spans_of(text, ACCESS, "access"), spans_of(text, HEX, "hex")
    )
    hashed = lambda spans: F.transform(spans, lambda s: F.struct(s["start"], s["rank"], s["end"], s["kind"], F.xxhash64(s["value"]).alias("hash"), (F.size(F.array_distinct(F.split(s["value"], ""))) >= DISTINCT).alias("varied")))
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(repository_col).cast("string").alias("repository"), F.col(owner_col).cast("string").alias("owner"),
        hashed(base).alias("base"), hashed(spans_of(text, MIXED, "mixed", None, mixed)).alias("more"), F.monotonically_increasing_id().alias("row"),
    )
    rows, _ = stored(rows, "secret-spans")
    each = rows.select("row", "repository", "owner", F.explode(F.concat("base", "more")).alias("s")).select("row", "repository", "owner", "s.*")
    owned = each.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("repository").alias("repositories"), F.count_distinct("owner").alias("owners"))
    owned, _ = stored(owned, "secret-owners")
    around = (F.col("owners") >= OWNERS) | ((F.col("owners") > 1) & (F.col("repositories") >= REPOSITORIES))
    # A value that is copied everywhere is one hot key.
    judged = join_split(each, owned.drop("n"), "hash", hot_keys(owned, "hash"), F.xxhash64("row", "start", "rank"))
    judged = judged.withColumn("copied", around).withColumn("live", ~F.col("copied") & F.col("varied"))
    kept = judged.where((F.col("kind") != "mixed") | F.col("live"))
    per_row = kept.groupBy("row").agg(
        F.collect_list(F.struct("start", "rank", "end", "kind")).alias("spans"), F.count_if("live").alias("live"), F.count_if("copied").alias("copied"), F.max("repositories").alias("repositories")
    )
    out = rows.select("row", "id", F.transform("base", lambda s: F.struct(s["start"], s["rank"], s["end"], s["kind"])).alias("base")).join(per_row, "row", "left")
    none = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string>>")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select("id", "base", F.array_sort(F.coalesce("spans", none)).alias("spans"), zero("live"), zero("copied"), zero("repositories"))
