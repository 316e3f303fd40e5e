"""Document fingerprints as invertible Bloom lookup sketches, in DataFrame functions only.

A text is the set of digests of its paragraphs (up to a line break or the end of a sentence, long ones
cut). A digest has a page, and one cell in each of three tables of the page: it is added to the cell's count, to the
exclusive-or of its digests and to that of their check sums. The number of pages grows with the paragraphs. A fingerprint
lists the cells that are not empty. Subtracting the cells of two versions leaves those of the digests that
differ. A cell of count 1 or -1 whose check sum fits holds one such digest, which is recovered and taken out
of its other cells, and so on until nothing is left. Two versions are compared at the pages of the larger fingerprint, so its cells are
those that are returned; the other's are too if it has as many pages, and are made anew if not. Cells are linear: adding both
versions' digests with opposite signs gives the subtracted cells. A pair whose cells are not emptied is tried again with four
times the pages and other cells, until it is. The likeness of two texts is the share of common digests among all of theirs.

Each round of peeling is one grouping of cells by document. Only one of the three tables is peeled per
round: a digest has one cell there, so it is taken out once. The documents are bucketed once by place in the order of
ids; all later grouping stays inside these buckets and moves nothing. Partitions are sized by the bytes of the texts, so that
the cells of one fit in memory.

Defined results: null and empty texts have no digests; two texts without digests have likeness 1, one
without and one with have 0. A null doc_id sorts below all others. Rows of one doc_id follow each other
by text. Repeated rows are kept. Other columns are not read. A table of one row is its own next document, and an empty table
gives no rows. Texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.llm.common import bucketed as stored_in_buckets, partitions, spool

#: Paragraphs: no line break or sentence end inside, at most 200 characters.
PARAGRAPH = r"[^\n.!?]{1,200}"
#: Digests of a page at most on average, cells of each of its tables (only those that are not empty are kept), rounds of
#: peeling in a try. Of the pairs some in ten thousand are tried again: two digests share all of their cells.
PAGE, CELLS, ROUNDS = 32, 256, 6
#: Bytes of text in a partition.
PARTITION_BYTES = 8 << 20
#: Documents of a bucket, and buckets at most (their bounds go through the driver).
BUCKET_ROWS, MAX_BUCKETS = 256, 4096


def paragraph_digests(text: Column) -> Column:
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PARAGRAPH), 0)
    return F.array_distinct(F.transform(found, lambda p: F.xxhash64(p)))


def pages_of(digests: Column) -> Column:
    """The power of two that leaves at most ``PAGE`` digests to a page."""
    return F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.size(digests) / PAGE, F.lit(1.0))))).cast("long")


def _place(digest: Column, table: int, pages: Column, salt: int = 0) -> Column:
    """The cell of a digest in one of its page's tables, numbered over all pages."""
    return (F.pmod(F.xxhash64(digest, F.lit(3), F.lit(salt)), pages) * 3 + table) * CELLS + F.pmod(F.xxhash64(digest, F.lit(table), F.lit(salt)), F.lit(CELLS))


def _check(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit(99))


def _unit(cell: Column, digest: Column) -> Column:
    return F.struct(cell.alias("cell"), F.lit(1).alias("n"), digest.alias("x"), _check(digest).alias("check"))


def _joined(units: Column) -> Column:
    """Cells in order of place from units in any order; a sort brings those of a place together."""
    def add(done: Column, now: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        both = F.struct(now["cell"].alias("cell"), (last["n"] + now["n"]).alias("n"), last["x"].bitwiseXOR(now["x"]).alias("x"),
                        last["check"].bitwiseXOR(now["check"]).alias("check"))
        same = F.coalesce(last["cell"] == now["cell"], F.lit(False))
        return F.when(same, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(both))).otherwise(F.concat(done, F.array(now)))

    return F.aggregate(F.array_sort(units), F.array().cast("array<struct<cell:bigint,n:int,x:bigint,check:bigint>>"), add)


def printed(digests: Column) -> Column:
    """The sketch as text: digests, pages, then place, count, exclusive-or and check sums of each cell, page by page."""
    def cell(c: Column) -> Column:
        return F.concat_ws(":", F.lower(F.hex(c["cell"])), c["n"], F.lower(F.hex(c["x"])), F.lower(F.hex(c["check"])))

    def page(p: Column) -> Column:
        own = F.filter(digests, lambda d: F.pmod(F.xxhash64(d, F.lit(3), F.lit(0)), pages_of(digests)) == p)
        units = F.flatten(F.transform(own, lambda d: F.array(*(_unit(_place(d, t, pages_of(digests)), d) for t in range(3)))))
        return F.array_join(F.transform(_joined(units), cell), " ")

    return F.concat_ws(" ", F.size(digests), pages_of(digests), F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), pages_of(digests) - 1), page), " "))


def _versions(docs: DataFrame) -> tuple[DataFrame, int]:
    """Each document with the next one by descending id, bucketed: (bkt, rid, doc_id, text, following); and the partitions."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.coalesce("doc_id", F.lit(-(1 << 63))))
    ids = rows.select("key")
    count, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    buckets = max(1, min(MAX_BUCKETS, count // BUCKET_ROWS))
    inner = ids.agg(F.percentile_approx("key", [i / buckets for i in range(1, buckets)] or [0.5], 100 * buckets)).first()[0] or []
    cuts = [float("-inf"), *sorted({float(x) for x in inner}), float("inf")]
    if len(cuts) < 3:
        cuts.insert(1, 0.0)
    bucketizer = Bucketizer(splits=cuts, inputCol="at", outputCol="bkt")

    def bucketed(df: DataFrame) -> DataFrame:
        return bucketizer.transform(df.withColumn("at", F.col("key").cast("double"))).drop("at").withColumn("bkt", F.col("bkt").cast("int"))

    # a row for each bucket: its largest id, which follows the last document of the bucket above
    heads = sorted(tuple(r) for r in bucketed(ids).groupBy("bkt").agg(F.max("key")).collect())
    follows = [(key, to) for (_, key), (to, _) in zip(heads, heads[1:])] + [(heads[-1][1], heads[0][0])] if heads else []
    follows = spark.createDataFrame(follows, "key long, to int")
    ghosts = rows.join(F.broadcast(follows), "key").select("doc_id", "text", "key", F.col("to").alias("bkt"), F.lit(True).alias("ghost"))  # MAX_BUCKETS rows
    parts = max(partitions(spark), min(buckets, -(-size // PARTITION_BYTES)))
    every = bucketed(rows).withColumn("ghost", F.lit(False)).unionByName(ghosts).repartition(parts, "bkt")
    order = W.partitionBy("bkt").orderBy("ghost", F.desc("key"), "text")
    return (every.withColumns({"following": F.lead("text").over(order), "rid": F.row_number().over(order)})
            .where("not ghost").select("bkt", "rid", "doc_id", "text", "following")), parts


_KEYS = ("bkt", "rid", "pair", "pages")
#: Places of what was recovered: digests of the first version only, and of the second only.
_GONE, _COME = -1, -2


def _cells(pairs: DataFrame, salt: int = 0) -> DataFrame:
    """Subtracted cells of rows (bkt, rid, pair, pages, mine, theirs): (cell, own, n, x, check)."""
    signed = F.concat(F.transform("mine", lambda d: F.struct(d.alias("d"), F.lit(1).alias("n"))),
                      F.transform("theirs", lambda d: F.struct(d.alias("d"), F.lit(-1).alias("n"))))
    units = pairs.select(*_KEYS, F.inline(signed))
    placed = units.select(*_KEYS, F.explode(F.array(*(_place(F.col("d"), t, F.col("pages"), salt) for t in range(3)))).alias("cell"),
                          F.lit(0).cast("long").alias("own"), "n", F.col("d").alias("x"), _check(F.col("d")).alias("check"))
    return _added(placed)


def _added(cells: DataFrame) -> DataFrame:
    total = cells.groupBy(*_KEYS, "cell", "own").agg(F.sum("n").cast("int").alias("n"), F.bit_xor("x").alias("x"), F.bit_xor("check").alias("check"))
    return total.where("cell < 0 or n <> 0 or x <> 0 or check <> 0")


def _peeled(cells: DataFrame, salt: int = 0, digests: bool = False) -> DataFrame:
    """After all rounds: what is left of the cells, and at the places ``_GONE`` and ``_COME`` how many digests were recovered.

    With ``digests`` each recovered digest has a row, as ``own``.
    """
    none = F.lit(0).cast("long")
    for k in range(ROUNDS):
        table = F.floor(F.col("cell") / CELLS) % 3
        alone = (F.col("cell") >= 0) & (table == k % 3) & (F.abs("n") == 1) & (F.col("check") == _check(F.col("x")))
        kept = F.struct("cell", "own", "n", "x", "check")
        taken = [F.struct(_place(F.col("x"), t, F.col("pages"), salt).alias("cell"), none.alias("own"), (-F.col("n")).alias("n"), F.col("x"), F.col("check"))
                 for t in range(3)]
        found = F.struct(F.when(F.col("n") > 0, _GONE).otherwise(_COME).cast("long").alias("cell"), (F.col("x") if digests else none).alias("own"),
                         F.lit(1).alias("n"), none.alias("x"), none.alias("check"))
        cells = _added(cells.select(*_KEYS, F.inline(F.when(alone, F.array(kept, *taken, found)).otherwise(F.array(kept)))))
    return cells


def _differences(pairs: DataFrame, salt: int = 0) -> DataFrame:
    """(bkt, rid, pair, gone, come, left): digests recovered on each side, and cells that could not be emptied."""
    def at(place: int) -> Column:
        return F.coalesce(F.sum(F.when(F.col("cell") == place, F.col("n"))), F.lit(0))

    return _peeled(_cells(pairs, salt), salt).groupBy("bkt", "rid", "pair").agg(at(_GONE).alias("gone"), at(_COME).alias("come"),
                                                                             F.count_if(F.col("cell") >= 0).alias("left"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each row of docs (doc_id, text)."""
    size = F.length("text")
    rows, parts = _versions(docs)
    rows = rows.withColumn("edited", F.concat(F.expr("left(text, length(text) - cast(floor(length(text) / 3) as int))"),
                                           F.expr("left(following, cast(floor(length(text) / 3) as int))")))
    rows = rows.select("bkt", "rid", "doc_id", size.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
                       paragraph_digests(F.col("text")).alias("mine"), paragraph_digests(F.col("edited")).alias("edited"),
                       paragraph_digests(F.col("following")).alias("next"))
    stored = stored_in_buckets(rows, "bkt", parts, "paragraphs")
    versions = F.array(F.struct(F.lit(0).alias("pair"), F.col("edited").alias("theirs")), F.struct(F.lit(1).alias("pair"), F.col("next").alias("theirs")))
    both = stored.select("bkt", "rid", "mine", F.inline(versions))

    def sized(df: DataFrame, factor: int) -> DataFrame:
        return df.withColumn("pages", factor * F.greatest(pages_of(F.col("mine")), pages_of(F.col("theirs"))))

    solved, tries = spool(_differences(sized(both, 1)), "peeled"), 0
    while not (failed := spool(solved.where("left > 0").select("bkt", "rid", "pair"), "unsolved")).isEmpty():
        tries += 1  # other cells each time: two digests that share all of theirs part sooner or later
        again = _differences(sized(both.join(failed, ["bkt", "rid", "pair"], "left_semi"), 4**tries), tries)
        solved = spool(solved.where("left = 0").union(again), "peeled")
    wide = solved.groupBy("bkt", "rid").agg(*(F.max(F.when(F.col("pair") == p, F.struct("gone", "come"))).alias(f"p{p}") for p in (0, 1)))
    out = stored.select("bkt", "rid", "doc_id", "n_chars", "edited_sha256", "mine", "edited").join(wide.hint("merge"), ["bkt", "rid"], "left")

    def likeness(p: str) -> Column:
        every = F.size("mine") + F.coalesce(F.col(f"{p}.come"), F.lit(0))
        return F.when(every == 0, F.lit(1.0)).otherwise((F.size("mine") - F.coalesce(F.col(f"{p}.gone"), F.lit(0))) / F.greatest(every, F.lit(1)))

    return out.select("doc_id", "n_chars", "edited_sha256", printed(F.col("mine")).alias("fingerprint"), printed(F.col("edited")).alias("edited_fingerprint"),
                      likeness("p0").alias("near_edited"), likeness("p1").alias("near_next"))
