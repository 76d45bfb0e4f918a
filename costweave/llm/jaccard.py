"""Exact n-gram Jaccard join of documents by a blocked sparse product of document by n-gram incidence.

A link needs `numerator * union <= denominator * overlap`, so a document of n grams misses at most
n - ceil(n * numerator / denominator) of them in any partner. Everything below follows from that bound:

1. Documents with equal gram sets are one class; only one document of a class goes on. Classes are linked, by the
   hash of their set; documents with several texts tie theirs together, and components are named by doc_id last.
2. Of the first grams of each document in a global order (as many as it may miss, and a twentieth more), a
   document with a partner shares more than a twentieth of the partner's size. Classes that share fewer of
   theirs with any other class are out. Tasks combine what they see before the shuffle.
3. The rest are taken with their whole sets. Grams that no second class has are dropped and counted. In order
   of rising frequency, partners share one of the first grams up to the bound; such grams tie classes into
   clusters, which hold every link.
4. Clusters are cut into blocks. The product of a block with itself, or with a block of another part, adds up
   overlaps over slices of the grams, stops where no pair can reach its bound, and returns a spanning forest
   of its links. A large cluster first meets some pivots; only classes that stay apart from its main component
   are multiplied with the other blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from costweave.llm import textops
from costweave.llm.shared import components, discard, free_name, maybe_in
from costweave.session import reuse

GRAM_WORDS = 5
SIMILARITY = (80, 100)  # numerator, denominator
EXTRA = 20  # a twentieth more grams than the bound asks for
TASK_BYTES = 8 << 20  # texts combined in a task before the shuffle
BLOCK = 512  # classes of a block
PIVOTS = 32  # classes of a large cluster that every block meets
SLICE = 4096  # grams multiplied at once
_U = np.uint64


def needed(n: int, numerator: int, denominator: int) -> int:
    """Least overlap of a set of n grams with a partner."""
    return -(-n * numerator // denominator)


def gram_sets(data: np.ndarray, offsets: np.ndarray, n: int):
    """The sorted distinct gram hashes of every row; a row of fewer than n words has one gram, an empty row none."""
    for low, high in textops.blocks(offsets, textops.BLOCK_BYTES):
        part = offsets[low : high + 1]
        words, row, _, _ = textops.word_hashes(data[part[0] : part[-1]], part - part[0])
        cuts = np.searchsorted(row, np.arange(len(part)))
        for first, last in zip(cuts[:-1], cuts[1:]):
            own = words[first:last]
            yield np.unique(textops.gram_hashes(own, min(n, len(own)))) if len(own) else own


def _marks(grams: np.ndarray) -> tuple[int, int]:
    """Two hashes that name a gram set."""
    one, two = textops.mix(grams), textops.mix(grams ^ _U(0x5851F42D4C957F2D))
    return int(one.sum().view(np.int64)), int(two.sum().view(np.int64))


def _sets(n: int):
    names = ["doc_id", "n_shingles", "mark", "mark2"]

    def run(batches):
        for batch in batches:
            data, offsets = textops.byte_column(batch.column(1))
            rows = [(len(g), *_marks(g)) for g in gram_sets(data, offsets, n)]
            columns = list(zip(*rows)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in columns)], names=names)
            textops.release()

    return run


def _first_grams(n: int, numerator: int, denominator: int):
    """Tasks: rows (k, mark, times): a gram and the class that has it (times 1), word that a gram has
    several classes (times 0), or how many grams of a class are known to have several (below 0)."""

    def flush(marks, grams):
        mark = np.repeat(np.array(marks, np.int64), [len(g) for g in grams])
        gram = np.concatenate(grams)
        order = np.lexsort((mark, gram))
        mark, gram = mark[order], gram[order]
        new_gram = np.concatenate([[True], gram[1:] != gram[:-1]])
        new = new_gram | np.concatenate([[True], mark[1:] != mark[:-1]])
        mark, gram, new_gram = mark[new], gram[new], new_gram[new]
        group = np.cumsum(new_gram) - 1
        shared = np.bincount(group)[group] > 1
        first = shared & new_gram
        second = np.concatenate([[False], first[:-1]])
        told = first | second
        known, times = np.unique(mark[shared], return_counts=True)
        k = np.concatenate([gram[~shared], gram[told], textops.mix(known.view(np.uint64))]).view(np.int64)
        return pa.RecordBatch.from_arrays([
            pa.array(k), pa.array(np.concatenate([mark[~shared], mark[told], known])),
            pa.array(np.concatenate([np.ones((~shared).sum(), np.int32), np.zeros(told.sum(), np.int32), -times.astype(np.int32)])),
        ], names=["k", "mark", "times"])

    def run(batches):
        marks, grams, size = {}, [], 0
        for batch in batches:
            textops.release()
            data, offsets = textops.byte_column(batch.column(0))
            for own, length in zip(gram_sets(data, offsets, n), np.diff(offsets)):
                if not len(own):
                    continue
                mark = _marks(own)[0]
                size += int(length)
                if mark not in marks:
                    marks[mark] = None
                    first = len(own) - needed(len(own), numerator, denominator) + 1 + len(own) // EXTRA
                    grams.append(own[:first])
                if size >= TASK_BYTES:
                    yield flush(list(marks), grams)
                    marks, grams, size = {}, [], 0
        if grams:
            yield flush(list(marks), grams)
        textops.release()

    return run


def _whole_sets(n: int):
    """Tasks: rows (mark, text) to (id, n, grams) of the texts whose grams have that mark."""

    def run(batches):
        for batch in batches:
            data, offsets = textops.byte_column(batch.column(1))
            for low, high in textops.blocks(offsets, textops.BLOCK_BYTES):
                part = offsets[low : high + 1]
                marks, sets = [], []
                texts = gram_sets(data[part[0] : part[-1]], part - part[0], n)
                for mark, own in zip(batch.column(0).slice(low, high - low).to_pylist(), texts):
                    if _marks(own)[0] == mark:  # else another text of the same doc_id
                        marks.append(mark)
                        sets.append(own.view(np.int64))
                flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
                ends = np.concatenate([[0], np.cumsum([len(g) for g in sets])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    pa.array(marks, pa.int64()), pa.array(np.diff(ends).astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                ], names=["id", "n", "grams"])
            textops.release()

    return run


def overlaps(left: list[np.ndarray], right: list[np.ndarray], need: np.ndarray) -> np.ndarray:
    """Overlap of every left with every right set, as an exact sparse product slice by slice.

    Ends early, with counts too low to reach it, once no pair can reach its `need`.
    """
    sets = left + right
    sizes = np.array([len(s) for s in sets])
    grams, place = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(place, kind="stable")
    row, place = row[order], place[order]
    found = np.zeros((len(left), len(right)), np.float32)
    rest = sizes.astype(np.float32)
    for low in range(0, len(grams), SLICE):
        a, b = np.searchsorted(place, [low, low + SLICE])
        part = np.zeros((len(sets), min(SLICE, len(grams) - low)), np.float32)
        part[row[a:b], place[a:b] - low] = 1
        found += part[: len(left)] @ part[len(left) :].T
        rest -= part.sum(axis=1)
        if not (found + np.minimum(rest[: len(left), None], rest[None, len(left) :]) >= need).any():
            break
    return found


def forest(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links (a matrix over left and right ids)."""
    rows, columns = np.nonzero(linked)
    parent: dict[int, int] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for a, b in zip(left[rows].tolist(), right[columns].tolist()):
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def _multiply(numerator: int, denominator: int):
    """Tasks: rows (cluster, block, other, part, id, n, grams) sorted by the first three to links (a, b).

    Part 0 is multiplied with part 1, and with itself where there is no part 1.
    """

    def links(held):
        zero, one = ([r for r in held if r[0] == part] for part in (0, 1))
        one = one or zero
        if not zero:
            return []
        out = []
        for low in range(0, len(zero), BLOCK):  # a block can be a little larger than BLOCK
            left = zero[low : low + BLOCK]
            nl, nr = (np.array([r[2] for r in x], np.float64) for x in (left, one))
            total = nl[:, None] + nr[None]
            # denominator * o >= numerator * (total - o); sizes too far apart can't reach it
            need = np.ceil(numerator * total / (numerator + denominator))
            need = np.where(np.minimum(nl[:, None], nr[None]) * denominator >= numerator * np.maximum(nl[:, None], nr[None]), need, np.inf)
            found = overlaps([r[3] for r in left], [r[3] for r in one], need).astype(np.float64)
            linked = (found >= need) & (denominator * found >= numerator * (total - found))
            out += forest(linked, np.array([r[1] for r in left]), np.array([r[1] for r in one]))
        return out

    def run(batches):
        held, last = [], None
        for batch in batches:
            textops.release()
            out = []
            keys = zip(*(batch.column(k).to_pylist() for k in range(3)))
            parts, ids, sizes = (batch.column(k).to_pylist() for k in (3, 4, 5))
            for k, key in enumerate(keys):
                if key != last:
                    out += links(held)
                    held, last = [], key
                held.append((parts[k], ids[k], sizes[k], np.asarray(batch.column(6)[k].values)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["a", "b"])
        if out := links(held):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["a", "b"])
        del held, out
        textops.release()

    return run


def _product(rows: DataFrame, numerator: int, denominator: int) -> DataFrame:
    dealt = rows.select("cluster", "block", "other", "part", "id", "n", "grams").repartition("cluster", "block", "other")
    dealt = dealt.sortWithinPartitions("cluster", "block", "other", "part", "id")
    return reuse(dealt.mapInArrow(_multiply(numerator, denominator), "a long, b long"))


def shared_cells(sets: DataFrame) -> DataFrame:
    """Rows (id, gram, times) of the grams that several rows of sets (id, grams) have."""
    # counted where the join needs them: with the same filter and columns on both sides they read one shuffle
    cells = sets.select("id", F.explode("grams").alias("gram")).where("id is not null and gram is not null").repartition("gram")
    often = cells.groupBy("gram").agg(F.count("*").alias("times"), F.max("id").alias("some"))
    return cells.join(often.where("times > 1 and some is not null").drop("some"), "gram")


def class_links(sets: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """Links (a, b) that connect what is linked among sets (id, n, grams): step 3 and 4."""
    sets = reuse(sets)
    shared = shared_cells(sets).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("times", "gram"))).alias("own"))
    bound = F.col("n") - F.ceil(F.col("n") * numerator / F.lit(denominator)) + 1 - (F.col("n") - F.size("own"))
    work = reuse(
        sets.select("id", "n").dropDuplicates(["id"]).join(shared, "id")  # one row an id
        .withColumn("bound", bound.cast("int")).where("bound > 0")
        .select("id", "n", F.col("own.gram").alias("grams"), F.expr("slice(own.gram, 1, bound)").alias("first"))
    )
    discard(sets)  # one gram array a class is stored at a time
    buckets = work.select("id", F.explode("first").alias("gram"))
    least = buckets.groupBy("gram").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least <> most")
    ties = buckets.join(least, "gram").select(F.col("id").alias("a"), F.col("least").alias("b"))
    clusters = components(ties).withColumnRenamed("component", "cluster")
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("size"))
    placed = work.drop("first").join(clusters, "id").join(sizes, "cluster").withColumn(
        "blocks", F.ceil(F.col("size") / BLOCK).cast("long")
    ).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    placed = reuse(placed.withColumns({"other": F.lit(-1).cast("long"), "part": F.lit(0)}))
    discard(work)
    large = placed.where("blocks > 1")
    pivot = F.pmod(F.xxhash64("id", F.lit(1)), F.greatest(F.floor(F.col("size") / PIVOTS), F.lit(1))) == 0
    pivots = large.where(pivot).withColumn("home", F.col("block")).withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    ).where("block <> home").drop("home")
    near = _product(placed.unionByName(pivots), numerator, denominator)
    if large.isEmpty():
        return near
    found = components(near)
    joined = large.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    members = joined.groupBy("cluster", "component").agg(F.count("*").alias("members"))
    main = members.groupBy("cluster").agg(F.max_by("component", F.struct("members", "component")).alias("main"))
    apart = joined.join(main, "cluster").where("component <> main")
    many = apart.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("others"))
    apart = apart.join(many, "cluster").withColumn("other", F.pmod(F.xxhash64("id", F.lit(2)), F.col("others")))
    ones = apart.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumn("part", F.lit(1))
    zeros = large.join(many, "cluster").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("others") - 1)))
    names = ["cluster", "block", "other", "part", "id", "n", "grams"]
    return near.unionByName(_product(zeros.select(names).unionByName(ones.select(names)), numerator, denominator))


def join_similar(docs: DataFrame, n: int = GRAM_WORDS, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links) of every row of docs (doc_id, text).

    Words are runs of bytes without blanks, A-Z lower-cased. NULL or blank texts have no grams and no links.
    Rows that share a doc_id count as one document that links wherever one of them does. A NULL doc_id links
    with nothing and has no component. Columns beyond doc_id and text are not read.
    """
    numerator, denominator = similarity
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = docs.where("doc_id is not null")
    sets = reuse(docs.mapInArrow(_sets(n), "doc_id long, n_shingles long, mark long, mark2 long"))
    key = ["n_shingles", "mark", "mark2"]
    classes = sets.where("n_shingles > 0").groupBy(*key).agg(F.min("doc_id").alias("head")).where("head is not null")
    cells = known.select("text").mapInArrow(_first_grams(n, numerator, denominator), "k long, mark long, times int")
    bucket = Window.partitionBy("k")
    seen = F.lag("mark").over(bucket.orderBy("mark", "times")).eqNullSafe(F.col("mark"))
    shares = cells.withColumns({"seen": seen, "beside": F.min("mark").over(bucket) != F.max("mark").over(bucket)}).where(
        "times < 0 or (times = 1 and beside and not seen)"
    ).groupBy("mark").agg(F.sum(F.abs("times")).alias("shares"))
    least = F.floor(F.ceil(F.col("n_shingles") * numerator / F.lit(denominator)) / EXTRA) + 1
    heads = reuse(classes.join(shares, "mark").where(F.col("shares") >= least).select(F.col("head").alias("doc_id"), "mark").distinct())
    likely = maybe_in(known, "doc_id", heads, "likely").where("likely")  # the other texts need no shuffle
    whole = likely.join(heads, "doc_id").select("mark", "text").mapInArrow(_whole_sets(n), "id long, n long, grams array<long>")
    # the classes of a document with several texts hang together
    own = sets.where("doc_id is not null and n_shingles > 0")
    several = own.groupBy("doc_id").agg(F.min("mark").alias("b"), F.max("mark").alias("most")).where("b <> most").drop("most")
    ties = own.join(several, "doc_id").select(F.col("mark").alias("a"), "b")
    found = components(class_links(whole, numerator, denominator).unionByName(ties)).withColumnRenamed("id", "mark")
    found = classes.join(found, "mark", "left").withColumn("component", F.coalesce("component", "mark"))
    least_head = reuse(found.groupBy("component").agg(F.min("head").alias("least")))
    named = found.join(least_head, "component").select(*key, F.col("least").alias("component"))
    own = sets.where("n_shingles > 0").join(named, key, "left").select("doc_id", "n_shingles", "component")
    blank = sets.where("n_shingles = 0").select("doc_id", "n_shingles")
    beside = own.join(blank.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component").alias("component"))
    own = own.unionByName(blank.join(beside, "doc_id", "left"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return own.select("doc_id", "n_shingles", component.alias("component_id"))


def keep_first(docs: DataFrame, n: int = GRAM_WORDS, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """docs without the rows whose component has a smaller doc_id; rows without doc_id or grams stay."""
    gone = reuse(join_similar(docs, n, similarity).where("doc_id <> component_id").select("doc_id").distinct())
    likely = free_name(docs, "_likely")
    marked = maybe_in(docs, "doc_id", gone, likely)
    stay = marked.where(~F.col(likely))  # all but a few of those that stay need no shuffle
    return stay.unionByName(marked.where(likely).join(gone, "doc_id", "left_anti")).select(*docs.columns)
