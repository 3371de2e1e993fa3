"""N-gram Jaccard join: a blocked sparse product of the incidence matrix.

Rows of the matrix are classes (documents with the same columns are one class),
columns word n-grams (by 64-bit hash). An entry of the product is the overlap of
two classes; only entries that may reach the bound of their sizes are formed.

Bounds. Classes of sizes n and m are linked if they share at least
ceil(t (n + m) / (1 + t)) columns. If the columns of all classes are put in one
order, two linked classes meet in the first n - ceil(t n) + 1 columns of each:
only these entries of the incidence matrix take part in finding candidates, and
one at rank r leaves at most n - r columns to share, which bounds the size of
the partner. Entries in the earlier half of this prefix can meet any linked
class; a later one only meets classes that have the column in their earlier half.

Order. Columns that more than ``HOT`` classes put forward come last, the rarer
ones of them first; all others are ordered by hash. Every class puts forward its
first columns by hash and some to spare; one that has too few others among them
puts forward all. So a text of many shared passages is found by what few others
have, and a column of a template that very many classes share makes no pairs of
those that differ enough elsewhere.

Large groups. Pairs within a column's group aren't all formed: each class first
meets one class of its group, the one nearest to what all share; what links then is one component, and after that
only classes outside the group's largest component meet others. If that is still
much more than the entries, they first meet another one, up to ``TURNS`` times.
No link between components can be lost.

Product. A parity bitmap of each class, whose Hamming distance never exceeds the
number of columns that differ, discards candidates first; of classes with more
columns than its bits, a sketch with a bit for each column does so again. For the
others, columns are made of their texts again (``docs`` must give the same rows
each time: only columns put forward at first are kept) and cut into blocks (ranges
of hashes of about ``RANGE`` columns), and overlaps are counted block by block and
summed for each pair: the first block alone drops pairs that the remaining columns
can't lift to the bound. No row ever holds more than one block of two classes.

What stays quadratic: classes that have hardly any column which fewer than
``HOT`` classes share, that share such columns in the earlier half of their
prefix, and yet aren't linked. They meet pair by pair (cheaply, by sizes, ranks
and bitmaps).

Defined results: words are lower-cased (A-Z only) runs of what isn't ASCII white
space. With fewer words than ``width`` the whole sequence is one n-gram; without
words, or null, a document has no n-grams and is linked with nothing. Copies
(also rows that repeat an id) are linked. Rows with a null id take part; a
component's id is the least id that isn't null. Very long texts are one row of
many blocks. Extra columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import components, discard, narrowed, sliced, written

#: Longs of a parity bitmap; words whose hashes a worker keeps.
BITMAP, CACHE = 8, 100_000
#: Classes from which on a column is ordered behind others; columns that each class puts forward to spare, besides a quarter.
HOT, SPARE = 128, 8
#: Times, at most, that groups meet one of their classes before the rest meets, and pairs for each entry from which on they do so again.
TURNS, MANY = 4, 128
#: Bits of the filter of shared columns (a table of 262,144 rows, 4 MB).
COLUMN_FILTER_BITS = 1 << 24
#: Columns of a block of the product, about.
RANGE = 1024
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = WordHashes()


def columns_of(text: str | None, width: int) -> np.ndarray:
    """The sorted hashes of a text's distinct n-grams."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=1 + len(words))], np.uint64) if words else np.zeros(0, np.uint64)
    if len(_WORDS) > CACHE:
        _WORDS.clear()
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    n = len(words) - width + 1
    out = h[:n]
    for i in range(1, width):
        out = mixed(out * _A + h[i : i + n] + np.uint64(i))
    return np.unique(out)


def class_key(columns: bytes) -> int:
    """The number of the class of all texts with these columns."""
    return xxhash.xxh3_64_intdigest(columns) - (1 << 63)


def sketch(h: np.ndarray) -> np.ndarray:
    """Parities of the numbers of columns that fall on each of the bits: a power
    of two, at least one for each column and those of a bitmap."""
    size = max(BITMAP * 64, 1 << max(0, len(h) - 1).bit_length())
    bits = np.bincount((mixed(h ^ _B) % np.uint64(size)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def folded(of: np.ndarray) -> np.ndarray:
    """A sketch, folded to ``BITMAP`` longs."""
    return np.bitwise_xor.reduce(of.reshape(-1, BITMAP), axis=0)


def bitmap(h: np.ndarray) -> np.ndarray:
    """Parities of the numbers of columns that fall on each of the bits."""
    return folded(sketch(h))


class Bounds:
    """What a similarity of at least ``num`` / ``den`` asks of sizes, also as SQL."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def needed(self, n: int, m: int) -> int:
        """The least overlap of linked classes of sizes n and m."""
        return -(-self.num * (n + m) // (self.num + self.den))

    def prefix(self, n: int) -> int:
        """In how many of its first columns a class of size n meets all linked ones."""
        return n - -(-self.num * n // self.den) + 1

    def first(self, n: int) -> int:
        """How many columns a class of size n puts forward at first."""
        return min(n, self.prefix(n) + self.prefix(n) // 4 + SPARE)

    def prefix_sql(self) -> str:
        return f"(n - (({self.num} * n + {self.den - 1}) div {self.den}) + 1)"

    def needed_sql(self) -> str:
        return f"(({self.num} * (na + nb) + {self.num + self.den - 1}) div {self.num + self.den})"

    def early_sql(self) -> str:
        """Whether an entry at ``rank`` of a class of size ``n`` can meet a class of the same size."""
        return f"({self.num + self.den} * (n - rank) >= {2 * self.num} * n)"

    def reached_sql(self) -> str:
        """Whether classes that meet at ``ra`` and ``rb`` can share enough after it."""
        return f"least(na - ra, nb - rb) >= {self.needed_sql()}"

    def close_sql(self) -> str:
        """Whether bitmaps allow a link."""
        apart = " + ".join(f"bit_count(a{i} ^ b{i})" for i in range(BITMAP))
        return f"{apart} <= na + nb - 2 * {self.needed_sql()}"

    def alike_sql(self) -> str:
        """Whether sketches ``sa`` and ``sb`` allow a link; the longer one is folded."""
        halved = (f"if(size({x}) > size({y}), zip_with(slice({x}, 1, size({y})), slice({x}, size({y}) + 1, size({y})), (p, q) -> p ^ q), {x})" for x, y in (("sa", "sb"), ("sb", "sa")))
        apart = f"aggregate(zip_with({next(halved)}, {next(halved)}, (p, q) -> bit_count(p ^ q)), 0, (s, c) -> s + c)"
        return f"(greatest(size(sa), size(sb)) > 2 * least(size(sa), size(sb)) OR {apart} <= na + nb - 2 * {self.needed_sql()})"


_PASS = pa.schema([("doc_id", pa.int64()), ("ref", pa.int64()), ("n", pa.int64()), ("key", pa.int64()), ("cols", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64())), *((f"b{i}", pa.int64()) for i in range(BITMAP))])


def _lists(of: list[np.ndarray | None]) -> pa.ListArray:
    """Longs of each row; rows without any are null."""
    ends = np.cumsum([0, *(0 if x is None else len(x) for x in of)])
    own = [x.view(np.int64) for x in of if x is not None]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(own) if own else np.zeros(0, np.int64)), mask=pa.array([x is None for x in of], pa.bool_()))


def _first_pass(width: int, bounds: Bounds):
    """Each text's class. The columns that it puts forward at first, and the
    sketch of a class that a bitmap is too small for, come with the first text of
    the class that a task meets."""

    def run(batches):
        met: set[int] = set()
        for batch in sliced(batches, 64):
            n, key, bits, cols, sketches = [], [], [], [], []
            for text in batch.column(2).to_pylist():
                h = columns_of(text, width)
                n.append(len(h))
                key.append(class_key(h.tobytes()))
                own = sketch(h)
                bits.append(folded(own))
                known = key[-1] in met or not len(h)
                if not known:
                    met.add(key[-1])
                cols.append(None if known else h[: bounds.first(len(h))])
                sketches.append(None if known or len(own) == BITMAP else own)
            longs = (pa.array(np.ascontiguousarray(b)) for b in np.stack(bits).T)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(key, pa.int64()), _lists(cols), _lists(sketches), *longs], schema=_PASS)
        _WORDS.clear()

    return run


def _columns(width: int):
    """All columns of texts (the first column) that are of the class named by the
    second, once for each task and row of the others."""

    def run(batches):
        met = set()
        for batch in sliced(batches, 64):
            at, cols = [], []
            for i, (text, *own) in enumerate(zip(*(c.to_pylist() for c in batch.columns))):
                if tuple(own) not in met and class_key((h := columns_of(text, width)).tobytes()) == own[0]:
                    met.add(tuple(own))
                    at.append(i)
                    cols.append(h)
            if at:
                names = [*batch.schema.names[1:], "cols"]
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at)) for c in batch.columns[1:]), _lists(cols)], names=names)
        _WORDS.clear()

    return run


_BLOCKS = pa.schema([("key", pa.int64()), ("cuts", pa.int32()), ("blk", pa.int32()), ("part", pa.list_(pa.int64()))])


def blocks_of(columns: np.ndarray, cuts: int) -> np.ndarray:
    """Where the ``cuts`` (a power of two) ranges of hashes end in sorted columns."""
    if cuts == 1:
        return np.array([len(columns)])
    return np.append(np.searchsorted(columns, np.arange(1, cuts, dtype=np.uint64) << np.uint64(65 - cuts.bit_length())), len(columns))


def _blocks(batches):
    for batch in sliced(batches, 64):
        lists, offsets = batch.column(2), batch.column(2).offsets.to_numpy()
        flat = lists.values.to_numpy().view(np.uint64)
        for i, (key, cuts) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            own = flat[offsets[i] : offsets[i + 1]]
            ends = np.append(0, blocks_of(own, cuts)).astype(np.int32)
            parts = pa.ListArray.from_arrays(pa.array(ends), pa.array(own.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array([key] * cuts, pa.int64()), pa.array([cuts] * cuts, pa.int32()), pa.array(range(cuts), pa.int32()), parts], schema=_BLOCKS)


_BITS = [f"b{i}" for i in range(BITMAP)]


class Join:
    """One join: the pass over the texts, the candidates and the product."""

    def __init__(self, docs: DataFrame, *, width: int, num: int, den: int, id_col: str = "doc_id", text_col: str = "text"):
        self.bounds, self.width, self.frames = Bounds(num, den), width, []
        own = F.col(id_col).cast("long")
        self.texts = texts = docs.select(own.alias("doc_id"), F.coalesce(own, F.xxhash64(text_col)).alias("ref"), F.col(text_col).alias("text"))
        shape = "doc_id long, ref long, n long, key long, cols array<long>, sketch array<long>, " + ", ".join(f"{b} long" for b in _BITS)
        self.rows = self.write(texts.mapInArrow(_first_pass(width, self.bounds), shape), "rows")
        #: key, rep (least id), ref (of a row with columns), n, bitmap: each class with columns
        firsts = (F.first(c).alias(c) for c in ("n", *_BITS))
        self.classes = self.write(self.rows.filter("n > 0").groupBy("key").agg(F.min("doc_id").alias("rep"), F.min(F.when(F.col("cols").isNotNull(), F.col("ref"))).alias("ref"), *firsts), "classes")

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """An intermediate result, which ``close`` removes if nothing has before."""
        self.frames.append(written(df, name))
        return self.frames[-1]

    def close(self) -> None:
        """Removes what the join has written; its lazy results can't be read any more."""
        discard(*self.frames)

    def columns(self, wanted: DataFrame) -> DataFrame:
        """The rows of ``wanted`` (key, ref, ...) and ``cols``, from texts that
        are read again; only those of their refs are shuffled."""
        others = [c for c in wanted.columns if c != "ref"]
        held = narrowed(self.texts.select("ref", "text"), wanted, "ref").select("text", *others)
        return held.mapInArrow(_columns(self.width), ", ".join(f"{c} {held.schema[c].dataType.simpleString()}" for c in others) + ", cols array<long>")

    def first_sql(self) -> str:
        """How many columns a class of size ``n`` puts forward at first."""
        p = self.bounds.prefix_sql()
        return f"least(n, {p} + {p} div 4 + {SPARE})"

    def entries(self) -> DataFrame:
        """key, n, pos, col: what each class puts forward at first."""
        return self.rows.filter("cols IS NOT NULL").select("key", "n", F.posexplode("cols").alias("pos", "col"))

    def groups(self) -> tuple[DataFrame, DataFrame]:
        """(key, n, pos, col) of columns that several classes put forward, and
        (col, df) of those that too many do."""
        entries = self.entries()
        # written, so that the join can split a column that very many classes have
        shared = self.write(entries.groupBy("col").agg(F.min("key").alias("low"), F.max("key").alias("high")).filter("low <> high").select("col"), "shared")
        found = self.write(narrowed(entries, shared, "col", COLUMN_FILTER_BITS).distinct().select("key", "n", "pos", "col"), "groups")
        whole = self.classes.limit(0).select("key")
        while True:
            hot = self.write(found.groupBy("col").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") > HOT), "hot")
            hots = found.join(hot.select("col"), "col", "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("hots"), F.first("n").alias("n"))
            lacking = hots.filter(f"{self.first_sql()} < n AND {self.first_sql()} - hots < {self.bounds.prefix_sql()}").join(whole, "key", "left_anti")
            lacking = self.write(lacking.select("key", "n").join(self.classes.select("key", "ref"), "key"), "lacking")
            if lacking.isEmpty():
                return found, hot
            added = self.write(self.columns(lacking).select("key", "n", F.posexplode("cols").alias("pos", "col")).distinct(), "added")
            met = narrowed(entries, added.select("col").distinct(), "col", COLUMN_FILTER_BITS).select("key", "n", "pos", "col")
            before, found = found, self.write(found.unionByName(met).unionByName(added).distinct(), "groups")
            discard(before, added, hot)
            whole = whole.unionByName(lacking.select("key"))

    def prefixes(self) -> DataFrame:
        """col, key, n, rank, early: the entries in which linked classes meet,
        ranked in the order of columns."""
        found, hot = self.groups()
        marked = found.join(hot, "col", "left")
        own, last = Window.partitionBy("key"), F.col("df").isNotNull()
        before = F.count("df").over(own.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        tail = F.col("n") - F.count("df").over(own) + F.row_number().over(own.orderBy(F.col("df").asc_nulls_last(), "col")) - 1
        ranked = marked.withColumn("rank", F.when(last, tail).otherwise(F.col("pos") - before)).filter(f"rank < {self.bounds.prefix_sql()}")
        # only a class that has put forward all of its columns gets ranks for hot ones that are below its prefix
        return ranked.select("col", "key", "n", "rank", F.expr(self.bounds.early_sql()).alias("early"))

    def links(self, pairs: DataFrame) -> DataFrame:
        """Of ``pairs`` (root, key, n and ref of a and b, cuts) those whose
        overlap reaches the bound, as (a, b) of their roots."""
        needed = self.bounds.needed_sql()
        sides = (pairs.select(F.col(s).alias("key"), F.col(f"ref_{s}").alias("ref"), "cuts") for s in "ab")
        wanted = next(sides).unionByName(next(sides)).distinct()
        blocks = self.write(self.columns(wanted).select("key", "cuts", "cols").mapInArrow(_blocks, "key long, cuts int, blk int, part array<long>").dropDuplicates(["key", "cuts", "blk"]), "blocks")

        def product(of: DataFrame, own: DataFrame) -> DataFrame:
            x, y = (own.select(F.col("key").alias(s), "cuts", "blk", F.col("part").alias(f"x{s}")) for s in "ab")
            return of.join(x, ["a", "cuts", "blk"]).join(y, ["b", "cuts", "blk"]).withColumn("both", F.expr("size(array_intersect(xa, xb))"))

        pair = ["root_a", "root_b", "a", "b", "na", "nb"]
        first = product(pairs.withColumn("blk", F.lit(0)), blocks.filter("blk = 0")).filter(f"both + least(na - size(xa), nb - size(xb)) >= {needed}")
        first = self.write(first.select(*pair, "cuts", "both"), "first")
        rest = product(first.filter("cuts > 1").drop("both").withColumn("blk", F.expr("explode(sequence(1, cuts - 1))")), blocks.filter("blk > 0"))
        sums = rest.select(*pair, "both").unionByName(first.filter("cuts > 1").select(*pair, "both")).groupBy(*pair).agg(F.sum("both").cast("int").alias("both"))
        done = first.filter("cuts = 1").select(*pair, "both").unionByName(sums)
        links = self.write(done.filter(f"both >= {needed}").select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct(), "links")
        discard(blocks, first)
        return links

    def met_one(self, left: DataFrame, turn: int) -> DataFrame:
        """Each class of a column's group and one of them: first that with the
        fewest columns before this one, as it has hardly any that the others don't
        share; in later turns any early one."""
        order = F.struct(F.col("rank") if turn == 0 else (~F.col("early")).cast("long"), F.xxhash64("key", F.lit(turn)))
        hub = left.groupBy("col").agg(F.min_by(F.struct("key", "root", "n", "rank"), order).alias("hub"))
        names = {"root_a": "hub.root", "root_b": "root", "a": "hub.key", "b": "key", "na": "hub.n", "nb": "n", "ra": "hub.rank", "rb": "rank"}
        return left.join(hub, "col").filter("root <> hub.root").select(*(F.col(c).alias(s) for s, c in names.items()))

    def met_rest(self, left: DataFrame, largest: DataFrame) -> DataFrame:
        """Each class outside the largest component of a column's group and the
        others of it; of two entries one must be early."""
        tagged = left.join(largest.select("col", "largest"), "col").withColumn("out", F.expr("root <> largest"))
        x = tagged.filter("out").withColumn("met", F.expr("explode(if(early, array(true, false), array(true)))")).select("col", "met", *(F.col(c).alias(s) for s, c in {"root_a": "root", "a": "key", "na": "n", "ra": "rank"}.items()))
        y = tagged.select("col", F.col("early").alias("met"), "out", *(F.col(c).alias(s) for s, c in {"root_b": "root", "b": "key", "nb": "n", "rb": "rank"}.items()))
        return x.join(y, ["col", "met"]).filter("root_a <> root_b AND (NOT out OR a < b)").drop("col", "met", "out")

    def largest(self, left: DataFrame) -> DataFrame:
        """col, largest, pairs: the largest component of each column's group that
        may still link others, and how many pairs that makes."""
        by_root = left.groupBy("col", "root").agg(F.count(F.lit(1)).alias("rows"), F.max("early").alias("early"))
        groups = by_root.groupBy("col").agg(F.max(F.struct("rows", "root")).alias("most"), F.sum("rows").alias("rows"), F.max("early").alias("has_early"))
        return self.write(groups.filter("has_early AND rows > most.rows").select("col", F.col("most.root").alias("largest"), F.expr("(rows - most.rows) * rows").alias("pairs")), "largest")

    def pairs(self, met: DataFrame) -> DataFrame:
        """The pairs that sizes, ranks and bitmaps allow, and their number of blocks."""
        met = met.filter(self.bounds.reached_sql()).select("root_a", "root_b", "a", "b", "na", "nb").distinct()
        x, y = (self.classes.select(F.col("key").alias(s), F.col("ref").alias(f"ref_{s}"), *(F.col(b).alias(f"{s}{i}") for i, b in enumerate(_BITS))) for s in "ab")
        cuts = F.expr(f"cast(pow(2, greatest(0, ceil(log2(greatest(na, nb) / {RANGE}.0)))) as int)").alias("cuts")
        close = met.join(x, "a").join(y, "b").filter(self.bounds.close_sql()).select("root_a", "root_b", "a", "b", "na", "nb", "ref_a", "ref_b", cuts)
        close = self.write(close, "close")
        large = f"least(na, nb) > {BITMAP * 64}"
        sides = (close.filter(large).select(F.col(s).alias("key"), F.col(f"ref_{s}").alias("ref")) for s in "ab")
        wanted = next(sides).unionByName(next(sides)).distinct()
        held = self.rows.filter("sketch IS NOT NULL").select("ref", F.col("key").alias("__key"), "sketch")
        sketches = self.write(narrowed(held, wanted, "ref").filter("key = __key").select("key", "sketch").dropDuplicates(["key"]), "sketches")
        x, y = (sketches.select(F.col("key").alias(s), F.col("sketch").alias(f"s{s}")) for s in "ab")
        alike = close.filter(large).join(x, "a").join(y, "b").filter(self.bounds.alike_sql()).select(close.columns)
        found = self.write(close.filter(f"NOT {large}").unionByName(alike), "pairs")
        discard(close, sketches)
        return found

    def components(self) -> DataFrame:
        """node, root: the component of each class that links with another."""
        kept = len(self.frames)
        left, found, turn = self.write(self.prefixes().withColumn("root", F.col("key")), "left"), [], 0
        discard(*self.frames[kept:-1])
        while True:
            pairs = self.pairs(self.met_one(left, turn))
            links = self.links(pairs)
            discard(pairs)
            found.append(links)
            joined = components(links).select(F.col("node").alias("root"), F.col("root").alias("least"))
            moved = left.join(joined, "root", "left").withColumn("root", F.coalesce("least", "root")).drop("least")
            before, moved = left, self.write(moved, "left")
            largest = self.largest(moved)
            left = self.write(moved.join(largest.select("col"), "col", "left_semi"), "left")
            discard(before, moved)
            todo = largest.agg(F.coalesce(F.sum("pairs"), F.lit(0))).first()[0]
            turn += 1
            if turn == TURNS or todo <= MANY * max(1, left.count()):
                break
        if todo:
            found.append(self.links(self.pairs(self.met_rest(left, largest))))
        edges = found[0]
        for more in found[1:]:
            edges = edges.unionByName(more)
        return components(edges)

    def result(self) -> DataFrame:
        """doc_id, n_shingles, component_id, one row for each input row."""
        named = self.components().withColumnRenamed("node", "key").join(self.classes.select("key", "rep"), "key")
        least = named.groupBy("root").agg(F.min("rep").alias("component"))
        joined = named.join(least, "root").select("key", "component")
        # written, so that the join can split a class of very many copies
        ids = self.write(self.classes.select("key", "rep").join(joined, "key", "left").select("key", F.coalesce("component", "rep").alias("component")), "ids")
        own = self.rows.select("doc_id", "n", "key")
        return own.join(ids, "key", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def similar(docs: DataFrame, *, width: int = 5, num: int = 80, den: int = 100, **columns) -> DataFrame:
    """doc_id, n_shingles, component_id under links of at least num / den. The
    result is written, so that the columns of all texts can go."""
    join = Join(docs, width=width, num=num, den=den, **columns)
    found = written(join.result(), "similar")
    join.close()
    return found


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=3, num=90, den=100)
