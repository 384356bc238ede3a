"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

Rows of the matrix are texts, columns are hashed word n-grams. The product of the matrix with its
transpose holds all overlaps; it is formed only where a size bound lets a pair reach the
threshold:

1. *Rows.* Each document becomes its sorted n-gram hashes; documents with equal sets share one
   row (their class), so copies are never multiplied with each other.
2. *Column blocks.* With threshold p/q two linked sets a, b differ in at most
   (q-p)(|a|+|b|)/(q+p) columns. Columns are dealt into one block more than the largest such
   difference in a band of sizes; then a linked pair agrees in a whole block. Pairs that agree in
   none are discarded without being formed. (An empty block agrees with every empty block and so
   says nothing: one spare block is added, and only rows with more empty blocks than spare ones
   also publish these.)
3. *Products.* Rows that agree in a block are multiplied first with one pivot of the block (the
   row that agrees most often), then with a second one from outside its largest component; overlaps
   are accumulated and compared exactly. Rows that this links are one component and need
   no further product. Where a block still holds several components, rows are compared by their
   differences from the pivot: linked ones must share rare columns of these (``_by_differences``).
   So no link that joins components is lost, and no group of near copies is expanded into pairs.
4. *Components* by large-star / small-star rounds over the links, each written to the shared
   folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bankspark.llm.components import components
from bankspark.llm.words import mix, shingle, word_hashes
from bankspark.session import cut_lineage

_U = np.uint64
#: Spare column blocks against empty ones.
SPARE = 1


class SizeBounds:
    """What the threshold ``numerator / denominator`` implies for set sizes (exact integers)."""

    def __init__(self, numerator: int, denominator: int):
        if not 0 < numerator <= denominator:
            raise ValueError("the threshold lies above 0 and at most at 1")
        self.p, self.q = numerator, denominator

    def band(self, n: int) -> int:
        """Sizes fall into bands [low, high); a linked pair is in one band or two neighbours."""
        k, low = 0, 1
        while True:
            high = self.next_low(low)
            if n < high:
                return k
            k, low = k + 1, high

    def next_low(self, low: int) -> int:
        # two steps of the threshold wide, so that most rows belong to one band only
        return max(low + 1, low * self.q * self.q // (self.p * self.p) + 1)

    def largest(self, n: int) -> int:
        """Largest size that can be linked with size n."""
        return n * self.q // self.p

    def difference(self, a: int, b: int) -> int:
        return (self.q - self.p) * (a + b) // (self.q + self.p)


def _bands(bounds: SizeBounds, up_to: int) -> tuple[list[int], list[int]]:
    """Lower ends of the bands and the number of column blocks of each."""
    lows, blocks = [1], []
    while lows[-1] <= up_to:
        high = bounds.next_low(lows[-1])
        a = high - 1
        blocks.append(bounds.difference(a, bounds.largest(a)) + 1 + SPARE)
        lows.append(high)
    return lows, blocks


def _block_sums(grams: np.ndarray, band: int, blocks: int, spare: int) -> np.ndarray:
    """One signature per column block: a hash of the row's columns in that block."""
    scrambled = mix(grams + _U(0x632BE59BD9B4E019))
    at = (scrambled >> _U(33)).astype(np.int64) % blocks
    sums = np.zeros(blocks, np.uint64)
    np.add.at(sums, at, scrambled)
    signature = mix(sums ^ mix(np.arange(blocks, dtype=np.uint64) + _U(band << 32)))
    filled = np.bincount(at, minlength=blocks) > 0
    return signature[filled] if blocks - int(filled.sum()) <= spare else signature


def incidence(documents: DataFrame, size: int, bounds: SizeBounds) -> DataFrame:
    """(doc_id, row, n, key, blocks) per document: its id and row fingerprint, set size, fingerprint of the set, signatures."""
    p, q = bounds.p, bounds.q

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = SizeBounds(p, q)
        lows, counts = _bands(own, 64)
        for batch in batches:
            words, _, at = word_hashes(batch.column(2))
            n, key, signatures = [], [], []
            for i in range(batch.num_rows):
                grams = np.unique(shingle(words[at[i] : at[i + 1]], size))
                n.append(len(grams))
                if not len(grams):
                    key.append(None)
                    signatures.append(None)
                    continue
                key.append(int(mix(grams).sum(dtype=np.uint64).view(np.int64)))
                if own.difference(len(grams), own.largest(len(grams))) == 0 and own.difference(len(grams), len(grams)) == 0:
                    signatures.append(None)  # so small that only equal sets are linked
                    continue
                if len(grams) >= lows[-1]:
                    lows, counts = _bands(own, 2 * len(grams))
                band = int(np.searchsorted(lows, len(grams), "right")) - 1
                spare = counts[band] - 1 - own.difference(len(grams), own.largest(len(grams)))
                own_band = _block_sums(grams, band, counts[band], spare)
                parts = [own_band]
                if band and own.largest(lows[band] - 1) >= len(grams):
                    # the larger row of a pair whose smaller one lies in the band below
                    parts.append(_block_sums(grams, band - 1, counts[band - 1], SPARE))
                signatures.append(np.concatenate(parts).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(n, pa.int64()), pa.array(key, pa.int64()), pa.array(signatures, pa.list_(pa.int64()))],
                names=["doc_id", "row", "n", "key", "blocks"],
            )

    return documents.select("doc_id", "row", "text").mapInArrow(rows, "doc_id long, row long, n long, key long, blocks array<long>")


def _overlaps(pairs: DataFrame, rows: DataFrame, size: int, bounds: SizeBounds) -> DataFrame:
    """The linked ones among ``pairs`` (a, b): overlaps of whole rows, compared exactly."""
    p, q = bounds.p, bounds.q

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}

        def fill(keys: list[int], texts: pa.Array) -> None:
            new = [i for i, k in enumerate(keys) if k not in known]
            new = list({keys[i]: i for i in new}.values())
            words, _, at = word_hashes(texts.take(pa.array(new, pa.int64())))
            for j, i in enumerate(new):
                known[keys[i]] = np.unique(shingle(words[at[j] : at[j + 1]], size))

        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            known = {k: known[k] for k in {*a, *b} if k in known}
            fill(a, batch.column(2))
            fill(b, batch.column(3))
            keep = []
            for x, y in zip(a, b, strict=True):
                s, t = known[x], known[y]
                if len(s) > len(t):
                    s, t = t, s
                place = np.searchsorted(t, s)
                place[place == len(t)] = 0
                both = int((t[place] == s).sum())
                keep.append(q * both >= p * (len(s) + len(t) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    left = rows.select(F.col("key").alias("a"), F.col("text").alias("text_a"))
    right = rows.select(F.col("key").alias("b"), F.col("text").alias("text_b"))
    return (
        pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(product, "a long, b long")
    )


def jaccard_components(
    documents: DataFrame, size: int = 3, numerator: int = 90, denominator: int = 100,
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of ``documents``.

    Two rows are linked when the Jaccard similarity of their sets of ``size``-word shingles is at
    least numerator / denominator; ``component_id`` is the smallest id that links reach, itself
    included. Words are runs of characters other than ASCII white space, A-Z in lower case; a text
    of fewer words is one shingle. A null or wordless text has size 0 and is its own component.
    Repeated rows are returned as often as they occur; a row without an id takes part, and its
    component has the smallest id that is not null (null if there is none). Other columns are
    ignored. Sets are compared by 64-bit hashes of their shingles.
    """
    source = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    table, named = _classes(source.withColumn("row", _fingerprint(source)), size, SizeBounds(numerator, denominator))
    first = named.groupBy("component").agg(F.min("first.doc_id").alias("component_id"))
    return (
        table.select("doc_id", "n", "key")
        .join(named.join(first, "component").select("key", "component_id"), "key", "left")
        .select(
            "doc_id", F.col("n").alias("n_shingles"),
            F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        )
    )


def one_of_each_component(
    documents: DataFrame, size: int = 3, numerator: int = 90, denominator: int = 100,
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """The rows of ``documents`` with exactly one per component of ``jaccard_components``.

    It is the row with the smallest id, one without an id only if the component has no other, then
    the one with the smallest fingerprint over all columns; of equal rows one stays. A row without
    shingles (null or wordless text) is its own component and stays, as often as it occurs.
    """
    text = F.col(text_column)
    packed = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("kept"), _fingerprint(documents).alias("row"))
    source = packed.select(F.col(f"kept.`{id_column}`").cast("long").alias("doc_id"), F.col(f"kept.`{text_column}`").alias("text"), "row")
    _, named = _classes(source, size, SizeBounds(numerator, denominator))
    stay = cut_lineage(named.groupBy("component").agg(F.min("first").alias("first")).select("first.row"))
    kept = packed.join(stay, "row").dropDuplicates(["row"]).select("kept.*")
    return kept.unionByName(documents.where(text.isNull() | ~text.rlike(r"[^\x20\x09-\x0D]")))


def _fingerprint(rows: DataFrame) -> Column:
    """A 64-bit hash of all columns; a null is told from a value that is left out."""
    columns = [F.col(f"`{c}`") for c in rows.columns]
    return F.xxhash64(*columns, *[c.isNull() for c in columns])


def _classes(source: DataFrame, size: int, bounds: SizeBounds) -> tuple[DataFrame, DataFrame]:
    """(doc_id, row, n, key, blocks) per row of ``source`` (doc_id, text, row), and (key, first, component)
    per class: its first row as (no_id, doc_id, row), and the component that links reach."""
    table = cut_lineage(incidence(source, size, bounds))
    classes = table.where("key is not null").groupBy("key").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first"), F.min("n").alias("n")
    )

    # Column blocks in which at least two different rows agree.
    posting = table.where("blocks is not null").select("key", F.explode("blocks").alias("block"))
    agreed = (
        posting.groupBy("block").agg(F.min("key").alias("low"), F.max("key").alias("high"))
        .where("low <> high").select("block")
    )
    shared = cut_lineage(posting.join(agreed, "block").distinct())
    counted = shared.join(shared.groupBy("block").agg(F.count("*").alias("rows")), "block")
    weight = counted.groupBy("key").agg(F.sum("rows").alias("weight"))
    rows = cut_lineage(
        source.join(
            classes.join(weight.select("key", "weight"), "key").select("first.row", "key", "n", "weight"), "row"
        ).select("key", "n", "weight", "text")
    )
    rows = _only_own_text(rows, size)
    ranked = rows.select("key", "n", "weight")

    weighed = cut_lineage(shared.join(ranked, "key"))
    pivots = cut_lineage(weighed.groupBy("block").agg(F.max(F.struct("weight", "key")).alias("top")).select("block", F.col("top.key").alias("pivot")))
    pairs = weighed.join(pivots, "block").where("key <> pivot").select(F.col("key").alias("a"), F.col("pivot").alias("b")).distinct()
    links = cut_lineage(_overlaps(cut_lineage(pairs), rows, size, bounds))
    label = components(links, "a", "b")

    # A second pivot for blocks that still hold several components, from outside the largest one.
    grouped = _undecided(weighed, label)
    largest = grouped.groupBy("block", "component").agg(F.count("*").alias("rows")).groupBy("block").agg(
        F.max(F.struct("rows", "component")).alias("top")
    ).select("block", F.col("top.component").alias("top"))
    second = grouped.join(largest, "block").where("component <> top").groupBy("block").agg(
        F.max(F.struct("weight", "key", "component")).alias("s")
    ).select("block", F.col("s.key").alias("b"), F.col("s.component").alias("own"))
    pairs = grouped.join(second, "block").where("component <> own").select(F.col("key").alias("a"), "b").distinct()
    links = links.unionByName(cut_lineage(_overlaps(cut_lineage(pairs), rows, size, bounds)))
    label = components(links, "a", "b")

    grouped = _undecided(weighed, label)
    rest = cut_lineage(_by_differences(grouped.join(pivots, "block"), rows, size, bounds))
    links = links.unionByName(cut_lineage(_overlaps(rest, rows, size, bounds)))
    label = components(links, "a", "b")

    named = cut_lineage(
        classes.join(label.withColumnRenamed("node", "key"), "key", "left")
        .select("key", "first", F.coalesce("component", "key").alias("component"))
    )
    return table, named


def _undecided(weighed: DataFrame, label: DataFrame) -> DataFrame:
    """(block, key, n, weight, component) of blocks whose rows are not all in one component."""
    grouped = cut_lineage(
        weighed.join(label.withColumnRenamed("node", "key"), "key", "left")
        .select("block", "key", "n", "weight", F.coalesce("component", "key").alias("component"))
    )
    several = grouped.groupBy("block").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    return grouped.join(several.where("low <> high").select("block"), "block")


def _by_differences(grouped: DataFrame, rows: DataFrame, size: int, bounds: SizeBounds) -> DataFrame:
    """Pairs (a, b) of different components that may still be linked, without forming a block's pairs.

    With pivot v, x and y differ in |x^y| = |Dx| + |Dy| - 2 |Dx & Dy| columns, where Dx = x^v. If x
    and y are linked but not both linked to v, |Dx| + |Dy| exceeds the largest difference of a
    linked pair, so their differences share at least t columns, t half of the excess. In an order
    of columns by rarity, x and y then share one of the first |Dx| - t + 1 and |Dy| - t + 1.
    """
    p, q = bounds.p, bounds.q

    def differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = []
            for texts in (batch.column(4), batch.column(5)):
                words, _, at = word_hashes(texts)
                sets.append([np.unique(shingle(words[at[i] : at[i + 1]], size)) for i in range(batch.num_rows)])
            delta = [np.setxor1d(x, y, assume_unique=True).view(np.int64) for x, y in zip(*sets, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array([len(d) for d in delta], pa.int64()), pa.array(delta, pa.list_(pa.int64()))],
                names=["pivot", "key", "n", "component", "differing", "delta"],
            )

    members = cut_lineage(grouped.select("pivot", "key", "n", "component").distinct())
    texts = rows.select("key", "text")
    delta = cut_lineage(
        members.where("key <> pivot").join(texts, "key")
        .join(texts.select(F.col("key").alias("pivot"), F.col("text").alias("pivot_text")), "pivot")
        .select("pivot", "key", "n", "component", "text", "pivot_text")
        .mapInArrow(differences, "pivot long, key long, n long, component long, differing long, delta array<long>")
    )
    entry = delta.select("pivot", "key", "n", "component", "differing", F.explode("delta").alias("column"))
    counted = entry.groupBy("pivot", "column").agg(F.count("*").alias("rows"))
    ranked = entry.join(counted, ["pivot", "column"]).withColumn(
        "place", F.row_number().over(Window.partitionBy("pivot", "key").orderBy("rows", "column"))
    )
    # no pair needs more places than the largest difference of a linked pair with the larger partner
    far = f"({q} - {p}) * (n + n * {q} div {p}) div ({q} + {p}) + 1"
    prefix = cut_lineage(ranked.where(f"rows > 1 and place <= {far}").drop("rows"))
    mixed = prefix.groupBy("pivot", "column").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    open_ = cut_lineage(prefix.join(mixed.select("pivot", "column"), ["pivot", "column"]))
    largest = open_.groupBy("pivot", "column", "component").agg(F.count("*").alias("rows")).groupBy("pivot", "column").agg(
        F.max(F.struct("rows", "component")).alias("top")
    ).select("pivot", "column", F.col("top.component").alias("top"))
    x = open_.join(largest, ["pivot", "column"]).where("component <> top")
    y = open_.select("pivot", "column", F.col("key").alias("b"), F.col("n").alias("m"), F.col("component").alias("other"), F.col("differing").alias("d"), F.col("place").alias("at"))
    excess = f"(differing + d - ({q} - {p}) * (n + m) div ({q} + {p}) + 1) div 2"
    return (
        x.join(y, ["pivot", "column"])
        .where("component <> other and (other = top or key < b)")
        .where(f"{q} * least(n, m) >= {p} * greatest(n, m)")
        .where(f"place <= differing - {excess} + 1 and at <= d - {excess} + 1")
        .select(F.least("key", "b").alias("a"), F.greatest("key", "b").alias("b")).distinct()
    )


def _only_own_text(rows: DataFrame, size: int) -> DataFrame:
    """Rows whose text has the fingerprint of their class (rows may be equal), once each."""

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, _, at = word_hashes(batch.column(3))
            keep = []
            for i, key in enumerate(batch.column(0).to_pylist()):
                grams = np.unique(shingle(words[at[i] : at[i + 1]], size))
                keep.append(len(grams) > 0 and int(mix(grams).sum(dtype=np.uint64).view(np.int64)) == key)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return cut_lineage(rows.mapInArrow(same, rows.schema).dropDuplicates(["key"]))
