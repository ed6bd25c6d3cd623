"""Near copies by SimHash in pieces, verified on shingles.

At a Jaccard similarity of 0.8 two fingerprints differ in about 15 % of their bits, too many
for a ball around a whole fingerprint. A long fingerprint is therefore cut into pieces, each
piece emits its ball of variants within half a small radius, and texts that share a variant
of some piece are candidates. There are as many pieces as let nearly all such pairs meet,
and a piece has as many bits as keep chance meetings rare at the table's size.

Where many texts share a variant, each first meets a few. What is then connected needs no
further pairs. Of the rest, all pairs of a variant are compared where it has up to 12 texts.
The texts of larger variants are joined without regard to variants, by the rarest of the
shingles that set them apart from what their neighbours have in common; that is exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from musterroll.llm.common import free_name, raw, word_runs
from musterroll.llm.components import components
from musterroll.operators.heat import small_side
from musterroll.session import written

SEED = 42
#: Bits of the sketch that goes along with a variant.
_SKETCH = 32
#: Texts of a variant that a text meets in the first step, besides the smallest.
_BEFORE = 3
#: Up to so many texts of a variant all meet in the second step.
_DIRECT = 12
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, width: int) -> np.ndarray:
    """Distinct hashes of the ``width``-word shingles in lower case; fewer words are one."""
    held: list[bytes] = []
    found: list[np.ndarray] = []
    for new in word_runs(raw(text).lower()):
        words = held + new
        hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + width]), SEED) for i in range(len(words) - width + 1)]
        found.append(np.unique(np.array(hashes, dtype=np.uint64)))
        held = words[len(words) - min(len(words), width - 1) :]
    if held and not any(map(len, found)):
        found.append(np.array([xxhash.xxh64_intdigest(b" ".join(held), SEED)], dtype=np.uint64))
    return np.unique(np.concatenate(found)) if found else np.empty(0, dtype=np.uint64)


def fingerprint(hashes: np.ndarray, lanes: int) -> np.ndarray:
    """``lanes`` times 64 bits (0 or 1): the majority of the bits of the mixed hashes."""
    if not len(hashes):
        return np.zeros(64 * lanes, dtype=np.uint8)
    ones = np.zeros(64 * lanes, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 14):
        some = hashes[at : at + (1 << 14)]
        for lane in range(lanes):
            mixed = (some ^ np.uint64(lane * 0x632BE59B)) * _ODD
            mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            mixed ^= mixed >> np.uint64(32)
            bits = np.unpackbits(mixed.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones[64 * lane : 64 * lane + 64] += bits.sum(axis=0, dtype=np.int64)
    return (2 * ones > len(hashes)).astype(np.uint8)


def jaccard(left: np.ndarray, right: np.ndarray) -> float:
    """Of two sets of shingles; two empty ones are equal."""
    both = len(np.intersect1d(left, right, assume_unique=True))
    either = len(left) + len(right) - both
    return both / either if either else 1.0


def plan_pieces(rows: int, similarity: float, recall: float) -> tuple[int, int]:
    """Bits of a piece and how many pieces, for ``rows`` different texts.

    A chance text shares a given variant with probability (bits + 1) / 2^bits per text. Two
    texts at ``similarity`` meet in a piece if at most two of its bits differ.
    """
    bits = 12
    while rows * (bits + 1) > 2**bits and bits < 60:
        bits += 1
    differ = math.acos(2 * similarity / (1 + similarity)) / math.pi
    meet = sum(math.comb(bits, k) * differ**k * (1 - differ) ** (bits - k) for k in range(3))
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet)))


def _meetings(classes: DataFrame, bits: int, pieces: int, differ: float) -> DataFrame:
    """``variant``, ``at``, ``size``, ``sketch``, ``others`` (met in the first step) and ``crowded``.

    ``classes`` has one row per different text: its number ``at``, its number of shingles and
    its fingerprint. Texts of a variant are ordered by their number of shingles and each
    meets the few before it and the smallest, so a group of n gives 4 n pairs at most. A
    sketch of 32 further bits goes along and drops most chance meetings on the spot. A
    variant is crowded if it has texts that do not all meet; all rows of it are kept.
    """
    width = bits * pieces

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights = np.left_shift(np.int64(1), np.arange(bits, dtype=np.int64))
        for batch in batches:
            packed = np.frombuffer(b"".join(batch["fp"]), dtype=np.uint8).reshape(len(batch), -1)
            whole = np.unpackbits(packed, axis=1)
            values = whole[:, :width].reshape(len(batch), pieces, bits).astype(np.int64) @ weights
            sketch = np.ascontiguousarray(packed[:, -_SKETCH // 8 :]).view(np.uint32).ravel().astype(np.int64)
            yield pd.DataFrame({"at": batch["at"], "size": batch["size"], "sketch": sketch, "values": list(values)})

    cut_rows = classes.select("at", "size", "fp").mapInPandas(cut, "at bigint, size int, sketch bigint, values array<bigint>")
    piece = cut_rows.select("at", "size", "sketch", F.posexplode("values").alias("piece", "value"))
    masks = F.array(*[F.lit(m).cast("bigint") for m in [0, *(1 << b for b in range(bits))]])
    variants = piece.select("at", "size", "sketch", "piece", "value", F.explode(masks).alias("mask"))
    # The number of the piece goes above its bits.
    variant = F.col("value").bitwiseXOR(F.col("mask")) + F.shiftleft(F.col("piece").cast("bigint"), bits)
    variants = variants.select("at", "size", "sketch", variant.alias("variant"))
    order = Window.partitionBy("variant").orderBy("size", "at")
    own = F.struct("at", "sketch")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    others = F.array(*[F.lag(own, n).over(order) for n in range(1, _BEFORE + 1)], F.first(own).over(order))
    met = variants.select("variant", "at", "size", "sketch", others.alias("others"), (F.count("at").over(whole) > _BEFORE + 2).alias("crowded"))
    near = F.filter("others", lambda o: (o["at"] != F.col("at")) & _near(F.col("sketch"), o["sketch"], differ))
    met = met.withColumn("others", F.array_distinct(F.transform(near, lambda o: o["at"])))
    return met.where("crowded or size(others) > 0")


def _near(left: Column, right: Column, differ: float) -> Column:
    return F.bit_count(left.bitwiseXOR(right)) <= _most_bits(differ, _SKETCH)


def _mixed(met: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of crowded variants whose texts are not all one group after the first step.

    ``root`` names a text's group, ``most`` the group with most rows of the variant, which
    are ``n_most``, and ``n`` counts all rows of the variant.
    """
    rows = met.where("crowded").select("variant", "at", "size", "sketch")
    rows = rows.join(roots.withColumnRenamed("node", "at"), "at", "left").withColumn("root", F.coalesce("root", "at"))
    rows = written(rows, "crowded")
    groups = rows.groupBy("variant", "root").agg(F.count("at").alias("n"))
    top = groups.groupBy("variant").agg(F.max(F.struct("n", "root")).alias("top"), F.count("root").alias("roots"), F.sum("n").alias("n"))
    top = top.where("roots > 1").select("variant", F.col("top.root").alias("most"), F.col("top.n").alias("n_most"), "n")
    return written(rows.join(top, "variant"), "mixed")


def _across(mixed: DataFrame, differ: float, similarity: float) -> DataFrame:
    """Pairs of the smaller crowded variants that are not in one group.

    Of a variant, the texts of the group that has most of its rows are left out on one side;
    no pair across groups has both ends in it. A text with less than the share of the
    other's shingles cannot be similar.
    """
    rows = mixed.where(F.col("n") <= _DIRECT).select("variant", "at", "size", "sketch", "root", "most")
    left = rows.where("root <> most").select("variant", *[F.col(c).alias(f"{c}_l") for c in ("at", "size", "sketch", "root")])
    pairs = left.join(rows, "variant").where(
        (F.col("root_l") != F.col("root")) & _near(F.col("sketch_l"), F.col("sketch"), differ)
        & (F.least("size_l", "size") >= similarity * F.greatest("size_l", "size") - 1e-6))
    return _ordered(pairs, "at_l", "at").distinct()


def _ordered(pairs: DataFrame, left: str, right: str) -> DataFrame:
    return pairs.select(F.least(left, right).alias("a"), F.greatest(left, right).alias("b"))


def _hubs(mixed: DataFrame) -> DataFrame:
    """``at``, ``size``, ``root`` and ``hub`` of the texts of larger variants.

    The hub is the group that a text shares most rows of its variants with, each variant
    counted by the group that has most of its rows.
    """
    rows = mixed.where(F.col("n") > _DIRECT)
    led = rows.groupBy("at", "size", "root", "most").agg(F.sum("n_most").alias("n"))
    return led.groupBy("at", "size", "root").agg(F.max_by("most", F.struct("n", "most")).alias("hub"))


def _spaces(sets: DataFrame, ratio: float, similarity: float) -> DataFrame:
    """Each text's ``items`` twice: what sets it apart from the centre of its hub, and all its shingles.

    A hub's centre holds the shingles of more than half of its group's texts. Two texts of a
    hub differ in the same shingles as their items do. Space -1 has the whole sets, for texts
    of different hubs. Only texts of different ``kind`` are to meet: groups within a hub, hubs
    in space -1. Two texts x and y are similar if and only if x and y differ in (x + y) / ratio
    shingles at most; with e = ratio * items - shingles that asks for (e of x + e of y) /
    (2 * ratio) common items. ``fewest`` is the least number that any partner leaves.
    """
    led = sets.join(sets.select(F.col("hub").alias("root")).distinct(), "root", "left_semi")
    counts = led.select("root", F.explode("tokens").alias("token")).groupBy("root", "token").agg(F.count("*").alias("n"))
    centres = counts.join(led.groupBy("root").agg(F.count("*").alias("texts")), "root").where("2 * n > texts")
    centres = centres.groupBy("root").agg(F.collect_list("token").alias("centre")).withColumnRenamed("root", "hub")
    around = sets.join(centres, "hub", "left").withColumn("centre", F.coalesce("centre", F.array().cast("array<bigint>")))
    apart = F.concat(F.array_except("tokens", "centre"), F.array_except("centre", "tokens"))
    around = around.select(F.col("hub").alias("space"), "at", "size", "root", F.col("root").alias("kind"), apart.alias("items"))
    whole = sets.select(F.lit(-1).cast("bigint").alias("space"), "at", "size", "root", F.col("hub").alias("kind"), F.col("tokens").alias("items"))
    both = around.union(whole).withColumn("d", F.size("items")).withColumn("e", ratio * F.col("d") - F.col("size"))
    both = written(both, "spaces")
    low = both.where("space >= 0").groupBy("space").agg(F.min(F.struct("e", "at", "root")).alias("low"))
    both = both.join(low, "space", "left")
    least = F.coalesce("low.e", (ratio - 1) * similarity * F.col("size"))
    return both.withColumn("fewest", _common(F.col("e"), least, ratio))


def _common(left: Column, right: Column, ratio: float) -> Column:
    return F.greatest(F.lit(1), F.ceil((left + right) / (2 * ratio) - 1e-6))


def _crossings(hubs: DataFrame, docs: DataFrame, classes: DataFrame, width: int, similarity: float) -> DataFrame:
    """Pairs that connect what similar texts of different groups connect, found without variants.

    Texts near the centre of a hub, by sum of their distances, are surely similar; one pair
    with the nearest text stands for all of these. All other similar pairs have items in
    common, one of them among the rarest of either text: with items in one order, what comes
    after the first common one bounds the common ones. Items of one kind of texts only are
    never common to a pair in question and go first.
    """
    ratio = (1 + similarity) / max(1 - similarity, 1e-9)

    @F.pandas_udf("array<bigint>")
    def cut(texts: pd.Series) -> pd.Series:
        return pd.Series([shingles(t, width).view(np.int64) for t in texts], dtype=object)

    texts = _texts_of(docs, classes, hubs.select("at"))
    sets = written(hubs.join(texts, "at").withColumn("tokens", cut("text")).drop("text"), "sets")
    spaces = _spaces(sets, ratio, similarity)
    sure = _ordered(spaces.where("e + low.e <= 1e-6 and root <> low.root").withColumn("other", F.col("low.at")), "at", "other")
    items = spaces.select("space", "at", "kind", "d", "fewest", F.explode("items").alias("item"))
    often = items.groupBy("space", "item").agg(F.count("*").alias("n"), F.min("kind").alias("low"), F.max("kind").alias("high"))
    shared = items.join(often.where("low < high").select("space", "item", "n"), ["space", "item"])
    own = Window.partitionBy("space", "at")
    place = F.col("d") - F.count("*").over(own) + F.row_number().over(own.orderBy("n", "item")) - 1
    shared = shared.withColumn("place", place).where("place + fewest <= d").select("space", "item", "at", "place")
    shared = shared.join(spaces.select("space", "at", "size", "root", "kind", "d", "e"), ["space", "at"])
    shared = written(shared, "shared")
    kinds = shared.groupBy("space", "item", "kind").agg(F.count("*").alias("n"))
    kinds = kinds.groupBy("space", "item").agg(F.max_by("kind", F.struct("n", "kind")).alias("most"), F.count("*").alias("n"))
    left = shared.join(kinds.where("n > 1").drop("n"), ["space", "item"]).where("kind <> most").drop("most")
    left = left.withColumnsRenamed({c: f"{c}_l" for c in left.columns if c not in ("space", "item")})
    common = _common(F.col("e_l"), F.col("e"), ratio)
    pairs = left.join(shared, ["space", "item"]).where(
        "kind_l <> kind and root_l <> root and e_l + e > 1e-6").where(
        (F.col("place_l") + common <= F.col("d_l")) & (F.col("place") + common <= F.col("d"))
        & (F.least("size_l", "size") >= similarity * F.greatest("size_l", "size") - 1e-6))
    return written(sure.union(_ordered(pairs, "at_l", "at")).distinct(), "crossings")


def _close(pairs: DataFrame, classes: DataFrame, differ: float, whole_bits: int) -> DataFrame:
    """The pairs whose whole fingerprints agree in most bits."""

    @F.pandas_udf("int")
    def distance(left: pd.Series, right: pd.Series) -> pd.Series:
        two = [np.frombuffer(b"".join(s), dtype=np.uint8).reshape(len(s), -1) for s in (left, right)]
        return pd.Series(np.bitwise_count(two[0] ^ two[1]).sum(axis=1, dtype=np.int32)) if len(left) else pd.Series([], dtype="int32")

    prints = classes.select("at", "fp")
    both = pairs.join(prints.withColumnsRenamed({"at": "a", "fp": "fp_a"}), "a").join(
        prints.withColumnsRenamed({"at": "b", "fp": "fp_b"}), "b")
    return both.where(distance("fp_a", "fp_b") <= _most_bits(differ, whole_bits)).select("a", "b")


def _lanes(bits: int, pieces: int) -> int:
    return -(-(bits * pieces + _SKETCH) // 64)


def _most_bits(differ: float, bits: int) -> int:
    """More than so many of the bits differ in one of a thousand pairs at most."""
    return math.ceil(differ * bits + 3.2 * math.sqrt(differ * (1 - differ) * bits))


def _texts_of(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """``at`` and text of the classes in the first two columns: a text is only read where it is compared."""
    ends = pairs.columns[:2]
    needed = pairs.select(F.explode(F.array(*ends)).alias("at")).distinct().join(classes.select("at", "first", "body"), "at")
    needed = written(needed, "needed")
    found = docs.join(small_side(needed, needed.count()), (docs["doc"] == needed["first"]) & (F.xxhash64(docs["text"]) == needed["body"]))
    return written(found.groupBy("at").agg(F.first("text").alias("text")), "compared")


def _similar(pairs: DataFrame, texts: DataFrame, left: str, right: str, width: int, least: float) -> DataFrame:
    """The pairs whose texts have at least the similarity."""

    @F.pandas_udf("boolean")
    def alike(one: pd.Series, other: pd.Series) -> pd.Series:
        return pd.Series([jaccard(shingles(a, width), shingles(b, width)) >= least for a, b in zip(one, other, strict=True)], dtype=bool)

    both = pairs.join(texts.withColumnsRenamed({"at": left, "text": "text_l"}), left)
    both = both.join(texts.withColumnsRenamed({"at": right, "text": "text_r"}), right)
    return both.where(alike("text_l", "text_r")).select(*pairs.columns)


def near_copies(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, similarity: float = 0.8, recall: float = 0.93
) -> DataFrame:
    """``doc``, ``body`` and ``head``, the document that stands for it, for all rows with an id.

    A document stands for another if their shingles are alike by ``similarity`` at least;
    texts with the same words stand or fall together, and of those the smallest id is the
    one that may stand. Groups are what verified pairs connect; a member that is not like
    the group's head itself is its own head. ``body`` is a hash of the text.
    """
    rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc"), F.col(text).alias("text"))

    # The size of the table decides on the bits, and counting it needs no text.
    bits, pieces = plan_pieces(rows.count(), similarity, recall)
    lanes = _lanes(bits, pieces)

    @F.pandas_udf("struct<node: bigint, size: int, fp: binary>")
    def printed(texts: pd.Series) -> pd.DataFrame:
        nodes, sizes, prints = [], [], []
        for text in texts:
            nodes.append(xxhash.xxh64_intdigest(b" ".join(raw(text).lower().split()), SEED) - (1 << 63))
            own = shingles(text, width)
            sizes.append(len(own))
            prints.append(np.packbits(fingerprint(own, lanes)).tobytes())
        return pd.DataFrame({"node": nodes, "size": sizes, "fp": prints}, columns=["node", "size", "fp"])

    named = rows.withColumn("p", printed("text")).select("doc", F.xxhash64("text").alias("body"), "p.*")
    named = written(named, "named")
    classes = named.groupBy("node").agg(
        F.min("doc").alias("first"), F.min_by("body", F.struct("doc", "body")).alias("body"), F.first("size").alias("size"), F.first("fp").alias("fp"))
    # Written, so that the numbers stay; they are shorter than hashes where rows are many.
    classes = written(classes.withColumn("at", F.monotonically_increasing_id()), "classes")
    differ = math.acos(2 * similarity / (1 + similarity)) / math.pi
    met = written(_meetings(classes, bits, pieces, differ), "met")
    first = met.select("at", F.explode("others").alias("other")).select(F.least("at", "other").alias("a"), F.greatest("at", "other").alias("b"))
    pairs = written(_close(first.distinct(), classes, differ, 64 * lanes), "pairs")
    links = written(_similar(pairs, _texts_of(rows, classes, pairs), "a", "b", width, similarity), "similar")
    roots = components(links, "a", "b")
    mixed = _mixed(met, roots)
    rest = _close(_across(mixed, differ, similarity).join(pairs, ["a", "b"], "left_anti"), classes, differ, 64 * lanes)
    hubs = written(_hubs(mixed), "hubs")
    if not hubs.isEmpty():
        rest = rest.union(_crossings(hubs, rows, classes, width, similarity).join(pairs, ["a", "b"], "left_anti")).distinct()
    rest = written(rest, "pairs")
    if not rest.isEmpty():
        more = written(_similar(rest, _texts_of(rows, classes, rest), "a", "b", width, similarity), "similar")
        roots = roots if more.isEmpty() else components(links.union(more), "a", "b")
    roots = roots.withColumnRenamed("node", "at")
    # The head of a group is the class of its smallest document.
    groups = classes.join(roots, "at").select("root", "at", "first")
    heads = groups.groupBy("root").agg(F.min_by("at", "first").alias("head_at"), F.min("first").alias("head"))
    members = written(groups.join(heads, "root").where("at <> head_at").select("at", "head_at", "head"), "members")
    alike = _similar(members, _texts_of(rows, classes, members), "at", "head_at", width, similarity).select("at", "head")
    final = classes.join(alike, "at", "left").select("node", F.coalesce("head", "first").alias("head"))
    return named.select("doc", "body", "node").join(final, "node").select("doc", "body", "head")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stand for themselves among near copies (see ``near_copies``).

    Rows with a null id cannot be told apart and stay. Of rows that share an id, the first
    by length and text stays. Texts without words are alike, so one of them stays; an empty
    table gives no rows. Columns are those of ``docs``.
    """
    own, nth = (free_name(docs, c) for c in ("own_doc", "nth_of_doc"))
    found = near_copies(docs, doc_id, text, **options).where("doc = head").select(F.col("doc").alias(own)).distinct()
    kept = docs.join(found, docs[doc_id] == found[own], "left_semi")
    order = Window.partitionBy(F.col(doc_id)).orderBy(F.length(F.col(text)).desc_nulls_last(), F.col(text))
    kept = kept.withColumn(nth, F.row_number().over(order)).where(F.col(nth) == 1).drop(nth)
    return kept.unionByName(docs.where(F.col(doc_id).isNull()))
