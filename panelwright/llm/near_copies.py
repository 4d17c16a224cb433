"""Near copies by word shingles: one document of each group of similar texts stays.

Two texts are near copies if the sets of their five-word shingles have a Jaccard similarity of 0.8 or
more. Candidates are compared by their whole shingle sets, whatever way they were found.

``one_of_each`` takes them from fingerprints, as in ``simhash``: texts whose fingerprints are linked by at most
RADIUS differing bits, over the grid on their bit counts, are a cell. Near copies may differ in more bits (at the
least similarity 9.7 of 64 on average), so all texts, whatever their cell, are then joined between groups by
prefixes of their shingles, which loses no pair. ``near_copies`` takes cells from BANDS bands of ROWS minimum hashes
(a pair at the least similarity shares none in 3 of 100,000 cases).

A group of many copies has too many pairs to look at. So the first rounds compare each text of a
cell with one text of it only, and of two near copies the larger name takes no part in later
rounds. What they link are groups; only links between groups are missing then. Texts of several
groups, dropped ones included, go to an exact join: by the prefixes of their shingles, the rarest
first: two near copies share one of the first few, while what makes a text differ from all others comes first
and matches nothing. Pairs within a group aren't made there. So all near copies (in ``near_copies``: that share a
cell) are in one group in the end, as if all of their pairs had been compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm.common import connected_components, stored
from panelwright.llm.rolling import MOST, Rolling, mixed
from panelwright.llm.simhash import components, majority

SHINGLE_WORDS = 5
#: Least similarity as a fraction: 4 / 5.
NEAR = (4, 5)
BANDS, ROWS = 20, 4
#: Differing bits of two fingerprints that link them. Chance neighbours in the grid cost less than more cells.
RADIUS = 5
CHANCE = 64
#: Texts, about, in which the commonest shingles are counted, and how many of these come last in prefixes. No result depends on them.
SAMPLED, COMMONEST = 10_000, 1 << 16
#: Bits of the filter in front of the join that looks up texts. No result depends on them.
FILTER_BITS = 1 << 23
#: Longs of a set's sketch, and sets of a shingle from which on sketches are compared. No result depends on them.
SKETCH, CROWDED = 8, 8
#: Rounds in which a cell's texts are compared with one of them.
ROUNDS = 3
#: Shingles whose hashes are held at once.
CHUNK = 256
#: Of the minimum hashes: odd factors and shifts, for the upper halves of shingles' hashes.
_DRAWN = np.random.default_rng(11).integers(0, 1 << 31, (2, BANDS * ROWS), np.uint32)
FACTORS, SHIFTS = _DRAWN[0] * np.uint32(2) + np.uint32(1), _DRAWN[1]
#: What the hashes of a shingle's words are combined with.
WORD_FACTOR = np.uint64(0x9FB21C651E98DF25)
#: Which bytes stand between words.
SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))


def row_key() -> Column:
    """128 bits of a row's ``doc_id`` and ``text``; never null. Only rows that agree in both share it."""
    id_part = F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("")).cast("binary")
    return F.unhex(F.md5(F.concat(id_part, F.lit("\0").cast("binary"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))))


def word_hashes(text: bytes) -> np.ndarray:
    """64 bits of each word, in order. Words stand between ASCII white space."""
    from xxhash import xxh64_intdigest

    buffer = np.frombuffer(text, np.uint8)
    inside = np.zeros(len(buffer) + 2, bool)
    inside[1:-1] = ~SPACE[buffer]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        base = starts[first]
        last = int(np.searchsorted(ends, base + MOST, "right"))
        if last == first:  # a word longer than the buffer of rolling hashes
            out[first] = xxh64_intdigest(text[base : ends[first]])
            last += 1
        else:
            part = slice(first, last)
            out[part] = Rolling(buffer[base : ends[last - 1]], seed=3).spans(starts[part] - base, ends[part] - starts[part])
        first = last
    return out


def shingle_set(text: bytes | None) -> np.ndarray:
    """The distinct shingles' hashes of the text without ASCII case, in order; fewer words are one shingle."""
    words = word_hashes((text or b"").lower())
    size = min(SHINGLE_WORDS, len(words))
    if not size:
        return words
    places = len(words) - size + 1
    out = np.full(places, size, np.uint64)
    for k in range(size):
        out *= WORD_FACTOR
        out += words[k : k + places]
    out = np.sort(mixed(out))
    new = np.ones(places, bool)
    np.not_equal(out[1:], out[:-1], out=new[1:])
    return out[new]


def set_name(shingles: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(shingles.tobytes())


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """One hash a band, which differs between bands; none of an empty set."""
    from xxhash import xxh64_intdigest

    if not len(shingles):
        return np.empty(0, np.uint64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, np.uint32)
    upper = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(upper), CHUNK):
        part = upper[at : at + CHUNK, None] * FACTORS
        part += SHIFTS
        np.minimum(least, part.min(axis=0), out=least)
    return np.array([xxh64_intdigest(b.tobytes(), k) for k, b in enumerate(least.reshape(BANDS, ROWS))], np.uint64)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Whether the shingles that belong to a bit are odd in number. Two sets have at least as many shingles that aren't common as they have different bits."""
    odd = np.bincount((shingles % np.uint64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.uint64), *parts]).view(np.int64)))


def described(
    docs: DataFrame, column: str, describe: Callable, more: tuple[str, ...] = (), bare: Callable | None = None, words: bool = False, sketches: bool = False
) -> DataFrame:
    """``doc_id``, columns of ``more``, ``same`` (the shingle set's name), ``n`` (its size), a list of longs of every row.

    ``bare`` is applied to the text's bytes first. With ``words`` there is a column ``size``, the words of the text as it was,
    with ``sketches`` a column ``bits``, the set's ``sketch``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):  # few sets at once
                part = batch.slice(at, 256)
                names, sizes, lists, counts, bits = [], [], [], [], []
                for t in part.column(len(more) + 1).cast(pa.binary()):
                    text = t.as_py() or b""
                    shingles = shingle_set(bare(text) if bare else text)
                    names.append(set_name(shingles))
                    sizes.append(len(shingles))
                    lists.append(describe(shingles))
                    if words:
                        counts.append(len(text.split()))
                    if sketches:
                        bits.append(sketch(shingles))
                made = [pa.array(np.array(names, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), _lists(lists)]
                yield pa.record_batch(
                    [*part.columns[:-1], *made, *([pa.array(counts, pa.int64())] if words else []), *([_lists(bits)] if sketches else [])],
                    ["doc_id", *more, "same", "n", column, *(["size"] if words else []), *(["bits"] if sketches else [])],
                )

    kept = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in ("doc_id", *more))
    return docs.select("doc_id", *more, "text").mapInArrow(
        run, f"{kept}, same long, n long, {column} array<long>" + (", size long" if words else "") + (", bits array<long>" if sketches else "")
    )


def sizes_fit(a: str, b: str) -> Column:
    """Whether sets of these sizes can be near copies."""
    return F.least(a, b) * NEAR[1] >= F.greatest(a, b) * NEAR[0]


def sketches_fit(a: str, b: str, n: str, m: str) -> Column:
    """Whether sets of these sketches and sizes can be near copies."""
    apart = sum((F.bit_count(F.col(a)[k].bitwiseXOR(F.col(b)[k])) for k in range(SKETCH)), F.lit(0))
    return apart * (NEAR[0] + NEAR[1]) <= (F.col(n) + F.col(m)) * (NEAR[1] - NEAR[0])


def can_be_first(n: str, at: str, m: str, behind: str) -> Column:
    """Whether what stands at these places of two sets can be the first thing common to near copies: enough of both follows."""
    needed = F.ceil(F.lit(NEAR[0]) * (F.col(n) + F.col(m)) / F.lit(NEAR[0] + NEAR[1]))
    return F.least(F.col(n) - F.col(at), F.col(m) - F.col(behind)) >= needed


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``a``, ``b`` and whether they are near copies, by their whole shingle sets."""
    a = sets.select(F.col("same").alias("a"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("same").alias("b"), F.col("shingles").alias("sb"))
    shared = F.size(F.array_intersect("sa", "sb"))
    whole = F.size("sa") + F.size("sb") - shared
    return pairs.join(a, "a").join(b, "b").select("a", "b", (shared * NEAR[1] >= whole * NEAR[0]).alias("near"))


def prefix_pairs(sets: DataFrame) -> DataFrame:
    """Pairs ``same``, ``other`` of sets that can be near copies: all of those that are, but for pairs within a ``group``, if there is such a column.

    Shingles are ordered by how many sets have them. Sets of n and m >= n shingles need ``(n + m) * 4 / 9`` in
    common; as n / m is at least 4 / 5, the first of these stands among the n - 8 n / 9 + 1 first ones of
    the smaller set and the m - 4 m / 5 + 1 first ones of the larger, with enough of both sets behind it.
    """
    near, of = F.lit(NEAR[0]), F.lit(NEAR[1])
    if "group" not in sets.columns:
        sets = sets.withColumn("group", F.col("same"))
    each = sets.select("same", "group", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    held = each.groupBy("shingle").agg(F.count("*").alias("held")).where("held > 1")
    ordered = each.join(held.hint("merge"), "shingle").groupBy("same", "group", "n").agg(F.sort_array(F.collect_list(F.struct("held", "shingle"))).alias("s"))
    # a set's shingles that no other set has come before all others: their number is enough
    ordered = ordered.withColumn("alone", F.col("n") - F.size("s"))
    probe = (F.col("n") - F.ceil(near * F.col("n") / of) + 1 - F.col("alone")).cast("int")
    firsts = ordered.select("same", "group", "n", "alone", F.posexplode(F.slice("s", F.lit(1), F.greatest(probe, F.lit(0)))).alias("k", "x"))
    firsts = firsts.select("same", "group", "n", (F.col("alone") + F.col("k")).alias("at"), F.col("x.shingle").alias("shingle"))
    return meeting(stored(firsts, "prefixes"), sets.select("same", "bits") if "bits" in sets.columns else None)


def meeting(firsts: DataFrame, bits: DataFrame | None = None) -> DataFrame:
    """Pairs ``same``, ``other`` of different groups that can be near copies, by the ``shingle`` at place ``at`` of their prefixes.

    Any order of the shingles does that is the same for all sets. Of a shingle's largest group no two sets meet: others are joined
    with all of its sets, so that about as many pairs are made as there are between groups. A pair meets only where a shingle can be the first
    that it has in common; where CROWDED sets have the shingle, and ``bits`` has the sets' sketches, these have to fit, too. What such pairs share of
    their prefixes is then counted. What else the sets share comes after the last of these in both and after the end of one prefix, so pairs
    with too few of them aren't near copies and don't come out. Each pair comes once.
    """
    near, of = F.lit(NEAR[0]), F.lit(NEAR[1])
    by_group = firsts.groupBy("shingle", "group").agg(F.count("*").alias("held"))
    several = by_group.groupBy("shingle").agg(F.max_by("group", F.struct("held", "group")).alias("major"), F.count("*").alias("groups"), F.sum("held").alias("held")).where("groups > 1")
    firsts = stored(firsts.join(several.select("shingle", "major", "held"), "shingle"), "prefixes")
    if bits is None:
        sketched = firsts.withColumn("bits", F.lit(None).cast("array<long>"))
    else:
        few = firsts.where(F.col("held") < CROWDED).withColumn("bits", F.lit(None).cast("array<long>"))
        sketched = few.unionByName(firsts.where(F.col("held") >= CROWDED).join(bits, "same"))
    minor = sketched.where("group <> major").select("shingle", "same", "group", "n", "at", "bits")
    other = sketched.select("shingle", F.col("same").alias("other"), F.col("group").alias("other_group"), F.col("n").alias("m"), F.col("at").alias("behind"), F.col("bits").alias("other_bits"), (F.col("group") == F.col("major")).alias("of_major"))
    once = F.col("of_major") | (F.col("same") < F.col("other"))  # two that are both of smaller groups meet twice
    fit = sizes_fit("n", "m") & can_be_first("n", "at", "m", "behind") & (F.col("bits").isNull() | sketches_fit("bits", "other_bits", "n", "m"))
    met = minor.join(other, "shingle").where((F.col("group") != F.col("other_group")) & once & fit)
    swap = F.col("same") > F.col("other")
    sides = [F.when(swap, F.col(b)).otherwise(F.col(a)).alias(a) for a, b in (("same", "other"), ("n", "m"))]
    sides += [F.when(swap, F.col(a)).otherwise(F.col(b)).alias(b) for a, b in (("same", "other"), ("n", "m"))]
    return sharing(stored(met.select(*sides).distinct(), "pairs"), firsts).select("same", "other")


def sharing(pairs: DataFrame, firsts: DataFrame) -> DataFrame:
    """The rows of ``pairs`` (``same``, ``other``, their sizes ``n`` and ``m``) whose prefixes have enough in common for near copies."""
    near, of = F.lit(NEAR[0]), F.lit(NEAR[1])
    names = pairs.select("same").union(pairs.select(F.col("other").alias("same"))).distinct()
    lists = firsts.join(names, "same", "left_semi").groupBy("same").agg(F.sort_array(F.collect_list(F.struct("at", "shingle"))).alias("s"))
    a = lists.select("same", F.col("s.at").alias("at"), F.col("s.shingle").alias("sa"))
    b = lists.select(F.col("same").alias("other"), F.col("s.at").alias("behind"), F.col("s.shingle").alias("sb"))
    both = pairs.join(a, "same").join(b, "other").withColumn("common", F.array_intersect("sa", "sb")).where(F.size("common") > 0)
    last = F.element_at("common", -1)  # the lists are in the order of all sets
    place = lambda at, among: F.element_at(at, F.array_position(among, last).cast("int"))
    left = F.least(F.col("n") - place("at", "sa"), F.col("m") - place("behind", "sb"))  # of the last one on
    # the last one that they share in their prefixes is counted in both; where a prefix ends, so many of its set are left
    most = F.size("common") + F.least(left - 1, F.greatest(F.ceil(near * F.col("n") / of), F.ceil(near * F.col("m") / of)) - 1)
    return both.where(most >= F.ceil(near * (F.col("n") + F.col("m")) / (near + of))).select(*pairs.columns)


def first_picks(firsts: DataFrame, bits: DataFrame) -> DataFrame:
    """Pairs ``same``, ``other`` of different groups that can be near copies: sets of a crowded shingle, each with one of them, stored.

    That is the set that has the fewest rarer ones, so it resembles most others. There are no more pairs than rows. ``group`` and
    ``into`` are the groups of both.
    """
    of = firsts.groupBy("shingle").agg(F.min(F.struct("at", "same", "n", "group")).alias("pick"), F.count("*").alias("held")).where(F.col("held") >= CROWDED)
    of = of.select("shingle", F.col("pick.same").alias("other"), F.col("pick.n").alias("m"), F.col("pick.at").alias("behind"), F.col("pick.group").alias("into"))
    met = firsts.join(of, "shingle").where((F.col("group") != F.col("into")) & sizes_fit("n", "m") & can_be_first("n", "at", "m", "behind"))
    pairs = met.select("same", "other", "n", "m", "group", "into").distinct()
    pairs = pairs.join(bits, "same").join(bits.select(F.col("same").alias("other"), F.col("bits").alias("other_bits")), "other")
    return stored(sharing(stored(pairs.where(sketches_fit("bits", "other_bits", "n", "m")).drop("bits", "other_bits"), "pairs"), firsts), "picks")


def near_copies(docs: DataFrame, prints: DataFrame, bare: Callable | None = None) -> DataFrame:
    """Pairs ``a`` > ``b`` of set names that are near copies: enough of them to join whatever near copies that share a cell join.

    ``docs`` has ``doc_id`` (never null, see ``row_key``) and ``text``, ``prints`` are its sets with their bands,
    both made with the same ``bare``.
    """
    nodes = prints.groupBy("same").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    cells = nodes.select("same", "n", F.explode("bands").alias("cell"))
    shared = cells.groupBy("cell").agg(F.count("*").alias("held")).where("held > 1").drop("held")
    cells = stored(cells.join(shared, "cell"), "cells")
    sets = whole_sets(docs, nodes, cells, bare)
    tested = by_picks(cells, sets)
    between = across_groups(cells, tested.where("near").select("a", "b"), sets)
    return tested.union(_newly(between, tested, sets)).where("near").select("a", "b")


def whole_sets(docs: DataFrame, nodes: DataFrame, names: DataFrame, bare: Callable | None = None) -> DataFrame:
    """``same`` and ``shingles`` of the sets that ``names`` has, stored; ``nodes`` knows a row of each."""
    rows = stored(nodes.join(names.select("same").distinct(), "same", "left_semi").select("doc_id"), "rows")
    of = docs.select("doc_id", "text").join(*perhaps_among(rows, "doc_id"), "left_semi").join(rows.hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return stored(described(of, "shingles", lambda s: s, bare=bare, sketches=True), "sets")


def perhaps_among(rows: DataFrame, key: str) -> tuple[DataFrame, Column]:
    """What tells rows that can have a ``key`` that is in ``rows`` from those that can't: a table to be joined, and on what.

    Its FILTER_BITS bits, 1 MB at most, say which hashes of keys occur. So only few other rows need to go to an exact join.
    """
    place = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    bucket, bit = F.bitmap_bucket_number(place), F.bitmap_bit_position(place)
    bits = rows.groupBy(bucket.alias(f"{key}_bucket")).agg(F.bitmap_construct_agg(bit).alias(f"{key}_bits"))
    byte = F.conv(F.hex(F.substring(f"{key}_bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.broadcast(bits), (bucket == F.col(f"{key}_bucket")) & (F.getbit(byte, (bit % 8).cast("int")) == 1)


def by_picks(cells: DataFrame, sets: DataFrame) -> DataFrame:
    """Comparisons ``a``, ``b``, ``near`` of each text with one of its cell; of near ones the larger name is in no later round."""
    tested = cells.sparkSession.createDataFrame([], "a long, b long, near boolean")
    left = cells
    for k in range(ROUNDS):
        one = left.groupBy("cell").agg(F.min(F.struct(F.xxhash64("same", "cell", F.lit(k)), "same", "n")).alias("one"))
        other = one.select("cell", F.col("one.same").alias("other"), F.col("one.n").alias("other_n"))
        pairs = left.join(other, "cell").where((F.col("same") != F.col("other")) & sizes_fit("n", "other_n"))
        found = _newly(pairs, tested, sets)
        tested = tested.union(found)
        if k + 1 < ROUNDS:
            left = stored(left.join(found.where("near").select(F.col("a").alias("same")).distinct(), "same", "left_anti"), "left")
    return tested


def _newly(pairs: DataFrame, tested: DataFrame, sets: DataFrame) -> DataFrame:
    """Comparisons, stored, of the pairs ``same``, ``other`` that aren't among the tested ones."""
    pairs = pairs.select(F.greatest("same", "other").alias("a"), F.least("same", "other").alias("b")).distinct()
    return stored(_compared(pairs.join(tested, ["a", "b"], "left_anti"), sets), "tested")


def across_groups(cells: DataFrame, links: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs ``same``, ``other`` of different groups of linked texts: all that are near copies and share a cell are among them."""
    groups = connected_components(links).withColumnRenamed("node", "same")
    grouped = cells.join(groups, "same", "left").select("cell", "same", F.coalesce("component", "same").alias("group"))
    several = grouped.groupBy("cell").agg(F.min("group").alias("least"), F.max("group").alias("most")).where("least < most").select("cell")
    candidates = grouped.join(several, "cell", "left_semi").select("same", "group").distinct()
    return prefix_pairs(sets.join(candidates, "same"))


def commonest(docs: DataFrame) -> np.ndarray:
    """Shingles that several texts of a sample of ``docs`` have, the rarest first."""
    every = max(1, docs.count() // SAMPLED)
    sets = described(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0), "shingles", lambda s: s).dropDuplicates(["same"])
    held = sets.select(F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("held")).where("held > 1")
    rows = held.orderBy(F.desc("held"), "shingle").limit(COMMONEST).collect()
    return np.array([r.shingle for r in reversed(rows)], np.int64).view(np.uint64)


def marks(common: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """What describes a shingle set: its fingerprint, then its prefix. Shingles go by their hashes; those of ``common`` come last, as there."""
    rank = np.argsort(common)
    known = common[rank]

    def describe(shingles: np.ndarray) -> np.ndarray:
        n = len(shingles)
        few = n + NEAR[0] * n // -NEAR[1] + 1
        at = np.searchsorted(known, shingles)
        late = np.zeros(n, bool)
        inside = at < len(known)
        late[inside] = known[at[inside]] == shingles[inside]
        first = shingles[~late][:few]
        if len(first) < few:
            first = np.concatenate([first, common[np.sort(rank[at[late]])[: few - len(first)]]])
        return np.concatenate([np.array([majority(shingles)], np.uint64), first])

    return describe


def fingerprint_cells(nodes: DataFrame) -> DataFrame:
    """``same``, ``n``, ``cell`` (one each) of all sets whose fingerprints ``fp`` are linked with another set's, stored."""
    of = components(nodes.select(F.col("same").alias("doc_id"), "fp"), RADIUS, CHANCE).select(F.col("doc_id").alias("same"), F.col("component_id").alias("cell"))
    shared = of.groupBy("cell").agg(F.count("*").alias("held")).where("held > 1").select("cell")
    return stored(nodes.select("same", "n").join(of.join(shared, "cell", "left_semi"), "same"), "cells")


def fingerprint_copies(docs: DataFrame, prints: DataFrame) -> DataFrame:
    """Pairs ``a`` > ``b`` of set names that are near copies: enough of them to join whatever near copies join.

    ``docs`` has ``doc_id`` (never null, see ``row_key``) and ``text``, ``prints`` are its sets with their ``marks`` and a number
    ``row`` of their own. Of the prefixes only shingles that several groups have are stored. There sets and groups go by rows' numbers,
    which are near each other and so take less room than names.
    """
    nodes = prints.groupBy("same").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first(F.col("marks")[0]).alias("fp"), F.min("row").alias("row"), F.first("bits").alias("bits"))
    nodes = stored(nodes, "nodes")
    cells = fingerprint_cells(nodes)
    sets = whole_sets(docs, nodes, cells)
    tested = by_picks(cells, sets)
    groups = connected_components(tested.where("near").select("a", "b")).withColumnRenamed("node", "same")
    groups = groups.join(nodes.select(F.col("same").alias("component"), F.col("row").alias("group")), "component").select("same", "group")
    grouped = nodes.join(groups, "same", "left").select("row", F.coalesce("group", "row").alias("group"))
    firsts = F.posexplode(F.slice("marks", F.lit(2), F.size("marks"))).alias("at", "shingle")
    firsts = prints.join(grouped, "row").select(F.col("row").alias("same"), "group", "n", firsts)
    of_shingle = Window.partitionBy("shingle")
    firsts = firsts.withColumn("apart", F.min("group").over(of_shingle) < F.max("group").over(of_shingle)).where("apart").drop("apart")
    firsts = stored(firsts, "firsts")
    bits = nodes.select(F.col("row").alias("same"), "bits")

    def named(pairs: DataFrame) -> DataFrame:
        for side in ("same", "other"):
            pairs = pairs.join(nodes.select(F.col("row").alias(side), F.col("same").alias(f"{side}_name")), side)
        return stored(pairs.drop("same", "other").withColumnsRenamed({"same_name": "same", "other_name": "other"}), "named")

    def with_sets(pairs: DataFrame) -> DataFrame:
        names = pairs.select("same").union(pairs.select("other")).distinct().join(sets, "same", "left_anti")
        return sets.unionByName(whole_sets(docs, nodes, names))

    picks = named(first_picks(firsts, bits))
    sets = with_sets(picks)
    found = _newly(picks, tested, sets)
    tested = tested.union(found)
    linked = picks.join(found.where("near"), (F.greatest("same", "other") == F.col("a")) & (F.least("same", "other") == F.col("b")))
    groups = connected_components(linked.select(F.col("group").alias("a"), F.col("into").alias("b")))
    firsts = firsts.join(groups, F.col("group") == F.col("node"), "left").withColumn("group", F.coalesce("component", "group")).drop("node", "component")
    rest = named(meeting(firsts, bits))
    return tested.union(_newly(rest, tested, with_sets(rest))).where("near").select("a", "b")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near copies: of each group of linked ones the row with the smallest ``doc_id`` stays.

    Rows without an id come after all others; among rows of one id, and of none, a hash of the text decides.
    Rows that agree in id and text are one document. Wordless texts are copies of each other. Texts go to a join only
    where their row may have to go.
    """
    keyed = docs.select(row_key().alias("doc_id"), F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text"))
    prints = described(keyed, "marks", marks(commonest(keyed)), ("id",), sketches=True).withColumn("row", F.monotonically_increasing_id())
    prints = stored(prints, "prints")
    groups = connected_components(fingerprint_copies(keyed.select("doc_id", "text"), prints))
    least = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "doc_id")).alias("least")
    of = prints.groupBy("same").agg(least).join(groups, F.col("same") == F.col("node"), "left")
    key = "key"
    while any(c.lower().startswith(key) for c in docs.columns):
        key += "_"
    stay = of.groupBy(F.coalesce("component", "same").alias("group")).agg(F.min("least").alias("least"))
    stay = stored(stay.select(F.col("least.doc_id").alias(key)), "stay")
    rows = prints.groupBy(F.col("doc_id").alias(key)).agg(F.count("*").alias("held"))
    out = stored(rows.join(stay.withColumn("stays", F.lit(True)), key, "left").where("stays is null or held > 1").select(key), "out")
    marked, (bits, can_go) = docs.withColumn(key, row_key()), perhaps_among(out, key)
    unsure = marked.join(bits, can_go, "left_semi").join(stay.hint("merge"), key, "left_semi").dropDuplicates([key])
    return marked.join(bits, can_go, "left_anti").unionByName(unsure).drop(key)
