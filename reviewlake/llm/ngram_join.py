"""N-gram Jaccard join: the universe-partition pigeonhole method on sets of word shingles, exact.

Tokens (shingles) are hashed into segments, their number depending on the band of set sizes. Two sets that are similar enough
differ in at most H tokens. A set therefore shows, for its own H, signatures of segments whose capacities add up to H + 1:
the whole segment (capacity 1: if no other set shows it, every other set differs there in one token at least), then the
one-deletion neighbourhoods of segments (1 more), then single tokens (the rest). This order is the order of rows per unit of
capacity, so a set takes the cheapest slots that suffice. Of two sets the one with the shorter list of slots proves the pair:
if they share no signature, they differ in more than H tokens.

Cost also depends on how many sets show a signature. Signatures of more than `hot` sets that are not all linked prove nothing
that can be checked cheaply, so the sets that show them are allocated anew among themselves: such a signature is still shown, but
counts as no capacity, and further slots make up for it. What counts as hot grows with each round. A set that has no slots left
is compared by sketches, within its hot groups and block by block, with the sets of other components, so no link is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import components, narrow, save, texts
from .kernels import counts_of, flat, mix, signed, slices, word_hashes

BAND = 2.0
SEGMENTS = 0.31
#: So many sets are compared with each other in one task.
TOGETHER = 1024
_ODD = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_sets(data: np.ndarray, at: np.ndarray, n: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles of n words; of a text with 1 to n - 1 words, of all its words."""
    words, doc = word_hashes(data, at)
    edge = counts_of(doc, len(at) - 1)
    rolled = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for k in range(n):
        rolled += words[k : k + len(rolled)] * _ODD[k]
    rolled = mix(rolled)
    out = []
    for i, j in zip(edge[:-1], edge[1:]):
        if j - i >= n:
            out.append(np.unique(rolled[i : j - n + 1]))
        else:
            out.append(mix((words[i:j] * _ODD[: j - i]).sum(keepdims=True) + np.uint64(j - i)) if j > i else np.zeros(0, np.uint64))
    return out


def bands_of(n: int, percent: int) -> list[int]:
    """The bands in which a set of n tokens shows signatures: its own, and the next if a partner may be there."""
    own = int(np.floor(np.log(n) / np.log(BAND) + 1e-9))
    return [own, own + 1] if n * 100 // percent >= np.ceil(BAND ** (own + 1)) else [own]


def signatures(tokens: np.ndarray, band: int, percent: int, hot: np.ndarray | None = None) -> tuple[np.ndarray, bool]:
    """The signatures that a set shows in a band, and whether its capacity suffices. hot: signatures that count as no capacity."""
    n, top = len(tokens), int(np.ceil(BAND ** (band + 1))) - 1
    partner = max(n, min(n * 100 // percent, top))
    need = (100 - percent) * (n + partner) // (100 + percent) + 1
    segments = max(1, int(np.ceil(SEGMENTS * top)))
    salt = _ODD[band % 64] + np.uint64(band)
    value = mix(tokens ^ salt)
    place = (value >> np.uint64(32)) % np.uint64(segments)
    order = np.argsort(place, kind="stable")
    value, place = value[order], place[order]
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    size = np.diff(np.r_[first, n])
    total = np.add.reduceat(value, first)
    name = lambda sums, places: mix(mix(sums) + places * _ODD[40] + salt)
    whole = name(total, place[first])
    cold = np.ones(len(whole), bool) if hot is None else ~np.isin(whole, hot)
    have = int(cold.sum())
    if have >= need:
        return whole[: int(np.searchsorted(np.cumsum(cold), need)) + 1], True
    out = [whole]
    nth = np.repeat(np.arange(len(first)), size)
    less = name(total[nth] - value, place)
    single = name(value, place)
    fit = np.ones(n, bool) if hot is None else ~np.isin(less, hot)
    alone = np.ones(n, bool) if hot is None else ~np.isin(single, hot)
    # A segment's capacity grows to 2 by deletions, if none of them is hot, and to its number of cold tokens by single tokens.
    capacity = cold.astype(int)
    pairs = np.where(cold & (size >= 2) & np.minimum.reduceat(fit, first), 2, capacity)
    tokens_ = np.maximum(pairs, np.add.reduceat(alone.astype(int), first))
    for rows, shown, reach in ((less, size[nth] >= 2, pairs), (single, np.ones(n, bool), tokens_)):
        more = np.cumsum(reach - capacity)
        last = int(np.searchsorted(more, need - have))
        out.append(rows[(nth <= last) & shown])
        if more[-1] >= need - have:
            return np.concatenate(out), True
        have, capacity = have + int(more[-1]), reach
    return np.concatenate(out), False


def _shown(rows: DataFrame, n_words: int, percent: int, least: bool) -> DataFrame:
    """rows: doc_id, text and, unless least, hot (array of long). Rows id, sig, full (the set's capacity suffices)."""

    def run(batches):
        for part in slices(batches, limit=1 << 19):
            ids, sigs, full = [], [], []
            hots = None if least else part.column("hot").to_pylist()
            for k, (i, tokens) in enumerate(zip(part.column("doc_id").to_pylist(), shingle_sets(*flat(part.column("text")), n_words))):
                if not len(tokens):
                    continue
                hot = None if least else np.sort(np.array(hots[k], np.int64).view(np.uint64))
                for band in bands_of(len(tokens), percent):
                    s, enough = signatures(tokens, band, percent, hot)
                    ids.append(np.full(len(s), i, np.int64))
                    sigs.append(s)
                    full.append(np.full(len(s), enough))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(signed(np.concatenate(sigs))), pa.array(np.concatenate(full))], ["id", "sig", "full"])

    return rows.mapInArrow(run, "id long, sig long, full boolean")


def sketch_of(tokens: np.ndarray) -> np.ndarray:
    """The parities of a set's buckets, 64 to a word: as many buckets as the next power of two over its size, 1,024 at least."""
    size = max(1024, 1 << int(len(tokens)).bit_length())
    return np.packbits(np.bincount((mix(tokens ^ _ODD[52]) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1, bitorder="little").view(np.int64)


def _sizes(rows: DataFrame, n_words: int) -> DataFrame:
    """doc_id, n_shingles, a 128-bit digest of the set in two longs, and its sketch."""

    def run(batches):
        for part in slices(batches, limit=1 << 19):
            sets = shingle_sets(*flat(part.column("text")), n_words)
            sums = [np.array([int(f(s).sum()) if len(s) else 0 for s in sets], np.uint64) for f in (lambda s: mix(s + _ODD[50]), lambda s: mix(s ^ _ODD[51]))]
            bits = [sketch_of(s) for s in sets]
            sketch = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(x) for x in bits])], pa.int32()), pa.array(np.concatenate(bits) if bits else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(signed(x)) for x in sums), sketch], ["doc_id", "n_shingles", "d1", "d2", "sketch"])

    return rows.mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long, sketch array<long>")


def _possible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that their sets' sizes and sketches allow. Each token in one set only changes one parity, so the sketches
    differ in no more bits than the sets in tokens: no similar pair is lost."""
    at = lambda x: sets.select(F.col("doc_id").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    both = pairs.select("a", "b").join(at("a"), "a").join(at("b"), "b")

    def folded(x: str, y: str) -> Column:
        # Sizes of similar sets differ by a factor under 2; a sketch of twice the buckets is the other's kind once its halves meet.
        half = (F.size(x) / 2).cast("int")
        return F.when(F.size(x) > F.size(y), F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda p, q: p.bitwiseXOR(q))).otherwise(F.col(x))

    apart = F.aggregate(F.zip_with(folded("s_a", "s_b"), folded("s_b", "s_a"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    sizes = f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)"
    return both.where(sizes).where(apart <= F.expr(f"(n_a + n_b) * {100 - percent} div {100 + percent}")).select("a", "b").distinct()


def _verified(pairs: DataFrame, docs: DataFrame, sets: DataFrame, n_words: int, percent: int, name: str) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough, saved; only texts of possible pairs are shuffled."""

    def run(batches):
        for batch in batches:
            for part in slices([batch], "text_a", 1 << 19):
                left, right = (shingle_sets(*flat(part.column(c)), n_words) for c in ("text_a", "text_b"))
                ok = []
                for a, b in zip(left, right):
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    ok.append(bool(len(a)) and 100 * both >= percent * (len(a) + len(b) - both))
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], ["a", "b"]).filter(pa.array(ok))

    some = save(_possible(pairs, sets, percent), f"possible_{name}")
    at = lambda x: narrow(docs, some.select(F.col(x).alias("doc_id"))).select(F.col("doc_id").alias(x), F.col("text").alias(f"text_{x}"))
    joined = some.join(at("a"), "a").join(at("b"), "b")
    return save(joined.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long"), name)


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """a, b, in_a, in_b: the pairs in different components, and these."""
    at = lambda x: labels.select(F.col("node").alias(x), F.col("component").alias(f"in_{x}"))
    out = pairs.join(at("a"), "a", "left").join(at("b"), "b", "left").withColumns({f"in_{x}": F.coalesce(f"in_{x}", x) for x in "ab"})
    return out.where("in_a <> in_b").select("a", "b", "in_a", "in_b")


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels after more links: only the components that these join are worked on."""
    joined = components(_apart(links, labels).select(F.col("in_a").alias("a"), F.col("in_b").alias("b")))
    known = labels.union(joined.select("node", F.col("node").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
    to = joined.select(F.col("node").alias("component"), F.col("component").alias("to"))
    return save(known.join(to, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "labels")


def _apart_groups(groups: DataFrame, labels: DataFrame) -> DataFrame:
    """groups (g, id) with their components c, of the groups that have members in several."""
    at = labels.select(F.col("node").alias("id"), "component")
    whole = Window.partitionBy("g")
    rows = groups.join(at, "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")
    return rows.withColumn("_apart", F.min("c").over(whole) != F.max("c").over(whole)).where("_apart").drop("_apart")


def close_pairs(ids: np.ndarray, labels: np.ndarray, sizes: np.ndarray, sketches: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a group's members in different components that sizes and sketches allow, see _possible()."""
    order = np.argsort(sizes, kind="stable")
    ids, labels, sizes = ids[order], labels[order], sizes[order]
    sketches = [sketches[i].view(np.uint64) for i in order]
    width = np.array([len(x) for x in sketches])
    found = [[], []]
    for w in np.unique(width):
        same = np.flatnonzero(width == w)
        for mine, step in ((same, 1), (np.flatnonzero(width == 2 * w), 2)):
            if not len(mine):
                continue
            left = np.stack([sketches[i] for i in same])
            right = np.stack([sketches[i] for i in mine])
            right = right if step == 1 else right[:, :w] ^ right[:, w:]
            for at in range(0, len(same), max(1, (1 << 20) // (len(mine) * w))):  # blocks of 8 MB
                block = same[at : at + max(1, (1 << 20) // (len(mine) * w))]
                apart = np.bitwise_count(left[at : at + len(block), None, :] ^ right[None, :, :]).sum(-1, dtype=np.int64)
                x, y = sizes[block][:, None], sizes[mine][None, :]
                ok = (apart <= (100 - percent) * (x + y) // (100 + percent)) & (100 * np.minimum(x, y) >= percent * np.maximum(x, y)) & (labels[block][:, None] != labels[mine][None, :])
                i, j = np.nonzero(ok)
                i, j = ids[block[i]], ids[mine[j]]
                keep = (i < j) if step == 1 else np.ones(len(i), bool)
                found[0].append(np.minimum(i, j)[keep])
                found[1].append(np.maximum(i, j)[keep])
    return tuple(np.concatenate(f) if f else np.zeros(0, np.int64) for f in found)


def _dealt(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """members: g, id, c (its component); sets: id, n_shingles, sketch. The members with these, and with g such that pairs that
    may be similar meet under one g, and under no g many more than TOGETHER.

    Members of a great group are dealt into cells by a band of sizes, as similar sets are in the same or in neighbouring bands,
    and by whether they are in the component of most members, as those need not meet each other. Cells are cut into blocks by a
    hash of the id, and a block goes to as many places as there are blocks it must meet.
    """
    at = save(members.distinct(), "members")
    sizes = at.groupBy("g", "c").count().groupBy("g").agg(F.sum("count").alias("m"), F.max_by("c", F.struct("count", "c")).alias("main"))
    sizes = save(sizes, "group_sizes")
    small = at.join(sizes.where(F.col("m") <= TOGETHER).select("g"), "g", "left_semi").join(sets, "id").select("g", "id", "c", "n_shingles", "sketch")
    great = sizes.where(F.col("m") > TOGETHER)
    if great.isEmpty():
        return small
    rows = at.join(great, "g").join(sets, "id").withColumn("cell", F.floor(F.log("n_shingles") / float(np.log(100 / percent)) + 1e-9) * 2 + (F.col("c") == F.col("main")).cast("long"))
    rows = save(rows.select("g", "id", "c", "n_shingles", "sketch", "cell"), "cells")
    cells = save(rows.groupBy("g", "cell").agg(F.ceil(F.count("*") / (TOGETHER // 2)).alias("blocks")), "blocks")
    other = cells.select("g", F.col("cell").alias("other"), F.col("blocks").alias("their"))
    band = lambda c: F.floor(F.col(c) / 2)
    both_main = (F.col("cell") % 2 == 1) & (F.col("other") % 2 == 1)
    meet = cells.join(other, "g").where((F.abs(band("cell") - band("other")) <= 1) & ~both_main)  # six at most for a cell
    block = F.pmod(F.xxhash64("id"), F.col("blocks"))
    spread = rows.join(meet, ["g", "cell"]).withColumn("mine", block).withColumn("theirs", F.explode(F.sequence(F.lit(0).cast("long"), F.col("their") - 1)))
    ends = F.array_sort(F.array(F.struct(F.col("cell").alias("cell"), F.col("mine").alias("block")), F.struct(F.col("other").alias("cell"), F.col("theirs").alias("block"))))
    return small.unionByName(spread.select(F.xxhash64("g", ends).alias("g"), "id", "c", "n_shingles", "sketch"))


def _across(groups: DataFrame, labels: DataFrame, sets: DataFrame, percent: int, most: int | None = None) -> DataFrame:
    """groups: g, id, of any size, or of at most `most` members. The pairs (a, b) of members in different components that may be
    similar, group by group.

    A group of up to TOGETHER members is compared in one task, a greater one block by block, see _dealt()."""

    def run(batches):
        held: list = []

        def close():
            a, b = close_pairs(*(np.array(x) for x in list(zip(*held))[1:4]), [h[4] for h in held], percent)
            pairs = np.unique(np.stack([a, b]), axis=1) if len(a) else np.zeros((2, 0), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

        for batch in batches:
            sketch = batch.column("sketch")
            edge, bits = np.asarray(sketch.offsets), np.asarray(sketch.values)
            for k, row in enumerate(zip(*(batch.column(c).to_pylist() for c in ("g", "id", "c", "n_shingles")))):
                if held and held[0][0] != row[0]:
                    yield close()
                    held = []
                held.append((*row, bits[edge[k] : edge[k + 1]]))
        if held:
            yield close()

    members, own = _apart_groups(groups.select("g", "id"), labels), sets.select(F.col("doc_id").alias("id"), "n_shingles", "sketch")
    rows = members.join(own, "id") if most and most <= TOGETHER else _dealt(members, own, percent)
    return rows.repartition("g").sortWithinPartitions("g").select("g", "id", "c", "n_shingles", "sketch").mapInArrow(run, "a long, b long").distinct()


def jaccard_links(docs: DataFrame, sets: DataFrame, reps: DataFrame, n_words: int, percent: int, hot: int) -> DataFrame:
    """Labels (node, component) of docs (doc_id, text) with ids in reps (doc_id), by verified links; without links no label."""
    labels = bans = None
    active, rounds = narrow(docs, reps), 0

    def link(pairs: DataFrame, name: str) -> None:
        nonlocal labels
        new = _verified(pairs, docs, sets, n_words, percent, f"{name}{rounds}")
        if labels is None:
            labels = components(new)
        elif not new.isEmpty():
            labels = _merged(labels, new)

    while True:
        # 1. Who shows what: of a signature the smallest id leads. Groups with the same members are one group.
        by = "partition by sig"
        seen = _shown(active, n_words, percent, not rounds).select(
            "sig", "id", "full", F.expr(f"min(id) over ({by})").alias("lead"), F.expr(f"max(id) over ({by})").alias("last"), F.expr(f"count(*) over ({by})").alias("n"), F.expr(f"bit_xor(xxhash64(id)) over ({by})").alias("mark")
        ).where("lead <> last and (n > 2 or id <> lead)")
        key = F.when(F.col("n") > hot, F.col("sig")).otherwise(F.xxhash64("lead", "last", "n", "mark"))
        groups = save(seen.groupBy(key.alias("g"), "id", "lead", "n").agg(F.count("*").alias("weight"), F.min("full").alias("full")), f"groups{rounds}")
        # 2. Each id meets the leader with which it shares most.
        if labels is None:
            pairs = groups.where("id <> lead").groupBy(F.col("lead").alias("a"), F.col("id").alias("b")).agg(F.sum("weight").alias("weight"))
            link(pairs.groupBy("b").agg(F.max_by("a", F.struct("weight", (-F.col("a")).alias("first"))).alias("a")).select("a", "b"), "best")
        # 3. Members of a group that are still apart meet, unless it is a hot one.
        couples = groups.where("n = 2").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()
        link(_apart(couples, labels).select("a", "b").union(_across(groups.where(F.col("n").between(3, hot)), labels, sets, percent, hot)).distinct(), "others")
        # 4. Hot signatures whose sets are still apart.
        given = save(_apart_groups(groups.where(F.col("n") > hot).select("g", "id", "full"), labels), f"given{rounds}")
        stuck = given.where("not full").select("g").distinct()
        if not stuck.isEmpty():  # no slots left: whoever is in such a group meets all of other components
            link(_across(given.join(stuck, "g", "left_semi"), labels, sets, percent), "rest")
        known = given.select(F.col("g").alias("sig"), "id").distinct()
        if bans is None:
            fresh, ids = known, None
        else:
            # All sets of a signature that is new to one of them go on, each with all that it has shown in vain.
            fresh = save(known.join(bans, ["sig", "id"], "left_anti"), f"fresh{rounds}")
            ids = known.join(fresh.select("sig").distinct(), "sig", "left_semi").select("id").distinct()
        if fresh.isEmpty():
            return labels
        bans = fresh if bans is None else save(bans.union(fresh), f"bans{rounds}")
        going = bans if ids is None else bans.join(ids, "id", "left_semi")
        lists = save(going.groupBy(F.col("id").alias("doc_id")).agg(F.collect_set("sig").alias("hot")), f"lists{rounds}")
        active, rounds, hot = narrow(docs, lists).join(lists, "doc_id"), rounds + 1, min(4 * hot, 1 << 14)


def ngram_jaccard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = 5, percent: int = 75, hot: int = 1024) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id.

    Words are runs of bytes other than ASCII white space, A-Z in lower case. A document's set holds its distinct shingles of
    n_words words; with fewer words all of them are one shingle; null texts and texts without words have an empty set and no
    links. Two documents link if 100 * intersection >= percent * union. component_id is the smallest id reachable by links,
    the document's own included. Rows that share an id are one node, linked if any of them is; rows with a null id have no
    links and a null component. Other columns are ignored.
    """
    rows = texts(docs, id_col, text_col)
    sets = save(_sizes(rows, n_words), "sets")
    real = sets.where("n_shingles > 0 and doc_id is not null")
    reps = real.groupBy("n_shingles", "d1", "d2").agg(F.min("doc_id").alias("rep"))
    copies = save(real.join(reps, ["n_shingles", "d1", "d2"]).select(F.col("rep").alias("a"), F.col("doc_id").alias("b")), "copies")
    labels = jaccard_links(rows.where("doc_id is not null"), real, copies.select(F.col("a").alias("doc_id")), n_words, percent, hot)
    if copies.groupBy("b").count().where("count > 1").isEmpty():
        found = copies.join(labels, copies.a == labels.node, "left").select(F.col("b").alias("doc_id"), F.coalesce("component", "a").alias("component"))
    else:  # an id with several texts joins their components
        all_links = copies.where("a <> b").union(labels.select(F.col("component").alias("a"), F.col("node").alias("b")).where("a <> b"))
        found = components(all_links).withColumnRenamed("node", "doc_id")
    return sets.join(found.distinct(), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
