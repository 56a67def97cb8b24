"""Exact top-k search by BM25: an inverted index in shards, block-max WAND in each of them, an exact merge.

Index: documents are dealt into shards of bounded size, a row each: the shard's terms with their document frequencies, and the
postings (document, term frequency) of each term in the order of documents. A task reads a shard where it lies; no part of the
index is ever shuffled. Document frequencies, the number of documents and their mean length are summed over all shards, so a
document has the same score wherever it is stored.

Search: postings lie in blocks of few neighbouring documents, a long one being alone, each with its greatest contribution. A
block of documents can reach at most the sum of these maxima over a query's terms. The cursor of a query moves through a shard in the order of
documents to the next pivot, a block whose bound reaches the k-th best score so far; the blocks before it are skipped and none of
their documents is scored. Bounds are made for many queries at once: the maxima of frequent terms are a matrix, so their part is
a product of matrices, and rarer terms add theirs block by block. Documents of a shard and queries of a block lie by kind, as
languages are: each kind of documents has a matrix of its own, of which queries of another kind ask few terms. A long document is a
block of its own, so its bound is its score but for the rounding: k such bounds give a query its first floor before anything is
scored. Pivots of many queries are scored in one pass. The k-th best score is carried from shard to shard of a task, and each shard
starts with the blocks that promise most, so it is high from the start; some shards are searched before the others, whose search
starts from the k-th best score there. What tasks return has the exact k best, and so their merge is exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import narrow, running_start, save, texts
from .kernels import counts_of, flat, signed, slices, word_hashes

K1, B = 1.2, 0.75
#: A block has neighbouring documents of so many postings in all, a longer one being a block of its own. Block maxima say little
#: about long queries unless blocks are small: of blocks of 64 documents nine in ten can reach the ten best, of this size one in 1,000.
BLOCK = 384
#: Terms in a share of 1 / FREQUENT of a kind's blocks, and in 8 at least, have their maxima in its matrix; so many queries share a
#: product, and so many the sums over rarer terms, whose lists are filled up to a multiple of WIDTH, so fewer places are computed.
FREQUENT, TOGETHER, LISTED, WIDTH = 16, 256, 32, 8
#: Kinds are told apart by so many most frequent terms; a kind is split if it has twice KIND texts and its first axis explains SPLIT of
#: how they differ, LEAST_KIND being on either side.
KIND_TERMS, KIND, SPLIT, LEAST_KIND = 512, 256, 0.1, 64
#: So many postings are scored in one go, whichever queries they are scored for.
SCORED = 1 << 18
#: Scores are rounded to 9 places, so sums that differ by their rounding only are ties; bounds have that much to spare.
ROUND = 1e-9
SHARD_DOCS, SHARD_BYTES = 4096, 16 << 20
#: One shard in LEADS is searched first, but some MOST_LEADS at most; what it has raises the bar for all others.
LEADS, MOST_LEADS = 8, 32
#: Queries are packed in blocks of so many bytes, a longer query being a block of its own; the index is read once for PASS blocks.
QUERY_BYTES, PASS = 16 << 20, 6
#: A shard is a row of some MB, so row groups are cut by size and not only looked at every 100 rows.
_FILES = {"parquet.block.size": str(16 << 20), "parquet.block.size.row.check.min": "1", "parquet.block.size.row.check.max": "4"}


def term_counts(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """term, text and count of all distinct words of each text, by term and then text; and the number of words of each text."""
    words, doc = word_hashes(data, at)
    order = np.lexsort((doc, words))
    words, doc = words[order], doc[order]
    first = np.flatnonzero(np.r_[True, (words[1:] != words[:-1]) | (doc[1:] != doc[:-1])]) if len(words) else np.zeros(0, np.int64)
    return words[first], doc[first], np.diff(np.r_[first, len(words)]), np.bincount(doc, minlength=len(at) - 1)


def packed(*arrays: np.ndarray) -> bytes:
    return zstandard.compress(b"".join(x for a in arrays for x in (len(a).to_bytes(8, "little"), np.ascontiguousarray(a).tobytes())), 1)


def unpacked(raw: bytes, *types: type) -> list[np.ndarray]:
    raw = zstandard.decompress(raw)
    out, at = [], 0
    for t in types:
        n = int.from_bytes(raw[at : at + 8], "little")
        out.append(np.frombuffer(raw, t, n, at + 8))
        at += 8 + n * np.dtype(t).itemsize
    return out


def places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """s, s + 1, ..., s + n - 1 of each (s, n), joined."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def kinds(term: np.ndarray, text: np.ndarray, n: int) -> list[np.ndarray]:
    """term, text: which terms (small integers) each of n texts has. The texts by kind, as languages are: those of a kind share many of
    the frequent terms. A group is split where its first principal axis changes sign. Results don't depend on kinds, only the work does."""
    out, todo = [], [np.arange(n)]
    if n >= 2 * KIND and len(term):
        many = np.bincount(term)
        top = np.argpartition(-many, KIND_TERMS)[:KIND_TERMS] if len(many) > KIND_TERMS else np.arange(len(many))
        place = np.full(len(many), -1, np.int32)
        place[top] = np.arange(len(top))
        has = np.flatnonzero(place[term] >= 0)
        x = np.zeros((n, len(top)), np.float32)
        x[text[has], place[term[has]]] = 1
        x /= np.sqrt(np.maximum(x.sum(axis=1), 1))[:, None]
    while todo:
        own = todo.pop()
        if len(own) >= 2 * KIND and len(term):
            some = x[own[:: len(own) // KIND]]
            mean = some.mean(axis=0)
            some -= mean
            axis = some[np.argmax(np.einsum("ij,ij->i", some, some))]
            for _ in range(8):
                axis = some.T @ (some @ axis)
                axis /= max(float(np.linalg.norm(axis)), 1e-30)
            side = x[own] @ axis > mean @ axis
            differ = float(np.square(some).sum())
            if LEAST_KIND <= np.count_nonzero(side) <= len(own) - LEAST_KIND and float(np.square(some @ axis).sum()) >= SPLIT * differ:
                todo += [own[side], own[~side]]
                continue
        out.append(own)
    return out


def build_index(rows: DataFrame, name: str) -> DataFrame:
    """rows: doc_id, text. A saved table of shards, a row each: nth, docs, words (totals), kinds (where each kind's documents start), terms
    and postings (packed arrays). A shard's documents lie by kind, and within it by their number of terms."""

    def run(batches):
        from pyspark import TaskContext

        nth, held, docs, size = TaskContext.get().partitionId(), [], 0, 0

        def close():
            term, doc, tf, length, ids = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(term, kind="stable")
            term, doc, tf = term[order], doc[order], tf[order]
            new = np.ones(len(term), bool)
            new[1:] = term[1:] != term[:-1]
            first, nr = np.flatnonzero(new), np.cumsum(new) - 1
            terms_of = np.bincount(doc, minlength=len(ids))
            own = [x[np.argsort(terms_of[x], kind="stable")] for x in kinds(nr, doc, len(ids))]
            starts = np.cumsum([0] + [len(x) for x in own[:-1]]).astype(np.int32)
            own = np.concatenate(own)
            rank = np.empty(len(own), np.uint16)
            rank[own] = np.arange(len(own))
            doc = rank[doc]
            order = np.argsort((nr << 16) | doc)
            terms = packed(term[first], np.diff(np.r_[first, len(term)]).astype(np.uint16))
            postings = packed(doc[order], tf[order], length[own], ids[own])
            return pa.RecordBatch.from_arrays(
                [pa.array([nth]), pa.array([len(ids)]), pa.array([int(length.sum())]), pa.array([starts], pa.list_(pa.int32())), pa.array([terms], pa.binary()), pa.array([postings], pa.binary())],
                ["nth", "docs", "words", "kinds", "terms", "postings"],
            )

        for part in slices(batches, limit=1 << 20):
            data, at = flat(part.column("text"))
            for i in range(0, part.num_rows, 1024):
                j = min(part.num_rows, i + 1024)
                if held and (docs + j - i > SHARD_DOCS or size + at[j] - at[i] > SHARD_BYTES):
                    yield close()
                    nth, held, docs, size = nth + 3, [], 0, 0
                term, doc, tf, length = term_counts(data[at[i] : at[j]], at[i : j + 1] - at[i])
                held.append((term, (doc + docs).astype(np.uint16), tf.astype(np.uint32), length.astype(np.uint32), np.asarray(part.column("doc_id"))[i:j]))
                docs, size = docs + j - i, size + int(at[j] - at[i])
        if held:
            yield close()

    return save(rows.mapInArrow(run, "nth long, docs long, words long, kinds array<int>, terms binary, postings binary"), name, _FILES)


class Shard:
    """A shard in memory: block maxima of each kind's frequent terms as a matrix and of the others in lists, and the terms of each document."""

    def __init__(self, terms: bytes, postings: bytes, mean: float, kinds=(0,)):
        self.terms, count = unpacked(terms, np.uint64, np.uint16)
        doc, tf, length, self.ids = unpacked(postings, np.uint16, np.uint32, np.uint32, np.int64)
        start = np.r_[0, np.cumsum(count, dtype=np.int64)]
        impact = tf / (tf + (K1 * (1 - B + B * length / mean))[doc])
        impact *= K1 + 1
        size = np.bincount(doc, minlength=len(self.ids))
        self.by_doc = np.r_[0, np.cumsum(size)]
        shut = self.by_doc[:-1] // BLOCK
        long = size > BLOCK // 2
        shut = np.r_[True, (shut[1:] != shut[:-1]) | long[1:] | long[:-1]]
        shut[list(kinds)] = True
        self.edge = np.r_[np.flatnonzero(shut), len(size)]  # where each block of documents starts
        self.n_blocks = len(self.edge) - 1
        self.alone = np.flatnonzero(np.diff(self.edge) == 1)  # blocks of one document
        of_doc = (np.cumsum(shut) - 1).astype(np.uint16)
        block = of_doc[doc]
        new = np.ones(len(block), bool)
        new[1:] = block[1:] != block[:-1]
        new[start[:-1]] = True
        at = np.flatnonzero(new)
        block = block[at]  # of each block of postings the documents it is about
        top = (np.maximum.reduceat(impact, at) if len(at) else np.zeros(0)).astype(np.float32)
        of = np.searchsorted(at, start)  # a term's blocks of postings
        self.kind = np.r_[of_doc[list(kinds)], self.n_blocks].astype(np.int64)  # where each kind's blocks start
        least = np.maximum(8, -(-np.diff(self.kind) // FREQUENT))
        kind = np.repeat(np.arange(len(least), dtype=np.int32), np.diff(self.kind))[block]
        often = np.flatnonzero(np.diff(of) >= least.min())
        self.nr = np.full(len(self.terms), -1, np.int32)  # of terms that have a row in a matrix
        self.nr[often] = np.arange(len(often))
        nr = np.repeat(self.nr, np.diff(of))
        cell = np.where(nr < 0, -1, nr * len(least) + kind)
        in_matrix = np.bincount(cell + 1, minlength=len(often) * len(least) + 1)[1:].reshape(len(often), len(least)) >= least
        held = np.r_[False, in_matrix.ravel()][cell + 1]
        self.maxima, self.row = [], np.full((len(least), len(often)), -1, np.int32)
        for k, (i, j) in enumerate(zip(self.kind[:-1], self.kind[1:])):
            own = np.flatnonzero(in_matrix[:, k])
            self.row[k, own] = np.arange(len(own))
            some = np.flatnonzero(held & (kind == k))
            self.maxima.append(np.zeros((len(own), j - i), np.float32))
            self.maxima[-1][self.row[k, nr[some]], block[some] - i] = top[some]
        listed = np.flatnonzero(~held)
        sizes = np.diff(np.searchsorted(listed, of))
        self.of = np.r_[0, np.cumsum(-(-sizes // WIDTH))]  # a term's lines of WIDTH blocks of postings
        at = places(self.of[:-1] * WIDTH, sizes)
        self.block, self.top = np.zeros((self.of[-1], WIDTH), np.int32), np.zeros((self.of[-1], WIDTH), np.float32)
        self.block.ravel()[at], self.top.ravel()[at] = block[listed], top[listed]
        # Sums of so many positive numbers of 24 bits are right up to this factor.
        self.slack = 1 + (max(len(m) for m in self.maxima) + 4096) * 2.0**-23
        order = np.argsort(doc, kind="stable")  # terms stay in order within a document, so equal texts have equal sums
        self.doc_term = np.repeat(np.arange(len(self.terms), dtype=np.int32), count)[order]
        self.doc_impact = impact[order]
        self.asked, self.weight = np.zeros(len(self.terms), bool), np.zeros(len(self.terms))
        self.skipped = self.scored = 0  # blocks of documents, for each query

    def bounds(self, query: np.ndarray, terms: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
        """query, terms, weights: the terms (indexes into self.terms) of n queries, by query. What each block can reach, a row per query."""
        reach = np.empty((n, self.n_blocks), np.float32)
        start = self.of[terms]
        sizes = self.of[terms + 1] - start
        listed = np.flatnonzero(sizes)
        of, start, sizes, w = query[listed], start[listed], sizes[listed], weights[listed].astype(np.float32)
        cut = np.searchsorted(of, np.arange(0, n + LISTED, LISTED))
        for q, i, j in zip(range(0, n, LISTED), cut[:-1], cut[1:]):
            at, many = places(start[i:j], sizes[i:j]), min(n - q, LISTED)
            cell, part = self.block.take(at, axis=0), self.top.take(at, axis=0)
            cell += np.repeat((of[i:j] - q).astype(np.int32) * np.int32(self.n_blocks), sizes[i:j])[:, None]
            part *= np.repeat(w[i:j], sizes[i:j])[:, None]
            reach[q : q + many] = np.bincount(cell.ravel(), part.ravel(), many * self.n_blocks).reshape(many, -1)
        nr = self.nr[terms]
        some = np.flatnonzero(nr >= 0)
        of, nr, weights = query[some], nr[some], weights[some]
        for rows, maxima, i, j in zip(self.row, self.maxima, self.kind[:-1], self.kind[1:]):
            row = rows[nr]
            own = np.flatnonzero(row >= 0)
            row = row[own]
            asked = np.flatnonzero(np.bincount(row, minlength=len(maxima)))
            if not len(asked):
                continue
            if 4 * len(asked) < 3 * len(maxima):  # queries of another kind have few of the terms
                at = np.empty(len(maxima), np.int32)
                at[asked] = np.arange(len(asked))
                row, maxima = at[row], maxima[asked]
            w = np.zeros((n, len(maxima)), np.float32)
            w[of[own], row] = weights[own]
            reach[:, i:j] += w @ maxima
        reach *= np.float32(self.slack)
        reach += np.float32(ROUND)
        return reach

    def scores(self, query: np.ndarray, blocks: np.ndarray, terms: np.ndarray, weights: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """query, blocks: pairs, by query; terms and weights of query q: ends[q] to ends[q + 1]. Of each document of each pair's
        block: the query, the document and its score."""
        many = self.edge[blocks + 1] - self.edge[blocks]
        docs = places(self.edge[blocks], many)
        start = self.by_doc[self.edge[blocks]]
        size = self.by_doc[self.edge[blocks + 1]] - start
        ends_of, term = np.cumsum(size), np.concatenate([self.doc_term[i:j] for i, j in zip(start.tolist(), (start + size).tolist())])
        first = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
        cut = np.r_[0, ends_of][np.r_[first, len(query)]].tolist()
        some, part = [], []
        for q, i, j in zip(query[first].tolist(), cut[:-1], cut[1:]):
            own, here = terms[ends[q] : ends[q + 1]], term[i:j]
            self.asked[own] = True
            hit = np.flatnonzero(self.asked[here])  # few of a long document's terms
            self.asked[own] = False
            self.weight[own] = weights[ends[q] : ends[q + 1]]
            some.append(hit + i)
            part.append(self.weight[here[hit]])
        some, part = np.concatenate(some), np.concatenate(part)
        block = np.searchsorted(ends_of, some, "right")
        part *= self.doc_impact[(start - ends_of + size)[block] + some]
        doc = np.searchsorted(np.cumsum(self.by_doc[docs + 1] - self.by_doc[docs]), some, "right")
        sums = np.bincount(doc, part, len(docs)).round(9)
        return np.repeat(query, many), docs, sums

    def search_all(self, terms: np.ndarray, weights: np.ndarray, ends: np.ndarray, bound: np.ndarray, k: int, best: list[tuple[np.ndarray, np.ndarray]], floor: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Many queries: the terms and weights of query q are those from ends[q] to ends[q + 1], a row of bound has what its blocks
        can reach. best: for each query the ids and scores of the k best documents of other shards, best first; floor: scores
        that k documents elsewhere reach. The k best of best and of this shard's documents that reach the floor, by score, then
        id; only scores over 0 count.

        Pivots of all queries are scored together, in steps: what a step finds raises the k-th best scores for the next one."""
        best = list(best)
        least = np.array([max(1e-12, f, b[1][k - 1] if len(b[1]) >= k else 0.0) for f, b in zip(floor, best)])

        def score(query: np.ndarray, blocks: np.ndarray) -> None:
            self.scored += len(blocks)
            done = np.cumsum(self.by_doc[self.edge[blocks + 1]] - self.by_doc[self.edge[blocks]])
            i = 0
            while i < len(blocks):
                j = max(i + 1, int(np.searchsorted(done, (done[i - 1] if i else 0) + SCORED, "right")))
                of, docs, sums = self.scores(query[i:j], blocks[i:j], terms, weights, ends)
                hit = np.flatnonzero(sums >= least[of])
                of, ids, sums = of[hit], self.ids[docs[hit]], sums[hit]
                first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else []
                for q, x, y in zip(of[first].tolist(), first, np.r_[first[1:], len(of)]):
                    some, high = np.concatenate((best[q][0], ids[x:y])), np.concatenate((best[q][1], sums[x:y]))
                    order = np.lexsort((some, -high))[:k]
                    best[q] = some[order], high[order]
                    if len(order) == k:
                        least[q] = max(least[q], high[order[-1]])
                i = j

        reached = lambda rows: bound[rows] >= (np.maximum(least[rows], 2 * ROUND) * (1 - 2.0**-22)).astype(np.float32)[:, None]
        left = reached(slice(None))
        many = np.flatnonzero(np.count_nonzero(left, axis=1) > 2 * k)
        if len(many) and len(self.alone) >= k:
            # What a document alone in its block can reach is its score, but for the slack: k such scores are a floor unscored.
            alone = np.partition(bound[np.ix_(many, self.alone)], -k, axis=1)[:, -k]
            least[many] = np.maximum(least[many], (alone - ROUND) * (2 - self.slack) / self.slack - ROUND)
            left[many] = reached(many)
            many = many[np.count_nonzero(left[many], axis=1) > 2 * k]
        self.skipped += left.size - np.count_nonzero(left)
        # Where many blocks are left, those that promise most come first, and most of the others are then skipped.
        if len(many):
            first = np.argpartition(-bound[many], k, axis=1)[:, :k]
            score(np.repeat(many, k), first.ravel())
            left[np.repeat(many, k), first.ravel()] = False
        query, blocks = np.divmod(np.flatnonzero(left), self.n_blocks)
        reach = bound[query, blocks]
        if len(many):
            order = np.lexsort((-reach, query))
            query, blocks, reach = query[order], blocks[order], reach[order]
        step = 32
        while len(query):
            pivot = reach >= least[query]
            self.skipped += len(query) - np.count_nonzero(pivot)
            query, blocks, reach = query[pivot], blocks[pivot], reach[pivot]
            now = np.arange(len(query)) - np.searchsorted(query, query) < step
            score(query[now], blocks[now])
            # A few pivots are taken at once, and more and more, as the k-th best rises ever more slowly.
            query, blocks, reach, step = query[~now], blocks[~now], reach[~now], 2 * step
        return best

    def search(self, terms: np.ndarray, weights: np.ndarray, bound: np.ndarray, k: int, best: tuple[np.ndarray, np.ndarray], floor: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """search_all() for one query."""
        return self.search_all(terms, weights, np.array([0, len(terms)]), bound[None], k, [best], np.array([floor]))[0]


def _query_terms(queries: DataFrame) -> DataFrame:
    def run(batches):
        for part in slices(batches):
            term, doc, n, _ = term_counts(*flat(part.column("text")))
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(doc)), pa.array(signed(term)), pa.array(n.astype(np.int32))], ["query_id", "term", "n"])

    return queries.mapInArrow(run, "query_id long, term long, n int")


def _shard_terms(index: DataFrame) -> DataFrame:
    """term, n: each shard's document frequencies."""

    def run(batches):
        for batch in batches:
            for raw in batch.column("terms"):
                term, count = unpacked(raw.as_py(), np.uint64, np.uint16)
                yield pa.RecordBatch.from_arrays([pa.array(signed(term)), pa.array(count.astype(np.int64))], ["term", "n"])

    return index.select("terms").mapInArrow(run, "term long, n long")


def _query_blocks(weighed: DataFrame) -> tuple[DataFrame, int]:
    """weighed: query_id, term, n, idf. A saved table (block, queries): queries packed, about QUERY_BYTES a block; and their number.
    A block's queries lie by kind, as those of a kind meet the same matrices."""
    sizes = weighed.groupBy("query_id").agg((F.count("*") * 24).alias("size")).withColumn("all", F.lit(0)).withColumn("order", F.xxhash64("query_id"))
    sizes = save(sizes, "query_sizes")
    dealt = running_start(sizes, ["all"], "order", ["query_id"], "size", sizes.count(), "start").select("query_id", F.floor(F.col("start") / QUERY_BYTES).alias("block"))
    last = dealt.agg(F.max("block")).first()[0]

    def pack(table: pa.Table) -> pa.Table:
        q, t, n, idf = (np.asarray(table.column(c)) for c in ("query_id", "term", "n", "idf"))
        ids, q = np.unique(q, return_inverse=True)
        words, some, nth = np.unique(t.view(np.uint64), return_index=True, return_inverse=True)
        own = np.concatenate(kinds(nth, q, len(ids)))
        rank = np.empty(len(own), np.int64)
        rank[own] = np.arange(len(own))
        q = rank[q]
        order = np.lexsort((nth, q))
        raw = packed(ids[own], np.searchsorted(q[order], np.arange(len(own) + 1)).astype(np.int64), words, idf[some].astype(float), nth[order].astype(np.uint32), n[order].astype(np.uint32))
        return pa.table({"block": pa.array([table.column("block")[0].as_py()], pa.int64()), "queries": pa.array([raw], pa.binary())})

    blocks = weighed.join(dealt, "query_id").groupBy("block").applyInArrow(pack, "block long, queries binary")
    return save(blocks, "query_blocks", _FILES), 0 if last is None else last + 1


def _searched(index: DataFrame, queries: list[bytes], k: int, mean: float, floors: dict[int, float]) -> DataFrame:
    """query_id, doc_id, score: for each query of some blocks the k best documents of each task's shards that reach its floor."""
    blocks = index.sparkSession.sparkContext.broadcast((queries, floors))

    def run(batches):
        queries, floors = blocks.value
        asked = [unpacked(x, np.int64, np.int64, np.uint64, np.float64, np.uint32, np.uint32) for x in queries]
        floor = [np.array([floors.get(q, 0.0) for q in ids.tolist()]) for ids, *_ in asked]
        best = [[(np.zeros(0, np.int64), np.zeros(0))] * len(ids) for ids, *_ in asked]

        def search_shard(starts, terms, postings):  # a shard goes before the next one is made
            shard = Shard(terms.as_py(), postings.as_py(), mean, starts.as_py())
            for (ids, edge, words, idf, nth, count), low, high in zip(asked, floor, best):
                where = np.minimum(np.searchsorted(shard.terms, words), max(0, len(shard.terms) - 1)).astype(np.int32)
                where[shard.terms[where] != words if len(shard.terms) else slice(None)] = -1
                for q0 in range(0, len(ids), TOGETHER):
                    q1 = min(len(ids), q0 + TOGETHER)
                    span = slice(edge[q0], edge[q1])
                    at = where[nth[span]]
                    has = np.flatnonzero(at >= 0)
                    at, weights = at[has], idf[nth[span][has]] * count[span][has]
                    query = np.repeat(np.arange(q1 - q0), np.diff(edge[q0 : q1 + 1]))[has]
                    bound = shard.bounds(query, at, weights, q1 - q0)
                    ends = np.searchsorted(query, np.arange(q1 - q0 + 1))
                    high[q0:q1] = shard.search_all(at, weights, ends, bound, k, high[q0:q1], low[q0:q1])

        for batch in batches:
            for row in zip(batch.column("kinds"), batch.column("terms"), batch.column("postings")):
                search_shard(*row)
        for (ids, *_), high in zip(asked, best):
            sizes = [len(b[0]) for b in high]
            if sum(sizes):
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, sizes)), pa.array(np.concatenate([b[0] for b in high])), pa.array(np.concatenate([b[1] for b in high]))], ["query_id", "doc_id", "score"])

    return index.select("kinds", "terms", "postings").mapInArrow(run, "query_id long, doc_id long, score double")


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def search(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each query its k best documents by BM25: query_id, rank (from 1), doc_id, score.

    docs and queries have an id and a text. Words are runs of bytes other than ASCII white space, A-Z in lower case; a query's
    words count as often as it has them. Scores are the sums over its words of ln(1 + (N - df + 0.5) / (df + 0.5)) * tf * 2.2 /
    (tf + 1.2 * (0.25 + 0.75 * length / mean length)), over all docs, to 9 places. Ties go to the smaller id. Documents without a word of
    the query are no results, so an empty query has none. Null texts count as empty. Rows with a null id are left out, of
    docs and of queries. Documents that share an id are results each. Of queries that share one, the least text asks. A text of
    any length is indexed and asked with whole; a long one is a shard, or a block of queries, of its own.

    Queries meet the index in passes of PASS blocks of QUERY_BYTES: these are broadcast, with a number per query, and the index is read
    once for each pass.
    """
    rows = texts(docs, id_col, text_col).where("doc_id is not null")
    asked = texts(queries, id_col, text_col).where("doc_id is not null").groupBy("doc_id").agg(F.min("text").alias("text"))
    index = build_index(rows, "shards")
    n_docs, n_words, n_shards = (x or 0 for x in index.agg(F.sum("docs"), F.sum("words"), F.count("*")).first())
    lead = F.col("nth") % max(LEADS, n_shards // MOST_LEADS) == 0
    mean = max(n_words, 1) / max(n_docs, 1)
    terms = save(_query_terms(asked), "query_terms")
    wanted = save(terms.select("term").distinct(), "wanted")
    df = narrow(_shard_terms(index), wanted, "term").groupBy("term").agg(F.sum("n").alias("df"))
    weighed = save(terms.join(df, "term").select("query_id", "term", "n", F.log(1 + (F.lit(float(n_docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")), "weighed")
    blocks, n_blocks = _query_blocks(weighed)
    out = docs.sparkSession.createDataFrame([], "query_id long, rank int, doc_id long, score double")
    for b in range(0, n_blocks, PASS):
        queries = [bytes(blocks.where(F.col("block") == i).first()["queries"]) for i in range(b, min(n_blocks, b + PASS))]
        leads = save(_best(_searched(index.where(lead), queries, k, mean, {}), k), f"leads{b}")
        floors = dict(map(tuple, leads.where(F.col("rank") == k).select("query_id", "score").toPandas().itertuples(index=False)))
        found = leads.select("query_id", "doc_id", "score").unionByName(_searched(index.where(~lead), queries, k, mean, floors))
        out = out.unionByName(save(_best(found, k), f"found{b}") if n_blocks > PASS else _best(found, k))
    return out
