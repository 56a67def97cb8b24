"""SentencePiece encoding and decoding: the n best segmentations of whole texts over the piece lattice of a given model.

A text's lattice falls apart into segments, runs of spaces with the word that follows, if no piece of the model goes beyond
one. For all distinct segments of a batch together, Viterbi runs forward (best score up to a node) and backward (best score
from it on). An edge's two scores and its own are the best of all paths through it, so the best edge off the best path tells
how much a segment's second best loses. Only in the segments that lose least can one of a text's n best differ from its best;
there A-star searches backward from the end, the forward scores being exact heuristics, so the n best come out one by one.

Scores are the model's own, whole numbers here, so sums are exact. A character that no piece holds is its bytes' pieces, with a
score of 10 below the least. The first segmentation is the one with the greatest sum of scores, which need not be the one that
the library's own greedy merging gives. Of equal scores the order is fixed, see a_star() and best_sums().
"""

from __future__ import annotations

from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts
from .kernels import EXACT, flat, prefix_hash, slices, span_hash
from .token_store import ragged

_memo: dict[str, PieceModel] = {}
NEVER = np.int64(2**62)


class PieceModel:
    """A model's pieces by the hash of their bytes, with a space for the escaped one."""

    def __init__(self, path: str, most: int = 300_000):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        names = [sp.id_to_piece(i).replace("▁", " ").encode() for i in plain]
        if any(b" " in name.lstrip(b" ") for name in names) or sp.normalize(" Aﬁ  ") != "▁▁Aﬁ▁▁":
            raise ValueError("pieces must not go beyond a word, and the model must keep texts as they are and add a leading space")
        self.names = {i: name.decode() for i, name in zip(plain, names)}
        self.pieces = {name: (i, round(sp.get_score(i))) for i, name in self.names.items()}
        self.bytes_id = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        size = np.array([len(x) for x in names])
        data, at = np.frombuffer(b"".join(names), np.uint8), np.r_[0, np.cumsum(size)]
        keys = span_hash(prefix_hash(data, EXACT), at[:-1], at[1:])
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(plain)[order]
        self.scores = np.rint([sp.get_score(i) for i in plain]).astype(np.int64)[order]
        self.unknown = int(self.scores.min()) - 10
        self.may = np.zeros(1 << 20, bool)
        self.may[(keys >> np.uint64(44)).astype(np.int64)] = True
        self.width = max(len(x.decode()) for x in names)
        spelt = [b""] * n
        for i, name in zip(plain, names):
            spelt[i] = name
        for b, i in enumerate(self.bytes_id):
            spelt[i] = bytes([b])
        self.spelt = np.frombuffer(b"".join(spelt), np.uint8)
        self.spelt_size = np.array([len(x) for x in spelt])
        self.spelt_at = np.r_[0, np.cumsum(self.spelt_size)]
        self.most = most
        self.forget()

    @classmethod
    def at(cls, path: str) -> PieceModel:
        if path not in _memo:
            _memo[path] = cls(path)
        return _memo[path]

    def forget(self) -> None:
        """Known segments: hash, best score, loss of the second best, and the best ids."""
        self.known = np.zeros(0, np.uint64)
        self.best, self.loss = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.start, self.best_ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)
        self.lists: dict[bytes, list] = {}

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each hash among the pieces, -1 if there is none."""
        out = np.full(len(keys), -1)
        some = np.flatnonzero(self.may[(keys >> np.uint64(44)).astype(np.int64)])
        where = np.minimum(np.searchsorted(self.keys, keys[some]), len(self.keys) - 1)
        hit = self.keys[where] == keys[some]
        out[some[hit]] = where[hit]
        return out

    def lattice(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of all segments: node offsets (a node per character and the end), node bytes, and edges (from, to, id, score), by
        the character index of `to`, `to` and id. An id of -1 stands for a character's bytes."""
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        chars = np.searchsorted(lead, at)
        length = np.diff(chars)
        offset = np.r_[0, np.cumsum(length + 1)]
        node_byte = np.empty(offset[-1], np.int64)
        seg = np.repeat(np.arange(len(length)), length)
        node = np.arange(len(lead)) + seg
        node_byte[node] = lead
        node_byte[offset[1:] - 1] = at[1:]
        step = np.arange(offset[-1]) - np.repeat(offset[:-1], length + 1)
        h = prefix_hash(data, EXACT)
        froms, tos, ids, scores = [], [], [], []
        single = np.zeros(offset[-1], bool)
        for w in range(1, min(self.width, int(length.max(initial=0))) + 1):
            to = np.flatnonzero(step >= w)
            piece = self.find(span_hash(h, node_byte[to - w], node_byte[to]))
            hit = piece >= 0
            froms.append(to[hit] - w)
            tos.append(to[hit])
            ids.append(self.ids[piece[hit]])
            scores.append(self.scores[piece[hit]])
            if w == 1:
                single[to[hit]] = True
        # Characters without a piece of their own.
        bare = np.flatnonzero((step >= 1) & ~single)
        froms.append(bare - 1)
        tos.append(bare)
        ids.append(np.full(len(bare), -1))
        scores.append(np.full(len(bare), self.unknown, np.int64))
        u, v, i, s = map(np.concatenate, (froms, tos, ids, scores))
        del froms, tos, ids, scores
        # No two edges share a node and an id. One key for all three is faster to sort by, where it holds them.
        key = (step[v].astype(np.int64) << 44) | (v << 16) | (i + 1)
        order = np.argsort(key) if step.max(initial=0) < 1 << 19 and len(step) < 1 << 28 else np.lexsort((i, v, step[v]))
        return offset, node_byte, step, u[order], v[order], i[order], s[order]

    def viterbi(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Best score, loss of the second best, and the best ids with their edges, of non-empty segments data[at[i]:at[i + 1]]."""
        offset, node_byte, step, u, v, ids, score = self.lattice(data, at)
        alpha = np.full(offset[-1], -NEVER)
        alpha[offset[:-1]] = 0
        into = np.zeros(offset[-1], np.int64)
        level = np.searchsorted(step[v], np.arange(step.max(initial=0) + 2))
        for k in range(1, len(level) - 1):
            e = slice(level[k], level[k + 1])
            val = alpha[u[e]] + score[e]
            first = np.flatnonzero(np.r_[True, v[e][1:] != v[e][:-1]])
            top = np.maximum.reduceat(val, first)
            size = np.diff(np.r_[first, len(val)])
            pick = np.minimum.reduceat(np.where(val == np.repeat(top, size), np.arange(len(val)), len(val)), first)
            alpha[v[e][first]] = top
            into[v[e][first]] = pick + level[k]
        beta = np.full(offset[-1], -NEVER)
        beta[offset[1:] - 1] = 0
        for k in range(len(level) - 2, 0, -1):
            e = slice(level[k], level[k + 1])
            np.maximum.at(beta, u[e], beta[v[e]] + score[e])
        on = np.zeros(len(u), bool)
        here = offset[1:] - 1
        while len(here):
            e = into[here]
            on[e] = True
            here = u[e]
            here = here[step[here] > 0]
        best = alpha[offset[1:] - 1]
        through = alpha[u] + score + beta[v]
        second = np.full(len(best), -NEVER)
        seg = np.searchsorted(offset, u, "right") - 1
        np.maximum.at(second, seg[~on], through[~on])
        loss = np.where(second > -NEVER // 2, best - second, NEVER)
        path = np.flatnonzero(on)
        path = path[np.argsort(v[path], kind="stable")]
        # Bytes in place of what has no piece.
        bare = ids[path] < 0
        wide = np.where(bare, node_byte[v[path]] - node_byte[u[path]], 1)
        out = np.repeat(ids[path], wide)
        mask = np.repeat(bare, wide)
        if mask.any():
            out[mask] = self.bytes_id[ragged(data, node_byte[u[path]][bare], wide[bare])]
        counts = np.bincount(seg[path], wide, len(best)).astype(np.int64)
        return best, loss, out.astype(np.uint32), np.r_[0, np.cumsum(counts)]

    def a_star(self, segment: bytes, n: int) -> list[tuple[int, np.ndarray]]:
        """The n best segmentations of one segment: loss and ids, the best first.

        A state is a path from the end to a node; it is kept as its last edge and the number of the state before, so memory grows
        with the states and not with their lengths. As the forward scores are exact, each state that is opened is part of one of
        the n best. Of equal losses the one found last is opened first, so a path is followed to its start before its siblings, the
        smallest ids first: the first segmentation is viterbi()'s.
        """
        key = segment + n.to_bytes(4, "little")
        if key in self.lists:
            return self.lists[key]
        chars = segment.decode()
        # The edges into each node, those of the best paths first: where they come from, their ids, and what they lose.
        first, froms, ids, lost = [0, 0], [], [], []
        alpha = [0]
        get, width = self.pieces.get, self.width
        for end in range(1, len(chars) + 1):
            edges = []
            for start in range(max(0, end - width), end):
                got = get(chars[start:end])
                if got or start == end - 1:
                    i, score = got or (-1, self.unknown)
                    edges.append((-alpha[start] - score, i, start))
            if len(edges) > 1:
                edges.sort()
            best = edges[0][0]
            alpha.append(-best)
            for loss, i, start in edges:
                froms.append(start)
                ids.append(i)
                lost.append(loss - best)
            first.append(len(froms))
        # Heap: loss, minus the number, edge, node behind it, state before it. An edge's next best sibling waits until it is opened.
        before, edge_of, out = [-1], [-1], []
        edge = first[len(chars)]
        heap, number = [(lost[edge], 0, edge, len(chars), 0)], 0
        while heap and len(out) < n:
            loss, _, edge, node, state = heappop(heap)
            at = froms[edge]
            if edge + 1 < first[node + 1]:
                number -= 1
                heappush(heap, (loss - lost[edge] + lost[edge + 1], number, edge + 1, node, state))
            before.append(state)
            edge_of.append(edge)
            if at:
                number -= 1
                heappush(heap, (loss, number, first[at], at, len(before) - 1))  # a node's first edge loses nothing
                continue
            spelt, s, start = [], len(before) - 1, 0
            while s:
                i = ids[edge_of[s]]
                if i >= 0:
                    spelt.append(i)
                    start += len(self.names[i])
                else:
                    spelt += self.bytes_id[list(chars[start].encode())].tolist()
                    start += 1
                s = before[s]
            out.append((loss, np.array(spelt, np.uint32)))
        if len(self.lists) > 10_000:
            self.lists.clear()
        if len(segment) <= 1 << 12:
            self.lists[key] = out
        return out

    def encode(self, strings: list[str], n: int) -> list[list[tuple[int, np.ndarray]]]:
        """For each text its n best segmentations, (score, ids); fewer if it has fewer. An empty text has one, without ids."""
        raw = [(" " + t.replace("▁", " ")).encode() if t else b"" for t in strings]
        at = np.r_[0, np.cumsum([len(r) for r in raw])]
        joined = b"".join(raw)
        data = np.frombuffer(joined, np.uint8)
        blank = data == 32
        new = blank.copy()
        new[1:] &= ~blank[:-1]
        new[at[:-1][np.diff(at) > 0]] = True
        starts = np.flatnonzero(new)
        ends = np.r_[starts[1:], len(data)][: len(starts)]
        keys, first, nth = np.unique(span_hash(prefix_hash(data, EXACT), starts, ends), return_index=True, return_inverse=True)
        if len(self.known) > self.most:
            self.forget()
        at_known = np.searchsorted(self.known, keys)
        fresh = np.ones(len(keys), bool)
        inside = np.flatnonzero(at_known < len(self.known))
        fresh[inside] = self.known[at_known[inside]] != keys[inside]
        if fresh.any():
            s, e = starts[first[fresh]], ends[first[fresh]]
            best, loss, ids, edge = self.viterbi(ragged(data, s, e - s), np.r_[0, np.cumsum(e - s)])
            merged = np.concatenate([self.known, keys[fresh]])
            order = np.argsort(merged, kind="stable")  # two sorted runs
            from_ = np.concatenate([self.start[:-1], len(self.best_ids) + edge[:-1]])[order]
            size = np.concatenate([np.diff(self.start), np.diff(edge)])[order]
            self.best_ids = ragged(np.concatenate([self.best_ids, ids]), from_, size)
            self.known, self.start = merged[order], np.r_[0, np.cumsum(size)]
            self.best, self.loss = np.concatenate([self.best, best])[order], np.concatenate([self.loss, loss])[order]
        where = np.searchsorted(self.known, keys)[nth]
        size = self.start[where + 1] - self.start[where]
        ids = ragged(self.best_ids, self.start[where], size)
        id_at = np.r_[0, np.cumsum(size)]
        best, loss = np.r_[0, np.cumsum(self.best[where])], self.loss[where]
        out = []
        for a, b in zip(np.searchsorted(starts, at[:-1]), np.searchsorted(starts, at[1:])):
            own, score = ids[id_at[a] : id_at[b]], int(best[b] - best[a])
            found = [(score, own)]
            if n > 1 and b > a:
                some = np.arange(a, b)
                if b - a > n - 1:
                    limit = np.partition(loss[a:b], n - 2)[n - 2]
                    some = some[loss[a:b] <= limit]
                    some = some[np.argsort(loss[some], kind="stable")][: n - 1]
                items = sorted(((lost, int(p), j, x) for p in some if loss[p] < NEVER for j, (lost, x) in enumerate(self.a_star(joined[starts[p] : ends[p]], n)) if j), key=lambda item: item[:3])
                for lost, chosen in best_sums([(lost, p) for lost, p, _, _ in items[: n - 1]], n)[1:]:
                    parts, last = [], id_at[a]
                    for _, p, _, x in sorted((items[c] for c in chosen), key=lambda item: item[1]):
                        parts += [ids[last : id_at[p]], x]
                        last = id_at[p + 1]
                    found.append((score - lost, np.concatenate([*parts, ids[last : id_at[b]]])))
            out.append(found)
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of a segmentation; bytes that are no UTF-8 become replacement characters."""
        return ragged(self.spelt, self.spelt_at[ids], self.spelt_size[ids]).tobytes()[1:].decode("utf-8", "replace") if len(ids) else ""


def best_sums(items: list[tuple[int, int]], n: int) -> list[tuple[int, tuple[int, ...]]]:
    """items: (loss, place), sorted. The n selections of at most one item for each place with the least sums: (sum, indexes,
    the last first). Of equal sums the one comes first whose last item is earlier, then the one before that, and so on."""
    out, heap = [(0, ())], [(items[0][0], (0,))] if items else []
    while heap and len(out) < n:
        total, chosen = heappop(heap)
        if len({items[c][1] for c in chosen}) == len(chosen):
            out.append((total, chosen))
        last = chosen[0]
        if last + 1 < len(items):
            heappush(heap, (total + items[last + 1][0], (last + 1, *chosen)))
            heappush(heap, (total - items[last][0] + items[last + 1][0], (last + 1, *chosen[1:])))
    return out


def encode_nbest(docs: DataFrame, model: str, n: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Up to n rows per row of docs: doc_id, rank (from 1), score, n_pieces, ids (binary: little-endian unsigned 32-bit).

    model: path of a SentencePiece model on every machine. Texts are segmented whole, of any length, null as empty; an empty
    text has one segmentation, without pieces and with score 0. Rows repeated, with the same id or not, each have their rows.
    Null ids stay null, other columns are left out.
    """

    def run(batches):
        coder = PieceModel.at(model)
        for part in slices(batches, limit=1 << 19):
            rows = [[], [], [], [], []]
            for i, found in zip(part.column("doc_id").to_pylist(), coder.encode(part.column("text").to_pylist(), n)):
                for rank, (score, ids) in enumerate(found, 1):
                    for o, x in zip(rows, (i, rank, score, len(ids), ids.astype("<u4").tobytes())):
                        o.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], ["doc_id", "rank", "score", "n_pieces", "ids"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, rank int, score long, n_pieces long, ids binary")


def decoded(encoded: DataFrame, model: str) -> DataFrame:
    """encoded with a column text, decoded from ids; null ids give an empty text. The model's escaped space reads as a space."""
    names = [c for c in encoded.columns if c != "text"]

    def run(batches):
        coder = PieceModel.at(model)
        for batch in batches:
            for part in slices([batch], "ids", 4 << 20):
                got = [coder.decode(np.frombuffer(x, "<u4").astype(np.int64)) for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got, pa.string())], [*names, "text"])

    kept = encoded.select(*names).withColumn("ids", F.coalesce("ids", F.lit(b"")))
    return kept.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", text string")
