"""N-best SentencePiece encoding over the piece lattice, and decoding.

A text is normalised as the model asks for (a word mark in front, spaces as word marks) and cut
into chunks where no piece can cross: before a run of word marks, and around characters that
no piece contains. Every path of the text's lattice is then one path per chunk, and a path's
score is the sum of its pieces' scores.

For all distinct chunks of a slab the forward Viterbi scores and, in the same way, the backward
ones are computed together. The best path through an edge is the sum of both around it, so the best
edge off the best path tells how far the chunk's second path is behind. A document's N best
paths differ from its best only in the N - 1 chunks with the smallest such gaps. For these
chunks, and then for the document as a short lattice of chunk alternatives, a backward A*
search with the forward scores as exact heuristics yields the paths in order of score.

Defined results: a NULL or empty text has one segmentation, the empty one, with score 0; a text
with fewer than N segmentations gives all it has; equal scores are taken in the order the search
meets them, which is the same in every run; a character that no piece covers is one edge with
the unknown score and becomes its byte pieces; a word mark in a text decodes to a space.
"""

import hashlib
import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from depweave.llm import chars
from depweave.llm.common import tidied

MARK = "▁"
CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
CHUNK_OR_BREAK = re.compile(f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+")
UNKNOWN_PENALTY = 10.0
# Lattice arrays, chunk strings and kept solutions grow with these; two workers share an executor with its JVM.
SLAB_CHARS = 1 << 18
# Characters whose paths are decoded at a time, so that the gathered bytes stay in the processor's cache.
DECODED_CHARS = 1 << 16
MOST_CACHED = 200_000
# Distinct chunks whose solutions are kept from slab to slab of a task.
MOST_SOLVED = 150_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
NO_SCORE = -1e300


def best_paths(forward, edges, last, most):
    """The ``most`` best paths 0 -> ``last``, as (score, edges in order).

    ``edges(node)`` lists (start, score, label) of the edges that end at a node; ``forward`` holds the
    best score of any path from 0 to each node, an exact heuristic for the search from the end.
    """
    found, order = [], 0
    queue = [(-forward[last], 0, last, 0.0, None)]
    while queue and len(found) < most:
        cost, _, node, behind, path = heapq.heappop(queue)
        if node == 0:
            labels = []
            while path is not None:
                labels.append(path[0])
                path = path[1]
            found.append((behind, labels))
            continue
        for start, score, label in edges(node):
            order += 1
            heapq.heappush(queue, (-(forward[start] + score + behind), order, start, score + behind, (label, path)))
    return found


class Pieces:
    """Pieces, scores and lattices of one SentencePiece model file."""

    def __init__(self, model_file):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = model.get_piece_size()
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.ids = {model.id_to_piece(i): i for i in plain}
        self.scores = np.zeros(n)
        self.scores[plain] = [model.get_score(i) for i in plain]
        self.bytes = np.full(256, model.unk_id(), dtype=np.int32)
        self.raw = [b""] * n
        for i in range(n):
            if model.is_byte(i):
                value = int(model.id_to_piece(i)[3:-1], 16)
                self.bytes[value], self.raw[i] = i, bytes([value])
        for piece, i in self.ids.items():
            self.raw[i] = piece.replace(MARK, " ").encode()
        self.unknown_score = min(self.scores[plain]) - UNKNOWN_PENALTY
        self.longest = max(map(len, self.ids))
        self.known = set("".join(self.ids))
        if any(MARK in piece.lstrip(MARK) for piece in self.ids):
            raise ValueError("pieces with a word mark inside cross the chunks")
        self._table()
        self.raw_bytes = np.frombuffer(b"".join(self.raw), dtype=np.uint8)
        self.raw_sizes = np.array([len(b) for b in self.raw], dtype=np.int64)
        self.raw_starts = np.cumsum(self.raw_sizes) - self.raw_sizes
        self.forget()

    def forget(self):
        """Drop what was kept of the chunks met so far."""
        self.cache, self.solved = {}, {}
        none, flat = np.zeros(0, dtype=np.int64), np.zeros(0)
        self.solutions = (flat, flat, np.zeros(0, dtype=np.int32), none, none)

    def _table(self):
        """Two-way hash table from a hashed substring to its piece."""
        self.slots = 20
        names = list(self.ids)
        keys = np.array([self._hash(p) for p in names], dtype=np.uint64)
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two pieces share a 64-bit hash")
        self.key = np.zeros((2, 1 << self.slots), dtype=np.uint64)
        self.id = np.full((2, 1 << self.slots), -1, dtype=np.int32)
        for name, key in zip(names, keys):
            for side in (0, 1):
                at = self._slot(key, side)
                if self.id[side, at] < 0:
                    self.key[side, at], self.id[side, at] = key, self.ids[name]
                    break
            else:
                raise ValueError("both slots of a piece are taken")

    def _slot(self, key, side):
        return key >> np.uint64(64 - self.slots) if side == 0 else (key >> np.uint64(20)) & np.uint64((1 << self.slots) - 1)

    @staticmethod
    def _hash(piece):
        with np.errstate(over="ignore"):
            value = np.uint64(0)
            for c in piece:
                value = (value + np.uint64(ord(c) + 1)) * _BASE
            return value * np.uint64(0xBF58476D1CE4E5B9)

    def lookup(self, keys):
        """Piece id of each hashed substring, -1 for none."""
        keys = keys * np.uint64(0xBF58476D1CE4E5B9)
        first, second = (self._slot(keys, side) for side in (0, 1))
        found = np.where(self.key[0, first] == keys, self.id[0, first], -1)
        return np.where((found < 0) & (self.key[1, second] == keys), self.id[1, second], found)

    def chunks(self, text):
        """The chunks of a text, after normalisation."""
        if not text:
            return []
        pattern = CHUNK if "\n" in self.known else CHUNK_OR_BREAK
        return pattern.findall(MARK + text.replace(" ", MARK))

    def solve(self, chunks):
        """Best score, gap to the second path (inf without one) and best ids of distinct non-empty chunks."""
        sizes = np.array([len(c) for c in chunks], dtype=np.int64)
        rank = np.argsort(-sizes, kind="stable")
        ordered = [chunks[i] for i in rank]
        sizes = sizes[rank]
        points = np.frombuffer("".join(ordered).encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64)
        # Node t of chunk c is at[c] + t; each chunk has one node more than characters.
        at = np.cumsum(sizes + 1) - (sizes + 1)
        char_node = np.arange(len(points)) + np.repeat(np.arange(len(sizes)), sizes)
        left = np.repeat(at + sizes, sizes) - char_node
        n_nodes = int(at[-1] + sizes[-1] + 1)
        lengths = min(self.longest, int(sizes[0]))
        # Piece that starts at each node, by length.
        piece = np.full((lengths, n_nodes), -1, dtype=np.int32)
        key = np.zeros(len(points), dtype=np.uint64)
        for length in range(1, lengths + 1):
            fits = np.flatnonzero(left >= length)
            key[fits] = (key[fits] + points[fits + length - 1] + np.uint64(1)) * _BASE
            piece[length - 1, char_node[fits]] = self.lookup(key[fits])
        score = np.where(piece >= 0, self.scores[piece], NO_SCORE)
        lone = char_node[piece[0, char_node] < 0]
        score[0, lone] = self.unknown_score
        widths = np.searchsorted(-sizes, -np.arange(1, int(sizes[0]) + 1), side="right")
        forward, step = np.full(n_nodes, NO_SCORE), np.zeros(n_nodes, dtype=np.int64)
        forward[at] = 0
        for t in range(1, int(sizes[0]) + 1):
            node = at[: widths[t - 1]] + t
            for length in range(1, min(t, lengths) + 1):
                value = forward[node - length] + score[length - 1, node - length]
                better = value > forward[node]
                forward[node[better]], step[node[better]] = value[better], length
        backward = np.full(n_nodes, NO_SCORE)
        end = at + sizes
        backward[end] = 0
        for t in range(1, int(sizes[0]) + 1):
            node = end[: widths[t - 1]] - t
            for length in range(1, min(t, lengths) + 1):
                value = backward[node + length] + score[length - 1, node]
                backward[node] = np.maximum(backward[node], value)
        # Walk back along the best paths, marking their edges.
        on_best = np.zeros((lengths, n_nodes), dtype=bool)
        active, node, edges, owners = np.arange(len(sizes)), end.copy(), [], []
        while len(active):
            length = step[node]
            node = node - length
            on_best[length - 1, node] = True
            edges.append(node)
            owners.append(active)
            more = node > at[active]
            active, node = active[more], node[more]
        best = forward[end]
        second = np.full(n_nodes, NO_SCORE)
        for length in range(1, lengths + 1):
            starts = np.flatnonzero((score[length - 1, : n_nodes - length] > NO_SCORE) & ~on_best[length - 1, : n_nodes - length])
            through = forward[starts] + score[length - 1, starts] + backward[starts + length]
            second[starts] = np.maximum(second[starts], through)
        gap = best - np.maximum.reduceat(second, at)
        gap[gap > 1e200] = np.inf
        # Edges in reading order, then unknown characters as bytes.
        nodes, owner = np.concatenate(edges), np.concatenate(owners)
        nodes_order = np.argsort(nodes)
        nodes, owner = nodes[nodes_order], owner[nodes_order]
        length = np.zeros(n_nodes, dtype=np.int64)
        for k in range(lengths):
            length[on_best[k]] = k + 1
        ids = piece[length[nodes] - 1, nodes]
        ids, owner = self._with_bytes(ids, owner, points, nodes - owner)
        counts = np.bincount(owner, minlength=len(sizes))
        back = np.empty(len(sizes), dtype=np.int64)
        back[rank] = np.arange(len(sizes))
        offsets = np.cumsum(counts) - counts
        return best[back], gap[back], ids, offsets[back], counts[back]

    def _with_bytes(self, ids, owner, points, at):
        if (ids >= 0).all():
            return ids, owner
        width = np.ones(len(ids), dtype=np.int64)
        unknown = np.flatnonzero(ids < 0)
        spelled = [chr(c).encode("utf-8", "replace") for c in points[at[unknown]]]
        width[unknown] = [len(b) for b in spelled]
        out, place = np.repeat(ids, width), np.cumsum(width) - width
        out[out < 0] = self.bytes[np.frombuffer(b"".join(spelled), dtype=np.uint8)]
        return out, np.repeat(owner, width)

    def lattice_paths(self, chunk, most):
        """The N best (score, ids) of one chunk by backward A* search."""
        if (chunk, most) in self.cache:
            return self.cache[chunk, most]
        n = len(chunk)
        ending = [[] for _ in range(n + 1)]
        forward = [NO_SCORE] * (n + 1)
        forward[0] = 0.0
        for start in range(n):
            for stop in range(start + 1, min(n, start + self.longest) + 1):
                i = self.ids.get(chunk[start:stop])
                if i is not None:
                    ending[stop].append((start, float(self.scores[i]), (i,)))
                elif stop == start + 1:
                    spelled = tuple(int(self.bytes[b]) for b in chunk[start].encode("utf-8", "replace"))
                    ending[stop].append((start, self.unknown_score, spelled))
        for stop in range(1, n + 1):
            forward[stop] = max(forward[start] + score for start, score, _ in ending[stop])
        paths = [(score, [i for label in labels for i in label]) for score, labels in best_paths(forward, ending.__getitem__, n, most)]
        if len(self.cache) >= MOST_CACHED:
            self.cache.clear()
        self.cache[chunk, most] = paths
        return paths

    def encode(self, texts, most=1):
        """Per text, up to ``most`` (score, ids) from the best on; ids are int32 arrays."""
        out = []
        for _, group in chars.slabs(texts, SLAB_CHARS):
            out += self._encode(group, most)
        return out

    def _encode(self, texts, most):
        cut = [self.chunks(t) for t in texts]
        flat = [c for chunks in cut for c in chunks]
        if not flat:
            return [[(0.0, np.zeros(0, dtype=np.int32))] for _ in texts]
        coded = pa.array(flat, pa.large_string()).dictionary_encode()
        which, distinct = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        which = self._solved(distinct)[which]
        best, gap, ids, offset, count = self.solutions
        out, stop = [], 0
        for chunks in cut:
            mine = which[stop : stop + len(chunks)]
            stop += len(chunks)
            if not len(mine):
                out.append([(0.0, np.zeros(0, dtype=np.int32))])
                continue
            sizes = count[mine]
            place = np.cumsum(sizes) - sizes
            first = ids[np.arange(sizes.sum()) + np.repeat(offset[mine] - place, sizes)]
            total = float(best[mine].sum())
            out.append([(total, first)] + (self._next_best(total, first, place, sizes, flat[stop - len(mine) : stop], gap[mine], most) if most > 1 else []))
        return out

    def _solved(self, chunks):
        """Numbers of distinct chunks among the ``solutions``; new ones are solved together."""
        if len(self.solved) > MOST_SOLVED:
            self.forget()
        new = [c for c in chunks if c not in self.solved]
        if new:
            best, gap, ids, offset, count = self.solve(new)
            held = self.solutions
            found = (best, gap, ids, offset + len(held[2]), count)
            self.solutions = tuple(np.concatenate(pair) for pair in zip(held, found))
            self.solved.update(zip(new, range(len(held[0]), len(held[0]) + len(new))))
        return np.array([self.solved[c] for c in chunks], dtype=np.int64)

    def _next_best(self, total, first, place, sizes, chunks, gaps, most):
        near = np.argsort(gaps, kind="stable")[: most - 1] if len(gaps) < 64 else self._smallest(gaps, most - 1)
        near = [int(k) for k in sorted(near) if np.isfinite(gaps[k])]
        choices = [self.lattice_paths(chunks[k], most) for k in near]

        def edges(node):
            top = choices[node - 1][0][0]
            return [(node - 1, score - top, c) for c, (score, _) in enumerate(choices[node - 1])]

        found = []
        for behind, picks in best_paths([0.0] * (len(near) + 1), edges, len(near), most)[1:]:
            parts, done = [], 0
            for k, pick, paths in zip(near, picks, choices):
                if pick:
                    parts += [first[done : place[k]], np.array(paths[pick][1], dtype=np.int32)]
                    done = place[k] + sizes[k]
            found.append((total + behind, np.concatenate([*parts, first[done:]])))
        return found

    @staticmethod
    def _smallest(gaps, n):
        edge = np.partition(gaps, min(n, len(gaps)) - 1)[min(n, len(gaps)) - 1]
        below = np.flatnonzero(gaps < edge)
        return np.concatenate([below, np.flatnonzero(gaps == edge)[: n - len(below)]])

    def decode(self, ids):
        """Text of a sequence of ids; the word mark put in front by encoding is taken off."""
        return self.decode_all([ids])[0]

    def decode_all(self, paths):
        """Texts of many sequences of ids, whose bytes are gathered together."""
        flat = np.concatenate([*paths, np.zeros(0, dtype=np.int32)])
        sizes = self.raw_sizes[flat]
        ends = np.cumsum(sizes)
        raw = self.raw_bytes[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.raw_starts[flat] - (ends - sizes), sizes)].tobytes()
        stops = np.concatenate([[0], ends])[np.cumsum([0, *map(len, paths)])].tolist()
        return [raw[a + (raw[a : a + 1] == b" ") : b].decode("utf-8", "replace") if a < b else "" for a, b in zip(stops, stops[1:])]


_LOADED = {}


def model_of(model_file):
    """The model, loaded once per worker process."""
    if model_file not in _LOADED:
        _LOADED[model_file] = Pieces(model_file)
    return _LOADED[model_file]


def encode(docs, model_file, most=4, keep=("doc_id",)):
    """Columns ``keep`` and ``paths``: array of (score, ids), the N best segmentations of each text."""
    kind = pa.list_(pa.struct([("score", pa.float64()), ("ids", pa.list_(pa.int32()))]))

    def encoded(batches):
        model = model_of(model_file)
        for batch in batches:
            for first, group in chars.column_slabs(batch.column("_whole"), SLAB_CHARS):
                paths = model._encode([t or "" for t in group], most)
                flat = [p for doc in paths for p in doc]
                ids = pa.ListArray.from_arrays(_offsets([len(p[1]) for p in flat]), pa.array(np.concatenate([p[1] for p in flat]), pa.int32()))
                pairs = pa.StructArray.from_arrays([pa.array([p[0] for p in flat], pa.float64()), ids], ["score", "ids"])
                rows = pa.ListArray.from_arrays(_offsets([len(doc) for doc in paths]), pairs)
                part = batch.slice(first, len(group))
                yield pa.record_batch({**{n: part.column(n) for n in keep}, "paths": rows.cast(kind)})
        model.forget()

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return docs.select(*keep, F.col("text").alias("_whole")).mapInArrow(tidied(encoded), f"{kinds}, paths array<struct<score:double,ids:array<int>>>")


def _offsets(sizes):
    return pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))


def round_trips(docs, model_file, most=4, keep=("doc_id",)):
    """Encode to the N best paths and decode every one of them, without moving the ids.

    Columns ``keep``, n_paths, scores and n_pieces (arrays, best first), ids_sha256 (of the best path's
    ids as little-endian 32-bit integers) and round_trip (every path decodes to the text).
    """

    def checked(batches):
        model = model_of(model_file)
        for batch in batches:
            for first, group in chars.column_slabs(batch.column("_whole"), SLAB_CHARS):
                texts = [t or "" for t in group]
                paths = model._encode(texts, most)
                decoded = iter([t for at, group in chars.slabs(texts, DECODED_CHARS) for t in model.decode_all([i for doc in paths[at : at + len(group)] for _, i in doc])])
                plain = [t.replace(MARK, " ") for t in texts]
                part = batch.slice(first, len(texts))
                yield pa.record_batch(
                    {
                        **{n: part.column(n) for n in keep},
                        "n_paths": pa.array([len(doc) for doc in paths], pa.int32()),
                        "scores": pa.array([[s for s, _ in doc] for doc in paths], pa.list_(pa.float64())),
                        "n_pieces": pa.array([[len(i) for _, i in doc] for doc in paths], pa.list_(pa.int32())),
                        "ids_sha256": pa.array([hashlib.sha256(doc[0][1].astype("<i4").tobytes()).hexdigest() for doc in paths], pa.string()),
                        "round_trip": pa.array([all([next(decoded) == t for _ in doc]) for doc, t in zip(paths, plain)], pa.bool_()),
                    }
                )
        model.forget()

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    schema = f"{kinds}, n_paths int, scores array<double>, n_pieces array<int>, ids_sha256 string, round_trip boolean"
    return docs.select(*keep, F.col("text").alias("_whole")).mapInArrow(tidied(checked), schema)


def decode(rows, model_file, ids="ids", keep=("doc_id",)):
    """Columns ``keep`` and ``decoded``, the text of the ids in column ``ids`` (NULL: empty)."""

    def decoded(batches):
        model = model_of(model_file)
        for batch in batches:
            texts = [model.decode(v.values.to_numpy() if v.is_valid else np.zeros(0, np.int32)) for v in batch.column("_ids")]
            yield pa.record_batch({**{n: batch.column(n) for n in keep}, "decoded": pa.array(texts, pa.string())})

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema)
    return rows.select(*keep, F.col(ids).alias("_ids")).mapInArrow(decoded, f"{kinds}, decoded string")
