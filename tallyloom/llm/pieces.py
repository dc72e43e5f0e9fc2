"""SentencePiece encoding with N-best segmentations, and decoding.

The lattice of a text has an edge for every vocabulary piece that occurs in it and a byte-fallback
edge for every character that is no piece. Forward Viterbi gives each position the best score of
what lies before it. That score is the exact heuristic of an A-star search from the end backwards:
a partial path's priority is the score of any completion of it, so paths come out in order and no
path outside the best N is completed. Pending paths beyond the N best can never be among the
results and are left out, so memory grows with the text, not with the number of segmentations.

Scores are log-probabilities of pieces. A vocabulary of merges has ranks instead, from the most to the
least frequent; these become Zipf's law, log(1 / (rank + 1)) less the log of the sum over all pieces. So
scores follow from the file alone: nothing is trained, and ids do not depend on the corpus. Texts are
encoded as they are, with a leading space and no other normalisation.

A text is cut where no piece can span: before a word-start mark that follows another character,
and between characters that are adjacent in no piece. All paths pass these positions, so the best
segmentation of the text joins the best ones of its parts, and the N best are found by merging the
parts with the smallest losses. Parts repeat, so their results are cached within a task (bounded).

Decoding gives back the text exactly. The mark U+2581 itself is written as bytes.

Edge cases: null and empty texts have no pieces and one segmentation with score 0; a null stays
apart from an empty text only in the input; equal scores come in an order that depends on the part
alone; repeated rows are encoded one by one; an empty table gives an empty result; other columns
are not read. Ids that are no piece decode to nothing.
"""

from __future__ import annotations

import functools
import math
import re
from array import array
from bisect import insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.common import small_batches

MARK = "▁"
N_BEST = 4
#: A character without a piece costs this much more than the worst piece.
FALLBACK_COST = 10.0
CACHE_PARTS = 200_000
_LITERAL = "<mark>"
_LETTER = "[^\\W\\d_]"


def _part_pattern(inner: set[str]) -> re.Pattern:
    """Cuts before word starts and, where no piece holds both, between letters and ASCII signs."""
    letter = lambda c: c.isalnum() and not c.isdecimal()
    bound = {c for pair in inner for c in pair if letter(pair[0]) or letter(pair[1])}
    signs = "".join(re.escape(c) for c in map(chr, range(128)) if not c.isalnum() and c not in bound)
    sign = f"[{signs}]" if signs else "(?!)"
    return re.compile(f"{MARK}*{_LETTER}+(?={sign}|{MARK}|$)|{MARK}*{sign}+(?={_LETTER}|{MARK}|$)|{MARK}+[^{MARK}]*|[^{MARK}]+")


Path = tuple[float, bytes]  # score and int32 ids
Edge = tuple[int, tuple[int, ...], float]  # start, ids, score
Best = tuple[float, bytes, float]  # score and int32 ids of the best path, loss of the second best


def log_probabilities(scores: list[float]) -> list[float]:
    """`scores` as they are, or by Zipf's law if they are ranks (whole numbers, the most frequent first)."""
    if any(s != int(s) for s in scores):
        return scores
    total = sum(1 / (i + 1) for i in range(len(scores)))
    rank = {i: k for k, i in enumerate(sorted(range(len(scores)), key=lambda i: (-scores[i], i)))}
    return [-math.log((rank[i] + 1) * total) for i in range(len(scores))]


class Pieces:
    """A vocabulary with scores, from the bytes of a SentencePiece model file."""

    def __init__(self, model: bytes, n_best: int = N_BEST):
        m = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = m.get_piece_size()
        self.n_best = n_best
        plain = [i for i in range(n) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        self.scores = [0.0] * n
        for i, score in zip(plain, log_probabilities([m.get_score(i) for i in plain]), strict=True):
            self.scores[i] = score
        self.ids: dict[str, int] = {}
        self.table: list[bytes] = [b""] * n
        self.byte_ids: dict[int, int] = {}
        for i in range(n):
            piece = m.id_to_piece(i)
            if m.is_byte(i):
                self.byte_ids[int(piece[1:-1], 16)] = i
                self.table[i] = bytes([int(piece[1:-1], 16)])
        for i in plain:
            self.ids[m.id_to_piece(i)] = i
            self.table[i] = m.id_to_piece(i).replace(MARK, " ").encode()
        self.inner = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.fallback = min((self.scores[i] for i in self.ids.values()), default=0.0) - FALLBACK_COST
        # a node of the tree of pieces: [children by character, ids or None, score]
        self._root: list = [{}, None, 0.0]
        for piece, i in self.ids.items():
            node = self._root
            for c in piece:
                node = node[0].setdefault(c, [{}, None, 0.0])
            node[1:] = [(i,), self.scores[i]]
        self._parts = _part_pattern(self.inner)
        self._cache: dict[str, Best] = {}  # and the generation before it
        self._old: dict[str, Best] = {}
        self._paths: dict[str, list[Path]] = {}

    def _bytes_of(self, char: str) -> tuple[int, ...]:
        return tuple(self.byte_ids[b] for b in char.encode("utf-8", "surrogatepass"))

    def viterbi(self, part: str) -> tuple[list[list[Edge]], list[float]]:
        """For every position, the edges that end there and the best score of what lies before it."""
        n, root = len(part), self._root[0]
        ends: list[list[Edge]] = [[] for _ in range(n + 1)]
        best = [0.0] + [-np.inf] * n
        for i in range(n):
            before, children, single = best[i], root, False
            for j in range(i, n):
                node = children.get(part[j])
                if node is None:
                    break
                children, ids, score = node
                if ids is not None:
                    single |= j == i
                    ends[j + 1].append((i, ids, score))
                    if before + score > best[j + 1]:
                        best[j + 1] = before + score
            if not single:
                ends[i + 1].append((i, self._bytes_of(part[i]), self.fallback))
                best[i + 1] = max(best[i + 1], before + self.fallback)
        return ends, best

    def _best(self, part: str) -> Best:
        """The best path, and how much the second best loses.

        The second best leaves the best one at a single position, so the two best edges into each
        position tell its loss.
        """
        n, root, none = len(part), self._root[0], -np.inf
        best, second, back, taken = [0.0] + [none] * n, [none] * (n + 1), [0] * (n + 1), [None] * (n + 1)
        for i in range(n):
            before, children, single = best[i], root, False
            for j in range(i, n):
                node = children.get(part[j])
                if node is None:
                    break
                children, ids, score = node
                if ids is not None:
                    if j == i:
                        single = True
                    score += before
                    j += 1
                    if score > best[j]:
                        second[j], best[j], back[j], taken[j] = best[j], score, i, ids
                    elif score > second[j]:
                        second[j] = score
            if not single:
                score, j = before + self.fallback, i + 1
                if score > best[j]:
                    second[j], best[j], back[j], taken[j] = best[j], score, i, self._bytes_of(part[i])
                elif score > second[j]:
                    second[j] = score
        at, path, loss = n, [], np.inf
        while at:
            if best[at] - second[at] < loss:
                loss = best[at] - second[at]
            path.append(taken[at])
            at = back[at]
        path.reverse()
        return best[n], array("i", [x for piece in path for x in piece]).tobytes(), loss

    def search(self, part: str) -> list[Path]:
        """The n_best segmentations of a part that is not cut: A-star backwards over the Viterbi scores."""
        ends, best = self.viterbi(part)
        found: list[Path] = []
        # pending: (loss, serial, position, score of the suffix, suffix); the least is expanded first
        pending: list[tuple] = [(0.0, 0, len(part), 0.0, None)]
        serial = 0
        while pending and len(found) < self.n_best:
            loss, _, at, score, suffix = pending.pop(0)
            room = self.n_best - len(found) - 1
            while at:
                taken = None
                for i, ids, s in ends[at]:
                    behind = best[at] - (best[i] + s)  # exactly 0 on the best path
                    step = (i, score + s, (ids, suffix))
                    if taken is None and behind <= 0:
                        taken = step
                    elif room and (len(pending) < room or loss + behind < pending[-1][0]):
                        serial += 1
                        insort(pending, (loss + behind, serial, *step))
                        del pending[room:]
                at, score, suffix = taken
            path: list[int] = []
            while suffix:
                path += suffix[0]
                suffix = suffix[1]
            found.append((score, array("i", path).tobytes()))
        return found

    def _cut(self, part: str) -> list[str]:
        if part.lstrip(MARK).isalpha():
            return [part]
        inner = self.inner
        cuts = [k for k in range(1, len(part)) if part[k - 1 : k + 1] not in inner]
        return [part[a:b] for a, b in zip([0, *cuts], [*cuts, len(part)], strict=True)]

    def part(self, part: str) -> Best:
        """The best segmentation of a part between word starts, cached."""
        got = self._cache.get(part) or self._old.get(part)
        if got is None:
            cut = self._cut(part)
            if len(cut) == 1:
                got = self._best(part)
            else:
                each = [self.part(p) for p in cut]
                got = (sum(e[0] for e in each), b"".join([e[1] for e in each]), min(e[2] for e in each))
        if len(part) <= 64:
            if len(self._cache) >= CACHE_PARTS:
                self._cache, self._old = {}, self._cache
            self._cache[part] = got
        return got

    def paths(self, part: str) -> list[Path]:
        """The n_best segmentations of a part between word starts, cached."""
        got = self._paths.get(part)
        if got is None:
            got = self._search_cut(part)
            if len(self._paths) >= CACHE_PARTS // 10:
                self._paths.clear()
            if len(part) <= 64:
                self._paths[part] = got
        return got

    def _search_cut(self, part: str) -> list[Path]:
        cut = self._cut(part)
        if len(cut) == 1:
            return self.search(part)
        each = [self.part(p) for p in cut]
        ranked = self.merged(each, cut.__getitem__)
        return [(score, b"".join([chosen[k][1] if k in chosen else e[1] for k, e in enumerate(each)])) for score, chosen in ranked]

    def merged(self, parts: list[Best], name: Callable[[int], str]) -> list[tuple[float, dict[int, Path]]]:
        """The n_best combinations of independent parts: (score, {part: its path, where not the best})."""
        total = sum([p[0] for p in parts])
        losses = np.array([p[2] for p in parts])
        # a path of the best n differs from the best one only in the n - 1 parts that lose least
        few = np.argsort(losses, kind="stable")[: self.n_best - 1]
        options: list[tuple[float, dict[int, Path]]] = [(0.0, {})]
        for k in few[np.isfinite(losses[few])].tolist():
            own = self.paths(name(k))
            options = sorted(((loss + own[0][0] - p[0], chosen | ({k: p} if r else {})) for loss, chosen in options for r, p in enumerate(own)), key=lambda x: x[0])[: self.n_best]
        return [(total - loss, chosen) for loss, chosen in options]

    def encode(self, text: str | None) -> tuple[bytes, list[tuple[float, list[tuple[int, int, bytes]]]]]:
        """int32 ids of the best segmentation, and the n_best ones as (score, edits against the best).

        An edit is (first id replaced, ids replaced, new ids).
        """
        if not text:
            return b"", [(0.0, [])]
        if MARK not in text:
            names = self._parts.findall(MARK + text.replace(" ", MARK))
            get, part = self._cache.get, self.part
            return self._encode(names, [get(u) or part(u) for u in names])
        names = []
        for k, literal in enumerate(text.split(MARK)):
            marked = literal.replace(" ", MARK)
            names += [_LITERAL] if k else []
            names += self._parts.findall(marked if k else MARK + marked)
        return self._encode(names, [self._literal() if u is _LITERAL else self.part(u) for u in names])

    def _encode(self, names: list[str], units: list[Best]) -> tuple[bytes, list[tuple[float, list[tuple[int, int, bytes]]]]]:
        best = b"".join([u[1] for u in units])
        ranked = self.merged(units, names.__getitem__)
        places = {k for _, chosen in ranked for k in chosen}
        starts = {k: sum([len(u[1]) for u in units[:k]]) // 4 for k in places}
        return best, [(score, [(starts[k], len(units[k][1]) // 4, p[1]) for k, p in sorted(chosen.items())]) for score, chosen in ranked]

    def _literal(self) -> Best:
        """The mark as a character of the text: its bytes, and no other way."""
        return self.fallback, array("i", self._bytes_of(MARK)).tobytes(), np.inf

    def decode(self, ids: bytes) -> str:
        numbers = np.frombuffer(ids, dtype="<i4")
        if len(numbers) and (numbers.min() < 0 or numbers.max() >= len(self.table)):
            numbers = numbers[(numbers >= 0) & (numbers < len(self.table))]
        return b"".join(map(self.table.__getitem__, numbers.tolist())).decode("utf-8", "surrogatepass")[1:]


@functools.lru_cache(maxsize=1)
def loaded(model: bytes, n_best: int) -> Pieces:
    """The vocabulary, once for each Python worker, so that its cache serves all tasks."""
    return Pieces(model, n_best)


EDIT = T.StructType([T.StructField("at", T.IntegerType()), T.StructField("replaced", T.IntegerType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
PATH = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("edits", T.ArrayType(EDIT))])
_ARROW_PATHS = pa.list_(pa.struct([("score", pa.float64()), ("edits", pa.list_(pa.struct([("at", pa.int32()), ("replaced", pa.int32()), ("ids", pa.list_(pa.int32()))])))]))


def _lists(parts: list[bytes]) -> pa.Array:
    offsets = np.cumsum([0] + [len(p) // 4 for p in parts])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(parts), dtype="<i4")))


def encode(docs: DataFrame, model_path: str, n_best: int = N_BEST, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep`, `ids`, `paths` and `round_trip` for every row of `docs`.

    ids: pieces of the best segmentation. paths: up to `n_best` segmentations, best first, as a score
    and the edits that make its ids from `ids`. round_trip: whether the ids decode to the text.
    """
    with open(model_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())  # the driver's file; executors need none

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(shared.value, n_best)
        for batch in small_batches(batches):
            texts = batch.column("text").to_pylist()
            got = [pieces.encode(t) for t in texts]
            paths = [[{"score": s, "edits": [{"at": a, "replaced": n, "ids": np.frombuffer(x, dtype="<i4")} for a, n, x in edits]} for s, edits in p] for _, p in got]
            same = [pieces.decode(ids) == (t or "") for (ids, _), t in zip(got, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(f"k{i}") for i in range(len(keep))), _lists([ids for ids, _ in got]), pa.array(paths, _ARROW_PATHS), pa.array(same)], [*keep, "ids", "paths", "round_trip"])

    schema = docs.select(*keep).schema.add("ids", T.ArrayType(T.IntegerType())).add("paths", T.ArrayType(PATH)).add("round_trip", "boolean")
    return docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], "text").mapInArrow(encoded, schema)


def decode(encodings: DataFrame, model_path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep` and `text`, decoded from `ids`; null ids give an empty text."""
    with open(model_path, "rb") as f:
        shared = encodings.sparkSession.sparkContext.broadcast(f.read())

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(shared.value, N_BEST)
        for batch in small_batches(batches):
            texts = [pieces.decode(np.array(x or [], dtype="<i4").tobytes()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(f"k{i}") for i in range(len(keep))), pa.array(texts, pa.string())], [*keep, "text"])

    schema = encodings.select(*keep).schema.add("text", "string")
    return encodings.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], "ids").mapInArrow(decoded, schema)
