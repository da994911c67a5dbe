"""SentencePiece encoding and decoding with the N best segmentations.

The lattice of a text has an edge for each piece that stands at a place. Forward Viterbi scores are
the exact best score from the start to each place; a backward A-star search from the end takes them
as its heuristic, so it meets complete paths in the order of their scores and expands nothing else.

No piece goes beyond the end of a word (spaces, then other characters), nor across characters that
only stand alone in the vocabulary. The lattice of a text is therefore a chain of small lattices:
each is searched once and remembered, and a text's N best paths come from the few places where
another choice costs least.
"""

from __future__ import annotations

import heapq
import math
import re
from array import array
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import count, repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from logmere.llm.common import ship_package

SPACE = "▁"
#: What stands for a literal U+2581 of a text; no other stretch has this form.
LITERAL = "x" + SPACE
UNKNOWN_PENALTY = 10.0
#: Stretches remembered; when they are more, those met most often stay, half as many at most.
REMEMBERED = 250_000
MOST_SEVERAL = 5_000
#: Longer stretches are searched one by one, the others so many at a time.
MOST_TOGETHER = 48
TOGETHER = 12_000
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BEST = 4

ENCODED = (
    "id long, ids array<int>, score double,"
    " others array<struct<score: double, changes: array<struct<at: int, n: int, ids: array<int>>>>>"
)


class Path(NamedTuple):
    """A segmentation of a stretch: 32-bit ids, and the sum of the pieces' scores."""

    ids: bytes
    score: float


#: The best path of a stretch: ids, score, and how much the next one costs more.
Found = tuple[bytes, float, float]


class Change(NamedTuple):
    """Instead of ``n`` pieces from ``at`` on, ``ids``."""

    at: int
    n: int
    ids: bytes


#: Score of another path, and its changes of the best one.
Other = tuple[float, list[Change]]
Encoded = tuple[bytes, float, list[Other]]


class Memory:
    """Best paths of stretches. A stretch has a number; what is known of it stands in flat arrays."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.ends = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.int32)
        self.score, self.extra = np.zeros(0), np.zeros(0)
        self.met = np.zeros(0, np.int64)

    def add(self, stretches: list[str], ids: np.ndarray, sizes: np.ndarray, score, extra) -> None:
        """New stretches, with their ids one after another."""
        self.number.update(zip(stretches, range(len(self.number), len(self.number) + len(stretches))))
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
        self.ids = np.concatenate([self.ids, ids])
        self.score, self.extra = np.concatenate([self.score, score]), np.concatenate([self.extra, extra])
        self.met = np.concatenate([self.met, np.zeros(len(sizes), np.int64)])

    def places(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of these stretches stand, one stretch after another, and where each ends."""
        sizes = self.ends[numbers + 1] - self.ends[numbers]
        upto = np.cumsum(sizes)
        total = int(upto[-1]) if len(upto) else 0
        return np.repeat(self.ends[numbers] - (upto - sizes), sizes) + np.arange(total), upto

    def forget(self, most: int) -> None:
        """All but the ``most`` met most often, and those met once."""
        often = np.argsort(-self.met, kind="stable")[:most]
        kept = np.sort(often[self.met[often] > 1])
        old, names = self.__dict__.copy(), list(self.number)
        at, upto = self.places(kept)
        self.clear()
        self.add(
            [names[k] for k in kept.tolist()],
            old["ids"][at],
            np.diff(upto, prepend=0),
            old["score"][kept],
            old["extra"][kept],
        )


class Batch(NamedTuple):
    """Encoded texts: ids one after another, where each text's end, scores, and the other paths."""

    ids: np.ndarray
    upto: np.ndarray
    scores: np.ndarray
    others: list[list[Other]]


class Pieces:
    """The vocabulary of a model, and the search in its lattices."""

    def __init__(self, proto: bytes) -> None:
        model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.scores: dict[str, tuple[int, float]] = {}
        self.bytes_of: list[bytes] = []
        byte_ids: dict[int, int] = {}
        for k in range(model.get_piece_size()):
            piece = model.id_to_piece(k)
            raw = piece.replace(SPACE, " ").encode()
            if model.is_byte(k):
                byte_ids[int(piece[3:-1], 16)] = k
                raw = bytes([int(piece[3:-1], 16)])
            elif model.is_control(k) or model.is_unknown(k):
                raw = b""
            elif not model.is_unused(k):
                self.scores[piece] = (k, model.get_score(k))
            self.bytes_of.append(raw)
        self.byte_ids = byte_ids if len(byte_ids) == 256 else None
        self.unknown_id = model.unk_id()
        self.longest = max(map(len, self.scores), default=1)
        least = min((s for _, s in self.scores.values()), default=0.0)
        self.unknown_score = least - UNKNOWN_PENALTY
        several = [p for p in self.scores if len(p) > 1]
        if any(SPACE in p.lstrip(SPACE) for p in several):
            raise ValueError("a piece of this model goes beyond the end of a word")
        together = set("".join(several))
        alone = "".join(re.escape(c) for c in map(chr, range(128)) if c not in together)
        plain = f"[^{SPACE}{alone}]"
        self.stretches = re.compile(f"{SPACE}*{plain}+|{SPACE}+" + (f"|[{alone}]" if alone else ""))
        #: Pieces and, without a value, what other pieces begin with.
        self.begun: dict[str, tuple[int, float] | None] = {}
        for piece in self.scores:
            self.begun |= {piece[:k]: None for k in range(1, len(piece)) if piece[:k] not in self.begun}
        self.begun |= self.scores
        self.trie_keys: np.ndarray | None = None
        self.known = Memory()
        self.alternatives: dict[str, list[Path]] = {}

    def _grow_trie(self) -> None:
        """Arrays of the beginnings of pieces: (node, character) to node, and what ends there."""
        node = {"": 0} | {text: k for k, text in enumerate(self.begun, 1)}
        keys = np.array([node[t[:-1]] << 21 | ord(t[-1]) for t in self.begun], np.int64)
        order = np.argsort(keys)
        self.trie_keys, self.trie_nodes = keys[order], order + 1
        ended = [self.begun[t] or (-1, 0.0) for t in self.begun]
        self.node_piece = np.array([-1] + [k for k, _ in ended], np.int32)
        self.node_score = np.array([0.0] + [x for _, x in ended])

    def unknown(self, char: str) -> list[int]:
        """A character without a piece, as byte pieces if the model has them."""
        raw = char.replace(SPACE, " ").encode("utf-8", "replace")
        return [self.unknown_id] if self.byte_ids is None else [self.byte_ids[b] for b in raw]

    def search(self, stretch: str, n: int) -> list[Path]:
        """The ``n`` best paths through the lattice of ``stretch``, best first.

        Of paths with equal scores the one whose last pieces are longer is met first, wherever the
        search has both to choose from; the order is the same each time.
        """
        if stretch == LITERAL:
            ids = self.unknown_id if self.byte_ids is None else None
            found = [ids] if ids is not None else [self.byte_ids[b] for b in SPACE.encode()]
            return [Path(np.array(found, np.int32).tobytes(), self.unknown_score)]
        size, get, longest = len(stretch), self.scores.get, self.longest
        unknown = self.unknown_score
        best = [0.0] * (size + 1)
        for end in range(1, size + 1):
            top = -math.inf
            for start in range(max(0, end - longest), end):
                piece = get(stretch[start:end])
                if piece is not None and best[start] + piece[1] > top:
                    top = best[start] + piece[1]
            if get(stretch[end - 1 : end]) is None and best[end - 1] + unknown > top:
                top = best[end - 1] + unknown
            best[end] = top
        order, paths = count(0, -1), []
        heap = [(-best[size], 0, size, 0.0, None)]  # (-bound, order, place, score behind, pieces behind)
        while heap and len(paths) < n:
            bound, _, end, behind, tail = heapq.heappop(heap)
            if end == 0:
                paths.append(Path(self._ids(stretch, tail), -bound))
                continue
            if get(stretch[end - 1 : end]) is None:
                score = behind + unknown
                heapq.heappush(heap, (-(best[end - 1] + score), next(order), end - 1, score, (end - 1, end, -1, tail)))
            for start in range(end - 1, max(0, end - longest) - 1, -1):
                piece = get(stretch[start:end])
                if piece is not None:
                    score = behind + piece[1]
                    heapq.heappush(heap, (-(best[start] + score), next(order), start, score, (start, end, piece[0], tail)))
        return paths

    def _ids(self, stretch: str, tail: tuple | None) -> bytes:
        ids: list[int] = []
        while tail is not None:
            start, end, piece, tail = tail
            ids.extend([piece] if piece >= 0 else self.unknown(stretch[start:end]))
        return np.array(ids, np.int32).tobytes()

    def learn(self, new: list[str]) -> None:
        """Find and remember the best paths of stretches that aren't known."""
        single = [x for x in new if len(x) > MOST_TOGETHER or x == LITERAL]
        short = [x for x in new if len(x) <= MOST_TOGETHER and x != LITERAL]
        for at in range(0, len(short), TOGETHER):
            self._learn_together(short[at : at + TOGETHER], single)
        if single:
            found = [
                (*self.search(x, 1)[0], math.inf) if x == LITERAL else self._viterbi(x) for x in single
            ]
            raws, scores, extras = zip(*found, strict=True)
            sizes = np.array([len(raw) // 4 for raw in raws])
            self.known.add(single, np.frombuffer(b"".join(raws), np.int32), sizes, scores, extras)

    def _learn_together(self, stretches: list[str], left: list[str]) -> None:
        """Forward Viterbi over many short stretches at once; those with a character that has no
        piece are put on ``left``."""
        if not stretches:
            return
        if self.trie_keys is None:
            self._grow_trie()
        codes = np.frombuffer("".join(stretches).encode("utf-32-le"), np.uint32).astype(np.int64)
        size = np.fromiter(map(len, stretches), np.int64, len(stretches))
        end_of = np.cumsum(size)
        start_of = end_of - size
        owner = np.repeat(np.arange(len(size)), size)
        # A place is a character's start, or the end of a stretch; stretch k has size + 1 places.
        shift = owner  # from a character to its place
        begin, stop = start_of + np.arange(len(size)), end_of + np.arange(len(size))
        whole = np.ones(len(size), bool)
        walking, nodes = np.arange(len(codes)), np.zeros(len(codes), np.int64)
        edges: list[tuple] = []
        for length in range(1, self.longest + 1):
            keys = nodes << 21 | codes[walking + length - 1]
            at = np.minimum(np.searchsorted(self.trie_keys, keys), len(self.trie_keys) - 1)
            there = self.trie_keys[at] == keys
            if length == 1:
                alone = there & (self.node_piece[self.trie_nodes[at]] >= 0)
                whole[owner[~alone]] = False
            walking, nodes = walking[there], self.trie_nodes[at[there]]
            piece = self.node_piece[nodes]
            ends = piece >= 0
            first = walking[ends]
            last = first - start_of[owner[first]] + length  # how far into its stretch
            # By how far they go; longer pieces first, as the one search does it.
            rank = last * MOST_TOGETHER + (MOST_TOGETHER - length)
            edges.append((rank, first + shift[first], first + shift[first] + length, piece[ends], self.node_score[nodes[ends]]))
            more = walking + length < end_of[owner[walking]]
            walking, nodes = walking[more], nodes[more]
            if not len(walking):
                break
        best = np.full(len(codes) + len(size), -np.inf)
        second, back, chosen = best.copy(), np.zeros(len(best), np.int64), np.zeros(len(best), np.int32)
        best[begin] = 0.0
        rank, *columns = (np.concatenate(x) for x in zip(*edges, strict=True))
        order = np.argsort(rank, kind="stable")
        rank, (firsts, ends_at, pieces, scores) = rank[order], [x[order] for x in columns]
        cuts = [0, *(np.flatnonzero(np.diff(rank)) + 1).tolist(), len(rank)]
        # Edges of one rank end at different places; of equal scores the first one stays.
        for low, high in zip(cuts, cuts[1:]):
            first, end, score = firsts[low:high], ends_at[low:high], scores[low:high]
            one, two, top = best[first] + score, second[first] + score, best[end]
            better = one > top
            second[end] = np.where(better, np.maximum(top, two), np.maximum(second[end], one))
            back[end] = np.where(better, first, back[end])
            chosen[end] = np.where(better, pieces[low:high], chosen[end])
            best[end] = np.maximum(top, one)
        place, active, found = stop.copy(), np.flatnonzero(whole), []
        while len(active):
            found.append((active, chosen[place[active]]))
            place[active] = back[place[active]]
            active = active[place[active] > begin[active]]
        counts = np.zeros(len(size), np.int64)
        for own, _ in found:
            counts[own] += 1
        upto = np.cumsum(counts)
        ids = np.zeros(int(upto[-1]), np.int32)
        for back_by, (own, piece) in enumerate(found, 1):
            ids[upto[own] - back_by] = piece
        extra = np.subtract(best[stop], second[stop], where=whole, out=np.zeros(len(stop)))
        fine = whole.tolist()
        # Of those with unknown characters nothing was found: no ids stand between the others'.
        known = [x for x, ok in zip(stretches, fine, strict=True) if ok]
        self.known.add(known, ids, counts[whole], best[stop][whole], extra[whole])
        left.extend(x for x, ok in zip(stretches, fine, strict=True) if not ok)

    def _viterbi(self, stretch: str) -> Found:
        """Forward Viterbi with the two best scores of each place, and the best path."""
        size, get, longest, unknown = len(stretch), self.begun.get, self.longest, self.unknown_score
        best, second, back = [-math.inf] * (size + 1), [-math.inf] * (size + 1), [None] * (size + 1)
        best[0] = 0.0
        for start in range(size):
            here, next_best = best[start], second[start]
            for end in range(start + 1, min(size, start + longest) + 1):
                piece = get(stretch[start:end], 0)
                if piece == 0:  # no piece begins like this
                    if end > start + 1:
                        break
                    piece = (-1, unknown)
                elif piece is None:  # the beginning of a piece
                    if end > start + 1:
                        continue
                    piece = (-1, unknown)
                score = here + piece[1]
                if score > best[end]:
                    second[end] = max(best[end], next_best + piece[1])
                    best[end], back[end] = score, (start, piece[0])
                elif score > second[end]:
                    second[end] = score
        ids, end = [], size
        while end:
            start, piece = back[end]
            ids.append([piece] if piece >= 0 else self.unknown(stretch[start:end]))
            end = start
        raw = array("i", [k for part in reversed(ids) for k in part]).tobytes()
        return raw, best[size], best[size] - second[size]

    def several(self, stretch: str, n: int) -> list[Path]:
        paths = self.alternatives.get(stretch)
        if paths is None or len(paths) < n:
            if len(self.alternatives) >= MOST_SEVERAL:
                self.alternatives.clear()
            paths = self.alternatives[stretch] = self.search(stretch, n)
        return paths[:n]

    def cut(self, text: str) -> list[str]:
        """The stretches of a text; a word begins with its spaces, and so does the text."""
        first, *rest = text.split(SPACE)
        parts = self.stretches.findall(SPACE + first.replace(" ", SPACE))
        for part in rest:
            parts.append(LITERAL)
            parts.extend(self.stretches.findall(part.replace(" ", SPACE)))
        return parts

    def encode_batch(self, texts: list[str | None], n: int) -> Batch:
        """Null texts as empty ones."""
        cut = [self.cut(t) if t else [] for t in texts]
        flat = [x for parts in cut for x in parts]
        known = self.known
        if len(known.number) > REMEMBERED:
            known.forget(REMEMBERED // 2)
        numbers = np.fromiter(map(known.number.get, flat, repeat(-1)), np.int64, len(flat))
        missing = np.flatnonzero(numbers < 0).tolist()
        if missing:
            # In the order they come, so that each run does the same.
            self.learn(list(dict.fromkeys(flat[k] for k in missing)))
            numbers[missing] = [known.number[flat[k]] for k in missing]
        known.met += np.bincount(numbers, minlength=len(known.met))
        at, upto = known.places(numbers)
        score, extra = known.score[numbers], known.extra[numbers]
        ends = np.cumsum([len(parts) for parts in cut])
        bounds = np.concatenate([[0], upto])
        sums = np.zeros(len(cut))
        some = [k for k, parts in enumerate(cut) if parts]
        if some:
            sums[some] = np.add.reduceat(score, [ends[k] - len(cut[k]) for k in some])
        others: list[list[Other]] = []
        for parts, end, total in zip(cut, ends.tolist(), sums.tolist(), strict=True):
            low = end - len(parts)
            others.append(
                self._others(parts, extra[low:end], bounds[low : end + 1] - bounds[low], total, n)
                if parts and n > 1
                else []
            )
        return Batch(known.ids[at], bounds[ends], sums, others)

    def encode(self, text: str, n: int) -> Encoded:
        """Ids and score of the best path, and the next ``n - 1`` as changes of it."""
        done = self.encode_batch([text], n)
        return done.ids.tobytes(), float(done.scores[0]), done.others[0]

    def _others(self, parts: list[str], extras: np.ndarray, starts: np.ndarray, score: float, n: int) -> list[Other]:
        """Any path outside of the ``n - 1`` cheapest places costs as much as ``n - 1`` others.

        ``starts``: where the ids of each part begin, and where the last one's end.
        """
        if len(extras) >= n:
            edge = np.partition(extras, n - 2)[n - 2]
            below, same = np.flatnonzero(extras < edge), np.flatnonzero(extras == edge)
            cheap = np.sort(np.concatenate([below, same[: n - 1 - len(below)]]))
        else:
            cheap = np.arange(len(extras))
        places = cheap[extras[cheap] < math.inf].tolist()
        choices = [self.several(parts[at], n) for at in places]
        costs = [[paths[0].score - p.score for p in paths] for paths in choices]
        spans = [(int(starts[at]), int(starts[at + 1] - starts[at])) for at in places]
        origin = (0,) * len(places)
        heap, seen, others = [(0.0, origin)], {origin}, []
        while heap and len(others) < n:
            cost, ranks = heapq.heappop(heap)
            changes = [
                Change(*span, paths[rank].ids)
                for span, paths, rank in zip(spans, choices, ranks, strict=True)
                if rank
            ]
            others.append((score - cost, changes))
            for k, rank in enumerate(ranks):
                further = (*ranks[:k], rank + 1, *ranks[k + 1 :])
                if rank + 1 < len(choices[k]) and further not in seen:
                    seen.add(further)
                    heapq.heappush(heap, (cost - costs[k][rank] + costs[k][rank + 1], further))
        return others[1:]

    def decode(self, ids: np.ndarray) -> str:
        """The text; bytes that aren't UTF-8 become U+FFFD, and the first space is the encoder's."""
        table = self.bytes_of
        raw = b"".join([table[k] for k in ids.tolist()])
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def loaded(proto: bytes) -> Pieces:
    """One for each worker process, with what it remembers."""
    return Pieces(proto)


def changed(ids: list[int], changes: list) -> list[int]:
    """The ids of another path, from the best one's."""
    out, at = [], 0
    for change in sorted(changes, key=lambda c: c["at"]):
        out += [*ids[at : change["at"]], *change["ids"]]
        at = change["at"] + change["n"]
    return out + ids[at:]


def _proto(docs: DataFrame, model: str):
    ship_package(docs.sparkSession)
    with open(model, "rb") as file:
        return docs.sparkSession.sparkContext.broadcast(file.read())


def encode(
    docs: DataFrame,
    n: int = BEST,
    model: str = MODEL,
    id_column: str = "doc_id",
    text_column: str = "text",
    decoded: bool = False,
    keep: Sequence[str] = (),
) -> DataFrame:
    """``id, ids, score, others`` for each row of ``docs``, and ``text`` if ``decoded``.

    The columns ``keep``, whole numbers, come with them.

    ``others``: up to ``n - 1`` next best paths, each with its score and how its ids differ from
    ``ids`` (see ``changed``); fewer if the text has fewer. A null text has null ids and score, an
    empty one no pieces and score 0. Texts and words of any length are taken whole; repeated rows
    are encoded alike; an empty table gives no rows. ``text`` is what ``decode`` makes of the ids, in
    the same pass. The model file (``model``, a path on the
    driver) goes to the tasks as it is.
    """
    if n < 1:
        raise ValueError("n is 1 or more")
    proto = _proto(docs, model)
    kinds = pa.schema(
        [
            ("id", pa.int64()),
            ("ids", pa.list_(pa.int32())),
            ("score", pa.float64()),
            (
                "others",
                pa.list_(
                    pa.struct(
                        [
                            ("score", pa.float64()),
                            (
                                "changes",
                                pa.list_(
                                    pa.struct(
                                        [
                                            ("at", pa.int32()),
                                            ("n", pa.int32()),
                                            ("ids", pa.list_(pa.int32())),
                                        ]
                                    )
                                ),
                            ),
                        ]
                    )
                ),
            ),
        ]
    )

    if decoded:
        kinds = kinds.append(pa.field("text", pa.string()))
    for name in keep:
        kinds = kinds.append(pa.field(name, pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(proto.value)
        for whole in batches:
            for batch in small(whole):
                texts = batch.column("text").to_pylist()
                done = pieces.encode_batch(texts, n)
                null = pa.array([t is None for t in texts], pa.bool_())
                upto = np.concatenate([[0], done.upto])
                ids = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(done.ids), mask=null)
                back = [
                    None if t is None else pieces.decode(done.ids[upto[k] : upto[k + 1]])
                    for k, t in enumerate(texts if decoded else [])
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id"),
                        ids,
                        pa.array(done.scores, mask=np.array(null, bool)),
                        other_paths(done.others),
                        *([pa.array(back, pa.string())] if decoded else []),
                        *(batch.column(name) for name in keep),
                    ],
                    schema=kinds,
                )
            pa.default_memory_pool().release_unused()

    rows = docs.select(
        F.col(id_column).cast("long").alias("id"),
        F.col(text_column).cast("string").alias("text"),
        *(F.col(name).cast("long") for name in keep),
    )
    also = [", text string"] * decoded + [f", {name} long" for name in keep]
    return rows.mapInArrow(run, ENCODED + "".join(also))


ROWS_AT_ONCE, CHARS_AT_ONCE = 500, 500_000


def small(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch: many rows, or few very long ones."""
    low = size = 0
    for k, length in enumerate(pc.utf8_length(batch.column("text")).to_pylist()):
        if k - low == ROWS_AT_ONCE or (k > low and size + (length or 0) > CHARS_AT_ONCE):
            yield batch.slice(low, k - low)
            low, size = k, 0
        size += length or 0
    if batch.num_rows > low:
        yield batch.slice(low)


def other_paths(others: list[list[Other]]) -> pa.Array:
    """``others`` as nested arrays, built from flat ones."""
    paths = [path for of_text in others for path in of_text]
    changes = [change for _, of_path in paths for change in of_path]
    ends = lambda sizes: pa.array(np.cumsum([0, *sizes]), pa.int32())
    ids = pa.ListArray.from_arrays(
        ends(len(c.ids) // 4 for c in changes),
        pa.array(np.frombuffer(b"".join([c.ids for c in changes]), np.int32)),
    )
    columns = [pa.array([c.at for c in changes], pa.int32()), pa.array([c.n for c in changes], pa.int32()), ids]
    of_path = pa.ListArray.from_arrays(
        ends(len(c) for _, c in paths), pa.StructArray.from_arrays(columns, ["at", "n", "ids"])
    )
    scores = pa.array([score for score, _ in paths], pa.float64())
    return pa.ListArray.from_arrays(
        ends(map(len, others)), pa.StructArray.from_arrays([scores, of_path], ["score", "changes"])
    )


def decode(
    encoded: DataFrame, model: str = MODEL, ids_column: str = "ids", to: str = "text"
) -> DataFrame:
    """``encoded`` with the text of its ids as a further column; null ids give a null text.

    Encoding and decoding gives back any text of valid Unicode; control pieces decode to nothing.
    """
    proto = _proto(encoded, model)
    given = encoded.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(proto.value)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                column = batch.column(ids_column)
                texts = [
                    None if ids is None else pieces.decode(ids)
                    for ids in (x.values.to_numpy() if x.is_valid else None for x in column)
                ]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(texts, pa.string())], names=[*given, to]
                )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(run, f"{kinds}, `{to}` string")
