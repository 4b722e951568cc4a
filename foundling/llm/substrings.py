"""Removal of repeated byte strings with a sparse suffix array, sorted deep-shallow.

A string of ``length`` bytes that occurs twice has the same smallest window hash in both places, so suffixes are taken at
those anchors only, about one in ``length / 2`` bytes.  Anchors whose hash occurs once are out.  At the others the text
after the anchor and the reversed text before it are sorted: multikey quicksort to a shallow depth, four bytes at a time
over all groups at once, then blind tries for the groups that still agree.  Neighbours in both orders give the common
lengths to the right and to the left, and so for each offset the classes of strings that agree over ``length`` bytes.

Equal texts are one row before anything is sorted, with their number.  An anchor in more than ``CROWD`` different texts (a
passage that a large part of the corpus shares; so many places take about 100 MB) is not sorted in one task: its strings
are counted by digest, each for itself.
Both ways are exact up to 128-bit digests.

Shorter strings can be found in the same run (``also``): an anchor of a long window is that of the shorter ones around it
too, so both lengths share gram hashes, places, bodies and sorting, and each place says which windows of either length it
stands for.

Defined results: null is an empty text; texts shorter than ``length`` lose nothing; a text that occurs twice loses all of
its bytes if it has ``length``; extra columns pass; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import text_key

LENGTH = 400
GRAM = 32
#: Over fifty words of three letters and a space take so many bytes.
SHORT, WORDS = 200, 51
CROWD = 65_536
SHALLOW = 64
#: Bytes per step; positions in a step take 21 bits.
STEP = 1 << 20
BATCH = 20_000


# --- anchors


def anchors_of(data: np.ndarray, ends: np.ndarray, lengths: Sequence[int], gram: int = GRAM) -> list[tuple[np.ndarray, ...]]:
    """Of texts that stand one after the other, for each length (rising): anchor place, first and last window start, hash of the anchor's gram."""
    n = len(data)
    empty = np.zeros(0, np.int64)
    if n < lengths[0]:
        return [(empty, empty, empty, empty)] * len(lengths)
    with np.errstate(over="ignore"):
        h, base, have = data.astype(np.uint64) + np.uint64(1), np.uint64(0x9E3779B97F4A7C15), 1
        while have < gram:
            h = h[:-have] * base + h[have:]
            base, have = base * base, have * 2
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    low = np.uint64((1 << 21) - 1)
    least, have = (h & ~low) | np.arange(len(h), dtype=np.uint64), 1
    starts = np.concatenate([[0], ends[:-1]])
    found = []
    for length in lengths:
        if n < length:
            found.append((empty, empty, empty, empty))
            continue
        wide = length - gram + 1
        while 2 * have <= wide:
            least = np.minimum(least[:-have], least[have:])
            have *= 2
        own = np.minimum(least[:have - wide], least[wide - have:]) if have < wide else least
        place = (own & low).astype(np.int64)
        inside = np.zeros(n + 2, np.int32)
        long = ends - starts >= length
        np.add.at(inside, starts[long], 1)
        # what begins after a step belongs to the next one
        np.add.at(inside, np.minimum(ends - length + 1, starts + STEP)[long], -1)
        place[np.cumsum(inside[:len(place)]) == 0] = -1
        edge = np.flatnonzero(np.diff(place)) + 1
        first = np.concatenate([[0], edge])
        last = np.concatenate([edge, [len(place)]]) - 1
        real = place[first] >= 0
        first, last = first[real], last[real]
        found.append((place[first], first, last, h[place[first]].view(np.int64)))
    return found


def joined(found: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of all lengths as one: place, hash, and for each length the first and last window start (1 and 0: none)."""
    place, at = np.unique(np.concatenate([f[0] for f in found]), return_index=True)
    h = np.concatenate([f[3] for f in found])[at]
    first, last = np.ones((len(found), len(place)), np.int64), np.zeros((len(found), len(place)), np.int64)
    for i, f in enumerate(found):
        where = np.searchsorted(place, f[0])
        first[i, where], last[i, where] = f[1], f[2]
    return place, h, first, last


def steps(rows: Sequence[tuple], shortest: int, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray, list]]:
    """Texts in bounded steps: joined bytes, ends, and (row, offset in its text).  Long texts overlap by ``longest - 1``."""
    data: list[bytes] = []
    owners: list[tuple] = []
    held = 0

    def flush():
        ends = np.cumsum([len(d) for d in data])
        return np.frombuffer(b"".join(data), np.uint8), ends, owners

    for row in rows:
        text = row[1]
        for at in range(0, max(len(text) - shortest + 1, 0), STEP):
            part = text[at:at + STEP + longest - 1]
            if held and held + len(part) > STEP:
                yield flush()
                data, owners, held = [], [], 0
            data.append(part)
            owners.append((row, at))
            held += len(part)
    if data:
        yield flush()


# --- deep-shallow sorting


def shallow(strings: list[bytes], group: np.ndarray, depth: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort of all groups at once.  Returns the order and the class of each place; equal classes still agree."""
    n = len(strings)
    wide = -(-depth // 4)
    # a byte is 1 to 256 and the end is 0; four of them are one sign
    flat = np.zeros((n, wide * 4), np.uint64)
    joined = np.frombuffer(b"".join(s[:wide * 4] for s in strings), np.uint8)
    sizes = np.array([min(len(s), wide * 4) for s in strings], np.int64)
    rows = np.repeat(np.arange(n), sizes)
    flat[rows, np.arange(len(joined)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = joined.astype(np.uint64) + np.uint64(1)
    signs = np.zeros((n, wide), np.uint64)
    for i in range(4):
        signs = (signs << np.uint64(16)) | flat[:, i::4]
    order = np.argsort(group, kind="stable")
    part = np.unique(group[order], return_inverse=True)[1].astype(np.int64)
    at = np.zeros(n, np.int64)  # signs that a part already agrees on, by place
    while True:
        counts = np.bincount(part)
        open_ = np.flatnonzero((counts[part] > 1) & (at < wide))
        if not len(open_):
            return order, part
        own = part[open_]
        starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        sizes = np.diff(np.append(starts, len(own)))
        key = signs[order[open_], at[open_]]
        pivot = np.repeat(key[starts + sizes // 2], sizes)
        side = np.where(key < pivot, 0, np.where(key > pivot, 2, 1))
        by = np.argsort(own * 3 + side, kind="stable")  # parts stay where they are
        order[open_] = order[open_][by]
        at[open_] = (at[open_] + (side == 1))[by]
        split = np.zeros(n, np.int64)
        split[open_] = side[by]
        part = np.cumsum(np.concatenate([[False], (part[1:] != part[:-1]) | (split[1:] != split[:-1])])).astype(np.int64)


def blind(strings: list[bytes], members: Sequence[int], depth: int) -> list[int]:
    """The members in order, by a blind trie: descend by the branching bytes alone, compare once, put in where they part."""
    root: list = [None, [members[0]]]  # [depth, children] or [None, equal members]
    for m in members[1:]:
        own, node, path = strings[m], root, []
        while node[0] is not None:
            path.append(node)
            d = node[0]
            node = node[1].get(own[d] if d < len(own) else -1) or next(iter(node[1].values()))
        other = strings[node[1][0]]
        same = common(own, other)
        if same == len(own) == len(other):
            node[1].append(m)
            continue
        above = None
        for node in path:
            if node[0] >= same:
                break
            above = node
        else:
            node = None
        if above is None:
            below = root
        else:
            below = above[1].get(own[above[0]] if above[0] < len(own) else -1)
        sign = own[same] if same < len(own) else -1
        if below is not None and below[0] == same:
            below[1][sign] = [None, [m]]
            continue
        fresh = [same, {sign: [None, [m]], (other[same] if same < len(other) else -1): below}]
        if above is None:
            root = fresh
        else:
            above[1][own[above[0]] if above[0] < len(own) else -1] = fresh
    out, stack = [], [root]
    while stack:
        depth_, rest = stack.pop()
        if depth_ is None:
            out += rest
        else:
            stack += [rest[c] for c in sorted(rest, reverse=True)]
    return out


def common(a: bytes, b: bytes) -> int:
    """Length of the common beginning."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    apart = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (apart.bit_length() + 7) // 8


def deep_shallow(strings: list[bytes], group: np.ndarray, depth: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings within their groups, and what each has in common with the one before (0 for a group's first)."""
    order, part = shallow(strings, group, depth)
    counts = np.bincount(part)
    for p in np.flatnonzero(counts > 1):
        at = np.searchsorted(part, p)
        order[at:at + counts[p]] = blind(strings, order[at:at + counts[p]].tolist(), depth)
    ordered, groups = [strings[i] for i in order], group[order]
    same = [0] + [common(a, b) if g == k else 0 for a, b, g, k in zip(ordered, ordered[1:], groups, groups[1:], strict=False)]
    return order, np.array(same, np.int64)


def both_ways(lefts: list[bytes], rights: list[bytes], group: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Order, common lengths and first places of groups, to the right and to the left.  ``lefts`` is what stands before an
    anchor within its windows, reversed; ``rights`` what follows."""
    return [(o, same, np.concatenate([[True], group[o][1:] != group[o][:-1]])) for o, same in (deep_shallow(x, group) for x in (rights, lefts))]


def repeated(fall: list[tuple[np.ndarray, ...]], copies: np.ndarray, length: int, least: np.ndarray, most: np.ndarray) -> list[tuple[int, int, int]]:
    """(place, first offset, last offset) of windows that occur twice; offset o is the window that begins o bytes before the
    anchor, and a place has those from ``least`` to ``most``."""
    n, has = len(copies), least <= most
    if not has.any():
        return []
    low, high = int(least[has].min()), int(most[has].max())
    hit = np.zeros((high - low + 2, n), bool)
    classes = np.zeros((2, n), np.int64)
    for o in range(low, high + 1):
        here = np.flatnonzero((least <= o) & (o <= most))
        if len(here) < 2 and not (copies[here] > 1).any():
            continue
        for i, need in enumerate((length - o, o)):
            order, same, border = fall[i]
            classes[i, order] = np.cumsum((same < need) | border)
        both = classes[0, here] * (n + 1) + classes[1, here]
        _, which = np.unique(both, return_inverse=True)
        hit[o - low, here] = np.bincount(which, copies[here])[which] > 1
    turns = np.diff(np.concatenate([np.zeros((1, n), np.int8), hit.astype(np.int8)]), axis=0)
    begin, end = np.argwhere(turns.T == 1), np.argwhere(turns.T == -1)
    return [(int(i), int(a) + low, int(b) - 1 + low) for (i, a), (_, b) in zip(begin, end, strict=True)]


# --- the job

TEXT, COPIES = "text", "copies"


def _rows(batch: pa.RecordBatch) -> list[tuple]:
    """(key, text, copies, hashes, crowded hashes) of a batch."""
    columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
    return list(zip(*columns, strict=True))


def _hash_rows(lengths: Sequence[int], gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, ends, owners in steps(_rows(batch), lengths[0], lengths[-1]):
                place, h, _, _ = joined(anchors_of(data, ends, lengths, gram))
                if not len(place):
                    continue
                owner = np.searchsorted(ends, place, side="right")
                by = np.lexsort((h, owner))
                owner, h = owner[by], h[by]
                new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])]))
                owner, h, counts = owner[new], h[new], np.diff(np.append(new, len(h)))
                keys = pa.array([o[0][0] for o in owners], pa.binary()).take(pa.array(owner))
                copies = np.array([o[0][2] for o in owners], np.int64)[owner]
                yield pa.RecordBatch.from_arrays([keys, pa.array(h), pa.array(counts * copies)], names=["key", "hash", "n"])

    return run


PLACES = "hash long, key binary, at long, left int, body binary, copies long, reach binary, size int"


def _places(lengths: Sequence[int], gram: int, dense: bool):
    """Windows of shared anchors: their text and the offsets of the windows of each length (``reach``), or with ``dense``,
    for crowded anchors, a digest of each window and its length (``size``)."""
    sizes = np.array(lengths, np.int64)[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import blake2b

        for batch in batches:
            for data, ends, owners in steps(_rows(batch), lengths[0], lengths[-1]):
                place, h, first, last = joined(anchors_of(data, ends, lengths, gram))
                owner = np.searchsorted(ends, place, side="right")
                raw, starts = data.tobytes(), np.concatenate([[0], ends[:-1]])
                cut = np.searchsorted(owner, np.arange(len(owners) + 1))
                has = first <= last
                begin, end = np.where(has, first, len(raw)).min(axis=0), np.where(has, last + sizes, 0).max(axis=0)
                reach = np.where(has[:, :, None], place[None, :, None] - np.stack([last, first], axis=2), np.array([0, -1])).astype(np.int32).transpose(1, 0, 2).copy()
                out: list[tuple] = []
                for i, ((key, _, copies, hashes, crowded), offset) in enumerate(owners):
                    if not hashes or cut[i] == cut[i + 1]:
                        continue
                    crowd = np.isin(h[cut[i]:cut[i + 1]], np.array(crowded or (), np.int64))
                    wanted = crowd if dense else np.isin(h[cut[i]:cut[i + 1]], np.array(hashes, np.int64)) & ~crowd
                    base = offset - int(starts[i])
                    for j in (np.flatnonzero(wanted) + cut[i]).tolist():
                        if dense:
                            for length, f, l in zip(lengths, first[:, j].tolist(), last[:, j].tolist(), strict=True):
                                for k in range(f, l + 1):
                                    mark = blake2b(raw[k:k + length], digest_size=16).digest()
                                    out.append((int.from_bytes(mark[:8], "little", signed=True), key, k + base, None, mark, copies, None, length))
                        else:
                            a = int(begin[j])
                            out.append((int(h[j]), key, a + base, int(place[j]) - a, raw[a:int(end[j])], copies, reach[j].tobytes(), None))
                if out:
                    c = list(zip(*out, strict=True))
                    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.binary(), pa.int32()]
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(c, kinds, strict=True)], names=["hash", "key", "at", "left", "body", "copies", "reach", "size"])

    return run


def _resolve(lengths: Sequence[int], batch_rows: int):
    def solve(rows: list[tuple]) -> list[tuple]:
        alike: dict[tuple, list[int]] = {}
        for i, (code, _, _, left, body, _, reach, _) in enumerate(rows):
            alike.setdefault((code, left, body, reach), []).append(i)
        kept = list(alike)
        copies = np.array([sum(rows[i][5] for i in own) for own in alike.values()], np.int64)
        lefts = [body[:left][::-1] for _, left, body, _ in kept]
        rights = [body[left:] for _, left, body, _ in kept]
        fall = both_ways(lefts, rights, np.array([k[0] for k in kept], np.int64))
        reach = np.frombuffer(b"".join(k[3] for k in kept), np.int32).reshape(len(kept), len(lengths), 2)
        found = []
        for x, length in enumerate(lengths):
            for which, low, high in repeated(fall, copies, length, reach[:, x, 0], reach[:, x, 1]):
                for i in alike[kept[which]]:
                    _, key, at, left, *_ = rows[i]
                    found.append((key, at + left - high, at + left - low + length, length))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(found):
            c = list(zip(*found, strict=True)) or [(), (), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c[0], pa.binary()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.int32())], names=["key", "a", "b", "size"])

        held: list[tuple] = []
        for batch in batches:
            held += _rows(batch)
            if len(held) >= batch_rows:
                edge = len(held)
                while edge and held[edge - 1][0] == held[-1][0]:
                    edge -= 1
                if edge:  # the last group may go on
                    yield out(solve(held[:edge]))
                    held = held[edge:]
        if held:
            yield out(solve(held))

    return run


def _runs(text: bytes, copies: int, spans: list, length: int) -> list[list[int]]:
    """Maximal runs of the bytes that the spans of one length cover."""
    if copies > 1 and len(text) >= length:
        return [[0, len(text)]]
    merged: list[list[int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans if s["size"] == length):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    return merged


def _cut(length: int, words: int, as_text: bool, also: int, also_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, text, copies, spans in _rows(batch):
                merged = _runs(text, copies, spans or (), length)
                if words:
                    merged = [m for m in merged if m[1] - m[0] >= LENGTH or len(text[m[0]:m[1]].split()) >= words]
                rest, at = [], 0
                for a, b in merged:
                    rest.append(text[at:a])
                    at = b
                rest.append(text[at:])
                if as_text:
                    rest = [part.decode(errors="ignore").encode() for part in rest]
                passages = [b - a for a, b in _runs(text, copies, spans or (), also) if len(text[a:b].split()) >= also_words] if also else []
                out.append((key, len(text), sum(b - a for a, b in merged), len(merged), b"".join(rest), [{"a": a, "b": b} for a, b in merged], len(passages), sum(passages)))
            c = list(zip(*out, strict=True)) or [()] * 8
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, k) for x, k in zip(c, kinds, strict=True)], names=["key", "n_bytes", "n_removed", "n_spans", "kept", "spans", "n_passages", "n_passage_bytes"],
            )

    return run


def cut(
    docs: DataFrame, *, text: str = "text", length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD, batch_rows: int = BATCH, words: int = 0, as_text: bool = False,
    also: int = 0, also_words: int = 0,
) -> DataFrame:
    """A row for each distinct text: ``key`` (:func:`common.text_key`), n_bytes, n_removed, n_spans, kept bytes, spans.
    With ``words``, spans of fewer words that are shorter than ``LENGTH`` stay.  ``as_text`` drops what a cut leaves of a character, so that the kept bytes are UTF-8.
    ``also`` is a shorter length (``gram`` at least): n_passages and n_passage_bytes are then the maximal runs of bytes that
    its repeated strings cover, of ``also_words`` words and more, which are only told and not taken out."""
    lengths = sorted({length, also or length})
    if also > length or 0 < also < gram:
        raise ValueError("also: from gram to length")
    body = F.coalesce(F.col(text), F.lit(""))
    # a key that can't be null: else the inner join below filters it before the texts are shuffled, and they are shuffled twice
    texts = docs.select(F.coalesce(text_key(body), F.lit(b"")).alias("key"), body.cast("binary").alias("text")).groupBy("key").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    hashes = texts.mapInArrow(_hash_rows(lengths, gram), "key binary, hash long, n long")
    shared = hashes.groupBy("hash").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("texts")).filter("total > 1")
    wanted = (
        hashes.join(shared, "hash").groupBy("key")
        .agg(F.collect_list("hash").alias("hashes"), F.collect_list(F.when(F.col("texts") > crowd, F.col("hash"))).alias("crowded"))
    )
    both = texts.join(wanted, "key").select("key", "text", "copies", "hashes", "crowded")
    sorted_ = both.mapInArrow(_places(lengths, gram, False), PLACES).repartition("hash").sortWithinPartitions("hash").mapInArrow(_resolve(lengths, batch_rows), "key binary, a long, b long, size int")
    # read twice, but only texts that have a crowded anchor
    crowded = both.filter(F.size("crowded") > 0).mapInArrow(_places(lengths, gram, True), PLACES).select("body", "key", "at", "copies", "size")
    twice = crowded.groupBy("body").agg(F.sum("copies").alias("n")).filter("n > 1").select("body")
    counted = crowded.join(twice, "body").select("key", F.col("at").alias("a"), (F.col("at") + F.col("size")).alias("b"), "size")
    spans = sorted_.union(counted).groupBy("key").agg(F.collect_list(F.struct("a", "b", "size")).alias("spans"))
    found = texts.join(spans, "key", "left").select("key", "text", "copies", "spans").mapInArrow(
        _cut(length, words, as_text, also, also_words),
        "key binary, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<a:long,b:long>>, n_passages long, n_passage_bytes long",
    )
    return found if also else found.drop("n_passages", "n_passage_bytes")
