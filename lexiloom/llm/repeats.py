"""Removal of byte passages that stand in an earlier document, by prefix-free parsing.

A rolling hash over `TRIGGER` bytes makes trigger points: a point is one if its
hash is the least within some window of `SPAN` bytes. So every string of `SPAN`
bytes holds a trigger, at the same place in it wherever it stands, and phrases
between triggers are the same in all copies of a passage. A suffix of a phrase
is known by its trigger and what is left and right of it; sorting triggers with
their surroundings, bucket by bucket of their hashes, brings equal suffixes of
all documents together, as the suffix arrays of dictionary and parse would.

Three questions narrow the work down, each asked by every part of the corpus
about its own distinct hashes and answered with one bit for each:

1. Does the trigger stand in more than one document? Most don't.
2. Does its whole surrounding (all strings of `SPAN` bytes that may hang on the
   trigger) stand in an earlier document? Then all of these strings do. And does
   a half of the surrounding go on in more than one way? If not, no single
   string can stand in an earlier document.
3. For first surroundings with such a half: does the string stand in an earlier
   document?

Documents are kept in parts of about `PART_BYTES` as files in the shared folder;
only hashes and bits are shuffled. A part sends one row per bucket whatever its
texts repeat, so no hash is heavier than the number of parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import run_folder, stored
from .shingles import mixed
from .token_files import file_system

SPAN, TRIGGER = 50, 20
#: Strings of SPAN bytes that a trigger can be in, by how far left of it they start.
REACH = SPAN - TRIGGER
HALF = REACH // 2
PART_BYTES = 1 << 20
#: Places that are hashed at once.
BLOCK = 1 << 18
#: Buckets of hashes: at least so many, and one for so many bytes of text.
LEAST_BUCKETS, BUCKET_BYTES = 64, 1 << 24
#: Bytes of a hash that are sent: fewer where the answer only narrows the search, all 64 bits where it decides.
KEY_BYTES = (6, 8, 6, 6, 8)
BASE = 0x9E3779B97F4A7C15
PART = "part_id LONG, n_bytes LONG"
ASKED = "kind INT, bucket LONG, part_id LONG, keys BINARY, base LONG, marks BINARY, width INT"
ANSWER = "kind INT, bucket LONG, part_id LONG, bits BINARY, n LONG"
TRIGGERS, WHOLES, LEFTS, RIGHTS, STRINGS = range(5)


@cache
def _letters():
    """A number for each byte."""
    import numpy as np

    return mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


@cache
def _powers(n: int, base: int = BASE):
    """base^0, base^1 and so on modulo 2^64."""
    import numpy as np

    steps = np.full(n, base, dtype=np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


def _sliding(values, width: int, least):
    """The least (or largest) of each run of `width` values."""
    import numpy as np

    n = len(values)
    rows = np.concatenate([values, np.full(-n % width, values[-1], values.dtype)]).reshape(-1, width)
    ahead, back = least.accumulate(rows, axis=1).ravel(), least.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - width + 1
    return least(back[:count], ahead[width - 1 : width - 1 + count])


class Part:
    """Documents laid end to end: `data`, where each one `starts` and `ends`, its `ids` and whether it takes part."""

    def __init__(self, ids: list[int | None], texts: list[bytes]):
        import numpy as np

        self.ids, self.none = np.array([0 if i is None else i for i in ids], dtype=np.int64), np.array([i is None for i in ids], dtype=bool)
        self.data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        self.ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        self.starts = self.ends - np.array([len(t) for t in texts], dtype=np.int64)

    def owner(self, places):
        import numpy as np

        return np.searchsorted(self.ends, places, side="right")

    def triggers(self):
        """(trigger points in ascending order, their hashes), in documents with an id and of at least SPAN bytes."""
        import numpy as np

        n, found, keys = len(self.data), [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.uint64)]
        most, least = np.uint64(2**64 - 1), np.uint64(0)
        for at in range(0, n, BLOCK):
            low, high = max(0, at - REACH), min(n, at + BLOCK + REACH)
            if high - low <= REACH:
                continue
            places = np.arange(low, high)
            reach = min(n, high + TRIGGER)
            sums = np.concatenate(([least], np.cumsum(_letters()[self.data[low:reach]] * _powers(BLOCK + 4 * SPAN)[: reach - low], dtype=np.uint64)))
            first, last = self.owner(np.array([low, high - 1]))
            held = np.minimum(self.ends[first : last + 1], high) - np.maximum(self.starts[first : last + 1], low)
            ends = np.repeat(self.ends[first : last + 1], held)
            good = places + TRIGGER <= ends
            stop = np.minimum(places + TRIGGER - low, reach - low)
            hashes = np.where(good, mixed((sums[stop] - sums[places - low]) * _powers(BLOCK + 4 * SPAN, pow(BASE, -1, 1 << 64))[: high - low]), most)
            lowest = _sliding(hashes, REACH + 1, np.minimum)
            fits = places[: len(lowest)] + SPAN <= ends[: len(lowest)]
            lowest = np.where(fits, lowest, least)
            edge = np.zeros(REACH, dtype=np.uint64)
            best = _sliding(np.concatenate([edge, lowest, edge]), REACH + 1, np.maximum)
            chosen = np.flatnonzero((best == hashes) & good & (best > least) & (places >= at) & (places < at + BLOCK))
            found.append(places[chosen])
            keys.append(hashes[chosen])
        points, hashes = np.concatenate(found), np.concatenate(keys)
        sound = ~self.none[self.owner(points)] if len(points) else np.zeros(0, dtype=bool)
        return points[sound], hashes[sound]

    def around(self, points, before: int, after: int):
        """Hashes of the bytes from `before` left of each point to `after` right of it; bytes of other documents count as none."""
        import numpy as np

        out = np.empty(len(points), dtype=np.uint64)
        offsets, powers, letters = np.arange(-before, after), _powers(before + after), _letters()
        for at in range(0, len(points), 8192):
            own = points[at : at + 8192]
            owner = self.owner(own)
            low, high = max(0, int(own[0]) - before), min(len(self.data), int(own[-1]) + after)
            near = letters[self.data[low:high]]
            inner = (own - before >= self.starts[owner]) & (own + after <= self.ends[owner])
            part = np.empty(len(own), dtype=np.uint64)
            if inner.any():
                part[inner] = np.lib.stride_tricks.sliding_window_view(near, before + after)[own[inner] - before - low] @ powers
            places = own[~inner][:, None] + offsets
            inside = (places >= self.starts[owner[~inner]][:, None]) & (places < self.ends[owner[~inner]][:, None])
            values = np.where(inside, near[np.clip(places - low, 0, len(near) - 1)], np.uint64(0))
            part[~inner] = values @ powers
            out[at : at + 8192] = mixed(part)
        return out


def short(kind: int, hashes):
    """The leading bytes of 64-bit hashes that a question of this kind sends, as numbers."""
    import numpy as np

    return hashes >> np.uint64(64 - 8 * KEY_BYTES[kind])


def _packed(values, width: int) -> bytes:
    import numpy as np

    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpacked(data, width: int):
    import numpy as np

    own = np.frombuffer(data, dtype=np.uint8).reshape(-1, width)
    out = np.zeros((len(own), 8), dtype=np.uint8)
    out[:, :width] = own
    return out.view("<u8").ravel().astype(np.uint64)


def _question(kind: int, part_id: int, buckets: int, keys, marks):
    """Rows that ask about sorted distinct keys; `marks` are numbers to be compared among parts."""
    import numpy as np
    import pyarrow as pa

    shift = np.uint64(8 * KEY_BYTES[kind] - (buckets.bit_length() - 1))
    bounds = np.searchsorted(keys >> shift, np.arange(buckets + 1, dtype=np.uint64))
    bounds[-1] = len(keys)
    rows = []
    for bucket in range(buckets):
        low, high = bounds[bucket], bounds[bucket + 1]
        if high > low or bucket == 0:  # bucket 0 always asks: so every part gets an answer and goes on
            own = marks[low:high]
            base = int(own.min()) if len(own) else 0
            span = (int(own.max()) - base if len(own) else 0) or 1
            width = (span.bit_length() + 7) // 8
            own = (own.astype(np.int64) - base).astype(np.uint64) if len(own) else np.zeros(0, dtype=np.uint64)
            rows.append((kind, bucket, part_id, _packed(keys[low:high], KEY_BYTES[kind]), base, _packed(own, width), width))
    types = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int32()]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["kind", "bucket", "part_id", "keys", "base", "marks", "width"])


def _grouped(keys, marks, last: bool = False):
    """Distinct keys in order with the least mark of each, and the largest one if `last`."""
    import numpy as np

    order = np.lexsort((marks, keys))
    keys, marks = keys[order], marks[order]
    first = np.concatenate((np.ones(min(1, len(keys)), dtype=bool), keys[1:] != keys[:-1]))
    if not last:
        return keys[first], marks[first]
    ends = np.concatenate((first[1:], np.ones(min(1, len(keys)), dtype=bool)))
    return keys[first], marks[first], marks[ends]


#: A mark of keys that already differ within their part.
SEVERAL = -1


def _differing(keys, marks):
    keys, low, high = _grouped(keys, marks, last=True)
    return keys, low, low != high


def _give_back() -> None:
    """Hand memory that a finished group held back to the system: a worker goes on to other groups, beside a second worker and the JVM."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # only the C library of Linux has it
        pass


def _answered(key, table):
    """One bit for each key of each part: WHOLES and STRINGS: an earlier document has it; others: marks differ anywhere."""
    import numpy as np
    import pyarrow as pa

    kind, bucket = key[0].as_py(), key[1].as_py()
    base, width, part_ids = (table.column(c).to_pylist() for c in ("base", "width", "part_id"))
    keys = [_unpacked(k.as_buffer(), KEY_BYTES[kind]) for k in table.column("keys")]
    ends = np.cumsum([len(k) for k in keys])
    keys = np.concatenate(keys)
    marks = np.concatenate([_unpacked(m.as_buffer(), w).astype(np.int64) + b for m, w, b in zip(table.column("marks"), width, base, strict=True)])
    del table
    order = np.argsort(keys, kind="stable")
    keys, marks = keys[order], marks[order]  # one after the other: few arrays of all keys live at a time
    at = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), dtype=bool), keys[1:] != keys[:-1])))
    sizes = np.diff(at, append=len(keys))
    del keys
    bits = np.zeros(len(marks), dtype=bool)
    if len(marks):
        low = np.minimum.reduceat(marks, at)
        if kind in (WHOLES, STRINGS):
            bits[order] = np.repeat(low, sizes) < marks
        else:
            bits[order] = np.repeat((low != np.maximum.reduceat(marks, at)) | (low == SEVERAL), sizes)
    del order, marks
    counts = np.diff(ends, prepend=0).tolist()
    packed = [np.packbits(bits[e - c : e]).tobytes() for c, e in zip(counts, ends.tolist(), strict=True)]
    _give_back()
    n = len(counts)
    return pa.table(
        [pa.array([kind] * n, pa.int32()), pa.array([bucket] * n, pa.int64()), pa.array(part_ids, pa.int64()), pa.array(packed, pa.binary()), pa.array(counts, pa.int64())],
        names=["kind", "bucket", "part_id", "bits", "n"],
    )


def _answers(table, kind: int):
    """A part's bits of one kind, in the order of its sorted distinct keys."""
    import numpy as np

    rows = sorted((r for r in table.to_pylist() if r["kind"] == kind), key=lambda r: r["bucket"])
    return np.concatenate([np.zeros(0, dtype=bool), *(np.unpackbits(np.frombuffer(r["bits"], dtype=np.uint8), count=r["n"]).astype(bool) for r in rows)])


def _write(folder: str, name: str, content: bytes) -> None:
    import zstandard

    system, root = file_system(folder)
    system.create_dir(root, recursive=True)
    temporary = f"{root}/.{name}-{TaskContext.get().taskAttemptId()}"
    with system.open_output_stream(temporary) as out:
        out.write(zstandard.ZstdCompressor(level=3).compress(content))
    system.move(temporary, f"{root}/{name}")


def _read(folder: str, name: str) -> bytes:
    import zstandard

    system, root = file_system(folder)
    with system.open_input_file(f"{root}/{name}") as source:
        return zstandard.ZstdDecompressor().decompress(source.read())


def _save_part(folder: str, part_id: int, ids: list[int | None], texts: list[bytes]) -> None:
    import pickle

    _write(folder, f"part-{part_id}", pickle.dumps((ids, texts), protocol=5))


def _load_part(folder: str, part_id: int) -> Part:
    import pickle

    return Part(*pickle.loads(_read(folder, f"part-{part_id}")))


def _save_points(folder: str, name: str, points) -> None:
    import numpy as np

    _write(folder, name, np.diff(points, prepend=0).astype("<u4").tobytes())


def _saved_points(folder: str, name: str):
    import numpy as np

    return np.cumsum(np.frombuffer(_read(folder, name), dtype="<u4").astype(np.int64))


class Flagged:
    """A part's triggers that stand in several documents, with the hashes of their surroundings."""

    def __init__(self, folder: str, part_id: int, answers=None):
        """With the answers to the first question they are found and saved, without them read."""
        import numpy as np

        _give_back()
        self.part = _load_part(folder, part_id)
        if answers is None:
            self.points = _saved_points(folder, f"flagged-{part_id}")
        else:
            points = _saved_points(folder, f"points-{part_id}")
            distinct, place = np.unique(short(TRIGGERS, self.part.around(points, 0, TRIGGER)), return_inverse=True)
            self.points = points[_answers(answers, TRIGGERS)[place]] if len(points) else points
            _save_points(folder, f"flagged-{part_id}", self.points)
        owner = self.part.owner(self.points)
        self.ids = self.part.ids[owner]
        self.left, self.right = self.points - self.part.starts[owner], self.part.ends[owner] - self.points
        self.whole = self.part.around(self.points, REACH, SPAN)
        self.lefts, self.rights = self.left >= HALF, self.right >= TRIGGER + HALF

    def half(self, kind: int):
        """(short hashes of the halves, which triggers have that half)."""
        if kind == LEFTS:
            return short(kind, self.part.around(self.points[self.lefts], HALF, TRIGGER)), self.lefts
        return short(kind, self.part.around(self.points[self.rights], 0, TRIGGER + HALF)), self.rights

    def settled(self, answers):
        """Which triggers' whole surroundings stand in an earlier document."""
        import numpy as np

        keys = short(WHOLES, self.whole)
        distinct, low = _grouped(keys, self.ids)
        place = np.searchsorted(distinct, keys)
        return _answers(answers, WHOLES)[place] | (self.ids > low[place]) if len(keys) else np.zeros(0, dtype=bool)

    def strings(self, answers, settled):
        """(starts, ids) of the single strings to be asked about: first surroundings with a half that goes on in several ways."""
        import numpy as np

        wanted = np.zeros(len(self.part.data), dtype=bool)
        for kind, far in ((LEFTS, range(HALF, REACH + 1)), (RIGHTS, range(HALF + 1))):
            keys, having = self.half(kind)
            distinct, place = np.unique(keys, return_inverse=True)
            several = np.zeros(len(self.points), dtype=bool)
            several[having] = _answers(answers, kind)[place] if len(keys) else False
            open_ones = np.flatnonzero(several & ~settled)
            for x in far:
                own = open_ones[(self.left[open_ones] >= x) & (self.right[open_ones] >= SPAN - x)]
                wanted[self.points[own] - x] = True
        starts = np.flatnonzero(wanted)
        return starts, self.part.ids[self.part.owner(starts)]


def _file_parts(docs: DataFrame, folder: str) -> DataFrame:
    """Write the documents as part files and return (part_id, n_bytes)."""

    def deal(batches: Iterator) -> Iterator:
        import pyarrow as pa

        part_id, ids, texts, held = TaskContext.get().partitionId() << 36, [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                ids.append(doc_id.as_py())
                texts.append((text.as_py() or "").encode("utf-8", "surrogatepass"))
                held += len(texts[-1])
                if held >= PART_BYTES:
                    _save_part(folder, part_id, ids, texts)
                    yield pa.RecordBatch.from_pydict({"part_id": [part_id], "n_bytes": [held]})
                    part_id, ids, texts, held = part_id + 1, [], [], 0
        if ids:
            _save_part(folder, part_id, ids, texts)
            yield pa.RecordBatch.from_pydict({"part_id": [part_id], "n_bytes": [held]})

    return stored(docs.select("doc_id", "text").mapInArrow(deal, PART), "parts")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, starts, ends, kept): byte spans of each text that stand in a document with a smaller id, and the rest.

    A byte goes if a string of SPAN bytes around it also starts in a document
    with a smaller doc_id. A null text counts as empty; a document with a null
    id loses nothing and takes nothing from others; rows that share an id take
    nothing from each other; other columns are not read; an empty table gives
    no row. Texts of under SPAN bytes stay whole.
    """
    folder = f"{run_folder(docs.sparkSession, 'repeats')}/parts"
    parts = _file_parts(docs, folder)
    n_bytes = parts.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = 1 << max(LEAST_BUCKETS.bit_length() - 1, (n_bytes // BUCKET_BYTES).bit_length())

    def ask_triggers(batches: Iterator) -> Iterator:
        import numpy as np

        for batch in batches:
            for part_id in batch.column("part_id").to_pylist():
                part = _load_part(folder, part_id)
                points, hashes = part.triggers()
                _save_points(folder, f"points-{part_id}", points)
                _give_back()
                keys, low, several = _differing(short(TRIGGERS, hashes), part.ids[part.owner(points)])
                yield from _question(TRIGGERS, part_id, buckets, keys, np.where(several, SEVERAL, low)).to_batches()

    def ask_surroundings(key, answers):
        import numpy as np
        import pyarrow as pa

        part_id = key[0].as_py()
        own = Flagged(folder, part_id, answers)
        tables = [_question(WHOLES, part_id, buckets, *_grouped(short(WHOLES, own.whole), own.ids))]
        for kind in (LEFTS, RIGHTS):
            keys, having = own.half(kind)
            # 62 bits of the whole surrounding: marks stay positive, and as sure as the hashes that decide.
            distinct, low, several = _differing(keys, (own.whole[having] >> np.uint64(2)).astype(np.int64))
            tables.append(_question(kind, part_id, buckets, distinct, np.where(several, SEVERAL, low)))
        return pa.concat_tables(tables)

    def ask_strings(key, answers):
        part_id = key[0].as_py()
        own = Flagged(folder, part_id)
        starts, ids = own.strings(answers, own.settled(answers))
        return _question(STRINGS, part_id, buckets, *_grouped(short(STRINGS, own.part.around(starts, 0, SPAN)), ids))

    def remove(key, answers):
        import numpy as np
        import pyarrow as pa

        own = Flagged(folder, key[0].as_py())
        part, settled = own.part, own.settled(answers)
        starts, ids = own.strings(answers, settled)
        keys = short(STRINGS, part.around(starts, 0, SPAN))
        distinct, low = _grouped(keys, ids)
        place = np.searchsorted(distinct, keys)
        if len(keys):
            starts = starts[_answers(answers, STRINGS)[place] | (ids > low[place])]
        whole = np.flatnonzero(settled & (own.left + own.right >= SPAN))
        first = own.points[whole] - np.minimum(own.left[whole], REACH)
        last = own.points[whole] + np.minimum(own.right[whole], SPAN)
        steps = np.zeros(len(part.data) + 1, dtype=np.int32)
        for places, step in ((first, 1), (starts, 1), (last, -1), (starts + SPAN, -1)):
            np.add.at(steps, places, step)
        gone = np.cumsum(steps[:-1]) > 0
        rows = []
        for i, (low_end, high_end) in enumerate(zip(part.starts.tolist(), part.ends.tolist(), strict=True)):
            mask = gone[low_end:high_end]
            edges = np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))
            rows.append((None if part.none[i] else int(part.ids[i]), high_end - low_end, np.flatnonzero(edges == 1), np.flatnonzero(edges == -1), part.data[low_end:high_end][~mask].tobytes()))
        columns = list(zip(*rows, strict=True))
        types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "n_bytes", "starts", "ends", "kept"])

    def answered(asked: DataFrame, name: str) -> DataFrame:
        return stored(asked.groupBy("kind", "bucket").applyInArrow(_answered, ANSWER), name)

    known = answered(parts.repartition(max(1, parts.count()), "part_id").mapInArrow(ask_triggers, ASKED), "triggers")
    for asking, name in ((ask_surroundings, "surroundings"), (ask_strings, "strings")):
        known = known.unionByName(answered(known.groupBy("part_id").applyInArrow(asking, ASKED), name))
    return known.groupBy("part_id").applyInArrow(remove, "doc_id LONG, n_bytes LONG, starts ARRAY<LONG>, ends ARRAY<LONG>, kept BINARY")


def removal_digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""
    return remove_repeats(docs).select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
