"""Repeated 50-byte strings across documents, by difference-cover suffix sorting.

A suffix array over all bytes of a corpus would be many times its size, so only
what can repeat is sorted.  Each 50-byte window has an anchor, the smallest hash
of a 20-byte string inside it; equal windows have equal anchors.  Anchors that
occur in one document only cannot repeat.  The stretches of text around the others
go to a task by anchor (each content once a slice; its other documents are settled
where they are read), and there all their suffixes are sorted by a difference
cover of period 3: triples at two of three positions get names, names of names
reach 48 bytes, the remaining suffixes are merged in by the names of their
neighbours, and adjacent 50-byte prefixes are compared.  An anchor of very many
stretches, such as a phrase that stands in a third of all documents, would fill a
task: its windows go by their own hash, one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitforge.llm.scratch import cut, discard
from fitforge.llm.textkernel import Texts, mix, span_hashes, texts_of, window_hashes

LENGTH = 50
GRAM = 20

#: Stretches of one anchor that a task sorts; the windows of an anchor with more are dealt one by one.
MOST_STRETCHES = 20_000
#: Windows of such anchors that a task makes at once.
WINDOWS_AT_ONCE = 200_000
#: Bytes that are sorted together; an anchor with more has its windows dealt by hash into parts of that many.
SORTED_BYTES = 2_000_000


def _anchors(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of windows with one anchor: text number, first window, windows and anchor of each."""
    data, n = texts.data, len(texts.data)
    width = LENGTH - GRAM + 1
    if n < LENGTH:
        nothing = np.zeros(0, np.int64)
        return nothing, nothing, nothing, nothing.astype(np.uint64)
    least = window_hashes(data, GRAM)
    reach = 1
    while 2 * reach <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    least = np.minimum(least[: len(least) - (width - reach)], least[width - reach :])  # of windows 0 to n - LENGTH
    inside = np.zeros(len(least) + 1, np.int32)
    first = texts.bounds[:-1]
    last = np.maximum(first, texts.bounds[1:] - LENGTH + 1)
    np.add.at(inside, first[first < last], 1)
    np.add.at(inside, last[first < last], -1)
    inside = np.cumsum(inside)[:-1] > 0
    start = inside.copy()
    start[1:] &= ~inside[:-1] | (least[1:] != least[:-1])
    edges = first[first < last]
    start[edges] = True
    starts = np.flatnonzero(start)
    stops = np.concatenate((starts[1:], [len(least)])) if len(starts) else starts
    text = np.searchsorted(texts.bounds, starts, "right") - 1
    return text, starts, np.minimum(stops, last[text]) - starts, least[starts]


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, doc, known, n): anchors of documents and how many stretches have them; known to be shared where two of a batch have them.

    Of a shared one, a single row without document stands for all of them elsewhere."""
    for batch in batches:
        docs = batch.column(0).to_numpy()
        for texts in texts_of(batch.column(1)):
            text, _, _, key = _anchors(texts)
            doc = docs[texts.first + text]
            order = np.lexsort((doc, key))
            key, doc = key[order], doc[order]
            new_key = np.ones(len(key), bool)
            new_key[1:] = key[1:] != key[:-1]
            new = new_key.copy()
            new[1:] |= doc[1:] != doc[:-1]
            stretches = np.diff(np.append(np.flatnonzero(new), len(key)))
            key, doc, new_key = key[new].view(np.int64), doc[new], new_key[new]
            group = np.cumsum(new_key) - 1
            shared = np.bincount(group, minlength=0)[group] > 1 if len(group) else np.zeros(0, bool)
            stand_in = shared & new_key
            alike = np.bincount(group, stretches).astype(np.int64)[group[stand_in]] if len(group) else stretches
            keys = np.concatenate((key, key[stand_in]))
            ids = pa.array(np.concatenate((doc, doc[stand_in])), mask=np.concatenate((np.zeros(len(doc), bool), np.ones(int(stand_in.sum()), bool))))
            known = np.concatenate((shared, np.zeros(int(stand_in.sum()), bool)))
            yield pa.RecordBatch.from_arrays([pa.array(keys), ids, pa.array(known), pa.array(np.concatenate((stretches, alike)), pa.int64())], names=["key", "doc", "known", "n"])


def _shared_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by key: (doc, key) of anchors with several rows, and of known ones.

    A row without document follows for an anchor of more than MOST_STRETCHES."""
    last_key, waiting, n_last = None, None, 0  # the last key so far, its only row while it has no other, and its stretches

    def hot(keys: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.nulls(len(keys), pa.int64()), pa.array(keys, pa.int64())], names=["doc", "key"])

    for batch in batches:
        known = batch.column(2).to_numpy(zero_copy_only=False)
        done = batch.filter(pa.array(known))
        if len(done):
            yield done.select(["doc", "key"])
        rest = batch.filter(pa.array(~known))
        if not len(rest):
            continue
        key = rest.column(0).to_numpy()
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        total = np.add.reduceat(rest.column(3).to_numpy(), first)
        if last_key is not None and key[0] == last_key:
            total[0] += n_last
        elif n_last > MOST_STRETCHES:
            yield hot(np.array([last_key]))
        yield hot(key[first[:-1]][total[:-1] > MOST_STRETCHES])
        n_last = int(total[-1])
        more = np.zeros(len(key), bool)
        more[1:] = key[1:] == key[:-1]
        more[:-1] |= key[1:] == key[:-1]
        if last_key is not None and key[0] == last_key:
            more[0] = True
            if waiting is not None:
                yield waiting.select(["doc", "key"]).filter(waiting.column(1).is_valid())
        found = rest.filter(pa.array(more))
        found = found.filter(found.column(1).is_valid())
        if len(found):
            yield found.select(["doc", "key"])
        waiting = None if more[-1] else rest.slice(len(rest) - 1)
        last_key = key[-1]
    if n_last > MOST_STRETCHES:
        yield hot(np.array([last_key]))


_STRETCH = ("key", "doc", "start", "stop", "bytes")


def _once(key: np.ndarray, doc: np.ndarray, start: np.ndarray, pieces: list[bytes]) -> tuple[pa.RecordBatch, np.ndarray]:
    """Rows of stretches, of which each content goes on with its smallest document only, and which are the others."""
    column = pa.array(pieces, pa.binary())
    encoded = column.dictionary_encode()
    content = encoded.indices.to_numpy()
    smallest = np.full(len(encoded.dictionary), np.iinfo(np.int64).max)
    np.minimum.at(smallest, content, doc)
    settled = doc != smallest[content]
    going = np.flatnonzero(~settled)
    return pa.RecordBatch.from_arrays([pa.array(key[going]), pa.array(doc[going]), pa.array(start[going]), pa.nulls(len(going), pa.int64()), column.take(pa.array(going))], names=_STRETCH), settled


def _settled_rows(docs: np.ndarray, text: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.RecordBatch:
    """Rows without key and bytes for stretches that a smaller document of the slice has; those that touch are one."""
    order = np.lexsort((start, text))
    text, start, stop = text[order], start[order], stop[order]
    # within a text later stretches end later
    new = np.append(True, (text[1:] != text[:-1]) | (start[1:] > stop[:-1])) if len(text) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(text)) - 1 if len(text) else first
    n = len(first)
    return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.array(docs[text[first]]), pa.array(start[first]), pa.array(stop[last]), pa.nulls(n, pa.binary())], names=_STRETCH)


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (doc, text, keys, hot): rows of the stretches with these anchors; single windows where an anchor is hot."""

    def pairs_of(column: pa.ListArray, names: np.ndarray) -> np.ndarray:
        """Pairs (text, key) as one number each, by the place of the key among ``names``."""
        wanted = column.values.to_numpy()[column.offsets[0].as_py() : column.offsets[-1].as_py()]
        return np.repeat(np.arange(len(column)), column.value_lengths().to_numpy()) * (len(names) + 1) + np.searchsorted(names, wanted)

    for batch in batches:
        docs = batch.column(0).to_numpy()
        for texts in texts_of(batch.column(1)):
            text, start, windows, key = _anchors(texts)
            key = key.view(np.int64)
            wanted, hot = (batch.column(i).slice(texts.first, len(texts)) for i in (2, 3))
            names = np.unique(wanted.values.to_numpy()[wanted.offsets[0].as_py() : wanted.offsets[-1].as_py()])
            if not len(names):
                continue
            place = np.minimum(np.searchsorted(names, key), len(names) - 1)
            pair = text * (len(names) + 1) + place
            hit = (names[place] == key) & np.isin(pair, pairs_of(wanted, names))
            single = hit & np.isin(pair, pairs_of(hot, names))
            pick = np.flatnonzero(hit & ~single)
            doc, within = docs[texts.first + text], texts.bounds[text]
            settled: list[tuple[np.ndarray, ...]] = []
            raw = texts.data.tobytes()
            if len(pick):
                length = windows[pick] + LENGTH - 1
                pieces = [raw[a : a + n] for a, n in zip(start[pick].tolist(), length.tolist(), strict=True)]
                going, other = _once(key[pick], doc[pick], start[pick] - within[pick], pieces)
                yield going
                settled.append((pick[other], start[pick][other], length[other]))
            pick = np.flatnonzero(single)
            n = windows[pick]
            at = np.repeat(start[pick] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            whose = np.repeat(pick, n)
            for a in range(0, len(at), WINDOWS_AT_ONCE):
                p, w = at[a : a + WINDOWS_AT_ONCE], whose[a : a + WINDOWS_AT_ONCE]
                own = mix(span_hashes(texts.data, p, p + LENGTH)).view(np.int64)
                going, other = _once(own, doc[w], p - within[w], [raw[x : x + LENGTH] for x in p.tolist()])
                yield going
                settled.append((w[other], p[other], np.full(int(other.sum()), LENGTH)))
            if settled:
                w, p, length = (np.concatenate(x) for x in zip(*settled, strict=True))
                yield _settled_rows(docs[texts.first :], text[w], p - within[w], p - within[w] + length)


def _names(key: np.ndarray) -> np.ndarray:
    """Ranks of equal values: sorted, then named."""
    order = np.argsort(key)
    ranked = key[order]
    new = np.zeros(len(key), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    out = np.empty(len(key), np.uint64)
    out[order] = np.cumsum(new)
    return out


def _names_of_triples(data: np.ndarray) -> np.ndarray | None:
    """Names of three bytes at all places, without sorting, where at most 128 different bytes occur: 7 bits of each."""
    present = np.bincount(data, minlength=256) > 0
    if present.sum() > 128:
        return None
    code = (np.cumsum(present) - 1).astype(np.uint64)[data]
    name = np.zeros(len(data), np.uint64)
    name[:-2] = code[:-2] << np.uint64(14) | code[1:-1] << np.uint64(7) | code[2:]
    return name


def smallest_holder(data: np.ndarray, starts: np.ndarray, holder: np.ndarray) -> np.ndarray:
    """For each suffix at ``starts``, the smallest holder of a suffix with the same LENGTH bytes.

    ``data`` may hold anything behind the last suffix's LENGTH bytes.
    """
    n = len(data)
    padded = np.concatenate((data, np.zeros(3 * LENGTH, np.uint8)))
    t = padded.astype(np.uint64)
    sampled = np.flatnonzero(np.arange(n + 2 * LENGTH) % 3)
    # three names of 21 bits fit in one number; names of more suffixes are paired one after the other
    narrow, shift = len(sampled) < 1 << 21, np.uint64(21 if len(sampled) < 1 << 21 else 32)

    def spread(names: np.ndarray) -> np.ndarray:
        out = np.zeros(n + 3 * LENGTH, np.uint64)
        out[sampled] = names
        return out

    # names of sampled triples, of triples of names (9 and 27 bytes), and of 48 bytes
    name = _names_of_triples(padded)
    if name is None:
        name = spread(_names(t[sampled] << np.uint64(16) | t[sampled + 1] << np.uint64(8) | t[sampled + 2]))
    for step in (3, 9):
        two = name[sampled] << shift | name[np.minimum(sampled + step, n + 2 * LENGTH)]
        name = spread(_names((two if narrow else _names(two)) << shift | name[np.minimum(sampled + 2 * step, n + 2 * LENGTH)]))
    name = spread(_names(name[sampled] << shift | name[np.minimum(sampled + 21, n + 2 * LENGTH)]))

    byte, wide, whole = np.uint64(8), np.uint64(16), np.uint64(40)
    out = holder.copy()
    residue = starts % 3
    # two classes of positions meet where a neighbour of both is sampled
    for pair, key_of in (
        ((0, 1), lambda p: (t[p] << whole | name[p + 1]) << byte | t[p + LENGTH - 1]),
        ((0, 2), lambda p: (t[p] << byte | t[p + 1]) << whole | name[p + 2]),
        ((1, 2), lambda p: name[p] << wide | t[p + LENGTH - 2] << byte | t[p + LENGTH - 1]),
    ):
        rows = np.flatnonzero((residue == pair[0]) | (residue == pair[1]))
        if not len(rows):
            continue
        key = key_of(starts[rows])
        order = np.argsort(key)
        key, rows = key[order], rows[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]  # adjacent prefixes that differ
        least = np.minimum.reduceat(holder[rows], np.flatnonzero(new))
        out[rows] = np.minimum(out[rows], least[np.cumsum(new) - 1])
    return out


def _smallest_in_parts(data: np.ndarray, starts: np.ndarray, holder: np.ndarray) -> np.ndarray:
    """As :func:`smallest_holder`, for any number of suffixes: equal windows meet in a part by their hash."""
    parts = -(-len(starts) // SORTED_BYTES)
    part = span_hashes(data, starts, starts + LENGTH) % np.uint64(parts)
    out = holder.copy()
    for k in range(parts):
        rows = np.flatnonzero(part == k)
        windows = np.lib.stride_tricks.sliding_window_view(data, LENGTH)[starts[rows]]
        same = np.unique(np.ascontiguousarray(windows).view(f"V{LENGTH}").ravel(), return_inverse=True)[1]
        least = np.full(len(rows), np.iinfo(np.int64).max)
        np.minimum.at(least, same, holder[rows])
        out[rows] = least[same]
    return out


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From stretches sorted by key, bytes and doc: rows (doc, start, stop) of windows that a smaller doc_id holds too.

    Of equal stretches the smallest doc_id's are held until their key is settled; the others go at once."""
    held: list[pa.RecordBatch] = []
    size, last = 0, None
    run: tuple | None = None  # key, bytes and smallest doc of the last stretch

    def settle(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(parts).combine_chunks()
        if not len(table):
            return
        doc, first = table.column("doc").to_numpy(), table.column("start").to_numpy()
        # of equal stretches only that of the smallest doc_id is sorted; the others go whole
        equal = table.column("bytes").combine_chunks().dictionary_encode()
        piece = equal.indices.to_numpy()
        smallest = np.full(len(equal.dictionary), np.iinfo(np.int64).max)
        np.minimum.at(smallest, piece, doc)
        texts = next(texts_of(equal.dictionary, 1 << 62))
        windows = np.diff(texts.bounds) - LENGTH + 1
        of = np.repeat(np.arange(len(windows)), windows)
        ends = np.cumsum(windows)
        offset = np.arange(ends[-1]) - np.repeat(ends - windows, windows)
        least = smallest_holder if len(of) <= SORTED_BYTES else _smallest_in_parts
        gone = least(texts.data, texts.bounds[of] + offset, smallest[of]) < smallest[of]
        edge = gone.copy()
        edge[1:] = gone[1:] & (~gone[:-1] | (of[1:] != of[:-1]))
        begin = np.flatnonzero(edge)
        edge = gone.copy()
        edge[:-1] = gone[:-1] & (~gone[1:] | (of[1:] != of[:-1]))
        stop = np.flatnonzero(edge)
        runs = np.bincount(of[begin], minlength=len(windows))
        owner = np.flatnonzero(doc == smallest[piece])
        copy = np.flatnonzero(doc != smallest[piece])
        # the runs of its stretch for each row of a smallest doc_id
        counts = runs[piece[owner]]
        row = np.repeat(owner, counts)
        run = np.repeat((np.cumsum(runs) - runs)[piece[owner]] - (np.cumsum(counts) - counts), counts) + np.arange(len(row))
        rows = np.concatenate((row, copy))
        start = first[rows] + np.concatenate((offset[begin][run], np.zeros(len(copy), np.int64)))
        end = first[rows] + np.concatenate((offset[stop][run] + 1, windows[piece[copy]])) + LENGTH - 1
        yield pa.RecordBatch.from_arrays([pa.array(doc[rows]), pa.array(start), pa.array(end)], names=["doc", "start", "stop"])

    for batch in batches:
        if "stop" in batch.schema.names:
            settled = batch.column("key").is_null()
            yield batch.select(["doc", "start", "stop"]).filter(settled)
            batch = batch.filter(pc.invert(settled))
        if not len(batch):
            continue
        for a in range(0, len(batch), 2_000):
            part = batch.slice(a, 2_000)
            key, doc, pieces = part.column("key").to_numpy(), part.column("doc").to_numpy(), part.column("bytes")
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | ~pc.equal(pieces.slice(1), pieces.slice(0, len(key) - 1)).to_numpy(zero_copy_only=False)
            new[0] = run is None or run[0] != key[0] or run[1] != pieces[0].as_py()
            first = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
            smallest = np.where(first < 0, run[2] if run else 0, doc[first])
            run = (key[-1], pieces[len(key) - 1].as_py(), smallest[-1])
            copy = doc != smallest
            if copy.any():
                copies = part.filter(pa.array(copy))
                start = copies.column("start").to_numpy()
                yield pa.RecordBatch.from_arrays([copies.column("doc"), pa.array(start), pa.array(start + pc.binary_length(copies.column("bytes")).to_numpy())], names=["doc", "start", "stop"])
                part = part.filter(pa.array(~copy))
                if not len(part):
                    continue
            key = part.column("key").to_numpy()
            if size > SORTED_BYTES // 2:  # settle at the first change of key
                change = 0 if key[0] != last else int(np.searchsorted(key, last, "right"))
                if change < len(key):
                    yield from settle([*held, part.slice(0, change)])
                    held, size, part = [], 0, part.slice(change)
            held.append(part)
            size += part.nbytes
            last = key[-1]
    if held:
        yield from settle(held)


def _span_code(start: Column, stop: Column) -> Column:
    """A span of a text as one number: its start, and its length in the lower 31 bits."""
    return F.shiftleft(start, 31).bitwiseOR(stop - start)


def _runs(spans: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From lists of span codes: start and stop of the maximal runs, and how many each list has."""
    lengths = spans.value_lengths().fill_null(0).to_numpy()
    row = np.repeat(np.arange(len(spans)) << 32, lengths)
    code = spans.flatten().to_numpy()
    start, length = row + (code >> 31), code & ((1 << 31) - 1)
    order = np.argsort(start)
    start, row = start[order], row[order]
    stop = np.maximum.accumulate(start + length[order])  # those of a row lie below the next row's starts
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > stop[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1 if len(first) else first
    return start[first] - row[first], stop[last] - row[first], np.bincount(row[first] >> 32, minlength=len(spans))


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (doc_id, text, spans): what stays of each text."""
    for batch in batches:
        out: list[list] = [[], [], [], []]
        start, stop, counts = _runs(batch.column(2))
        ends = np.cumsum(counts)
        for texts in texts_of(batch.column(1)):
            for i in range(len(texts)):
                raw = texts.bytes_of(i)
                n = int(counts[texts.first + i])
                own = slice(int(ends[texts.first + i]) - n, int(ends[texts.first + i]))
                removed = int((stop[own] - start[own]).sum()) if n else 0
                edges = [0, *np.column_stack((start[own], stop[own])).ravel().tolist(), len(raw)] if n else []
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)) if n else raw
                for column, value in zip(out, (len(raw), removed, n, sha256(kept).hexdigest()), strict=True):
                    column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """``doc``, ``start`` and ``stop`` of stretches of bytes that a smaller doc_id holds too.

    Stretches of one document may touch or overlap.
    """
    source = docs.select(F.col("doc_id").alias("doc"), "text").where("doc is not null")
    rows = source.mapInArrow(_anchor_rows, "key long, doc long, known boolean, n long")
    dealt = rows.repartition(F.when(F.col("known"), F.xxhash64("doc")).otherwise(F.col("key"))).sortWithinPartitions("key")
    shared = cut(dealt.mapInArrow(_shared_anchors, "doc long, key long"), "shared")
    hot = cut(shared.where("doc is null").select("key").distinct(), "hot")
    found = shared.where("doc is not null")
    found = found.join(hot.withColumn("hot", F.col("key")), "key", "left") if hot.limit(1).count() else found
    of_doc = F.collect_list("hot") if "hot" in found.columns else F.array().cast("array<bigint>")
    wanted = cut(found.groupBy("doc").agg(F.collect_list("key").alias("keys"), of_doc.alias("hot")), "anchors")
    discard(shared, hot)
    stretches = source.join(wanted, "doc").select("doc", "text", "keys", "hot").mapInArrow(_stretches, "key long, doc long, start long, stop long, bytes binary")
    dealt = stretches.repartition(F.coalesce("key", F.xxhash64("doc", "start"))).sortWithinPartitions("key", "bytes", "doc")
    spans = cut(dealt.mapInArrow(_repeated, "doc long, start long, stop long"), "spans")
    discard(wanted)
    return spans


def without_repeats(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Each byte covered by a 50-byte string that also starts in a document with a
    smaller doc_id is removed; strings never cross documents and are judged on the
    input.  Null text counts as empty; texts under 50 bytes stay whole; repeated
    rows of a doc_id do not count against each other; a row with null doc_id stays
    whole and counts against none.  Very long texts are looked at whole; other columns are
    left out, whatever their names.  An empty table gives no rows.
    """
    spans = repeated_spans(docs).groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list(_span_code(F.col("start"), F.col("stop"))).alias("spans"))
    rows = docs.select("doc_id", "text").join(spans, "doc_id", "left").select("doc_id", "text", "spans")
    return rows.mapInArrow(_without, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
