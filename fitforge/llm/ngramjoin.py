"""Similarity join on word shingles by prefix filters under several token orders.

Two sets with Jaccard similarity t or more share a token among the first
n - ceil(t n) + 1 of each under ANY global order of tokens.  Candidates must do
so under three orders at once: each puts tokens known to be frequent last and
orders the others by a hash of its own.

1. One order finds the documents that can have a partner at all: of a longer
   prefix, as many tokens must occur in other documents too.  Tokens are combined
   by the tasks that read them, so a token in a third of all documents crosses
   the network once a task.
2. Documents with equal sets, told by SHA-256 over the digests of their words, become
   one representative.
3. Within the documents that share a prefix token of the first order, all are
   compared with one of them, the pivot, never all with each other.  Where a group
   still has several components after that, it is split by the prefix tokens of the
   second order, and again by those of the third; each part has a pivot of its own,
   and only then do the pairs between the components of a part follow.
4. Pairs must meet the size filter and share prefix tokens under the other orders;
   then their full sets are compared, word by word.  The text of the one that many are
   compared with is sent once for every PAIRS_PER_TASK of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitforge.llm.components import connected_components
from fitforge.llm.scratch import cut
from fitforge.llm.textkernel import LOWER, SLICE_BYTES, Texts, Words, mix, run_numbers, shingle_hashes, texts_of, value_digests, value_hashes, word_numbers, words_of

WIDTH = 5
PERCENT = 75
#: Share of a document's set, in percent, that must be found elsewhere in the long prefix of step 1.
SLACK_PERCENT = 15
#: Documents that are compared with one text where it is sent once.
PAIRS_PER_TASK = 2_000
#: Documents of a group of several components up to which their pairs follow at once; larger groups are split first.
#: (At 100 the split itself was the larger work: 53 million rows over 0.5 GB.)
PAIRED_DOCS = 5_000
#: Tokens whose frequency the orders know: the most frequent ones.  Any list gives
#: the same result; a good one keeps groups small.
FREQUENT_TOKENS = 100_000

_ORDERS = (0x51ED2701, 0xA3C59AC3, 0x1B873593)  # seeds
_MANY = -1  # in place of a document: several documents of a task


def _words(texts: Texts) -> tuple[Words, np.ndarray, pa.Array]:
    """The words of each text, A-Z in lower case, their numbers and the distinct ones."""
    words = words_of(texts)
    return words, *word_numbers(LOWER[texts.data], words)


def shingle_sets(texts: Texts, width: int = WIDTH) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, A-Z in lower case."""
    words, number, values = _words(texts)
    shingles, counts = shingle_hashes(value_hashes(values)[number], words.per_text, width)
    at = 0
    for n in counts.tolist():
        yield np.unique(shingles[at : at + n])
        at += n


def shingle_digests(texts: Texts, width: int = WIDTH) -> Iterator[tuple[np.ndarray, bytes]]:
    """Of each text the sorted distinct shingle hashes, and SHA-256 over the words of these shingles."""
    words, number, values = _words(texts)
    shingles, counts = shingle_hashes(value_hashes(values)[number], words.per_text, width)
    digests = np.concatenate((value_digests(values), np.zeros((1, 2), np.uint64)))
    number = np.append(number, np.full(width, len(values)))
    at = 0
    for n, first, n_words in zip(counts.tolist(), words.bounds[:-1].tolist(), words.per_text.tolist(), strict=True):
        found, place = np.unique(shingles[at : at + n], return_index=True)
        run = (first + place)[:, None] + np.arange(width)
        run[run >= first + n_words] = len(number) - 1  # a text of fewer words
        yield found, sha256(digests[number[run]].tobytes()).digest()
        at += n


def _at_least(n, percent: int):
    return -(-percent * n // 100)


def _long_prefix(n: int, percent: int) -> int:
    return n - _at_least(n, percent) + max(1, _at_least(n, SLACK_PERCENT)) if n else 0


def _token_rows(width: int, percent: int):
    """Rows (key, doc, n): tokens of long prefixes, and one row a document without key and with the set's size.

    Tokens that several documents of a batch have become one row; these documents'
    share of found tokens is in their own rows (credit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.column(0).to_numpy()
            tokens, sizes, lengths, at = [], np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64), 0
            for texts in texts_of(batch.column(1)):
                for found in shingle_sets(texts, width):
                    # hashes are sorted: the order by their value is the first global order
                    prefix = found[: _long_prefix(len(found), percent)]
                    tokens.append(prefix)
                    sizes[at], lengths[at] = len(found), len(prefix)
                    at += 1
            token = np.concatenate(tokens) if tokens else np.zeros(0, np.uint64)
            row = np.repeat(np.arange(len(docs)), lengths)
            order = np.argsort(token, kind="stable")
            token, row = token[order], row[order]
            first = np.ones(len(token), bool)
            first[1:] = token[1:] != token[:-1]
            group = np.cumsum(first) - 1
            start = np.flatnonzero(first)
            count = np.diff(np.append(start, len(token)))
            several = count > 1
            credit = np.bincount(row[several[group]], minlength=len(docs)) if len(token) else np.zeros(len(docs), np.int64)
            holder = np.where(several, _MANY, docs[row[start]] if len(start) else start)
            for a in range(0, len(start), 200_000):
                part = slice(a, a + 200_000)
                n = len(start[part])
                yield _batch(token[start[part]].view(np.int64), holder[part], count[part], np.zeros(n, np.int64))
            yield _batch(None, docs, credit, sizes)

    return run


def _batch(key, doc, count, n) -> pa.RecordBatch:
    key = pa.nulls(len(doc), pa.int64()) if key is None else pa.array(key, pa.int64())
    return pa.RecordBatch.from_arrays([key, pa.array(doc, pa.int64()), pa.array(count, pa.int64()), pa.array(n, pa.int64())], names=["key", "doc", "count", "n"])


def _found_elsewhere(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by key: per shared token a credit for its document.

    The last key of a batch may go on in the next one and is held back."""
    held: list[np.ndarray] = [np.zeros(0, np.int64)] * 3

    def settle(key, doc, count):
        if not len(key):
            return
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        start = np.flatnonzero(first)
        rows = np.diff(np.append(start, len(key)))
        total = np.add.reduceat(count, start)
        group = np.cumsum(first) - 1
        credited = doc[(total[group] > 1) & (rows[group] > 1) & (doc != _MANY)]
        if len(credited):
            yield _credits(credited, np.ones(len(credited), np.int64), np.zeros(len(credited), np.int64))

    for batch in batches:
        bare = batch.column(0).is_null().to_numpy(zero_copy_only=False)
        columns = [batch.column(i).fill_null(0).to_numpy() for i in range(4)]
        if bare.any():
            yield _credits(columns[1][bare], columns[2][bare], columns[3][bare])
        key, doc, count = (np.concatenate((h, c[~bare])) for h, c in zip(held, columns[:3], strict=True))
        if not len(key):
            continue
        end = int(np.searchsorted(key, key[-1], "left"))
        if len(key) - end > 100_000:  # one key goes on and on: its rows so far are known to be shared
            total = int(count[end:].sum())
            yield from settle(np.append(key[:end], key[-1:].repeat(len(key) - end)), doc, count)
            held = [key[-1:], np.array([_MANY]), np.array([total])]
            continue
        yield from settle(key[:end], doc[:end], count[:end])
        held = [key[end:], doc[end:], count[end:]]
    yield from settle(*held)


def _credits(doc, credit, n) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(credit), pa.array(n)], names=["doc", "credit", "n"])


def _locally_frequent(width: int):
    """Rows (token, docs): tokens in several documents of a batch, and in how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = np.concatenate([s for texts in texts_of(batch.column(0)) for s in shingle_sets(texts, width)] or [np.zeros(0, np.uint64)])
            token, count = np.unique(tokens, return_counts=True)
            token, count = token[count > 1], count[count > 1]
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(count.astype(np.int64))], names=["token", "docs"])

    return run


def _frequent_tokens(texts: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted tokens and their levels (logarithms of frequency), FREQUENT_TOKENS at most."""
    seen = texts.select("text").mapInArrow(_locally_frequent(width), "token long, docs long")
    most = seen.groupBy("token").agg(F.sum("docs").alias("docs")).orderBy(F.desc("docs"), "token").limit(FREQUENT_TOKENS).toPandas()
    token = most["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(token)
    return token[order], np.log2(np.maximum(most["docs"].to_numpy(np.int64), 1)).astype(np.int8)[order]


def _signatures(width: int, percent: int, frequent: np.ndarray, levels: np.ndarray):
    """Rows (doc, n, digest, prefix_1, prefix_2, prefix_3)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in texts_of(batch.column(1)):
                out: list[list] = [[], [], [], [], []]
                for found, digest in shingle_digests(texts, width):
                    n = len(found)
                    out[0].append(n)
                    out[1].append(digest)
                    level = np.zeros(n, np.int8)
                    if len(frequent):
                        place = np.minimum(np.searchsorted(frequent, found), len(frequent) - 1)
                        level = np.where(frequent[place] == found, levels[place], 0)
                    short, long = n - _at_least(n, percent) + 1, _long_prefix(n, percent)
                    for k, seed in enumerate(_ORDERS):
                        rank = mix(found ^ np.uint64(seed))
                        out[2 + k].append(found[np.lexsort((rank, level))[: long if k else short]].view(np.int64))
                arrays = [batch.column(0).slice(at, len(texts)), pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary())]
                arrays += [pa.array(x, pa.list_(pa.int64())) for x in out[2:]]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc", "n", "digest", "prefix_1", "prefix_2", "prefix_3"])
                at += len(texts)

    return run


def similar_pairs(texts: Texts, a: np.ndarray, b: np.ndarray, width: int, percent: int) -> np.ndarray:
    """Which of the pairs (a, b) of texts are similar enough, by their words themselves."""
    words, number, _ = _words(texts)
    shingle, counts = run_numbers(number, words.per_text, width)
    kinds = len(number) + 1
    held = np.unique(np.repeat(np.arange(len(texts)), counts) * kinds + shingle)
    n = np.bincount(held // kinds, minlength=len(texts)) if len(held) else np.zeros(len(texts), np.int64)
    first = np.cumsum(n) - n
    pair = np.repeat(np.arange(len(b)), n[b])
    place = np.repeat(first[b] - (np.cumsum(n[b]) - n[b]), n[b]) + np.arange(len(pair))
    wanted = a[pair] * kinds + held[place] % kinds
    there = held[np.minimum(np.searchsorted(held, wanted), max(0, len(held) - 1))] == wanted if len(held) else np.zeros(0, bool)
    both = np.bincount(pair[there], minlength=len(b))
    return (both > 0) & (100 * both >= percent * (n[a] + n[b] - both))


def _verify(width: int, percent: int):
    """From rows (a, part, b, text) sorted so: pairs that are similar enough.

    Of each (a, part) the row without b comes first and has a's own text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, pivot_text = None, None
        for batch in batches:
            sizes = pc.binary_length(batch.column("text")).fill_null(0).to_numpy()
            at = 0
            while at < len(batch):
                end = at + max(1, min(500, int(np.searchsorted(np.cumsum(sizes[at : at + 500]), SLICE_BYTES, "right"))))
                rows = batch.slice(at, end - at)
                at = end
                own = rows.column("b").is_null().to_numpy(zero_copy_only=False)
                column = rows.column("text").cast(pa.large_string())
                if pivot is not None:  # the text that the first rows belong to
                    column = pa.concat_arrays([pa.array([pivot_text], pa.large_string()), column])
                    own = np.append(True, own)
                whose = np.maximum.accumulate(np.where(own, np.arange(len(own)), -1))
                pairs = np.flatnonzero(~own)
                if len(pairs):
                    linked = pairs[similar_pairs(next(texts_of(column, 1 << 62)), whose[pairs], pairs, width, percent)] - (pivot is not None)
                    yield rows.select(["a", "b"]).take(pa.array(linked))
                pivot, pivot_text = True, column[int(whose[-1])].as_py()

    return run


def _reachable(percent: int):
    """Whether sets whose first common token stands at these places of the order can still be similar enough."""
    return F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b")) * (100 + percent) >= percent * (F.col("n_a") + F.col("n_b"))


def _near(percent: int):
    """Whether documents a and b are of like size and share enough of their long prefixes.

    Similar sets share as many tokens of these under each order as the shorter
    one's slack says; the first order has brought the two together already."""
    slack = F.least(*(F.greatest(F.lit(1), F.ceil(F.col(n) * SLACK_PERCENT / F.lit(100.0) - 1e-9)) for n in ("n_a", "n_b")))
    alike = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    return alike & (F.size(F.array_intersect("prefix_2_a", "prefix_2_b")) >= slack) & (F.size(F.array_intersect("prefix_3_a", "prefix_3_b")) >= slack)


def _side(rows: DataFrame, side: str, columns: tuple[str, ...], keys: tuple | list = ()) -> DataFrame:
    return rows.select(*keys, *(F.col(c).alias(side if c == "doc" else f"{c}_{side}") for c in columns))


def _verified(pairs: DataFrame, signatures: DataFrame, texts: DataFrame, width: int, percent: int, name: str) -> DataFrame:
    """Of distinct pairs (a, b) those that the other orders let pass and whose full sets are similar enough.

    The a of many pairs is dealt into parts, each of which gets a's text once."""
    columns = ("doc", "n", "prefix_2", "prefix_3")
    likely = pairs.join(_side(signatures, "a", columns), "a").join(_side(signatures, "b", columns), "b").where(_near(percent)).select("a", "b")
    parts = likely.groupBy("a").agg(F.ceil(F.count("*") / F.lit(PAIRS_PER_TASK)).alias("parts"))
    dealt = cut(likely.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), "parts").alias("part"), "b"), f"dealt_{name}")
    others = dealt.join(texts.toDF("b", "text"), "b").select("a", "part", "b", "text")
    own = dealt.select("a", "part").distinct().join(texts.toDF("a", "text"), "a").select("a", "part", F.lit(None).cast("long").alias("b"), "text")
    together = own.unionByName(others).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return cut(together.mapInArrow(_verify(width, percent), "a long, b long"), name)


def _still_mixed(groups: DataFrame, links: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The rows of those groups (by ``keys``) whose documents are not all of one component of ``links``, with their number."""
    labels = connected_components(links).select(F.col("node").alias("doc"), F.col("component").alias("_component"))
    named = groups.drop("component", "docs").join(labels, "doc", "left").withColumn("component", F.coalesce("_component", "doc")).drop("_component")
    mixed = named.groupBy(*keys).agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("docs")).where("lo != hi and docs > 2").select(*keys, "docs")
    return cut(named.join(mixed, keys), name)


def _stars(groups: DataFrame, keys: list[str], apart: bool, percent: int) -> DataFrame:
    """Pairs (a, b) of the pivot of each group and its other documents.

    The pivot is, of the longest sets, which edits tend to shorten, the smallest doc_id."""
    pivots = groups.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("n"), "doc")).alias("p"))
    pivots = groups.join(pivots.select(*keys, F.col("p.doc").alias("doc")), [*keys, "doc"])
    return _pairs(pivots, groups, keys, F.col("a") != F.col("b"), apart, percent)


def _pairs(left: DataFrame, right: DataFrame, keys: list[str], test: Column, apart: bool, percent: int) -> DataFrame:
    columns = ("doc", "n", "place", "component") if apart else ("doc", "n", "place")
    met = _side(left, "a", columns, keys).join(_side(right, "b", columns, keys), keys).where(test & _reachable(percent))
    return (met.where("component_a != component_b") if apart else met).select("a", "b").distinct()


def _split_by(groups: DataFrame, signatures: DataFrame, order: int, keys: list[str], percent: int) -> DataFrame:
    """The groups, split by the tokens of the short prefix under another order; parts of one component are left out.

    Similar sets share such a token under every order, so the parts hold all pairs."""
    short = F.slice(f"prefix_{order}", 1, F.col("n") - F.ceil(F.col("n") * percent / F.lit(100.0) - 1e-9).cast("int") + 1)
    tokens = signatures.select("doc", F.explode(short).alias(f"token_{order}")).distinct()
    wider = groups.join(tokens, "doc")
    keys = [*keys, f"token_{order}"]
    several = wider.groupBy(*keys).agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select(*keys)
    return wider.join(several, keys)


def similar_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id.

    Documents link when the Jaccard similarity of their sets of ``width``-word
    shingles is ``percent`` or more; component_id is the smallest doc_id that links
    reach.  A text with fewer words is one shingle; one without words, or null,
    has none and links with nothing.  Repeated rows of a doc_id are one document
    and are returned each.  A null doc_id takes no part: no shingles, component
    null.  An empty table gives no rows.
    """
    source = docs.select("doc_id", "text").where("doc_id is not null")
    rows = source.mapInArrow(_token_rows(width, percent), "key long, doc long, count long, n long")
    dealt = rows.repartition(F.coalesce("key", F.xxhash64("doc"))).sortWithinPartitions("key")
    found = dealt.mapInArrow(_found_elsewhere, "doc long, credit long, n long")
    per_doc = cut(found.groupBy("doc").agg(F.sum("credit").alias("credit"), F.max("n").alias("n")), "counts")
    needed = F.greatest(F.lit(1), F.ceil(F.col("n") * SLACK_PERCENT / F.lit(100.0) - 1e-9))
    candidates = per_doc.where((F.col("n") > 0) & (F.col("credit") >= needed)).select(F.col("doc").alias("doc_id"))
    texts = cut(source.join(candidates, "doc_id", "left_semi"), "candidates")
    signatures = cut(
        texts.mapInArrow(_signatures(width, percent, *_frequent_tokens(texts, width)), "doc long, n long, digest binary, prefix_1 array<long>, prefix_2 array<long>, prefix_3 array<long>"),
        "signatures",
    )
    same = cut(signatures.groupBy("digest").agg(F.min("doc").alias("rep"), F.count("*").alias("copies")), "same")
    members = signatures.select("doc", "digest").join(same.where("copies > 1"), "digest").where("doc != rep").select(F.col("doc").alias("a"), F.col("rep").alias("b")).distinct()
    postings = signatures.select("doc", "n", F.posexplode("prefix_1").alias("place", "token")).join(same.select(F.col("rep").alias("doc")), "doc", "left_semi")
    shared = postings.groupBy("token").agg(F.count("*").alias("docs")).where("docs > 1").select("token")
    groups = cut(postings.join(shared, "token"), "groups")
    stars = cut(_stars(groups, ["token"], False, percent), "stars")
    links = _verified(stars, signatures, texts, width, percent, "links_0")
    tested = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    keys, rest = ["token"], groups
    for order in (2, 3, None):
        rest = _still_mixed(rest, links, keys, f"rest_{order}")
        few = rest.where(F.col("docs") <= (PAIRED_DOCS if order else F.col("docs")))
        new, many = _pairs(few, few, keys, F.col("a") < F.col("b"), True, percent), rest.where(F.col("docs") > PAIRED_DOCS)
        split = order is not None and many.limit(1).count() > 0
        if split:
            rest = cut(_split_by(many, signatures, order, keys, percent), f"parts_{order}")
            keys = [*keys, f"token_{order}"]
            new = new.unionByName(_stars(rest, keys, True, percent))
        elif not rest.limit(1).count():
            break
        new = cut(new.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(tested, ["a", "b"], "left_anti"), f"new_{order}")
        if new.limit(1).count():
            tested = tested.unionByName(new)
            links = links.unionByName(_verified(new, signatures, texts, width, percent, f"links_{order}"))
        if not split:
            break
    classes = connected_components(links.unionByName(members))
    named_docs = per_doc.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles")).join(classes.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return docs.select("doc_id").join(named_docs, "doc_id", "left").select("doc_id", F.coalesce("n_shingles", F.lit(0)).cast("long").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its component, with all their columns.

    Null and empty texts have no shingles and all stay, as do rows without doc_id; rows that
    repeat a doc_id stay or go together.  Ties go to the smaller doc_id; very long texts
    are compared whole; an empty table gives no rows.
    """
    kept = similar_components(docs, **options).where("component_id is null or component_id = doc_id").select(F.col("doc_id").alias("_kept_id")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_kept_id"]), "left_semi")
