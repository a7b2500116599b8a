"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

The words of a source, its documents in an order given by hashes, are cut into blocks.
A source's target makes an exact quota of blocks, repeats counted.  A binary tree deals
the quotas of all sources to the output shards: each node hands a random half of its
blocks to its left child, and so from every source a hypergeometric number, jointly
multivariate hypergeometric.  A shard then takes from every source as many blocks as
fell to it, the next ones of the source's permuted blocks, and shuffles them by itself.

No table of all sources meets in one place for that.  The blocks of a node are thought
of as lying in order of sources, so a source is the stretch between two bounds.  How
many of the first c blocks go left is found by halving the node's stretch again and
again, where a hash of the place seeds a univariate hypergeometric number each time.
Every source finds what it needs from its own two bounds, and all agree.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fitforge.llm.scratch import cut

#: Weights of the sources in order of code points, again from the start where there are more.
WEIGHTS = (3, 1, 2)
#: Words of the mix for each word of the documents, and the most times that a document is taken.
SHARE = 1.5
MOST_TAKEN = 2
#: Output shards, a power of two.
SHARDS = 32
SEED = 12
#: Words in a block, at least; larger ones where there would be more than MOST_BLOCKS of them.
BLOCK_WORDS = 2048
MOST_BLOCKS = 1 << 20

# Primes, larger than any number of blocks and so prime to it.
_PRIMES = (15485863, 32452843, 49979687, 67867967, 86028121)
_BLANK, _WORD = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
_TAILS = 9  # standard deviations; what lies beyond has a probability below 1e-18


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` worked out once."""
    return F.transform(F.array(value), then)[0]


def _log_factorial(n: Column) -> Column:
    x = F.greatest(n, F.lit(1)).cast("double")
    series = (x + 0.5) * F.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return F.when(n <= 20, F.log(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def _log_choose(n: Column, k: Column) -> Column:
    return _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k)


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of ``drawn`` out of ``total``, ``marked`` of them marked, are marked; by inversion of ``u`` in [0, 1)."""
    share = marked.cast("double") / total
    mean = share * drawn
    spread = _TAILS * (F.sqrt(mean * (1 - share) * (total - drawn) / F.greatest(total - 1, F.lit(1))) + 1)
    low = F.greatest(F.lit(0).cast("long"), drawn + marked - total, F.floor(mean - spread))
    high = F.least(marked, drawn, F.ceil(mean + spread))

    def probability(k: Column) -> Column:
        return F.exp(_log_choose(marked, k) + _log_choose(total - marked, drawn - k) - _log_choose(total, drawn))

    def step(a: Column, k: Column) -> Column:
        ratio = (marked - k).cast("double") * (drawn - k) / ((k + 1).cast("double") * (total - marked - drawn + k + 1))
        further = F.struct((k + 1).alias("k"), (a["p"] * ratio).alias("p"), (a["u"] - a["p"]).alias("u"))
        return F.when(a["u"] < a["p"], a).otherwise(further)

    def inverted(low: Column) -> Column:
        start = F.struct(low.alias("k"), probability(low).alias("p"), u.alias("u"))
        return F.when(low >= high, low).otherwise(F.aggregate(F.sequence(low, high - 1), start, step, lambda a: a["k"]))

    return _let(low, inverted)


def _uniform(*of) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*of), 11).cast("double") / float(1 << 53)


def _left_of(bound: Column, total: Column, left: Column, halvings: int, *place) -> Column:
    """How many of the first ``bound`` of a node's ``total`` blocks are among the ``left`` random ones that go left."""
    start = F.struct(F.lit(0).cast("long").alias("lo"), total.alias("hi"), left.alias("n"), F.lit(0).cast("long").alias("before"))

    def step(a: Column, _: Column) -> Column:
        lo, hi, n, before = a["lo"], a["hi"], a["n"], a["before"]
        mid = F.shiftright(lo + hi, 1)
        first = hypergeometric(hi - lo, n, mid - lo, _uniform(*place, lo, hi))

        def halved(x: Column) -> Column:
            upper = F.struct(mid.alias("lo"), hi.alias("hi"), (n - x).alias("n"), (before + x).alias("before"))
            lower = F.struct(lo.alias("lo"), mid.alias("hi"), x.alias("n"), before.alias("before"))
            return F.when(bound >= mid, upper).otherwise(lower)

        settled = (bound <= lo) | (bound >= hi) | (n == 0) | (n == hi - lo)
        return F.when(settled, a).otherwise(_let(first, halved))

    def counted(a: Column) -> Column:
        inside = F.when(a["n"] == 0, 0).otherwise(bound - a["lo"])
        return a["before"] + F.when(bound <= a["lo"], 0).when(bound >= a["hi"], a["n"]).otherwise(inside)

    return F.aggregate(F.sequence(F.lit(1), F.lit(halvings)), start, step, counted)


def split_bounds(low: Column, high: Column, blocks: int, shards: int = SHARDS, seed: int | Column = SEED) -> Column:
    """For each shard, how many of the first ``low`` of all blocks the tree deals to it; then the same for ``high``."""
    levels = [[blocks]]
    while len(levels[-1]) < shards:
        levels.append([half for n in levels[-1] for half in (n // 2, n - n // 2)])
    all_of = F.array(*(F.array(*map(_long, nodes)) for nodes in levels))

    def split(bounds: Column, level: Column) -> Column:
        nodes = all_of[level]

        def halves(bound: Column, i: Column) -> Column:
            # the first half of the array is of low, the second one of high
            node = F.pmod(i, F.size(nodes))
            left = _left_of(bound, nodes[node], F.shiftright(nodes[node], 1), max(1, blocks.bit_length()), F.lit(seed), level, node)
            return _let(left, lambda x: F.array(x, bound - x))

        return F.flatten(F.transform(bounds, halves))

    both = F.array(low, high)
    return F.aggregate(F.array(*map(F.lit, range(len(levels) - 1))), both, split) if len(levels) > 1 else both


def _long(n: int) -> Column:
    return F.lit(n).cast("long")


def _running(rows: DataFrame, order: list, value: Column, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over all rows before, which are ordered by ``range`` and ``order`` in it."""
    within = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    # one row per range: as many as the range exchange has partitions
    totals = rows.groupBy("range").agg(F.sum(value).alias("_sum"))
    starts = totals.select("range", F.coalesce(F.sum("_sum").over(before), _long(0)).alias("_start"))
    summed = rows.withColumn(name, F.coalesce(F.sum(value).over(within), _long(0)))
    return summed.join(F.broadcast(starts), "range").withColumn(name, F.col(name) + F.col("_start")).drop("_start")


def water_level(sources: DataFrame, share: float = SHARE, most: int = MOST_TAKEN) -> float:
    """Words for each unit of weight, when sources that would exceed ``most`` times their size stop there.

    Each round shares what is left among the sources that have not stopped; the level
    only rises, and ends when no further source stops.
    """
    full = F.col("source_size") * most
    level, stopped = 0.0, -1
    while True:
        over = F.col("weight") * F.lit(level) > full
        found = sources.agg(
            F.sum("source_size"), F.sum(F.when(over, full).otherwise(0)), F.sum(F.when(over, 0).otherwise(F.col("weight"))), F.count_if(over)
        ).first()
        words, fixed, weight, now = found
        if not weight or now == stopped:
            return level
        level, stopped = (share * words - fixed) / weight, now


def _planned(rows: DataFrame, weights: Sequence[int], share: float, shards: int, block_words: int, seed: int) -> tuple[DataFrame, int]:
    """Per source its target, quota and blocks in each shard; and the words in a block."""
    order = [F.col("source").isNull(), "source"]
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.min("range").alias("range"))
    numbered = _running(_running(cut(sizes, "sizes"), order, _long(1), "number"), order, F.col("source_size"), "source_start")
    weighed = cut(numbered.withColumn("weight", F.array(*map(F.lit, weights))[F.pmod("number", F.lit(len(weights))).cast("int")]), "weighed")
    level = water_level(weighed, share)
    block = max(block_words, -(-(weighed.agg(F.sum("source_size")).first()[0] or 0) // MOST_BLOCKS))
    target = F.least(F.col("weight") * F.lit(level), (F.col("source_size") * MOST_TAKEN).cast("double"))
    place_of_last = F.expr("(multiplier * (n_blocks - 1) + shifts[int(copies)]) % n_blocks")
    quotas = (
        weighed.withColumn("target", target)
        .withColumn("n_blocks", F.expr(f"(source_size + {block - 1}) div {block}"))
        .withColumn("multiplier", F.array(*map(_long, _PRIMES))[F.pmod(F.xxhash64(F.lit(seed), "source"), F.lit(len(_PRIMES))).cast("int")])
        .withColumn("shifts", F.array(*(F.pmod(F.xxhash64(F.lit(seed), F.lit(c), "source"), F.greatest("n_blocks", F.lit(1))) for c in range(MOST_TAKEN + 1))))
        .withColumn("wanted", F.round("target").cast("long"))
        .withColumn("copies", F.when(F.col("source_size") > 0, F.expr("wanted div source_size")).otherwise(_long(0)))
        # beyond whole copies: so many words, and so many blocks to hold them
        .withColumn("rest", F.expr("wanted - copies * source_size"))
        .withColumn("missing", F.expr(f"n_blocks * {block} - source_size"))
        .withColumn("last_at", F.when(F.col("rest") > 0, place_of_last).otherwise(_long(0)))
        .withColumn("rest_blocks", F.expr(f"(rest + {block - 1}) div {block}"))
        .withColumn("rest_blocks", F.expr(f"if(rest_blocks > last_at, (rest + missing + {block - 1}) div {block}, rest_blocks)"))
        .withColumn("quota", F.expr("copies * n_blocks + if(rest > 0, rest_blocks, 0)"))
        # the last block that is drawn gives no more than what is left of the target
        .withColumn("last_words", F.expr(f"if(rest > 0, rest - (rest_blocks - 1) * {block} + if(last_at < rest_blocks - 1, missing, 0), {block})"))
    )
    bounded = cut(_running(cut(quotas, "quotas"), order, F.col("quota"), "before"), "bounds")
    blocks = bounded.agg(F.sum("quota")).first()[0] or 0
    dealt = cut(bounded.withColumn("shard_bounds", split_bounds(F.col("before"), F.col("before") + F.col("quota"), blocks, shards, seed)), "dealt")
    shard_from, shard_to = F.slice("shard_bounds", 1, shards), F.slice("shard_bounds", shards + 1, shards)
    firsts = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda k: F.aggregate(F.slice("counts", F.lit(1), k), _long(0), lambda a, b: a + b))
    plan = dealt.withColumn("shard_from", shard_from).withColumn("counts", F.zip_with("shard_from", shard_to, lambda a, b: b - a)).withColumn("firsts", firsts)
    columns = ["source", "source_size", "source_start", "target", "n_blocks", "multiplier", "shifts", "quota", "last_words", "firsts", "shard_from"]
    return plan.select(*columns), block


def _pieces(shards: int, block: int) -> Column:
    """What the mix takes of a document: structs of shard, block (its place in the shard), offset in the block, first word and words."""
    words_end = F.col("start") + F.col("size")

    def draws(b: Column) -> Column:
        def drawn(c: Column) -> Column:
            place = F.pmod(F.col("multiplier") * b + F.col("shifts")[c], F.col("n_blocks"))
            return F.struct(b.alias("b"), (c.cast("long") * F.col("n_blocks") + place).alias("d"))

        return F.transform(F.sequence(F.lit(0), F.lit(MOST_TAKEN - 1)), drawn)

    def shard_of(d: Column) -> Column:
        # the last shard whose first draw is not after d
        jumps = [shards >> k for k in range(1, shards.bit_length())]
        if not jumps:
            return F.lit(0)
        return F.aggregate(F.array(*map(F.lit, jumps)), F.lit(0), lambda at, j: at + F.when(F.col("firsts")[at + j] <= d, j).otherwise(0))

    def piece(x: Column) -> Column:
        begin = F.greatest(F.col("start"), x["b"] * block)
        held = F.when(x["d"] == F.col("quota") - 1, F.col("last_words")).otherwise(_long(block))
        end = F.least(words_end, x["b"] * block + held)
        return F.struct(
            shard_of(x["d"]).alias("shard"), x["d"].alias("d"), (begin - x["b"] * block).alias("offset"), (begin - F.col("start")).alias("first_word"), (end - begin).alias("words")
        )

    def placed(x: Column) -> Column:
        at = F.col("shard_from")[x["shard"]] + x["d"] - F.col("firsts")[x["shard"]]
        return F.struct(x["shard"].alias("shard"), at.alias("block"), x["offset"].alias("offset"), x["first_word"].alias("first_word"), x["words"].alias("words"))

    touched = F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))
    found = F.filter(F.flatten(F.transform(touched, draws)), lambda x: x["d"] < F.col("quota"))
    pieces = F.transform(F.filter(F.transform(found, piece), lambda x: x["words"] > 0), placed)
    return F.when(F.col("size") > 0, pieces).otherwise(F.filter(F.transform(F.array(F.struct(_long(0).alias("b"), _long(0).alias("d"))), lambda x: placed(piece(x))), lambda x: F.lit(False)))


def _mixed(docs: DataFrame, source: str, weights: Sequence[int], share: float, shards: int, block_words: int, seed: int, keep: list[str]) -> DataFrame:
    if shards < 1 or shards & (shards - 1):
        raise ValueError("shards: a power of two")
    if not 0 < share <= MOST_TAKEN or min(weights) <= 0:
        raise ValueError(f"share: above 0 and {MOST_TAKEN} at most; weights: above 0")
    text = F.coalesce("text", F.lit(""))
    sized = docs.select(
        "doc_id", F.col(source).alias("source"), F.regexp_count(text, F.lit(f"{_WORD}+")).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"), *keep
    )
    # rows alike in everything before are told apart by their place, so that no range has to hold them all
    order = [F.col("source").isNull(), "source", "dealt", "doc_id", "size", "crc", "nth"]
    keyed = sized.withColumn("dealt", F.xxhash64(F.lit(seed), "doc_id")).withColumn("nth", F.monotonically_increasing_id())
    rows = cut(keyed.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranges")
    plan, block = _planned(rows, weights, share, shards, block_words, seed)
    placed = _running(rows, order, F.col("size"), "place").withColumnRenamed("source", "_source")
    # no hint: Spark broadcasts the plan where the written table is small enough
    joined = placed.join(plan, F.col("_source").eqNullSafe(F.col("source")))
    return joined.withColumn("start", F.col("place") - F.col("source_start")).withColumn("pieces", _pieces(shards, block))


def mixture(docs: DataFrame, source: str = "source", weights: Sequence[int] = WEIGHTS, share: float = SHARE, shards: int = SHARDS, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """Per row of ``docs``: doc_id, size, source_size, target, taken, n_pieces, first_shard.

    Size is the number of words; sources, in order of code points and null last, get the
    weights in turn.  All targets together are ``share`` times all words; none exceeds
    MOST_TAKEN times its source, the excess is shared by weight among the others.  A
    source's taken words are its target, rounded.  Documents are cut where blocks and the
    last drawn block end; each is taken whole as often as its source, or once more.

    Null and empty texts have no words and nothing is taken of them; very long ones
    spread over many blocks.  Rows of one doc_id stay rows of their own, those of a null
    doc_id too.  A source without words has target 0.  Reruns agree.  An empty table
    gives no rows.
    """
    mixed = _mixed(docs, source, weights, share, shards, block_words, seed, [])
    taken = F.aggregate("pieces", _long(0), lambda a, x: a + x["words"])
    return mixed.select("doc_id", "size", "source_size", "target", taken.alias("taken"), F.size("pieces").alias("n_pieces"), F.get("pieces", F.lit(0))["shard"].alias("first_shard"))


def mixed_shards(docs: DataFrame, source: str = "source", weights: Sequence[int] = WEIGHTS, share: float = SHARE, shards: int = SHARDS, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """The mix itself: shard, slot (gapless from 0 in each shard), doc_id, first_word, words, text.

    Blocks of a shard lie in shuffled order, the pieces of a block one after the other,
    as :func:`mixture` says.  A piece of a document has the blanks before its words, the
    last one those at the end too, so the pieces of a copy make up the text again.
    """
    mixed = _mixed(docs, source, weights, share, shards, block_words, seed, ["text"])
    pieces = mixed.select("doc_id", "text", "size", F.inline("pieces"))
    words = F.regexp_extract_all("text", F.lit(rf"{_BLANK}*{_WORD}+({_BLANK}+\z)?"), F.lit(0))
    part = F.array_join(F.slice(words, (F.col("first_word") + 1).cast("int"), F.col("words").cast("int")), "")
    text = F.when(F.col("words") == F.col("size"), F.col("text")).otherwise(part)
    shuffled = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), "shard", "block"), "block", "offset", "doc_id")
    return pieces.withColumn("slot", F.row_number().over(shuffled) - 1).select("shard", "slot", "doc_id", "first_word", "words", text.alias("text"))
