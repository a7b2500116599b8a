"""Filter audit, source mixing and target sampling against plain versions."""

import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fitforge.llm import filteraudit, mixing, targetsampling
from fitforge.llm.textkernel import texts_of

# columns that the operators use themselves
SCHEMA = "doc_id long, text string, source string, mask int, part string, digest string, start long, pieces string, score string, _k0 int, dealt int, range string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows, partitions=3):
    return spark.createDataFrame([(i, t, s, 7, "x", "d", 1, "p", "s", 1, 2, "r") for i, t, s in rows], SCHEMA).repartition(partitions)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    words = ["alpha", "Beta", "GAMMA", "é", "x1", "日本", "omega#", "a|b", "tail", "ÄÖ", "0"]
    texts = [None, "", " \n\t ", "one", "ONE two", "\x0bfive\x0csix\x1f"]
    texts += [" ".join(r.choice(words[: r.randint(2, 11)]) for _ in range(r.choice([3, 19, 20, 21, 150, 199, 200, 201, 260]))) for _ in range(70)]
    texts += [f"w{i} " * i for i in range(190, 215, 4)] + [" ".join(f"v{i}" for i in range(k)) for k in (199, 200, 400)]
    sources = ["b", "a", "B", "é", "", None, "日", "c"]
    out = [(i * 7 % 101, t, sources[i % 5 if i % 3 else r.randrange(8)]) for i, t in enumerate(texts)]
    out += [(200 + i, texts[8], "a") for i in range(40)] + [(3, texts[9], "a"), (500, texts[60] * 30, "big"), (None, texts[8], "a"), (None, None, None), (None, texts[12], "b"), (None, texts[12], "b")]
    return [*out, out[7], out[7], out[20]]  # repeated rows


@pytest.fixture(scope="module")
def labels(spark):
    known = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 120, 2)] + [(8, 1, 1), (8, 0, 0), (9999, 1, 1), (None, 1, 1), (14, None, None)]
    return spark.createDataFrame(known, "doc_id long, quality int, toxic int")


def plain_audit(rows, labels):
    good = {r["doc_id"] for r in labels if r["quality"] == 1 and r["doc_id"] is not None}
    toxic = {r["doc_id"] for r in labels if r["toxic"] == 1 and r["doc_id"] is not None}
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    parts = defaultdict(list)
    for i, t, s in rows:
        t, fails = t or "", set()
        words = WORD.findall(t)
        if len(words) < 200:
            fails.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            fails.add("B")
        if 100 * len(re.findall("[A-Z]", t)) > 2 * len(t):
            fails.add("C")
        if re.search(r"[#$%&*|]", t):
            fails.add("D")
        if i is not None and first[t] < i:
            fails.add("E")
        parts[s or ""].append((fails, i in good, i in toxic))
    for part, found in parts.items():
        steps, totals = [], Counter()
        for order in itertools.permutations("ABCDE"):
            left = found
            for k, f in enumerate(order):
                out = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                failing = sum(f in x[0] for x in found)
                steps.append((part, "".join(order), k + 1, len(left), len(out), failing - len(out), sum(x[0] == {f} for x in found), sum(x[1] for x in out), sum(x[2] for x in out)))
                totals[f] += len(out)
        yield from ((*s, totals[s[1][s[2] - 1]]) for s in steps)


def test_audit_walks_all_orders(spark, rows, labels):
    found = filteraudit.audit(frame(spark, rows), labels)
    assert found.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, found.collect())) == sorted(plain_audit(rows, labels.collect()))


def test_audit_without_rows_or_labels(spark, rows, labels):
    assert filteraudit.audit(frame(spark, []), labels).count() == 0
    one = filteraudit.audit(frame(spark, [(1, None, None)]), labels.where("false")).collect()
    assert len(one) == 600 and {r["part"] for r in one} == {""} and {r["good_lost"] for r in one} == {0}


@pytest.mark.parametrize("n", [2, 3, 5, 6])
def test_least_squares_give_shapley_values(n):
    weights = filteraudit.shapley_weights(n)
    for i, s in itertools.product(range(n), range(1 << n)):
        size = s.bit_count() - (s >> i & 1)
        share = Fraction(math.factorial(size) * math.factorial(n - 1 - size), math.factorial(n))
        assert weights[i][s] == (share if s >> i & 1 else -share)


def plain_targets(sizes):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    total, stopped = 1.5 * sum(sizes.values()), set()
    while True:
        left = total - sum(2 * sizes[s] for s in stopped)
        share = sum(weight[s] for s in order if s not in stopped)
        target = {s: 2 * sizes[s] if s in stopped else left * weight[s] / share for s in order}
        over = {s for s in order if target[s] > 2 * sizes[s]}
        if not over:
            return target
        stopped |= over


def n_words(text):
    return len(WORD.findall(text or ""))


@pytest.mark.parametrize("block_words", [1, 50, 4096])
def test_mixture_meets_its_targets(spark, rows, block_words):
    found = mixing.mixture(frame(spark, rows), block_words=block_words).collect()
    sizes, taken = Counter(), defaultdict(int)
    for _, t, s in rows:
        sizes[s] += n_words(t)
    targets = plain_targets(sizes)
    wanted = sorted(((-1 if i is None else i), n_words(t), sizes[s], round(targets[s], 6)) for i, t, s in rows)
    assert sorted(((-1 if r["doc_id"] is None else r["doc_id"]), r["size"], r["source_size"], round(r["target"], 6)) for r in found) == wanted
    by_source = defaultdict(set)
    for i, t, s in rows:
        by_source[i, n_words(t), sizes[s]].add(s)
    for r in found:
        taken[r["source_size"]] += r["taken"]
        whole = r["target"] // r["source_size"] if r["source_size"] else 0
        assert whole * r["size"] <= r["taken"] <= 2 * r["size"] and (r["n_pieces"] > 0) == (r["taken"] > 0) == (r["first_shard"] is not None)
    for size in set(sizes.values()):
        assert abs(taken[size] - sum(targets[s] for s in targets if sizes[s] == size)) <= 0.5001 * sum(x == size for x in sizes.values())


def test_mixture_does_not_depend_on_partitions(spark, rows):
    key = lambda r: tuple(-1 if x is None else x for x in r)
    first, second = (sorted(map(key, mixing.mixture(frame(spark, rows, n), block_words=40).collect())) for n in (1, 7))
    assert first == second


@pytest.mark.parametrize("shards", [1, 8])
def test_shards_hold_disjoint_blocks(spark, rows, shards):
    docs = frame(spark, rows)
    found = mixing.mixed_shards(docs, block_words=40, shards=shards).collect()
    taken = Counter()
    for r in mixing.mixture(docs, block_words=40, shards=shards).collect():
        taken[r["doc_id"]] += r["taken"]
    pieces, slots, words = Counter(), defaultdict(list), Counter()
    for r in found:
        assert n_words(r["text"]) == r["words"] > 0 and 0 <= r["shard"] < shards
        words[r["doc_id"]] += r["words"]
        slots[r["shard"]].append(r["slot"])
        pieces[r["doc_id"], r["first_word"], r["text"]] += 1
    assert +words == +taken
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    long_text = next(t for i, t, _ in rows if i == 500)
    for (i, first, text), n in pieces.items():
        if i == 500:
            found = WORD.findall(text)
            assert n <= 2 and text in long_text and found == WORD.findall(long_text)[first : first + len(found)]


def test_pieces_of_a_copy_make_up_its_text(spark, rows):
    found = mixing.mixed_shards(frame(spark, rows), block_words=40, share=2.0).collect()
    copies = defaultdict(list)
    for r in found:
        copies[r["doc_id"]].append((r["first_word"], r["text"]))
    once = Counter(i for i, _, _ in rows)
    for i, text, _ in rows:
        if once[i] == 1 and n_words(text):
            first, second = sorted(copies[i])[::2], sorted(copies[i])[1::2]
            assert first == second and "".join(t for _, t in first) == text


def test_hypergeometric_numbers(spark):
    def exact(total, marked, drawn):
        ways = [math.comb(marked, k) * math.comb(total - marked, drawn - k) if 0 <= k <= marked else 0 for k in range(drawn + 1)]
        return np.cumsum([w / math.comb(total, drawn) for w in ways])

    cases = [(10, 3, 5), (1, 1, 1), (1, 0, 1), (7, 7, 3), (40, 20, 20), (2000, 700, 1000), (5000, 3, 2500)]
    grid = [(n, m, d, (i + 0.5) / 100) for n, m, d in cases for i in range(100)]
    rows = spark.createDataFrame(grid, "total long, marked long, drawn long, u double")
    for n, m, d, u, k in rows.select("*", mixing.hypergeometric(*map(F.col, rows.columns)).alias("k")).collect():
        below = exact(n, m, d)
        assert (below[k - 1] if k else 0) <= u + 1e-9 and u <= below[k] + 1e-9


def test_the_tree_splits_like_random_subsets(spark):
    quotas = [30, 0, 1, 17, 16]
    bounds = np.cumsum([0, *quotas]).tolist()
    seeds, total = 300, sum(quotas)
    rows = spark.createDataFrame([(i, s, a, b) for i, (a, b) in enumerate(itertools.pairwise(bounds)) for s in range(seeds)], "i int, s int, low long, high long")
    left = np.zeros((len(quotas), seeds))
    for i, s, x in rows.select("i", "s", mixing.split_bounds(F.col("low"), F.col("high"), total, 2, F.col("s")).alias("b")).collect():
        left[i, s] = x[2] - x[0]
        assert x[2] >= x[0] and x[3] >= x[1]
    assert (left.sum(0) == total // 2).all()
    for i, a in enumerate(quotas):
        spread = a * (total - a) / 4 / (total - 1)  # variance of a hypergeometric number
        assert abs(left[i].mean() - a / 2) <= 5 * math.sqrt(spread / seeds) + 1e-9
        assert spread / 1.4 <= left[i].var() <= 1.4 * spread or not a
    # drawn without replacement: what one source has more, others have less
    wanted = -quotas[0] * quotas[3] / 4 / (total - 1)
    assert abs(np.cov(left[0], left[3])[0, 1] - wanted) < 0.5
    eight = spark.createDataFrame([(0, total)], "low long, high long").select(mixing.split_bounds(F.col("low"), F.col("high"), total, 8)).first()[0]
    assert eight[:8] == [0] * 8 and sum(eight[8:]) == total and max(eight[8:]) - min(eight[8:]) <= 1


def test_mixture_of_nothing(spark):
    assert mixing.mixture(frame(spark, [])).count() == 0
    assert [tuple(r) for r in mixing.mixture(frame(spark, [(1, None, "a"), (2, " ", None)])).orderBy("doc_id").collect()] == [(1, 0, 0, 0.0, 0, 0, None), (2, 0, 0, 0.0, 0, 0, None)]
    assert mixing.mixed_shards(frame(spark, [(1, None, "a")])).count() == 0
    with pytest.raises(ValueError):
        mixing.mixture(frame(spark, []), shards=3)


def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(x.encode()) % 10_000 for x in runs]


def plain_draw(rows, target, percent=5):
    raw, wanted = Counter(), Counter()
    for _, t, _ in rows:
        raw.update(features(t)[1])
    for t in target:
        wanted.update(features(t)[1])
    s_all, t_all = raw.total(), wanted.total()
    gain = {b: math.floor(1000 * math.log((wanted[b] + 1.0) * (s_all + 10_000) / ((raw[b] + 1.0) * (t_all + 10_000)))) for b in raw}
    out, enough = [], []
    for k, (i, t, _) in enumerate(rows):
        n, found = features(t)
        weight = sum(gain[b] for b in found)
        h = int(sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
        if n >= 20:
            enough.append(k)
    enough.sort(key=lambda k: (-out[k][3], math.inf if out[k][0] is None else out[k][0]))
    for rank, k in enumerate(enough[: percent * len(enough) // 100], 1):
        out[k][4] = rank
    return [tuple(x) for x in out]


def order(rows):
    return sorted(rows, key=lambda r: tuple(math.inf if x is None else x for x in r))


@pytest.mark.parametrize("percent", [5, 100])
def test_draw_equals_a_plain_one(spark, rows, percent):
    target = ["alpha Beta x1 日本", None, "", "GAMMA gamma " * 30]
    found = targetsampling.draw(frame(spark, rows), spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id int, text string"), percent=percent)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert order(map(tuple, found.collect())) == order(plain_draw(rows, target, percent))


def test_draw_without_rows_or_target(spark, rows):
    nothing = spark.createDataFrame([], "item_id int, text string")
    assert targetsampling.draw(frame(spark, []), nothing).count() == 0
    assert order(map(tuple, targetsampling.draw(frame(spark, rows), nothing).collect())) == order(plain_draw(rows, []))


@pytest.mark.parametrize("samples", [1, 40, 100_000])
def test_ranks_with_ties_and_hot_keys(spark, samples):
    r = random.Random(2)
    keys = [(r.choice([0, 0, 1, -5, r.randrange(1000)]), r.choice([None, 3, r.randrange(50)])) for _ in range(3000)]
    rows = spark.createDataFrame(keys, "a long, b long").repartition(6)
    found = targetsampling.ranked(rows, ["a", "b"], segments=16, samples=samples).collect()
    assert [tuple(x)[:2] for x in sorted(found, key=lambda x: x["rank"])] == sorted(keys, key=lambda k: (k[0], math.inf if k[1] is None else k[1]))
    assert sorted(x["rank"] for x in found) == list(range(1, 3001))


def test_crc_of_joined_strings():
    r = random.Random(4)
    pairs = [(r.randbytes(r.randint(0, 9)), r.randbytes(r.choice([0, 1, 2, 3, 31, 32, 1000]))) for _ in range(200)]
    left, right = (np.array([zlib.crc32(p[k]) for p in pairs], np.uint32) for k in (0, 1))
    found = targetsampling.joined_crc(left, right, np.array([len(b) for _, b in pairs]))
    assert found.tolist() == [zlib.crc32(a + b) for a, b in pairs]


def test_features_at_edges_of_texts():
    texts = ["a", "B c", None, "", "d  é日1-f", "x" * 3000 + " y", "., ,", "A b C d"]
    column = pa.array(texts)
    for slice_bytes in (1, 1 << 20):
        found = []
        for part in texts_of(column, slice_bytes):
            buckets, owner, words = targetsampling.feature_buckets(part)
            found += [(int(n), sorted(buckets[owner == i].tolist())) for i, n in enumerate(words)]
        assert found == [(n, sorted(b)) for n, b in map(features, texts)]
