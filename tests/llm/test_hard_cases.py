"""Hard cases of the training-data operators: hot groups, odd graphs, bad input, nulls, brute force."""

import itertools
import json
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from fitforge.llm import exactdup, isolation, ngramjoin, packing, privacy, resampling, sharding, suffixes, toolcalls
from fitforge.llm.components import connected_components

PATH = public_tokenizers.path("byte_bpe_50k.json")
KEY = b"key of the tests"


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


@pytest.mark.parametrize("order", ["ascending", "descending", "random"])
def test_components_of_a_long_chain(spark, order):
    ids = list(range(1000))
    if order == "descending":
        ids.reverse()
    elif order == "random":
        random.Random(1).shuffle(ids)
    links = [*zip(ids, ids[1:], strict=False), *((5000 + i, 6000) for i in range(20)), (7, 7)]
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == dict.fromkeys(range(1000), 0) | dict.fromkeys([*range(5000, 5020), 6000], 5000)


def _brute_components(rows):
    sets = {}
    for i, t in rows:
        words = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode().split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        both = len(x & y)
        if both and 100 * both >= 75 * (len(x) + len(y) - both):
            a, b = sorted((root(a), root(b)))
            up[b] = a
    return {(i, len(sets[i]), root(i)) for i in sets}


def _components(spark, rows):
    return {tuple(r) for r in ngramjoin.similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


@pytest.mark.parametrize("paired", [3, 5000])
def test_similarity_of_texts_around_one_passage(spark, monkeypatch, paired):
    monkeypatch.setattr(ngramjoin, "PAIRED_DOCS", paired)
    monkeypatch.setattr(ngramjoin, "PAIRS_PER_TASK", 7)
    r = random.Random(5)
    words = [f"w{i}" for i in range(200)]
    passage = " ".join(r.choice(words) for _ in range(40))
    rows = []
    for i in range(90):
        own = " ".join(r.choice(words) for _ in range(r.choice([3, 8, 12, 30])))
        rows.append((i, passage + " " + own if r.random() < 0.5 else own + " " + passage))
    assert _components(spark, rows) == _brute_components(rows)


def test_similarity_of_successive_versions(spark):
    r = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    text, rows = [r.choice(words) for _ in range(100)], []
    for i in r.sample(range(10**9), 60):
        rows.append((i, "\n".join(text)))
        text = [*text[1:], r.choice(words)]
    assert _components(spark, rows) == _brute_components(rows) and len({c for _, _, c in _components(spark, rows)}) == 1


def test_different_contents_with_one_polynomial_hash(spark):
    a = thue_morse(1024)
    b = a.translate(str.maketrans("ab", "ba"))
    rows = [(1, a + b), (2, b + a), (3, a + b)]
    assert _components(spark, rows) == {(1, 1, 1), (2, 1, 2), (3, 1, 1)}
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(1, f"{a + b}\n{b + a}\n{a + b}"), (2, f"{a + b} x y {b + a} x y"), (None, None)], "doc_id long, text string")
    found = {r["doc_id"]: (r["n_dup_lines"], r["n_repeat_words"], r["kept"]) for r in isolation.quality_rules(docs, labels).collect()}
    assert found == {1: (1, 0, False), 2: (0, 0, False), None: (0, 0, False)}


def _brute_removed(rows):
    least, out = {}, {}
    for i, t in rows:
        for p in range(len(t) - 49):
            w = t[p : p + 50]
            least[w] = min(i, least.get(w, i))
    for i, t in rows:
        gone = bytearray(len(t))
        for p in range(len(t) - 49):
            if least[t[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        out[i] = (sum(gone), len([x for x in bytes(gone).split(b"\0") if x]))
    return out


@pytest.mark.parametrize("most", [5, 20_000])
def test_suffixes_around_a_phrase_that_all_documents_have(spark, monkeypatch, most):
    monkeypatch.setattr(suffixes, "MOST_STRETCHES", most)
    monkeypatch.setattr(suffixes, "WINDOWS_AT_ONCE", 100)
    r = random.Random(4)
    phrase = "of the party of the first part "

    def letters(n):
        return "".join(r.choice("abcdefgh") for _ in range(n))

    contexts = [letters(14) for _ in range(12)]
    rows = [(i, letters(60) + r.choice(contexts) + phrase + r.choice(contexts) + letters(r.randint(0, 60)) + ("x" * 300 if i % 9 == 0 else "")) for i in range(150)]
    docs = spark.createDataFrame([*rows, (None, rows[0][1]), (7, rows[7][1])], "doc_id long, text string").repartition(5)
    found = {(x["doc_id"], x["n_removed"], x["n_spans"]) for x in suffixes.without_repeats(docs).collect()}
    wanted = _brute_removed([(i, t.encode()) for i, t in rows])
    assert found == {(i, *w) for i, w in wanted.items()} | {(None, 0, 0)}
    assert sum(w[0] > 0 for w in wanted.values()) > 20


def test_exact_duplicates_with_hot_groups_and_without_doc_id(spark, monkeypatch):
    monkeypatch.setattr(exactdup, "LEAST_HOT", 5)
    monkeypatch.setattr(exactdup, "HOT_GROUPS", 20)
    rows = [(i if i % 5 else None, r_text) for i, r_text in enumerate(["", " ", None] * 60 + ["a b", "ab", "a  b"] * 3 + ["c", "d"])]
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((i, t or ""))
    wanted = Counter()
    for members in groups.values():
        keep = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))[0]
        wanted.update((i, keep, len(members), i is not None and i == keep) for i, _ in members)
    found = exactdup.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in found) == wanted
    kept = exactdup.drop_exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(kept) == len(groups) == 4


def test_names_are_replaced_wherever_they_stand(spark):
    texts = ["Mr John Smith met us. Later John Smith left, and Smith came.", "Dr Anna Schmidt saw Mr. Smith.", "John Smith and Anna are not known here."]
    found = [r["text"] for r in privacy.replace_entities(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), KEY).orderBy("doc_id").collect()]
    first = re.fullmatch(r"Mr (\w+ (\w+)) met us\. Later (\w+ \w+) left, and (\w+) came\.", found[0])
    assert first and first[1] == first[3] and first[2] == first[4] and "Smith" not in found[0] and "John" not in found[0]
    second = re.fullmatch(r"Dr (\w+) (\w+) saw Mr\. (\w+)\.", found[1])
    assert second and second[3] == first[2] and second[2] != first[2] and second[1] in privacy._FIRST_NAMES["f"] and second[1] != "Anna"
    assert found[2] == texts[2]


def test_surrogates_are_distinct_typed_and_depend_on_the_key(spark):
    r = random.Random(2)
    values = [f"u{i}@mail{r.randint(0, 9)}.example.com" for i in range(80)] + [f"+49 151 {r.randint(10**6, 10**7 - 1)}" for _ in range(80)] + [f"10.0.{i % 9}.{i}" for i in range(80)]
    values += [f"Mrs {n} {m}" for n in privacy._FIRST_NAMES["f"][:10] for m in ("Miller", "Duval", "Weiß", "Иванова")]
    docs = spark.createDataFrame([(None if i % 7 == 0 else i // 2, f"see {v}, then") for i, v in enumerate(values)], "doc_id long, text string")
    assigned = {key: {(x["kind"], x["value"]): x["surrogate"] for x in privacy.assign_surrogates(docs, key).collect()} for key in (KEY, b"other")}
    for made in assigned.values():
        assert len(set(made.values())) == len(made) and not {v for _, v in made} & set(made.values())
    assert sum(assigned[KEY][e] != assigned[b"other"][e] for e in assigned[KEY]) > 0.9 * len(assigned[KEY])
    made = assigned[KEY]
    assert all(re.fullmatch(r"[\w.]+@[\w.]+\.com", s) for (k, _), s in made.items() if k == "email")
    assert all(re.fullmatch(r"\+4\d{10,}", s) for (k, _), s in made.items() if k == "phone")
    assert all(re.match("[А-Я]", s) for (k, v), s in made.items() if v == "Иванова")
    texts = [x["text"] for x in privacy.replace_entities(docs, KEY).collect()]
    assert Counter(re.sub(r"[\w@.+ ]+", "", t) for t in texts) == Counter(re.sub(r"[\w@.+ ]+", "", f"see {v}, then") for v in values)
    assert not any(v.split()[-1] in t for v in values for t in texts)
    assert len(set(texts)) == len(set(values))


def test_many_mentions_in_one_text():
    text = " ".join(f"user{i}@mail{i}.example.com" for i in range(20_000))
    assert len(privacy.find_entities(text)) == 20_000


def test_tool_calls_of_bad_json(spark):
    deep = '{"tool_calls": [{"id": "1", "name": "reply", "arguments": ' + "[" * 100_000 + "]" * 100_000 + "}]}"
    texts = [
        '{"tool_calls": [{"id": "a", "name": "reply", "arguments": {"text": "x"}, "after": 5}]}',
        '{"tool_calls": [{"name": "reply", "arguments": {"text": "x"}}, {"id": null, "name": "reply"}]}',
        '{"tool_calls": [{"id": "\\ud800", "name": "reply", "arguments": {"text": "\\udfff"}}]}',
        '{"tool_calls": [{"id": "n", "name": "reply", "arguments": {"text": NaN}}]}',
        '{"tool_calls": [{"id": "f", "name": "reply", "arguments": {"text": 1e999}}]}',
        '{"tool_calls": [5, null, {"id": 7, "name": "reply", "arguments": {"text": ""}, "after": [null, "a", 7.5]}]}',
        '{"tool_calls": 5}', "{", "[1]", None, "", deep,
    ]
    rows = [(1, i, "assistant", t) for i, t in enumerate(texts)] + [(1, 50, "tool", '{"tool_call_id": null, "content": 1}'), (1, 51, "tool", "plain"), (1, 52, "tool", '{"tool_call_id": 7, "content": 2}'), (None, 0, "user", "x"), (None, 1, "assistant", texts[0].replace('"a"', '"turn-0"'))]
    found = toolcalls.link_tool_calls(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()
    calls = [r for r in found if r["n_calls"]]
    assert sorted((str(r["call_id"]), r["level"], r["valid"]) for r in calls) == [("7", 1, False), ("None", 0, False), ("None", 0, True), ("\\ud800", 0, True), ("a", 0, True), ("turn-0", 0, True)]
    assert all(r["n_results"] == 0 for r in calls if r["call_id"] is None)
    assert next(r for r in calls if r["call_id"] == "7")["n_results"] == 1
    for r in found:
        json.loads(r["exchange"], parse_constant=lambda c: pytest.fail(c))


def test_ordinary_turns_are_neither_calls_nor_results(spark):
    call = json.dumps({"tool_calls": [{"id": "c", "name": "reply", "arguments": {"text": "x"}}]})
    rows = [("a-1", 0, "user", "please look"), ("a-1", 1, "assistant", call), ("a-1", 2, "tool", '{"tool_call_id": "c", "content": "found"}'), ("a-1", 3, "assistant", "here it is"), ("a-1", 4, "user", '{"tool_calls": [{"id": "d"}]}'), ("b-2", 0, "user", None)]
    found = toolcalls.link_tool_calls(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")).collect()
    assert [(r["conv_id"], r["call_id"], r["call_turn"], r["result_turn"], r["level"], r["valid"]) for r in found] == [("a-1", "c", 1, 2, 0, True)]


def test_tool_call_schemas_with_limits():
    schema = {"f": {"required": ["a"], "properties": {"a": {"type": "integer", "minimum": 1, "maximum": 3}, "b": {"enum": ["x"]}, "c": {"type": "string", "maxLength": 2}}}}
    ok = ['{"a":1}', '{"a":3,"b":"x","c":"yy"}']
    bad = ['{"a":0}', '{"a":true}', '{"a":1.5}', '{"a":1,"b":"y"}', '{"a":1,"c":"yyy"}', "{}", "[]", '{"a":1,"d":1}']
    assert not any(toolcalls.argument_errors("f", x, schema) for x in ok) and all(toolcalls.argument_errors("f", x, schema) for x in bad)


def test_inclusion_in_a_sample_follows_the_weights():
    import pyarrow as pa

    ratio = np.random.default_rng(1).normal(0, 0.4, 64)
    texts = ["one two", "three", "four five six", "", "seven eight nine ten"]
    mean = resampling._weights(pa.array(range(5)), pa.array(texts), ratio, 0)[0]
    wins = Counter(int(np.argmax(4 * mean + resampling._weights(pa.array(range(5)), pa.array(texts), ratio, seed)[1])) for seed in range(6000))
    share = np.exp(4 * mean) / np.exp(4 * mean).sum()
    assert np.abs(np.array([wins[i] / 6000 for i in range(5)]) - share).max() < 0.03 < np.ptp(share)
    long = resampling._weights(pa.array([1, 2]), pa.array([texts[0], " ".join([texts[0]] * 500)]), ratio, 0)[0]
    assert abs(long[0] - long[1]) < 0.4  # length alone gives no weight


def test_seeds_change_the_sample_but_not_its_size(spark):
    data = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    samples = [{r["doc_id"] for r in resampling.resample(docs, labels, k=60, seed=s).where("kept").collect()} for s in (1, 2)]
    assert [len(s) for s in samples] == [60, 60] and 5 < len(samples[0] & samples[1]) < 60


def test_resampling_without_labels_of_both_kinds(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, "c"), (3, None)], "doc_id long, text string")
    for labels in ([], [(1, 1, 0)], [(1, 0, 0), (1, 1, 0)], [(None, 1, 0), (9, 0, 0)]):
        found = resampling.resample(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
        assert [r["kept"] for r in found.collect()] == [True] * 3


def test_certified_partitions_are_left_alone(spark, monkeypatch):
    r = random.Random(6)
    # thirds that only fit exactly in threes: most partitions of 50 have a gap
    sizes = [r.choice([340, 335, 325, 330, 410, 290]) for _ in range(600)] + [1] * 40
    pieces = spark.createDataFrame([(i, 0, 0, n, i) for i, n in enumerate(sizes)], "doc_id long, piece int, start long, length long, ids_crc32 long").repartition(3).persist()
    first = packing._packed(pieces, 1000, 13, 0).persist()
    certified = {x["doc_id"]: (x["pack_group"], x["bin"]) for x in first.where("group_bins = group_bound").collect()}
    before = packing._bins(first).agg({"group_bins": "sum"}).first()[0]
    done, last = packing._exchanged(first, 1000, 50, pieces.columns)
    rows = [x for part in [*done, last] for x in part.collect()]
    assert sorted(x["doc_id"] for x in rows) == list(range(640))
    moved = [x for x in rows if x["turn"] > 0 and x["doc_id"] in certified]
    assert len({certified[x["doc_id"]][0] for x in moved}) <= 1  # the one partner at most
    assert len({(x["turn"], x["pack_group"], x["bin"]) for x in rows}) <= before
    found = packing.pack_pieces(pieces, 1000, 50).collect()
    fill = Counter()
    for x in found:
        fill[x["sequence_id"]] += x["length"]
    assert max(fill.values()) <= 1000 and len(fill) <= before
    assert found[0].__fields__ == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "certified"]


def test_texts_of_a_megabyte_and_null_ids_are_packed(spark):
    text = "".join(random.Random(1).choice("abc de\n") for _ in range(1_200_000))
    rows = packing.pack_documents(spark.createDataFrame([(None, text), (None, None), (2, "")], "doc_id long, text string"), PATH).collect()
    assert sum(r["length"] for r in rows if r["doc_id"] == 2) == 1 and sum(r["doc_id"] is None for r in rows) > 100


def test_shards_have_nearly_equal_bytes(spark):
    r = random.Random(7)
    docs = spark.createDataFrame([(None if i % 50 == 0 else i, "é" * r.choice([0, 5, 50, 700])) for i in range(3000)], "doc_id long, text string")
    shards = Counter()
    sizes = []
    for x in sharding.byte_shards(docs).collect():
        shards[x["shard"]] += x["size"]
        sizes.append(x["size"])
    target = sum(sizes) / 24
    assert set(shards) == set(range(24)) and all(abs(n - target) < 2 * max(sizes) for n in shards.values())


@pytest.mark.parametrize("samples", [3, 100_000])
def test_shards_need_no_scratch_files(spark, monkeypatch, tmp_path, samples):
    """Executors start processes for each file that they write, and any of them may count as much memory as the executor."""
    from fitforge.llm import scratch

    monkeypatch.setattr(sharding, "SAMPLES", samples, raising=False)
    monkeypatch.setattr(scratch, "scratch_dir", lambda _: str(tmp_path))
    r = random.Random(11)
    ids = [None, None, -(2**62), *(-i for i in range(5)), *range(2000), *([7] * 30), 2**40, 2**62]
    rows = [(i, r.choice([None, "", "é", "x" * 40, "y" * 900])) for i in ids]
    found = sharding.byte_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert not list(tmp_path.iterdir())
    order = sorted(found, key=lambda x: (x["shard"], x["slot"]))
    assert [x["doc_id"] for x in order] == sorted(ids, key=lambda i: (i is not None, i or 0))
    below, whole = 0, sum(x["size"] for x in found)
    slots = Counter()
    for x in order:
        assert (x["shard"], x["slot"]) == (below * 24 // whole, slots[x["shard"]])
        below += x["size"]
        slots[x["shard"]] += 1


def test_isolation_forest_against_a_plain_one():
    rng = np.random.default_rng(3)
    rows = np.concatenate((rng.normal(0, 1, (200, 4)), [[9, 9, 9, 9]]))
    forest = [isolation.grow_tree(rows[rng.choice(201, 64, replace=False)], rng) for _ in range(50)]

    def depth(tree, row):
        node = 0
        while tree[node][0] >= 0:
            node = int(tree[node][2] if row[int(tree[node][0])] <= tree[node][1] else tree[node][3])
        return tree[node][4]

    plain = [2 ** (-np.mean([depth(t, row) for t in forest]) / isolation._usual_depth(64)) for row in rows]
    found = isolation.anomaly_scores(forest, rows, 64)
    assert np.allclose(found, plain) and int(np.argmax(found)) == 200


def test_isolation_on_held_out_labels(spark):
    data = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    held_out = {r["doc_id"]: r["quality"] for r in labels.where("doc_id % 4 = 0").collect()}
    found = {r["doc_id"]: r for r in isolation.quality_rules(docs, labels.where("doc_id % 4 <> 0")).collect()}
    judged = [(found[i]["kept"], q == 1) for i, q in held_out.items() if not found[i]["base_failed"]]
    assert np.mean([a == b for a, b in judged]) > 0.95


def test_texts_that_repeat_lines_are_anomalous(spark):
    r = random.Random(8)
    words = [f"{a}{b}{c}" for a in "bcdfglmnprst" for b in "aeiou" for c in ("n", "r", "st", "l")]

    def text(n):
        return " ".join(r.choice(words) for _ in range(n))

    plain = [(i, "\n".join(text(30) for _ in range(8))) for i in range(400)]
    # ten short lines that come twice: few words, half of all lines
    lines = [[text(2) for _ in range(10)] for _ in range(20)]
    repeating = [(1000 + i, "\n".join([text(150), *x, *x])) for i, x in enumerate(lines)]
    docs = spark.createDataFrame([*plain, *repeating], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 1000), 0) for i, _ in plain[::2] + repeating[::2]], "doc_id long, quality int, toxic int")
    found = {x["doc_id"]: x for x in isolation.quality_rules(docs, labels).collect()}
    assert not any(x["base_failed"] for x in found.values())
    assert not any(found[i]["kept"] for i, _ in repeating) and sum(not found[i]["kept"] for i, _ in plain) <= 2
    assert min(found[i]["repeat_score"] for i, _ in repeating) > max(found[i]["repeat_score"] for i, _ in plain)


def test_pipeline_on_hard_rows(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(11)
    words = "the of and to in is was for that on with as by at from his it an were are which this be or has".split()
    good = [" ".join(r.choice(words) + r.choice(["", "", "s", "ing"]) for _ in range(120)) + "." for _ in range(31)]
    junk = ["".join(r.choice("#$%&*<>|@!~^") for _ in range(4)) + " " + " ".join("".join(r.choice("#$%&*<>|") for _ in range(5)) for _ in range(60)) for _ in range(12)]
    near = " ".join([*good[0].split()[:-3], "quite", "another", "end"])
    rows = [(i, t) for i, t in enumerate(good[:30])] + [(100 + i, t) for i, t in enumerate(junk)]
    rows += [(200, good[1].replace(" ", "\n")), (201, near), (202, good.pop() + " Mr John Smith, john@mail1.example.com"), (None, good[3] + " alone"), (None, None), (203, ""), (204, "\n".join(r.sample(good[:30], 30))), rows[5]]
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_entities long, sequence_id string"
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), 3, "x") for i, t in rows], schema).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(0, 30, 2)] + [(100 + i, 0, 0) for i in range(0, 12, 2)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, counts = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == [f.split()[0] for f in schema.split(", ")]
        counts.append({(x["doc_id"], x["text"]) for x in docs.collect()})
    ids = [{i for i, _ in c} for c in counts]
    assert set(range(30)) <= ids[0] and not {100 + i for i in range(12)} & ids[0]
    assert 200 not in ids[1] or 1 not in ids[1]
    assert 201 not in ids[2] and 0 in ids[2] and {i for i in ids[1] if i != 201} == ids[2]
    assert not any("John" in (t or "") or "john@" in (t or "") for _, t in counts[3]) and len(counts[3]) == len(counts[2])
    assert any(t is not None and t.endswith("alone") for i, t in counts[3] if i is None)
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x["doc_id"] for x in packed} == ids[3]
    spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/empty/documents.parquet")
    spark.read.parquet(f"{tmp_path}/labels.parquet").write.parquet(f"{tmp_path}/empty/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0


def test_tool_calls_that_repeat_or_tie(spark):
    def call(i, text, **more):
        return json.dumps({"tool_calls": [{"id": i, "name": "reply", "arguments": {"text": text}, **more}]})

    rows = [(1, 0, "assistant", call("a", "late")), (1, 0, "assistant", call("a", "early")), (1, 3, "assistant", call("a", "third")), (1, 1, "tool", '{"tool_call_id": "a", "content": 2}'), (1, 1, "tool", '{"tool_call_id": "a", "content": 1}')]
    rows += [rows[0], (2, 0, "assistant", call("b", "x" * 1_000_000)), (2, 1, "system", "s"), (None, None, None, None)]
    frame = spark.createDataFrame([(*r, "k", 1) for r in rows], "conv_id long, turn int, role string, text string, call_id string, level int")
    found = {r["call_id"]: r for r in toolcalls.link_tool_calls(frame).collect()}
    assert set(found) == {"a", "b"}
    assert (found["a"]["n_calls"], found["a"]["n_results"], found["a"]["call_turn"], found["a"]["result_turn"]) == (4, 2, 0, 1)
    assert json.loads(found["a"]["exchange"])["arguments"] == {"text": "early"} and json.loads(found["a"]["exchange"])["result"] == 1
    assert found["a"]["valid"] and not found["b"]["valid"] and len(found["b"]["exchange"]) > 1_000_000


def test_round_trip_of_a_long_text(spark):
    import hashlib

    from tokenizers import Tokenizer

    from fitforge.llm import bpe

    text = "".join(random.Random(3).choice(["a", "b", "the ", "é", "\n", "  ", "'s", "12", "日"]) for _ in range(600_000))
    tokenizer = Tokenizer.from_file(PATH)
    ids = tokenizer.encode(text, add_special_tokens=False).ids
    row = bpe.round_trip_digests(spark.createDataFrame([(None, text)], "doc_id long, text string"), PATH).first()
    assert (row["doc_id"], row["n_tokens"], row["ids_sha256"]) == (None, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
    assert row["decoded_sha256"] == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_columns_with_the_names_of_the_operators_own(spark):
    names = "a b bin bytes component content count doc docs fill hot key keep_id kept kind least lone n node noise part piece place range rank salt score sequence_id shard start stop surrogate text_sha256 token turn turns up value _kept_id _text _text_hash _turns _sha256 _n".split()
    docs = spark.createDataFrame([(i, f"word {i % 2} " * 60, *("x" for _ in names)) for i in range(4)], f"doc_id long, text string, {', '.join(f'`{n}` string' for n in names)}")
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0)], "doc_id long, quality int, toxic int")
    assert {r["doc_id"] for r in exactdup.drop_exact_duplicates(docs).collect()} == {0, 1}
    assert {r["doc_id"] for r in ngramjoin.drop_near_duplicates(docs).collect()} == {0, 1}
    assert suffixes.without_repeats(docs).where("n_removed > 0").count() == 2
    assert privacy.replace_entities(docs, KEY).columns == [*docs.columns, "n_entities"] and privacy.replace_entities(docs, KEY).count() == 4
    assert resampling.keep_target_like(docs, labels).columns == docs.columns
    assert sharding.byte_shards(docs).count() == isolation.quality_rules(docs, labels).count() == packing.pack_documents(docs, PATH).count() == 4
