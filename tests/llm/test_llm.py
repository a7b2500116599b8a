"""The training-data operators against brute force on small tables."""

import hashlib
import json
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from fitforge.llm import bpe, exactdup, isolation, ngramjoin, packing, privacy, resampling, sharding, suffixes, toolcalls

PATH = public_tokenizers.path("byte_bpe_50k.json")
KEY = b"key of the tests"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n int, digest string, key string"


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    words = ["alpha", "beta", "gamma", "Delta", "é", "x1", "omega"]
    base = [" ".join(r.choice(words) for _ in range(60)) for _ in range(6)]
    texts = [None, "", " \n\t", "one", "one two", "a  b\tc", base[0], base[0], base[0] + " ", base[0].replace(" ", "\n")]
    texts += [b + " tail end" for b in base] + [b.upper() for b in base] + ["<|endoftext|> it's 'RE x  \n", "z" * 5000, base[1] * 40]
    out = [(i * 3 % 31, t, None, "s", None, 1, "d", None) for i, t in enumerate(texts)]
    return [*out, out[6]]  # one row twice


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def labels(spark, rows):
    return spark.createDataFrame([(r[0], int(not (r[1] or "").isupper()), 0) for r in rows[:-1]], "doc_id long, quality int, toxic int")


def _ids(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_bpe_equals_the_library_on_random_texts(spark):
    r, tokenizer = random.Random(1), Tokenizer.from_file(PATH)
    letters = list("aest '\n\t1é.!") + [" ", "　", "<|endoftext|>", "日", "🙂", "'s", "'ll"]
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(2000)]
    found = bpe.encode_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PATH)
    ids = {x["doc_id"]: np.frombuffer(x["ids"], "<u4").tolist() for x in found.collect()}
    assert all(ids[i] == _ids(tokenizer, t) for i, t in enumerate(texts))
    assert {x["doc_id"]: x["text"] for x in bpe.decode_ids(found, PATH).collect()} == dict(enumerate(texts))


@pytest.mark.parametrize("slice_bytes", [1, 64, 8 << 20])
def test_specials_spread_over_neighbouring_texts(monkeypatch, slice_bytes):
    import pyarrow as pa

    monkeypatch.setattr(bpe, "_SLICE", slice_bytes)
    tokenizer, special = Tokenizer.from_file(PATH), "<|endoftext|>"
    texts = []
    for k in range(len(special) + 1):
        for before, after in (("", ""), ("foo.", "bar"), ("é <", "> 's"), (special, special), ("<|endof", "text|>")):
            texts += [before + special[:k], special[k:] + after, None, "x" + special[:k], "", special[k:]]
    for order in range(3):
        if order:
            random.Random(order).shuffle(texts)
        found = [x.tolist() for x in bpe.encoded_texts(pa.array(texts), PATH)]
        assert found == [_ids(tokenizer, t) for t in texts]


def test_round_trip_digests(docs, rows):
    tokenizer = Tokenizer.from_file(PATH)
    found = sorted(map(tuple, bpe.round_trip_digests(docs, PATH).collect()))
    wanted = []
    for r in rows:
        ids = _ids(tokenizer, r[1])
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        wanted.append((r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert found == sorted(wanted)


def test_packing_is_whole_gapless_and_close_to_the_bound(docs, rows):
    tokenizer = Tokenizer.from_file(PATH)
    found = packing.pack_documents(docs, PATH, capacity=128, pieces_per_partition=7).collect()
    wanted = []
    for r in rows:
        ids, start, piece = [*_ids(tokenizer, r[1]), 0], 0, 0
        while start < len(ids):
            length = (len(ids) - start) % 128 or 128
            wanted.append((r[0], piece, start, length, zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())))
            start, piece = start + length, piece + 1
    assert sorted((x["doc_id"], x["piece"], x["start"], x["length"], x["ids_crc32"]) for x in found) == sorted(wanted)
    sequences = {}
    for x in found:
        sequences.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 128
    # many pieces are longer than half a sequence, so the sum of lengths alone is no bound to come close to
    assert len(sequences) <= packing.bin_lower_bound(np.bincount([x["length"] for x in found], minlength=129), 128) + 1


def test_lower_bound_never_exceeds_best_fit():
    r = np.random.default_rng(2)
    for _ in range(50):
        sizes = r.integers(1, 100, r.integers(1, 60))
        bins, offsets, fill = packing.best_fit_decreasing(sizes, 100)
        assert packing.bin_lower_bound(np.bincount(sizes, minlength=101), 100) <= len(fill)
        assert fill.max() <= 100 and fill.sum() == sizes.sum()


@pytest.mark.parametrize("weak", [False, True])
def test_exact_duplicates(docs, rows, weak):
    from pyspark.sql import functions as F

    options = {"digest": lambda c: F.substring(c, 1, 1)} if weak else {}  # a weak digest: only content tells groups apart
    groups = {}
    for r in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r[1] or ""), []).append(r)
    wanted = []
    for content, members in groups.items():
        keep = min(members, key=lambda r: (-len(r[1] or ""), r[0]))[0]
        wanted += [(r[0], keep, len(members), r[0] == keep, hashlib.sha256(content.encode()).hexdigest()) for r in members]
    assert sorted(map(tuple, exactdup.exact_duplicates(docs, **options).collect())) == sorted(wanted)


def test_kept_copies_without_or_with_repeated_doc_id(spark):
    rows = [(None, "alone"), (None, "a l o n e"), (None, "with id"), (1, "with id"), (2, "copy"), (3, "copy"), (3, "other")]
    found = exactdup.drop_exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, found), key=repr) == sorted([(None, "a l o n e"), (1, "with id"), (2, "copy"), (3, "other")], key=repr)


def test_exceptions_reach_rows_without_doc_id(spark):
    texts = [f"Password: ____________{i} " for i in range(10)]
    docs = spark.createDataFrame([(None if i == 1 else i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = privacy.replace_entities(docs, KEY).collect()
    made = {r["value"]: r["surrogate"] for r in privacy.assign_surrogates(docs, KEY).collect()}
    assert any(r["turn"] > 0 for r in privacy.assign_surrogates(docs, KEY).collect())
    assert {(r["doc_id"], r["text"]) for r in found} == {(None if i == 1 else i, f"Password: {made[t.split()[1]]} ") for i, t in enumerate(texts)}


def test_similarity_join(docs, rows):
    sets = {}
    for r in rows:
        w = re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or "").encode().split()
        sets[r[0]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    component = {k: k for k in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                    component[a] = component[b] = min(component[a], component[b])
    found = ngramjoin.similar_components(docs).collect()
    assert len(found) == len(rows)
    assert {tuple(x) for x in found} == {(k, len(s), component[k]) for k, s in sets.items()}


def test_byte_shards(docs, rows):
    found = sharding.byte_shards(docs, shards=4).collect()
    assert sorted((x["doc_id"], x["size"], x["text_crc32"]) for x in found) == sorted((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)
    order = sorted(found, key=lambda x: (x["shard"], x["slot"]))
    assert [x["doc_id"] for x in order] == sorted(r[0] for r in rows)
    for shard in {x["shard"] for x in found}:
        assert [x["slot"] for x in order if x["shard"] == shard] == list(range(sum(x["shard"] == shard for x in found)))


def test_rules(docs, rows, labels):
    for x in isolation.quality_rules(docs, labels).collect():
        text = next(r[1] for r in rows if r[0] == x["doc_id"]) or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        repeated = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
        lines = [s for s in text.split("\n") if s.split()]
        wanted = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated))
        assert tuple(x)[1:6] == wanted
        assert x["base_failed"] == (len(words) < 50 or 100 * len(repeated) > 50 * len(words)) and not (x["base_failed"] and x["kept"])


def test_suffixes(docs, rows):
    seen, wanted = {}, set()
    for i, t in sorted((r[0], (r[1] or "").encode()) for r in rows):
        for p in range(len(t) - 49):
            seen.setdefault(t[p : p + 50], i)
    for i, t in ((r[0], (r[1] or "").encode()) for r in rows):
        gone = bytearray(len(t))
        for p in range(len(t) - 49):
            if seen[t[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(b for b, g in zip(t, gone) if not g)
        wanted.add((i, len(t), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(kept).hexdigest()))
    assert {tuple(x) for x in suffixes.without_repeats(docs).collect()} == wanted


def test_suffixes_beyond_the_names_of_21_bits():
    n = 3_300_000
    data = np.random.default_rng(5).integers(0, 256, n, dtype=np.uint8)
    data[-200:] = data[:200]  # 151 windows of two holders
    starts = np.arange(n - suffixes.LENGTH + 1)
    holder = np.where(starts < n // 2, 1, 2)
    for least in (suffixes.smallest_holder, suffixes._smallest_in_parts):
        found = least(data, starts, holder)
        assert np.flatnonzero(found < holder).tolist() == list(range(n - 200, n - suffixes.LENGTH + 1))


@pytest.mark.parametrize("values, sorts", [(128, 3), (129, 4)])
def test_suffixes_of_few_different_bytes_are_named_with_a_sort_less(monkeypatch, values, sorts):
    rng = np.random.default_rng(values)
    data = np.concatenate((np.append(0, np.arange(257 - values, 256)), rng.choice(np.array([0, 200, 255]), 2_000))).astype(np.uint8)  # 0 is the padding, too
    data = np.concatenate((data, data[500:900], np.zeros(300, np.uint8)))
    starts = np.arange(len(data) - suffixes.LENGTH + 1)
    holder = rng.integers(0, 9, len(starts))
    named, real = [], suffixes._names
    monkeypatch.setattr(suffixes, "_names", lambda key: named.append(len(key)) or real(key))
    found = suffixes.smallest_holder(data, starts, holder)
    least: dict[bytes, int] = {}
    windows = [data[p : p + suffixes.LENGTH].tobytes() for p in starts]
    for w, h in zip(windows, holder.tolist(), strict=True):
        least[w] = min(h, least.get(w, h))
    assert found.tolist() == [least[w] for w in windows] and len(named) == sorts


def test_hashes_of_all_windows_are_those_of_their_spans():
    from fitforge.llm import textkernel

    data = np.random.default_rng(1).integers(0, 256, 500, dtype=np.uint8)
    for width in (1, 20, 500):
        at = np.arange(len(data) - width + 1)
        assert textkernel.window_hashes(data, width).tolist() == textkernel.span_hashes(data, at, at + width).tolist()


def test_runs_of_spans():
    import pyarrow as pa

    r = random.Random(2)
    rows = [r.choice([None, [], [(r.randint(0, 60), r.randint(1, 9)) for _ in range(r.randint(1, 8))]]) for _ in range(300)] + [[(2**31 - 60, 50), (0, 50)], [(0, 50)]]
    column = pa.array([None] + [row and [a << 31 | n for a, n in row] for row in rows], pa.list_(pa.int64())).slice(1)
    start, stop, counts = suffixes._runs(column)
    found, at = [], 0
    for n in counts.tolist():
        found.append(list(zip(start[at : at + n].tolist(), stop[at : at + n].tolist(), strict=True)))
        at += n
    wanted = []
    for row in rows:
        cover: list[tuple[int, int]] = []
        for a, n in sorted(row or ()):
            if cover and a <= cover[-1][1]:
                cover[-1] = (cover[-1][0], max(cover[-1][1], a + n))
            else:
                cover.append((a, a + n))
        wanted.append(cover)
    assert found == wanted


def test_suffixes_of_one_anchor_with_many_contexts(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(suffixes, "SORTED_BYTES", 500)
    r = random.Random(9)
    contexts = [bytes(r.choice(b"ab") for _ in range(4)) + b"x" * 48 + bytes(r.choice(b"ab") for _ in range(4)) for _ in range(300)]
    rows = sorted((7, c, doc) for doc, c in enumerate(contexts) for _ in range(1 + doc % 2))
    sizes, real = [], suffixes.smallest_holder
    monkeypatch.setattr(suffixes, "smallest_holder", lambda d, s, h: sizes.append(len(s)) or real(d, s, h))
    batches = [pa.RecordBatch.from_arrays([pa.array([x[0] for x in part]), pa.array([x[2] for x in part]), pa.array([0] * len(part)), pa.array([x[1] for x in part], pa.binary())], names=["key", "doc", "start", "bytes"]) for part in (rows[:170], rows[170:])]
    gone = {(x["doc"], p) for b in suffixes._repeated(iter(batches)) for x in b.to_pylist() for p in range(x["start"], x["stop"] - suffixes.LENGTH + 1)}
    least: dict[bytes, int] = {}
    for doc, c in enumerate(contexts):
        for p in range(7):
            least.setdefault(c[p : p + 50], doc)
    assert gone == {(doc, p) for doc, c in enumerate(contexts) for p in range(7) if least[c[p : p + 50]] < doc}
    assert all(s <= 500 for s in sizes)


def test_resampling_on_held_out_labels(spark):
    data = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    held_out = {r["doc_id"]: r["quality"] for r in labels.where("doc_id % 4 = 0").collect()}
    found = {r["doc_id"]: r["kept"] for r in resampling.resample(docs, labels.where("doc_id % 4 <> 0")).collect()}
    assert np.mean([found[i] == (q == 1) for i, q in held_out.items()]) > 0.95
    assert sum(r["kept"] for r in resampling.resample(docs, labels, k=100).collect()) == 100


def test_surrogates(spark):
    text = 'mail und.34@mail7.example.com, +1 (017) 555-7713, 4539578763621486 at 97.51.17.173 token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" Frau Anna Schmidt Version 2.0.'
    rows = [(1, text), (2, "UND.34@mail7.example.com"), (3, "4539 5787 6362 1486 und.35@mail7.example.com"), (4, None), (5, "no data 4.0.")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_entities string")
    found = {r["doc_id"]: r for r in privacy.replace_entities(docs, KEY).collect()}
    assert [found[i]["n_entities"] for i in range(1, 6)] == [6, 1, 2, 0, 0] and found[4]["text"] is None and found[5]["text"] == "no data 4.0."
    assert not any(x in found[1]["text"] for x in ("und.34", "555-7713", "4539578763621486", "97.51.17.173", "04dbebab", "Schmidt")) and "Version 2.0." in found[1]["text"]
    mail = re.search(r"mail (\S+@\S+),", found[1]["text"])[1]
    card = re.search(r"\d{16}", found[1]["text"])[0]
    assert found[2]["text"].lower() == mail and found[3]["text"].startswith(" ".join(card[i : i + 4] for i in range(0, 16, 4))) and not found[3]["text"].endswith(mail)
    assert privacy._luhn(card[:-1]) == int(card[-1])
    made = {privacy.surrogate("ip", f"10.0.{i}.{j}", KEY) for i in range(40) for j in range(256)}
    assert len(made) == 40 * 256


def test_entities_of_texts_without_ascii_digits():
    for text, kind in (("api_key=AbCdEfGhIjKlMnOp", "secret"), ("a password: correct-horse-battery", "secret"), ("abcdefab" * 4, "hex"), ("Tel +٣٣ ٦١٢ ٣٤٥ ٦٧٨", "phone"), ("٤٥٣٩٥٧٨٧٦٣٦٢١٤٨٦", "card")):
        assert [x[2] for x in privacy.find_entities(text)] == [kind] and [x[2] for x in privacy.find_entities(text + " and 1")] == [kind]


def test_whole_entities_are_found():
    whole = {
        "phone": ["+14155550123", "+49 151 12345678", "+33 1 23 45 67 89", "+49 (0)151 12345678", "(030) 12345678", "0151 12345678", "+1 (017) 555-7713", "01 23 45 67 89"],
        "name:m": ["McDonald", "John Michael Smith", "Jean-Pierre Martin", "Dvořák", "O'Brien", "d'Artagnan", "J. R. Smith", "Juan de la Cruz", "李明", "Dvor\u030c\u00e1k"],
        "secret": ["hunter2", "correct-horse-battery", "pa$$w0rd!x", "a;b,c"],
    }
    before = {"phone": "call 1: ", "name:m": "so Mr. ", "secret": "the password: "}
    for kind, values in whole.items():
        for value in values:
            for after in (", then", ".", " went on", ""):
                text = before[kind] + value + after
                assert [(text[a:b], k) for a, b, k in privacy.find_entities(text)] == [(value, kind)], text
    assert [x for x in privacy.find_entities('password="two words, here" x')] == [(10, 25, "secret")]
    assert privacy.canonical("phone", "+1 (017) 555-7713") == privacy.canonical("phone", "+10175557713")


# Texts with the entities that stand in them, as a reader would mark them.
LABELLED = [
    ("The log of 2024-01-15 10:30 says so.", []), ("Due 15.01.2024 12:45, or 15/01/2024.", []), ("From 2019-2020 and 01/2019 to 12/2021.", []), ("Codes 100 200 300 and 1 000 000 000 and 123.456.789 came up.", []),
    ("Call 555-123-4567 or 1-555-123-4567 today.", ["555-123-4567", "1-555-123-4567"]), ("Call 555.123.4567, or 555 123-4567!", ["555.123.4567", "555 123-4567"]), ("Rufen Sie 030/1234567 an.", ["030/1234567"]), ("Au 01 23 45 67 89 ou +33 1 23 45 67 89.", ["01 23 45 67 89", "+33 1 23 45 67 89"]),
    ("Tel. (030) 12345678.", ["(030) 12345678"]), ("Version 10.20.30.40 and v1.2.3.4 are out.", []), ("Release 1.2.3.4, from host 10.20.30.40.", ["10.20.30.40"]), ("We miss Paris and Paris is nice.", []), ("Please don Armor before battle.", []), ("The lady Justice and a lord Byron fan, sir Knight.", []),
    ("Miss Keller met Sir Allen.", ["Keller", "Allen"]), ("Don Carlos Gomez spoke with señora Molina.", ["Carlos Gomez", "Molina"]), ("MISS CARTER and mr Harris.", ["CARTER", "Harris"]), ("Dr. Roth, Prof. Dr. Winter.", ["Roth", "Winter"]), ("It has 4155550123 rows, 12 34 56 78 90 of them odd.", []),
    ("Chapter 12-345-6789 of 1999-12-31-0001.", []), ("mail jane@mail.example.com now", ["jane@mail.example.com"]), ("Pi is 3.14159265 and 1.234.567.890 is big.", []), ("On 05-06-2021-00017 it broke.", []), ("a sum of 12,345,678.90 in 2021", []),
]


def test_precision_and_recall_on_labelled_texts():
    hits = misses = wrong = 0
    for text, wanted in LABELLED:
        found = [text[a:b] for a, b, _ in privacy.find_entities(text)]
        hits += len(set(found) & set(wanted))
        misses += len(set(wanted) - set(found))
        wrong += len(set(found) - set(wanted))
        assert found == wanted, text
    assert hits >= 18 and misses == wrong == 0


def test_surrogates_of_forms_that_are_used_up(spark):
    texts = ["Password: ____________ 1", "1 用户@例子.公司", "1 Tel +٣٣ ٦١٢ ٣٤٥ ٦٧٨", *(f"Password: ____________{i}" for i in range(10)), *(f"Mr. {n}." for n in privacy._FIRST_NAMES["m"])]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    made = privacy.assign_surrogates(docs, KEY).collect()
    assert len(made) == len(texts) == len({r["surrogate"] for r in made}) and not {r["surrogate"] for r in made} & {r["value"] for r in made}
    found = {r["doc_id"]: r["text"] for r in privacy.replace_entities(docs, KEY).collect()}
    assert all(found[i] != t for i, t in enumerate(texts)) and re.fullmatch(r"1 Tel \+٣[٠-٩] [٠-٩]{3} [٠-٩]{3} [٠-٩]{3}", found[2])


def test_tool_calls(spark):
    schemas = {"add": {"required": ["a"], "properties": {"a": "integer", "b": "integer"}}}
    calls = '{"tool_calls": [{"id": "2", "name": "add", "arguments": {"b": 1, "a": 2}, "after": ["1"]}, {"id": "1", "name": "add", "arguments": {"a": "x"}}, {"id": "3", "name": "add", "arguments": {"a": 1}, "after": ["3"]}]}'
    rows = [(1, 0, "assistant", calls), (1, 1, "tool", '{"tool_call_id": "2", "content": {"z": 1, "y": "é"}}'), (1, 2, "tool", '{"tool_call_id": "9", "content": null}'), (2, 0, "system", None)]
    found = {r["call_id"]: r for r in toolcalls.link_tool_calls(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"), schemas).collect()}
    assert {k: (r["level"], r["valid"]) for k, r in found.items()} == {"1": (0, False), "2": (1, True), "3": (None, True), "9": (None, False)}
    assert found["2"]["exchange"] == '{"arguments":{"a":2,"b":1},"id":"2","name":"add","result":{"y":"é","z":1}}'


def test_tool_calls_in_a_long_chain(spark, monkeypatch):
    def chain(n, conv_id):
        calls = [{"id": str(i), "name": "reply", "arguments": {"text": ""}, "after": [str(i - 1), str(max(0, i - 7))] if i else []} for i in range(n)]
        cycle = [{"id": "x", "name": "reply", "after": ["y"]}, {"id": "y", "name": "reply", "after": ["x", "0"]}, {"id": "z", "name": "reply", "after": ["y"]}]
        return conv_id, 0, "assistant", json.dumps({"tool_calls": cycle + calls[::-1]})

    def levels(*rows):
        found = toolcalls.link_tool_calls(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
        return {(r["conv_id"], r["call_id"]): r["level"] for r in found.collect()}

    def wanted(n, conv_id):
        return {(conv_id, str(i)): i for i in range(n)} | {(conv_id, x): None for x in "xyz"}

    assert levels(chain(300, 1), chain(70, 2)) == wanted(300, 1) | wanted(70, 2)
    monkeypatch.setattr(toolcalls, "TASK_NEEDS", 20)
    assert levels(chain(14, 1), chain(5, 2)) == wanted(14, 1) | wanted(5, 2)


def test_empty_tables(spark, docs, labels):
    empty = docs.limit(0)
    for f in (lambda d: packing.pack_documents(d, PATH), lambda d: bpe.round_trip_digests(d, PATH), exactdup.exact_duplicates, ngramjoin.similar_components, sharding.byte_shards,
              lambda d: isolation.quality_rules(d, labels), suffixes.without_repeats, lambda d: resampling.resample(d, labels), lambda d: privacy.replace_entities(d, KEY)):
        assert f(empty).count() == 0
    assert toolcalls.link_tool_calls(spark.createDataFrame([], "conv_id long, turn int, role string, text string")).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    found = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    kept = {r["doc_id"] for r in found.collect()}
    assert 0 < len(kept) < spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()


def test_kept_rows_are_those_that_resampling_keeps(spark, docs, labels):
    wanted = sorted(r["doc_id"] for r in resampling.resample(docs, labels).where("kept").collect())
    found = resampling.keep_target_like(docs, labels)
    assert sorted(r["doc_id"] for r in found.collect()) == wanted and found.columns == docs.columns
    assert resampling.target_ids(labels, 5).count() == 5


def test_cut_leaves_the_setting_as_it_was(spark):
    from fitforge.llm import scratch

    before = spark.conf.get(scratch._CLEANUP, None)
    assert scratch.cut(spark.range(5).distinct(), "five").count() == 5
    assert spark.conf.get(scratch._CLEANUP, None) == before
