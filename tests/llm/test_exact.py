"""Operators against brute force, on a small fixture with nulls, empty and long texts, ties, repeats and odd columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from concurrent.futures import ThreadPoolExecutor
from threading import Barrier

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glossa.llm import chat, decontaminate, neardup, packing, quality, repeats, rollup, scratch, substrings, suffixes, tokens, urls
from glossa.llm import textbuf as tb

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, k1 string, rest string"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def corpus(seed: int = 3, n: int = 60) -> list[tuple]:
    """Documents that share passages with each other and within themselves."""
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefg") for _ in range(r.randint(2, 7))) for _ in range(300)] + ["Été", "naïve,", "ß", "你好", "don't", "x1"]
    say = lambda k: " ".join(r.choice(vocab) for _ in range(k))
    passages = [say(r.randint(40, 140)) for _ in range(8)]
    rows = []
    for i in range(n):
        parts = [say(r.randint(0, 120))]
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            if r.random() < 0.4:
                w = p.split(" ")
                w[r.randrange(len(w))] = "changed"
                p = " ".join(w)
            parts += [p, say(r.randint(0, 60))]
        text = r.choice([" ", "\n", "  ", "\t"]).join(parts)
        if rows and r.random() < 0.15:
            text = r.choice(rows)[1]
        rows.append((i * 3 % n if n % 3 else i, text))
    rows[5] = (rows[5][0], None)
    rows[6] = (rows[6][0], "")
    rows[7] = (rows[7][0], " \n\t ")
    rows[8] = (rows[8][0], "one two")
    rows.append((1000, say(9000)))
    rows.append((1001, " ".join(passages) * 3))
    return [(d, t, "en", None if d % 7 == 0 else "s", None if t is None else len(t), 1, "clash", "clash") for d, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


@pytest.fixture(scope="module")
def texts():
    return {r[0]: (r[1] or "").encode() for r in corpus()}


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_encoder_is_the_tokenizers():
    r = random.Random(5)
    pieces = [" ", "  ", " \n", "\n ", "a", "Bc", "é", "'s", "'re", ".", "12", "—", "<|endoftext|>", "\t", "ß!", "\u00a0", "\u2003x", "你", ""]
    said = ["".join(r.choice(pieces) for _ in range(r.randint(0, 30))) for _ in range(800)] + ["", " ", "a ", "\n "]
    e = tokens.Encoder(tokens.default_tokenizer())
    for chunk in (said, said[:50]):  # the second time from the cache
        ids, off = e.encode(*tb.parts(pa.array(chunk)))
        for i, x in enumerate(e.model.encode_batch(chunk, add_special_tokens=False)):
            assert ids[off[i] : off[i + 1]].tolist() == [*x.ids, tokens.END_ID]


def test_rank_encoder():
    r = random.Random(6)
    pieces = [" ", "  ", " \n", "a", "Bc", "é", "'s", ".", "12", "—", "<|endoftext|>", "\t", "\u00a0", "你", "straße", "naïve", " the", " og"]
    said = ["".join(r.choice(pieces) for _ in range(r.randint(0, 30))) for _ in range(500)] + ["", " "]
    e = tokens.Encoder.of(tokens.versioned("byte_bpe_multi_50k.tiktoken"))
    ids, off = e.encode(*tb.parts(pa.array(said)))
    for i, x in enumerate(said):
        assert ids[off[i] : off[i + 1]].tolist() == [*e.model.encode_ordinary(x), tokens.END_ID]


def test_token_store(spark, docs, texts):
    shards = tokens.write_store(docs, scratch.path(spark, "store"), frame_tokens=500)
    found = by_id(tokens.read_store(shards))
    e, start = tokens.Encoder.of(tokens.default_tokenizer()).model, 0
    for d in sorted(texts):
        ids = [*e.encode(texts[d].decode(), add_special_tokens=False).ids, 2]
        assert tuple(found[d]) == (d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    some = {r["doc_id"]: r["tokens"] for r in tokens.fetch(shards, [3, 1000, 77777]).collect()}
    assert sorted(some) == [3, 1000] and some[3] == [*e.encode(texts[3].decode(), add_special_tokens=False).ids, 2]


def test_token_store_detects_damage(spark, docs):
    where = tokens.write_store(docs, scratch.path(spark, "store")).first()["path"]
    system, local = tokens._open(where)
    with system.open_input_file(local) as f:
        raw = bytearray(f.read())
    raw[len(raw) // 3] ^= 255
    reader = tokens.ShardReader(pa.PythonFile(__import__("io").BytesIO(bytes(raw)), "r"))
    with pytest.raises(Exception):  # noqa: B017
        for k in range(len(reader.frames)):
            reader.frame(k)


def test_substrings(spark, docs, texts):
    made = by_id(substrings.factored(docs, 10))
    first, dropped = {}, {}
    for d in sorted(texts):
        w = WORD.findall(texts[d])
        for i in range(len(w) - 9):
            first.setdefault(tuple(w[i : i + 10]), d)
    for d, t in texts.items():
        w = WORD.findall(t)
        gone = dropped[d] = {j for i in range(len(w) - 9) if first[tuple(w[i : i + 10])] < d for j in range(i, i + 10)}
        parse = made[d]["factors"]
        assert {j for f in parse for j in range(f["start"], f["start"] + f["length"])} == gone
        assert sum(f["length"] for f in parse) == len(gone)
        for f in parse:
            at = f["source_start"]
            assert f["source"] < d and WORD.findall(texts[f["source"]])[at : at + f["length"]] == w[f["start"] : f["start"] + f["length"]]
    kept = by_id(substrings.deduplicated(docs, 10))
    for d, t in texts.items():
        w = WORD.findall(t)
        gone = dropped[d]
        left = b" ".join(x for j, x in enumerate(w) if j not in gone)
        if gone and not left:
            assert d not in kept
        elif gone:
            assert kept[d]["text"].encode() == left and kept[d]["n_chars"] == len(kept[d]["text"])
        else:
            assert (kept[d]["text"] or "").encode() == t
        assert d not in kept or kept[d]["rest"] == "clash"


def test_suffixes(spark, docs, texts):
    made = by_id(suffixes.repeated_bytes(docs, 60))
    times = Counter(t[i : i + 60] for t in texts.values() for i in range(len(t) - 59))
    for d, t in texts.items():
        gone = {j for i in range(len(t) - 59) if times[t[i : i + 60]] > 1 for j in range(i, i + 60)}
        assert {j for x in made[d]["found"] or [] for j in range(x["s"], x["e"])} == gone


def test_sliding_argmin():
    h = tb.mix(np.random.default_rng(1).integers(0, 50, 500).astype(np.uint64))
    for w in (1, 2, 7, 43):
        want = [i + int(np.argmin(h[i : i + w] >> np.uint64(32))) for i in range(500 - w + 1)]
        assert tb.sliding_argmin(h, w).tolist() == want


def test_decontamination(spark, docs, texts):
    low = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower() if t.isascii() else bytes(b + 32 if 65 <= b <= 90 else b for b in t))
    some = [t for t in texts.values() if len(t) > 300][:6]
    items = [(i, " ".join(t.decode().split()[5:30])) for i, t in enumerate(some)] + [(50, "One TWO"), (51, None), (52, ""), (None, "x1 don't"), (53, "one")]
    found = by_id(decontaminate.contamination(docs, spark.createDataFrame(items, "item_id long, text string")))
    pats = defaultdict(set)
    for i, t in items:
        w = low((t or "").encode())
        m = min(10, len(w))
        for k in range(len(w) - m + 1 if m else 0):
            pats[tuple(w[k : k + m])].add("null" if i is None else str(i))
    for d, t in texts.items():
        w, hit, names = low(t), set(), set()
        for m in {len(p) for p in pats}:
            for k in range(len(w) - m + 1):
                if tuple(w[k : k + m]) in pats:
                    hit |= set(range(k, k + m))
                    names |= pats[tuple(w[k : k + m])]
        assert (found[d]["n_words"], found[d]["n_hit"], found[d]["items"]) == (len(w), len(hit), sorted(names))
    kept = {r["doc_id"] for r in decontaminate.clean(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert kept == {d for d in texts if not found[d]["n_hit"]}


def test_decontamination_in_blocks(spark, docs, monkeypatch):
    items = spark.createDataFrame([(i, f"one two {i}" * (i + 1)) for i in range(20)] + [(99, "one two")], "item_id long, text string")
    whole = by_id(decontaminate.contamination(docs, items))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 100)
    assert by_id(decontaminate.contamination(docs, items)) == whole


def test_quality(spark, docs, texts):
    rules = quality.Rules(min_repeat=9)
    found = by_id(quality.judge(docs, rules))
    for d, t in texts.items():
        w = WORD.findall(t)
        def repeated(n, w=w):
            c = Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
            return {j for i in range(len(w) - n + 1) if c[tuple(w[i : i + n])] > 1 for j in range(i, i + n)}

        lines = [x for x in t.split(b"\n") if WORD.search(x)]
        row = found[d]
        longest = 0
        if repeated(8):
            low, high = 8, len(w)  # a repeat of n words holds one of n - 1
            while high - low > 1:
                low, high = ((low + high) // 2, high) if repeated((low + high) // 2) else (low, (low + high) // 2)
            longest = low
        assert (row["n_words"], row["word_chars"], row["n_symbols"]) == (len(w), sum(len(x.decode()) for x in w), sum(t.count(b) for b in b"#*$%&|<>"))
        assert (row["n_dup_lines"], row["n_repeat_words"], row["n_covered"]) == (len(lines) - len(set(lines)), len(repeated(8)), len(repeated(9)))
        assert row["longest_repeat"] == longest or not repeated(8)
        assert row["base_failed"] == (len(w) < 20 or 100 * len(repeated(8)) > 30 * len(w))
    assert {r["doc_id"] for r in quality.passing(docs, rules).collect()} == {d for d in texts if found[d]["kept"]}


def test_suffix_array():
    r = random.Random(2)
    for _ in range(60):
        s = [r.randrange(3) for _ in range(r.randint(2, 60))]
        order, common = quality.suffix_array(np.array(s, np.uint64))
        assert order.tolist() == sorted(range(len(s)), key=lambda i: s[i:])
        for a, b, c in zip(order[:-1], order[1:], common, strict=True):
            x, y = s[a:], s[b:]
            assert c == next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))


def test_near_duplicates(spark):
    r = random.Random(9)
    rows = []
    for g in range(12):
        base = [f"w{g}_{r.randrange(500)}" for _ in range(120)]
        for _ in range(r.randint(1, 12)):
            w = list(base)
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = f"n{r.randrange(10**6)}"
            rows.append(" ".join(w))
    rows += [None, "", " \n", "A b", "a B", "a", "A", rows[0], rows[0].upper()]
    r.shuffle(rows)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(rows)], "doc_id long, text string, n_shingles string")
    sets = []
    for t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set())
    parent = list(range(len(rows)))
    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    _, found = neardup.grouped(docs)
    assert {x["k1"]: (x["n_shingles"], x["component"]) for x in found.collect()} == {i: (len(s), top(i)) for i, s in enumerate(sets)}
    assert sorted(x["doc_id"] for x in neardup.deduplicated(docs).collect()) == [i for i in range(len(rows)) if top(i) == i]


def test_crowded_regions(spark, monkeypatch):
    """With hardly any neighbours, what the walk along the orders misses is found between components."""
    monkeypatch.setattr(neardup, "NEIGHBOURS", 1)
    test_near_duplicates(spark)


def test_dense_region(spark):
    """Thousands of texts of one template, most of them just under the threshold: recall of links, and few pairs a text."""
    r = random.Random(8)
    base = [f"t{i}" for i in range(150)]
    rows = []
    for i in range(2000):
        w = list(base)
        for k in r.sample(range(150), r.choice([3, 4, 4, 4])):
            w[k] = f"n{r.randrange(10**6)}"
        rows.append(w)
    for i in range(0, 2000, 20):  # pairs that are nearer
        rows[i + 1] = list(rows[i])
        for k in r.sample(range(150), 3):
            rows[i + 1][k] = f"m{i}_{k}"
    sets = [{tuple(w[i : i + 3]) for i in range(148)} for w in rows]
    ids = {g: n for n, g in enumerate(sorted(set().union(*sets)))}
    has = np.zeros((len(rows), len(ids)), np.float32)
    for i, x in enumerate(sets):
        has[i, [ids[g] for g in x]] = 1
    both = has @ has.T
    size = has.sum(1)
    linked = 100 * both >= 85 * (size[:, None] + size[None, :] - both)
    x, y = np.nonzero(np.triu(linked, 1))
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    counted = []
    links = neardup._links
    neardup._links = lambda pairs, *rest: (counted.append(pairs.count()), links(pairs, *rest))[1]
    try:
        found = {n["k1"]: n["component"] for n in neardup.grouped(docs)[1].collect()}
    finally:
        neardup._links = links
    caught = np.mean([found[a] == found[b] for a, b in zip(x.tolist(), y.tolist(), strict=True)])
    print("links", len(x), "recall", caught, "pairs", counted)
    assert len(x) >= 100 and caught >= 0.9
    assert counted[0] <= len(rows) * neardup.TREES * (neardup.NEIGHBOURS + neardup.DEPTH) and all(n <= len(rows) * neardup.DENSE_TREES * neardup.NEIGHBOURS for n in counted[1:])


def test_hub_texts_are_salted(spark, monkeypatch):
    monkeypatch.setattr(neardup, "HUB", 2)
    test_near_duplicates(spark)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 7), (200, 201), (201, 200), (300, 300)]
    found = {r["node"]: r["root"] for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(1, 41)}, 100: 0, 201: 200}


@pytest.mark.parametrize("bins", [packing.Bin(), packing.SEQUENCE, packing.Bin(documents=3), packing.Bin(attention=1024**2, documents=5, weights=(1, 0.5, 0.5), select="dot")])
def test_packing(spark, docs, texts, bins):
    rows = packing.pack(docs, bins=bins).collect()
    e = tokens.Encoder.of(tokens.default_tokenizer()).model
    ids = {d: [*e.encode(t.decode(), add_special_tokens=False).ids, 2] for d, t in texts.items()}
    per, seq = defaultdict(list), defaultdict(list)
    for r in rows:
        per[r["doc_id"]].append(r)
        seq[r["sequence_id"]].append(r)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    for d, own in per.items():
        own.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) and sum(r["length"] for r in own) == len(ids[d])
        assert [r["start"] for r in own] == [sum(x["length"] for x in own[:i]) for i in range(len(own))]
        assert all(r["length"] == 1024 for r in own[1:])
    assert set(per) == set(texts)
    for own in seq.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == [sum(x["length"] for x in own[:i]) for i in range(len(own))]
        assert sum(r["length"] for r in own) <= 1024 and len(own) <= (bins.documents or 1024)


def test_every_capacity_decides():
    one = packing.fit({900: 1, 1: 100}, packing.Bin(documents=32))[1]
    assert (packing.fit({900: 1, 1: 100}, packing.Bin())[1], one) == (1, 4)
    # 300 tokens fit beside 700 in either bin; the residual of documents or of attention says into which they go
    held = {700: 1, 350: 2, 300: 1}
    tight = packing.fit(held, packing.Bin(attention=1024**2, weights=(0, 0, 1)))[0]
    loose = packing.fit(held, packing.Bin(documents=32, weights=(0, 1, 0)))[0]
    bin_of = lambda rows: {r[0]: r[3] for r in rows}
    assert bin_of(tight)[300] == bin_of(tight)[700] and bin_of(loose)[300] == bin_of(loose)[350]
    assert packing.fit({600: 1, 400: 3}, packing.Bin(attention=600**2))[1] == 3


def test_fit_is_tight_and_valid():
    r = random.Random(4)
    h = Counter(r.randint(1, 1023) for _ in range(20_000))
    rows, used = packing.fit(h, packing.Bin())
    assert used <= 1.01 * sum(k * v for k, v in h.items()) / 1024 and len(rows) < 6000
    with pytest.raises(ValueError):
        packing.fit({2000: 1}, packing.Bin())
    with pytest.raises(ValueError):
        packing.Bin(select="first")


def test_chat(spark):
    said = "</s>[INST] ok [/INST] \ue0001 \ue000"
    rows = [(1, 1, "assistant", said), (1, 0, "user", None), (1, 2, "user", "x"), (2, 0, None, "hm"), (2, 1, "assistant", ""), (None, 0, "user", "a"), (1, 2, "user", "x"), (3, 0, "system", "s"), (3, 1, "user", "u"), (3, 2, "assistant", "A" * 100_000)]
    turns = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, part string")
    segments = chat.formatted(turns)
    found = {r["conv_id"]: r for r in chat.read_back(segments).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == conv)
        assert found[conv]["n_turns"] == len(own)
        assert found[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in own).encode()).hexdigest()
        learned = "".join(t for _, r, t in own if r == "assistant")
        assert (found[conv]["loss_chars"], found[conv]["loss_sha256"]) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert found[3]["first_wrong"] is None and found[2]["first_wrong"] == 0 and found[1]["first_wrong"] == 3
    marks = "".join(r["text"] for r in segments.where("conv_id = 1").orderBy("turn_no", "part").collect())
    assert marks.count("[/INST]") == 3 and chat.INSTRUCT.unescape(chat.INSTRUCT.escape(said)) == said


def test_rollup(spark):
    rows = [(1, "a", "en", "x y"), (2, "a", "en", None), (3, None, "fr", "z"), (3, None, "fr", "z")]
    docs = rollup.sized(spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, source string, lang string, text string, sizes int, tokens int"), rollup.OLD, rollup.NEW)
    count = lambda d, i=0: rollup.counted(d, ("old", "new")[i], d["sizes"][i])
    where = scratch.path(spark, "ledger")
    ledger = rollup.Ledger(spark, where)
    assert ledger.totals().count() == 0
    assert ledger.commit("a", inserted=count(docs)) and not ledger.commit("a", inserted=count(docs))
    assert ledger.commit("b", deleted=count(docs.where("doc_id = 3")), revised=(count(docs.where("doc_id = 1")), count(docs.where("doc_id = 1"), 1)))
    assert ledger.commit("c")
    want = [("a", "en", "new", 1, 2), ("a", "en", "old", 1, 0)]
    assert sorted(map(tuple, ledger.totals().collect())) == want
    assert ledger.committed() == ["a", "b", "c"]
    assert ledger.compact() and sorted(map(tuple, ledger.totals().collect())) == want
    again = rollup.Ledger(spark, where)
    assert not again.commit("a", inserted=count(docs)) and again.commit("d", inserted=count(docs.where("doc_id = 2")))
    assert again.compact() and sorted(map(tuple, again.totals().collect())) == [want[0], ("a", "en", "old", 2, 0)]
    assert len([n for n in again._names(".") if n.startswith("data-")]) == 1


def test_rollup_two_writers(spark):
    """Both have written their deltas before either commits: one of them counts."""
    docs = rollup.counted(spark.createDataFrame([("a", "en")], "source string, lang string"), "v", F.lit(5))
    ledger = rollup.Ledger(spark, scratch.path(spark, "ledger"))
    meet, publish = Barrier(2), ledger._publish

    def late(*args):
        meet.wait(60)
        return publish(*args)

    ledger._publish = late
    with ThreadPoolExecutor(2) as pool:
        won = [f.result() for f in [pool.submit(ledger.commit, "same", docs) for _ in range(2)]]
    assert sorted(won) == [False, True]
    assert list(map(tuple, ledger.totals().collect())) == [("a", "en", "v", 1, 5)]


def test_rollup_markers_of_many_writers(spark):
    """Of writers of one marker at one time exactly one counts, and the marker is readable."""
    ledger = rollup.Ledger(spark, scratch.path(spark, "ledger"))
    writers = 4
    meet = Barrier(writers)

    def publish(name, i):
        meet.wait(60)
        return ledger._publish("batches", name, {"data": str(i) * 10**i})

    with ThreadPoolExecutor(writers) as pool:
        for k in range(60):
            won = [f.result() for f in [pool.submit(publish, f"m{k}", i) for i in range(writers)]]
            assert sum(won) == 1
            assert ledger._said("batches", f"m{k}") == {"data": str(won.index(True)) * 10 ** won.index(True)}
    assert ledger.committed() == sorted(f"m{k}" for k in range(60)) and not ledger._names("pending")


def test_op4_query(spark):
    sf = "/root/testdata/sf0.001"
    toxic = {}
    for r in spark.read.parquet(f"{sf}/labels.parquet").collect():
        toxic[r["doc_id"]] = max(toxic.get(r["doc_id"], 0), r["toxic"] or 0)
    ids = tokens.Encoder.of(tokens.default_tokenizer()).model
    ranks = tokens.Encoder.of(tokens.versioned(rollup.NEW)).model
    docs, size = Counter(), Counter()
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        if toxic.get(r["doc_id"]) == 1:
            continue
        new = r["doc_id"] in toxic
        key = (r["source"], r["lang"], rollup.NEW if new else rollup.OLD)
        docs[key] += 1
        size[key] += len(ranks.encode_ordinary(r["text"] or "") if new else ids.encode(r["text"] or "", add_special_tokens=False).ids)
    found = {tuple(r)[:3]: tuple(r)[3:] for r in rollup.op4_token_rollup(spark, sf).collect()}
    assert found == {k: (n, size[k]) for k, n in docs.items()}


def test_urls(spark):
    given = [(1, "http://Ab.Example.com/en/71?x#y"), (2, "https://example.net/de/8"), (3, "https://example.net/de/9"), (4, "notcom/en/"), (5, None), (6, "http://xcom/en/"), (7, "x://q.com#/en/"), (8, "http://a.org/es/1?u=://b"), (9, "")]
    found = {r["page_id"]: r for r in urls.filtered(spark.createDataFrame([(*g, "clash") for g in given], "page_id long, url string, host string")).collect()}
    assert (found[1]["host"], found[1]["path"], found[1]["rule"], found[1]["verdict"]) == ("ab.example.com", "/en/71", "example.com/en/7", "allow")
    assert [found[i]["rule"] for i in range(2, 10)] == ["example.net/de/8", "net/de/", None, None, None, None, "org/es/", None]
    assert (found[7]["host"], found[7]["path"]) == ("q.com", "") and (found[5]["host"], found[5]["path"]) == ("", "") == (found[4]["host"], found[4]["path"])
    assert all(r["verdict"] in ("allow", "block") for r in found.values())


def test_urls_held_out(spark):
    assert urls.held_out(spark.read.parquet("/root/testdata/sf0.1/pages.parquet")) >= 0.9


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    items = spark.createDataFrame([], "item_id long, text string")
    assert tokens.read_store(tokens.write_store(none, scratch.path(spark, "store"))).count() == 0
    for df in (substrings.deduplicated(none), suffixes.repeated_bytes(none), decontaminate.contamination(none, items), neardup.deduplicated(none), packing.pack(none), quality.judge(none), urls.filtered(spark.createDataFrame([], "page_id long, url string"))):
        assert df.count() == 0
    assert chat.read_back(chat.formatted(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0
    some = spark.createDataFrame(corpus()[:9], SCHEMA)
    assert decontaminate.contamination(some, items).where("n_hit > 0").count() == 0


def test_null_and_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(80))
    docs = spark.createDataFrame([(None, text), (4, text), (4, text), (4, "other " * 3), (None, None)], "doc_id long, text string")
    rows = substrings.parsed(docs).select("doc_id", "text", "found").collect()
    assert sorted((r["doc_id"] or -1, bool(r["found"])) for r in rows if r["text"] == text) == [(-1, False), (4, True), (4, True)]
    assert all(r["found"] for r in suffixes.repeated_bytes(docs, 50).collect() if r["text"] == text)
    _, found = neardup.grouped(docs)
    assert found.count() == 5
    assert packing.pack(docs).count() == 5 and tokens.read_store(tokens.write_store(docs, scratch.path(spark, "s"))).count() == 5
