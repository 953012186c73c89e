"""The pipeline against a brute-force version of every stage on what its predecessor kept."""

import re
from collections import Counter

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

from glossa.llm import quality, tokens  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(t):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


def test_stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns, kept, out = docs.columns, {r["doc_id"]: r["text"] or "" for r in docs.collect()}, docs
    sf = "/root/testdata/sf0.001"
    stages = dict(pipeline.STAGES)
    assert list(stages) == ["quality rules", "near dedup", "substring dedup", "decontamination", "packing"]

    def rows(df):
        return {r["doc_id"]: r["text"] or "" for r in df.collect()}

    out = stages["quality rules"](spark, out, sf)
    rules, want = quality.Rules(), {}
    for d, t in kept.items():
        w = WORD.findall(t)

        def covered(n, w=w):
            c = Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
            return len({j for i in range(len(w) - n + 1) if c[tuple(w[i : i + n])] > 1 for j in range(i, i + n)})

        if len(w) >= 20 and 100 * covered(8) <= 30 * len(w) and covered(rules.min_repeat) <= rules.max_fraction * len(w) and not covered(rules.max_repeat + 1):
            want[d] = t
    assert rows(out) == want and out.columns == columns

    out = stages["near dedup"](spark, out, sf)
    sets = {d: shingles(t) for d, t in want.items()}
    root = {d: d for d in sets}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    want = {d: t for d, t in want.items() if top(d) == d}
    assert rows(out) == want and out.columns == columns

    out = stages["substring dedup"](spark, out, sf)
    first, new = {}, {}
    for d in sorted(want):
        w = WORD.findall(want[d])
        gone = set()
        for i in range(len(w) - 49):
            if first.setdefault(tuple(w[i : i + 50]), d) < d:
                gone |= set(range(i, i + 50))
        left = " ".join(x for j, x in enumerate(w) if j not in gone)
        if not gone:
            new[d] = want[d]
        elif left:
            new[d] = left
    assert rows(out) == new and out.columns == columns
    assert all(r["n_chars"] == len(r["text"]) for r in out.collect())

    out = stages["decontamination"](spark, out, sf)

    def low(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))

    pats = set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = low(r["text"])
        m = min(10, len(w))
        pats |= {tuple(w[i : i + m]) for i in range(len(w) - m + 1)} if m else set()
    sizes = {len(p) for p in pats}
    clean = {d: t for d, t in new.items() if not any(tuple(low(t)[i : i + m]) in pats for m in sizes for i in range(len(low(t)) - m + 1))}
    assert rows(out) == clean and out.columns == columns

    packed = pipeline.run(spark, sf).collect()
    model = tokens.Encoder.of(tokens.default_tokenizer()).model
    assert Counter({d: len(model.encode(t, add_special_tokens=False).ids) + 1 for d, t in clean.items()}) == Counter({d: sum(r["length"] for r in packed if r["doc_id"] == d) for d in clean})
    assert {r["doc_id"] for r in packed} == set(clean)
    filled = Counter()
    for r in packed:
        filled[r["sequence_id"]] += r["length"]
    assert max(filled.values()) <= 1024
