"""Operators on documents against brute force, on awkward rows and on the small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from loomspark.llm import audio, licenses, mixing, packing, quality, rules, sharding, simhash
from tests.llm import tables

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)


@pytest.fixture(scope="module", params=["awkward", "sf0.01"])
def docs(request, spark):
    if request.param == "awkward":
        return tables.docs(spark).cache()
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


def by_row(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def texts(docs):
    return [(r["doc_id"], r["text"] or "", r["source"]) for r in docs.collect()]


def test_license_phrases(docs):
    def base(i, t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        at, names = [], set()
        for phrase, name in licenses.BASE:
            p = phrase.split()
            for k in range(len(w)):
                if w[k : k + len(p)] == p:
                    at.append(k)
                    names.add(name)
        return i, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(names))

    got = licenses.scan_licenses(docs)
    assert by_row(got, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == Counter(base(i, t) for i, t, _ in texts(docs))
    for r in got.collect():
        assert 0 <= r["score"] <= 1
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert r["labels"] == ",".join(sorted(set(filter(None, r["labels"].split(",")))))


def test_license_rules_suppress_what_they_contain(spark):
    cases = {
        "Licensed under the Apache License, Version 2.0.": "apache-2.0",
        "Released under the MIT License.": "mit",
        "SPDX-License-Identifier: GPL-3.0-only": "gpl-3.0",
        "under CC BY-NC 4.0.": "cc-by-nc-4.0",
        "Apache License here; later the Apache License, Version 2.0": "apache,apache-2.0",
        "nothing here, mit dem": "",
    }
    df = spark.createDataFrame([(k, t) for k, t in enumerate(cases)], "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in licenses.scan_licenses(df).collect()}
    for k, (text, want) in enumerate(cases.items()):
        assert set(got[k].split(",")) - {"cc-by"} == set(want.split(",")), text


def brute_detections(norm):
    """Rule by rule, all intervals; then each against each."""
    found = []
    if any(a in norm for a in licenses.ANCHORS):
        for r in licenses.signature_rules():
            if r["keyword"] in norm:
                found += [(m.start(), m.end(), r["class"], r["no"], r["label"]) for m in re.finditer(r["regex"], norm)]
    def inside(d, e):
        if e is d or not (e[0] <= d[0] and d[1] <= e[1]):
            return False
        return e[2] < d[2] or e[2] == d[2] and ((e[0], e[1]) != (d[0], d[1]) or e[3] < d[3])
    return {d[4] for d in found if not any(inside(d, e) for e in found)}


def test_license_labels_equal_brute_force(docs):
    want = Counter()
    for i, t, _ in texts(docs):
        norm = " " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))) + " "
        base = {name for phrase, name in licenses.BASE if f" {phrase} " in norm}
        want[i, ",".join(sorted(base | brute_detections(norm)))] += 1
    assert by_row(licenses.scan_licenses(docs), "doc_id", "labels") == want


def test_license_rules_are_sound():
    found = licenses.signature_rules()
    assert len(found) >= 600
    written = [x for lines in (licenses.TEXTS, licenses.NOTICES) for x in lines.strip().splitlines()]
    names = [n for line in licenses.LICENSES.strip().splitlines() for n in line.split("|", 2)[2].split(";")]
    assert len(written) + len(names) >= 300 and len({r["regex"] for r in found}) >= 600
    for r in found:
        re.compile(r["regex"])
        assert r["keyword"]


def spelt(pattern):
    """All texts that a regex of groups, classes and optional parts matches, one for each repeat."""
    import itertools
    from re import _constants as C
    from re import _parser

    def of(tree):
        parts = []
        for op, arg in tree:
            if op is C.LITERAL:
                parts.append([chr(arg)])
            elif op is C.NOT_LITERAL:
                parts.append(["x"])
            elif op is C.IN:
                parts.append([chr(a) if o is C.LITERAL else {C.CATEGORY_DIGIT: "7", C.CATEGORY_NOT_SPACE: "x"}[a] for o, a in arg])
            elif op is C.MAX_REPEAT:
                low, high, inner = arg
                parts.append(([""] if low == 0 else []) + of(inner))
            elif op is C.SUBPATTERN:
                parts.append(of(arg[3]))
            elif op is C.BRANCH:
                parts.append([x for b in arg[1] for x in of(b)])
            else:
                assert op is C.ASSERT, op
        return ["".join(x) for x in itertools.product(*parts)]

    return of(_parser.parse(pattern))


def test_license_rules_pass_their_own_gates():
    for r in licenses.signature_rules():
        for text in spelt(r["regex"]):
            assert re.search(r["regex"], f"{text} "), r
            assert r["keyword"] in text, (r, text)
            assert any(a in text for a in licenses.ANCHORS), (r, text)


def test_license_spelt_out_names(spark):
    cases = {
        "Creative Commons Attribution-ShareAlike 4.0 International": "cc-by-sa-4.0",
        "Creative Commons Attribution-NonCommercial 3.0 Unported": "cc-by-nc-3.0",
        "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0": "cc-by-nc-nd-4.0",
        "Creative Commons Attribution-NoDerivs 3.0": "cc-by-nd-3.0",
        "released under the Beerware License": "beerware",
        "under OpenRAIL-M": "openrail",
        "MIT No Attribution": "mit-0",
        "http://creativecommons.org/licenses/by-nc-sa/4.0/": "cc-by-nc-sa-4.0",
        "http://creativecommons.org/publicdomain/zero/1.0/": "cc0-1.0",
        "Redistributions of source code must retain the above copyright notice, this list of conditions": "bsd-2-clause",
        "Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software": "bsd-3-clause",
        "You should have received a copy of the GNU Affero General Public License along with this program.": "agpl,gpl",
        "You may not use this file except in compliance with the License.": "apache-2.0",
        "This is free and unencumbered software released into the public domain.": "unlicense",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": "mpl-2.0",
        "Tous droits réservés": "reserved",
    }
    df = spark.createDataFrame([(k, t) for k, t in enumerate(cases)], "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in licenses.scan_licenses(df).collect()}
    assert [got[k] for k in range(len(cases))] == list(cases.values())


def test_license_labels_equal_ungated_rules(docs):
    """As test_license_labels_equal_brute_force, with neither keywords nor anchors."""
    want = Counter()
    for i, t, _ in texts(docs):
        norm = " " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))) + " "
        found = [(m.start(), m.end(), r["class"], r["no"], r["label"]) for r in licenses.signature_rules() for m in re.finditer(r["regex"], norm)]
        inside = lambda d, e: e is not d and e[0] <= d[0] and d[1] <= e[1] and (e[2] < d[2] or e[2] == d[2] and (e[:2] != d[:2] or e[3] < d[3]))
        base = {name for phrase, name in licenses.BASE if f" {phrase} " in norm}
        want[i, ",".join(sorted(base | {d[4] for d in found if not any(inside(d, e) for e in found)}))] += 1
    assert by_row(licenses.scan_licenses(docs), "doc_id", "labels") == want


def facts(t):
    w = WORD.findall(t)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = bytearray(len(w))
    for i in range(len(w) - 4):
        if grams[tuple(w[i : i + 5])] > 1:
            covered[i : i + 5] = b"\1" * 5
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), sum(covered)


def test_quality_counts(docs):
    got = rules.judge(docs)
    want = Counter((i, *facts(t)) for i, t, _ in texts(docs))
    assert by_row(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words") == want
    for r in got.collect():
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
    want = Counter((i, not rejected(t)) for i, t, _ in texts(docs))
    assert by_row(got, "doc_id", "kept") == want and by_row(rules.judge(docs.repartition(5)), *got.columns) == by_row(got, *got.columns)


def rejected(t):
    w = WORD.findall(t)
    n, chars, symbols, dup, repeated = facts(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    same = sum(a == b for a, b in zip(w, w[1:], strict=False))
    return (
        n < 10 or 100 * repeated > 20 * n or 10 * symbols > 3 * n or 10 * (len(t.split("!!")) - 1) > 3 * n or chars > 20 * n or 2 * chars < 3 * n
        or len(lines) >= 4 and 10 * len(set(lines)) < 5 * len(lines) or 10 * same > 3 * n
    )


def test_cascade_keeps_whole_rows(docs):
    kept = rules.keep_by_rules(docs)
    assert kept.columns == docs.columns
    want = Counter((i, t) for i, t, _ in texts(docs) if not rejected(t))
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == want
    assert Counter((r["doc_id"]) for r in rules.judge(docs).collect() if r["kept"]) == Counter(i for i, _ in want.elements())


def test_cascade_order_is_by_rejection_per_cost(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = rules.order_rules(docs)
    worth = [rate / cost for _, rate, cost in found]
    assert worth == sorted(worth, reverse=True) and len(found) == len(rules.RULES)
    cost = {r.name: c for r, _, c in found}
    assert cost["few_words"] < cost["symbols"] < cost["repeated_windows"]
    # rates are those of the sample, whatever the partitions
    assert {(r.name, rate) for r, rate, _ in found} == {(r.name, rate) for r, rate, _ in rules.order_rules(docs.repartition(7))}


def test_cascade_order_follows_what_is_seen(spark):
    """A costly rule that rejects all goes behind a cheap one that does, and before one that rejects none."""
    from pyspark.sql import functions as F

    slow = lambda f: F.size(F.filter(F.sequence(F.lit(1), F.lit(3000)), lambda x: x * x > 5 * f.n_words())) > 0
    made = (rules.Rule("none", lambda f: f.n_words() < 0), rules.Rule("slow", slow), rules.Rule("cheap", lambda f: f.n_words() >= 0))
    docs = spark.createDataFrame([(k, "some words here " * 20) for k in range(300)], "doc_id long, text string")
    for _ in range(3):
        assert [r.name for r, _, _ in rules.order_rules(docs, made)] == ["cheap", "slow", "none"]
    assert [r.name for r, _, _ in rules.order_rules(docs.limit(0), made)] == ["none", "slow", "cheap"]


def test_packing_round_trip(docs):
    from tokenizers import Tokenizer
    import public_tokenizers

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = packing.pack(docs).collect()
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"], r["doc_tokens"]].append((r["start"], r["length"], r["ids_crc32"]))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    tokens = sum(r["length"] for r in got)
    assert len(sequences) * packing.CAPACITY - tokens < packing.CAPACITY  # one sequence with padding: few tasks
    want = Counter()
    held = {}
    for i, t, _ in texts(docs):
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, packing.END], "<u4")
        want[i, len(ids)] += len(ids)
        held[i, len(ids)] = ids
    assert Counter({k: sum(n for _, n, _ in v) for k, v in pieces.items()}) == want
    for k, v in pieces.items():
        for start, n, crc in v:
            assert zlib.crc32(held[k][start : start + n].tobytes()) == crc


def test_best_fill_equals_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(200):
        counts = [(int(n), int(rng.integers(1, 4))) for n in sorted(set(rng.integers(1, 60, rng.integers(1, 7))), reverse=True)]
        room = int(rng.integers(1, 150))
        sums = {0}
        for n, c in counts:
            sums = {s + n * k for s in sums for k in range(c + 1) if s + n * k <= room}
        used = packing.best_fill(counts, room)
        assert sum(n * k for n, k in used.items()) == max(sums)
        assert all(k <= dict(counts)[n] for n, k in used.items())


def test_equal_lengths_leave_no_padding(spark):
    df = spark.createDataFrame([(k, "word " * 2998) for k in range(40)], "doc_id long, text string").coalesce(1)
    got = packing.pack(df).collect()
    tokens = sum(r["length"] for r in got)
    assert len({r["sequence_id"] for r in got}) == -(-tokens // packing.CAPACITY)


def test_encoder_equals_tokenizer_on_odd_texts():
    encoder = packing.Encoder.of(None)
    rng = np.random.default_rng(3)
    letters = list("ab'sStTdmrvel019 .,!-\n\tÀÉéßÿñ×÷ªµİ\x1c\x85\xa0中_<|>/")
    for _ in range(4000):
        t = "".join(rng.choice(letters, rng.integers(0, 14)))
        want = encoder.tokenizer.encode(t, add_special_tokens=False).ids
        assert encoder.encode(t) == np.array(want, "<u4").tobytes(), repr(t)


def test_encoder_equals_tokenizer_on_added_tokens():
    encoder = packing.Encoder.of(None)
    rng = np.random.default_rng(4)
    added = [t.content for t in encoder.tokenizer.get_added_tokens_decoder().values()]
    assert len(added) == 2
    some = [*added, *[a.upper() for a in added], *[a[:-1] for a in added], *[a[1:] for a in added], " ", "\n", "word", "É", "中", "'s", "<", "|", ">", "İ", "12"]
    for _ in range(4000):
        t = "".join(rng.choice(some, rng.integers(0, 9)))
        want = encoder.tokenizer.encode(t, add_special_tokens=False).ids
        assert encoder.encode(t) == np.array(want, "<u4").tobytes(), repr(t)


def test_added_tokens_are_packed_as_the_tokenizer_gives_them(spark):
    texts = ["hello <|endoftext|> world", "<|startoftext|>" * 3, "a<|endoftext|>b" * 2000, "É<|endoftext|>中"]
    tokenizer = packing.Encoder.of(None).tokenizer
    got = Counter()
    for r in packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        got[r["doc_id"], r["doc_tokens"]] += r["length"]
    ids = [[*tokenizer.encode(t, add_special_tokens=False).ids, packing.END] for t in texts]
    assert got == Counter({(k, len(x)): len(x) for k, x in enumerate(ids)})


def test_shards(docs):
    got = sharding.shard_by_bytes(docs).collect()
    want = Counter((i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t, _ in texts(docs))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    slots, sizes = defaultdict(list), Counter()
    for r in got:
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 8
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    largest, total = max(r["size"] for r in got), sum(sizes.values())
    if largest < total / 80:
        assert all(abs(sizes[k] - total / 8) <= total / 800 + 2 * largest for k in range(8))


def test_small_groups_of_copies_stay_whole(spark):
    df = spark.createDataFrame([(k, f"text {k // 3} " * 20) for k in range(6000)], "doc_id long, text string")
    got = sharding.shard_by_bytes(df).collect()
    where = defaultdict(set)
    for r in got:
        where[r["text_crc32"]].add(r["shard"])
    assert all(len(s) == 1 for s in where.values())


def fingerprint(t):
    w = WORD.findall(lower(t))
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]).encode(), 42) for k in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_classes(docs):
    rows = [(i, fingerprint(t if len(t) < 10**6 else t[:0] + t)) for i, t, _ in texts(docs)]
    fp = np.array([f for _, f in rows], np.uint64)
    label = np.arange(len(rows))
    for k in range(len(rows)):
        near = np.nonzero(np.bitwise_count(fp ^ fp[k]) <= 3)[0]
        simhash.merge(label, np.full(len(near), k), near)
    smallest = {}
    for (i, _), c in zip(rows, label, strict=True):
        if i is not None:
            smallest[c] = min(smallest.get(c, i), i)
    want = Counter((i, f"{f:016x}", smallest.get(c)) for (i, f), c in zip(rows, label, strict=True))
    assert by_row(simhash.component_ids(docs), "doc_id", "fingerprint", "component_id") == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(set(label))


def test_trees_lose_no_link(spark):
    rng = np.random.default_rng(1)
    some = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    near = some[:1000].copy()
    for _ in range(3):
        near ^= np.uint64(1) << rng.integers(0, 64, 1000, dtype=np.uint64)
    chain = [some[0]]
    for b in range(40):
        chain.append(chain[-1] ^ np.uint64(1 << b))
    fp = np.unique(np.concatenate((some, near, np.array(chain, np.uint64))))
    label = np.arange(len(fp))
    for k in range(0, len(fp), 200):
        a, b = np.nonzero(np.bitwise_count(fp[k : k + 200, None] ^ fp[None, :]) <= 3)
        simhash.merge(label, a + k, b)
    df = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long")
    from loomspark.llm.components import components

    # leaves and cells small enough that many of each are in use
    old = simhash.LEAF, simhash.CELL, simhash.TINY
    simhash.LEAF, simhash.CELL, simhash.TINY = 64, 50, 8
    try:
        roots = {r["node"]: r["root"] for r in components(simhash.links(df, len(fp))).collect()}
    finally:
        simhash.LEAF, simhash.CELL, simhash.TINY = old
    ours = defaultdict(set)
    for x in fp.view(np.int64).tolist():
        ours[roots.get(x, x)].add(x)
    brute = defaultdict(set)
    for x, c in zip(fp.view(np.int64).tolist(), label, strict=True):
        brute[c].add(x)
    assert {frozenset(s) for s in ours.values()} == {frozenset(s) for s in brute.values()}


@pytest.mark.parametrize("edges", [
    [], [(5, 5)], [(3, 1), (1, 3), (3, 1)], [(k, k + 1) for k in range(200)], [(0, k) for k in range(1, 300)], [(k, 1000 - k) for k in range(100)] + [(-5, 7), (7, -9)],
    [(k * 7919 % 500, k * 104729 % 500) for k in range(400)],
])
def test_components_equal_plain_propagation(spark, edges):
    from loomspark.llm.components import components

    root = {x: x for e in edges for x in e if e[0] != e[1]}
    changed = True
    while changed:
        changed = False
        for u, v in edges:
            if u != v and root[u] != root[v]:
                root[u] = root[v] = min(root[u], root[v])
                changed = True
    got = [(r["node"], r["root"]) for r in components(spark.createDataFrame(edges, "u long, v long")).collect()]
    assert len(got) == len(set(got)) and dict(got) == root


def waterfill(sizes):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be")) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, fixed, free = sum(sizes.values()), {}, set(order)
    while True:
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return fixed | share
        fixed |= {s: 3 * sizes[s] for s in over}
        free -= over


def brute_copies(sizes, target, start, fold):
    """One document after another, longest first; `fold` of them settled in turn, the rest at one rate."""
    left, size, total, out = target, sum(sizes), start, []
    for k, s in enumerate(sizes):
        if k < fold:
            e = 0.0
            if s > 0:
                e = min(left / size, float(np.floor(left / s)))
                e = min(3.0, max(0.0, float(np.ceil((left - 3 * (size - s)) / s)), e))
            n = int(np.floor(total + e)) - int(np.floor(total))
            out.append(n)
            left, size, total = left - n * s, size - s, total + e
        else:
            e = max(0.0, min(3.0, left / size)) if size > 0 else 0.0
            at = k - fold
            out.append(int(np.floor((at + 1) * e + total)) - int(np.floor(at * e + total)))
    return out


@pytest.mark.parametrize("fold", [mixing.FOLD, 7, 1])
def test_mix(docs, fold):
    rows = [(i, len(WORD.findall(t)), s) for i, t, s in texts(docs)]
    sizes, by = Counter(), defaultdict(list)
    for i, n, s in rows:
        sizes[s] += n
        by[s].append((-n, i is None, -(i or 0)))
    targets = waterfill(sizes)
    got = mixing.mix(docs, fold=fold).collect()
    assert Counter((r["doc_id"], r["size"], r["source"]) for r in got) == Counter(rows)
    taken, ours = Counter(), Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - targets[r["source"]]) < 1e-6 * max(1, r["target"])
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        ours[r["source"], r["doc_id"], r["size"]] += r["copies"]
    want = Counter()
    for s, own in by.items():
        own.sort()
        start = int(hashlib.md5(f"17:{'n' if s is None else 's' + s}".encode()).hexdigest()[:8], 16) / 2**32
        target = next(r["target"] for r in got if r["source"] == s)
        for (n, none, i), c in zip(own, brute_copies([-n for n, _, _ in own], target, start, fold)):
            want[s, None if none else -i, -n] += c
        others = [-n for n, _, _ in own[fold:]]
        assert abs(taken[s] - targets[s]) <= max([0.05 * targets[s], *others, 1 if len(own) > 7 else -own[0][0]])
    assert ours == want
    again = mixing.mix(docs.repartition(5), fold=fold).collect()
    assert Counter((r["doc_id"], r["size"], r["taken"]) for r in again) == Counter((r["doc_id"], r["size"], r["taken"]) for r in got)


def test_many_sources_and_one_with_a_third_of_all_rows(spark):
    rows = [(k, "word " * (1 + k * k % 90), "hot" if k % 3 == 0 else f"s{k % 400:03d}") for k in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    targets, sizes = {}, Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    targets = waterfill(sizes)
    taken = Counter()
    for r in mixing.mix(df).collect():
        taken[r["source"]] += r["taken"]
        assert abs(r["target"] - targets[r["source"]]) < 1e-6 * r["target"]
    assert all(abs(taken[s] - t) <= 90 for s, t in targets.items())


def test_repeated_rows_share_their_copies(spark):
    df = spark.createDataFrame([(1, "a b c", "x", k) for k in range(5)] + [(2, "a b c", "x", 0), (None, "d", "y", 1), (None, "d", "y", 2)], "doc_id long, text string, source string, other int")
    want = Counter()
    for r in mixing.mix(df).collect():
        want[r["doc_id"], r["source"]] += r["copies"]
    got = Counter((r["doc_id"], r["source"], r["other"]) for r in mixing.take_copies(df).collect())
    assert Counter({k: sum(n for g, n in got.items() if g[:2] == k) for k in want}) == want
    ones = [n for (i, _, _), n in got.items() if i == 1]
    assert max(ones) - min(ones) <= 1 and (len(ones) == 5 or max(ones) == 1)


def test_copies_have_the_rows_columns(docs):
    copies = Counter()
    for r in mixing.mix(docs).collect():
        copies[r["doc_id"]] += r["copies"]
    out = mixing.take_copies(docs)
    assert out.columns == docs.columns
    assert Counter(r["doc_id"] for r in out.collect()) == +copies


def test_audio(docs):
    got = audio.audio_columns(docs).collect()
    assert Counter((r["doc_id"], r["n_bytes"]) for r in got) == Counter((i, len(t.encode())) for i, t, _ in texts(docs))
    held = defaultdict(list)
    for i, t, _ in texts(docs):
        held[i].append(t.encode())
    features = {}
    for r in got:
        samples, rate = audio.load(bytes(r["media"]))
        assert rate == audio.RATE and len(samples) % 192 == 0 and len(samples) > 0
        assert any(samples == t + b" " * (len(samples) - len(t)) and len(samples) - len(t) < 193 for t in held[r["doc_id"]])
        assert features.setdefault(hashlib.sha256(samples).digest(), r["feature"]) == r["feature"]
        found = audio.read_tensors(bytes(r["tensors"]))
        assert found.schema.field("tensor").type.shape == [audio.PATCH, audio.MELS]
        assert found.num_rows == int(r["feature"].split(";")[0])


def naive_log_mel(samples, rate):
    """Frame by frame and band by band, the transform by its sum."""
    x = np.frombuffer(samples, np.uint8)
    n = -(-len(x) * audio.UP // audio.DOWN)
    y = audio.resample(x, 0, n).astype(float)
    top = rate * audio.UP / audio.DOWN
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = [700 * (10 ** (mel(top / 2) * k / (audio.MELS + 1) / 2595) - 1) for k in range(audio.MELS + 2)]
    mels, energy, a = [], [], 0
    while True:
        frame = np.zeros(audio.FRAME)
        part = y[a : a + audio.FRAME]
        frame[: len(part)] = part
        frame *= [0.5 - 0.5 * np.cos(2 * np.pi * t / audio.FRAME) for t in range(audio.FRAME)]
        k = np.arange(audio.FRAME // 2 + 1)
        spectrum = np.exp(-2j * np.pi * np.outer(k, np.arange(audio.FRAME)) / audio.FRAME) @ frame
        row = []
        for m in range(audio.MELS):
            low, mid, high = edges[m : m + 3]
            f = k * top / audio.FRAME
            weight = np.where(f <= mid, (f - low) / (mid - low), (high - f) / (high - mid)).clip(0)
            row.append(np.log10(max(1e-6, float(weight @ np.abs(spectrum) ** 2))))
        mels.append(row)
        energy.append(10 * np.log10(max(1e-9, float((frame**2).mean()))))
        a += audio.HOP
        if a + audio.FRAME - audio.HOP >= n:
            return np.array(mels), np.array(energy)


@pytest.mark.parametrize("text", [b"", b"a", b"The quick brown fox " * 40, bytes(range(256)) * 9, "été straße ".encode() * 77])
def test_log_mel_equals_a_naive_version(text):
    samples = audio.payload_of(text)
    mels, energy = audio.log_mel(samples, audio.RATE)
    want, loud = naive_log_mel(samples, audio.RATE)
    assert mels.shape == want.shape and len(energy) == len(loud)
    assert np.abs(mels / 100 - want).max() < 0.03 and np.abs(energy / 100 - loud).max() < 0.03


def test_log_mel_in_blocks_is_the_same(monkeypatch):
    samples = audio.payload_of(b"The quick brown fox jumps " * 200)
    whole = audio.log_mel(samples, audio.RATE)
    monkeypatch.setattr(audio, "BLOCK", 3)
    parts = audio.log_mel(samples, audio.RATE)
    assert all(np.abs(a.astype(int) - b.astype(int)).max() <= 1 for a, b in zip(whole, parts, strict=True))


def test_tensors_hold_the_frames_and_their_spans():
    mels, energy = audio.log_mel(audio.payload_of(b"some words and then some more " * 60), audio.RATE)
    found = audio.read_tensors(audio.tensors(mels, energy, audio.RATE))
    on = np.zeros(len(mels), int)
    for a, b in audio.active_spans(energy):
        on[a:b] = 1
    ms = 1000 * audio.HOP * audio.DOWN / (audio.RATE * audio.UP)
    values = np.concatenate([c.to_numpy_ndarray() for c in found.column("tensor").chunks])
    for k, r in enumerate(found.drop_columns(["tensor"]).to_pylist()):
        begin = k * audio.PATCH_HOP
        end = min(begin + audio.PATCH, len(mels))
        assert (values[k][: end - begin] == mels[begin:end]).all() and (values[k][end - begin :] == mels[-1]).all()
        assert (r["begin_ms"], r["end_ms"], r["active"]) == (begin * ms, end * ms, on[begin:end].sum())
    assert end == len(mels)


@pytest.mark.parametrize("up,down", [(1, 2), (3, 4), (2, 3), (1, 1)])
def test_resampling_equals_its_definition(up, down):
    x = np.random.default_rng(0).integers(0, 256, 500).astype(np.uint8)
    h, flat = audio.low_pass(up, down, 32), (x.astype(float) - 128) / 128
    n = -(-len(x) * up // down)
    want = [sum(h[m * down % up][t] * flat[m * down // up - t] for t in range(32) if 0 <= m * down // up - t < len(x)) for m in range(n)]
    assert np.allclose(audio.resample(x, 0, n, up, down), want, atol=1e-5)
    parts = [audio.resample(x, k, min(n, k + 7 * up), up, down) for k in range(0, n, 7 * up)]
    assert np.allclose(np.concatenate(parts), want, atol=1e-5)


def test_activity_has_hysteresis():
    energy = np.array([-500, -500, 100, 20, -20, 30, -80, 20, -500, 400, 900], np.int32) + 0
    mean, on, want = energy.mean(), False, []
    for e in energy:
        on = True if e > mean + 50 else False if e < mean - 50 else on
        want.append(on)
    got = np.zeros(len(energy), bool)
    for a, b in audio.active_spans(energy):
        got[a:b] = True
    assert got.tolist() == want


def test_quality_scores(docs, spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(spark.read.parquet(f"{SF}/documents.parquet"), labels)
    got = quality.with_score(docs, model).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _, _ in texts(docs))
    assert all(0 <= r["score"] <= 1 for r in got)
    kept = quality.keep_good(docs, model, 0.2)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r["doc_id"] for r in got if r["score"] >= 0.2)


def test_quality_on_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    scores = {r["doc_id"]: r["score"] for r in quality.with_score(docs, quality.train(docs, labels)).collect()}
    held = [(scores[r["doc_id"]], r["quality"]) for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert sum((s >= 0.5) == (q == 1) for s, q in held) / len(held) >= 0.95
    least = quality.train(docs, labels).least
    assert sum(s < least for s, q in held if q == 0) >= 0.9 * sum(q == 0 for _, q in held)
    assert sum(s < least for s, q in held if q == 1) <= 0.01 * sum(q == 1 for _, q in held)


def naive_score(text, model):
    """The forward pass, window by window and pair by pair."""
    n = max(quality.CHUNK, -(-len(text) // (quality.CHUNK // 2)) * (quality.CHUNK // 2))
    x = list(text) + [0] * (n - len(text))
    hidden = []
    for f in range(quality.FILTERS):
        windows = range(0, n - quality.KERNEL + 1, quality.STRIDE)
        hidden.append(max(sum(float(model.embed[x[a + k]] @ model.byte[k, :, f]) for k in range(quality.KERNEL)) for a in windows) + model.byte_bias[f])
    for p in range(quality.PAIRS):
        unit = [v / np.sqrt(v @ v) for v in model.pair[p].astype(float)]
        y = [0] * quality.REACH + x
        chunks = range(0, n - quality.CHUNK + 1, quality.CHUNK // 2)
        best = max(sum(unit[x[a + t]] @ unit[y[quality.REACH + a + t - back]] for t in range(quality.CHUNK)) for a in chunks for back in range(2, quality.REACH + 1))
        hidden.append(best * quality.GAIN / quality.CHUNK + model.pair_bias[p])
    z = sum(max(0, h) * w for h, w in zip(hidden, model.out, strict=True)) + model.bias[0]
    return 1 / (1 + np.exp(-z))


def test_network_equals_a_naive_forward_pass(monkeypatch):
    monkeypatch.setattr(quality, "BLOCK", 8)  # several blocks a text
    monkeypatch.setattr(quality, "PAIR_BLOCK", 2 * quality.CHUNK)
    model = quality.Model.fresh(1)
    model.pair_bias[:], tables = -1, model.tables()
    rng = np.random.default_rng(2)
    for text in (b"", b"a", b"one two " * 9, bytes(rng.integers(0, 256, 300, dtype=np.uint8)), "straße été ".encode() * 31, b"x" * 64, b"y" * 65):
        assert abs(quality.score(text, model, tables) - naive_score(text, model)) < 1e-4


def test_gradients_are_those_of_the_loss():
    """A step of plain descent along fit's own gradients lowers the loss: seen by training on one batch."""
    texts, labels = [b"the quick brown fox jumps over it " * 4, b"word word word word word word " * 5], [1, 0]
    losses = []
    for epochs in (1, 60):
        old, quality.EPOCHS = quality.EPOCHS, epochs
        try:
            model = quality.fit(texts, labels, (1.0, 1.0))
        finally:
            quality.EPOCHS = old
        t = model.tables()
        losses.append(-sum(np.log(s if y else 1 - s) for s, y in ((quality.score(x, model, t), y) for x, y in zip(texts, labels))))
    assert losses[1] < 0.2 * losses[0]


def test_threshold_loses_few_good_documents():
    assert quality.least_score([]) == 0.5 and quality.least_score([0.9] * 10) == 0.5
    assert quality.least_score([k / 1000 for k in range(1000)], 0.002) == 0.002


def test_repeated_ids_teach_once(spark):
    df = spark.createDataFrame([(k % 4, f"{'good words here' if k % 2 else '!! ## !! ##'} {k}") for k in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 0), (2, 0), (1, 1), (3, 1), (3, 1), (None, 1), (1, None), (99, 0)], "doc_id long, quality int")
    a, b = quality.train(df, labels), quality.train(df.repartition(3), labels)
    assert (a is None) == (b is None) and (a is None or all((x == y).all() for x, y in zip(a.parts(), b.parts(), strict=True)))


def test_held_out_labels_teach_nothing(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    flipped = spark.createDataFrame(
        [(r["doc_id"], 1 - r["quality"] if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 else r["quality"]) for r in labels.collect()], "doc_id long, quality int"
    )
    a, b = quality.train(docs, labels), quality.train(docs, flipped)
    assert all((x == y).all() for x, y in zip(a.parts(), b.parts(), strict=True))


def test_gradient_of_the_network():
    """The step that training takes lowers the loss on what it is trained on."""
    model = quality.fit([b"good words and more of them " * 9, b"!! !! !! !! !! " * 15] * 20, [1, 0] * 20, (1.0, 1.0))
    t = model.tables()
    assert quality.score(b"good words and more of them " * 9, model, t) > 0.9 > 0.1 > quality.score(b"!! !! !! !! !! " * 15, model, t)


def test_no_labels_no_model(spark):
    empty = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.train(tables.docs(spark), empty) is None
    assert {r["score"] for r in quality.with_score(tables.docs(spark), None).collect()} == {0.5}


@pytest.mark.parametrize("make", [
    licenses.scan_licenses, rules.judge, rules.keep_by_rules, packing.pack, sharding.shard_by_bytes, simhash.component_ids, simhash.keep_one,
    mixing.mix, mixing.take_copies, audio.audio_columns, lambda d: quality.with_score(d, None),
])
def test_empty_tables(spark, make):
    assert make(tables.none(spark)).count() == 0
