"""Suffix dedup, sharding, near duplicates, packing, mixing and the pipeline against brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from leafmill.llm import common, minhash, mixing, packing, repeats, sharding, simhash
from leafmill.llm import queries as q
from leafmill.llm import wordscan as ws
from leafmill.llm.graph import components

WORD = re.compile("[^\x20\x09-\x0d]+")


def removed_by_hand(texts, length=400):
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("crowd", [repeats.CROWD, 2])
def test_repeats(docs, rows, crowd, monkeypatch):
    monkeypatch.setattr(repeats, "CROWD", crowd)
    small = docs.where("text is null or length(text) < 20000")
    kept = [r for r in rows if len(r[1] or "") < 20000]
    got = collections.Counter(tuple(r)[:5] for r in repeats.remove_repeats(small).collect())
    assert got == collections.Counter((r[0], *w) for r, w in zip(kept, removed_by_hand([r[1] for r in kept]), strict=True))


def test_contexts_of_long_texts(monkeypatch):
    rng = random.Random(12)
    shared = [bytes(rng.choices(b"abcdefgh", k=n)) for n in (400, 900, 1500)]
    filler = lambda: bytes(rng.choices(b"ijklmnop", k=rng.randint(300, 2500)))
    texts = [b"".join(x for s in rng.sample(shared, 3) for x in (filler(), s)) for _ in range(5)] + [b"short", shared[2][:1024]]
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    for place in (23, 10):
        monkeypatch.setattr(repeats, "_PLACE", place)
        anchors, seen = collections.defaultdict(set), collections.Counter()
        for row, begin, number, anchor, _ in zip(*(x.tolist() for x in repeats.contexts(np.frombuffer(b"".join(texts), np.uint8), off, repeats.WHOLE)), strict=True):
            for i in range(begin, begin + number):
                seen[row, i] += 1
                anchors[texts[row][i : i + 400]].add(anchor)
        assert seen == collections.Counter({(row, i): 1 for row, t in enumerate(texts) for i in range(len(t) - 399)})
        assert all(len(a) == 1 for a in anchors.values())


def test_repeats_beyond_eight_mebibytes(spark):
    rng = random.Random(13)
    shared = "".join(rng.choices("abcdefgh", k=1000))
    long = "".join(rng.choices("ijklmnop", k=8_500_000)) + shared + "".join(rng.choices("ijklmnop", k=500_000))
    frame = spark.createDataFrame([(1, long), (2, f"1{shared}2")], "doc_id long, text string")
    want = {1: hashlib.sha256(long.replace(shared, "").encode()).hexdigest(), 2: hashlib.sha256(b"12").hexdigest()}
    got = repeats.remove_repeats(frame).collect()
    assert sorted((r.doc_id, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == [(k, 1000, 1, want[k]) for k in (1, 2)]


def test_transforms_merge():
    rng = random.Random(7)
    line = bytes(rng.choices(b"abcdef ", k=900))
    texts = [line[a : a + rng.randint(400, 660)] for a in (rng.randint(0, 200) for _ in range(9))] + [bytes(rng.choices(b"ab", k=450)), b"c" * 500]
    copies = np.array([1] * 10 + [1])
    seen = collections.Counter(t[i : i + 400] for t in texts for i in range(len(t) - 399))
    want = [[seen[t[i : i + 400]] > 1 for i in range(len(t) - 399)] for t in texts]
    for shard in (1 << 19, 3000, 1000, 500):
        assert [f.tolist() for f in repeats.repeated_windows(texts, copies, repeats.WHOLE, shard)] == want
    assert all(f.all() for f in repeats.repeated_windows([texts[9]], np.array([2]), repeats.WHOLE))


def test_transforms_of_few_even_shards(monkeypatch):
    rng = random.Random(8)
    line = bytes(rng.choices(b"ab", k=3)) * 40 + bytes(rng.choices(b"abcdef ", k=800))
    texts = [line[a : a + n] for n in (256, 257, 383, 384, 385, 416, 512) for a in (rng.randint(0, 300) for _ in range(12))]
    seen = collections.Counter(t[i : i + 256] for t in texts for i in range(len(t) - 255))
    want = [[seen[t[i : i + 256]] > 1 for i in range(len(t) - 255)] for t in texts]
    total, made, plain = sum(map(len, texts)), [], repeats.transform
    monkeypatch.setattr(repeats, "transform", lambda *a: made.append(len(a[0])) or plain(*a))
    for shards in (2, 3, 5, 8):
        made.clear()
        # A little more than whole shards, as buckets are: what is beyond makes no shard of its own.
        shard = (total - 600) // shards
        assert [f.tolist() for f in repeats.repeated_windows(texts, np.ones(len(texts)), repeats.PASSAGE, shard)] == want
        assert len(made) == shards and min(made) > shard // 2


def test_contexts_hash_only_what_they_return(monkeypatch):
    rng = random.Random(9)
    data = np.frombuffer(bytes(rng.choices(b"abcdefgh ", k=100_000)), np.uint8)
    made, plain = [], repeats.ws.range_hash
    monkeypatch.setattr(repeats.ws, "range_hash", lambda sums, starts, ends: made.append(len(starts)) or plain(sums, starts, ends))
    row, *_ = repeats.contexts(data, np.array([0, 40_000, 100_000]), repeats.PASSAGE)
    assert 100 < len(row) < 5000 and sum(made) == 2 * len(row)


def test_hashes_of_places(monkeypatch):
    rng = random.Random(10)
    monkeypatch.setattr(repeats, "_STEP", 64)
    raw = bytes(rng.choices(b"\0\1", k=500)) + bytes(300) + b"\0\1" * 100
    for of in (repeats.choosing_hash, repeats.place_hash):
        for width in (5, 96):
            found = of(np.frombuffer(raw, np.uint8), width).tolist()
            pairs = set(zip((raw[i : i + width] for i in range(len(raw) - width + 1)), found, strict=True))
            assert len(found) == len(raw) - width + 1 and len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})
    # Different hashes with equal upper bits are different numbers.
    hashes = np.array([5, 3, 5, 1 << 61, 3, 4, 1 << 61], np.uint64)
    order, number = repeats.numbered(hashes)
    assert order.tolist() == [1, 4, 5, 0, 2, 3, 6] and number.tolist() == [1, 1, 2, 3, 3, 4, 4]


def test_planted_passages(spark):
    rng = random.Random(21)
    word = lambda: "".join(rng.choices("abcdefghiklmnoprstu", k=rng.randint(2, 9)))
    prose = lambda n: [word() for _ in range(n)]
    planted = [prose(rng.randint(51, 80)) for _ in range(10)]
    rows, holders = [], set()
    for i in range(120):
        text = prose(rng.randint(60, 200))
        if i % 3 == 0:
            at = rng.randrange(len(text))
            text[at:at] = planted[rng.randrange(10)]
            holders.add(i)
        rows.append((i, " ".join(text)))
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    wanted = removed_by_hand([t for _, t in rows])
    assert [tuple(r)[1:5] for r in sorted(got, key=lambda r: r.doc_id)] == wanted
    grams = collections.Counter(g for _, t in rows for g in {tuple(t.split()[k : k + 50]) for k in range(len(t.split()) - 49)})
    shared = {i for i, t in rows if any(grams[tuple(t.split()[k : k + 50])] > 1 for k in range(len(t.split()) - 49))}
    assert {r.doc_id for r in got if r.n_passages} == shared <= holders


def jump_by_hand(key, n):
    key, b, j = key & (2**64 - 1), -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & (2**64 - 1)
        j = int((b + 1) * (2.0**31 / ((key >> 33) + 1)))
    return b


def test_sharding(spark, docs, rows):
    got = sharding.shard(docs).collect()
    assert len(got) == len(rows)
    slots = collections.defaultdict(list)
    for r in got:
        assert r.law == "key" and r.shard == jump_by_hand(r.doc_id or 0, 40) and r.grown_shard in (r.shard, 40)
        assert r.grown_shard == jump_by_hand(r.doc_id or 0, 41)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == collections.Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows)
    keys = [-5, -(2**63), 2**63 - 1, 0, 1, 10**12]
    frame = spark.createDataFrame([(k,) for k in keys], "doc_id long")
    assert [r.s for r in frame.select(sharding.jump("doc_id", 1000).alias("s")).collect()] == [jump_by_hand(k, 1000) for k in keys]


def print_by_hand(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(text)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots_by_hand(prints, tau=2):
    prints = sorted(set(prints))
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= tau:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {p: find(p) for p in prints}


@pytest.mark.parametrize("bucket", [simhash.BUCKET, 1])
def test_near_duplicates(docs, rows, bucket, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    prints = [print_by_hand(r[1]) for r in rows]
    root = roots_by_hand(prints)
    least = {}
    for r, p in zip(rows, prints, strict=True):
        if r[0] is not None:
            least[root[p]] = min(least.get(root[p], r[0]), r[0])
    got = collections.Counter((r.doc_id, f"{r.fp & (2**64 - 1):016x}", r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == collections.Counter((r[0], f"{p:016x}", least.get(root[p])) for r, p in zip(rows, prints, strict=True))


@pytest.mark.parametrize("bucket", [simhash.BUCKET, 3])
def test_links_of_close_prints(spark, bucket, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = random.Random(8)
    prints = {rng.getrandbits(64) for _ in range(300)}
    for p in list(prints)[:60]:
        for _ in range(4):
            prints.add(p ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 3))))
    signed = np.array(sorted(prints), np.uint64)
    nodes = spark.createDataFrame([(int(p),) for p in signed.view(np.int64)], "fp long")
    for chosen in (simhash.plan(signed[:200], len(prints)), [(list(range(32)), 1), (list(range(32, 64)), 0)], [(list(range(64)), 2)] if bucket == 3 else [(list(range(0, 64, 2)), 0), (list(range(1, 64, 2)), 1)]):
        assert sum(t + 1 for _, t in chosen) == 3
        found = {r.node & (2**64 - 1): r.root & (2**64 - 1) for r in components(simhash.links(nodes, chosen)).collect()}
        want = roots_by_hand(prints)
        groups = collections.defaultdict(set)
        for p in prints:
            groups[found.get(p, p)].add(p)
        expected = collections.defaultdict(set)
        for p in prints:
            expected[want[p]].add(p)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_keep_first(docs, rows):
    out = simhash.keep_first(docs)
    assert out.schema == docs.schema
    classes = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    kept = [r.doc_id for r in out.collect() if r.doc_id is not None]
    assert sorted(kept) == sorted({c for d, c in classes if d is not None and d == c})
    assert sum(r.doc_id is None for r in out.collect()) == 2


def grams_by_hand(text, k=5):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(" ".join(w[i : i + k]) for i in range(len(w) - k + 1)) or frozenset([" ".join(w)] if w else [])


def classes_by_hand(rows):
    """The component_id of each row (doc_id, text) by all pairs of 5-word shingle sets, and the links' similarities."""
    grams = [grams_by_hand(r[1]) for r in rows]
    root, links = list(range(len(rows))), []

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(grams):
        for j in range(i):
            b = grams[j]
            if a == b or (a and b and min(len(a), len(b)) / max(len(a), len(b)) >= 0.8 and len(a & b) / len(a | b) >= 0.8):
                links.append(len(a & b) / len(a | b) if a else 1.0)
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return [least.get(find(i)) for i in range(len(rows))], links


def edited_copies():
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefghiklmnoprst", k=rng.randint(3, 8))) for _ in range(3000)]
    texts = []
    for _ in range(60):
        base = [rng.choice(words) for _ in range(rng.randint(60, 400))]
        texts.append(" ".join(base))
        for _ in range(3):
            w = list(base)
            for _ in range(rng.randint(1, max(1, len(w) // 40))):
                w[rng.randrange(len(w))] = rng.choice(words)
            texts.append(" ".join(w).upper())
    return list(enumerate(texts))


def test_stage_links_edited_copies(spark, docs, rows):
    copies = edited_copies()
    want, links = classes_by_hand(copies)
    assert sum(s < 0.9 for s in links) > 20
    frame = spark.createDataFrame([(*r, "en", "s0", len(r[1])) for r in copies], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_dedup(spark, frame, "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want))
    want, _ = classes_by_hand(rows)
    got = collections.Counter(tuple(r) for r in minhash.near_duplicates(docs).collect())
    assert got == collections.Counter((r[0], c) for r, c in zip(rows, want, strict=True))


def test_stage_meets_by_simhash(spark, monkeypatch):
    copies = edited_copies()
    sets = [minhash.sets(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0] for _, t in copies]
    begin = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    prints = simhash.weighted_fingerprints(np.concatenate(sets), begin)
    # By hand: the sign of each bit's weighted sum, in any order and in slices.
    low = (1 << 64) - 1
    for row in (0, 5):
        for k in (0, 7, simhash.TABLES - 1):
            sums = [0] * 64
            for h in map(int, sets[row]):
                weight = 2**32 // ((((h ^ int(simhash._SALTS[1 + k])) * int(simhash._FACTORS[k]) & low) >> 32) + 1)
                signs = int(ws.mix(np.array([h], np.uint64) ^ simhash._SALTS[0])[0])
                sums = [s + (weight if signs >> b & 1 else -weight) for b, s in enumerate(sums)]
            assert int(prints[row, k]) == sum(1 << b for b, s in enumerate(sums) if s > 0) ^ int(simhash._SALTS[simhash.TABLES + 1 + k])
    monkeypatch.setattr(simhash, "SLICE", 61)
    assert (simhash.weighted_fingerprints(np.concatenate([s[::-1] for s in sets]), begin) == prints).all()
    # All links are within the distance in some table, and the stage has its candidates from the links of the tables.
    grams = [grams_by_hand(t) for _, t in copies]
    close = [(i, j) for i in range(len(grams)) for j in range(i) if len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j])]
    assert len(close) > 100 and all((np.bitwise_count(prints[i] ^ prints[j]) <= simhash.TAU).any() for i, j in close)
    linked, link = [], simhash.links

    def noted(nodes, chosen):
        linked.append((nodes.count(), sum(t + 1 for _, t in chosen)))
        return link(nodes, chosen)

    monkeypatch.setattr(simhash, "links", noted)
    want, _ = classes_by_hand(copies)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(copies, "doc_id long, text string")).collect()}
    assert got == dict(enumerate(want)) and linked == [(len(np.unique(prints)), simhash.TAU + 1)]


def one_edited_group():
    """Copies of one text, edited so that many pairs lie on either side of the similarity, with lasting sub-families."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    families = [list(base) for _ in range(8)]
    for f, w in enumerate(families):
        for k in rng.sample(range(150), 2 + f // 2):
            w[k] = f"f{f}"
    texts = []
    for _ in range(240):
        w = list(rng.choice(families))
        for k in rng.sample(range(len(w)), rng.randint(0, 4)):
            w[k] = f"e{rng.randrange(40)}"
        texts.append(" ".join(w[rng.randint(0, 6) : 150 - rng.randint(0, 6)]))
    return list(enumerate(texts))


def test_links_of_one_edited_group(spark, monkeypatch):
    sizes, write = collections.defaultdict(list), minhash.materialize

    def counted(df, name):
        out = write(df, name)
        sizes[name].append(out.count())
        return out

    monkeypatch.setattr(minhash, "materialize", counted)
    copies = one_edited_group()
    want, links = classes_by_hand(copies)
    assert 1 < len(set(want)) < 200
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(copies, "doc_id long, text string")).collect()}
    assert got == dict(zip(range(len(copies)), want, strict=True))
    # First stars, hubs, and what lies outside a hub's component all had work.
    assert sizes["near"][0] and sizes["near"][1] and sizes["pairs"][0]


def test_edited_copies_form_no_pairs(spark, monkeypatch):
    sizes, write = collections.defaultdict(list), minhash.materialize

    def counted(df, name):
        out = write(df, name)
        sizes[name].append(out.count())
        return out

    monkeypatch.setattr(minhash, "materialize", counted)
    # Copies of one text with edits of few kinds: no shingle is a copy's own, and those with many edits link to none.
    rng = random.Random(31)
    base = [f"w{k}" for k in range(150)]
    edits = [0] * 5 + [1] * 10 + [2] * 10 + [6] * 120
    texts = []
    for e in edits:
        w = list(base)
        for k in rng.sample(range(0, 150, 5), e):
            w[k] = f"e{k}-{rng.randrange(4)}"
        texts.append(" ".join(w))
    copies = list(enumerate(texts))
    want, _ = classes_by_hand(copies)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(copies, "doc_id long, text string")).collect()}
    assert got == dict(zip(range(len(copies)), want, strict=True)) and len(set(want)) > 60
    assert sizes["within"][0] > 100 and sizes["pairs"][0] < 1000


def test_stage_links_nothing(nothing):
    assert minhash.near_duplicates(nothing).count() == 0


def test_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(200)] + [(500 + rng.randint(0, 60), 500 + rng.randint(0, 60)) for _ in range(40)] + [(900, i) for i in range(901, 980)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_packing(docs, rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.vocabulary_path())
    got = packing.pack(docs).collect()
    want = collections.Counter()
    for r in rows:
        ids = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            some = np.array(ids[k : k + 2048], "<u4")
            want[(r[0], k // 2048, k, len(some), zlib.crc32(some.tobytes()))] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    full = collections.defaultdict(list)
    for r in got:
        full[r.sequence_id].append((r.offset, r.length))
    for places in full.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(full) <= 1 + -(-sum(r.length for r in got) // 2048)


def one_by_one(counts, capacity):
    free = []
    for length in sorted(counts.elements(), reverse=True):
        fits = [g for g in free if g >= length]
        if fits:
            free.remove(min(fits))
            free.append(min(fits) - length)
        else:
            free.append(capacity - length)
    return len(free)


def test_rounds_against_one_by_one():
    for seed, capacity, n in [(0, 10, 300), (1, 50, 200), (2, 2048, 120), (3, 2048, 1), (4, 2048, 0), *((k, 64 << k % 6, 37 * k) for k in range(5, 60))]:
        rng = random.Random(seed)
        counts = collections.Counter(rng.randint(1, capacity) for _ in range(n))
        ranks, places = collections.defaultdict(list), collections.defaultdict(list)
        for length, rank, number, each, first, offset in packing.rounds(dict(counts), capacity):
            for k in range(number):
                ranks[length].append(rank + k)
                places[first + k // each].append((offset + k % each * length, length))
        assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(v)) for k, v in counts.items()}
        for some in places.values():
            ends = [0, *(offset + length for offset, length in sorted(some))]
            assert [offset for offset, _ in sorted(some)] == ends[:-1] and ends[-1] <= capacity
        assert len(places) <= 1.03 * one_by_one(counts, capacity) + 1


def test_rounds_resolve_conflicts():
    # Both lengths want the gaps of 7: the longer pieces get them, of the rest one goes to the gap of 9, two wait.
    placed, after = packing.sweep({7: (0, 2), 6: (0, 3)}, [(7, 10, 2), (9, 20, 1)])
    assert sorted(placed) == [(6, 0, 1, 1, 20, 9), (7, 0, 2, 1, 10, 7)] and after == [(3, 20, 1)]


def test_long_texts_in_windows(spark, monkeypatch):
    rng = random.Random(31)
    text = " ".join("".join(rng.choices("abcdeÉ.,", k=rng.randint(1, 9))) for _ in range(4000))
    frame = spark.createDataFrame([(1, text), (2, "a b"), (3, "x" * 9000)], "doc_id long, text string")
    raw = text.encode()
    whole = simhash.fingerprints(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    want = sorted(tuple(r) for r in packing.cut(frame, packing.vocabulary_path()).collect())
    plain = ws.word_windows
    monkeypatch.setattr(simhash, "LONG", 0)
    monkeypatch.setattr(ws, "word_windows", lambda data, overlap=0: plain(data, overlap, 500))
    assert simhash.fingerprints(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])) == whole
    from tokenizers import Tokenizer

    tokens, bare = packing.WordTokens(packing.vocabulary_path()), Tokenizer.from_file(packing.vocabulary_path())
    parts = [tokens.encode(x, np.array([0, len(x)]))[0] for x in ws.word_windows(np.frombuffer(raw, np.uint8))]
    assert len(parts) > 20 and np.concatenate(parts).tolist() == bare.encode(text, add_special_tokens=False).ids
    assert sum(r[3] for r in want if r[0] == 1) == len(np.concatenate(parts)) + 1


def thue_morse(n):
    a, b = "a", "b"
    while len(a) < n:
        a, b = a + b, b + a
    return a, b


def test_words_that_collide_modulo_powers_of_two():
    a, b = thue_morse(2048)
    from tokenizers import Tokenizer

    tokens, bare = packing.WordTokens(packing.vocabulary_path()), Tokenizer.from_file(packing.vocabulary_path())
    raw = f"{a} {b}".encode()
    assert tokens.encode(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0].tolist() == bare.encode(raw.decode(), add_special_tokens=False).ids
    data = np.frombuffer((a + b + a).encode(), np.uint8)
    h = ws.range_hash(ws.prefix_hash(data), np.array([0, 2048, 4096]), np.array([2048, 4096, 6144]))
    assert h[0] == h[2] != h[1]


def test_word_tokens_without_room():
    import pyarrow as pa

    from leafmill.llm import wordscan as ws

    texts = ["a'. b'S. 'S, é., É!! ñ; ×. a×, x'- don't- 's- <|ENDOFTEXT|> <|", "...", None, "K. K, İ. ß; STRASSE", "plain words here, and here."]
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.vocabulary_path())
    for room in (1 << 20, 3):
        tokens = packing.WordTokens(packing.vocabulary_path(), room)
        for some in (texts, texts[::-1], texts[3:]):
            ids, first = tokens.encode(*ws.buffers(pa.array(some)))
            assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)] == [plain.encode(t or "", add_special_tokens=False).ids for t in some]


def targets_by_hand(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        rest = total - sum(capped.values())
        free = [s for s in names if s not in capped]
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return {**capped, **share}
        capped |= {s: 3.0 * sizes[s] for s in over}


def test_mixing(docs, rows):
    got = mixing.mix_digest(docs).collect()
    again = mixing.mix_digest(docs.repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    want = targets_by_hand(sizes)
    source = {r[0]: r[3] for r in rows if r[0] is not None}
    taken = collections.Counter()
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        if r.doc_id is not None:
            assert r.source_size == sizes[source[r.doc_id]] and abs(r.target - want[source[r.doc_id]]) < 1e-6
            taken[source[r.doc_id]] += r.taken
    for s in ("s0", "s2", "s3", "s4"):
        assert abs(taken[s] - want[s]) <= 1


def test_digest_is_in_training_order(spark, docs, rows):
    for frame in (docs, docs.repartition(5)):
        out = mixing.mix_digest(frame)
        places = [r.position for r in out.collect()]
        taken = [p for p in places if p is not None]
        assert taken == sorted(taken) and len(set(taken)) > 50 and set(places[len(taken) :]) == {None} and len(places) == len(rows)
    # What the digest says is what the copies of each row come to, and where the first of them stands.
    frame = spark.createDataFrame([(i, f"s{i % 3}", " w" * (1 + i % 50 * (i % 3 == 0))) for i in range(600)], "doc_id long, source string, text string")
    words, first = collections.Counter(), {}
    for r in mixing.copies(mixing.schedule(frame.select("doc_id", "source", mixing.n_words().alias("size")))).collect():
        words[r.doc_id] += r.words
        first[r.doc_id] = min(first.get(r.doc_id, 1), r.position)
    got = mixing.mix_digest(frame).collect()
    assert max(r.taken / r.size for r in got) > 1
    assert {r.doc_id: (r.taken, r.position) for r in got} == {i: (words[i], first.get(i)) for i in range(600)}


def test_targets_cap(spark):
    for sizes in ({"a": 1000, "b": 10, "c": 10, None: 5}, {"a": 0, "b": 0}, {"z": 7}, {chr(97 + i): (i * 37) % 50 for i in range(9)}):
        frame = spark.createDataFrame(list(sizes.items()), "source string, size long")
        got = {r.source: r.target for r in mixing.targets(frame).collect()}
        want = targets_by_hand(sizes)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_mixed_documents(docs, rows):
    out = mixing.mix_documents(docs)
    assert out.schema.names == docs.schema.names
    words = collections.Counter()
    for r in out.collect():
        words[r.doc_id] += len(WORD.findall(r.text))
        assert r.n_chars == len(r.text) or r.doc_id is None
    want = collections.Counter()
    for r in mixing.mix_digest(docs).collect():
        want[r.doc_id] += r.taken
    assert +words == +want


def test_mixed_files_are_not_written_again(spark, docs, rows, tmp_path, monkeypatch):
    written, write = [], common.materialize

    def noted(df, name):
        written.append((name, "text" in df.columns))
        return write(df, name)

    for module in (common, mixing):
        monkeypatch.setattr(module, "materialize", noted)
    want = collections.Counter(map(str, mixing.mix_documents(docs).collect()))
    assert ("rows", True) in written
    written.clear()
    # Rows that are all alike, in folders of files with equal names, are still rows of their own.
    for k, part in enumerate(docs.randomSplit([1.0, 1.0], 3)):
        part.coalesce(1).write.parquet(f"{tmp_path}/part={k}")
    for k in (0, 1):
        (found,) = (tmp_path / f"part={k}").glob("*.parquet")
        found.rename(found.with_name("rows.parquet"))
        (found.with_name(f".{found.name}.crc")).unlink()
    files = spark.read.schema(docs.schema).parquet(*[f"{tmp_path}/part={k}" for k in (0, 1)])
    got = mixing.mix_documents(files)
    assert got.columns == docs.columns and collections.Counter(map(str, got.collect())) == want
    assert written and not any(text for _, text in written)


def test_positions_follow_schedules(spark):
    rows = [(i, f"s{i % 3}", 10) for i in range(3000)]
    sized = spark.createDataFrame(rows, "doc_id long, source string, size long")
    placed = mixing.copies(mixing.schedule(sized)).collect()
    mean = {s: np.mean([r.position for r in placed if r.source == s]) for s in ("s0", "s1", "s2")}
    assert all(0 <= r.position <= 1 for r in placed)
    # s0 is early, s1 level, s2 late; their means under the linear schedules are 0.5 - tilt / 6.
    for s, tilt in (("s0", 0.5), ("s1", 0.0), ("s2", -0.5)):
        assert abs(mean[s] - (0.5 - tilt / 6)) < 0.02


def test_empty(nothing, spark):
    for f in (repeats.remove_repeats, sharding.shard, simhash.near_duplicates, simhash.keep_first, packing.pack, mixing.mix_digest, mixing.mix_documents):
        assert f(nothing).count() == 0


def test_pipeline(spark, folder, rows):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "mask_secrets", "mix_sources", "pack"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, seen, folder)
        if name != "pack":
            assert out.columns == docs.columns
            out = spark.createDataFrame(out.collect(), out.schema)
            assert 0 < out.count()
        seen = out
    whole = corpus_pipeline.run(spark, folder).collect()
    assert collections.Counter((r.doc_id, r.piece, r.length) for r in whole) == collections.Counter((r.doc_id, r.piece, r.length) for r in seen.collect())


def test_pipeline_of_nothing(spark, folder, tmp_path):
    path = str(tmp_path)
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").limit(0).write.parquet(f"{path}/labels.parquet")
    assert corpus_pipeline.run(spark, path).count() == 0


def test_queries_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in q.queries()) == list(range(1, 11))
