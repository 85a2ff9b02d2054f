"""Classifier, rules, secrets, media and HTML against brute force and round trips."""

import collections
import hashlib
import html
import random
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest

from leafmill.llm import classifier, media, rules, secrets
from leafmill.llm import html as pages
from leafmill.llm import wordscan as ws
from leafmill.llm.common import bounded_sample, materialize

WORD = re.compile("[^\x20\x09-\x0d]+")


def counts_by_hand(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_rule_counts(docs, labels, rows):
    forest = rules.fit(docs, labels)
    got = collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rules.judge(docs, forest).collect())
    want = collections.Counter()
    for r in rows:
        c = counts_by_hand(r[1])
        want[(r[0], *c, c[0] < 20 or 100 * c[4] > 30 * c[0])] += 1
    assert got == want


def test_rules_keep_and_reject(docs, labels, rows):
    forest = rules.fit(docs, labels)
    verdicts = {r.doc_id: r for r in rules.judge(docs, forest).collect()}
    assert not any(r.kept for r in verdicts.values() if r.base_failed)
    kept = rules.keep_good(docs, forest)
    assert kept.schema == docs.schema
    assert {r.doc_id for r in kept.collect()} == {i for i, r in verdicts.items() if r.kept}


def test_forest_isolates_and_calibrates():
    rng = np.random.default_rng(0)
    x = rng.uniform(0.1, 0.15, (2000, 3))
    x[:100, 0] = rng.uniform(0.4, 1, 100)
    forest = rules.calibrate(rules.grow(x[1000:]), x, np.arange(2000) >= 100)
    bad = forest.score(x) >= forest.cut
    assert bad[:100].mean() > 0.95 and bad[100:].mean() < 0.01
    assert rules.grow(np.zeros((0, 3))).score(np.zeros((2, 3))).tolist() == [1, 1]


def path_by_hand(forest, tree, row):
    node = forest.roots[tree]
    while forest.feature[node] >= 0:
        node = forest.left[node] if row[forest.feature[node]] < forest.split[node] else forest.right[node]
    return forest.length[node]


def test_forest_decides():
    rng = np.random.default_rng(2)
    # Fitted rows are alike in most statistics: nothing but what they spread over tells them apart.
    x = np.zeros((600, 8))
    x[:, 3] = rng.normal(0.55, 0.02, 600)
    x[:, 4] = rng.normal(0.15, 0.01, 600)
    forest = rules.grow(x)
    forest.cut = float(np.quantile(forest.score(x), 0.995))
    some = x[:20]
    assert np.allclose(forest.score(some), [2 ** (-np.mean([path_by_hand(forest, t, r) for t in range(len(forest.roots))]) / forest.norm) for r in some])
    for k in range(8):
        odd = np.median(x, axis=0)
        assert forest.score(odd[None])[0] < forest.cut
        odd[k] = 0.95
        assert forest.score(odd[None])[0] >= forest.cut, rules.STATISTICS[k]
    # Rows that are zero and not zero in the same places get different verdicts.
    few, many = np.median(x, axis=0), np.median(x, axis=0)
    few[5], many[5] = 0.001, 0.6
    assert forest.score(few[None])[0] < forest.cut <= forest.score(many[None])[0]


def test_rule_verdicts_by_hand(docs, labels, rows):
    forest = rules.fit(docs, labels)
    for r in rules.judge(docs, forest).collect():
        assert r.kept == (not r.base_failed and r.anomaly < forest.cut)


def test_forest_of_all_labelled_rows(spark):
    rng = random.Random(23)
    prose = lambda: " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(rng.randint(15, 40)))
    ids = [r[0] for r in spark.range(3400).selectExpr("id", "xxhash64(id) as h").orderBy("h", "id").collect()]
    # Rows beyond the first 3,000 in hash order are labelled bad, and only they are shouted.
    texts = [(i, prose() if k < 3000 else prose().upper(), int(k < 3000)) for k, i in enumerate(ids)]
    frame = spark.createDataFrame(texts, "doc_id long, text string, quality int")
    forest = rules.fit(frame.select("doc_id", "text"), frame.select("doc_id", "quality"))
    counts, x = rules.statistics(*ws.buffers(pa.array([t[1] for t in texts])))
    passed, good = ~rules.base_failed(counts), np.array([t[2] == 1 for t in texts])
    first, bad = x[passed & good], x[passed & ~good]
    want = rules.grow(first[::2])
    assert forest.feature.tolist() == want.feature.tolist() and forest.split.tolist() == want.split.tolist()
    known = np.concatenate([first[1::2], bad])
    assert forest.cut == rules.calibrate(want, known, np.arange(len(known)) < len(first) // 2).cut != rules.DEFAULT_CUT
    assert (forest.score(bad) >= forest.cut).all()
    alone = rules.fit(frame.select("doc_id", "text"), frame.select("doc_id", "quality").limit(0))
    assert alone.split.tolist() == rules.grow(x[passed]).split.tolist() and alone.cut == rules.DEFAULT_CUT


def test_lines_that_collide_modulo_powers_of_two():
    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    text = f"{a}\n{b}\n{a}"
    counts, _ = rules.statistics(*ws.buffers(pa.array([text])))
    assert counts["n_dup_lines"].tolist() == [1] == [counts_by_hand(text)[3]]


def spans_by_hand(text):
    text = text or ""
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out = [("assign", *m.span()) for m in assign.finditer(text) if len(m[2]) >= 8]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def test_secret_spans(docs, rows):
    got = collections.Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in secrets.scan_documents(docs).collect())
    want = collections.Counter()
    for r in rows:
        s = spans_by_hand(r[1])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in s)
        want[(r[0], *(sum(x[0] == k for x in s) for k in ("assign", "access", "hex")), hashlib.sha256(joined.encode()).hexdigest())] += 1
    assert got == want


def test_random_tokens_and_words():
    rng = random.Random(1)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    keys = ["".join(rng.choices(letters, k=40)) for _ in range(50)]
    found = sum(bool(secrets.random_tokens([(0, 40, k)])) for k in keys)
    assert found >= 45
    plain = ["version-2-of-the-release-notes-2024", "chapter_12_of_the_long_winter_story", "internationalization2020edition", "12345678901234567890", "aaaaaaaaaaaaaaaaaaaa1111"]
    assert not any(secrets.random_tokens([(0, len(t), t)]) for t in plain)


def test_random_letters_without_digits():
    import pyarrow as pa

    from leafmill.llm import wordscan as ws

    rng = random.Random(2)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    for letters in (upper + lower, upper, lower):
        texts = ["see " + "".join(rng.choices(letters, k=40)) + " there" for _ in range(50)]
        found = secrets.scan(*ws.buffers(pa.array(texts)))
        assert sum(found.get(i) == [(4, 44, 3)] for i in range(50)) >= 45
    plain = ["INTERNATIONALIZATIONANDLOCALIZATION", "MAX_CONNECTION_RETRIES_ALLOWED", "getUserAccountInformationFromDatabase", "usr/share/documentation/packages", "Donaudampfschifffahrtsgesellschaft", "-" * 60]
    assert not secrets.scan(*ws.buffers(pa.array(plain)))


def likelihood_by_hand(token, alphabet):
    total, before = 0.0, "s"
    for c in token:
        now = "l" if c.islower() else "u" if c.isupper() else "d" if c.isdigit() else "s"
        chance = secrets._NEXT[before]["luds".index(now)]
        chance *= secrets._LETTERS[ord(c.lower()) - 97] / sum(secrets._LETTERS) if now in "lu" else 0.1 if now == "d" else 0.25
        total, before = total - np.log(len(alphabet) * chance), now
    return total


def random_by_hand(tokens):
    """Bodies found among tokens, by the definition of the weighted step-up rule."""
    alphabets = [a for _, a in secrets.ENCODINGS]
    ps = []
    for t in tokens:
        alphabet = next(a for a in alphabets if all(c in a for c in t))
        plain = t.lower() if t == t.upper() and not any(c.isdigit() for c in t) else t
        ps.append(min(1.0, np.exp(-(likelihood_by_hand(plain, alphabet) + secrets.evidence(secrets.battery(t, alphabet))))))
    mean, m = np.mean([len(t) for t in tokens]), len(tokens)
    q = [p * mean / len(t) for p, t in zip(ps, tokens, strict=True)]
    most = max((k for k in range(1, m + 1) if sum(x <= secrets.DISCOVERY_RATE * k / m for x in q) >= k), default=0)
    return {t for t, x in zip(tokens, q, strict=True) if most and x <= secrets.DISCOVERY_RATE * most / m}


def test_random_spans_by_hand():
    rng = random.Random(14)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    seen = collections.Counter()
    for _ in range(60):
        tokens = ["".join(rng.choices(letters, k=rng.randint(20, 44))) for _ in range(rng.randint(0, 4))]
        tokens += ["".join(rng.choices("etaoinshr", k=rng.randint(20, 30))) + str(rng.randint(0, 99)) for _ in range(rng.randint(1, 4))]
        at, spans = 0, []
        for t in tokens:
            spans.append((at, at + len(t), t))
            at += len(t) + 1
        found = {t for s, e, t in spans if (s, e) in set(secrets.random_tokens(spans))}
        assert found == random_by_hand(tokens)
        seen[bool(found)] += 1
    assert seen[True] > 20 and seen[False] > 3


def test_each_test_of_the_battery_decides():
    letters = next(a for name, a in secrets.ENCODINGS if name == "base62")
    rng = random.Random(15)
    key = "".join(rng.choices(letters, k=60))
    ps = secrets.battery(key, letters)
    assert 3 * min(ps) > secrets.UNIFORM_LEVEL and secrets.random_tokens([(0, 60, key)])
    low, high = letters[:31], letters[31:]
    skewed = "".join(rng.choice(letters[:6] + letters[31:37]) for _ in range(60))
    alternating = "".join(rng.choice(low) + rng.choice(high) for _ in range(30))
    order = sorted(key, key=letters.index)
    slow = "".join(order[::2] + order[1::2][::-1])
    for token, k in ((skewed, 0), (alternating, 1), (slow, 2)):
        ps = secrets.battery(token, letters)
        assert 3 * ps[k] < secrets.UNIFORM_LEVEL and not secrets.random_tokens([(0, 60, token)])
    assert secrets.evidence((0.5, 0.5, 0.5)) > 0 > secrets.evidence((0.001, 0.001, 0.001))


def test_masking(docs):
    before = {r.doc_id: r for r in docs.collect()}
    out = secrets.mask_documents(docs)
    assert out.schema == docs.schema and out.count() == docs.count()
    for r in out.collect():
        if r.doc_id is not None and r.text != before[r.doc_id].text:
            assert secrets.MASK in r.text and r.n_chars == len(r.text) and not spans_by_hand(r.text)
    assert secrets.masked("abcdef", [(1, 3, 0), (2, 4, 2)]) == "a<secret>ef"


def test_media_round_trip(docs, rows):
    got = collections.defaultdict(list)
    for r in media.media_digest(docs).collect():
        got[r.doc_id].append(r)
    for row in rows:
        text = (row[1] or "").encode()
        payload = text + b"\0" * (-len(text) % 64 if text else 64)
        r = got[row[0]][0] if row[0] is not None else next(x for x in got[None] if x.n_bytes == len(text))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


def test_tiff_forms():
    rng = random.Random(2)
    for compression in (media.NONE, media.LZW, media.DEFLATE, media.PACKBITS):
        for predictor in (1, 2):
            for tile in (0, 16, 48):
                for order in "<>":
                    data = bytes(rng.choices(b"aab \0\xff", k=64 * rng.choice((1, 7, 300))))
                    read = media.decode(media.encode(data, compression, predictor, tile, page_rows=100, order=order))
                    assert b"".join(p.pixels for p in read) == data
    assert media.decode(b"no")[0].error and media.decode(media.encode(b"a" * 6400, media.NONE)[:300])[0].error


def test_lzw_long_and_packbits():
    rng = random.Random(5)
    for n in (0, 1, 5000, 60000):
        data = bytes(rng.choices(range(256), k=n))
        assert media.unpack_lzw(media.pack_lzw(data)) == data
        assert media.unpack_bits(media.pack_bits(data)) == data


def foreign(width, height, strips, order="<", big=False, **tags):
    """A TIFF put together by hand: tags by number, strips one after another behind the header."""
    head = (b"II" if order == "<" else b"MM") + (struct.pack(order + "HHHQ", 43, 8, 0, 0) if big else struct.pack(order + "HI", 42, 0))
    out, offsets = bytearray(head), []
    for strip in strips:
        offsets.append(len(out))
        out += strip
    fields = {256: (4, [width]), 257: (4, [height]), 258: (3, [8]), 259: (3, [1]), 273: (16 if big else 4, offsets), 277: (3, [1]), 278: (4, [height]), 279: (4, [len(x) for x in strips])}
    fields.update({int(k[1:]): v for k, v in tags.items()})
    place, code = (8, "Q") if big else (4, "I")
    entries = b""
    for tag, (kind, values) in sorted(fields.items()):
        body = b"".join(struct.pack(order + {3: "H", 4: "I", 16: "Q"}[kind], v) for v in values)
        if len(body) > place:
            body, at = struct.pack(order + code, len(out)), body
            out += at
        entries += struct.pack(order + "HH" + code, tag, kind, len(values)) + body.ljust(place, b"\0")
    struct.pack_into(order + code, out, 8 if big else 4, len(out))
    return bytes(out + struct.pack(order + ("Q" if big else "H"), len(fields)) + entries + bytes(place))


def test_tiffs_of_another_writer():
    rng = np.random.default_rng(0)
    for order in "<>":
        for big in (False, True):
            for bits in (1, 2, 4):
                x = rng.integers(0, 1 << bits, (5, 13)).astype(np.uint8)
                planes = ((x[:, :, None] >> np.arange(bits - 1, -1, -1)) & 1).astype(np.uint8).reshape(5, -1)
                packed = np.packbits(planes, axis=1).tobytes()
                read = media.decode(foreign(13, 5, [media.pack_bits(packed)], order, big, t258=(3, [bits]), t259=(3, [32773])))
                assert [p.pixels for p in read] == [x.tobytes()]
            for bits in (16, 32):
                x = rng.integers(0, 1 << bits, (4, 3), dtype=np.uint64).astype(f"u{bits // 8}")
                steps = x.copy()
                steps[:, 1:] -= x[:, :-1]
                read = media.decode(foreign(3, 4, [zlib.compress(steps.astype(f"{order}u{bits // 8}").tobytes())], order, big, t258=(3, [bits]), t259=(3, [8]), t317=(3, [2])))
                assert [p.pixels for p in read] == [x.tobytes()]
            x = rng.normal(size=(3, 6)).astype("f4")
            high = x.astype(">f4").view(np.uint8).reshape(3, 6, 4).transpose(0, 2, 1).reshape(3, 24)
            steps = high.copy()
            steps[:, 1:] -= high[:, :-1]
            read = media.decode(foreign(6, 3, [steps.tobytes()], order, big, t258=(3, [32]), t317=(3, [3])))
            assert [p.pixels for p in read] == [x.tobytes()]


def test_hostile_tiffs(spark):
    huge = foreign(1 << 20, 1 << 20, [b"x" * 60])
    small = foreign(20000, 13000, [zlib.compress(bytes(1000))], t259=(3, [8]))
    none = foreign(0, 5, [b""])
    wide = foreign((1 << 32) - 1, 1, [b"x"])
    for data in (huge, small, none, wide, b"II*\0", b"MM\0*\xff\xff\xff\xff", b"II+\0\x08\0\0\0\xff"):
        assert [p.pixels for p in media.decode(data)] == [None]
    rng = random.Random(9)
    for _ in range(400):
        base = bytearray(media.encode(bytes(rng.choices(b"abc", k=640)), rng.choice((1, 5, 8, 32773)), rng.choice((1, 2)), rng.choice((0, 16))))
        for _ in range(rng.randint(1, 6)):
            base[rng.randrange(len(base))] = rng.randrange(256)
        media.decode(bytes(base))
    files = spark.createDataFrame([(1, bytearray(huge)), (1, bytearray(wide)), (2, bytearray(media.encode(b"q" * 64)))], "id long, content binary")
    assert sorted((r.id, r.error is None) for r in media.tiff_pages(files, "id").collect()) == [(1, False), (1, False), (2, True)]


def test_media_features(spark):
    text = "abc é" * 70000
    rows = media.media_digest(spark.createDataFrame([(1, text, "x"), (1, text, "y"), (2, None, "z")], "doc_id long, text string, feature string")).collect()
    raw = text.encode() + bytes(-len(text.encode()) % 64)
    shares = [sum(b >> 4 == k for b in raw) * 1000 // len(raw) for k in range(16)]
    mean = sum(raw) / len(raw)
    spread = (sum((b - mean) ** 2 for b in raw) / len(raw)) ** 0.5
    n = -(-len(raw) // (64 * media.PAGE_ROWS))
    one, two = (r for r in rows if r.doc_id == 1)
    assert one == two and one.feature == f"{n};{mean:.3f};{spread:.3f};{','.join(map(str, shares))}"
    stored = media.encode(raw)
    assert (one.media_bytes, one.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())


def test_tiff_pages(spark):
    files = spark.createDataFrame([(1, media.encode(b"q" * 64 * 300, page_rows=128)), (2, b"bad"), (3, None), (4, b"")], "id long, content binary")
    got = sorted((r.id, r.page, r.height, r.error is None) for r in media.tiff_pages(files, "id").collect())
    assert got == [(1, 0, 128, True), (1, 1, 128, True), (1, 2, 44, True), (2, 0, 0, False)]


PAGE = '<!DOCTYPE html><html><head><title>T t</title><script>var t="</p>";</script></head><body><nav><ul>{nav}</ul></nav><!-- ad --><div class="ad">Buy {ad}.</div><article><h1>{h}</h1><p><b>{p}<br><p>{q} &amp; caf&eacute;</p></article><footer>&copy; x</footer>'


def page(rng):
    w = lambda n: " ".join("".join(rng.choices("abcdeé", k=4)) for _ in range(n))
    h, p, q = w(4), w(rng.randint(1, 40)), w(rng.randint(1, 40))
    nav = "".join(f"<li><a href=/x>{w(1)}</a></li>" for _ in range(6))
    return PAGE.format(nav=nav, ad=w(9), h=h, p=p, q=q), f"{h} {p} {q} & café"


def test_html(spark):
    rng = random.Random(4)
    some = [page(rng) for _ in range(60)]
    weights = pages.learn([p for p, _ in some])
    assert [pages.extract(p, weights) for p, _ in some] == [t for _, t in some]
    assert pages.extract(None, weights) == "" and pages.extract("<p", weights) == "" and pages.extract("", pages.Weights()) == ""
    mixed = '<body><div id="main"><p>One &amp two <i>th</i>ree four.</p><div class="comments"><p>No</p></div><form><input>Log in</form><p>Five six <script>"</p>"</script> seven<p>eight <!-- c --> x</div><div class=sidebar>side</div><footer>foot'
    assert pages.extract(mixed, weights) == "One & two three four. Five six seven eight x"
    table = spark.createDataFrame([(i, "u", p, "extra") for i, (p, _) in enumerate(some)] + [(None, None, None, None)], "page_id long, url string, html string, text string")
    out = pages.extract_pages(table, pages.fit(table))
    assert sorted((r.text, r.n_chars) for r in out.collect()) == sorted([(t, len(t)) for _, t in some] + [("", 0)])
    assert pages.extract_pages(table.limit(0), pages.fit(table.limit(0))).count() == 0
    assert html.unescape("&eacute;") == "é"


def best_by_hand(scores):
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    return max([0.0, *(sums[j] - sums[i] for i in range(len(sums)) for j in range(i + 1, len(sums)))])


def test_region_is_the_maximum():
    rng = random.Random(16)
    for _ in range(200):
        scores = [rng.choice((-6.0, -2.0, -0.5, -0.25, 0.0, 1.0, 4.0)) for _ in range(rng.randint(0, 40))]
        start, end = pages.best_region(scores)
        assert sum(scores[start:end]) == best_by_hand(scores)
    some = [page(rng) for _ in range(30)]
    weights = pages.learn([p for p, _ in some])
    for text, _ in some[:10]:
        scores, _ = weights.of(pages.parse(text))
        start, end = pages.best_region(scores)
        assert abs(sum(scores[start:end]) - best_by_hand(scores)) < 1e-6


def test_scan_decides(monkeypatch):
    rng = random.Random(17)
    some = [page(rng) for _ in range(30)]
    weights = pages.learn([p for p, _ in some])
    assert all(pages.extract(p, weights) == t for p, t in some)
    monkeypatch.setattr(pages, "best_region", lambda scores: (0, len(scores)))
    assert all(pages.extract(p, weights) != t for p, t in some)


def test_class_words_and_nesting():
    rng = random.Random(18)
    for weights in (pages.learn([page(rng)[0] for _ in range(30)]), pages.Weights()):
        five = "One two three four five."
        for text in (
            f'<body><nav><a href=/>x</a></nav><div id="page" class="with-sidebar"><p>{five}</p></div><footer>f',
            f'<div class="content no-comments"><p>{five}</p></div>',
            f'<section class="share-price-news">{five}</section><div class="left-sidebar">no</div>',
            f'<div class="sidebar">{"menu " * 500}</div><article>{five}</article><div id="comments">{"ha " * 500}</div>',
            f'<div class="related"><article>One two<aside>no</aside> three<div class="ad">buy</div> four five.</article></div>',
            f'<div style="display: none">hidden words here</div><p>{five}</p><script>var x = "<p>no</p>"</script>',
        ):
            assert pages.extract(text, weights) == five, text
        listed = "<article><h1>T</h1><ul><li>a b<li>c</ul><div>q</div><aside>no</aside><p>end</article>"
        assert pages.extract(listed, weights) == "T a b c q end"
        long = "<article>" + "<p>word &amp; <b>more</b></p>" * 20000 + "</article>"
        assert pages.extract(long, weights) == " ".join(["word & more"] * 20000)
        assert pages.extract("<div>" * 20000 + "x" + "</p>" * 20000, weights) == "x"


def test_labels_overrule_names():
    kept = [f'<body><article><p>{"a b c " * 30}</p></article><div class="widget"><article>{"d e " * 200}</article></div></body>' for _ in range(5)]
    odd = [f'<body><div class="teaser">{"x " * 100}</div><article><p>{"a b c " * 30}</p></article></body>' for _ in range(5)]
    weights = pages.learn(kept + odd)
    assert weights.odds(0, ".teaser") < 0 and pages.Weights().odds(0, ".teaser") is None
    assert pages.extract('<p>One two three.</p><div class="teaser">no</div><p>Four five six.</p>', weights) == "One two three. Four five six."


def forward_by_hand(net, raw):
    """One text, byte by byte: symbols, chunks, filters, the largest responses, hidden layer, sigmoid."""
    c = classifier
    n = len(raw) + 2 * c.PAD
    framed = [0] * c.PAD + list(raw) + [0] * (c.PAD + (-n) % c.STRIDE)
    symbols = list(framed)
    for i in range(len(framed)):
        for lag in range(2, c.LAGS + 1):
            if all(i - k - lag >= 0 and framed[i - k] and framed[i - k] == framed[i - k - lag] for k in range(c.MATCH)):
                symbols[i] = framed[i] + 256
    top = np.full(c.FILTERS, -np.inf)
    for start in range(0, len(symbols) - c.WIDTH + 1, c.STRIDE):
        seen = np.concatenate([net.embed[s] for s in symbols[start : start + c.WIDTH]])
        top = np.maximum(top, seen @ net.filters)
    pool = np.maximum(top + net.bias, 0)
    z = np.maximum(pool @ net.w1 + net.b1, 0) @ net.w2 + net.b2
    return 1 / (1 + np.exp(-z[0]))


def test_classifier_forward_pass():
    rng = random.Random(19)
    net = classifier.fresh(3)
    texts = ["", "a", "abab" * 12, "".join(rng.choices("abcé \n", k=400)), "xyz " * 100]
    got = classifier.scores(net, *ws.buffers(pa.array(texts)))
    assert np.allclose(got, [forward_by_hand(net, t.encode()) for t in texts], atol=1e-4)
    for blocks in (1, 5, 1 << 17):
        framed, at = classifier.chunks(*ws.buffers(pa.array(texts[3:4])))
        assert np.allclose(classifier.pooled_long(net, framed, blocks), classifier.pooled(net, framed, at)[0], atol=1e-5)


def test_samples_are_bounded(spark):
    rows = [(i, "x" * (10 * (i % 7 + 1)), i % 2) for i in range(50)] + [(3, "y" * 5, 1)] * 40 + [(None, "z", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    taken = bounded_sample(frame, "doc_id", "text", 30, 600)
    assert len(taken) == len({r.doc_id for r in taken}) <= 30 and sum(len(r.text) for r in taken) <= 600
    assert [r.doc_id for r in taken] == [r.doc_id for r in bounded_sample(frame.repartition(7), "doc_id", "text", 30, 600)]
    assert len(bounded_sample(frame, "doc_id", "text", 1000, 1 << 20)) == 50
    assert bounded_sample(frame.limit(0), "doc_id", "text", 5, 5) == []


def test_classifier_learns_and_covers_whole_texts(spark):
    rng = random.Random(6)
    prose = lambda: " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(80))
    noise = lambda: " ".join("".join(rng.choices("abcdefgh", k=4)) + "***" for _ in range(80))
    texts = [(i, noise() if i % 3 == 0 else prose()) for i in range(400)]
    docs = spark.createDataFrame([(*t, "x") for t in texts] + [(None, None, None), (900, "", "y")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i, _ in texts], "doc_id long, quality int")
    net = classifier.fit(docs, labels)
    out = classifier.score(docs, net).collect()
    held = [r for r in out if r.doc_id is not None and r.doc_id < 400 and r.held_out]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in held)
    assert sum(r.predicted == int(r.doc_id % 3 != 0) for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    # What stands at the very end of a long text is pooled like the rest: the larger of both parts, filter by filter.
    long = " ".join(prose() for _ in range(300)) + " "
    parts = [long + " " * (-(len(long) + classifier.PAD) % classifier.STRIDE), noise()]
    top = lambda t: classifier.pooled(net, *classifier.chunks(*ws.buffers(pa.array([t]))))[0][0]
    whole, first, last = top("".join(parts)), top(parts[0]), top(" " * 24 + parts[1])
    assert (last > first).any() and (whole >= first - 1e-4)[last <= first].all() and (whole > first)[last > first + 1].all()
    # A text's score doesn't depend on what stands beside it.
    late = [long, "".join(parts), parts[1]]
    both = classifier.scores(net, *ws.buffers(pa.array(late)))
    assert all(abs(classifier.scores(net, *ws.buffers(pa.array([t])))[0] - b) < 1e-4 for t, b in zip(late, both, strict=True))


def shuffled_bytes(spark):
    gateway, jvm = spark.sparkContext._gateway, spark._jvm
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


@pytest.mark.parametrize("most", ["-1", "10MB"])
def test_classifier_fit_shuffles_no_texts(spark, monkeypatch, most):
    rng = random.Random(29)
    texts = [(i, "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGH", k=8000)), i % 2) for i in range(400)]
    frame = spark.createDataFrame(texts, "doc_id long, text string, quality int").repartition(4)
    monkeypatch.setattr(classifier, "SAMPLE", 5)
    monkeypatch.setattr(classifier, "train", lambda some, good: (some, good.tolist()))
    table = materialize(frame, "frame")
    before, limit = shuffled_bytes(spark), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    try:
        some, good = classifier.fit(table.select("doc_id", "text"), table.select("doc_id", "quality"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert shuffled_bytes(spark) - before < 400_000
    marked = {t: g for _, t, g in texts}
    assert len(some) == 5 and [marked[t.decode()] for t in some] == good


def test_classifier_without_labels(spark, docs, nothing, labels):
    net = classifier.fit(docs, labels.limit(0))
    assert {r.score for r in classifier.score(docs, net).collect()} == {0.5}
    assert classifier.score(nothing, net).count() == 0


def test_empty_tables(nothing, labels):
    forest = rules.fit(nothing, labels)
    for out in (rules.judge(nothing, forest), rules.keep_good(nothing, forest), secrets.scan_documents(nothing), secrets.mask_documents(nothing), media.media_digest(nothing)):
        assert out.count() == 0
