"""Operators against brute force, round trips and the edge cases that their docstrings define."""

import base64
import collections
import hashlib
import itertools
import re
import struct
import tracemalloc
import zlib

import numpy as np
import pytest

from triloom.llm import bpe, components, embed_dedup, html_text, licenses, packing, pii, quality_cnn, quality_rules, setjoin, warc

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n string, set string, key string"
TEXTS = [
    None, "", "   \n\t ", "one", "one two three", "the same words stand here again " * 12, "the same words stand here again " * 12,
    "Mail joe.x@mail3.example.com or call +1 (644) 555-7859 about 10.2.3.44 and 4111 1111 1111 1111 please",
    "word " * 3000, "é ü 日本   x\x1cy", "Licensed under the Apache License, Version 2.0.\nplain text follows here and goes on for a while",
    " ".join(f"w{i}" for i in range(200)), " ".join(f"w{i}" for i in range(199)) + " changed", "#### $$$ ||| " * 30,
    "stop <|endoftext|> here, a<|startoftext|>b and <|endoftext",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(None if i == 4 else i // 2 if i in (5,) else i, t, "en", None if i % 3 == 0 else "src0", 1, "x", "y", "z") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    got = packing.pack(docs, path, longest=64).collect()
    assert packing.pack(empty, path).count() == 0
    assert len({r.sequence_id for r in got}) == len(got) and all(r.offset == 0 and r.length & (r.length - 1) == 0 and r.length <= 64 for r in got)
    whole = collections.defaultdict(list)
    for r in got:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        whole[r.doc_id, r.doc_tokens].append((r.start, bytes(r.ids)))
    expected = collections.Counter()
    for r in docs.collect():
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 1]
        expected[r.doc_id, struct.pack(f"<{len(ids)}I", *ids)] += 1
    assert {(k[0], b"".join(p for _, p in sorted(set(v)))) for k, v in whole.items()} == set(expected)


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 1000])
def test_pieces(n):
    got = list(packing.pieces(n, 64))
    assert sum(x for _, x in got) == n and [s for s, _ in got] == list(np.cumsum([0, *(x for _, x in got)])[:-1])
    rest = [x for _, x in got if x < 64]
    assert rest == sorted(set(rest), reverse=True)


def test_bpe(docs, empty):
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode(docs, path, P.PATTERN).collect()}
    expected = set()
    for r in docs.collect():
        ids = lib.encode_ordinary(r.text or "")
        expected.add((r.doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert got == expected
    assert bpe.encode(empty, path, P.PATTERN).count() == 0


def test_bpe_long_and_odd_words():
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    rng = np.random.default_rng(1)
    some = ["a" * 3001, "ab" * 900 + "aaa", "don't  DON'T\n\n x", "<|endoftext|>", *("".join(rng.choice(list("ab aé\n1!"), 300)) for _ in range(30))]
    enc = bpe.Encoder(path, P.PATTERN)
    for x, (ids, back) in zip(some, enc.encode(some), strict=True):
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == lib.encode_ordinary(x) and back.decode() == x


WORD = r"[^\x20\x09-\x0D]+"


def test_quality_rules(docs, empty):
    got = collections.Counter(tuple(r) for r in quality_rules.verdicts(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect())
    expected = collections.Counter()
    for r in docs.collect():
        t = r.text or ""
        w = re.findall(WORD, t)
        seen = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {p for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for p in range(i, i + 8)}
        lines = [x for x in t.split("\n") if re.search(WORD, x)]
        expected[r.doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)] += 1
    assert got == expected
    assert quality_rules.verdicts(empty).count() == 0
    assert quality_rules.verdicts(docs, keep=tuple(docs.columns)).select("_kept.*").columns == docs.columns


def test_bad_host(spark):
    """On a host that mostly fails, one soft failure is enough; elsewhere it isn't."""
    good = " ".join(f"word{i}" for i in range(40))
    soft = good + "".join(f" #k{i}" for i in range(15))  # breaks the symbol rule alone
    rows = [(i, "short", "bad") for i in range(60)] + [(100, soft, "bad"), (101, good, "bad"), (102, soft, "fine")] + [(200 + i, good, "fine") for i in range(60)]
    kept = {r.doc_id: r.kept for r in quality_rules.verdicts(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert (kept[100], kept[101], kept[102]) == (False, True, True)
    assert quality_rules.beta_prior({"hosts": 0}) == (1.0, 1.0)


def brute_components(texts):
    sets = {}
    for i, t in texts:
        w = re.findall(WORD, re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets[i] = {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()
    ids = [i for i in sets if sets[i]]
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    roots = components.forest([(i, i) for i in sets] + pairs)
    return {i: (len(sets[i]), roots[i]) for i in sets}


def test_setjoin_edges(docs, empty):
    got = setjoin.jaccard_components(docs).collect()
    assert len(got) == docs.count()
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[12].component_id == by[11].component_id == 11
    assert by[0].component_id == 0 and by[0].n_shingles == 0 and by[1].component_id == 1
    assert by[3].n_shingles == 1
    assert by[6].component_id == 2  # the row that repeats id 2 has the same text
    none = [(r.n_shingles, r.component_id) for r in got if r.doc_id is None]
    assert none == [(1, None)]  # three words are one shingle
    assert setjoin.jaccard_components(empty).count() == 0


def test_setjoin_random(spark, monkeypatch):
    """Families of copies with edits, of small and large sets, and a passage that many share: by subsets and by lists, whole or in blocks."""
    rng = np.random.default_rng(5)
    word = lambda: f"w{rng.integers(0, 400)}"
    passage = [word() for _ in range(55)]
    texts, n = [], 0
    for size in (4, 8, 10, 14, 20, 30, 45, 80, 200):
        for _ in range(4):
            base = [word() for _ in range(size)]
            for _ in range(6):
                copy = list(base)
                for _ in range(int(rng.integers(0, 1 + size // 25 + 1))):
                    copy[int(rng.integers(0, len(copy)))] = word()
                texts.append((n, " ".join(copy + (passage if rng.random() < 0.3 else []))))
                n += 1
    rows, expected = spark.createDataFrame(texts, "doc_id long, text string"), brute_components(texts)
    for rounds, block, edge in ((2, 20_000, None), (0, 20_000, 0), (2, 3, 0), (2, 3, 60), (0, 5, 13)):  # without early rounds the last one finds all links
        monkeypatch.setattr(setjoin, "LIST_ROWS", block)
        if edge is not None:
            monkeypatch.setattr(setjoin, "boundary", lambda *_, edge=edge: edge)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in setjoin.jaccard_components(rows, rounds=rounds).collect()} == expected, (rounds, block, edge)


def test_boundary_follows_cost():
    """Subsets where lists are long, lists where they are short."""
    sizes = np.concatenate([np.arange(6, 60), np.full(50, 235)])
    found = [setjoin.boundary(sizes, 85, others) for others in (0.0, 0.25, 1.0, 10.0)]
    assert found[0] <= 6 and found == sorted(found) and found[1] >= 13 and found[3] >= 20


@pytest.mark.parametrize("n", [1, 6, 63, 64, 65, 128, 129, 511, 1024, 1025, 3000])
def test_bitmaps_never_exceed_the_difference(n):
    rng = np.random.default_rng(n)
    base = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
    for lost, added in ((0, 0), (0, n // 7), (n // 12, n // 20), (n // 7, 0), (n // 2, n // 2)):
        other = np.unique(np.concatenate([base[lost:], rng.integers(0, 1 << 63, added).astype(np.uint64)]))
        small, large = sorted((base, other), key=len)
        words, full, half = setjoin.bitmaps(np.array([setjoin.bitmap(small), setjoin.bitmap(large)], object))
        if words[1] > 2 * words[0]:  # sizes that can't link
            continue
        apart = int(np.bitwise_count(full[0] ^ (full[1] if words[0] == words[1] else half[1])).sum())
        assert apart <= len(np.setxor1d(base, other))
        assert apart % 2 == len(np.setxor1d(base, other)) % 2  # folded rightly: parity of the difference stays


def passages_in_three(n):
    """n texts of six shingles; 60 further ones hold one of 20 passages of two shingles, each in three texts and a copy of one, in other places."""
    rows = [(i, " ".join(f"u{i}x{j}" for j in range(9))) for i in range(n)]
    own = lambda i: " ".join(f"v{i}x{j}" for j in range(20))
    more = [(n + i, f"{own(i)} " + " ".join(f"p{i % 20}x{j}" for j in range(5))) for i in range(60)]
    return rows + more + [(n + 60 + i, more[i][1]) for i in range(20)]


def test_setjoin_counts_all_rows(spark, monkeypatch):
    """Shingles that three texts hold are found among all rows, copies count once, and the boundary sees all sets."""
    seen, sketches, boundary = [], setjoin.sketches, setjoin.boundary
    monkeypatch.setattr(setjoin, "sketches", lambda *a: seen.append(len(a[3])) or sketches(*a))
    monkeypatch.setattr(setjoin, "boundary", lambda sizes, percent, others, *times: seen.append(int(sum(times[0]) if times else len(sizes))) or boundary(sizes, percent, others, *times))
    texts = passages_in_three(26_000)
    got = setjoin.jaccard_components(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i - 60 if i >= 26_060 else i for i, _ in texts}
    assert sorted(seen) == [20 * 2, 26_060]


@pytest.mark.parametrize("ranges", [1, 3, 50])
def test_shingle_counts_are_exact(spark, monkeypatch, ranges):
    """Summed in runs and ranges: the counts that plain Python finds."""
    monkeypatch.setattr(setjoin, "RUN", 40)
    rng = np.random.default_rng(3)
    texts = [(i, i, " ".join(f"w{rng.integers(0, 4)}" for _ in range(int(rng.integers(0, 60))))) for i in range(80)] + [(80, 80, None)]
    rows = spark.createDataFrame(texts, "id long, rid long, text string").repartition(3)
    keys = collections.Counter(int(h >> np.uint64(64 - setjoin.KEY_BITS)) for _, _, t in texts for s in setjoin.shingle_sets([(t or "").encode()], 4) for h in s)
    got = setjoin.shingle_counts(rows, 4, ranges, 3).collect()
    assert {r.key: r.n for r in got if r.key is not None} == {k: n for k, n in keys.items() if n >= 3}
    times = collections.Counter()
    for r in got:
        times[r.n] += r.times
    assert times == collections.Counter(keys.values())
    heavy, others = setjoin.common_shingles(rows, 4, 3, 20)
    bound = min(x for x in range(3, 100) if sum(n >= x for n in keys.values()) <= 20)
    assert heavy.tolist() == sorted(k for k, n in keys.items() if n >= bound)
    assert others == sum(n * (n - 1) for n in keys.values() if n < bound) / sum(keys.values())
    for x in ([0], [1, 255, 256, 0], [1 << 47, 5]):
        assert setjoin.unplaned(setjoin.planes(np.array(x, np.uint64)), len(x)).tolist() == x


def test_setjoin_boundary_keeps_all_links(spark):
    texts = [(i, " ".join(f"x{j}" for j in range(i % 7, 30 + i % 7))) for i in range(40)]
    rows = spark.createDataFrame(texts, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in setjoin.jaccard_components(rows).collect()} == brute_components(texts)


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(1000, 1060)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long").repartition(5)).collect()}
    expected = {k: v for k, v in components.forest([e for e in edges if e[0] != e[1]]).items()}
    assert got == expected


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 16))
    rows, vid = [], 0
    for b in base:
        for _ in range(25):
            rows.append((vid, [float(x) for x in np.float32(b + rng.normal(size=16) * rng.choice([0.05, 0.15, 0.3]))]))
            vid += 1
    rows += [(vid, rows[0][1]), (vid + 1, rows[0][1]), (vid + 2, None), (vid + 3, []), (vid + 4, [0.0] * 16), (vid + 5, [float("nan")] * 16), (vid + 6, [None] * 16), (vid + 7, [1.0, 2.0]), (vid + 8, [float("inf")] + [1.0] * 15), (vid + 9, [1e300 * 1.0] + [0.0] * 15)]
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], "vec_id long, embedding array<double>, v string").repartition(4)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_dedup.near_duplicates(df).collect()}
    sound = [(i, np.array(v, float)) for i, v in rows if v and None not in v and np.isfinite(v).all() and np.any(v)]
    unit = {i: (v / np.abs(v).max()) / np.linalg.norm(v / np.abs(v).max()) for i, v in sound}
    pairs = [(a, b) for a in unit for b in unit if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95]
    links = collections.Counter(x for p in pairs for x in p)
    roots = components.forest([(i, i) for i, _ in rows] + pairs)
    assert got == {i: (links[i], roots[i], roots[i] == i) for i, _ in rows}
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_ids_and_blocks(spark, monkeypatch):
    """Null and repeated ids, over blocks and leaves of a few vectors, with far clusters that are never compared."""
    monkeypatch.setattr(embed_dedup, "BLOCK", 8)
    monkeypatch.setattr(embed_dedup, "LEAF", 3)
    rng = np.random.default_rng(12)
    a, b, far = rng.normal(size=8), rng.normal(size=8), rng.normal(size=(60, 8))
    rows = [(None, a), (None, a), (7, a + 0.001), (None, b), (7, b), (9, far[0]), (9, far[0]), (None, far[1])] + [(100 + k, v) for k, v in enumerate(far[2:])]
    rows += [(300 + k, a + 0.002 * k) for k in range(30)]
    df = spark.createDataFrame([(i, [float(x) for x in v], "c", 1) for i, v in rows], "vec_id long, embedding array<double>, cid string, block int").repartition(3)
    units = embed_dedup.unit(np.array([v for _, v in rows]))
    near = units @ units.T >= 0.95
    want = collections.Counter()
    roots = components.forest([(x, y) for x in range(len(rows)) for y in range(x + 1) if near[x, y]])
    for k, (i, _) in enumerate(rows):
        ids = [rows[m][0] for m in roots if roots[m] == roots[k] and rows[m][0] is not None]
        least = min(ids, default=None)
        want[i, int(near[k].sum()) - 1, least, i is not None and i == least] += 1
    assert collections.Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in embed_dedup.near_duplicates(df).collect()) == want


def test_close_pairs():
    """Recursive halving in single precision with a margin gives the pairs of the plain product in double precision."""
    rng = np.random.default_rng(13)
    x = embed_dedup.unit(np.concatenate([rng.normal(size=(300, 24)), np.repeat(rng.normal(size=(20, 24)), 20, axis=0) + rng.normal(size=(400, 24)) * 0.2]))
    eps = float(np.sqrt(2 - 2 * 0.95))
    got = {(int(p), int(q)) for i, j in embed_dedup.close_pairs(x, x, x, x, eps, 0.95) for p, q in zip(i, j, strict=True)}
    i, j = np.nonzero(np.einsum("ik,jk->ij", x, x) >= 0.95)
    assert got == set(zip(i.tolist(), j.tolist(), strict=True))


def test_very_long_texts(spark):
    """One text of some megabytes each goes through whole."""
    words = " ".join(f"w{i}" for i in range(400_000))
    mail = "joe@mail.example.com "
    page = spark.createDataFrame([(1, "http://a/", f"<article><p>{words}</p></article><footer>x</footer>"), (2, "http://a/2", f"<div>{words} end</div>")], "page_id long, url string, html string")
    assert [r.text for r in sorted(html_text.extract(page).collect())] == [words, words + " end"]
    captures, directory = warc.write(page)
    assert sorted(r.payload_bytes for r in warc.read(directory, captures).collect()) == sorted(len(r.html) for r in page.collect())
    text = spark.createDataFrame([(1, mail * 60_000 + words)], "doc_id long, text string")
    assert pii.find(text, pii.train()).first().n_email == 60_000
    assert setjoin.jaccard_components(text).first().n_shingles > 399_000
    got = packing.pack(text, P.path("word_bpe_49k.json")).collect()
    assert sum(r.length for r in got) == got[0].doc_tokens > 1_000_000


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/x">Menu</a></li></ul></nav><!-- ad --><div class="ad">Buy</div><aside>Side</aside><div id="cookie-notice">Cookies</div>
<article><h1>Title &amp; more</h1><p><b>First  line<br>goes on &eacute;&#x41;.</p><p>Second<p>Third {n}<form><input>no</form><div class="comments"><p>A reader</p></div></article>
<footer>&copy; foot</footer></body></html>"""


def test_html(spark):
    boiler = "this long line of many words stands at the top of every page here"
    rows = [(1, "http://a.example/1", PAGE), (2, None, None), (3, "http://a.example/2", ""), (4, "http://b.example/1", "<div class='x <p>never closed"), (None, "http://a.example/3", "plain <i>in</i>line")]
    rows += [(10 + k, "http://c.example/" + str(k), f"<div>{boiler}</div><div>unique text number {k} with its own words {k * 7}</div>") for k in range(4)]
    got = {r.page_id: r for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1].text == "Title & more\nFirst line goes on éA.\nSecond\nThird {n}" and got[1].n_chars == len(got[1].text)
    assert got[2].text == "" and got[3].text == "" and got[None].text == "plain inline"
    assert all(got[10 + k].text == f"unique text number {k} with its own words {k * 7}" for k in range(4))
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def page_texts(spark, pages, parts=3):
    df = spark.createDataFrame([(k, f"http://h.example/{k}", p) for k, p in enumerate(pages)], "page_id long, url string, html string").repartition(parts)
    return [r.text for r in sorted(html_text.extract(df).collect(), key=lambda r: r.page_id)]


def test_html_copies(spark):
    """Articles stay whole, whatever number of pages shares a paragraph or all of it; notices known as chrome go."""
    own = lambda k, j: " ".join(f"w{k}x{j}x{i}" for i in range(20))
    notice = "please accept that this site sets cookies and keeps them for a year"
    copy, text = "".join(f"<p>{own('c', j)}</p>" for j in range(4)), "\n".join(own("c", j) for j in range(4))
    assert page_texts(spark, [f"<article>{copy}</article>"] * 20) == [text] * 20
    assert page_texts(spark, [f"<article>{copy}<p>changed {k} here</p></article>" for k in range(20)]) == [f"{text}\nchanged {k} here" for k in range(20)]
    assert page_texts(spark, [f"<div>{copy}</div>"] * 2) == [text] * 2
    for n in (11, 12, 13):
        shared = [f"<article><p>{own(k, 0)}</p><p>{notice}</p><p>{own(k, 1)}</p></article>" for k in range(n)]
        assert page_texts(spark, shared) == [f"{own(k, 0)}\n{notice}\n{own(k, 1)}" for k in range(n)]
        known = [f"{p}<div class=cookie>{notice}</div>" if k < 2 else p for k, p in enumerate(shared)]
        assert page_texts(spark, known) == [f"{own(k, 0)}\n{own(k, 1)}" for k in range(n)]
    # headings shared by pages without a main zone stay, the footer's long run doesn't
    assert page_texts(spark, [f"<h2>A heading</h2><div>{own(k, 0)}</div><div>{notice}</div>" for k in range(3)]) == [f"A heading\n{own(k, 0)}" for k in range(3)]


def brute_texts(pages):
    """Main texts of (host, html) by sets of runs."""
    split = [html_text.split_page(p or "") for _, p in pages]
    runs = lambda x: [tuple(x.split()[i : i + html_text.SPAN]) for i in range(len(x.split()) - html_text.SPAN + 1)]
    stands = {k: collections.defaultdict(set) for k in ("run", "chrome", "main")}
    for (host, _), (zoned, kept, other) in zip(pages, split, strict=True):
        for x in other + ([] if zoned else kept):
            for r in runs(x):
                stands["run"][host, r].add(tuple(kept))
        for x in other:
            stands["chrome"][host, x].add(tuple(kept))
        for x in kept if zoned else []:
            stands["main"][host, x].add(tuple(kept))
    out = []
    for (host, _), (zoned, kept, _) in zip(pages, split, strict=True):
        if zoned:
            left = [x for x in kept if min(len(stands["chrome"][host, x]), len(stands["main"][host, x])) < 2]
        else:
            left = []
            for x in kept:
                gone = {i + s for i, r in enumerate(runs(x)) if len(stands["run"][host, r]) > 1 for s in range(html_text.SPAN)}
                left.append(" ".join(w for i, w in enumerate(x.split()) if i not in gone))
        out.append("\n".join([x for x in left if x] or kept))
    return out


def test_html_brute_force(spark):
    """Random hosts, whose pages share runs, blocks and notices, however they are dealt; ids may repeat or be null."""
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcde"), 4))
    pool = [" ".join(word() for _ in range(int(rng.integers(3, 30)))) for _ in range(30)]
    pages = []
    for k in range(90):
        parts = [f"<p>{pool[int(rng.integers(30))] if rng.random() < 0.4 else ' '.join(word() for _ in range(12))}</p>" for _ in range(int(rng.integers(0, 8)))]
        at = int(rng.integers(0, len(parts) + 1))
        html = f"<article>{''.join(parts[:at])}</article><div class=sidebar>{''.join(parts[at:])}</div>" if k % 2 else "".join(parts)
        pages.append((f"{'a' if k % 5 else 'b'}.example", None if k == 7 else html))
    want = brute_texts(pages)
    assert sum(w != "\n".join(html_text.split_page(p or "")[1]) for w, (_, p) in zip(want, pages, strict=True)) > 20
    rows = [(None if k % 17 == 0 else k // 2 if k % 13 == 0 else k, f"http://{h}/{k}", p, "x", "y") for k, (h, p) in enumerate(pages)]
    for parts in (1, 7):
        df = spark.createDataFrame(rows, "page_id long, url string, html string, host string, hash string").repartition(parts)
        got = {r.url: r for r in html_text.extract(df).collect()}
        assert [got[u].text for _, u, *_ in rows] == want and [got[u].page_id for _, u, *_ in rows] == [r[0] for r in rows]


def test_suffix_ranks():
    rng = np.random.default_rng(0)
    t = rng.integers(0, 3, 200)
    rank = html_text.suffix_order(t)
    keys = [tuple(t[i : i + html_text.SPAN]) + (-1,) * max(0, i + html_text.SPAN - len(t)) for i in range(len(t))]
    order = {k: n for n, k in enumerate(sorted(set(keys)))}
    assert [order[k] for k in keys] == rank.tolist()


def test_warc(spark):
    rows = [(1, "http://www.example.com/a?b=1#c", "same"), (2, "https://example.com", "same"), (3, None, None), (4, "http://x.example.org:80/ü y", ""), (5, "u\nrl", "é" * 100), (6, "http://www.example.com/a?b=1", "other"), (None, "http://n/", "none")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    captures, directory = warc.write(df)
    got = {r.page_id: r for r in warc.read(directory, captures).collect()}
    assert len(got) == len(rows)
    asked = spark.createDataFrame([("com,example,www)/a?b=1", 6), ("com,example,www)/a?b=1", 6), ("com,example,www)/zzz", 1), ("a", None), ("n)/", None)], "key string, page_id long")
    assert sorted((r.page_id, r.payload_bytes) for r in warc.read(directory, asked).collect() if r.page_id) == [(6, 5)]
    assert [r.payload_bytes for r in warc.read(directory, asked).collect() if r.page_id is None] == [4]
    for page, _, html in rows:
        data = (html or "").encode()
        assert got[page].payload_bytes == len(data) and got[page].payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
    assert [(got[k].record_type, got[k].refers_to) for k in (1, 2, 3, 4)] == [("response", None), ("revisit", 1), ("response", None), ("revisit", 3)]
    found = sorted(f["WARC-Record-ID"] for f, _ in warc.lookup(sorted(map(tuple, directory.collect())), "http://WWW.example.com/a?b=1"))
    assert found == ["<urn:page:1>", "<urn:page:6>"]
    assert warc.url_key("http://www.example.com/a?b#c") == "com,example,www)/a?b"
    assert captures.count() == len(rows)
    nothing, none = warc.write(df.limit(0))
    assert warc.read(none, nothing).count() == 0


def test_warc_many(spark, monkeypatch):
    """Many captures of few URLs, repeated rows and ids among them, over small blocks and several parts; clashing columns."""
    monkeypatch.setattr(warc, "BLOCK_LINES", 7)
    rng = np.random.default_rng(4)
    rows = [(None if k % 19 == 0 else k // 3 if k % 5 == 0 else k, f"http://h{int(rng.integers(3))}.example/{int(rng.integers(4))}" if k % 7 else None, "x" * int(rng.integers(0, 5)), "a", 1) for k in range(300)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, key string, part long").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small parts stay apart
    captures, directory = warc.write(df)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    least = {}
    for page, _, html, *_ in rows:
        if page is not None:
            least[html] = min(page, least.get(html, page))
    want = collections.Counter()
    for page, url, html, *_ in rows:
        kind = "response" if page is None and html not in least or page == least.get(html) else "revisit"
        want[page, warc.url_key(url), len(html), base64.b32encode(hashlib.sha1(html.encode()).digest()).decode(), kind, least[html] if kind == "revisit" else None] += 1
    assert collections.Counter(tuple(r) for r in warc.read(directory, captures).collect()) == want
    assert directory.count() > 40 and directory.select("part").distinct().count() > 1


PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def brute_spans(t):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m.group())
            if k == 1 and any(int(x) > 255 for x in m.group().split(".")) or k == 2 and not (16 <= len(d) <= 19 and pii.luhn(d)) or k == 3 and not 8 <= len(d) <= 15:
                continue
            out.append((k, *m.span()))
    return out


def test_pii_patterns():
    rng = np.random.default_rng(8)
    for _ in range(3000):
        t = "".join(rng.choice(list("a@.1 2+-(9b"), int(rng.integers(0, 40))))
        assert sorted(pii.base_spans(t)) == brute_spans(t), t
    assert pii.base_spans("1" * 200_000 + "a" * 200_000 + "@") == []


def test_pii_windows_hold_every_anchor():
    rng = np.random.default_rng(4)
    for _ in range(300):
        t = "".join(rng.choice(list("a" * 30 + "1"), int(rng.integers(0, 500))))
        last = max(0, -(-(len(t) - pii.WINDOW) // pii.STRIDE))
        assert pii.windows(t) == [k * pii.STRIDE for k in range(last + 1) if re.search("[0-9@]", t[k * pii.STRIDE : k * pii.STRIDE + pii.WINDOW])]


def test_pii_model(spark, docs, empty):
    net = pii.train()
    rng = np.random.default_rng(77)
    hit = [(pii.viterbi(net, pii.emissions(net, pii.codes(x)[:, None]))[0][:, 0] == y).mean() for x, y in (pii.example(rng, pii.WINDOW) for _ in range(150))]
    assert np.mean(hit) > 0.96
    text = "please call (644) 555-7859 now"
    assert pii.added_spans(net, [text], [pii.base_spans(text)]) == [[(3, 12, 26)]]
    clean = "plain prose of 12 words, version 2.0 and 684 more, nothing private"
    assert pii.added_spans(net, [clean], [[]]) == [[]]
    got = {(r.doc_id, r.spans) for r in pii.find(docs, net).collect()}
    assert any(s.startswith("email:5:28") and "phone:" in s and "card:" in s and "ip:" in s for _, s in got)
    assert pii.find(empty, net).count() == 0
    masked = {r.doc_id: r.text for r in pii.redact(docs, net).collect()}
    assert masked[7].startswith("Mail <EMAIL> or call <PHONE> about <IP> and <CARD>") and masked[0] is None
    assert pii.redact(docs, net).columns == docs.columns


def test_cnn_gradients():
    rng = np.random.default_rng(1)
    docs = [bytes(rng.integers(97, 110, int(rng.integers(1, 900))).astype(np.uint8)) for _ in range(6)]
    y = np.array([0, 1, 0, 1, 1, 0], np.float32)
    f = lambda *s: rng.normal(0, 0.4, s).astype(np.float32)
    net = quality_cnn.Net(f(256, 3), f(quality_cnn.WIDTH, 3, 4), f(4), f(4, 3), f(3) + 0.3, f(6), f(1))
    data, ends, starts, owner = quality_cnn.layout(docs)

    def loss():
        z = quality_cnn.head(net, quality_cnn.pooled(data, ends, starts, len(data), net.tables()), owner, len(docs)).astype(float)
        return float(np.mean(np.log1p(np.exp(z)) - y * z))

    grads = quality_cnn.gradients(net, data, ends, starts, owner, y)
    for name in ("filters", "bias", "dense_bias", "out_bias"):
        g, p = grads[name], getattr(net, name)
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, h = p[at], 2e-3
        p[at] = old + h
        up = loss()
        p[at] = old - h
        down = loss()
        p[at] = old
        assert abs((up - down) / (2 * h) - g[at]) < 0.1 * abs(g[at]) + 1e-3, name


def test_cnn_forward_brute_force():
    """Scores of whole texts against loops over every place, filter and chunk."""
    rng = np.random.default_rng(2)
    f = lambda *s: rng.normal(0, 0.4, s).astype(np.float32)
    net = quality_cnn.Net(f(256, 3), f(quality_cnn.WIDTH, 3, 4), f(4), f(4, 3), f(3) + 0.3, f(6), f(1), shift=0.2)
    docs = [bytes(rng.integers(0, 256, n).astype(np.uint8)) for n in (0, 1, 5, 255, 256, 257, 700, 1600)]
    for d, score in zip(docs, quality_cnn.scores(net, docs), strict=True):
        n, size, data = len(d) or 1, quality_cnn.SEGMENT, d + b"\0" * (quality_cnn.WIDTH + 1)
        place = [sum(net.embed[data[i + k]] @ net.filters[k] for k in range(quality_cnn.WIDTH)) for i in range(n)]
        peaks = [np.max(place[i : i + size], axis=0) for i in range(0, n, size)]
        chunks = [np.maximum(p, q) for p, q in itertools.pairwise(peaks)] + [peaks[-1]]
        hidden = [np.maximum(np.maximum(c + net.bias, 0) @ net.dense + net.dense_bias, 0) for c in chunks]
        logit = np.concatenate([np.max(hidden, axis=0), np.mean(hidden, axis=0)]) @ net.out + net.out_bias[0] + net.shift
        assert abs(1 / (1 + np.exp(-logit)) - score) < 1e-4
        assert abs(quality_cnn.scores(net, [d])[0] - score) < 1e-6  # whatever texts are scored beside it


def test_cnn_held_out(spark):
    """On rows whose labels it hasn't seen the network of the query tells both kinds apart."""
    queries = pytest.importorskip("triloom.llm.queries")
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [(r.score, labels[r.doc_id], r.predicted) for r in queries.op8_quality_classifier(spark, sf).collect() if r.held_out and r.doc_id in labels]
    good, bad = ([s for s, y, _ in rows if y == v] for v in (1, 0))
    assert len(rows) > 50 and np.mean([g > b for g in good for b in bad]) > 0.97 and np.mean([p == y for _, y, p in rows]) > 0.93


def test_cnn_scores(spark, docs, empty):
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abcdefgh"), int(rng.integers(2, 8))))
    good = [" ".join(word() for _ in range(120)) for _ in range(60)]
    bad = [" ".join(w.upper() + "!!" for w in t.split()) for t in good[:20]] + [" ".join([word()] * 100) for _ in range(20)]
    rows = [(i, t, int(i < 60)) for i, t in enumerate(good + bad)]
    table = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    net = quality_cnn.fit(table, table.select("doc_id", "quality"))
    got = {r.doc_id: r.score for r in quality_cnn.score(table, net).collect()}
    assert np.mean([got[i] > 0.5 for i in range(60)]) > 0.95 and np.mean([got[i] < 0.5 for i in range(60, 100)]) > 0.9
    assert all(0 <= r.score <= 1 for r in quality_cnn.score(docs, net).collect())
    clash = docs.selectExpr("doc_id", "text", "1 as score", "'x' as predicted", "2 as _kept", "3 as _text")
    kept = quality_cnn.score(clash, net, keep=tuple(clash.columns)).select("_kept.*")
    assert kept.columns == clash.columns and sorted(map(str, kept.collect())) == sorted(map(str, clash.collect()))
    assert quality_cnn.score(empty, net).count() == 0
    none = quality_cnn.fit(table, table.select("doc_id", "quality").limit(0))
    assert {r.score for r in quality_cnn.score(docs, none).collect()} == {0.5}
    # a long text is scored in units, and comes out as in one
    long = " ".join(good * 30).encode()
    old, quality_cnn.UNIT = quality_cnn.UNIT, 1 << 30
    whole = quality_cnn.scores(net, [long])
    quality_cnn.UNIT = 1 << 14
    parts = quality_cnn.scores(net, [long])
    quality_cnn.UNIT = old
    assert np.allclose(whole, parts, atol=1e-5)


def test_licenses(spark):
    text = "Released under the MIT License."
    body = "just some source code without any header " * 5
    rows = [(1, text, "/a/LICENSE"), (2, body, "/a/b/c/x.py"), (3, body, "/z/y.py"), (4, "Licensed under the Apache License, Version 2.0.\n" + body, "/a/b/y.py"), (5, None, None), (6, "", "/a/e.py"), (7, "This work is licensed under the GNU General Public License, version 3.", "/a/b/COPYING"), (8, body, "/a/q.py"), (9, body, "/ab/q.py")]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, path string")).collect()}
    assert [got[i].license for i in range(1, 10)] == ["MIT", "GPL-3.0", None, "Apache-2.0", None, "MIT", "GPL-3.0", "MIT", None]
    assert got[2].license_dir == "/a/b" and got[2].own_license is None and got[4].own_score > 0.9
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string, path string")).count() == 0


def test_tagger_skips_nothing(monkeypatch):
    """Addresses without a digit or at sign are found, and leaving windows out gives what all windows give."""
    net = pii.train()
    text = "write to jane [at] firm [dot] org about it"
    assert [text[s:e] for _, s, e in pii.added_spans(net, [text], [[]])[0]] == ["jane [at] firm [dot] org"]
    rng = np.random.default_rng(9)
    word = lambda: "".join(rng.choice(list("abcdefghilmnoprstu"), int(rng.integers(2, 9))))
    item = lambda: [word(), word(), word(), word(), f"{word()} [at] {word()} [dot] org", f"{word()}_{word()}_{word()}_{word()}_{word()}_{word()}_{word()}@{word()}.org", "(555) 123-4567", f"{word()} (at) {word()}.org", f"{word()}.{word()}.{word()}.{word()}.{word()} [at] {word()}.{word()}.org"][int(rng.integers(9))]
    batch = [" ".join(item() for _ in range(int(rng.integers(1, 120)))) for _ in range(60)]
    bases = [pii.base_spans(t) for t in batch]
    got = pii.added_spans(net, batch, bases)
    monkeypatch.setattr(pii, "windows", lambda t: [k * pii.STRIDE for k in range(pii.last_window(t) + 1)])
    assert got == pii.added_spans(net, batch, bases) and sum(map(len, got)) > 20


def test_reconcile():
    """The set of greatest score, against all subsets; and a text of 100,000 spans in little memory and time."""
    rng = np.random.default_rng(5)
    for _ in range(200):
        text = " ".join("".join(rng.choice(list("123"), 3)) for _ in range(12))
        starts = [int(rng.integers(0, 11)) * 4 for _ in range(int(rng.integers(0, 7)))]
        found = [(3, s, min(len(text), s + 11 + 4 * int(rng.integers(0, 2))), float(rng.random())) for s in starts]
        base = [(2, s, s + 3) for s in rng.integers(0, 45, int(rng.integers(0, 2))).tolist()]
        joined = {}
        for _, s, e, x in sorted(found):
            last = next(reversed(joined), None)
            if last and s <= last[1]:
                joined[last[0], max(e, last[1])] = max(x, joined.pop(last))
            else:
                joined[s, e] = x
        fit = [(s, e, x) for (s, e), x in joined.items() if pii.plausible(3, text[s:e]) and not any(a < e and s < b for _, a, b in base)]
        want = max((sum(x for *_, x in part) for n in range(len(fit) + 1) for part in itertools.combinations(fit, n) if all(p[1] <= q[0] for p, q in itertools.pairwise(sorted(part)))), default=0)
        scores = {(s, e): x for s, e, x in fit}
        assert abs(sum(scores[s, e] for _, s, e in pii.reconcile(text, found, base)) - want) < 1e-9
    text = "(644) 555-7859 " * 100_000
    found = [(3, 15 * k, 15 * k + 14, 1.0) for k in range(100_000)]
    tracemalloc.start()
    got = pii.reconcile(text, found, [(1, 15 * k + 14, 15 * k + 15) for k in range(0, 100_000, 2)])
    assert len(got) == 100_000 and tracemalloc.get_traced_memory()[1] < 300_000_000
    tracemalloc.stop()


def test_added_span_recall():
    """Labelled spans that no pattern has, in generated text: nearly all are found, and little else."""
    net, rng = pii.train(), np.random.default_rng(123)
    hit = total = extra = 0
    for _ in range(60):
        text, tags = pii.example(rng, 600)
        base = pii.base_spans(text)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], tags, [0]])))
        want = {(int(tags[a]) - 1, a, b) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True) if tags[a] and a > 0 and b < len(text)}
        want = {w for w in want if not any(s < w[2] and w[1] < e for _, s, e in base) and pii.plausible(w[0], text[w[1] : w[2]])}
        got = set(pii.added_spans(net, [text], [base])[0])
        hit, total, extra = hit + len(want & got), total + len(want), extra + len({g for g in got - want if g[1] > 0 and g[2] < len(text)})
    assert total > 60 and hit >= 0.8 * total and extra <= 0.1 * total


def test_license_weights(spark):
    """All terms weigh by their own document frequency: scores equal a plain count over all terms, whatever the number of files."""
    line = "Licensed under the Apache License, Version 2.0 or later"
    got = []
    for n in (40, 400):
        texts = [line] * (n // 10) + [f"this or that word, sooner or later, version {i}" for i in range(n - n // 10)]
        files = spark.createDataFrame([(i, t, f"/{i}/x") for i, t in enumerate(texts)], "doc_id long, text string, path string")
        sets = [set(licenses.terms(t)) for t in texts]
        weigh = lambda ws: {w: ws.count(w) * licenses.idf(n, sum(w in s for s in sets)) for w in ws}  # noqa: E731, B023
        a = weigh(licenses.terms(line))
        b = weigh(licenses.terms(dict(reversed(licenses.TEMPLATES))["Apache-2.0"]))
        want = sum(x * b.get(w, 0) for w, x in a.items()) / sum(x * x for x in a.values()) ** 0.5 / sum(x * x for x in b.values()) ** 0.5
        row = next(r for r in licenses.scan(files, threshold=0.7).collect() if r.doc_id == 0)
        assert row.own_license == "Apache-2.0" and abs(row.own_score - want) < 1e-8
        got.append(row.own_score)
    assert abs(got[0] - got[1]) < 0.02


def test_license_files(spark):
    """Full licence texts, rewrapped and with a notice, are licence files; wrapped headers are found; prose is neither."""
    texts = licenses.full_texts()
    body = "just some source code without any header\n" * 30
    rows = [(k, "Copyright 2020 Foo\n\n" + " ".join(texts[name].split()), f"/{name}/COPYING") for k, name in enumerate(sorted(texts))]
    rows += [(10 + k, body, f"/{name}/src/x.py") for k, name in enumerate(sorted(texts))]
    rows += [(20, "# This work is licensed under\n# the GNU General\n# Public License,\n# version 3.\n" + body, "/h/x.py"), (21, body, "/h/y.py"), (22, "\n\n".join(texts["MIT"].split("\n")[2:]), "/m/LICENSE"), (23, body, "/m/x.py")]
    rows += [(30 + k, f"the work of the day and the terms of it are a matter for you {k}. " * 20, "/p/x") for k in range(30)]
    rows += [(60, "Use of this source code is governed by a\nBSD-style license that can be found in the LICENSE file.", "/w/LICENSE"), (61, body, "/w/x.py")]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, path string")).collect()}
    for k, name in enumerate(sorted(texts)):
        assert (got[k].own_license, got[10 + k].own_license, got[10 + k].license) == (name, None, name)
    assert got[20].own_license == "GPL-3.0" and got[21].license is None
    assert got[22].own_license == "MIT" and got[23].license == "MIT" and got[60].own_license == "BSD-3-Clause" and got[61].license == "BSD-3-Clause"
    assert all(got[30 + k].license is None for k in range(30))


def test_license_headers(spark):
    """Notices in comments, SPDX tags and rewrapped headers, among code; unknown tags, ties, repeated rows and clashing columns."""
    body = "\n".join(f"int x{i} = compute_{i}(y{i}); // step {i}" for i in range(40))
    apache = "\n".join(["// Copyright 2019 Foo", "//", *("// " + x for x in licenses.TEMPLATES[1][1].split(". ")), "//"])
    gpl = dict(licenses.TEMPLATES)["GPL-3.0"]
    wrapped = "\n".join(" * " + " ".join(gpl.split()[i : i + 9]) for i in range(0, len(gpl.split()), 9))
    texts = [
        (apache + "\n" + body, "Apache-2.0"), ("/*\n" + wrapped + "\n */\n" + body, "GPL-3.0"), ("# SPDX-License-Identifier: MIT\n" + body, "MIT"),
        ("# SPDX-License-Identifier: GPL-2.0-or-later\n" + body, "GPL-2.0"), ("# SPDX-License-Identifier: Foo\n" + body, None), ("the software is free and the source of it is open\n" + body, None),
        (body, None), (None, None), ("", None), ("license " * 3000, None), (body * 200 + "\nReleased under the MIT License.\n" + body, "MIT"),
    ]
    rows = [(None if k == 2 else k, t, f"/{k}/x.c", "a", 1, "b") for k, (t, _) in enumerate(texts)]
    df = spark.createDataFrame([*rows, rows[0], *[(100 + k, f"w{k} " * 30, None, "a", 1, "b") for k in range(200)]], "doc_id long, text string, path string, term string, score int, _row string")
    got = collections.Counter((r.doc_id, r.own_license) for r in licenses.scan(df.repartition(3)).collect())
    want = collections.Counter((r[0], own) for r, (_, own) in zip([*rows, rows[0]], [*texts, texts[0]], strict=True))
    assert {k: v for k, v in got.items() if k[0] is None or k[0] < 100} == dict(want)
    same = [("B", "Free as the wind of dawn"), ("A", "Free as the wind of dawn")]
    one = licenses.scan(spark.createDataFrame([(1, "free as the wind of dawn", "/LICENSE"), (2, "x", "/y")], "doc_id long, text string, path string"), templates=same, whole_texts={}).collect()
    assert [(r.own_license, r.license) for r in sorted(one, key=lambda r: r.doc_id)] == [("A", "A"), (None, "A")]


def test_deduplicate_by_row(spark):
    """Stage 3 keeps one row of each group, whatever the ids: null, or shared by rows with different texts."""
    pipeline = pytest.importorskip("corpus_pipeline")
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    rows = [(None, a), (None, a), (5, b), (5, c), (3, b), (None, d), (8, d), (9, ""), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = pipeline.deduplicate(spark, docs, "").collect()
    assert collections.Counter((r.doc_id, r.text) for r in got) == collections.Counter([(None, a), (5, c), (3, b), (8, d), (9, ""), (None, "")])


def test_pipeline_edges(spark):
    """All stages on null and repeated ids, null and empty texts, columns with the stages' own names, and an empty table."""
    pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    good = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").where("lang = 'en' and n_chars between 800 and 4000").orderBy("doc_id").limit(4).collect()]
    rows = [(None, good[0]), (None, good[0]), (1, good[1]), (1, good[2]), (2, good[1]), (3, None), (4, ""), (None, None), (5, good[3] + " call (644) 555-7859")]
    names = "lang string, source string, n_chars long, score string, predicted int, kept string, _kept int, _row string, _group string, _doc string, component_id string, set string, key string, base_failed int"
    docs = spark.createDataFrame([(i, t, "en", None, None if t is None else len(t), "s", 1, "k", 2, "r", "g", "d", "c", "x", "y", 3) for i, t in rows], f"doc_id long, text string, {names}").repartition(3)
    for table in (docs, docs.limit(0)):
        kept = table
        for _, stage in pipeline.STAGES[:-1]:
            kept = stage(spark, kept, sf).cache()
            assert kept.columns == docs.columns
        last = pipeline.STAGES[-1][1](spark, kept, sf)
        assert last.count() >= kept.count()
        if table is docs:
            assert all((r.score, r.predicted, r.kept, r._kept, r._row, r._group, r._doc, r.key) == ("s", 1, "k", 2, "r", "g", "d", "y") for r in kept.collect())
    only = pipeline.deduplicate(spark, docs, sf).collect()
    assert collections.Counter((r.doc_id, r.text) for r in only) == collections.Counter([(None, good[0]), (1, good[1]), (1, good[2]), (3, None), (4, ""), (None, None), (5, good[3] + " call (644) 555-7859")])
    for name, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns, name


def test_pipeline(spark):
    """Decisions of all stages on a small corpus: junk, short texts and copies go, personal data are masked, pieces add up."""
    pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    for name, stage in pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, sf).cache()
        assert kept.columns == docs.columns, name
        assert kept.count() <= before.count()
    rows = kept.collect()
    texts = [(r.doc_id, r.text) for r in rows]
    assert not any(pii.base_spans(t) for _, t in texts)
    assert all(len(re.findall(WORD, t)) >= 19 for _, t in texts) and all(r.n_chars == len(r.text) for r in rows)
    found = brute_components(texts)
    assert len({c for _, c in found.values()}) >= 0.99 * len(found)
    pieces = pipeline.run(spark, sf).collect()
    assert {p.doc_id for p in pieces} == {r.doc_id for r in rows}
    totals = collections.Counter()
    for p in pieces:
        totals[p.doc_id] += p.length
    assert all(totals[p.doc_id] == p.doc_tokens for p in pieces)


def brute_kept(rows):
    """Rows that the quality rules keep, with the hosts' prior, in plain Python."""
    measured, hosts = [], collections.defaultdict(list)
    for r in rows:
        t = r.text or ""
        w = re.findall(WORD, t)
        n = len(w)
        seen = collections.Counter(tuple(w[i : i + 8]) for i in range(n - 7))
        repeated = len({p for i in range(n - 7) if seen[tuple(w[i : i + 8])] > 1 for p in range(i, i + 8)})
        lines = [x for x in t.split("\n") if re.search(WORD, x)]
        chars = sum(map(len, w))
        base = n < 20 or 100 * repeated > 30 * n
        soft = sum([4 * len(re.findall(r"[#*$%&|<>]", t)) > n, 100 * (len(lines) - len(set(lines))) > 30 * len(lines), 10 * repeated > n, chars < 2 * n or chars > 20 * n])
        measured.append((r, base, soft))
        hosts[r.source].append(base or soft > 0)
    rates = [sum(x) / len(x) for x in hosts.values()]
    mean = min(max(sum(map(sum, hosts.values())) / len(measured), 1e-4), 1 - 1e-4)
    spread = max(np.var(rates) - mean * (1 - mean) * np.mean([1 / len(x) for x in hosts.values()]), 1e-6)
    strength = min(max(mean * (1 - mean) / spread - 1, 2), 1e6)
    return [r for r, base, soft in measured if not base and soft < (1 if (sum(hosts[r.source]) + mean * strength) / (len(hosts[r.source]) + strength) >= 0.5 else 2)]


def test_pipeline_counts_all_rows(spark, monkeypatch):
    """The pipeline's join orders shingles by counts of all the rows it gets, and keeps the first of each copy."""
    pipeline = pytest.importorskip("corpus_pipeline")
    seen, sketches = [], setjoin.sketches
    monkeypatch.setattr(setjoin, "sketches", lambda *a: seen.append(len(a[3])) or sketches(*a))
    docs = spark.createDataFrame(passages_in_three(26_000), "doc_id long, text string")
    got = pipeline.deduplicate(spark, docs, "")
    assert sorted(r.doc_id for r in got.select("doc_id").collect()) == list(range(26_060))
    assert seen == [20 * 2]


def test_pipeline_decisions(spark):
    """Each stage's rows on the test table equal those that plain Python keeps of the stage before."""
    from tokenizers import Tokenizer

    pipeline = pytest.importorskip("corpus_pipeline")
    queries = pytest.importorskip("triloom.llm.queries")
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    key = lambda rows: sorted((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in rows)
    rows = docs.collect()
    stages = dict(pipeline.STAGES)
    ran = []

    def step(name, want):
        got = stages[name](spark, spark.createDataFrame(rows, docs.schema), sf).collect()
        assert key(got) == key(want), name
        ran.append(name)
        return got

    net = queries.fitted(spark, docs, sf)
    rows = step("quality classifier", [r for r in rows if quality_cnn.scores(net, [(r.text or "").encode()])[0] >= 0.3])
    rows = step("quality rules", brute_kept(rows))
    found = brute_components([(r.doc_id, r.text) for r in rows])
    rows = step("n-gram jaccard join", [r for r in rows if found[r.doc_id][1] == r.doc_id])
    tagger, want = pii.train(), []
    for r in rows:
        base = brute_spans(r.text)
        text = pii.masked(r.text, base + pii.added_spans(tagger, [r.text], [base])[0])
        want.append(type(r)(**{**r.asDict(), "text": text, "n_chars": len(text)}))
    rows = step("personal data", want)
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    expected = {r.doc_id: [*tok.encode(r.text, add_special_tokens=False).ids, 1] for r in rows}
    covered = collections.defaultdict(list)
    for p in pipeline.pack(spark, spark.createDataFrame(rows, docs.schema), sf).collect():
        ids = expected[p.doc_id]
        assert p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(struct.pack(f"<{p.length}I", *ids[p.start : p.start + p.length]))
        covered[p.doc_id].append((p.start, p.length))
    assert set(covered) == set(expected)
    for k, parts in covered.items():
        ends = [0, *(a + b for a, b in sorted(parts))]
        assert [a for a, _ in sorted(parts)] == ends[:-1] and ends[-1] == len(expected[k])
    assert ran == [name for name, _ in pipeline.STAGES[:-1]]
