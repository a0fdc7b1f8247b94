"""The operators against brute force on small tables with nulls, empty and long texts, ties, repeats and extra columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from tidemark.llm import bpe, html_boilerplate, langid, minhash_join, packing, quality, substring_dedup, suffix_dedup, topk_cover_tree, warc
from tidemark.llm._spark import new_path
from tidemark.llm.queries import tokenizer_file

SPACE = " \t\n\x0b\x0c\r"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def docs():
    """(doc_id, text): shared passages, copies, near copies, nulls, empty, odd characters, long texts, repeated rows."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, base = make(70), [make(rng.randint(1, 200)) for _ in range(30)]
    rows = list(enumerate(base))
    rows += [(100 + i, t) for i, t in enumerate(base[:8])]
    rows += [(200 + i, t + " " + make(2)) for i, t in enumerate(base[:15])]
    rows += [(300 + i, make(20) + "\n" + passage + "\t" + make(5)) for i in range(6)]
    rows += [(400, None), (401, ""), (402, "  \n "), (403, "one"), (404, "One\x1cTwo x y"), (405, make(6000)), (406, "ab" * 4000), (407, "the " * 300)]
    rows += [(None, base[0]), (1, base[1]), (1, base[1])]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def frame(spark, docs):
    return spark.createDataFrame([(i, t, "x", 7) for i, t in docs], "doc_id long, text string, chunk string, n_words int").repartition(3)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def test_top_k(spark):
    rng = random.Random(1)
    rows = [(i, [float(np.float32(rng.gauss(0, 1))) for _ in range(6)]) for i in range(300)]
    rows += [(i, list(rows[0][1])) for i in range(300, 330)] + [(400, None), (401, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (402, [float("nan")] * 6), (403, []), (404, [1.0, 2.0]), (405, [3e300] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    valid = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows if v and all(x is not None and np.isfinite(256 * x) for x in v)}
    got = defaultdict(list)
    for r in topk_cover_tree.top_k(df, df.where("vec_id % 5 = 0"), 5).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    clip = lambda s: max(1 - (1 << 63), min((1 << 63) - 1, s))
    for q, v in valid.items():
        if q % 5 == 0:
            scored = [(-clip(sum(a * b for a, b in zip(v, w))), i) for i, w in valid.items() if i != q and len(w) == len(v)]
            assert got[q] == [(i, -s) for s, i in sorted(scored)[:5]]
    assert topk_cover_tree.top_k(df.limit(0), df.limit(0), 5).count() == 0


def test_cover_tree_covers():
    x = np.random.default_rng(0).normal(size=(3000, 4)).round(1) * 256
    tree = topk_cover_tree.Tree(x)
    assert len(tree.start) > 10 and sorted(tree.order.tolist()) == list(range(3000))
    for i in range(len(tree.start)):
        rows = tree.order[tree.start[i] : tree.stop[i]]
        assert np.sqrt(((x[rows] - x[tree.centre[i]]) ** 2).sum(1)).max() <= tree.radius[i] + 1e-9
    best = topk_cover_tree.Best(1, 5)
    scored, offer = [], topk_cover_tree.Best.offer
    best.offer = lambda rows, score, *a: (scored.append(score.size), offer(best, rows, score, *a))
    topk_cover_tree.search(topk_cover_tree.Tree(x[:1]), np.array([0]), tree, np.arange(3000), best)
    assert sum(scored) < 2000  # some of the candidates are pruned
    expected = np.lexsort((np.arange(3000), -(x @ x[0])))
    assert best.id[0].tolist() == [i for i in expected.tolist() if i != 0][:5]


def test_warc(spark):
    long, other = "<p>" + "é" * 60 + "</p>", "y" * 100
    pages = [(3, "u3", long), (1, "u1", long), (2, None, other), (5, "u5", "short"), (6, "u\r\n6", "short"), (7, "u7", None), (8, "u8", ""), (9, "u9", other), (None, "n", other), (4, "big", "z" * 3_000_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2)
    path = new_path(spark, "warc-test")
    warc.write_archives(warc.plan_records(df), path, archive_size=1000)
    got = {r.page_id: r for r in warc.read_archives(spark.read.parquet(path)).collect()}
    assert len(got) == len(pages)
    for i, _, html in pages:
        raw = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
        assert got[i].payload == (raw if got[i].record_type == "response" else None)
    assert {i: r.refers_to for i, r in got.items() if r.record_type == "revisit"} == {3: 1, 9: 2, None: 2}
    assert warc.plan_records(df.limit(0)).count() == 0


def test_archive_has_a_leading_dictionary():
    records = [b"WARC/1.1\r\nsome header: %d\r\n\r\n" % i + b"common body text " * 30 for i in range(200)]
    content = warc.archive_bytes(records)
    assert content[:4] == b"\x5d\x2a\x4d\x18" and list(warc.records_of(content)) == records


def brute_windows(docs, width, units):
    """Kept units by row: those not covered by a window that also starts in a row of smaller id."""
    cut = [units(t) for _, t in docs]
    first = {}
    for (i, _), u in zip(docs, cut):
        for k in range(len(u) - width + 1 if i is not None else 0):
            first[tuple(u[k : k + width])] = min(i, first.get(tuple(u[k : k + width]), i))
    out = []
    for (i, _), u in zip(docs, cut):
        gone = set()
        for k in range(len(u) - width + 1 if i is not None else 0):
            if first[tuple(u[k : k + width])] < i:
                gone.update(range(k, k + width))
        out.append((i, u, gone))
    return out


@pytest.mark.parametrize("width", [50, 12])
def test_substring_dedup(frame, docs, empty, width):
    got = Counter((r.doc_id, r.n_words, sum(s.stop - s.start for s in r.spans), r.kept, r.rest.chunk) for r in substring_dedup.remove_repeats(frame, width).collect())
    want = Counter((i, len(u), len(g), " ".join(w for k, w in enumerate(u) if k not in g), "x") for i, u, g in brute_windows(docs, width, words))
    assert got == want
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_suffix_dedup(frame, docs, empty):
    got = Counter((r.doc_id, r.n_bytes, sum(s.stop - s.start for s in r.spans), len(r.spans), bytes(r.kept)) for r in suffix_dedup.remove_repeats(frame).collect())
    want = Counter()
    for i, u, g in brute_windows(docs, 50, lambda t: (t or "").encode()):
        starts = sum(1 for k in g if k - 1 not in g)
        want[i, len(u), len(g), starts, bytes(c for k, c in enumerate(u) if k not in g)] += 1
    assert got == want
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_suffix_array_is_sorted():
    rng = random.Random(3)
    for _ in range(60):
        parts = [bytes(rng.choice(b"ab\x00\xff") for _ in range(rng.randint(1, 25))) for _ in range(rng.randint(1, 6))]
        s = np.concatenate([np.append(np.frombuffer(p, np.uint8).astype(np.int16) + 1, np.int16(0)) for p in parts])
        order = suffix_dedup.suffix_array(s, 12)
        key = lambda i: [int(c) for c in s[i : i + 12]][: ([int(c) for c in s[i : i + 12]] + [0]).index(0) + 1]
        keys = [key(i) for i in order]
        assert sorted(order.tolist()) == list(range(len(s))) and keys == sorted(keys)
        ends = np.flatnonzero(s == 0)
        first = np.concatenate(([0], ends[:-1] + 1))
        count = np.array([rng.randint(1, e - f + 1) for f, e in zip(first, ends)])
        some = {k for f, c in zip(first, count) for k in range(f, f + c)}
        part = [i for i in suffix_dedup.suffix_array(s, 12, None, first, count).tolist() if i in some]
        assert sorted(part) == sorted(some) and [key(i) for i in part] == sorted(key(i) for i in part)


def test_packing(frame, docs, empty):
    path = tokenizer_file("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    docs = [*docs, (500, "hello <|startoftext|> world<|endoftext|>"), (501, "<|STARTOFTEXT|> " + "<|endoftext|>" * 3000)]
    frame = frame.unionByName(frame.sparkSession.createDataFrame([(i, t, "x", 7) for i, t in docs[-2:]], frame.schema))
    pieces = packing.pack_documents(frame, path).collect()
    want = Counter()
    for i, t in docs:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want[i, zlib.crc32(ids.tobytes()), len(ids)] += 1
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert len(p.ids_le) == 4 * p.length
        by_sequence[p.sequence_id].append((p.offset, p.length))
        by_doc[p.doc_id, p.doc_tokens].append((p.start, p.length, bytes(p.ids_le)))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 2048 or at & (at - 1) == 0 and at < 2048
    for (i, n), parts in by_doc.items():
        if sum(1 for d, _, m in want.elements() if (d, m) == (i, n)) == 1:
            whole = b"".join(b for _, _, b in sorted(parts))
            assert want[i, zlib.crc32(whole), n] == 1 and len(whole) == 4 * n
    assert sum(p.length for p in pieces) == sum(n for _, _, n in want.elements())
    assert packing.pack_documents(empty, path).count() == 0


def test_packing_ids_are_those_of_the_tokenizer():
    path = tokenizer_file("word_bpe_49k.json")
    tokenizer, encode, rng = Tokenizer.from_file(path), packing.encoder(path).encode, random.Random(8)
    alphabet = [chr(c) for c in range(1, 0x260)] + list("ΣσςİſK\u0301\u200b\u2028\u00a0ẞ漢かな한🙂\u200d")
    alphabet += ["<|startoftext|>", "<|endoftext|>", "<|STARTOFTEXT|>", "<|", "'s", "'LL", " ", "  ", "a", "B"] * 8
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25)))
        assert np.frombuffer(encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_quality(frame, docs, empty):
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.judge(quality.measure(frame)).collect())
    want = Counter()
    for i, t in docs:
        w, lines = words(t), [x for x in (t or "").split("\n") if x.strip(SPACE)]
        windows = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {k + j for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for j in range(5)}
        base = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        want[i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered), base] += 1
    assert got == want
    assert quality.judge(quality.measure(empty)).count() == 0


def test_quality_runs_no_python(frame):
    plan = quality.judge(quality.measure(frame))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_html(spark):
    page = lambda body: f"<html><head><title>T</title><style>p{{}}</style></head><body>{body}</body></html>"
    template = "<div>please read our terms and follow the house rules before you write to us</div>"
    pages = [
        (1, "http://a.org/1", page("<nav>menu</nav><article><h1>A &amp; B</h1><p>one<br>two <b>th</b>ree<p>four<div class='comments'><p>bad</p></div></article><footer>f</footer>")),
        (2, "http://a.org/2", page("<header>top</header><main><p>x &lt; y</p><form>no</form></main><script>var a='</p>'</script><!-- c -->")),
        (3, "http://b.org/1", page(template + "<p>first text that stands alone here</p>")),
        (4, "http://b.org/2", page(template + "<p>second text that stands alone here</p>")),
        (5, "http://b.org/3", page(template + "<h1>Head</h1><p>third text that stands alone here</p>")),
        (6, None, None), (7, "odd", ""), (8, "http://a.org/1", "<p>unclosed <i>text"), (None, "http://c.org", "<p>x"),
    ]
    got = {r.page_id: r.text for r in html_boilerplate.extract(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)).collect()}
    assert got == {
        1: "A & B\none two three\nfour", 2: "x < y", 3: "first text that stands alone here", 4: "second text that stands alone here",
        5: "Head\nthird text that stands alone here", 6: "", 7: "", 8: "unclosed text", None: "x",
    }
    assert html_boilerplate.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(frame, docs, empty, width):
    sets, parent = {}, {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
        parent[i] = i

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    known = sorted(i for i in sets if i is not None)
    for i in known:
        for j in known:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash_join.near_duplicates(frame, width).collect()}
    want = {(i, len(s), None if i is None else root(i), i is None or root(i) == i) for i, s in sets.items()}
    assert got == want
    assert minhash_join.near_duplicates(empty).count() == 0


def test_language_id(spark, empty):
    path = tokenizer_file("piece_bpe_32k.model")
    sf = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source")
    odd = spark.createDataFrame([(9001, None, "en", None), (9002, "", None, "s"), (9003, "12 %% !", "fr", "s"), (9004, "word" * 3000, None, "s")], sf.schema)
    whole = sf.union(odd).withColumn("held_out", langid.held_out(sf["doc_id"]))
    model = langid.train(whole.where("NOT held_out"), path, bound=60)
    got = {r.doc_id: r for r in langid.predict(whole, model).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (9001, 9002, 9003)) and got[9004].lang_pred != "und"
    tested = [r for i, r in got.items() if r.held_out and i < 9000]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 4 == 2) == r.held_out for r in got.values())
    assert sum(r.lang_pred == r.lang for r in tested) >= 0.9 * len(tested) > 0
    nothing = langid.train(empty, path)
    assert {r.lang_pred for r in langid.predict(whole, nothing).collect()} == {"und"}


def test_forward_sums_all_segmentations():
    vocabulary = langid.vocabulary(tokenizer_file("piece_bpe_32k.model"))
    chance = np.random.default_rng(0).random((vocabulary.size, 2))
    spelt = [langid.shaped(w) for w in ("theend", "a", "straße漢字", "été", "qzxqz")]

    def total(rest, k):
        if not rest:
            return 1.0
        out = 0.0 if vocabulary.number.get(rest[0], -1) >= 0 else chance[-1, k] * total(rest[1:], k)
        return out + sum(chance[vocabulary.number[rest[:n]], k] * total(rest[n:], k) for n in range(1, len(rest) + 1) if vocabulary.number.get(rest[:n], -1) >= 0)

    together = langid.forward_many(vocabulary, spelt, chance)
    for i, word in enumerate(spelt):
        expected = np.log([total(word, 0), total(word, 1)])
        assert np.allclose(together[i], expected)
        assert np.allclose(langid.forward_long(vocabulary.lattice(word), len(word), chance), expected)
    assert langid.forward_many(vocabulary, [], chance).shape == (0, 2)


def test_bpe(frame, docs, empty, monkeypatch):
    how = tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    encoder = bpe.encoder(*how)
    truth = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})
    got = Counter((r.doc_id, tuple(r.ids), bytes(r.decoded), r.chunk) for r in bpe.decode(bpe.encode(frame, *how), *how).collect())
    assert got == Counter((i, tuple(truth.encode_ordinary(t or "")), (t or "").encode(), "x") for i, t in docs)
    rng = random.Random(2)
    parts = [" ", "  ", "\n", "\t", "a", "the", "é", "1", "'s", ".", "\x1c", "\x85", "\xa0", " ", "日本", "😀", "\r\n", "\x00", "<|endoftext|>"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 10)))
        assert np.frombuffer(encoder.encode(text), np.int32).tolist() == truth.encode_ordinary(text)
    long = "ab" * 20000 + "thequick" * 2000
    assert np.frombuffer(encoder.encode(long), np.int32).tolist() == truth.encode_ordinary(long)
    monkeypatch.setattr(bpe, "GROUP_CHARACTERS", 100)  # longer texts go match by match
    monkeypatch.setattr(bpe, "GROUP_MATCHES", 7)
    monkeypatch.setattr(bpe, "CACHED_PIECES", 20)
    mixed = " ".join(rng.choice(["the", "quick", "brown's", "foxé", "12  ", "zq" * 300]) for _ in range(200))
    assert [np.frombuffer(x, np.int32).tolist() for x in encoder.encode_all([mixed, "", "ab " * 20])] == [truth.encode_ordinary(t) for t in (mixed, "", "ab " * 20)]
    assert bpe.encode(empty, *how).count() == 0


def host_pages(spark, bodies, url="http://h.org"):
    """The text of each page of one host, by number."""
    rows = [(i, f"{url}/{i}", f"<html><body>{b}</body></html>") for i, b in enumerate(bodies)]
    made = html_boilerplate.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3))
    return {r.page_id: r.text for r in made.collect()}


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(10**6)}" for _ in range(n))


def test_html_copies_under_other_menus(spark):
    article, line = prose("article", 60).split(), prose("line", 12)
    near = [" ".join(article[:k] + [f"edit{k}"] + article[k + 1 :]) for k in (5, 20, 40)]
    same = [" ".join(article)] * 4
    bodies = [f"<nav>{prose(f'menu {i}', 9)}</nav><p>{t}</p>" for i, t in enumerate(same + near)]
    assert host_pages(spark, bodies) == dict(enumerate(same + near))
    # A line on four of forty pages is a phrase there, on six it is boilerplate.
    for n, gone in ((4, False), (6, True)):
        own = [prose(f"own {i}", 30) for i in range(40)]
        got = host_pages(spark, [f"<p>{t}</p>" + (f"<p>{line}</p>" if i < n else "") for i, t in enumerate(own)])
        assert got == {i: t + (f"\n{line}" if i < n and not gone else "") for i, t in enumerate(own)}


def test_html_line_within_articles(spark):
    line, quote = prose("subscribe", 14), prose("quote", 30)
    own = [prose(f"article {i}", 40) for i in range(12)]
    # The line goes; a passage that five of twelve articles quote and an article that stands twice stay.
    bodies = [f"<article><p>{t}</p><p>{line}</p>" + (f"<p>{quote}</p>" if i < 5 else "") + "</article>" for i, t in enumerate(own)]
    bodies.append(f"<nav>{prose('menu', 9)}</nav>{bodies[0]}")
    want = {i: t + (f"\n{quote}" if i < 5 else "") for i, t in enumerate(own)}
    assert host_pages(spark, bodies) == want | {12: want[0]}
    # An article's title stays although other pages advertise it.
    title = prose("title", 10)
    ads = [f"<div class='ad'>{title}</div><article><p>{t}</p></article>" for t in own[1:]]
    assert host_pages(spark, [f"<article><h1>{title}</h1><p>{own[0]}</p></article>", *ads]) == {0: f"{title}\n{own[0]}"} | dict(enumerate(own[1:], 1))


def test_html_large_host_is_judged_as_a_whole(spark, monkeypatch):
    line, notice, copied = prose("line", 14), prose("notice", 12), prose("copied", 50)
    own = [prose(f"page {i}", 25) for i in range(300)]
    bodies = [f"<p>{t}</p>" + (f"<p>{notice}</p>" if i % 25 == 0 else "") for i, t in enumerate(own)]
    bodies += [f"<nav>{prose(f'menu {i}', 9)}</nav><p>{copied}</p>" for i in range(30)]
    bodies += [f"<article><p>{prose(f'main {i}', 25)}</p><p>{line}</p></article>" for i in range(400)]
    whole = host_pages(spark, bodies)
    monkeypatch.setattr(html_boilerplate, "SHARD_PAGES", 32)  # more shards than pages with the notice
    assert host_pages(spark, bodies) == whole
    monkeypatch.setattr(html_boilerplate, "SHARD_PAGES", 2048)
    monkeypatch.setattr(html_boilerplate, "SHARD_BYTES", 20_000)
    assert host_pages(spark, bodies) == whole
    assert whole[0] == own[0] and whole[300] == copied and whole[330] == prose("main 0", 25)


def test_top_k_with_repeated_ids(spark):
    rows = [(i, [1.0, 2.0]) for i in (50, 50, 51, 52, 53, 54, 55)] + [(7, [3.0, 0.5])] * 2 + [(8, [0.5, 0.25])] * 8
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    got = topk_cover_tree.top_k(df, df.where("vec_id IN (50, 7)"), 5).collect()
    want = []
    for q, v in rows:
        if q in (50, 7):
            scored = sorted((-int(65536 * sum(a * b for a, b in zip(v, w))), i) for i, w in rows if i != q)[:5]
            want += [(q, n, i, -score) for n, (score, i) in enumerate(scored, 1)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_language_id_learns_from_long_strings(spark):
    path = tokenizer_file("piece_bpe_32k.model")
    vocabulary, rng = langid.vocabulary(path), random.Random(3)
    chance = np.random.default_rng(0).random(vocabulary.size)
    word = langid.shaped("thequickbrownfox")
    how = vocabulary.lattice(word), len(word), chance / chance.sum()
    assert [p for p, _ in langid.expected_long(*how)] == [p for p, _ in langid.expected(*how)]
    assert np.allclose([x for _, x in langid.expected_long(*how)], [x for _, x in langid.expected(*how)])
    word = langid.shaped("".join(rng.choices("abcdefgh", k=5000)))
    got = langid.expected_long(vocabulary.lattice(word), len(word), chance / chance.sum())
    covered = np.zeros(len(word))
    for (i, j, _), (_, x) in zip(vocabulary.lattice(word), got):
        covered[i:j] += x
    assert np.allclose(covered, 1)
    # Languages written without spaces: each text is one string.
    text = lambda letters: "".join(rng.choices(letters, k=300))
    rows = [(i, text(letters), lang) for i, (lang, letters) in enumerate([("xa", "的一是不了人我在有他"), ("xb", "这中大来上国个到说们")] * 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df.where("doc_id < 30"), path)
    told = langid.predict(df.where("doc_id >= 30"), model).collect()
    assert len(told) == 10 and all(r.lang_pred == r.lang for r in told)
